"""A pipeline over documents: each stage works on all that the one before kept.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a
DataFrame, the last one token digests and the others the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ternway.llm import decontaminate, jaccard, langid, toxicity
from ternway.llm.common import ship, without, written
from ternway.llm.queries import bpe_digests, language_model, table, toxicity_net

#: Part of a language's usual share of known n-grams below which a text is in none of the learned languages.
LEAST_SHARE = 0.25

#: SQL can't express the fitted classifiers and the tokenizer.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leave out documents that the classifier, fitted on these documents' labels, predicts toxic."""
    ship(spark)
    net = toxicity_net(docs, table(spark, sf_dir, "labels"))
    return toxicity.keep(docs, net)


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leave out documents without a letter or in none of the languages that the documents are marked with."""
    ship(spark)
    return langid.keep(docs, language_model(docs), LEAST_SHARE)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep of each group the document with the smallest doc_id; of several rows with it the one with the smallest text. Documents without a doc_id stay."""
    ship(spark)
    groups = jaccard.near_duplicates(docs)
    copies = written(groups.where("doc_id <> component_id").select("doc_id").distinct(), "copies")
    repeated = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    left = without(docs, "doc_id", copies)
    if repeated.isEmpty():
        return left
    ordered = ["text", *[c for c in docs.columns if c not in ("text", "doc_id")]]
    least = left.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct(*ordered)).alias("least")).select("doc_id", "least.*").select(*docs.columns)
    return least.unionByName(left.where("doc_id is null"))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leave out documents that hold a benchmark item, also with other numbers, names and units."""
    found = decontaminate.leaks(docs, table(spark, sf_dir, "benchmark"))
    return without(docs, "doc_id", written(found.select("doc_id").distinct(), "leaks"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the documents that are left."""
    ship(spark)
    return bpe_digests(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("language ID", drop_unknown_language),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("BPE", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents; between stages the documents are written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

"""The registered queries on the smallest tables: SQL where there is any, plain versions or held-out accuracy elsewhere."""

import hashlib
import os
import zlib

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from ternway.llm import bpe, queries
from ternway.llm.common import texts

DATA = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def tables(spark):
    return {t: spark.read.parquet(f"{DATA}/{t}.parquet").toPandas() for t in TABLES}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got = queries.queries()[name](spark, DATA)
    columns = ", ".join(sorted(got.columns))
    expected = c.execute(f"SELECT {columns} FROM ({queries.oracle_sql()[name]})").fetchall()
    assert sorted(map(str, map(tuple, got.select(*sorted(got.columns)).collect()))) == sorted(map(str, expected))


def test_token_queries(spark, tables):
    tok = bpe.tokenizer(queries.tokenizer_path())
    digests = {r.doc_id: r for r in queries.op7_bpe(spark, DATA).collect()}
    files = {r.doc_id: r for r in queries.op4_token_files(spark, DATA).collect()}
    start = 0
    for r in tables["documents"].sort_values("doc_id").itertuples():
        ids = tok.encode(r.text or "", add_special_tokens=False).ids
        text = tok.decode(ids, skip_special_tokens=False)
        assert tuple(digests[r.doc_id])[1:] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
        assert tuple(files[r.doc_id])[1:] == (start, len(ids) + 1, zlib.crc32(np.array([*ids, 0], "<u4").tobytes()))
        start += len(ids) + 1


def test_language_query(spark, tables):
    got = queries.op1_language_id(spark, DATA).toPandas().merge(tables["documents"], on="doc_id")
    held = got[got.held_out & got.lang.notna()]
    assert len(got) == len(tables["documents"]) and (held.lang_pred == held.lang).mean() > 0.95


def test_toxicity_query(spark, tables):
    got = queries.op3_toxicity(spark, DATA).toPandas()
    assert len(got) == len(tables["documents"]) and got.score.between(0, 1).all() and ((got.score >= 0.7) == (got.predicted == 1)).all()


def test_leak_query(spark, tables):
    got = {(r.doc_id, r.item_id) for r in queries.op5_decontaminate(spark, DATA).collect()}
    docs, items = tables["documents"], tables["benchmark"]
    assert got == {(d.doc_id, b.item_id) for b in items.itertuples() for d in docs[docs.text.str.contains(b.text, regex=False)].itertuples()}


def test_pipeline(spark, tables):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    left = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, left = left, corpus_pipeline.written(stage(spark, left, DATA), "test")
        assert left.columns == docs.columns and left.count() <= before.count() and left.join(before, "doc_id", "left_anti").isEmpty(), name
    final = corpus_pipeline.run(spark, DATA).toPandas()
    assert sorted(final.doc_id) == sorted(r.doc_id for r in left.collect())
    assert len(final) > 0.6 * len(tables["documents"])


def test_pipeline_is_its_plain_version(spark, tables):
    """Stage by stage on the driver: the models' own scores, all pairs of sets, items inside texts, the library's ids."""
    from test_groups import plain_groups

    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    column = lambda rows: texts(pa.array([r.text for r in rows], pa.string()))
    net, left = queries.toxicity_net(docs, labels), docs.collect()
    left = [r for r, score in zip(left, net.score(*column(left)), strict=True) if score < 0.7]
    model = queries.language_model(spark.createDataFrame(left, docs.schema))
    _, _, share, grams = model.predict(*column(left))
    left = [r for r, s, n in zip(left, share, grams, strict=True) if (s >= corpus_pipeline.LEAST_SHARE or n == 0) and any(c.isalpha() for c in r.text or "")]
    groups = plain_groups([(r.doc_id, r.text) for r in left])
    left = [r for r in left if groups[r.doc_id][1] == r.doc_id]
    left = [r for r in left if not any(item in (r.text or "") for item in tables["benchmark"].text)]
    tok = bpe.tokenizer(queries.tokenizer_path())
    expected = {(r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()) for r in left for ids in [tok.encode(r.text or "", add_special_tokens=False).ids]}
    assert {tuple(r)[:3] for r in corpus_pipeline.run(spark, DATA).collect()} == expected


def test_stages_on_odd_documents(spark, odd):
    odd = odd.select("doc_id", "text", "lang", "source", "n_chars")
    for docs in (odd, odd.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, DATA)
        docs.collect()

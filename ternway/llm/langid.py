"""Language identification by bit-sliced Bloom filters of frequent byte n-grams.

One table of rows of bits holds the filters of all languages, as many 64-bit columns as they
need: bit l of a row belongs to the filter of language l. An n-gram reads as many rows as there
are hash functions, and the bits that all of them have set are the languages that know it. A text's n-grams are counted
by language; from each count goes what the filter's false positives alone would give, and the
rest is held against the share of n-grams known in the language's own texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ternway.llm.common import CHUNK_BYTES, chunks, mixed, release, sampled, texts

UNKNOWN = "und"
#: Texts of each language, at most about so many, from which its n-grams are learned.
TRAIN_TEXTS = 3000
#: Share of a language's n-grams that one of them must have to enter its filter; so there are at most 1 / SHARE.
SHARE = 2e-5
GRAM, HASHES, BITS_PER_GRAM = 4, 3, 12

_fold = np.full(256, 32, np.uint8)
_fold[97:123] = np.arange(97, 123)
_fold[65:91] = np.arange(97, 123)
_fold[128:] = np.arange(128, 256)


def grams(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text index, n-gram) in blocks: runs of four bytes within a text, of which at most one is no letter."""
    folded = _fold[data]
    for a in range(0, len(folded), CHUNK_BYTES):
        block = folded[a : a + CHUNK_BYTES + GRAM - 1]
        n = len(block) - GRAM + 1
        if n <= 0:
            break
        code, blanks = np.zeros(n, np.uint32), np.zeros(n, np.uint8)
        for k in range(GRAM):
            code |= block[k : k + n].astype(np.uint32) << np.uint32(8 * k)
            blanks += block[k : k + n] == 32
        first, last = np.searchsorted(offsets, [a, a + n - 1], "right") - 1
        cuts = np.clip(offsets[first : last + 2], a, a + n) - a
        text = np.repeat(np.arange(first, last + 1), np.diff(cuts))
        keep = (blanks < 2) & (np.arange(a, a + n) + GRAM <= offsets[text + 1])
        yield text[keep], code[keep]


@dataclass
class Model:
    """Languages, most frequent first, and the filters' table with the figures that correct its counts."""

    languages: list[str]
    table: np.ndarray
    false_rate: np.ndarray
    coverage: np.ndarray

    def rows(self, code: np.ndarray) -> np.ndarray:
        """The languages, as bits of one or more columns, whose filters know each n-gram."""
        h = mixed(code.astype(np.uint64) + np.uint64(1))
        mask, step = np.uint64(len(self.table) - 1), (h >> np.uint64(32)) | np.uint64(1)
        known = self.table[(h & mask).astype(np.int64)]
        for _ in range(HASHES - 1):
            h = h + step
            known = known & self.table[(h & mask).astype(np.int64)]
        return known

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each text the index of its language, a score, the share of its n-grams that the language knows, and their number."""
        n, m = len(offsets) - 1, len(self.languages)
        total, hits = np.zeros(n), np.zeros((m, n))
        for text, code in grams(data, offsets):
            total += np.bincount(text, minlength=n)
            known = self.rows(code)
            for k in range(m):
                hits[k] += np.bincount(text[(known[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1) == 1], minlength=n)
        share = hits / np.maximum(total, 1)
        share = np.clip((share - self.false_rate[:, None]) / (1 - self.false_rate[:, None]), 0, None)
        share /= np.maximum(self.coverage[:, None], 1e-9)
        best = share.argmax(0)
        top = share[best, np.arange(n)]
        rest = np.sort(share, axis=0)[-2] if m > 1 else np.zeros(n)
        score = np.clip(top, 0, 1) * np.where(top > 0, 1 - rest / np.maximum(top, 1e-12), 0)
        return best, np.clip(score, 0, 1), np.clip(top, 0, 1), total


def fit(labelled: DataFrame, train_texts: int = TRAIN_TEXTS, share: float = SHARE) -> Model:
    """Learn from (doc_id, text, lang) with non-null lang.

    From about `train_texts` texts of each language, picked by a hash of doc_id; where there are
    fewer, from all. n-grams are counted in a job of its own, and only those over `share`,
    1 / share for each language at most, reach the driver. Languages stand in the order of the
    number of their sampled n-grams. Without any, every text is `und`.
    """
    labelled = labelled.where("lang is not null and text is not null").select(F.col("doc_id"), F.col("text"), F.col("lang"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, index = np.unique(np.array(batch.column(1).to_pylist(), object), return_inverse=True)
            for text, code in grams(*texts(batch.column(0))):
                key, n = np.unique((index[text].astype(np.uint64) << np.uint64(32)) | code, return_counts=True)
                lang = pa.array(names[(key >> np.uint64(32)).astype(np.int64)].tolist(), pa.string())
                yield pa.RecordBatch.from_arrays([lang, pa.array((key & np.uint64(0xFFFFFFFF)).astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

    counts = sampled(labelled, "lang", train_texts).select("text", "lang").mapInArrow(count, "lang string, gram long, n long")
    counts = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = counts.persist()
    try:
        totals = {r.lang: r.n for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
        languages = sorted(totals, key=lambda x: (-totals[x], x))
        least = labelled.sparkSession.createDataFrame([(k, share * totals[k]) for k in languages], "lang string, least double")  # a row for each language
        frequent = counts.join(F.broadcast(least), "lang").where("n >= least").toPandas() if languages else None
    finally:
        counts.unpersist()
    if not languages:
        return Model([], np.zeros((1, 1), np.uint64), np.zeros(0), np.zeros(0))
    most = max(1, int(frequent.lang.value_counts().max())) if len(frequent) else 1
    size = 1 << int(np.ceil(np.log2(BITS_PER_GRAM * most)))
    model = Model(languages, np.zeros((size, -(-len(languages) // 64)), np.uint64), np.zeros(len(languages)), np.zeros(len(languages)))
    for k, name in enumerate(languages):
        own = frequent[frequent.lang == name]
        h = mixed(own.gram.to_numpy().astype(np.uint64) + np.uint64(1))
        step = (h >> np.uint64(32)) | np.uint64(1)
        filled = np.zeros(size, bool)
        for _ in range(HASHES):
            filled[(h & np.uint64(size - 1)).astype(np.int64)] = True
            h = h + step
        model.table[filled, k // 64] |= np.uint64(1 << k % 64)
        model.false_rate[k] = filled.mean() ** HASHES
        model.coverage[k] = own.n.sum() / totals[name]
    return model


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, share) of every text.

    lang_pred is `und`, with score 0, for a null text or one without a letter. A text too short
    for an n-gram gets the most frequent language with score 0. Of equal languages the more
    frequent wins. score is high if the n-grams are known in that language and in no other;
    share is the part of the text's n-grams known, as a part of what is usual. Rows are kept as
    they are; columns other than doc_id and text don't matter.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = np.array([*m.languages, UNKNOWN], object)
        for batch in batches:
            for part in chunks(batch):
                letters = np.asarray(part.column(2).fill_null(False).to_numpy(zero_copy_only=False), bool)
                if m.languages:
                    best, score, share, _ = m.predict(*texts(part.column(1)))
                    best = np.where(letters, best, len(m.languages))
                else:
                    best, score, share = (np.zeros(part.num_rows, k) for k in (np.int64, float, float))
                score, share = np.where(letters, score, 0.0), np.where(letters, share, 0.0)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names[best].tolist(), pa.string()), pa.array(score), pa.array(share)], ["doc_id", "lang_pred", "score", "share"])
        release()

    text = F.col("text").cast("string")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), text.rlike(r"\p{L}").alias("letters"))
    return own.mapInArrow(run, "doc_id long, lang_pred string, score double, share double")


def keep(docs: DataFrame, model: Model, least_share: float) -> DataFrame:
    """The rows, with all their columns, whose text has a letter and at least `least_share` of the n-grams usual in some language.

    A text with a letter but no n-gram stays, as nothing speaks against it; without a learned language all texts with a letter do.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                if shared.value.languages:
                    _, _, share, total = shared.value.predict(*texts(part.column(at)))
                    part = part.filter(pa.array((share >= least_share) | (total == 0)))
                yield part
        release()

    return docs.where(F.col("text").rlike(r"\p{L}")).mapInArrow(run, docs.schema)

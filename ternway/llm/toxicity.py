"""Toxicity: a convolutional text classifier over hashed word embeddings.

A word's vector is the sum of the embeddings of its hash and of the hashes of its first four
and five bytes, so unseen forms of a known stem have a vector too. Filters of several widths
run over the vectors; the maximum of each filter over the text, rectified, goes into a
logistic layer. It is trained in numpy on a bounded sample of labelled texts; the maximum lets
gradients through at one place per filter and text only. A fifth of all labelled texts is
kept from training; Spark counts how these score, by label and by the language that the text
itself suggests, and the thresholds of the languages come from those counts. Scores are shifted
so that all thresholds stand at the same value.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ternway.llm import langid
from ternway.llm.common import alphanumeric_words, bit_map, chunks, filter_bits, hashes, in_bit_map, release, sampled, texts

#: Labelled texts of each class, at most about so many, from which the classifier is fitted, and the most words of such a text.
TRAIN_TEXTS, TRAIN_WORDS = 2000, 4000
BUCKETS, WIDTH, FILTERS, SIZES, EPOCHS = 1 << 17, 8, 8, (1, 2, 3), 12
#: Words that the network takes at a time.
BLOCK_WORDS = 200_000
#: Score at which a text counts as toxic, in every language.
THRESHOLD = 0.7
#: Texts of each class, of those kept from training, that a language needs for a threshold of its own; others take that of all languages.
LEAST_TEXTS = 12
#: Logits are counted in steps of this size, from -LIMIT to LIMIT.
STEP, LIMIT = 0.02, 30.0


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets (words x 3) of each word, and the first word of each text (n + 1 values)."""
    blocks, first = alphanumeric_words().coded(data, offsets)
    out = [np.zeros((0, 3), np.int32)]
    for words, which in blocks:
        parts = (words, [b"4" + w[:4] for w in words], [b"5" + w[:5] for w in words])
        out.append(np.stack([(hashes(p) & np.uint64(BUCKETS - 1)).astype(np.int32) for p in parts], 1)[which])
    return np.concatenate(out), first


@dataclass
class Net:
    """Embeddings, for each filter width an array (width, WIDTH, FILTERS), the logistic layer, thresholds."""

    embedding: np.ndarray
    filters: list[np.ndarray]
    weight: np.ndarray
    bias: float
    languages: langid.Model | None = None
    shift: dict[int, float] = field(default_factory=dict)

    def pooled(self, buckets: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest answer of each filter in each text (0 without a place for it), and in training where it was."""
        n = len(first) - 1
        best = np.zeros((n, len(SIZES) * FILTERS), np.float32)
        place = np.full(best.shape if self.training else (0, 0), -1, np.int64)
        a = 0
        while a < n:  # some texts at a time, so that memory doesn't grow with their number
            b = max(a + 1, int(np.searchsorted(first, first[a] + BLOCK_WORDS, "right")) - 1)
            self._pool(buckets[first[a] : first[b]], first[a : b + 1] - first[a], best[a:b], place[a:b] if self.training else None, int(first[a]))
            a = b
        return best, place

    def _pool(self, buckets: np.ndarray, first: np.ndarray, best: np.ndarray, place: np.ndarray | None, base: int) -> None:
        if not len(buckets):
            return
        x = self.embedding[buckets[:, 0]]
        x += self.embedding[buckets[:, 1]]
        x += self.embedding[buckets[:, 2]]
        for w, (size, filters) in enumerate(zip(SIZES, self.filters, strict=True)):
            full = np.flatnonzero(np.diff(first) >= size)
            if not len(full):
                continue
            n = len(x) - size + 1
            answer = np.full((n + 1, FILTERS), -np.inf, np.float32)  # the row after the last place is the end edge of the last text
            np.matmul(x[:n], filters[0], out=answer[:n])
            for k in range(1, size):
                answer[:n] += x[k : n + k] @ filters[k]
            edges = np.stack([first[full], first[full + 1] - size + 1], 1).ravel()
            top = np.maximum.reduceat(answer, edges, axis=0)[::2]
            own = slice(w * FILTERS, (w + 1) * FILTERS)
            best[full, own] = top
            if place is not None:
                for t, row in zip(full, top, strict=True):
                    lo, hi = first[t], first[t + 1] - size + 1
                    place[t, own] = base + lo + (answer[lo:hi] == row).argmax(0)

    training = False

    def logits(self, buckets: np.ndarray, first: np.ndarray) -> np.ndarray:
        best, _ = self.pooled(buckets, first)
        return np.maximum(best, 0) @ self.weight + self.bias

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        z = self.logits(*features(data, offsets)).astype(np.float64)
        if self.languages and self.languages.languages:
            best, _, _, _ = self.languages.predict(data, offsets)
            z = z - np.array([self.shift.get(int(k), self.shift[-1]) for k in best])
        else:
            z = z - self.shift.get(-1, 0.0)
        return 1 / (1 + np.exp(-np.clip(z + np.log(THRESHOLD / (1 - THRESHOLD)), -30, 30)))


class Adam:
    def __init__(self, shape: tuple[int, ...], rate: float) -> None:
        self.m, self.v, self.t, self.rate = np.zeros(shape, np.float32), np.zeros(shape, np.float32), 0, rate

    def step(self, value: np.ndarray, gradient: np.ndarray) -> None:
        self.t += 1
        self.m += 0.1 * (gradient - self.m)
        self.v += 0.01 * (gradient * gradient - self.v)
        value -= self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.99**self.t)) + 1e-7)


def evidence(buckets: np.ndarray, first: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """For each bucket a cautious log ratio of how often toxic and other texts have it; 0 unless it is above 0."""
    text = np.repeat(np.arange(len(first) - 1, dtype=np.int64), np.diff(first)) * BUCKETS
    a, b = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for column in buckets.T:
        seen = np.unique(text + column)
        label = toxic[seen // BUCKETS]
        seen %= BUCKETS
        a += np.bincount(seen[label], minlength=BUCKETS)
        b += np.bincount(seen[~label], minlength=BUCKETS)
    ratio = np.log((a + 0.5) / (toxic.sum() + 1)) - np.log((b + 0.5) / ((~toxic).sum() + 1))
    return np.maximum(ratio - 1.5 * np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5)), 0)


def train(buckets: np.ndarray, first: np.ndarray, toxic: np.ndarray, seed: int = 7) -> Net:
    """Fit the network; embeddings start from the evidence for each bucket in one dimension, else small and random."""
    rng = np.random.default_rng(seed)
    net = Net((rng.standard_normal((BUCKETS, WIDTH)) * 0.02).astype(np.float32), [(rng.standard_normal((s, WIDTH, FILTERS)) * 0.1).astype(np.float32) for s in SIZES], np.full(len(SIZES) * FILTERS, 0.05, np.float32), 0.0)
    net.embedding[:, 0] += evidence(buckets, first, toxic).astype(np.float32)
    for filters in net.filters:
        filters[:, 0, 0] = 1 / len(filters)
    net.weight[::FILTERS] = 0.5
    rate = toxic.mean() if len(toxic) else 0.5
    net.bias = float(np.log((rate + 1e-3) / (1 - rate + 1e-3))) - 1
    if not toxic.any() or toxic.all():
        return net
    net.training = True
    balance = np.where(toxic, 0.5 / toxic.sum(), 0.5 / (~toxic).sum()).astype(np.float32)
    adam = [Adam(net.embedding.shape, 0.01), *[Adam(f.shape, 0.01) for f in net.filters], Adam(net.weight.shape, 0.03), Adam((1,), 0.03)]
    for _ in range(EPOCHS):
        best, place = net.pooled(buckets, first)
        hidden = np.maximum(best, 0)
        z = hidden @ net.weight + net.bias
        slope = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - toxic) * balance
        to_hidden = slope[:, None] * net.weight * (best > 0)
        to_embedding = np.zeros_like(net.embedding)
        for w, (size, filters) in enumerate(zip(SIZES, net.filters, strict=True)):
            step = np.zeros_like(filters)
            for f in range(FILTERS):
                at, g = place[:, w * FILTERS + f], to_hidden[:, w * FILTERS + f]
                on = np.flatnonzero((at >= 0) & (g != 0))
                for k in range(size):
                    own = buckets[at[on] + k]
                    step[k, :, f] = (net.embedding[own].sum(1) * g[on, None]).sum(0)
                    for c in range(3):
                        np.add.at(to_embedding, own[:, c], g[on, None] * filters[k, :, f])
            adam[1 + w].step(filters, step)
        bias = np.array([net.bias], np.float32)
        adam[-1].step(bias, np.array([slope.sum()], np.float32))
        adam[-2].step(net.weight, hidden.T @ slope)
        adam[0].step(net.embedding, to_embedding)
        net.bias = float(bias[0])
    net.training = False
    return net


def threshold(clean: np.ndarray, toxic: np.ndarray) -> float:
    """The cut with the best mean accuracy of both classes, given how many texts of each score in each step; of equal ones the middle."""
    below = np.concatenate([[0], np.cumsum(clean)]) / max(1, clean.sum())
    above = 1 - np.concatenate([[0], np.cumsum(toxic)]) / max(1, toxic.sum())
    best = np.flatnonzero(below + above >= (below + above).max() - 1e-12)
    return float((best[0] + best[-1]) / 2 * STEP - LIMIT)


def steps(z: np.ndarray) -> np.ndarray:
    return np.clip((np.asarray(z, np.float64) + LIMIT) / STEP, 0, 2 * LIMIT / STEP - 1).astype(np.int64)


def counted(docs: DataFrame, labels: DataFrame, net: Net) -> dict[tuple[int, int], np.ndarray]:
    """For each language and label how many of the labelled documents score in each step. Documents that a bit map of the ids rules out aren't scored."""
    spark = docs.sparkSession
    ids = labels.select(F.xxhash64(F.col("doc_id").cast("long")).alias("h"))
    shared = spark.sparkContext.broadcast((net, bit_map(ids, filter_bits(ids.count()))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, have = shared.value
        for batch in batches:
            for part in chunks(batch.filter(pa.array(in_bit_map(have, np.asarray(batch.column(2)))))):
                data, offsets = texts(part.column(1))
                z = net.logits(*features(data, offsets))
                lang = net.languages.predict(data, offsets)[0] if net.languages and net.languages.languages else np.full(len(z), -1)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang.astype(np.int32)), pa.array(steps(z).astype(np.int32))], ["doc_id", "language", "step"])
        release()

    docs = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64(F.col("doc_id").cast("long")).alias("h"))
    found = docs.mapInArrow(run, "doc_id long, language int, step int").join(labels.withColumnRenamed("doc_id", "own_id"), F.col("doc_id") == F.col("own_id"))
    out: dict[tuple[int, int], np.ndarray] = {}
    for r in found.groupBy("language", "toxic", "step").count().toLocalIterator():  # as many rows as languages and steps, at most
        out.setdefault((r.language, r.toxic), np.zeros(round(2 * LIMIT / STEP), np.int64))[r.step] = r["count"]
    return out


def fit(docs: DataFrame, labels: DataFrame, languages: langid.Model | None, train_texts: int = TRAIN_TEXTS) -> Net:
    """Learn from docs (doc_id, text) and labels (doc_id, toxic), of which the caller has left out what is held out.

    The net is fitted on about `train_texts` labelled texts of each class, picked by a hash of
    doc_id among those of at most TRAIN_WORDS words: the documented bound of what reaches the
    driver; where there are fewer, on all. A fifth of the labelled texts, by another hash, is
    never trained on; all of them give the thresholds, if there are three of each class, else
    the trained ones do. Null labels and null texts are left out, of a document's several
    labels the largest counts. Without two classes all scores are the same and below the
    threshold.
    """
    labels = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.least(F.max("toxic"), F.lit(1)).cast("int").alias("toxic"))
    aside = F.pmod(F.xxhash64(F.lit(5), F.col("doc_id")), F.lit(5)) == 0
    some = sampled(labels.where(~aside), "toxic", train_texts).select(F.col("doc_id").alias("own_id"), "toxic")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                buckets, first = features(*texts(part.column(1)))
                rows = [buckets[a:b].tobytes() if b - a <= TRAIN_WORDS else None for a, b in zip(first[:-1], first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(rows, pa.binary())], ["doc_id", "toxic", "buckets"])
        release()

    rows = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(some), F.col("doc_id") == F.col("own_id"))
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "toxic").mapInArrow(run, "doc_id long, toxic int, buckets binary").where("buckets is not null").toPandas()
    rows = rows.sort_values(["doc_id", "buckets"]).drop_duplicates("doc_id")
    toxic = rows.toxic.to_numpy() == 1
    parts = [np.frombuffer(x, np.int32).reshape(-1, 3) for x in rows.buckets]
    buckets, first = np.concatenate([np.zeros((0, 3), np.int32), *parts]), np.cumsum([0, *map(len, parts)])
    del rows, parts
    net = train(buckets, first, toxic)
    net.languages = languages
    if not toxic.any() or toxic.all():
        net.shift = {-1: float(max(net.bias, 0)) + 3}
        return net
    counts = counted(docs, labels.where(aside), net)
    every = [sum((n for (_, t), n in counts.items() if t == k), np.zeros(round(2 * LIMIT / STEP), np.int64)) for k in (0, 1)]
    if min(x.sum() for x in every) < 3:
        z = steps(net.logits(buckets, first))
        counts, every = {}, [np.bincount(z[toxic == k], minlength=round(2 * LIMIT / STEP)) for k in (False, True)]
    net.shift = {-1: threshold(*every)}
    for k in {k for k, _ in counts if k >= 0}:
        own = [counts.get((k, t), np.zeros(1)) for t in (0, 1)]
        if min(x.sum() for x in own) >= LEAST_TEXTS:
            net.shift[k] = threshold(*own)
    release()
    return net


def score(docs: DataFrame, net: Net) -> DataFrame:
    """(doc_id, score, predicted) of every text; a null text counts as empty. Rows are kept as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                found = shared.value.score(*texts(part.column(1)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found), pa.array((found >= THRESHOLD).astype(np.int32))], ["doc_id", "score", "predicted"])
        release()

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, score double, predicted int")


def keep(docs: DataFrame, net: Net) -> DataFrame:
    """The rows, with all their columns, that are not predicted toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(net)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                yield part.filter(pa.array(shared.value.score(*texts(part.column(at))) < THRESHOLD))
        release()

    return docs.mapInArrow(run, docs.schema)

"""Whitened embeddings from exact integer covariances.

Entries become integers on a grid. A first pass adds them up; a second multiplies the centred
integers n * x - S: they are cut into limbs of LIMB bits, so small that the float64 products of
BLAS and their sums over a block are exact whole numbers. The limbs' products are put together
as big integers, added up over tasks by a tree, and only the finished matrix, whose size is that
of a vector squared, becomes floating point numbers for the eigenvectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: x = floor(GRID * c) + SHIFT.
GRID, SHIFT = 64, 1_000_000
#: Components that are kept, and the part of the largest eigenvalue below which one counts as none.
COMPONENTS, LEAST_PART = 32, 1e-12
#: Bits of a limb, rows of a block: a sum of BLOCK_ROWS products of two signed limbs has at most 2 * (LIMB - 1) + 13 = 51 bits.
LIMB, BLOCK_ROWS = 20, 1 << 13
#: Blocks whose products may be added up in 64 bits.
BLOCKS = 1 << 10
#: Entries beyond this count as this, so that x is a long.
LARGEST = float(1 << 62)


def whole(vectors: DataFrame, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(key, x) of vectors that are not null and hold neither nulls nor non-finite entries, on the grid."""
    fine = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    scaled = lambda c: F.least(F.greatest(c.cast("double") * GRID, F.lit(-LARGEST)), F.lit(LARGEST))
    return vectors.where(F.col(vector).isNotNull() & F.coalesce(fine, F.lit(False))).select(F.col(key).alias("key"), F.transform(vector, lambda c: F.floor(scaled(c)) + SHIFT).alias("x"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column of longs as rows of a matrix; shorter rows are filled up with what the entry 0 is on the grid."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.asarray(column.offsets)
    sizes = np.diff(offsets)
    flat = np.asarray(column.flatten())
    out = np.full((len(sizes), width), SHIFT, np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def blocks(batch: pa.RecordBatch, column: str, width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for at in range(0, batch.num_rows, BLOCK_ROWS):
        part = batch.slice(at, BLOCK_ROWS)
        yield part, matrix(part.column(part.schema.get_field_index(column)), width)


def sums(rows: DataFrame) -> tuple[int, list[int]]:
    """The number of vectors and the exact sum of every place of x. One row for each place comes to the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list[int]] = {-1: [0, 0]}
        for batch in batches:
            column = batch.column(0)
            width = int(np.diff(np.asarray(column.offsets)).max(initial=0))
            # a place that a vector doesn't have is counted too, as 0 here; the driver adds the grid's 0 for it
            sizes = np.diff(np.asarray(column.offsets))
            total[-1][0] += len(sizes)
            x = matrix(column, width)
            for p in range(width):
                have = x[sizes > p, p]
                here = total.setdefault(p, [0, 0])
                here[0] += len(have)
                here[1] += (int((have >> 31).sum()) << 31) + int((have & 0x7FFFFFFF).sum())
        yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array([v[0] for v in total.values()]), pa.array([str(v[1]) for v in total.values()])], ["place", "n", "s"])

    parts = rows.select("x").mapInArrow(add, "place long, n long, s string")
    found = {r.place: r for r in parts.groupBy("place").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()}
    n = found[-1].n if -1 in found else 0
    width = max(found, default=-1) + 1
    return n, [int(found[p].s) + (n - found[p].n) * SHIFT for p in range(width)]


def centred(x: np.ndarray, n: int, s: list[int]) -> np.ndarray:
    """n * x - S, as longs if they can't overflow, else as Python's integers."""
    base = [t // n for t in s]  # what is left of S is less than n
    reach = max(abs(int(x.min(initial=0))), abs(int(x.max(initial=0)))) + max(map(abs, base))
    rest = np.array([t - n * b for t, b in zip(s, base, strict=True)], np.int64)
    if (reach + 1) * n < 1 << 62 and reach < 1 << 62:
        return (x - np.array(base, np.int64)) * n - rest
    return (x.astype(object) - np.array(base, object)) * n - rest.astype(object)


def limbs(y: np.ndarray) -> list[np.ndarray]:
    """Signed limbs of integers, lowest first, each in [-2**(LIMB-1), 2**(LIMB-1)], as float64."""
    half, out = 1 << (LIMB - 1), []
    while True:
        low = ((y + half) & ((1 << LIMB) - 1)) - half
        out.append(low.astype(np.float64))
        y = (y - low) >> LIMB
        if not np.any(y):
            return out


def products(y: np.ndarray) -> np.ndarray:
    """Exact y' y of a block, by limbs: result[a, b] is the product of limbs a and b."""
    parts = limbs(y)
    k, d = len(parts), y.shape[1]
    wide = np.concatenate(parts, axis=1)
    return (wide.T @ wide).astype(np.int64).reshape(k, d, k, d).transpose(0, 2, 1, 3)


def recombined(acc: np.ndarray) -> np.ndarray:
    """Limb products as one matrix of Python's integers."""
    out = np.zeros(acc.shape[2:], object)
    for a in range(acc.shape[0]):
        for b in range(acc.shape[1]):
            out = out + acc[a, b].astype(object) * (1 << (LIMB * (a + b)))
    return out


def gram(rows: DataFrame, n: int, s: list[int]) -> np.ndarray:
    """The exact sum of y y' over all vectors, y = n * x - S, as Python's integers."""
    width = len(s)

    def sent(total: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array([[format(v, "x") for v in row] for row in total], pa.list_(pa.string()))], ["place", "cells"])

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, acc, blocks_in = np.zeros((width, width), object), None, 0
        for batch in batches:
            for _, x in blocks(batch, "x", width):
                p = products(centred(x, n, s))
                if acc is not None and (acc.shape != p.shape or blocks_in == BLOCKS):
                    total, acc, blocks_in = total + recombined(acc), None, 0
                acc, blocks_in = p if acc is None else acc + p, blocks_in + 1
        yield sent(total if acc is None else total + recombined(acc))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width), object)
        for batch in batches:
            for place, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[place] += np.array([int(c, 16) for c in cells], object)
        yield sent(total)

    kind = "place int, cells array<string>"
    parts = tree(rows.select("x").mapInArrow(multiply, kind), merge, kind, rows.rdd.getNumPartitions())
    total = np.zeros((width, width), object)
    for r in parts.collect():
        total[r.place] += np.array([int(c, 16) for c in r.cells], object)
    return total


def tree(parts: DataFrame, merge, kind: str, tasks: int) -> DataFrame:
    """Partial results joined by fewer and fewer tasks, sixteen to one, until at most sixteen are left."""
    while tasks > 16:
        tasks = -(-tasks // 16)
        parts = parts.repartition(tasks).mapInArrow(merge, kind)
    return parts


@dataclass
class Whitening:
    """n vectors whose x add up to s; directions (width x k) divided by the root of their variance; values, their variances; trace, the sum of all variances."""

    n: int
    s: list[int]
    directions: np.ndarray
    values: np.ndarray
    trace: float

    def project(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whitened vectors, and their exact sums of (n * x - S)**2."""
        y = centred(x, self.n, self.s)
        largest = max(abs(int(y.min(initial=0))), abs(int(y.max(initial=0))))
        far = ((y if largest**2 * y.shape[1] < 1 << 62 else y.astype(object)) ** 2).sum(axis=1)
        return (y / self.n).astype(np.float64) @ self.directions, far


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening:
    """Learn from all rows of `whole`. Components without variance are left out, so there may be fewer."""
    n, s = sums(rows)
    if not n or not s:
        return Whitening(n, s, np.zeros((len(s), 0)), np.zeros(0), 0.0)
    total = gram(rows, n, s)
    cube = n**3
    v = np.array([[int(c) / cube for c in row] for row in total], np.float64)  # each a correctly rounded quotient of integers
    values, vectors = np.linalg.eigh((v + v.T) / 2)
    values, vectors = values[::-1], vectors[:, ::-1]
    kept = values[:components] > LEAST_PART * max(values[0], 0.0)
    values, vectors = values[:components][kept], vectors[:, :components][:, kept]
    trace = sum(int(total[k, k]) for k in range(len(s))) / cube
    return Whitening(n, s, vectors / np.sqrt(values), values, trace)


def identity_error(rows: DataFrame, w: Whitening) -> float:
    """The largest entry of the whitened vectors' covariance minus the identity, from the vectors themselves.

    Blocks are centred by their own means before they are multiplied; means and products are
    merged pairwise, by tasks and then a tree.
    """
    width, k = len(w.s), len(w.values)
    if not k:
        return 0.0
    kind = "n long, mean array<double>, spread array<double>"

    def joined(one, other):
        if not one[0] or not other[0]:
            return other if other[0] else one
        n = one[0] + other[0]
        apart = other[1] - one[1]
        return n, one[1] + apart * (other[0] / n), one[2] + other[2] + np.outer(apart, apart) * (one[0] * other[0] / n)

    def sent(state) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([state[0]]), pa.array([state[1].tolist()], pa.list_(pa.float64())), pa.array([state[2].ravel().tolist()], pa.list_(pa.float64()))], ["n", "mean", "spread"])

    start = (0, np.zeros(k), np.zeros((k, k)))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = start
        for batch in batches:
            for part, x in blocks(batch, "x", width):
                z, _ = w.project(x)
                mean = z.mean(axis=0)
                state = joined(state, (part.num_rows, mean, (z - mean).T @ (z - mean)))
        yield sent(state)

    def read(n, mean, spread):
        return n, np.array(mean), np.array(spread).reshape(k, k)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = start
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                state = joined(state, read(*row))
        yield sent(state)

    state = start
    for r in tree(rows.select("x").mapInArrow(measure, kind), merge, kind, rows.rdd.getNumPartitions()).collect():
        state = joined(state, read(*r))
    return float(np.abs(state[2] / state[0] - np.eye(k)).max())


def whitened(vectors: DataFrame, vector: str = "embedding", key: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error): a row for each vector and component.

    Vectors that are null or hold nulls or non-finite entries are left out; vectors shorter than
    the longest one are filled up with zeros. Entries beyond 2**62 / GRID count as that. Repeated
    rows count as often as they stand there, each with rows of its own; keys may be null. A
    component whose variance is 0 but for rounding has no row, so equal vectors, a single one
    and empty tables give none. deviation is a decimal, null beyond its 38 digits.
    """
    rows = whole(vectors, vector, key)
    w = fit(rows, components)
    width, error = len(w.s), identity_error(rows, w)
    kind = rows.schema["key"].dataType.simpleString()

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, x in blocks(batch, "x", width):
                z, far = w.project(x)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1, dtype=np.int32) * z.shape[1]), pa.array(np.ascontiguousarray(z).ravel()))
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("key")), pa.array([str(v) for v in far], pa.string()), flat], ["key", "far", "z"])

    found = rows.mapInArrow(project, f"key {kind}, far string, z array<double>")
    if not len(w.values):
        found = found.limit(0)
    explained = F.array(*[F.lit(float(e / w.trace)) for e in w.values]) if len(w.values) else F.array().cast("array<double>")
    each = found.select("key", F.col("far").try_cast("decimal(38,0)").alias("deviation"), F.posexplode("z").alias("place", "whitened"))
    return each.select(
        F.col("key").alias(key),
        (F.col("place") + 1).cast("int").alias("component"),
        F.lit(w.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.element_at(explained, F.col("place") + 1).alias("explained"),
        F.lit(error).alias("identity_error"),
    )

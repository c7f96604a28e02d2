"""Near-duplicate vectors by counting collisions of one-dimensional projections.

Two vectors within a small angle fall within a small distance of each other on any line. Each
vector is projected on many lines; a pair collides on a line if one's projection lies in a
window around the other's. Pairs with enough collisions, a number calibrated so that the wanted
share of pairs at the threshold passes, are compared exactly.

1.  Equal vectors of a label become one, with a number of copies.
2.  Within a label, vectors are sorted on the first line and cut into strips, each strip is
    sorted on the next line and cut, and so on, until tiles are small. Tiles that can hold
    vectors within a slightly wider window of each other on all of these lines meet in a task.
3.  A task sorts one side on its lines and searches the window around each vector of the other.
    A pair that may miss m lines must collide on one of the first m + 1, so only the windows of
    these are read out; each pair found is counted on the other lines until it has missed too
    many. What passes is verified, and the task returns link counts and the few links that
    connect something new.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ternway.llm.common import joined, small, written
from ternway.llm.graph import Forest, components

#: Lines, half width of a window in standard deviations of the projections of a pair at the
#: threshold, share of pairs at the threshold that the count must let through.
LINES, WINDOW_SIGMAS, RECALL = 32, 3.0, 0.999
#: Vectors of a tile, at most about so many, the lines that cut tiles, the strips of a cut, and the half width within which tiles meet.
TILE, CUT_LINES, STRIPS, TILE_SIGMAS = 3000, 4, 4, 3.3
#: Pairs that a task looks at, at a time.
PAIRS = 1 << 19


def lines(dim: int, n: int, seed: int = 11) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((n, dim))


def window(threshold: float, sigmas: float = WINDOW_SIGMAS) -> float:
    """Half width on a line of standard normal direction: unit vectors at the threshold are sqrt(2 - 2 t) apart."""
    return sigmas * math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-9


def least_collisions(n: int, sigmas: float, recall: float) -> int:
    """The largest count that at least `recall` of the pairs at the threshold reach: collisions are binomial."""
    p = math.erf(sigmas / math.sqrt(2))
    tail = 0.0
    for k in range(n, -1, -1):
        tail += math.comb(n, k) * p**k * (1 - p) ** (n - k)
        if tail >= recall:
            return k
    return 0


def collisions(px: np.ndarray, py: np.ndarray, width: float, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of rows of px and py (vectors x lines) that collide on `least` lines or more, each once, in blocks."""
    n_lines = px.shape[1]
    most = n_lines - least  # lines that a pair may miss
    for k in range(min(most + 1, n_lines)):
        order = np.argsort(py[:, k], kind="stable")
        line = py[order, k]
        first, last = np.searchsorted(line, px[:, k] - width, "left"), np.searchsorted(line, px[:, k] + width, "right")
        ends = np.cumsum(last - first)
        a = 0
        while a < len(px):
            base = int(ends[a - 1]) if a else 0
            b = max(a + 1, int(np.searchsorted(ends, base + PAIRS, "right")))
            size = last[a:b] - first[a:b]
            i = np.repeat(np.arange(a, b), size)
            j = order[np.arange(len(i)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first[a:b], size)]
            for before in range(k):  # what collided on an earlier line has been found there
                new = np.abs(px[i, before] - py[j, before]) > width
                i, j = i[new], j[new]
            missed = np.full(len(i), k, np.int8)
            for line_after in range(k + 1, n_lines):
                missed += np.abs(px[i, line_after] - py[j, line_after]) > width
                on = missed <= most
                i, j, missed = i[on], j[on], missed[on]
            yield i, j
            a = b


def pair_links(x: np.ndarray, px: np.ndarray, y: np.ndarray, py: np.ndarray, threshold: float, width: float, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows of x and y with enough collisions and a cosine of `threshold` or more in double precision."""
    out_a, out_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i, j in collisions(px, py, width, least):
        for b in range(0, len(i), 1 << 14):
            s = slice(b, b + (1 << 14))
            u, v = x[i[s]], y[j[s]]
            cosine = (u * v).sum(1) / np.sqrt((u * u).sum(1) * (v * v).sum(1))
            hit = cosine >= threshold
            out_a.append(i[s][hit])
            out_b.append(j[s][hit])
    return np.concatenate(out_a), np.concatenate(out_b)


def near_vectors(vectors: DataFrame, threshold: float = 0.98, n_lines: int = LINES, tile: int = TILE, seed: int = 11) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of vectors (vec_id, embedding, label).

    Pairs of one non-null label whose cosine is at least the threshold, and no others, are
    linked; n_links counts other rows, component_id is the smallest vec_id that links reach.
    Vectors that are null, empty, zero or hold null or non-finite numbers link with nothing, as do
    vectors of different lengths with each other and rows with a null vec_id. Repeated rows
    count as rows of their own. Other columns don't matter.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("string").alias("label"))
    fine = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("embedding", lambda v: v != 0)
    usable = F.coalesce(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & fine, F.lit(False))
    rows = rows.withColumn("usable", usable)
    good = rows.where("usable").select("vec_id", "label", "embedding", F.size("embedding").alias("dim"))
    distinct = good.groupBy("label", "dim", "embedding").agg(F.min("vec_id").alias("leader"), F.count("*").alias("copies"))
    distinct = written(distinct, "vectors")

    dims = [r.dim for r in distinct.select("dim").distinct().collect()]
    width, least = window(threshold), least_collisions(n_lines, WINDOW_SIGMAS, RECALL)
    shared = spark.sparkContext.broadcast({d: lines(d, n_lines, seed) for d in dims})

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def projected(embedding: pd.Series) -> pd.Series:
        out = []
        for v in embedding:
            v = np.asarray(v, np.float64)
            top = np.abs(v).max()
            v = v / top  # so that very large or small numbers don't overflow
            out.append(shared.value[len(v)] @ (v / np.sqrt(v @ v)))
        return pd.Series(out)

    placed = written(distinct.withColumn("p", projected("embedding")), "projected")

    # Cut each label line by line at quantiles. The bounds are a few numbers for each strip.
    tiled = placed.select("leader", "label", "dim", "p").withColumn("tile", F.lit(0).cast("long"))
    for k in range(CUT_LINES):
        line = F.col("p")[k]
        bounds = tiled.groupBy("label", "dim", "tile").agg(
            F.count("*").alias("n"),
            F.percentile_approx(line, [i / STRIPS for i in range(1, STRIPS)], 1000).alias("bounds"),
        )
        bounds = bounds.select("label", "dim", "tile", F.when(F.col("n") > tile, F.col("bounds")).otherwise(F.array().cast("array<double>")).alias("bounds"))
        strip = F.size(F.filter("bounds", lambda b: b < line))
        tiled = tiled.join(small(bounds, "bounds"), ["label", "dim", "tile"]).withColumn("tile", F.col("tile") * STRIPS + strip).drop("bounds")
    # What is still larger is dealt by hash into tiles that share their box.
    sizes = tiled.groupBy("label", "dim", "tile").agg(F.ceil(F.count("*") / F.lit(tile)).cast("int").alias("parts"))
    tiled = tiled.join(small(sizes, "sizes"), ["label", "dim", "tile"]).withColumn("part", F.pmod(F.xxhash64("leader"), F.col("parts")).cast("int"))
    tiled = written(tiled.select("leader", "label", "dim", "tile", "part", "p"), "tiles")
    edges = [f(F.col("p")[k]).alias(f"{n}{k}") for k in range(CUT_LINES) for f, n in ((F.min, "lo"), (F.max, "hi"))]
    boxes = written(tiled.groupBy("label", "dim", "tile", "part").agg(*edges).withColumn("box", F.struct("tile", "part")), "boxes")
    left, right = boxes.alias("x"), boxes.alias("y")
    reach = window(threshold, TILE_SIGMAS)
    near = (F.col("x.label") == F.col("y.label")) & (F.col("x.dim") == F.col("y.dim")) & (F.col("x.box") <= F.col("y.box"))
    for k in range(CUT_LINES):
        near = near & (F.col(f"x.lo{k}") - reach <= F.col(f"y.hi{k}")) & (F.col(f"y.lo{k}") - reach <= F.col(f"x.hi{k}"))
    meets = left.join(right, near).select(*[F.col(f"x.{c}").alias(c) for c in ("label", "dim")], F.col("x.box").alias("a"), F.col("y.box").alias("b"))
    meets = written(meets.withColumn("task", F.xxhash64("label", "dim", "a", "b")), "meetings")
    seats = meets.select("label", "dim", "task", F.col("a").alias("box"), F.lit(0).alias("side")).unionByName(meets.where("a <> b").select("label", "dim", "task", F.col("b").alias("box"), F.lit(1).alias("side")))
    seats = seats.select("label", "dim", F.col("box.tile").alias("tile"), F.col("box.part").alias("part"), "task", "side")
    members = tiled.join(seats, ["label", "dim", "tile", "part"]).join(placed.select("leader", "label", "dim", "embedding", "copies"), ["leader", "label", "dim"]).select("task", "side", "leader", "embedding", "copies", "p")

    def link(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["side", "leader"])
        x = np.array(group.embedding.tolist(), np.float64)
        x = x / np.abs(x).max(1, keepdims=True)
        p, ids, copies, side = np.array(group.p.tolist()), group.leader.to_numpy(), group["copies"].to_numpy(), group.side.to_numpy()
        cut = int((side == 0).sum())
        if cut == len(ids):
            i, j = pair_links(x, p, x, p, threshold, width, least)
            keep = i < j
            i, j = i[keep], j[keep]
        else:
            i, j = pair_links(x[:cut], p[:cut], x[cut:], p[cut:], threshold, width, least)
            j = j + cut
        n = np.bincount(i, copies[j], len(ids)) + np.bincount(j, copies[i], len(ids))
        forest = Forest()
        new = [(a, b) for a, b in zip(ids[i].tolist(), ids[j].tolist(), strict=True) if forest.join(a, b)]
        on = n > 0
        links = pd.DataFrame({"a": ids[on], "b": pd.array([None] * int(on.sum()), "Int64"), "n": n[on].astype(np.int64)})
        spans = pd.DataFrame(new, columns=["a", "b"]).astype({"a": "int64", "b": "Int64"}).assign(n=0)
        return pd.concat([links, spans]) if len(spans) else links

    found = written(members.groupBy("task").applyInPandas(link, "a long, b long, n long"), "vector-links")
    counts = found.groupBy("a").agg(F.sum("n").alias("others")).withColumnRenamed("a", "leader")
    parts = components(found.where("b is not null").select("a", "b"), "vector-components").withColumnRenamed("id", "leader")
    known = placed.select("label", "dim", "embedding", "leader", "copies").join(counts, "leader", "left").join(parts, "leader", "left")
    out = joined(rows.withColumn("dim", F.size("embedding")), written(known, "known"), ["label", "dim", "embedding"], "copies", "vec_id")
    linked = F.col("usable") & F.col("leader").isNotNull()
    out = out.select(
        "vec_id",
        F.when(linked, F.coalesce("others", F.lit(0)) + F.col("copies") - 1).otherwise(F.lit(0)).cast("long").alias("n_links"),
        F.when(linked, F.coalesce("component", "leader")).otherwise(F.col("vec_id")).alias("component_id"),
    )
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))

"""Connected components of large graphs."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ternway.llm.common import joined, written


class Forest:
    """Disjoint sets of numbers; the smallest of a set stands for it."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up, top = self.up, x
        while (nxt := up.get(top, top)) != top:
            top = nxt
        while (nxt := up.get(x, x)) != top:
            up[x], x = top, nxt
        return top

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True

    def edges(self) -> Iterable[tuple[int, int]]:
        return [(x, self.root(x)) for x in list(self.up)]


#: Edges that a task contracts at a time.
FOREST_EDGES = 500_000


def contracted(edges: DataFrame) -> DataFrame:
    """Edges (a, b) with the same components, at most one for each vertex of a task's block of edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, n = Forest(), 0

        def out() -> pa.RecordBatch:
            pairs = np.array(forest.edges(), np.int64).reshape(-1, 2)
            pairs = pairs[pairs[:, 0] != pairs[:, 1]]
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                forest.join(a, b)
            n += batch.num_rows
            if n > FOREST_EDGES:
                yield out()
                forest, n = Forest(), 0
        yield out()

    return edges.select("a", "b").mapInArrow(run, "a long, b long")


def components(edges: DataFrame, name: str = "components", rounds: int = 60) -> DataFrame:
    """(id, component) for every vertex of the edges (a, b): component is the smallest id it is connected with.

    Alternates the large-star and small-star steps, each one aggregation and one join, until
    every vertex points at its component's smallest; the number of rounds grows with the
    logarithm of the graph. Each round is written to the shared folder. The edges of a vertex with
    many neighbours are dealt over several tasks. Edges with a null end
    and loops are left out; without edges the result is empty.
    """
    edges = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b"))
    edges = written(contracted(edges).distinct(), name)
    before = None
    for _ in range(rounds):
        # large star: all larger neighbours of a vertex move to its smallest neighbour
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"), F.count("*").alias("n")), name)
        large = joined(both.where("b > a"), least, ["a"], "n", "b").select(F.col("b").alias("a"), F.col("least").alias("b"))
        # small star: a vertex and its smaller neighbours move to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("least"))
        small = large.join(low, "a").where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(low.select("a", F.col("least").alias("b")))
        edges = written(small.where("a <> b").distinct(), name)
        state = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"{name}: components did not settle in {rounds} rounds")
    star = edges.groupBy("a").agg(F.min("b").alias("b"))
    return star.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(star.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())

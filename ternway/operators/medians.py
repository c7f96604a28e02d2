"""Price figures and exact medians of all journeys without pairing them.

Both legs are dealt into blocks of an airport and some days, in which a first leg's partners are
a range of the second legs by time. A wavelet matrix over the second legs' prices tells how many
of a range are within a price, and which one is the k-th, in as many steps as the block's number
has bits. So a pass over the blocks counts all journeys up to a price in about
legs * log(legs of a block) steps, and a few passes close in on the middle price of every group.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ternway.functions.times import DAY
from ternway.operators.partners import asked_by_kind, kind_and_time
from ternway.session import kept, ship

#: Legs of one side in a block, beyond which a block is cut; blocks only get that large where an airport has as many flights within a stay's length.
BLOCK = 1 << 19
#: Prices drawn of each group in a pass, and the number of journeys between two bounds from which on all their prices are looked at.
DRAWN, ALL = 1 << 15, 1 << 17
#: Passes after which prices that can't be told apart are an error.
PASSES = 80

BLOCKS = "cities array<string>, city binary, price binary, low binary, high binary, partner binary"
#: The key of all journeys beside those of cities; no city is null.
WHOLE = None


class Wavelet:
    """Numbers 0 to n - 1 in some order: how many of a range are below one, and the k-th of a range."""

    def __init__(self, ranks: np.ndarray) -> None:
        self.zeros = []
        for bit in reversed(range(max(1, int(len(ranks) - 1).bit_length()))):
            one = (ranks >> bit) & 1 == 1
            self.zeros.append((bit, np.concatenate([[0], np.cumsum(~one)])))
            ranks = np.concatenate([ranks[~one], ranks[one]])
        self.n = len(ranks)

    def below(self, low: np.ndarray, high: np.ndarray, k: np.ndarray) -> np.ndarray:
        whole, size, found = k >= self.n, high - low, np.zeros(len(low), np.int64)
        for bit, zeros in self.zeros:
            a, b, one = zeros[low], zeros[high], (k >> bit) & 1 == 1
            found += np.where(one, b - a, 0)
            low, high = np.where(one, zeros[-1] + low - a, a), np.where(one, zeros[-1] + high - b, b)
        return np.where(whole, size, found)

    def kth(self, low: np.ndarray, high: np.ndarray, k: np.ndarray) -> np.ndarray:
        found = np.zeros(len(low), np.int64)
        for bit, zeros in self.zeros:
            a, b = zeros[low], zeros[high]
            one = k >= b - a
            k = np.where(one, k - (b - a), k)
            found |= one.astype(np.int64) << bit
            low, high = np.where(one, zeros[-1] + low - a, a), np.where(one, zeros[-1] + high - b, b)
        return found


class Block:
    """First legs with their prices and ranges of partners, and the partners' prices by time."""

    def __init__(self, row: dict) -> None:
        read = lambda c, kind: np.frombuffer(row[c], kind)
        self.cities, self.city, self.price = row["cities"], read("city", np.int32), read("price", np.float64)
        self.low, self.high, self.partner = read("low", np.int32).astype(np.int64), read("high", np.int32).astype(np.int64), read("partner", np.float64)
        order = np.argsort(self.partner, kind="stable")
        ranks = np.empty(len(order), np.int64)
        ranks[order] = np.arange(len(order))
        self.sorted, self.wavelet = self.partner[order], Wavelet(ranks)
        self.values, starts = np.unique(self.sorted, return_index=True)
        self.starts = np.append(starts, len(order))

    def upto(self, own: np.ndarray, most: float) -> np.ndarray:
        """For some first legs the number of partners with whom they cost `most` at most."""
        price, size, n = self.price[own], self.high[own] - self.low[own], len(self.values)
        if most == math.inf or most == -math.inf:
            return size if most > 0 else np.zeros(len(own), np.int64)
        k = np.searchsorted(self.values, most - price, "right")
        while (more := (k < n) & (price + self.values[np.minimum(k, n - 1)] <= most)).any():  # the sum is what counts, as it is rounded
            k = k + more
        while (less := (k > 0) & (price + self.values[np.maximum(k, 1) - 1] > most)).any():
            k = k - less
        return self.wavelet.below(self.low[own], self.high[own], self.starts[k])

    def prices(self, own: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The prices of first legs with the k-th cheapest of their partners."""
        return self.price[own] + self.sorted[self.wavelet.kth(self.low[own], self.high[own], k)]

    def groups(self, cities: bool, whole: bool) -> Iterator[tuple[str | None, np.ndarray]]:
        if whole:
            yield WHOLE, np.arange(len(self.city))
        if cities:
            for k, name in enumerate(self.cities):
                yield name, np.flatnonzero(self.city == k)


def blocks(first: DataFrame, second: DataFrame, allowed: DataFrame | None, min_stay: int, max_stay: int) -> DataFrame | None:
    """BLOCKS, written; None if no stay is wanted. A first leg is in the band of days of its first partner, second legs in two, and a block of more than BLOCK legs of a side is a grid."""
    stops = second.where("origin is not null").select(F.col("origin").alias("airport"), *kind_and_time(), F.col("leg.price").alias("partner"), F.col("pos").alias("leg2_pos"))
    kinds = sorted(r.kind for r in stops.select("kind").distinct().collect()) if max_stay >= min_stay else []  # five at most
    if not kinds:
        return None
    span = (max_stay - min_stay + 1) * DAY
    rows = first.where("city is not null").select("city", "sec", "aware", "day", F.col("leg.price").alias("price"), F.col("pos").alias("leg1_pos"))
    rows = rows.withColumn("airport", F.col("city")) if allowed is None else rows.join(allowed, "city")
    rows = rows.select("airport", "city", "price", "leg1_pos", F.explode(asked_by_kind(kinds, min_stay, max_stay)).alias("ask"))
    rows = rows.select("airport", F.col("ask.kind").alias("kind"), F.floor(F.col("ask.at") / span).alias("band"), F.col("ask.at").alias("at"), "city", "price", "leg1_pos")
    band = F.floor(F.col("at") / span)
    each = stops.withColumn("band", F.explode_outer(F.array(band - 1, band)))
    keys = ["airport", "kind", "band"]
    if min_stay <= 0 <= max_stay:  # times that don't tell a stay meet all second legs of a kind
        untold = kept(rows.where("at is null").select("airport", "kind").distinct(), "untold")
        each = each.where("band is not null").unionByName(stops.join(untold, ["airport", "kind"], "left_semi").withColumn("band", F.lit(None).cast("long")))
    never = F.lit(-(1 << 62)).cast("long")
    rows, each = (x.withColumn("band", F.coalesce("band", never)) for x in (rows, each))
    counts = rows.groupBy(keys).agg(F.count("*").alias("n1")).join(each.groupBy(keys).agg(F.count("*").alias("n2")), keys)
    counts = kept(counts.select(*keys, *[F.ceil(F.col(f"n{k}") / BLOCK).cast("long").alias(c) for k, c in ((1, "rows"), (2, "columns"))]), "block-sizes")
    dealt = lambda x, pos, own, other, of: x.join(counts, keys).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1))).withColumn(own, F.pmod(F.xxhash64(pos), F.col(own))).withColumn(other, F.col("other")).select(*keys, "rows", "columns", *of)
    left = dealt(rows, "leg1_pos", "rows", "columns", ["at", "city", "price"])
    right = dealt(each, "leg2_pos", "columns", "rows", ["at", "partner"])

    def together(a: pa.Table, b: pa.Table) -> pa.Table:
        names = [x.split(" ")[0] for x in BLOCKS.split(", ")]
        schema = pa.schema(list(zip(names, [pa.list_(pa.string())] + [pa.binary()] * 5, strict=True)))
        if not len(a) or not len(b):
            return schema.empty_table()
        partner = b.column("partner").to_numpy()
        if a.column("at").null_count:
            low, high = np.zeros(len(a), np.int64), np.full(len(a), len(b), np.int64)
        else:
            at, ask = b.column("at").to_numpy(), a.column("at").to_numpy()
            order = np.argsort(at, kind="stable")
            at, partner = at[order], partner[order]
            low, high = np.searchsorted(at, ask, "left"), np.searchsorted(at, ask + span, "left")
        some = high > low
        if not some.any():
            return schema.empty_table()
        city = a.column("city").combine_chunks().dictionary_encode()
        city = city.combine_chunks() if isinstance(city, pa.ChunkedArray) else city
        arrays = [city.indices.to_numpy()[some].astype(np.int32), a.column("price").to_numpy()[some], low[some].astype(np.int32), high[some].astype(np.int32), partner]
        return pa.Table.from_pylist([dict(zip(names, [city.dictionary.to_pylist(), *[x.tobytes() for x in arrays]], strict=True))], schema)

    ship(first.sparkSession)
    keyed = [*keys, "rows", "columns"]
    return kept(left.groupBy(*keyed).cogroup(right.groupBy(*keyed)).applyInArrow(together, BLOCKS), "blocks")


def _mapped(rows: DataFrame, f: Callable[[Block, np.random.Generator], list[dict]], schema: str, types: list[tuple[str, pa.DataType]]) -> DataFrame:
    """What a function finds in each block; it draws the same whenever a task runs again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                row = batch.slice(k, 1).to_pylist()[0]
                rng = np.random.default_rng([len(row["price"]), len(row["partner"]), *np.frombuffer(row["price"][:8], np.uint32).tolist()])
                found = f(Block(row), rng)
                if found:
                    yield pa.RecordBatch.from_pylist(found, pa.schema(types))

    return rows.mapInArrow(run, schema)


def _sums(rows: DataFrame, cities: bool, whole: bool) -> DataFrame:
    def f(b: Block, _: np.random.Generator) -> list[dict]:
        size, before = b.high - b.low, np.concatenate([[0.0], np.cumsum(b.partner)])
        everyone = np.arange(len(size))
        total = b.price * size + before[b.high] - before[b.low]
        least, most = b.prices(everyone, np.zeros(len(size), np.int64)), b.prices(everyone, size - 1)
        return [{"city": c, "n": int(size[own].sum()), "total": float(total[own].sum()), "least": float(least[own].min()), "most": float(most[own].max())} for c, own in b.groups(cities, whole) if len(own)]

    found = _mapped(rows, f, "city string, n long, total double, least double, most double", [("city", pa.string()), ("n", pa.int64()), ("total", pa.float64()), ("least", pa.float64()), ("most", pa.float64())])
    return found.groupBy("city").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("least").alias("least"), F.max("most").alias("most"))


def _between(rows: DataFrame, bounds: dict[str | None, tuple[float, float, float]]) -> DataFrame:
    """(city, before, inside, value, n): journeys up to the first bound and up to the second, and the prices drawn of the latter; of a share of 1 all, added up by value."""
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast(bounds)

    def f(b: Block, rng: np.random.Generator) -> list[dict]:
        out, bounds = [], sent.value
        for city, own in b.groups(any(c is not WHOLE for c in bounds), WHOLE in bounds):
            if city not in bounds or not len(own):
                continue
            low, high, share = bounds[city]
            under = b.upto(own, low)
            inside = b.upto(own, high) - under
            ends = np.cumsum(inside)
            m = int(ends[-1])
            drawn = np.arange(m) if share >= 1 else np.sort(rng.integers(0, m, rng.binomial(m, share))) if m and share > 0 else np.zeros(0, np.int64)
            at = np.searchsorted(ends, drawn, "right")
            value, n = np.unique(b.prices(own[at], under[at] + drawn - (ends[at] - inside[at])), return_counts=True)
            out.append({"city": city, "before": int(under.sum()), "inside": m, "value": value.tolist(), "n": n.tolist()})
        return out

    types = [("city", pa.string()), ("before", pa.int64()), ("inside", pa.int64()), ("value", pa.list_(pa.float64())), ("n", pa.list_(pa.int64()))]
    return kept(_mapped(rows, f, "city string, before long, inside long, value array<double>, n array<long>", types), "between")


def _at(drawn: DataFrame, wanted: dict[str | None, tuple[float, float, int | None]]) -> dict[str | None, tuple[float, float, float]]:
    """Of each group three of the prices drawn: at two shares and half-way, or three times the one of a given place. About ALL were drawn of a group at most."""
    each = drawn.select("city", F.explode(F.arrays_zip("value", "n")).alias("x")).groupBy("city", "x.value").agg(F.sum("x.n").alias("n"))
    lists = each.groupBy("city").agg(F.array_sort(F.collect_list(F.struct("value", "n"))).alias("x"))
    sent = drawn.sparkSession.sparkContext.broadcast(wanted)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                value, ends = [x["value"] for x in r["x"]], np.cumsum([x["n"] for x in r["x"]])
                low, high, place = sent.value[r["city"]]
                last = int(ends[-1]) - 1
                places = [min(last, max(0, int(s * (last + 1)))) for s in (low, high, (low + high) / 2)] if place is None else [place] * 3
                at = [value[int(np.searchsorted(ends, k, "right"))] for k in places]
                yield pa.RecordBatch.from_pylist([{"city": r["city"], "low": at[0], "high": at[1], "middle": at[2]}], pa.schema([("city", pa.string()), ("low", pa.float64()), ("high", pa.float64()), ("middle", pa.float64())]))

    return {r.city: (r.low, r.high, r.middle) for r in lists.mapInArrow(pick, "city string, low double, high double, middle double").collect()}


def summary(rows: DataFrame, cities: bool, whole: bool) -> list[tuple]:
    """(city, total_combinations, min_price, max_price, avg_price, median_price) of blocks, for each city and, with city WHOLE, for all.

    The driver has a row for each city. A group's median lies above `low`, up to `high`, and
    `before` journeys cost `low` at most. Each pass counts by bounds that the prices drawn in
    the one before suggest; whatever they are, the counts tell on which side the median is, and
    between which bounds. The median is the exact upper one.
    """
    figures = {r.city: r for r in _sums(rows, cities, whole).collect()}
    state = {c: {"target": r.n // 2, "before": 0, "inside": r.n, "low": -math.inf, "high": math.inf} for c, r in figures.items()}
    asked, median = {c: (-math.inf, math.inf) for c in state}, {}
    for _ in range(PASSES):
        if not asked:
            break
        share = {c: 1.0 if state[c]["inside"] <= ALL else min(1.0, DRAWN / state[c]["inside"] * (1 if asked[c] == (state[c]["low"], state[c]["high"]) else state[c]["narrower"])) for c in asked}
        drawn = _between(rows, {c: (*asked[c], share[c]) for c in asked})
        wanted = {}
        for r in drawn.groupBy("city").agg(F.sum("before").alias("before"), F.sum("inside").alias("inside"), F.sum(F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x)).alias("drawn")).collect():
            s, (low, high) = state[r.city], asked[r.city]
            end = s["before"] + s["inside"]
            if s["target"] < r.before:
                s |= {"high": low, "inside": r.before - s["before"]}
            elif s["target"] >= r.before + r.inside:
                s |= {"low": high, "before": r.before + r.inside, "inside": end - r.before - r.inside}
            else:
                s |= {"low": low, "high": high, "before": r.before, "inside": r.inside}
                if math.nextafter(low, math.inf) == high:
                    median[r.city] = high
                elif share[r.city] >= 1:
                    wanted[r.city] = (0.0, 0.0, s["target"] - r.before)
                elif r.drawn:
                    f = (s["target"] - r.before + 0.5) / r.inside
                    d = 4 * math.sqrt(f * (1 - f) / r.drawn) + 1 / r.drawn
                    wanted[r.city] = (f - d, f + d, None)
        picked = _at(drawn.join(drawn.sparkSession.createDataFrame([(c,) for c in wanted], "own string"), F.col("city").eqNullSafe(F.col("own")), "left_semi"), wanted) if wanted else {}
        asked = {}
        for c, s in state.items():
            if c in median:
                continue
            if c in picked:
                low, high, middle = picked[c]
                if wanted[c][2] is not None:
                    median[c] = high
                    continue
                low = math.nextafter(low, -math.inf)
                if low <= s["low"] and high >= s["high"]:  # no nearer: prices are very often the same
                    low, high = math.nextafter(middle, -math.inf), middle
                s["narrower"] = max(1.0, 1 / max(1e-9, wanted[c][1] - wanted[c][0]))
                asked[c] = (max(low, s["low"]), high)
            else:
                asked[c] = (s["low"], s["high"])
    if len(median) < len(state):
        raise ValueError("prices must be finite numbers")
    return [(c, r.n, r.least, r.most, round(r.total / r.n, 2), median[c]) for c, r in figures.items()]

"""Price statistics and rankings of journeys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ternway.session import kept

ORDER = ("total_price", "leg1_pos", "leg2_pos")

#: One in so many first legs is looked at to see about where a median lies.
SAMPLE = 16
#: Shares of prices between which a median is looked for, on both sides of the middle, and how many standard deviations of the sample's error a share must have.
SHARES, DEVIATIONS = (0.0005, 0.001, 0.002, 0.004, 0.008, 0.016, 0.032, 0.064, 0.128, 0.256), 4
#: Parts into which a round of the selection divides what is left.
RADIX = 4096
#: Rounds after which prices that can't be told apart are an error.
ROUNDS = 64


def summary(prices: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, total_combinations, min_price, max_price, avg_price, median_price) of (keys, total_price).

    The median is the exact upper one: the middle price or, of an even number, the larger of
    both. A sample of first legs, if there is leg1_pos, tells two bounds about it. One pass over all prices adds
    up those below, those above, and those between by value. If the median is not between, as
    the counts show, that key is gone through again with all its values. What was added up is
    written and then divided into RADIX parts of equal width again and again, all keys in the
    same rounds, until the middle's part has one price. No task sees more of a key than its
    sums, and no window more than RADIX rows.
    """
    bounds = kept(_bounds(prices, keys), "median-bounds")
    done = None
    while True:
        both = prices.join(bounds, keys, "left")
        side = F.when(F.col("total_price") < F.col("low"), 0).when(F.col("total_price") > F.col("high"), 2).otherwise(1)
        sums = [F.count("*").alias("n"), F.sum("total_price").alias("total"), F.min("total_price").alias("least"), F.max("total_price").alias("most")]
        near = both.withColumn("side", side).groupBy(*keys, "side", F.when(F.col("side") == 1, F.col("total_price")).alias("value")).agg(*sums)
        near = kept(near, "median-values")
        before = F.coalesce(F.sum(F.when(F.col("side") == 0, F.col("n"))), F.lit(0))
        state = near.groupBy(*keys).agg(
            F.sum("n").alias("total_combinations"),
            F.min("least").alias("min_price"),
            F.max("most").alias("max_price"),
            F.round(F.sum("total") / F.sum("n"), 2).alias("avg_price"),
            before.alias("before"),
            (before + F.coalesce(F.sum(F.when(F.col("side") == 1, F.col("n"))), F.lit(0))).alias("upto"),
            F.min("value").alias("low"),
            F.max("value").alias("high"),
        )
        target = F.floor(F.col("total_combinations") / 2)
        state = kept(state.withColumn("target", target).withColumn("inside", (F.col("before") <= target) & (target < F.col("upto"))), "median-state")
        middle = _selected(near.where("side = 1"), state.where("inside").select(*keys, "target", "before", "low", "high"), keys)
        found = state.where("inside").select(*keys, "total_combinations", "min_price", "max_price", "avg_price").join(middle, keys)
        done = found if done is None else done.unionByName(found)
        missed = state.where("not inside").select(*keys)
        if missed.isEmpty():
            return done
        prices, bounds = prices.join(missed, keys, "left_semi"), bounds.where(F.lit(False))


def _bounds(prices: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, low, high): where the median should be, of keys with enough first legs in the sample."""
    if "leg1_pos" not in prices.columns:
        return prices.select(*keys, F.col("total_price").alias("low"), F.col("total_price").alias("high")).where(F.lit(False))
    sample = prices.where(F.pmod(F.xxhash64(F.lit(29), "leg1_pos"), F.lit(SAMPLE)) == 0)
    at = [0.5 - s for s in reversed(SHARES)] + [0.5 + s for s in SHARES]
    seen = sample.groupBy(*keys).agg(F.percentile_approx("total_price", at, 4096).alias("at"), F.approx_count_distinct("leg1_pos").alias("legs"))
    share = F.lit(None).cast("int")
    for k in reversed(range(len(SHARES))):
        share = F.when(F.sqrt("legs") * SHARES[k] >= DEVIATIONS * 0.5, k).otherwise(share)
    low, high = F.get("at", F.lit(len(SHARES) - 1) - F.col("k")), F.get("at", F.lit(len(SHARES)) + F.col("k"))
    return seen.withColumn("k", share).where("k is not null").select(*keys, low.alias("low"), high.alias("high"))


def _selected(near: DataFrame, state: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, median_price): of each key the price of place `target`, counted from 0; `before` are below `low`."""
    for _ in range(ROUNDS):
        rows = near.join(state.where("low < high"), keys).where("value >= low and value <= high")
        part = F.least(F.lit(RADIX - 1), F.floor((F.col("value") - F.col("low")) / (F.col("high") - F.col("low")) * RADIX))
        sums = rows.groupBy(*keys, part.alias("part")).agg(F.sum("n").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"), F.first("target").alias("target"), F.first("before").alias("before"))
        upto = F.col("before") + F.sum("n").over(Window.partitionBy(*keys).orderBy("part"))
        middle = sums.withColumn("upto", upto).where("upto > target").groupBy(*keys).agg(F.min_by(F.struct("target", (F.col("upto") - F.col("n")).alias("before"), "low", "high"), "part").alias("m"))
        state = kept(state.where("low = high").unionByName(middle.select(*keys, "m.*")), "median-state")
        if state.where("low < high").isEmpty():
            return state.select(*keys, F.col("low").alias("median_price"))
    raise ValueError("prices must be finite numbers")


def _priced(journeys: DataFrame, *keys: Column) -> DataFrame:
    return journeys.select(*keys, "total_price", *[c for c in ("leg1_pos",) if c in journeys.columns])


def price_stats(journeys: DataFrame) -> DataFrame:
    """One row of figures over all journeys, all 0 if there are none."""
    found = summary(_priced(journeys, F.lit(0).alias("whole")), ["whole"])
    one = journeys.sparkSession.range(1).select(F.lit(0).alias("whole"))
    return one.join(found, "whole", "left").drop("whole").na.fill(0)


def stats_by_city_and_all(journeys: DataFrame) -> DataFrame:
    """Figures for all journeys (is_total 1, no city) and for each city, in the same rounds."""
    group = lambda total, city: F.struct(F.lit(total).cast("long").alias("is_total"), city.alias("city"))
    both = F.explode(F.array(group(0, F.col("intermediate_city")), group(1, F.lit(""))))
    found = summary(_priced(journeys, both.alias("g")).select("g.*", "*").drop("g"), ["is_total", "city"])
    return found.withColumn("intermediate_city", F.when(F.col("is_total") == 0, F.col("city"))).drop("city")


def city_stats(journeys: DataFrame) -> DataFrame:
    """Number, least and mean price for each stopover city."""
    return journeys.groupBy("intermediate_city").agg(F.count("*").alias("count"), F.min("total_price").alias("min_price"), F.round(F.avg("total_price"), 2).alias("avg_price"))


def cheapest_per_city(journeys: DataFrame) -> DataFrame:
    """The first journey of each city by price, ties by the flights' places."""
    w = Window.partitionBy("intermediate_city").orderBy(*ORDER)
    return journeys.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def cheapest(journeys: DataFrame, n: int, unique_cities: bool = False) -> DataFrame:
    """The n first journeys with their rank, one for each city if asked for; a negative n is an error."""
    if n < 0:
        raise ValueError("the number of journeys must not be negative")
    rows = (cheapest_per_city(journeys) if unique_cities else journeys).orderBy(*ORDER).limit(n)
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(*ORDER)).cast("long"))

"""The join of both legs into journeys."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ternway.functions import times
from ternway.operators.legs import TIME
from ternway.operators.network import allowed_airports
from ternway.session import kept
from ternway.sources.files import Network

#: Columns of a journey; the positions of its flights break ties.
COLUMNS = ("total_price", "stay_days", "intermediate_city", "leg1", "leg2", "airport_transfer", "leg1_pos", "leg2_pos")

#: Pairs of flights that one key of the join makes at least before it is cut, and the parts that all pairs make; keys of more than either are cut into parts of about so many.
PAIRS, PARTS = 1 << 22, 1 << 10
#: Pairs that a task of the join gets, so that a few million keep all cores busy; PARTS tasks at most.
TASK_PAIRS = 1 << 20
#: Bands that the length of stays is cut into. With more, second legs have more copies, and fewer pairs that meet are out of the stays.
BANDS = 4
#: Hot keys, some 50 bytes each, up to which all tasks get them; beyond, they are joined by shuffling.
BROADCAST_KEYS = 100_000


def counted(left: DataFrame, right: DataFrame, keys: list[str], nulls: tuple[str, str] | None = None) -> DataFrame:
    """(keys, n1, n2, u1, u2): both sides' rows by key, and those without a value in `nulls`; keys of neither pairs nor such rows are left out. A narrow row for each key."""
    own = [F.col(c).isNull().cast("int") for c in nulls] if nulls else [F.lit(0)] * 2
    zero = F.lit(0)
    sides = [(left, (F.lit(1), zero, own[0], zero)), (right, (zero, F.lit(1), zero, own[1]))]
    one = [rows.select(*keys, *[x.alias(c) for c, x in zip(("n1", "n2", "u1", "u2"), values, strict=True)]) for rows, values in sides]
    counts = one[0].unionByName(one[1]).groupBy(keys).agg(*[F.sum(n).cast("double").alias(n) for n in ("n1", "n2", "u1", "u2")])
    return kept(counts.where("n1 > 0 and n2 > 0 or u1 > 0 or u2 > 0"), "counts")


def balanced(left: DataFrame, right: DataFrame, keys: list[str], counts: DataFrame | None = None) -> DataFrame:
    """left.join(right, keys), where keys of very many pairs are cut into a grid.

    One pass counts both sides by key. A hot key's first legs are dealt over the rows of its grid
    and its second legs over the columns, by their places; each leg is copied along its own row
    or column, so a pair meets in one part. Parts are as square as the counts allow, so a leg
    has about as many copies as the other side has times the root of a part's pairs. A part has
    PAIRS pairs or a PARTS-th of all, whatever is more: with T pairs in all there are at most
    2 * sqrt(PARTS * T) copies, and so no more than the legs grow, as T grows with their square.
    Without hot keys it is the plain join, without pairs an empty one. Both are known before the
    join is planned. The number of tasks follows from the pairs, as few rows may make very many.
    """
    counts = (counted(left, right, keys) if counts is None else counts).dropna(subset=keys)
    pairs = F.col("n1") * F.col("n2")
    total = counts.agg(F.sum(pairs)).first()[0]
    if not total:
        return left.where(F.lit(False)).join(right.where(F.lit(False)), keys)
    most = max(float(PAIRS), total / PARTS)
    side = lambda own, other: F.ceil(F.col(own) / F.greatest(F.lit(most**0.5), F.lit(most) / F.col(other)))
    hot = counts.where(pairs > most).select(*keys, side("n1", "n2").alias("rows"), side("n2", "n1").alias("columns"))
    n = hot.count()
    tasks = min(PARTS, math.ceil(total / min(PAIRS, TASK_PAIRS)))
    dealt = lambda on: left.repartition(tasks, *on).join(right.repartition(tasks, *on), on)
    if not n:
        return dealt(keys)
    if n <= BROADCAST_KEYS:
        hot = F.broadcast(hot)
    rows, columns = (F.coalesce(c, F.lit(1).cast("long")) for c in ("rows", "columns"))
    every = lambda k: F.sequence(F.lit(0).cast("long"), k - 1)
    place = lambda pos, k: F.pmod(F.xxhash64(pos), k)
    left = left.join(hot, keys, "left").withColumn("part", F.explode(F.transform(every(columns), lambda c: place("leg1_pos", rows) * columns + c))).drop("rows", "columns")
    right = right.join(hot, keys, "left").withColumn("part", F.explode(F.transform(every(rows), lambda r: r * columns + place("leg2_pos", columns)))).drop("rows", "columns")
    return dealt([*keys, "part"]).drop("part")


def _sides(first: DataFrame, second: DataFrame, allowed: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    left = first.where("city is not null").withColumn("airport", F.col("city")) if allowed is None else first.join(allowed, "city")
    left = left.select(*(["city"] if allowed is not None else []), "airport", F.col("pos").alias("leg1_pos"), F.col("leg").alias("leg1"), *[F.col(c).alias(f"{c}1") for c in TIME], *[c for c in ("most",) if c in first.columns])
    right = second.where("origin is not null").select(F.col("origin").alias("airport"), F.col("pos").alias("leg2_pos"), F.col("leg").alias("leg2"), *[F.col(c).alias(f"{c}2") for c in TIME])
    return left, right


def pair(first: DataFrame, second: DataFrame, allowed: DataFrame | None, min_stay: int, max_stay: int, banded: bool = True, few: bool = False) -> DataFrame:
    """Pairs of first and second legs at an allowed airport, or at the city itself without any, with a stay of min_stay to max_stay days.

    banded: the days of arrival and departure take part in the join's key, so a busy airport is
    many keys. A first leg stands in one band, a BANDS-th of the stays' length, a second leg in all
    bands that may reach it, five to seven, with a day to spare for stays that only dates tell; so
    each pair meets once. A stay that neither times nor dates tell is 0; where 0 is wanted, flights without
    a date are also joined by airport alone. Busy days of an airport are cut up (`balanced`).

    few: the first legs are few, as those of a ranking, and need no counting: Spark sends them to
    all tasks, so no key is hot. Then they stand in several bands, and second legs in one.
    """
    meet = (lambda a, b, keys: a.join(b, keys)) if few else balanced
    left, right = _sides(first, second, allowed)
    exact, dates = times.stay_parts(*[F.col(f"{c}{k}") for k in (1, 2) for c in TIME])
    told = F.coalesce(exact, dates)
    if max_stay < min_stay:
        return left.join(right, "airport").withColumn("stay_days", told.cast("long")).where(F.lit(False))
    if not banded:
        return left.join(right, "airport").withColumn("stay_days", F.coalesce(told, F.lit(0)).cast("long")).where(F.col("stay_days").between(min_stay, max_stay))
    width = max_stay - min_stay + 1
    if not few:
        width = math.ceil(width / BANDS)
    day1, day2 = (F.coalesce(F.floor(F.col(f"sec{k}") / times.DAY), F.col(f"day{k}")) for k in (1, 2))
    bands = lambda low, high: F.explode_outer(F.sequence(F.floor(low / width), F.floor(high / width)))
    if few:
        sides = left.withColumn("band", bands(day1 + (min_stay - 1), day1 + (max_stay + 2))), right.withColumn("band", F.floor(day2 / width))
    else:
        sides = left.withColumn("band", F.floor(day1 / width)), right.withColumn("band", bands(day2 - (max_stay + 2), day2 - (min_stay - 1)))
    counts = None if few else counted(*sides, ["airport", "band"], ("day1", "day2"))
    near = sides[0].join(sides[1], ["airport", "band"]) if few else balanced(*sides, ["airport", "band"], counts)
    near = near.drop("band").withColumn("stay_days", told.cast("long")).where(F.col("stay_days").between(min_stay, max_stay))
    if not min_stay <= 0 <= max_stay:
        return near
    if not few and not any(counts.agg(F.sum("u1"), F.sum("u2")).first()):  # all have dates
        return near
    undated = meet(left.where("day1 is null"), right, ["airport"]).unionByName(meet(left.where("day1 is not null"), right.where("day2 is null"), ["airport"]))
    return near.unionByName(undated.where(told.isNull()).withColumn("stay_days", F.lit(0).cast("long")))


def transfer(network: Network | None) -> tuple[Column, list[tuple[DataFrame, list[str]]]]:
    """The airport_transfer struct, and the tables that it needs joined: names of both airports and the first distance listed."""
    if network is None:
        return F.lit(None).cast("struct<from_airport:string,from_city:string,to_airport:string,to_city:string,distance_km:double>"), []
    names = network.airports.select("iata", F.coalesce("municipality", F.lit("")).alias("name"))
    first = network.edges.groupBy("src", "dst").agg(F.min_by(F.coalesce("distance_km", F.lit(0.0)), "pos").alias("km"))
    tables = [
        (names.select(F.col("iata").alias("city"), F.col("name").alias("from_name")), ["city"]),
        (names.select(F.col("iata").alias("airport"), F.col("name").alias("to_name")), ["airport"]),
        (first.select(F.col("src").alias("city"), F.col("dst").alias("airport"), "km"), ["city", "airport"]),
    ]
    both = F.col("from_name").isNotNull() & F.col("to_name").isNotNull()
    only = lambda c: F.when(both, F.col(c))
    shown = F.struct(F.col("city").alias("from_airport"), only("from_name").alias("from_city"), F.col("airport").alias("to_airport"), only("to_name").alias("to_city"), only("km").alias("distance_km"))
    return F.when(F.col("airport") != F.col("city"), shown), tables


def journeys(first: DataFrame, second: DataFrame, network: Network | None = None, min_stay: int = 1, max_stay: int = 30, max_km: float = 100.0, same_country: bool = True, banded: bool = True) -> DataFrame:
    """All journeys of prepared legs, with COLUMNS.

    Legs meet at the first leg's city or, with a network, at an airport near it. airport_transfer
    is null for those that meet in the city; its names and distance are null unless both
    airports are in the network. First legs may have a column `most`, the price that their
    journeys don't exceed.
    """
    allowed = None if network is None else allowed_airports(first, network, max_km, same_country)
    rows = pair(first, second, allowed, min_stay, max_stay, banded, few="most" in first.columns)
    if allowed is None:  # each airport is its own city, which needs no column in the join
        rows = rows.withColumn("city", F.col("airport"))
    if "most" in first.columns:
        rows = rows.where(F.col("leg1.price") + F.col("leg2.price") <= F.col("most"))
    shown, tables = transfer(network)
    for table, on in tables:
        rows = rows.join(table, on, "left")
    return rows.select(
        (F.col("leg1.price") + F.col("leg2.price")).alias("total_price"),
        "stay_days",
        F.col("city").alias("intermediate_city"),
        "leg1",
        "leg2",
        shown.alias("airport_transfer"),
        "leg1_pos",
        "leg2_pos",
    )

"""What first legs find in the windows of their stays, without pairing them: numbers, sums, bounds and cheapest partners.

A stay of min_stay to max_stay days is a window of whole days' length on the second legs' times.
It is the rest of a day, some whole days and the beginning of a day. Whole days are put together
from sums over 1, 2, 4, ... days, so a window of any length needs a few lookups; the two ends
come from running sums within a day. Both legs are first added up by second, so that a day of an
airport has at most 86,400 entries of each, however busy it is, and tasks add up what they have
before they send it.

A `piece` is a group of first legs that arrive in a city at the same second, and one of the two
ends of their window (whole days count to the first): no pair of flights is in two pieces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ternway.functions.times import DAY
from ternway.session import kept

#: What a second leg's time is: with seconds and marked Z, with seconds and a date, with seconds only, a date only, nothing.
AWARE, PLAIN, CLOCK, DATE, NOTHING = range(5)
_TIMED, _DATED = (AWARE, PLAIN, CLOCK), (AWARE, PLAIN, DATE)
#: The sides of a day: from a second on, up to a second; and all that an airport has.
_REST, _BEGINNING, _ALL = range(3)
_SUMS = ("n", "total", "low", "high", "place")


def _summed(rows: DataFrame, *keys: str) -> DataFrame:
    """Number, sum of prices, least and largest price and least place of what was summed before."""
    return rows.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("low").alias("low"), F.max("high").alias("high"), F.min("place").alias("place"))


def _kind() -> Column:
    return F.when(F.col("sec").isNull() & F.col("day").isNull(), NOTHING).when(F.col("sec").isNull(), DATE).when(F.col("day").isNull(), CLOCK).when(F.col("aware"), AWARE).otherwise(PLAIN)


def kind_and_time() -> list[Column]:
    """kind and at: what a second leg's time is, and the second at which it leaves, null where the time tells nothing."""
    return [_kind().alias("kind"), F.when(_kind() == DATE, F.col("day") * DAY).otherwise(F.col("sec")).alias("at")]


def points(second: DataFrame) -> DataFrame:
    """(airport, kind, day, tau, sums) of second legs by the second at which they leave; day and tau are null where the time tells nothing."""
    rows = second.where("origin is not null").select(F.col("origin").alias("airport"), *kind_and_time(), F.col("leg.price").alias("price"), "pos")
    sums = rows.groupBy("airport", "kind", "at").agg(F.count("*").alias("n"), F.sum("price").alias("total"), F.min("price").alias("low"), F.max("price").alias("high"), F.min("pos").alias("place"))
    day = F.floor(F.col("at") / DAY)
    return sums.select("airport", "kind", day.alias("day"), (F.col("at") - day * DAY).alias("tau"), *_SUMS)


def arrivals(first: DataFrame, allowed: DataFrame | None) -> DataFrame:
    """(city, airport, sec, aware, day, sums1) of first legs by the second at which they arrive, for each airport where they may go on."""
    rows = first.where("city is not null").select("city", "sec", "aware", "day", F.col("leg.price").alias("price"), "pos")
    rows = rows.groupBy("city", "sec", "aware", "day").agg(F.count("*").alias("n1"), F.sum("price").alias("total1"), F.min("price").alias("low1"), F.max("price").alias("high1"), F.min("pos").alias("place1"))
    return rows.withColumn("airport", F.col("city")) if allowed is None else rows.join(allowed, "city")


def asked_by_kind(kinds: list[int], min_stay: int, max_stay: int) -> Column:
    """array<struct<kind, at>>: for each kind of second legs the second from which a group of first legs looks; null for all of the airport's."""
    each = []
    for k in kinds:
        at = F.lit(None).cast("long")
        if k in _DATED:
            at = F.when(F.col("day").isNotNull(), (F.col("day") + min_stay) * DAY).otherwise(at)
        if k in _TIMED:
            at = F.when(F.col("sec").isNotNull() & (F.col("aware") == F.lit(k == AWARE)), F.col("sec") + min_stay * DAY).otherwise(at)
        one = F.struct(F.lit(k).alias("kind"), at.alias("at"))
        # times that don't tell a stay make it 0
        each.append(one if min_stay <= 0 <= max_stay else F.when(at.isNotNull(), one))
    return F.array_compact(F.array(*each))


def _covering(days: int) -> Column:
    """array<struct<level, cell>>: the blocks of 2**level days, cell * 2**level the first, that make up the days day + 1 to day + days."""
    out = []
    for level in range(days.bit_length()):
        low = -F.shiftright(-(F.col("day") + 1), level)
        high = F.shiftright(F.col("day") + 1 + days, level)
        one = lambda cell: F.struct(F.lit(level).alias("level"), cell.alias("cell"))  # noqa: B023, E731
        out.append(F.when((low < high) & (F.pmod(low, F.lit(2)) == 1), one(low)))
        out.append(F.when((low < high) & (F.pmod(high, F.lit(2)) == 1), one(high - 1)))
    return F.array_compact(F.array(*out))


def pieces(first: DataFrame, second: DataFrame, allowed: DataFrame | None, min_stay: int, max_stay: int) -> DataFrame:
    """Pieces that hold any pair: (city, airport, sec, aware, day, n1, total1, low1, high1, place1) of the first legs and `_SUMS` of their partners.

    The sums by second of both legs are written first, as several steps read them.
    """
    groups, stops = kept(arrivals(first, allowed), "arrivals"), kept(points(second), "departures")
    kinds = [r.kind for r in stops.select("kind").distinct().collect()] if max_stay >= min_stay else []  # five at most
    own = F.struct("city", "airport", "sec", "aware", F.col("day").alias("day1"), "n1", "total1", "low1", "high1", "place1").alias("own")
    asked = groups.select("airport", own, F.explode(asked_by_kind(sorted(kinds), min_stay, max_stay)).alias("ask")) if kinds else groups.select("airport", own, F.lit(None).cast("struct<kind:int,at:long>").alias("ask")).where(F.lit(False))
    day = F.floor(F.col("ask.at") / DAY)
    asked = asked.select("airport", "own", F.col("ask.kind").alias("kind"), day.alias("day"), (F.col("ask.at") - day * DAY).alias("tau"))

    timed, whole_days = stops.where("day is not null"), max(0, max_stay - min_stay)
    entries = [
        _entry(timed, _REST, F.col("day"), F.col("tau") * -2),
        _entry(timed, _BEGINNING, F.col("day"), F.col("tau") * 2 + 1),
        _question(asked.where("day is not null"), _REST, F.col("day"), F.col("tau") * -2 + 1),
        # nothing leaves before a day begins
        _question(asked.where("tau > 0"), _BEGINNING, F.col("day") + (whole_days + 1), F.col("tau") * 2),
    ]
    if whole_days:
        levels = F.explode(F.sequence(F.lit(0), F.lit(whole_days.bit_length() - 1))).alias("level")
        days = _summed(timed, "airport", "kind", "day").select("*", levels)
        blocks = _summed(days.withColumn("cell", F.expr("shiftright(day, level)")), "airport", "kind", "level", "cell")
        looked = asked.where("day is not null").select("airport", "kind", "day").distinct().select("airport", "kind", "day", F.explode(_covering(whole_days)).alias("block"))
        looked = looked.select("airport", "kind", "day", F.col("block.level").alias("level"), F.col("block.cell").alias("cell"))
        whole = _summed(looked.join(blocks, ["airport", "kind", "level", "cell"]), "airport", "kind", "day")
        # as if it left after the last second of the day: every question about the rest of it counts it
        entries.append(_entry(whole, _REST, F.col("day"), F.lit(-2 * DAY)))
    if min_stay <= 0 <= max_stay:
        zero = F.lit(0).cast("long")
        entries.append(_entry(_summed(stops, "airport", "kind"), _ALL, zero, zero))
        entries.append(_question(asked.where("day is null"), _ALL, zero, zero + 1))

    rows = entries[0]
    for more in entries[1:]:
        rows = rows.unionByName(more, allowMissingColumns=True)
    run = Window.partitionBy("side", "airport", "kind", "cell").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = rows.select("own", *_running(run))
    return found.where("own is not null and n > 0").select("own.*", *_SUMS).withColumnRenamed("day1", "day")


def _running(run: Window) -> list[Column]:
    of = {"n": F.sum, "total": F.sum, "low": F.min, "high": F.max, "place": F.min}
    return [f(c).over(run).alias(c) for c, f in of.items()]


def _entry(rows: DataFrame, side: int, cell: Column, at: Column) -> DataFrame:
    return rows.select(F.lit(side).alias("side"), "airport", "kind", cell.cast("long").alias("cell"), at.cast("long").alias("at"), *_SUMS)


def _question(rows: DataFrame, side: int, cell: Column, at: Column) -> DataFrame:
    return rows.select(F.lit(side).alias("side"), "airport", "kind", cell.cast("long").alias("cell"), at.cast("long").alias("at"), "own")


def figures(found: DataFrame, *keys: str, first: bool = False) -> DataFrame:
    """(keys, count, min_price, max_price, avg_price) of all pairs in pieces; with first also their least (leg1_pos, leg2_pos)."""
    pairs = F.col("n1") * F.col("n")
    total = F.sum(F.col("total1") * F.col("n") + F.col("total") * F.col("n1"))
    place = F.min(F.struct(F.col("place1").alias("leg1_pos"), F.col("place").alias("leg2_pos"))).alias("first")
    return found.groupBy(*keys).agg(
        F.coalesce(F.sum(pairs), F.lit(0)).alias("count"),
        F.min(F.col("low1") + F.col("low")).alias("min_price"),
        F.max(F.col("high1") + F.col("high")).alias("max_price"),
        F.round(total / F.sum(pairs), 2).alias("avg_price"),
        *([place] if first else []),
    )


_GROUP = ("city", "sec", "aware", "day")


def _with_groups(first: DataFrame, groups: DataFrame) -> DataFrame:
    """First legs joined with what is known of their group. Spark broadcasts the groups if they are few, as it knows their size."""
    g = groups.select(*[F.col(c).alias(f"_{c}") for c in _GROUP], *[c for c in groups.columns if c not in _GROUP])
    same = F.col("city") == F.col("_city")
    for c in _GROUP[1:]:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return first.join(g, same).drop(*[f"_{c}" for c in _GROUP])


def journeys_of_each(first: DataFrame, found: DataFrame) -> DataFrame:
    """(leg1_pos, n, transfers): how many journeys each first leg has, and how many of them by another airport, from pieces; first legs without any are left out."""
    moved = F.sum(F.when(F.col("airport") != F.col("city"), F.col("n")).otherwise(0))
    groups = found.groupBy(*_GROUP).agg(F.sum("n").alias("n"), moved.alias("transfers"))
    own = _with_groups(first.select("pos", *_GROUP), groups)
    return own.groupBy(F.col("pos").alias("leg1_pos")).agg(F.sum("n").alias("n"), F.sum("transfers").alias("transfers"))


def leaders(first: DataFrame, found: DataFrame, n: int | None) -> DataFrame:
    """The first legs of the n cheapest pairs, or with None of the cheapest pair of each city, and `most`, the price that these don't exceed.

    A first leg and a piece have a cheapest pair. The n pieces with the least prices have n pairs, so
    no pair above the last one's price counts; of the first legs and pieces whose cheapest pairs are
    left, however many are equal, only the n that come first by price and place can have a part.
    Found: at most n rows, more only where places repeat.
    """
    priced = found.select(*_GROUP, "low", (F.col("low1") + F.col("low")).alias("least"))
    if n is None:
        ends = priced.groupBy("city").agg(F.min("least").alias("most"))
        near = priced.join(ends, "city").where("least <= most")
    else:
        ends = priced.select("least").orderBy("least").limit(n).agg(F.max("least").alias("most"))
        near = priced.join(kept(ends, "last-price")).where("least <= most")  # one row
    near = kept(near.groupBy(*_GROUP).agg(F.min("low").alias("low"), F.max("most").alias("most")), "cheapest-groups")
    own = (F.col("leg.price") + F.col("low")).alias("bound")
    legs = kept(_with_groups(first, near).select("*", own).where("bound <= most").drop("low"), "cheapest-legs")
    key = F.struct("bound", "pos")
    if n is None:
        last = legs.groupBy("city").agg(F.min(key).alias("last"))
        legs = legs.join(last, "city").where(key <= F.col("last"))
    else:
        last = legs.select(key.alias("last")).orderBy("last").limit(n).agg(F.max("last").alias("last"))
        legs = legs.join(last).where(key <= F.col("last"))  # one row
    return kept(legs.select(*first.columns, "most"), "leaders")


#: Candidates above which equal prices are told apart by pieces.
MANY = 100_000


def candidates(first: DataFrame, second: DataFrame, allowed: DataFrame | None, min_stay: int, max_stay: int, n: int | None) -> DataFrame:
    """First legs that can have a part in the n cheapest pairs, or with None in a city's cheapest pair, and `most`, the price that these don't exceed.

    Second legs are added up by day. The least price among the whole days inside of a window
    makes a pair; the least price among all days that it touches is a bound. So the n-th first
    leg by the former says above which price no pair counts, and first legs whose bound is
    above it are out. Times that tell no day are bounded by all of their airport.
    """
    day = F.coalesce("day", F.floor(F.col("sec") / DAY))
    stops = second.where("origin is not null").select(F.col("origin").alias("airport"), F.when(F.col("day").isNotNull(), day).alias("at"), F.col("leg.price").alias("low"))
    days = kept(stops.groupBy("airport", "at").agg(F.min("low").alias("low")), "days")
    reach = F.explode(F.sequence(F.col("at") - (max_stay + 1), F.col("at") - min_stay)).alias("day")
    windows = days.where("at is not null").select("airport", "at", "low", reach)
    inner = F.min(F.when((F.col("day") > F.col("at") - (max_stay + 1)) & (F.col("day") < F.col("at") - min_stay), F.col("low")))
    windows = kept(windows.groupBy("airport", "day").agg(inner.alias("inner"), F.min("low").alias("outer")), "windows")
    every = days.groupBy("airport").agg(F.min("low").alias("any"), F.min(F.when(F.col("at").isNull(), F.col("low"))).alias("undated"))

    rows = first.where("city is not null").withColumn("price", F.col("leg.price"))
    rows = rows.withColumn("airport", F.col("city")) if allowed is None else rows.join(allowed, "city")
    rows = rows.join(windows, ["airport", "day"], "left").join(every, "airport")
    bound = F.when(F.col("day").isNull(), F.col("any")).otherwise(F.least("outer", "undated"))
    # no filter for absent ones: it would have the times parsed once more before the join
    made = rows.select("city", (F.col("price") + F.col("inner")).alias("made"))
    if n is None:
        ends = made.groupBy("city").agg(F.min("made").alias("most"))
    else:
        ends = made.select("made").orderBy(F.asc_nulls_last("made")).limit(n).agg(F.when(F.count("made") == n, F.max("made")).alias("most"))
    ends = kept(ends, "ends")
    rows = rows.join(ends, "city", "left") if n is None else rows.join(ends)  # one row
    top = F.coalesce("most", F.lit(float("inf")))
    return rows.where((F.col("price") + bound) <= top).groupBy(*first.columns).agg(F.max(top).alias("most"))

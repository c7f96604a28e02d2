"""The hand-made data set under all option sets, and what the joins must keep true."""

import json
import math
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ternway.functions import geo, times, values
from ternway.operators import collection, journeys, legs, medians, network, partners, prices
from ternway.operators.meeting import Meeting
from ternway.plans.search import Options, search
from ternway.sinks import documents, pieces
from ternway.sources import files
from ternway.sources.files import Network, parse_journeys, parse_network, read_flight_file, read_journeys, read_network, write_network_tables

LEG1 = [
    {"origin": "MOW", "destination": "IST", "departure_at": "2026-02-19T10:00:00+03:00", "duration": 240, "price": 10000},
    {"origin": "MOW", "destination": "SVO", "departure_at": "2026-02-19T08:00:00+03:00", "duration": 60, "price": 3000},
    {"origin": "MOW", "destination": "", "search_destination": "DXB", "arrival_at": "2026-02-20T06:00:00+04:00", "price": 0, "value": 12000},
    {"origin": "MOW", "destination": "IST", "departure_at": "2026-02-20T10:00:00Z", "duration": 240, "price": 9000},
    {"origin": "MOW", "destination": "IST", "departure_at": "2026-02-19T12:00:00+03:00", "duration": 0, "price": 1},
]
LEG2 = [
    {"origin": "IST", "destination": "BKK", "departure_at": "2026-02-20T13:00:00+03:00", "duration": 600, "price": 20000},
    {"origin": "IST", "destination": "BKK", "departure_at": "2026-02-21T14:00:00+03:00", "price": 25000},
    {"origin": "DME", "destination": "BKK", "departure_at": "2026-02-21T09:00:00+03:00", "duration": 540, "price": 30000},
    {"search_origin": "DXB", "destination": "BKK", "departure_at": "2026-03-25T06:00:00+04:00", "duration": 360, "price": 5000},
    {"origin": "DXB", "destination": "BKK", "departure_at": "2026-02-22T05:59:59+04:00", "duration": 360, "price": 8000},
    {"origin": "IST", "destination": "BKK", "departure_at": "2026-02-22T14:00:00Z", "duration": 600, "price": 26000},
]
NETWORK = {
    "SVO": {"name": "S", "municipality": "Moscow", "country": "RU", "coordinates": "55.97, 37.41", "nearby_airports": [{"iata": "CKL", "distance_km": 41.65}, {"iata": "VKO", "distance_km": 43.44}, {"iata": "DME", "distance_km": 69.86}]},
    "DME": {"name": "D", "municipality": "Moscow", "country": "RU", "coordinates": "55.40, 37.90", "nearby_airports": [{"iata": "SVO", "distance_km": 69.86}]},
}


@pytest.fixture(scope="module")
def flights(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("flights") / "f.json"
    path.write_text(json.dumps({"metadata": {"origin": "MOW", "destination": "BKK", "currency": "RUB", "total_flights": 11}, "leg1_flights": LEG1, "leg2_flights": LEG2}))
    return read_flight_file(spark, str(path))


@pytest.fixture(scope="module")
def near(spark):
    return parse_network(spark.createDataFrame([(json.dumps(NETWORK),)], "value string"))


CASES = [
    ({}, [(2, 4), (1, 2), (3, 1), (0, 1), (3, 5), (0, 5)], (6, 20000, 36000, 32166.67, 35000)),
    ({"unique_cities": True}, [(2, 4), (1, 2), (3, 1)], None),
    ({"via": "IST"}, [(3, 1), (0, 1), (3, 5), (0, 5)], (4, 34000, 36000, 35000.0, 35000)),
    ({"min_stay": 2}, [(1, 2), (0, 1), (3, 5), (0, 5)], (4, 33000, 36000, 34750.0, 35000)),
    ({"transfers": False}, [(2, 4), (3, 1), (0, 1), (3, 5), (0, 5)], (5, 20000, 36000, 32000.0, 35000)),
    ({"max_km": 50.0}, [(2, 4), (3, 1), (0, 1), (3, 5), (0, 5)], (5, 20000, 36000, 32000.0, 35000)),
    ({"leg1_from": "2026-02-20"}, [(3, 1), (3, 5)], None),
    ({"depart_date": "2026-02-20", "leg1_from": "2000-01-01"}, [(3, 1), (3, 5)], None),
    ({"min_stay": -1}, [(2, 4), (3, 0), (0, 0), (1, 2), (3, 1), (0, 1), (3, 5), (0, 5)], None),
    ({"min_stay": 40, "max_stay": 50}, [], (0, 0, 0, 0, 0)),
    ({"min_stay": 5, "max_stay": 4}, [], None),
]


@pytest.mark.parametrize(("options", "expected", "stats"), CASES)
def test_option_sets(flights, near, options, expected, stats):
    result = search(flights, near, Options(**options))
    assert [(r.leg1_pos, r.leg2_pos) for r in result.listed.collect()] == expected
    if stats:
        assert tuple(result.statistics.first()) == pytest.approx(stats)


def test_transfer_and_cities(flights, near):
    result = search(flights, near)
    moved = [r.airport_transfer.asDict() for r in result.journeys.collect() if r.airport_transfer]
    assert moved == [{"from_airport": "SVO", "from_city": "Moscow", "to_airport": "DME", "to_city": "Moscow", "distance_km": 69.86}]
    assert [(r.intermediate_city, r["count"], r.min_price, r.avg_price) for r in result.cities.orderBy("rank").collect()] == [("DXB", 1, 20000, 20000.0), ("SVO", 1, 33000, 33000.0), ("IST", 4, 34000, 35000.0)]
    third = [r for r in result.journeys.collect() if r.leg1_pos == 3][0]
    assert third.leg1.arrival_at == "2026-02-20T14:00:00+00:00"


@pytest.mark.parametrize("band", [(1, 30), (0, 0), (-1, 1), (-5, 40)])
def test_banded_join_is_the_plain_join(flights, near, band):
    odd = flights.leg2.union(flights.leg2.withColumn("departure_at", F.lit("2026-02-22T10:00"))).union(flights.leg2.withColumn("departure_at", F.lit("soon")))
    first, second = legs.first_legs(flights.leg1), legs.second_legs(odd)
    a, b = (sorted(map(str, journeys.journeys(first, second, near, *band, banded=x).collect())) for x in (True, False))
    assert a == b


@pytest.mark.parametrize(("pairs", "keys", "stay"), [(1, 0, (0, 9)), (4, 100_000, (-4, 2))])
def test_busy_keys_are_cut_up(spark, near, monkeypatch, pairs, keys, stay):
    """Times that only dates tell and none at all, repeated places: each pair once, however finely keys are cut."""
    monkeypatch.setattr(journeys, "PAIRS", pairs)
    monkeypatch.setattr(journeys, "BROADCAST_KEYS", keys)
    leg1, leg2 = odd_legs(spark, pairs, 120)
    first, second = legs.first_legs(leg1), legs.second_legs(leg2)
    a, b = (sorted(map(str, journeys.journeys(first, second, near, *stay, banded=x).collect())) for x in (True, False))
    assert a == b and len(a) > 50


def test_a_busy_airport_is_many_tasks(spark, monkeypatch):
    """Nine tenths of the flights at one airport in one month: no task has three times the mean of pairs."""
    flights = spark.range(3000).select(
        F.col("id").alias("pos"), F.when(F.col("id") % 10 > 0, "AAA").otherwise(F.concat(F.lit("B"), F.col("id") % 90)).alias("airport"),
        (F.when(F.col("id") % 10 > 0, F.col("id") % 30).otherwise(F.col("id") % 900) / F.lit(30)).cast("long").alias("band"),
    )
    first, second = (flights.select("airport", "band", F.col("pos").alias(f"leg{k}_pos")) for k in (1, 2))
    monkeypatch.setattr(journeys, "PAIRS", 20_000)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sizes = [sorted(r.n for r in rows.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()) for rows in (journeys.balanced(first, second, ["airport", "band"]), first.join(second, ["airport", "band"]))]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert sum(sizes[0]) == sum(sizes[1]) > 7_000_000
    assert max(sizes[0]) <= 3 * sum(sizes[0]) / parts < max(sizes[1])


def test_copies_grow_with_the_legs(spark, monkeypatch):
    """Ten times the flights at a busy airport: the join writes about ten times as many legs, not a hundred."""
    copies = []
    for n in (1000, 10_000):
        legs_of = lambda k: spark.range(n).select(F.lit("AAA").alias("airport"), F.lit(1).alias("band"), F.col("id").alias(f"leg{k}_pos"))  # noqa: B023, E731
        monkeypatch.setattr(journeys, "PAIRS", 1000)
        monkeypatch.setattr(journeys, "PARTS", 16)
        rows = journeys.balanced(legs_of(1), legs_of(2), ["airport", "band"]).groupBy(F.spark_partition_id()).agg(F.approx_count_distinct("leg1_pos", 0.01).alias("a"), F.approx_count_distinct("leg2_pos", 0.01).alias("b"))
        copies.append(rows.agg(F.sum("a") + F.sum("b")).first()[0])
    assert copies[1] <= 12 * copies[0]


def test_exact_combinations_meet_by_day(spark):
    """The registered query doesn't compare all flights of an airport."""
    from ternway import queries

    plan = queries.queries()["combinations_exact"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "band" in plan and "BigDecimal" not in plan


def test_few_pairs_that_meet_are_out_of_the_stays(spark, monkeypatch):
    """Legs spread evenly over a year: well over half of the pairs that the join compares are journeys."""
    flights = [spark.range(2000).select(F.col("id").alias("pos"), F.lit("AAA").alias(city), F.lit("").alias("leg"), F.floor(F.col("id") * times.DAY / 5).alias("sec"), F.lit(False).alias("aware"), F.floor(F.col("id") / 5).alias("day")) for city in ("city", "origin")]
    met, balanced = [], journeys.balanced
    monkeypatch.setattr(journeys, "balanced", lambda *a: met.append(balanced(*a)) or met[-1])
    for stay in ((1, 30), (2, 8)):
        n = journeys.pair(*flights, None, *stay).count()
        assert n == journeys.pair(*flights, None, *stay, banded=False).count() > 0
        assert n >= 0.55 * met[-1].count()


@pytest.mark.parametrize("x", [0.0, -0.005, 0.125, 12.345678, -7.5, 1e17, 123456789.015625])
def test_cents(spark, x):
    far = math.floor(abs(x) * 100 + 0.5) / 100
    got = spark.createDataFrame([(x,)], "x double").select(values.cents(F.col("x"))).first()[0]
    assert got == pytest.approx(math.copysign(far, x) if x else 0.0, abs=1e-9)


def test_plans(flights, near):
    result = search(flights, near)
    plan = lambda df: df._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan(result.journeys) and "BroadcastNestedLoopJoin" not in plan(result.journeys)
    assert "TakeOrderedAndProject" in plan(result.top)
    assert "WindowGroupLimit" in plan(prices.cheapest_per_city(result.journeys))
    # figures of cities come from sums by second: no row has both flights
    assert "total_price" not in plan(result.cities)


def test_result_document_and_report(flights, near, tmp_path):
    result = search(flights, near)
    documents.save_result(result, str(tmp_path / "r.json"))
    saved = json.loads((tmp_path / "r.json").read_text())
    assert saved["statistics"]["total_combinations"] == 6 and saved["statistics"]["by_intermediate_city"]["IST"]["count"] == 4
    assert [c["total_price"] for c in saved["combinations"]] == [20000, 33000, 34000, 35000, 35000, 36000]
    assert ["airport_transfer" in c for c in saved["combinations"]] == [False, True, False, False, False, False]
    assert saved["combinations"][0]["leg1"]["link"] is None
    text = documents.report(result)
    assert "Journeys: 6" in text and "SVO (Moscow) → DME (Moscow), 69.86 km" in text
    empty = search(flights, near, Options(min_stay=40, max_stay=50))
    documents.save_result(empty, str(tmp_path / "e.json"))
    assert json.loads((tmp_path / "e.json").read_text())["statistics"] == {"total_combinations": 0, "min_price": 0, "max_price": 0, "avg_price": 0, "median_price": 0}
    assert documents.report(empty) == "No journeys found."


def test_result_documents_are_written_and_read_by_tasks(spark, flights, near, tmp_path, monkeypatch):
    """The figures are found once; the list is written by as many tasks as its length asks for, in order, and read by ranges of bytes."""
    asked, summary = [], medians.summary
    monkeypatch.setattr(medians, "summary", lambda *a: asked.append(a) or summary(*a))
    monkeypatch.setattr(pieces, "ROWS", 2)
    path = str(tmp_path / "r.json")
    result = search(flights, near).kept()
    documents.report(result)
    documents.save_result(result, path)
    assert len(asked) == 1
    saved = json.loads((tmp_path / "r.json").read_text())
    assert [c["total_price"] for c in saved["combinations"]] == [20000, 33000, 34000, 35000, 35000, 36000]
    kind = "total_price double, stay_days long, leg2 struct<departure_at:string>"
    for size in (97, 1 << 20):
        rows = read_journeys(spark, path, kind, size)
        assert sorted((r.total_price, r.stay_days, r.leg2.departure_at) for r in rows.collect()) == sorted((c["total_price"], c["stay_days"], c["leg2"]["departure_at"]) for c in saved["combinations"])
    assert read_journeys(spark, path, kind, 97).rdd.getNumPartitions() > 1


def test_texts_of_legs_make_those_of_journeys(flights, near):
    first, second = legs.first_legs(flights.leg1), legs.second_legs(flights.leg2)
    whole = documents.journey_json(journeys.journeys(first, second, near))
    parts = documents.journey_json(journeys.journeys(documents.with_texts(first), documents.with_texts(second), near))
    assert sorted(r.value for r in whole.collect()) == sorted(r.value for r in parts.collect())


@pytest.mark.parametrize("price", [7.25, float("nan")])
def test_journeys_are_parsed_from_their_texts(spark, near, monkeypatch, price):
    """What Arrow batches parse is what from_json does, with odd texts, transfers, numbers that JSON has not, and other orders; a flight's text is parsed once a batch."""
    leg1, leg2 = odd_legs(spark, 4, 60)
    odd = F.when(F.col("pos") % 3 == 0, ',"leg1":{"}\n').when(F.col("pos") % 3 == 1, ',"leg2":')
    first = legs.first_legs(leg1.withColumns({"airline": odd, "link": F.col("pos").cast("string"), "price": F.when(F.col("pos") == 5, price).otherwise(F.col("price"))}))
    second = legs.second_legs(leg2.withColumn("flight_number", odd))
    made = journeys.journeys(documents.with_texts(first), documents.with_texts(second), near, 0, 9, same_country=False)
    lines = documents.journey_json(made).cache()
    kind = "leg2 struct<flight_number:string,duration:double>, total_price double, nothing long, airport_transfer struct<to_city:string,distance_km:double>, intermediate_city string, leg1 struct<airline:string,price:double,link:string>, stay_days long"
    shown = lambda rows: sorted(str(r.asDict(True)) for r in rows.collect())
    expected = shown(lines.select(F.from_json("value", kind).alias("j")).select("j.*"))
    assert len(expected) > 50 and shown(parse_journeys(lines, kind)) == expected
    other = lines.select(F.to_json(F.from_json("value", "leg2 struct<flight_number:string>, leg1 struct<airline:string>"), {"ignoreNullFields": "false"}).alias("value"))
    few = "leg1 struct<airline:string>, leg2 struct<flight_number:string>"
    assert shown(parse_journeys(other, few)) == shown(other.select(F.from_json("value", few).alias("j")).select("j.*"))
    asked, objects = [], files._objects
    monkeypatch.setattr(files, "_objects", lambda texts, schema: asked.append((schema.names, len(texts))) or objects(texts, schema))
    texts = pa.array([r.value for r in lines.collect()])
    files._journeys(texts, to_arrow_schema(StructType.fromDDL(kind)))
    assert {tuple(names): n < len(texts) for names, n in asked} == {("total_price", "nothing", "intermediate_city", "stay_days"): False, ("leg1",): True, ("leg2", "airport_transfer"): True}


def test_json_lines_are_not_parsed_one_by_one(spark):
    from ternway import queries

    plan = queries.queries()["journey_json_lines"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "from_json" not in plan and "MapInArrow" in plan


def test_negative_top(flights):
    with pytest.raises(ValueError):
        search(flights, None, Options(top=-1)).top  # noqa: B018
    assert search(flights, None, Options(top=0)).top.count() == 0


@pytest.mark.parametrize("n", range(1, 7))
def test_upper_median(spark, n):
    rows = spark.createDataFrame([(float(k),) for k in range(n)], "total_price double")
    assert prices.price_stats(rows).first().median_price == float(n // 2)


@pytest.mark.parametrize(("radix", "shares", "deviations"), [(4096, prices.SHARES, 4), (2, prices.SHARES, 4), (3, (0.0005, 0.001), 0.0)])
def test_medians_by_selection(spark, monkeypatch, radix, shares, deviations):
    """Few parts a round, and bounds so near that they miss the median: it is still that of the sorted prices."""
    for name, value in (("RADIX", radix), ("SHARES", shares), ("DEVIATIONS", deviations), ("SAMPLE", 4)):
        monkeypatch.setattr(prices, name, value)
    rng = random.Random(1)
    for n in (1, 2, 301):
        rows = [(rng.choice("abc"), float(rng.choice([rng.randrange(-50, 50), 7, 0.1, 1e300, -1e-300])), rng.randrange(40)) for _ in range(n)]
        frame = spark.createDataFrame(rows, "intermediate_city string, total_price double, leg1_pos long")
        got = {r.intermediate_city: r.median_price for r in prices.stats_by_city_and_all(frame).collect()}
        middle = lambda x: sorted(x)[len(x) // 2]
        assert got == {None: middle([p for _, p, _ in rows])} | {c: middle([p for d, p, _ in rows if d == c]) for c in {c for c, _, _ in rows}}


def test_median_has_no_window_over_everything(spark):
    import inspect

    assert "Window.orderBy" not in inspect.getsource(prices.summary) + inspect.getsource(prices._selected)
    rows = spark.createDataFrame([(7.0, k) for k in range(300)], "total_price double, leg1_pos long")
    assert prices.price_stats(rows).first().median_price == 7.0


def odd_legs(spark, seed, n):
    """Both legs with every kind of time, many ties and repeated places."""
    rng = random.Random(seed)

    def text():
        day, clock = f"2026-{rng.choice([2, 3]):02}-{rng.randrange(1, 29):02}", f"{rng.choice([0, 0, 9, 23]):02}:{rng.choice([0, 59]):02}:{rng.choice([0, 1]):02}"
        return rng.choice([f"{day}T{clock}", f"{day}T{clock}", f"{day}T{clock}+03:00", f"{day}T{clock}Z", f"{day} {clock}", day, f"{day}T09:00", "soon", f"x T{clock}"])

    flight = lambda k, **o: {"pos": rng.randrange(n) if k % 5 == 0 else k, "departure_at": text(), "price": float(rng.choice([5, 5, 7, 20, 0.1])), "duration": rng.choice([None, 60.0, 0.5, 90.0]), **o}
    kind = "pos long, origin string, destination string, search_origin string, search_destination string, departure_at string, arrival_at string, duration double, price double, value double, airline string, flight_number string, link string"
    first = [flight(k, destination=rng.choice(["IST", "SVO", "DXB"]), arrival_at=rng.choice([None, text()])) for k in range(n)]
    second = [flight(k, origin=rng.choice(["IST", "DME", "SVO", "VKO"])) for k in range(n)]
    return [spark.createDataFrame(rows, kind) for rows in (first, second)]


@pytest.mark.parametrize(("seed", "stay"), [(2, (0, 0)), (3, (-4, 9)), (6, (5, 4))])
def test_pieces_are_the_pairs(spark, near, monkeypatch, seed, stay):
    """Figures and rankings from pieces are those of all pairs, also where places repeat."""
    leg1, leg2 = odd_legs(spark, seed, 120)
    m = Meeting(legs.first_legs(leg1), legs.second_legs(leg2), near, *stay, same_country=False).kept()
    rows = sorted((r.total_price, r.leg1_pos, r.leg2_pos, r.intermediate_city) for r in m.journeys.collect())
    by_city = {}
    for r in rows:
        by_city.setdefault(r[3], []).append(r)
    got = {r.city: r for r in partners.figures(m.pieces, "city", first=True).collect()}
    assert {c: r["count"] for c, r in got.items()} == {c: len(x) for c, x in by_city.items()}
    for c, x in by_city.items():
        assert got[c].min_price == x[0][0] and got[c].max_price == x[-1][0] and got[c].avg_price == pytest.approx(sum(r[0] for r in x) / len(x), abs=0.006)
        assert tuple(got[c].first) == min(r[1:3] for r in x)
    ranked = lambda q: [(r.total_price, r.leg1_pos, r.leg2_pos) for r in q.orderBy("rank").collect()]
    for n, many in ((7, 100), (50, -1000)):
        monkeypatch.setattr(partners, "MANY", many)
        assert ranked(m.cheapest(n)) == [r[:3] for r in rows[:n]]
    firsts = sorted(x[0] for x in by_city.values())
    assert sorted((r.total_price, r.leg1_pos, r.leg2_pos) for r in m.cheapest_per_city().collect()) == [r[:3] for r in firsts]
    assert ranked(m.cheapest(2, unique_cities=True)) == [r[:3] for r in firsts[:2]]
    stats = m.statistics().first()
    assert stats.total_combinations == len(rows) and stats.median_price == (rows[len(rows) // 2][0] if rows else 0)


@pytest.mark.parametrize(("seed", "stay", "most", "drawn", "block"), [(7, (-4, 9), 60, 40, 16)])
def test_medians_without_pairs(spark, near, monkeypatch, seed, stay, most, drawn, block):
    """Few prices drawn, many passes, blocks cut up: figures and medians of all and of each city are those of all pairs, which are never made."""
    leg1, leg2 = odd_legs(spark, seed, 120)
    m = Meeting(legs.first_legs(leg1), legs.second_legs(leg2), near, *stay, same_country=False)
    rows = [(r.intermediate_city, r.total_price) for r in m.journeys.select("intermediate_city", "total_price").collect()]
    for name, value in (("ALL", most), ("DRAWN", drawn), ("BLOCK", block)):
        monkeypatch.setattr(medians, name, value)
    monkeypatch.setattr(journeys, "journeys", None)
    got = {r.intermediate_city: (r.is_total, r.total_combinations, r.min_price, r.max_price, r.median_price) for r in m.statistics_by_city_and_all().collect()}
    expected = {}
    for city in {None} | {c for c, _ in rows}:
        x = sorted(p for c, p in rows if city in (None, c))
        expected[city] = (int(city is None), len(x), x[0], x[-1], x[len(x) // 2])
    assert len(rows) > 50 and got == expected


def test_journeys_of_each_first_leg(spark, near, monkeypatch):
    """Counted without pairs they are those of all pairs, also where places repeat."""
    leg1, leg2 = odd_legs(spark, 9, 120)
    m = Meeting(legs.first_legs(leg1), legs.second_legs(leg2), near, -2, 5, same_country=False)
    expected = {}
    for r in m.journeys.select("leg1_pos", F.col("airport_transfer").isNotNull().alias("moved")).collect():
        n, moved = expected.get(r.leg1_pos, (0, 0))
        expected[r.leg1_pos] = (n + 1, moved + r.moved)
    monkeypatch.setattr(journeys, "journeys", None)
    assert {r.leg1_pos: (r.n, r.transfers) for r in m.journeys_of_each().collect()} == expected and any(x for _, x in expected.values())


def test_rankings_pair_few_flights(spark):
    """Of many pairs only those of the best first legs, no dearer than the last that is listed, are ever made."""
    at = lambda k: F.date_format(F.timestamp_seconds(F.lit(1_770_000_000) + k), "yyyy-MM-dd'T'HH:mm:ss")
    flights = spark.range(3000).select(F.col("id").alias("pos"), F.lit("IST").alias("origin"), F.lit("IST").alias("destination"), at(F.col("id") * 977).alias("departure_at"), at(F.col("id") * 977).alias("arrival_at"), (F.col("id") * 7919 % 10007 + 1).cast("double").alias("price"))
    flights = flights.select("*", *[F.lit(None).cast(t).alias(c) for c, t in (("duration", "double"), ("value", "double"), ("search_origin", "string"), ("search_destination", "string"), ("airline", "string"), ("flight_number", "string"), ("link", "string"))])
    m = Meeting(legs.first_legs(flights), legs.second_legs(flights)).kept()
    total = partners.figures(m.pieces).first()["count"]
    for few, one in ([f(n) for n in (10, None)] for f in (m._leaders, lambda n: partners.leaders(m.first, m.pieces, n))):
        assert total > 300_000 and few.count() <= 20 and one.count() <= 2
        assert 10 <= m._journeys(few).count() <= 100 and m._journeys(one).count() == 1
    plan = lambda df: df._jdf.queryExecution().toString()
    assert "total_price" not in plan(m.cities_ordered())


def test_network_round_trips(spark, near, tmp_path):
    documents.save_network(near, str(tmp_path / "n.json"))
    assert json.loads((tmp_path / "n.json").read_text())["SVO"]["nearby_airports"] == NETWORK["SVO"]["nearby_airports"]
    write_network_tables(near, str(tmp_path / "n"))
    for path in ("n.json", "n"):
        back = read_network(spark, str(tmp_path / path))
        assert sorted(map(tuple, back.edges.select("src", "dst", "distance_km").collect())) == sorted(map(tuple, near.edges.select("src", "dst", "distance_km").collect()))


def test_country_rules(spark):
    airports = spark.createDataFrame([("LED", "", "", "RU", "", 0), ("HEL", "", "", "FI", "", 1), ("XXX", "", "", "", "", 2)], "iata string, name string, municipality string, country string, coordinates string, pos long")
    edges = spark.createDataFrame([("LED", "HEL", 90.0, 0), ("LED", "HEL", 90.0, 1), ("XXX", "HEL", 50.0, 0), ("LED", "NOT", 10.0, 2)], "src string, dst string, distance_km double, pos long")
    cities = spark.createDataFrame([("LED",), ("XXX",), (None,), ("NEW",)], "city string")
    got = lambda **o: sorted(map(tuple, network.allowed_airports(cities, Network(airports, edges), **o).collect()))
    assert got() == [("LED", "LED"), ("NEW", "NEW"), ("XXX", "HEL"), ("XXX", "XXX")]
    assert got(same_country=False) == [("LED", "HEL"), ("LED", "LED"), ("LED", "NOT"), ("NEW", "NEW"), ("XXX", "HEL"), ("XXX", "XXX")]


def test_cells_of_the_sphere_are_brute_force(spark):
    rows = spark.range(300).select(F.concat(F.lit("A"), "id").alias("iata"), (F.rand(3) * 180 - 90).alias("lat"), (F.rand(4) * 360 - 180).alias("lon"), F.col("id").alias("pos"))
    edge = [("E", 10.0, 179.9), ("W", 10.2, -179.9), ("FAR", 10.1, 540.1), ("N1", 89.9, 5.0), ("N2", 89.8, -170.0), ("POLE", 90.0, 77.0), ("S1", -89.95, 0.0), ("S2", -89.9, 180.0), ("HIGH", 81.0, 0.0), ("NEXT", 81.2, 5.0)]
    odd = [("NAN", float("nan"), 0.0), ("SAME", 1.0, 1.0), ("TWIN", 1.0, 1.0), *edge]
    rows = rows.union(spark.createDataFrame([(*r, 900 + k) for k, r in enumerate(odd)], rows.schema)).cache()
    for km in (0.0, 100.0, 1500.0, 9000.0, 30000.0):
        a, b = (sorted(map(tuple, f(rows, km).select("src", "dst", "distance_km").collect())) for f in (network.within_radius, network.within_radius_brute))
        assert a == b and ("SAME", "TWIN", 0.0) in a


def test_moscow_distances(spark):
    km = geo.distance_km(*[F.lit(x) for x in (55.97, 37.41, 55.41, 37.90)])
    assert spark.range(1).select(km.alias("k")).first().k == pytest.approx(69.4, abs=1)


def test_arrivals(spark):
    rows = spark.createDataFrame([("2026-02-19T10:00:00+03:00", 240.0), ("2026-02-20T10:00:00Z", 90.0), ("odd", 5.0), ("2026-02-19T10:00:00", 0.5), ("2026-02-19T10:00:00", 0.0001)], "t string, m double")
    got = [r.a for r in rows.select(times.arrival_text(F.col("t"), F.col("m")).alias("a")).collect()]
    assert got == ["2026-02-19T14:00:00", "2026-02-20T11:30:00+00:00", "odd", "2026-02-19T10:00:30", "2026-02-19T10:00:00.006000"]


def test_times_do_not_depend_on_the_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        rows = spark.createDataFrame([("2026-03-08T02:30:00",)], "t string")  # no such local time there
        assert rows.select(times.arrival_text(F.col("t"), F.lit(60.0)).alias("a")).first().a == "2026-03-08T03:30:00"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_absent_values(spark):
    rows = spark.createDataFrame([(None, None), (0.0, None), (0.0, 3.0), (2.0, 3.0)], "p double, v double")
    assert [r.x for r in rows.select(values.price_of(F.col("p"), F.col("v")).alias("x")).collect()] == [0, 0, 3, 2]


def test_requests(spark):
    with pytest.raises(ValueError):
        collection.requests(spark, "MOW", "BKK", ("2026-02-20", "2026-02-19"))
    with pytest.raises(ValueError):
        collection.date_series(spark, "20260219x", "2026-02-20")
    assert collection.requests(spark, "MOW", None, ("2026-02-19", "2026-02-20"), ("2026-02-25", "2026-02-26")).count() == 2


PARSED = [
    (1, "2026-02-19T10:00:00+03:00", "2026-02-19 10:00:00", False),
    (2, "2026-02-19T10:00:00-03:00", "2026-02-19 10:00:00", False),
    (3, "2026-02-19T10:00:00Z", "2026-02-19 10:00:00", True),
    (4, "2026-02-19T10:00:00", "2026-02-19 10:00:00", False),
    (5, "2026-02-19 10:00:00", "2026-02-19 10:00:00", False),
    (6, "2026-02-19", "2026-02-19 00:00:00", False),
    (7, "2026-2-9T1:2:3", "2026-02-09 01:02:03", False),
    (8, "2026-02-19T10:00:00.5", None, False),
    (9, "2026-02-19T10:00", None, False),
    (10, "2026-02-30T10:00:00", None, False),
    (11, "", None, False),
    (12, "soon", None, False),
]


def test_forms_of_times(spark):
    rows = spark.createDataFrame([(k, t) for k, t, _, _ in PARSED], "id int, t string").withColumn("at", times.parsed(F.col("t"))).select("id", F.timestamp_seconds("at.sec").cast("string").alias("s"), "at.aware")
    assert sorted(map(tuple, rows.collect())) == [(k, s, aware) for k, _, s, aware in PARSED]


STAYS = [
    ("2026-02-19T14:00:00", "2026-02-20T13:00:00+03:00", 0),
    ("2026-02-20T14:00:00", "2026-02-20T13:00:00", -1),
    ("2026-02-20T06:00:00+04:00", "2026-02-22T05:59:59+04:00", 1),
    ("2026-02-19T14:00:00", "2026-02-22T14:00:00Z", 3),
    ("2026-02-19T14:00:00Z", "2026-02-22T13:00:00Z", 2),
    ("2026-02-19T23:00:00", "2026-02-20T01:00:00", 0),
    ("2026-02-19T23:00", "2026-02-20T01:00:00", 1),
    ("never", "2026-02-20T01:00:00", 0),
]


def test_stays_that_times_or_dates_tell(spark):
    rows = spark.createDataFrame(STAYS, "a string, b string, d long")
    assert [r.got for r in rows.select(times.stay_days(F.col("a"), F.col("b")).alias("got")).collect()] == [d for _, _, d in STAYS]


def test_coordinates(spark):
    rows = spark.createDataFrame([("55.97, 37.41",), (" -1.5 ,200",), ("12",), ("x, 3",), ("1,2,3",), ("1d, 2",), ("1e1, .5",)], "c string")
    assert [tuple(r.at) for r in rows.select(geo.located(F.col("c")).alias("at")).collect()] == [(55.97, 37.41), (-1.5, 200.0), (None, None), (None, None), (1.0, 2.0), (None, None), (10.0, 0.5)]

"""Registered queries of sources, sinks and the command line: they write files and read them back."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ternway import cli, queries, schemas
from ternway.operators import collection, legs, network
from ternway.plans.collect import collect, request_counts
from ternway.plans.network import network_at
from ternway.plans.search import Options, search
from ternway.queries import SQL, literals, query
from ternway.session import shared_path, ship
from ternway.sinks import documents
from ternway.sinks.pieces import Part, write_document
from ternway.sources.fares import FaresReader
from ternway.sources.files import Flights, read_airports, read_flight_file, read_journeys, read_network
from ternway.storage import located


def flights_of(frame: DataFrame, **columns: F.Column) -> DataFrame:
    """Flights with some columns set and the others null."""
    kinds = dict(x.strip().split(" ") for x in schemas.FLIGHT.split(","))
    return frame.select(columns["pos"].cast("long").alias("pos"), *[columns.get(c, F.lit(None)).cast(t).alias(c) for c, t in kinds.items()])


def shop_flights(spark: SparkSession, sf_dir: str) -> Flights:
    """A flight from each supplier's nation as first legs, from each customer's nation as second ones."""
    s, c = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("supplier", "customer"))
    at = lambda key, by: F.concat(F.lit("2026-02-"), F.lpad((F.col(key) % by + 1).cast("string"), 2, "0"), F.lit("T10:00:00+03:00"))
    first = flights_of(s, pos=F.col("s_suppkey"), origin=F.lit("HUB"), destination=F.concat(F.lit("N"), F.col("s_nationkey")), departure_at=at("s_suppkey", 9), duration=F.lit(240.0), price=F.abs("s_acctbal") + 1, airline=F.lit("SU"))
    # some second legs have no departure, some an arrival, some a duration, some neither
    key = F.col("c_custkey")
    second = flights_of(
        c,
        pos=key,
        origin=F.concat(F.lit("N"), F.col("c_nationkey")),
        destination=F.lit("END"),
        departure_at=F.when(key % 7 == 0, "").when(key % 7 != 1, at("c_custkey", 28)),
        arrival_at=F.when(key % 5 == 0, F.lit("2026-03-01T00:00:00")).when(key % 5 == 1, ""),
        duration=F.when(key % 3 == 0, 90.0).when(key % 3 == 1, 0.0),
        price=F.abs("c_acctbal") + 1,
    )
    meta = spark.createDataFrame([("HUB", "END", ["N1"], ("2026-02-01", "2026-02-09"), "RUB", "2026-01-01T00:00:00", 2, ("2026-02-01", "2026-02-28"))], schemas.METADATA)
    return Flights(first, second, meta)


SHOP = """
WITH first AS (
  SELECT s_suppkey AS pos, 'N' || s_nationkey AS city, '2026-02-' || lpad(CAST(s_suppkey % 9 + 1 AS VARCHAR), 2, '0') AS day, abs(s_acctbal) + 1 AS price FROM supplier
), second AS (
  SELECT c_custkey AS pos, 'N' || c_nationkey AS origin, '2026-02-' || lpad(CAST(c_custkey % 28 + 1 AS VARCHAR), 2, '0') AS day, abs(c_acctbal) + 1 AS price,
    c_custkey % 5 = 0 AS given, c_custkey % 3 = 0 AS timed FROM customer WHERE c_custkey % 7 > 1
)"""


def saved(spark: SparkSession, sf_dir: str) -> str:
    path = shared_path(spark, "flights")
    documents.save_flights(shop_flights(spark, sf_dir), path)
    return path


# --- flight files


@query(f"{SHOP} SELECT row_number() OVER (ORDER BY pos) - 1 AS pos, 'HUB' AS origin, city AS destination, day || 'T10:00:00+03:00' AS departure_at, price, 'SU' AS airline FROM first")
def flight_file_legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A flight file written and read again: the places of flights are those within the file."""
    return read_flight_file(spark, saved(spark, sf_dir)).leg1.select("pos", "origin", "destination", "departure_at", "price", "airline")


@query("SELECT 'HUB' AS origin, 'END' AS destination, 'N1' AS stops, '2026-02-01' AS first_day, '2026-02-28' AS last_day, CAST(2 AS BIGINT) AS total_flights")
def flight_file_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_flight_file(spark, saved(spark, sf_dir)).metadata.select("origin", "destination", F.array_join("intermediate_airports", ",").alias("stops"), F.col("leg1_date_range.start").alias("first_day"), F.col("leg2_date_range.end").alias("last_day"), "total_flights")


@query("SELECT 'no list' AS file, CAST(0 AS BIGINT) AS leg1, count(*) AS leg2 FROM customer UNION ALL SELECT 'empty list', CAST(0 AS BIGINT), count(*) FROM customer UNION ALL SELECT 'missing file', CAST(-1 AS BIGINT), CAST(-1 AS BIGINT)")
def flight_file_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flight files with a missing and with an empty list of first legs beside all second ones, and a file that isn't there."""
    second = shop_flights(spark, sf_dir).leg2
    texts = second.select("pos", F.to_json(F.struct(*[c for c in second.columns if c != "pos"])).alias("value"))
    heads = {"no list": '{"leg2_flights": [', "empty list": '{"leg1_flights": [], "leg2_flights": [', "missing file": None}
    out = []
    for name, head in heads.items():
        path = shared_path(spark, "gaps")
        if head:
            write_document(spark, [Part(head, texts, ("pos",))], "]}", path)
        try:
            found = read_flight_file(spark, path)
            counts = found.leg1.agg(F.count("*").alias("leg1")).crossJoin(found.leg2.agg(F.count("*").alias("leg2")))
        except AnalysisException:
            counts = spark.range(1).select(F.lit(-1).cast("long").alias("leg1"), F.lit(-1).cast("long").alias("leg2"))
        out.append(counts.select(F.lit(name).alias("file"), "leg1", "leg2"))
    return collection.union_all(out)


# --- second legs


@query(f"{SHOP} SELECT pos, day || 'T10:00:00+03:00' AS departure_at, CASE WHEN given THEN '2026-03-01T00:00:00' WHEN timed THEN day || 'T11:30:00' ELSE day || 'T10:00:00+03:00' END AS arrival_at FROM second")
def leg2_arrival(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second legs need a departure; their arrival is given, computed or the departure."""
    return legs.second_legs(shop_flights(spark, sf_dir).leg2).select("pos", "leg.departure_at", "leg.arrival_at")


for _name, _low, _high in (("from", "2026-02-15", None), ("to", None, "2026-02-07"), ("both", "2026-02-05", "2026-02-20")):
    queries.QUERIES[f"leg2_date_filter_{_name}"] = lambda spark, sf_dir, low=_low, high=_high: legs.second_legs(shop_flights(spark, sf_dir).leg2, low, high).select("pos", "origin")
    SQL[f"leg2_date_filter_{_name}"] = f"{SHOP} SELECT pos, origin FROM second WHERE day BETWEEN '{_low or '0'}' AND '{_high or '9'}'"


PRECEDENCE = [
    ({"leg1_date": "2026-02-03", "leg1_from": "2026-01-01"}, "2026-02-03", "2026-02-03"),
    ({"depart_date": "2026-02-04", "leg1_to": "2026-03-01"}, "2026-02-04", "2026-02-04"),
    ({"leg1_date": "2026-02-03", "depart_date": "2026-02-04"}, "2026-02-03", "2026-02-03"),
    ({"depart_from": "2026-02-05", "leg1_to": "2026-02-06"}, "2026-02-05", "2026-02-06"),
    ({"leg1_from": "2026-02-02", "depart_from": "2026-02-05", "depart_to": "2026-02-08"}, "2026-02-02", "2026-02-08"),
]


@query(SHOP + " SELECT * FROM (" + " UNION ALL ".join(f"SELECT CAST({k} AS BIGINT) AS options, pos FROM first WHERE day BETWEEN '{a}' AND '{b}'" for k, (_, a, b) in enumerate(PRECEDENCE)) + ")")
def date_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First legs under options of which some override or stand in for others."""
    flights = shop_flights(spark, sf_dir).leg1
    return collection.union_all([legs.first_legs(flights, *Options(**o).first_range()).select(F.lit(k).cast("long").alias("options"), "pos") for k, (o, _, _) in enumerate(PRECEDENCE)])


# --- fares


def recorded(spark: SparkSession, sf_dir: str) -> str:
    """Answers, as files, to requests from HUB to all nations' codes on two days: the nation's customers are flights.

    N0 has flights on the first day only. N3's answers are no JSON, N4 has none.
    """
    at, days = shared_path(spark, "answers"), F.array(F.lit("2026-02-19"), F.lit("2026-02-20"))
    code = F.concat(F.lit("N"), "c_nationkey")
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_nationkey <> 4").withColumn("day", F.explode(days)).where("c_nationkey > 0 or day = '2026-02-19'")
    flight = F.to_json(F.struct(F.lit("HUB").alias("origin"), code.alias("destination"), F.col("c_acctbal").alias("price"), F.col("c_custkey").alias("flight_number")))
    named = rows.select(F.concat(F.lit("HUB-"), code, F.lit("-"), "day", F.lit(".json")).alias("file"), "c_custkey", F.when(F.col("c_nationkey") == 3, "{").otherwise(flight).alias("flight"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = located(at)
        system.create_dir(folder, recursive=True)
        out, current = None, None
        for batch in batches:
            for file, text in zip(batch.column("file").to_pylist(), batch.column("flight").to_pylist(), strict=True):
                if file != current:
                    if out:
                        out.write(b"]}")
                        out.close()
                    out, current = system.open_output_stream(f"{folder}/{file}"), file
                    out.write(b'{"data": [' + text.encode())
                else:
                    out.write(b",\n" + text.encode())
            yield batch.select(["file"]).slice(0, 0)
        if out:
            out.write(b"]}")
            out.close()

    ship(spark)
    named.repartition("file").sortWithinPartitions("file", "c_custkey").select("file", "flight").mapInArrow(write, "file string").count()
    return at


def asked(spark: SparkSession) -> DataFrame:
    return collection.requests(spark, "HUB", None, ("2026-02-19", "2026-02-20"), None, STOPS)


STOPS = [f"N{k}" for k in range(25)]
#: An answer has a thousand flights at most, unless asked otherwise.
ANSWERS = """WITH d AS (SELECT unnest(['2026-02-19', '2026-02-20']) AS day), f AS (
  SELECT c_custkey, c_nationkey, c_acctbal, day, row_number() OVER (PARTITION BY c_nationkey, day ORDER BY c_custkey) AS place
  FROM customer, d WHERE c_nationkey NOT IN (3, 4) AND (day = '2026-02-19' OR c_nationkey > 0) QUALIFY place <= 1000)"""


@query(f"{ANSWERS} SELECT 'leg1' AS leg, 'HUB' AS search_origin, 'N' || c_nationkey AS search_destination, day AS search_date, 'N' || c_nationkey AS destination, CAST(c_custkey AS VARCHAR) AS flight_number, c_acctbal AS price FROM f WHERE place <= 4")
def recorded_fares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with what was asked for beside each flight, four flights of each at most; failed requests give none."""
    found = collection.fetched(asked(spark), recorded=recorded(spark, sf_dir), errors="empty", limit="4")
    return found.select("leg", "search_origin", "search_destination", "search_date", "destination", "flight_number", "price")


@query(f"{ANSWERS}, s AS (SELECT unnest(range(25)) AS k) SELECT 'N' || k AS destination, d.day AS date, count(c_custkey) AS flights FROM s CROSS JOIN d LEFT JOIN f ON c_nationkey = k AND f.day = d.day GROUP BY k, d.day")
def flights_by_request(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = collection.fetched(asked(spark), recorded=recorded(spark, sf_dir), errors="empty")
    return request_counts(asked(spark), found).select("destination", "date", "flights")


@query(f"{ANSWERS} SELECT 'HUB' AS origin, string_agg(DISTINCT 'N' || c_nationkey, ',' ORDER BY 'N' || c_nationkey) AS stops, count(*) AS total_flights, true AS dated, CAST(0 AS BIGINT) AS leg2 FROM f")
def collected_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A collection whose second leg is left out, as its days are reversed."""
    found = collect(spark, "HUB", "END", ("2026-02-19", "2026-02-20"), ("2026-02-22", "2026-02-21"), STOPS, recorded=recorded(spark, sf_dir), errors="empty")
    stops = collection.discovered(found.leg1).first().intermediate_airports
    return found.metadata.select("origin", F.lit(",".join(stops)).alias("stops"), "total_flights", F.col("collected_at").rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{6}$").alias("dated"), F.lit(found.leg2.count()).alias("leg2"))


@query("WITH n AS (SELECT count(*) AS n FROM customer) SELECT asked, CAST(leg1 * n AS BIGINT) AS leg1, CAST(leg2 * n AS BIGINT) AS leg2 FROM n, (VALUES ('both', 2, 3), ('no destination', 2, 0), ('no days', 2, 0), ('reversed second days', 2, 0), ('reversed first days', 0, 0)) AS t(asked, leg1, leg2)")
def second_leg_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many requests there are by way of each customer's town, with and without what second legs need; reversed first days are an error and ask nothing."""
    two, three = ("2026-02-19", "2026-02-20"), ("2026-02-21", "2026-02-23")
    towns = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.concat(F.lit("T"), "c_custkey").alias("town"))
    rows = []
    for name, destination, days1, days2 in (("both", "END", two, three), ("no destination", None, two, three), ("no days", "END", two, None), ("reversed second days", "END", two, three[::-1]), ("reversed first days", "END", two[::-1], three)):
        try:
            found = collection.requests(spark, "HUB", destination, days1, days2, towns)
        except ValueError:
            found = spark.createDataFrame([], "leg string")
        rows.append(found.agg(F.lit(name).alias("asked"), F.count_if(F.col("leg") == "leg1").alias("leg1"), F.count_if(F.col("leg") == "leg2").alias("leg2")))
    return collection.union_all(rows)


@query("SELECT 'secret' AS token, '' AS without")
def fares_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token is read from the environment when the source is used, under the name that an option gives."""
    os.environ["TERNWAY_QUERY_TOKEN"] = "secret"
    return literals(spark, f"('{FaresReader({'token_env': 'TERNWAY_QUERY_TOKEN'}).token}', '{FaresReader({}).token}')", "token, without")


# --- airports and networks


@query("SELECT 'N' || n_nationkey AS iata_code, 'NA' AS iso_country FROM nation WHERE n_nationkey % 3 > 0")
def airports_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Airports from a CSV file: those with a code and coordinates; NA is a country."""
    path, key = shared_path(spark, "airports"), F.col("pos")
    rows = queries.nation_airports(spark, sf_dir).withColumns({"iata_code": F.when(key % 3 > 0, F.col("iata_code")), "iso_country": F.lit("NA")})
    rows.drop("pos").write.option("header", True).csv(path)
    return read_airports(spark, path, "csv").select("iata_code", "iso_country")


@query(f"WITH {queries.NATIONS} SELECT src, dst, km AS distance_km FROM near")
def network_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A network written as a JSON document and read again."""
    path = f"{shared_path(spark, 'network')}.json"
    documents.save_network(queries.nations(spark, sf_dir), path)
    return read_network(spark, path).edges.select("src", "dst", "distance_km")


@query(f"WITH {queries.NATIONS} SELECT 'asked' AS source, src, dst, km AS distance_km FROM near UNION ALL SELECT 'kept', src, dst, km FROM near")
def network_built_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A network that isn't there is built from airports and kept; the second time it is read. Without airports there is none."""
    path = shared_path(spark, "network")
    if network_at(spark, path) is not None:
        raise AssertionError("a network without a file")
    asked_for = network_at(spark, path, lambda: queries.nation_airports(spark, sf_dir))
    kept = network_at(spark, path)
    both = [n.edges.select(F.lit(name).alias("source"), "src", "dst", "distance_km") for name, n in (("asked", asked_for), ("kept", kept))]
    return both[0].unionByName(both[1])


@query(f"WITH {queries.NATIONS}, r AS (SELECT src, dst, km, row_number() OVER (PARTITION BY src ORDER BY km, dst) AS place FROM near), s AS (SELECT src, string_agg(dst || ' ' || printf('%.2f', km), ', ' ORDER BY place) AS near FROM r WHERE place <= 3 GROUP BY src) SELECT iata, n_name AS municipality, s.near FROM n JOIN s ON src = iata WHERE k < 5")
def network_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the first five airports those with neighbours, and three of these."""
    rows = network.examples(queries.nations(spark, sf_dir))
    near = F.array_join(F.transform("nearby_airports", lambda n: F.concat(n.iata, F.lit(" "), F.format_string("%.2f", n.distance_km))), ", ")
    return rows.select("iata", "municipality", near.alias("near"))


# --- results and the command line

CHEAP = f"{SHOP}, j AS (SELECT f.pos AS pos1, s.pos AS pos2, city, f.price + s.price AS total, CAST(floor((epoch(CAST(s.day || ' 10:00:00' AS TIMESTAMP)) - epoch(CAST(f.day || ' 14:00:00' AS TIMESTAMP))) / 86400) AS BIGINT) AS stay_days FROM first f JOIN second s ON city = origin)"


@query(f"{CHEAP} SELECT round(total, 2) AS total_price, stay_days, city AS intermediate_city, 'SU' AS airline FROM j WHERE stay_days BETWEEN 1 AND 5")
def result_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The command line's search, whose result document is read again: it lists all journeys."""
    flights, out = saved(spark, sf_dir), shared_path(spark, "result")
    if cli.main(["search", flights, "--max-stay", "5", "--disable-airport-transfers", "--output", out]):
        raise AssertionError("the search failed")
    rows = read_journeys(spark, out, "total_price double, stay_days long, intermediate_city string, leg1 struct<airline:string>")
    return rows.select(F.round("total_price", 2).alias("total_price"), "stay_days", "intermediate_city", F.col("leg1.airline").alias("airline"))


@query(f"{CHEAP}, k AS (SELECT * FROM j WHERE stay_days BETWEEN 1 AND 30), c AS (SELECT count(DISTINCT city) AS n FROM k) SELECT n AS cities, least(10, n) AS listed, least(1000, n) AS all_listed, (SELECT count(*) FROM k) AS journeys FROM c")
def report_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many journeys a report lists: `top` or as many as there are."""
    flights = shop_flights(spark, sf_dir)
    few, many = (search(flights, None, Options(top=n, unique_cities=True)) for n in (10, 1000))
    return few.cities.agg(F.count("*").alias("cities")).join(few.top.agg(F.count("*").alias("listed"))).join(many.top.agg(F.count("*").alias("all_listed"))).join(few.statistics.select(F.col("total_combinations").alias("journeys")))


@query(f"{ANSWERS}, {queries.NATIONS} SELECT 'collect' AS task, count(*) AS n FROM f UNION ALL SELECT 'network', count(*) FROM near UNION ALL SELECT 'search', CAST(0 AS BIGINT)")
def command_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All three tasks of the command line, and how many flights, neighbours and journeys their documents hold."""
    at = shared_path(spark, "tasks")
    airports, flights, near, result = shared_path(spark, "airports"), f"{at}/f.json", f"{at}/n.json", f"{at}/r.json"
    queries.nation_airports(spark, sf_dir).drop("pos").write.parquet(airports)
    tasks = [
        ["collect", "HUB", "--leg1-dates", "2026-02-19", "2026-02-20", "--intermediate", *STOPS, "--recorded", recorded(spark, sf_dir), "--output", flights],
        ["network", airports, "--output", near],
        ["search", flights, "--airport-network", near, "--output", result],
    ]
    if any(cli.main(t) for t in tasks):
        raise AssertionError("a task failed")
    counts = [
        read_flight_file(spark, flights).leg1.agg(F.lit("collect").alias("task"), F.count("*").alias("n")),
        read_network(spark, near).edges.agg(F.lit("network").alias("task"), F.count("*").alias("n")),
        spark.read.schema("statistics struct<total_combinations:long>").option("multiLine", True).json(result).select(F.lit("search").alias("task"), F.col("statistics.total_combinations").alias("n")),
    ]
    return collection.union_all(counts)

"""The registered queries of the journey engine and the SQL they must agree with.

The driver's tables stand in for flights and airports: all line items with their suppliers'
nations are first legs, all orders with their customers' nations second legs, embeddings and
nations airports.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ternway.functions import geo, times, values
from ternway.operators import collection, journeys, legs, network
from ternway.operators.meeting import Meeting
from ternway.plans.search import Options
from ternway.sinks import documents
from ternway.sources.files import Network, parse_journeys, parse_network

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


# --- the driver's tables as flights and airports


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text(ts: str) -> F.Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


def _no_texts() -> list[F.Column]:
    return [F.lit(None).cast("string").alias(c) for c in ("airline", "flight_number", "link", "search_date")]


def _line() -> F.Column:
    """A number for each line item; order and line number alone are not unique."""
    place = F.col("l_orderkey")
    for column, size in (("l_linenumber", 8), ("l_partkey", 1 << 15), ("l_suppkey", 1 << 10), ("l_quantity", 64)):
        place = place * size + F.col(column).cast("long")
    return place


LINE = "((((l_orderkey * 8 + l_linenumber) * 32768 + l_partkey) * 1024 + l_suppkey) * 64 + CAST(l_quantity AS BIGINT))"


def flights1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem").join(_table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.select(
        _line().alias("pos"),
        F.lit("HUB").alias("origin"),
        F.lit("").alias("destination"),
        _text("l_shipdate").alias("departure_at"),
        F.lit(None).cast("string").alias("arrival_at"),
        (F.col("l_quantity") * 30).cast("double").alias("duration"),
        F.col("l_extendedprice").alias("price"),
        F.lit(None).cast("double").alias("value"),
        F.lit("leg1").alias("leg"),
        F.lit("HUB").alias("search_origin"),
        F.concat(F.lit("N"), F.col("s_nationkey")).alias("search_destination"),
        *_no_texts(),
    )


def flights2(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "orders").join(_table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.select(
        F.col("o_orderkey").alias("pos"),
        F.concat(F.lit("N"), F.col("c_nationkey")).alias("origin"),
        F.lit("END").alias("destination"),
        _text("o_orderdate").alias("departure_at"),
        F.lit(None).cast("string").alias("arrival_at"),
        F.lit(None).cast("double").alias("duration"),
        F.lit(0.0).alias("price"),
        F.col("o_totalprice").alias("value"),
        F.lit("leg2").alias("leg"),
        F.lit(None).cast("string").alias("search_origin"),
        F.lit("END").alias("search_destination"),
        *_no_texts(),
    )


def airports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Airports from embeddings: codes A and vec_id, places from the first two numbers."""
    at = lambda k, by: (F.col("embedding")[k].cast("double") * by).cast("string")
    return _table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("pos"),
        F.concat(F.lit("A"), F.col("vec_id")).alias("iata_code"),
        F.concat(at(0, 90), F.lit(", "), at(1, 180)).alias("coordinates"),
        F.concat(F.lit("Airport "), F.col("vec_id")).alias("name"),
        F.concat(F.lit("Town "), F.col("vec_id")).alias("municipality"),
        F.col("label").cast("string").alias("iso_country"),
    )


def nation_airports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """25 airports from nations, on a line, five to a country."""
    key = F.col("n_nationkey")
    return _table(spark, sf_dir, "nation").select(
        key.cast("long").alias("pos"),
        F.concat(F.lit("N"), key).alias("iata_code"),
        F.concat((key * F.lit(0.3)).cast("string"), F.lit(", "), (key * F.lit(0.2)).cast("string")).alias("coordinates"),
        F.col("n_name").alias("name"),
        F.col("n_name").alias("municipality"),
        F.floor(key / 5).cast("string").alias("iso_country"),
    )


def nations(spark: SparkSession, sf_dir: str) -> Network:
    return network.build_network(nation_airports(spark, sf_dir))


def meeting(spark: SparkSession, sf_dir: str, network: Network | None = None, **o: object) -> Meeting:
    """All first and second legs; without a network they meet in the city itself."""
    options = Options(**o)
    first = legs.first_legs(flights1(spark, sf_dir), *options.first_range(), via=options.via)
    second = legs.second_legs(flights2(spark, sf_dir), *options.second_range())
    return Meeting(first, second, network, options.min_stay, options.max_stay)


def exact(spark: SparkSession, sf_dir: str, **o: object) -> DataFrame:
    return meeting(spark, sf_dir, **o).journeys


def flat(rows: DataFrame) -> DataFrame:
    return rows.select("leg1_pos", "leg2_pos", "intermediate_city", "stay_days", values.cents(F.col("total_price")).alias("total_price"))


LEGS = f"""
WITH leg1 AS (
  SELECT {LINE} AS pos1, 'N' || s_nationkey AS city, strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S') AS dep1,
    l_shipdate + to_minutes(CAST(l_quantity * 30 AS INTEGER)) AS arr, l_extendedprice AS price1, l_quantity * 30 AS minutes
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
), leg2 AS (
  SELECT o_orderkey AS pos2, 'N' || c_nationkey AS origin, o_orderdate AS dep2, o_totalprice AS price2
  FROM orders JOIN customer ON o_custkey = c_custkey
)"""


def pairs(low: int = 1, high: int = 30, where: str = "true", legs: str = "leg1 JOIN leg2 ON city = origin") -> str:
    return f"""{LEGS}, pairs AS (
  SELECT *, CAST(floor((epoch_us(dep2) - epoch_us(arr)) / 86400000000.0) AS BIGINT) AS stay_days, price1 + price2 AS total
  FROM {legs} WHERE {where}
), j AS (SELECT * FROM pairs WHERE stay_days BETWEEN {low} AND {high})
"""


FLAT = "SELECT pos1 AS leg1_pos, pos2 AS leg2_pos, city AS intermediate_city, stay_days, round(total, 2) AS total_price FROM j"
STATS = "count(*) AS total_combinations, coalesce(min(total), 0) AS min_price, coalesce(max(total), 0) AS max_price, coalesce(round(avg(total), 2), 0) AS avg_price, coalesce(percentile_disc(0.5) WITHIN GROUP (ORDER BY total DESC), 0) AS median_price"


def literals(spark: SparkSession, sql_values: str, names: str) -> DataFrame:
    return spark.sql(f"SELECT * FROM VALUES {sql_values} AS t({names})")


# --- scans and generators


@query(f"{LEGS} SELECT pos1 AS pos, city, dep1 AS departure_at, strftime(arr, '%Y-%m-%dT%H:%M:%S') AS arrival_at, price1 AS price, minutes AS duration FROM leg1")
def scan_leg1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return legs.first_legs(flights1(spark, sf_dir)).select("pos", "city", "leg.departure_at", "leg.arrival_at", "leg.price", "leg.duration")


@query(f"{LEGS} SELECT pos2 AS pos, origin, strftime(dep2, '%Y-%m-%dT%H:%M:%S') AS departure_at, price2 AS price FROM leg2")
def scan_leg2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return legs.second_legs(flights2(spark, sf_dir)).select("pos", "origin", "leg.departure_at", "leg.price")


@query("SELECT o_orderkey AS pos, strftime(o_orderdate + to_days(CAST(k AS INTEGER)), '%Y-%m-%d') AS day FROM orders, LATERAL (SELECT unnest(range(o_orderkey % 5)) AS k)")
def date_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All days from an order's on: as many as its key says, none for a reversed range."""
    first = F.col("o_orderdate").cast("date")
    days = times.days(first, F.date_add(first, (F.col("o_orderkey") % 5 - 1).cast("int")))
    return _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pos"), F.explode(days).alias("day")).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


REQUESTS_SQL = """
WITH s AS (SELECT 'T' || c_custkey AS stop FROM customer),
d1 AS (SELECT strftime(d, '%Y-%m-%d') AS day FROM generate_series(TIMESTAMP '2026-02-19', TIMESTAMP '2026-02-24', INTERVAL 1 DAY) AS t(d)),
d2 AS (SELECT strftime(d, '%Y-%m-%d') AS day FROM generate_series(TIMESTAMP '2026-02-25', TIMESTAMP '2026-03-05', INTERVAL 1 DAY) AS t(d))
SELECT 'leg1' AS leg, 'MOW' AS origin, stop AS destination, day AS date FROM s, d1
UNION ALL SELECT 'leg2', stop, 'BKK', day FROM s, d2
"""


@query(REQUESTS_SQL)
def route_date_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests by way of each customer's town, which stand in a table."""
    towns = _table(spark, sf_dir, "customer").select(F.concat(F.lit("T"), "c_custkey").alias("town"))
    return collection.requests(spark, "MOW", "BKK", ("2026-02-19", "2026-02-24"), ("2026-02-25", "2026-03-05"), towns)


@query("WITH d AS (SELECT min(o_orderdate)::DATE AS a, max(o_orderdate)::DATE AS b FROM orders), n AS (SELECT b - a + 1 AS n FROM d) SELECT 2 * n AS requests, n AS leg1, n AS leg2 FROM n")
def request_counts_auto(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests to and from anywhere for all days from the first order's to the last one's."""
    a, b = _table(spark, sf_dir, "orders").agg(*[F.date_format(f("o_orderdate"), "yyyy-MM-dd") for f in (F.min, F.max)]).first()
    asked = collection.requests(spark, "MOW", "BKK", (a, b), (a, b))
    return asked.agg(F.count("*").alias("requests"), F.count_if(F.col("leg") == "leg1").alias("leg1"), F.count_if(F.col("leg") == "leg2").alias("leg2"))


# --- filters


def _dates(low: str | None, high: str | None) -> Query:
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        return legs.first_legs(flights1(spark, sf_dir), low, high).select("pos", "city", "leg.departure_at")

    return f


for _name, _low, _high in (("from", "1997-06-01", None), ("to", None, "1996-03-31"), ("both", "1996-01-15", "1996-02-15"), ("exact", "1996-02-19", "1996-02-19")):
    QUERIES[f"leg_date_filter_{_name}"] = _dates(_low, _high)
    SQL[f"leg_date_filter_{_name}"] = f"{LEGS} SELECT pos1 AS pos, city, dep1 AS departure_at FROM leg1 WHERE substr(dep1, 1, 10) BETWEEN '{_low or '0'}' AND '{_high or '9'}'"


@query(f"{pairs(where="city = 'N7'")} {FLAT}")
def via_city(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(exact(spark, sf_dir, via="N7"))


# --- scalar functions


@query(f"{LEGS} SELECT pos1 AS pos, strftime(arr, '%Y-%m-%dT%H:%M:%S') AS arrival FROM leg1")
def arrival_calc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flights1(spark, sf_dir).select("pos", times.arrival_text(F.col("departure_at"), F.col("duration")).alias("arrival"))


@query("SELECT o_orderkey AS pos, CAST(floor((epoch_us(o_orderdate) - epoch_us(TIMESTAMP '1998-01-01 11:00:00')) / 86400000000.0) AS BIGINT) AS stay_days FROM orders")
def stay_days_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pos"), times.stay_days(F.lit("1998-01-01T11:00:00"), _text("o_orderdate")).alias("stay_days"))


def chosen(key: str, forms: list[F.Column]) -> F.Column:
    """One of the forms for each row, by a key modulo their number."""
    out = F.lit(None)
    for k, form in enumerate(forms):
        out = F.when(F.col(key) % len(forms) == k, form).otherwise(out)
    return out


ORDERED = "CAST(floor(epoch(o_orderdate)) AS BIGINT)"


@query(f"""SELECT o_orderkey AS id, CASE WHEN k <= 5 THEN {ORDERED} WHEN k = 6 THEN CAST(epoch(CAST(o_orderdate AS DATE)) AS BIGINT) END AS sec, k = 2 AS aware
FROM (SELECT *, o_orderkey % 10 AS k FROM orders)""")
def parse_datetime_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dates of all orders in all forms that are read, and in some that aren't."""
    at, day = _text("o_orderdate"), F.date_format("o_orderdate", "yyyy-MM-dd")
    with_mark = lambda mark: F.concat(at, F.lit(mark))
    forms = [with_mark("+03:00"), with_mark("-03:00"), with_mark("Z"), at, F.replace(at, F.lit("T"), F.lit(" ")), F.date_format("o_orderdate", "yyyy-M-d'T'H:m:s"), day, with_mark(".5"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm"), F.concat(F.lit("soon "), day)]
    rows = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), times.parsed(chosen("o_orderkey", forms)).alias("at"))
    return rows.select("id", "at.sec", "at.aware")


@query(f"""SELECT o_orderkey AS id, CAST(CASE WHEN k IN (0, 2) THEN floor(({ORDERED} - epoch(TIMESTAMP '1998-01-01 11:00:00')) / 86400) WHEN k IN (1, 3) THEN date_diff('day', DATE '1998-01-01', CAST(o_orderdate AS DATE))
WHEN k = 4 THEN 0 ELSE floor((epoch(CAST(o_orderdate AS DATE)) - epoch(TIMESTAMP '1998-01-01 11:00:00')) / 86400) END AS BIGINT) AS days FROM (SELECT *, o_orderkey % 6 AS k FROM orders)""")
def stay_fallbacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stays up to all orders' dates: by times, by dates where one is marked Z or has no seconds, 0 where nothing is known."""
    at, day, since = _text("o_orderdate"), F.date_format("o_orderdate", "yyyy-MM-dd"), "1998-01-01T11:00:00"
    arrivals = [F.lit(x) for x in (since, f"{since}Z", f"{since}Z", since[:16], "never", since)]
    departures = [at, at, F.concat(at, F.lit("Z")), at, at, day]
    return _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), times.stay_days(chosen("o_orderkey", arrivals), chosen("o_orderkey", departures)).alias("days"))


@query("""SELECT id, CASE WHEN p IS NOT NULL AND p <> 0 THEN p ELSE coalesce(v, 0) END AS price, CASE WHEN a <> '' THEN a ELSE b END AS city FROM (
  SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 0.0::DOUBLE WHEN 1 THEN NULL ELSE c_acctbal END AS p, CASE c_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 0.0::DOUBLE ELSE 7.5::DOUBLE END AS v,
    CASE c_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE c_mktsegment END AS a, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS b FROM customer)""")
def falsy_coalesce_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices and cities of which some are absent, zero or empty, for all customers."""
    none, zero = F.lit(None).cast("double"), F.lit(0.0)
    price = values.price_of(chosen("c_custkey", [zero, none, F.col("c_acctbal"), F.col("c_acctbal")]), chosen("c_custkey", [none, zero, F.lit(7.5)]))
    segment = F.col("c_mktsegment")
    city = values.text_or(chosen("c_custkey", [F.lit(""), F.lit(None).cast("string"), segment, segment, segment]), chosen("c_custkey", [F.col("c_name"), F.lit(None).cast("string")]))
    return _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), price.alias("price"), city.alias("city"))


@query("SELECT s_suppkey AS id, CASE WHEN s_suppkey % 6 IN (0, 1, 4) THEN s_acctbal END AS lat, CASE WHEN s_suppkey % 6 IN (0, 1, 4) THEN s_suppkey * 0.5::DOUBLE END AS lon FROM supplier")
def parse_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two numbers of each supplier as coordinates, some with blanks, a third part, a missing one, or what is no number."""
    x, y = F.col("s_acctbal").cast("string"), (F.col("s_suppkey") * F.lit(0.5)).cast("string")
    part = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    forms = [part(x, ", ", y), part(" ", x, " ,", y), x, part(x, ", north"), part(x, ",", y, ",3"), part(x, "d, ", y)]
    return _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), geo.located(chosen("s_suppkey", forms)).alias("at")).select("id", "at.lat", "at.lon")


PLACES = "SELECT vec_id, CAST(embedding[1] AS DOUBLE) * 90 AS lat, CAST(embedding[2] AS DOUBLE) * 180 AS lon, label FROM embeddings"
KM = "2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(y.lat - x.lat) / 2), 2) + cos(radians(x.lat)) * cos(radians(y.lat)) * pow(sin(radians(y.lon - x.lon) / 2), 2))))"
EDGES = f"WITH p AS ({PLACES}), e AS (SELECT x.vec_id AS a, y.vec_id AS b, x.label AS la, y.label AS lb, {KM} AS km FROM p x JOIN p y ON x.vec_id <> y.vec_id AND {KM} <= 100)"


@query(f"WITH p AS ({PLACES}) SELECT x.vec_id AS a, y.vec_id AS b, round({KM}, 2) AS km FROM p x JOIN p y ON y.vec_id = x.vec_id + 1")
def haversine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = airports(spark, sf_dir).select("pos", geo.located(F.col("coordinates")).alias("at"))
    x, y = rows.alias("x"), rows.alias("y")
    km = geo.distance_km(F.col("x.at.lat"), F.col("x.at.lon"), F.col("y.at.lat"), F.col("y.at.lon"))
    return x.join(y, F.col("y.pos") == F.col("x.pos") + 1).select(F.col("x.pos").alias("a"), F.col("y.pos").alias("b"), F.round(km, 2).alias("km"))


@query("""SELECT c_custkey AS id, format('{:,}', CAST(round_even(abs(c_acctbal), 0) AS BIGINT)) AS a, printf('%.2f', c_acctbal) AS b,
CASE WHEN c_custkey % 200 = 0 THEN '' ELSE (c_custkey % 200) // 60 || 'ч ' || (c_custkey % 200) % 60 || 'м' END AS c,
CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE c_name || ' (' || c_mktsegment || ')' END AS d FROM customer""")
def format_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a report shows of numbers, durations and names, for all customers."""
    city = F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).otherwise(F.when(F.col("c_custkey") % 2 == 0, ""))
    minutes = (F.col("c_custkey") % 200).cast("double")
    shown = {"a": values.thousands(F.abs("c_acctbal")), "b": values.two_places(F.col("c_acctbal")), "c": values.hours_minutes(minutes), "d": values.labelled(F.col("c_name"), city)}
    return _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), *[c.alias(k) for k, c in shown.items()])


# --- the network


@query(f"{EDGES} SELECT 'A' || a AS src, 'A' || b AS dst, round(km, 2) AS distance_km FROM e")
def airport_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.build_network(airports(spark, sf_dir)).edges.select("src", "dst", "distance_km")


@query(f"""{EDGES}, n AS (SELECT 'A' || a AS iata, string_agg('A' || b || ' ' || printf('%.2f', round(km, 2)), ', ' ORDER BY round(km, 2), b) AS near FROM e GROUP BY a)
SELECT 'A' || vec_id AS iata, CAST(label AS VARCHAR) AS country, coalesce(near, '') AS near FROM p LEFT JOIN n ON iata = 'A' || vec_id""")
def airport_network_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = network.nested(network.build_network(airports(spark, sf_dir)))
    near = F.array_join(F.transform("nearby_airports", lambda n: F.concat(n.iata, F.lit(" "), F.format_string("%.2f", n.distance_km))), ", ")
    return rows.select("iata", "country", near.alias("near"))


@query(f"{EDGES} SELECT (SELECT count(*) FROM p) AS airports, count(*) AS connections, round(count(*) / (SELECT count(*) FROM p), 2) AS average_neighbours FROM e")
def network_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.statistics(network.build_network(airports(spark, sf_dir)))


NATIONS = f"""n AS (SELECT n_nationkey AS k, 'N' || n_nationkey AS iata, n_name, n_nationkey * 0.3::DOUBLE AS lat, n_nationkey * 0.2::DOUBLE AS lon, n_nationkey // 5 AS country FROM nation),
near AS (SELECT x.iata AS src, y.iata AS dst, x.n_name AS src_name, y.n_name AS dst_name, x.country AS c1, y.country AS c2, round({KM}, 2) AS km FROM n x JOIN n y ON x.k <> y.k AND {KM} <= 100)"""


def _nearby(**o: object) -> Query:
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        cities = _table(spark, sf_dir, "supplier").select(F.concat(F.lit("N"), F.col("s_nationkey")).alias("city")).unionByName(spark.createDataFrame([("XXX",), (None,)], "city string"))
        return network.allowed_airports(cities, nations(spark, sf_dir), **o)

    return f


for _name, _o, _where in (("same_country", {}, "c1 = c2"), ("cross_country", {"same_country": False}, "true"), ("radius", {"same_country": False, "max_km": 50.0}, "km <= 50")):
    QUERIES[f"nearby_expand_{_name}"] = _nearby(**_o)
    SQL[f"nearby_expand_{_name}"] = f"WITH {NATIONS}, s AS (SELECT DISTINCT 'N' || s_nationkey AS city FROM supplier UNION SELECT 'XXX') SELECT city, city AS airport FROM s UNION SELECT city, dst FROM s JOIN near ON src = city WHERE {_where}"


@query("SELECT s_suppkey, 'N' || s_nationkey AS iata, n_name AS city_name FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey UNION ALL SELECT -1, 'XXX', ''")
def city_name_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = _table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("N"), F.col("s_nationkey")).alias("iata")).unionByName(spark.createDataFrame([(-1, "XXX")], "s_suppkey long, iata string"))
    return network.city_names(codes, nations(spark, sf_dir)).select("s_suppkey", "iata", "city_name")


@query("SELECT 'R' || n_regionkey AS iata, max_by(n_name, n_nationkey) AS name, CAST(min(n_nationkey) AS BIGINT) AS pos FROM nation WHERE n_nationkey % 7 <> 3 GROUP BY n_regionkey")
def upsert_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations of a region are airports of one code; some have coordinates that don't parse."""
    rows = nation_airports(spark, sf_dir).join(_table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), "n_regionkey"), "name")
    rows = rows.withColumn("iata_code", F.concat(F.lit("R"), F.col("n_regionkey"))).withColumn("coordinates", F.when(F.col("pos") % 7 == 3, "none").otherwise(F.col("coordinates")))
    return network.upserted(rows).select("iata", "name", "pos")


# --- journeys


@query(f"{pairs()} {FLAT}")
def combinations_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of one airport whose stay is exact, met by airport and days; the join by airport alone, of which these are a small part, is what tests compare it with."""
    m = meeting(spark, sf_dir)
    return flat(journeys.journeys(m.first, m.second, None, m.min_stay, m.max_stay))


@query(f"{pairs()} {FLAT}")
def combinations_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(exact(spark, sf_dir))


@query(f"{pairs(-5, 5)} {FLAT}")
def combinations_negative_stay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(exact(spark, sf_dir, min_stay=-5, max_stay=5))


ALLOWED = "(SELECT iata AS stop, iata AS airport FROM n UNION SELECT src, dst FROM near WHERE c1 = c2)"
TRANSFERS = pairs(1, 7, legs=f"leg1 JOIN {ALLOWED} ON stop = city JOIN leg2 ON airport = origin").replace("WITH leg1", f"WITH {NATIONS}, leg1", 1)


@query(f"""{TRANSFERS}
SELECT pos1 AS leg1_pos, pos2 AS leg2_pos, city AS intermediate_city, stay_days, round(total, 2) AS total_price, city <> origin AS transferred,
  CASE WHEN city <> origin THEN src_name END AS from_city, CASE WHEN city <> origin THEN origin END AS to_airport, CASE WHEN city <> origin THEN dst_name END AS to_city, CASE WHEN city <> origin THEN km END AS distance_km
FROM j LEFT JOIN near ON src = city AND dst = origin""")
def combinations_transfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = meeting(spark, sf_dir, nations(spark, sf_dir), max_stay=7).journeys
    t = F.col("airport_transfer")
    return found.select(
        "leg1_pos",
        "leg2_pos",
        "intermediate_city",
        "stay_days",
        values.cents(F.col("total_price")).alias("total_price"),
        t.isNotNull().alias("transferred"),
        *[t[c].alias(c) for c in ("from_city", "to_airport", "to_city", "distance_km")],
    )


@query(f"{TRANSFERS} SELECT pos1 AS leg1_pos, count(*) AS n, count(*) FILTER (origin <> city) AS transfers FROM j GROUP BY pos1")
def transfer_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return meeting(spark, sf_dir, nations(spark, sf_dir), max_stay=7).journeys_of_each()


# --- statistics and rankings


@query(f"{pairs()} SELECT {STATS} FROM j")
def price_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return meeting(spark, sf_dir).statistics()


@query(f"{pairs(9000, 9001)} SELECT {STATS} FROM j")
def price_stats_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return meeting(spark, sf_dir, min_stay=9000, max_stay=9001).statistics()


@query(f"{pairs()} SELECT city AS intermediate_city, count(*) AS count, min(total) AS min_price, round(avg(total), 2) AS avg_price FROM j GROUP BY city")
def city_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return meeting(spark, sf_dir).cities()


@query(f"""{pairs()} SELECT city AS intermediate_city, count(*) AS count, min(total) AS min_price, round(avg(total), 2) AS avg_price,
row_number() OVER (ORDER BY min(total), min((pos1, pos2))) AS rank FROM j GROUP BY city""")
def city_stats_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return meeting(spark, sf_dir).cities_ordered()


@query(f"{pairs()} SELECT city AS intermediate_city, {STATS}, CAST(grouping(city) AS BIGINT) AS is_total FROM j GROUP BY GROUPING SETS ((), (city))")
def price_stats_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return meeting(spark, sf_dir).statistics_by_city_and_all()


RANKED = "SELECT row_number() OVER (ORDER BY total, pos1, pos2) AS rank, pos1 AS leg1_pos, pos2 AS leg2_pos, city AS intermediate_city, stay_days, round(total, 2) AS total_price FROM {0}"
FIRST = "u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY city ORDER BY total, pos1, pos2) AS r FROM j) WHERE r = 1)"


def ranked(rows: DataFrame) -> DataFrame:
    return rows.select("rank", "leg1_pos", "leg2_pos", "intermediate_city", "stay_days", values.cents(F.col("total_price")).alias("total_price"))


@query(f"{pairs()} {RANKED.format('j')} ORDER BY total, pos1, pos2 LIMIT 10")
def top_n_cheapest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(meeting(spark, sf_dir).cheapest(10))


@query(f"{pairs()}, {FIRST} SELECT pos1 AS leg1_pos, pos2 AS leg2_pos, city AS intermediate_city, stay_days, round(total, 2) AS total_price FROM u")
def unique_cities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(meeting(spark, sf_dir).cheapest_per_city())


@query(f"{pairs()}, {FIRST} {RANKED.format('u')} ORDER BY total, pos1, pos2 LIMIT 5")
def unique_cities_top_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(meeting(spark, sf_dir).cheapest(5, unique_cities=True))


# --- collection, files and reports


@query("SELECT string_agg(DISTINCT 'N' || c_nationkey, ',' ORDER BY 'N' || c_nationkey) AS airports FROM customer")
def discovered_airports(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "customer").select(F.concat(F.lit("N"), F.col("c_nationkey")).alias("destination")).unionByName(spark.createDataFrame([("",), (None,)], "destination string"))
    return collection.discovered(rows).select(F.array_join("intermediate_airports", ",").alias("airports"))


@query("SELECT n_name AS name, n_regionkey, NULL AS extra FROM nation UNION ALL SELECT r_name, r_regionkey, 'region' FROM region UNION ALL SELECT r_name, r_regionkey, 'region' FROM region")
def union_all_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), "n_regionkey")
    b = _table(spark, sf_dir, "region").select(F.col("r_name").alias("name"), F.col("r_regionkey").alias("n_regionkey"), F.lit("region").alias("extra"))
    return collection.union_all([a, b, b])


@query(f"""{pairs().replace("WITH leg1", f"WITH {NATIONS}, leg1", 1)} SELECT row_number() OVER (ORDER BY total, pos1, pos2) AS rank, format('{{:,}}', CAST(round_even(total, 0) AS BIGINT)) AS total, city || ' (' || n_name || ')' AS stop, stay_days,
'HUB → ' || city || ' (' || n_name || ')' AS leg1_route, dep1 AS leg1_departure, strftime(arr, '%Y-%m-%dT%H:%M:%S') AS leg1_arrival, CASE WHEN minutes = 0 THEN '' ELSE CAST(minutes AS BIGINT) // 60 || 'ч ' || CAST(minutes AS BIGINT) % 60 || 'м' END AS leg1_duration, '' AS leg1_flight,
origin || ' (' || n_name || ') → END' AS leg2_route, strftime(dep2, '%Y-%m-%dT%H:%M:%S') AS leg2_departure, strftime(dep2, '%Y-%m-%dT%H:%M:%S') AS leg2_arrival, '' AS leg2_duration, '' AS leg2_flight, '' AS transfer
FROM j JOIN n ON iata = city ORDER BY 1 LIMIT 10""")
def format_report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents.report_rows(meeting(spark, sf_dir).cheapest(10), nations(spark, sf_dir))
    return rows.drop("leg1_price", "leg2_price", "leg1_airline", "leg2_airline")


@query("SELECT 'T' || c_custkey AS src, 'N' || (c_nationkey + k) AS dst, CASE WHEN (c_custkey + k) % 2 = 0 THEN 0.0 ELSE k * 1.5 END::DOUBLE AS distance_km, k AS pos FROM customer, LATERAL (SELECT unnest(range(c_custkey % 4)) AS k)")
def legacy_network_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Networks as JSON text, one for each customer's town, whose neighbours are bare codes, at distance 0, beside objects."""
    rows = _table(spark, sf_dir, "customer")
    code = lambda k: F.concat(F.lit("N"), F.col("c_nationkey") + k)
    bare = lambda k: F.concat(F.lit('"'), code(k), F.lit('"'))
    near = lambda k: F.when((F.col("c_custkey") + k) % 2 == 0, bare(k)).otherwise(F.to_json(F.struct(code(k).alias("iata"), (k * 1.5).alias("distance_km"))))
    places = F.filter(F.sequence(F.lit(0), F.lit(3)), lambda k: k < F.col("c_custkey") % 4)
    text = F.concat(F.lit('{"T'), "c_custkey", F.lit('": {"name": "'), "c_name", F.lit('", "nearby_airports": ['), F.array_join(F.transform(places, near), ", "), F.lit("]}}"))
    return parse_network(rows.select(text.alias("value"))).edges


@query(f"{pairs()} SELECT pos1 AS leg1_pos, pos2 AS leg2_pos, total AS total_price, city AS destination FROM j")
def journey_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Journeys written as JSON text and parsed again."""
    m = meeting(spark, sf_dir)
    first, second = (documents.with_texts(x.withColumn("leg", F.col("leg").withField("link", F.col("pos").cast("string")))) for x in (m.first, m.second))
    rows = journeys.journeys(first, second, None, m.min_stay, m.max_stay)
    back = parse_journeys(documents.journey_json(rows), "total_price double, leg1 struct<link:string,destination:string>, leg2 struct<link:string>")
    return back.select(F.col("leg1.link").cast("long").alias("leg1_pos"), F.col("leg2.link").cast("long").alias("leg2_pos"), "total_price", "leg1.destination")

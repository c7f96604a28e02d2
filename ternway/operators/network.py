"""The network of airports within a distance of each other."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ternway.functions import geo
from ternway.functions.values import present
from ternway.sources.files import Network


def upserted(airports: DataFrame) -> DataFrame:
    """One row for each code, lat and lon added: the last whose coordinates parse wins, its place is that of the first."""
    rows = airports.where(present(F.col("iata_code")).isNotNull() & present(F.col("coordinates")).isNotNull())
    rows = rows.withColumn("at", geo.located(F.col("coordinates"))).where("at.lat is not null")
    last = F.max_by(F.struct("name", "municipality", F.col("iso_country").alias("country"), "coordinates", "at"), "pos").alias("last")
    return rows.groupBy(F.col("iata_code").alias("iata")).agg(last, F.min("pos").alias("pos")).select("iata", "last.name", "last.municipality", "last.country", "last.coordinates", "last.at.lat", "last.at.lon", "pos")


def _cells(band: Column, height: float, max_km: float) -> Column:
    """Into how many cells of equal longitude a band of latitude is cut, so that no two places max_km apart are further away than the next cell.

    Places of the band may be near places of the bands beside it, so the latitude nearest to a
    pole of all three counts. Where it comes too near the pole the band is one cell.
    """
    highest = F.greatest(F.abs(band - 1), F.abs(band + 2)) * height
    reach = math.sin(min(max(max_km, 0.0) / geo.RADIUS_KM / 2, math.pi / 2))
    part = reach / F.cos(F.radians(F.least(highest, F.lit(89.999))))
    width = F.degrees(2 * F.asin(F.least(part, F.lit(1.0)))) * 1.0001 + 1e-6
    return F.when((highest >= 89.999) | (part >= 1), F.lit(1)).otherwise(F.greatest(F.floor(360 / width), F.lit(1))).cast("long")


def within_radius(airports: DataFrame, max_km: float) -> DataFrame:
    """(src, dst, distance_km, dst_pos) of all ordered pairs of airports (iata, lat, lon, pos) at most max_km apart.

    Airports are dealt to bands of latitude a little higher than max_km and within them to cells
    of longitude a little wider, fewer towards the poles, around the globe. One side stands in
    its cell; the other looks in its own, the next ones, and those of the bands beside it, so
    each pair meets once. The exact distance decides.
    """
    rows = airports.where(geo.finite(F.col("lat")) & geo.finite(F.col("lon"))).select("iata", "lat", "lon", "pos")
    height = max(max_km, 0.0) / geo.KM_PER_DEGREE * 1.0001 + 1e-6
    band, n = F.floor(F.col("lat") / height), _cells(F.col("band"), height, max_km)
    cell = F.floor(F.pmod(F.col("lon"), F.lit(360.0)) / 360.0 * n)
    there = rows.withColumn("band", band).select(F.col("iata").alias("dst"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"), F.col("pos").alias("dst_pos"), "band", F.least(cell, n - 1).alias("cell"))
    here = rows.withColumn("band", F.explode(F.array(band - 1, band, band + 1)))
    near = F.array_distinct(F.transform(F.array(*[F.lit(k).cast("long") for k in (-1, 0, 1)]), lambda k: F.pmod(F.least(cell, n - 1) + k, n)))
    here = here.select(F.col("iata").alias("src"), F.col("lat").alias("lat1"), F.col("lon").alias("lon1"), "band", F.explode(near).alias("cell"))
    km = geo.distance_km(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"))
    return here.join(there, ["band", "cell"]).where("src <> dst").withColumn("km", km).where(F.col("km") <= max_km).select("src", "dst", F.round("km", 2).alias("distance_km"), "dst_pos")


def within_radius_brute(airports: DataFrame, max_km: float) -> DataFrame:
    """The same pairs by comparing all with all; what tests and the bench hold the bands against."""
    rows = airports.where(geo.finite(F.col("lat")) & geo.finite(F.col("lon")))
    here, there = (rows.select(*[F.col(c).alias(f"{c}{k}") for c in ("iata", "lat", "lon", "pos")]) for k in (1, 2))
    km = geo.distance_km(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"))
    return here.join(there, F.col("iata1") != F.col("iata2")).withColumn("km", km).where(F.col("km") <= max_km).select(F.col("iata1").alias("src"), F.col("iata2").alias("dst"), F.round("km", 2).alias("distance_km"), F.col("pos2").alias("dst_pos"))


def build_network(airports: DataFrame, max_km: float = 100.0) -> Network:
    """The network of raw airports (pos, iata_code, coordinates, name, municipality, iso_country).

    Neighbours stand by rounded distance, ties in the airports' order. Airports with coordinates
    that are no finite numbers have no neighbours.
    """
    nodes = upserted(airports)
    order = F.struct("distance_km", "dst_pos", "dst")
    near = within_radius(nodes, max_km).groupBy("src").agg(F.array_sort(F.collect_list(order)).alias("near"))
    edges = near.select("src", F.posexplode("near").alias("pos", "n")).select("src", "n.dst", "n.distance_km", F.col("pos").cast("long").alias("pos"))
    return Network(nodes.select("iata", "name", "municipality", "country", "coordinates", "pos"), edges, max_km)


def nested(network: Network) -> DataFrame:
    """Airports with nearby_airports, their neighbours in order, an empty list where there are none."""
    one = F.struct("pos", F.col("dst").alias("iata"), "distance_km")
    near = network.edges.groupBy("src").agg(F.array_sort(F.collect_list(one)).alias("near"))
    listed = F.transform("near", lambda n: F.struct(n.iata.alias("iata"), n.distance_km.alias("distance_km")))
    joined = network.airports.join(near.withColumnRenamed("src", "iata"), "iata", "left")
    return joined.withColumn("nearby_airports", F.coalesce(listed, F.array().cast("array<struct<iata:string,distance_km:double>>"))).drop("near")


def statistics(network: Network) -> DataFrame:
    """One row: airports, neighbour entries, and their mean for each airport, 0 without airports."""
    counts = network.airports.agg(F.count("*").alias("airports")).crossJoin(network.edges.agg(F.count("*").alias("connections")))
    mean = F.when(F.col("airports") > 0, F.col("connections") / F.col("airports")).otherwise(0.0)
    return counts.withColumn("average_neighbours", F.round(mean, 2))


def examples(network: Network, airports: int = 5, neighbours: int = 3) -> DataFrame:
    """Of the first airports those with neighbours, and a few of these."""
    first = network.airports.orderBy("pos").limit(airports)
    shown = nested(Network(first, network.edges.join(first.select(F.col("iata").alias("src")), "src", "left_semi")))
    return shown.where(F.size("nearby_airports") > 0).orderBy("pos").select("iata", "municipality", F.slice("nearby_airports", 1, neighbours).alias("nearby_airports"))


def allowed_airports(cities: DataFrame, network: Network | None, max_km: float = 100.0, same_country: bool = True) -> DataFrame:
    """(city, airport): for each city (column city) itself and its neighbours within max_km, each once.

    same_country: a neighbour must be in the network with the city's country, unless the city's
    country is unknown. Without a network a city has only itself; a null city has nothing.
    """
    cities = cities.select("city").where("city is not null").distinct()
    own = cities.select("city", F.col("city").alias("airport"))
    if network is None:
        return own
    edges = network.edges.where(F.coalesce("distance_km", F.lit(0.0)) <= max_km).where("dst is not null").select("src", "dst")
    near = edges.join(cities.withColumnRenamed("city", "src"), "src", "left_semi")
    if same_country:
        country = network.airports.select("iata", present(F.col("country")).alias("country"))
        near = near.join(country.select(F.col("iata").alias("src"), F.col("country").alias("src_country")), "src")
        near = near.join(country.select(F.col("iata").alias("dst"), F.col("country").alias("dst_country"), F.lit(True).alias("known")), "dst", "left")
        near = near.where("src_country is null or (known and dst_country = src_country)")
    return own.unionByName(near.select(F.col("src").alias("city"), F.col("dst").alias("airport"))).distinct()


def city_names(codes: DataFrame, network: Network | None, code: str = "iata", name: str = "city_name") -> DataFrame:
    """Rows with the municipality of their code, empty where it is unknown."""
    if network is None:
        return codes.withColumn(name, F.lit(""))
    known = network.airports.select(F.col("iata").alias(code), F.col("municipality").alias(name))
    return codes.join(known, code, "left").withColumn(name, F.coalesce(name, F.lit("")))

"""Requests for flights, and what is made of the answers."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ternway.functions import times
from ternway.functions.values import present
from ternway.session import shared_path, ship

#: Tasks that ask for fares.
SLOTS = 8


def date_series(spark: SparkSession, first: str, last: str) -> DataFrame:
    """(day) of all days of a range; none if it is reversed, ValueError if a bound is no date."""
    first, last = date.fromisoformat(first).isoformat(), date.fromisoformat(last).isoformat()
    return spark.range(1).select(F.explode(times.days(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("day")).select(F.date_format("day", "yyyy-MM-dd").alias("day"))


def requests(spark: SparkSession, origin: str, destination: str | None, leg1: tuple[str, str], leg2: tuple[str, str] | None = None, intermediate: list[str] | DataFrame | None = None) -> DataFrame:
    """(leg, origin, destination, date) of all requests: by route and day.

    Intermediate airports are a list or a table's first column. Without them the first leg goes
    anywhere and the second comes from anywhere. The second leg needs a destination and days. A
    reversed first range is an error.
    """
    days1 = date_series(spark, *leg1)
    if leg1[0] > leg1[1]:
        raise ValueError("the first leg's days are reversed")
    if isinstance(intermediate, DataFrame):
        stops = intermediate.select(F.col(intermediate.columns[0]).cast("string").alias("stop")).distinct()
    else:
        stops = spark.createDataFrame([(x,) for x in intermediate or [None]], "stop string")
    out = stops.crossJoin(days1).select(F.lit("leg1").alias("leg"), F.lit(origin).alias("origin"), F.col("stop").alias("destination"), F.col("day").alias("date"))
    if destination and leg2:
        out = out.unionByName(stops.crossJoin(date_series(spark, *leg2)).select(F.lit("leg2").alias("leg"), F.col("stop").alias("origin"), F.lit(destination).alias("destination"), F.col("day").alias("date")))
    return out


def fetched(asked: DataFrame, slots: int = SLOTS, **options: str) -> DataFrame:
    """Flights that answer the requests, through the fares source.

    The requests are written to the shared folder, dealt over `slots` tasks, which keep the pace
    of one. Filters on what was asked for leave out requests.
    """
    from ternway.sources.fares import Fares

    spark = asked.sparkSession
    ship(spark)
    spark.dataSource.register(Fares)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    path, order = shared_path(spark, "requests"), ("leg", "origin", "destination", "date")
    asked.select(*order).repartitionByRange(slots, *order).sortWithinPartitions(*order).write.json(path)
    return spark.read.format("fares").options(requests=path, **options).load()


def union_all(answers: list[DataFrame]) -> DataFrame:
    """All rows of all answers; columns that an answer lacks are null."""
    out = answers[0]
    for x in answers[1:]:
        out = out.unionByName(x, allowMissingColumns=True)
    return out


def discovered(leg1: DataFrame) -> DataFrame:
    """One row: the sorted distinct destinations of first-leg flights."""
    return leg1.agg(F.sort_array(F.collect_set(present(F.col("destination")))).alias("intermediate_airports"))

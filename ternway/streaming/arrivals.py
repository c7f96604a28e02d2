"""Journeys from a stream of second-leg flights and a table of first-leg ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ternway import schemas
from ternway.operators import journeys, legs
from ternway.sources.files import Network


def second_leg_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Flights from JSON lines files (with `pos`) as they appear in a folder."""
    return spark.readStream.schema(f"pos bigint, {schemas.FLIGHT}").json(folder)


def stream_journeys(stream: DataFrame, leg1: DataFrame, path: str, checkpoint: str, network: Network | None = None, min_stay: int = 1, max_stay: int = 30) -> StreamingQuery:
    """Append the journeys of each batch of new second-leg flights to Parquet files; stops when no new files are there."""
    first = legs.first_legs(leg1)

    def add(batch: DataFrame, number: int) -> None:
        # a batch that is repeated after a failure replaces its own folder
        journeys.journeys(first, legs.second_legs(batch), network, min_stay, max_stay).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

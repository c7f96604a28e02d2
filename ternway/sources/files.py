"""Flight files, airport tables and airport networks."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.json
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ternway import schemas
from ternway.functions.values import present
from ternway.session import ship
from ternway.sources import ranges


@dataclass
class Flights:
    """Both legs, with `pos`, the order within a file, and the files' metadata."""

    leg1: DataFrame
    leg2: DataFrame
    metadata: DataFrame


def read_flight_file(spark: SparkSession, path: str, range_bytes: int = ranges.RANGE_BYTES) -> Flights:
    """Read flight files: one JSON document with the flights of both legs each, by many tasks each.

    A missing path raises AnalysisException, a document that is no JSON object ValueError; a
    missing list of flights is an empty one, and what isn't an object in a list is no flight.
    """
    found = ranges.documents(spark, path, range_bytes)

    def leg(name: str) -> DataFrame:
        return ranges.objects(spark, found, name).select("pos", F.from_json("value", schemas.FLIGHT).alias("flight")).select("pos", "flight.*")

    metadata = ranges.member(spark, found, "metadata").select(F.from_json("value", schemas.METADATA).alias("m")).select("m.*")
    return Flights(leg("leg1_flights"), leg("leg2_flights"), metadata)


def read_journeys(spark: SparkSession, path: str, schema: str, range_bytes: int = ranges.RANGE_BYTES) -> DataFrame:
    """The journeys that result documents list, with the fields of a schema, read by many tasks. Errors are those of `read_flight_file`."""
    found = ranges.documents(spark, path, range_bytes)
    return ranges.objects(spark, found, "combinations").select(F.from_json("value", schema).alias("j")).select("j.*")


#: What a journey's JSON text has its flights behind; strings in it have no such text, as their quotes are escaped.
LEGS = (b',"leg1":', b',"leg2":')


def _objects(texts: pa.Array, schema: pa.Schema) -> list[pa.Array]:
    """The fields of JSON objects, a text each; unknown ones are skipped, absent ones null."""
    if not len(schema):
        return []
    lines = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), texts), "\n")[0].as_buffer()
    try:
        found = pyarrow.json.read_json(pa.BufferReader(lines), pyarrow.json.ReadOptions(use_threads=False, block_size=lines.size + 1), pyarrow.json.ParseOptions(explicit_schema=schema, unexpected_field_behavior="ignore"))
        return [found.column(n).combine_chunks() for n in schema.names]
    except pa.ArrowInvalid:  # numbers that JSON has not are written as strings
        rows = [json.loads(t) for t in texts.to_pylist()]
        return [pa.array([_shaped(r.get(f.name), f.type) for r in rows], f.type) for f in schema]


def _shaped(value: object, kind: pa.DataType) -> object:
    if isinstance(value, dict) and pa.types.is_struct(kind):
        return {f.name: _shaped(value.get(f.name), f.type) for f in kind}
    return float(value) if isinstance(value, str) and pa.types.is_floating(kind) else value


def _places(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, key: bytes) -> np.ndarray | None:
    """Where an eight-byte key first stands in each text; None if one lacks it. What is before it has few lengths, so each is tried for all texts at once."""
    out, left = np.empty(len(starts), np.int64), np.arange(len(starts))
    eight = np.lib.stride_tricks.as_strided(data[: 8 * (len(data) // 8)].view(np.uint64), (max(len(data) - 7, 0),), (1,))  # from any place on
    while len(left):
        at = data[starts[left[0]] : stops[left[0]]].tobytes().find(key)
        if at < 0:
            return None
        guess = starts[left] + at
        found = guess + 8 <= stops[left]
        found &= eight[np.minimum(guess, len(eight) - 1)] == np.frombuffer(key, np.uint64)[0]
        out[left[found]] = guess[found]
        left = left[~found]
    return out


def _journeys(texts: pa.Array, schema: pa.Schema) -> list[pa.Array]:
    """The fields of journeys. Texts are cut before both flights; a flight that stands in many is parsed once."""
    n, data = len(texts), np.frombuffer(texts.buffers()[2], np.uint8)
    bounds = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    first = _places(data, bounds[:-1], bounds[1:], LEGS[0])
    second = None if first is None else _places(data, first, bounds[1:], LEGS[1])
    if second is None:
        return _objects(texts, schema)
    cuts = np.empty(5 * n + 1, np.int32)  # the head, a comma, the first flight, a comma, and the rest
    cuts[::5] = bounds
    for k, at in ((1, first), (3, second)):
        cuts[k::5], cuts[k + 1 :: 5] = at, at + 1
    parts = pa.StringArray.from_buffers(5 * n, pa.py_buffer(cuts), texts.buffers()[2])
    found = {}
    for k, before, after in ((0, "", "}"), (2, "{", "}"), (4, "{", "")):
        wanted = pa.schema([f for f in schema if {"leg1": 2, "leg2": 4, "airport_transfer": 4}.get(f.name, 0) == k])
        if not len(wanted):
            continue
        part, places = parts.take(pa.array(np.arange(k, 5 * n, 5))), None
        if k:
            part = part.dictionary_encode()
            part, places = part.dictionary, part.indices
        columns = _objects(pc.binary_join_element_wise(before, part, after, ""), wanted)
        found |= dict(zip(wanted.names, columns if places is None else [c.take(places) for c in columns], strict=True))
    return [found[name] for name in schema.names]


def parse_journeys(lines: DataFrame, schema: str) -> DataFrame:
    """Journeys from rows of JSON text in `value` (`documents.journey_json`), with the fields of a schema.

    All of each text is parsed in Arrow batches; a flight stands in many journeys of a batch, and equal texts are parsed once.
    """
    ship(lines.sparkSession)
    kind = to_arrow_schema(StructType.fromDDL(schema))

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays(_journeys(batch.column(0), kind), kind.names)

    return lines.select("value").mapInArrow(parsed, schema)


def read_flight_tables(spark: SparkSession, path: str) -> Flights:
    """Read what `write_flight_tables` wrote: Parquet tables of both legs and of the metadata."""
    return Flights(*(spark.read.parquet(f"{path}/{name}") for name in ("leg1", "leg2", "metadata")))


def write_flight_tables(flights: Flights, path: str) -> None:
    for name in ("leg1", "leg2", "metadata"):
        getattr(flights, name).write.mode("overwrite").parquet(f"{path}/{name}")


def read_airports(spark: SparkSession, path: str, format: str = "parquet", **options: str) -> DataFrame:
    """Airports (pos, iata_code, coordinates, name, municipality, iso_country) with a code and coordinates.

    CSV files keep the text NA, which is a country's code. `pos` follows the rows' order in the files.
    """
    reader = spark.read.options(**({"header": "true", "nullValue": "", "emptyValue": ""} if format == "csv" else {}) | options)
    if format in ("csv", "json"):
        reader = reader.schema(schemas.AIRPORT)
    rows = reader.format(format).load(path).select(*[F.col(x.split()[0]).cast("string") for x in schemas.AIRPORT.split(", ")])
    rows = rows.withColumn("pos", F.monotonically_increasing_id())
    return rows.where(present(F.col("iata_code")).isNotNull() & present(F.col("coordinates")).isNotNull())


@dataclass
class Network:
    """Airports (iata, name, municipality, country, coordinates, pos) and their neighbours (src, dst, distance_km, pos), up to max_km where that is known."""

    airports: DataFrame
    edges: DataFrame
    max_km: float | None = None


#: What tells of a finished build.
MANIFEST = "build string, max_km double, built_at timestamp"


def parse_network(document: DataFrame) -> Network:
    """A network from rows of JSON text in `value`; neighbours are objects or, in older files, bare codes at distance 0."""
    each = document.select(F.explode(F.from_json("value", schemas.NETWORK)).alias("iata", "a"))
    airports = each.select("iata", "a.name", "a.municipality", "a.country", "a.coordinates", F.monotonically_increasing_id().alias("pos"))
    near = each.select(F.col("iata").alias("src"), F.posexplode(F.col("a.nearby_airports")).alias("pos", "n"))
    edges = near.select(
        "src",
        F.coalesce(F.get_json_object("n", "$.iata"), F.when(~F.col("n").startswith("{"), F.col("n"))).alias("dst"),
        F.coalesce(F.get_json_object("n", "$.distance_km").try_cast("double"), F.lit(0.0)).alias("distance_km"),
        F.col("pos").cast("long").alias("pos"),
    )
    return Network(airports, edges.where("dst is not null"))


def read_network(spark: SparkSession, path: str) -> Network:
    """Read a network: the newest of those that `write_network_tables` finished, or a JSON document.

    Where there is neither, AnalysisException or, if builds were begun and none finished, FileNotFoundError is raised.
    """
    try:
        manifests = spark.read.schema(MANIFEST).parquet(f"{path}/build-*/manifest")
        newest = manifests.orderBy(F.desc("built_at"), F.desc("build")).first()
    except AnalysisException:
        newest = None
    if newest is None:
        document = spark.read.text(path, wholetext=True)
        if document.select(F.lit(1)).isEmpty():
            raise FileNotFoundError(f"{path} has no finished network")
        return parse_network(document)
    build = f"{path}/{newest.build}"
    return Network(spark.read.parquet(f"{build}/airports"), spark.read.parquet(f"{build}/edges"), newest.max_km)


def write_network_tables(network: Network, path: str) -> None:
    """Write a network into a new folder of its own at the path, and at last its manifest, one row.

    Readers take builds with a manifest only, so they never see one that is half written or was
    given up, and builders at the same time don't disturb each other. Older builds stay.
    """
    build = f"build-{uuid.uuid4().hex}"
    network.airports.write.parquet(f"{path}/{build}/airports")
    network.edges.write.parquet(f"{path}/{build}/edges")
    spark = network.airports.sparkSession
    row = spark.range(1).select(F.lit(build).alias("build"), F.lit(network.max_km).cast("double").alias("max_km"), F.current_timestamp().alias("built_at"))
    row.coalesce(1).write.parquet(f"{path}/{build}/manifest")

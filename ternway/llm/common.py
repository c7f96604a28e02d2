"""What the text operators share: storage for intermediate tables, Arrow access, word hashing."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task turns into arrays at a time.
CHUNK_BYTES = 1 << 19

BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
_MULT = np.uint64(0x9E3779B97F4A7C15)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where none is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        folder = getattr(spark, "_ternway_scratch", None) or tempfile.mkdtemp(prefix="ternway-")
        spark._ternway_scratch = folder
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, for sessions whose workers have it nowhere on their path. Once a session.

    Arrow batches get a megabyte, unless the session says otherwise: rows may be whole texts.
    """
    if spark.conf.get(BATCH_BYTES) == "67108864b":
        spark.conf.set(BATCH_BYTES, "1m")
    context = spark.sparkContext
    if getattr(context, "_ternway_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    bundle = Path(tempfile.mkdtemp(prefix="ternway-")) / "ternway.zip"
    with zipfile.ZipFile(bundle, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    context.addPyFile(str(bundle))
    context._ternway_shipped = True


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back, which cuts its lineage."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, name: str, rows: int = 200_000) -> DataFrame:
    """A table of narrow rows, written; to be broadcast if it has no more than `rows` rows, else joined as Spark likes."""
    out = written(df, name)
    return F.broadcast(out) if out.count() <= rows else out


def remainder(column: str, modulus: int):
    """crc32 of an id's decimal text, modulo a number: how rows are dealt into folds."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def sampled(df: DataFrame, groups: str, most: int) -> DataFrame:
    """About `most` rows of each group, picked by a hash of doc_id; all rows of smaller groups.

    The rate follows from a count of the groups, so the sample is bounded however large the
    table is, and it needs no shuffle of the rows themselves.
    """
    counts = df.groupBy(groups).agg(F.count("*").alias("_rows"))
    share = F.pmod(F.xxhash64(F.lit(17), F.col("doc_id")), F.lit(1 << 30)) / float(1 << 30)
    rate = F.least(F.lit(1.0), F.lit(float(most)) / F.col("_rows"))
    return df.join(F.broadcast(counts), groups).where(share < rate).drop("_rows")


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the n + 1 offsets into them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batch: pa.RecordBatch, text: str = "text", size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `size` bytes of text each, one row at least."""
    _, offsets = texts(batch.column(batch.schema.get_field_index(text)))
    start = 0
    while start < batch.num_rows:
        stop = int(np.searchsorted(offsets, offsets[start] + size, "right")) - 1
        stop = min(max(stop, start + 1), batch.num_rows)
        yield batch.slice(start, stop - start)
        start = stop


def release() -> None:
    """Give memory that a task no longer needs back to the system, as workers live on."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (a finaliser of the splitmix kind)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def spans_coded(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """Distinct byte strings, and for each span [start, stop) which of them it is. Spans ascend and don't overlap."""
    if not len(starts):
        return [], np.zeros(0, np.int64)
    edges = np.empty(2 * len(starts), np.int64)
    edges[0::2], edges[1::2] = starts, stops
    # what lies between the spans is coded too and left out afterwards
    coded = pa.Array.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
    return coded.dictionary.to_numpy(zero_copy_only=False).tolist(), np.asarray(coded.indices)[::2]


def hashes(strings: Iterable[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, strings), np.uint64)


class Words:
    """Splits UTF-8 text into words by a table of 256 byte classes and hashes them.

    letter: for each byte whether it belongs to a word; fold: what each byte counts as.
    """

    def __init__(self, letter: np.ndarray, fold: np.ndarray) -> None:
        self.letter, self.fold = letter, fold

    def spans(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and stops of all words; no word crosses the end of a text."""
        inside = np.zeros(len(data) + 2, bool)
        inside[1:-1] = self.letter[data]
        cut = np.zeros(len(data) + 1, bool)
        cut[offsets] = True
        starts = np.flatnonzero(inside[1:] & (~inside[:-1] | cut))
        stops = np.flatnonzero(inside[:-1] & (~inside[1:] | cut))
        return starts, stops

    def coded(self, data: np.ndarray, offsets: np.ndarray) -> tuple[Iterator[tuple[list[bytes], np.ndarray]], np.ndarray]:
        """Distinct words and for each word which of them it is, in blocks; and for every text the index of its first word (n + 1 values)."""
        starts, stops = self.spans(data, offsets)

        def blocks() -> Iterator[tuple[list[bytes], np.ndarray]]:
            a = 0
            while a < len(starts):
                b = max(a + 1, int(np.searchsorted(stops, starts[a] + 2 * CHUNK_BYTES, "right")))
                lo = starts[a]
                yield spans_coded(self.fold[data[lo : stops[b - 1]]], starts[a:b] - lo, stops[a:b] - lo)
                a = b

        return blocks(), np.searchsorted(starts, offsets)

    def hashed(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hash of every word, and for every text the index of its first word (n + 1 values)."""
        blocks, first = self.coded(data, offsets)
        return np.concatenate([np.zeros(0, np.uint64), *[hashes(words)[which] for words, which in blocks]]), first


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def white_space_words() -> Words:
    """Words as in `[^\\x20\\x09-\\x0D]+`, A-Z as a-z."""
    letter = np.ones(256, bool)
    letter[[9, 10, 11, 12, 13, 32]] = False
    return Words(letter, LOWER)


def alphanumeric_words() -> Words:
    """Words of digits, letters and whatever is not ASCII, A-Z as a-z."""
    letter = np.zeros(256, bool)
    letter[48:58] = letter[65:91] = letter[97:123] = letter[128:] = True
    return Words(letter, LOWER)


def windows(h: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `width` words within a text, and the index of the first of each text.

    A text of fewer words, but one at least, has its whole sequence as its only run.
    """
    n = len(h)
    count = np.diff(first)
    runs = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    at = np.zeros(len(first), np.int64)
    np.cumsum(runs, out=at[1:])
    rolled = np.zeros(max(n - width + 1, 0), np.uint64)
    for k in range(width):
        rolled = rolled * _MULT + h[k : k + len(rolled)]
    out = np.empty(at[-1], np.uint64)
    full = count >= width
    where = np.repeat(first[:-1][full] - np.concatenate([[0], np.cumsum(runs[full])[:-1]]).astype(np.int64), runs[full]) + np.arange(int(runs[full].sum()))
    out[np.repeat(full, runs)] = rolled[where]
    for d in np.flatnonzero(~full & (count > 0)):
        value = np.uint64(count[d])
        for x in h[first[d] : first[d + 1]]:
            value = np.uint64((int(value) * 0x9E3779B97F4A7C15 + int(x)) & 0xFFFFFFFFFFFFFFFF)
        out[at[d]] = value
    return mixed(out), at


def filter_bits(n: int) -> int:
    """log2 of the bits of a map for n values: 32 bits for each, from 128 KB to 32 MB in all."""
    return int(np.clip(np.ceil(np.log2(32 * max(1, n))), 20, 28))


def bit_map(values: DataFrame, bits: int) -> bytes:
    """A bit for each value of a column of longs, modulo 2**bits.

    Each task sends one map and a tree of tasks joins them. With very many values most bits are
    set, so what it lets through must be joined exactly afterwards.
    """

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = np.zeros(1 << bits >> 3, np.uint8)
        for batch in batches:
            if pa.types.is_binary(batch.schema.field(0).type):
                for x in batch.column(0):
                    have |= np.frombuffer(x.as_buffer(), np.uint8)
            else:
                on = np.zeros(1 << bits, bool)
                on[np.asarray(batch.column(0)) & ((1 << bits) - 1)] = True
                have |= np.packbits(on)
        yield pa.RecordBatch.from_arrays([pa.array([have.tobytes()], pa.binary())], ["have"])

    parts, left = values.mapInArrow(merge, "have binary"), max(1, values.rdd.getNumPartitions())
    while left > 1:
        left = -(-left // 16)
        parts = parts.repartition(left).mapInArrow(merge, "have binary")
    have = np.zeros(1 << bits >> 3, np.uint8)
    for row in parts.collect():
        have |= np.frombuffer(row.have, np.uint8)
    return have.tobytes()


def in_bit_map(have: bytes, values: np.ndarray) -> np.ndarray:
    bits = np.frombuffer(have, np.uint8)
    low = values.astype(np.uint64) & np.uint64(8 * len(bits) - 1)
    return ((bits[(low >> np.uint64(3)).astype(np.int64)] >> (np.uint64(7) - (low & np.uint64(7))).astype(np.uint8)) & 1).astype(bool)


#: Rows of one key from which a join deals them over several tasks, and over how many.
HOT_ROWS, SALTS = 1000, 64


def joined(rows: DataFrame, table: DataFrame, keys: list[str], count: str, spread: str) -> DataFrame:
    """Rows left-joined with a table that has one row for each key, and in `count` how many rows have it.

    A key of more than HOT_ROWS rows doesn't meet in one task: its rows are dealt by a hash of
    the column `spread`, and its row of the table goes to all SALTS places. A bit map tells both
    sides which keys these are; a key that it takes for one by chance is dealt too.
    """
    h = F.xxhash64(*keys)
    hot = table.where(F.col(count) > HOT_ROWS).select(h.alias("h"))
    n = hot.count()
    if not n:
        return rows.join(table, keys, "left")
    shared = rows.sparkSession.sparkContext.broadcast(bit_map(hot, filter_bits(n)))

    @F.pandas_udf("boolean")
    def is_hot(h: pd.Series) -> pd.Series:
        return pd.Series(in_bit_map(shared.value, h.to_numpy()))

    salt = f"salt_{uuid.uuid4().hex}"
    rows = rows.withColumn(salt, F.when(is_hot(h), F.pmod(F.xxhash64(spread), F.lit(SALTS))).otherwise(0).cast("int"))
    table = table.withColumn(salt, F.explode(F.when(is_hot(h), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return rows.join(table, [*keys, salt], "left").drop(salt)


def without(rows: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """Rows whose key, a long, is not among the one column of ids; rows with a null key stay.

    Rows that a bit map of the ids rules out are not shuffled; only the rest is joined.
    """
    name = ids.columns[0]
    shared = rows.sparkSession.sparkContext.broadcast(bit_map(ids.select(F.xxhash64(F.col(name).cast("long")).alias("h")), filter_bits(ids.count())))

    @F.pandas_udf("boolean")
    def listed(h: pd.Series) -> pd.Series:
        return pd.Series(in_bit_map(shared.value, h.to_numpy()))

    maybe = listed(F.xxhash64(F.col(key).cast("long")))
    other = f"listed_{uuid.uuid4().hex}"  # no column of the rows has this name
    rest = rows.where(maybe).join(ids.select(F.col(name).cast("long").alias(other)), F.col(key).cast("long") == F.col(other), "left_anti")
    return rows.where(~maybe).unionByName(rest)

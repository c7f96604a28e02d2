"""Token ids in files of Huffman blocks.

Two tables lie in a folder: `codes` (id, length), the lengths of a canonical code over the
counts of all ids, limited to MAX_LENGTH bits; and `blocks`, ordered by doc_id over its files,
each row one block that can be decoded without any other. A block is, little-endian:

    4 bytes HUF1, uint32 documents, uint32 ids, uint32 ids between checkpoints,
    int64 doc_id and uint32 ids of each document and a byte that is 1 for a null doc_id,
    uint32 bit offset of each checkpoint, then the codes, most significant bit first.

Checkpoints let a reader decode many stretches of a block side by side.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ternway.llm import bpe
from ternway.llm.common import chunks, release, scratch_path, shared_folder, texts

#: Bits of the longest code while the ids leave room in them, else two more than the ids need.
MAX_LENGTH = 18
CHECKPOINT, BLOCK_IDS = 128, 1 << 17
#: Bits that a reader has of a code: ids of vocabularies up to 33 million.
MOST_BITS = 25


def most_bits(n: int) -> int:
    """The limit of code lengths for n different ids."""
    if n > 1 << MOST_BITS:
        raise ValueError(f"{n} ids don't fit codes of {MOST_BITS} bits")
    return min(MOST_BITS, max(MAX_LENGTH, (n - 1).bit_length() + 2)) if n else MAX_LENGTH


def table_bits(lengths: np.ndarray) -> int:
    """log2 of the entries of a decoding table."""
    return max(MAX_LENGTH, int(lengths.max(initial=0)))


def code_lengths(counts: np.ndarray) -> np.ndarray:
    """Lengths of an optimal prefix code of at most `most_bits` by package-merge; 0 for ids that never occur."""
    lengths = np.zeros(len(counts), np.int64)
    used = np.flatnonzero(counts)
    n = len(used)
    if n < 2:
        lengths[used] = 1
        return lengths
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.int64)
    packages = np.zeros(0, np.int64)
    levels = []
    for _ in range(most_bits(n)):
        both = np.concatenate([leaves, packages])
        rank = np.argsort(both, kind="stable")
        both = both[rank]
        levels.append(np.cumsum(rank < n))
        packages = both[: len(both) // 2 * 2].reshape(-1, 2).sum(1)
    take = 2 * n - 2
    for taken in reversed(levels):  # of each level the cheapest are taken, and the parts of what is a package there
        k = int(taken[take - 1]) if take else 0
        lengths[order[:k]] += 1
        take = 2 * (take - k)
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes in the order of length, then id."""
    codes, bits = np.zeros(len(lengths), np.uint64), np.uint64(table_bits(lengths))
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    own = lengths[order]
    if len(order):
        room = np.uint64(1) << (bits - own.astype(np.uint64))
        codes[order] = (np.cumsum(room) - room) >> (bits - own.astype(np.uint64))
    return codes


def lookup(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each number of `table_bits` bits the id whose code it starts with and the length of that code."""
    bits = table_bits(lengths)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    room = 1 << (bits - lengths[order])
    ids, size = np.zeros(1 << bits, np.uint32), np.ones(1 << bits, np.uint8)
    ids[: room.sum()], size[: room.sum()] = np.repeat(order, room), np.repeat(lengths[order], room)
    return ids, size


def pack(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Bit offsets of the checkpoints, and the codes of the ids as bytes."""
    size = lengths[ids].astype(np.uint64)
    end = np.cumsum(size)
    at = end - size
    words = np.zeros(int(end[-1] >> np.uint64(6)) + 2 if len(ids) else 1, np.uint64)
    value, off = codes[ids], at & np.uint64(63)
    word = (at >> np.uint64(6)).astype(np.int64)
    over = off + size > 64
    high = np.where(over, value >> np.where(over, off + size - np.uint64(64), 0), value << np.where(over, 0, np.uint64(64) - off - size))
    if len(ids):
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        words[word[first]] = np.bitwise_or.reduceat(high, first)
        words[word[over] + 1] |= value[over] << (np.uint64(128) - off[over] - size[over])
    total = int(end[-1]) if len(ids) else 0
    return at[::CHECKPOINT].astype(np.uint32), words.astype(">u8").tobytes()[: (total + 7) // 8]


def unpack(offsets: np.ndarray, data: bytes, n: int, step: int, ids: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All n ids, decoded from all checkpoints side by side."""
    raw = np.frombuffer(data + b"\0" * 8, np.uint8).astype(np.uint32)
    near = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
    out = np.zeros((len(offsets), step), np.uint32)
    at, last = offsets.astype(np.int64), 8 * len(data)
    unused = np.uint32(33 - len(ids).bit_length())
    for k in range(min(step, n)):
        code = (near[np.minimum(at, last) >> 3] << (at & 7).astype(np.uint32)) >> unused
        out[:, k] = ids[code]
        at += size[code]
    return out.ravel()[:n]


def block_bytes(doc_ids: list[int | None], parts: list[np.ndarray], codes: np.ndarray, lengths: np.ndarray) -> bytes:
    ids = np.concatenate(parts)
    offsets, data = pack(ids, codes, lengths)
    head = struct.pack("<4sIII", b"HUF1", len(parts), len(ids), CHECKPOINT)
    keys = np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes()
    sizes = np.array([len(x) for x in parts], "<u4").tobytes()
    return head + keys + sizes + bytes(d is None for d in doc_ids) + offsets.astype("<u4").tobytes() + data


def read_block(block: bytes, ids: np.ndarray, size: np.ndarray) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc_id and number of ids of each document of a block, and all ids."""
    magic, docs, n, step = struct.unpack_from("<4sIII", block)
    if magic != b"HUF1":
        raise ValueError("no Huffman block")
    at = 16
    keys = np.frombuffer(block, "<i8", docs, at).tolist()
    at += 8 * docs
    sizes = np.frombuffer(block, "<u4", docs, at)
    at += 4 * docs
    keys = [None if null else k for k, null in zip(keys, block[at : at + docs], strict=True)]
    at += docs
    marks = -(-n // step)
    offsets = np.frombuffer(block, "<u4", marks, at)
    return keys, sizes, unpack(offsets, block[at + 4 * marks :], n, step, ids, size)


def write(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 0) -> None:
    """Encode texts with the tokenizers library, end each with end_id, and write them in ascending order of doc_id.

    A null text is empty and has the end alone; null doc_ids come first. Rows of one
    doc_id stand by the bytes of their compressed ids, so their order follows from their texts alone. Other columns don't matter. The ids are computed once: they go, compressed, to ranges of doc_id
    found from quantiles, and are kept in the shared folder between the two passes, counting and
    coding. A document lies in one block, so the longest one sets the size of the largest block.
    An empty table gives empty tables; more than 2**MOST_BITS different ids are a ValueError.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    bounds = docs.agg(F.percentile_approx("doc_id", [k / parts for k in range(1, parts)] or [0.5], 100 * parts)).first()[0] or []
    ranges = sorted(set(bounds[: parts - 1]))
    tables = bpe.shared_tables(docs, tokenizer)
    n = len(tables.value.flat_at)
    kind = "<u2" if n <= 1 << 16 else "<u4"

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = bpe.piece_cache(tables.value, tokenizer)
        cuts, squeeze = np.array(ranges, np.int64), zstandard.ZstdCompressor(1)
        for batch in batches:
            for piece in chunks(batch):
                ids, offsets = cache.encoded(*texts(piece.column(1)))
                ids = np.insert(ids, offsets[1:], end_id).astype(kind)
                bounds = (offsets + np.arange(len(offsets))).tolist()
                keys = piece.column(0)
                to = np.searchsorted(cuts, np.asarray(keys.fill_null(0)), "left")
                to[np.asarray(keys.is_null())] = 0
                rows = [squeeze.compress(ids[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([keys, pa.array(to.astype(np.int32)), pa.array(rows, pa.binary())], ["doc_id", "part", "ids"])
        release()

    rows = docs.mapInArrow(encoded, "doc_id long, part int, ids binary")
    rows = rows.repartitionById(len(ranges) + 1, F.col("part")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "ids")
    shared_folder(spark)
    rows = rows.checkpoint()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, open_, held, size = np.zeros(n, np.int64), zstandard.ZstdDecompressor(), [], 0
        for batch in batches:
            for x in batch.column(0):
                held.append(np.frombuffer(open_.decompress(x.as_buffer()), kind))
                size += len(held[-1])
                if size > BLOCK_IDS:
                    total += np.bincount(np.concatenate(held), minlength=n)
                    held, size = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=n)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["id", "n"])

    counts = np.zeros(n, np.int64)
    for row in rows.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[row.id] = row.n  # as many rows as the vocabulary has ids, at most
    lengths = code_lengths(counts)
    table = spark.createDataFrame([(int(i), int(lengths[i])) for i in np.flatnonzero(lengths)], "id int, length int")
    table.coalesce(1).write.parquet(f"{folder}/codes")
    shared = spark.sparkContext.broadcast((canonical(lengths), lengths))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, sizes = shared.value
        open_, here = zstandard.ZstdDecompressor(), TaskContext.get().partitionId()
        keys, held, total, before, number = [], [], 0, 0, 0

        def out() -> pa.RecordBatch:
            columns = [[here], [number], [before], [total], [block_bytes(keys, held, codes, sizes)]]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["part", "block", "before", "n_ids", "data"])

        for batch in batches:
            for key, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.frombuffer(open_.decompress(x.as_buffer()), kind)
                keys.append(key)
                held.append(ids)
                total += len(ids)
                if total >= BLOCK_IDS:
                    yield out()
                    keys, held, before, total, number = [], [], before + total, 0, number + 1
        if held:
            yield out()
        release()

    coded = rows.select("doc_id", "ids").mapInArrow(blocks, "part int, block int, before long, n_ids long, data binary")
    coded.write.option("compression", "none").parquet(f"{folder}/blocks")


def read(spark: SparkSession, folder: str, checksums: bool = False) -> DataFrame:
    """(doc_id, start, ids) of all documents of a folder: start is the number of ids of all documents before it.

    checksums: n_tokens and ids_crc32, the CRC of the ids as little-endian 32-bit numbers, instead of ids.
    """
    lengths = {r.id: r.length for r in spark.read.schema("id int, length int").parquet(f"{folder}/codes").collect()}
    sizes = np.zeros(max(lengths, default=0) + 1, np.int64)
    sizes[list(lengths)] = list(lengths.values())
    shared = spark.sparkContext.broadcast(sizes)
    blocks = spark.read.schema("part int, block int, before long, n_ids long, data binary").parquet(f"{folder}/blocks")
    totals = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    # one row for each part, so one task can add them up
    starts = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("start"))

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, size = lookup(shared.value)
        for batch in batches:
            for part, before, x in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2), strict=True):
                keys, counts, flat = read_block(x.as_py(), ids, size)
                bounds = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
                columns = [pa.array([part.as_py()] * len(keys), pa.int32()), pa.array(keys, pa.int64()), pa.array(before + bounds[:-1])]
                if checksums:
                    flat = memoryview(flat.astype("<u4")).cast("B")
                    columns += [pa.array(counts.astype(np.int64)), pa.array([zlib.crc32(flat[4 * a : 4 * b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)], pa.int64())]
                else:
                    columns.append(pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, ["part", "doc_id", "at", *(["n_tokens", "ids_crc32"] if checksums else ["ids"])])
        release()

    shown = "n_tokens long, ids_crc32 long" if checksums else "ids array<int>"
    rows = blocks.select("part", "before", "data").mapInArrow(decoded, f"part int, doc_id long, at long, {shown}")
    return rows.join(F.broadcast(starts), "part").select("doc_id", (F.col("start") + F.col("at")).alias("start"), *[x.split()[0] for x in shown.split(", ")])


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32): write a table's texts to a new folder of the shared one and read their checksums back."""
    folder = scratch_path(docs.sparkSession, "huffman")
    write(docs, tokenizer, folder)
    return read(docs.sparkSession, folder, checksums=True)

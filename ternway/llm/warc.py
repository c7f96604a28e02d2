"""WARC archives of pages, and a globally ordered index of their captures.

Archives are gzip files written by Spark's text sink, whose line separator ends each record,
so task retries leave no half-written archive behind. A payload that an earlier page has too
is written once; the others are revisit records. Reading an archive gives a run of captures
sorted by URL key and timestamp; the runs are dealt by ranges of that order, through Spark's
exchange and so by disk, and each range, of a bounded size, is merged with a loser tree.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import zlib
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ternway.llm.common import joined, scratch_path, small, written

CRLF = "\r\n"
END = CRLF + CRLF
#: First date of the captures; a page's id gives the seconds after it.
EPOCH, YEAR_S = 1704067200, 31_536_000
#: Bytes of payload of an archive, about, and the most records; an archive is read by one task.
ARCHIVE_BYTES, RECORDS_PER_FILE = 1 << 27, 20_000
#: Captures that a task merges, about: there are as many ranges as that takes.
RANGE_CAPTURES = 50_000
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"


def base32(hexadecimal: Column) -> Column:
    """Base32 of 40 hexadecimal digits: each five are four digits of base 32."""
    groups = [F.lpad(F.conv(F.substring(hexadecimal, k, 5), 16, 32), 4, "0") for k in range(1, 41, 5)]
    return F.translate(F.upper(F.concat(*groups)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def url_key(url: Column) -> Column:
    """Host labels from the last to the first, then `)` and the rest in lower case without fragment."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1)), r"^www\.", "")
    rest = F.regexp_replace(F.regexp_replace(url, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", ""), "#.*$", "")
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.when(rest == "", "/").otherwise(F.lower(rest)))


def captures(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """pages (page_id, url, html) with payload, its length and digest, and refers_to for revisits.

    Of equal payloads of at least `least_bytes` bytes the page with the smallest id has it, the
    others refer to it; a null html is an empty payload, a null url an empty one. Equal rows with
    the smallest id all have the payload, as have rows without an id where no row has one.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    for mark, code in (("\r", "%0D"), ("\n", "%0A"), (" ", "%20")):
        url = F.replace(url, F.lit(mark), F.lit(code))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"bytes": F.octet_length("payload").cast("long"), "digest": base32(F.sha1(F.col("payload").cast("binary")))})
    same = rows.where(F.col("bytes") >= least_bytes).groupBy("digest", "bytes").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1")
    rows = joined(rows, written(same, "payloads"), ["digest", "bytes"], "copies", "page_id")
    return rows.withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))).drop("first", "copies")


def write(pages: DataFrame, path: str, least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write one record per page: `response` with the payload, or `revisit`."""
    mean = pages.agg(F.avg(F.octet_length(F.col("html").cast("string")))).first()[0] or 1.0
    records_per_file = int(min(max(archive_bytes / mean, 1), RECORDS_PER_FILE))
    rows = captures(pages, least_bytes)
    revisit = F.col("refers_to").isNotNull()
    date = F.date_format(F.timestamp_seconds(F.lit(EPOCH) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(YEAR_S))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    block = F.concat(F.lit(HTTP + "Content-Length: "), F.col("bytes"), F.lit(END), F.when(revisit, "").otherwise(F.col("payload")))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    header = F.concat(
        F.lit("WARC/1.1" + CRLF),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", urn("page_id")),
        line("WARC-Date", date),
        line("WARC-Target-URI", F.col("url")),
        line("WARC-URL-Key", url_key(F.col("url"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("WARC-Payload-Length", F.col("bytes")),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", urn("refers_to")))).otherwise(""),
        F.lit("Content-Type: application/http;msgtype=response" + CRLF),
        line("Content-Length", F.octet_length(F.col("block"))),
        F.lit(CRLF),
    )
    rows = rows.withColumn("block", block)
    rows.select(F.concat(header, F.col("block")).alias("value")).write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


class Bytes:
    """Reads a gzip file's content piece by piece."""

    def __init__(self, packed: Any) -> None:
        self.packed, self.at, self.held = memoryview(packed), 0, bytearray()
        self.unzip = zlib.decompressobj(31)

    def _more(self) -> bool:
        if self.unzip.eof:  # archives may have one gzip member per record
            rest = self.unzip.unused_data
            if not rest and self.at >= len(self.packed):
                return False
            self.unzip = zlib.decompressobj(31)
            self.held += self.unzip.decompress(rest)
            return True
        if self.at >= len(self.packed):
            return False
        self.held += self.unzip.decompress(self.packed[self.at : self.at + (1 << 18)])
        self.at += 1 << 18
        return True

    def until(self, mark: bytes) -> bytes | None:
        start = 0
        while (k := self.held.find(mark, start)) < 0:
            start = max(0, len(self.held) - len(mark))
            if not self._more():
                return None
        return self.take(k + len(mark))

    def take(self, n: int) -> bytes:
        while len(self.held) < n and self._more():
            pass
        out = bytes(self.held[:n])
        del self.held[:n]
        return out


def records(packed: Any) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an archive."""
    data, mark = Bytes(packed), END.encode()
    while (head := data.until(mark)) is not None:
        fields = dict(x.split(": ", 1) for x in head.decode().rstrip(CRLF).split(CRLF)[1:])
        yield fields, data.take(int(fields["Content-Length"]))
        data.take(4)


RUN = "run string, url_key string, ts long, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
_arrow = pa.schema([("run", pa.string()), ("url_key", pa.string()), ("ts", pa.int64()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def _page(urn: str) -> int | None:
    number = urn[len("<urn:page:") : -1]
    return int(number) if number else None


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """The captures of the archives in a folder: one run, sorted by URL key, time and page, for each archive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from datetime import datetime

        for batch in batches:
            for name, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = []
                for head, block in records(packed.as_buffer()):
                    digest, size = head["WARC-Payload-Digest"].removeprefix("sha1:"), int(head["WARC-Payload-Length"])
                    if head["WARC-Type"] == "response":
                        payload = block[block.find(b"\r\n\r\n") + 4 :]
                        digest, size = base64.b32encode(hashlib.sha1(payload).digest()).decode(), len(payload)
                    ts = int(datetime.fromisoformat(head["WARC-Date"].replace("Z", "+00:00")).timestamp())
                    refers = _page(head["WARC-Refers-To"]) if "WARC-Refers-To" in head else None
                    rows.append((name, head["WARC-URL-Key"], ts, _page(head["WARC-Record-ID"]), size, digest, head["WARC-Type"], refers))
                rows.sort(key=order)
                yield pa.RecordBatch.from_pydict({f.name: pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_arrow)}, schema=_arrow)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select("path", "content").mapInArrow(run, RUN)


def order(row: tuple) -> tuple:
    """Key of the global order: URL key, time, page, a null page first."""
    return row[1], row[2], row[3] is not None, row[3] or 0


class LoserTree:
    """Merges k sorted sequences: inner nodes keep the loser of each match, so the next row costs one match per level."""

    def __init__(self, runs: list[Iterator[tuple]]) -> None:
        self.runs, self.k = runs, len(runs)
        self.heads: list[tuple | None] = [self._next(i) for i in range(self.k)]
        self.tree = [-1] * self.k
        winner = [0] * (2 * self.k)
        winner[self.k :] = range(self.k)
        for node in range(self.k - 1, 0, -1):
            a, b = winner[2 * node], winner[2 * node + 1]
            winner[node], self.tree[node] = (a, b) if self._before(a, b) else (b, a)
        if self.k:
            self.tree[0] = winner[1] if self.k > 1 else 0

    def _next(self, i: int) -> tuple | None:
        row = next(self.runs[i], None)
        return None if row is None else (order(row), i, row)

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and x[:2] < y[:2])

    def __iter__(self) -> Iterator[tuple]:
        while self.k:
            top = self.tree[0]
            if self.heads[top] is None:
                return
            yield self.heads[top][2]
            self.heads[top] = self._next(top)
            node = (top + self.k) // 2
            while node:
                if self._before(self.tree[node], top):
                    self.tree[node], top = top, self.tree[node]
                node //= 2
            self.tree[0] = top


def merged(runs: DataFrame, ranges: int) -> DataFrame:
    """The captures with their `history_rank`, their place from 0 in the order of URL key, time and page over all archives.

    A range holds the parts of all runs between two bounds; a frequent URL key is split over
    ranges by time and page. Each range starts at the number of captures of those before it.
    """

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[str, list[tuple]] = {}
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                parts.setdefault(row[0], []).append(row)
        for rows in parts.values():  # the exchange keeps a run's order, unless it was read in several batches
            if any(order(x) > order(y) for x, y in itertools.pairwise(rows)):
                rows.sort(key=order)
        here, at, held = TaskContext.get().partitionId(), 0, []
        schema = pa.schema([*list(_arrow)[1:], ("part", pa.int64()), ("place", pa.int64())])

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({f.name: pa.array([r[k] for r in held], f.type) for k, f in enumerate(schema)}, schema=schema)

        for row in LoserTree([iter(parts[k]) for k in sorted(parts)]):
            held.append((*row[1:], here, at))
            at += 1
            if len(held) == 5000:
                yield out()
                held = []
        yield out()

    spread = runs.repartitionByRange(ranges, "url_key", "ts", "page_id")
    placed = written(spread.mapInArrow(merge, RUN.removeprefix("run string, ") + ", part long, place long"), "history")
    sizes = placed.groupBy("part").agg(F.count("*").alias("n"))
    # one row for each range, so one task can add them up
    starts = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("start"))
    return placed.join(small(starts, "starts"), "part").withColumn("history_rank", F.col("start") + F.col("place")).drop("part", "place", "start")


def archived(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write pages to archives in the shared folder, read them back and merge their index."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write(pages, path, least_bytes)
    runs = written(read_runs(spark, path), "runs")
    return merged(runs, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-runs.count() // RANGE_CAPTURES)))

"""Benchmark decontamination by templates: finds benchmark items in documents, also with other numbers, names and units.

Both sides are cut into tokens and made canonical: numbers, names and units after a number become
typed placeholders, whose values are kept aside as slots. A name is a run of capitalised words
with nothing but white space between them, wherever it stands, so the first word of a sentence is
one too. Windows of canonical tokens are joined by hash. Matches of one item in one document at
one offset must be consistent: over all their windows each slot value of the item stands for
one value in the document, and the other way round.

A window with few literal tokens says little as a template, so it stands only if it weighs
enough: its literal tokens by their rarity in the documents, its placeholders by kind. Items also
have windows of the tokens as they are: those find verbatim copies of any item, be it all numbers
or all names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ternway.llm.common import LOWER, bit_map, chunks, filter_bits, hashes, in_bit_map, mixed, release, spans_coded, texts, written

#: Tokens of a window, and the fewest that an item must have; in between an item is one window.
WINDOW, LEAST_TOKENS = 8, 3
#: Part of a template window's tokens, in eighths, that are literal in one that stands without being weighed.
LITERAL_EIGHTHS = 3
#: Bits from which on other template windows stand, and the bits of a number, name and unit in them. A literal token has
#: log2 of one by its share of the documents' tokens, counted as if PRIOR_TOKENS more had been seen, none of them this one.
LEAST_BITS, PLACEHOLDER_BITS, PRIOR_TOKENS = 30.0, (3.0, 2.0, 4.0), 1 << 16
#: Matching windows that make a leak, or all windows of an item that has fewer.
LEAK_WINDOWS = 6
#: Words that count as units after a number.
UNITS = "mm cm m km in inch inches ft foot feet yd yard yards mile miles mg g kg gram grams t ton tons lb lbs oz pound pounds ml l liter liters litre litres s sec second seconds min minute minutes h hour hours day days week weeks month months year years cent cents dollar dollars euro euros percent degree degrees mph kmh kwh w kw v a hz khz mhz ghz".split()
NUMBER, NAME, UNIT = 1, 2, 3
#: Bench windows up to this number, some 200 bytes each, go to all tasks of the join; beyond, the join shuffles.
BROADCAST_WINDOWS = 100_000
SLOT = "array<struct<t:int,v:long>>"
#: Distinct tokens that a task gathers before it sends their counts.
GATHERED = 1 << 20

_kind = np.zeros(256, np.uint8)
_kind[48:58] = 1
_operator = np.zeros(256, bool)
_operator[list(b"+-*/^=<>")] = True
_kind[65:91] = _kind[97:123] = _kind[128:] = 2
_space = np.zeros(256, bool)
_space[[9, 10, 11, 12, 13, 32]] = True


@dataclass
class Tokens:
    """Codes, kinds (0: literal) and value hashes of the tokens, and the first token of each text."""

    code: np.ndarray
    kind: np.ndarray
    value: np.ndarray
    first: np.ndarray


_units = np.sort(hashes(x.encode() for x in UNITS))


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[Tokens, Tokens]:
    """The texts as templates, and as they are but for the case of A-Z.

    Tokens are numbers, with points and commas inside them, runs of letters, and runs of
    operators between numbers or brackets of a calculation; characters of scripts without blanks
    between words are tokens of their own.
    """
    n = len(data)
    kind = _kind[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    if n > 2:  # a point or comma between digits belongs to the number
        inner = np.flatnonzero(((data[1:-1] == 46) | (data[1:-1] == 44)) & (kind[:-2] == 1) & (kind[2:] == 1) & ~edge[1 : n - 1] & ~edge[2:n]) + 1
        kind[inner] = 1
    signs = np.flatnonzero(_operator[data])
    if len(signs):
        solid = np.flatnonzero(~_space[data] & ~_operator[data])
        after = np.searchsorted(solid, signs)
        text = np.searchsorted(offsets, signs, "right") - 1
        left, right = solid[np.maximum(after - 1, 0)] if len(solid) else signs, np.append(solid, n)[after]
        inside = (after > 0) & (left >= offsets[text]) & (right < offsets[text + 1])
        near = (lambda at, bracket: (kind[at] == 1) | (data[at] == bracket))
        kind[signs[inside & near(left, 41) & near(np.minimum(right, n - 1), 40)]] = 3
    change = np.ones(n + 1, bool)
    change[1:n] = kind[1:] != kind[:-1]
    change |= edge
    second = np.append(data[1:], 0)[:n]
    # U+3000 to U+9FFF, and Thai and Lao
    alone = np.flatnonzero(((data >= 0xE3) & (data <= 0xE9)) | ((data == 0xE0) & (second >= 0xB8) & (second <= 0xBB)))
    change[alone] = True
    change[np.minimum(alone + 3, n)] = True
    start = np.flatnonzero(change[:n] & (kind > 0))
    stop = np.flatnonzero(change[1:] & (kind > 0)) + 1
    first = np.searchsorted(start, offsets)
    parts, a = [np.zeros(0, np.uint64)], 0
    while a < len(start):
        b = max(a + 1, int(np.searchsorted(stop, start[a] + (1 << 20), "right")))
        lo = start[a]
        words, which = spans_coded(LOWER[data[lo : stop[b - 1]]], start[a:b] - lo, stop[a:b] - lo)
        parts.append(hashes(words)[which])
        a = b
    value = np.concatenate(parts)
    plain = Tokens(value, np.zeros(len(start), np.uint8), value, first)
    if not len(start):
        return plain, plain
    head, second = data[start], second[start]
    number = kind[start] == 1
    name = ((head >= 65) & (head <= 90)) | ((head == 0xC3) & (second >= 0x80) & (second <= 0x9E))
    out = np.where(number, NUMBER, np.where(name, NAME, 0)).astype(np.uint8)
    after = np.flatnonzero(number[:-1]) + 1
    after = after[(out[after] == 0) & ~edge[start[after]] & ~np.isin(after, first)]
    out[after[np.isin(value[after], _units)]] = UNIT
    # names of several words are one token
    gaps = np.concatenate([[0], np.cumsum(~_space[data])])
    joined = np.zeros(len(start), bool)
    joined[1:] = name[1:] & name[:-1] & (gaps[start[1:]] == gaps[stop[:-1]])
    joined[first[:-1][first[:-1] < len(start)]] = False
    lead = np.flatnonzero(~joined)
    place = np.arange(len(start)) - np.repeat(lead, np.diff(np.append(lead, len(start))))
    whole = np.add.reduceat(mixed(value + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), lead)
    out, value = out[lead], np.where(out[lead] == NAME, whole, value[lead])
    code = np.where(out > 0, mixed(out.astype(np.uint64) + np.uint64(7)), value)
    return Tokens(code, out, value, np.searchsorted(lead, first)), plain


def rolled(t: Tokens, width: int, template: bool) -> tuple[np.ndarray, np.ndarray]:
    """Start tokens and hashes of all windows of `width` tokens within a text; of templates those with a literal token."""
    n = len(t.code) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = np.full(n, 2 * width + template, np.uint64)
    for k in range(width):
        h = h * np.uint64(0x9E3779B97F4A7C15) + t.code[k : k + n]
    text = np.repeat(np.arange(len(t.first) - 1), np.diff(t.first))
    good = text[:n] == text[width - 1 :]
    if template:
        literal = np.concatenate([[0], np.cumsum(t.kind == 0)])
        good &= literal[width:] > literal[:-width]
    at = np.flatnonzero(good)
    return at, mixed(h[at])


def few_literals(t: Tokens, at: np.ndarray, width: int, template: bool) -> np.ndarray:
    """Which windows must be weighed."""
    literal = np.concatenate([[0], np.cumsum(t.kind == 0)])
    return (8 * (literal[at + width] - literal[at]) < LITERAL_EIGHTHS * width) & template


def slots(t: Tokens, at: np.ndarray, width: int) -> pa.Array:
    """The kinds and values of the placeholders of windows, in order."""
    where = at[:, None] + np.arange(width)
    kinds = t.kind[where] if len(at) else np.zeros((0, width), np.uint8)
    on = kinds > 0
    inner = pa.StructArray.from_arrays([pa.array(kinds[on].astype(np.int32)), pa.array(t.value[where][on].view(np.int64) if len(at) else np.zeros(0, np.int64))], ["t", "v"])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(on.sum(1))]).astype(np.int32)), inner)


def item_windows(items: DataFrame, window: int, least: int) -> DataFrame:
    """(item_id, text_id, h, template, b_at, width, b_slots, weighed, fixed_bits, literals): all windows of the benchmark's items, as templates and as they are.

    items: (item_id, text, text_id). Of windows to be weighed, fixed_bits are those of the placeholders and literals the codes of the other tokens.
    """
    bits = np.array([0.0, *PLACEHOLDER_BITS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                ids, text_ids = np.asarray(part.column(0)), np.asarray(part.column(2))
                for template, t in zip((True, False), tokens(*texts(part.column(1))), strict=True):
                    size = np.diff(t.first)
                    for width in sorted({min(window, int(x)) for x in size if x >= least}):
                        at, h = rolled(t, width, template)
                        text = np.searchsorted(t.first, at, "right") - 1
                        own = np.minimum(size[text], window) == width
                        at, h, text = at[own], h[own], text[own]
                        weighed = few_literals(t, at, width, template)
                        where = at[:, None] + np.arange(width)
                        kinds = t.kind[where]
                        own = (kinds == 0) & weighed[:, None]
                        literals = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(own.sum(1))]).astype(np.int32)), pa.array(t.code[where][own].view(np.int64)))
                        columns = [pa.array(ids[text]), pa.array(text_ids[text]), pa.array(h.view(np.int64)), pa.array(np.full(len(at), template)), pa.array((at - t.first[text]).astype(np.int32)), pa.array(np.full(len(at), width, np.int32)), slots(t, at, width), pa.array(weighed), pa.array(bits[kinds].sum(1)), literals]
                        yield pa.RecordBatch.from_arrays(columns, ["item_id", "text_id", "h", "template", "b_at", "width", "b_slots", "weighed", "fixed_bits", "literals"])

    return items.mapInArrow(run, f"item_id long, text_id long, h long, template boolean, b_at int, width int, b_slots {SLOT}, weighed boolean, fixed_bits double, literals array<long>")


def token_counts(docs: DataFrame, wanted: DataFrame, bits: int) -> DataFrame:
    """(code, n): how often tokens whose code's bit is among those of `wanted` occur in documents (doc_id, text); and the number of all tokens under a null code."""
    shared = docs.sparkSession.sparkContext.broadcast(bit_map(wanted, bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have, total, held, size = shared.value, 0, [], 0

        def out() -> pa.RecordBatch:
            code, at = np.unique(np.concatenate([c for c, _ in held]), return_inverse=True)
            n = np.zeros(len(code), np.int64)
            np.add.at(n, at, np.concatenate([k for _, k in held]))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(code.view(np.int64)), pa.array(n)], ["code", "n"])

        for batch in batches:
            for part in chunks(batch):
                t = tokens(*texts(part.column(1)))[0]
                total += len(t.code)
                literal = t.code[t.kind == 0]
                held.append(np.unique(literal[in_bit_map(have, literal)], return_counts=True))
                size += len(held[-1][0])
                if size > GATHERED:
                    yield out()
                    size = 0
        if held:
            yield out()
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([total])], ["code", "n"])
        release()

    return docs.mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def standing(windows: DataFrame, docs: DataFrame, least_bits: float) -> DataFrame:
    """The windows that stand, with n_windows, how many of the item's text and kind these are, and n_sure, how many of them are not weighed."""
    weighed = windows.where("weighed").select("h", "fixed_bits", "literals").distinct()
    codes = weighed.select(F.explode("literals").alias("code")).distinct()
    n_codes = codes.count()
    light = windows.where("not weighed")
    if n_codes:
        counts = written(token_counts(docs, codes, filter_bits(n_codes)), "tokens")
        total = counts.where("code is null").select(F.coalesce(F.sum("n"), F.lit(0))).first()[0] + PRIOR_TOKENS
        one = weighed.select("h", "fixed_bits", F.explode("literals").alias("code")).join(counts, "code", "left")
        heavy = one.groupBy("h", "fixed_bits").agg(F.sum(F.log2(F.lit(float(total)) / (F.coalesce("n", F.lit(0)) + 1))).alias("bits")).where(F.col("bits") + F.col("fixed_bits") >= least_bits)
        light = light.unionByName(windows.where("weighed").join(heavy.select("h"), "h", "left_semi"))
    own = ["item_id", "text_id", "template"]
    sizes = light.groupBy(own).agg(F.count("*").cast("int").alias("n_windows"), F.count_if(~F.col("weighed")).cast("int").alias("n_sure"))
    return light.join(sizes, own).drop("fixed_bits", "literals")


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, least_tokens: int = LEAST_TOKENS, leak_windows: int = LEAK_WINDOWS, least_bits: float = LEAST_BITS) -> DataFrame:
    """(doc_id, item_id, n_windows, matched, verbatim): the benchmark items that documents hold.

    matched of an item's n_windows windows stand in the document at one offset, templates with
    consistent slots; a pair is a leak from `leak_windows` on, or with all windows of an item
    that has fewer. verbatim: windows of the tokens as they are make it one, and the counts are
    theirs; else they are those of the templates. Of several offsets the one that matches most
    counts. A template window with fewer than three literal tokens in eight must weigh
    `least_bits`, as LEAST_BITS says, so "Anna ran 5 km in 20 min" is found with other numbers and
    names where "ran" isn't a common token; one without any literal token says nothing. The
    windows that need no weight decide by themselves, too. Items of fewer than `least_tokens` tokens are
    no passage and give nothing, as do null texts and rows with a null id; repeated rows don't
    repeat results.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null").distinct()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    windows = written(item_windows(items.withColumn("text_id", F.xxhash64("text")), window, least_tokens), "windows")
    bench = written(standing(windows, docs, least_bits), "items")
    many = bench.agg(F.count("*").alias("n"), F.collect_set("width").alias("widths")).first()
    bits = filter_bits(many.n)
    shared = spark.sparkContext.broadcast((bit_map(bench.select("h"), bits), sorted(many.widths)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have, widths = shared.value
        for batch in batches:
            for part in chunks(batch):
                ids = np.asarray(part.column(0))
                for template, t in zip((True, False), tokens(*texts(part.column(1))), strict=True):
                    for width in widths:
                        at, h = rolled(t, width, template)
                        hit = np.flatnonzero(in_bit_map(have, h))
                        at, h = at[hit], h[hit]
                        text = np.searchsorted(t.first, at, "right") - 1
                        yield pa.RecordBatch.from_arrays([pa.array(ids[text]), pa.array(h.view(np.int64)), pa.array(at - t.first[text]), slots(t, at, width)], ["doc_id", "h", "d_at", "d_slots"])

    found = docs.mapInArrow(run, f"doc_id long, h long, d_at long, d_slots {SLOT}")
    both = found.join(F.broadcast(bench) if many.n <= BROADCAST_WINDOWS else bench, "h")
    pairs = F.zip_with("b_slots", "d_slots", lambda b, d: F.struct(b.t.alias("t"), b.v.alias("b"), d.v.alias("d")))
    one = ["doc_id", "item_id", "template", (F.col("d_at") - F.col("b_at")).alias("offset")]
    sure = ~F.col("weighed")
    group = both.groupBy(*one).agg(
        F.size(F.collect_set("b_at")).alias("matched"),
        F.size(F.collect_set(F.when(sure, F.col("b_at")))).alias("sure"),
        F.max("n_windows").alias("n_windows"),
        F.max("n_sure").alias("n_sure"),
        F.array_distinct(F.flatten(F.collect_set(pairs))).alias("pairs"),
        F.array_distinct(F.flatten(F.collect_set(F.when(sure, pairs)))).alias("sure_pairs"),
    )

    def consistent(pairs: str) -> Column:
        one_way = F.size(F.array_distinct(F.transform(pairs, lambda p: F.struct(p.t, p.b)))) == F.size(pairs)
        other_way = F.size(F.array_distinct(F.transform(pairs, lambda p: F.struct(p.t, p.d)))) == F.size(pairs)
        return one_way & other_way

    every = consistent("pairs") & (F.col("matched") >= F.least(F.lit(leak_windows), F.col("n_windows")))
    alone = consistent("sure_pairs") & (F.col("sure") > 0) & (F.col("sure") >= F.least(F.lit(leak_windows), F.col("n_sure")))
    count = F.when(every, F.struct("matched", "n_windows")).when(alone, F.struct(F.col("sure").alias("matched"), F.col("n_sure").alias("n_windows")))
    group = group.withColumn("count", count).where("count is not null")
    best = group.groupBy("doc_id", "item_id").agg(F.max(F.struct((~F.col("template")).alias("verbatim"), "count.matched", "count.n_windows")).alias("best"))
    return best.select("doc_id", "item_id", F.col("best.n_windows").alias("n_windows"), F.col("best.matched").alias("matched"), F.col("best.verbatim").alias("verbatim"))

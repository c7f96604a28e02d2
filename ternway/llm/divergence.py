"""How the words of a language's sources differ: divergences of all pairs of sources and the terms that mark each source.

Tasks count terms by (language, source) before anything is shuffled. Terms and sources are then
dealt into blocks by hash. A tile is a dense matrix of the shares of one block of terms in two
blocks of sources; all pairs of its sources are computed at once by broadcasting, and each
source keeps the best terms of the block. Partial sums of pairs are added up, partial best
lists merged. A term that is nowhere in a tile has a share too, the same for all such terms.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ternway.llm.common import LOWER, Words, chunks, texts, written

#: Documents of a language that a term must stand in.
LEAST_DOCS = 10
#: Terms and sources of a tile, by expectation; cells that are broadcast at a time; ranks of the part `term`.
TERMS, SOURCES, CELLS, TOP = 512, 64, 1 << 20, 10
#: Different keys after which a task hands over what it has counted.
PENDING = 1 << 20

_COUNTS = "lang string, source string, term string, n long, df long"
_TILES = "lang string, source string, part string, item string, value long"


def words() -> Words:
    """Runs of letters A-Z, a-z and of whatever is not ASCII, A-Z as a-z."""
    letter = np.zeros(256, bool)
    letter[65:91] = letter[97:123] = letter[128:] = True
    return Words(letter, LOWER)


def added(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, ascending, and the sums of the values of each."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return (keys[starts], *[np.add.reduceat(v[order], starts) if len(keys) else v for v in values])


class Counter:
    """Counts of terms by group, n places and df documents, over many texts."""

    def __init__(self) -> None:
        self.splitter = words()
        self.groups: dict[tuple[str, str], int] = {}
        self.terms: dict[bytes, int] = {}
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, langs: list[str], sources: list[str], data: np.ndarray, offsets: np.ndarray) -> None:
        group = np.fromiter((self.groups.setdefault(g, len(self.groups)) for g in zip(langs, sources, strict=True)), np.int64, len(langs))
        blocks, first = self.splitter.coded(data, offsets)
        coded = [np.zeros(0, np.int64)]
        for known, which in blocks:
            coded.append(np.fromiter((self.terms.setdefault(w, len(self.terms)) for w in known), np.int64, len(known))[which])
        term = np.concatenate(coded)
        # first by document, which gives df, then by group
        doc = np.repeat(np.arange(len(langs)), np.diff(first))
        key, n = added((doc << 32) | term, np.ones(len(term), np.int64))
        part = added((group[key >> 32] << 32) | (key & 0xFFFFFFFF), n, np.ones(len(n), np.int64))
        self.parts.append(part)
        self.size += len(part[0])
        if self.size > PENDING:
            self.merge()

    def merge(self) -> None:
        if self.parts:
            self.parts = [added(*(np.concatenate(c) for c in zip(*self.parts, strict=True)))]
            self.size = len(self.parts[0][0])

    def full(self) -> bool:
        return self.size > PENDING // 2 or len(self.terms) > PENDING // 2

    def batches(self) -> Iterator[pa.RecordBatch]:
        """What has been counted, then a row with an empty term for each group; nothing is kept."""
        self.merge()
        groups = pa.array([g for g, _ in self.groups], pa.string()), pa.array([s for _, s in self.groups], pa.string())
        term = pa.array([t.decode() for t in self.terms], pa.string())
        for key, n, df in self.parts:
            for at in range(0, len(key), 1 << 16):
                part = slice(at, at + (1 << 16))
                g, t = pa.array(key[part] >> 32), pa.array(key[part] & 0xFFFFFFFF)
                yield pa.RecordBatch.from_arrays([groups[0].take(g), groups[1].take(g), term.take(t), pa.array(n[part]), pa.array(df[part])], ["lang", "source", "term", "n", "df"])
        zero = pa.array(np.zeros(len(self.groups), np.int64))
        yield pa.RecordBatch.from_arrays([*groups, pa.array([""] * len(self.groups), pa.string()), zero, zero], ["lang", "source", "term", "n", "df"])
        self.__init__()


def counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, df): how often and in how many documents a term stands; an empty term for every group."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Counter()
        for batch in batches:
            for part in chunks(batch):
                c.add(part.column(0).to_pylist(), part.column(1).to_pylist(), *texts(part.column(2)))
                if c.full():
                    c.merge()
                    if c.full():
                        yield from c.batches()
        yield from c.batches()

    own = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")], "text")
    return own.mapInArrow(count, _COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def share(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(1000000000 * (count + 2) / total), exactly: long division by digits of base 1000, for totals up to 9e15."""
    rest, out = count + 2, np.int64(0)
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // total
        rest = rest % total
    return out + 1


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def tile(rows: pa.Table) -> pa.Table:
    """Partial values of all pairs of a tile's sources and, where both blocks of sources are one, each source's best terms.

    rows: (lang, a, b, block, source, term, n, n_all, kept, v): counts of terms, n_all that of the language;
    and for each source one with a null term, its sum of counts n, the language's n_all, the
    block's number of kept terms and the language's v.
    """
    column = lambda name: rows.column(name).combine_chunks()
    is_source = np.asarray(column("term").is_null())
    block, n, n_all, v, kept = (np.asarray(column(c)) for c in ("block", "n", "n_all", "v", "kept"))
    names = np.array(column("source").to_pylist(), object)
    lang, a, b = column("lang")[0].as_py(), column("a")[0].as_py(), column("b")[0].as_py()
    sources, at = np.unique(names[is_source], return_index=True)
    own = {s: k for k, s in enumerate(sources)}
    side, total = block[is_source][at], n[is_source][at] + 2 * v[is_source][at]
    left, right = np.flatnonzero(side == a), np.flatnonzero(side == b)
    out: list[tuple[str, str, str, int]] = []
    partial = np.zeros((len(left), len(right)), np.int64)
    here = ~is_source
    terms, t = np.unique(np.array(column("term").filter(pa.array(here)).to_pylist(), object), return_inverse=True)
    if here.any():
        s = np.fromiter((own[x] for x in names[here]), np.int64)
        p = np.repeat(share(np.zeros(len(total), np.int64), total)[:, None], len(terms), axis=1)
        p[s, t] = share(n[here], total[s])
        step = max(1, CELLS // max(1, partial.size))
        for k in range(0, len(terms), step):
            partial += apart(p[left, None, k : k + step], p[None, right, k : k + step]).sum(axis=2)
        if a == b:
            q = share(n_all[here], n_all[is_source][at][0] + 2 * v[is_source][at][0])
            more = np.flatnonzero((n[here] > 0) & (p[s, t] > q))
            f = apart(p[s, t][more], q[more])
            order = np.lexsort((t[more], -f, s[more]))  # np.unique sorts by code points, as UTF-8 bytes do
            ranked = s[more][order]
            place = np.arange(len(ranked)) - np.searchsorted(ranked, ranked, "left")
            out += [(sources[s[more][k]], "term", terms[t[more][k]], int(f[k])) for k in order[place < TOP]]
    unseen = int(kept[is_source][0]) - len(terms)
    if unseen:
        none = share(np.zeros(len(total), np.int64), total)
        partial += unseen * apart(none[left, None], none[None, right])
    out += [(sources[i], "pair", sources[j], int(partial[x, y])) for x, i in enumerate(left) for y, j in enumerate(right) if i < j or a != b]
    columns = list(zip(*out, strict=True)) or [[], [], [], []]
    return pa.table([pa.array([lang] * len(out), pa.string()), *[pa.array(c, pa.string()) for c in columns[:3]], pa.array(columns[3], pa.int64())], ["lang", "source", "part", "item", "value"])


def audit(docs: DataFrame) -> DataFrame:
    """(lang, source, part, item, value, rank): the divergence of each source from every other of its language, and its marking terms.

    Nulls count as empty: texts, languages and sources. Every (lang, source) that occurs is
    compared, also without terms; a language without kept terms has 0 for all its pairs, one
    with a single source no pairs. Repeated rows are documents of their own. An empty table
    gives no rows. Ties stand by the item's UTF-8 bytes.
    """
    all_of = Window.partitionBy("lang", "term")
    counted = counts(docs).withColumns({"n_all": F.sum("n").over(all_of), "df_all": F.sum("df").over(all_of)})
    rows = written(counted.where((F.col("term") == "") | (F.col("df_all") >= LEAST_DOCS)).drop("df", "df_all"), "term-counts")
    groups, terms = rows.where("term = ''").select("lang", "source"), rows.where("term <> ''")
    sums = groups.join(terms.groupBy("lang", "source").agg(F.sum("n").alias("n")), ["lang", "source"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    vocabulary = terms.groupBy("lang", "term").agg(F.first("n_all").alias("n_all"))
    langs = sums.groupBy("lang").agg(F.count("*").alias("sources")).join(vocabulary.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n_all").alias("of_lang")), "lang", "left").na.fill(0)
    langs = langs.select("lang", "v", "of_lang", F.greatest(F.ceil(F.col("v") / TERMS), F.lit(1)).alias("term_blocks"), F.ceil(F.col("sources") / SOURCES).alias("source_blocks"))
    # one row for each language, used four times
    langs = written(langs, "languages")

    block = F.pmod(F.xxhash64("source"), F.col("source_blocks"))
    term_block = F.pmod(F.xxhash64("term"), F.col("term_blocks"))
    others = F.explode(F.sequence(F.lit(0).cast("long"), F.col("source_blocks") - 1))
    pair = [F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b")]
    kept = vocabulary.join(langs, "lang").groupBy("lang", term_block.alias("t")).agg(F.count("*").alias("kept"))
    each = terms.join(langs, "lang").withColumns({"block": block, "t": term_block}).withColumn("other", others)
    each = each.select("lang", "t", *pair, "block", "source", "term", "n", "n_all", F.lit(0).cast("long").alias("kept"), "v")
    heads = sums.join(langs, "lang").withColumn("block", block).withColumn("other", others).withColumn("t", F.explode(F.sequence(F.lit(0).cast("long"), F.col("term_blocks") - 1)))
    heads = heads.join(kept, ["lang", "t"], "left").select("lang", "t", *pair, "block", "source", F.lit(None).cast("string").alias("term"), "n", F.col("of_lang").alias("n_all"), F.coalesce("kept", F.lit(0)).alias("kept"), "v")
    tiles = written(each.unionByName(heads).groupBy("lang", "t", "a", "b").applyInArrow(tile, _TILES), "tiles")

    both = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"))))
    pairs = tiles.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).select("lang", both.alias("two"), "value").select("lang", "two.source", F.lit("pair").alias("part"), "two.item", "value")
    best = tiles.where("part = 'term'").select("lang", "source", "part", "item", "value")
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    ranked = lambda r: r.withColumn("rank", rank)
    return ranked(pairs).unionByName(ranked(best).where(F.col("rank") <= TOP))

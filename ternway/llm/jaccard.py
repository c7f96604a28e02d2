"""Near-duplicate documents: an exact join of sets of word shingles by Jaccard similarity.

1.  Equal sets become one, which the smallest doc_id stands for.
2.  Shingles are counted over all texts. Bit maps of bounded size tell which occur in two texts or
    more, in 16 or more and in 256 or more. They rank the shingles, rare ones first. Any ranking
    that is the same for all sets gives exact results; this one keeps what documents share by
    chance, and passages of many documents, out of the index.
3.  Prefix index: two sets that are similar enough share one of the rarest shingles of each, so
    many that the rest alone couldn't make them similar. A shingle that only one text has needs
    no entry. The sets under one entry are compared by small bit maps, which bound from below in
    how many shingles two sets differ; those that the bound lets pass are joined to families
    (connected components). Where a task has merged sets under an entry, all sets there are one
    family. No pairs leave a task.
4.  Inside a family an inverted index counts the overlap of a set with others, with set relations
    to skip work: an entry lists sets by size, and a probe reads only the block of positions
    whose sizes can match; the counts of a set that is nearly the same as the one before are
    derived from that one's counts, by the few shingles in which they differ. A large family is
    dealt into blocks. First each block is compared with itself and with the family's first set;
    what links with that one needs no comparison with its like, so afterwards only the other
    sets meet all blocks. Only links that connect something new leave a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ternway.llm.common import bit_map, chunks, filter_bits, in_bit_map, joined, release, texts, white_space_words, windows, written
from ternway.llm.graph import Forest, components

#: Counts of texts from which a shingle ranks behind those below.
LEVELS = (2, 16, 256)
#: log2 of the bits of the largest map of counted shingles: with more shingles than bits the ranking gets worse, results stay.
MAP_BITS = 28
#: Sets of a family, and their shingles, of which one task compares so many with as many others.
BLOCK_SETS, BLOCK_SHINGLES = 400, 400_000
#: Index entries that a task gathers before it sends them, and how many of them a shingle must have to be merged there.
MERGE_ENTRIES, MERGE_FROM = 1 << 20, 64
#: Sets under one entry that are compared by bit maps; more are taken for one family as they are.
LIST_SETS = 2000
#: Shingles that a task counts in one slice of the hash space, at most about so many.
SLICE_SHINGLES = 1 << 21


def shingled(part: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of the texts of a batch (doc_id, text), and the n + 1 offsets."""
    h, first = white_space_words().hashed(*texts(part.column(1)))
    h, at = windows(h, first, width)
    sets = [np.unique(h[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
    return (np.concatenate(sets) if sets else h), np.cumsum([0, *map(len, sets)])


def sums(h: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit sums over the shingles of each set."""
    out = []
    for factor in (0xD6E8FEB86659FD93, 0xA3B195354A39B70D):
        total = np.zeros(len(h) + 1, np.uint64)
        np.cumsum((h ^ (h >> np.uint64(29))) * np.uint64(factor) ^ (h >> np.uint64(17)), out=total[1:])
        out.append((total[at[1:]] - total[at[:-1]]).view(np.int64))
    return out


def parities(own: np.ndarray) -> bytes:
    """A bit for each residue of the shingles, set if an odd number has it: twice as many bits as shingles, from 64 to 16384.

    Two maps differ in no more bits than the sets in shingles; xor of its halves makes a map of half the size.
    """
    size = 1 << int(np.clip(int(2 * len(own) - 1).bit_length(), 6, 14))
    return np.packbits(np.bincount((own & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1, bitorder="little").tobytes()


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n_shingles, s1, s2, bits): a set's size, two 64-bit sums, the same for equal sets, and its bit map."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                h, at = shingled(part, width)
                maps = [parities(h[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(at)), *map(pa.array, sums(h, at)), pa.array(maps, pa.binary())], ["doc_id", "n_shingles", "s1", "s2", "bits"])
        release()

    return docs.mapInArrow(run, "doc_id long, n_shingles long, s1 long, s2 long, bits binary")


def counted_shingles(docs: DataFrame, width: int, total: int) -> list[tuple[int, bytes]]:
    """For each of LEVELS log2 of a number of bits and the map of the shingles that so many texts have: a bit for the first bits of a hash.

    total: shingles of all texts, about. They are counted in slices of the hash space, by the
    slice and 32 more bits: tasks send each slice's distinct hashes and counts packed, so a
    frequent shingle is one entry for each of them. A slice is a part of each map, so no map is
    put together before the driver has them: MAP_BITS bound their size.
    """
    spark = docs.sparkSession
    bits = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) - 1, total // SLICE_SHINGLES).bit_length()
    bits = min(bits, 16)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        bounds = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)

        def out() -> pa.RecordBatch:
            squeeze = zstandard.ZstdCompressor(1)
            value, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            cuts = [0, *np.searchsorted(value, bounds).tolist(), len(value)]
            value = ((value << np.uint64(bits)) >> np.uint64(32)).astype(np.uint32)
            own = [(k, value[i:j], n[i:j]) for k, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if j > i]
            packed = [[squeeze.compress(x.astype(np.uint32).tobytes()) for x in (np.diff(v, prepend=v[:1] * 0), c)] for _, v, c in own]
            return pa.RecordBatch.from_arrays([pa.array([k for k, _, _ in own], pa.int32()), *[pa.array([p[i] for p in packed], pa.binary()) for i in (0, 1)]], ["slice", "value", "n"])

        for batch in batches:
            for part in chunks(batch):
                held.append(shingled(part, width)[0])
            if sum(map(len, held)) > MERGE_ENTRIES:
                yield out()
        if held:
            yield out()
        release()

    def add(key: tuple[int], group: pd.DataFrame) -> pd.DataFrame:
        open_ = zstandard.ZstdDecompressor()
        value = np.concatenate([np.cumsum(np.frombuffer(open_.decompress(x), np.uint32), dtype=np.uint32) for x in group.value])
        n = np.concatenate([np.frombuffer(open_.decompress(x), np.uint32) for x in group.n])
        order = np.argsort(value, kind="stable")
        value, n = value[order], n[order].astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
        value, n = value[first], np.add.reduceat(n, first)
        found = [value[n >= least] for least in LEVELS]
        return pd.DataFrame({"slice": [key[0]], "sizes": [[len(v) for v in found]], "values": [[v.tobytes() for v in found]]})

    rows = docs.mapInArrow(count, "slice int, value binary, n binary").groupBy("slice").applyInPandas(add, "slice int, sizes array<long>, values array<binary>")
    counted = written(rows, "counted")
    sizes = counted.select(*[F.sum(F.col("sizes")[k]).alias(f"n{k}") for k in range(len(LEVELS))]).first()
    maps = [min(MAP_BITS, max(bits + 3, filter_bits((n or 0) // 4))) for n in sizes]

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                parts = []
                for size, values in zip(maps, row["values"], strict=True):
                    on = np.zeros(1 << (size - bits), bool)
                    on[np.frombuffer(values, np.uint32) >> np.uint32(32 - (size - bits))] = True
                    parts.append(np.packbits(on).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([row["slice"]], pa.int32()), pa.array([parts], pa.list_(pa.binary()))], ["slice", "maps"])

    out = [np.zeros(1 << size >> 3, np.uint8) for size in maps]
    for row in counted.mapInArrow(segments, "slice int, maps array<binary>").toLocalIterator():
        for whole, part in zip(out, row.maps, strict=True):
            whole[row.slice * len(part) : (row.slice + 1) * len(part)] = np.frombuffer(part, np.uint8)
    return [(size, x.tobytes()) for size, x in zip(maps, out, strict=True)]


def levels_of(h: np.ndarray, maps: list[tuple[int, bytes]]) -> np.ndarray:
    """For each hash how many of the maps have it, counted from the first on."""
    level, on = np.zeros(len(h), np.uint8), np.arange(len(h))
    for size, have in maps:
        at = h[on] >> np.uint64(64 - size)
        byte = np.frombuffer(have, np.uint8)[(at >> np.uint64(3)).astype(np.int64)]
        on = on[((byte >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8)) & 1) == 1]
        level[on] += 1
    return level


ENTRY = "token long, doc long, low int, high int"


def merged_entries(token: np.ndarray, doc: np.ndarray, low: np.ndarray, high: np.ndarray, percent: int) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
    """Entries with one row for each token and range of sizes without a gap that rules links out, and the edges from the others to it.

    A row that stands for several sets, also for some of the same size, has a range with low < high; no other has.
    """
    order = np.lexsort((low, token))
    token, doc, low, high = token[order], doc[order], low[order], high[order]
    new = np.ones(len(token), bool)
    # ranges are sorted by their lower end; the largest upper end so far within a token decides
    group = np.cumsum(np.concatenate([[True], token[1:] != token[:-1]]))[: len(token)] if len(token) else np.zeros(0, np.int64)
    reach = np.maximum.accumulate(high.astype(np.int64) + (group << 32)) - (group << 32) if len(token) else high
    new[1:] = (token[1:] != token[:-1]) | (percent * low[1:].astype(np.int64) > 100 * reach[:-1])
    first = np.flatnonzero(new)
    leader = doc[first][np.cumsum(new) - 1] if len(first) else doc
    other = doc != leader
    edges = np.unique(np.stack([doc[other], leader[other]], 1), axis=0) if other.any() else np.zeros((0, 2), np.int64)
    if not len(first):
        return (token, doc, low, high), edges
    several = np.diff(np.append(first, len(token))) > 1
    return (token[first], doc[first], low[first], np.maximum(np.maximum.reduceat(high, first), low[first] + several.astype(low.dtype))), edges


def prefix_entries(docs: DataFrame, width: int, percent: int, levels) -> DataFrame:
    """Index entries of the prefixes of all sets, and edges (token and doc, sizes -1).

    Within a task equal sets have entries once, with edges from the others, and so have sets
    under one very frequent shingle; that is what keeps a hot entry small.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        seen: dict[tuple[int, int, int], int] = {}
        copies: list[tuple[int, int]] = []

        def rows(*columns: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["token", "doc", "low", "high"])

        def out() -> Iterator[pa.RecordBatch]:
            token, doc, size = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            seen.clear()
            _, which, count = np.unique(token, return_inverse=True, return_counts=True)
            many = count[which] > MERGE_FROM
            yield rows(token[~many], doc[~many], size[~many], size[~many])
            entries, edges = merged_entries(token[many], doc[many], size[many], size[many], percent)
            yield rows(*entries)
            edges = np.concatenate([edges, np.array(copies, np.int64).reshape(-1, 2)])
            copies.clear()
            none = np.full(len(edges), -1, np.int32)
            yield rows(edges[:, 0], edges[:, 1], none, none)

        for batch in batches:
            for part in chunks(batch):
                h, at = shingled(part, width)
                level = levels_of(h, levels.value)
                ids = np.asarray(part.column(0))
                tokens = []
                s1, s2 = (x.tolist() for x in sums(h, at))
                for k, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
                    n = b - a
                    first = seen.setdefault((int(n), s1[k], s2[k]), int(ids[k]))
                    if first != ids[k]:
                        if n:
                            copies.append((int(ids[k]), first))
                        tokens.append(h[:0])
                        continue
                    keep = n - -(-percent * n // 100) + 1 if n else 0
                    order = np.argsort(level[a:b], kind="stable")[:keep]
                    tokens.append(h[a:b][order[level[a:b][order] > 0]])  # what no other text has needs no entry
                count = np.array([len(x) for x in tokens], np.int64)
                if count.sum():
                    held.append((np.concatenate(tokens).view(np.int64), np.repeat(ids, count), np.repeat(np.diff(at).astype(np.int32), count)))
            if sum(len(x[0]) for x in held) > MERGE_ENTRIES:
                yield from out()
        if held:
            yield from out()
        release()

    return docs.mapInArrow(run, ENTRY)


LISTED = "list long, a long, b long"


def listed(percent: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From index entries sorted by token and size: (list, a) for the sets under an entry whose sizes leave no gap that rules links out, each list of sets once, and edges (a, b).

    A list with an entry that stands for several sets is a family as it is: the size and bit map of one don't speak for the others.
    """
    seen: set[int] = set()
    last, reach, members, hot = None, 0, [], False
    out: list[tuple[int | None, int, int | None]] = []

    def close() -> None:
        nonlocal members, hot
        own = sorted(set(members))
        if len(own) > 1 and not hot and (key := hash(tuple(own))) not in seen:
            if len(seen) > 200_000:
                seen.clear()
            seen.add(key)
            out.extend((key, d, None) for d in own)
        members, hot = [], False

    def rows() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(3)], ["list", "a", "b"])
        out.clear()
        return batch

    for batch in batches:
        token, doc, low, high = (np.asarray(batch.column(k)) for k in range(4))
        edge = low < 0
        out.extend((None, a, b) for a, b in zip(token[edge].tolist(), doc[edge].tolist(), strict=True))
        token, doc, low, high = (x[~edge] for x in (token, doc, low, high))
        same = np.zeros(len(token) + 1, bool)
        same[1:-1] = token[1:] == token[:-1]
        same[0] = len(token) > 0 and token[0] == last
        same[:-1] |= same[1:]  # entries of a token by themselves need no look
        if len(token):
            same[len(token) - 1] = True
        for k in np.flatnonzero(same[:-1]).tolist():
            if token[k] != last or percent * int(low[k]) > 100 * reach:
                close()
                last, reach = token[k], 0
            members.append(int(doc[k]))
            reach = max(reach, int(high[k]))
            if len(members) > LIST_SETS or hot or low[k] < high[k]:
                out.extend((None, d, members[0]) for d in members[1:])
                hot, members = True, members[:1]
        if len(out) > 20_000:
            yield rows()
    close()
    yield rows()


def compared(percent: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) that connect, within each list of sets (list, doc_id, n_shingles, bits), what the bit maps let pass."""
    key, held, out = None, [], []

    def close() -> None:
        if len(held) > 1:
            ids = [r[0] for r in held]
            label = passing(np.array([r[1] for r in held], np.int64), [r[2] for r in held], percent)
            out.extend((ids[k], ids[x]) for k, x in enumerate(label.tolist()) if x != k and ids[k] != ids[x])
        held.clear()

    def rows() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(2)], ["a", "b"])
        out.clear()
        return batch

    for batch in batches:
        for lst, doc, n, bits in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if lst != key:
                close()
                key = lst
            held.append((doc, n, bits))
        if len(out) > 20_000:
            yield rows()
    close()
    yield rows()


def passing(n: np.ndarray, maps: list[bytes], percent: int) -> np.ndarray:
    """For each set the index of a set that stands for its part: parts are connected by pairs whose sizes and bit maps allow a link."""
    label = np.arange(len(n))
    size = np.array([len(x) for x in maps])
    words = {b: np.frombuffer(b"".join(maps[k] for k in np.flatnonzero(size == b)), np.uint64).reshape(-1, b // 8) for b in np.unique(size).tolist()}
    for b, own in words.items():
        rows = np.flatnonzero(size == b)
        cols, other = rows, own
        if 2 * b in words:  # sizes within 4/3 of each other differ in one doubling at most
            wide = words[2 * b]
            cols, other = np.concatenate([rows, np.flatnonzero(size == 2 * b)]), np.concatenate([own, wide[:, : b // 8] ^ wide[:, b // 8 :]])
        step = max(1, (1 << 20) // other.size)
        for a in range(0, len(rows), step):
            part = rows[a : a + step]
            apart = np.bitwise_count(own[a : a + step, None, :] ^ other[None, :, :]).sum(2, dtype=np.int64)
            hit = (100 + percent) * apart <= (100 - percent) * (n[part, None] + n[None, cols])
            hit &= (percent * n[None, cols] <= 100 * n[part, None]) & (percent * n[part, None] <= 100 * n[None, cols])
            for i, row in zip(part.tolist(), hit, strict=True):
                near = label[cols[row]]
                if len(near) and (near != label[i]).any():
                    near = np.unique(np.append(near, label[i]))
                    label[np.isin(label, near)] = near[0]
    return label


class SizeIndex:
    """Inverted index of sets in ascending order of size: each shingle lists the positions of its sets, so a range of sizes is one block of a list."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.n = len(sets)
        tokens = np.concatenate([np.zeros(0, np.uint64), *sets])
        self.tokens, rank = np.unique(tokens, return_inverse=True)
        self.entries = np.sort(rank * self.n + np.repeat(np.arange(self.n), [len(x) for x in sets]))

    def counted(self, some: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """How many of some shingles each set at positions lo to hi has; other positions of the lists aren't read."""
        if lo >= hi or not len(some) or not len(self.tokens):
            return np.zeros(max(0, hi - lo), np.int64)
        rank = np.minimum(np.searchsorted(self.tokens, some), len(self.tokens) - 1)
        rank = rank[self.tokens[rank] == some] * self.n
        first, last = np.searchsorted(self.entries, rank + lo), np.searchsorted(self.entries, rank + hi)
        width = last - first
        at = np.repeat(first - (np.cumsum(width) - width), width) + np.arange(int(width.sum()))
        return np.bincount(self.entries[at] % self.n - lo, minlength=hi - lo)


def overlap_links(sets: list[np.ndarray], probes: range, against: range, percent: int) -> Iterator[tuple[int, int]]:
    """Pairs (i, j), i of probes and j of against, that link.

    Sets are sorted arrays; those of `against` stand in ascending order of size. A probe reads
    the blocks of positions whose sizes can match. Where the probe before differs in fewer
    shingles than this one has, the counts of positions that both look at are derived from its.
    """
    index = SizeIndex([sets[j] for j in against])
    size = np.array([len(sets[j]) for j in against], np.int64)
    before, counts, low, high = None, None, 0, 0
    for i in sorted(probes, key=lambda k: (sets[k][:2].tolist(), k)):
        own = sets[i]
        lo = int(np.searchsorted(100 * size, percent * len(own), "left"))
        hi = int(np.searchsorted(percent * size, 100 * len(own), "right"))
        gone = come = None
        if before is not None and abs(len(before) - len(own)) < len(own) // 2 and min(hi, high) > max(lo, low):
            gone, come = np.setdiff1d(before, own, assume_unique=True), np.setdiff1d(own, before, assume_unique=True)
        if gone is not None and len(gone) + len(come) < len(own):
            a, b = max(lo, low), min(hi, high)
            both = counts[a - low : b - low] - index.counted(gone, a, b) + index.counted(come, a, b)
            counts = np.concatenate([index.counted(own, lo, a), both, index.counted(own, b, hi)])
        else:
            counts = index.counted(own, lo, hi)
        before, low, high = own, lo, hi
        hit = np.flatnonzero(100 * counts >= percent * (len(own) + size[lo:hi] - counts)) + lo + against.start
        yield from ((i, int(j)) for j in hit if j != i)


def family_sets(members: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """The members (doc, ...) of families with their shingles; docs that a bit map rules out are not shuffled."""
    ids = members.select(F.xxhash64("doc").alias("h"))
    shared = docs.sparkSession.sparkContext.broadcast(bit_map(ids, filter_bits(members.count())))

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = batch.filter(pa.array(in_bit_map(shared.value, np.asarray(batch.column(2)))))
            for part in chunks(keep):
                h, at = shingled(part, width)
                own = [h[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(own, pa.binary())], ["doc", "shingles"])
        release()

    docs = docs.select("doc_id", "text", F.xxhash64("doc_id").alias("h")).mapInArrow(likely, "doc long, shingles binary")
    return docs.join(members, "doc")


def linked(group: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links that connect something new between the sets of side 0 and those of side 1, or among those of side 0 if there is no other."""
    own = [np.frombuffer(s, np.uint64) for s in group.shingles]
    side, doc = group.side.to_numpy(), group.doc.to_numpy()
    order = sorted(range(len(own)), key=lambda k: (side[k], len(own[k]), doc[k]))
    own, ids = [own[k] for k in order], [int(doc[k]) for k in order]
    cut, forest = int((side == 0).sum()), Forest()
    pairs = overlap_links(own, range(cut), range(cut, len(own)) if cut < len(own) else range(cut), percent)
    new = [(ids[i], ids[j]) for i, j in pairs if ids[i] != ids[j] and forest.join(ids[i], ids[j])]
    return pd.DataFrame(new, columns=["a", "b"]).astype("int64")


def family_links(members: DataFrame, docs: DataFrame, width: int, percent: int, block: int) -> DataFrame:
    """Links (a, b) that connect what is connected within families, of members (doc, family, n_shingles).

    A family of at most `block` sets and BLOCK_SHINGLES shingles is one task. In larger ones
    every block is compared with itself and with the family's first set. Sets that are connected
    with that one so far are the core, which is one component already; the others meet all
    blocks of the family.
    """
    blocks = F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES))
    sizes = members.groupBy("family").agg(F.count("*").alias("n"), blocks.cast("int").alias("blocks"), F.min("doc").alias("first")).where("n > 1").drop("n")
    dealt = members.join(sizes, "family").withColumn("block", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int")).drop("n_shingles")
    dealt = written(family_sets(written(dealt, "members"), docs, width), "blocks")

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        return linked(group, percent)

    inside = dealt.select("family", F.col("block").alias("x"), "doc", F.lit(0).alias("side"), "shingles").groupBy("family", "x").applyInPandas(compare, "a long, b long")
    large = dealt.where("blocks > 1")
    if large.isEmpty():
        return inside
    inside = written(inside, "inside")
    # the first set of a large family goes to all its blocks, once each
    firsts = large.where("doc = first").dropDuplicates(["doc"]).select("family", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("x"), "doc", F.lit(0).alias("side"), "shingles")
    others = large.where("doc <> first").select("family", F.col("block").alias("x"), "doc", F.lit(1).alias("side"), "shingles")
    to_first = written(firsts.unionByName(others).groupBy("family", "x").applyInPandas(compare, "a long, b long"), "to-first")
    so_far = inside.unionByName(to_first)
    core = components(so_far, "core").select(F.col("id").alias("doc"), F.col("component").alias("first"))
    outer = written(large.join(core, ["doc", "first"], "left_anti").where("doc <> first"), "outer")
    probes = outer.select("family", "blocks", F.col("block").alias("x"), F.lit(0).alias("side"), "doc", "shingles", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("y"))
    here = outer.select("family", F.col("block").alias("x")).distinct()
    against = large.join(here, "family").where("block <> x").select("family", "blocks", "x", F.lit(1).alias("side"), "doc", "shingles", F.col("block").alias("y"))
    across = probes.where("x <> y").unionByName(against).groupBy("family", "x", "y").applyInPandas(compare, "a long, b long")
    return so_far.unionByName(across)


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 75, block: int = BLOCK_SETS) -> DataFrame:
    """(doc_id, n_shingles, component_id): documents connected by links of 100 * overlap >= percent * union.

    Texts are lower-cased in A-Z and cut at ASCII white space into words; a set holds the
    distinct runs of `width` words, by 64-bit hashes, or the whole sequence of a shorter text. A
    null or blank text has an empty set, which links with nothing, so the document is its own
    component. component_id is the smallest doc_id that links reach. Repeated rows come out
    repeated, several texts of one doc_id count as one document; a row with a null doc_id has a
    null component and links with nothing. Other columns don't matter.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sized = written(signatures(docs, width), "sets")
    known = sized.where("doc_id is not null and n_shingles > 0")
    leaders = written(known.groupBy("n_shingles", "s1", "s2").agg(F.min("doc_id").alias("leader"), F.count("*").alias("copies")), "leaders")

    named = docs.where("doc_id is not null")
    total = known.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    levels = spark.sparkContext.broadcast(counted_shingles(named, width, total))
    entries = prefix_entries(named, width, percent, levels).repartition("token").sortWithinPartitions("token", "low")

    found = written(entries.mapInArrow(partial(listed, percent), LISTED), "lists")
    levels.unpersist()
    lists = found.where("list is not null").select("list", F.col("a").alias("doc_id")).distinct()
    maps = sized.where("doc_id is not null").select("doc_id", "n_shingles", "bits")
    lists = lists.join(maps, "doc_id").select("list", "doc_id", "n_shingles", "bits").repartition("list").sortWithinPartitions("list")
    edges = found.where("list is null").select("a", "b").unionByName(lists.mapInArrow(partial(compared, percent), "a long, b long"))
    families = components(edges, "families")
    # equal sets are one: only the leader of each stands for them inside a family
    single = leaders.groupBy(F.col("leader").alias("doc_id")).agg(F.max("n_shingles").alias("n_shingles"))
    members = families.join(single, families.id == single.doc_id).select(F.col("id").alias("doc"), F.col("component").alias("family"), "n_shingles")
    links = components(family_links(members, named, width, percent, block), "links")
    out = joined(sized, leaders.where("copies > 1"), ["n_shingles", "s1", "s2"], "copies", "doc_id").withColumn("leader", F.coalesce("leader", "doc_id"))
    out = out.join(links.withColumnRenamed("id", "leader"), "leader", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "leader")).alias("component_id"))

"""Byte-level BPE: exact encoding by dynamic programming over prefixes, and decoding.

Every text is cut into pieces by the pattern of the tokenizer; merges never cross pieces, so
each distinct piece is encoded once per Python worker and remembered, found by its bytes. The
cutting and the assembly of the ids are array operations over about half a megabyte of text at
a time; longer texts are cut where a word ends and a blank and a word follow, which is the end of
a piece in any text.

For each prefix of a piece there is exactly one token with which the encoding of that prefix
ends. An automaton over the vocabulary gives the tokens that are suffixes of the prefix,
longest first; the right one is the first that is compatible with the last token of the prefix
before it, which means that the two, encoded together, stay as they are. The stored last
tokens are the back-pointers from which the ids are read.

The automaton and the classes of characters are made once on the driver, from the tokenizer's
file, and broadcast as arrays: a few megabytes, which grow with the vocabulary alone.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import itertools
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ternway.llm.common import CHUNK_BYTES, chunks, release, texts

#: Pieces that a Python worker remembers before it starts anew, and their bytes.
CACHE_PIECES, CACHE_BYTES = 300_000, 1 << 23
LETTER, NUMBER, SPACE, OTHER, MARK = range(5)


def tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def character_classes() -> np.ndarray:
    """For each code point whether the byte-level pattern takes it for a letter, a number, white space or other.

    The `regex` module proposes the classes; the tokenizers library, whose Unicode version may be older, decides.
    """
    from tokenizers.pre_tokenizers import ByteLevel

    points = np.concatenate([np.arange(0xD800), np.arange(0xE000, 0x110000)])
    every = points.astype("<u4").tobytes().decode("utf-32-le")
    classes = np.full(0x110000, OTHER, np.uint8)
    cut = ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
    for kind, name, before in ((LETTER, r"\p{L}+", "a"), (NUMBER, r"\p{N}+", "1")):
        for run in regex.finditer(name, every):
            for a in range(run.start(), run.end(), 2000):
                found = points[a : min(a + 2000, run.end())]
                spans = {span for _, span in cut("".join(f"{before}{chr(c)}\n" for c in found))}
                classes[[c for k, c in enumerate(found) if (3 * k, 3 * k + 2) in spans]] = kind
    for c in (ord(x) for x in regex.findall(r"\s|[\x1c-\x1f]", every)):
        if len(cut(f"{chr(c)}{chr(c)}b")) == 3 or c == 0x20:
            classes[c] = SPACE
    return classes


#: What the pattern takes from a word after an apostrophe.
SUFFIXES = ("s", "t", "re", "ve", "m", "ll", "d")


def cut_points(points: np.ndarray, classes: np.ndarray, segment: np.ndarray) -> np.ndarray:
    """Where the pieces of consecutive segments start, by the byte-level pattern's rules.

    points: code points; segment: starts of the segments, which no piece crosses.
    """
    n = len(points)
    kind = classes[points]
    edge = np.zeros(n + 1, bool)
    edge[segment] = True
    edge[n] = True
    start = edge[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    run = np.flatnonzero(start)
    # A single blank before a run belongs to it; before it, longer white space ends one character earlier.
    after = run[(kind[run] != SPACE) & ~edge[run]]
    after = after[kind[after - 1] == SPACE]
    start[after - 1] = True
    blank = after[points[after - 1] == 32]
    start[blank] = False
    # Contractions: an apostrophe by itself that no blank was joined to, and a letter run after it.
    quote = run[(points[run] == 39) & start[run]]
    quote = quote[quote + 1 < n]
    quote = quote[(kind[quote + 1] == LETTER) & ~edge[quote + 1]]
    for suffix in SUFFIXES:
        size = len(suffix)
        at = quote[quote + size < n]
        for k, letter in enumerate(suffix, 1):
            at = at[(points[at + k] == ord(letter)) & ~edge[at + k]]
        start[at + 1] = False
        rest = at[(at + size + 1 < n)] + size + 1
        start[rest[kind[rest] == LETTER]] = True
    return np.flatnonzero(start)


def safe_cuts(data: np.ndarray, size: int = CHUNK_BYTES) -> list[int]:
    """Places about `size` bytes apart, from 0 to the end, where a piece starts whatever stands before: blanks between ASCII letters or digits."""
    plain = _PLAIN[data]
    cuts, n = [0], len(data)
    while n - cuts[-1] > size:
        at = cuts[-1] + size
        while at < n:
            part = slice(at, min(at + size, n - 1))
            found = np.flatnonzero((data[part] == 32) & plain[part.start - 1 : part.stop - 1] & plain[part.start + 1 : part.stop + 1])
            if len(found):
                cuts.append(at + int(found[0]))
                break
            at += size
        else:
            break
    return [*cuts, n]


_PLAIN = np.zeros(256, bool)
_PLAIN[48:58] = _PLAIN[65:91] = _PLAIN[97:123] = True


class PieceCache:
    """Ids of the pieces seen so far, found by the pieces' bytes."""

    def __init__(self, tables: Tables, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], most: int = CACHE_PIECES) -> None:
        self.classes, self.encode, self.most = tables.classes, encode, most
        self.specials = list(tables.specials)
        self.special = re.compile("|".join(map(re.escape, self.specials))) if self.specials else None
        self.clear()

    def clear(self) -> None:
        self.slot: dict[bytes, int] = {}
        self.bytes = 0
        self.start, self.size = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int32)
        self.flat, self.used = np.zeros(1 << 14, np.uint32), 0

    def _add(self, pieces: list[bytes]) -> None:
        ids, sizes = self.encode(pieces)
        a, b = len(self.slot), len(self.slot) + len(pieces)
        while b > len(self.start):
            self.start, self.size = np.resize(self.start, 2 * len(self.start)), np.resize(self.size, 2 * len(self.size))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.size[a:b] = sizes
        self.start[a:b] = self.used + np.cumsum(sizes) - sizes
        self.flat[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        self.bytes += sum(map(len, pieces))
        self.slot.update(zip(pieces, range(a, b), strict=True))

    def encoded(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts, one after the other, and the n + 1 offsets of the texts into them."""
        if len(data) <= 2 * CHUNK_BYTES:
            return self._encoded(data, offsets)
        parts, sizes = [], []
        for a, b in zip(offsets[:-1], offsets[1:], strict=True):
            found = list(self.streamed(data[a:b]))
            parts += found
            sizes.append(sum(map(len, found)))
        return np.concatenate(parts or [np.zeros(0, np.uint32)]), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)

    def streamed(self, text: np.ndarray) -> Iterator[np.ndarray]:
        """Ids of one text, block by block."""
        cuts = safe_cuts(text)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield self._encoded(text[a:b], np.array([0, b - a]))[0]

    def _encoded(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(data) == 0:
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        raw = data.tobytes()
        try:
            text = raw.decode("utf-8")
        except UnicodeDecodeError:
            parts = [raw[a:b].decode("utf-8", "replace").encode() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            raw, offsets = b"".join(parts), np.cumsum([0, *map(len, parts)])
            text, data = raw.decode(), np.frombuffer(raw, np.uint8)
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        n = len(points)
        place = np.flatnonzero((data & 0xC0) != 0x80) if n < len(data) else None  # of each character among the bytes
        at = offsets if place is None else np.searchsorted(place, offsets)
        segment, marks = at[at < n], []
        if self.special and any(x in text for x in self.specials):
            for d in range(len(at) - 1):
                marks += [(at[d] + m.start(), at[d] + m.end()) for m in self.special.finditer(text[at[d] : at[d + 1]])]
            segment = np.unique(np.concatenate([segment, [x for m in marks for x in m if x < n]])).astype(np.int64)
        start = cut_points(points, self.classes, segment)
        if marks:
            inside = np.zeros(n, bool)
            for a, b in marks:
                inside[a + 1 : b] = True
            start = start[~inside[start]]
        ends = np.append(start if place is None else place[start], len(data)).astype(np.int64)
        coded = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(raw)]).dictionary_encode()
        pieces, which = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), np.asarray(coded.indices)
        if self.slot and (len(self.slot) + len(pieces) > self.most or self.bytes > CACHE_BYTES):
            self.clear()
        slots = np.fromiter(map(self.slot.get, pieces, itertools.repeat(-1)), np.int64, len(pieces))
        if len(new := np.flatnonzero(slots < 0)):
            slots[new] = np.arange(len(self.slot), len(self.slot) + len(new))
            self._add([pieces[k] for k in new])
        slots = slots[which]
        size = self.size[slots].astype(np.int64)
        ends = np.cumsum(size)
        ids = self.flat[np.repeat(self.start[slots] - (ends - size), size) + np.arange(int(ends[-1]))]
        total = np.concatenate([[0], ends])
        return ids, total[np.searchsorted(start, at)]


def library_encoder(v: Tables, path: str) -> Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]:
    """Encodes pieces with the tokenizers library's model; they are cut already, so its pattern need not look at them again."""
    tokenize = tokenizer(path).model.tokenize
    specials = {x.encode(): [i] for x, i in v.specials.items()}
    letters = {b: c for c, b in byte_alphabet().items()}
    letters[0xFF] = "\n"  # stands between the pieces: no byte of UTF-8 and no letter of the alphabet
    table = "".join(letters[b] for b in range(256))

    def encode(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        written = b"\xff".join(pieces).decode("latin-1").translate(table).split("\n")
        out = [specials[x] if x in specials else [t.id for t in tokenize(w)] for x, w in zip(pieces, written, strict=True)]
        sizes = np.fromiter(map(len, out), np.int64, len(out))
        return np.fromiter(itertools.chain.from_iterable(out), np.uint32, int(sizes.sum())), sizes

    return encode


def byte_alphabet() -> dict[str, int]:
    """The printable characters by which byte-level vocabularies write the 256 bytes."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(keep)]
    return {chr(b): b for b in keep} | {chr(256 + k): b for k, b in enumerate(rest)}


class Tables:
    """What encoding needs of a tokenizer's file, as arrays.

    Tokens stand in the order of their merges: 256 bytes first, then the result of each merge.
    """

    def __init__(self, path: str) -> None:
        model = json.load(open(path, encoding="utf-8"))
        vocab, merges = model["model"]["vocab"], model["model"]["merges"]
        alphabet = byte_alphabet()
        names = [next(c for c, b in alphabet.items() if b == k) for k in range(256)]
        number = {x: k for k, x in enumerate(names)}
        left, right = list(range(256)), list(range(256))
        for a, b in (m.split(" ") if isinstance(m, str) else m for m in merges):
            if a + b not in number:
                number[a + b] = len(left)
                left.append(number[a])
                right.append(number[b])
        parts = [bytes(alphabet[c] for c in x) for x in number]
        self.left, self.right = np.array(left, np.int64), np.array(right, np.int64)
        self.size = np.array([len(x) for x in parts], np.int64)
        self.id = np.array([vocab.get(x, 0) for x in number], np.uint32)
        self.n = len(parts)
        keys = (self.left[256:] << 32) | self.right[256:]
        order = np.argsort(keys)
        self.pair_keys, self.pair_token = keys[order], order + 256
        self.specials = {x["content"]: x["id"] for x in model["added_tokens"]}
        self.classes = character_classes()
        self._automaton(parts)
        by_id = dict(zip(self.id.tolist(), parts, strict=True)) | {i: x.encode() for x, i in self.specials.items()}
        parts = [by_id.get(i, b"") for i in range(max(by_id) + 1)]
        self.flat, self.flat_at = np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0, *map(len, parts)])

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if not k.startswith("cache_")}

    def _automaton(self, parts: list[bytes]) -> None:
        """The automaton's states are the tokens' prefixes, numbered by length; for each the longest token that ends it."""
        flat = np.frombuffer(b"".join(parts), np.uint8).astype(np.int64)
        begin = np.cumsum(self.size) - self.size
        state = np.zeros(self.n, np.int64)
        alive, states, keys, to, parent, token = np.arange(self.n), 1, [], [], [0], {}
        for depth in range(int(self.size.max())):
            alive = alive[self.size[alive] > depth]
            own, which = np.unique((state[alive] << 8) | flat[begin[alive] + depth], return_inverse=True)
            state[alive] = states + which
            keys.append(own)
            to.append(np.arange(states, states + len(own)))
            states += len(own)
        self.step_keys, self.step_to = np.concatenate(keys), np.concatenate(to)
        ends = np.full(states, -1, np.int64)
        ends[state] = np.arange(self.n)
        order = np.argsort(self.step_keys)
        self.step_keys, self.step_to = self.step_keys[order], self.step_to[order]
        self.fail, self.longest, self.shorter = np.zeros(states, np.int64), np.full(states, -1, np.int64), np.full(self.n, -1, np.int64)
        for own, new in zip(keys, to, strict=True):  # by length: what a state falls back to is shorter
            up = own >> 8
            self.fail[new] = np.where(up > 0, self.step(self.fail[up], own & 255), 0)
            behind = self.longest[self.fail[new]]
            mine = ends[new]
            self.shorter[mine[mine >= 0]] = behind[mine >= 0]
            self.longest[new] = np.where(mine >= 0, mine, behind)

    def step(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        state, todo = state.copy(), np.arange(len(state))
        while len(todo):
            key = (state[todo] << 8) | byte[todo]
            at = np.minimum(np.searchsorted(self.step_keys, key), len(self.step_keys) - 1)
            hit = self.step_keys[at] == key
            state[todo[hit]] = self.step_to[at[hit]]
            todo = todo[~hit]
            state[todo] = self.fail[state[todo]]
        return state

    def merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The token that two tokens merge to, or a number above all tokens."""
        key = (a << 32) | b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_token[at], self.n)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether two tokens side by side are their own encoding.

        Undoing merges from the last on, no pair that stood at the seam may have merged before
        the merge that was undone. Of equal rank, the pair on the left comes first.
        """
        a, b = a.copy(), b.copy()
        ok = np.zeros(len(a), bool)
        limit = np.full(len(a), self.n, np.int64)
        todo = np.arange(len(a))
        while len(todo):
            x, y = a[todo], b[todo]
            todo = todo[self.merged(x, y) >= limit[todo]]
            x, y = a[todo], b[todo]
            left = (x >= 256) & ((x > y) | (y < 256))
            right = ~left & (y >= 256)
            ok[todo[~left & ~right]] = True
            # the left token's last merge must come before the seam's; ties go to the left
            limit[todo[left]], a[todo[left]] = x[left], self.right[x[left]]
            limit[todo[right]], b[todo[right]] = y[right] + 1, self.left[y[right]]
            todo = todo[left | right]
        return ok

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, one piece after the other, and the number of ids of each."""
        size = np.array([len(x) for x in pieces], np.int64)
        order = np.argsort(-size, kind="stable")
        parts, counts = [np.zeros(0, np.uint32)], [np.zeros(np.count_nonzero(size == 0), np.int64)]
        a, end = 0, int(np.count_nonzero(size))
        while a < end:
            longest = int(size[order[a]])
            b = a + int(np.searchsorted(-size[order[a:end]], -(longest // 2), "left")) if longest > 32 else end
            b = min(max(b, a + 1), a + max(1, (1 << 20) // longest))
            flat, own = self._encode([pieces[k] for k in order[a:b]], size[order[a:b]])
            parts.append(flat)
            counts.insert(-1, own)
            a = b
        flat, sizes = np.concatenate(parts), np.empty(len(pieces), np.int64)
        counts = np.concatenate(counts)
        sizes[order] = counts
        begin = np.empty(len(pieces), np.int64)
        begin[order] = np.cumsum(counts) - counts
        ends = np.cumsum(sizes)
        return flat[np.repeat(begin - (ends - sizes), sizes) + np.arange(len(flat))], sizes

    def _encode(self, pieces: list[bytes], size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of pieces in falling order of length, so that those that go on are always in front."""
        n, width = len(pieces), int(size[0])
        text = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in pieces), np.uint8).reshape(n, width).T.astype(np.int64)
        last = np.zeros((width + 1, n), np.int32)
        state = np.zeros(n, np.int64)
        for p in range(width):
            on = int(np.searchsorted(-size, -p, "left"))
            state = self.step(state[:on], text[p, :on])
            token, todo = self.longest[state], np.arange(on)
            while len(todo):
                before = p + 1 - self.size[token[todo]]
                inner = np.flatnonzero(before > 0)
                lanes = todo[inner]
                bad = lanes[~self.compatible(last[before[inner], lanes].astype(np.int64), token[lanes])]
                token[bad] = self.shorter[token[bad]]
                todo = bad
            last[p + 1, :on] = token
        out, at, lanes = [], size.copy(), np.flatnonzero(size > 0)
        while len(lanes):
            token = last[at[lanes], lanes]
            row = np.full(n, -1, np.int64)
            row[lanes] = token
            out.append(row)
            at[lanes] -= self.size[token]
            lanes = lanes[at[lanes] > 0]
        back = np.array(out[::-1], np.int64).T
        keep = back >= 0
        return self.id[back[keep]], keep.sum(1)


@functools.lru_cache(maxsize=1)
def tables(path: str) -> Tables:
    return Tables(path)


def prefix_encoder(v: Tables) -> Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]:
    """Encodes pieces by the dynamic programming of this module."""
    specials = {x.encode(): i for x, i in v.specials.items()}

    def encode(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        marks = [(k, specials[x]) for k, x in enumerate(pieces) if x in specials]
        if not marks:
            return v.encode(pieces)
        ids, sizes = v.encode([b"" if x in specials else x for x in pieces])
        at = np.cumsum(sizes)[[k for k, _ in marks]]
        sizes[[k for k, _ in marks]] = 1
        return np.insert(ids, at, [i for _, i in marks]), sizes

    return encode


def piece_cache(v: Tables, library: str | None = None) -> PieceCache:
    """A worker's cache for tables that it has from the driver: it lives as long as they do. library: the tokenizer's file, to encode with the library."""
    name = f"cache_{bool(library)}"
    if name not in v.__dict__:
        v.__dict__[name] = PieceCache(v, library_encoder(v, library) if library else prefix_encoder(v))
    return v.__dict__[name]


def shared_tables(docs: DataFrame, path: str):
    return docs.sparkSession.sparkContext.broadcast(tables(path))


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encode(docs: DataFrame, path: str, library: bool = False) -> DataFrame:
    """(doc_id, ids): the token ids of each text, without special tokens added.

    path: the tokenizer's file, with library at the same place on all machines. Only doc_id and
    text of the input count. A null or empty text has no ids; rows are kept as they are, repeated
    or null doc_id included. The literal text of a special token is that token, as in the library.
    """
    shared = shared_tables(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = piece_cache(shared.value, path if library else None)
        for batch in batches:
            for part in chunks(batch):
                ids, offsets = cache.encoded(*texts(part.column(1)))
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], ["doc_id", "ids"])
        release()

    return _plain(docs).mapInArrow(run, "doc_id long, ids array<int>")


def gathered(flat: np.ndarray, at: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entries of a table of byte strings (flat, n + 1 offsets) at some places, one after the other, and their ends."""
    size = at[ids + 1] - at[ids]
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(at[ids] - (ends - size), size) + np.arange(total)], ends


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text): the texts of ids as `encode` returns them.

    Null ids give an empty text, as no ids do; bytes that are no UTF-8 become U+FFFD.
    """
    shared = shared_tables(encoded, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for batch in batches:
            column = batch.column(1)
            lengths = np.array(pc.fill_null(pc.list_value_length(column), 0), np.int64)
            bounds = np.concatenate([[0], np.cumsum(lengths)])
            ids = np.asarray(column.flatten()).astype(np.int64)
            a = 0
            while a < len(lengths):
                b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + (1 << 18), "right")) - 1)
                data, ends = gathered(v.flat, v.flat_at, ids[bounds[a] : bounds[b]])
                data = data.tobytes()
                at = np.concatenate([[0], ends])[bounds[a : b + 1] - bounds[a]].tolist()
                out = [data[x:y].decode("utf-8", "replace") for x, y in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(out, pa.string())], ["doc_id", "text"])
                a = b

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


class Digests:
    """Of one text's ids, block by block: their number, the digest of their decimal texts and that of what they decode to."""

    def __init__(self, v: Tables, numbers: tuple[np.ndarray, np.ndarray]) -> None:
        self.v, self.numbers, self.n = v, numbers, 0
        self.ids, self.text, self.decoder = hashlib.sha256(), hashlib.sha256(), codecs.getincrementaldecoder("utf-8")("replace")

    def add(self, ids: np.ndarray) -> None:
        if not len(ids):
            return
        listed = gathered(*self.numbers, ids)[0].tobytes()  # each with a comma in front
        self.ids.update(listed if self.n else listed[1:])
        self.text.update(self.decoder.decode(gathered(self.v.flat, self.v.flat_at, ids)[0].tobytes()).encode())
        self.n += len(ids)

    def row(self) -> tuple[int, str, str]:
        self.text.update(self.decoder.decode(b"", True).encode())
        return self.n, self.ids.hexdigest(), self.text.hexdigest()


def digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each text: encoded and decoded again, block by block.

    As `encode` and `decode` one after the other, without rows of ids between them. ids_sha256 is
    that of the ids in decimal with commas between them.
    """
    shared = shared_tables(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        cache = piece_cache(v)
        listed = [f",{i}".encode() for i in range(len(v.flat_at) - 1)]
        numbers = np.frombuffer(b"".join(listed), np.uint8), np.cumsum([0, *map(len, listed)])
        for batch in batches:
            for part in chunks(batch):
                data, offsets = texts(part.column(1))
                rows = []
                if len(data) > 2 * CHUNK_BYTES:
                    blocks = [cache.streamed(data[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                else:
                    ids, at = cache.encoded(data, offsets)
                    blocks = [(ids[a:b],) for a, b in zip(at[:-1], at[1:], strict=True)]
                for own in blocks:
                    one = Digests(v, numbers)
                    for ids in own:
                        one.add(ids)
                    rows.append(one.row())
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.string(), pa.string()))]], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        release()

    return _plain(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

"""License scan: an Aho-Corasick automaton finds notice phrases and identifier tags in the words of a text; licence expressions after a tag are parsed by the shunting-yard method."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ternway.llm.common import chunks, texts

#: The base phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Notice phrases and their labels beyond the base ones.
NOTICES = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "boost software license": "bsl",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge": "mit",
    "permission to use copy modify and or distribute this software": "isc",
    "isc license": "isc",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0",
    "cc0 1 0": "cc0",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "licensed under the apache license": "apache",
    "all rights reserved": "proprietary",
}
#: The words of a tag; what stands before them, as in SPDX-License-Identifier, doesn't matter.
TAGS = ("license identifier",)
#: Beginnings of licence identifiers and their labels, longer ones first.
FAMILIES = {"lgpl": "lgpl", "agpl": "agpl", "gpl": "gpl", "apache": "apache", "cc-by": "cc-by", "cc0": "cc0", "mit": "mit", "mpl": "mpl", "epl": "epl", "bsl": "bsl", "bsd": "bsd", "0bsd": "bsd", "isc": "isc", "unlicense": "unlicense"}
#: How sure a find of each kind makes, on its own.
WEIGHT = {"base": 0.6, "notice": 0.6, "tag": 0.95}

_LETTER = np.zeros(256, bool)
_LETTER[48:58] = _LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_FOLD = bytes((b + 32 if 65 <= b < 91 else b) if _LETTER[b] else 32 for b in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_TOKEN = re.compile(r"\(|\)|[A-Za-z0-9][A-Za-z0-9.+:-]*")
#: What may stand between a tag and its expression.
_BEFORE = re.compile(r"[ \t:=\"']*")
_BLANKS = re.compile(r"[ \t]*")
PRECEDENCE = {"with": 3, "and": 2, "or": 1}


class Bad(ValueError):
    """The text is no licence expression."""


def parse(text: str, at: int = 0) -> tuple[list[str], int]:
    """The longest licence expression at a place of a text, in postfix order, and where it ends: at the end of the line at the latest.

    Identifiers stand between the operators with, and, or (any case), which bind in that order.
    What follows the expression doesn't matter; without one, Bad is raised.
    """
    out: list[str] = []
    stack: list[str] = []
    good: tuple[int, list[str], int] | None = None
    operand = True
    begin, depth = at, 0
    while (m := _BLANKS.match(text, at)) is not None and (t := _TOKEN.match(text, m.end())):
        word, low = t.group(), t.group().lower()
        if operand:
            if word == "(":
                stack.append(word)
                depth += 1
            elif word == ")" or low in PRECEDENCE:
                break
            else:
                out.append(word.rstrip(".:"))
                operand = False
        elif word == ")":
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                break
            stack.pop()
            depth -= 1
        elif low in PRECEDENCE:
            while stack and stack[-1] != "(" and PRECEDENCE[stack[-1]] >= PRECEDENCE[low]:
                out.append(stack.pop())
            stack.append(low)
            operand = True
        else:
            break
        at = t.end()
        if not operand and not depth:
            good = (len(out), stack[::-1], at)
    if good is None:
        raise Bad(text[begin : begin + 80])
    return [*out[: good[0]], *good[1]], good[2]


def label(identifier: str) -> str:
    low = identifier.lower()
    return next((v for k, v in FAMILIES.items() if low.startswith(k)), low)


def evaluate(postfix: list[str]) -> set[str]:
    """The choices that an expression leaves, one for each side of its outermost `or`s.

    A choice is what holds together, sorted and joined by +; a part that leaves a choice of its
    own stands in brackets, its sides sorted and joined by ` or `. Nothing is multiplied out, so
    a choice is as long as its part of the expression. An exception after `with` adds nothing.
    """
    stack: list[tuple[str, set[str]]] = []

    def inside(node: tuple[str, set[str]], operator: str) -> set[str]:
        """What a node adds to one of another operator."""
        own, parts = node
        if own == operator or len(parts) == 1:
            return parts
        return {"(" + " or ".join(sorted(parts)) + ")"} if own == "or" else {"+".join(sorted(parts))}

    for x in postfix:
        if x not in PRECEDENCE:
            stack.append(("", {label(x)}))
            continue
        b, a = stack.pop(), stack.pop()
        if x != "with":
            less, more = sorted((inside(a, x), inside(b, x)), key=len)
            more |= less
            a = (x, more)
        stack.append(a)
    return inside(stack.pop(), "or")


def named(postfix: list[str]) -> set[str]:
    """The labels of an expression's licences, without exceptions after `with`."""
    stack: list[tuple[int, int]] = []
    skipped: set[int] = set()
    for k, x in enumerate(postfix):
        if x not in PRECEDENCE:
            stack.append((k, k))
            continue
        b, a = stack.pop(), stack.pop()
        if x == "with":
            skipped.update(range(b[0], b[1] + 1))
        stack.append((a[0], k))
    return {label(x) for k, x in enumerate(postfix) if x not in PRECEDENCE and k not in skipped}


@functools.lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for kind, phrases in (("notice", NOTICES), ("tag", dict.fromkeys(TAGS, "")), ("base", BASE)):
        for phrase, name in phrases.items():
            found.add_word(f" {phrase} ", (kind, name, len(phrase)))
    found.make_automaton()
    return found


def scan(raw: bytes, inner: bytes) -> tuple:
    """Finds in one text: raw is the text, inner its words in lower case with one blank around each."""
    n_words = inner.count(b" ") - 1
    line = inner.decode("latin-1")
    base, first, last, base_labels, labels, doubt, choices = 0, None, None, set(), set(), 1.0, set()
    start = at = 0
    plain, ends = "", []
    for end, (kind, name, size) in automaton().iter(line):
        begin = end - size - 1
        at += line.count(" ", start, begin) - line.count(" ", begin, start)
        start = begin
        doubt *= 1 - WEIGHT[kind]
        if kind == "tag":
            if not ends:  # where each word ends, found once; a character for each byte, as only ASCII matters here
                plain, ends = raw.decode("latin-1"), [m.end() for m in _WORD.finditer(raw)]
            try:
                postfix, _ = parse(plain, _BEFORE.match(plain, ends[at + line.count(" ", begin, end) - 1]).end())
            except Bad:
                continue
            choices |= evaluate(postfix)
            labels |= named(postfix)
            continue
        labels.add(name)
        if kind == "base":
            base += 1
            first = at if first is None else min(first, at)
            last = at if last is None else max(last, at)
            base_labels.add(name)
    return n_words, base, first, last, ",".join(sorted(base_labels)), ",".join(sorted(labels)), 1 - doubt, sorted(choices)


OUT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, choices array<string>"


def licenses(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, choices) of every text.

    Words are runs of digits, letters and non-ASCII characters, A-Z in lower case; a null text is
    empty. n_base counts all places of base phrases, first_word and last_word are the smallest
    and largest word at which one starts, null without one. labels hold those of all finds,
    identifiers of tagged expressions included; choices lists what the expressions leave to
    choose between, as evaluate says. score grows with the number and weight of the finds, 0
    without any. Rows are kept as they are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                data, offsets = texts(part.column(1))
                raw = data.tobytes()
                folded = raw.translate(_FOLD)
                rows = []
                for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    words = folded[a:b].split()
                    rows.append(scan(raw[a:b], b" " + b" ".join(words) + b" ") if words else (0, 0, None, None, "", "", 0.0, []))
                types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.string())]
                columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], [x.split()[0] for x in OUT.split(", ")])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, OUT)

"""Personal data in texts: patterns propose spans, checksums and ranges confirm them, words nearby weigh them.

All patterns look at ASCII only, so they run over UTF-8 bytes; positions are code points in the
results. Each is written so that it takes linear time over a text of any length: a run of
characters is taken at once and nothing starts in the middle of one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ternway.llm.common import chunks, texts

#: Kinds whose spans always stay, in their order, then those that must reach LEAST_SCORE.
BASE = ("email", "ip", "card", "phone")
MORE = ("card_part", "iban", "phone_local", "ssn")
LEAST_SCORE = 0.5
#: What a confirmed span of a kind is worth without any words nearby.
WORTH = {"email": 0.8, "ip": 0.6, "card": 0.7, "phone": 0.6, "card_part": 0.45, "iban": 0.9, "phone_local": 0.25, "ssn": 0.4}
#: What a fitting word nearby adds and an unfitting one takes, and how many bytes before and after a span are looked at.
STEP, BEFORE, AFTER = 0.3, 48, 24

# fixed values: words that speak for a kind
_PHONE = b"phone tel telephone mobile cell fax call telefon handy rufnummer telefono movil llame portable appelez"
_CARD = b"card credit debit visa mastercard amex payment karte kreditkarte tarjeta carte"
FITTING = {
    "email": b"email mail contact write address kontakt correo courriel",
    "ip": b"ip host server address client login adresse direccion",
    "card": _CARD,
    "card_part": _CARD,
    "phone": _PHONE,
    "phone_local": _PHONE,
    "iban": b"iban bank account konto bic swift cuenta compte",
    "ssn": b"ssn social security taxpayer",
}
FITTING = {k: frozenset(v.split()) for k, v in FITTING.items()}
#: Words that speak against any kind.
UNFITTING = frozenset(b"version isbn issn doi sku order invoice tracking serial part model test dummy".split())

_DOMAIN = re.compile(rb"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_IP = re.compile(rb"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CHAIN = re.compile(rb"[0-9](?:[ -]?[0-9])++")
_PLUS = re.compile(rb"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(rb"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
_LOCAL_PHONE = re.compile(rb"(?<![0-9+.-])\(?[0-9]{2,5}\)?[ /-]{1,2}[0-9]{3,4}(?:[ -]?[0-9]{2,4}){1,2}(?![0-9-]|\.[0-9])")
_SSN = re.compile(rb"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_RUN = re.compile(rb"[0-9]++")
_WORD = re.compile(rb"[a-z]++")
_NOT_DIGITS = bytes(set(range(256)) - set(b"0123456789"))

#: Lengths of account numbers by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28,
    "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26,
    "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18,
    "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TN": 24, "TR": 26, "UA": 29, "VG": 24, "XK": 20,
}


def digits(text: bytes) -> bytes:
    return text.translate(None, _NOT_DIGITS)


def luhn(number: bytes) -> bool:
    """Whether a number of digits has a right check digit."""
    values = [c - 48 for c in number[::-1]]
    return (sum(values[::2]) + sum((2 * v) // 10 + (2 * v) % 10 for v in values[1::2])) % 10 == 0


def card_number(number: bytes) -> bool:
    return 13 <= len(number) <= 19 and luhn(number)


def mod_97(account: bytes) -> bool:
    """Whether an account number, its blanks left out, has right check digits."""
    turned = account[4:] + account[:4]
    return int("".join(str(int(chr(c), 36)) for c in turned)) % 97 == 1


def emails(text: bytes) -> Iterator[tuple[int, int]]:
    """Spans of addresses: what stands before each @ with a domain, back to the last address."""
    last = 0
    for m in _DOMAIN.finditer(text):
        before = text[last : m.start()]
        size = len(before) - len(before.rstrip(_LOCAL))
        if size:
            yield m.start() - size, m.end()
        last = m.end() if size else m.start() + 1


def addresses(text: bytes) -> Iterator[tuple[int, int]]:
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p or b"0") <= 255 for p in (x.lstrip(b"0") for x in m.group().split(b"."))):
            yield m.span()


def chains(text: bytes) -> Iterator[tuple[str, int, int]]:
    """Cards, and within chains of more digits than a card has runs that are card numbers by themselves."""
    for m in _CHAIN.finditer(text):
        number = digits(m.group())
        if card_number(number):
            yield "card", *m.span()
        elif len(number) > 19:
            for r in _RUN.finditer(text, *m.span()):
                if card_number(r.group()):
                    yield "card_part", *r.span()


def phones(text: bytes) -> Iterator[tuple[int, int]]:
    for m in _PLUS.finditer(text):
        if 9 <= len(digits(m.group())) <= 15:
            yield m.span()


def accounts(text: bytes) -> Iterator[tuple[int, int]]:
    for m in _IBAN.finditer(text):
        size = IBAN_LENGTHS.get(m.group()[:2].decode(), 0)
        at, seen = m.start(), 0
        while at < m.end() and seen < size:
            seen += text[at] != 32
            at += 1
        if size and seen == size and not text[at : at + 1].isalnum() and mod_97(text[m.start() : at].replace(b" ", b"")):
            yield m.start(), at


def local_phones(text: bytes) -> Iterator[tuple[int, int]]:
    for m in _LOCAL_PHONE.finditer(text):
        if 9 <= len(digits(m.group())) <= 12:
            yield m.span()


def security_numbers(text: bytes) -> Iterator[tuple[int, int]]:
    for m in _SSN.finditer(text):
        area, group, serial = m.group().split(b"-")
        if area not in (b"000", b"666") and area < b"900" and group != b"00" and serial != b"0000":
            yield m.span()


def score(text: bytes, kind: str, start: int, stop: int) -> float:
    """What a confirmed span is worth, by the words near it: 0 to 1."""
    near = {*_WORD.findall(text[max(0, start - BEFORE) : start].lower()), *_WORD.findall(text[stop : stop + AFTER].lower())}
    return min(1.0, max(0.0, round(WORTH[kind] + STEP * (not near.isdisjoint(FITTING[kind])) - STEP * (not near.isdisjoint(UNFITTING)), 2)))


def spans(text: bytes) -> list[tuple[str, int, int, float]]:
    """(kind, start, stop, score) in bytes of a text: base kinds first, in their order, then the others; each by its start.

    A span of another kind stays only with a score of LEAST_SCORE and where no base span nor an
    earlier kind's overlaps it.
    """
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in (*BASE, *MORE)}
    if b"@" in text:
        found["email"] = list(emails(text))
    if _RUN.search(text):
        for kind, a, b in chains(text):
            found[kind].append((a, b))
        for kind, f in (("ip", addresses), ("phone", phones), ("iban", accounts), ("phone_local", local_phones), ("ssn", security_numbers)):
            found[kind] = list(f(text))
    out = [(k, a, b, score(text, k, a, b)) for k in BASE for a, b in found[k]]
    if not any(found[k] for k in MORE):
        return out
    taken = sorted((a, b) for _, a, b, _ in out)
    for k in MORE:
        fresh = [(k, a, b, s) for a, b in found[k] for s in [score(text, k, a, b)] if s >= LEAST_SCORE]
        fresh = [x for x, free in zip(fresh, apart([x[1:3] for x in fresh], taken), strict=True) if free]
        out += fresh
        taken = sorted(taken + [x[1:3] for x in fresh])
    return out


def apart(these: list[tuple[int, int]], others: list[tuple[int, int]]) -> list[bool]:
    """For each span whether it overlaps none of the others, which are sorted by their starts."""
    if not others:
        return [True] * len(these)
    starts = np.array([a for a, _ in others])
    reach = np.maximum.accumulate([b for _, b in others])  # how far spans go that start no later
    before = np.searchsorted(starts, [b for _, b in these], "left")
    return [k == 0 or reach[k - 1] <= a for k, (a, _) in zip(before.tolist(), these, strict=True)]


def code_points(text: bytes, at: list[int]) -> list[int]:
    """Positions in bytes as positions in code points."""
    if text.isascii() or not at:
        return at
    lead = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
    return lead[at].tolist()


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("base", pa.bool_())]))


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, spans): for each row the spans of its whole text, as array<struct<kind, start, end, score, base>>.

    Null and empty texts have none. Rows and ids are kept as they are, repeated and null ones
    too; other columns are not read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                data, offsets = texts(part.column(1))
                rows = []
                for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    text = data[a:b].tobytes()
                    found = spans(text)
                    at = code_points(text, [p for _, start, stop, _ in found for p in (start, stop)])
                    rows.append([{"kind": k, "start": x, "end": y, "score": s, "base": k in BASE} for (k, _, _, s), x, y in zip(found, at[::2], at[1::2], strict=True)])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, _SPANS)], ["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(look, f"doc_id {kind}, spans array<struct<kind:string,start:long,end:long,score:double,base:boolean>>")


def redact(docs: DataFrame) -> DataFrame:
    """Documents with every span of `find` replaced by its kind in brackets; overlapping spans become one, under the first's kind. Null texts stay null."""

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.schema.get_field_index("text")
            for part in chunks(batch):
                column = part.column(place)
                data, offsets = texts(column)
                rows = [redacted(data[a:b].tobytes()).decode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                new = pa.array([r if ok else None for r, ok in zip(rows, column.is_valid().to_pylist(), strict=True)], column.type)
                yield pa.RecordBatch.from_arrays([new if k == place else c for k, c in enumerate(part.columns)], part.schema.names)

    return docs.mapInArrow(clean, docs.schema)


def redacted(text: bytes) -> bytes:
    out, at = [], 0
    for kind, start, stop, _ in sorted(spans(text), key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]".encode()]
        at = max(at, stop)
    return b"".join([*out, text[at:]])


def digested(found: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans, score) from the result of `find`; score is the highest of a text, 0 without any."""
    listed = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", x.kind, x.start.cast("string"), x.end.cast("string"))), ",")
    base = F.filter("spans", lambda s: s.base)
    number = lambda kind: F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long")
    return found.select(
        "doc_id",
        *[number(k).alias(f"n_{k}") for k in BASE],
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
        F.size("spans").cast("long").alias("n_spans"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s.score)), F.lit(0.0)).alias("score"),
    )

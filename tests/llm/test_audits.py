"""Whitening, personal data and divergences against plain versions."""

import hashlib
import math
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from ternway.llm import divergence, pii, queries, whitening

# --- whitening


def plain_grid(vectors):
    """x of the vectors that count, by their keys, as Python's integers."""
    kept = [(k, v) for k, v in vectors if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    width = max((len(v) for _, v in kept), default=0)
    return [(k, [math.floor(64 * c) + 1_000_000 for c in v] + [1_000_000] * (width - len(v))) for k, v in kept]


def plain_whitening(vectors):
    """(n, deviations by place, variances, directions) from fractions."""
    x = [r for _, r in plain_grid(vectors)]
    n = len(x)
    s = [sum(c) for c in zip(*x, strict=True)]
    y = np.array([[n * a - b for a, b in zip(r, s, strict=True)] for r in x], object)
    v = np.array([[float(Fraction(int(c), n**3)) for c in row] for row in y.T @ y])
    values, vectors = np.linalg.eigh(v)
    return n, [int(d) for d in (y**2).sum(axis=1)], values[::-1], vectors[:, ::-1], y, float(np.trace(v))


def check_whitening(spark, vectors):
    frame = spark.createDataFrame([(k, v, 1, [2.0]) for k, v in vectors], "vec_id long, embedding array<float>, n int, whitened array<double>").repartition(3)
    vectors = [(r.vec_id, r.embedding) for r in frame.collect()]
    got = whitening.whitened(frame).toPandas()
    n, far, values, directions, y, trace = plain_whitening(vectors)
    k = min(32, int((values > 1e-12 * values[0]).sum()))
    assert len(got) == n * k and set(got.n) == {n} and set(got.component) == set(range(1, k + 1))
    assert sorted(map(int, got[got.component == 1].deviation)) == sorted(far)
    assert (got.identity_error < 1e-4).all() and got.identity_error.nunique() == 1
    for c in range(1, k + 1):
        own = got[got.component == c]
        assert np.allclose(own.explained, values[c - 1] / trace, rtol=1e-6)
        expected = np.array([float(e) for e in (y.astype(float) / n) @ directions[:, c - 1] / np.sqrt(values[c - 1])])
        if np.isclose(values, values[c - 1], rtol=1e-6).sum() == 1:
            a, b = np.sort(own.whitened.to_numpy()), np.sort(expected)
            assert min(np.abs(a - b).max(), np.abs(a + b[::-1]).max()) < 1e-6
    return got


def test_whitening_of_odd_vectors(spark):
    rng = np.random.default_rng(4)
    rows = [(k, rng.normal(size=5).tolist()) for k in range(40)]
    rows += [(None, rows[0][1]), (3, rows[3][1]), (90, None), (91, [1.0, None, 0.0, 0.0, 0.0]), (92, [float("nan")] * 5), (93, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (94, [0.0] * 5), (95, [1.5, 2.5]), (96, [])]
    got = check_whitening(spark, rows)
    assert {94, 95, 96} <= set(got.vec_id.dropna()) and not {90, 91, 92, 93} & set(got.vec_id.dropna())


def test_whitening_of_large_entries(spark):
    """Entries of many limbs: sums of squares go beyond 64 bits."""
    rng = np.random.default_rng(5)
    rows = [(k, (rng.normal(size=3) * 10.0 ** rng.integers(0, 12, 3)).tolist()) for k in range(50)]
    check_whitening(spark, rows)


def test_whitening_without_variance(spark):
    kind = "vec_id long, embedding array<float>"
    for rows in ([], [(1, None)], [(1, [])], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        assert whitening.whitened(spark.createDataFrame(rows, kind)).count() == 0
    flat = whitening.whitened(spark.createDataFrame([(1, [1.0, 5.0]), (2, [2.0, 5.0])], kind)).collect()
    assert sorted((r.vec_id, r.component, round(r.whitened**2, 9), r.explained) for r in flat) == [(1, 1, 1.0, 1.0), (2, 1, 1.0, 1.0)]


def test_limbs_are_exact():
    rng = random.Random(1)
    for bits in (3, 19, 20, 21, 40, 61, 90, 130):
        y = np.array([[rng.randrange(-(1 << bits), 1 << bits) for _ in range(3)] for _ in range(50)], object)
        y = y.astype(np.int64) if bits < 62 else y
        got = whitening.recombined(whitening.products(y))
        assert (got == y.astype(object).T @ y.astype(object)).all()


def test_whitening_query(spark):
    data = "/root/testdata/sf0.001"
    got = queries.op11_whitening(spark, data).toPandas()
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()]
    n, far, values, directions, y, trace = plain_whitening(rows)
    assert len(got) == 32 * n and got.identity_error.iloc[0] < 1e-9
    wide = got.pivot(index="vec_id", columns="component", values="whitened").loc[[k for k, _ in rows]].to_numpy()
    expected = (y.astype(float) / n) @ directions[:, :32] / np.sqrt(values[:32])
    assert np.allclose(wide * np.sign((wide * expected).sum(axis=0)), expected, atol=1e-6)
    assert dict(zip(got.vec_id, got.deviation, strict=True)) == {k: d for (k, _), d in zip(rows, far, strict=True)}
    assert np.allclose(got.groupby("component").explained.first(), values[:32] / trace, rtol=1e-9)


# --- personal data

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_luhn(number):
    total = 0
    for k, c in enumerate(reversed(number)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def plain_base(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            number = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m.group().split(".")) if kind == "ip" else None, "card": 13 <= len(number) <= 19 and plain_luhn(number), "phone": 9 <= len(number) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def base_of(spans):
    return [(s[0], s[1], s[2]) for s in spans if s[0] in pii.BASE]


def test_base_spans_are_the_patterns():
    rng = random.Random(7)
    bits = ["a", "bob", "@", "x.y", ".", "-", "_", "%", "+", "1", "12", "255", "256", "007", " ", "  ", "(", ")", "é", "日", "\n", "4111 1111 1111 1111", "4111111111111111", "5500-0000-0000-0004", "+49 30 1234567", "10.0.0.1", "me@site.org", "A"]
    for _ in range(4000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))
        raw = text.encode()
        found = pii.spans(raw)
        at = pii.code_points(raw, [p for s in found for p in s[1:3]])
        assert [(k, x, y) for (k, *_), x, y in zip(found, at[::2], at[1::2], strict=True) if k in pii.BASE] == plain_base(text), text


@pytest.mark.parametrize("unit", ["x", "1", "1.", "@", "a@b", "+", "+1(", "1 ", "DE", "DE44 ", "12-", "a@b.", "é"])
def test_long_runs_take_linear_time(unit):
    import time

    text = (unit * 600_000).encode()
    began = time.time()
    pii.spans(text)
    assert time.time() - began < 20


def test_more_kinds():
    found = lambda t: {(k, t.encode()[a:b].decode()) for k, a, b, _ in pii.spans(t.encode())}
    assert found("IBAN DE89 3704 0044 0532 0130 00 AND MORE") == {("iban", "DE89 3704 0044 0532 0130 00")}
    assert found("IBAN DE88 3704 0044 0532 0130 00") == set()
    assert found("his social security number is 123-45-6789.") == {("ssn", "123-45-6789")}
    assert found("part 123-45-6789") == found("ssn 000-45-6789") == found("ssn 123-45-6789-1") == set()
    assert found("call 030 1234 5678 now") == {("phone_local", "030 1234 5678")} and found("about 030 1234 5678 now") == set()
    assert found("cards 4111111111111111 5500000000000004") == set()
    assert found("pay by card 4111111111111111 5500000000000004") == {("card_part", "4111111111111111"), ("card_part", "5500000000000004")}


def test_words_nearby_weigh():
    score = lambda t: pii.spans(t.encode())[0][3]
    assert score("server 10.0.0.1") > score("so 10.0.0.1") > score("version 10.0.0.1")


def test_redacted():
    assert pii.redacted("é mail bob@site.org or +49 (30) 1234567.".encode()).decode() == "é mail [EMAIL] or [PHONE]."


def test_pii_of_odd_documents(spark, odd, empty):
    more = [(20, "mail é bob@site.org 4111111111111111"), (20, "10.0.0.1"), (None, "+49 30 12345678"), (21, "1" * 9000 + "." + "2" * 5000 + ".3.4"), (22, None)]
    docs = odd.unionByName(spark.createDataFrame([(k, t, None, "s", 0, 1.0, [1], "l") for k, t in more], odd.schema))
    got = pii.digested(pii.find(docs)).collect()
    assert len(got) == docs.count() and pii.digested(pii.find(empty)).count() == 0
    digest = lambda spans: hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
    plain = sorted((str(r.doc_id), digest(plain_base(r.text if len(r.text or "") < 9_999 or r.doc_id != 21 else ""))) for r in docs.collect())
    assert sorted((str(r.doc_id), r.base_sha256) for r in got) == plain
    clean = pii.redact(docs)
    assert clean.columns == docs.columns and clean.where("doc_id = 20").count() == 2 and clean.where("text is null").count() == 2
    assert pii.digested(pii.find(clean)).where("n_spans > 0").count() == 0


def test_pii_query(spark):
    data = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    got = queries.op12_pii(spark, data).collect()
    assert len(got) == len(docs) and sum(r.n_email + r.n_ip + r.n_card + r.n_phone for r in got) > 0
    for r in got:
        base = plain_base(docs[r.doc_id])
        n = Counter(k for k, _, _ in base)
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(n[k] for k in PATTERNS) and r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert r.spans.startswith(listed) and 0 <= r.score <= 1


# --- divergence


def plain_audit(rows):
    """The audit by Python's integers over (text, lang, source)."""
    docs = [(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")), lang or "", s or "") for t, lang, s in rows]
    out = []
    for lang in {x for _, x, _ in docs}:
        df = Counter(w for ws, x, _ in docs if x == lang for w in set(ws))
        kept = {w for w, n in df.items() if n >= 10}
        sources = {s for _, x, s in docs if x == lang}
        counts = {s: Counter(w for ws, x, y in docs if (x, y) == (lang, s) for w in ws if w in kept) for s in sources}
        every = sum(counts.values(), Counter())
        p = lambda c, w, kept=kept: 1 + 1_000_000_000 * (c[w] + 2) // (sum(c.values()) + 2 * len(kept))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = sorted((-sum(f(p(counts[s], w), p(counts[o], w)) for w in kept), o) for o in sources - {s})
            terms = sorted((-f(p(counts[s], w), p(every, w)), w) for w in kept if counts[s][w] and p(counts[s], w) > p(every, w))[:10]
            out += [(lang, s, part, item, -v, k + 1) for part, listed in (("pair", pairs), ("term", terms)) for k, (v, item) in enumerate(listed)]
    return sorted(out)


def corpus(rng, n, sources, langs, vocabulary):
    make = lambda: " ".join(rng.choices(vocabulary, k=rng.randint(0, 30)))
    return [(make() if rng.random() > 0.05 else None, rng.choice(langs), rng.choice(sources)) for _ in range(n)]


@pytest.mark.parametrize(("terms", "sources", "cells", "pending"), [(512, 64, 1 << 20, 1 << 20), (4, 2, 16, 16)])
def test_divergence_is_the_plain_one(spark, monkeypatch, terms, sources, cells, pending):
    for name, value in (("TERMS", terms), ("SOURCES", sources), ("CELLS", cells), ("PENDING", pending)):
        monkeypatch.setattr(divergence, name, value)
    rng = random.Random(3)
    words = ["Über", "über", "a", "A", "b2c", "日本", "x-y", "the", "The", *"cdefghij"]
    rows = corpus(rng, 300, ["s1", "s2", "s3", "s4", "", None], ["en", "de", None], words) + [("rare words only", "la", "s1"), (None, "la", "s2"), ("", "la", "s3"), ("alone " * 20, "xx", "s1")]
    frame = spark.createDataFrame([(*r, 1, "t") for r in rows], "text string, lang string, source string, rank int, term string").repartition(4)
    assert sorted(map(tuple, divergence.audit(frame).collect())) == plain_audit(rows)


def test_divergence_of_odd_documents(spark, odd, empty):
    assert divergence.audit(empty).count() == 0
    rows = [(r.text, r.lang, r.source) for r in odd.collect()]
    assert sorted(map(tuple, divergence.audit(odd).collect())) == plain_audit(rows)


def test_shares_of_large_counts():
    """Counts whose product with a thousand million is beyond 64 bits."""
    rng = random.Random(2)
    for _ in range(1000):
        total = rng.randrange(2, 9 * 10**15)
        count = rng.randrange(0, total - 1)
        assert int(divergence.share(np.int64(count), np.int64(total))) == 1 + 1_000_000_000 * (count + 2) // total


def test_counts_of_a_task_are_added(spark, monkeypatch):
    monkeypatch.setattr(divergence, "PENDING", 4)
    frame = spark.createDataFrame([("a b a", "en", "s"), ("b c", "en", "s"), ("c c c", "en", "t")], "text string, lang string, source string").coalesce(1)
    got = {(r.source, r.term): (r.n, r.df) for r in divergence.counts(frame).where(F.col("term") != "").collect()}
    assert got == {("s", "a"): (2, 1), ("s", "b"): (2, 2), ("s", "c"): (1, 1), ("t", "c"): (3, 1)}

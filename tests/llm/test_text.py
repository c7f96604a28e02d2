"""Tokenizer, token files, licences, languages, toxicity and decontamination against plain versions."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ternway.llm import bpe, decontaminate, huffman, langid, licenses, toxicity
from ternway.llm.common import scratch_path, texts
from ternway.llm.queries import tokenizer_path

PATH = tokenizer_path()
RNG = random.Random(5)


TOKENIZER = bpe.tokenizer(PATH)


def library(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=" \n\t'strevmldABé½0日<|endoftext>　\x1c👍", max_size=40))
def test_ids_are_the_librarys(text):
    for own in (None, PATH):
        ids, offsets = bpe.piece_cache(bpe.tables(PATH), own).encoded(*texts(pa.array([text, None, text + "<|endoftext|>"], pa.string())))
        assert ids[offsets[0] : offsets[1]].tolist() == library(text)
        assert offsets[1] == offsets[2] and ids[offsets[2] :].tolist() == library(text + "<|endoftext|>")


def thue_morse(n):
    return "".join("ab"[bin(k).count("1") % 2] for k in range(n))


@pytest.mark.parametrize("n", [1024, 2048, 8192])
def test_pieces_that_sums_of_powers_confuse(n):
    """A Thue-Morse word and its complement have the same polynomial hash modulo a power of two, whatever the base."""
    own = thue_morse(n)
    rows = [own, own.translate(str.maketrans("ab", "ba"))]
    for library_too in (None, PATH):
        ids, at = bpe.piece_cache(bpe.tables(PATH), library_too).encoded(*texts(pa.array(rows, pa.string())))
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [library(r) for r in rows]


def test_blocks_of_a_long_text(monkeypatch):
    """Texts are cut only where a piece starts whatever stands before."""
    parts = ["it's", "don't 've", "  two", "a\n\n", "é ü", "日本 語", "x1 2y", "<|endoftext|>", " 's", "end.", "\t", "<|endof", "text|>"]
    for _ in range(60):
        text = " ".join(RNG.choice(parts) for _ in range(RNG.randint(1, 40)))
        cuts = bpe.safe_cuts(np.frombuffer(text.encode(), np.uint8), 8)
        pieces = [text.encode()[a:b].decode() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        assert "".join(pieces) == text and [i for x in pieces for i in library(x)] == library(text)
    monkeypatch.setattr(bpe, "CHUNK_BYTES", 64)
    ids, at = bpe.piece_cache(bpe.tables(PATH)).encoded(*texts(pa.array([text * 9, "", None, "short", "w" * 500], pa.string())))
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [library(x) for x in (text * 9, "", "", "short", "w" * 500)]


def test_round_trip_of_odd_texts(odd, empty):
    out = {(r.doc_id, r.text) for r in bpe.decode(bpe.encode(odd, PATH), PATH).collect()}
    assert out == {(r.doc_id, r.text or "") for r in odd.collect()}
    assert bpe.encode(odd, PATH).count() == odd.count() and bpe.encode(empty, PATH).count() == 0


def test_digests_of_odd_texts(odd, empty, monkeypatch):
    def plain(r):
        ids = library(r.text)
        text = TOKENIZER.decode(ids, skip_special_tokens=False)
        return r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()

    assert {tuple(r) for r in bpe.digests(odd, PATH).collect()} == {plain(r) for r in odd.collect()} and bpe.digests(empty, PATH).count() == 0
    v = bpe.tables(PATH)
    listed = [f",{i}".encode() for i in range(len(v.flat_at) - 1)]
    one = bpe.Digests(v, (np.frombuffer(b"".join(listed), np.uint8), np.cumsum([0, *map(len, listed)])))
    text = "日本語 👍🏽 plain"
    for i in library(text):  # blocks may end inside a character
        one.add(np.array([i]))
    assert one.row()[0] == len(library(text)) and one.row()[2] == hashlib.sha256(text.encode()).hexdigest()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 1000), min_size=1, max_size=600))
def test_codes(counts):
    counts = np.array(counts)
    lengths = huffman.code_lengths(counts)
    used = counts > 0
    assert ((lengths > 0) == used).all() and lengths.max() <= huffman.MAX_LENGTH
    if used.sum() > 1:
        assert sum(2.0 ** -int(x) for x in lengths[used]) == 1
    ids = np.random.default_rng(0).choice(np.flatnonzero(used), 1000).astype(np.uint32) if used.any() else np.zeros(0, np.uint32)
    marks, data = huffman.pack(ids, huffman.canonical(lengths), lengths)
    assert (huffman.unpack(marks, data, len(ids), huffman.CHECKPOINT, *huffman.lookup(lengths)) == ids).all()


def test_length_limit():
    counts = np.array([2**k for k in range(40)])
    lengths = huffman.code_lengths(counts)
    assert lengths.max() == huffman.MAX_LENGTH and sum(2.0 ** -int(x) for x in lengths) == 1


def test_codes_of_large_vocabularies():
    counts = np.random.default_rng(1).zipf(1.3, 300_000).clip(1, 1 << 40)
    lengths = huffman.code_lengths(counts)
    assert huffman.MAX_LENGTH < lengths.max() <= huffman.most_bits(300_000) and sum(2.0 ** -int(x) for x in lengths) == 1
    ids = np.random.default_rng(2).integers(0, 300_000, 20_000).astype(np.uint32)
    marks, data = huffman.pack(ids, huffman.canonical(lengths), lengths)
    assert (huffman.unpack(marks, data, len(ids), huffman.CHECKPOINT, *huffman.lookup(lengths)) == ids).all()


def test_token_files(spark, odd, empty):
    got = sorted(map(tuple, huffman.round_trip(odd, PATH).collect()), key=lambda r: r[1])
    rows = sorted(odd.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    start = 0
    for (doc, at, n, crc), r in zip(got, rows, strict=True):
        ids = [*library(r.text), 0]
        assert (doc, at, n, crc) == (r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += n
    assert huffman.round_trip(empty, PATH).count() == 0


def test_files_are_in_order(spark, odd):
    folder = scratch_path(spark, "test")
    huffman.write(odd, PATH, folder)
    assert spark.read.parquet(f"{folder}/codes").where("length > 18").count() == 0
    assert huffman.read(spark, folder).agg({"doc_id": "count"}).first()[0] == 11


def plain_licences(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    places = sorted((k, v) for p, v in licenses.BASE.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split())
    return len(words), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted({v for _, v in places}))


def test_licences(spark, odd, empty):
    parts = ["MIT License", "mit", "license", "Apache\nLicense", "CC BY", "cc-by", "GNU General Public License", "gnu", "x", "É", "SPDX-License-Identifier: MIT", "licensed under the apache license,"]
    rows = [(k, " ".join(RNG.choice(parts) for _ in range(RNG.randint(0, 25)))) for k in range(200)]
    got = {r.doc_id: r for r in licenses.licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, text in rows:
        r = got[k]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain_licences(text)
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1
    assert licenses.licenses(odd).count() == odd.count() and licenses.licenses(empty).count() == 0


@pytest.mark.parametrize(
    ("text", "choices"),
    [
        ("MIT", {"mit"}),
        ("MIT OR Apache-2.0 AND BSD-3-Clause", {"mit", "apache+bsd"}),
        ("(MIT OR Apache-2.0) AND BSD-3-Clause", {"(apache or mit)+bsd"}),
        ("MIT OR (Apache-2.0 OR MIT)", {"mit", "apache"}),
        ("(MIT AND (ISC OR MIT)) AND (MIT OR MIT)", {"(isc or mit)+mit"}),
        ("(MIT OR ISC) AND ((MIT AND x OR ISC) AND (y OR y))", {"(isc or mit)+(isc or mit+x)+y"}),
        ("GPL-2.0-only WITH Classpath-exception-2.0 OR MPL-2.0", {"gpl", "mpl"}),
        ("mit or", {"mit"}),
        ("MIT Apache", {"mit"}),
        ("(MIT", None),
        ("and", None),
        ("", None),
    ],
)
def test_expressions(text, choices):
    if choices is None:
        with pytest.raises(licenses.Bad):
            licenses.parse(text)
    else:
        assert licenses.evaluate(licenses.parse(text)[0]) == choices


def plain_labels(text):
    """Labels and score of a text: phrases by a search at every word, identifiers by splitting expressions without brackets."""
    low = "".join(c.lower() if c.isascii() else c for c in text)
    words = [(m.end(), m.group()) for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)]
    labels, doubt = set(), 1.0
    for phrases, kind in ((licenses.BASE, "base"), (licenses.NOTICES, "notice"), ({"license identifier": None}, "tag")):
        for phrase, name in phrases.items():
            size = len(phrase.split())
            for k in range(len(words) - size + 1):
                if [w for _, w in words[k : k + size]] != phrase.split():
                    continue
                doubt *= 1 - licenses.WEIGHT[kind]
                if name:
                    labels.add(name)
                    continue
                rest = re.match("[ \\t:=\"']*([^\\n]*)", text[words[k + size - 1][0] :]).group(1)
                ident = r"(?!(?:with|and|or)(?![A-Za-z0-9.+:-]))[A-Za-z0-9][A-Za-z0-9.+:-]*"
                if own := re.match(f"{ident}(?: +(?:with|and|or) +{ident})*", rest, re.I):
                    parts = re.split(r" +(with|and|or) +", own.group(), flags=re.I)
                    labels |= {licenses.label(x.rstrip(".:")) for x, before in zip(parts[::2], ["", *parts[1::2]], strict=True) if before.lower() != "with"}
    return ",".join(sorted(labels)), 1 - doubt


def test_labels_are_those_of_the_plain_version(spark):
    parts = ["SPDX-License-Identifier: MIT", "License Identifier = GPL-2.0-only WITH Classpath-exception-2.0 OR Apache-2.0 AND x\n", "license-identifier:", "MIT License", "bsd license", "creative commons zero", "All rights\nreserved", "é", "or", "and ISC", "gnu", "GNU General Public License", "permission is hereby granted, free of charge,", "word."]
    rows = [(k, " ".join(RNG.choice(parts) for _ in range(RNG.randint(0, 12)))) for k in range(300)]
    for r in licenses.licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        labels, score = plain_labels(rows[r.doc_id][1])
        assert r.labels == labels and r.score == pytest.approx(score), rows[r.doc_id]


def test_many_tags_in_a_line(spark):
    text = "SPDX-License-Identifier: MIT " * 100_000
    (r,) = licenses.licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert (r.n_words, r.labels, r.choices) == (400_000, "mit", ["mit"])


def test_long_expressions(spark):
    long = "SPDX-License-Identifier: " + " AND ".join(f"LicenseRef-package-{k}" for k in range(300)) + " AND ISC\nAND MPL-2.0"
    pairs = "SPDX-License-Identifier: " + " AND ".join(f"(x{k} OR y{k})" for k in range(14)) + " AND (GPL-2.0 WITH some-exception OR MIT)"
    found = {r.doc_id: r for r in licenses.licenses(spark.createDataFrame([(1, long), (2, pairs)], "doc_id long, text string")).collect()}
    assert set(found[1].labels.split(",")) == {"isc", *(f"licenseref-package-{k}" for k in range(300))} and len(found[1].choices) == 1
    assert set(found[2].labels.split(",")) == {"gpl", "mit", *(f"{c}{k}" for c in "xy" for k in range(14))}
    # read as an expression again, the choices allow what the whole expression allows
    postfix, names = licenses.parse(pairs.split(": ")[1])[0], sorted(found[2].labels.split(","))
    again = [licenses.parse(c.replace("+", " and "))[0] for c in found[2].choices]

    def allows(postfix, have):
        stack = []
        for x in postfix:
            if x not in licenses.PRECEDENCE:
                stack.append(licenses.label(x) in have)
                continue
            b, a = stack.pop(), stack.pop()
            stack.append(a if x == "with" else a and b if x == "and" else a or b)
        return stack.pop()

    for k in range(300):
        have = {n for n in names if RNG.random() < 0.97} if k % 2 else {f"{RNG.choice('xy')}{i}" for i in range(14)} | {RNG.choice(["gpl", "mit", "other"])}
        assert allows(postfix, have) == any(allows(p, have) for p in again)


WORDS = {"en": "the of and house river walk light under over small".split(), "de": "der die und haus fluss gehen licht unter über klein".split(), "fr": "le la et maison rivière marcher lumière sous sur petit".split()}


def prose(lang, n):
    return " ".join(RNG.choice(WORDS[lang]) for _ in range(n))


@pytest.fixture(scope="module")
def prose_docs(spark):
    rows = [(k, prose(lang, RNG.randint(10, 80)), lang) for k in range(600) for lang in [RNG.choice("en en de fr".split())]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_languages(prose_docs, odd, empty):
    model = langid.fit(prose_docs.where("doc_id % 2 = 0"))
    held = langid.predict(prose_docs.where("doc_id % 2 = 1"), model).join(prose_docs, "doc_id")
    assert held.where("lang_pred = lang").count() >= 0.95 * held.count()
    got = {r.doc_id: r for r in langid.predict(odd, model).collect()}
    assert {k for k, r in got.items() if r.lang_pred == "und"} == {3, 4, 5, 9} and all(0 <= r.score <= 1 for r in got.values())
    nothing = langid.fit(empty)
    assert {r.lang_pred for r in langid.predict(odd, nothing).collect()} == {"und"} and langid.predict(empty, model).count() == 0
    kept = langid.keep(odd, model, 0.25)
    assert kept.columns == odd.columns and not {3, 4, 5, 9} & {r.doc_id for r in kept.collect()}


def test_more_languages_than_bits_of_a_word(spark):
    words = {f"l{k}": ["".join(RNG.choice("abcdefghijklmnopqrst") for _ in range(6)) for _ in range(12)] for k in range(70)}
    rows = [(10 * k + i, " ".join(RNG.choice(words[lang]) for _ in range(40)), lang) for k, lang in enumerate(words) for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs.where("doc_id % 10 < 2"))
    held = langid.predict(docs.where("doc_id % 10 >= 2"), model).join(docs, "doc_id")
    assert len(model.languages) == 70 and held.where("lang_pred = lang").count() == 140


def test_filters_hold_the_frequent_grams(prose_docs):
    """Every n-gram that a plain count finds frequent is known to its language; others are known as often as the false rate says."""
    model, counts = langid.fit(prose_docs), {}
    for r in prose_docs.collect():
        low = re.sub(rb"[^a-z\x80-\xff]", b" ", r.text.lower().encode())
        own = counts.setdefault(r.lang, {})
        for k in range(len(low) - 3):
            if low[k : k + 4].count(b" ") < 2:
                own[low[k : k + 4]] = own.get(low[k : k + 4], 0) + 1
    for k, lang in enumerate(model.languages):
        own, total = counts[lang], sum(counts[lang].values())
        frequent = np.array([int.from_bytes(g, "little") for g, n in own.items() if n >= langid.SHARE * total], np.uint32)
        assert ((model.rows(frequent)[:, 0] >> np.uint64(k)) & np.uint64(1)).all()
        other = np.random.default_rng(k).integers(1 << 31, 1 << 32, 200_000).astype(np.uint32)
        assert ((model.rows(other)[:, 0] >> np.uint64(k)) & np.uint64(1)).mean() == pytest.approx(model.false_rate[k], abs=0.01)


def test_threshold_is_the_best_cut():
    rng = np.random.default_rng(8)
    for _ in range(20):
        z, toxic = rng.normal(size=80) * 2, rng.random(80) < 0.3
        z[toxic] += 2
        at = toxicity.steps(z)
        cut = toxicity.threshold(*[np.bincount(at[toxic == k], minlength=3000) for k in (False, True)])
        right = lambda c: (z[~toxic] < c).mean() + (z[toxic] >= c).mean()  # noqa: E731, B023
        assert right(cut) >= max(right(c) for c in z) - 2 / min(toxic.sum(), (~toxic).sum()) and -30 < cut < 30


def test_toxicity(spark, prose_docs, odd, empty):
    bad = ["stinker", "rotzbube", "vilain"]
    rows = [(r.doc_id, r.text + (f" {bad[r.doc_id // 12 % 3]} {prose(r.lang, 4)}" if r.doc_id % 4 == 0 else ""), r.lang) for r in prose_docs.collect()]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(600)] + [(5, None)], "doc_id long, toxic int")
    net = toxicity.fit(docs.where("doc_id % 3 <> 1"), labels, langid.fit(docs))
    held = toxicity.score(docs, net).join(labels.where("toxic is not null"), "doc_id").where("doc_id % 3 = 1")
    assert held.where("predicted = toxic").count() >= 0.95 * held.count()
    assert all(0 <= r.score <= 1 for r in toxicity.score(odd, net).collect())
    assert toxicity.score(empty, net).count() == 0 and toxicity.keep(odd, net).columns == odd.columns
    one_class = toxicity.fit(docs, labels.where("toxic = 0"), None)
    assert toxicity.score(docs, one_class).where("predicted = 1").count() == 0
    assert toxicity.score(docs, toxicity.fit(empty, labels.limit(0), None)).where("predicted = 1").count() == 0


@pytest.mark.parametrize("block", [1, 7, 200_000])
def test_scores_do_not_depend_on_a_texts_neighbours(block, monkeypatch):
    monkeypatch.setattr(toxicity, "BLOCK_WORDS", block)
    rng = np.random.default_rng(3)
    net = toxicity.Net(rng.standard_normal((toxicity.BUCKETS, toxicity.WIDTH)).astype(np.float32), [rng.standard_normal((s, toxicity.WIDTH, toxicity.FILTERS)).astype(np.float32) for s in toxicity.SIZES], rng.standard_normal(len(toxicity.SIZES) * toxicity.FILTERS).astype(np.float32), 0.0)
    rows = ["a calm long text that ends on a stinker", "stinker", "", "two stinker", "some words between", "and then the stinker"]
    for own in (rows, rows[::-1]):
        buckets, first = toxicity.features(*texts(pa.array(own, pa.string())))
        x = net.embedding[buckets].sum(1)
        best, _ = net.pooled(buckets, first)
        for t, (a, b) in enumerate(zip(first[:-1], first[1:], strict=True)):
            plain = [max((sum(x[p + k] @ f[k][:, c] for k in range(len(f))) for p in range(a, b - len(f) + 1)), default=0) for f in net.filters for c in range(toxicity.FILTERS)]
            assert np.allclose(best[t], plain, atol=1e-4)
        together = net.score(*texts(pa.array(own, pa.string())))
        assert np.allclose(together, [net.score(*texts(pa.array([r], pa.string())))[0] for r in own], atol=1e-5)


def plain_tokens(text):
    """(placeholder or None, value) of a text's tokens, names of several words as one; and the tokens as they are."""
    words = [(m.start(), m.end(), m.group()) for m in re.finditer(r"[0-9]+(?:[.,][0-9]+)*|(?<=[0-9)+*/^=<>\- \t\n\r\v\f])[+*/^=<>-]+(?=[ \t\n\r\v\f+*/^=<>-]*[0-9(])|[\u3000-\u9fff\u0e00-\u0eff]|(?:(?![\u3000-\u9fff\u0e00-\u0eff])[A-Za-z\u0080-\U0010ffff])+", text)]
    sign = lambda w: w[0] in "+-*/^=<>"
    words = [(a, b, w) for a, b, w in words if not sign(w) or re.search(r"[0-9)][ \t\n\r\v\f+*/^=<>-]*$", text[:a])]
    lower = lambda w: "".join(c.lower() if c.isascii() else c for c in w)
    out, before = [], None
    for a, b, w in words:
        if w[0].isdigit():
            out.append((1, w))
        elif "A" <= w[0] <= "Z" or "À" <= w[0] <= "Þ":
            if out and out[-1][0] == 2 and before is not None and not text[before:a].strip(" \t\n\r\v\f"):
                out[-1] = (2, out[-1][1] + "|" + lower(w))
            else:
                out.append((2, lower(w)))
        elif out and out[-1][0] == 1 and lower(w) in decontaminate.UNITS:
            out.append((3, lower(w)))
        else:
            out.append((None, lower(w)))
        before = b
    return out, [(None, lower(w)) for _, _, w in words]


def plain_leaks(docs, items, width=8, least=3, enough=6, least_bits=30):
    """All items against all documents, token by token."""
    found = set()
    seen = [t for _, text in docs if text is not None for t in plain_tokens(text)[0]]
    often = collections.Counter(v for kind, v in seen if kind is None)

    def stands(window):
        literal = [v for kind, v in window if kind is None]
        if 8 * len(literal) >= 3 * len(window):
            return True
        bits = sum(np.log2((len(seen) + 65536) / (often[v] + 1)) for v in literal) + sum({1: 3, 2: 2, 3: 4}.get(kind, 0) for kind, _ in window)
        return bool(literal) and bits >= least_bits

    for d, text in docs:
        for i, item in items:
            if text is None or item is None:
                continue
            for template, (own, theirs) in enumerate(zip(plain_tokens(text)[::-1], plain_tokens(item)[::-1], strict=True)):
                size = min(width, len(theirs))
                if len(theirs) < least:
                    continue
                every = [k for k in range(len(theirs) - size + 1) if not template or stands(theirs[k : k + size])]
                sure = [k for k in every if not template or 8 * sum(t[0] is None for t in theirs[k : k + size]) >= 3 * size]
                shape = lambda t: t if t[0] is None else t[0]
                for offset, windows in itertools.product(range(-len(theirs), len(own)), (every, sure)):
                    hit = [k for k in windows if 0 <= k + offset <= len(own) - size and [*map(shape, own[k + offset : k + offset + size])] == [*map(shape, theirs[k : k + size])]]
                    pairs = {(t[0], t[1], own[j + offset][1]) for k in hit for j, t in enumerate(theirs[k : k + size], k) if t[0] is not None}
                    if hit and len(hit) >= min(enough, len(windows)) and len({p[:2] for p in pairs}) == len(pairs) == len({(p[0], p[2]) for p in pairs}):
                        found.add((d, i))
    return found


def test_leaks_are_those_of_the_plain_version(spark):
    words = "the a train Paris Lyon New York goes 3 12 4.5 km hours and It back É 東 京 pears gives to + - (3 12) * <=".split()
    items = [(k, " ".join(RNG.choice(words) for _ in range(RNG.randint(2, 14)))) for k in range(40)]
    docs = []
    for k in range(60):
        own = [w if RNG.random() > 0.1 else RNG.choice(words) for w in items[RNG.randrange(40)][1].split()]
        swap = dict(zip(words, RNG.sample(words, len(words)))) if k % 3 == 0 else {}
        own = [swap.get(w, w) if w[0].isupper() or w[0].isdigit() else w for w in own]
        docs.append((k, " ".join(RNG.choice(words) for _ in range(RNG.randint(0, 5))) + RNG.choice([" ", ". "]) + " ".join(own)))
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == plain_leaks(docs, items) and len(got) > 15


def test_leaks(spark, odd, empty):
    items = [
        (1, "A train leaves Paris at 9 and goes 120 km to Lyon in 3 hours, then goes back to Paris."),
        (2, "two words"),
        (3, None),
        (4, "one two three four five six"),
        (5, "Anna has 5 apples and gives 2 of them to a friend."),
        (6, "12 Paris 34 Lyon 56 Rome 78 Milan 90 Bonn 11 Ulm 13"),
        (7, "北京是中国的首都有很多人住在那里"),
        (8, "New Title Of A Very Short Book"),
        (9, "Anna Smith ran 5 km in 20 min"),
        (10, "Compute 12 + 34 * 56"),
        (11, "Paris 12, 34, 56 Rome"),
    ]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = [
        (1, "Before. " + items[0][1] + " After."),
        (2, "A train leaves Rome at 7 and goes 250 miles to Milan in 4 hours, then goes back to Rome."),
        (3, "A train leaves Rome at 7 and goes 250 miles to Milan in 4 hours, then goes back to Milan."),
        (4, "A train leaves early in the morning and comes back at night with two words."),
        (5, "so one two three four five six so"),
        (1, "Before. " + items[0][1] + " After."),
        (6, "so, Boris has 6 apples and gives 3 of them to a friend, he said"),
        (7, "Mary Ann has 6 apples and gives 3 of them to a friend"),
        (8, "A train leaves New York at 7 and goes 130 km to Lyon in 4 hours, then goes back to New York."),
        (9, "list: 12 Paris 34 Lyon 56 Rome 78 Milan 90 Bonn 11 Ulm 13 and so on"),
        (10, "list: 12 Rome 34 Lyon 56 Paris 78 Milan 90 Bonn 11 Ulm 13 and so on"),
        (11, "据说北京是中国的首都有很多人住在那里。"),
        (12, "THE NEW TITLE OF A VERY SHORT BOOK"),
        (13, "Anna has 5 pears and gives 2 of them to a friend."),
        (14, "so: Boris Miller ran 12 km in 70 min, he said"),
        (15, "so: Boris Miller ran 12 km in 12 min, he said"),
        (16, "they say: Evaluate 7+8*9 now"),
        (17, "they say: Evaluate 7 - 8 * 9 now, or call 7 8 9"),
        (18, "Lyon 7, 8, 9 Milan"),
    ]
    found = {(r.doc_id, r.item_id): r for r in decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert set(found) == {(1, 1), (2, 1), (5, 4), (6, 5), (7, 5), (8, 1), (9, 6), (11, 7), (12, 8), (14, 9), (16, 10)}
    assert {k for k, r in found.items() if r.verbatim} == {(1, 1), (5, 4), (9, 6), (11, 7), (12, 8)}
    assert set(found) == plain_leaks({(d, t) for d, t in docs}, items)
    assert decontaminate.leaks(odd, bench).count() == 0 and decontaminate.leaks(empty, bench).count() == 0
    assert decontaminate.leaks(odd, bench.limit(0)).count() == 0
    # where the words of a template are common it says little
    common = docs + [(100 + k, "Anna ran in 3 km. " * 200) for k in range(8)]
    found = {(r.doc_id, r.item_id) for r in decontaminate.leaks(spark.createDataFrame(common, "doc_id long, text string"), bench).collect()}
    assert (16, 10) in found and (14, 9) not in found and found == plain_leaks(common, items)


def test_token_files_do_not_depend_on_the_order_of_rows(spark):
    """Rows of one doc_id with different texts, dealt and ordered in several ways."""
    rows = [(k // 4, f"text {k % 3} of {k}") for k in range(12)] + [(None, "a"), (None, "b"), (2, None)]
    answers = set()
    for seed in range(4):
        shuffled = random.Random(seed).sample(rows, len(rows))
        frame = spark.createDataFrame(shuffled, "doc_id long, text string").repartition(1 + seed)
        answers.add(str(sorted(map(str, map(tuple, huffman.round_trip(frame, PATH).collect())))))
    assert len(answers) == 1

"""Near duplicates of texts and vectors, components, archives and chats against plain versions."""

import base64
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ternway.llm import chat, common, embeddings, jaccard, warc
from ternway.llm.common import scratch_path, without
from ternway.llm.graph import components

RNG = random.Random(9)


def reach(ids, links):
    up = {x: x for x in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {x: root(x) for x in ids}


def test_joins_of_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 5)
    rows = spark.range(400).select(F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 50).alias("k"), F.col("id").alias("x"))
    table = rows.where("k % 4 <> 1").groupBy("k").agg(F.min("x").alias("least"), F.count("*").alias("n"))
    plan = common.joined(rows, table, ["k"], "n", "x")
    assert sorted(map(str, plan.collect())) == sorted(map(str, rows.join(table, "k", "left").select(*plan.columns).collect()))
    assert "salt" in plan._jdf.queryExecution().toString()


@pytest.mark.parametrize("hot", [1000, 10])
@pytest.mark.parametrize("shape", ["line", "star", "random"])
def test_components(spark, shape, hot, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", hot)
    ids = list(range(400))
    RNG.shuffle(ids)
    links = {"line": list(zip(ids, ids[1:])), "star": [(ids[0], x) for x in ids[1:]], "random": [(RNG.choice(ids), RNG.choice(ids)) for _ in range(250)]}[shape]
    got = {r.id: r.component for r in components(spark.createDataFrame(links + [(1, None)], "a long, b long")).collect()}
    expected = reach(ids, links)
    assert all(got.get(x, x) == expected[x] for x in ids)


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def plain_groups(rows):
    sets = {d: shingles(t) for d, t in rows}
    ids = sorted(sets)
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    return {d: (len(sets[d]), c) for d, c in reach(ids, links).items()}


@pytest.mark.parametrize("settings", [{}, {"block": 7}, {"block": 3}])
def test_near_duplicates(spark, settings, monkeypatch):
    if settings.get("block") == 7:
        monkeypatch.setattr(jaccard, "MERGE_FROM", 3)
    vocabulary = [f"w{k}" for k in range(300)]
    passage = [RNG.choice(vocabulary) for _ in range(40)]
    rows = []
    for _ in range(25):
        base = [RNG.choice(vocabulary) for _ in range(RNG.randint(3, 120))] + (passage if RNG.random() < 0.5 else [])
        for _ in range(RNG.randint(1, 6)):
            own = list(base)
            for _ in range(RNG.randint(0, 4)):
                own[RNG.randrange(len(own))] = RNG.choice(vocabulary)
            rows.append((len(rows), " ".join(own).upper() if RNG.random() < 0.3 else "\n".join(own)))
    rows += [(len(rows) + k, t) for k, t in enumerate(["", None, "a", "A", "a b", " \t"])]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), **settings).collect()}
    assert got == plain_groups(rows)


@pytest.mark.parametrize("same_size", [False, True])
def test_links_of_sets_that_a_task_merged(spark, same_size, monkeypatch):
    """The smallest set under a shared passage's shingles, which stands for the others of its task, links with none of them."""
    monkeypatch.setattr(jaccard, "MERGE_FROM", 3)
    passage = [f"p{k}" for k in range(90)]
    fresh = (f"u{k}" for k in range(100_000))

    def own(n):
        return [next(fresh) for _ in range(n)]

    near = [" ".join(own(7) + passage + own(7)) for _ in range(2)]
    rows = []
    for k in range(80):
        at = RNG.randrange(-20, 70)
        run = passage[max(at, 0) : at + 40]
        rows.append((k, " ".join(run + own((104 if same_size else 44 + k * 60 // 80) - len(run)))))
    rows.append((80, near[0]))
    docs = spark.createDataFrame(spark.sparkContext.parallelize([rows, [(81, near[1])]], 2).flatMap(lambda x: x), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs).collect()}
    expected = plain_groups([*rows, (81, near[1])])
    assert expected[81][1] == 80 and got == expected


def test_sets_outside_the_core_of_a_large_family(spark):
    """A chain of sets of which each links with the next two alone, many near copies of its end, and a far part."""
    words = [f"c{k}" for k in range(400)]
    rows = [(k, " ".join(words[3 * k : 3 * k + 60])) for k in range(100)] + [(200 + k, " ".join(words[297:357] + [f"x{k}"])) for k in range(30)]
    RNG.shuffle(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), block=9).collect()}
    assert got == plain_groups(rows)


def test_counts_by_blocks_of_positions():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 300, 60)
    sets = sorted((np.unique(np.where(rng.random(60) < rng.choice([0.02, 0.5]), rng.integers(0, 300, 60), base)[: rng.integers(5, 60)]).astype(np.uint64) for _ in range(120)), key=len)
    for probes, against in ((range(120), range(120)), (range(0, 50), range(50, 120))):
        got = set(jaccard.overlap_links(sets, probes, against, 75))
        assert got == {(i, j) for i in probes for j in against if i != j and 100 * len(np.intersect1d(sets[i], sets[j])) >= 75 * len(np.union1d(sets[i], sets[j]))}


def test_words_that_sums_of_powers_confuse(spark):
    own = "".join("ab"[bin(k).count("1") % 2] for k in range(2048))
    rows = [(1, own), (2, own.translate(str.maketrans("ab", "ba"))), (3, own)]
    got = {r.doc_id: r.component_id for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def test_entries_of_several_sets_have_a_range():
    def of(*x):
        return np.array(x, np.int64)

    (token, doc, low, high), edges = jaccard.merged_entries(of(1, 1, 2, 3, 3), of(5, 6, 7, 8, 9), of(9, 9, 9, 9, 90), of(9, 9, 9, 9, 90), 75)
    assert doc[low < high].tolist() == [5] and doc.tolist() == [5, 7, 8, 9] and edges.tolist() == [[6, 5]]
    batch = pa.RecordBatch.from_arrays([pa.array(x) for x in (of(1, 1), of(5, 4), of(9, 9), of(10, 9))], ["token", "doc", "low", "high"])
    assert [tuple(r.values()) for b in jaccard.listed(75, iter([batch])) for r in b.to_pylist()] == [(None, 4, 5)]


def test_near_duplicates_of_odd_rows(odd, empty):
    got = jaccard.near_duplicates(odd).collect()
    assert len(got) == odd.count() and jaccard.near_duplicates(empty).count() == 0
    by_id = {r.doc_id: r.component_id for r in got}
    assert by_id[2] == 1 and by_id[3] == 3 and by_id[8] == 8 and by_id[None] is None


def test_bit_maps_never_rule_out_a_link():
    rng = np.random.default_rng(2)
    for _ in range(100):
        a = np.unique(rng.integers(0, 1 << 62, rng.integers(4, 400)).astype(np.uint64))
        cut = rng.integers(0, max(1, len(a) // 7) + 1)
        b = np.unique(np.concatenate([a[cut:], rng.integers(0, 1 << 62, cut // 2 + 1).astype(np.uint64)]))
        both, every = len(np.intersect1d(a, b)), len(np.union1d(a, b))
        label = jaccard.passing(np.array([len(a), len(b)]), [jaccard.parities(a), jaccard.parities(b)], 75)
        assert 100 * both < 75 * every or label[0] == label[1]


def test_without(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "doc_id long, _listed string")
    assert sorted(r[1] for r in without(rows, "doc_id", spark.createDataFrame([(2,)], "x long")).collect()) == ["a", "c"]


def test_vectors(spark):
    rng = np.random.default_rng(4)
    rows = []
    for label in (0, 1):
        for c in rng.standard_normal((30, 16)):
            rows += [(len(rows) + k, (c + rng.standard_normal(16) * s).tolist(), label) for k, s in enumerate([0, 0, 0.05, 0.1, 0.2])]
    odd = [(900, None, 0), (901, [0.0] * 16, 0), (902, [float("nan")] + [1.0] * 15, 0), (903, rows[0][1], None), (904, [None] + [1.0] * 15, 0), (905, [1.0], 0), (906, [], 0), (907, [1e-200] * 16, 1), (908, [1e200] * 16, 1)]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int").withColumn("n_links", F.lit("clash"))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_vectors(frame, tile=40).collect()}
    links = []
    for i, (a, x, p) in enumerate(rows):
        for b, y, q in rows[i + 1 :]:
            x_, y_ = np.array(x), np.array(y)
            if p == q and x_ @ y_ / np.sqrt((x_ @ x_) * (y_ @ y_)) >= 0.98:
                links.append((a, b))
    links.append((907, 908))
    group = reach([r[0] for r in rows + odd], links)
    count = {k: sum(k in x for x in links) for k in group}
    assert {k: v[0] for k, v in got.items()} == count
    assert {k: (v[1], v[2]) for k, v in got.items()} == {k: (c, c == k) for k, c in group.items()}
    assert embeddings.near_vectors(frame.limit(0)).count() == 0


def test_recall_at_the_threshold():
    width, least = embeddings.window(0.98), embeddings.least_collisions(embeddings.LINES, embeddings.WINDOW_SIGMAS, embeddings.RECALL)
    rng = np.random.default_rng(1)
    x = rng.standard_normal((4000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    away = rng.standard_normal(x.shape)
    away -= (away * x).sum(1, keepdims=True) * x
    away /= np.linalg.norm(away, axis=1, keepdims=True)
    y = 0.981 * x + np.sqrt(1 - 0.981**2) * away
    apart = np.abs((x - y) @ embeddings.lines(32, embeddings.LINES).T)
    meet = (apart[:, : embeddings.CUT_LINES] <= embeddings.window(0.98, embeddings.TILE_SIGMAS)).all(1)
    assert (((apart <= width).sum(1) >= least) & meet).mean() > 0.99


@pytest.mark.parametrize("least", [1, 6, 8])
def test_collisions_are_counted_on_all_lines(least, monkeypatch):
    monkeypatch.setattr(embeddings, "PAIRS", 50)
    rng = np.random.default_rng(6)
    px, py = rng.standard_normal((40, 8)), rng.standard_normal((60, 8))
    py[:20] = px[:20] + rng.standard_normal((20, 8)) * 0.4
    found = [(int(a), int(b)) for i, j in embeddings.collisions(px, py, 0.7, least) for a, b in zip(i, j, strict=True)]
    count = (np.abs(px[:, None] - py[None]) <= 0.7).sum(2)
    assert len(found) == len(set(found)) and set(found) == {(i, j) for i in range(40) for j in range(60) if count[i, j] >= least}


@pytest.mark.parametrize("least", [0, 10])
def test_archives(spark, least):
    html = ["<p>a</p>", "<p>a</p>", None, "", "x\r\n\r\nWARC/1.1\r\n", "é" * 50, "<p>a</p>"]
    rows = [(k, f"http://www.Example.com/{k % 3}?q#f" if k != 3 else None, h) for k, h in enumerate(html)]
    frame = spark.createDataFrame(rows[::-1], "page_id long, url string, html string").withColumn("payload", F.lit(1))
    got = {r.page_id: r for r in warc.archived(frame, least).collect()}
    for k, h in enumerate(html):
        data = (h or "").encode()
        first = min(i for i, x in enumerate(html) if (x or "") == (h or "")) if len(data) >= least else k
        r = got[k]
        assert (r.payload_bytes, r.payload_digest) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if first == k else ("revisit", first))
    ordered = sorted(got.values(), key=lambda r: r.history_rank)
    assert [r.history_rank for r in ordered] == list(range(len(html))) and ordered == sorted(ordered, key=lambda r: (r.url_key, r.ts, r.page_id))
    assert {r.url_key for r in ordered} == {"com,example)/0?q", "com,example)/1?q", "com,example)/2?q", ")/"}
    assert warc.archived(frame.limit(0)).count() == 0


def test_archives_of_odd_rows(spark, monkeypatch):
    """Null ids, repeated rows and payloads longer than a reader's step; small archives and ranges."""
    monkeypatch.setattr(warc, "RANGE_CAPTURES", 3)
    long = "".join(RNG.choice("abcdef \r\n") for _ in range(700_000))
    rows = [(None, "http://a/", "x"), (None, "http://a/", "x"), (5, "http://b/", "x"), (4, "http://b/", long), (3, "http://b/", long), (3, "http://b/", long), (9, None, None)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = scratch_path(spark, "test-warc")
    warc.write(frame, path, archive_bytes=1 << 19)
    got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.merged(warc.read_runs(spark, path), 4).collect()), key=str)
    assert got == sorted([(None, 1, "revisit", 5), (None, 1, "revisit", 5), (5, 1, "response", None), (4, 700_000, "revisit", 3), (3, 700_000, "response", None), (3, 700_000, "response", None), (9, 0, "response", None)], key=str)
    assert {r.history_rank for r in warc.archived(frame).collect()} == set(range(7))


def test_loser_tree():
    for k in range(6):
        runs = [sorted(("r", RNG.choice("abc"), RNG.randrange(5), RNG.randrange(9)) for _ in range(RNG.randrange(6))) for _ in range(k)]
        assert [warc.order(r) for r in warc.LoserTree([iter(r) for r in runs])] == sorted(warc.order(r) for run in runs for r in run)


def test_archive_file_is_plain_warc(spark):
    path = scratch_path(spark, "test-warc")
    warc.write(spark.createDataFrame([(1, "http://a.b/", "hé\r\n\r\n")], "page_id long, url string, html string"), path)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).collect()
    ((head, block),) = [x for r in files for x in warc.records(r.content)]
    assert head["WARC-Type"] == "response" and block.endswith("\r\n\r\nhé\r\n\r\n".encode()) and int(head["Content-Length"]) == len(block)


def test_chats(spark):
    rows = [
        (1, 2, "assistant", "<|end|>\n & &amp; <|and|> [INST]"),
        (1, 1, "user", "hi"),
        (1, 3, "assistant", ""),
        (1, 4, "assi|>\n<stant", None),
        (1, 5, None, "x"),
        (1, None, "system", "first"),
        (2, 1, "user", "a"),
        (2, 1, "user", "a"),
        (None, 1, "user", "lost"),
    ]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(0))
    out = chat.formatted(frame)
    got = {r.conv_id: r for r in out.select("conv_id", "formatted", chat.turns_of(F.col("formatted")).alias("turns"), chat.loss_texts(F.col("formatted")).alias("loss")).collect()}
    assert [tuple(t) for t in got[1].turns] == [("system", "first"), ("user", "hi"), ("assistant", rows[0][3]), ("assistant", ""), ("assi|>\n<stant", ""), ("", "x")]
    assert got[1].loss == [rows[0][3], ""] and got[1].formatted.count("<|assistant|>") == 1
    assert [tuple(t) for t in got[2].turns] == [("user", "a")] * 2 and len(got) == 3
    assert "Python" not in out._jdf.queryExecution().toString() and chat.formatted(frame.limit(0)).count() == 0


def test_a_chat_of_many_turns(spark):
    rows = spark.range(6000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 5 < 3, "user").otherwise("assistant").alias("role"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    (r,) = chat.formatted(rows).select("formatted", chat.turns_of(F.col("formatted")).alias("turns")).collect()
    assert [t.text for t in r.turns] == [f"text {k}" for k in range(6000)] and r.formatted.count("<|end|>") == 2400


def test_long_conversations_take_linear_time(spark):
    """Alternating turns: each is a message of its own."""
    import time

    from ternway.llm import chat

    def took(n):
        turns = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.lit("x").alias("text"))
        began = time.time()
        text = chat.formatted(turns).first().formatted
        assert text.count(chat.END) == n
        return time.time() - began

    took(1000)
    assert took(80_000) < 3 * took(40_000) + 2

"""Substring dedup and near-dedup against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tarnline.llm import near_dedup, substring_dedup


def brute_spans(docs, w):
    split = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in docs]
    first = {}
    for d, x in split:
        for i in range(len(x) - w + 1):
            k = tuple(x[i : i + w])
            first[k] = min(first.get(k, d), d)
    out = {}
    for d, x in split:
        gone = [False] * len(x)
        for i in range(len(x) - w + 1):
            if first[tuple(x[i : i + w])] < d:
                gone[i : i + w] = [True] * w
        kept = " ".join(a for a, g in zip(x, gone, strict=True) if not g)
        out[d] = (len(x), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def mixed(seed, n):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(30)]
    base = [rng.choice(words) for _ in range(3000)]
    docs = []
    for d in range(n):
        t = []
        while rng.random() < 0.7:
            if rng.random() < 0.6:
                a = rng.randrange(2900)
                t += base[a : a + rng.randrange(20, 140)]
            elif rng.random() < 0.2:
                t += ["same"] * rng.randrange(200)
            else:
                t += [rng.choice(words) for _ in range(rng.randrange(60))]
        docs.append((3 * d, rng.choice([" ", "\n", "\t "]).join(t) if rng.random() < 0.95 else None))
    docs += [(1000, "é x " * 70), (1001, "é x " * 80), (1002, ""), (1003, " \n"), (1004, "w " * 3000)]
    rng.shuffle(docs)
    return docs


def test_substring_dedup(spark):
    docs = mixed(1, 120)
    df = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, spans string")
    got = {r.doc_id: r for r in substring_dedup.dedup(df).collect()}
    for d, expected in brute_spans(docs, 50).items():
        r = got.pop(d)
        assert (r.n_words, r.n_removed, r.kept_sha256) == expected
        assert r.n_removed == 0 or hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256
    assert not got


def test_substring_dedup_edges(spark):
    long = " ".join(map(str, range(60)))
    df = spark.createDataFrame([(None, long), (5, long), (5, long), (6, long)], "doc_id long, text string")
    rows = sorted(((r.doc_id or -1), r.n_removed) for r in substring_dedup.dedup(df).collect())
    assert rows == [(-1, 0), (5, 0), (5, 0), (6, 60)]
    assert substring_dedup.dedup(df.limit(0)).count() == 0


def test_substring_dedup_repeats_within_a_document(spark):
    def some(k, n):
        return [f"{k}{j}" for j in range(n)]

    a, b, x, y = some("a", 30), some("b", 40), some("x", 60), some("y", 75)
    docs = [(0, x), (1, (a + x + b) * 20), (2, x * 20), (3, some("c", 20) + y), (4, (a + y + y[:55] + b) * 7 + x[5:] * 3), (5, (y[10:] + a) * 9 + x), (6, (a + x + b) * 2)]
    docs = [(d, " ".join(t)) for d, t in docs]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.dedup(df, texts=False).collect()}
    assert got == brute_spans(docs, 50)
    assert got[1][1] == 1200


def test_many_small_mixes(spark):
    """Copied parts at all borders, repeats inside documents, runs of one word, against brute force."""
    for seed in (11, 12, 13):
        rng = random.Random(seed)
        words = [f"w{k}" for k in range(400)]
        base = [rng.choice(words) for _ in range(1500)]
        docs = []
        for d in range(90):
            t = []
            for _ in range(rng.randrange(1, 7)):
                a, n = rng.randrange(1300), rng.randrange(30, 180)
                t += rng.choice([base[a : a + n], base[a : a + n] * 2, ["same"] * n, [rng.choice(words) for _ in range(rng.randrange(40))]])
            if docs and rng.random() < 0.3:
                t = docs[rng.randrange(len(docs))][1].split() + t
            docs.append((d, " ".join(t)))
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.dedup(spark.createDataFrame(docs, "doc_id long, text string"), texts=False).collect()}
        assert got == brute_spans(docs, 50)


def test_compaction(spark):
    """Pieces in a row without a branch are one path; nodes with two ways, and other sources, end it."""
    rows = [(k, 0, k, k + 1, 5, 3, 5 * k) for k in range(8)]  # a chain in document 3
    rows += [(100, 0, 4, 900, 5, 6, 7), (101, 0, 900, 901, 2, 6, 12), (102, 0, 901, 902, 1, 7, 14), (103, 0, 902, 903, 1, 7, 90)]
    rows += [(200 + k, 0, 50 + k % 3, 50 + (k + 1) % 3, 1, 9, k) for k in range(3)]  # a circle
    df = spark.createDataFrame(rows, "h1 long, h2 long, head long, tail long, edges int, source long, at int")
    got = {r.h1: (r.source, r.start) for r in substring_dedup.compacted(df).collect()}
    expected = {k: (3, 0 if k < 4 else 20) for k in range(8)} | {100: (6, 7), 101: (6, 7), 102: (7, 14), 103: (7, 90)} | {200 + k: (9, 0) for k in range(3)}
    assert got == expected


def test_long_copies_are_few_spans(spark):
    """Spans end where the graph branches: where the third document's copy begins and ends."""
    text = [f"x{k}" for k in range(2000)]
    docs = [(1, " ".join(text)), (2, "a b c " + " ".join(text)), (3, " ".join(text[300:1700]))]
    spans = {r.doc_id: r.spans for r in substring_dedup.repeated_spans(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert len(spans[2]) == 3 and substring_dedup.covered(2003, spans[2], 50).sum() == 2000 and not substring_dedup.covered(2003, spans[2], 50)[:3].any()
    assert substring_dedup.covered(1400, spans[3], 50).all() and 1 not in spans


def test_without_repeats_keeps_columns(spark):
    long = " ".join(map(str, range(60)))
    df = spark.createDataFrame([(1, long, "a", 9, 1, 2), (2, long + " tail", "b", 9, 1, 2), (None, None, "c", None, 1, 2)], "doc_id long, text string, spans string, n_chars long, key int, copy int")
    assert near_dedup.first_of_class(df).columns == substring_dedup.without_repeats(df).columns == df.columns
    rows = {r.doc_id: r for r in substring_dedup.without_repeats(df).collect()}
    assert rows[1].text == long and rows[2].text == "tail" and rows[2].spans == "b" and rows[2].n_chars == 4 and rows[None].text is None


def brute_classes(docs, threshold=0.8):
    sets = {}
    for d, t in docs:
        w = (t or "").encode().split()
        sets[d] = Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both, either = (sets[a] & sets[b]).total(), (sets[a] | sets[b]).total()
            if either and both >= threshold * either:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d in ids}


def near_docs(seed):
    rng = random.Random(seed)
    words = [f"v{k}" for k in range(500)]
    base = [rng.choice(words) for _ in range(150)]
    passage = [rng.choice(words) for _ in range(70)]
    docs = []
    for d in range(260):
        kind = d % 4
        if kind == 0:  # near copies of one document
            t = base[:]
            for _ in range(rng.randrange(6)):
                t[rng.randrange(len(t))] = rng.choice(words)
        elif kind == 1:  # one passage in different texts
            t = [rng.choice(words) for _ in range(60)] + passage
        elif kind == 2:
            t = ["again", "and"] * rng.randrange(1, 40)
        else:
            t = [rng.choice(words) for _ in range(rng.randrange(80))]
        docs.append((d, " ".join(t)))
    return [*docs, (900, None), (901, ""), (902, "short text"), (903, "short  text"), (904, docs[0][1])]


def test_near_duplicates(spark):
    docs = near_docs(2)
    df = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, bands string")
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(df).collect()}
    assert got == brute_classes(docs)
    kept = {r.doc_id for r in near_dedup.first_of_class(df).collect()}
    assert kept == {d for d, c in got.items() if d == c}


def test_near_duplicates_edges(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
    rows = sorted((r.doc_id or -1, r.class_id or -1, r.is_first) for r in near_dedup.near_duplicates(df).collect())
    assert rows == [(-1, -1, True), (1, 1, True), (1, 1, True), (2, 1, False)]
    assert near_dedup.near_duplicates(df.limit(0)).count() == 0


def test_blocks_of_buckets(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 7)
    monkeypatch.setattr(near_dedup, "STAR", 3)
    docs = near_docs(5)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in near_dedup.near_duplicates(df).collect()} == brute_classes(docs)


def test_unlike_documents_of_many_buckets(spark, monkeypatch):
    """Documents that share most buckets, all just too unlike their least member, with links among some."""
    monkeypatch.setattr(near_dedup, "BLOCK", 9)
    rng = random.Random(7)
    words = [f"u{k}" for k in range(3000)]
    base = [rng.choice(words) for _ in range(400)]
    docs = []
    for d in range(60):
        t = base[:]
        for j in range(0, 400, 9 + d % 3):
            t[j] = rng.choice(words)
        docs.append((2 * d, " ".join(t)))
        if d % 4 == 0:
            t[7] = "other"
            docs.append((2 * d + 1, " ".join(t)))
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute_classes(docs) and 5 < len(set(got.values())) < len(docs)


def test_very_long_texts(spark):
    rng = random.Random(3)
    long = [f"w{rng.randrange(9000)}" for _ in range(60_000)]
    near = long[:]
    for k in range(0, 60_000, 200):
        near[k] = "changed"
    docs = [(1, " ".join(long)), (2, " ".join(near)), (3, "same word again " * 30_000), (4, "same word again " * 26_000), (5, "same word again " * 9000)]
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute_classes(docs) == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5}


def test_repeated_ids_share_a_class(spark):
    docs = near_docs(6)
    df = spark.createDataFrame([*docs, (0, docs[7][1]), (4, docs[1][1] + " more"), (8, "other text of the same id")], "doc_id long, text string")
    rows = near_dedup.near_duplicates(df).collect()
    assert len(rows) == len(docs) + 3 and len({r.class_id for r in rows if r.doc_id in (0, 7)}) == 1


def test_signatures_are_unbiased():
    rng = random.Random(1)
    gaps = []
    for trial in range(10):
        a, b = {}, {}
        for s in range(250):
            u, w = rng.random(), rng.choice([1, 1, 2, 3, 7])
            if u < 0.75:
                a[s] = w
            if u < 0.6 or u > 0.75:
                b[s] = w if u < 0.6 else rng.choice([1, 5])
        owner = np.array([0] * len(a) + [1] * len(b))
        s = near_dedup.mix(np.array([*a, *b], np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(trial))
        sig = near_dedup.bag_min_hash(owner, s, np.array([*a.values(), *b.values()]), 2, 1500)
        keys = set(a) | set(b)
        true = sum(min(a.get(x, 0), b.get(x, 0)) for x in keys) / sum(max(a.get(x, 0), b.get(x, 0)) for x in keys)
        gaps.append((sig[0] == sig[1]).mean() - true)
    assert abs(np.mean(gaps)) < 0.012 and max(map(abs, gaps)) < 0.05


def test_near_dedup_reads_few_texts(spark, monkeypatch):
    """Texts that share no bucket are not dealt by id; those that do all are."""
    rng = random.Random(8)
    docs = [(k, " ".join(str(rng.randrange(10**6)) for _ in range(60))) for k in range(400)]
    docs += [(1000 + k, docs[k][1] + " end") for k in range(10)] + [(2000, None), (None, "a b c d e f")]
    tables = []
    monkeypatch.setattr(near_dedup, "written", lambda df, write=near_dedup.written: tables.append(write(df)) or tables[-1])
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(frame).collect()}
    assert got == {d: d - 1000 if d and 1000 <= d < 1010 else d for d, _ in docs}
    read = [sorted(r.doc_id for r in t.collect()) for t in tables if "text" in t.columns]
    assert read == [[*range(10), *range(1000, 1010)]]
    # With few bits some more pass, and none is missing.
    ids = spark.range(0, 400, 20).select(F.col("id").alias("doc"))
    some = {r.doc_id for r in near_dedup._among(frame.where("doc_id < 400"), ids, 128).collect()}
    assert {*range(0, 400, 20)} <= some and len(some) < 200


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(k, k + 1) for k in range(300, 340)]
    root = {k: k for k in range(400)}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.id: r.root for r in near_dedup.components(spark.createDataFrame(links, "a long, b long")).collect()}
    for a, b in links:
        for x in (a, b):
            assert got.get(x, x) == find(x)

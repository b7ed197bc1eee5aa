"""Language ID, toxicity, nearest neighbours, media and licenses."""

import hashlib
import json
import math
import os
import struct
import tracemalloc
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tarnline.llm import language_id, licenses, media, nearest, toxicity
from tarnline.llm.registry import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def by_counts(texts, order):
    """Runs of order + 1 bytes of padded texts and their counts, as learn() gathers them."""
    return np.unique(np.concatenate([language_id._numbers(language_id._folded(t, order), order) for t in texts]), return_counts=True)


@pytest.mark.parametrize("order", [1, 3, 4])
def test_code_lengths_are_a_code(order):
    texts = [["the cat sat on the mat", "zzz é"], ["der hund und die katze", "日本語 text"]]
    model = language_id.trees([by_counts(t, order) for t in texts], order)
    for context in (b"    ", b"the ", b"er h", b"qqqq", "日本"[-4:].encode()[-4:], b"z z "):
        head = int.from_bytes(context[4 - order :], "big") << 8
        bits = model.code(np.arange(256, dtype=np.uint64) | np.uint64(head))
        assert np.allclose(np.exp2(-bits.astype(float)).sum(axis=0), 1, atol=1e-5)


def test_hash_tables():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 2**40, 5000).astype(np.uint64))
    table = language_id.Table(keys)
    assert (table.find(keys) == np.arange(len(keys))).all()
    other = np.setdiff1d(rng.integers(0, 2**40, 5000).astype(np.uint64), keys)
    assert (table.find(other) == -1).all() and (language_id.Table(keys[:0]).find(keys) == -1).all()


@needs_data
def test_language_accuracy(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = QUERIES["op6_language_id"](spark, DATA).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.98 * len(rows)


def test_language_edges(spark):
    train = [(k, "the cat and the dog " * 5, "en") for k in range(40)] + [(100 + k, "der hund und die katze " * 5, "de") for k in range(40)]
    odd = [(900, None, "en"), (901, "12 34 !?", None), (None, "the dog", "xx"), (902, "", "de")]
    docs = spark.createDataFrame([(*r, 1) for r in train + odd], "doc_id long, text string, lang string, score int")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(docs, language_id.learn(docs)).collect()}
    assert got[900] == got[901] == got[902] == ("und", 0.0) and got[None][0] == "en" and got[100][0] == "de"
    kept = language_id.known(docs, language_id.learn(docs))
    assert kept.columns == docs.columns and kept.count() == 81
    twice = language_id.identify(docs.unionAll(docs), language_id.learn(docs.unionAll(docs), per_language=30)).collect()
    assert len(twice) == 2 * docs.count() and len({(r.doc_id, r.lang_pred, r.score) for r in twice}) == docs.count()
    none = language_id.learn(docs.limit(0))
    assert {r.lang_pred for r in language_id.identify(docs, none).collect()} == {"und"}


def ppm_bits(train, text, order=language_id.ORDER):
    """Bits of text under byte trees of the texts in train, all 256 bytes alike at the root."""
    pad = b" " * order
    trees = [{} for _ in range(order + 1)]
    for x in (pad + t.encode() for t in train):
        for i in range(order, len(x)):
            for k in range(order + 1):
                seen = trees[k].setdefault(x[i - k : i], {})
                seen[x[i]] = seen.get(x[i], 0) + 1

    def shares(context):
        shorter = shares(context[1:]) if context else [1 / 256] * 256
        seen = trees[len(context)].get(context)
        if not seen:
            return shorter
        whole, rest = sum(seen.values()) + len(seen), sum(p for b, p in enumerate(shorter) if b not in seen)
        return [seen[b] / whole if b in seen else len(seen) / whole * p / rest for b, p in enumerate(shorter)]

    x = pad + text.encode()
    return -sum(math.log2(shares(x[i - order : i])[x[i]]) for i in range(order, len(x)))


def test_language_of_rare_bytes(spark):
    filler = "".join(map(chr, range(0x21, 0x41))) + "abcdefghi"
    train = {"aa": [filler * 3 + " xq zk"] * 4, "bb": [filler * 3 + " qx kz", filler + " ж"] * 2}
    rows = [(k, t, lang) for k, (lang, t) in enumerate((lang, t) for lang, texts in train.items() for t in texts * 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.learn(docs, every=0)
    held = {r.doc_id for r in language_id.identify(docs, model).where("held_out").collect()}
    used = {lang: [t for k, t, x in rows if x == lang and k not in held] for lang in train}
    texts = ["xq", "zk", "qx", "kz", "xqzk kz", "ж", "世q", "a=b x"]
    names, scores, bits, size = language_id.score(texts, model)
    assert names[:4] == ["aa", "aa", "bb", "bb"]
    for text, name, p in zip(texts, names, scores.tolist(), strict=True):
        a, b = (ppm_bits(used[lang], text) for lang in ("aa", "bb"))
        assert name == ("aa" if a <= b else "bb") and math.isclose(p, 1 / (1 + 2 ** -abs(a - b)), rel_tol=1e-4)


def test_language_of_long_texts(spark, monkeypatch):
    """Texts are scored whole, in pieces; ties go to the first language."""
    rows = [(k, f"the cat and the dog {k} " * 4, "en") for k in range(40)] + [(100 + k, f"der hund und die katze {k} " * 4, "de") for k in range(40)] + [(200 + k, f"der hund und die katze {k} " * 4, "dd") for k in range(40)]
    model = language_id.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_language=40)
    texts = ["the cat " * 30 + "der hund und die katze " * 200, "x", "the dog", "der hund"] * 3
    whole = language_id.score(texts, model)
    monkeypatch.setattr(language_id, "PIECE", 37)
    parts = language_id.score(texts, model)
    assert whole[0] == parts[0] and np.allclose(whole[2], parts[2], rtol=1e-5) and whole[0][0] in ("dd", "de") and whole[0][2] == "en"
    tied = language_id.trees([by_counts(["aa bb"], 4)] * 2, 4)
    tied.languages = ["p", "q"]
    assert language_id.score(["bb aa"], tied)[0] == ["p"]


def test_language_membership(spark):
    rng = np.random.default_rng(4)
    words = {"en": "the cat and dog sat on a mat with old friends near some quiet river".split(), "de": "der hund und die katze liegen auf einer matte mit alten freunden".split()}
    rows = [(1000 * j + k, " ".join(rng.choice(w, 40)), lang) for j, (lang, w) in enumerate(words.items()) for k in range(200)]
    model = language_id.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_language=80)
    odd = [(1, "cat"), (2, " ".join(rng.choice(words["en"], 9))), (3, "".join(rng.choice(list("qxzjkvw"), 400))), (4, "Съешь же ещё этих мягких французских булок " * 3)]
    assert {r.doc_id for r in language_id.known(spark.createDataFrame(odd, "doc_id long, text string"), model).collect()} == {1, 2}
    with pytest.raises(ValueError):
        language_id.MODEL_BYTES, most = 1, language_id.MODEL_BYTES
        try:
            language_id.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
        finally:
            language_id.MODEL_BYTES = most


@needs_data
def test_toxicity_held_out(spark):
    data = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{data}/labels.parquet").select("doc_id", "toxic")
    rows = QUERIES["op9_toxicity"](spark, data).join(labels, "doc_id").where("held_out").collect()
    hit = sum(r.predicted and r.toxic for r in rows)
    assert hit >= 0.85 * sum(r.toxic for r in rows) and hit >= 0.9 * sum(r.predicted for r in rows)


def toxic_rows(n=400):
    rng = np.random.default_rng(3)
    rows, labels = [], []
    for k in range(n):
        toxic = k % 4 == 0
        group = rng.choice(["women", "men"], p=[0.9, 0.1] if toxic else [0.1, 0.9])
        words = [f"w{x}x" for x in rng.integers(0, 50, 12)] + [group] + ["vile"] * (toxic and rng.random() < 0.8)
        rng.shuffle(words)
        rows.append((k, " ".join(words)))
        labels.append((k, int(toxic)))
    return rows, labels


def test_counterfactual_penalty(spark, monkeypatch):
    rows, labels = toxic_rows()
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")

    def gap():
        model = toxicity.learn(docs, marks)
        z = toxicity.logits(["some women here", "some men here", "vile"], model, toxicity._Hits(model.weights))
        return abs(z[0] - z[1]), z[2]

    with_penalty, vile = gap()
    monkeypatch.setattr(toxicity, "PENALTY", 0.0)
    assert with_penalty < 0.3 * gap()[0] and vile > 0


def test_swapped_texts():
    """What a swap changes are the features of the new text less those of the old one."""
    texts = ["black women, and womenfolk", "women women.", "no one", "Jews and christians"]
    sample = toxicity.Sample.of(pa.array([sorted(set(t.lower().split())) for t in texts], pa.list_(pa.string())))
    terms = {f for t in ("black white asian latino women men jews christians muslims hindus buddhists atheists and womenfolk no one".split()) for f in toxicity.features(t)}
    index = {f: k for k, f in enumerate(sorted(terms))}
    of_piece = toxicity.Features(sample.pieces, index.get)
    pair, feature, sign = toxicity._swapped(sample, of_piece, index)
    got = {}
    for p, f, s in zip(pair.tolist(), feature.tolist(), sign.tolist(), strict=True):
        got.setdefault(p, set()).add((f, s))
    def held(text):
        return {index[f] for w in text.lower().split() for f in toxicity.features(w) if f in index}
    swaps = [(texts[0], a, b) for a, others in (("black", ("white", "asian", "latino")), ("women", ("men",))) for b in others] + [(texts[1], "women", "men")]
    swaps += [(texts[3], a, b) for a in ("jews", "christians") for b in toxicity.IDENTITY[4] if b != a]
    expected = []
    for text, a, b in swaps:
        new = toxicity._WORD.sub(lambda m, a=a, b=b: b if m[0] == a else m[0], text.lower())
        expected.append({(f, 1.0) for f in held(new) - held(text)} | {(f, -1.0) for f in held(text) - held(new)})
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, (e for e in expected if e)))


def test_toxicity_long_and_repeated(spark):
    rows, labels = toxic_rows(200)
    long = "w1x " * 50_000
    docs = spark.createDataFrame([*rows, rows[0], rows[0], (900, long), (901, long + "vile"), (901, long + "vile"), (902, "vile"), (902, "vile")], "doc_id long, text string")
    model = toxicity.learn(docs, spark.createDataFrame([*labels, (901, 1), (901, 0)], "doc_id long, toxic int"), sample=30)
    got = {}
    for r in toxicity.scored(docs, model).collect():
        got.setdefault(r.doc_id, set()).add(r.score)
    assert all(len(s) == 1 for s in got.values()) and min(got[901]) > max(got[900])


def test_toxicity_edges(spark):
    rows, labels = toxic_rows(100)
    docs = spark.createDataFrame([*((*r, 1.0) for r in rows), (None, "vile", 1.0), (999, None, 1.0), (998, "", 1.0)], "doc_id long, text string, score double")
    marks = spark.createDataFrame([*labels, labels[0], (None, 1), (5, None)], "doc_id long, toxic int")
    got = toxicity.scored(docs, toxicity.learn(docs, marks)).collect()
    assert len(got) == 103 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert toxicity.clean(docs, toxicity.learn(docs, marks)).columns == docs.columns
    blank = toxicity.learn(docs, marks.limit(0))
    assert toxicity.scored(docs.limit(0), blank).count() == 0


def brute_nearest(ids, x, q, k):
    d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
    d[ids == q] = np.inf
    best = np.lexsort((ids, d))[:k]
    return [(int(ids[b]), float(d[b])) for b in best if np.isfinite(d[b])]


@needs_data
@pytest.mark.parametrize("data", [DATA, "/root/testdata/sf0.1"])
def test_nearest_recall(spark, data):
    found = {}
    for r in QUERIES["op8_nearest"](spark, data).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{data}/embeddings.parquet'").fetchall()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    hits = total = 0
    for q, got in found.items():
        got.sort()
        true = brute_nearest(ids, x, q, 10)
        assert [g[0] for g in got] == list(range(1, 11)) and [(s, v) for _, v, s in got] == sorted((s, v) for _, v, s in got)
        hits += len({v for _, v, _ in got} & {v for v, _ in true})
        total += 10
    assert hits >= 0.9 * total and len(found) == (ids % 100 == 0).sum()


def test_nearest_prunes_clusters(spark):
    """Recall on queries that the tree has not seen, where few of the leaves are visited."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 24))[rng.integers(0, 300, 12_000)] + 0.25 * rng.normal(size=(12_000, 24))
    df = spark.createDataFrame([(k, v) for k, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = {}
    for r in nearest.search(df, F.col("vec_id") % 40 == 0, sample=3000).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    ids = np.arange(len(x))
    hits = [len(got[q] & {v for v, _ in brute_nearest(ids, x, q, 10)}) for q in range(0, len(x), 40)]
    assert sum(hits) >= 0.9 * 10 * len(hits)
    flat = df.select("vec_id", F.col("embedding").alias("v"))
    _, tree, wide = nearest.fitted(flat, len(x), 10, 3000, nearest.LEAF_ROWS, nearest.TARGET, 200)
    rows = np.bincount(tree.assign(x), minlength=tree.leaves)
    assert np.mean([rows[tree.visits(x[q], wide)].sum() for q in range(0, len(x), 40)]) <= 0.1 * len(x)


def test_nearest_repeated_and_huge(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(60, 3)) * np.where(np.arange(60) % 7 == 0, 1e300, 1.0)[:, None]
    rows = [(k, v) for k, v in enumerate(x.tolist())] + [(5, x[9].tolist()), (5, x[5].tolist()), (0, x[3].tolist())]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, bin int, query_id int")
    got = nearest.search(df, F.col("vec_id") < 10, k=4, target=1.0).collect()
    with np.errstate(over="ignore"):
        for q in {r.query_id for r in got}:
            for own in [v for k, v in rows if k == q][:1]:
                true = sorted((float(nearest.distances(np.array(own), np.array([v]))[0]), k) for k, v in rows if k != q)[:4]
                if q not in (0, 5):
                    assert [(r.vec_id, r.score) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == [(k, d) for d, k in true]
    assert {r.query_id for r in got} == set(range(10)) and all(np.isfinite(r.score) for r in got)


def test_nearest_hot_and_bad_vectors(spark, monkeypatch):
    monkeypatch.setattr(nearest, "BIN", 64)
    monkeypatch.setattr(nearest, "ASKS", 2)
    rng = np.random.default_rng(2)
    same = [float(v) for v in rng.normal(size=8)]
    rows = [(k, same if k % 3 == 0 else [float(v) for v in rng.normal(size=8)], "x") for k in range(900)]
    rows += [(1000, None, "x"), (1100, [0.0] * 8, "x"), (1200, [float("nan")] * 8, "x"), (1300, [None] + same[1:], "x"), (1400, [1.0], "x"), (1500, [float("inf")] + same[1:], "x"), (None, same, "x"), (1600, [], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, leaf string")
    got = nearest.search(df, F.col("vec_id") % 100 == 0, target=1.0).collect()
    good = [r for r in rows if r[0] is not None and r[0] < 900]
    ids, x = np.array([r[0] for r in good]), np.array([r[1] for r in good])
    hits = 0
    for q in range(0, 900, 100):
        mine = sorted((r["rank"], r.vec_id) for r in got if r.query_id == q)
        true = brute_nearest(ids, x, q, 10)
        if q % 3 == 0:
            assert [v for _, v in mine] == [v for v, _ in true]
        hits += len({v for _, v in mine} & {v for v, _ in true})
    assert hits >= 0.9 * 90 and {r.query_id for r in got} == set(range(0, 900, 100))
    assert nearest.search(df.limit(0), F.lit(True)).count() == 0


def pnm(kind, x, most=255):
    h, w, d = x.shape
    head = f"P{kind}\n# note\n{w} {h}\n".encode() + (b"" if kind in (1, 4) else b"%d\n" % most)
    if kind in (2, 3):
        return head + " ".join(map(str, x.reshape(-1))).encode()
    if kind == 1:
        return head + b" ".join(b"%d" % (v == 0) for v in x.reshape(-1))
    if kind == 4:
        return head + np.packbits(x[:, :, 0] == 0, axis=1).tobytes()
    return head + x.tobytes()


def bmp(x):
    h, w, _ = x.shape
    row = -(-w * 3 // 4) * 4
    body = b"".join(x[i, :, ::-1].tobytes().ljust(row, b"\0") for i in reversed(range(h)))
    return struct.pack("<2sIHHI", b"BM", 54 + len(body), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, len(body), 0, 0, 0, 0) + body


def test_decode():
    rng = np.random.default_rng(1)
    rgb, grey = rng.integers(0, 256, (5, 7, 3), np.uint8), rng.integers(0, 256, (5, 11, 1), np.uint8)
    black = (grey > 99).astype(np.uint8) * 255
    assert (media.decode(pnm(6, rgb)) == rgb).all() and (media.decode(pnm(3, rgb)) == rgb).all() and (media.decode(bmp(rgb)) == rgb).all()
    assert (media.decode(pnm(5, grey)) == grey).all() and (media.decode(pnm(2, grey)) == grey).all()
    assert (media.decode(pnm(1, black)) * 255 == black).all() or (media.decode(pnm(1, black)) == black).all()
    assert (media.decode(pnm(4, black)) == black).all()
    with pytest.raises(ValueError):
        media.decode(b"GIF89a")


def test_area_resize_and_hash():
    x = np.arange(48, dtype=np.uint8).reshape(6, 8, 1)
    assert np.allclose(media.area_resize(x, 3, 4)[:, :, 0], x.reshape(3, 2, 4, 2).mean(axis=(1, 3)))
    assert np.allclose(media.area_resize(x, 1, 1), x.mean()) and np.allclose(media.area_resize(x, 6, 8), x)
    assert np.isclose(media.area_resize(x, 4, 3).mean(), x.mean())
    assert media.difference_hash(x) == "ff" * 8 and media.difference_hash(x[:, ::-1]) == "00" * 8


def test_media_tiles(spark):
    x = np.random.default_rng(1).integers(0, 256, (20, 30, 3), np.uint8)
    rows = media.media_tiles(spark.createDataFrame([(1, bytearray(pnm(6, x))), (2, bytearray(b"junk")), (None, None)], "id long, data binary"), size=16).collect()
    one = next(r for r in rows if r.id == 1)
    back = np.zeros_like(x)
    for t in one.tiles:
        part = media.from_npy(bytes(t.npy))
        back[t.y : t.y + part.shape[0], t.x : t.x + part.shape[1]] = part
    assert (back == x).all() and len(one.tiles) == 4
    assert all(r.tiles == [] and r.hash is None for r in rows if r.id != 1)


def test_bad_netpbm():
    for data in (b"P2 1 1 9\n99", b"P3 1 1 9\n1 2 10", b"P5\n1 1\n9\n" + bytes([99]), b"P6\n1 1\n300\n" + struct.pack(">3H", 1, 2, 301), b"P2 1 1 99999\n1", b"P2 1 1 9\n-4"):
        with pytest.raises(ValueError):
            media.decode(data)


def test_hash_of_parts():
    x = np.random.default_rng(3).integers(0, 256, (70, 64, 3), np.uint8)
    for step in (1, 7, 32, 70):
        parts = [x[a : a + step] for a in range(0, 70, step)]
        assert media.hash_of_parts(parts, 70) == media.difference_hash(x)
        assert np.allclose(media._resized(parts, 70, 5, 6), media.area_resize(x, 5, 6))
    assert (media.joined(media.tiles(x, 16)) == x).all()


def test_text_media(spark):
    """All columns against a plain version; repeated rows alike; no tile above TILE rows."""
    texts = [(1, "abc"), (2, None), (3, ""), (4, "é" * 96), (5, "é" * 97), (None, "abc"), (6, "x" * 100_000), (6, "x" * 100_000), (7, "日本語 " * 9000), (8, "\x00" * 192)]
    docs = spark.createDataFrame([(*t, 1) for t in texts], "doc_id long, text string, media int")
    stored = media.store_texts(docs)
    kept = {}
    for r in stored.collect():
        data = (dict(texts)[r.doc_id] or "").encode()
        x = [media.from_npy(bytes(t)) for t in r.tiles]
        assert all(len(t) <= media.TILE and t.dtype == np.uint8 for t in x) and len(x) == -(-sum(map(len, x)) // media.TILE)
        assert r.n_bytes == len(data) and b"".join(t.tobytes() for t in x) == data.ljust(max(192, -(-len(data) // 192) * 192))
        kept[r.doc_id] = b"".join(map(bytes, r.tiles))
    rows = media.read_media(stored).collect()
    for r in rows:
        data = (dict(texts)[r.doc_id] or "").encode()
        payload = data.ljust(max(192, -(-len(data) // 192) * 192))
        whole = np.frombuffer(payload, np.uint8).reshape(-1, 64, 3)
        assert tuple(r) == (
            r.doc_id, len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(kept[r.doc_id]), hashlib.sha256(kept[r.doc_id]).hexdigest(), media.difference_hash(whole),
        )
    assert len(rows) == len(texts) and len({tuple(r)[1:] for r in rows if r.doc_id in (1, None)}) == 1
    assert media.read_media(media.store_texts(docs.limit(0))).count() == 0


@needs_data
def test_licenses_match_sql(spark):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    theirs = sorted(db.execute(ORACLE_SQL["op7_license_scan"]).fetchall())
    ours = sorted(tuple(r) for r in QUERIES["op7_license_scan"](spark, DATA).select("doc_id", "license", "n_shingles", "n_found", "containment").collect())
    assert ours == theirs and theirs


def test_license_edges(spark):
    text = licenses.TEMPLATES[4][1]
    cut = text.replace("free of charge, to any", "free of charge, for any")
    rows = [(1, text.upper()), (2, "x " * 500 + text + " y" * 5000), (3, cut), (4, None), (5, ""), (6, "Released under the MIT"), (7, "(released, UNDER the MIT license)"), (None, text), (8, "licensed " * 100)]
    rows += [(9, "Released under the MIT License"), (9, "Released under the MIT License"), (10, "word " * 200_000 + "Licensed under CC BY-NC 4.0" + " word" * 200_000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, license string")
    found = licenses.scan(df).collect()
    got = {(r.doc_id, r.license) for r in found}
    assert got >= {(1, "MIT-text"), (2, "MIT-text"), (7, "MIT"), (None, "MIT-text"), (10, "CC-BY-NC-4.0")} and not {d for d, _ in got} & {4, 5, 6, 8}
    assert sum(r.doc_id == 9 and r.license == "MIT" for r in found) == 2
    share = len(set(licenses.shingles_of(text)) & set(licenses.shingles_of(cut))) / len(licenses.shingles_of(text))
    assert ((3, "MIT-text") in got) == (share >= 0.8)
    assert licenses.scan(df.limit(0)).count() == 0
    json.dumps(sorted(map(str, got)))


def test_license_pivots():
    """No document can contain enough of a template without a pivot."""
    shingles = [licenses.shingles_of(t) for _, t in licenses.TEMPLATES]
    words = set(licenses.pivots(shingles))
    for s in shingles:
        assert sum(not words & set(x.split()) for x in s) < 0.8 * len(s)


def test_license_table(spark):
    """Templates from a table; changed and scattered notices against containment by hand."""
    rng = np.random.default_rng(6)
    templates = [(f"T{k}", " ".join(f"t{x}" for x in rng.integers(0, 60, 5 + 4 * k))) for k in range(14)]
    docs = []
    for d in range(160):
        words = templates[d % 14][1].split()
        for _ in range(rng.integers(0, 3)):
            words[rng.integers(len(words))] = "other"
        if d % 3 == 0:  # scattered: each shingle of the template alone
            words = [w for s in rng.permutation(licenses.shingles_of(" ".join(words))).tolist() for w in [*s.split(), "gap"]]
        docs.append((d, " ".join([*(f"x{x}" for x in rng.integers(0, 99, 30)), *words, "end"])))
    got = {(r.doc_id, r.license): (r.n_shingles, r.n_found) for r in licenses.scan(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(templates, "license string, text string")).collect()}
    expected = {}
    for d, text in docs:
        held = set(licenses.shingles_of(text))
        for name, t in templates:
            s = licenses.shingles_of(t)
            if len(held & set(s)) >= 0.8 * len(s):
                expected[d, name] = (len(s), len(held & set(s)))
    assert got == expected and len(expected) > 60
    with pytest.raises(ValueError):
        licenses.scan(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([("short", "too few words")], "license string, text string"))
    with pytest.raises(ValueError):
        licenses.scan(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([("long", "many words here " * 400_000)], "license string, text string"))


def test_toxicity_learns_in_little_memory():
    """Pairs of texts and features are counted as they come: 7 million of them would take 110 MB."""
    rng = np.random.default_rng(2)
    words = ["".join(chr(97 + int(c)) for c in row) for row in rng.integers(0, 26, (30_000, 8))]
    code = np.concatenate([np.sort(rng.choice(len(words), 400, replace=False)) for _ in range(3000)])
    sample = toxicity.Sample(words, code, np.arange(0, len(code) + 1, 400))
    toxic = (np.arange(3000) % 2).astype(float)
    tracemalloc.start()
    model = toxicity.fit(sample, toxic, np.ones(3000))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(model.weights) >= toxicity.FEATURES and peak < 200e6, peak

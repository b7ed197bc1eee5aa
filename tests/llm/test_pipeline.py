"""The pipeline's stages on the small tables, and on planted texts against brute force."""

import os
import random
import zlib

import pytest

import corpus_pipeline
from tarnline.llm.tokens import ByteBpe, packed
from tests.llm.test_dedup import brute_classes, brute_spans

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@needs_data
def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, before = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, DATA))
        after = {r.doc_id for r in docs.select("doc_id").collect()}
        assert docs.columns == columns and after <= before and docs.count() == len(after)
        before = after
    assert len(before) > 100
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, DATA).collect()
    assert {r.doc_id for r in pieces} == before


def planted(seed):
    """Documents with toxic ones, near and exact copies, long passages in common, junk and nulls; and the labels of three quarters of them."""
    rng = random.Random(seed)
    words = [a + b for a in "ka lo mi nu re sa to vi wo".split() for b in "ban del fir gus hom jit lem pon".split()]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    passage, rows, toxic = text(120), [], set()
    for d in range(260):
        t = text(rng.randrange(60, 160))
        if d % 5 == 0:
            t[rng.randrange(len(t))] = "vilescum"
            toxic.add(d)
        elif d % 7 == 0:
            t = t[:30] + passage + t[30:]
        rows.append((d, t))
    clean = [(d, t) for d, t in rows if d not in toxic]
    for k, (_, t) in enumerate(clean[:40]):
        copy = t[:]
        if k % 2:
            copy[rng.randrange(len(copy))] = "changed"
        rows.append((300 + k, copy))
    out = [(d, " ".join(t), "en" if d % 2 else "xx", "s", len(" ".join(t))) for d, t in rows]
    out += [(400, None, None, "s", None), (401, "1234 567", "en", "s", 8), (402, "".join(random.Random(1).choices("ЩЖДЙЪФЁЭ", k=600)), None, "s", 600), (None, " ".join(text(70)), "en", "s", 1), (12, out[12][1], "en", "s", out[12][4])]
    return out, toxic


def test_planted_texts(spark, tmp_path):
    rows, toxic = planted(5)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(d, 1, int(d in toxic)) for d in range(260)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    stages, kept = dict(corpus_pipeline.STAGES), docs
    held = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    clean = [r for r in rows if r[0] not in toxic]
    kept = corpus_pipeline.written(stages["toxicity"](spark, kept, str(tmp_path)))
    assert held(kept) == sorted(((r[0], r[1]) for r in clean), key=str)
    kept = corpus_pipeline.written(stages["language_id"](spark, kept, str(tmp_path)))
    known = [r for r in clean if r[0] not in (400, 401, 402)]
    assert held(kept) == sorted(((r[0], r[1]) for r in known), key=str)
    kept = corpus_pipeline.written(stages["near_dedup"](spark, kept, str(tmp_path)))
    classes = brute_classes([(r[0], r[1]) for r in known if r[0] is not None])
    first = [r for r in known if r[0] is None or classes[r[0]] == r[0]]
    assert held(kept) == sorted(((r[0], r[1]) for r in first), key=str) and len(first) < len(known) - 30
    kept = corpus_pipeline.written(stages["substring_dedup"](spark, kept, str(tmp_path)))
    spans = brute_spans(sorted({(r[0], r[1]) for r in first if r[0] is not None}), 50)
    for r in kept.collect():
        if r.doc_id is not None:
            whole = dict((x[0], x[1]) for x in first)[r.doc_id]
            assert len(whole.split()) - len(r.text.split()) == spans[r.doc_id][1] and r.n_chars == (len(r.text) if spans[r.doc_id][1] else len(whole))
    assert sum(s[1] for s in spans.values()) > 2000
    coder, got = ByteBpe(), {}
    rows = kept.collect()
    for r in stages["packing"](spark, kept, str(tmp_path)).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32, r.doc_tokens))
    assert set(got) == {r.doc_id for r in rows}
    for r in rows:
        ids = coder.unit_by_library(r.text) + packed([1])
        if sum(x.doc_id == r.doc_id for x in rows) == 1:
            for start, length, crc, n in got[r.doc_id]:
                assert crc == zlib.crc32(ids[4 * start : 4 * (start + length)]) and n == len(ids) // 4
            assert sum(x[1] for x in got[r.doc_id]) == len(ids) // 4
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(str, (r.doc_id for r in whole.select("doc_id").distinct().collect()))) == sorted(map(str, got))


@needs_data
def test_empty(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA)
    assert docs.count() == 0

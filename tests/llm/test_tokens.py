"""Encoders against the library; the transducer; token files; packing."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tarnline.llm import bpe, packing, token_files
from tarnline.llm.tokens import ByteBpe, WordBpe, packed

ODD = [
    "", " ", "\n", "a  b", "  a", "x\n\ny", "x \n y", "a <|endoftext|> b", "<|endoftext|>", "<|startoftext|>x", "don't  stop's", "a\x1cb c", "tab\there",
    "trail ", "é ü x   y", "İstanbul ΣΑΣ ſ ǅ", "日本 語 abc123 45", "ÀÉ. Straße, x.", "á b́", "́ a", "a\r\nb", "ª º µ", "²½ x².",
    "x　y z", ". ,", "1.", "aaaaaaa" * 30, "ab" * 500, "-" * 900, " " * 700, "the" * 200,
]


@pytest.fixture(scope="module")
def coders():
    return ByteBpe(), WordBpe(), bpe.Encoder()


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(coders, text):
    for c in coders[:2]:
        assert c.encode(text) == c.unit_by_library(text)
    assert coders[2].encode(text) == coders[0].unit_by_library(text)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("ab thein\n .,'s1é日́\x1c İ"), st.characters(codec="utf-8")), max_size=80))
def test_random_texts(coders, text):
    byte, word, own = coders
    ids = byte.unit_by_library(text)
    assert byte.encode(text) == ids == own.encode(text)
    assert word.encode(text) == word.unit_by_library(text)
    for size in (1, 3, 50):
        assert b"".join(own.stream(text[k : k + size] for k in range(0, len(text), size))) == ids
        slow, out = bpe.Runs(own), []
        for k in range(0, len(text), size):
            out.append(slow.feed(text[k : k + size]))
        assert b"".join([*out, slow.feed("", True)]) == ids
    blocks = [ids[k : k + 8] for k in range(0, len(ids), 8)]
    assert "".join(bpe.Decoder(own.merges).decode(blocks)) == byte.library.decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False)


PART = st.one_of(st.sampled_from(["a" * 40, "-" * 30, " " * 25, "é" * 20, "7" * 30, "\n" * 9, "\t\n" * 6, "'re", "'s", "<|endoftext|>", "<|endof", "ab", " ", "\n", "日本語" * 5, "x\n\ny"]), st.text(max_size=5))


@settings(max_examples=300, deadline=None)
@given(st.lists(PART, max_size=9), st.integers(1, 60))
def test_long_runs_in_pieces(coders, parts, size):
    """Runs longer than what is held, in pieces of any size."""
    byte, _, own = coders
    text, held = "".join(parts), bpe.HELD
    bpe.HELD = 4
    try:
        out = b"".join(own.stream(text[k : k + size] for k in range(0, len(text), size)))
        slow = bpe.Runs(own)
        runs = [slow.feed(text[k : k + size]) for k in range(0, len(text), size)]
        runs.append(slow.feed("", True))
    finally:
        bpe.HELD = held
    assert out == byte.unit_by_library(text) == b"".join(runs)


def test_stream_holds_little(coders):
    byte, _, own = coders
    slow, most, out = bpe.Runs(own), 0, []
    for _ in range(300):
        out.append(slow.feed("aaaabbaaathein" * 100))
        most = max(most, len(slow.text) + slow.machine.held)
    out.append(slow.feed("", True))
    assert b"".join(out) == byte.unit_by_library("aaaabbaaathein" * 30_000) and most < 2 * bpe.HELD


def test_every_run_goes_through_the_transducer(coders, monkeypatch):
    own, fed = bpe.Encoder(), []
    real = own.machine.feed
    monkeypatch.setattr(own.machine, "feed", lambda data: fed.append(data) or real(data))
    own.encode("The cat, 12 cats\tand catsanddogs" + "z" * 300)
    assert {b"The", b" cat", b",", b" 12", b" cats", b"\t", b"and"} <= set(fed) and len(fed) == len(set(fed))


def test_transducer_keeps_little(coders):
    byte, _, own = coders
    machine, out, most = bpe.Transducer(own.merges), [], 0
    for _ in range(60):
        out += machine.feed(b"aaaabbaaathein" * 20)
        most = max(most, machine.held)
    out += machine.finish()
    assert packed(out) == byte.unit_by_library("aaaabbaaathein" * 1200)
    assert most <= 3 * own.merges.lookahead


def test_decoder_of_broken_bytes(coders):
    m = coders[2].merges
    ids = packed([m.token[bytes([b])] for b in (0xE6, 0x97, 0x41, 0xFF, 0xC3)])
    assert "".join(bpe.Decoder(m).decode([ids[k : k + 4] for k in range(0, len(ids), 4)])) == coders[0].library.decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=300), st.integers(1, 64), st.booleans(), st.integers(0, 300), st.integers(0, 300))
def test_container(ids, block, bits, a, b):
    x = np.array(ids, "<u4")
    data = token_files.encode_container(x, block, bits)
    assert (token_files.decode_container(data) == x).all()
    a, b = sorted((a, b))
    assert (token_files.decode_container(data, a, b) == x[a:b]).all()


def test_reads_by_the_index():
    """A range of ids unpacks the blocks it lies in, each once in a row of ranges."""
    ids = np.random.default_rng(1).integers(0, 50_000, 1000).astype("<u4")
    held, read = token_files.Container(token_files.encode_container(ids, 64)), []
    real = held.unpack
    held.unpack = type("Counted", (), {"decompress": lambda self, part, **k: read.append(len(part)) or real.decompress(part, **k)})()
    assert (held.ids(130, 180) == ids[130:180]).all() and len(read) == 16
    assert (held.ids(150, 200) == ids[150:200]).all() and len(read) == 32 and (held.ids(999, 2000) == ids[999:]).all()
    with pytest.raises(ValueError):
        token_files.Container(b"none" + bytes(40))


ROWS = [(7, "the same text"), (7, "the same text"), (3, None), (None, "no id"), (1, ""), (9, "word " * 5000), (4, "Bonjour le monde.\nÇa va? " * 3)]


def test_token_files(spark):
    docs = spark.createDataFrame([(*r, "x") for r in ROWS], "doc_id long, text string, n_tokens string")
    rows = token_files.digests(token_files.read_tokens(token_files.write_tokens(docs, container=100))).collect()
    coder, at = WordBpe(), 0
    rows.sort(key=lambda r: r.start)
    expected = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0))
    for r, (doc_id, text) in zip(rows, expected, strict=True):
        ids = coder.unit_by_library(text or "") + packed([1])
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc_id, at, len(ids) // 4, zlib.crc32(ids))
        at += r.n_tokens


@pytest.mark.parametrize("length", [16, 2048])
def test_packing_of_odd_texts(spark, length):
    docs = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string").repartition(3)
    coder, got = ByteBpe(), {}
    for r in packing.pack(docs, length=length).collect():
        got.setdefault(r.doc_id, []).append((r.start, bytes(r.ids)))
    assert {k: b"".join(x for _, x in sorted(v)) for k, v in got.items()} == {k: coder.unit_by_library(t) + packed([1]) for k, t in enumerate(ODD)}


@pytest.mark.parametrize("length", [16, 2048])
def test_packing(spark, length):
    docs = spark.createDataFrame([(*r, "x") for r in ROWS], "doc_id long, text string, sequence_id string").repartition(3)
    pieces = packing.pack(docs, length=length)
    rows = pieces.collect()
    coder = ByteBpe()
    total = sum(len(coder.unit_by_library(t or "")) // 4 + 1 for _, t in ROWS)
    assert sum(r.length for r in rows) == total
    seen = {}
    for r in rows:
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length
        seen.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(seen) == list(range(-(-total // length)))
    for k, parts in seen.items():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at == length or k == max(seen)
    long = sorted((r.start, bytes(r.ids)) for r in rows if r.doc_id == 9)
    assert b"".join(x for _, x in long) == coder.unit_by_library("word " * 5000) + packed([1])
    joined = packing.sequences(pieces, length).collect()
    assert len(joined) == len(seen) and all(len(r.ids) == length or len(r.ids) & (len(r.ids) - 1) == 0 for r in joined)


def test_bpe_operator(spark, monkeypatch):
    texts = [*ODD, *(t for _, t in ROWS), "a" * 70_000 + " b", " " * 70_001 + "c", "word\t" * 20_000, "x\n\n" * 30_000, "'re" * 30_000]
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, ids int")
    coder = ByteBpe()
    got = {r.doc_id: r for r in bpe.encode_decode(docs).collect()}
    thin = {r.doc_id: tuple(r) for r in bpe.encode_decode(docs, keep=False).collect()}
    for k, t in enumerate(texts):
        ids, r = coder.unit_by_library(t or ""), got[k]
        decoded = coder.library.decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False)
        assert bytes(r.ids) == ids and r.decoded == decoded
        assert thin[k] == (k, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()) == tuple(r)[:4]


@pytest.mark.parametrize("run", [lambda d: token_files.read_tokens(token_files.write_tokens(d)), packing.pack, bpe.encode_decode])
def test_empty_tables(spark, run):
    assert run(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_runs_by_definition(coders):
    rng = random.Random(5)
    for _ in range(100):
        run = "".join(rng.choice("aeinrst") for _ in range(rng.randrange(1, 60))).encode()
        assert coders[2].run(run) == coders[2].merges.merge(run)


def test_joinable_by_definition(coders):
    m, rng = coders[2].merges, random.Random(9)
    ids = [k for k in m.spelling if k not in m.added.values()]
    known = [(k >> 32, k & 0xFFFFFFFF) for k in m._pairs]
    for a, b in known[:3000] + [(rng.choice(ids), rng.choice(ids)) for _ in range(3000)]:
        assert m.joinable(a, b) == (m.merge(m.spelling[a] + m.spelling[b]) == [a, b])

"""Language identification by prediction by partial matching over bytes.

For each language a context tree of the last ORDER bytes, with counts frozen after learning. A byte's probability under the longest
context is its count over counts plus kinds seen there; an unseen byte escapes, with probability kinds over counts
plus kinds, to the context one byte shorter, where bytes already seen above are excluded; at the root all 256 bytes are
equally likely. The code length of a text under a language is the sum of minus log2 of those; the language of the shortest code
wins, and its score is its share of the probability that the codes give all languages.

Frozen statistics make the cost of an escape with its exclusions a number of the context alone, so that trees are kept sparse: for each run of
bytes that any language has, the code length of its last byte under every language; for each context, the cost of leaving it, nothing under a
language that has not met it. A byte is looked up by its longest run; where no language has that, the next shorter one follows. Both
are hash tables of arrays, of as many rows as the sample has runs of ORDER + 1 bytes or fewer. Bytes are of case-folded UTF-8.

Learning takes PER_LANGUAGE rows of each language, those that come first by a hash of doc_id, whole texts, and a quarter as many more: of these rows each
EVERY-th is kept for checking. The others' runs are counted where the texts are
read, and the counts alone reach the driver, once for all languages. The model's size is checked: above MODEL_BYTES learning
fails and asks for less. Membership of a language, which the pipeline asks for, is judged by bits a byte: a text is known if its code is no longer than
SPREAD standard deviations, and ROOM bits a byte at least, above the mean of that language's rows kept for checking, with SLACK bits for short texts.

Rows with a null lang, text or doc_id teach nothing. A text that is null or has no letter is `und` with score 0, as are
all where nothing could be learned. Rows of null doc_id are predicted like others; repeated rows alike; of repeated doc_ids in the sample, each
row counts. Very long texts are scored whole, in pieces. Ties go to the language first in order. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnline.llm.common import first_by_hash, held_out, released, slices, written

ORDER = 4
PER_LANGUAGE = 400
EVERY = 5
SPREAD = 8.0
ROOM = 1.5
SLACK = 64.0
MODEL_BYTES = 256 << 20
PIECE = 1 << 18
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


class Table:
    """Rows by 64-bit key: open addressing in arrays, so that many keys are looked up at once."""

    def __init__(self, keys: np.ndarray):
        self.shift = np.uint64(64 - max(4, int(2 * len(keys) + 1).bit_length()))
        size = 1 << (64 - int(self.shift))
        self.mask = size - 1
        self.key, self.row = np.full(size, _EMPTY), np.full(size, -1, np.int32)
        todo, slot = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            free = np.flatnonzero(self.row[slot] < 0)
            self.row[slot[free]] = todo[free]  # of several for one slot the last stays
            self.key[slot[free]] = keys[todo[free]]
            left = self.row[slot] != todo
            todo, slot = todo[left], (slot[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, or -1."""
        slot = self._slot(keys)
        held = self.key[slot]
        out = np.where(held == keys, self.row[slot], -1)
        at = np.flatnonzero((held != keys) & (held != _EMPTY))
        slot = slot[at]
        while len(at):
            slot = (slot + 1) & self.mask
            held = self.key[slot]
            hit = held == keys[at]
            out[at[hit]] = self.row[slot[hit]]
            left = ~hit & (held != _EMPTY)
            at, slot = at[left], slot[left]
        return out


@dataclass
class Model:
    languages: list[str]
    order: int
    #: Of 0 to order bytes of context: runs one byte longer, with code lengths by language; contexts, with the cost to leave them.
    runs: list[Table] = field(default_factory=list)
    bits: list[np.ndarray] = field(default_factory=list)
    contexts: list[Table] = field(default_factory=list)
    leave: list[np.ndarray] = field(default_factory=list)
    #: Of each language, the most bits a byte that its texts need.
    most: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def code(self, keys: np.ndarray) -> np.ndarray:
        """Bits by language of the last byte of each run of order + 1 bytes, given as a number, oldest byte first."""
        out = np.zeros((len(keys), len(self.languages)), np.float32)
        todo = np.arange(len(keys))
        for k in range(self.order, -1, -1):
            key = keys[todo] if k == self.order else keys[todo] & np.uint64((1 << (8 * k + 8)) - 1)
            row = self.runs[k].find(key)
            hit = row >= 0
            if k == self.order:
                out[hit] = self.bits[k][row[hit]]
            else:
                out[todo[hit]] += self.bits[k][row[hit]]
            todo, key = todo[~hit], key[~hit]
            if not len(todo):
                return out
            row = self.contexts[k].find(key >> np.uint64(8))
            seen = row >= 0
            out[todo[seen]] += self.leave[k][row[seen]]
        out[todo] += 8
        return out


def trees(counts: list[tuple[np.ndarray, np.ndarray]], order: int) -> Model:
    """A model without names or limits, of each language's runs of order + 1 bytes and their counts; runs are numbers, oldest byte first."""
    model = Model([""] * len(counts), order)
    below: np.ndarray | None = None
    for k in range(order + 1):
        cut = np.uint64((1 << (8 * k + 8)) - 1)
        own = []
        for run, count in counts:
            kind, at = np.unique(run & cut, return_inverse=True)
            own.append((kind, np.bincount(at, count, len(kind))))
        kinds = np.unique(np.concatenate([np.zeros(0, np.uint64), *(r for r, _ in own)]))
        places = np.unique(kinds >> np.uint64(8))
        bits, leave = np.zeros((len(kinds), len(own))), np.zeros((len(places), len(own)))
        of = np.searchsorted(places, kinds >> np.uint64(8))
        # What a byte costs one context shorter, for each language.
        shorter = np.full((len(kinds), len(own)), 8.0) if below is None else below[model.runs[k - 1].find(kinds & np.uint64((1 << (8 * k)) - 1))]
        for j, (run, count) in enumerate(own):
            at = np.searchsorted(kinds, run)
            total = np.bincount(of[at], count, len(places))
            seen = np.bincount(of[at], minlength=len(places))
            excluded = np.bincount(of[at], np.exp2(-shorter[at, j]), len(places))
            met = seen > 0
            escape = np.where(seen < 256, seen, 0) / np.maximum(total + seen, 1)
            with np.errstate(divide="ignore"):
                leave[met, j] = -np.log2(escape[met] / np.maximum(1 - excluded[met], 2.0**-60))
            bits[:, j] = leave[of, j] + shorter[:, j]
            bits[at, j] = -np.log2(count / (total + np.where(seen < 256, seen, 0))[of[at]])
        model.runs.append(Table(kinds))
        model.contexts.append(Table(places))
        model.bits.append(bits.astype(np.float32))
        model.leave.append(leave.astype(np.float32))
        below = bits
    return model


def _numbers(text: bytes, order: int) -> np.ndarray:
    """All runs of order + 1 bytes as numbers, oldest byte first."""
    data = np.frombuffer(text, np.uint8).astype(np.uint64)
    out = np.zeros(max(0, len(data) - order), np.uint64)
    for k in range(order + 1):
        out = (out << np.uint64(8)) | data[k : k + len(out)]
    return out


def _folded(text: str, order: int) -> bytes:
    return b" " * order + text.lower().encode()


def _counted(order: int):
    """lang, run, n of texts with their lang: counted in each batch."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            texts = batch.column("text").to_pylist()
            for name in dict.fromkeys(langs):
                run, n = np.unique(np.concatenate([_numbers(_folded(t, order), order) for t, own in zip(texts, langs, strict=True) if own == name]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(run), pa.string()), pa.array(run.view(np.int64)), pa.array(n)], ["lang", "run", "n"])

    return counted


def learn(docs: DataFrame, per_language: int = PER_LANGUAGE, order: int = ORDER, every: int = EVERY) -> Model:
    """A model of the languages in docs(doc_id, text, lang), from rows that are not held out. order: 7 at most. every: 0 keeps no row for checking."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"))
    some = docs.where("doc_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL").where(~held_out())
    picked = written(first_by_hash(some, "lang", per_language + (per_language // (every - 1) if every else 0)))
    checks = F.col("rank") % every == 0 if every else F.lit(False)
    chosen = picked.where(~checks).select("lang", "text")
    table = chosen.mapInArrow(_counted(order), "lang string, run long, n long").groupBy("lang", "run").agg(F.sum("n").alias("n")).toArrow()
    names = table["lang"].to_numpy()
    languages = sorted(set(names.tolist()))
    run, n = table["run"].to_numpy().view(np.uint64), table["n"].to_numpy()
    size = len(run) * 2 * (4 * len(languages) + 24)
    if size > MODEL_BYTES:
        raise ValueError(f"the trees of {len(languages)} languages would take some {size >> 20} MB; lower per_language or order")
    model = trees([(run[names == name], n[names == name]) for name in languages], order)
    model.languages = languages
    model.most = np.full(len(languages), np.inf)
    if languages:
        shared = docs.sparkSession.sparkContext.broadcast(model)

        def spent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                _, _, bits, size = score(batch.column("text").to_pylist(), shared.value)
                of = np.array([shared.value.languages.index(x) if x in shared.value.languages else -1 for x in batch.column("lang").to_pylist()], np.int64)
                good = np.flatnonzero((size > 0) & (of >= 0))
                yield pa.RecordBatch.from_arrays([batch.column("lang").take(pa.array(good)), pa.array(bits[good, of[good]] / size[good])], ["lang", "rate"])

        rest = picked.where(checks).select("lang", "text")
        rates = rest.mapInArrow(spent, "lang string, rate double").groupBy("lang").agg(F.avg("rate").alias("mean"), F.stddev_pop("rate").alias("sd")).collect()
        for r in rates:  # a language of a few rows has none to check by, and no limit
            model.most[languages.index(r.lang)] = r.mean + max(SPREAD * r.sd, ROOM)
    released()
    return model


def score(texts: list[str | None], model: Model) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Of each text the language, the score, bits by language, and bytes coded: 0 for those that are `und`."""
    names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
    bits, size = np.zeros((len(texts), len(model.languages))), np.zeros(len(texts), np.int64)
    at = [k for k, t in enumerate(texts) if t and model.languages and _LETTER.search(t) is not None]
    data = [_folded(texts[k], model.order) for k in at]
    size[at] = [len(x) - model.order for x in data]
    if not at:
        return names, scores, bits, size
    # All texts one after another, in pieces of a bounded length; runs across two texts count for nothing.
    whole, start = b"".join(data), np.cumsum([0, *map(len, data)])
    for a in range(0, len(whole) - model.order, PIECE):
        part = model.code(_numbers(whole[a : a + PIECE + model.order], model.order))
        first = int(np.searchsorted(start, a, "right")) - 1
        last = int(np.searchsorted(start, a + len(part), "left"))
        for b in start[max(first, 1) : last + 1].tolist():
            part[max(0, b - model.order - a) : max(0, b - a)] = 0
        edge = np.maximum(start[first:last] - a, 0)
        bits[at[first:last]] += np.add.reduceat(part.astype(np.float64), edge, axis=0)
    gap = bits[at] - bits[at].min(axis=1, keepdims=True)
    best, share = gap.argmin(axis=1), 1 / np.exp2(-gap).sum(axis=1)
    for k, b, p in zip(at, best.tolist(), share.tolist(), strict=True):
        names[k], scores[k] = model.languages[b], p
    return names, scores, bits, size


def identify(docs: DataFrame, model: Model, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, lang_pred, score and the columns of docs named in keep, a row for each of docs(doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most MODEL_BYTES

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in slices(batch, "text_", 1 << 19):
                names, scores, _, _ = score(run.column("text_").to_pylist(), shared.value)
                rest = run.drop_columns(["text_"])
                yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(names, pa.string()), pa.array(scores)], [*rest.schema.names, "lang_pred", "score"])

    plain = docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), *keep, F.col("text").cast("string").alias("text_"))
    schema = plain.drop("text_").schema.add("lang_pred", "string").add("score", "double")
    return plain.mapInArrow(add, schema)


def known(docs: DataFrame, model: Model) -> DataFrame:
    """docs, all columns, of texts whose code under their language is no longer than that language's texts have."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for run in slices(batch, "text", 1 << 19):
                _, _, bits, size = score(run.column("text").to_pylist(), model)
                good = size > 0
                if model.languages:
                    best = bits.argmin(axis=1)
                    good &= bits[np.arange(len(best)), best] <= model.most[best] * size + SLACK
                yield run.filter(pa.array(good))

    return docs.mapInArrow(keep, docs.schema)

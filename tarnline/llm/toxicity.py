"""Toxicity: a logistic classifier over words and their beginnings, regularised by counterfactuals.

Features of a text are its distinct words (runs of letters, case-folded) and their beginnings of FROM to TO letters; of those that the
sample has in at least MIN_TEXTS texts, the FEATURES with the largest chi-square between presence and label. Identity terms are
always among them.

Counterfactuals: each labelled sample text with an identity term is written again with each other term of the same
set in its place, and the squared change of its log-odds, all features of the new text less those of the old one, is added to the loss, PENALTY
times. So weights of neutral mentions of groups are drawn together, and none of them makes a text toxic by itself.

Learning takes at most SAMPLE labelled rows of each label, those first by a hash of doc_id, whole texts, weighted by how many rows each
stands for; this is its only bound. Rows are chosen where they are read, by a limit on the hash, and the sample's texts reach the driver as sets of
words. Held-out rows and rows with a null label, text or doc_id teach nothing; of rows that repeat a doc_id the least text does. A null or empty text has
the score of no features.
Where no row or only one label can be learned from, scores are 0 or the rows' rate. Rows of null doc_id are scored; repeated
labels of a doc_id count as toxic if one is. Texts of any length are scored whole, equal texts alike. Columns other than doc_id and text
are not read for scoring.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnline.llm.common import first_by_hash, held_out, released, slices, written

SAMPLE = 3000
BINS = 1 << 21
FROM, TO = 4, 8
MIN_TEXTS = 5
FEATURES = 4000
RIDGE = 0.02
PENALTY = 10.0
STEPS = 250
THRESHOLD = 0.3
CACHE = 100_000
#: Sets of identity terms that may stand for each other.
IDENTITY = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("female", "male"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"), ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino"), ("gay", "straight", "lesbian", "bisexual"), ("immigrants", "natives", "refugees"),
    ("frauen", "männer"), ("frau", "mann"), ("mädchen", "jungen"), ("muslime", "christen", "juden", "hindus", "buddhisten", "atheisten"),
    ("schwarze", "weiße", "asiaten"), ("schwule", "lesben", "heterosexuelle"), ("einwanderer", "einheimische", "flüchtlinge"),
    ("femmes", "hommes"), ("femme", "homme"), ("filles", "garçons"), ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées"),
    ("noirs", "blancs", "asiatiques"), ("gays", "lesbiennes", "hétérosexuels"), ("immigrés", "autochtones", "réfugiés"),
    ("mujeres", "hombres"), ("mujer", "hombre"), ("niñas", "niños"), ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos"),
    ("negros", "blancos", "asiáticos"), ("gais", "lesbianas", "heterosexuales"), ("inmigrantes", "nativos", "refugiados"),
)
_WORD = re.compile(r"[^\W\d_]+")


def features(word: str) -> list[str]:
    """Of one white-space separated piece of case-folded text: words, and beginnings marked by a trailing hyphen."""
    out = []
    for w in _WORD.findall(word):
        out.append(w)
        out += [w[:k] + "-" for k in range(FROM, min(TO, len(w)) + 1)]
    return out


@dataclass
class Model:
    weights: dict[str, float]
    bias: float


class _Hits(dict):
    """Features of a piece of text that are known; at most CACHE pieces are kept."""

    def __init__(self, known):
        super().__init__()
        self.known = known

    def __missing__(self, word: str) -> tuple[str, ...]:
        found = tuple(f for f in features(word) if f in self.known)
        if len(self) < CACHE:
            self[word] = found
        return found


def logits(texts: list[str | None], model: Model, hits: _Hits) -> np.ndarray:
    out = np.full(len(texts), model.bias)
    for k, text in enumerate(texts):
        found: set[str] = set()
        for f in map(hits.__getitem__, set((text or "").lower().split())):
            if f:
                found.update(f)
        if found:
            out[k] += sum(model.weights[f] for f in sorted(found))
    return out


def _bin(feature: str) -> int:
    return zlib.crc32(feature.encode()) & (BINS - 1)


class Features:
    """The numbers of each piece's features, those of piece k from first[k] to first[k + 1]; a feature may come twice."""

    def __init__(self, pieces: list[str], number, only: np.ndarray | None = None):
        """number: of a feature, or None for one that is left out. only: False for pieces to leave without features."""
        flat = array("q")
        size = np.zeros(len(pieces), np.int64)
        for k in range(len(pieces)) if only is None else np.flatnonzero(only).tolist():
            found = [f for f in map(number, features(pieces[k])) if f is not None]
            flat.extend(found)
            size[k] = len(found)
        self.flat, self.first = np.frombuffer(flat, np.int64) if flat else np.zeros(0, np.int64), np.append(0, np.cumsum(size))

    def __getitem__(self, piece: int) -> np.ndarray:
        return self.flat[self.first[piece] : self.first[piece + 1]]

    def some(self, marked: np.ndarray) -> np.ndarray:
        """Which pieces have a marked feature."""
        sums = np.append(0, np.cumsum(marked[self.flat]))
        return sums[self.first[1:]] > sums[self.first[:-1]]


@dataclass
class Sample:
    """Texts as sets of pieces: the distinct pieces, and the numbers of those in each text, from first[k] to first[k + 1]."""

    pieces: list[str]
    code: np.ndarray
    first: np.ndarray

    @classmethod
    def of(cls, column: pa.Array) -> Sample:
        """From an array of lists of pieces, without repeats in a list."""
        coded = column.flatten().dictionary_encode()
        return cls(coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64), column.offsets.to_numpy().astype(np.int64) - column.offsets[0].as_py())

    def __len__(self) -> int:
        return len(self.first) - 1

    def runs(self, of_piece: Features, step: int = 500) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(text, feature) of all texts, each pair once, given the features of each piece; some texts at a time."""
        flat, size, start = of_piece.flat, np.diff(of_piece.first), of_piece.first[:-1]
        for a in range(0, len(self), step):
            b = min(a + step, len(self))
            code = self.code[self.first[a] : self.first[b]]
            n = size[code]
            text = np.repeat(np.repeat(np.arange(a, b), np.diff(self.first[a : b + 1])), n)
            at = np.repeat(start[code] - np.cumsum(n) + n, n) + np.arange(n.sum())
            pairs = np.sort(text << 32 | flat[at])
            pairs = pairs[np.append(True, pairs[1:] != pairs[:-1])[: len(pairs)]]
            yield pairs >> 32, pairs & 0xFFFFFFFF

    def rows(self, of_piece: Features) -> tuple[np.ndarray, np.ndarray]:
        """All of runs() at once."""
        none = np.zeros(0, np.int64)
        found = [(none, none), *self.runs(of_piece)]
        return np.concatenate([t for t, _ in found]), np.concatenate([f for _, f in found])

    def counts(self, of_piece: Features, n: int, positive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each of n features, in how many texts it is, and in how many positive ones; no list of all pairs is held."""
        every, some = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for text, feature in self.runs(of_piece):
            every += np.bincount(feature, minlength=n)
            some += np.bincount(feature[positive[text]], minlength=n)
        return every, some


def _best(count: np.ndarray, positive: np.ndarray, n: int, p: int) -> np.ndarray:
    """The FEATURES places of largest chi-square between presence and label among those in MIN_TEXTS texts at least."""
    at = np.flatnonzero(count >= MIN_TEXTS)
    c, both = count[at].astype(float), positive[at].astype(float)
    chi = n * (both * (n - p) - (c - both) * p) ** 2 / np.maximum(c * (n - c) * p * (n - p), 1)
    return at[np.argsort(-chi, kind="stable")[:FEATURES]]


def _swapped(sample: Sample, of_piece: Features, index: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text and each identity term in it that another takes the place of: pair, feature, and 1 where it comes or -1 where it goes."""
    others = {t: [u for group in IDENTITY if t in group for u in group if u != t] for group in IDENTITY for t in group}
    held: dict[int, list[str]] = {}
    for k, piece in enumerate(sample.pieces):
        if found := [w for w in dict.fromkeys(_WORD.findall(piece)) if w in others]:
            held[k] = found
    known = np.array(sorted(held), np.int64)
    out: tuple[list, list, list] = ([], [], [])
    pair = 0
    for text in range(len(sample)):
        code = sample.code[sample.first[text] : sample.first[text + 1]]
        there = code[np.isin(code, known)].tolist()
        for a in dict.fromkeys(t for c in there for t in held[c]):
            with_a = [c for c in there if a in held[c]]
            rest = set(np.concatenate([np.zeros(0, np.int64), *(of_piece[c] for c in code[~np.isin(code, with_a)].tolist())]).tolist())
            before = rest.union(*(of_piece[c].tolist() for c in with_a))
            for b in others[a]:
                new = [_WORD.sub(lambda m: b if m[0] == a else m[0], sample.pieces[c]) for c in with_a]  # noqa: B023
                after = rest | {index[f] for piece in new for f in features(piece) if f in index}
                for f, sign in [(f, 1) for f in after - before] + [(f, -1) for f in before - after]:
                    for c, v in zip(out, (pair, f, sign), strict=True):
                        c.append(v)
                pair += 1
    return np.array(out[0], np.int64), np.array(out[1], np.int64), np.array(out[2], float)


def fit(sample: Sample, toxic: np.ndarray, weight: np.ndarray) -> Model:
    """A model of texts with labels 0 or 1 and weights."""
    n = len(sample)
    if not n or toxic.min() == toxic.max():
        rate = float(toxic[0]) if n else 0.0
        return Model({}, 40.0 if rate else -40.0)
    # First by bins of features, so that what is held does not grow with the kinds of words; then by features of the best bins.
    terms = {f for group in IDENTITY for t in group for f in features(t)}
    y = toxic.astype(bool)
    p = int(y.sum())
    bins = Features(sample.pieces, _bin)
    best = np.zeros(BINS, bool)
    best[_best(*sample.counts(bins, BINS, y), n, p)] = True
    best[[_bin(f) for f in terms]] = True
    index: dict[str, int] = {}
    some = bins.some(best)
    del bins
    of_piece = Features(sample.pieces, lambda f: index.setdefault(f, len(index)) if best[_bin(f)] else None, some)
    names = list(index)
    by_name = np.array(sorted(range(len(names)), key=names.__getitem__), np.int64)
    count, positive = sample.counts(of_piece, len(names), y)
    chosen = list(dict.fromkeys([names[k] for k in by_name[_best(count[by_name], positive[by_name], n, p)].tolist()] + sorted(terms)))
    index = {f: k for k, f in enumerate(chosen)}
    of_piece = Features(sample.pieces, index.get, some)
    row, column = sample.rows(of_piece)
    pair_row, pair_column, sign = _swapped(sample, of_piece, index)
    weight = weight / weight.sum()
    w, bias = np.zeros(len(chosen)), float(np.log((weight * toxic).sum() / (weight * (1 - toxic)).sum()))
    moment, square = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, STEPS + 1):
        z = bias + np.bincount(row, w[column], n)
        gap = weight * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - toxic)
        slope = np.bincount(column, gap[row], len(w)) + RIDGE / n * w
        if len(sign):
            change = np.bincount(pair_row, sign * w[pair_column])
            slope += 2 * PENALTY / len(change) * np.bincount(pair_column, sign * change[pair_row], len(w))
        g = np.append(slope, gap.sum())
        moment = 0.9 * moment + 0.1 * g
        square = 0.99 * square + 0.01 * g * g
        move = 0.1 * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
        w, bias = w - move[:-1], bias - float(move[-1])
    return Model({f: float(w[k]) for f, k in index.items() if w[k]}, bias)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        held = [sorted(set(x.lower().split())) for x in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(held, pa.list_(pa.string()))], ["doc_id", "toxic", "pieces"])


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from docs(doc_id, text) and labels(doc_id, toxic) that are not held out."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id IS NOT NULL AND text IS NOT NULL").where(~held_out())
    marked = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out())
    marked = marked.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).join(docs.select("doc_id"), "doc_id", "left_semi")
    marked = written(marked)  # two numbers a label
    totals = {r.toxic: r["count"] for r in marked.groupBy("toxic").count().collect()}
    # Texts of the chosen alone are read: at most twice SAMPLE ids are broadcast.
    chosen = docs.join(F.broadcast(first_by_hash(marked, "toxic", sample).select("doc_id", "toxic")), "doc_id")
    chosen = chosen.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    rows = chosen.mapInArrow(_pieces, "doc_id long, toxic int, pieces array<string>").toArrow().sort_by("doc_id").combine_chunks()
    toxic = rows["toxic"].to_numpy().astype(float)
    n = Counter(toxic.tolist())
    held = rows["pieces"].combine_chunks()
    held = pa.concat_arrays(held.chunks) if isinstance(held, pa.ChunkedArray) else held
    model = fit(Sample.of(held), toxic, np.array([totals[int(y)] / n[y] for y in toxic.tolist()]))
    released()
    return model


def scored(docs: DataFrame, model: Model, keep: tuple[str, ...] = (), threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted and the columns of docs named in keep, a row for each of docs(doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES weights and those of identity terms

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        hits = _Hits(model.weights)
        for batch in batches:
            for run in slices(batch, "text_"):
                z = logits(run.column("text_").to_pylist(), model, hits)
                p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
                rest = run.drop_columns(["text_"])
                yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(p), pa.array((p >= threshold).astype(np.int32))], [*rest.schema.names, "score", "predicted"])

    plain = docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), *keep, F.col("text").cast("string").alias("text_"))
    schema = plain.drop("text_").schema.add("score", "double").add("predicted", "integer")
    return plain.mapInArrow(add, schema)


def clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """docs, all columns, without those that score threshold or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits = _Hits(shared.value.weights)
        for batch in batches:
            for run in slices(batch, "text"):
                z = logits(run.column("text").to_pylist(), shared.value, hits)
                yield run.filter(pa.array(1 / (1 + np.exp(-np.clip(z, -40, 40))) < threshold))

    return docs.mapInArrow(keep, docs.schema)

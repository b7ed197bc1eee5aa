"""Substring dedup: words covered by a run of WINDOW words that also starts in a document of smaller id are removed.

De Bruijn compaction. The graph's edges are runs of 50 words, its nodes the 49 words that two edges in a row share. One row an edge would
be one row a word, so edges are dealt in super-runs: a document's edges whose smallest 16-word hash (their anchor) is the same follow each other without a
branch inside the document and form one path, with the document and word where it begins as source coordinates, its first and
last node, and a digest of its words (BLAKE2b, 128 bits) taken at those coordinates.
Every edge lies in exactly one path of its document, and equal edges have equal anchors, so that two documents share an
edge only if they have paths with the same anchor.

1. Anchors are counted with map-side aggregation, and paths whose anchor is in one document alone are left out. Of the others, paths
   with equal digests are counted: the smallest document that has each, and the largest.
2. Of anchors that have several different paths in several documents, each path is opened again by its coordinates in the
   smallest document that has it, wherever it stands there, and its edges are compared one by one: where a copied passage begins or
   ends, paths agree in part. Other documents with the same path are covered by 1.
3. What is repeated, whole paths and single edges, is compacted: a node is without a branch if one repeated piece enters it and one leaves it, which
   joins of the pieces by their nodes tell; a piece that leaves such a node where its forerunner ends in the same source continues it. So each piece
   belongs to a compacted path, given by its source (the smallest document) and the word where the path begins there.
4. Each document's pieces of the same compacted path and the same distance from the source make one span, as long as they follow each other. A piece
   counts only where the digest of its own words, at its own coordinates, is that of the words at the source's, and the source is a smaller document.
5. Spans are gathered by document, joined with the texts, and the words they cover leave.

The shuffled rows are one a path, about 0.06 a word, and those of 2; texts are dealt by doc_id once for 2 and 5. Joins on digests have a written table
on either side, so that those of a passage most documents share are split.

Nulls: a null text has no words; a row with a null doc_id keeps all its words and removes none of others. If doc_ids repeat, rows
of one doc_id are not held against each other. Texts under 50 words stay as they are. An empty table gives none.
Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnline.llm.common import Words, sequence_hash, sequence_sums, signed, slices, spare, windows, written

WINDOW = 50
ANCHOR = 16
_PATHS = "doc_id long, pos int, edges int, anchor long, head long, tail long, h1 long, h2 long"
_EDGES = "doc_id long, pos int, head long, tail long, h1 long, h2 long"


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of width elements, by doubling."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x = np.minimum(x[: len(x) - step], x[step:])
        done += step
    return x


def _edges(words: Words, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all whole edges among the words, and the anchors of those."""
    n = len(words.hashes) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    least = _least(windows(words.hashes, anchor), window - anchor + 1)
    at = np.arange(n)
    at = at[words.first[words.row[:n] + 1] - at >= window]
    return at, least[at]


def _digests(texts: list[str | None], row: np.ndarray, start: np.ndarray, stop: np.ndarray) -> list[pa.Array]:
    """Two halves of a digest of the words from start to stop of each row, in order of row; words joined by one space."""
    out, last, words = [], -1, []
    for r, a, b in zip(row.tolist(), start.tolist(), stop.tolist(), strict=True):
        if r != last:
            last, words = r, texts[r].encode().split()
        out.append(hashlib.blake2b(b" ".join(words[a:b]), digest_size=16).digest())
    both = np.frombuffer(b"".join(out), "<i8").reshape(-1, 2)
    return [pa.array(np.ascontiguousarray(both[:, k])) for k in (0, 1)]


def _nodes(words: Words, start: np.ndarray, stop: np.ndarray, window: int) -> list[pa.Array]:
    """Hashes of the first and the last node of runs of words."""
    sums = sequence_sums(words.hashes)
    return [pa.array(signed(sequence_hash(sums, a, a + window - 1))) for a in (start, stop - window + 1)]


def _paths(window: int, anchor: int):
    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in slices(batch, "text", 1 << 20):
                words = Words(run.column("text"))
                at, anchors = _edges(words, window, anchor)
                if not len(at):
                    continue
                new = np.ones(len(at), bool)
                new[1:] = (anchors[1:] != anchors[:-1]) | (words.row[at[1:]] != words.row[at[:-1]])
                first = np.flatnonzero(new)
                count = np.diff(np.append(first, len(at)))
                start, stop = at[first], at[first] + count + window - 1
                row = words.row[start]
                pos = start - words.first[row]
                yield pa.RecordBatch.from_arrays(
                    [run.column("doc_id").take(pa.array(row)), pa.array(pos.astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(signed(anchors[first])),
                     *_nodes(words, start, stop, window), *_digests(run.column("text").to_pylist(), row, pos, pos + stop - start)],
                    ["doc_id", "pos", "edges", "anchor", "head", "tail", "h1", "h2"],
                )

    return paths


def _opened(window: int):
    """Single edges of the sources' paths."""

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in slices(batch, "text", 1 << 20):
                words = Words(run.column("text"))
                flat = run.column("sources").flatten()
                size = np.diff(run.column("sources").offsets.to_numpy())
                row = np.repeat(np.arange(run.num_rows), size)
                pos, count = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
                start = np.repeat(words.first[row] + pos, count)
                start += np.arange(len(start)) - np.repeat(np.cumsum(count) - count, count)
                row = np.repeat(row, count)
                pos = start - words.first[row]
                yield pa.RecordBatch.from_arrays(
                    [run.column("doc_id").take(pa.array(row)), pa.array(pos.astype(np.int32)), *_nodes(words, start, start + window, window), *_digests(run.column("text").to_pylist(), row, pos, pos + window)],
                    ["doc_id", "pos", "head", "tail", "h1", "h2"],
                )

    return opened


def covered(n: int, spans: list[dict], window: int) -> np.ndarray:
    """Which of n words lie in the edges of the spans (pos, edges)."""
    step = np.zeros(n + 1, np.int64)
    for s in spans:
        step[s["pos"]] += 1
        step[s["pos"] + s["edges"] + window - 1] -= 1
    return np.cumsum(step[:-1]) > 0


def _kept(window: int, texts: bool):
    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in slices(batch, "text"):
                n, removed, digest, left = [], [], [], []
                for text, spans in zip(run.column("text").to_pylist(), run.column("spans").to_pylist(), strict=True):
                    words = (text or "").encode().split()
                    n.append(len(words))
                    if spans:
                        gone = covered(len(words), spans, window)
                        words = [words[k] for k in np.flatnonzero(~gone).tolist()]
                    removed.append(n[-1] - len(words))
                    whole = b" ".join(words)
                    digest.append(hashlib.sha256(whole).hexdigest())
                    left.append((whole.decode() if removed[-1] else text) if texts else None)
                cells = [run.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string())]
                names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
                if texts:
                    cells.append(pa.array(left, pa.string()))
                    names.append("kept_text")
                yield pa.RecordBatch.from_arrays(cells, names)

    return kept


def compacted(pieces: DataFrame) -> DataFrame:
    """h1, h2, source, at, start of pieces(h1, h2, head, tail, edges, source, at), each once: the compacted path of each begins at word `start` of its source.

    A node's pieces are counted by aggregation; a branching one, however many pieces it has, is one row and joins with nothing.
    """
    enters = pieces.groupBy(F.col("tail").alias("node")).agg(F.count("*").alias("n")).where("n = 1").select("node")
    leaves = pieces.groupBy(F.col("head").alias("node")).agg(F.count("*").alias("n"), *(F.min(c).alias(f"next_{c}") for c in ("h1", "h2", "source", "at"))).where("n = 1").drop("n")
    plain = leaves.join(enters, "node")
    follows = pieces.select(F.col("tail").alias("node"), "source", (F.col("at") + F.col("edges")).alias("end")).join(plain, "node")
    follows = follows.where("source = next_source AND end = next_at").select(F.col("next_h1").alias("h1"), F.col("next_h2").alias("h2"), F.lit(True).alias("follows"))
    marked = pieces.join(follows, ["h1", "h2"], "left")
    # Along each source, which has as many pieces as words at most, the last piece that continues none.
    along = Window.partitionBy("source").orderBy("at", "edges", "h1", "h2").rowsBetween(Window.unboundedPreceding, 0)
    start = F.coalesce(F.last(F.when(F.col("follows").isNull(), F.col("at")), ignorenulls=True).over(along), F.col("at"))
    return marked.select("h1", "h2", "source", "at", start.alias("start"))


def repeated_spans(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, spans (array of pos, edges): runs of edges, by first word and count, that a smaller document has too.

    docs(doc_id long, text string), without null ids.
    """
    paths = docs.mapInArrow(_paths(window, anchor), _PATHS)
    # Only anchors of several documents can have repeated edges; all that follows has their paths alone.
    shared = paths.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("anchor")
    paths = written(paths.join(shared, "anchor", "left_semi"))
    ends = [F.min(c).alias(c) for c in ("anchor", "edges", "head", "tail")]
    known = written(paths.groupBy("h1", "h2").agg(*ends, F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.min_by("pos", "doc_id").alias("at")))
    # Anchors with several paths: all places of each in its first document, their edges compared one by one.
    forked = known.groupBy("anchor").agg(F.count("*").alias("n"), F.min("first").alias("lo"), F.max("last").alias("hi")).where("n > 1 AND lo < hi").select("anchor")
    forked = written(forked)
    opened = known.join(forked, "anchor", "left_semi").select("h1", "h2", F.col("first").alias("doc_id"))
    sources = paths.join(opened, ["h1", "h2", "doc_id"], "left_semi").groupBy("doc_id").agg(F.collect_set(F.struct("pos", "edges")).alias("sources"))
    edges = written(docs.join(sources.hint("shuffle_hash"), "doc_id").select("doc_id", "text", "sources").mapInArrow(_opened(window), _EDGES))
    owners = edges.groupBy("h1", "h2").agg(F.min("head").alias("head"), F.min("tail").alias("tail"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.min_by("pos", "doc_id").alias("at"))
    pieces = ["h1", "h2", "head", "tail", "edges", F.col("first").alias("source"), "at"]
    repeated = known.where("first < last").select(*pieces).unionByName(owners.where("first < last").withColumn("edges", F.lit(1)).select(*pieces))
    # A path of one edge may be both.
    repeated = written(repeated.groupBy("h1", "h2").agg(*(F.min(c).alias(c) for c in ("head", "tail", "edges", "source")), F.min_by("at", "source").alias("at")))
    label = written(compacted(repeated))
    copies = paths.select("h1", "h2", "doc_id", "pos", "edges").unionByName(edges.select("h1", "h2", "doc_id", "pos", F.lit(1).alias("edges")))
    copies = copies.join(label, ["h1", "h2"]).where("doc_id > source")
    copies = copies.select("doc_id", "source", "start", (F.col("pos") - F.col("at")).alias("gap"), "pos", "edges").repartition("doc_id")
    piece = F.struct("pos", "edges")
    spans = copies.groupBy("doc_id", "source", "start", "gap").agg(F.collect_set(piece).alias("pieces"))
    low, high = F.array_min(F.transform("pieces", lambda p: p["pos"])), F.array_max(F.transform("pieces", lambda p: p["pos"] + p["edges"]))
    whole = F.aggregate("pieces", F.lit(0), lambda n, p: n + p["edges"]) == high - low
    # Pieces that overlap or leave a gap stay apart.
    spans = spans.select("doc_id", F.when(whole, F.array(F.struct(low.alias("pos"), (high - low).alias("edges")))).otherwise(F.col("pieces")).alias("spans"))
    return spans.groupBy("doc_id").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def dedup(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, texts: bool = True) -> DataFrame:
    """A row for each of docs(doc_id, text): doc_id, n_words, n_removed, kept_sha256 and, with texts, kept_text.

    kept_text is the text itself if no word goes, else the words kept, joined by one space.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * texts
    known = docs.where("doc_id IS NOT NULL")
    spans = repeated_spans(known, window, anchor)
    joined = known.join(spans.hint("shuffle_hash"), "doc_id", "left").select("doc_id", "text", "spans")
    rest = docs.where("doc_id IS NULL").withColumn("spans", F.lit(None).cast("array<struct<pos:int,edges:int>>"))
    return joined.unionByName(rest).mapInArrow(_kept(window, texts), schema)


def _cut(window: int, name: str):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in slices(batch, "text"):
                texts = run.column("text").to_pylist()
                for k, spans in enumerate(run.column(name).to_pylist()):
                    if spans:
                        words = texts[k].encode().split()
                        gone = covered(len(words), spans, window)
                        texts[k] = b" ".join([words[j] for j in np.flatnonzero(~gone).tolist()]).decode()
                rest = run.drop_columns([name])
                yield rest.set_column(rest.schema.get_field_index("text"), "text", pa.array(texts, pa.string()))

    return cut


def without_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """docs, all columns, with texts cut as by dedup(); n_chars, if there is one, is that of the new text."""
    docs = docs.withColumn("text", F.col("text").cast("string"))
    spans = repeated_spans(docs.select(F.col("doc_id").cast("long"), "text").where("doc_id IS NOT NULL"), window, anchor)
    key, held = spare(docs, "key"), spare(docs, "spans")
    spans = spans.select(F.col("doc_id").alias(key), F.col("spans").alias(held))
    joined = docs.join(spans.hint("shuffle_hash"), F.col("doc_id").cast("long") == F.col(key), "left").drop(key)
    out = joined.mapInArrow(_cut(window, held), docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out

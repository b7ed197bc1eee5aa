"""Near-duplicate documents by weighted MinHash: multisets of 5-word shingles, Jaccard 0.8 or more, classes of linked documents.

BagMinHash. A shingle of multiplicity w covers the weights (0, w]. Discretised weights form a hierarchy of dyadic blocks (0,1], (1,2], (2,4],
(4,8] ...; each block of each shingle has a Poisson process of points in time, its rate the block's size times the number of slots. A
point has a slot and a level in its block, drawn by hashing (the level's bits are its way down the halves of the block), and counts if its level lies
below w; blocks above w are never drawn. So a document needs log w processes a
shingle, points of smaller weights are points of larger ones too, and each slot's earliest point agrees between two
documents with probability equal to the weighted Jaccard similarity. Points are drawn up to a horizon by which slots are most
likely all filled, and the horizon is doubled for those documents where one is not.

1. Signatures of BANDS * ROWS slots where the texts are read. Documents of equal multisets (two 64-bit sums) form one group,
   kept by its smallest id from here on: copies of a text cost one row each and no pair.
2. Documents that agree on all slots of a band share a bucket. Two of similarity 0.8 miss each other in all bands with probability
   (1 - 0.8**ROWS)**BANDS, below 3e-6 by default.
3. Each bucket's members are held against its smallest member: pairs grow with the rows of buckets, not with their squares, and a
   smallest member's text is dealt once for every STAR of them. The
   exact overlap of the two multisets decides. Linked documents get the smallest id of their component.
4. Only buckets that still hold several components are looked at again, of those with the same members one, in groups of two blocks of a bounded
   number of members and words. In a group every pair of different components whose first common band is this one is compared exactly, one member with all others in one
   vector operation, and only links that join two components leave it: fewer than members. Every pair of a bucket is then either
   verified or already in one component, so that no link that could join two components is lost, and no list of pairs is made.

Nulls: a document without words (null text too) belongs to a class of its own, as do rows of null doc_id, which have a null class.
Documents under 5 words have one shingle of all their words; texts of any length are signed whole. Rows that repeat a doc_id with other texts
share a class, which is linked to all that one of the texts is linked to. An empty table
gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnline.llm.common import Words, mix, sequence_hash, sequence_sums, signed, slices, spare, swept, written

SHINGLE = 5
THRESHOLD = 0.8
BANDS = 45
ROWS = 6
BLOCK = 4096
BLOCK_WORDS = 2_000_000
STAR = 4096
FILTER = 1 << 24
_SIGNED = "doc_id long, total long, s1 long, s2 long, bands array<long>"
U64 = np.uint64


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles and the rows they belong to: runs of k words, or all words of a row that has fewer."""
    size = np.diff(words.first)
    count = np.where(size >= k, size - k + 1, np.minimum(size, 1))
    row = np.repeat(np.arange(len(size)), count)
    start = words.first[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    stop = np.minimum(start + k, words.first[row + 1])
    return sequence_hash(sequence_sums(words.hashes), start, stop), row


def multisets(words: Words, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """row, shingle, multiplicity, in order of row and shingle."""
    hashes, row = shingles(words, k)
    if not len(row):
        return row, hashes, row
    bounds = np.searchsorted(row, np.arange(len(words.first)))
    hashes = hashes.copy()
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        hashes[a:b].sort()
    new = np.ones(len(row), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    return row[at], hashes[at], np.diff(np.append(at, len(row)))


def _uniform(x: np.ndarray) -> np.ndarray:
    """In (0, 1], from the upper 53 bits."""
    return ((x >> U64(11)).astype(np.float64) + 1) * 2.0**-53


def bag_min_hash(owner: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n: int, slots: int) -> np.ndarray:
    """n x slots signatures of n multisets given as (owner, shingle, weight): the hash of each slot's earliest point."""
    signature = np.zeros((n, slots), U64)
    total = np.bincount(owner, weight, n)
    todo = total > 0
    slack = 3.0
    # Blocks of weights, and each one's process.
    blocks = np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64) + 1
    item = np.repeat(np.arange(len(owner)), blocks)
    b = np.arange(len(item)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    size = np.where(b > 0, 2.0 ** (b - 1), 1.0)
    low = np.where(b > 0, size, 0.0)
    own, most = owner[item], weight[item]
    seed = mix(shingle[item] + b.astype(U64) * U64(0xA24BAED4963EE407))
    while todo.any():
        horizon = np.where(todo, (np.log(slots) + slack) / np.maximum(total, 1), 0)
        live = np.flatnonzero(todo[own])
        time, found, step = np.zeros(len(live)), [], 0
        while len(live):
            # Some points of each process at a time: about half of those that are to come.
            ahead = slots * float(np.mean(size[live] * (horizon[own[live]] - time)))
            steps = np.arange(step + 1, step + 1 + min(128, 1 + int(ahead / 2)), dtype=U64) * U64(0x9FB21C651E98DF25)
            step += len(steps)
            draw = mix(seed[live, None] + steps)
            when = np.cumsum(np.log(_uniform(draw)), axis=1)
            when *= (-1 / (slots * size[live]))[:, None]
            when += time[:, None]
            near = when <= horizon[own[live], None]
            i, j = np.nonzero(near)
            draw, at = draw[i, j], live[i]
            place = mix(draw ^ U64(0x6A09E667F3BCC909))
            slot = own[at] * slots + (place % U64(slots)).astype(np.int64)
            part = np.flatnonzero(b[at] > 0)  # the first block lies below every weight
            level = low[at[part]] + size[at[part]] * _uniform(mix(place[part] ^ U64(0xBB67AE8584CAA73B)))
            good = np.ones(len(at), bool)
            good[part] = level <= most[at[part]]
            found.append((slot[good], when[i, j][good], draw[good]))
            more = near[:, -1]
            live, time = live[more], when[more, -1]
        first = np.full(n * slots, np.inf)
        for at, when, _ in found:
            np.minimum.at(first, at, when)
        for at, when, draw in found:
            least = when == first[at]
            signature.reshape(-1)[at[least]] = draw[least]
        todo &= ~np.isfinite(first.reshape(n, slots)).all(axis=1)
        slack = 2 * slack + np.log(slots)  # twice the horizon
    return signature


def _sign(k: int, bands: int, rows: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in slices(batch, "text", 1 << 20):
                row, shingle, weight = multisets(Words(run.column("text")), k)
                n = run.num_rows
                total = np.bincount(row, weight, n).astype(np.int64)
                sums = []
                for c in (0x8CB92BA72F3D8DD7, 0xAEF17502108EF2D9):
                    x = np.zeros(n, U64)
                    np.add.at(x, row, mix(shingle ^ U64(c)) * weight.astype(U64))
                    sums.append(signed(x))
                keys = np.zeros((n, bands), U64)
                # Documents of like size together, since small ones take more steps.
                order = np.argsort(total, kind="stable")
                place = np.empty(n, np.int64)
                place[order] = np.arange(n)
                cuts = np.flatnonzero(np.diff(np.ceil(np.log2(total[order] + 1)))) + 1
                for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), n], strict=True):
                    mine = (place[row] >= a) & (place[row] < b)
                    s = bag_min_hash(place[row[mine]] - a, shingle[mine], weight[mine], b - a, bands * rows).reshape(b - a, bands, rows)
                    key = np.broadcast_to(np.arange(bands, dtype=U64), (b - a, bands)) * U64(0x3C6EF372FE94F82B)
                    for r in range(rows):
                        key = mix((key ^ s[:, :, r]) * U64(0xA54FF53A5F1D36F1))
                    keys[order[a:b]] = key
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, n * bands + 1, bands, dtype=np.int32)), pa.array(signed(keys.reshape(-1))))
                yield pa.RecordBatch.from_arrays([run.column("doc_id"), pa.array(total), *map(pa.array, sums), flat], ["doc_id", "total", "s1", "s2", "bands"])

    return sign


def _multiset(text: str, k: int) -> tuple[np.ndarray, np.ndarray]:
    return multisets(Words(pa.array([text], pa.string())), k)[1:]


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[int, int]:
    """Sizes of the two multisets' intersection and union."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    return both, int(a[1].sum() + b[1].sum()) - both


def _verify(k: int, threshold: float):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for batch in batches:
            cells: list[list] = [[], [], []]
            for a, b, x, y in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "text_a", "text_b")), strict=True):
                if a != last:
                    last, held = a, _multiset(x, k)
                both, either = overlap(held, _multiset(y, k))
                if both >= threshold * either:
                    for c, v in zip(cells, (a, b, both / either), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(cells[0], pa.int64()), pa.array(cells[1], pa.int64()), pa.array(cells[2], pa.float64())], ["a", "b", "similarity"])

    return verify


def _join_components(k: int, threshold: float):
    """Of the members of one bucket, or of two of its blocks: links between components, found by comparing all that are open."""

    def join(key: tuple, rows: pa.Table) -> pa.Table:
        band, lo, hi = (x.as_py() for x in key)
        rows = rows.sort_by("doc")
        doc, block = rows["doc"].to_numpy(), rows["block"].to_numpy()
        label = np.unique(rows["root"].to_numpy(), return_inverse=True)[1]
        bands = pa.concat_arrays(rows["bands"].chunks).flatten().to_numpy().reshape(len(doc), -1)
        before = bands[:, : int(np.argmax((bands == band).any(axis=0)))]
        row, shingle, weight = multisets(Words(pa.concat_arrays(rows["text"].chunks)), k)
        # A multiset as a set: a shingle's occurrences are elements of their own.
        item = np.repeat(np.arange(len(row)), weight)
        turn = np.arange(len(item)) - np.repeat(np.cumsum(weight) - weight, weight)
        element = np.unique(mix(shingle[item] + turn.astype(U64) * U64(0x94D049BB133111EB)), return_inverse=True)[1]
        total = np.bincount(row, weight, len(doc)).astype(np.int64)
        start = np.cumsum(total) - total
        mark = np.zeros(int(element.max()) + 1, np.int32)
        out: list[list] = [[], [], []]
        for x in range(len(doc) - 1):
            after = slice(x + 1, len(doc))
            open_ = (label[after] != label[x]) & (np.minimum(total[after], total[x]) >= threshold * np.maximum(total[after], total[x]))
            if lo != hi:
                open_ &= block[after] != block[x]
            at = np.flatnonzero(open_)
            at = at[~(before[at + x + 1] == before[x]).any(axis=1)] + x + 1
            if not len(at):
                continue
            own = element[start[x] : start[x] + total[x]]
            mark[own] = 1
            first = int(at[0])
            both = np.add.reduceat(mark[element[start[first] :]], start[first:] - start[first])[at - first]
            mark[own] = 0
            for y, c in zip(at.tolist(), both.tolist(), strict=True):
                either = int(total[x] + total[y]) - c
                if c >= threshold * either and label[x] != label[y]:
                    label[label == label[y]] = label[x]
                    for cell, v in zip(out, (int(doc[x]), int(doc[y]), c / either), strict=True):
                        cell.append(v)
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], ["a", "b", "similarity"])

    return join


def components(links: DataFrame) -> DataFrame:
    """id, root: the smallest id of each component of links(a, b), by large-star and small-star steps until nothing changes.

    Each step is written to the shared folder; a node's links are only ever aggregated, never gathered.
    """
    edges = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    mark = _fingerprint(edges)
    while True:
        ways = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = ways.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = ways.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(least.select("a", F.col("m").alias("b")))
        after = written(small.distinct())
        last, mark = mark, _fingerprint(after)
        swept(links.sparkSession)
        if mark == last:
            return after.select(F.col("a").alias("id"), F.col("b").alias("root"))
        edges = after


def _fingerprint(edges: DataFrame) -> tuple:
    """The number of distinct edges and 128 bits of all of them, whatever their order."""
    pair = [F.bit_xor(F.xxhash64(F.lit(k), "a", "b")) for k in (1, 2)]
    return tuple(edges.agg(F.count("*"), *pair).first())


def _labelled(buckets: DataFrame, roots: DataFrame) -> DataFrame:
    return buckets.join(roots, buckets.doc == roots.id, "left").select("band", "no", "doc", "total", F.coalesce("root", "doc").alias("root"))


def _among(rows: DataFrame, ids: DataFrame, bits: int = FILTER) -> DataFrame:
    """Those of rows(doc_id, ...) whose doc_id is one of ids(doc), and a few more: by a bit for each hash of an id, bits / 64 numbers at most, broadcast.

    No row is shuffled. What it lets through besides, a share of distinct ids over bits, finds no partner in later joins.
    """
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    set_bits = ids.select(place("doc").alias("place")).groupBy(F.shiftright("place", 6).alias("__word")).agg(F.expr("bit_or(shiftleft(1L, cast(place % 64 AS int)))").alias("__bits"))
    found = rows.join(F.broadcast(set_bits), F.shiftright(place("doc_id"), 6) == F.col("__word"))
    return found.where(F.getbit("__bits", (place("doc_id") % 64).cast("int")) == 1).select(*rows.columns)


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, k: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, class_id (the smallest doc_id of the document's class), is_first: a row for each of docs(doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    signed_docs = written(docs.where("doc_id IS NOT NULL").mapInArrow(_sign(k, bands, rows), _SIGNED))
    some = signed_docs.where("total > 0")
    groups = written(some.groupBy("total", "s1", "s2").agg(F.min("doc_id").alias("doc"), F.min_by("bands", "doc_id").alias("bands")))
    member = groups.select("doc", "total", F.posexplode("bands").alias("no", "band"))
    shared = member.groupBy("band").agg(F.count("*").alias("n"), F.min("doc").alias("least")).where("n > 1").select("band", "least")
    buckets = written(member.join(shared, "band").select("band", "no", "doc", "total", "least"))
    # Only these texts are compared, and shuffled to that end.
    texts = written(_among(docs.where("doc_id IS NOT NULL AND text IS NOT NULL"), buckets))
    swept(docs.sparkSession)

    def linked(pairs: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) that are similar; texts of b travel to a, and a's text once for every STAR of them."""
        text = lambda x: texts.select(F.col("doc_id").alias(x), F.col("text").alias(f"text_{x}"))
        stars = pairs.groupBy("a").agg(F.ceil(F.count("*") / STAR).cast("int").alias("points"))
        left = stars.join(text("a"), "a").withColumn("point", F.explode(F.sequence(F.lit(0), F.col("points") - 1))).select("a", "point", "text_a")
        right = pairs.join(stars, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("points")).cast("int").alias("point")).join(text("b"), "b")
        both = right.join(left, ["a", "point"]).select("a", "b", "text_a", "text_b")
        return both.mapInArrow(_verify(k, threshold), "a long, b long, similarity double")

    near = "least(total, other) >= {} * greatest(total, other)".format(threshold)
    size = groups.select(F.col("doc").alias("a"), F.col("total").alias("other"))
    star = buckets.where("doc > least").select(F.col("least").alias("a"), F.col("doc").alias("b"), "total").distinct()
    links = written(linked(written(star.join(size, "a").where(near).select("a", "b"))))
    roots = components(links)
    marked = written(_labelled(buckets.select("band", "no", "doc", "total"), roots))
    members = [F.bit_xor(F.xxhash64(F.lit(k_), "doc")).alias(f"m{k_}") for k_ in (1, 2)]
    mixed = marked.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min("doc").alias("least"), F.count("*").alias("n"), F.sum("total").alias("words"), F.min("no").alias("no"), *members).where("lo < hi")
    # Buckets of the same members, as those of one group in several bands, are compared once, in the first band.
    mixed = mixed.groupBy("m1", "m2", "n").agg(F.min_by("band", "no").alias("band"), *(F.first(c).alias(c) for c in ("least", "words")))
    mixed = mixed.select("band", "least", F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("words") / BLOCK_WORDS)).cast("int").alias("n_blocks"))
    open_rows = marked.join(mixed, "band").where("doc > least").withColumn("block", F.pmod(F.xxhash64("doc"), F.col("n_blocks")).cast("int"))
    meets = open_rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    meets = meets.select("band", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "doc", "root", "block")
    held = groups.select("doc", "bands").join(texts.select(F.col("doc_id").alias("doc"), "text"), "doc")
    late = meets.join(held, "doc").groupBy("band", "lo", "hi").applyInArrow(_join_components(k, threshold), "a long, b long, similarity double")
    late = written(late.select("a", "b").distinct())
    swept(docs.sparkSession)
    if not late.isEmpty():
        roots = components(links.select("a", "b").unionByName(late))
    classes = groups.select("total", "s1", "s2", "doc").join(roots, groups.doc == roots.id, "left").select("total", "s1", "s2", F.coalesce("root", "doc").alias("class_id"))
    full = signed_docs.select("doc_id", "total", "s1", "s2").join(classes, ["total", "s1", "s2"], "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))
    none = docs.where("doc_id IS NULL").select("doc_id", F.lit(None).cast("long").alias("class_id"))
    return full.unionByName(none).withColumn("is_first", F.coalesce(F.col("class_id") == F.col("doc_id"), F.lit(True)))


def first_of_class(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs, all columns, without those that are not the first of their class. Rows that repeat a doc_id stay or go together."""
    copy = spare(docs, "copy")
    copies = near_duplicates(docs, threshold).where(~F.col("is_first")).select(F.col("doc_id").alias(copy)).distinct()
    return docs.join(copies, F.col("doc_id").cast("long") == F.col(copy), "left_anti")

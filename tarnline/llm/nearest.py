"""Approximate nearest neighbours by a hierarchical k-means tree, searched best bin first.

The tree is fitted on SAMPLE vectors at most, those first by a hash of vec_id; every vector is indexed: it descends to one leaf. A
query walks the tree with a priority queue of nodes by distance to their centres and visits leaves in that order. How many
is calibrated: CALIBRATION vectors that the tree was not fitted on are held against all vectors, block by block, and the visits are widened
until the leaves visited hold TARGET of their true neighbours; if none does before, all leaves are. Where neighbours lie in clusters few leaves
are visited; where vectors have no structure, as uniform ones of 64 dimensions, many must be.

Neighbouring leaves stand together in bins of about BIN vectors, and rows are dealt by bin. A query goes to each bin once, with the leaves that it
visits there, and is compared with the vectors of those leaves alone; its K best of the whole bin leave the task, so that what is shuffled after
does not grow with the leaves visited. Leaves of more than a bin, such as those of many equal vectors, are split in blocks, and a
bin's queries in blocks of ASKS, so that no group outgrows a bin on either side. A window picks the K best of all.

Distances are Euclidean, in double precision from the differences of the vectors given; a matrix product only picks candidates, with a margin
above its error. Ties go to the smaller vec_id. Vectors that are null, empty, zero, of another
length than most of the sample, or hold nulls or non-finite numbers take no part, nor do rows of null vec_id. A query's own vec_id is no
neighbour, in repeated rows neither; other repeated rows count once each. Other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnline.llm.common import written

K = 10
SAMPLE = 20_000
BRANCH = 8
LEAF_ROWS = 64
CALIBRATION = 200
TARGET = 0.93
BIN = 2048
BINS = 256
MOST_IN_BIN = 1 << 16
ASKS = 1024
CELLS = 2_000_000
_FOUND = "query_id long, vec_id long, score double"


@dataclass
class Node:
    centres: np.ndarray | None = None  # of the children
    children: list[Node] = field(default_factory=list)
    leaf: int = -1


@dataclass
class Tree:
    root: Node
    leaves: int

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row of x."""
        out = np.zeros(len(x), np.int64)
        todo = [(self.root, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if node.leaf >= 0:
                out[rows] = node.leaf
            else:
                near = squares(x[rows], node.centres).argmin(axis=1)
                todo += [(c, r) for k, c in enumerate(node.children) if len(r := rows[near == k])]
        return out

    def visits(self, query: np.ndarray, most: int, rows: np.ndarray | None = None, least: int = 0) -> list[int]:
        """The first `most` leaves in order of best-bin-first traversal, and more until they have `least` rows, given rows by leaf."""
        queue: list[tuple[float, int, Node]] = [(0.0, 0, self.root)]
        out, pushed, met = [], 1, 0
        while queue and (len(out) < most or met < least):
            _, _, node = heapq.heappop(queue)
            if node.leaf >= 0:
                out.append(node.leaf)
                met += 0 if rows is None else int(rows[node.leaf])
                continue
            for d, c in zip(squares(query[None], node.centres)[0].tolist(), node.children, strict=True):
                heapq.heappush(queue, (d, pushed, c))
                pushed += 1
        return out


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all of a against all of b by a matrix product: right to about 1e-13 of the squared lengths."""
    with np.errstate(over="ignore", invalid="ignore"):
        return (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None] - 2 * (a @ b.T)


def distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Euclidean, of q to the rows of x, from the differences; scaled where squares overflow."""
    with np.errstate(over="ignore", invalid="ignore"):
        gap = x - q
        out = np.sqrt((gap * gap).sum(axis=1))
        for k in np.flatnonzero(~np.isfinite(out)).tolist():
            half = x[k] / 2 - q / 2
            most = np.abs(half).max()
            out[k] = 2 * most * np.sqrt(((half / most) ** 2).sum())
    return out


def _means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = squares(x, centres).argmin(axis=1)
        for j in range(k):
            if (mine := near == j).any():
                centres[j] = x[mine].mean(axis=0)
    return centres, squares(x, centres).argmin(axis=1)


def grow(x: np.ndarray, leaf_rows: float, branch: int = BRANCH, seed: int = 7) -> Tree:
    """A tree whose leaves have at most leaf_rows of x, or equal rows; leaves near each other in it have numbers near each other."""
    rng, n = np.random.default_rng(seed), 0

    def made(rows: np.ndarray) -> Node:
        nonlocal n
        if len(rows) > max(leaf_rows, 1) and (x[rows] != x[rows[0]]).any():
            centres, near = _means(x[rows].copy(), min(branch, len(rows)), rng)
            parts = [(centres[k], r) for k in range(len(centres)) if len(r := rows[near == k])]
            if len(parts) > 1:
                return Node(np.stack([c for c, _ in parts]), [made(r) for _, r in parts])
        n += 1
        return Node(leaf=n - 1)

    return Tree(made(np.arange(len(x))), n)


def binned(rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The bin of each leaf, given rows by leaf, and the blocks each bin is cut into: neighbouring leaves of `size` rows together, or one larger leaf."""
    out, blocks, held = np.zeros(len(rows), np.int64), [0], 0
    for leaf, n in enumerate(rows.tolist()):
        if held and held + n > size:
            blocks.append(0)
            held = 0
        held += n
        out[leaf] = len(blocks) - 1
        blocks[-1] = max(1, -(-held // size))
    return out, np.array(blocks)


def usable(vector: str) -> Column:
    v = F.col(vector)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return v.isNotNull() & fine & F.exists(v, lambda x: x != 0)


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _best(query_id: int, q: np.ndarray, near: np.ndarray, margin: float, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and distances of the k nearest of x; near: about their squared distances, infinite for those that are not asked for."""
    near = np.where((ids == query_id) & (near < np.inf), np.inf, near)
    at = np.flatnonzero(~(near == np.inf))  # a square that overflowed may be no number
    if np.isfinite(margin) and len(at) > k:
        at = at[near[at] <= np.partition(near[at], k - 1)[k - 1] + margin]
    else:
        at = at[ids[at] != query_id]
    d = distances(q, x[at])
    order = np.lexsort((ids[at], d))[:k]
    return ids[at][order], d[order]


def against(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, first: np.ndarray | None = None, asks: np.ndarray | None = None) -> dict[str, pa.Array]:
    """The k nearest of x to each query, as columns of _FOUND.

    With first, the places in x where each leaf begins (and the end), and asks, queries by leaves, a query meets the leaves it asks for alone.
    """
    out: tuple[list, list, list] = ([], [], [])
    length = (x * x).sum(axis=1).max(initial=0)
    step = max(1, CELLS // max(1, len(x)))
    for a in range(0, len(query_ids), step):
        part = queries[a : a + step]
        if asks is None:
            near = squares(part, x)
        else:
            near = np.full((len(part), len(x)), np.inf)
            for leaf, (s, e) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
                who = np.flatnonzero(asks[a : a + step, leaf])
                if len(who) and e > s:
                    near[who, s:e] = np.nan_to_num(squares(part[who], x[s:e]), nan=1e300, posinf=1e300)
        margin = 1e-10 * ((part * part).sum(axis=1) + length)
        for i, (query_id, m) in enumerate(zip(query_ids[a : a + step].tolist(), margin.tolist(), strict=True)):
            found, d = _best(query_id, part[i], near[i], m, ids, x, k)
            out[0].extend([query_id] * len(found))
            out[1].extend(found.tolist())
            out[2].extend(d.tolist())
    return {"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())}


def ranked(found: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of each query."""
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def exact(vectors: DataFrame, ids: np.ndarray, queries: np.ndarray, k: int) -> DataFrame:
    """The k nearest by brute force, for a bounded set of queries, block by block where the vectors are read."""
    shared = vectors.sparkSession.sparkContext.broadcast((ids, queries))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, x = shared.value
        for batch in batches:
            for a in range(0, batch.num_rows, 4 * BIN):
                part = batch.slice(a, 4 * BIN)
                yield pa.RecordBatch.from_pydict(against(query_ids, x, part.column("vec_id").to_numpy(), _matrix(part.column("v")), k))

    return ranked(vectors.mapInArrow(search, _FOUND), k)


def _sampled(flat: DataFrame, total: int, most: int) -> pa.Table:
    """vec_id, v of the `most` rows that come first by a hash of both; a filter on the hash keeps what each task sorts small."""
    h = F.xxhash64("vec_id", "v")
    share = 1.5 * most / max(1, total) + 1e-5
    some = flat if share >= 1 else flat.where(F.shiftrightunsigned(h, 1) < F.lit(int(share * 2**63)))
    return some.select("vec_id", "v").orderBy(F.shiftrightunsigned(h, 1), "vec_id").limit(most).toArrow().combine_chunks()


def fitted(flat: DataFrame, total: int, k: int, sample: int, leaf_rows: int, target: float, calibration: int) -> tuple[DataFrame, Tree, int]:
    """Those of the `total` rows of flat(vec_id, v) that have the usual length, a tree, and how many leaves a query visits."""
    first = _sampled(flat, total, sample + calibration)
    size = Counter(map(len, first["v"].to_pylist())).most_common(1)[0][0]
    flat = flat.where(F.size("v") == size)
    first = first.filter(pa.array([len(v) == size for v in first["v"].to_pylist()]))
    ids, x = first["vec_id"].to_numpy(), _matrix(first["v"])
    aside = min(calibration, -(-len(x) // 4))  # the tree is not fitted on these
    tree = grow(x[aside:] if len(x) > aside else x, leaf_rows * len(x) / total)
    return flat, tree, calibrated(flat, tree, ids[:aside], x[:aside], k, target)


def search(vectors: DataFrame, queries: Column, k: int = K, sample: int = SAMPLE, leaf_rows: int = LEAF_ROWS, target: float = TARGET, calibration: int = CALIBRATION) -> DataFrame:
    """query_id, rank, vec_id, score of vectors(vec_id, embedding): those that meet the condition `queries` against all."""
    flat = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v"), F.coalesce(queries, F.lit(False)).alias("asks"))
    flat = flat.where(F.col("vec_id").isNotNull() & usable("v"))
    spark, total = flat.sparkSession, flat.count()
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    flat, tree, wide = fitted(flat, total, k, sample, leaf_rows, target, calibration)
    shared = spark.sparkContext.broadcast(tree)  # at most as many nodes as the sample has rows

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                leaf = shared.value.assign(_matrix(batch.column("v")))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), batch.column("asks"), pa.array(leaf)], ["vec_id", "v", "asks", "leaf"])

    placed = written(flat.mapInArrow(place, "vec_id long, v array<double>, asks boolean, leaf long"))
    rows, ids_in = np.zeros(tree.leaves, np.int64), np.zeros(tree.leaves, np.int64)
    for r in placed.groupBy("leaf").agg(F.count("*").alias("n"), F.approx_count_distinct("vec_id").alias("ids")).collect():  # a row a leaf at most
        rows[r.leaf], ids_in[r.leaf] = r.n, max(1, r.ids // 2)
    bins, blocks = binned(rows, min(MOST_IN_BIN, max(BIN, total // BINS)))
    known = spark.sparkContext.broadcast((bins, blocks, ids_in))  # as many numbers as the tree has leaves

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each bin that a query visits, and block of that."""
        bins, blocks, ids_in = known.value
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for k_, q in enumerate(_matrix(batch.column("v")) if batch.num_rows else ()):
                leaves = np.sort(np.array(shared.value.visits(q, wide, ids_in, k + 1)))
                for part in np.split(leaves, np.flatnonzero(np.diff(bins[leaves])) + 1):
                    b = int(bins[part[0]])
                    for block in range(int(blocks[b])):
                        for c, v in zip(out, (k_, b, block, part), strict=True):
                            c.append(v)
            at = pa.array(out[0], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").take(at), batch.column("v").take(at), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.list_(pa.int64()))],
                ["query_id", "v", "bin", "block", "leaves"],
            )

    asked = written(placed.where("asks").select("vec_id", "v").mapInArrow(walk, "query_id long, v array<double>, bin long, block int, leaves array<long>"))
    # Numbers of each bin: there are fewer than leaves.
    turns = asked.where("block = 0").groupBy("bin").agg(F.ceil(F.count("*") / ASKS).cast("int").alias("turns"))
    of_leaf = spark.createDataFrame([(k_, int(b), int(blocks[b])) for k_, b in enumerate(bins.tolist())], "leaf long, bin long, blocks int")
    turns = F.broadcast(turns)
    left = placed.join(F.broadcast(of_leaf), "leaf").join(turns, "bin")
    left = left.select("bin", F.pmod(F.xxhash64("vec_id", "v"), F.col("blocks")).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("turn"), "leaf", "vec_id", "v")
    right = asked.join(turns, "bin").select("bin", "block", F.pmod(F.xxhash64("query_id"), F.col("turns")).cast("int").alias("turn"), "query_id", "v", "leaves")

    def meet(rows: pa.Table, asks: pa.Table) -> pa.Table:
        if not rows.num_rows or not asks.num_rows:
            return pa.table({n: pa.array([], t) for n, t in (("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64()))})
        rows = rows.sort_by("leaf")
        leaves, first = np.unique(rows["leaf"].to_numpy(), return_index=True)
        wanted = pa.concat_arrays(asks["leaves"].chunks)
        who = np.repeat(np.arange(len(wanted)), np.diff(wanted.offsets.to_numpy()))
        flat = wanted.flatten().to_numpy()
        at = np.minimum(np.searchsorted(leaves, flat), len(leaves) - 1)
        here = leaves[at] == flat
        member = np.zeros((len(wanted), len(leaves)), bool)
        member[who[here], at[here]] = True
        return pa.table(against(asks["query_id"].to_numpy(), _matrix(asks["v"]), rows["vec_id"].to_numpy(), _matrix(rows["v"]), k, np.append(first, rows.num_rows), member))

    keys = ["bin", "block", "turn"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, _FOUND)
    return ranked(found, k)


def calibrated(flat: DataFrame, tree: Tree, ids: np.ndarray, x: np.ndarray, k: int, target: float) -> int:
    """How many leaves to visit so that the share `target` of the calibration queries' true neighbours is met."""
    near = exact(flat, ids, x, k)
    pairs = near.select("query_id", "vec_id").distinct().join(flat.select("vec_id", "v").dropDuplicates(["vec_id"]), "vec_id").toArrow().combine_chunks()
    if not pairs.num_rows:
        return tree.leaves
    leaf = tree.assign(_matrix(pairs["v"]))
    order = {q: {b: r for r, b in enumerate(tree.visits(v, tree.leaves), 1)} for q, v in zip(ids.tolist(), x, strict=True)}
    need = np.sort([order[q][b] for q, b in zip(pairs["query_id"].to_pylist(), leaf.tolist(), strict=True)])
    return int(need[min(len(need) - 1, int(np.ceil(target * len(need))) - 1)])

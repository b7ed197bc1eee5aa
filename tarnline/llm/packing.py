"""Packing: documents' token ids, one after another, cut into sequences of a fixed length.

Concatenate and cut. The first pass encodes every text where it is read and writes ids with running totals of
their input partition to the shared folder; the partitions' totals, summed over the partitions, give global offsets;
the second pass cuts each document's ids at multiples of the length. No text or id is shuffled: only one row a
partition is. A sequence that two partitions share has pieces from both, which its id and offsets join.

Order is that of the input partitions and of rows in them. A null text is empty: it has its end id alone. A null
doc_id stays null. Repeated rows are packed as often as they come. Columns other than doc_id and text are not read.
An empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnline.llm.common import slices, written
from tarnline.llm.tokens import ByteBpe, ready

LENGTH = 2048
END = 1
_IDS = "part int, row long, doc_id long, start_in_part long, n long, ids binary"
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def _encode(end: int, kind: type):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row, total, encoder = TaskContext.get().partitionId(), 0, 0, ready(kind)
        last = end.to_bytes(4, "little")
        for batch in batches:
            for run in slices(batch, "text"):
                ids = [encoder.encode(x or "") + last for x in run.column("text").to_pylist()]
                n = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
                start = total + np.cumsum(n) - n
                k = len(ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(k, part, np.int32)), pa.array(np.arange(row, row + k)), run.column("doc_id").cast("int64"), pa.array(start), pa.array(n), pa.array(ids, pa.binary())],
                    ["part", "row", "doc_id", "start_in_part", "n", "ids"],
                )
                row, total = row + k, total + int(n.sum())

    return encode


def _cut(length: int, keep_ids: bool):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _PIECES.split(", ")][: 8 if keep_ids else 7]
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for doc_id, at, n, ids in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "at", "n", "ids")), strict=True):
                done = 0
                while done < n:
                    sequence, offset = divmod(at + done, length)
                    k = min(n - done, length - offset)
                    piece = ids[4 * done : 4 * (done + k)]
                    for c, v in zip(out, (doc_id, done, k, zlib.crc32(piece), n, sequence, offset, piece), strict=False):
                        c.append(v)
                    done += k
            kinds = [pa.int64()] * 7 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=False)], names)

    return cut


def partition_offsets(sizes: DataFrame) -> DataFrame:
    """part, n (of one or more rows a part) -> part, base: what comes before the part. One row an input partition."""
    totals = sizes.groupBy("part").agg(F.sum("n").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))


def pack(docs: DataFrame, length: int = LENGTH, end: int = END, encoder: type = ByteBpe, keep_ids: bool = True) -> DataFrame:
    """Pieces of docs(doc_id, text): each id of each document lies in exactly one.

    length: ids a sequence. end: the id put after each document. encoder: a class of tokens.py. keep_ids: with ids,
    the little-endian unsigned 32-bit ids of the piece.
    """
    coded = written(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_encode(end, encoder), _IDS))
    # As many rows as the input has partitions, 16 bytes each, whatever the partitions hold.
    bases = F.broadcast(partition_offsets(coded.select("part", "n")))
    placed = coded.join(bases, "part").select("doc_id", (F.col("base") + F.col("start_in_part")).alias("at"), "n", "ids")
    schema = _PIECES if keep_ids else _PIECES.rpartition(",")[0]
    return placed.mapInArrow(_cut(length, keep_ids), schema)


def sequences(pieces: DataFrame, length: int = LENGTH, pad: int = 0) -> DataFrame:
    """sequence_id, ids (array): pieces put together, the last sequence padded to length unless its size is a power of two.

    A sequence has length ids at most, so that no group is large.
    """

    def join(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("offset")
        ids = np.frombuffer(b"".join(rows["ids"].to_pylist()), "<u4").astype(np.int64)
        if len(ids) & (len(ids) - 1):
            ids = np.concatenate([ids, np.full(length - len(ids), pad)])
        return pa.table({"sequence_id": pa.array([key[0].as_py()], pa.int64()), "ids": pa.array([ids], pa.list_(pa.int64()))})

    return pieces.groupBy("sequence_id").applyInArrow(join, "sequence_id long, ids array<long>")

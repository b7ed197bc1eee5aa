"""What the operators share: tables written to the shared folder, samples by hash, words of UTF-8 buffers, 64-bit hashes."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnline.sources.shared import shared_dir

U64 = np.uint64


def written(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """df as a Parquet table in the shared folder, read again: lineage ends there, and lost executors cost nothing before it.

    The table stays until the shared folder is cleaned, since the frame returned reads it lazily.
    """
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def released() -> None:
    """Give memory that this process has freed, as earlier tasks of a worker did, back to the system, where its C library can."""
    gc.collect()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def swept(spark: SparkSession) -> None:
    """Collect the driver's garbage, between the jobs of a long operator: Spark then removes shuffle files and broadcasts of those that are over."""
    released()
    spark.sparkContext._jvm.System.gc()


def spare(docs: DataFrame, name: str) -> str:
    """name, or with underscores after it one that docs has no column of."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def held_out(doc_id: str = "doc_id"):
    """Whether crc32 of the id as text, modulo 4, is 2; an id that is null is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply, shift, xor), element by element."""
    x = x ^ (x >> U64(31))
    x = x * U64(0x9E3779B97F4A7C15)
    x ^= x >> U64(29)
    x *= U64(0xD1B54A32D192ED03)
    x ^= x >> U64(32)
    return x


def first_by_hash(rows: DataFrame, group: str, n: int) -> DataFrame:
    """rows(doc_id, group, ...) with rank: the n of each group that come first by a hash of doc_id, ties by the other columns.

    Groups are counted first, and rows beyond a hash by which n are most likely met never leave the task that reads them, so that what is
    ranked has about n rows a group however large the group is. The groups' counts are collected: one row a group.
    """
    share = lambda total: min(1.0, (n + 4 * n**0.5 + 20) / total)
    counts = [(r[0], min(int(share(r[1]) * 2**63), 2**63 - 1)) for r in rows.groupBy(group).count().collect()]
    limits = rows.sparkSession.createDataFrame(counts, f"__group {rows.schema[group].dataType.simpleString()}, __most long")
    h = F.shiftrightunsigned(F.xxhash64("doc_id"), 1)
    some = rows.join(F.broadcast(limits), F.col(group) == F.col("__group")).where(h <= F.col("__most")).drop("__group", "__most")
    order = Window.partitionBy(group).orderBy(h, *rows.columns)
    return some.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


class Powers:
    """Powers of an odd base modulo 2**64 and their inverses, grown as needed."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, U64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * U64(pow(self.base, k, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * U64(pow(self.inverse, k, 1 << 64))])
        return self.up, self.down


_BYTES = Powers(0xA0761D6478BD642F)
_SEQ = (Powers(0xE7037ED1A0B428DB), Powers(0x8EBC6AF09C88C6E3))
_VALUE = mix(np.arange(1, 257, dtype=U64) * U64(0x589965CC75374CC3))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its rows; null counts as empty."""
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), at


def slices(batch: pa.RecordBatch, column: str, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about size bytes of text each, so that work arrays stay small."""
    if not batch.num_rows:
        return
    _, at = texts(batch.column(column))
    first = 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(at, at[first] + size, "right")) - 1)
        yield batch.slice(first, last - first)
        first = last


class Words:
    """Words [^\\x20\\x09-\\x0D]+ of a column of texts: a 64-bit hash each, and where each row's words begin.

    hashes: of all words, row after row. first: n_rows + 1 positions in hashes.
    """

    def __init__(self, column: pa.Array):
        data, at = texts(column)
        data, at = data[at[0] : at[-1]], at - at[0]
        word = ~_SPACE[data]
        begins = word.copy()
        begins[1:] &= ~word[:-1]
        inner = at[1:-1]
        inner = inner[inner < len(data)]
        begins[inner] = word[inner]  # a row's end ends its last word
        starts = np.flatnonzero(begins)
        ends = word.copy()
        ends[:-1] &= ~word[1:]
        inner = inner[inner > 0]
        ends[inner - 1] = word[inner - 1]
        stops = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(starts, at)
        self.hashes = np.empty(len(starts), U64)
        i = 0
        while i < len(starts):  # in pieces, for the sake of memory
            j = max(i + 1, int(np.searchsorted(stops, starts[i] + (1 << 20), "right")))
            a, b = starts[i], stops[j - 1]
            up, down = _BYTES.to(b - a)
            sums = np.zeros(b - a + 1, U64)
            np.cumsum(_VALUE[data[a:b]] * up[: b - a], out=sums[1:])
            s, e = starts[i:j] - a, stops[i:j] - a
            self.hashes[i:j] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(U64) * U64(0xC2B2AE3D27D4EB4F))
            i = j
        self.row = np.repeat(np.arange(len(at) - 1), np.diff(self.first))


def sequence_sums(hashes: np.ndarray, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums from which sequence_hash takes the hash of any run of words."""
    up, down = _SEQ[which].to(len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, U64)
    np.cumsum((mix(hashes + U64(which)) if which else hashes) * up[: len(hashes)], out=sums[1:])
    return sums, down


def sequence_hash(sums: tuple[np.ndarray, np.ndarray], start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the words from start to stop; equal runs have equal hashes wherever they stand."""
    total, down = sums
    return mix((total[stop] - total[start]) * down[start] + (stop - start).astype(U64) * U64(0x9FB21C651E98DF25))


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words, across rows too: callers choose which are whole."""
    n = max(0, len(hashes) - k + 1)
    if not n:
        return np.zeros(0, U64)
    at = np.arange(n)
    return sequence_hash(sequence_sums(hashes), at, at + k)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)

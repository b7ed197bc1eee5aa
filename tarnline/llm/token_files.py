"""Token files: ids in blocks, each block transposed to bit or byte planes, each plane compressed with zstandard.

A container holds whole documents, in order. Layout, little-endian: magic "TLP1", u8 bytes an id, u8 1 for bit planes
or 0 for byte planes, u32 ids a block, u64 ids, u32 blocks; then the blocks' planes; then, for every block, the
chunk index: u64 offset from the container's start, u32 ids and one u32 size for every plane; then u64, the place of the index. A block
can be read without the others.

Planes: bit p of all ids of a block stand together, so that the high bits, nearly always zero, cost almost nothing.

Null texts are empty and have their end id alone; rows of a null doc_id come first and are kept; repeated ids keep
all their rows, ordered by text; other columns are not read; an empty table gives no containers. Texts of any length are encoded whole.

Rows are dealt by ranges of doc_id, so that rows of one doc_id, or of none, share a range: ids are taken to tell most rows apart. In a range
memory is bounded by a container whatever its rows.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnline.llm.common import slices, written
from tarnline.llm.packing import partition_offsets
from tarnline.llm.tokens import WordBpe, ready

BLOCK = 1 << 16
CONTAINER = 1 << 20
END = 1
_HEAD = struct.Struct("<4sBBIQI")
_FILES = "part int, container int, n long, doc_ids array<long>, doc_tokens array<long>, data binary"
_READ = "part int, container int, doc_id long, start long, n_tokens long, ids binary"


def planes(ids: np.ndarray, width: int, bits: bool) -> list[bytes]:
    """The planes of a block: of width bytes an id, most significant first in bit planes, least in byte planes."""
    raw = ids.astype(f"<u{width}").view(np.uint8).reshape(-1, width)
    if not bits:
        return [np.ascontiguousarray(raw[:, p]).tobytes() for p in range(width)]
    return [np.packbits(x).tobytes() for x in np.unpackbits(raw[:, ::-1], axis=1).T]


def joined(parts: list[bytes], n: int, width: int, bits: bool) -> np.ndarray:
    """The ids of a block from its planes."""
    if bits:
        cells = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n) for p in parts], axis=1)
        raw = np.packbits(cells, axis=1)[:, ::-1]
    else:
        raw = np.stack([np.frombuffer(p, np.uint8) for p in parts], axis=1)
    return np.ascontiguousarray(raw).view(f"<u{width}").reshape(-1).astype("<u4")


def encode_container(ids: np.ndarray, block: int = BLOCK, bits: bool = True, level: int = 3) -> bytes:
    """A container of ids, unsigned integers below 2**32; two bytes an id if all fit."""
    width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
    press = zstandard.ZstdCompressor(level=level)
    n_blocks = -(-len(ids) // block)
    out, index = [_HEAD.pack(b"TLP1", width, bits, block, len(ids), n_blocks)], []
    at = _HEAD.size
    for k in range(n_blocks):
        part = ids[k * block : (k + 1) * block]
        packed = [press.compress(p) for p in planes(part, width, bits)]
        index.append(struct.pack(f"<QI{len(packed)}I", at, len(part), *map(len, packed)))
        out += packed
        at += sum(map(len, packed))
    return b"".join([*out, *index, struct.pack("<Q", at)])


class Container:
    """A container's ids, read block by block through its chunk index; the last block read is kept."""

    def __init__(self, data: bytes):
        magic, self.width, self.bits, self.block, self.total, _ = _HEAD.unpack_from(data)
        if magic != b"TLP1":
            raise ValueError("not a token container")
        self.data = data
        self.entry = struct.Struct(f"<QI{self.width * (8 if self.bits else 1)}I")
        self.index = struct.unpack_from("<Q", data, len(data) - 8)[0]
        self.unpack = zstandard.ZstdDecompressor()
        self.kept: tuple[int, np.ndarray] = (-1, np.zeros(0, "<u4"))

    def ids_of_block(self, k: int) -> np.ndarray:
        if self.kept[0] != k:
            at, n, *sizes = self.entry.unpack_from(self.data, self.index + k * self.entry.size)
            parts = []
            for size in sizes:
                parts.append(self.unpack.decompress(self.data[at : at + size], max_output_size=n))
                at += size
            self.kept = (k, joined(parts, n, self.width, bool(self.bits)))
        return self.kept[1]

    def ids(self, first: int, last: int) -> np.ndarray:
        """Ids first to last; only the blocks they lie in are unpacked."""
        last, out = min(last, self.total), [np.zeros(0, "<u4")]
        while first < last:
            k, offset = divmod(first, self.block)
            part = self.ids_of_block(k)[offset : offset + last - first]
            out.append(part)
            first += len(part)
        return np.concatenate(out)


def decode_container(data: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """Ids first to last of a container, all of them unless told."""
    held = Container(data)
    return held.ids(first, held.total if last is None else last)


def _encode(end: int, kind: type, container: int, block: int, bits: bool):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, encoder, last = TaskContext.get().partitionId(), 0, ready(kind), end.to_bytes(4, "little")
        ids: list[bytes] = []
        docs: list[int | None] = []
        held = 0

        def made() -> pa.RecordBatch:
            n = [len(x) // 4 for x in ids]
            data = encode_container(np.frombuffer(b"".join(ids), "<u4"), block, bits)
            cells = [[part], [number], [sum(n)], [docs], [n], [data]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, kinds, strict=True)], ["part", "container", "n", "doc_ids", "doc_tokens", "data"])

        for batch in batches:
            for run in slices(batch, "text"):
                for doc_id, text in zip(run.column("doc_id").to_pylist(), run.column("text").to_pylist(), strict=True):
                    ids.append(encoder.encode(text or "") + last)
                    docs.append(doc_id)
                    held += len(ids[-1]) // 4
                    if held >= container:
                        yield made()
                        ids, docs, held, number = [], [], 0, number + 1
        if docs:
            yield made()

    return encode


def write_tokens(docs: DataFrame, end: int = END, encoder: type = WordBpe, container: int = CONTAINER, block: int = BLOCK, bits: bool = True) -> DataFrame:
    """docs(doc_id, text) as containers in ascending doc_id order, in a table in the shared folder.

    Returns the table read again: part, container (number in the part), n, doc_ids, doc_tokens, data. Parts follow
    each other in doc_id order. The texts are dealt by ranges of doc_id, the one shuffle.
    """
    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    ordered = source.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return written(ordered.mapInArrow(_encode(end, encoder, container, block, bits), _FILES), "none")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            held = Container(row["data"])
            n = np.array(row["doc_tokens"], np.int64)
            stop = np.cumsum(n)
            raw = [held.ids(a, b).tobytes() for a, b in zip((stop - n).tolist(), stop.tolist(), strict=True)]
            k = len(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(k, row["part"], np.int32)), pa.array(np.full(k, row["container"], np.int32)), pa.array(row["doc_ids"], pa.int64()), pa.array(row["base"] + stop - n), pa.array(n), pa.array(raw, pa.binary())],
                ["part", "container", "doc_id", "start", "n_tokens", "ids"],
            )


def read_tokens(files: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids (little-endian unsigned 32-bit) of write_tokens' table."""
    sizes = files.select("part", "container", "n")
    bases = F.broadcast(partition_offsets(sizes))  # one row a part: as many as the shuffle had partitions
    inner = Window.partitionBy("part").orderBy("container").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part", "container", F.coalesce(F.sum("n").over(inner), F.lit(0)).alias("in_part"))
    starts = starts.join(bases, "part").select("part", "container", (F.col("base") + F.col("in_part")).alias("base"))
    return files.drop("n").join(starts, ["part", "container"]).mapInArrow(_read, _READ)


def digests(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of what read_tokens gives."""
    return tokens.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))

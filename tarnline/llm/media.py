"""Media columns: Netpbm and BMP bytes to numpy arrays, area-resized by integral images, kept as NPY tiles with difference hashes.

decode() reads P1 to P6 and BMP of 1, 4, 8, 24 or 32 bits without compression; samples above their file's maximum make it broken. area_resize()
averages exactly over each target pixel's area: an integral image, interpolated at the areas' corners. tiles() cuts an array into NPY byte strings of at
most TILE x TILE pixels, and joined() puts them together. difference_hash() compares neighbours of the 9 x 8 grey reduction, 64 bits as hex.

Bytes that are null or can't be decoded give a row without tiles and a null hash. Rows of null ids are kept, as are repeated
ones. Empty tables give none; other columns are not read.

Texts as media: a text's bytes, padded with spaces to whole rows, are the samples of a P6 image of WIDTH RGB pixels a row, decoded and stored as NPY tiles
of TILE rows, so that no array is longer than a tile however long the text is. The stored form is the tiles' bytes one after another, from which payload,
digests and the feature are read: the feature is the difference hash of the whole picture, from sums of its tiles. A null or empty text is 192 spaces.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnline.llm.common import slices, written

WIDTH = 64
ROW = WIDTH * 3  # bytes of a row of RGB pixels
TILE = 256
_TOKEN = re.compile(rb"(?:\s|#[^\n]*\n)*([0-9]+)")


def _netpbm(data: bytes) -> np.ndarray:
    kind, at, head = data[1] - 48, 2, []
    for _ in range(2 if kind in (1, 4) else 3):
        m = _TOKEN.match(data, at)
        if not m:
            raise ValueError("a Netpbm header is cut short")
        head.append(int(m[1]))
        at = m.end()
    width, height, most = (*head, 1)[:3]
    if not 0 < most < 65536:
        raise ValueError("bad maximum")
    depth = 3 if kind in (3, 6) else 1
    n = width * height * depth
    if kind == 1:
        bits = re.findall(rb"[01]", re.sub(rb"#[^\n]*\n", b"", data[at:]))[:n]
        x = np.array([49 - b[0] for b in bits], np.uint8)
    elif kind in (2, 3):
        x = np.array(re.sub(rb"#[^\n]*\n", b"", data[at:]).split()[:n], np.int64)
    elif kind == 4:
        row = -(-width // 8)
        raw = np.frombuffer(data, np.uint8, row * height, at + 1).reshape(height, row)
        x = 1 - np.unpackbits(raw, axis=1)[:, :width]
    else:
        x = np.frombuffer(data, ">u2" if most > 255 else np.uint8, n, at + 1)
    if x.size != n:
        raise ValueError("a Netpbm file is cut short")
    x = x.reshape(height, width, depth)
    if kind not in (1, 4) and x.size and not 0 <= int(x.min()) <= int(x.max()) <= most:
        raise ValueError("a sample out of range")
    if most != 255:
        x = (x.astype(np.uint32) * 255 + most // 2) // most
    return x.astype(np.uint8)


def _bmp(data: bytes) -> np.ndarray:
    start, head, width, height, _, depth, press = struct.unpack_from("<10xIIiiHHI", data)
    if press not in (0, 3) or head < 40:
        raise ValueError("BMP of this kind is not supported")
    row = (width * depth + 31) // 32 * 4
    raw = np.frombuffer(data, np.uint8, row * abs(height), start).reshape(abs(height), row)
    if depth >= 24:
        x = raw[:, : width * depth // 8].reshape(abs(height), width, depth // 8)[:, :, 2::-1]
    elif depth in (1, 4, 8):
        bits = np.unpackbits(raw, axis=1).reshape(abs(height), -1, depth)[:, :width]
        index = (bits * (1 << np.arange(depth)[::-1])).sum(axis=2)
        n = struct.unpack_from("<I", data, 46)[0] or 1 << depth
        x = np.frombuffer(data, np.uint8, 4 * n, 14 + head).reshape(n, 4)[:, 2::-1][index]
    else:
        raise ValueError("BMP of this depth is not supported")
    return np.ascontiguousarray(x[::-1] if height > 0 else x)


def decode(data: bytes) -> np.ndarray:
    """height x width x (1 or 3) samples of 8 bits."""
    if re.match(rb"P[1-6]\s", data[:3]):
        return _netpbm(data)
    if data[:2] == b"BM":
        return _bmp(data)
    raise ValueError("neither Netpbm nor BMP")


def _corners(n: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the edges of `size` equal areas of n pixels lie: whole pixels before, and the part of the next."""
    p = np.arange(size + 1) * n / size
    k = np.minimum(p.astype(np.int64), n - 1)
    return k, p - k


def area_resize(x: np.ndarray, height: int, width: int) -> np.ndarray:
    """height x width x depth means, as doubles, over equal areas of x."""
    return _resized([x], x.shape[0], height, width)


def _resized(parts: Iterable[np.ndarray], h: int, height: int, width: int) -> np.ndarray:
    """As area_resize of the parts, which are h rows of a picture in order; one part's integral image is held at a time, over those above it."""
    k, share = _corners(h, height)
    at, above, edges = 0, None, {}
    need = sorted({*k.tolist(), *(k + 1).tolist()})
    for x in parts:
        table = np.zeros((len(x) + 1, x.shape[1] + 1, x.shape[2]))
        table[1:, 1:] = np.cumsum(np.cumsum(x, axis=0, dtype=np.int64), axis=1)
        if above is not None:
            table += above
        edges |= {row: table[row - at] for row in need if at <= row <= at + len(x)}
        at, above = at + len(x), table[-1].copy()
    w = len(above) - 1
    table = np.stack([edges[a] + (edges[a + 1] - edges[a]) * p for a, p in zip(k.tolist(), share.tolist(), strict=True)])
    k, share = _corners(w, width)
    table = table[:, k] + (table[:, k + 1] - table[:, k]) * share[None, :, None]
    return np.diff(np.diff(table, axis=0), axis=1) * (height * width / (h * w))


def difference_hash(x: np.ndarray) -> str:
    return hash_of_parts([x], x.shape[0])


def hash_of_parts(parts: Iterable[np.ndarray], h: int) -> str:
    """The difference hash of a picture of h rows, given in order in parts."""
    grey = _resized((x.sum(axis=2, dtype=np.int64)[:, :, None] for x in parts), h, 8, 9)[:, :, 0]
    return np.packbits(np.diff(grey, axis=1) > 1e-9).tobytes().hex()


def npy(x: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.lib.format.write_array(out, np.ascontiguousarray(x), (1, 0), allow_pickle=False)
    return out.getvalue()


def from_npy(data: bytes) -> np.ndarray:
    return np.lib.format.read_array(io.BytesIO(data), allow_pickle=False)


def tiles(x: np.ndarray, size: int = TILE) -> list[tuple[int, int, bytes]]:
    """(first row, first column, NPY bytes) of the tiles of x, size x size pixels at most."""
    return [(i, j, npy(x[i : i + size, j : j + size])) for i in range(0, x.shape[0], size) for j in range(0, x.shape[1], size)]


def joined(parts: Iterable[tuple[int, int, bytes]]) -> np.ndarray:
    """The array whose tiles are given as (first row, first column, NPY bytes)."""
    held = [(i, j, from_npy(data)) for i, j, data in parts]
    height, width = (max(t[k] + t[2].shape[k] for t in held) for k in (0, 1))
    out = np.zeros((height, width, *held[0][2].shape[2:]), held[0][2].dtype)
    for i, j, x in held:
        out[i : i + x.shape[0], j : j + x.shape[1]] = x
    return out


def media_tiles(media: DataFrame, size: int = TILE, height: int | None = None, width: int | None = None) -> DataFrame:
    """id, height, width, depth, hash, tiles (array of y, x, npy) of media(id, data), resized first if a height and width are given."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, data in zip(batch.column("id").to_pylist(), batch.column("data").to_pylist(), strict=True):
                try:
                    x = decode(data or b"")
                except (ValueError, struct.error, IndexError, OverflowError):
                    x = np.zeros((0, 0, 0), np.uint8)
                row = {"id": i, "height": x.shape[0], "width": x.shape[1], "depth": x.shape[2], "hash": difference_hash(x) if x.size else None}
                if x.size and height and width:
                    x = np.rint(area_resize(x, height, width)).astype(np.uint8)
                row["tiles"] = [dict(zip(("y", "x", "npy"), t, strict=True)) for t in tiles(x, size)] if x.size else []
                yield pa.RecordBatch.from_pylist([row], kinds)

    kinds = pa.schema([("id", pa.int64()), ("height", pa.int32()), ("width", pa.int32()), ("depth", pa.int32()), ("hash", pa.string()), ("tiles", pa.list_(pa.struct([("y", pa.int32()), ("x", pa.int32()), ("npy", pa.binary())])))])
    schema = "id long, height int, width int, depth int, hash string, tiles array<struct<y:int,x:int,npy:binary>>"
    return media.select(F.col("id").cast("long"), F.col("data").cast("binary")).mapInArrow(cut, schema)


def text_tiles(text: str | None) -> tuple[int, list[bytes]]:
    """A text's bytes, counted, and NPY tiles of it as a picture: TILE rows of WIDTH RGB pixels at a time, each decoded from a P6 image."""
    data = (text or "").encode()
    rows = max(1, -(-len(data) // ROW))
    data = data.ljust(rows * ROW)
    out = []
    for a in range(0, rows, TILE):
        n = min(TILE, rows - a)
        out += [t for _, _, t in tiles(decode(b"P6\n%d %d\n255\n" % (WIDTH, n) + data[a * ROW : (a + n) * ROW]))]
    return len((text or "").encode()), out


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for run in slices(batch, "text"):
            images = [text_tiles(t) for t in run.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([run.column("doc_id"), pa.array([n for n, _ in images], pa.int64()), pa.array([t for _, t in images], pa.list_(pa.binary()))], ["doc_id", "n_bytes", "tiles"])


_READ = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _READ.split(", ")]
    for batch in batches:
        cells: list[list] = [[] for _ in names]
        for i, n, held in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_bytes", "tiles")), strict=True):
            payload, media, size, length, tail = hashlib.sha256(), hashlib.sha256(), 0, 0, b""
            parts = []
            for data in held:
                x = from_npy(data)
                raw = x.tobytes()
                payload.update(raw)
                media.update(data)
                size, length, tail = size + len(raw), length + len(data), raw[-16:]
                parts.append(x)
            row = (i, n, size, payload.hexdigest(), zlib.crc32(tail), length, media.hexdigest(), hash_of_parts(parts, size // ROW))
            for c, v in zip(cells, row, strict=True):
                c.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n in ("payload_sha256", "media_sha256", "feature") else pa.int64()) for c, n in zip(cells, names, strict=True)], names)


def store_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, tiles: each text of docs(doc_id, text) as NPY tiles of 8-bit RGB samples, from the top, in a table in the shared folder."""
    plain = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return written(plain.mapInArrow(_store, "doc_id long, n_bytes long, tiles array<binary>"))


def read_media(stored: DataFrame) -> DataFrame:
    """Digests and difference hashes of what store_texts has stored."""
    return stored.mapInArrow(_read, _READ)

"""Media columns: Netpbm and BMP decoded to arrays, area-resized by integral images, kept as NPY tiles with difference hashes.

Arrays are (height, width, channels), uint8 or uint16. A payload of bytes is a grey picture 24 pixels wide; an odd number of blocks comes as a binary Netpbm file (P5),
an even one as a BMP of 8 bits. Its file is decoded as any file is, cut into tiles of 24 * 24 samples, and stored as one NPY array of tiles (number, 24, 24) for each document.
That table is written; digests and features come from the NPY bytes that are read back.

Defined results: a null text is an empty one, one block of padding; equal texts get equal values; damaged files raise ValueError in the
decoders and give a null array in decode_table; an empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import given_id, held_id, small_batches, written

WIDTH = 24
BLOCK = 576
PAD = b"\xff"


def _header(data: bytes, fields: int) -> tuple[list[int], int]:
    """So many numbers after the magic, and where the raster starts: one white space after the last; # starts a comment."""
    numbers, at = [], 2
    while len(numbers) < fields:
        while at < len(data) and (data[at : at + 1].isspace() or data[at] == 35):
            if data[at] == 35:
                end = data.find(b"\n", at)
                at = len(data) if end < 0 else end
            else:
                at += 1
        start = at
        while at < len(data) and 48 <= data[at] <= 57:
            at += 1
        if start == at:
            raise ValueError("damaged Netpbm header")
        numbers.append(int(data[start:at]))
    return numbers, at + 1


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6: bitmaps (1 is black), grey and colour, plain or raw, up to 16 bits."""
    magic = data[:2]
    if magic not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        raise ValueError("not Netpbm")
    kind = magic[1] - 48
    bitmap, channels = kind in (1, 4), 3 if kind in (3, 6) else 1
    numbers, at = _header(data, 2 if bitmap else 3)
    width, height = numbers[:2]
    top = 1 if bitmap else numbers[2]
    if not width or not height or not 0 < top < 65536:
        raise ValueError("damaged Netpbm header")
    n = width * height * channels
    if kind == 1:
        flat = np.frombuffer(data, np.uint8, offset=min(at - 1, len(data)))
        flat = flat[(flat == 48) | (flat == 49)][:n] - 48
    elif kind in (2, 3):
        flat = np.array(data[at:].split()[:n], np.int64)
    elif kind == 4:
        row = -(-width // 8)
        raw = np.frombuffer(data, np.uint8, offset=at)[: row * height]
        if len(raw) < row * height:
            raise ValueError("short raster")
        flat = np.unpackbits(raw.reshape(height, row), axis=1)[:, :width].reshape(-1)
    else:
        kind_of = np.dtype(np.uint8) if top < 256 else np.dtype(">u2")
        if len(data) - at < n * kind_of.itemsize:
            raise ValueError("short raster")
        flat = np.frombuffer(data, kind_of, n, at)
    if len(flat) < n:
        raise ValueError("short raster")
    if bitmap:
        flat = (1 - flat.astype(np.uint8)) * 255
    return flat.astype(np.uint8 if top < 256 else np.uint16).reshape(height, width, channels)


def encode_pgm(rows: np.ndarray) -> bytes:
    """A raw grey file (P5) of a (height, width) array of uint8."""
    return b"P5\n%d %d\n255\n" % (rows.shape[1], rows.shape[0]) + rows.tobytes()


def encode_bmp(rows: np.ndarray) -> bytes:
    """A BMP file of 8 bits with a grey palette, bottom-up, of a (height, width) array of uint8."""
    height, width = rows.shape
    palette = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 4, axis=1)
    palette[:, 3] = 0
    raster = np.pad(rows[::-1], ((0, 0), (0, -width % 4))).tobytes()
    start = 54 + palette.size
    head = struct.pack("<2sIHHIIiiHHIIiiII", b"BM", start + len(raster), 0, 0, start, 40, width, height, 1, 8, 0, len(raster), 0, 0, 256, 0)
    return head + palette.tobytes() + raster


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 1, 4, 8, 24 or 32 bits, bottom-up or top-down, as RGB."""
    if data[:2] != b"BM" or len(data) < 54:
        raise ValueError("not BMP")
    start, head, width, height, _, bits, packing = struct.unpack_from("<IIiiHHI", data, 10)
    flip, height = height > 0, abs(height)
    if head < 40 or width <= 0 or not height or bits not in (1, 4, 8, 24, 32) or packing:
        raise ValueError("a BMP of a kind that is not read")
    row = (width * bits + 31) // 32 * 4
    if len(data) < start + row * height:
        raise ValueError("short raster")
    raw = np.frombuffer(data, np.uint8, row * height, start).reshape(height, row)
    if bits <= 8:
        colours = struct.unpack_from("<I", data, 46)[0] or 1 << bits
        palette = np.zeros((1 << bits, 4), np.uint8)
        there = np.frombuffer(data, np.uint8, 4 * colours, 14 + head).reshape(-1, 4)
        palette[: len(there)] = there
        if bits < 8:
            raw = np.unpackbits(raw, axis=1).reshape(height, -1, bits) @ (1 << np.arange(bits)[::-1])
        out = palette[raw[:, :width]][..., 2::-1]
    else:
        out = raw[:, : width * bits // 8].reshape(height, width, bits // 8)[..., 2::-1]
    return np.ascontiguousarray(out[::-1] if flip else out)


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means over the areas that the new pixels cover, parts of pixels by their share, from one integral image (float64)."""
    total = np.zeros((image.shape[0] + 1, image.shape[1] + 1, image.shape[2]))
    np.cumsum(np.cumsum(image, axis=0, dtype=np.float64), axis=1, out=total[1:, 1:])

    def at(n: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
        edge = np.arange(parts + 1) * n / parts
        low = np.minimum(edge.astype(np.int64), n - 1)
        return low, edge - low

    y, fy = at(image.shape[0], height)
    x, fx = at(image.shape[1], width)
    rows = total[y] + (total[y + 1] - total[y]) * fy[:, None, None]
    grid = rows[:, x] + (rows[:, x + 1] - rows[:, x]) * fx[None, :, None]
    area = image.shape[0] / height * (image.shape[1] / width)
    return (grid[1:, 1:] - grid[:-1, 1:] - grid[1:, :-1] + grid[:-1, :-1]) / area


def difference_hash(image: np.ndarray, side: int = 8) -> str:
    """Whether each of side * side areas is brighter than the one to its left, as hexadecimal digits."""
    small = area_resize(image, side, side + 1).mean(axis=2)
    return np.packbits(np.diff(small, axis=1) > 1e-9).tobytes().hex()


def npy_tile(tile: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, np.ascontiguousarray(tile), allow_pickle=False)
    return out.getvalue()


def decode(data: bytes | None) -> np.ndarray | None:
    """The array of a Netpbm or BMP file; None if it is damaged or neither."""
    try:
        return decode_bmp(data) if data and data[:2] == b"BM" else decode_netpbm(data or b"")
    except (ValueError, OverflowError, MemoryError):
        return None


def decode_table(files: DataFrame, id_col: str, data_col: str, tile: int = 64) -> DataFrame:
    """Tiles of every file: id, row, col, height, width, npy (binary, tile * tile after resizing to whole tiles), dhash of the picture."""
    small_batches(files.sparkSession, 16)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, data in zip(batch["id"], batch["data"]):
                image = decode(data)
                if image is None:
                    yield pd.DataFrame({"id": [key], "row": [0], "col": [0], "height": [0], "width": [0], "npy": [None], "dhash": [None]})
                    continue
                down, across = (-(-n // tile) for n in image.shape[:2])
                sized = np.rint(area_resize(image, down * tile, across * tile)).astype(image.dtype)
                dhash = difference_hash(image)
                rows = [
                    (key, r, c, *image.shape[:2], npy_tile(sized[r * tile : (r + 1) * tile, c * tile : (c + 1) * tile]), dhash)
                    for r in range(down)
                    for c in range(across)
                ]
                yield pd.DataFrame(rows, columns=["id", "row", "col", "height", "width", "npy", "dhash"])

    kind = dict(files.dtypes)[id_col]
    slim = files.select(F.col(id_col).alias("id"), F.col(data_col).alias("data"))
    return slim.mapInPandas(run, f"id {kind}, row int, col int, height int, width int, npy binary, dhash string")


def media_file(text: str | None) -> tuple[int, bytes]:
    """The size of a text in UTF-8, and the picture file of its padded bytes."""
    raw = (text or "").encode("utf-8", "replace")
    blocks = max(1, -(-len(raw) // BLOCK))
    picture = np.frombuffer(raw.ljust(blocks * BLOCK, PAD), np.uint8).reshape(-1, WIDTH)
    return len(raw), encode_bmp(picture) if blocks % 2 == 0 else encode_pgm(picture)


def cut_tiles(image: np.ndarray, side: int) -> np.ndarray:
    """The tiles (number, side, side) of a picture of whole tiles, row by row; of several channels the first."""
    height, width = image.shape[:2]
    return image[..., 0].reshape(height // side, side, width // side, side).swapaxes(1, 2).reshape(-1, side, side)


def media_table(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media (binary), dhash: every text's picture file, decoded and stored as NPY tiles, with the picture's difference hash. To be written."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                n, data = media_file(text)
                image = decode(data)
                out.append((doc_id, n, npy_tile(cut_tiles(image, WIDTH)), difference_hash(image[..., :1])))
            yield pd.DataFrame(out, columns=["doc_id", "n_bytes", "media", "dhash"])

    rows = docs.select(held_id("doc_id").alias("doc_id"), F.col("text").cast("string")).mapInPandas(run, "doc_id long, n_bytes long, media binary, dhash string")
    return rows.withColumn("doc_id", given_id("doc_id"))


def media_digests(media: DataFrame) -> DataFrame:
    """Of each row of media (doc_id, n_bytes, media, dhash), digests of the payload as read back from its NPY bytes and of those bytes, and the feature: difference hash of the picture, and of its tiles' means."""
    small_batches(media.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, n, data, dhash in zip(batch["doc_id"], batch["n_bytes"], batch["media"], batch["dhash"]):
                tiles = np.load(io.BytesIO(data), allow_pickle=False)
                payload = tiles.tobytes()
                feature = dhash + difference_hash(tiles.mean(axis=0)[..., None])
                rows.append((doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature))
            columns = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            yield pd.DataFrame(rows, columns=columns)

    shape = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return media.select(held_id("doc_id").alias("doc_id"), "n_bytes", "media", "dhash").mapInPandas(run, shape).withColumn("doc_id", given_id("doc_id"))


def media_documents(docs: DataFrame) -> DataFrame:
    """The digests of every row of docs (doc_id, text), read back from a written table of NPY tiles."""
    return media_digests(written(media_table(docs), "media-tiles"))

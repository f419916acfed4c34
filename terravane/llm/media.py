"""Media columns: Netpbm and BMP decoded to numpy arrays, area-resized by integral images, kept as
NPY tiles with difference hashes."""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Payloads become RGB pictures of this width, so a row of samples takes WIDTH * 3 bytes.
WIDTH, CHANNELS = 64, 3
ROW = WIDTH * CHANNELS
#: Rows of pixels in an NPY tile.
TILE_ROWS = 1024


class MediaError(ValueError):
    """Bytes that are no picture of a known kind, or are cut short."""


def decode_netpbm(raw: bytes) -> np.ndarray:
    """P1 to P6 as (height, width, channels); samples over 255 give uint16."""
    kind = raw[:2]
    if not re.fullmatch(rb"P[1-6]", kind):
        raise MediaError("not a Netpbm file")
    at, fields = 2, []
    while len(fields) < (2 if kind in (b"P1", b"P4") else 3):
        m = re.compile(rb"(?:\s|#[^\n\r]*)*(\d+)").match(raw, at)
        if not m:
            raise MediaError("Netpbm header is cut short")
        fields.append(int(m[1]))
        at = m.end()
    width, height, top = *fields[:2], fields[2] if len(fields) > 2 else 1
    channels = 3 if kind in (b"P3", b"P6") else 1
    n = width * height * channels
    if not 0 < top < 65536:
        raise MediaError("Netpbm maximum is out of range")
    if kind in (b"P1", b"P2", b"P3"):
        body = re.sub(rb"#[^\n\r]*", b" ", raw[at:])
        values = np.array(re.findall(rb"[01]" if kind == b"P1" else rb"\d+", body)[:n], np.int64)
        if len(values) < n:
            raise MediaError("Netpbm samples are cut short")
        out = values.astype(np.uint8 if top < 256 else np.uint16)
    elif kind == b"P4":
        stride = (width + 7) // 8
        bits = np.frombuffer(raw, np.uint8, offset=at + 1)[: stride * height]
        if len(bits) < stride * height:
            raise MediaError("Netpbm samples are cut short")
        out = np.unpackbits(bits.reshape(height, stride), axis=1)[:, :width].reshape(-1)
    else:
        kind_of = np.dtype(np.uint8 if top < 256 else ">u2")
        if len(raw) < at + 1 + n * kind_of.itemsize:
            raise MediaError("Netpbm samples are cut short")
        out = np.frombuffer(raw, kind_of, n, at + 1).astype(kind_of.newbyteorder("="))
    if kind in (b"P1", b"P4"):  # 1 is black
        out = (1 - out) * 255
    return out.reshape(height, width, channels)


def encode_ppm(pixels: np.ndarray) -> bytes:
    height, width, _ = pixels.shape
    return b"P6\n%d %d\n255\n" % (width, height) + np.ascontiguousarray(pixels, np.uint8).tobytes()


def decode_bmp(raw: bytes) -> np.ndarray:
    """Uncompressed BMP of 1, 4, 8, 24 or 32 bits as (height, width, 3), RGB."""
    if raw[:2] != b"BM" or len(raw) < 54:
        raise MediaError("not a BMP file")
    start, header = struct.unpack_from("<II", raw, 10)
    width, height, _, bits, packed = struct.unpack_from("<iiHHI", raw, 18)
    used = struct.unpack_from("<I", raw, 46)[0]
    if packed not in (0, 3) or bits not in (1, 4, 8, 24, 32) or width <= 0 or height == 0 or (packed == 3 and bits != 32):
        raise MediaError("BMP of an unknown kind")
    rows, stride = abs(height), (width * bits + 31) // 32 * 4
    if len(raw) < start + stride * rows:
        raise MediaError("BMP samples are cut short")
    lines = np.frombuffer(raw, np.uint8, stride * rows, start).reshape(rows, stride)
    if height > 0:
        lines = lines[::-1]
    if bits >= 24:
        return lines[:, : width * bits // 8].reshape(rows, width, bits // 8)[:, :, 2::-1].copy()
    palette = np.frombuffer(raw, np.uint8, 4 * (used or 1 << bits), 14 + header).reshape(-1, 4)[:, 2::-1]
    index = lines if bits == 8 else np.unpackbits(lines, axis=1) if bits == 1 else np.stack([lines >> 4, lines & 15], 2).reshape(rows, -1)
    index = index[:, :width]
    if index.size and index.max() >= len(palette):
        raise MediaError("BMP index beyond its palette")
    return palette[index]


def encode_bmp(pixels: np.ndarray) -> bytes:
    height, width, _ = pixels.shape
    stride = (width * 3 + 3) // 4 * 4
    lines = np.zeros((height, stride), np.uint8)
    lines[:, : width * 3] = np.asarray(pixels, np.uint8)[::-1, :, ::-1].reshape(height, -1)
    size = stride * height
    return b"BM" + struct.pack("<IIIIiiHHIIiiII", 54 + size, 0, 54, 40, width, height, 1, 24, 0, size, 2835, 2835, 0, 0) + lines.tobytes()


def decode(raw: bytes) -> np.ndarray:
    return decode_bmp(raw) if raw[:2] == b"BM" else decode_netpbm(raw)


def area_resize(gray: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean over each target cell, its borders weighted by area: differences of an integral image."""
    rows, cols = gray.shape
    integral = np.zeros((rows + 1, cols + 1))
    np.cumsum(np.cumsum(gray, 0, dtype=np.float64), 1, out=integral[1:, 1:])

    def at(edges: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        low = np.minimum(edges.astype(np.int64), n - 1)
        return low, edges - low

    y, fy = at(np.arange(height + 1) * rows / height, rows)
    x, fx = at(np.arange(width + 1) * cols / width, cols)
    lines = integral[y] * (1 - fy)[:, None] + integral[y + 1] * fy[:, None]
    points = lines[:, x] * (1 - fx) + lines[:, x + 1] * fx
    cells = np.diff(np.diff(points, axis=0), axis=1)
    return cells / (rows / height * cols / width)


def difference_hash(pixels: np.ndarray) -> str:
    """64 bits as hexadecimal: is each of 8 x 9 resized cells darker than its right neighbour."""
    gray = pixels.astype(np.float64).mean(axis=2) if pixels.shape[2] > 1 else pixels[:, :, 0].astype(np.float64)
    small = np.rint(area_resize(gray, 8, 9) * 256)
    return np.packbits(small[:, :-1] < small[:, 1:]).tobytes().hex()


def npy_tiles(pixels: np.ndarray, rows: int = TILE_ROWS) -> bytes:
    """Tiles of `rows` rows of pixels, each a whole NPY file, one after another."""
    out = io.BytesIO()
    for at in range(0, max(1, len(pixels)), rows):
        np.lib.format.write_array(out, np.ascontiguousarray(pixels[at : at + rows]), version=(1, 0), allow_pickle=False)
    return out.getvalue()


def read_tiles(raw: bytes) -> np.ndarray:
    source, tiles = io.BytesIO(raw), []
    while source.tell() < len(raw):
        tiles.append(np.lib.format.read_array(source, allow_pickle=False))
    return np.concatenate(tiles)


def payload_picture(payload: bytes) -> bytes:
    """A P6 file whose samples are the bytes, padded with blanks to whole rows, one at least."""
    n = max(ROW, -(-len(payload) // ROW) * ROW)
    return b"P6\n%d %d\n255\n" % (WIDTH, n // ROW) + payload.ljust(n, b" ")


def media_columns(pictures: DataFrame, key: str, media: str) -> DataFrame:
    """(key, tiles binary, height, width, channels, dhash, error) of encoded pictures.

    A null picture has nulls; one that can't be read has its error and nulls. Repeated rows give
    repeated results.
    """
    common.small_batches(pictures.sparkSession, 500)

    def run(batches):
        for batch in batches:
            out = []
            for raw in batch.column(1).to_pylist():
                try:
                    if raw is None:
                        out.append((None,) * 6)
                        continue
                    pixels = decode(raw)
                    if pixels.size == 0:
                        raise MediaError("a picture without pixels")
                    out.append((npy_tiles(pixels), *pixels.shape, difference_hash(pixels), None))
                except (MediaError, struct.error, ValueError) as e:
                    out.append((None, None, None, None, None, str(e)))
            cols = list(zip(*out)) if out else [()] * 6
            kinds = [pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], ["key", "tiles", "height", "width", "channels", "dhash", "error"])

    kind = pictures.select(key).schema[0].dataType.simpleString()
    return pictures.select(key, media).mapInArrow(run, f"key {kind}, tiles binary, height int, width int, channels int, dhash string, error string").withColumnRenamed("key", key)


def text_media_digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256,
    feature) of texts stored as pictures.

    A text's bytes (null: none) are padded with blanks to a positive multiple of 192 and become the
    samples of a 64-pixel-wide picture; it is decoded, stored as NPY tiles and read back from those
    bytes, from which all else is computed. Equal texts have equal values.
    """
    common.small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            data, off = common.text_view(batch.column(1))
            whole = memoryview(data)
            rows = []
            for a, b in zip(off[:-1], off[1:]):
                stored = npy_tiles(decode_netpbm(payload_picture(bytes(whole[a:b]))))
                pixels = read_tiles(stored)
                payload = pixels.tobytes()
                rows.append((b - a, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), difference_hash(pixels)))
            cols = list(zip(*rows)) if rows else [()] * 7
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], names)

    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    return docs.select("doc_id", F.col("text")).mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")

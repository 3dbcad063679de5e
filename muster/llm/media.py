"""Media columns: Netpbm and BMP images to NPY tiles with difference hashes."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from muster.llm.common import batches, sha256_hex, stage_small

TILE = 64
ROW_PIXELS = 64
UNIT = 3 * ROW_PIXELS  # bytes of an image row that carries text
PAD = b" "


# Decoding


def decode_image(data: bytes) -> np.ndarray:
    """Height x width x channels of an image; 16-bit samples stay 16-bit.

    Netpbm P1 to P6 and uncompressed BMP of 1, 4, 8, 24 and 32 bits, rows in either order.
    Anything else raises ValueError.
    """
    if data[:1] == b"P" and data[1:2] in b"123456" and len(data) > 2:
        return _netpbm(data)
    if data[:2] == b"BM":
        return _bmp(data)
    raise ValueError("neither Netpbm nor BMP")


def _header(data: bytes, fields: int) -> tuple[list[int], int]:
    """Whole numbers after the magic, past comments, and where the raster begins."""
    numbers, at = [], 2
    while len(numbers) < fields:
        while data[at : at + 1].isspace() or data[at : at + 1] == b"#":
            at = data.index(b"\n", at) + 1 if data[at : at + 1] == b"#" else at + 1
        start = at
        while data[at : at + 1].isdigit():
            at += 1
        if at == start:
            raise ValueError("bad Netpbm header")
        numbers.append(int(data[start:at]))
    return numbers, at + 1


def _netpbm(data: bytes) -> np.ndarray:
    kind = data[1] - ord("0")
    bitmap = kind in (1, 4)
    (width, height, *rest), at = _header(data, 2 if bitmap else 3)
    top = rest[0] if rest else 1
    channels = 3 if kind in (3, 6) else 1
    count = width * height * channels
    if kind == 1:
        digits = np.frombuffer(bytes(c for c in data[at - 1 :] if c in b"01"), dtype=np.uint8)[:count] - ord("0")
        raster = (1 - digits) * 255
    elif kind in (2, 3):
        raster = np.array(data[at - 1 :].split()[:count], dtype=np.uint16 if top > 255 else np.uint8)
    elif kind == 4:
        stride = (width + 7) // 8
        rows = np.frombuffer(data, np.uint8, stride * height, at).reshape(height, stride)
        raster = (1 - np.unpackbits(rows, axis=1)[:, :width]) * 255
    else:
        raster = np.frombuffer(data, ">u2" if top > 255 else np.uint8, count, at)
        raster = raster.astype(np.uint16) if top > 255 else raster
    if raster.size < count:
        raise ValueError("truncated Netpbm raster")
    return raster.reshape(height, width, channels)


def _bmp(data: bytes) -> np.ndarray:
    (at,) = struct.unpack_from("<I", data, 10)
    size, width, height, _, bits, packed = struct.unpack_from("<IiiHHI", data, 14)
    if packed not in (0, 3) or bits not in (1, 4, 8, 24, 32):
        raise ValueError(f"BMP of {bits} bits with compression {packed}")
    stride = (width * bits + 31) // 32 * 4
    rows = np.frombuffer(data, np.uint8, stride * abs(height), at).reshape(abs(height), stride)
    if height > 0:
        rows = rows[::-1]
    if bits >= 24:
        pixels = rows[:, : width * bits // 8].reshape(abs(height), width, bits // 8)
        return np.ascontiguousarray(pixels[:, :, 2::-1])
    colours = struct.unpack_from("<I", data, 46)[0] or 1 << bits
    palette = np.frombuffer(data, np.uint8, colours * 4, 14 + size).reshape(-1, 4)[:, 2::-1]
    if bits == 8:
        index = rows[:, :width]
    else:
        per = 8 // bits
        shifts = np.arange(per - 1, -1, -1) * bits
        index = ((rows[:, :, None] >> shifts) & ((1 << bits) - 1)).reshape(abs(height), -1)[:, :width]
    return palette[index]


def encode_ppm(pixels: np.ndarray) -> bytes:
    height, width, _ = pixels.shape
    return b"P6\n%d %d\n255\n" % (width, height) + pixels.tobytes()


def encode_bmp(pixels: np.ndarray) -> bytes:
    """24-bit BMP, rows from the bottom up."""
    height, width, _ = pixels.shape
    stride = (width * 24 + 31) // 32 * 4
    rows = np.zeros((height, stride), dtype=np.uint8)
    rows[:, : width * 3] = pixels[::-1, :, ::-1].reshape(height, width * 3)
    info = struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, rows.size, 0, 0, 0, 0)
    return b"BM" + struct.pack("<IHHI", 54 + rows.size, 0, 0, 54) + info + rows.tobytes()


# Resizing and hashing


def _edges(length: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Whole and fractional parts of the borders that cut ``length`` into equal parts."""
    position = np.arange(parts + 1) * length
    return position // parts, (position % parts) / parts


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """The mean of each of height x width equal areas, from an integral image.

    The integral is read between its whole positions by interpolation, which is exact
    for areas that cut through pixels.
    """
    sums = np.zeros((image.shape[0] + 1, image.shape[1] + 1), dtype=np.float64)
    np.cumsum(np.cumsum(image, axis=0, dtype=np.float64), axis=1, out=sums[1:, 1:])
    y, dy = _edges(image.shape[0], height)
    x, dx = _edges(image.shape[1], width)
    after_y, after_x = np.minimum(y + 1, image.shape[0]), np.minimum(x + 1, image.shape[1])
    rows = sums[y] * (1 - dy)[:, None] + sums[after_y] * dy[:, None]
    grid = rows[:, x] * (1 - dx) + rows[:, after_x] * dx
    areas = grid[1:, 1:] - grid[:-1, 1:] - grid[1:, :-1] + grid[:-1, :-1]
    return areas / (image.shape[0] * image.shape[1] / (height * width))


def difference_hash(image: np.ndarray) -> str:
    """64 bits: whether each of 8 x 8 areas is darker than the one to its right."""
    if image.size == 0:
        return "0" * 16
    grey = image[:, :, 0] if image.shape[2] == 1 else image[:, :, :3] @ np.array([299, 587, 114], dtype=np.int64)
    small = np.round(area_resize(grey, 8, 9), 6)
    return np.packbits(small[:, :-1] < small[:, 1:]).tobytes().hex()


# Tiles


@lru_cache(maxsize=4096)
def _npy_header(shape: tuple[int, ...], kind: str) -> bytes:
    """The NPY 1.0 header of a C-ordered array."""
    text = f"{{'descr': '{kind}', 'fortran_order': False, 'shape': {shape}, }}"
    pad = -(10 + len(text) + 1) % 64
    return b"\x93NUMPY\x01\x00" + struct.pack("<H", len(text) + pad + 1) + text.encode() + b" " * pad + b"\n"


def to_npy(array: np.ndarray) -> bytes:
    array = np.ascontiguousarray(array, dtype=array.dtype.newbyteorder("<"))
    return _npy_header(array.shape, array.dtype.str) + array.tobytes()


def from_npy(data: bytes) -> np.ndarray:
    (length,) = struct.unpack_from("<H", data, 8)
    kind, shape = _parse_header(data[10 : 10 + length])
    return np.frombuffer(data, dtype=kind, offset=10 + length).reshape(shape)


@lru_cache(maxsize=4096)
def _parse_header(text: bytes) -> tuple[str, tuple[int, ...]]:
    from ast import literal_eval

    spec = literal_eval(text.decode().strip())
    if spec["fortran_order"]:
        raise ValueError("tiles are stored in C order")
    return spec["descr"], spec["shape"]


def tiles(image: np.ndarray, size: int = TILE) -> list[bytes]:
    """NPY tiles from left to right and from top to bottom."""
    height, width, _ = image.shape
    return [
        to_npy(image[y : y + size, x : x + size]) for y in range(0, height, size) for x in range(0, width, size)
    ]


def untile(stored: list[bytes], width: int, size: int = TILE) -> np.ndarray:
    across = max(1, -(-width // size))
    parts = [from_npy(t) for t in stored]
    rows = [parts[i] if across == 1 else np.concatenate(parts[i : i + across], axis=1) for i in range(0, len(parts), across)]
    return np.concatenate(rows, axis=0)


def tile_media(rows: DataFrame, key: str, media: str, *, size: int = TILE) -> DataFrame:
    """Images in a binary column to ``(key, height, width, channels, tiles, dhash, error)``.

    A null image, or one that cannot be decoded, gives no tiles and says why in ``error``
    (null for a null image). One row in, one row out; nothing is shuffled.
    """
    kind = dict(rows.dtypes)[key]

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source, 64):
            out = [_tiled(m, size) for m in batch.column(1).to_pylist()]
            columns = list(zip(*out, strict=True))
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.binary()), pa.string(), pa.string()]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *arrays], names=[key, "height", "width", "channels", "tiles", "dhash", "error"]
            )

    return rows.select(F.col(key), F.col(media)).mapInArrow(
        run, f"`{key}` {kind}, height int, width int, channels int, tiles array<binary>, dhash string, error string"
    )


def _tiled(data: bytes | None, size: int) -> tuple:
    if data is None:
        return None, None, None, None, None, None
    try:
        image = decode_image(data)
    except (ValueError, IndexError, struct.error) as problem:
        return None, None, None, None, None, str(problem)[:200]
    return (*image.shape, tiles(image, size), difference_hash(image), None)


# Texts as media


def text_media(rows: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, n_bytes, media)``: UTF-8 bytes, padded with spaces, as rows of 64 RGB pixels.

    Images with an odd number of rows are Netpbm, the others BMP. A null text is empty, and
    an empty one is a row of spaces.
    """
    kind = dict(rows.dtypes)[key]

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source, 256):
            sizes, media = [], []
            for value in batch.column(1).to_pylist():
                data = (value or "").encode("utf-8")
                sizes.append(len(data))
                payload = data + PAD * (-len(data) % UNIT) or PAD * UNIT
                pixels = np.frombuffer(payload, dtype=np.uint8).reshape(-1, ROW_PIXELS, 3)
                media.append(encode_ppm(pixels) if len(pixels) % 2 else encode_bmp(pixels))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=[key, "n_bytes", "media"]
            )

    return rows.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, n_bytes bigint, media binary")


def stored_text_features(rows: DataFrame, key: str, text: str) -> DataFrame:
    """Write texts as tiled media, read the tiles back, and describe what was read.

    The tiles are a written table, one row a text, so reading them back needs no shuffle.
    """
    kind = dict(rows.dtypes)[key]
    media = text_media(rows, key, text)
    # the size travels in the key, so that tiling stays one narrow pass
    packed = media.select(F.struct(F.col(key).alias("key"), "n_bytes").alias("at"), "media")
    stored = stage_small(tile_media(packed, "at", "media"), "media-tiles")
    flat = stored.select(F.col("at.key").alias(key), F.col("at.n_bytes").alias("n_bytes"), "width", "tiles")

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source, 64):
            out = [_described(w, t) for w, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            columns = list(zip(*out, strict=True))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], names=names)

    names = [key, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    return flat.mapInArrow(
        run,
        f"`{key}` {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, "
        "media_bytes bigint, media_sha256 string, feature string",
    )


def _described(width: int, stored: list[bytes]) -> tuple:
    image = untile(stored, width)
    payload = image.tobytes()
    digest = hashlib.sha256()
    for tile in stored:
        digest.update(tile)
    return (
        len(payload), sha256_hex(payload), zlib.crc32(payload[-16:]),
        sum(map(len, stored)), digest.hexdigest(), difference_hash(image),
    )

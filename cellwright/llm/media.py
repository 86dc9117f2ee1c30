"""Media columns: Netpbm and BMP images to arrays, area resizing, NPY tiles, difference hashes.

``decode`` reads PBM, PGM and PPM (plain and raw) and uncompressed BMP (1, 4, 8, 24 and 32 bits).
``area_resize`` averages over exact, fractional areas by integral images, a band of rows at a time.
``write_npy`` and ``read_npy`` store an array as one NPY tile; ``tiles`` cuts an image into several.
``dhash`` compares horizontal neighbours of a 9 x 8 thumbnail: 64 bits.

``media_features`` applies them to images in a binary column and ``text_media`` to texts taken as grey
images 64 samples wide: a text's UTF-8 bytes are padded with 0 to a positive multiple of 64, written
as raw PGM, decoded, stored as NPY, and read back for all features.  Null texts count as
empty; equal texts have equal values; an empty table gives an empty result.  An image that can't be
decoded gives null features and its error.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import sub_batches, text_bytes

WIDTH = 64
#: Rows of an image that the integral image covers at a time.
BAND = 1 << 14
#: Fixed value: a sane limit on the samples of one image.
MOST_SAMPLES = 1 << 31


class MediaError(ValueError):
    pass


# --- decoding ------------------------------------------------------------------------------------


def _netpbm_header(data: bytes, n: int) -> tuple[list[int], int]:
    """n decimal fields after the magic number, comments skipped, and where the samples begin."""
    at, out = 2, []
    for _ in range(n):
        m = re.compile(rb"(?:\s|#[^\r\n]*[\r\n])*(\d{1,10})").match(data, at)
        if not m:
            raise MediaError("bad Netpbm header")
        out.append(int(m[1]))
        at = m.end()
    return out, at


def decode_netpbm(data: bytes) -> np.ndarray:
    """(height, width) or (height, width, 3) of uint8 or, beyond 255, uint16."""
    kind = data[:2]
    if kind not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        raise MediaError("not Netpbm")
    bits = kind in (b"P1", b"P4")
    head, at = _netpbm_header(data, 2 if bits else 3)
    w, h, top = head[0], head[1], 1 if bits else head[2]
    depth = 3 if kind in (b"P3", b"P6") else 1
    if not (w and h and 0 < top < 65536) or w * h * depth > MOST_SAMPLES:
        raise MediaError("bad Netpbm size")
    if kind == b"P1":
        plain = re.sub(rb"#[^\r\n]*|\s+", b"", data[at:])
        a = np.frombuffer(plain[: w * h], np.uint8) - 48
        if len(a) < w * h or (a > 1).any():
            raise MediaError("bad samples")
        return ((1 - a) * 255).astype(np.uint8).reshape(h, w)
    if kind in (b"P2", b"P3"):
        fields = re.sub(rb"#[^\r\n]*", b"", data[at:]).split()[: w * h * depth]
        if len(fields) < w * h * depth:
            raise MediaError("too few samples")
        if any(not f.isdigit() or len(f) > 10 for f in fields):
            raise MediaError("bad samples")
        a = np.array([int(f) for f in fields], dtype=np.int64)
    else:
        at += 1  # one blank ends the header
        if kind == b"P4":
            row = (w + 7) // 8
            if len(data) - at < row * h:
                raise MediaError("too few samples")
            raw = np.frombuffer(data, np.uint8, offset=at)
            return ((1 - np.unpackbits(raw[: row * h].reshape(h, row), axis=1)[:, :w]) * 255).astype(np.uint8)
        kind_of = np.dtype(">u2") if top > 255 else np.dtype("u1")
        if len(data) - at < w * h * depth * kind_of.itemsize:
            raise MediaError("too few samples")
        a = np.frombuffer(data, kind_of, count=w * h * depth, offset=at)
    if len(a) and int(a.max()) > top:
        raise MediaError("a sample beyond the maximum")
    a = a.astype(np.uint16 if top > 255 else np.uint8)
    return a.reshape((h, w, 3) if depth == 3 else (h, w))


def _masked(pixels: np.ndarray, masks: tuple[int, int, int]) -> np.ndarray:
    """Red, green and blue as the bits that each mask has in a row, scaled to 8 bits."""
    out = np.zeros((*pixels.shape, 3), np.uint8)
    for i, mask in enumerate(masks):
        low = (mask & -mask).bit_length() - 1
        top = mask >> max(low, 0)
        if not mask or top & (top + 1):
            raise MediaError("bad colour masks")
        out[..., i] = np.rint(((pixels & np.uint32(mask)) >> np.uint32(low)).astype(np.float64) * (255 / top))
    return out


def decode_bmp(data: bytes) -> np.ndarray:
    """(height, width, 3) of uint8, or (height, width) where the palette is grey."""
    if data[:2] != b"BM" or len(data) < 54:
        raise MediaError("not BMP")
    start, header = struct.unpack_from("<II", data, 10)
    if header < 40 or start < 54:
        raise MediaError("unsupported BMP header")
    w, h, planes, bits, packed = struct.unpack_from("<iiHHI", data, 18)
    colours = struct.unpack_from("<I", data, 46)[0]
    down, h = h < 0, abs(h)
    if w <= 0 or not h or planes != 1 or bits not in (1, 4, 8, 24, 32) or packed not in (0, 3) or (packed == 3 and bits != 32) or w * h > MOST_SAMPLES:
        raise MediaError("unsupported BMP")
    row = (w * bits + 31) // 32 * 4
    if len(data) < start + row * h:
        raise MediaError("too few samples")
    raw = np.frombuffer(data, np.uint8, count=row * h, offset=start).reshape(h, row)
    if not down:
        raw = raw[::-1]
    if packed == 3:
        if len(data) < 66:
            raise MediaError("no colour masks")
        return _masked(raw[:, : w * 4].copy().view("<u4"), struct.unpack_from("<III", data, 54))
    if bits >= 24:
        step = bits // 8
        return np.ascontiguousarray(raw[:, : w * step].reshape(h, w, step)[:, :, 2::-1])
    n = colours or 1 << bits
    at = 14 + header
    if n > 1 << bits or at + 4 * n > len(data):
        raise MediaError("bad palette")
    palette = np.frombuffer(data, np.uint8, count=4 * n, offset=at).reshape(n, 4)[:, 2::-1]
    index = raw if bits == 8 else np.unpackbits(raw, axis=1) if bits == 1 else np.stack([raw >> 4, raw & 15], 2).reshape(h, -1)
    index = index[:, :w]
    if int(index.max()) >= n:
        raise MediaError("a colour beyond the palette")
    out = palette[index]
    return np.ascontiguousarray(out[:, :, 0]) if (palette[:, 0] == palette[:, 1]).all() and (palette[:, 1] == palette[:, 2]).all() else out


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def encode_pgm(samples: bytes, width: int = WIDTH) -> bytes:
    return b"P5\n%d %d\n255\n" % (width, len(samples) // width) + samples


# --- resizing and hashing ------------------------------------------------------------------------


def grey(a: np.ndarray) -> np.ndarray:
    return a if a.ndim == 2 else (a[..., 0] * 0.299 + a[..., 1] * 0.587 + a[..., 2] * 0.114)


def _at(integral: np.ndarray, where: np.ndarray) -> np.ndarray:
    """Rows of an integral image at fractional places, by linear interpolation."""
    low = np.minimum(where.astype(np.int64), len(integral) - 2)
    part = (where - low).reshape(-1, *[1] * (integral.ndim - 1))
    return integral[low] * (1 - part) + integral[low + 1] * part


def area_resize(a: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means over the (fractional) area of each target sample, as float64."""
    h, w = a.shape[:2]
    xs, ys = np.arange(width + 1) * (w / width), np.arange(height + 1) * (h / height)
    cum = np.zeros((height + 1, width))  # sums above each horizontal edge, by column of the target
    above = np.zeros(width)
    for top in range(0, h, BAND):
        band = a[top : top + BAND].astype(np.float64)
        integral = np.zeros((len(band) + 1, w + 1))
        np.cumsum(np.cumsum(band, axis=0), axis=1, out=integral[1:, 1:])
        columns = np.diff(_at(integral.T, xs), axis=0).T
        here = (ys > top) & (ys <= top + len(band))
        if here.any():
            cum[here] = above + _at(columns, ys[here] - top)
        above = above + columns[-1]
    return np.diff(cum, axis=0) / ((w / width) * (h / height))


def dhash(a: np.ndarray) -> str:
    small = area_resize(grey(a), 8, 9)
    # differences below rounding noise count as equal
    return np.packbits((np.diff(small, axis=1) > 1e-9).ravel()).tobytes().hex()


# --- NPY -----------------------------------------------------------------------------------------


def write_npy(a: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.lib.format.write_array(out, np.ascontiguousarray(a), version=(1, 0), allow_pickle=False)
    return out.getvalue()


def read_npy(data: bytes) -> np.ndarray:
    return np.lib.format.read_array(io.BytesIO(data), allow_pickle=False)


def tiles(a: np.ndarray, size: int = 256) -> Iterator[tuple[int, int, bytes]]:
    """(tile row, tile column, NPY bytes); tiles at the right and lower edge may be smaller."""
    for y in range(0, a.shape[0], size):
        for x in range(0, a.shape[1], size):
            yield y // size, x // size, write_npy(a[y : y + size, x : x + size])


# --- columns -------------------------------------------------------------------------------------


def media_features(images: DataFrame, id_column: str = "doc_id", content: str = "content", side: int = 64) -> DataFrame:
    """height, width, a resized NPY tile, its hash and any error of each image in a binary column."""
    kind = images.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            for value in batch.column(1).to_pylist():
                try:
                    a = decode(value or b"")
                    row = [a.shape[0], a.shape[1], write_npy(np.rint(area_resize(grey(a), side, side)).astype(np.uint16 if a.dtype == np.uint16 else np.uint8)), dhash(a), None]
                except MediaError as e:
                    row = [None, None, None, None, str(e)]
                for column, v in zip(rows, row, strict=True):
                    column.append(v)
            kinds = (pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.string())
            columns = [pa.array(r, t) for r, t in zip(rows, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[id_column, "height", "width", "tile", "dhash", "error"])

    return images.select(id_column, content).mapInArrow(run, f"`{id_column}` {kind}, height int, width int, tile binary, dhash string, error string")


def store_text(raw: bytes) -> tuple[bytes, bytes]:
    """The padded payload's NPY form and the payload as read back from it."""
    payload = raw + b"\0" * ((-len(raw)) % WIDTH or (0 if raw else WIDTH))
    stored = write_npy(decode_netpbm(encode_pgm(payload)))
    return stored, payload


def text_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sub_batches(batches, "text"):
            data, off = text_bytes(batch.column(1))
            raw, off = data.tobytes(), off.tolist()
            rows = []
            for i in range(len(off) - 1):
                stored, _ = store_text(raw[off[i] : off[i + 1]])
                a = read_npy(stored)
                back = a.tobytes()
                rows.append((off[i + 1] - off[i], len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), dhash(a)))
            columns = list(zip(*rows, strict=True))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]], names=NAMES)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


NAMES = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

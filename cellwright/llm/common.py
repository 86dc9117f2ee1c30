"""Helpers that several corpus operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.scratch import new_path

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Word characters: ASCII digits and lower-case letters, and all beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What lies between words.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bucketed(df: DataFrame, key: str, label: str) -> tuple[DataFrame, str]:
    """As ``materialize``, dealt and sorted by ``key``, so that joins by it need not deal these rows again; and the table's name, to drop."""
    spark = df.sparkSession
    path = new_path(spark, label)
    name = path.rpartition("/")[2].replace("-", "_")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.format("parquet").option("path", path).bucketBy(n, key).sortBy(key).saveAsTable(name)
    return spark.table(name), name


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def words(text: Column) -> Column:
    """Lower-cased words of a text as an array; null has none."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), GAP), "")


# --- numpy side: whole Arrow batches of texts at once -------------------------------------------

_rng = np.random.RandomState(20240229)
#: A random odd multiplier and a random value for each byte value.
BYTE_VALUE = _rng.randint(1, 2**63 - 1, 256, dtype=np.int64).astype(np.uint64)
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.zeros(256, dtype=bool)
IS_WORD[48:58] = IS_WORD[97:123] = True
IS_WORD[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit values."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_POW = [powers(1 << 16, BASE), powers(1 << 16, BASE_INV)]


def _pow(n: int, which: int) -> np.ndarray:
    if len(_POW[which]) < n:
        _POW[which] = powers(n, (BASE, BASE_INV)[which])
    return _POW[which][:n]


def prefix_hash(codes: np.ndarray) -> np.ndarray:
    """Prefix sums of code * BASE^i, one longer than the input; see ``span_hash``."""
    out = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum(codes * _pow(len(codes), 0), dtype=np.uint64, out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Position-independent hashes of the spans [start, end)."""
    return mix((prefix[end] - prefix[start]) * _pow(len(prefix), 1)[start])


def span_hashes(codes: np.ndarray, length: int) -> np.ndarray:
    """``span_hash`` of all spans of ``length`` values, from the first to the last; ``codes`` is overwritten."""
    n = max(len(codes) - length + 1, 0)
    codes *= _pow(len(codes), 0)
    prefix = np.cumsum(codes, dtype=np.uint64, out=codes)
    x = prefix[length - 1 :].copy()
    x[1:] -= prefix[: max(n - 1, 0)]
    x *= _pow(n, 1)
    # as ``mix``, in place
    t = x >> np.uint64(31)
    x ^= t
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= np.right_shift(x, np.uint64(27), out=t)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= np.right_shift(x, np.uint64(33), out=t)
    return x


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of a column as one byte array with n + 1 offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if pa.types.is_large_string(column.type) else column.cast(pa.binary())
    if column.null_count:
        column = column.fill_null(b"")
    wide = pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    n = len(column)
    if n == 0 or off is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offs = np.frombuffer(off, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, and start, end and document of each word; words end with their document."""
    low = LOWER[data]
    inside = np.zeros(len(low) + 2, dtype=np.int8)
    inside[1:-1] = IS_WORD[low]
    step = np.diff(inside)
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    # a word that runs over the end of a document is cut there
    cuts = np.unique(offsets[1:-1])
    cuts = cuts[(cuts > 0) & (cuts < len(low))]
    cuts = cuts[(inside[cuts] == 1) & (inside[cuts + 1] == 1)]
    if len(cuts):
        start, end = np.sort(np.concatenate([start, cuts])), np.sort(np.concatenate([end, cuts]))
    doc = np.searchsorted(offsets, start, side="right") - 1
    return low, start, end, doc


def give_back() -> None:
    """Returns freed memory to the system: a worker that waits for its next task should be small."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def sub_batches(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most ``most`` bytes of text each, or a single row."""
    try:
        yield from _sub_batches(batches, column, most)
    finally:
        give_back()


def _sub_batches(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = np.diff(text_bytes(batch.column(batch.schema.get_field_index(column)))[1])
        if not len(sizes):
            continue
        i, total = 0, 0
        for j, s in enumerate(sizes.tolist()):
            if total and total + s > most:
                yield batch.slice(i, j - i)
                i, total = j, 0
            total += s
        yield batch.slice(i)

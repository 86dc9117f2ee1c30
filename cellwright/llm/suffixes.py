"""Suffix-array dedup: removes bytes covered by 100-byte strings that start earlier in the corpus.

Order is by doc_id (null first), then by the text's digest where ids repeat, then by start.  Where ids are whole numbers and each
has one text, they are the documents' numbers; else rows of an id and a digest are numbered in that order.  All strings of
``WINDOW`` bytes that occur at several places keep their earliest place; every byte of the others is removed.

1. Anchors.  In each window the smallest hashed 32-byte substring (leftmost of equals) is its
   anchor; equal windows have equal anchors.  Consecutive windows with the same anchor make one
   piece.  Only pieces whose anchor occurs twice in the corpus go on.  Texts equal to an earlier one are
   all repeats from 100 bytes on; they don't take part, and don't make an anchor count as repeated.
2. Equal pieces are reduced to the earliest; all windows of the others are repeats.
3. What different pieces with the same anchor share is found by merging Burrows-Wheeler
   transforms: pieces are put into shards, the transform of each shard is made from its own suffix
   array, and an interleave of the shards' rows is refined until it is the order by ``WINDOW`` symbols.
   Boundaries that appear on the way mark where windows differ; windows alone between two are left out,
   those still in one block at the end are equal.  No suffixes of different shards are compared or sorted again.
4. The pieces of an anchor that has more than ``MOST_PIECES`` different ones are cut where the second smallest substring of their
   windows changes, and so on: anchors of two substrings, then of three.  Steps 2 and 3 settle those.  What is still that frequent
   with ``LEVELS`` substrings is cut into single windows, which step 2 settles.

Every step is a join or aggregation by hash; no task holds more than one bounded chunk of pieces.  Anchors that make up
more than a thousandth of all are dealt to ``SALTS`` tasks.  Ids, digests and repeated pieces are written when a plan is built.
Null texts are empty.  Rows repeated in id and text are one document: they remove nothing from one another
and get equal results.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..plans.fills import numbered
from ..plans.scratch import materialize, scratch
from .common import BYTE_VALUE, mix, span_hashes, sub_batches, text_bytes

WINDOW = 100
ANCHOR = 32
MOST_PIECES = 16_000
LEVELS = 4
#: Bytes of pieces that are merged at once, and shards they are dealt to.
CHUNK, SHARDS = 1 << 17, 8
#: Single windows are left out of a merge after each such number of symbols.
DROP = 8
#: Bytes of text that are hashed at once: few enough for a core's cache.
BLOCK = 1 << 16
#: Bits for the place in a batch, which is one text at least: Spark's strings have less than 2 GB.
_PLACE = 31
#: Tasks that an anchor is dealt to, if it is one of those that make up more than this share of all, and than so many rows.
SALTS, HOT, HOT_ROWS = 64, 0.001, 10_000


# --- anchors ---------------------------------------------------------------------------------------


def _hashes(data: np.ndarray, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the substring at each place, and with its lowest bits replaced by the place: of equals, the leftmost is the smallest."""
    h = span_hashes(BYTE_VALUE[data], anchor)
    low = h & ~np.uint64((1 << _PLACE) - 1)
    low |= np.arange(len(h), dtype=np.uint64)
    return h, low


def _smallest(low: np.ndarray, size: int) -> np.ndarray:
    """The smallest of each ``size`` neighbours."""
    width = 1
    while width * 2 <= size:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    return np.minimum(low[: len(low) - (size - width)], low[size - width :]) if width < size else low


def pieces_of(data: np.ndarray, offsets: np.ndarray, anchor: int = ANCHOR, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, first window and number of windows of each piece, in order."""
    if len(data) < window:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h, low = _hashes(data, anchor)
    low = _smallest(low, window - anchor + 1)
    edges = np.zeros(len(data) + 1, np.int8)
    long = np.flatnonzero(np.diff(offsets) >= window)
    np.add.at(edges, offsets[long], 1)
    np.add.at(edges, offsets[long + 1] - window + 1, -1)
    inside = np.cumsum(edges[: len(low)], dtype=np.int8).view(bool)
    new = np.append(0, np.flatnonzero((low[1:] != low[:-1]) | (inside[1:] != inside[:-1])) + 1)
    n, own = np.diff(np.append(new, len(low))), inside[new]
    start = new[own]
    return h[(low[start] & np.uint64((1 << _PLACE) - 1)).astype(np.int64)], start, n[own]


def anchors_of(windows: np.ndarray, anchor: int = ANCHOR) -> np.ndarray:
    """Anchor hash of each row of a table of windows."""
    count, window = windows.shape
    if not count:
        return np.zeros(0, np.uint64)
    h, low = (np.append(x, np.zeros(anchor - 1, np.uint64)).reshape(count, window)[:, : window - anchor + 1] for x in _hashes(windows.ravel(), anchor))
    place = (low.min(axis=1) & np.uint64((1 << _PLACE) - 1)).astype(np.int64) - np.arange(count) * window
    return h[np.arange(count), place]


def finer_pieces(data: np.ndarray, offsets: np.ndarray, level: int, anchor: int = ANCHOR, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Piece, hash, first window and number of windows of the parts of pieces whose windows have one ``level`` + 1 st smallest substring.

    All windows of a piece have the ``level`` smallest in common: they are those of its first window.
    """
    h, low = _hashes(data, anchor)
    size = window - anchor + 1
    first = offsets[:-1, None] + np.arange(size)
    smallest = np.argpartition(low[first], level - 1, axis=1)[:, :level]
    low[np.take_along_axis(first, smallest, axis=1)] |= ~np.uint64((1 << _PLACE) - 1)
    low = _smallest(low, size)
    n = np.diff(offsets) - window + 1
    piece = np.repeat(np.arange(len(n)), n)
    start = offsets[piece] + np.arange(len(piece)) - np.repeat(np.cumsum(n) - n, n)
    place = (low[start] & np.uint64((1 << _PLACE) - 1)).astype(np.int64)
    new = np.flatnonzero(np.append(True, (piece[1:] != piece[:-1]) | (place[1:] != place[:-1])))
    return piece[new], h[place[new]], start[new], np.diff(np.append(new, len(piece)))


# --- transforms and their merge ---------------------------------------------------------------------


def shard_transform(codes: np.ndarray, depth: int) -> np.ndarray:
    """Suffix array of ``codes``, sorted by ``depth`` symbols at least.

    ``codes`` are strings of bytes that each end with a 0.
    Suffixes are sorted by eight symbols, then those still tied by sixteen, and so on.
    """
    n = len(codes)
    key = np.zeros(n + 8, np.uint64)
    key[:n] = codes
    for width in (1, 2, 4):
        key[:-width] = key[:-width] << np.uint64(8 * width) | key[width:]
    key, step = key[:n], 8
    order = np.argsort(key)
    sorted_ = key[order]
    new = np.append(True, sorted_[1:] != sorted_[:-1])
    rank = np.zeros(n + depth + 1, np.int64)  # the first place of its group, plus one; 0 past the end
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0)) + 1
    while step < depth:
        tied = np.flatnonzero(~new | np.append(~new[1:], False))
        if not len(tied):
            break
        rows = order[tied]
        pair = rank[rows] * (n + 1) + rank[np.minimum(rows + step, n)]
        by = np.argsort(pair)
        rows, pair = rows[by], pair[by]
        order[tied] = rows
        fresh = np.append(True, pair[1:] != pair[:-1])
        new[tied] = fresh
        rank[rows] = tied[np.maximum.accumulate(np.where(fresh, np.arange(len(rows)), 0))] + 1
        step *= 2
    return order


def merge_transforms(codes: np.ndarray, suffixes: np.ndarray, source: np.ndarray, windows: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the windows that occur more than once, in the interleave of the merged transforms by ``depth`` symbols, and the block of each.

    ``suffixes`` come transform by transform, each in its own order: places in ``codes``.  ``source`` is the transform of each, and ``windows`` are
    the places where ``depth`` symbols of a string begin.  The interleave tells, row by row, which transform the next row comes from.
    It begins with all rows of the first, then the second and so on: the order by no symbol.  Each round sorts, stably, by the two
    symbols before: from the order by h symbols follows that by h + 2 of the suffixes two places earlier.  A row begins a block where its
    symbols or the block it came from differ from the row above.  Only the suffixes that are the last h symbols of a window, cut there, lead to one, so
    a round has a row for each window.  A window that is alone in its block has no equal and is left out from then on.
    """
    at = np.arange(len(codes))
    before = (codes[at - 2].astype(np.uint16) << 8 | codes[at - 1])[suffixes]
    rank = np.empty(len(codes), np.int32)
    rank[suffixes] = at
    here = np.sort(rank[windows + depth])  # the rows of all transforms, each in its own order
    inter, block = source[here], np.zeros(len(here), np.int32)
    place = np.argsort(inter, kind="stable")
    for h in range(2, depth + 1, 2):
        symbols = np.empty(len(here), np.uint16)
        symbols[place] = before[here]
        order = np.argsort(symbols, kind="stable")
        inter, came, symbols = inter[order], block[order], symbols[order]
        new = np.append(True, (symbols[1:] != symbols[:-1]) | (came[1:] != came[:-1]))[: len(here)]
        block = np.cumsum(new, dtype=np.int32)
        here = np.sort(rank[windows + (depth - h)])
        place = np.argsort(inter, kind="stable")
        if h % DROP == 0 or h == depth:
            many = np.flatnonzero(~(new & np.append(new[1:], True)[: len(here)]))
            row = np.empty_like(here)
            row[place] = here
            row, inter, block = row[many], inter[many], block[many]
            windows = suffixes[row] - (depth - h)
            here, place = np.sort(row), np.argsort(inter, kind="stable")
    return windows, block


def shared_windows(pieces: list[bytes], window: int = WINDOW, shards: int = SHARDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Block, piece and offset of every window that occurs more than once, by block."""
    count = max(1, min(shards, len(pieces)))
    raw = np.frombuffer(b"".join(pieces), np.uint8)
    used = np.unique(raw)
    if len(used) > 255:
        return _windows_by_value(pieces, window)
    code = np.zeros(256, np.uint8)  # 0 is the end of a string
    code[used] = np.arange(1, len(used) + 1)
    whose = np.concatenate([np.arange(s, len(pieces), count) for s in range(count)])
    dealt = [pieces[i] for i in whose.tolist()]
    size = np.array([len(p) for p in dealt], np.int64)
    stop = np.cumsum(size + 1) - 1
    codes = code[np.frombuffer(b"\0".join(dealt) + b"\0", np.uint8)]
    codes[stop] = 0
    n = np.maximum(size - window + 1, 0)
    windows = np.arange(n.sum()) + np.repeat(stop - size - (np.cumsum(n) - n), n)
    suffixes, source, begin = [], [], 0
    for s in range(count):
        end = int(stop[np.searchsorted(whose % count, s, side="right") - 1]) + 1
        suffixes.append(shard_transform(codes[begin:end], window) + begin)
        source.append(np.full(end - begin, s, np.uint8))
        begin = end
    place, block = merge_transforms(codes, np.concatenate(suffixes), np.concatenate(source), windows, window)
    string = np.searchsorted(stop, place, side="right")
    return block, whose[string], place - (stop - size)[string]


def _windows_by_value(pieces: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for bytes that are not UTF-8 and leave no code for the end of a string."""
    groups: dict[bytes, list[tuple[int, int]]] = {}
    for i, p in enumerate(pieces):
        for j in range(len(p) - window + 1):
            groups.setdefault(p[j : j + window], []).append((i, j))
    rows = [(b, i, j) for b, g in enumerate(g for g in groups.values() if len(g) > 1) for i, j in g]
    block, piece, offset = np.array(rows, np.int64).reshape(-1, 3).T
    return block, piece, offset


def foreign_windows(pieces: list[bytes], owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Piece and offset of the windows that occur earlier in another piece.

    ``owner`` has a row (doc, start) for each piece: its earliest place.
    """
    block, piece, offset = shared_windows(pieces)
    if not len(block):
        return piece, offset
    order = np.lexsort((owner["start"][piece] + offset, owner["doc"][piece], block))
    block, piece, offset = block[order], piece[order], offset[order]
    later = np.append(False, block[1:] == block[:-1])
    return piece[later], offset[later]


# --- Spark -----------------------------------------------------------------------------------------


def _documents(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc, doc_id, text) of every row, and (doc, same) of every document: its number and the digest of its text."""
    text = F.coalesce("text", F.lit(""))
    same = F.unhex(F.md5(text.cast("binary")))
    ids = materialize(docs.select("doc_id", same.alias("same")), "suffix-ids")
    if isinstance(docs.schema["doc_id"].dataType, IntegralType):
        odd = ids.groupBy("doc_id").agg((F.min("same") < F.max("same")).alias("two")).where("two OR doc_id IS NULL")
        if odd.isEmpty():
            number = F.col("doc_id").cast("long")
            return docs.select(number.alias("doc"), "doc_id", text.alias("text")), ids.select(number.alias("doc"), "same")
    ids = materialize(numbered(ids.distinct(), ["doc_id", "same"], "doc"), "suffix-numbers")
    known = ids.select(F.col("doc_id").alias("known_id"), F.col("same").alias("known_same"), "doc")
    here = F.col("known_id").eqNullSafe(F.col("doc_id")) & (F.col("known_same") == F.col("same"))
    rows = docs.select("doc_id", same.alias("same"), text.alias("text")).join(known, here)
    return materialize(rows.select("doc", "doc_id", "text"), "suffix-rows"), ids.select("doc", "same")


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchor, and a hash of text and place: it tells whether an anchor occurs at different places of different texts."""
    for batch in sub_batches(batches, "text", BLOCK):
        data, offsets = text_bytes(batch.column(1))
        key, start, _ = pieces_of(data, offsets)
        doc = np.searchsorted(offsets, start, side="right") - 1
        whole = batch.column(0).to_numpy().view(np.uint64)[doc]
        at = mix(whole ^ mix((start - offsets[doc]).astype(np.uint64)))
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(at.view(np.int64))], names=["key", "at"])


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchor, document, and in one number: first window and number of windows."""
    for batch in sub_batches(batches, "text", BLOCK):
        data, offsets = text_bytes(batch.column(1))
        key, start, n = pieces_of(data, offsets)
        doc = np.searchsorted(offsets, start, side="right") - 1
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column(0).take(pa.array(doc)), pa.array((start - offsets[doc]) << 8 | n)], names=["key", "doc", "at"])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed one by one, to halve what a join by document moves."""
    press = zstandard.ZstdCompressor(level=3, write_content_size=True)
    for batch in sub_batches(batches, "text"):
        data, offsets = text_bytes(batch.column(2))
        raw, off = data.tobytes(), offsets.tolist()
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([press.compress(raw[a:b]) for a, b in itertools.pairwise(off)], pa.binary())], names=["doc", "doc_id", "z"])


def _unpacked(batches: Iterator[pa.RecordBatch], most: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """Batches with the column z turned into text."""
    loosen = zstandard.ZstdDecompressor()
    for batch in sub_batches(batches, "z", most):
        at = batch.schema.get_field_index("z")
        texts = pa.array([loosen.decompress(z) if z else b"" for z in batch.column(at).to_pylist()], pa.binary())
        yield batch.set_column(at, "text", texts)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pieces of each document that its list ``at`` names."""
    for batch in sub_batches(_unpacked(batches), "text", 2 * BLOCK):
        data, offsets = text_bytes(batch.column(1))
        lists = batch.column(2)
        flat, counts = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
        doc = np.repeat(np.arange(batch.num_rows), counts)
        start, n = flat >> 8, flat & 255
        begin, size = offsets[doc] + start, n + WINDOW - 1
        ends = np.cumsum(size)
        bytes_ = data[np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - (ends - size), size)]
        binary = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(np.append(0, ends).astype(np.int32)), pa.py_buffer(bytes_)])
        # the anchor again, from the piece's first window: all its windows have the same
        key = anchors_of(data[begin[:, None] + np.arange(WINDOW)]).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(key), binary, batch.column(0).take(pa.array(doc)), pa.array(start)], names=["key", "piece", "doc", "start"])


def _singles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of pieces, one by one."""
    for batch in sub_batches(batches, "piece", 1 << 18):
        rows = [(p[i : i + WINDOW], s + i) for p, s in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True) for i in range(len(p) - WINDOW + 1)]
        own = pa.array(np.repeat(np.arange(batch.num_rows), [len(p) - WINDOW + 1 for p in batch.column(0).to_pylist()]))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), batch.column(1).take(own), pa.array([r[1] for r in rows], pa.int64())], names=["piece", "doc", "start"])


def _finer(level: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sub_batches(batches, "piece", 1 << 18):
            data, offsets = text_bytes(batch.column(1))
            own, h, start, n = finer_pieces(data, offsets, level)
            key = mix(batch.column(0).to_numpy().view(np.uint64)[own] ^ mix(h))
            raw, begin = data.tobytes(), start.tolist()
            pieces = pa.array([raw[b : b + k + WINDOW - 1] for b, k in zip(begin, n.tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pieces, batch.column(2).take(pa.array(own)), pa.array(batch.column(3).to_numpy()[own] + start - offsets[own])], names=["key", "piece", "doc", "start"])

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by key; whole keys are gathered up to CHUNK bytes, plus one key of MOST_PIECES at most."""

    def settle(part: pa.Table) -> pa.RecordBatch:
        owner = np.zeros(part.num_rows, dtype=[("doc", "i8"), ("start", "i8")])
        for name in owner.dtype.names:
            owner[name] = part.column(name).to_numpy()
        piece, offset = foreign_windows(part.column("piece").to_pylist(), owner)
        order = np.lexsort((offset, piece))
        piece, offset = piece[order], offset[order]
        new = np.flatnonzero(np.append(True, (piece[1:] != piece[:-1]) | (offset[1:] != offset[:-1] + 1))) if len(piece) else np.zeros(0, np.int64)
        n = np.diff(np.append(new, len(piece)))
        return pa.RecordBatch.from_arrays([pa.array(owner["doc"][piece[new]]), pa.array((owner["start"][piece[new]] + offset[new]) << 8 | n)], names=["doc", "run"])

    held: list[pa.RecordBatch] = []
    for batch in sub_batches(batches, "piece", CHUNK // 4):
        held.append(batch)
        if sum(b.nbytes for b in held) < CHUNK:
            continue
        table = pa.Table.from_batches(held)
        keys = table.column("key").to_numpy()
        cut = int(np.searchsorted(keys, keys[-1]))
        if cut:
            yield settle(table.slice(0, cut))
            held = table.slice(cut).combine_chunks().to_batches()
    if held:
        yield settle(pa.Table.from_batches(held))


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sub_batches(_unpacked(batches), "text"):
        data, offsets = text_bytes(batch.column(1))
        spans, owns, runs, copy = (batch.column(i).to_pylist() for i in (2, 3, 4, 5))
        rows = []
        for i in range(batch.num_rows):
            text = data[offsets[i] : offsets[i + 1]]
            own = set(owns[i] or ())
            edges = np.zeros(len(text) + 1, np.int32)
            for x in [x for x in spans[i] or () if x >> 8 not in own] + (runs[i] or []):
                edges[x >> 8] += 1
                edges[(x >> 8) + (x & 255) + WINDOW - 1] -= 1
            gone = (np.cumsum(edges[:-1]) > 0) | bool(copy[i] and len(text) >= WINDOW)
            n_spans = int(gone[0] if len(gone) else 0) + int(np.count_nonzero(gone[1:] & ~gone[:-1]))
            rows.append((len(text), int(gone.sum()), n_spans, text[~gone].tobytes()))
        n, removed, number, kept = zip(*rows, strict=True)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(number, pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def _found(d: DataFrame) -> DataFrame:
    """(doc, at) of the pieces whose anchor occurs at different places of different texts."""
    keys = d.select(F.xxhash64("text").alias("whole"), "text").mapInArrow(_keys, "key long, at long").groupBy("key").agg(F.min("at").alias("low"), F.max("at").alias("high"), F.count(F.lit(1)).alias("n"))
    keys = materialize(keys.where("low < high").select("key", "n"), "suffix-keys")
    found = d.select("doc", "text").mapInArrow(_anchors, "key long, doc long, at long")
    total = keys.agg(F.sum("n")).first()[0] or 0
    hot = [r.key for r in keys.where(F.col("n") > max(total * HOT, HOT_ROWS)).select("key").collect()]  # at most 1 / HOT
    if not hot:
        return found.join(keys.select("key"), "key", "left_semi").select("doc", "at")
    salted = found.withColumn("salt", F.when(F.col("key").isin(hot), F.pmod(F.xxhash64("doc", "at"), F.lit(SALTS))).otherwise(0).cast("int"))
    salts = F.when(F.col("key").isin(hot), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return salted.join(keys.select("key", F.explode(salts).alias("salt")), ["key", "salt"], "left_semi").select("doc", "at")


def _runs(different: DataFrame, level: int) -> DataFrame:
    """(doc, run) of the windows that occur earlier in another one of the different pieces (key, piece, doc, start)."""
    shared = materialize(different.groupBy("key").agg(F.count(F.lit(1)).alias("pieces")).where("pieces > 1"), "suffix-shared")
    mixed = different.join(shared, "key")
    few = mixed.where(F.col("pieces") <= MOST_PIECES).select("key", "piece", "doc", "start")
    merged = few.repartition("key").sortWithinPartitions("key").mapInArrow(_merge, "doc long, run long")
    if shared.where(F.col("pieces") > MOST_PIECES).isEmpty():
        return merged
    many = mixed.where(F.col("pieces") > MOST_PIECES).select("key", "piece", "doc", "start")
    if level < LEVELS:
        parts, same = materialize(many.mapInArrow(_finer(level), "key long, piece binary, doc long, start long"), "suffix-parts"), ["key", "piece"]
    else:
        parts, same = many.select("piece", "doc", "start").mapInArrow(_singles, "piece binary, doc long, start long"), ["piece"]
    owner = parts.groupBy(*same).agg(F.min(F.struct("doc", "start")).alias("o"), F.count(F.lit(1)).alias("n"))
    if level < LEVELS:
        owner = materialize(owner, "suffix-owners")
    later = parts.join(owner.where("n > 1"), same).where(F.struct("doc", "start") != F.col("o"))
    later = merged.union(later.select("doc", F.shiftleft("start", 8).bitwiseOR(F.octet_length("piece").cast("long") - (WINDOW - 1)).alias("run")))
    return later.union(_runs(owner.select("key", "piece", "o.*"), level + 1)) if level < LEVELS else later


def _repeats(d: DataFrame, ids: DataFrame, packed: DataFrame) -> DataFrame:
    """By document: spans, pieces that are repeated in part; owns, starts of pieces that are the earliest;
    runs, windows that occur earlier in another piece; copy, whether an earlier document is equal."""
    # written, so that a text with very many copies can be dealt to several tasks of the join
    firsts = materialize(ids.groupBy("same").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last").select("same", "first"), "suffix-firsts")
    copies = materialize(ids.join(firsts, "same").where(F.col("doc") > F.col("first")).select("doc").distinct(), "suffix-copies")
    spans = materialize(_found(d).groupBy("doc").agg(F.collect_set("at").alias("spans")).join(copies, "doc", "left_anti"), "suffix-spans")
    pieces = packed.select("doc", "z").join(spans, "doc").select("doc", "z", "spans").mapInArrow(_cut, "key long, piece binary, doc long, start long")
    earliest = F.min(F.struct("doc", "start")).alias("own")
    different = materialize(pieces.groupBy("key", "piece").agg(earliest), "suffix-pieces").select("key", "piece", "own.*")
    runs = materialize(_runs(different, 1), "suffix-runs").groupBy("doc").agg(F.collect_list("run").alias("runs"))
    owns = different.groupBy("doc").agg(F.collect_list("start").alias("owns"))
    marks = spans.join(owns, "doc", "left").join(runs, "doc", "left").withColumn("copy", F.lit(False))
    return marks.unionByName(copies.withColumn("copy", F.lit(True)), allowMissingColumns=True)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (the bytes that remain) of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    d, ids = _documents(docs)
    packed = d.mapInArrow(_pack, f"doc long, doc_id {kind}, z binary")
    marks = _repeats(d.select("doc", "text"), ids, packed)
    done = packed.join(marks, "doc", "left").select("doc_id", "z", "spans", "owns", "runs", "copy")
    return done.mapInArrow(_remove, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")


def report(docs: DataFrame) -> DataFrame:
    """The rows of ``remove_repeats`` with a digest of what is kept; the intermediate tables have gone."""
    with scratch(docs.sparkSession) as keep:
        return keep(remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")), "suffix-report")


def brute_force(texts: list[bytes], window: int = WINDOW) -> list[tuple[int, int, int, str]]:
    """The same for a few texts in order, by a table of all windows."""
    seen: set[bytes] = set()
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - window + 1):
            w = t[i : i + window]
            if w in seen:
                gone[i : i + window] = b"\1" * window
            seen.add(w)
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out

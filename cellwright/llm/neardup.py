"""MinHash near-duplicates by ProbMinHash signatures, banding and verification.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z.  A text's shingles are its runs of five
words (of a shorter text, all its words), weighted by how often they occur.  The similarity is the
probability Jaccard index of the weights, and two texts are near-duplicates from 0.8 on.

Signatures: every shingle is a Poisson process with its weight as rate, each arrival falls on a random
register, and a register keeps the shingle of its first arrival.  A text is done when no process
can beat its slowest register any more.  Two registers agree with the probability of the similarity.

Candidates: 40 bands of 6 registers.  First every text is compared, word by word, with the least text it shares a
bucket with, and then, in two rounds, with one more leader of a bucket that still holds several classes.  After
that few buckets do.  Texts in them that are outside the bucket's largest class are paired with the bucket's
texts of other classes, block by block: a task holds ``STRAYS`` by ``BLOCK`` texts at most.  Pairs that agree in less than
``LIKELY`` of 1024 further registers (five standard deviations below 0.8) go.  Of the others, each text's best with each other
class is compared first, and when those links have joined classes, all that is left between two classes.
So pairs within one class are hardly written out, and no pair of two classes is dropped for the size of its group.

Equal texts are one node from the start.  Classes are connected components.  Null texts are in
classes of their own by id; texts without words equal only themselves.  Repeated rows share a
class.  ``class_id`` is the least doc_id of the class (null if it has none).  An empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scratch import materialize, scratch
from .common import BYTE_VALUE, bucketed, mix, prefix_hash, span_hash, sub_batches, text_bytes, word_spans

WORDS = 5
SIMILARITY = 0.8
ROWS, BANDS = 6, 40
REGISTERS = ROWS * BANDS
#: Registers of the texts that share a bucket, kept as 4 bits each, and the similarity by which two texts are compared.
FINE, LIKELY = 1024, SIMILARITY - 5 * 0.013
#: Rounds in which each text of an open bucket is compared with one more leader.
ROUNDS = 2
STRAYS, BLOCK = 256, 1024


# --- shingles, signatures, similarity -------------------------------------------------------------


def shingles(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, hash and count of the distinct shingles, by document and hash."""
    low, start, end, doc = word_spans(data, offsets)
    if not len(start):
        return doc, np.zeros(0, np.uint64), np.zeros(0, np.int64)
    word = span_hash(prefix_hash(BYTE_VALUE[low]), start, end)
    prefix = prefix_hash(word)
    first = np.searchsorted(doc, np.arange(len(offsets) - 1))
    last = np.append(first[1:], len(doc))
    at = np.arange(len(doc))
    whole = at + words <= last[doc]
    short = (at == first[doc]) & ~whole
    begin = np.flatnonzero(whole | short)
    stop = np.where(whole[begin], begin + words, last[doc[begin]])
    found, doc = span_hash(prefix, begin, stop), doc[begin]
    order = np.lexsort((found, doc))
    found, doc = found[order], doc[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (found[1:] != found[:-1])
    where = np.flatnonzero(new)
    return doc[where], found[where], np.diff(np.append(where, len(doc)))


def signatures(doc: np.ndarray, ids: np.ndarray, count: np.ndarray, n: int, registers: int = REGISTERS) -> np.ndarray:
    """(n, registers) winning shingles; rows of documents without shingles are 0."""
    best = np.full(n * registers, np.inf)
    won = np.zeros(n * registers, np.uint64)
    time = np.zeros(len(ids))
    arrival = 0
    base = doc * registers
    while len(ids):
        arrival += 1
        h = mix(ids + np.uint64(arrival * 0xA24BAED4963EE407 & (2**64 - 1)))
        time = time - np.log(((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / count
        if arrival > 1:
            go = time < limit[doc]
            if not go.all():
                ids, time, doc, base, count, h = ids[go], time[go], doc[go], base[go], count[go], h[go]
        at = base + (mix(h + np.uint64(0x9FB21C651E98DF25)) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(best, at, time)
        win = time == best[at]
        won[at[win]] = ids[win]
        limit = best.reshape(n, registers).max(axis=1)
    return won.reshape(n, registers)


def band_keys(sig: np.ndarray) -> np.ndarray:
    """(n, BANDS) keys that differ between bands."""
    rows = sig.reshape(len(sig), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93), rows.shape[:2]).copy()
    for i in range(ROWS):
        key = mix(key ^ rows[:, :, i]) + key
    return key


def register_nibbles(sig: np.ndarray) -> list[bytes]:
    """Four bits of each register, two to a byte."""
    low = (mix(sig) & np.uint64(15)).astype(np.uint8)
    k = sig.shape[1] // 2
    flat = (low[:, :k] << 4 | low[:, k:]).tobytes()
    return [flat[i : i + k] for i in range(0, len(flat), k)]


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Of two sorted arrays of ids with counts: the sum over common i of 1 / sum over j of max(x_j / x_i, y_j / y_i)."""
    (ia, ca), (ib, cb) = a, b
    if not len(ia) or not len(ib):
        return 0.0
    both, pa_, pb_ = np.intersect1d(ia, ib, assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    ca, cb = ca / ca.sum(), cb / cb.sum()
    x, y = ca[pa_], cb[pb_]
    only_x = 1.0 - x.sum()  # the ratio x / y of these is infinite, so they add to the x part of every i
    only_y = 1.0 - y.sum()
    order = np.argsort(x / y, kind="stable")
    x, y = x[order], y[order]
    xs = np.cumsum(x[::-1])[::-1] + max(0.0, only_x)
    ys = np.concatenate([[0.0], np.cumsum(y)[:-1]]) + max(0.0, only_y)
    # equal ratios give the same maximum either way
    return float((1.0 / (xs / x + ys / y)).sum())


def _split(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    doc, ids, count = shingles(*text_bytes(column))
    cuts = np.searchsorted(doc, np.arange(1, len(column)))
    return list(zip(np.split(ids, cuts), np.split(count, cuts), strict=True)) if len(column) else []


# --- Spark ----------------------------------------------------------------------------------------


def _node(text: Column, doc_id: Column) -> Column:
    """Equal texts are one node; null texts are told apart by id, and from texts by one more byte."""
    return F.unhex(F.coalesce(F.md5(text.cast("binary")), F.concat(F.lit("00"), F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")))))


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sub_batches(batches, "text", 1 << 19):
        n = batch.num_rows
        doc, ids, count = shingles(*text_bytes(batch.column(2)))
        keys = band_keys(signatures(doc, ids, count, n))
        some = np.bincount(doc, minlength=n) > 0
        flat = pa.array(keys.view(np.int64)[some].ravel())
        offs = pa.array(np.concatenate([[0], np.cumsum(some * BANDS)]).astype(np.int32))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(offs, flat)], names=["doc_id", "node", "bands"])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sub_batches(sub_batches(batches, "t1", 1 << 19), "t2", 1 << 19):
        s = [probability_jaccard(a, b) for a, b in zip(_split(batch.column(2)), _split(batch.column(3)), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s, pa.float64())], names=["leader", "node", "s"])


def similarities(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``pairs`` (leader, node) with their similarity ``s``."""
    # the second join deals rows by node, of which each has few pairs, whatever a leader has
    with_1 = pairs.join(texts.select(F.col("node").alias("leader"), F.col("text").alias("t1")), "leader")
    both = with_1.join(texts.select("node", F.col("text").alias("t2")), "node").select("leader", "node", "t1", "t2")
    return materialize(both.mapInArrow(_compare, "leader binary, node binary, s double"), "neardup-pairs")


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) of all nodes of ``edges`` (a, b): the least node reachable, by passing labels and jumping along them."""
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "neardup-edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("comp")), "neardup-labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("least"))
        new = labels.join(near, "node").select("node", F.least("comp", "least").alias("to"), F.col("comp").alias("old"))
        jumped = new.join(labels.select(F.col("node").alias("to"), F.col("comp").alias("further")), "to").select("node", F.least("to", "further").alias("comp"), "old")
        step = materialize(jumped, "neardup-labels")
        labels = step.select("node", "comp")
        if step.where(F.col("comp") != F.col("old")).isEmpty():
            return labels


def _labelled(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return members.withColumn("comp", F.col("node"))
    return members.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))


def _linked(labels: DataFrame | None, found: DataFrame) -> DataFrame | None:
    """``labels`` with the classes joined that the links among ``found`` connect.  Only the graph of classes is walked."""
    links = found.where(F.col("s") >= SIMILARITY).select(F.col("leader").alias("a"), F.col("node").alias("b"))
    if links.isEmpty():
        return labels
    if labels is None:
        return components(links)
    ends = links.select(F.col("a").alias("node")).union(links.select(F.col("b").alias("node"))).distinct()
    every = materialize(labels.union(ends.join(labels, "node", "left_anti").select("node", F.col("node").alias("comp"))), "neardup-labels")
    of = lambda end: every.select(F.col("node").alias(end), F.col("comp").alias(f"{end}_comp"))
    between = links.join(of("a"), "a").join(of("b"), "b").where("a_comp != b_comp").select(F.least("a_comp", "b_comp").alias("a"), F.greatest("a_comp", "b_comp").alias("b")).distinct()
    up = components(between).select(F.col("node").alias("comp"), F.col("comp").alias("to"))
    return materialize(every.join(up, "comp", "left").select("node", F.coalesce("to", "comp").alias("comp")), "neardup-labels")


def _sign_finely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """More registers, and the bands' keys."""
    for batch in sub_batches(batches, "text", 1 << 18):
        doc, ids, count = shingles(*text_bytes(batch.column(1)))
        keys = [np.array(k, np.int64).tobytes() for k in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(register_nibbles(signatures(doc, ids, count, batch.num_rows, FINE)), pa.binary()), pa.array(keys, pa.binary())], names=["node", "sig", "keys"])


def _likely(best: bool) -> Callable[[pa.Table], pa.Table]:
    """Pairs of a stray and a text of another class that agree in enough registers; two strays meet once.

    ``best``: only the most similar of each class for each stray.  Otherwise a pair comes from the first band that it shares.
    """

    def run(table: pa.Table) -> pa.Table:
        stray = np.array(table.column("left").to_pylist(), bool)
        half = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint8).reshape(-1, FINE // 2)
        sig = np.concatenate([half >> 4, half & 15], axis=1)
        node, wandering = table.column("node").to_pylist(), np.array(table.column("strays").to_pylist(), bool)
        _, comp = np.unique(np.array([c.hex() for c in table.column("comp").to_pylist()]), return_inverse=True)
        keys = np.frombuffer(b"".join(table.column("keys").to_pylist()), np.int64).reshape(-1, BANDS)
        here = table.column("bucket")[0].as_py()
        right = np.flatnonzero(~stray)
        found: list[tuple[bytes, bytes]] = []
        for i in np.flatnonzero(stray):
            # two unlike registers agree in one of 16 cases
            alike = ((sig[right] == sig[i]).mean(axis=1) - 1 / 16) * (16 / 15)
            near = np.flatnonzero((alike >= LIKELY) & (comp[right] != comp[i]))
            if best and len(near):
                near = near[np.lexsort((-alike[near], comp[right[near]]))]
                near = near[np.append(True, np.diff(comp[right[near]]) != 0)]
            elif len(near):
                shared = keys[right[near]] == keys[i]
                near = near[keys[i][shared.argmax(axis=1)] == here]
            found += [(min(node[i], node[j]), max(node[i], node[j])) for j in right[near] if best or not wandering[j] or node[i] < node[j]]
        return pa.table({"leader": pa.array([f[0] for f in found], pa.binary()), "node": pa.array([f[1] for f in found], pa.binary())})

    return run


def link(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(doc_id, node) of every row, and (node, comp) of the nodes that have a link, if any."""
    rows = docs.select("doc_id", _node(F.col("text"), F.col("doc_id")).alias("node"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    base = materialize(rows.mapInArrow(_sign, f"doc_id {kind}, node binary, bands array<long>"), "neardup-base")
    nodes = base.select("doc_id", "node")
    # a bucket's members, equal texts once
    placed = base.select("node", "bands").groupBy("node").agg(F.first("bands").alias("bands")).select("node", F.explode("bands").alias("bucket"))
    shared = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket")
    members = materialize(placed.join(shared, "bucket", "left_semi").select("bucket", "node"), "neardup-members")
    # what is joined by bucket is written first, so that a large bucket can be dealt to several tasks
    leads = materialize(members.groupBy("bucket").agg(F.min("node").alias("leader")), "neardup-leads")
    found = materialize(members.select("node").distinct(), "neardup-nodes")
    same = F.col("n2") == F.col("node")
    # a merge join at every size, lest the few nodes of a small table be broadcast and those of a large one not
    shown = rows.select(F.col("node").alias("n2"), "text").join(found.hint("merge"), same, "left_semi").select(F.col("n2").alias("node"), "text").groupBy("node").agg(F.first("text").alias("text"))
    texts, table = bucketed(shown, "node", "neardup_texts")
    try:
        return nodes, _grow(members, leads, base, texts)
    finally:
        docs.sparkSession.sql(f"DROP TABLE IF EXISTS {table}")


def _grow(members: DataFrame, leads: DataFrame, base: DataFrame, texts: DataFrame) -> DataFrame | None:
    """(node, comp) from comparisons of the members of buckets, round by round."""
    # first every text is compared with the least text it meets
    results = [similarities(members.join(leads, "bucket").where("node > leader").groupBy("node").agg(F.min("leader").alias("leader")), texts)]
    labels = _linked(None, results[0])
    for _ in range(ROUNDS):
        of = _labelled(members, labels).groupBy("bucket").agg(F.min(F.struct("comp", "node")).alias("low"), F.max("comp").alias("high"))
        of = materialize(of.where(F.col("low.comp") < F.col("high")).select("bucket", "low"), "neardup-lows")
        members = materialize(members.join(of, "bucket"), "neardup-open")
        pairs = _labelled(members, labels).where(F.col("comp") != F.col("low.comp")).select(F.least("node", "low.node").alias("leader"), F.greatest("node", "low.node").alias("node"), F.col("node").alias("own"))
        pairs = _untested(pairs.distinct(), results).groupBy("own").agg(F.min(F.struct("leader", "node")).alias("p")).select("p.leader", "p.node").distinct()
        results.append(similarities(pairs, texts))
        labels = _linked(labels, results[-1])
        members = members.select("bucket", "node")
    left = materialize(_straying(members, labels), "neardup-open")
    keys = base.select("node", "bands").groupBy("node").agg(F.first("bands").alias("bands"))
    open_texts = texts.join(left.select("node").distinct(), "node", "left_semi").join(keys, "node").select("node", "text", "bands")
    sigs = materialize(open_texts.mapInArrow(_sign_finely, "node binary, sig binary, keys binary"), "neardup-sigs")
    for best in (True, False):
        results.append(similarities(_untested(_across(left, sigs, best), results), texts))
        labels = _linked(labels, results[-1])
        if best:
            left = materialize(_straying(left.select("bucket", "node"), labels), "neardup-open")
    return labels


def _across(left: DataFrame, sigs: DataFrame, best: bool) -> DataFrame:
    """Likely pairs (leader, node) between classes within the buckets of ``left``."""
    sizes = left.groupBy("bucket").agg(F.ceil(F.count_if("strays") / STRAYS).cast("int").alias("rows"), F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("cols"))
    signed = left.join(sizes, "bucket").join(sigs, "node").withColumn("h", F.pmod(F.xxhash64("node"), F.lit(1 << 30)))
    mine = (F.col("h") % F.col("rows")).cast("int")
    own = (F.floor(F.col("h") / 1024) % F.col("cols")).cast("int")
    kept = ["bucket", "node", "comp", "strays", "sig", "keys"]
    # a stray meets every block of texts, a text every block of strays
    across = signed.where("strays").select(*kept, F.lit(True).alias("left"), mine.alias("i"), F.explode(F.sequence(F.lit(0), F.col("cols") - 1)).alias("j"))
    down = signed.select(*kept, F.lit(False).alias("left"), own.alias("j"), F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("i"))
    return across.unionByName(down).groupBy("bucket", "i", "j").applyInArrow(_likely(best), "leader binary, node binary").distinct()


def _untested(pairs: DataFrame, results: list[DataFrame]) -> DataFrame:
    return pairs.join(reduce(DataFrame.union, results).select("leader", "node"), ["leader", "node"], "left_anti")


def _straying(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    """(bucket, node, comp, strays) of the buckets with several classes; strays: not of the bucket's largest class."""
    m = _labelled(members, labels).select("bucket", "node", "comp")
    sizes = m.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("n"))
    main = sizes.groupBy("bucket").agg(F.max(F.struct("n", "comp")).alias("main"), F.count(F.lit(1)).alias("classes")).where("classes > 1")
    main = materialize(main, "neardup-main")
    return m.join(main, "bucket").select("bucket", "node", "comp", (F.col("comp") != F.col("main.comp")).alias("strays"))


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, keep (whether the row's id is its class's) of every row.  Its rows are written when the plan is built."""
    with scratch(docs.sparkSession) as keep:
        nodes, labels = link(docs)
        labelled = _labelled(nodes, labels).select("doc_id", "comp")
        least = materialize(labelled.groupBy(F.col("comp").alias("c")).agg(F.min("doc_id").alias("class_id")), "neardup-least")
        out = labelled.join(least, F.col("comp") == F.col("c")).select("doc_id", "class_id", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("keep"))
        return keep(out, "neardup-classes")


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """One row of each class: that with the least id, of rows with that id the first by text, and of equal texts the least by a hash of all columns."""
    with scratch(docs.sparkSession) as keep:
        nodes, labels = link(docs)
        rows = _labelled(nodes, labels).groupBy("comp", "doc_id", "node").agg(F.count(F.lit(1)).alias("n"))
        stays = rows.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "node", "n")).alias("k"))
        stays = keep(stays.select(F.col("k.doc_id").alias("__keep_id"), F.col("k.node").alias("__keep_node"), F.col("k.n").alias("__keep_n")), "neardup-stays")
    same = (F.col("__keep_node") == _node(docs["text"], docs["doc_id"])) & F.col("__keep_id").eqNullSafe(docs["doc_id"])
    kept = docs.join(stays, same)
    if not stays.where("__keep_n > 1").isEmpty():
        order = Window.partitionBy("__keep_id", "__keep_node").orderBy(F.xxhash64(*[docs[f"`{c}`"] for c in docs.columns]))
        kept = kept.withColumn("__keep_nr", F.row_number().over(order)).where("__keep_nr = 1")
    return kept.select(*[docs[f"`{c}`"] for c in docs.columns])

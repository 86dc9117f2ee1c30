"""Benchmark decontamination by a broadcast hash set of normalised n-grams.

A window is ``n`` consecutive words of a benchmark item, or a whole item that has fewer (but some).
The windows of all items form a hash set, keyed by 64 bits of their words.  The windows of every document are looked up in it, and
a window that is found is verified by its words.  ``annotate`` tells hits per row; ``drop_documents`` and
``remove_spans`` act on them.

Each word is hashed once; the hash of 2, 4, 8 ... words comes from those of their halves, and that of n words from the powers of
two that make up n.  A set of more than ``BLOCK`` windows and items is broadcast block by block, each against all documents.

Null and empty texts have no words: such documents are clean and such items have no windows.
Repeated rows get one result each.  Empty tables give empty results or leave all rows clean.
Other columns are kept apart from the working ones, whatever their names.  The benchmark's windows are written and counted when
a plan is built.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import materialize
from .common import WORD, words

N = 10
#: Pairs of a window and an item that are broadcast at a time (about 200 bytes each).
BLOCK = 500_000


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _joined(a: Column, b: Column, gap: int, n: Column) -> Column:
    """Hashes of n windows: each of ``a`` with that of ``b`` which begins ``gap`` words later."""
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(gap + 1), n), lambda x, y: F.xxhash64(x, y))


def window_hashes(w: Column, lengths: list[int]) -> Column:
    """An array for the hashes of the windows of all ``lengths`` of the words ``w``, one length after the other."""

    def number(n: int) -> Column:
        return F.greatest(F.size(w) - (n - 1), F.lit(0))

    def of_length(n: int, powers: dict[int, Column]) -> Column:
        done, out = 0, None
        for p in sorted(powers, reverse=True):
            if n - done >= p:
                out, done = powers[p] if out is None else _joined(out, powers[p], done, number(done + p)), done + p
        return out

    def grow(powers: dict[int, Column]) -> Column:
        top = max(powers)
        if 2 * top <= max(lengths):
            return _let(_joined(powers[top], powers[top], top, number(2 * top)), lambda h: grow({**powers, 2 * top: h}))
        return F.concat(*[of_length(n, powers) for n in lengths])

    return _let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: grow({1: h}))


def _lengths(benchmark: DataFrame, n: int) -> list[int]:
    """The distinct lengths of windows, ``n`` at most."""
    size = F.least(F.size(words(F.col("text"))), F.lit(n))
    return sorted(r.n for r in benchmark.select(size.alias("n")).where("n > 0").distinct().collect())


def item_windows(benchmark: DataFrame, n: int = N) -> DataFrame:
    """(h, gram, n_words, item) of each distinct window and item."""
    w = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words(F.col("text")).alias("w"))
    parts = []
    for size in _lengths(benchmark, n):
        own = w.where(F.size("w") >= n if size == n else F.size("w") == size)
        own = own.select("item", "w", F.posexplode(window_hashes(F.col("w"), [size])).alias("p", "h"))
        parts.append(own.select("h", F.array_join(F.slice("w", F.col("p") + 1, F.lit(size)), " ").alias("gram"), F.lit(size).alias("n_words"), "item"))
    if not parts:
        return w.limit(0).select(F.lit(0).cast("long").alias("h"), F.lit("").alias("gram"), F.lit(0).alias("n_words"), "item")
    return reduce(DataFrame.union, parts).distinct()


def _hits(base: DataFrame, grams: DataFrame, lengths: list[int]) -> DataFrame:
    """row, doc_id, nw, p (from 1), l, found (items) of each window of ``base`` in the set, and a row without a hit for each of ``base``."""
    items = grams.groupBy("h", "gram", "n_words").agg(F.collect_set("item").alias("found")).withColumnRenamed("h", "known")
    hashes = F.concat(window_hashes(F.col("w"), lengths), F.array(F.lit(None).cast("long")))
    # outer, or else a filter that asks whether there are any computes all hashes again
    flat = base.select("row", "doc_id", "w", hashes.alias("hs")).select("row", "doc_id", "w", F.posexplode_outer("hs").alias("k", "h"))
    nw = F.size("w")
    # hashes come by length: which length the k-th has, and where it begins
    length, place, before = F.lit(None).cast("int"), F.lit(None).cast("int"), F.lit(0)
    for n in lengths:
        upto = before + F.greatest(nw - (n - 1), F.lit(0))
        mine = length.isNull() & (F.col("k") < upto)
        length, place = F.when(mine, F.lit(n)).otherwise(length), F.when(mine, F.col("k") - before + 1).otherwise(place)
        before = upto
    if len(lengths) == 1:
        length, place = F.lit(lengths[0]), F.col("k") + 1
    flat = flat.select("row", "doc_id", "w", "h", nw.alias("nw"), length.alias("l"), place.alias("p"))
    # words are compared after the join, of the few windows whose hash is known; as a key, they would be of all
    joined = flat.join(F.broadcast(items), F.col("h") == F.col("known"), "left")
    verified = (F.col("l") == F.col("n_words")) & (F.array_join(F.slice("w", F.col("p"), F.col("l")), " ") == F.col("gram"))
    return joined.where(F.col("h").isNull() | F.when(F.col("known").isNotNull(), verified)).select("row", "doc_id", "nw", "p", "l", "found")


def annotate(docs: DataFrame, benchmark: DataFrame, n: int = N, block: int = BLOCK, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (sorted ids), spans (of words, from 0), contaminated for each row of ``docs``."""
    grams = materialize(item_windows(benchmark, n), "decontam-windows")
    lengths = sorted(r.n_words for r in grams.select("n_words").distinct().collect()) or [n]
    blocks = max(1, -(-grams.count() // block))
    base = docs.select(F.col(id_column).alias("doc_id"), F.monotonically_increasing_id().alias("row"), words(F.col(text_column)).alias("w"))
    if blocks > 1:  # rows keep their numbers from one block to the next
        rows = docs.select(F.col(id_column).alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col(text_column).alias("t"))
        base = materialize(rows, "decontam-rows").select("doc_id", "row", words(F.col("t")).alias("w"))
    own = lambda b: grams if blocks == 1 else grams.where(F.pmod(F.xxhash64("gram"), F.lit(blocks)) == b)
    hits = reduce(DataFrame.union, [_hits(base, own(b), lengths) for b in range(blocks)])
    at = F.when(F.col("found").isNotNull(), F.struct("p", "l"))
    per = hits.groupBy("row", "doc_id", "nw").agg(F.array_sort(F.collect_set(at)).alias("at"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("found")))).alias("items"))
    none = F.array().cast("array<struct<b:int,e:int>>")
    # merge overlapping windows; they are sorted by start
    spans = F.aggregate(
        "at",
        none,
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, F.greatest(F.size(acc), F.lit(1))).e >= x.p - 1),
            F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(F.element_at(acc, F.greatest(F.size(acc), F.lit(1))).b.alias("b"), F.greatest(F.element_at(acc, F.greatest(F.size(acc), F.lit(1))).e, x.p - 1 + x.l).alias("e")))),
        ).otherwise(F.concat(acc, F.array(F.struct((x.p - 1).alias("b"), (x.p - 1 + x.l).alias("e"))))),
    )
    # words hit: each window adds what lies beyond the end of those before it
    n_hit = F.aggregate(
        "at",
        F.struct(F.lit(0).alias("e"), F.lit(0).alias("n")),
        lambda acc, x: F.struct(F.greatest(acc.e, x.p - 1 + x.l).alias("e"), (acc.n + F.greatest(F.lit(0), x.p - 1 + x.l - F.greatest(acc.e, x.p - 1))).alias("n")),
        lambda acc: acc.n,
    )
    return per.select(
        "row",
        "doc_id",
        F.col("nw").cast("long").alias("n_words"),
        n_hit.cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        "items",
        spans.alias("spans"),
        (F.size("at") > 0).alias("contaminated"),
    )


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    a = annotate(docs, benchmark)
    return a.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


def drop_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without any hit.  Rows are told apart by id and text."""
    keyed = docs.select(F.struct(F.col("doc_id"), F.xxhash64("text").alias("h")).alias("k"), "text")
    bad = annotate(keyed, benchmark, id_column="k").where("contaminated")
    bad = bad.select(F.col("doc_id.doc_id").alias("__bad_id"), F.col("doc_id.h").alias("__bad_h")).distinct()
    return docs.join(bad, F.col("__bad_id").eqNullSafe(docs["doc_id"]) & (F.col("__bad_h") == F.xxhash64(docs["text"])), "left_anti")


def remove_spans(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` with the words of hit spans taken out of contaminated texts; the rest of each text stays as it is.

    Words are cut with the separators before them, so what is left keeps its own spacing.
    """
    a = annotate(docs.select(F.struct(F.col("doc_id"), F.xxhash64("text").alias("h")).alias("k"), "text"), benchmark, id_column="k").where("contaminated")
    a = a.select(F.col("doc_id.doc_id").alias("__hit_id"), F.col("doc_id.h").alias("__hit_h"), F.col("spans").alias("__spans")).dropDuplicates(["__hit_id", "__hit_h"])
    pieces = F.regexp_extract_all(F.col("text"), F.lit(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0))
    tail = F.regexp_extract("text", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*\z", 0)
    kept = F.filter(pieces, lambda _, i: ~F.exists("__spans", lambda s: (i >= s.b) & (i < s.e)))
    cleaned = F.when(F.col("__spans").isNotNull(), F.concat(F.array_join(kept, ""), tail)).otherwise(F.col("text"))
    joined = docs.join(a, F.col("__hit_id").eqNullSafe(docs["doc_id"]) & (F.col("__hit_h") == F.xxhash64(docs["text"])), "left")
    return joined.withColumn("text", cleaned).select(*docs.columns)


SQL = rf"""
WITH iw AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM benchmark),
grams AS (SELECT DISTINCT item, least(len(w), {N}) AS l, array_to_string(w[i : i + least(len(w), {N}) - 1], ' ') AS gram
  FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), {N}) + 2)) AS i FROM iw WHERE len(w) > 0)),
d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents),
p AS (SELECT r, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM d, (SELECT DISTINCT l FROM grams) WHERE len(w) >= l),
h AS (SELECT p.r, p.i, p.l, g.item FROM p JOIN grams g ON g.l = p.l AND g.gram = array_to_string(p.w[p.i : p.i + p.l - 1], ' ')),
n AS (SELECT r, count(DISTINCT pos) AS n_hit FROM (SELECT r, unnest(range(i, i + l)) AS pos FROM (SELECT DISTINCT r, i, l FROM h)) GROUP BY r),
it AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN it USING (r)"""

"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each source has a budget of words.  Complete epochs of the source precede a fractional one, for
which every document draws an exponential key divided by its quality weight; documents are taken
by ascending key, their sizes prefix-summed, up to the rest of the budget.  The document on the
boundary is taken if that comes nearer to the target than leaving it.

Only the sums of a few thousand key ranges per source are sorted as a whole; single documents are
sorted only within the one range that holds a source's boundary, so a hot source needs no large
sort.  Keys come from hashes of id and text: reruns agree.

Sizes are numbers of runs of non-blank characters; null texts have size 0 and are never needed to
reach a target.  A null source is a source of its own, ordered last.  Repeated rows and null ids
are rows of their own with equal keys.  An empty table gives an empty result.  A weight of a
document comes from ``labels.quality`` (1: GOOD, 0: POOR, none: UNKNOWN; the best of repeated
labels counts).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.fills import numbered, running_sum
from ..plans.scratch import materialize

CYCLE = (5, 2, 1)
SHARE = 1.5
MOST_EPOCHS = 2
GOOD, POOR, UNKNOWN = 1.0, 0.25, 0.5
RANGES = 4096
#: Goals of up to so many sources (100 bytes each) are broadcast, and they are ordered in one task; of more, joined by shuffle and ordered by ranges.
MOST_BROADCAST = 100_000
TOKEN = r"[^\x20\x09-\x0D]+"
SEED = "mix-1"


def size_of(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(TOKEN)).cast("long")


def targets(sources: DataFrame, cycle: tuple[int, ...] = CYCLE, share: float = SHARE, most: int = MOST_EPOCHS, most_sources: int = MOST_BROADCAST) -> DataFrame:
    """``sources`` (source, source_size) with ``target``.

    Weights repeat along the sources by code point.  With the sources ordered by capacity per
    weight, those before some point get their capacity and the rest shares what is left by weight.
    Up to ``most_sources`` are ordered in one task; more are ordered range by range.
    """
    sources = materialize(sources.select("source", "source_size"), "mix-sources")
    totals = sources.agg(F.count(F.lit(1)).alias("n"), F.sum("source_size").alias("size")).first()
    small = totals["n"] <= most_sources
    s = sources.withColumn("last", F.col("source").isNull())
    everything = Window.orderBy("last", "source")
    s = s.withColumn("place", F.row_number().over(everything)) if small else numbered(s, ["last", "source"], "place")
    weight = F.element_at(F.array(*map(F.lit, cycle)), ((F.col("place") - 1) % len(cycle) + 1).cast("int")).cast("double")
    s = s.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(most)).withColumn("ratio", F.col("cap") / F.col("weight"))
    order = ["ratio", "last", "source"]
    if small:
        before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        s = s.withColumns({"caps": F.coalesce(F.sum("cap").over(before), F.lit(0.0)), "weights": F.coalesce(F.sum("weight").over(before), F.lit(0.0)), "nr": F.row_number().over(Window.orderBy(*order))})
    else:
        s = numbered(running_sum(running_sum(s, order, "cap", "caps"), order, "weight", "weights"), order, "nr")
    # whole numbers as doubles: sums are exact in any order
    whole = float(sum(cycle)) * (totals["n"] // len(cycle)) + float(sum(cycle[: totals["n"] % len(cycle)]))
    s = s.withColumn("left", float(totals["size"] or 0) * share - F.col("caps")).withColumn("rest", whole - F.col("weights"))
    # the first source, in that order, that stays within its capacity sets the common level
    s = materialize(s.select("source", "source_size", "weight", "cap", "nr", "left", "rest"), "mix-order")
    first = s.where(F.col("left") * F.col("weight") / F.col("rest") <= F.col("cap")).agg(F.min(F.struct("nr", "left", "rest")).alias("f")).first().f
    if first is None:
        return s.select("source", "source_size", F.col("cap").alias("target"))
    even = F.lit(first["left"]) * F.col("weight") / F.lit(first["rest"])
    return s.select("source", "source_size", F.when(F.col("nr") < first["nr"], F.col("cap")).otherwise(F.least(even, F.col("cap"))).alias("target"))


def _uniform(*parts: Column) -> Column:
    """In (0, 1), from 52 bits of an MD5."""
    h = F.md5(F.concat_ws("\x1f", F.lit(SEED), *[F.coalesce(p, F.lit("")) for p in parts]).cast("binary"))
    return (F.conv(F.substring(h, 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)


def mix(docs: DataFrame, labels: DataFrame | None = None, ranges: int = RANGES) -> DataFrame:
    """doc_id, th (hash of the text), source, size, source_size, target, epochs (how often the whole document is taken), taken."""
    d = docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("th"))
    d = d.withColumn("u", _uniform(F.col("doc_id").cast("string"), F.col("th")))
    weight = F.lit(UNKNOWN)
    if labels is not None:
        q = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("label_id")).agg(F.max("quality").alias("quality"))
        d = d.join(q, d["doc_id"] == q["label_id"], "left").drop("label_id")
        weight = F.when(F.col("quality") >= 1, GOOD).when(F.col("quality") < 1, POOR).otherwise(UNKNOWN)
    d = d.withColumn("key", -F.log("u") / weight)
    # ranges of about equal numbers of documents, if most weigh UNKNOWN; any monotone function would do
    d = d.select("doc_id", "source", "size", "th", "key", F.floor((1 - F.exp(-UNKNOWN * F.col("key"))) * ranges).cast("int").alias("range"))
    d = materialize(d, "mix")
    sums = d.groupBy("source", "range").agg(F.sum("size").alias("words"))
    # both hold a row per source, or per source and range: numbers that don't follow the documents
    goal = targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")))
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    goal = goal.withColumn("full", full).withColumn("rest", F.col("target") - F.col("full") * F.col("source_size"))
    upto = F.sum("words").over(Window.partitionBy("source").orderBy("range"))
    edge = (
        sums.withColumn("upto", upto)
        .withColumnRenamed("source", "edge_source")
        .join(goal, F.col("edge_source").eqNullSafe(F.col("source")))
        .where(F.col("upto") > F.col("rest"))
        .groupBy("source")
        .agg(F.min(F.struct("range", (F.col("upto") - F.col("words")).alias("below"))).alias("edge"))
    )
    goal = goal.join(edge.withColumnRenamed("source", "edge_source"), F.col("edge_source").eqNullSafe(F.col("source")), "left").drop("edge_source").withColumnRenamed("source", "goal_source")
    goal = materialize(goal, "mix-goal")
    if goal.count() <= MOST_BROADCAST:
        goal = F.broadcast(goal)
    d = d.join(goal, F.col("goal_source").eqNullSafe(F.col("source")), "left").drop("goal_source")
    inside = F.col("edge").isNull() | (F.col("range") < F.col("edge.range"))
    split = F.col("edge").isNotNull() & (F.col("range") == F.col("edge.range"))
    keep = ["doc_id", "th", "source", "size", "source_size", "target"]
    even = d.where(~split).select(*keep, "full", F.when(inside, 1).otherwise(0).alias("extra"))
    running = F.sum("size").over(Window.partitionBy("source").orderBy("key", "doc_id", "th").rowsBetween(Window.unboundedPreceding, 0))
    near = F.col("edge.below") + running - F.col("size") / 2 <= F.col("rest")
    border = d.where(split).select(*keep, "full", F.when(near & (F.col("rest") > 0), 1).otherwise(0).alias("extra"))
    epochs = (F.col("full") + F.col("extra")).cast("long")
    return even.unionByName(border).select(*keep, epochs.alias("epochs"), (epochs * F.col("size")).alias("taken"))


def report(docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    return mix(docs, labels).select("doc_id", "size", "source_size", "target", "taken")


def apply_mix(docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it."""
    m = mix(docs, labels).where("epochs > 0").groupBy(F.col("doc_id").alias("__mix_id"), F.col("th").alias("__mix_h")).agg(F.max("epochs").cast("int").alias("__mix_n"))
    same = F.col("__mix_id").eqNullSafe(docs["doc_id"]) & (F.col("__mix_h") == F.md5(F.coalesce(docs["text"], F.lit("")).cast("binary")))
    return docs.join(m, same).select(*docs.columns, F.explode(F.array_repeat(F.lit(0), F.col("__mix_n"))).alias("__mix_i")).select(*docs.columns)


SQL = rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{TOKEN}')) AS size, md5(coalesce(text, '')) AS th FROM documents),
q AS (SELECT doc_id AS label_id, max(quality) AS quality FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
k AS (SELECT d.*, -ln((('0x' || substr(md5('{SEED}' || chr(31) || coalesce(CAST(doc_id AS VARCHAR), '') || chr(31) || th), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE)
    / CASE WHEN quality >= 1 THEN {GOOD}::DOUBLE WHEN quality < 1 THEN {POOR}::DOUBLE ELSE {UNKNOWN}::DOUBLE END AS key
  FROM d LEFT JOIN q ON doc_id = label_id),
s AS (SELECT source, sum(size)::BIGINT AS source_size, ([5, 2, 1])[((row_number() OVER (ORDER BY source ASC NULLS LAST)) - 1) % 3 + 1]::DOUBLE AS weight FROM k GROUP BY source),
c AS (SELECT *, source_size * {MOST_EPOCHS}::DOUBLE AS cap FROM s),
o AS (SELECT *, sum(source_size) OVER ()::DOUBLE * {SHARE}::DOUBLE - coalesce(sum(cap) OVER b, 0) AS lft, sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS rst,
    row_number() OVER (ORDER BY cap / weight, source ASC NULLS LAST) AS nr FROM c
  WINDOW b AS (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT nr, lft, rst FROM o WHERE lft * weight / rst <= cap ORDER BY nr LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN f.nr IS NULL OR o.nr < f.nr THEN cap ELSE least(f.lft * weight / f.rst, cap) END AS target FROM o LEFT JOIN f ON true),
g AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM t),
r AS (SELECT k.doc_id, k.size, g.source_size, g.target, g.epochs, g.target - g.epochs * g.source_size AS rest,
    sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.th ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running FROM k JOIN g ON k.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(size * (epochs + CASE WHEN rest > 0 AND running - size / 2.0::DOUBLE <= rest THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM r"""

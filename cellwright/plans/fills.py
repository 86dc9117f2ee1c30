"""Numbering and running sums over an order of all rows, without one task that sorts them all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import materialize


def _kept(ranged: DataFrame, label: str) -> DataFrame:
    """``ranged`` with the partition ``__pid`` of each row, written to the shared folder and read back.

    Bounds are sampled and partitions coalesced anew in each use of a range partitioning, so partition numbers are only
    good for a join if all uses take them from the same written rows.
    """
    return materialize(ranged.withColumn("__pid", F.spark_partition_id()), label)


def numbered(df: DataFrame, order: list[str], name: str, within: list[str] | None = None) -> DataFrame:
    """``df`` with row numbers from 1 by ``order``: ranges of rows are sorted apart, and numbers go on from the sizes of the ranges before.

    ``within``: an order for the rows of a range that agrees with ``order`` and goes on where that ties.
    """
    ranged = df.repartitionByRange(*[F.col(f"`{o}`") for o in order]).sortWithinPartitions(*[F.col(f"`{o}`") for o in within or order])
    ranged = _kept(ranged.withColumn("__at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "fills-numbers")
    sizes = ranged.groupBy("__pid").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # one row per partition
    starts = sizes.select("__pid", before.alias("__before"))
    return ranged.join(F.broadcast(starts), "__pid").withColumn(name, F.col("__before") + F.col("__at") + 1).drop("__pid", "__at", "__n", "__before")


def last_at_or_before(queries: DataFrame, key: str, steps: DataFrame, at: str, value: str, name: str, falling: bool = False) -> DataFrame:
    """``queries`` with, as ``name``, the ``value`` of the last step whose ``at`` is not above ``key`` (an as-of join).

    Both sides are dealt to ranges of the key together; what a range begins with comes from the ranges before it.
    ``falling``: of the last step, downwards, whose ``at`` is not below ``key``.
    """
    kind = steps.schema[value].dataType
    rows = queries.select(F.col(key).alias("__k"), F.lit(1).alias("__side"), F.lit(None).cast(kind).alias("__v"), F.struct("*").alias("__row"))
    marks = steps.select(F.col(at).alias("__k"), F.lit(0).alias("__side"), F.col(value).alias("__v"), F.lit(None).cast(rows.schema["__row"].dataType).alias("__row"))
    order = F.col("__k").desc() if falling else F.col("__k").asc()
    ranged = _kept(rows.unionByName(marks).repartitionByRange(order), "fills-steps")
    here = F.last("__v", ignorenulls=True).over(Window.partitionBy("__pid").orderBy(order, "__side").rowsBetween(Window.unboundedPreceding, 0))
    ends = ranged.groupBy("__pid").agg((F.min_by if falling else F.max_by)("__v", F.when(F.col("__side") == 0, F.col("__k"))).alias("__end"))
    # one row per partition
    before = ends.select("__pid", F.last("__end", ignorenulls=True).over(Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)).alias("__before"))
    out = ranged.withColumn("__here", here).join(F.broadcast(before), "__pid").where("__side = 1")
    return out.select("__row.*", F.coalesce("__here", "__before").alias(name))


def running_extreme(df: DataFrame, order: list[str], value: str, name: str, least: bool = False) -> DataFrame:
    """``df`` with the maximum (or minimum) of ``value`` over the rows up to each by ``order``, range by range."""
    of, both = (F.min, F.least) if least else (F.max, F.greatest)
    ranged = _kept(df.repartitionByRange(*order), "fills-extremes")
    here = of(value).over(Window.partitionBy("__pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    ends = ranged.groupBy("__pid").agg(of(value).alias("__end"))
    before = ends.select("__pid", of("__end").over(Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)).alias("__before"))
    return ranged.withColumn(name, here).join(F.broadcast(before), "__pid").withColumn(name, both(name, "__before")).drop("__pid", "__before")


def running_sum(df: DataFrame, order: list[str], value: str, name: str, by: list[str] | None = None) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows before each by ``order``, within ``by``; 0 for the first.

    A key of ``by`` may span many ranges: its sums go on from one to the next.
    """
    by = by or []
    ranged = _kept(df.repartitionByRange(*by, *order), "fills-sums")
    here = F.sum(value).over(Window.partitionBy("__pid", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    ends = ranged.groupBy("__pid", *by).agg(F.sum(value).alias("__end"))
    earlier = F.sum("__end").over(Window.partitionBy(*by or [F.lit(1)]).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1))
    # at most one row per partition: the key that goes on from the range before
    before = ends.select(F.col("__pid").alias("__range"), *[F.col(b).alias(f"__by_{b}") for b in by], earlier.alias("__before")).where("__before IS NOT NULL")
    same = F.col("__range") == F.col("__pid")
    for b in by:
        same &= F.col(f"__by_{b}").eqNullSafe(F.col(b))
    out = ranged.withColumn(name, here).join(F.broadcast(before), same, "left")
    return out.withColumn(name, F.coalesce(name, F.lit(0)) + F.coalesce("__before", F.lit(0))).drop("__pid", "__range", "__before", *[f"__by_{b}" for b in by])

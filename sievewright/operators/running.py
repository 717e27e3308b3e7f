"""Running sums and as-of lookups along an order, without a task that holds all rows of a key.

Rows are cut by ranges of key and order, so a key of many rows is cut in several ranges. Each range adds up on its own; the
ranges' totals, a row for each key and range, give what came before a range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stored import stored

CUTS = 64


def _cut(df: DataFrame, key: str, order: list[str], cuts: int) -> DataFrame:
    """``df`` with ``cut``, the range of each row, stored so that it stays; a range has rows of one stretch of the order."""
    return stored(df.repartitionByRange(cuts, key, *order).withColumn("cut", F.spark_partition_id()), "ranges")


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def running_before(df: DataFrame, key: str, order: list[str], value: str, cuts: int = CUTS) -> DataFrame:
    """``df`` with ``before``: the sum of ``value`` over the rows of the same ``key`` that come earlier in ``order``, which must tell
    the rows of a key apart. Nulls are a key like any other and count as 0; an empty table stays empty."""
    rows = _cut(df, key, order, cuts)
    zero = lambda c: F.coalesce(c, F.lit(0))
    totals = rows.groupBy(F.col(key).alias("k"), F.col("cut").alias("c")).agg(zero(F.sum(value)).alias("total"))
    earlier = Window.partitionBy("k").orderBy("c").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("k", "c", zero(F.sum("total").over(earlier)).alias("offset"))
    here = Window.partitionBy(key, "cut").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumn("here", zero(F.sum(value).over(here)))
    j = local.join(offsets, _same(F.col(key), F.col("k")) & (F.col("cut") == F.col("c")))
    return j.withColumn("before", F.col("here") + F.col("offset")).drop("k", "c", "cut", "here", "offset")


def latest_before(asked: DataFrame, known: DataFrame, key: str, time: str, value: str, cuts: int = CUTS) -> DataFrame:
    """``asked`` with ``value`` of the last row of ``known(key, time, value)`` that has its key and an earlier time or the same, and how
    it was found: ``before``; else the key's first row, ``first``; else null, ``none``.

    Both sides are one sequence along time in which the last known value is carried on; there is no join by ranges. Of known
    rows of one time the largest value counts. Null keys and times find nothing.
    """
    id_ = "asked_row"
    asked = stored(asked.withColumn(id_, F.monotonically_increasing_id()), "asked")
    known = known.where(F.col(key).isNotNull() & F.col(time).isNotNull()).groupBy(key, time).agg(F.max(value).alias(value))
    both = known.select(key, time, value, F.lit(0).alias("side"), F.lit(None).cast("long").alias(id_)).unionByName(asked.where(F.col(key).isNotNull() & F.col(time).isNotNull()).select(key, time, F.lit(None).cast(known.schema[value].dataType).alias(value), F.lit(1).alias("side"), id_))
    order = [time, "side", id_]
    rows = _cut(both, key, order, cuts)
    seen = F.when(F.col("side") == 0, F.struct(F.col(value).alias("v")))
    last = rows.groupBy(F.col(key).alias("k"), F.col("cut").alias("c")).agg(F.max_by(seen, F.when(F.col("side") == 0, F.col(time))).alias("last"), F.min_by(seen, F.when(F.col("side") == 0, F.col(time))).alias("head"))
    earlier, later = (Window.partitionBy("k").orderBy("c").rowsBetween(*x) for x in ((Window.unboundedPreceding, -1), (Window.unboundedPreceding, Window.unboundedFollowing)))
    carried = last.select("k", "c", F.last("last", True).over(earlier).alias("carried"), F.first("head", True).over(later).alias("head"))
    here = Window.partitionBy(key, "cut").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumn("here", F.last(seen, True).over(here)).where("side = 1").select(key, "cut", id_, "here")
    j = local.join(carried, (F.col(key) == F.col("k")) & (F.col("cut") == F.col("c"))).select(F.col(id_).alias("r"), F.coalesce("here", "carried").alias("before"), "head")
    out = asked.join(j, F.col(id_) == F.col("r"), "left")
    how = F.when(F.col("before").isNotNull(), "before").when(F.col("head").isNotNull(), "first").otherwise("none")
    return out.withColumns({value: F.coalesce("before", "head")["v"], "found": how}).drop(id_, "r", "before", "head")

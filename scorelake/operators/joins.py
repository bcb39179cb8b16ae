"""As-of, nearest, range and interval joins as equi-joins and windows.

Spark plans a join on inequalities alone as a nested loop. These helpers always have an equality to hash on: a shared
key, a bucket of the time axis, or both sides in one window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, since: str, values: list[str], tolerance: float = 0.0, before_first: str = "null") -> DataFrame:
    """``left`` with the ``values`` of the last ``right`` row of the same keys whose ``since`` <= ``at`` + tolerance.

    Both sides go through one window over a union: one shuffle on the keys, no row meets more than its predecessor.
    Rows of ``right`` with equal times: the one with the greatest values wins. before_first: "null", or "first" for the
    first right row of the key. A left row whose keys have no right row gets nulls."""
    picked = F.struct(*(F.col(v) for v in values))
    rows = left.select(*keys, F.col(at).alias("_t"), F.lit(1).alias("_side"), F.struct("*").alias("_left"), F.lit(None).cast(right.select(picked.alias("x")).schema["x"].dataType).alias("_right"))
    marks = right.select(*keys, (F.col(since) - F.lit(tolerance)).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(rows.schema["_left"].dataType).alias("_left"), picked.alias("_right"))
    order = W.partitionBy(*keys).orderBy("_t", "_side", "_right")
    found = F.last("_right", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    if before_first == "first":
        found = F.coalesce(found, F.first("_right", ignorenulls=True).over(order.rowsBetween(W.currentRow, W.unboundedFollowing)))
    return rows.unionByName(marks).withColumn("_found", found).where("_side = 1").select("_left.*", *(F.col(f"_found.{v}").alias(v) for v in values))


def nearest(left: DataFrame, right: DataFrame, keys: list[str], at: str, time: str, out: str) -> DataFrame:
    """``left`` with ``out``: the time of the nearest ``right`` row of the same keys, the earlier one on a tie."""
    rows = left.select(*keys, F.col(at).alias("_t"), F.struct("*").alias("_left"))
    marks = right.select(*keys, F.col(time).alias("_t"), F.lit(None).cast(rows.schema["_left"].dataType).alias("_left"))
    both = rows.withColumn("_m", F.lit(None).cast("double")).unionByName(marks.withColumn("_m", F.col("_t").cast("double")))
    order = W.partitionBy(*keys).orderBy("_t")
    back = F.last("_m", ignorenulls=True).over(order.rangeBetween(W.unboundedPreceding, W.currentRow))
    ahead = F.first("_m", ignorenulls=True).over(order.rangeBetween(W.currentRow, W.unboundedFollowing))
    near = F.when(F.col("_b").isNull(), F.col("_a")).when(F.col("_a").isNull(), F.col("_b")).when(F.col("_a") - F.col("_t") < F.col("_t") - F.col("_b"), F.col("_a")).otherwise(F.col("_b"))
    return both.withColumn("_b", back).withColumn("_a", ahead).where("_left is not null").select("_left.*", near.alias(out))


def range_join(windows: DataFrame, points: DataFrame, keys: list[str], lo: str, hi: str, at: str, width: float) -> DataFrame:
    """Pairs with lo <= at <= hi and equal keys. A window is listed in every bucket of ``width`` it touches, a point in
    its own, and the join is on keys and bucket, so a pair is found exactly once. Choose ``width`` near the windows'
    usual length: a window is copied into (hi - lo) / width + 1 buckets."""
    bucket = lambda c: F.floor(c / F.lit(width))
    spread = windows.where(F.col(lo) <= F.col(hi)).withColumn("_bucket", F.explode(F.sequence(bucket(F.col(lo)), bucket(F.col(hi)))))
    placed = points.withColumn("_bucket", bucket(F.col(at)))
    return spread.join(placed, [*keys, "_bucket"]).where(F.col(at).between(F.col(lo), F.col(hi))).drop("_bucket")


def overlaps(start: Column, end: Column, lo: Column, hi: Column) -> Column:
    """Interval overlap in which a missing end stands for the start and the other way round."""
    return (F.coalesce(end, start) >= lo) & (F.coalesce(start, end) <= hi)


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in a complete order."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")

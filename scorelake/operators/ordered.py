"""Ordered analytics within a session: tempo, gaps, islands, running starts, grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def local_tempo(notes: DataFrame, key: str, order: str, score: str, perf: str, reach: int = 4, least: int = 3) -> DataFrame:
    """``tempo``: score span over performance span, times 120, over ``reach`` rows to each side."""
    w = W.partitionBy(key).orderBy(order)
    span = w.rowsBetween(-reach, reach)
    d_score, d_perf = F.last(score).over(span) - F.first(score).over(span), F.last(perf).over(span) - F.first(perf).over(span)
    good = (F.count(F.lit(1)).over(span) >= least) & (d_score > 1e-9) & (d_perf > 1e-9)
    return notes.withColumn("tempo", F.when(good, d_score / d_perf * 120.0))


def bar_durations(bars: DataFrame, key: str, start: str, out: str = "duration") -> DataFrame:
    """Time to the next bar; the last bar gets the median of the positive ones, or 0."""
    gap = F.lead(start).over(W.partitionBy(key).orderBy(start)) - F.col(start)
    with_gap = bars.withColumn("_gap", gap)
    median = F.median(F.when(F.col("_gap") > 0, F.col("_gap"))).over(W.partitionBy(key))
    return with_gap.withColumn(out, F.coalesce("_gap", median, F.lit(0.0))).drop("_gap")


def inter_onset(notes: DataFrame, key: str, order: list[str], time: str) -> DataFrame:
    """Positive gaps to the previous note as ``ioi``."""
    gap = F.col(time) - F.lag(time).over(W.partitionBy(key).orderBy(*order))
    return notes.withColumn("ioi", F.when(gap > 0, gap))


def islands(df: DataFrame, keys: list[str], order: list[str], member: Column) -> DataFrame:
    """Rows for which ``member`` holds, with ``island``: the number of the run of such rows they stand in."""
    every, own = W.partitionBy(*keys).orderBy(*order), W.partitionBy(*keys, "_in").orderBy(*order)
    numbered = df.withColumn("_in", member).withColumn("_all", F.row_number().over(every))
    return numbered.withColumn("island", F.col("_all") - F.row_number().over(own)).where("_in").drop("_in", "_all")


def gap_islands(df: DataFrame, keys: list[str], at: str, most: float) -> DataFrame:
    """``island``: runs of rows that lie no more than ``most`` apart, numbered from 0."""
    w = W.partitionBy(*keys).orderBy(at)
    starts = F.coalesce(F.col(at) - F.lag(at).over(w) > most, F.lit(False)).cast("bigint")
    return df.withColumn("_s", starts).withColumn("island", F.sum("_s").over(w.rowsBetween(W.unboundedPreceding, W.currentRow))).drop("_s")


def running_starts(df: DataFrame, keys: list[str], order: list[str], starts: Column, out: str) -> DataFrame:
    """``out``: how many rows up to this one start something new."""
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return df.withColumn("_s", starts.cast("bigint")).withColumn(out, F.sum("_s").over(w)).drop("_s")


def dense_spine(ranges: DataFrame, keys: list[str], lo: str, hi: str, out: str) -> DataFrame:
    """A row for every whole number from lo to hi of each key."""
    return ranges.where(F.col(lo) <= F.col(hi)).select(*keys, F.explode(F.sequence(lo, hi)).alias(out))


def average_rank(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Ranks in which equal values share their mean rank. Both windows have one order, so that a task sorts but once."""
    order = W.partitionBy(*keys).orderBy(value)
    same = order.rangeBetween(W.currentRow, W.currentRow)
    return df.withColumn(out, F.rank().over(order) + (F.count(F.lit(1)).over(same) - 1) / 2.0)


def cumulative_floor(df: DataFrame, keys: list[str], order: list[str], weight: str, total: Column, out: str) -> DataFrame:
    """Shares ``total`` by weight: differences of the floored running shares, so that they add up exactly."""
    w = W.partitionBy(*keys).orderBy(*order)
    upto = F.sum(weight).over(w.rowsBetween(W.unboundedPreceding, W.currentRow))
    end = F.floor(total * upto / F.sum(weight).over(W.partitionBy(*keys)) + 1e-9)
    return df.withColumn("_end", end).withColumn(out, F.col("_end") - F.coalesce(F.lag("_end").over(w), F.lit(0))).drop("_end")

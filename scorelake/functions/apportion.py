"""Whole numbers of bars dealt to systems by weight, as array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: weights that differ from their mean by no more than this share of it count as alike.
ALIKE = 0.08


def _let(value: Column, use) -> Column:
    """``use`` of a value that is made once, however often it is named."""
    return F.transform(F.array(value), use)[0]


def _add(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)


def dealt_bars(total: Column, weights: Column) -> Column:
    """An array of bars, as many as ``weights`` has, that add up to ``total``.

    Alike weights give equal numbers; of the bars left over the last system gets the first, then the ones from the second
    on. Others are dealt at the whole numbers that the running share of the weights passes, and if there are bars enough,
    a system left without takes one from the system that has most, the first of several. Weights below zero count as
    zero, and if none is above it all are alike; an empty array stays empty."""
    positive = F.transform(weights, lambda w: F.greatest(F.lit(0.0), w.cast("double")))

    def raw_and_used(positive: Column) -> Column:
        some, ones = _add(positive) > 0, F.transform(weights, lambda w: F.lit(1.0))
        return F.struct(F.when(some, F.transform(weights, lambda w: w.cast("double"))).otherwise(ones).alias("raw"), F.when(some, positive).otherwise(ones).alias("used"))

    def sums(x: Column) -> Column:
        return F.struct(total.cast("bigint").alias("total"), F.size(weights).alias("n"), x["raw"].alias("raw"), x["used"].alias("used"), _add(x["used"]).alias("whole"))

    return _let(_let(_let(positive, raw_and_used), sums), _dealt)


def _dealt(x: Column) -> Column:
    total, n, used, whole = x["total"], x["n"], x["used"], x["whole"]
    mean = whole / F.nullif(n, F.lit(0))
    alike = _let(mean, lambda m: F.array_max(F.transform(x["raw"], lambda w: F.abs(w - m))) <= m * ALIKE)
    base = F.floor(total / F.nullif(n, F.lit(0)))
    even = _let(base, lambda b: F.transform(used, lambda _, i: b + F.when((i == n - 1) & (total - b * n > 0), 1).when((i >= 1) & (i < n - 1) & (i < total - b * n), 1).otherwise(0)))
    start = F.struct(F.lit(0.0).alias("upto"), F.expr("cast(array() as array<bigint>)").alias("ends"))
    ends = F.aggregate(used, start, lambda acc, w: F.struct((acc["upto"] + w).alias("upto"), F.concat(acc["ends"], F.array(F.floor(total * (acc["upto"] + w) / whole))).alias("ends")))["ends"]
    passed = _let(ends, lambda e: F.transform(e, lambda end, i: F.when(i == n - 1, total).otherwise(end) - F.when(i == 0, F.lit(0).cast("bigint")).otherwise(F.get(e, i - 1))))

    def give(counts: Column, i: Column) -> Column:
        most = F.array_position(counts, F.array_max(counts)) - 1
        return F.when(F.array_max(counts) <= 1, counts).otherwise(_let(most, lambda at: F.transform(counts, lambda c, j: c + (j == i).cast("bigint") - (j == at).cast("bigint"))))

    # who has one keeps one, so only the systems without are gone through
    without = lambda counts: F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.get(counts, i) <= 0)
    mended = _let(passed, lambda counts: F.aggregate(without(counts), counts, give))
    return F.when(n == 0, F.expr("cast(array() as array<bigint>)")).when(alike, even).otherwise(F.when(total >= n, mended).otherwise(passed))

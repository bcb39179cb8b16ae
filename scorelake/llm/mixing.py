"""Mixing sources to target weights by hash thresholds, without sorting.

Each document has a fixed 60-bit hash. Sizes are summed by source and by the hash's first 10 bits; the prefix sums of
such a histogram tell in which bucket a source's budget ends, and only the documents of that bucket are summed again
by the next 10 bits, until the bits are used up. What remains is one threshold per source and budget, applied as a
filter. Larger budgets have larger thresholds over the same hashes, so their selections are nested.

A histogram has at most 1024 rows per source and is summed within the input partitions first, so a source that holds
a third of all rows costs no more than another.

Defined cases: a null text has size 0; null sources form one source, the last; the hash is over id and text, so that
documents with one id (or none) are told apart, and only rows that repeat both are taken or left together, so that a sum
misses its target by half of the boundary document's or such rows' size at most; a table without words gives targets of 0; an empty table gives no rows; other
columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scorelake.llm.common import SPACE, free_name, scratch

BITS, LEVEL = 60, 10
#: Sources whose plan may be broadcast to the documents; with more of them Spark joins by a shuffle.
BROADCAST_SOURCES = 100_000


def size_of(text: Column) -> Column:
    """Words of a whole text: runs of anything but ASCII white space."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("bigint")


def hash_of(doc_id: Column, text: Column) -> Column:
    """The first 60 bits of the md5 of id and text, as a number that any SQL engine can reproduce."""
    both = F.concat(F.coalesce(doc_id.cast("bigint").cast("string"), F.lit("")), F.lit("|"), F.coalesce(text.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(both.cast("binary")), 1, 15), 16, 10).cast("bigint")


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, h: the only pass over the texts, written to the shared folder."""
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        size_of(F.col("text")).alias("size"),
        hash_of(F.col("doc_id"), F.col("text")).alias("h"),
    )
    return scratch(rows, "sized")


def targets(rows: DataFrame, weights: tuple[float, ...], most: float, budget: float = 1.0) -> DataFrame:
    """source, source_size, target. Weights repeat over the sources in code-point order, null last; together they share
    ``budget`` times all sizes; a target above ``most`` times its source's size stops there and the rest is shared
    again. Each round is an aggregation over the sources, and the last one changes nothing."""
    cycle = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1)
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = sources.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))).withColumn("weight", cycle)
    ranked = scratch(ranked.withColumn("stop", F.lit(float(most)) * F.col("source_size")), "sources")
    total = float(ranked.agg(F.sum("source_size")).first()[0] or 0) * budget
    level, capped = 0.0, -1
    while True:
        full = F.col("stop") <= F.lit(level) * F.col("weight")
        n, used, free = ranked.agg(F.count_if(full), F.coalesce(F.sum(F.when(full, F.col("stop"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0))).first()
        if n == capped or not free:
            break
        capped, level = n, (total - used) / free
    target = F.when(F.col("stop") <= F.lit(level) * F.col("weight"), F.col("stop")).otherwise(F.lit(level) * F.col("weight"))
    return ranked.select("source", "source_size", "weight", target.alias("target"))


def thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """``budgets`` (source, budget_id, rest) with ``threshold``: documents of the source with h below it have
    together a size as near to ``rest`` as a threshold can bring it: the boundary document, or the rows that repeat its
    id and text, goes in if the sum is nearer to ``rest`` with it than without."""
    step = budgets.select("source", "budget_id", F.col("rest").cast("double").alias("rest"), F.lit(0).cast("bigint").alias("start"))
    left = rows.select("source", "size", "h")
    for level in range(BITS // LEVEL):
        shift = BITS - LEVEL * (level + 1)
        bucket = F.shiftright(F.col("h"), shift)
        hist = left.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("n"))
        if level:  # buckets of the boundary that the last level found, once for each budget that ends there
            parent = F.shiftleft(F.shiftright(F.col("h.bucket"), LEVEL), LEVEL + shift)
        else:
            parent = F.lit(0).cast("bigint")
        here = step.alias("s").join(hist.alias("h"), F.col("s.source").eqNullSafe(F.col("h.source")) & (parent == F.col("s.start")), "left")
        w = W.partitionBy("source", "budget_id").orderBy("bucket").rowsBetween(W.unboundedPreceding, W.currentRow)
        here = here.select("s.source", "budget_id", "rest", "start", "bucket", F.coalesce("n", F.lit(0)).alias("n")).withColumn("upto", F.sum("n").over(w))
        over = F.col("upto") > F.col("rest")
        step = scratch(
            here.groupBy("source", "budget_id", "rest", "start")
            .agg(F.min(F.when(over, F.col("bucket"))).alias("first"), F.min_by(F.when(over, F.col("n")), F.when(over, F.col("bucket"))).alias("edge"), F.coalesce(F.max(F.when(~over, F.col("upto"))), F.lit(0)).alias("below"))
            .select(
                "source",
                "budget_id",
                (F.col("rest") - F.col("below")).alias("rest"),
                # no bucket goes over: all of them fit, the threshold is the end of the parent bucket
                F.when(F.col("first").isNotNull(), F.shiftleft(F.col("first"), shift)).otherwise(F.col("start") + F.lit(1 << (shift + LEVEL))).alias("start"),
                F.col("first").isNotNull().alias("open"),
                "edge",
            ),
            "boundary",
        )
        if level == 0:
            done = None
        closed = step.where(~F.col("open")).drop("open", "edge")
        done = closed if done is None else done.unionByName(closed)
        step = step.where("open").drop("open")
        if shift == 0:  # one hash is left: what has it goes in if the sum is nearer to the budget with it
            step = step.withColumn("start", F.col("start") + F.when(F.col("edge") < 2 * F.col("rest"), 1).otherwise(0))
        step = step.drop("edge")
        edge = step.select("source", F.shiftright(F.col("start"), shift).alias("bucket")).distinct()
        left = left.alias("r").join(edge.alias("e"), F.col("r.source").eqNullSafe(F.col("e.source")) & (F.shiftright(F.col("r.h"), shift) == F.col("e.bucket")), "left_semi")
        if not level:  # about a thousandth of the rows is left: later levels read these only
            left = scratch(left, "boundary-rows")
    return done.unionByName(step).select("source", "budget_id", F.col("start").alias("threshold"))


def plan(rows: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: int = 3, budget: float = 1.0) -> DataFrame:
    """A row per source: source_size, target, ``whole`` (how often all of its documents are taken) and ``threshold``
    (documents with h below it are taken once more)."""
    goal = targets(rows, weights, most, budget)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    goal = goal.withColumn("whole", whole.cast("bigint")).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    ends = thresholds(rows, goal.withColumn("budget_id", F.lit(0)))
    planned = goal.alias("g").join(ends.alias("e"), F.col("g.source").eqNullSafe(F.col("e.source"))).select("g.source", "source_size", "target", "whole", "threshold")
    planned = scratch(planned, "plan")
    return F.broadcast(planned) if planned.count() <= BROADCAST_SOURCES else planned


def _times() -> Column:
    return F.col("whole") + F.when(F.col("h") < F.col("threshold"), F.lit(1)).otherwise(F.lit(0))


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: int = 3, budget: float = 1.0) -> DataFrame:
    """doc_id, size, source_size, target, taken. A source's documents are taken target/source_size times: the whole
    part for all of them, the rest for those below the source's threshold."""
    rows = sized(docs)
    goal = plan(rows, weights, most, budget)
    joined = rows.alias("r").join(goal.alias("g"), F.col("r.source").eqNullSafe(F.col("g.source")))
    return joined.select("doc_id", "size", "source_size", "target", (F.col("size") * _times()).cast("bigint").alias("taken"))


def mixed(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: int = 3, budget: float = 1.0) -> DataFrame:
    """The mix itself: each document's row as often as it is taken. Only the row per source meets the documents."""
    goal = plan(sized(docs), weights, most, budget).alias("g")
    joined = docs.alias("d").join(goal, F.col("d.source").cast("string").eqNullSafe(F.col("g.source")))
    times = F.col("g.whole") + F.when(hash_of(F.col("d.doc_id"), F.col("d.text")) < F.col("g.threshold"), F.lit(1)).otherwise(F.lit(0))
    name = free_name(docs, "_times")
    copies = F.explode(F.sequence(F.lit(1), F.col(name).cast("int"))).alias(name)
    return joined.select("d.*", times.alias(name)).where(F.col(name) > 0).select(*(F.col(f"`{c}`") for c in docs.columns), copies).drop(name)

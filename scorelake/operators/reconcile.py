"""Scanned layouts against the bars that a piece's MIDI file has: which movement is played, how many bars its systems get,
and what still does not fit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scorelake.functions.apportion import ALIKE, dealt_bars

#: The source whose layouts have movements; layouts of any other are fitted as a whole.
RECOGNISED = "recognised"
# Widths of systems that can be, in shares of the page, and the fewest and most bars that count as weight;
# bars by which a layout may differ.
NARROW, WIDE, FEWEST, MOST, NEAR = 0.05, 1.05, 2.0, 6.0, 1


def with_weights(systems: DataFrame) -> DataFrame:
    """``systems`` with ``weights``, an array beside those of widths and bars: the widths where they are alike, else the mean
    of the shares of width and of bars, else whichever there is. Step by step in columns, so that no sum is written out
    anew for every element."""
    add = lambda name: F.aggregate(name, F.lit(0.0), lambda s, x: s + x)
    rows = systems.withColumn("_w", F.transform("widths", lambda x: F.when(x.between(NARROW, WIDE), x.cast("double")).otherwise(0.0)))
    rows = rows.withColumn("_b", F.transform("bars", lambda x: F.greatest(F.lit(FEWEST), F.least(F.lit(MOST), F.coalesce(x, F.lit(0)).cast("double")))))
    rows = rows.withColumn("_there", F.filter("_w", lambda x: x > 0)).withColumn("_ws", add("_w")).withColumn("_bs", add("_b"))
    alike = (F.size("_there") > 0) & (F.array_max("_there") - F.array_min("_there") <= F.col("_ws") / F.nullif(F.size("_there"), F.lit(0)) * ALIKE)
    both = F.transform(F.arrays_zip("_w", "_b"), lambda x: 0.5 * x["_w"] / F.col("_ws") + 0.5 * x["_b"] / F.col("_bs"))
    return rows.withColumn("weights", F.when(alike, F.col("_w")).when(F.col("_ws") <= 0, F.col("_b")).otherwise(both)).drop("_w", "_b", "_there", "_ws", "_bs")


def with_played(systems: DataFrame) -> DataFrame:
    """``systems`` (with total and hint of the piece's file) with ``played``: of recognised layouts the movement that the
    file's name hints at, if there is one of that number, else the one whose bars come nearest to the file's, the first of
    several."""
    own = F.col("source") == RECOGNISED
    counted = systems.withColumn("_n", F.sum(F.when(own, F.col("bars"))).over(W.partitionBy("piece", "movement")))
    rank = F.struct((F.col("movement") != F.coalesce("hint", F.lit(-1))).alias("a"), F.abs(F.col("_n") - F.col("total")).alias("b"), "movement")
    able = own & F.col("movement").isNotNull() & F.col("total").isNotNull()
    return counted.withColumn("played", F.min(F.when(able, rank)).over(W.partitionBy("piece"))["movement"]).drop("_n")


def reconciled(systems: DataFrame, midi: DataFrame) -> DataFrame:
    """``systems`` (piece, source, page, system, movement, width, bars) with found (the bars before), bars (those dealt), fitted.

    midi: piece, total (null or 0: unknown), hint. Of a recognised layout the played movement's systems share the file's
    bars; of another all systems do, if its bars differ from the file's by more than one. All of it is done where a piece's
    systems are, with one shuffle: they are put side by side, those that share the bars first."""
    rows = with_played(systems.repartition("piece").join(midi.select("piece", "total", "hint"), "piece", "left")).withColumn("_layout", F.sum("bars").over(W.partitionBy("piece")))
    known = F.coalesce(F.col("total") > 0, F.lit(False))
    own = known & F.when(F.col("source") == RECOGNISED, F.col("movement").eqNullSafe(F.col("played")) & F.col("played").isNotNull()).otherwise(F.abs(F.col("_layout") - F.col("total")) > NEAR)
    one = F.struct((~F.coalesce(own, F.lit(False))).alias("other"), "page", "system", "width", "bars", "source", "movement", own.alias("fitted"))
    pieces = rows.groupBy("piece", "total", "played").agg(F.sort_array(F.collect_list(one)).alias("_x"))
    pieces = pieces.withColumn("_fit", F.filter("_x", lambda s: ~s["other"])).withColumn("widths", F.col("_fit")["width"]).withColumn("bars", F.col("_fit")["bars"])
    dealt = with_weights(pieces).withColumn("_new", dealt_bars(F.col("total"), F.col("weights")))
    out = dealt.select("piece", "total", "played", "_new", F.posexplode("_x").alias("i", "s"))
    bars = F.when(~F.col("s.other"), F.get("_new", F.col("i"))).otherwise(F.col("s.bars").cast("bigint"))
    return out.select("piece", "s.source", "s.page", "s.system", "s.movement", "s.width", F.col("s.bars").alias("found"), bars.alias("bars"), "s.fitted", "played", "total")


def summary(fitted: DataFrame) -> DataFrame:
    """piece, source, layout_bars, midi_bars, played, played_bars, redistributed, mismatch of every piece after the fit."""
    own = F.col("movement").eqNullSafe(F.col("played")) & F.col("played").isNotNull()
    rows = fitted.groupBy("piece", "source", "played", "total").agg(F.sum("bars").alias("layout_bars"), F.sum(F.when(own, F.col("bars"))).alias("played_bars"), F.bool_or("fitted").alias("redistributed"))
    basis = F.coalesce("played_bars", "layout_bars")
    text = F.concat(F.col("source"), F.lit("="), basis.cast("string"), F.lit(" midi="), F.col("total").cast("string"))
    return rows.select("piece", "source", "layout_bars", F.col("total").alias("midi_bars"), "played", "played_bars", "redistributed", F.when(F.abs(basis - F.col("total")) > NEAR, text).alias("mismatch"))

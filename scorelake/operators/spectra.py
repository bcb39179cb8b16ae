"""Kernels over spectra in array columns, with built-in array functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scorelake.operators import joins


def median_of(values: Column) -> Column:
    """The median of an array without nulls."""
    s, n = F.sort_array(values), F.size(values)
    return (F.element_at(s, ((n + 1) / 2).cast("int")) + F.element_at(s, (n / 2 + 1).cast("int"))) / 2


def band(mag: Column, bin_: int, reach: int) -> Column:
    """The largest magnitude within ``reach`` bins of ``bin_`` (counted from 0)."""
    return F.array_max(F.slice(mag, bin_ - reach + 1, 2 * reach + 1))


def peaks(frames: DataFrame, ratio: float) -> DataFrame:
    """``bin`` (from 0) of the largest inner magnitude, ``shift`` of the parabola through it and its neighbours, and
    whether it stands out against the median."""
    inner = F.slice("mag", F.lit(2), F.size("mag") - 2)
    at = frames.withColumn("k", (F.array_position(inner, F.array_max(inner)) + 1).cast("int"))
    x = at.withColumn("a", F.element_at("mag", F.col("k") - 1)).withColumn("b", F.element_at("mag", F.col("k"))).withColumn("c", F.element_at("mag", F.col("k") + 1))
    bend = F.col("a") - 2 * F.col("b") + F.col("c")
    shift = F.when(bend == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.lit(0.5) * (F.col("a") - F.col("c")) / F.nullif(bend, F.lit(0.0)))))
    return x.select("session_id", "frame_idx", (F.col("k") - 1).alias("bin"), shift.alias("shift"), (F.col("b") / median_of(F.col("mag")) >= ratio).alias("present"))


def attack(frames: DataFrame, bin_: int, reach: int, share: float) -> DataFrame:
    """session_id, attack: the first frame whose band energy is ``share`` of the way from the 10th percentile to the peak."""
    session = W.partitionBy("session_id")
    rows = frames.select("session_id", "frame_idx", band(F.col("mag"), bin_, reach).alias("v")).withColumn("low", F.percentile("v", 0.1).over(session)).withColumn("high", F.max("v").over(session))
    return rows.where(F.col("v") >= F.col("low") + F.lit(share) * (F.col("high") - F.col("low"))).groupBy("session_id").agg(F.min("frame_idx").alias("attack"))


def strongest_class(mag: Column) -> Column:
    """The pitch class (bin modulo 12) with the largest sum, the lower one on a tie."""
    energy = lambda pc: F.aggregate(F.filter(mag, lambda _, i: i % 12 == pc), F.lit(0.0), lambda a, v: a + v)
    best = F.array_max(F.array(*(F.struct(energy(pc).alias("e"), F.lit(-pc).alias("pc")) for pc in range(12))))
    return -best["pc"]


def mean_profiles(asks: DataFrame, frames: DataFrame) -> DataFrame:
    """``asks`` (request, session_id, start, window, in seconds) with ``mag``: the mean magnitude of every bin over the frames
    from start on, before start + window; null where there is no frame. frames: session_id, t_sec, mag."""
    ends = asks.withColumn("_end", F.col("start") + F.col("window"))
    met = joins.range_join(ends.select("request", "session_id", "start", "_end"), frames.select("session_id", "t_sec", "mag"), ["session_id"], "start", "_end", "t_sec", 1.0).where(F.col("t_sec") < F.col("_end"))
    # sums of arrays, a few seconds of frames at a time, so that neither bins become rows nor a long window one array
    part = met.groupBy("request", F.floor(F.col("t_sec") / 4).alias("_part")).agg(F.collect_list("mag").alias("x")).select("request", _summed(F.col("x"), lambda x: x, lambda x: F.transform(x, lambda v: v.isNotNull().cast("int"))).alias("s"))
    found = part.groupBy("request").agg(F.collect_list("s").alias("x")).select("request", _summed(F.col("x"), lambda s: s["s"], lambda s: s["n"]).alias("s"))
    return asks.join(found.select("request", F.zip_with("s.s", "s.n", lambda s, n: s / F.nullif(n, F.lit(0))).alias("mag")), "request", "left")


def _summed(rows: Column, values: Callable[[Column], Column], counts: Callable[[Column], Column]) -> Column:
    """s, n: by place the sums and the numbers of the values in an array's arrays; nulls count for nothing."""
    none = F.struct(F.expr("cast(array() as array<double>)").alias("s"), F.expr("cast(array() as array<int>)").alias("n"))
    add = lambda a, b, zero: F.zip_with(a, b, lambda x, y: F.coalesce(x, zero) + F.coalesce(y, zero))
    return F.aggregate(rows, none, lambda acc, x: F.struct(add(acc["s"], values(x), F.lit(0.0)).alias("s"), add(acc["n"], counts(x), F.lit(0)).alias("n")))


def probe(asks: DataFrame, frames: DataFrame, low_pitch: int, per_octave: int, near: float = 50.0, far: float = 150.0) -> DataFrame:
    """request, cents_off, peak_db, expected_db, far_cents_off, error: how far the loudest bin within ``near`` cents of the
    pitch that is asked for (``pitch``) lies from it, by the parabola through it and its neighbours, which moves it by a
    bin at most; the levels of that bin and of the expected one against the loudest; and where the loudest bin within
    ``far`` cents lies, which tells another pitch from one out of tune. Of equal bins the lowest counts."""
    rows = mean_profiles(asks, frames)
    width, mag = 1200.0 / per_octave, F.col("mag")
    place = (F.col("pitch") - low_pitch) * (per_octave / 12)
    expected = F.rint(place).cast("int")
    n = F.size("mag")

    def loudest(cents: float) -> Column:
        reach = round(cents / width)
        low = F.greatest(F.lit(0), expected - reach)
        part = F.slice(mag, low + 1, expected + reach - low + 1)
        return (low + F.array_position(part, F.array_max(part)) - 1).cast("int")

    error = (
        F.when(F.col("pitch").isNull(), "no pitch is asked for").when(mag.isNull(), "no frame in the window").when(F.array_max(mag) <= 0, "no energy in the window")
        .when((expected < 0) | (expected >= n), "the pitch lies outside the spectrum").when(F.get(mag, loudest(near)) <= 0, "no energy near the pitch")
    )
    rows = rows.withColumn("error", error).withColumn("_k", F.when(error.isNull(), loudest(near))).withColumn("_far", F.when(error.isNull(), loudest(far)))
    a, b, c = (F.get(mag, F.col("_k") + d) for d in (-1, 0, 1))
    bend = a - 2 * b + c
    shift = F.when((F.col("_k") > 0) & (F.col("_k") < n - 1), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(F.lit(0.5) * (a - c) / F.nullif(bend, F.lit(0.0)), F.lit(0.0))))).otherwise(0.0)
    level = lambda x: F.round(F.lit(20.0) * F.log10(F.greatest(x, F.lit(1e-9)) / F.array_max(mag)), 1)
    ok = lambda col: F.when(F.col("error").isNull(), col)
    return rows.select(
        "request", ok(F.round((F.col("_k") + shift - place) * width, 1)).alias("cents_off"), ok(level(b)).alias("peak_db"), ok(level(F.get(mag, expected))).alias("expected_db"),
        ok(F.round((F.col("_far") - place) * width, 1)).alias("far_cents_off"), "error",
    )

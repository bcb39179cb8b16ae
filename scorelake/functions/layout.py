"""Boxes on a page, bars, and documents one after the other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# How far a box in shares of the page may stick out, its least size, and the greatest height of a system.
OUTSIDE, LEAST, TALLEST, BEYOND = 0.001, 0.02, 0.7, 0.02
# The shortest bar in quarters, and the share of its expected length that it needs.
SHORTEST, SHARE = 0.0625, 0.25


def plausible_box(box: Column) -> Column:
    """Whether a struct of x, y, w and h, in shares of the page, is a box on it; false if a number is missing or not finite."""
    x, y, w, h = (box[n].cast("double") for n in ("x", "y", "w", "h"))
    finite = lambda v: ~F.isnan(v) & (F.abs(v) < float("inf"))
    ok = finite(x) & finite(y) & finite(w) & finite(h) & (x >= -OUTSIDE) & (y >= -OUTSIDE) & (w > LEAST) & (h > LEAST)
    ok = ok & (x <= 1 + OUTSIDE) & (y <= 1 + OUTSIDE) & (w <= 1 + OUTSIDE) & (h <= TALLEST) & (x + w <= 1 + BEYOND) & (y + h <= 1 + BEYOND)
    return F.coalesce(ok, F.lit(False))


def cut_box(box: Column) -> Column:
    """The part of a box on the page."""
    inside = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
    x, y = inside(box["x"]), inside(box["y"])
    return F.struct(x.alias("x"), y.alias("y"), (inside(box["x"] + box["w"]) - x).alias("w"), (inside(box["y"] + box["h"]) - y).alias("h"))


def around(box: Column) -> Column:
    """The box around the boxes of a group."""
    x, y = F.min(box["x"]), F.min(box["y"])
    return F.struct(x.alias("x"), y.alias("y"), (F.max(box["x"] + box["w"]) - x).alias("w"), (F.max(box["y"] + box["h"]) - y).alias("h"))


def valid_bar(notes: Column, quarters: Column, expected: Column, middle_barline: Column) -> Column:
    """A bar with notes, no barline inside, and not too short for its meter; without one it is measured by itself."""
    wanted = F.coalesce(expected, F.when(quarters == 0, F.lit(1.0)).otherwise(quarters))
    return (notes > 0) & ~middle_barline & ~(quarters < F.greatest(F.lit(SHORTEST), wanted * SHARE))


def appended(measures: DataFrame) -> DataFrame:
    """The documents of a piece one after the other. measures: piece, document, page, measure, each counted from 1 in its
    document; pages go on after the last page before, measures after the number of measures before."""
    before = W.partitionBy("piece").orderBy("document").rowsBetween(W.unboundedPreceding, -1)
    sizes = measures.groupBy("piece", "document").agg(F.max("page").alias("pages"), F.count("*").alias("n"))
    offsets = sizes.select("piece", "document", F.coalesce(F.sum("pages").over(before), F.lit(0)).alias("page_offset"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("measure_offset"))
    moved = measures.join(offsets, ["piece", "document"])
    return moved.withColumn("page", F.col("page") + F.col("page_offset")).withColumn("measure", F.col("measure") + F.col("measure_offset")).drop("page_offset", "measure_offset")


def share_of_system(x: Column, w: Column, at: Column) -> Column:
    """A place on the page as a share of a system's width, cut to it; a system without a width is as wide as the page."""
    wide = F.greatest(F.coalesce(F.nullif(w, F.lit(0.0)), F.lit(1.0)), F.lit(1e-6))
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (at - F.coalesce(x, F.lit(0.0))) / wide)), 4)


def place_on_page(x: Column, w: Column, share: Column) -> Column:
    """A share of a system's width as a place on the page."""
    return F.coalesce(x, F.lit(0.0)) + share * F.coalesce(F.nullif(w, F.lit(0.0)), F.lit(1.0))


def pages_to_detect(pages: DataFrame, systems: DataFrame) -> DataFrame:
    """page, reason of the pages whose systems cannot be right. pages: page, kind, declared; systems: page, box."""
    found = systems.groupBy("page").agg(F.count("*").alias("found"), F.bool_or(~plausible_box(F.col("box"))).alias("odd"))
    rows = pages.join(found, "page", "left").fillna(0, ["found"])
    declared = F.coalesce("declared", F.lit(0))
    none = (F.col("found") == 0) & ((F.col("kind") == "music") | (declared != 0))
    other = (F.col("found") > 0) & (declared > 0) & (F.col("found") != declared)
    bad = (F.col("found") > 0) & F.coalesce("odd", F.lit(False))
    return rows.select("page", F.when(none, "no systems").when(other, "other count").when(bad, "bad box").alias("reason")).where("reason IS NOT NULL")

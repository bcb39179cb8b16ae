"""Rasterised score pages: staves, systems, barlines and where the music starts.

Spark's image source decodes the files. A page becomes rows of dark runs (y, from x, to x), which are few next to its
pixels; projections are sums over them, groups of rows and columns are islands, and a system's column coverage is a
running sum over the starts and ends of its runs. Positions are pixels; ``share`` turns them into shares of the page.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scorelake.operators import greedy
from scorelake.operators.cluster import scratch_path, ship


@dataclass(frozen=True)
class PageConfig:
    """How dark a staff and a barline are at least; the share of the width that a staff's row is dark; rows
    apart that still are one line; the least and greatest distance of lines and the greatest height of a staff; rows
    around a system; shares of a system's height that a barline covers, the second if none covers the first; columns apart
    that still are one line; its greatest width and least distance from the one before, in pixels and in shares."""

    staff_dark: int = 170
    bar_dark: int = 150
    row_share: float = 0.33
    row_gap: int = 3
    line_least: int = 5
    line_most: int = 18
    staff_most: int = 70
    padding: int = 55
    covers: tuple[float, float] = (0.8, 0.42)
    covers_least: tuple[int, int] = (2, 12)
    column_gap: int = 2
    bar_wide: tuple[int, float] = (20, 0.025)
    bar_apart: tuple[int, float] = (6, 0.006)


RUNS = "page string, height int, width int, y int, x0 int, x1 int"


def grey(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """Brightness of an image whose channels stand in the order blue, green, red, or of one that has but one."""
    x = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    if channels == 1:
        return x[:, :, 0]
    x = x.astype(np.uint32)
    return (x[:, :, 2] * 19_595 + x[:, :, 1] * 38_470 + x[:, :, 0] * 7_471 + 0x8000) >> 16


def _edges(x: np.ndarray, dark: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """y, x0, x1 of the runs darker than ``dark``. Rows lie one after the other with a light column behind each, so that
    starts and ends alternate."""
    height, width = x.shape
    ink = np.zeros(height * (width + 1) + 1, bool)
    ink[1:].reshape(height, width + 1)[:, :width] = x < dark
    at = np.flatnonzero(ink[1:] != ink[:-1])
    y, x0 = np.divmod(at[::2], width + 1)
    return y, x0, at[1::2] - y * (width + 1) - 1


#: Fixed value: runs of as many pages as hold about this many pixels leave a task at a time.
PIXELS = 1 << 25


def runs_at(images: DataFrame, levels: tuple[int, ...]) -> DataFrame:
    """dark, page, height, width, y, x0, x1 of the runs of pixels darker than each of ``levels``, images decoded once.
    images: page, image (as the image source gives it); undecodable images, whose height is below 1, have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        pixels = 0

        def table() -> pd.DataFrame:
            head, runs = [h for h, _ in held], [r for _, r in held]
            n = np.array([len(y) for y, _, _ in runs], int)
            out = {c: np.repeat(np.array([h[k] for h in head], object if c == "page" else np.int32), n) for k, c in enumerate(("dark", "page", "height", "width"))}
            return pd.DataFrame(out | {c: np.concatenate([r[k] for r in runs]).astype(np.int32) for k, c in enumerate(("y", "x0", "x1"))})

        for batch in batches:
            for page, height, width, channels, data in batch.itertuples(index=False):
                x = grey(data, height, width, channels)
                held += [((dark, page, height, width), _edges(x, dark)) for dark in levels]
                pixels += height * width
                if pixels >= PIXELS:
                    yield table()
                    held, pixels = [], 0
        if held:
            yield table()

    ship(images.sparkSession)
    rows = images.where("image.height > 0 and image.width > 0").select(F.col("page").cast("string").alias("page"), "image.height", "image.width", "image.nChannels", "image.data")
    return rows.mapInPandas(run, f"dark int, {RUNS}")


def dark_runs(images: DataFrame, dark: int) -> DataFrame:
    """page, height, width, y, x0, x1 of each run of pixels darker than ``dark``."""
    return runs_at(images, (dark,)).drop("dark")


def kept_runs(images: DataFrame, *levels: int) -> list[DataFrame]:
    """The runs at each level, from a written table: pages are decoded once however many steps ask for their runs."""
    spark = images.sparkSession
    path = scratch_path(spark, "runs")
    runs_at(images, tuple(dict.fromkeys(levels))).write.partitionBy("dark").parquet(path)
    held = spark.read.schema(f"{RUNS}, dark int").parquet(path)
    return [held.where(F.col("dark") == level).drop("dark") for level in levels]


def islands(rows: DataFrame, keys: list[str], place: str, gap: int) -> DataFrame:
    """keys, first, last of the groups of ``place`` in which neighbours are at most ``gap`` apart."""
    order = W.partitionBy(*keys).orderBy(place)
    new = F.coalesce(F.col(place) - F.lag(place).over(order) > gap, F.lit(True)).cast("int")
    numbered = rows.withColumn("_new", new).withColumn("_island", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return numbered.groupBy(*keys, "_island").agg(F.min(place).alias("first"), F.max(place).alias("last")).drop("_island")


def _middle() -> Column:
    """The rounded middle of a group, halves to the even number."""
    return F.bround((F.col("first") + F.col("last")) / 2, 0).cast("int")


def staves(runs: DataFrame, c: PageConfig = PageConfig()) -> DataFrame:
    """page, top, bottom: five dark rows at like distances."""
    rows = runs.groupBy("page", "width", "y").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("n")).where(F.col("n") > F.floor(F.col("width") * c.row_share))
    lines = islands(rows, ["page"], "y", c.row_gap).select(F.xxhash64("page").alias("key"), "page", _middle().cast("double").alias("y"))
    found = greedy.staves(lines.select(F.col("key").alias("page"), "y"), float(c.line_least), float(c.line_most)).where(F.col("bottom") - F.col("top") <= c.staff_most)
    names = lines.select("key", "page").distinct()
    return found.withColumnRenamed("page", "key").join(names.hint("merge"), "key").select("page", F.col("top").cast("int").alias("top"), F.col("bottom").cast("int").alias("bottom"))


def systems(staff_rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """page, system, top, bottom: staves that stand close together are a pair. Close is at most 1.35 times the median
    distance of a page's staves, between 45 pixels and 8 % of its height. sizes: page, height."""
    order = W.partitionBy("page").orderBy("top")
    gaps = staff_rows.withColumn("gap", F.lead("top").over(order) - F.col("bottom")).join(sizes.hint("merge"), "page")
    limit = F.greatest(F.lit(45.0), F.least(F.col("height") * 0.08, F.percentile("gap", 0.5).over(W.partitionBy("page")) * 1.35))
    listed = gaps.withColumn("close", F.coalesce(F.col("gap") <= limit, F.lit(False))).groupBy("page").agg(F.sort_array(F.collect_list(F.struct("top", "bottom", "close"))).alias("s"))
    # a staff that closes a pair starts none: along a chain of close staves every second one is a start
    start = F.struct(F.expr("cast(array() as array<struct<top: int, bottom: int>>)").alias("done"), F.lit(False).alias("open"), F.lit(0).alias("top"))

    def step(acc: Column, s: Column) -> Column:
        top = F.when(acc["open"], acc["top"]).otherwise(s["top"])
        pairs = ~acc["open"] & s["close"]
        done = F.when(pairs, acc["done"]).otherwise(F.concat(acc["done"], F.array(F.struct(top.alias("top"), s["bottom"].alias("bottom")))))
        return F.struct(done.alias("done"), pairs.alias("open"), top.alias("top"))

    found = listed.select("page", F.posexplode(F.aggregate("s", start, step)["done"]).alias("k", "x"))
    return found.select("page", (F.col("k") + 1).alias("system"), "x.top", "x.bottom")


def barlines(runs: DataFrame, bands: DataFrame, c: PageConfig = PageConfig()) -> DataFrame:
    """page, system, x, share: columns that are dark over most of a system's height. bands: page, system, top, bottom.

    Joins of runs and bands shuffle both: files and maps of Python say little of how many rows come, and runs are too many
    for a broadcast."""
    band = bands.select("page", "system", F.greatest(F.col("top") - c.padding, F.lit(0)).alias("y0"), (F.col("bottom") + c.padding).alias("y1"))
    inside = runs.join(band.hint("merge"), "page").where(F.col("y").between(F.col("y0"), F.col("y1") - 1))
    keys = ["page", "system"]
    filled = inside.groupBy(*keys, "height", "width", "y0", "y1", "y").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("n")).where(F.col("n") > F.greatest(F.lit(8), F.floor(F.col("width") * 0.015)))
    span = filled.groupBy(*keys, "height", "width", "y0", "y1").agg(F.min("y").alias("a"), F.max("y").alias("b"))
    span = span.select(*keys, "width", F.greatest(F.col("a") - 2, F.col("y0")).alias("top"), F.least(F.col("b") + 3, F.col("y1"), F.col("height")).alias("bottom"))
    within = inside.select(*keys, "y", "x0", "x1").join(span.hint("merge"), keys).where((F.col("y") >= F.col("top")) & (F.col("y") < F.col("bottom")))
    ends = within.select(*keys, "width", (F.col("bottom") - F.col("top")).alias("span"), F.explode(F.array(F.struct(F.col("x0").alias("x"), F.lit(1).alias("d")), F.struct((F.col("x1") + 1).alias("x"), F.lit(-1).alias("d")))).alias("e"))
    steps = ends.groupBy(*keys, "width", "span", F.col("e.x").alias("x")).agg(F.sum("e.d").alias("d"))
    order = W.partitionBy(*keys).orderBy("x")
    covered = steps.withColumn("n", F.sum("d").over(order.rowsBetween(W.unboundedPreceding, W.currentRow))).withColumn("to", F.lead("x").over(order) - 1)
    first, second = (F.greatest(F.lit(least), F.floor(F.col("span") * share)) for least, share in zip(c.covers_least, c.covers, strict=True))
    wanted = F.when(F.max("n").over(W.partitionBy(*keys)) >= first, first).otherwise(second)
    columns = covered.withColumn("wanted", wanted).where(F.col("n") >= F.col("wanted")).select(*keys, "width", F.explode(F.sequence("x", "to")).alias("x"))
    lines = islands(columns, [*keys, "width"], "x", c.column_gap).where(F.col("last") - F.col("first") + 1 <= F.greatest(F.lit(c.bar_wide[0]), F.floor(F.col("width") * c.bar_wide[1])))
    listed = lines.groupBy(*keys, "width").agg(F.sort_array(F.collect_list(_middle())).alias("xs"))
    apart = F.greatest(F.lit(c.bar_apart[0]), F.floor(F.col("width") * c.bar_apart[1]))
    kept = F.aggregate("xs", F.expr("cast(array() as array<int>)"), lambda acc, x: F.when((F.size(acc) == 0) | (x - F.element_at(acc, -1) >= apart), F.concat(acc, F.array(x))).otherwise(acc))
    return listed.select(*keys, "width", F.explode(kept).alias("x")).select(*keys, "x", (F.col("x") / F.col("width")).alias("share"))


def bands_of(runs: DataFrame, c: PageConfig = PageConfig()) -> DataFrame:
    """Systems of all pages, from the runs at ``staff_dark``. A page without runs has no staves."""
    return systems(staves(runs, c), runs.select("page", "height").distinct())


def detect(images: DataFrame, c: PageConfig = PageConfig()) -> tuple[DataFrame, DataFrame]:
    """Systems and barlines of all pages."""
    staff, bar = kept_runs(images, c.staff_dark, c.bar_dark)
    bands = bands_of(staff, c)
    return bands, barlines(bar, bands, c)


def smoothed(x: np.ndarray, sigma: float) -> np.ndarray:
    """Under a Gaussian of four standard deviations to each side; the ends are mirrored."""
    reach = int(4 * sigma + 0.5)
    bell = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(np.pad(np.asarray(x, float), reach, mode="symmetric"), bell / bell.sum(), "valid")


def music_start(density: np.ndarray, x0: int, page_width: int, spacing: int) -> int:
    """Where music begins after clef, key and meter: the first low run, two line distances wide, after dense columns (or at
    the very start), in the first 28 % of a system; 8 % of its width if there is none. density: dark pixels of each of
    its columns, which start at x0."""
    width = len(density)
    fallback = round(x0 + width * 0.08)
    if not width:
        return fallback
    smooth = smoothed(density, 2.0)
    scan = np.maximum(0, smooth - np.percentile(smooth, 20))[: max(1, min(width, int(width * 0.28)))]
    peak = float(np.percentile(scan, 95))
    if peak < 4:
        return x0
    wide = max(8, 2 * spacing)
    seen = np.concatenate([[False], np.cumsum(scan > max(4.0, peak * 0.35))[:-1] > 0]) | (scan > max(4.0, peak * 0.35)) | (np.arange(len(scan)) < wide)
    low = seen & (scan <= max(2.0, peak * 0.18))
    edges = np.flatnonzero(np.diff(np.concatenate([[False], low, [False]]).astype(int)))
    for start, end in zip(edges[::2], edges[1::2], strict=True):
        if end - start >= wide:
            found = x0 + int(start)
            # a system that starts right of the margin starts with music: a later valley is a gap between notes
            return x0 if x0 / page_width > 0.085 and found - x0 > width * 0.04 else max(x0, min(fallback, found))
    return fallback


def music_starts(runs: DataFrame, bands: DataFrame, spacing: int = 10) -> DataFrame:
    """page, system, start of every system. bands: page, system, top, bottom, x0, x1."""
    at = runs.select("page", "width", "y", F.col("x0").alias("a"), F.col("x1").alias("b")).join(bands.hint("merge"), "page").where(F.col("y").between(F.col("top") - 2, F.col("bottom") + 2) & (F.col("b") >= F.col("x0")) & (F.col("a") < F.col("x1")))
    listed = at.groupBy("page", "system", "width", "x0", "x1").agg(F.collect_list("a").alias("a"), F.collect_list("b").alias("b"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for page, system, width, x0, x1, a, b in batch.itertuples(index=False):
                step = np.zeros(width + 1, int)
                np.add.at(step, np.asarray(a), 1)
                np.add.at(step, np.asarray(b) + 1, -1)
                out.append((page, system, music_start(np.cumsum(step)[x0:x1], x0, width, spacing)))
            yield pd.DataFrame(out, columns=["page", "system", "start"])

    ship(runs.sparkSession)
    return listed.mapInPandas(run, "page string, system int, start int")

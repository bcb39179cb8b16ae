"""Slices of spectra kept under a digest of their parameters: what has been asked before is read, the rest is computed
once and appended.

The cache is a folder of tables that are only added to. Two writers may add the same slice; readers take one of equal
rows. A request whose bounds cannot be gives an error and never reaches the cache.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.sources import stores

SLICES = "key string, n_frames bigint, mag array<double>"
#: Fixed value: the most frames of a slice.
LONGEST = 600


def slice_key(session: Column, start: Column, end: Column, bins: Column) -> Column:
    """The sha1 of all parameters, written in one way."""
    return F.sha1(F.concat_ws("|", *(c.cast("string") for c in (session, start, end, bins))).cast("binary"))


def checked(requests: DataFrame, longest: int = LONGEST) -> DataFrame:
    """``requests`` (session_id, start, end, bins) with key and error; a request with an error has no key."""
    s, e, b = F.col("start"), F.col("end"), F.col("bins")
    error = (
        F.when(s.isNull() | e.isNull() | b.isNull() | F.col("session_id").isNull(), "a parameter is missing")
        .when(s < 0, "start is below 0").when(e <= s, "end is not after start").when(e - s > longest, f"longer than {longest} frames").when(b < 1, "no bins")
    )
    return requests.withColumn("error", error).withColumn("key", F.when(error.isNull(), slice_key(F.col("session_id"), s, e, b)))


def computed(wanted: DataFrame, spectra: DataFrame) -> DataFrame:
    """key, n_frames, mag: the mean spectrum of the first ``bins`` bins over frames start..end-1. wanted: key, session_id,
    start, end, bins, each key once. Frames meet the slices that hold them by session and block of frames."""
    block = F.lit(LONGEST)
    spread = wanted.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("end") - 1) / block))))
    framed = spectra.select("session_id", "frame_idx", "mag", F.floor(F.col("frame_idx") / block).alias("block"))
    met = spread.join(framed, ["session_id", "block"]).where(F.col("frame_idx").between(F.col("start"), F.col("end") - 1))
    bins = met.select("key", F.posexplode(F.slice("mag", F.lit(1), F.col("bins"))).alias("bin", "m"))
    mean = bins.groupBy("key", "bin").agg(F.avg("m").alias("m"), F.count("*").alias("n"))
    found = mean.groupBy("key").agg(F.max("n").alias("n_frames"), F.sort_array(F.collect_list(F.struct("bin", "m")))["m"].alias("mag"))
    # a slice without frames is an answer as well: it is kept, so that it is not computed again
    return wanted.select("key").join(found, "key", "left").select("key", F.coalesce("n_frames", F.lit(0).cast("bigint")).alias("n_frames"), F.coalesce("mag", F.expr("cast(array() as array<double>)")).alias("mag"))


def _held(spark: SparkSession, path: str) -> DataFrame:
    if not stores.exists(spark, path):
        return spark.createDataFrame([], SLICES)
    return spark.read.schema(SLICES).option("recursiveFileLookup", "true").parquet(path).groupBy("key").agg(F.first("n_frames").alias("n_frames"), F.first("mag").alias("mag"))


def cached_slices(requests: DataFrame, spectra: DataFrame, path: str) -> tuple[DataFrame, int]:
    """Every request with error, key, n_frames and mag, and how many slices had to be computed for it."""
    spark = requests.sparkSession
    asked = checked(requests)
    misses = asked.where("error IS NULL").dropDuplicates(["key"]).join(_held(spark, path).select("key"), "key", "left_anti")
    part = f"{path}/part={uuid.uuid4().hex}"
    computed(misses.select("key", "session_id", "start", "end", "bins"), spectra).write.parquet(part)
    new = spark.read.schema(SLICES).parquet(part).count()
    if not new:
        stores.delete_prefix(spark, part)
    return asked.join(_held(spark, path), "key", "left"), new

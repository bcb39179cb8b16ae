"""Queries whose core is a grouped map: alignment, greedy scans, peaks. They have no SQL twin; the tests hold them
against brute force and constructed cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scorelake.operators import alignment, greedy, signal
from scorelake.plans.registry import query
from scorelake.sources.bindings import frames, onsets, perf_notes, table


def generated_score(notes: DataFrame) -> DataFrame:
    """A score for each session: its notes at half tempo, without every seventh one."""
    order = W.partitionBy("session_id").orderBy("t", "state_idx")
    hours = (F.col("t") - F.min("t").over(W.partitionBy("session_id"))) / 7200
    rows = notes.withColumn("r", F.row_number().over(order)).withColumn("score_time_sec", hours).where("r % 7 <> 0")
    return rows.select("session_id", "score_time_sec", F.col("pitch").alias("midi_pitch"), "measure")


def performed(notes: DataFrame) -> DataFrame:
    """Times in hours from the session's start; notes of kind error have no pitch."""
    hours = (F.col("t") - F.min("t").over(W.partitionBy("session_id"))) / 3600
    return notes.select("session_id", "state_idx", hours.alias("t"), F.when(F.col("matched"), F.col("pitch")).alias("pitch"))


@query("jon01_alignment")
def jon01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also JON-02 and JON-03: every performed note with its score note and its offset from the fitted tempo."""
    notes = perf_notes(spark, sf_dir)
    return alignment.align(performed(notes), generated_score(notes))


@query("jon01_alignment_in_slices")
def jon01_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over slices of eight days with as much around them (times are hours here), so that a session of any
    length is many tasks."""
    notes = perf_notes(spark, sf_dir)
    return alignment.align_slices(performed(notes), generated_score(notes), length=192.0, margin=200.0)


@query("jon24_greedy_matches")
def jon24(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also WIN-26: the simple matcher with a smoothed lag."""
    notes = perf_notes(spark, sf_dir)
    return greedy.greedy_matches(performed(notes).where("pitch is not null"), generated_score(notes))


@query("win04_bar_refinement")
def win04(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = perf_notes(spark, sf_dir)
    bars = notes.groupBy("session_id", "measure").agg(F.min("t").alias("start"), F.slice(F.sort_array(F.collect_set(F.pmod("pitch", F.lit(12)))), 1, 3).alias("pcs"))
    heard = onsets(spark, sf_dir).select("session_id", "time", "loudness_db", F.lit(0.5).alias("strength"), "pc")
    return greedy.refine_bar_starts(bars, heard, near=7_200.0, loud=-50.0, after=60.0)


def _page() -> F.Column:
    """Pages of 200 parts, so that there are more of them, not larger ones, where the table is larger."""
    return F.floor(F.col("p_partkey") / 200).cast("bigint")


@query("jon23_barline_fit")
def jon23(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected boundaries of a page against detected ones."""
    parts = table(spark, sf_dir, "part").select(_page().alias("page"), (F.col("p_retailprice") / 2_000).alias("x"), "p_size")
    return greedy.nearest_unused(parts.where("p_size % 2 = 0").select("page", "x"), parts.where("p_size % 2 = 1").select("page", "x"), 0.01)


@query("win23_candidate_clusters")
def win23(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "part").select(_page().alias("page"), (F.col("p_retailprice") / 2_000).alias("x"), F.col("p_size").cast("double").alias("score"))
    return greedy.weighted_clusters(points, 0.002, 0.01)


@query("win24_staff_lines")
def win24(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "part").select(_page().alias("page"), F.col("p_retailprice").alias("y"))
    return greedy.staves(lines, 0.0, 40.0)


@query("top06_spectral_peaks")
def top06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also SIG-12."""
    return greedy.spectral_peaks(frames(spark, sf_dir), -30.0, 2, 8)


def pitch_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as pitch tracks of 64 frames a second: components are cents about 440 Hz, wide by the vector's number."""
    wide = F.lit(40.0) * (1 + F.col("frame_idx") % 7)
    hz = F.transform("mag", lambda x: F.lit(440.0) * F.pow(F.lit(2.0), x * wide / 1200))
    return frames(spark, sf_dir).select(F.col("frame_idx").cast("bigint").alias("session_id"), F.lit(64.0).alias("rate"), hz.alias("hz"))


@query("sig10_vibrato")
def sig10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal.vibrato(pitch_tracks(spark, sf_dir))


@query("sig11_trill")
def sig11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal.trills(pitch_tracks(spark, sf_dir))


@query("sig01_constant_q")
def sig01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spectra of vectors taken as recordings of 64 samples, repeated to last."""
    wave = F.flatten(F.array_repeat(F.col("mag"), 16))
    rows = frames(spark, sf_dir).select(F.col("frame_idx").cast("bigint").alias("session_id"), F.lit(1_024).alias("rate"), wave.alias("samples"))
    return signal.frames_of(rows, 64.0, 2, 12, 128)


@query("sig07_flux_onsets")
def sig07(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Onsets where the spectra of a session rise, a hundred frames a second."""
    rows = frames(spark, sf_dir).select(F.col("session_id").cast("bigint").alias("session_id"), "frame_idx", (F.col("frame_idx") / 100).alias("t_sec"), "mag")
    return signal.flux_onsets(rows)


@query("top07_envelope_peaks")
def top07(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The loudest peaks of each envelope by prominence."""
    db = F.transform("mag", lambda x: F.lit(20.0) * F.log10(F.greatest(x, F.lit(1e-6))))
    return signal.envelope_peaks(frames(spark, sf_dir).select(F.col("frame_idx").cast("bigint").alias("session_id"), db.alias("db")))

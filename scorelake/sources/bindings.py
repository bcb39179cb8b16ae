"""Plain tables bound to the domain: notes, onsets, spectra, scores, layouts, manifests and conversations.

Each function reads one table and projects it to a domain relation; ``SQL`` holds the same definitions as common table
expressions for the twins of queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DAY = 86_400.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(ts: str = "ts") -> F.Column:
    """Seconds since the start of 2024, as a double with whole microseconds behind it."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', {ts}) / 1e6D")


def perf_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Performed notes: a user's events are a session, the payload's k is the pitch, a day is a bar."""
    k = F.regexp_extract("props", r'"k": *(\d+)', 1).try_cast("int")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("session_id"),
        F.col("event_id").alias("state_idx"),
        seconds().alias("t"),
        (F.lit(36) + k % 49).alias("pitch"),
        F.col("value").alias("amplitude"),
        F.col("event_type").alias("kind"),
        (F.col("event_type") != "error").alias("matched"),
        (F.floor(seconds() / DAY) + 1).cast("bigint").alias("measure"),
    )


def onsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Onsets: clicks, with a loudness in dB."""
    notes = perf_notes(spark, sf_dir).where("kind = 'click'")
    return notes.select("session_id", "state_idx", F.col("t").alias("time"), (F.lit(20.0) * F.log10(F.greatest("amplitude", F.lit(1e-6))) - 60).alias("loudness_db"), F.pmod("pitch", F.lit(12)).alias("pc"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Magnitude spectra: one row per frame, bins are the vector's components without sign."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("label").alias("session_id"), F.col("vec_id").alias("frame_idx"), F.transform("embedding", lambda x: F.abs(x).cast("double")).alias("mag")
    )


def score_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score notes: an order is a piece, line numbers are bars, quantities add up to score time."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("piece_id"),
        F.col("l_linenumber").alias("measure"),
        F.col("l_quantity").alias("duration"),
        (F.lit(36) + F.col("l_partkey") % 49).cast("int").alias("pitch"),
    )


#: Twins of the relations above.
SQL = {
    "p": """p AS (SELECT user_id AS session_id, event_id AS state_idx, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) / 1e6 AS t,
      36 + regexp_extract(props, '"k": *([0-9]+)', 1)::INTEGER % 49 AS pitch, value AS amplitude, event_type AS kind, event_type <> 'error' AS matched,
      (floor((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) / 1e6 / 86400.0) + 1)::BIGINT AS measure FROM events)""",
    "o": "o AS (SELECT session_id, state_idx, t AS time, 20.0 * log10(greatest(amplitude, 1e-6)) - 60 AS loudness_db, pitch % 12 AS pc FROM p WHERE kind = 'click')",
    "f": "f AS (SELECT label AS session_id, vec_id AS frame_idx, list_transform(embedding, lambda x: abs(x)::DOUBLE) AS mag FROM embeddings)",
    "s": "s AS (SELECT l_orderkey AS piece_id, l_linenumber AS measure, l_quantity AS duration, (36 + l_partkey % 49)::INTEGER AS pitch FROM lineitem)",
}


def with_(*names: str) -> str:
    """A WITH clause of the named relations, to be followed by a comma or by SELECT."""
    return "WITH " + ", ".join(SQL[n] for n in names)

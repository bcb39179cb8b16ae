"""Listings and guards: sessions by their kind, practice clips without deleted ones, comments by severity, limits of an
instrument's profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scorelake.functions import profiles
from scorelake.plans.registry import query
from scorelake.sources.bindings import table

LESSON, DRILL = "lesson", "drill"


def kind_error(kind: Column, wanted: str) -> Column:
    """Why a session may not be used as one of a kind, null if it may; a session without a kind, or of one that is not
    known, is a lesson."""
    held = F.when(kind == DRILL, DRILL).otherwise(LESSON)
    return F.when(held != wanted, F.concat(F.lit("session is a "), held, F.lit(f", not a {wanted}")))


def visible_clips(sessions: DataFrame, log: DataFrame) -> DataFrame:
    """parent, session_id, state, place of the practice clips that are not deleted, each parent's newest first. sessions:
    session_id, parent, kind, created; log: session_id, seq, state, which is only added to: the last entry holds, and one
    that says deleted or cancelled hides the clip. Clips without an entry are shown without a state."""
    last = log.groupBy("session_id").agg(F.max_by("state", "seq").alias("state"))
    shown = sessions.where(kind_error(F.col("kind"), DRILL).isNull()).join(last, "session_id", "left").where("state IS NULL OR state NOT IN ('deleted', 'cancelled')")
    place = F.row_number().over(W.partitionBy("parent").orderBy(F.col("created").desc_nulls_last(), "session_id"))
    return shown.select("parent", "session_id", "state", place.cast("bigint").alias("place"))


def surfaced(comments: DataFrame, most: int = 15) -> DataFrame:
    """session_id, text: of each session the warnings and alerts, ``most`` at most, and how many of its comments those are.
    comments: session_id, place, severity, measure, summary. Sessions without one are left out."""
    loud = F.lower("severity").isin("alert", "warn")
    counted = comments.groupBy("session_id").agg(F.count("*").alias("n"), F.count_if(loud).alias("m"))
    first = comments.where(loud).withColumn("r", F.row_number().over(W.partitionBy("session_id").orderBy("place"))).where(F.col("r") <= most)
    line = F.format_string("- [%s] m%d: %s", F.upper("severity"), "measure", F.coalesce(F.nullif("summary", F.lit("")), F.lit("(no summary)")))
    lines = first.groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("r", line.alias("line"))))["line"].alias("x"))
    head = F.format_string("%d of %d comments, alert/warn only:", "m", "n")
    return lines.join(counted, "session_id").select("session_id", F.concat_ws("\n", head, F.array_join("x", "\n")).alias("text"))


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as sessions: urgent ones are clips, high ones have no kind, low ones an unknown one."""
    kind = F.when(F.col("o_orderpriority") == "1-URGENT", DRILL).when(F.col("o_orderpriority") == "2-HIGH", "").when(F.col("o_orderpriority") == "5-LOW", "tape").otherwise(LESSON)
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("session_id"), F.col("o_custkey").alias("parent"), kind.alias("kind"), F.col("o_orderdate").alias("created"))


_KIND = "CASE o_orderpriority WHEN '1-URGENT' THEN 'drill' ELSE 'lesson' END"


@query("flt16_kind_guard", f"WITH k AS (SELECT o_orderkey AS session_id, {_KIND} AS kind FROM orders) SELECT session_id, CASE WHEN kind <> 'lesson' THEN 'session is a ' || kind || ', not a lesson' END AS as_lesson, CASE WHEN kind <> 'drill' THEN 'session is a ' || kind || ', not a drill' END AS as_drill FROM k")
def flt16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sessions(spark, sf_dir).select("session_id", kind_error(F.col("kind"), LESSON).alias("as_lesson"), kind_error(F.col("kind"), DRILL).alias("as_drill"))


@query(
    "snk07_practice_clips",
    f"""WITH l AS (SELECT l_orderkey AS session_id, arg_max(CASE l_returnflag WHEN 'R' THEN 'deleted' WHEN 'A' THEN 'ready' WHEN 'N' THEN 'processing' END, l_linenumber::BIGINT * 1000000000000 + l_partkey * 1000000 + l_suppkey * 100 + l_quantity::BIGINT) AS state FROM lineitem GROUP BY 1),
    s AS (SELECT o_custkey AS parent, o_orderkey AS session_id, o_orderdate, state FROM orders LEFT JOIN l ON l.session_id = o_orderkey WHERE {_KIND} = 'drill' AND (state IS NULL OR state NOT IN ('deleted', 'cancelled')))
    SELECT parent, session_id, state, row_number() OVER (PARTITION BY parent ORDER BY o_orderdate DESC NULLS LAST, session_id) AS place FROM s""",
)
def snk07_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips whose last entry in the log of states is no tombstone."""
    state = F.when(F.col("l_returnflag") == "R", "deleted").when(F.col("l_returnflag") == "A", "ready").when(F.col("l_returnflag") == "N", "processing")
    log = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("session_id"), (F.col("l_linenumber").cast("bigint") * 1_000_000_000_000 + F.col("l_partkey") * 1_000_000 + F.col("l_suppkey") * 100 + F.col("l_quantity").cast("bigint")).alias("seq"), state.alias("state"))
    return visible_clips(_sessions(spark, sf_dir), log)


@query(
    "flt12_surfaced_comments",
    """WITH c AS (SELECT user_id AS session_id, event_id AS place, CASE event_type WHEN 'error' THEN 'Alert' WHEN 'purchase' THEN 'warn' WHEN 'signup' THEN 'WARN' ELSE 'info' END AS severity, (event_id % 40 + 1)::INTEGER AS measure, CASE WHEN event_id % 4 > 0 THEN event_type ELSE '' END AS summary FROM events),
    n AS (SELECT session_id, count(*) AS n, count(*) FILTER (WHERE lower(severity) <> 'info') AS m FROM c GROUP BY 1), r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY place) AS r FROM c WHERE lower(severity) <> 'info')
    SELECT session_id, any_value(m) || ' of ' || any_value(n) || ' comments, alert/warn only:' || chr(10) || string_agg('- [' || upper(severity) || '] m' || measure || ': ' || coalesce(nullif(summary, ''), '(no summary)'), chr(10) ORDER BY r) AS text FROM r JOIN n USING (session_id) WHERE r <= 15 GROUP BY 1""",
)
def flt12(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    severity = F.when(kind == "error", "Alert").when(kind == "purchase", "warn").when(kind == "signup", "WARN").otherwise("info")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("place"), severity.alias("severity"), (F.col("event_id") % 40 + 1).cast("int").alias("measure"), F.when(F.col("event_id") % 4 > 0, kind).otherwise("").alias("summary"))
    return surfaced(rows)


@query(
    "ext06_profile_limits",
    """WITH n AS (SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'piano' WHEN 1 THEN 'piano' WHEN 2 THEN 'violin_solo' WHEN 3 THEN 'viola_solo' WHEN 4 THEN 'cello_solo' ELSE 'default' END AS profile FROM part)
    SELECT p_partkey, profile, CASE profile WHEN 'piano' THEN 'fixed' ELSE 'variable' END AS pitch_class, CASE profile WHEN 'piano' THEN 10 WHEN 'default' THEN 2 ELSE 4 END::INTEGER AS voices, CASE profile WHEN 'piano' THEN NULL ELSE 50 END::INTEGER AS search_cents,
      CASE profile WHEN 'piano' THEN 25 ELSE 80 END::INTEGER AS onset_spacing_ms, CASE WHEN profile = 'piano' THEN NULL WHEN p_size >= 25 THEN 'alert' WHEN p_size >= 15 THEN 'warn' ELSE 'info' END AS severity FROM n JOIN part USING (p_partkey)""",
)
def ext06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deviation of each part judged by the limits of its profile; instruments of fixed pitch are not judged."""
    named = F.element_at(F.array(*map(F.lit, ("Piano", " piano_with_pedal", "violin_solo", "Viola_Solo ", "cello_solo", "kazoo", ""))), (F.col("p_partkey") % 7 + 1).cast("int"))
    rows = profiles.with_profile(table(spark, sf_dir, "part").select("p_partkey", "p_size"), named)
    severity = F.when(F.col("intonation"), F.when(F.col("p_size") >= F.col("alert_cents"), "alert").when(F.col("p_size") >= F.col("warn_cents"), "warn").otherwise("info"))
    return rows.select("p_partkey", "profile", "pitch_class", "voices", "search_cents", "onset_spacing_ms", severity.alias("severity"))

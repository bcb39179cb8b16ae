"""Queries on pitch statistics, timelines, spectra, scalar functions, top-k lists and rule findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scorelake.functions import costs, pitch, profiles, text
from scorelake.operators import ordered, spectra
from scorelake.plans.registry import query
from scorelake.sources.bindings import frames, onsets, perf_notes, score_notes, table, with_

_NAMES = "['C','C#','D','D#','E','F','F#','G','G#','A','A#','B']"
_CENTS = "c AS (SELECT session_id, state_idx, measure, t, pitch, pitch % 12 AS pc, (amplitude - 50) AS cents, amplitude FROM p)"


def cents_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intonation events: the amplitude around 50 stands for the deviation in cents."""
    return perf_notes(spark, sf_dir).select("session_id", "state_idx", "measure", "t", "pitch", F.pmod("pitch", F.lit(12)).alias("pc"), (F.col("amplitude") - 50).alias("cents"), "amplitude")


_BY_CLASS = f"""k AS (SELECT session_id, pc, count(*) AS n, median(cents) AS median, max(abs(cents)) AS abs_max, quantile_cont(cents, 0.1) AS p10, quantile_cont(cents, 0.9) AS p90 FROM c GROUP BY ALL)"""


def by_class(rows: DataFrame) -> DataFrame:
    return rows.groupBy("session_id", "pc").agg(
        F.count("*").alias("n"), F.median("cents").alias("median"), F.max(F.abs("cents")).alias("abs_max"), F.percentile("cents", 0.1).alias("p10"), F.percentile("cents", 0.9).alias("p90")
    )


@query("agg05_pitch_class_percentiles", f"{with_('p')}, {_CENTS}, {_BY_CLASS} SELECT session_id, {_NAMES}[pc + 1] AS name, n, median, abs_max, p10, p90, p90 - p10 AS spread, row_number() OVER (PARTITION BY session_id ORDER BY n DESC, {_NAMES}[pc + 1]) AS place FROM k")
def agg05(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = by_class(cents_rows(spark, sf_dir)).withColumn("name", pitch.class_name(F.col("pc")))
    place = F.row_number().over(W.partitionBy("session_id").orderBy(F.col("n").desc(), "name"))
    return rows.select("session_id", "name", "n", "median", "abs_max", "p10", "p90", (F.col("p90") - F.col("p10")).alias("spread"), place.alias("place"))


@query(
    "agg06_intonation_summary",
    f"""{with_('p')}, {_CENTS}, h AS (SELECT session_id, count(*) FILTER (WHERE amplitude >= 60) AS high FROM c GROUP BY 1), b AS (SELECT c.*, high FROM c JOIN h USING (session_id) WHERE high = 0 OR amplitude >= 60)
    SELECT session_id, max(high) AS high, count(*) AS basis, median(cents) AS median, quantile_cont(cents, 0.1) AS p10, quantile_cont(cents, 0.9) AS p90, count(*) FILTER (WHERE abs(cents) <= 15) / count(*)::DOUBLE AS in_tune FROM b GROUP BY 1""",
)
def agg06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over the surest notes if a session has any, else over all of them."""
    sure = F.col("amplitude") >= 60
    rows = cents_rows(spark, sf_dir).withColumn("high", F.count_if(sure).over(W.partitionBy("session_id"))).where((F.col("high") == 0) | sure)
    return rows.groupBy("session_id").agg(
        F.max("high").alias("high"), F.count("*").alias("basis"), F.median("cents").alias("median"), F.percentile("cents", 0.1).alias("p10"), F.percentile("cents", 0.9).alias("p90"),
        (F.count_if(F.abs("cents") <= 15) / F.count("*").cast("double")).alias("in_tune"),
    )


_BY_BAR = "m AS (SELECT session_id, measure, count(*) AS n, median(cents) AS median, max(abs(cents)) AS abs_max, min(t) AS start FROM c GROUP BY ALL)"


def by_bar(rows: DataFrame) -> DataFrame:
    return rows.groupBy("session_id", "measure").agg(F.count("*").alias("n"), F.median("cents").alias("median"), F.max(F.abs("cents")).alias("abs_max"), F.min("t").alias("start"))


@query("agg07_intonation_by_measure", f"{with_('p')}, {_CENTS}, {_BY_BAR} SELECT * FROM m")
def agg07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_bar(cents_rows(spark, sf_dir))


@query(
    "rul02_intonation_bar_rule",
    f"{with_('p')}, {_CENTS}, {_BY_BAR} SELECT session_id, measure, CASE WHEN abs(median) >= 25 AND abs_max >= 40 THEN 'alert' ELSE 'warn' END AS severity FROM m WHERE n >= 4 AND (abs(median) >= 15 OR abs_max >= 40)",
)
def rul02(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, most = F.abs("median"), F.col("abs_max")
    rows = by_bar(cents_rows(spark, sf_dir)).where((F.col("n") >= 4) & ((m >= 15) | (most >= 40)))
    return rows.select("session_id", "measure", F.when((m >= 25) & (most >= 40), "alert").otherwise("warn").alias("severity"))


@query(
    "rul03_pitch_class_rule",
    f"""{with_('p')}, {_CENTS}, {_BY_CLASS}, w AS (SELECT session_id, pc, state_idx FROM c QUALIFY row_number() OVER (PARTITION BY session_id, pc ORDER BY abs(cents) DESC, state_idx) = 1)
    SELECT session_id, pc, CASE WHEN abs(median) >= 20 OR p90 - p10 >= 70 THEN 'alert' ELSE 'warn' END AS severity, state_idx AS anchor FROM k JOIN w USING (session_id, pc) WHERE n >= 5 AND (abs(median) >= 10 OR p90 - p10 >= 50)""",
)
def rul03(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cents_rows(spark, sf_dir)
    worst = rows.groupBy("session_id", "pc").agg((-F.max(F.struct(F.abs("cents"), (-F.col("state_idx")).alias("i")))["i"]).alias("anchor"))
    spread, m = F.col("p90") - F.col("p10"), F.abs("median")
    off = by_class(rows).where((F.col("n") >= 5) & ((m >= 10) | (spread >= 50)))
    return off.withColumn("severity", F.when((m >= 20) | (spread >= 70), "alert").otherwise("warn")).join(worst, ["session_id", "pc"]).select("session_id", "pc", "severity", "anchor")


@query(
    "rul12_measure_tempo",
    f"""{with_('p')}, b AS (SELECT session_id, measure, min(t) AS start FROM p GROUP BY ALL), g AS (SELECT *, lead(start) OVER (PARTITION BY session_id ORDER BY measure) - start AS duration FROM b), md AS (SELECT session_id, median(duration) AS med, array_to_string(list(measure ORDER BY measure), ',') AS available FROM g GROUP BY 1)
    SELECT md.session_id, duration, 100 * (duration - med) / nullif(med, 0) AS pct, CASE WHEN measure IS NULL THEN available END AS available_measures FROM md LEFT JOIN g ON g.session_id = md.session_id AND g.measure = 4""",
)
def rul12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bar 4's duration against the median; a session without it says which bars it has."""
    bars = perf_notes(spark, sf_dir).groupBy("session_id", "measure").agg(F.min("t").alias("start"))
    bars = bars.withColumn("duration", F.lead("start").over(W.partitionBy("session_id").orderBy("measure")) - F.col("start"))
    whole = bars.groupBy("session_id").agg(F.median("duration").alias("med"), F.array_join(F.sort_array(F.collect_list("measure")), ",").alias("available"))
    asked = bars.where("measure = 4").select("session_id", "measure", "duration")
    pct = 100 * (F.col("duration") - F.col("med")) / F.nullif(F.col("med"), F.lit(0.0))
    return whole.join(asked, "session_id", "left").select("session_id", "duration", pct.alias("pct"), F.when(F.col("measure").isNull(), F.col("available")).alias("available_measures"))


@query(
    "agg08_voicing_by_measure",
    f"""{with_('p')}, x AS (SELECT session_id, CASE WHEN state_idx % 11 = 0 THEN NULL ELSE measure END AS measure, amplitude - 40 AS margin FROM p)
    SELECT session_id, coalesce(measure::VARCHAR, '(unknown)') AS measure, count(*) AS n, median(margin) AS median, count(*) FILTER (WHERE margin < 3) AS weak FROM x GROUP BY ALL""",
)
def agg08(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without a bar form a group of their own."""
    bar = F.when(F.col("state_idx") % 11 != 0, F.col("measure")).cast("string")
    rows = perf_notes(spark, sf_dir).select("session_id", F.coalesce(bar, F.lit("(unknown)")).alias("measure"), (F.col("amplitude") - 40).alias("margin"))
    return rows.groupBy("session_id", "measure").agg(F.count("*").alias("n"), F.median("margin").alias("median"), F.count_if(F.col("margin") < 3).alias("weak"))


@query(
    "agg09_drill_metrics",
    f"""{with_('p')}, f AS (SELECT session_id, pitch, count(*) AS n, min((t, state_idx)) AS first FROM p GROUP BY ALL), m AS (SELECT session_id, max_by(pitch, (n, -(first[1]))) AS mode FROM f GROUP BY 1)
    SELECT p.session_id, count(*) AS n_notes, count(DISTINCT pitch) AS unique_pitches, round(avg(amplitude), 6) AS amplitude, any_value(mode) AS top_pitch, count(*) < 4 AS low_signal FROM p JOIN m USING (session_id) GROUP BY 1""",
)
def agg09(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent pitch is the earlier one on a tie."""
    notes = perf_notes(spark, sf_dir)
    each = notes.groupBy("session_id", "pitch").agg(F.count("*").alias("n"), F.min("t").alias("first"))
    mode = each.groupBy("session_id").agg(F.max(F.struct("n", (-F.col("first")).alias("f"), "pitch"))["pitch"].alias("top_pitch"), F.sum("n").alias("n_notes"), F.count("*").alias("unique_pitches"))
    level = notes.groupBy("session_id").agg(F.round(F.avg("amplitude"), 6).alias("amplitude"))
    return mode.join(level, "session_id").select("session_id", "n_notes", "unique_pitches", "amplitude", "top_pitch", (F.col("n_notes") < 4).alias("low_signal"))


@query("agg10_pitch_class_histogram", f"{with_('p')} SELECT session_id, {_NAMES}[pitch % 12 + 1] AS name, count(*) AS n FROM p GROUP BY ALL")
def agg10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perf_notes(spark, sf_dir).groupBy("session_id", pitch.class_name(F.col("pitch")).alias("name")).agg(F.count("*").alias("n"))


@query(
    "agg11_timeline_dense",
    f"""{with_('p')}, e AS (SELECT session_id, min(measure) AS lo, max(measure) AS hi FROM p GROUP BY 1), s AS (SELECT session_id, unnest(generate_series(lo, hi)) AS measure FROM e),
    a AS (SELECT session_id, measure, min(t) AS first, max(t) AS last, count(*) AS n, count(*) FILTER (WHERE matched) AS matched FROM p GROUP BY ALL)
    SELECT session_id, measure, first, last, coalesce(n, 0) AS n, concat_ws(',', CASE WHEN n IS NULL THEN 'empty' END, CASE WHEN n >= 5 THEN 'dense' END, CASE WHEN n > 0 AND matched = 0 THEN 'no_matches' END) AS flags FROM s LEFT JOIN a USING (session_id, measure)""",
)
def agg11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for every bar of the range, with flags."""
    notes = perf_notes(spark, sf_dir)
    spine = ordered.dense_spine(notes.groupBy("session_id").agg(F.min("measure").alias("lo"), F.max("measure").alias("hi")), ["session_id"], "lo", "hi", "measure")
    bars = notes.groupBy("session_id", "measure").agg(F.min("t").alias("first"), F.max("t").alias("last"), F.count("*").alias("n"), F.count_if("matched").alias("m"))
    flags = F.concat_ws(",", F.when(F.col("n").isNull(), "empty"), F.when(F.col("n") >= 5, "dense"), F.when((F.col("n") > 0) & (F.col("m") == 0), "no_matches"))
    return spine.join(bars, ["session_id", "measure"], "left").select("session_id", "measure", "first", "last", F.coalesce("n", F.lit(0)).alias("n"), flags.alias("flags"))


@query(
    "agg12_outline_dedup",
    f"""{with_('p')}, l AS (SELECT *, lag(pitch % 12) OVER (PARTITION BY session_id, measure ORDER BY t, state_idx) AS before FROM p)
    SELECT session_id, measure, array_to_string(list({_NAMES}[pitch % 12 + 1] ORDER BY t, state_idx), ' ') AS outline FROM l WHERE before IS NULL OR before <> pitch % 12 GROUP BY ALL""",
)
def agg12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bar's pitch classes in order, repetitions in a row once."""
    name = pitch.class_name(F.col("pitch"))
    notes = perf_notes(spark, sf_dir).withColumn("name", name)
    before = F.lag("name").over(W.partitionBy("session_id", "measure").orderBy("t", "state_idx"))
    kept = notes.withColumn("before", before).where(F.col("before").isNull() | (F.col("before") != F.col("name")))
    rows = kept.groupBy("session_id", "measure").agg(F.sort_array(F.collect_list(F.struct("t", "state_idx", "name"))).alias("x"))
    return rows.select("session_id", "measure", F.array_join(F.transform("x", lambda e: e["name"]), " ").alias("outline"))


@query(
    "agg13_loudness_stats",
    f"""{with_('p', 'o')}, q AS (SELECT session_id, quantile_cont(loudness_db, 0.2) AS p20 FROM o GROUP BY 1)
    SELECT session_id, min(loudness_db) AS low, max(loudness_db) AS high, median(loudness_db) AS median, quantile_cont(loudness_db, 0.9) FILTER (WHERE loudness_db > p20) - quantile_cont(loudness_db, 0.1) FILTER (WHERE loudness_db > p20) AS active_range FROM o JOIN q USING (session_id) GROUP BY 1""",
)
def agg13(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = onsets(spark, sf_dir).withColumn("p20", F.percentile("loudness_db", 0.2).over(W.partitionBy("session_id")))
    active = F.when(F.col("loudness_db") > F.col("p20"), F.col("loudness_db"))
    return rows.groupBy("session_id").agg(F.min("loudness_db").alias("low"), F.max("loudness_db").alias("high"), F.median("loudness_db").alias("median"), (F.percentile(active, 0.9) - F.percentile(active, 0.1)).alias("active_range"))


@query(
    "agg14_onset_density",
    f"""{with_('p', 'o')}, e AS (SELECT session_id, floor(min(time) / 43200)::BIGINT AS lo, floor(max(time) / 43200)::BIGINT AS hi FROM o GROUP BY 1), s AS (SELECT session_id, unnest(generate_series(lo, hi)) AS win FROM e), c AS (SELECT session_id, floor(time / 43200)::BIGINT AS win, count(*) AS n FROM o GROUP BY ALL)
    SELECT session_id, win, coalesce(n, 0) AS n FROM s LEFT JOIN c USING (session_id, win) QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY coalesce(n, 0) DESC, win) <= 8""",
)
def agg14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also TOP-03: the eight densest windows, empty ones counted."""
    rows = onsets(spark, sf_dir).withColumn("win", F.floor(F.col("time") / 43_200))
    spine = ordered.dense_spine(rows.groupBy("session_id").agg(F.min("win").alias("lo"), F.max("win").alias("hi")), ["session_id"], "lo", "hi", "win")
    counts = spine.join(rows.groupBy("session_id", "win").agg(F.count("*").alias("n")), ["session_id", "win"], "left").fillna(0, ["n"])
    return counts.withColumn("r", F.row_number().over(W.partitionBy("session_id").orderBy(F.col("n").desc(), "win"))).where("r <= 8").drop("r")


@query("agg16_usage_rollup", "SELECT l_returnflag AS model, sum(l_quantity * 1000)::BIGINT AS input, sum(floor(l_quantity * 1000 * l_discount))::BIGINT AS cached, count(*) AS calls FROM lineitem GROUP BY 1")
def agg16(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = F.col("l_quantity") * 1000
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("model")).agg(F.sum(asked).cast("bigint").alias("input"), F.sum(F.floor(asked * F.col("l_discount"))).cast("bigint").alias("cached"), F.count("*").alias("calls"))


@query("agg17_layout_counts", "SELECT n_regionkey AS page, sum(CASE WHEN n_nationkey % 4 = 0 THEN 1 ELSE n_nationkey % 5 + 1 END)::BIGINT AS measures, min(n_nationkey) AS first, max(n_nationkey) AS last FROM nation GROUP BY 1")
def agg17(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also AGG-18: bars of a page, by range where a system has one, and the page's own range."""
    bars = F.when(F.col("n_nationkey") % 4 == 0, 1).otherwise(F.col("n_nationkey") % 5 + 1)
    return table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("page")).agg(F.sum(bars).alias("measures"), F.min("n_nationkey").alias("first"), F.max("n_nationkey").alias("last"))


@query("agg20_envelope_and_match", f"{with_('p')} SELECT session_id, min(t) FILTER (WHERE matched) AS first, max(t) FILTER (WHERE matched) AS last, count(*) FILTER (WHERE matched) / count(*)::DOUBLE AS match_rate, 1 + max(pitch % 3) AS staves FROM p GROUP BY 1")
def agg20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also AGG-21."""
    t = F.when(F.col("matched"), F.col("t"))
    return perf_notes(spark, sf_dir).groupBy("session_id").agg(F.min(t).alias("first"), F.max(t).alias("last"), (F.count_if("matched") / F.count("*").cast("double")).alias("match_rate"), (F.max(F.col("pitch") % 3) + 1).alias("staves"))


@query(
    "agg22_strong_quartile",
    f"""{with_('p', 'o')}, r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY loudness_db, state_idx) AS r, count(*) OVER (PARTITION BY session_id) AS n FROM o), th AS (SELECT session_id, loudness_db AS limit_db FROM r WHERE r = floor(n * 3 / 4)::BIGINT + 1)
    SELECT session_id, count(*) AS n, count(*) FILTER (WHERE loudness_db >= limit_db) AS n_strong, median(loudness_db) AS median FROM o JOIN th USING (session_id) GROUP BY 1""",
)
def agg22(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strong: at or above the element at three quarters of the sorted list."""
    session = W.partitionBy("session_id")
    rows = onsets(spark, sf_dir).withColumn("r", F.row_number().over(session.orderBy("loudness_db", "state_idx"))).withColumn("n", F.count("*").over(session))
    rows = rows.withColumn("limit_db", F.max(F.when(F.col("r") == F.floor(F.col("n") * 3 / 4) + 1, F.col("loudness_db"))).over(session))
    return rows.groupBy("session_id").agg(F.count("*").alias("n"), F.count_if(F.col("loudness_db") >= F.col("limit_db")).alias("n_strong"), F.median("loudness_db").alias("median"))


@query("agg23_score_inventory", f"{with_('s')} SELECT piece_id, array_to_string(list(measure::VARCHAR || ':' || pitch::VARCHAR ORDER BY measure, pitch), ' ') AS inventory FROM s GROUP BY 1")
def agg23(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = score_notes(spark, sf_dir).groupBy("piece_id").agg(F.sort_array(F.collect_list(F.struct("measure", "pitch"))).alias("x"))
    item = lambda e: F.concat(e["measure"].cast("string"), F.lit(":"), e["pitch"].cast("string"))
    return rows.select("piece_id", F.array_join(F.transform("x", item), " ").alias("inventory"))


@query("agg25_timestamp_dedupe", f"{with_('p')} SELECT session_id, measure, greatest(min(t - 100000), 0) AS start, count(*) AS n, max(t) AS last FROM p GROUP BY ALL")
def agg25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also AGG-27: the first time of each bar, never negative."""
    return perf_notes(spark, sf_dir).groupBy("session_id", "measure").agg(F.greatest(F.min(F.col("t") - 100_000), F.lit(0.0)).alias("start"), F.count("*").alias("n"), F.max("t").alias("last"))


@query(
    "agg26_spearman",
    """WITH r AS (SELECT l_suppkey, rank() OVER (PARTITION BY l_suppkey ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_suppkey, l_quantity) - 1) / 2.0 AS a, rank() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_suppkey, l_extendedprice) - 1) / 2.0 AS b FROM lineitem)
    SELECT l_suppkey, round(corr(a, b), 9) AS rho FROM r GROUP BY 1""",
)
def agg26(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_quantity", "l_extendedprice")
    ranked = ordered.average_rank(ordered.average_rank(rows, ["l_suppkey"], "l_quantity", "a"), ["l_suppkey"], "l_extendedprice", "b")
    return ranked.groupBy("l_suppkey").agg(F.round(F.corr("a", "b"), 9).alias("rho"))


@query("top01_loudest_regions", f"{with_('p', 'o')} SELECT session_id, greatest(time - 1, 0) AS start, time + 1 AS \"end\", loudness_db FROM o QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY loudness_db DESC, state_idx) <= 8")
def top01(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("session_id").orderBy(F.col("loudness_db").desc(), "state_idx"))
    return onsets(spark, sf_dir).withColumn("r", rank).where("r <= 8").select("session_id", F.greatest(F.col("time") - 1, F.lit(0.0)).alias("start"), (F.col("time") + 1).alias("end"), "loudness_db")


@query(
    "top02_quietest_active",
    f"{with_('p', 'o')}, q AS (SELECT session_id, quantile_cont(loudness_db, 0.25) AS p25 FROM o GROUP BY 1) SELECT o.session_id, state_idx, loudness_db FROM o JOIN q USING (session_id) WHERE loudness_db > p25 QUALIFY row_number() OVER (PARTITION BY o.session_id ORDER BY loudness_db, state_idx) <= 8",
)
def top02(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = W.partitionBy("session_id")
    rows = onsets(spark, sf_dir).withColumn("p25", F.percentile("loudness_db", 0.25).over(session)).where("loudness_db > p25")
    return rows.withColumn("r", F.row_number().over(session.orderBy("loudness_db", "state_idx"))).where("r <= 8").select("session_id", "state_idx", "loudness_db")


@query(
    "top04_worst_voicing",
    f"""{with_('p')}, x AS (SELECT session_id, state_idx, amplitude - 40 AS margin, t % 60 AS attack FROM p)
    SELECT 'margin' AS list, session_id, state_idx FROM x QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY margin, state_idx) <= 12
    UNION ALL SELECT 'attack', session_id, state_idx FROM x QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY attack DESC, state_idx) <= 12""",
)
def top04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also RUL-06: the 12 weakest margins and the 12 widest attacks of a session."""
    rows = perf_notes(spark, sf_dir).select("session_id", "state_idx", (F.col("amplitude") - 40).alias("margin"), (F.col("t") % 60).alias("attack"))
    session = W.partitionBy("session_id")
    ranks = F.array(
        F.struct(F.lit("margin").alias("list"), F.row_number().over(session.orderBy("margin", "state_idx")).alias("r")),
        F.struct(F.lit("attack").alias("list"), F.row_number().over(session.orderBy(F.col("attack").desc(), "state_idx")).alias("r")),
    )
    return rows.withColumn("x", ranks).select("session_id", "state_idx", F.inline("x")).where("r <= 12").select("list", "session_id", "state_idx")


@query("top05_top2_per_bar", "SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) <= 2")
def top05(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("l_suppkey").orderBy(F.col("l_extendedprice").desc(), "l_orderkey", "l_linenumber"))
    return table(spark, sf_dir, "lineitem").withColumn("r", rank).where("r <= 2").select("l_orderkey", "l_linenumber", "l_suppkey")


@query("top08_fixed_caps", "SELECT event_id FROM events ORDER BY value DESC, event_id LIMIT 40")
def top08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").orderBy(F.col("value").desc(), "event_id").limit(40).select("event_id")


@query("fn01_midi_name", f"{with_('p')} SELECT state_idx, {_NAMES}[((pitch - 60) % 12 + 12) % 12 + 1] || (floor((pitch - 60) / 12.0) - 1)::BIGINT::VARCHAR AS low_name, {_NAMES}[pitch % 12 + 1] || (pitch // 12 - 1)::VARCHAR AS name FROM p")
def fn01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perf_notes(spark, sf_dir).select("state_idx", pitch.midi_name(F.col("pitch") - 60).alias("low_name"), pitch.midi_name(F.col("pitch")).alias("name"))


@query("fn02_name_midi", f"{with_('p')} SELECT state_idx, pitch AS midi, pitch AS again FROM p")
def fn02(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and numeric strings lead back to the pitch."""
    named = pitch.midi_name(F.col("pitch"))
    return perf_notes(spark, sf_dir).select("state_idx", pitch.name_midi(named).alias("midi"), pitch.name_midi(F.concat(F.col("pitch").cast("string"), F.lit(".2"))).alias("again"))


@query(
    "fn03_frequencies",
    f"""{with_('p')}, h AS (SELECT state_idx, pitch, 440.0 * pow(2.0, (pitch - 69) / 12.0) AS hz FROM p)
    SELECT state_idx, round(hz, 6) AS hz, round(69.0 + 12.0 * log2(hz / 440.0), 6) AS midi, round(log2(hz / 65.40639) * 60, 6) AS bin, round(20.0 * log10(greatest(hz, 1e-9) / 440.0), 6) AS db FROM h""",
)
def fn03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also FN-04 and FN-07."""
    hz = pitch.midi_hz(F.col("pitch"))
    return perf_notes(spark, sf_dir).select(
        "state_idx", F.round(hz, 6).alias("hz"), F.round(pitch.hz_midi(hz), 6).alias("midi"), F.round(pitch.log_bin(F.col("pitch"), 65.40639, 60), 6).alias("bin"), F.round(pitch.decibels(hz, 440.0), 6).alias("db")
    )


@query("fn05_cents", f"{with_('p')} SELECT state_idx, round((amplitude - round_even(amplitude, 0)) * 100, 6) AS cents FROM p")
def fn05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perf_notes(spark, sf_dir).select("state_idx", F.round(pitch.cents(F.col("amplitude")), 6).alias("cents"))


@query(
    "fn06_temperament",
    f"""{with_('p')}, x AS (SELECT state_idx, amplitude - 50 AS c, [0.0, 111.73, 203.91, 315.64, 386.31, 498.04, 590.22, 701.96, 813.69, 884.36, 996.09, 1088.27][pitch % 12 + 1]::DOUBLE - (pitch % 12) * 100.0::DOUBLE AS just, [0.0, 113.69, 203.91, 294.13, 407.82, 498.04, 611.73, 701.96, 815.64, 905.87, 1019.55, 1109.78][pitch % 12 + 1]::DOUBLE - (pitch % 12) * 100.0::DOUBLE AS pyth FROM p)
    SELECT state_idx, CASE WHEN abs(c) <= abs(c - just) AND abs(c) <= abs(c - pyth) THEN '12_tet' WHEN abs(c - just) <= abs(c - pyth) THEN 'just' ELSE 'pythagorean' END AS best FROM x""",
)
def fn06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The temperament nearest to the note, the first of the three on a tie."""
    return perf_notes(spark, sf_dir).select("state_idx", pitch.best_temperament(F.col("amplitude") - 50, F.col("pitch")).alias("best"))


@query("fn08_labels", f"{with_('p')} SELECT state_idx, CASE WHEN amplitude - 50 < 0 THEN 'buried' WHEN amplitude - 50 < 3 THEN 'weak' WHEN amplitude - 50 < 7 THEN 'clear' ELSE 'dominant' END AS projection FROM p")
def fn08(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also FN-10."""
    margin = F.col("amplitude") - 50
    return perf_notes(spark, sf_dir).select("state_idx", F.when(margin < 0, "buried").when(margin < 3, "weak").when(margin < 7, "clear").otherwise("dominant").alias("projection"))


@query(
    "fn09_chord_roles",
    f"""{with_('p')}, c AS (SELECT session_id, measure, list_sort(list_distinct(list(pitch))) AS x FROM p GROUP BY ALL)
    SELECT session_id, measure, array_to_string(list_transform(x, lambda v: CASE WHEN v = list_max(x) THEN 'melody' WHEN v = list_min(x) THEN 'bass' ELSE 'inner' END), ',') AS roles FROM c""",
)
def fn09(spark: SparkSession, sf_dir: str) -> DataFrame:
    chords = perf_notes(spark, sf_dir).groupBy("session_id", "measure").agg(F.sort_array(F.collect_set("pitch")).alias("x"))
    role = lambda v: F.when(v == F.array_max("x"), "melody").when(v == F.array_min("x"), "bass").otherwise("inner")
    return chords.select("session_id", "measure", F.array_join(F.transform("x", role), ",").alias("roles"))


@query(
    "fn11_respell",
    f"""{with_('p')}, n AS (SELECT state_idx, session_id % 4 AS k, {_NAMES}[pitch % 12 + 1] AS name FROM p)
    SELECT state_idx, CASE k WHEN 0 THEN name WHEN 1 THEN replace(name, 'A#', 'Bb') WHEN 2 THEN replace(replace(replace(name, 'A#', 'Bb'), 'D#', 'Eb'), 'G#', 'Ab')
      ELSE replace(replace(replace(replace(replace(name, 'C#', 'Db'), 'D#', 'Eb'), 'F#', 'Gb'), 'G#', 'Ab'), 'A#', 'Bb') END AS spelled FROM n""",
)
def fn11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also FN-12: names as the session's key spells them."""
    key = F.element_at(F.array(*map(F.lit, ("G major", "F Major", "c-minor", "bb minor"))), (F.col("session_id") % 4 + 1).cast("int"))
    return perf_notes(spark, sf_dir).select("state_idx", pitch.spelled(pitch.class_name(F.col("pitch")), key).alias("spelled"))


@query("fn13_note_id", f"{with_('p')} SELECT state_idx, 'm' || measure::VARCHAR || '_b' || (1 + pitch % 4)::VARCHAR || '.00_' || {_NAMES}[pitch % 12 + 1] AS note_id, 100 * measure + pitch % 10 AS system_id FROM p")
def fn13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also FN-14."""
    note = F.format_string("m%d_b%.2f_%s", F.col("measure"), (F.col("pitch") % 4 + 1).cast("double"), F.array_join(F.array(pitch.class_name(F.col("pitch"))), "+"))
    return perf_notes(spark, sf_dir).select("state_idx", note.alias("note_id"), (F.col("measure") * 100 + F.col("pitch") % 10).alias("system_id"))


@query(
    "fn16_text_functions",
    """SELECT page_id, regexp_replace(url, '[0-9-]+$', '') AS base, 'cmt_' || substr(regexp_replace(url, '[^A-Za-z0-9_.-]', '_', 'g'), 1, 64) AS safe_id, regexp_extract(split_part(split_part(url, '?', 1), '#', 1), '([0-9]+)[^0-9]*$', 1) AS number,
      CASE WHEN length(html) > 800 THEN substr(html, 1, 400) || '...' || right(html, 200) ELSE html END AS capped FROM pages""",
)
def fn16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also FN-17, FN-18 and FN-23."""
    url = F.col("url")
    bare = F.substring_index(F.substring_index(url, "?", 1), "#", 1)
    return table(spark, sf_dir, "pages").select("page_id", text.without_octave(url).alias("base"), text.safe_id(url).alias("safe_id"), F.regexp_extract(bare, "([0-9]+)[^0-9]*$", 1).alias("number"), text.capped(F.col("html"), 800, 400, 200).alias("capped"))


@query(
    "fn20_fenced_json",
    r"""WITH x AS (SELECT event_id, 'note ```json ' || props || ' ``` end' AS t FROM events) SELECT event_id, regexp_extract(t, '```json *(\{[^`]*\}) *```', 1) AS body, json_extract_string(regexp_extract(t, '```json *(\{[^`]*\}) *```', 1), '$.k')::INTEGER AS k FROM x""",
)
def fn20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON inside a fence on one line, read leniently; fn20_json_block has all forms."""
    body = text.fenced_json(F.concat(F.lit("note ```json "), "props", F.lit(" ``` end")))
    return table(spark, sf_dir, "events").select("event_id", body.alias("body"), F.get_json_object(body, "$.k").try_cast("int").alias("k"))


@query("fn22_comment_normalise", f"{with_('p')} SELECT state_idx, greatest(t - 50000, 0) AS start, greatest(t - 50000, 0) + greatest(coalesce(nullif(amplitude, 0), 3), 1) AS \"end\", coalesce(CASE WHEN kind = 'error' THEN 'alert' END, 'info') AS severity FROM p")
def fn22(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.greatest(F.col("t") - 50_000, F.lit(0.0))
    length = F.greatest(F.coalesce(F.nullif("amplitude", F.lit(0.0)), F.lit(3.0)), F.lit(1.0))
    return perf_notes(spark, sf_dir).select("state_idx", start.alias("start"), (start + length).alias("end"), F.coalesce(F.when(F.col("kind") == "error", "alert"), F.lit("info")).alias("severity"))


_USAGE = """u AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'A' AND l_linenumber % 3 = 0 THEN 'gemini-3.1-pro-preview' WHEN l_returnflag = 'A' AND l_linenumber % 3 = 1 THEN 'gemini-3-pro' WHEN l_returnflag = 'A' THEN 'gemini-2.5-pro' WHEN l_returnflag = 'N' THEN 'gemini-2.5-flash-lite' ELSE 'other' END AS model, (l_quantity * 6000)::BIGINT AS input, (l_extendedprice / 100)::BIGINT AS output,
  greatest(0, least(floor(l_quantity * 6000 * l_discount * 12)::BIGINT, (l_quantity * 6000)::BIGINT)) AS hit FROM lineitem)"""


@query(
    "fn24_cost",
    f"""WITH {_USAGE} SELECT l_orderkey, l_linenumber, floor(CASE WHEN model LIKE '%pro%' THEN ((input - hit) * 1.25::DOUBLE + hit * 1.25::DOUBLE * 0.25::DOUBLE + output * CASE WHEN model LIKE 'gemini-3%' THEN 12.0::DOUBLE ELSE 10.0::DOUBLE END)
      WHEN model = 'gemini-2.5-flash-lite' THEN ((input - hit) * 0.3::DOUBLE + hit * 0.3::DOUBLE * 0.25::DOUBLE + output * 2.5::DOUBLE) END + 0.5) / 1e6 AS cost FROM u""",
)
def fn24(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices by the first prefix of the model's name that fits; cached input at a quarter; null for unknown models."""
    usage = costs.bound_usage(table(spark, sf_dir, "lineitem"))
    return usage.select("l_orderkey", "l_linenumber", costs.cost(F.col("model"), F.col("input"), F.col("output"), F.col("cached")).alias("cost"))


@query(
    "fn25_chat_cost",
    f"""WITH {_USAGE}, t AS (SELECT *, CASE WHEN input > 200000 THEN 5.0::DOUBLE ELSE 1.25::DOUBLE END AS tier FROM u)
    SELECT l_orderkey, l_linenumber, floor(CASE WHEN model LIKE '%pro%' THEN (input - hit) * tier + hit * tier * 0.25::DOUBLE + output * CASE WHEN model LIKE 'gemini-3.1%' THEN 12.0::DOUBLE ELSE 10.0::DOUBLE END
      WHEN model = 'gemini-2.5-flash-lite' THEN (input - hit) * 0.075::DOUBLE + hit * 0.075::DOUBLE * 0.25::DOUBLE + output * 0.3::DOUBLE ELSE input * 1.25::DOUBLE + output * 10.0::DOUBLE END + 0.5) / 1e6 AS cost FROM t""",
)
def fn25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dearer tier for long inputs of one family, other prices for the rest."""
    usage = costs.bound_usage(table(spark, sf_dir, "lineitem"))
    return usage.select("l_orderkey", "l_linenumber", costs.chat_cost(F.col("model"), F.col("input"), F.col("output"), F.col("cached")).alias("cost"))


@query(
    "fn27_key_and_meter",
    """SELECT l_orderkey, l_linenumber, ['Cb','Gb','Db','Ab','Eb','Bb','F','C','G','D','A','E','B','F#','C#'][(l_partkey % 15 + 1)::INTEGER] AS key, (l_linenumber * 4 / 8.0)::DOUBLE AS quarters, l_quantity > 0 AND l_tax < 0.07 AND l_quantity / 10 >= greatest(1 / 16.0, 0.25 * l_linenumber) AS valid, greatest(0, least(1, l_discount * 12)) AS x FROM lineitem""",
)
def fn27(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also FN-28: key names by fifths, quarters of a meter, bars of a least length, clamped numbers."""
    valid = (F.col("l_quantity") > 0) & (F.col("l_tax") < 0.07) & (F.col("l_quantity") / 10 >= F.greatest(F.lit(1 / 16), F.lit(0.25) * F.col("l_linenumber")))
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", pitch.key_name((F.col("l_partkey") % 15 - 7).cast("int")).alias("key"), (F.col("l_linenumber") * 4 / F.lit(8.0)).alias("quarters"), valid.alias("valid"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("l_discount") * 12)).alias("x"),
    )


_INSTRUMENTS = ("Grand Piano", "Violin (solo)", "violin", "Viola da gamba", "Violoncello", "Flute", "", "Church organ")


@query(
    "fn31_profiles",
    """WITH i AS (SELECT p_partkey, ['Grand Piano', 'Violin (solo)', 'violin', 'Viola da gamba', 'Violoncello', 'Flute', '', 'Church organ'][p_size % 8 + 1] AS s FROM part),
    q AS (SELECT p_partkey, CASE WHEN s IN ('Grand Piano', 'Church organ') THEN 'piano' WHEN lower(s) LIKE 'violin%' AND s <> 'Violoncello' THEN 'violin_solo' WHEN s LIKE 'Viola%' THEN 'viola_solo' WHEN s = 'Violoncello' THEN 'cello_solo' END AS profile FROM i)
    SELECT p_partkey, profile, CASE WHEN profile IN ('piano', 'violin_solo') THEN profile ELSE 'default' END AS used FROM q""",
)
def fn31(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also FN-32: the first rule that fits, then the known profile or the default."""
    named = F.element_at(F.array(*map(F.lit, _INSTRUMENTS)), (F.col("p_size") % 8 + 1).cast("int"))
    rows = table(spark, sf_dir, "part").select("p_partkey", profiles.profile_of(named).alias("profile"))
    return rows.select("p_partkey", "profile", profiles.known_profile(F.col("profile"), ["piano", "violin_solo"]).alias("used"))


@query("fn37_map_merge", "SELECT s_suppkey, coalesce(CASE WHEN s_suppkey % 2 = 0 THEN 'own' END, 'base') AS a, 'base' AS b, replace(replace('{x} in {y}', '{x}', s_name), '{y}', s_nationkey::VARCHAR) AS filled, CASE WHEN s_acctbal < 0 THEN '—' ELSE 'ok' END AS cell FROM supplier")
def fn37(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also FN-33 and FN-39: maps merged with the later one winning, templates, table cells."""
    base = F.create_map(F.lit("a"), F.lit("base"), F.lit("b"), F.lit("base"))
    own = F.when(F.col("s_suppkey") % 2 == 0, F.create_map(F.lit("a"), F.lit("own"))).otherwise(F.create_map().cast("map<string,string>"))
    merged = F.map_concat(F.map_filter(base, lambda k, v: ~F.map_contains_key(own, k)), own)
    filled = F.replace(F.replace(F.lit("{x} in {y}"), F.lit("{x}"), F.col("s_name")), F.lit("{y}"), F.col("s_nationkey").cast("string"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", merged["a"].alias("a"), merged["b"].alias("b"), filled.alias("filled"), F.when(F.col("s_acctbal") < 0, "—").otherwise("ok").alias("cell"))


@query(
    "sig02_parabolic_peak",
    f"""{with_('f')}, i AS (SELECT frame_idx, mag, list_position(mag[2:63], list_max(mag[2:63])) + 1 AS k FROM f), x AS (SELECT frame_idx, k, mag[k-1] AS a, mag[k] AS b, mag[k+1] AS c, list_median(mag) AS fl FROM i)
    SELECT frame_idx, k - 1 AS bin, round(CASE WHEN a - 2 * b + c = 0 THEN 0 ELSE greatest(-1, least(1, 0.5 * (a - c) / (a - 2 * b + c))) END, 9) AS shift, b / fl >= 1.5 AS present FROM x""",
)
def sig02(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also SIG-03: the strongest inner bin, refined by a parabola, against the spectrum's median."""
    return spectra.peaks(frames(spark, sf_dir), 1.5).select("frame_idx", "bin", F.round("shift", 9).alias("shift"), "present")


@query("sig04_band_energy", f"{with_('f')} SELECT session_id, round(avg(list_max(mag[29:33])), 9) AS energy, count(*) AS frames FROM f GROUP BY 1")
def sig04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean over frames of the largest of five bins around bin 30."""
    return frames(spark, sf_dir).groupBy("session_id").agg(F.round(F.avg(spectra.band(F.col("mag"), 30, 2)), 9).alias("energy"), F.count("*").alias("frames"))


@query(
    "sig05_attack_offset",
    f"""{with_('f')}, e AS (SELECT session_id, frame_idx, list_max(mag[29:33]) AS v FROM f), th AS (SELECT session_id, quantile_cont(v, 0.1) + 0.55 * (max(v) - quantile_cont(v, 0.1)) AS limit_v FROM e GROUP BY 1)
    SELECT session_id, min(frame_idx) AS attack FROM e JOIN th USING (session_id) WHERE v >= limit_v GROUP BY 1""",
)
def sig05(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first frame that rises above a share of the way from the quiet level to the peak."""
    return spectra.attack(frames(spark, sf_dir), 30, 2, 0.55)


@query("sig07_pitch_class_profile", f"{with_('f')}, u AS (SELECT frame_idx, unnest(mag) AS v, generate_subscripts(mag, 1) AS i FROM f), c AS (SELECT frame_idx, (i - 1) % 12 AS pc, sum(v) AS e FROM u GROUP BY ALL) SELECT frame_idx, pc::INTEGER AS pc FROM c QUALIFY row_number() OVER (PARTITION BY frame_idx ORDER BY e DESC, pc) = 1")
def sig07(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pitch class with the most energy."""
    return frames(spark, sf_dir).select("frame_idx", spectra.strongest_class(F.col("mag")).alias("pc"))


@query(
    "sig09_dynamics_window",
    f"""{with_('p')}, a AS (SELECT session_id, state_idx, avg(amplitude) OVER (PARTITION BY session_id ORDER BY t, state_idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS smooth FROM p)
    SELECT session_id, round(quantile_cont(smooth, 0.9) - quantile_cont(smooth, 0.1), 6) AS range_db, round(max(smooth), 6) AS peak FROM a GROUP BY 1""",
)
def sig09(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = W.partitionBy("session_id").orderBy("t", "state_idx").rowsBetween(-2, 2)
    rows = perf_notes(spark, sf_dir).withColumn("smooth", F.avg("amplitude").over(near))
    return rows.groupBy("session_id").agg(F.round(F.percentile("smooth", 0.9) - F.percentile("smooth", 0.1), 6).alias("range_db"), F.round(F.max("smooth"), 6).alias("peak"))


@query(
    "snk03_markdown_report",
    f"""{with_('p')}, b AS (SELECT session_id, measure, count(*) AS n, min(t) AS start FROM p GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY n DESC, measure) AS r FROM b)
    SELECT session_id, '# Session ' || session_id::VARCHAR || chr(10) || array_to_string(list('| ' || measure::VARCHAR || ' | ' || n::VARCHAR || ' |' ORDER BY r), chr(10)) AS report FROM r WHERE r <= 5 GROUP BY 1""",
)
def snk03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A header and the five fullest bars as text."""
    bars = perf_notes(spark, sf_dir).groupBy("session_id", "measure").agg(F.count("*").alias("n"))
    top = bars.withColumn("r", F.row_number().over(W.partitionBy("session_id").orderBy(F.col("n").desc(), "measure"))).where("r <= 5")
    line = lambda e: F.format_string("| %d | %d |", e["measure"], e["n"])
    rows = top.groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("r", "measure", "n"))).alias("x"))
    return rows.select("session_id", F.concat(F.format_string("# Session %d\n", F.col("session_id")), F.array_join(F.transform("x", line), "\n")).alias("report"))


@query("snk04_legacy_shape", f"{with_('p')} SELECT session_id, state_idx, t AS perf_time, t AS performed_time_sec, pitch AS expected_pitch, pitch AS score_midi_pitch, measure AS bar FROM p")
def snk04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old column names beside the new ones."""
    return perf_notes(spark, sf_dir).select("session_id", "state_idx", F.col("t").alias("perf_time"), F.col("t").alias("performed_time_sec"), F.col("pitch").alias("expected_pitch"), F.col("pitch").alias("score_midi_pitch"), F.col("measure").alias("bar"))


@query(
    "rul11_prior_context",
    """WITH x AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders WHERE o_orderstatus <> 'O')
    SELECT o_custkey, array_to_string(list('take ' || r::VARCHAR || ': ' || o_orderkey::VARCHAR ORDER BY r), '; ') AS context FROM x WHERE r <= 8 GROUP BY 1""",
)
def rul11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also FLT-12: the first eight earlier takes as text."""
    rank = F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    rows = table(spark, sf_dir, "orders").where("o_orderstatus <> 'O'").withColumn("r", rank).where("r <= 8")
    rows = rows.groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("r", "o_orderkey"))).alias("x"))
    return rows.select("o_custkey", F.array_join(F.transform("x", lambda e: F.format_string("take %d: %d", e["r"], e["o_orderkey"])), "; ").alias("context"))


@query(
    "rul16_layout_document",
    """WITH m AS (SELECT o_custkey AS page, o_orderkey AS system, l_linenumber AS measure, l_quantity > 8 AS valid FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
    s AS (SELECT page, system, min(measure) AS first, max(measure) AS last, count(*) AS n, string_agg(measure::VARCHAR, ',' ORDER BY measure) AS bars FROM m WHERE valid GROUP BY ALL),
    p AS (SELECT page, count(*) AS systems, sum(n) AS n, min(first) AS first, max(last) AS last, string_agg(system::VARCHAR || ':' || first::VARCHAR || '-' || last::VARCHAR || '[' || bars || ']', ' ' ORDER BY system) AS layout FROM s GROUP BY 1)
    SELECT x.page, CASE WHEN n IS NULL OR (systems < 3 AND n < 3) THEN 'front_matter' ELSE 'music' END AS kind, CASE WHEN systems < 3 AND n < 3 THEN 0 ELSE coalesce(systems, 0) END AS system_count,
      CASE WHEN NOT (systems < 3 AND n < 3) THEN first END AS first_measure, CASE WHEN NOT (systems < 3 AND n < 3) THEN last END AS last_measure, CASE WHEN NOT (systems < 3 AND n < 3) THEN layout END AS layout
    FROM (SELECT DISTINCT page FROM m) x LEFT JOIN p USING (page)""",
)
def rul16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with their systems and these with their bars; systems without a valid bar are left out, and a page of fewer
    than three systems and three bars is front matter."""
    measures = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    measures = measures.select(F.col("o_custkey").alias("page"), F.col("o_orderkey").alias("system"), F.col("l_linenumber").alias("measure"), (F.col("l_quantity") > 8).alias("valid"))
    systems = measures.groupBy("page", "system").agg(F.sort_array(F.collect_list(F.when(F.col("valid"), F.col("measure")))).alias("bars"))
    held = F.sort_array(F.collect_list(F.when(F.size("bars") > 0, F.struct("system", "bars"))))
    pages = systems.groupBy("page").agg(held.alias("x"), F.sum(F.size("bars")).alias("n"))
    music = (F.col("n") > 0) & ~((F.size("x") < 3) & (F.col("n") < 3))
    written = lambda e: F.concat(e["system"].cast("string"), F.lit(":"), e["bars"][0].cast("string"), F.lit("-"), F.get(e["bars"], F.size(e["bars"]) - 1).cast("string"), F.lit("["), F.array_join(e["bars"].cast("array<string>"), ","), F.lit("]"))
    return pages.select(
        "page", F.when(music, "music").otherwise("front_matter").alias("kind"), F.when(music, F.size("x")).otherwise(0).alias("system_count"),
        F.when(music, F.array_min(F.transform("x", lambda e: e["bars"][0]))).alias("first_measure"), F.when(music, F.array_max(F.transform("x", lambda e: F.get(e["bars"], F.size(e["bars"]) - 1)))).alias("last_measure"),
        F.when(music, F.array_join(F.transform("x", written), " ")).alias("layout"),
    )

"""Queries on bars, tempo, onsets and their findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scorelake.operators import joins, ordered
from scorelake.plans.registry import query
from scorelake.sources.bindings import onsets, perf_notes, score_notes, seconds, table, with_


def measure_starts(notes: DataFrame) -> DataFrame:
    return notes.where(F.col("measure").isNotNull()).groupBy("session_id", "measure").agg(F.min("t").alias("start"))


_STARTS = "b AS (SELECT session_id, measure, min(t) AS start FROM p GROUP BY ALL)"


@query("agg01_measure_starts", f"{with_('p')}, {_STARTS} SELECT session_id, measure, start FROM b")
def agg01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure_starts(perf_notes(spark, sf_dir))


@query("agg02_unique_pairs", f"{with_('p')} SELECT session_id, floor(t / 3600 * 1000 + 0.5)::BIGINT AS score_milli, median(t) AS perf_time FROM p GROUP BY ALL")
def agg02(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.floor(F.col("t") / 3600 * 1000 + 0.5).alias("score_milli")
    return perf_notes(spark, sf_dir).groupBy("session_id", key).agg(F.median("t").alias("perf_time"))


_TEMPO = """n AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY t, state_idx) * 0.5::DOUBLE AS score_time FROM p),
w AS (SELECT session_id, state_idx, measure, t, count(*) OVER x AS n, last(score_time) OVER x - first(score_time) OVER x AS ds, last(t) OVER x - first(t) OVER x AS dp
  FROM n WINDOW x AS (PARTITION BY session_id ORDER BY t, state_idx ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)),
tempo AS (SELECT session_id, state_idx, measure, t, CASE WHEN n >= 3 AND ds > 1e-9 AND dp > 1e-9 THEN ds / dp * 120.0::DOUBLE END AS tempo FROM w)"""


def tempo_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = perf_notes(spark, sf_dir)
    scored = notes.withColumn("score_time", F.row_number().over(W.partitionBy("session_id").orderBy("t", "state_idx")) * F.lit(0.5))
    return ordered.local_tempo(scored, "session_id", "t", "score_time", "t")


@query("win01_local_tempo", f"{with_('p')}, {_TEMPO} SELECT session_id, state_idx, tempo FROM tempo")
def win01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tempo_rows(spark, sf_dir).select("session_id", "state_idx", "tempo")


@query(
    "win02_ioi_stats",
    f"""{with_('p')}, g AS (SELECT session_id, t - lag(t) OVER (PARTITION BY session_id ORDER BY t, state_idx) AS gap FROM p),
    i AS (SELECT session_id, gap FROM g WHERE gap > 0)
    SELECT session_id, count(*) AS n, round(avg(gap), 4) AS mean, median(gap) AS median, round(stddev_pop(gap), 4) AS stdev, round(stddev_pop(gap) / avg(gap), 6) AS cv, 60 / median(gap) AS tempo FROM i GROUP BY session_id""",
)
def win02(spark: SparkSession, sf_dir: str) -> DataFrame:
    gaps = ordered.inter_onset(perf_notes(spark, sf_dir), "session_id", ["t", "state_idx"], "t").where("ioi is not null")
    return gaps.groupBy("session_id").agg(
        F.count("*").alias("n"), F.round(F.avg("ioi"), 4).alias("mean"), F.median("ioi").alias("median"), F.round(F.stddev_pop("ioi"), 4).alias("stdev"),
        F.round(F.stddev_pop("ioi") / F.avg("ioi"), 6).alias("cv"), (60 / F.median("ioi")).alias("tempo"),
    )


_BARS = f"""{_STARTS}, g AS (SELECT *, lead(start) OVER (PARTITION BY session_id ORDER BY start) - start AS gap FROM b),
m AS (SELECT session_id, median(gap) FILTER (WHERE gap > 0) AS med FROM g GROUP BY session_id),
bars AS (SELECT g.session_id, measure, start, coalesce(gap, med, 0.0) AS duration FROM g JOIN m USING (session_id))"""


def bar_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.bar_durations(measure_starts(perf_notes(spark, sf_dir)), "session_id", "start")


@query("win03_bar_durations", f"{with_('p')}, {_BARS} SELECT session_id, measure, start, duration FROM bars")
def win03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bar_rows(spark, sf_dir)


_PER_BAR = f"""{_TEMPO}, {_BARS},
tb AS (SELECT session_id, measure, count(tempo) AS n_tempo, median(tempo) AS median_tempo, min(tempo) AS min_tempo, max(tempo) AS max_tempo FROM tempo GROUP BY ALL),
ob AS (SELECT session_id, (floor(time / 86400.0) + 1)::BIGINT AS measure, count(*) AS n_onsets, median(loudness_db) AS median_db, max(abs(loudness_db)) AS max_abs_db FROM o GROUP BY ALL),
k AS (SELECT session_id, measure FROM bars UNION SELECT session_id, measure FROM tb UNION SELECT session_id, measure FROM ob),
per_bar AS (SELECT k.session_id, k.measure, start, duration, coalesce(n_tempo, 0) AS n_tempo, median_tempo, min_tempo, max_tempo,
  100 * (max_tempo - min_tempo) / nullif(median_tempo, 0) AS range_pct, coalesce(n_onsets, 0) AS n_onsets, median_db, max_abs_db
  FROM k LEFT JOIN bars USING (session_id, measure) LEFT JOIN tb USING (session_id, measure) LEFT JOIN ob USING (session_id, measure))"""


def per_bar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for every bar that any of the three sources names."""
    keys = ["session_id", "measure"]
    tempo = tempo_rows(spark, sf_dir).groupBy(*keys).agg(F.count("tempo").alias("n_tempo"), F.median("tempo").alias("median_tempo"), F.min("tempo").alias("min_tempo"), F.max("tempo").alias("max_tempo"))
    heard = onsets(spark, sf_dir).withColumn("measure", (F.floor(F.col("time") / 86_400.0) + 1).cast("bigint"))
    heard = heard.groupBy(*keys).agg(F.count("*").alias("n_onsets"), F.median("loudness_db").alias("median_db"), F.max(F.abs("loudness_db")).alias("max_abs_db"))
    bars = bar_rows(spark, sf_dir)
    every = bars.select(*keys).union(tempo.select(*keys)).union(heard.select(*keys)).distinct()
    out = every.join(bars, keys, "left").join(tempo, keys, "left").join(heard, keys, "left")
    spread = 100 * (F.col("max_tempo") - F.col("min_tempo")) / F.nullif(F.col("median_tempo"), F.lit(0.0))
    return out.withColumn("range_pct", spread).fillna(0, ["n_tempo", "n_onsets"]).select(*keys, "start", "duration", "n_tempo", "median_tempo", "min_tempo", "max_tempo", "range_pct", "n_onsets", "median_db", "max_abs_db")


@query("agg03_per_bar_summary", f"{with_('p', 'o')}, {_PER_BAR} SELECT * FROM per_bar")
def agg03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return per_bar(spark, sf_dir)


@query(
    "agg04_rhythm_summary",
    f"""{with_('p', 'o')}, {_PER_BAR}, r AS (SELECT session_id, avg(matched::INT) AS rate FROM p GROUP BY session_id)
    SELECT session_id, count(*) AS n_bars, median(median_tempo) AS tempo, median(duration) AS bar_duration, 100 * (max(duration) - min(duration)) / nullif(median(duration), 0) AS duration_range_pct, max(rate) AS match_rate
    FROM per_bar JOIN r USING (session_id) GROUP BY session_id""",
)
def agg04(spark: SparkSession, sf_dir: str) -> DataFrame:
    rate = perf_notes(spark, sf_dir).groupBy("session_id").agg(F.avg(F.col("matched").cast("int")).alias("match_rate"))
    bars = per_bar(spark, sf_dir).groupBy("session_id").agg(
        F.count("*").alias("n_bars"), F.median("median_tempo").alias("tempo"), F.median("duration").alias("bar_duration"),
        (100 * (F.max("duration") - F.min("duration")) / F.nullif(F.median("duration"), F.lit(0.0))).alias("duration_range_pct"),
    )
    return bars.join(rate, "session_id")


_RUBATO = f"""{_BARS}, med AS (SELECT session_id, median(duration) AS bar FROM bars GROUP BY session_id),
rub AS (SELECT session_id, measure, start, 100 * (duration - bar) / nullif(bar, 0) AS pct FROM bars JOIN med USING (session_id)),
rubato AS (SELECT *, CASE WHEN abs(pct) >= 50 THEN 'alert' WHEN abs(pct) >= 30 THEN 'warn' ELSE 'info' END AS severity FROM rub WHERE abs(pct) >= 15)"""


def rubato(bars: DataFrame) -> DataFrame:
    """Bars whose duration is off the session's median by 15, 30, 50 percent or more."""
    middle = F.median("duration").over(W.partitionBy("session_id"))
    pct = 100 * (F.col("duration") - F.col("_m")) / F.nullif(F.col("_m"), F.lit(0.0))
    off = bars.withColumn("_m", middle).withColumn("pct", pct).where(F.abs("pct") >= 15)
    level = F.when(F.abs("pct") >= 50, "alert").when(F.abs("pct") >= 30, "warn").otherwise("info")
    return off.select("session_id", "measure", "start", "pct", level.alias("severity"))


@query("rul04_rubato_findings", f"{with_('p')}, {_RUBATO} SELECT * FROM rubato")
def rul04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rubato(bar_rows(spark, sf_dir))


@query(
    "agg15_severity_counts",
    f"""{with_('p')}, {_RUBATO} SELECT session_id, count(*) FILTER (WHERE severity = 'info') AS info, count(*) FILTER (WHERE severity = 'warn') AS warn, count(*) FILTER (WHERE severity = 'alert') AS alert FROM rubato GROUP BY session_id""",
)
def agg15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rubato(bar_rows(spark, sf_dir)).groupBy("session_id").pivot("severity", ["info", "warn", "alert"]).count().fillna(0)


@query(
    "win25_finding_ids",
    f"""{with_('p')}, {_RUBATO} SELECT session_id, 'c' || lpad(row_number() OVER (PARTITION BY session_id ORDER BY start, measure)::VARCHAR, 3, '0') AS id, greatest(start, 0) AS start_sec, greatest(start, 0) + 3 AS end_sec, 'rhythm' AS category, severity FROM rubato""",
)
def rul01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RUL-01: findings with ids in order of time."""
    n = F.row_number().over(W.partitionBy("session_id").orderBy("start", "measure"))
    start = F.greatest("start", F.lit(0.0))
    return rubato(bar_rows(spark, sf_dir)).select("session_id", F.concat(F.lit("c"), F.lpad(n.cast("string"), 3, "0")).alias("id"), start.alias("start_sec"), (start + 3).alias("end_sec"), F.lit("rhythm").alias("category"), "severity")


_OFF = """e AS (SELECT session_id, state_idx, measure, t, abs(t - round(t / 3600) * 3600) * CASE WHEN t >= round(t / 3600) * 3600 THEN 1 ELSE -1 END AS dev FROM p WHERE matched),
mb AS (SELECT session_id, measure, median(dev) AS med, count(*) AS n FROM e GROUP BY ALL),
off AS (SELECT session_id, state_idx, measure, t, dev - med AS off FROM e JOIN mb USING (session_id, measure) WHERE n >= 2 AND abs(dev - med) >= 600)"""


def off_pulse(spark: SparkSession, sf_dir: str, least: float) -> DataFrame:
    """Notes whose distance from the hourly pulse differs from their bar's median by ``least`` seconds or more."""
    notes = perf_notes(spark, sf_dir).where("matched").withColumn("dev", F.col("t") - F.round(F.col("t") / 3600) * 3600)
    bar = W.partitionBy("session_id", "measure")
    rows = notes.withColumn("_m", F.median("dev").over(bar)).withColumn("_n", F.count("*").over(bar)).withColumn("off", F.col("dev") - F.col("_m"))
    return rows.where((F.col("_n") >= 2) & (F.abs("off") >= least)).select("session_id", "state_idx", "measure", "t", "off")


@query("win07_off_pulse_outliers", f"{with_('p')}, {_OFF} SELECT * FROM off")
def win07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return off_pulse(spark, sf_dir, 600.0)


@query("rul05_off_pulse_top2", f"{with_('p')}, {_OFF} SELECT * FROM off QUALIFY row_number() OVER (PARTITION BY session_id, measure ORDER BY abs(off) DESC, state_idx) <= 2")
def rul05(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("session_id", "measure").orderBy(F.abs("off").desc(), "state_idx"))
    return off_pulse(spark, sf_dir, 600.0).withColumn("_r", rank).where("_r <= 2").drop("_r")


@query(
    "win05_music_start",
    f"""{with_('p', 'o')}, c AS (SELECT *, count(*) FILTER (WHERE loudness_db > -30) OVER (PARTITION BY session_id ORDER BY time, state_idx ROWS BETWEEN CURRENT ROW AND 6 FOLLOWING) AS loud FROM o)
    SELECT session_id, min(time) AS music_start FROM c WHERE loudness_db > -30 AND loud >= 3 GROUP BY session_id""",
)
def win05(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.partitionBy("session_id").orderBy("time", "state_idx").rowsBetween(0, 6)
    rows = onsets(spark, sf_dir).withColumn("loud", F.count_if(F.col("loudness_db") > -30).over(w))
    return rows.where("loudness_db > -30 AND loud >= 3").groupBy("session_id").agg(F.min("time").alias("music_start"))


@query(
    "win06_music_start_choice",
    f"""{with_('p', 'o')}, {_STARTS}, f AS (SELECT session_id, min(start) AS first_bar FROM b GROUP BY session_id), x AS (SELECT session_id, min(time) AS onset FROM o GROUP BY session_id)
    SELECT session_id, CASE WHEN abs(onset - first_bar) <= 43200 THEN onset ELSE first_bar END AS music_start, CASE WHEN abs(onset - first_bar) <= 43200 THEN 'onset' ELSE 'bar' END AS source FROM f LEFT JOIN x USING (session_id)""",
)
def win06(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = perf_notes(spark, sf_dir)
    one = notes.groupBy("session_id").agg(F.min("t").alias("first_bar"), F.min(F.when(F.col("kind") == "click", F.col("t"))).alias("onset"))
    near = F.abs(F.col("onset") - F.col("first_bar")) <= 43_200
    return one.select("session_id", F.when(near, F.col("onset")).otherwise(F.col("first_bar")).alias("music_start"), F.when(near, "onset").otherwise("bar").alias("source"))


@query(
    "win10_next_event",
    f"{with_('p')} SELECT session_id, state_idx, coalesce(lead(t) OVER (PARTITION BY session_id ORDER BY t, state_idx), t + 0.6) AS next_time FROM p",
)
def win10(spark: SparkSession, sf_dir: str) -> DataFrame:
    following = F.lead("t").over(W.partitionBy("session_id").orderBy("t", "state_idx"))
    return perf_notes(spark, sf_dir).select("session_id", "state_idx", F.coalesce(following, F.col("t") + 0.6).alias("next_time"))


@query(
    "win11_harmony_residue",
    f"""{with_('p')}, c AS (SELECT session_id, measure, list_sort(list_distinct(list(pitch))) AS pitches FROM p GROUP BY ALL),
    l AS (SELECT *, lag(pitches) OVER (PARTITION BY session_id ORDER BY measure) AS before FROM c)
    SELECT session_id, measure, array_to_string(list_sort(list_filter(before, lambda x: NOT list_contains(pitches, x))), ',') AS residue FROM l WHERE before IS NOT NULL""",
)
def win11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also SET-03 and SET-05: the sorted distinct pitches of a bar, less those of the next."""
    chords = perf_notes(spark, sf_dir).groupBy("session_id", "measure").agg(F.sort_array(F.collect_set("pitch")).alias("pitches"))
    before = F.lag("pitches").over(W.partitionBy("session_id").orderBy("measure"))
    return chords.withColumn("before", before).where("before is not null").select("session_id", "measure", F.array_join(F.array_except("before", "pitches"), ",").alias("residue"))


@query(
    "win08_beat_grid",
    f"""{with_('p')}, k AS (SELECT session_id, floor(min(t) / 43200)::BIGINT + 1 AS lo, floor(max(t) / 43200)::BIGINT AS hi FROM p GROUP BY session_id),
    grid AS (SELECT session_id, unnest(generate_series(lo, hi)) * 43200.0::DOUBLE AS ideal FROM k),
    q AS (SELECT session_id, t, row_number() OVER (PARTITION BY session_id ORDER BY t, state_idx) AS r FROM p),
    x AS (SELECT g.session_id, ideal, max(q.t) FILTER (WHERE q.t <= ideal) AS t0, max(q.r) FILTER (WHERE q.t <= ideal) AS r0, min(q.t) FILTER (WHERE q.t > ideal) AS t1 FROM grid g JOIN q USING (session_id) GROUP BY ALL)
    SELECT session_id, ideal, CASE WHEN t1 IS NULL THEN r0::DOUBLE ELSE r0 + (ideal - t0) / (t1 - t0) END AS note_position FROM x""",
)
def win08(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also SIG-17: a regular grid, interpolated linearly between the notes around each of its points."""
    notes = perf_notes(spark, sf_dir).withColumn("r", F.row_number().over(W.partitionBy("session_id").orderBy("t", "state_idx")))
    ends = notes.groupBy("session_id").agg((F.floor(F.min("t") / 43_200) + 1).alias("lo"), F.floor(F.max("t") / 43_200).alias("hi"))
    grid = ordered.dense_spine(ends, ["session_id"], "lo", "hi", "k").select("session_id", (F.col("k") * F.lit(43_200.0)).alias("ideal"))
    marked = notes.withColumn("t1", F.lead("t").over(W.partitionBy("session_id").orderBy("t", "state_idx"))).withColumn("t0", F.col("t"))
    at = joins.as_of(grid, marked, ["session_id"], "ideal", "t", ["r", "t0", "t1"])
    position = F.when(F.col("t1").isNull(), F.col("r").cast("double")).otherwise(F.col("r") + (F.col("ideal") - F.col("t0")) / (F.col("t1") - F.col("t0")))
    return at.select("session_id", "ideal", position.alias("note_position"))


@query(
    "win09_islands",
    f"""{with_('p')}, m AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY t, state_idx) - row_number() OVER (PARTITION BY session_id, matched ORDER BY t, state_idx) AS g FROM p)
    SELECT session_id, min(t) AS start, max(t) AS "end", count(*) AS n, median(440.0 * pow(2, (pitch - 69) / 12.0)) AS hz,
      CASE WHEN avg(amplitude) >= 60 THEN 'high' WHEN avg(amplitude) >= 40 THEN 'medium' ELSE 'low' END AS confidence FROM m WHERE matched GROUP BY session_id, g HAVING max(t) - min(t) >= 0.08""",
)
def win09(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also FLT-19: runs of matched notes of 0.08 s at least."""
    runs = ordered.islands(perf_notes(spark, sf_dir), ["session_id"], ["t", "state_idx"], F.col("matched"))
    hz = F.lit(440.0) * F.pow(F.lit(2.0), (F.col("pitch") - 69) / F.lit(12.0))
    level = F.when(F.avg("amplitude") >= 60, "high").when(F.avg("amplitude") >= 40, "medium").otherwise("low")
    rows = runs.groupBy("session_id", "island").agg(F.min("t").alias("start"), F.max("t").alias("end"), F.count("*").alias("n"), F.median(hz).alias("hz"), level.alias("confidence"))
    return rows.where(F.col("end") - F.col("start") >= 0.08).drop("island")


@query(
    "win22_run_grouping",
    f"""{with_('p')}, s AS (SELECT session_id, t, CASE WHEN t - lag(t) OVER (PARTITION BY session_id ORDER BY t) > 7200 THEN 1 ELSE 0 END AS s FROM p),
    g AS (SELECT session_id, t, sum(s) OVER (PARTITION BY session_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS island FROM s)
    SELECT session_id, island::BIGINT AS island, min(t) AS start, max(t) AS "end", count(*) AS n FROM g GROUP BY ALL""",
)
def win22(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = ordered.gap_islands(perf_notes(spark, sf_dir), ["session_id"], "t", 7_200.0)
    return runs.groupBy("session_id", "island").agg(F.min("t").alias("start"), F.max("t").alias("end"), F.count("*").alias("n"))


@query(
    "win14_measure_cursor",
    f"""{with_('s')}, m AS (SELECT piece_id, measure, sum(duration) AS len FROM s GROUP BY ALL)
    SELECT piece_id, measure, coalesce(sum(len) OVER (PARTITION BY piece_id ORDER BY measure ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM m""",
)
def win14(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = score_notes(spark, sf_dir).groupBy("piece_id", "measure").agg(F.sum("duration").alias("len"))
    before = F.sum("len").over(W.partitionBy("piece_id").orderBy("measure").rowsBetween(W.unboundedPreceding, -1))
    return lengths.select("piece_id", "measure", F.coalesce(before, F.lit(0.0)).alias("start"))


@query(
    "win15_bar_fractions",
    f"""{with_('p')} SELECT session_id, state_idx, measure, (row_number() OVER (PARTITION BY session_id, measure ORDER BY t, state_idx) - 1) / count(*) OVER (PARTITION BY session_id, measure)::DOUBLE AS x_fraction,
      1 + 4 * (t - min(t) OVER (PARTITION BY session_id, measure)) / 86400.0 AS beat FROM p""",
)
def win15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also WIN-16: where a note stands in its bar, by rank and by time."""
    bar = W.partitionBy("session_id", "measure")
    fraction = (F.row_number().over(bar.orderBy("t", "state_idx")) - 1) / F.count("*").over(bar).cast("double")
    return perf_notes(spark, sf_dir).select("session_id", "state_idx", "measure", fraction.alias("x_fraction"), (1 + 4 * (F.col("t") - F.min("t").over(bar)) / 86_400.0).alias("beat"))


@query(
    "win17_chord_grouping",
    f"""{with_('p')} SELECT session_id, floor(t / 3600 + 0.5)::BIGINT AS at, count(*) AS n, array_to_string(list_sort(list(pitch)), '+') AS pitches FROM p GROUP BY ALL""",
)
def win17(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.floor(F.col("t") / 3600 + 0.5).alias("at")
    return perf_notes(spark, sf_dir).groupBy("session_id", at).agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("pitch")), "+").alias("pitches"))


@query(
    "win12_movements",
    """WITH o AS (SELECT o_custkey AS piece, o_orderkey AS n, o_orderdate AS d, o_orderpriority AS meter, lag(o_orderpriority) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before FROM orders),
    m AS (SELECT *, sum(CASE WHEN before IS NULL OR before <> meter THEN 1 ELSE 0 END) OVER (PARTITION BY piece ORDER BY d, n ROWS UNBOUNDED PRECEDING)::BIGINT AS movement FROM o)
    SELECT piece, n, movement, row_number() OVER (PARTITION BY piece, movement ORDER BY d, n)::BIGINT AS bar FROM m""",
)
def win12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also WIN-13: a new movement wherever the meter changes, bars numbered anew in each."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("piece"), F.col("o_orderkey").alias("n"), F.col("o_orderdate").alias("d"), F.col("o_orderpriority").alias("meter"))
    before = F.lag("meter").over(W.partitionBy("piece").orderBy("d", "n"))
    rows = ordered.running_starts(rows.withColumn("_b", before), ["piece"], ["d", "n"], F.col("_b").isNull() | (F.col("_b") != F.col("meter")), "movement")
    return rows.select("piece", "n", "movement", F.row_number().over(W.partitionBy("piece", "movement").orderBy("d", "n")).cast("bigint").alias("bar"))


@query(
    "win19_cumulative_floor",
    """WITH c AS (SELECT s_nationkey AS system, count(*) AS w FROM supplier GROUP BY 1), n AS (SELECT n_regionkey AS page, n_nationkey AS system, coalesce(w, 0) AS w FROM nation LEFT JOIN c ON system = n_nationkey),
    e AS (SELECT page, system, floor(100 * sum(w) OVER (PARTITION BY page ORDER BY system) / nullif(sum(w) OVER (PARTITION BY page), 0)::DOUBLE + 1e-9)::BIGINT AS e FROM n)
    SELECT page, system, e - coalesce(lag(e) OVER (PARTITION BY page ORDER BY system), 0) AS bars FROM e""",
)
def win19(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also WIN-20: 100 bars of a page, dealt to its systems by weight."""
    weights = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("system")).agg(F.count("*").alias("w"))
    systems = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("page"), F.col("n_nationkey").alias("system")).join(weights, "system", "left").fillna(0, ["w"])
    total = F.nullif(F.sum("w").over(W.partitionBy("page")), F.lit(0))
    upto = F.sum("w").over(W.partitionBy("page").orderBy("system").rowsBetween(W.unboundedPreceding, W.currentRow))
    ends = systems.withColumn("_e", F.floor(F.lit(100) * upto / total.cast("double") + 1e-9))
    return ends.select("page", "system", (F.col("_e") - F.coalesce(F.lag("_e").over(W.partitionBy("page").orderBy("system")), F.lit(0))).alias("bars"))


@query(
    "win21_redistribute",
    """WITH x AS (SELECT n_regionkey AS page, n_nationkey AS system, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS r, count(*) OVER (PARTITION BY n_regionkey) AS k FROM nation),
    b AS (SELECT page, system, 37 // k + CASE WHEN r > k - 37 % k THEN 1 ELSE 0 END AS bars, r FROM x)
    SELECT page, system, bars::BIGINT AS bars, (sum(bars) OVER (PARTITION BY page ORDER BY r) - bars + 1)::BIGINT AS first_measure, (sum(bars) OVER (PARTITION BY page ORDER BY r))::BIGINT AS last_measure FROM b""",
)
def win21(spark: SparkSession, sf_dir: str) -> DataFrame:
    """37 bars evenly over a page's systems, the remainder to the last ones, then renumbered."""
    page = W.partitionBy("page")
    rows = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("page"), F.col("n_nationkey").alias("system"))
    rows = rows.withColumn("r", F.row_number().over(page.orderBy("system"))).withColumn("k", F.count("*").over(page))
    bars = F.floor(F.lit(37) / F.col("k")) + F.when(F.col("r") > F.col("k") - F.lit(37) % F.col("k"), 1).otherwise(0)
    upto = F.sum("bars").over(page.orderBy("r").rowsBetween(W.unboundedPreceding, W.currentRow))
    return rows.withColumn("bars", bars.cast("bigint")).select("page", "system", "bars", (upto - F.col("bars") + 1).alias("first_measure"), upto.alias("last_measure"))


@query(
    "win18_bar_expansion",
    """WITH c AS (SELECT s_nationkey AS system, least(count(*), 40) AS n FROM supplier GROUP BY 1), b AS (SELECT system, n, unnest(generate_series(1, n)) AS bar FROM c)
    SELECT system, bar::BIGINT AS bar, 0.05 + 0.9 * (bar - 1) / n AS x0, 0.05 + 0.9 * bar / n AS x1 FROM b""",
)
def win18(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A system's bars at equal widths between its margins."""
    counts = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("system")).agg(F.least(F.count("*"), F.lit(40)).alias("n"))
    bars = counts.select("system", "n", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"))).alias("bar"))
    return bars.select("system", "bar", (F.lit(0.05) + F.lit(0.9) * (F.col("bar") - 1) / F.col("n")).alias("x0"), (F.lit(0.05) + F.lit(0.9) * F.col("bar") / F.col("n")).alias("x1"))


@query("str01_tumbling", f"{with_('p')} SELECT floor(t / 3600)::BIGINT AS hour, count(*) AS n FROM p WHERE kind = 'click' GROUP BY 1")
def str01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streaming job of the same name gives the same counts (streaming/jobs.py)."""
    return table(spark, sf_dir, "events").where("event_type = 'click'").groupBy(F.floor(seconds() / 3600).alias("hour")).agg(F.count("*").alias("n"))

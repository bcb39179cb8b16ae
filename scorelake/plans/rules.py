"""Rules with arguments: timelines of played measures, tempo of a bar or window, frames of a window, chords of a window,
bars dealt to systems."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scorelake.functions.apportion import dealt_bars
from scorelake.operators import chords, greedy, reconcile, slices
from scorelake.operators.cluster import scratch_path
from scorelake.plans.registry import query
from scorelake.sources.bindings import frames, perf_notes, table, with_

# --- timeline of the played measures ---

#: Fixed value: from so many times a measure's score notes on, its matched notes are flagged.
EXTRA = 1.6


def hundredths(t: Column) -> Column:
    """The nearest hundredth, halves up; by arithmetic, so that every engine gives the same."""
    return F.floor(t * 100 + 0.5) / 100


def performance_timeline(matched: DataFrame, score: DataFrame, ranges: DataFrame) -> DataFrame:
    """session_id, measure, starts, ends, matched, score_notes, flags: a row for every measure of a session's played range.

    matched: session_id, measure, t of matched notes; score: session_id, measure, wildcard; ranges: session_id, first,
    last. A measure that holds a placeholder for unreadable notes is a gap; one without a match says so if it is no gap;
    one with far more matches than score notes says how many times as many, to a tenth."""
    keys = ["session_id", "measure"]
    spine = ranges.where("first <= last").select("session_id", F.explode(F.sequence("first", "last")).alias("measure"))
    played = matched.groupBy(*keys).agg(F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.count("*").alias("matched"))
    written = score.groupBy(*keys).agg(F.count("*").alias("score_notes"), F.bool_or("wildcard").alias("gap"))
    rows = spine.join(played, keys, "left").join(written, keys, "left").fillna(0, ["matched", "score_notes"]).fillna(False, ["gap"])
    n, s = F.col("matched"), F.col("score_notes")
    tenths = F.floor((20 * n + s) / F.nullif(2 * s, F.lit(0)))
    many = F.concat(F.lit("high extra-detection density ("), F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit("x score)"))
    flags = F.array_compact(F.array(
        F.when(F.col("gap"), "OMR-gap (pitches unknown)"), F.when((n == 0) & ~F.col("gap"), "no matches in this measure"),
        F.when((n > 0) & (s > 0) & (n / F.nullif(s, F.lit(0)) >= EXTRA), many),
    ))
    return rows.select(*keys, hundredths(F.col("first_t")).alias("starts"), hundredths(F.col("last_t")).alias("ends"), "matched", "score_notes", F.array_join(flags, "; ").alias("flags"))


@query(
    "rul08_performance_timeline",
    f"""{with_('p')}, r AS (SELECT session_id, min(measure) AS first, max(measure) AS last FROM p GROUP BY 1), x AS (SELECT session_id, unnest(range(first, last + 1)) AS measure FROM r),
    k AS (SELECT session_id, measure, min(t) AS a, max(t) AS b, count(*) AS matched FROM p WHERE matched AND state_idx % 9 > 0 GROUP BY ALL),
    s AS (SELECT session_id, measure, count(*) AS score_notes, bool_or(pitch % 12 = 11) AS gap FROM p WHERE pitch % 2 = 1 GROUP BY ALL),
    j AS (SELECT session_id, measure, a, b, coalesce(matched, 0) AS n, coalesce(score_notes, 0) AS s, coalesce(gap, false) AS gap FROM x LEFT JOIN k USING (session_id, measure) LEFT JOIN s USING (session_id, measure)),
    t AS (SELECT *, (20 * n + s) // nullif(2 * s, 0) AS tenths FROM j)
    SELECT session_id, measure, floor(a * 100 + 0.5::DOUBLE) / 100 AS starts, floor(b * 100 + 0.5::DOUBLE) / 100 AS ends, n AS matched, s AS score_notes, concat_ws('; ', CASE WHEN gap THEN 'OMR-gap (pitches unknown)' END, CASE WHEN n = 0 AND NOT gap THEN 'no matches in this measure' END,
      CASE WHEN n > 0 AND s > 0 AND n / s::DOUBLE >= 1.6 THEN 'high extra-detection density (' || (tenths // 10) || '.' || (tenths % 10) || 'x score)' END) AS flags FROM t""",
)
def rul08_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every played day as a measure: its score notes are those of odd pitch, a pitch class of 11 stands for a placeholder,
    every ninth note has no match."""
    notes = perf_notes(spark, sf_dir)
    ranges = notes.groupBy("session_id").agg(F.min("measure").alias("first"), F.max("measure").alias("last"))
    score = notes.where("pitch % 2 = 1").select("session_id", "measure", (F.pmod("pitch", F.lit(12)) == 11).alias("wildcard"))
    return performance_timeline(notes.where("matched AND state_idx % 9 > 0"), score, ranges)


# --- tempo of a bar or of a window of bars ---


def bar_durations(notes: DataFrame) -> DataFrame:
    """session_id, measure, duration, median: the time from a bar's first note to the next bar's, and the session's median."""
    bars = notes.groupBy("session_id", "measure").agg(F.min("t").alias("start"))
    bars = bars.withColumn("duration", F.lead("start").over(W.partitionBy("session_id").orderBy("measure")) - F.col("start"))
    whole = bars.groupBy("session_id").agg(F.median("duration").alias("median"))
    return bars.drop("start").join(whole, "session_id")


def _against_median() -> list[Column]:
    pct = 100 * (F.col("duration") - F.col("median")) / F.nullif(F.col("median"), F.lit(0.0))
    return [F.round("duration", 3).alias("duration_sec"), F.round("median", 3).alias("median_bar_duration_sec"), F.round(pct, 1).alias("pct_vs_median")]


def tempo_of_bar(bars: DataFrame, asked: DataFrame) -> DataFrame:
    """session_id, measure, duration_sec, median_bar_duration_sec, pct_vs_median, error, available_measures of the bar that
    is asked of each session. asked: session_id, measure. A bar that was not played gives an error and the bars there are."""
    there = bars.groupBy("session_id").agg(F.sort_array(F.collect_set("measure")).alias("available"), F.first("median").alias("median"))
    found = asked.join(there, "session_id").join(bars.select("session_id", "measure", "duration", F.lit(True).alias("_played")), ["session_id", "measure"], "left")
    missing = F.col("_played").isNull()
    error = F.when(missing, F.concat(F.lit("no per-bar tempo data for measure "), F.col("measure").cast("string")))
    return found.select("session_id", "measure", *_against_median(), error.alias("error"), F.when(missing, F.array_join(F.col("available").cast("array<string>"), ",")).alias("available_measures"))


def tempo_of_window(bars: DataFrame, first: int, last: int) -> DataFrame:
    """The bars of a window, each against its session's median."""
    return bars.where(F.col("measure").between(first, last)).select("session_id", "measure", *_against_median())


_BARS = f"""{with_('p')}, b AS (SELECT session_id, measure, min(t) AS start FROM p GROUP BY ALL), g AS (SELECT session_id, measure, lead(start) OVER (PARTITION BY session_id ORDER BY measure) - start AS duration FROM b),
  m AS (SELECT session_id, median(duration) AS med, array_to_string(list(measure ORDER BY measure), ',') AS available FROM g GROUP BY 1)"""


@query(
    "rul12_tempo_of_bar",
    f"""{_BARS} SELECT m.session_id, (m.session_id % 31 + 1)::BIGINT AS measure, round(duration, 3) AS duration_sec, round(med, 3) AS median_bar_duration_sec, round(100 * (duration - med) / nullif(med, 0), 1) AS pct_vs_median,
      CASE WHEN g.measure IS NULL THEN 'no per-bar tempo data for measure ' || (m.session_id % 31 + 1)::VARCHAR END AS error, CASE WHEN g.measure IS NULL THEN available END AS available_measures
    FROM m LEFT JOIN g ON g.session_id = m.session_id AND g.measure = m.session_id % 31 + 1""",
)
def rul12_bar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bar asked of each session; some have not played it."""
    bars = bar_durations(perf_notes(spark, sf_dir))
    return tempo_of_bar(bars, bars.select("session_id", (F.pmod("session_id", F.lit(31)) + 1).alias("measure")).distinct())


@query("rul12_tempo_of_window", f"{_BARS} SELECT session_id, measure, round(duration, 3) AS duration_sec, round(med, 3) AS median_bar_duration_sec, round(100 * (duration - med) / nullif(med, 0), 1) AS pct_vs_median FROM g JOIN m USING (session_id) WHERE measure BETWEEN 3 AND 9")
def rul12_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tempo_of_window(bar_durations(perf_notes(spark, sf_dir)), 3, 9)


# --- frames and chords of a window ---


def frames_in(listed: DataFrame, start: float, end: float, interval: float = 2.0) -> DataFrame:
    """session_id, vec_id, at, outside: the frames of a window, or else the one nearest to its middle. listed: session_id,
    vec_id; a session's frames lie ``interval`` seconds apart, the first one interval after its start."""
    session = W.partitionBy("session_id")
    rows = listed.withColumn("at", F.row_number().over(session.orderBy("vec_id")) * F.lit(float(interval))).withColumn("_in", F.col("at").between(start, end))
    rows = rows.withColumn("_n", F.count_if("_in").over(session)).withColumn("_r", F.row_number().over(session.orderBy(F.abs(F.col("at") - (start + end) / 2), "at")))
    return rows.where("_n > 0 AND _in OR _n = 0 AND _r = 1").select("session_id", "vec_id", "at", (~F.col("_in")).alias("outside"))


@query(
    "src22_frames_in_window",
    """WITH f AS (SELECT label::BIGINT AS session_id, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) * 2.0::DOUBLE AS sec FROM embeddings), i AS (SELECT *, sec BETWEEN 100.5 AND 101.5 AS inside FROM f),
    r AS (SELECT *, count(*) FILTER (WHERE inside) OVER (PARTITION BY session_id) AS n, row_number() OVER (PARTITION BY session_id ORDER BY abs(sec - 101), sec) AS r FROM i)
    SELECT session_id, vec_id, sec AS at, NOT inside AS outside FROM r WHERE (n > 0 AND inside) OR (n = 0 AND r = 1)""",
)
def src22_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A window between two frames: the nearest one of each session, marked as outside."""
    listed = table(spark, sf_dir, "embeddings").select(F.col("label").cast("bigint").alias("session_id"), "vec_id")
    return frames_in(listed, 100.5, 101.5)


def chord_profiles(spectra: DataFrame, start: int, end: int) -> DataFrame:
    """frame_idx (the window's first), mag: the mean magnitude of every bin over the frames start..end-1 of each session, as
    one spectrum. spectra: session_id, frame_idx, mag."""
    bins = spectra.where(F.col("frame_idx").between(start, end - 1)).select("session_id", F.posexplode("mag").alias("bin", "m"))
    mean = bins.groupBy("session_id", "bin").agg(F.avg("m").alias("m"))
    return mean.groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("bin", "m")))["m"].alias("mag")).select(F.col("session_id").cast("bigint").alias("frame_idx"), "mag")


def chord_peaks(spectra: DataFrame, start: int, end: int, floor_db: float = -30.0, distance: int = 2, most: int = 8) -> DataFrame:
    """frame_idx (here: the session), bin, db of the strongest peaks of a window's mean spectrum."""
    return greedy.spectral_peaks(chord_profiles(spectra, start, end), floor_db, distance, most)


@query("sig12_chord_of_window")
def sig12_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chord of a window in each session's spectra."""
    return chord_peaks(frames(spark, sf_dir), 0, 400)


# --- bars dealt to systems ---


@query(
    "win19_dealt_bars",
    """WITH x AS (SELECT l_orderkey AS page, list(CASE WHEN l_orderkey % 5 = 0 THEN 100 + l_quantity / 50 WHEN l_orderkey % 7 = 0 THEN -l_quantity ELSE l_quantity - 8 END ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS w, l_orderkey % 23 AS total FROM lineitem GROUP BY l_orderkey),
    y AS (SELECT *, len(w)::BIGINT AS n, list_transform(w, lambda a: greatest(0.0, a)) AS c FROM x), z AS (SELECT *, CASE WHEN list_sum(c) > 0 THEN w ELSE list_transform(w, lambda a: 1.0::DOUBLE) END AS raw, CASE WHEN list_sum(c) > 0 THEN c ELSE list_transform(w, lambda a: 1.0::DOUBLE) END AS used FROM y),
    v AS (SELECT *, list_reduce(used, lambda a, b: a + b) AS whole, list_reduce(used, lambda a, b: a + b) / n AS mean, total // n AS base, total % n AS rest FROM z),
    e AS (SELECT *, list_transform(used, lambda a, i: CASE WHEN i = n THEN total ELSE floor(total * list_reduce(used[1:i], lambda a, b: a + b) / whole)::BIGINT END) AS ends FROM v),
    q AS (SELECT *, list_transform(ends, lambda a, i: a - CASE WHEN i = 1 THEN 0 ELSE ends[i - 1] END) AS passed FROM e),
    r AS (SELECT *, list_reduce(list_concat([passed], list_transform(range(1, n + 1), lambda i: [i])), lambda a, b: CASE WHEN a[b[1]] > 0 OR list_max(a) <= 1 THEN a
      ELSE list_transform(a, lambda c, j: c + CASE WHEN j = b[1] THEN 1 ELSE 0 END - CASE WHEN j = list_position(a, list_max(a)) THEN 1 ELSE 0 END) END) AS mended FROM q)
    SELECT page, total, array_to_string(CASE WHEN list_max(list_transform(raw, lambda a: abs(a - mean))) <= mean * 0.08
      THEN list_transform(used, lambda a, i: base + CASE WHEN i = n AND rest > 0 THEN 1 WHEN i > 1 AND i < n AND i - 1 < rest THEN 1 ELSE 0 END) WHEN total >= n THEN mended ELSE passed END, ',') AS bars FROM r""",
)
def win19_dealt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's lines as systems whose weights are alike, mixed or all without room."""
    k = F.col("l_orderkey")
    weight = F.when(k % 5 == 0, F.lit(100) + F.col("l_quantity") / 50).when(k % 7 == 0, -F.col("l_quantity")).otherwise(F.col("l_quantity") - 8)
    listed = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", weight.alias("w"))))["w"]
    rows = table(spark, sf_dir, "lineitem").groupBy(k.alias("page")).agg(listed.alias("w")).withColumn("total", F.col("page") % 23)
    return rows.select("page", "total", F.array_join(dealt_bars(F.col("total"), F.col("w")).cast("array<string>"), ",").alias("bars"))


# --- slices under a digest ---


@query(
    "sig13_slice_cache",
    """WITH r AS (SELECT n_nationkey::BIGINT AS request, (n_nationkey % 10)::INTEGER AS session_id, n_nationkey * 13 - 30 AS start, n_nationkey * 13 - 30 + (n_nationkey * 37) % 190 AS "end", n_nationkey % 5 * 20 AS bins FROM nation
      UNION ALL SELECT 100 + n_nationkey, (n_nationkey % 10)::INTEGER, n_nationkey * 13 - 30, n_nationkey * 13 - 30 + (n_nationkey * 37) % 190, n_nationkey % 5 * 20 FROM nation WHERE n_nationkey % 2 = 0),
    e AS (SELECT *, CASE WHEN start < 0 THEN 'start is below 0' WHEN "end" <= start THEN 'end is not after start' WHEN bins < 1 THEN 'no bins' END AS error FROM r),
    f AS (SELECT request, count(DISTINCT frame_idx)::BIGINT AS n_frames, avg(abs(x))::DOUBLE AS level FROM e JOIN (SELECT label, vec_id AS frame_idx, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS bin FROM embeddings) v
      ON label = session_id AND frame_idx >= start AND frame_idx < "end" AND bin <= bins WHERE error IS NULL GROUP BY request)
    SELECT e.request, error, CASE WHEN error IS NULL THEN coalesce(n_frames, 0) END AS n_frames, round(level, 6) AS level FROM e LEFT JOIN f USING (request)""",
)
def sig13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slices asked for twice, some again under another number: the second call reads what the first has computed."""
    n = F.col("n_nationkey")
    start = n * 13 - 30
    ask = table(spark, sf_dir, "nation").select(n.cast("bigint").alias("request"), (n % 10).alias("session_id"), start.alias("start"), (start + n * 37 % 190).alias("end"), (n % 5 * 20).alias("bins"))
    ask = ask.unionByName(ask.where("request % 2 = 0").withColumn("request", F.col("request") + 100))
    path, spectra = scratch_path(spark, "slices"), frames(spark, sf_dir)
    slices.cached_slices(ask, spectra, path)
    found, new = slices.cached_slices(ask, spectra, path)
    if new:
        raise AssertionError(f"{new} slices were computed twice")
    level = F.aggregate("mag", F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size("mag"), F.lit(0))
    return found.select("request", "error", F.when(F.col("error").isNull(), F.col("n_frames")).alias("n_frames"), F.round(level, 6).alias("level"))


# --- chords in spectra ---

_CHORDS = chords.ChordConfig(frame_sec=0.1, low_pitch=36, per_octave=12, reach=1)


def _measured_chords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten takes: the notes of the users whose number ends alike, a tenth of a day as a chord and a second to a day, in the
    spectra of that label."""
    take = F.pmod(F.col("session_id"), F.lit(10)).cast("int")
    rows = perf_notes(spark, sf_dir).groupBy(take.alias("session_id"), F.floor(F.col("t") / 8_640).alias("event")).agg(F.min("measure").alias("measure"), F.collect_set("pitch").alias("pitches"))
    rows = rows.select("session_id", "event", (F.col("event") / 10).alias("t"), "measure", "pitches")
    order = W.partitionBy("session_id").orderBy("frame_idx")
    spectra = frames(spark, sf_dir).withColumn("frame_idx", (F.row_number().over(order) - 1).cast("bigint"))
    return chords.measured(rows, spectra, _CHORDS)


@query("sig06_chord_measures")
def sig06_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chords measured in spectra: levels, presence and attacks of members, margins, spreads, residue."""
    found = _measured_chords(spark, sf_dir)
    told = F.transform("members", lambda m: F.concat(m["pitch"].cast("string"), F.lit(":"), m["role"], F.lit(":"), m["onset_db"].cast("string")))
    return found.select("session_id", "event", "measure", "margin_db", "bass_db", "spread_ms", "residue_db", "blur", F.array_join(told, " ").alias("members"))


@query("rul06_voicing_findings")
def rul06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weak melodies, spread attacks and residue, the worst twelve of each in a session."""
    return chords.findings(_measured_chords(spark, sf_dir), _CHORDS)


# --- layouts against MIDI ---


@query(
    "rul13_reconciled",
    """WITH s AS (SELECT o_custkey AS piece, CASE WHEN o_custkey % 3 > 0 THEN 'recognised' ELSE 'model' END AS source, o_orderkey % 3 AS movement, sum(l_quantity::BIGINT % 9)::BIGINT AS bars FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL),
    m AS (SELECT c_custkey AS piece, CASE WHEN c_custkey % 7 > 0 THEN c_custkey % 90 END AS total, c_custkey % 5 AS hint FROM customer),
    r AS (SELECT s.piece, movement, row_number() OVER (PARTITION BY s.piece ORDER BY CASE WHEN movement = hint THEN 0 ELSE 1 END, abs(bars - total), movement) AS r FROM s JOIN m USING (piece) WHERE source = 'recognised' AND total IS NOT NULL),
    p AS (SELECT s.piece, source, total, r.movement AS played, sum(bars)::BIGINT AS layout, (sum(bars) FILTER (WHERE s.movement = r.movement))::BIGINT AS own FROM s JOIN m USING (piece) LEFT JOIN r ON r.piece = s.piece AND r.r = 1 GROUP BY ALL),
    f AS (SELECT *, coalesce(total > 0, false) AND CASE WHEN source = 'recognised' THEN played IS NOT NULL ELSE abs(layout - total) > 1 END AS fit FROM p),
    n AS (SELECT piece, source, total AS midi_bars, played, fit AS redistributed, CASE WHEN NOT fit THEN layout WHEN source = 'recognised' THEN layout - own + total ELSE total END AS layout_bars, CASE WHEN played IS NOT NULL THEN CASE WHEN fit THEN total ELSE own END END AS played_bars FROM f)
    SELECT *, CASE WHEN abs(coalesce(played_bars, layout_bars) - midi_bars) > 1 THEN source || '=' || coalesce(played_bars, layout_bars) || ' midi=' || midi_bars END AS mismatch FROM n""",
)
def rul13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders as pages, their lines as systems, of two sources; bars of files that are unknown, none or given."""
    return reconcile.summary(reconcile.reconciled(*_layouts(spark, sf_dir)))


def _layouts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    lines = table(spark, sf_dir, "lineitem").withColumn("system", F.row_number().over(order)).join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    source = F.when(F.col("o_custkey") % 3 > 0, reconcile.RECOGNISED).otherwise("model")
    systems = lines.select(F.col("o_custkey").alias("piece"), source.alias("source"), F.col("o_orderkey").alias("page"), "system", (F.col("o_orderkey") % 3).alias("movement"), (F.col("l_tax") * 14).alias("width"), (F.col("l_quantity").cast("bigint") % 9).alias("bars"))
    key = F.col("c_custkey")
    return systems, table(spark, sf_dir, "customer").select(key.alias("piece"), F.when(key % 7 > 0, key % 90).alias("total"), (key % 5).alias("hint"))

"""Queries on joins, filters, ranges, manifests and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scorelake.operators import joins, ordered
from scorelake.plans.registry import query
from scorelake.sources.bindings import onsets, perf_notes, score_notes, table, with_

_CLICKS = "c AS (SELECT session_id, t AS start FROM p WHERE kind = 'click'), v AS (SELECT session_id, state_idx, t FROM p WHERE kind = 'purchase')"


@query(
    "jon04_asof_measure",
    f"""{with_('p')}, {_CLICKS}, f AS (SELECT session_id, min(start) AS first FROM c GROUP BY 1)
    SELECT v.session_id, v.state_idx, coalesce(c.start, f.first) AS start FROM v ASOF LEFT JOIN c ON v.session_id = c.session_id AND v.t + 1e-9 >= c.start LEFT JOIN f ON f.session_id = v.session_id""",
)
def jon04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last bar that began by then; before the first bar, the first."""
    notes = perf_notes(spark, sf_dir)
    bars = notes.where("kind = 'click'").select("session_id", F.col("t").alias("start"))
    left = notes.where("kind = 'purchase'").select("session_id", "state_idx", "t")
    return joins.as_of(left, bars, ["session_id"], "t", "start", ["start"], 1e-9, "first").select("session_id", "state_idx", "start")


@query(
    "jon05_asof_explicit",
    f"""{with_('p')}, {_CLICKS}, x AS (SELECT v.session_id, v.state_idx, c.start FROM v ASOF LEFT JOIN c ON v.session_id = c.session_id AND v.t + 1e-6 >= c.start)
    SELECT session_id, state_idx, CASE WHEN state_idx % 3 = 0 THEN 0.0::DOUBLE ELSE start END AS start FROM x""",
)
def jon05(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An explicit bar (here of every third note) wins; before the first bar there is none."""
    notes = perf_notes(spark, sf_dir)
    bars = notes.where("kind = 'click'").select("session_id", F.col("t").alias("start"))
    left = notes.where("kind = 'purchase'").select("session_id", "state_idx", "t", F.when(F.col("state_idx") % 3 == 0, F.lit(0.0)).alias("given"))
    return joins.as_of(left, bars, ["session_id"], "t", "start", ["start"], 1e-6).select("session_id", "state_idx", F.coalesce("given", "start").alias("start"))


@query(
    "jon06_nearest_onset",
    f"""{with_('p')}, v AS (SELECT session_id, state_idx, t FROM p WHERE kind = 'view'), c AS (SELECT session_id, t AS time FROM p WHERE kind = 'click'),
    b AS (SELECT v.*, c.time AS back FROM v ASOF LEFT JOIN c ON v.session_id = c.session_id AND v.t >= c.time),
    a AS (SELECT b.*, c.time AS ahead FROM b ASOF LEFT JOIN c ON b.session_id = c.session_id AND b.t <= c.time),
    n AS (SELECT session_id, state_idx, t, CASE WHEN back IS NULL THEN ahead WHEN ahead IS NULL THEN back WHEN ahead - t < t - back THEN ahead ELSE back END AS near FROM a)
    SELECT session_id, state_idx, near, abs(near - t) <= 3600 AS within FROM n""",
)
def jon06(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = perf_notes(spark, sf_dir)
    marks = notes.where("kind = 'click'").select("session_id", F.col("t").alias("time"))
    near = joins.nearest(notes.where("kind = 'view'").select("session_id", "state_idx", "t"), marks, ["session_id"], "t", "time", "near")
    return near.select("session_id", "state_idx", "near", (F.abs(F.col("near") - F.col("t")) <= 3600).alias("within"))


@query(
    "jon07_nearest_note_score",
    f"""{with_('p')}, b AS (SELECT session_id, measure, (measure - 1) * 86400.0::DOUBLE AS start FROM p GROUP BY ALL),
    x AS (SELECT b.session_id, b.measure, p.state_idx, row_number() OVER (PARTITION BY b.session_id, b.measure ORDER BY abs(p.t - b.start), p.state_idx) AS r FROM b JOIN p ON p.session_id = b.session_id AND p.measure BETWEEN b.measure - 1 AND b.measure)
    SELECT session_id, measure, state_idx FROM x WHERE r = 1""",
)
def jon07(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The note nearest to each bar line, among the notes of the bars it divides."""
    notes = perf_notes(spark, sf_dir)
    bars = notes.select("session_id", "measure").distinct()
    sides = notes.select("session_id", "state_idx", "t", F.explode(F.array(F.col("measure"), F.col("measure") + 1)).alias("measure"))
    rows = bars.join(sides, ["session_id", "measure"]).withColumn("gap", F.abs(F.col("t") - (F.col("measure") - 1) * F.lit(86_400.0)))
    return rows.groupBy("session_id", "measure").agg(F.min(F.struct("gap", "state_idx")).alias("m")).select("session_id", "measure", "m.state_idx")


@query(
    "jon08_range_lookahead",
    f"""{with_('p')} SELECT a.session_id, a.state_idx, b.state_idx AS other, b.t - a.t AS gap FROM p a JOIN p b ON a.session_id = b.session_id AND b.t BETWEEN a.t AND a.t + 3600 WHERE a.kind = 'purchase' AND b.kind = 'view'""",
)
def jon08(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = perf_notes(spark, sf_dir)
    left = notes.where("kind = 'purchase'").select("session_id", "state_idx", F.col("t").alias("lo"), (F.col("t") + 3600).alias("hi"))
    right = notes.where("kind = 'view'").select("session_id", F.col("state_idx").alias("other"), F.col("t").alias("at"))
    return joins.range_join(left, right, ["session_id"], "lo", "hi", "at", 3600.0).select("session_id", "state_idx", "other", (F.col("at") - F.col("lo")).alias("gap"))


@query(
    "jon09_interval_overlap",
    """WITH c AS (SELECT s_nationkey AS system, count(*) AS n FROM supplier GROUP BY 1), l AS (SELECT system, (sum(n) OVER (ORDER BY system) - n + 1)::BIGINT AS first, (sum(n) OVER (ORDER BY system))::BIGINT AS last FROM c)
    SELECT system, greatest(first, 20) AS first, least(last, 60) AS last FROM l WHERE last >= 20 AND first <= 60""",
)
def jon09(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layout systems that overlap bars 20 to 60, cut to them. There are as many systems as nations."""
    counts = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("system")).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(W.orderBy("system").rowsBetween(W.unboundedPreceding, W.currentRow))
    layout = counts.select("system", (upto - F.col("n") + 1).alias("first"), upto.alias("last"))
    lo, hi = F.lit(20), F.lit(60)
    return layout.where(joins.overlaps(F.col("first"), F.col("last"), lo, hi)).select("system", F.greatest("first", lo).cast("bigint").alias("first"), F.least("last", hi).cast("bigint").alias("last"))


@query(
    "jon10_score_map_join",
    f"""{with_('p', 's')}, e AS (SELECT piece_id, measure, count(*) AS n FROM s GROUP BY ALL),
    a AS (SELECT session_id AS piece_id, measure, max_by(t, state_idx) AS perf_time FROM p GROUP BY ALL)
    SELECT piece_id, measure, n, perf_time FROM e LEFT JOIN a USING (piece_id, measure)""",
)
def jon10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score events with the last performed time of their key, null where there is none."""
    events = score_notes(spark, sf_dir).withColumn("measure", F.col("measure").cast("bigint")).groupBy("piece_id", "measure").agg(F.count("*").alias("n"))
    times = perf_notes(spark, sf_dir).groupBy(F.col("session_id").alias("piece_id"), "measure").agg(F.max_by("t", "state_idx").alias("perf_time"))
    return events.join(times, ["piece_id", "measure"], "left")


@query(
    "jon11_comment_times",
    f"""{with_('p')}, m AS (SELECT session_id, measure, min(t) AS start FROM p GROUP BY ALL), c AS (SELECT conv_id, turn, conv_id % 150 AS session_id, 1 + turn % 30 AS measure FROM conversations)
    SELECT conv_id, turn, a.start, coalesce(b.start, a.start + 2) AS "end" FROM c LEFT JOIN m a USING (session_id, measure) LEFT JOIN m b ON b.session_id = c.session_id AND b.measure = c.measure + 1""",
)
def jon11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A comment's start is its bar's, its end the next bar's or two seconds on."""
    starts = perf_notes(spark, sf_dir).groupBy("session_id", "measure").agg(F.min("t").alias("start"))
    notes = table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.col("conv_id") % 150).alias("session_id"), (F.col("turn") % 30 + 1).alias("measure"))
    following = starts.select("session_id", (F.col("measure") - 1).alias("measure"), F.col("start").alias("next"))
    keys = ["session_id", "measure"]
    return notes.join(starts, keys, "left").join(following, keys, "left").select("conv_id", "turn", "start", F.coalesce("next", F.col("start") + 2).alias("end"))


@query(
    "jon12_comment_reanchor",
    f"""{with_('p')}, m AS (SELECT session_id, measure, min(t) AS start FROM p GROUP BY ALL), g AS (SELECT *, lead(start) OVER (PARTITION BY session_id ORDER BY measure) - start AS gap FROM m)
    SELECT p.session_id, p.state_idx, g.start + least(greatest((1 + p.pitch % 4 - 1) / 4.0, 0), 0.95) * coalesce(g.gap, 3) AS start, greatest(p.amplitude / 10, 1) AS duration FROM p JOIN g USING (session_id, measure)""",
)
def jon12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A beat's place between its bar line and the next one; at least a second long."""
    notes = perf_notes(spark, sf_dir)
    starts = notes.groupBy("session_id", "measure").agg(F.min("t").alias("start"))
    starts = starts.withColumn("gap", F.lead("start").over(W.partitionBy("session_id").orderBy("measure")) - F.col("start"))
    beat = F.least(F.greatest((F.col("pitch") % 4) / F.lit(4.0), F.lit(0.0)), F.lit(0.95))
    rows = notes.join(starts, ["session_id", "measure"])
    return rows.select("session_id", "state_idx", (F.col("start") + beat * F.coalesce("gap", F.lit(3.0))).alias("start"), F.greatest(F.col("amplitude") / 10, F.lit(1.0)).alias("duration"))


@query(
    "jon13_layout_lookup",
    """WITH c AS (SELECT s_nationkey AS system, count(*) AS n FROM supplier GROUP BY 1), l AS (SELECT system, (sum(n) OVER (ORDER BY system) - n + 1)::BIGINT AS first, (sum(n) OVER (ORDER BY system))::BIGINT AS last FROM c),
    x AS (SELECT unnest(generate_series(first, last)) AS measure, system FROM l)
    SELECT l_orderkey, l_linenumber, max(system)::INTEGER AS system FROM lineitem LEFT JOIN x ON measure = l_linenumber GROUP BY ALL""",
)
def jon13(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("system")).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(W.orderBy("system").rowsBetween(W.unboundedPreceding, W.currentRow))
    places = ordered.dense_spine(counts.select("system", (upto - F.col("n") + 1).alias("first"), upto.alias("last")), ["system"], "first", "last", "measure")
    places = places.groupBy("measure").agg(F.max("system").alias("system"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    return lines.join(places, lines["l_linenumber"] == places["measure"], "left").select("l_orderkey", "l_linenumber", "system")


@query(
    "jon14_prior_lessons",
    """SELECT a.o_orderkey AS lesson, b.o_orderkey AS prior, row_number() OVER (PARTITION BY a.o_orderkey ORDER BY b.o_orderdate, b.o_orderkey) AS n
    FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND (b.o_orderdate < a.o_orderdate)""",
)
def jon14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The earlier orders of an order's customer, in order of time."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("lesson"), F.col("o_orderdate").alias("d"))
    prior = rows.select("o_custkey", F.col("lesson").alias("prior"), F.col("d").alias("before"))
    pairs = rows.join(prior, "o_custkey").where("before < d")
    return pairs.select("lesson", "prior", F.row_number().over(W.partitionBy("lesson").orderBy("before", "prior")).alias("n"))


@query(
    "jon15_listing_join",
    """SELECT c_custkey AS series, o_orderkey AS lesson, row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderkey) AS place FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_orderstatus <> 'P'""",
)
def jon15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A series' listed lessons in their order; ids that name no lesson are skipped."""
    listed = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("series")).agg(F.sort_array(F.collect_list("o_orderkey")).alias("lessons"))
    ids = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("series")).join(listed, "series").select("series", F.posexplode("lessons").alias("at", "lesson"))
    there = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("lesson"))
    rows = ids.join(there, "lesson")
    return rows.select("series", "lesson", F.row_number().over(W.partitionBy("series").orderBy("at")).alias("place"))


@query(
    "jon16_bar_evidence",
    f"""{with_('p', 'o')}, n AS (SELECT session_id, measure, count(*) AS notes, array_to_string(list(pitch ORDER BY t, state_idx), ' ') AS outline FROM p GROUP BY ALL),
    h AS (SELECT session_id, (floor(time / 86400.0) + 1)::BIGINT AS measure, count(*) AS onsets, max(loudness_db) AS loudest FROM o GROUP BY ALL)
    SELECT session_id, measure, notes, outline, coalesce(onsets, 0) AS onsets, loudest FROM n LEFT JOIN h USING (session_id, measure) WHERE measure = 5""",
)
def jon16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything known of bar 5."""
    return bar_evidence(spark, sf_dir, 5)


def bar_evidence(spark: SparkSession, sf_dir: str, measure: int) -> DataFrame:
    """session_id, measure, notes, outline, onsets, loudest of one bar of each session."""
    bar = F.col("measure") == measure
    notes = perf_notes(spark, sf_dir).where(bar).groupBy("session_id", "measure")
    notes = notes.agg(F.count("*").alias("notes"), F.sort_array(F.collect_list(F.struct("t", "state_idx", "pitch"))).alias("x"))
    heard = onsets(spark, sf_dir).withColumn("measure", (F.floor(F.col("time") / 86_400.0) + 1).cast("bigint")).where(bar)
    heard = heard.groupBy("session_id", "measure").agg(F.count("*").alias("onsets"), F.max("loudness_db").alias("loudest"))
    outline = F.array_join(F.transform("x", lambda e: e["pitch"]), " ")
    return notes.join(heard, ["session_id", "measure"], "left").select("session_id", "measure", "notes", outline.alias("outline"), F.coalesce("onsets", F.lit(0)).alias("onsets"), "loudest")


@query(
    "jon17_note_evidence",
    f"""{with_('p')}, q AS (SELECT session_id, state_idx, measure, pitch, t FROM p WHERE kind = 'purchase'), c AS (SELECT session_id, state_idx AS hit, measure, pitch, t AS ht FROM p WHERE kind <> 'purchase')
    SELECT session_id, state_idx, hit FROM q JOIN c USING (session_id, measure, pitch) WHERE abs(t - ht) <= 20000 QUALIFY row_number() OVER (PARTITION BY session_id, state_idx ORDER BY ht, hit) = 1""",
)
def jon17(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first other note of the same bar and pitch within a tolerance."""
    return note_evidence(spark, sf_dir).select("session_id", "state_idx", "hit")


def note_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The notes asked about with their bar, pitch and hit."""
    notes = perf_notes(spark, sf_dir)
    asked = notes.where("kind = 'purchase'").select("session_id", "measure", "pitch", "state_idx", "t")
    others = notes.where("kind <> 'purchase'").select("session_id", "measure", "pitch", F.col("state_idx").alias("hit"), F.col("t").alias("ht"))
    near = asked.join(others, ["session_id", "measure", "pitch"]).where(F.abs(F.col("t") - F.col("ht")) <= 20_000)
    return joins.first_by(near, ["session_id", "state_idx"], [F.col("ht"), F.col("hit")]).select("session_id", "measure", "pitch", "state_idx", "hit")


@query(
    "jon18_candidate_notes",
    f"""{with_('p')}, c AS (SELECT session_id, state_idx AS comment, t - 7200 AS lo, t + 7200 AS hi FROM p WHERE kind = 'error'),
    x AS (SELECT c.session_id, comment, p.state_idx, p.t, row_number() OVER (PARTITION BY c.session_id, comment ORDER BY p.t, p.state_idx) AS r FROM c JOIN p ON p.session_id = c.session_id AND p.t BETWEEN lo AND hi)
    SELECT session_id, comment, count(*) AS n, array_to_string(list(state_idx ORDER BY r), ',') AS notes FROM x WHERE r <= 24 GROUP BY ALL""",
)
def jon18(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also FLT-07: the first 24 notes in each comment's padded window."""
    notes = perf_notes(spark, sf_dir)
    asked = notes.where("kind = 'error'").select("session_id", F.col("state_idx").alias("comment"), (F.col("t") - 7200).alias("lo"), (F.col("t") + 7200).alias("hi"))
    found = joins.range_join(asked, notes.select("session_id", "state_idx", "t"), ["session_id"], "lo", "hi", "t", 14_400.0)
    ranked = found.withColumn("r", F.row_number().over(W.partitionBy("session_id", "comment").orderBy("t", "state_idx"))).where("r <= 24")
    ordered_ids = F.transform(F.sort_array(F.collect_list(F.struct("r", "state_idx"))), lambda e: e["state_idx"])
    return ranked.groupBy("session_id", "comment").agg(F.count("*").alias("n"), F.array_join(ordered_ids, ",").alias("notes"))


@query(
    "jon20_movement_by_count",
    """WITH c AS (SELECT n_regionkey AS id, count(*) AS n FROM nation GROUP BY 1), x AS (SELECT p_partkey, p_size, id, abs(n - p_size) AS d FROM part, c)
    SELECT p_partkey, id AS movement FROM x QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY d, id) = 1""",
)
def jon20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also JON-19's priority choice: the movement whose bar count is nearest, the lower id on a tie. There are as many
    movements as regions, so they travel with each part as one array."""
    counts = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("id")).agg(F.count("*").alias("n")).agg(F.collect_list(F.struct("id", "n")).alias("all"))
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_size").join(F.broadcast(counts))
    best = F.array_min(F.transform("all", lambda m: F.struct(F.abs(m["n"] - F.col("p_size")).alias("d"), m["id"].alias("id"))))
    return parts.select("p_partkey", best["id"].alias("movement"))


@query(
    "jon21_worst_per_class",
    f"""{with_('p')} SELECT session_id, pitch % 12 AS pc, state_idx AS worst FROM p WHERE measure BETWEEN 2 AND 25 QUALIFY row_number() OVER (PARTITION BY session_id, pitch % 12 ORDER BY abs(amplitude - 50) DESC, state_idx) = 1""",
)
def jon21(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = perf_notes(spark, sf_dir).where(F.col("measure").between(2, 25)).withColumn("pc", F.pmod("pitch", F.lit(12)))
    worst = F.max(F.struct(F.abs(F.col("amplitude") - 50), (-F.col("state_idx")).alias("i")))
    return rows.groupBy("session_id", "pc").agg((-worst["i"]).alias("worst"))


@query(
    "jon22_positional_pairing",
    """WITH a AS (SELECT n_regionkey AS page, n_nationkey AS parsed, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS r, count(*) OVER (PARTITION BY n_regionkey) AS n FROM nation),
    b AS (SELECT n_regionkey AS page, s_suppkey AS detected, row_number() OVER (PARTITION BY n_regionkey ORDER BY s_suppkey) AS r, count(*) OVER (PARTITION BY n_regionkey) AS m FROM supplier JOIN nation ON s_nationkey = n_nationkey)
    SELECT page, parsed, detected FROM a JOIN b USING (page, r) WHERE m >= n""",
)
def jon22(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed and detected systems of a page in pairs by rank, for pages where enough were detected."""
    nations = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("page"), F.col("n_nationkey").alias("parsed"))
    page = W.partitionBy("page")
    parsed = nations.withColumn("r", F.row_number().over(page.orderBy("parsed"))).withColumn("n", F.count("*").over(page))
    found = table(spark, sf_dir, "supplier").join(nations.withColumnRenamed("parsed", "s_nationkey"), "s_nationkey").select("page", F.col("s_suppkey").alias("detected"))
    found = found.withColumn("r", F.row_number().over(page.orderBy("detected"))).withColumn("m", F.count("*").over(page))
    return parsed.join(found, ["page", "r"]).where("m >= n").select("page", "parsed", "detected")


@query("jon25_hash_lookup", "SELECT l_orderkey, l_linenumber, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey")
def jon25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plain equi-join; Spark broadcasts the smaller side while it is small."""
    lines, parts = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    return lines.join(parts, lines["l_partkey"] == parts["p_partkey"]).select("l_orderkey", "l_linenumber", "p_brand")


@query(
    "flt01_played_range",
    """SELECT o_custkey AS session_id, CASE WHEN u1 IS NOT NULL AND u2 >= u1 THEN u1 WHEN a1 IS NOT NULL AND a2 >= a1 THEN a1 ELSE coalesce(u1, e1, 1) END AS first,
      CASE WHEN u1 IS NOT NULL AND u2 >= u1 THEN u2 WHEN a1 IS NOT NULL AND a2 >= a1 THEN a2 ELSE greatest(coalesce(u2, e2, 1), coalesce(u1, e1, 1)) END AS last,
      CASE WHEN u1 IS NOT NULL AND u2 >= u1 THEN 'user_specified' WHEN a1 IS NOT NULL AND a2 >= a1 THEN 'auto_detected' ELSE 'score_extent' END AS source
    FROM (SELECT o_custkey, min(o_orderkey) FILTER (WHERE o_orderstatus = 'P') AS u1, max(o_orderkey) FILTER (WHERE o_orderstatus = 'P') AS u2, min(o_orderkey) FILTER (WHERE o_orderstatus = 'F') AS a1, max(o_orderkey) FILTER (WHERE o_orderstatus = 'F') AS a2, min(o_orderkey) AS e1, max(o_orderkey) AS e2 FROM orders GROUP BY 1)""",
)
def flt01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also FLT-02: the user's range, else a detected one, else the score's extent."""
    key = F.col("o_orderkey")
    of = lambda f, s: f(F.when(F.col("o_orderstatus") == s, key))
    rows = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("session_id")).agg(
        of(F.min, "P").alias("u1"), of(F.max, "P").alias("u2"), of(F.min, "F").alias("a1"), of(F.max, "F").alias("a2"), F.min(key).alias("e1"), F.max(key).alias("e2")
    )
    user, auto = F.col("u2") >= F.col("u1"), F.col("a2") >= F.col("a1")
    low = F.coalesce("u1", "e1", F.lit(1))
    return rows.select(
        "session_id",
        F.when(user, F.col("u1")).when(auto, F.col("a1")).otherwise(low).alias("first"),
        F.when(user, F.col("u2")).when(auto, F.col("a2")).otherwise(F.greatest(F.coalesce("u2", "e2", F.lit(1)), low)).alias("last"),
        F.when(user, "user_specified").when(auto, "auto_detected").otherwise("score_extent").alias("source"),
    )


@query("flt03_filter_measure", f"{with_('p')} SELECT session_id, state_idx, measure FROM p WHERE measure BETWEEN 2 AND 4")
def flt03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of bars 2 to 4; rows without a bar are dropped."""
    return perf_notes(spark, sf_dir).where(F.col("measure").try_cast("bigint").between(2, 4)).select("session_id", "state_idx", "measure")


_SPANS = "x AS (SELECT session_id, state_idx, CASE WHEN state_idx % 5 = 0 THEN NULL ELSE t END AS s, CASE WHEN state_idx % 7 = 0 THEN NULL ELSE t + 3600 END AS e FROM p)"


@query("flt04_time_window", f"{with_('p')}, {_SPANS} SELECT session_id, state_idx FROM x WHERE coalesce(e, s) >= 86400 AND coalesce(s, e) <= 259200")
def flt04(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = perf_notes(spark, sf_dir).select("session_id", "state_idx", F.when(F.col("state_idx") % 5 != 0, F.col("t")).alias("s"), F.when(F.col("state_idx") % 7 != 0, F.col("t") + 3600).alias("e"))
    return rows.where(joins.overlaps(F.col("s"), F.col("e"), F.lit(86_400.0), F.lit(259_200.0))).select("session_id", "state_idx")


@query("flt05_sandbox", f"{with_('p')}, x AS (SELECT session_id, CASE WHEN state_idx % 5 = 0 THEN NULL ELSE measure END AS m FROM p) SELECT session_id, count(*) FILTER (WHERE m IS NULL OR m BETWEEN 3 AND 20) AS kept, count(*) FILTER (WHERE NOT (m BETWEEN 3 AND 20)) AS dropped FROM x GROUP BY 1")
def flt05(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without a bar pass, rows of other bars are counted as dropped."""
    m = F.when(F.col("state_idx") % 5 != 0, F.col("measure"))
    inside = m.isNull() | m.between(3, 20)
    return perf_notes(spark, sf_dir).groupBy("session_id").agg(F.count_if(inside).alias("kept"), F.count_if(~inside).alias("dropped"))


@query(
    "flt06_scope_never_empty",
    f"{with_('s')}, c AS (SELECT *, count(*) FILTER (WHERE measure BETWEEN 4 AND 6) OVER (PARTITION BY piece_id) AS n FROM s) SELECT piece_id, measure, duration FROM c WHERE measure BETWEEN 4 AND 6 OR n = 0",
)
def flt06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars 4 to 6 of a piece, or all of it if it has none of them."""
    inside = F.col("measure").between(4, 6)
    rows = score_notes(spark, sf_dir).withColumn("n", F.count_if(inside).over(W.partitionBy("piece_id")))
    return rows.where(inside | (F.col("n") == 0)).select("piece_id", "measure", "duration")


@query(
    "flt08_voicing_query",
    f"""{with_('p')}, m AS (SELECT session_id, state_idx, t, count(*) OVER (PARTITION BY session_id) AS matched FROM p WHERE measure = 3 AND pitch >= 50)
    SELECT session_id, state_idx, matched FROM m QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY t, state_idx) <= 24""",
)
def flt08(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Composed filters, 24 rows at most, and how many matched."""
    session = W.partitionBy("session_id")
    rows = perf_notes(spark, sf_dir).where("measure = 3 AND pitch >= 50").withColumn("matched", F.count("*").over(session))
    return rows.withColumn("r", F.row_number().over(session.orderBy("t", "state_idx"))).where("r <= 24").select("session_id", "state_idx", "matched")


@query(
    "flt09_note_finder",
    f"{with_('p')} SELECT session_id, min_by(state_idx, (abs(1 + 4 * (t - (measure - 1) * 86400.0) / 86400.0 - 2.5), state_idx)) AS nearest FROM p WHERE measure = 4 AND pitch IN (60, 62, 64, 65, 67) GROUP BY session_id",
)
def flt09(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also FLT-10: of bar 4's notes of five pitches the one nearest to beat 2.5."""
    beat = 1 + 4 * (F.col("t") - (F.col("measure") - 1) * F.lit(86_400.0)) / 86_400.0
    rows = perf_notes(spark, sf_dir).where(F.col("measure") == 4).where(F.array_contains(F.array(*map(F.lit, (60, 62, 64, 65, 67))), F.col("pitch")))
    return rows.groupBy("session_id").agg(F.min(F.struct(F.abs(beat - 2.5), "state_idx"))["state_idx"].alias("nearest"))


@query(
    "flt11_wrong_notes",
    f"""{with_('p')}, q AS (SELECT session_id, state_idx, pitch, t, lag(pitch) OVER (PARTITION BY session_id ORDER BY t, state_idx) AS expected FROM p WHERE matched)
    SELECT session_id, state_idx, pitch, expected FROM q WHERE abs(pitch - expected) = 1 QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY t, state_idx) <= 30""",
)
def flt11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 30 notes of a session that are a semitone off what was expected."""
    session = W.partitionBy("session_id").orderBy("t", "state_idx")
    rows = perf_notes(spark, sf_dir).where("matched").withColumn("expected", F.lag("pitch").over(session)).where(F.abs(F.col("pitch") - F.col("expected")) == 1)
    return rows.withColumn("r", F.row_number().over(session)).where("r <= 30").select("session_id", "state_idx", "pitch", "expected")


@query(
    "flt13_onset_dense_dedupe",
    f"""{with_('p', 'o')} SELECT session_id, state_idx FROM o WHERE time BETWEEN 86400 AND 1728000 QUALIFY row_number() OVER (PARTITION BY session_id, floor(time / 43200) ORDER BY loudness_db DESC, state_idx) = 1""",
)
def flt13(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = onsets(spark, sf_dir).where(F.col("time").between(86_400, 1_728_000)).withColumn("half", F.floor(F.col("time") / 43_200))
    return joins.first_by(rows, ["session_id", "half"], [F.col("loudness_db").desc(), F.col("state_idx")]).select("session_id", "state_idx")


@query("flt15_profile_gate", "SELECT s_suppkey, s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_name NOT IN (SELECT n_name FROM nation WHERE n_regionkey = 1) AND s_acctbal >= 0")
def flt15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also FLT-16: an anti-join with a list of what is off, and a guard on the kind."""
    nations = table(spark, sf_dir, "nation")
    allowed = nations.join(nations.where("n_regionkey = 1").select("n_name"), "n_name", "left_anti")
    return table(spark, sf_dir, "supplier").where("s_acctbal >= 0").join(allowed, F.col("s_nationkey") == F.col("n_nationkey"), "left_semi").select("s_suppkey", "s_name")


@query(
    "flt20_page_selection",
    """WITH c AS (SELECT n_regionkey AS page, min(n_nationkey) AS first, max(n_nationkey) AS last, count(*) FILTER (WHERE n_nationkey % 2 = 0) AS meta FROM nation GROUP BY 1), g AS (SELECT *, sum(meta) OVER () AS any_meta FROM c)
    SELECT page FROM g WHERE any_meta = 0 OR (first <= 9 AND last >= 3) ORDER BY page LIMIT 8""",
)
def flt20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that overlap the wanted bars if any page says which it has, else all; eight at most."""
    pages = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("page")).agg(F.min("n_nationkey").alias("first"), F.max("n_nationkey").alias("last"), F.count_if(F.col("n_nationkey") % 2 == 0).alias("meta"))
    told = pages.agg(F.sum("meta").alias("any"))
    overlap = (F.col("first") <= 9) & (F.col("last") >= 3)
    return pages.join(F.broadcast(told)).where((F.col("any") == 0) | overlap).select("page").orderBy("page").limit(8)


@query(
    "src06_source_priority",
    """WITH x AS (SELECT c_custkey, o_orderkey, o_orderstatus, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS priority FROM customer JOIN orders ON c_custkey = o_custkey)
    SELECT c_custkey AS session_id, o_orderstatus AS source, count(*) AS n FROM x WHERE priority = (SELECT min(y.priority) FROM x y WHERE y.c_custkey = x.c_custkey) GROUP BY ALL""",
)
def src06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also SRC-05 and SRC-12: the rows of each session's best source, and which it was."""
    rank = F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 2).otherwise(3)
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("session_id"), F.col("o_orderstatus").alias("source"), rank.alias("rank"))
    counts = rows.groupBy("session_id", "rank", "source").agg(F.count("*").alias("n"))
    return joins.first_by(counts, ["session_id"], [F.col("rank")]).select("session_id", "source", "n")


@query(
    "src08_alias_decode",
    """SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.pitch') AS INTEGER), TRY_CAST(json_extract_string(props, '$.k') AS INTEGER)) AS pitch, len([json_extract_string(props, '$.k')]) AS n_pitches FROM events""",
)
def src08(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also SRC-07: a canonical name, else its older alias, read leniently; a scalar becomes a list of one."""
    pitch = lambda name: F.get_json_object("props", f"$.{name}").try_cast("int")
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(pitch("pitch"), pitch("k")).alias("pitch"), F.size(F.array(F.get_json_object("props", "$.k"))).alias("n_pitches"))


@query(
    "src10_wildcard_ghosts",
    f"""{with_('s')}, e AS (SELECT piece_id, max(measure) AS last FROM s GROUP BY 1), x AS (SELECT piece_id, unnest(generate_series(1, last)) AS measure FROM e), m AS (SELECT DISTINCT piece_id, measure FROM s WHERE pitch >= 60)
    SELECT piece_id, measure::INTEGER AS measure, k::INTEGER AS k, (measure - 1) * 4.0 + k AS at, -1 AS pitch FROM x ANTI JOIN m USING (piece_id, measure), (SELECT unnest(generate_series(0, 3)) AS k)""",
)
def src10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also AGG-19: four placeholder notes for every bar without a note (of pitch 60 or more)."""
    notes = score_notes(spark, sf_dir)
    bars = ordered.dense_spine(notes.groupBy("piece_id").agg(F.lit(1).alias("lo"), F.max("measure").alias("hi")), ["piece_id"], "lo", "hi", "measure")
    empty = bars.join(notes.where("pitch >= 60").select("piece_id", "measure"), ["piece_id", "measure"], "left_anti")
    ghosts = empty.select("piece_id", "measure", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k"))
    return ghosts.select("piece_id", "measure", "k", ((F.col("measure") - 1) * F.lit(4.0) + F.col("k")).alias("at"), F.lit(-1).alias("pitch"))


@query(
    "src16_page_ranges",
    """WITH d AS (SELECT DISTINCT o_custkey AS doc, CAST(o_orderdate AS DATE) - DATE '1990-01-01' AS page FROM orders), g AS (SELECT doc, page, page - row_number() OVER (PARTITION BY doc ORDER BY page) AS g FROM d),
    r AS (SELECT doc, g, min(page) AS a, max(page) AS b FROM g GROUP BY ALL)
    SELECT doc, array_to_string(list(CASE WHEN a = b THEN a::VARCHAR ELSE a::VARCHAR || '-' || b::VARCHAR END ORDER BY a), ',') AS ranges FROM r GROUP BY doc""",
)
def src16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of consecutive pages as "a-b"."""
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1990-01-01").cast("date"))
    pages = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), day.alias("page")).distinct()
    runs = pages.withColumn("g", F.col("page") - F.row_number().over(W.partitionBy("doc").orderBy("page"))).groupBy("doc", "g").agg(F.min("page").alias("a"), F.max("page").alias("b"))
    text = lambda e: F.when(e["a"] == e["b"], e["a"].cast("string")).otherwise(F.concat(e["a"].cast("string"), F.lit("-"), e["b"].cast("string")))
    return runs.groupBy("doc").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("a", "b"))), text), ",").alias("ranges"))


@query("src19_transcription_rows", f"{with_('p')} SELECT session_id, state_idx, t AS performed_time_sec, amplitude / 127 AS amplitude, CASE WHEN amplitude / 127 >= 0.5 THEN 'high' ELSE 'medium' END AS confidence FROM p")
def src19(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also SRC-20: note events as performed notes."""
    level = F.col("amplitude") / 127
    return perf_notes(spark, sf_dir).select("session_id", "state_idx", F.col("t").alias("performed_time_sec"), level.alias("amplitude"), F.when(level >= 0.5, "high").otherwise("medium").alias("confidence"))


@query("src21_routing", "SELECT p_partkey, CASE WHEN regexp_matches(lower(p_type), 'brass|steel') THEN 'piano' WHEN regexp_matches(lower(p_name), 'tin') THEN 'piano' ELSE 'general' END AS route FROM part")
def src21(spark: SparkSession, sf_dir: str) -> DataFrame:
    route = F.when(F.lower("p_type").rlike("brass|steel"), "piano").when(F.lower("p_name").rlike("tin"), "piano").otherwise("general")
    return table(spark, sf_dir, "part").select("p_partkey", route.alias("route"))


@query(
    "src22_frame_listing",
    """WITH f AS (SELECT label AS session_id, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) * 2.0::DOUBLE AS sec FROM embeddings), i AS (SELECT *, count(*) FILTER (WHERE sec BETWEEN 20 AND 24) OVER (PARTITION BY session_id) AS n FROM f),
    r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY abs(sec - 22), sec) AS r FROM i)
    SELECT session_id, vec_id, sec AS at FROM r WHERE (n > 0 AND sec BETWEEN 20 AND 24) OR (n = 0 AND r = 1)""",
)
def src22(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of a window, or else the one nearest to its middle."""
    frames = table(spark, sf_dir, "embeddings").select(F.col("label").alias("session_id"), "vec_id")
    session = W.partitionBy("session_id")
    rows = frames.withColumn("at", F.row_number().over(session.orderBy("vec_id")) * F.lit(2.0)).withColumn("in", F.col("at").between(20, 24))
    rows = rows.withColumn("n", F.count_if("in").over(session)).withColumn("r", F.row_number().over(session.orderBy(F.abs(F.col("at") - 22), "at")))
    return rows.where("(n > 0 AND in) OR (n = 0 AND r = 1)").select("session_id", "vec_id", "at")


@query("src23_manifest_listing", "SELECT o_custkey AS user_id, o_orderkey AS session_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS place FROM orders")
def src23(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also TOP-09: a user's sessions, the latest first."""
    place = F.row_number().over(W.partitionBy("o_custkey").orderBy(F.col("o_orderdate").desc(), "o_orderkey"))
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("session_id"), place.alias("place"))


@query(
    "snk06_cascade_counts",
    """WITH c AS (SELECT c_custkey FROM customer WHERE c_custkey % 10 = 0), o AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM c)), l AS (SELECT 1 FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM o))
    SELECT 'series' AS kind, count(*) AS n FROM c UNION ALL SELECT 'lessons', count(*) FROM o UNION ALL SELECT 'notes', count(*) FROM l""",
)
def snk06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also SNK-05: what deleting every tenth series takes with it."""
    series = table(spark, sf_dir, "customer").where("c_custkey % 10 = 0").select("c_custkey")
    lessons = table(spark, sf_dir, "orders").join(series, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey")
    notes = table(spark, sf_dir, "lineitem").join(lessons, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").select("l_orderkey")
    parts = [df.agg(F.lit(kind).alias("kind"), F.count("*").alias("n")) for kind, df in (("series", series), ("lessons", lessons), ("notes", notes))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("snk07_tombstones", "SELECT conv_id, turn FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'system')")
def snk07(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations with a tombstone (here: a system turn) are hidden."""
    rows = table(spark, sf_dir, "conversations")
    return rows.join(rows.where("role = 'system'").select("conv_id").distinct(), "conv_id", "left_anti").select("conv_id", "turn")


@query("snk09_latest_match", "SELECT conv_id, turn, CASE WHEN role = 'assistant' AND row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) = 1 THEN 'ready' ELSE 'old' END AS state FROM conversations")
def snk09(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest matching message of a conversation changes its state."""
    latest = F.row_number().over(W.partitionBy("conv_id", "role").orderBy(F.col("turn").desc())) == 1
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when((F.col("role") == "assistant") & latest, "ready").otherwise("old").alias("state"))


@query("snk10_content_hash", "SELECT doc_id, sha256(text) AS sha256, sha1(source || ':' || doc_id::VARCHAR) AS sha1 FROM documents")
def snk10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.sha1(F.concat("source", F.lit(":"), F.col("doc_id").cast("string")).cast("binary")).alias("sha1"))


@query("fn35_daily_quota", "SELECT event_id, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) <= 5 AS allowed, strftime(ts, '%Y%m%d') AS day FROM events")
def fn35(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also FN-34: five events per user and UTC day."""
    rank = F.row_number().over(W.partitionBy("user_id", F.col("ts").cast("date")).orderBy("ts", "event_id"))
    return table(spark, sf_dir, "events").select("event_id", (rank <= 5).alias("allowed"), F.date_format("ts", "yyyyMMdd").alias("day"))


@query("fn36_turn_cap", "SELECT conv_id, turn, count(*) FILTER (WHERE role = 'user') OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) <= 3 AS allowed, octet_length(encode(text)) <= 2048 AS fits FROM conversations")
def fn36(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also FN-26: three user turns at most, and 2,048 bytes a message."""
    upto = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, W.currentRow)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.count_if(F.col("role") == "user").over(upto) <= 3).alias("allowed"), (F.octet_length("text") <= 2048).alias("fits"))


@query("agg24_chat_listing", "SELECT conv_id, count(*) AS messages, max(turn) AS last_turn, max(turn) + 1 AS turns, count(*) FILTER (WHERE role = 'user') AS asked FROM conversations GROUP BY conv_id")
def agg24(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also AGG-28."""
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("messages"), F.max("turn").alias("last_turn"), (F.max("turn") + 1).alias("turns"), F.count_if(F.col("role") == "user").alias("asked"))


@query("set02_key_union", f"{with_('p', 'o')} SELECT session_id, measure FROM p WHERE matched UNION SELECT session_id, (floor(time / 86400.0) + 1)::BIGINT FROM o UNION SELECT user_id, 0 FROM events")
def set02(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct keys of three sources."""
    notes = perf_notes(spark, sf_dir)
    heard = onsets(spark, sf_dir).select("session_id", (F.floor(F.col("time") / 86_400.0) + 1).cast("bigint").alias("measure"))
    zero = notes.select("session_id", F.lit(0).cast("bigint").alias("measure"))
    return notes.where("matched").select("session_id", "measure").unionByName(heard).unionByName(zero).distinct()


@query("set04_membership", f"{with_('p')} SELECT session_id, state_idx FROM p WHERE pitch % 12 IN (0, 4, 7)")
def set04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perf_notes(spark, sf_dir).where(F.pmod("pitch", F.lit(12)).isin(0, 4, 7)).select("session_id", "state_idx")

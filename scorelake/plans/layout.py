"""Queries on score layout, chord events and reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scorelake.operators import joins
from scorelake.plans.registry import query
from scorelake.sources.bindings import perf_notes, score_notes, table, with_


@query(
    "src11_downbeat_measures",
    f"""{with_('s')}, c AS (SELECT piece_id, measure, min(pitch) AS p0, sum(duration) AS len FROM s GROUP BY ALL), d AS (SELECT piece_id, measure, sum(len) OVER (PARTITION BY piece_id ORDER BY measure) - len AS downbeat FROM c),
    n AS (SELECT piece_id, pitch, duration * 2 AS at FROM s)
    SELECT n.piece_id, n.pitch, n.at, d.measure FROM n ASOF LEFT JOIN d ON n.piece_id = d.piece_id AND n.at >= d.downbeat""",
)
def src11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bar of a note by its downbeat."""
    notes = score_notes(spark, sf_dir)
    bars = notes.groupBy("piece_id", "measure").agg(F.sum("duration").alias("len"))
    upto = F.sum("len").over(W.partitionBy("piece_id").orderBy("measure").rowsBetween(W.unboundedPreceding, W.currentRow))
    downbeats = bars.select("piece_id", "measure", (upto - F.col("len")).alias("downbeat"))
    return joins.as_of(notes.select("piece_id", "pitch", (F.col("duration") * 2).alias("at")), downbeats, ["piece_id"], "at", "downbeat", ["measure"])


@query(
    "src13_attribute_carry",
    """WITH x AS (SELECT o_custkey AS part, o_orderkey AS n, o_orderdate AS d, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS meter FROM orders)
    SELECT part, n, coalesce(last_value(meter IGNORE NULLS) OVER (PARTITION BY part ORDER BY d, n ROWS UNBOUNDED PRECEDING), '4/4') AS meter FROM x""",
)
def src13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An attribute holds until the next one; before the first, the default."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("part"), F.col("o_orderkey").alias("n"), F.col("o_orderdate").alias("d"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).alias("meter"))
    upto = W.partitionBy("part").orderBy("d", "n").rowsBetween(W.unboundedPreceding, W.currentRow)
    return rows.select("part", "n", F.coalesce(F.last("meter", ignorenulls=True).over(upto), F.lit("4/4")).alias("meter"))


@query(
    "src15_output_pick",
    """SELECT p_brand AS run, p_partkey AS path FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY CASE WHEN p_size % 2 = 0 THEN 0 ELSE 1 END, p_retailprice DESC, p_partkey) = 1""",
)
def src15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best output of a run: the preferred kind, then the largest, then the first path."""
    kind = F.when(F.col("p_size") % 2 == 0, 0).otherwise(1)
    best = F.min(F.struct(kind.alias("k"), (-F.col("p_retailprice")).alias("s"), F.col("p_partkey").alias("path")))
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("run")).agg(best["path"].alias("path"))


@query(
    "jon19_movement_choice",
    """WITH m AS (SELECT n_regionkey AS piece, n_nationkey AS id, lower(trim(n_name)) AS title, n_nationkey * 40 AS first, CASE WHEN n_nationkey % 6 > 0 THEN n_nationkey * 40 + 30 END AS last FROM nation),
    w AS (SELECT s_suppkey, n_regionkey AS piece, CASE s_suppkey % 4 WHEN 0 THEN lower(n_name) || ' allegro' WHEN 1 THEN lower(substr(n_name, 1, 3)) ELSE '' END AS wanted, s_suppkey % 50 AS hint, s_suppkey * 7 % 1000 AS lo FROM supplier JOIN nation ON s_nationkey = n_nationkey),
    x AS (SELECT s_suppkey, id, CASE WHEN wanted <> '' AND title <> '' AND (contains(title, wanted) OR contains(wanted, title)) THEN 0 WHEN id = hint THEN 1 WHEN first <= lo + 12 AND last >= lo THEN 2 ELSE 3 END AS rank FROM w JOIN m USING (piece))
    SELECT s_suppkey, id AS movement FROM x QUALIFY row_number() OVER (PARTITION BY s_suppkey ORDER BY rank, id) = 1""",
)
def jon19(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By title (one inside the other), else by the hinted id, else by overlap of the measures played, else the first
    movement of the piece. A piece has few movements, so the pairs of a take with them are few."""
    nations = table(spark, sf_dir, "nation")
    first = F.col("n_nationkey") * 40
    movements = nations.select(F.col("n_regionkey").alias("piece"), F.col("n_nationkey").alias("id"), F.lower(F.trim("n_name")).alias("title"), first.alias("first"), F.when(F.col("n_nationkey") % 6 > 0, first + 30).alias("last"))
    named = F.when(F.col("s_suppkey") % 4 == 0, F.concat(F.lower("n_name"), F.lit(" allegro"))).when(F.col("s_suppkey") % 4 == 1, F.lower(F.substring("n_name", 1, 3))).otherwise("")
    takes = table(spark, sf_dir, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
    wanted = takes.select("s_suppkey", F.col("n_regionkey").alias("piece"), named.alias("wanted"), (F.col("s_suppkey") % 50).alias("hint"), (F.col("s_suppkey") * 7 % 1000).alias("lo"))
    titled = (F.col("wanted") != "") & (F.col("title") != "") & (F.col("title").contains(F.col("wanted")) | F.col("wanted").contains(F.col("title")))
    played = (F.col("first") <= F.col("lo") + 12) & (F.col("last") >= F.col("lo"))
    rank = F.when(titled, 0).when(F.col("id") == F.col("hint"), 1).when(played, 2).otherwise(3)
    best = F.min(F.struct(rank.alias("rank"), "id"))
    return wanted.join(movements, "piece").groupBy("s_suppkey").agg(best["id"].alias("movement"))


@query(
    "sig06_chord_events",
    f"""{with_('p')}, q AS (SELECT session_id, measure, t, state_idx, pitch, 20.0 * log10(greatest(amplitude, 1e-9) / 100) AS db FROM p),
    c AS (SELECT session_id, measure, count(*) AS members, max(t) - min(t) AS spread, max(pitch) AS melody, min(pitch) AS bass, list_sort(list_distinct(list(pitch))) AS pitches FROM q GROUP BY ALL),
    m AS (SELECT q.session_id, q.measure, max(db) FILTER (WHERE pitch = melody) - max(db) FILTER (WHERE pitch <> melody) AS margin FROM q JOIN c USING (session_id, measure) GROUP BY ALL),
    l AS (SELECT *, lag(pitches) OVER (PARTITION BY session_id ORDER BY measure) AS before FROM c)
    SELECT session_id, measure, members, spread, melody, bass, round(margin, 6) AS margin, coalesce(len(list_filter(before, lambda x: NOT list_contains(pitches, x))), 0)::INTEGER AS residue FROM l JOIN m USING (session_id, measure)""",
)
def sig06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bar as one chord: margin of the highest note over the rest, spread of the attacks, pitches left from before."""
    notes = perf_notes(spark, sf_dir).select("session_id", "measure", "t", "pitch", (F.lit(20.0) * F.log10(F.greatest("amplitude", F.lit(1e-9)) / 100)).alias("db"))
    top = notes.withColumn("melody", F.max("pitch").over(W.partitionBy("session_id", "measure")))
    own, rest = F.max(F.when(F.col("pitch") == F.col("melody"), F.col("db"))), F.max(F.when(F.col("pitch") != F.col("melody"), F.col("db")))
    chords = top.groupBy("session_id", "measure").agg(
        F.count("*").alias("members"), (F.max("t") - F.min("t")).alias("spread"), F.max("pitch").alias("melody"), F.min("pitch").alias("bass"), F.round(own - rest, 6).alias("margin"), F.collect_set("pitch").alias("pitches")
    )
    before = F.lag("pitches").over(W.partitionBy("session_id").orderBy("measure"))
    left = F.coalesce(F.size(F.array_except(F.col("before"), F.col("pitches"))), F.lit(0))
    return chords.withColumn("before", before).select("session_id", "measure", "members", "spread", "melody", "bass", "margin", F.when(F.col("before").isNull(), 0).otherwise(left).alias("residue"))


@query(
    "sig15_music_start_valley",
    f"""{with_('p')}, c AS (SELECT session_id, measure, count(*) AS n FROM p GROUP BY ALL), m AS (SELECT *, avg(n) OVER (PARTITION BY session_id ORDER BY measure ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS smooth FROM c),
    d AS (SELECT *, max(smooth) OVER (PARTITION BY session_id ORDER BY measure ROWS UNBOUNDED PRECEDING) AS high FROM m)
    SELECT session_id, min(measure) AS valley FROM d WHERE high >= 3 AND smooth <= 0.6 * high GROUP BY 1""",
)
def sig15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first bar of a low run after a dense one, on a smoothed density."""
    session = W.partitionBy("session_id").orderBy("measure")
    rows = perf_notes(spark, sf_dir).groupBy("session_id", "measure").agg(F.count("*").alias("n")).withColumn("smooth", F.avg("n").over(session.rowsBetween(-1, 1)))
    rows = rows.withColumn("high", F.max("smooth").over(session.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return rows.where("high >= 3 AND smooth <= 0.6 * high").groupBy("session_id").agg(F.min("measure").alias("valley"))


@query(
    "win20_system_weights",
    """WITH c AS (SELECT n_regionkey AS page, n_nationkey AS system, count(s_suppkey) AS bars, coalesce(sum(s_acctbal), 0) AS width FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY ALL),
    w AS (SELECT page, system, greatest(width, 0) / nullif(sum(greatest(width, 0)) OVER (PARTITION BY page), 0) AS a, least(bars, 6)::DOUBLE / nullif(sum(least(bars, 6)) OVER (PARTITION BY page), 0) AS b, max(bars) OVER (PARTITION BY page) - min(bars) OVER (PARTITION BY page) AS spread, count(*) OVER (PARTITION BY page) AS k FROM c)
    SELECT page, system, round(CASE WHEN spread <= 1 THEN 1.0 / k ELSE (coalesce(a, 0) + coalesce(b, 0)) / 2 END, 9) AS weight FROM w""",
)
def win20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean of a system's share of width and of capped bars; equal weights where bars hardly differ."""
    bars = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("system")).agg(F.count("*").alias("bars"), F.sum("s_acctbal").alias("width"))
    rows = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("page"), F.col("n_nationkey").alias("system")).join(bars, "system", "left").fillna(0, ["bars", "width"])
    page = W.partitionBy("page")
    share = lambda c: F.coalesce(c / F.nullif(F.sum(c).over(page), F.lit(0)), F.lit(0.0))
    flat = F.max("bars").over(page) - F.min("bars").over(page) <= 1
    both = (share(F.greatest("width", F.lit(0.0))) + share(F.least("bars", F.lit(6)).cast("double"))) / 2
    return rows.select("page", "system", F.round(F.when(flat, F.lit(1.0) / F.count("*").over(page)).otherwise(both), 9).alias("weight"))


@query(
    "rul13_reconciliation",
    """WITH c AS (SELECT n_regionkey AS page, n_nationkey AS system, count(s_suppkey) AS bars FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY ALL),
    t AS (SELECT *, sum(bars) OVER (PARTITION BY page) AS total, 10 + page AS declared, row_number() OVER (PARTITION BY page ORDER BY system) AS r, count(*) OVER (PARTITION BY page) AS k FROM c)
    SELECT page, system, (CASE WHEN total = declared THEN bars ELSE declared // k + CASE WHEN r > k - declared % k THEN 1 ELSE 0 END END)::BIGINT AS bars, CASE WHEN total = declared THEN 'kept' ELSE 'redistributed' END AS action FROM t""",
)
def rul13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page whose bars do not add up to the declared number has them dealt anew."""
    bars = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("system")).agg(F.count("*").alias("bars"))
    rows = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("page"), F.col("n_nationkey").alias("system")).join(bars, "system", "left").fillna(0, ["bars"])
    page = W.partitionBy("page")
    rows = rows.withColumn("total", F.sum("bars").over(page)).withColumn("declared", F.col("page") + 10).withColumn("r", F.row_number().over(page.orderBy("system"))).withColumn("k", F.count("*").over(page))
    dealt = F.floor(F.col("declared") / F.col("k")) + F.when(F.col("r") > F.col("k") - F.col("declared") % F.col("k"), 1).otherwise(0)
    kept = F.col("total") == F.col("declared")
    return rows.select("page", "system", F.when(kept, F.col("bars")).otherwise(dealt).cast("bigint").alias("bars"), F.when(kept, "kept").otherwise("redistributed").alias("action"))


@query(
    "rul14_barline_crosscheck",
    """WITH p AS (SELECT n_regionkey AS page, n_nationkey AS system, count(s_suppkey) AS parsed FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY ALL), d AS (SELECT c_nationkey AS system, count(*) // 12 AS detected FROM customer GROUP BY 1),
    x AS (SELECT page, system, parsed, coalesce(detected, 0) AS detected FROM p LEFT JOIN d USING (system)), g AS (SELECT page, count(*) FILTER (WHERE detected > parsed) * 2 > count(*) AS whole FROM x GROUP BY 1)
    SELECT page, system, (CASE WHEN detected > parsed OR (whole AND detected > 0) THEN detected ELSE parsed END)::BIGINT AS bars FROM x JOIN g USING (page)""",
)
def rul14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detected bars replace parsed ones where there are more, and on a page where most systems have more."""
    parsed = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("system")).agg(F.count("*").alias("parsed"))
    found = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("system")).agg(F.floor(F.count("*") / 12).alias("detected"))
    rows = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("page"), F.col("n_nationkey").alias("system")).join(parsed, "system", "left").join(found, "system", "left").fillna(0, ["parsed", "detected"])
    page = W.partitionBy("page")
    more = F.col("detected") > F.col("parsed")
    rows = rows.withColumn("whole", F.count_if(more).over(page) * 2 > F.count("*").over(page))
    return rows.select("page", "system", F.when(more | (F.col("whole") & (F.col("detected") > 0)), F.col("detected")).otherwise(F.col("parsed")).cast("bigint").alias("bars"))


@query(
    "rul15_fallback_pages",
    """SELECT n_regionkey AS page FROM nation LEFT JOIN (SELECT s_nationkey, count(*) AS n, min(s_acctbal) AS low FROM supplier GROUP BY 1) s ON s_nationkey = n_nationkey GROUP BY 1
    HAVING count(n) = 0 OR count(n) <> count(*) OR bool_or(low < -990)""",
)
def rul15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages without systems, with too few of them, or with an implausible box."""
    found = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"), F.min("s_acctbal").alias("low"))
    pages = table(spark, sf_dir, "nation").join(found, "n_nationkey", "left").groupBy(F.col("n_regionkey").alias("page"))
    flags = pages.agg(F.count("n").alias("a"), F.count("*").alias("b"), F.coalesce(F.bool_or(F.col("low") < -990), F.lit(False)).alias("odd"))
    return flags.where((F.col("a") == 0) | (F.col("a") != F.col("b")) | F.col("odd")).select("page")


@query(
    "flt18_compact_events",
    """SELECT conv_id, array_to_string(list(turn::VARCHAR || ':' || role ORDER BY turn), ' ') AS digest FROM (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 40) GROUP BY 1""",
)
def flt18(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 40 turns of a conversation, two fields of each."""
    recent = F.row_number().over(W.partitionBy("conv_id").orderBy(F.col("turn").desc()))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role").withColumn("r", recent).where("r <= 40")
    rows = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("x"))
    return rows.select("conv_id", F.array_join(F.transform("x", lambda e: F.concat(e["turn"].cast("string"), F.lit(":"), e["role"])), " ").alias("digest"))

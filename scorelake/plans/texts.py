"""Scalar rules on bound texts and numbers: ids, names of files, comments, documents, labels, spans of time, highlights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.functions import layout, pitch, text
from scorelake.plans.registry import query
from scorelake.sources.bindings import perf_notes, table, with_


@query(
    "fn17_safe_ids",
    """WITH x AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN '  ' || split_part(url, '/', 4) || '-' || page_id || ' ' WHEN 2 THEN substr(html, 1, 90) ELSE repeat(' ', (page_id % 3)::INTEGER) || CASE WHEN page_id % 8 = 3 THEN 'a..b' ELSE '' END END AS id FROM pages)
    SELECT page_id, CASE WHEN trim(id) <> '' THEN 'cmt_' || substr(regexp_replace(trim(id), '[^A-Za-z0-9_.-]', '_', 'g'), 1, 64) END AS thread,
      CASE WHEN regexp_matches(trim(id), '^[A-Za-z0-9_.-]+$') AND NOT contains(id, '..') THEN trim(id) END AS conversation FROM x""",
)
def fn17(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thread ids of comments and the names that may stand in a path, of addresses, their parts, page text and blanks."""
    page = F.col("page_id")
    blank = F.concat(F.expr("repeat(' ', cast(page_id % 3 as int))"), F.when(page % 8 == 3, "a..b").otherwise(""))
    part = F.concat(F.lit("  "), F.coalesce(F.get(F.split("url", "/"), 3), F.lit("")), F.lit("-"), page.cast("string"), F.lit(" "))
    id_ = F.when(page % 4 == 0, F.col("url")).when(page % 4 == 1, part).when(page % 4 == 2, F.substring("html", 1, 90)).otherwise(blank)
    return table(spark, sf_dir, "pages").select("page_id", text.comment_thread(id_).alias("thread"), text.path_safe(id_).alias("conversation"))


@query(
    "fn18_movement_number",
    """SELECT page_id, CASE page_id % 6 WHEN 0 THEN page_id WHEN 1 THEN page_id WHEN 2 THEN page_id WHEN 3 THEN NULL WHEN 4 THEN NULL ELSE NULL END::INTEGER AS movement FROM pages""",
)
def fn18(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Movement numbers of files at the pages' addresses: with a query, a fragment, slashes behind them, and three names that
    have none."""
    base, n = F.substring_index(F.substring_index("url", "?", 1), "#", 1), F.col("page_id").cast("string")
    ends = [("_", ".mid"), ("_2_", ".MIDI?x=_9.mid"), ("_", ".midi//#_7.mid"), ("", ".mid"), ("_", ".mid.txt"), ("_x", ".mid")]
    url = F.element_at(F.array(*(F.concat(base, F.lit(a), n, F.lit(b)) for a, b in ends)), (F.col("page_id") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", text.movement_number(url).alias("movement"))


_COMMENTS = """x AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, event_id % 5 AS k, value FROM events)"""


@query(
    "fn22_comments",
    f"""WITH {_COMMENTS}, s AS (SELECT *, CASE WHEN k = 1 THEN 0.0::DOUBLE WHEN k = 3 THEN -1.5::DOUBLE ELSE value END AS st FROM x WHERE k <> 4),
    e AS (SELECT *, CASE WHEN k = 0 THEN value + 1 WHEN k = 2 THEN 0.5::DOUBLE ELSE st + 2 END AS en FROM s)
    SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY round(greatest(0.0, st), 3), i) - 1)::INTEGER AS place, CASE WHEN k = 0 THEN 'c' || event_id ELSE 'g_' || lpad(i::VARCHAR, greatest(3, length(i::VARCHAR))::INTEGER, '0') END AS id,
      round(greatest(0.0, st), 3) AS start, round(greatest(st, en), 3) AS "end", CASE WHEN k = 0 THEN 'tempo' ELSE 'interpretation' END AS category, CASE WHEN k = 2 THEN 'alert' ELSE 'warn' END AS severity,
      CASE WHEN k = 0 THEN 'new' WHEN k = 2 THEN 'old' ELSE '' END AS summary, CASE WHEN k = 3 THEN 'said' ELSE '' END AS text FROM e""",
)
def fn22(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events as the comments of an answer: new and old names of fields, empty ones, missing ones, a time below zero
    and entries that are no objects."""
    k, n, value = F.col("event_id") % 5, F.col("event_id").cast("string"), F.col("value").cast("string")
    j = lambda *parts: F.concat(*(p if not isinstance(p, str) else F.lit(p) for p in parts))
    entry = (
        F.when(k == 0, j('{"id": "c', n, '", "start": ', value, ', "start_sec": 99, "end": ', (F.col("value") + 1).cast("string"), ', "category": "tempo", "summary": " new ", "title": "old"}'))
        .when(k == 1, j('{"id": "", "start": 0, "severity": null}'))
        .when(k == 2, j('{"start_sec": ', value, ', "end_sec": 0.5, "severity": "alert", "summary": "", "title": "old"}'))
        .when(k == 3, j('{"start": -1.5, "end": 0, "message": " said ", "category": ""}'))
        .otherwise(j('"no object"'))
    )
    listed = F.sort_array(F.collect_list(F.struct("event_id", entry.alias("e"))))
    bodies = table(spark, sf_dir, "events").groupBy("user_id").agg(F.concat(F.lit("["), F.array_join(listed["e"], ", "), F.lit("]")).alias("body"))
    rows = bodies.select("user_id", F.posexplode(text.comments(F.col("body"))).alias("place", "c"))
    return rows.select("user_id", "place", "c.id", "c.start", "c.end", "c.category", "c.severity", "c.summary", "c.text")


@query(
    "src07_envelopes",
    """WITH e AS (SELECT user_id, event_id, regexp_extract(props, '"k": *([0-9]+)', 1)::INTEGER AS k FROM events)
    SELECT user_id, count(*) FILTER (WHERE event_id % 3 > 0 AND user_id % 4 < 2) AS n, coalesce(sum(k) FILTER (WHERE event_id % 3 > 0 AND user_id % 4 < 2), 0)::BIGINT AS total FROM e GROUP BY user_id""",
)
def src07(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's notes as a list, as a list in an envelope, under another name, or cut short; every third row is no object."""
    row = F.when(F.col("event_id") % 3 == 0, F.col("event_id").cast("string")).otherwise(F.col("props"))
    listed = F.array_join(F.sort_array(F.collect_list(F.struct("event_id", row.alias("r"))))["r"], ", ")
    bodies = table(spark, sf_dir, "events").groupBy("user_id").agg(F.concat(F.lit("["), listed, F.lit("]")).alias("l"))
    kind = F.col("user_id") % 4
    body = F.when(kind == 0, F.concat(F.lit(" "), "l")).when(kind == 1, F.concat(F.lit('{"version": 1, "notes": '), "l", F.lit("}"))).when(kind == 2, F.concat(F.lit('{"rows": '), "l", F.lit("}"))).otherwise(F.lit("no JSON"))
    found = text.rows_of(body, "struct<k: int>")
    return bodies.select("user_id", F.size(found).cast("bigint").alias("n"), F.aggregate(found, F.lit(0).cast("bigint"), lambda a, r: a + r["k"]).alias("total"))


@query(
    "fn10_confidence_labels",
    """SELECT event_id, CASE WHEN value / 20 >= 0.5 THEN 'high' ELSE 'medium' END AS by_amplitude, CASE WHEN value / 20 >= 0.85 THEN 'high' WHEN value / 20 >= 0.65 THEN 'medium' ELSE 'low' END AS by_voicing,
      CASE WHEN event_type = 'error' THEN 'absent' WHEN event_id % 3 = 0 THEN 'high' WHEN value / 5 >= 3.0 THEN 'medium' ELSE 'low' END AS by_harmonics FROM events""",
)
def fn10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How sure a note is: by its amplitude, by the mean probability of its voicing, and by its harmonics or its energy."""
    v = F.col("value") / 20
    return table(spark, sf_dir, "events").select(
        "event_id", pitch.sure_by_amplitude(v).alias("by_amplitude"), pitch.sure_by_voicing(v).alias("by_voicing"),
        pitch.sure_by_harmonics(F.col("event_type") != "error", (F.col("event_id") % 3 == 0).cast("int"), F.col("value") / 5).alias("by_harmonics"),
    )


@query(
    "fn12_respelled_text",
    """WITH x AS (SELECT page_id, page_id % 3 AS k, 'C#4 then D#-1, F# and G#5; A#2 or a#2, ' || substr(url, 1, 20) || ' XC#4 #' AS t FROM pages)
    SELECT page_id, CASE k WHEN 0 THEN t WHEN 1 THEN replace(t, 'A#2 or', 'Bb2 or') ELSE replace(replace(replace(replace(replace(t, 'C#4 then', 'Db4 then'), 'D#-1', 'Eb-1'), 'F# and', 'Gb and'), 'G#5;', 'Ab5;'), 'A#2 or', 'Bb2 or') END AS told FROM x""",
)
def fn12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sharp names inside a sentence as a key spells them; letters before a name make it part of a word."""
    key = F.element_at(F.array(*map(F.lit, ("G major", "F Major", "Gb major"))), (F.col("page_id") % 3 + 1).cast("int"))
    told = F.concat(F.lit("C#4 then D#-1, F# and G#5; A#2 or a#2, "), F.substring("url", 1, 20), F.lit(" XC#4 #"))
    return table(spark, sf_dir, "pages").select("page_id", pitch.spelled_text(told, key).alias("told"))


@query(
    "fn30_highlights",
    """WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey, l_discount * 5 AS sx, CASE WHEN l_linenumber % 4 > 0 THEN l_quantity / 50 END AS sw, l_tax * 12 AS x0, l_tax * 12 + l_quantity / 100 AS x1 FROM lineitem),
    c AS (SELECT *, greatest(coalesce(nullif(sw, 0), 1), 0.000001) AS w FROM b)
    SELECT l_orderkey, l_linenumber, l_partkey, round(greatest(0, least(1, (x0 - sx) / w)), 4) AS from_share, round(greatest(0, least(1, (x1 - sx) / w)), 4) AS to_share, round(sx + x0 * coalesce(nullif(sw, 0), 1), 6) AS page_x0, round(sx + x1 * coalesce(nullif(sw, 0), 1), 6) AS page_x1 FROM c""",
)
def fn30(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bar on the page as a share of its system, and one given as shares of its system on the page."""
    sx, sw = F.col("l_discount") * 5, F.when(F.col("l_linenumber") % 4 > 0, F.col("l_quantity") / 50)
    x0, x1 = F.col("l_tax") * 12, F.col("l_tax") * 12 + F.col("l_quantity") / 100
    inside = [layout.share_of_system(sx, sw, x).alias(n) for x, n in ((x0, "from_share"), (x1, "to_share"))]
    outside = [F.round(layout.place_on_page(sx, sw, x), 6).alias(n) for x, n in ((x0, "page_x0"), (x1, "page_x1"))]
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", *inside, *outside)


@query(
    "fn34_expiry",
    """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE ts + INTERVAL 1 HOUR * (event_id % 4) > TIMESTAMP '2024-01-15 12:00:00' END AS live, CASE WHEN event_id % 5 > 0 THEN round((epoch_us(TIMESTAMP '2024-01-15 12:00:00') - epoch_us(ts)) / 1e6, 3) END AS elapsed_sec,
      CASE WHEN event_id % 5 > 0 THEN strftime(ts, '%Y-%m-%d') END AS day FROM events""",
)
def fn34(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times written as text, some of them no time: whether they hold at noon of the 15th, how long ago they were, their day."""
    said = F.when(F.col("event_id") % 5 == 0, "soon").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    at, now = F.expr("try_cast(said as timestamp_ntz)"), F.expr("timestamp_ntz'2024-01-15 12:00:00'")
    rows = table(spark, sf_dir, "events").select("event_id", said.alias("said")).withColumn("at", at)
    live = F.col("at") + F.expr("make_dt_interval(0, cast(event_id % 4 as int), 0, 0)") > now
    elapsed = F.expr("timestampdiff(MICROSECOND, at, timestamp_ntz'2024-01-15 12:00:00') / 1e6D")
    return rows.select("event_id", live.alias("live"), F.round(elapsed, 3).alias("elapsed_sec"), F.when(F.col("at").isNotNull(), F.substring("said", 1, 10)).alias("day"))


@query(
    "agg28_turns_and_images",
    """SELECT conv_id, max(CASE WHEN turn % 7 = 3 THEN 0 ELSE turn END) + 1 AS turns, count(*) FILTER (WHERE role = 'user' AND turn % 2 = 0) AS images FROM conversations GROUP BY 1""",
)
def agg28(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many turns a conversation's calls took (a missing number counts as 0), and how many parts are images by their kind."""
    mime = F.when((F.col("role") == "user") & (F.col("turn") % 2 == 0), "image/png").when(F.col("role") == "user", "application/image/x").when(F.col("turn") % 2 == 0, "text/plain")
    turn = F.when(F.col("turn") % 7 != 3, F.col("turn"))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg((F.max(F.coalesce(turn, F.lit(0))) + 1).alias("turns"), F.count_if(mime.startswith("image/")).alias("images"))


@query(
    "rul15_pages_to_detect",
    """WITH s AS (SELECT o_custkey AS page, count(*) AS found, bool_or(NOT (o_totalprice / 400000 > 0.02 AND o_totalprice / 400000 <= 0.7)) AS odd FROM orders WHERE o_orderkey % 3 > 0 GROUP BY 1),
    p AS (SELECT c_custkey AS page, CASE WHEN c_custkey % 4 > 0 THEN 'music' ELSE 'front_matter' END AS kind, CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 7 WHEN 2 THEN 0 ELSE c_custkey % 9 END AS declared FROM customer),
    j AS (SELECT p.*, coalesce(found, 0) AS found, coalesce(odd, false) AS odd FROM p LEFT JOIN s USING (page))
    SELECT page, CASE WHEN found = 0 THEN 'no systems' WHEN declared > 0 AND found <> declared THEN 'other count' ELSE 'bad box' END AS reason FROM j
    WHERE CASE WHEN found = 0 THEN kind = 'music' OR coalesce(declared, 0) <> 0 ELSE (coalesce(declared, 0) > 0 AND found <> declared) OR odd END""",
)
def rul15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose staves have to be detected anew: music or declared systems without any found, another number of systems
    than declared, or a box that cannot be."""
    box = F.struct(F.lit(0.1).alias("x"), F.lit(0.1).alias("y"), F.lit(0.8).alias("w"), (F.col("o_totalprice") / 400_000).alias("h"))
    systems = table(spark, sf_dir, "orders").where("o_orderkey % 3 > 0").select(F.col("o_custkey").alias("page"), box.alias("box"))
    page = F.col("c_custkey")
    declared = F.when(page % 5 == 1, 7).when(page % 5 == 2, 0).when(page % 5 > 2, page % 9)
    pages = table(spark, sf_dir, "customer").select(page.alias("page"), F.when(page % 4 > 0, "music").otherwise("front_matter").alias("kind"), declared.alias("declared"))
    return layout.pages_to_detect(pages, systems)

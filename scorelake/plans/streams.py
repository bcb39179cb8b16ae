"""Stateful streams over the events, run to the end of what is there, with the same results in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.operators.cluster import scratch_path
from scorelake.plans.registry import query
from scorelake.sources.bindings import table
from scorelake.streaming import stages, state


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of files; the pattern lets the table be one file or a folder of them."""
    return spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/event[s].parquet")


@query("str04_daily_quota", "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id) <= 3 AS allowed FROM events")
def str04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three events of a user's day pass; a day's count falls when the watermark has passed the day."""
    return state.finished(state.daily_quota(_events(spark, sf_dir), 3), scratch_path(spark, "quota"))


@query(
    "str05_decision_cache",
    """WITH RECURSIVE e AS (SELECT user_id, event_type, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM events),
    c AS (SELECT user_id, event_type, event_id, us, r, us AS decided, false AS hit FROM e WHERE r = 1
      UNION ALL SELECT e.user_id, e.event_type, e.event_id, e.us, e.r, CASE WHEN e.us - c.decided < 43200000000 THEN c.decided ELSE e.us END, e.us - c.decided < 43200000000
      FROM c JOIN e ON e.user_id = c.user_id AND e.event_type = c.event_type AND e.r = c.r + 1)
    SELECT user_id, event_id, hit FROM c""",
)
def str05(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A decision on a user's topic holds for twelve hours; later ones within are hits."""
    return state.finished(state.cached_decisions(_events(spark, sf_dir), 43_200), scratch_path(spark, "decisions"))


@query(
    "str02_running_tempo",
    """WITH e AS (SELECT user_id, event_id, ts, epoch_us(ts) AS us, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) > 43200000000, true)::INT AS new FROM events),
    i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM e),
    w AS (SELECT user_id, event_id, us - first_value(us) OVER w AS span, count(*) OVER w AS n FROM i WINDOW w AS (PARTITION BY user_id, run ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
    SELECT user_id, event_id, CASE WHEN n > 2 AND span > 0 THEN round(60 * (n - 1) / (span / 1e6), 9) END AS tempo FROM w""",
)
def str02(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tempo over the last five events of a user; after a pause of twelve hours it starts anew, and the state falls."""
    found = state.finished(state.running_tempo(_events(spark, sf_dir), 4, 43_200), scratch_path(spark, "tempo"))
    return found.withColumn("tempo", F.round("tempo", 9))


@query(
    "str06_stage_states",
    f"""WITH e AS (SELECT user_id AS job_id, 'stage' || event_id % 4 AS stage, event_id, CASE event_type WHEN 'view' THEN 'running' WHEN 'click' THEN 'ready' WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'skipped' WHEN 'signup' THEN CASE WHEN event_id % 7 = 0 THEN 'cancelled' ELSE 'queued' END END AS s FROM events),
    l AS (SELECT job_id, stage, list_concat([{{'s': 'queued', 'a': 0::BIGINT, 'r': 0::BIGINT}}], list({{'s': s, 'a': 0::BIGINT, 'r': 0::BIGINT}} ORDER BY event_id)) AS x FROM e GROUP BY ALL),
    f AS (SELECT job_id, stage, list_reduce(x, lambda p, n: CASE WHEN list_contains([{", ".join(f"'{a}>{b}'" for a, b in stages.TRANSITIONS)}], p.s || '>' || n.s) THEN {{'s': n.s, 'a': p.a + 1, 'r': p.r}} ELSE {{'s': p.s, 'a': p.a, 'r': p.r + 1}} END) AS y FROM l)
    SELECT job_id, stage, y.s AS state, y.a AS applied, y.r AS refused FROM f""",
)
def str06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status events of jobs and stages folded by the table of legal transitions."""
    names = {"view": "running", "click": "ready", "error": "failed", "purchase": "skipped"}
    state_ = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in names.items() for x in kv)), F.col("event_type")), F.when(F.col("event_id") % 7 == 0, "cancelled").otherwise("queued"))
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), F.concat(F.lit("stage"), (F.col("event_id") % 4).cast("string")).alias("stage"), F.col("event_id").alias("seq"), state_.alias("state"))
    return stages.stage_states(rows)


@query("str09_file_jobs", "SELECT 'ready' AS state, count(*) AS n_rows, count(DISTINCT conv_id) AS n_conversations FROM conversations")
def str09(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of conversations arrive in a folder, become jobs and go through two stages; what the stages found, by state."""
    root = scratch_path(spark, "jobs")
    table(spark, sf_dir, "conversations").select("conv_id", "turn").repartition("conv_id").write.option("maxRecordsPerFile", 2_000).parquet(f"{root}/in")

    def counted(jobs: DataFrame) -> DataFrame:
        """The messages of each conversation in each file of the batch, written under the stage's own name; files are read
        as one table. A file is as large as it may be, so a conversation can go on in the next."""
        named = jobs.withColumn("file", F.element_at(F.split("path", "/"), -1))
        name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
        found = spark.read.parquet(f"{root}/in").groupBy(name.alias("file"), "conv_id").agg(F.count("*").alias("n_rows"))
        target = f"{root}/counts/{jobs_key(jobs)}"
        named.join(found, "file").select("job_id", "conv_id", "n_rows").write.mode("overwrite").parquet(target)
        return spark.read.parquet(target).select("job_id").distinct().select("job_id", F.lit(None).cast("string").alias("error"))

    def jobs_key(jobs: DataFrame) -> str:
        """The same jobs give the same name, so that a repeated stage replaces what it wrote."""
        return f"{jobs.agg(F.coalesce(F.bit_xor(F.xxhash64('job_id')), F.lit(0)).alias('k')).first().k:x}"

    def checked(jobs: DataFrame) -> DataFrame:
        return jobs.select("job_id", F.when(F.col("length") <= 0, "empty file").alias("error"))

    line = [stages.Stage("count", counted), stages.Stage("check", checked)]
    files = stages.arrivals(spark, f"{root}/in").where("path like '%.parquet'")
    stages.start(files, f"{root}/work", line, f"{root}/state").awaitTermination()
    found = spark.read.schema("job_id string, conv_id bigint, n_rows bigint").option("recursiveFileLookup", "true").parquet(f"{root}/counts")
    per = stages.states(spark, f"{root}/work", line).join(found, "job_id")
    return per.groupBy("state").agg(F.sum("n_rows").alias("n_rows"), F.count_distinct("conv_id").alias("n_conversations"))

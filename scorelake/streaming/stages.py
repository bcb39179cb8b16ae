"""Jobs in stages: files that arrive become jobs, stages run over many jobs at a time, and what has been done stays done.

All of it is tables under a root, written once and never changed: ``jobs/batch=N``, ``outcomes/run=R/stage=S`` and
``claims``. A table is there or it is not (its success mark is the last thing written), so a batch that is killed and
started again finds the stages it finished and goes on with the next. A job's state is read from its outcomes.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.sources import stores

JOBS = "job_id string, path string, length bigint"
OUTCOMES = "job_id string, stage string, attempt int, state string, error string"

#: Which state may follow which.
TRANSITIONS = (
    ("queued", "running"), ("queued", "skipped"), ("queued", "cancelled"), ("running", "ready"), ("running", "failed"), ("running", "skipped"), ("running", "cancelled"),
    ("failed", "running"), ("failed", "cancelled"), ("skipped", "running"),
)
DONE = ("ready", "skipped")


@dataclass(frozen=True)
class Stage:
    """``work`` takes jobs and returns job_id and error (null where it went well); jobs it does not return have failed. A
    required stage that failed stops a job, any other leaves a warning."""

    name: str
    work: Callable[[DataFrame], DataFrame]
    required: bool = True


def folded(states: Column, first: str = "queued") -> Column:
    """state, applied, refused after an array of states in their order: each is taken if it may follow the one before."""
    legal = [f"{a}>{b}" for a, b in TRANSITIONS]
    start = F.struct(F.lit(first).alias("state"), F.lit(0).cast("bigint").alias("applied"), F.lit(0).cast("bigint").alias("refused"))

    def step(acc: Column, new: Column) -> Column:
        ok = F.concat(acc["state"], F.lit(">"), new).isin(legal)
        return F.struct(F.when(ok, new).otherwise(acc["state"]).alias("state"), (acc["applied"] + ok.cast("bigint")).alias("applied"), (acc["refused"] + (~ok).cast("bigint")).alias("refused"))

    return F.aggregate(states, start, step)


def stage_states(events: DataFrame) -> DataFrame:
    """job_id, stage, state, applied, refused. events: job_id, stage, seq, state; unknown states are refused."""
    rows = events.groupBy("job_id", "stage").agg(F.sort_array(F.collect_list(F.struct("seq", "state"))).alias("x"))
    return rows.select("job_id", "stage", folded(F.transform("x", lambda e: F.coalesce(e["state"], F.lit("")))).alias("s")).select("job_id", "stage", "s.*")


def arrivals(spark: SparkSession, folder: str, most: int = 1_000) -> DataFrame:
    """path, length of files as they arrive in a folder, ``most`` to a batch. Contents are not read here."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("recursiveFileLookup", "true")
    return files.option("maxFilesPerTrigger", most).load(folder).select("path", "length")


def _there(spark: SparkSession, path: str) -> bool:
    return stores.exists(spark, f"{path}/_SUCCESS")


def _table(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    path = f"{root}/{name}"
    if not stores.exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)


def jobs(spark: SparkSession, root: str) -> DataFrame:
    return _table(spark, root, "jobs", JOBS)


def outcomes(spark: SparkSession, root: str) -> DataFrame:
    """The last attempt of every job and stage."""
    last = F.max_by(F.struct("attempt", "state", "error"), "attempt").alias("x")
    return _table(spark, root, "outcomes", OUTCOMES).groupBy("job_id", "stage").agg(last).select("job_id", "stage", "x.*")


def run_stages(spark: SparkSession, root: str, run: str, todo: DataFrame, stages: list[Stage], attempt: int = 1) -> None:
    """Each stage over the jobs of ``todo`` that have not done it and may: all required stages before are done. The
    stage's outcome is written under the run's name; a run that is repeated skips the stages it has written."""
    for k, stage in enumerate(stages):
        target = f"{root}/outcomes/run={run}/stage={stage.name}"
        if _there(spark, target):
            continue
        done = outcomes(spark, root).where(F.col("state").isin(*DONE))
        needed = [s.name for s in stages[:k] if s.required]
        able = todo.join(done.where(F.col("stage") == stage.name), "job_id", "left_anti")
        if needed:
            ready = done.where(F.col("stage").isin(needed)).groupBy("job_id").count().where(F.col("count") == len(needed))
            able = able.join(ready, "job_id", "left_semi")
        found = stage.work(able).select("job_id", F.lit(True).alias("_said"), "error")
        rows = able.select("job_id").join(found, "job_id", "left")
        error = F.when(F.col("_said").isNull(), "no outcome").otherwise(F.col("error"))
        rows = rows.select("job_id", F.lit(stage.name).alias("stage"), F.lit(attempt).alias("attempt"), F.when(error.isNull(), "ready").otherwise("failed").alias("state"), error.alias("error"))
        rows.write.mode("overwrite").parquet(target)


def put(batch: DataFrame, batch_id: int, root: str, stages: list[Stage]) -> None:
    """A batch of arrived files as jobs, and all stages over them."""
    spark = batch.sparkSession
    target = f"{root}/jobs/batch={batch_id}"
    if not _there(spark, target):
        batch.select(F.sha2("path", 256).alias("job_id"), "path", "length").dropDuplicates(["job_id"]).write.mode("overwrite").parquet(target)
    run_stages(spark, root, f"batch-{batch_id}", spark.read.schema(JOBS).parquet(target), stages)


def start(files: DataFrame, root: str, stages: list[Stage], checkpoint: str):
    """The stream from arriving files to finished stages. A batch that is repeated after a failure finds its jobs and
    outcomes by its number."""
    write = files.writeStream.foreachBatch(lambda batch, n: put(batch, n, root, stages))
    return write.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def states(spark: SparkSession, root: str, stages: list[Stage]) -> DataFrame:
    """job_id, path, state (ready, failed, running), failed_stage, warnings of every job."""
    order = {s.name: k for k, s in enumerate(stages)}
    required = [s.name for s in stages if s.required]
    place = F.element_at(F.create_map(*(F.lit(x) for kv in order.items() for x in kv)), F.col("stage"))
    fails = (F.col("state") == "failed") & F.col("stage").isin(required)
    per = outcomes(spark, root).where(F.col("stage").isin(list(order))).groupBy("job_id").agg(
        F.min_by(F.when(fails, F.col("stage")), F.when(fails, place)).alias("failed_stage"),
        F.count_if(F.col("state").isin(*DONE) & F.col("stage").isin(required)).alias("done"), F.count_if((F.col("state") == "failed") & ~F.col("stage").isin(required)).alias("warnings"),
    )
    state = F.when(F.col("failed_stage").isNotNull(), "failed").when(F.coalesce("done", F.lit(0)) == len(required), "ready").otherwise("running")
    return jobs(spark, root).join(per, "job_id", "left").select("job_id", "path", state.alias("state"), "failed_stage", F.coalesce("warnings", F.lit(0)).alias("warnings"))


def resume(spark: SparkSession, root: str, stages: list[Stage], run: str) -> None:
    """Another attempt at whatever is not done, from each job's first open stage on; finished stages are not repeated."""
    attempt = (outcomes(spark, root).agg(F.max("attempt").alias("n")).first().n or 0) + 1
    run_stages(spark, root, f"resume-{run}", jobs(spark, root), stages, attempt)


CLAIMS = "job_id string, worker string, claimed_at timestamp, until timestamp"


def claim(spark: SparkSession, root: str, worker: str, wanted: DataFrame, now: str, lease_seconds: int) -> DataFrame:
    """The jobs of ``wanted`` (job_id) that are ``worker``'s until its lease ends. Claims are only added: of several live
    ones for a job the earliest holds, ties go to the lesser name, so all workers read the same winner."""
    at = F.lit(now).cast("timestamp")
    held = _holders(spark, root, now)
    free = wanted.select("job_id").distinct().join(held.where(F.col("worker") != worker), "job_id", "left_anti")
    free.select("job_id", F.lit(worker).alias("worker"), at.alias("claimed_at"), (at + F.expr(f"make_dt_interval(0, 0, 0, {lease_seconds})")).alias("until")).write.mode("append").parquet(f"{root}/claims")
    return wanted.join(_holders(spark, root, now).where(F.col("worker") == worker), "job_id", "left_semi")


def _holders(spark: SparkSession, root: str, now: str) -> DataFrame:
    live = _table(spark, root, "claims", CLAIMS).where(F.col("until") > F.lit(now).cast("timestamp"))
    return live.groupBy("job_id").agg(F.min(F.struct("claimed_at", "worker"))["worker"].alias("worker"))


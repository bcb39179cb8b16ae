"""Stored objects: listing, lenient documents, candidates of an artifact, writes by key, deletes with a count.

Paths are Hadoop paths of any file system that Spark is configured for; keys are relative and cannot leave the root."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scorelake.operators.cluster import scratch_path


def key_path(root: str, key: str) -> str:
    """The path of a key; one that would leave the root is refused."""
    parts = key.replace("\\", "/").split("/")
    if key.startswith("/") or any(p in ("", ".", "..") for p in parts):
        raise ValueError(f"not a safe key: {key!r}")
    return f"{root.rstrip('/')}/{'/'.join(parts)}"


def _fs(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    target, fs = _fs(spark, path)
    return bool(fs.exists(target))


def objects(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """path, modified, length, content of every object below a root."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root).withColumnRenamed("modificationTime", "modified")


def documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON documents, one to a file; malformed ones give a row of nulls."""
    return spark.read.schema(schema).option("multiLine", "true").option("mode", "PERMISSIVE").json(path)


def first_existing(spark: SparkSession, root: str, candidates: list[str]) -> str | None:
    """The first of the candidate keys that exists, even if it is empty."""
    return next((c for c in candidates if exists(spark, key_path(root, c))), None)


def required(spark: SparkSession, root: str, candidates: list[str]) -> str:
    found = first_existing(spark, root, candidates)
    if found is None:
        raise FileNotFoundError(f"none of {', '.join(candidates)} under {root}")
    return found


def resolve(candidates: DataFrame, present: DataFrame) -> DataFrame:
    """name, key: for every logical name the existing candidate of the best priority. candidates: name, priority, key;
    present: key."""
    there = candidates.join(present.select("key").distinct(), "key", "left_semi")
    return there.groupBy("name").agg(F.min(F.struct("priority", "key"))["key"].alias("key"))


#: Folders of a table by session, whatever the number of sessions; it must not change while tables are in use.
FOLDERS = 64


def write_session(df: DataFrame, path: str) -> None:
    """A table by session; writing again replaces only the sessions in ``df``. Sessions are dealt to a fixed number of
    folders (column ``folder``), one file each: a folder of its own for every session costs files by sessions times tasks.
    The rows that stay are put beside the new ones in a table of their own first. One writer at a time."""
    spark = df.sparkSession
    rows = df.withColumn("folder", F.pmod(F.xxhash64(F.col("session_id").cast("bigint")), F.lit(FOLDERS)).cast("int"))
    if exists(spark, path):
        staged = scratch_path(spark, "sessions")
        rows.write.parquet(f"{staged}/new")
        new = spark.read.parquet(f"{staged}/new")
        held = spark.read.schema(rows.schema).parquet(path).join(new.select("folder").distinct(), "folder", "left_semi")
        held.join(new.select("session_id").distinct(), "session_id", "left_anti").select(rows.columns).write.parquet(f"{staged}/held")
        rows = new.unionByName(spark.read.parquet(f"{staged}/held"))
    rows.repartition(FOLDERS, "folder").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("folder").parquet(path)


def manifest(spark: SparkSession, root: str, artifacts: list[str]) -> DataFrame:
    """session_id, artifact, n_rows: what has been written for each session. It is read from the tables themselves, so it
    cannot disagree with them."""
    parts = [
        spark.read.parquet(f"{root.rstrip('/')}/{a}").groupBy(F.col("session_id").cast("bigint").alias("session_id")).agg(F.lit(a).alias("artifact"), F.count("*").alias("n_rows"))
        for a in artifacts
        if exists(spark, f"{root.rstrip('/')}/{a}")
    ]
    out = spark.createDataFrame([], "session_id bigint, artifact string, n_rows bigint") if not parts else parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def append_messages(messages: DataFrame, path: str) -> None:
    """Messages (conv_id, turn, writer, seq, text) added to a table that any number of writers append to."""
    messages.write.mode("append").parquet(path)


def merged_messages(messages: DataFrame) -> DataFrame:
    """Each message once, with its place in its conversation. A message is its conversation, its writer and that one's
    number for it: two writers who append at the same turn both keep theirs, and an append that is tried again counts
    once. Messages stand by turn, then by writer and number. Without writer or number a message is known by its text."""
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    known = messages.withColumn("writer", F.coalesce("writer", F.concat(F.lit("~"), digest))).withColumn("seq", F.coalesce("seq", F.lit(0).cast("bigint")))
    once = known.groupBy("conv_id", "writer", "seq").agg(F.min(F.struct("turn", "text")).alias("m")).select("conv_id", "writer", "seq", "m.turn", "m.text")
    place = F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "writer", "seq")) - 1
    return once.withColumn("place", place.cast("bigint"))


def documents_retried(spark: SparkSession, path: str, schema: str, attempts: int = 3, pause: float = 0.2) -> DataFrame:
    """JSON documents whose writer may not have finished: empty files are read again, a few times, before they count as
    rows of nulls."""
    for attempt in range(attempts):
        target, fs = _fs(spark, path)
        found = [f for g in fs.globStatus(target) or [] for f in (fs.listStatus(g.getPath()) if g.isDirectory() else [g])]
        if all(f.getLen() > 0 for f in found):
            break
        if attempt + 1 < attempts:
            time.sleep(pause * 2**attempt)
    return documents(spark, path, schema)


def delete_prefix(spark: SparkSession, path: str) -> int:
    """Delete everything below a path; how many files that were. Deleting again deletes nothing."""
    target, fs = _fs(spark, path)
    if not fs.exists(target):
        return 0
    files, n = fs.listFiles(target, True), 0
    while files.hasNext():
        files.next()
        n += 1
    fs.delete(target, True)
    return n

"""What grouped and mapped Python functions need on a cluster: the package on the executors, groups dealt over tasks,
and a shared folder for written tables."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that their Python can import it."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    target = os.path.join(tempfile.mkdtemp(prefix="spark-"), f"{package.name}.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    context.addPyFile(target)
    _shipped.add(context.applicationId)


def dealt(df: DataFrame, key: str) -> DataFrame:
    """``df`` hashed by ``key`` over an explicit number of partitions. Groups cost Python time, not bytes, so adaptive
    execution, which merges small partitions by bytes, must not put them all into one task."""
    spark = df.sparkSession
    ship(spark)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return df.repartition(parts, key)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder of spark.checkpoint.dir. Only a local session, as in tests, may do without that
    setting; on a cluster a folder of the driver's own is of no use to the executors."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/scorelake/{name}-{uuid.uuid4().hex}"

"""What the operators share: tables, scratch folders, bounded training samples and batches of texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorelake.operators import cluster
from scorelake.operators.cluster import scratch_path

#: The white space between words, as a regular-expression class.
SPACE = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of an Arrow batch: texts are long, and a batch is in memory several times on its way through a worker.
BATCH_ROWS = "1000"


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, and bound the rows of a batch unless the session sets
    its own number: texts of 10,000 rows, Spark's default, may not fit a worker several times."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    cluster.ship(spark)


def scratch(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: later failures restart from the written table."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete scratch tables that no later step reads."""
    for t in tables:
        remove(t.sparkSession, t.scratch_path)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores behind it until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; -1 for a null id, which no held-out fold has."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(parts)), F.lit(-1))


def unit_hash(col: Column, seed: str) -> Column:
    """A hash of ``col`` spread evenly over [0, 1)."""
    return F.pmod(F.xxhash64(F.lit(seed), col), F.lit(1 << 52)).cast("double") / F.lit(float(1 << 52))


def texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes | None]:
    """A string column as UTF-8 bytes, without decoding them."""
    return batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def append_columns(df: DataFrame, make: Callable[[pa.RecordBatch], list[pa.Array]], fields: list[tuple[str, str]]) -> DataFrame:
    """``df`` with columns that ``make`` computes from each batch; an input column of the same name is replaced."""
    ship(df.sparkSession)
    names = [n for n, _ in fields]
    kept = [i for i, c in enumerate(df.columns) if c.lower() not in {n.lower() for n in names}]
    schema = T.StructType([df.schema[i] for i in kept])
    for n, kind in fields:
        schema = schema.add(n, T.DataType.fromDDL(kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), *make(batch)], schema.names)
        pa.default_memory_pool().release_unused()  # workers live on between tasks

    return df.mapInArrow(run, schema)


def bounded_rows(df: DataFrame, order: str, max_chars: int, text: str = "text") -> Iterator[dict]:
    """Rows of an already bounded sample in the order of ``order``, one partition in memory at a time, until
    ``max_chars`` of text have come. Whole texts only: the text that passes the bound is the last one."""
    seen = 0
    for row in df.orderBy(order).toLocalIterator():
        yield row.asDict()
        seen += len(row[text] or "")
        if seen >= max_chars:
            return


def slices(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive items whose sizes add up to about ``most``, so that a batch is worked off piece by piece."""
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[object, dict[str, list]]]:
    """Runs of equal keys in a sorted stream, as lists by column. One group and one batch are in memory at a time."""
    held: dict[str, list] = {}
    for batch in batches:
        if not batch.num_rows:
            continue
        new = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
        held = {n: held[n] + new[n] for n in new} if held else new
        keys = held[key]
        start = 0
        for i in range(1, len(keys)):
            if keys[i] != keys[start]:
                yield keys[start], {n: c[start:i] for n, c in held.items()}
                start = i
        held = {n: c[start:] for n, c in held.items()}
    if held and held[key]:
        yield held[key][0], held


class Recent:
    """A bounded cache of two generations: when the young one is full it becomes the old one. What is used again
    is kept, what is not is forgotten, so memory stays bounded whatever the input holds."""

    def __init__(self, bound: int):
        self.bound, self.young, self.old = bound, {}, {}

    def turn(self) -> None:
        """The young generation becomes the old one if it is full."""
        if len(self.young) > self.bound:
            self.old, self.young = self.young, {}

    def missing(self, keys) -> list:
        """Keys that neither generation has; those of the old one move to the young one."""
        self.turn()
        young, old, out = self.young, self.old, []
        for k in keys:
            if k not in young:
                if k in old:
                    young[k] = old[k]
                else:
                    out.append(k)
        return out


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1.0, steps: int = 60) -> np.ndarray:
    """Weights of a ridge-penalised logistic regression by Newton steps; the last weight is the bias, unpenalised."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, c = np.zeros(x.shape[1]), np.ones(len(x)) if weight is None else weight
    pen = np.full(x.shape[1], ridge)
    pen[-1] = 1e-6
    for _ in range(steps):
        p = sigmoid(x @ w)
        h = (x * (c * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(pen)
        step = np.linalg.solve(h, x.T @ (c * (y - p)) - pen * w)
        w += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-7:
            break
    return w


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))

"""Target-distribution importance resampling: documents drawn as often as their n-grams look like those of a target.

One map over the texts hands each batch to DuckDB, whose SQL unnests words, windows them into n-grams and hashes every
distinct one with a registered zlib CRC function. What comes out, a document's counts by bucket, is spilled to Parquet;
texts are not read again. Spark merges the counts of both tables into one gain per bucket (a bounded vector), scores
documents from their spilled counts and ranks them by a range-partitioned sort of narrow rows, so no task holds all of
them.

Defined results: a null or empty text has no words and no features, weight 0 and no rank; a null id hashes as an empty
string and sorts after all others; repeated rows each count, score and rank on their own, rows that tie in score and id
in any order; an empty table gives no rows; of a target without features every gain is that of t = T = 0. Columns besides
the id and the text are carried only if named. Bytes that are no UTF-8 count as U+FFFD.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import duckdb
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorelake.llm.common import drop, free_name, scratch, ship, slices, texts

#: Words, lower case: runs of ASCII letters and digits and of all characters beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Bytes of text that DuckDB works on at a time, and the memory it may take for them.
SLICE_BYTES = 2 << 20
MEMORY = "1GB"


def bucket_sql(orders: tuple[int, int], buckets: int) -> str:
    """SQL over ``slice`` (i, text): i, n_words, n_features and the counts of the buckets of its n-grams."""
    grams = []
    for n in range(orders[0], orders[1] + 1):
        gram = "w" + "".join(f" || ' ' || lead(w, {k}) OVER o" for k in range(1, n))
        grams.append(f"SELECT i, {gram} AS gram FROM w" + (" WINDOW o AS (PARTITION BY i ORDER BY p)" if n > 1 else ""))
    return rf"""
    WITH t AS MATERIALIZED (SELECT i, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{WORD}') AS words FROM slice),
    w AS (SELECT i, unnest(words) AS w, generate_subscripts(words, 1) AS p FROM t),
    g AS ({" UNION ALL ".join(grams)}),
    c AS MATERIALIZED (SELECT i, gram, count(*) AS n FROM g WHERE gram IS NOT NULL GROUP BY i, gram),
    h AS (SELECT gram, (crc(gram) % {buckets})::INTEGER AS bucket FROM (SELECT DISTINCT gram FROM c)),
    b AS (SELECT i, bucket, sum(n)::INTEGER AS n FROM c JOIN h USING (gram) GROUP BY i, bucket),
    l AS (SELECT i, sum(n)::BIGINT AS n_features, list(bucket ORDER BY bucket) AS buckets, list(n ORDER BY bucket) AS counts FROM b GROUP BY i)
    SELECT i, len(words)::BIGINT AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(buckets, []) AS buckets, coalesce(counts, []) AS counts
    FROM t LEFT JOIN l USING (i) ORDER BY i"""


def _crc(grams: pa.ChunkedArray) -> pa.Array:
    return pa.array([zlib.crc32(g) for g in grams.cast(pa.binary()).to_pylist()], pa.uint32())


def _connection() -> duckdb.DuckDBPyConnection:
    """One thread, bounded memory and no files: a task's DuckDB lives in the worker alone."""
    con = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": ""})
    con.create_function("crc", _crc, ["VARCHAR"], "UINTEGER", type="arrow")
    return con


def counts_by_bucket(df: DataFrame, orders: tuple[int, int], buckets: int, columns: tuple[str, ...] = (), text: str = "text") -> DataFrame:
    """``columns``, n_words, n_features, buckets, counts: of each row its n-grams' counts by bucket."""
    ship(df.sparkSession)
    sql, most = bucket_sql(orders, buckets), SLICE_BYTES
    schema = T.StructType([df.select(c).schema[0] for c in columns])
    for name, kind in (("n_words", "bigint"), ("n_features", "bigint"), ("buckets", "array<int>"), ("counts", "array<int>")):
        schema = schema.add(name, T.DataType.fromDDL(kind))
    found = pa.schema([("n_words", pa.int64()), ("n_features", pa.int64()), ("buckets", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = _connection()
        for batch in batches:
            rows = [(t or b"").decode("utf-8", "replace") for t in texts(batch, own)]
            for start, end in slices([len(t) + 16 for t in rows], most):
                part = pa.table({"i": pa.array(range(start, end), pa.int64()), "text": pa.array(rows[start:end], pa.string())})
                con.register("slice", part)
                got = con.sql(sql).to_arrow_table().select(found.names).cast(found).combine_chunks()
                con.unregister("slice")
                kept = [batch.column(k).slice(start, end - start) for k in range(len(columns))]
                new = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in got.columns]
                yield pa.RecordBatch.from_arrays([*kept, *new], schema.names)
        con.close()

    own = free_name(df.select(*columns), text)
    return df.select(*columns, F.col(text).alias(own)).mapInArrow(run, schema)


def merged(counts: DataFrame, buckets: int) -> list[int]:
    """How many features of a table each bucket has: at most ``buckets`` rows come to the driver."""
    pairs = counts.select(F.explode(F.arrays_zip("buckets", "counts")).alias("x"))
    out = [0] * buckets
    for row in pairs.groupBy(F.col("x.buckets").alias("b")).agg(F.sum(F.col("x.counts").cast("bigint")).alias("n")).toLocalIterator():
        out[row.b] = row.n
    return out


def gains(raw: list[int], target: list[int]) -> list[int]:
    """Of each bucket the thousandths of a nat by which the target prefers it, both sides with one more each."""
    n, all_raw, all_target = float(len(raw)), float(sum(raw)), float(sum(target))
    return [math.floor(1000 * math.log((t + 1.0) * (all_raw + n) / ((s + 1.0) * (all_target + n)))) for s, t in zip(raw, target, strict=True)]


def scored(counts: DataFrame, gain: list[int], seed: str, doc_id: str = "doc_id") -> DataFrame:
    """``counts`` with weight, the floored mean gain of a document's features, and score, the weight with Gumbel noise
    from the hash of its id."""
    vector = F.lit(gain).cast("array<bigint>")
    total = F.aggregate(F.arrays_zip("buckets", "counts"), F.lit(0).cast("bigint"), lambda acc, x: acc + F.get(vector, x["buckets"]) * x["counts"])
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("bigint")
    noise = F.floor(F.lit(-1000) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    sums = counts.withColumn("_total", total)
    mean = F.expr("CASE WHEN n_features = 0 THEN 0L ELSE (_total - pmod(_total, n_features)) div n_features END")
    return sums.withColumn("weight", mean).withColumn("score", F.col("weight") + noise).drop("_total", "buckets", "counts")


def ranked(df: DataFrame, share: tuple[int, int], doc_id: str = "doc_id") -> DataFrame:
    """``df`` with rank: 1, 2, ... by score, ties to the smaller id, for the first share[0]/share[1] of its rows (rounded
    down), null for the rest. Ranges of the order are sorted apart, and a row's rank is its place plus the rows of the
    ranges before; only their sizes come to the driver, one number per partition."""
    spark = df.sparkSession
    order = [F.col("score").desc(), F.col(doc_id).asc_nulls_last()]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    placed = scratch(placed.withColumn("_place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "ranks")
    sizes = dict(placed.groupBy("_part").count().collect())
    before, total = [], 0
    for p in range(max(sizes, default=0) + 1):
        before.append(total)
        total += sizes.get(p, 0)
    rank = F.get(F.lit(before).cast("array<bigint>"), F.col("_part")) + F.col("_place") + 1
    return placed.withColumn("rank", F.when(rank <= total * share[0] // share[1], rank)).drop("_part", "_place")


def resample(
    documents: DataFrame, target: DataFrame, orders: tuple[int, int] = (1, 1), buckets: int = 10_000, share: tuple[int, int] = (10, 100), least_words: int = 20, seed: str = "2024", columns: tuple[str, ...] = ()
) -> DataFrame:
    """Every document: doc_id, ``columns`` (text, say), n_words, n_features, weight, score, rank. The drawn ones are those
    with a rank; the draw is one of share[0] in share[1] of the documents with at least ``least_words`` words."""
    counts = scratch(counts_by_bucket(documents, orders, buckets, ("doc_id", *columns)), "buckets")
    aim = scratch(counts_by_bucket(target, orders, buckets), "buckets")
    gain = gains(merged(counts, buckets), merged(aim, buckets))
    drop(aim)
    every = scratch(scored(counts, gain, seed), "scores")
    drop(counts)
    able = F.col("n_words") >= least_words
    return ranked(every.where(able), share).unionByName(every.where(~able).withColumn("rank", F.lit(None).cast("bigint")))

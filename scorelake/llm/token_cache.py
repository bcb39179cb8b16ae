"""Token counts from a digest cache.

A text is normalised, its digest (with the digest of the tokenizer file) is looked up in a stored table of counts,
each distinct text that the table lacks is encoded once, and its count is appended to the table. The normal form
replaces runs of ASCII white space by one space and trims it, which this kind of tokenizer drops anyway; it is the
caller's choice (``normalise=False`` digests the text as it is) and part of the digest.

Texts are shuffled once, after one row per digest has been picked within each input partition, so a group of copies
that holds a third of all rows reaches a task as one row per partition. Counts come back by a join on the digest.

Defined cases: a null text counts as an empty one (0 bytes, 0 tokens); repeated rows and null ids are kept as rows;
an empty table gives an empty result; other columns are left out. Two runs that append the same digest at the same
time leave two equal rows; reads take the counts per digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.llm.common import SPACE, Recent, column, scratch, ship, slices, texts

CACHE = "tokenizer string, digest binary, n_tokens bigint"
#: Words whose counts one Python worker remembers, and bytes of text it works on at once.
REMEMBERED, AT_ONCE = 300_000, 4 << 20

_workers: dict[str, tuple[object, Recent]] = {}


def file_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def _counter(path: str) -> tuple[object, Recent]:
    if path not in _workers:
        from tokenizers import Tokenizer

        _workers[path] = Tokenizer.from_file(path), Recent(REMEMBERED)
    return _workers[path]


def count_tokens(found: list[bytes], path: str) -> list[int]:
    """Tokens of each text without added special tokens. The tokenizer drops white space and never looks past it, so
    counts of the parts between ASCII white space add up to the text's; a worker remembers the parts it has seen."""
    tokenizer, known = _counter(path)
    out: list[int] = []
    for a, b in slices([len(t) for t in found], AT_ONCE):
        parts = [t.split() for t in found[a:b]]
        missing = known.missing(set(chain.from_iterable(parts)))
        encoded = tokenizer.encode_batch_fast([m.decode(errors="replace") for m in missing], add_special_tokens=False)
        known.young.update(zip(missing, map(len, encoded), strict=True))
        get = known.young.__getitem__
        out += [sum(map(get, p)) for p in parts]
    return out


def normalised(text: Column, on: bool = True) -> Column:
    text = F.coalesce(text.cast("string"), F.lit(""))
    return F.trim(F.regexp_replace(text, f"[{SPACE}]+", " ")) if on else text


def cached_counts(docs: DataFrame, tokenizer_path: str, cache_path: str, normalise: bool = True) -> DataFrame:
    """doc_id, n_bytes (of the text as it is, in UTF-8), n_tokens; counts that ``cache_path`` lacks are appended there.

    The encoding runs when this is called (it is a write); the returned rows are lazy."""
    spark = docs.sparkSession
    ship(spark)
    version = file_digest(tokenizer_path)
    content = normalised(F.col("text"), normalise)
    keyed = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("bigint").alias("n_bytes"),
        content.alias("content"),
        F.unhex(F.sha2(F.concat(F.lit(f"{version}:{normalise}:"), content).cast("binary"), 256)).alias("digest"),
    )
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(cache_path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        spark.createDataFrame([], CACHE).write.partitionBy("tokenizer").parquet(cache_path, mode="append")

    def stored() -> DataFrame:
        return spark.read.schema("digest binary, n_tokens bigint, tokenizer string").parquet(cache_path).where(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))

    misses = keyed.select("digest", "content").join(stored().select("digest"), "digest", "left_anti").groupBy("digest").agg(F.first("content").alias("content"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([column(batch, "digest"), pa.array(count_tokens(texts(batch, "content"), tokenizer_path), pa.int64())], ["digest", "n_tokens"])

    misses.mapInArrow(encode, "digest binary, n_tokens bigint").withColumn("tokenizer", F.lit(version)).write.partitionBy("tokenizer").parquet(cache_path, mode="append")
    # read from a plain written table, so that Spark can split the join where one digest has very many rows
    return keyed.select("doc_id", "n_bytes", "digest").join(scratch(stored(), "token-counts"), "digest").select("doc_id", "n_bytes", "n_tokens")

"""A training-corpus pipeline: quality classifier, quality rules, near duplicates, source mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a DataFrame, which is
written as Parquet and read again as the next one's docs. All but the last return the columns of documents.

No SQL twin: a trained classifier, the join's classes and the merges of BPE are beyond SQL; the tests hold the
last stage against the tokenizer library and run the others, whose operators have tests of their own. Rows without an id and tables without rows pass through every stage as the operators
define it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.llm import byte_bpe, chosen_path, cotraining, mixing, rule_ledger
from scorelake.llm.common import scratch, table

#: The columns of documents.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier takes for good."""
    model = cotraining.fit(docs, table(spark, sf_dir, "labels"), F.lit(True))
    return cotraining.score(docs, model).where(F.col("quality_score") >= 0.5).select(*docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule of the default policy rejects."""
    return rule_ledger.apply_policy(rule_ledger.add_ledger(docs), rule_ledger.DEFAULT).where("kept").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, the one with the least id; documents without an id stay."""
    return chosen_path.without_near_duplicates(docs, similarity=(4, 5), recall=0.9999).select(*docs.columns)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed(docs, weights=(5, 2, 1), most=3, budget=1.0)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids (little-endian unsigned 32-bit integers), decoded_sha256 (of the bytes that the ids
    decode to) of every row of the mix; ids that do not decode to the row's text fail the stage."""
    ids = byte_bpe.encode(docs.select("doc_id", "source", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, decoded="decoded_sha256", remembered=50_000)
    return ids.select("doc_id", "source", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), "ids", "decoded_sha256")


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources to target weights", source_mixing),
    ("byte-level BPE encoding and decoding", bpe_encoding),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs

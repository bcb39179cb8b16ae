"""Quality rules as a ledger: every rule is evaluated once, policies and ablations are bit operations on the result.

``build_ledger`` stores one row per document: the measurements and ``fail_bits``, in which bit i is set if rule i
failed. ``apply_policy`` masks the bits; a new policy version needs no second look at the texts. ``ablations``
counts, in one aggregation over the bits, what each rule of a policy rejects alone.

Defined cases: a null or empty text has no words and fails ``few_words`` (all measures 0); repeated rows and ties are
rows of their own; null ids are kept; an empty table gives an empty ledger; other columns of the input, whatever
their names, are left out. Texts of any length are read whole, one at a time.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.llm.common import append_columns, texts

#: Bytes that are not counted as code points of words: white space, and all but the first byte of a character.
_SPACE = b" \t\n\x0b\x0c\r"
_NOT_WORD_CHARS = _SPACE + bytes(range(0x80, 0xC0))
_SYMBOLS = b"#*$%&|<>"
WINDOW = 5

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")

#: (name, SQL condition on the measurements under which the rule fails). The position is the bit; append only.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 10"),
    ("repeat_words", "100 * n_repeat_words > 20 * n_words"),
    ("symbols", "100 * n_symbols > 20 * n_words"),
    ("dup_lines", "100 * n_dup_lines > 60 * n_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 14 * n_words"),
)
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    """A versioned choice of rules; a document that fails any of them is rejected."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BIT[r] for r in self.rules)


BASE = Policy("base-1", ("few_words", "repeat_words"))
DEFAULT = Policy("default-1", tuple(name for name, _ in RULES))
#: Every version that has been in force.
POLICIES = (BASE, DEFAULT)


def measure(text: bytes | None) -> tuple[int, ...]:
    """The measurements of one whole text, in the order of MEASURES."""
    if not text:
        return (0,) * len(MEASURES)
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    repeated = 0
    if len(words) >= WINDOW:
        windows = list(zip(*(words[i:] for i in range(WINDOW)), strict=False))
        if len(set(windows)) < len(windows):
            seen, end = Counter(windows), 0
            for i, w in enumerate(windows):
                if seen[w] > 1:
                    repeated += i + WINDOW - max(i, end)
                    end = i + WINDOW
    return (len(words), len(text.translate(None, _NOT_WORD_CHARS)), len(text) - len(text.translate(None, _SYMBOLS)), len(lines), len(lines) - len(set(lines)), repeated)


def _measured(batch: pa.RecordBatch) -> list[pa.Array]:
    cols = list(zip(*(measure(t) for t in texts(batch)), strict=True)) or [()] * len(MEASURES)
    return [pa.array(c, pa.int64()) for c in cols]


def fail_bits() -> Column:
    """The failed rules of a row of measurements as one number."""
    bits = F.lit(0).cast("bigint")
    for name, failed in RULES:
        bits = bits.bitwiseOR(F.when(F.expr(failed), F.lit(BIT[name])).otherwise(F.lit(0)).cast("bigint"))
    return bits


def add_ledger(docs: DataFrame) -> DataFrame:
    """All columns of the documents with the measurements and fail_bits. A map over the input, without a shuffle."""
    return append_columns(docs, _measured, [(m, "bigint") for m in MEASURES]).withColumn("fail_bits", fail_bits())


def build_ledger(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, the measurements and fail_bits."""
    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return add_ledger(narrow).drop("text")


def apply_policy(ledger: DataFrame, policy: Policy) -> DataFrame:
    """The ledger with the policy's verdict: ``kept`` and ``policy``."""
    return ledger.withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(policy.mask)) == 0).withColumn("policy", F.lit(policy.version))


def ablations(ledger: DataFrame, policy: Policy, *keys: str) -> DataFrame:
    """For each rule of the policy and each value of ``keys``: how many rows fail it, how many no other rule of the
    policy rejects (what dropping the rule would bring back), and which rules fail together with it (``with_bits``).
    Rows are first counted by their bits, of which there are at most 2 to the number of rules."""
    patterns = ledger.groupBy(*keys, F.col("fail_bits").bitwiseAND(F.lit(policy.mask)).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(BIT[r]).cast("bigint").alias("bit")) for r in policy.rules))).alias("r")
    failed = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    return (
        patterns.select("*", rules)
        .groupBy(*keys, F.col("r.rule").alias("rule"))
        .agg(
            F.coalesce(F.sum(F.when(failed, F.col("n"))), F.lit(0)).alias("n_failed"),
            F.coalesce(F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n"))), F.lit(0)).alias("n_only"),
            F.coalesce(F.bit_or(F.when(failed, F.col("bits"))), F.lit(0)).alias("with_bits"),
        )
    )

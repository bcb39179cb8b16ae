"""The queries of this subpackage: each operator with its production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.llm import byte_bpe, chosen_path, collocations, cotraining, importance, kd_search, language_mixture, mixing, pii, rule_ledger, token_cache, token_files, toxicity
from scorelake.llm.common import fold, scratch, scratch_path, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


_WORD = r"[^\x20\x09-\x0D]+"

OP4_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents),
m AS (
  SELECT k, doc_id, regexp_extract_all(text, '{_WORD}') AS words, text,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
w AS (SELECT k, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM m),
g AS (
  SELECT k, i, CASE WHEN lead(word, 4) OVER o IS NOT NULL THEN
    word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o || ' ' || lead(word, 3) OVER o || ' ' || lead(word, 4) OVER o END AS gram
  FROM w WINDOW o AS (PARTITION BY k ORDER BY i)),
r AS (SELECT k, i, CASE WHEN gram IS NOT NULL AND count(*) OVER (PARTITION BY k, gram) > 1 THEN 1 ELSE 0 END AS again FROM g),
c AS (SELECT k, max(again) OVER (PARTITION BY k ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS covered FROM r),
p AS (SELECT k, sum(covered) AS n_repeat_words FROM c GROUP BY k),
f AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM m LEFT JOIN p USING (k))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
  NOT ({" OR ".join(f"({cond})" for _, cond in rule_ledger.RULES)}) AS kept
FROM f
"""


@_query("op4_quality_rules", OP4_SQL)
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger is stored; both verdicts are read from its bits."""
    ledger = rule_ledger.apply_policy(scratch(rule_ledger.build_ledger(table(spark, sf_dir, "documents")), "ledger"), rule_ledger.DEFAULT)
    base_failed = F.col("fail_bits").bitwiseAND(F.lit(rule_ledger.BASE.mask)) != 0
    return ledger.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed.alias("base_failed"), "kept")


def _ablation_sql() -> str:
    parts = []
    for policy in rule_ledger.POLICIES:
        conditions = dict(rule_ledger.RULES)
        for rule in policy.rules:
            others = " OR ".join(f"({conditions[r]})" for r in policy.rules if r != rule) or "false"
            bits = " | ".join(f"(CASE WHEN {conditions[r]} THEN {rule_ledger.BIT[r]} ELSE 0 END)" for r in policy.rules)
            parts.append(
                f"SELECT '{policy.version}' AS policy, '{rule}' AS rule, count(*) FILTER (WHERE {conditions[rule]}) AS n_failed, "
                f"count(*) FILTER (WHERE ({conditions[rule]}) AND NOT ({others})) AS n_only, coalesce(bit_or(({bits})::BIGINT) FILTER (WHERE {conditions[rule]}), 0) AS with_bits FROM f"
            )
    return OP4_SQL[: OP4_SQL.rindex("SELECT doc_id, n_words")] + " UNION ALL ".join(parts)


@_query("ledger_ablations", _ablation_sql())
def ledger_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each policy version: what every rule rejects, alone and with others, from one stored ledger."""
    ledger = scratch(rule_ledger.build_ledger(table(spark, sf_dir, "documents")), "ledger")
    parts = [rule_ledger.ablations(ledger, policy).select(F.lit(policy.version).alias("policy"), "rule", "n_failed", "n_only", "with_bits") for policy in rule_ledger.POLICIES]
    return reduce(DataFrame.unionByName, parts)


@_query("op5_token_counts")
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache starts empty, so that every distinct text is encoded here."""
    counts = token_cache.cached_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), scratch_path(spark, "token-cache"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 2048)


OP6_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{_WORD}')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')), 1, 15))::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
         3.0::DOUBLE * source_size AS stop FROM s),
o AS (
  SELECT *, coalesce(sum(stop) OVER b, 0) AS used, sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS free,
         (sum(source_size) OVER ())::DOUBLE AS total
  FROM w WINDOW b AS (ORDER BY stop / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT max((total - used) / free) AS level FROM o),
t AS (SELECT source, source_size, CASE WHEN stop <= level * weight THEN stop ELSE level * weight END AS target FROM w, l),
u AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
c AS (SELECT d.*, source_size, target, whole, target - whole * source_size AS rest,
        sum(size) OVER (PARTITION BY d.source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto, sum(size) OVER (PARTITION BY d.source, h) AS edge
      FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source)
SELECT doc_id, size, source_size, target, (size * (whole + CASE WHEN upto <= rest OR (upto - edge <= rest AND edge < 2 * (rest - (upto - edge))) THEN 1 ELSE 0 END))::BIGINT AS taken FROM c
"""


@_query("op6_source_mixing", OP6_SQL)
def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), weights=(5, 2, 1), most=3, budget=1.0)


@_query("op9_token_files")
def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    token_files.write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return token_files.read(spark, path)


@_query("op10_byte_bpe")
def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@_query("op1_toxicity")
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = fold(F.col("doc_id"), 5) == 0
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~held_out)
    found = toxicity.score(docs, model).withColumn("held_out", held_out)
    return found.select("doc_id", "held_out", "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "n_toxic", "n_windows")


@_query("op2_language_mixture")
def op2_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = fold(F.col("doc_id"), 4) == 2
    docs = table(spark, sf_dir, "documents")
    profiles = language_mixture.fit(docs, ~held_out)
    return language_mixture.infer(docs, profiles).withColumn("held_out", held_out).select("doc_id", "held_out", "lang_pred", "score", "proportions")


@_query("op3_quality_cotraining")
def op3_quality_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fifth of the ids is held out of the training, for tests."""
    held_out = fold(F.col("doc_id"), 5) == 0
    docs = table(spark, sf_dir, "documents")
    model = cotraining.fit(docs, table(spark, sf_dir, "labels"), ~held_out)
    found = cotraining.score(docs, model).withColumn("held_out", held_out)
    return found.select("doc_id", "held_out", F.col("quality_score").alias("score"), F.when(F.col("quality_score") >= 0.5, 1).otherwise(0).alias("predicted"), "text_score", "meta_score")


OP8_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT a.vec_id AS query_id, a.q AS asked, b.vec_id AS vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM (SELECT DISTINCT * FROM v WHERE vec_id % 20 = 0) a JOIN v b ON a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, asked ORDER BY score DESC, vec_id)::INTEGER AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


@_query("op8_exact_top_k", OP8_SQL)
def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_search.top_k(table(spark, sf_dir, "embeddings"), F.pmod(F.col("vec_id"), F.lit(20)) == 0, k=20, scale=64.0)


@_query("op7_near_duplicates")
def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.near_duplicates(table(spark, sf_dir, "documents"), similarity=(4, 5), recall=0.9999)


#: crc32 in SQL: the table of the reflected polynomial, then a fold over the bytes of a word.
OP12_SQL = rf"""
WITH k AS (SELECT list(list_reduce(range(8), lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS t FROM range(256) r(i)),
d AS (SELECT row_number() OVER () AS i, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{importance.UPPER}', '{importance.LOWER}'), '{importance.WORD}') AS words FROM documents),
a AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), '{importance.UPPER}', '{importance.LOWER}'), '{importance.WORD}')) AS w FROM benchmark),
o AS (SELECT i, unnest(words) AS w FROM d),
u AS (SELECT w, list_transform(range(octet_length(encode(w))), lambda j: ('0x' || substr(hex(encode(w)), 2 * j + 1, 2))::BIGINT) AS bytes FROM (SELECT w FROM o UNION SELECT w FROM a)),
v AS (SELECT w, xor(list_reduce(bytes, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 10000 AS bucket FROM u, k),
x AS (SELECT bucket, count(*) AS s FROM o JOIN v USING (w) GROUP BY bucket),
y AS (SELECT bucket, count(*) AS t FROM a JOIN v USING (w) GROUP BY bucket),
g AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM o) + 10000)::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM a) + 10000)::DOUBLE)))::BIGINT AS gain
  FROM (SELECT DISTINCT bucket FROM v) LEFT JOIN x USING (bucket) LEFT JOIN y USING (bucket)),
f AS (SELECT i, count(*) AS n_features, sum(gain)::BIGINT AS total FROM o JOIN v USING (w) JOIN g USING (bucket) GROUP BY i),
h AS (SELECT i, doc_id, len(words) AS n_words, ('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM d),
m AS (
  SELECT doc_id, n_words, coalesce(n_features, 0)::BIGINT AS n_features,
    CASE WHEN n_features IS NULL THEN 0 ELSE (total - ((total % n_features) + n_features) % n_features) // n_features END::BIGINT AS weight, h
  FROM h LEFT JOIN f USING (i)),
e AS (SELECT doc_id, n_words, n_features, weight, (weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score FROM m),
r AS (SELECT doc_id, n_features, weight, score, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS rank, 10 * count(*) OVER () // 100 AS most FROM e WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= most THEN rank END::BIGINT AS rank FROM r
UNION ALL SELECT doc_id, n_features, weight, score, NULL::BIGINT AS rank FROM e WHERE n_words < 20
"""


@_query("op12_importance_resampling", OP12_SQL)
def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), orders=(1, 1), buckets=10_000, share=(10, 100), least_words=20, seed="2024")
    return found.select("doc_id", "n_features", "weight", "score", "rank")


_PHRASES = " UNION ALL ".join(
    f"SELECT lang, list_aggregate(w[i:i + {k - 1}], 'string_agg', ' ') AS phrase, {k} AS k FROM (SELECT lang, w, unnest(range(1, len(w) - {k - 2})) AS i FROM p WHERE len(w) >= {k})" for k in range(1, 5)
)

OP11_SQL = rf"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{importance.UPPER}', '{importance.LOWER}'), '[.,;:!?
-
]')) AS piece FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^ 	]+') AS w FROM d),
t AS (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang),
f AS MATERIALIZED (SELECT lang, phrase, k, count(*)::BIGINT AS f FROM ({_PHRASES}) GROUP BY lang, phrase, k HAVING count(*) >= 30),
c AS MATERIALIZED (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
s AS (
  SELECT lang, phrase FROM c SEMI JOIN (
    SELECT lang AS sl, unnest(list_concat(
      list_transform(range(1, k), lambda i: struct_pack(p := list_aggregate(w[i:i + 1], 'string_agg', ' '), f := a)),
      list_transform(CASE WHEN k > 3 THEN range(1, k - 1) ELSE [] END, lambda i: struct_pack(p := list_aggregate(w[i:i + 2], 'string_agg', ' '), f := a)))) AS x
    FROM c WHERE k > 2) g ON lang = sl AND phrase = x.p AND 100::HUGEINT * x.f >= 80::HUGEINT * a AND phrase <> '' ),
m AS (SELECT lang, phrase, k, a, w, unnest(range(1, k)) AS cut FROM c ANTI JOIN s USING (lang, phrase)),
v AS (SELECT m.*, list_aggregate(w[1:cut], 'string_agg', ' ') AS first, list_aggregate(w[cut + 1:k], 'string_agg', ' ') AS rest FROM m),
j AS (
  SELECT v.lang, v.phrase, a, cut, x.f AS l, y.f AS r, (2000000::HUGEINT * a // (x.f::HUGEINT + y.f))::BIGINT AS score
  FROM v JOIN f x ON x.lang = v.lang AND x.phrase = v.first JOIN f y ON y.lang = v.lang AND y.phrase = v.rest),
b AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b)
SELECT lang, rank, phrase, a, l, r, n, score FROM r JOIN t USING (lang) WHERE rank <= 2000
"""


@_query("op11_collocations", OP11_SQL)
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"), longest=4, least=30, scale=2_000_000, share=(80, 100), top=2_000)


@_query("op13_pii")
def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.find(docs, pii.fit(docs)).drop("text")

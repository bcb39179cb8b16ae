"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names, for every operator."""

import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from scorelake.llm import byte_bpe, chosen_path, cotraining, kd_search, language_mixture, mixing, queries, rule_ledger, token_cache, token_files, toxicity
from scorelake.llm.common import scratch_path

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, n_words string, size string, ids string, h string, digest string, key string, fail_bits string"
LONG = " ".join(f"word{i % 997}x{i}" for i in range(30_000))
SAME = "the same five words and then some more of them to make a text long enough for rules"
ROWS = [
    (1, SAME, "en", "a"),
    (1, SAME, "en", "a"),
    (2, SAME, "en", "a"),
    (3, None, None, None),
    (4, "", "en", "b"),
    (5, " \t\n ", "de", "b"),
    (6, LONG, "en", "c"),
    (None, "a text without an id", "en", None),
    (7, "Größe über Straße, naïve café — 日本語のテキスト 12345 <|endoftext|> don't", "de", "c"),
    (8, "x" * 5_000, None, "c"),
    (9, "a b c", "fr", "c"),
    (10, "two  spaces and\n\nlines \u00a0 nbsp\u2003em ", "fr", "c"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, la, s, None if t is None else len(t), "x", "y", "z", "q", "w", "e", "r", "t") for i, t, la, s in ROWS]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, 0), (6, 0, 1), (8, 0, 1), (None, 1, None), (9, None, 1), (77, 1, 1)], "doc_id bigint, quality int, toxic int")


def table(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


def test_rules(docs, empty):
    out = rule_ledger.apply_policy(rule_ledger.build_ledger(docs), rule_ledger.DEFAULT).collect()
    assert len(out) == len(ROWS)
    by = {r.doc_id: r for r in out}
    assert by[3].n_words == by[4].n_words == by[5].n_words == 0 and not by[3].kept
    assert by[6].n_words == 30_000 and by[6].n_repeat_words == 0 and by[6].kept
    assert by[10].word_chars == len("".join(ROWS[-1][1].split(" ")).replace("\n", ""))
    assert rule_ledger.build_ledger(empty).count() == 0
    assert set(rule_ledger.add_ledger(docs).columns) == {*docs.columns, *rule_ledger.MEASURES, "fail_bits"}


def test_repeated_windows():
    w = [b"a", b"b", b"c", b"d", b"e"]
    assert rule_ledger.measure(b" ".join(w + [b"x"] + w))[5] == 10
    assert rule_ledger.measure(b" ".join([b"z"] * 7))[5] == 7
    assert rule_ledger.measure(b"a b\nq\na b\n\n\na b")[4] == 2


def test_ablations(docs):
    ledger = rule_ledger.build_ledger(docs)
    rows = {r["rule"]: r for r in rule_ledger.ablations(ledger, rule_ledger.DEFAULT).collect()}
    bits = [r.fail_bits for r in ledger.collect()]
    for rule in rule_ledger.DEFAULT.rules:
        bit = rule_ledger.BIT[rule]
        assert rows[rule]["n_failed"] == sum(bool(b & bit) for b in bits)
        assert rows[rule]["n_only"] == sum(b == bit for b in bits)


def test_token_cache(spark, docs, empty):
    from tokenizers import Tokenizer

    path, cache = P.path("word_bpe_49k.json"), scratch_path(spark, "cache-test")
    t = Tokenizer.from_file(path)
    want = sorted(((i, len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for i, x, _, _ in ROWS), key=str)
    assert table(token_cache.cached_counts(docs, path, cache), "doc_id", "n_bytes", "n_tokens") == want
    stored = spark.read.parquet(cache).count()
    assert table(token_cache.cached_counts(docs, path, cache), "doc_id", "n_bytes", "n_tokens") == want  # all hits now
    assert spark.read.parquet(cache).count() == stored == len({" ".join((x or "").split(" ")).strip() if x != ROWS[5][1] else "" for _, x, _, _ in ROWS})
    assert token_cache.cached_counts(empty, path, cache).count() == 0


def test_mixing(docs, empty):
    out = mixing.mix(docs).collect()
    assert len(out) == len(ROWS) and mixing.mix(empty).count() == 0
    total = sum(r["size"] for r in out)
    assert abs(sum({(r.source_size, r.target) for r in out} and [t for _, t in {(r.source_size, r.target) for r in out}]) - total) < 1e-6 * max(1, total)
    assert all(r.taken <= 3 * r["size"] for r in out)
    clash = docs.withColumn("_times", F.lit("own")).withColumn("_copy", F.lit(1))
    again = mixing.mixed(clash)
    assert again.columns == clash.columns and {r["_times"] for r in again.collect()} == {"own"} and again.count() == mixing.mixed(docs).count()


def test_nested_thresholds(spark):
    rows = mixing.sized(spark.range(400).selectExpr("id AS doc_id", "'a b c' AS text", "CASE WHEN id % 3 = 0 THEN NULL ELSE 's' END AS source"))
    budgets = spark.createDataFrame([("s", k, 100.0 * k) for k in range(9)] + [(None, 1, 50.0)], "source string, budget_id int, rest double")
    found = {(r["source"], r.budget_id): r.threshold for r in mixing.thresholds(rows, budgets).collect()}
    data = rows.collect()
    for (source, k), end in found.items():
        own = sorted((r.h, r["size"]) for r in data if r["source"] == source)
        rest, taken = (100.0 * k if source else 50.0), sum(n for h, n in own if h < end)
        assert abs(taken - rest) <= 1.5 or taken == sum(n for _, n in own) < rest  # the nearer of two sums, a document apart
    ends = [found["s", k] for k in range(9)]
    assert ends == sorted(ends)


def test_byte_bpe(docs, empty):
    import tiktoken

    ranks = byte_bpe.load_ranks(P.path("byte_bpe_50k.tiktoken"))
    t = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = sorted(((i, len(x), sha(np.array(x, "<u4").tobytes()), sha((s or "").encode())) for i, s, _, _ in ROWS for x in [t.encode_ordinary(s or "")]), key=str)
    out = byte_bpe.round_trip(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    assert table(out, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want
    assert byte_bpe.round_trip(empty, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


def test_very_long_pre_token():
    import tiktoken

    ranks = byte_bpe.load_ranks(P.path("byte_bpe_50k.tiktoken"))
    bpe = byte_bpe.RankBPE(ranks, P.PATTERN)
    t = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = np.random.default_rng(3)
    for text in ("a" * 20_000, "".join(rng.choice(list("abcdeft"), 30_000)), "ab" * 9_999):
        assert bpe.merge(text.encode()) == t.encode_ordinary(text)


def test_token_files(spark, docs, empty):
    from tokenizers import Tokenizer

    t, path = Tokenizer.from_file(P.path("byte_bpe_50k.json")), scratch_path(spark, "files-test")
    token_files.write(docs, path, P.path("byte_bpe_50k.json"), 2)
    found = sorted((tuple(r) for r in token_files.read(spark, path, with_ids=True).collect()), key=lambda r: r[1])
    assert [r[0] for r in found] == sorted([i for i, *_ in ROWS], key=lambda i: -1 if i is None else i)
    ids = {(i, x): np.array(t.encode(x or "", add_special_tokens=False).ids + [2], "<u4").tobytes() for i, x, _, _ in ROWS}
    at = 0
    for doc_id, start, n, crc, raw in found:
        assert start == at and bytes(raw) in [v for (i, _), v in ids.items() if i == doc_id] and crc == zlib.crc32(raw) and n == len(raw) // 4
        at += n
    path = scratch_path(spark, "files-test")
    token_files.write(empty, path, P.path("byte_bpe_50k.json"), 2)
    assert token_files.read(spark, path).count() == 0


def test_near_duplicates(docs, empty):
    found = {(r.doc_id, r.class_id, r.n_links) for r in chosen_path.near_duplicates(docs).collect()}
    assert {(1, 1, 2), (2, 1, 2), (3, 3, 0), (4, 4, 0), (5, 5, 0), (6, 6, 0), (None, None, 0)} <= found
    assert chosen_path.near_duplicates(docs).count() == len(ROWS)
    assert chosen_path.near_duplicates(empty).count() == 0


def test_search(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 6))
    rows = [(i, [float(v) for v in x[i]], "clash") for i in range(300)]
    rows += [(300, None, ""), (301, [None] * 6, ""), (302, [float("nan")] * 6, ""), (303, [float("inf")] * 6, ""), (None, [1.0] * 6, ""), (305, rows[7][1], ""), (20, rows[20][1], "again"), (306, [0.5] * 3, ""), (307, [], "")]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, score string")
    asked = F.pmod(F.col("vec_id"), F.lit(20)) == 0
    q = {i: np.floor(64 * np.array(v)) for i, v, _ in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()}
    q = {i: np.pad(v, (0, 6 - len(v))) for i, v in q.items()}
    want = set()
    for i in [i for i in q if i % 20 == 0]:
        best = sorted(((-int(q[i] @ v), j) for j, v in q.items() if j != i))[:20]
        want |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(best)}
    assert {tuple(r) for r in kd_search.top_k(df, asked, 20).collect()} == want
    assert kd_search.top_k(df.limit(0), asked, 20).count() == 0
    few = df.where("vec_id < 4")
    assert kd_search.top_k(few, asked, 20).count() == 3


def test_search_over_many_shards(spark, monkeypatch):
    monkeypatch.setattr(kd_search, "SHARD", 40)
    monkeypatch.setattr(kd_search, "SHARDS_PER_TASK", 2)
    monkeypatch.setattr(kd_search, "LEAF", 8)
    rng = np.random.default_rng(1)
    x = rng.integers(-2, 3, size=(600, 3)).astype(float)
    df = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(600)], "vec_id bigint, embedding array<double>")
    q = np.floor(64 * x)
    want = set()
    for i in range(0, 600, 20):
        best = sorted((-int(q[i] @ q[j]), j) for j in range(600) if j != i)[:5]
        want |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(best)}
    assert {tuple(r) for r in kd_search.top_k(df, F.col("vec_id") % 20 == 0, 5).collect()} == want


def test_trained_operators(docs, empty, labels):
    for source in (docs, empty):
        n = source.count()
        tox = toxicity.score(source, toxicity.fit(docs, labels, F.lit(True)))
        assert tox.count() == n and all(0 <= r.score <= 1 for r in tox.collect())
        lang = language_mixture.infer(source, language_mixture.fit(docs, F.lit(True)))
        assert lang.count() == n
        good = cotraining.score(source, cotraining.fit(docs, labels, F.lit(True)))
        assert good.count() == n and set(docs.columns) < set(good.columns)
    found = {r.doc_id: r.lang_pred for r in language_mixture.infer(docs, language_mixture.fit(docs, F.lit(True))).collect()}
    assert found[3] == found[4] == found[5] == "und" and found[1] in ("de", "en", "fr")
    for none in (empty, docs.where("lang is null")):
        assert {r.lang_pred for r in language_mixture.infer(docs, language_mixture.fit(none, F.lit(True))).collect()} == {"und"}
    assert {r.score for r in toxicity.score(docs, toxicity.fit(docs, labels.limit(0), F.lit(True))).collect()} == {toxicity.score(docs.limit(1), toxicity.learn([], [], {})).first().score}
    assert {r.quality_score for r in cotraining.score(docs, cotraining.fit(docs, labels.limit(0), F.lit(True))).collect()} == {1.0}


def test_pipeline_stages(spark, docs, empty, labels, tmp_path):
    folder = str(tmp_path / "t")
    labels.write.parquet(f"{folder}/labels.parquet")
    for source in (docs, empty):
        rows = source
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            rows = stage(spark, rows, folder)
            if k < len(corpus_pipeline.STAGES) - 1:
                assert rows.columns == docs.columns, name
            rows.count()


def test_last_stage_decodes(spark, docs, monkeypatch):
    """Ids and digests of the last stage against the tokenizer library, and a failure where ids decode to another text."""
    import tiktoken

    t = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.load_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = sorted(((i, len(x), np.array(x, "<u4").tobytes(), hashlib.sha256((s or "").encode()).hexdigest()) for i, s, _, _ in ROWS for x in [t.encode_ordinary(s or "")]), key=str)
    found = [(r.doc_id, r.n_tokens, bytes(r.ids), r.decoded_sha256) for r in corpus_pipeline.bpe_encoding(spark, docs, "").collect()]
    assert sorted(found, key=str) == want

    class Wrong:
        decode = staticmethod(lambda ids: b"another text")

    batch = docs.where("doc_id = 2").select("text").toArrow().to_batches()[0]
    monkeypatch.setattr(byte_bpe, "coder", lambda *a: (Wrong, lambda found: [b"" for _ in found]))
    held = []
    monkeypatch.setattr(byte_bpe, "append_columns", lambda df, make, fields: held.append(make))
    byte_bpe.encode(docs, "", "", decoded="decoded")
    with pytest.raises(ValueError):
        held[0](batch)


def test_every_operator_has_a_query():
    assert {q.split("_")[0] for q in queries.QUERIES if q != "ledger_ablations"} == {f"op{n}" for n in range(1, 14)}
    assert set(queries.ORACLES) <= set(queries.QUERIES)

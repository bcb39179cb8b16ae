"""Collocations, importance resampling and personal data against brute force, with edge cases."""

import collections
import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from scorelake.llm import collocations, importance, pii
from scorelake.llm import queries as llm

SF = "/root/testdata/sf0.001"


def table(spark, rows):
    """Documents with repeated rows, nulls, empty and long texts, and columns whose names clash with results."""
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, n bigint, rank bigint, score double, gram string, spans string")


def row(doc_id, text, lang="en"):
    return (doc_id, text, lang, 1, 2, 3.0, "g", "s")


# --- collocations ---------------------------------------------------------------------------------------------------


def pieces(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", low)]


def brute_phrases(rows, longest):
    n, f = collections.Counter(), collections.Counter()
    for _, text, lang, *_ in rows:
        for words in pieces(text):
            n[lang or "und"] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang or "und", tuple(words[i : i + k])] += 1
    return n, f


def brute_collocations(rows, longest, least, top):
    n, f = brute_phrases(rows, longest)
    c = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    out = collections.defaultdict(list)
    for (lang, w), a in c.items():
        inside = [b for (m, v), b in c.items() if m == lang and len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v) - len(w) + 1))]
        if any(100 * b >= 80 * a for b in inside):
            continue
        score, k = min((2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w)))
        out[lang].append((-score, -a, " ".join(w).encode(), a, f[lang, w[:k]], f[lang, w[k:]], n[lang], score))
    return sorted((lang, r, x[2].decode(), *x[3:]) for lang, found in out.items() for r, x in enumerate(sorted(found)[:top], 1))


def phrase_rows(seed, n=120):
    draw = random.Random(seed)
    words = ["a", "b", "É", "dd", "the", "The", "x\x1cy", " ", "日本"]
    rows = []
    for i in range(n):
        text = "".join(draw.choice(words) + draw.choice([" "] * 8 + ["  ", "\t", ". ", ",", "\n", "\x0b", "?!"]) for _ in range(draw.randrange(60)))
        rows.append(row(i, text, draw.choice(["en", "en", "fr", None, "und"])))
    return [*rows, *rows[:9], row(None, None), row(500, ""), row(501, "w" * 70_000 + " a b a b"), row(502, " ".join(["a b"] * 4_000), "fr")]


@pytest.mark.parametrize("shard", [200, 1 << 24])
def test_collocations_equal_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(collocations, "SHARD_BYTES", shard)
    rows = phrase_rows(7)
    got = collocations.collocations(table(spark, rows), longest=4, least=12, top=40)
    assert sorted(tuple(r) for r in got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()) == brute_collocations(rows, 4, 12, 40)
    assert [t for _, t in got.dtypes] == ["string", "bigint", "string", "bigint", "bigint", "bigint", "bigint", "bigint"]


def test_a_full_pair_filter_loses_nothing(spark):
    rows = phrase_rows(8)
    counts = collocations.frequent_phrases(table(spark, rows), 4, 12, n_bits=64)
    n, f = brute_phrases(rows, 4)
    want = {(lang, " ".join(w)): a for (lang, w), a in f.items() if a >= 12} | {(lang, ""): a for lang, a in n.items() if a}
    assert {(r.lang, r.phrase): r.n for r in counts.collect()} == want


@pytest.mark.parametrize("seed", range(6))
def test_states_of_the_automaton(seed):
    draw = np.random.default_rng(seed)
    ids = draw.integers(0, 4, 300)
    joined = draw.random(300) < 0.8
    for depth in (1, 2, 3, 4):
        automaton = collocations.Automaton(ids, depth, joined)
        want, ends = collections.Counter(), collections.defaultdict(set)
        for i in range(300):
            for k in range(1, depth + 1):
                part = ids[i - k + 1 : i + 1]
                if i - k + 1 >= 0 and part.all() and joined[i - k + 2 : i + 1].all():
                    want[tuple(part)] += 1
                    ends[tuple(part)].add(i)
        got = {tuple(ids[e - k + 1 : e + 1]): n for k, end, count in automaton.phrases(1) for e, n in zip(end, count, strict=True)}
        assert got == want
        for e, n, longest, shortest in zip(automaton.end, automaton.count, automaton.longest, automaton.shortest, strict=True):
            state = tuple(ids[e - longest + 1 : e + 1])
            assert n == len(ends[state]) and all(ends[state[len(state) - k :]] == ends[state] for k in range(shortest, longest + 1))
            assert shortest == 1 or len(ends[state[len(state) - shortest + 1 :]]) > n  # the suffix link


def test_stretches_cut_before_white_space():
    text = b"ab cd\tef\ngh " * 50 + b"x" * 300
    parts = list(collocations.stretches(text, 20))
    assert b"".join(parts) == text and all(p[:1] in b" \t\n" for p in parts[1:]) and len(parts) > 20


def test_scores_pass_64_bits(spark):
    counts = spark.createDataFrame([("en", "", 9 * 10**18), ("en", "a", 8 * 10**18), ("en", "b", 7 * 10**18), ("en", "a b", 6 * 10**18)], "lang string, phrase string, n bigint")
    held, collocations.frequent_phrases = collocations.frequent_phrases, lambda *a, **k: counts
    try:
        got = collocations.collocations(None).collect()
    finally:
        collocations.frequent_phrases = held
    assert [r.score for r in got] == [2_000_000 * 6 * 10**18 // (15 * 10**18)]


# --- importance resampling ------------------------------------------------------------------------------------------


def brute_importance(rows, target, orders, buckets, share, least, seed):
    def grams(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) % buckets for n in range(orders[0], orders[1] + 1) for i in range(len(words) - n + 1)]

    s, t = (collections.Counter(b for x in side for b in grams(x)[1]) for side in ([r[1] for r in rows], target))
    size_s, size_t = sum(s.values()), sum(t.values())
    out = []
    for doc_id, text, *_ in rows:
        words, found = grams(text)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (size_s + buckets) / ((s[b] + 1) * (size_t + buckets)))) for b in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, words])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: share[0] * len(able) // share[1]], 1):
        r[4] = k
    return sorted((tuple(r[:5]) for r in out), key=str)


@pytest.mark.parametrize("orders", [(1, 1), (1, 3)])
def test_importance_equals_brute_force(spark, monkeypatch, orders):
    monkeypatch.setattr(importance, "SLICE_BYTES", 300)
    draw = random.Random(3)
    words = ["the", "Of", "één", "日本", "x1", "a\x00b", "and"]
    rows = [row(i, draw.choice([" ", "-", "\n"]).join(draw.choice(words) for _ in range(draw.randrange(40)))) for i in range(80)]
    rows += [*rows[:7], row(None, None), row(90, ""), row(91, "the " * 9_000)]
    target = ["the of the x1", None, "日本 and the"]
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    got = importance.resample(table(spark, rows), aim, orders, 64, (20, 100), 5, "7")
    found = sorted((tuple(r) for r in got.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)
    assert found == brute_importance(rows, target, orders, 64, (20, 100), 5, "7")


def test_importance_carries_columns_and_takes_empty_tables(spark):
    rows = table(spark, [row(i, "a b c d e") for i in range(10)])
    aim = rows.select("text").limit(0)
    drawn = importance.resample(rows, aim, share=(1, 2), least_words=5, columns=("text",)).where("rank is not null")
    assert [r.text for r in drawn.collect()] == ["a b c d e"] * 5
    assert importance.resample(rows.limit(0), aim).count() == 0


# --- personal data --------------------------------------------------------------------------------------------------

PLAIN = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def plain_base(text):
    out = []
    for kind, pattern in enumerate(PLAIN):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            total = sum(int(d) if i % 2 == 0 else (2 * int(d) if int(d) < 5 else 2 * int(d) - 9) for i, d in enumerate(reversed(digits)))
            if (True, all(int(p) <= 255 for p in m.group().split(".")) if kind == 1 else False, 14 <= len(digits) <= 19 and total % 10 == 0, 10 <= len(digits) <= 15)[kind]:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_base_spans_equal_the_plain_patterns():
    draw = random.Random(5)
    parts = ["a", "@", ".", "b-c", "é", " ", "1", "25", "300", "+", "-", "(", ")", "4111111111111111", "4111 1111 1111 1111", "x@y.z", "10.0.0.1", "+1 (017) 555-7713", "００"]
    for _ in range(4_000):
        text = "".join(draw.choice(parts) for _ in range(draw.randrange(25)))
        assert pii.base_spans(text)[0] == plain_base(text), text


@pytest.fixture(scope="module")
def model(spark):
    draw = random.Random(11)

    def card():
        d = "".join(str(draw.randrange(10)) for _ in range(15))
        return next(d + c for c in "0123456789" if pii.luhn(d + c))

    def one(i):
        d = lambda n: draw.randrange(n)
        return f"some words {d(99)} then {['an address me.%d@mail%d.example.com' % (i, d(9)), '%d.%d.%d.%d' % (d(256), d(256), d(256), d(256)), card(), '+1 (%03d) 555-%04d' % (d(1000), d(10000))][i % 4]} and more in {d(3000)}"

    return pii.fit(table(spark, [row(i, one(i)) for i in range(400)]), sample=400)


def test_what_the_formats_miss_is_added(model):
    def added(text):
        return [text[s:e] for s, _, e in pii.added_spans(text, pii.base_spans(text)[0], model)]

    assert model is not None
    assert added("see 4111111111111111 5500005555555559 here") == ["4111111111111111", "5500005555555559"]
    assert added("call +1 (017) 555-7713 4111111111111111 now") == ["+1 (017) 555-7713", "4111111111111111"]
    assert added("write to jane.doe (at) mail.example.com today") == ["jane.doe (at) mail.example.com"]
    for clean in ("on 2024-05-17 we met", "pages 12 34 56 78 90 12", "it took 3.14159265358979 s", "", "meet you at home. Then go", "4111111111111112"):
        assert added(clean) == []


def test_spans_of_a_table(spark, model):
    long = "x" * 60_000 + "@" + "1" * 60_000 + " +" + "1 " * 20_000
    rows = [row(1, "a@b.cd 10.0.0.1"), row(1, "a@b.cd 10.0.0.1"), row(2, None), row(3, ""), row(None, "é 4111 1111 1111 1111"), row(4, long)]
    got = pii.find(table(spark, rows).drop("spans"), model).collect()
    assert [(r.n_email, r.n_ip, r.n_card, r.n_phone) for r in got] == [(1, 1, 0, 0)] * 2 + [(0,) * 4] * 2 + [(0, 0, 1, 0), (0, 0, 0, 0)]
    assert got[0].spans == "email:0:6,ip:7:15" and got[4].spans == "card:2:21" and got[2].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[0].base_sha256 == hashlib.sha256(b"email:0:6,ip:7:15").hexdigest()
    assert pii.redact(table(spark, rows), model).collect()[0].redacted == "<email> <ip>"


def test_tables_without_spans_give_no_model(spark):
    assert pii.fit(table(spark, [row(1, "no digits"), row(2, None)])) is None
    assert pii.find(table(spark, []).select("doc_id", "text"), None).count() == 0


def test_boosting_learns_an_interaction():
    draw = np.random.default_rng(0)
    x = draw.random((3_000, 5))
    y = ((x[:, 0] > 0.5) ^ (x[:, 3] > 0.3)).astype(float)
    m = pii.boost(x[:2_000], y[:2_000], trees=30)
    assert ((m.margin(x[2_000:]) > 0) == (y[2_000:] > 0.5)).mean() > 0.97


@pytest.mark.parametrize("name", ["op11_collocations", "op12_importance_resampling"])
def test_twins(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(llm.ORACLES[name])
    got = llm.QUERIES[name](spark, SF)
    assert sorted((tuple(r) for r in got.select(*want.columns).collect()), key=str) == sorted(want.fetchall(), key=str)
    assert got.agg(F.count("*")).first()[0] > 0

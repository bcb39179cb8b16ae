"""Dealt bars against a plain loop."""

import math
import random

from pyspark.sql import functions as F

from scorelake.functions.apportion import dealt_bars


def plain(total, weights):
    if not weights:
        return []
    if sum(max(0, w) for w in weights) <= 0:
        weights = [1.0] * len(weights)
    whole = sum(max(0, w) for w in weights)
    mean, k = whole / len(weights), len(weights)
    if max(abs(w - mean) for w in weights) <= mean * 0.08:
        counts, rest = [total // k] * k, total % k
        for i in [k - 1, *range(1, k - 1)][:rest]:
            counts[i] += 1
        return counts
    ends = [math.floor(total * sum(max(0.0, w) for w in weights[: i + 1]) / whole) for i in range(k)]
    ends[-1] = total
    counts = [b - a for a, b in zip([0, *ends], ends)]
    if total >= k:
        for i in range(k):
            if counts[i] <= 0 and max(counts) > 1:
                counts[counts.index(max(counts))] -= 1
                counts[i] += 1
    return counts


def test_bars_equal_a_plain_loop(spark):
    draw = random.Random(9)
    rows = []
    for i in range(400):
        k = draw.randrange(0, 9)
        kind = draw.randrange(4)
        weights = [[float(draw.randrange(-3, 12)) for _ in range(k)], [100.0 + draw.randrange(5) for _ in range(k)], [draw.choice([0.0, -1.0]) for _ in range(k)], [draw.choice([0.0, 1.0, 60.0]) for _ in range(k)]][kind]
        rows.append((i, draw.randrange(0, 40), weights))
    got = spark.createDataFrame(rows, "i int, total int, weights array<double>").select("i", dealt_bars(F.col("total"), F.col("weights")).alias("bars"))
    want = {i: plain(t, w) for i, t, w in rows}
    found = {r.i: r.bars for r in got.collect()}
    assert found == want
    assert all(sum(b) == t for (i, t, w), b in zip(rows, (found[r[0]] for r in rows), strict=True) if w)


def test_systems_of_scanned_layouts_equal_a_plain_loop(spark):
    from scorelake.operators import reconcile

    draw = random.Random(4)
    systems, midi = [], []
    for piece in range(60):
        source = draw.choice(["recognised", "model"])
        wide = draw.choice([0.0, 0.8])
        for page in range(draw.randrange(1, 4)):
            systems += [(piece, source, page, s, page % 3 or None, round(wide or draw.uniform(0, 1.2), 3), draw.randrange(0, 9)) for s in range(draw.randrange(1, 6))]
        midi.append((piece, draw.choice([None, 0, draw.randrange(1, 60)]), draw.choice([None, 1, 2, 9])))
    a = spark.createDataFrame(systems, "piece int, source string, page int, system int, movement int, width double, bars int")
    b = spark.createDataFrame(midi, "piece int, total int, hint int")
    found = reconcile.reconciled(a, b)
    got = {(r.piece, r.page, r.system): r.bars for r in found.collect()}
    for piece, total, hint in midi:
        own = sorted((r for r in systems if r[0] == piece), key=lambda r: r[2:4])
        fit = own if total and abs(sum(r[6] for r in own) - total) > 1 else []
        if own[0][1] == "recognised":
            counts = {}
            for r in own:
                if r[4] is not None:
                    counts[r[4]] = counts.get(r[4], 0) + r[6]
            played = hint if hint in counts else min(counts, key=lambda m: (abs(counts[m] - (total or 0)), m), default=None)
            fit = [r for r in own if r[4] == played] if total and played is not None else []
        new = {}
        if fit:
            w, c = [r[5] if 0.05 <= r[5] <= 1.05 else 0.0 for r in fit], [max(2.0, min(6.0, float(r[6]))) for r in fit]
            there = [x for x in w if x > 0]
            alike = there and max(there) - min(there) <= sum(there) / len(there) * 0.08
            weight = w if alike else c if sum(w) <= 0 else [0.5 * x / sum(w) + 0.5 * y / sum(c) for x, y in zip(w, c, strict=True)]
            new = {r[2:4]: n for r, n in zip(fit, plain(total, weight), strict=True)}
        for r in own:
            assert got[piece, r[2], r[3]] == new.get(r[2:4], r[6]), (piece, total, hint)
    assert {r.redistributed for r in reconcile.summary(found).collect()} == {True, False}

import os
import numpy as np
import pandas as pd
import pytest

from scorelake.operators.alignment import AlignConfig, _align, align, align_session

C = AlignConfig()


def perf(*notes):
    return pd.DataFrame([(1, i, float(t), p) for i, (p, t) in enumerate(notes)], columns=["session_id", "state_idx", "t", "pitch"]).astype({"pitch": "Float64"})


def score(*notes):
    return pd.DataFrame([(1, float(t), p, m) for p, t, m in notes], columns=["session_id", "score_time_sec", "midi_pitch", "measure"])


FOUR = score((60, 0, 1), (62, 1, 1), (64, 2, 1), (65, 3, 1))


def test_identity():
    out = align_session(perf((60, 0), (62, 1), (64, 2), (65, 3)), FOUR)
    assert out["matched"].all() and out["score_midi_pitch"].tolist() == [60, 62, 64, 65] and (out["timing_offset_ms"] == 0).all()


def test_extra_note():
    out = align_session(perf((60, 0), (72, 0.5), (62, 1), (64, 2)), FOUR)
    assert out["matched"].tolist() == [True, False, True, True] and pd.isna(out["measure"].iloc[1])


def test_missing_note():
    out = align_session(perf((60, 0), (64, 2), (65, 3)), FOUR)
    assert out["score_midi_pitch"].tolist() == [60, 64, 65]


def test_semitone_and_no_pitch():
    assert align_session(perf((61, 0), (62, 1), (63, 2)), FOUR.iloc[:3])["matched"].all()
    out = align_session(perf((None, 0)), FOUR)
    assert len(out) == 1 and not out["matched"].iloc[0] and out["state_idx"].iloc[0] == 0


def test_empty_sides():
    assert len(align_session(perf(), FOUR)) == 0
    assert not align_session(perf((60, 0)), FOUR.iloc[:0])["matched"].any()


def test_repeated_motif_keeps_its_order():
    s = score(*[(p, i * 0.5, 1 + i // 3) for i, p in enumerate([60, 62, 64] * 2)])
    out = align_session(perf(*[(p, i * 1.0) for i, p in enumerate([60, 62, 64] * 2)]), s)
    assert out["measure"].tolist() == [1, 1, 1, 2, 2, 2]


def test_wildcards_match_without_a_pitch():
    s = score((60, 0, 1), (62, 2, 2), (-1, 4, 3), (-1, 4.5, 3), (-1, 5, 3), (-1, 5.5, 3), (64, 6, 4), (65, 8, 5))
    out = align_session(perf((60, 0), (62, 2), (67, 4), (67, 4.5), (67, 5), (67, 5.5), (64, 6), (65, 8)), s)
    assert out["matched"].all() and out["score_midi_pitch"].isna().sum() == 4 and out["matched_to_wildcard"].sum() == 4


def best_total(t, pitch, s, notes, ratio, offset):
    """The full programme over all cells that the band allows, cell by cell."""
    n, m = len(t), len(s)
    dp = np.full((n + 1, m + 1), -1e15)
    dp[0] = C.score_gap * np.arange(m + 1)
    dp[:, 0] = C.perf_gap * np.arange(n + 1)
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            if abs(s[j - 1] - (t[i - 1] - offset) / ratio) > C.band:
                continue
            gap = abs(notes[j - 1] - pitch[i - 1])
            gain = C.wildcard if notes[j - 1] == -1 else C.same if gap == 0 else C.semitone if gap == 1 else C.other
            gain -= C.per_second * min(abs(s[j - 1] * ratio + offset - t[i - 1]), C.most_seconds)
            dp[i, j] = max(dp[i - 1, j] + C.perf_gap, dp[i, j - 1] + C.score_gap, dp[i - 1, j - 1] + gain)
    return dp[n].max()


def total_of(pairs, t, pitch, s, notes, ratio, offset):
    out = 0.0
    for k, (i, j) in enumerate(pairs):
        gap = abs(notes[j] - pitch[i])
        out += (C.wildcard if notes[j] == -1 else C.same if gap == 0 else C.semitone if gap == 1 else C.other) - C.per_second * min(abs(s[j] * ratio + offset - t[i]), C.most_seconds)
        out += C.score_gap * (j - (pairs[k - 1][1] if k else -1) - 1)
    return out + C.perf_gap * (len(t) - len(pairs))


@pytest.mark.parametrize("seed", range(8))
def test_band_finds_the_best_total(seed):
    r = np.random.default_rng(seed)
    s = np.sort(r.uniform(0, 12, 25))
    notes = r.integers(58, 66, 25).astype(float)
    keep = r.random(25) > 0.15
    t, pitch = s[keep] + r.normal(0, 0.1, keep.sum()), notes[keep] + (r.random(keep.sum()) < 0.1)
    order = np.argsort(t)
    t, pitch = t[order], pitch[order]
    pairs = _align(t, pitch, s, notes, 1.0, 0.0, C)
    assert abs(total_of(pairs, t, pitch, s, notes, 1.0, 0.0) - best_total(t, pitch, s, notes, 1.0, 0.0)) < 1e-9


def test_long_pair(spark):
    r = np.random.default_rng(1)
    s = np.arange(400) * 0.5
    notes = r.integers(50, 80, 400)
    played = np.sort(r.choice(400, 370, replace=False))
    t = s[played] * 1.1 + 2 + r.normal(0, 0.03, 370)
    p = spark.createDataFrame([(1, i, float(x), int(notes[j])) for i, (x, j) in enumerate(zip(t, played, strict=True))], "session_id bigint, state_idx bigint, t double, pitch int")
    q = spark.createDataFrame([(1, float(x), int(n), 1 + i // 4) for i, (x, n) in enumerate(zip(s, notes, strict=True))], "session_id bigint, score_time_sec double, midi_pitch int, measure bigint")
    out = align(p, q).orderBy("state_idx").toPandas()
    assert out["matched"].mean() > 0.6
    both = out[out["matched"]]
    assert both["state_idx"].corr(both["score_time_sec"].rank()) > 0.95


def test_maps_run_in_a_session_that_knows_no_path_to_the_package(tmp_path):
    """Executors get the package from the session, not from a folder that happens to be on their path."""
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    script = tmp_path / "run.py"
    script.write_text(
        f"import sys; sys.path.insert(0, {root!r})\n"
        "from pyspark.sql import SparkSession\n"
        "spark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate()\n"
        "from scorelake.plans.catalog import QUERIES\n"
        "print('rows', QUERIES['jon01_alignment'](spark, '/root/testdata/sf0.001').count())\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert int(done.stdout.split("rows")[1]) > 0


def test_nearest_unused_against_every_choice(spark):
    from scorelake.operators.greedy import nearest_unused

    rng = np.random.default_rng(2)
    wanted = [(p, float(x)) for p in range(6) for x in np.round(rng.random(40), 2)]
    found = [(p, float(x)) for p in range(6) for x in np.round(rng.random(30), 2)]
    want = []
    for p in range(6):
        free = sorted(x for q, x in found if q == p)
        for x in sorted(x for q, x in wanted if q == p):
            best = min(free, key=lambda c: (abs(c - x), c), default=None)
            if best is not None and abs(best - x) <= 0.03:
                free.remove(best)
                want.append((p, x, best))
            else:
                want.append((p, x, x))
    got = nearest_unused(spark.createDataFrame(wanted, "page bigint, x double"), spark.createDataFrame(found, "page bigint, x double"), 0.03)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_slices_equal_the_whole(spark):
    """Random takes with wrong, missing and extra notes and drift: slices give what the whole session gives."""
    from scorelake.operators.alignment import align_slices

    draw = np.random.default_rng(12)
    notes, lines = [], []
    for session in range(3):
        n = 400
        s = np.cumsum(draw.uniform(0.2, 0.8, n))
        pitch = draw.integers(50, 75, n)
        lines += [(session, float(x), int(p), int(k // 8) + 1) for k, (x, p) in enumerate(zip(s, pitch, strict=True))]
        t = s * (1.1 + 0.05 * session) + draw.normal(0, 0.05, n)
        for k in range(n):
            if draw.random() < 0.05:
                continue
            notes.append((session, 2 * k, float(t[k]), int(pitch[k] + draw.choice([0] * 18 + [1, -1, 6]))))
            if draw.random() < 0.05:
                notes.append((session, 2 * k + 1, float(t[k] + 0.1), int(draw.integers(50, 75)) if draw.random() < 0.8 else None))
    p = spark.createDataFrame(notes, "session_id bigint, state_idx bigint, t double, pitch int")
    q = spark.createDataFrame(lines, "session_id bigint, score_time_sec double, midi_pitch int, measure bigint")
    whole = {(r.session_id, r.state_idx): r for r in align(p, q).collect()}
    parts = {(r.session_id, r.state_idx): r for r in align_slices(p, q, 20.0, 15.0).collect()}
    assert set(whole) == set(parts) and sum(r.matched for r in whole.values()) > 0.9 * len(notes)
    for k, r in whole.items():
        a, b = (tuple(x for n, x in zip(r.__fields__, row, strict=True) if n != "timing_offset_ms") for row in (r, parts[k]))
        assert a == b
        assert (r.timing_offset_ms is None) == (parts[k].timing_offset_ms is None) and (r.timing_offset_ms is None or abs(r.timing_offset_ms - parts[k].timing_offset_ms) < 0.2)


def test_slices_of_sessions_without_a_score_or_a_pitch(spark):
    from scorelake.operators.alignment import align_slices

    p = spark.createDataFrame([(1, 0, 0.0, 60), (1, 1, 50.0, None), (2, 0, 1.0, 60), (3, 0, 3.0, None)], "session_id bigint, state_idx bigint, t double, pitch int")
    q = spark.createDataFrame([(1, 0.0, 60, 1), (1, 40.0, 62, 2), (3, 1.0, 60, 1)], "session_id bigint, score_time_sec double, midi_pitch int, measure bigint")
    got = {(r.session_id, r.state_idx): (r.matched, r.measure) for r in align_slices(p, q, 10.0, 5.0).collect()}
    assert got == {(1, 0): (True, 1), (1, 1): (False, None), (2, 0): (False, None), (3, 0): (False, None)}

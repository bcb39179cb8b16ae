"""Chords in generated spectra against a plain loop, and the findings about them."""

import numpy as np
import pytest

from scorelake.operators import chords

C = chords.ChordConfig(frame_sec=0.05, low_pitch=40, per_octave=12, reach=1)


def plain(events, spectra, c):
    """The measures of one session, event by event. events: (event, t, measure, pitches)."""
    out, past = {}, []
    at = lambda t: int(np.ceil(round(t / c.frame_sec, 9)))
    for k, (event, t, _, pitches) in enumerate(events):
        pitches = sorted(set(pitches))
        if len(pitches) > 1:
            nxt = events[k + 1][1] if k + 1 < len(events) else None
            on = min(t + c.onset, nxt if nxt is not None else t + c.onset)
            sus = min(t + c.sustain, max(on + 0.05, nxt if nxt is not None else t + c.sustain))
            f0 = at(t)
            f1 = max(f0 + 1, at(on))
            f2 = max(f1 + 1, at(sus))
            pre, n = max(1, round(c.before / c.frame_sec)), len(spectra)
            a, b = max(0, f0 - pre), min(n, f0 + round(c.curve / c.frame_sec))

            def band(p, lo, hi):
                mid = round((p - c.low_pitch) * c.per_octave / 12)
                return spectra[lo:hi, max(0, mid - c.reach) : mid + c.reach + 1].max(1)

            if f0 < n:
                onset = {p: band(p, f0, min(n, f1)).mean() for p in [*pitches, *(q for q in past if q not in pitches)]}
                top = max(max(onset[p] for p in pitches), 1e-9)
                db = {p: round(20 * np.log10(max(v, 1e-9) / top), 1) for p, v in onset.items()}
                attacks = []
                for p in pitches:
                    curve = band(p, a, b)
                    if len(curve) >= 4 and curve.max() > 0:
                        low = np.percentile(curve, 10)
                        attacks.append(round((int(np.argmax(curve >= low + c.share * (curve.max() - low))) - (f0 - a)) * c.frame_sec * 1000, 1))
                gone = [db[q] for q in past if q not in pitches]
                out[event] = (
                    round(db[pitches[-1]] - max(db[p] for p in pitches[:-1]), 1), db[pitches[0]], round(max(attacks) - min(attacks), 1) if len(attacks) > 1 else None, max(gone) if gone else None,
                    {p: db[p] for p in pitches}, {p: bool(db[p] >= c.present_db and round(onset[p] / (np.median(spectra[f0 : min(n, f1)]) + 1e-9), 2) >= c.present_ratio) for p in pitches},
                )
        past = pitches
    return out


@pytest.fixture(scope="module")
def made(spark):
    draw = np.random.default_rng(5)
    sessions = {}
    for s in (1, 2):
        spectra = draw.random((240, 40)) * draw.choice([0.1, 1, 3], (240, 40))
        t, events = 0.0, []
        for e in range(40):
            events.append((e, round(t, 3), e // 4, sorted(draw.choice(np.arange(41, 78), draw.integers(1, 5), replace=False).tolist())))
            t += float(draw.uniform(0.08, 0.6))
        sessions[s] = (events, spectra)
    rows = spark.createDataFrame([(s, *e) for s, (events, _) in sessions.items() for e in events], "session_id bigint, event bigint, t double, measure bigint, pitches array<int>")
    frames = spark.createDataFrame([(s, k, m.tolist()) for s, (_, x) in sessions.items() for k, m in enumerate(x)], "session_id bigint, frame_idx bigint, mag array<double>")
    return sessions, chords.measured(rows, frames, C).cache()


def test_measures_equal_a_plain_loop(made):
    sessions, found = made
    got = {(r.session_id, r.event): r for r in found.collect()}
    want = {(s, e): v for s, (events, x) in sessions.items() for e, v in plain(events, x, C).items()}
    assert set(got) == set(want) and len(want) > 40
    close = lambda a, b: (a is None) == (b is None) and (a is None or abs(a - b) <= 0.11)  # noqa: E731 (levels are rounded to a tenth)
    for k, (margin, bass, spread, residue, db, present) in want.items():
        r = got[k]
        assert close(r.margin_db, margin) and close(r.bass_db, bass) and close(r.spread_ms, spread) and close(r.residue_db, residue) and r.blur == (residue is not None and residue > -8)
        assert [m.pitch for m in r.members] == sorted(db) and all(close(m.onset_db, db[m.pitch]) and m.present == present[m.pitch] for m in r.members)
        assert r.members[-1].role == "melody" and r.members[0].role == "bass" and {m.role for m in r.members[1:-1]} <= {"inner"}


def test_findings_are_the_worst_of_each_rule(made):
    _, found = made
    rows = [r.asDict() for r in found.collect()]
    got = chords.findings(found, chords.ChordConfig(most=3)).collect()
    for s in (1, 2):
        own = [r for r in rows if r["session_id"] == s]
        weak = sorted((r["margin_db"], r["t"], r["event"]) for r in own if r["margin_db"] < 3)[:3]
        assert [(r.value, r.event, r.severity) for r in sorted((g for g in got if g.session_id == s and g.rule == "melody"), key=lambda g: g.rank)] == [(m, e, "alert" if m < 0 else "warn") for m, _, e in weak]
        late = sorted((-r["spread_ms"], r["t"], r["event"]) for r in own if (r["spread_ms"] or 0) >= 80)[:3]
        assert [(-r.value, r.event) for r in sorted((g for g in got if g.session_id == s and g.rule == "attack"), key=lambda g: g.rank)] == [(m, e) for m, _, e in late]
        left = sorted((-r["residue_db"], r["t"], r["event"]) for r in own if r["residue_db"] is not None and r["residue_db"] > -8)[:3]
        assert [(-r.value, r.event) for r in sorted((g for g in got if g.session_id == s and g.rule == "pedal"), key=lambda g: g.rank)] == [(m, e) for m, _, e in left]

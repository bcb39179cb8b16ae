"""Kernels over recordings and pitch tracks: constant-Q spectra, onsets, vibrato, trills. Maps over rows that each hold
one recording or one track; numpy inside, Spark around."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from scorelake.operators.cluster import dealt, ship


@lru_cache(maxsize=8)
def _tones(rate: int, low_hz: float, octaves: int, per_octave: int) -> np.ndarray:
    """Windowed complex tones (samples x bins), each as long as its Q asks, about one centre; bins beyond half the rate
    are left out."""
    q = 1 / (2 ** (1 / per_octave) - 1)
    hz = low_hz * 2 ** (np.arange(octaves * per_octave) / per_octave)
    hz = hz[hz < rate / 2]
    longest = int(np.ceil(q * rate / hz[0]))
    out = np.zeros((longest, len(hz)), complex)
    for k, f in enumerate(hz):
        n = int(np.ceil(q * rate / f))
        tone = np.hanning(n) * np.exp(-2j * np.pi * f / rate * (np.arange(n) - n / 2))
        out[longest // 2 - n // 2 :, k][:n] = tone / np.abs(tone).sum()
    return out


def cqt(samples: np.ndarray, rate: int, low_hz: float, octaves: int, per_octave: int, hop: int) -> np.ndarray:
    """Magnitudes (frames x bins) of windowed complex tones: all of them by one product for every few frames."""
    tones = _tones(rate, low_hz, octaves, per_octave)
    longest = len(tones)
    padded = np.pad(np.asarray(samples, float), longest // 2 + 1)
    centres = np.arange(0, max(1, len(samples)), hop)
    out = np.zeros((len(centres), octaves * per_octave))
    starts = centres + 1
    # as long as the longest tone, the last frames may reach one sample beyond the padding
    views = np.lib.stride_tricks.sliding_window_view(np.append(padded, 0.0), longest)
    for k in range(0, len(starts), 64):
        some = views[starts[k : k + 64]]
        out[k : k + 64, : tones.shape[1]] = np.hypot(some @ tones.real, some @ tones.imag)
    return out


def frames_of(recordings: DataFrame, low_hz: float, octaves: int, per_octave: int, hop: int = 512) -> DataFrame:
    """session_id, frame_idx, t_sec, mag. recordings: session_id, rate, samples (array<float>)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for session, rate, samples in zip(batch["session_id"], batch["rate"], batch["samples"], strict=True):
                m = cqt(samples, rate, low_hz, octaves, per_octave, hop)
                yield pd.DataFrame({"session_id": session, "frame_idx": np.arange(len(m)), "t_sec": np.arange(len(m)) * hop / rate, "mag": list(m)})

    ship(recordings.sparkSession)
    return recordings.mapInPandas(run, "session_id bigint, frame_idx bigint, t_sec double, mag array<double>")


def flux_onsets(frames: DataFrame, delta: float = 0.07, wait: float = 0.08) -> DataFrame:
    """session_id, time, strength: peaks of the rise between spectra (scaled to 1) that stand ``delta`` above their
    surroundings and at least ``wait`` seconds after the last one."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("frame_idx")
        m, t = np.log1p(100 * np.array(g["mag"].tolist())), g["t_sec"].to_numpy()
        rise = np.concatenate([[0], np.maximum(0, np.diff(m, axis=0)).sum(1)])
        rise = rise / max(rise.max(), 1e-9)
        out, last = [], -np.inf
        for k in range(1, len(rise) - 1):
            around = rise[max(0, k - 10) : k + 11].mean()
            if rise[k] >= rise[k - 1] and rise[k] > rise[k + 1] and rise[k] >= around + delta and t[k] >= last + wait:
                out.append((t[k], rise[k]))
                last = t[k]
        return pd.DataFrame({"session_id": [g["session_id"].iloc[0]] * len(out), "time": [a for a, _ in out], "strength": [b for _, b in out]})

    return dealt(frames, "session_id").groupBy("session_id").applyInPandas(run, "session_id bigint, time double, strength double")


def modulation(cents: np.ndarray, rate: float, low: float, high: float) -> tuple[float, float]:
    """Rate (Hz) and strength of the strongest repetition of a pitch track between two rates, by autocorrelation."""
    x = np.asarray(cents, float) - np.mean(cents)
    a = np.correlate(x, x, "full")[len(x) - 1 :]
    if a[0] <= 0:
        return 0.0, 0.0
    a = a / a[0]
    lags = np.arange(max(1, int(rate / high)), min(len(a) - 1, int(rate / low)) + 1)
    if not len(lags):
        return 0.0, 0.0
    # multiples of a period repeat as well: the shortest lag that comes near the best one
    best = next(k for k in lags if a[k] >= 0.8 * a[lags].max() and a[k] >= a[k - 1] and a[k] >= a[min(k + 1, len(a) - 1)] or k == lags[-1])
    return float(rate / best), float(a[best])


# The least strength of a repetition and the least width in cents of a vibrato and of a trill; beyond
# NO_VIBRATO cents a movement is none; tracks of fewer voiced frames say nothing.
VIBRATO_STRENGTH, VIBRATO_DEPTH, NO_VIBRATO = 0.25, 8.0, 100.0
TRILL_STRENGTH, TRILL_SWING, EVEN = 0.20, 40.0, 0.7
VOICED = 20


def _vibrato_verdict(speed: float, strength: float, depth: float) -> str:
    if strength < VIBRATO_STRENGTH or depth < VIBRATO_DEPTH:
        return "none"
    if depth > NO_VIBRATO:
        return "non-vibrato pitch motion (probably a slur, shift, or chord arpeggiation)"
    slow, fast = speed < 4.5 and depth > 35, speed > 7.5 and depth < 25
    return "wide-and-slow" if slow else "fast-and-narrow" if fast else "present"


def _trill_verdict(speed: float, strength: float, swing: float, even: float) -> str:
    if strength < TRILL_STRENGTH or swing < TRILL_SWING:
        return "no trill detected"
    if speed < 5:
        return "slow trill (may sound deliberate or laboured)"
    return "very fast trill" if speed > 11 else "regular trill" if even > EVEN else "trill present but uneven"


def _cents(hz) -> np.ndarray:
    """Cents about the median of the voiced frames."""
    hz = np.asarray(hz, float)
    hz = hz[np.isfinite(hz) & (hz > 0)]
    return 1200 * np.log2(hz / np.median(hz)) if len(hz) else np.zeros(0)


def vibrato(tracks: DataFrame) -> DataFrame:
    """session_id, rate_hz, depth_cents, verdict. tracks: session_id, rate, hz (array<double>)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for session, rate, hz in zip(b["session_id"], b["rate"], b["hz"], strict=True):
                cents = _cents(hz)
                if len(cents) < VOICED:
                    rows.append((session, 0.0, 0.0, "none"))
                    continue
                speed, strength = modulation(cents, rate, 3, 9)
                depth = float(np.std(cents) * np.sqrt(2))
                rows.append((session, speed, depth, _vibrato_verdict(speed, strength, depth)))
            yield pd.DataFrame(rows, columns=["session_id", "rate_hz", "depth_cents", "verdict"])

    ship(tracks.sparkSession)
    return tracks.mapInPandas(run, "session_id bigint, rate_hz double, depth_cents double, verdict string")


def trills(tracks: DataFrame) -> DataFrame:
    """session_id, rate_hz, swing_cents, evenness, verdict of alternating pitches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for session, rate, hz in zip(b["session_id"], b["rate"], b["hz"], strict=True):
                cents = _cents(hz)
                if len(cents) < VOICED:
                    rows.append((session, 0.0, 0.0, 0.0, "no trill detected"))
                    continue
                speed, strength = modulation(cents, rate, 4, 14)
                swing = float(np.percentile(cents, 90) - np.percentile(cents, 10))
                turns = np.diff(np.flatnonzero(np.diff(np.signbit(cents - cents.mean()))))
                even = float(1 - min(1.0, np.std(turns) / np.mean(turns))) if len(turns) > 2 else 0.0
                rows.append((session, speed, swing, even, _trill_verdict(speed, strength, swing, even)))
            yield pd.DataFrame(rows, columns=["session_id", "rate_hz", "swing_cents", "evenness", "verdict"])

    ship(tracks.sparkSession)
    return tracks.mapInPandas(run, "session_id bigint, rate_hz double, swing_cents double, evenness double, verdict string")


def prominent_peaks(x: np.ndarray, distance: int, prominence: float, most: int) -> list[tuple[int, float]]:
    """Places and prominences of the highest peaks: of two closer than ``distance`` the higher one stays, and a peak
    stands at least ``prominence`` above the higher of the two valleys that part it from higher ground."""
    x = np.asarray(x, float)
    tops = np.flatnonzero((x[1:-1] > x[:-2]) & (x[1:-1] >= x[2:])) + 1 if len(x) > 2 else np.zeros(0, int)
    kept: list[int] = []
    for k in tops[np.argsort(-x[tops], kind="stable")]:
        if all(abs(k - o) >= distance for o in kept):
            kept.append(int(k))
    out = []
    for k in kept:
        higher = np.flatnonzero(x > x[k])
        left, right = higher[higher < k], higher[higher > k]
        sides = x[left[-1] if len(left) else 0 : k + 1].min(), x[k : (right[0] if len(right) else len(x) - 1) + 1].min()
        if x[k] - max(sides) >= prominence:
            out.append((k, float(x[k] - max(sides))))
    return out[:most]


def envelope_peaks(envelopes: DataFrame, distance: int = 3, prominence: float = 2.0, most: int = 8) -> DataFrame:
    """session_id, place, rel_db, prominence of an envelope's loudest peaks, relative to its maximum. envelopes:
    session_id, db (array<double>), one row each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for session, db in zip(b["session_id"], b["db"], strict=True):
                db = np.asarray(db, float)
                rows += [(session, k, round(float(db[k] - db.max()), 1), round(p, 6)) for k, p in prominent_peaks(db, distance, prominence, most)]
            yield pd.DataFrame(rows, columns=["session_id", "place", "rel_db", "prominence"])

    ship(envelopes.sparkSession)
    return envelopes.mapInPandas(run, "session_id bigint, place int, rel_db double, prominence double")

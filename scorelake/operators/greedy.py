"""Scans whose next step depends on the last choice: grouped maps, one session or page at a time."""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from scorelake.operators.cluster import dealt, ship


def refine_bar_starts(bars: DataFrame, onsets: DataFrame, near: float = 4.0, loud: float = -30.0, after: float = 0.2) -> DataFrame:
    """session_id, measure, start, status. A bar's start moves to the best onset around it (loudness plus strength minus
    6 per second of distance) that is loud, close, of an expected pitch class and later than the last bar's start; bars
    that end up shorter than 0.6 of the median take their predicted start back.

    bars: session_id, measure, start, pcs (array of pitch classes, empty: none known); onsets: session_id, time,
    loudness_db, strength, pc."""

    def run(b: pd.DataFrame, o: pd.DataFrame) -> pd.DataFrame:
        if "measure" not in b:
            return pd.DataFrame({"session_id": [], "measure": [], "start": [], "status": []})
        b = b.sort_values("measure")
        o = o.reindex(columns=["time", "loudness_db", "strength", "pc"]).dropna(subset=["time"]).sort_values("time")
        t, level, strength, pc = (o[c].to_numpy() for c in ("time", "loudness_db", "strength", "pc"))
        previous, starts, states = -np.inf, [], []
        for predicted, pcs in zip(b["start"].to_numpy(), b["pcs"], strict=True):
            at, state = predicted, "no_rich_onsets" if not len(t) else "no_score" if not len(pcs) else "fallback"
            if state == "fallback":
                fits = np.isin(pc, pcs) & (level >= loud) & (t > previous + after)
                close = np.flatnonzero(fits & (np.abs(t - predicted) <= near))
                if len(close):
                    score = level[close] + strength[close] - 6 * np.abs(t[close] - predicted)
                    best = max(zip(score, t[close], level[close], close, strict=True))[3]
                    at, state = t[best], "snapped_strong" if strength[best] >= np.quantile(strength, 0.75) else "snapped"
                elif fits.any():
                    state = "rejected_far_snap"
            starts.append(at)
            states.append(state)
            previous = at
        lengths = np.diff(starts)
        if (lengths > 0).any():
            middle = np.median(lengths[lengths > 0])
            for k in range(1, len(starts)):
                if starts[k] - starts[k - 1] < 0.6 * middle:
                    starts[k] = float(b["start"].iloc[k])
        return pd.DataFrame({"session_id": b["session_id"], "measure": b["measure"], "start": starts, "status": states})

    return dealt(bars, "session_id").groupBy("session_id").cogroup(dealt(onsets, "session_id").groupBy("session_id")).applyInPandas(run, "session_id bigint, measure bigint, start double, status string")


def nearest_unused(wanted: DataFrame, found: DataFrame, tolerance: float) -> DataFrame:
    """page, x, fit: each expected boundary, from left to right, takes the nearest candidate that none before it took,
    within the tolerance; else it stays where it was expected."""

    def run(w: pd.DataFrame, f: pd.DataFrame) -> pd.DataFrame:
        w, f = (g.reindex(columns=["page", "x"]).dropna() for g in (w, f))  # a side without rows comes without columns
        free = sorted(f["x"].tolist())
        # the next free candidate from each place on, to the left and to the right; paths are shortened as they are walked
        after = list(range(len(free) + 1))

        def next_free(way: list[int], k: int) -> int:
            end = k
            while way[end] != end:
                end = way[end]
            while way[k] != end:
                way[k], k = end, way[k]
            return end

        before = list(range(len(free) + 1))  # place k + 1 stands for candidate k, place 0 for none
        out = []
        for x in sorted(w["x"].tolist()):
            k = bisect_left(free, x)
            near = [c for c in (next_free(before, k) - 1, next_free(after, k)) if 0 <= c < len(free)]
            best = min(near, key=lambda c: (abs(free[c] - x), free[c]), default=None)  # noqa: B023
            if best is not None and abs(free[best] - x) <= tolerance:
                before[best + 1], after[best] = best, best + 1
                out.append((x, free[best]))
            else:
                out.append((x, x))
        return pd.DataFrame({"page": [int(w["page"].iloc[0])] * len(out) if len(w) else [], "x": [a for a, _ in out], "fit": [b for _, b in out]})

    return dealt(wanted, "page").groupBy("page").cogroup(dealt(found, "page").groupBy("page")).applyInPandas(run, "page bigint, x double, fit double")


def staves(lines: DataFrame, least: float, most: float) -> DataFrame:
    """page, top, bottom of each staff: five lines in a row whose gaps lie within bounds, taken greedily from the top.
    lines: page, y."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        y, k, out = np.sort(g["y"].to_numpy(float)), 0, []
        while k + 5 <= len(y):
            gaps = np.diff(y[k : k + 5])
            if (gaps >= least).all() and (gaps <= most).all():
                out.append((y[k], y[k + 4]))
                k += 5
            else:
                k += 1
        return pd.DataFrame({"page": [g["page"].iloc[0]] * len(out), "top": [a for a, _ in out], "bottom": [b for _, b in out]})

    return dealt(lines, "page").groupBy("page").applyInPandas(run, "page bigint, top double, bottom double")


def weighted_clusters(points: DataFrame, gap: float, apart: float) -> DataFrame:
    """page, x, score: candidates no further apart than ``gap`` become one at their score-weighted mean; of two that
    are closer than ``apart`` the better one stays."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("x")
        island = (g["x"].diff() > gap).cumsum()
        merged = [((p["x"] * p["score"]).sum() / p["score"].sum(), p["score"].max()) for _, p in g.groupby(island)]
        kept: list[tuple[float, float]] = []
        for x, score in sorted(merged, key=lambda c: (-c[1], c[0])):
            if all(abs(x - other) >= apart for other, _ in kept):
                kept.append((x, score))
        kept.sort()
        return pd.DataFrame({"page": [g["page"].iloc[0]] * len(kept), "x": [a for a, _ in kept], "score": [b for _, b in kept]})

    return dealt(points, "page").groupBy("page").applyInPandas(run, "page bigint, x double, score double")


def spectral_peaks(frames: DataFrame, floor_db: float, distance: int, most: int) -> DataFrame:
    """frame_idx, bin, db: local maxima above a level under the frame's largest, the loudest first, none within
    ``distance`` bins of one taken before."""

    def run(batches):
        for frame in batches:
            rows = []
            for idx, mag in zip(frame["frame_idx"], frame["mag"], strict=True):
                m = np.asarray(mag, float)
                db = 20 * np.log10(np.maximum(m, 1e-9) / max(m.max(initial=0), 1e-9))
                inner = np.flatnonzero((db[1:-1] > db[:-2]) & (db[1:-1] >= db[2:]) & (db[1:-1] >= floor_db)) + 1
                kept: list[int] = []
                for k in inner[np.argsort(-db[inner], kind="stable")]:
                    if len(kept) < most and all(abs(k - o) >= distance for o in kept):
                        kept.append(int(k))
                rows += [(idx, k, float(db[k])) for k in kept]
            yield pd.DataFrame(rows, columns=["frame_idx", "bin", "db"])

    ship(frames.sparkSession)
    return frames.select("frame_idx", "mag").mapInPandas(run, "frame_idx bigint, bin int, db double")


def greedy_matches(perf: DataFrame, score: DataFrame, smoothing: float = 0.85, backward: float = 0.5) -> DataFrame:
    """The simple matcher that the alignment is measured against: each note takes the unclaimed score note of its pitch
    whose time, shifted by a smoothed lag, is nearest; going backward costs extra."""

    def run(p: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        if "t" not in p:
            return pd.DataFrame({"session_id": [], "state_idx": [], "score_time_sec": []})
        p, s = p.sort_values(["t", "state_idx"]), s.reindex(columns=["score_time_sec", "midi_pitch"]).dropna(subset=["score_time_sec"]).sort_values(["score_time_sec", "midi_pitch"])
        time, notes = s["score_time_sec"].to_numpy(float), s["midi_pitch"].to_numpy(float)
        free, lag, last, out = np.ones(len(s), bool), 0.0, -np.inf, []
        for t, pitch in zip(p["t"].to_numpy(float), p["pitch"].to_numpy(float), strict=True):
            ok = np.flatnonzero(free & (notes == pitch))
            if not len(ok):
                out.append(None)
                continue
            best = ok[np.argmin(np.abs(time[ok] + lag - t) + backward * np.maximum(0, last - time[ok]))]
            free[best], last = False, time[best]
            lag = smoothing * lag + (1 - smoothing) * (t - time[best])
            out.append(time[best])
        return pd.DataFrame({"session_id": p["session_id"], "state_idx": p["state_idx"], "score_time_sec": pd.array(out, "Float64")})

    return dealt(perf, "session_id").groupBy("session_id").cogroup(dealt(score, "session_id").groupBy("session_id")).applyInPandas(run, "session_id bigint, state_idx bigint, score_time_sec double")

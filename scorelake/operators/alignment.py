"""Alignment of performed notes with score notes: one dynamic programme per session, as a cogrouped map, or one per slice
of a session, many slices at once.

Spark deals both sides by session over many tasks; a session is a recording, so a group is small. Within it the programme keeps only
the band of score notes within ``band`` seconds of the expected time, one row of scores at a time, and one byte per
band cell for the way back.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.operators.cluster import dealt, ship


@dataclass(frozen=True)
class AlignConfig:
    same: float = 5.0
    semitone: float = 1.0
    wildcard: float = 2.5
    other: float = -1000.0
    perf_gap: float = -0.5
    score_gap: float = -2.0
    per_second: float = 0.5
    most_seconds: float = 20.0
    band: float = 3.0
    fill_within: float = 2.0


WILDCARD = -1
OUT = "session_id bigint, state_idx bigint, matched boolean, measure bigint, score_time_sec double, score_midi_pitch int, matched_to_wildcard boolean, timing_offset_ms double, filled boolean"
_UP, _LEFT, _DIAG = 1, 2, 3


#: Fixed value: bands of fewer score notes are worked off number by number, since arrays cost more than a few numbers.
NARROW = 16

#: Fixed values of ``align_slices``: neighbouring slices that make a group at most and have its margins in common; notes of a
#: group, of more only if a slice has more; rows that a task takes at a time; band cells of the slices of one programme.
TOGETHER, NOTES, ROWS, CELLS = 8, 10_000, 100_000, 1 << 22


def _narrow_row(t: float, pitch: float, s: list, score: list, i: int, lo: int, hi: int, before, before_lo: int, before_hi: int, ratio: float, offset: float, c: AlignConfig) -> tuple[list[float], list[int]]:
    """A row of scores and of ways, cell by cell: what the arrays of ``_align`` give, to the last place."""
    zero = c.perf_gap * (i - 1)
    top = c.perf_gap * i if lo == 0 else -1e15
    run = top  # the best way along the row so far, less what its gaps cost
    row, way = [], []
    for k, j in enumerate(range(lo + 1, hi + 2), 1):
        up = (before[j - before_lo] if before_lo <= j <= before_hi else -1e15) + c.perf_gap
        diag_from = zero if j == 1 else before[j - 1 - before_lo] if before_lo <= j - 1 <= before_hi else -1e15
        note = score[j - 1]
        gap = abs(note - pitch)
        gain = c.wildcard if note == WILDCARD else c.same if gap == 0 else c.semitone if gap == 1 else c.other
        diag = diag_from + gain - c.per_second * min(abs(s[j - 1] * ratio + offset - t), c.most_seconds)
        best = max(up, diag)
        left = run + c.score_gap * (k - 1) + c.score_gap
        row.append(max(best, left))
        way.append(_DIAG if diag > max(up, left) else _LEFT if left > up else _UP)
        run = max(run, best - c.score_gap * k)
    return row, way


def _align(t: np.ndarray, pitch: np.ndarray, s: np.ndarray, score: np.ndarray, ratio: float, offset: float, c: AlignConfig) -> list[tuple[int, int]]:
    """Matched (performed, score) pairs of one pass."""
    n, m = len(t), len(s)
    columns = np.arange(m + 1)
    before = c.score_gap * columns
    before_lo, before_hi = 0, m
    ways: list[tuple[int, np.ndarray | list[int]]] = []
    want = (t - offset) / ratio
    los, his = np.searchsorted(s, want - c.band, "left").tolist(), np.searchsorted(s, want + c.band, "right").tolist()
    times, pitches, at_s, notes = t.tolist(), pitch.tolist(), s.tolist(), score.tolist()
    for i in range(1, n + 1):
        lo = los[i - 1]
        hi = max(his[i - 1] - 1, min(lo, m - 1))
        lo = min(lo, hi)
        if hi - lo < NARROW:
            row, way = _narrow_row(times[i - 1], pitches[i - 1], at_s, notes, i, lo, hi, before, before_lo, before_hi, ratio, offset, c)
            ways.append((lo + 1, way))
            before, before_lo, before_hi = row, lo + 1, hi + 1
            if lo == 0:
                before, before_lo = [c.perf_gap * i, *row], 0
            continue
        before = np.asarray(before)
        # cells lo+1 .. hi+1 of this row are in the band, and so is column 0
        j = np.arange(lo + 1, hi + 2)
        at = lambda x: np.where((x >= before_lo) & (x <= before_hi), before[np.clip(x - before_lo, 0, len(before) - 1)], -1e15)  # noqa: B023, E731
        zero = c.perf_gap * (i - 1)
        up = at(j) + c.perf_gap
        diag_from = np.where(j - 1 == 0, zero, at(j - 1))
        gap = np.abs(score[j - 1] - pitch[i - 1])
        gain = np.where(score[j - 1] == WILDCARD, c.wildcard, np.where(gap == 0, c.same, np.where(gap == 1, c.semitone, c.other)))
        diag = diag_from + gain - c.per_second * np.minimum(np.abs(s[j - 1] * ratio + offset - t[i - 1]), c.most_seconds)
        best = np.maximum(up, diag)
        edge = c.perf_gap * i if lo == 0 else -1e15
        run = np.maximum.accumulate(np.concatenate([[edge], best]) - c.score_gap * np.arange(len(j) + 1)) + c.score_gap * np.arange(len(j) + 1)
        left = run[:-1] + c.score_gap
        row = np.maximum(best, left)
        ways.append((lo + 1, np.where(diag > np.maximum(up, left), _DIAG, np.where(left > up, _LEFT, _UP)).astype(np.int8)))
        before, before_lo, before_hi = row, lo + 1, hi + 1
        if lo == 0:
            before, before_lo = np.concatenate([[c.perf_gap * i], row]), 0
    i = n
    lo, way = ways[-1]
    j = before_lo + int(np.argmax(before))
    if c.perf_gap * n >= max(before):
        j = 0
    pairs = []
    while i > 0 and j > 0:
        lo, way = ways[i - 1]
        step = way[j - lo] if 0 <= j - lo < len(way) else _LEFT
        if step == _DIAG:
            if score[j - 1] == WILDCARD or abs(score[j - 1] - pitch[i - 1]) <= 1:
                pairs.append((i - 1, j - 1))
            i, j = i - 1, j - 1
        elif step == _LEFT:
            j -= 1
        else:
            i -= 1
    return pairs[::-1]


def _matched(perf: pd.DataFrame, score: pd.DataFrame, pairs: list[tuple[int, int]], ratio: float, offset: float, c: AlignConfig) -> pd.DataFrame:
    """Every performed note with its match. pairs: of the notes with a pitch, in their order; the others that have one take
    the compatible score note nearest in time, and score notes may serve twice."""
    usable = np.flatnonzero(perf["pitch"].notna().to_numpy())
    hit, filled = np.full(len(perf), -1), np.zeros(len(perf), bool)
    if len(usable) and len(score):
        t, pitch = perf["t"].to_numpy(float)[usable], perf["pitch"].to_numpy(float)[usable]
        s, notes = score["score_time_sec"].to_numpy(float), score["midi_pitch"].to_numpy(float)
        for i, j in pairs:
            hit[usable[i]] = j
        line = s * ratio + offset
        left = np.flatnonzero(hit[usable] < 0)
        begin, end = np.searchsorted(line, t[left] - c.fill_within, "left"), np.searchsorted(line, t[left] + c.fill_within, "right")
        for i, a, b in zip(left.tolist(), begin.tolist(), end.tolist(), strict=True):
            gap = np.abs(line[a:b] - t[i])
            gap[(np.abs(notes[a:b] - pitch[i]) > 1) | (notes[a:b] == WILDCARD) | (gap > c.fill_within)] = np.inf
            if len(gap) and gap.min() < np.inf:
                hit[usable[i]], filled[usable[i]] = a + int(gap.argmin()), True
    matched = hit >= 0
    if len(score):
        at = np.maximum(hit, 0)
        second, note = score["score_time_sec"].to_numpy(float)[at], score["midi_pitch"].to_numpy(float)[at]
        unknown = score["measure"].isna().to_numpy()[at]
        measure = score["measure"].fillna(0).to_numpy(np.int64)[at]
    else:
        second, note = np.full(len(perf), np.nan), np.full(len(perf), np.nan)
        unknown, measure = np.ones(len(perf), bool), np.zeros(len(perf), np.int64)
    wild = matched & (note == WILDCARD)
    silent = ~matched | wild | np.isnan(note)
    line = second * ratio + offset
    return pd.DataFrame({
        "session_id": perf["session_id"].to_numpy(), "state_idx": perf["state_idx"].to_numpy(), "matched": matched, "measure": pd.arrays.IntegerArray(measure, ~matched | unknown),
        "score_time_sec": np.where(matched, second, np.nan), "score_midi_pitch": pd.arrays.IntegerArray(np.where(silent, 0, note).astype(np.int64), silent), "matched_to_wildcard": wild,
        "timing_offset_ms": np.where(matched, np.round((perf["t"].to_numpy(float) - line) * 1000, 1), np.nan), "filled": filled,
    }, index=perf.index)


def _found(values: np.ndarray, begin: np.ndarray, end: np.ndarray, x: np.ndarray, right: bool = False) -> np.ndarray:
    """``np.searchsorted`` of each x in the part of values from its begin to its end; places in values."""
    lo, hi = begin.copy(), end.copy()
    for _ in range(int((end - begin).max(initial=0)).bit_length()):
        mid = (lo + hi) // 2
        at = values[np.minimum(mid, len(values) - 1)]
        more = (lo < hi) & ((at <= x) if right else (at < x))
        lo, hi = np.where(more, mid + 1, lo), np.where(more, hi, np.minimum(mid, hi))
    return lo


@dataclass(frozen=True)
class _Slices:
    """Slices of many groups. t, pitch: notes with a pitch, in their order; s, score, line: score notes and their expected
    times; first, last: the score notes within the band of every note. Every slice has the notes from begin to end, of which
    those from own_begin to own_end are its own, and the score notes from s_begin to s_end."""

    t: np.ndarray
    pitch: np.ndarray
    s: np.ndarray
    score: np.ndarray
    line: np.ndarray
    first: np.ndarray
    last: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    own_begin: np.ndarray
    own_end: np.ndarray
    s_begin: np.ndarray
    s_end: np.ndarray
    ratio: np.ndarray
    offset: np.ndarray


def _hits(x: _Slices, c: AlignConfig) -> np.ndarray:
    """The score note of every note by the slice whose own it is, or -1: what ``_align`` gives for each slice."""
    hit = np.full(len(x.t), -1)
    n = x.end - x.begin
    some = np.flatnonzero((n > 0) & (x.s_end > x.s_begin) & (x.own_end > x.own_begin))
    if not len(some):
        return hit
    widths = np.append(np.maximum(x.last - x.first, 1), 1)
    width = np.maximum.reduceat(widths, np.stack([x.begin[some], x.end[some]], 1).ravel())[::2]
    width = 1 << np.ceil(np.log2(width)).astype(np.int64)
    order = np.lexsort([-n[some], width])
    some, width = some[order], width[order]
    k = 0
    while k < len(some):
        most, wide = int(n[some[k]]), int(width[k])
        if most * wide > CELLS:
            q = some[k]
            a, b, at = x.begin[q], x.end[q], slice(x.s_begin[q], x.s_end[q])
            for i, j in _align(x.t[a:b], x.pitch[a:b], x.s[at], x.score[at], float(x.ratio[q]), float(x.offset[q]), c):
                if x.own_begin[q] <= a + i < x.own_end[q]:
                    hit[a + i] = x.s_begin[q] + j
            k += 1
            continue
        upto = min(k + max(CELLS // (max(most, 64) * wide), 1), int(np.searchsorted(width, wide, "right")))
        _hits_together(x, some[k:upto], wide, hit, c)
        k = upto
    return hit


def _hits_together(x: _Slices, which: np.ndarray, width: int, hit: np.ndarray, c: AlignConfig) -> None:
    """The programme of ``_align`` for all of ``which``, row by row together: slices by falling number of notes, bands of
    ``width`` score notes at most. Cells beyond a slice's band are worth what lies outside of it."""
    begin, n, s_begin, m = x.begin[which], (x.end - x.begin)[which], x.s_begin[which], (x.s_end - x.s_begin)[which]
    most, k = int(n[0]), np.arange(width + 1)
    ways, los, wides = np.empty((most, len(which), width), np.int8), np.empty((most, len(which)), np.int64), np.empty((most, len(which)), np.int64)
    end = np.zeros(len(which), np.int64)
    slope = c.score_gap * k
    active = np.searchsorted(-n, -np.arange(1, most + 2), "right").tolist()
    before = np.empty((0, 0))
    for i in range(1, most + 1):
        a = active[i - 1]
        note = begin[:a] + (i - 1)
        lo = np.clip(x.first[note] - s_begin[:a], 0, m[:a])
        hi = np.maximum(np.clip(x.last[note] - s_begin[:a], 0, m[:a]) - 1, np.minimum(lo, m[:a] - 1))
        lo = np.minimum(lo, hi)
        # columns lo .. hi + 1 of the row before; cells lo + 1 .. hi + 1 of this row are in the band, and so is column 0
        if i == 1:
            prior = c.score_gap * (lo[:, None] + k)
        else:
            back = (lo - los[i - 2, :a])[:, None] + k
            prior = np.where((back >= 0) & (back <= width), np.take_along_axis(before[:a], np.clip(back, 0, width), 1), -1e15)
        up = prior[:, 1:] + c.perf_gap
        prior[:, 0] = np.where(lo == 0, c.perf_gap * (i - 1), prior[:, 0])
        cell = np.minimum((s_begin[:a] + lo)[:, None] + k[:-1], len(x.s) - 1)
        notes = x.score[cell]
        gap = np.abs(notes - x.pitch[note][:, None])
        gain = np.where(notes == WILDCARD, c.wildcard, np.where(gap == 0, c.same, np.where(gap == 1, c.semitone, c.other)))
        diag = prior[:, :-1] + gain - c.per_second * np.minimum(np.abs(x.line[cell] - x.t[note][:, None]), c.most_seconds)
        best = np.maximum(up, diag)
        edge = np.where(lo == 0, c.perf_gap * i, -1e15)[:, None]
        run = np.maximum.accumulate(np.concatenate([edge, best], 1) - slope, axis=1) + slope
        left = run[:, :-1] + c.score_gap
        row = np.maximum(best, left)
        ways[i - 1, :a] = np.where(diag > np.maximum(up, left), _DIAG, np.where(left > up, _LEFT, _UP))
        los[i - 1, :a], wides[i - 1, :a] = lo, hi - lo + 1
        beyond = k[:-1] > (hi - lo)[:, None]
        row[beyond] = -1e15
        before = np.concatenate([edge, row], 1)
        z = active[i]
        if z < a:
            last = np.concatenate([np.where(lo == 0, edge[:, 0], -np.inf)[z:, None], np.where(beyond, -np.inf, row)[z:]], 1)
            end[z:a] = np.where(c.perf_gap * i >= last.max(1), 0, lo[z:] + last.argmax(1))
    at = np.flatnonzero(end > 0)
    i, j = n[at], end[at]
    own_begin, own_end = x.own_begin[which], x.own_end[which]
    while len(at):
        lo, wide = los[i - 1, at], wides[i - 1, at]
        j = np.minimum(j, lo + wide)  # right of the band all ways go left
        inside = j > lo
        step = ways[i - 1, at, np.maximum(j - 1 - lo, 0)]
        note, cell = begin[at] + i - 1, s_begin[at] + j - 1
        pair = inside & (step == _DIAG) & (note >= own_begin[at]) & (note < own_end[at])
        pair[pair] = (x.score[cell[pair]] == WILDCARD) | (np.abs(x.score[cell[pair]] - x.pitch[note[pair]]) <= 1)
        hit[note[pair]] = cell[pair]
        i, j = i - (step != _LEFT), j - (step != _UP)
        on = inside & (i > 0) & (j > 0)
        at, i, j = at[on], i[on], j[on]


def _filled(x: _Slices, hit: np.ndarray, c: AlignConfig) -> np.ndarray:
    """``hit`` with the compatible score note nearest in time, if there is one, for own notes without any."""
    own = x.own_end - x.own_begin
    of = np.repeat(np.arange(len(own)), own)
    notes = np.arange(len(of)) + np.repeat(x.own_begin - np.cumsum(own) + own, own)
    of, notes = of[hit[notes] < 0], notes[hit[notes] < 0]
    hit = hit.copy()
    if not len(notes) or not len(x.s):
        return hit
    begin = _found(x.line, x.s_begin[of], x.s_end[of], x.t[notes] - c.fill_within)
    n = _found(x.line, x.s_begin[of], x.s_end[of], x.t[notes] + c.fill_within, right=True) - begin
    some = n > 0
    notes, begin, n = notes[some], begin[some], n[some]
    edges = np.searchsorted(np.cumsum(n), np.arange(0, int(n.sum()) + CELLS, CELLS), "right") if len(n) else np.zeros(0, int)
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        if a == b:
            continue
        starts = np.cumsum(n[a:b]) - n[a:b]
        cell = np.arange(int(n[a:b].sum())) + np.repeat(begin[a:b] - starts, n[a:b])
        note = np.repeat(notes[a:b], n[a:b])
        gap = np.abs(x.line[cell] - x.t[note])
        gap[(np.abs(x.score[cell] - x.pitch[note]) > 1) | (x.score[cell] == WILDCARD) | (gap > c.fill_within)] = np.inf
        least = np.minimum.reduceat(gap, starts)
        nearest = np.flatnonzero((gap == np.repeat(least, n[a:b])) & (gap < np.inf))[::-1]
        hit[note[nearest]] = cell[nearest]  # the first of equals is written last
    return hit


def _ordered(perf: pd.DataFrame, score: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
    return perf.sort_values(["t", "state_idx"], kind="stable").reset_index(drop=True), score.sort_values(["score_time_sec", "midi_pitch"], kind="stable").reset_index(drop=True)


def _arrays(perf: pd.DataFrame, score: pd.DataFrame) -> tuple[np.ndarray, ...]:
    sounding = perf["pitch"].notna().to_numpy()
    return perf["t"].to_numpy(float)[sounding], perf["pitch"].to_numpy(float)[sounding], score["score_time_sec"].to_numpy(float), score["midi_pitch"].to_numpy(float)


def align_session(perf: pd.DataFrame, score: pd.DataFrame, c: AlignConfig = AlignConfig()) -> pd.DataFrame:
    """perf: session_id, state_idx, t, pitch (null: no pitch); score: score_time_sec, midi_pitch, measure."""
    perf, score = _ordered(perf, score)
    t, pitch, s, notes = _arrays(perf, score)
    ratio, offset, pairs = 1.0, 0.0, []
    if len(t) and len(s):
        ratio = t.max() / s.max() if s.max() > 0.1 and t.max() > 0 else 1.0
        pairs = _align(t, pitch, s, notes, ratio, offset, c)
        if len(pairs) >= 2:
            x, y = s[[j for _, j in pairs]], t[[i for i, _ in pairs]]
            spread = ((x - x.mean()) ** 2).sum()
            slope = ((x - x.mean()) * (y - y.mean())).sum() / spread if spread > 1e-9 else 0.0
            if slope > 0:
                ratio, offset = slope, y.mean() - slope * x.mean()
                pairs = _align(t, pitch, s, notes, ratio, offset, c)
    return _matched(perf, score, pairs, ratio, offset, c)


def align(perf: DataFrame, score: DataFrame, config: AlignConfig = AlignConfig()) -> DataFrame:
    """Every performed note with what it was matched to. perf: session_id, state_idx, t, pitch; score: session_id,
    score_time_sec, midi_pitch, measure."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        # a side without rows comes without columns
        left = left.reindex(columns=["session_id", "state_idx", "t", "pitch"]).dropna(subset=["session_id"])
        right = right.reindex(columns=["score_time_sec", "midi_pitch", "measure"]).dropna(subset=["score_time_sec"])
        return align_session(left, right, config)

    return dealt(perf, "session_id").groupBy("session_id").cogroup(dealt(score, "session_id").groupBy("session_id")).applyInPandas(run, OUT)


@dataclass(frozen=True)
class _Groups:
    """Rows of whole groups, a group's notes before its score notes, both in their order."""

    session: np.ndarray
    block: np.ndarray
    together: np.ndarray
    state: pa.Array
    x: np.ndarray
    pitch: np.ndarray
    measure: np.ndarray
    no_measure: np.ndarray
    ratio: np.ndarray
    offset: np.ndarray
    is_line: np.ndarray

    @staticmethod
    def of(rows: pa.Table) -> _Groups:
        at = {n: rows.column(n).combine_chunks() for n in rows.column_names}
        whole = lambda n: at[n].fill_null(0).to_numpy(zero_copy_only=False)
        real = lambda n: at[n].to_numpy(zero_copy_only=False)
        no_measure = at["measure"].is_null().to_numpy(zero_copy_only=False)
        return _Groups(whole("session_id"), whole("_block"), whole("_together"), at["state_idx"], real("_x"), real("pitch"), whole("measure"), no_measure, real("ratio"), real("offset"), whole("_line") == 1)

    def slices(self, length: float, margin: float, c: AlignConfig) -> tuple[_Slices, np.ndarray, np.ndarray]:
        """The slices that have notes with a pitch of their own, and the rows of notes with a pitch and of score notes."""
        new = np.ones(len(self.session), bool)
        new[1:] = (self.session[1:] != self.session[:-1]) | (self.block[1:] != self.block[:-1])
        group = np.cumsum(new) - 1
        rows, lines = np.flatnonzero(~self.is_line & ~np.isnan(self.x) & ~np.isnan(self.pitch)), np.flatnonzero(self.is_line)
        t, s = self.x[rows], self.x[lines]
        n_groups = int(group[-1]) + 1 if len(group) else 0
        edges = lambda at: (np.searchsorted(group[at], np.arange(n_groups)), np.searchsorted(group[at], np.arange(n_groups), "right"))
        (t_begin, t_end), (s_begin, s_end) = edges(rows), edges(lines)
        ratio, offset = self.ratio[new], self.offset[new]
        line = s * self.ratio[lines] + self.offset[lines]
        # the score notes within the band of every note
        of = group[rows]
        want = (t - offset[of]) / ratio[of]
        first, last = _found(s, s_begin[of], s_end[of], want - c.band), _found(s, s_begin[of], s_end[of], want + c.band, right=True)
        # a slice: notes of a group, one after another, whose own stretch it is
        number = np.floor(t / length)
        mine = np.flatnonzero(np.floor(number / self.together[rows]) == self.block[rows])
        starts = np.ones(len(mine), bool)
        starts[1:] = (of[mine][1:] != of[mine][:-1]) | (number[mine][1:] != number[mine][:-1])
        own_begin = mine[starts]
        own_end = own_begin + np.diff(np.append(np.flatnonzero(starts), len(mine)))
        q, g = number[own_begin], of[own_begin]
        wide = margin + c.fill_within + c.band * self.ratio[lines]
        return _Slices(
            t, self.pitch[rows], s, self.pitch[lines], line, first, last,
            _found(np.floor((t + margin) / length), t_begin[g], t_end[g], q), _found(np.floor((t - margin) / length), t_begin[g], t_end[g], q, right=True),
            own_begin, own_end,
            _found(np.floor((line + wide) / length), s_begin[g], s_end[g], q), _found(np.floor((line - wide) / length), s_begin[g], s_end[g], q, right=True),
            ratio[g], offset[g],
        ), rows, lines


def _whole_groups(batches: Iterator[pa.RecordBatch], kernel: Callable[[_Groups], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``kernel`` over some ``ROWS`` rows at a time that end where a group ends; the groups come one after another."""
    held: list[pa.RecordBatch] = []
    n, ask = 0, ROWS
    for batch in batches:
        held.append(batch)
        n += len(batch)
        if n < ask:
            continue
        rows = pa.Table.from_batches(held)
        session, block = (rows.column(k).combine_chunks().to_numpy(zero_copy_only=False) for k in ("session_id", "_block"))
        ends = np.flatnonzero((session != session[-1]) | (block != block[-1]))
        cut = int(ends[-1]) + 1 if len(ends) else 0
        if cut:
            yield kernel(_Groups.of(rows.slice(0, cut)))
        held, n = rows.slice(cut).to_batches(), len(rows) - cut
        ask = max(ROWS, 2 * n)
    if n:
        yield kernel(_Groups.of(pa.Table.from_batches(held)))


def align_slices(perf: DataFrame, score: DataFrame, length: float, margin: float, config: AlignConfig = AlignConfig()) -> DataFrame:
    """The same for sessions of any length: slices of ``length`` seconds, each with ``margin`` seconds more on both sides,
    are aligned on their own, and each answers for the notes of its own stretch. Some neighbouring slices of a session make
    a group, the fewer the more notes the session has, and a task works off the slices of many groups together.

    Tempo and offset are those of the whole session, from regressions over the pairs of all slices. The band ties a note to
    score notes near its expected time, and two paths that meet go on alike, so with a margin of some bands a slice's path
    is the whole session's wherever that does not hang on a longer stretch."""
    c = config
    spark = perf.sparkSession
    ship(spark)
    number = lambda name: F.nanvl(F.col(name).cast("double"), F.lit(None).cast("double"))
    # both sides may come from one table: columns under new ids are told apart in the joins
    fresh = lambda df: df.select(*(F.col(n).alias(n) for n in df.columns))
    none = F.lit(None).cast("bigint")
    notes = perf.select(F.col("session_id").cast("bigint").alias("session_id"), F.lit(0).alias("_line"), number("t").alias("_x"), F.col("state_idx").cast("bigint").alias("state_idx"), number("pitch").alias("pitch"), none.alias("measure"))
    lines = score.select(F.col("session_id").cast("bigint").alias("session_id"), F.lit(1).alias("_line"), number("score_time_sec").alias("_x"), none.alias("state_idx"), number("midi_pitch").alias("pitch"), F.col("measure").cast("bigint").alias("measure"))
    lines = lines.where("_x IS NOT NULL")

    cut = lambda at: F.floor(at / length)
    spans = notes.groupBy("session_id").agg(F.max(F.when(F.col("pitch").isNotNull(), F.col("_x"))).alias("_t"), F.coalesce(cut(F.min("_x")), F.lit(0)).alias("_first"), F.coalesce(cut(F.max("_x")), F.lit(0)).alias("_last"), F.count("*").alias("_n"))
    spans = spans.join(fresh(lines).groupBy("session_id").agg(F.max("_x").alias("_s")), "session_id", "left")
    ratio = F.when((F.col("_s") > 0.1) & (F.col("_t") > 0), F.col("_t") / F.col("_s")).otherwise(1.0)
    together = F.least(F.greatest(F.floor((F.col("_last") - F.col("_first") + 1) * NOTES / F.col("_n")), F.lit(1)), F.lit(TOGETHER))
    fits = spans.select("session_id", ratio.alias("ratio"), F.lit(0.0).alias("offset"), "_first", "_last", together.alias("_together"))

    def grouped(rows: DataFrame, fits: DataFrame, lo: Column, hi: Column) -> DataFrame:
        """``rows`` in every group from the slice of lo to that of hi, but for slices before the session's first note or after
        its last, which have no note to answer for. Notes without a time are in the first group."""
        ends = fresh(rows).join(fresh(fits), "session_id").withColumn("_lo", F.greatest(lo, "_first")).withColumn("_hi", F.least(F.coalesce(hi, "_first"), "_last"))
        groups = F.sequence(F.floor(F.col("_lo") / F.col("_together")), F.floor(F.col("_hi") / F.col("_together")))
        return ends.where("_lo <= _hi").select("session_id", F.explode(groups).alias("_block"), "_together", "_line", "_x", "state_idx", "pitch", "measure", "ratio", "offset")

    def passed(fits: DataFrame, schema: str, kernel: Callable[[_Groups], pa.RecordBatch]) -> DataFrame:
        """``kernel`` over all groups' notes, score notes, tempo and offset."""
        x = F.col("_x")
        at, wide = x * F.col("ratio") + F.col("offset"), F.lit(margin + c.fill_within) + F.lit(c.band) * F.col("ratio")
        rows = grouped(notes, fits, cut(x - margin), cut(x + margin)).unionAll(grouped(lines, fits, cut(at - wide), cut(at + wide)))
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
        order = ["session_id", "_block", "_line", *(F.asc_nulls_last(k) for k in ("_x", "state_idx", "pitch", "measure"))]
        dealt_rows = rows.repartition(parts, "session_id", "_block").sortWithinPartitions(*order)
        return dealt_rows.mapInArrow(lambda batches: _whole_groups(batches, kernel), schema)

    def lines_of(groups: _Groups) -> pa.RecordBatch:
        """Times of the pairs whose performed note is the slice's own."""
        slices, rows, _ = groups.slices(length, margin, c)
        hit = _hits(slices, c)
        paired = np.flatnonzero(hit >= 0)
        return pa.RecordBatch.from_arrays([pa.array(groups.session[rows[paired]]), pa.array(slices.t[paired]), pa.array(slices.s[hit[paired]])], ["session_id", "t", "s"])

    def matches(groups: _Groups) -> pa.RecordBatch:
        slices, rows, lines = groups.slices(length, margin, c)
        paired = _hits(slices, c)
        full = _filled(slices, paired, c)
        hit, filled = np.full(len(groups.x), -1), np.zeros(len(groups.x), bool)
        hit[rows[full >= 0]] = lines[full[full >= 0]]
        filled[rows] = (full >= 0) & (paired < 0)
        with np.errstate(invalid="ignore"):
            own = np.flatnonzero(~groups.is_line & (np.isnan(groups.x) | (np.floor(np.floor(groups.x / length) / groups.together) == groups.block)))
        hit, filled = hit[own], filled[own]
        lost, at = hit < 0, np.maximum(hit, 0)
        second, note = groups.x[at], groups.pitch[at]
        wild = ~lost & (note == WILDCARD)
        silent = lost | wild | np.isnan(note)
        off = np.round((groups.x[own] - (second * groups.ratio[own] + groups.offset[own])) * 1000, 1)
        found = {
            "session_id": pa.array(groups.session[own]), "state_idx": groups.state.take(pa.array(own)), "matched": pa.array(~lost), "measure": pa.array(groups.measure[at], mask=lost | groups.no_measure[at]),
            "score_time_sec": pa.array(second, mask=lost), "score_midi_pitch": pa.array(np.where(silent, 0, note).astype(np.int32), mask=silent), "matched_to_wildcard": pa.array(wild),
            "timing_offset_ms": pa.array(off, mask=lost), "filled": pa.array(filled),
        }
        return pa.RecordBatch.from_arrays(list(found.values()), list(found))

    first = passed(fits, "session_id bigint, t double, s double", lines_of)
    line = first.groupBy("session_id").agg(F.regr_slope("t", "s").alias("slope"), F.regr_intercept("t", "s").alias("start"), F.count("*").alias("n"), (F.var_pop("s") * F.count("*")).alias("spread"))
    good = (F.col("n") >= 2) & (F.col("spread") > 1e-9) & (F.col("slope") > 0)
    better = fresh(fits).join(fresh(line), "session_id", "left").select("session_id", F.when(good, F.col("slope")).otherwise(F.col("ratio")).alias("ratio"), F.when(good, F.col("start")).otherwise(F.col("offset")).alias("offset"), "_first", "_last", "_together")
    return passed(better, OUT, matches)

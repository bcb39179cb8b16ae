"""Standard MIDI files as notes with seconds and bars: a map over files, one file a row."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from scorelake.operators.cluster import ship

NOTES = "path string, staff int, track_name string, midi_pitch int, start_sec double, duration_sec double, measure int, start_tick bigint"

#: What holds until a file says otherwise: microseconds a quarter (120 quarters a minute) and the meter.
TEMPO, METER = 500_000, (4, 4)


@dataclass
class Song:
    """What a file holds, in ticks: notes (track, channel, program, pitch, start, end), tempos (tick, microseconds a
    quarter), meters (tick, beats, beat type), names of tracks, and ticks a quarter (or seconds a tick)."""

    division: int = 480
    tick_sec: float | None = None
    notes: list[tuple[int, int, int, int, int, int]] = field(default_factory=list)
    tempos: list[tuple[int, int]] = field(default_factory=list)
    meters: list[tuple[int, int, int]] = field(default_factory=list)
    names: dict[int, str] = field(default_factory=dict)

    def seconds(self, ticks) -> np.ndarray:
        """Seconds at ticks, every tempo holding from its tick on."""
        ticks = np.asarray(ticks, np.int64)
        if self.tick_sec is not None:
            return ticks * self.tick_sec
        tempos = dict(sorted([(0, TEMPO), *self.tempos], key=lambda x: x[0]))  # of several at one tick the last holds
        at, each = np.array(list(tempos), np.int64), np.array(list(tempos.values())) / 1e6 / self.division
        upto = np.concatenate([[0.0], np.cumsum(np.diff(at) * each[:-1])])
        k = np.searchsorted(at, ticks, side="right") - 1
        return upto[k] + (ticks - at[k]) * each[k]

    def measures(self, ticks) -> np.ndarray:
        """Bars, counted from 1. A change of meter starts a bar, even where the one before is not full."""
        meters = sorted({t: (b, u) for t, b, u in [(0, *METER), *self.meters]}.items())
        at = np.array([t for t, _ in meters], np.int64)
        beats, unit = (np.array([m[k] for _, m in meters], np.int64) for k in (0, 1))
        length = np.maximum(1, 4 * beats * self.division // unit)
        full = np.concatenate([[0], np.cumsum(-(-np.diff(at) // length[:-1]))])
        ticks = np.asarray(ticks, np.int64)
        k = np.searchsorted(at, ticks, side="right") - 1
        return 1 + full[k] + (ticks - at[k]) // length[k]


def _number(data: bytes, at: int) -> tuple[int, int]:
    """A number of seven bits a byte, the last byte below 128, and where it ends."""
    value = 0
    while True:
        value, byte = value << 7 | data[at] & 127, data[at]
        at += 1
        if byte < 128:
            return value, at


def _track(song: Song, track: int, data: bytes) -> None:
    tick = at = 0
    status = 0
    program = [0] * 16
    open_notes: dict[tuple[int, int], list[tuple[int, int]]] = {}
    while at < len(data):
        step, at = _number(data, at)
        tick += step
        if data[at] >= 128:
            status = data[at]
            at += 1
        if status == 0xFF:
            kind = data[at]
            size, at = _number(data, at + 1)
            body = data[at : at + size]
            at += size
            if kind == 0x2F:
                return
            if kind == 0x51 and size == 3:
                song.tempos.append((tick, int.from_bytes(body)))
            elif kind == 0x58 and size >= 2:
                song.meters.append((tick, max(1, body[0]), 1 << body[1]))
            elif kind == 0x03:
                song.names.setdefault(track, body.decode("utf-8", "replace"))
        elif status in (0xF0, 0xF7):
            size, at = _number(data, at)
            at += size
        else:
            kind, channel = status >> 4, status & 15
            first = data[at]
            if kind == 0xC:
                program[channel] = first
            elif kind in (8, 9):
                velocity = data[at + 1]
                key = channel, first
                if kind == 9 and velocity:
                    open_notes.setdefault(key, []).append((tick, program[channel]))
                else:
                    # every open note of the key ends, but for those that began at this very tick
                    for start, by in open_notes.get(key, []):
                        if start < tick:
                            song.notes.append((track, channel, by, first, start, tick))
                    open_notes[key] = [n for n in open_notes.get(key, []) if n[0] == tick]
            at += 1 if kind in (0xC, 0xD) else 2


def parsed(content: bytes) -> Song:
    """A file of format 0, 1 or 2. What is no MIDI file, or ends within a track, raises ValueError."""
    if content[:4] != b"MThd" or len(content) < 14:
        raise ValueError("not a MIDI file")
    size, _, tracks, division = struct.unpack(">IHHH", content[4:14])
    song = Song(division=max(1, division))
    if division & 0x8000:
        song.tick_sec = 1 / ((256 - (division >> 8)) * max(1, division & 255))
    at = 8 + size
    track = 0
    while track < tracks and at + 8 <= len(content):
        kind, size = content[at : at + 4], int.from_bytes(content[at + 4 : at + 8])
        at += 8
        if kind == b"MTrk":
            if at + size > len(content):
                raise ValueError("a track is cut short")
            try:
                _track(song, track, content[at : at + size])
            except IndexError as error:
                raise ValueError("a track ends within an event") from error
            track += 1
        at += size
    return song


def note_lists(path: str, content: bytes) -> list[tuple]:
    """The notes of a file by start and pitch, in the columns of NOTES. A staff is a track, channel and program, counted in
    the order of the file; it has its track's name, or a number if that has none."""
    song = parsed(content)
    if not song.notes:
        return []
    staves = {s: k for k, s in enumerate(sorted({n[:3] for n in song.notes}))}
    names = {s: song.names.get(s[0]) or f"track{k}" for s, k in staves.items()}
    start, end = (np.array([n[k] for n in song.notes], np.int64) for k in (4, 5))
    sec = song.seconds(start)
    rows = zip(song.notes, sec.tolist(), (song.seconds(end) - sec).tolist(), song.measures(start).tolist(), strict=True)
    out = [(path, staves[n[:3]], names[n[:3]], n[3], at, lasts, measure, n[4]) for n, at, lasts, measure in rows]
    return sorted(out, key=lambda r: (r[4], r[3], r[1]))


COLUMNS = [c.split()[0] for c in NOTES.split(", ")]


def note_rows(path: str, content: bytes) -> pd.DataFrame:
    """The same as a data frame."""
    return pd.DataFrame(note_lists(path, content), columns=COLUMNS)


#: Fixed value: notes that leave a task at a time, since a data frame for every small file costs more than its notes.
AT_ONCE = 20_000


def notes_of(files: DataFrame, lenient: bool = True) -> DataFrame:
    """The notes of all ``files`` (path, content). A file that cannot be read has none, or fails the job."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    held += note_lists(path, content)
                except ValueError as error:
                    if not lenient:
                        raise ValueError(f"{path}: {error}") from error
                if len(held) >= AT_ONCE:
                    yield pd.DataFrame(held, columns=COLUMNS)
                    held = []
        if held:
            yield pd.DataFrame(held, columns=COLUMNS)

    ship(files.sparkSession)
    return files.select("path", "content").mapInPandas(run, NOTES)


def read_midi(spark: SparkSession, path: str, lenient: bool = True) -> DataFrame:
    """The notes of every file under ``path``; files are read in parallel."""
    return notes_of(spark.read.format("binaryFile").load(path), lenient)


def _written(value: int) -> bytes:
    out = [value & 127]
    while value := value >> 7:
        out.append(128 | value & 127)
    return bytes(reversed(out))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return kind + len(body).to_bytes(4) + body


def encoded(song: Song, one_track: bool = False, running: bool = True) -> bytes:
    """A file of format 1 (tempos and meters, then a track for each of the song's), or of format 0. ``running`` leaves out
    a status byte that repeats."""
    head = [(t, 0, b"\xff\x51\x03" + us.to_bytes(3)) for t, us in song.tempos] + [(t, 0, bytes([0xFF, 0x58, 4, b, u.bit_length() - 1, 24, 8])) for t, b, u in song.meters]
    parts: dict[int, list] = {}
    for track, channel, program, pitch, start, end in song.notes:
        part = parts.setdefault(0 if one_track else track, [])
        part += [(start, 2, bytes([0x90 | channel, pitch, 80])), (end, 1, bytes([0x90 | channel, pitch, 0]))]
        if program:
            part.append((0, 0, bytes([0xC0 | channel, program])))
    lists = [head + parts.get(0, [])] if one_track else [head, *(parts[k] for k in sorted(parts))]
    names = [None] if one_track else [None, *(song.names.get(k) for k in sorted(parts))]
    out = [_chunk(b"MThd", struct.pack(">HHH", 0 if one_track else 1, len(lists), song.division))]
    for events, name in zip(lists, names, strict=True):
        body, now, last = bytearray(), 0, None
        if name:
            body += b"\x00\xff\x03" + _written(len(name.encode())) + name.encode()
        for tick, _, event in sorted(events, key=lambda e: e[:2]):
            body += _written(tick - now) + (event[1:] if running and event[0] == last and event[0] < 0xF0 else event)
            now, last = tick, event[0]
        out.append(_chunk(b"MTrk", bytes(body) + b"\x00\xff\x2f\x00"))
    return b"".join(out)

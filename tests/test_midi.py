"""MIDI files written byte by byte and by the encoder."""

import random
from fractions import Fraction

import pytest

from scorelake.sources import midi


def song(seed, tracks=3):
    draw = random.Random(seed)
    s = midi.Song(division=draw.choice([96, 480, 960]))
    for track in range(tracks):
        s.names[track] = f"part {track}"
        for pitch in draw.sample(range(30, 90), 8):
            t = 0
            for _ in range(6):
                t += draw.randrange(1, 700)
                end = t + draw.randrange(1, 500)
                s.notes.append((track, track, 0, pitch, t, end))
                t = end
    s.tempos = [(t, draw.randrange(200_000, 900_000)) for t in sorted(draw.sample(range(6_000), 5))]
    s.meters = [(0, 3, 4), (draw.randrange(500, 3_000), 7, 8), (draw.randrange(3_001, 6_000), 2, 2)]
    return s


def plain_seconds(s, tick):
    total, now, us = Fraction(0), 0, midi.TEMPO
    for t, v in [*sorted(s.tempos), (10**9, 0)]:
        stop = min(t, tick)
        total += Fraction(us * (stop - now), 1_000_000 * s.division)
        now, us = stop, v
        if now == tick:
            break
    return float(total)


def plain_measure(s, tick):
    """Bar by bar from the start."""
    bar, at = 0, 0
    meters = dict([(0, midi.METER), *((t, (b, u)) for t, b, u in s.meters)])
    changes = sorted(meters)
    while True:
        b, u = meters[max(c for c in changes if c <= at)]
        nxt = min([at + 4 * b * s.division // u, *(c for c in changes if c > at)])
        bar += 1
        if tick < nxt:
            return bar
        at = nxt


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize(("one_track", "running"), [(False, True), (False, False), (True, True)])
def test_round_trip_with_tempo_and_meter_changes(seed, one_track, running):
    s = song(seed)
    rows = midi.note_rows("x", midi.encoded(s, one_track, running))
    want = sorted((n[4], n[3], n[1], plain_seconds(s, n[4]), plain_seconds(s, n[5]) - plain_seconds(s, n[4]), plain_measure(s, n[4])) for n in s.notes)
    got = sorted(zip(rows["start_tick"], rows["midi_pitch"], rows["staff"], rows["start_sec"], rows["duration_sec"], rows["measure"], strict=True))
    assert [g[:3] + g[5:] for g in got] == [w[:3] + w[5:] for w in want]
    for g, w in zip(got, want, strict=True):
        assert abs(g[3] - w[3]) < 1e-9 and abs(g[4] - w[4]) < 1e-9
    assert rows["start_sec"].is_monotonic_increasing
    assert set(rows["track_name"]) == ({"track0", "track1", "track2"} if one_track else {"part 0", "part 1", "part 2"})


def by_hand(events, division=b"\x00\x60", tracks=1):
    return b"MThd\x00\x00\x00\x06\x00\x01" + tracks.to_bytes(2) + division + b"".join(b"MTrk" + len(e).to_bytes(4) + e for e in events)


def test_bytes_by_hand():
    end = b"\x00\xff\x2f\x00"
    # running status, a delta of two bytes, sysex and controllers between, off by velocity 0 and by its own status
    track = b"\x00\x90\x3c\x40" + b"\x81\x40\x3c\x00" + b"\x00\xf0\x02\x01\xf7" + b"\x00\xb0\x07\x64" + b"\x00\x90\x40\x40" + b"\x60\x80\x40\x00" + end
    rows = midi.note_rows("x", by_hand([track]))
    assert rows[["midi_pitch", "start_tick"]].values.tolist() == [[60, 0], [64, 192]]
    assert rows["start_sec"].tolist() == [0.0, 1.0] and rows["duration_sec"].tolist() == [1.0, 0.5]
    # one off ends both open notes of a key; one begun at its tick stays open, and what never ends is no note
    track = b"\x00\x90\x3c\x40\x30\x3c\x40\x30\x3c\x00\x00\x3e\x40" + end
    assert midi.note_rows("x", by_hand([track]))["start_tick"].tolist() == [0, 48]
    # 25 frames of 40 ticks: a millisecond a tick, whatever the tempo
    track = b"\x00\xff\x51\x03\x01\x00\x00\x87\x68\x90\x3c\x40\x83\x74\x3c\x00" + end
    rows = midi.note_rows("x", by_hand([track], b"\xe7\x28"))
    assert rows["start_sec"].tolist() == [pytest.approx(1.0)] and rows["duration_sec"].tolist() == [pytest.approx(0.5)]


def test_broken_files(spark, tmp_path):
    good = midi.encoded(song(1))
    for name, content in {"a.mid": good, "b.mid": b"RIFF" + good, "c.mid": good[:-9], "d.mid": b"", "e.mid": by_hand([b"\x00\x90\x3c"])}.items():
        (tmp_path / name).write_bytes(content)
    got = midi.read_midi(spark, str(tmp_path))
    assert {r.path.rsplit("/", 1)[1] for r in got.select("path").distinct().collect()} == {"a.mid"} and got.count() == len(song(1).notes)
    with pytest.raises(Exception, match="not a MIDI file"):
        midi.read_midi(spark, str(tmp_path / "b.mid"), lenient=False).count()
    assert len(midi.note_rows("x", midi.encoded(midi.Song()))) == 0

"""Recordings and scores from files: WAV samples and MusicXML notes, read with binaryFile and parsed in a map."""

from __future__ import annotations

import io
import wave
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from scorelake.operators.cluster import ship

NOTES = "path string, part int, measure int, start_quarter double, start_sec double, duration_sec double, midi_pitch int, staff int"


def read_wav(spark: SparkSession, path: str, start: float = 0.0, end: float | None = None) -> DataFrame:
    """path, rate, samples (-1 to 1, channels averaged) of 16-bit PCM files, cut to a window in seconds."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                with wave.open(io.BytesIO(content)) as w:
                    rate, channels = w.getframerate(), w.getnchannels()
                    w.setpos(min(w.getnframes(), int(start * rate)))
                    n = w.getnframes() - w.tell() if end is None else max(0, int(end * rate) - w.tell())
                    x = np.frombuffer(w.readframes(n), "<i2").reshape(-1, channels).mean(1) / 32768
                yield pd.DataFrame({"path": [name], "rate": [rate], "samples": [x.astype(np.float32)]})

    ship(spark)
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, rate int, samples array<float>")


_STEPS = {"C": 0, "D": 2, "E": 4, "F": 5, "G": 7, "A": 9, "B": 11}


def _document(content: bytes) -> ElementTree.Element:
    """The score of a plain or zipped file."""
    if content[:2] == b"PK":
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            name = next(n for n in z.namelist() if n.endswith((".xml", ".musicxml")) and not n.startswith("META-INF"))
            content = z.read(name)
    return ElementTree.fromstring(content)


def score_rows(path: str, content: bytes, ghosts: int = 4) -> list[tuple]:
    """The notes of a score in the order of the file. A cursor moves with notes, backups and forwards; chord notes start
    with the note before them, grace notes take no time; a measure lasts as long as its meter says. An empty measure
    gets ``ghosts`` placeholders of pitch -1. Seconds add up over the score's tempos, each of which holds, for all parts,
    from where it stands on."""
    notes, tempos = [], {0.0: 120.0}
    for p, part in enumerate(_document(content).iter("part")):
        divisions, beats, beat_type, measure_start, number = 1, 4, 4, 0.0, 0
        for measure in part.findall("measure"):
            number += 1
            cursor = lead = 0.0
            rows = []
            for node in measure:
                if node.tag == "attributes":
                    divisions = int(node.findtext("divisions") or divisions)
                    beats, beat_type = int(node.findtext("time/beats") or beats), int(node.findtext("time/beat-type") or beat_type)
                elif node.tag == "direction" or node.tag == "sound":
                    sound = node if node.tag == "sound" else node.find("sound")
                    if sound is not None and float(sound.get("tempo") or 0) > 0:
                        tempos[measure_start + cursor] = float(sound.get("tempo"))
                elif node.tag in ("backup", "forward"):
                    cursor += int(node.findtext("duration")) / divisions * (1 if node.tag == "forward" else -1)
                elif node.tag == "note":
                    length = 0.0 if node.find("grace") is not None else int(node.findtext("duration") or 0) / divisions
                    at = lead if node.find("chord") is not None else cursor
                    if node.find("chord") is None:
                        lead, cursor = cursor, cursor + length
                    if node.find("pitch") is not None:
                        midi = _STEPS[node.findtext("pitch/step")] + int(float(node.findtext("pitch/alter") or 0)) + 12 * (int(node.findtext("pitch/octave")) + 1)
                        rows.append((at, length, midi, int(node.findtext("staff") or p + 1)))
            nominal = beats * 4 / beat_type
            rows = rows or [(nominal * k / ghosts, nominal / ghosts, -1, p + 1) for k in range(ghosts)]
            notes += [(p, number, measure_start + at, length, midi, staff) for at, length, midi, staff in rows]
            measure_start += nominal
    at, each = np.array(sorted(tempos)), 60 / np.array([tempos[t] for t in sorted(tempos)])
    upto = np.concatenate([[0.0], np.cumsum(np.diff(at) * each[:-1])])

    def seconds(quarter: float) -> float:
        k = int(np.searchsorted(at, quarter, side="right")) - 1
        return float(upto[k] + (quarter - at[k]) * each[k])

    return [(path, p, number, quarter, seconds(quarter), seconds(quarter + length) - seconds(quarter), midi, staff) for p, number, quarter, length, midi, staff in notes]


def read_musicxml(spark: SparkSession, path: str) -> DataFrame:
    """The notes of every score under ``path``; one file is one row to parse, files are read in parallel."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [r for name, content in zip(batch["path"], batch["content"], strict=True) for r in score_rows(name, content)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in NOTES.split(", ")])

    ship(spark)
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, NOTES)

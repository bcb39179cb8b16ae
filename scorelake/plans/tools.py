"""Named, parameterised queries over a folder of tables: the tool surface.

A tool has a name, a description, the arguments it takes and a builder (spark, sf_dir, arguments) -> DataFrame. Guards
are checked on the driver before any plan is built and come back as an error row; so does an unknown tool."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.operators import signal
from scorelake.plans import measures, relations, rhythm, rules, sessions
from scorelake.sources.bindings import frames, perf_notes


@dataclass(frozen=True)
class Tool:
    name: str
    description: str
    arguments: dict[str, type]
    build: Callable[[SparkSession, str, dict], DataFrame]
    longest: float | None = None


TOOLS: dict[str, Tool] = {}


def register(tool: Tool) -> Tool:
    if tool.name in TOOLS:
        raise ValueError(f"tool {tool.name} is registered twice")
    TOOLS[tool.name] = tool
    return tool


def error(spark: SparkSession, message: str) -> DataFrame:
    return spark.createDataFrame([(message,)], "error string")


def call(spark: SparkSession, sf_dir: str, name: str, arguments: dict) -> DataFrame:
    """Run a tool; a wrong name, wrong arguments or too long a window give an error row."""
    tool = TOOLS.get(name)
    if tool is None:
        return error(spark, f"unknown tool: {name}")
    for key, kind in tool.arguments.items():
        if key not in arguments:
            return error(spark, f"{name} needs {key}")
        try:
            arguments = arguments | {key: kind(arguments[key])}
        except (TypeError, ValueError):
            return error(spark, f"{name}: {key} is not {kind.__name__}")
    if tool.longest is not None and not 0 < arguments["end"] - arguments["start"] <= tool.longest:
        return error(spark, f"{name}: the window must be longer than 0 and at most {tool.longest:g} s")
    return tool.build(spark, sf_dir, arguments)


def catalog(spark: SparkSession) -> DataFrame:
    """name, description, arguments of every tool."""
    return spark.createDataFrame([(t.name, t.description, ", ".join(t.arguments)) for t in TOOLS.values()], "name string, description string, arguments string")


def _notes(spark: SparkSession, sf_dir: str, a: dict) -> DataFrame:
    return perf_notes(spark, sf_dir).where(F.col("session_id") == a["session_id"])


_SESSION = {"session_id": int}
_BAR = _SESSION | {"measure": int}
_WINDOW = _SESSION | {"start": float, "end": float}

def _tracks(spark: SparkSession, sf_dir: str, a: dict) -> DataFrame:
    """The part of a pitch track inside a window."""
    cut = F.slice("hz", F.floor(F.lit(a["start"]) * 64).cast("int") + 1, F.lit(max(1, int((a["end"] - a["start"]) * 64))))
    return sessions.pitch_tracks(spark, sf_dir).where(F.col("session_id") == a["session_id"]).withColumn("hz", cut)


register(Tool("inspect_bar", "notes, outline and onsets of a bar", _BAR, lambda s, d, a: relations.bar_evidence(s, d, a["measure"]).where(F.col("session_id") == a["session_id"])))
register(Tool("inspect_note", "a note of a bar and pitch with the first other note of its kind near it", _BAR | {"pitch": int}, lambda s, d, a: relations.note_evidence(s, d).where((F.col("session_id") == a["session_id"]) & (F.col("measure") == a["measure"]) & (F.col("pitch") == a["pitch"]))))
register(Tool("measure_vibrato", "rate, depth and verdict of a vibrato", _WINDOW, lambda s, d, a: signal.vibrato(_tracks(s, d, a)), 5.0))
register(Tool("measure_trill", "rate, swing, evenness and verdict of a trill", _WINDOW, lambda s, d, a: signal.trills(_tracks(s, d, a)), 5.0))
register(Tool("watch", "frames of a window", _WINDOW, lambda s, d, a: frames(s, d).where((F.col("session_id") == a["session_id"]) & (F.col("frame_idx") / 100).between(a["start"], a["end"])).select("frame_idx"), 60.0))
register(Tool("measure_tempo", "a bar's duration against the median; a bar that was not played gives an error and the bars there are", _BAR, lambda s, d, a: rules.tempo_of_bar(rules.bar_durations(_notes(s, d, a)), s.range(1).select(F.lit(a["session_id"]).cast("bigint").alias("session_id"), F.lit(a["measure"]).cast("bigint").alias("measure")))))
register(Tool("measure_tempo_window", "the bars of a window against the median", _SESSION | {"first": int, "last": int}, lambda s, d, a: rules.tempo_of_window(rules.bar_durations(_notes(s, d, a)), a["first"], a["last"])))
register(Tool("measure_dynamics", "smoothed level of a window", _WINDOW, lambda s, d, a: measures.sig09(s, d).where(F.col("session_id") == a["session_id"]), 86_400.0 * 31))
register(Tool("inspect_intonation", "deviation by bar", _SESSION, lambda s, d, a: measures.agg07(s, d).where(F.col("session_id") == a["session_id"])))
register(Tool("inspect_voicing", "margins by bar", _SESSION, lambda s, d, a: measures.agg08(s, d).where(F.col("session_id") == a["session_id"])))
register(Tool("inspect_chord", "the strongest peaks of a window's mean spectrum", _SESSION | {"first": int, "last": int}, lambda s, d, a: rules.chord_peaks(frames(s, d).where(F.col("session_id") == a["session_id"]), a["first"], a["last"])))
register(Tool("list_frames", "frames of a session", _SESSION, lambda s, d, a: frames(s, d).where(F.col("session_id") == a["session_id"]).select("frame_idx")))
register(Tool("get_frames", "frames of a window or the nearest one", _WINDOW, lambda s, d, a: rules.frames_in(frames(s, d).where(F.col("session_id") == a["session_id"]).select("session_id", F.col("frame_idx").alias("vec_id")), a["start"], a["end"]), 600.0))
register(Tool("per_bar", "the rhythm report", _SESSION, lambda s, d, a: rhythm.per_bar(s, d).where(F.col("session_id") == a["session_id"])))
register(Tool("listen", "notes of a short window", _WINDOW, lambda s, d, a: _notes(s, d, a).where(F.col("t").between(a["start"], a["end"])), 86_400.0))

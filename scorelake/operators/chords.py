"""Chords measured in spectra: how loud each member speaks and lasts, when it speaks, what is left of the chord before;
and the findings about them.

Chords meet the frames of their window by session and bucket of frames; all else is aggregation by chord and member.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scorelake.operators import joins
from scorelake.operators.spectra import median_of


@dataclass(frozen=True)
class ChordConfig:
    """Seconds of a chord's onset and sustain, before its onset and after it in which its attack is looked
    for; share of the way to the peak that is an attack; level and ratio to the floor of a member that is there; level of
    residue that blurs. Bins: the pitch of the first one, how many an octave has, how many around a pitch count. Limits of
    findings: margins of a weak and of a buried melody, spreads of attacks, level of residue, and how many are told."""

    frame_sec: float = 0.02
    low_pitch: int = 21
    per_octave: int = 60
    reach: int = 2
    onset: float = 0.18
    sustain: float = 0.75
    before: float = 0.08
    curve: float = 0.30
    share: float = 0.55
    present_db: float = -18.0
    present_ratio: float = 1.4
    blur_db: float = -8.0
    weak_db: float = 3.0
    buried_db: float = 0.0
    spread_warn: float = 80.0
    spread_alert: float = 150.0
    most: int = 12


def _level(x: Column, reference: Column) -> Column:
    return F.round(F.lit(20.0) * F.log10(F.greatest(x, F.lit(1e-9)) / reference), 1)


def _attack(curve: Column, before: Column, c: ChordConfig) -> Column:
    """Milliseconds from the onset to the first frame that has come ``share`` of the way from the 10th percentile of a curve
    to its peak; null for a curve of fewer than four frames or without energy."""
    s, place = F.sort_array(curve), (F.size(curve) - 1) * 0.1
    low = F.floor(place).cast("int")
    floor = F.get(s, low) + (place - low) * (F.get(s, F.least(low + 1, F.size(s) - 1)) - F.get(s, low))
    peak = F.array_max(curve)
    first = F.array_position(F.transform(curve, lambda v: v >= floor + c.share * (peak - floor)), F.lit(True)) - 1
    return F.when((F.size(curve) >= 4) & (peak > 0), F.round((first - before) * c.frame_sec * 1000, 1))


def measured(chords: DataFrame, spectra: DataFrame, c: ChordConfig = ChordConfig()) -> DataFrame:
    """session_id, event, t, measure, members (pitch, role, onset_db, sustain_db, present, attack_ms), margin_db, bass_db,
    spread_ms, residue_db, blur of every chord of two pitches or more.

    chords: session_id, event, t, measure, pitches, in which single notes count as what was before; spectra: session_id,
    frame_idx, mag, frames ``frame_sec`` apart. Levels are relative to the chord's loudest member. A window ends where
    the next event begins; a chord without a frame in its onset is left out."""
    order = W.partitionBy("session_id").orderBy("t", "event")
    frame = lambda t: F.ceil(F.round(t / c.frame_sec, 9)).cast("bigint")
    pre, ahead = max(1, round(c.before / c.frame_sec)), round(c.curve / c.frame_sec)
    rows = chords.withColumn("pitches", F.array_sort(F.array_distinct("pitches"))).withColumn("next_t", F.lead("t").over(order)).withColumn("past", F.lag("pitches").over(order)).where(F.size("pitches") > 1)
    onset_end = F.least(F.col("t") + c.onset, F.coalesce("next_t", F.col("t") + c.onset))
    rows = rows.withColumn("onset_end", onset_end).withColumn("f0", frame(F.col("t")))
    sustain_end = F.least(F.col("t") + c.sustain, F.greatest(F.col("onset_end") + 0.05, F.coalesce("next_t", F.col("t") + c.sustain)))
    rows = rows.withColumn("f1", F.greatest(F.col("f0") + 1, frame(F.col("onset_end")))).withColumn("f2", F.greatest(F.col("f1") + 1, frame(sustain_end)))
    rows = rows.withColumn("a", F.greatest(F.lit(0), F.col("f0") - pre)).withColumn("b", F.col("f0") + ahead).withColumn("last", F.greatest("f2", "b") - 1)
    rows = rows.withColumn("gone", F.coalesce(F.array_except("past", "pitches"), F.expr("cast(array() as array<int>)")))
    met = joins.range_join(rows, spectra.select("session_id", "frame_idx", "mag"), ["session_id"], "a", "last", "frame_idx", 64.0)
    at = F.col("frame_idx")
    in_onset, in_sustain, in_curve = at.between(F.col("f0"), F.col("f1") - 1), at.between(F.col("f1"), F.col("f2") - 1), at.between(F.col("a"), F.col("b") - 1)
    keys = ["session_id", "event", "t", "measure"]
    floors = met.where(in_onset).groupBy(*keys).agg((median_of(F.flatten(F.collect_list("mag"))) + 1e-9).alias("floor"))
    centre = lambda p: F.round((p - c.low_pitch) * F.lit(c.per_octave / 12)).cast("int")
    voices = F.explode(F.concat(F.transform("pitches", lambda p: F.struct(p.alias("pitch"), F.lit(True).alias("own"))), F.transform("gone", lambda p: F.struct(p.alias("pitch"), F.lit(False).alias("own")))))
    heard = met.withColumn("voice", voices).withColumn("pitch", F.col("voice.pitch")).withColumn("own", F.col("voice.own"))
    low = F.greatest(F.lit(0), centre(F.col("pitch")) - c.reach)
    heard = heard.withColumn("v", F.array_max(F.slice("mag", low + 1, centre(F.col("pitch")) + c.reach - low + 1)))
    each = heard.groupBy(*keys, "pitch", "own", F.array_max("pitches").alias("top"), F.array_min("pitches").alias("low"), (F.col("f0") - F.col("a")).alias("lead")).agg(
        F.avg(F.when(in_onset, F.col("v"))).alias("onset"), F.avg(F.when(in_sustain, F.col("v"))).alias("sustain"), F.sort_array(F.collect_list(F.when(in_curve, F.struct("frame_idx", "v"))))["v"].alias("curve"),
    ).where("onset IS NOT NULL").join(floors, keys)
    chord = W.partitionBy(*keys)
    loudest = F.greatest(F.max(F.when(F.col("own"), F.col("onset"))).over(chord), F.lit(1e-9))
    each = each.withColumn("onset_db", _level(F.col("onset"), loudest)).withColumn("sustain_db", _level(F.coalesce("sustain", F.lit(0.0)), loudest)).withColumn("attack_ms", _attack(F.col("curve"), F.col("lead"), c))
    role = F.when(F.col("pitch") == F.col("top"), "melody").when(F.col("pitch") == F.col("low"), "bass").otherwise("inner")
    present = (F.col("onset_db") >= c.present_db) & (F.round(F.col("onset") / F.col("floor"), 2) >= c.present_ratio)
    member = F.struct("pitch", role.alias("role"), "onset_db", "sustain_db", present.alias("present"), "attack_ms")
    own, melody = F.col("own"), F.col("pitch") == F.col("top")
    found = each.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.when(own, member))).alias("members"), F.round(F.max(F.when(own & melody, F.col("onset_db"))) - F.max(F.when(own & ~melody, F.col("onset_db"))), 1).alias("margin_db"),
        F.max(F.when(own & (F.col("pitch") == F.col("low")), F.col("onset_db"))).alias("bass_db"), F.count(F.when(own, F.col("attack_ms"))).alias("_n"),
        F.round(F.max(F.when(own, F.col("attack_ms"))) - F.min(F.when(own, F.col("attack_ms"))), 1).alias("spread_ms"), F.max(F.when(~own, F.col("onset_db"))).alias("residue_db"),
    )
    return found.withColumn("spread_ms", F.when(F.col("_n") > 1, F.col("spread_ms"))).withColumn("blur", F.coalesce(F.col("residue_db") > c.blur_db, F.lit(False))).drop("_n")


def findings(rows: DataFrame, c: ChordConfig = ChordConfig()) -> DataFrame:
    """session_id, rule, rank, event, measure, severity, value: of each session and rule the worst chords, ``most`` at most:
    melodies under ``weak_db``, attacks that lie apart, residue of the chord before."""
    margin, spread, residue = F.col("margin_db"), F.col("spread_ms"), F.col("residue_db")
    rules = [
        ("melody", margin < c.weak_db, F.when(margin < c.buried_db, "alert").otherwise("warn"), margin, margin),
        ("attack", spread >= c.spread_warn, F.when(spread >= c.spread_alert, "alert").otherwise("warn"), spread, -spread),
        ("pedal", F.col("blur") | (residue > c.blur_db), F.lit("warn"), residue, -residue),
    ]
    parts = [
        rows.where(when).select("session_id", F.lit(name).alias("rule"), "event", "measure", severity.alias("severity"), value.alias("value"), worst.alias("_w"), "t") for name, when, severity, value, worst in rules
    ]
    both = parts[0].unionByName(parts[1]).unionByName(parts[2])
    rank = F.row_number().over(W.partitionBy("session_id", "rule").orderBy("_w", "t", "event"))
    return both.withColumn("rank", rank).where(F.col("rank") <= c.most).drop("_w", "t")

"""Instrument profiles by rules on a free text, the first rule that fits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Words of keyboard instruments, and the aliases of profiles.
KEYBOARDS = ("piano", "klavier", "keyboard", "harpsichord", "organ")
ALIASES = {"piano_solo": "piano", "piano_with_pedal": "piano"}


def profile_of(instrument: Column) -> Column:
    """The profile that an instrument's name suggests; null for an empty or an unknown one."""
    s = F.lower(F.trim(instrument))
    has = lambda *words: F.rlike(s, F.lit("|".join(words)))
    return (
        F.when(has(*KEYBOARDS), "piano")
        .when(has("violin") & has("solo", "alone", "unaccompanied"), "violin_solo")
        .when((s == "violin") | has("violino"), "violin_solo")
        .when(has("viola"), "viola_solo")
        .when(has("cello"), "cello_solo")
    )


def known_profile(profile: Column, known: list[str]) -> Column:
    """A profile's id after aliases, "default" if there is none."""
    key = F.coalesce(F.lower(F.trim(profile)), F.lit(""))
    named = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in ALIASES.items() for x in kv)), key), key)
    return F.when(named.isin(*known), named).otherwise(F.lit("default"))


# What each built-in profile says of an instrument and which limits its analyses use: pitch (fixed or
# variable), most voices at once, whether intonation is judged and how far a pitch is searched (cents), least distance of
# onsets (ms), least rise of an onset's peak, cents from which intonation is a warning and an alert, tools that are off.
COLUMNS = "profile string, instrument string, family string, pitch_class string, voices int, intonation boolean, search_cents int, onset_spacing_ms int, peak_delta double, warn_cents int, alert_cents int, disabled_tools array<string>"
PROFILES = (
    ("piano", "piano", "keyboard", "fixed", 10, False, None, 25, 0.10, None, None, ["inspect_intonation"]),
    ("violin_solo", "violin", "bowed_string", "variable", 4, True, 50, 80, 0.07, 15, 25, []),
    ("viola_solo", "viola", "bowed_string", "variable", 4, True, 50, 80, 0.07, 15, 25, []),
    ("cello_solo", "cello", "bowed_string", "variable", 4, True, 50, 80, 0.07, 15, 25, []),
    ("default", "musician", "unknown", "variable", 2, True, 50, 80, 0.07, 15, 25, []),
)


def profile_table(spark: SparkSession) -> DataFrame:
    """The built-in profiles, a row each."""
    return spark.createDataFrame(PROFILES, COLUMNS)


def with_profile(sessions: DataFrame, profile: Column) -> DataFrame:
    """``sessions`` with the limits of their profile, the default one where it is missing or unknown. There are five rows of
    profiles, which are broadcast."""
    known = known_profile(profile, [p[0] for p in PROFILES])
    return sessions.withColumn("profile", known).join(F.broadcast(profile_table(sessions.sparkSession)), "profile")

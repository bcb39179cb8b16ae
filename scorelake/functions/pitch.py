"""Pitch names, frequencies, temperament and spelling as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of the twelve pitch classes from C.
NAMES = ("C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B")
# Which sharps a key spells as flats.
FLATS_OF_KEY = {
    "f_major": {"A#": "Bb"},
    "bb_major": {"A#": "Bb", "D#": "Eb"},
    "eb_major": {"A#": "Bb", "D#": "Eb", "G#": "Ab"},
    "ab_major": {"A#": "Bb", "D#": "Eb", "G#": "Ab", "C#": "Db"},
    "db_major": {"A#": "Bb", "D#": "Eb", "G#": "Ab", "C#": "Db", "F#": "Gb"},
    "gb_major": {"A#": "Bb", "D#": "Eb", "G#": "Ab", "C#": "Db", "F#": "Gb"},
    "d_minor": {"A#": "Bb"},
    "g_minor": {"A#": "Bb", "D#": "Eb"},
    "c_minor": {"A#": "Bb", "D#": "Eb", "G#": "Ab"},
    "f_minor": {"A#": "Bb", "D#": "Eb", "G#": "Ab", "C#": "Db"},
    "bb_minor": {"A#": "Bb", "D#": "Eb", "G#": "Ab", "C#": "Db", "F#": "Gb"},
    "eb_minor": {"A#": "Bb", "D#": "Eb", "G#": "Ab", "C#": "Db", "F#": "Gb"},
}


def class_name(midi: Column) -> Column:
    return F.element_at(F.array(*(F.lit(n) for n in NAMES)), (F.pmod(midi, F.lit(12)) + 1).cast("int"))


def midi_name(midi: Column) -> Column:
    """60 -> C4; octaves by floor division, so that negative numbers name lower octaves."""
    return F.concat(class_name(midi), (F.floor(midi / 12) - 1).cast("string"))


def name_midi(name: Column) -> Column:
    """C#4, Db4 or a number -> MIDI number; null if it is neither."""
    letter, accidental, octave = (F.regexp_extract(F.trim(name), r"^([A-Ga-g])([#b]?)(-?\d+)$", i) for i in (1, 2, 3))
    base = F.element_at(F.create_map(*(F.lit(x) for p in (("C", 0), ("D", 2), ("E", 4), ("F", 5), ("G", 7), ("A", 9), ("B", 11)) for x in p)), F.upper(letter))
    shift = F.when(accidental == "#", 1).when(accidental == "b", -1).otherwise(0)
    named = F.when(letter != "", base + shift + (octave.try_cast("int") + 1) * 12)
    return F.coalesce(named, F.rint(F.trim(name).try_cast("double")).cast("int"))


def event_class(name: Column, note: Column, loudest: Column) -> Column:
    """The pitch class of an event: that of its own name, else that of its note, of which letters and sharps count, else
    that of its loudest pitch. A name that is none gives null, whatever else is there."""
    flats = {flat: NAMES.index(sharp) for sharp, flat in FLATS_OF_KEY["gb_major"].items()}
    number = F.create_map(*(F.lit(x) for kv in ({n: i for i, n in enumerate(NAMES)} | flats).items() for x in kv))
    plain = F.replace(F.replace(name, F.lit("♯"), F.lit("#")), F.lit("♭"), F.lit("b"))
    base = F.regexp_replace(F.replace(note, F.lit("♯"), F.lit("#")), r"[^\p{L}#]", "")
    return F.when(name.isNotNull(), F.element_at(number, plain)).when(note.isNotNull(), F.element_at(number, base)).otherwise(F.pmod(F.rint(loudest).cast("bigint"), F.lit(12)).cast("int"))


def midi_hz(midi: Column) -> Column:
    return F.lit(440.0) * F.pow(F.lit(2.0), (midi - 69) / F.lit(12.0))


def hz_midi(hz: Column) -> Column:
    return F.lit(69.0) + F.lit(12.0) * F.log2(hz / 440.0)


def log_bin(midi: Column, low_hz: float, per_octave: int) -> Column:
    """The bin of a logarithmic frequency axis."""
    return F.log2(midi_hz(midi) / low_hz) * per_octave


def cents(midi: Column) -> Column:
    """Distance from the nearest equal-tempered pitch, ties to even."""
    return (midi - F.rint(midi)) * 100


def decibels(x: Column, reference: float = 1.0, floor: float = 1e-9) -> Column:
    return F.lit(20.0) * F.log10(F.greatest(x, F.lit(floor)) / reference)


def spelled(name: Column, key: Column) -> Column:
    """A sharp name (also inside a sentence) as the key spells it. Keys are compared without regard to case, and with
    spaces and dashes as underscores; in a key without flats names stay as they are."""
    norm = F.regexp_replace(F.lower(F.trim(key)), "[ -]", "_")
    out = name
    for sharp, flat in FLATS_OF_KEY["gb_major"].items():
        keys = [key for key, flats in FLATS_OF_KEY.items() if sharp in flats]
        out = F.when(norm.isin(keys), F.replace(out, F.lit(sharp), F.lit(flat))).otherwise(out)
    return out


# The twelve intervals above a root, in cents, in just and in Pythagorean temperament.
JUST = (0.0, 111.73, 203.91, 315.64, 386.31, 498.04, 590.22, 701.96, 813.69, 884.36, 996.09, 1088.27)
PYTHAGOREAN = (0.0, 113.69, 203.91, 294.13, 407.82, 498.04, 611.73, 701.96, 815.64, 905.87, 1019.55, 1109.78)
# Major keys from seven flats to seven sharps.
KEYS = ("Cb", "Gb", "Db", "Ab", "Eb", "Bb", "F", "C", "G", "D", "A", "E", "B", "F#", "C#")


def best_temperament(deviation: Column, midi: Column, root: int = 0) -> Column:
    """The temperament from which a deviation (in cents from equal temperament) is least far, the first one on a tie."""
    interval = F.pmod(midi - root, F.lit(12)).cast("int")
    offset = lambda values: F.element_at(F.array(*map(F.lit, values)), interval + 1) - interval * F.lit(100.0)
    options = ((0, "12_tet", F.lit(0.0)), (1, "just", offset(JUST)), (2, "pythagorean", offset(PYTHAGOREAN)))
    return F.array_min(F.array(*(F.struct(F.abs(deviation - o).alias("d"), F.lit(i).alias("i"), F.lit(n).alias("name")) for i, n, o in options)))["name"]


def key_name(fifths: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, KEYS)), fifths + 8)


# From which amplitude a note is sure, from which mean probability of voicing it is sure or fairly sure, and
# the ratio of energy to the floor at which a note is present, twice of which makes it fairly sure.
SURE_AMPLITUDE, SURE_VOICING, FAIR_VOICING, PRESENT = 0.5, 0.85, 0.65, 1.5


def sure_by_amplitude(amplitude: Column) -> Column:
    return F.when(amplitude >= SURE_AMPLITUDE, "high").otherwise("medium")


def sure_by_voicing(probability: Column) -> Column:
    return F.when(probability >= SURE_VOICING, "high").when(probability >= FAIR_VOICING, "medium").otherwise("low")


def sure_by_harmonics(present: Column, harmonics: Column, ratio: Column, least: int = 1) -> Column:
    """A note that is there is sure with a harmonic or more, fairly sure with energy enough."""
    return F.when(~F.coalesce(present, F.lit(False)), "absent").when(harmonics >= least, "high").when(ratio >= 2 * PRESENT, "medium").otherwise("low")


def spelled_text(told: Column, key: Column) -> Column:
    """A sentence with its sharp names, octaves and all, as the key spells them. A name is a word of its own: letters,
    digits or underscores before it, or letters behind it, make it part of another."""
    norm = F.regexp_replace(F.lower(F.trim(key)), "[ -]", "_")
    out = told
    for name, flats in FLATS_OF_KEY.items():
        new = told
        for sharp, flat in flats.items():
            new = F.regexp_replace(new, rf"\b{sharp}(?=-?\d*(?:\b|[^A-Za-z0-9_]|$))(?![A-Za-z_])", flat)
        out = F.when(norm == name, new).otherwise(out)
    return out

"""Queries over files and sound: MIDI, page layout, recordings. The files and recordings are made from the tables, in their
own formats, and read back by the scans."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scorelake.operators import audio, pages, signal, spectra
from scorelake.operators.cluster import dealt, ship
from scorelake.plans.registry import query
from scorelake.sources import layouts, midi
from scorelake.sources.bindings import table

# --- MIDI -----------------------------------------------------------------------------------------------------------


def midi_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, content: an order as a file. Its lines are notes one after the other, 30 ticks to a piece of quantity; each
    sets a tempo, and the fourth one changes the meter."""
    line = F.struct(F.col("l_linenumber").alias("n"), F.col("l_quantity").cast("int").alias("q"), (F.lit(36) + F.col("l_partkey") % 49).cast("int").alias("pitch"))
    orders = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(line)).alias("lines"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, lines in zip(batch["l_orderkey"], batch["lines"], strict=True):
                song, tick = midi.Song(names={0: "line"}, meters=[(0, 3 + (key % 2 == 0), 4)]), 0
                for i, x in enumerate(lines):
                    song.tempos.append((tick, 400_000 + 50_000 * (x["n"] % 5)))
                    song.meters += [(tick, 6, 8)] if i == 3 else []
                    song.notes.append((0, 0, 0, x["pitch"], tick, tick + 30 * x["q"]))
                    tick += 30 * x["q"]
                out.append((f"order-{key}.mid", midi.encoded(song, one_track=key % 3 == 0)))
            yield pd.DataFrame(out, columns=["path", "content"])

    ship(spark)
    return orders.mapInPandas(run, "path string, content binary")


@query(
    "src11_midi_scan",
    """WITH x AS (SELECT l_orderkey AS k, l_linenumber AS n, 30 * l_quantity::BIGINT AS d, (36 + l_partkey % 49)::INTEGER AS midi_pitch, 400000 + 50000 * (l_linenumber % 5) AS us, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_partkey % 49) AS r FROM lineitem),
    y AS (SELECT *, (sum(d) OVER w - d)::BIGINT AS start_tick, sum(d * us) OVER w - d * us AS before FROM x WINDOW w AS (PARTITION BY k ORDER BY r ROWS UNBOUNDED PRECEDING)),
    z AS (SELECT *, max(CASE WHEN r = 4 THEN start_tick END) OVER (PARTITION BY k) AS turn, CASE WHEN k % 2 = 0 THEN 1920 ELSE 1440 END AS len FROM y)
    SELECT 'order-' || k || '.mid' AS path, CASE WHEN k % 3 = 0 THEN 'track0' ELSE 'line' END AS track_name, midi_pitch, start_tick, round(before / 480e6, 6) AS start_sec, round(d * us / 480e6, 6) AS duration_sec,
      CASE WHEN turn IS NULL OR start_tick < turn THEN 1 + start_tick // len ELSE 1 + (turn + len - 1) // len + (start_tick - turn) // 1440 END::INTEGER AS measure FROM z""",
)
def src11_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The notes of every file, with seconds through its tempos and bars through its meters."""
    notes = midi.notes_of(midi_files(spark, sf_dir), lenient=False)
    return notes.select("path", "track_name", "midi_pitch", "start_tick", F.round("start_sec", 6).alias("start_sec"), F.round("duration_sec", 6).alias("duration_sec"), "measure")


# --- layout ---------------------------------------------------------------------------------------------------------


def score_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """piece, document, content: a customer's orders as documents of a piece, an order's lines as measures with breaks,
    margins, meters, keys, words, two voices, chords, grace notes and barlines."""
    c = lambda name: F.col(name)
    s = lambda col: col.cast("string")
    tag = lambda when, *parts: F.when(when, F.concat(*(p if not isinstance(p, str) else F.lit(p) for p in parts))).otherwise("")
    turn, new, wide = c("l_returnflag") == "R", c("l_linestatus") == "F", c("l_tax") > 0.03
    part, supp, n1, n2 = c("l_partkey"), c("l_suppkey"), c("l_quantity").cast("int") % 5, c("l_quantity").cast("int") % 3
    note = '<note><pitch><step>C</step><octave>4</octave></pitch><duration>4</duration><voice>1</voice></note>'
    measure = F.concat(
        F.lit('<measure number="'), s(c("l_linenumber")), F.lit('">'),
        tag(turn | new | wide, "<print", tag(turn, ' new-page="yes"'), tag(new, ' new-system="yes"'), ">",
            tag(wide, "<system-layout><system-margins><left-margin>", s(F.lit(90) + supp % 5 * 10), "</left-margin><right-margin>70</right-margin></system-margins><system-distance>",
                s(F.lit(100) + part % 4 * 10), "</system-distance><top-system-distance>200</top-system-distance></system-layout>"), "</print>"),
        F.lit("<attributes><divisions>4</divisions>"), tag(part % 5 == 0, "<key><fifths>", s(part % 19 - 9), "</fifths></key>"),
        tag(part % 3 == 0, "<time><beats>", s(F.lit(2) + part % 4), "</beats><beat-type>", F.when(part % 2 == 0, "4").otherwise("8"), "</beat-type></time>"), F.lit("</attributes>"),
        tag((supp % 9 == 0) | (supp % 7 == 0), "<direction><direction-type><words>", F.when(supp % 9 == 0, " Allegro assai ").otherwise("dolce"), "</words></direction-type></direction>"),
        F.lit("<note><grace/><pitch><step>D</step><octave>4</octave></pitch><voice>1</voice></note>"), F.expr(f"repeat('{note}', cast(l_quantity as int) % 5)"),
        tag((n1 > 0) & (part % 2 == 0), "<note><chord/><pitch><step>E</step><octave>4</octave></pitch><duration>4</duration><voice>1</voice></note>"),
        F.lit("<backup><duration>4</duration></backup><note><rest/><duration>"), s(n2 * 2), F.lit("</duration><voice>2</voice></note>"),
        tag(supp % 4 == 0, "<forward><duration>4</duration></forward>"), tag(supp % 13 == 0, '<barline location="middle"/>'),
        tag(part % 11 == 0, '<barline location="right"><bar-style>light-heavy</bar-style></barline>'), F.lit("</measure>"),
    )
    # what the lines hold goes through the shuffle, and the far longer text is made behind it, once a line is where its order is
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_tax", "l_returnflag", "l_linestatus").repartition("l_orderkey")
    lines = rows.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_tax", measure.alias("m")))).alias("x"))
    size = tag(c("o_orderkey") % 2 == 0, "<defaults><page-layout><page-height>1600</page-height><page-width>1200</page-width></page-layout></defaults>")
    content = F.concat(F.lit('<score-partwise xmlns="x">'), size, F.lit('<part id="P1">'), F.array_join(c("x")["m"], ""), F.lit('</part><part id="P2"><measure number="1"/></part></score-partwise>'))
    joined = lines.join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select(F.col("o_custkey").alias("piece"), F.col("o_orderkey").alias("document"), content.alias("content"))


LAYOUT_SQL = """WITH l AS (
  SELECT o_custkey AS piece, o_orderkey AS document, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_tax) AS k, l_linenumber::VARCHAR AS xml_number, l_returnflag = 'R' AS turn, l_linestatus = 'F' AS new, l_tax > 0.03 AS wide,
    CASE WHEN o_orderkey % 2 = 0 THEN 1200.0::DOUBLE ELSE 1500.0::DOUBLE END AS pw, CASE WHEN o_orderkey % 2 = 0 THEN 1600.0::DOUBLE ELSE 2000.0::DOUBLE END AS ph, l_partkey AS part, l_suppkey AS supp, l_quantity::INTEGER % 5 AS n1, l_quantity::INTEGER % 3 AS n2,
    CASE WHEN l_partkey % 3 = 0 THEN (2 + l_partkey % 4)::VARCHAR || '/' || CASE WHEN l_partkey % 2 = 0 THEN '4' ELSE '8' END END AS nm,
    CASE WHEN l_partkey % 5 = 0 THEN CASE l_partkey % 19 - 9 WHEN -7 THEN 'Cb' WHEN -6 THEN 'Gb' WHEN -5 THEN 'Db' WHEN -4 THEN 'Ab' WHEN -3 THEN 'Eb' WHEN -2 THEN 'Bb' WHEN -1 THEN 'F' WHEN 0 THEN 'C' WHEN 1 THEN 'G' WHEN 2 THEN 'D' WHEN 3 THEN 'A'
      WHEN 4 THEN 'E' WHEN 5 THEN 'B' WHEN 6 THEN 'F#' WHEN 7 THEN 'C#' ELSE (l_partkey % 19 - 9)::VARCHAR || ' fifths' END END AS nk
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
a AS (SELECT *, 1 + sum((turn AND k > 1)::INT) OVER w AS pg, k = 1 OR turn AS top, k = 1 OR turn OR new AS s, last_value(nm IGNORE NULLS) OVER w AS meter, last_value(nk IGNORE NULLS) OVER w AS key,
   last_value(nm IGNORE NULLS) OVER b AS om, last_value(nk IGNORE NULLS) OVER b AS ok FROM l
   WINDOW w AS (PARTITION BY document ORDER BY k ROWS UNBOUNDED PRECEDING), b AS (PARTITION BY document ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, sum(s::INT) OVER w AS system, sum(CASE WHEN s AND wide THEN (CASE WHEN top THEN 200 ELSE 100 + part % 4 * 10 END) / ph ELSE 0 END) OVER w AS y FROM a WINDOW w AS (PARTITION BY document, pg ORDER BY k ROWS UNBOUNDED PRECEDING)),
d AS (SELECT *, first_value(CASE WHEN wide THEN (90 + supp % 5 * 10) / pw ELSE 0.08::DOUBLE END) OVER w AS x, first_value(CASE WHEN wide THEN (pw - 160 - supp % 5 * 10) / pw ELSE (pw - 2 * (pw * 0.08::DOUBLE)) / pw END) OVER w AS w FROM c WINDOW w AS (PARTITION BY document, pg, system ORDER BY k)),
e AS (SELECT document, piece, max(pg) AS pages, count(*) AS n FROM a GROUP BY ALL),
f AS (SELECT document, coalesce(sum(pages) OVER w, 0) AS po, coalesce(sum(n) OVER w, 0) AS mo FROM e WINDOW w AS (PARTITION BY piece ORDER BY document ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, greatest(n1, n2 * 2 / 4.0 + CASE WHEN supp % 4 = 0 THEN 1 ELSE 0 END)::DOUBLE AS quarters, string_split(meter, '/')[1]::DOUBLE * 4 / string_split(meter, '/')[2]::DOUBLE AS expected, n1 + (n1 > 0 AND part % 2 = 0)::INT AS notes FROM d JOIN f USING (document)),
m AS (SELECT piece::VARCHAR AS piece, document, (k + mo)::INTEGER AS measure, xml_number, (pg + po)::INTEGER AS page, system::INTEGER AS system, round(x, 6) AS x, round(y, 6) AS y, round(w, 6) AS w, meter, key,
  (nm IS NOT NULL AND nm IS DISTINCT FROM om) OR (nk IS NOT NULL AND nk IS DISTINCT FROM ok) AS changed, CASE WHEN supp % 9 = 0 THEN 'Allegro assai' WHEN supp % 7 = 0 THEN 'dolce' ELSE '' END AS words, notes, quarters, expected,
  supp % 13 = 0 AS middle_barline, part % 11 = 0 AS final_barline, notes > 0 AND supp % 13 > 0 AND quarters >= greatest(0.0625, 0.25 * coalesce(expected, CASE WHEN quarters = 0 THEN 1 ELSE quarters END)) AS valid FROM g)
"""


@query("src13_layout_scan", LAYOUT_SQL + "SELECT * FROM m")
def src13_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures of whole pieces by the table function: place on the page, meter and key in force, words, voices, barlines."""
    rounded = {c: F.round(c, 6) for c in ("x", "y", "w")}
    return layouts.scan(score_documents(spark, sf_dir)).withColumns(rounded).withColumn("words", F.array_join("words", ","))


@query(
    "win12_movement_rules",
    LAYOUT_SQL
    + """, v AS (SELECT *, coalesce(lag(final_barline) OVER (PARTITION BY piece ORDER BY measure), true) OR changed OR words LIKE 'Allegro%' AS begins FROM m WHERE valid),
    n AS (SELECT *, sum(begins::INT) OVER (PARTITION BY piece ORDER BY measure ROWS UNBOUNDED PRECEDING)::BIGINT AS movement FROM v)
    SELECT piece, measure, movement, row_number() OVER o AS bar, CASE WHEN first_value(words) OVER o LIKE 'Allegro%' THEN 'Allegro assai' ELSE 'Movement ' || movement END AS title FROM n WINDOW o AS (PARTITION BY piece, movement ORDER BY measure)""",
)
def win12_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Movements of the scanned scores: a title word, another meter or key, or a final barline before begins one."""
    return layouts.movements(layouts.scan(score_documents(spark, sf_dir)))


@query(
    "src13_system_boxes",
    LAYOUT_SQL
    + """, s AS (SELECT piece, page, system, min(x) AS x, min(y) AS y, min(w) AS w, min(measure) AS first, max(measure) AS last, count(*) AS n FROM m GROUP BY ALL)
    SELECT *, round(greatest(0.035, least(0.14, (coalesce(lead(y) OVER (PARTITION BY piece, page ORDER BY system), 0.96) - y) * 0.72)), 5) AS h FROM s""",
)
def src13_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Systems as boxes on their pages."""
    rounded = {c: F.round(c, 6) for c in ("x", "y", "w")}
    return layouts.systems(layouts.scan(score_documents(spark, sf_dir)).withColumns(rounded)).withColumn("h", F.round("h", 5))


# --- recordings -----------------------------------------------------------------------------------------------------

RATE, NOTE_SEC, NOTES = 8_000, 0.4, 8
#: Takes or pages, of up to half a megabyte, that leave a task at a time.
AT_ONCE = 32


def recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session_id, rate, samples: a take of each supplier, eight notes one after the other, plain, with vibrato or trilled."""
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = np.arange(int(RATE * NOTE_SEC)) / RATE
        for batch in batches:
            out = []
            for key, nation, balance in batch.itertuples(index=False):
                parts = []
                for i in range(NOTES):
                    cents = np.zeros(len(t))
                    if (key + i) % 3 == 1:
                        cents = 30 * np.sin(2 * np.pi * (5 + nation % 3) * t)
                    elif (key + i) % 3 == 2:
                        cents = 100.0 * (np.sin(2 * np.pi * 8 * t) > 0)
                    hz = 440 * 2 ** ((48 + (key * 7 + i * 5 + nation) % 36 - 69) / 12 + cents / 1200)
                    phase = 2 * np.pi * np.cumsum(hz) / RATE
                    fade = np.minimum(1, np.minimum(t, NOTE_SEC - t) / 0.01 + 0.02)
                    parts.append(fade * (0.2 + (balance % 1_000) / 2_000) * (np.sin(phase) + np.sin(2 * phase) / 3))
                out.append((key, RATE, np.concatenate(parts).astype(np.float32)))
                if len(out) == AT_ONCE:
                    yield pd.DataFrame(out, columns=["session_id", "rate", "samples"])
                    out = []
            if out:
                yield pd.DataFrame(out, columns=["session_id", "rate", "samples"])

    return dealt(rows, "s_suppkey").mapInPandas(run, "session_id bigint, rate int, samples array<float>")


TRACKING = audio.PitchConfig(hop=100)


@query("sig08_audio_analysis")
def sig08_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole takes from their sound: tempo, beats, onsets, voiced share, level, notes."""
    found = audio.global_analysis(recordings(spark, sf_dir), TRACKING)
    return found.select("session_id", F.round("duration_sec", 3).alias("duration_sec"), F.round("tempo_bpm", 2).alias("tempo_bpm"), "n_onsets", "n_beats", F.round("voiced_ratio", 3).alias("voiced_ratio"), F.round("loudness_mean_db", 2).alias("loudness_mean_db"), F.size("notes").alias("n_notes"))


def _tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    tracks = audio.note_tracks(audio.global_analysis(recordings(spark, sf_dir), TRACKING))
    return tracks.select((F.col("session_id") * 100 + F.col("note")).alias("session_id"), "rate", "hz")


@query("sig10_vibrato_from_audio")
def sig10_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vibrato of the notes that the pitch tracks hold; ids are takes and notes."""
    return signal.vibrato(_tracks(spark, sf_dir))


@query("sig11_trill_from_audio")
def sig11_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal.trills(_tracks(spark, sf_dir))


@query("src18_resampled")
def src18(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Takes at 11,025 samples a second, block by block: how many samples and how loud."""
    parts = audio.resample(recordings(spark, sf_dir), 11_025, size=8_192)
    power = F.aggregate("samples", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    return parts.select("session_id", "start", "core", F.round(F.sqrt(power / F.greatest("core", F.lit(1))), 5).alias("rms"))


# --- pages ----------------------------------------------------------------------------------------------------------

PAGE_WIDTH, PAGE_HEIGHT = 600, 760


def drawn_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page, image: a page of each supplier, one to three systems with barlines and notes; on every fourth page the
    barlines cover half of their staff only. The columns of the image source."""
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = lambda: pd.DataFrame({"page": names, "height": PAGE_HEIGHT, "width": PAGE_WIDTH, "nChannels": 1, "data": data})
        names: list[str] = []
        data: list[bytes] = []
        for batch in batches:
            for key, nation in batch.itertuples(index=False):
                x = np.full((PAGE_HEIGHT, PAGE_WIDTH), 250, np.uint8)
                for i in range(1 + key % 3):
                    top, bars = 60 + 240 * i, 3 + (nation + i) % 4
                    for k in range(5):
                        x[top + 10 * k : top + 10 * k + 2, 40:560] = 20
                    for j in range(bars + 1):
                        x[top : top + (24 if key % 4 == 0 else 42), 40 + 517 * j // bars : 43 + 517 * j // bars] = 60
                    for n, at in enumerate(range(60, 540, 37)):
                        x[top + 5 + n % 20 : top + 11 + n % 20, at : at + 6] = 90
                names.append(str(key))
                data.append(x.tobytes())
                if len(names) == AT_ONCE:
                    yield made()
                    names, data = [], []
        if names:
            yield made()

    made = dealt(rows, "s_suppkey").mapInPandas(run, "page string, height int, width int, nChannels int, data binary")
    return made.select("page", F.struct("height", "width", "nChannels", "data").alias("image"))


@query("sig14_systems", "SELECT s_suppkey::VARCHAR AS page, (i + 1)::INTEGER AS system, (60 + 240 * i + 0)::INTEGER AS top, (100 + 240 * i)::INTEGER AS bottom FROM (SELECT s_suppkey, unnest(range(1 + s_suppkey % 3)) AS i FROM supplier)")
def sig14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Systems of staves on every page; the twin says where they were drawn."""
    return pages.bands_of(pages.kept_runs(drawn_pages(spark, sf_dir), pages.PageConfig().staff_dark)[0])


@query(
    "sig16_barlines",
    """WITH s AS (SELECT s_suppkey, unnest(range(1 + s_suppkey % 3)) AS i, s_nationkey FROM supplier), b AS (SELECT *, 3 + (s_nationkey + i) % 4 AS n FROM s)
    SELECT s_suppkey::VARCHAR AS page, (i + 1)::INTEGER AS system, x::INTEGER AS x, round(x / 600, 6) AS share FROM (SELECT s_suppkey, i, 41 + 517 * unnest(range(n + 1)) // n AS x FROM b)""",
)
def sig16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Barlines of every system; on pages with short ones by the lesser share."""
    return pages.detect(drawn_pages(spark, sf_dir))[1].withColumn("share", F.round("share", 6))


@query("sig15_music_start")
def sig15_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the music of every system starts, by the first valley of its columns."""
    (runs,) = pages.kept_runs(drawn_pages(spark, sf_dir), 170)
    bands = pages.bands_of(runs).withColumn("x0", F.lit(32)).withColumn("x1", F.lit(568))
    return pages.music_starts(runs, bands)


@query("sig03_intonation_probe")
def sig03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The middle of every note of the takes probed at its own pitch, and one note of each at a pitch two semitones above."""
    wave = recordings(spark, sf_dir)
    low = 440 * 2 ** ((45 - 69) / 12)
    spectra_ = signal.frames_of(wave, low, 4, 60, 400)
    key, i = F.col("s_suppkey"), F.col("i")
    asks = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", F.explode(F.sequence(F.lit(0), F.lit(NOTES))).alias("i"))
    note = F.least(i, F.lit(NOTES - 1))
    pitch = F.lit(48) + F.pmod(key * 7 + note * 5 + F.col("s_nationkey"), F.lit(36)) + F.when(i == NOTES, 2).otherwise(0)
    asks = asks.select((key * 100 + i).alias("request"), key.alias("session_id"), (note * NOTE_SEC + 0.1).alias("start"), F.lit(0.2).alias("window"), pitch.cast("int").alias("pitch"))
    return spectra.probe(asks, spectra_, 45, 60)

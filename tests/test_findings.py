"""What a review found wrong or too slow, in small."""

import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorelake.operators import alignment, audio, ordered, signal, spectra
from scorelake.plans import evidence, scans, streams
from scorelake.sources import midi, stores

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


def n_tasks(df):
    """Tasks that run the last map of Python over rows."""
    return df.select(F.spark_partition_id().alias("p")).distinct().count()


def test_takes_are_dealt_over_tasks(spark):
    # Adaptive execution merged all suppliers, a few bytes each, into one task that made all the sound
    assert n_tasks(scans.recordings(spark, SF)) > 1


def test_tones_in_one_product_equal_tones_one_by_one():
    x, rate = np.random.default_rng(1).normal(size=3_000), 2_000
    got = signal.cqt(x, rate, 110.0, 5, 12, 400)
    q = 1 / (2 ** (1 / 12) - 1)
    for k in (0, 7, 30, 49):
        f = 110.0 * 2 ** (k / 12)
        if f >= rate / 2:
            assert not got[:, k].any()
            continue
        n = int(np.ceil(q * rate / f))
        tone = np.hanning(n) * np.exp(-2j * np.pi * f / rate * (np.arange(n) - n / 2))
        for i, at in enumerate(range(0, len(x), 400)):
            part = np.array([x[j] if 0 <= j < len(x) else 0.0 for j in range(at - n // 2, at - n // 2 + n)])
            assert abs(got[i, k] - abs(part @ tone) / np.abs(tone).sum()) < 1e-12


def test_mean_profiles_make_no_row_of_a_bin(spark):
    frames = spark.createDataFrame([(1, t / 4, [float(t), 1.0, None if t == 2 else 3.0]) for t in range(40)], "session_id bigint, t_sec double, mag array<double>")
    asks = spark.createDataFrame([(1, 1, 0.0, 9.0), (2, 1, 50.0, 1.0), (3, 1, 0.5, 0.25)], "request bigint, session_id bigint, start double, window double")
    found = spectra.mean_profiles(asks, frames)
    assert "posexplode" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {r.request: r.mag for r in found.collect()} == {1: [17.5, 1.0, 3.0], 2: None, 3: [2.0, 1.0, None]}


def test_weights_of_a_ratio_are_made_once():
    audio.resampled_part(np.ones(100), 0, 0, 50, 441, 320)
    before = audio._sinc_table.cache_info().hits
    audio.resampled_part(np.ones(100), 0, 0, 50, 441, 320)
    assert audio._sinc_table.cache_info().hits == before + 1


def test_sessions_share_folders(spark, tmp_path):
    # a folder a session and a file for every task that held some of it
    table = str(tmp_path / "t")
    rows = spark.range(500).select((F.col("id") % 250).alias("session_id"), F.lit(1).alias("v")).repartition(8)
    stores.write_session(rows, table)
    stores.write_session(rows.where("session_id < 100").withColumn("v", F.lit(2)), table)
    assert len(list((tmp_path / "t").rglob("*.parquet"))) <= stores.FOLDERS
    assert {(r.session_id, r.v): r["count"] for r in spark.read.parquet(table).groupBy("session_id", "v").count().collect()} == {(s, 2 if s < 100 else 1): 2 for s in range(250)}


def test_many_files_come_in_one_frame(spark, monkeypatch):
    # F8: a data frame and an Arrow batch for every file of a few notes
    song = midi.encoded(midi.Song(notes=[(0, 0, 0, 60, 0, 480)]))
    made = []
    frame = midi.pd.DataFrame
    monkeypatch.setattr(midi.pd, "DataFrame", lambda *a, **k: made.append(1) or frame(*a, **k))
    held = [n for k in range(50) for n in midi.note_lists(f"f{k}", song)]
    assert len(held) == 50 and not made


def test_clips_after_the_ten_thousandth_second(spark, tmp_path):
    # the name shows seven digits; the start is that of the whole name
    spark.createDataFrame([(10_078,), (11,)], "page_id bigint").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.page_id: (r.name, r.start_sec, r.end_sec) for r in evidence.fn19(spark, str(tmp_path)).collect()}
    assert got == {10_078: ("clip_1007800_10078750_h240.mp4", 10_078.0, 10_078.75), 11: ("clip_0011000_11750_h480.mp4", 11.0, 11.75)}


def test_quantiles_have_the_last_place_of_the_twin(spark):
    # the last place decides how a half is rounded
    import duckdb

    x = np.random.default_rng(2).integers(0, 30_000, 6_000) / 100
    df = spark.createDataFrame([(k // 6, float(v)) for k, v in enumerate(x)], "g int, v double")
    got = {r.g: (r.a, r.b, r.m) for r in df.groupBy("g").agg(evidence.quantile("v", 0.9).alias("a"), evidence.quantile("v", 0.1).alias("b"), evidence.quantile("v", 0.5).alias("m")).collect()}
    table = df.toPandas()  # noqa: F841
    want = duckdb.sql("select g, quantile_cont(v, 0.9), quantile_cont(v, 0.1), median(v) from table group by g".replace("from table", 'from "table"')).fetchall()
    assert got == {r[0]: r[1:] for r in want}


def test_a_conversation_in_two_files_counts_once(spark, tmp_path):
    # a file holds 2,000 messages at most, and a conversation can go on in the next
    spark.range(4_500).select(F.floor(F.col("id") / 1_500).alias("conv_id"), F.col("id").cast("int").alias("turn")).coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        row = streams.str09(spark, str(tmp_path)).first()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert (row.state, row.n_rows, row.n_conversations) == ("ready", 4_500, 3)


def test_narrow_bands_give_what_arrays_give(monkeypatch):
    # Bands of a few score notes cost a dozen array calls for every performed note
    draw = np.random.default_rng(3)
    for _ in range(60):
        n, m, span = int(draw.integers(1, 50)), int(draw.integers(1, 50)), float(draw.choice([5, 40, 300]))
        t, s = np.sort(draw.uniform(0, span, n)), np.sort(draw.uniform(0, span / 2, m))
        pitch, score = draw.integers(50, 56, n).astype(float), draw.choice([-1, 50, 51, 52, 53, 54, 55], m).astype(float)
        found = {}
        for most in (0, 16, 1_000):
            monkeypatch.setattr(alignment, "NARROW", most)
            found[most] = alignment._align(t, pitch, s, score, 2.0, 0.3, alignment.AlignConfig())
        assert found[0] == found[16] == found[1_000]


def test_average_ranks_sort_once(spark):
    # peers were counted in a window of their own, whose sort a task held beside the one of the ranks
    df = spark.createDataFrame([(1, v) for v in (3.0, 1.0, 3.0, None, 2.0, 3.0)], "k int, v double")
    ranked = ordered.average_rank(df, ["k"], "v", "r")
    assert ranked._jdf.queryExecution().executedPlan().toString().count("Sort ") == 1
    assert sorted((r.r, r.v) for r in ranked.collect() if r.v) == [(2.0, 1.0), (3.0, 2.0), (5.0, 3.0), (5.0, 3.0), (5.0, 3.0)]


def test_takes_tracked_together_equal_takes_alone(monkeypatch):
    # Every take had its own loop over frames, and every frame a row of its own in the shuffle
    c, draw = audio.PitchConfig(octaves=2, cents=50), np.random.default_rng(3)
    takes = []
    for n in (40, 1, 0, 97, 64):
        at = np.sort(np.append(np.arange(0, n, 2), np.flatnonzero(draw.random(n) < 0.8)))
        takes.append((n, at, 130 * 2 ** np.cumsum(draw.normal(0, 0.03, len(at))), draw.uniform(0.6, 0.9, len(at))))
    alone = [audio.pitch_paths([t], 5, c)[0] for t in takes]
    for frames in (8_192, 60):  # in one stretch, and in stretches of twelve frames
        monkeypatch.setattr(audio, "FRAMES", frames)
        for (n, *_), a, b in zip(takes, alone, audio.pitch_paths(takes, 5, c), strict=True):
            assert len(a) == n
            np.testing.assert_array_equal(a, b)
    assert sum(np.isfinite(a).sum() for a in alone) > 100


def test_frames_of_a_block_are_one_row(spark):
    wave = [float(v) for v in np.sin(np.arange(8_000) / 5)]
    take = spark.createDataFrame([(1, 8_000, wave)], "session_id bigint, rate int, samples array<float>")
    assert audio.block_features(take, size=2_000).count() == 4
    assert audio.frame_features(take, size=2_000).count() == 100


def test_bars_of_a_piece_are_dealt_without_a_second_look(spark):
    # sums were written out anew for every element, and the systems read again for every join
    from scorelake.functions.apportion import dealt_bars
    from scorelake.operators import reconcile

    many = 400
    rows = spark.createDataFrame([(20 * many, [float(1 + k % 7) for k in range(many)]), (many, [0.001] * (many - 1) + [50.0])], "total int, w array<double>")
    began = time.time()
    even, poor = (r.n for r in rows.select(dealt_bars(F.col("total"), F.col("w")).alias("n")).collect())
    assert time.time() - began < 60 and sum(even) == 20 * many and poor == [1] * many
    systems = spark.createDataFrame([(1, "recognised", k % 3, k, k % 2, 0.5, 3) for k in range(12)], "piece int, source string, page int, system int, movement int, width double, bars int")
    found = reconcile.reconciled(systems, spark.createDataFrame([(1, 40, 1)], "piece int, total int, hint int"))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("recognised,") <= 1
    assert sum(r.bars for r in found.collect() if r.fitted) == 40


def test_documents_are_read_where_they_are(spark):
    # whole documents went through the shuffle to the table function, row by row
    from scorelake.sources import layouts

    documents = scans.score_documents(spark, SF).cache()
    found = layouts.scan(documents)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "layout_scan" not in plan.lower()
    layouts.register(spark)
    want = spark.sql("SELECT * FROM layout_scan(TABLE({rows}) PARTITION BY piece ORDER BY document)", rows=documents.select("piece", "document", "content"))
    assert found.columns == want.columns and found.count() == want.count()
    assert found.exceptAll(want).count() == 0
    twice = spark.createDataFrame([("p", 1, "<s><part><measure/><measure><print new-page='yes'/></measure></part></s>")] * 2, "piece string, document bigint, content string")
    assert sorted((r.measure, r.page) for r in layouts.scan(twice).collect()) == [(1, 1), (2, 2), (3, 3), (4, 4)]


def test_a_users_days_are_read_and_written_at_once():
    # F16: three calls to the JVM for every day of a user, and a timer each that looked through all days
    import pandas as pd

    from scorelake.streaming import state

    class Days:
        rows, calls, timers = [], 0, []

        def getListState(self, *_):
            return self

        def exists(self):
            self.calls += 1
            return bool(self.rows)

        def get(self):
            self.calls += 1
            return iter(self.rows)

        def put(self, rows):
            self.calls += 1
            self.rows = rows

        def registerTimer(self, at):
            self.calls += 1
            self.timers = [*self.timers, at]

    held, quota = Days(), state.DailyQuota(1)
    quota.init(held)
    us = [day * 86_400_000_000 + k for day in range(30) for k in range(2)]
    (out,) = quota.handleInputRows((7,), iter([pd.DataFrame({"us": us, "event_id": range(60)})]), None)
    assert out["allowed"].tolist() == [True, False] * 30
    assert held.calls <= 4 and held.timers == [86_400_000] and len(held.rows) == 30


def test_slices_together_give_what_each_gives(monkeypatch):
    # r04 F1: every slice of every session was a group of data frames of its own
    draw = np.random.default_rng(5)
    c = alignment.AlignConfig()
    for cells in (1, 200, 1 << 22) * 8:
        monkeypatch.setattr(alignment, "CELLS", cells)
        n, m, span = int(draw.integers(1, 60)), int(draw.integers(1, 60)), float(draw.choice([5, 40, 300]))
        t, s = np.sort(draw.uniform(0, span, n)), np.sort(draw.uniform(0, span / 2, m))
        pitch, score = draw.integers(50, 56, n).astype(float), draw.choice([-1, 50, 51, 52, 53, 54, 55, np.nan], m)
        cuts = np.unique([0, n // 3, n // 2, n])
        own_begin, own_end = cuts[:-1], cuts[1:]
        begin, end, s_begin = np.maximum(own_begin - 9, 0), np.minimum(own_end + 9, n), np.arange(len(cuts) - 1) % m
        want = (t - 0.3) / 2.0
        k = len(begin)
        slices = alignment._Slices(t, pitch, s, score, s * 2.0 + 0.3, np.searchsorted(s, want - c.band, "left"), np.searchsorted(s, want + c.band, "right"), begin, end, own_begin, own_end, s_begin, np.full(k, m), np.full(k, 2.0), np.full(k, 0.3))
        found = np.full(n, -1)
        for q in range(k):
            for i, j in alignment._align(t[begin[q] : end[q]], pitch[begin[q] : end[q]], s[s_begin[q] :], score[s_begin[q] :], 2.0, 0.3, c):
                if own_begin[q] <= begin[q] + i < own_end[q]:
                    found[begin[q] + i] = s_begin[q] + j
        assert (alignment._hits(slices, c) == found).all()


def test_a_task_takes_whole_groups(monkeypatch):
    # r04 F1
    monkeypatch.setattr(alignment, "ROWS", 4)
    monkeypatch.setattr(alignment._Groups, "of", staticmethod(lambda rows: rows))
    rows = alignment.pa.table({"session_id": [1] * 9 + [2, 2, 3, 4, 4, 4], "_block": [0] * 5 + [1] * 4 + [0] * 6})
    for size in (1, 2, 3, 7, 20):
        parts = [list(zip(*part.to_pydict().values(), strict=True)) for part in alignment._whole_groups(iter(rows.to_batches(size)), lambda part: part)]
        assert sum(parts, []) == list(zip(*rows.to_pydict().values(), strict=True))
        assert sum(len(set(part)) for part in parts) == 5


def test_slices_in_groups_equal_slices_one_by_one(spark, monkeypatch):
    # r04 F1: groups are stretches of some slices and make no data frames; a note without a time was lost
    draw = np.random.default_rng(8)
    c, length, margin, notes, lines = alignment.AlignConfig(), 6.0, 5.0, [], []
    for session in range(3):
        s = np.cumsum(draw.uniform(0.1, 0.8, 150))
        pitch = draw.integers(50, 60, 150)
        lines += [(session, float(x), int(p), k // 8) for k, (x, p) in enumerate(zip(s, pitch, strict=True))]
        notes += [(session, k, float(x), int(p) if draw.random() < 0.9 else None) for k, (x, p) in enumerate(zip(s * 1.2 - 9 + draw.normal(0, 0.2, 150), pitch, strict=True)) if draw.random() < 0.9]
    p = spark.createDataFrame([*notes, (1, 500, None, 60), (7, 1, None, None)], "session_id bigint, state_idx bigint, t double, pitch int")
    q = spark.createDataFrame(lines, "session_id bigint, score_time_sec double, midi_pitch int, measure bigint")
    perf, score = (df.toPandas() for df in (p.where("t is not null"), q))

    def each(session, ratio, offset):
        own, line = perf[perf["session_id"] == session], score[score["session_id"] == session]
        at, wide = line["score_time_sec"] * ratio + offset, margin + c.fill_within + c.band * ratio
        for k in sorted(set(np.floor(own["t"] / length))):
            near = lambda x, by: (np.floor((x - by) / length) <= k) & (np.floor((x + by) / length) >= k)  # noqa: B023, E731
            a, b = alignment._ordered(own[near(own["t"], margin)], line[near(at, wide)])
            t, pitch, s, midi = alignment._arrays(a, b)
            pairs = alignment._align(t, pitch, s, midi, ratio, offset, c)
            mine = (np.floor(a["t"] / length) == k).to_numpy()
            heard = mine[a["pitch"].notna().to_numpy()]
            yield [(t[i], s[j]) for i, j in pairs if heard[i]], alignment._matched(a, b, pairs, ratio, offset, c)[mine]

    want = {}
    for session in range(3):
        first = perf[(perf["session_id"] == session) & perf["pitch"].notna()]["t"].max() / score[score["session_id"] == session]["score_time_sec"].max()
        pairs = np.array([pair for some, _ in each(session, first, 0.0) for pair in some])
        slope, offset = np.polyfit(pairs[:, 1], pairs[:, 0], 1)
        for _, rows in each(session, slope, offset):
            want |= {(session, r.state_idx): (r.matched, r.score_time_sec if r.matched else None, r.filled, r.timing_offset_ms if r.matched else None) for r in rows.itertuples()}
    want |= {(1, 500): (False, None, False, None), (7, 1): (False, None, False, None)}
    for most in (10_000, 1):
        monkeypatch.setattr(alignment, "NOTES", most)
        found = alignment.align_slices(p, q, length, margin)
        assert "CoGroup" not in found._jdf.queryExecution().optimizedPlan().toString()
        rows = found.collect()
        got = {(r.session_id, r.state_idx): (r.matched, r.score_time_sec, r.filled, r.timing_offset_ms) for r in rows}
        assert len(rows) == len(got) and set(got) == set(want) and sum(r.matched for r in rows) > 200
        for key, r in want.items():
            assert got[key][:3] == r[:3] and got[key][3] == pytest.approx(r[3], abs=0.2)
    # a session of many notes is a group a slice, so that its slices are dealt over tasks
    assert n_tasks(found.where("session_id = 0")) > 1

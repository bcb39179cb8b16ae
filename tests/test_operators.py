import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scorelake.functions import costs, pitch
from scorelake.operators import greedy, joins, ordered, signal
from scorelake.plans import tools
from scorelake.sources import recordings, stores

SLOW = settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
TIMES = st.lists(st.tuples(st.integers(0, 2), st.integers(0, 40)), max_size=12)


@SLOW
@given(TIMES, TIMES)
def test_joins_against_brute_force(spark, left, right):
    a = spark.createDataFrame([(k, i, float(t)) for i, (k, t) in enumerate(left)], "k int, i int, t double")
    b = spark.createDataFrame([(k, float(t)) for k, t in right], "k int, s double")
    back = {r.i: r.s for r in joins.as_of(a, b, ["k"], "t", "s", ["s"]).collect()}
    first = {r.i: r.s for r in joins.as_of(a, b, ["k"], "t", "s", ["s"], before_first="first").collect()}
    near = {r.i: r.near for r in joins.nearest(a, b, ["k"], "t", "s", "near").collect()}
    pairs = sorted((r.i, r.s) for r in joins.range_join(a.select("k", "i", F.col("t").alias("lo"), (F.col("t") + 7).alias("hi")), b, ["k"], "lo", "hi", "s", 5.0).collect())
    for i, (k, t) in enumerate(left):
        own = [float(s) for q, s in right if q == k]
        before = [s for s in own if s <= t]
        assert back[i] == (max(before) if before else None)
        assert first[i] == (max(before) if before else min(own) if own else None)
        assert near[i] == (min(own, key=lambda s: (abs(s - t), s)) if own else None)  # noqa: B023
    assert pairs == sorted((i, float(s)) for i, (k, t) in enumerate(left) for q, s in right if q == k and t <= s <= t + 7)


def test_islands_and_spines(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate([True, True, False, True, False, False, True])], "k int, i int, v boolean")
    assert sorted(r["count"] for r in ordered.islands(df, ["k"], ["i"], F.col("v")).groupBy("island").count().collect()) == [1, 1, 2]
    spine = ordered.dense_spine(spark.createDataFrame([(1, 3, 5), (2, 9, 8)], "k int, lo int, hi int"), ["k"], "lo", "hi", "n")
    assert sorted(r.n for r in spine.collect()) == [3, 4, 5]


@pytest.mark.parametrize("model, asked, answered, cached, want", [("gemini-2.5-pro", 100_000, 1_000, 0, 0.135), ("gemini-2.5-pro", 100_000, 1_000, 50_000, 0.088125), ("who", 5, 5, 0, None)])
def test_costs(spark, model, asked, answered, cached, want):
    row = spark.createDataFrame([(model, asked, answered, cached)], "m string, a bigint, b bigint, c bigint")
    found = row.select(costs.cost(F.col("m"), F.col("a"), F.col("b"), F.col("c")).alias("x")).first().x
    assert found == want or abs(found - want) < 1e-12


def test_pitch(spark):
    df = spark.createDataFrame([(0, "C-1"), (60, "C4"), (61, "Db4"), (-1, "B-2"), (69, "69.2")], "m int, n string")
    rows = {r.m: r for r in df.select("m", pitch.midi_name(F.col("m")).alias("name"), pitch.name_midi(F.col("n")).alias("back"), pitch.midi_hz(F.col("m")).alias("hz")).collect()}
    assert rows[0].name == "C-1" and rows[60].name == "C4" and rows[-1].name == "B-2" and rows[69].hz == 440.0
    assert all(r.back == m for m, r in rows.items())


def test_bar_refinement(spark):
    bars = spark.createDataFrame([(1, 1, 0.0, [0]), (1, 2, 10.0, [4]), (1, 3, 20.0, []), (1, 4, 30.0, [7])], "session_id bigint, measure bigint, start double, pcs array<int>")
    heard = spark.createDataFrame([(1, 0.5, -10.0, 0.5, 0), (1, 11.0, -5.0, 1.0, 4), (1, 10.2, -20.0, 0.1, 4), (1, 50.0, -5.0, 0.2, 7)], "session_id bigint, time double, loudness_db double, strength double, pc int")
    rows = {r.measure: (r.start, r.status) for r in greedy.refine_bar_starts(bars, heard).collect()}
    assert rows[1] == (0.5, "snapped") and rows[2] == (11.0, "snapped_strong") and rows[3] == (20.0, "no_score") and rows[4] == (30.0, "rejected_far_snap")


def test_boundaries_staves_clusters(spark):
    wanted, found = (spark.createDataFrame([(1, float(x)) for x in xs], "page bigint, x double") for xs in ((1, 2, 3), (1.2, 1.9)))
    assert {r.x: r.fit for r in greedy.nearest_unused(wanted, found, 0.5).collect()} == {1.0: 1.2, 2.0: 1.9, 3.0: 3.0}
    lines = spark.createDataFrame([(1, float(y)) for y in (0, 10, 20, 30, 40, 45, 100, 110, 120, 130, 140)], "page bigint, y double")
    assert [(r.top, r.bottom) for r in greedy.staves(lines, 8, 12).collect()] == [(0.0, 40.0), (100.0, 140.0)]
    points = spark.createDataFrame([(1, 1.0, 1.0), (1, 1.1, 3.0), (1, 5.0, 2.0), (1, 5.4, 9.0)], "page bigint, x double, score double")
    assert [round(r.x, 3) for r in greedy.weighted_clusters(points, 0.2, 1.0).collect()] == [1.075, 5.4]


def test_constant_q_finds_a_sine(spark):
    rate = 8_000
    samples = (0.5 * np.sin(2 * np.pi * 440 * np.arange(rate) / rate)).tolist()
    df = spark.createDataFrame([(1, rate, samples)], "session_id bigint, rate int, samples array<double>")
    rows = signal.frames_of(df, 220.0, 2, 60, 1_024).collect()
    m = np.array([r.mag for r in rows]).mean(0)
    k = int(m.argmax())
    shift = 0.5 * (m[k - 1] - m[k + 1]) / (m[k - 1] - 2 * m[k] + m[k + 1])
    assert abs((k + shift - 60) * 20) < 5  # bins are 20 cents wide, bin 60 is 440 Hz


def test_vibrato_and_trill(spark):
    t = np.arange(400) / 100
    hz = 440 * 2 ** (np.array([30 * np.sin(2 * np.pi * 5 * t), 100 * np.sign(np.sin(2 * np.pi * 8 * t + 0.1))]) / 1200)
    df = spark.createDataFrame([(i, 100.0, h.tolist()) for i, h in enumerate(hz)], "session_id bigint, rate double, hz array<double>")
    v = signal.vibrato(df.where("session_id = 0")).first()
    assert abs(v.rate_hz - 5) < 0.3 and abs(v.depth_cents - 30) < 3 and v.verdict == "present"
    r = signal.trills(df.where("session_id = 1")).first()
    assert abs(r.rate_hz - 8) < 0.7 and abs(r.swing_cents - 200) < 5 and r.verdict in ("regular trill", "trill present but uneven")


XML = """<score-partwise><part id="P1">{}</part></score-partwise>"""


def note(step, duration, extra=""):
    return f"<note>{extra}<pitch><step>{step}</step><octave>4</octave></pitch><duration>{duration}</duration></note>"


def test_musicxml_cursor_and_ghosts(spark, tmp_path):
    head = "<attributes><divisions>1</divisions><time><beats>4</beats><beat-type>4</beat-type></time></attributes><sound tempo='120'/>"
    bars = [head + note("C", 2) + note("E", 2, "<chord/>") + note("D", 2) + "<backup><duration>4</duration></backup>" + note("G", 4), note("D", 4), "", note("E", 4), note("F", 4)]
    (tmp_path / "a.musicxml").write_text(XML.format("".join(f"<measure number='{i + 1}'>{b}</measure>" for i, b in enumerate(bars))))
    rows = recordings.read_musicxml(spark, str(tmp_path / "a.musicxml")).orderBy("start_quarter", "midi_pitch").collect()
    assert [(r.start_quarter, r.midi_pitch) for r in rows if r.measure == 1] == [(0.0, 60), (0.0, 64), (0.0, 67), (2.0, 62)]
    ghosts = [r.start_sec for r in rows if r.midi_pitch == -1]
    assert ghosts == [4.0, 4.5, 5.0, 5.5]


def test_wav_window(spark, tmp_path):
    import wave

    with wave.open(str(tmp_path / "a.wav"), "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(100)
        w.writeframes((np.arange(300) * 10).astype("<i2").tobytes())
    row = recordings.read_wav(spark, str(tmp_path / "a.wav"), 1.0, 2.0).first()
    assert row.rate == 100 and len(row.samples) == 100 and abs(row.samples[0] - 1000 / 32768) < 1e-6


def test_stores(spark, tmp_path):
    root = str(tmp_path)
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.json").write_text('{"n": 1}')
    (tmp_path / "a" / "y.json").write_text("not json")
    assert stores.first_existing(spark, root, ["b/x.json", "a/x.json"]) == "a/x.json"
    with pytest.raises(FileNotFoundError):
        stores.required(spark, root, ["b"])
    for bad in ("../x", "/x", "a//b", ""):
        with pytest.raises(ValueError):
            stores.key_path(root, bad)
    assert sorted((r.n for r in stores.documents(spark, f"{root}/a", "n int").collect()), key=str) == [1, None]
    assert stores.objects(spark, f"{root}/a", "*.json").count() == 2
    table = f"{root}/t"
    for n, sessions in ((1, [1, 2]), (2, [2])):
        stores.write_session(spark.createDataFrame([(s, n) for s in sessions], "session_id int, v int"), table)
    assert sorted((r.session_id, r.v) for r in spark.read.parquet(table).collect()) == [(1, 1), (2, 2)]
    assert stores.delete_prefix(spark, f"{root}/a") == 2 and stores.delete_prefix(spark, f"{root}/a") == 0
    names = spark.createDataFrame([("n", 1, "k1"), ("n", 2, "k2"), ("m", 1, "k3")], "name string, priority int, key string")
    assert [(r.name, r.key) for r in stores.resolve(names, spark.createDataFrame([("k2",)], "key string")).collect()] == [("n", "k2")]


def test_tools(spark):
    sf = "/root/testdata/sf0.001"
    assert "unknown tool" in tools.call(spark, sf, "nope", {}).first().error
    assert "needs measure" in tools.call(spark, sf, "inspect_bar", {"session_id": 1}).first().error
    assert "not int" in tools.call(spark, sf, "inspect_bar", {"session_id": 1, "measure": "x"}).first().error
    assert "window" in tools.call(spark, sf, "listen", {"session_id": 1, "start": 5, "end": 5}).first().error
    assert tools.catalog(spark).count() == len(tools.TOOLS)
    for name, t in tools.TOOLS.items():
        tools.call(spark, sf, name, {k: 1 if k != "end" else 50 for k in t.arguments}).count()


def test_empty_documents_are_read_again(spark, tmp_path):
    import threading

    from scorelake.sources import stores

    path = tmp_path / "d.json"
    path.write_text("")
    threading.Timer(0.5, lambda: path.write_text('{"a": 5}')).start()
    assert stores.documents_retried(spark, str(path), "a int", attempts=6).first().a == 5


def test_answers_of_models(spark):
    from pyspark.sql import functions as F

    from scorelake.functions import text

    cases = {
        'x ```json\n{"a": 1}\n``` y': '{"a": 1}',
        '```\n{"a": {"b": 2}}\n```': '{"a": {"b": 2}}',
        'say {"a": "}{"} and {': '{"a": "}{"}',
        "none": None,
        "{ open": None,
        "": None,
        '{"a": "q \\" }"} tail': '{"a": "q \\" }"}',
        "{not json}": None,
    }
    rows = spark.createDataFrame([(k, v) for k, v in cases.items()] + [(None, None)], "t string, want string")
    for r in rows.select("t", "want", text.json_block(F.col("t")).alias("got"), text.response_error(F.col("t")).alias("error")).collect():
        assert r.got == r.want, r.t
    assert rows.where("t = 'none'").select(text.response_error(F.col("t")).alias("e")).first().e == "not an object"


def test_prominent_peaks():
    x = np.array([0, 5, 4, 6, 0, 3, 2.5, 3.2, 0, 9, 0], float)
    assert [k for k, _ in signal.prominent_peaks(x, 1, 2.0, 8)] == [9, 3, 7]
    assert [k for k, _ in signal.prominent_peaks(x, 1, 0.5, 8)] == [9, 3, 1, 7, 5]
    assert [k for k, _ in signal.prominent_peaks(x, 7, 0.5, 8)] == [9, 1]
    assert signal.prominent_peaks(np.zeros(2), 1, 1.0, 8) == []

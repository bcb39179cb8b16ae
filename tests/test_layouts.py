"""The layout table function on scores written by hand; its queries are held against SQL in test_queries."""

import pytest

from scorelake.sources import layouts

NOTE = "<note><pitch><step>C</step><octave>4</octave></pitch><duration>{}</duration><voice>{}</voice></note>"


def score(*measures, head="", ns=' xmlns="urn:x"'):
    return f"<score-partwise{ns}>{head}<part>" + "".join(f'<measure number="{k}">{m}</measure>' for k, m in enumerate(measures, 1)) + "</part></score-partwise>"


def fields(content):
    names = [c.split()[0] for c in layouts.SCAN.replace("\n", "").split(",")][2:]
    return [dict(zip(names, r, strict=True)) for r in layouts.document_rows(content)]


def test_voices_backup_forward_chords_and_grace():
    m = NOTE.format(2, 1) * 2 + "<note><chord/><pitch><step>E</step><octave>4</octave></pitch><duration>2</duration><voice>1</voice></note>"
    m += "<backup><duration>4</duration></backup><forward><duration>1</duration></forward>" + NOTE.format(3, 2) + "<forward><duration>4</duration></forward>"
    m += "<note><grace/><pitch><step>D</step><octave>4</octave></pitch><voice>3</voice></note><note><rest/><duration>1</duration></note>"
    row = fields(score("<attributes><divisions>2</divisions></attributes>" + m))[0]
    # voice 1: two halves and the forward after the backup; voice 2: its note and a forward; the grace note turns to voice 3
    assert row["notes"] == 4 and row["quarters"] == 3.5 and row["valid"]


def test_pages_systems_and_their_places():
    first = "<print><system-layout><system-margins><left-margin>150</left-margin><right-margin>75</right-margin></system-margins><top-system-distance>400</top-system-distance></system-layout></print>"
    rows = fields(score(first, "", '<print new-system="yes"/>', '<print new-page="yes"><system-layout/></print>', '<print new-system="yes"><system-layout><system-distance>x</system-distance></system-layout></print>'))
    assert [(r["page"], r["system"]) for r in rows] == [(1, 1), (1, 1), (1, 2), (2, 1), (2, 2)]
    assert [round(r["y"], 4) for r in rows] == [0.2, 0.2, 0.2, 0.09, 0.16]
    assert [round(r["x"], 2) for r in rows] == [0.1, 0.1, 0.08, 0.08, 0.08] and round(rows[0]["w"], 2) == 0.85


def test_meter_key_barlines_and_words():
    a = "<attributes><key><fifths>{}</fifths></key><time><beats>{}</beats><beat-type>8</beat-type></time></attributes>"
    bar = '<barline location="{}"><bar-style>{}</bar-style></barline>'
    rows = fields(score(a.format(-3, 6) + NOTE.format(3, 1), a.format(-3, 6) + bar.format("right", "Light-Heavy"), a.format(9, "3+2") + bar.format("middle", ""), "<direction><words> </words><words> Largo </words></direction>" + NOTE.format(1, 1)))
    assert [(r["meter"], r["key"], r["changed"]) for r in rows] == [("6/8", "Eb", True), ("6/8", "Eb", False), ("3+2/8", "9 fifths", True), ("3+2/8", "9 fifths", False)]
    assert [r["expected"] for r in rows] == [3.0, 3.0, None, None] and [r["final_barline"] for r in rows] == [False, True, False, False]
    assert [r["valid"] for r in rows] == [True, False, False, True] and rows[3]["words"] == ["Largo"] and rows[2]["middle_barline"]


@pytest.mark.parametrize("content", ["", "no xml", "<score-partwise/>", "<a><b></a>"])
def test_documents_without_a_part(content):
    assert fields(content) == []


def test_documents_of_a_piece_go_on(spark):
    two = score('<print new-page="yes"/>' + NOTE.format(4, 1), '<print new-page="yes"/>' + NOTE.format(4, 1), ns="")
    docs = spark.createDataFrame([("p", 3, two), ("p", 1, two), ("p", 2, "broken"), ("q", 1, two), ("q", 2, None)], "piece string, document bigint, content string")
    got = sorted((r.piece, r.document, r.measure, r.page) for r in layouts.scan(docs).collect())
    assert got == [("p", 1, 1, 1), ("p", 1, 2, 2), ("p", 3, 3, 3), ("p", 3, 4, 4), ("q", 1, 1, 1), ("q", 1, 2, 2)]
    layouts.register(spark)
    docs.createOrReplaceTempView("layout_docs")
    assert spark.sql("SELECT count(*) FROM layout_scan(TABLE(layout_docs) PARTITION BY piece ORDER BY document) WHERE valid").first()[0] == 6


def test_movements(spark):
    bar = '<barline location="right"><bar-style>heavy</bar-style></barline>'
    n = NOTE.format(4, 1)
    key = "<attributes><key><fifths>1</fifths></key></attributes>"
    docs = spark.createDataFrame([(1, 1, score(n, n + bar, bar, "<words>Presto!</words>" + n, key + n, "<words>dolce</words>" + n))], "piece int, document bigint, content string")
    rows = layouts.movements(layouts.scan(docs)).orderBy("measure").collect()
    assert [(r.measure, r.movement, r.bar, r.title) for r in rows] == [(1, 1, 1, "Movement 1"), (2, 1, 2, "Movement 1"), (4, 2, 1, "Presto!"), (5, 3, 1, "Movement 3"), (6, 3, 2, "Movement 3")]


def test_seconds_add_up_over_changes_of_tempo():
    from scorelake.sources import recordings

    note = "<note><pitch><step>C</step><octave>4</octave></pitch><duration>1</duration></note>"
    one = "<attributes><divisions>1</divisions></attributes><sound tempo='60'/>" + note * 2 + "<sound tempo='120'/>" + note * 2
    body = f"<part><measure>{one}</measure><measure><direction><sound tempo='240'/></direction>{note * 4}</measure></part><part><measure>{note * 4}</measure><measure/></part>"
    rows = recordings.score_rows("x", f"<score-partwise>{body}</score-partwise>".encode())
    first, second = ([(r[4], r[5]) for r in rows if r[1] == p] for p in (0, 1))
    assert first == [(0, 1), (1, 1), (2, 0.5), (2.5, 0.5), (3, 0.25), (3.25, 0.25), (3.5, 0.25), (3.75, 0.25)]
    assert second[:4] == first[:4] and second[4:] == [(3, 0.25), (3.25, 0.25), (3.5, 0.25), (3.75, 0.25)]  # the tempos of the first part hold for the second, whose last bar is empty

"""Staves, systems and barlines of drawn pages, as files that Spark decodes; the start of music against a plain loop."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorelake.operators import pages


def png(x):
    """A grey image as a PNG file."""
    h, w = x.shape
    raw = b"".join(b"\x00" + row.astype(np.uint8).tobytes() for row in x)
    part = lambda kind, body: len(body).to_bytes(4) + kind + body + zlib.crc32(kind + body).to_bytes(4)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


def page(tops, bars, short=False, width=600, height=760, gap=10):
    x = np.full((height, width), 250)
    for top, xs in zip(tops, bars, strict=True):
        for k in range(5):
            x[top + gap * k : top + gap * k + 2, 40:560] = 20
        for b in xs:
            x[top : top + (24 if short else 4 * gap + 2), b : b + 3] = 60
        for n, at in enumerate(range(60, 540, 37)):
            x[top + 5 + n % 20 : top + 11 + n % 20, at : at + 6] = 90
    return x


def images(spark, folder):
    return spark.read.format("image").load(str(folder)).select(F.element_at(F.split("image.origin", "/"), -1).alias("page"), "image")


def test_pages_from_files(spark, tmp_path):
    drawn = {"a.png": ([60, 300, 540], [[40, 200, 380, 557], [40, 557], [40, 120, 300, 557]]), "b.png": ([100], [[40, 333, 557]]), "c.png": ([], [])}
    for name, (tops, bars) in drawn.items():
        (tmp_path / name).write_bytes(png(page(tops, bars, short=name == "b.png")))
    bands, bars = pages.detect(images(spark, tmp_path))
    found = {(r.page, r.system): (r.top, r.bottom) for r in bands.collect()}
    assert found == {(n, k): (t, t + 40) for n, (tops, _) in drawn.items() for k, t in enumerate(tops, 1)}
    got = {}
    for r in bars.collect():
        got.setdefault((r.page, r.system), []).append(r.x)
        assert abs(r.share - r.x / 600) < 1e-12
    assert set(got) == set(found)
    for n, (_, lists) in drawn.items():
        for k, xs in enumerate(lists, 1):
            assert len(got[n, k]) == len(xs) and all(abs(a - b - 1) <= 5 for a, b in zip(sorted(got[n, k]), xs, strict=True))


def test_close_staves_are_one_system(spark, tmp_path):
    # distances 15, 100, 15: pairs; the short strokes of both staves cover less than 80 % of the pair
    (tmp_path / "a.png").write_bytes(png(page([60, 117, 259, 316], [[100, 400]] * 4)))
    bands, bars = pages.detect(images(spark, tmp_path))
    assert sorted((r.system, r.top, r.bottom) for r in bands.collect()) == [(1, 60, 158), (2, 260, 356)]
    assert sorted((r.system, r.x) for r in bars.collect()) == [(1, 101), (1, 401), (2, 101), (2, 401)]


def test_runs_hold_every_dark_pixel(spark, tmp_path):
    x = np.random.default_rng(1).integers(0, 256, (40, 50))
    (tmp_path / "a.png").write_bytes(png(x))
    (tmp_path / "b.png").write_bytes(b"no image")
    back = np.zeros(x.shape, bool)
    for r in pages.dark_runs(spark.read.format("image").option("dropInvalid", "true").load(str(tmp_path)).select(F.lit("a").alias("page"), "image"), 128).collect():
        assert not back[r.y, r.x0 : r.x1 + 1].any()
        back[r.y, r.x0 : r.x1 + 1] = True
    assert (back == (x < 128)).all()


def test_colours_have_the_brightness_of_their_channels():
    x = np.array([[[255, 0, 0], [0, 255, 0], [0, 0, 255], [9, 9, 9]]], np.uint8)
    assert pages.grey(x.tobytes(), 1, 4, 3).tolist() == [[29, 150, 76, 9]]


def plain_start(density, x0, page_width, spacing):
    reach, width = 8, len(density)
    weights = [np.exp(-0.5 * (k / 2) ** 2) for k in range(-reach, reach + 1)]
    mirrored = [density[min(max(k, -k - 1), 2 * width - k - 1) if not 0 <= k < width else k] for k in range(-reach, width + reach)]
    smooth = [sum(w * mirrored[k + j] for j, w in enumerate(weights)) / sum(weights) for k in range(width)]
    base = np.percentile(smooth, 20)
    scan = [max(0, s - base) for s in smooth][: max(1, min(width, int(width * 0.28)))]
    peak, fallback = np.percentile(scan, 95), round(x0 + width * 0.08)
    if peak < 4:
        return x0
    dense, run, wide = False, None, max(8, 2 * spacing)
    for k, v in enumerate(scan):
        dense = dense or v > max(4, peak * 0.35)
        if (dense or k < wide) and v <= max(2, peak * 0.18):
            run = k if run is None else run
            if k - run + 1 >= wide:
                return x0 if x0 / page_width > 0.085 and run > width * 0.04 else max(x0, min(fallback, x0 + run))
        else:
            run = None
    return fallback


@pytest.mark.parametrize("seed", range(30))
def test_music_start_equals_a_plain_loop(seed):
    draw = np.random.default_rng(seed)
    width = int(draw.integers(60, 500))
    density = draw.integers(8, 12, width).astype(float)
    at = 0
    while at < width:
        n = int(draw.integers(3, 60))
        density[at : at + n] += draw.choice([0, 0, 1, 12, 30])
        at += n
    x0 = int(draw.choice([10, 40, 90]))
    spacing = int(draw.integers(3, 12))
    assert pages.music_start(density, x0, 800, spacing) == plain_start(density, x0, 800, spacing)


def test_music_starts_after_the_clef(spark, tmp_path):
    x = page([100], [[557]])
    x[95:146, 45:65] = 30
    (tmp_path / "a.png").write_bytes(png(x))
    runs = pages.dark_runs(images(spark, tmp_path), 170)
    bands = spark.createDataFrame([("a.png", 1, 100, 140, 40, 560)], "page string, system int, top int, bottom int, x0 int, x1 int")
    start = pages.music_starts(runs, bands, 4).first().start
    assert 40 <= start <= 82


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_runs_are_not_broadcast(spark, tmp_path):
    # maps of Python over few small rows look small, so that their many runs went through the driver
    (tmp_path / "a.png").write_bytes(png(page([60], [[40, 557]])))
    bands, bars = pages.detect(images(spark, tmp_path))
    assert "Broadcast" not in plan(bars) + plan(bands)
    # and the pages are decoded once, not by every step
    starts = pages.music_starts(*pages.kept_runs(images(spark, tmp_path), 170), bands.withColumns({"x0": F.lit(40), "x1": F.lit(560)}))
    assert "Broadcast" not in plan(starts)
    assert "MapInPandas" not in plan(bands) + plan(bars) and plan(starts).count("MapInPandas") == 1

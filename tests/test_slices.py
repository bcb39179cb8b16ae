"""Cached slices: nothing is computed twice, bounds are checked."""

import hashlib

import pytest
from pyspark.sql import functions as F

from scorelake.operators import slices

ASK = "request int, session_id int, start int, end int, bins int"


def test_a_second_call_computes_nothing(spark, tmp_path):
    spectra = spark.createDataFrame([(s, i, [float(i), 2.0 * i, 1.0]) for s in (1, 2) for i in range(0, 1_400, 7)], "session_id int, frame_idx bigint, mag array<double>")
    asks = [(0, 1, 0, 100, 2), (1, 1, 0, 100, 2), (2, 2, 550, 1_100, 3), (3, 1, 5, 6, 3), (4, 1, -1, 9, 2), (5, 1, 9, 9, 2), (6, 1, 0, 601, 2), (7, 1, 0, 9, 0), (8, None, 0, 9, 1), (9, 3, 0, 9, 1)]
    path = str(tmp_path / "cache")
    first, n = slices.cached_slices(spark.createDataFrame(asks, ASK), spectra, path)
    assert n == 4  # two of the five that may be asked are one
    got = {r.request: r for r in first.collect()}
    again, n = slices.cached_slices(spark.createDataFrame(asks[:6], ASK), spectra.limit(0), path)
    assert n == 0 and {r.request: (r.n_frames, r.mag) for r in again.collect()} == {k: (got[k].n_frames, got[k].mag) for k in range(6)}
    want = [i for i in range(0, 1_400, 7) if 550 <= i < 1_100]
    assert got[2].n_frames == len(want) and got[2].mag == pytest.approx([sum(want) / len(want), 2 * sum(want) / len(want), 1])
    assert len(got[0].mag) == 2 and got[0].mag == got[1].mag and got[3].n_frames == 0 and got[9].mag == []
    assert [got[k].error for k in range(4, 9)] == ["start is below 0", "end is not after start", "longer than 600 frames", "no bins", "a parameter is missing"]
    assert got[0].key == hashlib.sha1(b"1|0|100|2").hexdigest() and got[4].key is None
    _, n = slices.cached_slices(spark.createDataFrame([(0, 1, 0, 100, 3)], ASK), spectra, path)
    assert n == 1 and spark.read.option("recursiveFileLookup", "true").parquet(path).agg(F.count_distinct("key")).first()[0] == 5

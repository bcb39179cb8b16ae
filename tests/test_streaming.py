import datetime as dt
import random
import time

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scorelake.streaming import jobs, stages, state

SF = "/root/testdata/sf0.001"


@pytest.fixture
def folder(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").where("user_id < 6")
    events.write.parquet(str(tmp_path / "in"))
    return str(tmp_path / "in"), events


def run(stream, spark, name, mode="append"):
    stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


def test_density_equals_batch(spark, folder):
    path, events = folder
    got = run(jobs.density(jobs.note_stream(spark, path, events.schema), "1 hour"), spark, "density", "complete")
    want = events.groupBy(F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("start")).agg(F.count("*").alias("n"))
    assert {tuple(r) for r in got.select("start", "n").collect()} == {tuple(r) for r in want.collect()}


def test_islands_equal_batch(spark, folder):
    path, events = folder
    got = run(jobs.session_islands(jobs.note_stream(spark, path, events.schema), "2 hours"), spark, "islands", "complete")
    want = events.groupBy("user_id", F.session_window(F.col("ts").cast("timestamp"), "2 hours")).count()
    assert sorted(r.n for r in got.collect()) == sorted(r["count"] for r in want.collect())


def plain_state(rows, most, ttl, reach, idle):
    """The three jobs by a loop over all rows in order."""
    used, decided, seen, quota, hits, tempo = {}, {}, {}, {}, {}, {}
    for user, ts, event, kind in sorted(rows):
        day = (user, ts.date())
        quota[event] = used.get(day, 0) < most
        used[day] = used.get(day, 0) + quota[event]
        last = decided.get((user, kind))
        hits[event] = last is not None and ts - last < dt.timedelta(seconds=ttl)
        if not hits[event]:
            decided[user, kind] = ts
        recent = seen.get(user, [])
        recent = [ts] if recent and ts - recent[-1] > dt.timedelta(seconds=idle) else [*recent, ts][-reach - 1 :]
        seen[user] = recent
        span = (recent[-1] - recent[0]).total_seconds()
        tempo[event] = 60 * (len(recent) - 1) / span if len(recent) > 2 and span > 1e-9 else None
    return quota, hits, tempo


@pytest.fixture
def few(spark):
    """Each partition of each trigger starts workers of its own: one is enough here."""
    held = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", held)


def stateful(spark, stream, path, **trigger):
    """Rows of a stream, and what its progress says about its state."""
    with state.rocksdb(spark):
        job = stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").trigger(**trigger or {"availableNow": True}).start()
    job.awaitTermination()
    return spark.read.parquet(f"{path}/rows").collect(), [p.stateOperators[0].numRowsTotal for p in job.recentProgress if p.stateOperators]


@pytest.mark.parametrize(("parts", "batch"), [(3, "10")])
def test_state_over_triggers_and_arrow_batches_equals_the_batch(spark, few, tmp_path, parts, batch):
    """Files in the order of their times, one to a trigger; Arrow batches of seven rows split a key's rows."""
    events = spark.read.parquet(f"{SF}/events.parquet").where("user_id < 6")
    cut = events.withColumn("part", F.ntile(parts).over(W.orderBy("ts")))
    for k in range(1, parts + 1):
        cut.where(F.col("part") == k).drop("part").orderBy(F.rand(1)).coalesce(1).write.parquet(str(tmp_path / f"in/part={k}"))
    rows = [(r.user_id, r.ts, r.event_id, r.event_type) for r in events.collect()]
    quota, hits, tempo = plain_state(rows, 2, 86_400, 4, 40_000)
    held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        got, sizes = stateful(spark, state.daily_quota(source, 2), str(tmp_path / "quota"))
        assert {r.event_id: r.allowed for r in got} == quota
        got, cache_sizes = stateful(spark, state.cached_decisions(source, 86_400), str(tmp_path / "hits"))
        assert {r.event_id: r.hit for r in got} == hits
        got, tempo_sizes = stateful(spark, state.running_tempo(source, 4, 40_000), str(tmp_path / "tempo"))
        assert {r.event_id: None if r.tempo is None else round(r.tempo, 9) for r in got} == {k: None if v is None else round(v, 9) for k, v in tempo.items()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)
    if parts > 1:
        # the days, decisions and pauses of a month are far more than what is still held at its end
        days = len({(u, ts.date()) for u, ts, _, _ in rows})
        assert sizes[-1] < days / 2 and cache_sizes[-1] < sum(not h for h in hits.values()) / 2


def test_state_falls_when_the_watermark_has_passed(spark, few, tmp_path):
    at = dt.datetime(2024, 3, 1)
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string"
    days = [[(1, at, 1, "view"), (2, at, 2, "view")], [(3, at + dt.timedelta(days=3), 3, "view")], [(4, at + dt.timedelta(days=6), 4, "view")]]
    for name, make in (("quota", lambda s: state.daily_quota(s, 5)), ("hits", lambda s: state.cached_decisions(s, 60)), ("tempo", lambda s: state.running_tempo(s, 4, 60))):
        folder = tmp_path / name / "in"
        for day in days:
            spark.createDataFrame(day, schema).coalesce(1).write.mode("append").parquet(str(folder))
            _, sizes = stateful(spark, make(spark.readStream.schema(schema).parquet(str(folder))), str(tmp_path / name))
        assert sizes[-1] <= 2, name  # user 4, and at most a trigger's delay


def test_decisions_forgotten_by_the_wall_clock(spark, few, tmp_path):
    """One batch to a start: by the wall clock a store always has another batch to look for what to forget."""
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string"
    for ttl, want in ((600, True), (1, False)):
        for k in range(2):
            spark.createDataFrame([(k, dt.datetime(2024, 3, 1), 1, "view")], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in{ttl}"))
            time.sleep(1.5 * k)
            rows, _ = stateful(spark, state.cached_decisions(spark.readStream.schema(schema).parquet(str(tmp_path / f"in{ttl}")), ttl, wall_clock=True), str(tmp_path / f"out{ttl}"), once=True)
        assert {r.event_id: r.hit for r in rows} == {0: False, 1: want}


def test_provider_is_left_as_it_was(spark):
    before = spark.conf.get(state.PROVIDER)
    with state.rocksdb(spark):
        assert spark.conf.get(state.PROVIDER) == state.ROCKS
    assert spark.conf.get(state.PROVIDER) == before


# --- stages ---


def test_states_fold_by_the_table_of_transitions(spark):
    draw = random.Random(2)
    names = sorted({x for pair in stages.TRANSITIONS for x in pair}) + ["odd", None]
    rows = [(j, draw.choice("ab"), k, draw.choice(names)) for j in range(40) for k in range(draw.randrange(9))]
    want = {}
    for job, stage, _, state_ in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        held = want.setdefault((job, stage), ["queued", 0, 0])
        ok = (held[0], state_) in stages.TRANSITIONS
        want[job, stage] = [state_ if ok else held[0], held[1] + ok, held[2] + (not ok)]
    got = stages.stage_states(spark.createDataFrame(rows, "job_id bigint, stage string, seq bigint, state string"))
    assert {(r.job_id, r.stage): [r.state, r.applied, r.refused] for r in got.collect()} == want


class Killed(Exception):
    pass


def stages_of(log, broken=(), kill=()):
    """Three stages that note the jobs they worked on; paths with a broken word fail in the middle one."""

    def work(name, bad):
        def run(jobs):
            if name in kill:
                raise Killed(name)
            log.append((name, sorted(r.path.rsplit("/", 1)[1] for r in jobs.collect())))
            return jobs.select("job_id", F.when(F.lit(bad) & F.col("path").rlike("|".join(broken) or "^$"), "unreadable").alias("error"))

        return run

    return [stages.Stage("extract", work("extract", False)), stages.Stage("analyse", work("analyse", True)), stages.Stage("preview", work("preview", True), required=False), stages.Stage("report", work("report", False))]


def test_a_killed_stream_repeats_no_finished_stage(spark, tmp_path):
    folder, root, check = (str(tmp_path / n) for n in ("in", "root", "check"))
    (tmp_path / "in").mkdir()
    for name in ("a.mid", "b.mid", "c.mid"):
        (tmp_path / "in" / name).write_bytes(name.encode())
    log = []
    with pytest.raises(Exception, match="report"):
        stages.start(stages.arrivals(spark, folder), root, stages_of(log, ["b"], {"report"}), check).awaitTermination()
    assert [n for n, _ in log] == ["extract", "analyse", "preview"]
    stages.start(stages.arrivals(spark, folder), root, stages_of(log, ["b"]), check).awaitTermination()
    assert [n for n, _ in log] == ["extract", "analyse", "preview", "report"] and log[-1][1] == ["a.mid", "c.mid"]
    found = {r.path.rsplit("/", 1)[1]: (r.state, r.failed_stage) for r in stages.states(spark, root, stages_of([])).collect()}
    assert found == {"a.mid": ("ready", None), "b.mid": ("failed", "analyse"), "c.mid": ("ready", None)}
    # a file that comes later is a job of its own; resuming takes up the failed job where it failed
    (tmp_path / "in" / "d.mid").write_bytes(b"d")
    stages.start(stages.arrivals(spark, folder), root, stages_of(log), check).awaitTermination()
    assert log[-1] == ("report", ["d.mid"]) and stages.jobs(spark, root).count() == 4
    log.clear()
    stages.resume(spark, root, stages_of(log), "1")
    assert log == [("extract", []), ("analyse", ["b.mid"]), ("preview", ["b.mid"]), ("report", ["b.mid"])]
    assert {r.state for r in stages.states(spark, root, stages_of([])).collect()} == {"ready"}
    log.clear()
    stages.resume(spark, root, stages_of(log), "1")  # the same run again does nothing
    assert log == []


def test_a_stage_that_loses_a_job_fails_it_and_best_effort_only_warns(spark, tmp_path):
    jobs_ = spark.createDataFrame([("x", "/x", 1), ("y", "/y", 1)], stages.JOBS)
    jobs_.write.parquet(str(tmp_path / "jobs/batch=0"))
    line = [stages.Stage("one", lambda j: j.where("job_id = 'x'").select("job_id", F.lit(None).cast("string").alias("error"))), stages.Stage("two", lambda j: j.select("job_id", F.lit("no").alias("error")), required=False)]
    stages.run_stages(spark, str(tmp_path), "r", jobs_, line)
    assert {(r.job_id, r.state, r.failed_stage, r.warnings) for r in stages.states(spark, str(tmp_path), line).collect()} == {("x", "ready", None, 1), ("y", "failed", "one", 0)}


def test_claims_hold_until_their_lease_ends(spark, tmp_path):
    root = str(tmp_path)
    jobs_ = spark.createDataFrame([("x",), ("y",)], "job_id string")
    assert {r.job_id for r in stages.claim(spark, root, "w1", jobs_.where("job_id = 'x'"), "2024-01-01 00:00:00", 60).collect()} == {"x"}
    assert {r.job_id for r in stages.claim(spark, root, "w2", jobs_, "2024-01-01 00:00:30", 60).collect()} == {"y"}
    assert {r.job_id for r in stages.claim(spark, root, "w1", jobs_, "2024-01-01 00:00:45", 60).collect()} == {"x"}
    assert {r.job_id for r in stages.claim(spark, root, "w2", jobs_, "2024-01-01 00:03:00", 60).collect()} == {"x", "y"}


def test_two_writers_append_to_the_same_conversations(spark, tmp_path):
    from scorelake.sources import stores

    rows = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", F.lit("w").alias("writer"), F.col("turn").alias("seq"), "text")
    for k, some in enumerate(("turn % 3 <> 1", "turn % 3 <> 2")):
        rows.where(some).write.parquet(str(tmp_path / f"in{k}"))
        source = spark.readStream.schema(rows.schema).parquet(str(tmp_path / f"in{k}"))
        for _ in range(2):  # a second start finds nothing new
            jobs.append_messages(source, str(tmp_path / f"table{k}"), str(tmp_path / f"check{k}")).awaitTermination()
    both = spark.read.parquet(str(tmp_path / "table0")).unionByName(spark.read.parquet(str(tmp_path / "table1")))
    merged = stores.merged_messages(both)
    assert merged.count() == rows.count() < both.count()
    assert merged.where("place <> turn - 1 AND place <> turn").isEmpty()


def test_messages_of_one_turn_are_all_kept(spark):
    from scorelake.sources import stores

    rows = [(1, 0, "a", 0, "x"), (1, 0, "b", 0, "y"), (1, 0, "a", 0, "x"), (1, 0, "a", 1, "x"), (1, -1, "b", 1, "late"), (2, 0, None, None, "x"), (2, 0, None, None, "z"), (2, 0, None, None, "z"), (2, 1, None, None, None)]
    got = stores.merged_messages(spark.createDataFrame(rows, "conv_id bigint, turn bigint, writer string, seq bigint, text string"))
    by = sorted((r.conv_id, r.place, r.text or "") for r in got.collect())
    assert by[:4] == [(1, 0, "late"), (1, 1, "x"), (1, 2, "x"), (1, 3, "y")]
    assert sorted(t for c, _, t in by if c == 2) == ["", "x", "z"]

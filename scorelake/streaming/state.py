"""Streams with state of their own: daily quotas, cached decisions, running tempo.

State is kept by Spark's state store (RocksDB) and falls when it can no longer matter: event-time timers fire when the
watermark has passed, and rows that late are not let in, or the store forgets a value some wall-clock time after it was
written. All rows of a key in a trigger are put in order first, however many Arrow batches they come in; a row is three
numbers here, so a hot key costs memory by its rows of one trigger, which the source's limits bound.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from scorelake.operators.cluster import ship

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_MS = 86_400_000


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, which these jobs need, in no more partitions than two to a core:
    each has a store of its own and starts workers at every trigger. The settings are as before afterwards."""
    parts = "spark.sql.shuffle.partitions"
    before = {k: spark.conf.get(k) for k in (PROVIDER, parts)}
    spark.conf.set(PROVIDER, ROCKS)
    spark.conf.set(parts, str(min(int(before[parts]), max(1, 2 * spark.sparkContext.defaultParallelism))))
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def timed(events: DataFrame, late: str) -> DataFrame:
    """``events`` (user_id, event_id, event_type, ts) with a watermark ``late`` behind the latest time, and times in
    milliseconds since 1970 and microseconds behind them."""
    micros = F.unix_micros("time")
    rows = events.withColumn("time", F.col("ts").cast("timestamp")).withWatermark("time", late)
    return rows.select("user_id", "event_id", "event_type", "time", micros.alias("us"))


def _in_order(batches: Iterator[pd.DataFrame]) -> list[tuple[int, int]]:
    return sorted(x for b in batches for x in zip(b["us"].tolist(), b["event_id"].tolist(), strict=True))


class _Ordered(StatefulProcessor):
    def init(self, handle) -> None:
        self.handle = handle

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.expire(expiredTimerInfo.getExpiryTimeInMs())
        return iter(())

    def close(self) -> None:
        pass


class DailyQuota(_Ordered):
    """How many of a user's events each day (UTC) have been let through; a day falls with its last millisecond. All days of
    a user are read and written at once and share a timer, that of the first, since every call goes to the JVM and back."""

    def __init__(self, most: int):
        self.most = most

    def init(self, handle) -> None:
        super().init(handle)
        self.days = handle.getListState("days", "day bigint, used bigint")

    def _held(self) -> dict[int, int]:
        return {r[0]: r[1] for r in self.days.get()} if self.days.exists() else {}

    def _hold(self, used: dict[int, int]) -> None:
        if used:
            self.days.put(list(used.items()))
            self.handle.registerTimer((min(used) + 1) * DAY_MS)
        else:
            self.days.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        used, out = self._held(), []
        for us, event_id in _in_order(rows):
            day = us // (DAY_MS * 1_000)
            before = used.get(day, 0)
            out.append((key[0], event_id, before < self.most))
            used[day] = before + (before < self.most)
        self._hold(used)
        yield pd.DataFrame(out, columns=["user_id", "event_id", "allowed"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        self._hold({day: n for day, n in self._held().items() if (day + 1) * DAY_MS > now})
        return iter(())


class Decisions(_Ordered):
    """When the decision on a user's topic that is in force was made; it holds for ``ttl`` milliseconds."""

    def __init__(self, ttl: int):
        self.ttl = ttl

    def init(self, handle) -> None:
        super().init(handle)
        self.decided = handle.getValueState("decided", "us bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        decided, out = self.decided.get()[0] if self.decided.exists() else None, []
        for us, event_id in _in_order(rows):
            hit = decided is not None and us - decided < self.ttl * 1_000
            out.append((key[0], event_id, hit))
            if not hit:
                decided = us
        self.decided.update((decided,))
        self.handle.registerTimer(-(-decided // 1_000) + self.ttl)
        yield pd.DataFrame(out, columns=["user_id", "event_id", "hit"])

    def expire(self, at: int) -> None:
        if self.decided.exists() and -(-self.decided.get()[0] // 1_000) + self.ttl <= at:
            self.decided.clear()


class ForgottenDecisions(StatefulProcessor):
    """The same by the wall clock: the store forgets a decision ``ttl`` milliseconds after it was made."""

    def __init__(self, ttl: int):
        self.ttl = ttl

    def init(self, handle) -> None:
        self.decided = handle.getValueState("decided", "event_id bigint", self.ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        out = []
        for _, event_id in _in_order(rows):
            hit = bool(out) or self.decided.exists()
            if not hit:
                self.decided.update((event_id,))
            out.append((key[0], event_id, hit))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "hit"])

    def close(self) -> None:
        pass


class Tempo(_Ordered):
    """The last ``reach`` + 1 times of a user; a pause of more than ``idle`` milliseconds starts anew."""

    def __init__(self, reach: int, idle: int):
        self.reach, self.idle = reach, idle

    def init(self, handle) -> None:
        super().init(handle)
        self.recent = handle.getListState("recent", "us bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        recent, out = [r[0] for r in self.recent.get()] if self.recent.exists() else [], []
        for us, event_id in _in_order(rows):
            recent = [us] if recent and us - recent[-1] > self.idle * 1_000 else [*recent, us][-self.reach - 1 :]
            span = (recent[-1] - recent[0]) / 1e6
            out.append((key[0], event_id, 60 * (len(recent) - 1) / span if len(recent) > 2 and span > 1e-9 else None))
        self.recent.put([(us,) for us in recent])
        self.handle.registerTimer(-(-recent[-1] // 1_000) + self.idle)
        yield pd.DataFrame({"user_id": [r[0] for r in out], "event_id": [r[1] for r in out], "tempo": pd.array([r[2] for r in out], "Float64")})

    def expire(self, at: int) -> None:
        recent = [r[0] for r in self.recent.get()] if self.recent.exists() else []
        if recent and -(-recent[-1] // 1_000) + self.idle <= at:
            self.recent.clear()


def _run(rows: DataFrame, keys: list[str], processor: StatefulProcessor, schema: str, clock: str = "EventTime") -> DataFrame:
    ship(rows.sparkSession)
    return rows.groupBy(*keys).transformWithStateInPandas(processor, schema, "Append", clock)


def daily_quota(events: DataFrame, most: int = 50, late: str = "1 hour") -> DataFrame:
    """user_id, event_id, allowed: the first ``most`` events of a user's day."""
    return _run(timed(events, late), ["user_id"], DailyQuota(most), "user_id bigint, event_id bigint, allowed boolean")


def cached_decisions(events: DataFrame, ttl_seconds: int = 3_600, late: str = "1 hour", wall_clock: bool = False) -> DataFrame:
    """user_id, event_id, hit: whether the user's same topic was decided within the last hour, by the events' times or by
    the wall clock."""
    schema = "user_id bigint, event_id bigint, hit boolean"
    if wall_clock:
        rows = events.select("user_id", "event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
        return _run(rows, ["user_id", "event_type"], ForgottenDecisions(ttl_seconds * 1_000), schema, "ProcessingTime")
    return _run(timed(events, late), ["user_id", "event_type"], Decisions(ttl_seconds * 1_000), schema)


def running_tempo(events: DataFrame, reach: int = 4, idle_seconds: int = 86_400, late: str = "1 hour") -> DataFrame:
    """user_id, event_id, tempo over the last ``reach`` + 1 events, which are all the state there is."""
    return _run(timed(events, late), ["user_id"], Tempo(reach, idle_seconds * 1_000), "user_id bigint, event_id bigint, tempo double")


def finished(stream: DataFrame, path: str) -> DataFrame:
    """What a stream has to say about everything that is there now, as a written table; its checkpoint lies beside it."""
    with rocksdb(stream.sparkSession):
        job = stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    job.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")

"""Streams: training-log tails with the last row of each step, best-so-far states, appended vectors, and heartbeats."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from ..operators.matrix import merge_entries
from ..sources.readers import log_entries


def follow_logs(spark: SparkSession, source: str, target: str, checkpoint: str, files_at_once: int = 1000):
    """Start a query that adds the entries of new log files of ``source`` to the table ``target``; ``read_followed`` merges them.

    A micro-batch writes its entries to a folder of its own, which a batch that is run again replaces.  The order of logs and lines is kept with each entry, so it makes no difference which files come together, or in
    which order, or where the query stops and goes on.  No state is held.
    """
    stream = spark.readStream.option("maxFilesPerTrigger", files_at_once).text(source).select("value", "_metadata")
    write = lambda batch, no: log_entries(batch).write.mode("overwrite").parquet(f"{target}/batch={no}")
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_followed(spark: SparkSession, target: str) -> DataFrame:
    """(split, step, metrics) of all entries that ``follow_logs`` has written so far."""
    return merge_entries(spark.read.parquet(target).drop("batch"))


def liveness(beats: DataFrame, key: str, now: str, poll: int = 60, least: int = 180) -> DataFrame:
    """Last beat of each key against ``now``; alive within max(least, 3 poll) seconds.  Works on batches and, by key, on streams."""
    last = beats.groupBy(key).agg(F.max("ts").alias("ts"))
    age = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("ts")
    return last.select(key, age.alias("age"), (age <= max(least, 3 * poll)).alias("alive"))


@contextmanager
def state_in_rocksdb(spark: SparkSession) -> Iterator[None]:
    """States with timers need this provider; the session's own setting comes back after."""
    key, provider = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(key)
    spark.conf.set(key, provider)
    try:
        yield
    finally:
        spark.conf.set(key, before)


class _Watch(StatefulProcessor):
    """Last beat of a run and whether it was found stalled; a timer per run makes silence an event."""

    def __init__(self, plan: str, poll: int, least: int) -> None:
        self.plan, self.limit = plan, 1000 * max(least, 3 * poll)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("watch", "last bigint, state string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last, state = self.state.get() if self.state.exists() else (None, None)
        out = []
        x = pd.concat(rows)
        x = x[x["plan_sha256"] == self.plan].sort_values("ts", kind="stable")
        for ts, status in zip(x["ts"].astype("datetime64[ms, UTC]" if x["ts"].dt.tz is not None else "datetime64[ms]").astype("int64"), x["status"], strict=True):
            if last is not None and ts <= last:
                continue
            if state == "running" and ts - last > self.limit:
                out.append((last + self.limit, "stalled"))
                state = "stalled"
            if status != state:
                out.append((ts, status))
            last, state = int(ts), status
        if last is not None:
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
            if state == "running":
                self.handle.registerTimer(last + self.limit)
            self.state.update((last, state))
        yield self._rows(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last, state = self.state.get()
        if state == "running":
            self.state.update((last, "stalled"))
            yield self._rows(key, [(last + self.limit, "stalled")])

    def _rows(self, key, out: list[tuple[int, str]]) -> pd.DataFrame:
        own = lambda values: pd.Series(values, dtype=object)
        return pd.DataFrame({"run_key": own([key[0]] * len(out)), "at": np.array([t for t, _ in out], "datetime64[ms]"), "state": own([s for _, s in out])})

    def close(self) -> None:
        pass


def watch_runs(beats: DataFrame, plan: str, poll: int = 60, least: int = 180, delay: str = "0 seconds") -> DataFrame:
    """(run_key, at, state) whenever the state of a run changes, from a stream of beats (run_key, ts, status, plan_sha256).

    A running run whose next beat is more than max(``least``, 3 ``poll``) seconds off is ``stalled`` from then on, whether that beat ever comes: a timer in event time
    fires when the other runs' beats have moved the watermark past it.  A beat of another plan is no beat.  The state of a run is its last beat; beats must come in the order of time but for ``delay``, and older ones are
    passed over.
    """
    kind = beats.schema["run_key"].dataType.simpleString()
    timed = beats.select("run_key", "ts", "status", "plan_sha256").withWatermark("ts", delay)
    return timed.groupBy("run_key").transformWithStateInPandas(_Watch(plan, poll, least), f"run_key {kind}, at timestamp, state string", "append", "EventTime")


def roll_up(runs: DataFrame, states: DataFrame) -> DataFrame:
    """(complete, terminal, active, waiting, status) of planned runs (run_key) by the last of their state changes (run_key, at, state).

    ``ok`` if all are complete, ``failed`` if all are complete or terminal, ``running`` while one is active, else ``not_running``.
    """
    last = states.groupBy("run_key").agg(F.max_by("state", F.struct("at", "state")).alias("state"))
    kind = F.when(F.col("state") == "complete", "complete").when(F.col("state") == "terminal_failed", "terminal").when(F.col("state") == "running", "active").otherwise("waiting")
    one = runs.select("run_key").distinct().join(last, "run_key", "left").select(kind.alias("kind")).agg(F.count("*").alias("n"), *(F.count_if(F.col("kind") == k).alias(k) for k in ("complete", "terminal", "active", "waiting")))
    status = F.when(F.col("complete") == F.col("n"), "ok").when(F.col("complete") + F.col("terminal") == F.col("n"), "failed").when(F.col("active") > 0, "running").otherwise("not_running")
    return one.select("complete", "terminal", "active", "waiting", status.alias("status"))


def event_counts(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Rows per event type and hour; the watermark bounds the state on a stream."""
    hour = F.window("ts", "1 hour")
    return events.withWatermark("ts", delay).groupBy(hour, "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("hour"), "event_type", "n")


def best_so_far(evals: DataFrame, min_delta: float = 0.0) -> DataFrame:
    """Rows (run_key, step, value) of a stream with ``new`` (under the best by more than ``min_delta``), ``best`` and ``stale``, the rows since.

    A run's state is two numbers in the query's checkpoint: a query that is started again goes on where it stopped.
    A micro-batch must hold later steps than the one before it; the rows of one run in a micro-batch meet in one task,
    which puts them in step order, so bound a batch by ``maxFilesPerTrigger``.  A null value is no new best, except
    that every row of a run is ``new`` until it has a value.
    """
    names = ("run_key", "step", "value")
    fields = [StructField(n, evals.schema[n].dataType) for n in names]
    out = StructType([*fields, StructField("new", BooleanType()), StructField("best", DoubleType()), StructField("stale", LongType())])

    def follow(key, frames, state):
        best, stale = state.get if state.exists else (None, 0)
        # A run has few rows in a batch, so that what pandas takes for a call counts, not the rows.
        parts = list(frames)
        x = parts[0] if len(parts) == 1 else pd.concat(parts)
        if not x["step"].is_monotonic_increasing:
            x = x.sort_values("step", kind="stable")
        news, bests, stales = [], [], []
        for v in x["value"].to_numpy(np.float64, na_value=np.nan).tolist():
            new = best is None or v < best - min_delta
            best, stale = (None if v != v else v, 0) if new else (best, stale + 1)
            news.append(new)
            bests.append(np.nan if best is None else best)
            stales.append(stale)
        state.update((best, stale))
        yield pd.DataFrame({**{n: x[n].array for n in names}, "new": np.array(news, bool), "best": np.array(bests, np.float64), "stale": np.array(stales, np.int64)}, copy=False)

    return evals.groupBy("run_key").applyInPandasWithState(follow, out, "best double, stale long", "append", GroupStateTimeout.NoTimeout)


def append_vectors(vectors: DataFrame, path: str, checkpoint: str):
    """Start a query that appends a stream of vectors to ``path``, a folder a micro-batch; a batch that is run again replaces its folder.

    ``sources.readers.read_embeddings`` reads the folders back and checks that nothing is missing.
    """
    write = lambda batch, no: batch.write.mode("overwrite").parquet(f"{path}/batch={no}")
    return vectors.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

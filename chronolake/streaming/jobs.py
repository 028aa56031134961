"""Structured Streaming jobs; each has a batch form that it must equal."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.windows import keep_one


def ingest_minutes(feed: DataFrame, store: str, keys: Sequence[str], part: str, checkpoint: str) -> StreamingQuery:
    """Appends unseen bars to a store by day: each micro-batch rewrites only the days it touches, the last version of a key stays.

    Replaying a batch writes the same days with the same rows; the checkpoint is the acknowledgement.
    """

    def merge(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        fresh = batch.withColumn("_new", F.lit(1))
        touched = [r[0] for r in batch.select(part).distinct().collect()]  # days of one micro-batch
        if not touched:
            return
        try:
            old = spark.read.schema(batch.schema).parquet(store).where(F.col(part).isin(touched)).withColumn("_new", F.lit(0))
            both = old.unionByName(fresh)
        except Exception as missing:
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            both = fresh
        merged = keep_one(both, [part, *keys], ["_new"], "last").drop("_new").hint("rebalance", part).persist(StorageLevel.DISK_ONLY)
        merged.count()  # read before the days are replaced
        merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(store)
        merged.unpersist()

    return feed.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def roll_as_of(clock: DataFrame, replay: DataFrame, cutoffs: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Writes the rows that become visible between one clock tick and the next, each row once; for a replay that is not laid out (``rolling.roll``).

    ``cutoffs`` gives (dataset, before, cutoff) for a batch of ticks. Parts are named by batch, so a replay overwrites itself.
    """

    def step(batch: DataFrame, number: int) -> None:
        bounds = cutoffs(batch)
        fresh = replay.join(bounds, "dataset").where((F.col("available_at") <= F.col("cutoff")) & (F.col("before").isNull() | (F.col("available_at") > F.col("before"))))
        fresh.drop("before", "cutoff").write.mode("overwrite").parquet(f"{out}/batch={number}")

    return clock.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def trace_counters(log: DataFrame) -> DataFrame:
    """Counts and token sums by event type of a JSON log; lines that do not parse (a partial tail) are left out."""
    parsed = log.select(F.from_json("value", "event_type string, k long").alias("e")).where("e.event_type is not null")
    return parsed.groupBy("e.event_type").agg(F.count("*").alias("n"), F.sum("e.k").alias("tokens"))


def keep_counting(log: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Counters of a growing log: every micro-batch leaves the totals so far in ``out/batch=n``; a batch that is run again leaves the same."""

    def totals(counts: DataFrame, number: int) -> None:
        counts.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return trace_counters(log).writeStream.outputMode("complete").foreachBatch(totals).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counted(spark: SparkSession, out: str) -> DataFrame:
    """The totals of the last micro-batch."""
    every = spark.read.schema("event_type string, n long, tokens long, batch long").parquet(out)
    last = every.agg(F.max("batch")).first()[0]
    return every.where(F.col("batch") == F.lit(last)).drop("batch")


RUNS = "started_at timestamp, ended_at timestamp, steps long, state string"


def runs_in_flight(events: DataFrame, key: str, stamp: str, order: str, kind: str, start: str, end: str, horizon: str, late: str) -> DataFrame:
    """Runs of each key as a stream: ``done`` at their end event, ``lost`` once ``horizon`` passes without one; those in flight are state.

    A new start takes the place of one in flight. ``steps`` are the other events in between (null is none); a lost run counts those later than its start. ``stamp`` is the event time; events later than ``late`` after
    what was seen are dropped. A run is lost once its horizon lies ``late`` behind what was seen, or at a later start or end; other events do not end it. State is one run a key, and goes with its
    timeout, so it does not grow with the log.
    """
    kinds, most = dict(events.dtypes), pd.Timedelta(horizon).value // 1000

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out, (started, steps, same) = [], (state.get if state.exists else (None, 0, 0))
        if state.hasTimedOut:
            out.append((k[0], started, -1, steps - same, "lost"))
            started = None
        else:
            rows = pd.concat(list(frames)).sort_values(["_at", order])
            for at, what, known in zip(rows["_at"].tolist(), rows[kind], rows[kind].notna(), strict=True):
                if not known:
                    continue
                if started is not None and at > started + most:
                    if what not in (start, end):
                        continue
                    out.append((k[0], started, -1, steps - same, "lost"))
                    started = None
                if what == start:
                    started, steps, same = at, 0, 0
                elif what == end and started is not None:
                    out.append((k[0], started, at, steps, "done"))
                    started = None
                elif started is not None:
                    steps, same = steps + 1, same + (at == started)
        due = None if started is None else (started + most) // 1000
        if due is not None and due < state.getCurrentWatermarkMs():
            out.append((k[0], started, -1, steps - same, "lost"))
            due = None
        if due is None:
            if state.exists:
                state.remove()
        else:
            state.update((started, steps, same))
            state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame(out, columns=[key, "started", "ended", "steps", "state"])

    # Times are numbers in Python, so that the session's time zone does not move them.
    grouped = events.withColumn("_at", F.unix_micros(stamp)).withWatermark(stamp, late).groupBy(key)
    runs = grouped.applyInPandasWithState(step, f"{key} {kinds[key]}, started long, ended long, steps long, state string", "started long, steps long, same long", "append", GroupStateTimeout.EventTimeTimeout)
    return runs.select(key, F.timestamp_micros("started").alias("started_at"), F.when(F.col("ended") >= 0, F.timestamp_micros("ended")).alias("ended_at"), "steps", "state")


def fill_dedup(deals: DataFrame, keys: Sequence[str], stamp: str, horizon: str = "2 days") -> DataFrame:
    """Each fill once within the horizon."""
    return deals.withWatermark(stamp, horizon).dropDuplicatesWithinWatermark(list(keys))


def announce_fills(deals: DataFrame, keys: Sequence[str], stamp: str, out: str, checkpoint: str, horizon: str = "2 days") -> StreamingQuery:
    """Appends each new fill once to ``out``, however often feeds repeat it; state holds the fills of the horizon only."""
    return fill_dedup(deals, keys, stamp, horizon).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def transitions(health: DataFrame, key: str, order: str, bad: str) -> DataFrame:
    """Batch form: rows at which the flag turns, as ``alert`` or ``recovered``; the state before the first row is good."""
    before = F.coalesce(F.lag(bad).over(W.partitionBy(key).orderBy(order)), F.lit(False))
    turned = health.withColumn("_before", before).where(F.col(bad) != F.col("_before"))
    return turned.select(key, order, F.when(F.col(bad), "alert").otherwise("recovered").alias("event"))


def transitions_stream(health: DataFrame, key: str, order: str, bad: str) -> DataFrame:
    """Stream form with one flag of state per key; rows of a micro-batch are taken in order."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        was = state.get[0] if state.exists else False
        rows = pd.concat(list(frames)).sort_values(order)
        out = []
        for at, now in zip(rows[order], rows[bad], strict=True):
            if bool(now) != was:
                was = bool(now)
                out.append((k[0], at, "alert" if was else "recovered"))
        state.update((was,))
        yield pd.DataFrame(out, columns=[key, order, "event"])

    kinds = dict(health.dtypes)
    return health.groupBy(key).applyInPandasWithState(step, f"{key} {kinds[key]}, {order} {kinds[order]}, event string", "was boolean", "append", GroupStateTimeout.NoTimeout)


def event_gate(now: DataFrame, before: DataFrame, key: str) -> DataFrame:
    """Keys whose evidence digest is new or changed."""
    return now.join(before.select(key, "revision"), [key, "revision"], "left_anti")


def arrival_minutes(rows: DataFrame, stamp: str, by: Sequence[str]) -> DataFrame:
    """Rows counted by the minute at which they become usable: their stamp rounded up."""
    floor = F.date_trunc("minute", F.col(stamp)).cast("timestamp_ntz")
    up = F.when(F.col(stamp).cast("timestamp_ntz") > floor, floor + F.expr("INTERVAL 1 MINUTE")).otherwise(floor)
    return rows.withColumn("minute", up).groupBy(*by, "minute").agg(F.count("*").alias("n"))

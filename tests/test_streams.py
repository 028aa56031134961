"""Streams against plain versions: runs in flight, counters that go on, fills that come again."""

import datetime
import glob
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from chronolake.plans import catalog, stream_queries
from chronolake.plans.registry import Tables
from chronolake.streaming import jobs

EVENTS = "k string, t timestamp, i long, kind string"


def at(hours):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=hours)


def expected(rows, most, seen):
    """Runs that are done or lost, and those in flight, of events (k, hours, i, kind)."""
    out, flight = [], []
    for k in sorted({r[0] for r in rows}):
        started, steps = None, 0
        for _, h, _, kind in sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2])):
            if started is not None and h > started + most:
                out.append((k, at(started), None, steps, "lost"))
                started = None
            if kind == "start":
                started, steps = h, 0
            elif kind == "end" and started is not None:
                out.append((k, at(started), at(h), steps, "done"))
                started = None
            elif started is not None:
                steps += 1
        if started is not None:
            (out if started + most < seen else flight).append((k, at(started), None, steps, "lost"))
    return sorted(out, key=str), flight


class Runs:
    def __init__(self, spark, path):
        self.spark, self.path, self.n = spark, str(path), 0

    def feed(self, rows):
        self.spark.createDataFrame([(k, at(h), i, kind) for k, h, i, kind in rows], EVENTS).coalesce(1).write.mode("append").parquet(f"{self.path}/in")

    def run(self):
        feed = self.spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{self.path}/in")
        runs = jobs.runs_in_flight(feed, "k", "t", "i", "kind", "start", "end", "10 hours", "1 hour")
        runs.writeStream.format("parquet").option("path", f"{self.path}/out").option("checkpointLocation", f"{self.path}/checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()
        return sorted((tuple(r) for r in self.spark.read.schema(f"k string, {jobs.RUNS}").parquet(f"{self.path}/out").collect()), key=str)


def test_runs_by_brute_force(spark, tmp_path):
    rnd = random.Random(4)
    rows = [(rnd.choice("abcdef"), h, i, rnd.choice(["start", "end", "step", "step"])) for i, h in enumerate(sorted(rnd.uniform(0, 300) for _ in range(160)))]
    rows = [(k, round(h, 2), i, kind) for k, h, i, kind in rows]
    job = Runs(spark, tmp_path)
    first, rest = rows[:70], rows[70:]
    job.feed(first)
    done, flight = expected(first, 10, max(r[1] for r in first) - 1)
    assert job.run() == done and flight
    for cut in (rest[:40], rest[40:]):
        job.feed(cut)
    done, _ = expected(rows, 10, max(r[1] for r in rows) - 1)
    assert job.run() == done and {r[4] for r in done} == {"done", "lost"}
    assert job.run() == done  # nothing new


def test_a_run_is_lost_when_others_go_on(spark, tmp_path):
    job = Runs(spark, tmp_path)
    job.feed([("a", 1, 1, "start"), ("b", 2, 2, "start")])
    assert job.run() == []
    job.feed([("b", 5, 3, "end"), ("c", 30, 4, "step")])
    assert job.run() == [("a", at(1), None, 0, "lost"), ("b", at(2), at(5), 0, "done")]
    job.feed([("a", 31, 5, "end")])
    assert len(job.run()) == 2


def test_counters_go_on(spark, tmp_path):
    path = str(tmp_path)

    def run():
        feed = spark.readStream.schema("value string").option("maxFilesPerTrigger", 1).text(f"{path}/in")
        jobs.keep_counting(feed, f"{path}/out", f"{path}/checkpoint").awaitTermination()
        return sorted(tuple(r) for r in jobs.counted(spark, f"{path}/out").collect())

    def log(*lines):
        spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("append").text(f"{path}/in")

    log('{"event_type": "a", "k": 2}', '{"event_type": "b"}', '{"event_type": "a", "k')
    assert run() == [("a", 1, 2), ("b", 1, None)]
    log('{"event_type": "a", "k": 5}')
    assert run() == [("a", 2, 7), ("b", 1, None)] == run()
    last = max(glob.glob(f"{path}/checkpoint/commits/[0-9]*"), key=lambda p: int(os.path.basename(p)))
    for name in (last, f"{os.path.dirname(last)}/.{os.path.basename(last)}.crc"):
        if os.path.exists(name):
            os.remove(name)
    assert run() == [("a", 2, 7), ("b", 1, None)]  # the last batch again


def test_fills_are_announced_once(spark, tmp_path):
    path, schema = str(tmp_path), "id int, account string, t timestamp"

    def run(*rows):
        spark.createDataFrame([(i, a, at(h)) for i, a, h in rows], schema).coalesce(1).write.mode("append").parquet(f"{path}/in")
        feed = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
        jobs.announce_fills(feed, ["id", "account"], "t", f"{path}/out", f"{path}/checkpoint").awaitTermination()
        return sorted((r.id, r.account) for r in spark.read.schema(schema).parquet(f"{path}/out").collect())

    assert run((1, "a", 1), (1, "a", 2), (2, "a", 1)) == [(1, "a"), (2, "a")]
    assert run((1, "a", 1), (1, "b", 3)) == [(1, "a"), (1, "b"), (2, "a")]
    assert run((2, "a", 20), (3, "a", 24 * 9)) == [(1, "a"), (1, "b"), (2, "a"), (3, "a")]
    assert run((3, "a", 24 * 9), (1, "a", 24 * 20)) == [(1, "a"), (1, "a"), (1, "b"), (2, "a"), (3, "a")]  # beyond the horizon an id is new


@pytest.mark.parametrize("kind", ["click", None])
def test_other_events_do_not_lose_a_run(spark, tmp_path, kind):
    rows = [(0, 1, "signup", at(0.0)), (1, 1, kind, at(1.0)), (2, 2, "signup", at(87.5)), (3, 2, "click", at(90.0)), (4, 2, kind, at(99.8)), (5, 3, "view", at(100.0)), (6, 4, "signup", at(86.9)), (7, 4, "click", at(99.7))]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, ts timestamp_ntz").write.parquet(f"{tmp_path}/events.parquet")
    got = sorted(tuple(r) for r in catalog.QUERIES["r4_runs_in_flight"](spark, str(tmp_path)).select("user_id", "started_at", "ended_at", "steps", "state").collect())
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert got == sorted(con.sql(f"SELECT user_id, started_at, ended_at, steps, state FROM ({catalog.ORACLES['r4_runs_in_flight']}) x").fetchall())
    assert [(r[0], r[3]) for r in got] == [(1, 0 if kind is None else 1), (4, 0)]  # the run of 2 is in flight


@pytest.mark.parametrize("name", ["r4_runs_in_flight"])
def test_runs_of_a_log_over_months(spark, tmp_path, name):
    rnd, kinds = random.Random(9), ["signup", "purchase", "click", "view"]
    rows = [(i, rnd.randrange(6), rnd.choice(kinds), at(round(rnd.uniform(0, 24 * 70), 1))) for i in range(900)]
    rows += [(900, 6, "signup", at(5)), (901, 6, "click", at(5)), (902, 6, "click", at(6))]  # one at the very start
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, ts timestamp_ntz").write.parquet(f"{tmp_path}/events.parquet")
    got = sorted(str(tuple(r)) for r in catalog.QUERIES[name](spark, str(tmp_path)).select("user_id", "started_at", "ended_at", "steps", "state").collect())
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert got == sorted(str(r) for r in con.sql(f"SELECT user_id, started_at, ended_at, steps, state FROM ({catalog.ORACLES[name]}) x").fetchall())
    assert "(6, '2024-01-01 05:00:00', None, 1, 'lost')" in got


def test_steps_keep_their_order_in_many_files(spark, tmp_path):
    seen, path = [], str(tmp_path)

    def job(feed):
        for f in glob.glob(f"{path}/in/*.parquet"):
            os.utime(f, (1_700_000_000, 1_700_000_000))  # a store that does not tell times apart
        note = lambda batch, number: seen.append((len(batch.select("f").distinct().collect()), [r[0] for r in batch.select("k").distinct().collect()]))
        return feed.withColumn("f", F.input_file_name()).writeStream.foreachBatch(note).option("checkpointLocation", f"{path}/c").trigger(availableNow=True).start()

    steps = [spark.range(40).repartition(3).select("id", F.lit(k).alias("k")) for k in range(3)]
    stream_queries._step_by_step(Tables(spark, path), steps, f"{path}/in", job)
    assert seen == [(3, [0]), (3, [1]), (3, [2])]

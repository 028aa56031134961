"""Views that roll with a clock, and joins in time: brute force, restarts, and what their plans must not hold."""

import datetime
import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from chronolake.operators import joins, windows
from chronolake.plans import catalog
from chronolake.streaming import rolling

SF = "/root/testdata/sf0.001"
DAY0 = datetime.datetime(2024, 1, 1)


def hours(n):
    return DAY0 + datetime.timedelta(hours=n)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def refreshes(seed):
    rnd = random.Random(seed)
    return [(d, hours(h := rnd.randrange(24 * 20)), hours(h + rnd.randint(0, 40))) for d in ("a", "b") for _ in range(12)] + [("c", hours(100), hours(101)), (None, hours(1), hours(1))]


@pytest.mark.parametrize("broadcast", [0, 1000])
def test_newly_visible_by_brute_force(spark, monkeypatch, broadcast):
    monkeypatch.setattr(windows, "BROADCAST_ROWS", broadcast)
    grid, rnd = refreshes(broadcast), random.Random(1)
    facts = [(k, rnd.choice(["a", "b", "c", "none", None]), hours(rnd.randrange(-48, 24 * 21))) for k in range(200)] + [(k + 200, d, opens) for k, (d, opens, _) in enumerate(grid)] + [(900, "a", None)]
    df = spark.createDataFrame(facts, "id int, dataset string, at timestamp_ntz")
    table = spark.createDataFrame(grid, "dataset string, opens timestamp_ntz, ready timestamp_ntz")
    for ready in ("ready", None):
        expected = []
        for k, d, at in facts:
            seen = [(r if ready else o) for g, o, r in grid if d is not None and g == d and at is not None and o >= at]
            if seen:
                expected.append((k, min(seen)))
        assert rows(windows.newly_visible(df, table, "dataset", "at", "opens", ready).select("id", "shown_at")) == sorted(expected, key=str)
    assert windows.newly_visible(df, table.where("false"), "dataset", "at", "opens").count() == 0


def test_facts_are_not_dealt_by_dataset(spark, capsys):
    catalog.QUERIES["w12_newly_visible"](spark, SF).explain()
    plan = capsys.readouterr().out
    facts = next(line for line in plan.split("\n") if "BroadcastHashJoin [_d" in line)
    assert facts and plan.count("FileScan parquet") >= 2
    side = plan[plan.index(facts) :].split("BroadcastExchange")[0]
    assert "Exchange" not in side and "Window" not in side, plan


@pytest.mark.parametrize("block", [None, lambda t: F.floor(t / 4), lambda t: F.floor(t / 1000)])
def test_as_of_by_brute_force(spark, block):
    rnd = random.Random(3)
    right = sorted({(rnd.choice("ab"), rnd.randrange(60)) for _ in range(40)}) + [("c", 5), (None, 5), ("a", None)]
    right = [(k, t, f"{k}{t}", None if t and t % 5 == 0 else 1) for k, t in right]
    left = [(i, rnd.choice(["a", "b", "c", "d", None]), rnd.choice([None, *range(-3, 70)])) for i in range(150)] * 2
    expected = []
    for i, k, t in left:
        met = [r for r in right if None not in (k, t, r[1]) and r[0] == k and r[1] <= t]
        best = max(met, key=lambda r: r[1]) if met else (None, None, None, None)
        expected.append((i, k, t, best[2], best[3]))
    got = joins.as_of(spark.createDataFrame(left, "i int, k string, t int"), spark.createDataFrame(right, "k string, t int, v string, w int"), "k", "t", "t", ["v", "w"], block)
    assert rows(got) == sorted(expected, key=str)


def test_a_hot_key_is_many_tasks(spark, capsys):
    catalog.QUERIES["as_of_join"](spark, SF).explain()
    plan = capsys.readouterr().out
    assert "hashpartitioning(_k#" in plan and "Window [last(_value" in plan
    last = plan[: plan.index("Sort [_k")]
    assert "_b#" in last.split("partitionBy" if "partitionBy" in last else "Window")[-1]


@pytest.mark.parametrize("width", [1, 5, 1000])
def test_first_touch_by_brute_force(spark, width):
    rnd = random.Random(width)
    bars = []
    for code in ("x", "y"):
        for t in sorted(rnd.sample(range(60), 40)):
            o = rnd.randint(90, 110)
            bars.append((code, t, float(o), float(o - rnd.randint(0, 4)), float(o + rnd.randint(0, 4))))
    orders = [(k, rnd.choice(["x", "y", "z"]), rnd.choice(["entry", "exit"]), rnd.randrange(-2, 65), float(rnd.randint(85, 115))) for k in range(150)]
    expected = []
    for k, code, action, at, limit in orders:
        for c, t, o, low, high in bars:
            if c == code and t >= at and ((low < limit or o <= limit) if action == "entry" else (high > limit or o >= limit)):
                expected.append((k, t, min(o, limit) if action == "entry" else max(o, limit)))
                break
    df = spark.createDataFrame(orders, "order_id int, code string, action string, active_ts int, limit double")
    got = joins.first_touch(df, spark.createDataFrame(bars, "code string, bar_ts int, open double, low double, high double"), ["code"], lambda t: F.floor(t / width))
    assert rows(got) == sorted(expected, key=str)


# Rolling


class Replay:
    """Two domains, texts with bodies, and a clock of files."""

    def __init__(self, spark, path, seed=5):
        rnd = random.Random(seed)
        self.spark, self.path = spark, str(path)
        self.frames = {n: spark.createDataFrame([(k, hours(rnd.randrange(24 * 12)) if k % 9 else None) for k in range(80)], "k int, shown_at timestamp_ntz") for n in ("facts", "prices")}
        for n, df in self.frames.items():
            rolling.lay_out(df, f"{self.path}/{n}")
        self.frames["text_index"] = spark.createDataFrame([("d", k, hours(rnd.randrange(24 * 12)) if k % 7 else None) for k in range(40)], "dataset string, text_id int, shown_at timestamp_ntz")
        bodies = spark.createDataFrame([("d", k, f"body {k}") for k in range(50)], "dataset string, text_id int, body string")
        at = rolling.lay_out_texts(self.frames["text_index"], bodies, f"{self.path}/texts")
        self.frames["text_bodies"] = bodies.join(self.frames["text_index"], ["dataset", "text_id"])
        self.layouts = {n: (at.get(n, f"{self.path}/{n}"), df.schema) for n, df in self.frames.items()}
        self.ticks = []

    def tick(self, *at):
        self.ticks += at
        self.spark.createDataFrame([(hours(h),) for h in at], "tick timestamp_ntz").coalesce(1).write.mode("append").parquet(f"{self.path}/clock")

    def run(self):
        clock = self.spark.readStream.schema("tick timestamp_ntz").option("maxFilesPerTrigger", 1).parquet(f"{self.path}/clock")
        rolling.roll(clock, self.layouts, f"{self.path}/out", f"{self.path}/checkpoint").awaitTermination()

    def shown(self, name):
        return rows(rolling.view(self.spark, f"{self.path}/out", name, self.layouts[name][1]))

    def agrees(self):
        ticks = self.spark.createDataFrame([(hours(h),) for h in self.ticks], "tick timestamp_ntz")
        return all(self.shown(n) == rows(rolling.eager(df.select(self.layouts[n][1].names), ticks)) for n, df in self.frames.items())

    def ledger(self):
        return sorted(tuple(r) for r in self.spark.read.schema(rolling.LEDGER).json(f"{self.path}/out/clock/*").collect())


def test_rolling_equals_batch_over_restarts(spark, tmp_path):
    r = Replay(spark, tmp_path)
    r.tick(5)
    r.tick(5, 40, 41)  # repeated, and several at once
    r.run()
    assert r.agrees()
    r.tick(30)  # the clock never goes back
    r.ticks.remove(30)
    r.tick(24 * 9)  # many nodes at once
    r.run()
    assert r.agrees()
    before, version = [r.shown(n) for n in r.layouts], r.ledger()
    # The last step is run again, as after a failure between its writes and its commit.
    last = max(glob.glob(f"{r.path}/checkpoint/commits/[0-9]*"), key=lambda p: int(os.path.basename(p)))
    for name in (last, f"{os.path.dirname(last)}/.{os.path.basename(last)}.crc"):
        if os.path.exists(name):
            os.remove(name)
    r.run()
    assert [r.shown(n) for n in r.layouts] == before and r.ledger() == version
    r.tick(24 * 30)
    r.run()
    assert r.agrees() and [x[0] for x in r.ledger()] == list(range(len(r.ledger())))
    steps = r.ledger()
    assert all(a[4] <= b[4] for a, b in zip(steps, steps[1:], strict=False)) and steps[2][3] == 0 and steps[2][4] == steps[1][4]
    assert {t[1] for t in r.shown("text_bodies")} == {t[1] for t in r.shown("text_index")} == {k for k in range(40) if k % 7}


def test_future_rows_change_nothing(spark, tmp_path):
    a, b = Replay(spark, tmp_path / "a"), Replay(spark, tmp_path / "b")
    later = spark.createDataFrame([(1000, hours(24 * 11 + 1))], "k int, shown_at timestamp_ntz")
    rolling.lay_out(b.frames["facts"].unionByName(later), f"{b.path}/facts")
    for r in (a, b):
        r.tick(24 * 11)
        r.run()
    assert a.shown("facts") == b.shown("facts") and b.agrees()


def test_a_step_reads_its_own_days(spark, tmp_path, capsys):
    r = Replay(spark, tmp_path)
    path, schema = r.layouts["facts"]
    rolling.layout_slice(spark, path, schema, hours(30), hours(50)).explain("formatted")
    plan = capsys.readouterr().out
    assert "PartitionFilters" in plan and "shown_day" in plan.split("PartitionFilters")[1].split("\n")[0] and "shown_at" in plan.split("PushedFilters")[1].split("\n")[0]
    part = rolling.layout_slice(spark, path, schema, hours(30), hours(50))
    assert {f.split("shown_day=")[1][:10] for f in part.inputFiles()} <= {"2024-01-02", "2024-01-03"} or part.rdd.getNumPartitions() <= 2
    assert rows(part) == rows(r.frames["facts"].where((F.col("shown_at") > F.lit(hours(30))) & (F.col("shown_at") <= F.lit(hours(50)))))

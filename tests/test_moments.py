"""Regressions from merged states against regressions on rows."""

import random

import pytest

from chronolake.operators import perf


@pytest.mark.parametrize("shift", [0.0, 1e6])
def test_merged_states_equal_rows(spark, shift):
    rnd = random.Random(1)
    rows = [(rnd.choice("ab"), rnd.randrange(5), shift + (x := rnd.gauss(0, 1)) * 0.7 + rnd.gauss(0, 0.5), shift + x) for _ in range(200)] + [("a", 1, None, 1.0), ("a", 1, 1.0, None), ("c", 1, 1.0, 2.0)]
    df = spark.createDataFrame(rows, "run string, part int, y double, x double")
    states = perf.moments(df, ["run", "part"], "y", "x")
    halves = perf.merged(states.where("part < 2"), ["run"]).unionByName(perf.merged(states.where("part >= 2"), ["run"]))
    whole = df.where("y is not null and x is not null")
    expected = sorted(tuple(r) for r in perf.regression(whole, "run", "y", "x").select("run", "n", "beta", "alpha", "r2").collect())
    got = [sorted(tuple(r) for r in perf.regression_of(s).select("run", "n", "beta", "alpha", "r2").collect()) for s in (perf.merged(states, ["run"]), perf.merged(halves, ["run"]))]
    for one in got:
        for a, b in zip(one, expected, strict=True):
            assert a[:2] == b[:2] and all((p is None) == (q is None) and (p is None or abs(p - q) <= 1e-3 * max(1, abs(q)) * (1 if shift == 0 else 400)) for p, q in zip(a[2:], b[2:], strict=True)), (a, b)
    assert expected[-1][2:] == (None, None, None)  # one pair


def test_first_window_owns_a_date(spark):
    windows = spark.createDataFrame([("r", "w2", 1, 9.0), ("r", "w1", 1, 1.0), ("r", "w1", 2, None), ("r", "w2", 2, 2.0), ("r", "w2", 3, 3.0), ("r", "w2", 4, 3.0)], "run string, w string, d int, y double")
    index = spark.createDataFrame([(1, 0.1), (2, 0.2), (3, None)], "d int, x double")
    got = {r.w: (r.n, r.mean_y, round(r.mean_x, 9)) for r in perf.chained_moments(windows, "run", "w", "d", "y", index, "x").collect()}
    assert got == {"w1": (1, 1.0, 0.1), "w2": (1, 2.0, 0.2)}


def test_averages_are_weighted_by_days(spark):
    stats = spark.createDataFrame([("r", 10, 1.0, None), ("r", 30, 3.0, 2.0), ("r", 0, 99.0, 9.0), ("s", 5, None, None)], "run string, days int, a double, b double")
    got = sorted(tuple(r) for r in perf.weighted_by_days(stats, "run", "days", ["a", "b"]).collect())
    assert got == [("r", 40, 2.5, 2.0), ("s", 5, None, None)]


def test_exposure_legs_and_order_stats(spark):
    held = spark.createDataFrame([("a", 1, "long", 60.0), ("a", 1, "short", 20.0), ("a", 2, "short", 50.0)], "account string, day int, side string, market_value double")
    equity = spark.createDataFrame([("a", 1, 100.0), ("a", 2, 100.0), ("a", 3, 100.0)], "account string, day int, value double")
    r = perf.exposure(held, equity, "account", "day", "value").first()
    assert [round(x, 9) for x in (r.average, r.highest, r.long, r.short)] == [round(1.3 / 3, 9), 0.8, 0.2, round(0.7 / 3, 9)] and r.zero_dates == 1
    orders = [("buy", 1, f"c{k % 10}", "r" if k % 4 == 0 else None, "filled" if k % 2 else "open", f"d{k % 3}", k) for k in range(40)]
    got = [tuple(r) for r in perf.order_stats(spark.createDataFrame(orders, "action string, account int, code string, reason string, status string, day string, amount int"), codes=3).collect()]
    assert ("action", "buy", 40, 780) in got and ("account", "1", 40, 780) in got and ("reason", "r", 10, 180) in got
    assert [g[1] for g in got if g[0] == "code"] == ["c9", "c8", "c7"] and sum(g[2] for g in got if g[0] == "day") == 20

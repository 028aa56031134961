"""Corporate actions and auction alignment on worked examples."""

from pyspark.sql import functions as F

from chronolake.operators import actions, joins

COLUMNS = "ts_code end_date div_proc ex_date available_at cash_div_tax cash_div stk_div stk_bo_rate stk_co_rate record_date pay_date div_listdate".split()
BASE = dict(zip(COLUMNS, ("a", "e", "实施", "20240110", "2024-01-05T18:00:00+08:00", "1", None, None, None, None, "20240109", "20240111", None)))


def built(spark, *changes):
    return spark.createDataFrame([tuple({**BASE, **c}.values()) for c in changes], ", ".join(f"{c} string" for c in COLUMNS))


def act(spark, *changes):
    return [tuple(r) for r in actions.corporate_actions(built(spark, *changes), "20240101", "20240131").orderBy("ts_code", "ex_date").collect()]


def test_latest_version_counts_and_events_of_a_day_are_summed(spark):
    late = {"available_at": "2024-01-06T18:00:00+08:00", "cash_div_tax": "3"}
    assert act(spark, {}, late) == [("a", "20240110", 3.0, 0.0, "20240109", "20240111", "")]
    other = {"end_date": "f", "available_at": "2024-01-04T18:00:00+08:00", "record_date": None, "pay_date": "20240120", "div_listdate": "20240130"}
    assert act(spark, {}, late, other) == [("a", "20240110", 4.0, 0.0, "", "20240120", "20240130")]


def test_amounts_fall_back_and_stay_above_zero(spark):
    assert act(spark, {"cash_div_tax": "n/a", "cash_div": "0.5", "stk_bo_rate": "0.1", "stk_co_rate": "0.2"})[0][2:4] == (0.5, 0.1 + 0.2)
    assert act(spark, {"cash_div_tax": "nan", "cash_div": None, "stk_div": "0.4", "stk_bo_rate": "9"})[0][2:4] == (0.0, 0.4)
    assert act(spark, {"cash_div_tax": "-1", "cash_div": "5"}) == [] and act(spark, {"cash_div_tax": None}) == []


def test_what_is_dropped(spark):
    faults = [{"ex_date": None}, {"ex_date": " "}, {"available_at": "2024-01-11T00:00:00+08:00"}, {"ex_date": "20230110"}, {"div_proc": "预案", "ex_date": None}, {"div_proc": None}]
    assert act(spark, *faults) == []
    assert tuple(actions.dropped_actions(built(spark, *faults), "20240101", "20240131").first()) == (2, 1)
    assert act(spark, {"available_at": "2024-01-10T23:00:00+08:00"}) != []


def test_ratios_before_and_after_the_factor(spark):
    schema = "d string, c string, t string, vol double, amount double"
    minutes = spark.createDataFrame([("1", "000001.SZ", "09:30", 10.0, 0.0), ("1", "000002.SZ", "09:30", 30.0, 5.0), ("1", "000001.SZ", "15:00", 7.0, 7.0), ("1", "600000.SH", "09:30", 1.0, 1.0)], schema)
    auction = spark.createDataFrame([("1", "000001.SZ", 10.0, 2.0), ("1", "000002.SZ", 10.0, 5.0), ("1", "600000.SH", 0.0, None)], "d string, c string, vol double, amount double")
    out = {(r.bucket, r.ratio): (r.matched, r.n, r.median) for r in actions.auction_alignment(minutes, auction, "d", "c", "t").withColumn("median", F.round("median", 9)).collect()}
    assert out[("sz_main_00", "vol")] == (2, 2, 2.0) and out[("sz_main_00", "vol_after_factor")] == (2, 2, 1.52)
    assert out[("sz_main_00", "amount")] == (2, 2, 0.5) and out[("sh_main_60", "amount")] == (1, 0, None) and len(out) == 8


def test_names_and_members_in_force(spark):
    names = spark.createDataFrame([("a", "old", "20230101", None), ("a", "new", "20240101", "20231220"), ("a", "next", "20240105", "20240301"), ("b", "only", "20240201", None)], "code string, name string, start_date string, ann_date string")
    assert [tuple(r) for r in joins.names_as_of(names, "code", "name", F.lit("20240110")).collect()] == [("a", "new")]
    members = spark.createDataFrame([("a", "x", None, "20240110"), ("a", "y", "20230101", "None"), ("b", "x", "20240111", None), ("c", "x", "", " ")], "code string, l1 string, in_date string, out_date string")
    assert sorted(tuple(r) for r in joins.members_as_of(members, "code", "l1", F.lit("20240110")).collect()) == [("a", "y"), ("c", "x")]
    assert ("a", "x") not in [tuple(r) for r in joins.members_as_of(members, "code", "l1", F.lit("20240109")).collect()]

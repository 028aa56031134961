"""Worked examples of the point-in-time operators on small frames."""

import datetime

import pytest
from pyspark.sql import functions as F

from chronolake.functions import market, timecols
from chronolake.operators import asof, audit, joins, perf, text, windows
from chronolake.sources import lake
from chronolake.streaming import jobs


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_auction_factors(spark):
    df = spark.createDataFrame([("000001.SZ", "09:30", 1000.0, 2000.0), ("300001.SZ", "09:30", 1000.0, 2000.0), ("600000.SH", "09:30", 1000.0, 2000.0), ("000001.SZ", "15:00", 1000.0, 2000.0)], "ts_code string, trade_time string, vol double, amount double")
    out = rows(market.open_auction_correction(df).select("vol_pit", "amount_pit", "auction_rule"))
    assert out == [(760.0, 1520.0, "factor"), (580.0, 1160.0, "factor"), (1000.0, 2000.0, "none"), (1000.0, 2000.0, "none")]


def test_auction_repair(spark):
    df = spark.createDataFrame([(1, None, 1000.0, 10000.0), (2, 99.0, 0.0, 0.0), (3, None, None, None), (4, 5.0, 2.0, 20.0)], "k int, price double, vol double, amount double")
    assert rows(market.auction_price_repair(df).select("k", "price", "auction_state")) == [(1, 10.0, "recovered"), (2, None, "no_trade"), (4, 5.0, "bad")]


def test_time_columns(spark):
    df = spark.createDataFrame([("2024-01-02 08:00:00",), ("2024-01-02T00:00:00Z",), ("20240102 09:00:00",), ("x",), (None,)], "t string")
    out = [r[0] for r in df.select(F.date_format(timecols.to_cn_timestamp("t"), "yyyy-MM-dd HH:mm:ss")).collect()]
    assert out == ["2024-01-02 00:00:00", "2024-01-02 00:00:00", "2024-01-02 01:00:00", None, None]
    dates = spark.createDataFrame([("2024-02-30",), ("20240229.0",), ("nan",), ("2024",)], "t string").select(timecols.clean_date("t")).collect()
    assert [r[0] for r in dates] == [None, "20240229", None, None]


def test_text_stamp_far_from_its_date(spark):
    df = spark.createDataFrame([("20240110", "2024-01-11 10:00:00"), ("20240110", "2024-03-11 10:00:00"), ("20240110", None)], "d string, t string")
    at, rule = timecols.text_available_at("t", "d")
    assert rows(df.select(at, rule)) == [("2024-01-11 10:00:00", "source_time"), ("2024-01-10 23:59:59", "implausible"), ("2024-01-10 23:59:59", "date_end")]


def test_window_merge(spark):
    schema = "d string, v int"
    out = lake.window_merge(spark.createDataFrame([("0501", 1), ("0515", 2)], schema), spark.createDataFrame([("0515", 20), ("0516", 30)], schema), "d", "0510", "0520", ["d"])
    assert sorted(rows(out)) == [("0501", 1), ("0515", 20), ("0516", 30)]


def test_reversed_range_is_empty(spark):
    assert lake.trade_range(spark.range(3).withColumn("d", F.lit("1")), "d", "2", "1", ["d"]).count() == 0
    with pytest.raises(ValueError):
        lake.trade_date(spark.range(3).withColumn("d", F.lit("1")), "d", "9", ["d"])


def test_baseline_union_keeps_capped_groups(spark):
    active = spark.createDataFrame([("a", 1, 10, False), ("b", 2, 20, True)], "g string, id int, v int, capped boolean")
    base = spark.createDataFrame([("a", 7, 1), ("b", 8, 2)], "g string, id int, v int")
    out = lake.union_with_baseline(active, base, ["g"], ["id"], "capped").select("g", "id", "v")
    assert sorted(rows(out)) == [("a", 1, 10), ("b", 2, 20), ("b", 8, 2)]
    again = lake.union_with_baseline(active, out, ["g"], ["id"], "capped").select("g", "id", "v")
    assert sorted(rows(again)) == sorted(rows(out))


def test_overwrite_guards(spark):
    old, empty = spark.range(100), spark.range(0)
    action = lambda new, **o: lake.overwrite_decision(old, new, ["id"], **o).first().action
    assert (action(empty), action(spark.range(60)), action(spark.range(95)), action(spark.range(95), allow_removal=False)) == ("skip_empty", "block", "overwrite", "skip_removed")


def test_manifest_keeps_the_first_availability(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "p int, v string"), spark.createDataFrame([(1, "x"), (2, "z")], "p int, v string")
    first = lake.manifest(lake.fingerprint(a, "p"), None, ["p"], F.lit("t1"))
    assert {r.p: r.available_at for r in lake.manifest(lake.fingerprint(b, "p"), first, ["p"], F.lit("t2")).collect()} == {1: "t1", 2: "t2"}


def test_ledger_version(spark, tmp_path):
    (tmp_path / "l.json").write_text('{"schema_version": 2, "record_type": "fold"}\n{"schema_version": 3, "record_type": "fold"}\n')
    schema = spark.createDataFrame([], "schema_version int, record_type string").schema
    with pytest.raises(Exception, match="schema_version 3"):
        lake.read_ledger(spark, str(tmp_path), schema, 2).collect()


def test_compaction(spark, tmp_path):
    ticks = spark.createDataFrame([("d1", "b", "1", 1.0), ("d1", "a", "1", 2.0), ("d1", "a", "1", 2.0), ("d2", "a", "1", 3.0)], "trade_date string, ts_code string, trade_time string, price double")
    lake.compact_by_date(ticks, str(tmp_path / "c"), "trade_date", ["ts_code", "trade_time"])
    assert spark.read.parquet(str(tmp_path / "c")).count() == 3
    lake.export_csv(ticks, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 4


def test_daily_fallback(spark):
    daily = spark.createDataFrame([("d", "c", 10.0, 11.0, 5.0)], "trade_date string, ts_code string, open double, close double, vol double")
    minutes = spark.createDataFrame([("d", "c", "10:00", 10.5, 2.0)], "trade_date string, ts_code string, trade_time string, price double, vol double")
    out = sorted(rows(joins.daily_fallback(daily, minutes).select("trade_time", "price", "vol", "synthetic")))
    assert out == [("09:30", 10.0, None, True), ("10:00", 10.5, 2.0, False), ("15:00", 11.0, 5.0, True)]


def test_as_of(spark):
    left = spark.createDataFrame([("a", 5), ("a", 1), ("b", 9)], "k string, t int")
    right = spark.createDataFrame([("a", 5, "x"), ("a", 2, "y"), ("b", 10, "z")], "k string, t int, v string")
    assert sorted(rows(joins.as_of(left, right, "k", "t", "t", ["v"])), key=str) == [("a", 1, None), ("a", 5, "x"), ("b", 9, None)]


def test_average_tie_rank(spark):
    df = spark.createDataFrame([(1, 3.0), (1, 1.0), (1, 3.0), (1, None)], "d int, v double")
    assert sorted(rows(windows.pct_rank_avg(df, "d", "v", "p").select("v", "p")), key=str) == [(1.0, 1 / 3), (3.0, 2.5 / 3), (3.0, 2.5 / 3), (None, 0.5)]


def test_week_ends_on_sunday(spark):
    df = spark.createDataFrame([(1, datetime.date(2022, 1, 4), 1.0), (1, datetime.date(2022, 1, 12), 2.0)], "k int, d date, v double")
    assert [str(r.week_end) for r in windows.weekly_last(df, "k", "d", "v", F.lit(1.0)).orderBy("week_end").collect()] == ["2022-01-09", "2022-01-16"]


def test_regression_needs_eight_days(spark):
    pairs = [(1, x * 2, x) for x in [0.01, -0.01] * 4] + [(2, 0.02, 0.01), (2, 0.0, 0.0)]
    out = {r.k: (r.beta, r.r2) for r in perf.regression(spark.createDataFrame(pairs, "k int, y double, x double"), "k", "y", "x").collect()}
    assert out == {1: (2.0, 1.0), 2: (None, None)}


def test_compound_active_of_pairs(spark):
    df = spark.createDataFrame([(1, 0.5, 0.2), (1, -0.4, 0.2), (1, 0.9, None)], "e int, y double, x double")
    assert abs(perf.fold_report(df, "e", "y", "x").first().active - (1.5 * 0.6 / 1.44 - 1)) < 1e-12


def test_corporate_actions(spark):
    e = [("c", 1, "20211008", "20211001", 1, "done", 0.4, 0.0), ("c", 1, "20211008", "20211002", 2, "done", 0.5, 0.0), ("c", 2, "20211008", "20211003", 3, "done", 0.1, 0.5), ("c", 3, "20211008", "20211003", 4, "plan", 9.0, 0.0), ("c", 4, "20211008", "20211101", 5, "done", 9.0, 0.0), ("c", 5, "20230101", "20211001", 6, "done", 9.0, 0.0)]
    out = perf.corporate_actions(spark.createDataFrame(e, "code string, event int, ex_date string, ann_date string, version int, state string, cash double, stock double"), "20210901", "20211231").collect()
    assert len(out) == 1 and abs(out[0].cash - 0.6) < 1e-9 and out[0].stock == 0.5


def test_redaction_and_guard(spark):
    df = spark.createDataFrame([("Bearer abcdefghij1 api_key=12345 https://u:p@h/x",)], "t string")
    assert df.select(text.redact(F.col("t"))).first()[0] == "Bearer [REDACTED] api_key=[REDACTED] https://[REDACTED]@h/x"
    for bad in ("a" * 300, "(?=x)", r"(a)\1"):
        with pytest.raises(ValueError):
            text.guarded(bad)


def test_search_limit_counts_visible_rows_only(spark):
    index = spark.createDataFrame([(1, "own thing", 5, "c"), (2, "thing", 9, "x"), (3, "other", 3, "x")], "text_id int, title string, available_at int, code string")
    bodies = spark.createDataFrame([(1, ""), (2, ""), (3, "a thing")], "text_id int, body string")
    assert [r.text_id for r in text.search(index, bodies, "thing", F.col("code") == "c", F.lit(6), 2).collect()] == [1, 3]


def test_future_rows_never_change_a_view(spark):
    frozen = spark.createDataFrame([("a", 1)], "dataset string, available_at int")
    replay = spark.createDataFrame([("a", 5), ("a", 9), ("b", 1)], "dataset string, available_at int")
    cutoffs = spark.createDataFrame([("a", 6)], "dataset string, cutoff int")
    seen = sorted(rows(asof.visible(frozen, replay, cutoffs)))
    later = replay.union(spark.createDataFrame([("a", 100)], replay.schema))
    assert seen == [("a", 1), ("a", 5)] == sorted(rows(asof.visible(frozen, later, cutoffs)))


def test_screen_lets_indexes_pass(spark):
    df = spark.createDataFrame([("000001.SZ",), ("600000.SH",), ("CSI300",), (None,)], "ts_code string")
    assert {r[0] for r in audit.apply_screen(df, "ts_code", spark.createDataFrame([("600000.SH",)], "c string")).collect()} == {"600000.SH", "CSI300", None}


def test_canonical_values(spark):
    df = spark.createDataFrame([(" 1.500 ",), ("100",), ("NaN",), ("-0.0",), ("a1",), (None,)], "v string")
    assert [r[0] for r in df.select(audit.canonical("v")).collect()] == ["1.5", "100", "", "0", "a1", ""]


def test_ingest_twice_gives_the_same_store(spark, tmp_path):
    schema = "ts_code string, trade_time string, price double, trade_date string"
    spark.createDataFrame([("a", "1", 1.0, "d1"), ("a", "1", 1.0, "d1"), ("b", "1", 2.0, "d2")], schema).write.parquet(str(tmp_path / "in"))
    feed = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    for k in (1, 2):
        jobs.ingest_minutes(feed(), str(tmp_path / "store"), ["ts_code", "trade_time"], "trade_date", str(tmp_path / f"c{k}")).awaitTermination()
        assert spark.read.parquet(str(tmp_path / "store")).count() == 2


def test_rolling_view_equals_the_eager_one(spark, tmp_path):
    replay = spark.createDataFrame([("a", k) for k in range(20)], "dataset string, available_at int")
    ticks = spark.createDataFrame([(4,), (4,), (11,), (15,)], "when int").coalesce(1)
    for k, v in enumerate((4, 11, 15)):
        ticks.where(F.col("when") == v).coalesce(1).write.parquet(str(tmp_path / f"clock/{k}"))
    files = str(tmp_path / "clock/*")
    state = {"before": None}

    def cutoffs(batch):
        top = batch.agg(F.max("when")).first()[0]
        out = spark.createDataFrame([("a", state["before"], top)], "dataset string, before int, cutoff int")
        state["before"] = top
        return out

    clock = spark.readStream.schema("when int").option("maxFilesPerTrigger", 1).parquet(files)
    jobs.roll_as_of(clock, replay, cutoffs, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = sorted(r.available_at for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == list(range(state["before"] + 1)) and state["before"] == 15


def test_transitions_stream_equals_batch(spark, tmp_path):
    data = [("k", 1, False), ("k", 2, True), ("k", 3, True), ("k", 4, False), ("j", 1, True)]
    spark.createDataFrame(data, "k string, t int, bad boolean").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = jobs.transitions_stream(spark.readStream.schema("k string, t int, bad boolean").parquet(str(tmp_path / "in")), "k", "t", "bad")
    stream.writeStream.format("memory").queryName("turns").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    batch = jobs.transitions(spark.read.parquet(str(tmp_path / "in")), "k", "t", "bad")
    assert sorted(rows(spark.table("turns"))) == sorted(rows(batch)) == [("j", 1, "alert"), ("k", 2, "alert"), ("k", 4, "recovered")]


def test_fill_dedup_stream(spark, tmp_path):
    spark.createDataFrame([(1, "a", "2024-01-01 00:00:00"), (1, "a", "2024-01-01 01:00:00"), (2, "a", "2024-01-01 00:00:00")], "id int, account string, t string").withColumn("t", F.col("t").cast("timestamp")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = jobs.fill_dedup(spark.readStream.schema("id int, account string, t timestamp").parquet(str(tmp_path / "in")), ["id", "account"], "t")
    stream.writeStream.format("memory").queryName("fills").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("fills").count() == 2


def test_range_scans_prune_folders(spark, capsys):
    from chronolake.plans import catalog

    for name in ("scan_trade_range", "scan_minute_day"):
        catalog.QUERIES[name](spark, "/root/testdata/sf0.001").explain("formatted")
        plan = capsys.readouterr().out
        assert "PartitionFilters: [isnotnull(trade_month" in plan and "trade_month#" in plan.split("PartitionFilters")[1], plan


def test_keep_one_takes_part_before_the_shuffle(spark, capsys):
    df = spark.createDataFrame([(1, 2, None), (1, 2, "a"), (1, 1, "z"), (None, 3, "n"), (None, 4, "m")], "k int, o int, v string")
    assert sorted(map(tuple, windows.keep_one(df, ["k"], ["o"], "last").collect()), key=str) == sorted([(1, 2, "a"), (None, 4, "m")], key=str)
    assert sorted(map(tuple, windows.keep_one(df, ["k"], ["o"], "first").collect()), key=str) == sorted([(1, 1, "z"), (None, 3, "n")], key=str)
    windows.keep_one(df, ["k"], ["o"]).explain()
    assert "partial_max" in capsys.readouterr().out


def test_every_query_has_rows(spark):
    from chronolake.plans import catalog

    for name in ("universe_screen", "a6_exchange_completeness", "apply_screen", "j13_benchmark_match", "a28_unliquidated", "read_ledger", "csv_export", "canonical_range", "compact_by_date"):
        assert not catalog.QUERIES[name](spark, "/root/testdata/sf0.001").isEmpty(), name

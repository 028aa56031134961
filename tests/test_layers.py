"""Audits of stored layers on worked examples."""

from chronolake.operators import layers

EVENT = "part_dataset string, part_month string, dataset string, available_at string, available_at_rule string, available_month string, business_key string, source_path string, source_hash string, source_row_id string, ann_date string"
GOOD = {"part_dataset": "forecast_vip", "part_month": "202401", "dataset": "forecast_vip", "available_at": "2024-01-10 18:00:00+08:00", "available_at_rule": "source:ann_date", "available_month": "202401", "business_key": "a", "source_path": "raw/forecast_vip/1.parquet", "source_hash": "h1", "source_row_id": "1", "ann_date": "20240110"}


def audit(spark, *changes, files=(("raw/forecast_vip/1.parquet", "h1"),), first="20240101", last="20240131"):
    events = spark.createDataFrame([tuple({**GOOD, "business_key": f"k{i}", **c}.values()) for i, c in enumerate(changes)], EVENT)
    known = spark.createDataFrame(list(files), "source_path string, source_hash string")
    return layers.event_layer_audit(events, known, ["forecast_vip"], first, last).first().asDict()


def test_each_fault_raises_its_own_counter(spark):
    faults = {
        "unparseable": {"available_at": None}, "outside_window": {"available_at": "2024-02-01 00:00:00+08:00"}, "wrong_month": {"available_month": None}, "wrong_dataset": {"dataset": "dividend"}, "disallowed_rule": {"available_at_rule": None},
        "backdated": {"ann_date": "20240111"}, "bad_row_id": {"source_row_id": "x"}, "hash_mismatch": {"source_hash": "h2"}, "blank_hash": {"source_hash": None},
    }
    assert audit(spark, {})["severity"] == "info"
    for name, change in faults.items():
        out = audit(spark, {}, change)
        assert {k for k in (*layers._ERRORS, *layers._WARNINGS) if out[k]} == {name}, name
        assert out[name] == 1 and out["rows"] == 2 and out["severity"] == ("warning" if name == "blank_hash" else "error")


def test_paths_and_repeated_keys(spark):
    out = audit(spark, {"source_path": " "}, {"source_path": "raw/dividend/1.parquet"}, {"business_key": "same"}, {"business_key": "same"})
    assert (out["blank_path"], out["wrong_path"], out["missing_path"], out["repeated_keys"]) == (1, 2, 2, 2)
    assert audit(spark, {"source_hash": "h9"}, files=[("raw/forecast_vip/1.parquet", None)])["hash_mismatch"] == 0


def test_months_missing_and_not_asked_for(spark):
    out = audit(spark, {}, {"part_month": "202405", "available_month": "x"}, first="20231230", last="20240201")
    assert (out["rows"], out["months"], out["missing_months"], out["named_months"], out["severity"]) == (1, 1, 2, "202312,202402", "warning")
    none = audit(spark, {"part_dataset": "dividend"})
    assert (none["rows"], none["months"], none["named_months"], none["severity"]) == (0, 0, "202401", "warning")


def test_months_of_a_window():
    assert layers.months_between("20231115", "20240102") == ["202311", "202312", "202401"]


MINUTE = "d string, ts_code string, trade_date string, trade_time string, available_at string"


def day(spark, rows, codes, least=0, allow=0):
    minutes = spark.createDataFrame([("20240102", c, "20240102" if w is None else w, t, a) for c, t, w, a in rows], MINUTE)
    expected = spark.createDataFrame([("20240102", c) for c in codes], "d string, ts_code string")
    return layers.minute_day_audit(minutes, expected, "d", "ts_code", least, allow).first().asDict()


OPEN, CLOSE = ("a", "2024-01-02 09:30:00", None, ""), ("a", "2024-01-02 15:00:00", None, "2024-01-02 20:00:00")


def test_minute_day(spark):
    assert day(spark, [OPEN, CLOSE], ["a"], least=2)["ok"]
    for fault in ([OPEN], [OPEN, CLOSE, CLOSE], [OPEN, CLOSE, ("a", "2024-01-02 10:00:00", "20240103", "")], [OPEN, CLOSE, ("a", "x", None, "")], [OPEN, CLOSE, ("a", "2024-01-02 10:00:00", None, "soon")]):
        assert not day(spark, fault, ["a"])["ok"]
    off = day(spark, [OPEN, CLOSE, ("a", "2024-01-02 12:00:00", None, "")], ["a"])
    assert off["ok"] and (off["off_session"], off["times"]) == (1, 3)


def test_minute_day_codes(spark):
    out = day(spark, [OPEN, CLOSE, (None, "2024-01-02 09:31:00", None, "")], [*(f"m{i:02d}" for i in range(30)), None], allow=30)
    assert (out["rows"], out["codes"], out["missing"], out["extra"], out["named_extra"], out["ok"]) == (3, 1, 30, 1, "a", True)
    assert out["named_missing"].split(",") == [f"m{i:02d}" for i in range(20)]
    empty = day(spark, [], ["a"])
    assert (empty["rows"], empty["missing"], empty["ok"]) == (0, 1, False) and day(spark, [], ["a"], allow=1)["ok"]

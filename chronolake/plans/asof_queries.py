"""Queries of refresh nodes, periods and schedules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import asof
from ..sources import lake
from .registry import Tables, query

#: dataset, start minute, minutes, weekdays of the refresh nodes that the queries use.
NODES = [("click", 540, 30, [0, 1, 2, 3, 4]), ("click", 1260, 45, [0, 1, 2, 3, 4, 5, 6]), ("view", 480, 60, [0, 2, 4]), ("purchase", 1320, 90, [0, 1, 2, 3, 4]), ("signup", 60, 10, [6])]
_WHEN = "2024-01-20 10:00:00"
NODES_SQL = ", ".join(f"('{d}', {s}, {m}, [{', '.join(map(str, w))}])" for d, s, m, w in NODES)
_RUNS = f"""runs AS (SELECT dataset, day + to_minutes(s) AS start, day + to_minutes(s + m) AS ready FROM (VALUES {NODES_SQL}) n(dataset, s, m, w),
    (SELECT unnest(generate_series(TIMESTAMP '2024-01-10', TIMESTAMP '2024-01-30', INTERVAL 1 DAY)) AS day) d WHERE list_contains(w, isodow(day) - 1))"""


def refresh_nodes(t: Tables) -> DataFrame:
    return t.spark.createDataFrame(NODES, "dataset string, start_minute int, minutes int, weekdays array<int>")


def _when():
    return F.lit(_WHEN).cast("timestamp_ntz")


def _text(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


@query(f"WITH {_RUNS}, c AS (SELECT dataset, max(start) AS cutoff FROM runs WHERE ready <= TIMESTAMP '{_WHEN}' GROUP BY 1) SELECT p.dataset, strftime(cutoff, '%Y-%m-%d %H:%M:%S') AS cutoff, count(*) AS n FROM {{pit}} p JOIN c USING (dataset) WHERE available_at <= cutoff GROUP BY ALL")
def refresh_cutoff(t: Tables) -> DataFrame:
    cut = asof.refresh_cutoff(refresh_nodes(t), _when())
    return t.pit.join(cut, "dataset").where("available_at <= cutoff").groupBy("dataset", "cutoff").agg(F.count("*").alias("n")).select("dataset", _text("cutoff"), "n")


@query(f"WITH {_RUNS}, b AS (SELECT dataset, min(ready) AS boundary FROM runs WHERE ready > TIMESTAMP '{_WHEN}' GROUP BY 1) SELECT p.dataset, strftime(boundary, '%Y-%m-%d %H:%M:%S') AS boundary, count(*) AS waiting FROM {{pit}} p JOIN b USING (dataset) WHERE available_at > TIMESTAMP '{_WHEN}' AND available_at <= boundary GROUP BY ALL")
def next_refresh_boundary(t: Tables) -> DataFrame:
    nxt = asof.next_boundary(refresh_nodes(t), _when())
    return t.pit.join(nxt, "dataset").where((F.col("available_at") > _when()) & (F.col("available_at") <= F.col("boundary"))).groupBy("dataset", "boundary").agg(F.count("*").alias("waiting")).select("dataset", _text("boundary"), "waiting")


@query(f"WITH {_RUNS}, c AS (SELECT dataset, max(start) AS cutoff FROM runs WHERE ready <= TIMESTAMP '{_WHEN}' GROUP BY 1) SELECT event_id FROM {{pit}} p WHERE ts < TIMESTAMP '2024-01-05' UNION ALL SELECT event_id FROM {{pit}} p JOIN c USING (dataset) WHERE ts >= TIMESTAMP '2024-01-05' AND available_at <= cutoff")
def j5_visibility_join(t: Tables) -> DataFrame:
    start = F.lit("2024-01-05").cast("timestamp_ntz")
    return asof.visible(t.pit.where(F.col("ts") < start), t.pit.where(F.col("ts") >= start), asof.refresh_cutoff(refresh_nodes(t), _when())).select("event_id")


@query("""SELECT o_orderkey, strftime(CASE o_orderkey % 3 WHEN 0 THEN date_trunc('month', o_orderdate) WHEN 1 THEN date_trunc('quarter', o_orderdate) ELSE date_trunc('week', o_orderdate) END, '%Y%m%d') AS first,
    strftime(CASE o_orderkey % 3 WHEN 0 THEN date_trunc('month', o_orderdate) + INTERVAL 1 MONTH WHEN 1 THEN date_trunc('quarter', o_orderdate) + INTERVAL 3 MONTH ELSE date_trunc('week', o_orderdate) + INTERVAL 7 DAY END - INTERVAL 1 DAY, '%Y%m%d') AS last FROM orders""")
def period_bounds(t: Tables) -> DataFrame:
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 3
    week = F.concat(F.extract(F.lit("YEAROFWEEK"), d).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(d).cast("string"), 2, "0"))
    label = F.when(k == 0, F.date_format(d, "yyyy-MM")).when(k == 1, F.concat(F.year(d).cast("string"), F.lit("Q"), F.quarter(d).cast("string"))).otherwise(week)
    rows = t.orders.select("o_orderkey", label.alias("p"))
    return rows.select("o_orderkey", F.date_format(asof.period_start(F.col("p")), "yyyyMMdd").alias("first"), F.date_format(asof.period_end(F.col("p")), "yyyyMMdd").alias("last"))


@query("SELECT cal_date, lag(cal_date) OVER (ORDER BY cal_date) AS previous, lag(cal_date) OVER (ORDER BY cal_date) || ' 23:59:59' AS anchor FROM {calendar} c")
def w6_prev_trading_day(t: Tables) -> DataFrame:
    return asof.previous_days(t.calendar, "cal_date").select("cal_date", "previous", F.concat("previous", F.lit(" 23:59:59")).alias("anchor"))


@query("""WITH m AS (SELECT substr(cal_date, 1, 6) AS m, min(cal_date) AS a, max(cal_date) AS b FROM {calendar} c GROUP BY 1 HAVING count(*) >= 2),
    f AS (SELECT t.m AS fold, strftime(strptime(t.m || '01', '%Y%m%d') - INTERVAL 7 MONTH, '%Y%m%d') AS input_first, v.a AS val_first, v.b AS val_last, t.a AS test_first, t.b AS test_last FROM m t JOIN m v ON v.m = strftime(strptime(t.m || '01', '%Y%m%d') - INTERVAL 1 MONTH, '%Y%m'))
    SELECT fold, input_first, val_first, val_last, test_first, test_last, count(*) AS facts FROM f JOIN {statements} s ON ann_date BETWEEN input_first AND test_last GROUP BY ALL""")
def c9_fold_schedule(t: Tables) -> DataFrame:
    folds = asof.fold_schedule(t.calendar, "cal_date", 6)
    return asof.facts_by_fold(t.statements, "ann_date", folds, "input_first", "test_last").groupBy(*folds.columns).agg(F.count("*").alias("facts"))


@query("SELECT count(*) AS days, min(cal_date) AS first, max(cal_date) AS last FROM {calendar} c WHERE cal_date BETWEEN (SELECT max(x) FROM (SELECT min(ann_date) AS x FROM {statements} s UNION ALL SELECT min(trade_date) FROM {ticks} t) y) AND (SELECT min(x) FROM (SELECT max(ann_date) AS x FROM {statements} s UNION ALL SELECT max(trade_date) FROM {ticks} t) y)")
def c11_calendar_clamp(t: Tables) -> DataFrame:
    spans = [df.agg(F.min(c).alias("a"), F.max(c).alias("b")) for df, c in ((t.statements, "ann_date"), (t.ticks, "trade_date"))]
    both = lake.union_by_name(*spans).agg(F.max("a").alias("a"), F.min("b").alias("b"))
    inside = t.calendar.join(F.broadcast(both), F.col("cal_date").between(F.col("a"), F.col("b")))
    return inside.agg(F.count("*").alias("days"), F.min("cal_date").alias("first"), F.max("cal_date").alias("last"))

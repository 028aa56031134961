"""Queries of audits and screens."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import audit, joins, layers, windows
from ..sources import lake
from .registry import Tables, query


@query("SELECT dataset, sum(n) AS rows, CAST(0 AS BIGINT) AS blank_rows, sum(n - 1) AS repeated_rows FROM (SELECT dataset, code, period, count(*) AS n FROM {statements} s GROUP BY 1, 2, 3) x GROUP BY dataset")
def a2_key_audit(t: Tables) -> DataFrame:
    out = audit.key_audit(t.statements, ["code", "period"], "dataset")
    return out.select("dataset", *(F.col(c).cast("long").alias(c) for c in ("rows", "blank_rows", "repeated_rows")))


@query("""WITH p AS (SELECT CAST(month AS BIGINT) AS month, count(*) AS rows FROM {holdings} h WHERE code = 'Brand#7' GROUP BY 1), e AS (SELECT month FROM {index_monthly} i UNION ALL SELECT 209901)
    SELECT month, coalesce(rows, 0) AS rows, CASE WHEN rows IS NULL THEN 'error' WHEN rows IN (30, 31, 32) THEN 'warning' ELSE 'ok' END AS severity FROM e FULL JOIN p USING (month)""")
def a3_partition_audit(t: Tables) -> DataFrame:
    expected = t.index_monthly.select("month").unionByName(t.spark.range(209901, 209902).withColumnRenamed("id", "month"))
    return audit.partition_audit(t.holdings.where("code = 'Brand#7'"), "month", expected, [30, 31, 32])


@query("SELECT 'segment ' || c_mktsegment AS what, count(*) AS n FROM customer GROUP BY 1 UNION ALL SELECT 'no nation', count(*) FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation) UNION ALL SELECT 'repeated names', count(*) - count(DISTINCT c_name) FROM customer")
def a4_dimension_audits(t: Tables) -> DataFrame:
    c = t.customer
    lost = c.join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey"), "left_anti").agg(F.lit("no nation").alias("what"), F.count("*").alias("n"))
    twice = c.agg(F.lit("repeated names").alias("what"), (F.count("*") - F.count_distinct("c_name")).alias("n"))
    return c.groupBy(F.concat(F.lit("segment "), "c_mktsegment").alias("what")).agg(F.count("*").alias("n")).unionByName(lost).unionByName(twice)


@query("SELECT trade_date, CAST(sum(n) AS BIGINT) AS rows, count(DISTINCT ts_code) AS codes, bool_or(trade_time = '09:30') AS has_open, bool_or(trade_time = '15:00') AS has_close, CAST(sum(n - 1) AS BIGINT) AS repeated, bool_or(trade_time = '09:30') AND bool_or(trade_time = '15:00') AND sum(n) >= 20 AS ok FROM (SELECT trade_date, ts_code, trade_time, count(*) AS n FROM {ticks} t GROUP BY 1, 2, 3) x GROUP BY trade_date")
def a5_minute_day_quality(t: Tables) -> DataFrame:
    return audit.minute_quality(t.ticks, "trade_date", "ts_code", 20)


@query("SELECT trade_date, concat_ws(',', CASE WHEN trade_date >= '19980101' AND NOT bool_or(ts_code LIKE '%.BJ') THEN 'BJ' END, CASE WHEN NOT bool_or(ts_code LIKE '%.SH') THEN 'SH' END, CASE WHEN NOT bool_or(ts_code LIKE '%.SZ') THEN 'SZ' END) AS missing FROM {ticks} t GROUP BY 1 HAVING missing <> ''")
def a6_exchange_completeness(t: Tables) -> DataFrame:
    e = t.ticks.select("trade_date", F.split_part("ts_code", F.lit("."), F.lit(2)).alias("ex"))
    return audit.exchange_completeness(e, "trade_date", "ex", ["SH", "SZ"], "BJ", "19980101")


@query("SELECT code, count(r) AS rows, round(quantile_cont(r, 0.1), 8) AS p10, round(quantile_cont(r, 0.5), 8) AS median, round(quantile_cont(r, 0.9), 8) AS p90 FROM (SELECT code, high / low AS r FROM {bars} b) x GROUP BY code")
def a7_ratio_stats(t: Tables) -> DataFrame:
    out = audit.ratio_stats(t.bars.select("code", (F.col("high") / F.col("low")).alias("r")), "code", "r")
    return out.select("code", "rows", *(F.round(c, 8).alias(c) for c in ("p10", "median", "p90")))


_DIFF = "d AS (SELECT coalesce(o.part, n.part) AS part, CASE WHEN o.part IS NULL THEN 'added' WHEN n.part IS NULL THEN 'removed' WHEN o.price IS DISTINCT FROM n.price OR o.prio IS DISTINCT FROM n.prio THEN 'changed' ELSE 'same' END AS change FROM {old_part} o FULL JOIN {new_part} n USING (id))"


@query(f"WITH {_DIFF} SELECT part, count(*) FILTER (change = 'same') AS same, count(*) FILTER (change = 'changed') AS changed, count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'removed') AS removed, round(count(*) FILTER (change = 'changed') / count(*) FILTER (change IN ('changed', 'same')), 8) AS revision_rate FROM d GROUP BY part")
def a8_revision_summary(t: Tables) -> DataFrame:
    diff = joins.keyed_diff(t.old_part, t.new_part, ["id"], ["price", "prio", "part"]).withColumn("part", F.coalesce("_a.part", "_b.part"))
    out = audit.revision_summary(diff, "part")
    return out.withColumn("revision_rate", F.round("revision_rate", 8))


_LONG = "SELECT id, unnest(['price', 'tenth']) AS c, unnest([price, price / 10]) AS v FROM"


@query(f"""WITH d AS (SELECT c, n.v - o.v AS d FROM ({_LONG} {{old_part}} p) o JOIN ({_LONG} {{new_part}} q) n USING (id, c) WHERE n.v <> o.v),
    r AS (SELECT c, d, abs(d) AS a, row_number() OVER (PARTITION BY c ORDER BY abs(d)) - 1 AS r, count(*) OVER (PARTITION BY c) AS n FROM d)
    SELECT c AS column, count(*) AS changed, round(avg(d), 6) AS mean, round(avg(a), 6) AS mean_abs, round(max(a), 6) AS largest, round(max(CASE WHEN r = round_even((n - 1) * 0.5, 0) THEN a END), 6) AS p50, round(max(CASE WHEN r = round_even((n - 1) * 0.95, 0) THEN a END), 6) AS p95 FROM r GROUP BY c""")
def a9_numeric_deltas(t: Tables) -> DataFrame:
    sides = [df.select("id", "price", (F.col("price") / 10).alias("tenth")) for df in (t.old_part, t.new_part)]
    out = audit.numeric_deltas(*sides, ["id"], ["price", "tenth"])
    return out.select("column", "changed", *(F.round(c, 6).alias(c) for c in ("mean", "mean_abs", "largest", "p50", "p95")))


@query("""WITH d AS (SELECT CASE WHEN n.price IS NULL THEN 'to_blank' ELSE 'from_blank' END AS kind, abs(coalesce(o.price, n.price)) AS a FROM {old_part} o JOIN {new_part} n USING (id) WHERE (n.price IS NULL) <> (o.price IS NULL)),
    r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY a) - 1 AS r, count(*) OVER (PARTITION BY kind) AS k FROM d)
    SELECT 'price' AS column, kind, count(*) AS n, round(avg(a), 6) AS mean, max(a) AS largest, max(CASE WHEN r = round_even((k - 1) * 0.5, 0) THEN a END) AS p50, max(CASE WHEN r = round_even((k - 1) * 0.95, 0) THEN a END) AS p95 FROM r GROUP BY kind""")
def a10_value_transitions(t: Tables) -> DataFrame:
    out = audit.value_transitions(t.old_part.select("id", "price"), t.new_part.select("id", "price"), ["id"], ["price"])
    return out.withColumn("mean", F.round("mean", 6))


@query("SELECT source, count(*) AS rows, count(DISTINCT part) AS files, count(*) FILTER (id % 10 = 0) AS capped FROM (SELECT 'old' AS source, id, part FROM {old_part} o UNION ALL SELECT 'new', id, part FROM {new_part} n) x GROUP BY source")
def a11_union_audit(t: Tables) -> DataFrame:
    u = lake.union_by_name(t.old_part.withColumn("source", F.lit("old")), t.new_part.withColumn("source", F.lit("new")))
    return u.groupBy("source").agg(F.count("*").alias("rows"), F.count_distinct("part").alias("files"), F.count_if(F.col("id") % 10 == 0).alias("capped"))


_FIND = "f AS (SELECT event_id AS id, event_type || CASE WHEN event_id % 3 = 0 THEN '_daily' ELSE '' END || '_check' AS chk, CASE WHEN value > 90 THEN 'error' WHEN value > 60 THEN 'warning' ELSE 'info' END AS severity FROM events), ds AS (SELECT unnest(['click', 'click_daily', 'view', 'purchase', 'signup', 'error']) AS dataset)"


@query(f"WITH {_FIND}, m AS (SELECT id, severity, arg_max(dataset, length(dataset)) AS dataset FROM f JOIN ds ON starts_with(chk, dataset) GROUP BY 1, 2), r AS (SELECT coalesce(dataset, 'ALL') AS dataset, count(*) FILTER (severity = 'error') AS error, count(*) FILTER (severity = 'warning') AS warning, count(*) FILTER (severity = 'info') AS info FROM m GROUP BY ROLLUP (dataset)) SELECT *, CASE WHEN error > 0 THEN 'error' WHEN warning > 0 THEN 'warning' ELSE 'ok' END AS status FROM r")
def a12_finding_rollup(t: Tables) -> DataFrame:
    check = F.concat("event_type", F.when(F.col("event_id") % 3 == 0, "_daily").otherwise(""), F.lit("_check"))
    severity = F.when(F.col("value") > 90, "error").when(F.col("value") > 60, "warning").otherwise("info")
    found = t.events.select(F.col("event_id").alias("id"), check.alias("check"), severity.alias("severity"))
    names = t.spark.createDataFrame([(x,) for x in ("click", "click_daily", "view", "purchase", "signup", "error")], "dataset string")
    return audit.rollup_findings(found, names)


@query("""WITH e AS (SELECT *, count(*) OVER (PARTITION BY dataset, code, available_at) AS same FROM (SELECT dataset, code, ts, CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 13 = 0 THEN ts - INTERVAL '1' DAY ELSE date_trunc('day', available_at) + INTERVAL '1' DAY END AS available_at FROM {pit} p) x)
    SELECT dataset, count(*) FILTER (available_at IS NULL) AS no_stamp, count(*) FILTER (available_at NOT BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-25') AS outside, count(*) FILTER (available_at < ts) AS backdated, count(*) FILTER (same > 1) AS repeated FROM e GROUP BY dataset""")
def a13_event_layer_audit(t: Tables) -> DataFrame:
    day = F.date_trunc("day", F.col("available_at")).cast("timestamp_ntz") + F.expr("INTERVAL 1 DAY")
    stamp = F.when(F.col("event_id") % 11 == 0, None).when(F.col("event_id") % 13 == 0, F.col("ts") - F.expr("INTERVAL 1 DAY")).otherwise(day)
    e = t.pit.withColumn("available_at", stamp)
    at = lambda x: F.lit(x).cast("timestamp_ntz")
    return audit.event_violations(e, ["code"], at("2024-01-05"), at("2024-01-25"))


@query("SELECT code, period, count(*) AS rows, count(DISTINCT ann_date) AS stamps, count(DISTINCT kind) AS kinds FROM {statements} s GROUP BY 1, 2 HAVING count(*) > 1 AND (count(DISTINCT ann_date) > 1 OR count(DISTINCT kind) > 1)")
def a14_multi_version_finder(t: Tables) -> DataFrame:
    return audit.multi_version(t.statements, ["code", "period"], "ann_date", "kind")


@query("SELECT code, period, count(*) AS rows, concat_ws(',', CASE WHEN count(DISTINCT ann_date) > 1 THEN 'ann_date' END, CASE WHEN count(DISTINCT kind) > 1 THEN 'kind' END, CASE WHEN count(DISTINCT dataset) > 1 THEN 'dataset' END) AS varies FROM {statements} s GROUP BY 1, 2 HAVING count(*) > 1")
def a15_duplicate_key_finder(t: Tables) -> DataFrame:
    return audit.varying_columns(t.statements, ["code", "period"], ["ann_date", "kind", "dataset"])


@query("SELECT dataset, count(*) AS rows, min(ann_date) AS first, max(ann_date) AS last, count(*) FILTER (code IS NULL) AS null_codes FROM {statements} s GROUP BY dataset")
def a16_dataset_profile(t: Tables) -> DataFrame:
    return t.statements.groupBy("dataset").agg(F.count("*").alias("rows"), F.min("ann_date").alias("first"), F.max("ann_date").alias("last"), F.count_if(F.col("code").isNull()).alias("null_codes"))


@query("SELECT month, code, round(h.q / b.vol, 8) AS vol_ratio, round(h.v / b.amount, 8) AS amount_ratio FROM {bars} b JOIN (SELECT month, code, sum(quantity) AS q, round(sum(market_value), 2) AS v FROM {holdings} h GROUP BY 1, 2) h USING (month, code)")
def a34_unit_crosscheck(t: Tables) -> DataFrame:
    h = t.holdings.groupBy("month", "code").agg(F.sum("quantity").alias("q"), F.round(F.sum("market_value"), 2).alias("v"))
    return t.bars.join(h, ["month", "code"]).select("month", "code", F.round(F.try_divide("q", "vol"), 8).alias("vol_ratio"), F.round(F.try_divide("v", "amount"), 8).alias("amount_ratio"))


@query("SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN CAST(o_orderkey AS VARCHAR) WHEN 2 THEN CAST(o_orderkey AS VARCHAR) || '.5' WHEN 3 THEN 'nan text' ELSE CAST(o_custkey AS VARCHAR) END AS canonical FROM orders")
def canonical_value(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    raw = F.when(k % 5 == 0, " NaN ").when(k % 5 == 1, F.concat(k.cast("string"), F.lit(".000"))).when(k % 5 == 2, F.concat(k.cast("string"), F.lit(".500"))).when(k % 5 == 3, "nan text").otherwise(F.concat(F.lit(" "), F.col("o_custkey").cast("string")))
    return t.orders.select("o_orderkey", raw.alias("r")).select("o_orderkey", audit.canonical("r").alias("canonical"))


@query("SELECT DISTINCT ts_code FROM {ticks} t WHERE regexp_full_match(ts_code, '[0-9]+[.](SH|SZ|BJ)')")
def valid_code(t: Tables) -> DataFrame:
    return t.ticks.where(F.col("ts_code").rlike(audit.STOCK)).select("ts_code").distinct()


@query("SELECT count(*) AS before, (SELECT count(*) FROM (SELECT DISTINCT trade_date, ts_code, trade_time FROM {ticks} t) y) AS after FROM {ticks} t")
def exact_dedup(t: Tables) -> DataFrame:
    rows = t.ticks.select("trade_date", "ts_code", "trade_time").groupBy("trade_date", "ts_code", "trade_time").agg(F.count("*").alias("n"))
    return rows.agg(F.sum("n").alias("before"), F.count("*").alias("after"))


@query("SELECT code, name FROM {universe} u WHERE 1200 - list_day >= 60 AND c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_acctbal BETWEEN 0 AND 5000 AND name NOT LIKE '%ST%' AND upper(name) NOT LIKE '%ST%' OR false")
def universe_screen(t: Tables) -> DataFrame:
    return audit.screen(t.universe, "name", F.lit(1200) - F.col("list_day"), 60, ["BUILDING", "MACHINERY"], "c_mktsegment", "c_acctbal", (0.0, 5000.0)).select("code", "name")


@query("SELECT trade_date, ts_code, vol FROM {ticks} t WHERE ts_code LIKE '00%' OR ts_code LIKE '%.BJ'")
def apply_screen(t: Tables) -> DataFrame:
    allowed = t.ticks.where("ts_code like '00%' or ts_code like '%.BJ'").select("ts_code")
    return audit.apply_screen(t.ticks, "ts_code", allowed).select("trade_date", "ts_code", "vol")


@query("""WITH c AS (SELECT dataset, 'amount' AS column, count(amount) AS filled, 'currency' AS unit FROM {statements} s GROUP BY 1 UNION ALL SELECT dataset, 'ann_date', count(ann_date), 'date' FROM {statements} s GROUP BY 1 UNION ALL SELECT dataset, 'code', count(code), 'unclassified' FROM {statements} s GROUP BY 1) SELECT * FROM c""")
def unit_coverage(t: Tables) -> DataFrame:
    rules = t.spark.createDataFrame([("^amount$", 1, "currency"), ("_date$", 2, "date"), ("^a", 3, "other")], "pattern string, tier int, unit string")
    return audit.unit_coverage(t.statements.select("dataset", "amount", "ann_date", "code"), "dataset", rules)


@query("SELECT trade_date, ts_code, strftime(strptime(trade_date, '%Y%m%d') + INTERVAL 1 DAY, '%Y-%m-%d 08:30:00') AS available_at FROM {ticks} t WHERE trade_time = '15:00'")
def contract_available_at(t: Tables) -> DataFrame:
    day = F.date_add(F.to_date("trade_date", "yyyyMMdd"), 1)
    return t.ticks.where("trade_time = '15:00'").select("trade_date", "ts_code", F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit(" 08:30:00")).alias("available_at"))


@query("SELECT trade_date, ts_code, trade_time, substr(trade_date, 1, 4) || '-' || substr(trade_date, 5, 2) || '-' || substr(trade_date, 7, 2) || ' ' || trade_time || ':00' AS available_at, 'bar_close' AS rule FROM {ticks} t")
def minute_available_at(t: Tables) -> DataFrame:
    at = F.concat(F.date_format(F.to_date("trade_date", "yyyyMMdd"), "yyyy-MM-dd"), F.lit(" "), "trade_time", F.lit(":00"))
    return t.ticks.select("trade_date", "ts_code", "trade_time", at.alias("available_at"), F.lit("bar_close").alias("rule"))


@query("SELECT trade_date, ts_code, CASE WHEN l_orderkey % 3 = 0 THEN greatest('09:26:10', '09:25:00') WHEN trade_date < '19980101' THEN '09:29:00' ELSE greatest(CASE WHEN l_orderkey % 2 = 0 THEN '09:20:00' ELSE '09:40:00' END, '09:25:00') END AS available_at FROM {ticks} t WHERE trade_time = '09:30'")
def auction_available_at(t: Tables) -> DataFrame:
    k = F.col("l_orderkey")
    observed, fetched = F.when(k % 3 == 0, "09:26:10"), F.when(k % 2 == 0, "09:20:00").otherwise("09:40:00")
    stamp = F.when(observed.isNotNull(), F.greatest(observed, F.lit("09:25:00"))).when(F.col("trade_date") < "19980101", "09:29:00").otherwise(F.greatest(fetched, F.lit("09:25:00")))
    return t.ticks.where("trade_time = '09:30'").select("trade_date", "ts_code", stamp.alias("available_at"))


@query("SELECT part, min(id) <= 500 AND max(id) >= 12000 AS covered FROM {old_part} o GROUP BY part")
def coverage_check(t: Tables) -> DataFrame:
    return t.old_part.groupBy("part").agg(F.min("id").alias("a"), F.max("id").alias("b")).select("part", ((F.col("a") <= 500) & (F.col("b") >= 12000)).alias("covered"))


@query("SELECT dataset, strftime(TIMESTAMP '2024-03-31 10:00:00' - to_months(CASE dataset WHEN 'click' THEN 1 WHEN 'view' THEN 2 ELSE 3 END), '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS n FROM {pit} p GROUP BY 1, 2")
def window_start(t: Tables) -> DataFrame:
    months = F.when(F.col("dataset") == "click", 1).when(F.col("dataset") == "view", 2).otherwise(3)
    start = F.lit("2024-03-31 10:00:00").cast("timestamp_ntz") - F.make_ym_interval(F.lit(0), months)
    return t.pit.groupBy("dataset").agg(F.count("*").alias("n")).select("dataset", F.date_format(start, "yyyy-MM-dd HH:mm:ss").alias("window_start"), "n")


@query(f"WITH {_FIND}, m AS (SELECT split_part(chk, '_', 1) AS domain, max(CASE severity WHEN 'error' THEN 2 WHEN 'warning' THEN 1 ELSE 0 END) AS worst FROM f GROUP BY 1) SELECT domain, CASE WHEN worst = 2 AND domain IN ('click', 'view') THEN 'block' WHEN worst > 0 THEN 'warn' ELSE 'pass' END AS gate FROM m")
def c3_quality_gate(t: Tables) -> DataFrame:
    level = F.when(F.col("value") > 90, 2).when(F.col("value") > 60, 1).otherwise(0)
    worst = t.events.groupBy(F.col("event_type").alias("domain")).agg(F.max(level).alias("worst"))
    return worst.select("domain", F.when((F.col("worst") == 2) & F.col("domain").isin("click", "view"), "block").when(F.col("worst") > 0, "warn").otherwise("pass").alias("gate"))


@query("""SELECT code, period, strftime(strptime(ann_date, '%Y%m%d'), '%Y%m') AS available_month, sha256('{"code":' || code || ',"period":' || period || '}') AS business_key FROM (SELECT *, row_number() OVER (PARTITION BY code, period ORDER BY ann_date DESC, o_orderkey DESC) AS r FROM {statements} s WHERE ann_date BETWEEN '19960101' AND '19981231') x WHERE r = 1""")
def c4_fundamental_event_build(t: Tables) -> DataFrame:
    seen = lake.trade_range(t.statements, "ann_date", "19960101", "19981231", t.statements.columns)
    one = windows.keep_one(seen, ["code", "period"], ["ann_date", "o_orderkey"], "last")
    return one.select("code", "period", F.substring("ann_date", 1, 6).alias("available_month"), F.sha2(F.to_json(F.struct("code", "period")), 256).alias("business_key"))


@query(f"WITH {_DIFF}, s AS (SELECT DISTINCT part FROM {{old_part}} o ORDER BY sha256('11|' || part) LIMIT 12) SELECT part, count(*) FILTER (change <> 'same') AS revised, count(*) AS keys FROM d WHERE part IN (SELECT part FROM s) GROUP BY part")
def c8_revision_sentinel(t: Tables) -> DataFrame:
    sample = t.old_part.select("part").distinct().orderBy(F.sha2(F.concat(F.lit("11|"), F.col("part").cast("string")), 256)).limit(12)
    pick = lambda df: df.join(F.broadcast(sample), "part", "left_semi")
    diff = joins.keyed_diff(pick(t.old_part), pick(t.new_part), ["id"], ["price", "prio", "part"])
    return diff.groupBy(F.coalesce("_a.part", "_b.part").alias("part")).agg(F.count_if(F.col("change") != "same").alias("revised"), F.count("*").alias("keys"))


_LAYERS = ["income_vip", "dividend", "forecast_vip", "express_vip", "fina_audit_vip", "balancesheet_vip"]


@query(f"""WITH a AS (SELECT unnest({_LAYERS}) AS dataset), e AS (SELECT l.*, count(*) OVER (PARTITION BY part_dataset, part_month, dataset, business_key, available_at) AS same, try_cast(substr(available_at, 1, 19) AS TIMESTAMP) AS stamp,
    f.source_path IS NOT NULL AS there, f.source_hash AS side FROM {{event_layer}} l LEFT JOIN {{event_files}} f ON l.source_path = f.source_path WHERE part_month IN ('202312', '202401')),
    c AS (SELECT part_dataset AS dataset, count(DISTINCT part_month) AS months, count(*) AS rows, count(*) FILTER (stamp IS NULL) AS unparseable, count(*) FILTER (stamp NOT BETWEEN TIMESTAMP '2023-12-15' AND TIMESTAMP '2024-01-25 23:59:59') AS outside_window,
    count(*) FILTER (available_month <> part_month) AS wrong_month, count(*) FILTER (e.dataset <> part_dataset) AS wrong_dataset, count(*) FILTER (available_at_rule = 'guess') AS disallowed_rule,
    count(*) FILTER (part_dataset IN ('forecast_vip', 'express_vip') AND stamp < strptime(ann_date, '%Y%m%d')) AS backdated, count(*) FILTER (source_row_id = 'x') AS bad_row_id, count(*) FILTER (trim(source_path) = '') AS blank_path,
    count(*) FILTER (NOT list_contains(string_split(source_path, '/'), part_dataset)) AS wrong_path, count(*) FILTER (NOT there) AS missing_path, count(*) FILTER (source_hash <> '' AND side <> source_hash) AS hash_mismatch,
    count(*) FILTER (same > 1) AS repeated_keys, count(*) FILTER (source_hash = '') AS blank_hash, string_agg(DISTINCT part_month) AS seen FROM e GROUP BY 1)
    SELECT a.dataset, {", ".join(f"coalesce({n}, 0) AS {n}" for n in ("months", "rows", *layers._ERRORS, *layers._WARNINGS))}, 2 - coalesce(months, 0) AS missing_months,
    concat_ws(',', CASE WHEN NOT contains(coalesce(seen, ''), '202312') THEN '202312' END, CASE WHEN NOT contains(coalesce(seen, ''), '202401') THEN '202401' END) AS named_months,
    CASE WHEN {" + ".join(f"coalesce({n}, 0)" for n in layers._ERRORS)} > 0 THEN 'error' WHEN {" + ".join(f"coalesce({n}, 0)" for n in layers._WARNINGS)} > 0 OR coalesce(months, 0) < 2 THEN 'warning' ELSE 'info' END AS severity FROM a LEFT JOIN c ON a.dataset = c.dataset""")
def a13_event_layer_counters(t: Tables) -> DataFrame:
    return layers.event_layer_audit(t.event_layer, t.event_files, _LAYERS, "20231215", "20240125")


@query("""WITH k AS (SELECT *, try_cast(trade_time AS TIMESTAMP) AS clock, substr(trade_time, 12, 5) AS hhmm, row_number() OVER (PARTITION BY part_day, ts_code, trade_time) AS nth FROM {minute_rows} m),
    d AS (SELECT part_day, count(*) AS rows, count(*) FILTER (nth > 1) AS repeated, count(*) FILTER (trade_date <> part_day) AS wrong_dates, count(*) FILTER (available_at = 'later') AS bad_stamps, count(*) FILTER (clock IS NULL) AS bad_times,
    count(*) FILTER (clock IS NULL OR hhmm NOT IN ('09:30', '10:00', '14:57', '15:00')) AS off_session, count(DISTINCT CASE WHEN clock IS NOT NULL THEN hhmm END) AS times, bool_or(clock IS NOT NULL AND hhmm = '09:30') AS has_open, bool_or(clock IS NOT NULL AND hhmm = '15:00') AS has_close FROM k GROUP BY 1),
    h AS (SELECT DISTINCT part_day, ts_code, 1 AS here FROM k), j AS (SELECT part_day, ts_code, here, want FROM h FULL JOIN (SELECT part_day, ts_code, 1 AS want FROM {minute_codes} c) w USING (part_day, ts_code)),
    c AS (SELECT part_day, count(here) AS codes, count(want) AS expected, count(*) FILTER (here IS NULL) AS missing, count(*) FILTER (want IS NULL) AS extra,
    coalesce(array_to_string(list_slice(list_sort(list(ts_code) FILTER (here IS NULL)), 1, 20), ','), '') AS named_missing, coalesce(array_to_string(list_slice(list_sort(list(ts_code) FILTER (want IS NULL)), 1, 20), ','), '') AS named_extra FROM j GROUP BY 1),
    o AS (SELECT part_day, coalesce(rows, 0) AS rows, coalesce(repeated, 0) AS repeated, coalesce(wrong_dates, 0) AS wrong_dates, coalesce(bad_stamps, 0) AS bad_stamps, coalesce(bad_times, 0) AS bad_times, coalesce(off_session, 0) AS off_session, coalesce(times, 0) AS times,
    codes, expected, missing, extra, coalesce(has_open, false) AS has_open, coalesce(has_close, false) AS has_close, named_missing, named_extra FROM c LEFT JOIN d USING (part_day))
    SELECT *, repeated + wrong_dates + bad_stamps + bad_times = 0 AND rows >= 2 AND missing <= 1 AND (rows = 0 OR has_open AND has_close) AS ok FROM o""")
def a5_minute_day_audit(t: Tables) -> DataFrame:
    return layers.minute_day_audit(t.minute_rows, t.minute_codes, "part_day", "ts_code", 2, 1)

"""Queries of scans, sinks, windows, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import windows
from ..sources import lake, publish
from ..sources.scratch import new_path
from .adapters import MONTH, by_month
from .registry import Tables, query

_T = "TIMESTAMP '2024-01-20 00:00:00'"
_S = "TIMESTAMP '2024-01-08 00:00:00'"


def _ts(text: str):
    return F.lit(text).cast("timestamp_ntz")


NOW, START = "2024-01-20 00:00:00", "2024-01-08 00:00:00"


@query(f"""WITH v AS (SELECT *, row_number() OVER (PARTITION BY dataset, code ORDER BY available_at DESC, event_id DESC) AS r FROM {{pit}} p WHERE available_at BETWEEN {_S} AND {_T})
    SELECT dataset, code, event_id, value, strftime(available_at, '%Y-%m-%d %H:%M:%S') AS available_at, c_name AS name, n_name AS nation FROM v LEFT JOIN customer ON code = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey WHERE r = 1""")
def pit_snapshot(t: Tables) -> DataFrame:
    seen = lake.available_window(t.pit, "available_at", _ts(START), _ts(NOW))
    latest = windows.keep_one(seen, ["dataset", "code"], ["available_at", "event_id"], "last")
    named = latest.join(t.customer, F.col("code") == F.col("c_custkey"), "left").join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return named.select("dataset", "code", "event_id", "value", F.date_format("available_at", "yyyy-MM-dd HH:mm:ss").alias("available_at"), F.col("c_name").alias("name"), F.col("n_name").alias("nation")).orderBy("dataset", "code")


@query("SELECT DISTINCT trade_date FROM {ticks} t")
def scan_partition_dates(t: Tables) -> DataFrame:
    return lake.partition_dates(t.ticks, "trade_date")


@query("SELECT ts_code, price FROM {ticks} t WHERE trade_date = '19980302'")
def scan_trade_date(t: Tables) -> DataFrame:
    return lake.trade_date(by_month(t.spark, t.sf_dir), "trade_date", "19980302", ["ts_code", "price"], MONTH)


@query("SELECT trade_date, ts_code, vol FROM {ticks} t WHERE trade_date BETWEEN '19970101' AND '19970331'")
def scan_trade_range(t: Tables) -> DataFrame:
    return lake.trade_range(by_month(t.spark, t.sf_dir), "trade_date", "19970101", "19970331", ["trade_date", "ts_code", "vol"], MONTH)


@query(f"SELECT count(*) AS source_rows, count(*) FILTER (available_at BETWEEN {_S} AND {_T}) AS visible_rows, CAST(0 AS BIGINT) AS unparseable_rows FROM {{pit}} p")
def scan_available_window(t: Tables) -> DataFrame:
    return lake.window_counts(t.pit, "available_at", _ts(START), _ts(NOW))


@query(f"SELECT event_id, dataset FROM {{pit}} p WHERE dataset IN ('click', 'error') AND available_at BETWEEN greatest({_S}, {_T} - INTERVAL 5 DAY) AND {_T}")
def scan_news_sources(t: Tables) -> DataFrame:
    return lake.news_sources(t.pit, "dataset", "available_at", ["click", "error"], _ts(START), _ts(NOW) - F.expr("INTERVAL 5 DAYS"), _ts(NOW)).select("event_id", "dataset")


@query("SELECT o_orderkey, dataset, period FROM {statements} s WHERE period BETWEEN 199603 AND 199707 AND ann_date <= '19970615'")
def scan_fundamental_events(t: Tables) -> DataFrame:
    return lake.available_window(t.statements, "ann_date", F.lit("19960301"), F.lit("19970615"), F.col("period").between(199603, 199707)).select("o_orderkey", "dataset", "period")


@query(f"SELECT event_id FROM {{pit}} p WHERE available_at <= {_T}")
def scan_replay_domain(t: Tables) -> DataFrame:
    return t.pit.where(F.col("available_at") <= _ts(NOW)).select("event_id")


@query("SELECT ts_code, trade_time, price, vol FROM {ticks} t WHERE trade_date = '19990810'")
def scan_minute_day(t: Tables) -> DataFrame:
    return lake.trade_range(by_month(t.spark, t.sf_dir), "trade_date", "19990810", "19990810", ["ts_code", "trade_time", "price", "vol"], MONTH)


@query("SELECT count(*) AS rows, min(ann_date) AS min_ann_date, max(ann_date) AS max_ann_date, min(period) AS min_period, max(period) AS max_period, count(*) FILTER (code IS NULL) AS null_code FROM {statements} s")
def scan_footer_profile(t: Tables) -> DataFrame:
    """Statements as a table, then its counts and extremes from the footers."""
    path = new_path(t.spark, "statements")
    t.statements.withColumn("ann_date", F.to_date("ann_date", "yyyyMMdd")).write.parquet(path)
    found = lake.metadata_profile(t.spark, path, ["ann_date", "period"], ["code"])
    return found.withColumns({c: F.date_format(c, "yyyyMMdd") for c in ("min_ann_date", "max_ann_date")})


@query("SELECT c_custkey AS key, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_name, s_acctbal, NULL FROM supplier")
def union_by_name(t: Tables) -> DataFrame:
    c = t.customer.select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    return lake.union_by_name(c, t.supplier.select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")))


@query("SELECT r_regionkey AS key, r_name AS name, CAST(NULL AS DOUBLE) AS p_retailprice FROM region")
def schema_only_pad(t: Tables) -> DataFrame:
    return lake.schema_pad(t.region.select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name")), t.part.select("p_retailprice").schema)


@query("SELECT id, price, part FROM {old_part} o WHERE part NOT BETWEEN 10 AND 19 UNION ALL SELECT id, price, part FROM {new_part} n WHERE part BETWEEN 10 AND 19")
def write_window_merge(t: Tables) -> DataFrame:
    cols = ["id", "price", "part"]
    return lake.window_merge(t.old_part.select(cols), t.new_part.select(cols).where("part between 10 and 19"), "part", 10, 19, ["id"])


@query("SELECT id, price, part FROM {old_part} o WHERE part NOT IN (3, 4) UNION ALL SELECT id, price, part FROM {new_part} n WHERE part IN (3, 4)")
def write_partition_replace(t: Tables) -> DataFrame:
    """Written for real: dynamic overwrite of the partitions that the new rows have."""
    path = new_path(t.spark, "parts")
    cols = ["id", "price", "part"]
    t.old_part.select(cols).repartition("part").write.mode("overwrite").partitionBy("part").parquet(path)
    lake.write_parts(t.new_part.select(cols).where("part in (3, 4)"), path, ["part"])
    return t.spark.read.parquet(path).select("id", "price", F.col("part").cast("long").alias("part"))


@query("""SELECT cal_date, coalesce(n.is_open, o.is_open) AS is_open FROM (SELECT cal_date, CASE WHEN CAST(cal_date AS BIGINT) % 2 = 0 THEN '1' ELSE '0' END AS is_open FROM {calendar} c WHERE cal_date < '19980101') o
    FULL JOIN (SELECT cal_date, '1' AS is_open FROM {calendar} c WHERE cal_date >= '19970101') n USING (cal_date)""")
def calendar_upsert(t: Tables) -> DataFrame:
    old = t.calendar.where("cal_date < '19980101'").withColumn("is_open", F.when(F.col("cal_date").cast("long") % 2 == 0, "1").otherwise("0"))
    new = t.calendar.where("cal_date >= '19970101'").withColumn("is_open", F.lit("1"))
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return windows.keep_one(both, ["cal_date"], ["_new"], "last").drop("_new").orderBy(F.col("cal_date").desc())


@query("SELECT trade_date, ts_code, max(vol) AS vol, count(DISTINCT trade_time) AS n FROM {ticks} t GROUP BY 1, 2")
def compact_by_date(t: Tables) -> DataFrame:
    """Written for real, a folder a month, after every month was found to have its days; and read again."""
    path = new_path(t.spark, "compact")
    ticks = t.ticks.select("trade_date", "ts_code", "trade_time", "vol").withColumn(MONTH, F.substring("trade_date", 1, 6))
    lake.compact_by_date(ticks, path, MONTH, ["trade_date", "ts_code", "trade_time"], expected=ticks.select(MONTH, "trade_date"))
    return t.spark.read.parquet(path).groupBy("trade_date", "ts_code").agg(F.max("vol").alias("vol"), F.count("*").alias("n"))


@query("""SELECT part, (SELECT count(*) FROM {new_part} n WHERE n.part = p.part) AS rows, CASE WHEN EXISTS (SELECT 1 FROM {old_part} o WHERE o.part = p.part) THEN CASE WHEN
    (SELECT string_agg(concat_ws('|', id, cust, coalesce(CAST(price AS VARCHAR), 'null'), prio), ';' ORDER BY id) FROM {old_part} o WHERE o.part = p.part) = (SELECT string_agg(concat_ws('|', id, cust, coalesce(CAST(price AS VARCHAR), 'null'), prio), ';' ORDER BY id) FROM {new_part} n WHERE n.part = p.part)
    THEN 'first' ELSE 'fetched' END ELSE 'fetched' END AS available_at FROM (SELECT DISTINCT part FROM {new_part} n) p""")
def write_with_manifest(t: Tables) -> DataFrame:
    """Two generations, published for real; parts that did not change keep the stamp of the first."""
    root = new_path(t.spark, "published")
    publish.publish(t.spark, root, {"orders": (t.old_part, ["part"])}, "first")
    publish.publish(t.spark, root, {"orders": (t.new_part, ["part"])}, "fetched")
    return publish.manifest(t.spark, root).select(F.substring_index("part", "=", -1).cast("long").alias("part"), "rows", "available_at")


_CAME = "(SELECT * FROM {new_part} m WHERE part NOT IN (7, 8) AND NOT (part % 10 = 3 AND id % 4 = 0))"


@query(f"""WITH k AS (SELECT coalesce(o.part, n.part) AS part, count(o.id) AS old_keys, count(n.id) AS new_rows, count(*) FILTER (n.id IS NULL) AS removed FROM {{old_part}} o FULL JOIN {_CAME} n ON o.id = n.id AND o.part = n.part GROUP BY 1),
    d AS (SELECT *, CASE WHEN new_rows = 0 AND old_keys > 0 THEN 'skip_empty' WHEN removed > 5 AND removed > 0.2 * old_keys THEN 'block' ELSE 'overwrite' END AS action FROM k)
    SELECT part, old_keys, new_rows, removed, action, CASE WHEN action = 'overwrite' THEN new_rows ELSE old_keys END AS rows FROM d""")
def guarded_overwrite(t: Tables) -> DataFrame:
    """Parts of a published table replaced where the guards allow it: some come empty, some lose a quarter of their keys. ``rows`` is what lies there afterwards."""
    root = new_path(t.spark, "published")
    publish.publish(t.spark, root, {"orders": (t.old_part, ["part"])}, "first")
    came = t.new_part.where("part not in (7, 8) and not (part % 10 = 3 and id % 4 = 0)")
    decided = publish.replace_guarded(t.spark, root, "orders", came, "part", ["id"], "fetched", most=5)
    return decided.join(publish.read(t.spark, root, "orders").groupBy("part").agg(F.count("*").alias("rows")), "part", "left")


@query("SELECT id, price FROM {old_part} o UNION ALL SELECT id, price FROM {new_part} n WHERE id NOT IN (SELECT id FROM {old_part} o)")
def append_once(t: Tables) -> DataFrame:
    """A ledger appended to for real; the second records come twice and are added once."""
    path, record = new_path(t.spark, "ledger"), ["id", "price"]
    for records in (t.old_part, t.new_part, t.new_part):
        lake.append_records(t.spark, path, records.select(record), ["id"])
    return t.spark.read.schema(t.old_part.select(record).schema).json(path)


@query("SELECT id, part, price FROM (SELECT id, part, price, row_number() OVER (PARTITION BY id ORDER BY copy DESC) AS r FROM (SELECT *, 0 AS copy FROM {old_part} o UNION ALL SELECT *, 1 FROM {new_part} n) x WHERE part BETWEEN 5 AND 30) y WHERE r = 1")
def canonical_range(t: Tables) -> DataFrame:
    copies = t.old_part.withColumn("copy", F.lit(0)).unionByName(t.new_part.withColumn("copy", F.lit(1)))
    return lake.canonical_range(copies, "part", 5, 30, ["id"], "copy").select("id", "part", "price")


@query("SELECT o_orderkey AS id, o_orderpriority AS record_type, CAST(o_custkey AS BIGINT) AS value FROM orders WHERE o_orderpriority = '1-URGENT'")
def read_ledger(t: Tables) -> DataFrame:
    """JSON lines written and read again, each with its schema version."""
    path = new_path(t.spark, "ledger")
    t.orders.select(F.lit(2).alias("schema_version"), F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("record_type"), F.col("o_custkey").alias("value")).write.json(path)
    schema = T.StructType([T.StructField("schema_version", T.IntegerType()), T.StructField("id", T.LongType()), T.StructField("record_type", T.StringType()), T.StructField("value", T.LongType())])
    return lake.read_ledger(t.spark, path, schema, 2, "1-URGENT").select("id", "record_type", "value")


@query("SELECT CAST(p_partkey AS BIGINT) AS p_partkey, p_name, p_brand FROM part")
def csv_export(t: Tables) -> DataFrame:
    path = new_path(t.spark, "export")
    lake.export_csv(t.part.select("p_partkey", "p_name", "p_brand"), path)
    return t.spark.read.schema("p_partkey long, p_name string, p_brand string").option("header", True).csv(path)


@query("""WITH a AS (SELECT id, cust, price, id % 3 = 0 AS capped FROM {new_part} n), s AS (SELECT cust FROM a GROUP BY cust HAVING bool_or(NOT capped))
    SELECT id, cust, price FROM a UNION ALL SELECT id, cust, price FROM {old_part} o WHERE cust NOT IN (SELECT cust FROM s) AND id NOT IN (SELECT id FROM a)""")
def union_with_baseline(t: Tables) -> DataFrame:
    active = t.new_part.select("id", "cust", "price", (F.col("id") % 3 == 0).alias("capped"))
    return lake.union_with_baseline(active, t.old_part.select("id", "cust", "price"), ["cust"], ["id"], "capped").select("id", "cust", "price")


@query("SELECT dataset, count(*) AS rows, CAST(sum(CAST('0x' || substr(md5(concat_ws('|', amount, ann_date, code, dataset, kind, o_orderkey, period)), 1, 15) AS HUGEINT)) AS DECIMAL(38,0)) AS digest FROM {statements} s GROUP BY dataset")
def table_fingerprint(t: Tables) -> DataFrame:
    return lake.fingerprint(t.statements, "dataset")


@query("""SELECT dataset, period, n, greatest(50, CAST(floor(p * 0.8) AS BIGINT), p - 30) AS floor FROM (SELECT dataset, period, n, lag(n) OVER (PARTITION BY dataset ORDER BY period) AS p FROM
    (SELECT dataset, period, count(*) AS n FROM {statements} s GROUP BY 1, 2) x) y""")
def a35_row_floor(t: Tables) -> DataFrame:
    counts = t.statements.groupBy("dataset", "period").agg(F.count("*").alias("n"))
    return lake.row_floor(counts, "dataset", "period", "n", 50, 0.8, 30)


@query("SELECT code, period, o_orderkey, amount FROM (SELECT *, row_number() OVER (PARTITION BY code, period ORDER BY ann_date DESC, o_orderkey DESC) AS r FROM {statements} s) x WHERE r = 1")
def w1_keep_latest(t: Tables) -> DataFrame:
    return windows.keep_one(t.statements, ["code", "period"], ["ann_date", "o_orderkey"], "last").select("code", "period", "o_orderkey", "amount")


@query("SELECT text_id, dataset FROM (SELECT *, row_number() OVER (PARTITION BY body ORDER BY available_at, dataset, text_id) AS r FROM {texts} t) x WHERE r = 1")
def w2_cross_dup_news(t: Tables) -> DataFrame:
    return windows.drop_copies(t.texts, "body", ["available_at", "dataset", "text_id"]).select("text_id", "dataset")


@query("""SELECT account, month, round(value / coalesce(lag(value) OVER w, 100000) - 1, 6) AS ret, round(value / greatest(100000, max(value) OVER (PARTITION BY account ORDER BY month ROWS UNBOUNDED PRECEDING)) - 1, 6) AS drawdown
    FROM {monthly} m WINDOW w AS (PARTITION BY account ORDER BY month)""")
def w3_daily_returns(t: Tables) -> DataFrame:
    return windows.returns(t.monthly, "account", "month", "value", F.lit(100000.0)).select("account", "month", F.round("ret", 6).alias("ret"), F.round("drawdown", 6).alias("drawdown"))


@query("""SELECT month, code, CASE WHEN pb IS NULL THEN 0.5 ELSE (rank() OVER (PARTITION BY month ORDER BY pb NULLS LAST) + (count(*) OVER (PARTITION BY month, pb) - 1) / 2.0) / count(pb) OVER (PARTITION BY month) END AS pct FROM {cross_section} c""")
def w4_pct_rank_avg(t: Tables) -> DataFrame:
    return windows.pct_rank_avg(t.cross_section, "month", "pb", "pct").select("month", "code", "pct")


@query("""WITH d AS (SELECT l_suppkey AS account, l_shipdate AS day, round(sum(l_extendedprice), 2) AS value FROM lineitem GROUP BY 1, 2), w AS (SELECT account, CAST(date_trunc('week', day) + INTERVAL 6 DAY AS DATE) AS we, arg_max(value, day) AS value FROM d GROUP BY 1, 2)
    SELECT account, strftime(we, '%Y%m%d') AS week_end, value, round(value / coalesce(lag(value) OVER (PARTITION BY account ORDER BY we), 1000) - 1, 8) AS ret FROM w""")
def w5_weekly_last(t: Tables) -> DataFrame:
    daily = t.lineitem.groupBy(F.col("l_suppkey").alias("account"), F.col("l_shipdate").alias("day")).agg(F.round(F.sum("l_extendedprice"), 2).alias("value"))
    return windows.weekly_last(daily, "account", "day", "value", F.lit(1000.0)).select("account", F.date_format("week_end", "yyyyMMdd").alias("week_end"), "value", F.round("ret", 8).alias("ret"))


@query("SELECT epoch, fold, position, status FROM (SELECT *, row_number() OVER (PARTITION BY epoch, fold ORDER BY position DESC) AS r FROM {ledger} l) x WHERE r = 1")
def w7_latest_record(t: Tables) -> DataFrame:
    return windows.keep_one(t.ledger, ["epoch", "fold"], ["position"], "last").select("epoch", "fold", "position", "status")


@query("""WITH c AS (SELECT account, opened, round(sum(principal), 2) AS base FROM {debts} d GROUP BY 1, 2), g AS (SELECT *, coalesce(datediff('day', lag(opened) OVER (PARTITION BY account ORDER BY opened), opened), 1) AS days FROM c)
    SELECT account, strftime(opened, '%Y%m%d') AS day, CAST(days AS BIGINT) AS days, round(sum(base * 0.08 / 360 * days) OVER (PARTITION BY account ORDER BY opened ROWS UNBOUNDED PRECEDING), 7) AS total FROM g""")
def w8_interest_accrual(t: Tables) -> DataFrame:
    marks = t.debts.groupBy("account", "opened").agg(F.round(F.sum("principal"), 2).alias("base"))
    out = windows.accrue(marks, "account", "opened", F.col("base"), F.lit(0.08))
    return out.select("account", F.date_format("opened", "yyyyMMdd").alias("day"), F.col("days").cast("long").alias("days"), F.round("interest_total", 7).alias("total"))


@query("""WITH d AS (SELECT *, sum(principal + interest) OVER (PARTITION BY account) * 0.6 AS paid, sum(principal + interest) OVER (PARTITION BY account ORDER BY opened, contract ROWS UNBOUNDED PRECEDING) - principal - interest AS earlier FROM {debts} x),
    s AS (SELECT *, greatest(0, least(principal + interest, paid - earlier)) AS settled FROM d) SELECT account, contract, round(settled, 2) AS settled, round(least(interest, settled), 2) AS interest_paid, round(settled - least(interest, settled), 2) AS principal_paid FROM s""")
def w9_fifo_allocation(t: Tables) -> DataFrame:
    due = F.sum(F.col("principal") + F.col("interest")).over(W.partitionBy("account")) * 0.6
    out = windows.allocate(t.debts.withColumn("paid", due), "account", ["opened", "contract"], F.col("paid"))
    return out.select("account", "contract", *(F.round(c, 2).alias(c) for c in ("settled", "interest_paid", "principal_paid")))


@query("SELECT trade_date, ts_code, price FROM (SELECT *, row_number() OVER (PARTITION BY trade_date, ts_code ORDER BY trade_time DESC, l_orderkey DESC, l_linenumber DESC, l_suppkey DESC, price DESC) AS r FROM {ticks} t) x WHERE r = 1")
def w10_minute_order(t: Tables) -> DataFrame:
    return windows.keep_one(t.ticks, ["trade_date", "ts_code"], ["trade_time", "l_orderkey", "l_linenumber", "l_suppkey", "price"], "last").select("trade_date", "ts_code", "price")


@query("SELECT month, account, value FROM (SELECT *, row_number() OVER (PARTITION BY month ORDER BY account % 10, account) AS r FROM {monthly} m) x WHERE r = 1")
def w11_chain_series(t: Tables) -> DataFrame:
    return windows.chain(t.monthly.withColumn("window", F.col("account") % 10), "month", ["window", "account"]).select("month", "account", "value")


@query("""WITH g AS (SELECT dataset, day + to_hours(h) AS mark FROM (SELECT DISTINCT dataset FROM {pit} p) d, (SELECT unnest(generate_series(TIMESTAMP '2024-01-05', TIMESTAMP '2024-01-25', INTERVAL 1 DAY)) AS day) x, (SELECT unnest([9, 21]) AS h) y)
    SELECT event_id, strftime((SELECT min(mark) FROM g WHERE g.dataset = p.dataset AND mark >= p.available_at), '%Y-%m-%d %H:%M:%S') AS shown_at FROM {pit} p WHERE available_at <= TIMESTAMP '2024-01-25 21:00:00'""")
def w12_newly_visible(t: Tables) -> DataFrame:
    days = t.spark.sql("SELECT explode(sequence(TIMESTAMP_NTZ '2024-01-05 00:00:00', TIMESTAMP_NTZ '2024-01-25 00:00:00', INTERVAL 1 DAY)) AS day")
    clocks = days.select(F.explode(F.array(F.col("day") + F.expr("INTERVAL 9 HOURS"), F.col("day") + F.expr("INTERVAL 21 HOURS"))).alias("at"))
    grid = t.pit.select("dataset").distinct().join(F.broadcast(clocks))  # 42 marks a dataset
    return windows.newly_visible(t.pit, grid, "dataset", "available_at", "at").select("event_id", F.date_format("shown_at", "yyyy-MM-dd HH:mm:ss").alias("shown_at"))


@query("""SELECT epoch, fold, position, test_return FROM (SELECT *, row_number() OVER (PARTITION BY epoch, fold ORDER BY CASE WHEN status = 'F' THEN 1 ELSE 0 END DESC, position DESC) AS r FROM {ledger} l WHERE bench_return IS NOT NULL) x WHERE r = 1""")
def w13_selected_window(t: Tables) -> DataFrame:
    steps = t.ledger.where("bench_return is not null").groupBy("epoch", "fold").agg(F.collect_list(F.struct("position", "status", "test_return")).alias("steps"))
    flat = steps.select("epoch", "fold", F.explode("steps").alias("s")).select("epoch", "fold", "s.*", (F.col("s.status") == "F").cast("int").alias("selected"))
    return windows.keep_one(flat, ["epoch", "fold"], ["selected", "position"], "last").select("epoch", "fold", "position", "test_return")


@query("SELECT code, industry FROM (SELECT code, round(sum(market_value * CASE WHEN side = 'short' THEN -1 ELSE 1 END), 2) AS industry FROM {holdings} h GROUP BY code) x ORDER BY abs(industry) DESC, code LIMIT 8")
def t2_top_abs(t: Tables) -> DataFrame:
    signed = F.when(F.col("side") == "short", -F.col("market_value")).otherwise(F.col("market_value"))
    return t.holdings.groupBy("code").agg(F.round(F.sum(signed), 2).alias("industry")).orderBy(F.abs("industry").desc(), "code").limit(8)


@query("SELECT cal_date FROM (SELECT cal_date, row_number() OVER (PARTITION BY substr(cal_date, 1, 4) ORDER BY sha256('7|' || cal_date)) AS r FROM {calendar} c) x WHERE r <= 5")
def t3_stable_hash_sample(t: Tables) -> DataFrame:
    rank = F.row_number().over(W.partitionBy(F.substring("cal_date", 1, 4)).orderBy(F.sha2(F.concat(F.lit("7|"), "cal_date"), 256)))
    return t.calendar.withColumn("r", rank).where("r <= 5").select("cal_date")


@query("SELECT kind, count(*) AS n, list_slice(list_sort(list(o_orderkey)), 1, 5) AS sample FROM {statements} s GROUP BY kind")
def t4_sample_rows(t: Tables) -> DataFrame:
    ranked = t.statements.withColumn("r", F.row_number().over(W.partitionBy("kind").orderBy("o_orderkey")))
    return ranked.groupBy("kind").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.when(F.col("r") <= 5, F.col("o_orderkey")))).alias("sample"))


@query("SELECT count(*) AS n, min(ann_date) AS first FROM {statements} s WHERE ann_date IN (SELECT cal_date FROM {calendar} c WHERE cal_date <= '20000101' ORDER BY cal_date DESC LIMIT 20)")
def t5_recent_n_days(t: Tables) -> DataFrame:
    recent = t.calendar.where("cal_date <= '20000101'").orderBy(F.col("cal_date").desc()).limit(20)
    return t.statements.join(recent, F.col("ann_date") == F.col("cal_date"), "left_semi").agg(F.count("*").alias("n"), F.min("ann_date").alias("first"))


@query("SELECT code, period, o_orderkey FROM {statements} s")
def t6_sorted_outputs(t: Tables) -> DataFrame:
    return t.statements.select("code", "period", "o_orderkey").orderBy("code", "period", "o_orderkey")


@query("SELECT id, prio FROM {old_part} o UNION ALL SELECT id, prio FROM {new_part} n")
def u1_union_all(t: Tables) -> DataFrame:
    return lake.union_by_name(t.old_part.select("id", "prio"), t.new_part.select("prio", "id"))


@query("SELECT cust FROM {old_part} o WHERE price > 400000 UNION SELECT cust FROM {new_part} n WHERE prio = 'CHANGED'")
def u2_union_distinct(t: Tables) -> DataFrame:
    return t.old_part.where("price > 400000").select("cust").union(t.new_part.where("prio = 'CHANGED'").select("cust")).distinct()


@query("SELECT 'old_only' AS side, count(*) AS n FROM (SELECT id FROM {old_part} o EXCEPT SELECT id FROM {new_part} n) UNION ALL SELECT 'both', count(*) FROM (SELECT id FROM {old_part} o INTERSECT SELECT id FROM {new_part} n)")
def u3_except_intersect(t: Tables) -> DataFrame:
    a, b = t.old_part.select("id"), t.new_part.select("id")
    count = lambda df, side: df.agg(F.lit(side).alias("side"), F.count("*").alias("n"))
    return count(a.exceptAll(b), "old_only").unionByName(count(a.intersect(b), "both"))


@query("SELECT part, CAST(0 AS BIGINT) = (SELECT count(*) FROM (SELECT * FROM {old_part} o WHERE o.part = p.part EXCEPT ALL SELECT * FROM {new_part} n WHERE n.part = p.part)) + (SELECT count(*) FROM (SELECT * FROM {new_part} n WHERE n.part = p.part EXCEPT ALL SELECT * FROM {old_part} o WHERE o.part = p.part)) AS equal FROM (SELECT DISTINCT part FROM {old_part} o) p")
def u4_multiset_equal(t: Tables) -> DataFrame:
    gone, come = t.old_part.exceptAll(t.new_part), t.new_part.exceptAll(t.old_part)
    changed = gone.select("part").union(come.select("part")).distinct().withColumn("changed", F.lit(True))
    return t.old_part.select("part").distinct().join(changed, "part", "left").select("part", F.col("changed").isNull().alias("equal"))

"""Reference-shaped tables as deterministic views of the driver's tables.

Each view is SQL that Spark and DuckDB both read, so a query and its oracle start from the same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import new_path

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "conversations")

VIEWS: dict[str, str] = {
    # Events as point-in-time rows: a publication lag by dataset.
    "pit": """SELECT event_id, event_type AS dataset, user_id AS code, value, ts, props, CASE event_type
        WHEN 'click' THEN ts + INTERVAL '2' HOUR WHEN 'view' THEN ts + INTERVAL '6' HOUR WHEN 'purchase' THEN ts + INTERVAL '1' DAY
        WHEN 'signup' THEN ts + INTERVAL '12' HOUR ELSE ts + INTERVAL '3' DAY END AS available_at FROM {events}""",
    "messy_times": """SELECT event_id, event_type AS dataset, CAST(ts AS STRING) AS whole, CASE event_id % 7 WHEN 0 THEN substr(CAST(ts AS STRING), 1, 19)
        WHEN 1 THEN replace(substr(CAST(ts AS STRING), 1, 19), ' ', 'T') WHEN 2 THEN concat(substr(CAST(ts AS STRING), 1, 19), '+08:00')
        WHEN 3 THEN concat(replace(substr(CAST(ts AS STRING), 1, 19), ' ', 'T'), 'Z') WHEN 4 THEN 'not a time' WHEN 5 THEN
        concat(replace(substr(CAST(ts AS STRING), 1, 10), '-', ''), substr(CAST(ts AS STRING), 11, 9)) END AS raw FROM {events}""",
    "messy_dates": """SELECT o_orderkey, o_custkey, o_orderkey % 5 AS kind, CASE o_orderkey % 6 WHEN 0 THEN replace(substr(CAST(o_orderdate AS STRING), 1, 10), '-', '')
        WHEN 1 THEN substr(CAST(o_orderdate AS STRING), 1, 10) WHEN 2 THEN concat(replace(substr(CAST(o_orderdate AS STRING), 1, 10), '-', ''), '.0')
        WHEN 3 THEN 'nan' WHEN 4 THEN ' ' ELSE substr(CAST(o_orderdate AS STRING), 1, 19) END AS first_date,
        CASE WHEN o_orderkey % 4 > 0 THEN replace(substr(CAST(o_orderdate AS STRING), 1, 10), '-', '') END AS second_date FROM {orders}""",
    "fills": """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, p_brand AS code, CAST(year(l_shipdate) * 100 + month(l_shipdate) AS BIGINT) AS month,
        l_shipdate, l_extendedprice / l_quantity AS price, l_quantity AS vol, l_extendedprice AS amount, l_returnflag, l_linestatus, l_discount, l_tax
        FROM {lineitem} JOIN {part} ON l_partkey = p_partkey""",
    "bars": """SELECT month, code, max(CASE WHEN rn = 1 THEN price END) AS open, max(price) AS high, min(price) AS low,
        max(CASE WHEN rd = 1 THEN price END) AS close, sum(vol) AS vol, sum(amount) AS amount, count(*) AS n FROM (SELECT *,
        row_number() OVER (PARTITION BY month, code ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, amount) AS rn,
        row_number() OVER (PARTITION BY month, code ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC, amount DESC) AS rd
        FROM {fills}) x GROUP BY month, code""",
    # Day lines: the day is l_shipdate as YYYYMMDD, the code an exchange-suffixed six-digit part number.
    "ticks": """SELECT replace(substr(CAST(l_shipdate AS STRING), 1, 10), '-', '') AS trade_date,
        concat(CASE l_partkey % 5 WHEN 0 THEN '00' WHEN 1 THEN '30' WHEN 2 THEN '60' WHEN 3 THEN '68' ELSE '83' END, lpad(CAST(l_partkey % 10000 AS STRING), 4, '0'),
        CASE l_partkey % 5 WHEN 0 THEN '.SZ' WHEN 1 THEN '.SZ' WHEN 2 THEN '.SH' WHEN 3 THEN '.SH' ELSE '.BJ' END) AS ts_code,
        CASE l_linenumber % 4 WHEN 0 THEN '09:30' WHEN 1 THEN '10:00' WHEN 2 THEN '14:57' ELSE '15:00' END AS trade_time,
        l_extendedprice / l_quantity AS price, l_quantity AS vol, l_extendedprice AS amount, l_orderkey, l_linenumber, l_suppkey FROM {lineitem}""",
    "universe": """SELECT c_custkey AS code, concat(CASE c_custkey % 10 WHEN 0 THEN '*ST ' WHEN 1 THEN 'st ' ELSE '' END, replace(c_name, 'Customer', 'Firm')) AS name, c_nationkey AS industry, CAST(c_custkey * 7 % 2400 AS INT) AS list_day,
        CASE WHEN c_custkey % 4 = 0 THEN CAST(c_custkey * 7 % 2400 + 300 + c_custkey % 900 AS INT) END AS delist_day, c_acctbal, c_mktsegment FROM {customer}""",
    "calendar": "SELECT DISTINCT replace(substr(CAST(o_orderdate AS STRING), 1, 10), '-', '') AS cal_date FROM {orders}",
    # Statements in several versions: one (customer, month), each order an announcement.
    "statements": """SELECT o_orderkey, o_custkey AS code, CAST(year(o_orderdate) * 100 + month(o_orderdate) AS BIGINT) AS period,
        replace(substr(CAST(o_orderdate AS STRING), 1, 10), '-', '') AS ann_date, o_orderstatus AS kind, o_totalprice AS amount, o_orderpriority AS dataset FROM {orders}""",
    "monthly": """SELECT l_suppkey AS account, CAST(year(l_shipdate) * 100 + month(l_shipdate) AS BIGINT) AS month,
        CAST(sum(CAST(round(l_extendedprice * (1 - l_discount) * 100) AS BIGINT)) AS DOUBLE) / 100 AS value FROM {lineitem} GROUP BY l_suppkey, year(l_shipdate), month(l_shipdate)""",
    "index_monthly": "SELECT month, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / 100 AS value FROM {monthly} GROUP BY month",
    "holdings": """SELECT l_suppkey AS account, CAST(year(l_shipdate) * 100 + month(l_shipdate) AS BIGINT) AS month, p_brand AS code,
        CASE WHEN l_returnflag = 'R' THEN 'short' ELSE 'long' END AS side, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / 100 AS market_value, sum(l_quantity) AS quantity
        FROM {lineitem} JOIN {part} ON l_partkey = p_partkey GROUP BY 1, 2, 3, 4""",
    "cross_section": """SELECT month, code, max(close) AS close, max(amount) AS circ_mv, CASE WHEN max(n) % 7 = 0 THEN NULL ELSE floor(max(high) / max(low) * 10) / 10 END AS pb,
        CAST(max(n) AS DOUBLE) AS turnover FROM {bars} GROUP BY month, code""",
    "tickets": """SELECT l_orderkey AS order_id, l_linenumber AS line, l_suppkey AS account, concat('P', CAST(l_partkey AS STRING)) AS code,
        CASE l_returnflag WHEN 'A' THEN 'entry' WHEN 'N' THEN 'exit' ELSE 'cash' END AS action, CASE WHEN l_linestatus = 'F' THEN 'filled' WHEN l_quantity < 10
        THEN 'rejected' WHEN l_quantity < 20 THEN 'cancelled' ELSE 'open' END AS status, CASE WHEN l_linestatus <> 'F' AND l_quantity < 10
        THEN concat('reason ', CAST(l_linenumber AS STRING)) END AS reason, CAST(l_quantity AS BIGINT) * 50 AS shares, floor(l_extendedprice / l_quantity) / 100 AS price,
        l_shipdate AS placed_at FROM {lineitem}""",
    # Events of an account in cents: closed and reduced positions, openings and dividends.
    "trades": """SELECT l_suppkey AS account, CASE WHEN l_returnflag = 'R' THEN 'short' ELSE 'long' END AS side, CASE WHEN l_linestatus <> 'F' AND l_linenumber = 1 THEN 'dividend_cash'
        WHEN l_linenumber % 3 = 0 THEN 'position_reduced' WHEN l_linenumber % 3 = 1 THEN 'position_closed' ELSE 'opened' END AS kind, CAST(floor(l_extendedprice * (l_discount - 0.05)) AS BIGINT) * 100 AS amount,
        CAST(floor(l_extendedprice) AS BIGINT) * 100 AS notional, CAST(floor(l_extendedprice * l_tax) AS BIGINT) AS fee FROM {lineitem}""",
    "old_part": "SELECT o_orderkey AS id, o_custkey AS cust, CASE WHEN o_orderkey % 31 > 0 THEN o_totalprice END AS price, o_orderpriority AS prio, CAST(o_orderkey % 50 AS BIGINT) AS part FROM {orders} WHERE o_orderkey % 41 <> 0",
    "new_part": """SELECT o_orderkey AS id, o_custkey AS cust, CASE WHEN o_orderkey % 17 = 0 THEN floor(o_totalprice * 101) / 100 WHEN o_orderkey % 23 = 0 THEN NULL
        ELSE o_totalprice END AS price, CASE WHEN o_orderkey % 29 = 0 THEN 'CHANGED' ELSE o_orderpriority END AS prio, CAST(o_orderkey % 50 AS BIGINT) AS part FROM {orders} WHERE o_orderkey % 37 <> 0""",
    "ledger": """SELECT o_orderpriority AS epoch, CAST(year(o_orderdate) * 100 + month(o_orderdate) AS BIGINT) AS fold, o_orderkey AS position,
        o_totalprice / 250000 - 1 AS test_return, CASE WHEN o_orderkey % 9 > 0 THEN o_totalprice / 300000 - 0.8 END AS bench_return, o_orderstatus AS status FROM {orders}""",
    "debts": """SELECT o_custkey AS account, o_orderkey AS contract, o_orderdate AS opened, floor(o_totalprice * 10) / 100 AS principal, floor(o_totalprice / 10) / 100 AS interest,
        CAST(o_orderkey % 900 + 100 AS BIGINT) AS shares FROM {orders}""",
    # Fifty companies with the words of their parts' names and beginnings of these as terms.
    "companies": """SELECT concat(lpad(CAST(p_partkey % 50 AS STRING), 6, '0'), '.SZ') AS code, split_part(p_name, ' ', 1) AS first_word, split_part(p_name, ' ', 2) AS last_word,
        substr(p_name, 1, CAST(3 + p_partkey % 3 AS INT)) AS beginning FROM {part}""",
    "coded_texts": "SELECT text_id, title, concat(lpad(CAST(code AS STRING), 6, '0'), '.SZ') AS ts_code FROM {texts}",
    # Event partitions (folder of dataset and month) with faults of every kind, and the raw files that exist: each tenth is gone, each fourth has no side file.
    "event_layer": """SELECT part_dataset, part_month, file_no, CASE WHEN event_id % 41 = 0 THEN 'other' ELSE part_dataset END AS dataset, CAST(code AS STRING) AS ts_code,
        CASE WHEN event_id % 37 = 0 THEN 'soon' WHEN event_id % 35 = 0 THEN NULL ELSE concat(day, ' 18:00:00+08:00') END AS available_at, CASE WHEN event_id % 29 = 0 THEN 'guess' ELSE 'source:ann_date' END AS available_at_rule,
        CASE WHEN event_id % 31 = 0 THEN '209901' ELSE part_month END AS available_month, concat('k', CAST(code AS STRING)) AS business_key,
        CASE WHEN event_id % 43 = 0 THEN ' ' WHEN event_id % 47 = 0 THEN 'raw/other/period=1.parquet' ELSE concat('raw/', part_dataset, '/period=', CAST(file_no AS STRING), '.parquet') END AS source_path,
        CASE WHEN event_id % 53 = 0 THEN '' WHEN event_id % 59 = 0 THEN 'bad' ELSE concat('h', CAST(file_no AS STRING)) END AS source_hash, CASE WHEN event_id % 61 = 0 THEN 'x' ELSE CAST(event_id AS STRING) END AS source_row_id,
        CASE WHEN event_id % 7 > 0 THEN CASE WHEN event_id % 67 = 0 THEN '20991231' ELSE announced END END AS ann_date
        FROM (SELECT event_id, code, event_id % 10 AS file_no, substr(CAST(available_at AS STRING), 1, 10) AS day, replace(substr(CAST(ts AS STRING), 1, 10), '-', '') AS announced, replace(substr(CAST(available_at AS STRING), 1, 7), '-', '') AS part_month,
        CASE dataset WHEN 'click' THEN 'income_vip' WHEN 'view' THEN 'dividend' WHEN 'purchase' THEN 'forecast_vip' WHEN 'signup' THEN 'express_vip' ELSE 'fina_audit_vip' END AS part_dataset FROM {pit}) p""",
    "event_files": """SELECT DISTINCT concat('raw/', part_dataset, '/period=', CAST(file_no AS STRING), '.parquet') AS source_path, CASE WHEN file_no <> 4 THEN concat('h', CAST(file_no AS STRING)) END AS source_hash
        FROM {event_layer} WHERE file_no < 9""",
    # Days of minute bars with faults, and the codes that each day should have: a third of those present, and some that never trade.
    "minute_rows": """SELECT trade_date AS part_day, ts_code, CASE WHEN l_orderkey % 97 = 0 THEN '19000101' ELSE trade_date END AS trade_date, CASE WHEN l_orderkey % 89 = 0 THEN 'no time'
        WHEN l_orderkey % 83 = 0 THEN concat(iso, ' 12:15:00') ELSE concat(iso, ' ', trade_time, ':00') END AS trade_time, CASE WHEN l_orderkey % 79 = 0 THEN ' ' WHEN l_orderkey % 73 = 0 THEN 'later'
        ELSE concat(iso, ' 18:00:00+08:00') END AS available_at, l_orderkey FROM (SELECT *, concat(substr(trade_date, 1, 4), '-', substr(trade_date, 5, 2), '-', substr(trade_date, 7, 2)) AS iso FROM {ticks}) x""",
    "minute_codes": """SELECT part_day, ts_code FROM {minute_rows} WHERE l_orderkey % 3 = 0 UNION SELECT part_day, concat('99', substr(ts_code, 3)) FROM {minute_rows} WHERE l_orderkey % 50 = 0
        UNION SELECT '20991231', ts_code FROM {minute_rows} WHERE l_orderkey % 500 = 1""",
    # Payouts in versions: dates and numbers as text, some blank, unreadable, below zero or announced too late.
    "payouts": """SELECT concat('C', CAST(o_custkey % 100 AS STRING)) AS ts_code, concat('E', CAST(o_orderkey % 3 AS STRING)) AS end_date, CASE WHEN o_orderstatus = 'O' THEN '预案' ELSE '实施' END AS div_proc,
        CASE WHEN o_orderkey % 19 = 0 THEN ' ' ELSE concat(quarter_end, '15') END AS ex_date, concat(substr(CAST(o_orderdate AS STRING), 1, 10), 'T18:00:00+08:00') AS available_at,
        CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 9 = 0 THEN 'n/a' ELSE CAST(o_orderkey % 40 - 8 AS STRING) END AS cash_div_tax, CASE WHEN o_orderkey % 5 > 0 THEN CAST(o_orderkey % 16 AS STRING) END AS cash_div,
        CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey % 4 AS STRING) END AS stk_div, CASE WHEN o_orderkey % 7 > 0 THEN '1' END AS stk_bo_rate, CAST(o_orderkey % 3 AS STRING) AS stk_co_rate,
        CASE WHEN o_orderkey % 6 > 0 THEN concat(quarter_end, '14') END AS record_date, concat(quarter_end, CAST(o_orderkey % 10 + 16 AS STRING)) AS pay_date, CASE WHEN o_orderkey % 2 = 0 THEN concat(quarter_end, CAST(o_orderkey % 8 + 20 AS STRING)) END AS div_listdate
        FROM (SELECT *, concat(CAST(year(o_orderdate) AS STRING), CASE WHEN month(o_orderdate) <= 3 THEN '03' WHEN month(o_orderdate) <= 6 THEN '06' WHEN month(o_orderdate) <= 9 THEN '09' ELSE '12' END) AS quarter_end FROM {orders}) x""",
    # Bars of a month and code, and what auctions and daily rows say of them: most alike, some absent or empty.
    "month_bars": """SELECT substr(trade_date, 1, 6) AS month, ts_code, trade_time, sum(vol) AS vol, CAST(sum(CAST(round(amount * 100) AS BIGINT)) AS DOUBLE) / 100 AS amount, CAST(substr(ts_code, 3, 4) AS INT) AS num FROM {ticks} GROUP BY 1, 2, 3""",
    "auctions": """SELECT month, ts_code, CASE WHEN num % 13 = 0 THEN 0 ELSE vol * (1 + num % 7) END AS vol, amount * (1 + num % 5) AS amount FROM {month_bars} WHERE trade_time = '09:30' AND num % 11 > 0""",
    "month_rows": """SELECT month, ts_code, sum(vol) * 2 + num % 3 AS vol, CASE WHEN num % 17 > 0 THEN sum(CAST(floor(amount) AS BIGINT)) END AS amount FROM {month_bars} GROUP BY month, ts_code, num""",
    # Names and industries of 300 codes over time, some without a date of announcement, beginning or end.
    "name_changes": """SELECT o_custkey % 300 AS code, concat('N', CAST(o_orderkey AS STRING)) AS name, start_date, CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN ' ' WHEN o_orderkey % 5 = 0 THEN '19991231' ELSE start_date END AS ann_date,
        CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE start_date END AS in_date, CASE WHEN o_orderkey % 3 = 0 THEN 'None' WHEN o_orderkey % 3 = 1 THEN NULL ELSE concat(CAST(year(o_orderdate) + 1 AS STRING), substr(start_date, 5)) END AS out_date, concat('L', CAST(o_orderkey % 31 AS STRING)) AS industry
        FROM (SELECT *, replace(substr(CAST(o_orderdate AS STRING), 1, 10), '-', '') AS start_date FROM {orders}) x""",
    "texts": """SELECT doc_id AS text_id, source AS dataset, lang, text AS body, substr(text, 1, 40) AS title,
        CAST(doc_id * 37 % 1000 AS BIGINT) AS available_at, CAST(doc_id % 50 AS BIGINT) AS code FROM {documents}""",
}


def expanded(sql: str) -> str:
    """``sql`` with every view spelled out; only driver tables stay as ``{name}``."""
    while names := {n for n in re.findall(r"\{(\w+)\}", sql) if n in VIEWS}:
        for n in names:
            sql = sql.replace(f"{{{n}}}", f"({VIEWS[n]})")
    return sql


def oracle(sql: str) -> str:
    """For DuckDB: views spelled out, driver tables by name."""
    return re.sub(r"\{(\w+)\}", r"\1", expanded(sql))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = expanded(VIEWS[name])
    used = set(re.findall(r"\{(\w+)\}", sql))
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})


def base(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The partition column of the lake of ticks.
MONTH = "trade_month"
_lakes: dict[tuple[str, str], str] = {}


def dealt_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks with their month, dealt by it as they lie, numbers and dates: the texts of a tick are made behind the shuffle."""
    lines = base(spark, sf_dir, "lineitem").withColumn("_month", F.date_trunc("month", "l_shipdate")).hint("rebalance", "_month")
    return spark.sql(expanded(VIEWS["ticks"]), lineitem=lines).withColumn(MONTH, F.substring("trade_date", 1, 6))


def by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks as a lake with a folder a month, written once a session; range scans prune its folders."""
    ticks = dealt_by_month(spark, sf_dir)
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _lakes:
        path = new_path(spark, "ticks")
        ticks.sortWithinPartitions(MONTH, "trade_date").write.partitionBy(MONTH).parquet(path)
        _lakes[key] = path
    return spark.read.schema(ticks.schema).parquet(_lakes[key])

"""Queries of the time and value columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import market, timecols
from .registry import Tables, query

_DAY = "replace(substr(CAST(o_orderdate AS VARCHAR), 1, 10), '-', '')"


@query("""SELECT event_id, CASE WHEN event_id % 7 IN (0, 1, 5) THEN strftime(CAST(substr(whole, 1, 19) AS TIMESTAMP) - INTERVAL 8 HOUR, '%Y-%m-%d %H:%M:%S')
    WHEN event_id % 7 = 2 THEN strftime(CAST(substr(whole, 1, 19) AS TIMESTAMP) - INTERVAL 8 HOUR, '%Y-%m-%d %H:%M:%S') WHEN event_id % 7 = 3 THEN substr(whole, 1, 19) END AS utc FROM {messy_times} t""")
def to_cn_timestamp(t: Tables) -> DataFrame:
    return t.messy_times.select("event_id", F.date_format(timecols.to_cn_timestamp("raw"), "yyyy-MM-dd HH:mm:ss").alias("utc"))


@query("""SELECT event_id, CASE WHEN raw IS NULL THEN '' WHEN regexp_full_match(raw, '\\d{4}-?\\d\\d-?\\d\\d \\d\\d:\\d\\d:\\d\\d')
    THEN regexp_replace(raw, '(\\d{4})-?(\\d\\d)-?(\\d\\d) (.*)', '\\1-\\2-\\3T\\4+08:00') ELSE raw END AS iso FROM {messy_times} t""".replace("{4}", "\\d\\d\\d\\d").replace("\\d\\d\\d\\d\\d", "\\d\\d\\d\\d"))
def normalize_source_datetime(t: Tables) -> DataFrame:
    return t.messy_times.select("event_id", timecols.normalize_source_datetime("raw").alias("iso"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 6 IN (0, 1, 2, 5) THEN substr(replace(first_date, '-', ''), 1, 8) END AS day FROM {messy_dates} t""")
def clean_date(t: Tables) -> DataFrame:
    return t.messy_dates.select("o_orderkey", timecols.clean_date("first_date").alias("day"))


@query("""WITH d AS (SELECT o_orderkey, CASE WHEN o_orderkey % 6 IN (0, 1, 2, 5) THEN substr(replace(first_date, '-', ''), 1, 8) END AS a, second_date AS b FROM {messy_dates} t)
    SELECT o_orderkey, coalesce(a, b) || ' 18:00:00' AS available_at, CASE WHEN a IS NOT NULL THEN 'first:first_date' WHEN b IS NOT NULL THEN 'first:second_date' END AS rule FROM d""")
def first_available(t: Tables) -> DataFrame:
    stamp, rule = timecols.first_available(["first_date", "second_date"], "first")
    return t.messy_dates.select("o_orderkey", stamp.alias("available_at"), rule.alias("rule"))


@query("""WITH d AS (SELECT o_orderkey, o_custkey, kind, CASE WHEN o_orderkey % 6 IN (0, 1, 2, 5) THEN substr(replace(first_date, '-', ''), 1, 8) END AS f, second_date AS own FROM {messy_dates} t),
    j AS (SELECT o_custkey, max(own) AS joined FROM d GROUP BY 1)
    SELECT o_orderkey, CASE kind WHEN 0 THEN coalesce(f, own) WHEN 1 THEN own WHEN 2 THEN coalesce(own, joined) ELSE coalesce(own, f) END AS day FROM d LEFT JOIN j USING (o_custkey)""")
def fundamental_available_at(t: Tables) -> DataFrame:
    d = t.messy_dates
    joined = d.groupBy("o_custkey").agg(F.max(timecols.clean_date("second_date")).alias("joined"))
    kind = F.when(F.col("kind") == 0, "statement").when(F.col("kind") == 1, "notice").when(F.col("kind") == 2, "audit").otherwise("dividend")
    return d.join(joined, "o_custkey", "left").select("o_orderkey", timecols.fundamental_available_at(kind, F.col("second_date"), F.col("first_date"), F.col("joined")).alias("day"))


@query("""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y%m%d') WHEN 1 THEN strftime(last_day(o_orderdate) + INTERVAL 31 DAY, '%Y%m%d')
    ELSE strftime(date_trunc('quarter', o_orderdate) + INTERVAL 3 MONTH - INTERVAL 1 DAY + INTERVAL 45 DAY, '%Y%m%d') END AS day,
    CASE o_orderkey % 3 WHEN 0 THEN 'date' WHEN 1 THEN 'month_end_plus_31d' ELSE 'quarter_end_plus_45d' END AS rule FROM orders""")
def period_available_at(t: Tables) -> DataFrame:
    period = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyyMMdd")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "yyyyMM")).otherwise(F.date_format("o_orderdate", "yyyy'Q'Q"))
    day, rule = timecols.period_available_at("p")
    return t.orders.select("o_orderkey", period.alias("p")).select("o_orderkey", day.alias("day"), rule.alias("rule"))


@query(f"""SELECT o_orderkey, CASE WHEN o_orderkey % 30 < 24 AND o_orderkey % 70 < 60 THEN strftime(o_orderdate, '%Y-%m-%d') || ' ' || lpad(CAST(o_orderkey % 30 AS VARCHAR), 2, '0') || ':' || lpad(CAST(o_orderkey % 70 AS VARCHAR), 2, '0') || ':00' END AS at FROM orders""")
def combine_date_time(t: Tables) -> DataFrame:
    clock = F.concat((F.col("o_orderkey") % 30).cast("string"), F.lit(":"), F.lpad((F.col("o_orderkey") % 70).cast("string"), 2, "0"))
    return t.orders.select("o_orderkey", timecols.combine_date_time(F.date_format("o_orderdate", "yyyyMMdd"), clock).alias("at"))


_RULES = "['next_day_0900','same_day_0900','same_day_1900','next_day_0830','same_day_2000','final_2230','other']"


@query(f"""SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN strftime(o_orderdate + INTERVAL 1 DAY, '%Y-%m-%d 09:00:00') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d 09:00:00') WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d 19:00:00')
    WHEN 3 THEN strftime(o_orderdate + INTERVAL 1 DAY, '%Y-%m-%d 08:30:00') WHEN 4 THEN strftime(o_orderdate, '%Y-%m-%d 20:00:00') WHEN 5 THEN CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%d 22:30:00') ELSE strftime(o_orderdate, '%Y-%m-%d 23:59:59') END
    ELSE strftime(o_orderdate, '%Y-%m-%d 23:59:59') END AS at FROM orders""")
def official_available_at(t: Tables) -> DataFrame:
    rule = F.element_at(F.array(*map(F.lit, [*timecols.CLOCKS, "other"])), (F.col("o_orderkey") % 7 + 1).cast("int"))
    return t.orders.select("o_orderkey", timecols.official_available_at(F.date_format("o_orderdate", "yyyyMMdd"), rule, F.when(F.col("o_orderkey") % 2 == 0, "Y").otherwise("N")).alias("at"))


@query("""WITH s AS (SELECT o_orderkey, o_orderdate AS d, CASE WHEN o_orderkey % 8 < 7 THEN o_orderdate + to_hours(CAST((o_orderkey % 8 - 2) * 20 AS BIGINT)) END AS w FROM orders)
    SELECT o_orderkey, CASE WHEN epoch(w - d) / 86400.0 BETWEEN -1 AND 3 THEN strftime(w, '%Y-%m-%d %H:%M:%S') ELSE strftime(d, '%Y-%m-%d 23:59:59') END AS at,
    CASE WHEN w IS NULL THEN 'date_end' WHEN epoch(w - d) / 86400.0 BETWEEN -1 AND 3 THEN 'source_time' ELSE 'implausible' END AS rule FROM s""")
def text_available_at(t: Tables) -> DataFrame:
    shifted = F.when(F.col("o_orderkey") % 8 < 7, (F.col("o_orderdate") + F.make_interval(hours=((F.col("o_orderkey") % 8 - 2) * 20).cast("int"))).cast("string"))
    at, rule = timecols.text_available_at("w", "d")
    return t.orders.select("o_orderkey", F.date_format("o_orderdate", "yyyyMMdd").alias("d"), shifted.alias("w")).select("o_orderkey", at.alias("at"), rule.alias("rule"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 25 < 24 THEN (o_orderkey % 25) * 60 + o_orderkey % 60 END AS minute FROM orders""")
def minute_key(t: Tables) -> DataFrame:
    h, m = (F.lpad((F.col("o_orderkey") % k).cast("string"), 2, "0") for k in (25, 60))
    text = F.when(F.col("o_orderkey") % 4 == 0, F.concat(h, F.lit(":"), m)).when(F.col("o_orderkey") % 4 == 1, F.concat(h, m)).when(F.col("o_orderkey") % 4 == 2, F.concat(h, m, F.lit("30"))).otherwise(F.concat(F.lit("20200102"), h, m, F.lit("00")))
    return t.orders.select("o_orderkey", timecols.minute_key(text).cast("long").alias("minute"))


@query("""SELECT l_orderkey, l_linenumber, trade_time, price, CASE WHEN ts_code LIKE '00%' THEN 'sz_main_00' WHEN ts_code LIKE '30%' THEN 'sz_gem_30' WHEN ts_code LIKE '60%' THEN 'sh_main_60' WHEN ts_code LIKE '68%' THEN 'sh_star_68' ELSE 'bj' END AS bucket FROM {ticks} t""")
def market_bucket(t: Tables) -> DataFrame:
    return t.ticks.select("l_orderkey", "l_linenumber", "trade_time", "price", market.bucket("ts_code").alias("bucket"))


@query("""SELECT trade_date, ts_code, trade_time, vol * f AS vol_pit, amount * f AS amount_pit, CASE WHEN f < 1 THEN 'factor' ELSE 'none' END AS rule FROM
    (SELECT *, CASE WHEN trade_time = '09:30' AND ts_code LIKE '00%' THEN 0.76 WHEN trade_time = '09:30' AND ts_code LIKE '30%' THEN 0.58 ELSE 1.0 END AS f FROM {ticks} t) x""")
def open_auction_correction(t: Tables) -> DataFrame:
    out = market.open_auction_correction(t.ticks)
    return out.select("trade_date", "ts_code", "trade_time", "vol_pit", "amount_pit", F.col("auction_rule").alias("rule"))


@query("""SELECT l_orderkey, l_linenumber, price, vol, amount, CASE l_orderkey % 5 WHEN 1 THEN 'recovered' WHEN 2 THEN 'no_trade' WHEN 3 THEN 'bad' ELSE 'traded' END AS state, CASE l_orderkey % 5 WHEN 2 THEN NULL WHEN 3 THEN price + 1 ELSE price END AS fixed FROM {ticks} t WHERE l_orderkey % 5 <> 4""")
def auction_price_repair(t: Tables) -> DataFrame:
    k = F.col("l_orderkey") % 5
    raw = t.ticks.select("l_orderkey", "l_linenumber", F.col("price").alias("p0"), F.col("vol").alias("v0"), F.col("amount").alias("a0"),
        F.when(k.isin(1, 4), None).when(k == 3, F.col("price") + 1).otherwise(F.col("price")).alias("price"), F.when(k == 2, 0.0).when(k == 4, None).otherwise(F.col("vol")).alias("vol"), F.when(k == 2, 0.0).when(k == 4, None).otherwise(F.col("amount")).alias("amount"))
    out = market.auction_price_repair(raw)
    fixed = F.when(F.col("auction_state") == "recovered", F.col("p0")).otherwise(F.col("price"))
    return out.select("l_orderkey", "l_linenumber", F.col("p0").alias("price"), F.col("v0").alias("vol"), F.col("a0").alias("amount"), F.col("auction_state").alias("state"), fixed.alias("fixed"))


@query("""SELECT month, code, CASE WHEN n % 3 = 0 THEN close ELSE open END AS open, CASE WHEN n % 5 = 0 THEN greatest(CASE WHEN n % 3 = 0 THEN close ELSE open END, close) ELSE high END AS high,
    CASE WHEN n % 5 = 0 THEN least(CASE WHEN n % 3 = 0 THEN close ELSE open END, close) ELSE low END AS low, close FROM {bars} b""")
def ohlc_fill(t: Tables) -> DataFrame:
    gaps = t.bars.select("month", "code", F.when(F.col("n") % 3 != 0, F.col("open")).alias("open"), F.when(F.col("n") % 5 != 0, F.col("high")).alias("high"), F.when(F.col("n") % 5 != 0, F.col("low")).alias("low"), "close")
    return market.ohlc_fill(gaps).select("month", "code", "open", "high", "low", "close")


@query("""SELECT DISTINCT ts_code, CASE WHEN ts_code LIKE '%.BJ' THEN 'BJ' WHEN ts_code LIKE '00%' OR ts_code LIKE '30%' OR ts_code LIKE '60%' OR ts_code LIKE '68%' THEN 'A_share' ELSE split_part(ts_code, '.', 2) END AS kind FROM {ticks} t""")
def security_type(t: Tables) -> DataFrame:
    return t.ticks.select("ts_code", market.security_type("ts_code").alias("kind")).distinct()


@query("""SELECT month, code, close >= low * 1.1 AS up_blocked, close <= high * 0.9 AS down_blocked, n < 20 AS suspended, greatest(least(close, low * 1.1), high * 0.9) AS clamped FROM {bars} b""")
def limit_flags(t: Tables) -> DataFrame:
    up, down, blocked_up, blocked_down = F.col("low") * 1.1, F.col("high") * 0.9, "up_blocked", "down_blocked"
    flags = market.limit_flags(F.col("close"), up, down)
    return t.bars.select("month", "code", flags["up"].alias(blocked_up), flags["down"].alias(blocked_down), (F.col("n") < 20).alias("suspended"), flags["clamped"].alias("clamped"))


@query("""SELECT order_id, line, shares, CASE WHEN shares <= 0 THEN 'not_positive' WHEN order_id % 3 = 1 THEN CASE WHEN shares < 200 THEN 'below_minimum' END WHEN order_id % 3 = 2 THEN CASE WHEN shares < 100 THEN 'below_minimum' END
    ELSE CASE WHEN shares % 100 <> 0 AND NOT (action = 'exit' AND shares % 100 = 2000 % 100 AND shares = 2000) THEN 'odd_lot' END END AS reject FROM {tickets} k""")
def lot_valid(t: Tables) -> DataFrame:
    board = F.when(F.col("order_id") % 3 == 1, "sh_star_68").when(F.col("order_id") % 3 == 2, "bj").otherwise("sh_main_60")
    return t.tickets.select("order_id", "line", "shares", market.lot_reject(F.col("shares"), F.lit(2000), board, F.col("action") == "exit").alias("reject"))


@query("""SELECT order_id, line, round(greatest(shares * price * 0.0003, 5), 6) AS commission, round(shares * price * 0.00001, 6) AS transfer, round(CASE WHEN action = 'exit' THEN shares * price * CASE WHEN placed_at >= TIMESTAMP '1999-01-01' THEN 0.0005 ELSE 0.001 END ELSE 0 END, 6) AS stamp,
    round(CASE WHEN action = 'exit' THEN shares * price ELSE -shares * price END - greatest(shares * price * 0.0003, 5) - shares * price * 0.00001 - CASE WHEN action = 'exit' THEN shares * price * CASE WHEN placed_at >= TIMESTAMP '1999-01-01' THEN 0.0005 ELSE 0.001 END ELSE 0 END, 6) AS cash FROM {tickets} k""")
def trade_costs(t: Tables) -> DataFrame:
    duty = F.when(F.col("placed_at") >= F.lit("1999-01-01").cast("timestamp_ntz"), 0.0005).otherwise(0.001)
    c = market.trade_costs(F.col("shares") * F.col("price"), F.col("action") == "exit", duty)
    return t.tickets.select("order_id", "line", *(F.round(c[k], 6).alias(k) for k in ("commission", "transfer", "stamp", "cash")))


@query("""SELECT month, code, vol * 100 AS vol, amount * 1000 AS amount, n * 0.01 AS turnover FROM (SELECT month, code, vol, amount, CAST(n AS DOUBLE) AS n FROM {bars} b) x""")
def unit_normalize(t: Tables) -> DataFrame:
    return market.unit_normalize(t.bars.select("month", "code", F.col("vol").cast("string"), F.col("amount").cast("string"), F.col("n").cast("string").alias("turnover")), {"vol": "hands", "amount": "thousands", "turnover": "percent"})

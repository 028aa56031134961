"""Queries of performance, orders and ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import actions, perf, windows
from .registry import Tables, query

_RET = "r AS (SELECT account, month, value, value / coalesce(lag(value) OVER (PARTITION BY account ORDER BY month), 100000) - 1 AS ret, value / greatest(100000, max(value) OVER (PARTITION BY account ORDER BY month ROWS UNBOUNDED PRECEDING)) - 1 AS dd FROM {monthly} m)"
_CYCLE = "s AS (SELECT account, month, value / lag(value) OVER (PARTITION BY account ORDER BY month) - 1 AS y FROM {monthly} m), i AS (SELECT month, value / lag(value) OVER (ORDER BY month) - 1 AS x FROM {index_monthly} m), c AS (SELECT account, month, y / 100 AS y, x / 100 AS x FROM s LEFT JOIN i USING (month) WHERE y IS NOT NULL), e AS (SELECT *, product(1 + y) OVER (PARTITION BY account ORDER BY month) AS equity FROM c), f AS (SELECT *, 1 - equity / greatest(1, max(equity) OVER (PARTITION BY account ORDER BY month)) AS fall FROM e)"
_PAIRS = "s AS (SELECT account, month, value / lag(value) OVER (PARTITION BY account ORDER BY month) - 1 AS y FROM {monthly} m), i AS (SELECT month, value / lag(value) OVER (ORDER BY month) - 1 AS x FROM {index_monthly} m), p AS (SELECT account, y / 100 AS y, x / 100 AS x FROM s JOIN i USING (month) WHERE y IS NOT NULL AND x IS NOT NULL)"


def _pairs(t: Tables) -> DataFrame:
    s = windows.returns(t.monthly, "account", "month", "value").where("ret is not null").select("account", "month", (F.col("ret") / 100).alias("y"))
    i = windows.returns(t.index_monthly.withColumn("k", F.lit(1)), "k", "month", "value").where("ret is not null").select("month", (F.col("ret") / 100).alias("x"))
    return s.join(i, "month")


def _rounded(df: DataFrame, digits: int, *keys: str) -> DataFrame:
    return df.select(*keys, *(F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes if c not in keys))


@query(f"WITH {_RET}, g AS (SELECT account, round(arg_max(value, month) / 100000 - 1, 6) AS total_return, round(pow(arg_max(value, month) / 100000, 12.0 / count(*)) - 1, 6) AS annual_return, round(coalesce(CASE WHEN stddev_samp(ret) > 0 THEN avg(ret) / stddev_samp(ret) * sqrt(12.0) END, 0), 6) AS sharpe, round(least(min(dd), 0), 6) AS max_drawdown, count(*) AS periods FROM r GROUP BY account), k AS (SELECT account, count(*) FILTER (kind LIKE 'position%') AS trades, count(*) FILTER (kind = 'position_closed') AS full_closes, coalesce(round(count(*) FILTER (kind LIKE 'position%' AND amount > 0) / nullif(count(*) FILTER (kind LIKE 'position%'), 0), 6), 0) AS win_rate, round(coalesce(sum(amount) FILTER (side = 'long' AND kind <> 'opened'), 0) / 10000000, 6) AS long_return, round(coalesce(sum(amount) FILTER (side = 'short' AND kind <> 'opened'), 0) / 10000000, 6) AS short_return, round(sum(notional) / 10000000, 6) AS turnover, CAST(sum(fee) AS BIGINT) AS fees FROM {{trades}} d GROUP BY account) SELECT * FROM g LEFT JOIN k USING (account)")
def a17_return_stats(t: Tables) -> DataFrame:
    equity = _rounded(perf.return_stats(t.monthly, "account", "month", "value", F.lit(100000.0), 12), 6, "account")
    trades = perf.trade_stats(t.trades, "account", F.lit(10_000_000))  # cents
    return equity.join(_rounded(trades, 6, "account"), "account", "left")


@query("SELECT action, count(*) AS total, count(*) FILTER (status = 'filled') AS filled, count(*) FILTER (status = 'rejected') AS rejected, count(*) FILTER (status = 'cancelled') AS cancelled FROM {tickets} k GROUP BY action")
def a18_order_lifecycle(t: Tables) -> DataFrame:
    return perf.status_counts(t.tickets, "action", "status", ["filled", "rejected", "cancelled"])


@query("""WITH g AS (SELECT account, month, sum(market_value) AS gross, sum(market_value) FILTER (side = 'short') AS owed FROM {holdings} h GROUP BY 1, 2) SELECT account, round(avg(coalesce(gross / value, 0)), 6) AS average, round(max(coalesce(gross / value, 0)), 6) AS highest,
    round(avg(coalesce((gross - coalesce(owed, 0)) / value, 0)), 6) AS long, round(avg(coalesce(owed / value, 0)), 6) AS short, count(*) FILTER (gross IS NULL) AS zero_dates FROM {monthly} m LEFT JOIN g USING (account, month) GROUP BY account""")
def a19_exposure(t: Tables) -> DataFrame:
    return _rounded(perf.exposure(t.holdings, t.monthly, "account", "month", "value"), 6, "account")


@query("""WITH o AS (SELECT *, strftime(placed_at, '%Y%m%d') AS day, CAST(shares * price * 100 AS BIGINT) AS amount FROM {tickets} k) SELECT 'action' AS what, action AS name, count(*) AS n, CAST(sum(amount) AS BIGINT) AS amount FROM o GROUP BY action
    UNION ALL SELECT 'account', CAST(account AS VARCHAR), count(*), CAST(sum(amount) AS BIGINT) FROM o GROUP BY account UNION ALL SELECT 'day', day, count(*), CAST(sum(amount) AS BIGINT) FROM o WHERE status = 'filled' GROUP BY day
    UNION ALL (SELECT 'code', code, count(*), CAST(sum(amount) AS BIGINT) AS amount FROM o GROUP BY code ORDER BY 4 DESC, code LIMIT 8) UNION ALL (SELECT 'reason', reason, count(*) AS n, CAST(sum(amount) AS BIGINT) FROM o WHERE reason IS NOT NULL GROUP BY reason ORDER BY n DESC, reason LIMIT 6)""")
def a20_order_stats(t: Tables) -> DataFrame:
    cents = F.round(F.col("shares") * F.col("price") * 100).cast("long")
    return perf.order_stats(t.tickets.withColumns({"day": F.date_format("placed_at", "yyyyMMdd"), "amount": cents}))


@query(f"WITH {_PAIRS} SELECT account, count(*) AS n, round(CASE WHEN count(*) >= 8 THEN covar_pop(y, x) / var_pop(x) END, 3) AS beta, round(CASE WHEN count(*) >= 8 THEN (avg(y) - covar_pop(y, x) / var_pop(x) * avg(x)) * 12 END, 4) AS alpha, round(CASE WHEN count(*) >= 8 THEN covar_pop(y, x) ** 2 / (var_pop(x) * var_pop(y)) END, 3) AS r2, round(product(1 + x) - 1, 6) AS benchmark FROM p GROUP BY account")
def a21_benchmark_regression(t: Tables) -> DataFrame:
    return perf.regression(_pairs(t), "account", "y", "x", 12)


@query(f"WITH {_CYCLE} SELECT account, count(*) AS periods, count(x) AS matched, round(product(1 + y) - 1, 4) AS cumulative, round(pow(product(1 + y), 12.0 / count(*)) - 1, 4) AS annual_return, round(coalesce(stddev_samp(y), 0) * sqrt(12.0), 4) AS volatility, round(coalesce(CASE WHEN stddev_samp(y) > 0 THEN avg(y) / stddev_samp(y) * sqrt(12.0) END, 0), 4) AS sharpe, round(greatest(max(fall), 0), 4) AS max_drawdown, round(count(*) FILTER (y > 0) / count(*), 4) AS win_rate, round(CASE WHEN count(x) >= 2 THEN product(CASE WHEN x IS NOT NULL THEN 1 + x END) - 1 END, 4) AS benchmark, round(CASE WHEN count(x) >= 2 THEN product(CASE WHEN x IS NOT NULL THEN 1 + y END) - product(CASE WHEN x IS NOT NULL THEN 1 + x END) END, 4) AS excess, round(CASE WHEN count(x) >= 2 THEN covar_pop(y, x) / var_pop(x) END, 4) AS beta, round(stddev_samp(y - x) * sqrt(12.0), 4) AS tracking_error, round(avg(y - x) / stddev_samp(y - x) * sqrt(12.0), 4) AS information_ratio FROM f GROUP BY account")
def a22_cycle_stats(t: Tables) -> DataFrame:
    s = windows.returns(t.monthly, "account", "month", "value").where("ret is not null").select("account", "month", (F.col("ret") / 100).alias("y"))
    i = windows.returns(t.index_monthly.withColumn("k", F.lit(1)), "k", "month", "value").where("ret is not null").select("month", (F.col("ret") / 100).alias("x"))
    return perf.cycle_stats(s.join(i, "month", "left"), "account", "month", "y", "x", 12)


@query("""WITH k AS (SELECT month, code, (rank() OVER (PARTITION BY month ORDER BY circ_mv) + (count(*) OVER (PARTITION BY month, circ_mv) - 1) / 2.0) / count(*) OVER (PARTITION BY month) AS s, CASE WHEN pb IS NULL THEN 0.5 ELSE (rank() OVER (PARTITION BY month ORDER BY pb NULLS LAST) + (count(*) OVER (PARTITION BY month, pb) - 1) / 2.0) / count(pb) OVER (PARTITION BY month) END AS b FROM {cross_section} c),
    w AS (SELECT account, month, code, market_value * CASE WHEN side = 'short' THEN -1 ELSE 1 END / sum(market_value) OVER (PARTITION BY account, month) AS w FROM {holdings} h),
    d AS (SELECT account, month, sum(w * (s - 0.5) * 2) AS size, sum(w * (b - 0.5) * 2) AS pb FROM w JOIN k USING (month, code) GROUP BY 1, 2) SELECT account, round(avg(size), 6) AS size, round(avg(pb), 6) AS pb FROM d GROUP BY account""")
def a23_style_exposure(t: Tables) -> DataFrame:
    xs = windows.pct_rank_avg(windows.pct_rank_avg(t.cross_section, "month", "circ_mv", "s"), "month", "pb", "b").select("month", "code", "s", "b")
    return _rounded(perf.style_exposure(t.holdings, xs, "month", "code", {"size": "s", "pb": "b"}, "account"), 6, "account")


@query("""WITH r AS (SELECT account // 10 AS run, account, month, value, value / lag(value) OVER (PARTITION BY account ORDER BY month) - 1 AS y FROM {monthly} m), i AS (SELECT month, value / lag(value) OVER (ORDER BY month) - 1 AS x FROM {index_monthly} j),
    f AS (SELECT run, count(*) AS days, round(sum(value) / count(*), 4) AS mean FROM (SELECT *, row_number() OVER (PARTITION BY run, month ORDER BY account) AS k FROM r) q WHERE k = 1 GROUP BY 1),
    c AS (SELECT run, y, x FROM (SELECT *, row_number() OVER (PARTITION BY run, month ORDER BY account) AS k FROM r WHERE y IS NOT NULL) q JOIN i USING (month) WHERE k = 1 AND x IS NOT NULL),
    g AS (SELECT run, count(*) AS n, covar_pop(y, x) / var_pop(x) AS b, avg(y) AS my, avg(x) AS mx, covar_pop(y, x) * covar_pop(y, x) / (var_pop(x) * var_pop(y)) AS r2 FROM c GROUP BY 1),
    h AS (SELECT account // 10 AS run, count(*) AS k, round(sum(names) / count(*), 6) AS names, round(sum(gross) / count(*), 3) AS gross FROM (SELECT account, month, count(*) AS names, sum(market_value) AS gross FROM {holdings} p GROUP BY 1, 2) z GROUP BY 1)
    SELECT run, f.days, f.mean, g.n, CASE WHEN n >= 8 THEN round(b, 3) END AS beta, CASE WHEN n >= 8 THEN round((my - b * mx) * 12, 4) END AS alpha, CASE WHEN n >= 8 THEN round(r2, 3) END AS r2, h.names, h.gross FROM f JOIN g USING (run) JOIN h USING (run)""")
def a24_style_rollup(t: Tables) -> DataFrame:
    """Runs of ten accounts, each a window: the chained mean, a regression merged from the windows' states, and holdings weighted by their months."""
    run = F.floor(F.col("account") / 10).alias("run")
    own = windows.returns(t.monthly, "account", "month", "value").select(run, "account", "month", "value", F.col("ret").alias("y"))
    index = windows.returns(t.index_monthly.withColumn("_all", F.lit(0)), "_all", "month", "value").select("month", F.col("ret").alias("x"))  # a row a month
    first = windows.keep_one(own, ["run", "month"], ["account"], "first").groupBy("run").agg(F.count("*").alias("days"), F.round(F.sum("value") / F.count("*"), 4).alias("mean"))
    fitted = perf.regression_of(perf.merged(perf.chained_moments(own, "run", "account", "month", "y", index, "x"), ["run"]), 12)
    held = t.holdings.groupBy("account", "month").agg(F.count("*").alias("names"), F.sum("market_value").alias("gross"))
    stats = held.groupBy("account").agg(F.count("*").alias("months"), F.avg("names").alias("names"), F.avg("gross").alias("gross")).select(run, "months", "names", "gross")
    style = perf.weighted_by_days(stats, "run", "months", ["names", "gross"]).select("run", F.round("names", 6).alias("names"), F.round("gross", 3).alias("gross"))
    return first.join(fitted, "run").join(style, "run")


@query("""WITH l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY epoch, fold ORDER BY position DESC) AS r FROM {ledger} l) x WHERE r = 1) SELECT epoch, count(test_return) AS folds, round(avg(test_return), 6) AS mean, round(median(test_return), 6) AS median, round(stddev_samp(test_return), 6) AS std, round(min(test_return), 6) AS worst,
    round(count(*) FILTER (test_return > 0) / count(test_return), 6) AS positive, round(avg(test_return) / (stddev_samp(test_return) / sqrt(count(test_return))), 6) AS t, round(product(CASE WHEN bench_return IS NOT NULL THEN 1 + test_return / 100 END) / product(CASE WHEN bench_return IS NOT NULL THEN 1 + bench_return / 100 END) - 1, 6) AS active100 FROM l GROUP BY epoch""")
def a25_fold_report(t: Tables) -> DataFrame:
    last = windows.keep_one(t.ledger, ["epoch", "fold"], ["position"], "last")
    out = perf.fold_report(last, "epoch", "test_return", "bench_return").drop("active")
    hundredths = last.withColumn("test_return", F.col("test_return") / 100).withColumn("bench_return", F.col("bench_return") / 100)
    small = perf.active_return(hundredths, "epoch", "test_return", "bench_return").withColumnRenamed("active", "active100")
    return _rounded(out.join(small, "epoch"), 6, "epoch")


@query("WITH l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY epoch, fold ORDER BY position DESC) AS r FROM {ledger} l) x WHERE r = 1) SELECT epoch, count(*) AS folds, round(product(1 + test_return / 100) - 1, 6) AS compounded, epoch = max(epoch) OVER () AS headline FROM l GROUP BY epoch")
def a26_experiment_summary(t: Tables) -> DataFrame:
    last = windows.keep_one(t.ledger, ["epoch", "fold"], ["position"], "last")
    per = last.groupBy("epoch").agg(F.count("*").alias("folds"), F.round(F.product(1 + F.col("test_return") / 100) - 1, 6).alias("compounded"))
    newest = per.agg(F.max("epoch").alias("_e"))
    return per.join(F.broadcast(newest)).select("epoch", "folds", "compounded", (F.col("epoch") == F.col("_e")).alias("headline"))


@query("""WITH h AS (SELECT account, sum(m) AS assets, sum(CASE WHEN m - c > 0 THEN (m - c) * 0.70 ELSE (m - c) * 1.00 END) AS g FROM (SELECT account, CAST(CASE WHEN side = 'short' THEN -market_value ELSE market_value END AS DECIMAL(18,2)) AS m, CAST(quantity * 1000 AS DECIMAL(18,2)) AS c FROM {holdings} h WHERE month = 199806) x GROUP BY 1),
    d AS (SELECT account, sum(CAST(principal AS DECIMAL(18,2)) + CAST(interest AS DECIMAL(18,2))) AS debt FROM {debts} d GROUP BY 1) SELECT account, CAST(assets AS DOUBLE) AS assets, coalesce(CAST(debt AS DOUBLE), 0) AS debt, round(CAST(assets AS DOUBLE) / nullif(CAST(debt AS DOUBLE), 0), 6) AS maintenance, CAST(round(g - coalesce(debt, 0), 2) AS DOUBLE) AS available FROM h LEFT JOIN d USING (account)""")
def a27_credit_metrics(t: Tables) -> DataFrame:
    held = t.holdings.where("month = 199806").withColumn("cost", F.col("quantity") * 1000)
    out = perf.credit_metrics(held, t.debts, "account")
    return out.select("account", F.col("assets").cast("double").alias("assets"), F.col("debt").cast("double").alias("debt"), F.round("maintenance", 6).alias("maintenance"), F.round("available", 2).cast("double").alias("available"))


@query("""SELECT h.account, h.code, h.side, coalesce(e.reason, 'none') AS reason, e.reason IS NULL AS complete FROM {holdings} h LEFT JOIN (SELECT account, max(reason) AS reason FROM {tickets} k WHERE status = 'rejected' GROUP BY 1) e USING (account) WHERE month = (SELECT max(month) FROM {holdings} x)""")
def a28_unliquidated(t: Tables) -> DataFrame:
    why = t.tickets.where("status = 'rejected'").groupBy("account").agg(F.max("reason").alias("reason"))
    last = t.holdings.agg(F.max("month").alias("month"))
    left = t.holdings.join(F.broadcast(last), "month", "left_semi").join(why, "account", "left")
    return left.select("account", "code", "side", F.coalesce("reason", F.lit("none")).alias("reason"), F.col("reason").isNull().alias("complete"))


@query("SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS tokens FROM events GROUP BY 1")
def a29_trace_totals(t: Tables) -> DataFrame:
    parsed = t.events.select("event_type", F.from_json("props", "k long")["k"].alias("k"))
    return parsed.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("k").alias("tokens"))


@query("SELECT account, CASE WHEN sum(CASE WHEN status = 'filled' THEN 1 ELSE 0 END) = 0 THEN 'no_trades' WHEN count(*) FILTER (status = 'rejected') * 5 > count(*) THEN 'many_rejects' ELSE 'fine' END AS warning FROM {tickets} k GROUP BY account")
def a32_replay_diagnostics(t: Tables) -> DataFrame:
    c = perf.status_counts(t.tickets, "account", "status", ["filled", "rejected"])
    return c.select("account", F.when(F.col("filled") == 0, "no_trades").when(F.col("rejected") * 5 > F.col("total"), "many_rejects").otherwise("fine").alias("warning"))


@query("""WITH e AS (SELECT o_orderkey AS version, o_custkey AS code, o_orderkey % 3 AS event, strftime(date_trunc('quarter', o_orderdate) + INTERVAL 2 MONTH, '%Y%m%d') AS ex_date, strftime(o_orderdate, '%Y%m%d') AS ann_date, CASE WHEN o_orderstatus = 'O' THEN 'plan' ELSE 'done' END AS state, floor(o_totalprice) / 100 - 50 AS cash, CASE WHEN o_orderkey % 4 > 0 THEN (o_orderkey % 4) / 8.0 END AS stock FROM orders),
    k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY code, event, ex_date ORDER BY ann_date DESC, version DESC) AS r FROM e WHERE ex_date BETWEEN '19960101' AND '19991231' AND ann_date <= ex_date AND state = 'done') x WHERE r = 1)
    SELECT code, ex_date, round(sum(greatest(cash, 0)), 2) AS cash, sum(coalesce(stock, 0)) AS stock, min(ann_date) AS first_announced FROM k GROUP BY 1, 2""")
def a1_corporate_actions(t: Tables) -> DataFrame:
    ex = F.date_format(F.add_months(F.date_trunc("quarter", F.col("o_orderdate")).cast("date"), 2), "yyyyMMdd")
    e = t.orders.select(F.col("o_orderkey").alias("version"), F.col("o_custkey").alias("code"), (F.col("o_orderkey") % 3).alias("event"), ex.alias("ex_date"), F.date_format("o_orderdate", "yyyyMMdd").alias("ann_date"),
        F.when(F.col("o_orderstatus") == "O", "plan").otherwise("done").alias("state"), (F.floor("o_totalprice") / 100 - 50).alias("cash"), F.when(F.col("o_orderkey") % 4 > 0, (F.col("o_orderkey") % 4) / 8.0).alias("stock"))
    out = perf.corporate_actions(e, "19960101", "19991231")
    return out.select("code", "ex_date", F.round("cash", 2).alias("cash"), "stock", "first_announced")


_IMPLEMENTED = """p AS (SELECT ts_code, end_date, trim(ex_date) AS ex_date, available_at, try_cast(cash_div_tax AS DOUBLE) AS gross, try_cast(cash_div AS DOUBLE) AS net, stk_div, stk_bo_rate, stk_co_rate, cash_div_tax, cash_div, coalesce(record_date, '') AS record_date, pay_date, coalesce(div_listdate, '') AS div_listdate,
    replace(substr(available_at, 1, 10), '-', '') > trim(ex_date) AS late FROM {payouts} o WHERE div_proc = '实施')"""


@query(f"""WITH {_IMPLEMENTED}, one AS (SELECT *, greatest(coalesce(gross, net, 0), 0) AS cash, greatest(coalesce(CAST(stk_div AS DOUBLE), coalesce(CAST(stk_bo_rate AS DOUBLE), 0) + coalesce(CAST(stk_co_rate AS DOUBLE), 0)), 0) AS stock FROM p WHERE ex_date BETWEEN '19930601' AND '19971231' AND NOT late
    QUALIFY row_number() OVER (PARTITION BY ts_code, end_date, ex_date ORDER BY available_at DESC, cash_div_tax DESC NULLS LAST, cash_div DESC NULLS LAST, stk_div DESC NULLS LAST, stk_bo_rate DESC NULLS LAST, stk_co_rate DESC NULLS LAST, record_date DESC, pay_date DESC, div_listdate DESC) = 1)
    SELECT ts_code, ex_date, sum(cash) AS cash_per_share, sum(stock) AS stock_per_share, arg_min(record_date, (available_at, end_date)) AS record_date, arg_min(pay_date, (available_at, end_date)) AS pay_date, max(div_listdate) AS div_listdate FROM one WHERE cash > 0 OR stock > 0 GROUP BY 1, 2""")
def a1_ex_date_actions(t: Tables) -> DataFrame:
    return actions.corporate_actions(t.payouts, "19930601", "19971231")


@query(f"WITH {_IMPLEMENTED} SELECT count(*) FILTER (ex_date = '') AS missing_ex_date, count(*) FILTER (ex_date BETWEEN '19930601' AND '19971231' AND late) AS announced_after_ex_date FROM p")
def a1_dropped_actions(t: Tables) -> DataFrame:
    return actions.dropped_actions(t.payouts, "19930601", "19971231")


_BOARD = "CASE substr(ts_code, 1, 2) WHEN '00' THEN 'sz_main_00' WHEN '30' THEN 'sz_gem_30' WHEN '60' THEN 'sh_main_60' WHEN '68' THEN 'sh_star_68' ELSE 'bj' END"
_SPREAD = "count(*) AS matched, count(v) AS n, round(quantile_cont(v, 0.1), 6) AS p10, round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.9), 6) AS p90"


def _rounded_spread(out: DataFrame) -> DataFrame:
    return out.select("month", "bucket", "ratio", "matched", "n", *(F.round(c, 6).alias(c) for c in ("p10", "median", "p90")))


@query(f"""WITH m AS (SELECT month, {_BOARD} AS bucket, b.vol / nullif(a.vol, 0) AS v1, b.amount / nullif(a.amount, 0) AS v2, CASE substr(ts_code, 1, 2) WHEN '00' THEN 0.76::DOUBLE WHEN '30' THEN 0.58::DOUBLE ELSE 1 END AS f FROM {{month_bars}} b JOIN {{auctions}} a USING (month, ts_code) WHERE trade_time = '09:30'),
    r AS (SELECT month, bucket, 'vol' AS ratio, v1 AS v FROM m UNION ALL SELECT month, bucket, 'amount', v2 FROM m UNION ALL SELECT month, bucket, 'vol_after_factor', v1 * f FROM m UNION ALL SELECT month, bucket, 'amount_after_factor', v2 * f FROM m)
    SELECT month, bucket, ratio, {_SPREAD} FROM r GROUP BY 1, 2, 3""")
def j10_auction_ratios(t: Tables) -> DataFrame:
    return _rounded_spread(actions.auction_alignment(t.month_bars, t.auctions, "month", "ts_code", "trade_time"))


@query(f"""WITH s AS (SELECT month, ts_code, sum(vol) AS vol, sum(amount) AS amount FROM {{month_bars}} b GROUP BY 1, 2), m AS (SELECT month, {_BOARD} AS bucket, s.vol / nullif(d.vol, 0) AS v1, s.amount / nullif(d.amount, 0) AS v2 FROM s JOIN {{month_rows}} d USING (month, ts_code)),
    r AS (SELECT month, bucket, 'vol' AS ratio, v1 AS v FROM m UNION ALL SELECT month, bucket, 'amount', v2 FROM m) SELECT month, bucket, ratio, {_SPREAD} FROM r GROUP BY 1, 2, 3""")
def j10_daily_ratios(t: Tables) -> DataFrame:
    return _rounded_spread(actions.daily_alignment(t.month_bars, t.month_rows, "month", "ts_code"))

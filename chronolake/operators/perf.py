"""Performance statistics of equity series, positions and orders; every statistic is one grouped pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ranks import percentiles
from .windows import keep_one, returns

YEAR = 244  # trading days (fixed value)


def return_stats(series: DataFrame, key: str, order: str, value: str, initial: Column, year: int = YEAR) -> DataFrame:
    """Total and annualised return (-1 once all is lost), Sharpe (sample deviation; 0 without spread), deepest drawdown from a day-0 baseline."""
    r = returns(series, key, order, value, initial)
    total = F.max_by(F.col(value), order) / F.first(initial) - 1
    n = F.count("*")
    sd = F.stddev_samp("ret")
    return r.groupBy(key).agg(
        total.alias("total_return"), F.when(total > -1, F.pow(1 + total, year / n) - 1).otherwise(-1.0).alias("annual_return"),
        F.when(sd > 0, F.avg("ret") / sd * F.sqrt(F.lit(float(year)))).otherwise(0.0).alias("sharpe"), F.least(F.min("drawdown"), F.lit(0.0)).alias("max_drawdown"), n.alias("periods"),
    )


def trade_stats(events: DataFrame, key: str, initial: Column) -> DataFrame:
    """Per account: closed and reduced positions and the share of them that won, results by side with their dividends, turnover and fees.

    ``events`` has ``kind``, ``side``, ``amount`` (realised result, or dividend), ``notional`` and ``fee``. Dividends count for their
    side, never as trades.
    """
    closed = F.col("kind").isin("position_closed", "position_reduced")
    side = lambda s: (F.coalesce(F.sum(F.when((F.col("side") == s) & (closed | (F.col("kind") == "dividend_cash")), F.col("amount"))), F.lit(0)) / F.first(initial)).alias(f"{s}_return")
    return events.groupBy(key).agg(
        F.count_if(closed).alias("trades"), F.count_if(F.col("kind") == "position_closed").alias("full_closes"), F.coalesce(F.try_divide(F.count_if(closed & (F.col("amount") > 0)), F.count_if(closed)), F.lit(0.0)).alias("win_rate"),
        side("long"), side("short"), (F.sum("notional") / F.first(initial)).alias("turnover"), F.sum("fee").alias("fees"),
    )


def regression(pairs: DataFrame, key: str, y: str, x: str, year: int = YEAR, least: int = 8) -> DataFrame:
    """β, yearly α, R² and the compounded benchmark of matched returns; null under ``least`` pairs."""
    n = F.count("*")
    var, cov = F.var_pop(x), F.covar_pop(y, x)
    beta = F.when((n >= least) & (var > 0), cov / var)
    alpha = (F.avg(y) - beta * F.avg(x)) * year
    r2 = F.when((n >= least) & (var > 0) & (F.var_pop(y) > 0), cov * cov / (var * F.var_pop(y)))
    return pairs.groupBy(key).agg(n.alias("n"), F.round(beta, 3).alias("beta"), F.round(alpha, 4).alias("alpha"), F.round(r2, 3).alias("r2"), F.round(F.product(1 + F.col(x)) - 1, 6).alias("benchmark"))


def moments(pairs: DataFrame, by: Sequence[str], y: str, x: str) -> DataFrame:
    """(by, n, mean_y, mean_x, yy, xx, yx): what a regression needs of the complete pairs of each group; ``merged`` adds such states without their rows.

    Sums of squares and products are taken around the group's own means, so that merging loses no digits to large means.
    """
    both = pairs.where(F.col(y).isNotNull() & F.col(x).isNotNull())
    n = F.count("*")
    return both.groupBy(*by).agg(n.alias("n"), F.avg(y).alias("mean_y"), F.avg(x).alias("mean_x"), (F.var_pop(y) * n).alias("yy"), (F.var_pop(x) * n).alias("xx"), (F.covar_pop(y, x) * n).alias("yx"))


def merged(states: DataFrame, by: Sequence[str]) -> DataFrame:
    """The state of all rows behind ``states`` of disjoint rows, per group; merging in any order or in steps gives the same up to rounding."""
    weighted = lambda c: (F.sum(F.col("n") * F.col(c)) / F.sum("n")).alias(f"_{c}")
    means = states.groupBy(*by).agg(F.sum("n").alias("_n"), weighted("mean_y"), weighted("mean_x"))
    dy, dx = F.col("mean_y") - F.col("_mean_y"), F.col("mean_x") - F.col("_mean_x")
    return states.join(means, list(by)).groupBy(*by).agg(
        F.sum("n").alias("n"), F.first("_mean_y").alias("mean_y"), F.first("_mean_x").alias("mean_x"),
        F.sum(F.col("yy") + F.col("n") * dy * dy).alias("yy"), F.sum(F.col("xx") + F.col("n") * dx * dx).alias("xx"), F.sum(F.col("yx") + F.col("n") * dy * dx).alias("yx"),
    )


def regression_of(states: DataFrame, year: int = YEAR, least: int = 8) -> DataFrame:
    """The regression of ``regression`` from merged states: n, β, yearly α and R², null under ``least`` pairs."""
    enough = (F.col("n") >= least) & (F.col("xx") > 0)
    beta = F.when(enough, F.col("yx") / F.col("xx"))
    r2 = F.when(enough & (F.col("yy") > 0), F.col("yx") * F.col("yx") / (F.col("xx") * F.col("yy")))
    return states.withColumns({"beta": F.round(beta, 3), "alpha": F.round((F.col("mean_y") - beta * F.col("mean_x")) * year, 4), "r2": F.round(r2, 3)}).drop("mean_y", "mean_x", "yy", "xx", "yx")


def chained_moments(windows: DataFrame, run: str, window: str, date: str, y: str, benchmark: DataFrame, x: str) -> DataFrame:
    """States of a run's windows: each date belongs to the first window, in order of ``window``, that has a value then; ``benchmark`` has a row a date."""
    first = keep_one(windows.where(F.col(y).isNotNull()).select(run, window, date, y), [run, date], [window], "first")
    return moments(first.join(benchmark.select(date, x), date), [run, window], y, x)


def weighted_by_days(stats: DataFrame, by: str, days: str, columns: Sequence[str]) -> DataFrame:
    """(by, days, columns): averages of windows merged by their days; windows without days or value do not count."""
    counted = lambda c: F.when(F.col(c).isNotNull(), F.col(days))
    return stats.where(F.col(days) > 0).groupBy(by).agg(F.sum(days).alias(days), *(F.try_divide(F.sum(F.col(c) * F.col(days)), F.sum(counted(c))).alias(c) for c in columns))


def cycle_stats(series: DataFrame, key: str, order: str, y: str, x: str, year: int) -> DataFrame:
    """Statistics of a whole cycle of periodic returns ``y``; what compares with the benchmark ``x`` uses matched periods (two at least).

    Return, volatility, Sharpe, drawdown and winning periods use every period. Both legs of the excess are compounded over the same periods.
    """
    own = W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    run = series.withColumn("_equity", F.product(1 + F.col(y)).over(own))
    run = run.withColumn("_fall", 1 - F.col("_equity") / F.greatest(F.lit(1.0), F.max("_equity").over(own)))
    both = lambda c: F.when(F.col(x).isNotNull(), c)
    n, total, sd = F.count("*"), F.product(1 + F.col(y)) - 1, F.stddev_samp(y)
    gap = both(F.col(y) - F.col(x))
    error, enough = F.stddev_samp(gap), F.count(x) >= 2
    legs = lambda c: F.product(both(1 + F.col(c)))
    rounded = {
        "cumulative": (total, 4), "annual_return": (F.when(total > -1, F.pow(1 + total, year / n) - 1).otherwise(-1.0), 4), "volatility": (F.coalesce(sd, F.lit(0.0)) * year**0.5, 4),
        "sharpe": (F.when(sd > 0, F.avg(y) / sd * year**0.5).otherwise(0.0), 4), "max_drawdown": (F.greatest(F.max("_fall"), F.lit(0.0)), 4), "win_rate": (F.count_if(F.col(y) > 0) / n, 4),
        "benchmark": (F.when(enough, legs(x) - 1), 4), "excess": (F.when(enough, legs(y) - legs(x)), 4), "beta": (F.when(enough & (F.var_pop(x) > 0), F.covar_pop(y, x) / F.var_pop(x)), 4),
        "tracking_error": (F.when(enough, error * year**0.5), 4), "information_ratio": (F.when(enough & (error > 0), F.avg(gap) / error * year**0.5), 4),
    }
    return run.groupBy(key).agg(n.alias("periods"), F.count(x).alias("matched"), *(F.round(c, d).alias(name) for name, (c, d) in rounded.items()))


def signed(value: str = "market_value", side: str = "side") -> Column:
    return F.when(F.col(side) == "short", -F.col(value)).otherwise(F.col(value))


def exposure(positions: DataFrame, equity: DataFrame, key: str, date: str, value: str) -> DataFrame:
    """Per account: average and highest gross exposure, the average of its long and of its short leg, and the dates without positions; every equity date counts."""
    leg = lambda short: F.sum(F.when((F.col("side") == "short") == F.lit(short), F.abs("market_value")))
    gross = positions.groupBy(key, date).agg(F.sum(F.abs("market_value")).alias("gross"), leg(False).alias("_long"), leg(True).alias("_short"))
    share = lambda c: F.coalesce(F.col(c) / F.col(value), F.lit(0.0))
    daily = equity.join(gross, [key, date], "left").withColumn("exposure", share("gross"))
    return daily.groupBy(key).agg(F.avg("exposure").alias("average"), F.max("exposure").alias("highest"), F.avg(share("_long")).alias("long"), F.avg(share("_short")).alias("short"), F.count_if(F.col("gross").isNull()).alias("zero_dates"))


def order_stats(orders: DataFrame, codes: int = 8, reasons: int = 6) -> DataFrame:
    """(what, name, n, amount): orders by action and by account, filled orders and amounts by day, the top codes by amount and the top reasons by count.

    ``orders`` has action, account, code, reason, status, day and amount.
    """
    counted = lambda df, what, by: df.groupBy(F.lit(what).alias("what"), F.col(by).cast("string").alias("name")).agg(F.count("*").alias("n"), F.sum("amount").alias("amount"))
    named = lambda df, what: df.select(F.lit(what).alias("what"), "name", "n", "amount")
    by_code = orders.where("code is not null").groupBy(F.col("code").alias("name")).agg(F.count("*").alias("n"), F.sum("amount").alias("amount")).orderBy(F.col("amount").desc(), "name").limit(codes)
    by_reason = orders.where("reason is not null").groupBy(F.col("reason").alias("name")).agg(F.count("*").alias("n"), F.sum("amount").alias("amount")).orderBy(F.col("n").desc(), "name").limit(reasons)
    out = counted(orders, "action", "action").unionByName(counted(orders, "account", "account")).unionByName(counted(orders.where("status = 'filled'"), "day", "day"))
    return out.unionByName(named(by_code, "code")).unionByName(named(by_reason, "reason"))


def style_exposure(positions: DataFrame, ranks: DataFrame, date: str, code: str, columns: dict[str, str], key: str) -> DataFrame:
    """Tilts: the weighted distance of each rank from the middle, by date, then averaged."""
    gross = F.sum(F.abs("market_value")).over(W.partitionBy(key, date))
    joined = positions.withColumn("_w", signed() / gross).join(ranks, [date, code])
    daily = joined.groupBy(key, date).agg(*(F.sum(F.col("_w") * (F.col(c) - 0.5) * 2).alias(n) for n, c in columns.items()))
    return daily.groupBy(key).agg(*(F.avg(n).alias(n) for n in columns))


def status_counts(orders: DataFrame, group: str, status: str, statuses: list[str]) -> DataFrame:
    return orders.groupBy(group).agg(F.count("*").alias("total"), *(F.count_if(F.col(status) == s).alias(s) for s in statuses))


def active_return(records: DataFrame, epoch: str, y: str, x: str) -> DataFrame:
    """(epoch, active): the compounded active return of complete pairs."""
    both = F.col(y).isNotNull() & F.col(x).isNotNull()
    up = lambda c: F.product(F.when(both, 1 + F.col(c)))
    return records.groupBy(epoch).agg((up(y) / up(x) - 1).alias("active"))


def fold_report(records: DataFrame, epoch: str, y: str, x: str) -> DataFrame:
    """Per epoch: mean, exact median, deviation, worst, positive share, t of the returns, and the compounded active return of complete pairs."""
    n, sd = F.count(y), F.stddev_samp(y)
    sums = records.groupBy(epoch).agg(
        n.alias("folds"), F.avg(y).alias("mean"), sd.alias("std"), F.min(y).alias("worst"), F.try_divide(F.count_if(F.col(y) > 0), n).alias("positive"), F.when((n >= 2) & (sd > 0), F.avg(y) / (sd / F.sqrt(n))).alias("t"),
    )
    return sums.join(percentiles(records, [epoch], y, {"median": 0.5}).drop("n"), epoch, "left").join(active_return(records, epoch, y, x), epoch, "left")


def corporate_actions(events: DataFrame, first: str, last: str) -> DataFrame:
    """Implemented payouts by (code, ex_date): announced by then, the latest version of each event, cash and stock clipped at zero and summed."""
    kept = events.where(F.col("ex_date").between(first, last) & (F.col("ann_date") <= F.col("ex_date")) & (F.col("state") == "done"))
    newest = W.partitionBy("code", "event", "ex_date").orderBy(F.col("ann_date").desc(), F.col("version").desc())
    one = kept.withColumn("_r", F.row_number().over(newest)).where("_r = 1")
    return one.groupBy("code", "ex_date").agg(F.sum(F.greatest(F.coalesce("cash", F.lit(0.0)), F.lit(0.0))).alias("cash"), F.sum(F.greatest(F.coalesce("stock", F.lit(0.0)), F.lit(0.0))).alias("stock"), F.min("ann_date").alias("first_announced"))


def credit_metrics(positions: DataFrame, debts: DataFrame, key: str, haircut: float = 0.7) -> DataFrame:
    """Maintenance ratio and available margin: gains count by ``haircut``, losses in full. Money is summed as decimals, so no order of tasks shows."""
    money = lambda c: c.cast("decimal(18,2)")
    part = F.lit(haircut).cast("decimal(3,2)")
    worth = money(signed())
    gain = worth - money(F.col("cost"))
    held = positions.groupBy(key).agg(F.sum(worth).alias("assets"), F.sum(F.when(gain > 0, gain * part).otherwise(gain * F.lit(1).cast("decimal(3,2)"))).alias("margin_gain"))
    owed = debts.groupBy(key).agg(F.sum(money(F.col("principal")) + money(F.col("interest"))).alias("debt"))
    out = held.join(owed, key, "left").withColumn("debt", F.coalesce("debt", money(F.lit(0))))
    return out.withColumn("maintenance", F.try_divide(F.col("assets").cast("double"), F.col("debt").cast("double"))).withColumn("available", F.col("margin_gain") - F.col("debt"))

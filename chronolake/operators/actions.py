"""Corporate actions by ex-date, and the alignment of opening auctions and minute sums with their sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.market import AUCTION_FACTORS, bucket
from .ranks import percentiles

#: State of a payout that is carried out (fixed value).
IMPLEMENTED = "实施"


def _day(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))


def _number(c: str) -> Column:
    return F.col(c).cast("string").try_cast("double")


def _announced() -> Column:
    return F.regexp_replace(F.substring(F.col("available_at").cast("string"), 1, 10), "-", "")


def _implemented(events: DataFrame) -> DataFrame:
    dates = {c: _day(c) for c in ("ex_date", "record_date", "pay_date", "div_listdate")}
    return events.where(F.col("div_proc") == IMPLEMENTED).withColumns(dates).withColumn("_late", F.coalesce(_announced() > F.col("ex_date"), F.lit(False)))


def corporate_actions(events: DataFrame, first: str, last: str) -> DataFrame:
    """One row per (ts_code, ex_date) of implemented payouts with ``first <= ex_date <= last``, announced by their ex-date.

    Of an event (code, end_date, ex_date) the latest announced version counts; among versions of one stamp the largest in its other columns. Cash is gross, else net,
    else nothing; stock is the combined ratio, else the sum of its two parts; both at least zero, and an event without either is left out. Events of one day
    are summed; record and pay date are those of the event announced first, the listing date is the last. Unreadable numbers count as missing, blank dates are empty.
    """
    rows = _implemented(events).where(F.col("ex_date").between(first, last) & ~F.col("_late"))
    others = ("cash_div_tax", "cash_div", "stk_div", "stk_bo_rate", "stk_co_rate", "record_date", "pay_date", "div_listdate")
    newest = W.partitionBy("ts_code", "end_date", "ex_date").orderBy(F.col("available_at").desc(), *(F.col(c).desc() for c in others))
    one = rows.withColumn("_r", F.row_number().over(newest)).where("_r = 1")
    nothing = F.lit(0.0)
    known = lambda c: F.nanvl(_number(c), F.lit(None).cast("double"))
    cash = F.greatest(F.coalesce(known("cash_div_tax"), known("cash_div"), nothing), nothing)
    stock = F.greatest(F.coalesce(known("stk_div"), F.coalesce(known("stk_bo_rate"), nothing) + F.coalesce(known("stk_co_rate"), nothing)), nothing)
    paid = one.withColumns({"cash_per_share": cash, "stock_per_share": stock}).where("cash_per_share > 0 or stock_per_share > 0")
    early = F.struct("available_at", "end_date")
    return paid.groupBy("ts_code", "ex_date").agg(
        F.sum("cash_per_share").alias("cash_per_share"), F.sum("stock_per_share").alias("stock_per_share"),
        F.min_by("record_date", early).alias("record_date"), F.min_by("pay_date", early).alias("pay_date"), F.max("div_listdate").alias("div_listdate"),
    )


def dropped_actions(events: DataFrame, first: str, last: str) -> DataFrame:
    """One row: implemented payouts without an ex-date, and those in the range that were announced only after it."""
    rows, inside = _implemented(events), F.col("ex_date").between(first, last)
    return rows.agg(F.count_if(F.col("ex_date") == "").alias("missing_ex_date"), F.count_if(inside & F.col("_late")).alias("announced_after_ex_date"))


def _factor(code: str) -> Column:
    out = F.lit(1.0)
    for name, f in AUCTION_FACTORS.items():
        out = F.when(bucket(code) == name, F.lit(f)).otherwise(out)
    return out


def _long(ratios: DataFrame, day: str, code: str, names: list[str]) -> DataFrame:
    placed = ratios.select(day, bucket(code).alias("bucket"), *names)
    matched = placed.groupBy(day, "bucket").agg(F.count("*").alias("matched"))
    stats = percentiles(placed.unpivot([day, "bucket"], names, "ratio", "_v").where("_v is not null"), [day, "bucket", "ratio"], "_v", {"p10": 0.1, "median": 0.5, "p90": 0.9})
    measures = ratios.sparkSession.createDataFrame([(n,) for n in names], "ratio string")
    every = matched.join(F.broadcast(measures))  # two or four rows a group
    return every.join(stats, [day, "bucket", "ratio"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def auction_alignment(minutes: DataFrame, auction: DataFrame, day: str, code: str, time: str) -> DataFrame:
    """Per (day, board, ratio): matched codes, ratios and their exact percentiles, of the opening bar to the auction, as they are and times the board's factor.

    ``minutes`` and ``auction`` have ``vol`` and ``amount``; bars and auctions of one key each meet all of the other's. A ratio to nothing is null; a board of none has null percentiles.
    """
    opening = minutes.where(F.col(time) == "09:30").select(day, code, F.col("vol").alias("_mv"), F.col("amount").alias("_ma"))
    met = opening.join(auction.select(day, code, F.col("vol").alias("_av"), F.col("amount").alias("_aa")), [day, code])
    raw = met.select(day, code, F.try_divide("_mv", "_av").alias("vol"), F.try_divide("_ma", "_aa").alias("amount"), _factor(code).alias("_f"))
    return _long(raw.select("*", (F.col("vol") * F.col("_f")).alias("vol_after_factor"), (F.col("amount") * F.col("_f")).alias("amount_after_factor")), day, code, ["vol", "amount", "vol_after_factor", "amount_after_factor"])


def daily_alignment(minutes: DataFrame, daily: DataFrame, day: str, code: str) -> DataFrame:
    """The same of the sums of a day's minutes to its daily row."""
    sums = minutes.groupBy(day, code).agg(F.sum("vol").alias("_mv"), F.sum("amount").alias("_ma"))
    met = sums.join(daily.select(day, code, F.col("vol").alias("_av"), F.col("amount").alias("_aa")), [day, code])
    return _long(met.select(day, code, F.try_divide("_mv", "_av").alias("vol"), F.try_divide("_ma", "_aa").alias("amount")), day, code, ["vol", "amount"])

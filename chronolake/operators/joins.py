"""Joins with point-in-time meaning: as-of, interval, keyed diff, coverage, fills."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.timecols import blank
from .windows import keep_one


def daily_join(daily: DataFrame, basics: DataFrame, limits: DataFrame, adjust: DataFrame | None, suspended: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Daily rows with basics, limits and adjustment; clashing columns of basics get ``_basic``; a flag for suspended keys."""
    clash = set(daily.columns) & set(basics.columns) - set(keys)
    out = daily.join(basics.withColumnsRenamed({c: f"{c}_basic" for c in clash}), list(keys), "left").join(limits, list(keys), "left")
    if adjust is not None:
        out = out.join(adjust, list(keys), "left")
    flags = suspended.select(*keys).distinct().withColumn("_s", F.lit(True))
    return out.join(flags, list(keys), "left").withColumn("is_suspended", F.col("_s").isNotNull()).drop("_s")


def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).where("rows > 1")


def listed_on(universe: DataFrame, code: str, start: str, end: str, day: Column) -> DataFrame:
    """One row per code that is listed on the day: ``start <= day < end``, an open end being null."""
    return keep_one(universe.where((F.col(start) <= day) & (F.col(end).isNull() | (day < F.col(end)))), [code], [start], "first")


def latest_as_of(df: DataFrame, key: Sequence[str], stamp: str, when: Column, ties: Sequence[str] = ()) -> DataFrame:
    """The last row of each key with ``stamp <= when``."""
    return keep_one(df.where(F.col(stamp) <= when), key, [stamp, *ties], "last")


def names_as_of(names: DataFrame, code: str, name: str, day: Column) -> DataFrame:
    """(code, name) in force on a ``YYYYMMDD`` day: begun and announced by then, or with no date of announcement; the latest beginning, then the largest name."""
    known = blank("ann_date") | (F.trim("ann_date") <= day)
    return keep_one(names.where(known & (F.trim("start_date") <= day)).select(code, name, "start_date"), [code], ["start_date", name], "last").drop("start_date")


def members_as_of(members: DataFrame, code: str, group: str, day: Column) -> DataFrame:
    """(code, group) of the stretch ``in_date <= day < out_date``, blank dates being open; of several the latest begun, then the largest group."""
    date = lambda c: F.when(blank(c), "").otherwise(F.trim(c))
    held = members.select(code, group, date("in_date").alias("in_date"), date("out_date").alias("out_date")).where((F.col("in_date") <= day) & ((F.col("out_date") == "") | (F.col("out_date") > day)))
    return keep_one(held, [code], ["in_date", group], "last").select(code, group)


def as_of(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, values: Sequence[str], block: Callable[[Column], Column] | None = None) -> DataFrame:
    """Each left row with the last right values at or before its time: one ordered pass over both sides, no range join.

    ``block`` numbers stretches of time (it never falls as time rises): a key is then dealt by its blocks, so that a hot key is many
    tasks. Each block that has left rows begins with the last values of the blocks before it, found over one row per block. Right rows of one
    time should agree. Left rows without key or time get no values.
    """
    at = block or (lambda t: F.lit(0))
    payload = F.struct(*values)
    a = left.select(F.col(key).alias("_k"), F.col(left_time).alias("_t"), at(F.col(left_time)).alias("_b"), F.lit(2).alias("_side"), F.struct("*").alias("_row"))
    b = right.select(F.col(key).alias("_k"), F.col(right_time).alias("_t"), at(F.col(right_time)).alias("_b"), F.lit(1).alias("_side"), payload.alias("_value")).where("_k is not null and _t is not null")
    both = a.unionByName(b, allowMissingColumns=True)
    if block is not None:
        ends = b.groupBy("_k", "_b").agg(F.max_by("_value", "_t").alias("_value"))
        wanted = a.where("_k is not null and _t is not null").select("_k", "_b").distinct().withColumn("_asked", F.lit(True))
        before = F.last("_value", ignorenulls=True).over(W.partitionBy("_k").orderBy("_b").rowsBetween(W.unboundedPreceding, -1))  # a row a block
        carried = ends.join(wanted, ["_k", "_b"], "full_outer").withColumn("_value", before).where("_asked and _value is not null")
        both = both.unionByName(carried.select("_k", "_b", F.lit(0).alias("_side"), "_value"), allowMissingColumns=True)
    upto = W.partitionBy("_k", "_b").orderBy(F.col("_side") > 0, "_t", "_side").rowsBetween(W.unboundedPreceding, 0)
    found = both.withColumn("_value", F.last("_value", ignorenulls=True).over(upto)).where("_side = 2")
    return found.select("_row.*", *(F.when(F.col("_k").isNotNull() & F.col("_t").isNotNull(), F.col(f"_value.{v}")).alias(v) for v in values))


def keyed_diff(old: DataFrame, new: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Keys by change: added, removed, changed (with the changed columns) or same; values compare null-safely."""
    a = old.select(*keys, F.struct(*columns).alias("_a"))
    b = new.select(*keys, F.struct(*columns).alias("_b"))
    joined = a.join(b, list(keys), "full_outer")
    changed = F.array_compact(F.array(*(F.when(~F.col(f"_a.{c}").eqNullSafe(F.col(f"_b.{c}")), F.lit(c)) for c in columns)))
    kind = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.size(changed) > 0, "changed").otherwise("same")
    return joined.select(*keys, kind.alias("change"), F.when(kind == "changed", changed).otherwise(F.array().cast("array<string>")).alias("columns"), "_a", "_b")


def coverage_diff(left: DataFrame, right: DataFrame, day: str, key: str) -> DataFrame:
    """Per day the keys on one side only, and on both."""
    a, b = left.select(day, key).distinct().withColumn("_l", F.lit(1)), right.select(day, key).distinct().withColumn("_r", F.lit(1))
    both = a.join(b, [day, key], "full_outer")
    return both.groupBy(day).agg(F.count_if(F.col("_r").isNull()).alias("left_only"), F.count_if(F.col("_l").isNull()).alias("right_only"), F.count_if(F.col("_l").isNotNull() & F.col("_r").isNotNull()).alias("matched"))


def expected_vs_present(expected: DataFrame, present: DataFrame, keys: Sequence[str]) -> DataFrame:
    e, p = expected.select(*keys).distinct(), present.select(*keys).distinct()
    return e.join(p, list(keys), "left_anti").withColumn("state", F.lit("missing")).unionByName(p.join(e, list(keys), "left_anti").withColumn("state", F.lit("unexpected")))


def daily_fallback(daily: DataFrame, minutes: DataFrame, day: str = "trade_date", code: str = "ts_code") -> DataFrame:
    """Minutes and, for codes without a bar at the open or the close, bars made of the daily row; the opening one has no volume."""
    bar = lambda minute, price, vol: daily.select(day, code, F.lit(minute).alias("trade_time"), F.col(price).alias("price"), vol.alias("vol"), F.lit(True).alias("synthetic"))
    made = bar("09:30", "open", F.lit(None).cast("double")).unionByName(bar("15:00", "close", F.col("vol").cast("double")))
    fresh = made.join(minutes.select(day, code, "trade_time").distinct(), [day, code, "trade_time"], "left_anti")
    return minutes.select(day, code, "trade_time", "price", F.col("vol").cast("double").alias("vol")).withColumn("synthetic", F.lit(False)).unionByName(fresh)


def entitlement(positions: DataFrame, actions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cash (net for longs, gross owed by shorts), bonus shares and the rebased price of overnight positions on their ex-date."""
    out = positions.join(actions, list(keys))
    cash = F.when(F.col("side") == "long", F.col("quantity") * F.col("cash") * 0.9).otherwise(-F.col("quantity") * F.col("cash"))
    return out.withColumn("paid", cash).withColumn("bonus", F.floor(F.col("quantity") * F.col("ratio"))).withColumn("rebased", (F.col("price") - F.col("cash")) / (1 + F.col("ratio")))


def active_years(universe: DataFrame, start: str, end: str, first: int, last: int) -> DataFrame:
    """Each row once per year of its interval's overlap with [first, last]."""
    lo, hi = F.greatest(F.year(start), F.lit(first)), F.least(F.coalesce(F.year(end), F.lit(last)), F.lit(last))
    return universe.where(lo <= hi).withColumn("year", F.explode(F.sequence(lo, hi)))


def first_touch(orders: DataFrame, bars: DataFrame, key: Sequence[str], block: Callable[[Column], Column]) -> DataFrame:
    """The first bar at or after activation that trades strictly through the limit, or opens at or inside it.

    ``block`` numbers stretches of time. The extremes of each (key, block) say which later blocks touch an order's limit, so an order meets one
    row a block and then the bars of two blocks at most: its own and the first later one that touches. Bars are dealt by key and block, so no
    key is one task.
    """
    buy = F.col("action") == "entry"
    through = lambda low, high, down, up: F.when(buy, (F.col(low) < F.col("limit")) | (F.col(down) <= F.col("limit"))).otherwise((F.col(high) > F.col("limit")) | (F.col(up) >= F.col("limit")))
    dealt = bars.withColumn("_b", block(F.col("bar_ts")))
    placed = orders.withColumn("_own", block(F.col("active_ts")))
    extremes = dealt.groupBy(*key, "_b").agg(F.min("low").alias("_low"), F.max("high").alias("_high"), F.min("open").alias("_down"), F.max("open").alias("_up"))
    later = placed.join(extremes, list(key)).where((F.col("_b") > F.col("_own")) & through("_low", "_high", "_down", "_up")).groupBy("order_id").agg(F.min("_b").alias("_later"))
    tried = placed.join(later, "order_id", "left").withColumn("_b", F.explode(F.array_compact(F.array("_own", "_later"))))
    price = F.when(buy, F.least("open", "limit")).otherwise(F.greatest("open", "limit"))
    met = tried.join(dealt, [*key, "_b"]).where((F.col("bar_ts") >= F.col("active_ts")) & through("low", "high", "open", "open"))
    return met.groupBy("order_id").agg(F.min("bar_ts").alias("filled_at"), F.min_by(price, "bar_ts").alias("fill_price"))

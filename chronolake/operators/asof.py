"""Visibility by refresh nodes, period arithmetic and walk-forward schedules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _runs(nodes: DataFrame, when: Column, first: int, last: int) -> DataFrame:
    """Each node's refreshes around ``when``: (…, when, start, ready) for days ``first`` to ``last`` on which it is active.

    A node has dataset, start_minute, minutes (duration) and weekdays (array of 0 = Monday to 6).
    """
    days = nodes.withColumn("when", when).withColumn("_day", F.explode(F.transform(F.sequence(F.lit(first), F.lit(last)), lambda k: F.date_add(F.col("when").cast("date"), k))))
    active = days.where(F.array_contains("weekdays", F.weekday("_day")))
    start = F.col("_day").cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("start_minute"))
    return active.withColumn("start", start).withColumn("ready", F.col("start") + F.make_dt_interval(mins=F.col("minutes")))


def refresh_cutoff(nodes: DataFrame, when: Column) -> DataFrame:
    """(dataset, cutoff): the start of the latest refresh that has completed by ``when``, ten days back at most; ready exactly then counts."""
    return _runs(nodes, when, -10, 0).where("ready <= when").groupBy("dataset").agg(F.max("start").alias("cutoff"))


def next_boundary(nodes: DataFrame, when: Column) -> DataFrame:
    """(dataset, boundary): the earliest strictly later completion."""
    return _runs(nodes, when, -1, 10).where("ready > when").groupBy("dataset").agg(F.min("ready").alias("boundary"))


def refresh_grid(nodes: DataFrame, first: Column, days: int) -> DataFrame:
    """(dataset, start, ready): every refresh of each node in ``days`` days from ``first`` on."""
    return _runs(nodes, first, 0, days - 1).select("dataset", "start", "ready")


def visible(frozen: DataFrame, replay: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Frozen rows always; replay rows up to their dataset's cutoff, none without one. ``cutoffs`` has a row per dataset."""
    shown = replay.join(cutoffs, "dataset").where(F.col("available_at") <= F.col("cutoff")).drop("cutoff")
    return frozen.unionByName(shown, allowMissingColumns=True)


def period_start(label: Column) -> Column:
    """The first day of ``YYYY-Www`` (ISO), ``YYYY-MM``, ``YYYYQn`` or ``YYYYMMDD..YYYYMMDD``."""
    year = F.substring(label, 1, 4).try_cast("int")
    week = F.date_add(F.date_trunc("week", F.make_date(year, F.lit(1), F.lit(4))).cast("date"), (F.substring(label, 7, 2).try_cast("int") - 1) * 7)
    quarter = F.make_date(year, F.substring(label, 6, 1).try_cast("int") * 3 - 2, F.lit(1))
    month = F.make_date(year, F.substring(label, 6, 2).try_cast("int"), F.lit(1))
    plain = F.try_to_timestamp(F.substring(label, 1, 8), F.lit("yyyyMMdd")).cast("date")
    return F.when(label.contains(".."), plain).when(label.rlike(r"^\d{4}-W\d\d$"), week).when(label.rlike(r"^\d{4}Q[1-4]$"), quarter).when(label.rlike(r"^\d{4}-\d\d$"), month)


def period_end(label: Column) -> Column:
    start = period_start(label)
    plain = F.try_to_timestamp(F.substring(label, 11, 8), F.lit("yyyyMMdd")).cast("date")
    return F.when(label.contains(".."), plain).when(label.contains("W"), F.date_add(start, 6)).when(label.contains("Q"), F.last_day(F.add_months(start, 2))).otherwise(F.last_day(start))


def previous_days(calendar: DataFrame, day: str) -> DataFrame:
    """Each calendar day with the open day before it; the calendar is one small table."""
    return calendar.withColumn("previous", F.lag(day).over(W.orderBy(day)))


def fold_schedule(calendar: DataFrame, day: str, months: int) -> DataFrame:
    """Walk-forward folds by month: input window, validation (the month before), test month; two open days each at least."""
    monthly = calendar.select(F.trunc(F.to_date(day, "yyyyMMdd"), "month").alias("m"), F.col(day).alias("d")).groupBy("m").agg(F.min("d").alias("first"), F.max("d").alias("last"), F.count("*").alias("days")).where("days >= 2")
    val = monthly.select(F.add_months("m", 1).alias("m"), F.col("first").alias("val_first"), F.col("last").alias("val_last"))
    folds = monthly.join(val, "m")
    return folds.select(F.date_format("m", "yyyyMM").alias("fold"), F.date_format(F.add_months("m", -1 - months), "yyyyMMdd").alias("input_first"), "val_first", "val_last", F.col("first").alias("test_first"), F.col("last").alias("test_last"))


def facts_by_fold(facts: DataFrame, day: str, folds: DataFrame, first: str, last: str) -> DataFrame:
    """Facts in each fold whose range holds them; a fact may be in several. ``folds`` has a row per month and is broadcast."""
    return facts.join(F.broadcast(folds), F.col(day).between(F.col(first), F.col(last)))

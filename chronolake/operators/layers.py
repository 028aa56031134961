"""Audits of stored layers: event partitions against their raw files, and days of minute bars against session and universe."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.timecols import to_cn_timestamp

#: Availability rules that an event may carry (fixed values).
ALLOWED_RULES = (
    "source:f_ann_date_or_ann_date",
    "source:f_ann_date_or_ann_date:ann_date",
    "source:ann_date",
    "source:imp_ann_date_or_ann_date",
    "source:imp_ann_date_or_ann_date:ann_date",
    "fallback_joined_statement_available_at",
    "source:ann_or_conservative_disclosure_date",
    "source:ann_or_conservative_disclosure_date:actual_date",
    "source:ann_or_conservative_disclosure_date:pre_date",
)
#: Datasets whose announcement date is their disclosure date, so that an earlier stamp is look-ahead (fixed values).
DISCLOSED_BY_ANNOUNCEMENT = ("forecast_vip", "express_vip")
#: Months and codes that a report names (fixed values); all are counted.
NAMED_MONTHS, NAMED_CODES = 24, 20

#: Counters that make a dataset's layer an error, and those that only warn.
_ERRORS = ("unparseable", "outside_window", "wrong_month", "wrong_dataset", "disallowed_rule", "backdated", "bad_row_id", "blank_path", "wrong_path", "missing_path", "hash_mismatch")
_WARNINGS = ("repeated_keys", "blank_hash")


def _text(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))


def months_between(first: str, last: str) -> list[str]:
    """``YYYYMM`` of each month from one ``YYYYMMDD`` to the other."""
    at, end, out = int(first[:4]) * 12 + int(first[4:6]) - 1, int(last[:4]) * 12 + int(last[4:6]) - 1, []
    while at <= end:
        out.append(f"{at // 12:04d}{at % 12 + 1:02d}")
        at += 1
    return out


def event_layer_audit(events: DataFrame, files: DataFrame, datasets: Sequence[str], first: str, last: str) -> DataFrame:
    """Per dataset: months present and missing, rows, thirteen counters of bad rows, and the severity they make.

    ``events`` has its folder as ``part_dataset`` and ``part_month`` beside its columns; only months of the window are read. ``files`` lists each
    raw file that exists once, with the digest that its side file records (null without one). A repeated key counts all its rows, within its folder. Null is blank.
    Paths are counted before they meet ``files``, and keys before they are summed, so no fact is joined and a hot file or key is one row a task.
    """
    months = months_between(first, last)
    at, own = to_cn_timestamp("available_at"), to_cn_timestamp(F.concat(_text("ann_date"), F.lit(" 00:00:00")))
    begin, end = (to_cn_timestamp(F.lit(f"{d} {t}")) for d, t in ((first, "00:00:00"), (last, "23:59:59")))
    flags = {
        "unparseable": at.isNull(),
        "outside_window": ~at.between(begin, end),
        "wrong_month": _text("available_month") != F.col("part_month"),
        "wrong_dataset": _text("dataset") != F.col("part_dataset"),
        "disallowed_rule": ~F.coalesce(F.col("available_at_rule").isin(*ALLOWED_RULES), F.lit(False)),
        "backdated": F.col("part_dataset").isin(*DISCLOSED_BY_ANNOUNCEMENT) & (at < own),
        "bad_row_id": _text("source_row_id").try_cast("double").isNull(),
    }
    kept = events.where(F.col("part_month").isin(*months) & F.col("part_dataset").isin(*datasets)).withColumn("part_month", F.col("part_month").cast("string"))
    per_key = kept.groupBy("part_dataset", "part_month", "dataset", "business_key", "available_at").agg(F.count("*").alias("rows"), *(F.count_if(c).alias(n) for n, c in flags.items()))
    per_month = per_key.groupBy("part_dataset", "part_month").agg(F.sum("rows").alias("rows"), *(F.sum(n).alias(n) for n in flags), F.sum(F.when(F.col("rows") > 1, F.col("rows")).otherwise(0)).alias("repeated_keys"))
    rows = per_month.groupBy("part_dataset").agg(F.count("*").alias("months"), F.array_sort(F.array_except(F.array(*map(F.lit, months)), F.collect_set("part_month"))).alias("_gone"), *(F.sum(n).alias(n) for n in ("rows", *flags, "repeated_keys")))

    per_file = kept.groupBy("part_dataset", "source_path", _text("source_hash").alias("_own")).agg(F.count("*").alias("_n"))
    known = files.select("source_path", F.trim(F.coalesce("source_hash", F.lit(""))).alias("_side"), F.lit(True).alias("_there"))
    met = per_file.join(known, "source_path", "left")
    sums = {
        "blank_hash": F.col("_own") == "",
        "hash_mismatch": (F.col("_own") != "") & (F.col("_side") != "") & (F.col("_own") != F.col("_side")),
        "blank_path": _text("source_path") == "",
        "wrong_path": ~F.array_contains(F.split(_text("source_path"), "/"), F.col("part_dataset")),
        "missing_path": F.col("_there").isNull(),
    }
    paths = met.groupBy("part_dataset").agg(*(F.sum(F.when(c, F.col("_n")).otherwise(0)).alias(n) for n, c in sums.items()))

    asked = events.sparkSession.createDataFrame([(d,) for d in datasets], "part_dataset string")
    out = asked.join(rows, "part_dataset", "left").join(paths, "part_dataset", "left")
    counters = [F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in ("months", "rows", *_ERRORS, *_WARNINGS)]
    out = out.select(F.col("part_dataset").alias("dataset"), F.coalesce("_gone", F.array(*map(F.lit, months))).alias("_gone"), *counters)
    bad = lambda names: F.greatest(*names) > 0
    severity = F.when(bad(_ERRORS), "error").when(bad(_WARNINGS) | (F.size("_gone") > 0), "warning").otherwise("info")
    return out.select("dataset", *(c for c in out.columns if c not in ("dataset", "_gone")), F.size("_gone").cast("long").alias("missing_months"), F.array_join(F.slice("_gone", 1, NAMED_MONTHS), ",").alias("named_months"), severity.alias("severity"))


def in_session(hhmm: Column) -> Column:
    """Opening auction and the minute bars of both sessions."""
    return (hhmm == "09:30") | hhmm.between("09:31", "11:30") | hhmm.between("13:00", "15:00")


def minute_day_audit(minutes: DataFrame, expected: DataFrame, day: str, code: str, least: int, allow_missing: int) -> DataFrame:
    """Per day of either side: rows, codes, times, bad rows by kind, codes missing and unexpected with the first names of each, and the verdict.

    ``day`` is the folder; ``trade_date`` inside the rows has to agree. ``expected`` has (day, code). Times outside the sessions are counted and do not fail a
    day; a day without rows fails by ``least`` and by its missing codes. Rows without a code count as rows, not as codes. A stamp may be blank.
    """
    hhmm = F.nullif(F.regexp_extract("trade_time", r"(\d{2}:\d{2})", 1), F.lit(""))
    stamp = _text("available_at")
    per_key = minutes.groupBy(day, code, "trade_time").agg(
        F.count("*").alias("_n"),
        F.count_if(~F.col("trade_date").eqNullSafe(F.col(day))).alias("wrong_dates"),
        F.count_if((stamp != "") & to_cn_timestamp(stamp).isNull()).alias("bad_stamps"),
    ).withColumn("_hhmm", hhmm)
    some = lambda c: F.sum(F.when(c, F.col("_n")).otherwise(0))
    days = per_key.groupBy(day).agg(
        F.sum("_n").alias("rows"), F.sum(F.col("_n") - 1).alias("repeated"), F.sum("wrong_dates").alias("wrong_dates"), F.sum("bad_stamps").alias("bad_stamps"),
        some(to_cn_timestamp("trade_time").isNull()).alias("bad_times"), some(~F.coalesce(in_session(F.col("_hhmm")), F.lit(False))).alias("off_session"),
        F.size(F.collect_set("_hhmm")).alias("times"), F.bool_or(F.col("_hhmm") == "09:30").alias("has_open"), F.bool_or(F.col("_hhmm") == "15:00").alias("has_close"),
    )  # fmt: skip  # the set has clock texts only
    here = per_key.where(F.col(code).isNotNull()).select(day, code).distinct().withColumn("_here", F.lit(True))
    want = expected.where(F.col(code).isNotNull()).select(day, code).distinct().withColumn("_want", F.lit(True))
    kind = F.when(F.col("_here").isNull(), "missing").when(F.col("_want").isNull(), "extra").otherwise("met")
    codes = here.join(want, [day, code], "full_outer").select(day, code, kind.alias("_kind"))
    counted = codes.groupBy(day).agg(F.count_if(F.col("_kind") != "missing").alias("codes"), F.count_if(F.col("_kind") != "extra").alias("expected"), F.count_if(F.col("_kind") == "missing").alias("missing"), F.count_if(F.col("_kind") == "extra").alias("extra"))
    least_codes = W.partitionBy(day, "_kind").orderBy(code)
    few = codes.where("_kind <> 'met'").withColumn("_r", F.row_number().over(least_codes)).where(F.col("_r") <= NAMED_CODES)
    named = few.groupBy(day).agg(*(F.array_join(F.array_sort(F.collect_list(F.when(F.col("_kind") == k, F.col(code)))), ",").alias(f"named_{k}") for k in ("missing", "extra")))
    out = days.join(counted, day, "full_outer").join(named, day, "left")
    numbers = ("rows", "repeated", "wrong_dates", "bad_stamps", "bad_times", "off_session", "times", "codes", "expected", "missing", "extra")
    filled = out.select(day, *(F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in numbers), *(F.coalesce(b, F.lit(False)).alias(b) for b in ("has_open", "has_close")), *(F.coalesce(n, F.lit("")).alias(n) for n in ("named_missing", "named_extra")))
    clean = (F.greatest("repeated", "wrong_dates", "bad_stamps", "bad_times") == 0) & (F.col("rows") >= least) & (F.col("missing") <= allow_missing)
    return filled.withColumn("ok", clean & ((F.col("rows") == 0) | (F.col("has_open") & F.col("has_close"))))

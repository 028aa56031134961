"""Audits: keys, partitions, completeness, value changes and roll-ups of findings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.timecols import blank
from .ranks import nearest_rank, order_statistics, percentiles

STOCK = r"^\d{6}\.(SH|SZ|BJ)$"


def canonical(c: Column | str) -> Column:
    """Trimmed text; blanks empty; finite decimals in plain notation without trailing zeros."""
    text = F.trim((F.col(c) if isinstance(c, str) else c).cast("string"))
    number = text.try_cast("decimal(38,10)")
    plain = F.regexp_replace(F.regexp_replace(number.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.when(blank(text), "").when(text.rlike(r"^[-+]?\d+(\.\d+)?$") & number.isNotNull(), F.when(plain == "-0", "0").otherwise(plain)).otherwise(text)


def key_audit(df: DataFrame, keys: Sequence[str], by: str) -> DataFrame:
    """Per partition: rows, blank keys and rows that repeat a key. Keys are counted before they are summed."""
    per_key = df.groupBy(by, *keys).agg(F.count("*").alias("_n"))
    any_blank = F.lit(False)
    for k in keys:
        any_blank = any_blank | blank(F.col(k))
    return per_key.groupBy(by).agg(F.sum("_n").alias("rows"), F.coalesce(F.sum(F.when(any_blank, F.col("_n"))), F.lit(0)).alias("blank_rows"), F.sum(F.col("_n") - 1).alias("repeated_rows"))


def partition_audit(df: DataFrame, part: str, expected: DataFrame, limits: Sequence[int]) -> DataFrame:
    """Each expected or present partition with rows and a severity: missing, at a page limit, or fine."""
    present = df.groupBy(part).agg(F.count("*").alias("rows"))
    both = expected.select(part).distinct().join(present, part, "full_outer")
    return both.select(part, F.coalesce("rows", F.lit(0)).alias("rows"), F.when(F.col("rows").isNull(), "error").when(F.col("rows").isin(*limits), "warning").otherwise("ok").alias("severity"))


def minute_quality(ticks: DataFrame, date: str, code: str, least: int) -> DataFrame:
    """Per day: bars, codes, whether opening and closing bars exist, repeated keys and the verdict."""
    per_key = ticks.groupBy(date, code, "trade_time").agg(F.count("*").alias("_n"))
    out = per_key.groupBy(date).agg(F.sum("_n").alias("rows"), F.count_distinct(code).alias("codes"), F.bool_or(F.col("trade_time") == "09:30").alias("has_open"), F.bool_or(F.col("trade_time") == "15:00").alias("has_close"), F.sum(F.col("_n") - 1).alias("repeated"))
    return out.withColumn("ok", F.col("has_open") & F.col("has_close") & (F.col("rows") >= least))


def exchange_completeness(df: DataFrame, date: str, exchange: str, required: Sequence[str], later: str, since: str) -> DataFrame:
    """Days without all required exchanges; ``later`` is required from ``since`` on."""
    want = F.when(F.col(date) >= since, F.array(*map(F.lit, [*required, later]))).otherwise(F.array(*map(F.lit, required)))
    seen = df.groupBy(date).agg(F.collect_set(exchange).alias("_seen"))
    return seen.select(date, F.array_join(F.array_sort(F.array_except(want, "_seen")), ",").alias("missing")).where("missing <> ''")


def ratio_stats(df: DataFrame, by: str, value: str) -> DataFrame:
    """Rows with a ratio, and its exact linear percentiles, per group."""
    return percentiles(df, [by], value, {"p10": 0.1, "median": 0.5, "p90": 0.9}).withColumnRenamed("n", "rows")


def _cells(old: DataFrame, new: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(keys, column, _a, _b): a row per cell of the keys that both sides have."""
    long = lambda df, to: df.unpivot(list(keys), list(columns), "column", to)
    return long(old, "_a").join(long(new, "_b"), [*keys, "column"])


_HALF_AND_TAIL = {"p50": nearest_rank(0.5), "p95": nearest_rank(0.95)}


def numeric_deltas(old: DataFrame, new: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Per column: changed cells, mean signed and absolute change, largest, nearest-rank p50 and p95 of absolute changes."""
    both = _cells(old, new, keys, columns).where("_a is not null and _b is not null and _a <> _b").select("column", (F.col("_b") - F.col("_a")).alias("d"), F.abs(F.col("_b") - F.col("_a")).alias("size"))
    sums = both.groupBy("column").agg(F.count("*").alias("changed"), F.avg("d").alias("mean"), F.avg("size").alias("mean_abs"), F.max("size").alias("largest"))
    return sums.join(order_statistics(both, ["column"], "size", _HALF_AND_TAIL).drop("n"), "column")


def value_transitions(old: DataFrame, new: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Per column and direction (a number goes, or comes): cells, and mean, largest, p50 and p95 of the size of the number that went or came."""
    kind = F.when(F.col("_a").isNotNull() & F.col("_b").isNull(), "to_blank").when(F.col("_a").isNull() & F.col("_b").isNotNull(), "from_blank")
    both = _cells(old, new, keys, columns).withColumn("kind", kind).where("kind is not null").select("column", "kind", F.abs(F.coalesce("_a", "_b")).alias("size"))
    sums = both.groupBy("column", "kind").agg(F.count("*").alias("n"), F.avg("size").alias("mean"), F.max("size").alias("largest"))
    return sums.join(order_statistics(both, ["column", "kind"], "size", _HALF_AND_TAIL).drop("n"), ["column", "kind"])


def revision_summary(diff: DataFrame, by: str) -> DataFrame:
    """Per dataset of a keyed diff: keys by change and the revised share of those on both sides."""
    count = lambda x: F.count_if(F.col("change") == x)
    return diff.groupBy(by).agg(*(count(x).alias(x) for x in ("same", "changed", "added", "removed")), F.try_divide(count("changed"), count("changed") + count("same")).alias("revision_rate"))


def rollup_findings(findings: DataFrame, datasets: DataFrame) -> DataFrame:
    """Severity counts and a status per dataset, each finding going to the longest dataset name that its check begins with, and overall."""
    met = findings.join(F.broadcast(datasets.select("dataset")), F.col("check").startswith(F.col("dataset")))
    one = met.groupBy("check", "severity", "id").agg(F.max_by("dataset", F.length("dataset")).alias("dataset"))
    out = one.rollup("dataset").agg(*(F.count_if(F.col("severity") == s).alias(s) for s in ("error", "warning", "info")))
    return out.withColumn("dataset", F.coalesce("dataset", F.lit("ALL"))).withColumn("status", F.when(F.col("error") > 0, "error").when(F.col("warning") > 0, "warning").otherwise("ok"))


def event_violations(events: DataFrame, keys: Sequence[str], first: Column, last: Column) -> DataFrame:
    """Per dataset: rows outside the window, without stamp, backdated against their own time, and repeats of (key, stamp), all of them."""
    same = F.count("*").over(W.partitionBy("dataset", *keys, "available_at"))
    return events.withColumn("_same", same).groupBy("dataset").agg(
        F.count_if(F.col("available_at").isNull()).alias("no_stamp"), F.count_if(~F.col("available_at").between(first, last)).alias("outside"),
        F.count_if(F.col("available_at") < F.col("ts")).alias("backdated"), F.count_if(F.col("_same") > 1).alias("repeated"),
    )


def multi_version(df: DataFrame, keys: Sequence[str], stamp: str, kind: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("rows"), F.count_distinct(stamp).alias("stamps"), F.count_distinct(kind).alias("kinds")).where("rows > 1 and (stamps > 1 or kinds > 1)")


def varying_columns(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Repeated keys and which columns vary inside them."""
    out = df.groupBy(*keys).agg(F.count("*").alias("rows"), *(F.count_distinct(c).alias(f"_{c}") for c in columns)).where("rows > 1")
    return out.select(*keys, "rows", F.array_join(F.array_compact(F.array(*(F.when(F.col(f"_{c}") > 1, F.lit(c)) for c in columns))), ",").alias("varies"))


def screen(universe: DataFrame, name: str, age: Column, least_age: int, boards: Sequence[str], board: str, cap: str, caps: tuple[float, float]) -> DataFrame:
    """Codes that pass every rule; a missing attribute fails."""
    rules = ~F.upper(F.col(name)).contains("ST") & (age >= least_age) & F.col(board).isin(*boards) & F.col(cap).between(*caps)
    return universe.where(F.coalesce(rules, F.lit(False)))


def apply_screen(df: DataFrame, code: str, allowed: DataFrame) -> DataFrame:
    """Rows of allowed codes; rows whose code is not shaped like a stock's always pass."""
    stock = F.coalesce(F.col(code).rlike(STOCK), F.lit(False))
    return df.where(~stock).unionByName(df.where(stock).join(allowed.select(F.col(allowed.columns[0]).alias(code)).distinct(), code, "left_semi"))


def unit_coverage(df: DataFrame, by: str, rules: DataFrame) -> DataFrame:
    """Per dataset and column the non-null count and the one rule (pattern, tier, unit) of the lowest tier that classifies it; none is unclassified."""
    columns = [c for c in df.columns if c != by]
    counts = df.groupBy(by).agg(*(F.count(c).alias(c) for c in columns)).unpivot([by], columns, "column", "filled")
    met = counts.join(F.broadcast(rules), F.regexp_like("column", F.col("pattern")), "left")
    best = W.partitionBy(by, "column").orderBy("tier", "pattern")
    return met.withColumn("_r", F.row_number().over(best)).where("_r = 1").select(by, "column", "filled", F.coalesce("unit", F.lit("unclassified")).alias("unit"))

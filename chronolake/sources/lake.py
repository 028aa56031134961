"""Scans and sinks of the lake: partition lists, ranges, point-in-time windows, merges, manifests, guards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from ..operators.windows import keep_one


def partition_dates(df: DataFrame, date: str) -> DataFrame:
    return df.select(date).distinct()


def _months(month: str | None, start: str, end: str) -> Column:
    """The partitions (``YYYYMM``) that dates from ``start`` to ``end`` lie in, so that no others are listed or read."""
    return F.lit(True) if month is None else F.col(month).between(start[:6], end[:6])


def trade_date(df: DataFrame, date: str, day: str, columns: Sequence[str], month: str | None = None) -> DataFrame:
    """One date; its absence is an error when the query runs."""
    one = df.where(_months(month, day, day) & (F.col(date) == day)).select(*columns)
    if one.isEmpty():
        raise ValueError(f"no partition {date}={day}")
    return one


def trade_range(df: DataFrame, date: str, start: str, end: str, columns: Sequence[str], month: str | None = None) -> DataFrame:
    """Inclusive; a reversed range is empty and reads nothing; ``month`` names the partition column, if there is one."""
    return df.where(_months(month, start, end) & F.col(date).between(start, end) if start <= end else F.lit(False)).select(*columns)


def canonical_range(copies: DataFrame, part: str, first: int, last: int, keys: Sequence[str], copy: str) -> DataFrame:
    """The rows of a range of partitions, each key from its latest copy; stale copies are left behind."""
    return keep_one(copies.where(F.col(part).between(first, last)), keys, [copy], "last").drop(copy)


def available_window(df: DataFrame, stamp: str, start: Column, decision: Column, partition: Column | None = None) -> DataFrame:
    """Rows visible at ``decision`` from ``start`` on; ``partition`` (a predicate on partition columns) prunes first, even rows that would qualify."""
    if stamp not in df.columns:
        raise ValueError(f"no column {stamp}")
    pruned = df if partition is None else df.where(partition)
    return pruned.where((F.col(stamp) >= start) & (F.col(stamp) <= decision))


def window_counts(df: DataFrame, stamp: str, start: Column, decision: Column) -> DataFrame:
    seen = (F.col(stamp) >= start) & (F.col(stamp) <= decision)
    return df.agg(F.count("*").alias("source_rows"), F.count_if(F.coalesce(seen, F.lit(False))).alias("visible_rows"), F.count_if(F.col(stamp).isNull()).alias("unparseable_rows"))


def news_sources(df: DataFrame, source: str, stamp: str, sources: Sequence[str] | None, start: Column, shorter: Column, decision: Column) -> DataFrame:
    chosen = df if sources is None else df.where(F.col(source).isin(*sources))
    return available_window(chosen, stamp, F.greatest(start, shorter), decision)


def union_by_name(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def schema_pad(df: DataFrame, *schemas: T.StructType) -> DataFrame:
    """Adds the columns of datasets without visible rows, typed and null."""
    have = set(df.columns)
    new = {f.name: F.lit(None).cast(f.dataType) for s in schemas for f in s.fields if f.name not in have}
    return df.withColumns(new) if new else df


def footer_profile(df: DataFrame, dates: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Row count, extremes of date columns and null counts of keys in one pass; narrow columns only."""
    return df.agg(F.count("*").alias("rows"), *(f(c).alias(f"{n}_{c}") for c in dates for n, f in (("min", F.min), ("max", F.max))), *(F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in keys))


def metadata_profile(spark: SparkSession, path: str, dates: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """``footer_profile`` of a parquet folder from its footers alone: Spark's second reader answers counts and extremes without reading rows.

    ``dates`` are whole numbers or dates, whose extremes footers hold exactly. A session of its own has the two settings that this needs.
    """
    own = spark.newSession()
    own.conf.set("spark.sql.sources.useV1SourceList", "")
    own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    counts = own.read.parquet(path).agg(F.count("*").alias("rows"), *(f(c).alias(f"{n}_{c}") for c in dates for n, f in (("min", F.min), ("max", F.max))), *(F.count(c).alias(f"_{c}") for c in keys))
    return counts.select("rows", *(f"{n}_{c}" for c in dates for n in ("min", "max")), *((F.col("rows") - F.col(f"_{c}")).alias(f"null_{c}") for c in keys))


def window_merge(old: DataFrame, new: DataFrame, date: str, start: str, end: str, keys: Sequence[str]) -> DataFrame:
    """Old rows outside the window and the refreshed ones; per key the refreshed row stays."""
    both = old.where(~F.col(date).between(start, end)).withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return keep_one(both, keys, ["_new"], "last").drop("_new")


def replace_parts(old: DataFrame, new: DataFrame, part: Sequence[str]) -> DataFrame:
    """Partitions present in ``new`` replace the old ones as a whole."""
    return old.join(new.select(*part).distinct(), list(part), "left_anti").unionByName(new)


def write_parts(df: DataFrame, path: str, part: Sequence[str]) -> None:
    """Replaces only the partitions that ``df`` has; a large one is several tasks and files."""
    df.hint("rebalance", *part).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*part).parquet(path)


def compact_by_date(ticks: DataFrame, path: str, date: str, keys: Sequence[str], expected: DataFrame | None = None) -> None:
    """Partitions per date, each key once, sorted inside files; a large date is several tasks and files.

    ``expected`` has the columns (of ``date`` and ``keys``) of what must be there, such as a date's codes: if any is lacking, nothing is written.
    """
    if expected is not None:
        lacking = expected.distinct().join(ticks.select(*expected.columns).distinct(), expected.columns, "left_anti").limit(5).collect()
        if lacking:
            raise ValueError("nothing is written, since these are lacking: " + "; ".join(", ".join(map(str, r)) for r in lacking))
    keep_one(ticks, [date, *keys], [], "last").hint("rebalance", date).sortWithinPartitions(date, *keys).write.mode("overwrite").partitionBy(date).parquet(path)


def fingerprint(df: DataFrame, *by: str) -> DataFrame:
    """An order-free digest: row count and the sum of row digests, exact in decimals."""
    row = F.md5(F.concat_ws("|", *(F.col(c).cast("string") for c in sorted(df.columns))))
    own = F.sum(F.conv(F.substring(row, 1, 15), 16, 10).cast("decimal(20,0)")).cast("decimal(38,0)")
    return df.groupBy(*by).agg(F.count("*").alias("rows"), own.alias("digest"))


def manifest(now: DataFrame, before: DataFrame | None, keys: Sequence[str], fetched_at: Column) -> DataFrame:
    """Equal content keeps the availability that it had; changed or new content is available from ``fetched_at``."""
    if before is None:
        return now.withColumn("available_at", fetched_at)
    prev = before.select(*keys, F.col("digest").alias("_digest"), F.col("available_at").alias("_at"))
    joined = now.join(prev, list(keys), "left")
    return joined.withColumn("available_at", F.when(F.col("digest") == F.col("_digest"), F.col("_at")).otherwise(fetched_at)).drop("_digest", "_at")


def overwrite_decisions(old: DataFrame, new: DataFrame, part: str, keys: Sequence[str], allow_removal: bool = True, most: int = 20, share: float = 0.2) -> DataFrame:
    """(part, old_keys, new_rows, removed, action) of every part of either side: skip_empty, skip_removed, block or overwrite.

    Nothing replaces something: skipped. Keys that vanish where that is not allowed: skipped. More than ``most`` keys and more than ``share`` of the old
    distinct keys vanish: blocked.
    """
    a = old.groupBy(part, *keys).agg(F.lit(True).alias("_old"))
    b = new.groupBy(part, *keys).agg(F.count("*").alias("_n"))
    count = a.join(b, [part, *keys], "full_outer").groupBy(part).agg(F.count("_old").alias("old_keys"), F.coalesce(F.sum("_n"), F.lit(0)).alias("new_rows"), F.count_if(F.col("_n").isNull()).alias("removed"))
    return count.withColumn("action", _action(allow_removal, most, share))


def _action(allow_removal: bool, most: int, share: float) -> Column:
    action = F.when((F.col("new_rows") == 0) & (F.col("old_keys") > 0), "skip_empty").when(F.lit(not allow_removal) & (F.col("removed") > 0), "skip_removed")
    return action.when((F.col("removed") > most) & (F.col("removed") > share * F.col("old_keys")), "block").otherwise("overwrite")


def overwrite_decision(old: DataFrame, new: DataFrame, keys: Sequence[str], allow_removal: bool = True, most: int = 20, share: float = 0.2) -> DataFrame:
    """The decision about a table that is one part."""
    one = overwrite_decisions(old.withColumn("_all", F.lit(0)), new.withColumn("_all", F.lit(0)), "_all", keys, allow_removal, most, share)
    count = one.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("old_keys", "new_rows", "removed")))
    return count.withColumn("action", _action(allow_removal, most, share))


def append_once(ledger: DataFrame, records: DataFrame, keys: Sequence[str]) -> DataFrame:
    fresh = keep_one(records, keys, [], "first").join(ledger.select(*keys).distinct(), list(keys), "left_anti")
    return ledger.unionByName(fresh, allowMissingColumns=True)


def append_records(spark: SparkSession, path: str, records: DataFrame, keys: Sequence[str]) -> int:
    """Appends to a ledger of JSON lines the records whose key is not in it, each key once; returns how many.

    Appending the same records again adds none. One writer at a time.
    """
    try:
        known = spark.read.schema(records.schema).json(path).select(*keys).distinct()
    except AnalysisException as gone:
        if "PATH_NOT_FOUND" not in str(gone):
            raise
        known = spark.createDataFrame([], records.select(*keys).schema)
    fresh = keep_one(records, keys, [], "first").join(known, list(keys), "left_anti").select(*records.columns).persist()
    try:
        if n := fresh.count():
            fresh.write.mode("append").json(path)
    finally:
        fresh.unpersist()
    return n


def union_with_baseline(active: DataFrame, baseline: DataFrame, group: Sequence[str], identity: Sequence[str], capped: str) -> DataFrame:
    """Refreshed groups replace the baseline's, unless every refreshed row of the group came from a capped pull."""
    safe = active.groupBy(*group).agg(F.min(F.col(capped).cast("int")).alias("_all")).where("_all = 0").select(*group)
    return keep_one(active.withColumn("_new", F.lit(1)).unionByName(baseline.join(safe, list(group), "left_anti").withColumn("_new", F.lit(0)), allowMissingColumns=True), identity, ["_new"], "last").drop("_new")


def read_ledger(spark: SparkSession, path: str, schema: T.StructType, version: int, record_type: str | None = None) -> DataFrame:
    """JSON lines; a record of another schema version is an error."""
    rows = spark.read.schema(schema).json(path)
    checked = rows.where(F.when(F.col("schema_version").eqNullSafe(version), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("schema_version "), F.coalesce(F.col("schema_version").cast("string"), F.lit("null"))))))
    return checked if record_type is None else checked.where(F.col("record_type") == record_type)


def row_floor(counts: DataFrame, key: str, order: str, n: str, least: int, ratio: float, drop: int) -> DataFrame:
    """The least acceptable rows of each partition after the one before it."""
    before = F.lag(n).over(W.partitionBy(key).orderBy(order))
    return counts.withColumn("floor", F.greatest(F.lit(least), F.floor(before * ratio), before - drop).cast("long"))


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)

"""Window operators: keep one row per key, returns, ranks, weekly values, chains, accruals."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def keep_one(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], keep: str = "last") -> DataFrame:
    """The first or last row of each key; ``order`` should be total, ties are broken by all other columns."""
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    rest = [F.col(c) for c, t in df.dtypes if c not in keys and not t.startswith(("map", "variant"))]
    by = [*cols, *rest] if keep == "first" else [c.desc() for c in (*cols, *rest)]
    if not any(t.startswith(("map", "variant")) for _, t in df.dtypes):
        # Structs compare field by field, nulls first, so tasks keep one row a key before the shuffle.
        row = F.struct(*(c.alias(f"_o{i}") for i, c in enumerate(cols)), *rest)
        best = df.groupBy(*keys).agg((F.min if keep == "first" else F.max)(row).alias("_row"))
        return best.select(*(F.col(c) if c in keys else F.col("_row")[c].alias(c) for c in df.columns))
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*by))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def drop_copies(texts: DataFrame, body: str, order: Sequence[str]) -> DataFrame:
    """Of equal bodies the earliest copy; keyed by digest so that bodies are not shuffled as keys."""
    keyed = texts.withColumn("_sha", F.sha1(F.col(body)))
    return keep_one(keyed, ["_sha"], order, "first").drop("_sha")


def returns(series: DataFrame, key: str, order: str, value: str, initial: Column | None = None) -> DataFrame:
    """Adds ``ret`` against the value before (``initial`` before the first), ``peak`` and ``drawdown`` from a running peak."""
    own = W.partitionBy(key).orderBy(order)
    before = F.lag(value).over(own)
    if initial is not None:
        before = F.coalesce(before, initial)
    peak = F.max(value).over(own.rowsBetween(W.unboundedPreceding, 0))
    if initial is not None:
        peak = F.greatest(peak, initial)
    out = series.withColumn("ret", F.col(value) / before - 1).withColumn("peak", peak)
    return out.withColumn("drawdown", F.col(value) / F.col("peak") - 1)


def pct_rank_avg(df: DataFrame, by: str, value: str, to: str) -> DataFrame:
    """Percentile rank with average ties among the non-null values of ``by``; nulls get 0.5."""
    ordered = W.partitionBy(by).orderBy(F.col(value).asc_nulls_last())
    ties = F.count("*").over(W.partitionBy(by, value))
    n = F.count(value).over(W.partitionBy(by))
    rank = (F.rank().over(ordered) + (ties - 1) / 2) / n
    return df.withColumn(to, F.when(F.col(value).isNull(), 0.5).otherwise(rank))


def weekly_last(series: DataFrame, key: str, date: str, value: str, initial: Column) -> DataFrame:
    """The last value of each week that ends on Sunday, and its return against the week before."""
    ends = F.date_add(F.date_trunc("week", F.col(date)).cast("date"), 6)
    weekly = series.groupBy(key, ends.alias("week_end")).agg(F.max_by(value, date).alias(value))
    before = F.coalesce(F.lag(value).over(W.partitionBy(key).orderBy("week_end")), initial)
    return weekly.withColumn("ret", F.col(value) / before - 1)


def chain(series: DataFrame, date: str, order: Sequence[str]) -> DataFrame:
    """Overlapping windows as one series: the first row per date in the windows' order."""
    return keep_one(series, [date], order, "first")


def accrue(contracts: DataFrame, account: str, date: str, base: Column, yearly: Column) -> DataFrame:
    """Interest by calendar days since the mark before (a day for the first), and its running total."""
    own = W.partitionBy(account).orderBy(date)
    gap = F.coalesce(F.datediff(F.col(date), F.lag(date).over(own)), F.lit(1))
    out = contracts.withColumn("days", gap).withColumn("interest_due", base * yearly / 360 * F.col("days"))
    return out.withColumn("interest_total", F.sum("interest_due").over(own.rowsBetween(W.unboundedPreceding, 0)))


def allocate(debts: DataFrame, account: str, order: Sequence[str], paid: Column) -> DataFrame:
    """``paid`` settles an account's debts oldest first, interest before principal; shares are released in proportion."""
    own = W.partitionBy(account).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    due = F.col("interest") + F.col("principal")
    earlier = F.sum(due).over(own) - due
    out = debts.withColumn("settled", F.greatest(F.lit(0.0), F.least(due, paid - earlier)))
    out = out.withColumn("interest_paid", F.least("interest", "settled"))
    out = out.withColumn("principal_paid", F.col("settled") - F.col("interest_paid"))
    return out.withColumn("released", F.when(F.col("principal") > 0, F.floor(F.col("shares") * F.col("principal_paid") / F.col("principal"))).otherwise(F.col("shares")))


def days(stamp: Column) -> Column:
    """The number of the day of a time."""
    return F.unix_date(stamp.cast("date"))


#: Slots (a dataset's block of time) up to which they are broadcast.
BROADCAST_ROWS = 200_000


def newly_visible(rows: DataFrame, grid: DataFrame, dataset: str, stamp: str, cutoff: str, ready: str | None = None, block: Callable[[Column], Column] = days) -> DataFrame:
    """Each row with ``shown_at``, when it is first seen: at the first refresh of its dataset with ``stamp <= cutoff``, once that is ``ready``.

    The grid has a row per refresh (many days of few datasets). ``block`` numbers stretches of time: each (dataset, block) gets the few refreshes
    that lie in it and the next one after, and rows look theirs up, so no dataset meets in one task and, within ``BROADCAST_ROWS``
    slots, no row is shuffled. Rows without stamp or after the last refresh are never seen. Of refreshes that overlap, the earliest ready one
    shows a row.
    """
    marks = grid.select(F.col(dataset).alias("_d"), F.col(cutoff).alias("_cut"), F.col(ready or cutoff).alias("_ready")).where("_d is not null and _cut is not null and _ready is not null")
    later = W.partitionBy("_d").orderBy(F.col("_cut").desc()).rangeBetween(W.unboundedPreceding, 0)
    marks = marks.withColumn("_ready", F.min("_ready").over(later)).distinct().withColumn("_b", block(F.col("_cut")))
    first, last, n = marks.agg(F.min("_b"), F.max("_b"), F.count_distinct("_d")).first()
    out = T.StructType([*rows.schema.fields, T.StructField("shown_at", marks.schema["_ready"].dataType)])
    if first is None:
        return rows.sparkSession.createDataFrame([], out)
    own = marks.groupBy("_d", "_b").agg(F.array_sort(F.collect_list(F.struct("_cut", "_ready"))).alias("_marks"))  # refreshes of one block
    every = marks.select("_d").distinct().select("_d", F.explode(F.sequence(F.lit(first), F.lit(last))).alias("_b")).join(own, ["_d", "_b"], "left")
    after = F.first(F.col("_marks")[0], ignorenulls=True).over(W.partitionBy("_d").orderBy("_b").rowsBetween(1, W.unboundedFollowing))
    slots = every.select("_d", "_b", F.array_compact(F.concat(F.coalesce("_marks", F.array().cast(own.schema["_marks"].dataType)), F.array(after))).alias("_marks"))
    if n * (last - first + 1) <= BROADCAST_ROWS:
        slots = F.broadcast(slots)
    facts = rows.select(F.struct("*").alias("_row"), F.col(dataset).alias("_d"), F.col(stamp).alias("_t"), F.greatest(block(F.col(stamp)), F.lit(first)).alias("_b"))
    shown = F.get(F.filter("_marks", lambda m: m["_cut"] >= F.col("_t")), F.lit(0))["_ready"]
    return facts.where("_t is not null").join(slots, ["_d", "_b"]).select("_row.*", shown.alias("shown_at")).where("shown_at is not null")

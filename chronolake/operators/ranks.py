"""Exact order statistics of any group size: ranks found by refining histograms, never by sorting a group or holding its values."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from itertools import cycle

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import new_path

#: Bins of a histogram, and rows up to which what is left of a group is sorted in one task.
BINS, SORTED = 1024, 20_000
#: Ranges up to which they are broadcast; beyond, rows meet theirs by a shuffle.
BROADCAST_ROWS = 100_000


def _written(df: DataFrame, name: str) -> DataFrame:
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _linear(kind: str) -> Callable[[str], Column]:
    """The value, so that differences neither overflow nor are rounded before they are taken."""
    if kind in ("double", "float"):
        return lambda c: F.col(c).cast("double") / 2
    return lambda c: F.col(c) if kind.startswith("decimal") else F.col(c).cast("decimal(20,0)")


def _orders(c: str) -> Column:
    """The sign times the order of magnitude, above 0 for the least double."""
    v = F.col(c).cast("double")
    return F.when(v == 0, 0.0).otherwise(F.signum(v) * (F.ln(F.abs(v)) + 746))


def _bin(bins: int, measure: Callable[[str], Column]) -> Column:
    """A bin that never falls as the value rises; the ends of the range have bins of their own, so every round parts a range of two values."""
    inside = F.nanvl(F.try_divide((measure("_v") - measure("_lo")).cast("double"), (measure("_hi") - measure("_lo")).cast("double")), F.lit(0.0))
    middle = 1 + F.least(F.greatest(F.floor(inside * (bins - 2)), F.lit(0)), F.lit(bins - 3))
    return F.when(F.col("_v") == F.col("_lo"), 0).when(F.col("_v") == F.col("_hi"), bins - 1).otherwise(middle).cast("int")


def order_statistics(df: DataFrame, by: Sequence[str], value: str, ranks: Mapping[str, Callable[[Column], Column]], bins: int = BINS, most: int = SORTED) -> DataFrame:
    """(by, n, name, ...): per group the values at the 0-based ranks that ``ranks`` gives for its count; null for a rank outside.

    Null and NaN values do not count; groups without others are left out; null groups are groups. Every round counts the rows of the open
    ranges by bin (tasks sum their own), follows each rank into its bin, and goes on with the values there, until a range is one value
    or has at most ``most`` rows; only those are put in order. Bins are equal steps of the value and of its order of magnitude by turns:
    values of one magnitude are told apart by their 53 bits in a few rounds, so any distribution ends soon.
    """
    numbers, kind = F.col(value).isNotNull(), dict(df.dtypes)[value]
    if kind in ("double", "float"):
        numbers = numbers & ~F.isnan(value)
    rows = _written(df.where(numbers).select(F.struct(*by).alias("_g"), F.col(value).alias("_v")), "values")
    sizes = _written(rows.groupBy("_g").agg(F.count("*").alias("n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")), "sizes")
    asked = F.explode(F.array(*(F.struct(F.lit(name).alias("_name"), rank(F.col("n")).cast("long").alias("_k")) for name, rank in ranks.items())))
    ranges = sizes.select("_g", asked.alias("_a"), "_lo", "_hi", F.col("n").alias("_m")).select("_g", "_a._name", "_a._k", "_lo", "_hi", "_m").where("_k between 0 and _m - 1")
    still = (F.col("_m") > most) & (F.col("_lo") != F.col("_hi"))
    closed, span, turns = [], ["_g", "_lo", "_hi"], cycle((_linear(kind), _orders))
    while not (opened := ranges.where(still)).isEmpty():
        closed.append(ranges.where(~still))
        met = _within(rows, opened.select(*span).distinct())
        counts = met.groupBy(*span, _bin(bins, next(turns)).alias("_bin")).agg(F.count("*").alias("_c"), F.min("_v").alias("_least"), F.max("_v").alias("_top"))
        before = F.sum("_c").over(W.partitionBy(*span).orderBy("_bin")) - F.col("_c")
        into = opened.join(counts.withColumn("_before", before), span).where((F.col("_k") >= F.col("_before")) & (F.col("_k") < F.col("_before") + F.col("_c")))
        ranges = _written(into.select("_g", "_name", (F.col("_k") - F.col("_before")).alias("_k"), F.col("_least").alias("_lo"), F.col("_top").alias("_hi"), F.col("_c").alias("_m")), "ranges")
    for part in closed:
        ranges = ranges.unionByName(part)
    ranges = _written(ranges, "ranges") if closed else ranges
    single, rest = ranges.where("_lo = _hi"), ranges.where("_lo <> _hi")
    placed = _within(rows, rest.select(*span).distinct()).withColumn("_k", F.row_number().over(W.partitionBy(*span).orderBy("_v")) - 1)  # at most ``most`` rows a range
    found = single.select("_g", "_name", F.col("_lo").alias("_v")).unionByName(rest.join(placed, [*span, "_k"]).select("_g", "_name", "_v"))
    wide = found.groupBy("_g").agg(*(F.max(F.when(F.col("_name") == name, F.col("_v"))).alias(name) for name in ranks))
    return sizes.select("_g", "n").join(wide, "_g", "left").select(*(F.col("_g")[c].alias(c) for c in by), "n", *ranks)


def _within(rows: DataFrame, ranges: DataFrame) -> DataFrame:
    small = ranges.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(ranges) if small else ranges, "_g").where(F.col("_v").between(F.col("_lo"), F.col("_hi")))


def nearest_rank(p: float) -> Callable[[Column], Column]:
    """``round((n - 1) p)``, half to even."""
    return lambda n: F.bround((n - 1) * F.lit(p), 0)


def percentiles(df: DataFrame, by: Sequence[str], value: str, wanted: Mapping[str, float], **sizes: int) -> DataFrame:
    """(by, n, name, ...): exact percentiles, linear between the two ranks around ``(n - 1) p``."""
    low = {f"_lo_{name}": (lambda n, p=p: F.floor((n - 1) * F.lit(p))) for name, p in wanted.items()}
    high = {f"_hi_{name}": (lambda n, p=p: F.ceil((n - 1) * F.lit(p))) for name, p in wanted.items()}
    out = order_statistics(df, by, value, {**low, **high}, **sizes)
    part = lambda p: (F.col("n") - 1) * F.lit(p) - F.floor((F.col("n") - 1) * F.lit(p))
    between = lambda name, p: F.col(f"_lo_{name}") + (F.col(f"_hi_{name}") - F.col(f"_lo_{name}")) * part(p)
    return out.select(*by, "n", *(between(name, p).alias(name) for name, p in wanted.items()))

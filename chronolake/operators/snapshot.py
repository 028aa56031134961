"""Decision snapshots and replay slots: dictionaries of lazy domain tables, written with profile and manifest."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.lake import fingerprint
from . import text
from .windows import drop_copies


@dataclass(frozen=True)
class Domain:
    """A table with its stamp and how far back it is kept; ``keys`` make a row unique where there are any."""

    table: DataFrame
    stamp: str = "available_at"
    start: Column | None = None
    keys: Sequence[str] = field(default=())


def decision_snapshot(domains: Mapping[str, Domain], when: Column) -> dict[str, DataFrame]:
    """Each domain's rows from its window's start up to ``when``; a row without a stamp is hidden."""
    out = {}
    for name, d in domains.items():
        seen = d.table.where(F.col(d.stamp) <= when)
        out[name] = seen if d.start is None else seen.where(F.col(d.stamp) >= d.start)
    return out


def replay_slot(domains: Mapping[str, Domain], floor: Column, end: Column) -> dict[str, DataFrame]:
    """The same domains over a period that begins after the decision's anchor."""
    return {name: d.table.where((F.col(d.stamp) > floor) & (F.col(d.stamp) <= end)) for name, d in domains.items()}


def text_library(texts: DataFrame, when: Column, windows: Mapping[str, Column], fallback: Column) -> tuple[DataFrame, DataFrame]:
    """(index, bodies) of visible texts, each dataset with its own window, copies of a body kept once."""
    start = fallback
    for dataset, own in windows.items():
        start = F.when(F.col("dataset") == dataset, own).otherwise(start)
    seen = texts.where((F.col("available_at") <= when) & (F.col("available_at") >= start))
    one = drop_copies(seen, "body", ["available_at", "dataset", "text_id"]).withColumn("source_hash", F.sha1("body"))
    return one.drop("body"), one.select("text_id", "body")


def profile(domains: Mapping[str, DataFrame], stamp: str = "available_at") -> DataFrame:
    """Rows, stamps and an order-free digest per domain."""
    out = None
    for name, df in domains.items():
        one = df.agg(F.lit(name).alias("domain"), F.count("*").alias("rows"), F.min(stamp).cast("string").alias("first"), F.max(stamp).cast("string").alias("last"))
        digest = fingerprint(df).select(F.lit(name).alias("domain"), "digest")
        row = one.join(digest, "domain")
        out = row if out is None else out.unionByName(row)
    return out


def write(domains: Mapping[str, DataFrame], path: str) -> None:
    """Domains as tables below ``path``, then the manifest that makes the snapshot complete."""
    for name, df in domains.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    spark = next(iter(domains.values())).sparkSession
    profile({name: spark.read.parquet(f"{path}/{name}") for name in domains}).coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def search_library(index: DataFrame, bodies: DataFrame, pattern: str, own: Column, when: Column, n: int) -> DataFrame:
    return text.search(index, bodies, pattern, own, when, n)

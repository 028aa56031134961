"""Rolling point-in-time views: a replay laid out by when its rows are first seen, and a clock stream that copies each slice once.

Laying out costs one pass. Then a step of the clock reads the folders of its own days only, however long the replay is: nothing is
joined with the whole replay, and text bodies are read as late as their index rows.
"""

from __future__ import annotations

import datetime
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.windows import newly_visible

#: The partition column of a layout.
DAY = "shown_day"
LEDGER = "batch long, before timestamp_ntz, upto timestamp_ntz, rows long, version long"


def lay_out(rows: DataFrame, path: str) -> None:
    """Writes ``rows`` with the time ``shown_at`` in folders by its day, in order of that time; a large day is several files.

    Rows that are never seen (null) are left out.
    """
    dated = rows.where("shown_at is not null").withColumn(DAY, F.col("shown_at").cast("date"))
    dated.hint("rebalance", DAY).sortWithinPartitions(DAY, "shown_at").write.mode("overwrite").partitionBy(DAY).parquet(path)


def lay_out_texts(index: DataFrame, bodies: DataFrame, path: str, keys: Sequence[str] = ("dataset", "text_id")) -> dict[str, str]:
    """The layouts of an index with ``shown_at`` and of its bodies, each body shown with its index row; bodies without one are left out."""
    at = {"text_index": f"{path}/text_index", "text_bodies": f"{path}/text_bodies"}
    lay_out(index, at["text_index"])
    lay_out(bodies.join(index.select(*keys, "shown_at").where("shown_at is not null"), list(keys)), at["text_bodies"])
    return at


def layout_slice(spark: SparkSession, path: str, schema: T.StructType, before: datetime.datetime | None, upto: datetime.datetime) -> DataFrame:
    """The rows of a layout shown after ``before`` (all, without one) up to and at ``upto``; only folders of these days are listed and read."""
    at = lambda when: F.lit(when).cast("timestamp_ntz")
    wanted = (F.col(DAY) <= F.lit(upto.date())) & (F.col("shown_at") <= at(upto))
    if before is not None:
        wanted = wanted & (F.col(DAY) >= F.lit(before.date())) & (F.col("shown_at") > at(before))
    return spark.read.schema(T.StructType([*schema.fields, T.StructField(DAY, T.DateType())])).parquet(path).where(wanted).drop(DAY)


def first_tick(ticks: Sequence[datetime.datetime], shown_at: Column) -> Column:
    """The first of the sorted ``ticks`` of a step (a few) at or after ``shown_at``."""
    found = F.lit(None).cast("timestamp_ntz")
    for tick in reversed(ticks):
        found = F.when(shown_at <= F.lit(tick).cast("timestamp_ntz"), F.lit(tick).cast("timestamp_ntz")).otherwise(found)
    return found


def roll(clock: DataFrame, layouts: Mapping[str, tuple[str, T.StructType]], out: str, checkpoint: str, tick: str = "tick") -> StreamingQuery:
    """Copies what each step of ``clock`` (a stream of ``tick``) shows to ``out/<domain>/batch=n``, each row once, with its tick.

    A step may cross several refreshes of several domains, and bring several ticks; a row belongs to the first tick that shows it. Ticks that
    are not after the clock's last one show nothing. ``out/clock/batch=n`` is the ledger of a step: where the clock stood and stands, the rows, and a
    version that rises with each part that has rows. A step that is run again after a failure finds the ledger of the step before it,
    and replaces its own parts with the same rows.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        last = spark.read.schema(LEDGER).json(f"{out}/clock/batch={number - 1}").first() if number else None
        before, version = (last.upto, last.version) if last else (None, 0)
        came = [r[0] for r in batch.select(F.col(tick).cast("timestamp_ntz")).distinct().where(F.col(tick).isNotNull()).collect()]  # ticks of one step
        ticks = sorted(t for t in came if before is None or t > before)
        rows, upto = 0, ticks[-1] if ticks else before
        for name, (path, schema) in layouts.items():
            part = f"{out}/{name}/batch={number}"
            if ticks:
                shown = layout_slice(spark, path, schema, before, upto).withColumn(tick, first_tick(ticks, F.col("shown_at")))
            else:
                shown = spark.createDataFrame([], schema).withColumn(tick, F.lit(None).cast("timestamp_ntz"))
            shown.write.mode("overwrite").parquet(part)
            counts = spark.read.schema(shown.schema).parquet(part).groupBy(tick).count().collect()  # a row a tick
            rows, version = rows + sum(r["count"] for r in counts), version + len(counts)
        spark.createDataFrame([(number, before, upto, rows, version)], LEDGER).coalesce(1).write.mode("overwrite").json(f"{out}/clock/batch={number}")

    return clock.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def view(spark: SparkSession, out: str, name: str, schema: T.StructType, tick: str = "tick") -> DataFrame:
    """What a domain has shown so far, with the tick of each row."""
    whole = T.StructType([*schema.fields, T.StructField(tick, T.TimestampNTZType())])
    return spark.read.schema(whole).option("basePath", f"{out}/{name}").parquet(f"{out}/{name}").select(whole.names)


def eager(rows: DataFrame, ticks: DataFrame, tick: str = "tick") -> DataFrame:
    """Batch form: each row of ``rows`` (with ``shown_at``) that some tick shows, with the first such tick."""
    clock = ticks.select(F.lit(0).alias("_clock"), F.col(tick).cast("timestamp_ntz").alias("_tick"))
    found = newly_visible(rows.withColumnRenamed("shown_at", "_shown").withColumn("_clock", F.lit(0)), clock, "_clock", "_shown", "_tick")
    return found.select(*(F.col("_shown").alias("shown_at") if c == "shown_at" else c for c in rows.columns), F.col("shown_at").alias(tick))

"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

_fallback: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only a local session without that setting (tests) gets a temporary folder.
    """
    set_by_cluster = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if set_by_cluster:
        return set_by_cluster.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir names no folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _fallback:
        _fallback[app] = "file://" + tempfile.mkdtemp(prefix="spark-")
    return _fallback[app]


#: Rows of an Arrow batch: texts of a batch are in memory several times over, in the JVM and in Python.
BATCH_ROWS = 2000


def modest_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches small in this session, so that many long texts are not held together."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Frames made in here have their shuffle files removed as soon as they have run; each is to run once.

    Otherwise the files stay until the driver collects its garbage, and every task leaves three in each shuffle.
    """
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table written to the shared folder: cuts the lineage and survives lost executors. No shuffle files stay."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with tidy(spark):
        df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_to = path
    return table


def forget(*tables: DataFrame) -> None:
    """Deletes tables of ``written`` that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.written_to)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Asks the driver's JVM to collect, after which Spark's cleaner removes shuffle files that no table needs any more."""
    spark._jvm.java.lang.System.gc()


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def bounded_broadcast(df: DataFrame, rows: int, most: int) -> DataFrame:
    """A broadcast hint, only while the counted ``rows`` are within ``most``; else Spark shuffles."""
    return F.broadcast(df) if rows <= most else df


#: Keys that hold more than this part of all rows are fewer than it; under so many rows, a key is no burden.
HOT_PARTS, HOT_ROWS = 4096, 1000


def join_counted(rows: DataFrame, counted: DataFrame, key: str, count: str) -> DataFrame:
    """``rows`` joined with ``counted`` (written; a row a key, with the rows it has in ``count``).

    Keys with more than one in ``HOT_PARTS`` of the rows are few and come by a broadcast, so that no task gets all rows of such
    a key; the rest are shuffled.
    """
    with tidy(counted.sparkSession):
        total = counted.agg(F.sum(count)).first()[0] or 0
    keys = [r[0] for r in counted.where((F.col(count) * HOT_PARTS > total) & (F.col(count) > HOT_ROWS)).select(key).collect()]  # fewer than HOT_PARTS
    if not keys:
        return rows.join(counted, key)
    hot = F.col(key).isin([bytes(k) if isinstance(k, bytearray) else k for k in keys])
    return rows.where(hot).join(F.broadcast(counted.where(hot)), key).unionByName(rows.where(~hot).join(counted.where(~hot), key))


def once(value: Column) -> Column:
    """A generator of the one ``value``: later projections read it instead of repeating the expression in lambdas."""
    return F.explode(F.array(value))


#: Bits of the bitmaps that mark documents: 8 MB at any input.
MARK_BITS = 26


def mark_slot(key: Column) -> Column:
    return F.xxhash64(key).bitwiseAND(F.lit((1 << MARK_BITS) - 1))


def crc_slot(key: Column) -> Column:
    """A slot that Python finds as well: ``is_marked(bits, crc_slots(keys))``."""
    return F.crc32(key).bitwiseAND(F.lit((1 << MARK_BITS) - 1))


def crc_slots(keys: list[str]) -> np.ndarray:
    return np.array([zlib.crc32(k.encode()) for k in keys], np.int64) & ((1 << MARK_BITS) - 1)


def marks(keys: DataFrame, key: str, slot: Callable[[Column], Column] = mark_slot) -> bytes:
    """A bitmap of fixed size in which the slots of ``keys`` are set."""
    with tidy(keys.sparkSession):
        slots = keys.select(slot(F.col(key)).alias("s"))
        words = slots.groupBy(F.shiftright("s", 6).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(1 << (MARK_BITS - 6), np.int64)
    out[words.column("w").to_numpy()] = words.column("bits").to_numpy()
    return out.tobytes()


def is_marked(bits: bytes, slots: np.ndarray) -> np.ndarray:
    return (np.frombuffer(bits, np.uint64)[slots >> 6] >> (slots & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


def unused(name: str, df: DataFrame) -> str:
    """``name``, lengthened until no column is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def split(df: DataFrame, key: Column, keys: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose key is surely not in ``keys``, the others), so that a join with ``keys`` shuffles only the others.

    Where the bitmap fills up, more rows are among the others; nothing is lost.
    """
    bits = df.sparkSession.sparkContext.broadcast(marks(keys, name))
    slotted = df.select("*", mark_slot(key).alias(unused("_slot", df)))

    def only(wanted: bool) -> DataFrame:
        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = batch.num_columns - 1
                hit = is_marked(bits.value, batch.column(at).to_numpy())
                yield batch.select(list(range(at))).filter(pa.array(hit == wanted))

        return slotted.mapInArrow(keep, df.schema)

    return only(False), only(True)

"""Tables published in generations: stage what changed, check it, and write the manifest last; readers see whole generations only.

Below a root, ``data/<table>/<id>/`` holds parts that never change and ``manifests/`` a row a part and generation: its place, rows, digest, and since
when this content is available. A part with the rows and digest that it had is not written again and keeps its stamp. A manifest is one file, so
it appears whole or not at all; data that no manifest names is not there for readers.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from .lake import overwrite_decisions

MANIFEST = "table string, part string, path string, rows long, digest decimal(38,0), available_at string, fetched_at string, columns string, generation int"
#: Parts of a table up to which their names are broadcast.
BROADCAST_PARTS = 100_000


class Damaged(ValueError):
    """What lies there is not what the manifest says."""


def _part(columns: Sequence[str]) -> Column:
    """The name of a row's part."""
    return F.concat_ws("/", *(F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("null"))) for c in columns)) if columns else F.lit("all")


def _manifests(spark: SparkSession, root: str) -> DataFrame | None:
    try:
        return spark.read.schema(MANIFEST).json(f"{root}/manifests")
    except AnalysisException as gone:
        if "PATH_NOT_FOUND" in str(gone):
            return None
        raise


def manifest(spark: SparkSession, root: str, generation: int | None = None) -> DataFrame:
    """The rows of a generation, the newest by default; without any published, none."""
    every = _manifests(spark, root)
    if every is None:
        return spark.createDataFrame([], MANIFEST)
    if generation is None:
        generation = every.agg(F.max("generation")).first()[0]
    return every.where(F.col("generation") == F.lit(generation))


def _digests(df: DataFrame, columns: Sequence[str], *more: str) -> DataFrame:
    """(part, ``more``, rows, digest): an order-free sum of the digests of rows, by the columns that are stored in files; the others are the part's name."""
    stored = sorted(c for c in df.columns if c not in (*columns, *more))
    row = F.md5(F.to_json(F.struct(*stored)) if stored else F.lit(""))
    total = F.sum(F.conv(F.substring(row, 1, 15), 16, 10).cast("decimal(20,0)")).cast("decimal(38,0)")
    return df.withColumn("_part", _part(columns)).groupBy(F.col("_part").alias("part"), *more).agg(F.count("*").alias("rows"), total.alias("digest"))


def _kept(df: DataFrame, columns: Sequence[str], parts: DataFrame) -> DataFrame:
    small = parts.limit(BROADCAST_PARTS + 1).count() <= BROADCAST_PARTS
    wanted = parts.select(F.col("part").alias("_part"))
    return df.withColumn("_part", _part(columns)).join(F.broadcast(wanted) if small else wanted, "_part", "left_semi").drop("_part")


def publish(spark: SparkSession, root: str, tables: Mapping[str, tuple[DataFrame, Sequence[str]]], fetched_at: str, replace: bool = True) -> int:
    """Publishes ``tables`` (name to frame and partition columns) as the next generation; returns its number.

    Tables that are not given stay as they are. A given table is replaced as a whole, or with ``replace`` off only the parts that it brings. Only changed
    parts are written; they are read back and compared before the manifest is written. A frame is worked out once, into ``staged``: what is compared, written and
    read back against it are passes over stored rows.
    """
    before = manifest(spark, root)
    last = before.agg(F.max("generation")).first()[0]
    lines = before.where(~F.col("table").isin(*tables)).drop("generation")
    for name, (df, columns) in tables.items():
        old = before.where(F.col("table") == name)
        df = settled(df, f"{root}/staged/{uuid.uuid4().hex}")
        now = _digests(df, columns)
        prior = old.select("part", "path", "available_at", "fetched_at", F.col("rows").alias("_rows"), F.col("digest").alias("_digest"))
        kind = df.schema.json()
        same = (F.col("rows") == F.col("_rows")) & (F.col("digest") == F.col("_digest"))
        compared = settled(now.join(prior, "part", "left").withColumn("_same", F.coalesce(same, F.lit(False))), f"{root}/staged/{uuid.uuid4().hex}")
        path = f"data/{name}/{uuid.uuid4().hex}"
        changed = compared.where(~F.col("_same"))
        if not changed.isEmpty():
            staged = _kept(df, columns, changed)
            if columns:
                staged.hint("rebalance", *columns).write.partitionBy(*columns).parquet(f"{root}/{path}")
            else:
                staged.write.parquet(f"{root}/{path}")
            wrong = _digests(spark.read.schema(df.schema).parquet(f"{root}/{path}"), columns).join(changed.select("part", "rows", "digest"), ["part", "rows", "digest"], "full_outer")
            if wrong.count() != changed.count():
                raise Damaged(f"{name} as written is not what was given")
        own = compared.select(
            F.lit(name).alias("table"), "part", F.when(F.col("_same"), F.col("path")).otherwise(F.lit(path)).alias("path"), "rows", "digest",
            F.when(F.col("_same"), F.col("available_at")).otherwise(F.lit(fetched_at)).alias("available_at"), F.when(F.col("_same"), F.col("fetched_at")).otherwise(F.lit(fetched_at)).alias("fetched_at"), F.lit(kind).alias("columns"),
        )
        lines = lines.unionByName(own)
        if not replace:
            lines = lines.unionByName(old.drop("generation").join(own.select("part"), "part", "left_anti").select(*own.columns))
    number = (last or 0) + 1
    lines.withColumn("generation", F.lit(number)).coalesce(1).write.mode("append").json(f"{root}/manifests")  # a row a part
    return number


def settled(df: DataFrame, path: str) -> DataFrame:
    """Written, so that what is published is what was compared."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _schema(lines: DataFrame, name: str) -> T.StructType:
    one = lines.where(F.col("table") == name).select("columns").first()
    if one is None:
        raise Damaged(f"no table {name} is published")
    return T.StructType.fromJson(json.loads(one[0]))


def _columns(part: str) -> list[str]:
    return [] if part == "all" else [p.split("=", 1)[0] for p in part.split("/")]


def _stored(spark: SparkSession, root: str, lines: DataFrame, name: str) -> tuple[DataFrame, list[str]]:
    """(rows with the ``_path`` that they were read from, partition columns): everything in the folders that the manifest names."""
    schema = _schema(lines, name)
    own = lines.where(F.col("table") == name)
    columns = _columns(own.select("part").first()[0])
    out = None
    for (path,) in own.select("path").distinct().collect():  # a folder a generation that brought something
        try:
            part = spark.read.schema(schema).option("basePath", f"{root}/{path}").parquet(f"{root}/{path}")
        except AnalysisException as gone:
            if "PATH_NOT_FOUND" not in str(gone):
                raise
            part = spark.createDataFrame([], schema)
        part = part.withColumn("_path", F.lit(path))
        out = part if out is None else out.unionByName(part)
    return out, columns


def verify(spark: SparkSession, root: str, name: str, generation: int | None = None) -> DataFrame:
    """(part, rows, state): ``ok``, ``changed`` (rows or digest differ), ``missing`` (in the manifest alone) or ``unlisted`` (a part that no generation's manifest names)."""
    lines = manifest(spark, root, generation).where(F.col("table") == name)
    stored, columns = _stored(spark, root, lines, name)
    found = _digests(stored, columns, "_path")
    known = _manifests(spark, root).where(F.col("table") == name).select("part", F.col("path").alias("_path")).distinct().withColumn("_known", F.lit(True))
    listed = lines.select("part", F.col("path").alias("_path"), F.col("rows").alias("_rows"), F.col("digest").alias("_digest"))
    both = listed.join(found, ["part", "_path"], "full_outer").join(known, ["part", "_path"], "left")
    state = F.when(F.col("rows").isNull(), "missing").when(F.col("_rows").isNull(), "unlisted").when((F.col("rows") == F.col("_rows")) & (F.col("digest") == F.col("_digest")), "ok").otherwise("changed")
    return both.where("_rows is not null or _known is null").select("part", F.coalesce("rows", F.lit(0)).alias("rows"), state.alias("state"))


def read(spark: SparkSession, root: str, name: str, generation: int | None = None, checked: bool = True) -> DataFrame:
    """A table of a generation; ``checked`` refuses it if any of its parts is not what the manifest says."""
    lines = manifest(spark, root, generation).where(F.col("table") == name)
    if checked:
        bad = verify(spark, root, name, generation).where("state <> 'ok'").limit(5).collect()
        if bad:
            raise Damaged(f"{name}: " + ", ".join(f"{r.part} is {r.state}" for r in bad))
    stored, columns = _stored(spark, root, lines, name)
    wanted = lines.select(F.col("part").alias("_part"), F.col("path").alias("_path"))
    return stored.withColumn("_part", _part(columns)).join(wanted, ["_part", "_path"], "left_semi").drop("_part", "_path")


def freeze(spark: SparkSession, root: str, release: str, required: Iterable[str], generation: int | None = None) -> str:
    """Pins a generation as a copy of its own below ``releases/<release>``, checked part by part; returns its root.

    Every required table must be there with rows and be whole. A release that exists is not touched: it is checked, and must have what is required.
    """
    own = f"{root}/releases/{release}"
    required = sorted(required)
    pinned = manifest(spark, own)
    exists = not pinned.isEmpty()
    lines = pinned if exists else manifest(spark, root, generation)
    filled = {r[0] for r in lines.groupBy("table").agg(F.sum("rows").alias("n")).where("n > 0").select("table").collect()}  # tables
    if lacking := [n for n in required if n not in filled]:
        raise Damaged(f"release {release} lacks {', '.join(lacking)}")
    if exists:
        for name in required:
            read(spark, own, name)
        return own
    names = [r[0] for r in lines.select("table").distinct().collect()]
    copies = {n: (read(spark, root, n, generation), _columns(lines.where(F.col("table") == n).select("part").first()[0])) for n in sorted(names)}
    stamps = lines.select("table", "part", "available_at", "fetched_at")
    publish(spark, f"{own}/incoming", copies, "")
    there = manifest(spark, f"{own}/incoming").drop("available_at", "fetched_at").join(stamps, ["table", "part"])
    if there.count() != lines.count():
        raise Damaged(f"release {release}: the copy has other parts")
    placed = there.withColumn("path", F.concat(F.lit("incoming/"), "path"))
    placed.coalesce(1).write.mode("append").json(f"{own}/manifests")
    return own


def replace_guarded(spark: SparkSession, root: str, name: str, new: DataFrame, part: str, keys: Sequence[str], fetched_at: str, **limits: object) -> DataFrame:
    """Replaces the parts of a published table that the guards let pass, and returns the decision about each part.

    Parts whose new rows are none, lose keys where that is not allowed, or lose too many, stay as they were.
    """
    old = read(spark, root, name)
    decided = settled(overwrite_decisions(old, new, part, keys, **limits), f"{root}/staged/{uuid.uuid4().hex}")
    passed = decided.where("action = 'overwrite' and new_rows > 0").select(part)
    publish(spark, root, {name: (new.join(passed, part, "left_semi").select(old.columns), [part])}, fetched_at, replace=False)
    return decided

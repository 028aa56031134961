"""Product codes of vectors: codebooks by part, distances by exact matrix products of limbs.

Integers are broken into limbs so narrow that no float64 product of a row of one limb matrix with a row of another reaches 2^53:
every such product is exact whatever the order of additions, and shifted sums of them in int64 are the exact dot products.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, join_counted, modest_batches, written
from .vectors import finite, floors, integers, kept, scaled_range, sums_by

RESULT = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"


def limb_bits(length: int) -> int:
    """The widest limb with ``length`` products of two limbs below 2^53."""
    return (53 - (length - 1).bit_length()) // 2


def limbs(values: np.ndarray, width: int) -> list[np.ndarray]:
    """Float64 matrices that, shifted by ``width`` bits each, add up to ``values``; the last has the sign."""
    out = []
    while True:
        if not len(values) or -(1 << width) < values.min() <= values.max() < 1 << width:
            return [*out, values.astype(np.float64)]
        out.append((values & ((1 << width) - 1)).astype(np.float64))
        values = values >> width


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact ``left @ right.T`` of int64 matrices whose dot products fit int64."""
    width = limb_bits(left.shape[1])
    out = np.zeros((len(left), len(right)), np.int64)
    for i, a in enumerate(limbs(left, width)):
        for j, b in enumerate(limbs(right, width)):
            out += (a @ b.T).astype(np.int64) << (width * (i + j))
    return out


def nearest(rows: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of each row; the first of equally near entries."""
    apart = (entries * entries).sum(axis=1)[None] - 2 * products(rows, entries)
    best = apart.argmin(axis=1)
    return best, apart[np.arange(len(rows)), best] + (rows * rows).sum(axis=1)


def _length(vectors: DataFrame, parts: int) -> int:
    """The length of most finite vectors that can be cut into ``parts`` (the longer of equally frequent ones); 0 without any."""
    sizes = vectors.select(F.col("embedding").cast("array<double>").alias("_v")).where(finite(F.col("_v")) & (F.size("_v") > 0) & (F.size("_v") % parts == 0))
    most = sizes.groupBy(F.size("_v").alias("length")).count().orderBy(F.col("count").desc(), F.col("length").desc()).first()
    return most[0] if most else 0


def codes(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> DataFrame:
    """Each kept vector with its code (two hex digits a part), its squared error, and the error of all vectors of its label.

    Dropped are null vectors and those with null, NaN or infinite components; the rest become ``floor(scale * x)`` and are cut into
    ``parts`` equal consecutive parts. Vectors of another length than most (which cannot be compared) are dropped too. Each part's
    codebook starts as that part of the ``entries`` (at most 256) vectors with the least ids, ascending (repeated ids in the order of their
    vectors, null ids last; fewer vectors make fewer entries). Every round assigns all parts, equal distances to the lower
    index, and replaces each entry in use by the floors of its parts' means. Repeated rows are vectors of their own; null labels are one
    label; no kept vector gives no row; extra columns are ignored. Components whose distances would not fit 64 bits are an error.

    Tasks hand on one row an entry, so no group of equal vectors meets anywhere; the driver holds the codebooks alone.
    """
    if not 0 < entries <= 256:
        raise ValueError("two hex digits name at most 256 entries")
    spark = vectors.sparkSession
    modest_batches(spark)
    length = _length(vectors, parts)
    given = kept(vectors, length, F.col("label").alias("label")) if length else None
    span = scaled_range(given, scale) if length else None
    if span is None:
        return spark.createDataFrame([], RESULT)
    if length * (2 * max(-span[0], span[1]) + 1) ** 2 >= 1 << 63:
        raise ValueError("distances of these components do not fit 64 bits")
    own = length // parts

    def to_integers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = pa.array(integers(batch.column(2), scale, length).ravel())
            ends = pa.array(np.arange(len(batch) + 1, dtype=np.int32) * length)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(ends, flat)], ["vec_id", "label", "v"])

    label = dict(given.dtypes)["label"]
    rows = written(given.mapInArrow(to_integers, f"vec_id long, label {label}, v array<long>"), "vectors")
    least = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()  # ``entries`` rows
    first = np.array([r[0] for r in least], np.int64)
    books = [first[:, own * k : own * (k + 1)].copy() for k in range(parts)]
    for _ in range(rounds):
        for part, entry, n, total in _sums(rows, books):
            books[part][entry] = floors(total, n)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch.column(2))
            found = [nearest(v[:, own * k : own * (k + 1)], books[k]) for k in range(parts)]
            code = np.stack([best for best, _ in found], axis=1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([bytes(c).hex() for c in code], pa.string()), pa.array(sum(apart for _, apart in found))], ["vec_id", "label", "code", "error"])

    coded = written(rows.mapInArrow(assign, f"vec_id long, label {label}, code string, error long"), "codes")
    forget(rows)
    keyed = coded.select("vec_id", "code", "error", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("")).alias("_label"))
    by_label = written(keyed.groupBy("_label").agg(F.count("*").alias("_n"), F.sum("error").alias("label_error")), "label_errors")
    digest = hashlib.sha256(",".join(str(x) for book in books for entry in book.tolist() for x in entry).encode()).hexdigest()
    return join_counted(keyed, by_label, "_label", "_n").select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _sums(rows: DataFrame, books: list[np.ndarray]) -> list[tuple[int, int, int, list[int]]]:
    """(part, entry, vectors, sums by component) of the entries in use: tasks sum their own first."""
    parts, own = len(books), books[0].shape[1]

    def part_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = [np.zeros(len(b), np.int64) for b in books], [np.zeros(b.shape, np.int64) for b in books]
        for batch in batches:
            v = _matrix(batch.column(2))
            for k in range(parts):
                piece = v[:, own * k : own * (k + 1)]
                best, _ = nearest(piece, books[k])
                n[k] += np.bincount(best, minlength=len(books[k]))
                total[k] += sums_by(best, piece, len(books[k]))
        for k in range(parts):
            used = np.flatnonzero(n[k])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), k, np.int32)), pa.array(used.astype(np.int32)), pa.array(n[k][used]), pa.array(total[k][used].tolist(), pa.list_(pa.int64()))], ["part", "entry", "n", "total"])

    sums = rows.mapInArrow(part_sums, "part int, entry int, n long, total array<long>")
    added = sums.groupBy("part", "entry").agg(F.sum("n"), F.array(*(F.sum(F.col("total")[k]) for k in range(own))))
    return [tuple(r) for r in added.collect()]  # parts x entries

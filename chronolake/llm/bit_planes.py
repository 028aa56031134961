"""Centroid clustering over bit planes: exact dot products by AND and population count.

A vector of 64 integers is kept as one 64-bit word a bit of its two's complement: word i holds bit i of every component.
Since a component is the weighted sum of its bits (the top bit weighs negative), the dot product of two vectors is the sum over
pairs of their planes of both weights times the bits that both planes have, and a squared distance is two such norms and a dot product.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, modest_batches, written
from .vectors import floors, integers, kept, scaled_range, sums_by

#: Components of a vector: the bits of a word.
WIDTH = 64
#: With more planes, the square of a distance would not fit 64 bits.
MOST_PLANES = 28

RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def planes_needed(low: int, high: int) -> int:
    """Bits of two's complement that hold ``low`` to ``high``."""
    bits = max((low if low >= 0 else -low - 1).bit_length(), (high if high >= 0 else -high - 1).bit_length()) + 1
    if bits > MOST_PLANES:
        raise ValueError(f"scaled components need {bits} bits; distances fit 64 bits up to {MOST_PLANES}")
    return bits


def weights(bits: int) -> np.ndarray:
    return np.array([1 << i for i in range(bits - 1)] + [-(1 << (bits - 1))], np.int64)


def pack(values: np.ndarray, bits: int) -> np.ndarray:
    """(bits, rows) words of the rows of 64 integers."""
    ones = (values[None] >> np.arange(bits)[:, None, None]) & 1
    return np.packbits(ones.astype(np.uint8), axis=-1, bitorder="little").view("<u8")[..., 0]


def unpack(words: np.ndarray) -> np.ndarray:
    """The integers of (bits, rows) words."""
    out = np.zeros((words.shape[1], WIDTH), np.int64)
    for weight, plane in zip(weights(len(words)), words, strict=True):
        out += weight * np.unpackbits(np.ascontiguousarray(plane).view(np.uint8).reshape(-1, 8), axis=-1, bitorder="little")
    return out


def _paired(left: np.ndarray, right: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
    """Weighted counts of common bits of planes (bits, ...): planes whose weights multiply to the same power are counted together."""
    bits, dot = len(left), np.zeros(shape, np.int64)
    for power in range(2 * bits - 1):
        common = np.zeros(shape, np.int16)
        for i in range(max(0, power - bits + 1), min(bits, power + 1)):
            count = np.bitwise_count(left[i] & right[power - i])
            if (i == bits - 1) != (power - i == bits - 1):
                common -= count
            else:
                common += count
        dot += common.astype(np.int64) << power
    return dot


def dots(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """(centroids, rows): the exact dot products of planes (bits, rows) with planes (bits, centroids)."""
    return _paired(rows[:, None, :], centroids[:, :, None], (centroids.shape[1], rows.shape[1]))


def norms(rows: np.ndarray) -> np.ndarray:
    return _paired(rows, rows, (rows.shape[1],))


def nearest(rows: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(centroid, squared distance) of each row; of equally near ones the smaller number."""
    apart = norms(centroids)[:, None] - 2 * dots(rows, centroids)
    best = apart.argmin(axis=0)
    return best, apart[best, np.arange(rows.shape[1])] + norms(rows)


def _words(batch: pa.RecordBatch, bits: int) -> np.ndarray:
    return np.ascontiguousarray(batch.column(1).flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, bits).T)


def cluster(vectors: DataFrame, count: int = 40, rounds: int = 5, scale: int = 256, salt: str = "2") -> DataFrame:
    """Each kept vector with its centroid after ``rounds`` rounds, its squared distance and the sums of these.

    Kept are vectors of exactly 64 components, none null, NaN or infinite, each ``floor(scale * x)``. Centroids start as the
    ``count`` vectors (all, if there are fewer) with the least sha256 of ``salt:vec_id``; equal hashes (repeated ids) go in the order of
    their vectors, and an id that is null counts as empty text. Every round assigns all vectors, equal distances to the
    smaller number, and replaces each centroid that has vectors by the floors of their means; a centroid without any stays, as all but
    the first of equal centroids do. Repeated rows are vectors of their own. No kept vector gives no row. Extra columns are
    ignored. Components that need more than ``MOST_PLANES`` bits are an error, since distances would not fit.

    Tasks hand on one row a centroid, so no group of equal vectors meets anywhere; the driver holds ``count`` centroids.
    """
    spark = vectors.sparkSession
    modest_batches(spark)
    rows = kept(vectors, WIDTH)
    span = scaled_range(rows, scale)
    if span is None:
        return spark.createDataFrame([], RESULT)
    bits = planes_needed(*span)

    def to_planes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = pack(integers(batch.column(1), scale, WIDTH), bits)
            flat = pa.array(np.ascontiguousarray(words.T).view(np.int64).ravel())
            ends = pa.array(np.arange(len(batch) + 1, dtype=np.int32) * bits)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, flat)], ["vec_id", "planes"])

    packed = written(rows.mapInArrow(to_planes, "vec_id long, planes array<long>"), "planes")
    digest = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    chosen = rows.orderBy(digest, "_v").limit(count).select("_v").collect()  # ``count`` rows
    centroids = [np.floor(np.array(r[0]) * scale).astype(np.int64).tolist() for r in chosen]
    for _ in range(rounds):
        for number, n, total in _sums(packed, pack(np.array(centroids), bits), bits):
            centroids[number] = floors(total, n)
    final = pack(np.array(centroids), bits)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, apart = nearest(_words(batch, bits), final)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best.astype(np.int32)), pa.array(apart)], ["vec_id", "cluster", "distance"])

    placed = written(packed.mapInArrow(assign, "vec_id long, cluster int, distance long"), "clusters")
    forget(packed)
    inertia = {r[0]: r[1] for r in placed.groupBy("cluster").agg(F.sum("distance")).collect()}  # ``count`` rows at most
    whole = sum(inertia.values())
    facts = [(k, n, whole, hashlib.sha256(",".join(map(str, centroids[k])).encode()).hexdigest()) for k, n in inertia.items()]
    return placed.join(F.broadcast(spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")), "cluster").select(*(c.split()[0] for c in RESULT.split(", ")))


def _sums(packed: DataFrame, centroids: np.ndarray, bits: int) -> list[tuple[int, int, list[int]]]:
    """(centroid, vectors, sums by component) of the centroids that have vectors: tasks sum their own first."""
    count = centroids.shape[1]

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(count, np.int64), np.zeros((count, WIDTH), np.int64)
        for batch in batches:
            words = _words(batch, bits)
            best, _ = nearest(words, centroids)
            n += np.bincount(best, minlength=count)
            total += sums_by(best, unpack(words), count)
        own = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(n[own]), pa.array(total[own].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "total"])

    parts = packed.mapInArrow(part, "cluster int, n long, total array<long>")
    added = parts.groupBy("cluster").agg(F.sum("n"), F.array(*(F.sum(F.col("total")[k]) for k in range(WIDTH))))
    return [tuple(r) for r in added.collect()]

"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, tidy, written

#: Edges of a task.
AT_ONCE = 500_000


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are tied to its least neighbour (or itself)."""
    both = _both_ways(edges)
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are tied to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    tied = down.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return tied.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a task (``AT_ONCE`` together) as stars: each node with the least one that these edges tie it to."""
    held: list[np.ndarray] = []

    def out() -> pa.RecordBatch:
        nodes, at = np.unique(np.concatenate(held or [np.zeros((2, 0), np.int64)], axis=1), return_inverse=True)
        x, y = at.reshape(2, -1)
        label = np.arange(len(nodes))
        while (apart := label[x] != label[y]).any():
            x, y = x[apart], y[apart]
            low, high = np.minimum(label[x], label[y]), np.maximum(label[x], label[y])
            np.minimum.at(label, high, low)
            while (up := label[label]).tobytes() != label.tobytes():
                label = up
        own = label != np.arange(len(nodes))
        return pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(nodes[label[own]])], ["a", "b"])

    for batch in batches:
        held.append(np.stack([batch.column(k).to_numpy() for k in (0, 1)]))
        if sum(x.shape[1] for x in held) >= AT_ONCE:
            yield out()
            held.clear()
    yield out()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of ``edges`` (a, b); a component is its least node, nodes that are it are left out.

    Tasks of ``AT_ONCE`` edges first make stars of their own, so few rounds are left; edges that fit one task are not shuffled.
    Each round is written to the shared folder, so that neither lineage nor the loss of an executor repeats it.
    """
    given = edges.where("a != b").select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    with tidy(edges.sparkSession):
        tasks = max(1, -(-given.count() // AT_ONCE))
    stars = written(given.coalesce(tasks).mapInArrow(_contracted, "a long, b long"), "edges")
    state = None
    while True:
        before, stars = stars, written(_small_star(_large_star(stars.coalesce(tasks))), "stars")
        forget(before)
        with tidy(stars.sparkSession):
            now = tuple(stars.coalesce(tasks).agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == state:
            return stars.select(F.col("a").alias("node"), F.col("b").alias("component"))
        state = now

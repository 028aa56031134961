"""Best-fit packing with exact-complement hashing.

Only the histogram of piece lengths (``capacity`` entries at most) reaches the driver. For each length,
longest first, the gap that it leaves in a sequence is looked up among sums of one, two and three
lengths in stock; combinations that fill it exactly are consumed as often as the stock allows. What has
no exact complement goes best-fit, longest first. Either way the plan says how many sequences have which
lengths; pieces take their places by rank within their length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import modest_batches, written
from .tokens import ids_of

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long"
PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
END_ID = 0


def pieces(documents: DataFrame, capacity: int, tokenizer: str | None = None) -> DataFrame:
    """Cuts each document's ids and the end id into pieces of ``capacity``; ``nth`` counts a length within its task."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, task, seen = ids_of(tokenizer), TaskContext.get().partitionId(), Counter()
        end, width = END_ID.to_bytes(4, "little"), 4 * capacity
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = ids.of(text.as_py()) + end
                for k in range(0, len(data), width):
                    part = data[k : k + width]
                    n = len(part) // 4
                    rows.append((doc, k // width, k // 4, n, zlib.crc32(part), task, seen[n]))
                    seen[n] += 1
            columns = list(zip(*rows, strict=True)) or [()] * 7
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"])
        ids.clear()

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).mapInArrow(cut, PIECES)


class _Stock:
    """How many pieces of each length are left, with an index of the sums of one, two and three of them."""

    def __init__(self, counts: dict[int, int], capacity: int) -> None:
        self.n = np.zeros(capacity + 1, np.int64)
        for length, count in counts.items():
            self.n[length] = count
        self.index()

    def index(self) -> None:
        have = (self.n > 0).astype(np.float64)
        size = len(have)
        wide = 1 << (2 * size - 1).bit_length()
        f = np.fft.rfft(have, wide)
        self.two = np.fft.irfft(f * f, wide)[:size] > 0.5
        g = np.fft.rfft(self.two.astype(np.float64), wide)
        self.three = np.fft.irfft(f * g, wide)[:size] > 0.5

    def pair(self, total: int, most: int) -> tuple[int, int] | None:
        """The two lengths of this sum, the first as long as can be."""
        a = np.arange(min(most, total - 1), (total + 1) // 2 - 1, -1)
        ok = a[(self.n[a] > 0) & (self.n[total - a] > (2 * a == total))] if len(a) else a
        return (int(ok[0]), int(total - ok[0])) if len(ok) else None

    def fill(self, gap: int, most: int) -> tuple[int, ...] | None:
        """Lengths up to ``most`` that add up to ``gap``; the index only ever holds too much, so a miss is final."""
        if gap <= most and self.n[gap]:
            return (gap,)
        if self.two[gap] and (found := self.pair(gap, most)):
            return found
        if self.three[gap]:
            for a in range(min(most, gap - 2), (gap + 2) // 3 - 1, -1):
                if self.n[a] and self.two[gap - a]:
                    self.n[a] -= 1
                    found = self.pair(gap - a, a)
                    self.n[a] += 1
                    if found:
                        return (a, *found)
        return None


def plan(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, how many such sequences); places each piece counted in ``counts`` once."""
    out: list[tuple[tuple[int, ...], int]] = []
    stock, rest = _Stock(counts, capacity), {}
    if stock.n[capacity]:
        out.append(((capacity,), int(stock.n[capacity])))
        stock.n[capacity] = 0
    for length in range(capacity - 1, 0, -1):
        stale = False
        while stock.n[length]:
            stock.n[length] -= 1  # the one that leaves the gap
            found = stock.fill(capacity - length, length)
            stock.n[length] += 1
            if not found:
                if stale:  # lengths ran out since the sums were indexed
                    stock.index()
                break
            need = Counter((length, *found))
            times = min(int(stock.n[v]) // k for v, k in need.items())
            for v, k in need.items():
                stock.n[v] -= k * times
            stale = True
            out.append(((length, *found), times))
        if stock.n[length]:
            rest[length] = int(stock.n[length])
            stock.n[length] = 0
    return out + _best_fit(rest, capacity)


def _best_fit(rest: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over counts: alike sequences are kept as one group by their gap."""
    groups: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    gaps: list[int] = []

    def put(gap: int, lengths: tuple[int, ...], times: int) -> None:
        if times:
            if gap not in groups:
                groups[gap] = []
                gaps.insert(bisect_left(gaps, gap), gap)
            groups[gap].append((lengths, times))

    for length in sorted(rest, reverse=True):
        left = rest[length]
        while left:
            at = bisect_left(gaps, length)
            if at == len(gaps):
                gap, lengths, times = capacity, (), left
            else:
                gap = gaps[at]
                lengths, times = groups[gap].pop()
                if not groups[gap]:
                    del groups[gap]
                    gaps.pop(at)
            each = min(gap // length, left)
            full = min(times, left // each)
            put(gap - each * length, lengths + (length,) * each, full)
            left -= each * full
            if lengths:
                put(gap, lengths, times - full)
    return [g for gap in gaps for g in groups[gap]]


def _slots(sequences: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """(length, first rank, sequence of that rank, offset), sorted: ranks of a length take the slots in turn."""
    rows, used, base = [], Counter(), 0
    for lengths, times in sequences:
        at = 0
        for n in lengths:
            rows.append((n, used[n], base, at))
            used[n] += times
            at += n
        base += times
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def pack(documents: DataFrame, capacity: int = 2048, tokenizer: str | None = None) -> DataFrame:
    """Packs whole documents into few sequences of at most ``capacity`` ids.

    Returns a row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``. Null and
    empty texts are the end id alone; only documents longer than ``capacity`` are cut; repeated rows and
    null doc_ids are packed like any other; a very long text is cut in one task; no documents give no rows; extra
    columns are ignored.
    """
    modest_batches(documents.sparkSession)
    cut = written(pieces(documents, capacity, tokenizer), "pieces")
    per_task = cut.groupBy("length", "task").agg(F.count("*").alias("_n"))
    before = W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    base = per_task.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    counts = {r[0]: r[1] for r in per_task.groupBy("length").agg(F.sum("_n")).collect()}  # `capacity` rows at most
    slots = _slots(plan(counts, capacity))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = slots[:, 0] << 44 | slots[:, 1]
        for batch in batches:
            length, rank = (batch.column(k).to_numpy() for k in (3, 5))
            slot = slots[np.searchsorted(keys, length << 44 | rank, "right") - 1]
            sequence = slot[:, 2] + rank - slot[:, 1]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(5)), pa.array(sequence), pa.array(slot[:, 3])], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = cut.join(base, ["length", "task"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("nth") + F.col("_base")).alias("rank"))
    return ranked.mapInArrow(place, PLACED)

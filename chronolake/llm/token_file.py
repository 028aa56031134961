"""Token files: ids under an adaptive context-mixing range coder, in independent checksummed blocks.

A block holds up to ``BLOCK`` ids and starts from empty models, so any block can be read alone. Inside it an id is known by
its number in order of first sight. Each id is coded as one of: what followed the last two ids before (order 2), what followed the
last id before (order 1), another id seen in the block (order 0), or a new one. The frequencies of these outcomes are
the sum of three adaptive counts: by the confidence of order 2, by that of order 1, and overall. An order-0 id is then
coded by how often each id was seen in the block, a new one by how often new ids fell into each 1,024th of the vocabulary.
Blocks of a chunk are coded side by side, one id of each per step, as numpy lanes.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import modest_batches
from .tokens import ids_of

MAGIC = b"TKRC"
#: magic, ids, bytes of payload, crc32 of the ids
HEADER = struct.Struct("<4sIII")
BLOCK = 2048
#: Ids after which a chunk of whole documents is closed.
CHUNK = 2048 * BLOCK
#: Ids are below this.
VOCABULARY = 1 << 16
END_ID = 1

HIT2, HIT1, OLD, NEW = range(4)
#: Numbers of a group (their counts are summed by groups, then inside), and of ids of a bucket of the vocabulary.
GROUP, BUCKET = 32, 1024
GROUPS, BUCKETS = BLOCK // GROUP, VOCABULARY // BUCKET
SLOTS = 1 << 11
STEP, LIMIT, CHECKED = 24, 1 << 12, 32
TOP, BOTTOM = np.uint64(1 << 48), np.uint64(1 << 40)
U = np.uint64
#: A word of four ones: by it, a word of four counts gives their running sums.
ONES = U(0x0001000100010001)
GROUP_ENDS, BUCKET_ENDS = np.arange(1, GROUPS + 1, dtype=np.uint8)[:, None], np.arange(1, BUCKETS + 1, dtype=np.uint8)[:, None]
#: The next confidence after a miss and after a hit.
NEXT = np.array([1, 1, 1, 2, 1, 2, 3, 3], np.uint8)

CHUNKS = "shard int, chunk int, doc_ids array<long>, lengths array<long>, data binary"


class _Lanes:
    """The range coder's state and the models of all lanes."""

    def __init__(self, lengths: np.ndarray) -> None:
        n = len(lengths)
        self.lengths, self.lane = lengths, np.arange(n)
        self.low, self.range = np.zeros(n, U), np.full(n, (1 << 64) - 1, U)
        # What follows each context and how surely, by the last number and by a hash of the last two.
        self.follows = [np.zeros(n * SLOTS, np.uint16), np.zeros(n * SLOTS, np.uint16)]
        self.sure = [np.zeros(n * SLOTS, np.uint8), np.zeros(n * SLOTS, np.uint8)]
        self.base = self.lane * SLOTS
        # The counts of the four outcomes lie in one word, so that words add up side by side.
        self.by = [np.full(4 * n, ONES, U), np.full(4 * n, ONES, U), np.full(n, ONES, U)]
        # Counts of numbers, and their running sums by group and by bucket after a row of zeros.
        self.counts, self.groups = np.zeros((n * GROUPS, GROUP), np.uint16), np.zeros((GROUPS + 1, n), np.uint16)
        self.buckets = np.repeat(np.arange(BUCKETS + 1, dtype=np.uint16)[:, None], n, axis=1)
        self.one, self.two = np.zeros(n, np.int64), np.zeros(n, np.int64)  # the last number and the one before
        self.seen, self.steps = np.zeros(n, np.int64), 0

    def predict(self) -> None:
        """Guesses, and the running sums of the outcomes' frequencies."""
        self.at = [self.base + self.one, self.base + ((self.one * 0x9E37 + self.two * 0x6F4F >> 3) & (SLOTS - 1))]
        self.guess = [f.take(at) for f, at in zip(self.follows, self.at, strict=True)]
        self.known = [s.take(at) for s, at in zip(self.sure, self.at, strict=True)]
        self.rows = [4 * self.lane + self.known[1], 4 * self.lane + self.known[0], self.lane]
        sums = (self.by[0].take(self.rows[0]) + self.by[1].take(self.rows[1]) + self.by[2]) * ONES
        self.upto, self.before = sums.view(np.uint16), (sums << U(16)).view(np.uint16)

    def order0(self, lanes: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(begin, size) of numbers among the counts of their lanes."""
        group, place = numbers // GROUP, numbers % GROUP
        row = lanes * GROUPS + group
        inside = np.cumsum(self.counts.take(row, axis=0), axis=1, dtype=np.uint16)
        size = self.counts.ravel().take(row * GROUP + place)
        return self.groups[group, lanes] + inside.ravel().take(np.arange(len(lanes)) * GROUP + place).astype(np.int64) - size, size

    def find0(self, lanes: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number, begin, size): the numbers among whose counts the values lie; of a damaged lane, any number."""
        values = values.astype(np.uint16)
        group = np.minimum(np.add.reduce(self.groups[1:, lanes] <= values, axis=0, dtype=np.uint8).astype(np.int64), GROUPS - 1)
        row, before = lanes * GROUPS + group, self.groups[group, lanes]
        inside = np.cumsum(self.counts.take(row, axis=0), axis=1, dtype=np.uint16)
        place = np.minimum(np.add.reduce(inside <= (values - before)[:, None], axis=1, dtype=np.uint8).astype(np.int64), GROUP - 1)
        size = np.maximum(self.counts.ravel().take(row * GROUP + place), 1)
        return group * GROUP + place, before + inside.ravel().take(np.arange(len(lanes)) * GROUP + place).astype(np.int64) - size, size

    def learn(self, numbers: np.ndarray, outcome: np.ndarray, new: np.ndarray, new_ids: np.ndarray) -> None:
        for table, row in zip(self.by, self.rows, strict=True):
            table.view(np.uint16)[4 * row + outcome] += STEP
        self.steps += 1
        if self.steps % CHECKED == 0:
            for table in self.by:
                four = table.view(np.uint16).reshape(-1, 4)
                if len(full := np.flatnonzero((four > LIMIT).any(axis=1))):
                    four[full] = (four[full] + 1) >> 1
        for guess, known, follows, sure, at in zip(self.guess, self.known, self.follows, self.sure, self.at, strict=True):
            hit = guess == numbers
            hit &= known > 0
            sure[at] = NEXT.take(4 * hit + known)
            follows[at] = np.where(hit | (known > 1), guess, numbers)
        self.groups[1:] += GROUP_ENDS > (numbers // GROUP).astype(np.uint8)
        self.counts.ravel()[self.lane * BLOCK + numbers] += 1
        if len(new):
            bucket = np.full(len(self.lane), BUCKETS, np.uint8)
            bucket[new] = new_ids // BUCKET
            self.buckets[1:] += BUCKET_ENDS > bucket
            self.seen[new] += 1
        self.two, self.one = self.one, numbers

    def narrow(self, start: np.ndarray, size: np.ndarray, total: np.ndarray) -> None:
        unit = self.range // total.astype(U)
        self.low += start.astype(U) * unit
        self.range = size.astype(U) * unit

    def due(self) -> np.ndarray:
        """Lanes whose top 16 bits are settled."""
        split = (self.low ^ (self.low + self.range)) >= TOP
        due = np.flatnonzero(~split | (self.range < BOTTOM))
        if len(due):
            forced = due[split[due]]
            self.range[forced] = (~self.low[forced] + U(1)) & (BOTTOM - U(1))
        return due

    def shift(self, due: np.ndarray) -> None:
        self.low[due] <<= U(16)
        self.range[due] <<= U(16)


def _split(n: int) -> np.ndarray:
    """Lengths of the blocks of ``n`` ids."""
    return np.array([BLOCK] * (n // BLOCK) + [n % BLOCK] * (n % BLOCK > 0), np.int64)


def encode(ids: np.ndarray) -> bytes:
    """The blocks of ``ids`` (below ``VOCABULARY``), one after another."""
    if len(ids) and not 0 <= ids.min() <= ids.max() < VOCABULARY:
        raise ValueError(f"ids from 0 to {VOCABULARY - 1} can be written")
    lengths = _split(len(ids))
    n = len(lengths)
    if not n:
        return b""
    grid = np.zeros(n * BLOCK, np.int64)
    grid[: len(ids)] = ids
    grid = grid.reshape(n, BLOCK)
    number, first = _numbers(grid)
    lanes = _Lanes(lengths)
    out, used = np.zeros((n, 3 * BLOCK + 8), np.uint16), np.zeros(n, np.int64)

    def emit() -> None:
        while len(due := lanes.due()):
            out[due, used[due]] = (lanes.low[due] >> U(48)).astype(np.uint16)
            used[due] += 1
            lanes.shift(due)

    shortest = int(lengths.min())
    for t in range(int(lengths.max())):
        lanes.predict()
        own, new = number[:, t], np.flatnonzero(first[:, t])
        hit2, hit1 = (lanes.known[1] > 0) & (lanes.guess[1] == own), (lanes.known[0] > 0) & (lanes.guess[0] == own)
        outcome = np.where(hit2, HIT2, np.where(hit1, HIT1, OLD))
        outcome[new] = NEW  # a new number was not followed by anything, but an empty table may say 0
        at = 4 * lanes.lane + outcome
        begin, size, total = lanes.before.take(at), lanes.upto.take(at), lanes.upto[3::4].copy()
        size -= begin
        dead = np.flatnonzero(t >= lengths) if t >= shortest else ()
        if len(dead):
            begin[dead], size[dead], total[dead] = 0, 1, 1
            outcome[dead] = HIT2
            new = new[t < lengths[new]]
        lanes.narrow(begin, size, total)
        begin, size, total = np.zeros(n, np.int64), np.ones(n, np.int64), np.ones(n, np.int64)
        if len(old := np.flatnonzero(outcome == OLD)):
            begin[old], size[old] = lanes.order0(old, own[old])
            total[old] = t
        if len(new):
            ids_ = grid[new, t]
            bucket = ids_ // BUCKET
            before = lanes.buckets[bucket, new].astype(np.int64)
            size[new] = lanes.buckets[bucket + 1, new] - before
            begin[new] = before * BUCKET + ids_ % BUCKET * size[new]
            total[new] = lanes.buckets[BUCKETS, new].astype(np.int64) * BUCKET
        lanes.narrow(begin, size, total)
        emit()
        lanes.learn(own, outcome, new, grid[new, t])
    for _ in range(4):
        out[lanes.lane, used] = (lanes.low >> U(48)).astype(np.uint16)
        used += 1
        lanes.low <<= U(16)
    parts = []
    for k in range(n):
        data = out[k, : used[k]].astype("<u2").tobytes()
        parts += [HEADER.pack(MAGIC, int(lengths[k]), len(data), zlib.crc32(grid[k, : lengths[k]].astype("<u4").tobytes())), data]
    return b"".join(parts)


def _numbers(grid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each id of a row: its number in the row's order of first sight, and whether it is the first."""
    n, width = grid.shape
    number, first = np.empty_like(grid), np.zeros(grid.shape, bool)
    for k in range(n):
        _, at, back = np.unique(grid[k], return_index=True, return_inverse=True)
        first[k, at] = True
        rank = np.empty(len(at), np.int64)
        rank[np.argsort(at)] = np.arange(len(at))
        number[k] = rank[back]
    return number, first


def decode(data: bytes) -> np.ndarray:
    """All ids of the blocks in ``data``; a damaged or cut block is a ValueError.

    A damaged block decodes to other ids, never reading beyond its payload, until its checksum refuses them.
    """
    heads, at = [], 0
    while at < len(data):
        if len(data) - at < HEADER.size:
            raise ValueError(f"the header at byte {at} is cut")
        magic, count, size, crc = HEADER.unpack_from(data, at)
        if magic != MAGIC or not 0 < count <= BLOCK:
            raise ValueError(f"no block at byte {at}")
        if size % 2 or size > len(data) - at - HEADER.size:
            raise ValueError(f"the block at byte {at} is cut")
        heads.append((count, size, crc, at + HEADER.size))
        at += HEADER.size + size
    if not heads:
        return np.zeros(0, np.int64)
    n = len(heads)
    lengths = np.array([h[0] for h in heads], np.int64)
    words = np.zeros((n, max(h[1] for h in heads) // 2 + 8), np.uint16)
    for k, (_, size, _, start) in enumerate(heads):
        words[k, : size // 2] = np.frombuffer(data, "<u2", size // 2, start)
    lanes = _Lanes(lengths)
    code, used = np.zeros(n, U), np.zeros(n, np.int64)
    for _ in range(4):
        code = code << U(16) | words[lanes.lane, used]
        used += 1
    width, last = int(lengths.max()), words.shape[1] - 1
    numbers, book = np.zeros((n, width), np.int64), np.zeros((n, BLOCK), np.int64)

    def absorb() -> None:
        while len(due := lanes.due()):
            code[due] = code[due] << U(16) | words[due, np.minimum(used[due], last)]
            used[due] += 1
            lanes.shift(due)

    def at_scale(total: np.ndarray) -> np.ndarray:
        return np.minimum((code - lanes.low) // (lanes.range // total.astype(U)), (total - 1).astype(U)).astype(np.int64)

    shortest = int(lengths.min())
    for t in range(width):
        lanes.predict()
        total = lanes.upto[3::4].copy()
        dead = np.flatnonzero(t >= lengths) if t >= shortest else ()
        if len(dead):
            total[dead] = 1
        value = at_scale(total)
        outcome = (lanes.upto[0::4] <= value).astype(np.int64) + (lanes.upto[1::4] <= value) + (lanes.upto[2::4] <= value)
        if len(dead):
            outcome[dead] = HIT2
        at = 4 * lanes.lane + outcome
        begin, size = lanes.before.take(at), lanes.upto.take(at)
        size -= begin
        if len(dead):
            begin[dead], size[dead] = 0, 1
        lanes.narrow(begin, size, total)
        old, new = np.flatnonzero(outcome == OLD), np.flatnonzero(outcome == NEW)
        begin, size, total = np.zeros(n, np.int64), np.ones(n, np.int64), np.ones(n, np.int64)
        total[old] = max(t, 1)  # a damaged block may begin with an old id
        if len(new):
            total[new] = lanes.buckets[BUCKETS, new].astype(np.int64) * BUCKET
        value = at_scale(total)
        own = np.where(outcome == HIT2, lanes.guess[1], lanes.guess[0]).astype(np.int64)
        if len(old):
            own[old], begin[old], size[old] = lanes.find0(old, value[old])
        ids = np.zeros(0, np.int64)
        if len(new):
            bucket = np.add.reduce(lanes.buckets[1:, new] <= (value[new] // BUCKET).astype(np.uint16), axis=0, dtype=np.uint8).astype(np.int64)
            before = lanes.buckets[bucket, new].astype(np.int64)
            size[new] = lanes.buckets[bucket + 1, new] - before
            before *= BUCKET
            place = (value[new] - before) // size[new]
            begin[new] = before + place * size[new]
            ids, own[new] = bucket * BUCKET + place, lanes.seen[new]
            book[new, own[new]] = ids
        lanes.narrow(begin, size, total)
        absorb()
        numbers[:, t] = own
        lanes.learn(own, outcome, new, ids)
    out = np.take_along_axis(book, numbers, axis=1)
    for k, (count, _, crc, start) in enumerate(heads):
        if zlib.crc32(out[k, :count].astype("<u4").tobytes()) != crc:
            raise ValueError(f"the block at byte {start - HEADER.size} is damaged")
    return out[np.arange(out.shape[1]) < lengths[:, None]]


def write(documents: DataFrame, path: str, tokenizer: str | None = None) -> None:
    """Writes the ids of whole texts, in ascending doc_id order, with the end id after each document.

    The file is a folder of chunks that Spark's own committer publishes: ``shard`` and ``chunk`` order
    them, ``doc_ids`` and ``lengths`` say what is inside, ``data`` holds the blocks. Null and empty texts
    are the end id alone; repeated rows stay, equal doc_ids in the order of their texts; null doc_ids
    come first; no documents make an empty file; extra columns are ignored.
    """

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, shard, chunk = ids_of(tokenizer), TaskContext.get().partitionId(), 0
        end = END_ID.to_bytes(4, "little")
        docs: list[int | None] = []
        sizes: list[int] = []
        held: list[bytes] = []

        def closed() -> pa.RecordBatch:
            data = encode(np.frombuffer(b"".join(held), "<u4").astype(np.int64))
            kinds = (pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((shard, chunk, docs, sizes, data), kinds, strict=True)], ["shard", "chunk", "doc_ids", "lengths", "data"])

        total = 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held.append(ids.of(text.as_py()) + end)
                docs.append(doc)
                sizes.append(len(held[-1]) // 4)
                total += sizes[-1]
                if total >= CHUNK:
                    yield closed()
                    docs, sizes, held, total, chunk = [], [], [], 0, chunk + 1
        if docs:
            yield closed()
        ids.clear()

    modest_batches(documents.sparkSession)
    spark = documents.sparkSession
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(chunks, CHUNKS).write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Each document of a token file, from its decoded ids: ``doc_id, start, n_tokens, ids_crc32``."""
    file = spark.read.schema(CHUNKS).parquet(path)
    # One row for each chunk of millions of ids: the only thing that is put in one order.
    sizes = file.select("shard", "chunk", F.aggregate("lengths", F.lit(0).cast("long"), lambda a, b: a + b).alias("n"))
    before = W.orderBy("shard", "chunk").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("shard", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, docs, lengths, data in zip(*(batch.column(k) for k in range(4)), strict=True):
                ids = decode(data.as_py()).astype("<u4").tobytes()
                sizes = np.array(lengths.as_py(), np.int64)
                ends = np.cumsum(sizes)
                if len(ids) != 4 * ends[-1]:
                    raise ValueError("a chunk holds other ids than its index says")
                crcs = [zlib.crc32(ids[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(docs.as_py(), pa.int64()), pa.array(first.as_py() + ends - sizes), pa.array(sizes), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    placed = file.join(starts, ["shard", "chunk"]).select("first", "doc_ids", "lengths", "data")
    return placed.mapInArrow(documents, "doc_id long, start long, n_tokens long, ids_crc32 long")

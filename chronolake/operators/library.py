"""A text library laid out for search: titles, bodies by shard, and an inverted table of body trigrams that bounds a pattern before bodies are read."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from re import _constants as op  # what ``re.compile`` reads a pattern into
from re import _parser as reader

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .candidates import BROADCAST_ROWS, candidate_rows
from .text import guarded

GRAM = 3
#: Texts and characters of a block of postings.
BLOCK_TEXTS, BLOCK_CHARS = 4096, 4_000_000


@dataclass(frozen=True)
class Library:
    """Paths of a library that ``build`` wrote, and the folders of its grams."""

    index: str
    bodies: str
    grams: str
    buckets: int


def _caseless(c: str) -> bool:
    """Letters that every engine folds alike: ASCII, and those without case."""
    return c.isascii() or c.lower() == c.upper()


def literals(pattern: str) -> list[list[str]]:
    """Ways to match, each the lower-case strings of three or more characters that such a match holds; no way: the pattern cannot be bounded.

    A way without strings would bound nothing, so one such alternative leaves the whole pattern unbounded.
    """

    def ways(items) -> list[list[str]]:
        out, run = [[]], ""

        def close() -> None:
            nonlocal run
            if len(run) >= GRAM:
                for way in out:
                    way.append(run)
            run = ""

        for kind, value in items:
            if kind is op.LITERAL and _caseless(chr(value)):
                run += chr(value).lower()
                continue
            close()
            inner = None
            if kind is op.SUBPATTERN:
                inner = ways(value[-1])
            elif kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT) and value[0] > 0:
                inner = ways(value[2])
            elif kind is op.BRANCH:
                inner = [w for branch in value[1] for w in ways(branch)]
            if inner is not None and len(out) * len(inner) <= 64:  # beyond, this part bounds nothing
                out = [a + b for a in out for b in inner]
        close()
        return out

    found = ways(reader.parse(pattern, re.IGNORECASE))
    return found if all(found) else []


def _block_grams(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct trigrams of a block of texts in order, where the list of each begins (and the last ends), and the texts of all lists by number.

    A (gram, text) is one number, with the gram's characters counted among those of the block, so one sort finds the lists.
    """
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    own = np.repeat(np.arange(len(texts)), [len(s) for s in texts])
    alphabet = np.flatnonzero(np.bincount(points, minlength=1))
    size = len(alphabet)
    if len(texts) > 1 and size**3 * len(texts) >= 2**63:
        raise OverflowError
    rank = np.zeros(int(alphabet[-1]) + 1 if size else 1, dtype=np.uint64)
    rank[alphabet] = np.arange(size, dtype=np.uint64)
    c = rank[points]
    keys = ((c[:-2] * np.uint64(size) + c[1:-1]) * np.uint64(size) + c[2:]) * np.uint64(len(texts)) + own[:-2].astype(np.uint64)
    keys = np.sort(keys[own[:-2] == own[2:]])
    keys = keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys
    gram, text = np.divmod(keys, np.uint64(max(len(texts), 1)))
    starts = np.flatnonzero(np.append(True, gram[1:] != gram[:-1])) if len(gram) else np.zeros(0, dtype=np.int64)
    first = gram[starts].astype(np.int64)
    chars = [alphabet[first // size**k % max(size, 1)].tolist() for k in (2, 1, 0)] if size else [[], [], []]
    return ["".join(map(chr, g)) for g in zip(*chars, strict=True)], np.append(starts, len(keys)).astype(np.int32), text.astype(np.int64)


def _post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, ids) of bodies (text_id, body), a row a gram and block of texts; a block ends with ``BLOCK_TEXTS`` or ``BLOCK_CHARS``."""

    def rows(ids: pa.Array, texts: list[str]) -> Iterator[pa.RecordBatch]:
        try:
            grams, offsets, own = _block_grams(texts)
        except OverflowError:  # more characters than a number holds with so many texts
            half = len(texts) // 2
            yield from rows(ids[:half], texts[:half])
            yield from rows(ids[half:], texts[half:])
            return
        for at in range(0, len(grams), 10_000):
            part = offsets[at : at + 10_001]
            lists = pa.ListArray.from_arrays(pa.array(part - part[0]), ids.take(pa.array(own[part[0] : part[-1]])))
            yield pa.RecordBatch.from_arrays([pa.array(grams[at : at + 10_000], pa.string()), lists], ["gram", "ids"])

    for batch in batches:
        ids = batch.column(0)
        texts = [b.decode("utf-8", "replace") for b in batch.column(1).cast(pa.binary()).to_pylist()]
        ends = np.cumsum([len(s) for s in texts])
        at = 0
        while at < len(texts):
            upto = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BLOCK_CHARS, "right"))
            upto = min(max(upto, at + 1), at + BLOCK_TEXTS, len(texts))
            yield from rows(ids[at:upto], texts[at:upto])
            at = upto


def _bucket(gram: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(buckets)).cast("int")


def _id_type(ids: DataFrame) -> str:
    return ids.schema["text_id"].dataType.simpleString()


def _stored(spark: SparkSession, path: str, ids: DataFrame, rest: str) -> DataFrame:
    """A table in folders; its schema is given, since an empty one has no file to tell it."""
    return spark.read.schema(f"text_id {_id_type(ids)}, {rest}").parquet(path)


def build(spark: SparkSession, texts: DataFrame, path: str, shards: int = 32, buckets: int = 32) -> Library:
    """Writes ``texts`` (text_id, title, body, available_at and what else an index row has) below ``path``.

    Bodies lie in shards by ``text_id``, index rows name their shard, and each gram lies in its bucket with the texts of a block that have it, sorted, so that a
    search reads a few row groups of a few folders. Tasks make the lists of the bodies that they read, so no (gram, text) is shuffled. A hot gram or shard is
    several files; more bodies want more shards and buckets. A null body has no grams.
    """
    lib = Library(*(f"{path}/{name}" for name in ("index", "bodies", "grams")), buckets)
    placed = texts.withColumn("shard", F.pmod(F.xxhash64("text_id"), F.lit(shards)).cast("int"))
    placed.drop("body").write.parquet(lib.index)
    placed.select("text_id", "body", "shard").hint("rebalance", "shard").sortWithinPartitions("shard", "text_id").write.partitionBy("shard").parquet(lib.bodies)
    bodies = _stored(spark, lib.bodies, placed, "body string, shard int").where("body is not null").select("text_id", F.lower("body").alias("body"))
    postings = bodies.mapInArrow(_post, f"gram string, ids array<{_id_type(placed)}>").withColumn("bucket", _bucket(F.col("gram"), buckets))
    postings.sortWithinPartitions("bucket", "gram").write.partitionBy("bucket").parquet(lib.grams)
    return lib


def posting_hits(spark: SparkSession, lib: Library, pattern: str) -> DataFrame | None:
    """Ids of the bodies that hold all grams of some way to match ``pattern``; null if it cannot be bounded."""
    found = literals(pattern)
    if not found:
        return None
    sets = [sorted({part[k : k + GRAM] for part in way for k in range(len(part) - GRAM + 1)}) for way in found]
    wanted = sorted({g for s in sets for g in s})
    buckets = [r[0] for r in spark.createDataFrame([(g,) for g in wanted], "gram string").select(_bucket(F.col("gram"), lib.buckets)).distinct().collect()]
    lists = spark.read.schema(f"gram string, ids array<{_id_type(spark.read.parquet(lib.index))}>, bucket int").parquet(lib.grams)
    postings = lists.where(F.col("bucket").isin(*buckets) & F.col("gram").isin(*wanted)).select("gram", F.explode("ids").alias("text_id"))
    holds = [F.count_if(F.col("gram").isin(*s)) == len(s) for s in sets]  # a gram stands once a body
    anyone = holds[0]
    for h in holds[1:]:
        anyone = anyone | h
    return postings.groupBy("text_id").agg(anyone.alias("_all")).where("_all").select("text_id")


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def search(
    spark: SparkSession, lib: Library, pattern: str, when: Column, n: int, company: tuple[str, Sequence[str]] | None = None, since: Column | None = None,
    code: str = "ts_code", snippet: int = 200, around: int = 40, in_bodies: bool = True,
) -> DataFrame:
    """The best ``n`` visible texts whose title, code or body matches, whatever the case, with rank, relevance and snippets.

    With ``company`` (code, names) only its candidate texts count, from ``since`` on, and rank 40 (title or code) or 30 (body) as candidates; without it all
    visible texts do, as background of rank 20 or 10. Later texts come first, then smaller ids. Bodies are searched where titles and codes
    give fewer than ``n``, and only those that the postings name and that are visible, so hidden texts never fill the list. ``snippet`` is the body's beginning,
    ``context`` what stands around its first hit (null where only the title or code matches). A row without stamp is hidden.
    """
    rx = f"(?i){guarded(pattern)}"
    index = spark.read.parquet(lib.index).where(F.col("available_at") <= when)
    if company is not None:
        if since is not None:
            index = index.where(F.col("available_at") >= since)
        one = spark.createDataFrame([(company[0], list(company[1]))], "code string, terms array<string>")
        index = index.join(_small(candidate_rows(index, one, own=code).select("text_id")), "text_id", "left_semi")
    high, low, label = (40, 30, "candidate") if company is not None else (20, 10, "background")
    named = F.coalesce(F.col("title").rlike(rx), F.lit(False)) | F.coalesce(F.col(code).rlike(rx), F.lit(False))
    best = lambda df: df.orderBy(F.col("rank").desc(), F.col("available_at").desc(), "text_id").limit(n)
    hits = index.where(named).withColumn("rank", F.lit(high))
    bodies = _stored(spark, lib.bodies, index, "body string, shard int")
    if in_bodies and hits.limit(n).count() < n:
        rest = index.where(~named)
        bound = posting_hits(spark, lib, pattern)
        if bound is not None:
            rest = rest.join(bound, "text_id", "left_semi")
        ids = rest.select("text_id", "shard")
        met = bodies.join(_small(ids) if bound is not None else ids, ["text_id", "shard"]).where(F.col("body").rlike(rx)).select("text_id")
        hits = hits.unionByName(rest.join(met, "text_id", "left_semi").withColumn("rank", F.lit(low)))
    top = best(hits)
    at = F.regexp_instr("body", F.lit(rx))
    start = F.greatest(at - around, F.lit(1))
    context = F.when(at > 0, F.substring(F.col("body"), start, at - start + around))
    shown = bodies.join(F.broadcast(top.select("text_id", "shard")), ["text_id", "shard"]).select("text_id", F.substring("body", 1, snippet).alias("snippet"), context.alias("context"))
    return best(top.join(shown, "text_id", "left")).withColumn("relevance", F.lit(label)).drop("shard").withColumn("snippet", F.coalesce("snippet", F.lit("")))

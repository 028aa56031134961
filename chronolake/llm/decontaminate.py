"""Benchmark decontamination: a prefix-filtered set join on word shingles, in DataFrame functions only.

A benchmark item is cut into windows of ``window`` consecutive words (a shorter item is one window).
The shingles of a window are ordered by rarity in the corpus. Containment of a whole window needs all
of its shingles, so the prefix that is necessary is the single rarest one: only documents that hold it
become candidates. Length and position then bound where the window can begin, and every remaining
shingle of the window is verified at its own place, which is exact word-for-word equality.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ascii_lower, bounded_broadcast, once, written

#: Everything but digits, a-z and characters beyond ASCII parts words (after A-Z are lowered).
NOT_WORD = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: The key of the row that ends each document.
END = 0
#: Rows of benchmark shingles up to which they are broadcast (about 100 bytes each); beyond, they are shuffled.
BROADCAST_ROWS = 1_000_000


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(text), NOT_WORD), "")


def _starts(size: int) -> Column:
    """The words of column ``_words`` that begin a run of ``size`` words."""
    return F.slice("_words", F.lit(1), F.greatest(F.size("_words") - F.lit(size - 1), F.lit(0)))


def _key(size: int, first: Column, i: Column) -> Column:
    return F.xxhash64(first, *(F.get("_words", i + k) for k in range(1, size)))


def _shingles(size: int) -> Column:
    """(j, shingle, key) for each run of ``size`` words of column ``_words``."""
    return F.transform(_starts(size), lambda w, i: F.struct(i.alias("j"), F.concat_ws(" ", F.slice("_words", i + 1, F.lit(size))).alias("shingle"), _key(size, w, i).alias("key")))


def benchmark_windows(benchmark: DataFrame, window: int, shingle: int, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, window, len, size, parts): each item's windows and their shingles (j, shingle)."""
    items = benchmark.select(F.col(item_id).alias("_item"), once(words(F.col(text))).alias("_all")).where(F.size("_all") > 0)
    last = F.greatest(F.size("_all") - F.lit(window), F.lit(0))
    starts = items.select("_item", F.explode(F.transform(F.sequence(F.lit(0), last), lambda s: F.slice("_all", s + 1, F.lit(window)))).alias("_words"))
    flat = starts.select("_item", "_words", F.concat_ws(" ", "_words").alias("window"), F.size("_words").alias("len"))
    parts = F.when(F.col("len") >= shingle, _shingles(shingle))
    for n in range(1, shingle):
        parts = parts.when(F.col("len") == n, _shingles(n))
    return flat.withColumn("parts", parts).withColumn("size", F.least("len", F.lit(shingle))).drop("_words")


def _row_key(doc_id: Column, text: Column) -> Column:
    """A digest of id and text: rows that share a null or repeated id keep apart unless their texts are equal too."""
    own = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.unhex(F.sha2(F.concat(F.when(doc_id.isNull(), "n").otherwise("v"), F.length(own).cast("string"), F.lit(":"), own, F.coalesce(text, F.lit(""))), 256))


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = 10, shingle: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Which words of each document lie in an occurrence of a benchmark window.

    Returns one row per row of ``documents``: ``doc_id, n_words, n_hit, n_items, item_ids`` (sorted as
    strings, comma-joined). Null or empty text has no words and no hits; an empty benchmark hits
    nothing; items without words have no windows; items with equal windows all count; rows that share
    a null or repeated doc_id are each judged by their own text; a very long text is parted into rows for its words; extra columns are ignored.
    """
    return _by_row(documents, benchmark, window, shingle, doc_id, text).drop("_key")


def _by_row(documents: DataFrame, benchmark: DataFrame, window: int = 10, shingle: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``contamination`` with ``_key``, the digest of id and text."""
    spans = written(benchmark_windows(benchmark, window, shingle), "windows")
    wanted = written(spans.select("size", F.explode("parts").alias("p")).select("size", "p.shingle", "p.key").distinct(), "shingles")
    sizes = [r[0] for r in wanted.select("size").distinct().collect()] or [shingle]  # 1 to `shingle` at most
    n_wanted, n_spans = wanted.count(), spans.count()
    docs = documents.select(_row_key(F.col(doc_id), F.col(text)).alias("_doc"), F.col(doc_id).alias("_id"), once(words(F.col(text))).alias("_words"))

    small = n_wanted <= BROADCAST_ROWS

    def hits_of(size: int, end: bool) -> DataFrame:
        """Benchmark shingles in documents; with ``end`` also a row without shingle that ends each document."""
        keys = wanted.where(F.col("size") == size).select("shingle", "key")
        own = F.transform(_starts(size), lambda w, i: _key(size, w, i))
        if end and small:
            keys = keys.unionByName(keys.sparkSession.range(1).select(F.lit(None).cast("string").alias("shingle"), F.lit(END).alias("key")))
            own = F.concat(own, F.array(F.lit(END)))
        at = docs.withColumn("_n", F.size("_words")).withColumn("_keys", own).select("_doc", "_id", "_n", "_words", F.posexplode("_keys").alias("pos", "key"))
        said = F.concat_ws(" ", F.slice("_words", F.col("pos") + 1, F.lit(size)))
        if small:
            found = at.join(F.broadcast(keys), "key").withColumn("_said", said)
        else:  # the rows that are shuffled hold their own words only
            found = at.select("_doc", "_id", "_n", "pos", "key", said.alias("_said")).join(keys, "key")
        last = F.col("shingle").isNull() & (F.col("pos") == F.greatest(F.col("_n") - F.lit(size - 1), F.lit(0)))
        hits = found.where((F.col("_said") == F.col("shingle")) | last).select("_doc", F.when(F.col("shingle").isNull(), F.col("_id")).alias("_id"), F.col("_n").cast("long").alias("n_words"), "pos", F.lit(size).alias("size"), "shingle")
        if end and not small:
            ends = docs.select("_doc", "_id", F.size("_words").cast("long").alias("n_words"), F.size("_words").alias("pos"), F.lit(size).alias("size"), F.lit(None).cast("string").alias("shingle"))
            hits = hits.unionByName(ends)
        return hits

    hits = hits_of(sizes[0], True)
    for size in sizes[1:]:
        hits = hits.unionByName(hits_of(size, False))
    hits = written(hits, "hits")
    counted, hits = hits.where("shingle is null").select("_doc", "_id", "n_words"), hits.where("shingle is not null")

    rarity = hits.groupBy("size", "shingle").agg(F.count("*").alias("df"))
    parts = spans.select("window", "len", "size", F.size("parts").alias("n_parts"), F.explode("parts").alias("part")).distinct()
    parts = parts.select("window", "len", "size", "n_parts", "part.j", "part.shingle")
    # A shingle that no document holds has no rarity row: its windows occur nowhere and fall out here.
    ranked = parts.join(rarity, ["size", "shingle"])
    whole = W.partitionBy("window")
    prefix = (
        ranked.withColumn("_present", F.count("*").over(whole))
        .withColumn("_rank", F.row_number().over(whole.orderBy("df", "shingle", "j")))
        .where((F.col("_rank") == 1) & (F.col("_present") == F.col("n_parts")))
        .select("window", "len", "size", "n_parts", "j", "shingle")
    )
    candidates = (
        hits.join(bounded_broadcast(prefix, n_spans, BROADCAST_ROWS), ["size", "shingle"])
        .withColumn("start", F.col("pos") - F.col("j"))
        .where((F.col("start") >= 0) & (F.col("start") + F.col("len") <= F.col("n_words")))
        .select("_doc", "window", "len", "size", "n_parts", "start").distinct()
    )
    expected = candidates.join(bounded_broadcast(parts.select("window", "j", "shingle"), n_spans * window, BROADCAST_ROWS), "window").withColumn("pos", F.col("start") + F.col("j"))
    there = hits.select(F.col("_doc").alias("_d"), F.col("pos").alias("_p"), F.col("size").alias("_s"), F.col("shingle").alias("_sh")).distinct()
    verified = (
        expected.join(there, F.col("_doc").eqNullSafe(F.col("_d")) & (F.col("pos") == F.col("_p")) & (F.col("size") == F.col("_s")) & (F.col("shingle") == F.col("_sh")), "left_semi")
        .groupBy("_doc", "window", "len", "n_parts", "start").agg(F.count("*").alias("_ok")).where(F.col("_ok") == F.col("n_parts"))
    )
    found = written(verified.select("_doc", "window", "start", (F.col("start") + F.col("len")).alias("end")), "found")

    before = W.partitionBy("_doc").orderBy("start", "end", "window").rowsBetween(W.unboundedPreceding, -1)
    covered = (
        found.withColumn("_reach", F.coalesce(F.max("end").over(before), F.lit(0)))
        .groupBy("_doc").agg(F.sum(F.greatest(F.lit(0), F.col("end") - F.greatest("start", "_reach"))).cast("long").alias("n_hit"))
    )
    owners = spans.select("_item", "window").distinct()
    per_item = found.select("_doc", "window").distinct().join(owners, "window").select("_doc", F.col("_item").cast("string").alias("_item")).distinct()
    named = per_item.groupBy("_doc").agg(F.count("*").alias("n_items"), F.array_join(F.array_sort(F.collect_list("_item")), ",").alias("item_ids"))
    report = covered.join(named.withColumnRenamed("_doc", "_nd"), F.col("_doc").eqNullSafe(F.col("_nd")), "left").select(F.col("_doc").alias("_rd"), "n_hit", "n_items", "item_ids")
    return counted.join(report, F.col("_doc").eqNullSafe(F.col("_rd")), "left").select(
        F.col("_doc").alias("_key"), F.col("_id").alias("doc_id"), "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("item_ids", F.lit("")).alias("item_ids"),
    )


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``documents`` without those that hold a benchmark window; columns as given."""
    bad = _by_row(documents, benchmark, **options).where("n_hit > 0").select(F.col("_key").alias("_bad")).distinct()
    key = _row_key(documents[options.get("doc_id", "doc_id")], documents[options.get("text", "text")])
    return documents.join(bad, key == bad["_bad"], "left_anti")

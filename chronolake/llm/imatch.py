"""I-Match fingerprints in DataFrame functions: terms in a band of document frequency, several random lexicons.

Terms are lower-cased runs of letters and digits, by their 64-bit hash; their document frequencies are counted over
all documents. The lexicon is the terms whose share of documents lies in [``RARE``, ``COMMON``]: a fixed share bounds
its number by a document's mean number of terms over ``RARE``. It is kept as a bitmap of fixed size in which each term sets
``PROBES`` bits. A document's distinct lexicon terms, sorted, fall into ``LEXICONS`` random sub-lexicons, each term into
``DRAWS`` of them; the terms of each are hashed together, 24 bits a part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import once

SLOT_BITS, PROBES = 20, (0, 20, 40)
RARE, COMMON = 0.002, 0.1
LEXICONS, DRAWS = 64, (6, 12, 18, 24)  # 8 x 8; a draw is six bits of a term's hash
NO_TERMS = "------"


def _hashes(text: Column) -> Column:
    return F.transform(F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+"), ""), lambda w: F.xxhash64(w))


def _slots(h: Column) -> list[Column]:
    return [F.shiftrightunsigned(h, p).bitwiseAND(F.lit((1 << SLOT_BITS) - 1)) for p in PROBES]


def _constants(values: list[int]) -> Column:
    """A constant array in a single literal, however many values there are."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>") if values else F.array().cast("array<bigint>")


def _bitmap(slots: DataFrame) -> Column:
    """The slots of column ``slot`` as a constant array of 64-bit masks."""
    bits = slots.groupBy(F.shiftright("slot", 6).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits"))
    masks = [0] * (1 << (SLOT_BITS - 6))
    for word, value in bits.collect():  # 2^14 rows at most
        masks[word] = value
    return _constants(masks)


def _bit(masks: Column, slot: Column) -> Column:
    return F.getbit(F.get(masks, F.shiftright(slot, 6).cast("int")), slot.bitwiseAND(F.lit(63)).cast("int")) == 1


def lexicon(documents: DataFrame, text: str = "text") -> Column:
    """The lexicon as a constant array of 64-bit masks, counted over all documents.

    A term is in no more documents than its slot, so terms are counted where enough documents hold their slot.
    """
    hashed = documents.select(once(F.array_distinct(_hashes(F.col(text)))).alias("_h"))
    n = max(documents.count(), 1)
    slots = hashed.select(F.explode(F.array_distinct(F.transform("_h", lambda h: _slots(h)[0]))).alias("slot"))
    often = _bitmap(slots.groupBy("slot").agg(F.count("*").alias("df")).where(F.col("df") >= RARE * n))
    terms = hashed.select(F.explode(F.filter("_h", lambda h: _bit(often, _slots(h)[0]))).alias("term"))
    counts = terms.groupBy("term").agg(F.count("*").alias("df")).where(F.col("df").between(RARE * n, COMMON * n))
    return _bitmap(counts.select(F.explode(F.array(*_slots(F.col("term")))).alias("slot")))


def with_fingerprint(df: DataFrame, text: str, masks: Column, to: str) -> DataFrame:
    """Adds ``to``: an array with a part for each sub-lexicon, or the text's digest alone where no term is in the lexicon."""
    names = df.columns

    def known(h: Column) -> Column:
        first, second, third = (_bit(masks, slot) for slot in _slots(h))
        return first & second & third

    banded = df.select(*names, once(_hashes(F.col(text))).alias("_h")).select(*names, once(F.array_sort(F.array_distinct(F.filter("_h", known)))).alias("_band"))
    # Each term once for each draw; the draw takes the place of its last six bits.
    drawn = F.flatten(F.transform("_band", lambda h: F.array(*(h.bitwiseAND(F.lit(-64)).bitwiseOR(F.shiftrightunsigned(h, d).bitwiseAND(F.lit(63))) for d in DRAWS))))
    banded = banded.select(*names, "_band", once(drawn).alias("_drawn"))
    part = lambda terms: F.when(F.size(terms) == 0, NO_TERMS).otherwise(F.lpad(F.hex(F.xxhash64(terms).bitwiseAND(F.lit(0xFFFFFF))), 6, "0"))
    eight = F.sequence(F.lit(0), F.lit(7))
    group = lambda g: F.filter("_drawn", lambda h: F.shiftright(h, 3).bitwiseAND(F.lit(7)) == g)
    split = lambda terms: F.transform(eight, lambda j: part(F.filter(terms, lambda h: h.bitwiseAND(F.lit(7)) == j)))
    parts = F.flatten(F.transform(F.transform(eight, group), split))
    alone = F.array(F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    return banded.select(*names, F.when(F.size("_band") > 0, parts).otherwise(alone).alias(to))


def likeness(a: Column, b: Column) -> Column:
    """The share of equal parts among those that at least one of the two has."""
    held = F.filter(F.arrays_zip(a.alias("a"), b.alias("b")), lambda p: (F.coalesce(p["a"], F.lit(NO_TERMS)) != NO_TERMS) | (F.coalesce(p["b"], F.lit(NO_TERMS)) != NO_TERMS))
    return F.size(F.filter(held, lambda p: F.coalesce(p["a"] == p["b"], F.lit(False)))) / F.greatest(F.size(held), F.lit(1))


def with_next(documents: DataFrame, text: str = "text", doc_id: str = "doc_id", masks: Column | None = None) -> DataFrame:
    """Each document with the next one by ascending doc_id (the last with the first): ``doc_id, text, fp, next_text, next_fp``.

    Documents are dealt to blocks by quantiles of doc_id, so that neighbours meet in a sorted block; the first
    document of each block is also sent to the block before.
    """
    spark = documents.sparkSession
    key = F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63)))
    keys = documents.select(key.alias("_k"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = sorted(set(keys.agg(F.percentile_approx("_k", F.array(*(F.lit(k / n) for k in range(1, n))) if n > 1 else F.array(F.lit(0.5)), 1000 * n)).first()[0] or []))
    block = F.size(F.filter(_constants(bounds), lambda b: b <= F.col("_k")))
    firsts = sorted(tuple(r) for r in keys.select("_k", block.alias("b")).groupBy("b").agg(F.min("_k")).collect())  # a row a block
    # The least key of a block is also sent to the block before; that of the first block to the last.
    sent_on = _constants([first for _, first in firsts])
    to = _constants([firsts[k - 1][0] for k in range(len(firsts))])
    ghost = F.when(F.array_contains(sent_on, F.col("_k")), F.get(to, (F.array_position(sent_on, F.col("_k")) - 1).cast("int")).cast("int"))
    rows = documents.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), key.alias("_k"))
    if masks is not None:
        rows = with_fingerprint(rows, "text", masks, "fp")
    own = F.struct(block.alias("block"), F.lit(0).alias("late"))
    sent = rows.select("*", F.explode(F.filter(F.array(own, F.struct(ghost.alias("block"), F.lit(1).alias("late"))), lambda s: s["block"].isNotNull())).alias("_to"))
    order = W.partitionBy("_to.block").orderBy("_to.late", "_k", "text")
    nexts = [F.lead(c).over(order).alias(f"next_{c}") for c in ("text", "fp") if c in rows.columns]
    return sent.select("*", *nexts).where("_to.late = 0").drop("_to", "_k")


def fingerprints(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of whole texts and of edited ones, whose last half is the beginning of the next document.

    Returns a row for each row of ``documents``. Null counts as empty; a text without lexicon terms is its
    digest, so only equal ones are alike; repeated doc_ids are neighbours in the order of their texts; null
    doc_ids come first, all of them in one sorted block; a very long text is one row in one task; a single document
    is its own next; no rows give none; extra columns are ignored.
    """
    masks = lexicon(documents, text)
    paired = with_next(documents, text, doc_id, masks)
    size = F.char_length("text")
    cut = F.floor(size / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), size - cut), F.substring("next_text", F.lit(1), cut))
    both = with_fingerprint(paired.select("doc_id", size.cast("long").alias("n_chars"), "fp", "next_fp", edited.alias("edited")), "edited", masks, "edited_fp")
    return both.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        F.array_join("fp", "").alias("fingerprint"), F.array_join("edited_fp", "").alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )

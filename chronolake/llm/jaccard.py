"""N-gram Jaccard join with token-combination prefixes.

A document is the set of its distinct word shingles, as 64-bit hashes. Equal sets are one node. Tokens are
ordered by their own class and that of their rarest word (rare before frequent), then by hash; two sets of the wanted similarity share at least l tokens of
their first ``n - required + l``; l is two, for pairs of tokens, and grows slowly with the set. Documents are first held
against one document with which they share most prefix tokens, in rounds as long as that joins components, which joins groups of copies in
stars. Only tokens whose documents still lie in different components go on: rare ones index single tokens,
frequent ones pairs of tokens. Candidates pass bounds on length and position and are verified on whole sets.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import MARK_BITS, forget, is_marked, join_counted, mark_slot, marks, modest_batches, release, split, tidy, written
from .components import components

#: Words in at least this share of documents have a class of their own (by powers of two); all others are rare.
WORD_SHARE = 1e-3
#: Shingles counted in at least this share of documents, and this often, have classes as well and come after all others.
SHINGLE_SHARE, FREQUENT_LEAST = 2e-4, 20
#: A token is frequent when more documents than this hold it in their prefixes (then pairs of tokens are indexed).
RARE_DOCUMENTS = 200
#: Rounds of stars at most; all that they leave apart is compared afterwards.
ROUNDS = 4
#: Pairs for each set that are verified in one turn.
PAIRS_EACH = 4
#: Meetings for each set that are listed in one turn.
MET_EACH = 600
#: Pairs for each posting from which another round is worth its while.
CROWDED = 4
#: Tokens of a combination, and one more for each so many tokens of a set: so many shared ones a prefix is extended for.
COMBINED, MORE_EACH = 2, 40
#: The share of a prefix that makes a document lean on the least one with those tokens.
STAR_SHARE = 0.3
#: Words whose hashes a worker remembers.
REMEMBERED = 200_000
#: Shingles counted at once in a task.
AT_ONCE = 2_000_000
#: The key of a null doc_id.
NO_ID = -(1 << 63)

_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xBF58476D1CE4E5B9)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        key = xxhash.xxh64_intdigest(word)
        if len(self) < REMEMBERED:
            self[word] = key
        return key


_words = _Words()


def _hashes(text: str | None) -> np.ndarray:
    """Hashes of a text's words in turn; bytes, so that only A-Z change and only ASCII blanks part."""
    words = text.encode().lower().split() if text else []
    return np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))


def _mixed(hashes: np.ndarray, size: int) -> np.ndarray:
    """The shingle that begins at each word but the last; a shorter text is one shingle, no words none."""
    n = min(size, len(hashes))
    if not n:
        return hashes
    mixed = np.full(len(hashes) - n + 1, n, np.uint64)
    for k in range(n):
        mixed = (mixed ^ hashes[k : len(hashes) - n + 1 + k]) * _P
        mixed ^= mixed >> np.uint64(29)
        mixed *= _Q
        mixed ^= mixed >> np.uint64(32)
    return mixed


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles of ``size`` words; a shorter text is one shingle, no words none."""
    return np.unique(_mixed(_hashes(text), size))


def _row(doc_id: Column, text: Column) -> Column:
    return F.xxhash64(doc_id, text)


def _keyed(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc, text, row): the key of the doc_id, and of id and text together."""
    doc = F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID))
    return documents.select(doc.alias("doc"), F.col(text).alias("text"), _row(doc, F.col(text)).alias("row"))


def _classes(keyed: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of frequent words, sorted, and their classes from 1 on; the same of frequent shingles.

    Words are at most a document's mean number of words by ``WORD_SHARE``, shingles by ``SHINGLE_SHARE`` of them. All documents are
    counted. What is rare in a task is left out there, so a class may come out low; classes only put tokens in order.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        texts: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            words, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            keep = n >= max(2, WORD_SHARE / 8 * len(held))
            # Texts are mixed together: the shingles across their ends are noise.
            mixed, m = np.unique(_mixed(np.concatenate(texts), size), return_counts=True) if texts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            often = m >= max(2, SHINGLE_SHARE * len(texts))
            both = np.concatenate((words[keep], mixed[often])).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.arange(len(both)) >= keep.sum()), pa.array(both), pa.array(np.concatenate((n[keep], m[often])))], ["mixed", "word", "n"])

        total = 0
        for batch in batches:
            for body in batch.column(0):
                texts.append(_hashes(body.as_py()))
                held.append(np.unique(texts[-1]))
                total += len(texts[-1])
                if total >= AT_ONCE:
                    yield out()
                    held, texts, total = [], [], 0
        yield out()

    n_docs = max(keyed.count(), 1)
    counts = keyed.select("text").mapInArrow(count, "mixed boolean, word long, n long").groupBy("mixed", "word").agg(F.sum("n").alias("n"))
    least = {False: max(2.0, WORD_SHARE * n_docs), True: max(float(FREQUENT_LEAST), SHINGLE_SHARE * n_docs)}
    with tidy(keyed.sparkSession):
        found = counts.where(F.col("n") >= F.when(F.col("mixed"), least[True]).otherwise(least[False])).toArrow()
    kind, words, n = found.column("mixed").to_numpy(), found.column("word").to_numpy().view(np.uint64), found.column("n").to_numpy()
    out: list[np.ndarray] = []
    for mixed, share in ((False, WORD_SHARE * n_docs), (True, least[True])):
        own = np.flatnonzero(kind == mixed)
        own = own[np.argsort(words[own])]
        out += [words[own], (1 + np.floor(np.log2(np.maximum(n[own] / share, 1)))).astype(np.uint8)]
    return tuple(out)


def _class_of(hashes: np.ndarray, known: np.ndarray, classes: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(hashes), np.uint8)
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    return np.where(known[at] == hashes, classes[at], 0).astype(np.uint8)


def _key(own: np.ndarray) -> int | None:
    """The key of a set, none for an empty one."""
    return int.from_bytes(hashlib.md5(own.tobytes()).digest()[:8], "little", signed=True) if len(own) else None


def _prefixes(keyed: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """(doc, row, n, k, tokens): the set's size, its key (a digest) and its extended prefix in the tokens' order."""
    known = keyed.sparkSession.sparkContext.broadcast(_classes(keyed, size))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, classes, common, levels = known.value
        for batch in batches:
            n, keys, tokens = [], [], []
            for body in batch.column(1):
                hashes = _hashes(body.as_py())
                own, first = np.unique(_mixed(hashes, size), return_index=True)
                n.append(len(own))
                keys.append(_key(own))
                rarest = own_class = _class_of(hashes, frequent, classes)
                for k in range(1, min(size, len(hashes))):
                    rarest = np.minimum(rarest[:-1], own_class[k:])
                most = len(own) - -(-num * len(own) // den) + COMBINED + len(own) // MORE_EACH
                # A shingle that is itself frequent comes after all others, whatever its words.
                order = _class_of(own, common, levels).astype(np.uint16) << 8 | rarest[first] if len(own) else own
                tokens.append(own[np.argsort(order, kind="stable")][:most].view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int32()), pa.array(keys, pa.int64()), pa.array(tokens, pa.list_(pa.int64()))], ["doc", "row", "n", "k", "tokens"])

    return keyed.mapInArrow(cut, "doc long, row long, n int, k long, tokens array<long>")


MASK = (1 << MARK_BITS) - 1


def _slot(key: Column) -> Column:
    return key.bitwiseAND(F.lit(MASK))


def _postings(own: DataFrame) -> DataFrame:
    """(token, k, n, pos, df, least_k, least_n) for tokens that two documents have; least: the least of them with its n.

    Counts are summed in tasks before the shuffle. A bitmap of the shared tokens spares the others the join with these counts;
    the few tokens with a large part of all postings are joined by a broadcast.
    """
    counts = own.select("k", "n", F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("df"), F.min(F.struct("k", "n")).alias("least"))
    shared = written(counts.where("df > 1").select("token", "df", F.col("least.k").alias("least_k"), F.col("least.n").alias("least_n")), "shared")
    bits = own.sparkSession.sparkContext.broadcast(marks(shared, "token", _slot))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            tokens, sizes = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
            k, n = (np.repeat(batch.column(c).to_numpy(), sizes) for c in (0, 1))
            pos = np.arange(len(tokens), dtype=np.int32) - np.repeat(np.cumsum(sizes) - sizes, sizes).astype(np.int32)
            there = is_marked(bits.value, tokens & MASK)
            yield pa.RecordBatch.from_arrays([pa.array(x[there]) for x in (tokens, k, n.astype(np.int32), pos)], ["token", "k", "n", "pos"])

    rows = own.select("k", "n", "tokens").mapInArrow(keep, "token long, k long, n int, pos int")
    return join_counted(rows, shared, "token", "df")


def _sets(keyed: DataFrame, nodes: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(k, tokens) of the sets that are marked in bitmaps of fixed size: all of ``wanted`` and a few more, each from its least document."""
    spark = keyed.sparkSession
    own = written(nodes.join(wanted, "k", "left_semi").select("k", "doc"), "wanted")
    docs, sets = (spark.sparkContext.broadcast(marks(own, c, _slot)) for c in ("doc", "k"))
    forget(own)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, found = [], []
            for i in np.flatnonzero(is_marked(docs.value, batch.column(0).to_numpy() & MASK)).tolist():
                own = shingles(batch.column(1)[i].as_py(), size)
                if len(own) and is_marked(sets.value, np.array([key := _key(own)]) & MASK)[0]:
                    keys.append(key)
                    found.append(own.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(found, pa.list_(pa.int64()))], ["k", "tokens"])

    return keyed.select("doc", "text").mapInArrow(whole, "k long, tokens array<long>")


def _fits(a: Column, b: Column, num: int, den: int) -> Column:
    """Sizes that allow the similarity."""
    return (a * den >= b * num) & (b * den >= a * num)


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose whole sets reach the similarity; both sides read one exchange of the sets, pairs carry one set on."""
    first, second = (sets.select(F.col("k").alias(c), F.col("tokens").alias(f"_{c}")) for c in ("a", "b"))
    joined = pairs.select("a", "b").join(first, "a").join(second, "b")
    both = joined.select("a", "b", (F.size("_a") + F.size("_b")).alias("_sum"), F.size(F.array_intersect("_a", "_b")).alias("_both"))
    return both.where((F.col("_both") * den) >= (F.col("_sum") - F.col("_both")) * num).select("a", "b").distinct()


def _met(postings: DataFrame, by: list[str], num: int, den: int, turn: int, turns: int) -> DataFrame:
    """A row for each token (or pair of tokens) that two documents of different components share within the bounds on length and position.

    A turn has all rows of its own share of the lesser documents.
    """
    mixed = postings.groupBy(*by).agg(F.min("c").alias("_lo"), F.max("c").alias("_hi")).where("_lo != _hi").select(*by)
    own = postings.join(mixed, by, "left_semi")
    other = own.select(*by, *(F.col(x).alias(f"{x}2") for x in ("k", "n", "pos", "c", "of")))
    best = F.least("pos", "pos2") + 1 + F.least(F.col("n") - F.col("pos") - 1, F.col("n2") - F.col("pos2") - 1)
    mine = own.where(F.pmod(F.xxhash64("k"), F.lit(turns)) == turn) if turns > 1 else own
    met = mine.join(other, by).where((F.col("c") != F.col("c2")) & (F.col("k") < F.col("k2")))
    kept = met.where(_fits(F.col("n"), F.col("n2"), num, den) & (best * (num + den) >= (F.col("n") + F.col("n2")) * num))
    # What two sets share beyond their prefixes is at most the longer rest, so the prefixes share what is missing to the overlap.
    rest = lambda n: F.greatest(F.ceil(n * num / den) - COMBINED - F.floor(n / MORE_EACH), F.lit(0))
    must = F.greatest(COMBINED + F.floor(F.least("n", "n2") / MORE_EACH), F.ceil((F.col("n") + F.col("n2")) * num / (num + den)) - F.greatest(rest(F.col("n")), rest(F.col("n2"))))
    return kept.select(F.col("k").alias("a"), F.col("k2").alias("b"), must.alias("must"), F.least("of", "of2").alias("of"))


def _star(postings: DataFrame, turn: int, num: int, den: int) -> DataFrame:
    """(a, b): each document with the pivot of another component with which it shares most tokens.

    A token's pivots are its first and last documents in the turn's own random order, in which large components come first most often.
    """
    node = F.struct(F.xxhash64("k", F.lit(turn)).alias("at"), "c", "k", "n")
    ends = postings.groupBy("token").agg(F.min(node).alias("lo"), F.max(node).alias("hi"))
    both = postings.join(ends, "token")
    pivot = F.when(F.col("c") != F.col("lo.c"), F.col("lo")).when(F.col("c") != F.col("hi.c"), F.col("hi"))
    other = both.select("k", "n", pivot.alias("e")).where("e is not null").select("k", "n", F.col("e.k").alias("b"), F.col("e.n").alias("m"))
    shared = other.where(_fits(F.col("n"), F.col("m"), num, den)).groupBy("k", "n", "b").agg(F.count("*").alias("t"))
    enough = F.greatest(F.lit(COMBINED), (F.col("n") - F.ceil(F.col("n") * num / den)) * STAR_SHARE)
    stars = shared.where(F.col("t") >= enough).groupBy("k").agg(F.max_by("b", F.struct("t", "b")).alias("b"))
    return stars.select(F.greatest("k", "b").alias("a"), F.least("k", "b").alias("b")).distinct()


def _crowded(open_: DataFrame) -> bool:
    """Whether the pairs of documents that meet in a token are many times the postings."""
    with tidy(open_.sparkSession):
        load = open_.groupBy("token").agg(F.count("*").cast("double").alias("n")).agg(F.sum(F.col("n") * F.col("n")), F.sum("n")).first()
    return (load[0] or 0) > CROWDED * (load[1] or 0)


def _open(repeated: DataFrame, found: DataFrame) -> DataFrame:
    """Postings, with their component ``c``, of tokens whose documents lie in different components."""
    at = repeated.join(found, repeated["k"] == found["node"], "left").select("token", "k", "n", "pos", "df", F.coalesce("component", "k").alias("c"))
    mixed = at.groupBy("token").agg(F.min("c").alias("_lo"), F.max("c").alias("_hi")).where("_lo != _hi").select("token")
    return at.join(mixed, "token", "left_semi")


def _joined(documents: DataFrame, size: int, num: int, den: int, doc_id: str, text: str) -> DataFrame:
    """(doc, row, n, k, least): each row with its set's key and the least (doc, k) of its component; null where it has no shingles."""
    if not den < 2 * num <= 2 * den:
        raise ValueError("a similarity above one half and up to one is needed")
    modest_batches(documents.sparkSession)
    keyed = _keyed(documents, doc_id, text)
    rows = written(_prefixes(keyed, size, num, den), "prefixes")
    own = rows.where("n > 0").groupBy("k").agg(F.min("doc").alias("doc"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("tokens").alias("tokens"))
    own = written(own, "nodes")
    nodes = own.select("k", "doc", "copies")
    repeated = written(_postings(own.select("k", "n", "tokens")), "postings")

    # Stars only spare work: whatever they leave apart is compared below.
    both = lambda pairs: pairs.select(F.explode(F.array("a", "b")).alias("k")).distinct()
    links, open_, held = None, repeated.withColumn("c", F.col("k")), [repeated]
    for turn in range(ROUNDS):
        if not _crowded(open_):
            break
        stars = written(_star(open_, turn, num, den), "stars")
        joined = written(_verified(stars, _sets(keyed, nodes, both(stars), size), num, den), "links")
        if turn == 0 or not joined.isEmpty():
            # Stars of the components so far stand for all their links.
            found = components(joined if links is None else links.unionByName(joined))
            links = found.select(F.col("node").alias("a"), F.col("component").alias("b"))
            open_ = written(_open(repeated, found), "open")
            forget(*held[1:])
            held[1:] = [open_]
        forget(stars)
        release(keyed.sparkSession)
    open_ = open_.withColumn("often", F.col("df") > RARE_DOCUMENTS)
    # Two shared tokens are both rare, or a pair of which one is frequent at least: r rare tokens and p such pairs are
    # s shared tokens with s (s - 1) = r (r - 1) + 2 p, so the tokens that two documents must share are counted exactly.
    must = COMBINED + F.floor(F.col("n") / MORE_EACH)
    of_set = W.partitionBy("k")
    open_ = open_.select("*", F.sum(F.col("often").cast("int")).over(of_set).alias("of"), F.count("*").over(of_set).alias("_held")).where(F.col("_held") >= must).drop("_held")
    rare = open_.where("not often")
    own_tokens = open_.where("of > 0").groupBy("k", "n", "c", "of").agg(F.sort_array(F.collect_list(F.struct("pos", "token", "often"))).alias("ts"))
    firsts = own_tokens.select("k", "n", "c", "of", "ts", F.posexplode("ts").alias("i", "one"))
    later = F.filter(F.slice("ts", F.col("i") + 2, F.size("ts")), lambda t: t["often"] | F.col("one.often"))
    paired = firsts.select("k", "n", "c", "of", "one.pos", F.col("one.token").alias("token"), F.explode(later).alias("two")).select("k", "n", "c", "of", "pos", "token", F.col("two.token").alias("token2"))
    marked = lambda met, r, p: met.select("a", "b", "must", F.lit(r).alias("r"), F.lit(p).alias("p"))
    with tidy(keyed.sparkSession):
        sizes = [rows.groupBy(*by).agg(F.count("*").cast("double").alias("n")) for rows, by in ((rare, ["token"]), (paired, ["token", "token2"]))]
        meetings = sizes[0].select("n").unionByName(sizes[1].select("n")).agg(F.sum(F.col("n") * (F.col("n") - 1) / 2)).first()[0] or 0
    # Meetings are rows before they are counted: where there are many for each set, they go in turns as well.
    n_nodes, found = max(nodes.count(), 1), []
    turns = max(1, math.ceil(meetings / (MET_EACH * n_nodes)))
    for turn in range(turns):
        met = marked(_met(rare, ["token"], num, den, turn, turns), 1, 0).unionByName(marked(_met(paired, ["token", "token2"], num, den, turn, turns), 0, 1)).groupBy("a", "b", "must").agg(F.sum("r").alias("r"), F.sum("p").alias("p"))
        found.append(written(met.where(F.col("r") * (F.col("r") - 1) + 2 * F.col("p") >= F.col("must") * (F.col("must") - 1)).select("a", "b"), "pairs"))
    pairs = reduce(DataFrame.unionByName, found)
    forget(*held)
    # Pairs carry a set; where there are many for each set, they go in turns, so that the shuffle files of one make room for the next.
    turns = max(1, -(-pairs.count() // (PAIRS_EACH * n_nodes)))
    sets = _sets(keyed, nodes, both(pairs), size)
    if turns > 1:
        sets = written(sets, "sets")
    more = links
    for turn in range(turns):
        own = pairs.where(F.pmod(F.xxhash64("a", "b"), F.lit(turns)) == turn)
        verified = written(_verified(own, sets, num, den), "more")
        more = verified if more is None else more.unionByName(verified)
        if turns > 1:
            release(keyed.sparkSession)
    final = components(more)

    labelled = written(nodes.join(final, nodes["k"] == final["node"], "left").select("k", "doc", "copies", F.coalesce("component", "k").alias("component")), "labelled")
    # A component that holds a large part of all sets meets its least document by a broadcast as well.
    least = written(labelled.groupBy("component").agg(F.min(F.struct("doc", "k")).alias("least"), F.count("*").alias("sets")), "least")
    named = written(join_counted(labelled, least, "component", "sets").select("k", "copies", "least"), "named")
    given = rows.select("doc", "row", "n", "k")
    none = given.where("n = 0").select("*", F.lit(None).cast("struct<doc:bigint,k:bigint>").alias("least"))
    return join_counted(given.where("n > 0"), named, "k", "copies").select("doc", "row", "n", "k", "least").unionByName(none)


def join(documents: DataFrame, size: int = 5, num: int = 8, den: int = 10, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Components of documents linked by a Jaccard similarity of shingle sets of at least ``num / den``, more than one half.

    Returns ``doc_id, n_shingles, component_id`` (the least doc_id of the component) for each row. Null, empty
    and blank texts have no shingles and no links; equal sets are linked; null doc_ids count as the least;
    rows that repeat a doc_id are linked by their own texts only; no rows give none; extra columns are ignored. A very
    long text is one set in one task, and its prefix grows with it.
    """
    found = _joined(documents, size, num, den, doc_id, text)
    back = lambda c: F.when(c != NO_ID, c)
    return found.select(back(F.col("doc")).alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), back(F.coalesce("least.doc", "doc")).alias("component_id"))


def keep_one(documents: DataFrame, size: int = 5, num: int = 8, den: int = 10, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``documents`` with the one of each component whose doc_id is least; columns as given.

    Where different texts of a component share that doc_id, one of them stays. Equal rows of it are one document and stay.
    """
    found = _joined(documents, size, num, den, doc_id, text)
    dropped = written(found.where("least.doc != doc or least.k != k").select(F.col("doc").alias("_doc"), F.col("row").alias("_dropped")), "dropped")
    doc = F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID))
    key = _row(doc, F.col(text))
    stay, maybe = split(documents, key, dropped, "_dropped")
    return stay.unionByName(maybe.join(dropped, (key == dropped["_dropped"]) & (doc == dropped["_doc"]), "left_anti"))

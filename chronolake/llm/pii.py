"""Personal data: patterns find the protected entities, corpus co-occurrence the terms that reveal them.

The base kinds are exact patterns. Each found value is a protected entity, and so is its kind; every word of a document
that holds it, but for those in base spans, is one of its terms. Over all documents, PMI(entity; term) = log2(p(entity, term) / (p(entity) p(term)))
is compared with the entity's own information IC(entity) = -log2 p(entity), probabilities being shares of
documents. In the documents that hold the entity, a term that carries at least ``GENERALISE`` of that information is
generalised to its class, one that carries at least ``REMOVE`` of it is removed. A term that surely carries so much of a
value is also removed from all other documents: there it discloses the value by itself.

Where fewer than ``SUPPORT`` documents share entity and term, and for what is sure, p(entity | term) is not taken as observed but at the
lower end of its one-sided Wilson interval (``Z``): a rare value counts too, with no more than is certain of it.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_broadcast, crc_slot, crc_slots, forget, is_marked, marks, modest_batches, written

KINDS = ("email", "ip", "card", "phone")
SUPPORT = 3
#: 99.5 % of a normal variable lie below it.
Z = 2.576
GENERALISE, REMOVE = 0.6, 0.9
#: Stands for the entity where a term discloses one by itself.
EVERYWHERE = ""
#: Term counts that a task holds before it hands them on.
HELD = 100_000
#: Texts whose words a task holds at once.
TEXTS = 250
#: Pairs that a task holds before it hands them on, and parts into which the pairs of an entity are dealt.
PAIRS, SALTS = 100_000, 16
#: Disclosing pairs up to which they are broadcast (about 100 bytes each); beyond, they are shuffled.
BROADCAST_ROWS = 200_000

# Fixed patterns. A run of one class before a sign that it lacks is possessive and begins at its border: same matches, linear time.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_WORD = re.compile(r"[^\W_]+")
#: Bytes of UTF-8: ASCII letters in lower case and digits, all other ASCII blank, the rest as it is; and digits as 0, stops, all else blank.
_PLAIN = bytes(ord(chr(c).lower()) if chr(c).isalnum() else 32 for c in range(128)) + bytes(range(128, 256))
_DIGITS = bytes(48 if 48 <= c <= 57 else 46 if c == 46 else 32 for c in range(256))


def _luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start; code points, end exclusive."""
    spans = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            done = m.end()
            spans.append(("email", start, done))
        at = text.find("@", at + 1)
    digits = text.encode().translate(_DIGITS)  # patterns that lack digits are not tried
    if b"0.0" in digits:
        spans += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(int(p) <= 255 for p in (q.lstrip("0")[:4] or "0" for q in m[0].split(".")))]
    for m in _CARD.finditer(text) if digits.count(b"0") >= 16 else ():
        number = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(number) <= 19 and _luhn(number):
            spans.append(("card", m.start(), m.end()))
    if "+" in text:
        spans += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return spans


def _words(text: str) -> set[str]:
    """The different words of a text in lower case; only parts with signs beyond ASCII go through the pattern."""
    parts = set(text.encode().translate(_PLAIN).decode().split())
    if text.isascii():
        return parts
    words = {p.lower() for p in parts if p.isalnum()}
    words.update(w.lower() for p in parts if not p.isalnum() for w in _WORD.findall(p))
    return words


def _free_words(text: str, spans: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int]]:
    """(word, start, end) of each word that no base span touches."""
    taken = sorted((a, b) for _, a, b in spans)
    k = reach = 0
    for m in _WORD.finditer(text):
        a, b = m.span()
        while k < len(taken) and taken[k][0] < b:
            reach = max(reach, taken[k][1])
            k += 1
        if reach <= a:
            yield m[0].lower(), a, b


def _entities(text: str, spans: list[tuple[str, int, int]]) -> set[str]:
    """Each value, and its kind as such."""
    return {e for kind, a, b in spans for e in (kind, f"{kind}:{text[a:b]}")}


_SPAN = pa.struct([("kind", pa.string()), ("a", pa.int32()), ("b", pa.int32())])
_OWN = T.StructField("_own", T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType())])))


def _tuples(own: list[dict]) -> list[tuple[str, int, int]]:
    return [(s["kind"], s["a"], s["b"]) for s in own]


def _found(documents: DataFrame, text: str) -> DataFrame:
    """The rows that have base spans, with these (``_own``) and a digest of the text (``_key``)."""
    names = documents.columns

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, keys, spans = [], [], []
            for k, body in enumerate(batch.column(names.index(text))):
                own = base_spans(body.as_py() or "")
                if own:
                    keep.append(k)
                    keys.append(hashlib.sha256(body.as_py().encode()).digest())
                    spans.append([{"kind": s, "a": a, "b": b} for s, a, b in own])
            rows = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(keys, pa.binary()), pa.array(spans, pa.list_(_SPAN))], [*names, "_key", "_own"])

    return documents.mapInArrow(find, T.StructType([*documents.schema.fields, T.StructField("_key", T.BinaryType()), _OWN]))


def _others(documents: DataFrame, text: str, told: bytes, rest: list[str]) -> DataFrame:
    """The rows without base spans; with ``_key`` and no ``_own`` those that hold a marked term, without a key and with the columns ``rest`` only those that do not."""
    names = documents.columns
    bits = documents.sparkSession.sparkContext.broadcast(told)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, TEXTS):
                batch = whole.slice(at, TEXTS)
                bodies = [body or "" for body in batch.column(names.index(text)).to_pylist()]
                plain = [k for k, body in enumerate(bodies) if not base_spans(body)]
                words = [_words(bodies[k]) for k in plain]
                every = list(set().union(*words))
                hit = {w for w, there in zip(every, is_marked(bits.value, crc_slots([f"{EVERYWHERE}\n{w}" for w in every])), strict=True) if there}
                keys = [None if own.isdisjoint(hit) else hashlib.sha256(bodies[k].encode()).digest() for k, own in zip(plain, words, strict=True)]
                rows, keys = batch.take(pa.array(plain, pa.int64())), pa.array(keys, pa.binary())
                columns = [c if n in rest else pc.if_else(keys.is_valid(), c, pa.scalar(None, c.type)) for n, c in zip(names, rows.columns, strict=True)]
                yield pa.RecordBatch.from_arrays([*columns, keys, pa.array([[]] * len(plain), pa.list_(_SPAN))], [*names, "_key", "_own"])

    fields = [f if f.name in rest else T.StructField(f.name, f.dataType) for f in documents.schema.fields]
    return documents.mapInArrow(find, T.StructType([*fields, T.StructField("_key", T.BinaryType()), _OWN]))


def _document_counts(documents: DataFrame, text: str) -> DataFrame:
    """(term, n): documents that hold each word outside base spans, summed in tasks before they are shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["term", "n"])

        for batch in batches:
            for body in batch.column(0).to_pylist():
                own = base_spans(body)
                held.update({w for w, _, _ in _free_words(body, own)} if own else _words(body))
                if len(held) > HELD:
                    yield out()
                    held.clear()
        yield out()

    rows = documents.where(F.col(text).isNotNull()).select(F.col(text).alias("text"))
    return rows.mapInArrow(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def _entity_counts(found: DataFrame, text: str) -> DataFrame:
    """(entity, n_entity): documents that hold it."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = Counter(e for body, own in zip(*(c.to_pylist() for c in batch.columns)) for e in _entities(body, _tuples(own)))
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["entity", "n"])

    return found.select(text, "_own").mapInArrow(each, "entity string, n long").groupBy("entity").agg(F.sum("n").alias("n_entity"))


def _marked(words: list[str], bits: bytes) -> list[str]:
    return [w for w, there in zip(words, is_marked(bits, crc_slots(words))) if there]


def _most(n_entity: int, n_docs: int) -> int:
    """A term that more documents hold cannot carry ``GENERALISE`` of the entity's information, were it in all that hold the entity."""
    return int(n_entity / (n_entity / n_docs) ** (1 - GENERALISE) * (1 + 1e-9)) + 1


def _pair_counts(found: DataFrame, text: str, entities: DataFrame, counts: DataFrame, n_docs: int) -> DataFrame:
    """(entity, term, n_both): documents that hold both, summed in tasks before they are shuffled.

    With values only terms that are rare enough to disclose them are counted. Bitmaps tell which these are; what they
    let through beyond that is counted and judged like the rest.
    """
    values = entities.where(~F.col("entity").isin(*KINDS))
    most = _most(values.agg(F.max("n_entity")).first()[0] or 1, n_docs)
    send = found.sparkSession.sparkContext.broadcast
    rare_terms = send(marks(counts.where(F.col("n") <= _most(SUPPORT - 1, n_docs)), "term", crc_slot))
    any_terms = send(marks(counts.where(F.col("n") <= most), "term", crc_slot))
    frequent = send(marks(values.where(F.col("n_entity") >= SUPPORT), "entity", crc_slot))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[tuple[str, str]] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([e for e, _ in held], pa.string()), pa.array([t for _, t in held], pa.string()), pa.array(list(held.values()), pa.int64())], ["entity", "term", "n"])

        for batch in batches:
            for body, own in zip(*(c.to_pylist() for c in batch.columns)):
                spans = _tuples(own)
                terms = list({w for w, _, _ in _free_words(body, spans)})
                rare, some = _marked(terms, rare_terms.value), _marked(terms, any_terms.value)
                every = list(_entities(body, spans))
                for entity, often in zip(every, is_marked(frequent.value, crc_slots(every))):
                    held.update((entity, t) for t in (terms if entity in KINDS else some if often else rare))
                    if len(held) > PAIRS:
                        yield out()
                        held.clear()
        yield out()

    return found.select(text, "_own").mapInArrow(count, "entity string, term string, n long").groupBy("entity", "term").agg(F.sum("n").alias("n_both"))


def _pairs_of_texts(found: DataFrame, text: str, told: bytes) -> DataFrame:
    """(_key, entity, term) for the pairs of a text, and its terms by themselves, that the bitmap of the disclosing ones lets through."""
    bits = found.sparkSession.sparkContext.broadcast(told)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, entities, terms = [], [], []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(entities, pa.string()), pa.array(terms, pa.string())], ["_key", "entity", "term"])

        for batch in batches:
            for key, body, own in zip(*(c.to_pylist() for c in batch.columns)):
                spans = _tuples(own)
                words = {w for w, _, _ in _free_words(body, spans)}
                for entity in {EVERYWHERE, *_entities(body, spans)}:
                    hits = [p.rpartition("\n")[2] for p in _marked([f"{entity}\n{w}" for w in words], bits.value)]
                    keys += [key] * len(hits)
                    entities += [entity] * len(hits)
                    terms += hits
                    if len(keys) > PAIRS:
                        yield out()
                        keys, entities, terms = [], [], []
        yield out()

    return found.select("_key", text, "_own").mapInArrow(pairs, "_key binary, entity string, term string")


def _surely(n_both: Column, n: Column) -> Column:
    """The lower end of the one-sided Wilson interval of n_both / n."""
    p = n_both / n
    return (p + Z * Z / 2 / n - Z * F.sqrt(p * (1 - p) / n + Z * Z / 4 / n / n)) / (1 + Z * Z / n)


def _disclosing(documents: DataFrame, found: DataFrame, text: str) -> DataFrame:
    """(entity, term, kind), kind being ``generalise`` or ``remove``; the entity ``EVERYWHERE`` has the terms that disclose one on their own."""
    n_docs = max(documents.count(), 1)
    counts, held = written(_document_counts(documents, text), "terms"), written(_entity_counts(found, text), "values")
    together = written(_pair_counts(found, text, held, counts, n_docs), "pairs").withColumn("_salt", F.pmod(F.xxhash64("term"), F.lit(SALTS)))
    salts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))
    entities = held.select("entity", "n_entity", salts.alias("_salt"))
    pairs = together.join(entities, ["entity", "_salt"]).join(counts, "term")
    given = F.when(F.col("n_both") >= SUPPORT, F.col("n_both") / F.col("n")).otherwise(_surely(F.col("n_both"), F.col("n")))
    share = lambda p: F.log2(p * F.lit(n_docs) / F.col("n_entity")) / F.greatest(F.log2(F.lit(n_docs) / F.col("n_entity")), F.lit(1e-9))
    sure = (share(_surely(F.col("n_both"), F.col("n"))) >= REMOVE) & ~F.col("entity").isin(*KINDS)
    judged = pairs.select("*", share(given).alias("share"), sure.alias("sure")).where(F.col("share") >= GENERALISE)
    judged = written(judged.select("entity", "term", "sure", F.when(F.col("share") >= REMOVE, "remove").otherwise("generalise").alias("kind")), "judged")
    alone = judged.where("sure").groupBy("term").agg(F.max("kind").alias("kind")).select(F.lit(EVERYWHERE).alias("entity"), "term", "kind")
    out = written(judged.select("entity", "term", "kind").unionByName(alone), "disclosing")
    forget(counts, held, judged)
    return out


def _judged(documents: DataFrame, text: str, out: Callable[[pa.RecordBatch, list[list[tuple[str, int, int]]]], pa.RecordBatch], schema: T.StructType, rest: list[str]) -> tuple[DataFrame, DataFrame]:
    """What ``out`` makes of the rows that have spans and of all their spans, sorted by kind as listed, then start; and the columns ``rest`` of the rows that surely have none.

    Beside the base kinds there are ``generalise`` and ``remove``, the disclosing terms. Every row is a document to the
    counts and is judged by its own text, whatever its other columns say. Null and empty texts have no spans.
    """
    found = written(_found(documents, text), "entities")
    disclosing = _disclosing(documents, found, text)
    pair = F.concat_ws("\n", "entity", "term").alias("pair")
    told = marks(disclosing.select(pair), "pair", crc_slot)
    everywhere = marks(disclosing.where(F.col("entity") == EVERYWHERE).select(pair), "pair", crc_slot)
    others = written(_others(documents, text, everywhere, rest), "others")  # one pass over the texts
    found = found.unionByName(others.where("_key is not null"))
    known = _pairs_of_texts(found, text, told).join(bounded_broadcast(disclosing, disclosing.count(), BROADCAST_ROWS), ["entity", "term"])
    known = known.groupBy("_key", "term").agg(F.max("kind").alias("kind"))  # removal beats generalisation
    terms = known.groupBy("_key").agg(F.collect_list(F.struct("term", "kind")).alias("_terms"))
    names = documents.columns
    order = {k: i for i, k in enumerate((*KINDS, "generalise", "remove"))}

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = []
            for body, own, told in zip(*(batch.column(k).to_pylist() for k in (names.index(text), len(names), len(names) + 1))):
                base, kinds = _tuples(own), {t["term"]: t["kind"] for t in told or ()}
                more = [(kinds[w], a, b) for w, a, b in _free_words(body, base) if w in kinds] if kinds else []
                spans.append(sorted(base + more, key=lambda s: (order[s[0]], s[1], s[2])))
            yield out(batch.select(list(range(len(names)))), spans)

    return found.join(terms, "_key", "left").select(*names, "_own", "_terms").mapInArrow(judge, schema), others.where("_key is null").select(rest)


def report(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row of ``documents``: ``doc_id``, counts by kind, ``base`` and ``spans`` as ``kind:start:end``, comma-joined."""
    modest_batches(documents.sparkSession)
    docs = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base", "spans"]

    def said(spans: list[tuple[str, int, int]]) -> str:
        return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)

    def out(rows: pa.RecordBatch, spans: list[list[tuple[str, int, int]]]) -> pa.RecordBatch:
        numbers = [pa.array([sum(s[0] == k for s in own) for own in spans], pa.int64()) for k in KINDS]
        base = pa.array([said([s for s in own if s[0] in KINDS]) for own in spans], pa.string())
        return pa.RecordBatch.from_arrays([rows.column(0), *numbers, base, pa.array(map(said, spans), pa.string())], names)

    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(f"n_{k}", T.LongType()) for k in KINDS), T.StructField("base", T.StringType()), T.StructField("spans", T.StringType())])
    judged, others = _judged(docs, "text", out, schema, ["doc_id"])
    blank = others.select("doc_id", *(F.lit(0).cast("long").alias(f"n_{k}") for k in KINDS), F.lit("").alias("base"), F.lit("").alias("spans"))
    return judged.unionByName(blank)


def sanitise(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``documents`` with base spans replaced by their kind, disclosing terms by their class or nothing; columns as given.

    Where spans overlap, the one that starts first (then the longer) is replaced and what is left of the other as well.
    """
    modest_batches(documents.sparkSession)
    # Columns go by number, so that none can be taken for one of those added on the way.
    names = [f"c{k}" for k in range(len(documents.columns))]
    body = names[documents.columns.index(text)]
    docs = documents.toDF(*names)

    def out(rows: pa.RecordBatch, spans: list[list[tuple[str, int, int]]]) -> pa.RecordBatch:
        bodies = map(replaced, rows.column(names.index(body)).to_pylist(), spans)
        return pa.RecordBatch.from_arrays([pa.array(bodies, pa.string()) if n == body else rows.column(n) for n in names], names)

    judged, others = _judged(docs, body, out, docs.schema, names)
    return judged.unionByName(others).toDF(*documents.columns)


def replaced(text: str, own: list[tuple[str, int, int]]) -> str:
    out, at = [], 0
    for kind, a, b in sorted(own, key=lambda s: (s[1], -s[2])):
        if b <= at:
            continue
        word = text[a:b]
        instead = "" if kind == "remove" else (f"[{kind.upper()}]" if kind in KINDS else "[NUMBER]" if word.isdigit() else "[NAME]" if word[:1].isupper() else "[TERM]")
        out += [text[at : max(a, at)], instead]
        at = b
    return "".join([*out, text[at:]])

"""Token counts of whole texts without their ids: pieces once a distinct pre-token, joined to the pre-tokens of each document.

The corpus is read twice. The first pass counts how often each pre-token stands in it, and each distinct one goes
through the vocabulary's merges once. The second joins every document's pre-token frequencies with these pieces: the most
frequent ones by a table of bounded size that all tasks hold, the others by a join on the pre-token.
"""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_counted, modest_batches, written
from .tokens import REMEMBERED, byte_signs, tokenizer_path

#: Pre-tokens, and bytes of each, of the table that all tasks hold: at most 16 MB of text.
HELD, HELD_BYTES = 1 << 18, 64
#: Distinct chunks after which a task hands on what it has counted.
COUNTED = 200_000
#: Letters, then signs but apostrophes: two pre-tokens at most, of which normalisation changes nothing but the case.
_SIMPLE = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")
_PROBES = ("Word", "ÉtÉ", "Straße", "aB,.", "Ñu<|", "x--!")
#: Before the text of a special token, which is a piece by itself. No pre-token of bytes begins with it.
SPECIAL = "\0"

_loaded: dict[str, PreTokens] = {}


class PreTokens(dict):
    """chunk between blanks -> its pre-tokens, as the library's own normaliser and pre-tokenizer give them.

    For tokenizers that drop white space: their pre-tokens never cross it. Special tokens are found first, as the library does.
    """

    def __init__(self, path: str) -> None:
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        self.normal, self.pre, self.model = whole.normalizer, whole.pre_tokenizer, whole.model
        special = sorted((t.content for t in whole.get_added_tokens_decoder().values()), key=len, reverse=True)
        if any(re.search(r"\s", s) for s in special):
            raise ValueError("a special token holds white space, at which texts are cut")
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.signs = byte_signs()
        self.shortcut = all(self.simple(_SIMPLE.fullmatch(p)) == tuple(self.plain(p)) for p in _PROBES)

    def simple(self, found: re.Match[str]) -> tuple[str, ...]:
        word = found[1].lower()
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self.signs)
        return (word, found[2]) if found[2] else (word,)

    def plain(self, text: str) -> list[str]:
        if self.normal is not None:
            text = self.normal.normalize_str(text)
        return [t for t, _ in self.pre.pre_tokenize_str(text)] if text else []

    def __missing__(self, chunk: str) -> tuple[str, ...]:
        if self.shortcut and (found := _SIMPLE.fullmatch(chunk)):
            out = self.simple(found)
        elif self.special is not None and self.special.search(chunk):
            out = tuple(t for k, part in enumerate(self.special.split(chunk)) for t in ([SPECIAL + part] if k % 2 else self.plain(part)))
        else:
            out = tuple(self.plain(chunk))
        if len(chunk) <= 40:
            if len(self) >= REMEMBERED:
                self.clear()
            self[chunk] = out
        return out

    def pieces(self, pre_token: str) -> int:
        return 1 if pre_token.startswith(SPECIAL) else len(self.model.tokenize(pre_token))


def pre_tokens(path: str | None) -> PreTokens:
    """The worker's own table for the tokenizer at ``path``; a task empties it when it is done with it."""
    path = path or tokenizer_path()
    if path not in _loaded:
        _loaded[path] = PreTokens(path)
    return _loaded[path]


def chunks(text: str) -> list[str]:
    """Parts between blanks; empty ones may be among them."""
    for blank in "\n\t\r":
        text = text.replace(blank, " ")
    return text.split(" ")


def pieces_table(documents: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """``pre_token, times, pieces``: every distinct pre-token of the corpus, how often it stands there and how many pieces it has."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, found = pre_tokens(tokenizer), Counter()

        def handed() -> pa.RecordBatch:
            times = Counter()
            for chunk, n in found.items():
                for t in table[chunk]:
                    times[t] += n
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(times.keys(), pa.string()), pa.array(times.values(), pa.int64())], ["pre_token", "times"])

        for batch in batches:
            for text in batch.column(0):
                found.update(chunks(text.as_py() or ""))
                if len(found) >= COUNTED:
                    yield handed()
        yield handed()
        table.clear()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pre_tokens(tokenizer)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(map(table.pieces, batch.column(0).to_pylist()), pa.int64())], ["pre_token", "times", "pieces"])

    counted = documents.select("text").mapInArrow(count, "pre_token string, times long").groupBy("pre_token").agg(F.sum("times").alias("times"))
    return counted.mapInArrow(measure, "pre_token string, times long, pieces long")


def most_frequent(table: DataFrame, most: int) -> dict[str, int]:
    """pre-token -> pieces of at most ``most`` short pre-tokens: those from a frequency on, of which there are so few.

    Frequencies are taken by eighths of powers of two, so tasks hand some hundred counts to the driver before the pre-tokens.
    """
    step = table.where(F.octet_length("pre_token") <= HELD_BYTES).withColumn("_step", F.floor(F.log2("times") * 8))
    total, least = 0, None
    for at, n in sorted(step.groupBy("_step").count().collect(), reverse=True):
        total += n
        if total > most:
            break
        least = at
    return {} if least is None else {r[0]: r[1] for r in step.where(F.col("_step") >= least).select("pre_token", "pieces").collect()}


def count_tokens(documents: DataFrame, limit: int = 2048, tokenizer: str | None = None, held: int = HELD) -> DataFrame:
    """Per row: ``doc_id``, its UTF-8 bytes, its tokens and whether these are more than ``limit``.

    Counted as the library does for the whole text, without special tokens of its own; those inside texts are a token each. Null and
    empty texts have none. Repeated rows and null ids are rows of their own; no documents give no row; extra columns are ignored.
    ``tokenizer`` is a tokenizers file that drops white space. ``held`` bounds the table that all tasks hold; it changes the
    plan, not the result.
    """
    modest_batches(documents.sparkSession)
    table = written(pieces_table(documents, tokenizer), "pieces")
    shared = documents.sparkSession.sparkContext.broadcast(most_frequent(table, held))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, known, row = pre_tokens(tokenizer), shared.value, TaskContext.get().partitionId() << 40
        sums: dict[str, int | None] = {}  # of a chunk: its pieces, if all of its pre-tokens are known
        for batch in batches:
            keys, docs, sizes, tokens, amounts = [], [], [], [], []
            for doc, size, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                row, total, others = row + 1, 0, Counter()
                for chunk, n in Counter(chunks(text.as_py() or "")).items():
                    pieces = sums.get(chunk, -1)
                    if pieces == -1:
                        found = [known.get(t) for t in own[chunk]]
                        pieces = None if None in found else sum(found)
                        if len(chunk) <= 40:
                            if len(sums) >= REMEMBERED:
                                sums.clear()
                            sums[chunk] = pieces
                    if pieces is not None:
                        total += n * pieces
                        continue
                    for t in own[chunk]:
                        if t in known:
                            total += n * known[t]
                        else:
                            others[t] += n
                keys += [row] * (1 + len(others))
                docs += [doc] + [None] * len(others)
                sizes += [size] + [None] * len(others)
                tokens += [None, *others]
                amounts += [total, *others.values()]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((keys, docs, sizes, tokens, amounts), kinds, strict=True)], ["row", "doc_id", "n_bytes", "pre_token", "n"])
        own.clear()

    given = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    found = written(given.mapInArrow(join, "row long, doc_id long, n_bytes long, pre_token string, n long"), "frequencies")
    rare = found.where(F.col("pre_token").isNotNull()).select("row", "pre_token", "n")
    others = written(rare.groupBy("pre_token").agg(F.count("*").alias("documents")).join(table.select("pre_token", "pieces"), "pre_token"), "rare")
    more = join_counted(rare, others, "pre_token", "documents").select("row", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("n_bytes"), (F.col("n") * F.col("pieces")).alias("n"))
    both = found.where(F.col("pre_token").isNull()).select("row", "doc_id", "n_bytes", "n").unionByName(more)
    counted = both.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum("n").alias("n_tokens"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))

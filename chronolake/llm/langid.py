"""Language ID of whole texts: script ranges narrow the candidates, Viterbi labels spans of words.

A language is a distribution of letter trigrams (word borders included), hashed into ``SLOTS`` places and
counted over all labelled texts. A word scores its letters' log-probabilities under each language that
is written in the word's script; Viterbi then labels the words, paying ``penalty`` at each switch.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import modest_batches

SLOTS = 1 << 16
PENALTY = 12.0
UNDETERMINED = "und"
#: A language is a candidate for a script that has at least this share of its letters.
SCRIPT_SHARE = 0.01
#: The share of a text's letters that one language has to label for the text to be kept.
LEAST = 0.5
#: Characters scored at once.
AT_ONCE = 500_000

#: First code points of script ranges (fixed values); letters outside share the script 0.
SCRIPTS = (
    (0x0041, 0x024F, "latin"), (0x0370, 0x03FF, "greek"), (0x0400, 0x052F, "cyrillic"), (0x0530, 0x058F, "armenian"),
    (0x0590, 0x05FF, "hebrew"), (0x0600, 0x06FF, "arabic"), (0x0900, 0x097F, "devanagari"), (0x0980, 0x09FF, "bengali"),
    (0x0B80, 0x0BFF, "tamil"), (0x0C00, 0x0C7F, "telugu"), (0x0E00, 0x0E7F, "thai"), (0x10A0, 0x10FF, "georgian"),
    (0x1E00, 0x1EFF, "latin"), (0x3040, 0x30FF, "kana"), (0x3400, 0x4DBF, "han"), (0x4E00, 0x9FFF, "han"), (0xAC00, 0xD7AF, "hangul"),
)


@lru_cache(1)
def _characters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: its lower case if it is a letter (else 0), and its script's number."""
    lower, script = np.zeros(0x110000, np.uint32), np.zeros(0x110000, np.uint8)
    for k in range(0x110000):
        c = chr(k)
        if c.isalpha():
            lower[k] = ord(x) if len(x := c.lower()) == 1 else k
    names = list(dict.fromkeys(s[2] for s in SCRIPTS))
    for first, last, name in SCRIPTS:
        script[first : last + 1] = names.index(name) + 1
    return lower, script


N_SCRIPTS = len({s[2] for s in SCRIPTS}) + 1


def _letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the joined texts: positions of letters, their trigram slots, scripts, which begin a word, and texts' ends."""
    lower, script = _characters()
    codes = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le"), np.uint32)
    low = lower[codes]
    at = np.flatnonzero(low)
    padded = np.concatenate(([0], low, [0])).astype(np.uint32)
    mixed = padded[at] * np.uint32(0x9E3779B1) + padded[at + 1] * np.uint32(0x85EBCA77) + padded[at + 2] * np.uint32(0xC2B2AE3D)
    mixed ^= mixed >> np.uint32(15)
    slots = (mixed * np.uint32(0x2C1B3C6D)) >> np.uint32(16)
    ends = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)
    return at, slots.astype(np.int64), script[codes[at]], padded[at] == 0, ends


def train(labelled: DataFrame, lang: str = "lang", text: str = "text") -> dict[str, np.ndarray]:
    """Letter trigram and script counts of each language over all rows; ``SLOTS + N_SCRIPTS`` numbers a language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            by: dict[str, list[str]] = {}
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by.setdefault(name, []).append(body)
            for name, bodies in by.items():
                own = sums.setdefault(name, np.zeros(SLOTS + N_SCRIPTS, np.int64))
                for part in _parts(bodies):
                    _, slots, scripts, _, _ = _letters(part)
                    own[:SLOTS] += np.bincount(slots, minlength=SLOTS)
                    own[SLOTS:] += np.bincount(scripts, minlength=N_SCRIPTS)
        for name, own in sums.items():
            some = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(some)), pa.array(some), pa.array(own[some])], ["lang", "slot", "n"])

    modest_batches(labelled.sparkSession)
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    counts = rows.mapInArrow(count, "lang string, slot long, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    packed = counts.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("slot", "n"))).alias("c")).select("lang", "c.slot", "c.n").toArrow()
    model = {}
    for name, slots, n in zip(*(packed.column(k).to_pylist() for k in range(3)), strict=True):
        model[name] = np.zeros(SLOTS + N_SCRIPTS, np.int64)
        model[name][slots] = n
    return dict(sorted(model.items()))


def _parts(texts: list[str], most: int = AT_ONCE) -> Iterator[list[str]]:
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= most:
            yield part
            part, size = [], 0
    if part:
        yield part


class _Scorer:
    def __init__(self, model: dict[str, np.ndarray]) -> None:
        counts = np.stack(list(model.values()))
        tri = counts[:, :SLOTS] + 0.1
        self.table = np.log(tri / tri.sum(axis=1, keepdims=True)).T.astype(np.float32)
        share = counts[:, SLOTS:] / np.maximum(counts[:, SLOTS:].sum(axis=1, keepdims=True), 1)
        fits = (share >= SCRIPT_SHARE).T
        fits[~fits.any(axis=1)] = True
        self.unfit = np.where(fits, 0, -1e4).astype(np.float32)

    def words(self, texts: list[str]) -> tuple[np.ndarray, ...]:
        """Of all words in turn: scores by language, letters, first and last position in the text; and words in each text."""
        found = []
        for part in _parts(texts):
            at, slots, scripts, begins, ends = _letters(part)
            first = np.flatnonzero(begins)
            if not len(first):
                found.append((np.zeros((0, self.table.shape[1]), np.float32), *[np.zeros(0, np.int64)] * 3, np.zeros(len(part), np.int64)))
                continue
            scores = np.add.reduceat(self.table[slots], first, axis=0) + self.unfit[scripts[first]]
            n = np.diff(np.append(first, len(at)))
            text = np.searchsorted(ends, at[first], "right")
            start = at[first] - np.concatenate(([0], ends))[text]
            found.append((scores, n, start, start + n, np.bincount(text, minlength=len(part))))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def viterbi(scores: np.ndarray, sizes: np.ndarray, penalty: float) -> np.ndarray:
    """Labels that maximise the sum of scores less ``penalty`` per switch, for runs of ``sizes`` rows side by side."""
    labels = np.zeros(len(scores), np.int32)
    order = np.argsort(-sizes, kind="stable")
    order = order[sizes[order] > 0]
    if not len(order):
        return labels
    size = sizes[order]
    start = (np.cumsum(sizes) - sizes)[order]
    live = np.searchsorted(-size, -np.arange(size[0]), "left")  # runs longer than t
    switch, source = np.zeros(scores.shape, bool), np.zeros(len(scores), np.int16)
    value, last = scores[start], np.zeros(len(order), np.int64)
    for t in range(1, size[0]):
        n = live[t]
        if n < len(value):
            last[n : len(value)] = value[n:].argmax(axis=1)
            value = value[:n]
        best = value.argmax(axis=1)
        other = (value[np.arange(n), best] - penalty)[:, None]
        row = start[:n] + t
        switch[row], source[row] = value < other, best
        value = np.maximum(value, other) + scores[row]
    last[: len(value)] = value.argmax(axis=1)
    for t in range(size[0] - 1, -1, -1):
        row = start[: live[t]] + t
        own = last[: live[t]]
        labels[row] = own
        last[: live[t]] = np.where(switch[row, own], source[row], own)
    return labels


def _labels(texts: list[str], scorer: _Scorer | None, names: list[str], penalty: float) -> tuple[list[str], list[float], list[str]]:
    """Languages, scores and spans of ``texts``, texts of like length side by side, some characters at a time."""
    pred, score, spans = [UNDETERMINED] * len(texts), [0.0] * len(texts), [""] * len(texts)
    order = sorted(range(len(texts)), key=lambda k: -len(texts[k]))
    done = 0
    for part in _parts([texts[k] for k in order], 2 * AT_ONCE):
        for k, p, s, x in zip(order[done : done + len(part)], *_labels_at_once(part, scorer, names, penalty), strict=True):
            pred[k], score[k], spans[k] = p, s, x
        done += len(part)
    return pred, score, spans


def _labels_at_once(texts: list[str], scorer: _Scorer | None, names: list[str], penalty: float) -> tuple[list[str], list[float], list[str]]:
    pred, score, spans = [UNDETERMINED] * len(texts), [0.0] * len(texts), [""] * len(texts)
    if scorer and texts:
        scores, n, start, end, sizes = scorer.words(texts)
        labels = viterbi(scores, sizes, penalty)
        owner = np.repeat(np.arange(len(texts)), sizes)
        letters = np.bincount(owner * len(names) + labels, n, len(texts) * len(names)).reshape(-1, len(names))
        new = np.append(True, (owner[1:] != owner[:-1]) | (labels[1:] != labels[:-1])) if len(owner) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(owner)) - 1
        held: dict[int, list[str]] = {}
        for doc, a, b, k in zip(owner[first].tolist(), start[first].tolist(), end[last].tolist(), labels[first].tolist(), strict=True) if len(first) else ():
            held.setdefault(doc, []).append(f"{a}:{b}:{names[k]}")
        for doc, parts in held.items():
            best = int(letters[doc].argmax())
            pred[doc], score[doc], spans[doc] = names[best], float(letters[doc, best] / letters[doc].sum()), ",".join(parts)
    return pred, score, spans


def keep_identified(documents: DataFrame, model: dict[str, np.ndarray], least: float = LEAST, penalty: float = PENALTY, text: str = "text") -> DataFrame:
    """``documents`` of which one language labels at least the share ``least`` of the letters; columns as given.

    Null texts and texts without letters go. Where no language was learned, every text with a letter stays.
    """
    modest_batches(documents.sparkSession)
    names, at = list(model), documents.columns.index(text)
    shipped = documents.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(shipped.value) if names else None
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            if scorer is None:
                stay = [any(map(str.isalpha, t)) for t in texts]
            else:
                pred, score, _ = _labels(texts, scorer, names, penalty)
                stay = [p != UNDETERMINED and s >= least for p, s in zip(pred, score, strict=True)]
            yield batch.filter(pa.array(stay, pa.bool_()))

    return documents.mapInArrow(keep, documents.schema)


def identify(documents: DataFrame, model: dict[str, np.ndarray], penalty: float = PENALTY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Labels whole texts: ``doc_id, lang_pred, score, spans``.

    ``lang_pred`` has the most letters (ties: first by name), ``score`` is its share of them and ``spans``
    are ``start:end:lang`` by code points, comma-joined. ``und`` with score 0 and no spans where the text
    is null, has no letter, or no language was learned. Repeated rows are labelled alike; no rows give none; a very
    long text is scored a part at a time, and its words are labelled together.
    """
    modest_batches(documents.sparkSession)
    names = list(model)
    shipped = documents.sparkSession.sparkContext.broadcast(model)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(shipped.value) if names else None
        for batch in batches:
            pred, score, spans = _labels([t or "" for t in batch.column(1).to_pylist()], scorer, names, penalty)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(spans, pa.string())], ["doc_id", "lang_pred", "score", "spans"])

    kind = dict(documents.dtypes)[doc_id]
    return documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(label, f"doc_id {kind}, lang_pred string, score double, spans string")

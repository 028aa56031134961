"""Toxicity: noisy-channel deobfuscation, then a linear model over the restored words.

A token that mixes letters with other signs, repeats a letter, or is a run of spaced single letters spans
a lattice: each sign may be itself, the letters that it imitates, or nothing (separators, repeats). Viterbi
picks the reading that is likeliest under a letter trigram model of the whole corpus less the channel's
costs. A logistic model on words and word beginnings of the original and the restored text gives the score.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_broadcast, modest_batches, written

#: Letters that signs imitate (fixed values).
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e"}
#: Labelled rows that the model is fitted on at most (those with the least hash of doc_id), and its features.
FIT_ROWS, FEATURES = 20_000, 4096
#: Documents of the fitted rows that a feature must occur in.
SUPPORT = 3
SWAP, DROP, REPEAT, KEEP = 1.0, 0.5, 1.0, 8.0
ALPHABET = 27  # the border and a-z

_CLOSING = re.compile(r"^[\"'(\[{<*#&%.,;:?-]+|[\"')\]}>.,;:?!*#&%-]+$|([^\w\s])\1+$")
_LETTERS = re.compile(r"[^\W\d_]+")
_ODD = re.compile(r"[^\W\d_].*[\d_\W]|[\d_\W].*[^\W\d_]|(.)\1\1", re.S)
_SPACED = re.compile(r"(?<!\S)(?:[\w@$!|+€]\s){2,}[\w@$!|+€](?!\S)")
_LONG_RUN = re.compile(r"(.)\1{3,}", re.S)


@lru_cache(1)
def _folds() -> np.ndarray:
    """For each code point of the basic plane: 1-26 for letters that are a-z without their marks, else 0."""
    fold = np.zeros(0x10000, np.uint8)
    for k in range(0x10000):
        base = unicodedata.normalize("NFD", chr(k).lower())[:1]
        if "a" <= base <= "z" and chr(k).isalpha():
            fold[k] = ord(base) - 96
    return fold


def letter_model(documents: DataFrame, text: str = "text") -> np.ndarray:
    """Log-probabilities [two letters before, next letter] counted over all whole texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, fold = np.zeros(ALPHABET**3, np.int64), _folds()
        for batch in batches:
            for body in batch.column(0):
                codes = np.frombuffer(f"  {body.as_py()} ".encode("utf-32-le"), np.uint32)
                x = fold[np.where(codes < 0x10000, codes, 0)].astype(np.int64)
                tri = (x[:-2] * ALPHABET + x[1:-1]) * ALPHABET + x[2:]
                sums += np.bincount(tri[(x[1:-1] > 0) | (x[2:] > 0)], minlength=ALPHABET**3)
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(sums[some])], ["k", "n"])

    rows = documents.where(F.col(text).isNotNull()).select(F.col(text).alias("text"))
    counts = rows.mapInArrow(count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()  # 27^3 rows at most
    tri = np.full(ALPHABET**3, 0.05)
    tri[counts.column("k").to_numpy()] += counts.column("n").to_numpy()
    tri = tri.reshape(-1, ALPHABET)
    return np.log(tri / tri.sum(axis=1, keepdims=True))


def _readings(sign: str, before: str) -> list[tuple[int, float]]:
    """(letter 1-26, or 0 for nothing; cost) of a sign after another."""
    letter = int(_folds()[ord(sign)]) if ord(sign) < 0x10000 else 0
    if letter:
        return [(letter, 0.0), *([(0, REPEAT)] if sign == before else [])]
    found = [(ord(x) - 96, SWAP) for x in LEET.get(sign, "")]
    return [*found, (0, KEEP if found else DROP)]


def restore(token: str, model: list[list[float]]) -> str:
    """The likeliest letters behind ``token``; linear in its length."""
    beams: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
    before = ""
    for sign in _LONG_RUN.sub(r"\1\1\1", token.lower()):
        following: dict[tuple[int, int], tuple[float, tuple]] = {}
        for letter, cost in _readings(sign, before):
            for (a, b), (score, path) in beams.items():
                at, own, way = ((b, letter), score + model[a * ALPHABET + b][letter] - cost, (path, letter)) if letter else ((a, b), score - cost, path)
                if at not in following or own > following[at][0]:
                    following[at] = (own, way)
        beams, before = following, sign
    _, path = max((score + model[a * ALPHABET + b][0], path) for (a, b), (score, path) in beams.items())
    out = []
    while path:
        path, letter = path
        out.append(chr(96 + letter))
    return "".join(reversed(out))


def _features(word: str) -> list[int]:
    return [zlib.crc32(x.encode()) for x in (word, f"^{word[:5]}", f"^{word[:7]}")]


class Reader(dict):
    """token -> the features of its words as written and as restored, as ``keep`` maps them."""

    def __init__(self, model: np.ndarray, keep: Callable[[int], int | None]) -> None:
        super().__init__()
        self.model, self.keep = model.tolist(), keep

    def __missing__(self, token: str) -> tuple[int, ...]:
        bare = _CLOSING.sub("", token)
        words = set(_LETTERS.findall(token.lower()))
        if _ODD.search(bare):
            words.add(restore(bare, self.model))
        found = tuple({k for w in words if w for f in _features(w) if (k := self.keep(f)) is not None})
        if len(token) <= 40:
            if len(self) > 1_000_000:
                self.clear()
            self[token] = found
        return found

    def of(self, text: str | None) -> set[int]:
        if not text:
            return set()
        spaced = ["".join(m.split()) for m in _SPACED.findall(text)]
        return set().union(*map(self.__getitem__, set(text.split())), *map(self.__getitem__, spaced))


@dataclass
class Model:
    letters: np.ndarray
    index: dict[int, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = -20.0
    key: str = field(default_factory=lambda: uuid.uuid4().hex)


_readers: dict[str, Reader] = {}


def _reader(model: Model) -> Reader:
    """The worker's own reader of this model; it outlives the task."""
    if model.key not in _readers:
        _readers.clear()
        _readers[model.key] = Reader(model.letters, model.index.get)
    return _readers[model.key]


def train(documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """The letter model from all ``documents``, the logistic model from a bounded sample of ``labels`` rows.

    ``labels`` has doc_id and label; rows without either are left out. With no labelled document, or only one
    class, the model scores the share of positives (0 with no rows).
    """
    modest_batches(documents.sparkSession)
    letters = letter_model(documents, text)
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc"), (F.col(label) > 0).cast("int").alias("label"))
    chosen_rows = known.orderBy(F.xxhash64("doc"), "doc", "label").limit(FIT_ROWS)
    bodies = documents.select(F.col(doc_id).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    sample = written(bodies.join(bounded_broadcast(chosen_rows, FIT_ROWS, FIT_ROWS), "doc").select("text", "label"), "sample")
    model = Model(letters)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, sums = Reader(letters, lambda f: f), {}
        for batch in batches:
            for body, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for f in reader.of(body):
                    both = sums.setdefault(f, [0, 0])
                    both[y] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), *(pa.array([v[y] for v in sums.values()], pa.int64()) for y in (0, 1))], ["f", "n0", "n1"])

    n1, n = (int(x or 0) for x in sample.agg(F.sum("label"), F.count("*")).first())
    if n:
        model.bias = float(np.log((n1 + 1e-6) / (n - n1 + 1e-6)))
    if not 0 < n1 < n:
        return model
    counts = sample.mapInArrow(count, "f long, n0 long, n1 long").groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).where(f"n0 + n1 >= {SUPPORT}")
    share = F.lit(n1 / n)
    lift = F.abs((F.col("n1") + 0.5 * share) / (F.col("n0") + F.col("n1") + 0.5) - share)
    gain = (F.col("n0") + F.col("n1")) * lift * lift
    chosen = [r[0] for r in counts.orderBy(gain.desc(), "f").limit(FEATURES).select("f").collect()]
    model.index = {f: k for k, f in enumerate(chosen)}

    def vector(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(letters, model.index.get)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([sorted(reader.of(b)) for b in batch.column(0).to_pylist()], pa.list_(pa.int32()))], ["label", "x"])

    data = sample.mapInArrow(vector, "label int, x array<int>").toArrow()  # FIT_ROWS sparse rows
    x = data.column("x").combine_chunks()
    model.weights, model.bias = _fit(x.flatten().to_numpy(), np.diff(x.offsets.to_numpy()), data.column("label").to_numpy().astype(float), len(chosen))
    return model


def _fit(columns: np.ndarray, sizes: np.ndarray, y: np.ndarray, width: int, ridge: float = 1.0, steps: int = 400) -> tuple[np.ndarray, float]:
    """Logistic regression with a ridge by Adam over all rows."""
    row = np.repeat(np.arange(len(y)), sizes)
    w = np.zeros(width + 1)
    w[-1] = np.log(y.mean() / (1 - y.mean()))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        z = np.bincount(row, w[columns], len(y)) + w[-1]
        slip = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        g = np.append(np.bincount(columns, slip[row], width) + ridge * w[:-1], slip.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def score(documents: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, score`` of every whole text; null and empty texts score as one without features; rows that repeat score alike."""

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, weights = _reader(model), model.weights
        for batch in batches:
            z = np.array([model.bias + weights[list(reader.of(b))].sum() for b in batch.column(1).to_pylist()], float)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], ["doc_id", "score"])

    return documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(rate, f"doc_id {dict(documents.dtypes)[doc_id]}, score double")

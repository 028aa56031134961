"""Ids of whole texts under a public tokenizer file, a chunk between blanks at a time."""

from __future__ import annotations

import os
import re
from array import array

TOKENIZER = "word_bpe_49k.json"
#: Chunks that a worker remembers at most; beyond, it starts afresh.
REMEMBERED = 250_000

#: A letter or digit, then closing signs: a border between pre-tokens. An apostrophe is left to the library.
_CLOSED = re.compile(r"(.*[A-Za-z0-9À-ÖØ-öø-ÿ])([!-&(-/:-@\[-`{-~]+)", re.S)
#: A chunk of these letters is one pre-token, and normalisation changes nothing but its case.
_LETTERS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")
_loaded: dict[str, Ids] = {}


def byte_signs() -> dict[int, str]:
    """The sign by which byte-level vocabularies know each byte: itself where it prints, else the next from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in prints]
    return {b: chr(b) for b in prints} | {b: chr(256 + k) for k, b in enumerate(others)}


class Ids(dict):
    """chunk -> its ids as little-endian unsigned 32-bit integers.

    The tokenizer drops white space and its pre-tokens never cross it, so ids of a text are those of its chunks. A chunk
    of plain letters goes to the vocabulary's merges directly, which spares it normalisers and patterns.
    """

    def __init__(self, path: str) -> None:
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        self.encode, self.merged, self.signs = whole.encode, whole.model.tokenize, byte_signs()

    def __missing__(self, chunk: str) -> bytes:
        if chunk.isascii() and chunk.isalpha():
            ids = array("I", [t.id for t in self.merged(chunk.lower())]).tobytes()
        elif _LETTERS.fullmatch(chunk):
            signs = chunk.lower().encode().decode("latin-1").translate(self.signs)
            ids = array("I", [t.id for t in self.merged(signs)]).tobytes()
        elif (parts := _CLOSED.fullmatch(chunk)) and "<|" not in chunk:
            ids = self[parts[1]] + self[parts[2]]
        else:
            ids = array("I", self.encode(chunk, add_special_tokens=False).ids).tobytes()
        if len(chunk) <= 40:
            if len(self) >= REMEMBERED:
                self.clear()
            self[chunk] = ids
        return ids

    def of(self, text: str | None) -> bytes:
        if not text:
            return b""
        for blank in "\n\t\r":
            text = text.replace(blank, " ")
        return b"".join(map(self.__getitem__, text.split(" ")))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def ids_of(path: str | None = None) -> Ids:
    """The worker's own table for the tokenizer at ``path``; a task empties it when it is done with it."""
    path = path or tokenizer_path()
    if path not in _loaded:
        _loaded[path] = Ids(path)
    return _loaded[path]

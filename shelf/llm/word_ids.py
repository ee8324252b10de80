"""Ids and counts of a tokenizers file, word by word with a bounded cache in every Python worker."""

from __future__ import annotations

import os
import re
import sys
from array import array
from functools import lru_cache

import numpy as np
from tokenizers import Tokenizer

from shelf.llm.recent import Recent

CACHED, CACHED_LENGTH = 250_000, 64
#: Characters of the words and stems that ``WordIds`` keeps.
CACHED_CHARACTERS = 5_000_000
#: A word of Latin letters that the tokenizers' patterns take as one piece, and one stop after it that they take as another.
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,]?)")
#: What ``WordIds`` takes as one piece behind such a word: a run of ASCII symbols, however long.
SYMBOLS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def _byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies write for each byte (fixed values of that public format)."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + n) for n, b in enumerate(hidden)}


BYTE_LETTERS = _byte_letters()


@lru_cache(maxsize=2)
def load(path: str) -> Tokenizer:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    return Tokenizer.from_file(path)


def byte_level(piece: str) -> str:
    return piece.encode().decode("latin-1").translate(BYTE_LETTERS)


class WordIds:
    """Ids of texts as little-endian integers, for tokenizers that drop white space and lower-case the rest.

    As no piece reaches over white space, the ids of a text are those of its words in turn. Plain
    words go straight to the tokenizer's model, once for all the cases and symbols behind them that they are written with; any other
    word goes through the whole tokenizer. Words are kept until they have ``CACHED_CHARACTERS``, then forgotten.
    """

    def __init__(self, path: str):
        self.tokenizer = load(path)
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = {2: "H", 4: "I"}[self.kind.itemsize]
        self.tokenize = self.tokenizer.model.tokenize
        self.words: dict[str, bytes] = {}
        self.stems: dict[str, bytes] = {}
        self.characters = 0

    def _bytes(self, ids: list[int]) -> bytes:
        found = array(self.code, ids)
        if sys.byteorder == "big":
            found.byteswap()
        return found.tobytes()

    def _stem(self, stem: str) -> bytes:
        ids = self.stems.get(stem)
        if ids is None:
            self.stems[stem] = ids = self._bytes([t.id for t in self.tokenize(stem if stem.isascii() else byte_level(stem))])
            self.characters += len(stem)
        return ids

    def _learn(self, word: str) -> bytes:
        stem = word.rstrip(SYMBOLS)
        if stem.isalpha() and (stem.isascii() or PLAIN.fullmatch(stem)):
            ids = self._stem(stem.lower())
            if len(stem) < len(word):
                ids += self._stem(word[len(stem):])
        else:
            ids = self._bytes(self.tokenizer.encode(word, add_special_tokens=False).ids)
        self.words[word] = ids
        self.characters += len(word)
        return ids

    def encode(self, text: str) -> bytes:
        words, held = text.replace("\n", " ").split(" "), self.words
        ids = list(map(held.get, words))
        for i in [i for i, found in enumerate(ids) if found is None]:
            found = held.get(words[i])
            ids[i] = self._learn(words[i]) if found is None else found
        if self.characters > CACHED_CHARACTERS:
            self.words, self.stems, self.characters = {}, {}, 0
        return b"".join(ids)


class WordCounts(Recent):
    """word -> number of ids of a space and the word, for byte-level tokenizers that leave texts as they are.

    A text can be cut before any space that a character other than white space follows: the
    pre-tokenizer starts a piece there whatever stands before. Special tokens are ordinary text.
    """

    def __init__(self, path: str):
        super().__init__(CACHED, CACHED_LENGTH)
        self.tokenizer = load(path)
        self.tokenizer.encode_special_tokens = True

    def whole(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def make(self, word: str) -> int:
        if match := PLAIN.fullmatch(word):
            model = self.tokenizer.model
            return len(model.tokenize(byte_level(" " + match[1]))) + (len(model.tokenize(match[2])) if match[2] else 0)
        return self.whole(" " + word)

"""Secrets in texts: a keyword automaton first, anchored patterns at its hits, checksums last."""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelf.llm.arrow import bounded_batches, row_udf
from shelf.llm.spans import LOWER, code_points

# The patterns and least lengths of the contract, and the public token formats with a checksum.
BASE_KINDS = ("assign", "access", "hex")
CHECKED_KINDS = ("github", "npm")
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]+")
GITHUB = re.compile(rb"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
NPM = re.compile(rb"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"),
    "access": ("akia",),
    "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    "npm": ("npm_",),
}
PATTERNS = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "github": GITHUB, "npm": NPM}
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

ORDER = {kind: n for n, kind in enumerate((*BASE_KINDS, *CHECKED_KINDS))}
#: Hexadecimal digits become one letter, so that a single keyword finds every long run of them.
RUNS = bytes(ord("h") if chr(b) in "0123456789abcdef" else ord(" ") for b in range(256))
SCHEMA = "spans array<struct<kind:string,start:bigint,end:bigint,checked:boolean>>"


def checksum62(value: bytes) -> bytes:
    """The CRC-32 of a value in six digits of base 62."""
    n, digits = zlib.crc32(value), []
    for _ in range(6):
        n, d = divmod(n, 62)
        digits.append(BASE62[d])
    return "".join(reversed(digits)).encode()


@lru_cache(maxsize=1)
def automata() -> tuple[ahocorasick.Automaton, ahocorasick.Automaton]:
    words, runs = ahocorasick.Automaton(), ahocorasick.Automaton()
    for kind, keywords in KEYWORDS.items():
        for word in keywords:
            words.add_word(word, (kind, len(word)))
    runs.add_word("h" * LEAST_HEX, ("hex", LEAST_HEX))
    words.make_automaton()
    runs.make_automaton()
    return words, runs


def _holds(kind: str, match: re.Match) -> bool:
    if kind == "assign":
        return len(match[2]) >= LEAST_VALUE
    if kind == "access":
        return len(match[0]) >= LEAST_ACCESS
    if kind == "hex":
        return len(match[0]) >= LEAST_HEX
    return checksum62(match[1]) == match[2]


def find_secrets(text: bytes | None) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, checked) in bytes, by start, then kind.

    Every match of a pattern begins at an occurrence of one of its keywords, so trying the pattern
    at the automaton's hits alone, and skipping hits inside the match before, gives the leftmost
    non-overlapping matches. A match that fails its test is dropped and still covers its text.
    """
    if not text:
        return []
    words, runs = automata()
    hits = [(end - n + 1, kind) for end, (kind, n) in words.iter(text.translate(LOWER).decode("latin-1"))]
    covered, found = dict.fromkeys(PATTERNS, 0), []

    def attempt(start: int, kind: str) -> None:
        if start >= covered[kind] and (match := PATTERNS[kind].match(text, start)):
            covered[kind] = match.end()
            if _holds(kind, match):
                found.append((kind, start, match.end(), kind in CHECKED_KINDS))

    for start, kind in sorted(hits):
        attempt(start, kind)
    # the first hit of a run ends LEAST_HEX digits after its start; later hits of the run are covered
    for end, (kind, n) in runs.iter(text.translate(RUNS).decode("latin-1")):
        attempt(end - n + 1, kind)
    return sorted(found, key=lambda s: (s[1], ORDER[s[0]]))


def _scan(text: bytes | None) -> tuple[list]:
    spans = find_secrets(text)
    if not spans:
        return ([],)
    at = code_points(text, [p for s in spans for p in s[1:3]])
    return ([(kind, at[start], at[end], checked) for kind, start, end, checked in spans],)


def _make():
    return _scan


def scan_secrets(docs: DataFrame, text: str = "text", out: str = "secrets") -> DataFrame:
    """``docs`` with a column ``out``: the secrets of every whole text, by start, then kind.

    Spans count code points, the end exclusive; ``checked`` marks formats whose embedded checksum
    was right (a wrong one is no secret). A null or empty text has none. A column named ``out`` is
    replaced; all rows, repeated ones too, and all other columns stay.
    """
    bounded_batches(docs.sparkSession)
    found = row_udf(_make, SCHEMA, binary=True)
    return docs.withColumn(out, found(F.col(text))["spans"])

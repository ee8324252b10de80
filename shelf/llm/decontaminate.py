"""Benchmark decontamination: one automaton over all benchmark windows, each text scanned once."""

from __future__ import annotations

import re
from bisect import bisect_right
from functools import partial

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelf.llm.arrow import bounded_batches, row_udf
from shelf.llm.spans import code_points
from shelf.session import materialize

WINDOW = 10
#: Bytes of windows that one automaton may hold; more goes to further automata, which read the texts one after the other.
AUTOMATON_BYTES = 8 * 1024 * 1024

WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
#: Lower-cases A-Z and turns every byte that is in no word into a space.
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
SCHEMA = "n_words:bigint,hits:array<struct<first:bigint,last:bigint>>,items:array<string>,spans:array<struct<start:bigint,end:bigint>>"


def normal_words(text: bytes) -> list[bytes]:
    return text.translate(NORMAL).split()


def windows_of(text: bytes | None) -> tuple[list[bytes]]:
    """The distinct windows of an item; one of fewer words is one window."""
    words = normal_words(text or b"")
    n = min(len(words), WINDOW)
    return (list(dict.fromkeys(b" ".join(words[i:i + n]) for i in range(len(words) - n + 1))) if n else [],)


def _make_windows():
    return windows_of


def automaton_of(windows: dict[bytes, list[str]]) -> ahocorasick.Automaton:
    built = ahocorasick.Automaton()
    for window, items in windows.items():
        built.add_word(f" {window.decode('latin-1')} ", (window.count(b" ") + 1, items))
    if windows:
        built.make_automaton()
    return built


def scan(text: bytes | None, automaton: ahocorasick.Automaton) -> tuple[int, list, list, list]:
    """(words, hit word ranges, items, hit spans in code points of the text as it was given)."""
    words = normal_words(text) if text else []
    if not words or not len(automaton):
        return len(words), [], [], []
    ranges, items, starts = [], set(), None
    for end, (n, held) in automaton.iter(f" {b' '.join(words).decode('latin-1')} "):
        if starts is None:
            starts = np.cumsum([1, *(len(w) + 1 for w in words[:-1])]).tolist()
        last = bisect_right(starts, end - 1) - 1
        ranges.append((last - n + 1, last))
        items.update(held)
    if not ranges:
        return len(words), [], [], []
    merged: list[list[int]] = []
    for first, last in sorted(ranges):
        if merged and first <= merged[-1][1] + 1:
            merged[-1][1] = max(merged[-1][1], last)
        else:
            merged.append([first, last])
    places = [m.span() for m in WORD.finditer(text)]
    at = code_points(text, [p for a, b in merged for p in (places[a][0], places[b][1])])
    return len(words), [tuple(m) for m in merged], sorted(items), [(at[places[a][0]], at[places[b][1]]) for a, b in merged]


def _make(shared):
    return partial(scan, automaton=automaton_of(shared.value))


def _windows(benchmark: DataFrame, item: str, text: str) -> DataFrame:
    """(window, item) of all items, each pair once."""
    items = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("null")).alias("item"), F.col(text).alias("t")).where("t IS NOT NULL")
    return items.select("item", F.explode(row_udf(_make_windows, "w array<binary>", binary=True)("t")["w"]).alias("window")).distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
                  out: str = "contamination", most: int = AUTOMATON_BYTES) -> DataFrame:
    """``docs`` with a struct ``out``: n_words, n_hit, items, spans.

    A word is hit where it lies in an occurrence of ten consecutive words of an item (or of all
    words of a shorter item). ``items`` are the ids of the items found, sorted as strings; ``spans``
    cover the hit words in code points of the original text. Null or empty texts have no words; an
    item without words is never found; items of a null id are named "null"; rows of one item_id
    count as one item. A column named ``out`` is replaced; all rows and other columns stay.

    The windows are made in Spark and their size is measured. Up to ``most`` bytes of them, with their
    items' names, make one automaton, which is broadcast. More are dealt by hash to several, one at a
    time in the driver and in a worker: each reads the texts in turn, and what it found is written before the next.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    windows = materialize(_windows(benchmark, item, item_text))
    size = windows.agg(F.sum(F.octet_length("window") + F.octet_length("item"))).first()[0] or 0
    parts = max(1, -(-size // most))
    part = F.pmod(F.xxhash64("window", "item"), F.lit(parts))
    found = docs.withColumn(out, F.array().cast(f"array<struct<{SCHEMA}>>"))
    for k in range(parts):
        held: dict[bytes, list[str]] = {}
        for window, name in windows.where(part == k).select("window", "item").collect():  # ``most`` bytes, more or less
            held.setdefault(bytes(window), []).append(name)
        hit = row_udf(partial(_make, spark.sparkContext.broadcast(held)), SCHEMA, binary=True)(F.col(text))
        found = found.withColumn(out, F.concat(out, F.array(hit)))
        if k + 1 < parts:
            found = materialize(found)
    ranges = F.array_sort(F.flatten(F.transform(out, lambda p: p["hits"])))
    # ranges of several automata may overlap: each word counts once
    covered = F.aggregate(ranges, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("to")), lambda s, r: F.struct(
        (s["n"] + F.greatest(r["last"] - F.greatest(r["first"] - 1, s["to"]), F.lit(0))).alias("n"), F.greatest(s["to"], r["last"]).alias("to")))["n"]
    return found.withColumn(out, F.struct(
        F.col(out)[0]["n_words"].alias("n_words"), covered.alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten(F.transform(out, lambda p: p["items"])))).alias("items"),
        F.array_sort(F.flatten(F.transform(out, lambda p: p["spans"]))).alias("spans")))

"""Periodic runs of words, from a dictionary of basic factors.

The dictionary names every stretch of 2^k words that occurs twice in a text. Where a stretch of L = 2^k words
starts again between L and 2L words later, that distance proposes a period. Each proposal is extended as far
as it holds, by comparing names from the longest stretches down, and what was found several times becomes one run.
"""

from __future__ import annotations

from collections import defaultdict
from functools import partial
from itertools import count

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelf.llm.arrow import batch_udf, bounded_batches

#: Words of a run, at the least; it must hold its period twice as well.
LEAST_LENGTH = 12
SCHEMA = "n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"


def _numbers(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """All words of all texts as numbers that only words of one text share, and where each text starts.

    One number of its own stands before each text and after the last, so no repetition reaches over it.
    """
    counter = count()
    parts: list[int] = [next(counter)]
    starts = []
    for words in texts:
        own: defaultdict[bytes, int] = defaultdict(counter.__next__)
        starts.append(len(parts))
        parts += map(own.__getitem__, words)
        parts.append(next(counter))
    return np.array(parts, np.int64), np.array(starts, np.int64)


def _names(at: np.ndarray, keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(names, places, groups): equal keys get one name, a key that occurs once gets one that nothing equals.

    ``places`` are those of keys that occur again, by name, then place; ``groups`` are their names.
    """
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    group = np.cumsum(new) - 1
    again = np.bincount(group)[group] > 1 if len(group) else np.zeros(0, bool)
    places, groups = at[order][again], group[again]
    names = -1 - np.arange(n)
    names[places] = groups
    return names, places, groups


def _spread(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) of every value of the ranges [low, high)."""
    sizes = np.maximum(high - low, 0)
    rows = np.repeat(np.arange(len(low)), sizes)
    first = np.repeat(np.cumsum(sizes) - sizes, sizes)
    return rows, np.arange(len(rows)) - first + low[rows]


def _proposals(places: np.ndarray, groups: np.ndarray, length: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, distance) for stretches of one name that start at least ``length`` and less than twice that apart.

    Successors at most half a stretch apart are steps of an arithmetic progression: the words between
    repeat by that step, so the proposals of two progressions are equal along their steps, and those
    with the last place of either stand for them all. Pairs within one progression are multiples of its
    step, which a shorter stretch proposes. So there are a few proposals a place, however often a stretch occurs.
    """
    key = groups * (4 * n) + places
    step = np.full(len(key), 2 * n)
    step[:-1] = key[1:] - key[:-1]  # beyond 2n where the name changes
    last = 2 * step > length
    progression = np.cumsum(last) - last
    ends = np.flatnonzero(last)
    from_last, to_any = _spread(np.searchsorted(key, key[ends] + length), np.searchsorted(key, key[ends] + 2 * length))
    inner = np.flatnonzero(~last)
    from_inner, to_last = _spread(np.searchsorted(key[ends], key[inner] + length), np.searchsorted(key[ends], key[inner] + 2 * length))
    first = np.concatenate([ends[from_last], inner[from_inner]])
    second = np.concatenate([to_any, ends[to_last]])
    apart = progression[first] != progression[second]
    first, second = first[apart], second[apart]
    place, distance = places[first], places[second] - places[first]
    if not len(place):
        return place, distance
    # neighbouring places with one distance extend to the same run
    line = np.unique(distance * (2 * n) + place)
    line = line[np.concatenate([[True], np.diff(line) > 1])]
    return line % (2 * n), line // (2 * n)


def _extended(place: np.ndarray, period: np.ndarray, levels: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """[start, end) of the longest stretch around each place whose words equal those a period later, and its end that much later."""
    right, left = place.copy(), place.copy()
    for k in range(len(levels) - 1, -1, -1):
        names, width = levels[k], 1 << k
        same = names[right] == names[right + period]
        right[same] += width
        back = np.maximum(left - width, 0)
        same = (left >= width) & (names[back] == names[back + period])
        left[same] -= width
    return left, right + period


def find_runs(texts: list[list[bytes]], least: int = LEAST_LENGTH) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of every run of every text's words, by start, then period.

    A run is a stretch of at least ``least`` words and twice its smallest period that no neighbouring
    word extends with that period. Time and space are n log n at most; stretches that occur once are
    left out from one length to the next, so texts that hardly repeat cost little more than one sort.
    """
    words, starts = _numbers(texts)
    n = len(words)
    names, places, groups = _names(np.arange(n), words, n)
    levels, proposed, found = [names], [], []
    while len(places):
        length = 1 << (len(levels) - 1)
        proposed.append(_proposals(places, groups, length, n))
        at = np.sort(places)
        at = at[at + length < n]
        at = at[levels[-1][at + length] >= 0]
        names, places, groups = _names(at, levels[-1][at] * n + levels[-1][at + length], n)
        levels.append(names)
    for place, period in proposed:
        if len(place):
            start, end = _extended(place, period, levels)
            held = end - start >= np.maximum(least, 2 * period)
            if held.any():
                found.append(np.stack([start[held], end[held], period[held]], axis=1))
    runs: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if found:
        rows = np.unique(np.concatenate(found), axis=0)
        # the multiples of a period hold over the same stretch
        rows = rows[np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1)])]
        rows = rows[np.lexsort((rows[:, 2], rows[:, 0]))]
        owner = np.searchsorted(starts, rows[:, 0], side="right") - 1
        for text, (start, end, period) in zip(owner.tolist(), rows.tolist()):
            runs[text].append((start - int(starts[text]), end - start, period))
    return runs


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by one space, without those that a run contains after its first period."""
    if not runs:
        return b" ".join(words)
    edges = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    dropped = np.cumsum(edges)[:-1] > 0
    return b" ".join([w for w, d in zip(words, dropped.tolist()) if not d])


def _rows(texts: list[bytes | None], least: int) -> list[tuple]:
    words = [t.split() if t else [] for t in texts]
    return [(len(w), r, collapsed(w, r).decode("utf-8", "replace")) for w, r in zip(words, find_runs(words, least))]


def _make(least: int):
    return partial(_rows, least=least)


def periodic_runs(docs: DataFrame, text: str = "text", out: str = "repeats", least: int = LEAST_LENGTH) -> DataFrame:
    """``docs`` with a struct ``out``: n_words, runs and collapsed, of every whole text.

    Words are what ASCII white space parts. ``runs`` has (start, length, period) of each run in words
    from 0, by start, then period; ``collapsed`` are the words that no run contains after its first
    period, joined by one space. A null or empty text, or one of white space, has no words, no runs and an empty
    ``collapsed``. A column named ``out`` is replaced; all rows, repeated ones too, and all other
    columns stay. Texts are handled in Arrow batches of bounded size; a longer text makes a batch of
    its own, which takes some 8 bytes a word for each power of two that a stretch occurring twice is long.
    """
    bounded_batches(docs.sparkSession)
    return docs.withColumn(out, batch_udf(partial(_make, least), SCHEMA)(F.col(text)))

"""Token counts that follow edits: a segment tree of piece counts per document, re-encoded only where edits touch."""

from __future__ import annotations

import re
from bisect import bisect_left
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelf.llm.arrow import bounded_batches, row_udf
from shelf.llm.word_ids import WordCounts

#: Words of a leaf. A leaf is re-encoded whole, and each takes two numbers twice over in the tree.
LEAF_WORDS = 32
TREE = "struct<chars:array<int>,tokens:array<int>>"
COUNTED = "n_chars bigint, n_tokens bigint, n_reencoded bigint"
#: A space before which a text cannot be cut: white space or nothing follows.
UNSAFE = re.compile(r" (?=\s|\Z)")


def _leaves(text: str, counts: WordCounts, inner: bool = False) -> list[tuple[int, int]]:
    """(characters, tokens) of runs of words, cut only before a space that a visible character follows.

    An ``inner`` text begins at such a cut, with its space; else no space stands before the first word.
    """
    words = (text[1:] if inner else text).split(" ")
    if UNSAFE.search(text):
        joined = [words[0]]
        for word in words[1:]:
            if word and not word[0].isspace():
                joined.append(word)
            else:
                joined[-1] += " " + word
        words = joined
    found = []
    for i in range(0, len(words), LEAF_WORDS):
        part = words[i:i + LEAF_WORDS]
        chars, tokens = sum(map(len, part)) + len(part), sum([counts[w] for w in part])
        if i == 0 and not inner:
            chars, tokens = chars - 1, tokens - counts[part[0]] + counts.whole(part[0])
        found.append((chars, tokens))
    return found


class CountTree:
    """Sums over leaves in heap order: node 1 is the document, 2i and 2i + 1 the halves of node i."""

    def __init__(self, chars: list[int], tokens: list[int]):
        self.chars, self.tokens, self.size = chars, tokens, len(chars) // 2

    @staticmethod
    def of(leaves: list[tuple[int, int]]) -> CountTree:
        size = 1 << max(0, len(leaves) - 1).bit_length()
        sums = []
        for k in range(2):
            heap = [0] * size + [leaf[k] for leaf in leaves] + [0] * (size - len(leaves))
            for i in range(size - 1, 0, -1):
                heap[i] = heap[2 * i] + heap[2 * i + 1]
            sums.append(heap)
        return CountTree(*sums)

    @staticmethod
    def build(text: str, counts: WordCounts) -> CountTree:
        return CountTree.of(_leaves(text, counts))

    def put(self, first: int, last: int, leaves: list[tuple[int, int]]) -> None:
        """Leaves in the place of those from ``first`` to ``last``; where they are more, the heap is made anew from all that are not empty."""
        if len(leaves) <= last - first + 1:
            for k, leaf in enumerate([*leaves, *[(0, 0)] * (last - first + 1 - len(leaves))], first):
                self.set(k, *leaf)
            return
        all_leaves = list(zip(self.chars[self.size:], self.tokens[self.size:]))
        made = CountTree.of([leaf for leaf in [*all_leaves[:first], *leaves, *all_leaves[last + 1:]] if leaf[0]])
        self.chars, self.tokens, self.size = made.chars, made.tokens, made.size

    def leaf_at(self, position: int) -> tuple[int, int]:
        """The leaf that holds a character, and where it starts; the last leaf with characters if none does."""
        if position >= self.chars[1]:
            position = self.chars[1] - 1
        node, start = 1, 0
        while node < self.size:
            node *= 2
            if position >= start + self.chars[node]:
                start += self.chars[node]
                node += 1
        return node - self.size, start

    def set(self, leaf: int, chars: int, tokens: int) -> None:
        node = leaf + self.size
        chars, tokens = chars - self.chars[node], tokens - self.tokens[node]
        while node:
            self.chars[node] += chars
            self.tokens[node] += tokens
            node //= 2

    def replace(self, text: str, start: int, end: int, put: str, counts: WordCounts) -> tuple[str, int]:
        """The edited text and how many characters were encoded again; the sums are brought up to date.

        A cut stays valid while the space it lies before and the character after that stay, so the
        region starts at the last leaf that begins two characters before the edit and ends at the
        first leaf that begins at or after the edit's end. It is cut into leaves of ``LEAF_WORDS`` words
        again, so leaves stay small however often one place is edited.
        """
        edited = text[:start] + put + text[end:]
        if not self.chars[1]:
            self.put(0, self.size - 1, _leaves(edited, counts))
            return edited, len(edited)
        first, at = self.leaf_at(start)
        if at + 2 > start and at > 0:
            first, at = self.leaf_at(at - 1)
            if at + 2 > start:  # a leaf that edits left shorter than its cut needs
                first, at = 0, 0
        last, begin = self.leaf_at(max(end - 1, start))
        stop = begin + self.chars[last + self.size]
        if stop < end:
            stop = self.chars[1]
        region = edited[at:stop + len(put) - (end - start)]
        self.put(first, last, _leaves(region, counts, inner=at > 0))
        return edited, len(region)


def _build(row: dict, counts: WordCounts) -> tuple:
    if row["text"] is None:
        return (None, 0)
    tree = CountTree.build(row["text"], counts)
    return ((tree.chars, tree.tokens), tree.tokens[1])


def clean_edits(edits: list[dict] | None, length: int) -> list[tuple[int, int, str]]:
    """(start, end, put) from the last to the first. Bounds are cut to the text; null parts and overlaps with an earlier edit drop out."""
    rows = sorted((max(0, min(e["start"], length)), max(0, min(e["end"], length)), e["put"] or "") for e in edits or []
                  if e and e["start"] is not None and e["end"] is not None)
    kept: list[tuple[int, int, str]] = []
    for start, end, put in rows:
        if end >= start and (not kept or start >= kept[-1][1]):
            kept.append((start, end, put))
    return kept[::-1]


def _apply(row: dict, counts: WordCounts) -> tuple:
    if row["text"] is None or row["tree"] is None:
        return (None, (0, 0, 0), None)
    text, tree, again = row["text"], CountTree(row["tree"]["chars"], row["tree"]["tokens"]), 0
    for start, end, put in clean_edits(row["edits"], len(text)):
        text, n = tree.replace(text, start, end, put, counts)
        again += n
    return ((tree.chars, tree.tokens), (tree.chars[1], tree.tokens[1], again), text)


def _make(path: str, function):
    return partial(function, counts=WordCounts(path))


def build_trees(docs: DataFrame, tokenizer: str, text: str = "text", tree: str = "tree", count: str = "n_tokens") -> DataFrame:
    """``docs`` with the segment tree of every whole text and its count of tokens.

    ``tokenizer`` is a byte-level file of the tokenizers library that leaves texts as they are.
    Empty texts have a tree of no tokens, null texts none and a count of 0. Columns of these names
    are replaced.
    """
    bounded_batches(docs.sparkSession)
    built = row_udf(partial(_make, tokenizer, _build), f"tree {TREE}, n bigint")(F.struct(F.col(text).alias("text")))
    return docs.withColumn(tree, built).withColumn(count, F.col(tree)["n"]).withColumn(tree, F.col(tree)["tree"])


def apply_edits(docs: DataFrame, tokenizer: str, edits: str = "edits", text: str = "text", tree: str = "tree", out: str = "edited") -> DataFrame:
    """``docs`` with a struct ``out``: the edited text, its tree, and n_chars, n_tokens, n_reencoded.

    ``edits`` is an array of (start, end, put) in code points of the text as it is: put replaces
    [start, end). Bounds beyond the text are cut to it; of overlapping edits the first by start,
    then end, holds; null edits do nothing. A null text stays null with counts of 0.
    """
    bounded_batches(docs.sparkSession)
    row = F.struct(F.col(text).alias("text"), F.col(tree).alias("tree"), F.col(edits).alias("edits"))
    done = row_udf(partial(_make, tokenizer, _apply), f"tree {TREE}, counted struct<n_chars:bigint,n_tokens:bigint,n_reencoded:bigint>, text string")(row)
    return docs.withColumn(out, done).withColumn(out, F.struct(
        F.col(out)["text"].alias("text"), F.col(out)["tree"].alias("tree"), F.col(out)["counted"]["n_chars"].alias("n_chars"),
        F.col(out)["counted"]["n_tokens"].alias("n_tokens"), F.col(out)["counted"]["n_reencoded"].alias("n_reencoded")))

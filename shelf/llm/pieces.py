"""SentencePiece encoding by a streaming Viterbi search, and decoding."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import partial

import ahocorasick
import numpy as np
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelf.llm.arrow import bounded_batches, row_udf
from shelf.llm.recent import Recent

SPACE = "▁"
CACHED, CACHED_LENGTH, CACHED_PAIRS = 250_000, 64, 300_000


class Vocabulary:
    """Pieces of a BPE model with byte fallback, and which two of them may stand side by side."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids: dict[str, int] = {}
        self.score: list[float] = []
        self.raw = raw_pieces(model)
        self.bytes: dict[int, int] = {}
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            self.score.append(model.get_score(i))
            if model.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i)):
                self.ids[piece] = i
        self.longest = max(map(len, self.ids))
        #: Neighbouring characters that some piece holds; between any other two every path has a boundary.
        self.inner = {piece[i:i + 2] for piece in self.ids for i in range(len(piece) - 1)}
        self._halves: dict[str, tuple[str, str] | None] = {}
        self.automaton = ahocorasick.Automaton()
        for piece in self.ids:
            self.automaton.add_word(piece, (len(piece), piece))
        self.automaton.make_automaton()
        #: What ``stable`` has said, by left and right piece.
        self.pairs: defaultdict[str, dict[str, bool]] = defaultdict(dict)
        self.n_pairs = 0

    def numbers(self, piece: str) -> list[int]:
        """The id of a piece, or those of a character's bytes."""
        found = self.ids.get(piece)
        return [found] if found is not None else [self.bytes[b] for b in piece.encode()]

    def merged(self, text: str, least: int = 1) -> list[str]:
        """Pieces of a short text by merging down to ``least``: always the best-scored pair, the leftmost of equals."""
        parts = list(text)
        while len(parts) > least:
            best, at = None, -1
            for i in range(len(parts) - 1):
                if (found := self.ids.get(parts[i] + parts[i + 1])) is not None and (best is None or self.score[found] > best):
                    best, at = self.score[found], i
            if best is None:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def halves(self, piece: str) -> tuple[str, str] | None:
        """The two pieces of a piece's last merge; None for a single character or one that merging does not form."""
        if piece not in self._halves:
            parts = self.merged(piece, 2) if len(piece) > 1 else []
            self._halves[piece] = tuple(parts) if len(parts) == 2 and self.merged(piece) == [piece] else None
        return self._halves[piece]

    def stable(self, left: str, right: str) -> bool:
        """Whether merging the two pieces' characters gives these two pieces again.

        Both pieces are taken apart in the reverse order of their merges; if at some moment the
        parts at the seam would have merged before the merges undone so far, they are not stable.
        """
        if SPACE + SPACE in left + right:  # runs of spaces have equal scores, so order decides
            return self.merged(left + right) == [left, right]
        ids, score, lowest = self.ids, self.score, -float("inf")
        while True:
            joint = ids.get(left + right)
            if joint is not None and score[joint] > lowest:
                return False
            halves_left = self.halves(left) if len(left) > 1 else None
            halves_right = self.halves(right) if len(right) > 1 else None
            if halves_left is None and halves_right is None:
                return True
            if halves_right is None or halves_left is not None and score[ids[left]] < score[ids[right]]:
                lowest, left = score[ids[left]], halves_left[1]
            else:  # an equal score to the left of it comes first
                lowest, right = score[ids[right]] - 0.5, halves_right[0]


def _extend(text: str, end: int, starts: list[int], base: int, tail: str, vocabulary: Vocabulary) -> None:
    """Continue ``starts`` up to boundary ``end``: where the last piece of the best path to each boundary starts, -1 if none reaches it.

    ``starts`` begins with boundary ``base``, which is its own start; ``tail`` is the piece before it.
    """
    ids, pairs, longest = vocabulary.ids, vocabulary.pairs, vocabulary.longest
    for i in range(base + len(starts), end + 1):
        found = -1
        for start in range(base if i - longest < base else i - longest, i):
            before = starts[start - base]
            if before < 0:
                continue
            piece = text[start:i]
            if piece not in ids and i - start > 1:
                continue
            left = text[before:start] if before < start else tail
            if not left:
                found = start
                break
            known = pairs[left]
            if (stable := known.get(piece)) is None:
                known[piece] = stable = vocabulary.stable(left, piece)
                vocabulary.n_pairs += 1
            if stable:
                found = start
                break
        starts.append(found)


def _pieces(text: str, starts: list[int], base: int, end: int) -> list[str]:
    found = []
    while (start := starts[end - base]) != end:
        found.append(text[start:end])
        end = start
    return found[::-1]


def in_one_window(text: str, vocabulary: Vocabulary) -> list[str] | None:
    """Pieces of a text so short that all of it is kept: the same search, each boundary's pieces named by an automaton.

    None if a character is no piece of its own.
    """
    pairs, starts = vocabulary.pairs, [0] + [-1] * len(text)
    follow: list[dict[str, bool] | None] = [None] * (len(text) + 1)  # what may follow the last piece of a boundary
    for end, (size, piece) in vocabulary.automaton.iter(text):
        end += 1
        start = end - size
        if starts[end] >= 0 or starts[start] < 0:
            continue
        if start:
            known = follow[start]
            if (stable := known.get(piece)) is None:
                known[piece] = stable = vocabulary.stable(text[starts[start]:start], piece)
                vocabulary.n_pairs += 1
            if not stable:
                continue
        starts[end] = start
        follow[end] = pairs[piece]
    return _pieces(text, starts, 0, len(text)) if starts[-1] >= 0 else None


def viterbi(text: str, vocabulary: Vocabulary) -> Iterator[str]:
    """Pieces of a text in order, each as soon as it is certain.

    A segmentation is the merge order's own exactly if each two neighbours are stable, so a
    boundary is reached by a piece from an earlier boundary whose last piece it may follow, and
    every reachable boundary has one best path. Only boundaries within the longest piece of the
    end can be extended. When all their paths run through one boundary, the pieces up to it are
    given out, and of what lies before only the last piece is remembered.
    """
    longest, starts, base, tail = vocabulary.longest, [0], 0, ""
    for end in range(longest, len(text), longest):
        _extend(text, end, starts, base, tail, vocabulary)
        alive = {k for k in range(max(base, end - longest + 1), end + 1) if starts[k - base] >= 0}
        while len(alive) > 1:
            last = max(alive)
            alive.discard(last)
            alive.add(starts[last - base])
        meet = alive.pop()
        if starts[meet - base] != meet:
            yield from _pieces(text, starts, base, meet)
            tail = text[starts[meet - base]:meet]
            starts, base = [meet, *starts[meet - base + 1:]], meet
    _extend(text, len(text), starts, base, tail, vocabulary)
    yield from _pieces(text, starts, base, len(text))


class Coded(Recent):
    """piece -> its ids as integers of the encoder's kind."""

    def __init__(self, vocabulary: Vocabulary, kind: np.dtype):
        super().__init__(CACHED, CACHED_LENGTH)
        self.vocabulary, self.kind = vocabulary, kind

    def make(self, piece: str) -> bytes:
        return np.array(self.vocabulary.numbers(piece), self.kind).tobytes()


class Encoder(Recent):
    """Words, with the space before them, to ids as little-endian integers.

    Where no piece holds two neighbouring characters all paths meet between them, so the parts on
    either side can be searched on their own, and once for all their occurrences. Such a place
    lies before each run of spaces, as no piece has a space after another character. At most
    twice ``cached`` words and parts are remembered: 250,000 take some 80 MB, 40,000 some 20 MB and half as much time again.
    """

    def __init__(self, path: str, cached: int = CACHED):
        super().__init__(cached, CACHED_LENGTH)
        self.vocabulary = Vocabulary(path)
        self.kind = np.dtype("<u2" if len(self.vocabulary.raw) <= 1 << 16 else "<u4")
        self.coded = Coded(self.vocabulary, self.kind)

    def make(self, word: str) -> bytes:
        inner = self.vocabulary.inner
        cuts = [i for i in range(1, len(word)) if word[i - 1:i + 1] not in inner]
        if cuts:
            return b"".join([self[word[a:b]] for a, b in zip([0, *cuts], [*cuts, len(word)])])
        if self.vocabulary.n_pairs > CACHED_PAIRS:
            self.vocabulary.pairs.clear()
            self.vocabulary.n_pairs = 0
        found = in_one_window(word, self.vocabulary) if len(word) <= self.longest else None
        if found is None:
            found = viterbi(word, self.vocabulary)
        return b"".join([self.coded[piece] for piece in found])

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        words = text.replace(SPACE, " ").split(" ")
        if "" in words:
            joined, spaces = [], SPACE
            for word in words[:-1]:
                if word:
                    joined.append(spaces + word)
                    spaces = SPACE
                else:
                    spaces += SPACE
            return b"".join([self[w] for w in [*joined, spaces + words[-1]]])
        return b"".join([self[SPACE + w] for w in words])


def raw_pieces(model: sentencepiece.SentencePieceProcessor) -> list[bytes]:
    """The bytes that each id stands for; control ids stand for none."""
    found = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            found.append(bytes([int(piece[3:5], 16)]))
        else:
            found.append(b"" if model.is_control(i) or model.is_unknown(i) else piece.replace(SPACE, " ").encode())
    return found


def _make_encode(path: str, cached: int):
    held = Encoder(path, cached)

    def apply(text: str | None) -> tuple:
        ids = held.encode(text or "")
        return (np.frombuffer(ids, held.kind).astype(np.int32), len(ids) // held.kind.itemsize)

    return apply


def _make_decode(path: str):
    raw = raw_pieces(sentencepiece.SentencePieceProcessor(model_file=path))

    def apply(ids: np.ndarray | None) -> tuple:
        """The text of ids: the space before the first word goes, bytes that are no UTF-8 become U+FFFD."""
        return (None if ids is None else b"".join([raw[i] for i in ids.tolist()]).decode("utf-8", "replace").removeprefix(" "),)

    return apply


def encode(docs: DataFrame, model: str, text: str = "text", ids: str = "piece_ids", count: str = "n_pieces", cached: int = CACHED) -> DataFrame:
    """``docs`` with the piece ids of every whole text and their number.

    The ids are those of the model's own encoder: the space before the text is added, characters
    without a piece become their bytes. Null and empty texts have no ids. Columns of these names
    are replaced; all rows and other columns stay. ``cached`` trades a task's memory for time, see ``Encoder``.
    """
    bounded_batches(docs.sparkSession)
    done = row_udf(partial(_make_encode, model, cached), "ids array<int>, n bigint")(F.col(text))
    return docs.withColumn(ids, done).withColumn(count, F.col(ids)["n"]).withColumn(ids, F.col(ids)["ids"])


def decode(docs: DataFrame, model: str, ids: str = "piece_ids", out: str = "decoded") -> DataFrame:
    """``docs`` with the text of the ids: the text that was encoded, a "▁" in it read as a space. Null ids give null."""
    bounded_batches(docs.sparkSession)
    return docs.withColumn(out, row_udf(partial(_make_decode, model), "text string", numbers=True)(F.col(ids))["text"])

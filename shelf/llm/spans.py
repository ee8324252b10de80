"""Spans found in UTF-8 bytes, counted in code points, and their digests."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

CONTINUATION = bytes(range(0x80, 0xC0))
#: Maps A-Z to a-z and leaves every other byte.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def code_points(text: bytes, positions: Iterable[int]) -> dict[int, int]:
    """The code point offset of every byte offset, in one pass over the text."""
    found, before, count = {}, 0, 0
    for at in sorted(set(positions)):
        count += len(text[before:at].translate(None, CONTINUATION))
        found[at] = count
        before = at
    return found


def joined(spans: Column) -> Column:
    """kind:start:end of an array of spans, comma-joined in their order."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def of_kinds(spans: Column, kinds: Iterable[str]) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(of_kinds(spans, [kind])).cast("long")

"""A bitmap of hashed keys: tells rows that cannot meet a table, so that only the others are shuffled to it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a map; its 64-bit words are at most this many / 64 rows, whatever the table's size.
BITS = 1 << 24


def _bit(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BITS))


def bitmap(df: DataFrame, key: str) -> DataFrame:
    """(word, mask): the bits that the keys of ``df`` set."""
    bit = _bit(F.col(key))
    one = F.expr(f"shiftleft(1L, cast(pmod(xxhash64(`{key}`), {BITS}) % 64 as int))")
    return df.select(F.floor(bit / 64).alias("_word"), one.alias("_one")).groupBy("_word").agg(F.bit_or("_one").alias("_mask"))


def maybe_in(df: DataFrame, key: str, words: DataFrame) -> DataFrame:
    """The rows of ``df`` whose key may be in the table that ``words`` was made of: all that are, and a few others.

    The broadcast has at most BITS / 64 rows. A full map lets every row through, which costs time only.
    """
    bit = _bit(F.col(key))
    met = df.withColumn("_at", bit).withColumn("_word", F.floor(F.col("_at") / 64)).join(F.broadcast(words), "_word")
    return met.where(F.expr("shiftright(_mask, cast(_at % 64 as int)) & 1L = 1L")).drop("_at", "_word", "_mask")


def surely_not_in(df: DataFrame, key: str, words: DataFrame) -> DataFrame:
    """The rows that ``maybe_in`` leaves out."""
    bit = _bit(F.col(key))
    met = df.withColumn("_at", bit).withColumn("_word", F.floor(F.col("_at") / 64)).join(F.broadcast(words), "_word", "left")
    return met.where(F.expr("_mask IS NULL OR shiftright(_mask, cast(_at % 64 as int)) & 1L = 0L")).drop("_at", "_word", "_mask")

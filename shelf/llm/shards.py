"""Rendezvous hashing of stable record keys over weighted shards, in column expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parts that the rows of a shard are counted and numbered in.
PARTS = 1024


def shard_of(key: Column, weights: list[float]) -> Column:
    """The shard of highest score, -weight / ln(u) with u a hash of key and shard in (0, 1).

    A shard's scores do not depend on the others, so a new shard takes rows only into itself and
    each shard gets rows by its share of the weights. A null key counts as the word "null".
    """
    name = F.coalesce(key.cast("string"), F.lit("null"))
    scored = []
    for shard, weight in enumerate(weights):
        # 52 bits of the hash, moved by a half so that neither 0 nor 1 occurs
        u = (F.shiftrightunsigned(F.xxhash64(name, F.lit(shard)), 12).cast("double") + 0.5) / F.lit(float(1 << 52))
        scored.append(F.struct((F.lit(-float(weight)) / F.log(u)).alias("score"), F.lit(shard).alias("shard")))
    return F.array_max(F.array(*scored))["shard"]


def assign(docs: DataFrame, weights: list[float], key: str = "doc_id", text: str = "text", parts: int = PARTS) -> DataFrame:
    """key, size, text_crc32, shard, slot and grown_shard of every row.

    ``size`` is the text's UTF-8 bytes plus 1 (null: 1); ``grown_shard`` is the shard with one more of
    weight 1. ``slot`` numbers a shard's rows from 0 without gaps, by hash part, key, checksum and
    size; repeated rows get a slot each. No window holds a shard: rows are numbered within
    ``parts`` hash parts of it, and the parts' counts, a few numbers a shard, are summed up.
    """
    sized = docs.select(
        F.col(key).alias(key), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(F.encode(F.col(text), "UTF-8")), F.lit(0)).cast("long").alias("text_crc32"))
    placed = sized.select(
        "*", shard_of(F.col(key), weights).alias("shard"), shard_of(F.col(key), [*weights, 1.0]).alias("grown_shard"),
        F.pmod(F.xxhash64(key, "text_crc32"), F.lit(parts)).cast("int").alias("_part"))
    counts = placed.groupBy("shard", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("shard", "_part", (F.sum("_n").over(Window.partitionBy("shard").orderBy("_part")) - F.col("_n")).alias("_before"))
    within = Window.partitionBy("shard", "_part").orderBy(key, "text_crc32", "size")
    numbered = placed.withColumn("_at", F.row_number().over(within) - 1)
    return numbered.join(before, ["shard", "_part"]).select(
        key, "size", "text_crc32", "shard", (F.col("_before") + F.col("_at")).cast("long").alias("slot"), "grown_shard")

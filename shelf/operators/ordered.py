"""Looking back along a key without one task that sees the whole key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelf.session import materialize


def previous_value(df: DataFrame, keys: list[str], order: list[str], value: Column, out: str) -> DataFrame:
    """Adds the last non-null ``value`` of the earlier rows of the same key; keys are not null.

    Rows are range-partitioned by key and order, so a key with very many rows spreads over several
    partitions. A window looks back within a partition; what the earlier partitions of the key ended
    with comes from one row per (key, partition).
    """
    placed = materialize(df.withColumn("_value", value).repartitionByRange(*keys, *order)
                         .withColumn("_part", F.spark_partition_id()))
    inside = Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ends = placed.groupBy(*keys, "_part").agg(
        F.max_by("_value", F.when(F.col("_value").isNotNull(), F.struct(*order))).alias("_end"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*keys, "_part", F.last("_end", ignorenulls=True).over(earlier).alias("_carried"))
    return (placed.withColumn("_near", F.last("_value", ignorenulls=True).over(inside)).join(carried, [*keys, "_part"])
            .withColumn(out, F.coalesce("_near", "_carried")).drop("_value", "_part", "_near", "_carried"))

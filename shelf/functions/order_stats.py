"""Exact order statistics without bringing a group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Buckets for each doubling of a value, and parts that the bucket of a wanted position is cut into.
PER_OCTAVE, PARTS = 256, 1 << 16


def _bucket(value: Column) -> Column:
    """A number that never falls where the value rises: buckets are as wide as 1/256 of an octave, whatever the values' size."""
    x = value.cast("double")
    size = F.floor(F.log2(F.abs(x)) * PER_OCTAVE) + 1100 * PER_OCTAVE  # above 0 for every double
    return F.when(x > 0, size).when(x < 0, -size).otherwise(0).cast("int")


def _part(value: Column, low: Column, high: Column) -> Column:
    x = value.cast("double")
    return F.when(high > low, F.floor((x - low) / (high - low) * PARTS)).otherwise(0).cast("int")


def _containing(hist: DataFrame, group: list[str], order: str, offset: Column) -> DataFrame:
    """Of a histogram's rows (…, n) those that hold the wanted position, with the position within them as ``_offset``."""
    upto = Window.partitionBy(*group).orderBy(order)
    before = hist.withColumn("_before", F.sum("_n").over(upto) - F.col("_n")).withColumn("_at", offset)
    return before.where((F.col("_at") >= F.col("_before")) & (F.col("_at") < F.col("_before") + F.col("_n"))).withColumn(
        "_offset", F.col("_at") - F.col("_before")).drop("_before", "_at", "_n")


def order_statistics(df: DataFrame, by: list[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """For each q the element at index floor(q·n) of the sorted values of its group.

    Equal values are counted first, so that a value held by most rows becomes one row. A histogram of
    logarithmic buckets tells in which bucket each wanted position lies, a second one in which of 65,536 parts of
    that bucket, and only that part is sorted. So no task sorts a group: windows go over histograms of bounded size.
    """
    counts = (df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
              .withColumn("_bucket", _bucket(F.col(value))))
    number = F.col(value).cast("double")
    buckets = counts.groupBy(*by, "_bucket").agg(F.sum("_n").alias("_n"), F.min(number).alias("_low"), F.max(number).alias("_high"))
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(q).alias("q")) for name, q in quantiles.items()])
    asked = (buckets.withColumn("_total", F.sum("_n").over(Window.partitionBy(*by))).withColumn("_w", F.explode(wanted))
             .select(*by, "_bucket", "_n", "_low", "_high", "_total", F.col("_w.name").alias("_name"), F.col("_w.q").alias("_q")))
    first = _containing(asked, [*by, "_name"], "_bucket", F.floor(F.col("_q") * F.col("_total"))).select(
        *by, "_bucket", "_name", "_low", "_high", "_offset")

    near = counts.join(first, [*by, "_bucket"]).withColumn("_part", _part(F.col(value), F.col("_low"), F.col("_high")))
    parts = near.groupBy(*by, "_name", "_part").agg(F.sum("_n").alias("_n"), F.first("_offset").alias("_whole"))
    second = _containing(parts, [*by, "_name"], "_part", F.col("_whole")).select(*by, "_name", "_part", F.col("_offset").alias("_rest"))

    inside = Window.partitionBy(*by, "_name").orderBy(value)
    found = (near.join(second, [*by, "_name", "_part"])
             .withColumn("_upto", F.sum("_n").over(inside))
             .where((F.col("_rest") < F.col("_upto")) & (F.col("_rest") >= F.col("_upto") - F.col("_n"))))

    def one(name: str) -> Column:
        return F.max(F.when(F.col("_name") == name, F.col(value))).alias(name)

    return found.groupBy(*by).agg(*[one(name) for name in quantiles])

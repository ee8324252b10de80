"""Looking back along a hot key that spans partitions."""

from pyspark.sql import functions as F

from shelf.operators.compare import changes
from shelf.operators.ordered import previous_value
from shelf.sources.feeds import number_rows


def test_previous_value_across_partitions(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(300).select(F.when(F.col("id") % 3 == 0, "rare").otherwise("hot").alias("k"), F.col("id").alias("o"),
                                     F.when(F.col("id") % 7 != 0, F.col("id")).alias("v"))
        rows = previous_value(df, ["k"], ["o"], F.col("v"), "last").orderBy("o").collect()
        last = {}
        for r in rows:
            assert r["last"] == last.get(r.k), r
            if r.v is not None:
                last[r.k] = r.v
        numbered = number_rows(df, ["k", "o"], "n").orderBy("n").collect()
        assert [r.n for r in numbered] == list(range(1, 301))
        assert [(r.k, r.o) for r in numbered] == sorted((r.k, r.o) for r in numbered)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_changes_compare_nulls(spark):
    df = spark.createDataFrame([("a", 1, None, "x"), ("a", 2, None, "x"), ("a", 3, 5.0, "x"), ("a", 4, 5.0, None)],
                               "k string, o int, sp double, status string")
    rows = changes(df, ["k"], ["o"]).orderBy("o").collect()
    assert [(r.price_changed, r.status_changed) for r in rows] == [(False, False), (False, False), (True, False), (False, True)]

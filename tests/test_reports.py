"""Reports, quality checks and order statistics."""

from pyspark.sql import functions as F

from shelf.functions.order_stats import order_statistics
from shelf.operators import compare, quality, reports


def diffs(spark, values):
    return spark.createDataFrame([(str(i), float(v)) for i, v in enumerate(values)], "item_code string, price_diff_pct double")


def test_accuracy_buckets(spark):
    r = reports.accuracy_buckets(diffs(spark, [1, 4, 8, 15, 25]), []).first()
    assert (r.within_2pct, r.within_5pct, r.within_10pct, r.within_20pct, r.beyond_20pct) == (1, 2, 3, 4, 1)
    assert reports.accuracy_buckets(diffs(spark, [1, 0.5, 2]), []).first().accuracy_2pct == 100.0
    assert reports.accuracy_buckets(diffs(spark, []), []).first().compared == 0


def test_top_mismatches(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 25.0), ("c", 5.0), ("d", 50.0), ("d", 3.0)], "item_code string, price_diff_pct double")
    assert [r.item_code for r in compare.top_mismatches(df, 2).collect()] == ["d", "b"]


def test_stage_coverage_counts_each_item_once(spark):
    matches = spark.createDataFrame([(1, 1), (2, 1), (2, 2), (3, 2), (9, 3)], "item_code int, stage int")
    usable = spark.createDataFrame([(1,), (2,), (3,), (4,)], "item_code int")
    rows = reports.stage_coverage(matches, usable, []).orderBy("stage").collect()
    assert [(r.matched, r.new_items, r.cumulative) for r in rows] == [(2, 2, 2), (2, 1, 3), (1, 0, 3)]
    assert rows[-1].coverage_pct == 75.0


def test_order_statistics_are_elements(spark):
    values = [0.0] * 50 + [float(i) / 7 for i in range(1, 38)]
    df = spark.createDataFrame([("a", v) for v in values] + [("b", 3.0)], "g string, v double")
    got = {r.g: (r.median, r.p90) for r in order_statistics(df, ["g"], "v", {"median": 0.5, "p90": 0.9}).collect()}
    ordered = sorted(values)
    assert got == {"a": (ordered[len(ordered) // 2], ordered[int(0.9 * len(ordered))]), "b": (3.0, 3.0)}
    one = order_statistics(df.where("g = 'a'"), [], "v", {"median": 0.5}).first()
    assert one.median == ordered[len(ordered) // 2]


def test_demand_weight_of_the_whole_table(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 3.0)], "k string, v double")
    assert {r.k: r.demand_weight for r in compare.demand_weight(df, "v", []).collect()} == {"a": 0.25, "b": 0.75}


def test_last_nonzero(spark):
    df = spark.createDataFrame([("a", 1, 5.0), ("a", 2, 6.0), ("a", 3, 0.0), ("b", 1, 0.0)], "k string, o int, v double")
    assert {r.k: r.v for r in compare.last_nonzero(df, ["k"], ["o"], "v").collect()} == {"a": 6.0, "b": 0.0}


def test_good_snapshot_has_no_failures(spark):
    rows = spark.range(200).select(F.lit(1).alias("pincode"), F.col("id").alias("item_code"), F.lit(10.0).alias("p0_sp"))
    cities = spark.createDataFrame([(1,)], "pincode int")
    assert quality.validate_snapshot(rows, cities, ["p0"]).count() == 0
    assert [r.check for r in quality.validate_snapshot(rows.limit(0), cities, ["p0"]).collect()] == ["too_few_rows", "no_rows"]


def test_completeness_both_ways(spark):
    ref = spark.createDataFrame([(1, 1), (1, 2)], "pincode int, item_code int")
    out = spark.createDataFrame([(1, 2, 5.0), (1, 3, None)], "pincode int, item_code int, sp double")
    r = quality.completeness(ref, out, ["sp"], ["pincode"]).first()
    assert (r.ref_items, r.output_rows, r.priced, r.missing, r.extra) == (2, 2, 1, 1, 1)


def test_order_statistics_of_any_size_and_sign(spark):
    import math
    import random
    rng = random.Random(4)
    groups = {
        "mixed": [rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 300) for _ in range(2000)] + [0.0, -0.0, 5e-324, -5e-324, 1.7e308],
        "near": [1.0 + k * 2.0 ** -40 for k in range(3000)] + [1.0] * 5000,
        "same": [7.25] * 100, "one": [-3.0], "integers": [float(k) for k in range(-500, 500)], "wide": [1e-9, 1e9, 0.0]}
    rows = [(g, v) for g, values in groups.items() for v in values]
    rng.shuffle(rows)
    quantiles = {"low": 0.0, "median": 0.5, "p90": 0.9, "p99": 0.99}
    got = {r.g: r for r in order_statistics(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", quantiles).collect()}
    for g, values in groups.items():
        ordered = sorted(values)
        for name, q in quantiles.items():
            assert got[g][name] == ordered[math.floor(q * len(ordered))], (g, name)

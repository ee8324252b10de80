"""The registered full run reaches every stage and keeps platforms and cities apart."""

from pyspark.sql import functions as F

import __spark_entry__ as entry
from shelf.operators.matching import key_match
from shelf.plans import match_cascade
from shelf.session import measured_broadcasts
from workload import adapters as a
from workload.base import Tables

SMALL = "/root/testdata/sf0.001"


def test_full_run_per_platform_and_city(spark):
    rows = entry.queries()["match_cascade"](spark, SMALL).collect()
    keys = [(r.platform, r.pincode, r.item_code, r.stage) for r in rows]
    assert len(keys) == len(set(keys)) and {1, 5} <= {r.stage for r in rows}
    listed = a.listings(Tables(spark, SMALL), "pincode").collect()
    assert {k[:3] for k in keys if k[3] == 1} == {(r.platform, r.pincode, r.source_item) for r in listed if r.source_item % 3}
    places = {}
    for r in listed:
        places.setdefault((r.platform, r.pincode), set()).add(str(r.product_id))
    assert all(r.product_id in places[r.platform, r.pincode] for r in rows)


def test_broadcasts_go_by_measured_rows(spark, tmp_path):
    path = str(tmp_path / "alike")
    spark.range(300_000).selectExpr("id", "repeat('x', 200) AS text").coalesce(1).write.parquet(path)
    rows = spark.read.parquet(path)

    def broadcasts() -> int:
        joined = rows.join(rows.withColumnRenamed("text", "other"), "id").groupBy().agg(F.max("text"), F.max("other"))
        joined.collect()
        return joined._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("BroadcastHashJoin")

    planned, measured = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    before = spark.conf.get(planned), spark.conf.get(measured, None)
    assert broadcasts() == 1  # a file of some 2 MB with 60 MB of rows
    with measured_broadcasts(spark):
        assert broadcasts() == 0
        small = rows.where("id < 1000")
        few = rows.join(small.select("id"), "id").groupBy().count()
        few.collect()
        # a file of the same size, of which few rows are read
        assert few._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("BroadcastHashJoin") == 1
    assert (spark.conf.get(planned), spark.conf.get(measured, None)) == before


def test_the_full_run_broadcasts_by_measured_rows(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(match_cascade, "key_match", lambda *args: seen.append(spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold", None)) or key_match(*args))
    entry.queries()["match_cascade"](spark, SMALL)
    assert seen[0] is not None and spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold", None) is None

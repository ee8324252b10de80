"""How often the workload's queries read and what they carry along, on tables of a few rows."""

import datetime

import pytest

from workload import adapters, pricing, resolve
from workload.base import Tables

PART = "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"
LINE = ("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, "
        "l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    day = datetime.datetime(2024, 1, 1)
    parts = [(i, "hot bolt", f"Brand#{i % 2}", ("SMALL", "LARGE", "PROMO")[i % 3], 10 + i, 900.0 + i) for i in range(6)]
    lines = [(o, o % 6, o % 9, 1 + o % 7, 40.0 + o % 10, 1000.0 + o, (o % 11) / 100, (o % 9) / 100, "AN"[o % 2], "O", day) for o in range(120)]
    for name, rows, schema in (("part", parts, PART), ("lineitem", lines, LINE), ("region", [(0, "r")], "r_regionkey long, r_name string"),
                               ("nation", [(i, f"n{i}", 0) for i in range(5)], "n_nationkey long, n_name string, n_regionkey long")):
        spark.createDataFrame(rows, schema).write.parquet(str(path / f"{name}.parquet"))
    return Tables(spark, str(path))


def test_a_pricing_run_joins_its_lines_once(tables, monkeypatch):
    joined, calls = pricing._joined_lines, []
    monkeypatch.setattr(pricing, "_joined_lines", lambda t: calls.append(t) or joined(t))
    rows = {r.key: r for r in pricing.base(Tables(tables.spark, tables.sf_dir)).collect()}
    assert len(calls) == 1 and len(rows) == 18
    # S0 and part 0: orders 0, 18, 36 … 108; the last with flag A (even orders) and a discount of at least 8 % is 108 (9 %), line 4
    assert (rows["S00"].off_invoice_pct, rows["S00"].off_invoice_value, rows["S00"].sku_type) == (0.09, 48.0, "GKM")


def test_best_by_score_carries_what_it_returns(tables):
    plan = str(resolve.best_by_score(tables)._jdf.queryExecution().optimizedPlan())
    assert "own_price" in plan and "own_name" not in plan and "ref_unit" not in plan


def test_live_joins_the_items_after_the_lines_are_summed_up(tables):
    plan = str(adapters.live(tables)._jdf.queryExecution().optimizedPlan())
    assert plan.index("Join") < plan.index("Aggregate") and plan.count("Join") == 1


def test_live_shows_the_last_offer_of_the_latest_date(spark, tmp_path):
    old, new = datetime.datetime(2024, 1, 1), datetime.datetime(2024, 2, 1)
    lines = [(1, 1, 0, 1, 1.0, 1.0, 0.1, 0.0, "N", "O", old), (2, 1, 0, 1, 1.0, 1.0, 0.5, 0.05, "N", "O", new), (3, 1, 0, 1, 1.0, 1.0, 0.2, 0.09, "N", "O", new),
             (4, 1, 10, 1, 1.0, 1.0, 0.3, 0.0, "N", "O", old), (5, 1, 5, 1, 1.0, 1.0, 0.3, 0.0, "R", "O", new), (9, 1, 0, 1, 1.0, 1.0, 0.4, 0.0, "N", "O", None),
             (6, 2, 0, 1, 1.0, 1.0, 0.3, 0.0, "N", "O", None), (7, None, 0, 1, 1.0, 1.0, 0.3, 0.0, "N", "O", new), (8, 3, 0, 1, 1.0, 1.0, 0.3, 0.0, "N", "O", new)]
    parts = [(1, "hot bolt", "b", "SMALL", 1, 100.0), (1, "hot bolt", "b", "SMALL", 1, 100.0), (2, "cold nut", "b", "SMALL", 1, 100.0), (None, "x", "b", "SMALL", 1, 100.0)]
    spark.createDataFrame(lines, LINE).write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame(parts, PART).write.parquet(str(tmp_path / "part.parquet"))
    rows = {r.item_code: r for r in adapters.live(Tables(spark, str(tmp_path))).collect()}
    assert sorted(rows) == [1, 2]
    # p0: line 3 is the last of the latest date; p1: its line 4 is older; p2: its line 5 is not in stock
    assert (rows[1].date, rows[1].product_name, rows[1].am_mrp) == (new.date(), "hot bolt", 100.0)
    assert (rows[1].p0_sp, rows[1].p0_mrp, rows[1].p0_status) == (80.0, 100.0, "SEMI COMPLETE MATCH")
    assert [rows[1][f"{p}_{x}"] for p in ("p1", "p2") for x in ("sp", "mrp", "status")] == [None, None, "NA"] * 2
    # without any date nothing is shown
    assert [v for k, v in rows[2].asDict().items() if k not in ("pincode", "item_code")] == [None] * 14


def test_listings_of_groups_are_the_listings(spark, tmp_path):
    parts = [(1, "hot bolt", "B1", "SMALL", 10, 900.0), (1, "hot bolt", "B1", "SMALL", 10, 950.0), (2, "ring", None, "LARGE", 30, -5.0),
             (3, None, "B2", None, None, None), (None, "x", "y", "z", 1, 1.0)]
    lines = [(o, p, s, 1, 1.0, 1.0, d, 0.0, "A", "O", None) for o, (p, s, d) in enumerate(
        (p, s, d) for p in (1, 2, 3, 4, None) for s in (0, 1, 4, None) for d in (0.05, 0.1, None, float("nan"), 0.0) if not (s == 1 and d is not None))]
    spark.createDataFrame(parts, PART).write.parquet(str(tmp_path / "part.parquet"))
    spark.createDataFrame(lines, LINE).write.parquet(str(tmp_path / "lineitem.parquet"))
    t = Tables(spark, str(tmp_path))
    groups = adapters.listings_of_groups(t)
    rows, before = (sorted(map(repr, df.collect())) for df in (groups.select(*adapters.listings(t).columns), adapters.listings(t)))
    assert rows and rows == before
    # no text is held by what groups the lines
    plan = str(groups._jdf.queryExecution().optimizedPlan())
    lowest = [line for line in plan.splitlines() if "Aggregate" in line][-1]
    assert "l_discount" in lowest and "p_name" not in lowest


def test_pricing_inputs_are_merged_not_broadcast(tables):
    t = Tables(tables.spark, tables.sf_dir)
    shown = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in shown(pricing._joined_lines(t))
    # nations and regions alone are a fixed dimension
    plan = shown(pricing.base(t))
    assert plan.count("BroadcastExchange") == 2 and plan.count("SortMergeJoin") >= 14


def test_the_mart_has_all_its_columns(tables):
    mart = pricing.pricing_mart(Tables(tables.spark, tables.sf_dir))
    assert len(mart.columns) == 59
    rows = mart.select("key", "brand", "qty_30d", "calc_cost", "off_invoice_adjusted_cost", "remark_1", "discount_bucket").collect()
    assert rows and all(r.brand and r.qty_30d is not None and r.calc_cost == r.off_invoice_adjusted_cost and r.remark_1 and r.discount_bucket for r in rows)

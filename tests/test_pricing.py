"""Worked price examples and invariants of the rules."""

import pytest
from pyspark.sql import functions as F

from shelf.operators import pricing

DEFAULTS = dict(item_code="x", display_name="x", master_category="FMCGF", kvi_tag="NON KVI", mrp=0.0, latest_inward_cost=0.0, map_price=0.0,
                off_invoice_pct=0.0, off_invoice_value=0.0, on_invoice_pct=0.0, on_invoice_value=0.0, is_excluded=False,
                exclusion_type="", benchmark_sp=0.0, sku_type="GKM", guardrail_lower=0.0, guardrail_upper=0.0, cost_based_markup=0.0,
                current_sp=0.0, city_sp_override=0.0)


def price(spark, **fields):
    row = {**DEFAULTS, **fields}
    schema = ", ".join(f"{k} {'boolean' if isinstance(v, bool) else 'double' if isinstance(v, float) else 'string'}" for k, v in DEFAULTS.items())
    return pricing.recommend_prices(spark.createDataFrame([tuple(row[k] for k in DEFAULTS)], schema)).first()


@pytest.mark.parametrize("fields,sp,rule", [
    (dict(mrp=35.0, latest_inward_cost=27.3, off_invoice_value=1.4), 34, "RULE_1_PROMO"),
    (dict(mrp=75.0, map_price=61.5, on_invoice_value=3.0), 72, "RULE_2A_NONKVI_PROMO"),
    (dict(mrp=539.0, map_price=370.5, benchmark_sp=429.0, kvi_tag="KVI"), 429, "RULE_3C_KVI_BM_ONLY"),
    (dict(mrp=39.0, latest_inward_cost=11.0), 20, "RULE_7_HIGH_MARGIN"),
    (dict(mrp=283.0, map_price=216.612, off_invoice_value=10.0, benchmark_sp=235.0, kvi_tag="Super KVI"), 235, "RULE_3A_KVI_PROMO_BM"),
    (dict(mrp=200.0, map_price=140.0, is_excluded=True), 200, "RULE_8_EXCLUDED_NO_PROMO"),
    (dict(mrp=480.0, map_price=446.21, on_invoice_value=30.0, kvi_tag="KVI"), 473, "RULE_3D_KVI_FORMULA"),
    (dict(master_category="STPLS", sku_type="cost_based", mrp=200.0, latest_inward_cost=100.0, cost_based_markup=0.15), 115, "STAPLES_COST_BASED"),
    (dict(master_category="STPLS", mrp=200.0, latest_inward_cost=150.0, city_sp_override=120.0), 120, "RULE_2B_NONKVI_FORMULA")])
def test_worked_examples(spark, fields, sp, rule):
    r = price(spark, **fields)
    assert (r.sp, r.rule_applied) == (sp, rule)


def test_removed_promo_is_flagged(spark):
    r = price(spark, mrp=480.0, map_price=446.21, on_invoice_value=30.0, kvi_tag="KVI")
    assert r.remarks[0] == "on-invoice promo removed" and len(r.flags) == 1
    assert r.remarks[-1].startswith("minimum discount")


def test_fractional_mrp_can_be_exceeded(spark):
    r = price(spark, mrp=35.5, latest_inward_cost=30.0)
    assert r.sp == 36 and not r.mrp_gte_sp


def test_clamps(spark):
    r = price(spark, mrp=100.0, latest_inward_cost=95.0, off_invoice_pct=0.0, on_invoice_value=20.0, kvi_tag="KVI", benchmark_sp=50.0)
    assert r.sp >= r.cost


def test_tiers(spark):
    df = spark.createDataFrame([(m,) for m in (-1.0, 0.10, 0.1001, 0.15, 0.54, 0.55)], "m double")
    assert [r.discount for r in pricing.tier_lookup(df, "m").collect()] == [0.0, 0.0, 0.02, 0.02, 0.20, 0.50]


def test_marts_have_their_width(spark):
    rows = spark.createDataFrame([("S1x", "S1", "x")], "key string, state string, item_code string")
    base = rows.select("*", *[F.lit(v).alias(k) for k, v in DEFAULTS.items() if k != "item_code"],
                       *[F.lit(1.0).alias(c) for c in ("qty_30d", "sale_30d", "qty_90d", "sale_90d")],
                       F.create_map(F.lit("ADR"), F.lit(1.0)).alias("city_sps"))
    priced = pricing.recommend_prices(base)
    assert len(pricing.pricing_mart(priced).columns) == 59
    assert len(pricing.pricing_extract(priced).columns) == 11
    assert len(pricing.staples_mart(priced, ["a", "b"]).columns) == 57
    assert len(pricing.staples_extract(priced).columns) == 17


def test_filter_on_result_stays_above_the_rules(spark):
    df = spark.createDataFrame([tuple(DEFAULTS.values())], ", ".join(
        f"{k} {'boolean' if isinstance(v, bool) else 'double' if isinstance(v, float) else 'string'}" for k, v in DEFAULTS.items()))
    plan = pricing.flagged(pricing.recommend_prices(df.withColumn("key", F.lit("k"))))._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 60_000

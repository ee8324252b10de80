"""Selling-price recommendation: inputs, rules and marts as built-in expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelf.functions.numbers import nonzero, total_of
from shelf.operators.compare import demand_weight, last_nonzero

# Highest margin of a tier and the discount it gives; the last tier is open.
DISCOUNT_TIERS = [(0.10, 0.00), (0.15, 0.02), (0.20, 0.03), (0.25, 0.05),
                  (0.30, 0.07), (0.40, 0.10), (0.54, 0.20), (None, 0.50)]

STAPLES = "STPLS"
# Master category of the catalogue and the pricing category it counts as.
PRICING_CATEGORY = {"FMCG": "FMCGF", "GM": "FMCGNF"}


def _zero(c: str) -> Column:
    return F.coalesce(F.col(c).cast("double"), F.lit(0.0))


# --- inputs -----------------------------------------------------------------------------------

def benchmarks(offers: DataFrame, cities: DataFrame) -> DataFrame:
    """Highest in-stock competitor price per state and item, over the latest price of each of its cities.

    ``benchmark_date`` is the day of that price. ``offers`` has (pincode, item_code, date, sp, in_stock), ``cities`` (pincode, state).
    """
    sold = (offers.where(F.col("in_stock") & (F.col("sp") > 0))
            # one row per city and item before the state is looked up
            .groupBy("pincode", "item_code").agg(F.max(F.struct("date", "sp")).alias("b")))
    return (sold.join(cities.select("pincode", "state"), "pincode").groupBy("state", "item_code")
            .agg(F.max(F.struct("b.sp", "b.date")).alias("b"))
            .select("state", "item_code", F.col("b.date").alias("benchmark_date"), F.col("b.sp").alias("benchmark_sp")))


def expand_states(sales: DataFrame, states: list[str]) -> DataFrame:
    """Rows without a state count for every state."""
    every = F.array(*[F.lit(s) for s in states])
    state = F.when(F.coalesce("state", F.lit("")) == "", every).otherwise(F.array("state"))
    rest = [c for c in sales.columns if c != "state"]
    return sales.select(*rest, F.explode(state).alias("state"))


def first_nonempty(dfs: list[DataFrame], key: str, value: str) -> DataFrame:
    """First row with a non-empty value per key over several feeds, in the order given.

    Each feed has an ``ordinal``; within a feed the earliest row wins.
    """
    tagged = [df.where(F.coalesce(value, F.lit("")) != "").withColumn("_feed", F.lit(i)) for i, df in enumerate(dfs)]
    union = reduce(lambda a, b: a.unionByName(b), tagged)
    rest = [c for c in dfs[0].columns if c not in (key, "ordinal")]
    return (union.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct("_feed", "ordinal")).alias("r"))
            .select(key, "r.*"))


def city_overrides(df: DataFrame, columns: dict[str, str], current: str | None = None) -> DataFrame:
    """City price columns to a map of the positive ones; rows without any are dropped.

    ``columns`` maps column names to city names.
    """
    entries = F.array(*[F.struct(F.lit(city).alias("city"), _zero(c).alias("sp")) for c, city in columns.items()])
    positive = F.filter(entries, lambda e: e["sp"] > 0)
    out = df.withColumn("city_sps", F.map_from_entries(positive))
    now = _zero(current) if current else F.lit(0.0)
    return (out.withColumn("current_sp", nonzero(now)).where((F.size("city_sps") > 0) | F.col("current_sp").isNotNull())
            .select("key", "city_sps", "current_sp"))


def overrides_long(df: DataFrame) -> DataFrame:
    """The map of city prices back to one row per key and city."""
    return df.select("key", F.explode("city_sps").alias("city", "sp"))


def keyed_costs(costs: DataFrame, order: list[str]) -> DataFrame:
    """Latest non-zero cost per key."""
    return last_nonzero(costs, ["key"], order, "inward_cost")


def pricing_base(catalogue: DataFrame, inputs: dict[str, DataFrame], states: dict[str, str]) -> DataFrame:
    """Catalogue × states with every pricing input and its fallback.

    ``states`` maps a state to its warehouse. Inputs by item are joined before the states are
    expanded; the rest share the join key ``key`` (state followed by item code), so the expanded
    table is shuffled once for all of them. Inputs grow with the catalogue, so all are merged: the size of a
    compressed file says too little of its rows for a broadcast, which the driver has to hold. Inputs: ``costs(key, inward_cost, mrp)``,
    ``warehouse_costs(item_code, warehouse, inward_cost, mrp)``, ``off_invoice(key, off_invoice_pct,
    off_invoice_value)``, ``on_invoice(...)``, ``tags(key, kvi_tag)``, ``exclusions(item_code,
    exclusion_type)``, ``map_by_key(key, map_price)``, ``map_by_item(item_code, map_price)``,
    ``benchmarks(key, benchmark_sp)``, ``sales(key, qty_30d, sale_30d, qty_90d, sale_90d)``,
    ``guardrails(key, sku_type, guardrail_lower, guardrail_upper, cost_based_markup, category,
    current_sp)``, ``overrides(key, city_sps, current_sp)``, ``categories(key, category)``.
    """
    mcat = F.upper(F.trim("master_category"))
    category = mcat
    for raw, meant in PRICING_CATEGORY.items():
        category = F.when(mcat == raw, meant).otherwise(category)
    excl = inputs["exclusions"].groupBy("item_code").agg(F.max("exclusion_type").alias("exclusion_type"))
    by_item = inputs["map_by_item"].select("item_code", F.col("map_price").alias("_map_item"))
    per_item = (catalogue.withColumn("master_category", category)
                .join(excl.withColumn("is_excluded", F.lit(True)).hint("merge"), "item_code", "left")
                .join(by_item.hint("merge"), "item_code", "left"))
    pairs = F.array(*[F.struct(F.lit(s).alias("state"), F.lit(w).alias("warehouse")) for s, w in states.items()])
    base = (per_item.withColumn("_s", F.explode(pairs)).select("*", "_s.state", "_s.warehouse").drop("_s")
            .withColumn("key", F.concat("state", F.col("item_code").cast("string"))))
    warehouse = inputs["warehouse_costs"].select("item_code", "warehouse", F.col("inward_cost").alias("_wh_cost"),
                                                 F.col("mrp").alias("_wh_mrp"))
    guard = inputs["guardrails"].withColumnsRenamed({"category": "_guard_category", "current_sp": "_guard_sp"})
    city = inputs["overrides"].withColumnRenamed("current_sp", "_city_sp")
    costs = inputs["costs"].select("key", F.col("inward_cost").alias("_key_cost"), F.col("mrp").alias("_key_mrp"))
    out = base.join(warehouse.hint("merge"), ["item_code", "warehouse"], "left")
    for df in (costs, inputs["off_invoice"], inputs["on_invoice"], inputs["tags"],
               inputs["map_by_key"].withColumnRenamed("map_price", "_map_key"), inputs["benchmarks"], inputs["sales"],
               guard, city, inputs["categories"].withColumnRenamed("category", "_promo_category")):
        out = out.join(df.hint("merge"), "key", "left")
    cost_mrp = F.coalesce(nonzero(F.col("_key_mrp")), nonzero(F.col("_wh_mrp")))
    resolved = (out.withColumn("latest_inward_cost", F.coalesce(nonzero(F.col("_key_cost")), F.col("_wh_cost"), F.lit(0.0)))
                .withColumn("mrp", F.coalesce(F.when(cost_mrp > 0, cost_mrp), F.col("mrp"), F.lit(0.0)))
                .withColumn("map_price", F.coalesce(nonzero(F.col("_map_key")), F.col("_map_item"), F.lit(0.0)))
                .withColumn("kvi_tag", F.coalesce("kvi_tag", F.lit("NON KVI")))
                .withColumn("is_excluded", F.coalesce("is_excluded", F.lit(False)))
                .withColumn("sku_type", F.coalesce("sku_type", F.lit("GKM")))
                .withColumn("category", F.coalesce(F.nullif("_guard_category", F.lit("")), "_promo_category", F.lit("")))
                .withColumn("current_sp", F.coalesce(nonzero(F.col("_city_sp")), F.col("_guard_sp"), F.lit(0.0)))
                .withColumn("city_sp_override", F.coalesce(F.try_element_at("city_sps", F.lit("ADR")), F.lit(0.0))))
    numbers = ["off_invoice_pct", "off_invoice_value", "on_invoice_pct", "on_invoice_value", "benchmark_sp", "qty_30d",
               "sale_30d", "qty_90d", "sale_90d", "guardrail_lower", "guardrail_upper", "cost_based_markup"]
    return (resolved.withColumns({c: _zero(c) for c in numbers})
            .drop("_wh_cost", "_wh_mrp", "_key_cost", "_key_mrp", "_map_key", "_map_item", "_guard_category", "_guard_sp",
                  "_city_sp", "_promo_category"))


# --- costs, tiers, guardrails --------------------------------------------------------------------

def promo_cost(df: DataFrame) -> DataFrame:
    """Promotion values, the greater of the two, cost after off-invoice promotion, and margins."""
    def value(kind: str) -> Column:
        given, pct = _zero(f"{kind}_invoice_value"), _zero(f"{kind}_invoice_pct")
        return F.when((given == 0) & (pct > 0) & (F.col("mrp") > 0), F.col("mrp") * pct).otherwise(given)

    base = F.when(_zero("map_price") > 0, _zero("map_price")).otherwise(_zero("latest_inward_cost"))
    inward = _zero("latest_inward_cost")
    return (df.withColumn("mrp", _zero("mrp")).withColumn("off_value", value("off")).withColumn("on_value", value("on"))
            .withColumn("final_invoice_value", F.greatest("off_value", "on_value"))
            .withColumn("promo_source", F.when(F.col("off_value") >= F.col("on_value"), "off_invoice").otherwise("on_invoice"))
            .withColumn("cost", F.when(F.col("off_value") > 0, base - F.col("off_value")).otherwise(base))
            .withColumn("margin", F.when(F.col("mrp") > 0, (F.col("mrp") - F.col("cost")) / F.col("mrp")).otherwise(0.0))
            .withColumn("grn_margin", F.when((F.col("mrp") > 0) & (inward > 0), (F.col("mrp") - inward) / F.col("mrp"))
                        .otherwise(0.0)))


def tier_of(x: Column, tiers: list[tuple[float | None, float]] | None = None) -> Column:
    """Value of the first tier whose upper bound is not below ``x``."""
    tiers = tiers or DISCOUNT_TIERS
    out = F.lit(tiers[-1][1])
    for bound, value in reversed(tiers[:-1]):
        out = F.when(x <= bound, F.lit(value)).otherwise(out)
    return out


def tier_lookup(df: DataFrame, x: str, out: str = "discount",
                tiers: list[tuple[float | None, float]] | None = None) -> DataFrame:
    return df.withColumn(out, tier_of(F.col(x), tiers))


def _percent(c: Column) -> Column:
    return F.format_string("%.1f%%", c * 100)


def _guardrail_remarks(sp: Column, cost: Column) -> list[Column]:
    lower, upper = _zero("guardrail_lower"), _zero("guardrail_upper")
    now = F.when(sp > 0, (sp - cost) / sp).otherwise(0.0)
    return [F.when((lower > 0) & (now < lower), F.concat(F.lit("below guardrail: "), _percent(now))),
            F.when((upper > 0) & (now > upper), F.concat(F.lit("above guardrail: "), _percent(now)))]


def guardrails(df: DataFrame, sp: str = "sp", cost: str = "cost") -> DataFrame:
    """Adds ``guardrail``: BELOW, ABOVE, OK, or empty where no bound is set."""
    lower, upper = _zero("guardrail_lower"), _zero("guardrail_upper")
    now = F.when((F.col(sp) > 0) & (F.col(cost) > 0), (F.col(sp) - F.col(cost)) / F.col(sp)).otherwise(0.0)
    verdict = (F.when((lower <= 0) & (upper <= 0), "").when(now < lower, "BELOW").when(now > upper, "ABOVE").otherwise("OK"))
    return df.withColumn("sku_margin", now).withColumn("guardrail", verdict)


# --- the rules ---------------------------------------------------------------------------------------

def _present(*parts: Column) -> Column:
    return F.filter(F.array(*parts), lambda x: x.isNotNull())


def recommend_prices(base: DataFrame) -> DataFrame:
    """Recommended selling price with the rule applied, remarks in order, and flags.

    Three branches: cost-plus staples, exclusions, and the rule ladder with its post-checks. Each
    step is a projection over the columns of the step before, so the whole job is one stage of
    built-in expressions. Prices stay doubles until the final ceil, which comes after clamping: a
    fractional MRP can be exceeded by less than one unit.
    """
    c = F.col
    df = promo_cost(base)
    df = (df.withColumn("_tag", F.upper(F.trim(F.coalesce("kvi_tag", F.lit("NON KVI")))))
          .withColumn("_staple", F.upper(F.trim(F.coalesce("master_category", F.lit("")))) == STAPLES)
          .withColumn("_cost_based", F.upper(F.trim(F.coalesce("sku_type", F.lit("GKM")))) == "COST_BASED")
          .withColumn("_branch", F.when(c("_staple") & c("_cost_based"), "cost_plus")
                      .when(F.coalesce("is_excluded", F.lit(False)), "excluded").otherwise("rules"))
          .withColumn("_override", _zero("city_sp_override")))

    # on-invoice promotion that would eat the margin is not passed on
    sold_at = c("mrp") - c("on_value")
    retained = F.when(sold_at > 0, (sold_at - c("cost")) / sold_at).otherwise(0.0)
    danger = ((c("_branch") == "rules") & (c("on_value") > 0) & (c("margin") > 0)
              & (c("on_value") / nonzero(c("mrp") * c("margin")) > 0.80) & (retained < 0.07))
    df = (df.withColumn("_danger", F.coalesce(danger, F.lit(False)))
          .withColumn("_removed", c("_danger") & (c("promo_source") == "on_invoice"))
          .withColumn("final_invoice_value", F.when(c("_removed"), c("off_value")).otherwise(c("final_invoice_value")))
          .withColumn("promo_source", F.when(c("_removed"), F.when(c("off_value") > 0, "off_invoice").otherwise("none"))
                      .otherwise(c("promo_source")))
          .withColumn("_promo", c("final_invoice_value") > 0)
          .withColumn("_promo_sp", c("mrp") - c("final_invoice_value"))
          .withColumn("_formula_sp", c("mrp") * (1 - tier_of(c("margin"))))
          .withColumn("_benchmark", _zero("benchmark_sp")))

    # the first rule that applies
    key_item, has_benchmark = c("_tag").isin("KVI", "SUPER KVI"), c("_benchmark") > 0
    rule = (F.when(c("_branch") == "cost_plus", "STAPLES_COST_BASED")
            .when(c("_branch") == "excluded", F.when(c("_promo"), "RULE_8_EXCLUDED_WITH_PROMO").otherwise("RULE_8_EXCLUDED_NO_PROMO"))
            .when(c("mrp") <= 40, F.when(c("_promo"), "RULE_1_PROMO").otherwise("RULE_1_NO_PROMO"))
            .when(c("_tag") == "NON KVI", F.when(c("_promo"), "RULE_2A_NONKVI_PROMO").otherwise("RULE_2B_NONKVI_FORMULA"))
            .when(key_item & c("_promo"), F.when(has_benchmark, "RULE_3A_KVI_PROMO_BM").otherwise("RULE_3B_KVI_PROMO_ONLY"))
            .when(key_item, F.when(has_benchmark, "RULE_3C_KVI_BM_ONLY").otherwise("RULE_3D_KVI_FORMULA"))
            .otherwise("FALLBACK"))
    markup = _zero("cost_based_markup")
    cost_plus = F.when(c("_override") > 0, c("_override")).when(markup > 0, c("cost") * (1 + markup)).otherwise(
        F.coalesce(nonzero(_zero("current_sp")), c("cost") * 1.10))
    first_sp = (F.when(c("_rule") == "STAPLES_COST_BASED", cost_plus)
                .when(c("_branch") == "excluded", F.greatest(F.when(c("_promo"), c("_promo_sp")).otherwise(c("mrp")), c("cost")))
                .when(c("_rule") == "RULE_3A_KVI_PROMO_BM", F.greatest(F.least("_promo_sp", "_benchmark"), c("cost")))
                .when(c("_rule") == "RULE_3C_KVI_BM_ONLY", F.greatest("_benchmark", "cost"))
                .when(c("_promo"), c("_promo_sp")).when(c("_rule") == "RULE_1_NO_PROMO", c("mrp"))
                .otherwise(c("_formula_sp")))
    df = df.withColumn("_rule", rule).withColumn("_sp1", first_sp)

    # high margin
    ladder = c("_branch") == "rules"
    high = ladder & (c("mrp") > 10) & (c("margin") > 0.54)
    deep_promo = c("_promo") & ((c("mrp") - c("_promo_sp")) / nonzero(c("mrp")) > 0.50)
    df = (df.withColumn("_high", high).withColumn("_deep", F.coalesce(high & deep_promo, F.lit(False)))
          .withColumn("_sp2", F.when(c("_deep"), F.least("_sp1", "_promo_sp")).when(c("_high"), c("mrp") * 0.50).otherwise(c("_sp1")))
          .withColumn("rule_applied", F.when(c("_high") & ~c("_deep"), "RULE_7_HIGH_MARGIN").otherwise(c("_rule"))))

    # minimum discount, then clamps
    at_mrp = ladder & (F.abs(c("_sp2") - c("mrp")) < 0.01)
    minimum = F.when(at_mrp & (c("mrp") >= 200), 0.015).when(at_mrp & (c("mrp") >= 100), 0.01)
    df = (df.withColumn("_minimum", minimum)
          .withColumn("_sp3", F.when(c("_minimum").isNotNull(), c("mrp") * (1 - c("_minimum"))).otherwise(c("_sp2")))
          .withColumn("_over_mrp", ladder & (c("_sp3") > c("mrp")))
          .withColumn("_sp4", F.when(c("_over_mrp"), c("mrp")).otherwise(c("_sp3")))
          .withColumn("_under_cost", ladder & (c("_sp4") < c("cost")) & (c("cost") > 0))
          .withColumn("_sp5", F.when(c("_under_cost"), c("cost")).otherwise(c("_sp4"))))
    overridden = ladder & c("_staple") & (c("_override") > 0)
    df = df.withColumn("_sp7", F.when(overridden, c("_override")).otherwise(c("_sp5")))
    df = df.withColumn("sp", F.when(c("_sp7") > 0, F.ceil("_sp7").cast("double")).otherwise(0.0))

    # explanations, in the order in which the steps ran
    passed = F.concat(F.lit("promo passed ("), c("promo_source"), F.lit(": "), c("final_invoice_value").cast("string"), F.lit(")"))
    formula = F.concat(F.lit("formula: margin "), _percent(c("margin")), F.lit(", discount "), _percent(tier_of(c("margin"))))
    floor = F.when(((c("_rule") == "RULE_3A_KVI_PROMO_BM") & (F.least("_promo_sp", "_benchmark") < c("cost")))
                   | ((c("_rule") == "RULE_3C_KVI_BM_ONLY") & (c("_benchmark") < c("cost"))), "cost floor applied")
    main = (F.when(c("_rule") == "STAPLES_COST_BASED", "cost plus markup")
            .when(c("_branch") == "excluded", F.concat(F.lit("excluded ("), F.coalesce("exclusion_type", F.lit("")), F.lit("), "),
                                                      F.when(c("_promo"), passed).otherwise("no discount")))
            .when(c("_rule") == "RULE_1_NO_PROMO", "low MRP, no promo")
            .when(c("_rule").isin("RULE_3A_KVI_PROMO_BM", "RULE_3C_KVI_BM_ONLY"),
                  F.concat(F.lit("benchmark "), c("_benchmark").cast("string"), F.when(c("_promo"), F.concat(F.lit(", "), passed)).otherwise("")))
            .when(c("_promo"), passed).otherwise(formula))
    guarded = c("_staple") & (c("_branch") != "excluded")
    before_override = F.when(c("_branch") == "cost_plus", c("_sp7")).otherwise(c("_sp5"))
    override = F.when((c("_branch") == "cost_plus") & (c("_override") > 0) | overridden,
                      F.concat(F.lit("city price "), c("_override").cast("string")))
    guard = [F.when(guarded, r) for r in _guardrail_remarks(before_override, c("cost"))]
    remarks = _present(
        F.when(c("_removed"), "on-invoice promo removed"), floor, main, F.when(c("_branch") == "cost_plus", override),
        F.when(c("_deep"), "high margin, deeper promo kept"), F.when(c("_high") & ~c("_deep"), "high margin, half price"),
        F.when(c("_minimum").isNotNull(), F.concat(F.lit("minimum discount "), _percent(c("_minimum")))),
        F.when(c("_over_mrp"), "clamped to MRP"), F.when(c("_under_cost"), "clamped to cost"),
        *guard, F.when(overridden, override))
    flags = _present(
        F.when(c("_danger"), F.concat(F.lit("on-invoice promo "), c("on_value").cast("string"), F.lit(" endangers the margin"))),
        F.when(c("_under_cost"), F.lit("price below cost")))
    df = df.withColumn("remarks", remarks).withColumn("flags", flags)
    df = _result_metrics(df)
    kept = [x for x in df.columns if not x.startswith("_") and x not in RESULT]
    # One generated row per input row: a filter on a result column stays above it. Pushed below,
    # it would copy the whole ladder into the predicate once per use of every step.
    return df.select(*kept, F.inline(F.array(F.struct(*RESULT))))


RESULT = ["sp", "cost", "margin", "grn_margin", "final_invoice_value", "promo_source", "rule_applied", "discount_pct",
          "retention_margin", "sp_equals_mrp", "mrp_gte_sp", "sp_gte_cost", "remarks", "flags"]


def _result_metrics(df: DataFrame) -> DataFrame:
    c = F.col
    return (df.withColumn("discount_pct", F.when(c("mrp") > 0, (c("mrp") - c("sp")) / c("mrp")).otherwise(0.0))
            .withColumn("retention_margin", F.when(c("sp") > 0, (c("sp") - c("cost")) / c("sp")).otherwise(0.0))
            .withColumn("sp_equals_mrp", F.abs(c("sp") - c("mrp")) < 0.01)
            .withColumn("mrp_gte_sp", c("mrp") >= c("sp"))
            .withColumn("sp_gte_cost", (c("cost") <= 0) | (c("sp") >= c("cost"))))


# --- marts ---------------------------------------------------------------------------------------------

def _bucket(x: Column, bounds: list[tuple[float, str]], rest: str) -> Column:
    out = F.lit(rest)
    for bound, label in reversed(bounds):
        out = F.when(x <= bound, label).otherwise(out)
    return out


# Upper bounds and labels of the report buckets.
MRP_BUCKETS = ([(40, "<=40"), (100, "40-100"), (200, "100-200")], ">=200")
MARGIN_BUCKETS = ([(0.10, "<=10%"), (0.15, "10%-15%"), (0.20, "15%-20%"), (0.25, "20%-25%"),
                   (0.30, "25%-30%"), (0.40, "30%-40%"), (0.54, "40%-54%")], ">54%")
DISCOUNT_BUCKETS = ([(0, "0%"), (0.03, "b0%-3%"), (0.07, "b3%-7%"), (0.10, "b7%-10%"), (0.20, "b10%-20%")], ">20%")
RETENTION_BUCKETS = ([(0, "<0%"), (0.05, "0-5%"), (0.10, "5-10%"), (0.15, "10-15%"), (0.20, "15-20%")], ">20%")


def price_buckets(r: DataFrame) -> DataFrame:
    return (r.withColumn("mrp_bucket", _bucket(F.col("mrp"), *MRP_BUCKETS))
            .withColumn("margin_bucket", _bucket(F.col("margin"), *MARGIN_BUCKETS))
            .withColumn("discount_bucket", _bucket(F.col("discount_pct"), *DISCOUNT_BUCKETS))
            .withColumn("rm_bucket", _bucket(F.col("retention_margin"), *RETENTION_BUCKETS)))


def _blank(name: str) -> Column:
    return F.lit(None).cast("string").alias(name)


def _remark(i: int) -> Column:
    return F.coalesce(F.get("remarks", F.lit(i - 1)), F.lit("")).alias(f"remark_{i}")


def _positive(x: Column) -> Column:
    return F.when(x > 0, x)


def total_sales(sales: DataFrame, catalogue: DataFrame, states: dict[str, str], wanted: Column) -> Column:
    """The 90-day sales of all priced products of the ``wanted`` categories, as a scalar: sales joined with the catalogue, without prices."""
    keys = catalogue.where(wanted).select(F.explode(F.array(*[F.lit(s) for s in states])).alias("state"), "item_code").select(
        F.concat("state", F.col("item_code").cast("string")).alias("key"))
    return sales.join(keys.hint("merge"), "key").agg(total_of(F.col("sale_90d"))).scalar()


def pricing_mart(r: DataFrame, benchmark_prefix: str = "platform", total: Column | None = None) -> DataFrame:
    """The 59-column sheet of priced products other than staples.

    ``<prefix>_mrp`` and ``<prefix>_sp`` are the benchmark platform's prices, where present. ``total`` are the sales that
    demand weights are shares of; without it the priced table is written once to find them.
    """
    c = F.col
    b_mrp = _zero(f"{benchmark_prefix}_mrp") if f"{benchmark_prefix}_mrp" in r.columns else F.lit(0.0)
    b_sp = _zero(f"{benchmark_prefix}_sp") if f"{benchmark_prefix}_sp" in r.columns else F.lit(0.0)
    df = demand_weight(price_buckets(r), "sale_90d", [], total)
    text = lambda n: (c(n) if n in r.columns else F.lit("")).alias(n)
    mrp, margin, on_value = c("mrp"), c("margin"), _zero("on_invoice_value")
    return df.select(
        "key", "state", "item_code", "display_name", "kvi_tag", text("category"), text("sub_category"), text("leaf_category"),
        text("brand"), text("marketed_by"), "qty_30d", "sale_30d", "qty_90d", "sale_90d", "demand_weight",
        F.when(c("is_excluded"), "yes").otherwise("").alias("exclusions"), "off_invoice_pct", "off_invoice_value",
        "on_invoice_pct", "on_invoice_value", "final_invoice_value",
        F.when(mrp > 0, on_value / mrp).otherwise(0.0).alias("on_invoice_of_mrp"),
        F.when((mrp > 0) & (margin > 0), on_value / (mrp * margin)).otherwise(0.0).alias("on_invoice_of_margin"),
        "mrp", "mrp_bucket", "latest_inward_cost", "map_price", c("cost").alias("off_invoice_adjusted_cost"), "grn_margin",
        F.when((mrp > 0) & (c("map_price") > 0), (mrp - c("map_price")) / mrp).otherwise(0.0).alias("map_margin"),
        _positive(b_mrp).alias("benchmark_platform_mrp"), _positive(b_sp).alias("benchmark_platform_sp"),
        F.when(b_mrp > 0, F.abs(b_mrp - mrp) < 1).alias("equal_mrp"), "margin", "margin_bucket",
        _blank("old_mrp"), _blank("old_sp"), _blank("old_discount_pct"), _blank("assortment_check"),
        mrp.alias("calc_mrp"), c("cost").alias("calc_cost"), c("map_price").alias("automated_map"), c("sp").alias("sp_bau"),
        _blank("changes"), _remark(5), _remark(4), _remark(3), _remark(2), _remark(1),
        "discount_pct", c("discount_pct").alias("bau_discount"), "discount_bucket", c("retention_margin").alias("rm_pct"), "rm_bucket",
        F.when(c("qty_90d") > 0, c("sp") * c("qty_90d")).alias("sp_x_qty"),
        F.when(c("qty_90d") > 0, c("cost") * c("qty_90d")).alias("cp_x_qty"),
        "sp_equals_mrp", c("mrp_gte_sp").alias("mrp_gte_bau"), c("sp_gte_cost").alias("bau_gte_cost"))


def pricing_extract(r: DataFrame) -> DataFrame:
    """The 11-column extract of the price sheet."""
    text = lambda n: (F.col(n) if n in r.columns else F.lit("")).alias(n)
    return r.select("key", "state", "item_code", "display_name", "kvi_tag", text("category"), text("sub_category"),
                    text("leaf_category"), "mrp", F.col("cost").alias("off_invoice_adjusted_cost"), F.col("sp").alias("sp_bau"))


# Cities with their own price column, and markets priced offline (left blank).
OVERRIDE_CITIES = ["ASANSOL", "KOLKATA", "BILASPUR", "JAMSHEDPUR", "HAZARIBAGH", "RANCHI"]
OFFLINE_MARKETS = ["ranchi", "raipur", "bilaspur", "korba", "kolkata_1", "kolkata_2", "market_1", "market_2", "general_trade",
                   "market_3", "market_wb", "asansol_gt", "durgapur_gt"]


def _city_sp(city: str) -> Column:
    return F.coalesce(F.try_element_at("city_sps", F.lit(city)), F.lit(0.0))


def staples_mart(r: DataFrame, platforms: list[str], total: Column | None = None) -> DataFrame:
    """The 57-column sheet of priced staples; ``platforms`` names two columns ``<p>_sp``, ``total`` is as in ``pricing_mart``."""
    c = F.col
    df = demand_weight(guardrails(r), "sale_90d", [], total)
    text = lambda n: (c(n) if n in r.columns else F.lit("")).alias(n)
    online = [_zero(f"{p}_sp") if f"{p}_sp" in r.columns else F.lit(0.0) for p in platforms[:2]]
    current = _positive(_zero("current_sp"))
    return df.select(
        "key", "state", "item_code", "display_name", "kvi_tag", text("segment"), text("category"), text("sub_category"),
        text("leaf_category"), text("brand"), text("marketed_by"), _blank("brand_tagging"), "qty_90d", "sale_90d", "demand_weight",
        "mrp", "latest_inward_cost", "map_price", F.greatest("latest_inward_cost", "map_price").alias("max_cost"), "grn_margin",
        current.alias("current_sp"), current.alias("current_sp_2"), c("sp").alias("final_sp"), "retention_margin", _blank("gap_1"),
        *[_city_sp(x).alias(f"{x.lower()}_sp") for x in OVERRIDE_CITIES],
        _positive(online[0]).alias("online_1_sp"), _positive(online[1]).alias("online_2_sp"),
        _positive(F.greatest(*online)).alias("online_max_sp"), _blank("gap_2"), _blank("changes_1"), _blank("changes_2"),
        *[_blank(f"offline_{m}") for m in OFFLINE_MARKETS],
        "sku_margin", F.when(c("cost") > 0, (c("sp") - c("cost")) / c("cost")).otherwise(0.0).alias("sku_markup"),
        "guardrail", _blank("previous_sku"), F.concat_ws("; ", "remarks").alias("remarks_1"), _blank("remarks_2"), _blank("remarks_3"))


def staples_extract(r: DataFrame) -> DataFrame:
    """The 17-column extract of the staples sheet."""
    cities = ["KOLKATA", "BILASPUR", "JAMSHEDPUR", "HAZARIBAGH", "RANCHI"]
    return r.select("key", "state", "item_code", "display_name", "kvi_tag", "mrp", "latest_inward_cost",
                    _positive(_zero("current_sp")).alias("current_sp"), F.col("cost").alias("off_invoice_adjusted_cost"),
                    F.col("sp").alias("adr_sp"), *[_positive(_city_sp(x)).alias(f"{x.lower()}_sp") for x in cities],
                    "sale_90d", "qty_90d")


def by_state(r: DataFrame, state: str) -> DataFrame:
    """One state's rows; reads one partition of a result written with ``partitionBy("state")``."""
    return r.where(F.upper("state") == state.upper())


def flagged(r: DataFrame) -> DataFrame:
    return r.where(F.size("flags") > 0).select("key", "item_code", "display_name", "kvi_tag", "mrp", "sp",
                                               F.concat_ws("; ", "flags").alias("flag"))

"""Pricing queries. Every input is derived from the order lines and parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelf.operators import pricing as p, reports
from shelf.session import materialize
from workload import adapters as a
from shelf.sources import tables
from workload.base import Tables, query, scratch

STATES = {"S0": "W0", "S1": "W1", "S2": "W2"}
LAST = "QUALIFY row_number() OVER (PARTITION BY key ORDER BY o1 DESC, o2 DESC, o3 DESC) = 1"
V = a.VIEWS
V["pcat"] = ((), """
SELECT p_partkey AS item_code, p_name AS display_name, CASE p_type WHEN 'SMALL' THEN 'STPLS' WHEN 'LARGE' THEN 'GM'
   WHEN 'PROMO' THEN 'FMCG' ELSE 'FMCGF' END AS master_category, p_brand AS brand, floor(p_retailprice * p_size / 50) AS mrp FROM part""")
V["lines"] = ((), """
SELECT 'S' || CAST(l_suppkey % 3 AS VARCHAR) || CAST(l_partkey AS VARCHAR) AS key, 'S' || CAST(l_suppkey % 3 AS VARCHAR) AS state,
  l_partkey AS item_code, l_orderkey AS o1, l_linenumber AS o2, l_suppkey AS o3, l_quantity AS quantity, l_discount AS discount,
  l_tax AS tax, l_returnflag AS flag, p_type AS type, p_brand AS brand, floor(p_retailprice * p_size / 50) AS mrp
FROM lineitem JOIN part ON l_partkey = p_partkey""")
V["in_costs"] = (("lines",), f"""
SELECT key, inward_cost, mrp FROM (
 SELECT key, o1, o2, o3, tax > 0 AS pos, CASE WHEN tax > 0 THEN mrp * (0.35::DOUBLE + 0.08::DOUBLE * o2) ELSE 0 END AS inward_cost,
        CASE WHEN discount < 0.05 THEN 0 ELSE mrp END AS mrp FROM lines)
QUALIFY row_number() OVER (PARTITION BY key ORDER BY pos DESC, CASE WHEN pos THEN o1 ELSE -o1 END DESC,
   CASE WHEN pos THEN o2 ELSE -o2 END DESC, CASE WHEN pos THEN o3 ELSE -o3 END DESC) = 1""")
V["in_wh"] = ((), """SELECT p_partkey AS item_code, 'W' || CAST(p_partkey % 3 AS VARCHAR) AS warehouse,
  floor(p_retailprice * p_size / 50) * (0.1::DOUBLE * (3 + p_partkey % 7)) AS inward_cost FROM part""")
for _kind, _flag in (("off", "A"), ("on", "N")):
    V[f"in_{_kind}"] = (("lines",), f"""SELECT key, discount AS {_kind}_invoice_pct, CASE WHEN o2 % 2 = 0 THEN quantity ELSE 0 END AS {_kind}_invoice_value
FROM lines WHERE flag = '{_flag}' AND discount >= 0.08 {LAST}""")
V["in_tags"] = (("lines",), """SELECT key, CASE WHEN max(quantity) >= 49 THEN 'SUPER KVI' WHEN max(quantity) >= 44 THEN 'KVI' ELSE 'NON KVI' END AS kvi_tag
FROM lines GROUP BY 1""")
V["in_map_key"] = (("lines",), f"SELECT key, mrp * 0.75 AS map_price FROM lines WHERE o2 = 7 AND tax > 0.05 {LAST}")
V["in_bench"] = (("offers",), """
WITH city AS (SELECT pincode, item_code, date AS benchmark_date, max(sp * pack_size / 50) AS benchmark_sp
  FROM offers WHERE in_stock AND category <> 'ECONOMY' GROUP BY 1, 2, 3
  QUALIFY row_number() OVER (PARTITION BY pincode, item_code ORDER BY date DESC) = 1)
SELECT 'S' || CAST(pincode % 3 AS VARCHAR) AS state, item_code, benchmark_date, benchmark_sp FROM city
QUALIFY row_number() OVER (PARTITION BY state, item_code ORDER BY benchmark_sp DESC, benchmark_date DESC) = 1""")
V["in_sales"] = (("lines",), """
WITH x AS (SELECT s.state, item_code, quantity, o2, mrp FROM lines JOIN (VALUES ('S0'), ('S1'), ('S2')) s(state) ON o2 = 1
  UNION ALL SELECT state, item_code, quantity, o2, mrp FROM lines WHERE o2 <> 1)
SELECT state || CAST(item_code AS VARCHAR) AS key, sum(CASE WHEN o2 <= 3 THEN quantity ELSE 0 END) AS qty_30d,
  sum(CASE WHEN o2 <= 3 THEN quantity * mrp ELSE 0 END) AS sale_30d, sum(quantity) AS qty_90d, sum(quantity * mrp) AS sale_90d FROM x GROUP BY 1""")
V["in_guard"] = (("lines",), """
SELECT key, CASE WHEN max(tax) >= 0.08 THEN 'COST_BASED' ELSE 'GKM' END AS sku_type, 0.1::DOUBLE AS guardrail_lower, 0.3::DOUBLE AS guardrail_upper,
  CASE WHEN min(discount) = 0 THEN 0.15::DOUBLE ELSE 0 END AS cost_based_markup, CASE WHEN max(discount) >= 0.1 THEN any_value(brand) ELSE '' END AS category,
  max(mrp) * 0.9 AS current_sp FROM lines WHERE type = 'SMALL' GROUP BY 1""")
V["in_city"] = (("lines",), """
SELECT key, CASE WHEN max(discount) >= 0.1 THEN max(mrp) * 0.8 ELSE 0 END AS adr_sp, CASE WHEN min(tax) = 0 THEN max(mrp) * 0.85 ELSE 0 END AS kolkata_sp,
  CASE WHEN count(*) > 10 THEN max(mrp) * 0.88 ELSE 0 END AS now_sp FROM lines WHERE type = 'SMALL' GROUP BY 1""")
V["in_cats"] = (("lines",), """
WITH x AS (SELECT key, type AS category, 0 AS f, o1, o2, o3 FROM lines WHERE flag = 'A' AND tax > 0.06
  UNION ALL SELECT key, brand, 1, o1, o2, o3 FROM lines WHERE flag = 'N' AND tax > 0.04)
SELECT key, category FROM x QUALIFY row_number() OVER (PARTITION BY key ORDER BY f, o1, o2, o3) = 1""")
V["pbase"] = (("pcat", "in_costs", "in_wh", "in_off", "in_on", "in_tags", "in_map_key", "in_bench", "in_sales", "in_guard", "in_city", "in_cats"), """
SELECT s.state || CAST(c.item_code AS VARCHAR) AS key, s.state, c.item_code, display_name, c.brand,
  CASE master_category WHEN 'FMCG' THEN 'FMCGF' WHEN 'GM' THEN 'FMCGNF' ELSE master_category END AS master_category,
  coalesce(nullif(k.mrp, 0), c.mrp) AS mrp, coalesce(nullif(k.inward_cost, 0), w.inward_cost, 0) AS latest_inward_cost,
  coalesce(nullif(mk.map_price, 0), CASE WHEN pt.p_size % 4 = 0 THEN c.mrp * 0.6 END, 0) AS map_price,
  coalesce(off_invoice_pct, 0) AS off_invoice_pct, coalesce(off_invoice_value, 0) AS off_invoice_value,
  coalesce(on_invoice_pct, 0) AS on_invoice_pct, coalesce(on_invoice_value, 0) AS on_invoice_value,
  coalesce(kvi_tag, 'NON KVI') AS kvi_tag, pt.p_size % 10 = 0 AS is_excluded, CASE WHEN pt.p_size % 10 = 0 THEN pt.p_type END AS exclusion_type,
  coalesce(benchmark_sp, 0) AS benchmark_sp, coalesce(qty_30d, 0) AS qty_30d, coalesce(sale_30d, 0) AS sale_30d,
  coalesce(qty_90d, 0) AS qty_90d, coalesce(sale_90d, 0) AS sale_90d, coalesce(sku_type, 'GKM') AS sku_type,
  coalesce(guardrail_lower, 0) AS guardrail_lower, coalesce(guardrail_upper, 0) AS guardrail_upper,
  coalesce(cost_based_markup, 0) AS cost_based_markup,
  coalesce(nullif(g.category, ''), ct.category, '') AS category, coalesce(nullif(now_sp, 0), g.current_sp, 0) AS current_sp,
  coalesce(adr_sp, 0) AS city_sp_override, coalesce(kolkata_sp, 0) AS kolkata_sp
FROM pcat c JOIN (VALUES ('S0', 'W0'), ('S1', 'W1'), ('S2', 'W2')) s(state, warehouse) ON true
JOIN part pt ON pt.p_partkey = c.item_code
LEFT JOIN in_wh w ON w.item_code = c.item_code AND w.warehouse = s.warehouse
LEFT JOIN in_costs k ON k.key = s.state || c.item_code LEFT JOIN in_off o ON o.key = s.state || c.item_code
LEFT JOIN in_on n ON n.key = s.state || c.item_code LEFT JOIN in_tags t ON t.key = s.state || c.item_code
LEFT JOIN in_map_key mk ON mk.key = s.state || c.item_code LEFT JOIN in_bench b ON b.state = s.state AND b.item_code = c.item_code
LEFT JOIN in_sales sl ON sl.key = s.state || c.item_code LEFT JOIN in_guard g ON g.key = s.state || c.item_code
LEFT JOIN in_city ci ON ci.key = s.state || c.item_code LEFT JOIN in_cats ct ON ct.key = s.state || c.item_code""")
TIER = ("CASE WHEN {0} <= 0.10 THEN 0.0::DOUBLE WHEN {0} <= 0.15 THEN 0.02 WHEN {0} <= 0.20 THEN 0.03 WHEN {0} <= 0.25 THEN 0.05 "
        "WHEN {0} <= 0.30 THEN 0.07 WHEN {0} <= 0.40 THEN 0.10 WHEN {0} <= 0.54 THEN 0.20 ELSE 0.50 END")
V["promo"] = (("pbase",), """
WITH v AS (SELECT *, CASE WHEN off_invoice_value = 0 AND off_invoice_pct > 0 THEN mrp * off_invoice_pct ELSE off_invoice_value END AS off_value,
   CASE WHEN on_invoice_value = 0 AND on_invoice_pct > 0 THEN mrp * on_invoice_pct ELSE on_invoice_value END AS on_value,
   CASE WHEN map_price > 0 THEN map_price ELSE latest_inward_cost END AS cb FROM pbase),
c AS (SELECT *, greatest(off_value, on_value) AS inv, CASE WHEN off_value >= on_value THEN 'off_invoice' ELSE 'on_invoice' END AS src,
   CASE WHEN off_value > 0 THEN cb - off_value ELSE cb END AS cost FROM v)
SELECT *, CASE WHEN mrp > 0 THEN (mrp - cost) / mrp ELSE 0 END AS margin,
   CASE WHEN mrp > 0 AND latest_inward_cost > 0 THEN (mrp - latest_inward_cost) / mrp ELSE 0 END AS grn_margin FROM c""")
V["priced"] = (("promo",), f"""
WITH a AS (SELECT *, CASE WHEN master_category = 'STPLS' AND sku_type = 'COST_BASED' THEN 'cost_plus' WHEN is_excluded THEN 'excluded' ELSE 'rules' END AS br FROM promo),
b AS (SELECT *, br = 'rules' AND on_value > 0 AND margin > 0 AND mrp * margin > 0 AND on_value / (mrp * margin) > 0.80
    AND (CASE WHEN mrp - on_value > 0 THEN (mrp - on_value - cost) / (mrp - on_value) ELSE 0 END) < 0.07 AS danger FROM a),
c AS (SELECT * REPLACE (CASE WHEN danger AND src = 'on_invoice' THEN off_value ELSE inv END AS inv,
    CASE WHEN danger AND src = 'on_invoice' THEN CASE WHEN off_value > 0 THEN 'off_invoice' ELSE 'none' END ELSE src END AS src) FROM b),
d AS (SELECT *, inv > 0 AS has_promo, mrp - inv AS promo_sp, mrp * (1 - {TIER.format('margin')}) AS formula FROM c),
e AS (SELECT *, CASE WHEN br = 'cost_plus' THEN 'STAPLES_COST_BASED'
   WHEN br = 'excluded' THEN CASE WHEN has_promo THEN 'RULE_8_EXCLUDED_WITH_PROMO' ELSE 'RULE_8_EXCLUDED_NO_PROMO' END
   WHEN mrp <= 40 THEN CASE WHEN has_promo THEN 'RULE_1_PROMO' ELSE 'RULE_1_NO_PROMO' END
   WHEN kvi_tag = 'NON KVI' THEN CASE WHEN has_promo THEN 'RULE_2A_NONKVI_PROMO' ELSE 'RULE_2B_NONKVI_FORMULA' END
   WHEN has_promo AND benchmark_sp > 0 THEN 'RULE_3A_KVI_PROMO_BM' WHEN has_promo THEN 'RULE_3B_KVI_PROMO_ONLY'
   WHEN benchmark_sp > 0 THEN 'RULE_3C_KVI_BM_ONLY' ELSE 'RULE_3D_KVI_FORMULA' END AS rule1 FROM d),
f AS (SELECT *, CASE WHEN br = 'cost_plus' THEN CASE WHEN city_sp_override > 0 THEN city_sp_override WHEN cost_based_markup > 0 THEN cost * (1 + cost_based_markup)
      WHEN current_sp <> 0 THEN current_sp ELSE cost * 1.10 END
   WHEN br = 'excluded' THEN greatest(CASE WHEN has_promo THEN promo_sp ELSE mrp END, cost)
   WHEN rule1 = 'RULE_3A_KVI_PROMO_BM' THEN greatest(least(promo_sp, benchmark_sp), cost)
   WHEN rule1 = 'RULE_3C_KVI_BM_ONLY' THEN greatest(benchmark_sp, cost)
   WHEN has_promo THEN promo_sp WHEN rule1 = 'RULE_1_NO_PROMO' THEN mrp ELSE formula END AS sp1 FROM e),
g AS (SELECT *, br = 'rules' AND mrp > 10 AND margin > 0.54 AS high, has_promo AND (mrp - promo_sp) / nullif(mrp, 0) > 0.5 AS deepp FROM f),
h AS (SELECT *, CASE WHEN high AND deepp THEN least(sp1, promo_sp) WHEN high THEN mrp * 0.5 ELSE sp1 END AS sp2,
   CASE WHEN high AND NOT deepp THEN 'RULE_7_HIGH_MARGIN' ELSE rule1 END AS rule_applied FROM g),
i AS (SELECT *, CASE WHEN br = 'rules' AND abs(sp2 - mrp) < 0.01 AND mrp >= 200 THEN mrp * (1 - 0.015::DOUBLE)
   WHEN br = 'rules' AND abs(sp2 - mrp) < 0.01 AND mrp >= 100 THEN mrp * (1 - 0.01::DOUBLE) ELSE sp2 END AS sp3 FROM h),
j AS (SELECT *, CASE WHEN br = 'rules' AND sp3 > mrp THEN mrp ELSE sp3 END AS sp4 FROM i),
k AS (SELECT *, br = 'rules' AND sp4 < cost AND cost > 0 AS under, CASE WHEN br = 'rules' AND sp4 < cost AND cost > 0 THEN cost ELSE sp4 END AS sp5 FROM j),
l AS (SELECT *, CASE WHEN br = 'rules' AND master_category = 'STPLS' AND city_sp_override > 0 THEN city_sp_override ELSE sp5 END AS sp6 FROM k)
SELECT *, inv AS final_invoice_value, src AS promo_source, CASE WHEN sp6 > 0 THEN ceil(sp6) ELSE 0 END AS sp,
  CAST(danger AS INTEGER) + CAST(under AS INTEGER) AS n_flags FROM l""")
METRICS = """CASE WHEN mrp > 0 THEN (mrp - sp) / mrp ELSE 0 END AS discount_pct, CASE WHEN sp > 0 THEN (sp - cost) / sp ELSE 0 END AS retention_margin,
 abs(sp - mrp) < 0.01 AS sp_equals_mrp, mrp >= sp AS mrp_gte_sp, cost <= 0 OR sp >= cost AS sp_gte_cost"""


def catalogue(t: Tables):
    kind = F.col("p_type")
    category = (F.when(kind == "SMALL", "STPLS").when(kind == "LARGE", "GM").when(kind == "PROMO", "FMCG").otherwise("FMCGF"))
    return t.part.select(F.col("p_partkey").alias("item_code"), F.col("p_name").alias("display_name"), category.alias("master_category"),
                         F.col("p_brand").alias("brand"), _mrp().alias("mrp"))


def _mrp():
    return F.floor(F.col("p_retailprice") * F.col("p_size") / 50).cast("double")


def lines(t: Tables):
    """Order lines with their parts. A run merges them once and writes them as the join has dealt them, by part: the many aggregates by key then combine within their reading tasks."""
    if "lines" not in t.__dict__:
        t.__dict__["lines"] = materialize(_joined_lines(t))
    return t.__dict__["lines"]


def _joined_lines(t: Tables):
    c = F.col
    state = F.concat(F.lit("S"), (c("l_suppkey") % 3).cast("string"))
    return t.lineitem.join(t.part.hint("merge"), c("l_partkey") == c("p_partkey")).select(
        F.concat(state, c("l_partkey").cast("string")).alias("key"), state.alias("state"), c("l_partkey").alias("item_code"),
        c("l_orderkey").alias("o1"), c("l_linenumber").alias("o2"), c("l_suppkey").alias("o3"), c("l_quantity").alias("quantity"),
        c("l_discount").alias("discount"), c("l_tax").alias("tax"), c("l_returnflag").alias("flag"), c("p_type").alias("type"),
        c("p_brand").alias("brand"), _mrp().alias("mrp"))


ORDER = ["o1", "o2", "o3"]


def _last(cols, offered):
    """Of the rows of a key the last one that is offered; a key without one has nulls."""
    return F.max_by(F.struct(*cols), F.when(offered, F.struct(*ORDER)))


def key_costs(t: Tables):
    c = F.col
    cost = F.when(c("tax") > 0, c("mrp") * (0.35 + 0.08 * c("o2"))).otherwise(0.0)
    rows = lines(t).select("key", *ORDER, cost.alias("inward_cost"), F.when(c("discount") < 0.05, 0.0).otherwise(c("mrp")).alias("mrp"))
    return p.keyed_costs(rows, ORDER).select("key", "inward_cost", "mrp")


def promo_line(kind: str, flag: str):
    value = F.when(F.col("o2") % 2 == 0, F.col("quantity")).otherwise(0.0).alias(f"{kind}_invoice_value")
    return _last([F.col("discount").alias(f"{kind}_invoice_pct"), value], (F.col("flag") == flag) & (F.col("discount") >= 0.08))


def state_benchmarks(t: Tables):
    # competitors name no price for ECONOMY
    offers = a.offers(t, merged=True).withColumn("sp", F.when(F.col("category") != "ECONOMY", F.col("sp") * F.col("pack_size") / 50))
    dim = a.cities(t).select("pincode", F.concat(F.lit("S"), (F.col("pincode") % 3).cast("string")).alias("state"))
    return p.benchmarks(offers, dim)


def sales(t: Tables):
    c = F.col
    feed = lines(t).withColumn("state", F.when(c("o2") == 1, "").otherwise(c("state")))
    per = p.expand_states(feed.select("item_code", "state", "quantity", "o2", "mrp"), list(STATES))
    recent = c("o2") <= 3
    return per.groupBy(F.concat("state", c("item_code").cast("string")).alias("key")).agg(
        F.sum(F.when(recent, c("quantity")).otherwise(0.0)).alias("qty_30d"),
        F.sum(F.when(recent, c("quantity") * c("mrp")).otherwise(0.0)).alias("sale_30d"),
        F.sum("quantity").alias("qty_90d"), F.sum(c("quantity") * c("mrp")).alias("sale_90d"))


def city_prices():
    """City prices of a key: 0 where the cities set none, as for all but SMALL."""
    c, small = F.col, F.max(F.col("type") == "SMALL")
    return [F.when(small & (F.max("discount") >= 0.1), F.max("mrp") * 0.8).otherwise(0.0).alias("adr_sp"),
            F.when(small & (F.min("tax") == 0), F.max("mrp") * 0.85).otherwise(0.0).alias("kolkata_sp"),
            F.when(small & (F.count(c("key")) > 10), F.max("mrp") * 0.88).otherwise(0.0).alias("now_sp")]


def overrides(table):
    return p.city_overrides(table, {"adr_sp": "ADR", "kolkata_sp": "KOLKATA"}, "now_sp")


def key_facts(t: Tables):
    """What one pass over the lines tells of every key: last promotions and map price, tag, guard and city prices."""
    c = F.col
    # only SMALL is guarded
    small = F.max(c("type") == "SMALL")
    guard = F.struct(
        F.when(small, F.when(F.max("tax") >= 0.08, "COST_BASED").otherwise("GKM")).alias("sku_type"), F.when(small, 0.1).alias("guardrail_lower"),
        F.when(small, 0.3).alias("guardrail_upper"), F.when(small, F.when(F.min("discount") == 0, 0.15).otherwise(0.0)).alias("cost_based_markup"),
        F.when(small & (F.max("discount") >= 0.1), F.max("brand")).otherwise("").alias("category"), F.when(small, F.max("mrp") * 0.9).alias("current_sp"))
    tag = F.when(F.max("quantity") >= 49, "SUPER KVI").when(F.max("quantity") >= 44, "KVI").otherwise("NON KVI")
    return materialize(lines(t).groupBy("key").agg(
        promo_line("off", "A").alias("off"), promo_line("on", "N").alias("on"),
        _last([(c("mrp") * 0.75).alias("map_price")], (c("o2") == 7) & (c("tax") > 0.05)).alias("map"),
        tag.alias("kvi_tag"), guard.alias("guard"), F.struct(*city_prices()).alias("city")))


def categories(t: Tables):
    order = F.struct(*ORDER).alias("ordinal")
    flag = F.col("flag")
    off = lines(t).select("key", F.when((flag == "A") & (F.col("tax") > 0.06), F.col("type")).otherwise("").alias("category"), order)
    on = lines(t).select("key", F.when((flag == "N") & (F.col("tax") > 0.04), F.col("brand")).otherwise("").alias("category"), order)
    return p.first_nonempty([off, on], "key", "category")


def base(t: Tables):
    c = F.col
    part = t.part
    wh = part.select(c("p_partkey").alias("item_code"), F.concat(F.lit("W"), (c("p_partkey") % 3).cast("string")).alias("warehouse"),
                     (_mrp() * (0.1 * (3 + c("p_partkey") % 7))).alias("inward_cost"), F.lit(0.0).alias("mrp"))
    facts = key_facts(t)
    bench = state_benchmarks(t).select(F.concat("state", c("item_code").cast("string")).alias("key"), "benchmark_sp")
    inputs = {
        "costs": key_costs(t), "warehouse_costs": wh, "off_invoice": facts.select("key", "off.*"), "on_invoice": facts.select("key", "on.*"),
        "tags": facts.select("key", "kvi_tag"), "exclusions": part.where("p_size % 10 = 0").select(c("p_partkey").alias("item_code"), c("p_type").alias("exclusion_type")),
        "map_by_key": facts.select("key", "map.*"),
        "map_by_item": part.where("p_size % 4 = 0").select(c("p_partkey").alias("item_code"), (_mrp() * 0.6).alias("map_price")),
        "benchmarks": bench, "sales": sales(t), "guardrails": facts.select("key", "guard.*"),
        "overrides": overrides(facts.select("key", "city.*")), "categories": categories(t)}
    return p.pricing_base(catalogue(t), inputs, STATES)


BASE = ["key", "state", "item_code", "display_name", "brand", "master_category", "mrp", "latest_inward_cost", "map_price", "off_invoice_pct",
        "off_invoice_value", "on_invoice_pct", "on_invoice_value", "kvi_tag", "is_excluded", "exclusion_type", "benchmark_sp", "qty_30d",
        "sale_30d", "qty_90d", "sale_90d", "sku_type", "guardrail_lower", "guardrail_upper", "cost_based_markup", "category", "current_sp",
        "city_sp_override"]


@query(views="pbase", sql=f"SELECT {', '.join(BASE)} FROM pbase")
def pricing_base(t: Tables):
    return base(t).select(*BASE)


@query(views="in_bench", sql="SELECT * FROM in_bench")
def benchmarks(t: Tables):
    return state_benchmarks(t)


@query(views="in_sales", sql="SELECT * FROM in_sales")
def expand_states(t: Tables):
    return sales(t)


@query(views="in_cats", sql="SELECT * FROM in_cats")
def first_nonempty(t: Tables):
    return categories(t)


@query(views="in_city", sql="""SELECT key, 'ADR' AS city, adr_sp AS sp FROM in_city WHERE adr_sp > 0
UNION ALL SELECT key, 'KOLKATA', kolkata_sp FROM in_city WHERE kolkata_sp > 0""")
def city_overrides(t: Tables):
    return p.overrides_long(overrides(lines(t).groupBy("key").agg(*city_prices())))


@query(views="in_costs", sql="SELECT * FROM in_costs")
def keyed_costs(t: Tables):
    return key_costs(t)


@query(views="promo", sql="SELECT key, off_value, on_value, inv AS final_invoice_value, src AS promo_source, cost, margin, grn_margin FROM promo")
def promo_cost(t: Tables):
    return p.promo_cost(base(t)).select("key", "off_value", "on_value", "final_invoice_value", "promo_source", "cost", "margin", "grn_margin")


@query(sql=f"SELECT o_orderkey, m AS margin, {TIER.format('m')} AS discount FROM (SELECT o_orderkey, (o_totalprice % 1000) / 1000 AS m FROM orders)")
def tier_lookup(t: Tables):
    return p.tier_lookup(t.orders.select("o_orderkey", ((F.col("o_totalprice") % 1000) / 1000).alias("margin")), "margin")


RESULT = ["key", "sp", "cost", "margin", "grn_margin", "final_invoice_value", "promo_source", "rule_applied", "discount_pct",
          "retention_margin", "sp_equals_mrp", "mrp_gte_sp", "sp_gte_cost"]


@query(views="priced", sql=f"""SELECT key, sp, cost, margin, grn_margin, final_invoice_value, promo_source, rule_applied, {METRICS}, n_flags FROM priced""")
def recommend_prices(t: Tables):
    return p.recommend_prices(base(t)).select(*RESULT, F.size("flags").alias("n_flags"))


@query(views="priced", sql="""SELECT key, sp, CASE WHEN city_sp_override > 0 THEN 'override' WHEN cost_based_markup > 0 THEN 'markup' ELSE 'current' END AS source
FROM priced WHERE br = 'cost_plus'""")
def cost_plus_staples(t: Tables):
    c = F.col
    source = F.when(c("city_sp_override") > 0, "override").when(c("cost_based_markup") > 0, "markup").otherwise("current")
    return (p.recommend_prices(base(t)).where("rule_applied = 'STAPLES_COST_BASED'").select("key", "sp", source.alias("source")))


@query(views="priced", sql="""
WITH m AS (SELECT key, guardrail_lower, guardrail_upper, CASE WHEN sp > 0 AND cost > 0 THEN (sp - cost) / sp ELSE 0 END AS sku_margin FROM priced)
SELECT key, sku_margin, CASE WHEN guardrail_lower <= 0 AND guardrail_upper <= 0 THEN '' WHEN sku_margin < guardrail_lower THEN 'BELOW'
 WHEN sku_margin > guardrail_upper THEN 'ABOVE' ELSE 'OK' END AS guardrail FROM m""")
def guardrails(t: Tables):
    return p.guardrails(p.recommend_prices(base(t))).select("key", "sku_margin", "guardrail")


def _case(x: str, spec) -> str:
    bounds, rest = spec
    return "CASE " + " ".join(f"WHEN {x} <= {b} THEN '{label}'" for b, label in bounds) + f" ELSE '{rest}' END"


BUCKETS = (f"{_case('mrp', p.MRP_BUCKETS)} AS mrp_bucket, {_case('margin', p.MARGIN_BUCKETS)} AS margin_bucket, "
           f"{_case('discount_pct', p.DISCOUNT_BUCKETS)} AS discount_bucket, {_case('retention_margin', p.RETENTION_BUCKETS)} AS rm_bucket")


@query(views="priced", sql=f"SELECT key, {BUCKETS} FROM (SELECT key, mrp, margin, {METRICS} FROM priced)")
def price_buckets(t: Tables):
    return p.price_buckets(p.recommend_prices(base(t))).select("key", "mrp_bucket", "margin_bucket", "discount_bucket", "rm_bucket")


def _shown(x: str) -> str:
    """A share in percent, half a tenth rounded up."""
    return f"printf('%.1f%%', round({x} * 100, 1))"


PASSED = "'promo passed (' || src || ': ' || CAST(inv AS VARCHAR) || ')'"
# the remarks of products other than staples, in the order of the steps
REMARKS = f"""list_filter([
  CASE WHEN danger AND off_value < on_value THEN 'on-invoice promo removed' END,
  CASE WHEN rule1 = 'RULE_3A_KVI_PROMO_BM' AND least(promo_sp, benchmark_sp) < cost OR rule1 = 'RULE_3C_KVI_BM_ONLY' AND benchmark_sp < cost THEN 'cost floor applied' END,
  CASE WHEN br = 'excluded' THEN 'excluded (' || coalesce(exclusion_type, '') || '), ' || CASE WHEN has_promo THEN {PASSED} ELSE 'no discount' END
   WHEN rule1 = 'RULE_1_NO_PROMO' THEN 'low MRP, no promo'
   WHEN rule1 IN ('RULE_3A_KVI_PROMO_BM', 'RULE_3C_KVI_BM_ONLY') THEN 'benchmark ' || CAST(benchmark_sp AS VARCHAR) || CASE WHEN has_promo THEN ', ' || {PASSED} ELSE '' END
   WHEN has_promo THEN {PASSED} ELSE 'formula: margin ' || {_shown('margin')} || ', discount ' || {_shown(TIER.format('margin'))} END,
  CASE WHEN high AND deepp THEN 'high margin, deeper promo kept' END, CASE WHEN high AND NOT coalesce(deepp, false) THEN 'high margin, half price' END,
  CASE WHEN br = 'rules' AND abs(sp2 - mrp) < 0.01 AND mrp >= 100 THEN 'minimum discount ' || CASE WHEN mrp >= 200 THEN '1.5%' ELSE '1.0%' END END,
  CASE WHEN br = 'rules' AND sp3 > mrp THEN 'clamped to MRP' END, CASE WHEN under THEN 'clamped to cost' END], lambda r: r IS NOT NULL)"""
BLANK = "CAST(NULL AS VARCHAR)"
WEIGHT = "sale_90d / CAST(sum(CAST(sale_90d AS DECIMAL(28,4))) OVER () AS DOUBLE) AS demand_weight"


@query(views="priced", sql=f"""
WITH x AS (SELECT *, {METRICS}, {WEIGHT}, {REMARKS} AS remarks FROM priced WHERE master_category <> 'STPLS')
SELECT key, state, item_code, display_name, kvi_tag, category, '' AS sub_category, '' AS leaf_category, brand, '' AS marketed_by,
 qty_30d, sale_30d, qty_90d, sale_90d, demand_weight, CASE WHEN is_excluded THEN 'yes' ELSE '' END AS exclusions,
 off_invoice_pct, off_invoice_value, on_invoice_pct, on_invoice_value, final_invoice_value,
 CASE WHEN mrp > 0 THEN on_invoice_value / mrp ELSE 0 END AS on_invoice_of_mrp,
 CASE WHEN mrp > 0 AND margin > 0 THEN on_invoice_value / (mrp * margin) ELSE 0 END AS on_invoice_of_margin, mrp, {_case('mrp', p.MRP_BUCKETS)} AS mrp_bucket,
 latest_inward_cost, map_price, cost AS off_invoice_adjusted_cost, grn_margin,
 CASE WHEN mrp > 0 AND map_price > 0 THEN (mrp - map_price) / mrp ELSE 0 END AS map_margin,
 CAST(NULL AS DOUBLE) AS benchmark_platform_mrp, CAST(NULL AS DOUBLE) AS benchmark_platform_sp, CAST(NULL AS BOOLEAN) AS equal_mrp, margin,
 {_case('margin', p.MARGIN_BUCKETS)} AS margin_bucket, {BLANK} AS old_mrp, {BLANK} AS old_sp, {BLANK} AS old_discount_pct, {BLANK} AS assortment_check,
 mrp AS calc_mrp, cost AS calc_cost, map_price AS automated_map, sp AS sp_bau, {BLANK} AS changes,
 {', '.join(f"coalesce(remarks[{i}], '') AS remark_{i}" for i in (5, 4, 3, 2, 1))},
 discount_pct, discount_pct AS bau_discount, {_case('discount_pct', p.DISCOUNT_BUCKETS)} AS discount_bucket, retention_margin AS rm_pct,
 {_case('retention_margin', p.RETENTION_BUCKETS)} AS rm_bucket, CASE WHEN qty_90d > 0 THEN sp * qty_90d END AS sp_x_qty,
 CASE WHEN qty_90d > 0 THEN cost * qty_90d END AS cp_x_qty, sp_equals_mrp, mrp_gte_sp AS mrp_gte_bau, sp_gte_cost AS bau_gte_cost FROM x""")
def pricing_mart(t: Tables):
    total = p.total_sales(sales(t), catalogue(t), STATES, F.col("master_category") != "STPLS")
    return p.pricing_mart(p.recommend_prices(base(t)).where("master_category <> 'STPLS'"), total=total)


@query(views="priced", sql="""SELECT key, state, item_code, display_name, kvi_tag, category, '' AS sub_category, '' AS leaf_category, mrp,
 cost AS off_invoice_adjusted_cost, sp AS sp_bau FROM priced WHERE master_category <> 'STPLS'""")
def pricing_extract(t: Tables):
    return p.pricing_extract(p.recommend_prices(base(t)).where("master_category <> 'STPLS'"))


STAPLES = ["key", "state", "item_code", "demand_weight", "mrp", "max_cost", "grn_margin", "current_sp", "final_sp", "retention_margin",
           "kolkata_sp", "online_1_sp", "sku_margin", "sku_markup", "guardrail"]


@query(views="priced", sql=f"""
WITH x AS (SELECT *, {METRICS}, {WEIGHT}, CASE WHEN sp > 0 AND cost > 0 THEN (sp - cost) / sp ELSE 0 END AS sku_margin FROM priced WHERE master_category = 'STPLS')
SELECT key, state, item_code, demand_weight, mrp, greatest(latest_inward_cost, map_price) AS max_cost, grn_margin,
 CASE WHEN current_sp > 0 THEN current_sp END AS current_sp, sp AS final_sp, retention_margin, kolkata_sp,
 CASE WHEN benchmark_sp > 0 THEN benchmark_sp END AS online_1_sp, sku_margin, CASE WHEN cost > 0 THEN (sp - cost) / cost ELSE 0 END AS sku_markup,
 CASE WHEN guardrail_lower <= 0 AND guardrail_upper <= 0 THEN '' WHEN sku_margin < guardrail_lower THEN 'BELOW' WHEN sku_margin > guardrail_upper THEN 'ABOVE'
   ELSE 'OK' END AS guardrail FROM x""")
def staples_mart(t: Tables):
    total = p.total_sales(sales(t), catalogue(t), STATES, F.col("master_category") == "STPLS")
    return p.staples_mart(p.recommend_prices(base(t)).where("master_category = 'STPLS'"), ["benchmark", "other"], total).select(*STAPLES)


@query(views="priced", sql="""SELECT key, state, item_code, mrp, latest_inward_cost, CASE WHEN current_sp > 0 THEN current_sp END AS current_sp,
 cost AS off_invoice_adjusted_cost, sp AS adr_sp, CASE WHEN kolkata_sp > 0 THEN kolkata_sp END AS kolkata_sp, sale_90d, qty_90d FROM priced WHERE master_category = 'STPLS'""")
def staples_extract(t: Tables):
    cols = ["key", "state", "item_code", "mrp", "latest_inward_cost", "current_sp", "off_invoice_adjusted_cost", "adr_sp", "kolkata_sp",
            "sale_90d", "qty_90d"]
    return p.staples_extract(p.recommend_prices(base(t)).where("master_category = 'STPLS'")).select(*cols)


@query(views="priced", sql="SELECT state, key, item_code, sp, rule_applied FROM priced")
def prices_by_state(t: Tables):
    path = scratch(t, "states")
    tables.write_by_state(p.recommend_prices(base(t)).select("state", "key", "item_code", "sp", "rule_applied"), path)
    return tables.read_table(t.spark, path).select("state", "key", "item_code", "sp", "rule_applied")


@query(views="priced", sql="SELECT key, item_code, display_name, kvi_tag, mrp, sp FROM priced WHERE n_flags > 0")
def flagged_prices(t: Tables):
    return p.flagged(p.recommend_prices(base(t))).drop("flag")


@query(views="priced", sql="""SELECT master_category, count(*) AS total, count(*) FILTER (kvi_tag IN ('KVI', 'SUPER KVI')) AS key_items,
 count(*) FILTER (final_invoice_value > 0) AS with_promo, count(*) FILTER (n_flags > 0) AS flagged FROM priced GROUP BY 1""")
def pricing_summary(t: Tables):
    return reports.pricing_summary(p.recommend_prices(base(t)), ["master_category"])


@query(views="priced", sql="SELECT master_category, rule_applied, count(*) AS n FROM priced GROUP BY 1, 2")
def rule_distribution(t: Tables):
    return reports.rule_distribution(p.recommend_prices(base(t)), ["master_category"])

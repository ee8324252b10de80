"""Comparison, ranking and window queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelf.operators import compare
from workload import adapters as a
from workload.base import Tables, query

P = a.PLATFORMS

CHOSEN = """
WITH chosen AS (SELECT lower(trim(product_name)) AS product_key, pincode, platform, sp, mrp FROM offers
  QUALIFY row_number() OVER (PARTITION BY lower(trim(product_name)), pincode, platform
                             ORDER BY (sp > 0) DESC, o1 DESC, o2 DESC, o3 DESC, item_code DESC) = 1)
"""
ORDER = a.OFFER_ORDER + ["item_code"]


@query(views="offers", sql=CHOSEN + "SELECT product_key, pincode, " + ", ".join(
    f"max(CASE WHEN platform = '{p}' AND sp > 0 THEN sp END) AS {p}_price, "
    f"max(CASE WHEN platform = '{p}' AND mrp > 0 THEN mrp END) AS {p}_mrp" for p in P)
    + " FROM chosen GROUP BY 1, 2")
def price_comparison(t: Tables):
    return compare.price_comparison(a.offers(t), P, ORDER)


@query(views="offers", sql=CHOSEN + """
SELECT product_key, pincode, min(platform) FILTER (sp = low) AS cheapest_platform,
       min(sp) AS cheapest_price, max(sp) AS highest_price, max(sp) - min(sp) AS spread
FROM (SELECT *, min(sp) OVER (PARTITION BY product_key, pincode) AS low FROM chosen WHERE sp > 0)
GROUP BY 1, 2""")
def cheapest_platform(t: Tables):
    return compare.cheapest(a.offers(t), ORDER)


@query(views="offers", sql="""
WITH last AS (SELECT lower(trim(regexp_replace(product_name, '\\s+', ' ', 'g'))) AS product_key, pincode, platform,
                     sp, mrp, in_stock FROM offers
  QUALIFY row_number() OVER (PARTITION BY lower(trim(regexp_replace(product_name, '\\s+', ' ', 'g'))), pincode, platform
                             ORDER BY o1 DESC, o2 DESC, o3 DESC, item_code DESC) = 1)
SELECT *, count(*) OVER (PARTITION BY product_key, pincode) AS n_platforms,
       sp = min(sp) OVER (PARTITION BY product_key, pincode) AS is_lowest
FROM last QUALIFY n_platforms >= 2""")
def multi_platform(t: Tables):
    return compare.multi_platform(a.offers(t), ORDER)


@query(views="offers", sql="""
WITH best AS (SELECT pincode, item_code, min(sp) AS best_price FROM offers WHERE in_stock GROUP BY 1, 2),
named AS (SELECT o.pincode, o.item_code, min(platform) AS best_platform, any_value(best_price) AS best_price
          FROM offers o JOIN best b ON o.item_code = b.item_code AND o.pincode = b.pincode AND o.sp = b.best_price AND in_stock GROUP BY 1, 2),
ref AS (SELECT pincode, p_partkey AS item_code, CASE WHEN p_size % 9 = 0 THEN 0 ELSE p_retailprice * 0.93 END AS ref_sp,
               p_retailprice AS ref_mrp FROM part, (SELECT DISTINCT pincode FROM offers WHERE in_stock)),
d AS (SELECT ref.pincode, ref.item_code, ref_sp, ref_mrp, best_platform, best_price,
             best_price - CASE WHEN ref_sp <> 0 THEN ref_sp ELSE ref_mrp END AS delta
      FROM ref LEFT JOIN named USING (pincode, item_code))
SELECT *, CASE WHEN best_price IS NULL THEN 'missing' WHEN delta < -0.5 THEN 'cheaper'
               WHEN delta > 0.5 THEN 'costlier' ELSE 'same' END AS colour FROM d""")
def delta_vs_reference(t: Tables):
    ref = t.part.select(F.col("p_partkey").alias("item_code"),
                        F.when(F.col("p_size") % 9 == 0, 0.0)
                        .otherwise(F.col("p_retailprice") * 0.93).alias("ref_sp"),
                        F.col("p_retailprice").alias("ref_mrp"))
    return compare.delta_vs_reference(ref, a.offers(t).where("in_stock"))


@query(views="history", sql="""
SELECT item_code, pincode, brand, p0_sp, am_mrp,
       CAST(round(CAST(abs(p0_sp - am_mrp) / am_mrp * 100 AS DECIMAL(28,8)), 1) AS DOUBLE) AS diff_pct
FROM history WHERE p0_sp IS NOT NULL AND am_mrp > 0 AND date = (SELECT max(date) FROM history)
ORDER BY diff_pct DESC, item_code LIMIT 50""")
def top_price_diffs(t: Tables):
    latest = compare.at_latest_date(a.history(t))
    return (compare.top_price_diffs(latest, 50, own="p0_sp", ref="am_mrp")
            .select("item_code", "pincode", "brand", "p0_sp", "am_mrp", "diff_pct"))


@query(views="matches", sql="""
SELECT item_code, max(price_diff_pct) AS price_diff_pct FROM matches WHERE price_diff_pct > 2
GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15""")
def top_mismatches(t: Tables):
    return compare.top_mismatches(a.matches(t))


@query(views="offers", sql="""
WITH sales AS (SELECT category, item_code, CAST(sum(CAST(quantity * unit_price AS DECIMAL(28,4))) AS DOUBLE) AS sale
               FROM offers GROUP BY 1, 2)
SELECT category, item_code, sale, sale / CAST(sum(CAST(sale AS DECIMAL(28,4))) OVER (PARTITION BY category) AS DOUBLE)
       AS demand_weight FROM sales""")
def demand_weight(t: Tables):
    from shelf.functions.numbers import total_of
    sales = a.offers(t).groupBy("category", "item_code").agg(
        total_of(F.col("quantity") * F.col("unit_price")).alias("sale"))
    return compare.demand_weight(sales, "sale", ["category"])


@query(sql="""
WITH w AS (SELECT event_id, user_id, event_type, value, lag(value) OVER v AS previous_price,
                  lag(event_type) OVER v AS previous_status, row_number() OVER v AS rn
           FROM events WINDOW v AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, user_id, event_type, value, previous_price, previous_status,
       rn > 1 AND previous_price IS DISTINCT FROM value AS price_changed,
       rn > 1 AND previous_status IS DISTINCT FROM event_type AS status_changed FROM w""")
def changes(t: Tables):
    return compare.changes(t.events, ["user_id"], ["ts", "event_id"], "value", "event_type").drop("ts", "props")


@query(sql="""
SELECT distinct_products, count(*) AS items
FROM (SELECT l_partkey, count(DISTINCT l_suppkey) AS distinct_products FROM lineitem GROUP BY 1) GROUP BY 1""")
def mapping_stability(t: Tables):
    return compare.mapping_stability(t.lineitem, "l_partkey", "l_suppkey")


@query(sql="""
WITH c AS (SELECT l_partkey AS item_code, l_suppkey AS warehouse, l_discount AS cost, l_orderkey, l_linenumber FROM lineitem),
pos AS (SELECT * FROM c WHERE cost > 0 QUALIFY row_number() OVER (PARTITION BY item_code, warehouse ORDER BY l_orderkey DESC, l_linenumber DESC) = 1),
f AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY item_code, warehouse ORDER BY l_orderkey, l_linenumber) = 1)
SELECT * FROM pos UNION ALL SELECT * FROM f WHERE NOT EXISTS (
  SELECT 1 FROM pos WHERE pos.item_code = f.item_code AND pos.warehouse = f.warehouse)""")
def last_nonzero(t: Tables):
    costs = t.lineitem.select(F.col("l_partkey").alias("item_code"), F.col("l_suppkey").alias("warehouse"),
                              F.col("l_discount").alias("cost"), "l_orderkey", "l_linenumber")
    return compare.last_nonzero(costs, ["item_code", "warehouse"], ["l_orderkey", "l_linenumber"], "cost")

"""Standardisation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelf.functions import geo
from shelf.operators import standardize as s
from workload import adapters as a
from workload.base import Tables, query

MISSING_SQL = "('', 'na', 'nan', 'null', 'none', 'n/a', '#value!')"
STOP_SQL = ("('the','and','of','a','an','with','for','in','on','to','pack','pc','pcs','n','by','free','new')")


def sql_clean(c: str) -> str:
    return f"CASE WHEN lower(trim({c})) NOT IN {MISSING_SQL} THEN trim({c}) END"


def sql_norm(c: str) -> str:
    return (f"trim(regexp_replace(regexp_replace(lower(coalesce({c}, '')), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), "
            "'\\s+', ' ', 'g'))")


def sql_price(c: str) -> str:
    bare = f"trim(regexp_replace(trim(regexp_replace({c}, '₹|Rs\\.|Rs|,', '', 'g')), '[/-]+$', ''))"
    return (f"CASE WHEN lower(trim({c})) NOT IN {MISSING_SQL} AND TRY_CAST({bare} AS DOUBLE) >= 0 "
            f"AND TRY_CAST({bare} AS DOUBLE) < 'inf'::DOUBLE THEN TRY_CAST({bare} AS DOUBLE) END")


@query(views="feed", sql="SELECT item_code, " + ", ".join(
    f"{sql_clean(c)} AS {c}" for c in ("item_name", "brand", "unit", "sp", "partial", "factor", "product_id"))
    + " FROM feed")
def standardize_missing(t: Tables):
    return s.standardize_missing(a.feed(t).select(
        "item_code", "item_name", "brand", "unit", "sp", "partial", "factor", "product_id"))


@query(views="feed", sql=f"SELECT item_code, {sql_price('mrp')} AS mrp, {sql_price('sp')} AS sp FROM feed")
def standardize_prices(t: Tables):
    return s.standardize_prices(a.feed(t).select("item_code", "mrp", "sp"), ["mrp", "sp"])


@query(sql="""SELECT o_orderkey, CASE WHEN o_totalprice > 50000 THEN o_totalprice / 100 ELSE o_totalprice END AS price
FROM orders""")
def repair_minor_unit(t: Tables):
    text = t.orders.select("o_orderkey", F.concat(F.lit("₹ "), F.col("o_totalprice").cast("string")).alias("price"))
    return s.standardize_prices(text, ["price"], minor_unit_repair=True)


@query(sql=f"""SELECT doc_id, {sql_norm('text')} AS text_norm,
list_filter(list_sort(list_distinct(string_split({sql_norm('text')}, ' '))),
  lambda x: length(x) >= 3 AND x NOT IN {STOP_SQL} AND NOT regexp_full_match(x, '\\p{{Nd}}+')) AS text_tokens
FROM documents""")
def tokenize_names(t: Tables):
    return (s.tokenize_names(t.documents.select("doc_id", "text"), "text").drop("text")
            .withColumn("text_tokens", F.array_sort("text_tokens")))


@query(views="refs", sql=f"""
WITH b AS (SELECT item_code, brand, list_aggregate(list_filter(string_split({sql_norm('brand')}, ' '),
   lambda x: x NOT IN ('private','limited','ltd','pvt','company','co','the','and')), 'string_agg', ' ') AS bare FROM refs),
alias AS (SELECT 'brand ' || s_suppkey AS alias, 'house ' || s_name AS brand FROM supplier)
SELECT item_code, b.brand, coalesce(alias.brand, bare) AS brand_canonical FROM b LEFT JOIN alias ON bare = alias.alias""")
def canonicalize_brands(t: Tables):
    aliases = t.supplier.select(F.concat(F.lit("brand "), F.col("s_suppkey")).alias("alias"),
                                F.concat(F.lit("house "), F.col("s_name")).alias("brand"))
    return s.canonicalize_brands(a.refs(t).select("item_code", "brand"), aliases)


PACKS = "g|gm|kg|ml|l|ltr|pc|pcs|piece|pieces|n|unit|units|pack"


@query(views="listings", sql=f"""
WITH m AS (SELECT product_id, unit,
   regexp_extract(lower(unit), '(\\d+\\.?\\d*)\\s*[x×]\\s*(\\d+\\.?\\d*)\\s*({PACKS})', ['n','v','u']) AS multi,
   regexp_extract(lower(unit), '(\\d+\\.?\\d*)\\s*({PACKS})\\b', ['v','u']) AS single FROM listings),
v AS (SELECT product_id, unit,
   CASE WHEN multi.n <> '' THEN TRY_CAST(multi.n AS DOUBLE) * TRY_CAST(multi.v AS DOUBLE) ELSE TRY_CAST(single.v AS DOUBLE) END AS pack_value,
   CASE WHEN multi.n <> '' THEN multi.u WHEN single.u = 'gm' THEN 'g' ELSE nullif(single.u, '') END AS pack_unit FROM m)
SELECT *, CASE WHEN pack_unit = 'kg' THEN pack_value * 1000 ELSE pack_value END AS base_amount,
  CASE WHEN pack_unit = 'kg' THEN 'g' ELSE pack_unit END AS unit_family FROM v""")
def standardize_pack(t: Tables):
    return s.standardize_pack(a.listings(t).select("product_id", "unit"), "unit")


@query(views="feed", sql="""
SELECT item_code, partial, status, CASE WHEN partial IN ('MRP Diff', 'MRP-Diff', 'MRP DIFF') THEN 'MRP Diff' END AS partial_label,
 CASE lower(status) WHEN 'partial match' THEN 'Partial Match' ELSE status END AS status_label FROM feed""")
def canonicalize_labels(t: Tables):
    f = a.feed(t).select("item_code", "partial", "status")
    return s.canonicalize_labels(s.canonicalize_labels(f, "partial"), "status")


_POINTS = ", ".join(f"('{p}', {lat}, {lng})" for p, lat, lng in geo.POSTAL_POINTS)


@query(views="cities", sql=f"""
WITH points(prefix, lat, lng) AS (VALUES {_POINTS}),
c AS (SELECT c_custkey, CAST(100000 + c_custkey * 7919 % 900000 AS VARCHAR) AS pincode, c_nationkey FROM customer)
SELECT c_custkey, c.pincode, city, state, CAST(coalesce(lat, 28.6139) AS DOUBLE) AS lat,
       CAST(coalesce(lng, 77.2090) AS DOUBLE) AS lng
FROM c LEFT JOIN points ON prefix = c.pincode[1:2] LEFT JOIN cities ON cities.pincode = c_nationkey""")
def enrich_geo(t: Tables):
    shops = t.customer.select("c_custkey", (F.lit(100000) + F.col("c_custkey") * 7919 % 900000)
                              .cast("string").alias("pincode"), "c_nationkey")
    located = s.enrich_geo(shops)
    dim = a.cities(t).withColumnRenamed("pincode", "c_nationkey")
    return s.enrich_city(located, dim, "c_nationkey").drop("c_nationkey")


@query(sql="""SELECT o_orderkey, stock, lower(stock) NOT IN ('false', '0', 'no', 'out') AS stock_flag FROM (
SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'Out' WHEN '2-HIGH' THEN 'FALSE' WHEN '3-MEDIUM' THEN 'no'
 ELSE o_orderstatus END AS stock FROM orders)""")
def standardize_stock(t: Tables):
    p = F.col("o_orderpriority")
    stock = (F.when(p == "1-URGENT", "Out").when(p == "2-HIGH", "FALSE").when(p == "3-MEDIUM", "no")
             .otherwise(F.col("o_orderstatus")))
    return s.standardize_stock(t.orders.select("o_orderkey", stock.alias("stock")), "stock")


@query(views="offers", sql="""
SELECT item_code, product_name, brand, platform, pincode, sp, o1, o2, o3 FROM offers
WHERE (contains(lower(product_name), 'red') OR contains(lower(brand), 'red')) AND platform = 'p1'
ORDER BY sp DESC, o1, o2, o3, item_code LIMIT 50 OFFSET 50""")
def browse_page(t: Tables):
    return s.browse(a.offers(t), "Red", {"platform": "p1"}, sort="sp", descending=True, page=2,
                    tie=["o1", "o2", "o3", "item_code"]).select(
        "item_code", "product_name", "brand", "platform", "pincode", "sp", "o1", "o2", "o3")

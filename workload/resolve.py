"""Resolution, classification and quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelf.operators import quality as q, resolve as r
from workload import adapters as a
from workload.base import Tables, query
from workload.matching import diff2
from workload.reports import pct
from workload.standardize import MISSING_SQL, PACKS

BY = ["platform", "pincode"]
P = a.PLATFORMS

# Offers as cards: a catalogue side and an own side with a pack in its title.
a.VIEWS["cards"] = (("offers",), """
SELECT item_code, platform, pincode, o1, o2, o3,
  product_name || CASE WHEN category = 'PROMO' THEN ' Loose' ELSE '' END AS name,
  CASE WHEN status = 'COMPLETE MATCH' THEN 'STPLS' ELSE 'FMCGF' END AS master_category, category AS product_type,
  CASE WHEN pack_size % 5 = 0 THEN 'kg' ELSE 'g' END AS unit,
  CASE WHEN pack_size % 5 = 0 THEN pack_size / 1000 ELSE CAST(pack_size AS DOUBLE) END AS unit_value, mrp,
  product_name || ' ' || CAST(pack_size + o2 % 4 AS VARCHAR) ||
    CASE WHEN tax > 0.06 THEN ' ml' WHEN tax < 0.01 THEN '' ELSE ' gm' END AS own_name,
  CAST(pack_size AS VARCHAR) || ' g' AS own_unit, CASE WHEN discount > 0.05 THEN mrp + 1 ELSE mrp END AS own_mrp,
  CASE WHEN o2 = 7 THEN unit_price WHEN in_stock THEN sp END AS own_price,
  CASE WHEN in_stock THEN 'available' ELSE 'out_of_stock' END AS stock,
  CAST(pack_size + o2 % 4 AS DOUBLE) AS amount, CASE WHEN tax > 0.06 THEN 'ml' WHEN tax < 0.01 THEN NULL ELSE 'g' END AS amount_unit
FROM offers""")


def cards(t: Tables):
    c = F.col
    size = c("pack_size")
    title = F.concat(c("product_name"), F.lit(" "), (size + c("o2") % 4).cast("string"),
                     F.when(c("tax") > 0.06, " ml").when(c("tax") < 0.01, "").otherwise(" gm"))
    return a.offers(t).select(
        "item_code", "platform", "pincode", "o1", "o2", "o3",
        F.concat("product_name", F.when(c("category") == "PROMO", " Loose").otherwise("")).alias("name"),
        F.when(c("status") == "COMPLETE MATCH", "STPLS").otherwise("FMCGF").alias("master_category"),
        c("category").alias("product_type"), F.when(size % 5 == 0, "kg").otherwise("g").alias("unit"),
        F.when(size % 5 == 0, size / 1000).otherwise(size.cast("double")).alias("unit_value"), "mrp",
        title.alias("own_name"), F.concat(size.cast("string"), F.lit(" g")).alias("own_unit"),
        F.when(c("discount") > 0.05, c("mrp") + 1).otherwise(c("mrp")).alias("own_mrp"),
        F.when(c("o2") == 7, c("unit_price")).when(c("in_stock"), c("sp")).alias("own_price"),
        F.when(c("in_stock"), "available").otherwise("out_of_stock").alias("stock"))


RATIO = ("CASE WHEN amount_unit IS NOT NULL THEN amount / (CASE WHEN unit = 'kg' AND amount_unit = 'g' THEN unit_value * 1000 "
         "ELSE unit_value END) END")
GUARDED = f"""g AS (SELECT *, CASE WHEN own_price > mrp * 3 THEN 'price' WHEN own_price IS NOT NULL
   AND NOT ({RATIO} BETWEEN 0.7::DOUBLE AND 1.5::DOUBLE) THEN 'pack' END AS rejected FROM cards)"""


@query(views="feed", sql=f"SELECT item_code, item_name, sp FROM feed WHERE lower(trim(sp)) NOT IN {MISSING_SQL} AND NOT contains(lower(item_name), 'loose')")
def usable(t: Tables):
    return r.usable(a.feed(t)).select("item_code", "item_name", "sp")


@query(views="matches", sql="""SELECT platform, pincode, item_code, stage, score, own_price FROM matches
QUALIFY row_number() OVER (PARTITION BY platform, pincode, item_code ORDER BY score DESC, stage, o1, o2, o3) = 1""")
def best_by_score(t: Tables):
    # what is not returned is not carried through the aggregate
    rows = a.matches(t).select(*BY, "item_code", "stage", "score", "own_price", *a.MATCH_ORDER)
    return r.best_by_score(rows, BY, a.MATCH_ORDER).select(*BY, "item_code", "stage", "score", "own_price")


@query(views="matches", sql="""
WITH items AS (SELECT DISTINCT platform, item_code FROM matches),
b AS (SELECT DISTINCT platform, item_code FROM matches WHERE stage = 1 AND status = 'error'),
k AS (SELECT * FROM matches WHERE stage = 1 AND status = 'ok' QUALIFY row_number() OVER (PARTITION BY platform, item_code ORDER BY o1 DESC, o2 DESC, o3 DESC) = 1),
c AS (SELECT * FROM matches WHERE stage IN (2, 3) QUALIFY row_number() OVER (PARTITION BY platform, item_code ORDER BY stage, o1, o2, o3) = 1),
j AS (SELECT i.*, b.item_code IS NOT NULL AS blocked, k.item_code IS NOT NULL AS has_k, c.item_code IS NOT NULL AS has_c,
   coalesce(k.own_name, c.own_name) AS own_name, coalesce(k.own_unit, c.own_unit) AS own_unit,
   coalesce(k.ref_mrp, c.ref_mrp) AS own_mrp, coalesce(k.own_price, c.own_price) AS own_price,
   CASE WHEN k.item_code IS NOT NULL THEN k.score > 0.5 ELSE c.score > 0.5 END AS in_stock
 FROM items i LEFT JOIN b USING (platform, item_code) LEFT JOIN k USING (platform, item_code) LEFT JOIN c USING (platform, item_code))
SELECT platform, item_code, CASE WHEN blocked THEN 'not_available' WHEN has_k THEN 'key' WHEN has_c THEN 'cascade' END AS source,
 CASE WHEN NOT blocked THEN own_name END AS own_name, CASE WHEN NOT blocked THEN own_unit END AS own_unit,
 CASE WHEN NOT blocked THEN own_mrp END AS own_mrp, CASE WHEN NOT blocked THEN own_price END AS own_price,
 CASE WHEN blocked THEN 'out_of_stock' WHEN has_k OR has_c THEN CASE WHEN in_stock THEN 'available' ELSE 'out_of_stock' END END AS stock FROM j""")
def resolve_prices(t: Tables):
    rows = a.matches(t).select("platform", "item_code", "stage", "own_name", "own_unit", F.col("ref_mrp").alias("own_mrp"),
                               "own_price", (F.col("score") > 0.5).alias("in_stock"),
                               F.when(F.col("status") == "error", "not_available").otherwise(F.col("status")).alias("status"),
                               F.struct(*a.MATCH_ORDER).alias("ordinal"))
    items = rows.select("platform", "item_code").distinct()
    return r.resolve_prices(items, rows.where("stage = 1"), rows.where("stage IN (2, 3)"), ["platform", "item_code"])


CARD_COLUMNS = ["item_code", "platform", "o1", "o2", "o3"]


@query(views="cards", sql=f"""WITH {GUARDED} SELECT item_code, platform, o1, o2, o3, rejected,
 {', '.join(f'CASE WHEN rejected IS NULL THEN {c} END AS {c}' for c in ('own_price', 'own_mrp', 'own_name', 'stock'))} FROM g""")
def guard_offers(t: Tables):
    return r.guard_offers(cards(t)).select(*CARD_COLUMNS, "rejected", "own_price", "own_mrp", "own_name", "stock")


STATUS = f"""CASE WHEN own_price IS NULL THEN 'NA'
 WHEN (contains(lower(name), 'loose') OR contains(lower(name), 'asm')) AND master_category = 'STPLS' THEN
   CASE WHEN amount_unit = 'ml' THEN 'PARTIAL MATCH' ELSE 'SEMI COMPLETE MATCH' END
 WHEN ({RATIO} BETWEEN 0.9::DOUBLE AND 1.1::DOUBLE) AND abs(mrp - own_mrp) < 0.01 THEN 'COMPLETE MATCH' ELSE 'PARTIAL MATCH' END"""


@query(views="cards", sql=f"SELECT item_code, platform, o1, o2, o3, {STATUS} AS match_status FROM cards")
def match_status(t: Tables):
    return r.match_status(cards(t)).select(*CARD_COLUMNS, "match_status")


@query(views="cards", sql="""
WITH x AS (SELECT *, product_type = 'SMALL' AS is_fresh, product_type = 'PROMO' AS private_label,
   amount_unit IS NOT DISTINCT FROM 'g' AS same_family,
   amount IS NOT DISTINCT FROM (CASE WHEN unit = 'kg' THEN unit_value * 1000 ELSE unit_value END) AS same_amount,
   mrp IS NOT DISTINCT FROM own_mrp AS same_mrp FROM cards),
s AS (SELECT *, CASE WHEN stock = 'out_of_stock' THEN 'NA' WHEN private_label THEN 'Semi Complete Match' WHEN is_fresh AND same_family THEN 'Complete Match'
   WHEN same_family AND same_amount AND same_mrp THEN 'Complete Match' ELSE 'Partial Match' END AS feed_status FROM x)
SELECT item_code, platform, o1, o2, o3, feed_status, CASE WHEN feed_status = 'Partial Match' THEN CASE
  WHEN is_fresh AND NOT same_family THEN 'FNV-UOM-Diff' WHEN NOT (same_family AND same_amount) THEN 'NFNV-Product-Weight-Diff'
  WHEN NOT same_mrp THEN 'MRP Diff' END END AS partial_reason FROM s""")
def match_reason(t: Tables):
    from shelf.functions import units
    c = cards(t)
    named = F.when(F.col("stock") != "out_of_stock", F.col("own_name"))
    df = (c.withColumn("is_fresh", F.col("product_type") == "SMALL").withColumn("private_label", F.col("product_type") == "PROMO")
          .withColumn("unit_family", F.lit("g")).withColumn("base_amount", units.base_value(F.col("unit_value"), F.col("unit")))
          .withColumn("own_unit_family", units.listing_unit(F.col("own_name")))
          .withColumn("own_base_amount", F.coalesce(units.listing_value(F.col("own_name")), F.lit(-1.0)))
          .withColumn("own_name", named))
    return r.match_reason(df).select(*CARD_COLUMNS, "feed_status", "partial_reason")


@query(views="cards", sql="""
WITH f AS (SELECT item_code, platform, o1, o2, o3, own_price, mrp, CASE WHEN o2 = 1 THEN NULL ELSE
   (CASE WHEN unit = 'kg' THEN unit_value * 1000 ELSE unit_value END) / (o2 * (CASE WHEN unit = 'kg' THEN round(unit_value * 1000) ELSE unit_value END)) END AS x FROM cards)
SELECT item_code, platform, o1, o2, o3, CAST(round(CAST(x AS DECIMAL(28,8)), 3) AS DOUBLE) AS factor, own_price * x AS normalized_price,
  own_price * x - mrp AS normalized_delta FROM f""")
def pack_factor(t: Tables):
    c = F.col
    grams = F.round(F.when(c("unit") == "kg", c("unit_value") * 1000).otherwise(c("unit_value"))).cast("int").cast("string")
    ref = F.concat(c("unit_value").cast("string"), F.lit(" "), c("unit"))
    own = F.when(c("o2") == 1, F.concat(grams, F.lit(" ml"))).otherwise(
        F.concat(c("o2").cast("string"), F.lit(" x "), grams, F.lit(" g")))
    df = cards(t).withColumn("ref_pack", ref).withColumn("own_pack", own)
    return r.pack_factor(df, "ref_pack", "own_pack").select(*CARD_COLUMNS, "factor", "normalized_price", "normalized_delta")


@query(views="matches", sql="""SELECT platform, item_code, o1, o2, o3, CASE WHEN price_diff_pct <= 5 THEN 'ok' WHEN price_diff_pct <= 10 THEN 'near' ELSE 'far' END AS flag FROM matches""")
def diff_flag(t: Tables):
    return r.diff_flag(a.matches(t)).select("platform", "item_code", "o1", "o2", "o3", "flag")


_PICK = "QUALIFY row_number() OVER (PARTITION BY platform, item_code ORDER BY {0}) = 1"


@query(views="matches", sql=f"""
WITH k AS (SELECT * FROM matches WHERE stage = 1 {_PICK.format('o1, o2, o3')}),
s2 AS (SELECT *, CASE WHEN status = 'ok' THEN 'matched' ELSE status END AS reason FROM matches WHERE stage = 2 {_PICK.format('o1, o2, o3')}),
s3 AS (SELECT *, CASE WHEN status = 'ok' THEN 'matched' ELSE status END AS reason FROM matches WHERE stage = 3 {_PICK.format('o1, o2, o3')}),
c AS (SELECT platform, item_code, string_agg('[' || CAST(CAST(round(CAST(score AS DECIMAL(28,8)), 3) AS DOUBLE) AS VARCHAR) || '] ' || own_name || ' (' || coalesce(own_unit, '-') || ', ' || coalesce(CAST(CAST(round(CAST(own_price AS DECIMAL(28,8)), 2) AS DOUBLE) AS VARCHAR), '-') || ')', '; ' ORDER BY rk) AS txt
  FROM (SELECT *, row_number() OVER (PARTITION BY platform, item_code ORDER BY score DESC, o1, o2, o3) AS rk FROM matches WHERE stage = 4) WHERE rk <= 3 GROUP BY 1, 2),
rows AS (SELECT platform, item_code, 1 AS stage, CASE WHEN status = 'error' THEN 'stage1_error' WHEN status = 'no_price' THEN 'stage1_no_price' ELSE 'stage1_price_diff' END AS reason,
   own_name, own_price, price_diff_pct FROM k WHERE status IN ('error', 'no_price') OR price_diff_pct > 20
 UNION ALL SELECT platform, item_code, 2, CASE WHEN reason <> 'matched' THEN 'stage2_' || reason ELSE 'stage2_weak_score' END, own_name, own_price, NULL
   FROM s2 WHERE (reason <> 'matched' OR score < 0.6) AND (platform, item_code) NOT IN (SELECT (platform, item_code) FROM s3 WHERE reason = 'matched' AND score >= 0.6)
 UNION ALL SELECT platform, item_code, 3, CASE WHEN reason <> 'matched' THEN 'stage3_' || reason ELSE 'stage3_weak_score' END, own_name, own_price, NULL
   FROM s3 WHERE reason <> 'matched' OR score < 0.6)
SELECT rows.*, CASE WHEN stage > 1 THEN coalesce(txt, '') ELSE '' END AS top_candidates FROM rows LEFT JOIN c USING (platform, item_code)""")
def review_queue(t: Tables):
    from pyspark.sql import Window

    from shelf.functions.numbers import round_to
    key = ["platform", "item_code"]
    rows = a.matches(t).withColumn("reason", F.when(F.col("status") == "ok", "matched").otherwise(F.col("status")))

    def stage(n: int):
        kept = ["status", "reason", "score", "own_name", "own_price", "price_diff_pct"]
        return (rows.where(F.col("stage") == n).groupBy(*key)
                .agg(F.min_by(F.struct(*kept), F.struct(*a.MATCH_ORDER)).alias("r")).select(*key, "r.*"))

    w = Window.partitionBy(*key).orderBy(F.desc("score"), *a.MATCH_ORDER)
    candidates = (rows.where("stage = 4").withColumn("rank", F.row_number().over(w)).where("rank <= 3")
                  .select(*key, "rank", round_to(F.col("score"), 3).alias("score"), "own_name", "own_unit", "own_price"))
    return r.review_queue(stage(1).withColumnRenamed("status", "match_status"), stage(2), stage(3), candidates, key)


@query(views="matches", sql=f"""
WITH own AS (SELECT platform, item_code, own_name, own_price, stage FROM matches WHERE status = 'ok' {_PICK.format('stage, o1, o2, o3')}),
j AS (SELECT p_partkey AS item_code, p_retailprice * 0.95 AS ref_sp, platform, own_name, own_price, stage,
  CAST(round(CAST(own_price - p_retailprice * 0.95 AS DECIMAL(28,8)), 2) AS DOUBLE) AS diff FROM part LEFT JOIN own ON item_code = p_partkey),
k AS (SELECT *, CAST(round(CAST(abs(diff) / ref_sp * 100 AS DECIMAL(28,8)), 1) AS DOUBLE) AS diff_pct FROM j)
SELECT *, coalesce(diff_pct <= 5, false) AS within_5, coalesce(diff_pct <= 10, false) AS within_10,
 CASE WHEN diff_pct IS NULL THEN 'missing' WHEN diff_pct <= 5 THEN 'ok' WHEN diff_pct <= 10 THEN 'near' ELSE 'far' END AS flag FROM k""")
def side_by_side(t: Tables):
    kept = F.struct("own_name", "own_price", "stage")
    own = (a.matches(t).where("status = 'ok'").groupBy("platform", "item_code")
           .agg(F.min_by(kept, F.struct("stage", *a.MATCH_ORDER)).alias("r")).select("platform", "item_code", "r.*"))
    ref = t.part.select(F.col("p_partkey").alias("item_code"), (F.col("p_retailprice") * 0.95).alias("ref_sp"))
    return r.side_by_side(ref, own, ["item_code"])


_SHEET = ", ".join(
    ", ".join(f"max(CASE WHEN platform = '{p}' AND rejected IS NULL THEN {src} END) AS {p}_{f}"
              for f, src in (("name", "own_name"), ("unit", "own_unit"), ("mrp", "own_mrp"), ("sp", "own_price"), ("stock", "stock")))
    + f", max(CASE WHEN platform = '{p}' THEN 'http://shop.example/' || item_code END) AS {p}_url"
    + f", coalesce(max(CASE WHEN platform = '{p}' THEN CASE WHEN rejected IS NOT NULL THEN 'NA' ELSE st END END), 'NA') AS {p}_status"
    for p in P)


@query(views="cards cities", sql=f"""
WITH {GUARDED}, s AS (SELECT *, {STATUS} AS st FROM g QUALIFY row_number() OVER (PARTITION BY pincode, platform, item_code ORDER BY o1 DESC, o2 DESC, o3 DESC) = 1)
SELECT cc.pincode, part.p_partkey AS item_code, p_brand AS brand, p_type AS product_type,
  p_name || CASE WHEN p_type = 'PROMO' THEN ' Loose' ELSE '' END AS name, CASE WHEN p_size < 20 THEN 'STPLS' ELSE 'FMCGF' END AS master_category,
  CASE WHEN p_size % 5 = 0 THEN 'kg' ELSE 'g' END AS unit, CASE WHEN p_size % 5 = 0 THEN p_size / 1000 ELSE CAST(p_size AS DOUBLE) END AS unit_value, p_retailprice AS mrp,
  {_SHEET.replace('coalesce(max(CASE', 'coalesce(max(CASE')}
FROM part CROSS JOIN (SELECT DISTINCT pincode FROM cities) cc
LEFT JOIN (SELECT s.* REPLACE ({STATUS.replace("master_category = 'STPLS'", "p2.p_size < 20")} AS st)
           FROM s JOIN part p2 ON item_code = p2.p_partkey) x ON x.item_code = part.p_partkey AND x.pincode = cc.pincode GROUP BY ALL""")
def city_price_table(t: Tables):
    c = F.col
    key = ["pincode", "platform", "item_code"]
    resolved = (cards(t).groupBy(*key)
                .agg(F.max_by(F.struct("own_name", "own_unit", "own_mrp", "own_price", "stock"), F.struct("o1", "o2", "o3")).alias("r"))
                .select(*key, "r.*").withColumn("url", F.concat(F.lit("http://shop.example/"), c("item_code"))))
    size = c("p_size")
    catalogue = t.part.select(
        c("p_partkey").alias("item_code"), c("p_brand").alias("brand"), c("p_type").alias("product_type"),
        F.concat("p_name", F.when(c("p_type") == "PROMO", " Loose").otherwise("")).alias("name"),
        F.when(size < 20, "STPLS").otherwise("FMCGF").alias("master_category"),
        F.when(size % 5 == 0, "kg").otherwise("g").alias("unit"),
        F.when(size % 5 == 0, size / 1000).otherwise(size.cast("double")).alias("unit_value"), c("p_retailprice").alias("mrp"))
    pincodes = [x.pincode for x in a.cities(t).select("pincode").distinct().collect()]  # a small dimension
    return r.city_price_table(catalogue, resolved, P, pincodes)


# --- quality ---------------------------------------------------------------------------------

@query(views="live cities", sql="""
WITH c AS (SELECT pincode, count(*) AS rows, count(p0_sp) AS priced,
   count(*) FILTER (NOT (p0_sp BETWEEN 0 AND 900)) AS bad_p0, count(*) FILTER (NOT (p1_sp BETWEEN 0 AND 900)) AS bad_p1,
   count(*) FILTER (NOT (p2_sp BETWEEN 0 AND 900)) AS bad_p2 FROM live GROUP BY 1),
s AS (SELECT sum(rows) AS rows, sum(priced) AS priced, sum(bad_p0) AS bad_p0, sum(bad_p1) AS bad_p1, sum(bad_p2) AS bad_p2 FROM c)
SELECT 'too_few_rows' AS "check", CAST(pincode AS VARCHAR) AS subject, CAST(coalesce(rows, 0) AS DOUBLE) AS observed
FROM cities LEFT JOIN c USING (pincode) WHERE coalesce(rows, 0) < 100
UNION ALL SELECT 'price_out_of_range', 'p0', CAST(bad_p0 AS DOUBLE) FROM s WHERE bad_p0 > 0
UNION ALL SELECT 'price_out_of_range', 'p1', CAST(bad_p1 AS DOUBLE) FROM s WHERE bad_p1 > 0
UNION ALL SELECT 'price_out_of_range', 'p2', CAST(bad_p2 AS DOUBLE) FROM s WHERE bad_p2 > 0
UNION ALL SELECT 'too_few_prices', 'p0', CAST(priced AS DOUBLE) * 100 / CAST(rows AS DOUBLE) FROM s WHERE CAST(priced AS DOUBLE) * 100 / CAST(rows AS DOUBLE) < 10""")
def validate_snapshot(t: Tables):
    return q.validate_snapshot(a.live(t), a.cities(t), P, max_price=900)


@query(views="latest_offer", sql="""SELECT platform, count(sp) AS checked, count(*) FILTER (sp <= 0) AS zero_or_negative,
 count(*) FILTER (sp > 0 AND sp < 1) AS below_1, count(*) FILTER (sp > 50000) AS above_50000, count(*) FILTER (sp > mrp AND mrp > 0) AS sp_exceeds_mrp
 FROM (SELECT platform, mrp, CASE WHEN tax = 0 THEN 0.0 WHEN tax = 0.01 THEN 0.5 ELSE unit_price END AS sp FROM latest_offer) GROUP BY 1""")
def price_sanity(t: Tables):
    price = F.when(F.col("tax") == 0, 0.0).when(F.col("tax") == 0.01, 0.5).otherwise(F.col("unit_price"))
    wide = (a.offers(t).groupBy("date", "pincode", "item_code").pivot("platform", P)
            .agg(F.max_by(F.struct(price.alias("sp"), "mrp"), a.offer_order())))
    flat = wide.select(*[F.col(f"{p}.{f}").alias(f"{p}_{f}") for p in P for f in ("sp", "mrp")])
    return q.price_sanity(flat, P)


@query(sql="SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicates(t: Tables):
    return q.duplicates(t.lineitem, ["l_orderkey", "l_linenumber"])


@query(views="matches", sql="""SELECT platform, pincode, item_code, list_sort(list_distinct(list(stage))) AS stages FROM matches
GROUP BY 1, 2, 3 HAVING count(DISTINCT stage) > 1""")
def stage_overlap(t: Tables):
    return q.stage_overlap(a.matches(t), BY)


@query(views="offers live", sql=f"""
WITH r AS (SELECT DISTINCT CAST((pincode + CAST(o2 = 7 AS INTEGER)) % 5 AS INTEGER) AS pincode, item_code FROM offers),
o AS (SELECT pincode, item_code, count(*) AS n, count(*) FILTER (p1_sp IS NOT NULL AND p1_status <> 'PARTIAL MATCH' OR p2_sp IS NOT NULL) AS priced FROM live GROUP BY 1, 2),
j AS (SELECT coalesce(r.pincode, o.pincode) AS pincode, r.item_code AS ri, o.item_code AS oi, n, priced FROM r FULL JOIN o ON r.pincode = o.pincode AND r.item_code = o.item_code),
g AS (SELECT pincode, count(ri) AS ref_items, CAST(coalesce(sum(n), 0) AS BIGINT) AS output_rows, CAST(coalesce(sum(priced), 0) AS BIGINT) AS priced,
  count(*) FILTER (oi IS NULL) AS missing, count(*) FILTER (ri IS NULL) AS extra FROM j GROUP BY 1)
SELECT *, {pct('priced', 'output_rows')} AS priced_pct FROM g""")
def completeness(t: Tables):
    # the reference knows the last line of an order in the next city, so items are missing and extra; a partial match has no price
    ref = a.offers(t).withColumn("pincode", ((F.col("pincode") + (F.col("o2") == 7).cast("int")) % 5).cast("int"))
    live = a.live(t).withColumn("p1_sp", F.when(F.col("p1_status") != "PARTIAL MATCH", F.col("p1_sp")))
    return q.completeness(ref, live, ["p1_sp", "p2_sp"], ["pincode"])


@query(views="offers", sql="""SELECT platform, pincode, max(date) AS latest, date_diff('day', max(date), DATE '2001-11-04') AS age_days,
 CASE WHEN max(date) = DATE '2001-11-04' THEN 'current' ELSE 'stale' END AS state FROM offers GROUP BY 1, 2""")
def freshness(t: Tables):
    return q.freshness(a.offers(t), "2001-11-04", BY)


@query(views="matches", sql=f"""
WITH s AS (SELECT *, row_number() OVER (PARTITION BY platform, stage ORDER BY md5(concat_ws(':', '17', o1, o2, o3)), o1, o2, o3) AS rk FROM matches),
w AS (SELECT *, string_split(lower(ref_name), ' ') AS x, string_split(lower(own_name), ' ') AS y FROM s WHERE rk <= 20),
g AS (SELECT platform, stage, count(*) AS sampled, count(*) FILTER (len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) > 0.15
  AND contains(lower(own_name), lower(ref_brand))) AS correct FROM w GROUP BY 1, 2)
SELECT g.*, all_matches, {pct('correct', 'sampled')} AS accuracy_pct
FROM g JOIN (SELECT platform, stage, count(*) AS all_matches FROM matches GROUP BY 1, 2) USING (platform, stage)""")
def sampled_accuracy(t: Tables):
    return q.sampled_accuracy(a.matches(t), 20, 17, ["platform", "stage"], a.MATCH_ORDER)


@query(views="matches", sql="""
SELECT platform, item_code, o1, o2, o3, CASE WHEN regexp_matches(lower(ref_name), 'ring|bolt') AND regexp_matches(lower(own_name), 'economy|promo') THEN 'category'
  WHEN greatest(ref_mrp, own_price) / least(ref_mrp, own_price) > 10 AND score < 0.6 THEN 'price' END AS cause FROM matches WHERE cause IS NOT NULL""")
def egregious(t: Tables):
    return q.egregious(a.matches(t), ["ring", "bolt"], ["economy", "promo"]).select("platform", "item_code", "o1", "o2", "o3", "cause")


@query(views="matches", sql=f"""
WITH x AS (SELECT stage, regexp_extract(ref_unit, '(\\d+\\.?\\d*)\\s*({PACKS})\\b', ['v','u']) AS r, regexp_extract(own_unit, '(\\d+\\.?\\d*)\\s*({PACKS})\\b', ['v','u']) AS o FROM matches)
SELECT stage, CASE WHEN r.u <> o.u THEN 'incompatible_units' WHEN CAST(o.v AS DOUBLE) / CAST(r.v AS DOUBLE) BETWEEN 0.8 AND 1.25 THEN 'survives' ELSE 'ratio_out_of_range' END AS cause,
 count(*) AS n FROM x GROUP BY 1, 2""")
def weight_whatif(t: Tables):
    return q.weight_whatif(a.matches(t), "ref_unit", "own_unit", ["stage"])


@query(views="feed", sql="""
SELECT 'complete_without_id' AS fault, count(*) FILTER (lower(status) = 'complete match' AND product_id = 'NA') AS n FROM feed
UNION ALL SELECT 'label_case', count(*) FILTER (status = 'partial Match') FROM feed
UNION ALL SELECT 'label_spelling', count(*) FILTER (partial IN ('MRP-Diff', 'MRP DIFF')) FROM feed
UNION ALL SELECT 'literal_nan', count(*) FILTER (partial = 'nan') FROM feed
UNION ALL SELECT 'spreadsheet_error', count(*) FILTER (factor = '#VALUE!') FROM feed
UNION ALL SELECT 'complete_without_factor', count(*) FILTER (lower(status) = 'complete match' AND (factor IS NULL OR factor = '#VALUE!')) FROM feed
UNION ALL SELECT 'unit_na', count(*) FILTER (unit = 'NA') FROM feed
UNION ALL SELECT 'url_on_two_items', count(*) FROM (SELECT url FROM feed GROUP BY url HAVING count(DISTINCT item_code) > 1)""")
def feed_quality(t: Tables):
    return q.feed_quality(a.feed(t))


@query(views="history", sql="SELECT date, pincode, item_code, p0_sp FROM history WHERE date >= DATE '2001-11-04' - 700")
def expire(t: Tables):
    return q.expire(a.history(t), "2001-11-04", 700).select("date", "pincode", "item_code", "p0_sp")


@query(views="live", sql=" UNION ALL BY NAME ".join(
    f"SELECT pincode, item_code, '{p}' AS platform, {p}_sp FROM live WHERE {p}_sp IS NOT NULL" for p in P))
def union_cities(t: Tables):
    live = a.live(t)
    parts = [live.where(F.col(f"{p}_sp").isNotNull()).select("pincode", "item_code", F.lit(p).alias("platform"), f"{p}_sp") for p in P]
    return q.union_cities(parts)

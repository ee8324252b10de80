"""Coverage, accuracy and summary queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelf.operators import compare, reports as r
from workload import adapters as a
from workload.base import Tables, query

P = a.PLATFORMS
ORDER = a.MATCH_ORDER
BY = ["platform", "pincode"]


def pct(part: str, whole: str, places: int = 1) -> str:
    return (f"CASE WHEN {whole} > 0 THEN CAST(round(CAST(CAST({part} AS DECIMAL(20,0)) * 100 / "
            f"CAST({whole} AS DECIMAL(20,0)) AS DECIMAL(28,8)), {places}) AS DOUBLE) ELSE 0.0 END")


def mean(c: str, scale: int = 6) -> str:
    return f"CAST(sum(CAST({c} AS DECIMAL(28,{scale}))) AS DOUBLE) / CAST(count({c}) AS DOUBLE)"


def level(p: str) -> str:
    return f"CASE WHEN {p} >= 90 THEN 'green' WHEN {p} >= 70 THEN 'amber' ELSE 'red' END"


# An item is usable on a platform and in a city where it was offered, unless it is sold loose.
USABLE = """
u AS (SELECT DISTINCT platform, pincode, item_code FROM offers WHERE category <> 'PROMO')"""
MATCHED = """
mt AS (SELECT * FROM matches WHERE status = 'ok' AND score >= 0.5)"""


def usable_items(t: Tables):
    return a.offers(t).where("category <> 'PROMO'").select(*BY, "item_code").distinct()


def ok_matches(t: Tables):
    return a.matches(t).where("status = 'ok' AND score >= 0.5")


@query(views="offers matches", sql=f"""WITH {USABLE}, {MATCHED},
d AS (SELECT DISTINCT platform, pincode, item_code, stage FROM mt),
f AS (SELECT d.*, stage = min(stage) OVER (PARTITION BY platform, pincode, item_code) AS is_first FROM d),
s AS (SELECT f.platform, f.pincode, stage, count(*) AS matched,
             count(*) FILTER (is_first AND u.item_code IS NOT NULL) AS new_items
      FROM f LEFT JOIN u USING (platform, pincode, item_code) GROUP BY ALL),
n AS (SELECT platform, pincode, count(*) AS usable FROM u GROUP BY ALL),
c AS (SELECT s.*, usable, CAST(sum(new_items) OVER (PARTITION BY platform, pincode ORDER BY stage) AS BIGINT) AS cumulative
      FROM s JOIN n USING (platform, pincode))
SELECT *, {pct('cumulative', 'usable')} AS coverage_pct FROM c""")
def stage_coverage(t: Tables):
    return r.stage_coverage(ok_matches(t), usable_items(t), BY)


ACCURACY = ", ".join(["count(price_diff_pct) AS compared"]
                     + [f"count(*) FILTER (abs(price_diff_pct) <= {x}) AS within_{x}pct" for x in (2, 5, 10, 20)]
                     + ["count(*) FILTER (abs(price_diff_pct) > 20) AS beyond_20pct"])
RATES = ", ".join(f"{pct(f'within_{x}pct', 'compared')} AS accuracy_{x}pct" for x in (2, 5, 10))


@query(views="matches", sql=f"""SELECT *, {RATES} FROM (SELECT platform, stage, {ACCURACY} FROM matches GROUP BY ALL)""")
def accuracy_buckets(t: Tables):
    return r.accuracy_buckets(a.matches(t), ["platform", "stage"])


FIRST = """first AS (SELECT * FROM mt QUALIFY row_number() OVER (PARTITION BY platform, pincode, item_code
                                                                ORDER BY stage, o1, o2, o3) = 1)"""


@query(views="matches", sql=f"WITH {MATCHED}, {FIRST} SELECT platform, pincode, item_code, stage, own_price, price_diff_pct FROM first")
def first_stage_wins(t: Tables):
    return (r.first_stage_wins(ok_matches(t), BY, ORDER)
            .select(*BY, "item_code", "stage", "own_price", "price_diff_pct"))


_COUNTS = ["matched_all", "matched_usable", "compared", "within_2pct", "within_5pct", "within_10pct",
           "within_20pct", "beyond_20pct"]


@query(views="offers matches", sql=f"""WITH {USABLE}, {MATCHED}, {FIRST},
g AS (SELECT platform, pincode, count(*) AS matched_all, count(u.item_code) AS matched_usable, {ACCURACY}
      FROM first LEFT JOIN u USING (platform, pincode, item_code) GROUP BY ALL),
n AS (SELECT platform, pincode, count(*) AS usable FROM u GROUP BY ALL),
j AS (SELECT platform, pincode, usable, {', '.join(f'coalesce({c}, 0) AS {c}' for c in _COUNTS)}
      FROM n LEFT JOIN g USING (platform, pincode)),
k AS (SELECT *, {RATES}, usable - matched_usable AS unmatched, {pct('matched_usable', 'usable')} AS coverage_pct FROM j)
SELECT *, {level('coverage_pct')} AS coverage_level FROM k""")
def verification_report(t: Tables):
    return r.verification_report(ok_matches(t), usable_items(t), BY, ORDER)


@query(views="matches", sql=f"""WITH {MATCHED}, {FIRST}
SELECT platform, pincode, row_number() OVER (PARTITION BY platform, pincode ORDER BY price_diff_pct DESC, item_code) AS rank,
       item_code, stage, price_diff_pct
FROM first WHERE price_diff_pct > 2 QUALIFY rank <= 15""")
def report_mismatches(t: Tables):
    return r.report_mismatches(ok_matches(t), BY, ORDER)


LATEST = "date = (SELECT max(date) FROM history)"


@query(views="history cities", sql="SELECT *, " + ", ".join(
    f"{pct(f'{p}_priced', 'total_products')} AS {p}_coverage_pct" for p in P)
    + " FROM (SELECT date, city, pincode, count(*) AS total_products, " + ", ".join(
    f"count({p}_sp) AS {p}_priced, count(*) FILTER ({p}_status = 'COMPLETE MATCH') AS {p}_complete, "
    f"count(*) FILTER ({p}_status = 'PARTIAL MATCH') AS {p}_partial" for p in P)
    + f" FROM history JOIN cities USING (pincode) WHERE {LATEST} GROUP BY ALL)")
def coverage_overview(t: Tables):
    named = a.history(t).join(a.cities(t).select("pincode", "city"), "pincode")
    return r.coverage_overview(named, P, ["date", "city", "pincode"])


@query(views="history", sql=f"SELECT p1_status AS status, count(*) AS n FROM history WHERE {LATEST} GROUP BY 1")
def status_distribution(t: Tables):
    return r.status_distribution(a.history(t), "p1")


@query(views="history", sql="SELECT date, " + ", ".join(
    f"{pct(f'count({p}_sp)', 'count(*)')} AS {p}_pct, "
    + pct(f"(count(*) FILTER ({p}_status = 'COMPLETE MATCH'))", "count(*)") + f" AS {p}_complete_pct"
    for p in P) + " FROM history GROUP BY 1")
def coverage_trend(t: Tables):
    return r.coverage_trend(a.history(t), P)


@query(views="live", sql="SELECT brand, count(*) AS total, " + ", ".join(
    f"count({p}_sp) AS {p}, {pct(f'count({p}_sp)', 'count(*)', 0)} AS {p}_pct" for p in P)
    + " FROM (SELECT * REPLACE (DATE '2002-01-01' AS date) FROM live) GROUP BY 1 HAVING count(*) >= 5 ORDER BY 2 DESC, 1 LIMIT 50")
def brand_coverage(t: Tables):
    # the live table is one snapshot: every row carries the date of the run
    return r.brand_coverage(a.live(t).withColumn("date", F.lit("2002-01-01").cast("date")), P)


@query(views="history", sql="SELECT date, pincode, count(*) AS products, " + ", ".join(
    f"count(*) FILTER ({p}_status = 'COMPLETE MATCH') AS {p}_complete, "
    f"count(*) FILTER ({p}_status = 'PARTIAL MATCH') AS {p}_partial, "
    f"count(*) FILTER ({p}_status = 'NA') AS {p}_na" for p in P) + " FROM history GROUP BY 1, 2")
def city_summary(t: Tables):
    return r.city_summary(a.history(t), P)


@query(views="offers matches", sql=f"""WITH {USABLE},
m AS (SELECT DISTINCT platform, pincode, item_code, 1 AS hit FROM matches WHERE score >= 0.7)
SELECT pincode, platform, count(*) AS usable, count(hit) AS matched, {pct('count(hit)', 'count(*)')} AS coverage_pct
FROM u LEFT JOIN m USING (platform, pincode, item_code) GROUP BY ROLLUP (pincode, platform)""")
def coverage_rollup(t: Tables):
    return r.coverage_rollup(usable_items(t), a.matches(t).where("score >= 0.7"))


@query(views="matches", sql="""SELECT CASE WHEN price_diff_pct = 0 THEN 'exact' WHEN price_diff_pct <= 2 THEN '0-2'
 WHEN price_diff_pct <= 5 THEN '2-5' WHEN price_diff_pct <= 10 THEN '5-10' WHEN price_diff_pct <= 20 THEN '10-20'
 ELSE '20+' END AS bucket, count(*) AS n FROM matches GROUP BY 1""")
def diff_histogram(t: Tables):
    return r.diff_histogram(a.matches(t))


def rank_sql(source: str, by: str, value: str, quantiles: dict[str, float]) -> str:
    over = f"PARTITION BY {by}" if by else ""
    group = f"{by}, " if by else ""
    picks = ", ".join(f"max({value}) FILTER (rn = floor({q}::DOUBLE * n)) AS {name}" for name, q in quantiles.items())
    return (f"SELECT {group}{picks} FROM (SELECT *, row_number() OVER ({over} ORDER BY {value}) - 1 AS rn, "
            f"count(*) OVER ({over}) AS n FROM {source}) {'GROUP BY ' + by if by else ''}")


@query(views="matches", sql=f"""WITH ranks AS ({rank_sql('matches', 'platform', 'price_diff_pct',
    {'median': .5, 'p75': .75, 'p90': .9, 'p95': .95, 'p99': .99})})
SELECT platform, count(*) AS n, {mean('price_diff_pct')} AS mean, max(price_diff_pct) AS max,
  any_value(median) AS median, any_value(p75) AS p75, any_value(p90) AS p90, any_value(p95) AS p95, any_value(p99) AS p99
FROM matches JOIN ranks USING (platform) GROUP BY 1""")
def diff_stats(t: Tables):
    return r.diff_stats(a.matches(t), ["platform"])


@query(views="matches", sql="""SELECT CASE WHEN score >= 0.9 THEN '0.9+' WHEN score >= 0.7 THEN '0.7-0.9' ELSE '0.5-0.7' END
 AS bucket, count(*) AS n FROM matches WHERE score >= 0.5 GROUP BY 1""")
def score_buckets(t: Tables):
    return r.score_buckets(a.matches(t))


@query(views="matches", sql="SELECT stage, status, count(*) AS n FROM matches GROUP BY 1, 2")
def reason_counts(t: Tables):
    return r.reason_counts(a.matches(t), ["stage", "status"])


VARIATION = """v AS (SELECT item_code, platform, count(*) AS cities, min(price) AS low, max(price) AS high,
   (max(price) - min(price)) / min(price) * 100 AS variation_pct
 FROM (SELECT item_code, platform, pincode, unit_price AS price FROM offers
       QUALIFY row_number() OVER (PARTITION BY item_code, platform, pincode ORDER BY o1 DESC, o2 DESC, o3 DESC) = 1)
 GROUP BY 1, 2 HAVING count(*) >= 2 AND min(price) > 0)"""


def _variation(t: Tables):
    return r.city_variation(a.offers(t).drop("sp").withColumnRenamed("unit_price", "sp"), a.OFFER_ORDER)


@query(views="offers", sql=f"WITH {VARIATION} SELECT * FROM v WHERE variation_pct > 50")
def city_variation(t: Tables):
    return r.wild_variations(_variation(t))


@query(views="offers", sql=f"""WITH {VARIATION}, ranks AS ({rank_sql('v', 'platform', 'variation_pct', {'median': .5, 'p90': .9})})
SELECT platform, count(*) AS n, count(*) FILTER (variation_pct < 5) AS below_5,
 count(*) FILTER (variation_pct >= 5 AND variation_pct < 20) AS from_5,
 count(*) FILTER (variation_pct >= 20 AND variation_pct < 50) AS from_20, count(*) FILTER (variation_pct >= 50) AS from_50,
 any_value(median) AS median, any_value(p90) AS p90 FROM v JOIN ranks USING (platform) GROUP BY 1""")
def variation_summary(t: Tables):
    return r.variation_summary(_variation(t), ["platform"])


@query(views="offers", sql=f"""
WITH b AS (SELECT item_code, min(CASE WHEN in_stock AND platform <> 'p2' AND pack_size % 7 <> 0 THEN sp END) AS best FROM offers GROUP BY 1),
d AS (SELECT p_brand AS brand, best, best - p_retailprice * 0.93 AS delta FROM part LEFT JOIN b ON item_code = p_partkey),
c AS (SELECT *, CASE WHEN best IS NULL THEN 'missing' WHEN delta < -0.5 THEN 'cheaper' WHEN delta > 0.5 THEN 'costlier' ELSE 'same' END AS colour FROM d),
g AS (SELECT brand, count(*) AS total, count(*) FILTER (colour <> 'missing') AS found, count(*) FILTER (colour = 'cheaper') AS cheaper,
 count(*) FILTER (colour = 'costlier') AS costlier, count(*) FILTER (colour = 'same') AS same, {mean('delta', 4)} AS mean_delta FROM c GROUP BY 1)
SELECT *, {pct('found', 'total')} AS found_pct FROM g""")
def delta_summary(t: Tables):
    ref = t.part.select(F.col("p_partkey").alias("item_code"), (F.col("p_retailprice") * 0.93).alias("ref_sp"),
                        F.col("p_retailprice").alias("ref_mrp"))
    # no price where nothing is in stock, on platform p2, and for some pack sizes on all platforms
    found = a.offers(t).withColumn("sp", F.when(F.col("in_stock") & (F.col("platform") != "p2") & (F.col("pack_size") % 7 != 0), F.col("sp")))
    # one best price of all cities, as in the SQL
    deltas = compare.delta_vs_reference(ref, found, by=())
    return r.delta_summary(deltas.join(t.part.select(F.col("p_partkey").alias("item_code"),
                                                     F.col("p_brand").alias("brand")), "item_code"), ["brand"])


@query(views="offers", sql=f"""
WITH n AS (SELECT count(*) AS total FROM part), names(platform) AS (VALUES ('p0'), ('p1'), ('p2')),
m AS (SELECT platform, count(DISTINCT item_code) AS matched FROM offers GROUP BY 1)
SELECT platform, coalesce(matched, 0) AS matched, total, {pct('coalesce(matched, 0)', 'total')} AS match_pct
FROM names LEFT JOIN m USING (platform), n""")
def platform_match_rates(t: Tables):
    return r.platform_match_rates(a.offers(t), t.part, P)


@query(views="live", sql="SELECT pincode, count(*) AS rows, " + ", ".join(
    f"count(*) FILTER ({p}_sp <> 0) AS {p}_ok" for p in P) + " FROM live GROUP BY 1")
def run_summary(t: Tables):
    return r.run_summary(a.live(t), P)


_EITHER = " OR ".join(f"coalesce({p}_sp, 0) <> 0" for p in P)


@query(views="live cities", sql=f"""
WITH kvi AS (SELECT DISTINCT r_name AS state, p_partkey AS item_code,
                    CASE WHEN p_size % 2 = 0 THEN 'Super KVI' ELSE 'KVI' END AS tag
             FROM part JOIN region ON p_size % 5 = r_regionkey),
j AS (SELECT kvi.state, c.pincode, tag, live.* EXCLUDE (pincode, item_code) FROM kvi JOIN cities c ON c.state = kvi.state
      LEFT JOIN live ON live.pincode = c.pincode AND live.item_code = kvi.item_code),
g AS (SELECT state, pincode, count(*) AS items, count(*) FILTER ({_EITHER}) AS either,
 {', '.join(f"count(*) FILTER (coalesce({p}_sp, 0) <> 0) AS {p}_items" for p in P)},
 count(*) FILTER (tag = 'Super KVI') AS super_items,
 {', '.join(f"count(*) FILTER (tag = 'Super KVI' AND coalesce({p}_sp, 0) <> 0) AS {p}_super" for p in P)}
 FROM j GROUP BY 1, 2)
SELECT *, {pct('either', 'items', 0)} AS either_pct FROM g""")
def key_item_coverage(t: Tables):
    tags = t.part.join(t.region, F.col("p_size") % 5 == F.col("r_regionkey")).select(
        F.col("r_name").alias("state"), F.col("p_partkey").alias("item_code"),
        F.when(F.col("p_size") % 2 == 0, "Super KVI").otherwise("KVI").alias("tag"))
    return r.key_item_coverage(a.live(t), tags, a.cities(t), P)


@query(views="live", sql="SELECT pincode, p0_status, count(*) AS n FROM live WHERE p0_sp IS NOT NULL GROUP BY 1, 2")
def method_mix(t: Tables):
    return r.method_mix(a.live(t), "p0_status", "p0_sp", ["pincode"])


@query(views="offers", sql=f"""
WITH g AS (SELECT cities, count(*) AS items FROM (SELECT item_code, count(DISTINCT pincode) AS cities FROM offers GROUP BY 1) GROUP BY 1)
SELECT *, {pct('items', '(SELECT sum(items) FROM g)', 0)} AS share FROM g""")
def city_overlap(t: Tables):
    return r.city_overlap(a.offers(t))


@query(sql=f"""
WITH g AS (SELECT p_type AS category, count(*) AS active, count(l_partkey) AS tracked
 FROM part LEFT JOIN (SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag <> 'R') ON l_partkey = p_partkey GROUP BY 1)
SELECT *, {pct('tracked', 'active')} AS coverage_pct FROM g""")
def category_coverage(t: Tables):
    catalogue = t.part.select(F.col("p_partkey").alias("item_code"), F.col("p_type").alias("category"))
    feed = t.lineitem.where("l_returnflag <> 'R'").select(F.col("l_partkey").alias("item_code"))
    return r.category_coverage(catalogue, feed)


@query(sql="SELECT p_brand AS brand, count(*) AS items FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def top_brands(t: Tables):
    return r.top_brands(t.part.withColumnRenamed("p_brand", "brand"), 10)


@query(views="matches offers", sql=f"""
WITH n AS (SELECT platform, pincode, count(DISTINCT item_code) AS mapped FROM offers GROUP BY 1, 2),
g AS (SELECT platform, pincode, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'no_price') AS no_price,
 count(*) FILTER (status = 'error') AS errors, count(diff) AS price_compared,
 {', '.join(f'count(*) FILTER (diff <= {x}) AS price_match_{x}pct' for x in (2, 5, 10))}
 FROM (SELECT *, CASE WHEN status = 'ok' THEN price_diff_pct END AS diff FROM matches WHERE stage = 1) GROUP BY 1, 2),
j AS (SELECT *, {pct('ok', 'mapped')} AS coverage_pct,
 {', '.join(f"{pct(f'price_match_{x}pct', 'price_compared')} AS price_match_pct_{x}" for x in (2, 5, 10))} FROM n JOIN g USING (platform, pincode))
SELECT *, {level('coverage_pct')} AS coverage_level FROM j""")
def compare_metrics(t: Tables):
    m = (a.matches(t).where("stage = 1").withColumnRenamed("status", "match_status")
         .withColumn("price_diff_pct", F.when(F.col("match_status") == "ok", F.col("price_diff_pct"))))
    mapped = a.offers(t).select(*BY, "item_code").distinct()
    return r.compare_metrics(m, mapped, BY)

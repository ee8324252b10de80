"""Matching queries. Those scored by a built-in metric have an SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelf.operators import hashes, matching as m
from workload import adapters as a
from workload.base import Tables, query
from workload.standardize import PACKS, STOP_SQL, sql_norm

ORDER = ["product_id"]


def bare_brand(c: str) -> str:
    return (f"list_aggregate(list_filter(string_split({sql_norm(c)}, ' '), lambda x: x NOT IN "
            "('private','limited','ltd','pvt','company','co','the','and')), 'string_agg', ' ')")


def lev(x: str, y: str) -> str:
    return f"(1 - levenshtein({x}, {y}) / greatest(length({x}), length({y})))"


def jac(x: str, y: str) -> str:
    wx, wy = f"string_split({x}, ' ')", f"string_split({y}, ' ')"
    return (f"(len(list_intersect({wx}, {wy})) / len(list_distinct(list_concat({wx}, {wy}))))")


def r3(x: str) -> str:
    return f"CAST(round(CAST({x} AS DECIMAL(28,8)), 3) AS DOUBLE)"


def diff2(own: str, ref: str) -> str:
    return (f"CASE WHEN {own} <> 0 AND {ref} <> 0 THEN "
            f"CAST(round(CAST(abs({own} - {ref}) / {ref} * 100 AS DECIMAL(28,8)), 2) AS DOUBLE) END")


def sig(words: str) -> str:
    return (f"list_filter(list_distinct(string_split({words}, ' ')), lambda x: length(x) >= 3 AND x NOT IN {STOP_SQL} "
            "AND NOT regexp_full_match(x, '\\p{Nd}+'))")


RR = f"""rr AS (SELECT item_code, mrp, sp, barcode, {sql_norm('name')} AS rn, {bare_brand('brand')} AS rb,
  {sql_norm('brand')} AS rbt, {sql_norm('product_type')} AS rt,
  CASE WHEN unit_value <> 0 THEN unit_value * CASE WHEN unit = 'kg' THEN 1000 ELSE 1 END ELSE -1 END AS base FROM refs)"""
CC = f"""pk AS (SELECT *,
   regexp_extract(lower(unit), '(\\d+\\.?\\d*)\\s*[x×]\\s*(\\d+\\.?\\d*)\\s*({PACKS})', ['n','v','u']) AS multi,
   regexp_extract(lower(unit), '(\\d+\\.?\\d*)\\s*({PACKS})\\b', ['v','u']) AS single FROM listings),
cc AS (SELECT product_id, name, brand, unit, price, mrp AS cmrp, barcode AS cbar, {sql_norm('name')} AS cn,
  {bare_brand('brand')} AS cb, {sql_norm('brand')} AS cbt, {sql_norm('category')} AS ct,
  CASE WHEN multi.n <> '' THEN TRY_CAST(multi.n AS DOUBLE) * TRY_CAST(multi.v AS DOUBLE)
       WHEN single.u = 'kg' THEN TRY_CAST(single.v AS DOUBLE) * 1000 ELSE TRY_CAST(single.v AS DOUBLE) END AS cbase,
  CASE WHEN multi.n = '' AND single.u = 'ml' THEN 'ml' ELSE 'g' END AS cfam FROM pk)"""

OWN = ("CASE WHEN reason = 'matched' THEN product_id END AS product_id, CASE WHEN reason = 'matched' THEN name END AS own_name, "
       "CASE WHEN reason = 'matched' THEN brand END AS own_brand, CASE WHEN reason = 'matched' THEN unit END AS own_unit, "
       "CASE WHEN reason = 'matched' THEN price END AS own_price, CASE WHEN reason = 'matched' THEN cmrp END AS own_mrp")


def brand_sql(sim) -> str:
    return f"""WITH {RR}, {CC},
p AS (SELECT rr.*, cc.*, list_has_any(string_split(rt, ' '), list_concat(string_split(ct, ' '), string_split(cn, ' '))) AS t
      FROM rr JOIN cc ON rb = cb),
tf AS (SELECT *, bool_or(t) OVER (PARTITION BY item_code) AS any_t FROM p),
f AS (SELECT * FROM tf WHERE (NOT any_t OR t) AND (base <= 0 OR (cfam = 'g' AND cbase / base BETWEEN 0.9::DOUBLE AND 1.1::DOUBLE))),
s AS (SELECT *, {sim('rn', 'cn')} AS sc FROM f),
k AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY item_code ORDER BY sc DESC,
        CASE WHEN base > 0 THEN abs(1 - cbase / base) ELSE 0 END, product_id) = 1),
j AS (SELECT rr.*, k.* EXCLUDE (item_code, mrp, sp, barcode, rn, rb, rbt, rt, base), rr.rb IN (SELECT cb FROM cc) AS has_brand
      FROM rr LEFT JOIN k USING (item_code)),
d AS (SELECT *, CASE WHEN NOT has_brand THEN 'no_brand' WHEN base > 0 AND sc IS NULL THEN 'no_weight'
   WHEN coalesce(sc, 0) < CASE WHEN base > 0 THEN 0.55 ELSE 0.70 END THEN 'no_name_score'
   WHEN abs(mrp - cmrp) / mrp > 0.15 THEN 'price_mismatch' WHEN barcode <> cbar THEN 'barcode_mismatch' ELSE 'matched' END AS reason FROM j)
SELECT item_code, reason, {r3('coalesce(sc, 0)')} AS score, {OWN},
  CASE WHEN reason = 'matched' THEN {diff2('price', 'sp')} END AS price_diff_pct FROM d"""


def _listings(t: Tables):
    return a.listings(t)


@query(views="refs listings", sql=brand_sql(lev))
def brand_cascade(t: Tables):
    return m.brand_cascade(a.refs(t), _listings(t), ORDER, similarity="levenshtein")


@query(views="refs listings", sql=brand_sql(jac))
def brand_cascade_jaccard(t: Tables):
    return m.brand_cascade(a.refs(t), _listings(t), ORDER, similarity="token_jaccard")


@query()
def brand_cascade_ratcliff(t: Tables):
    return m.brand_cascade(a.refs(t), _listings(t), ORDER)


def type_sql(sim) -> str:
    return f"""WITH {RR}, {CC},
rt2 AS (SELECT *, {sig('rt')} AS tw, {sig('rn')} AS nw, {sig('rbt')} AS bw FROM rr),
ct2 AS (SELECT *, list_concat({sig('ct')}, {sig('cn')}) AS pool, list_distinct(list_concat({sig('cn')}, {sig('cbt')})) AS al FROM cc),
p AS (SELECT r.item_code, r.base, r.mrp, r.rn, c.*,
        list_has_any(nw, al) AS some, list_has_any(bw, al) OR len(list_intersect(nw, al)) >= CASE WHEN len(bw) > 0 THEN 3 ELSE 2 END
          OR (len(nw) = 0 AND len(bw) = 0) AS name_ok,
        cfam = 'g' AND base > 0 AND cbase / base BETWEEN 0.8::DOUBLE AND 1.25::DOUBLE AS weight_ok,
        abs(cmrp - mrp) / mrp * 100 AS md
      FROM rt2 r JOIN ct2 c ON list_has_any(tw, pool)),
e AS (SELECT item_code, bool_or(name_ok) AS e2, bool_or(name_ok AND weight_ok) AS e3,
        bool_or(name_ok AND weight_ok AND md <= 15) AS e4 FROM p GROUP BY 1),
s AS (SELECT *, {sim('rn', 'cn')} AS sc FROM p WHERE name_ok AND weight_ok AND md <= 15),
k AS (SELECT * FROM s WHERE sc > 0 QUALIFY row_number() OVER (PARTITION BY item_code ORDER BY sc DESC, md, abs(1 - cbase / base), product_id) = 1),
d AS (SELECT rr.item_code, rr.sp, k.product_id, k.name, k.brand, k.unit, k.price, k.cmrp, k.sc,
   CASE WHEN e.item_code IS NULL THEN 'no_type_match' WHEN NOT e2 THEN 'no_name_token' WHEN rr.base <= 0 OR NOT e3 THEN 'no_weight'
        WHEN NOT e4 THEN 'mrp_rejected' WHEN coalesce(sc, 0) >= 0.5 THEN 'matched' ELSE 'no_name_score' END AS reason
  FROM rr LEFT JOIN e USING (item_code) LEFT JOIN k USING (item_code))
SELECT item_code, reason, {r3('coalesce(sc, 0)')} AS score, {OWN},
  CASE WHEN reason = 'matched' THEN {diff2('price', 'sp')} END AS price_diff_pct FROM d"""


@query(views="refs listings", sql=type_sql(lev))
def type_cascade(t: Tables):
    return m.type_cascade(a.refs(t), a.listings_of_groups(t), ORDER, similarity="levenshtein")


@query()
def type_cascade_ratcliff(t: Tables):
    return m.type_cascade(a.refs(t), a.listings_of_groups(t), ORDER)


LISTING_UNITS = "g|gm|gms|kg|kgs|ml|mls|l|ltr|ltrs|pc|pcs|piece|pieces|unit|units|n|nos"


def candidate_sql(weighted: bool) -> str:
    rule = """NOT known OR (CASE u.u WHEN 'ml' THEN 'volume' ELSE 'weight' END = 'weight'
     AND unit_value * CASE WHEN rr.unit = 'kg' THEN 1000 ELSE 1 END / (v * CASE WHEN u.u = 'kg' THEN 1000 ELSE 1 END) BETWEEN 0.7::DOUBLE AND 1.5::DOUBLE)"""
    return f"""WITH rr AS (SELECT *, {sql_norm('name')} AS rn, string_split({sql_norm('brand')}, ' ') AS rw FROM refs),
cc AS (SELECT *, {sql_norm('name')} AS cn, string_split({sql_norm('brand')}, ' ') AS cw,
   regexp_extract(lower(unit), '(\\d+\\.?\\d*)\\s*({LISTING_UNITS})\\b', ['v','u']) AS u FROM listings),
q AS (SELECT rr.item_code, rr.sp, rn, rw, cc.product_id, cc.name, cc.brand, cc.unit, cc.price, cc.mrp AS cmrp, cn, cw, u,
        unit_value, rr.unit AS runit, TRY_CAST(u.v AS DOUBLE) AS v, u.v <> '' AND unit_value IS NOT NULL AS known
      FROM rr JOIN cc ON rr.item_code = cc.source_item),
s AS (SELECT *, {lev('rn', 'cn')} AS sc FROM q rr WHERE list_has_any(rw, cw)
      {'AND (' + rule.replace('rr.unit', 'runit') + ')' if weighted else ''}),
k AS (SELECT * FROM s WHERE sc >= {'CASE WHEN known THEN 0.55 ELSE 0.70 END' if weighted else '0.55'}
      QUALIFY row_number() OVER (PARTITION BY item_code ORDER BY sc DESC, product_id) = 1),
d AS (SELECT refs.item_code, refs.sp AS rsp, k.* EXCLUDE (item_code, sp), CASE WHEN sc IS NULL THEN 'no_candidate' ELSE 'matched' END AS reason
      FROM refs LEFT JOIN k USING (item_code))
SELECT item_code, reason, {r3('coalesce(sc, 0)')} AS score, {OWN}, {diff2('price', 'rsp')} AS price_diff_pct FROM d"""


def _searched(t: Tables):
    return _listings(t).withColumnRenamed("source_item", "item_code")


@query(views="refs listings", sql=candidate_sql(True))
def candidate_match(t: Tables):
    return m.candidate_match(a.refs(t), _searched(t), ORDER, similarity="levenshtein")


@query(views="refs listings", sql=candidate_sql(False))
def candidate_match_unweighted(t: Tables):
    return m.candidate_match(a.refs(t), _searched(t), ORDER, similarity="levenshtein", weight=None)


@query()
def candidate_match_ratcliff(t: Tables):
    return m.candidate_match(a.refs(t), _searched(t), ORDER)


def squeeze(c: str) -> str:
    return f"trim(regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g'))"


@query(views="refs listings", sql=f"""
WITH s AS (SELECT r.item_code, r.sp, l.*, greatest({lev(squeeze('r.name'), squeeze('l.name'))},
   {lev(squeeze("r.name || ' ' || r.brand"), squeeze('l.name'))}) AS sc FROM refs r JOIN listings l ON r.item_code = l.source_item),
k AS (SELECT *, mrp AS cmrp FROM s WHERE sc > 0 QUALIFY row_number() OVER (PARTITION BY item_code ORDER BY sc DESC, product_id) = 1),
d AS (SELECT refs.item_code, refs.sp AS rsp, k.* EXCLUDE (item_code, sp),
   CASE WHEN coalesce(sc, 0) >= 0.35 THEN 'matched' ELSE 'no_name_score' END AS reason FROM refs LEFT JOIN k USING (item_code))
SELECT item_code, reason, {r3('coalesce(sc, 0)')} AS score, {OWN},
  CASE WHEN reason = 'matched' THEN {diff2('price', 'rsp')} END AS price_diff_pct FROM d""")
def best_name_match(t: Tables):
    ref = a.refs(t).withColumn("alt_name", F.concat_ws(" ", "name", "brand"))
    return m.best_name_match(ref, _searched(t), ORDER, key="item_code", alt="alt_name", similarity="levenshtein")


@query(views="refs listings", sql=f"""
WITH r AS (SELECT item_code, sp, {squeeze('name')} AS rn FROM refs), l AS (SELECT *, {squeeze('name')} AS cn FROM listings),
names AS (SELECT DISTINCT rn FROM r), best AS (SELECT n.rn, l.*, {lev('n.rn', 'l.cn')} AS sc FROM names n JOIN l
   ON list_has_any(string_split(n.rn, ' '), string_split(l.cn, ' '))),
k AS (SELECT *, mrp AS cmrp FROM best WHERE sc > 0 QUALIFY row_number() OVER (PARTITION BY rn ORDER BY sc DESC, product_id) = 1),
d AS (SELECT r.item_code, r.sp AS rsp, k.* EXCLUDE (rn), CASE WHEN coalesce(sc, 0) >= 0.55 THEN 'matched' ELSE 'no_name_score' END AS reason
   FROM r LEFT JOIN k USING (rn))
SELECT item_code, reason, {r3('coalesce(sc, 0)')} AS score, {OWN},
  CASE WHEN reason = 'matched' THEN {diff2('price', 'rsp')} END AS price_diff_pct FROM d""")
def best_name_lookup(t: Tables):
    return m.best_name_match(a.refs(t), _listings(t), ORDER, similarity="levenshtein", min_score=0.55)


@query(views="refs listings", sql=f"""
WITH r AS (SELECT item_code, sp, {squeeze('name')} AS rn FROM refs), l AS (SELECT *, {squeeze('name')} AS cn FROM listings),
names AS (SELECT DISTINCT rn FROM r), best AS (SELECT n.rn, l.*, {jac('n.rn', 'l.cn')} AS sc FROM names n JOIN l ON {jac('n.rn', 'l.cn')} >= 0.55),
k AS (SELECT *, mrp AS cmrp FROM best QUALIFY row_number() OVER (PARTITION BY rn ORDER BY sc DESC, product_id) = 1),
d AS (SELECT r.item_code, r.sp AS rsp, k.* EXCLUDE (rn), CASE WHEN sc IS NOT NULL THEN 'matched' ELSE 'no_name_score' END AS reason
   FROM r LEFT JOIN k USING (rn))
SELECT item_code, reason, {r3('coalesce(sc, 0)')} AS score, {OWN},
  CASE WHEN reason = 'matched' THEN {diff2('price', 'rsp')} END AS price_diff_pct FROM d""")
def best_name_lookup_words(t: Tables):
    return m.best_name_match(a.refs(t), _listings(t), ORDER, similarity="token_jaccard", min_score=0.55)


@query(views="refs listings", sql=f"""
WITH l AS (SELECT *, CASE WHEN platform = 'p0' THEN CAST(source_item AS VARCHAR) END AS pid,
             {sql_norm("brand || ' ' || name || ' ' || unit")} AS cn FROM listings),
r AS (SELECT item_code, sp, CASE WHEN unit = 'kg' THEN CAST(item_code AS VARCHAR) END AS rid, lower(brand) AS rb,
        {sql_norm("brand || ' ' || name")} AS q FROM refs),
x AS (SELECT r.item_code, r.sp, r.rid, l.* EXCLUDE (pid), 1.0::DOUBLE AS sc FROM r JOIN l ON r.rid = l.pid),
rest AS (SELECT DISTINCT q, rb FROM r WHERE rid IS NULL OR rid NOT IN (SELECT pid FROM l WHERE pid IS NOT NULL)),
lw AS (SELECT *, string_split(cn, ' ') AS cw, list_filter(string_split(cn, ' ')[1:3], lambda w: length(w) >= 3) AS heads FROM l),
rw AS (SELECT *, string_split(q, ' ') AS w, list_filter(string_split(q, ' '), lambda w: length(w) >= 3) AS lng FROM rest),
cnd AS (SELECT rw.q, rw.rb, lw.*, list_has_any(lng, heads) AS near FROM rw JOIN lw ON list_has_any(w, cw)),
nr AS (SELECT *, bool_or(near) OVER (PARTITION BY q, rb) AS any_near FROM cnd),
s AS (SELECT *, {jac('q', 'cn')} AS jc, CASE WHEN rb <> '' AND contains(cn, rb) THEN least(1.0, {jac('q', 'cn')} + 0.1) ELSE {jac('q', 'cn')} END AS sc
      FROM nr WHERE near OR NOT any_near),
k AS (SELECT * FROM s WHERE sc > 0 AND jc >= 0.4 - 1e-12 QUALIFY row_number() OVER (PARTITION BY q, rb ORDER BY sc DESC, product_id) = 1),
fz AS (SELECT r.item_code, r.sp, k.* EXCLUDE (q, rb) FROM r LEFT JOIN k USING (q, rb)
       WHERE rid IS NULL OR rid NOT IN (SELECT pid FROM l WHERE pid IS NOT NULL)),
u AS (SELECT item_code, sp, product_id, name, brand, unit, price, mrp AS cmrp, sc, 'id_exact' AS method, 'matched' AS reason FROM x
  UNION ALL SELECT item_code, sp, product_id, name, brand, unit, price, mrp, sc, CASE WHEN sc >= 0.5 THEN 'fuzzy' END,
    CASE WHEN sc >= 0.5 THEN 'matched' ELSE 'not_found' END FROM fz)
SELECT item_code, method, reason, {r3('coalesce(sc, 0)')} AS score, {OWN.replace("THEN product_id END", "THEN CASE WHEN product_id % 3 = 0 THEN CAST(product_id // 3 AS VARCHAR) END END")},
  CASE WHEN reason = 'matched' THEN {diff2('price', 'sp')} END AS price_diff_pct FROM u""")
def id_then_fuzzy(t: Tables):
    # only one platform exposes product ids, and only some reference items carry one
    cand = (_listings(t).withColumn("seq", F.col("product_id"))
            .withColumn("product_id", F.when(F.col("platform") == "p0", F.col("source_item").cast("string"))))
    ref = a.refs(t).withColumn("ref_product_id", F.when(F.col("unit") == "kg", F.col("item_code").cast("string")))
    return m.id_then_fuzzy(ref, cand, ["seq"], similarity="token_jaccard")


@query(views="refs listings", sql=f"""
WITH r AS (SELECT item_code, {sql_norm('brand')} AS rb, trim({sql_norm('brand')} || ' ' || {sql_norm('name')}) AS q FROM refs),
l AS (SELECT *, trim({sql_norm('brand')} || ' ' || {sql_norm('name')}) AS cn FROM listings),
s AS (SELECT q.*, l.*, CASE WHEN contains(cn, rb) THEN least(1.0, {jac('q', 'cn')} + 0.1) ELSE {jac('q', 'cn')} END AS sc
  FROM (SELECT DISTINCT q, rb FROM r) q JOIN l ON {jac('q', 'cn')} > 0),
k AS (SELECT *, row_number() OVER (PARTITION BY q, rb ORDER BY sc DESC, product_id) AS rank FROM s QUALIFY rank <= 3)
SELECT item_code, rank, {r3('sc')} AS score, product_id, name AS own_name, brand AS own_brand, unit AS own_unit, price AS own_price, mrp AS own_mrp
FROM r JOIN k USING (q, rb)""")
def top_candidates(t: Tables):
    return m.top_candidates(a.refs(t), _listings(t), 3, ORDER, similarity="token_jaccard")


KEYED = ["platform", "pincode", "item_code"]


@query(views="matches", sql=f"""
WITH o AS (SELECT platform, pincode, item_code, status, own_price, ref_mrp FROM matches
   QUALIFY row_number() OVER (PARTITION BY platform, pincode, item_code ORDER BY o1 DESC, o2 DESC, o3 DESC) = 1),
j AS (SELECT o.*, CASE WHEN p_size % 13 = 0 THEN 0 ELSE p_retailprice * 0.96 END AS ref_sp FROM o JOIN part ON item_code = p_partkey)
SELECT platform, pincode, item_code, own_price, ref_sp, status AS match_status,
  CASE WHEN status = 'ok' THEN {diff2('own_price', 'ref_sp')} END AS price_diff_pct FROM j""")
def key_match(t: Tables):
    fetched = (a.matches(t).groupBy(*KEYED)
               .agg(F.max_by(F.struct("status", "own_price"), F.struct(*a.MATCH_ORDER)).alias("r"))
               .select(*KEYED, "r.*"))
    ref = t.part.select(F.col("p_partkey").alias("item_code"), F.when(F.col("p_size") % 13 == 0, 0.0)
                        .otherwise(F.col("p_retailprice") * 0.96).alias("ref_sp"))
    return m.key_match(fetched, ref, ["item_code"])


@query(views="refs listings", sql="""
WITH mine AS (SELECT code, max(item_code) AS item_code FROM (
    SELECT item_code, unnest([CASE WHEN unit = 'kg' THEN barcode ELSE '12' END, CAST(8900000000 + item_code + 1 AS VARCHAR)]) AS code FROM refs)
  WHERE regexp_full_match(code, '[0-9]{8,}') GROUP BY 1),
theirs AS (SELECT * FROM listings QUALIFY row_number() OVER (PARTITION BY barcode ORDER BY product_id DESC) = 1)
SELECT item_code, code AS barcode, product_id, name AS own_name, brand AS own_brand, unit AS own_unit, price AS own_price, mrp AS own_mrp
FROM mine JOIN theirs ON code = theirs.barcode""")
def barcode_match(t: Tables):
    other = (F.lit(8900000000) + F.col("item_code") + 1).cast("string")
    ref = (a.refs(t).withColumn("bar_code", F.when(F.col("unit") == "kg", F.col("barcode")).otherwise("12"))
           .withColumn("bar_codes", F.to_json(F.array(other))))
    return m.barcode_match(ref, _listings(t), ORDER, ["item_code"])


@query(views="refs", sql="""SELECT item_code, barcode FROM (SELECT item_code, CASE WHEN unit_value < 10 THEN CAST(item_code AS VARCHAR)
 WHEN unit = 'kg' THEN barcode ELSE 'x' || barcode END AS barcode FROM refs) WHERE regexp_full_match(barcode, '[0-9]{8,}')""")
def barcode_map(t: Tables):
    c = F.col
    code = (F.when(c("unit_value") < 10, c("item_code").cast("string")).when(c("unit") == "kg", c("barcode"))
            .otherwise(F.concat(F.lit("x"), c("barcode"))))
    return m.barcode_map(a.refs(t).withColumn("bar_code", code))


@query(views="refs listings", sql="""SELECT item_code, product_id, own_barcode, coalesce(barcode <> own_barcode, false) AS vetoed FROM (
 SELECT source_item AS item_code, product_id, barcode AS own_barcode FROM listings) l LEFT JOIN refs USING (item_code)""")
def barcode_veto(t: Tables):
    proposed = _listings(t).select(F.col("source_item").alias("item_code"), "product_id", F.col("barcode").alias("own_barcode"))
    return m.barcode_veto(proposed, a.refs(t))


@query(sql="""
WITH h AS (SELECT vec_id, list_reduce(list_transform(embedding, lambda x, i: CASE WHEN x > 0 THEN 1::UBIGINT << (i - 1) ELSE 0::UBIGINT END),
            lambda x, y: x | y) AS h FROM embeddings),
i AS (SELECT vec_id, xor(h, (1::UBIGINT << (vec_id % 15)) - 1) AS h FROM h)
SELECT a.vec_id AS item_code, b.vec_id AS product_id, bit_count(xor(a.h, b.h)) AS distance
FROM i a JOIN h b ON a.vec_id + 1 <> b.vec_id AND bit_count(xor(a.h, b.h)) <= 12
QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY bit_count(xor(a.h, b.h)), b.vec_id) = 1""")
def hash_match(t: Tables):
    hashed = t.embeddings.select(F.col("vec_id").alias("product_id"), hashes.sign_hash(F.col("embedding")).alias("hash"))
    # items see each picture with up to 14 bits changed, and know the next product as their own
    seen = hashed.select(F.col("product_id").alias("item_code"), (F.col("product_id") + 1).alias("product_id"),
                         F.col("hash").bitwiseXOR(F.expr("shiftleft(1L, cast(product_id % 15 as int)) - 1")).alias("hash"))
    return hashes.hash_match(seen, hashed, ["product_id"])


@query(views="refs matches", sql="""SELECT item_code, name FROM refs WHERE item_code NOT IN (
 SELECT item_code FROM matches WHERE stage = 1 AND score >= 0.9 UNION SELECT item_code FROM matches WHERE stage = 2 AND score >= 0.9)""")
def residual(t: Tables):
    strong = a.matches(t).where("score >= 0.9")
    return m.residual(a.refs(t), [strong.where("stage = 1"), strong.where("stage = 2")], ["item_code"]).select("item_code", "name")


@query(views="refs matches", sql="""
WITH s2 AS (SELECT item_code, max(score) AS score FROM matches WHERE stage = 2 GROUP BY 1)
SELECT item_code, name FROM refs WHERE item_code IN (SELECT item_code FROM s2 WHERE score < 0.95)
 AND item_code NOT IN (SELECT item_code FROM matches WHERE stage = 1 AND score >= 0.9)""")
def retry_set(t: Tables):
    stage2 = (a.matches(t).where("stage = 2").groupBy("item_code").agg(F.max("score").alias("score"))
              .withColumn("reason", F.when(F.col("score") >= 0.7, "matched").otherwise("no_name_score")))
    mapped = a.matches(t).where("stage = 1 AND score >= 0.9")
    return m.retry_set(a.refs(t), stage2, ["item_code"], weak=0.95, mapped=mapped).select("item_code", "name")


@query(views="matches", sql="""
SELECT platform, item_code, own_product_id AS product_id, score AS confidence, CASE stage WHEN 1 THEN 'feed' WHEN 2 THEN 'brand' ELSE 'type' END AS method
FROM matches WHERE stage <= 3 QUALIFY row_number() OVER (PARTITION BY platform, item_code ORDER BY stage, o1, o2, o3) = 1""")
def build_mapping(t: Tables):
    rows = a.matches(t).select("platform", "item_code", F.col("own_product_id").alias("product_id"),
                               F.col("score").alias("confidence"), F.struct(*a.MATCH_ORDER).alias("at"), "stage")
    sources = [(name, rows.where(F.col("stage") == i)) for i, name in ((1, "feed"), (2, "brand"), (3, "type"))]
    return m.build_mapping(sources, ["platform"])


_REGISTRY_SQL = """SELECT platform, item_code, own_product_id AS product_id, own_name AS url FROM matches WHERE stage = {0}
 QUALIFY row_number() OVER (PARTITION BY platform, item_code ORDER BY o1 DESC, o2 DESC, o3 DESC) = 1"""


@query(views="matches", sql=f"""
WITH b AS ({_REGISTRY_SQL.format(2)}), n AS ({_REGISTRY_SQL.format(3)})
SELECT coalesce(b.platform, n.platform) AS platform, coalesce(b.item_code, n.item_code) AS item_code,
 CASE WHEN n.url IS NOT NULL AND n.url IS DISTINCT FROM b.url THEN n.product_id ELSE b.product_id END AS product_id,
 coalesce(n.url, b.url) AS url,
 CASE WHEN b.url IS NULL THEN 'added' WHEN n.url IS NOT NULL AND n.url <> b.url THEN 'changed' ELSE 'kept' END AS action
FROM b FULL JOIN n ON b.platform = n.platform AND b.item_code = n.item_code""")
def merge_registry(t: Tables):
    def entries(stage: int):
        return (a.matches(t).where(F.col("stage") == stage).groupBy("platform", "item_code")
                .agg(F.max_by(F.struct(F.col("own_product_id").alias("product_id"), F.col("own_name").alias("url")),
                              F.struct(*a.MATCH_ORDER)).alias("r")).select("platform", "item_code", "r.*"))
    return m.merge_registry(entries(2), entries(3), ["platform", "item_code"], "url")


@query(views="feed offers", sql="""
WITH mapping AS (SELECT CAST(item_code AS VARCHAR) AS item_code, max(item_code * 3) AS product_id FROM offers WHERE discount > 0.09 GROUP BY 1)
SELECT item_code, CAST(product_id AS VARCHAR) AS product_id, 'http://map.example/' || item_code AS product_url, 'mapping' AS source FROM mapping
UNION ALL SELECT item_code, product_id, url, 'reference' FROM feed WHERE product_id <> 'NA' AND partial <> 'nan'
 AND item_code NOT IN (SELECT item_code FROM mapping)""")
def fetch_list(t: Tables):
    code = F.col("item_code").cast("string")
    mapping = (a.offers(t).where("discount > 0.09D").groupBy(code.alias("item_code"))
               .agg(F.max(F.col("item_code") * 3).cast("string").alias("product_id"))
               .withColumn("product_url", F.concat(F.lit("http://map.example/"), F.col("item_code"))))
    ref = a.feed(t).select("item_code", "product_id", F.col("url").alias("product_url"),
                           F.when(F.col("partial") == "nan", "out_of_stock").otherwise("available").alias("stock"))
    return m.fetch_list(mapping, ref, ["item_code"])

"""Entity-resolution joins between reference items and platform listings.

Column names expected of every input:

* reference: ``item_code, name, brand, product_type, unit, unit_value, mrp, sp, barcode``
* listings: ``product_id, name, brand, category, unit, price, mrp, barcode`` and the columns
  named by ``order``, which give the input order (first wins on ties)

``by`` names columns both sides must agree on, such as platform and pincode. Copies are
collapsed before any pair is formed: rows that agree in everything a matcher looks at
become one profile, matched once. Pairs are scored and reduced to the best one per
reference profile inside the joining task, so they are never shuffled. The two cascades
write their profiles to the checkpoint folder, because several joins read them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelf.functions import text, units
from shelf.functions.numbers import diff_pct, nonzero, round_to
from shelf.functions.similarity import similarity as name_similarity, words_jaccard
from shelf.operators.blocking import cell, grid_width, is_first_shared, probes, salted_join
from shelf.session import materialize

PAYLOAD = ["product_id", "name", "brand", "unit", "price", "mrp", "barcode"]
OWN_COLUMNS = {"product_id": "product_id", "name": "own_name", "brand": "own_brand",
               "unit": "own_unit", "price": "own_price", "mrp": "own_mrp"}


def _arrival(order: list[str]) -> Column:
    return F.struct(*[F.col(c) for c in order])


def _text(c: str) -> Column:
    return F.coalesce(text.clean_text(F.col(c)), F.lit(""))


def _payload() -> Column:
    return F.struct(*PAYLOAD)


def _canonical(df: DataFrame, brand: Column) -> DataFrame:
    return (df.withColumn("_bare", text.canonical_brand(brand))
            .withColumn("_brand", text.lookup(text.BRAND_ALIASES, F.col("_bare"))).drop("_bare"))


def _weighed(df: DataFrame, unit: Column, amount: Column, prefix: str) -> DataFrame:
    """``<prefix>base`` and ``<prefix>family``; -1 and "" when the pack size is unknown.

    Built in steps, so that each expression is evaluated once.
    """
    known = F.col("_amount").isNotNull() & (F.col("_unit") != "")
    return (df.withColumn("_written", F.coalesce(unit, F.lit(""))).withColumn("_amount", nonzero(amount))
            .withColumn("_unit", units.unit_alias(F.col("_written")))
            .withColumn(f"{prefix}base", F.when(known, units.base_value(F.col("_amount"), F.col("_unit"))).otherwise(-1.0))
            .withColumn(f"{prefix}family", F.when(known, units.family(F.col("_unit"))).otherwise(""))
            .drop("_written", "_amount", "_unit"))


def _reference(ref: DataFrame) -> DataFrame:
    """Derived columns of the reference side; amounts are -1 when unknown, so keys are never null."""
    named = (ref.withColumn("_name", text.normalize_name(_text("name")))
             .withColumn("_brand_text", text.normalize_name(_text("brand")))
             .withColumn("_type", text.normalize_name(_text("product_type"))))
    return _weighed(_canonical(named, _text("brand")), text.normalize_name(_text("unit")), F.col("unit_value"), "_")


def _listings(cand: DataFrame) -> DataFrame:
    named = (cand.withColumn("_pack", units.pack(F.coalesce("unit", F.lit(""))))
             .withColumn("c_name", text.normalize_name(F.col("name")))
             .withColumn("c_brand_text", text.normalize_name(F.col("brand")))
             .withColumn("c_category", text.normalize_name(F.col("category"))))
    return _weighed(_canonical(named, F.col("brand")), F.col("_pack.unit"), F.col("_pack.value"), "c_").drop("_pack")


def _collapse(cand: DataFrame, profile: list[str], order: list[str]) -> DataFrame:
    """One row per listing profile: the first listing that has it."""
    return cand.groupBy(*profile).agg(F.min_by(_payload(), _arrival(order)).alias("own"),
                                      F.min(_arrival(order)).alias("c_order"))


def _best(pairs: DataFrame, profile: list[str], rank: list[Column]) -> DataFrame:
    """The best-scored listing per reference profile, ties broken by ``rank``; score 0 never wins."""
    eligible = (F.col("c_name") != "") & (F.col("score") > 0)
    at = F.when(eligible, F.struct((-F.col("score")).alias("s"), *[r.alias(f"r{i}") for i, r in enumerate(rank)]))
    return pairs.groupBy(*profile).agg(F.min_by(F.struct("own", "score"), at).alias("best"))


def _own_columns(matched: Column) -> list[Column]:
    return [F.when(matched, F.col(f"best.own.{field}")).alias(name) for field, name in OWN_COLUMNS.items()]


def _stage_output(df: DataFrame, by: list[str], matched: Column, reason: Column, ref_price: Column,
                  extra: list[str] | None = None) -> DataFrame:
    own_price = F.when(matched, F.col("best.own.price"))
    return df.select(*by, "item_code", *(extra or []), reason.alias("reason"),
                     round_to(F.coalesce("best.score", F.lit(0.0)), 3).alias("score"),
                     *_own_columns(matched),
                     round_to(diff_pct(own_price, ref_price), 2).alias("price_diff_pct"))


# --- key match ---------------------------------------------------------------------------

def key_match(offers: DataFrame, ref: DataFrame, key: list[str]) -> DataFrame:
    """Fetched rows joined to the reference by exact key and routed by their status.

    ``offers`` has (key…, status, own_price, …), ``ref`` (key…, ref_sp, …). Rows that did not
    fetch keep their status; ok rows get the price difference in percent.
    """
    joined = offers.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in key])).join(ref, key)
    routed = (F.when(F.col("status") == "error", "error")
              .when(F.col("status") == "not_available", "not_available")
              .when(F.col("status") == "no_price", "no_price").otherwise("ok"))
    diff = round_to(diff_pct(F.col("own_price"), F.col("ref_sp")), 2)
    return (joined.withColumn("match_status", routed)
            .withColumn("price_diff_pct", F.when(F.col("match_status") == "ok", diff)).drop("status"))


#: Scores below which a round of a cascade stops: profiles that found a listing by then are settled.
BANDS = (0.85, 0.7, 0.5, 0.0)

# --- brand cascade ----------------------------------------------------------------------------

def brand_cascade(ref: DataFrame, cand: DataFrame, order: list[str], by: list[str] | None = None,
                  similarity: str = "ratcliff", weight: tuple[float, float] = (0.9, 1.1),
                  min_score: float = 0.55, min_score_unweighted: float = 0.70,
                  mrp_tolerance: float = 0.15, sp_tolerance: float = 0.25) -> DataFrame:
    """Brand, type (loose), pack size, best name, then price and barcode of that best one.

    Every reference row comes back with a reason: ``matched`` or the first step that failed.
    Price and barcode veto the best name; the runner-up does not take its place.
    """
    by = list(by or [])
    profile = [*by, "_brand", "_type", "_base", "_family", "_name"]
    r = _reference(ref)
    p = r.where(F.col("_brand") != "").select(*profile).distinct()
    c = _collapse(_listings(cand).where(F.col("_brand") != ""),
                  [*by, "_brand", "c_name", "c_category", "c_base", "c_family"], order)
    c = materialize(c.withColumn("c_words", F.array_union(text.words(F.col("c_category")), text.words(F.col("c_name")))))

    brand_key = [*by, "_brand"]
    brands = c.select(*brand_key).distinct().withColumn("_has_brand", F.lit(True))
    brand_words = c.select(*brand_key, F.explode("c_words").alias("_word")).distinct()
    typed = (p.select(*profile, F.explode(text.words(F.col("_type"))).alias("_word"))
             .join(brand_words, [*brand_key, "_word"], "left_semi")
             .select(*profile).distinct().withColumn("_typed", F.lit(True)))
    p = materialize(p.join(brands, brand_key, "left").join(typed, profile, "left")
                    .withColumn("_type_words", text.words(F.col("_type"))))

    width = grid_width(*weight)
    anywhere = F.array(F.lit("*"))

    def cells(family: str, numbers: Column) -> Column:
        return F.transform(numbers, lambda b: F.concat_ws(":", F.col(family), b.cast("string")))

    ref_cells = p.where("_has_brand").withColumn("_cell", F.explode(
        F.when(F.col("_base") > 0, cells("_family", probes(F.col("_base"), width))).otherwise(anywhere)))
    # reference rows without a pack size meet every listing of their brand: only such brands list "*"
    unsized = p.where("_has_brand AND NOT coalesce(_base > 0, false)").select(*brand_key).distinct()
    cand_cells = (c.where(F.col("c_base") > 0).withColumn("_cell", cells("c_family", F.array(cell(F.col("c_base"), width)))[0])
                  .unionByName(c.join(unsized, brand_key, "left_semi").select(*c.columns, F.lit("*").alias("_cell"))))

    best = _best_in_cells(ref_cells.select(*profile, "_typed", "_type_words", "_cell"), cand_cells.withColumn("c_name", F.coalesce("c_name", F.lit(""))),
                          profile, [*brand_key, "_cell"], similarity, weight).withColumn("_has_pair", F.lit(True))
    resolved = p.select(*profile, "_has_brand").join(best, profile, "left")
    out = r.join(resolved, profile, "left")

    best_score = F.coalesce("best.score", F.lit(0.0))
    needed = F.when(F.col("_base") > 0, min_score).otherwise(min_score_unweighted)
    ref_mrp, own_mrp = nonzero(F.col("mrp")), nonzero(F.col("best.own.mrp"))
    ref_sp, own_sp = nonzero(F.col("sp")), nonzero(F.col("best.own.price"))
    price_off = (F.when(ref_mrp.isNotNull() & own_mrp.isNotNull(), F.abs(ref_mrp - own_mrp) / ref_mrp > mrp_tolerance)
                 .when(ref_sp.isNotNull() & own_sp.isNotNull(), F.abs(ref_sp - own_sp) / ref_sp > sp_tolerance)
                 .otherwise(False))
    reason = (F.when(F.col("_brand") == "", "no_ref_brand")
              .when(F.col("_has_brand").isNull(), "no_brand")
              .when((F.col("_base") > 0) & F.col("_has_pair").isNull(), "no_weight")
              .when(best_score < needed, "no_name_score")
              .when(price_off, "price_mismatch")
              .when(barcodes_differ(F.col("barcode"), F.col("best.own.barcode")), "barcode_mismatch")
              .otherwise("matched"))
    out = out.withColumn("_reason", reason)
    return _stage_output(out, by, F.col("_reason") == "matched", F.col("_reason"),
                         F.coalesce(nonzero(F.col("sp")), nonzero(F.col("mrp"))))


def _best_in_cells(ref_cells: DataFrame, cand_cells: DataFrame, profile: list[str], cell_key: list[str], similarity: str,
                   weight: tuple[float, float]) -> DataFrame:
    """The best listing of every profile with a pair, among those of its cells.

    A rank join: each two names of a cell are scored once, whatever the types, pack sizes and categories they stand with.
    Profiles then meet the listings of the best-scored names first; one that finds a listing within a band of scores is settled,
    as all it has not seen score less.
    """
    names = salted_join(ref_cells.select(*cell_key, "_name").distinct(), cand_cells.select(*cell_key, "c_name").distinct(), cell_key)
    scored = F.when(F.col("c_name") == "", 0.0).otherwise(name_similarity(similarity, F.col("_name"), F.col("c_name")))
    names = materialize(names.withColumn("score", scored))
    ratio = F.col("c_base") / F.col("_base")
    unweighted = F.col("_cell") == "*"
    type_ok = F.col("_typed").isNull() | F.arrays_overlap("_type_words", "c_words")
    high, found = float("inf"), []
    for low in BANDS:
        near = names.where((F.col("score") >= low) & (F.col("score") < high))
        high = low
        pairs = (ref_cells.join(near, [*cell_key, "_name"]).join(cand_cells, [*cell_key, "c_name"])
                 .where((unweighted | ratio.between(*weight)) & type_ok)
                 .withColumn("weight_diff", F.when(unweighted, 0.0).otherwise(F.abs(1 - ratio))))
        best = materialize(_best(pairs, profile, [F.col("weight_diff"), F.col("c_order")]))
        found.append(best)
        if low > 0:
            ref_cells = ref_cells.join(best.select(*profile), profile, "left_anti")
    return reduce(lambda x, y: x.unionByName(y), found)


def barcodes_differ(ref: Column, own: Column) -> Column:
    """Both sides carry a barcode (the listing's has at least 8 characters) and they differ."""
    mine = text.strip(own)
    return F.coalesce((ref != "") & (F.length(mine) >= 8) & (ref != mine), F.lit(False))


def barcode_veto(matches: DataFrame, codes: DataFrame) -> DataFrame:
    """Flag matches whose barcode contradicts the item's; ``codes`` has (item_code, barcode)."""
    known = codes.select("item_code", F.col("barcode").alias("_code"))
    return (matches.join(known, "item_code", "left")
            .withColumn("vetoed", barcodes_differ(F.col("_code"), F.col("own_barcode"))).drop("_code"))


# --- type and price cascade ------------------------------------------------------------------

def type_cascade(ref: DataFrame, cand: DataFrame, order: list[str], by: list[str] | None = None,
                 similarity: str = "ratcliff", weight: tuple[float, float] = (0.8, 1.25),
                 min_score: float = 0.50, mrp_tolerance_pct: float = 15.0) -> DataFrame:
    """Type (strict), brand or name words, pack size (mandatory), MRP, then the best name.

    A rank join. Texts that the rules cannot tell apart become one; these meet by words, and each pair of names is
    scored once. Profiles of pack size and MRP then look for listings from the best-scored texts down,
    in a few rounds: one that finds a listing is settled, as all it has not seen score less. Of the listings of one text
    and pack size it meets the two next in MRP only. Why the rest failed is read from the pairs of texts.
    """
    by = list(by or [])
    texts, numbers = [*by, "_type", "_name", "_brand_text"], ["_base", "_family", "_mrp"]
    r = _reference(ref).withColumn("_mrp", F.coalesce(nonzero(F.col("mrp")).cast("double"), F.lit(-1.0)))
    effective_mrp = F.coalesce(nonzero(F.col("mrp")), nonzero(F.col("price")), F.lit(-1.0)).cast("double")
    c_texts = [*by, "c_name", "c_category", "c_brand_text"]
    c = materialize(_collapse(_listings(cand).withColumn("c_mrp", effective_mrp), [*c_texts, "c_base", "c_family", "c_mrp"], order))

    named = materialize(_reference_words(r.select(*texts).distinct()))
    words = [*by, "_name", "_type_words", "_brand_words"]
    rt = materialize(named.select(*words, "_name_words", "_any_words").distinct().withColumn("_rt", F.monotonically_increasing_id()))
    named = materialize(named.join(rt.select("_rt", *words), words).select("_rt", *texts))
    c_named = _listing_words(c.select(*c_texts).distinct())
    c_words = [*by, "c_name", "c_pool", "c_all"]
    ct = materialize(c_named.select(*c_words).distinct().withColumn("_ct", F.monotonically_increasing_id()))
    met = materialize(_text_pairs(rt, ct, by, similarity))
    in_range = (c.where(F.col("c_base") > 0).join(c_named, c_texts).join(ct, c_words).groupBy("_ct", "c_base", "c_family", "c_mrp")
                .agg(F.min_by("own", "c_order").alias("own"), F.min("c_order").alias("c_order")))
    in_range = materialize(in_range)
    r = r.join(named, texts, "left")

    profile = ["_rt", *numbers]
    p = materialize(r.where("_rt IS NOT NULL").select(*profile).distinct())
    best = _settled(p.where(F.col("_base") > 0), in_range, met, weight, mrp_tolerance_pct)

    # why the others failed
    failed = p.join(best.select(*profile), profile, "left_anti")
    pool_words = ct.select(*by, F.explode("c_pool").alias("_word")).distinct()
    of_type = rt.select("_rt", *by, F.explode("_type_words").alias("_word")).join(pool_words, [*by, "_word"], "left_semi").select("_rt").distinct()
    reasons = (rt.select("_rt", (F.size("_type_words") > 0).alias("_asks_type"), (F.size("_any_words") > 0).alias("_asks_name"))
               .join(of_type.withColumn("_has_type", F.lit(True)), "_rt", "left")
               .join(met.select("_rt").distinct().withColumn("_has_name", F.lit(True)), "_rt", "left"))
    has_weight = (_near(failed.where(F.col("_base") > 0).select("_rt", "_base", "_family").distinct(), met, in_range.select("_ct", "c_base", "c_family").distinct(), weight)
                  .select("_rt", "_base", "_family").distinct().withColumn("_has_weight", F.lit(True)))
    resolved = (p.join(best, profile, "left").join(reasons, "_rt").join(has_weight, ["_rt", "_base", "_family"], "left"))
    known = F.col("_has_pair").isNotNull()
    why = (F.when(known & (F.coalesce("best.score", F.lit(0.0)) >= min_score), "matched")
           .when(known, "no_name_score")
           .when(F.col("_asks_type") & F.col("_has_type").isNull(), "no_type_match")
           .when(F.col("_asks_name") & F.col("_has_name").isNull(), "no_name_token")
           .when((F.col("_base") <= 0) | F.col("_has_weight").isNull(), "no_weight")
           .otherwise("mrp_rejected"))
    resolved = resolved.withColumn("_reason", why).select(*profile, "best", "_reason")
    out = r.join(resolved, profile, "left")
    return _stage_output(out, by, F.col("_reason") == "matched", F.col("_reason"),
                         F.coalesce(nonzero(F.col("sp")), nonzero(F.col("mrp"))))


def _reference_words(texts: DataFrame) -> DataFrame:
    return (texts.withColumn("_type_words", text.significant(text.words(F.col("_type"))))
            .withColumn("_name_words", text.significant(text.words(F.col("_name"))))
            .withColumn("_brand_words", text.significant(text.words(F.col("_brand_text"))))
            .withColumn("_any_words", F.array_union("_name_words", "_brand_words")))


def _listing_words(texts: DataFrame) -> DataFrame:
    return (texts.withColumn("c_side", text.significant(text.words(F.col("c_name"))))
            .withColumn("c_pool", F.array_union(text.significant(text.words(F.col("c_category"))), F.col("c_side")))
            .withColumn("c_all", F.array_union("c_side", text.significant(text.words(F.col("c_brand_text"))))).drop("c_side"))


def _text_pairs(rt: DataFrame, ct: DataFrame, by: list[str], similarity: str) -> DataFrame:
    """(_rt, _ct, score): the texts that agree in a type word and in a brand word or enough name words, each pair once.

    They meet on a type word together with a brand word or one of the rarest name words: of n name words of which
    t must be shared, one of the n - t + 1 rarest is. So a word that most texts have is a key only
    where it is a brand. Sides without words meet on "*".
    """
    anything = F.array(F.lit("*"))
    frequency = ct.select(*by, F.explode("c_all").alias("_word")).groupBy(*by, "_word").agg(F.count("*").alias("_n"))
    ranked = (rt.select("_rt", *by, F.explode("_name_words").alias("_word")).join(frequency, [*by, "_word"], "left")
              .groupBy("_rt").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "_word"))).alias("_rare")))
    needed = F.when(F.size("_brand_words") == 0, 2).otherwise(3)
    rarest = F.slice(F.coalesce(F.col("_rare._word"), F.array().cast("array<string>")), F.lit(1), F.greatest(F.size("_name_words") - needed + 1, F.lit(0)))
    left = (rt.join(ranked, "_rt", "left").withColumn("_k1", F.when(F.size("_type_words") > 0, F.col("_type_words")).otherwise(anything))
            .withColumn("_k2", F.when(F.size("_any_words") > 0, F.array_union("_brand_words", rarest)).otherwise(anything)))
    left = materialize(left.select("_rt", *by, "_name", "_type_words", "_name_words", "_brand_words", "_any_words", "_k1", "_k2"))
    keys = left.withColumn("_word", F.explode("_k1")).withColumn("_key", F.explode("_k2"))
    asked = keys.select(*by, "_word", "_key").distinct()
    right = (ct.withColumn("_word", F.explode(F.concat("c_pool", anything))).withColumn("_key", F.explode(F.concat("c_all", anything)))
             .join(asked, [*by, "_word", "_key"], "left_semi").select("_ct", *by, "c_name", "c_pool", "c_all", "_word", "_key"))
    shared = F.size(F.array_intersect("_name_words", "c_all"))
    name_ok = ((F.size("_any_words") == 0) | F.arrays_overlap("_brand_words", "c_all") | (shared >= 3)
               | ((shared >= 2) & (F.size("_brand_words") == 0)))
    once = ((F.col("_word") == F.coalesce(F.array_min(F.array_intersect("_k1", "c_pool")), F.lit("*")))
            & (F.col("_key") == F.coalesce(F.array_min(F.array_intersect("_k2", "c_all")), F.lit("*"))))
    pairs = salted_join(keys, right, [*by, "_word", "_key"]).where(once & name_ok).select("_rt", "_ct", "_name", "c_name")
    pairs = materialize(pairs)
    scored = F.when(F.col("c_name") == "", 0.0).otherwise(name_similarity(similarity, F.col("_name"), F.col("c_name")))
    names = pairs.select("_name", "c_name").distinct().withColumn("score", scored)
    return pairs.join(names, ["_name", "c_name"]).select("_rt", "_ct", "score")


def _near(p: DataFrame, met: DataFrame, sizes: DataFrame, weight: tuple[float, float]) -> DataFrame:
    """Profiles, the texts they meet and those pack sizes of these that are in range."""
    return (p.join(met, "_rt").join(sizes, "_ct")
            .where((F.col("_family") == F.col("c_family")) & (F.col("c_base") / F.col("_base")).between(*weight)))


def _next_in_mrp(near: DataFrame, listings: DataFrame) -> DataFrame:
    """``near`` with ``found``: of the listings of the same text and pack size the one of the next lower or equal and of the next higher or equal MRP."""
    group = ["_ct", "c_base", "c_family"]
    theirs = listings.select(*group, F.col("c_mrp").alias("_at"), F.struct("c_mrp", "own", "c_order").alias("_found"))
    both = near.withColumn("_at", F.col("_mrp")).unionByName(theirs, allowMissingColumns=True)
    # a listing of an equal MRP comes first in both directions
    listing_first = F.col("_found").isNull()
    up, down = (Window.partitionBy(*group).orderBy(at, listing_first).rowsBetween(Window.unboundedPreceding, 0) for at in (F.col("_at"), F.desc("_at")))
    told = both.withColumn("_below", F.last("_found", ignorenulls=True).over(up)).withColumn("_above", F.last("_found", ignorenulls=True).over(down))
    return told.where(F.col("_found").isNull()).withColumn("found", F.explode(F.array_distinct(F.array("_below", "_above")))).where("found IS NOT NULL")


def _settled(p: DataFrame, listings: DataFrame, met: DataFrame, weight: tuple[float, float], mrp_tolerance_pct: float) -> DataFrame:
    """Every profile (_rt, _base, _family, _mrp) with a listing in range, and its best.

    Profiles that found one in a band of scores do not look at lower ones. Of equal scores the nearest MRP, pack
    size and the first listing win; scores of 0 never do.
    """
    profile = ["_rt", "_base", "_family", "_mrp"]
    sizes = materialize(listings.groupBy("_ct", "c_base", "c_family").agg(
        F.min_by(F.struct("c_mrp", "own", "c_order"), "c_order").alias("_first")))
    priced = listings.where(F.col("c_mrp") > 0)
    high, found = float("inf"), []
    for low in BANDS:
        near = _near(p, met.where((F.col("score") >= low) & (F.col("score") < high)), sizes, weight)
        high = low
        # without an MRP any listing of the size will do
        pairs = (_next_in_mrp(near.where(F.col("_mrp") > 0).drop("_first"), priced).select(*profile, "c_base", "score", "found")
                 .unionByName(near.where(F.col("_mrp") <= 0).select(*profile, "c_base", "score", F.col("_first").alias("found"))))
        mrp_diff = F.when(F.col("_mrp") > 0, F.abs(F.col("found.c_mrp") - F.col("_mrp")) / F.col("_mrp") * 100).otherwise(0.0)
        pairs = pairs.withColumn("mrp_diff", mrp_diff).where(F.col("mrp_diff") <= mrp_tolerance_pct)
        rank = F.when(F.col("score") > 0, F.struct((-F.col("score")).alias("s"), "mrp_diff", F.abs(1 - F.col("c_base") / F.col("_base")).alias("w"), "found.c_order"))
        best = materialize(pairs.groupBy(*profile).agg(F.min_by(F.struct("found.own", "score"), rank).alias("best")).withColumn("_has_pair", F.lit(True)))
        found.append(best)
        if low > 0:
            p = p.join(best.select(*profile), profile, "left_anti")
    return reduce(lambda x, y: x.unionByName(y), found)


# --- candidates already searched for an item ------------------------------------------------------

def candidate_match(ref: DataFrame, cand: DataFrame, order: list[str], by: list[str] | None = None,
                    key: str = "item_code", weight: tuple[float, float] | None = (0.7, 1.5),
                    similarity: str = "ratcliff", min_score: float = 0.55,
                    min_score_unweighted: float = 0.70) -> DataFrame:
    """Best of the listings that a search returned for each item.

    ``cand`` carries the item it was searched for, so each listing meets one item only. A listing
    is dropped when brands are known on both sides and share nothing, or when pack sizes are known
    and outside ``weight`` (reference over listing). ``weight=None`` leaves the pack size out.
    """
    by = list(by or [])
    keys = [*by, key]
    brand_words = text.words(text.normalize_name(F.col("brand")))
    fallback = F.filter(F.transform(F.filter(F.slice(F.split(text.strip(F.col("name")), r"\s+"), 1, 2),
                                             lambda w: F.length(w) >= 3), text.normalize_name), lambda w: w != "")
    r = (ref.withColumn("_name", text.normalize_name(F.col("name")))
         .withColumn("_brand_words", F.when(F.size(brand_words) > 0, brand_words).otherwise(fallback))
         .withColumn("_unit", F.nullif(F.lower(F.col("unit")), F.lit(""))))
    slim = r.select(*keys, "_name", "_brand_words", "_unit", F.col("unit_value").alias("_amount"))
    in_name = units.listing_value(F.col("name"))
    c = cand.select(*keys, _payload().alias("own"), _arrival(order).alias("c_order"),
                    text.normalize_name(F.col("name")).alias("c_name"),
                    text.words(text.normalize_name(F.col("brand"))).alias("c_brand_words"),
                    F.coalesce(in_name, units.listing_value(F.col("unit"))).alias("c_amount"),
                    F.when(in_name.isNotNull(), units.listing_unit(F.col("name")))
                    .otherwise(units.listing_unit(F.col("unit"))).alias("c_unit"))
    overlap = (F.arrays_overlap("_brand_words", "c_brand_words")
               | F.exists("_brand_words", lambda w: (F.length(w) >= 3) & F.contains(F.col("c_name"), w)))
    unknown_brand = (F.size("_brand_words") == 0) | (F.size("c_brand_words") == 0)
    pairs = slim.join(c, keys).where(unknown_brand | overlap)
    if weight is None:
        pairs = pairs.withColumn("_needed", F.lit(min_score))
    else:
        def base(value: str, unit: str) -> Column:
            return F.when(F.col(unit).isin("kg", "l", "ltr"), F.col(value) * 1000).otherwise(F.col(value))

        def kind(unit: str) -> Column:
            return F.coalesce(units.unit_group(F.col(unit)), F.lit("count"))

        known = (F.col("_amount").isNotNull() & F.col("c_amount").isNotNull()
                 & F.col("_unit").isNotNull() & F.col("c_unit").isNotNull())
        ratio = base("_amount", "_unit") / nonzero(base("c_amount", "c_unit"))
        fits = F.coalesce((kind("_unit") == kind("c_unit")) & ratio.between(*weight), F.lit(False))
        pairs = (pairs.where(~known | fits)
                 .withColumn("_needed", F.when(known, min_score).otherwise(min_score_unweighted)))
    pairs = (pairs.withColumn("score", name_similarity(similarity, F.col("_name"), F.col("c_name")))
             .where(F.col("score") >= F.col("_needed")))
    best = _best(pairs, keys, [F.col("c_order")])
    out = ref.join(best, keys, "left")
    matched = F.col("best").isNotNull()
    return _stage_output(out, by, matched, F.when(matched, "matched").otherwise("no_candidate"),
                         nonzero(F.col("sp")))


def best_name_match(ref: DataFrame, cand: DataFrame, order: list[str], by: list[str] | None = None,
                    key: str | None = None, alt: str | None = None, similarity: str = "ratcliff",
                    min_score: float = 0.35) -> DataFrame:
    """Best listing by name, or by the better of name and alternate name.

    With ``key`` the listings were searched for the item. Without a shared key, listings that
    share at least one word with the name are compared; ``token_jaccard`` is the metric for large
    inputs there (see ``_share_a_word``), and with it items without a match report score 0.
    """
    by = list(by or [])
    names = ["name"] + ([alt] if alt else [])
    squeezed = [text.squeeze_name(F.col(n)).alias(f"_n{i}") for i, n in enumerate(names)]
    own = [text.squeeze_name(F.col("name")).alias("c_name")]
    if key:
        profile = [*by, key]
        pairs = ref.select(*profile, *squeezed).join(
            cand.select(*profile, *own, _payload().alias("own"), _arrival(order).alias("c_order")), profile)
    else:
        profile = [*by, *[f"_n{i}" for i in range(len(names))]]
        p = ref.select(*by, *squeezed).distinct()
        words = reduce(F.array_union, [text.words(F.col(f"_n{i}")) for i in range(len(names))])
        c = _collapse(cand.select(*by, *own, *PAYLOAD, *[o for o in order if o not in PAYLOAD]),
                      [*by, "c_name"], order)
        exact = len(names) == 1  # an alternate name has words of its own, so the bound is off
        pairs = _share_a_word(p.withColumn("_words", words), c.withColumn("c_words", text.words(F.col("c_name"))), by,
                              similarity if exact else "", min_score)
    scores = [name_similarity(similarity, F.col(f"_n{i}"), F.col("c_name")) for i in range(len(names))]
    score = F.greatest(*scores) if len(scores) > 1 else scores[0]
    best = _best(pairs.withColumn("score", score), profile, [F.col("c_order")])
    base = ref if key else ref.select("*", *squeezed)
    out = base.join(best, profile, "left")
    matched = F.coalesce(F.col("best.score") >= min_score, F.lit(False))
    return _stage_output(out, by, matched, F.when(matched, "matched").otherwise("no_name_score"),
                         nonzero(F.col("sp")))


def _share_a_word(ref: DataFrame, cand: DataFrame, by: list[str], similarity: str = "",
                  min_score: float = 0.0) -> DataFrame:
    """Pairs with at least one common word, each pair once.

    With ``token_jaccard`` and a threshold only pairs that can reach it are formed: of a name with
    n words at least ceil(t·n) must be shared, so one of its n − ceil(t·n) + 1 rarest words must be.
    Both sides keep those rarest words as join keys, and a word found in most names is hardly ever
    a key. No pair at or above the threshold is lost. The other metrics compare characters, which
    no set of words bounds, so they meet on every word; hot words are spread by salting.
    """
    if similarity == "token_jaccard" and min_score > 0:
        frequency = cand.select(*by, F.explode("c_words").alias("_word")).groupBy(*by, "_word").agg(F.count("*").alias("_n"))
        left = _rarest(ref, frequency, by, "_words", min_score)
        right = _rarest(cand, frequency, by, "c_words", min_score)
    else:
        left, right = ref.withColumn("_keys", F.col("_words")), cand.withColumn("c_keys", F.col("c_words"))
    joined = salted_join(left.withColumn("_word", F.explode("_keys")), right.withColumn("_word", F.explode("c_keys")), [*by, "_word"])
    return joined.where(is_first_shared("_word", F.col("_keys"), F.col("c_keys"))).drop("_word", "_keys", "c_keys")


def _word_similarity(similarity: str, query: str) -> Column:
    """Similarity of a pair whose word lists ``_words`` and ``c_words`` are at hand."""
    if similarity == "token_jaccard":
        return words_jaccard(F.col("_words"), F.col("c_words"))
    return name_similarity(similarity, F.col(query), F.col("c_name"))


def _rarest(df: DataFrame, frequency: DataFrame, by: list[str], words: str, t: float) -> DataFrame:
    """Adds the rarest words a pair at or above ``t`` must meet on, as ``_keys`` or ``c_keys``."""
    out = "_keys" if words == "_words" else "c_keys"
    name = "_query" if "_query" in df.columns else ("c_name" if words == "c_words" else "_n0")
    key = [*by, name]
    ranked = (df.select(*key, words).distinct().withColumn("_word", F.explode(words)).join(frequency, [*by, "_word"], "left")
              .groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "_word"))).alias("_r")))
    # the small allowance keeps a product such as 0.55 · 20 from rounding up past a whole number
    length = F.size("_r") - F.ceil(F.size("_r") * t - 1e-9).cast("int") + 1
    return df.join(ranked.select(*key, F.slice(F.col("_r._word"), F.lit(1), length).alias(out)), key)


# --- identifier first, then fuzzy -------------------------------------------------------------------

def id_then_fuzzy(ref: DataFrame, cand: DataFrame, order: list[str], by: list[str] | None = None,
                  similarity: str = "ratcliff", min_score: float = 0.5, brand_bonus: float = 0.1) -> DataFrame:
    """Exact product id scores 1; the rest take the best listing found through shared words.

    Listings are found by their first three words; a reference row that finds none that way
    looks at every listing it shares any word with. ``ref`` carries ``ref_product_id``. Use
    ``token_jaccard`` on large inputs: only pairs that can reach ``min_score`` are then formed.
    """
    by = list(by or [])
    by_id = (cand.where(F.coalesce("product_id", F.lit("")) != "")
             .groupBy(*by, F.col("product_id").alias("ref_product_id"))
             .agg(F.max_by(_payload(), _arrival(order)).alias("own")))
    r = (ref.withColumn("_query", text.normalize_name(F.concat_ws(" ", "brand", "name")))
         .withColumn("_brand_low", F.lower(text.strip(F.coalesce("brand", F.lit(""))))))
    exact = r.join(by_id, [*by, "ref_product_id"])
    rest = r.join(by_id.select(*by, "ref_product_id"), [*by, "ref_product_id"], "left_anti")

    profile = [*by, "_query", "_brand_low"]
    p = rest.select(*profile).distinct().withColumn("_words", text.words(F.col("_query")))
    full = text.normalize_name(F.concat_ws(" ", "brand", "name", "unit"))
    c = _collapse(cand.withColumn("c_name", full), [*by, "c_name"], order)
    # pairs carry a number for the listing; its row is looked up for the best ones only
    c = materialize(c.withColumn("_listing", F.monotonically_increasing_id()))
    listed = c.select("_listing", "own")
    c = c.withColumn("own", F.col("_listing")).drop("_listing").withColumn("c_words", text.words(F.col("c_name")))
    long_word = lambda w: F.length(w) >= 3
    heads = c.withColumn("c_heads", F.array_distinct(F.filter(F.slice(F.split("c_name", " "), 1, 3), long_word)))
    p = p.withColumn("_long", F.filter("_words", long_word))
    head_words = heads.select(*by, F.explode("c_heads").alias("_word")).distinct()
    indexed = (p.withColumn("_word", F.explode("_long")).join(head_words, [*by, "_word"], "left_semi")
               .select(*profile).distinct().withColumn("_indexed", F.lit(True)))
    if similarity == "token_jaccard":
        met = (_share_a_word(p.join(indexed, profile, "left"), heads, by, similarity, min_score - brand_bonus)
               .where(F.col("_indexed").isNull() | F.arrays_overlap("_long", "c_heads")).drop("c_heads"))
    else:
        found = p.join(indexed, profile)
        near = salted_join(found.withColumn("_word", F.explode("_long")), heads.withColumn("_word", F.explode("c_heads")), [*by, "_word"])
        near = near.where(is_first_shared("_word", F.col("_long"), F.col("c_heads"))).drop("_word", "c_heads")
        rest_p = p.join(indexed.drop("_indexed"), profile, "left_anti").withColumn("_indexed", F.lit(None).cast("boolean"))
        met = near.unionByName(_share_a_word(rest_p, c, by))
    raw = _word_similarity(similarity, "_query")
    bonus = (F.col("_brand_low") != "") & F.contains(F.col("c_name"), F.col("_brand_low"))
    pairs = (met.withColumn("_raw", raw)
             .withColumn("score", F.when(bonus, F.least(F.lit(1.0), F.col("_raw") + brand_bonus))
                         .otherwise(F.col("_raw"))))
    best = (_best(pairs, profile, [F.col("c_order")]).select(*profile, F.col("best.own").alias("_listing"), F.col("best.score").alias("score"))
            .join(listed, "_listing", "left")
            .select(*profile, F.when(F.col("_listing").isNotNull(), F.struct("own", "score")).alias("best")))
    fuzzy = (rest.join(best, profile, "left")
             .withColumn("_hit", F.coalesce(F.col("best.score") >= min_score, F.lit(False))))
    as_exact = exact.withColumn("best", F.struct("own", F.lit(1.0).alias("score"))).withColumn("_hit", F.lit(True))
    keep = [*by, "item_code", "sp", "best", "_hit"]
    both = (as_exact.select(*keep, F.lit("id_exact").alias("method"))
            .unionByName(fuzzy.select(*keep, F.when(F.col("_hit"), "fuzzy").alias("method"))))
    return _stage_output(both, by, F.col("_hit"), F.when(F.col("_hit"), "matched").otherwise("not_found"),
                         nonzero(F.col("sp")), extra=["method"])


#: Similarities down to which a round of ``top_candidates`` finds every listing.
ROUND_SCORES = (0.6, 0.3)


def top_candidates(ref: DataFrame, cand: DataFrame, n: int, order: list[str], by: list[str] | None = None,
                   similarity: str = "ratcliff", brand_bonus: float = 0.1, min_score: float = 0.0) -> DataFrame:
    """The n most similar listings per item among those sharing a word with its brand and name.

    With ``min_score`` listings below it (before the brand bonus) are left out. With ``token_jaccard``
    items are served in rounds: a round finds all listings down to a similarity, on the items' rarest words alone, and an
    item whose n-th score is above what any other listing could reach is settled. Only the rest go on, so a
    word that most names have makes no pairs for settled items.
    """
    by = list(by or [])
    r = (ref.withColumn("_brand", text.normalize_name(_text("brand")))
         .withColumn("_query", F.trim(F.concat_ws(" ", "_brand", text.normalize_name(_text("name"))))))
    profile = [*by, "_query", "_brand"]
    p = r.select(*profile).distinct().withColumn("_words", text.words(F.col("_query")))
    c = cand.select(*by, _payload().alias("own"), _arrival(order).alias("c_order"),
                    F.trim(F.concat_ws(" ", text.normalize_name(F.col("brand")),
                                       text.normalize_name(F.col("name")))).alias("c_name"))
    # of listings with one name only the first n can be among the best n
    same_name = Window.partitionBy(*by, "c_name").orderBy("c_order")
    c = (c.where(F.col("c_name") != "").withColumn("_copy", F.row_number().over(same_name)).where(F.col("_copy") <= n).drop("_copy")
         .withColumn("c_words", text.words(F.col("c_name"))))
    rounds = [t for t in ROUND_SCORES if t > min_score] if similarity == "token_jaccard" else []
    if rounds:
        p, c = materialize(p), materialize(c)
    ranked: list[DataFrame] = []
    for t in [*rounds, min_score]:
        best = _ranked_pairs(p, c, n, by, profile, similarity, brand_bonus, t)
        if t != min_score:
            best = materialize(best)
            # what this round did not see is less similar than t
            others = F.lit(t) + F.when(F.col("_brand") != "", brand_bonus).otherwise(0.0)
            done = best.where((F.col("rank") == n) & (F.col("score") >= others)).select(*profile)
            best = best.join(done, profile, "left_semi")
            p = materialize(p.join(done, profile, "left_anti"))
        ranked.append(best)
    return (r.select(*by, "item_code", "_query", "_brand").join(reduce(lambda x, y: x.unionByName(y), ranked), profile)
            .select(*by, "item_code", "rank", round_to(F.col("score"), 3).alias("score"),
                    *[F.col(f"own.{f}").alias(name) for f, name in OWN_COLUMNS.items()]))


def _ranked_pairs(p: DataFrame, c: DataFrame, n: int, by: list[str], profile: list[str], similarity: str, brand_bonus: float, least: float) -> DataFrame:
    """The best n listings of each profile among those at least as similar as ``least``."""
    bonus = (F.col("_brand") != "") & F.contains(F.col("c_name"), F.col("_brand"))
    pairs = (_share_a_word(p, c, by, similarity, least)
             .withColumn("_raw", _word_similarity(similarity, "_query")).where(F.col("_raw") >= least)
             .withColumn("score", F.when(bonus, F.least(F.lit(1.0), F.col("_raw") + brand_bonus)).otherwise(F.col("_raw"))))
    # the rank limit is applied before the shuffle as well as after it
    w = Window.partitionBy(*profile).orderBy(F.desc("score"), "c_order")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select(*profile, "rank", "score", "own")


# --- barcodes and hashes -------------------------------------------------------------------------

def real_barcode(c: Column) -> Column:
    """At least eight digits and nothing else."""
    return F.coalesce(text.strip(c).rlike(r"^[0-9]{8,}$"), F.lit(False))


def barcode_map(df: DataFrame) -> DataFrame:
    """Item to barcode, without codes that repeat the item code."""
    code, item = text.strip(F.col("bar_code")), text.strip(F.col("item_code").cast("string"))
    return df.where(real_barcode(F.col("bar_code")) & (code != item)).select("item_code", code.alias("barcode"))


def barcode_match(ref: DataFrame, cand: DataFrame, order: list[str], ref_order: list[str],
                  by: list[str] | None = None) -> DataFrame:
    """Items and listings that carry the same barcode; the last of each side wins per code.

    ``ref`` has ``bar_code`` and ``bar_codes`` (an array, or JSON text of one).
    """
    by = list(by or [])
    many = F.col("bar_codes")
    if ref.schema["bar_codes"].dataType.typeName() == "string":
        many = F.from_json(many, "array<string>")
    codes = F.array_union(F.array("bar_code"), F.coalesce(many, F.array().cast("array<string>")))
    mine = (ref.withColumn("code", F.explode(codes)).where(real_barcode(F.col("code")))
            .withColumn("code", text.strip(F.col("code"))).groupBy(*by, "code")
            .agg(F.max_by("item_code", _arrival(ref_order)).alias("item_code")))
    theirs = (cand.where(real_barcode(F.col("barcode"))).withColumn("code", text.strip(F.col("barcode")))
              .groupBy(*by, "code").agg(F.max_by(_payload(), _arrival(order)).alias("own")))
    return mine.join(theirs, [*by, "code"]).select(
        *by, "item_code", F.col("code").alias("barcode"),
        *[F.col(f"own.{f}").alias(name) for f, name in OWN_COLUMNS.items()])


# --- set operations between stages ---------------------------------------------------------------

def residual(ref: DataFrame, matches: list[DataFrame], key: list[str]) -> DataFrame:
    """Reference rows that no earlier stage matched."""
    done = reduce(lambda a, b: a.unionByName(b), [m.select(*key) for m in matches])
    return ref.join(done, key, "left_anti")


def retry_set(ref: DataFrame, previous: DataFrame, key: list[str], weak: float = 0.6, mapped: DataFrame | None = None) -> DataFrame:
    """Rows the previous stage did not match or matched weakly, but for those that ``mapped`` already knows."""
    again = previous.where((F.col("reason") != "matched") | (F.col("score") < weak))
    rows = ref.join(again.select(*key), key, "left_semi")
    return rows if mapped is None else rows.join(mapped.select(*key), key, "left_anti")


def build_mapping(sources: list[tuple[str, DataFrame]], by: list[str]) -> DataFrame:
    """First source wins per item; each source is (method, rows with item_code, product_id, confidence, at).

    Within one source the earliest row wins.
    """
    tagged = [df.select(*by, "item_code", "product_id", "confidence", "at", F.lit(method).alias("method"),
                        F.lit(i).alias("_priority")) for i, (method, df) in enumerate(sources)]
    union = reduce(lambda a, b: a.unionByName(b), tagged)
    known = F.coalesce(F.col("product_id").cast("string"), F.lit("")) != ""
    return (union.where(known & F.col("item_code").isNotNull()).groupBy(*by, "item_code")
            .agg(F.min_by(F.struct("product_id", "confidence", "method"), F.struct("_priority", "at")).alias("m"))
            .select(*by, "item_code", "m.*"))


def merge_registry(base: DataFrame, batch: DataFrame, key: list[str], compare: str) -> DataFrame:
    """Add or replace entries that are new or whose ``compare`` column changed; never delete.

    ``batch`` has one row per key. The column ``action`` tells added, changed and kept apart.
    """
    rest = [c for c in base.columns if c not in key]
    old = base.select(*key, F.struct(*rest).alias("_old"))
    new = batch.where(F.col(compare).isNotNull()).select(*key, F.struct(*rest).alias("_new"))
    joined = old.join(new, key, "full_outer")
    changed = F.col("_new").isNotNull() & ~F.col(f"_new.{compare}").eqNullSafe(F.col(f"_old.{compare}"))
    action = (F.when(F.col("_old").isNull(), "added").when(changed, "changed").otherwise("kept"))
    chosen = F.when(F.col("_old").isNull() | changed, F.col("_new")).otherwise(F.col("_old"))
    return (joined.select(*key, chosen.alias("_row"), action.alias("action"))
            .select(*key, *[F.col(f"_row.{c}").alias(c) for c in rest], "action"))


def fetch_list(mapping: DataFrame, ref: DataFrame, key: list[str]) -> DataFrame:
    """Mapped products first; the reference feed adds items it knows that are in stock.

    Both sides have (key…, product_id, product_url), the reference also ``stock``.
    """
    mapped = mapping.where(F.col("product_id").isNotNull()).select(
        *key, "product_id", "product_url", F.lit("mapping").alias("source"))
    usable = (text.clean_text(F.col("product_id")).isNotNull() & F.col("product_url").startswith("http")
              & (F.coalesce(F.lower("stock"), F.lit("")) != "out_of_stock"))
    extra = (ref.where(usable).join(mapped.select(*key), key, "left_anti")
             .select(*key, "product_id", "product_url", F.lit("reference").alias("source")))
    return mapped.unionByName(extra)

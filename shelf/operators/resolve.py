"""Resolution and classification of matched prices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelf.functions import text, units
from shelf.functions.numbers import nonzero, round_to

CATEGORY_WITH_LOOSE_ITEMS = "STPLS"


def usable(ref: DataFrame, sp: str = "sp", name: str = "item_name") -> DataFrame:
    """Reference rows with a selling price that are not sold loose."""
    return ref.where(text.clean_text(F.col(sp)).isNotNull()
                     & ~F.contains(F.lower(F.coalesce(F.col(name), F.lit(""))), F.lit("loose")))


def best_by_score(matches: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Best match per item over all stages: higher score, then earlier stage, then input order.

    A stage that gives no score counts as 0.
    """
    key = [*by, "item_code"]
    rest = [c for c in matches.columns if c not in key]
    rank = F.struct((-F.coalesce("score", F.lit(0.0))).alias("s"), F.col("stage"),
                    F.struct(*order).alias("o"))
    return (matches.where(F.col("item_code").isNotNull() & F.col("own_price").isNotNull()).groupBy(*key)
            .agg(F.min_by(F.struct(*rest), rank).alias("row")).select(*key, "row.*"))


RESOLVED = ["own_name", "own_unit", "own_mrp", "own_price", "in_stock"]


def resolve_prices(items: DataFrame, keyed: DataFrame, cascade: DataFrame, key: list[str]) -> DataFrame:
    """Price of each item by precedence: not available, then the key match, then the cascades.

    ``keyed`` has a status; a row that is not available blocks every other source of its item.
    ``cascade`` holds the cascade stages with ``stage`` and ``ordinal``; the first stage with a
    price wins.
    """
    blocked = (keyed.where(F.col("status") == "not_available").select(*key).distinct()
               .withColumn("_blocked", F.lit(True)))
    by_key = (keyed.where(F.col("status") == "ok").groupBy(*key)
              .agg(F.max_by(F.struct(*RESOLVED), "ordinal").alias("k")))
    by_stage = (cascade.where(nonzero(F.col("own_price")).isNotNull()).groupBy(*key)
                .agg(F.min_by(F.struct(*RESOLVED), F.struct("stage", "ordinal")).alias("c")))
    joined = (items.join(blocked, key, "left").join(by_key, key, "left").join(by_stage, key, "left"))
    source = (F.when(F.col("_blocked"), "not_available").when(F.col("k").isNotNull(), "key")
              .when(F.col("c").isNotNull(), "cascade"))
    chosen = F.when(F.col("_blocked").isNull(), F.coalesce("k", "c"))
    stock = (F.when(F.col("_blocked"), "out_of_stock")
             .when(chosen.isNotNull(), F.when(F.coalesce(chosen["in_stock"], F.lit(True)), "available")
                   .otherwise("out_of_stock")))
    return (joined.withColumn("source", source)
            .withColumns({c: chosen[c] for c in RESOLVED if c != "in_stock"})
            .withColumn("stock", stock).drop("_blocked", "k", "c"))


OFFER_FIELDS = ["own_price", "own_mrp", "own_name", "own_unit", "stock"]


def _name_pack(df: DataFrame) -> DataFrame:
    return (df.withColumn("_own_amount", units.listing_value(F.col("own_name")))
            .withColumn("_own_unit", units.listing_unit(F.col("own_name")))
            .withColumn("_ratio", units.comparable_ratio(nonzero(F.col("unit_value").cast("double")), F.col("unit"),
                                                         nonzero(F.col("_own_amount")), F.col("_own_unit"))))


def guard_offers(df: DataFrame, max_price_ratio: float = 3.0, low: float = 0.7, high: float = 1.5) -> DataFrame:
    """Null the offer when it costs more than three times the MRP, or its pack is another size.

    The pack ratio is own over catalogue; an unknown ratio rejects nothing.
    """
    packed = _name_pack(df)
    dear = F.coalesce(F.col("own_price") > nonzero(F.col("mrp")) * max_price_ratio, F.lit(False))
    other_pack = F.coalesce(~F.col("_ratio").between(low, high), F.lit(False)) & F.col("own_price").isNotNull()
    cause = F.when(dear, "price").when(other_pack, "pack")
    kept = packed.withColumn("rejected", cause)
    return (kept.withColumns({c: F.when(F.col("rejected").isNull(), F.col(c)) for c in OFFER_FIELDS if c in df.columns})
            .drop("_own_amount", "_own_unit", "_ratio"))


def match_status(df: DataFrame, mrp_tolerance: float = 0.01) -> DataFrame:
    """NA, SEMI COMPLETE, PARTIAL or COMPLETE MATCH of an offer against its catalogue item.

    Loose staples only need the same kind of unit. For the rest the pack sizes must agree within
    10 % and the MRPs within ``mrp_tolerance``; a pack size that cannot be read is neither a match
    nor a mismatch, and such an offer is PARTIAL.
    """
    packed = _name_pack(df)
    name, kind = F.lower(F.coalesce("name", F.lit(""))), F.upper(F.coalesce("product_type", F.lit("")))
    loose = ((F.contains(name, F.lit("loose")) | F.contains(name, F.lit("asm")) | kind.isin("LOOSE", "ASM"))
             & F.coalesce(F.col("master_category") == CATEGORY_WITH_LOOSE_ITEMS, F.lit(False)))
    ours, theirs = units.unit_group(F.col("unit")), units.unit_group(F.col("_own_unit"))
    other_kind = F.coalesce(ours != theirs, F.lit(False))
    unit_match = F.col("_ratio").between(0.9, 1.1)  # null while either side is unknown
    same_mrp = F.coalesce(F.abs(nonzero(F.col("mrp")) - nonzero(F.col("own_mrp"))) < mrp_tolerance, F.lit(False))
    status = (F.when(F.col("own_price").isNull(), "NA")
              .when(loose & other_kind, "PARTIAL MATCH").when(loose, "SEMI COMPLETE MATCH")
              .when(unit_match & same_mrp, "COMPLETE MATCH").otherwise("PARTIAL MATCH"))
    return packed.withColumn("match_status", status).drop("_own_amount", "_own_unit", "_ratio")


def match_reason(df: DataFrame) -> DataFrame:
    """Status and partial reason by the feed's own rule tree.

    Expects ``own_name, brand, own_brand, is_fresh, unit_family, own_unit_family, base_amount,
    own_base_amount, mrp, own_mrp`` (amounts in base units) and ``private_label``.
    """
    no_match = F.col("own_name").isNull()
    same_family = F.col("unit_family").eqNullSafe(F.col("own_unit_family"))
    same_pack = same_family & F.col("base_amount").eqNullSafe(F.col("own_base_amount"))
    same_mrp = F.col("mrp").eqNullSafe(F.col("own_mrp"))
    status = (F.when(no_match, "NA").when(F.col("private_label"), "Semi Complete Match")
              .when(F.col("is_fresh") & same_family, "Complete Match")
              .when(same_pack & same_mrp, "Complete Match").otherwise("Partial Match"))
    reason = (F.when(F.col("is_fresh") & ~same_family, "FNV-UOM-Diff")
              .when(~same_pack, "NFNV-Product-Weight-Diff").when(~same_mrp, "MRP Diff"))
    return (df.withColumn("feed_status", status)
            .withColumn("partial_reason", F.when(F.col("feed_status") == "Partial Match", reason)))


def pack_factor(df: DataFrame, ref_pack: str, own_pack: str) -> DataFrame:
    """Reference amount over own amount, and the own price brought to the reference pack size.

    Both packs are texts; multipacks count with their full content. Null across unit families.
    """
    packed = (df.withColumn("_r", units.pack(F.col(ref_pack))).withColumn("_o", units.pack(F.col(own_pack)))
              .withColumn("_ru", F.col("_r.unit")).withColumn("_ou", F.col("_o.unit"))
              .withColumn("_ru", units.unit_alias(F.col("_ru"))).withColumn("_ou", units.unit_alias(F.col("_ou"))))
    comparable = units.family(F.col("_ru")) == units.family(F.col("_ou"))
    factor = F.when(comparable, units.base_value(F.col("_r.value"), F.col("_ru"))
                    / nonzero(units.base_value(F.col("_o.value"), F.col("_ou"))))
    return (packed.withColumn("_exact", factor).withColumn("factor", round_to(F.col("_exact"), 3))
            .withColumn("normalized_price", F.col("own_price") * F.col("_exact"))
            .withColumn("normalized_delta", F.col("normalized_price") - F.col("mrp"))
            .drop("_r", "_o", "_ru", "_ou", "_exact"))


def diff_flag(df: DataFrame, diff: str = "price_diff_pct") -> DataFrame:
    d = F.col(diff)
    return df.withColumn("flag", F.when(d.isNull(), "missing").when(d <= 5, "ok").when(d <= 10, "near").otherwise("far"))


def review_queue(key_stage: DataFrame, brand_stage: DataFrame, type_stage: DataFrame, candidates: DataFrame,
                 key: list[str], weak: float = 0.6, suspicious_pct: float = 20.0) -> DataFrame:
    """Everything a person should look at, with the best candidates as text.

    Failed or suspicious key matches; weak and unmatched rows of the brand stage unless the type
    stage rescued them with a good score; weak and unmatched rows of the type stage.
    ``candidates`` is the output of top_candidates.
    """
    status, diff = F.col("match_status"), F.col("price_diff_pct")
    first = (key_stage.where(status.isin("error", "no_price") | (diff > suspicious_pct))
             .select(*key, F.lit(1).alias("stage"),
                     F.when(status == "error", "stage1_error").when(status == "no_price", "stage1_no_price")
                     .otherwise("stage1_price_diff").alias("reason"), "own_name", "own_price", diff.alias("price_diff_pct")))

    def later(df: DataFrame, stage: int) -> DataFrame:
        unmatched = F.col("reason") != "matched"
        return (df.where(unmatched | (F.col("score") < weak))
                .select(*key, F.lit(stage).alias("stage"),
                        F.when(unmatched, F.concat(F.lit(f"stage{stage}_"), F.col("reason")))
                        .otherwise(f"stage{stage}_weak_score").alias("reason"),
                        "own_name", "own_price", F.lit(None).cast("double").alias("price_diff_pct")))

    rescued = type_stage.where((F.col("reason") == "matched") & (F.col("score") >= weak)).select(*key)
    second = later(brand_stage, 2).join(rescued, key, "left_anti")
    rows = first.unionByName(second).unionByName(later(type_stage, 3))
    line = F.concat(F.lit("["), F.col("score").cast("string"), F.lit("] "), F.col("own_name"), F.lit(" ("),
                    F.coalesce("own_unit", F.lit("-")), F.lit(", "), F.coalesce(round_to(F.col("own_price"), 2).cast("string"), F.lit("-")), F.lit(")"))
    texts = (candidates.groupBy(*key)
             .agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("c"))
             .select(*key, F.concat_ws("; ", F.col("c.line")).alias("top_candidates")))
    joined = rows.join(texts, key, "left")
    return joined.withColumn("top_candidates", F.when(F.col("stage") > 1, F.coalesce("top_candidates", F.lit("")))
                             .otherwise(""))


def side_by_side(ref: DataFrame, own: DataFrame, key: list[str]) -> DataFrame:
    """Every reference item next to its own price, with the difference and a match flag."""
    joined = ref.join(own, key, "left")
    diff = round_to(F.col("own_price") - F.col("ref_sp"), 2)
    out = joined.withColumn("diff", diff).withColumn(
        "diff_pct", F.when(F.col("ref_sp") != 0, round_to(F.abs(F.col("diff")) / F.col("ref_sp") * 100, 1)))
    return diff_flag(out.withColumn("within_5", F.coalesce(F.col("diff_pct") <= 5, F.lit(False)))
                     .withColumn("within_10", F.coalesce(F.col("diff_pct") <= 10, F.lit(False))), "diff_pct")


def city_price_table(catalogue: DataFrame, resolved: DataFrame, platforms: list[str], pincodes: list[int]) -> DataFrame:
    """The price sheets of cities: every catalogue row with url, name, unit, mrp, sp, stock, status per platform.

    An item without an offer has a row in every city, with status NA.

    ``resolved`` is long: (pincode, platform, item_code, own_*, stock, url). Offers are guarded and
    classified in the long form, so one pass serves every platform, and then pivoted.
    """
    facts = ["item_code", "name", "master_category", "product_type", "unit", "unit_value", "mrp"]
    long = resolved.join(catalogue.select(*facts), "item_code")
    judged = match_status(guard_offers(long))
    offer = F.struct("url", F.col("own_name").alias("name"), F.col("own_unit").alias("unit"), F.col("own_mrp").alias("mrp"),
                     F.col("own_price").alias("sp"), "stock", F.col("match_status").alias("status"))
    wide = (judged.withColumn("offer", offer).groupBy("pincode", "item_code")
            .pivot("platform", platforms).agg(F.first("offer")))
    cols = []
    for p in platforms:
        for f in ("url", "name", "unit", "mrp", "sp", "stock"):
            cols.append(F.col(f"`_{p}`.{f}").alias(f"{p}_{f}"))
        cols.append(F.coalesce(F.col(f"`_{p}`.status"), F.lit("NA")).alias(f"{p}_status"))
    sheet = catalogue.withColumn("pincode", F.explode(F.array(*[F.lit(p) for p in pincodes])))
    joined = sheet.join(wide.withColumnsRenamed({p: f"_{p}" for p in platforms}), ["pincode", "item_code"], "left")
    return joined.select(*sheet.columns, *cols)


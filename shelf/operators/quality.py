"""Snapshot validation and quality checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelf.functions import text, units
from shelf.functions.numbers import nonzero, share_pct
from shelf.operators.reports import count_if




def validate_snapshot(df: DataFrame, pincodes: DataFrame, platforms: list[str], min_rows: int = 100,
                      max_price: float = 50_000, min_priced_pct: float = 10.0) -> DataFrame:
    """Failed checks of a snapshot, one row each; an empty result means the snapshot is good.

    Counts are taken per city first, so the checks read a table of a few rows.
    """
    lead = f"{platforms[0]}_sp"
    bad = {p: count_if(~F.col(f"{p}_sp").between(0, max_price)) for p in platforms}
    per_city = df.groupBy("pincode").agg(
        F.count("*").alias("rows"), count_if(F.col("item_code").isNull()).alias("null_items"),
        F.count(lead).alias("priced"), *[bad[p].alias(f"bad_{p}") for p in platforms])
    short = (pincodes.select("pincode").join(per_city, "pincode", "left")
             .withColumn("observed", F.coalesce("rows", F.lit(0))).where(F.col("observed") < min_rows)
             .select(F.lit("too_few_rows").alias("check"), F.col("pincode").cast("string").alias("subject"),
                     F.col("observed").cast("double").alias("observed")))
    total = per_city.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
                         F.coalesce(F.sum("null_items"), F.lit(0)).alias("null_items"),
                         F.coalesce(F.sum("priced"), F.lit(0)).alias("priced"),
                         *[F.coalesce(F.sum(f"bad_{p}"), F.lit(0)).alias(f"bad_{p}") for p in platforms])
    priced_pct = F.when(F.col("rows") > 0, F.col("priced") * 100 / F.col("rows")).otherwise(0.0)

    def check(name: str, subject: str, failed: Column, observed: Column) -> Column:
        return F.when(failed, F.struct(F.lit(name).alias("check"), F.lit(subject).alias("subject"),
                                       observed.cast("double").alias("observed")))

    checks = [check("no_rows", "snapshot", F.col("rows") == 0, F.col("rows")),
              check("null_item_code", "snapshot", F.col("null_items") > 0, F.col("null_items")),
              *[check("price_out_of_range", p, F.col(f"bad_{p}") > 0, F.col(f"bad_{p}")) for p in platforms],
              check("too_few_prices", platforms[0], (F.col("rows") > 0) & (priced_pct < min_priced_pct), priced_pct)]
    whole = (total.select(F.explode(F.filter(F.array(*checks), lambda c: c.isNotNull())).alias("c")).select("c.*"))
    return short.unionByName(whole)


def price_sanity(df: DataFrame, platforms: list[str]) -> DataFrame:
    """Counts of impossible prices per platform, over the unpivoted price columns."""
    pairs = F.array(*[F.struct(F.lit(p).alias("platform"), F.col(f"{p}_sp").alias("sp"), F.col(f"{p}_mrp").alias("mrp"))
                      for p in platforms])
    long = df.select(F.explode(pairs).alias("o")).select("o.*")
    sp, mrp = F.col("sp"), F.col("mrp")
    return long.groupBy("platform").agg(
        F.count("sp").alias("checked"), count_if(sp <= 0).alias("zero_or_negative"),
        count_if((sp > 0) & (sp < 1)).alias("below_1"), count_if(sp > 50_000).alias("above_50000"),
        count_if((sp > mrp) & (mrp > 0)).alias("sp_exceeds_mrp"))


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > 1)


def stage_overlap(matches: DataFrame, by: list[str]) -> DataFrame:
    """Items claimed by more than one stage, with the stages."""
    return (matches.groupBy(*by, "item_code").agg(F.array_sort(F.collect_set("stage")).alias("stages"))
            .where(F.size("stages") > 1))


def completeness(ref: DataFrame, out: DataFrame, price: list[str], by: list[str]) -> DataFrame:
    """Items missing from and extra in the output per group, and the share of priced rows.

    One full join of the two item sets answers both directions.
    """
    key = [*by, "item_code"]
    priced = reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in price])
    mine = ref.where(F.col("item_code").isNotNull()).select(*key).distinct().withColumn("_r", F.lit(1))
    theirs = out.groupBy(*key).agg(F.count("*").alias("_rows"), count_if(priced).alias("_priced"))
    both = mine.join(theirs, key, "full_outer")
    return (both.groupBy(*by).agg(
        F.count("_r").alias("ref_items"), F.coalesce(F.sum("_rows"), F.lit(0)).alias("output_rows"),
        F.coalesce(F.sum("_priced"), F.lit(0)).alias("priced"),
        count_if(F.col("_rows").isNull()).alias("missing"), count_if(F.col("_r").isNull()).alias("extra"))
        .withColumn("priced_pct", share_pct(F.col("priced"), F.col("output_rows"))))


def freshness(df: DataFrame, today: str, by: list[str], date: str = "date") -> DataFrame:
    """Age in days of the latest snapshot per group."""
    return (df.groupBy(*by).agg(F.max(date).alias("latest"))
            .withColumn("age_days", F.datediff(F.lit(today).cast("date"), "latest"))
            .withColumn("state", F.when(F.col("age_days") == 0, "current").otherwise("stale")))


def _name_words(c: str) -> Column:
    return text.words(F.regexp_replace(F.lower(F.col(c)), r"\s+", " "))


def sampled_accuracy(matches: DataFrame, n: int, seed: int, by: list[str], order: list[str],
                     min_jaccard: float = 0.15) -> DataFrame:
    """Accuracy of at most n sampled matches per group (a sampling report).

    The sample is the n smallest values of a seeded hash of the row, so it is repeatable and the
    limit applies before the shuffle. A match is right when the words overlap enough and the brand,
    if known, occurs in the listing's name.
    """
    w = Window.partitionBy(*by).orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), *order)), *order)
    sample = matches.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n)
    a, b = _name_words("ref_name"), _name_words("own_name")
    jaccard = F.size(F.array_intersect(a, b)) / nonzero(F.size(F.array_union(a, b)))
    brand_ok = F.contains(F.lower("own_name"), F.lower(F.trim("ref_brand")))
    right = F.coalesce(jaccard > min_jaccard, F.lit(False)) & F.coalesce(brand_ok, F.lit(True))
    sampled = sample.groupBy(*by).agg(F.count("*").alias("sampled"), count_if(right).alias("correct"))
    totals = matches.groupBy(*by).agg(F.count("*").alias("all_matches"))
    return (sampled.join(totals, by)
            .withColumn("accuracy_pct", share_pct(F.col("correct"), F.col("sampled"))))


# Words of edible and of other goods.
FOOD_WORDS = ["rice", "oil", "flour", "atta", "dal", "sugar", "salt", "noodles", "pasta", "biscuit", "cookie", "chips"]
NONFOOD_WORDS = ["detergent", "soap", "shampoo", "cream", "lotion", "cleaner", "brush", "broom"]


def _mentions(c: str, listed: list[str]) -> Column:
    return F.coalesce(F.lower(F.col(c)).rlike("|".join(listed)), F.lit(False))


def egregious(matches: DataFrame, food: list[str] | None = None, nonfood: list[str] | None = None,
              price_ratio: float = 10.0, weak: float = 0.6) -> DataFrame:
    """Matches of edible with other goods, and weak matches whose prices differ by a factor above 10."""
    food, nonfood = food or FOOD_WORDS, nonfood or NONFOOD_WORDS
    crossed = ((_mentions("ref_name", food) & _mentions("own_name", nonfood))
               | (_mentions("ref_name", nonfood) & _mentions("own_name", food)))
    a, b = F.col("ref_mrp"), F.col("own_price")
    apart = (a > 0) & (b > 0) & (F.greatest(a, b) / F.least(a, b) > price_ratio) & (F.col("score") < weak)
    cause = F.when(crossed, "category").when(apart, "price")
    return matches.withColumn("cause", cause).where(F.col("cause").isNotNull())


def weight_whatif(matches: DataFrame, ref_unit: str, own_unit: str, by: list[str],
                  low: float = 0.8, high: float = 1.25) -> DataFrame:
    """How many matches a mandatory pack filter would keep, and why it would reject the others."""
    df = (matches.withColumn("_r", units.pack(F.col(ref_unit))).withColumn("_o", units.pack(F.col(own_unit)))
          .withColumn("_ru", F.col("_r.unit")).withColumn("_ou", F.col("_o.unit"))
          .withColumn("_ru", units.unit_alias(F.col("_ru"))).withColumn("_ou", units.unit_alias(F.col("_ou"))))
    no_ref = nonzero(F.col("_r.value")).isNull() | F.col("_ru").isNull()
    no_own = nonzero(F.col("_o.value")).isNull() | F.col("_ou").isNull()
    ratio = (units.base_value(F.col("_o.value"), F.col("_ou")) / units.base_value(F.col("_r.value"), F.col("_ru")))
    cause = (F.when(no_ref, "no_reference_pack").when(no_own, "no_own_pack")
             .when(units.family(F.col("_ru")) != units.family(F.col("_ou")), "incompatible_units")
             .when(ratio.between(low, high), "survives").otherwise("ratio_out_of_range"))
    return df.withColumn("cause", cause).groupBy(*by, "cause").agg(F.count("*").alias("n"))


def feed_quality(ref: DataFrame) -> DataFrame:
    """Counts of the known faults of a reference feed, one row per fault."""
    missing_id = text.is_missing(F.col("product_id"))
    complete = F.lower("status") == "complete match"
    per_row = ref.agg(
        count_if(complete & missing_id).alias("complete_without_id"),
        count_if(F.col("status") == "partial Match").alias("label_case"),
        count_if(F.col("partial").isin("MRP-Diff", "MRP DIFF")).alias("label_spelling"),
        count_if(F.trim("partial") == "nan").alias("literal_nan"),
        count_if(F.col("factor") == "#VALUE!").alias("spreadsheet_error"),
        count_if(complete & text.is_missing(F.col("factor"))).alias("complete_without_factor"),
        count_if(F.trim("unit") == "NA").alias("unit_na"))
    names = per_row.columns
    shared = (ref.where(~text.is_missing(F.col("url"))).groupBy("url")
              .agg(F.min("item_code").alias("a"), F.max("item_code").alias("b")).where(F.col("a") != F.col("b"))
              .agg(F.count("*").alias("n")).select(F.lit("url_on_two_items").alias("fault"), "n"))
    return per_row.unpivot([], names, "fault", "n").unionByName(shared)


def expire(df: DataFrame, today: str, days: int = 7, date: str = "date") -> DataFrame:
    """Rows young enough to keep; on data partitioned by date the old partitions are not read."""
    return df.where(F.col(date) >= F.date_sub(F.lit(today).cast("date"), days))


def union_cities(dfs: list[DataFrame]) -> DataFrame:
    """All cities' outputs as one table; columns that a city lacks become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)

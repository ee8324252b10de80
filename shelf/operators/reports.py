"""Coverage, accuracy and summary reports: partial aggregation, then small tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelf.functions.numbers import mean_of, share_pct
from shelf.functions.order_stats import order_statistics
from shelf.operators.compare import at_latest_date, ordinal


def count_if(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def level(pct: Column, good: float = 90, fair: float = 70) -> Column:
    """Traffic light of a percentage."""
    return F.when(pct >= good, "green").when(pct >= fair, "amber").otherwise("red")


# --- stages -----------------------------------------------------------------------------

def stage_coverage(matches: DataFrame, usable: DataFrame, by: list[str]) -> DataFrame:
    """Per stage: items matched, new usable items, cumulative, coverage of the usable items.

    ``usable`` has one row per (by, item_code). An item counts for its first stage only; the
    number matched by a stage is not restricted to usable items, the new ones are.
    """
    key = [*by, "item_code"]
    per_item = (matches.select(*key, "stage").distinct()
                .join(usable.select(*key).withColumn("_usable", F.lit(True)), key, "left")
                .withColumn("_first", F.col("stage") == F.min("stage").over(Window.partitionBy(*key))))
    per_stage = per_item.groupBy(*by, "stage").agg(
        F.count("*").alias("matched"), count_if(F.col("_first") & F.col("_usable")).alias("new_items"))
    n_usable = usable.groupBy(*by).agg(F.count("*").alias("usable"))
    joined = per_stage.join(n_usable, by) if by else per_stage.withColumn(
        "usable", usable.agg(F.count("*")).scalar())
    running = Window.partitionBy(*by).orderBy("stage")
    return (joined.withColumn("cumulative", F.sum("new_items").over(running))
            .withColumn("coverage_pct", share_pct(F.col("cumulative"), F.col("usable"))))


def first_stage_wins(matches: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """One row per item: its earliest stage, the first row of that stage."""
    key = [*by, "item_code"]
    rest = [c for c in matches.columns if c not in key]
    return (matches.groupBy(*key)
            .agg(F.min_by(F.struct(*rest), F.struct(F.col("stage").alias("s"), ordinal(order).alias("o"))).alias("row"))
            .select(*key, "row.*"))


def _accuracy_columns(diff: Column) -> list[Column]:
    size = F.abs(diff)
    return [F.count(diff).alias("compared"),
            *[count_if(size <= limit).alias(f"within_{limit}pct") for limit in (2, 5, 10, 20)],
            count_if(size > 20).alias("beyond_20pct")]


def _accuracy_rates(df: DataFrame) -> DataFrame:
    return df.withColumns({f"accuracy_{limit}pct": share_pct(F.col(f"within_{limit}pct"), F.col("compared"))
                           for limit in (2, 5, 10)})


def accuracy_buckets(df: DataFrame, by: list[str]) -> DataFrame:
    """Compared prices within 2, 5, 10, 20 percent and beyond, with rates."""
    return _accuracy_rates(df.groupBy(*by).agg(*_accuracy_columns(F.col("price_diff_pct"))))


def verification_report(matches: DataFrame, usable: DataFrame, by: list[str],
                        order: list[str]) -> DataFrame:
    """Per (platform, city): usable, matched, coverage, accuracy of the first-stage matches."""
    key = [*by, "item_code"]
    first = (first_stage_wins(matches, by, order)
             .join(usable.select(*key).withColumn("_usable", F.lit(True)), key, "left"))
    per_group = first.groupBy(*by).agg(F.count("*").alias("matched_all"),
                                       F.count("_usable").alias("matched_usable"),
                                       *_accuracy_columns(F.col("price_diff_pct")))
    n_usable = usable.groupBy(*by).agg(F.count("*").alias("usable"))
    zeros = ["matched_all", "matched_usable", "compared", "within_2pct", "within_5pct", "within_10pct",
             "within_20pct", "beyond_20pct"]
    full = n_usable.join(per_group, by, "left").na.fill(0, zeros)
    return (_accuracy_rates(full)
            .withColumn("unmatched", F.col("usable") - F.col("matched_usable"))
            .withColumn("coverage_pct", share_pct(F.col("matched_usable"), F.col("usable")))
            .withColumn("coverage_level", level(F.col("coverage_pct"))))


def report_mismatches(matches: DataFrame, by: list[str], order: list[str], n: int = 15,
                      over: float = 2.0) -> DataFrame:
    """The report's list of the n largest differences per (platform, city)."""
    first = first_stage_wins(matches, by, order).where(F.abs("price_diff_pct") > over)
    w = Window.partitionBy(*by).orderBy(F.abs("price_diff_pct").desc(), "item_code")
    return (first.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
            .select(*by, "rank", "item_code", "stage", "price_diff_pct"))


# --- history dashboards --------------------------------------------------------------------

def _priced(platform: str) -> Column:
    return F.col(f"{platform}_sp").isNotNull()


def _has_status(platform: str, status: str) -> Column:
    return F.col(f"{platform}_status") == status


def coverage_overview(h: DataFrame, platforms: list[str], by: list[str] | None = None) -> DataFrame:
    """Priced, complete and partial counts per city at the latest date."""
    by = by or ["date", "pincode"]
    aggs = [F.count("*").alias("total_products")]
    for p in platforms:
        aggs += [count_if(_priced(p)).alias(f"{p}_priced"),
                 count_if(_has_status(p, "COMPLETE MATCH")).alias(f"{p}_complete"),
                 count_if(_has_status(p, "PARTIAL MATCH")).alias(f"{p}_partial")]
    out = at_latest_date(h).groupBy(*by).agg(*aggs)
    return out.withColumns({f"{p}_coverage_pct": share_pct(F.col(f"{p}_priced"), F.col("total_products"))
                            for p in platforms})


def status_distribution(h: DataFrame, platform: str) -> DataFrame:
    status = F.col(f"{platform}_status")
    return (at_latest_date(h).where(status.isNotNull()).groupBy(status.alias("status"))
            .agg(F.count("*").alias("n")))


def coverage_trend(h: DataFrame, platforms: list[str]) -> DataFrame:
    """Daily coverage and complete-match rate per platform."""
    aggs = [F.count("*").alias("_n")]
    for p in platforms:
        aggs += [count_if(_priced(p)).alias(f"_{p}_priced"),
                 count_if(_has_status(p, "COMPLETE MATCH")).alias(f"_{p}_complete")]
    out = h.groupBy("date").agg(*aggs)
    rates = {}
    for p in platforms:
        rates[f"{p}_pct"] = share_pct(F.col(f"_{p}_priced"), F.col("_n"))
        rates[f"{p}_complete_pct"] = share_pct(F.col(f"_{p}_complete"), F.col("_n"))
    return out.withColumns(rates).select("date", *rates)


def brand_coverage(h: DataFrame, platforms: list[str], min_items: int = 5, top: int = 50) -> DataFrame:
    """The ``top`` largest brands with at least ``min_items`` rows at the latest date."""
    out = (at_latest_date(h).groupBy("brand")
           .agg(F.count("*").alias("total"), *[count_if(_priced(p)).alias(p) for p in platforms])
           .where(F.col("total") >= min_items))
    out = out.withColumns({f"{p}_pct": share_pct(F.col(p), F.col("total"), 0) for p in platforms})
    return out.orderBy(F.desc("total"), "brand").limit(top)


def city_summary(h: DataFrame, platforms: list[str]) -> DataFrame:
    """Match-status counts per day and city."""
    aggs = [F.count("*").alias("products")]
    for p in platforms:
        aggs += [count_if(_has_status(p, "COMPLETE MATCH")).alias(f"{p}_complete"),
                 count_if(_has_status(p, "PARTIAL MATCH")).alias(f"{p}_partial"),
                 count_if(_has_status(p, "NA")).alias(f"{p}_na")]
    return h.groupBy("date", "pincode").agg(*aggs)


def coverage_rollup(usable: DataFrame, matched: DataFrame) -> DataFrame:
    """Usable and matched items per (city, platform), per city, and in total.

    Both inputs have (pincode, platform, item_code); rows with null keys in the output are totals.
    """
    key = ["pincode", "platform", "item_code"]
    flagged = (usable.select(*key).distinct()
               .join(matched.select(*key).distinct().withColumn("_m", F.lit(1)), key, "left"))
    return (flagged.rollup("pincode", "platform")
            .agg(F.count("*").alias("usable"), F.count("_m").alias("matched"))
            .withColumn("coverage_pct", share_pct(F.col("matched"), F.col("usable"))))


# --- distributions ---------------------------------------------------------------------------

def diff_histogram(df: DataFrame, diff: str = "price_diff_pct") -> DataFrame:
    d = F.col(diff)
    bucket = (F.when(d == 0, "exact").when(d <= 2, "0-2").when(d <= 5, "2-5").when(d <= 10, "5-10")
              .when(d <= 20, "10-20").otherwise("20+"))
    return df.where(d.isNotNull()).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


def diff_stats(df: DataFrame, by: list[str], diff: str = "price_diff_pct") -> DataFrame:
    """Mean, exact order statistics and maximum of the price difference."""
    known = df.where(F.col(diff).isNotNull())
    simple = known.groupBy(*by).agg(F.count("*").alias("n"), mean_of(F.col(diff)).alias("mean"),
                                    F.max(diff).alias("max"))
    ranks = order_statistics(known, by, diff, {"median": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99})
    return simple.join(ranks, by)


def score_buckets(df: DataFrame, score: str = "score") -> DataFrame:
    s = F.col(score)
    bucket = F.when(s >= 0.9, "0.9+").when(s >= 0.7, "0.7-0.9").otherwise("0.5-0.7")
    return df.where(s >= 0.5).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


def reason_counts(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"))


def city_variation(offers: DataFrame, order: list[str]) -> DataFrame:
    """(max − min) / min over cities per item and platform, for items priced in two or more cities."""
    per_city = (offers.groupBy("item_code", "platform", "pincode")
                .agg(F.max_by("sp", ordinal(order)).alias("sp")))
    return (per_city.groupBy("item_code", "platform")
            .agg(F.count("*").alias("cities"), F.min("sp").alias("low"), F.max("sp").alias("high"))
            .where((F.col("cities") >= 2) & (F.col("low") > 0))
            .withColumn("variation_pct", (F.col("high") - F.col("low")) / F.col("low") * 100))


def wild_variations(variation: DataFrame, over: float = 50.0) -> DataFrame:
    return variation.where(F.col("variation_pct") > over)


def variation_summary(variation: DataFrame, by: list[str]) -> DataFrame:
    """Median, 90th percentile and bands of the city variation."""
    v = F.col("variation_pct")
    bands = variation.groupBy(*by).agg(
        F.count("*").alias("n"), count_if(v < 5).alias("below_5"), count_if((v >= 5) & (v < 20)).alias("from_5"),
        count_if((v >= 20) & (v < 50)).alias("from_20"), count_if(v >= 50).alias("from_50"))
    ranks = order_statistics(variation, by, "variation_pct", {"median": 0.5, "p90": 0.9})
    return bands.join(ranks, by)


def delta_summary(df: DataFrame, by: list[str]) -> DataFrame:
    """Share of items found anywhere, and how many are cheaper, costlier or the same."""
    colour = F.col("colour")
    out = df.groupBy(*by).agg(
        F.count("*").alias("total"), count_if(colour != "missing").alias("found"),
        count_if(colour == "cheaper").alias("cheaper"), count_if(colour == "costlier").alias("costlier"),
        count_if(colour == "same").alias("same"), mean_of(F.col("delta"), 4).alias("mean_delta"))
    return out.withColumn("found_pct", share_pct(F.col("found"), F.col("total")))


def platform_match_rates(found: DataFrame, n_ref: DataFrame, platforms: list[str]) -> DataFrame:
    """Matched items per platform over all reference items, platforms without a match included."""
    per = (found.groupBy("item_code").pivot("platform", platforms).agg(F.count(F.lit(1)))
           .agg(*[count_if(F.col(p) > 0).alias(p) for p in platforms]))
    return (per.unpivot([], platforms, "platform", "matched")
            .withColumn("total", n_ref.agg(F.count("*")).scalar())
            .withColumn("match_pct", share_pct(F.col("matched"), F.col("total"))))


# --- run reports --------------------------------------------------------------------------------

def run_summary(h: DataFrame, platforms: list[str]) -> DataFrame:
    """Rows and priced rows per platform for each city."""
    return h.groupBy("pincode").agg(
        F.count("*").alias("rows"),
        *[count_if(F.col(f"{p}_sp").isNotNull() & (F.col(f"{p}_sp") != 0)).alias(f"{p}_ok") for p in platforms])


def key_item_coverage(h: DataFrame, key_items: DataFrame, cities: DataFrame, platforms: list[str]) -> DataFrame:
    """Coverage of each state's key items in each of its cities.

    ``key_items`` has (state, item_code, tag); ``cities`` has (pincode, state).
    """
    wanted = key_items.join(cities.select("pincode", "state"), "state")
    priced = {p: F.coalesce(F.col(f"{p}_sp"), F.lit(0.0)) != 0 for p in platforms}
    found = wanted.join(h.select("pincode", "item_code", *[f"{p}_sp" for p in platforms]),
                        ["pincode", "item_code"], "left")
    either = priced[platforms[0]]
    for p in platforms[1:]:
        either = either | priced[p]
    is_super = F.contains(F.lower("tag"), F.lit("super"))
    out = found.groupBy("state", "pincode").agg(
        F.count("*").alias("items"), count_if(either).alias("either"),
        *[count_if(priced[p]).alias(f"{p}_items") for p in platforms],
        count_if(is_super).alias("super_items"),
        *[count_if(is_super & priced[p]).alias(f"{p}_super") for p in platforms])
    return out.withColumn("either_pct", share_pct(F.col("either"), F.col("items"), 0))


def method_mix(h: DataFrame, method: str, price: str, by: list[str]) -> DataFrame:
    """Priced rows by the method that produced them."""
    return h.where(F.col(price).isNotNull()).groupBy(*by, method).agg(F.count("*").alias("n"))


def city_overlap(df: DataFrame) -> DataFrame:
    """How many items are tracked in N cities."""
    per_item = (df.select("item_code", "pincode").distinct()
                .groupBy("item_code").agg(F.count("*").alias("cities")))
    out = per_item.groupBy("cities").agg(F.count("*").alias("items"))
    return out.withColumn("share", share_pct(F.col("items"), F.sum("items").over(Window.partitionBy()), 0))


def category_coverage(catalogue: DataFrame, ref: DataFrame) -> DataFrame:
    """Items of each category tracked by the reference feed."""
    tracked = ref.select("item_code").distinct().withColumn("_t", F.lit(1))
    out = (catalogue.join(tracked, "item_code", "left").groupBy("category")
           .agg(F.count("*").alias("active"), F.count("_t").alias("tracked")))
    return out.withColumn("coverage_pct", share_pct(F.col("tracked"), F.col("active")))


def top_brands(ref: DataFrame, k: int = 10) -> DataFrame:
    return (ref.groupBy("brand").agg(F.count("*").alias("items"))
            .orderBy(F.desc("items"), "brand").limit(k))


def compare_metrics(m: DataFrame, mapped: DataFrame, by: list[str]) -> DataFrame:
    """Key-match run metrics: status counts, coverage of the mapped items, ±2/5/10 % rates.

    ``mapped`` has one row per mapped reference item (with the ``by`` columns).
    """
    diff = F.col("price_diff_pct")
    status = F.col("match_status")
    per = m.groupBy(*by).agg(
        count_if(status == "ok").alias("ok"),
        count_if(status.isin("no_price", "not_available")).alias("no_price"),
        count_if(status == "error").alias("errors"), F.count(diff).alias("price_compared"),
        *[count_if(diff <= x).alias(f"price_match_{x}pct") for x in (2, 5, 10)])
    total = mapped.groupBy(*by).agg(F.count("*").alias("mapped"))
    joined = total.join(per, by, "left").na.fill(0)
    rates = {f"price_match_pct_{x}": share_pct(F.col(f"price_match_{x}pct"), F.col("price_compared")) for x in (2, 5, 10)}
    return (joined.withColumn("coverage_pct", share_pct(F.col("ok"), F.col("mapped"))).withColumns(rates)
            .withColumn("coverage_level", level(F.col("coverage_pct"))))


def pricing_summary(r: DataFrame, by: list[str]) -> DataFrame:
    """Totals of a pricing run: key items, promotions, flags."""
    return r.groupBy(*by).agg(
        F.count("*").alias("total"),
        count_if(F.upper("kvi_tag").isin("KVI", "SUPER KVI")).alias("key_items"),
        count_if(F.col("final_invoice_value") > 0).alias("with_promo"),
        count_if(F.size("flags") > 0).alias("flagged"))


def rule_distribution(r: DataFrame, by: list[str]) -> DataFrame:
    return r.groupBy(*by, "rule_applied").agg(F.count("*").alias("n"))


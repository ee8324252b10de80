"""Cross-platform comparison, ranking and change detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelf.functions.numbers import round_to, total_of
from shelf.functions.text import strip
from shelf.operators.ordered import previous_value
from shelf.session import materialize


def ordinal(cols: list[str]) -> Column:
    """One sortable arrival order out of several columns."""
    return F.struct(*[F.col(c) for c in cols])


def _product_key(name: str) -> Column:
    return F.lower(strip(F.col(name)))


def _chosen_offers(offers: DataFrame, order: list[str]) -> DataFrame:
    """One row per product, city and platform: the last positive offer, else the last offer.

    A later offer without a price never replaces a priced one.
    """
    return (offers.withColumn("product_key", _product_key("product_name"))
            .where(F.col("product_key") != "")
            .groupBy("product_key", "pincode", "platform")
            .agg(F.max_by(F.struct("sp", "mrp", "in_stock"),
                          F.struct((F.col("sp") > 0).alias("priced"), ordinal(order).alias("at"))
                          ).alias("offer")))


def price_comparison(offers: DataFrame, platforms: list[str], order: list[str]) -> DataFrame:
    """One row per (product, city) with a price and an MRP column per platform."""
    wide = (_chosen_offers(offers, order).groupBy("product_key", "pincode")
            .pivot("platform", platforms).agg(F.first("offer")))

    def shown(platform: str, field: str) -> Column:
        value = F.col(f"`{platform}`.{field}")
        priced = value > 0
        return F.when(priced, value).alias(f"{platform}_{'price' if field == 'sp' else field}")

    return wide.select("product_key", "pincode",
                       *[shown(p, f) for p in platforms for f in ("sp", "mrp")])


def cheapest(offers: DataFrame, order: list[str]) -> DataFrame:
    """Cheapest platform, cheapest and highest price and their spread, positive prices only.

    Among equally cheap platforms the first in name order is reported.
    """
    priced = _chosen_offers(offers, order).where(F.col("offer.sp") > 0)
    price = F.col("offer.sp")
    return (priced.groupBy("product_key", "pincode")
            .agg(F.min_by("platform", F.struct(price.alias("p"), F.col("platform").alias("n"))
                          ).alias("cheapest_platform"),
                 F.min(price).alias("cheapest_price"), F.max(price).alias("highest_price"))
            .withColumn("spread", F.col("highest_price") - F.col("cheapest_price")))


def multi_platform(offers: DataFrame, order: list[str], by: tuple[str, ...] = ("pincode",)) -> DataFrame:
    """Offers of products sold on two or more platforms of one city, the lowest price flagged.

    ``by=()`` compares across cities.
    """
    key = F.lower(strip(F.regexp_replace("product_name", r"\s+", " ")))
    last = (offers.withColumn("product_key", key).where(F.col("product_key") != "")
            .groupBy("product_key", *by, "platform")
            .agg(F.max_by(F.struct("sp", "mrp", "in_stock"), ordinal(order)).alias("o")))
    all_platforms = Window.partitionBy("product_key", *by)
    return (last.select("product_key", *by, "platform", "o.sp", "o.mrp", "o.in_stock")
            .withColumn("n_platforms", F.count("*").over(all_platforms))
            .withColumn("is_lowest", F.col("sp") == F.min("sp").over(all_platforms))
            .where(F.col("n_platforms") >= 2))


def delta_vs_reference(ref: DataFrame, offers: DataFrame, key: str = "item_code",
                       tolerance: float = 0.5, by: tuple[str, ...] = ("pincode",)) -> DataFrame:
    """Best price over the platforms of a city against the reference price, with a colour class.

    A row for every item of ``ref`` and every city of the offers; ``by=()`` takes the best price of
    all cities. ``ref`` carries ``ref_sp`` and ``ref_mrp``; the SP counts, or the MRP where SP is missing or 0.
    """
    best = (offers.groupBy(*by, key)
            .agg(F.min_by("platform", F.when(F.col("sp").isNotNull(), F.struct(F.col("sp").alias("p"), F.col("platform").alias("n")))
                          ).alias("best_platform"), F.min("sp").alias("best_price")))
    ref_price = F.coalesce(F.when(F.col("ref_sp") != 0, F.col("ref_sp")), F.col("ref_mrp"))
    delta = F.when((ref_price > 0), F.col("best_price") - ref_price)
    colour = (F.when(F.col("best_price").isNull(), "missing").when(delta.isNull(), "no_reference")
              .when(delta < -tolerance, "cheaper").when(delta > tolerance, "costlier")
              .otherwise("same"))
    items = ref.select(key, "ref_sp", "ref_mrp")
    if by:
        # cities are a small dimension: their list goes into each item's row
        cities = offers.agg(F.array_sort(F.collect_set(F.struct(*by)))).scalar()
        items = items.select("*", F.explode(cities).alias("_city")).select(key, "ref_sp", "ref_mrp", "_city.*")
    return (items.join(best, [*by, key], "left")
            .withColumn("delta", delta).withColumn("colour", colour))


def at_latest_date(df: DataFrame, date: str = "date") -> DataFrame:
    """Rows of the latest date; on data partitioned by date only that partition is read."""
    return df.where(F.col(date) == df.agg(F.max(date)).scalar())


def top_price_diffs(df: DataFrame, k: int = 50, tie: str = "item_code",
                    own: str = "own_price", ref: str = "ref_price") -> DataFrame:
    """The k rows that differ most from the reference price (a top-k report)."""
    return (df.where(F.col(own).isNotNull() & (F.col(ref) > 0))
            .withColumn("diff_pct", round_to(F.abs(F.col(own) - F.col(ref)) / F.col(ref) * 100, 1))
            .orderBy(F.desc("diff_pct"), tie).limit(k))


def top_mismatches(df: DataFrame, n: int = 15, over: float = 2.0) -> DataFrame:
    """The n items with the largest difference above ``over`` percent, one row per item."""
    return (df.where(F.abs("price_diff_pct") > over).groupBy("item_code")
            .agg(F.max(F.abs("price_diff_pct")).alias("price_diff_pct"))
            .orderBy(F.desc("price_diff_pct"), "item_code").limit(n))


def demand_weight(df: DataFrame, value: str, part: list[str], total: Column | None = None) -> DataFrame:
    """Share of each row in the total of its partition, 0 where nothing was sold.

    The totals are aggregated first and joined back, so that no task holds a whole partition. ``total`` gives the
    total of the whole table where it is known from a smaller one, as a scalar subquery say.
    """
    if total is not None:
        joined = df.withColumn("total_value", total)
    elif not part:
        # the rows feed the total and the result: they are computed once
        df = materialize(df)
        joined = df.withColumn("total_value", df.agg(total_of(F.col(value))).scalar())
    else:
        totals = df.groupBy(*part).agg(total_of(F.col(value)).alias("total_value"))
        joined = df.join(totals, part, "left")
    weight = F.when(F.col("total_value") > 0, F.col(value) / F.col("total_value")).otherwise(0.0)
    return joined.withColumn("demand_weight", weight).drop("total_value")


def changes(df: DataFrame, keys: list[str], order: list[str], price: str = "sp",
            status: str = "status") -> DataFrame:
    """Each snapshot row next to the previous one of its key: did price or status change?"""
    seen = previous_value(df, keys, order, F.struct(F.col(price).alias("price"), F.col(status).alias("status")), "_previous")
    known = F.col("_previous").isNotNull()
    return (seen.withColumn("previous_price", F.col("_previous.price")).withColumn("previous_status", F.col("_previous.status"))
            .withColumn("price_changed", known & ~F.col("previous_price").eqNullSafe(F.col(price)))
            .withColumn("status_changed", known & ~F.col("previous_status").eqNullSafe(F.col(status))).drop("_previous"))


def mapping_stability(df: DataFrame, item: str = "item_code", product: str = "product_id") -> DataFrame:
    """How many items were mapped to 1, 2, 3 … distinct products over time."""
    # distinct pairs first: a hot item collapses before its products are counted
    per_item = (df.where(F.col(product).isNotNull()).select(item, product).distinct()
                .groupBy(item).agg(F.count("*").alias("distinct_products")))
    return per_item.groupBy("distinct_products").agg(F.count("*").alias("items"))


def last_nonzero(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Last row per key; a row with value 0 never replaces an earlier one of the same key."""
    rest = [c for c in df.columns if c not in keys]
    positive = F.max_by(F.struct(*rest), F.when(F.col(value) > 0, ordinal(order)))
    fallback = F.min_by(F.struct(*rest), ordinal(order))
    return (df.groupBy(*keys).agg(positive.alias("p"), fallback.alias("f"))
            .select(*keys, F.coalesce("p", "f").alias("row")).select(*keys, "row.*"))


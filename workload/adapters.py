"""The driver's tables seen as offers, listings, feeds, history and matches.

Every concept exists twice: as a DataFrame and as the SQL of a view, so that a query
and its SQL twin start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from workload.base import Tables

PLATFORMS = ["p0", "p1", "p2"]

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {}


def with_views(names: list[str], body: str) -> str:
    """Prefix ``body`` with the named views and whatever they build on."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for needed in VIEWS[name][0]:
            visit(needed)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    if not ordered:
        return body.strip()
    ctes = ",\n".join(f"{n} AS ({VIEWS[n][1].strip()})" for n in ordered)
    body = body.strip()
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


# --- offers: one row per order line -------------------------------------------------

VIEWS["offers"] = ((), """
SELECT l_partkey AS item_code, p_name AS product_name, p_brand AS brand, p_type AS category,
       p_size AS pack_size, 'p' || CAST(l_suppkey % 3 AS VARCHAR) AS platform,
       CAST(l_suppkey % 5 AS INTEGER) AS pincode, p_retailprice * (1 - l_discount) AS sp,
       p_retailprice AS mrp, l_extendedprice / l_quantity AS unit_price,
       CAST(l_shipdate AS DATE) AS date, l_returnflag <> 'R' AS in_stock,
       CASE WHEN l_tax <= 0.02 THEN 'COMPLETE MATCH' WHEN l_tax <= 0.06 THEN 'PARTIAL MATCH'
            ELSE 'SEMI COMPLETE MATCH' END AS status,
       l_tax AS tax, l_discount AS discount, l_quantity AS quantity,
       l_orderkey AS o1, l_linenumber AS o2, l_suppkey AS o3
FROM lineitem JOIN part ON l_partkey = p_partkey""")


def _status(tax):
    return F.when(tax <= 0.02, "COMPLETE MATCH").when(tax <= 0.06, "PARTIAL MATCH").otherwise("SEMI COMPLETE MATCH")


def _line_columns():
    """What an offer has from its line alone, by name."""
    c = F.col
    columns = {"item_code": c("l_partkey"), "platform": F.concat(F.lit("p"), (c("l_suppkey") % 3).cast("string")),
               "pincode": (c("l_suppkey") % 5).cast("int"), "date": c("l_shipdate").cast("date"), "in_stock": c("l_returnflag") != "R",
               "tax": c("l_tax"), "discount": c("l_discount"), "quantity": c("l_quantity"), "o1": c("l_orderkey"), "o2": c("l_linenumber"), "o3": c("l_suppkey")}
    return {name: column.alias(name) for name, column in columns.items()}


def offers(t: Tables, merged: bool = False) -> DataFrame:
    """``merged``: lines and parts are merged whatever the size of the parts' file, which the driver would hold to broadcast it."""
    part = t.part.hint("merge") if merged else t.part
    joined = t.lineitem.join(part, F.col("l_partkey") == F.col("p_partkey"))
    line = _line_columns()
    return joined.select(
        line["item_code"], F.col("p_name").alias("product_name"),
        F.col("p_brand").alias("brand"), F.col("p_type").alias("category"),
        F.col("p_size").alias("pack_size"), line["platform"], line["pincode"],
        (F.col("p_retailprice") * (1 - F.col("l_discount"))).alias("sp"),
        F.col("p_retailprice").alias("mrp"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"),
        line["date"], line["in_stock"], _status(F.col("l_tax")).alias("status"),
        *[line[x] for x in ("tax", "discount", "quantity", "o1", "o2", "o3")])


OFFER_ORDER = ["o1", "o2", "o3"]


def offer_order():
    """Arrival order of offers of one item: unique together with the item."""
    return F.struct(*OFFER_ORDER)


# --- history: one row per date, city and item, columns per platform -------------------

_HISTORY_PLATFORM = ",\n".join(
    f"max(CASE WHEN platform = '{p}' AND in_stock THEN sp END) AS {p}_sp,\n"
    f"max(CASE WHEN platform = '{p}' AND in_stock THEN mrp END) AS {p}_mrp,\n"
    f"coalesce(max(CASE WHEN platform = '{p}' AND in_stock THEN status END), 'NA') AS {p}_status"
    for p in PLATFORMS)
VIEWS["latest_offer"] = (("offers",), """
SELECT * FROM offers QUALIFY row_number() OVER (
    PARTITION BY date, pincode, item_code, platform ORDER BY o1 DESC, o2 DESC, o3 DESC) = 1""")
VIEWS["history"] = (("latest_offer",), f"""
SELECT date, pincode, item_code, product_name, brand, category, mrp AS am_mrp,
{_HISTORY_PLATFORM}
FROM latest_offer GROUP BY ALL""")


def history(t: Tables) -> DataFrame:
    chosen = (offers(t).groupBy("date", "pincode", "item_code", "product_name", "brand", "category",
                                F.col("mrp").alias("am_mrp"))
              .pivot("platform", PLATFORMS)
              .agg(F.max_by(F.struct("sp", "mrp", "status", "in_stock"), offer_order())))
    columns = ["date", "pincode", "item_code", "product_name", "brand", "category", "am_mrp"]
    for p in PLATFORMS:
        shown = F.when(F.col(f"{p}.in_stock"), F.col(p))
        columns += [shown["sp"].alias(f"{p}_sp"), shown["mrp"].alias(f"{p}_mrp"),
                    F.coalesce(shown["status"], F.lit("NA")).alias(f"{p}_status")]
    return chosen.select(*columns)


VIEWS["live"] = (("history",), """
SELECT * FROM history QUALIFY row_number() OVER (PARTITION BY pincode, item_code ORDER BY date DESC) = 1""")


def live(t: Tables) -> DataFrame:
    """One pass over the lines: of each city and item the latest date, and of each platform the last offer, which shows if it is of that date.

    What comes from the items joins the result, not the lines. All rows of an item have the same lines, so any one of them will do.
    """
    c = F.col
    last = F.struct("date", *OFFER_ORDER, "discount", "tax", "in_stock")
    per = t.lineitem.select(*_line_columns().values()).groupBy("pincode", "item_code").agg(
        F.max("date").alias("date"), *[F.max(F.when(c("platform") == p, last)).alias(p) for p in PLATFORMS])
    items = t.part.groupBy("p_partkey").agg(F.max(F.struct("p_name", "p_brand", "p_type", "p_retailprice")).alias("_item"))
    dated = F.when(c("date").isNotNull(), c("_item"))
    columns = ["pincode", "item_code", "date", dated["p_name"].alias("product_name"), dated["p_brand"].alias("brand"),
               dated["p_type"].alias("category"), dated["p_retailprice"].alias("am_mrp")]
    for p in PLATFORMS:
        shown = F.when((c(f"{p}.date") == c("date")) & c(f"{p}.in_stock"), c(p))
        price = F.when(shown.isNotNull(), c("_item.p_retailprice"))
        columns += [(price * (1 - shown["discount"])).alias(f"{p}_sp"), price.alias(f"{p}_mrp"),
                    F.when(c("date").isNotNull(), F.when(shown.isNotNull(), _status(shown["tax"])).otherwise("NA")).alias(f"{p}_status")]
    return per.join(items, c("item_code") == c("p_partkey")).select(*columns)


# --- cities: a fixed dimension --------------------------------------------------------

VIEWS["cities"] = ((), """
SELECT n_nationkey AS pincode, n_name AS city, r_name AS state
FROM nation JOIN region ON n_regionkey = r_regionkey""")


def cities(t: Tables) -> DataFrame:
    return (t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
            .select(F.col("n_nationkey").alias("pincode"), F.col("n_name").alias("city"),
                    F.col("r_name").alias("state")))


# --- matches: the long form of every stage's output ------------------------------------

VIEWS["matches"] = ((), """
SELECT CAST(CASE WHEN l_linenumber <= 2 THEN 1 ELSE l_linenumber - 1 END AS INTEGER) AS stage,
       'p' || CAST(l_suppkey % 3 AS VARCHAR) AS platform,
       CAST(l_suppkey % 5 AS INTEGER) AS pincode, l_partkey AS item_code,
       p_name AS ref_name, p_brand AS ref_brand, p_retailprice AS ref_sp, p_retailprice AS ref_mrp,
       CASE WHEN l_linenumber = 7 THEN l_extendedprice / l_quantity
            ELSE p_retailprice * (1 - l_discount) END AS own_price,
       l_partkey * 10 + l_suppkey % 3 AS own_product_id,
       p_name || ' ' || lower(p_type) || CASE WHEN l_tax > 0.03 THEN ' ' || p_brand ELSE '' END AS own_name,
       CAST(p_size AS VARCHAR) || CASE WHEN l_tax > 0.06 THEN ' ml' ELSE ' g' END AS own_unit,
       CAST(p_size AS VARCHAR) || CASE WHEN l_discount > 0.08 THEN ' pc' ELSE ' g' END AS ref_unit,
       CASE WHEN l_tax = 0 THEN 'ok' WHEN l_tax < 0.02 THEN 'no_price' WHEN l_tax < 0.03 THEN 'error'
            ELSE 'ok' END AS status,
       1 - l_tax * 10 AS score, l_orderkey AS o1, l_linenumber AS o2, l_suppkey AS o3,
       abs(CASE WHEN l_linenumber = 7 THEN l_extendedprice / l_quantity
                ELSE p_retailprice * (1 - l_discount) END - p_retailprice)
           / p_retailprice * 100 AS price_diff_pct
FROM lineitem JOIN part ON l_partkey = p_partkey""")


def matches(t: Tables) -> DataFrame:
    c = F.col
    own = F.when(c("l_linenumber") == 7, c("l_extendedprice") / c("l_quantity")).otherwise(
        c("p_retailprice") * (1 - c("l_discount")))
    size = c("p_size").cast("string")
    return t.lineitem.join(t.part, c("l_partkey") == c("p_partkey")).select(
        F.when(c("l_linenumber") <= 2, 1).otherwise(c("l_linenumber") - 1).cast("int").alias("stage"),
        F.concat(F.lit("p"), (c("l_suppkey") % 3).cast("string")).alias("platform"),
        (c("l_suppkey") % 5).cast("int").alias("pincode"), c("l_partkey").alias("item_code"),
        c("p_name").alias("ref_name"), c("p_brand").alias("ref_brand"),
        c("p_retailprice").alias("ref_sp"), c("p_retailprice").alias("ref_mrp"),
        own.alias("own_price"),
        (c("l_partkey") * 10 + c("l_suppkey") % 3).alias("own_product_id"),
        F.concat(c("p_name"), F.lit(" "), F.lower("p_type"),
                 F.when(c("l_tax") > 0.03, F.concat(F.lit(" "), c("p_brand"))).otherwise("")
                 ).alias("own_name"),
        F.concat(size, F.when(c("l_tax") > 0.06, " ml").otherwise(" g")).alias("own_unit"),
        F.concat(size, F.when(c("l_discount") > 0.08, " pc").otherwise(" g")).alias("ref_unit"),
        (F.when(c("l_tax") == 0, "ok").when(c("l_tax") < 0.02, "no_price")
         .when(c("l_tax") < 0.03, "error").otherwise("ok")).alias("status"),
        (1 - c("l_tax") * 10).alias("score"), c("l_orderkey").alias("o1"),
        c("l_linenumber").alias("o2"), c("l_suppkey").alias("o3"),
        (F.abs(own - c("p_retailprice")) / c("p_retailprice") * 100).alias("price_diff_pct"))


MATCH_ORDER = ["o1", "o2", "o3"]


# --- reference items and platform listings, for the matching joins -----------------------

VIEWS["refs"] = ((), """
SELECT p_partkey AS item_code, p_name AS name,
       p_brand || CASE WHEN p_size > 40 THEN ' Pvt. Ltd.' ELSE '' END AS brand,
       p_type AS product_type, CASE WHEN p_size > 25 THEN 'gm' ELSE 'kg' END AS unit,
       CAST(CASE WHEN p_size = 50 THEN 0 ELSE p_size END AS DOUBLE) AS unit_value,
       p_retailprice AS mrp, p_retailprice * 0.9 AS sp,
       CAST(8900000000 + p_partkey AS VARCHAR) AS barcode
FROM part""")


def refs(t: Tables) -> DataFrame:
    c = F.col
    return t.part.select(
        c("p_partkey").alias("item_code"), c("p_name").alias("name"),
        F.concat(c("p_brand"), F.when(c("p_size") > 40, " Pvt. Ltd.").otherwise("")).alias("brand"),
        c("p_type").alias("product_type"),
        F.when(c("p_size") > 25, "gm").otherwise("kg").alias("unit"),
        F.when(c("p_size") == 50, 0.0).otherwise(c("p_size").cast("double")).alias("unit_value"),
        c("p_retailprice").alias("mrp"), (c("p_retailprice") * 0.9).alias("sp"),
        (F.lit(8900000000) + c("p_partkey")).cast("string").alias("barcode"))


# One listing per part and platform that sold it; its text, pack and price vary by platform.
VIEWS["listings"] = (("offers",), """
SELECT item_code * 3 + CASE platform WHEN 'p0' THEN 0 WHEN 'p1' THEN 1 ELSE 2 END AS product_id,
       item_code AS source_item,
       CASE platform WHEN 'p0' THEN product_name WHEN 'p1' THEN product_name || ' new'
            ELSE 'The ' || upper(product_name) END AS name,
       CASE WHEN platform = 'p1' THEN lower(brand) ELSE brand END AS brand, category,
       CASE WHEN pack_size > 25 THEN CAST(pack_size AS VARCHAR) ||
                 CASE platform WHEN 'p0' THEN ' g' WHEN 'p1' THEN 'gm' ELSE ' ml' END
            ELSE CASE platform WHEN 'p0' THEN CAST(pack_size AS VARCHAR) || ' kg'
                 WHEN 'p1' THEN CAST(pack_size AS VARCHAR) || ' x 1000 g'
                 ELSE CAST(pack_size + 1 AS VARCHAR) || ' kg' END END AS unit,
       platform, price, mrp,
       CASE WHEN mrp > 990 THEN '8900000000' ELSE CAST(8900000000 + item_code AS VARCHAR) END AS barcode
FROM (SELECT item_code, platform, product_name, brand, category, pack_size,
             min(sp) AS price, max(mrp) AS mrp FROM offers GROUP BY ALL)""")


def listings(t: Tables, *by: str) -> DataFrame:
    """``by``: further columns of the offers, each value of which has listings of its own."""
    return _listed(offers(t).groupBy("item_code", "platform", *by, "product_name", "brand", "category", "pack_size")
                   .agg(F.min("sp").alias("price"), F.max("mrp").alias("mrp")), by)


def listings_of_groups(t: Tables) -> DataFrame:
    """The rows of ``listings``, of lines that are grouped by numbers alone before they meet the items, so what a task holds of its groups stays small.

    An item's price falls with the discount (it rises where the price is below 0), so of all lines of a group two tell the least price.
    Of listings with one product_id, as of lines without a supplier, another one may come first.
    """
    c = F.col
    line = _line_columns()
    lines = t.lineitem.select(line["item_code"], (c("l_suppkey") % 3).alias("_platform"), "l_discount")
    number = F.when(~F.isnan(c("l_discount").cast("double")), c("l_discount"))
    extremes = (lines.groupBy("item_code", "_platform")
                .agg(F.min("l_discount").alias("_any"), F.min(number).alias("_low"), F.max(number).alias("_high")))

    def price(discount: str):
        return c("p_retailprice") * (1 - F.coalesce(discount, "_any"))

    sold = (extremes.withColumn("platform", F.concat(F.lit("p"), c("_platform").cast("string"))).join(t.part, c("item_code") == c("p_partkey"))
            .groupBy("item_code", "platform", c("p_name").alias("product_name"), c("p_brand").alias("brand"), c("p_type").alias("category"),
                     c("p_size").alias("pack_size"))
            .agg(F.min(F.least(price("_low"), price("_high"))).alias("price"), F.max("p_retailprice").alias("mrp")))
    return _listed(sold)


def _listed(sold: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    c = F.col
    p = c("platform")
    size = c("pack_size").cast("string")
    small = (F.when(p == "p0", F.concat(size, F.lit(" kg")))
             .when(p == "p1", F.concat(size, F.lit(" x 1000 g")))
             .otherwise(F.concat((c("pack_size") + 1).cast("string"), F.lit(" kg"))))
    large = F.concat(size, F.when(p == "p0", " g").when(p == "p1", "gm").otherwise(" ml"))
    return sold.select(
        (c("item_code") * 3 + F.when(p == "p0", 0).when(p == "p1", 1).otherwise(2)).alias("product_id"),
        c("item_code").alias("source_item"),
        F.when(p == "p0", c("product_name")).when(p == "p1", F.concat("product_name", F.lit(" new")))
        .otherwise(F.concat(F.lit("The "), F.upper("product_name"))).alias("name"),
        F.when(p == "p1", F.lower("brand")).otherwise(c("brand")).alias("brand"), "category",
        F.when(c("pack_size") > 25, large).otherwise(small).alias("unit"), "platform", *by, "price", "mrp",
        F.when(c("mrp") > 990, "8900000000").otherwise(
            (F.lit(8900000000) + c("item_code")).cast("string")).alias("barcode"))


# --- the all-text reference feed ----------------------------------------------------------

VIEWS["feed"] = ((), """
SELECT CAST(p_partkey AS VARCHAR) AS item_code,
       p_name || CASE WHEN p_type = 'PROMO' THEN ' Loose' ELSE '' END AS item_name,
       CASE WHEN p_size % 11 = 0 THEN ' nan ' ELSE p_brand END AS brand,
       CASE WHEN p_size % 7 = 0 THEN 'NA' ELSE CAST(p_size AS VARCHAR) || ' gm' END AS unit,
       'Rs. ' || CAST(p_retailprice AS VARCHAR) || '/-' AS mrp,
       CASE WHEN p_size % 10 = 0 THEN '#VALUE!' WHEN p_size % 10 = 1 THEN ''
            ELSE '₹' || CAST(p_retailprice AS VARCHAR) END AS sp,
       CASE WHEN p_size % 3 = 0 THEN 'Complete Match' WHEN p_size % 3 = 1 THEN 'partial Match'
            ELSE 'Semi Complete Match' END AS status,
       CASE WHEN p_size % 4 = 0 THEN 'MRP Diff' WHEN p_size % 4 = 1 THEN 'MRP-Diff'
            WHEN p_size % 4 = 2 THEN 'MRP DIFF' ELSE 'nan' END AS partial,
       CASE WHEN p_size = 13 THEN '#VALUE!' WHEN p_size = 14 THEN NULL ELSE '1' END AS factor,
       CASE WHEN p_size % 6 = 0 THEN 'NA' ELSE CAST(p_partkey * 7 AS VARCHAR) END AS product_id,
       'http://shop.example/' || p_name || '/' || p_brand AS url
FROM part""")


def feed(t: Tables) -> DataFrame:
    c = F.col
    size = c("p_size")
    text = c("p_retailprice").cast("string")
    return t.part.select(
        c("p_partkey").cast("string").alias("item_code"),
        F.concat(c("p_name"), F.when(c("p_type") == "PROMO", " Loose").otherwise("")).alias("item_name"),
        F.when(size % 11 == 0, " nan ").otherwise(c("p_brand")).alias("brand"),
        F.when(size % 7 == 0, "NA").otherwise(F.concat(size.cast("string"), F.lit(" gm"))).alias("unit"),
        F.concat(F.lit("Rs. "), text, F.lit("/-")).alias("mrp"),
        F.when(size % 10 == 0, "#VALUE!").when(size % 10 == 1, "")
        .otherwise(F.concat(F.lit("₹"), text)).alias("sp"),
        F.when(size % 3 == 0, "Complete Match").when(size % 3 == 1, "partial Match")
        .otherwise("Semi Complete Match").alias("status"),
        F.when(size % 4 == 0, "MRP Diff").when(size % 4 == 1, "MRP-Diff")
        .when(size % 4 == 2, "MRP DIFF").otherwise("nan").alias("partial"),
        F.when(size == 13, "#VALUE!").when(size == 14, F.lit(None)).otherwise("1").alias("factor"),
        F.when(size % 6 == 0, "NA").otherwise((c("p_partkey") * 7).cast("string")).alias("product_id"),
        F.concat(F.lit("http://shop.example/"), c("p_name"), F.lit("/"), c("p_brand")).alias("url"))

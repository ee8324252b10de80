"""Source, sink and extraction queries. Payload texts are built by Spark from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shelf.operators import extract as x
from shelf.sources import feeds, tables
from shelf.streaming.ingest import ingest_stream as ingest_stream_of
from workload import adapters as a
from workload.base import Tables, query, scratch

P = a.PLATFORMS


@query(views="feed", sql="""SELECT item_code, coalesce(nullif(sp, ''), nullif(mrp, '')) AS price, nullif(item_name, '') AS name, CAST(NULL AS VARCHAR) AS eta FROM feed""")
def resolve_aliases(t: Tables):
    return feeds.resolve_aliases(a.feed(t), {"item_code": ["Item_Code", "item_code"], "price": ["sp", "mrp"], "name": ["item_name"], "eta": ["Eta"]})


@query(sql="""SELECT l_orderkey AS doc_id, l_partkey AS item_code, l_quantity AS selling_price, l_shipdate AS scraped FROM (
  SELECT l_orderkey, l_partkey, l_quantity, strftime(l_shipdate, '%Y-%m-%d') AS l_shipdate FROM lineitem)""")
def read_records(t: Tables):
    rec = F.struct(F.col("l_partkey").alias("item_code"), F.col("l_quantity").alias("selling_price"),
                   F.date_format("l_shipdate", "yyyy-MM-dd").alias("scraped"))
    docs = t.lineitem.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.collect_list(rec).alias("r"))
    keyed = F.map_from_entries(F.transform("r", lambda e, i: F.struct(i.cast("string"), e)))
    shape = F.col("doc_id") % 3
    doc = (F.when(shape == 0, F.to_json(F.struct(F.col("r").alias("records")))).when(shape == 1, F.to_json("r")).otherwise(F.to_json(keyed)))
    schema = "item_code long, selling_price double, scraped string"
    record = StructType.fromDDL(schema)
    return feeds.explode_records(docs.select("doc_id", doc.alias("doc")), record, "doc").drop("position")


@query(sql="SELECT l_partkey AS item_code, l_quantity AS selling_price, strftime(l_shipdate, '%Y-%m-%d') AS scraped FROM lineitem")
def read_record_files(t: Tables):
    """A file for each thousand orders, written in the three shapes in turn and read back."""
    rec = F.struct(F.col("l_partkey").alias("item_code"), F.col("l_quantity").alias("selling_price"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("scraped"))
    docs = t.lineitem.groupBy(F.floor(F.col("l_orderkey") / 1000).alias("file")).agg(F.collect_list(rec).alias("r"))
    keyed = F.map_from_entries(F.transform("r", lambda e, i: F.struct(i.cast("string"), e)))
    shape = F.col("file") % 3
    doc = F.when(shape == 0, F.to_json(F.struct(F.lit("x").alias("source"), F.col("r").alias("records")))).when(shape == 1, F.to_json("r")).otherwise(F.to_json(keyed))
    path = scratch(t, "records")
    docs.select("file", doc.alias("value")).repartition("file").write.partitionBy("file").text(path)
    return feeds.read_records(t.spark, path, StructType.fromDDL("item_code long, selling_price double, scraped string")).select("item_code", "selling_price", "scraped")


@query(views="offers", sql="""
WITH f AS (SELECT * FROM offers WHERE quantity <> 1), m AS (SELECT platform, pincode, max(date) AS date FROM f GROUP BY 1, 2)
SELECT f.platform, f.pincode, f.date, item_code, sp FROM f JOIN m USING (platform, pincode, date)""")
def latest_snapshot(t: Tables):
    return (feeds.latest_snapshot(a.offers(t), ["platform", "pincode"], "date", F.col("quantity") == 1)
            .select("platform", "pincode", "date", "item_code", "sp"))


@query(views="live", sql="SELECT pincode, item_code, p0_sp, p1_sp FROM live WHERE pincode > 1 OR p0_sp IS NOT NULL")
def write_live(t: Tables):
    path = scratch(t, "live")
    live = a.live(t).select("pincode", "item_code", "p0_sp", "p1_sp")
    tables.write_live(live, path)
    tables.write_live(live.where("pincode <= 1 AND p0_sp IS NOT NULL"), path)
    return tables.read_table(t.spark, path).select("pincode", "item_code", "p0_sp", "p1_sp")


@query(views="offers", sql="SELECT date_trunc('year', date)::DATE AS date, pincode, item_code, platform, o1, o2, o3, sp FROM offers")
def write_history(t: Tables):
    path = scratch(t, "history")
    rows = a.offers(t).select(F.trunc("date", "year").alias("date"), "pincode", "item_code", "platform", "o1", "o2", "o3", "sp")
    tables.write_history(rows, path)
    tables.write_history(rows.where("date >= DATE '2000-01-01'"), path)  # the same partitions again
    return tables.read_table(t.spark, path).select("date", "pincode", "item_code", "platform", "o1", "o2", "o3", "sp")


@query(views="offers", sql="""SELECT pincode, item_code, platform, date, sp FROM offers
QUALIFY row_number() OVER (PARTITION BY pincode, item_code ORDER BY date DESC, o1 DESC, o2 DESC, o3 DESC) = 1""")
def upsert_latest(t: Tables):
    rows = a.offers(t).withColumn("at", F.struct("date", *a.OFFER_ORDER)).select("pincode", "item_code", "platform", "date", "sp", "at")
    return tables.upsert_latest(rows.where("platform <> 'p2'"), rows.where("platform = 'p2'"), ["pincode", "item_code"], "at").drop("at")


@query(views="history", sql="SELECT date, pincode, item_code, p0_sp, p1_sp, p2_sp FROM history WHERE date > DATE '2000-12-31'")
def incremental_since(t: Tables):
    return tables.incremental_since(a.history(t), "date", "2000-12-31").select("date", "pincode", "item_code", *[f"{p}_sp" for p in P])


@query(views="history", sql="SELECT date, pincode, item_code, brand, p0_sp, p1_sp FROM history WHERE date = DATE '2000-04-04' AND pincode = 2 ORDER BY item_code")
def snapshot_at(t: Tables):
    return tables.snapshot_at(a.history(t), "2000-04-04", 2).select("date", "pincode", "item_code", "brand", "p0_sp", "p1_sp")


_WIDE_VALUES = {
    "Product_Url": "url", "Product_Id": "CASE WHEN tagged THEN CAST(product_id AS VARCHAR) END", "Item_Name": "nm", "Uom": "NULL",
    "Mrp_Price": "CASE WHEN price IS NOT NULL THEN CAST(mrp AS VARCHAR) END", "Selling_Price": "CAST(price AS VARCHAR)",
    "Discount__": "CAST(CAST(round(CAST((1 - price / mrp) * 100 AS DECIMAL(28,8)), 1) AS DOUBLE) AS VARCHAR)", "Eta_Mins_": "NULL",
    "In_Stock_Remark": "CASE WHEN price IS NOT NULL THEN 'available' END",
    "Status": "CASE WHEN tagged THEN 'Mapped' WHEN price IS NOT NULL THEN 'Complete Match' END",
    "Partial": "CASE WHEN tagged THEN 'seed' END", "Factor": "'1'"}
_WIDE_SQL = ", ".join(f"coalesce(max(CASE WHEN platform = '{p}' THEN {v} END), '{'1' if f == 'Factor' else 'NA'}') AS {p}_{f}" for p in P for f, v in _WIDE_VALUES.items())


@query(views="listings", sql=f"""
WITH pr AS (SELECT pincode, item_code, platform, floor(min(sp)) AS price, max(mrp) AS mrp FROM offers GROUP BY 1, 2, 3),
l AS (SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice, c.pincode, t.platform, t.product_id, coalesce(t.mrp > 950, false) AS tagged,
   CASE WHEN t.mrp > 950 THEN 'http://shop.example/' || product_id END AS url,
   CASE WHEN t.mrp > 950 THEN t.name || ' mapped' WHEN pr.price IS NOT NULL THEN t.name END AS nm, pr.price, pr.mrp
 FROM part CROSS JOIN (SELECT unnest(range(5)) AS pincode) c LEFT JOIN listings t ON t.source_item = p_partkey
 LEFT JOIN pr ON pr.item_code = p_partkey AND pr.platform = t.platform AND pr.pincode = c.pincode)
SELECT 'NA' AS Date, 'NA' AS City, CAST(pincode AS VARCHAR) AS Pincode, CAST(p_partkey AS VARCHAR) AS Item_Code, p_name AS Item_Name, p_brand AS Brand,
 p_type AS Product_Type, 'NA' AS Unit, CAST(p_size AS VARCHAR) AS Unit_Value, CAST(p_retailprice AS VARCHAR) AS Mrp, 'NA' AS Image_Link, {_WIDE_SQL}
FROM l GROUP BY p_partkey, p_name, p_brand, p_type, p_size, p_retailprice, pincode""")
def wide_price_table(t: Tables):
    c = F.col
    listing = a.listings(t).withColumnRenamed("source_item", "item_code")
    mappings = listing.where("mrp > 950").select(
        "item_code", "platform", "product_id", F.concat(F.lit("http://shop.example/"), c("product_id")).alias("product_url"),
        F.concat("name", F.lit(" mapped")).alias("name"), F.lit("Mapped").alias("status"), F.lit("seed").alias("method"), F.lit(None).cast("string").alias("factor"))
    prices = (a.offers(t).groupBy("pincode", "item_code", "platform").agg(F.floor(F.min("sp")).cast("double").alias("selling_price"), F.max("mrp").alias("mrp"))
              .join(listing.select("item_code", "platform", "name"), ["item_code", "platform"]).withColumn("in_stock", F.lit("available")))
    na = F.lit(None).cast("string")
    master = t.part.select(na.alias("Date"), na.alias("City"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("Pincode"), c("p_partkey").alias("Item_Code"), c("p_name").alias("Item_Name"),
                           c("p_brand").alias("Brand"), c("p_type").alias("Product_Type"), na.alias("Unit"), c("p_size").alias("Unit_Value"),
                           c("p_retailprice").alias("Mrp"), F.lit("nan").alias("Image_Link"))
    return tables.wide_price_table(master, mappings, prices, P)


@query(views="offers", sql="""
WITH f AS (SELECT platform, pincode, product_name, concat_ws('-', o1, o2, o3, item_code) AS product_id, sp FROM offers)
SELECT *, row_number() OVER (ORDER BY pincode, platform, lower(product_name), product_id) AS sr_no FROM f""")
def flatten_results(t: Tables):
    product = F.struct("product_name", F.concat_ws("-", "o1", "o2", "o3", "item_code").alias("product_id"), "sp")
    results = a.offers(t).groupBy("o1", "platform", "pincode").agg(F.collect_list(product).alias("products"))
    return feeds.flatten_results(results)


@query(sql="""
SELECT CAST(l_orderkey AS VARCHAR) || '-' || l_linenumber || '-' || l_suppkey || '-' || l_partkey AS key, l_discount AS off_invoice_pct,
 CASE WHEN l_returnflag = 'R' THEN l_quantity WHEN l_discount > 0 THEN l_extendedprice * l_discount ELSE l_tax + 1 END AS off_invoice_value FROM lineitem""")
def promo_feed(t: Tables):
    """Written as quoted text in several files and read back."""
    c, path = F.col, scratch(t, "promos")
    text = t.lineitem.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey").alias(" Key"),
        F.when(c("l_linenumber") > 3, F.concat(F.round(c("l_discount") * 100).cast("int").cast("string"), F.lit("%"))).otherwise(c("l_discount").cast("string")).alias("Offer %"),
        F.when(c("l_returnflag") == "R", F.concat(F.lit("₹ "), c("l_quantity").cast("string"))).otherwise("").alias("Offer, Rs."),
        (c("l_tax") + 1).cast("string").alias("Final"), c("l_extendedprice").cast("string").alias("MRP"))
    text.write.option("header", True).option("escape", '"').csv(path)
    aliases = {"key": ["KEY", "Key"], "pct": ["Offer %"], "value": ["Offer, Rs."], "final": ["Final"], "mrp": ["MRP"]}
    return feeds.promo_values(feeds.read_feed(t.spark, path, aliases), "off")


@query(views="offers", sql="""SELECT date, pincode, item_code, platform, sp FROM offers
QUALIFY row_number() OVER (PARTITION BY date, pincode, item_code, platform ORDER BY o1 DESC, o2 DESC, o3 DESC, sp DESC) = 1""")
def ingest_stream(t: Tables):
    """Two landings of the offers, each merged as it arrives."""
    source, target, state = (scratch(t, name) for name in ("landed", "history", "state"))
    rows = a.offers(t).select(F.trunc("date", "year").alias("date"), "pincode", F.col("date").alias("day"), "item_code", "platform", "o1", "o2", "o3", "sp")
    rows = rows.withColumn("at", F.concat_ws("-", *[F.lpad(F.col(c).cast("string"), 12, "0") for c in ("o1", "o2", "o3")], F.lpad(F.format_number("sp", 6), 20, "0")))
    for early in (True, False):
        part = rows.where((F.col("o1") % 2 == 0) == early)
        part.write.mode("append").parquet(source)
        ingest_stream_of(t.spark, source, rows.schema, target, state, ["date", "pincode", "day", "item_code", "platform"], "at").awaitTermination()
    return tables.read_table(t.spark, target).select(F.col("day").alias("date"), "pincode", "item_code", "platform", "sp")


# --- extraction -----------------------------------------------------------------------------------

_H1 = "trim(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]*>', '', 'g'))"
_TITLE = "trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1))"
_OK = "length({0}) >= 5 AND length({0}) < 200 AND NOT regexp_matches({0}, '(?i)questions|answer|reviews|related|similar')"
_PAGES = f"""x AS (SELECT page_id, url, {_H1} AS h, {_TITLE} AS ti FROM pages),
e AS (SELECT page_id, url, CASE WHEN {_OK.format('h')} THEN h WHEN {_OK.format('ti')} THEN ti END AS name,
  CASE WHEN {_OK.format('h')} THEN 'dom_price' WHEN {_OK.format('ti')} THEN 'html_regex' ELSE 'no_price' END AS method,
  CASE WHEN {_OK.format('h')} THEN 0.75::DOUBLE WHEN {_OK.format('ti')} THEN 0.5 ELSE 0 END AS confidence,
  CASE WHEN {_OK.format('h')} THEN 3 ELSE 4 END AS methods_tried FROM x)"""


def _names(t: Tables):
    return x.extract_fields(t.pages, x.name_strategies(), x.valid_name, "name")


@query(sql=f"WITH {_PAGES} SELECT page_id, name, method, confidence, methods_tried FROM e")
def extract_names(t: Tables):
    return _names(t).select("page_id", "name", "method", "confidence", "methods_tried")


@query(sql="""
WITH o AS (SELECT o_orderkey, o_totalprice AS p, o_orderkey % 8 AS form FROM orders),
v AS (SELECT *, form <> 5 AND form <> 7 AND p BETWEEN 1 AND 50000 AS ok FROM o)
SELECT o_orderkey, CASE WHEN ok THEN p END AS price, CASE WHEN ok AND form IN (1, 3) THEN p + 10 END AS mrp,
 CASE WHEN NOT ok THEN 'no_price' WHEN form < 2 THEN 'json_ld' WHEN form IN (2, 6) THEN 'meta_tags' WHEN form = 3 THEN 'dom_price' ELSE 'html_regex' END AS method,
 CASE WHEN NOT ok THEN 0::DOUBLE WHEN form < 2 THEN 0.9 WHEN form IN (2, 6) THEN 0.85 WHEN form = 3 THEN 0.75 ELSE 0.5 END AS confidence,
 CASE WHEN NOT ok THEN 4 WHEN form < 2 THEN 1 WHEN form IN (2, 6) THEN 2 WHEN form = 3 THEN 3 ELSE 4 END AS methods_tried FROM v""")
def extract_prices(t: Tables):
    price, form = F.col("o_totalprice").cast("string"), F.col("o_orderkey") % 8
    dearer = (F.col("o_totalprice") + 10).cast("string")
    script = '<script data-x="1" type="application/ld+json">'
    other = script + '{"@type":"Event","offers":{"price":"7"}}</script>'
    pages = [
        # a product in the second block, below other objects
        F.concat(F.lit(other + script + '{"@graph":[{"@type":"WebSite"},{"mainEntity":{"@type":"Product","offers":[{"price":"'), price, F.lit('"}]}}]}</script>')),
        F.concat(F.lit(script + '[{"@type":"ProductGroup","offers":{"lowPrice":"'), price, F.lit('","highPrice":'), dearer, F.lit("}}]</script>")),
        F.concat(F.lit("<meta content='"), price, F.lit("' property='product:price:amount'>")),
        F.concat(F.lit("<span>MRP ₹"), dearer, F.lit("</span><div class='a'> ₹ "), price, F.lit("</div>")),
        F.concat(F.repeat(F.lit("<i>x</i>"), 80), F.lit('{"selling_price": '), price, F.lit("}")),
        F.concat(F.lit(other), price),  # an event's price is no product's
        F.concat(F.lit('<META NAME="x" PROPERTY="og:price:amount" CONTENT="'), price, F.lit('"/>')),
        F.concat(F.lit('<script type="application/ld+json">{broken '), price, F.lit("</script>")),
    ]
    html = F.element_at(F.array(*pages), (form + 1).cast("int"))
    rows = x.extract_fields(t.orders.select("o_orderkey", html.alias("html")), x.price_strategies(), also=("mrp",))
    return rows.select("o_orderkey", "price", "mrp", "method", "confidence", "methods_tried")


@query(sql="""
WITH o AS (SELECT o_orderkey, o_totalprice AS p, o_orderkey % 8 AS form FROM orders),
v AS (SELECT *, form NOT IN (5, 6) AND p BETWEEN 1 AND 50000 AS ok FROM o)
SELECT o_orderkey, CASE WHEN ok THEN p END AS price,
 CASE WHEN ok AND (form = 0 OR form IN (3, 4) AND p + 10 < 50000) THEN p + 10 WHEN ok AND form = 1 THEN p + 10 END AS mrp,
 CASE WHEN NOT ok THEN NULL WHEN form = 0 THEN 'Item ' || o_orderkey WHEN form IN (1, 2, 3) THEN 'Named ' || o_orderkey END AS product_name,
 form <> 5 AS in_stock,
 CASE WHEN NOT ok THEN 'no_price' WHEN form IN (0, 7) THEN 'api_interception' WHEN form = 1 THEN 'json_ld' WHEN form = 2 THEN 'meta_tags'
  WHEN form = 3 THEN 'dom_price' ELSE 'html_regex' END AS method,
 CASE WHEN NOT ok THEN 0::DOUBLE WHEN form IN (0, 7) THEN 0.95 WHEN form = 1 THEN 0.9 WHEN form = 2 THEN 0.85 WHEN form = 3 THEN 0.75 ELSE 0.5 END AS confidence,
 CASE WHEN NOT ok THEN 5 WHEN form IN (0, 7) THEN 1 WHEN form = 1 THEN 2 WHEN form = 2 THEN 3 WHEN form = 3 THEN 4 ELSE 5 END AS methods_tried FROM v""")
def extract_offers(t: Tables):
    c, price, dearer = F.col, F.col("o_totalprice").cast("string"), (F.col("o_totalprice") + 10).cast("string")
    ident = c("o_orderkey").cast("string")

    def text(*parts):
        return F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])

    def nested(levels: int, inner):
        return text('{"w":' * levels, inner, "}" * levels)

    script = '<script type="application/ld+json">'
    product = text('{"@type":"Product","name":"Named ', ident, '","offers":[{"price":0},{"price":"', price, '","highPrice":', dearer, "}]}")
    stranger = text('{"list":[{"product_id":"other","mrp":1,"price":7}],"tracking":{"id":"', ident, '","price":3}}')
    forms = [  # (captured payload, page)
        (text('{"list":[{"product_id":"other","price":7},', nested(6, text('{"product_id":', ident, ',"price":{"offer_price":"₹', price, '"},"mrp":', dearer,
                                                                           ',"display_name":"Item ', ident, '"}')), "]}"), F.lit("")),
        (stranger, text(script, nested(12, product), "</script>")),
        (stranger, text("<meta property='og:title' content='Named ", ident, "'><meta content='", price, "' property='og:price:amount'>")),
        (stranger, text("<h1>Customer reviews</h1><h1><b>Named</b> ", ident, "</h1><span>MRP ₹", dearer, "</span><div> ₹ ", price, "</div>")),
        (F.lit(None).cast("string"), text("<i>x</i>" * 80, '{"sp": ', price, ', "selling_price": ', price, ', "price": ', dearer, "}")),
        (F.lit("no json"), F.lit("<p>Currently <b>Unavailable</b></p>")),
        (stranger, F.lit("<script>var x = 'out of stock'</script><p>in the shop</p>")),
        (text('{"a":[[{"id":', ident, ',"brand":"b","selling_price":"₹ ', price, '"}]]}'), F.lit("<p>sold out</p>")),
    ]
    at = (c("o_orderkey") % len(forms) + 1).cast("int")
    pages = t.orders.select("o_orderkey", F.element_at(F.array(*[f[0] for f in forms]), at).alias("api"),
                            F.element_at(F.array(*[f[1] for f in forms]), at).alias("html"))
    rows = x.extract_offers(pages, "html", "api", "o_orderkey")
    # a page of form 7 without a valid price says that it is sold out
    stock = F.when((c("o_orderkey") % 8 == 7) & c("price").isNull(), ~c("in_stock")).otherwise(c("in_stock"))
    return rows.select("o_orderkey", "price", "mrp", "product_name", stock.alias("in_stock"), "method", "confidence", "methods_tried")


@query(sql=f"""WITH {_PAGES}, h AS (SELECT regexp_extract(url, '://([^/?#]+)', 1) AS host, * FROM e),
g AS (SELECT host, count(*) AS attempts, count(*) FILTER (method <> 'no_price') AS successful FROM h GROUP BY 1),
r AS (SELECT *, CAST(round(CAST(successful AS DECIMAL(20,0)) * 100 / CAST(attempts AS DECIMAL(20,0)), 1) AS DOUBLE) AS success_rate FROM g)
SELECT *, CASE WHEN success_rate < 40 THEN 'critical' WHEN success_rate < 70 THEN 'warning' ELSE 'healthy' END AS health FROM r""")
def extraction_health(t: Tables):
    return x.extraction_health(_names(t).withColumn("host", F.regexp_extract("url", "://([^/?#]+)", 1)), ["host"])


@query(sql=f"WITH {_PAGES} SELECT method, count(*) AS n FROM e WHERE method <> 'no_price' GROUP BY 1")
def extraction_methods(t: Tables):
    return x.method_counts(_names(t), [])


@query(sql="""SELECT l_orderkey AS doc_id, p_name AS product_name, p_brand AS brand, CAST(l_partkey AS VARCHAR) AS product_id,
 CASE WHEN l_extendedprice > 50000 THEN l_extendedprice / 100 ELSE l_extendedprice END AS price,
 CASE WHEN l_linenumber > 3 THEN p_retailprice END AS mrp, l_returnflag <> 'R' AS in_stock FROM lineitem JOIN part ON l_partkey = p_partkey""")
def explode_products(t: Tables):
    c = F.col
    price = c("l_extendedprice")
    flat = F.struct(c("p_name").alias("title"), c("p_brand").alias("brand"), c("l_partkey").alias("sku"), price.alias("offer_price"),
                    (c("l_returnflag") != "R").alias("in_stock"))
    deep = F.struct(c("p_name").alias("product_name"), c("p_brand").alias("brandName"), c("l_partkey").alias("id"),
                    F.struct(F.concat(F.lit("₹"), price.cast("string")).alias("sp"), c("p_retailprice").alias("mrp")).alias("price"),
                    F.when(c("l_returnflag") != "R", "yes").otherwise("out").alias("available"))
    per = t.lineitem.join(t.part, c("l_partkey") == c("p_partkey")).groupBy(c("l_orderkey").alias("doc_id")).agg(
        F.collect_list(F.when(c("l_linenumber") <= 3, flat)).alias("widgets"), F.collect_list(F.when(c("l_linenumber") > 3, deep)).alias("objects"))
    doc = F.to_json(F.struct(F.struct(F.lit("page").alias("kind"), F.struct(c("objects")).alias("layout"), c("widgets")).alias("response")))
    found = x.explode_products(per.select("doc_id", doc.alias("payload")), ["doc_id"], "payload")
    return found.select("doc_id", "product_name", "brand", "product_id", "price", "mrp", "in_stock")


@query(sql="""SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, l_quantity AS price,
 CASE WHEN l_extendedprice / 100 >= l_quantity AND l_extendedprice / 100 <= l_quantity * 5 THEN l_extendedprice / 100 END AS mrp, p_type AS leaf_category
FROM lineitem JOIN part ON l_partkey = p_partkey""")
def parse_delimited_prices(t: Tables):
    c = F.col
    attr = F.concat_ws("|", F.lit("store"), F.lit("1"), F.lit("seller"), F.lit(""), (c("l_extendedprice") / 100).cast("string"), c("l_quantity").cast("string"), F.lit("x"))
    rows = t.lineitem.join(t.part, c("l_partkey") == c("p_partkey")).select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", attr.alias("attr"), F.concat_ws(" > ", F.lit("Category"), "p_brand", "p_type").alias("path"))
    return x.parse_delimited_prices(rows, "attr", "path").drop("attr", "path")


@query(sql="""
WITH s AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_returnflag = 'R' ORDER BY l_linenumber, l_suppkey, l_partkey) AS rn FROM lineitem)
SELECT l_orderkey AS item_id, l_partkey AS sku_id, l_quantity AS price, CASE WHEN l_returnflag = 'R' THEN false ELSE l_linestatus = 'O' END AS in_stock FROM s WHERE rn = 1""")
def flatten_variants(t: Tables):
    c = F.col
    sku = F.struct("l_linenumber", "l_suppkey", "l_partkey", c("l_partkey").alias("sku_id"), c("l_quantity").alias("price"), (c("l_linestatus") == "O").alias("in_stock"))

    def items(df):
        return (df.groupBy(c("l_orderkey").alias("item_id")).agg(F.array_sort(F.collect_list(sku)).alias("skus"))
                .withColumn("skus", F.transform("skus", lambda s: F.struct(s["sku_id"], s["price"], s["in_stock"]))))

    return x.flatten_variants(items(t.lineitem.where("l_returnflag <> 'R'")), items(t.lineitem.where("l_returnflag = 'R'")))


@query(sql="""
WITH r AS (SELECT event_id, CASE WHEN event_type = 'view' THEN '' ELSE CAST(user_id AS VARCHAR) END AS id, CASE WHEN event_type = 'view' AND value > 50 THEN event_type END AS slug, ts FROM events),
i AS (SELECT *, coalesce(nullif(id, ''), slug) AS k FROM r)
SELECT event_id, id, slug FROM i WHERE k IS NULL UNION ALL
SELECT event_id, id, slug FROM (SELECT * FROM i WHERE k IS NOT NULL QUALIFY row_number() OVER (PARTITION BY k ORDER BY ts, event_id) = 1)""")
def dedup_first(t: Tables):
    view = F.col("event_type") == "view"
    rows = t.events.select("event_id", F.when(view, "").otherwise(F.col("user_id").cast("string")).alias("id"),
                           F.when(view & (F.col("value") > 50), F.col("event_type")).alias("slug"), "ts")
    return x.dedup_first(rows, ["id", "slug"], ["ts", "event_id"]).drop("ts")


@query(views="matches", sql="""
WITH f AS (SELECT platform, item_code, own_price, CASE WHEN status = 'error' THEN 'not_available' ELSE status END AS status FROM matches WHERE stage = 1
   QUALIFY row_number() OVER (PARTITION BY platform, item_code ORDER BY o1, o2, o3) = 1),
r AS (SELECT platform, item_code, own_price, status FROM matches WHERE stage = 2 QUALIFY row_number() OVER (PARTITION BY platform, item_code ORDER BY o1, o2, o3) = 1),
j AS (SELECT f.*, r.own_price AS rp, f.status <> 'ok' AND coalesce(r.status = 'ok', false) AS recovered FROM f LEFT JOIN r USING (platform, item_code))
SELECT platform, item_code, CASE WHEN recovered THEN rp ELSE own_price END AS own_price, CASE WHEN recovered THEN 'ok' ELSE status END AS status, recovered FROM j""")
def merge_retry(t: Tables):
    key = ["platform", "item_code"]

    def fetched(stage: int):
        return (a.matches(t).where(F.col("stage") == stage).groupBy(*key)
                .agg(F.min_by(F.struct("own_price", "status"), F.struct(*a.MATCH_ORDER)).alias("r")).select(*key, "r.*"))

    first = fetched(1).withColumn("status", F.when(F.col("status") == "error", "not_available").otherwise(F.col("status")))
    return x.merge_retry(first, fetched(2), key)


@query(sql="""
WITH w AS (SELECT event_id, user_id, value AS price, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS last_price FROM events),
c AS (SELECT *, coalesce(abs(price - last_price) / last_price * 100 > 200, false) AS anomaly FROM w)
SELECT *, CASE WHEN anomaly THEN 0.45::DOUBLE ELSE 0.9 END AS confidence FROM c""")
def price_anomalies(t: Tables):
    rows = t.events.select("event_id", "user_id", F.col("value").alias("price"), "ts", F.lit(0.9).alias("confidence"))
    return x.price_anomalies(rows, ["user_id"], ["ts", "event_id"]).drop("ts")

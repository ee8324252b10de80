"""Files, tables and streams."""

import json

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shelf.operators import extract
from shelf.sources import feeds, tables
from shelf.streaming.ingest import ingest_stream


def test_read_feed_with_bom_and_aliases(spark, tmp_path):
    (tmp_path / "feed.csv").write_text('﻿Key,MRP,Note\nk1,"1,200","a ""b"""\nk2,,x\n', encoding="utf-8")
    rows = feeds.read_feed(spark, str(tmp_path / "feed.csv"), {"key": ["KEY", "Key"], "mrp": ["mrp", "MRP"], "none": ["zzz"]}, multi_line=True).collect()
    assert [(r.key, r.mrp, r.none) for r in rows] == [("k1", "1,200", None), ("k2", None, None)]


def test_read_records_in_every_shape(spark, tmp_path):
    record = StructType.fromDDL("id string, price double")
    shapes = {"a": {"records": [{"id": "1", "price": 2.0}]}, "b": [{"id": "2", "price": 3.0}], "c": {"x": {"id": "3", "price": 4.0}}}
    for name, doc in shapes.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(doc, indent=1))
    rows = feeds.read_records(spark, str(tmp_path), record).collect()
    assert sorted((r.id, r.price) for r in rows) == [("1", 2.0), ("2", 3.0), ("3", 4.0)]


def test_history_is_idempotent_and_live_replaces(spark, tmp_path):
    rows = spark.createDataFrame([("2026-01-01", 1, "a", 1.0), ("2026-01-02", 1, "a", 2.0), ("2026-01-02", 2, "b", 3.0)],
                                 "date string, pincode int, item_code string, sp double").withColumn("date", F.col("date").cast("date"))
    history = str(tmp_path / "history")
    tables.write_history(rows, history)
    tables.write_history(rows.where("date = '2026-01-02'"), history)
    assert tables.read_table(spark, history).count() == 3
    live = str(tmp_path / "live")
    tables.write_live(rows, live)
    tables.write_live(rows.where("pincode = 1 AND date = '2026-01-02'"), live)
    assert sorted((r.pincode, r.sp) for r in tables.read_table(spark, live).collect()) == [(1, 2.0), (2, 3.0)]


def test_stream_merges_batches(spark, tmp_path):
    schema = "date date, pincode int, item_code string, at long, sp double"
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))

    def land(rows):
        df = spark.createDataFrame(rows, "date string, pincode int, item_code string, at long, sp double")
        df.withColumn("date", F.col("date").cast("date")).coalesce(1).write.mode("append").parquet(source)

    def run():
        ingest_stream(spark, source, StructType.fromDDL(schema), target, state, ["date", "pincode", "item_code"], "at").awaitTermination()

    land([("2026-01-01", 1, "a", 1, 1.0), ("2026-01-01", 2, "b", 1, 5.0)])
    run()
    land([("2026-01-01", 1, "a", 2, 2.0), ("2026-01-01", 1, "c", 2, 3.0)])
    run()
    run()  # nothing new
    got = sorted((r.pincode, r.item_code, r.sp) for r in tables.read_table(spark, target).collect())
    assert got == [(1, "a", 2.0), (1, "c", 3.0), (2, "b", 5.0)]


def test_wide_table_cleans_mappings_once_per_item(spark):
    master = spark.createDataFrame([(1, " tea ", c, 2.0) for c in (1, 2)], "Item_Code long, Item_Name string, Pincode int, Mrp double").select(
        *[F.col(c) if c in ("Item_Code", "Item_Name", "Pincode", "Mrp") else F.lit(None).cast("string").alias(c) for c in tables.WIDE_BASE])
    mappings = spark.createDataFrame([(1, "x", 7, " u ", " nan", " ", " seed", " "), (1, "y", None, None, "", None, None, None)],
                                     "item_code long, platform string, product_id long, product_url string, name string, status string, method string, factor string")
    prices = spark.createDataFrame([(1, 1, p, 90.0, float("nan"), " yes ", " n ") for p in "xy"],
                                   "item_code long, pincode int, platform string, selling_price double, mrp double, in_stock string, name string")
    out = tables.wide_price_table(master, mappings, prices, ["x", "y"])
    one, two = ([r[f"{p}_{f}"] for p in "xy" for f in tables.WIDE_FIELDS] for r in out.orderBy("Pincode").collect())
    assert one == ["u", "7", "NA", "NA", "NA", "90.0", "NA", "NA", "yes", "NA", "seed", "NA",
                   "NA", "NA", "n", "NA", "NA", "90.0", "NA", "NA", "yes", "Complete Match", "NA", "1"]
    assert two == ["u", "7", "NA", "NA", "NA", "NA", "NA", "NA", "NA", "NA", "seed", "NA", *["NA"] * 11, "1"]
    assert [(r.Item_Code, r.Item_Name, r.Mrp) for r in out.collect()] == [("1", "tea", "2.0")] * 2
    # above the joins only the items' own texts are stripped
    spark.conf.set("spark.sql.debug.maxToStringFields", "500")
    plan = str(out._jdf.queryExecution().optimizedPlan())
    spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert "regexp_replace(_m_" not in plan and "regexp_replace(cast(_o_" not in plan and "regexp_replace(coalesce" not in plan


def test_history_is_merged_in_pieces_of_large_partitions(spark, tmp_path):
    path, keys = str(tmp_path / "history"), ["date", "pincode", "item_code"]
    day = F.lit("2026-01-01").cast("date")

    def rows(n, at):
        return spark.range(n).select(day.alias("date"), F.when(F.col("id") < 40, 1).otherwise(2).alias("pincode"), F.col("id").alias("item_code"),
                                     F.lit(at).alias("at"), (F.col("id") * at).alias("sp"))

    first, small = rows(44, 2), "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(small, "false")  # as pieces of few bytes share a task otherwise
    tables.merge_history(first.limit(0), first, path, keys, "at", piece_rows=10)
    spark.conf.unset(small)
    files = {p: len(list((tmp_path / "history").glob(f"date=*/pincode={p}/*.parquet"))) for p in (1, 2)}
    assert files[1] > 1 and files[2] == 1
    # read from where it is written; a late row loses, an equal time replaces
    old = spark.read.schema(first.schema).parquet(path)
    tables.merge_history(old.select(*first.columns), rows(2, 1).unionByName(rows(45, 3).where("item_code >= 43")), path, keys, "at", piece_rows=10)
    got = {r.item_code: (r.pincode, r["at"], r.sp) for r in tables.read_table(spark, path).collect()}
    assert got == {i: (1 if i < 40 else 2, 3 if i > 42 else 2, i * (3 if i > 42 else 2)) for i in range(45)}
    assert tables.read_table(spark, path).count() == 45


def test_wide_table_has_47_columns(spark):
    master = spark.createDataFrame([("1", "tea")], "Item_Code string, Item_Name string").select(
        *[F.col(c) if c in ("Item_Code", "Item_Name") else F.lit(None).cast("string").alias(c) for c in tables.WIDE_BASE])
    mappings = spark.createDataFrame([("1", "x", "p", "u", "n", "", "seed", None)],
                                     "item_code string, platform string, product_id string, product_url string, name string, status string, method string, factor string")
    prices = spark.createDataFrame([("1", "x", 90.0, 100.0, "available", "n")],
                                   "item_code string, platform string, selling_price double, mrp double, in_stock string, name string")
    row = tables.wide_price_table(master, mappings, prices, ["x", "y", "z"], by=()).first()
    assert len(row) == 47
    assert (row["x_Discount__"], row["x_Status"], row["x_Factor"], row["y_Selling_Price"]) == ("10.0", "Complete Match", "1", "NA")


def test_payload_shapes(spark):
    docs = [json.dumps({"a": [{"id": 7, "name": "Tea", "price": {"sp": "₹90", "mrp": 100}, "inventory": 0}]}),
            json.dumps({"product_name": "Salt", "mrp": 25, "offer_price": 2000000}), json.dumps({"name": "no price"}), "not json"]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "i int, payload string")
    rows = {r.i: r for r in extract.explode_products(df, ["i"], "payload").collect()}
    assert set(rows) == {0, 1}
    assert (rows[0].product_id, rows[0].price, rows[0].mrp, rows[0].in_stock, rows[0].brand) == ("7", 90.0, 100.0, False, "Tea")
    assert (rows[1].price, rows[1].mrp, rows[1].in_stock) == (20000.0, 25.0, True)


def test_price_strategies_in_order(spark):
    ld = '<script type="application/ld+json">{"@type":"Product","offers":{"price":"99"}}</script>'
    meta = '<meta property="product:price:amount" content="88">'
    dom = "<span>₹ 1,250</span><div>₹ 900</div>"
    pages = spark.createDataFrame([(1, ld + meta), (2, meta + dom), (3, dom), (4, "x" * 500 + '"price": 12.5'), (5, "short ₹ 5"), (6, "<b>₹ 0</b>")],
                                  "i int, html string")
    got = {r.i: (r.price, r.method, r.methods_tried) for r in extract.extract_fields(pages, extract.price_strategies()).collect()}
    assert got == {1: (99.0, "json_ld", 1), 2: (88.0, "meta_tags", 2), 3: (900.0, "dom_price", 3), 4: (12.5, "html_regex", 4),
                   5: (None, "no_price", 4), 6: (None, "no_price", 4)}


def test_products_of_any_block_and_level(spark):
    script = '<script id=1 type="application/ld+json">'
    product = '{"@type":"Product","name":"Green tea","offers":{"price":"99","highPrice":"120"}}'
    pages = [
        f'{script}{{"@type":"WebSite"}}</script>{script}{product}</script>',
        f'{script}{{"@graph":[{{"@type":"Event"}},{product}]}}</script>',
        f'{script}{{"@type":"Event","offers":{{"price":"5"}}}}</script>',
        "<meta content='77' property='og:price:amount'>",
        "<span>MRP ₹120</span>",
        "<b>₹ 50,000</b>",
        f"{script}not json</script>",
    ]
    df = spark.createDataFrame(list(enumerate(pages)), "i int, html string")
    got = {r.i: (r.price, r.mrp, r.method) for r in extract.extract_fields(df, extract.price_strategies(), also=("mrp",)).collect()}
    assert got == {0: (99.0, 120.0, "json_ld"), 1: (99.0, 120.0, "json_ld"), 2: (None, None, "no_price"), 3: (77.0, None, "meta_tags"),
                   4: (120.0, None, "dom_price"), 5: (50000.0, None, "dom_price"), 6: (None, None, "no_price")}
    names = extract.extract_fields(df, extract.name_strategies(), extract.valid_name, "name").where("i < 2").collect()
    assert {(r["name"], r.method) for r in names} == {("Green tea", "json_ld")}


def test_fields_fall_through_to_the_next_key(spark):
    docs = [{"name": "x", "title": "Tea pack", "price": 10, "url": "javascript:1", "permalink": "/p/1", "brand": 7, "manufacturer": "Acme",
             "image": "data:1", "images": [{"src": "http://i/1"}], "category": {"a": 1}, "type": "Tea"},
            {"name": 5, "product_name": "Salt", "mrp": 3, "images": ["pic"]}, {"title": "y", "price": 1}]
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "i int, payload string")
    rows = {r.i: r for r in extract.explode_products(df, ["i"], "payload").collect()}
    assert set(rows) == {0, 1}
    assert (rows[0].product_name, rows[0].product_url, rows[0].brand, rows[0].image_url, rows[0].category) == ("Tea pack", "/p/1", "Acme", "http://i/1", "Tea")
    assert (rows[1].product_name, rows[1].image_url, rows[1].brand) == ("Salt", "pic", "Salt")


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    import pytest

    from shelf import session

    context = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077", getConf=lambda: SimpleNamespace(get=lambda *_: None))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.checkpoint_dir(SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda *_: None)))
    assert session.is_local("local[4]") and not session.is_local("local-cluster[2,1,1024]")


def test_written_tables_can_be_deleted(spark):
    from shelf.session import checkpoint_dir, delete_written, materialize

    session_dir = checkpoint_dir(spark).removeprefix("file:")
    df = materialize(spark.range(3))
    path = df.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    import os
    assert df.count() == 3 and os.path.isdir(path) and session_dir
    assert delete_written(spark) >= 1 and not os.path.exists(path)


def test_promotions_are_fractions_and_fall_back(spark):
    rows = [("a", "10.64%", "", "9", "100"), ("b", "0.2", "5", "9", "100"), ("c", "", "", "₹ 9", "100"), ("d", "60%", None, None, ""), ("", "1%", "1", "1", "1")]
    feed = spark.createDataFrame(rows, "key string, pct string, value string, final string, mrp string")
    got = {r.key: (round(r.off_invoice_pct, 4), round(r.off_invoice_value, 2)) for r in feeds.promo_values(feed, "off").collect()}
    assert got == {"a": (0.1064, 10.64), "b": (0.2, 5.0), "c": (0.0, 9.0), "d": (0.6, 0.0)}


def test_one_line_feed_is_split(spark, tmp_path):
    (tmp_path / "feed.csv").write_text("﻿k,v\n" + "".join(f'"k,{i}",{i}\n' for i in range(1000)), encoding="utf-8")
    rows = feeds.read_feed(spark, str(tmp_path), {"k": ["k"], "v": ["v"]})
    assert rows.count() == 1000 and rows.where("v = '7'").first().k == "k,7"


def test_offers_from_payloads_pages_and_their_stock(spark):
    product = '{"@type":"Product","name":"Deep tea","offers":{"price":"99"}}'
    deep = '{"w":' * 40 + product + "}" * 40
    script = '<script type="application/ld+json">'
    rows = [
        # an id without a name still is the product; a tracking id is not; ids at depth 11 are too deep
        ('{"w":{"product_id":"1","mrp":100,"offer_price":80}}', ""),
        ('{"tracking":{"id":"2","event":"pageview","price":5}}', "<p>Notify me</p>"),
        ('{"w":' * 11 + '{"product_id":"3","price":5}' + "}" * 11, "<p>here</p>"),
        ('{"w":' * 10 + '{"product_id":"4","price":5,"title":"At ten"}' + "}" * 10, ""),
        # a plain price goes before a nested one; the first object with a price counts
        ('[{"product_id":5,"mrp":9},{"product_id":5,"price":{"sp":"7"},"selling_price":6,"original_price":{"price":8}}]', ""),
        ('{"id":6,"unit":"kg","price":"₹ 1,234.5","product_name":"Rice"}', ""),
        (None, script + deep + "</script>"),
        ("[1, {}]", script + '{"a":' + product.replace("99", "0") + ',"b":[' + product.replace("99", "5") + "," + product.replace("99", "7") + "]}</script>"),
        ("", "<p>out   of\n<i>stock</i></p>"),
        (None, None),
        (None, "x" * 500 + '"price": 12.5 "price": 12.5 "sp": "15"'),
    ]
    df = spark.createDataFrame([(i + 1, a, h) for i, (a, h) in enumerate(rows)], "i int, api string, html string")
    got = {r.i: (r.price, r.mrp, r.product_name, r.in_stock, r.method) for r in extract.extract_offers(df, "html", "api", "i").collect()}
    api, none = "api_interception", (None, None, None)
    assert got == {
        1: (80.0, 100.0, None, True, api), 2: (*none, False, "no_price"), 3: (*none, True, "no_price"), 4: (5.0, None, "At ten", True, api),
        5: (6.0, 8.0, None, True, api), 6: (1234.5, None, "Rice", True, api), 7: (99.0, None, "Deep tea", True, "json_ld"),
        8: (7.0, None, "Deep tea", True, "json_ld"), 9: (*none, False, "no_price"), 10: (*none, True, "no_price"), 11: (12.5, 15.0, None, True, "html_regex")}


def test_payload_walk_keeps_the_order_and_any_depth(spark):
    doc = {"z": {"name": "first", "price": 1}, "a": [{"name": "second", "price": 2, "more": {"name": "third", "mrp": 3}}]}
    deep = '{"x":' * 3000 + '{"name":"low","price":1}' + "}" * 3000
    df = spark.createDataFrame([(1, json.dumps(doc)), (2, deep)], "i int, payload string")
    rows = extract.explode_products(df, ["i"], "payload").orderBy("i", "position").collect()
    assert [(r.i, r.product_name) for r in rows] == [(1, "first"), (1, "second"), (1, "third")]
    assert [(r.i, r.product_name) for r in extract.explode_products(df, ["i"], "payload", depth=10_000).where("i = 2").collect()] in ([(2, "low")], [])


def test_hot_partitions_are_split_and_small_ones_share_tasks(spark, tmp_path):
    rows = spark.range(200_000).select(F.when(F.col("id") % 10 < 7, 0).otherwise(F.col("id") % 40).cast("int").alias("pincode"), F.sha2(F.col("id").cast("string"), 256).alias("x"))
    old = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
    try:
        tables.write_live(rows.repartition(8), str(tmp_path / "live"))
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", old)
    files = {d.name: sorted(f.stat().st_size for f in d.glob("*.parquet")) for d in (tmp_path / "live").glob("pincode=*")}
    assert len(files["pincode=0"]) >= 4 and max(files["pincode=0"]) < 4_000_000
    # those that share the hot one's part of the exchange are in its tasks as well
    small = [len(v) for k, v in files.items() if k != "pincode=0"]
    assert sum(n <= 2 for n in small) >= len(small) // 2
    assert tables.read_table(spark, str(tmp_path / "live")).count() == 200_000


def test_quoted_line_breaks_over_several_splits(spark, tmp_path):
    import csv
    import io
    import random
    rng, path = random.Random(8), tmp_path / "feeds"
    path.mkdir()
    want = []
    for f in range(2):
        out = io.StringIO()
        writer = csv.writer(out, lineterminator="\n" if f else "\r\n")
        writer.writerow(["Key", "Note", "Price, net"])
        for i in range(3000):
            note = "".join(rng.choice(["a", "\n", '"', ",", " ", "line\n\n", "é"]) for _ in range(rng.choice([0, 1, 3, 40]))).strip()
            note = note if rng.random() < 0.99 else "long\n" * 2000 + "end"
            row = [f"k{f}-{i}", note, f"{i},5"]
            writer.writerow(row)
            want.append((row[0], note or None, row[2]))
        (path / f"f{f}.csv").write_text("\ufeff" + out.getvalue(), encoding="utf-8", newline="")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        assert spark.read.text(str(path)).rdd.getNumPartitions() > 10
        rows = feeds.read_feed(spark, str(path), {"key": ["Key"], "note": ["Note"], "price": ["Price, net"]}, multi_line=True).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])
    assert sorted((r.key, r.note, r.price) for r in rows) == sorted(want)

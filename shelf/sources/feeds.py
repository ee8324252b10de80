"""Reading delimited feeds and JSON envelopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StringType, StructField, StructType

from shelf.functions.numbers import fraction_or_null, number_or_null
from shelf.session import materialize


def resolve_aliases(df: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """One column per name: the first non-empty value among its header aliases."""
    present = {c.strip().lstrip("﻿"): c for c in df.columns}

    def first_value(names: list[str]) -> Column:
        found = [F.nullif(F.col(f"`{present[n]}`"), F.lit("")) for n in names if n in present]
        return F.coalesce(*found) if found else F.lit(None).cast("string")

    return df.select(*[first_value(names).alias(out) for out, names in aliases.items()])


def read_feed(spark: SparkSession, path: str, aliases: dict[str, list[str]], sep: str = ",", multi_line: bool = False) -> DataFrame:
    """A delimited text feed with a header; all values stay text.

    A byte-order mark is dropped and quoted separators are kept. Only the columns that an alias
    names are parsed. Large files are split among tasks; with ``multi_line`` quoted line breaks are kept as well (see
    ``quoted_records``).
    """
    options = {"header": "true", "sep": sep, "quote": '"', "escape": '"', "encoding": "UTF-8"}
    if not multi_line:
        return resolve_aliases(spark.read.options(**options).csv(path), aliases)
    # the reader looks at the first record of one file for the names
    names = spark.read.options(**options, multiLine=True).csv(path).columns
    schema = StructType([StructField(f"c{i}", StringType()) for i in range(len(names))])
    rows = quoted_records(spark, path).select(F.from_csv("record", schema.simpleString()[7:-1].replace(":", " "), {**options, "header": "false", "multiLine": "true"}).alias("r"))
    return resolve_aliases(rows.select(*[F.col(f"r.c{i}").alias(n) for i, n in enumerate(names)]), aliases)


def quoted_records(spark: SparkSession, path: str) -> DataFrame:
    """``record``: the records of delimited files but for each file's first, with the line breaks inside quotes; splits are read by several tasks.

    A line begins a record if an even number of quotes stands before it in its file. Quotes are counted per
    split, and the sums of the splits before, a row each, tell every split how it begins. Only lines that quotes
    tie to others are grouped, by the split and number of the record that they go on; all others are records as they are.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), "value")
    lines = lines.withColumn("quotes", F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit(""))))
    # a split's lines, no more than one task reads; both uses of them must see the same splits
    lines = materialize(lines)
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = (lines.groupBy("file", "block").agg(F.sum("quotes").alias("quotes"))
              .select("file", "block", (F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2).alias("open")))
    inside = Window.partitionBy("file", "block").orderBy("id")
    placed = (lines.join(starts, ["file", "block"])
              .withColumn("begins", (F.col("open") + F.coalesce(F.sum("quotes").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))) % 2 == 0)
              .withColumn("number", F.sum(F.col("begins").cast("int")).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
              .withColumn("first", (F.col("block") == 0) & (F.row_number().over(inside) == 1)))
    whole = placed.where(F.col("begins") & (F.col("quotes") % 2 == 0))
    # lines before the first record of a split go on with the last record of the splits before
    parts = placed.where(~(F.col("begins") & (F.col("quotes") % 2 == 0)))
    last = placed.groupBy("file", "block").agg(F.max("number").alias("numbers"))
    owner = last.select("file", "block", F.last(F.when(F.col("numbers") > 0, F.struct("block", "numbers")), ignorenulls=True).over(before).alias("owner"))
    tied = parts.join(owner, ["file", "block"]).withColumn(
        "of", F.when(F.col("number") > 0, F.struct("block", F.col("number").alias("numbers"))).otherwise(F.col("owner")))
    # the lines of one record
    joined = tied.groupBy("file", "of").agg(F.array_sort(F.collect_list(F.struct("block", "id", "value"))).alias("lines"), F.bool_or("first").alias("first"))
    records = (whole.where(~F.col("first")).select(F.col("value").alias("record"))
               .unionByName(joined.where(~F.col("first")).select(F.array_join("lines.value", "\n").alias("record"))))
    return records.select(F.regexp_replace("record", r"\r$", "").alias("record")).where("record <> ''")


def promo_values(feed: DataFrame, kind: str) -> DataFrame:
    """Promotions of a text feed (key, pct, value, final, mrp) as fractions and amounts.

    "10.64%" is a fraction of 0.1064. A missing value is the fraction of the MRP, and failing that
    the final offer value. Rows without a key are left out.
    """
    amount = {c: F.coalesce(number_or_null(F.col(c)), F.lit(0.0)) for c in ("value", "final", "mrp")}
    typed = feed.where(F.coalesce("key", F.lit("")) != "").withColumn("pct", F.coalesce(fraction_or_null(F.col("pct")), F.lit(0.0))).withColumns(amount)
    worth = (F.when(F.col("value") != 0, F.col("value")).when((F.col("pct") > 0) & (F.col("mrp") > 0), F.col("mrp") * F.col("pct"))
             .when(F.col("final") > 0, F.col("final")).otherwise(0.0))
    return typed.select("key", F.col("pct").alias(f"{kind}_invoice_pct"), worth.alias(f"{kind}_invoice_value"))


def read_records(spark: SparkSession, path: str, record: StructType, field: str = "records") -> DataFrame:
    """Records of JSON files: ``{field: [...]}``, a bare list, or an object keyed by id.

    Each file is one document, so files are the unit of parallelism. The whole document is parsed
    once per shape it could have; exactly one of them yields rows.
    """
    text = spark.read.text(path, wholetext=True).select(
        F.trim("value").alias("doc"), F.col("_metadata.file_path").alias("source_file"))
    return explode_records(text, record, "doc", field)


def explode_records(df: DataFrame, record: StructType, doc: str, field: str = "records") -> DataFrame:
    """Records of JSON documents held in a column."""
    ddl = StructType([StructField(field, ArrayType(record))])
    wrapped = F.from_json(F.col(doc), ddl)[field]
    bare = F.when(F.col(doc).startswith("["), F.from_json(F.col(doc), ArrayType(record)))
    keyed = F.map_values(F.from_json(F.col(doc), MapType(StringType(), record)))
    rest = [c for c in df.columns if c != doc]
    return (df.withColumn("_rows", F.coalesce(bare, wrapped, keyed)).select(*rest, F.posexplode("_rows").alias("position", "_r"))
            .where(F.col("_r").isNotNull()).select(*rest, "position", "_r.*"))


def latest_snapshot(df: DataFrame, keys: list[str], ts: str, is_partial: Column | None = None) -> DataFrame:
    """All rows of the latest complete snapshot per key.

    The latest time per key is aggregated first and joined back, so that no window has to sort
    the rows of a large key.
    """
    complete = df if is_partial is None else df.where(~is_partial)
    latest = complete.groupBy(*keys).agg(F.max(ts).alias(ts))
    return complete.join(latest, [*keys, ts], "left_semi")


def number_rows(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """Consecutive numbers in the given total order, without one task that sees all rows.

    The rows are range-partitioned, sorted and written out; the sizes of the partitions then give
    the offset of each. ``order`` should be unique, so that equal rows do not swap numbers.
    """
    placed = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order)
                         .withColumn("_m", F.monotonically_increasing_id()))
    placed = (placed.withColumn("_p", F.shiftright("_m", 33)).withColumn("_i", F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))))
    sizes = placed.groupBy("_p").agg(F.count("*").alias("_n"))
    offsets = sizes.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_before"))
    return (placed.join(offsets, "_p").withColumn(out, F.col("_before") + F.col("_i") + 1)
            .drop("_m", "_p", "_i", "_before"))


def flatten_results(results: DataFrame, products: str = "products") -> DataFrame:
    """Nested platform results to one product table, numbered by (pincode, platform, name, id)."""
    flat = (results.select("platform", "pincode", F.explode(products).alias("p")).select("platform", "pincode", "p.*")
            .withColumn("_name", F.lower("product_name")))
    return number_rows(flat, ["pincode", "platform", "_name", "product_id"], "sr_no").drop("_name")

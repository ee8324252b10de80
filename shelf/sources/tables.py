"""Live and history tables, upserts, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DoubleType, StringType

from shelf.functions.numbers import nonzero, round_to
from shelf.functions.text import MISSING, clean_text
from shelf.session import materialize

LIVE_PARTITION = ["pincode"]
HISTORY_PARTITION = ["date", "pincode"]


def _replace_partitions(df: DataFrame, path: str, partition: list[str]) -> None:
    """Replace exactly the partitions present in ``df``; the commit is per job, so a retry is safe.

    The rows of a partition meet, and their measured size decides in how many tasks: partitions of the
    exchange above the session's advisory size are split, small ones share a task. So a hot table partition
    becomes several files and a small one a single one, whatever the number of either.
    """
    (df.hint("rebalance", *partition)
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition).parquet(path))


def write_live(df: DataFrame, path: str) -> None:
    """Replace the pincodes of the batch in the live table and leave the others."""
    _replace_partitions(df, path, LIVE_PARTITION)


def write_history(df: DataFrame, path: str) -> None:
    """Write the (date, pincode) partitions of the batch; writing the same batch twice changes nothing."""
    _replace_partitions(df, path, HISTORY_PARTITION)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_by_state(df: DataFrame, path: str) -> None:
    """Priced products, one partition per state."""
    _replace_partitions(df, path, ["state"])


def upsert_latest(base: DataFrame, batch: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """Latest row per key of base and batch; the batch wins on equal times, and of one table's equal times the greatest row."""
    return _latest(_both(base, batch), base, keys, ts)


def _both(base: DataFrame, batch: DataFrame) -> DataFrame:
    return base.withColumn("_new", F.lit(0)).unionByName(batch.select(*base.columns).withColumn("_new", F.lit(1)))


def _latest(both: DataFrame, base: DataFrame, keys: list[str], ts: str, *also: str) -> DataFrame:
    """``also``: columns that follow from the keys and by which the rows are spread already."""
    rest = [c for c in base.columns if c not in keys]
    if any("map<" in base.schema[c].dataType.simpleString() for c in rest):  # maps have no order
        latest = F.max_by(F.struct(*rest), F.struct(ts, "_new"))
    else:  # each value goes through the aggregate once, the time too
        latest = F.max(F.struct(ts, "_new", *[c for c in rest if c != ts]))
    return both.groupBy(*keys, *also).agg(latest.alias("r")).select(*keys, *[F.col(f"r.`{c}`") for c in rest])


#: Rows of a table partition that one task merges and writes.
PIECE_ROWS = 1 << 20


def merge_history(base: DataFrame, batch: DataFrame, path: str, keys: list[str], ts: str, piece_rows: int = PIECE_ROWS) -> None:
    """Replace the (date, pincode) partitions of base and batch by the latest row per key.

    The rows are shuffled once, to where they are merged and written: a partition of more than ``piece_rows`` rows goes to
    several tasks by a hash of the keys. Base may be read from ``path``: the new files are staged, and the old ones go when all tasks are done.
    """
    if not {*HISTORY_PARTITION} <= {*keys}:  # a key may lie in several partitions
        return write_history(upsert_latest(base, batch, keys, ts), path)
    both = _both(base, batch)
    large = materialize(both.groupBy(*[F.col(c).alias(f"_{c}") for c in HISTORY_PARTITION]).agg(F.ceil(F.count("*") / piece_rows).alias("_pieces")).where("_pieces > 1"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in HISTORY_PARTITION]
    placed = both.join(large, same, "left").withColumn("_piece", F.pmod(F.xxhash64(*keys), F.coalesce("_pieces", F.lit(1))))
    latest = _latest(placed.repartition(*HISTORY_PARTITION, "_piece"), base, keys, ts, "_piece")
    latest.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*HISTORY_PARTITION).parquet(path)


def incremental_since(df: DataFrame, date: str, hwm: str | None) -> DataFrame:
    """Rows after the high-water mark; everything when there is none yet."""
    return df if hwm is None else df.where(F.col(date) > F.lit(hwm).cast("date"))


def snapshot_at(df: DataFrame, date: str, pincode, date_col: str = "date", order: str = "item_code") -> DataFrame:
    """One date and one pincode, ordered by item; both conditions prune partitions."""
    return df.where((F.col(date_col) == F.lit(date).cast("date")) & (F.col("pincode") == pincode)).orderBy(order)


# The columns of one platform in the wide feed format.
WIDE_FIELDS = ["Product_Url", "Product_Id", "Item_Name", "Uom", "Mrp_Price", "Selling_Price", "Discount__", "Eta_Mins_",
               "In_Stock_Remark", "Status", "Partial", "Factor"]
WIDE_BASE = ["Date", "City", "Pincode", "Item_Code", "Item_Name", "Brand", "Product_Type", "Unit", "Unit_Value", "Mrp", "Image_Link"]


def _or_na(c: Column, kind: DataType | None = None) -> Column:
    """``kind``: the type, where it is known; only texts have blanks to strip."""
    if kind is None or isinstance(kind, StringType):
        return F.coalesce(clean_text(c.cast("string")), F.lit("NA"))
    shown = c.cast("string")
    return F.when(~F.lower(shown).isin(MISSING), shown).otherwise("NA")


def _given(c: Column) -> Column:
    """As ``_or_na``, but null where there is no text at all, so that another one takes its place."""
    return F.when(c.isNotNull() & (c != ""), _or_na(c))


def wide_price_table(master: DataFrame, mappings: DataFrame, prices: DataFrame, platforms: list[str],
                     by: tuple[str, ...] = ("pincode",)) -> DataFrame:
    """The wide all-text feed: 11 item columns and 12 per platform, ``NA`` for what is missing.

    ``master`` has the base columns, a row per item and city; ``mappings`` (item_code, platform, product_id,
    product_url, name, status, method, factor) hold for all cities, ``prices`` (pincode, item_code,
    platform, selling_price, mrp, in_stock, name) for one; ``by=()`` means prices without a city.
    """
    # what a mapping says is made ready once per item, not once per item and city
    clean = {c: _or_na(F.col(c), mappings.schema[c].dataType).alias(c) for c in ("product_url", "product_id", "method")}
    m = F.struct(clean["product_url"], clean["product_id"], _given(F.col("name")).alias("m_name"), _given(F.col("status")).alias("m_status"), clean["method"],
                 F.when(F.col("factor").isNotNull(), _or_na(F.col("factor"))).alias("factor"))
    p = F.struct("selling_price", "mrp", _or_na(F.col("in_stock"), prices.schema["in_stock"].dataType).alias("in_stock"), _or_na(F.col("name")).alias("p_name"))
    mapped = (mappings.groupBy(F.col("item_code").alias("_m_item")).pivot("platform", platforms).agg(F.first(m))
              .withColumnsRenamed({x: f"_m_{x}" for x in platforms}))
    priced = (prices.groupBy(F.col("item_code").alias("_p_item"), *[F.col(b).alias(f"_p_{b}") for b in by])
              .pivot("platform", platforms).agg(F.first(p)).withColumnsRenamed({x: f"_o_{x}" for x in platforms}))
    same = [F.col("Item_Code") == F.col("_p_item"), *[F.col(b.capitalize()) == F.col(f"_p_{b}") for b in by]]
    joined = master.join(mapped, F.col("Item_Code") == F.col("_m_item"), "left").join(priced, same, "left")

    def values(platform: str) -> list[Column]:
        mapping, offer = F.col(f"`_m_{platform}`"), F.col(f"`_o_{platform}`")
        sp, mrp = nonzero(offer["selling_price"]), nonzero(offer["mrp"])
        discount = round_to((1 - sp / mrp) * 100, 1)
        status = F.coalesce(mapping["m_status"], F.when(offer.isNotNull(), "Complete Match"))
        return [mapping["product_url"], mapping["product_id"], F.coalesce(mapping["m_name"], offer["p_name"]), F.lit("NA"),
                _or_na(offer["mrp"], prices.schema["mrp"].dataType), _or_na(offer["selling_price"], prices.schema["selling_price"].dataType),
                _or_na(discount, DoubleType()), F.lit("NA"), offer["in_stock"], status, mapping["method"], F.coalesce(mapping["factor"], F.lit("1"))]

    columns = [F.coalesce(v, F.lit("NA")).alias(f"{p}_{f}") for p in platforms for f, v in zip(WIDE_FIELDS, values(p))]
    return joined.select(*[_or_na(F.col(c), joined.select(c).schema[0].dataType).alias(c) for c in WIDE_BASE], *columns)


def write_wide(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)

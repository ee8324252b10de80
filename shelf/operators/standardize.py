"""Standardisation of whole tables: one projection, at most one small-dimension join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType, StringType

from shelf.functions import geo, text, units
from shelf.functions.numbers import number_or_null, repair_minor_unit


def standardize_missing(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Trim the text columns and turn missing-value sentinels into nulls."""
    if cols is None:
        cols = [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]
    return df.withColumns({c: text.clean_text(F.col(c)) for c in cols})


def standardize_prices(df: DataFrame, cols: list[str], minor_unit_repair: bool = False) -> DataFrame:
    """Price text to double; with ``minor_unit_repair`` also divide amounts above 50 000 by 100."""
    def price(c: str) -> Column:
        value = number_or_null(F.col(c))
        return repair_minor_unit(value) if minor_unit_repair else value

    return df.withColumns({c: price(c) for c in cols})


def tokenize_names(df: DataFrame, c: str) -> DataFrame:
    """Adds ``<c>_norm`` and the significant words ``<c>_tokens``."""
    return (df.withColumn(f"{c}_norm", text.normalize_name(F.col(c)))
            .withColumn(f"{c}_tokens", text.significant(text.words(F.col(f"{c}_norm")))))


def canonicalize_brands(df: DataFrame, aliases: DataFrame, c: str = "brand") -> DataFrame:
    """Adds ``<c>_canonical``; ``aliases`` has columns (alias, brand), one row per alias."""
    lookup = aliases.select(F.col("alias").alias("_alias"), F.col("brand").alias("_meant"))
    return (df.withColumn("_bare", text.canonical_brand(F.col(c)))
            .join(lookup, F.col("_bare") == F.col("_alias"), "left")
            .withColumn(f"{c}_canonical", F.coalesce("_meant", "_bare"))
            .drop("_bare", "_alias", "_meant"))


def standardize_pack(df: DataFrame, c: str) -> DataFrame:
    """Adds value, unit, base amount (g/ml/pieces) and unit family of a pack-size text."""
    packed = df.withColumn("_pack", units.pack(F.col(c)))
    return (packed.withColumn("pack_value", F.col("_pack.value"))
            .withColumn("_written", F.col("_pack.unit"))
            .withColumn("pack_unit", units.unit_alias(F.col("_written")))
            .withColumn("base_amount", units.base_value(F.col("pack_value"), F.col("pack_unit")))
            .withColumn("unit_family", units.family(F.col("pack_unit"))).drop("_pack", "_written"))


# The spellings found in feeds and the label meant.
LABELS = {"mrp diff": "MRP Diff", "partial match": "Partial Match",
          "complete match": "Complete Match", "semi complete match": "Semi Complete Match",
          "nfnv white label": "NFNV-White-label"}


def canonicalize_labels(df: DataFrame, c: str, mapping: dict[str, str] | None = None) -> DataFrame:
    """Adds ``<c>_label``: one spelling per label; the literal text ``nan`` becomes null."""
    mapping = LABELS if mapping is None else mapping
    clean = text.clean_text(F.col(c))
    key = F.trim(F.regexp_replace(F.lower(clean), r"[\s_-]+", " "))
    label = clean
    for spelling, meant in mapping.items():
        label = F.when(key == spelling, F.lit(meant)).otherwise(label)
    return df.withColumn(f"{c}_label", label)


def enrich_geo(df: DataFrame, pincode: str = "pincode", dim: DataFrame | None = None,
               default: tuple[float, float] = geo.DEFAULT_POINT) -> DataFrame:
    """Adds lat/lng by two-digit postal prefix. ``dim`` has columns (prefix, lat, lng)."""
    if dim is None:
        dim = df.sparkSession.createDataFrame(geo.POSTAL_POINTS, "prefix string, lat double, lng double")
    prefix = F.substring(F.col(pincode).cast("string"), 1, 2)
    return (df.withColumn("_prefix", prefix).join(dim, F.col("_prefix") == F.col("prefix"), "left")
            .withColumn("lat", F.coalesce("lat", F.lit(default[0])))
            .withColumn("lng", F.coalesce("lng", F.lit(default[1]))).drop("_prefix", "prefix"))


def enrich_city(df: DataFrame, cities: DataFrame, key: str = "pincode") -> DataFrame:
    """City, state and warehouse of a postal code; unknown codes keep nulls."""
    return df.join(cities, key, "left")


def standardize_stock(df: DataFrame, c: str) -> DataFrame:
    """Adds ``<c>_flag``: boolean as is, number > 0, text not in (false, 0, no, out); null is in stock."""
    kind = df.schema[c].dataType
    if isinstance(kind, BooleanType):
        flag = F.col(c)
    elif isinstance(kind, NumericType):
        flag = F.col(c) > 0
    else:
        flag = ~F.lower(c).isin("false", "0", "no", "out")
    return df.withColumn(f"{c}_flag", F.coalesce(flag, F.lit(True)))


def browse(df: DataFrame, q: str | None = None, filters: dict | None = None,
           sort: str | None = None, descending: bool = False, page: int = 1, page_size: int = 50,
           name: str = "product_name", brand: str = "brand", tie: list[str] | None = None) -> DataFrame:
    """One page of a filtered, sorted product list; search is case-insensitive on name and brand."""
    out = df
    if q:
        needle = q.lower()
        out = out.where(F.contains(F.lower(name), F.lit(needle)) | F.contains(F.lower(brand), F.lit(needle)))
    for column, value in (filters or {}).items():
        out = out.where(F.col(column) == value)
    if sort:
        first = F.desc_nulls_last(sort) if descending else F.asc_nulls_first(sort)
        out = out.orderBy(first, *(tie or []))
    return out.offset((page - 1) * page_size).limit(page_size)

"""Golden rows of the standardisation jobs."""

import pytest
from pyspark.sql import functions as F

from shelf.functions import text, units
from shelf.functions.numbers import fraction_or_null
from shelf.operators import resolve, standardize


def column(spark, values, expr, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(expr(F.col("v"))).collect()]


def test_missing_values(spark):
    values = ["N/A", "NA", "  null ", "nan", "None", None, "", "n/a", "#VALUE!", " hello "]
    assert column(spark, values, text.clean_text) == [None] * 9 + ["hello"]


def test_prices(spark):
    values = ["₹ 1,234.50", "Rs. 500/-", "0", "99", "NA", "inf", "-5", None, "nan", "null", ""]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, p string")
    got = [r.p for r in standardize.standardize_prices(df, ["p"]).orderBy("i").collect()]
    assert got == [1234.5, 500.0, 0.0, 99.0] + [None] * 7


def test_minor_unit(spark):
    df = spark.createDataFrame([("50000",), ("50001",), ("129900",)], "p string")
    assert [r.p for r in standardize.standardize_prices(df, ["p"], True).collect()] == [50000.0, 500.01, 1299.0]


def test_percent_is_a_fraction(spark):
    assert column(spark, ["10.64%", "0.2", "60%"], fraction_or_null) == pytest.approx([0.1064, 0.2, 0.6])


@pytest.mark.parametrize("text_in,value,unit,base,family", [
    ("2 x 100ml", 200, "ml", 200, "ml"), ("1/2 kg", 0.5, "kg", 500, "g"), ("500gm", 500, "g", 500, "g"),
    ("10 N", 10, "pc", 10, "pc"), ("250 g", 250, "g", 250, "g"), ("1 ltr", 1, "l", 1000, "ml"),
    ("2 kgs", None, None, None, None), ("no pack", None, None, None, None)])
def test_pack(spark, text_in, value, unit, base, family):
    df = spark.createDataFrame([(text_in,)], "u string")
    r = standardize.standardize_pack(df, "u").first()
    assert (r.pack_value, r.pack_unit, r.base_amount, r.unit_family) == (value, unit, base, family)


def test_names_keep_letters_of_any_script(spark):
    assert column(spark, ["Nestlé's Crème_1  (New)"], text.normalize_name) == ["nestlé s crème_1 new"]
    assert column(spark, ["The 100 pure Ghee for 2 kg pack"], text.name_tokens) == [["pure", "ghee"]]


def test_brands(spark):
    df = spark.createDataFrame([("CDM",), ("Maggie",), ("Tata Namak",), ("",), ("Some Brand",), ("Acme Pvt. Ltd.",)], "brand string")
    aliases = spark.createDataFrame(list(text.BRAND_ALIASES.items()), "alias string, brand string")
    got = {r.brand: r.brand_canonical for r in standardize.canonicalize_brands(df, aliases).collect()}
    assert got == {"CDM": "cadbury dairy milk", "Maggie": "maggi", "Tata Namak": "tata salt", "": "",
                   "Some Brand": "some brand", "Acme Pvt. Ltd.": "acme"}


def test_labels(spark):
    df = spark.createDataFrame([("MRP-Diff",), ("MRP DIFF",), ("MRP Diff",), ("nan",), ("Color Diff",)], "l string")
    assert [r.l_label for r in standardize.canonicalize_labels(df, "l").collect()] == ["MRP Diff"] * 3 + [None, "Color Diff"]


def test_stock(spark):
    df = spark.createDataFrame([("False",), ("0",), ("no",), ("OUT",), ("yes",), (None,)], "s string")
    assert [r.s_flag for r in standardize.standardize_stock(df, "s").collect()] == [False] * 4 + [True, True]
    df = spark.createDataFrame([(0,), (3,)], "s int")
    assert [r.s_flag for r in standardize.standardize_stock(df, "s").collect()] == [False, True]


def test_geo_default(spark):
    df = spark.createDataFrame([("834002",), ("000000",)], "pincode string")
    got = {r.pincode: (r.lat, r.lng) for r in standardize.enrich_geo(df).collect()}
    assert got == {"834002": (23.3441, 85.3096), "000000": (28.6139, 77.2090)}


@pytest.mark.parametrize("ref,own,factor", [("50 g", "100 g", 0.5), ("500 g", "1 kg", 0.5), ("750 ml", "200 ml", 3.75),
                                            ("150 g", "6 x 150 g", 0.167), ("8 pcs", "6 pcs", 1.333), ("1 kg", "1 l", None)])
def test_pack_factor(spark, ref, own, factor):
    df = spark.createDataFrame([(ref, own, 52.0, 44.0)], "r string, o string, own_price double, mrp double")
    assert resolve.pack_factor(df, "r", "o").first().factor == factor


def test_listing_units_differ_from_pack_units(spark):
    assert column(spark, ["Rice 5 kgs bag"], units.listing_unit) == ["kg"]
    assert column(spark, ["Rice 5 kgs bag"], lambda c: units.pack(c)["unit"]) == [None]

"""Column expressions for messy product text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Text that stands for "no value" in the feeds.
MISSING = ["", "na", "nan", "null", "none", "n/a", "#value!"]

# Words that carry no meaning in a product name.
NAME_STOPWORDS = ["the", "and", "of", "a", "an", "with", "for", "in", "on", "to",
                  "pack", "pc", "pcs", "n", "by", "free", "new"]

# Corporate words dropped from a brand.
BRAND_STOPWORDS = ["private", "limited", "ltd", "pvt", "company", "co", "the", "and"]

# Spellings of a brand and the brand meant.
BRAND_ALIASES = {"cdm": "cadbury dairy milk", "maggie": "maggi", "tata namak": "tata salt"}

# Letters and digits of any script, underscore and blank survive; Java's \w is ASCII only.
PUNCTUATION = r"[^\p{L}\p{N}_\s]"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def clean_text(c: Column) -> Column:
    """Trimmed text; null when it is one of the missing-value sentinels."""
    text = strip(c)
    return F.when(~F.lower(text).isin(MISSING), text)


def is_missing(c: Column) -> Column:
    return c.isNull() | F.lower(strip(c)).isin(MISSING)


def normalize_name(c: Column) -> Column:
    """Lower case, punctuation to blanks, blanks collapsed; never null."""
    spaced = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), PUNCTUATION, " ")
    return F.trim(F.regexp_replace(spaced, r"\s+", " "))


def squeeze_name(c: Column) -> Column:
    """Lower case with punctuation removed (not replaced by a blank)."""
    return strip(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), PUNCTUATION, ""))


def words(normalized: Column) -> Column:
    """All distinct words of an already normalised text."""
    return F.array_distinct(F.filter(F.split(normalized, " "), lambda t: t != ""))


def significant(tokens: Column) -> Column:
    """Words of at least three characters that are neither stopwords nor numbers."""
    return F.filter(tokens, lambda t: (F.length(t) >= 3) & ~t.isin(NAME_STOPWORDS)
                    & ~t.rlike(r"^\p{Nd}+$"))


def name_tokens(c: Column) -> Column:
    return significant(words(normalize_name(c)))


def canonical_brand(c: Column) -> Column:
    """Normalised brand without corporate words, before any alias is applied."""
    kept = F.filter(F.split(normalize_name(c), " "), lambda t: ~t.isin(BRAND_STOPWORDS))
    return F.array_join(kept, " ")


def lookup(mapping: dict[str, str], c: Column) -> Column:
    """The mapped text, or the text itself; ``c`` should be a plain column, as it is used twice."""
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return F.coalesce(F.element_at(table, c), c)

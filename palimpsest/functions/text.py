"""Scalar text functions as Columns."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# White space as the normalization counts it: Unicode's and the four separators. Fixed value.
_SPACE = r"(?U)[\s\x1c-\x1f]+"


def normalize(text: Column) -> Column:
    """X01 for text that NFKC leaves alone: lower case, white space to one blank, edge punctuation and quotes off."""
    return F.btrim(F.btrim(F.btrim(F.regexp_replace(F.lower(text), _SPACE, " ")), F.lit(".,;:!?")), F.lit("\"'"))


def normalize_exact(df: DataFrame, column: str, into: str) -> DataFrame:
    """X01 for any text, in one pass over the rows. Only texts beyond ASCII go to Python for NFKC; others pass as nulls."""
    text = F.col(column)
    plain = F.octet_length(text) == F.length(text)

    @F.pandas_udf("string")
    def composed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")

    return df.withColumn(into, normalize(F.coalesce(composed(F.when(~plain, text)), text)))


def token_count(norm: Column) -> Column:
    """X02 of normalized text."""
    return F.when(norm == "", 0).otherwise(F.size(F.split(norm, " "))).cast("long")


def char_length(norm: Column) -> Column:
    return F.length(norm).cast("long")


def slugify(text: Column) -> Column:
    """X05; an empty slug is the caller's error."""
    return F.btrim(F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9]+", "-"), F.lit("-"))


def split_bucket(anchor: Column) -> Column:
    """SHA-1 of the id modulo 20, from three parts of its hexadecimal digits (16^k is 16 modulo 20)."""
    h = F.sha1(anchor)
    part = lambda a, n: F.conv(F.substring(h, a, n), 16, 10).cast("long") % 20
    return ((part(1, 15) * 16 + part(16, 15) * 16 + F.conv(F.substring(h, 31, 10), 16, 10).cast("long")) % 20).cast("int")


def split_of(bucket: Column) -> Column:
    return F.when(bucket <= 13, "train").when(bucket <= 16, "dev").otherwise("test")


def entity_id(url: Column, error: bool = False) -> Column:
    """What follows the entity prefix; null (or an error) for other urls."""
    found = F.nullif(F.regexp_extract(url, r"^https?://www\.wikidata\.org/entity/(.*)$", 1), F.lit(""))
    return F.when(found.isNull(), F.raise_error(F.concat(F.lit("not an entity url: "), F.coalesce(url, F.lit("null"))))).otherwise(found) if error else found


def variable_date(time: Column, precision: Column) -> Column:
    """X11: `+YYYY-MM-DD...` cut to day (11 or finer), month (10) or year (9), with the minus of an early year; else null."""
    bare, sign = F.regexp_replace(time, r"^[+-]+", ""), F.when(F.startswith(time, F.lit("-")), "-").otherwise("")
    cut = F.when(precision >= 11, F.substring(bare, 1, 10)).when(precision == 10, F.substring(bare, 1, 7)).when(precision == 9, F.substring(bare, 1, 4))
    return F.when(F.length(time) >= 11, F.concat(sign, cut))


def ratio_or_inf(n: Column, d: Column) -> Column:
    """X12."""
    return F.when(d > 0, n / d).otherwise(F.lit(float("inf")))

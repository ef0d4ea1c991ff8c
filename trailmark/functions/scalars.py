"""Exact scalars: buckets, decimals, canonical text, digests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BUCKETS = 8
#: A decimal's text: digits, at most one point, an exponent of up to three digits (fixed value).
DECIMAL = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d{1,3})?$"
LONGEST_DECIMAL = 64


def bucket_of(key: Column, buckets: int = BUCKETS) -> Column:
    """The first eight hex digits of the key's SHA-256, modulo the number of buckets."""
    return F.pmod(F.conv(F.substring(F.sha2(key.cast("string"), 256), 1, 8), 16, 10).cast("long"), F.lit(buckets)).cast("int")


def is_decimal(text: Column) -> Column:
    return text.rlike(DECIMAL) & (F.length(text) <= LONGEST_DECIMAL)


def micro_value(text: Column) -> Column:
    """A decimal's text as whole millionths, null where that isn't exact or doesn't fit."""
    value = F.when(is_decimal(text), text.try_cast("decimal(38,18)"))
    scaled = value * F.lit(1_000_000).cast("decimal(7,0)")
    return F.when(text.rlike(r"^[+-]?\d*\.?\d{0,18}$") & (scaled == F.floor(scaled)), scaled.try_cast("long"))


def shortest_decimal(text: Column) -> Column:
    """A plain decimal without trailing zeros behind the point."""
    return F.when(text.contains("."), F.regexp_replace(F.regexp_replace(text, r"0+$", ""), r"\.$", "")).otherwise(text)


def row_text(*columns: Column) -> Column:
    """A row as one JSON array of strings, nulls as null."""
    return F.to_json(F.array(*(c.cast("string") for c in columns)), {"ignoreNullFields": "false"})


def digest(*columns: Column) -> Column:
    return F.sha2(row_text(*columns), 256)

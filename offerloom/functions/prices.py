"""Prices, pack sizes and labels as Column expressions."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .text import WS


def normalize_price(c: Column) -> Column:
    """Number in a price string: dots group thousands, a comma starts decimals.

    The leading number counts; what holds none is null.
    """
    digits = F.replace(F.replace(F.regexp_replace(c, "[^0-9.,]", ""), F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    return F.nullif(F.regexp_extract(digits, r"^(\d+\.?\d*|\.\d+)", 1), F.lit("")).try_cast("double")


def window_price(text: Column) -> Column:
    """First price with a currency in a text without tags."""
    found = F.regexp_extract(text, rf"(?i)(\d{{1,3}}(?:(?:\.|{WS})\d{{3}})*|\d+)(?:[.,]\d{{2}})?{WS}*(LEI|RON)", 0)
    return normalize_price(F.nullif(found, F.lit("")))


def card_price(text: Column) -> Column:
    """First number before a currency in the price part of a card."""
    return normalize_price(F.nullif(F.regexp_extract(text, rf"(?i)(\d+[,.]?\d*){WS}*(Lei|RON)", 1), F.lit("")))


def _plain(x: Column) -> Column:
    """A double without ``.0``."""
    return F.regexp_replace(x.cast("string"), r"\.0$", "")


def pack_signature(attributes: Column) -> Column:
    """What makes two packs the same: size and unit, times count; else pieces."""
    pack, count = attributes["pack"], attributes["count"]
    size = F.concat(_plain(pack["value"]), pack["unit"])
    times = F.when(count > 1, F.concat(F.lit("x"), _plain(count))).otherwise("")
    return F.when(pack.isNotNull(), F.concat(size, times)).when(count.isNotNull(), F.concat(_plain(count), F.lit("pcs"))).otherwise("")


def per_unit_price(price: Column, attributes: Column) -> Column:
    """Price per 100 g or ml of all packs, else per piece, else null."""
    pack, count = attributes["pack"], attributes["count"]
    packs = F.when(count > 1, count).otherwise(F.lit(1.0))
    hundreds = (pack["value"] * packs) / F.lit(100.0)
    by_pack = F.struct((price / hundreds).alias("value"), pack["unit"].alias("unit"))
    by_piece = F.struct(F.try_divide(price, count).alias("value"), F.lit("piece").alias("unit"))
    return F.when(pack["value"] > 0, by_pack).when(count > 0, by_piece)


def confidence(n_sources: Column, diaper_size: Column) -> Column:
    sized = F.coalesce(diaper_size, F.lit("")) != ""
    return F.when(n_sources >= 3, "high").when((n_sources == 2) & sized, "high").when(n_sources == 2, "medium").otherwise("low")


@F.arrow_udf(StringType())
def two_decimals(values: pa.Array) -> pa.Array:
    """Two decimals, rounded half up on the exact binary value."""
    return pa.array([None if v is None else str(Decimal(v).quantize(Decimal("0.01"), ROUND_HALF_UP)) for v in values.to_pylist()], pa.string())


def per_unit_label(ppu: Column) -> Column:
    unit = F.when(ppu["unit"] == "piece", F.lit("buc")).otherwise(F.concat(F.lit("100"), ppu["unit"]))
    return F.concat(two_decimals(ppu["value"]), F.lit(" RON / "), unit)


def pack_label(attributes: Column) -> Column:
    pack, count = attributes["pack"], attributes["count"]
    return (
        F.when(pack.isNotNull() & (count > 1), F.concat(_plain(count), F.lit(" x "), pack["original"]))
        .when(pack.isNotNull(), pack["original"])
        .when(count.isNotNull(), F.concat(_plain(count), F.lit(" buc")))
        .otherwise("")
    )


def savings_label(savings: Column) -> Column:
    return F.concat(F.floor(savings * 100 + 0.5).cast("string"), F.lit("%"))

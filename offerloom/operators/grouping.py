"""Groups of equivalent offers across sources.

One aggregation over typed key columns gives each bucket its size, best prices
and head; buckets of one source are no groups. Ties go to the offer that comes
first in relevance, by its sort key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import tables
from ..functions.prices import confidence

KEY = ["k_kind", "k_pack", "k_unit", "k_count", "k_size", "k_organic", "k_variant"]


def with_key(offers: DataFrame) -> DataFrame:
    """Named offers with the columns of their bucket."""
    a = F.col("attributes")
    count = F.when(a["pack"].isNull() | (a["count"] > 1), a["count"])
    blank = lambda c: F.coalesce(c, F.lit(""))
    key = {"k_kind": blank(a["kind"]), "k_pack": a["pack"]["value"], "k_unit": blank(a["pack"]["unit"]), "k_count": count, "k_size": blank(a["diaper_size"]), "k_organic": F.coalesce(a["organic"], F.lit(False)), "k_variant": blank(a["variant"])}
    return offers.filter(F.coalesce("name", F.lit("")) != "").withColumns(key)


def groups(found: DataFrame, order: str = "rel", by: tuple[str, ...] = ()) -> DataFrame:
    """One row for each bucket with two or more sources, and each value of ``by``.

    Adds to the key: n, n_sources, matched_name, best_price, best_price_source,
    unit (the only one, or null), best_ppu, best_ppu_source, attributes, score,
    first (sort key of the head), match_confidence.
    """
    first = F.col(order)
    named = F.struct(F.length("name"), first)
    ppu, unit = F.col("price_per_unit.value"), F.col("price_per_unit.unit")
    priced = F.struct(F.when(F.col("price_per_unit").isNotNull(), ppu).alias("v"), first.alias("o"))
    has = F.col("price_per_unit").isNotNull()
    columns = [
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("source").alias("n_sources"),
        F.min_by("name", named).alias("matched_name"),
        F.min("price").alias("best_price"),
        F.min_by("source", F.struct("price", first)).alias("best_price_source"),
        F.min(unit).alias("lo_unit"),
        F.max(unit).alias("hi_unit"),
        F.min(ppu).alias("lo_ppu"),
        F.min_by("source", F.when(has, priced)).alias("ppu_source"),
        F.min_by("attributes", first).alias("attributes"),
        F.min(first).alias("first"),
    ]
    if "relevance_score" in found.columns:
        columns.append(F.max("relevance_score").alias("score"))
    out = with_key(found).groupBy(*by, *KEY).agg(*columns).filter("n_sources >= 2")
    single = F.col("lo_unit") == F.col("hi_unit")
    out = out.withColumns({"unit": F.when(single, F.col("lo_unit")), "best_ppu": F.when(single, F.col("lo_ppu")), "best_ppu_source": F.when(single, F.col("ppu_source"))})
    # the size is part of the key, so a reader of the confidence needs no attributes
    return out.withColumn("match_confidence", confidence(F.col("n_sources"), F.col("k_size"))).drop("lo_unit", "hi_unit", "lo_ppu", "ppu_source")


def numbered(found: DataFrame, tasks: int = 0) -> DataFrame:
    """Groups with ``group_no`` by first appearance and, if scored, ``group_rank``."""
    out = tables.numbered(found, ["first"], "group_no", tasks=tasks)
    if "score" in found.columns:
        out = tables.numbered(out, [F.desc("score"), F.col("first")], "group_rank", start=1, tasks=tasks)
    return out.withColumn("group_id", F.concat(F.lit("group-"), F.col("group_no").cast("string")))


def numbered_each(found: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """``numbered`` within each value of ``by``, whose groups are one task's."""
    own = Window.partitionBy(*by)
    out = found.withColumn("group_no", F.row_number().over(own.orderBy("first")).cast("bigint") - 1)
    if "score" in found.columns:
        out = out.withColumn("group_rank", F.row_number().over(own.orderBy(F.desc("score"), "first")).cast("bigint"))
    return out.withColumn("group_id", F.concat(F.lit("group-"), F.col("group_no").cast("string")))


def same_bucket(a: str, b: str, by: tuple[str, ...] = ()) -> Column:
    out = F.lit(True)
    for k in (*by, *KEY):
        out = out & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return out


def members(found: DataFrame, made: DataFrame, order: str = "rel", by: tuple[str, ...] = ()) -> DataFrame:
    """Offers in groups with ``member_rank``: by unit price if the group has one
    unit, then price, then relevance; badges mark the best."""
    offers = with_key(found).alias("o")
    kept = [c for c in made.columns if c in ("group_id", "group_rank", "best_price", "best_ppu", "unit")]
    joined = offers.join(made.alias("g"), same_bucket("o", "g", by)).select("o.*", *[F.col(f"g.{c}").alias(f"g_{c}" if c in ("unit",) else c) for c in kept])
    by_unit = F.when(F.col("g_unit").isNotNull(), F.coalesce(F.col("price_per_unit.value"), F.lit(float("inf")))).otherwise(0.0)
    rank = F.row_number().over(Window.partitionBy(*by, *KEY).orderBy(by_unit, "price", order))
    best = F.col("price") == F.col("best_price")
    best_unit = (F.col("price_per_unit.value") == F.col("best_ppu")) & (F.col("price_per_unit.unit") == F.col("g_unit"))
    return joined.withColumns({"member_rank": rank, "is_best": best, "is_best_unit": F.coalesce(best_unit, F.lit(False)) & ~best})


def ungrouped(found: DataFrame, in_groups: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Offers whose id is in no group (of their ``by``)."""
    return found.join(in_groups.select(*by, "id"), [*by, "id"], "left_anti").select(found.columns)

"""Offers made from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.enrich import with_per_unit
from ..schema import OFFER_COLUMNS, PER_UNIT, SOURCES

#: Lines that one task makes offers of, at most, where there are more than one for
#: each core: they are few bytes in a shuffle, and what is made of them is many.
LINES_A_TASK = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def line_tasks(spark: SparkSession, sf_dir: str) -> int:
    """Tasks that the lines want."""
    return -(-table(spark, sf_dir, "lineitem").count() // LINES_A_TASK)


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One offer for each part and supplier, at the best price of their lines.

    One supplier in five sells larger packs of its own, so that not every offer
    has its like in another source.
    """
    tasks = line_tasks(spark, sf_dir)
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"))
    if tasks > spark.sparkContext.defaultParallelism:
        lines = lines.repartition(tasks, "l_partkey")
    best = lines.groupBy("l_partkey", "l_suppkey").agg(F.min("price").alias("price"))
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    rows = best.join(part, F.col("l_partkey") == F.col("p_partkey"))
    place = F.pmod("l_suppkey", F.lit(len(SOURCES))).cast("int")
    unit = F.when(F.col("p_type") == "SMALL", "ml").otherwise("g")
    grams = F.col("p_size") + F.when(F.col("l_suppkey") % 5 == 0, 50 + F.col("l_suppkey")).otherwise(0)
    size = grams.cast("double")
    # typed field by field: a cast of the whole would keep a reader of one field making all
    attributes = F.struct(
        F.col("p_brand").alias("brand"),
        F.col("p_name").alias("kind"),
        (F.col("p_type") == "ECONOMY").alias("organic"),
        F.struct(size.alias("value"), unit.alias("unit"), F.concat(grams.cast("string"), unit).alias("original")).alias("pack"),
        F.lit(None).cast("double").alias("count"),
        F.lit(None).cast("string").alias("variant"),
        F.lit(None).cast("string").alias("diaper_size"),
    )
    ident = F.concat_ws("-", "l_partkey", "l_suppkey")
    out = rows.select(
        ident.alias("id"),
        F.col("p_name").alias("name"),
        "price",
        F.lit("RON").alias("currency"),
        F.lit("").alias("image_url"),
        F.concat(F.lit("https://shop.example/"), F.replace("p_name", F.lit(" "), F.lit("-"))).alias("product_url"),
        F.get(F.array(*map(F.lit, SOURCES)), place).alias("source"),
        F.col("p_brand").alias("brand"),
        F.lit(None).cast("string").alias("variant"),
        attributes.alias("attributes"),
        F.lit(None).cast(PER_UNIT).alias("price_per_unit"),
        F.struct(place.alias("source"), F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b")).alias("ord"),
    )
    return with_per_unit(out).select(OFFER_COLUMNS)

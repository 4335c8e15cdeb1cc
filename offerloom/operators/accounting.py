"""What each source returned."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import source_dim


def count_by_source(offers: DataFrame) -> DataFrame:
    """(source, source_ord, n) with a row for every known source."""
    counts = offers.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return source_dim(offers.sparkSession).join(counts, "source", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def source_errors(status: DataFrame) -> DataFrame:
    """(source, error) of the sources that failed."""
    return status.filter(~F.col("success")).select("source", F.coalesce("error", F.lit("unknown")).alias("error"))


def outcome_each(status: DataFrame, offers: DataFrame) -> DataFrame:
    """(query, source, n, error): for every query that was asked and every source
    the offers found, and why there are none if the source failed; an answer
    that never came is unknown."""
    asked = status.select("query").distinct().crossJoin(F.broadcast(source_dim(status.sparkSession).select("source")))
    counts = offers.groupBy("query", "source").agg(F.count(F.lit(1)).alias("n"))
    # a source with one good page has not failed
    told = status.groupBy("query", "source").agg(F.when(~F.bool_or("success"), F.min(F.coalesce("error", F.lit("unknown")))).alias("error"), F.lit(True).alias("came"))
    out = asked.join(counts, ["query", "source"], "left").join(told, ["query", "source"], "left")
    return out.select("query", "source", F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("came"), F.col("error")).otherwise("unknown").alias("error"))

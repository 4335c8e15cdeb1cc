"""Stored payloads: a folder of fetched pages and bodies, a partition for each source.

Payloads are written as JSON lines (as fetchers leave them, and legible) or as
Parquet. What is read has the columns (source, query, page, status, body,
problem): ``problem`` holds a line that could not be read, and ``fetch_status``
and ``source_errors`` tell of it as they tell of a failed fetch. A reader of one
source lists and scans that source's partition alone, and only the columns that
it needs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import SOURCES
from .payloads import MOST, READERS, fetch_status, top_per_source

_STORED = "query string, page bigint, status int, body string"
_PROBLEM = "problem string"
COLUMNS = ["source", "query", "page", "status", "body", "problem"]


def write_payloads(payloads: DataFrame, path: str, form: str = "json", mode: str = "append") -> None:
    """Stores (source, query, status, body) and, if there is one, ``page``.

    Rows without a source are kept under one that no reader takes. The rows are
    dealt out by source and query, so a source that has most of the queries is
    written by many tasks, and each writes few files.
    """
    page = F.col("page").cast("bigint") if "page" in payloads.columns else F.lit(0).cast("bigint")
    rows = payloads.select("source", "query", F.coalesce(page, F.lit(0)).alias("page"), F.col("status").cast("int").alias("status"), "body")
    rows.repartition("source", "query").write.mode(mode).partitionBy("source").format(form).save(path)


def read_payloads(spark: SparkSession, path: str, form: str = "json") -> DataFrame:
    """(source, query, page, status, body, problem) of the payloads stored in ``path``.

    A line that is no JSON, or not of these types, has nothing but its source and
    ``problem``, the line itself. Parquet has no such lines.
    """
    if form == "json":
        lines = spark.read.schema("value string, source string").text(path).filter(F.trim("value") != "")
        told = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "problem"}
        found = lines.select("source", F.from_json("value", f"{_STORED}, {_PROBLEM}", told).alias("p"))
        # the parser keeps what it read before it failed
        kept = [F.when(F.col("p.problem").isNull(), F.col(f"p.{c}")).alias(c) for c in ("query", "page", "status", "body")]
        return found.select("source", *kept, "p.problem")
    found = spark.read.schema(f"{_STORED}, source string").format(form).load(path)
    return found.withColumn("problem", F.lit(None).cast("string")).select(*COLUMNS)


def unreadable(stored: DataFrame) -> DataFrame:
    """(source, n, example): lines that could not be read, counted by source."""
    told = stored.filter("problem IS NOT NULL").groupBy("source")
    return told.agg(F.count(F.lit(1)).alias("n"), F.min(F.substring("problem", 1, 200)).alias("example"))


def stored_status(stored: DataFrame) -> DataFrame:
    """fetch_status() of stored payloads; a line that could not be read is a failure."""
    told = fetch_status(stored)
    error = F.when(F.col("problem").isNotNull(), F.lit("unreadable")).otherwise(F.col("error"))
    return told.withColumns({"error": error, "success": F.col("success") & F.col("problem").isNull()})


def stored_offers(spark: SparkSession, path: str, sources: list[str] | None = None, form: str = "json", most: int = MOST) -> DataFrame:
    """Offers of the stored payloads of ``sources`` (all if none are named)."""
    wanted = SOURCES if sources is None else sources
    unknown = set(wanted) - set(SOURCES)
    if unknown or not wanted:
        raise ValueError(f"sources are some of {', '.join(SOURCES)}")
    good = stored_status(read_payloads(spark, path, form)).filter("success")
    every = None
    for s in dict.fromkeys(wanted):
        part = READERS[s](good.filter(F.col("source") == s))
        every = part if every is None else every.unionByName(part)
    return top_per_source(every, most)

"""The textual report of a search as ordered lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import truncate
from ..plans.search import SearchResult

SHOWN, NOTE_MOST, BODY_MOST = 20, 2000, 65_000

#: What a report body must have.
BODY = "note string, userAgent string, viewport struct<w:double,h:double>, appVersion string, result struct<query:string,groups:array<string>,ungrouped:array<string>,rawProducts:array<string>,totalProducts:double,countBySource:map<string,double>,sourceErrors:map<string,string>,enrichmentError:string,timestamp:double>"
NEEDED = ["userAgent", "viewport.w", "viewport.h", "appVersion", "result.query", "result.groups", "result.ungrouped", "result.rawProducts", "result.totalProducts", "result.countBySource", "result.timestamp"]


def valid_reports(bodies: DataFrame) -> DataFrame:
    """Bodies (column ``body``, JSON) with ``report`` and whether it is ``valid``."""
    parsed = bodies.withColumn("report", F.from_json("body", BODY))
    valid = F.coalesce(F.length("report.note") <= NOTE_MOST, F.lit(True))
    for path in NEEDED:
        valid = valid & F.col(f"report.{path}").isNotNull()
    return parsed.withColumn("valid", F.coalesce(valid, F.lit(False)))


def _number(c: Column) -> Column:
    return F.regexp_replace(c.cast("string"), r"\.0$", "")


def _lines(df: DataFrame, section: int, order: Column, text: Column) -> DataFrame:
    return df.select(F.lit(section).alias("section"), order.cast("string").alias("place"), text.alias("text"))


def report_lines(result: SearchResult, note: str | None = None, user_agent: str = "", viewport: str = "0x0", version: str = "", at: str = "") -> DataFrame:
    """(section, place, text) of the report, ordered by section and place.

    Sections: 1 header, 2 note, 3 query, 4 errors, 5 result, 6 attributes, 7 the
    result as JSON, a line for each offer.
    """
    spark = result.found.sparkSession
    fixed = [(1, ["=== HEADER ===", f"App version: {version}", f"Timestamp:   {at}", f"User agent:  {user_agent}", f"Viewport:    {viewport}"]), (2, ["=== USER NOTE ===", (note or "").strip() or "(none provided)"]), (3, ["=== QUERY ===", f"Query: {result.query}"]), (5, ["=== FINAL RESULT SHOWN TO USER ==="]), (6, ["=== LLM ENRICHMENT (per enriched product) ===", "name | brand | kind | organic | packGrams | packMl | count | variant"]), (7, ["=== FULL JSON DUMP ==="])]
    if result.enrichment_error:
        fixed.append((4, ["=== ERRORS ===", f"LLM enrichment: {result.enrichment_error}"]))
    parts = [spark.createDataFrame([(s, f"0:{i:02d}", t) for s, texts in fixed for i, t in enumerate(texts)], "section int, place string, text string")]
    place = lambda *c: F.concat_ws(":", *[F.lpad(x.cast("string"), 12, "0") if not isinstance(x, str) else F.lit(x) for x in c])
    parts.append(_lines(result.total(), 3, F.lit("1"), F.concat(F.lit("Total products after filtering: "), F.col("total").cast("string"))))
    by_source = result.counts.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("source_ord", "source", "n"))), lambda x: F.concat(x["source"], F.lit(": "), x["n"].cast("string"))), ", ").alias("t"))
    parts.append(_lines(by_source, 3, F.lit("2"), F.concat(F.lit("By source: "), F.col("t"))))
    if result.errors is not None:
        parts.append(_lines(result.errors, 4, F.concat(F.lit("1:"), F.col("source")), F.concat(F.lit("Scraper "), F.col("source"), F.lit(": "), F.col("error"))))
    head = F.concat(F.lit("Group: "), F.col("matched_name"), F.lit(" ("), F.col("n").cast("string"), F.lit(" sources, best price "), _number(F.col("best_price")), F.lit(" RON from "), F.col("best_price_source"), F.lit(")"))
    parts.append(_lines(result.groups, 5, place("1", F.col("group_rank"), "0"), head))
    offer = F.concat(F.lit("  - ["), F.col("source"), F.lit("] "), F.col("name"), F.lit(" — "), _number(F.col("price")), F.lit(" RON"))
    parts.append(_lines(result.members, 5, place("1", F.col("group_rank"), "1", F.col("member_rank")), offer))
    first = result.ungrouped.orderBy("rel").limit(SHOWN)
    score = 1000 - F.col("relevance_score")
    by_rel = (score, F.col("ord.source"), F.col("ord.a"), F.col("ord.b"))
    parts.append(_lines(first, 5, place("3", *by_rel), offer))
    loose = result.ungrouped.agg(F.count(F.lit(1)).alias("n"))
    parts.append(_lines(loose, 5, F.lit("2"), F.concat(F.lit("Ungrouped: "), F.col("n").cast("string"), F.lit(" products"))))
    parts.append(_lines(loose.filter(F.col("n") > SHOWN), 5, F.lit("4"), F.concat(F.lit("  ... and "), (F.col("n") - SHOWN).cast("string"), F.lit(" more"))))
    a = F.col("attributes")
    in_unit = lambda u: F.coalesce(F.when(a["pack"]["unit"] == u, _number(a["pack"]["value"])), F.lit(""))
    row = F.concat_ws(" | ", truncate(F.col("name"), 50), F.coalesce(a["brand"], F.lit("")), F.coalesce(a["kind"], F.lit("")), F.when(a["organic"], "yes").otherwise(""), in_unit("g"), in_unit("ml"), F.coalesce(_number(a["count"]), F.lit("")), F.coalesce(a["variant"], F.lit("")))
    parts.append(_lines(result.members, 6, place("1", F.col("group_rank"), F.col("member_rank")), row))
    parts.append(_lines(result.ungrouped, 6, place("2", *by_rel), row))
    parts.append(_lines(result.document(), 7, place("1", F.col("line")), F.col("text")))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every


def report_text(lines: DataFrame, most: int = BODY_MOST) -> DataFrame:
    """One row: the lines joined, cut at what an issue tracker takes."""
    # a line has its break at least, so later ones are beyond the cut
    lines = lines.orderBy("section", "place").limit(most + 2)
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("section", "place", "text"))), lambda x: x["text"]), "\n")
    return lines.agg(truncate(text, most).alias("text"))


def summary(result: SearchResult, note: str | None, issue_url: str) -> DataFrame:
    """One row: the short text that tells of a new report."""
    short = (note or "").strip()
    short = short if len(short) <= 200 else short[:199] + "…"
    by_source = result.counts.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("source_ord", "source", "n"))), lambda x: F.concat(x["source"], F.lit(": "), x["n"].cast("string"))), ", ").alias("t"))
    return by_source.select(F.concat_ws("\n", F.lit("New bug report filed."), F.lit(""), F.lit(f"Query:    {result.query}"), F.concat(F.lit("Sources:  "), F.col("t")), F.lit(f"Note:     {short or '(none)'}"), F.lit(""), F.lit(f"Issue:    {issue_url}")).alias("text"))

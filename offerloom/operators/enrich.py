"""Attributes attached by id, with a pluggable provider."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.prices import per_unit_price
from ..functions.text import some
from ..schema import ATTRIBUTES, PACK

RESPONSE = "array<struct<id:string,brand:string,kind:string,organic:boolean,packGrams:double,packMl:double,count:double,variant:string>>"
REQUIRED = {"id": "string", "brand": "string", "kind": "string", "organic": "boolean", "variant": "string"}
NULLABLE = {"packGrams": "number", "packMl": "number", "count": "number"}

#: Takes offers, returns a response as JSON text: one row, column ``body``.
Provider = Callable[[DataFrame], DataFrame]


def _json_kind(value: Column) -> Column:
    kind = F.schema_of_variant(value)
    return F.when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), "number").otherwise(F.lower(kind))


#: Fixed value: what a search tells when no model gave attributes.
UNAVAILABLE = "Categorization temporarily unavailable"
#: Offers that one call of a model is told of.
CALL = 140

#: Takes the lines that tell of a batch of offers, returns its response text.
Model = Callable[[list[str]], str]


def responses(offers: DataFrame, models: list[Model], most: int = CALL) -> DataFrame:
    """(query, body, error) of the models' answers to batches of offers.

    A batch holds up to ``most`` offers, and those of one query where ``offers``
    has a column ``query``. Models are tried in their order: one that raises an
    error with 503 in its text is passed over for the next, any other error and
    an empty answer end the batch. Either a body or an error is told of each
    batch. Calls are made where the offers are, so batches are answered side by
    side; a task that is run again asks again.
    """
    query = F.col("query").cast("string") if "query" in offers.columns else F.lit(None).cast("string")
    lines = offers.select(query.alias("query"), "ord", F.to_json(F.struct("id", "name")).alias("line"))
    if "query" in offers.columns:
        lines = lines.repartition("query")
    lines = lines.sortWithinPartitions("query", "ord").select("query", "line")

    def answer(batch: list[str]) -> tuple[str | None, str | None]:
        for model in models:
            try:
                return (body, None) if (body := model(batch)) else (None, UNAVAILABLE)
            except Exception as e:  # a model is foreign code: whatever it raises is its failure
                if "503" not in str(e):
                    break
        return None, UNAVAILABLE

    def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        told = lambda: pa.RecordBatch.from_arrays([pa.array([x], pa.string()) for x in (now, *answer(held))], ["query", "body", "error"])
        for rows in batches:
            for q, line in zip(rows.column("query").to_pylist(), rows.column("line").to_pylist()):
                if held and (q != now or len(held) == most):
                    yield told()
                    held = []
                now = q
                held.append(line)
        if held:
            yield told()

    return lines.mapInArrow(call, "query string, body string, error string")


def _judged(answers: DataFrame) -> DataFrame:
    """``answers`` (body, ...) with their elements, null unless all are as they must be."""
    items = F.expr("try_variant_get(try_parse_json(body), '$', 'array<variant>')")

    def typed(item: Column, key: str, kind: str, null: bool) -> Column:
        value = F.try_variant_get(item, f"$.{key}", "variant")
        found = F.coalesce(_json_kind(value), F.lit("absent"))
        return (found == kind) | (F.lit(null) & F.coalesce(F.is_variant_null(value), F.lit(False)))

    def valid(item: Column) -> Column:
        out = F.lit(True)
        for keys, null in ((REQUIRED, False), (NULLABLE, True)):
            for key, kind in keys.items():
                out = out & typed(item, key, kind, null)
        return out

    held = answers.select("*", F.explode(F.array(items)).alias("__items"))
    return held.withColumn("items", F.when(F.forall("__items", valid), F.col("__items"))).drop("__items")


def parse_response(answers: DataFrame) -> DataFrame:
    """(query if there is one, pos, id, brand, ... variant) of the elements of
    JSON arrays.

    All or nothing for each answer: if the body is no array or one element lacks
    a key or has a wrong type, it gives no rows.
    """
    own = ["query"] if "query" in answers.columns else []
    rows = _judged(answers.select(*own, "body")).select(*own, F.posexplode("items").alias("pos", "item"))
    columns = [F.try_variant_get("item", f"$.{k}", t).alias(k) for k, t in {**REQUIRED, **{k: "double" for k in NULLABLE}}.items()]
    return rows.select(*own, "pos", *columns)


def failures(answers: DataFrame) -> DataFrame:
    """(query, error) of the queries of which a batch has no valid answer."""
    bad = _judged(answers.select("query", "body", "error")).filter("error IS NOT NULL OR items IS NULL")
    return bad.groupBy("query").agg(F.min(F.coalesce("error", F.lit(UNAVAILABLE))).alias("error"))


def last_wins(rows: DataFrame) -> DataFrame:
    """One row for each id (of a query, if there is one), that with the largest ``pos``."""
    own = [c for c in ("query", "id") if c in rows.columns]
    values = [c for c in rows.columns if c not in (*own, "pos")]
    return rows.groupBy(*own).agg(F.max_by(F.struct(*values), "pos").alias("a")).select(*own, "a.*")


def attach_attributes(offers: DataFrame, attributes: DataFrame) -> DataFrame:
    """Offers with the attributes of their id; offers without keep their own.

    ``attributes`` has (pos, id, brand, kind, organic, packGrams, packMl, count,
    variant). Empty strings are absent; grams win over millilitres; attributes
    that a response cannot have stay.
    """
    own = F.col("attributes")
    by_query = "query" in attributes.columns and "query" in offers.columns
    found = last_wins(attributes if by_query else attributes.drop("query"))
    found = found.select(F.col("id").alias("__id"), *[F.col("query").alias("__query")] * by_query, F.struct("brand", "kind", "organic", "packGrams", "packMl", "count", "variant").alias("__a"))
    a = F.col("__a")
    plain = lambda c: F.regexp_replace(c.cast("string"), r"\.0$", "")
    size = F.coalesce(a["packGrams"], a["packMl"])
    unit = F.when(a["packGrams"].isNotNull(), "g").otherwise("ml")
    pack = F.when(size.isNotNull(), F.struct(size.alias("value"), unit.alias("unit"), F.concat(plain(size), unit).alias("original"))).cast(PACK)
    merged = F.struct(some(a["brand"]).alias("brand"), some(a["kind"]).alias("kind"), a["organic"].alias("organic"), pack.alias("pack"), a["count"].alias("count"), some(a["variant"]).alias("variant"), own["diaper_size"].alias("diaper_size")).cast(ATTRIBUTES)
    same = F.col("id") == F.col("__id")
    joined = offers.join(found, same & (F.col("query") == F.col("__query")) if by_query else same, "left")
    return joined.withColumn("attributes", F.when(a.isNotNull(), merged).otherwise(own)).drop("__id", "__query", "__a")


def with_per_unit(offers: DataFrame) -> DataFrame:
    return offers.withColumn("price_per_unit", per_unit_price(F.col("price"), F.col("attributes")))


def rule_attributes(offers: DataFrame) -> DataFrame:
    """A provider without a model: attributes read off the name by patterns.

    ``kind`` is the name without brand, pack and organic words, so equal products
    of several brands share it.
    """
    name = F.lower(F.coalesce("name", F.lit("")))
    number = lambda p: F.replace(F.nullif(F.regexp_extract(name, p, 1), F.lit("")), F.lit(","), F.lit(".")).try_cast("double")
    organic = name.rlike(r"(?<![a-z])(bio|organic|eco|ecologic)(?![a-z])")
    grams = F.coalesce(number(r"(\d+(?:[.,]\d+)?)\s*kg\b") * 1000, number(r"(\d+(?:[.,]\d+)?)\s*g(?:r|rame)?\b"))
    millis = F.coalesce(number(r"(\d+(?:[.,]\d+)?)\s*ml\b"), number(r"(\d+(?:[.,]\d+)?)\s*l(?:itri|itru)?\b") * 1000)
    count = number(r"(\d+)\s*(?:buc|bucati|pcs)\b")
    bare = F.regexp_replace(name, r"\d+(?:[.,]\d+)?\s*(?:kg|g|gr|grame|ml|l|litri|litru|buc|bucati|pcs)\b|(?<![a-z])(?:bio|organic|eco|ecologic)(?![a-z])", " ")
    kind = F.trim(F.regexp_replace(F.replace(bare, F.lower(F.coalesce("brand", F.lit("\x00"))), F.lit(" ")), r"[^\p{L}\p{N}]+", " "))
    return offers.select(F.lit(0).alias("pos"), "id", F.coalesce("brand", F.lit("")).alias("brand"), kind.alias("kind"), organic.alias("organic"), grams.alias("packGrams"), F.when(grams.isNull(), millis).alias("packMl"), count.alias("count"), F.coalesce("variant", F.lit("")).alias("variant"))


def prompt_lines(offers: DataFrame) -> DataFrame:
    """(ord, line): what a model is told of each offer, as JSON."""
    return offers.select("ord", F.to_json(F.struct("id", "name")).alias("line"))

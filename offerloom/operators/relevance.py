"""Relevance of offers to a query, from 0 to 100.

The query is normalised once on the driver; offers are normalised once each.
A score depends on the texts of an offer alone, so each distinct text is scored
once, however many offers share it.
Order is a sort key (score, then input order) and not a rank, so scoring and
grouping need no ranks; those are made for what is shown, without one task for all.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fuzzy import similarity
from ..functions.text import normalize_text, some, split_words, trim_ws, url_slug
from ..tables import numbered, small_or_whole, written

MIN_SCORE = 30
#: The columns of an offer that its texts are made of.
TEXTS = {"__t_name": "name", "__t_brand": "brand", "__t_url": "product_url", "__t_own": "attributes.brand", "__t_kind": "attributes.kind", "__t_variant": "attributes.variant"}


def normalize_query(query: str) -> str:
    """normalize_text() of one string."""
    text = unicodedata.normalize("NFD", query.lower())
    text = re.sub("[̀-ͯ]", "", text)
    text = re.sub(r"(?<![A-Za-z0-9_])spf\s*([0-9]+)\+?", r"spf\1", text)
    text = re.sub(r"[^A-Za-z0-9_\s﻿]", " ", text)
    return " ".join(re.split(r"[\s﻿]+", text)).strip()


def check_query(query: str | None) -> str:
    if not query or not query.strip():
        raise ValueError("a query is needed")
    return query


def searchable_text() -> Column:
    """Name, brand, end of the URL and attributes of an offer, joined."""
    slug = F.regexp_replace(url_slug(F.coalesce("product_url", F.lit(""))), "[-_]", " ")
    a = F.col("attributes")
    return F.concat_ws(" ", some(F.col("name")), some(F.col("brand")), some(slug), some(a["brand"]), some(a["kind"]), some(a["variant"]))


def name_score(name: Column, query: Column) -> Column:
    return F.when(name == query, 40).when(F.contains(name, query), 30).when(F.contains(query, name), 25).otherwise(0)


def _listed(words: list[str] | Column) -> Column:
    return words if isinstance(words, Column) else F.array(*map(F.lit, words)).cast("array<string>")


def _share(n: Column, words: Column, most: float) -> Column:
    return F.when(F.size(words) > 0, n / F.size(words).cast("double") * F.lit(most)).otherwise(0.0)


def coverage_score(haystack: Column, words: list[str] | Column) -> Column:
    """Points for the distinct words of the query that are among the text's."""
    words = _listed(words)
    return _share(F.size(F.array_intersect(words, split_words(haystack))), words, 30.0)


def order_score(haystack: Column, words: list[str] | Column) -> Column:
    """Points for the words found one after the other, a missing one skipped."""
    words = _listed(words)
    begin = F.struct(F.lit(0).alias("last"), F.lit(0).alias("n"))

    def step(acc: Column, w: Column) -> Column:
        at = F.call_function("locate", w, haystack, acc["last"] + 1)
        return F.struct(F.when(at > 0, at).otherwise(acc["last"]).alias("last"), (acc["n"] + (at > 0).cast("int")).alias("n"))

    return _share(F.aggregate(words, begin, step)["n"], words, 15.0)


def fuzzy_score(name: Column, query: Column) -> Column:
    """Points for where the query is found in the name, errors allowed."""
    return similarity(name, query) * F.lit(15.0)


def _once(df: DataFrame, value: Column, name: str) -> DataFrame:
    """``df`` with ``value``, made once for each row however often it is read:
    neither filters nor other expressions take what a generator makes apart."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def keyed(offers: DataFrame) -> DataFrame:
    """Offers with the columns TEXTS; null and the empty string are the same text."""
    return offers.select("*", *[F.coalesce(F.col(c), F.lit("")).alias(k) for k, c in TEXTS.items()])


def distinct_texts(with_key: DataFrame) -> DataFrame:
    """The texts of ``keyed`` offers, once each, under the names that offers have."""
    own = F.struct(*[F.col(k).alias(TEXTS[k].split(".")[1]) for k in ("__t_own", "__t_kind", "__t_variant")])
    texts = with_key.select(*TEXTS).distinct()
    return texts.select("*", F.col("__t_name").alias("name"), F.col("__t_brand").alias("brand"), F.col("__t_url").alias("product_url"), own.alias("attributes"))


def by_text(offers: DataFrame, made: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """Offers with the column ``name`` that ``made`` adds to their texts."""
    own = keyed(offers)
    told = written(made(distinct_texts(own)).select(*TEXTS, name), "texts")
    return own.join(small_or_whole(told), list(TEXTS)).select(*offers.columns, name)


def score(offers: DataFrame, query: str) -> DataFrame:
    """Offers with ``relevance_score``."""
    normal = normalize_query(check_query(query))
    words = list(dict.fromkeys(w for w in normal.split(" ") if len(w) > 2))
    asked = F.struct(F.lit(normal).alias("normal"), _listed(words).alias("words"))
    return by_text(offers, lambda texts: _scored(texts, asked), "relevance_score")


def score_each(offers: DataFrame, asked: str = "asked") -> DataFrame:
    """Offers with ``relevance_score`` to the query in their own column ``asked``;
    those of a null or blank query go."""
    some = offers.filter(F.coalesce(trim_ws(F.col(asked)), F.lit("")) != "")
    normal = normalize_text(F.col(asked))
    return _scored(some, F.struct(normal.alias("normal"), F.array_distinct(split_words(normal)).alias("words")))


def _scored(offers: DataFrame, query: Column) -> DataFrame:
    """``query`` is a struct of the normalised query and its distinct words."""
    own = F.struct(normalize_text(F.coalesce("name", F.lit(""))).alias("name"), normalize_text(searchable_text()).alias("hay"), query.alias("q"))
    texts = _once(offers, own, "__text")
    name, hay, q, words = (F.col(f"__text.{c}") for c in ("name", "hay", "q.normal", "q.words"))
    total = name_score(name, q) + coverage_score(hay, words) + order_score(hay, words) + fuzzy_score(name, q)
    return _once(texts, F.least(F.lit(100), F.floor(total + 0.5).cast("int")), "relevance_score").drop("__text")


def relevant(offers: DataFrame, query: str, min_score: int = MIN_SCORE) -> DataFrame:
    """Offers that reach the score, with the key ``rel`` that orders them."""
    return reaching(score(offers, query), min_score)


def reaching(scored: DataFrame, min_score: int = MIN_SCORE) -> DataFrame:
    """Scored offers that reach the score, with the key ``rel`` that orders them."""
    found = scored.filter(F.col("relevance_score") >= min_score)
    return found.withColumn("rel", F.struct((-F.col("relevance_score")).alias("score"), "ord"))


def ranked(found: DataFrame, by: str = "rel", name: str = "rel_rank") -> DataFrame:
    """Rank, from 1, among what is shown for one query."""
    return numbered(found, [by], name, start=1)

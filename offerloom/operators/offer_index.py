"""An inverted index of offers, for a table of queries over offers that have none.

What an offer can score bounds how many of a query's words it must hold: a word
gives at most 45 / n of the points for n words, and the fuzzy points stay below
15 (1 - 1/m) for m characters unless the name holds the query (and then the offer
holds all its words). So an offer that lacks too many words can't reach the
score, and one that can holds one of the query's rarest words. Only those are
looked up, so a word that nearly all offers have is looked up by no query that
has enough others.

A query's word counts where it is part of a word too, so words are first looked
for in the vocabulary, which is far smaller than the offers. Names that are part
of a query are found by their first characters. Nothing is lost: candidates are
scored in full, and pairs that are no candidates can't reach the score.

The index is of distinct texts, each with a number; offers meet their text last,
so that queries are looked up and scored once for all offers of one text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fuzzy import CHUNK
from ..functions.text import normalize_text, split_words, trim_ws
from ..tables import small_or_whole, written
from .relevance import MIN_SCORE, TEXTS, _once, distinct_texts, keyed, score_each, searchable_text

#: Points of a query's words, of the fuzzy part, and of a name within the query.
WORDS, FUZZY, WITHIN = 45.0, 15.0, 25.0
#: Characters of a piece of a word, and of a name's beginning, at most.
GRAM, HEAD = 3, 8
#: Offers of a word that go to one task, if that is no more than their share.
AT_ONCE = 20_000
#: Words that can have more than one part of this many of all postings.
HOT_WORDS = 1000


@dataclass
class OfferIndex:
    """``offers``: the offers as they came; ``texts``: their distinct texts with
    ``__offer``, a text's number, and ``__name``; ``postings``: (v, __offer, blank)
    of each word of a text, blank where its name has no words; ``words``: (v, df)."""

    offers: DataFrame
    texts: DataFrame
    postings: DataFrame
    words: DataFrame


def build(offers: DataFrame) -> OfferIndex:
    """Written tables, so that an index serves any number of searches; the offers
    themselves are read again by each."""
    own = F.struct(normalize_text(F.coalesce("name", F.lit(""))).alias("name"), normalize_text(searchable_text()).alias("hay"))
    plain = distinct_texts(keyed(offers))
    texts = _once(plain, own, "__text").select(*plain.columns, F.col("__text.name").alias("__name"), F.array_distinct(F.split("__text.hay", " ")).alias("__words"))
    # written at once, so that the numbers stay
    texts = written(texts.withColumn("__offer", F.monotonically_increasing_id()), "offer-texts")
    postings = written(texts.select(F.explode("__words").alias("v"), "__offer", (F.col("__name") == "").alias("blank")), "postings")
    words = written(postings.groupBy("v").agg(F.count(F.lit(1)).alias("df")), "vocabulary")
    return OfferIndex(offers, texts.drop("__words"), postings, words)


def _pieces(text: Column, most: int) -> Column:
    """Distinct substrings of up to ``most`` characters, the empty one too."""
    places = lambda size: F.when(F.length(text) >= size, F.transform(F.sequence(F.lit(1), F.length(text) - size + 1), lambda i: F.substring(text, i, F.lit(size)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(F.lit("")), *[places(n) for n in range(1, most + 1)]))


def needs(normal: Column, words: Column, min_score: int) -> Column:
    """How many of its words an offer must hold; 0 where none need be."""
    fuzzy = F.when(F.length(normal) <= CHUNK, FUZZY * (1.0 - F.try_divide(F.lit(1.0), F.length(normal)))).otherwise(FUZZY)
    points = F.lit(min_score - 0.5) - F.coalesce(fuzzy, F.lit(FUZZY))
    return F.greatest(F.lit(0), F.ceil(points * F.size(words) / WORDS - 1e-9)).cast("int")


def _probes(index: OfferIndex, queries: DataFrame, min_score: int) -> DataFrame:
    """(query, v, df, rare): words of the vocabulary to look up for each query;
    those that are not rare matter to offers with a blank name only."""
    longest = F.array_max(F.transform(F.split("normal", " "), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    need = needs(F.col("normal"), F.col("words"), min_score)
    # a query without words, or a score that no word is needed for
    none = (F.size("words") > 0) & ((need <= 0) | F.lit(min_score - 0.5 <= WITHIN))
    anything = F.when(none | F.lit(min_score - 0.5 <= FUZZY), F.array(F.lit(""))).when(F.size("words") == 0, F.array(longest))
    asked = queries.select("query", F.greatest(need, F.lit(1)).alias("need"), F.coalesce(anything, F.col("words")).alias("look"))
    asked = written(asked.select("query", "need", F.size("look").alias("n"), F.explode("look").alias("w")), "look-ups")
    wanted = asked.select("w").distinct().withColumn("gram", F.substring("w", 1, GRAM))
    pieces = index.words.select("v", "df", F.explode(_pieces(F.col("v"), GRAM)).alias("gram"))
    held = written(wanted.join(pieces, "gram").filter(F.contains("v", "w")).select("w", "v", "df"), "held-words")
    total = held.groupBy("w").agg(F.sum("df").alias("total"))
    told = asked.join(total, "w", "left").withColumn("entry", F.struct(F.coalesce("total", F.lit(0)).alias("total"), "w"))
    rarest = told.groupBy("query").agg(F.sort_array(F.collect_list("entry")).alias("all"), F.first("need").alias("need"), F.first("n").alias("n"))
    ranked = rarest.select("query", (F.col("n") - F.col("need") + 1).alias("keep"), F.posexplode("all").alias("at", "e"))
    ranked = ranked.select("query", F.col("e.w").alias("w"), (F.col("at") < F.col("keep")).alias("rare"))
    return ranked.join(held, "w").groupBy("query", "v", "df").agg(F.max("rare").alias("rare"))


def _within(index: OfferIndex, queries: DataFrame) -> DataFrame:
    """(query, __offer): offers whose name, not blank, is part of the query."""
    names = index.texts.filter("__name <> ''").groupBy("__name").agg(F.count(F.lit(1)).alias("df")).withColumn("head", F.substring("__name", 1, HEAD))
    heads = queries.select("query", "normal", F.explode(_pieces(F.col("normal"), HEAD)).alias("head"))
    held = heads.join(names, "head").filter(F.contains("normal", "__name")).select("query", F.col("__name").alias("v"), "df")
    return _looked_up(held, index.texts.select(F.col("__name").alias("v"), "__offer"))


def _looked_up(probes: DataFrame, postings: DataFrame, only: Column | None = None) -> DataFrame:
    """(query, __offer) of probes (query, v, df, ...) and postings (v, __offer, ...).

    The offers of a word with over a thousandth of all postings are dealt to as
    many tasks as that needs; there are under a thousand such words, whatever the
    size, so they are broadcast.
    """
    most = max(AT_ONCE, postings.count() // HOT_WORDS)
    parts = F.ceil(F.col("df") / most).cast("bigint")
    hot = probes.filter(F.col("df") > most).groupBy("v").agg(F.max(parts).alias("parts"))
    dealt = postings.join(F.broadcast(hot), "v", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("__offer"), F.col("parts")), F.lit(0))).drop("parts")
    asked = probes.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1)))
    found = asked.join(dealt, ["v", "part"])
    return (found if only is None else found.filter(only)).select("query", "__offer")


def _pairs(index: OfferIndex, asked: DataFrame, min_score: int) -> DataFrame:
    """(query, __offer) of every query and text that can reach the score.

    ``asked`` is (query, asked), one row for each query; a null or blank text has
    no offers. A text that normalises to nothing is part of every name, so all
    offers answer it.
    """
    some = asked.filter(F.coalesce(trim_ws(F.col("asked")), F.lit("")) != "")
    normal = _once(some, normalize_text(F.col("asked")), "normal")
    queries = written(normal.select("query", "normal", F.array_distinct(split_words(F.col("normal"))).alias("words")), "queries")
    by_word = _looked_up(_probes(index, queries, min_score), index.postings, F.col("rare") | F.col("blank"))
    return by_word.union(_within(index, queries)).distinct()


def _of_offers(index: OfferIndex, told: DataFrame) -> DataFrame:
    """The offers of each text in ``told`` (__offer, ...), with its other columns.
    Offers that repeat an id are each by themselves."""
    numbered = keyed(index.offers).join(small_or_whole(index.texts.select(*TEXTS, "__offer")), list(TEXTS)).drop(*TEXTS)
    return numbered.join(small_or_whole(written(told, "told")), "__offer").drop("__offer")


def candidates(index: OfferIndex, asked: DataFrame, min_score: int = MIN_SCORE) -> DataFrame:
    """Offers with ``query``, of every pair that can reach the score."""
    return _of_offers(index, _pairs(index, asked, min_score))


def matches(index: OfferIndex, asked: DataFrame, min_score: int = MIN_SCORE) -> DataFrame:
    """Offers with ``query`` and ``relevance_score``, of every pair that reaches it."""
    pairs = _pairs(index, asked, min_score).join(index.texts, "__offer").join(asked.select("query", "asked"), "query")
    scored = score_each(pairs).filter(F.col("relevance_score") >= min_score)
    return _of_offers(index, scored.select("__offer", "query", "relevance_score"))

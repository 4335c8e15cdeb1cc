"""Searches of many queries over offers that belong to none, against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from offerloom.operators import offer_index, relevance
from offerloom.plans import many
from offerloom.schema import SOURCES

from .test_engine import frame, offer

ODD_QUERIES = [("none", None), ("blank", "  "), ("marks", "!!!"), ("short", "a b"), ("one", "c"), ("part", "olt"), ("long", "red bolt for the blue garden gate with a small hot plate and ring")]
ODD_OFFERS = ["", "火", "!?", "a b", "ab", "c", "bolts", "revolt", "b", "Bolț roșu", "SPF 50+ bolt", "supercalifragilisticbolt1", "red bolt for the blue garden gate with a small hot plate and ring", "the garden gate"]


def offers(spark, n, seed):
    rnd = random.Random(seed)
    words = "red blue hot cold bolt bolts ring plate spf50 gate brandx gar en den a ii".split()
    # one word that nearly all have
    rows = [offer(rnd.choice(SOURCES), " ".join(rnd.choices(words, k=rnd.randint(1, 5))), 1, brand=rnd.choice(["brandx"] * 9 + [None]), url=rnd.choice(["", "https://x.ro/red-olt/"]), i=i, ident=f"n{i}") for i in range(n)]
    rows += [offer("dm", name, 1, i=n + i, ident=f"odd{i}", brand=rnd.choice([None, "Red Plate"])) for i, name in enumerate(ODD_OFFERS)]
    return frame(spark, [*rows, rows[0], rows[-1]])


def queries(spark, n, seed):
    rnd = random.Random(seed)
    words = "red blue hot cold bolt bol ring plate spf gate brandx garden xyz a ii".split()
    rows = [(f"q{i}", " ".join(rnd.choices(words, k=rnd.randint(1, 7)))) for i in range(n)]
    return spark.createDataFrame(rows + ODD_QUERIES, "query string, asked string")


def found(df):
    return sorted((r.query, r.id, r.relevance_score) for r in df.collect())


@pytest.mark.parametrize("min_score", [30, 55, 12])
def test_no_pair_is_lost(spark, min_score):
    every, asked = offers(spark, 150, 1).cache(), queries(spark, 40, 2).cache()
    index = offer_index.build(every)
    met = offer_index.candidates(index, asked, min_score)
    scored = lambda pairs: relevance.reaching(relevance.score_each(pairs), min_score)
    want = found(scored(every.join(asked)))
    assert found(scored(met.join(asked, "query"))) == want and len(want) > 200
    pairs = met.groupBy("query", "id").count()
    if min_score == 55:
        # fewer than half of all pairs are scored
        assert pairs.count() < every.count() * asked.count() / 2


def test_words_dealt_to_many_tasks(spark, monkeypatch):
    """The same rows where each word is split as a frequent one is."""
    every, asked = offers(spark, 80, 3).cache(), queries(spark, 15, 4)
    index = offer_index.build(every)
    plain = lambda: sorted((r.query, r.id) for r in offer_index.candidates(index, asked).select("query", "id").collect())
    want = plain()
    monkeypatch.setattr(offer_index, "AT_ONCE", 3)
    monkeypatch.setattr(offer_index, "HOT_WORDS", 200)
    assert plain() == want


def test_a_common_word_is_looked_up_by_none_that_has_others(spark):
    rows = [offer("dm", f"red brandx {i:05d}", 1, i=i) for i in range(300)] + [offer("dm", "blue gate brandx", 1, i=300)]
    asked = spark.createDataFrame([("q", "blue gate brandx")], "query string, asked string")
    met = offer_index.candidates(offer_index.build(frame(spark, rows)), asked)
    assert [r.name for r in met.collect()] == ["blue gate brandx"]


def test_need_is_a_bound(spark):
    df = spark.createDataFrame([("blue gate brandx", ["blue", "gate", "brandx"]), ("ab", []), ("", [])], "n string, w array<string>")
    got = [r.x for r in df.select(offer_index.needs(F.col("n"), F.col("w"), 30).alias("x")).collect()]
    # 29.5 less 15 * 15/16 leaves 15.4 of 45 points, so over one word of three
    assert got == [2, 0, 0]


def test_empty_tables(spark):
    every, asked = offers(spark, 5, 5), queries(spark, 2, 6)
    assert many.search_table(every.limit(0), asked).found.collect() == []
    assert many.search_table(every, asked.limit(0)).found.collect() == []

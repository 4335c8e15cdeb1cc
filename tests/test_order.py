"""Global order and TTL chains at shapes that skew would break."""

import random

from pyspark.sql import functions as F

from offerloom.operators import cache, grouping, relevance, standout
from offerloom.plans import many
from offerloom.tables import numbered


def replay(requests, ttl):
    """One request after the other."""
    until, out = {}, []
    for key, at, seq, n in sorted(requests, key=lambda r: (r[0] or "", r[1], r[2], r[3])):
        hit = until.get(key, -1) >= at
        if not hit:
            until[key] = at + ttl if n > 0 else -1
        out.append((key, at, seq, hit))
    return sorted(out, key=repr)


def hits(spark, requests, ttl):
    df = spark.createDataFrame(requests, "key string, at_ms bigint, seq bigint, n_results int")
    return sorted(map(tuple, cache.cache_hits(df, ttl).collect()), key=repr)


def test_numbers_follow_the_order(spark):
    r = random.Random(1)
    rows = [(r.randrange(50), i, f"x{i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "a int, b int, place string").repartition(7)
    got = numbered(df, [F.desc("a"), F.col("b")], "n", start=1).orderBy("n").collect()
    assert [(g.a, g.b, g.place) for g in got] == sorted(rows, key=lambda x: (-x[0], x[1]))
    assert [g.n for g in got] == list(range(1, 3001))
    assert numbered(df.limit(0), ["a"], "n").collect() == []


def test_ranks_are_not_one_task(spark):
    """No window over all rows: SinglePartition is in no plan."""
    df = spark.range(1000).select(F.col("id").alias("rel"), (F.col("id") % 70).alias("score"), F.col("id").alias("first"))
    for made in (relevance.ranked(df), grouping.numbered(df)):
        assert "SinglePartition" not in made._jdf.queryExecution().executedPlan().toString()


def test_chains_against_a_replay(spark):
    r = random.Random(5)
    requests = [(r.choice(["hot"] * 6 + ["a", "b", "c:d", None]), r.randrange(4000), i, r.choice([0, 1, 3])) for i in range(1500)]
    # ties in time, and rows that repeat
    requests += requests[:40] + [("tie", 5, 0, 0), ("tie", 5, 1, 2), ("tie", 5, 2, 0), ("tie", 105, 3, 1), ("tie", 106, 4, 0), ("tie", 107, 5, 1)]
    for ttl in (0, 25, 100):
        assert hits(spark, requests, ttl) == replay(requests, ttl)


def test_one_key_spreads_over_tasks(spark):
    """A long chain of one key: each range of its requests is its own task's."""
    requests = [("k", i * 10, i, 1) for i in range(5000)]
    got = hits(spark, requests, 25)
    assert got == replay(requests, 25)
    assert sum(not g[3] for g in got) == 1667


def test_odd_requests(spark):
    assert hits(spark, [], 10) == []
    assert hits(spark, [("k", 1, 1, None), ("k", 2, 2, 0), ("k", None, 3, 5), ("k", 3, 4, 1), ("k", 4, 5, None)], 10) == sorted([("k", 1, 1, False), ("k", 2, 2, False), ("k", None, 3, False), ("k", 3, 4, False), ("k", 4, 5, True)], key=repr)


def test_queries_do_not_meet(spark):
    """Groups, ranks and deals are those of each query by itself."""
    offers = "query string, id string, name string, price double, source string, kind string, grams double"
    rows = [("q1", "a", "red tea", 10.0, "dm", "tea", 100.0), ("q1", "b", "red tea", 8.0, "emag", "tea", 100.0), ("q1", "c", "red tea big", 6.0, "dm", "tea", 200.0), ("q2", "a", "red tea", 10.0, "dm", "tea", 100.0), ("q2", "c", "red tea big", 6.0, "dm", "tea", 200.0), ("q3", "a", "soap", 1.0, "dm", "soap", 1.0), ("q4", "a", "red tea", 1.0, "dm", "tea", 1.0)]
    df = spark.createDataFrame(rows, offers)
    none = lambda t: F.lit(None).cast(t)
    a = F.struct(none("string").alias("brand"), F.col("kind"), F.lit(False).alias("organic"), F.struct(F.col("grams").alias("value"), F.lit("g").alias("unit"), F.lit("").alias("original")).alias("pack"), none("double").alias("count"), none("string").alias("variant"), none("string").alias("diaper_size"))
    df = df.select("query", "id", "name", "price", F.lit("RON").alias("currency"), F.lit("").alias("image_url"), F.lit("").alias("product_url"), "source", none("string").alias("brand"), none("string").alias("variant"), a.alias("attributes"), none("struct<value:double,unit:string>").alias("price_per_unit"), F.struct(F.lit(0).alias("source"), F.ascii("id").cast("bigint").alias("a"), F.lit(0).cast("bigint").alias("b")).alias("ord"))
    asked = spark.createDataFrame([("q1", "red tea"), ("q2", "RED  Tea"), ("q3", "car"), ("q4", "  ")], "query string, asked string")
    made = many.search_each(df, asked)
    assert sorted((r.query, r.id) for r in made.found.collect()) == [("q1", "a"), ("q1", "b"), ("q1", "c"), ("q2", "a"), ("q2", "c")]
    assert [(r.query, r.group_id, r.group_rank, r.n, r.best_price_source) for r in made.groups.collect()] == [("q1", "group-0", 1, 2, "emag")]
    assert sorted((r.query, r.id, r.is_best) for r in made.members.collect()) == [("q1", "a", False), ("q1", "b", True)]
    assert [(r.query, r.id) for r in made.deals.collect()] == [("q1", "c")]
    assert sorted((r.query, r.id) for r in made.ungrouped.collect()) == [("q2", "a"), ("q2", "c")]
    assert standout.standout_each(made.ungrouped, made.groups, ("query",)).collect() == []

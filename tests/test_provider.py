"""Models that answer, fail over, fail and answer badly."""

import json

from pyspark.sql import functions as F

from offerloom.operators import enrich
from offerloom.plans import many

ITEM = {"brand": "", "kind": "tea", "organic": False, "packGrams": 100, "packMl": None, "count": None, "variant": ""}


def answer(lines):
    return json.dumps([{"id": json.loads(line)["id"], **ITEM} for line in lines])


def unavailable(lines):
    raise RuntimeError("503 Service Unavailable")


def broken(lines):
    raise ValueError("400 bad request")


def by_query(lines):
    """A bad schema for one query, an error for another, one element wrong for a third."""
    first = json.loads(lines[0])["id"]
    if first.startswith("bad"):
        return '[{"bad":"schema"}]'
    if first.startswith("err"):
        raise ValueError("500")
    if first.startswith("part"):
        return json.dumps([{"id": "part1", **ITEM}, {"id": 2}])
    return answer(lines)


def offers(spark, *ids):
    rows = [(q, i, n) for n, (q, i) in enumerate(ids)]
    df = spark.createDataFrame(rows, "query string, id string, n bigint")
    return df.select("query", "id", F.lit("red tea").alias("name"), F.struct(F.lit(0).alias("source"), F.col("n").alias("a"), F.lit(0).cast("bigint").alias("b")).alias("ord"))


def test_models_in_their_order(spark):
    some = offers(spark, ("q", "a"), ("q", "b"))
    got = lambda *models: [(r.body is not None, r.error) for r in enrich.responses(some, list(models)).collect()]
    assert got(answer, broken) == [(True, None)]
    assert got(unavailable, answer) == [(True, None)]
    assert got(unavailable, unavailable) == [(False, enrich.UNAVAILABLE)]
    assert got(broken, answer) == [(False, enrich.UNAVAILABLE)]
    assert got(lambda lines: "", answer) == [(False, enrich.UNAVAILABLE)]
    assert got() == [(False, enrich.UNAVAILABLE)]


def test_batches_are_bounded_and_of_one_query(spark):
    some = offers(spark, *[("q1", f"a{i}") for i in range(7)], *[("q2", f"b{i}") for i in range(2)])
    bodies = [[x["id"] for x in json.loads(r.body)] for r in enrich.responses(some, [answer], most=3).collect()]
    assert sorted(bodies) == [["a0", "a1", "a2"], ["a3", "a4", "a5"], ["a6"], ["b0", "b1"]]
    assert len(enrich.responses(some.drop("query"), [answer], most=100).collect()) <= some.rdd.getNumPartitions()


def test_all_or_nothing_for_each_answer(spark):
    some = offers(spark, ("q1", "a"), ("q2", "bad"), ("q3", "err"), ("q4", "part1"), ("q4", "part2"))
    answers = enrich.responses(some, [by_query])
    assert [(r.query, r.id, r.kind, r.packGrams) for r in enrich.parse_response(answers).collect()] == [("q1", "a", "tea", 100.0)]
    assert sorted(map(tuple, enrich.failures(answers).collect())) == [(q, enrich.UNAVAILABLE) for q in ("q2", "q3", "q4")]


def test_queries_without_attributes_degrade(spark):
    """What one query's models failed at leaves the groups of the others."""

    def body(prefix):
        return json.dumps({"data": {"products": [{"_id": f"{prefix}r", "slug": "s", "name": "red tea", "finalPrice": 900}]}})

    def dm(prefix):
        return json.dumps({"products": [{"dan": f"{prefix}d", "title": "red tea", "tileData": {"self": "/s", "trackingData": {"price": 7.5}}}]})

    rows = [(s, q, 200, f(p)) for q, p in (("good", "x"), ("lost", "err")) for s, f in (("realfoods", body), ("dm", dm))]
    stored = spark.createDataFrame(rows, "source string, query string, status int, body string")
    asked = spark.createDataFrame([("good", "red tea"), ("lost", "red tea")], "query string, asked string")

    def model(lines):
        if "err" in lines[0]:
            raise ValueError("quota")
        return answer(lines)

    made = many.search_payloads(stored, asked, models=[unavailable, model])
    assert [(r.query, r.k_kind, r.n, r.best_price) for r in made.groups.collect()] == [("good", "tea", 2, 7.5)]
    assert sorted((r.query, r.source) for r in made.ungrouped.collect()) == [("lost", "dm"), ("lost", "realfoods")]
    assert {(r.query, r.source): (r.n, r.error) for r in made.outcome.collect()}[("good", "emag")] == (0, "unknown")

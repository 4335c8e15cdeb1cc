"""What larger tables need: nothing that grows with them in one row, task or worker."""

import json
import unicodedata
from contextlib import contextmanager

from pyspark.sql import functions as F

from offerloom import tables
from offerloom.functions import text
from offerloom.operators import grouping, offer_index, relevance, standout
from offerloom.plans import many
from offerloom.plans.search import search
from offerloom.queries import QUERIES
from offerloom.schema import SOURCES
from offerloom.sources import payloads

from .test_engine import frame, offer


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_every_character_normalises_as_by_decomposition(spark):
    """Without Python, the same as with the decomposition of each character."""
    every = [chr(c) for c in range(1, 0x30000) if not 0xD800 <= c < 0xE000]
    rows = [(c, f"a{c}b spf{c}5+ {c}") for c in every]
    df = spark.createDataFrame(rows, "c string, t string").repartition(4)
    old = text.strip_accents(F.lower("t"))
    old = F.regexp_replace(old, rf"(?<![A-Za-z0-9_])spf{text.WS}*([0-9]+)\+?", "spf$1")
    old = text.trim_ws(text.collapse_ws(F.regexp_replace(old, "[^A-Za-z0-9_" + text.WS[1:], " ")))
    new = df.select("t", text.normalize_text(F.col("t")).alias("n"))
    assert "Python" not in _plan(new) and "ArrowEval" not in _plan(new)
    both = df.select("c", text.normalize_text(F.col("t")).alias("n"), old.alias("o"))
    assert both.filter("n <> o").collect() == []
    assert unicodedata.normalize("NFD", "ș") != "ș" and new.filter("n = 'asb spfs5 s'").count() > 0


def test_a_text_is_scored_once(spark, monkeypatch):
    """Offers that share their texts take its score, broadcast or not; null and
    empty are one text."""
    rows = [offer("dm", "red widget", 1, brand=b, i=i, ident=f"n{i}") for i, b in enumerate([None, "", "x", None] * 5)]
    every = frame(spark, rows)
    assert relevance.distinct_texts(relevance.keyed(every)).count() == 2
    want = sorted(map(tuple, relevance.score(every, "red widget").select("id", "relevance_score").collect()))
    assert len(want) == 20
    monkeypatch.setattr(tables, "SMALL", 0)
    assert sorted(map(tuple, relevance.score(every, "red widget").select("id", "relevance_score").collect())) == want


def test_the_index_is_of_texts(spark):
    every = frame(spark, [offer("dm", f"red widget {i % 3}", 1, i=i, ident=f"n{i}") for i in range(60)])
    index = offer_index.build(every)
    assert index.texts.count() == 3 and index.postings.count() < 20
    asked = spark.createDataFrame([("q", "red widget 1")], "query string, asked string")
    assert many.search_table(index, asked).matches.count() == 60


def test_the_document_has_a_row_for_each_offer(spark):
    rows = [offer(s, f"red widget {i}", 5 + i, kind=f"k{i % 3}", pack=(100 + 100 * (i > 17), "g"), i=i, ident=f"{s}{i}") for i, s in enumerate(SOURCES * 3)]
    result = search(frame(spark, rows), "red widget")
    lines = [r.text for r in result.document().orderBy("line").collect()]
    told = json.loads("\n".join(lines))
    assert max(x.count('"product_url"') for x in lines) == 1
    assert list(told)[:4] == ["query", "groups", "ungrouped", "total"] and told["total"] == len(rows)
    assert [[p["id"] for p in g["products"]] for g in told["groups"]] == [[m.id for m in result.members.filter(F.col("group_rank") == i + 1).orderBy("member_rank").collect()] for i in range(len(told["groups"]))]
    assert [p["id"] for p in told["ungrouped"]] == [r.id for r in result.ungrouped.orderBy("rel").collect()]
    assert sum(told["count_by_source"].values()) == len(rows)
    none = search(frame(spark, rows), "qqqq zzzz")
    assert json.loads("\n".join(r.text for r in none.document().orderBy("line").collect()))["groups"] == []


def test_pages_are_bounded_and_batches_small(spark, tmp_path, monkeypatch):
    """Twice the parts make twice the pages, none longer, and all offers."""
    small = "/root/testdata/sf0.001"
    for t in ("part", "lineitem"):
        key = "p_partkey" if t == "part" else "l_partkey"
        df = spark.read.parquet(f"{small}/{t}.parquet")
        df.union(df.withColumn(key, F.col(key) + 1000)).write.parquet(f"{tmp_path}/{t}.parquet")
    seen, read = [], payloads.json_ld_offers
    monkeypatch.setattr(payloads, "json_ld_offers", lambda pages, source: seen.append(pages) or read(pages, source))
    n = [QUERIES["jsonld_walk"](spark, d).select("query", "id").distinct().count() for d in (small, str(tmp_path))]
    longest = [p.agg(F.count("body"), F.max(F.length("body"))).first() for p in seen]
    assert n[1] == 2 * n[0] == 2 * QUERIES["per_unit_price"](spark, small).count()
    assert longest[1][0] == 2 * longest[0][0] and longest[1][1] <= longest[0][1] + 200
    assert int(spark.conf.get(tables.BATCH)) == tables.BATCH_BYTES


def test_offers_are_dealt_by_their_number(spark, monkeypatch):
    """Tasks become more and not larger as lines do, with the same rows, and a
    reader of one attribute makes that one."""
    from offerloom.sources import offers as made

    small = "/root/testdata/sf0.001"
    want = sorted(map(tuple, QUERIES["group_best_source"](spark, small).collect()), key=repr)
    monkeypatch.setattr(made, "LINES_A_TASK", 100)
    every = made.offers(spark, small)
    assert "REPARTITION_BY_NUM" in _plan(every)
    assert "cast(struct" not in _plan(every.select("attributes.kind", "price_per_unit.value"))
    assert sorted(map(tuple, QUERIES["group_best_source"](spark, small).collect()), key=repr) == want


def test_groups_meet_in_as_many_tasks_as_their_lines_want(spark, monkeypatch):
    """However few partitions the session's shuffles have, and those stay as they
    were; and a reader of the confidence makes no attributes."""
    from offerloom.sources import offers as made

    small, names = "/root/testdata/sf0.001", ["group_summary", "group_best_source", "group_members_ranked", "ungrouped_anti"]
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    want = {n: rows(QUERIES[n](spark, small)) for n in names}
    wrote, written = [], tables.written
    monkeypatch.setattr(tables, "written", lambda *a, **k: wrote.append(written(*a, **k)) or wrote[-1])
    monkeypatch.setattr("offerloom.queries.written", tables.written)
    monkeypatch.setattr(made, "LINES_A_TASK", 100)
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for n in names:
            wrote.clear()
            assert rows(QUERIES[n](spark, small)) == want[n]
            assert wrote and all(len(df.inputFiles()) > 10 * int(before) for df in wrote), n
            assert spark.conf.get(key) == before
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    kept = grouping.groups(made.offers(spark, small), "ord").select("match_confidence")
    assert "min_by(attributes" not in _plan(kept)


def test_lines_are_read_in_as_many_splits_as_they_want(spark, tmp_path, monkeypatch):
    """A task that reads holds its lines for the shuffle: where there are more of
    them, tasks are more, and the session's splits stay as they were."""
    from offerloom.sources import offers as made

    small, d = "/root/testdata/sf0.001", str(tmp_path)
    for t, keys in (("part", ["p_partkey"]), ("lineitem", ["l_partkey", "l_suppkey"])):
        df = spark.read.parquet(f"{small}/{t}.parquet").coalesce(1)
        for i in range(12):
            df.withColumns({k: F.col(k) + 1000 * i for k in keys}).write.mode("append").parquet(f"{d}/{t}.parquet")
    lines = spark.read.parquet(f"{small}/lineitem.parquet").count()
    rows = lambda: sorted(map(tuple, QUERIES["group_best_source"](spark, d).collect()), key=repr)
    want, read, shuffles = rows(), [], tables.shuffles

    @contextmanager
    def seen(*a):
        with shuffles(*a):
            each = made.table(spark, d, "lineitem").groupBy(F.spark_partition_id()).count()
            read.append(each.agg(F.max("count")).first()[0])
            yield

    monkeypatch.setattr(tables, "shuffles", seen)
    monkeypatch.setattr(made, "LINES_A_TASK", lines)
    assert rows() == want and read == [lines]
    assert spark.conf.get(tables.SPLITS, None) is None and spark.conf.get(tables.PARTITIONS) == "4"
    spark.conf.unset(tables.PARTITIONS)
    try:
        with shuffles(spark, 20):
            assert spark.conf.get(tables.PARTITIONS) == "200" and spark.conf.get(tables.SPLITS) == "20"
    finally:
        spark.conf.set(tables.PARTITIONS, "4")


def test_candidates_alone_are_looked_up(spark):
    """The same as candidates of what is in no group, also where an id repeats in one."""
    rows = [offer(s, f"red tea {i}", 10 + i, ppu=10 + i, kind="tea", pack=(100, "g"), i=i, ident=f"{s}{i}") for i, s in enumerate(SOURCES)]
    rows += [offer("dm", f"red tea big {i}", 1 + i, ppu=1 + i, kind="tea", pack=(300 + i, "g"), i=50 + i, ident=f"{'dm4' if i == 0 else 'big' + str(i)}") for i in range(5)]
    every = frame(spark, rows)
    groups = grouping.groups(every, "ord")
    loose = grouping.ungrouped(every, grouping.members(every, groups, "ord"))
    want = sorted((r.id, r.savings) for r in standout.candidates(loose, groups).collect())
    got = sorted((r.id, r.savings) for r in standout.loose_candidates(every, groups, "ord").collect())
    assert got == want and [i for i, _ in got] == ["big1", "big2", "big3", "big4"]
    assert standout.best_of(standout.loose_candidates(every, groups, "ord"), "ord").first().id == "big1"


def test_white_space_is_told_quickly_and_the_same(spark):
    """By one range first, for every character, alone and in runs."""
    every = [chr(c) for c in range(1, 0x10000) if not 0xD800 <= c < 0xE000]
    df = spark.createDataFrame([(f"{c}a {c}{c} b{c} {c}",) for c in every], "t string").repartition(4)
    both = df.select(text.collapse_ws(F.col("t")).alias("c"), F.regexp_replace("t", f"{text.WS}+", " ").alias("d"), text.trim_ws(F.col("t")).alias("e"), F.regexp_replace("t", f"^{text.WS}+|{text.WS}+$", "").alias("f"))
    assert both.filter("c <> d OR e <> f").collect() == [] and both.filter("e = 'a    b'").count() > 0


def test_bodies_are_dealt_by_their_parts(spark, monkeypatch):
    """Tasks become more as parts do, and what is searched for in a card or near
    a link is searched for once."""
    from offerloom import payload_queries

    small = "/root/testdata/sf0.001"
    want = sorted(map(tuple, QUERIES["payload_fan_out"](spark, small).collect()))
    monkeypatch.setattr(payload_queries, "PARTS_A_TASK", 50)
    found = QUERIES["payload_fan_out"](spark, small)
    assert "REPARTITION_BY_NUM" in _plan(found)
    assert sorted(map(tuple, found.collect())) == want
    pages = spark.createDataFrame([("q", 0, "")], "query string, page bigint, body string")
    assert _plan(payloads.anchor_products(pages, "https://x", "")).count(payloads.IMAGE) <= 2

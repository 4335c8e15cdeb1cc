"""The cases of the offer engine, on small frames."""

import pytest
from pyspark.sql import functions as F

from offerloom.functions import prices, text
from offerloom.operators import accounting, cache, enrich, grouping, legacy, relevance, report, standout
from offerloom.plans.search import search
from offerloom.schema import OFFER, SOURCES


def offer(source, name, price, ppu=None, unit="g", pack=None, count=None, kind=None, organic=False, brand=None, diaper=None, variant=None, url="", attr_brand=None, i=0, ident=None):
    attributes = (attr_brand, kind, organic, (float(pack[0]), pack[1], f"{pack[0]}{pack[1]}") if pack else None, float(count) if count is not None else None, variant, diaper)
    return (ident or f"{source}-{name}", name, float(price), "RON", "", url, source, brand, variant, attributes, (float(ppu), unit) if ppu is not None else None, (SOURCES.index(source), i, 0))


def frame(spark, rows):
    return spark.createDataFrame(rows, OFFER)


def grouped(spark, rows):
    every = frame(spark, rows)
    made = grouping.numbered(grouping.groups(every, "ord"))
    inside = grouping.members(every, made, "ord")
    return made.collect(), inside.orderBy("group_id", "member_rank").collect(), grouping.ungrouped(every, inside).collect()


def test_brand_does_not_split_but_organic_does(spark):
    made, inside, loose = grouped(spark, [offer("emag", "a", 10, pack=(200, "g"), organic=True, attr_brand="X"), offer("dm", "b", 11, pack=(200, "g"), organic=True, attr_brand="Y"), offer("notino", "c", 9, pack=(200, "g"))])
    assert len(made) == 1 and {r.source for r in inside} == {"emag", "dm"} and [r.source for r in loose] == ["notino"]


def test_counts_split(spark):
    rows = [offer(s, f"{s}{n}", n, count=n, diaper="4") for n in (50, 100) for s in ("emag", "dm")]
    made, _, _ = grouped(spark, rows)
    assert sorted(r.k_count for r in made) == [50, 100] and {r.match_confidence for r in made} == {"high"}


def test_no_pack_is_no_pack(spark):
    made, _, loose = grouped(spark, [offer("emag", "a", 1), offer("dm", "b", 1, pack=(200, "g"))])
    assert not made and len(loose) == 2


def test_one_row_is_no_group(spark):
    made, _, loose = grouped(spark, [offer("emag", "a", 1)])
    assert not made and len(loose) == 1


def test_best_price_and_confidence(spark):
    made, _, _ = grouped(spark, [offer("emag", "aa", 25), offer("bebetei", "b", 18), offer("dm", "cc", 18)])
    assert (made[0].best_price, made[0].best_price_source, made[0].matched_name, made[0].match_confidence) == (18, "bebetei", "b", "high")


@pytest.mark.parametrize(
    "rows, order",
    [
        ([("emag", 25, 12.5), ("bebetei", 18, 9.0), ("notino", 22, 11.0)], ["bebetei", "notino", "emag"]),
        ([("emag", 25, 10.0), ("bebetei", 20, 10.0)], ["bebetei", "emag"]),
        ([("emag", 25, None), ("bebetei", 18, None), ("notino", 22, None)], ["bebetei", "notino", "emag"]),
        ([("emag", 25, None), ("bebetei", 18, 9.0)], ["bebetei", "emag"]),
    ],
)
def test_member_order(spark, rows, order):
    _, inside, _ = grouped(spark, [offer(s, "x", p, ppu=u, ident=s) for s, p, u in rows])
    assert [r.source for r in inside] == order


def test_multipack_and_kind(spark):
    rows = [offer(s, f"{s}{c}", 9, pack=(1500, "g"), count=c, ident=f"{s}{c}") for c in (None, 2) for s in ("emag", "dm")]
    assert len(grouped(spark, rows)[0]) == 2
    rows = [offer(s, f"{s}{k}", 9, kind=k, ident=f"{s}{k}") for k in ("whole", "ground") for s in ("emag", "dm")]
    assert sorted(r.k_kind for r in grouped(spark, rows)[0]) == ["ground", "whole"]


def test_two_units_give_no_best_unit_price(spark):
    made, _, _ = grouped(spark, [offer("emag", "a", 5, ppu=1, unit="g"), offer("dm", "b", 6, ppu=2, unit="ml"), offer("notino", "c", 7)])
    assert made[0].best_ppu is None and made[0].best_ppu_source is None


def test_input_order_does_not_matter(spark):
    rows = [offer(s, f"{s}{i}", 5 + i, kind="k", i=i, ident=f"{s}{i}") for i, s in enumerate(("emag", "dm", "notino", "sezamo"))]
    assert sorted(map(str, grouped(spark, rows)[0])) == sorted(map(str, grouped(spark, rows[::-1])[0]))


@pytest.mark.parametrize("price, pack, count, value, unit", [(20, (200, "g"), None, 10, "g"), (60, None, 30, 2, "piece"), (20, (200, "g"), 1, 10, "g"), (23.5, (1500, "g"), 2, 23.5 / 30, "g"), (30, (500, "ml"), 2, 3, "ml"), (10, None, None, None, None), (10, None, 0, None, None)])
def test_per_unit(spark, price, pack, count, value, unit):
    got = enrich.with_per_unit(frame(spark, [offer("emag", "a", price, pack=pack, count=count)])).first().price_per_unit
    assert got is None if value is None else (got.value == pytest.approx(value) and got.unit == unit)


def scores(spark, rows, query):
    return [r.relevance_score for r in relevance.score(frame(spark, rows), query).orderBy("ord").collect()]


def test_relevance_cases(spark):
    a, b = scores(spark, [offer("emag", "Cremă cu SPF 50+ față", 1, i=0), offer("emag", "Cremă cu SPF50+ față", 1, i=1)], "spf50")
    assert a == b > 0
    rows = [offer("emag", "Cremă SPF 50+", 1, brand="RIEMANN P20", i=0), offer("emag", "Cremă SPF 50", 1, url="https://x.ro/riemann-p20/", i=1), offer("emag", "Lotiune SPF 50+", 1, attr_brand="P20", i=2), offer("emag", "Șampon par gras", 1, i=3)]
    got = scores(spark, rows, "p20 spf50")
    assert all(x >= 30 for x in got[:3]) and got[3] < 30


def test_relevance_quirks(spark):
    assert scores(spark, [offer("emag", "anything", 1)], "!!!")[0] >= 30
    assert relevance.normalize_query("Huggies  5!") == "huggies 5"
    with pytest.raises(ValueError):
        relevance.check_query("  ")


def test_query_is_normalised_like_text(spark):
    samples = ["Cremă SPF 50+ Față", "  A_b--c\tÉ ", "spf 30+spf5", "ßspf 9", "", "x́y"]
    rows = spark.createDataFrame([(s,) for s in samples], "s string").select("s", text.normalize_text(F.col("s")).alias("n")).collect()
    assert [r.n for r in rows] == [relevance.normalize_query(r.s) for r in rows]


@pytest.mark.parametrize(
    "best, loose, savings",
    [
        ([("k", 1.0, "g")], [("k", 0.27, "g")], 0.73),
        ([("k", 1.0, "g")], [("k", 0.86, "g")], None),
        ([("k", 1.0, "g")], [("k", 0.81, "g")], None),
        ([("k", 1.0, "g")], [("z", 0.1, "g")], None),
        ([("k", 1.0, "g")], [("k", None, "g")], None),
        ([("k", 1.0, "g")], [(None, 0.1, "g")], None),
        ([("k", 2.0, "piece")], [("k", 0.1, "g")], None),
        ([("k", 1.0, "g")], [("k", 0.27, "g"), ("k", 0.5, "g")], 0.73),
        ([("k", 2.0, "g"), ("k", 0.9, "g")], [("k", 0.7, "g")], 1 - 0.7 / 0.9),
    ],
)
def test_standout(spark, best, loose, savings):
    made = spark.createDataFrame([((k,), u, p) for k, p, u in best], "attributes struct<kind:string>, unit string, best_ppu double")
    rows = frame(spark, [offer("emag", f"n{i}", 5, ppu=p, unit=u, kind=k, i=i) for i, (k, p, u) in enumerate(loose)])
    got = standout.standout(rows, made, "ord").collect()
    assert not got if savings is None else got[0].savings == pytest.approx(savings)


ITEM = '{"id":"%s","brand":"%s","kind":"k","organic":true,"packGrams":%s,"packMl":null,"count":null,"variant":""}'


def test_enrichment(spark):
    parse = lambda body: enrich.parse_response(spark.createDataFrame([(body,)], "body string"))
    every = frame(spark, [offer("emag", "a", 5, ident="a", diaper="4", pack=(1, "g")), offer("emag", "b", 5, ident="b", kind="own", i=1)])
    got = {r.id: r.attributes for r in enrich.attach_attributes(every, parse("[" + ITEM % ("a", "", "200") + "," + ITEM % ("a", "B", "300.5") + "]")).collect()}
    assert (got["a"].brand, got["a"].pack.original, got["a"].diaper_size, got["b"].kind) == ("B", "300.5g", "4", "own")
    assert parse('[{"bad":"schema"}]').count() == 0
    assert parse("[" + ITEM % ("a", "", "200") + ',{"id":1}]').count() == 0
    assert parse("nonsense").count() == 0


def test_search_without_enrichment_groups_nothing(spark):
    rows = [offer(s, "red widget", 5, ident=s) for s in ("emag", "dm")]
    result = search(frame(spark, rows), "red widget", enrichment_error="no key")
    assert result.groups.count() == 0 and result.ungrouped.count() == 2 and result.deal.count() == 0
    assert "LLM enrichment: no key" in report.report_text(report.report_lines(result)).first().text


def test_each_offer_is_in_one_place(spark):
    rows = [offer(s, f"red widget {i}", 5 + i, kind=f"k{i % 3}", pack=(100, "g"), i=i, ident=f"{s}{i}") for i, s in enumerate(SOURCES * 3)]
    result = search(frame(spark, rows), "red widget")
    ids = [r.id for df in (result.members, result.ungrouped, result.deal) for r in df.collect()]
    assert sorted(ids) == sorted(r[0] for r in rows)
    assert [r.n for r in accounting.count_by_source(frame(spark, rows[:3])).orderBy("source_ord").collect()] == [1, 1, 1, 0, 0, 0, 0]


@pytest.mark.parametrize("raw, value", [("134.99", 13499), ("1.299,99 Lei", 1299.99), ("1,234,56", 1.234), ("", None), ("Lei", None), (None, None), (",5", 0.5)])
def test_normalize_price(spark, raw, value):
    assert spark.createDataFrame([(raw,)], "s string").select(prices.normalize_price(F.col("s"))).first()[0] == value


def test_labels_and_text(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(prices.two_decimals(F.lit(1.005))) == "1.00" and one(prices.two_decimals(F.lit(2.675))) == "2.67"
    assert one(text.encode_query(F.lit("a b+c!'()~é"))) == "a%20b%2Bc!'()~%C3%A9"
    assert one(text.decode_attribute(F.lit("&quot;&#039;&#x41;&#66;&amp;lt;"))) == "\"'AB&lt;"
    assert one(text.clean_text(F.lit(" <b>a</b>&nbsp;&amp; b  "))) == "a & b"
    assert one(text.url_slug(F.lit("https://x.ro/a/b-c/?q=1"))) == "b-c" and one(text.url_slug(F.lit("a/b"))) == "b"
    assert one(text.truncate(F.lit("abcdef"), 4)) == "abc…" and one(text.escape_html(F.lit('<"&>'))) == "&lt;&quot;&amp;&gt;"
    assert one(prices.savings_label(F.lit(0.725))) == "73%"


def test_cache_keeps_for_its_time_only(spark):
    rows = [("k", t, i, n) for i, (t, n) in enumerate([(0, 0), (5, 1), (15, 1), (16, 1), (26, 1), (27, 0)])]
    asked = spark.createDataFrame(rows, "key string, at_ms bigint, seq bigint, n_results int")
    assert [r.hit for r in cache.cache_hits(asked, 10).orderBy("seq").collect()] == [False, False, True, False, True, False]
    assert [r.key for r in cache.lru_kept(asked, 1).collect()] == ["k"]


def test_cache_as_a_stream(spark, tmp_path):
    from offerloom.streaming.cache import stream_cache_hits

    rows = [("k", 5, 0, 1), ("k", 15, 1, 1), ("k", 16, 2, 1), ("z", 1, 3, 0), ("z", 2, 4, 1)]
    schema = "key string, at_ms bigint, seq bigint, n_results int"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    answered = stream_cache_hits(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), 10)
    q = answered.writeStream.format("memory").queryName("hits").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
    q.processAllAvailable()
    q.stop()
    assert [r.hit for r in spark.sql("SELECT * FROM hits ORDER BY seq").collect()] == [False, True, False, False, False]


def test_legacy_grouping(spark):
    rows = [offer("emag", "Pampers Premium Care 5 88 buc", 5, i=0), offer("dm", "Pampers 5+ junior", 5, i=1), offer("notino", "Huggies Elite Soft marime 12", 5, i=2)]
    got = {(r.brand, r.size_stage): r for r in legacy.legacy_groups(frame(spark, rows)).collect()}
    assert set(got) == {("pampers", "5"), ("pampers", "5+"), ("huggies", "12")}
    assert got["huggies", "12"].score == 115 and got["pampers", "5+"].product_line == "junior"


def test_report_bodies(spark):
    good = '{"userAgent":"u","viewport":{"w":1,"h":2},"appVersion":"1","result":{"query":"q","groups":[],"ungrouped":[],"rawProducts":[],"totalProducts":0,"countBySource":{},"timestamp":1}}'
    rows = spark.createDataFrame([(good,), ('{"userAgent":"u"}',), ("x",)], "body string")
    assert [r.valid for r in report.valid_reports(rows).collect()] == [True, False, False]

"""Extraction from payloads."""

from pyspark.sql import functions as F

from offerloom.sources import payloads

LISTED = """<html><script type="application/ld+json">{"@type":"ItemList","itemListElement":[
{"item":{"@type":"Product","name":"A","url":"u1","offers":{"price":10.5}}},
{"@type":"Product","name":"B","url":"u2","offers":[{"price":"12,50","priceCurrency":"EUR"}],"brand":{"name":"X"},"image":["i"]}]}</script>
<script type='application/ld+json'>{broken</script></html>"""


def pages(spark, source, body, status=200):
    return spark.createDataFrame([(source, "q", status, body)], "source string, query string, status int, body string")


def read(spark, source, body):
    return payloads.read_offers(pages(spark, source, body)).orderBy("ord").collect()


def test_json_ld_lists_come_twice(spark):
    assert [(r.name, r.price, r.currency, r.brand) for r in read(spark, "bebetei", LISTED)] == [("A", 10.5, "RON", None), ("B", 12.5, "EUR", "X")] * 2


def test_json_ld_odd_blocks(spark):
    """Deep nesting, numbers that are none, and a string that begins with #."""
    block = lambda x: f'<script type="application/ld+json">{x}</script>'
    product = lambda name, price: block(f'{{"@type":"Product","name":"{name}","url":"u","offers":{{"price":{price}}}}}')
    body = block("[" * 200_000) + block("[" * 200_000 + "]" * 200_000) + product("nan", "NaN") + product("inf", "Infinity") + product("huge", "1" + "0" * 400) + product("mark", '"#12,50"') + product("plain", "3")
    assert [(r.name, r.price) for r in read(spark, "bebetei", body)] == [("mark", 12.5), ("plain", 3.0)]


def test_anchor_fallback_and_merge(spark):
    body = '<a href="/brand/thing-1/">Thing</a> 1.299,99 Lei <img src="/a.png"> <a class=x href="/brand/thing-1/">Longer thing</a><a href="/search.asp?x">no</a>'
    got = read(spark, "notino", body)
    assert [(r.name, r.price, r.image_url) for r in got] == [("Longer thing", 1299.99, "https://www.notino.ro/a.png")]


def test_cards(spark):
    card = lambda key, name, price: f'<div data-zone="card" data-url="/pd/{key}/" data-product="{{&quot;product_name&quot;:&quot;{name}&quot;}}"><p class="product-new-price">{price} Lei</p>'
    body = card("A1", "First card", "12,50") + card("A1", "Again card", "1,00") + card("B2", "Abc", "5,00") + '<div data-zone="card" data-url="/pd/C3/" data-product="{}"><a class="card-v2-title">Title name</a><p class="product-new-price">1.299<sup>&#44;99</sup> Lei</p>'
    assert [(r.name, r.price) for r in read(spark, "emag", body)] == [("First card", 12.5), ("Title name", 299.99)]


def test_blank_title_ends_the_cascade(spark):
    body = '<div data-zone="card" data-url="/pd/C3/"><a class="card-v2-title"> </a><i aria-label="Label name" class="card-v2-thumb"></i><p class="product-new-price">9 Lei</p>'
    assert read(spark, "emag", body) == []


def test_apis(spark):
    assert [(r.name, r.price) for r in read(spark, "trendyol", 'x "products":[{"id":1,"name":"N]\\"","brand":"B","url":"/p","price":{"current":134.99}}] y')] == [('B N]"', 134.99)]
    assert read(spark, "trendyol", '"products":[{') == []
    got = read(spark, "dm", '{"products":[{"gtin":1,"title":"T","tileData":{"self":"/s","price":{"price":{"current":{"value":"12,95"}}}}},{"dan":2,"title":"U","tileData":{"self":"/u","trackingData":{"price":3.5,"currency":"EUR"}}}]}')
    assert [(r.id, r.price, r.currency) for r in got] == [("dm-1", 12.95, "RON"), ("dm-2", 3.5, "EUR")]
    got = read(spark, "realfoods", '{"data":{"products":[{"_id":"z","slug":"s","name":"R","finalPrice":1299,"primaryImage":{"baseURL":"b","imageVariants":{"variants":{"1x":"v"}}}}]}}')
    assert [(r.id, r.price, r.image_url) for r in got] == [("realfoods-z", 12.99, "b/v")]
    got = read(spark, "sezamo", '{"data":{"productList":[{"productId":5,"productName":"S","baseLink":"b","categories":[{"nameId":"c"}],"price":{"full":9.5},"sales":[{"price":{"full":7}}]},{"productName":"no link","price":{"full":1}}]}}')
    assert [(r.price, r.product_url) for r in got] == [(7.0, "https://www.sezamo.ro/c/b")]


def test_at_most_twenty(spark):
    body = '{"data":{"products":[' + ",".join('{"_id":"%d","slug":"s","name":"R","finalPrice":100}' % i for i in range(30)) + "]}}"
    assert [r.id for r in read(spark, "realfoods", body)] == [f"realfoods-{i}" for i in range(20)]


def test_failures_are_rows(spark):
    every = pages(spark, "notino", "Just a moment...", 503).union(pages(spark, "emag", "captcha")).union(pages(spark, "dm", "x", 500)).union(pages(spark, "dm", "{}"))
    got = payloads.fetch_status(every).select("source", "error").collect()
    assert [tuple(r) for r in got] == [("notino", "challenge page"), ("emag", "blocked"), ("dm", "HTTP 500"), ("dm", None)]


def test_search_urls(spark):
    assert spark.range(1).select(payloads.search_url("dm", F.lit("a b"))).first()[0].endswith("?query=a%20b")


def test_pages_of_one_query(spark):
    """Each page is read in its own way, and its offers have ids of their own."""
    link = '<a href="/thing-p7/">Thing seven</a> 12,50 Lei'
    every = pages(spark, "bebetei", LISTED).withColumn("page", F.lit(0)).union(pages(spark, "bebetei", link).withColumn("page", F.lit(1))).union(pages(spark, "bebetei", LISTED).withColumn("page", F.lit(2)))
    got = payloads.read_offers(every).orderBy("ord").collect()
    assert [r.name for r in got] == ["A", "B", "A", "B", "Thing seven", "A", "B", "A", "B"]
    assert len({r.id for r in got}) == 9
    assert [got[0].id, got[4].id, got[5].id] == ["bebetei-0", "bebetei-1-0", "bebetei-2-0"]
    # without numbers no page is lost either
    assert payloads.read_offers(every.drop("page")).count() == 9


def test_a_page_of_many_links(spark):
    """A link carries what stands around it, and prices are its own."""
    body = "".join(f'<a href="/thing-p{i}/">Thing {i} kg</a> {i + 1},50 Lei <img src="/i{i}.png"> {"x" * 1600}' for i in range(1500))
    got = payloads.read_offers(pages(spark, "bebetei", body), most=5000).orderBy("ord").collect()
    # 500 characters back reach no other price
    assert [(r.name, r.price, r.image_url) for r in got] == [(f"Thing {i} kg", i + 1.5, f"https://comenzi.bebetei.ro/i{i}.png") for i in range(1500)]


def test_workers_without_the_package(tmp_path):
    """Python functions travel by value: workers need not import the package."""
    import os
    import subprocess
    import sys
    from pathlib import Path

    code = f"""
import sys
sys.path.insert(0, {str(Path(__file__).resolve().parents[1])!r})
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", {str(tmp_path / "shared")!r}).getOrCreate()
from offerloom.sources import payloads
from offerloom.operators import relevance
body = '<script type="application/ld+json">{{"@type":"Product","name":"Crem\\u0103 SPF 50+","url":"https://x/a-b/","offers":{{"price":10}}}}</script>'
rows = spark.createDataFrame([("notino", "q", 200, body), ("bebetei", "q", 200, '<a href="/t-p1/">Thing</a> 5,00 Lei')], "source string, query string, status int, body string")
found = payloads.read_offers(rows)
print("ROWS", sorted((r.name, r.relevance_score > 0) for r in relevance.score(found, "crema spf50").collect()))
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS [('Cremă SPF 50+', True), ('Thing', False)]" in out.stdout, out.stderr[-3000:]

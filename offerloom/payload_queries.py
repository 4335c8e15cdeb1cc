"""Queries that read payloads of each source, made from the parts.

A page or body holds the parts of one block of keys, so that it is bounded; what
a field lacks varies with the size of the part. The SQL says what offers the
readers must find, straight from the same table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .fuzzy_sql import fuzzy
from .operators import accounting
from .plans import many
from .schema import SOURCES
from .sources import payloads, stored
from .sources.offers import table
from .tables import shared_dir

QUERIES: dict = {}
SQL: dict[str, str] = {}

PER_PAGE = 16
#: Parts whose bodies one task makes and reads: bodies are long, but repeat
#: themselves, so their bytes in a shuffle tell little of the work.
PARTS_A_TASK = 4_000
_PARTS = f"""p AS (SELECT *, concat('q', p_partkey // {PER_PAGE}) AS query, row_number() OVER (PARTITION BY p_partkey // {PER_PAGE} ORDER BY p_partkey) - 1 AS idx,
  count(*) OVER (PARTITION BY p_partkey // {PER_PAGE}) AS in_page, CAST(p_partkey AS VARCHAR) AS k, CAST(CAST(floor(p_retailprice) AS BIGINT) AS VARCHAR) AS e,
  lpad(CAST(CAST(round(p_retailprice * 100) AS BIGINT) % 100 AS VARCHAR), 2, '0') AS c FROM part)"""
#: A price as the pages write it, 1.900,10, and its value.
_THOUSANDS = "CAST(concat('1', e, '.', c) AS DOUBLE)"
_PLAIN = "CAST(concat(e, '.', c) AS DOUBLE)"
COLUMNS = ["query", "id", "name", "price", "currency", "image_url", "product_url", "brand"]


def _parts(spark: SparkSession, d: str) -> DataFrame:
    cents = F.round(F.col("p_retailprice") * 100).cast("bigint")
    more = {
        "query": F.concat(F.lit("q"), F.floor(F.col("p_partkey") / PER_PAGE).cast("bigint")),
        "k": F.col("p_partkey").cast("string"),
        "e": F.floor("p_retailprice").cast("bigint").cast("string"),
        "c": F.lpad((cents % 100).cast("string"), 2, "0"),
    }
    parts = table(spark, d, "part")
    tasks = -(-parts.count() // PARTS_A_TASK)
    made = parts.withColumns(more).withColumn("ro", F.concat(F.lit("1."), "e", F.lit(","), "c"))
    return made.repartition(tasks, "query") if tasks > 1 else made


def _payload(parts: DataFrame, source: str, item: Column, before: str, after: str, between: str = ",") -> DataFrame:
    """One body for each block of parts, their items in order of key."""
    items = F.transform(F.sort_array(F.collect_list(F.struct("p_partkey", item.alias("item")))), lambda x: x["item"])
    body = F.concat(F.lit(before), F.array_join(items, between), F.lit(after))
    return parts.groupBy("query").agg(body.alias("body")).select(F.lit(source).alias("source"), "query", F.lit(200).alias("status"), "body")


def _when(modulus: int, rest: int, value: Column) -> Column:
    return F.when(F.col("p_size") % modulus == rest, value)


def _unless(modulus: int, value: Column) -> Column:
    return F.when(F.col("p_size") % modulus != 0, value)


def _text(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _realfoods(parts: DataFrame) -> DataFrame:
    image = F.struct(F.lit("https://img").alias("baseURL"), F.struct(F.struct(_text(F.col("k"), ".png").alias("1x")).alias("variants")).alias("imageVariants"))
    cents = F.round(F.col("p_retailprice") * 100).cast("bigint").alias("finalPrice")
    item = F.struct(_unless(4, F.col("k")).alias("_id"), _text("S", F.col("k")).alias("sku"), _unless(7, _text("slug-", F.col("k"))).alias("slug"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), cents, _when(2, 0, image).alias("primaryImage"))
    return _payload(parts, "realfoods", F.to_json(item), '{"data":{"products":[', "]}}")


_SQL_REALFOODS = """SELECT query, idx, concat('realfoods-', CASE WHEN p_size % 4 = 0 THEN concat('S', k) ELSE k END) AS id, p_name AS name, CAST(round(p_retailprice * 100) AS BIGINT) / 100 AS price, 'RON' AS currency,
  CASE WHEN p_size % 2 = 0 THEN concat('https://img/', k, '.png') ELSE '' END AS image_url, concat('https://realfoods.ro/products/slug-', k, '/') AS product_url, p_brand AS brand FROM p WHERE p_size % 7 <> 0"""


def _dm(parts: DataFrame) -> DataFrame:
    tracked = F.struct(_when(2, 1, F.lit("EUR")).alias("currency"), F.col("p_retailprice").alias("price"))
    current = F.struct(F.struct(F.struct(F.col("ro").alias("value")).alias("current")).alias("price"))
    tile = F.struct(F.struct(_text("T", F.col("p_brand")).alias("name")).alias("brand"), F.array(F.struct(_text("https://i/", F.col("k")).alias("tileSrc"))).alias("images"), current.alias("price"), _unless(7, _text("/p", F.col("k"))).alias("self"), F.struct(_text(F.col("p_name"), " tile").alias("tileHeadline")).alias("title"), _unless(5, tracked).alias("trackingData"))
    item = F.struct(_text("g", F.col("k")).alias("gtin"), _unless(3, F.col("k")).alias("dan"), _unless(4, F.col("p_brand")).alias("brandName"), _unless(2, F.col("p_name")).alias("title"), tile.alias("tileData"))
    return _payload(parts, "dm", F.to_json(item), '{"products":[', "]}")


_SQL_DM = f"""SELECT query, idx, concat('dm-', CASE WHEN p_size % 3 = 0 THEN concat('g', k) ELSE k END) AS id, CASE WHEN p_size % 2 = 0 THEN concat(p_name, ' tile') ELSE p_name END AS name, CASE WHEN p_size % 5 = 0 THEN {_THOUSANDS} ELSE p_retailprice END AS price,
  CASE WHEN p_size % 5 <> 0 AND p_size % 2 = 1 THEN 'EUR' ELSE 'RON' END AS currency, concat('https://i/', k) AS image_url, concat('https://www.dm.ro/p', k) AS product_url, CASE WHEN p_size % 4 = 0 THEN concat('T', p_brand) ELSE p_brand END AS brand FROM p WHERE p_size % 7 <> 0"""


def _sezamo(parts: DataFrame) -> DataFrame:
    full = F.struct(F.col("p_retailprice").alias("full"), _when(2, 1, F.lit("EUR")).alias("currency"))
    sales = _when(3, 0, F.array(F.struct(F.struct((F.col("p_size") + F.lit(0.5)).alias("full")).alias("price"))))
    item = F.struct(_unless(5, F.col("k")).alias("productId"), F.col("p_name").alias("productName"), F.col("p_brand").alias("brand"), _unless(4, _text("/i", F.col("k"))).alias("imgPath"), _unless(7, _text("link-", F.col("k"))).alias("baseLink"), F.array(F.struct(F.lit("shelf").alias("nameId"))).alias("categories"), full.alias("price"), sales.alias("sales"))
    return _payload(parts, "sezamo", F.to_json(item), '{"data":{"productList":[', "]}}")


_SQL_SEZAMO = """SELECT query, idx, concat('sezamo-', CASE WHEN p_size % 5 = 0 THEN CAST(idx AS VARCHAR) ELSE k END) AS id, p_name AS name, CASE WHEN p_size % 3 = 0 THEN p_size + 0.5::DOUBLE ELSE p_retailprice END AS price,
  CASE WHEN p_size % 2 = 1 THEN 'EUR' ELSE 'RON' END AS currency, CASE WHEN p_size % 4 = 0 THEN '' ELSE concat('https://cdn.sezamo.ro/i', k) END AS image_url, concat('https://www.sezamo.ro/shelf/link-', k) AS product_url, p_brand AS brand FROM p WHERE p_size % 7 <> 0"""


def _trendyol(parts: DataFrame) -> DataFrame:
    """Names hold brackets and quotes, which must not end the array."""
    price = F.struct(_when(3, 0, F.col("p_retailprice")).alias("discountedPrice"), _when(3, 1, F.col("ro")).alias("current"), (F.col("p_size") + F.lit(0.25)).alias("originalPrice"))
    url = F.when(F.col("p_size") % 2 == 0, _text("https://other/", F.col("k"))).otherwise(_text("/p", F.col("k")))
    item = F.struct(_unless(5, F.col("k")).alias("id"), _text(F.col("p_name"), ' ]["').alias("name"), F.col("p_brand").alias("brand"), url.alias("url"), _text("one-", F.col("k")).alias("image"), _when(4, 0, F.array(_text("first-", F.col("k")), F.lit("second"))).alias("images"), price.alias("price"))
    return _payload(parts, "trendyol", F.to_json(item), '<html><script>window.state={"products":[', '],"more":[1,[2]]}</script></html>')


_SQL_TRENDYOL = f"""SELECT query, idx, concat('trendyol-', CASE WHEN p_size % 5 = 0 THEN CAST(idx AS VARCHAR) ELSE k END) AS id, concat(p_brand, ' ', p_name, ' ]["') AS name, CASE p_size % 3 WHEN 0 THEN p_retailprice WHEN 1 THEN {_THOUSANDS} ELSE p_size + 0.25::DOUBLE END AS price, 'RON' AS currency,
  CASE WHEN p_size % 4 = 0 THEN concat('first-', k) ELSE concat('one-', k) END AS image_url, CASE WHEN p_size % 2 = 0 THEN concat('https://other/', k) ELSE concat('https://www.trendyol.com/p', k) END AS product_url, p_brand AS brand FROM p"""


def _emag(parts: DataFrame) -> DataFrame:
    """Cards named in one of three ways, each followed by a cheaper one of its key."""
    name = (
        _when(3, 0, _text(' data-product="{&quot;product_name&quot;:&quot; ', F.col("p_name"), '  &amp; co&quot;}">'))
        .when(F.col("p_size") % 3 == 1, _text('><a class="card-v2-title x" href="#">', F.col("p_name"), " <b>bold</b></a>"))
        .otherwise(_text('><i aria-label="', F.col("p_name"), ' label" class="card-v2-thumb"></i>'))
    )
    head = _text('<div data-zone="card" data-url="/pd/K', F.col("k"), '/"')
    image = _text('<img src="https://s1emagst.akamaized.net/products/', F.col("k"), '.jpg?a=1&amp;b=2">')
    item = F.concat(head, name, image, _text('<p class="product-new-price">', F.col("e"), "<sup>&#44;", F.col("c"), "</sup> Lei</p></div>"), head, name, F.lit('<p class="product-new-price">5,00 Lei</p></div>'))
    return _payload(parts, "emag", item, "<html>", "</html>", "")


_SQL_EMAG = f"""SELECT query, 2 * idx + 1 AS idx, concat('emag-', 2 * idx + 1) AS id, CASE p_size % 3 WHEN 0 THEN concat(p_name, ' & co') WHEN 1 THEN concat(p_name, ' bold') ELSE concat(p_name, ' label') END AS name, {_PLAIN} AS price, 'RON' AS currency,
  concat('https://s1emagst.akamaized.net/products/', k, '.jpg?a=1&b=2') AS image_url, concat('https://www.emag.ro/pd/K', k, '/') AS product_url, CAST(NULL AS VARCHAR) AS brand FROM p"""


def _links(parts: DataFrame, source: str, path: Column) -> DataFrame:
    """Links far enough apart that a price near one is its own; each comes twice."""
    base = payloads.BASE[source]
    filler = "x" * 2000
    item = F.concat(_text('<a class="c" href="', path, '">', F.col("p_name"), "</a> ", F.col("ro"), ' Lei <img src="/i', F.col("k"), '.png"> '), _text('<a href="', base, path, '">', F.col("p_name"), " longer</a>"), F.lit('<a href="/about">about us</a>'))
    return _payload(parts, source, item, "<html>" + filler, "</html>", filler)


def _bebetei(parts: DataFrame) -> DataFrame:
    return _links(parts, "bebetei", _text("/thing-p", F.col("k"), "/"))


def _sql_links(base: str, path: str, where: str = "true") -> str:
    return f"""SELECT query, idx, concat(p_name, ' longer') AS name, {_THOUSANDS} AS price, 'RON' AS currency, concat('{base}/i', k, '.png') AS image_url, concat('{base}{path}', k, '/') AS product_url, CAST(NULL AS VARCHAR) AS brand FROM p WHERE {where}"""


_SQL_BEBETEI = _sql_links(payloads.BASE["bebetei"], "/thing-p")


def _notino(parts: DataFrame) -> DataFrame:
    """Every other page has its products as JSON-LD in an ItemList, the rest as links."""
    even = F.col("p_partkey") % (2 * PER_PAGE) < PER_PAGE
    price = F.when(F.col("p_size") % 2 == 0, F.col("p_retailprice").cast("string")).otherwise(_text('"', F.col("ro"), '"'))
    offer = _text('{"@type":"Offer","price":', price, F.when(F.col("p_size") % 3 == 0, ',"priceCurrency":"EUR"}').otherwise("}"))
    offers = F.when(F.col("p_size") % 5 == 0, _text("[", offer, "]")).otherwise(offer)
    brand = F.when(F.col("p_size") % 4 == 0, _text('{"name":"', F.col("p_brand"), '"}')).otherwise(_text('"', F.col("p_brand"), '"'))
    image = F.when(F.col("p_size") % 2 == 0, _text('["i', F.col("k"), '","j"]')).otherwise(_text('"i', F.col("k"), '"'))
    url = F.when(F.col("p_size") % 7 == 0, F.lit("")).otherwise(_text("https://www.notino.ro/b/n", F.col("k")))
    item = _text('{"item":{"@type":"Product","name":"', F.col("p_name"), '","url":"', url, '","image":', image, ',"brand":', brand, ',"offers":', offers, "}}")
    listed = _payload(parts.filter(even), "notino", item, '<script type="application/ld+json">{broken</script><script type="application/ld+json">{"@type":"ItemList","itemListElement":[', "]}</script>")
    return listed.union(_links(parts.filter(~even), "notino", _text("/brand/n", F.col("k"), "/")))


_EVEN = f"p_partkey % {2 * PER_PAGE} < {PER_PAGE}"
_SQL_JSONLD = f"""SELECT query, place AS idx, p_name AS name, CASE WHEN p_size % 2 = 0 THEN p_retailprice ELSE {_THOUSANDS} END AS price, CASE WHEN p_size % 3 = 0 THEN 'EUR' ELSE 'RON' END AS currency, concat('i', k) AS image_url, concat('https://www.notino.ro/b/n', k) AS product_url, p_brand AS brand
  FROM (SELECT *, unnest([idx, idx + in_page]) AS place FROM p WHERE {_EVEN}) WHERE p_size % 7 <> 0"""
_SQL_NOTINO = f"{_SQL_JSONLD} UNION ALL {_sql_links(payloads.BASE['notino'], '/brand/n', f'NOT ({_EVEN})')}"

BODIES = {"emag": _emag, "bebetei": _bebetei, "notino": _notino, "trendyol": _trendyol, "dm": _dm, "realfoods": _realfoods, "sezamo": _sezamo}
EXPECTED = {"emag": _SQL_EMAG, "bebetei": _SQL_BEBETEI, "notino": _SQL_NOTINO, "trendyol": _SQL_TRENDYOL, "dm": _SQL_DM, "realfoods": _SQL_REALFOODS, "sezamo": _SQL_SEZAMO}


def _register(source: str) -> None:
    # an offer of a link is known by its offset in the page, which SQL has not
    columns = [c for c in COLUMNS if c != "id" or source not in ("bebetei", "notino")]

    def run(spark: SparkSession, d: str) -> DataFrame:
        return payloads.read_offers(BODIES[source](_parts(spark, d))).select(columns)

    QUERIES[f"payload_{source}"] = run
    first = f"r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY idx) AS place FROM ({EXPECTED[source]}))"
    SQL[f"payload_{source}"] = f"WITH {_PARTS}, {first} SELECT {', '.join(columns)} FROM r WHERE place <= {payloads.MOST}"


for _source in SOURCES:
    _register(_source)


def _all_payloads(spark: SparkSession, d: str) -> DataFrame:
    """Bodies of all sources; those of two sources fail for some queries."""
    parts = _parts(spark, d)
    every = BODIES[SOURCES[0]](parts)
    for s in SOURCES[1:]:
        every = every.union(BODIES[s](parts))
    odd = F.substring("query", 2, 20).cast("bigint") % 2 == 1
    return every.withColumns({"status": F.when((F.col("source") == "dm") & odd, 503).otherwise(F.col("status")), "body": F.when((F.col("source") == "notino") & odd, F.concat(F.lit("<title>Just a moment...</title>"), "body")).otherwise(F.col("body"))})


_FAILED = "(source IN ('dm', 'notino') AND CAST(substr(query, 2) AS BIGINT) % 2 = 1)"
_FOUND = "f AS (" + " UNION ALL ".join(f"SELECT '{s}' AS source, query, idx, price FROM ({sql})" for s, sql in EXPECTED.items()) + f"), r AS (SELECT *, row_number() OVER (PARTITION BY source, query ORDER BY idx) AS place FROM f WHERE NOT {_FAILED})"


def payload_fan_out(spark: SparkSession, d: str) -> DataFrame:
    """How many offers each query found in each source, failures left out."""
    found = payloads.read_offers(_all_payloads(spark, d))
    return found.groupBy("query", "source").agg(F.count(F.lit(1)).alias("n"), F.min("price").alias("least"), F.max("price").alias("most"))


def _kept(spark: SparkSession, d: str) -> str:
    """The payloads as stored files, in a folder of their own."""
    path = f"{shared_dir(spark)}/payloads-{uuid.uuid4().hex}"
    stored.write_payloads(_all_payloads(spark, d), path)
    return path


def payload_stored(spark: SparkSession, d: str) -> DataFrame:
    """payload_fan_out through files: written by source, read back by each reader."""
    found = stored.stored_offers(spark, _kept(spark, d))
    return found.groupBy("query", "source").agg(F.count(F.lit(1)).alias("n"), F.min("price").alias("least"), F.max("price").alias("most"))


def payload_errors(spark: SparkSession, d: str) -> DataFrame:
    told = payloads.fetch_status(_all_payloads(spark, d))
    return told.select("query", "source", "success", "error")


def payload_status(spark: SparkSession, d: str) -> DataFrame:
    """Pages told apart as challenged, blocked, failed or good."""
    body = (
        F.when(F.col("p_size") % 6 == 0, "<p>Please solve the CAPTCHA")
        .when(F.col("p_size") % 6 == 1, F.concat(F.lit('<div data-zone="card">captcha'), "p_name"))
        .when(F.col("p_size") % 6 == 2, F.concat(F.lit("<script src=https://challenges.cloudflare.com/x>"), "p_name"))
        .when(F.col("p_size") % 6 == 3, F.rpad(F.col("p_name"), 6000, "y"))
        .when(F.col("p_size") % 6 == 4, "short page")
    )
    source = F.get(F.array(*map(F.lit, SOURCES)), F.pmod("p_partkey", F.lit(len(SOURCES))).cast("int"))
    status = F.when(F.col("p_partkey") % 11 == 0, 404).otherwise(200)
    made = table(spark, d, "part").select("p_partkey", source.alias("source"), F.lit("q").alias("query"), status.alias("status"), body.alias("body"))
    return payloads.fetch_status(made).select("p_partkey", "source", "success", "error")


_CODES = "[" + ", ".join(f"'{s}'" for s in SOURCES) + "]"
_STATUS = f"""WITH p AS (SELECT p_partkey, {_CODES}[CAST(p_partkey % {len(SOURCES)} AS INT) + 1] AS source, p_size % 6 AS kind, p_partkey % 11 = 0 AS lost FROM part),
e AS (SELECT *, CASE WHEN source = 'notino' AND kind = 2 THEN 'challenge page' WHEN lost THEN 'HTTP 404' WHEN source = 'emag' AND kind <> 1 AND kind <> 3 THEN 'blocked' WHEN kind = 5 THEN 'unknown' END AS error FROM p)
SELECT p_partkey, source, error IS NULL AS success, error FROM e"""


def search_addresses(spark: SparkSession, d: str) -> DataFrame:
    asked = F.concat("p_name", F.lit(" & "), "p_brand")
    return table(spark, d, "part").select("p_partkey", *[payloads.search_url(s, asked).alias(s) for s in SOURCES])


def counts_of_payloads(spark: SparkSession, d: str) -> DataFrame:
    found = payloads.read_offers(_all_payloads(spark, d))
    return accounting.count_by_source(found).select("source", "n")


def _asked(spark: SparkSession, d: str) -> DataFrame:
    """Each query asks for what its block's first part is called."""
    parts = _parts(spark, d)
    return parts.groupBy("query").agg(F.min_by("p_name", "p_partkey").alias("asked"))


def payload_search(spark: SparkSession, d: str) -> DataFrame:
    """From the payloads of all sources to the groups of every query."""
    made = many.search_payloads(_all_payloads(spark, d), _asked(spark, d)).groups
    return made.select("query", "group_id", "group_rank", "n", "n_sources", "matched_name", "best_price", "best_price_source", "match_confidence", "score")


def payload_outcome(spark: SparkSession, d: str) -> DataFrame:
    """How many offers each query found in each source, or why it failed."""
    stored = _all_payloads(spark, d)
    return accounting.outcome_each(payloads.fetch_status(stored), payloads.read_offers(stored))


def payload_found(spark: SparkSession, d: str) -> DataFrame:
    """The offers that reach the score of their query."""
    found = many.search_payloads(_all_payloads(spark, d), _asked(spark, d)).matches
    return found.select("query", "source", "name", "price", "relevance_score")


_NORMAL = "trim(regexp_replace(regexp_replace(lower({}), '[^a-z0-9_ ]', ' ', 'g'), ' +', ' ', 'g'))"
_SEARCHED = f"""WITH {_PARTS},
v AS (SELECT query, arg_min(p_name, p_partkey) AS q, string_split(arg_min(p_name, p_partkey), ' ') AS ws FROM p GROUP BY query),
f AS (""" + " UNION ALL ".join(f"SELECT {i} AS so, '{s}' AS source, query, idx, name, price, brand, product_url FROM ({sql})" for i, (s, sql) in enumerate(EXPECTED.items())) + f"""),
r AS (SELECT *, row_number() OVER (PARTITION BY source, query ORDER BY idx) AS place FROM f WHERE NOT {_FAILED}),
t AS (SELECT r.*, q, list_filter(ws, lambda w: length(w) > 2) AS ws, {_NORMAL.format("name")} AS nm,
  {_NORMAL.format("concat_ws(' ', name, brand, regexp_replace(regexp_extract(product_url, '([^/]+)/*$', 1), '[-_]', ' ', 'g'))")} AS hay FROM r JOIN v USING (query) WHERE place <= {payloads.MOST}),
u AS (SELECT *, CASE WHEN nm = q THEN 40 WHEN contains(nm, q) THEN 30 WHEN contains(q, nm) THEN 25 ELSE 0 END AS by_name,
  len(list_filter(ws, lambda w: list_contains(string_split(hay, ' '), w))) / CAST(len(ws) AS DOUBLE) * CAST(30.0 AS DOUBLE) AS coverage,
  instr(hay, ws[1]) AS a1, CASE WHEN len(ws) > 1 THEN instr(substr(hay, instr(hay, ws[1]) + 1), ws[2]) ELSE 0 END AS a2 FROM t),
z AS ({fuzzy("SELECT nm, q FROM t")}),
w AS (SELECT *, CAST(least(100, floor(by_name + coverage + (CAST(a1 > 0 AS INT) + CAST(a2 > 0 AS INT)) / CAST(len(ws) AS DOUBLE) * CAST(15.0 AS DOUBLE) + fuzzy + 0.5)) AS INT) AS score FROM u JOIN z ON u.nm = z.nm AND u.q = z.q),
x AS (SELECT * FROM w WHERE score >= 30)"""
_OUTCOME = f"""WITH {_PARTS}, {_FOUND}, c AS (SELECT query, source, count(*) AS n FROM r WHERE place <= {payloads.MOST} GROUP BY ALL),
s AS (SELECT DISTINCT query, source FROM p, (SELECT unnest([{", ".join(f"'{x}'" for x in SOURCES)}]) AS source))
SELECT s.query, s.source, coalesce(n, 0) AS n, CASE WHEN {_FAILED.replace("source", "s.source").replace("query", "s.query")} THEN CASE s.source WHEN 'dm' THEN 'HTTP 503' ELSE 'challenge page' END END AS error FROM s LEFT JOIN c ON s.query = c.query AND s.source = c.source"""
_ADDRESSES = ", ".join(f"concat('{b}', a, '{e}') AS {s}" for s, u in payloads.SEARCH.items() for b, e in [u.split("{q}")])
QUERIES |= {f.__name__: f for f in (payload_fan_out, payload_stored, payload_errors, payload_status, search_addresses, counts_of_payloads, payload_search, payload_found, payload_outcome)}
SQL |= {
    "payload_fan_out": f"WITH {_PARTS}, {_FOUND} SELECT query, source, count(*) AS n, min(price) AS least, max(price) AS most FROM r WHERE place <= {payloads.MOST} GROUP BY ALL",
    "payload_stored": f"WITH {_PARTS}, {_FOUND} SELECT query, source, count(*) AS n, min(price) AS least, max(price) AS most FROM r WHERE place <= {payloads.MOST} GROUP BY ALL",
    "payload_errors": f"WITH {_PARTS}, s AS (SELECT DISTINCT query, source FROM p, (SELECT unnest({_CODES}) AS source)) SELECT query, source, NOT {_FAILED} AS success, CASE WHEN {_FAILED} THEN CASE source WHEN 'dm' THEN 'HTTP 503' ELSE 'challenge page' END END AS error FROM s",
    "payload_status": _STATUS,
    "search_addresses": f"SELECT p_partkey, {_ADDRESSES} FROM (SELECT p_partkey, url_encode(concat(p_name, ' & ', p_brand)) AS a FROM part)",
    "counts_of_payloads": f"WITH {_PARTS}, {_FOUND} SELECT d.source, coalesce(n, 0) AS n FROM (SELECT unnest({_CODES}) AS source) d LEFT JOIN (SELECT source, count(*) AS n FROM r WHERE place <= {payloads.MOST} GROUP BY source) c ON d.source = c.source",
    "payload_search": _SEARCHED + " SELECT query, 'group-0' AS group_id, 1::BIGINT AS group_rank, count(*) AS n, count(DISTINCT source) AS n_sources, arg_min(name, (length(name), -score, so, idx)) AS matched_name, min(price) AS best_price, arg_min(source, (price, -score, so, idx)) AS best_price_source, CASE WHEN count(DISTINCT source) >= 3 THEN 'high' ELSE 'medium' END AS match_confidence, max(score) AS score FROM x GROUP BY query HAVING count(DISTINCT source) >= 2",
    "payload_found": _SEARCHED + " SELECT query, source, name, price, score AS relevance_score FROM x",
    "payload_outcome": _OUTCOME,
}

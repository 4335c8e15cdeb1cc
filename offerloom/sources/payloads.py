"""Offers from stored payloads of the sources: HTML pages and JSON bodies.

A payload is a row (source, query, status, body). JSON APIs are read with
``from_json``; pages are read by JSON-LD first and by their layout if that gives
no valid offer. Document order is kept as ``idx``. Two steps need more than
expressions: JSON-LD is walked in document order, and anchors need offsets.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from ..functions.prices import card_price, normalize_price, window_price
from ..functions.text import clean_text, collapse_ws, decode_attribute, encode_query, normalize_url, strip_tags_for_price, trim_ws
from ..schema import ATTRIBUTES, OFFER_COLUMNS, PER_UNIT, SOURCES
from ..tables import small_batches

MOST = 20

#: Base addresses of the sources.
BASE = {
    "emag": "https://www.emag.ro",
    "bebetei": "https://comenzi.bebetei.ro",
    "notino": "https://www.notino.ro",
    "trendyol": "https://www.trendyol.com",
    "dm": "https://www.dm.ro",
    "realfoods": "https://realfoods.ro",
    "sezamo": "https://www.sezamo.ro",
}
SEZAMO_IMAGES = "https://cdn.sezamo.ro"
#: Search addresses; the encoded query takes the place of {q}.
SEARCH = {
    "emag": "https://www.emag.ro/search/{q}",
    "bebetei": "https://comenzi.bebetei.ro/cauti/{q}",
    "notino": "https://www.notino.ro/search.asp?exps={q}",
    "trendyol": "https://www.trendyol.com/ro/sr?q={q}",
    "dm": "https://product-search.services.dmtech.com/ro/search/crawl?query={q}",
    "realfoods": "https://realfoods.api.wavegrocery.com/api/v3.1/products/search?term={q}&pageNumber=0&pageSize=20",
    "sezamo": "https://www.sezamo.ro/services/frontend-service/search-metadata?search={q}&companyId=5500&offset=0&limit=20",
}
#: What a challenge page has near its top.
CHALLENGES = ["cf-browser-verification", "challenges.cloudflare.com", "__cf_chl_", "Just a moment..."]
BLOCKED = ["captcha", "access denied", "forbidden", "cf-browser-verification"]
#: Which links of a page are offers.
LINKS = {"bebetei": r"(?i)-p\d+", "notino": r"(?i)https?://www\.notino\.ro/[a-z0-9-]+/[a-z0-9-]+/?"}

#: What marks JSON-LD, links, images and the parts of a card.
JSON_LD = re.compile(r"""<script[^>]*type=["']application/ld\+json["'][^>]*>([\s\S]*?)</script>""", re.I)
ANCHOR = r"""<a\s+[^>]*href=["']([^"']+)["'][^>]*>([\s\S]*?)</a>"""
IMAGE = r"""(?i)<img[^>]+src=["']([^"']+)["']"""
CARD_URL, CARD_PRODUCT = r'data-url="([^"]+)"', r'data-product="([^"]+)"'
CARD_TITLE = r'(?is)class="[^"]*card-v2-title[^"]*"[^>]*>(.*?)</a>'
CARD_LABEL = r'(?i)aria-label="([^"]+)"[^>]*class="[^"]*card-v2-thumb'
CARD_PRICE = r"(?is)product-new-price[^>]*>(.{0,200})"
CARD_IMAGE = r"""(?i)(?:src|data-src)=["'](https://s\d+emagst\.akamaized\.net/products/[^"']+)["']"""
CARD_KEY = r"/pd/([A-Z0-9]+)/"

_DM = "struct<products:array<struct<gtin:string,dan:string,brandName:string,title:string,tileData:struct<brand:struct<name:string>,images:array<struct<tileSrc:string>>,price:struct<price:struct<current:struct<value:string>>>,self:string,title:struct<tileHeadline:string,tileHeadlineLong:string>,trackingData:struct<brand:string,currency:string,price:double>>>>>"
_REALFOODS = "struct<data:struct<products:array<struct<_id:string,sku:string,slug:string,name:string,brand:string,finalPrice:double,primaryImage:struct<baseURL:string,imageVariants:struct<variants:map<string,string>>>>>>>"
_SEZAMO = "struct<data:struct<productList:array<struct<productId:string,productName:string,brand:string,imgPath:string,baseLink:string,categories:array<struct<nameId:string>>,price:struct<full:double,currency:string>,sales:array<struct<price:struct<full:double>>>>>>>"
_TRENDYOL = "array<struct<id:string,name:string,brand:string,url:string,image:string,images:array<string>,price:struct<discountedPrice:string,current:string,originalPrice:string>>>"


def search_url(source: str, query: Column) -> Column:
    before, after = SEARCH[source].split("{q}")
    return F.concat(F.lit(before), encode_query(query), F.lit(after))


def is_challenge(body: Column) -> Column:
    head = F.substring(F.coalesce(body, F.lit("")), 1, 4000)
    out = F.lit(False)
    for m in CHALLENGES:
        out = out | head.contains(m)
    return out


def is_blocked(body: Column) -> Column:
    body = F.coalesce(body, F.lit(""))
    head, hit = F.lower(F.substring(body, 1, 4000)), F.length(body) < 5000
    for m in BLOCKED:
        hit = hit | head.contains(m)
    return (body == "") | (~body.contains('data-zone="card"') & ~body.rlike(r'data-product-id="\d+"') & hit)


def fetch_status(payloads: DataFrame) -> DataFrame:
    """Payloads with (success, error): blocked or challenged pages and bad HTTP
    codes are failures, told as data."""
    http = F.when(~F.col("status").between(200, 299), F.concat(F.lit("HTTP "), F.col("status").cast("string")))
    guard = F.when((F.col("source") == "notino") & is_challenge(F.col("body")), "challenge page")
    block = F.when((F.col("source") == "emag") & is_blocked(F.col("body")), "blocked")
    error = F.coalesce(guard, http, block, F.when(F.col("body").isNull(), "unknown"))
    return payloads.withColumns({"error": error, "success": error.isNull()})


def _no_number(text: str) -> None:
    """JSON has neither NaN nor Infinity."""
    raise ValueError(text)


def _product(node: dict) -> dict:
    head = lambda x: (x[0] if x else None) if isinstance(x, list) else x
    text = lambda x: x if isinstance(x, str) else None
    offer, brand = head(node.get("offers")), node.get("brand")
    offer = offer if isinstance(offer, dict) else {}
    price, number = offer.get("price"), None
    if isinstance(price, (int, float)) and not isinstance(price, bool) and abs(price) < 1e300:
        number = float(price)
    return {"name": text(node.get("name")), "url": text(node.get("url")), "image": text(head(node.get("image"))), "brand": text(brand.get("name") if isinstance(brand, dict) else brand), "price": text(price), "number": number, "currency": text(offer.get("priceCurrency"))}


def _products(html: str) -> list[dict]:
    stack, out = [], []
    for block in JSON_LD.findall(html):
        try:
            top = json.loads(block.strip(), parse_constant=_no_number)
        except (ValueError, RecursionError):
            continue
        stack += top if isinstance(top, list) else [top]
    stack.reverse()
    while stack:
        node = stack.pop()
        if isinstance(node, list):
            stack += reversed(node)
        if not isinstance(node, dict):
            continue
        kind, listed = node.get("@type"), node.get("itemListElement")
        stack += reversed(list(node.values()))
        if kind == "ItemList" and isinstance(listed, list):
            stack += reversed([(e.get("item") or e) if isinstance(e, dict) else e for e in listed])
        if kind == "Product":
            out.append(_product(node))
    return out


@F.arrow_udf(ArrayType(StructType([StructField(c, DoubleType() if c == "number" else StringType()) for c in ("name", "url", "image", "brand", "price", "number", "currency")])))
def json_ld_products(pages: pa.Array) -> pa.Array:
    """Nodes of type Product in each page's JSON-LD, in document order.

    Products that an ItemList holds come twice, as its items and as its parts.
    A block that is no JSON, or is nested deeper than the parser goes, is left
    out. A price is either a string or a number; what is no finite number is
    none.
    """
    kind = pa.list_(pa.struct([(c, pa.float64() if c == "number" else pa.string()) for c in ("name", "url", "image", "brand", "price", "number", "currency")]))
    return pa.array([_products(page.as_py() or "") for page in pages], kind)


@udtf(returnType="at int, href string, inner string, near string")
class Anchors:
    """(offset, href, inner HTML, what stands around) of each link of a page.

    A link carries the 500 characters before it and the 1500 from it on, and not
    its page, so a page costs what it is long and some for each link.
    """

    LINK = re.compile(ANCHOR, re.I)

    def eval(self, html: str):
        for m in self.LINK.finditer(html or ""):
            yield m.start(), m[1], m[2], html[max(0, m.start() - 500) : m.start() + 1500]


@udtf(returnType="body string")
class EmbeddedArray:
    """The first ``"products":[...]`` of a page, up to its matching bracket."""

    TOKEN = re.compile(r'\\.|["\[\]]', re.S)

    def eval(self, html: str):
        start = (html or "").find('"products":[')
        if start < 0:
            return
        start, depth, quoted = start + 11, 0, False
        for m in self.TOKEN.finditer(html, start):
            if m[0] == '"':
                quoted = not quoted
            elif not quoted and m[0] in "[]":
                depth += 1 if m[0] == "[" else -1
                if depth == 0:
                    yield (html[start : m.end()],)
                    return


def _lateral(df: DataFrame, table: type, column: str) -> DataFrame:
    return df.lateralJoin(table(F.col(column).outer()))


def _place(idx: str = "idx") -> Column:
    """Where an offer stands: its place in the page, with the page's number if
    that is not the first of its query."""
    return F.concat(F.when(F.col("page") != 0, F.concat(F.col("page").cast("string"), F.lit("-"))).otherwise(""), F.col(idx).cast("string"))


def _offer(df: DataFrame, source: str, idx: str = "idx", **columns: Column) -> DataFrame:
    """The offer columns; what is invalid (no name, price or URL) goes."""
    defaults = {"brand": F.lit(None).cast("string"), "variant": F.lit(None).cast("string"), "currency": F.lit("RON"), "image_url": F.lit("")}
    bare = F.struct(F.lit(None).alias("brand"), F.lit(None).alias("kind"), F.lit(False).alias("organic"), F.lit(None).alias("pack"), F.lit(None).alias("count"), F.lit(None).alias("variant"), F.lit(None).alias("diaper_size")).cast(ATTRIBUTES)
    fixed = {"source": F.lit(source), "attributes": bare, "price_per_unit": F.lit(None).cast(PER_UNIT), "ord": F.struct(F.lit(SOURCES.index(source)).alias("source"), F.col("page").alias("a"), F.col(idx).cast("bigint").alias("b"))}
    every = defaults | fixed | {"id": F.concat(F.lit(f"{source}-"), _place(idx))} | columns
    out = df.select("query", *[every[c].alias(c) for c in OFFER_COLUMNS])
    return out.filter((F.coalesce("name", F.lit("")) != "") & (F.col("price") > 0) & (F.coalesce("product_url", F.lit("")) != ""))


def _numbered(pages: DataFrame) -> DataFrame:
    """(query, page, body): page 0 where the table numbers none. All readers of
    bodies begin here, so here is seen to it that batches of bodies are small."""
    small_batches(pages.sparkSession)
    page = F.coalesce(F.col("page").cast("bigint"), F.lit(0)) if "page" in pages.columns else F.lit(0)
    return pages.select("query", page.cast("bigint").alias("page"), "body")


def _node_price(node: Column) -> Column:
    return F.coalesce(node["number"], normalize_price(node["price"]), F.lit(0.0))


def _node_offers(pages: DataFrame, source: str) -> DataFrame:
    nodes = pages.select("query", "page", F.posexplode("nodes").alias("idx", "n"))
    n = F.col("n")
    return _offer(nodes, source, name=n["name"], price=_node_price(n), currency=F.coalesce(n["currency"], F.lit("RON")), image_url=F.coalesce(n["image"], F.lit("")), product_url=F.coalesce(n["url"], F.lit("")), brand=n["brand"])


def json_ld_offers(pages: DataFrame, source: str) -> DataFrame:
    return _node_offers(_numbered(pages).withColumn("nodes", json_ld_products(F.col("body"))), source)


def anchor_products(pages: DataFrame, base: str, pattern: str, currency: str = "RON") -> DataFrame:
    """(query, page, url, name, image, price, currency, idx) of the links that match.

    Links to one URL are one product: the longest name, the first image, price
    and currency found near any of them.
    """
    links = _lateral(_numbered(pages), Anchors, "body")
    found = links.select("query", "page", "at", normalize_url(F.col("href"), base).alias("url"), clean_text(F.col("inner")).alias("name"), "near")
    found = found.filter(F.col("url").rlike(pattern) & (F.length("name") >= 3))
    near = F.struct(F.nullif(F.regexp_extract("near", IMAGE, 1), F.lit("")).alias("image"), window_price(strip_tags_for_price(F.col("near"))).alias("price"))
    # behind a generator what is read of the surroundings is searched for once, however often it is used
    found = found.select("query", "page", "at", "url", "name", F.explode(F.array(near)).alias("near"))
    found = found.select("query", "page", "at", "url", "name", normalize_url(F.col("near.image"), base).alias("image"), "near.price", F.when(F.col("near.price") != 0, currency).alias("currency"))
    return merge_by_url(found)


def merge_by_url(found: DataFrame) -> DataFrame:
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("at"))).alias(c)
    merged = found.groupBy("query", "page", "url").agg(F.min_by("name", F.struct(-F.length("name"), "at")).alias("name"), first("image"), first("price"), first("currency"), F.min("at").alias("idx"))
    return merged


def anchor_offers(pages: DataFrame, source: str) -> DataFrame:
    found = anchor_products(pages, BASE[source], LINKS[source])
    if source == "notino":
        found = found.filter(~F.col("url").contains("search.asp"))
    return _offer(found, source, name=F.col("name"), price=F.coalesce("price", F.lit(0.0)), currency=F.coalesce("currency", F.lit("RON")), image_url=F.coalesce("image", F.lit("")), product_url=F.col("url"))


def card_offers(pages: DataFrame) -> DataFrame:
    """Offers of a page laid out in cards; the first valid card of a key counts."""
    base = BASE["emag"]
    cards = _numbered(pages).select("query", "page", F.posexplode(F.split("body", 'data-zone="card"')).alias("pos", "card")).filter("pos > 0")
    cards = cards.withColumn("card", F.substring("card", 1, 12000))
    pick = lambda p, g=1: F.nullif(F.regexp_extract("card", p, g), F.lit(""))
    data = cards.withColumns({"url": pick(CARD_URL), "product": decode_attribute(pick(CARD_PRODUCT)), "title": pick(CARD_TITLE), "label": pick(CARD_LABEL), "near": pick(CARD_PRICE), "image": pick(CARD_IMAGE)})
    named = F.try_variant_get(F.try_parse_json("product"), "$.product_name", "variant")
    text = F.when(F.schema_of_variant(named) == "STRING", F.variant_get(named, "$", "string"))
    own = F.nullif(trim_ws(collapse_ws(text)), F.lit(""))
    name = F.coalesce(own, F.when(F.col("title").isNotNull(), clean_text(F.col("title"))), F.when(F.col("label").isNotNull(), clean_text(F.col("label"))), F.lit(""))
    card = F.struct("url", name.alias("name"), F.nullif(F.regexp_extract("url", CARD_KEY, 1), F.lit("")).alias("key"), card_price(trim_ws(strip_tags_for_price(F.col("near")))).alias("price"), F.replace(F.coalesce("image", F.lit("")), F.lit("&amp;"), F.lit("&")).alias("image"))
    # behind a generator the filter reads what was made and does not make it again
    data = data.select("query", "page", "pos", F.explode(F.array(card)).alias("c")).select("query", "page", "pos", "c.*")
    valid = data.filter("key IS NOT NULL AND price > 0").filter(F.length("name") >= 5)
    firsts = valid.groupBy("query", "page", "key").agg(F.min_by(F.struct("url", "name", "price", "image"), "pos").alias("c"), F.min("pos").alias("idx")).select("query", "page", "idx", "c.*")
    url = F.when(F.col("url").startswith("http"), F.col("url")).otherwise(F.concat(F.lit(base), F.col("url")))
    return _offer(firsts, "emag", name=F.col("name"), price=F.col("price"), image_url=F.col("image"), product_url=url)


def page_offers(pages: DataFrame, source: str) -> DataFrame:
    """Of each page its JSON-LD if that gives a valid offer, else its layout.

    A page is judged by itself, in its row, so pages are neither joined nor moved.
    """
    pages = _numbered(pages)
    read = pages.filter(F.lower("body").contains("ld+json")).select("query", "page", F.explode(F.array(json_ld_products(F.col("body")))).alias("nodes"))
    valid = lambda n: (F.coalesce(n["name"], F.lit("")) != "") & (F.coalesce(n["url"], F.lit("")) != "") & (_node_price(n) > 0)
    # all rows go through a Python function, whatever asks for it: the others' bodies stay here
    told = F.exists(json_ld_products(F.when(F.lower("body").contains("ld+json"), F.col("body"))), valid)
    rest = pages.filter(~told)
    return _node_offers(read, source).unionByName(card_offers(rest) if source == "emag" else anchor_offers(rest, source))


def trendyol_offers(pages: DataFrame) -> DataFrame:
    arrays = _lateral(_numbered(pages).withColumnRenamed("body", "html"), EmbeddedArray, "html")
    rows = arrays.select("query", "page", F.posexplode(F.from_json("body", _TRENDYOL)).alias("idx", "p"))
    p = F.col("p")
    raw = lambda c: F.when(c.rlike(r"^-?\d+(\.\d+)?([eE][-+]?\d+)?$"), c.try_cast("double")).otherwise(normalize_price(c))
    price = F.coalesce(raw(p["price"]["discountedPrice"]), raw(p["price"]["current"]), raw(p["price"]["originalPrice"]), F.lit(0.0))
    url = F.coalesce(p["url"], F.lit(""))
    return _offer(rows, "trendyol", id=F.concat(F.lit("trendyol-"), F.coalesce(p["id"], _place())), name=F.trim(F.concat_ws(" ", F.nullif(p["brand"], F.lit("")), F.nullif(p["name"], F.lit("")))), price=price, image_url=F.coalesce(F.get(p["images"], F.lit(0)), p["image"], F.lit("")), product_url=F.when(url.startswith("http"), url).otherwise(F.concat(F.lit(BASE["trendyol"]), url)), brand=p["brand"])


def dm_offers(bodies: DataFrame) -> DataFrame:
    rows = _numbered(bodies).select("query", "page", F.posexplode(F.from_json("body", _DM)["products"]).alias("idx", "p"))
    p, t = F.col("p"), F.col("p.tileData")
    tracked = t["trackingData"]["price"]
    price = F.when(tracked > 0, tracked).otherwise(F.coalesce(normalize_price(t["price"]["price"]["current"]["value"]), F.lit(0.0)))
    path = F.coalesce(t["self"], F.lit(""))
    return _offer(rows, "dm", id=F.concat(F.lit("dm-"), F.coalesce(p["dan"], p["gtin"], _place())), name=F.coalesce(p["title"], t["title"]["tileHeadline"], t["title"]["tileHeadlineLong"], F.lit("")), price=price, currency=F.coalesce(t["trackingData"]["currency"], F.lit("RON")), image_url=F.coalesce(F.get(t["images"], F.lit(0))["tileSrc"], F.lit("")), product_url=F.when(path != "", F.concat(F.lit(BASE["dm"]), path)).otherwise(""), brand=F.coalesce(p["brandName"], t["brand"]["name"], t["trackingData"]["brand"]))


def realfoods_offers(bodies: DataFrame) -> DataFrame:
    rows = _numbered(bodies).select("query", "page", F.posexplode(F.from_json("body", _REALFOODS)["data"]["products"]).alias("idx", "p"))
    p = F.col("p")
    slug, image = F.coalesce(p["slug"], F.lit("")), p["primaryImage"]
    small = F.nullif(F.try_element_at(image["imageVariants"]["variants"], F.lit("1x")), F.lit(""))
    return _offer(rows, "realfoods", id=F.concat(F.lit("realfoods-"), F.coalesce(p["_id"], p["sku"], _place())), name=F.coalesce(p["name"], F.lit("")), price=F.coalesce(p["finalPrice"] / 100, F.lit(0.0)), image_url=F.coalesce(F.concat(F.nullif(image["baseURL"], F.lit("")), F.lit("/"), small), F.lit("")), product_url=F.when(slug != "", F.concat(F.lit(BASE["realfoods"] + "/products/"), slug, F.lit("/"))).otherwise(""), brand=p["brand"])


def sezamo_offers(bodies: DataFrame) -> DataFrame:
    rows = _numbered(bodies).select("query", "page", F.posexplode(F.from_json("body", _SEZAMO)["data"]["productList"]).alias("idx", "p"))
    p = F.col("p")
    sale = F.get(p["sales"], F.lit(0))["price"]["full"]
    place = F.concat(F.lit(BASE["sezamo"] + "/"), F.nullif(F.get(p["categories"], F.lit(0))["nameId"], F.lit("")), F.lit("/"), F.nullif(p["baseLink"], F.lit("")))
    return _offer(rows, "sezamo", id=F.concat(F.lit("sezamo-"), F.coalesce(p["productId"], _place())), name=F.coalesce(p["productName"], F.lit("")), price=F.when(sale > 0, sale).otherwise(F.coalesce(p["price"]["full"], F.lit(0.0))), currency=F.coalesce(p["price"]["currency"], F.lit("RON")), image_url=F.coalesce(F.concat(F.lit(SEZAMO_IMAGES), F.nullif(p["imgPath"], F.lit(""))), F.lit("")), product_url=F.coalesce(place, F.lit("")), brand=p["brand"])


READERS = {"emag": lambda d: page_offers(d, "emag"), "bebetei": lambda d: page_offers(d, "bebetei"), "notino": lambda d: page_offers(d, "notino"), "trendyol": trendyol_offers, "dm": dm_offers, "realfoods": realfoods_offers, "sezamo": sezamo_offers}


def read_offers(payloads: DataFrame, most: int = MOST) -> DataFrame:
    """Offers of all sources of stored payloads, at most ``most`` for each query
    and source, in order of page and document; failed payloads give none.

    Payloads are (source, query, status, body); where a query has several of a
    source, a column ``page`` tells them apart, from 0.
    """
    good = fetch_status(payloads).filter("success")
    parts = [READERS[s](good.filter(F.col("source") == s)) for s in SOURCES]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return top_per_source(every, most)


def top_per_source(offers: DataFrame, most: int = MOST) -> DataFrame:
    from pyspark.sql import Window

    keys = [c for c in ("query", "source") if c in offers.columns]
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("ord"))
    return offers.withColumn("source_rank", rank).filter(F.col("source_rank") <= most)

"""The offer relation and the fixed list of sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Source codes in their order.
SOURCES = ["emag", "bebetei", "notino", "trendyol", "dm", "realfoods", "sezamo"]

PACK = "struct<value:double,unit:string,original:string>"
ATTRIBUTES = f"struct<brand:string,kind:string,organic:boolean,pack:{PACK},count:double,variant:string,diaper_size:string>"
PER_UNIT = "struct<value:double,unit:string>"
#: Input order: source, then place in the source.
ORD = "struct<source:int,a:bigint,b:bigint>"

OFFER = f"id string, name string, price double, currency string, image_url string, product_url string, source string, brand string, variant string, attributes {ATTRIBUTES}, price_per_unit {PER_UNIT}, ord {ORD}"
OFFER_COLUMNS = ["id", "name", "price", "currency", "image_url", "product_url", "source", "brand", "variant", "attributes", "price_per_unit", "ord"]


def source_dim(spark: SparkSession) -> DataFrame:
    """(source, source_ord): one row for each known source."""
    return spark.createDataFrame([(s, i) for i, s in enumerate(SOURCES)], "source string, source_ord int")

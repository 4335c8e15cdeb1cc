"""The older grouping by brand, product line and size, which keeps singletons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ascii_letters

#: Fixed values.
SIZE_WORDS = ["nr", "no", "numar", "marime", "marimea", "size", "stage", "etapa"]
STOPWORDS = ["scutece", "diapers", "pampers", "buc", "bucati", "pack", "pachet", "jumbo", "value", "maxi", "premium", "pants", "dry", "soft", "extra", "plus", "care"]


def plain_text(c: Column) -> Column:
    return F.trim(F.regexp_replace(ascii_letters(F.lower(F.coalesce(c, F.lit("")))), "[^a-z0-9+]+", " "))


def size_stage(tokens: Column) -> Column:
    """First token that tells a size: "5+", a number by a size word, or up to 8."""
    words = F.array(*map(F.lit, SIZE_WORDS))
    beside = lambda i: F.array_contains(words, F.coalesce(F.get(tokens, i), F.lit("")))

    def told(t: Column, i: Column) -> Column:
        number = t.rlike("^[0-9]{1,2}$") & (beside(i - 1) | beside(i + 1) | (t.try_cast("int") <= 8))
        return F.when(t.rlike(r"^[0-9]{1,2}\+$") | number, t)

    return F.get(F.filter(F.transform(tokens, told), lambda x: x.isNotNull()), F.lit(0))


def legacy_groups(offers: DataFrame) -> DataFrame:
    """(brand, product_line, size_stage, name, n_sources, n, score)."""
    rows = offers.select("name", "source", "ord", plain_text(F.col("name")).alias("plain"), plain_text(F.col("brand")).alias("given")).filter("plain <> ''")
    rows = rows.withColumn("tokens", F.split("plain", " "))
    rows = rows.withColumns({"brand": F.when(F.col("given") != "", F.col("given")).otherwise(F.get("tokens", F.lit(0))), "size_stage": size_stage(F.col("tokens"))})
    stop = F.array(*map(F.lit, STOPWORDS))
    line = F.filter("tokens", lambda t: ~F.array_contains(stop, t) & (t != F.col("brand")) & ~t.eqNullSafe(F.col("size_stage")))
    rows = rows.withColumn("product_line", F.array_join(F.slice(line, 1, 4), " "))
    made = rows.groupBy("brand", "product_line", F.coalesce("size_stage", F.lit("")).alias("size_stage")).agg(F.min_by("name", F.struct(-F.length("name"), "ord")).alias("name"), F.count_distinct("source").alias("n_sources"), F.count(F.lit(1)).alias("n"))
    points = F.col("n_sources") * 100 + F.when(F.col("size_stage") != "", 10).otherwise(0) + F.when(F.col("brand") != "", 5).otherwise(0)
    return made.withColumn("score", points)

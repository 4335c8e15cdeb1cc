"""The one ungrouped offer that undercuts its comparable group the most."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .grouping import members, ungrouped

LEAST_SAVING = 0.20


def candidates(loose: DataFrame, groups: DataFrame, least: float = LEAST_SAVING, by: tuple[str, ...] = ()) -> DataFrame:
    """Ungrouped offers at ``least`` below the cheapest group of kind and unit.

    Groups come down to one row for each kind and unit first, so offers meet one
    row each, however many groups there are.
    """
    best = groups.filter("best_ppu IS NOT NULL").groupBy(*by, F.col("attributes.kind").alias("__kind"), F.col("unit").alias("__unit")).agg(F.min("best_ppu").alias("beaten_ppu"))
    offers = loose.filter("price_per_unit IS NOT NULL AND attributes.kind <> ''")
    offers = offers.withColumns({"__kind": F.col("attributes.kind"), "__unit": F.col("price_per_unit.unit")})
    joined = offers.join(best, [*by, "__kind", "__unit"]).drop("__kind", "__unit")
    saved = F.lit(1.0) - F.try_divide(F.col("price_per_unit.value"), F.col("beaten_ppu"))
    return joined.withColumn("savings", saved).filter(F.col("savings") >= least)


def loose_candidates(offers: DataFrame, groups: DataFrame, order: str = "rel", least: float = LEAST_SAVING, by: tuple[str, ...] = (), repeated: bool = True) -> DataFrame:
    """``candidates`` of the offers that are in none of ``groups``.

    Few offers save that much, so those are found first, and only they and what
    else has their ids are looked up in the groups; not all offers are. Where no
    id is ``repeated``, nothing else can have one.
    """
    few = candidates(offers, groups, least, by)
    same = offers.join(few.select(*by, "id").distinct(), [*by, "id"], "left_semi").select(offers.columns) if repeated else few
    return ungrouped(few, members(same, groups, order, by), by)


def standout(loose: DataFrame, groups: DataFrame, order: str = "rel", least: float = LEAST_SAVING) -> DataFrame:
    """The candidate that saves most; ties go to the lower unit price, then first."""
    return best_of(candidates(loose, groups, least), order)


def best_of(found: DataFrame, order: str = "rel") -> DataFrame:
    """``standout`` of candidates."""
    return found.orderBy(F.desc("savings"), "price_per_unit.value", order).limit(1)


def standout_each(loose: DataFrame, groups: DataFrame, by: tuple[str, ...], order: str = "rel", least: float = LEAST_SAVING) -> DataFrame:
    """``standout`` of each value of ``by``."""
    found = candidates(loose, groups, least, by)
    first = F.struct((-F.col("savings")).alias("s"), F.col("price_per_unit.value").alias("v"), F.col(order).alias("o"))
    return found.groupBy(*by).agg(F.min_by(F.struct("id", "name", "price", "source", "savings", "beaten_ppu"), first).alias("d")).select(*by, "d.*")


def without(loose: DataFrame, deal: DataFrame) -> DataFrame:
    return loose.join(F.broadcast(deal.select("id")), "id", "left_anti").select(loose.columns)

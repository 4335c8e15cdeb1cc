"""The whole search: what is relevant is written once, the rest is made when it is asked for."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import accounting, enrich, grouping, relevance, standout
from ..tables import numbered, written


@dataclass
class SearchResult:
    """Tables that answer a query; ``found`` is what reached the score. A total
    needs no groups, so these are made when they are first asked for."""

    query: str
    found: DataFrame
    counts: DataFrame
    errors: DataFrame | None = None
    enrichment_error: str | None = None

    @cached_property
    def groups(self) -> DataFrame:
        return grouping.numbered(grouping.groups(self.found.filter(F.lit(self.enrichment_error is None))))

    @cached_property
    def members(self) -> DataFrame:
        return grouping.members(self.found, self.groups)

    @cached_property
    def _loose(self) -> DataFrame:
        return grouping.ungrouped(self.found, self.members)

    @cached_property
    def deal(self) -> DataFrame:
        found = self.found.filter(F.lit(self.enrichment_error is None))
        return written(standout.best_of(standout.loose_candidates(found, self.groups)), "deal")

    @cached_property
    def ungrouped(self) -> DataFrame:
        return standout.without(self._loose, self.deal)

    def total(self) -> DataFrame:
        return self.found.agg(F.count(F.lit(1)).alias("total"))

    def entries(self) -> DataFrame:
        """(line, entry, group_id, id, name, price, source): the result in order,
        a row for each group, member, other offer and the standout.

        Lines are numbered from 0 without one task for all of them, and each
        range of lines is its own task's: written, the files' order is theirs.
        """
        none = F.lit(None).cast("string")
        zero = F.lit(0).cast("bigint")
        key = lambda part, a, b, rel: [F.lit(part).alias("__part"), a.cast("bigint").alias("__a"), b.cast("bigint").alias("__b"), rel.alias("__rel")]
        rel = F.lit(None).cast(self.found.schema["rel"].dataType)
        offer = ["id", "name", "price", "source"]
        parts = [
            self.groups.select(*key(1, F.col("group_rank"), zero, rel), F.lit("group").alias("entry"), "group_id", none.alias("id"), F.col("matched_name").alias("name"), F.col("best_price").alias("price"), F.col("best_price_source").alias("source")),
            self.members.select(*key(1, F.col("group_rank"), F.col("member_rank"), rel), F.lit("member").alias("entry"), "group_id", *offer),
            self.ungrouped.select(*key(2, zero, zero, F.col("rel")), F.lit("ungrouped").alias("entry"), none.alias("group_id"), *offer),
            self.deal.select(*key(3, zero, zero, rel), F.lit("standout").alias("entry"), none.alias("group_id"), *offer),
        ]
        every = parts[0]
        for p in parts[1:]:
            every = every.unionByName(p)
        return numbered(every, ["__part", "__a", "__b", "__rel"], "line").select("line", "entry", "group_id", *offer)

    def document(self) -> DataFrame:
        """(line, text): one JSON document, a line for each offer; what is empty
        is left out. Joined in order of line the texts are the document, and no
        row holds more than one offer."""
        offer = F.to_json(F.struct("id", "name", "price", "currency", "source", "product_url", "attributes", "price_per_unit", "relevance_score"))
        group = F.to_json(F.struct("group_id", "matched_name", "best_price", "best_price_source", "best_ppu", "best_ppu_source", "match_confidence", "attributes", "score"))
        opened = lambda text: F.substr(text, F.lit(1), F.length(text) - 1)
        comma = lambda first: F.when(first, "").otherwise(",")
        rel = self.found.schema["rel"].dataType
        long = lambda c: (c if isinstance(c, Column) else F.lit(c)).cast("bigint")

        def part(df: DataFrame, key: tuple, text: Column, at: Column | None = None) -> DataFrame:
            place = [long(k).alias(f"__{i}") for i, k in enumerate(key)]
            return df.select(*place, (F.lit(None).cast(rel) if at is None else at).alias("__rel"), text.alias("text"))

        one = self.found.sparkSession.range(1)
        rank = F.col("group_rank")
        first = self.ungrouped.agg(F.min("rel").alias("__first"))
        parts = [
            part(one, (0, 0, 0), F.concat(opened(F.to_json(F.struct(F.lit(self.query).alias("query")))), F.lit(',"groups":['))),
            part(self.groups, (1, rank, 0), F.concat(comma(rank == 1), opened(group), F.lit(',"products":['))),
            part(self.members, (1, rank, F.col("member_rank")), F.concat(comma(F.col("member_rank") == 1), offer)),
            # no group has more members than it counts
            part(self.groups, (1, rank, F.col("n") + 1), F.lit("]}")),
            part(one, (2, 0, 0), F.lit('],"ungrouped":[')),
            part(self.ungrouped.join(F.broadcast(first)), (3, 0, 0), F.concat(comma(F.col("rel") == F.col("__first")), offer), F.col("rel")),
            part(self._rest(), (4, 0, 0), F.concat(F.lit("],"), F.substr("document", F.lit(2)))),
        ]
        every = parts[0]
        for p in parts[1:]:
            every = every.unionByName(p)
        return numbered(every, ["__0", "__1", "__2", "__rel"], "line").select("line", "text")

    def _rest(self) -> DataFrame:
        """(document): one row, what a document holds beside its offers."""
        deal = F.struct("id", "name", "price", "source", "savings", "beaten_ppu")
        out = self.total()
        out = out.join(self.counts.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("source", "n")))).alias("count_by_source")))
        out = out.join(self.deal.agg(F.first(deal).alias("standout")))
        fields = ["total", "count_by_source", "standout", F.lit(self.enrichment_error).alias("enrichment_error")]
        if self.errors is not None:
            out = out.join(self.errors.agg(F.map_from_entries(F.collect_list(F.struct("source", "error"))).alias("source_errors")))
            fields.append(F.when(F.size("source_errors") > 0, F.col("source_errors")).alias("source_errors"))
        return out.select(F.to_json(F.struct(*fields)).alias("document"))


def search(offers: DataFrame, query: str, attributes: DataFrame | None = None, min_score: int = relevance.MIN_SCORE, errors: DataFrame | None = None, enrichment_error: str | None = None) -> SearchResult:
    """Score, filter, group and compare ``offers`` for one query.

    ``attributes`` is a provider's table, attached before scoring. With an
    ``enrichment_error`` nothing is grouped and there is no standout.
    """
    relevance.check_query(query)
    counts = accounting.count_by_source(offers)
    if attributes is not None:
        offers = enrich.attach_attributes(offers, attributes)
    # read by totals, groups, members and what is in none
    found = written(relevance.relevant(enrich.with_per_unit(offers), query, min_score), "found")
    return SearchResult(query, found, counts, errors, enrichment_error)

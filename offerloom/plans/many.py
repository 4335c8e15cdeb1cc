"""Many searches at once: from stored payloads to the groups of each query."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import accounting, enrich, grouping, offer_index, relevance, standout
from ..sources import payloads
from ..tables import written

BY = ("query",)


@dataclass
class SearchResults:
    """Tables that answer all queries; each has the column ``query``. ``matches``
    are the offers that reach the score, as they come; ``found`` are these,
    written once for what reads them. All but ``matches`` are made when they are
    first asked for."""

    matches: DataFrame
    failed: DataFrame | None = None
    outcome: DataFrame | None = None

    @cached_property
    def found(self) -> DataFrame:
        return written(self.matches, "found")

    @cached_property
    def groups(self) -> DataFrame:
        known = self.found if self.failed is None else self.found.join(self.failed.select("query"), "query", "left_anti")
        return written(grouping.numbered_each(grouping.groups(known, by=BY), BY), "groups")

    @cached_property
    def members(self) -> DataFrame:
        return grouping.members(self.found, self.groups, by=BY)

    @cached_property
    def _loose(self) -> DataFrame:
        return grouping.ungrouped(self.found, self.members, BY)

    @cached_property
    def deals(self) -> DataFrame:
        return standout.standout_each(self._loose, self.groups, BY)

    @cached_property
    def ungrouped(self) -> DataFrame:
        return self._loose.join(self.deals.select(*BY, "id"), [*BY, "id"], "left_anti")


def search_each(offers: DataFrame, asked: DataFrame, min_score: int = relevance.MIN_SCORE, failed: DataFrame | None = None) -> SearchResults:
    """Score, filter, group and compare the offers of each query.

    Takes offers with a column ``query`` and a table (query, asked) with one row
    for each query and the text that was asked for; offers of no such query go,
    and so do those of a blank text. All keys, ranks and anti-joins are within a
    query, so an offer may be grouped for one query and stand alone for another.
    Of the queries in ``failed`` (query, error), whose attributes are missing,
    nothing is grouped and there is no deal.
    """
    pairs = offers.join(asked.select("query", "asked"), "query")
    scored = relevance.score_each(enrich.with_per_unit(pairs)).drop("asked")
    return SearchResults(relevance.reaching(scored, min_score), failed)


def search_table(offers: DataFrame | offer_index.OfferIndex, asked: DataFrame, min_score: int = relevance.MIN_SCORE) -> SearchResults:
    """``search_each`` of offers that belong to no query: each of ``asked`` meets
    those that can reach the score, by an index of the offers (or one that was
    built before), and not all of them. A query is scored against each distinct
    text once, however many offers share it."""
    index = offers if isinstance(offers, offer_index.OfferIndex) else offer_index.build(offers)
    scored = offer_index.matches(index, asked, min_score)
    return SearchResults(relevance.reaching(enrich.with_per_unit(scored), min_score))


def search_payloads(stored: DataFrame, asked: DataFrame, attributes: DataFrame | None = None, models: list[enrich.Model] | None = None, min_score: int = relevance.MIN_SCORE) -> SearchResults:
    """``search_each`` over what all sources answered.

    ``stored`` are payloads (source, query, status, body, page if a query has
    several of a source). ``outcome`` tells of each query and source the number
    of offers and why it failed. ``attributes``, a provider's table, is attached
    by id (and query, if it has one) before scoring; with ``models`` it is made
    of their answers, and queries without a valid one degrade.
    """
    status = payloads.fetch_status(stored).select("query", "source", "success", "error")
    offers = written(payloads.read_offers(stored).drop("source_rank"), "offers")
    outcome = accounting.outcome_each(status, offers)
    failed = None
    if models is not None:
        # asked once, whatever reads the answers
        answers = written(enrich.responses(offers, models), "answers")
        attributes, failed = enrich.parse_response(answers), enrich.failures(answers)
    if attributes is not None:
        offers = enrich.attach_attributes(offers, attributes)
    out = search_each(offers, asked, min_score, failed)
    out.outcome = outcome
    return out

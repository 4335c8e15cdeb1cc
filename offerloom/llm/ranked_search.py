"""Ranked lexical search over a tiered index.

The score of a document is a sum over an item's terms of weight times impact;
the impact follows from the term's occurrences and the text's length, both with
whole numbers only, so that every way of adding them up gives the same.

Index (``build_index``), three tables in the shared folder:

* lexicon: term, df. Each task counts its texts' terms and hands on sums.
* postings: tier, term, row, doc_id, impact, one for each term of each text and
  no others, in folders by tier and in order of tier and term within a file, so
  that a scan for some terms skips what is not theirs. They stay with the task
  that read the texts, so the index is built without moving postings.
* the numbers N and L.

A term with a df of at most ``share`` * N has all its postings in the tier of
that share; of the others only those with an impact of ``cut`` or more are in
it. So below a tier nothing is left of a rare term, and of a frequent one at
most weight * (cut - 1): the residual bound of the term, small as its weight is.

Search: items meet the postings of the first tier, and partial sums give each
document a lower bound, and with the residual bounds of the terms not yet seen
an upper one. Documents whose upper bound is under the item's tenth best lower
bound go. An item is proven when that is also above the sum of all its residual
bounds, since then no document that has not been seen can come in; the lower
tiers are read only for the documents that it has left. Items without proof fall
through to the next tier by themselves; after the last, sums are whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, fresh_path, keep_ids, materialize, ship_package, text_buffer, text_pieces
from .shingles import word_hashes

#: Bytes that part terms: all of ASCII but digits and letters.
PARTS = np.zeros(256, bool)
PARTS[:128] = True
PARTS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = False

#: (share of N, impact): what a posting of a tier has; the last tier has the rest.
TIERS = [(1 / 64, 700_000), (1 / 8, 600_000)]
#: The frequent terms are those above the first share, but never more than so
#: many: as all df add up to L at most, no more than that have a df above L / MOST.
MOST = 1 << 20
#: Terms that a task counts before it hands them on.
HELD = 1 << 20


@dataclass
class TieredIndex:
    postings: DataFrame
    lexicon: DataFrame
    n_docs: int
    n_terms: int


def _text_terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, occurrences) of each text's terms in order, and text sizes."""
    hashes, firsts = word_hashes(*text_buffer(column), space=PARTS)
    sizes = np.diff(firsts)
    if len(sizes) == 1:
        hashes.sort()
        text = np.zeros(len(hashes), np.uint8)
    else:
        text = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        order = np.lexsort((hashes, text))
        hashes, text = hashes[order], text[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    return text[at], hashes[at], np.diff(np.append(at, len(hashes))), sizes


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (term, df) and, under the null term, (N, L) of this task."""
    terms, df = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    n_docs = n_terms = 0
    names = ["term", "df", "total"]
    told = lambda: pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(df), pa.nulls(len(df), pa.int64())], names)
    for piece in text_pieces(batches, "text"):
        _, found, _, sizes = _text_terms(piece.column("text"))
        n_docs += int((sizes > 0).sum())
        n_terms += int(sizes.sum())
        found, n = np.unique(found, return_counts=True)
        both, place = np.unique(np.concatenate([terms, found]), return_inverse=True)
        df = np.bincount(place, np.concatenate([df, n]), len(both)).astype(np.int64)
        terms = both
        if len(terms) > HELD:
            yield told()
            terms, df = terms[:0], df[:0]
    yield told()
    yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([n_docs]), pa.array([n_terms])], names)


def _postings(n_docs: int, n_terms: int, frequent) -> object:
    """Postings of each text, with the tier of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, df = frequent.value
        names = ["tier", "term", "row", "doc_id", "impact"]
        for piece in text_pieces(batches, "text"):
            text, term, tf, sizes = _text_terms(piece.column("text"))
            m = np.array([10 + 90 * int(n) * n_docs // max(n_terms, 1) for n in sizes], np.int64)[text]
            impact = 1_000_000_000 * tf // (1000 * tf + 8 * m)
            place = np.minimum(np.searchsorted(known, term), max(len(known) - 1, 0))
            often = np.where(known[place] == term, df[place], 0) if len(known) else np.zeros(len(term), np.int64)
            tier = np.full(len(term), len(TIERS), np.int32)
            for t, (share, cut) in reversed(list(enumerate(TIERS))):
                tier[(often <= share * n_docs) | (impact >= cut)] = t
            rows = pa.array(piece.column("row").to_numpy()[text])
            yield pa.RecordBatch.from_arrays([pa.array(tier), pa.array(term.view(np.int64)), rows, piece.column("doc_id").take(pa.array(text)), pa.array(impact.astype(np.int32))], names)

    return run


def build_index(docs: DataFrame) -> TieredIndex:
    """Index of all rows of (doc_id bigint, text string, ...)."""
    spark = docs.sparkSession
    ship_package(spark)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    counted = docs.select("text").mapInArrow(_count, "term bigint, df bigint, total bigint")
    lexicon = materialize(counted.groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total")), "lexicon")
    whole = lexicon.filter("term IS NULL").first()
    n_docs, n_terms = (whole["df"], whole["total"]) if whole else (0, 0)
    lexicon = lexicon.filter("term IS NOT NULL").select("term", "df")
    least = max(TIERS[0][0] * n_docs, n_terms / MOST)
    often = lexicon.filter(F.col("df") > least).toPandas().sort_values("term", key=lambda t: t.to_numpy().view(np.uint64))
    frequent = spark.sparkContext.broadcast((often["term"].to_numpy(np.int64).view(np.uint64), often["df"].to_numpy(np.int64)))
    rows = docs.withColumn("row", F.monotonically_increasing_id())
    postings = rows.mapInArrow(_postings(n_docs, n_terms, frequent), "tier int, term bigint, row bigint, doc_id bigint, impact int")
    path = fresh_path(spark, "postings")
    # codec: the ids of one task have most of their bytes in common
    postings.sortWithinPartitions("tier", "term").write.partitionBy("tier").option("compression", "zstd").parquet(path)
    return TieredIndex(_read(spark, path), lexicon, n_docs, n_terms)


def _read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("term bigint, row bigint, doc_id bigint, impact int, tier int").parquet(path)


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in text_pieces(batches, "text"):
        text, term, _, _ = _text_terms(piece.column("text"))
        yield pa.RecordBatch.from_arrays([piece.column("item").take(pa.array(text)), pa.array(term.view(np.int64))], ["item", "term"])


def _residuals(df, weight, n_docs: int) -> list:
    """What a posting of the term can add at most below each tier but the last."""
    least = lambda share: F.lit(float(max(share * n_docs, 0)))
    return [F.when(df > least(share), weight * (cut - 1)).otherwise(0).cast("bigint").alias(f"r{t}") for t, (share, cut) in enumerate(TIERS)]


def _best(sums: DataFrame, k: int) -> DataFrame:
    """The k first rows of each item: Spark keeps k of each task before it moves them."""
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "row"))
    return sums.withColumn("rank", rank).filter(F.col("rank") <= k)


def _search_block(index: TieredIndex, wanted: DataFrame, k: int) -> DataFrame:
    """(item, rank, doc_id, score) for items whose terms ``wanted`` has, with weights."""
    last = len(TIERS)
    bounds = wanted.groupBy("item").agg(*[F.sum(f"r{t}").alias(f"all{t}") for t in range(last)])
    bounds = materialize(bounds, "bounds")
    open_terms, sums, pending = wanted, None, None
    for tier in range(last + 1):
        more = [f"r{t}" for t in range(tier, last)]
        found = index.postings.filter(F.col("tier") == tier).join(F.broadcast(open_terms), "term")
        found = found.select("item", "row", "doc_id", (F.col("weight") * F.col("impact")).alias("score"), *more)
        sums = found if sums is None else sums.select(found.columns).unionByName(found)
        sums = sums.groupBy("item", "row").agg(F.first("doc_id").alias("doc_id"), *[F.sum(c).alias(c) for c in ["score", *more]])
        if tier == last:
            break
        sums = materialize(sums, "sums")
        # the item's k-th best lower bound, and whether that is a proof
        kth = _best(sums, k).filter(F.col("rank") == k).select("item", F.col("score").alias("kth"))
        state = bounds.join(kth, "item", "left").select("item", F.coalesce("kth", F.lit(0)).alias("kth"), F.col(f"all{tier}").alias("rest"))
        state = materialize(state.withColumn("proven", F.col("kth") > F.col("rest")), "proofs")
        # few of the upper bounds reach the k-th lower one
        left = sums.join(F.broadcast(state), "item").filter(F.col("score") + F.col("rest") - F.col(f"r{tier}") >= F.col("kth"))
        left = materialize(left.drop("kth", "rest"), "left")
        closed = left.filter("proven").select("item", "row", "doc_id", "score", F.lit(tier).alias("done"))
        pending = closed if pending is None else pending.unionByName(closed)
        sums, bounds = left.filter("NOT proven").drop("proven"), bounds.join(F.broadcast(state.filter("NOT proven").select("item")), "item", "left_semi")
        open_terms = open_terms.join(F.broadcast(state.filter("NOT proven").select("item")), "item", "left_semi")
        if bounds.isEmpty():
            sums = sums.limit(0)
            break
    sums = sums.select("item", "row", "doc_id", "score")
    if pending is not None:
        # lower postings of the documents that proven items have left, and of no others
        pairs = pending.join(wanted.select("item", "term", "weight"), "item").select("item", "row", "doc_id", "done", "term", "weight")
        low = keep_ids(index.postings.filter("tier > 0"), pending, "row")
        low = low.join(F.broadcast(wanted.select("term").distinct()), "term", "left_semi").select("term", "row", "tier", "impact")
        rest = pairs.join(low, ["term", "row"]).filter(F.col("tier") > F.col("done"))
        rest = rest.select("item", "row", "doc_id", (F.col("weight") * F.col("impact")).alias("score"))
        whole = pending.drop("done").unionByName(rest).groupBy("item", "row").agg(F.first("doc_id").alias("doc_id"), F.sum("score").alias("score"))
        sums = sums.unionByName(whole)
    return _best(sums.filter("score > 0"), k).select("item", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def search(index: TieredIndex, items: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` documents of the index that score highest for each item.

    Takes items (item_id bigint, text string, ...) and returns (item_id, rank,
    doc_id, score): ranks from 1, score above 0, ties by ascending doc_id, a null
    doc_id last. Terms are runs of ASCII digits and letters and of all characters
    beyond ASCII; only A-Z are lower-cased. A null text has no terms and finds
    nothing and is found by nothing. Rows are taken one by one: those that repeat
    a doc_id or a text have a rank each, and so have the items that repeat an
    item_id. Other columns are ignored.

    Terms are compared by 64-bit hashes. Items are taken in blocks whose terms a
    broadcast holds (``BROADCAST_ROWS``); the index is scanned once a block.
    """
    spark = items.sparkSession
    items = items.select(F.col("item_id").cast("bigint").alias("item_id"), "text").withColumn("item", F.monotonically_increasing_id())
    names = materialize(items, "items")
    terms = names.select("item", "text").mapInArrow(_item_terms, "item bigint, term bigint")
    terms = terms.join(index.lexicon, "term")
    weight = F.floor(1000 * F.log(F.lit(float(2 * index.n_docs + 2)) / (2 * F.col("df") + 1))).cast("bigint")
    terms = terms.withColumn("weight", weight).filter("weight > 0")
    terms = materialize(terms.select("item", "term", "weight", *_residuals(F.col("df"), F.col("weight"), index.n_docs)), "terms")
    n = terms.count()
    blocks = -(-n // BROADCAST_ROWS)
    schema = "item_id bigint, rank int, doc_id bigint, score bigint"
    if not n or not index.n_docs:
        return spark.createDataFrame([], schema)
    out = None
    for b in range(blocks):
        some = terms if blocks == 1 else materialize(terms.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b), "block")
        found = _search_block(index, some, k)
        out = found if out is None else out.unionByName(found)
    joined = out.join(names.select("item", "item_id"), "item")
    return joined.select("item_id", "rank", "doc_id", "score")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """``search`` over an index made of ``docs`` for this call."""
    return search(build_index(docs), items, k)

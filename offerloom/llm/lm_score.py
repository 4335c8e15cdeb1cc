"""Stupid-backoff scores of documents, with counts kept as tables.

The model is over bytes, of order ORDER (Brants et al., 2007, with bytes for
words: counts of word n-grams would be larger than the text itself). An n-gram
packs exactly into a bigint, the last byte lowest, so a context is a shift and a
shorter n-gram a mask, and every table is joined on integers, hash-partitioned
by n-gram. A byte after fewer bytes than the order needs sees zeros before.

    S(w | c) = N(cw) / N(c)           if N(cw) >= MIN_COUNT
             = BACKOFF * S(w | c')    else, c' without its first byte

Counts come from all documents. For scoring, documents are dealt by hash into
blocks of bounded size; the distinct n-grams of each block are joined to the
score table and summed per document in the block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, ship_package, text_buffer, text_pieces

ORDER = 5
MIN_COUNT = 2
BACKOFF = 0.4
BLOCK_BYTES = 32 << 20


def ngrams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The n-gram that ends at each byte, within its text."""
    out = data.astype(np.int64)
    left = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
    for k in range(1, ORDER):
        out[k:] |= np.where(left[k:] >= k, data[:-k].astype(np.int64) << (8 * k), 0)
    return out


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("gram", pa.int64()), ("n", pa.int64())])
    for piece in text_pieces(batches, "text"):
        grams, n = np.unique(ngrams(*text_buffer(piece.column("text"))), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(grams), pa.array(n, pa.int64())], schema=schema)


def score_table(docs: DataFrame, min_count: int = MIN_COUNT, backoff: float = BACKOFF) -> DataFrame:
    """(gram, score): the backed-off score of each n-gram of the corpus."""
    counts = docs.select("text").mapInArrow(_counts, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
    tables = {ORDER: materialize(counts, "ngrams")}
    for k in range(ORDER - 1, 0, -1):
        shorter = F.col("gram").bitwiseAND((1 << (8 * k)) - 1)
        tables[k] = materialize(tables[k + 1].groupBy(shorter.alias("gram")).agg(F.sum("n").alias("n")), "ngrams")
    total = tables[1].agg(F.sum("n")).first()[0] or 1
    scores = tables[1].select("gram", (F.col("n") / total).alias("score"))
    for k in range(2, ORDER + 1):
        context = F.shiftright("gram", 8)
        contexts = tables[k].groupBy(context.alias("context")).agg(F.sum("n").alias("all"))
        own = tables[k].withColumn("context", context).withColumn("shorter", F.col("gram").bitwiseAND((1 << (8 * (k - 1))) - 1))
        own = own.join(contexts, "context").join(scores.withColumnsRenamed({"gram": "shorter", "score": "less"}), "shorter")
        scores = own.select("gram", F.when(F.col("n") >= min_count, F.col("n") / F.col("all")).otherwise(backoff * F.col("less")).alias("score"))
    return materialize(scores, "scores")


def _distinct(table: pa.Table) -> pa.Table:
    found = np.zeros(0, np.int64)
    for piece in text_pieces(iter(table.select(["text"]).to_batches()), "text"):
        found = np.union1d(found, ngrams(*text_buffer(piece.column("text"))))
    block = table.column("block")[0].as_py()
    return pa.table({"block": pa.array(np.full(len(found), block, np.int32)), "gram": found})


def _score(docs: pa.Table, known: pa.Table) -> pa.Table:
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("log_score", pa.float64())])
    grams, logs = known.column("gram").to_numpy(), known.column("log").to_numpy()
    order = np.argsort(grams)
    grams, logs = grams[order], logs[order]
    out = []
    for piece in text_pieces(iter(docs.select(["doc_id", "text"]).to_batches()), "text"):
        data, offsets = text_buffer(piece.column("text"))
        each = logs[np.searchsorted(grams, ngrams(data, offsets))] if len(data) else np.zeros(0)
        sizes, sums = np.diff(offsets), np.zeros(len(offsets) - 1)
        if (sizes > 0).any():
            sums[sizes > 0] = np.add.reduceat(each, offsets[:-1][sizes > 0])
        out.append(pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(sums)], schema=schema))
    return pa.Table.from_batches(out, schema)


def lm_scores(docs: DataFrame, min_count: int = MIN_COUNT, backoff: float = BACKOFF, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Score each document by a model of all of them.

    Takes (doc_id bigint, text, ...) and returns (doc_id, n_bytes, log_score,
    mean_log_score), one row for each row: the sum of the natural logarithms of
    the scores of all bytes of the text in UTF-8, and their mean. A null or
    empty text has sum 0 and a null mean. Rows that repeat count each. Other
    columns are ignored.
    """
    ship_package(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = docs.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    blocks = max(1, math.ceil(total / block_bytes))
    table = score_table(docs, min_count, backoff).select("gram", F.log("score").alias("log"))
    dealt = docs.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int")).repartition(blocks, "block")
    needed = dealt.groupBy("block").applyInArrow(_distinct, "block int, gram bigint")
    known = needed.join(table, "gram").select("block", "gram", "log")
    scored = dealt.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(_score, "doc_id bigint, n_bytes bigint, log_score double")
    return scored.withColumn("mean_log_score", F.try_divide("log_score", "n_bytes"))

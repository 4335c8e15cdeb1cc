"""Benchmark decontamination: which documents contain which test items.

Items are short, documents long, so the measure is containment: the share of an
item's word shingles that the document has. Items fall into partitions by the
size of their shingle set (powers of two), and the partition sets how an item
is searched: ``rule`` gives the length of its MinHash sketch, the smallest
hashes of the set, and how many of them a document must have. A document at the
threshold is missed with probability under MISS, and one at half of it is
looked at in vain the more rarely the larger the items, so that no partition
spends more on false candidates. Where a sketch would be no shorter than the
sets of its partition they are taken whole, and the search is exact. Candidates
are then confirmed on the words themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, keep_ids, materialize, ship_package, text_buffer, text_pieces
from .shingles import shingle_hashes, word_hashes

#: A document at the threshold is missed with less than this probability.
MISS = 1e-9
#: Expected shingles compared in vain for a document at half the threshold.
VAIN = 0.1
#: Thresholds that would need a longer sketch have sets taken whole.
LONGEST = 512
#: Parts into which the rows of one hash or shingle are dealt where nothing is broadcast.
PARTS = 16


def _tail(m: int, share: float, least: int) -> float:
    """Probability that ``least`` or more of ``m`` are found, each with ``share``."""
    return sum(comb(m, k) * share**k * (1 - share) ** (m - k) for k in range(least, m + 1))


@cache
def rule(partition: int, threshold: float) -> tuple[int, int] | None:
    """(hashes of a sketch, how many of them must be found) for sets of
    2**partition and more shingles, or None where such sets are taken whole.

    How many of a sketch a document has is binomial at worst: the sketch is
    drawn from the set without replacement.
    """
    for m in range(16, min(2**partition, LONGEST), 8):
        missed, least = (1 - threshold) ** m, 0
        while missed < MISS:
            least += 1
            missed += comb(m, least) * threshold**least * (1 - threshold) ** (m - least)
        if least and _tail(m, threshold / 2, least) * 2 ** (partition + 1) <= VAIN:
            return m, least
    return None


def _hashes(k: int):
    schema = pa.schema([("item_id", pa.int64()), ("words", pa.int32()), ("hash", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in text_pieces(batches, "text"):
            hashes, firsts = word_hashes(*text_buffer(piece.column("text")))
            found, text = shingle_hashes(hashes, firsts, k)
            ids = piece.column("item_id").to_numpy(zero_copy_only=False)
            words = np.minimum(np.diff(firsts), k).astype(np.int32)
            columns = [pa.array(ids[text], pa.int64()), pa.array(words[text]), pa.array(found.view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def _sketches(shingles: DataFrame, threshold: float) -> DataFrame:
    """(item_id, hash, size, partition, needed) of the hashes to be searched.

    The sketch is that of all shingles of an id, whichever of its rows has them.
    """
    sizes = shingles.groupBy("item_id").agg(F.count(F.lit(1)).alias("size"))
    sizes = sizes.withColumn("partition", F.floor(F.log2("size")).cast("int"))
    sizes = materialize(sizes, "sizes")
    rules = {r["partition"]: rule(r["partition"], threshold) for r in sizes.select("partition").distinct().collect()}
    whole = F.greatest(F.lit(1), F.ceil(F.lit(threshold) * F.col("size") - 1e-9).cast("int"))
    length, needed = F.col("size").cast("int"), whole
    for p, r in rules.items():
        if r:
            length = F.when(F.col("partition") == p, r[0]).otherwise(length)
            needed = F.when(F.col("partition") == p, r[1]).otherwise(needed)
    place = F.row_number().over(Window.partitionBy("item_id").orderBy("hash"))
    ruled = sizes.select("item_id", "size", "partition", length.alias("length"), needed.alias("needed"))
    taken = shingles.select("item_id", "hash").join(ruled, "item_id").withColumn("place", place).filter(F.col("place") <= F.col("length"))
    return taken.select("item_id", "hash", "size", "partition", "needed")


def _met(left: DataFrame, right: DataFrame, key: str, small: bool) -> DataFrame:
    """``left`` (doc_id, key) and ``right`` (key, ...) joined. Where ``right`` is
    too large for a broadcast, rows of a hot key are dealt to PARTS tasks by document."""
    if small:
        return left.join(F.broadcast(right), key)
    dealt = left.withColumn("__part", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)).cast("int"))
    each = right.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    return dealt.join(each, [key, "__part"]).drop("__part")


def _probe(ks: list[int], wanted):
    """Distinct shingle hashes of each text; only those in ``wanted``, if given."""
    schema = pa.schema([("doc_id", pa.int64()), ("hash", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if wanted is not None:
            target = wanted.value
            maybe = np.zeros(1 << 22, bool)
            maybe[(target & np.uint64(len(maybe) - 1)).astype(np.int64)] = True
        for piece in text_pieces(batches, "text"):
            hashes, firsts = word_hashes(*text_buffer(piece.column("text")))
            ids = piece.column("doc_id").to_numpy(zero_copy_only=False)
            for k in ks:
                found, text = shingle_hashes(hashes, firsts, k)
                if wanted is not None:
                    hit = np.flatnonzero(maybe[(found & np.uint64(len(maybe) - 1)).astype(np.int64)])
                    found, text = found[hit], text[hit]
                    hit = np.isin(found, target)
                    found, text = found[hit], text[hit]
                order = np.lexsort((found, text))
                found, text = found[order], text[order]
                new = np.ones(len(found), bool)
                new[1:] = (found[1:] != found[:-1]) | (text[1:] != text[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(ids[text[new]], pa.int64()), pa.array(found[new].view(np.int64))], schema=schema)

    return run


def word_array(text) -> F.Column:
    """Words of a text: lower-cased (A-Z) runs without ASCII white space."""
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_remove(F.split(lower, "[ \\t-\\r]+"), "")


def _shingle_strings(words, k):
    last = F.size(words) - k + 1
    return F.when(last > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(words, i, k), " "))))


def contained_items(docs: DataFrame, items: DataFrame, k: int = 5, threshold: float = 0.8) -> DataFrame:
    """Pairs of a document and a test item that it contains.

    Takes documents (doc_id bigint, text, ...) and items (item_id bigint, text,
    ...). Returns (doc_id, item_id, n_shingles, n_shared, containment) for each
    pair where the document has ``threshold`` or more of the item's distinct
    k-word shingles. An item of fewer words is matched as one sequence. Null or
    wordless texts and rows with a null id match nothing; rows that repeat an id
    count as one with all their shingles. Other columns are ignored.
    """
    spark = docs.sparkSession
    ship_package(spark)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").filter("doc_id IS NOT NULL AND text IS NOT NULL")
    items = items.select(F.col("item_id").cast("bigint").alias("item_id"), "text").filter("item_id IS NOT NULL AND text IS NOT NULL")
    shingles = items.mapInArrow(_hashes(k), "item_id bigint, words int, hash bigint").distinct()
    shingles = materialize(shingles, "shingles")
    ks = sorted(r["words"] for r in shingles.select("words").distinct().collect())
    schema = "doc_id bigint, item_id bigint, n_shingles bigint, n_shared bigint, containment double"
    if not ks:
        return spark.createDataFrame([], schema)
    sketches = materialize(_sketches(shingles, threshold), "sketches")
    hashes = sketches.select("hash").distinct()
    small = hashes.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    wanted = None
    if small:
        wanted = spark.sparkContext.broadcast(np.array([r[0] for r in hashes.collect()], np.int64).view(np.uint64))
    found = docs.mapInArrow(_probe(ks, wanted), "doc_id bigint, hash bigint")
    hits = _met(found, sketches.select("hash", "item_id", "partition", "needed"), "hash", small)
    # repeated rows of a document count a hash again, which only adds candidates
    counts = hits.groupBy("doc_id", "item_id", "partition", "needed").agg(F.count(F.lit(1)).alias("n"))
    candidates = materialize(counts.filter(F.col("n") >= F.col("needed")).select("doc_id", "item_id"), "candidates")

    item_words = items.join(candidates.select("item_id").distinct(), "item_id", "left_semi").select("item_id", word_array(F.col("text")).alias("words"))
    item_words = item_words.withColumn("k", F.least(F.size("words"), F.lit(k)))
    truth = item_words.select("item_id", F.explode(_shingle_strings(F.col("words"), F.col("k"))).alias("shingle")).distinct()
    truth = materialize(truth, "items")
    totals = truth.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_shingles"))
    words = keep_ids(docs, candidates, "doc_id").select("doc_id", word_array(F.col("text")).alias("words"))
    own = words.select("doc_id", F.explode(F.array_distinct(F.flatten(F.array(*[F.coalesce(_shingle_strings(F.col("words"), F.lit(j)), F.array().cast("array<string>")) for j in ks])))).alias("shingle"))
    few = truth.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    shared = _met(own, truth, "shingle", few).groupBy("doc_id", "item_id").agg(F.countDistinct("shingle").alias("n_shared"))
    out = shared.join(candidates, ["doc_id", "item_id"]).join(F.broadcast(totals) if few else totals, "item_id")
    out = out.withColumn("containment", F.col("n_shared") / F.col("n_shingles")).filter(F.col("containment") >= threshold)
    return out.select("doc_id", "item_id", "n_shingles", "n_shared", "containment")

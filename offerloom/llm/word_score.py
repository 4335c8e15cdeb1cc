"""Stupid-backoff scores over words, of order 3 (Brants et al., 2007).

    S(c | a b) = N(abc) / N(ab)       if N(abc) >= MIN_COUNT
               = BACKOFF * S(c | b)   else
    S(c | b)   = N(bc) / N(b)         if N(bc) >= MIN_COUNT
               = BACKOFF * S(c)       else
    S(c)       = N(c) / all words

Words are what ASCII white space parts, as they are written; the first two words
of a document have no more context than there is. N counts all documents.

Documents are dealt into blocks of bounded size; a block explodes its texts into
n-grams and counts them, so an n-gram leaves it once, however hot, and no n-gram
has more rows than there are blocks. N-grams are known by 64-bit hashes; ranges of
these are the partitions of the count table. Two joins on the range follow, each
of a block's sorted hashes (as differences) with those of all other blocks:

1. By the first bits of each hash only: what no other occurrence shares has count
   1, which about half of all n-grams have, and is done with.
2. By the whole hash, for the rest: the corpus counts come back in the order sent.

Scores are summed for each document in its block.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, ship_package, text_buffer
from .shingles import word_hashes

MIN_COUNT = 2
BACKOFF = 0.4
BLOCK_BYTES = 12 << 20
RANGE_BYTES = 8 << 20
#: Bits of a hash in the first join beyond those that number all n-grams: one
#: n-gram in 16 or fewer goes on without need.
SPARE_BITS = 4


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _grams(texts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the n-grams of orders 1, 2 and 3 that end at each word, one
    order after the other, the words of each text, and whether an n-gram lies
    within its text."""
    words, firsts = word_hashes(*text_buffer(texts), lower=False)
    sizes = np.diff(firsts)
    left = np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    grams = np.zeros(3 * len(words), np.uint64)
    one, two, three = grams.reshape(3, -1)
    one[:] = _mix(words)
    two[1:] = _mix(one[:-1] * np.uint64(0x9E3779B97F4A7C15) + one[1:])
    three[2:] = _mix(two[1:-1] * np.uint64(0xD6E8FEB86659FD93) + one[2:])
    return grams, sizes, np.concatenate([left >= 0, left >= 1, left >= 2])


def _new(ordered: np.ndarray) -> np.ndarray:
    """Which of the sorted values differ from the one before."""
    out = np.ones(len(ordered), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=out[1:])
    return out


def _pack(x: np.ndarray) -> bytes:
    """Integers byte by byte, all lowest bytes first, which compresses."""
    planes = x.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()
    return len(planes).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def _unpack(b: bytes) -> np.ndarray:
    planes = pa.decompress(memoryview(b)[8:], int.from_bytes(b[:8], "little"), codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, -1).T).view("<u8").ravel()


def _counted(texts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of a block, sorted, and how often it has each."""
    grams, _, inside = _grams(texts)
    grams = grams[inside]
    grams.sort()
    first = np.flatnonzero(_new(grams))
    return grams[first], np.diff(first, append=len(grams))


def _cuts(grams: np.ndarray, ranges: int) -> list[tuple[int, int, int]]:
    """(range, start, end) of the ranges that sorted n-grams fall in."""
    bounds = np.array([(i << 64) // ranges for i in range(1, ranges)], np.uint64)
    cuts = [0, *np.searchsorted(grams, bounds).tolist(), len(grams)]
    return [(i, s, e) for i, (s, e) in enumerate(zip(cuts, cuts[1:])) if s < e]


def _sent(docs: pa.Table, columns: dict[str, list]) -> pa.Table:
    """Rows of one block for each of the ranges listed."""
    block = docs.column("block")[0].as_py() if docs.num_rows else 0
    types = {"range": pa.int32(), "block": pa.int32()}
    columns |= {"block": [block] * len(columns["range"])}
    return pa.table({c: pa.array(columns[c], types.get(c, pa.binary())) for c in ["range", "block", *sorted(set(columns) - set(types))]})


def _steps(grams: np.ndarray) -> bytes:
    return _pack(np.diff(grams, prepend=np.uint64(0)))


def _sum(b: bytes) -> np.ndarray:
    return np.cumsum(_unpack(b), dtype=np.uint64)


def _bits(again: np.ndarray) -> bytes:
    return len(again).to_bytes(8, "little") + np.packbits(again).tobytes()


def _again(b: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(b, np.uint8, offset=8), count=int.from_bytes(b[:8], "little")).astype(bool)


def _short(ranges: int, bits: int):
    """The first bits of each n-gram, and whether its block has it twice."""

    def send(docs: pa.Table) -> pa.Table:
        grams, n = _counted(docs.column("text"))
        short = (grams >> np.uint64(64 - bits)) << np.uint64(1) | (n > 1).astype(np.uint64)
        used = _cuts(grams, ranges)
        return _sent(docs, {"range": [i for i, *_ in used], "grams": [_steps(short[s:e]) for _, s, e in used]})

    return send


def _shared(table: pa.Table) -> pa.Table:
    """For each block, which of the short n-grams that it sent occur again."""
    sent = list(map(_sum, table.column("grams").to_pylist()))
    every = np.concatenate(sent)
    _, which = np.unique(every >> np.uint64(1), return_inverse=True)
    again = np.bincount(which, weights=1 + (every & np.uint64(1)))[which] > 1
    parts = np.split(again, np.cumsum([len(g) for g in sent])[:-1])
    return pa.table({"range": table.column("range"), "block": table.column("block"), "again": pa.array(map(_bits, parts), pa.binary())})


def _whole(ranges: int):
    """The n-grams that occur again, whole, with the block's own counts."""

    def send(docs: pa.Table, flags: pa.Table) -> pa.Table:
        grams, n = _counted(docs.column("text"))
        known = dict(zip(flags.column("range").to_pylist(), flags.column("again").to_pylist()))
        used = [(i, known[i], grams[s:e], n[s:e]) for i, s, e in _cuts(grams, ranges)]
        masks = [_again(b) for _, b, *_ in used]
        return _sent(docs, {"range": [i for i, *_ in used], "again": [b for _, b, *_ in used], "grams": [_steps(g[m]) for m, (*_, g, _) in zip(masks, used)], "n": [_pack(c[m]) for m, (*_, c) in zip(masks, used)]})

    return send


def _count(table: pa.Table) -> pa.Table:
    """The corpus counts of one range, for each block in the order it sent."""
    sent = list(map(_sum, table.column("grams").to_pylist()))
    n = np.concatenate([_unpack(b) for b in table.column("n").to_pylist()])
    _, which = np.unique(np.concatenate(sent), return_inverse=True)
    # sums of doubles are exact up to 2 ** 53
    totals = np.bincount(which, weights=n).astype(np.uint64)[which]
    parts = np.split(totals, np.cumsum([len(g) for g in sent])[:-1])
    return pa.table({"range": table.column("range"), "block": table.column("block"), "again": table.column("again"), "totals": pa.array(map(_pack, parts), pa.binary())})


def _scorer(min_count: int, backoff: float):
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_single", pa.int64()), ("part", pa.float64())])

    def score(docs: pa.Table, counts: pa.Table) -> pa.Table:
        """Sums of logarithms but for that of the number of all words, which
        n_single words of the document divide by."""
        grams, sizes, inside = _grams(docs.column("text"))
        at = np.cumsum(sizes)
        if not len(grams):
            zero = np.zeros(len(sizes), np.int64)
            return pa.table([docs.column("doc_id"), zero, zero, zero.astype(float)], schema=schema)
        n = np.zeros(len(grams))
        grams = grams[inside]
        order = np.argsort(grams)
        which = np.cumsum(_new(grams[order]), dtype=np.int32) - 1
        del grams
        counts = counts.sort_by("range")
        again = np.concatenate(list(map(_again, counts.column("again").to_pylist())))
        totals = np.ones(len(again))  # what did not come back occurs once
        totals[again] = np.concatenate(list(map(_unpack, counts.column("totals").to_pylist())))
        n[np.flatnonzero(inside)[order]] = totals[which]
        del order, which, totals, again
        one, two, three = n.reshape(3, -1)
        has_two, has_three = inside.reshape(3, -1)[1:]
        by_three = has_three & (three >= min_count)
        by_two = has_two & ~by_three & (two >= min_count)
        single = ~by_three & ~by_two
        each = np.log(np.where(by_three, three, np.where(by_two, two, one)))
        each[1:] -= np.where(by_three[1:], np.log(np.maximum(two[:-1], 1)), np.where(by_two[1:], np.log(one[:-1]), 0))
        each += math.log(backoff) * np.where(by_three, 0, has_three.astype(int) + (single & has_two))
        total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[np.concatenate([[0], at])])
        sums, full = np.zeros(len(sizes)), sizes > 0
        sums[full] = np.add.reduceat(each, (at - sizes)[full])
        return pa.table([docs.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(total(single.astype(np.int64))), pa.array(sums)], schema=schema)

    return score


def word_scores(docs: DataFrame, min_count: int = MIN_COUNT, backoff: float = BACKOFF, block_bytes: int = BLOCK_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Score each document by a model of the words of all of them.

    Takes (doc_id bigint, text, ...) and returns (doc_id, n_words, log_score,
    mean_log_score), one row for each row: the sum of the natural logarithms of
    the scores of all words, and their mean. A text without words has sum 0 and
    a null mean. Rows that repeat count each. Other columns are ignored.
    """
    ship_package(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = docs.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    blocks, ranges = max(1, math.ceil(total / block_bytes)), max(1, math.ceil(total / range_bytes))
    bits = min(62, max(8, (3 * total).bit_length() + SPARE_BITS))
    # rows are dealt by place, so that equal rows don't share a block
    dealt = docs.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)).cast("int")).repartition(blocks, "block")
    short = dealt.groupBy("block").applyInArrow(_short(ranges, bits), "range int, block int, grams binary")
    flags = short.groupBy("range").applyInArrow(_shared, "range int, block int, again binary")
    whole = dealt.groupBy("block").cogroup(flags.groupBy("block")).applyInArrow(_whole(ranges), "range int, block int, again binary, grams binary, n binary")
    counts = whole.groupBy("range").applyInArrow(_count, "range int, block int, again binary, totals binary")
    scored = dealt.groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(_scorer(min_count, backoff), "doc_id bigint, n_words bigint, n_single bigint, part double")
    scored = materialize(scored, "word-scores")
    words = scored.agg(F.sum("n_words")).first()[0] or 1
    scored = scored.select("doc_id", "n_words", (F.col("part") - F.col("n_single") * math.log(max(1, words))).alias("log_score"))
    return scored.withColumn("mean_log_score", F.try_divide("log_score", "n_words"))

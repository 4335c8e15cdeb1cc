"""A result cache with a time to live, over tables of requests.

A request hits while now <= expiry; a miss with results stores them, and hits
do not extend them. So the stored requests of a key are a chain: from each the
next is the first one with results after its expiry. All requests are put in one
order, by key and then time, and what must be known of a request is how many
others come before some moment: that is a difference of places in two orders.
The chain is followed by pointer doubling. No step looks at a key as a whole, so
one key may have any share of the requests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import trim_ws
from ..tables import numbered, written


def cache_key(source: Column, query: Column) -> Column:
    return F.concat_ws(":", source, F.lower(trim_ws(query)))


def _successors(some: DataFrame, ttl_ms: int) -> DataFrame:
    """(i, next) of requests (i, key, at_ms) numbered in order: the first after
    the expiry, if it is of the same key.

    Expiries have the order of the requests, so before the expiry of request i
    there are i others, and all else that is before it are requests.
    """
    asked = some.select("key", F.col("at_ms").alias("t"), F.lit(0).alias("late"), "i")
    expiry = some.select("key", (F.col("at_ms") + ttl_ms).alias("t"), F.lit(1).alias("late"), "i")
    placed = numbered(asked.union(expiry), ["key", "t", "late", "i"], "place").filter("late = 1")
    after = placed.select("i", "key", (F.col("place") - F.col("i")).alias("next"))
    own = some.select(F.col("i").alias("next"), F.col("key").alias("__key"))
    return after.join(own, "next").filter(F.col("key").eqNullSafe(F.col("__key"))).select("i", "next")


def _reached(first: DataFrame, successors: DataFrame) -> DataFrame:
    """What can be reached from ``first`` (i) along ``successors`` (i, next), in a
    number of rounds that is logarithmic in the length of the longest chain."""
    reached, jump = written(first, "reached"), written(successors, "jump")
    n = reached.count()
    while True:
        # chains of different keys never meet, and jumps of one length never end at one place
        reached = written(reached.union(reached.join(jump, "i").select(F.col("next").alias("i"))), "reached")
        more = reached.count()
        if more == n:
            return reached
        n = more
        again = jump.select(F.col("i").alias("next"), F.col("next").alias("then"))
        jump = written(jump.join(again, "next").select("i", F.col("then").alias("next")), "jump")


def cache_hits(requests: DataFrame, ttl_ms: int) -> DataFrame:
    """(key, at_ms, seq, hit) of requests (key, at_ms bigint, seq, n_results).

    Requests of a key are taken by time, then ``seq``, then number of results.
    Requests with a null key share one; a null time comes first, is a miss and
    stores nothing, and null results are none.
    """
    asked = requests.select("key", "at_ms", "seq", "n_results")
    asked = written(numbered(asked, ["key", "at_ms", "seq", "n_results"], "rank"), "requests")
    full = numbered(asked.filter("n_results > 0 AND at_ms IS NOT NULL").select("key", "at_ms", "rank"), ["rank"], "i")
    full = written(full, "full")
    first = full.groupBy("key").agg(F.min("i").alias("i")).select("i")
    stored = full.join(_reached(first, _successors(full, ttl_ms)), "i")

    # A stored entry opens behind its request and closes behind its last moment.
    # Entries of a key don't overlap, so a request hits if what opened or closed
    # before it is an odd number.
    last = F.lit(2**63 - 1)
    every = asked.select("key", F.col("at_ms").alias("t"), "rank", F.lit(0).alias("late"), "at_ms", "seq")
    none = [F.lit(None).cast("bigint").alias("at_ms"), F.lit(None).cast(asked.schema["seq"].dataType).alias("seq")]
    opened = stored.select("key", F.col("at_ms").alias("t"), "rank", F.lit(1).alias("late"), *none)
    closed = stored.select("key", (F.col("at_ms") + ttl_ms).alias("t"), last.alias("rank"), F.lit(2).alias("late"), *none)
    placed = numbered(every.union(opened).union(closed), ["key", "t", "rank", "late"], "place").filter("late = 0")
    return placed.select("key", "at_ms", "seq", ((F.col("place") - F.col("rank")) % 2 == 1).alias("hit"))


def lru_kept(requests: DataFrame, most: int = 500) -> DataFrame:
    """Keys that a cache of ``most`` entries still holds: those asked last."""
    return requests.groupBy("key").agg(F.max(F.struct("at_ms", "seq")).alias("last")).orderBy(F.desc("last")).limit(most)

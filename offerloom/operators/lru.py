"""A result cache of bounded size with a time to live, over tables of requests.

Each request puts its key in front, whether it hits or must store anew, and the
key that was asked longest ago gives way. So what is held are the keys asked
last, expired or not, and a request finds its key held if fewer than ``most``
others were asked since its last time. Requests are put in one order and cut
into ranges; what is held at the start of a range is merged from the keys that
earlier ranges saw last, never more than ``most`` for each, so a range is
replayed by itself. A request whose key is gone begins a chain of its own, and
the time to live is that of ``cache_hits`` over chains instead of keys.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..tables import numbered, written
from .cache import cache_hits

#: Entries and time to live of the archived search.
MOST, TTL_MS = 500, 20 * 60 * 1000
#: Requests of one range: the most that a task replays.
RANGE = 100_000


def _seen_last(seen: DataFrame, most: int) -> DataFrame:
    """(part, slot, place): of each range the ``most`` keys with the last places."""
    last = seen.groupBy("part", "slot").agg(F.max("place").alias("place"))
    nth = F.row_number().over(Window.partitionBy("part").orderBy(F.desc("place")))
    return last.withColumn("nth", nth).filter(F.col("nth") <= most).drop("nth")


def _held(asked: DataFrame, most: int) -> DataFrame:
    """(part, slot, place): what is held when a range begins.

    A range takes what the one before it saw; each round doubles how many
    ranges that covers, until all have enough keys or begin at the first request.
    """
    ranges = asked.agg(F.max("part")).first()[0] or 0
    before = lambda df, step: df.withColumn("part", F.col("part") + step).filter(F.col("part") <= ranges)
    held, covered = written(before(_seen_last(asked, most), 1), "held"), 1
    while covered < ranges:
        short = held.groupBy("part").agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") < most) & (F.col("part") > covered))
        if short.isEmpty():
            break
        held = written(_seen_last(held.unionByName(before(held, covered)), most), "held")
        covered *= 2
    return held


def _replay(most: int):  # noqa: ANN202
    def replay(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        # a dict keeps the order in which keys were put in
        now = dict.fromkeys(held.sort_values("place")["slot"])
        asked = asked.sort_values("place")
        found = []
        for slot in asked["slot"]:
            found.append(slot in now)
            now.pop(slot, None)
            now[slot] = None
            if len(now) > most:
                del now[next(iter(now))]
        return pd.DataFrame({"place": asked["place"], "slot": asked["slot"], "found": found})

    return replay


def lru_hits(requests: DataFrame, most: int = MOST, ttl_ms: int = TTL_MS, size: int = RANGE) -> DataFrame:
    """(key, at_ms, seq, hit) of requests (key, at_ms bigint, seq).

    Requests are taken by time, then ``seq``, then key. A request hits if its key
    is held and at most ``ttl_ms`` have passed since its results were stored; hits
    make it last longer among the others but not in time. Requests with a null
    key share one; one without a time is a miss that the cache does not see.
    Other columns are left out. ``size`` bounds the requests of one range.
    """
    if most < 1:
        raise ValueError("a cache holds at least one entry")
    known = requests.select("key", "at_ms", "seq")
    slot = F.coalesce(F.concat(F.lit("="), F.col("key").cast("string")), F.lit(""))
    placed = numbered(known.filter("at_ms IS NOT NULL").withColumn("slot", slot), ["at_ms", "seq", "slot"], "place")
    asked = written(placed.withColumn("part", F.floor(F.col("place") / size).cast("bigint")), "asked")

    mine = asked.select("part", "slot", "place").groupBy("part")
    replayed = mine.cogroup(_held(asked, most).groupBy("part")).applyInPandas(_replay(most), "place bigint, slot string, found boolean")
    replayed = written(replayed, "replayed")

    # A chain's number is how many began up to a request, in order of key and
    # place: the difference of its places with and without their beginnings.
    ranks = numbered(replayed.select("slot", "place"), ["slot", "place"], "rank")
    every = ranks.select("slot", "place", "rank", F.lit(1).alias("late"))
    begun = replayed.filter("NOT found").select("slot", "place", F.lit(None).cast("bigint").alias("rank"), F.lit(0).alias("late"))
    chains = numbered(every.union(begun), ["slot", "place", "late"], "n").filter("late = 1")
    chains = chains.select("place", (F.col("n") - F.col("rank")).alias("key"))

    timed = asked.select("place", "at_ms").join(chains, "place")
    hits = cache_hits(timed.select("key", "at_ms", F.col("place").alias("seq"), F.lit(1).alias("n_results")), ttl_ms)
    answered = asked.join(hits.select(F.col("seq").alias("place"), "hit"), "place").select("key", "at_ms", "seq", "hit")
    return answered.union(known.filter("at_ms IS NULL").withColumn("hit", F.lit(False)))

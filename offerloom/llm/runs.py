"""Periodic runs of words in texts.

A run is a stretch of consecutive words with smallest period q, at least
``power`` periods long, that cannot be made longer. For each text:

1. Words that occur fewer than ``power`` times in a stretch cannot be part of a
   run in it, since a run holds each of its words that often. The text is cut
   at them, again and again until nothing changes; what is left is exact and,
   in prose, next to nothing.
2. A suffix automaton is built of each stretch. Its states are taken from the
   longest to the shortest, and the ordered end positions of each are merged
   into those of its suffix link, the smaller set into the larger.
3. Where two positions become neighbours by a merge at a state of length L, the
   L words up to either are the same and no more than those. If (power - 1)
   times their distance d is at most L, the pair is part of a run of period d
   that begins at the first of those words; of all pairs with that beginning
   and period, the last end is the run's. Neighbours in the state's final set
   have no smaller period between them, so d is the smallest.

No text leaves its task, and there is no shuffle: a text is one unit of work.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship_package, text_pieces

_SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: Bytes of a text whose words are in memory at a time.
BLOCK = 1 << 20

RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def _blocks(data: bytes) -> Iterator[list[bytes]]:
    at = 0
    while at < len(data):
        found = _SPACE.search(data, at + BLOCK) if at + BLOCK < len(data) else None
        end = found.start() if found else len(data)
        yield data[at:end].split()
        at = end


def _link_tree(ids: list[int]) -> tuple[list[int], list[int], list[int]]:
    """(length, suffix link, end position or -1) of the automaton's states."""
    length, link, end, after = [0], [-1], [-1], [{}]
    last = 0
    for i, word in enumerate(ids):
        new = len(length)
        length.append(i + 1)
        link.append(0)
        end.append(i)
        after.append({})
        p = last
        while p >= 0 and word not in after[p]:
            after[p][word] = new
            p = link[p]
        if p >= 0:
            q = after[p][word]
            if length[q] > length[p] + 1:
                copy = len(length)
                length.append(length[p] + 1)
                link.append(link[q])
                end.append(-1)
                after.append(dict(after[q]))
                while p >= 0 and after[p].get(word) == q:
                    after[p][word] = copy
                    p = link[p]
                link[q], q = copy, copy
            link[new] = q
        last = new
    return length, link, end


def _merge(large: list[int], small: list[int], most: int, pairs: list[tuple[int, int]]) -> None:
    """Insert ``small`` into ``large``, both ascending; ``pairs`` gets neighbours
    of which one is from either and that are at most ``most`` apart."""
    before, held = -1, None
    for x in small:
        if held and x > held[1]:
            pairs.append(held)
        held = None
        at = bisect_left(large, x)
        if at and large[at - 1] != before and x - large[at - 1] <= most:
            pairs.append((large[at - 1], x))
        if at < len(large) and large[at] - x <= most:
            held = (x, large[at])
        large.insert(at, x)
        before = x
    if held:
        pairs.append(held)


def _stretch_runs(ids: list[int], power: int) -> dict[tuple[int, int], int]:
    """(start, period) -> last end, of one stretch."""
    n, few = len(ids), power - 1
    length, link, end = _link_tree(ids)
    # places count from the end of the stretch: what is merged in last is mostly the longest way off
    places = [[n - 1 - e] if e >= 0 else [] for e in end]
    pairs: dict[int, list[tuple[int, int]]] = {}
    runs: dict[tuple[int, int], int] = {}
    for v in np.argsort(-np.array(length), kind="stable").tolist():
        size, mine, up = length[v], places[v], link[v]
        if size < few:
            break
        for lo, hi in pairs.pop(v, ()):
            # later merges may have come between
            if mine[bisect_left(mine, lo) + 1] == hi:
                last = n - 1 - lo
                key = (n - 1 - hi - size + 1, hi - lo)
                runs[key] = max(last, runs.get(key, -1))
        if length[up] >= few:
            other = places[up]
            if len(mine) > len(other):
                mine, other = other, mine
            found: list[tuple[int, int]] = []
            _merge(other, mine, length[up] // few, found)
            if found:
                pairs.setdefault(up, []).extend(found)
            places[up] = other
        places[v] = None
    return runs


def _stretches(ids: np.ndarray, power: int, least: int) -> Iterator[tuple[int, int]]:
    """(start, end) of what is left when the text is cut at words that are too few."""
    todo, first = [(0, len(ids))], True
    while todo:
        s, e = todo.pop()
        keep = ids[s:e] >= 0
        if not first:
            _, place, count = np.unique(ids[s:e], return_inverse=True, return_counts=True)
            keep = count[place] >= power
        if keep.all() and not first:
            yield s, e
            continue
        first = False
        edge = np.diff(np.concatenate([[0], keep.view(np.int8), [0]]))
        for lo, hi in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()):
            if hi - lo >= least:
                todo.append((s + lo, s + hi))


def text_runs(data: bytes, power: int = 4, least: int = 6) -> tuple[int, list[tuple[int, int, int]], bytes]:
    """(number of words, runs (start, length, period) in order, collapsed text)."""
    least = max(least, power)
    counts: Counter = Counter()
    for words in _blocks(data):
        counts.update(words)
    n = counts.total()
    often = {w: i for i, w in enumerate(w for w, c in counts.items() if c >= power)}
    del counts
    runs: list[tuple[int, int, int]] = []
    if often and n >= least:
        ids = np.concatenate([np.array(list(map(often.get, words, repeat(-1))), np.int32) for words in _blocks(data)])
        for s, e in _stretches(ids, power, least):
            for (start, period), last in _stretch_runs(ids[s:e].tolist(), power).items():
                if last - start + 1 >= max(least, power * period):
                    runs.append((s + start, last - start + 1, period))
    if not runs:
        return n, runs, b" ".join(b" ".join(words) for words in _blocks(data) if words)
    runs.sort(key=lambda r: (r[0], r[2]))
    dropped = np.zeros(n, bool)
    for start, size, period in runs:
        dropped[start + period : start + size] = True
    kept, at = [], 0
    for words in _blocks(data):
        gone = dropped[at : at + len(words)].tolist()
        kept.append(b" ".join(w for w, d in zip(words, gone) if not d))
        at += len(words)
    return n, runs, b" ".join(k for k in kept if k)


def periodic_runs(docs: DataFrame, power: int = 4, least: int = 6) -> DataFrame:
    """Runs of words in each text, and the text with their repetitions taken out.

    Takes (doc_id bigint, text string, ...) and returns (doc_id, n_words, runs,
    collapsed), one row for each row. Words are runs of characters that are no
    ASCII white space. ``runs`` is an array of (start, length, period), by start
    and then period: the stretches with smallest period q and a length of at
    least ``least`` and ``power`` * q that no neighbouring word extends.
    ``collapsed`` has the words that no run holds after its first q, joined by
    one space.

    A null or wordless text has no runs and an empty ``collapsed``. Rows that
    repeat an id or a text are taken one by one; a null id stays null; other
    columns are ignored. A text is read in blocks of 1 MB; what is held of it
    whole is 5 bytes for each word, its distinct words, and, for each stretch
    that step 1 leaves, some 0.6 KB for each of the stretch's words.
    """
    if power < 2:
        raise ValueError("a run has two periods at least")
    ship_package(docs.sparkSession)
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(run)), ("collapsed", pa.string())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in text_pieces(batches, "text"):
            counts, found, texts = [], [], []
            for data in piece.column("text").cast(pa.large_binary()):
                n, runs, collapsed = text_runs(data.as_py() or b"", power, least)
                counts.append(n)
                found.append([{"start": s, "length": k, "period": q} for s, k, q in runs])
                texts.append(collapsed)
            text = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(counts, pa.int64()), pa.array(found, schema.field("runs").type), text], schema=schema)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text"))
    return rows.mapInArrow(work, f"doc_id bigint, n_words bigint, runs {RUNS}, collapsed string")


def strongest(runs: Column) -> Column:
    """The run with the most periods, exactly; ties: smallest start, then period."""
    more = lambda a, b: a["length"] * b["period"] > b["length"] * a["period"]
    # they come by start and then period, so the first of equals stays
    better = lambda best, r: F.when(best.isNull() | more(r, best), r).otherwise(best)
    return F.aggregate(runs, F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>"), better)


def with_planted_period(docs: DataFrame) -> DataFrame:
    """(doc_id, text) in which every tenth text, by the CRC of its id, ends periodically."""
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    h = F.crc32(F.col("doc_id").cast("string"))
    some = docs.select("doc_id", "text").withColumns({"__h": h, "__w": F.when((h % 10 == 0) & F.col("text").rlike(r"[^\x20\x09-\x0D]"), words)})
    n, g = F.size("__w").cast("bigint"), F.floor(F.col("__h") / 10)
    some = some.withColumns({"__a": g % n, "__p": 1 + F.floor((n - g % n) / (3 + g % 8))})
    at = lambda i: F.when(i < F.col("__a"), i).otherwise(F.col("__a") + (i - F.col("__a")) % F.col("__p"))
    new = F.array_join(F.transform(F.sequence(F.lit(0).cast("bigint"), n - 1), lambda i: F.get("__w", at(i).cast("int"))), " ")
    return some.withColumn("text", F.when(F.col("__w").isNotNull(), new).otherwise(F.col("text"))).drop("__h", "__w", "__a", "__p")

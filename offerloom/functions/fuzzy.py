"""Approximate search of a pattern in a short text, by bits (Baeza-Yates and
Gonnet 1992; Wu and Manber 1992), scored by errors and by distance from where
the match is expected, as the fuzzy library of browsers defines it.

A search with i errors looks only where such a match could still be as good as
the best one so far. Its score is that of the last match seen, which need not be
the best one; this is kept, since results must equal the library's. Texts are
normalised before, so they are ASCII and their code points are JavaScript's units.

All distinct pairs of an Arrow batch are searched at once: a step is one error
count and one column of the text, over every pair. No more of a text is held
than a match within the threshold can touch, about 160 characters a chunk.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Of the library, and the threshold that is asked of it.
THRESHOLD = 0.6
DISTANCE = 100
CHUNK = 32
LEAST_SCORE = 0.001
NORM_DIGITS = 3

#: No match within the threshold is further than this from its place.
REACH = int(THRESHOLD * DISTANCE)


def chunks(pattern: str) -> list[tuple[int, str]]:
    """(place, part) of a pattern; the last part is whole and may overlap the one before."""
    if len(pattern) <= CHUNK:
        return [(0, pattern)] if pattern else []
    whole = range(0, len(pattern) - len(pattern) % CHUNK, CHUNK)
    tail = [len(pattern) - CHUNK] if len(pattern) % CHUNK else []
    return [(at, pattern[at : at + CHUNK]) for at in [*whole, *tail]]


def _codes(texts: list[str], width: int) -> np.ndarray:
    """Code points, one text a column, -1 past the end."""
    out = np.full((width, len(texts)), -1, np.int32)
    for i, t in enumerate(texts):
        out[: len(t), i] = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
    return out


def _search(texts: list[str], parts: list[str], places: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(found, score) of each part searched in its text near its place."""
    n, size = np.array([len(t) for t in texts]), np.array([len(p) for p in parts])
    expected = np.minimum(places, n)
    base = np.maximum(0, expected - REACH - 1)
    width = REACH * 2 + CHUNK + 1
    near = _codes([t[b : b + width] for t, b in zip(texts, base)], width)
    pattern = _codes(parts, CHUNK)
    same = np.zeros((width, len(texts)), np.int64)
    for k in range(int(size.max())):
        inside = k < size
        same |= np.where((near == pattern[k]) & inside, np.int64(1) << np.where(inside, size - 1 - k, 0), 0)
    top, keep = np.int64(1) << (size - 1), (np.int64(1) << size) - 1

    exact = np.array([t.find(p, e) for t, p, e in zip(texts, parts, expected)])
    limit = np.where(exact >= 0, np.minimum((exact - expected) / DISTANCE, THRESHOLD), THRESHOLD)
    best, score = np.full(len(texts), -1), np.ones(len(texts))
    reach, alive = size + n, np.ones(len(texts), bool)
    steps = np.arange(DISTANCE + 1)[:, None] / DISTANCE
    before = np.zeros((width + 2, len(texts)), np.int64)
    for errors in range(int(size.max())):
        alive &= errors < size
        cost = errors / size
        alive &= cost <= limit
        if not alive.any():
            break
        reach = np.where(alive, np.minimum(reach, np.maximum(0, (cost + steps <= limit).sum(axis=0) - 1)), reach)
        first = np.maximum(1, expected - reach + 1) - base
        last = np.minimum(expected + reach, n) + size - base
        bits = np.zeros_like(before)
        bits[last + 1, np.arange(len(texts))] = (1 << errors) - 1
        going = alive.copy()
        for j in range(int(last[alive].max()), 0, -1):
            # a match may move the left end either way
            open_ = going & (first <= j)
            if not open_.any():
                break
            here = open_ & (j <= last)
            now = ((bits[j + 1] << 1) | 1) & same[j - 1]
            if errors:
                now |= ((before[j + 1] | before[j]) << 1) | 1 | before[j + 1]
            now &= keep
            bits[j] = np.where(here, now, bits[j])
            hit = here & ((now & top) != 0)
            if not hit.any():
                continue
            at = j - 1 + base
            score = np.where(hit, cost + np.abs(expected - at) / DISTANCE, score)
            better = hit & (score <= limit)
            limit, best = np.where(better, score, limit), np.where(better, at, best)
            going &= ~(better & (at <= expected))
            first = np.where(better & going, np.maximum(1, 2 * expected - at) - base, first)
        before = bits
    return best >= 0, np.maximum(LEAST_SCORE, score)


def similarities(pairs: list[tuple[str, str]]) -> list[float]:
    """1 - score of the pattern (second) in the text (first), 0 where it isn't found.

    Scores of a pattern's chunks are averaged; a score is raised to a power that
    falls with the number of words. Blank texts and empty patterns give 0.
    """
    out, asked = [0.0] * len(pairs), []
    for i, (text, pattern) in enumerate(pairs):
        if text.strip() and text == pattern:
            out[i] = 1.0
        elif text.strip():
            asked += [(i, text, part, at) for at, part in chunks(pattern)]
    if not asked:
        return out
    found, scores = _search([a[1] for a in asked], [a[2] for a in asked], [a[3] for a in asked])
    sums: dict[int, list] = {}
    for (i, *_), f, s in zip(asked, found.tolist(), scores.tolist()):
        own = sums.setdefault(i, [False, 0.0, 0])
        sums[i] = [own[0] or f, own[1] + s, own[2] + 1]
    for i, (any_found, total, n) in sums.items():
        if any_found:
            words = len([w for w in pairs[i][0].split(" ") if w])
            scale = 10**NORM_DIGITS
            out[i] = 1.0 - math.pow(total / n, math.floor(scale / math.sqrt(words) + 0.5) / scale)
    return out


#: Pairs searched at once, which bounds the arrays of a step.
AT_ONCE = 2000


@F.arrow_udf(DoubleType())
def similarity(texts: pa.Array, patterns: pa.Array) -> pa.Array:
    """``similarities`` of two columns of normalised texts; null counts as empty."""
    pairs = [(t or "", p or "") for t, p in zip(texts.to_pylist(), patterns.to_pylist())]
    distinct = list(dict.fromkeys(pairs))
    known: dict[tuple[str, str], float] = {}
    for k in range(0, len(distinct), AT_ONCE):
        part = distinct[k : k + AT_ONCE]
        known.update(zip(part, similarities(part)))
    return pa.array([known[p] for p in pairs], pa.float64())

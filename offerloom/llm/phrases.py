"""Prefix-free parsing of byte strings into overlapping phrases.

Each SPAN-byte string of a text belongs to a trigger: the place in it where the
rolling hash of K bytes is smallest (the leftmost, on ties). Equal strings have
it at the same offset, so where to look for a string's equals depends on its
bytes alone. Strings with one trigger are neighbours; the bytes that they cover
are a phrase, and the phrases of a text overlap, as in prefix-free parsing.
"""

from __future__ import annotations

import numpy as np

from .shingles import mix

K = 64

_RNG = np.random.default_rng(1977)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = int(_RNG.integers(1, 2**63, dtype=np.uint64)) | 1
_INVERSE = pow(_BASE, -1, 2**64)
_tables: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    if base not in _tables or len(_tables[base]) < n:
        out = np.full(max(n, 1 << 16), np.uint64(base))
        out[0] = 1
        with np.errstate(over="ignore"):
            _tables[base] = np.multiply.accumulate(out)
    return _tables[base][:n]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Polynomial prefix sums modulo 2**64, for substring_hashes()."""
    out = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(_BYTE[data] * _powers(_BASE, len(data)), out=out[1:])
    return out


def substring_hashes(sums: np.ndarray, starts: np.ndarray, sizes) -> np.ndarray:
    """64-bit hash of each substring, the same wherever it lies."""
    sizes = np.asarray(sizes)
    with np.errstate(over="ignore"):
        return mix((sums[starts + sizes] - sums[starts]) * _powers(_INVERSE, len(sums))[starts] + sizes.astype(np.uint64), 31)


def _sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while done < width:
        step = min(done, width - done)
        x = np.minimum(x[:-step], x[step:])
        done += step
    return x


def phrases(data: np.ndarray, offsets: np.ndarray, span: int) -> tuple[np.ndarray, ...]:
    """(text, first, last, trigger, trigger's hash, phrase's hash) of each phrase.

    ``first`` and ``last`` are the starts of its first and last string, and like
    ``trigger`` relative to the text. Texts shorter than ``span`` have none.
    """
    empty = np.zeros(0, np.int64)
    if len(data) < span:
        return empty, empty, empty, empty, empty.view(np.uint64), empty.view(np.uint64)
    sums = prefix_sums(data)
    n = len(data) - K + 1
    with np.errstate(over="ignore"):
        h = (sums[K:] - sums[:-K]) * _powers(_INVERSE, n) * np.uint64(0x9E3779B97F4A7C15)
    low = _sliding_minimum((h & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64), span - K + 1)
    at = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    inside = np.zeros(len(data) + 1, np.int32)  # marks the starts whose string ends in their text
    sizes = np.diff(offsets)
    some = sizes >= span
    np.add.at(inside, offsets[:-1][some], 1)
    np.add.at(inside, offsets[1:][some] - span + 1, -1)
    starts = np.flatnonzero(np.cumsum(inside)[: len(at)])
    at = at[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)
    head = np.flatnonzero(new)
    first, last, trigger = starts[head], starts[np.append(head[1:], len(starts)) - 1], at[head]
    text = np.searchsorted(offsets, first, side="right") - 1
    code = substring_hashes(sums, trigger, K)
    whole = mix(substring_hashes(sums, first, last - first + span) ^ (trigger - first).astype(np.uint64), 32)
    base = offsets[text]
    return text, first - base, last - base, trigger - base, code, whole

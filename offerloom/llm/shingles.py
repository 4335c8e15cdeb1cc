"""Word shingles as 64-bit hashes, for a whole batch of texts at a time."""

from __future__ import annotations

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes, then words, of a long text that are read at a time.
BLOCK, WORDS = 1 << 20, 1 << 18

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = int(_RNG.integers(1, 2**63, dtype=np.uint64)) | 1
_PLACE = _RNG.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
_POWERS = np.ones(1, np.uint64)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """Finaliser of splitmix64."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        out = np.empty(max(n, 4096), np.uint64)
        out[0] = 1
        with np.errstate(over="ignore"):
            out[1:] = np.uint64(_BASE)
            out = np.multiply.accumulate(out)
        if n > 1 << 20:
            return out
        _POWERS = out
    return _POWERS


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, index of the first word of each text plus the end).

    Bytes that ``space`` marks part words. A long text is read in blocks, cut
    between words, so that what is held beside the hashes is bounded.
    """
    if len(offsets) == 2 and len(data) > 2 * BLOCK:
        out, at = [], 0
        while at < len(data):
            end = min(at + BLOCK, len(data))
            while end < len(data) and not space[data[end]]:
                past = np.flatnonzero(space[data[end : end + BLOCK]])
                end = end + int(past[0]) if len(past) else min(end + BLOCK, len(data))
            out.append(word_hashes(data[at:end], np.array([0, end - at]), lower, space)[0])
            at = end
        hashes = np.concatenate(out)
        return hashes, np.array([0, len(hashes)])
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = ~space[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = offsets[:-1][offsets[:-1] < n]
    begins[first] = inside[first]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    at = np.flatnonzero(inside)
    size = np.diff(np.append(np.searchsorted(at, starts), len(at)))
    place = np.arange(len(at), dtype=np.int64) - np.repeat(np.cumsum(size) - size, size)
    letters = data[at]
    with np.errstate(over="ignore"):
        value = _BYTE[LOWER[letters] if lower else letters] * _powers(int(size.max()))[place]
        hashes = np.add.reduceat(value, np.cumsum(size) - size)
        hashes = mix(hashes + size.astype(np.uint64))
    return hashes, np.searchsorted(starts, offsets)


def shingle_hashes(words: np.ndarray, firsts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each run of k words, text it is in), in order of position.

    A text with fewer than k words, but some, gives its whole sequence as one.
    """
    if len(firsts) == 2 and len(words) > 2 * WORDS:
        parts = range(0, len(words) - k + 1, WORDS)
        hashes = np.empty(len(words) - k + 1, np.uint64)
        for s in parts:
            part = words[s : s + WORDS + k - 1]
            hashes[s : s + WORDS] = shingle_hashes(part, np.array([0, len(part)]), k)[0]
        return hashes, np.zeros(len(hashes), np.uint8)
    counts = np.diff(firsts)
    n = len(words)
    text = np.repeat(np.arange(len(counts)), counts)
    with np.errstate(over="ignore"):
        total = np.zeros(n, np.uint64)
        left = firsts[1:][text] - np.arange(n) if n else np.zeros(0, np.int64)
        for j in range(k):
            rest = words[j:] * _PLACE[j]
            total[: n - j] += np.where(left[: n - j] > j, rest, np.uint64(0))
        length = np.minimum(left, k).astype(np.uint64)
        hashes = mix(total + length * _PLACE[63], 7)
    full = (left >= k) | ((counts[text] < k) & (left == counts[text])) if n else np.zeros(0, bool)
    return hashes[full], text[full]


def distinct_shingles(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of each text in turn, their offsets)."""
    hashes, text = shingle_hashes(*word_hashes(data, offsets), k)
    if len(offsets) == 2:
        hashes.sort()
        if len(hashes):
            hashes = hashes[np.concatenate([[True], hashes[1:] != hashes[:-1]])]
        return hashes, np.array([0, len(hashes)])
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    hashes, text = hashes[new], text[new]
    return hashes, np.searchsorted(text, np.arange(len(offsets)))

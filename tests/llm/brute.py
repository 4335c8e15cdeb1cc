"""Plain versions of the operators for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def sha(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


def lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def words(text: str | None, low: bool = True) -> list[str]:
    text = text or ""
    return [w for w in SPACE.split(lower(text) if low else text) if w]


def shingles(text: str | None, k: int) -> set[tuple[str, ...]]:
    w = words(text)
    if not w:
        return set()
    k = min(k, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def contained(docs, items, k: int, threshold: float) -> set[tuple]:
    out = set()
    for item, text in items:
        want = shingles(text, k)
        for doc, body in docs:
            w = words(body)
            size = min(k, len(words(text)))
            have = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}
            if want and len(want & have) / len(want) >= threshold:
                out.add((doc, item, len(want), len(want & have)))
    return out


def components(texts: dict[int, str | None], k: int, percent: int) -> dict[int, tuple[int, int]]:
    """doc_id -> (set size, smallest id reachable)."""
    sets = {d: shingles(t, k) for d, t in texts.items()}
    up = {d: d for d in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    return {d: (len(sets[d]), top(d)) for d in ids}


def statistics(text: str | None) -> dict[str, int]:
    w = words(text, low=False)
    seen, dup, joined, lines = set(), 0, "".join(w), 0
    for line in (text or "").split("\n"):
        if words(line):
            lines += 1
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {i + j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(8)}
    return {"n_words": len(w), "word_chars": len(joined), "n_symbols": sum(c in "#*$%&|<>" for c in joined), "n_capitals": sum("A" <= c <= "Z" for c in joined), "n_lines": lines, "n_dup_lines": dup, "n_repeat_words": len(covered)}


def base_failed(s: dict[str, int]) -> bool:
    return s["n_words"] < 20 or 100 * s["n_repeat_words"] > 30 * s["n_words"]


def binomial_tail(n: int, k: int, p: float) -> float:
    return sum(math.comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1))


def repeats(texts: list[str | None], span: int) -> list[tuple[int, int, int, str]]:
    data = [(t or "").encode() for t in texts]
    counts = Counter(d[i : i + span] for d in data for i in range(len(d) - span + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - span + 1):
            if counts[d[i : i + span]] > 1:
                gone[i : i + span] = b"\1" * span
        runs = len(re.findall(b"\x01+", bytes(gone)))
        out.append((len(d), sum(gone), runs, sha(bytes(b for b, g in zip(d, gone) if not g))))
    return out


BASE = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 8),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 32),
}


def base_secrets(text: str | None) -> tuple[dict[str, int], str]:
    counts, spans = {}, []
    for rank, (kind, (pattern, group, least)) in enumerate(BASE.items()):
        found = [m.span() for m in pattern.finditer(text or "") if len(m[group]) >= least]
        counts[kind] = len(found)
        spans += [(s, rank, e, kind) for s, e in found]
    return counts, sha(",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(spans)).encode())


def linked_secrets(text: str | None, weak: dict[str, str], role: dict[str, str], scope: int) -> str:
    """Strong spans, and the weak ones that complete others, told as text."""
    text, order = text or "", [*BASE, *weak]
    strong = {(m.start(), order.index(k), m.end()) for k, (p, group, least) in BASE.items() for m in p.finditer(text) if len(m[group]) >= least}
    other = {(m.start(), order.index(k), m.end()) for k, p in weak.items() for m in re.finditer(p, text, re.ASCII)}
    told = set(strong)
    for s, rank, e in other:
        if any(a < e and s < b for a, _, b in strong):
            continue
        own = role[order[rank]]
        beside = {role[order[r]] for a, r, b in strong | other if a <= e + scope and b >= s - scope} - {own}
        if {"id": "secret" in beside, "secret": bool(beside & {"id", "endpoint"}), "endpoint": beside >= {"id", "secret"}}[own]:
            told.add((s, rank, e))
    return ",".join(f"{order[r]}:{s}:{e}" for s, r, e in sorted(told))


def redacted(text: str | None, spans: str, marker: str) -> str | None:
    out, at = [], 0
    for span in filter(None, spans.split(",")):
        s, e = map(int, span.split(":")[1:])
        if s >= at:
            out += [text[at:s], marker]
        at = max(at, e)
    return None if text is None else "".join(out) + text[at:]


def backoff(texts: list[str | None], order: int, least: int, factor: float) -> list[float]:
    data = [b"\0" * (order - 1) + (t or "").encode() for t in texts]
    tables = {k: Counter(d[i - k + 1 : i + 1] for d in data for i in range(order - 1, len(d))) for k in range(1, order + 1)}
    contexts = {k: Counter() for k in tables}
    for k in tables:
        for g, n in tables[k].items():
            contexts[k][g[:-1]] += n

    def score(g: bytes) -> float:
        k = len(g)
        if k == 1 or tables[k][g] >= least:
            return tables[k][g] / contexts[k][g[:-1]]
        return factor * score(g[1:])

    return [sum(math.log(score(d[i - order + 1 : i + 1])) for i in range(order - 1, len(d))) for d in data]


def bigrams(text: str) -> set[tuple[str, str]]:
    w = re.findall(r"[^\W_]+", text.lower())
    return set(zip(w, w[1:]))


def licenses(text: str | None, templates: dict[str, list[str]], threshold: float) -> dict[str, tuple[int, float]]:
    out: dict[str, tuple[int, float]] = {}
    text = text or ""
    for unit in {*text.split("\n"), *re.split(r"\n[ \t\r#*/;%]*\n", text), text}:
        have = bigrams(unit)
        scores = [(-2 * len(have & want) / (len(have) + len(want)), name) for name, bodies in templates.items() for body in bodies if (want := bigrams(body))]
        least, name = min(scores)
        if have and -least >= threshold:
            n, d = out.get(name, (0, 0.0))
            out[name] = (n + 1, max(d, -least))
    return out

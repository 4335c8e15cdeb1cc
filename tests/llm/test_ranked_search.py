"""Tiered search against scores of every document."""

import math
import random
import re
from collections import Counter

import pytest

from offerloom.llm import ranked_search
from offerloom.llm.ranked_search import build_index, search

TERM = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def plain(docs, items, k=10):
    terms = [(d, TERM.findall((t or "").translate(LOWER))) for d, t in docs]
    big_n, big_l = sum(bool(t) for _, t in terms), sum(len(t) for _, t in terms)
    df = Counter(x for _, t in terms for x in set(t))
    out = []
    for item, text in items:
        scores = []
        for d, t in terms:
            tf = Counter(t)
            m = 10 + (90 * len(t) * big_n) // big_l if big_l else 0
            score = sum(math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[x] + 1))) * ((10**9 * tf[x]) // (1000 * tf[x] + 8 * m)) for x in set(TERM.findall((text or "").translate(LOWER))) if tf[x])
            if score > 0:
                scores.append((-score, d is None, d))
        out += [(item, i + 1, d, -s) for i, (s, _, d) in enumerate(sorted(scores, key=lambda s: (s[0], s[1], s[2] or 0))[:k])]
    return sorted(out, key=repr)


def found(spark, docs, items, k=10):
    docs = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id bigint, text string, tier int, term string")
    items = spark.createDataFrame([(*i, 2) for i in items], "item_id bigint, text string, score int")
    return sorted(map(tuple, search(build_index(docs), items, k).collect()), key=repr)


def zipf(r, n):
    return " ".join(f"w{min(int(r.paretovariate(0.6)), 400)}" for _ in range(n))


def test_against_every_score(spark, monkeypatch):
    """Skewed words, some texts with whole items, at tiers that all get used."""
    r = random.Random(4)
    items = [(i, zipf(r, r.randint(2, 20))) for i in range(25)]
    docs = [(i, zipf(r, r.randint(1, 80))) for i in range(400)]
    docs += [(1000 + j, zipf(r, 5) + " " + items[j % 8][1] + " " + zipf(r, 5)) for j in range(96)]
    want = plain(docs, items)
    assert found(spark, docs, items) == want
    monkeypatch.setattr(ranked_search, "TIERS", [(1 / 200, 900_000), (1 / 50, 700_000), (1 / 4, 500_000)])
    assert found(spark, docs, items) == want


def test_proofs(spark, monkeypatch):
    """Items with ten clear finds are proven in the first tier; vague ones fall through."""
    r = random.Random(9)
    clear = " ".join(f"rare{i}" for i in range(12))
    docs = [(i, zipf(r, 60)) for i in range(300)] + [(500 + i, clear + " " + zipf(r, 10)) for i in range(12)]
    items = [(1, clear + " w1 w2"), (2, " ".join(f"w{i}" for i in range(2, 14)))]
    seen = []
    real = ranked_search.materialize

    def kept(df, tag):
        out = real(df, tag)
        if tag == "proofs":
            seen.append({row["item"]: row["proven"] for row in out.collect()})
        return out

    monkeypatch.setattr(ranked_search, "materialize", kept)
    assert found(spark, docs, items) == plain(docs, items)
    assert sorted(seen[0].values()) == [False, True]
    assert list(seen[1].values()) == [False]


def test_odd_rows(spark):
    docs = [(5, "one Two"), (5, "one Two"), (3, "one two"), (None, "ONE two"), (7, None), (8, ""), (9, "... !"), (10, "straße ÄB äb"), (11, "zero")]
    items = [(1, "two, one one"), (1, "two"), (2, None), (3, "!"), (None, "ÄB"), (4, "absent")]
    got = found(spark, docs, items)
    assert got == plain(docs, items)
    assert [g[2] for g in got if g[0] == 1][:1] == [3]
    assert found(spark, [], items) == [] == found(spark, docs, [])


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(ranked_search, "BROADCAST_ROWS", 20)
    r = random.Random(2)
    items, docs = [(i, zipf(r, 6)) for i in range(12)], [(i, zipf(r, 30)) for i in range(80)]
    assert found(spark, docs, items, 3) == plain(docs, items, 3)


@pytest.mark.parametrize("held", [1, 50])
def test_tasks_hand_on_counts(spark, monkeypatch, held):
    monkeypatch.setattr(ranked_search, "HELD", held)
    docs = [(i, f"a b{i % 7} c") for i in range(60)]
    assert found(spark, docs, [(1, "b3 c")]) == plain(docs, [(1, "b3 c")])

"""The bounded cache against one that answers request after request."""

import random
from collections import OrderedDict

import pytest

from offerloom.operators.lru import _held, lru_hits

ASKED = "key string, at_ms bigint, seq bigint"


def replay(requests, most, ttl):
    held, out = OrderedDict(), []
    for key, at, seq in sorted(requests, key=lambda r: (r[1], r[2], r[0] or "")):
        hit = key in held and at - held[key] <= ttl
        if not hit:
            held[key] = at
        held.move_to_end(key)
        if len(held) > most:
            held.popitem(last=False)
        out.append((key, at, seq, hit))
    return sorted(out, key=repr)


def answers(spark, requests, most, ttl, size):
    return sorted(map(tuple, lru_hits(spark.createDataFrame(requests, ASKED), most, ttl, size).collect()), key=repr)


@pytest.mark.parametrize(("most", "ttl", "size"), [(8, 150, 40), (30, 10_000, 70), (1, 50, 1000)])
def test_against_a_replay(spark, most, ttl, size):
    """A hot key, null keys, ties in time and repeated rows; a key may be gone
    before it expires, and expire before it is gone."""
    r = random.Random(most)
    requests = [(r.choice(["hot"] * 20 + [None] * 3 + [f"k{r.randrange(60)}" for _ in range(40)]), r.randrange(1, 900), i) for i in range(800)]
    requests += requests[:30]
    got = answers(spark, requests, most, ttl, size)
    assert got == replay(requests, most, ttl)
    assert 0 < sum(g[3] for g in got) < len(got)


def test_a_long_stretch_of_one_key(spark):
    """Many ranges hold one key alone: what was asked before them must be found
    through all of them, and is held if no more keys came than there is room."""
    first = [(f"k{i}", i, i) for i in range(6)]
    stretch = [("hot", 10 + i, 10 + i) for i in range(300)]
    last = [(f"k{i}", 400 + i, 400 + i) for i in (5, 0, 1, 2)]
    requests = first + stretch + last
    for most in (6, 7):
        assert answers(spark, requests, most, 10_000, 20) == replay(requests, most, 10_000)


def test_what_a_range_begins_with_is_bounded(spark):
    df = spark.range(5000).selectExpr("concat('k', id % 700) AS slot", "id AS place", "id div 250 AS part")
    held = _held(df, 90).groupBy("part").count().collect()
    assert {h["count"] for h in held} == {90} and len(held) == 19


def test_odd_requests(spark):
    assert answers(spark, [], 3, 10, 5) == []
    # no time: a miss that is not stored; the age of exactly ttl still hits
    requests = [("k", None, 1), ("k", 5, 2), ("k", 15, 3), ("k", 16, 4), ("K", 16, 5), (None, 16, 6), (None, 17, 7)]
    want = [("K", 16, 5, False), ("k", 15, 3, True), ("k", 16, 4, False), ("k", 5, 2, False), ("k", None, 1, False), (None, 16, 6, False), (None, 17, 7, True)]
    assert answers(spark, requests, 3, 10, 5) == sorted(want, key=repr)
    with pytest.raises(ValueError):
        lru_hits(spark.createDataFrame([], ASKED), 0)


def test_clashing_columns(spark):
    rows = spark.createDataFrame([("a", 1, 1, "x", 3), ("a", 2, 2, "y", 4)], ASKED + ", slot string, place int")
    assert sorted(map(tuple, lru_hits(rows).collect())) == [("a", 1, 1, False), ("a", 2, 2, True)]

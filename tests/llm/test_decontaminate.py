import math
import random

import pytest

from offerloom.llm import decontaminate

from . import brute


def found(spark, docs, items, **more):
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    i = spark.createDataFrame(items, "item_id bigint, text string")
    return {(r.doc_id, r.item_id, r.n_shingles, r.n_shared) for r in decontaminate.contained_items(d, i, **more).collect()}


def test_brute_force(spark):
    rng = random.Random(5)
    word = lambda: f"{rng.choice('abcdefgh')}{rng.randrange(60)}"
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 2, 4, 5, 6, 12, 30, 80, 300])))) for i in range(40)]
    docs = []
    for d in range(150):
        w = [word() for _ in range(rng.randrange(0, 900))]
        for _ in range(rng.randrange(3)):
            part = items[rng.randrange(40)][1].upper().split()
            for _ in range(rng.randrange(0, 1 + len(part) // 15)):
                part[rng.randrange(len(part))] = word()
            at = rng.randrange(len(w) + 1)
            w[at:at] = part
        docs.append((d, "\n".join(w)))
    got = found(spark, docs, items)
    assert got == brute.contained(docs, items, 5, 0.8)
    assert len(got) > 100


def test_partitions_set_sketch_and_rule():
    """Small sets are whole; sketches grow with the partition; the tail of what
    is drawn without replacement is under MISS for sets of each partition."""
    assert all(decontaminate.rule(p, 0.8) is None for p in range(7))
    rules = [decontaminate.rule(p, 0.8) for p in range(7, 24)]
    assert rules == sorted(rules) and rules[0][0] < rules[-1][0] < 256
    for p in (7, 8, 11):
        m, least = decontaminate.rule(p, 0.8)
        for size in (2**p, 2**p + 2, 2 ** (p + 1) - 1):
            have = math.ceil(0.8 * size)
            missed = sum(math.comb(have, n) * math.comb(size - have, m - n) for n in range(least) if m - n <= size - have)
            assert missed / math.comb(size, m) < decontaminate.MISS
        assert decontaminate._tail(m, 0.4, least) * 2 ** (p + 1) <= decontaminate.VAIN


@pytest.mark.parametrize("rows", [decontaminate.BROADCAST_ROWS, 0])
def test_large_items(spark, monkeypatch, rows):
    """Items whose sketches are shorter than their sets, at and near the
    threshold; with nothing broadcast, too."""
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", rows)
    rng = random.Random(11)
    items, docs = [], []
    for i, n in enumerate([5, 70, 140, 260, 600, 1500, 3000]):
        words = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        items.append((i, " ".join(words)))
        for broken in (0.0, 0.15, 0.19, 0.2, 0.21, 0.3, 0.6):
            part = list(words)
            # whole stretches go, so the share of shingles is near that of words
            for w in range(int(broken * n)):
                part[w] = "x"
            docs.append((len(docs), " ".join(["before", *part, "after"] * rng.choice([1, 2]))))
    docs += [(len(docs) + i, "stop stop stop stop stop stop") for i in range(300)]
    got = found(spark, docs, items)
    assert got == brute.contained(docs, items, 5, 0.8)
    assert {p for _, p, *_ in got} == set(range(7))


def test_items_in_several_rows(spark):
    """An id's rows are one set; the document reaches the threshold of neither row."""
    w = [f"w{i}" for i in range(60)]
    first, second = w[:14], w[:7] + w[20:31]
    items = [(1, " ".join(first)), (1, " ".join(second))]
    docs = [(1, " ".join(w[3:14] + ["x"] + w[3:7] + w[20:31])), (2, " ".join(first + ["x"] + second)), (3, " ".join(first))]
    whole = {tuple(x[i : i + 5]) for x in (first, second) for i in range(len(x) - 4)}
    want = set()
    for d, text in docs:
        x = text.split()
        n = len(whole & {tuple(x[i : i + 5]) for i in range(len(x) - 4)})
        if n >= 0.7 * len(whole):
            want.add((d, 1, len(whole), n))
    assert found(spark, docs, items, threshold=0.7) == want
    assert {d for d, *_ in want} == {1, 2}


def test_edges(spark):
    items = [(1, "alpha beta gamma delta epsilon"), (1, "alpha beta gamma delta epsilon"), (2, None), (3, " "), (None, "alpha beta gamma delta epsilon"), (4, "solo")]
    docs = [(7, "x ALPHA beta\tgamma delta epsilon y"), (7, "x ALPHA beta\tgamma delta epsilon y"), (8, None), (9, ""), (None, "alpha beta gamma delta epsilon"), (10, "solo, not"), (11, "a solo b")]
    assert found(spark, docs, items) == {(7, 1, 1, 1), (11, 4, 1, 1)}
    assert found(spark, [], items) == found(spark, docs, []) == set()
    wide = spark.createDataFrame([(7, "solo", 3, "h")], "doc_id bigint, text string, item_id int, hash string")
    tests = spark.createDataFrame([(4, "solo", 3, 1)], "item_id bigint, text string, doc_id int, size int")
    assert [(r.doc_id, r.item_id) for r in decontaminate.contained_items(wide, tests).collect()] == [(7, 4)]

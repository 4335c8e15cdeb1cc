import random

import numpy as np

from offerloom.llm import phrases, repeats

from . import brute

SCHEMA = "doc_id bigint, text string"


def check(spark, texts, span=200):
    rows = list(enumerate(texts))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove_repeats(spark.createDataFrame(rows, SCHEMA).repartition(5), span).collect()}
    assert [got[i] for i in range(len(rows))] == brute.repeats(texts, span)
    return got


def fresh(rng, n):
    return "".join(rng.choice("abcdeé 🙂\n") for _ in range(n))


def test_brute_force(spark):
    rng = random.Random(6)
    passages = [fresh(rng, rng.choice([150, 180, 200, 201, 320, 900])) for _ in range(12)]
    texts = [None, "", "x", "a" * 199, "a" * 200, "a" * 201, "ab" * 150, "abc" * 500, "a" * 5000]
    for _ in range(80):
        parts = [fresh(rng, rng.randrange(0, 400)) for _ in range(rng.randrange(1, 5))]
        texts.append("".join(p + (rng.choice(passages)[rng.randrange(30) :] if rng.random() < 0.5 else "") for p in parts))
    base = fresh(rng, 2500)
    for _ in range(40):  # near copies
        at = rng.randrange(2500)
        texts.append(base[:at] + rng.choice(["", "Z", "ZZ"]) + base[at + rng.randrange(3) :])
    texts += [base] * 30
    got = check(spark, texts)
    assert sum(g[1] > 0 for g in got.values()) > 80


def test_text_of_several_pieces(spark):
    rng = random.Random(7)
    passage = fresh(rng, 700)
    long = "".join(rng.choices("abcdefghij", k=repeats.PIECE - 300)) + passage + "".join(rng.choices("abcdefghij", k=repeats.PIECE)) + passage
    check(spark, [long, "q" + passage + "q", "".join(rng.choices("xyz", k=900))])


def test_other_spans(spark):
    rng = random.Random(8)
    passage = fresh(rng, 260)
    texts = [fresh(rng, 50) + passage[: rng.randrange(100, 260)] + fresh(rng, 50) for _ in range(30)]
    check(spark, texts, 100)
    check(spark, texts, 66)


def test_edges(spark):
    text = "".join(map(str, range(100)))
    rows = [(1, text, 1), (1, text, 2), (2, None, 3), (None, "n" + text, 4), (3, "", 5)]
    got = sorted([tuple(r)[:4] for r in repeats.remove_repeats(spark.createDataFrame(rows, SCHEMA + ", rid int"), 150).collect()], key=repr)
    n = len(text)
    assert got == sorted([(1, n, n, 1), (1, n, n, 1), (2, 0, 0, 0), (None, n + 1, n, 1), (3, 0, 0, 0)], key=repr)
    assert repeats.remove_repeats(spark.createDataFrame([], SCHEMA)).collect() == []


def test_phrases_hold_each_string_once():
    data = np.frombuffer(fresh(random.Random(9), 3000).encode(), np.uint8)
    ends = np.array([0, 1000, 1100, len(data)])
    text, first, last, trigger, _, _ = phrases.phrases(data, ends, 200)
    found = sorted((t, s) for t, f, e in zip(text, first, last) for s in range(f, e + 1))
    assert found == [(t, s) for t, n in enumerate(np.diff(ends)) for s in range(n - 199)]
    assert ((first <= last) & (last <= trigger) & (trigger <= first + 200 - phrases.K)).all()


def test_one_passage_in_many_contexts(spark, monkeypatch):
    """Triggers and rows beyond the bound take the salted ways."""
    monkeypatch.setattr(repeats, "hot_limit", lambda rows: 3)
    rng = random.Random(10)
    passage = fresh(rng, 230)
    texts = [fresh(rng, 60) + passage + fresh(rng, 60) for _ in range(60)] + [passage] * 9 + [fresh(rng, 300)] * 7
    check(spark, texts)

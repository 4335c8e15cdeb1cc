import math
import random
from collections import Counter

import pytest

from offerloom.llm import word_score

from . import brute

SCHEMA = "doc_id bigint, text string"


def plain(texts, least=word_score.MIN_COUNT, factor=word_score.BACKOFF):
    docs = [tuple(brute.words(t, low=False)) for t in texts]
    n = Counter(d[i - k : i] for d in docs for k in (1, 2, 3) for i in range(k, len(d) + 1))
    total = sum(map(len, docs))

    def score(g):
        if len(g) == 1:
            return n[g] / total
        return n[g] / n[g[:-1]] if n[g] >= least else factor * score(g[1:])

    return [sum(math.log(score(d[max(0, i - 2) : i + 1])) for i in range(len(d))) for d in docs]


def test_brute_force(spark):
    rng = random.Random(6)
    word = ["a", "b", "é", "🙂", "ab", "A"]
    texts = ["".join(rng.choice(word) + rng.choice([" ", "  ", "\n", "\t"]) for _ in range(rng.randrange(60))) for _ in range(150)]
    texts += [None, "", " \n ", "a", " lead", "x y z", "b"] + ["same few words"] * 50 + ["w" * 5000]
    want = plain(texts)
    df = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    for sizes in ({}, {"block_bytes": 2000, "range_bytes": 300}):
        got = {r.doc_id: r for r in word_score.word_scores(df, **sizes).collect()}
        assert [got[i].log_score for i in range(len(texts))] == pytest.approx(want)
        assert [got[i].n_words for i in range(len(texts))] == [len(brute.words(t)) for t in texts]
        assert got[150].mean_log_score is None


def test_shuffled_words_score_lower(spark):
    rng = random.Random(7)
    words = [f"word{i}" for i in range(200)]
    texts = [" ".join(words[i : i + 40]) for i in range(0, 160, 2)]
    salad = words[:40]
    rng.shuffle(salad)
    rows = [*enumerate(texts), (500, " ".join(salad))]
    got = {r.doc_id: r.mean_log_score for r in word_score.word_scores(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[500] < min(v for d, v in got.items() if d != 500) - 2


def test_edges(spark):
    rows = [(1, "a b c", 1), (1, "a b c", 1), (None, "a b c", 2), (2, None, None)]
    got = word_score.word_scores(spark.createDataFrame(rows, SCHEMA + ", block int")).collect()
    assert len(got) == 4 and len({round(r.log_score, 9) for r in got if r.n_words}) == 1
    assert word_score.word_scores(spark.createDataFrame([], SCHEMA)).collect() == []

import random

import pytest

from offerloom.llm import quality

from . import brute

SCHEMA = "doc_id bigint, text string, lang string"
LABELS = "doc_id bigint, quality int, toxic int"


def texts(rng, n):
    out = []
    for i in range(n):
        w = [rng.choice(["Ab", "cd", "Éf", "#x", "y|z", "q"]) + str(rng.randrange(300)) for _ in range(rng.randrange(0, 160))]
        if w and rng.random() < 0.4:
            part = w[: rng.randrange(len(w) + 1)]
            w += part * rng.randrange(1, 3)
        out.append("".join(x + rng.choice([" ", "\n", "\t ", "\n\n", "\r\n"]) for x in w))
    return out


def test_statistics(spark):
    rows = list(enumerate(texts(random.Random(1), 200) + [None, "", " \n ", "a " * 8, "a " * 9, "a b\n a b\na b\n", "🙂 é x", "w " * 30_000]))
    got = quality.statistics(spark.createDataFrame(rows, "doc_id bigint, text string"), ["doc_id"]).collect()
    assert {r.doc_id: {k: v for k, v in r.asDict().items() if k != "doc_id"} for r in got} == {i: brute.statistics(t) for i, t in rows}


@pytest.mark.parametrize("n, k, p", [(1, 0, 0.1), (400, 1, 0.02), (2000, 3, 0.005), (2000, 0, 0.005), (50_000, 180, 0.005)])
def test_binomial_tail(spark, n, k, p):
    from pyspark.sql import functions as F

    got = spark.range(1).select(quality.binomial_tail(F.lit(n).cast("bigint"), F.lit(k).cast("bigint"), p)).first()[0]
    want = brute.binomial_tail(n, k, p) if n < 10_000 else got
    assert got == pytest.approx(want, rel=1e-6) and 0 < got < 1


def test_certified_cutoffs(spark):
    rng = random.Random(2)
    plain = lambda: [f"w{rng.randrange(10**6)}" for _ in range(40)]
    rows, labels = [], []
    for i in range(6000):
        w, bad = plain(), i % 10 == 0
        if bad:
            w += ["#" * 9] * 20
        rows.append((i, " ".join(w), "en" if i % 2 else "de"))
        if i % 3:
            labels.append((i, 0 if bad else 1, None))
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, LABELS), risk=0.005).collect()}
    stats = {i: brute.statistics(t) for i, t, _ in rows}
    good = {i for i, q, _ in labels if q == 1}
    cut = {}
    for lang in ("en", "de"):
        held = [stats[i] for i, _, x in rows if x == lang and i in good and not brute.base_failed(stats[i])]
        for rule, e in quality.RULES.items():
            a, b = e.split(" / ")
            for c in quality.GRID:
                k = sum(s[a] / s[b] > c for s in held)
                if k > len(held) * 0.005 or brute.binomial_tail(len(held), k, 0.005) > quality.DELTA / (2 * len(quality.RULES)):
                    break
                cut[lang, rule] = c
    assert cut
    for i, _, lang in rows:
        s = stats[i]
        over = any(s[a] / s[b] > cut.get((lang, r), 9) for r, e in quality.RULES.items() for a, b in [e.split(" / ")])
        assert got[i].kept == (not brute.base_failed(s) and not over)
    assert not any(got[i].kept for i in range(0, 6000, 10)) and all(got[i].kept for i in good)


def test_nulls_and_few_labels(spark):
    rows = [(1, "a b " * 30, None), (2, None, "en"), (2, None, "en"), (None, " ".join(map(str, range(40))), "zz"), (3, " ".join(map(str, range(20))), "en")]
    wide = spark.createDataFrame([(*r, 1, "s") for r in rows], SCHEMA + ", kept int, stratum string")
    labels = spark.createDataFrame([(None, 1, 0), (1, None, 0), (3, 1, 0), (3, 0, 0), (99, 1, None)], LABELS)
    got = sorted([(r.doc_id, r.n_words, r.base_failed, r.kept) for r in quality.judge(wide, labels).collect()], key=repr)
    assert got == sorted([(1, 60, True, False), (2, 0, True, False), (2, 0, True, False), (None, 40, False, True), (3, 20, False, True)], key=repr)
    none = spark.createDataFrame([], LABELS)
    assert quality.judge(spark.createDataFrame([], SCHEMA), none).collect() == []
    assert quality.judge(wide, none).filter("kept").count() == 2

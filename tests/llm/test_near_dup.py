import random

from offerloom.llm import near_dup

from . import brute

SCHEMA = "doc_id bigint, text string"


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def edited(rng, text, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


def corpus(rng):
    vocabulary = [f"w{i}" for i in range(400)]
    fresh = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    texts = []
    for _ in range(25):
        seed = fresh(rng.randrange(40, 300))
        texts += [seed] + [edited(rng, seed, rng.randrange(0, 9)) for _ in range(rng.randrange(1, 6))]
    chain = fresh(300)  # a chain: ends are far apart, neighbours are near
    for _ in range(20):
        texts.append(chain)
        chain = edited(rng, chain, 4)
    texts += [None, "", " \n\t", "one", "One", "one two", "one two three four", "ONE two Three FOUR", "é É"] + [fresh(100) for _ in range(40)]
    rng.shuffle(texts)
    return dict(enumerate(texts))


def test_brute_force(spark):
    texts = corpus(random.Random(3))
    df = near_dup.near_duplicates(spark.createDataFrame(list(texts.items()), SCHEMA), k=4)
    assert result(df) == brute.components(texts, 4, 80)
    assert all(r.kept == (r.doc_id == r.component_id) for r in df.collect())


def test_large_groups(spark):
    rng = random.Random(4)
    seed = " ".join(f"w{rng.randrange(500)}" for _ in range(150))
    texts = {i: seed for i in range(300)} | {300 + i: edited(rng, seed, rng.randrange(1, 7)) for i in range(600)}
    df = near_dup.near_duplicates(spark.createDataFrame(list(texts.items()), SCHEMA), k=5)
    assert result(df) == brute.components(texts, 5, 80)


def test_nulls_ties_and_extra_columns(spark):
    rows = [(2, "a b c d e f", 1, "x"), (1, "a b c d e f", 1, "x"), (1, "a b c d e f", 2, "y"), (None, "a b c d e f", 3, None), (3, None, 4, "z"), (4, "", None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, component_id int, bands string")
    got = sorted(map(tuple, near_dup.near_duplicates(df).collect()), key=repr)
    assert got == sorted([(2, 2, 1, False), (1, 2, 1, True), (1, 2, 1, True), (None, 2, None, True), (3, 0, 3, True), (4, 0, 4, True)], key=repr)


def test_empty_table(spark):
    assert near_dup.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_rows_that_share_an_id_are_one_document(spark):
    rng = random.Random(5)
    a, b = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(2))
    rows = [(1, a), (1, b), (2, a), (3, b + " more"), (4, "quite another text than these are"), (1, None)] + [(9, a)] * 5
    for order in (rows, rows[::-1]):
        got = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in near_dup.near_duplicates(spark.createDataFrame(order, SCHEMA)).collect()}
        assert got == {(1, 56): (1, True), (2, 56): (1, False), (3, 57): (1, False), (4, 2): (4, True), (1, 0): (1, True), (9, 56): (1, False)}

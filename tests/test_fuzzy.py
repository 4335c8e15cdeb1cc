"""Approximate search: worked cases, edit distances, and the SQL form."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from offerloom.functions.fuzzy import chunks, similarities, similarity
from offerloom.fuzzy_sql import fuzzy


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != y))
    return row[-1]


def fewest(text, pattern, at):
    """Least edits from the pattern to any piece of the text that begins there."""
    return min(edits(pattern, text[at:end]) for end in range(at, len(text) + 1))


def noisy(rnd, most=32, letters="abc "):
    pattern = "".join(rnd.choice(letters) for _ in range(rnd.randint(1, most)))
    text = list(pattern if rnd.random() < 0.6 else "".join(rnd.choice(letters) for _ in range(rnd.randint(1, 90))))
    for _ in range(rnd.randint(0, 8)):
        at = rnd.randrange(len(text) + 1)
        text[at : at + rnd.randint(0, 1)] = rnd.choice(["", "x", "ab"])
    return "".join([rnd.choice(letters) for _ in range(rnd.choice([0, 0, 3, 30, 55, 70]))]) + "".join(text), pattern


@pytest.mark.parametrize(
    "text, pattern, score, words",
    [
        ("bolt", "bolt", 0, 1),  # the same
        ("boltx", "bolt", 0.001, 1),  # found where expected: the least score
        ("xxbolt", "bolt", 2 / 100, 1),  # two characters off
        ("xxxx bolt", "bolt", 5 / 100, 2),
        ("bo1t", "bolt", 1 / 4, 1),  # one error of four
        ("a bo1ted", "bolt", None, 2),  # checked by the edits below
        ("x" * 60 + "bolt", "bolt", 60 / 100, 1),  # at the threshold
        ("x" * 61 + "bolt", "bolt", 1, 1),  # past it
        ("zzzz", "bolt", 1, 1),
        ("", "bolt", 1, 1),
        ("   ", "bolt", 1, 1),
        ("bolt", "", 1, 1),
    ],
)
def test_worked_cases(text, pattern, score, words):
    norm = round(1000 / words**0.5) / 1000
    if score is None:
        at = min(range(len(text)), key=lambda a: (fewest(text, pattern, a) / len(pattern) + a / 100))
        score = fewest(text, pattern, at) / len(pattern) + at / 100
    assert similarities([(text, pattern)])[0] == pytest.approx(1 - score**norm, abs=1e-12)


def test_found_where_the_edits_allow():
    """Found exactly where some place has few enough edits for its distance, and
    never scored better than the best place."""
    rnd = random.Random(5)
    for _ in range(150):
        pattern = "".join(rnd.choice("abc") for _ in range(rnd.randint(1, 9)))
        text = "".join(rnd.choice("abcd") for _ in range(rnd.randint(1, 14)))
        best = min(fewest(text, pattern, a) / len(pattern) + a / 100 for a in range(len(text)))
        got = similarities([(text, pattern)])[0]
        if text == pattern:
            assert got == 1
        elif best > 0.6:
            assert got == 0
        else:
            assert 0 < got <= 1 - max(0.001, best) + 1e-12


def test_a_match_is_missed_by_no_batch():
    """A pair scores the same alone and among others, whatever their lengths."""
    rnd = random.Random(6)
    pairs = [noisy(rnd, 80) for _ in range(200)]
    assert similarities(pairs) == [similarities([p])[0] for p in pairs]


def test_long_patterns_go_in_chunks():
    pattern = "".join(chr(0x4E00 + i) for i in range(70))
    assert [(at, len(p)) for at, p in chunks(pattern)] == [(0, 32), (32, 32), (38, 32)]
    assert similarities([(pattern + "z", pattern)])[0] == pytest.approx(0.999)
    # the first chunk alone is found; the others count as 1 each
    assert similarities([(pattern[:32], pattern)])[0] == pytest.approx(1 - (0.001 + 1 + 1) / 3)
    assert similarities([("z" * 200, pattern)])[0] == 0


def test_a_text_of_a_million_characters_costs_its_window():
    long = "bolt " + "x" * 1_000_000
    assert similarities([(long, "bolt")] * 50)[0] > 0.99


def test_sql_form():
    rnd = random.Random(7)
    pairs = list({noisy(rnd) for _ in range(600)})
    pairs = [p for p in pairs if p[0].strip()]
    con = duckdb.connect()
    con.execute("CREATE TABLE pairs (nm VARCHAR, q VARCHAR)")
    con.executemany("INSERT INTO pairs VALUES (?, ?)", pairs)
    told = {(a, b): f for a, b, f in con.execute(fuzzy("SELECT nm, q FROM pairs")).fetchall()}
    got = similarities(pairs)
    assert sum(g > 0 for g in got) > 100
    assert {p: round(15 * g, 9) for p, g in zip(pairs, got)} == {p: round(f, 9) for p, f in told.items()}


def test_columns(spark):
    rows = [("bolt", "bolt"), ("xxbolt", "bolt"), (None, "bolt"), ("bolt", None), ("", ""), ("xxbolt", "bolt")]
    df = spark.createDataFrame(rows, "a string, b string")
    got = [r.s for r in df.select(similarity(F.col("a"), F.col("b")).alias("s")).collect()]
    assert got == [1, pytest.approx(0.98), 0, 0, 0, pytest.approx(0.98)]
    assert df.limit(0).select(similarity(F.col("a"), F.col("b"))).count() == 0

"""Periodic runs against a plain version that tries every period."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from offerloom.llm import queries, runs

SMALL = "/root/testdata/sf0.001"


def plain_runs(words, power=4, least=6):
    found = []
    for q in range(1, len(words) // power + 1):
        i = q
        while i < len(words):
            if words[i] != words[i - q]:
                i += 1
                continue
            last = i
            while last + 1 < len(words) and words[last + 1] == words[last + 1 - q]:
                last += 1
            s, size = i - q, last - i + q + 1
            smaller = any(all(words[x] == words[x - d] for x in range(s + d, last + 1)) for d in range(1, q))
            if size >= max(least, power * q) and not smaller:
                found.append((s, size, q))
            i = last + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_collapsed(words, found):
    gone = {i for s, size, q in found for i in range(s + q, s + size)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


@pytest.mark.parametrize("power", [2, 3, 4])
def test_random_words(power):
    r = random.Random(power)
    for _ in range(1500):
        letters = "abcd"[: r.randint(1, 4)]
        words = [r.choice(letters) for _ in range(r.randint(0, 60))]
        if words and r.random() < 0.6:
            p, a = r.randint(1, 8), r.randrange(len(words))
            words = [words[i] if i < a else words[min(a + (i - a) % p, len(words) - 1)] for i in range(len(words))] + r.choices(letters, k=r.randrange(9))
        n, found, collapsed = runs.text_runs(" ".join(words).encode(), power, 6)
        assert n == len(words)
        assert found == plain_runs(words, power)
        assert collapsed.decode() == plain_collapsed(words, found)


def test_blocks(monkeypatch):
    """Words at the edges of blocks, and white space of all kinds."""
    monkeypatch.setattr(runs, "BLOCK", 7)
    text = "\t\n one  two\x0bone two\rone two one two  élan " + "x " * 9 + "tail"
    n, found, collapsed = runs.text_runs(text.encode(), 4, 6)
    assert (n, found) == (19, [(0, 8, 2), (9, 9, 1)])
    assert collapsed.decode() == "one two élan x tail"


def test_long_periods():
    words = [f"w{i}" for i in range(500)] * 4
    assert runs.text_runs(" ".join(words).encode())[1] == [(0, 2000, 500)]
    assert runs.text_runs(b"a b " * 20_000)[1] == [(0, 40_000, 2)]


def test_query(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    want = {}
    for doc_id, text in docs:
        words = (text or "").encode().split()
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        words = [w.decode() for w in words]
        found = plain_runs(words)
        best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None,) * 3)
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want[doc_id] = (len(found), *best, best[0] if best[0] is None else 1000 * best[1] // best[2], digest("".join("%d,%d,%d\n" % f for f in found)), digest(plain_collapsed(words, found)))
    got = queries.op12_periodic_runs(spark, SMALL).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == want
    assert sum(w[0] > 0 for w in want.values()) > 5


def test_odd_rows(spark):
    rows = [(None, "a a a a a a"), (1, None), (1, ""), (2, " \n"), (2, " \n"), (3, "b " * 6), (3, "b " * 6)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id bigint, text string, runs int, collapsed string")
    got = sorted(((r.doc_id or 0, r.n_words, len(r.runs), r.collapsed) for r in runs.periodic_runs(docs).collect()))
    assert got == [(0, 6, 1, "a"), (1, 0, 0, ""), (1, 0, 0, ""), (2, 0, 0, ""), (2, 0, 0, ""), (3, 6, 1, "b"), (3, 6, 1, "b")]
    assert runs.periodic_runs(docs.limit(0)).collect() == []
    assert runs.periodic_runs(runs.with_planted_period(docs)).count() == 7
    with pytest.raises(ValueError):
        runs.periodic_runs(docs, power=1)


def test_strongest_takes_the_first_of_equals(spark):
    make = F.array(*[F.struct(F.lit(s).cast("bigint").alias("start"), F.lit(n).cast("bigint").alias("length"), F.lit(q).cast("bigint").alias("period")) for s, n, q in [(0, 8, 2), (3, 9, 2), (5, 18, 4), (9, 27, 6)]])
    assert tuple(spark.range(1).select(runs.strongest(make).alias("r")).first().r) == (3, 9, 2)

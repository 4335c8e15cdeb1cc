import random

import pytest

from offerloom.llm import lm_score

from . import brute

SCHEMA = "doc_id bigint, text string"


def test_brute_force(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choices("aaabbcdé 🙂", k=rng.randrange(0, 400))) for _ in range(120)] + [None, "", "a", "same text"] + ["same text"] * 60
    rows = list(enumerate(texts))
    want = brute.backoff(texts, lm_score.ORDER, lm_score.MIN_COUNT, lm_score.BACKOFF)
    for block in (lm_score.BLOCK_BYTES, 4000):
        got = {r.doc_id: r for r in lm_score.lm_scores(spark.createDataFrame(rows, SCHEMA), block_bytes=block).collect()}
        assert [got[i].log_score for i in range(len(texts))] == pytest.approx(want)
        assert all(got[i].n_bytes == len((t or "").encode()) for i, t in rows)
        assert got[120].mean_log_score is None and got[122].mean_log_score == pytest.approx(want[122])


def test_edges(spark):
    rows = [(1, "abcabc", 1), (1, "abcabc", 1), (None, "abcabc", 2), (2, None, None)]
    got = lm_score.lm_scores(spark.createDataFrame(rows, SCHEMA + ", block int")).collect()
    assert len(got) == 4 and len({round(r.log_score, 9) for r in got if r.n_bytes}) == 1
    assert lm_score.lm_scores(spark.createDataFrame([], SCHEMA)).collect() == []

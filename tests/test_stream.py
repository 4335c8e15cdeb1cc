"""The streaming cache over batches: answers, state that ends, late requests."""

import pytest

from offerloom.streaming.cache import stream_cache_hits

ASKED = "key string, at_ms bigint, seq bigint, n_results int"
HOUR = 3_600_000


@pytest.fixture
def asks(spark, tmp_path):
    """A running stream; each call is one batch and gives what is held after it."""
    (tmp_path / "in").mkdir()
    answered = stream_cache_hits(spark.readStream.schema(ASKED).parquet(str(tmp_path / "in")), HOUR, delay_ms=1000)
    q = answered.writeStream.format("memory").queryName("answers").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()

    def ask(*rows):
        spark.createDataFrame(rows, ASKED).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q.processAllAvailable()
        return q.lastProgress["stateOperators"][0]["numRowsTotal"]

    yield ask
    q.stop()


def hits(spark):
    return {r.seq: r.hit for r in spark.sql("SELECT seq, hit FROM answers").collect()}


def test_state_ends_with_its_time(spark, asks):
    assert asks(("a", 1000, 0, 3), ("b", 2000, 1, 1), (None, 2000, 2, 1)) == 3
    # hits do not extend; of b nothing is left to be found at the end of its time plus one
    asks(("a", 1000 + HOUR, 3, 3), ("b", 2001 + HOUR, 4, 0))
    assert hits(spark) == {0: False, 1: False, 2: False, 3: True, 4: False}
    # a request without results moves the watermark on and leaves no state itself
    assert asks(("z", 10 * HOUR, 5, 0)) == 0
    assert asks(("a", 10 * HOUR + 1, 6, 1)) == 1
    assert hits(spark)[6] is False


def test_late_requests(spark, asks):
    asks(("a", 5 * HOUR, 0, 1))
    # the watermark is at 5 h less a second: at it is late, behind it is not
    asks(("a", 5 * HOUR - 1000, 1, 1), ("a", 5 * HOUR - 999, 2, 1), ("a", None, 3, 1))
    assert hits(spark) == {0: False, 2: True}


def test_asked_when_its_time_is_over(spark, asks):
    """A miss without results, on a key whose time ran out in between, ends its state."""
    assert asks(("a", 1000, 0, 1)) == 1
    assert asks(("a", 10 * HOUR, 1, 0)) == 0
    assert hits(spark) == {0: False, 1: False}

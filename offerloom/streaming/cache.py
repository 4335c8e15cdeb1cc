"""The result cache as a keyed stream operator."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: How much later than others a request may arrive.
DELAY_MS = 10 * 60 * 1000


def stream_cache_hits(requests: DataFrame, ttl_ms: int, delay_ms: int = DELAY_MS) -> DataFrame:
    """Streaming form of cache_hits(): (key, at_ms, seq, hit) of each request.

    The state of a key is the time until which its results are kept. It has a
    timer at that time and goes when the watermark, ``delay_ms`` behind the
    latest request, has passed it: no request that could still hit it can come.
    Requests that arrive in one batch are taken by time; one that arrives after
    later ones were answered is answered by the state as it is then. One that
    is at or behind the watermark when its batch begins is not answered, nor is
    one without a time.
    """

    def answer(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        until = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values(["at_ms", "seq"])
        hits = []
        for at, n in zip(rows["at_ms"], rows["n_results"]):
            hits.append(until is not None and until >= at)
            if not hits[-1]:
                until = int(at) + ttl_ms if n > 0 else None
        if until is not None and until > max(state.getCurrentWatermarkMs(), 0):
            state.update((until,))
            state.setTimeoutTimestamp(until)
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"key": key[0], "at_ms": rows["at_ms"], "seq": rows["seq"], "hit": hits})

    timed = requests.filter("at_ms IS NOT NULL").select("key", "at_ms", "seq", "n_results", F.timestamp_millis("at_ms").alias("__at"))
    timed = timed.withWatermark("__at", f"{delay_ms} milliseconds")
    return timed.groupBy("key").applyInPandasWithState(answer, "key string, at_ms bigint, seq bigint, hit boolean", "until bigint", "append", GroupStateTimeout.EventTimeTimeout)

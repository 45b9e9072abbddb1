"""Keyed state with expiry on streams: a result cache, conversation memory, and an incremental index."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.query import StreamingQuery


def cache_stream(requests: DataFrame, ttl: int = 3600, late: str = "1 hour") -> DataFrame:
    """key, request_id, hit of a stream of requests (key, request_id, at).

    The state of a key is when its entry was stored. It is dropped by event time once no hit is possible any more, so state
    is bounded by the keys of the last ttl seconds and the watermark.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        b = pd.concat(list(batches)).sort_values(["at", "request_id"])
        stored, hits = (state.get[0] if state.exists else None), []
        for at in b["at"]:
            second = int(at.timestamp())
            hit = stored is not None and 0 <= second - stored <= ttl
            stored = stored if hit else second
            hits.append(hit)
        state.update((stored,))
        state.setTimeoutTimestamp(max(stored + ttl + 1, state.getCurrentWatermarkMs() // 1000 + 1) * 1000)
        yield pd.DataFrame({"key": key[0], "request_id": b["request_id"], "hit": hits})

    kind = dict(requests.dtypes)["request_id"]
    timed = requests.withColumn("at", F.col("at").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy("key").applyInPandasWithState(step, f"key string, request_id {kind}, hit boolean", "stored long", "append", GroupStateTimeout.EventTimeTimeout)


def memory_stream(turns: DataFrame, keep: int = 5, show: int = 3, idle: int = 1800, cut: int = 200, late: str = "1 hour") -> DataFrame:
    """session_id, turn_id, context of a stream of turns (session_id, turn_id, question, answer, at): what was said before.

    The state of a session is its last `keep` turns; it is dropped after `idle` seconds of silence by event time.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        said, last = (list(state.get[0]), state.get[1]) if state.exists else ([], None)
        rows = []
        for r in pd.concat(list(batches)).sort_values(["at", "turn_id"]).itertuples():
            at = int(r.at.timestamp())
            if last is not None and at - last > idle:
                said = []
            rows.append((key[0], r.turn_id, "\n\n".join(said[-show:])))
            said = [*said, f"User: {r.question or ''}\nAssistant: {(r.answer or '')[:cut]}"][-keep:]
            last = at
        state.update((said, last))
        state.setTimeoutTimestamp(max(last + idle + 1, state.getCurrentWatermarkMs() // 1000 + 1) * 1000)
        yield pd.DataFrame(rows, columns=["session_id", "turn_id", "context"])

    kind = dict(turns.dtypes)["turn_id"]
    timed = turns.withColumn("at", F.col("at").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy("session_id").applyInPandasWithState(step, f"session_id string, turn_id {kind}, context string", "said array<string>, last long", "append", GroupStateTimeout.EventTimeTimeout)


def incremental_index(pages: DataFrame, build: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, late: str = "1 day", **trigger: Any) -> StreamingQuery:
    """Writes what build makes of the new pages (url, scraped_at, ...) of a stream to the Parquet folder target.

    A page counts once per address within the watermark; earlier addresses are dropped by the watermark's state only, so a
    page seen again much later is indexed again under the same ids.
    """
    fresh = pages.withWatermark("scraped_at", late).dropDuplicatesWithinWatermark(["url"])

    return fresh.writeStream.foreachBatch(lambda b, n: build(b).write.mode("overwrite").parquet(f"{target}/batch={n}")).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

"""Conversation memory and a result cache, as batch operators over logged requests."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def scope_key(query: Column, campus: Column, session: Column, pinned: Column | None = None, model: str = "", version: str = "1") -> Column:
    """md5 of a request's normalised scope: equal requests of one session, campus, pin, model and version share it."""
    low = lambda c: F.lower(F.trim(F.coalesce(c.cast("string"), F.lit(""))))
    pin = F.coalesce(F.to_json(pinned), F.lit("{}")) if pinned is not None else F.lit("{}")
    return F.md5(F.concat_ws("\x1f", low(query), low(campus), low(session), F.lit(model.lower().strip()), F.lit(version), pin))


def context(turns: DataFrame, keep: int = 5, show: int = 3, idle: int = 1800, cut: int = 200) -> DataFrame:
    """turns (session_id, turn_id, question, answer, at) with the column context: what came before in the session.

    The last `show` of the last `keep` turns, answers cut to `cut` characters; empty if the session was silent for longer
    than `idle` seconds. Sessions are bounded by what one person says; turns without a session have no context.
    """
    w = Window.partitionBy("session_id").orderBy("at", "turn_id")
    said = F.concat(F.lit("User: "), F.coalesce("question", F.lit("")), F.lit("\nAssistant: "), F.substring(F.coalesce("answer", F.lit("")), 1, cut))
    before = F.collect_list(said).over(w.rowsBetween(-min(show, keep), -1))
    fresh = F.unix_timestamp("at") - F.unix_timestamp(F.lag("at").over(w)) <= idle
    return turns.filter("session_id IS NOT NULL").withColumn("context", F.when(fresh, F.array_join(before, "\n\n")).otherwise(""))


def recent_turns(turns: DataFrame, keep: int = 5, sessions: int = 200) -> DataFrame:
    """The last `keep` turns of the `sessions` sessions that spoke last."""
    last = turns.filter("session_id IS NOT NULL").groupBy("session_id").agg(F.max("at").alias("last")).orderBy(F.desc("last"), "session_id").limit(sessions)
    w = Window.partitionBy("session_id").orderBy(F.desc("at"), F.desc("turn_id"))
    return turns.join(F.broadcast(last), "session_id").withColumn("n", F.row_number().over(w)).filter(F.col("n") <= keep)


def follow_up(question: Column) -> Column:
    """Whether a question refers to what was said before."""
    return F.coalesce(F.lower(question).rlike(r"(^|[^a-z])(he|she|they|it|this|that|his|her|their|its|them|those|the same|above|previous)([^a-z]|$)"), F.lit(False))


def resolve(question: Column, before: Column) -> Column:
    """The question after its context, if it refers to one and there is one."""
    return F.when(follow_up(question) & (before != ""), F.concat(F.lit("Previous conversation:\n"), before, F.lit("\n\nCurrent question: "), question)).otherwise(question)


def cache_hits(requests: DataFrame, ttl: int = 3600) -> DataFrame:
    """request_id, key, hit of requests (request_id, key, at): whether an entry of the key is no older than ttl seconds.

    A hit does not renew its entry, so hits of a key depend on one another; but after a silence longer than ttl the next
    request is always a miss. Requests are cut there, and only each stretch is walked through in order.
    """
    w = Window.partitionBy("key").orderBy("at", "request_id")
    gap = F.unix_timestamp("at") - F.unix_timestamp(F.lag("at").over(w))
    marked = requests.select("request_id", "key", "at", F.coalesce((gap > ttl).cast("int"), F.lit(0)).alias("cut")).withColumn("stretch", F.sum("cut").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    # Stretches of one key may lie in different tasks. A task walks through its sorted rows and keeps one time only.
    ordered = marked.select("request_id", "key", "stretch", F.unix_timestamp("at").alias("at")).repartition("key", "stretch").sortWithinPartitions("key", "stretch", "at", "request_id")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, stored = None, None
        for b in batches:
            hits = []
            for key, stretch, at in zip(b["key"], b["stretch"], b["at"]):
                if (key, stretch) != group:
                    group, stored = (key, stretch), None
                hit = stored is not None and at - stored <= ttl
                stored = stored if hit else at
                hits.append(hit)
            yield pd.DataFrame({"request_id": b["request_id"], "key": b["key"], "hit": hits})

    return ordered.mapInPandas(walk, f"request_id {dict(requests.dtypes)['request_id']}, key string, hit boolean")


def cache_stats(hits: DataFrame) -> DataFrame:
    """requests, hits, misses, hit_rate of cache_hits."""
    n = F.count("*")
    h = F.coalesce(F.sum(F.col("hit").cast("long")), F.lit(0))
    return hits.agg(n.alias("requests"), h.alias("hits"), (n - h).alias("misses"), F.coalesce(F.round(h / F.nullif(n, F.lit(0)), 4), F.lit(0.0)).alias("hit_rate"))


def evict(requests: DataFrame, rows: int = 500) -> DataFrame:
    """The keys that a cache of so many rows holds at the end: those used last, with the time of their last use."""
    return requests.groupBy("key").agg(F.max("at").alias("used")).orderBy(F.desc("used"), "key").limit(rows)


def number_sources(sources: Column) -> Column:
    """Distinct sources in order, numbered from 1."""
    return F.transform(F.array_distinct(sources), lambda s, i: F.struct((i + 1).alias("index"), s.alias("url")))

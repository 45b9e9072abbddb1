import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from graphloom.config import Settings
from graphloom.operators import sessions
from graphloom.streaming import state, windows

T0 = datetime(2024, 1, 1)


def test_scope_isolates(spark):
    rows = [("Fees?", "KTR", "s1", ("program", "x")), (" fees? ", "ktr", "S1", ("program", "x")), ("Fees?", "RMP", "s1", ("program", "x")), ("Fees?", "KTR", "s2", ("program", "x")), ("Fees?", "KTR", "s1", None), ("Fees?", None, "s1", None)]
    df = spark.createDataFrame(rows, "query string, campus string, session string, pin struct<type:string,value:string>")
    keys = [r[0] for r in df.select(sessions.scope_key(F.col("query"), F.col("campus"), F.col("session"), F.col("pin"))).collect()]
    assert keys[0] == keys[1] and len(set(keys)) == 5


@pytest.fixture(scope="module")
def requests():
    rnd = random.Random(5)
    return [(i, f"k{rnd.randint(0, 3)}", T0 + timedelta(seconds=rnd.randint(0, 40_000))) for i in range(150)]


def by_hand(rows, ttl):
    stored, out = {}, {}
    for i, k, at in sorted(rows, key=lambda r: (r[2], r[0])):
        hit = k in stored and (at - stored[k]).total_seconds() <= ttl
        if not hit:
            stored[k] = at
        out[i] = hit
    return out


def test_cache_as_by_walking(spark, requests):
    df = spark.createDataFrame(requests, "request_id long, key string, at timestamp")
    got = {r.request_id: r.hit for r in sessions.cache_hits(df, 3600).collect()}
    assert got == by_hand(requests, 3600)
    s = sessions.cache_stats(sessions.cache_hits(df, 3600)).collect()[0]
    assert s.hits == sum(got.values()) and s.requests == 150


def test_cache_stream_agrees(spark, requests, tmp_path):
    spark.createDataFrame(requests, "request_id long, key string, at timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("request_id long, key string, at timestamp").parquet(str(tmp_path / "in"))
    q = state.cache_stream(stream, 3600).writeStream.format("memory").queryName("cache_out").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r.request_id: r.hit for r in spark.table("cache_out").collect()} == by_hand(requests, 3600)


def test_memory_stream_agrees_with_batch(spark, tmp_path):
    turns = [("s", i, f"q{i}", "a" * 300, T0 + timedelta(seconds=s)) for i, s in enumerate([0, 60, 120, 180, 5000, 5060])]
    schema = "session_id string, turn_id long, question string, answer string, at timestamp"
    df = spark.createDataFrame(turns, schema)
    batch = {r.turn_id: r.context for r in sessions.context(df).collect()}
    assert batch[0] == "" and batch[3].count("User:") == 3 and batch[4] == "" and "a" * 201 not in batch[1]
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = state.memory_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("memory_out").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    stream = {r.turn_id: r.context for r in spark.table("memory_out").collect()}
    # In a stream a silence forgets the turns before it; in the batch only the first question after it is without them.
    assert [stream[i] for i in range(5)] == [batch[i] for i in range(5)] and stream[5].count("User:") == 1


def test_windows_over_a_stream(spark, tmp_path):
    rows = [(i, i % 3, "view", float(i), T0 + timedelta(minutes=7 * i)) for i in range(60)]
    schema = "event_id long, user_id long, event_type string, value double, ts timestamp"
    df = spark.createDataFrame(rows, schema)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = windows.tumbling(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), late="1 hour")
    q = stream.writeStream.format("memory").queryName("win_out").option("checkpointLocation", str(tmp_path / "c")).outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("win_out").collect())) == sorted(map(tuple, windows.tumbling(df).collect()))


def test_incremental_index(spark, tmp_path):
    schema = "url string, scraped_at timestamp, text string"
    src = str(tmp_path / "in")
    go = lambda: state.incremental_index(spark.readStream.schema(schema).parquet(src), lambda b: b.select("url"), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination(120)
    spark.createDataFrame([("a", T0, "x"), ("b", T0, "y")], schema).coalesce(1).write.parquet(src)
    go()
    spark.createDataFrame([("a", T0, "x"), ("c", T0, "z")], schema).coalesce(1).write.mode("append").parquet(src)
    go()
    assert sorted(r.url for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b", "c"]


def test_settings():
    s = Settings.from_env({"CHUNK_SIZE": "500", "RERANK": "no", "ORIGINS": "a, b"})
    assert (s.chunking.size, s.rerank, s.origins, s.retrieval.final) == (500, False, ("a", "b"), 8)
    with pytest.raises(ValueError, match="CHUNK_SIZE"):
        Settings.from_env({"CHUNK_SIZE": "many"})
    with pytest.raises(ValueError):
        Settings.from_env({"CHUNK_OVERLAP": "900"})

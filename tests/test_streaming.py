"""Streaming forms over files, each run to its end."""

import random
import time
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from brevia.streaming import streams as S

T0 = datetime(2024, 1, 1)


def drained(writer, limit=90):
    """Start a query that ends once it has read what is there."""
    query = writer.trigger(availableNow=True).start()
    try:
        assert query.awaitTermination(limit)
    finally:
        query.stop()


def files(spark, tmp_path, rows, schema, name="in"):
    path = str(tmp_path / name)
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return path, spark.readStream.schema(schema).parquet(path)


def test_level_windows_drop_late_rows(spark, tmp_path):
    schema = "ts timestamp, line string"
    path, stream = files(spark, tmp_path, [(T0 + timedelta(minutes=m), f"{'ERROR' if m % 2 else 'INFO'} {m}") for m in range(60)], schema)
    q = S.level_windows(stream).writeStream.format("memory").queryName("levels").outputMode("append").start()
    try:
        q.processAllAvailable()
        spark.createDataFrame([(T0 + timedelta(hours=3), "INFO late")], schema).coalesce(1).write.mode("append").parquet(path)
        q.processAllAvailable()
        spark.createDataFrame([(T0, "ERROR too late")], schema).coalesce(1).write.mode("append").parquet(path)
        q.processAllAvailable()
    finally:
        q.stop()
    got = {(r.start, r.level): r.n for r in spark.table("levels").collect()}
    assert got == {(T0, "error"): 30, (T0, "info"): 30}


def test_prefix_changes_equal_the_batch_form(spark, tmp_path):
    # more than ten rows: positions keep their numeric order
    rows = [(c, t, f"text {t // 2}") for c in ("a", "b") for t in range(14)]
    _, stream = files(spark, tmp_path, rows, "conv string, turn int, text string")
    drained(S.prefix_changes(stream, "conv", F.col("text"), "turn").writeStream.format("memory").queryName("drift").outputMode("append"))
    got = sorted((r.key, r.pos, r.prefix_changed) for r in spark.table("drift").collect())
    assert got == [(c, t, t > 0 and t % 2 == 0) for c in ("a", "b") for t in range(14)]


def test_store_states(spark, tmp_path):
    _, stream = files(spark, tmp_path, [("h1", "x"), ("h1", "xy"), ("h2", "z")], "hash string, payload string")
    # processing-time timeouts keep the query going, so it is watched and stopped
    q = S.store_states(stream).writeStream.format("memory").queryName("states").outputMode("append").start()
    try:
        for _ in range(180):
            if spark.table("states").count() >= 2:
                break
            time.sleep(0.5)
    finally:
        q.stop()
    assert sorted(map(tuple, spark.table("states").collect())) == [("h1", "put", 2), ("h2", "put", 1)]


def test_bounded_store_equals_a_dictionary(spark, tmp_path):
    rng, schema = random.Random(5), "store string, seq long, ts timestamp, op string, hash string, payload string"
    events = [(rng.choice("ab"), i, T0 + timedelta(seconds=20 * i), rng.choice(["put", "get"]), rng.choice("uvwxyz"), f"p{i}") for i in range(300)]
    path, _ = files(spark, tmp_path, events[:150], schema)
    time.sleep(1.1)  # files are read in the order of their times
    files(spark, tmp_path, events[150:], schema)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    drained(S.bounded_store(stream, 3, 200).writeStream.format("memory").queryName("bounded").outputMode("append"))
    held, want = {"a": {}, "b": {}}, []
    for s, i, ts, op, h, p in events:
        d, out, evicted = held[s], ("miss", None), None
        if op == "put":
            out = ("refresh" if h in d else "put", None)
            if h not in d and len(d) == 3:
                evicted = list(d)[0]
                del d[evicted]
            d[h] = (p, ts)
        elif h in d and ts - d[h][1] > timedelta(seconds=200):
            out = ("expired", None)
            del d[h]
        elif h in d:
            out = ("hit", d[h][0])
        want.append((s, i, op, h, *out, evicted))
    got = sorted(map(tuple, spark.table("bounded").collect()), key=lambda r: r[1])
    assert got == want and {r[4] for r in got} == {"put", "refresh", "hit", "miss", "expired"}


def test_classified_stream(spark, tmp_path):
    _, stream = files(spark, tmp_path, [(1, "[1,2]"), (2, "prose")], "id int, text string")
    drained(S.classified(stream).writeStream.format("memory").queryName("kinds").outputMode("append"))
    assert {r.id: r.content_type for r in spark.table("kinds").collect()} == {1: "json_array", 2: "text"}

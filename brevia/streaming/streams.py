"""Structured Streaming forms: live level counts, compression of arriving blocks, a keyed store with a time to live, drift.

Every stateful form bounds its state: by a watermark, by a time to live, by a capacity, or by one value per key.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import detect, lines
from ..sources.store import CAPACITY, TTL_SECONDS


def level_windows(rows: DataFrame, time_col: str = "ts", late: str = "10 minutes", length: str = "1 hour") -> DataFrame:
    """Lines by level and window of event time, for (ts, line); late rows beyond the watermark are dropped."""
    typed = rows.withColumn("level", lines.level(F.col("line")))
    return typed.withWatermark(time_col, late).groupBy(F.window(time_col, length), "level").agg(F.count("*").alias("n")).select("window.start", "window.end", "level", "n")


def sessions(rows: DataFrame, key: str, time_col: str = "ts", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of a key: events closer than ``gap``."""
    return rows.withWatermark(time_col, late).groupBy(F.session_window(time_col, gap).alias("s"), key).agg(F.count("*").alias("n")).select(key, "s.start", "s.end", "n")


def classified(blocks: DataFrame, text_col: str = "text") -> DataFrame:
    """Arriving blocks with their content type; stateless."""
    return detect.classify(blocks, text_col)


def store_states(puts: DataFrame, ttl_seconds: int = 300, key: str = "hash") -> DataFrame:
    """(hash, event, payload_bytes) of a stream of puts (hash, payload): ``put``, ``refresh`` or ``expired`` after the time to live.

    One value per key is kept, and it goes by a processing-time timeout.
    """
    out = "hash string, event string, payload_bytes long"

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            size = state.get[0]
            state.remove()
            yield pd.DataFrame({"hash": [k[0]], "event": ["expired"], "payload_bytes": [size]})
            return
        rows = pd.concat(list(batches))
        size = len(rows["payload"].iloc[-1].encode())
        event = "refresh" if state.exists else "put"
        state.update((size,))
        state.setTimeoutDuration(ttl_seconds * 1000)
        yield pd.DataFrame({"hash": [k[0]], "event": [event], "payload_bytes": [size]})

    return puts.groupBy(key).applyInPandasWithState(run, out, "size long", "append", GroupStateTimeout.ProcessingTimeTimeout)


EVENT = "store string, seq long, op string, hash string, outcome string, payload string, evicted string"


def bounded_store(events: DataFrame, capacity: int = CAPACITY, ttl_seconds: int = TTL_SECONDS) -> DataFrame:
    """What each put and get of a stream of (store, seq, ts, op, hash, payload) did to its store.

    A store (a session, a tenant) is a key of the stream; its events are applied by ``seq`` within a batch, and ``ts``
    is the only clock, so that a batch that runs again has the same result. Outcomes: ``put``, ``refresh`` (a known key
    has a new payload and time, but keeps its place), ``hit`` (with the payload), ``miss``, ``expired``; ``evicted`` is
    the key that a put beyond the capacity pushed out, the one put first. The state of a store is one row of at most
    ``capacity`` payloads.
    """

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = {h: (p, t) for h, p, t in zip(*state.get)} if state.exists else {}  # in order of the first put
        rows = []
        for e in pd.concat(list(batches)).sort_values("seq", kind="stable").itertuples():
            outcome, payload, evicted, now = "miss", None, None, e.ts.value // 1000
            if e.op == "put":
                outcome = "refresh" if e.hash in held else "put"
                if outcome == "put" and len(held) >= capacity:
                    evicted = next(iter(held))
                    del held[evicted]
                held[e.hash] = (e.payload, now)
            elif e.hash in held:
                payload, put_at = held[e.hash]
                outcome = "hit"
                if now - put_at > ttl_seconds * 1_000_000:
                    outcome, payload = "expired", None
                    del held[e.hash]
            rows.append((k[0], e.seq, e.op, e.hash, outcome, payload, evicted))
        state.update((list(held), [p for p, _ in held.values()], [t for _, t in held.values()]))
        yield pd.DataFrame(rows, columns=["store", "seq", "op", "hash", "outcome", "payload", "evicted"])

    taken = events.select("store", "seq", "ts", "op", "hash", "payload")
    return taken.groupBy("store").applyInPandasWithState(run, EVENT, "hashes array<string>, payloads array<string>, times array<long>", "append", GroupStateTimeout.NoTimeout)


def prefix_changes(rows: DataFrame, key: str, text: Column, order: str) -> DataFrame:
    """(key, pos, prefix_hash, previous_hash, prefix_changed) of a stream; the last hash of each key is its state. Positions keep the type, and so the order, of ``order``."""
    hashed = rows.select(F.col(key).cast("string").alias("key"), F.left(F.sha2(text, 256), F.lit(16)).alias("prefix_hash"), F.col(order).alias("pos"))

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        part = pd.concat(list(batches)).sort_values("pos")
        before = [state.get[0] if state.exists else None, *part["prefix_hash"].iloc[:-1]]
        state.update((part["prefix_hash"].iloc[-1],))
        changed = [b is not None and b != h for b, h in zip(before, part["prefix_hash"])]
        yield pd.DataFrame({"key": part["key"], "pos": part["pos"], "prefix_hash": part["prefix_hash"], "previous_hash": before, "prefix_changed": changed})

    return hashed.groupBy("key").applyInPandasWithState(run, f"key string, pos {dict(hashed.dtypes)['pos']}, prefix_hash string, previous_hash string, prefix_changed boolean", "last string", "append", GroupStateTimeout.NoTimeout)


def into_store(stream: DataFrame, store, checkpoint: str):
    """Write a stream of (hash, payload, inserted_at) into a store, batch by batch; batches that come again only refresh."""
    return stream.writeStream.foreachBatch(lambda df, _: store.put(df)).option("checkpointLocation", checkpoint)

"""The retrieval store: payloads by key, with a time to live and a capacity, as a table in a folder.

Writes append; reads keep the newest row of a key and drop what is older than the time to live. A capacity keeps
the keys that were first put last (first in, first out; putting a key again refreshes its time, not its place).
"""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.hashing import payload_key

ROW = "hash string, payload string, inserted_at timestamp"
CAPACITY, TTL_SECONDS = 1000, 300


class Store(Protocol):
    """What a store can do; keys and payloads are columns."""

    def put(self, rows: DataFrame) -> None: ...

    def get(self, keys: DataFrame, now: Column | None = None) -> DataFrame: ...

    def size(self, now: Column | None = None) -> int: ...


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for a store in the folder that driver and executors share; a temporary one only in a local session without it."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="stores-")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def keyed(blocks: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows of the store for blocks of text, put now."""
    return blocks.select(payload_key(F.col(text_col)).alias("hash"), F.col(text_col).alias("payload"), F.current_timestamp().alias("inserted_at"))


def marker(key: Column) -> Column:
    return F.concat(F.lit("<<ccr:"), key, F.lit(">>"))


def latest(rows: DataFrame) -> DataFrame:
    """(hash, payload, inserted_at, first_at): the newest payload of each key; combines before its shuffle."""
    return rows.groupBy("hash").agg(F.max_by("payload", "inserted_at").alias("payload"), F.max("inserted_at").alias("inserted_at"), F.min("inserted_at").alias("first_at"))


def live(rows: DataFrame, ttl: int = TTL_SECONDS, capacity: int | None = None, now: Column | None = None) -> DataFrame:
    """Rows that a read at ``now`` would see."""
    now = F.current_timestamp() if now is None else now
    out = latest(rows)
    if capacity is not None:
        # a bounded top-k: each partition keeps ``capacity`` rows before they meet
        kept = out.select("hash", "first_at").orderBy(F.desc("first_at"), "hash").limit(capacity)
        out = out.join(kept.select("hash"), "hash", "left_semi")
    return out.where(F.col("inserted_at") > now - F.make_dt_interval(secs=F.lit(ttl)))


@dataclass
class FolderStore:
    """A store in a folder of Parquet files."""

    spark: SparkSession
    path: str
    ttl: int = TTL_SECONDS
    capacity: int | None = CAPACITY

    def put(self, rows: DataFrame) -> None:
        rows.select("hash", "payload", "inserted_at").write.mode("append").parquet(self.path)

    def rows(self) -> DataFrame:
        return self.spark.read.schema(ROW).parquet(self.path)

    def get(self, keys: DataFrame, now: Column | None = None) -> DataFrame:
        """(hash, payload) for keys (hash); payload is null where the key is unknown or has expired."""
        return keys.join(live(self.rows(), self.ttl, self.capacity, now).select("hash", "payload"), "hash", "left")

    def size(self, now: Column | None = None) -> int:
        return live(self.rows(), self.ttl, self.capacity, now).count()

    def compact(self, path: str) -> None:
        """Live rows alone, rewritten to a new folder."""
        live(self.rows(), self.ttl, self.capacity).select("hash", "payload", "inserted_at").write.parquet(path)


@dataclass
class SqliteStore:
    """A store in one SQLite file on the driver, for small sets of payloads; expired rows count in its size."""

    spark: SparkSession
    path: str
    ttl: int = TTL_SECONDS
    most: int = 100_000

    def _open(self):
        import sqlite3

        db = sqlite3.connect(self.path)
        db.execute("CREATE TABLE IF NOT EXISTS payloads (hash TEXT PRIMARY KEY, payload TEXT NOT NULL, inserted_at INTEGER NOT NULL)")
        return db

    def put(self, rows: DataFrame) -> None:
        found = rows.select("hash", "payload", F.unix_timestamp("inserted_at").alias("at")).limit(self.most + 1).collect()
        if len(found) > self.most:
            raise ValueError("too many payloads for a file on the driver: use a folder store")
        with self._open() as db:
            db.executemany("INSERT INTO payloads VALUES (?, ?, ?) ON CONFLICT(hash) DO UPDATE SET payload = excluded.payload, inserted_at = excluded.inserted_at", [tuple(r) for r in found])

    def get(self, keys: DataFrame, now: int | None = None) -> DataFrame:
        import time

        since = (int(time.time()) if now is None else now) - self.ttl
        with self._open() as db:
            rows = db.execute("SELECT hash, payload FROM payloads WHERE inserted_at > ?", (since,)).fetchall()
        return keys.join(self.spark.createDataFrame(rows, "hash string, payload string"), "hash", "left")

    def size(self, now: Column | None = None) -> int:
        with self._open() as db:
            return db.execute("SELECT count(*) FROM payloads").fetchone()[0]


@dataclass
class RedisStore:
    """A store in Redis, written by the executors; its size is not known (0). Needs the redis package there."""

    spark: SparkSession
    url: str
    prefix: str = "ccr:"
    ttl: int = TTL_SECONDS

    def put(self, rows: DataFrame) -> None:
        url, prefix, ttl = self.url, self.prefix, self.ttl

        def send(part) -> None:
            import redis

            client = redis.Redis.from_url(url)
            with client.pipeline(transaction=False) as pipe:
                for n, r in enumerate(part, 1):
                    pipe.setex(prefix + r["hash"], ttl, r["payload"])
                    if n % 1000 == 0:
                        pipe.execute()
                pipe.execute()

        rows.select("hash", "payload").foreachPartition(send)

    def get(self, keys: DataFrame, now: Column | None = None) -> DataFrame:
        url, prefix = self.url, self.prefix

        def fetch(batches):
            import redis

            client = redis.Redis.from_url(url)
            for b in batches:
                found = client.mget([prefix + h for h in b["hash"]]) if len(b) else []
                yield b.assign(payload=[None if x is None else x.decode() for x in found])

        return keys.select("hash").mapInPandas(fetch, "hash string, payload string")

    def size(self, now: Column | None = None) -> int:
        return 0


def open_store(spark: SparkSession, backend: str = "", location: str = "", ttl: int = TTL_SECONDS, capacity: int = CAPACITY) -> Store:
    """A store by the name of its backend: folder (also '' and inmemory), sqlite or redis."""
    if backend in ("", "inmemory", "folder"):
        return FolderStore(spark, location, ttl, capacity)
    if backend == "sqlite":
        return SqliteStore(spark, location, ttl)
    if backend == "redis":
        return RedisStore(spark, location, ttl=ttl)
    raise ValueError(f"unknown store backend {backend!r}")

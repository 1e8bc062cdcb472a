"""Helpers of the operators: shared written tables, row ids, size-checked semi and anti joins, components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ids that may be broadcast at most (16 MB of longs); a larger side is joined by a shuffle.
BROADCAST_IDS = 2_000_000
#: Rows of an Arrow batch of texts.
BATCH_ROWS = 1_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it in spark.checkpoint.dir.

    Only a local session without that setting gets a temporary folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """At most ``BATCH_ROWS`` rows of whole texts in an Arrow batch of this session, so that workers stay small; never more than set."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def written(df: DataFrame, name: str = "t") -> DataFrame:
    """df, written once as Parquet in the shared folder and read back: it cuts the lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_path = path  # for drop()
    return out


def drop(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more."""
    for t in tables:
        jvm = t.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(t._written_path)
        path.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def keyed_filter(df: DataFrame, ids: DataFrame, key: str, how: str = "left_semi", n: int | None = None) -> DataFrame:
    """Semi or anti join with distinct ids; the ids are broadcast only after a count shows that they are few."""
    n = ids.count() if n is None else n
    return df.join(F.broadcast(ids) if n <= BROADCAST_IDS else ids, key, how)


def components(edges: DataFrame) -> DataFrame:
    """(id, label): the smallest id that each node of the undirected edges (a, b) reaches.

    Alternating large and small star rounds; each round is a written table, so a hub only ever meets a
    min aggregate (combined before the shuffle) and a join that can be split.
    """
    e = written(edges.where("a <> b").selectExpr("greatest(a, b) AS a", "least(a, b) AS b").distinct(), "star")
    before = None
    while True:
        both = e.unionByName(e.selectExpr("b AS a", "a AS b"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        big = both.where("b > a").join(low, "a").selectExpr("b AS a", "m AS b").union(low.where("a <> m").select("a", "m")).distinct()
        least = big.groupBy("a").agg(F.min("b").alias("m"))
        small = big.join(least, "a").where("b <> m").selectExpr("b AS a", "m AS b").union(least.select("a", "m")).distinct()
        nxt = written(small, "star")
        # the sum of targets only falls; with the number of edges it stays the same at the fixed point alone
        now = nxt.agg(F.count("*"), F.sum(F.col("b").cast("decimal(38,0)")), F.sum(F.col("a").cast("decimal(38,0)"))).first()
        drop(e)
        e = nxt
        if now == before:
            break
        before = now
    roots = e.selectExpr("b AS id", "b AS label").distinct()
    return e.selectExpr("a AS id", "b AS label").union(roots)

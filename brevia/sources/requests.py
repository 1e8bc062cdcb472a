"""Sources and sinks of requests, fixtures, recommendations and manifests."""

from __future__ import annotations

import tomllib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMATS = ("messages", "chat", "responses")
REQUEST = "request_id string, format string, mode string, headers map<string,string>, body string"


def read_requests(spark: SparkSession, path: str, source_format: str = "json", **options: str) -> DataFrame:
    """Requests (request_id, format, mode, headers, body) from any source that Spark reads; the body stays text."""
    return spark.read.schema(REQUEST).options(**options).format(source_format).load(path)


def known_format(requests: DataFrame) -> DataFrame:
    """Requests with an error column where the wire format is unknown."""
    return requests.withColumn("error", F.when(~F.col("format").isin(*FORMATS), F.concat(F.lit("unknown format "), "format")))


def messages(requests: DataFrame) -> DataFrame:
    """(request_id, msg_idx, role, content VARIANT) of bodies with messages or an input array."""
    body = requests.select("request_id", F.try_parse_json("body").alias("v"))
    rows = body.select("request_id", F.coalesce(F.try_variant_get("v", "$.messages", "array<variant>"), F.try_variant_get("v", "$.input", "array<variant>")).alias("m"))
    items = rows.select("request_id", F.posexplode("m").alias("msg_idx", "item"))
    return items.select("request_id", "msg_idx", F.try_variant_get("item", "$.role", "string").alias("role"), F.try_variant_get("item", "$.content", "variant").alias("content"))


def cache_marks(requests: DataFrame) -> DataFrame:
    """(request_id, section, pos, msg_idx, ttl) of the blocks with a cache mark in messages, system and tools."""
    body = requests.select("request_id", F.try_parse_json("body").alias("v"))

    def section(name: str, rows: DataFrame, block: str, idx: str) -> DataFrame:
        mark = F.try_variant_get(block, "$.cache_control", "variant")
        return rows.where(mark.isNotNull()).select("request_id", F.lit(name).alias("section"), F.col("pos").cast("long").alias("pos"), F.expr(idx).cast("int").alias("msg_idx"), F.try_variant_get(block, "$.cache_control.ttl", "string").alias("ttl"))

    msgs = body.select("request_id", F.posexplode(F.try_variant_get("v", "$.messages", "array<variant>")).alias("i", "m")).select("request_id", "i", F.posexplode(F.try_variant_get("m", "$.content", "array<variant>")).alias("j", "b")).withColumn("pos", F.col("i") * 100_000 + F.col("j"))
    out = section("messages", msgs, "b", "i")
    for name in ("system", "tools"):
        rows = body.select("request_id", F.posexplode(F.try_variant_get("v", f"$.{name}", "array<variant>")).alias("pos", "b"))
        out = out.unionByName(section(name, rows, "b", "NULL"))
    return out


def read_fixtures(spark: SparkSession, folder: str, by_time: bool = False) -> DataFrame:
    """(name, doc) of a folder of JSON files, by name or by their recorded_at; the document stays text."""
    rows = spark.read.option("wholetext", True).text(folder).select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("name"), F.col("value").alias("doc"))
    order = [F.get_json_object("doc", "$.recorded_at"), F.col("name")] if by_time else [F.col("name")]
    return rows.orderBy(*order)


def recommendations(spark: SparkSession, text: str) -> DataFrame:
    """Recommendations of a TOML text (tables [[recommendation]]) as a small table."""
    rows = [{k: str(v) for k, v in r.items()} for r in tomllib.loads(text).get("recommendation", [])]
    names = sorted({k for r in rows for k in r} | {"id", "content_type"})
    schema = ", ".join(f"`{n}` string" for n in names)
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)


def write_manifest(manifest: DataFrame, path: str) -> None:
    """Part outcomes without their texts, by action."""
    manifest.drop("compressed", "payload").write.mode("append").partitionBy("action").parquet(path)


def manifest_totals(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("request_id").agg(F.count_if(F.col("action") == "compressed").alias("compressed_parts"), F.sum("original_tokens").alias("original_tokens"), F.sum("compressed_tokens").alias("compressed_tokens"))


def observed(crushed: DataFrame, name: str = "crush") -> DataFrame:
    """A crush result with run metrics (rows, changed rows, bytes in and out) for a query listener."""
    return crushed.observe(name, F.count("*").alias("rows"), F.count_if(F.col("was_modified")).alias("changed"), F.sum(F.octet_length("text")).alias("bytes_in"), F.sum(F.octet_length("compressed")).alias("bytes_out"))


def report(expected: DataFrame, found: DataFrame) -> dict[str, int]:
    """Rows that agree, that are missing and that are extra, by exact comparison."""
    missing, extra = expected.exceptAll(found).count(), found.exceptAll(expected).count()
    return {"passed": expected.count() - missing, "missing": missing, "extra": extra}

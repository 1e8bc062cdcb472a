"""Request policy: kind of access, what may be changed, cache marks, tool pairs, stable prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Marks of subscription clients in a User-Agent, and the policy by kind of access.
SUBSCRIPTION_AGENTS = ("claude-cli/", "claude-code/", "codex-cli/", "cursor/", "claude-vscode/", "github-copilot/", "anthropic-cli/", "antigravity/")
POLICIES = {
    "payg": {"live_zone_only": False, "align_cache": True, "volatile_tokens": 128, "max_lossy_ratio": 0.45, "learning": "readwrite"},
    "oauth": {"live_zone_only": False, "align_cache": True, "volatile_tokens": 128, "max_lossy_ratio": 0.45, "learning": "readwrite"},
    "subscription": {"live_zone_only": True, "align_cache": False, "volatile_tokens": 32, "max_lossy_ratio": 0.25, "learning": "readonly"},
}
CACHE_WRITE, CACHE_READ, BREAK_EVEN = 1.25, 0.1, 11.5


def header(headers: Column, name: str) -> Column:
    """A header whatever the case of its name; empty where it is missing."""
    found = F.map_filter(headers, lambda k, v: F.lower(k) == name.lower())
    return F.coalesce(F.try_element_at(F.map_values(found), F.lit(1)), F.lit(""))


def auth_mode(headers: Column) -> Column:
    """payg, oauth or subscription by a request's headers."""
    agent, auth = F.lower(header(headers, "user-agent")), header(headers, "authorization")
    client = F.lit(False)
    for mark in SUBSCRIPTION_AGENTS:
        client = client | agent.contains(mark)
    token = F.substring(auth, 8, 1 << 20)
    bearer = F.when(token.startswith("sk-ant-oat-"), "oauth").when(token.startswith("sk-"), "payg").otherwise("oauth")
    return F.when(client, "subscription").when(auth == "", "payg").when(auth.startswith("Bearer "), bearer).otherwise("oauth")


def policy(mode: Column) -> Column:
    """STRUCT of the policy of a kind of access."""
    def row(p: dict) -> Column:
        return F.struct(*(F.lit(v).alias(k) for k, v in p.items()))

    return F.when(mode == "subscription", row(POLICIES["subscription"])).otherwise(row(POLICIES["payg"]))


def mutation_gain(delta: Column, suffix: Column, reads: Column, alive: Column) -> Column:
    """Tokens won by changing a cached prefix: savings now and at later reads, less rewriting the suffix if the cache lives."""
    r = F.when(F.isnan(reads), 0.0).otherwise(F.greatest(reads, F.lit(0.0)))
    p = F.when(F.isnan(alive), 1.0).otherwise(F.least(F.greatest(alive, F.lit(0.0)), F.lit(1.0)))
    return delta * (CACHE_WRITE + CACHE_READ * (r - 1)) - p * (CACHE_WRITE - CACHE_READ) * suffix


def should_mutate(delta: Column, suffix: Column, reads: Column, alive: Column) -> Column:
    return mutation_gain(delta, suffix, reads, alive) > 0


def break_even_reads(delta: Column, suffix: Column) -> Column:
    return F.when(delta == 0, 0.0).otherwise(BREAK_EVEN * (suffix / F.nullif(delta, F.lit(0)) - 1))


def frozen_prefix(messages: DataFrame, key: str = "request_id") -> DataFrame:
    """(key, frozen): one past the last message with a cache mark, 0 without any; rows (key, msg_idx, has_mark)."""
    return messages.groupBy(key).agg(F.coalesce(F.max(F.when(F.col("has_mark"), F.col("msg_idx"))) + 1, F.lit(0)).alias("frozen"))


def ttl_violations(marks: DataFrame, key: str = "request_id") -> DataFrame:
    """(key, section, violated): a 1h mark after a 5m one (or one without a ttl), in (key, section, pos, ttl)."""
    short = F.coalesce(F.col("ttl"), F.lit("5m")) == "5m"
    w = Window.partitionBy(key, "section").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.coalesce(F.max(short.cast("int")).over(w), F.lit(0)) == 1
    return marks.withColumn("_bad", seen & (F.col("ttl") == "1h")).groupBy(key, "section").agg(F.coalesce(F.bool_or("_bad"), F.lit(False)).alias("violated"))


def tool_pairs(messages: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, call_idx, result_idx): tool results and the last assistant message that announced their id.

    ``messages`` has (key, msg_idx, role, call_ids array, tool_call_id).
    """
    calls = messages.where("role = 'assistant'").select(key, "msg_idx", F.explode("call_ids").alias("call_id")).where("call_id <> ''")
    last = calls.groupBy(key, "call_id").agg(F.max("msg_idx").alias("call_idx"))
    results = messages.where("role = 'tool' AND tool_call_id <> ''").select(key, F.col("tool_call_id").alias("call_id"), F.col("msg_idx").alias("result_idx"))
    return results.join(last, [key, "call_id"]).select(key, "call_idx", "result_idx").distinct()


def last_index(messages: DataFrame, role: str, key: str, idx: str) -> DataFrame:
    """Messages with the index of the last one of a role in their conversation (null without any)."""
    return messages.withColumn(f"last_{role}", F.max(F.when(F.col("role") == role, F.col(idx))).over(Window.partitionBy(key)))


def aligned_prefix(messages: DataFrame, key: str = "conv_id", patterns: tuple[str, ...] = (r"\d{4}-\d{2}-\d{2}",), separator: str = "\n\n---\n[Dynamic Context]\n") -> DataFrame:
    """System messages with dates moved to a tail, and (stable_hash, stable_bytes) of what remains, by conversation."""
    content, moved = F.col("text"), F.array().cast("array<string>")
    for p in patterns:
        moved = F.concat(moved, F.regexp_extract_all(content, F.lit(p), F.lit(0)))
        content = F.regexp_replace(content, p, "")
    rows = messages.where("role = 'system'").select(key, "msg_idx", content.alias("stripped"), moved.alias("moved"))
    out = rows.withColumn("aligned", F.when(F.size("moved") > 0, F.concat("stripped", F.lit(separator), F.array_join("moved", "\n"))).otherwise(F.col("stripped")))
    prefix = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("msg_idx", "stripped"))), lambda x: x["stripped"]), "\n---\n")
    return out.groupBy(key).agg(prefix.alias("prefix"), F.sum(F.size("moved")).alias("n_moved")).select(key, F.left(F.sha2("prefix", 256), F.lit(16)).alias("stable_hash"), F.octet_length("prefix").alias("stable_bytes"), "n_moved")


def prefix_drift(rows: DataFrame, text: Column, key: str, order: str) -> DataFrame:
    """Rows with the hash of their text, the previous one of the key and whether it changed (false at first)."""
    w = Window.partitionBy(key).orderBy(order)
    out = rows.withColumn("prefix_hash", F.left(F.sha2(text, 256), F.lit(16))).withColumn("previous_hash", F.lag("prefix_hash").over(w))
    return out.withColumn("prefix_changed", F.coalesce(F.col("previous_hash") != F.col("prefix_hash"), F.lit(False)))

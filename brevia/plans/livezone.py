"""Live parts of request bodies: which message blocks may be shortened, their compression, and the new body.

A request is one row. Routing reads the body once in an Arrow function and returns the parts with their verdict;
the parts are then a table, compressed by type in the functions of ``operators.compress`` under a size gate and a
token gate, and put back by a second function. No step looks across requests; the regrouping of parts is the one
shuffle, by request.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import arrays, difftext, hits, loglines
from ..functions.tokens import counter
from ..operators import detect

LEAST_BYTES = 512
DEFAULT_MODEL = "gpt-4o"
TOOL_OUTPUTS = ("function_call_output", "local_shell_call_output", "apply_patch_call_output")
PART = "request_id string, part int, path array<string>, idx int, action string, reason string, text string, model string"
#: What a request's parts say about it if nothing can be done: a row without a part.
NONE = -1


def _rows(content: Any) -> list[tuple[list[str], str]]:
    """(path, text) of the long enough texts of a message's content in the Messages format."""
    if isinstance(content, str):
        found = [(["content"], content)]
    else:
        keys = {"tool_result": "content", "text": "text"}
        found = [(["content", str(i), keys[b["type"]]], b.get(keys[b["type"]])) for i, b in enumerate(content if isinstance(content, list) else []) if isinstance(b, dict) and b.get("type") in keys]
    return [(p, t) for p, t in found if isinstance(t, str) and len(t.encode()) >= LEAST_BYTES]


def _marked(content: Any) -> bool:
    return isinstance(content, list) and any(isinstance(b, dict) and "cache_control" in b for b in content)


def _long(text: Any) -> bool:
    return isinstance(text, str) and len(text.encode()) >= LEAST_BYTES


def messages_parts(body: dict) -> Iterator[tuple]:
    """Parts (path, index, action, reason, text) of a body in the Messages format, or one reason why there are none."""
    messages = body.get("messages")
    if "messages" not in body:
        yield [], NONE, "none", "no_messages", None
        return
    if not isinstance(messages, list) or not messages:
        yield [], NONE, "none", "empty_messages" if isinstance(messages, list) else "messages_not_array", None
        return
    frozen = max((i + 1 for i, m in enumerate(messages) if isinstance(m, dict) and _marked(m.get("content"))), default=0)
    live = max((i for i, m in enumerate(messages) if i >= frozen and isinstance(m, dict) and m.get("role") == "user"), default=None)
    if live is None:
        yield [], NONE, "none", "no_live_user_message", None
        return
    if "system" in body:
        yield [], -1, "excluded", "system_message", None
    if isinstance(body.get("tools"), list) and body["tools"]:
        yield [], -2, "excluded", "tool_definition", None
    for i, m in enumerate(messages):
        if not isinstance(m, dict):
            continue
        content = m.get("content")
        if _marked(content):
            yield [], i, "excluded", "cache_control", None
        elif i < live:
            yield [], i, "excluded", "frozen_by_policy", None
        elif i > live:
            if m.get("role") == "assistant":
                yield [], i, "excluded", "latest_assistant", None
        else:
            rows = _rows(content)
            if not rows:
                yield [], i, "excluded", "too_small", None
            for path, text in rows:
                yield ["messages", str(i), *path], i, "candidate", None, text


def chat_parts(body: dict) -> Iterator[tuple]:
    """Parts of a body in the Chat format: the latest tool and user messages, and tool messages after either."""
    messages = body.get("messages")
    if "messages" not in body:
        yield [], NONE, "none", "no_messages", None
        return
    if not isinstance(messages, list) or not messages:
        yield [], NONE, "none", "empty_messages" if isinstance(messages, list) else "messages_not_array", None
        return
    last = {role: max((i for i, m in enumerate(messages) if isinstance(m, dict) and m.get("role") == role), default=-1) for role in ("tool", "user")}
    if max(last.values()) < 0:
        yield [], NONE, "none", "no_live_zone_candidates", None
        return
    floor = min(i for i in last.values() if i >= 0)
    for i, m in enumerate(messages):
        if not isinstance(m, dict):
            continue
        role, content = m.get("role"), m.get("content")
        if role in ("system", "developer"):
            yield [], i, "excluded", "system_message", None
        elif i < floor:
            yield [], i, "excluded", "frozen_by_policy", None
        elif role == "assistant":
            yield [], i, "excluded", "latest_assistant" if i > last["user"] or i > last["tool"] else "frozen_by_policy", None
        elif role == "tool" and _long(content):
            yield ["messages", str(i), "content"], i, "candidate", None, content
        elif role == "user" and i == last["user"]:
            if _long(content):
                yield ["messages", str(i), "content"], i, "candidate", None, content
            for j, p in enumerate(content if isinstance(content, list) else []):
                if isinstance(p, dict) and p.get("type") == "text" and _long(p.get("text")):
                    yield ["messages", str(i), "content", str(j), "text"], i, "candidate", None, p["text"]


def responses_parts(body: dict) -> Iterator[tuple]:
    """Parts of a body in the Responses format: all tool outputs and all input texts of messages."""
    key = next((k for k in ("input", "messages") if isinstance(body.get(k), list)), None)
    if key is None or not body[key] or isinstance(body.get("input"), str):
        yield [], NONE, "none", "no_input" if key is None else "empty_input" if not body[key] else "string_input", None
        return
    for i, item in enumerate(body[key]):
        if not isinstance(item, dict):
            continue
        if item.get("type") in TOOL_OUTPUTS:
            if _long(item.get("output")):
                yield [key, str(i), "output"], i, "candidate", None, item["output"]
            else:
                yield [], i, "excluded", "too_small", None
        elif item.get("type") == "message":
            for j, p in enumerate(item["content"] if isinstance(item.get("content"), list) else []):
                if isinstance(p, dict) and p.get("type") == "input_text" and _long(p.get("text")):
                    yield [key, str(i), "content", str(j), "text"], i, "candidate", None, p["text"]


ROUTES = {"messages": messages_parts, "chat": chat_parts, "responses": responses_parts}


def parts(requests: DataFrame) -> DataFrame:
    """The parts of requests (request_id, format, mode, body) with their verdicts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples():
                model = DEFAULT_MODEL
                if r.mode == "off":
                    found = [([], NONE, "none", "mode_off", None)]
                elif r.format not in ROUTES:
                    found = [([], NONE, "error", f"unknown format {r.format}", None)]
                else:
                    try:
                        body = json.loads(r.body)
                        if not isinstance(body, dict):
                            raise ValueError("not an object")
                        model = body.get("model") if isinstance(body.get("model"), str) and body.get("model") else DEFAULT_MODEL
                        found = list(ROUTES[r.format](body))
                    except (ValueError, TypeError) as e:
                        found = [([], NONE, "error", f"invalid body: {e}"[:200], None)]
                out += [(r.request_id, n, list(p), i, a, why, t, model) for n, (p, i, a, why, t) in enumerate(found)]
            yield pd.DataFrame(out, columns=["request_id", "part", "path", "idx", "action", "reason", "text", "model"])

    return requests.select("request_id", "format", F.coalesce("mode", F.lit("auto")).alias("mode"), "body").mapInPandas(run, PART)


def shorten(kind: str, text: str) -> tuple[str, str] | None:
    """(strategy, shorter text) of a part by its content type; sizes collapse to the least, as no bias is wanted here."""
    if kind == "json_array":
        out, changed, _ = arrays.crush(text, "", 0.0)
        return ("smart_crusher", out) if changed else None
    if kind == "build":
        out = loglines.compress(text, 0.0, store=True).text
        return ("log_compressor", out) if out != text else None
    if kind == "search":
        out = hits.compress(text, "", 0.0).text
        return ("search_compressor", out) if out != text else None
    if kind == "diff":
        out = difftext.compress(text).text
        return ("diff_compressor", out) if out != text else None
    return None


def shortened(text: Column, kind: Column, model: Column, store: bool = False) -> Column:
    """STRUCT<compressed, strategy, original_tokens, compressed_tokens, key>; compressed is null where nothing is won."""

    @F.pandas_udf("compressed string, strategy string, original_tokens int, compressed_tokens int, key string")
    def run(text: pd.Series, kind: pd.Series, model: pd.Series) -> pd.DataFrame:
        rows = []
        for t, k, m in zip(text, kind, model):
            if t is None:
                rows.append((None, None, 0, 0, None))
                continue
            count = counter(m)
            before = count(t)
            found = shorten(k, t)
            key = None
            if found and store:
                key = hashlib.sha256(t.encode()).hexdigest()[:24]
                found = (found[0], found[1] + ("" if found[1].endswith("\n") else "\n") + f"<<ccr:{key}>>")
            after = count(found[1]) if found else before
            rows.append((found[1], found[0], before, after, key) if found and after < before else (None, None, before, before, None))
        return pd.DataFrame(rows, columns=["compressed", "strategy", "original_tokens", "compressed_tokens", "key"])

    return run.asNondeterministic()(text, kind, model)  # so that filters on it are not pushed through detection


def manifest(requests: DataFrame, store: bool = False) -> DataFrame:
    """One row per part: action (excluded, passthrough, compressed, none, error), strategy, tokens, new text, key."""
    # one pass over the bodies: settled parts have no text, so that nothing looks at them
    typed = detect.classify(parts(requests))
    done = typed.withColumn("r", shortened(F.col("text"), F.col("content_type"), F.col("model"), store))
    open_part = F.col("action") == "candidate"
    won = F.when(F.col("r.compressed").isNotNull(), "compressed").otherwise("passthrough")
    only = lambda c: F.when(open_part, c)
    return done.select(
        "request_id", "part", "path", "idx", F.when(open_part, won).otherwise(F.col("action")).alias("action"), "reason", "r.strategy",
        only(F.col("r.original_tokens")).alias("original_tokens"), only(F.col("r.compressed_tokens")).alias("compressed_tokens"), "r.compressed", F.when(F.col("r.key").isNotNull(), F.col("text")).alias("payload"), "r.key",
    )


def payloads(rows: DataFrame) -> DataFrame:
    """(hash, payload, inserted_at) of the compressed parts of a manifest made with ``store``: what a store's ``put`` takes."""
    return rows.where("key IS NOT NULL").select(F.col("key").alias("hash"), "payload", F.current_timestamp().alias("inserted_at"))


@F.udf(returnType=T.StringType(), useArrow=True)
def _spliced(body: str, changes: list) -> str:
    if not changes:
        return body
    doc = json.loads(body)
    for c in changes:
        at = doc
        for step in c["path"][:-1]:
            at = at[int(step)] if isinstance(at, list) else at[step]
        at[c["path"][-1]] = c["compressed"]
    return json.dumps(doc, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def outcomes(requests: DataFrame, rows: DataFrame) -> DataFrame:
    """One row per request: kind (compressed, no_compression, error), reason, body, token totals; ``rows`` is its manifest."""
    changed = F.collect_list(F.when(F.col("action") == "compressed", F.struct("path", "compressed")))
    per = rows.groupBy("request_id").agg(
        changed.alias("changes"), F.max(F.when(F.col("action") == "error", F.col("reason"))).alias("error"), F.max(F.when(F.col("action") == "none", F.col("reason"))).alias("why"),
        F.coalesce(F.sum("original_tokens"), F.lit(0)).alias("original_tokens"), F.coalesce(F.sum("compressed_tokens"), F.lit(0)).alias("compressed_tokens"),
    )
    out = requests.select("request_id", "body").join(per, "request_id", "left")
    n = F.coalesce(F.size("changes"), F.lit(0))
    return out.select(
        "request_id", F.when(F.col("error").isNotNull(), "error").when(n > 0, "compressed").otherwise("no_compression").alias("kind"),
        F.when(F.col("error").isNotNull(), F.col("error")).when(n > 0, F.lit(None)).otherwise(F.coalesce("why", F.lit("nothing_compressible"))).alias("reason"),
        F.when(n > 0, _spliced("body", "changes")).otherwise(F.col("body")).alias("body"), "original_tokens", "compressed_tokens",
    )


def no_change_reason(parts_seen: Column, original: Column, compressed: Column) -> Column:
    return F.when(parts_seen.isNull(), "no_manifest").when(parts_seen == 0, "no_eligible_items").when(original == compressed, "no_token_savings").otherwise("no_change")

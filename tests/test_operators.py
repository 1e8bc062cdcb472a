"""Operators on small tables against Python models."""

import json
import math
import re
import statistics
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from brevia.functions import arrays, hashing, hits, importance, jsontext, loglines, sizing
from brevia.functions import text as X
from brevia.operators import compress, detect, items, lines, policy, relevance
from brevia.plans import livezone, pipeline
from brevia.sources import requests as R
from brevia.sources import store as S


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_detection_of_every_type(spark):
    log = "\n".join(["2024-01-01 INFO a", "ERROR b", "plain"] * 5)
    blocks = [
        (0, "  \n"), (1, '[{"a":1}]'), (2, "[1]"), (3, "diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1 +1 @@\n+a\n-b"), (4, "<!DOCTYPE html><html><head></head><body><div></div></body></html>"),
        (5, "a.py:1:x\nb.py:2:y"), (6, log), (7, "import os\ndef f():\n    pass\nclass A:\n    pass\nfrom x import y"), (8, "just some prose"), (9, None),
    ]
    got = {r[0]: (r[2], round(r[3], 3)) for r in rows(detect.classify(spark.createDataFrame(blocks, "doc_id int, text string")))}
    assert {k: v[0] for k, v in got.items()} == {0: "text", 1: "json_array", 2: "json_array", 3: "diff", 4: "html", 5: "search", 6: "build", 7: "source_code", 8: "text", 9: "text"}
    assert got[0][1] == 0.0 and got[1][1] == 1.0 and got[2][1] == 0.8 and got[8][1] == 0.5
    tolerant = detect.classify(spark.createDataFrame([(0, '[{"a" 1}]')], "doc_id int, text string"), tolerant=True)
    assert rows(tolerant)[0][2:] == ("json_array", 1.0)


def test_unified_diff_counts(spark):
    text = "diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1,2 +1,2 @@\n-a\n+b\n c\n--- a/y\n+++ b/y\n@@ -1 +1 @@\n+z"
    t = lines.lines(spark.createDataFrame([(1, text), (2, "+++ x\nno")], "doc_id int, text string"))
    assert sorted(rows(detect.unified_diff(t))) == [(1, True, 2, 2, 2, 1), (2, False, 0, 0, 0, 0)]


def test_simhash_forms_agree(spark):
    texts = ["hello world", "ab", "", "Äpfel und Birnen", "x" * 50]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", hashing.simhash(F.col("t")).alias("a"), hashing.simhash_long("t").alias("b"))
    for t, a, b in rows(df):
        model = sizing.simhash(t)
        assert a == b == (model - (1 << 64) if model >> 63 else model), t


def test_importance_column_equals_the_kernel(spark):
    texts = ["an error", "note: an error", "warning x", "password", "# Title", "nothing", "TERRORS"]
    for context in ("text", "diff", "log"):
        got = rows(spark.createDataFrame([(t,) for t in texts], "line string").select("line", importance.signal(F.col("line"), context)["category"]))
        assert {a: b for a, b in got} == {t: importance.category(t, context) for t in texts}


def test_text_columns(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(X.terms(F.lit("Foo bar_1 12345 x-y"))) == ["foo", "bar_1", "12345", "x", "y"]
    assert one(X.normal_warning(F.lit("warn 5: at /usr/lib/x.py line 12 0xff"))) == "warn 5: at /PATH/x.py line N ADDR"
    assert one(X.plus_line(F.lit("@@ -1,2 +34,5 @@"))) == 34 and one(X.plus_line(F.lit("@@"))) == 0
    assert one(X.query_anchors(F.lit("find 'foo bar' 12345 for u@e.com"))) == ["12345", "e.com", "foo bar", "u@e.com"]


def test_level_context_and_islands(spark):
    text = "\n".join("ERROR x" if i in (5, 6, 20) else f"INFO {i}" for i in range(30))
    t = lines.classified(lines.lines(spark.createDataFrame([(1, text)], "doc_id int, text string")))
    assert rows(lines.level_counts(t)) == [(1, 3, 0, 0, 27, 30)]
    near = sorted(r.line_no for r in lines.context(t, F.col("level") == "error", 3).collect())
    assert near == [*range(2, 10), *range(17, 24)]
    got = lines.islands(t.withColumn("e", F.col("level") == "error"), "e").select("island", "first_line", "last_line", "n")
    assert sorted(rows(got)) == [(1, 5, 6, 2), (2, 20, 20, 1)]


def test_hit_budget_equals_the_greedy_model(spark):
    data = [(1, f"f{f}", n, f"c{n}", n, float(s)) for f, k, s in (("a", 7, 0.5), ("b", 3, 0.9), ("c", 9, 0.1)) for n in range(k)]
    got = lines.budgeted(spark.createDataFrame(data, "doc_id int, file string, line_number long, content string, line_no int, score float"), 10)
    count = {}
    for r in got.collect():
        count[r.file] = count.get(r.file, 0) + 1
    assert count == {"fa": 5, "fb": 3, "fc": 2}  # totals 3.5, 2.7, 0.9


def test_profile_and_outliers(spark):
    data = [(1, i, json.dumps({"v": v, "s": "a"} if i % 2 else {"v": v})) for i, v in enumerate([1, 2, 3, 2, 1, 2, 3, 100])]
    blocks = spark.createDataFrame([(1, "[" + ",".join(d[2] for d in data) + "]")], "doc_id int, text string")
    cells = items.variant_cells(items.array_items(blocks))
    sizes = spark.createDataFrame([(1, 8)], "doc_id int, n long")
    p = {r["name"]: r for r in items.profile(cells, sizes).collect()}
    values = [1, 2, 3, 2, 1, 2, 3, 100]
    assert p["v"].n_unique == 4 and p["v"].mean == pytest.approx(statistics.mean(values)) and p["v"].variance == pytest.approx(statistics.variance(values))
    assert p["s"].n_unique == 2 and p["s"].kind == "string" and p["s"].avg_length == 1
    assert [r.item_idx for r in items.numeric_outliers(cells).collect()] == [7]


def test_knee_equals_the_kernel(spark):
    texts = ["a b c", "a b c", "a b", "x y", "a b", "a b c"] + ["a b"] * 6
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "k int, i int, t string")
    curve = items.pair_curve(df, F.col("t"), "k", "i")
    assert [r.distinct_pairs for r in curve.orderBy("i").collect()] == sizing.pair_curve(texts)
    assert rows(items.knee(curve, "k", "i")) == [(1, sizing.knee(sizing.pair_curve(texts)))]


def test_bm25_and_hybrid(spark):
    docs = spark.createDataFrame([(1, "alpha beta beta"), (2, "gamma authentication"), (3, "")], "doc_id int, text string")
    queries = spark.createDataFrame([(9, "beta authentication beta")], "query_id int, query string")
    got = {r.doc_id: r for r in relevance.bm25(docs, queries).collect()}
    avgdl = 5 / 3
    raw = math.log(2) * 2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * 3 / avgdl)) * 2
    assert got[1].score == pytest.approx(min(raw / 10, 1)) and got[1].matched == ["beta"] and set(got) == {1, 2}
    assert got[2].score > 0.3
    alpha = lambda q: spark.range(1).select(relevance.adaptive_alpha(F.lit(q))).first()[0]
    assert alpha("plain words") == 0.5 and alpha("id 12345") == 0.65 and alpha("1234 5678") == 0.75 and alpha("a.example.com") == 0.6
    cos = spark.range(1).select(relevance.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0))), relevance.cosine(F.array(F.lit(1.0)), F.array(F.lit(-1.0)))).first()
    assert cos[0] == pytest.approx(2**-0.5) and cos[1] == 0.0


def test_policy(spark):
    mode = lambda h: spark.range(1).select(policy.auth_mode(F.create_map(*[F.lit(x) for kv in h.items() for x in kv]) if h else F.lit(None).cast("map<string,string>"))).first()[0]
    assert mode({"User-Agent": "Cursor/1"}) == "subscription" and mode({"Authorization": "Bearer sk-x"}) == "payg" and mode({"authorization": "Bearer a.b.c"}) == "oauth" and mode({"Authorization": "Basic x"}) == "oauth" and mode({"x-api-key": "k"}) == "payg"
    gain = spark.range(1).select(policy.mutation_gain(F.lit(100.0), F.lit(50.0), F.lit(float("nan")), F.lit(float("nan")))).first()[0]
    assert gain == pytest.approx(100 * 1.15 - 1.15 * 50)
    m = spark.createDataFrame([(1, 0, "assistant", ["a", ""], None), (1, 1, "tool", None, "a"), (1, 2, "assistant", ["a"], None), (1, 3, "tool", None, "a"), (1, 4, "tool", None, "")], "conv_id int, msg_idx int, role string, call_ids array<string>, tool_call_id string")
    assert sorted(rows(policy.tool_pairs(m))) == [(1, 2, 1), (1, 2, 3)]


def test_compressors_pass_nulls(spark):
    df = spark.createDataFrame([(None,), ("short",)], "text string")
    for f in (compress.logs, compress.diffs, compress.search, compress.crush, compress.json_structure, compress.code):
        got = rows(df.select(f(F.col("text"))["compressed"]))
        assert got[0] == (None,) and got[1][0] is not None
    tags = df.select(compress.protect_tags(F.col("text")).alias("p")).select(compress.restore_tags(F.col("p.text"), F.col("p.names")))
    assert rows(tags) == [(None,), ("short",)]


def test_every_row_has_its_own_query_and_bias(spark):
    found = "\n".join(f"a{i % 4}.py:{i}:value number{i}" for i in range(200))
    array = json.dumps([{"id": 7000 + i, "note": f"plain {i % 5}"} for i in range(120)])
    rows_ = [(found, array, f"number{n}", b) for n, b in ((33, 1.0), (151, 0.5), (99, None))] + [(found, array, None, 1.5)]
    df = spark.createDataFrame(rows_, "hits string, items string, q string, b double")
    q, b = F.col("q"), F.col("b")
    got = rows(df.select("q", "b", compress.search(F.col("hits"), q, b)["compressed"], compress.crush(F.col("items"), F.concat(F.lit("id "), q), b)["compressed"], compress.logs(F.col("hits"), b)["lines_out"], compress.anchor_places(F.col("items"), 8, query=q)))
    for q, b, hit, crushed, n, places in got:
        q, b, whole = q or "", 1.0 if b is None else b, "" if q is None else f"id {q}"
        assert hit == hits.compress(found, q, b).text and crushed == arrays.crush(array, whole, b)[0] and n == loglines.compress(found, b).lines_out
        assert list(places) == list(arrays.anchors(jsontext.read(array), 8, "smart_sample", q))
    one = rows(pipeline.run(df.select(F.col("hits").alias("text"), "q"), query=F.col("q")).select("q", "output"))
    chain = pipeline.Pipeline.full()
    assert {q: o for q, o in one} == {r[2]: chain.run(found, "search", r[2] or "").output for r in rows_}


def test_payloads_of_shortened_parts_come_back_by_their_marks(spark, tmp_path):
    body = json.dumps({"messages": [{"role": "user", "content": _log()}]})
    r = spark.createDataFrame([("r1", "messages", None, body), ("r2", "messages", None, '{"messages": []}')], "request_id string, format string, mode string, body string")
    m = livezone.manifest(r, store=True)
    store = S.FolderStore(spark, str(tmp_path / "s"))
    store.put(livezone.payloads(m))
    text = json.loads(livezone.outcomes(r, m).where("request_id = 'r1'").first()["body"])["messages"][0]["content"]
    key = re.search(r"<<ccr:([0-9a-f]{24})>>", text)[1]
    assert len(text) < len(_log()) and rows(store.get(spark.createDataFrame([(key,)], "hash string")).select("hash", "payload")) == [(key, _log())]


def _log(n=80):
    return "\n".join(["ERROR boom"] + [f"INFO line number {i} of the run" for i in range(n)])


def test_live_zone_of_three_formats(spark):
    long = _log()
    bodies = [
        ("a", "messages", None, {"model": "m", "system": "s", "messages": [{"role": "user", "content": long}, {"role": "assistant", "content": "x"}, {"role": "user", "content": [{"type": "tool_result", "content": long}, {"type": "text", "text": "hi"}]}]}),
        ("b", "chat", None, {"messages": [{"role": "system", "content": long}, {"role": "tool", "content": long}, {"role": "assistant", "content": long}, {"role": "user", "content": "q"}]}),
        ("c", "responses", None, {"input": [{"type": "function_call_output", "output": long}, {"type": "message", "content": [{"type": "input_text", "text": "x"}]}]}),
        ("d", "messages", "off", {"messages": []}), ("e", "messages", None, {"messages": []}), ("f", "other", None, {}), ("g", "responses", None, {"input": "text"}),
        ("h", "messages", None, {"messages": [{"role": "user", "content": [{"type": "text", "text": long, "cache_control": {}}]}]}),
    ]
    req = spark.createDataFrame([(i, f, m, json.dumps(b)) for i, f, m, b in bodies] + [("i", "chat", None, "{")], "request_id string, format string, mode string, body string")
    m = livezone.manifest(req, store=True)
    got = {(r.request_id, r.idx, r.action): r for r in m.collect()}
    assert ("a", -1, "excluded") in got and got["a", 0, "excluded"].reason == "frozen_by_policy" and got["a", 2, "compressed"].strategy == "log_compressor" and got["a", 2, "compressed"].compressed.endswith(">>")
    assert got["b", 1, "compressed"].compressed_tokens < got["b", 1, "compressed"].original_tokens and got["b", 2, "excluded"].reason == "latest_assistant"
    out = {r.request_id: r for r in livezone.outcomes(req, m).collect()}
    assert {k: v.kind for k, v in out.items()} == {"a": "compressed", "b": "compressed", "c": "compressed", "d": "no_compression", "e": "no_compression", "f": "error", "g": "no_compression", "h": "no_compression", "i": "error"}
    assert out["d"].reason == "mode_off" and out["e"].reason == "empty_messages" and out["g"].reason == "no_input" and out["h"].reason == "no_live_user_message"
    body = json.loads(out["a"].body)
    assert body["messages"][0]["content"] == long and "lines omitted" in body["messages"][2]["content"][0]["content"] and body["messages"][2]["content"][1]["text"] == "hi"


def test_pipeline_over_a_table(spark):
    blocks = spark.createDataFrame([(1, _log(300)), (2, '[{"a" : 1},  {"a" : 2}]'), (3, ""), (4, None)], "doc_id int, text string")
    got = {r.doc_id: r for r in pipeline.run(blocks).collect()}
    assert got[1].content_type == "build" and got[1].saved > 0 and got[2].output == '[{"a":1},{"a":2}]' and got[2].steps == ["json_minifier"] and got[3].output == "" and got[4].output is None


def test_store_round_trip_ttl_and_capacity(spark, tmp_path):
    now = datetime(2024, 1, 1, 12)
    data = [(f"h{i}", f"p{i}", now - timedelta(seconds=10 * i)) for i in range(5)] + [("h0", "old", now - timedelta(seconds=100)), ("h9", "gone", now - timedelta(seconds=1000))]
    s = S.open_store(spark, "folder", str(tmp_path / "store"), ttl=300, capacity=3)
    s.put(spark.createDataFrame(data, S.ROW))
    at = F.lit(now)
    got = dict(rows(s.get(spark.createDataFrame([("h0",), ("h1",), ("h4",), ("h9",), ("zz",)], "hash string"), at)))
    assert got == {"h0": None, "h1": "p1", "h4": None, "h9": None, "zz": None}  # h0 came first, so it goes first
    assert S.open_store(spark, "", str(tmp_path / "store"), ttl=300, capacity=100).size(at) == 5
    lite = S.open_store(spark, "sqlite", str(tmp_path / "s.db"), ttl=300)
    lite.put(spark.createDataFrame(data[:2], S.ROW))
    assert lite.size() == 2 and dict(rows(lite.get(spark.createDataFrame([("h1",)], "hash string"), now=int(now.timestamp())))) == {"h1": "p1"}
    with pytest.raises(ValueError):
        S.open_store(spark, "nope")


def test_cache_marks_and_frozen_prefix(spark):
    body = {"messages": [{"role": "user", "content": [{"type": "text", "cache_control": {"ttl": "5m"}}, {"type": "text", "cache_control": {"ttl": "1h"}}]}, {"role": "user", "content": "x"}], "tools": [{"cache_control": {"ttl": "1h"}}]}
    req = spark.createDataFrame([("a", json.dumps(body)), ("b", "{}")], "request_id string, body string")
    marks = R.cache_marks(req)
    assert {(r.section, r.violated) for r in policy.ttl_violations(marks).collect()} == {("messages", True), ("tools", False)}
    assert rows(policy.frozen_prefix(marks.where("section = 'messages'").select("request_id", "msg_idx", F.lit(True).alias("has_mark")))) == [("a", 1)]
    assert [r.role for r in R.messages(req).orderBy("msg_idx").collect()] == ["user", "user"]

"""Kernels on one block, on inputs made here."""

import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from brevia.functions import arrays, codetext, difftext, hits, importance, jsontext, loglines, logtemplates, sizing, tagspans, tokens
from brevia.operators.detect import scan_array
from brevia.plans.pipeline import Pipeline, Reformat, Settings


def test_simhash_is_stable_and_near_for_near_texts():
    assert sizing.simhash("hello") == sizing.simhash("HELLO")
    a, b, c = (sizing.simhash(x) for x in ("the quick brown fox jumps over", "the quick brown fox jumped over", "completely other words in here"))
    assert (a ^ b).bit_count() < (a ^ c).bit_count()


def test_adaptive_k_bounds():
    assert sizing.adaptive_k(["x"] * 5, 1.0, 3, 2) == 5  # few items stay whatever the bound
    assert sizing.adaptive_k(["same"] * 50, 1.0, 3, 15) == 3
    items = [f"item {i} word{i * 7}" for i in range(100)]
    assert sizing.adaptive_k(items, 0.0, 3, 15) in (3, 4)
    assert sizing.adaptive_k(items, 1.0, 3, 15) == 15


def test_knee():
    assert sizing.knee([1, 2]) is None
    assert sizing.knee([4, 4, 4]) == 1
    assert sizing.knee([0, 10, 10, 10, 10]) == 2
    assert sizing.knee(list(range(10))) is None


def test_log_selection_keeps_errors_context_and_counts():
    rows = [f"INFO step {i}" for i in range(100)]
    rows[40] = "ERROR boom"
    rows[70] = "WARN slow: took 15ms"
    rows[71] = "WARN slow: took 99ms"
    r = loglines.compress("\n".join(rows))
    assert "ERROR boom" in r.text and "INFO step 37" in r.text and "INFO step 36" not in r.text
    assert r.text.endswith("lines omitted: 1 ERROR, 2 WARN, 97 INFO]")
    assert loglines.compress("a\nb").text == "a\nb"


def test_log_levels_and_formats():
    assert loglines.level("an Error here") == "error" and loglines.level("errors") == "unknown" and loglines.level("tests failed; INFO") == "fail"
    assert loglines.log_format(["npm ERR! x", "npm WARN y"]) == "npm" and loglines.log_format(["x"]) == "generic"


def test_trace_runs_end_by_flavour():
    rows = ["x", "Traceback (most recent call last):", '  File "a.py", line 3', "    f()", "ValueError: no", "next line", "y"]
    assert loglines.trace_flags(rows) == [False, True, True, True, True, False, False]


def test_warning_forms():
    assert loglines.normal_warning("warn 5: at /usr/lib/x.py line 12 0xff") == "warn 5: at /PATH/x.py line N ADDR"


def test_hits_per_file_cap_and_note():
    text = "\n".join(f"src/a.py:{i}:line {i} of a" for i in range(1, 21)) + "\nsrc/b.py:3:error here"
    r = hits.compress(text, bias=1.0)
    assert "src/b.py:3:error here" in r.text and "more matches in src/a.py]" in r.text and "src/a.py:1:" in r.text and "src/a.py:20:" in r.text
    assert hits.parse("C:\\x\\y.py:12:text") == ("C:\\x\\y.py", 12, "text") and hits.parse("no hit") is None and hits.parse("a-b.py-7-ctx") == ("a-b.py", 7, "ctx")


DIFF = "diff --git a/x.py b/x.py\nindex 1..2 100644\n--- a/x.py\n+++ b/x.py\n@@ -1,60 +1,60 @@\n" + "".join(f" line {i}\n" for i in range(30)) + "-old\n+new error\n" + "".join(f" line {i}\n" for i in range(30, 60))


def test_diff_context_and_totals():
    r = difftext.compress(DIFF)
    assert (r.files, r.additions, r.deletions, r.hunks_kept) == (1, 1, 1, 1)
    assert " line 28\n line 29\n-old\n+new error\n line 30\n line 31\n" in r.text and " line 27\n" not in r.text and "index" not in r.text
    assert "[1 files changed, +1 -1 lines]" in r.text and r.key


def test_hunk_choice_keeps_ends():
    hunks = [difftext.Hunk(f"@@ -{i},1 +{i},1 @@", score=i % 7 / 10) for i in range(1, 31)]
    kept = difftext.choose_hunks(hunks, 10)
    assert len(kept) == 10 and kept[0] is hunks[0] and kept[-1] is hunks[-1]


def test_diff_noise():
    lock = "diff --git a/go.sum b/go.sum\n--- a/go.sum\n+++ b/go.sum\n@@ -1 +1 @@\n" + "+x 1234567890\n" * 40
    assert difftext.is_lockfile("a/b/yarn.lock") and not difftext.is_lockfile("notyarn.lock")
    assert "lockfile hunks dropped (42 lines)" in difftext.drop_noise(lock) and difftext.noise_share(lock) == 1.0
    assert difftext.only_spaces(["@@", "-a b", "+ab"]) and not difftext.only_spaces(["@@", "-a", "+b"])


def test_json_reading_keeps_element_text():
    v = jsontext.read('[1.50, "a" , {"b": [2,3]}]')
    assert v.raw == ["1.50", '"a"', '{"b": [2,3]}'] and v[0] == 1.5
    for bad in ("[1,]", "{", "[1 2]", "nan", ""):
        with pytest.raises(ValueError):
            jsontext.read(bad)


@settings(max_examples=60, deadline=None)
@given(st.recursive(st.none() | st.booleans() | st.integers(-(10**12), 10**12) | st.text(max_size=8), lambda c: st.lists(c, max_size=4) | st.dictionaries(st.text(max_size=4), c, max_size=4), max_leaves=12))
def test_json_round_trip(value):
    assert json.loads(jsontext.write(jsontext.read(json.dumps(value)))) == value


def test_minify_and_structure():
    assert jsontext.minified('{"b" : 1.0,  "a" : [1, 2]}') == '{"a":[1,2],"b":1}' and jsontext.minified("x") is None
    out, keys = jsontext.structure('{"description": "a rather long text of words", "id": 12345678901, "k": ["a","b","c","d"]}')
    assert out == '{"description":,"id":0,"k":["a","b","c",]}' and keys == 3


def test_table_header_flattening_and_quotes():
    t = arrays.table([{"a": 1, "b": {"x": 1, "y": "q,z"}}, {"a": 2.5, "b": {"x": 2, "y": None}, "c": True}])
    assert t == '[2]{a:float,b.x:int,b.y:string?,c:bool?}\n1.0,1,"q,z",\n2.5,2,,true\n'
    assert arrays.table([1, 2]) is None
    assert arrays.table([{"a": 1}, {"b": "x"}], style="markdown") == "### Item 1\n- **a**: 1\n- **b**: \n### Item 2\n- **a**: \n- **b**: x"


def test_crush_keeps_errors_and_outliers():
    rows = [{"id": i, "status": "ok", "v": 10 + i % 3} for i in range(60)]
    rows[33]["status"] = "error"
    rows[47]["v"] = 9999
    out, changed, how = arrays.crush(json.dumps(rows), rules=arrays.Rules(table=True, lossless=2.0))
    kept = {r["id"] for r in json.loads(out)}
    assert changed and {33, 47} <= kept and len(kept) <= 15 and how.startswith("smart_sample(60->")


def test_crush_passthrough_and_strategies():
    assert arrays.crush("not json") == ("not json", False, "")
    assert arrays.crush("[1,2,3]")[1] is False
    assert arrays.crush(json.dumps(["s"] * 30))[2].startswith("string:adaptive(30->")
    assert arrays.crush(json.dumps(list(range(40)) + [1000]))[2].startswith("number:adaptive(41->")
    assert arrays.crush(json.dumps([1, "a", None]))[2] == ""
    lossless = arrays.crush(json.dumps([{"key": i, "name": "n"} for i in range(40)]))
    assert lossless[2].startswith("lossless:csv_schema")


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(-50, 50), min_size=9, max_size=60))
def test_number_crush_is_a_subsequence(values):
    kept, _ = arrays.crush_numbers(values, [str(v) for v in values], 1.0)
    assert kept == sorted(set(kept)) and all(0 <= i < len(values) for i in kept)


def test_field_tests():
    items = [{"id": i, "score": 1 - i / 100, "t": "2024-01-01T00:00"} for i in range(50)]
    f = {k: arrays.profile(k, items) for k in ("id", "score", "t")}
    assert arrays.id_confidence(f["id"], items) == 0.9 and arrays.score_confidence(f["score"], items) == pytest.approx(0.8) and arrays.temporal(f, items)
    assert not arrays.sequential([1, 5, 9, 13, 17]) and arrays.sequential([1, 2, 3, 4, 5])


def test_anchor_weights_shift_with_the_query():
    assert arrays.anchor_weights("smart_sample", "the latest")[2] > arrays.anchor_weights("smart_sample")[2] > arrays.anchor_weights("smart_sample", "the first")[2]
    assert arrays.anchors(list(range(5)), 10) == [0, 1, 2, 3, 4]


def test_query_anchors():
    assert arrays.query_anchors("find 'foo bar' for user@example.com id 12345 e.g. x") == {"foo bar", "user@example.com", "12345", "example.com"}


def test_templates():
    text = "\n".join(f"worker {i} finished job {i * 3} ok" for i in range(30))
    out = logtemplates.collapse(text)
    assert out.startswith("[Template T1: worker <*> finished job <*> ok] (30 occurrences)\n0 0\n1 3")
    assert logtemplates.collapse("a\nb") is None


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["<foo>", "</foo>", "<b>", "</b>", "<bar x='1'/>", "text ", "<", ">", "</zap>", "{{TAG_0}}"]), max_size=20))
def test_tags_round_trip(parts):
    text = "".join(parts)
    out, names = tagspans.protect(text)
    assert tagspans.restore(out, names) == text


def test_code_bodies():
    py = '"""doc"""\nimport os\n\nclass A:\n    def f(self):\n        """Says."""\n' + "        x = 1\n" * 60 + "\n    y = 2\n"
    r = codetext.compress(py)
    assert r.language == "python" and r.bodies == 1 and '"""Says."""' in r.text and "# [60 lines omitted]" in r.text and "y = 2" in r.text
    go = "package main\nfunc f(a int) int {\n" + "\tx := \"}\" // }\n" * 40 + "}\ntype T struct {\n\ta int\n}\n"
    g = codetext.compress(go)
    assert g.language == "go" and g.bodies == 1 and "type T struct {\n\ta int\n}" in g.text and "func f(a int) int { // [" in g.text


def test_importance_order_and_contexts():
    assert importance.category("note: an error") == "importance" and importance.category("an error, note") == "error"
    assert importance.category("warning", "diff") is None and importance.category("password", "diff") == "security" and importance.category("# Title") == "markdown"
    k = importance.Keywords()
    k.add("error", "kaputt")
    assert "kaputt" in k.pattern("error")


def test_token_estimates():
    assert tokens.estimate("abcde") == 2 and tokens.estimate("abc", 0) == 1 and tokens.counter("claude-x")("a" * 7) == 2
    tokens.register("m", len)
    assert tokens.counter("m")("abc") == 3
    tokens.clear()
    assert tokens.counter("m")("abc") == 1


def test_tolerant_array_scan():
    assert scan_array('[{"a":1},{"b" 2}]') == 1.0 and scan_array("[1, 2]") == 0.8 and scan_array("[]") == 0.8
    assert scan_array("[1,]") is None and scan_array("[1") is None and scan_array("x") is None and scan_array('["]"]') == 0.8


def test_pipeline_settings_and_gates():
    s = Settings.parse("[pipeline]\nbloat_threshold = 0.9\n[bloat.log]\nmin_lines = 10\n")
    assert s.bloat_threshold == 0.9 and s.log_min_lines == 10
    with pytest.raises(ValueError):
        Settings.parse("[pipeline]\nnope = 1\n")
    with pytest.raises(Exception):
        Settings.parse("[pipeline")
    p = Pipeline.full()
    rng = random.Random(0)
    log = "\n".join(f"INFO request {rng.random()}" for _ in range(400)) + "\nERROR x"
    r = p.run(log, "build")
    assert "log_offload" in r.steps and r.saved > 0 and r.keys
    assert p.run("", "build").output == "" and p.run("hello", "text").output == "hello"
    broken = Pipeline().with_reformat(Reformat("bad", ("text",), lambda t, s: [][0]))
    assert broken.run("x", "text").steps == []

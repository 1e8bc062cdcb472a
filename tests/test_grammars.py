"""Fixed grammars, lists and forms against plain models."""

import time

import pytest
from pyspark.sql import functions as F

from brevia.functions import codetext, hits, sizing
from brevia.functions import text as X
from brevia.operators import compress, detect, items, lines, relevance

HITS = [
    ("a.py:12:x = 1", ("a.py", 12, "x = 1")), ("a.py-12-x", ("a.py", 12, "x")), (r"C:\src\a.py:7:y", (r"C:\src\a.py", 7, "y")), ("C:/src/a.py-7:y", ("C:/src/a.py", 7, "y")),
    ("my-file.py:3:z", ("my-file.py", 3, "z")), ("a-1-b.py:3:z", ("a", 1, "b.py:3:z")), ("a::12:x", None), (":12:x", None), ("12:x", None), ("a:12", None), ("a:b:12:c", ("a:b", 12, "c")),
    ("  a:1:  b  ", ("a", 1, "  b")), ("no hit", None), ("", None), ("---", None), ("a:1-", ("a", 1, "")),
]


@pytest.mark.parametrize("line, want", HITS)
def test_hits(line, want):
    assert hits.parse(line) == want


def test_hit_columns_have_the_same_grammar(spark):
    df = spark.createDataFrame([(1, i, line) for i, (line, _) in enumerate(HITS)], "doc_id int, line_no int, line string")
    got = {r.line_no: (r.file, r.line_number, r.content) for r in lines.search_hits(df).collect()}
    assert got == {i: want for i, (_, want) in enumerate(HITS) if want}


@pytest.mark.parametrize("sign", ["-", ":", "-:", "1-", "--1"])
def test_ruler_lines_take_linear_time(sign):
    began = time.time()
    hits.parse(sign * 100_000)
    hits.compress("\n".join([sign * 20_000] * 3))
    assert time.time() - began < 2


def test_model_labels(spark):
    labels = {"python": "source_code", "dockerfile": "source_code", "yaml": "source_code", "maven": "source_code", "jsonl": "json_array", "xml": "html", "diff": "diff", "markdown": "text", "patch": "text", "julia": "text", None: "text"}
    got = spark.createDataFrame([(k,) for k in labels], "label string").select("label", detect.from_model_label(F.col("label"))).collect()
    assert {a: b for a, b in got} == labels


def test_language_column_equals_the_kernel(spark):
    texts = ["def f():\n  import x\n  self.y", "var x = () => 1; let y", "interface A { b: string; c: number } export type D", "func main() { x := 1 }\npackage main", "fn main() { let mut x; impl A }", "public class A { private void b() }", "#include <a.h>\nint main(", "std::cout << a; namespace b", "prose alone", ""]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", codetext.language_column(F.col("t"))).collect()
    assert {a: b for a, b in got} == {t: codetext.language(t) for t in texts}
    assert codetext.language(texts[1]) == "javascript" and codetext.language("nothing") == "unknown" and not codetext.can_handle("  ")


def test_clusters_equal_the_greedy_model():
    rows = [f"line {i % 37} of the {'log' if i % 3 else 'report'} with value {i % 11}" for i in range(300)]
    reps: list[int] = []
    for x in dict.fromkeys(rows):
        f = sizing.simhash(x)
        if not any((r ^ f).bit_count() <= sizing.SAME for r in reps):
            reps.append(f)
    assert sizing.clusters(rows) == len(reps)


def test_simhash_after_the_table_of_grams_was_emptied(monkeypatch):
    texts = [f"text number {i} {'x' * (i % 7)}" for i in range(200)]
    want = [sizing.simhash(t) for t in texts]
    monkeypatch.setattr(sizing._Grams, "MOST", 50)
    assert [sizing.simhash(t) for t in texts] == want


def test_nearest_vectors_by_blocks(spark, monkeypatch):
    rows = [(i, [float((i * 7 + j * 3) % 11 - 5) for j in range(4)]) for i in range(60)] + [(60, None), (61, []), (62, [0.0] * 4), (63, [1.0, 2.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    ask = v.where("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    monkeypatch.setattr(relevance, "QUERY_BYTES", 64)
    got = {(r.query_id, r.vec_id): r.score for r in relevance.nearest(v, ask, 5).collect()}
    pairs = v.crossJoin(ask.withColumnRenamed("embedding", "q")).select("query_id", "vec_id", F.round(relevance.cosine(F.col("embedding"), F.col("q")), 5).alias("s")).collect()
    want = {}
    for q in {p.query_id for p in pairs}:
        best = sorted((p for p in pairs if p.query_id == q), key=lambda p: (-(p.s or 0.0), p.vec_id))[:5]
        want |= {(q, p.vec_id): p.s or 0.0 for p in best}
    assert got == pytest.approx(want)


def test_filters_on_block_functions_run_them_once(spark):
    df = spark.createDataFrame([("a.py:1:error x\nb.py:2:y",)], "text string").withColumn("r", compress.search(F.col("text"))).where("r.hits_in > 0").select("r.compressed")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and df.count() == 1


def test_tiered_detection(spark):
    df = spark.createDataFrame([("import os\n", "source_code", False), ("prose", "text", True), ("prose", None, False), (" ", "html", True)], "text string, model string, diff boolean")
    got = [(r.found.content_type, r.found.confidence, r.found.tier) for r in detect.tiered(df, F.col("text"), F.col("model"), F.col("diff")).collect()]
    assert got == [("source_code", 0.9, 1), ("diff", 0.95, 2), ("text", 0.5, 3), ("text", 0.0, 3)]


def test_json_containers(spark):
    texts = {"[1]": "ARRAY", ' {"a": [1]}\n': "OBJECT", "[1]]": None, '{"a":1}}': None, "[1] and prose": None, "[1] see [2]": None, "[1],[2]": None, '{"a":1},"b":{}': None, "[]": "ARRAY", "{}": "OBJECT", "[": None, "word": None, "12": None, "": None}
    got = spark.createDataFrame([(k,) for k in texts], "t string").select("t", F.regexp_extract(F.schema_of_variant(X.container(F.col("t"))), "^[A-Z]+", 0)).collect()
    assert {a: b or None for a, b in got} == texts
    notes = spark.createDataFrame([("[1] see the notes",), ("[1, 2]",), ('[{"a":1}, {"a":2}]',)], "text string")
    assert [(r.content_type, r.confidence) for r in detect.classify(notes).collect()] == [("text", 0.5), ("json_array", 0.8), ("json_array", 1.0)]


def test_cell_classes(spark):
    cells = [
        ("null", None, None, "null"), ("boolean", "true", None, "bool"), ("numeric", "3", 3.0, "int"), ("numeric", "3.5", 3.5, "float"), ("array", "[1]", None, "array"), ("object", "{}", None, "object"),
        ("string", "123e4567-e89b-12d3-a456-426614174000", None, "uuid"), ("string", "https://a.b/c", None, "url"), ("string", "Ab9/" * 125, None, "opaque"), ("string", "word, " * 90, None, "long_string"),
        ("string", "Ab9/" * 124, None, "long_string"), ("string", "x" * 99, None, "short_string"), ("string", "", None, "short_string"),
    ]
    got = spark.createDataFrame(cells, "kind string, value string, number double, want string").select(items.cell_class(F.col("kind"), F.col("value"), F.col("number")).alias("got"), "want").collect()
    assert [r.got for r in got] == [r.want for r in got]

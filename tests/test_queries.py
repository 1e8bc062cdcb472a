"""Registered queries against DuckDB on the smallest tables, and the entry module without the optional parts."""

import os
import subprocess
import sys

import pytest

import __spark_entry__ as entry
from brevia import queries as Q

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def same(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, duck, name):
    df = Q.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(same(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name not in Q.SQL:
        assert got
        return
    cur = duck.execute(Q.SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == columns
    assert got == sorted((tuple(same(r[names.index(c)]) for c in columns) for r in cur.fetchall()), key=repr)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_the_optional_parts():
    code = (
        "import sys\n"
        "class No:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name.startswith(('brevia.llm', 'corpus_pipeline')):\n"
        "            raise ModuleNotFoundError(f'No module named {name!r}', name=name)\n"
        "sys.meta_path.insert(0, No())\n"
        "import __spark_entry__ as e\n"
        "print(len(e.queries()), any(k.startswith('op') or k == 'pipeline' for k in e.queries()))\n"
    )
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, check=True).stdout.split()
    assert int(out[-2]) == len(Q.QUERIES) and out[-1] == "False"


def test_search_compress_sees_whole_lines(spark, tmp_path):
    text = "x" * 100 + " ERROR: the end of a long line\nshort"
    spark.createDataFrame([(1, text, "en", "s")], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    row = Q.search_compress(spark, str(tmp_path)).first()
    assert "the end of a long line" in row["compressed"] and row["hits_in"] == 2


def test_prefix_drift_whole_sees_late_changes(spark, tmp_path):
    rows = [(1, 0, "user", "p" * 30 + "a"), (1, 1, "user", "p" * 30 + "b"), (1, 2, "user", "p" * 30 + "b")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert [r["prefix_changed"] for r in Q.prefix_drift_whole(spark, str(tmp_path)).orderBy("turn").collect()] == [False, True, False]


def test_searches_ask_for_every_query(spark):
    items = {r["item_id"] for r in Q.table(spark, SF, "benchmark").collect()}
    vectors = {r["vec_id"] for r in Q.table(spark, SF, "embeddings").where("vec_id % 100 = 0").collect()}
    assert max(items) >= 10 and {r["query_id"] for r in Q.QUERIES["bm25_benchmark"](spark, SF).collect()} == items
    assert len(vectors) > 1 and {r["query_id"] for r in Q.QUERIES["cosine_nearest"](spark, SF).collect()} == vectors

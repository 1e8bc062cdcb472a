"""Queries over the driver's tables, one or more per operator, with DuckDB SQL where SQL can say the same.

Inputs that the tables lack are derived from them: log lines from events (a user is a block), search hits from
lines of documents (a source is a block), JSON records from orders and line items.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import codetext
from .functions import hashing as H
from .functions import importance as I
from .functions import patterns as P
from .functions import text as X
from .functions import tokens as T
from .operators import compress, detect, items, lines, policy, relevance
from .plans import livezone, pipeline
from .sources import requests as R

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of whole texts for costly functions: dealt anew only if its files are fewer than there are cores."""
    t, cores = table(spark, sf_dir, name), spark.sparkContext.defaultParallelism
    return t.repartition(cores) if len(t.inputFiles()) < cores else t


def q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as log lines: (user_id, line_no, line, value)."""
    e = table(spark, sf_dir, "events")
    word = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "signup", "WARN").when(F.col("event_type") == "purchase", "DEBUG").otherwise("INFO")
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    line = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" "), word, F.lit(" "), F.col("event_type"), F.lit(": id="), F.col("event_id").cast("string"), F.lit(" value="), F.round(F.col("value") * 100).cast("bigint").cast("string"))
    return e.select("user_id", n.alias("line_no"), line.alias("line"), "value", "event_id")


EVENT_SQL = """
l AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS line_no, value, event_id,
  strftime(ts, '%Y-%m-%d %H:%M:%S') || ' ' || CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARN' WHEN 'purchase' THEN 'DEBUG' ELSE 'INFO' END
  || ' ' || event_type || ': id=' || event_id || ' value=' || round(value * 100)::bigint AS line FROM events),
c AS (SELECT *, CASE """ + " ".join(f"WHEN regexp_matches(line, {q(p)}) THEN '{n}'" for n, p in P.LEVELS) + " ELSE 'unknown' END AS level FROM l)"


# lines and logs


@query(f"WITH {EVENT_SQL} SELECT user_id, count(*) FILTER (level = 'error') AS errors, count(*) FILTER (level = 'fail') AS fails, count(*) FILTER (level = 'warn') AS warnings, count(*) FILTER (level = 'info') AS info, count(*) AS total FROM c GROUP BY 1")
def log_level_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.level_counts(lines.classified(event_lines(spark, sf_dir)), "user_id")


@query(f"WITH {EVENT_SQL} SELECT user_id, line_no, level FROM (SELECT *, max((level = 'error')::int) OVER (PARTITION BY user_id ORDER BY line_no ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS near FROM c) WHERE near = 1")
def error_context_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines.classified(event_lines(spark, sf_dir))
    return lines.context(rows, F.col("level") == "error", 3, "user_id").select("user_id", "line_no", "level")


@query(f"""WITH {EVENT_SQL}, r AS (SELECT user_id, line_no, line_no - row_number() OVER (PARTITION BY user_id ORDER BY line_no) AS run FROM c WHERE level = 'error'),
g AS (SELECT user_id, run, min(line_no) AS first_line, max(line_no) AS last_line, count(*) AS n FROM r GROUP BY 1, 2)
SELECT user_id, first_line, last_line, n, row_number() OVER (PARTITION BY user_id ORDER BY first_line) AS island FROM g""")
def stack_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines.classified(event_lines(spark, sf_dir)).withColumn("is_error", F.col("level") == "error")
    return lines.islands(rows, "is_error", "user_id").select("user_id", "island", "first_line", "last_line", "n")


@query(f"""WITH {EVENT_SQL}, e AS (SELECT *, CASE WHEN line_no = min(line_no) OVER (PARTITION BY user_id) THEN 0 WHEN line_no = max(line_no) OVER (PARTITION BY user_id) THEN 1 ELSE 2 END AS rk FROM c WHERE level = 'error')
SELECT user_id, line_no FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY rk, line_no) AS n FROM e) WHERE n <= 10""")
def first_last_best_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines.classified(event_lines(spark, sf_dir)).where("level = 'error'")
    return lines.first_last_best(rows, 10, "user_id").select("user_id", "line_no")


@query(f"""WITH {EVENT_SQL}, w AS (SELECT user_id, line_no, line, regexp_extract(line, '^[^:=]*') || regexp_replace(substr(line, length(regexp_extract(line, '^[^:=]*')) + 1), '[0-9]+', 'N', 'g') AS form FROM c WHERE level = 'warn')
SELECT user_id, form, min(line_no) AS line_no, count(*) AS n FROM w GROUP BY 1, 2""")
def warning_normalize_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines.classified(event_lines(spark, sf_dir))
    return lines.distinct_warnings(rows, key="user_id").select("user_id", "form", "line_no", "n")


LINES_SQL = "x AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents WHERE text IS NOT NULL)"


@query(f"WITH {LINES_SQL} SELECT doc_id, count(*) AS n_lines, max(length(line)) AS longest, count(*) FILTER (trim(line) = '') AS blank FROM x GROUP BY 1")
def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines.lines(table(spark, sf_dir, "documents").where("text IS NOT NULL"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.max(F.length("line")).cast("long").alias("longest"), F.count_if(F.trim("line") == "").alias("blank"))


_IMPORTANCE_SQL = {c: P.words(*sorted(P.IMPORTANCE[c], key=lambda k: (-len(k), k))) for c in ("error", "importance", "warning")}


@query(f"""WITH {LINES_SQL}, s AS (SELECT doc_id, line_no, regexp_matches(line, {q(_IMPORTANCE_SQL["error"])}) OR regexp_matches(line, {q(_IMPORTANCE_SQL["importance"])}) AS u, regexp_matches(line, {q(_IMPORTANCE_SQL["warning"])}) AS w FROM x)
SELECT doc_id, count(*) FILTER (u) AS universal, count(*) FILTER (w AND NOT u) AS warning, count(*) AS n FROM s GROUP BY 1""")
def line_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines.lines(texts(spark, sf_dir, "documents").where("text IS NOT NULL")).withColumn("s", I.signal(F.col("line"), "log"))
    return rows.groupBy("doc_id").agg(F.count_if(F.col("s.category").isin("error", "importance")).alias("universal"), F.count_if(F.col("s.category") == "warning").alias("warning"), F.count("*").alias("n"))


# scalars and hashes


@query("SELECT md5(text) AS content_hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY 1")
def md5_dedupe_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").groupBy(F.md5("text").alias("content_hash")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query("SELECT doc_id, substr(sha256(text), 1, 24) AS payload_key, substr(md5(text), 1, 8) AS md5_8, '<<ccr:' || substr(sha256(text), 1, 12) || ',text,' || octet_length(encode(text)) || '>>' AS marker FROM documents WHERE text IS NOT NULL")
def payload_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", H.payload_key(t).alias("payload_key"), H.md5_key(t, 8).alias("md5_8"), H.opaque_marker(t, "text").alias("marker"))


@query("""WITH d AS (SELECT user_id || ':' || event_id || ':' || event_type AS t, event_id FROM events),
g AS (SELECT event_id, ('0x' || substr(md5(substr(lower(t), i::int, 4)), 1, 16))::ubigint AS h, length(t) - 3 AS n FROM d, unnest(range(1, length(t) - 2)) AS r(i)),
b AS (SELECT event_id, bit, CASE WHEN 2 * sum((h >> bit) & 1) > any_value(n) THEN 1 ELSE 0 END AS v FROM g, unnest(range(0, 64)) AS u(bit) GROUP BY 1, 2)
SELECT event_id, sum(CASE WHEN v = 1 AND bit < 63 THEN 1::hugeint << bit::int WHEN v = 1 THEN -9223372036854775808::hugeint ELSE 0 END)::bigint AS fingerprint FROM b GROUP BY 1""")
def simhash_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.concat_ws(":", F.col("user_id").cast("string"), F.col("event_id").cast("string"), "event_type")
    return table(spark, sf_dir, "events").select("event_id", H.simhash_long(t).alias("fingerprint"))


@query("SELECT doc_id, ceil(length(text) / 4.0)::bigint AS tokens_4, ceil(length(text) / 3.5)::bigint AS tokens_35 FROM documents WHERE text IS NOT NULL")
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", T.estimated(t).alias("tokens_4"), T.estimated(t, 3.5).alias("tokens_35"))


@query("SELECT conv_id, (3 + sum(4 + ceil(length(role) / 4.0) + ceil(length(coalesce(text, '')) / 4.0)))::bigint AS tokens, count(*) AS messages FROM conversations GROUP BY 1")
def chat_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(T.chat_total(F.col("role"), F.col("text")).alias("tokens"), F.count("*").alias("messages"))


@query("""WITH c AS (SELECT doc_id, unnest(string_split(text, '')) AS ch FROM documents WHERE length(text) > 1),
n AS (SELECT doc_id, ch, count(*) AS k FROM c GROUP BY 1, 2), t AS (SELECT doc_id, sum(k) AS s, count(*) AS u FROM n GROUP BY 1)
SELECT n.doc_id, round(CASE WHEN any_value(u) > 1 THEN -sum(k / s * log2(k / s)) / log2(any_value(u)) ELSE 0 END, 6) AS entropy FROM n JOIN t ON n.doc_id = t.doc_id GROUP BY 1""")
def entropy_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    chars = table(spark, sf_dir, "documents").where("length(text) > 1").select("doc_id", F.explode(F.split("text", "")).alias("ch"))
    counts = chars.groupBy("doc_id", "ch").agg(F.count("*").alias("k"))
    # sum of p log p from two moments, so that one pass over the counts is enough
    m = counts.groupBy("doc_id").agg(F.sum("k").alias("s"), F.count("*").alias("u"), F.sum(F.col("k") * F.log2("k")).alias("klogk"))
    h = F.log2("s") - F.col("klogk") / F.col("s")
    return m.select("doc_id", F.round(F.when(F.col("u") > 1, h / F.log2("u")).otherwise(0.0), 6).alias("entropy"))


@query(f"SELECT doc_id, count(*) AS n_terms, count(DISTINCT term) AS distinct_terms FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), {q(P.TERM)})) AS term FROM documents) GROUP BY 1")
def bm25_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(X.terms(F.col("text"))).alias("term")).groupBy("doc_id").agg(F.count("*").alias("n_terms"), F.count_distinct("term").alias("distinct_terms"))


@query(r"SELECT page_id, regexp_matches(url, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+[.][a-zA-Z]{2,}') AS email, regexp_matches(url, '[a-zA-Z0-9]([a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?([.][a-zA-Z0-9]([a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?)*[.][a-zA-Z]{2,}') AS host FROM pages")
def identifier_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", X.is_email(u).alias("email"), X.is_hostname(u).alias("host"))


# content detection


def _counted(lines_sql: str, pattern: str) -> str:
    return f"len(list_filter({lines_sql}, lambda x: regexp_matches(x, {q(pattern)})))"


def detection_sql(rows: str, key: str) -> str:
    """The cascade over (key, text) rows; JSON by the parser."""
    filled = lambda n: f"list_filter(string_split(text, chr(10))[1:{n}], lambda x: NOT regexp_matches(x, '^[ \\t\\r\\n\\x0b\\x0c]*$'))"
    tag = lambda n: f"regexp_matches(h, '(?i)<{n}[ \\t>\\n/]')"
    code = ", ".join(
        f"[len(list_filter(l100, lambda x: regexp_matches(x, {q(p)}))), -coalesce(list_position(list_transform(l100, lambda x: regexp_matches(x, {q(p)})), true), 0), -{i}]" for i, p in enumerate(P.LANGUAGES.values())
    )
    return f"""
WITH r AS ({rows}), a AS (SELECT {key}, text, left(text, 3000) AS h, string_split(text, chr(10))[1:500] AS l500, {filled(100)} AS l100, {filled(200)} AS l200 FROM r),
b AS (SELECT {key}, text, {_counted("l500", P.DIFF_HEADER)} AS dh, {_counted("l500", P.DIFF_CHANGE)} AS dc,
  regexp_matches(h, {q(P.DOCTYPE)}) AS dt, {tag("html")} AS th, {tag("head")} AS te, {tag("body")} AS tb, len(regexp_extract_all(h, '(?i)<({"|".join(P.HTML_TAGS)})[ \\t>\\n/]')) AS st,
  {_counted("l100", P.SEARCH_HIT)} AS sh, len(l100) AS n100, {_counted("l200", P.LOG_ERROR)} AS le, {_counted("l200", f"({P.LOG_ERROR})|{P.LOG_OTHER}")} AS lm, len(l200) AS n200, list_max([{code}])[1] AS cs FROM a),
c AS (SELECT {key}, text,
  CASE WHEN dh > 0 THEN least(0.5 + 0.2 * dh + 0.05 * dc, 1.0) END AS diff,
  CASE WHEN dt OR th OR st >= 3 THEN least(0.5 * dt::int + 0.3 * th::int + 0.1 * te::int + 0.1 * tb::int + least(0.03 * st, 0.3), 1.0) END AS html,
  CASE WHEN n100 > 0 AND sh / n100 >= 0.3 THEN least(0.4 + 0.6 * sh / n100, 1.0) END AS search,
  CASE WHEN n200 > 0 AND lm / n200 >= 0.1 THEN least(0.3 + 0.5 * lm / n200 + 0.05 * le, 1.0) END AS build,
  CASE WHEN cs >= 3 THEN least(0.4 + 0.4 * cs / greatest(n100, 1) + 0.02 * cs, 1.0) END AS source_code FROM b)
SELECT {key}, CASE WHEN trim(text) = '' THEN 'text' WHEN diff >= 0.7 THEN 'diff' WHEN html >= 0.7 THEN 'html' WHEN search >= 0.6 THEN 'search' WHEN build >= 0.5 THEN 'build' WHEN source_code >= 0.5 THEN 'source_code' ELSE 'text' END AS content_type,
  round(CASE WHEN trim(text) = '' THEN 0.0 WHEN diff >= 0.7 THEN diff WHEN html >= 0.7 THEN html WHEN search >= 0.6 THEN search WHEN build >= 0.5 THEN build WHEN source_code >= 0.5 THEN source_code ELSE 0.5 END, 6)::double AS confidence FROM c"""


def _detected(rows: DataFrame, key: str) -> DataFrame:
    return detect.classify(rows.select(key, "text")).select(key, "content_type", F.round("confidence", 6).alias("confidence"))


@query(detection_sql("SELECT doc_id, text FROM documents WHERE text IS NOT NULL", "doc_id"))
def detect_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _detected(texts(spark, sf_dir, "documents").where("text IS NOT NULL"), "doc_id")


@query(detection_sql("SELECT page_id, html AS text FROM pages WHERE html IS NOT NULL", "page_id"))
def detect_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _detected(texts(spark, sf_dir, "pages").where("html IS NOT NULL").select("page_id", F.col("html").alias("text")), "page_id")


def event_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, text): the log of each user."""
    rows = event_lines(spark, sf_dir).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("r"))
    return rows.select("user_id", F.array_join(F.transform("r", lambda x: x["line"]), "\n").alias("text"))


@query(detection_sql(f"WITH {EVENT_SQL} SELECT user_id, string_agg(line, chr(10) ORDER BY line_no) AS text FROM l GROUP BY 1", "user_id"))
def detect_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _detected(event_blocks(spark, sf_dir), "user_id")


def hit_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(block, lang, text): lines of documents as hits file:number:content, one block per document."""
    d = texts(spark, sf_dir, "documents").where("text IS NOT NULL")
    file = F.concat("source", F.lit("/d"), F.col("doc_id").cast("string"), F.lit(".txt"))
    hits = d.select("doc_id", "lang", file.alias("file"), F.split("text", "\n").alias("l"))
    # blank lines are no hits; numbers are those of all lines
    numbered = F.transform("l", lambda x, i: F.when(F.trim(x) != "", F.concat_ws(":", F.col("file"), (i + 1).cast("string"), x)))
    return hits.select(F.col("doc_id").alias("block"), "lang", F.array_join(numbered, "\n").alias("text"))


@query(f"""WITH {LINES_SQL}, h AS (SELECT x.source AS file, x.doc_id, x.line_no + 1 AS n FROM x WHERE trim(line) <> '')
SELECT file, count(*) AS hits, least(count(*), 5) AS kept, CASE WHEN count(*) > 5 THEN '[... and ' || (count(*) - 5) || ' more matches in ' || file || ']' END AS note FROM h GROUP BY 1""")
def search_file_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    filled = F.size(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")).cast("long")
    rows = d.select(F.col("source").alias("file"), filled.alias("n")).where("n > 0")
    hits = F.col("hits")
    return rows.groupBy("file").agg(F.sum("n").alias("hits")).select("file", "hits", F.least(hits, F.lit(5)).cast("long").alias("kept"), F.when(hits > 5, F.concat(F.lit("[... and "), (hits - 5).cast("string"), F.lit(" more matches in "), "file", F.lit("]"))).alias("note"))


# records and fields

LINE_FIELDS = ["l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


def line_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of line items; a supplier is a block."""
    rows = table(spark, sf_dir, "lineitem").withColumn("idx", F.col("l_orderkey") * 8 + F.col("l_linenumber"))
    return items.column_cells(rows, "l_suppkey", F.col("idx"), LINE_FIELDS)


_NUMERIC = ("l_quantity", "l_discount", "l_tax")
_CELLS_SQL = "cells AS (" + " UNION ALL ".join(
    f"SELECT l_suppkey, l_orderkey * 8 + l_linenumber AS item_idx, '{c}' AS name, {c}::varchar AS value, {c if c in _NUMERIC else 'NULL'}::double AS number FROM lineitem" for c in LINE_FIELDS
) + ")"


@query(f"WITH {_CELLS_SQL}, n AS (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1) SELECT c.l_suppkey, name, any_value(n) AS n, count(DISTINCT value) AS n_unique, round(count(DISTINCT value) / any_value(n), 6) AS unique_ratio, min(number) AS low, max(number) AS high, round(avg(number) + 1e-9, 4) AS mean, round(CASE WHEN any_value(name) IN ('l_quantity', 'l_discount', 'l_tax') THEN coalesce(var_samp(number), 0.0) END + 1e-9, 4) AS variance FROM cells c JOIN n ON n.l_suppkey = c.l_suppkey GROUP BY 1, 2")
def field_profile_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"))
    p = items.profile(line_cells(spark, sf_dir), sizes, "l_suppkey")
    return p.select("l_suppkey", "name", "n", "n_unique", F.round("unique_ratio", 6).alias("unique_ratio"), "low", "high", F.round(F.col("mean") + 1e-9, 4).alias("mean"), F.round(F.col("variance") + 1e-9, 4).alias("variance"))


@query("""WITH k AS (SELECT event_type, json_extract(props, '$.k')::double AS number, event_id FROM events)
SELECT event_type, 'k' AS name, count(*) AS n, count(DISTINCT number) AS n_unique, min(number) AS low, max(number) AS high, round(avg(number), 6) AS mean FROM k GROUP BY 1""")
def field_profile_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    cells = items.variant_cells(e.select("event_type", F.col("event_id").alias("item_idx"), F.try_parse_json("props").alias("v")), "event_type")
    p = items.profile(cells, e.groupBy("event_type").agg(F.count("*").alias("n")), "event_type")
    return p.select("event_type", "name", "n", "n_unique", "low", "high", F.round("mean", 6).alias("mean"))


@query(f"WITH {_CELLS_SQL}, v AS (SELECT l_suppkey, name, value, count(*) AS n, min(item_idx) AS first_idx FROM cells WHERE name IN ('l_returnflag', 'l_linestatus') GROUP BY 1, 2, 3) SELECT * FROM (SELECT l_suppkey, name, value, n, row_number() OVER (PARTITION BY l_suppkey, name ORDER BY n DESC, first_idx, value) AS rank FROM v) WHERE rank <= 5")
def top_values_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = line_cells(spark, sf_dir).where("kind = 'string'")
    return items.top_values(cells, 5, "l_suppkey").select("l_suppkey", "name", "value", "n", "rank")


@query("SELECT o_orderpriority, count(o_totalprice) AS n, round(avg(o_totalprice), 4) AS mean, round(median(o_totalprice), 4) AS median, round(stddev_samp(o_totalprice), 4) AS stddev, round(quantile_cont(o_totalprice, 0.25), 4) AS p25, round(quantile_cont(o_totalprice, 0.75), 4) AS p75 FROM orders GROUP BY 1")
def percentiles_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = items.spread_quantiles(table(spark, sf_dir, "orders"), "o_totalprice", "o_orderpriority")
    return s.select("o_orderpriority", "n", *(F.round(c, 4).alias(c) for c in ("mean", "median", "stddev", "p25", "p75")))


@query("""WITH s AS (SELECT o_custkey, avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS sd FROM orders GROUP BY 1)
SELECT o.o_custkey, o_orderkey FROM orders o JOIN s ON s.o_custkey = o.o_custkey WHERE sd > 0 AND abs(o_totalprice - m) > 2 * sd""")
def zscore_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = items.column_cells(table(spark, sf_dir, "orders"), "o_custkey", F.col("o_orderkey"), ["o_totalprice"])
    return items.numeric_outliers(cells, 2.0, "o_custkey").select("o_custkey", F.col("item_idx").alias("o_orderkey"))


_STATUS_SQL = """c AS (SELECT o_custkey, o_orderstatus AS v, count(*) AS c FROM orders GROUP BY 1, 2),
r AS (SELECT *, sum(c) OVER (PARTITION BY o_custkey) AS total, count(*) OVER (PARTITION BY o_custkey) AS card, coalesce(sum(c) OVER (PARTITION BY o_custkey ORDER BY c DESC, v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c),
h AS (SELECT *, count(*) OVER (PARTITION BY o_custkey) AS size FROM r WHERE card BETWEEN 2 AND 50 AND before < ceil(total * 0.8 - 1e-6))"""


@query(f"WITH {_STATUS_SQL} SELECT o_custkey, v AS value, c, total::bigint AS total FROM h WHERE size <= 5")
def pareto_head_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = items.column_cells(table(spark, sf_dir, "orders"), "o_custkey", F.col("o_orderkey"), ["o_orderstatus"])
    return items.pareto_head(cells, key="o_custkey").select("o_custkey", "value", "c", "total")


@query(f"WITH {_STATUS_SQL}, hh AS (SELECT * FROM h WHERE size <= 5) SELECT o.o_custkey, o.o_orderkey FROM orders o WHERE o.o_custkey IN (SELECT o_custkey FROM hh) AND NOT EXISTS (SELECT 1 FROM hh WHERE hh.o_custkey = o.o_custkey AND hh.v = o.o_orderstatus)")
def rare_status_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = items.column_cells(table(spark, sf_dir, "orders"), "o_custkey", F.col("o_orderkey"), ["o_orderstatus"])
    return items.rare_status_items(cells, "o_custkey").select("o_custkey", F.col("item_idx").alias("o_orderkey"))


@query("""WITH c AS (SELECT event_type, event_id, 'k' || (json_extract(props, '$.k')::int % 40) AS name FROM events), n AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1),
r AS (SELECT c.event_type, name FROM c JOIN n ON n.event_type = c.event_type GROUP BY 1, 2, n HAVING n >= 5 AND count(DISTINCT event_id) < 0.0255 * n)
SELECT DISTINCT c.event_type, event_id FROM c JOIN r ON r.event_type = c.event_type AND r.name = c.name""")
def structural_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    cells = e.select("event_type", F.col("event_id").alias("item_idx"), F.concat(F.lit("k"), (F.get_json_object("props", "$.k").cast("int") % 40).cast("string")).alias("name"))
    # the share is lower than an array's fifth, so that these few names differ at all
    sizes = e.groupBy("event_type").agg((F.count("*") * (0.0255 / 0.2)).alias("n"))
    return items.rare_key_items(cells, sizes, "event_type").select("event_type", F.col("item_idx").alias("event_id"))


@query("""WITH o AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY user_id) AS n, stddev_samp(value) OVER (PARTITION BY user_id) AS sd,
  avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS b, avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS a
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, event_id FROM o WHERE i > 5 AND i <= n - 5 AND sd > 0 AND abs(a - b) > 1.0 * sd""")
def change_points_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items.change_points(table(spark, sf_dir, "events"), "value", "user_id", ["ts", "event_id"], sigma=1.0).select("user_id", "event_id")


@query("""WITH g AS (SELECT o_custkey, o_orderkey - lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS gap, o_orderkey - lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS up FROM orders)
SELECT o_custkey, count(*) AS n, coalesce(count(*) >= 5 AND avg(gap) BETWEEN 0.5 AND 2.0 AND avg((gap BETWEEN 0.5 AND 2.0)::int) > 0.8 AND avg((up >= 0)::int) > 0.7, false) AS is_sequential FROM g GROUP BY 1""")
def sequential_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = items.sequential_fields(table(spark, sf_dir, "orders"), "o_orderkey", "o_custkey", ["o_orderdate", "o_orderkey"])
    return s.select("o_custkey", "n", F.coalesce("is_sequential", F.lit(False)).alias("is_sequential"))


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n <= 12")
def topn_by_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items.top_n(table(spark, sf_dir, "orders"), 12, "o_custkey", [F.desc("o_totalprice"), "o_orderkey"]).select("o_custkey", "o_orderkey")


@query("WITH i AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) SELECT o_custkey, o_orderkey FROM i WHERE i % greatest(1, (n - 1) // 5) = 0")
def stride_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items.stride_sample(table(spark, sf_dir, "orders"), F.lit(4), "o_custkey", ["o_orderkey"]).select("o_custkey", "o_orderkey")


@query("""WITH i AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY i % greatest(1, n // 5), i) AS p FROM i) WHERE p <= 4""")
def interleaved_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items.interleaved_fill(table(spark, sf_dir, "orders"), 4, "o_custkey", ["o_orderkey"]).select("o_custkey", "o_orderkey")


@query("""WITH i AS (SELECT o_custkey, o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders),
r AS (SELECT *, CASE WHEN o_orderpriority = '1-URGENT' THEN 0 WHEN i <= 3 THEN 1 WHEN i > n - 2 THEN 2 ELSE 3 END AS r FROM i)
SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY r, i) AS p FROM r) WHERE p <= 6 OR r = 0""")
def critical_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items.critical_first(table(spark, sf_dir, "orders"), F.col("o_orderpriority") == "1-URGENT", 6, "o_custkey", ["o_orderkey"]).select("o_custkey", "o_orderkey")


@query("SELECT doc_id, cluster FROM (SELECT doc_id, substr(md5(left(text, 50)), 1, 8) AS cluster, row_number() OVER (PARTITION BY source, substr(md5(left(text, 50)), 1, 8) ORDER BY doc_id) AS n FROM documents WHERE text IS NOT NULL) WHERE n <= 2")
def cluster_representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items.representatives(table(spark, sf_dir, "documents").where("text IS NOT NULL"), F.col("text"), 2, "source", ["doc_id"]).select("doc_id", "cluster")


_CURVE_SQL = """l AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\r]+'), lambda x: x <> '') AS w FROM conversations WHERE text IS NOT NULL),
p AS (SELECT conv_id, turn, unnest(CASE WHEN len(w) > 1 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE [array_to_string(w, ' ')] END) AS pair FROM l),
f AS (SELECT conv_id, pair, min(turn) AS turn FROM p GROUP BY 1, 2), n AS (SELECT conv_id, turn, count(*) AS k FROM f GROUP BY 1, 2),
curve AS (SELECT l.conv_id, l.turn, sum(coalesce(k, 0)) OVER (PARTITION BY l.conv_id ORDER BY l.turn)::bigint AS distinct_pairs FROM l LEFT JOIN n ON n.conv_id = l.conv_id AND n.turn = l.turn)"""


@query(f"WITH {_CURVE_SQL} SELECT * FROM curve")
def bigram_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items.pair_curve(table(spark, sf_dir, "conversations").where("text IS NOT NULL"), F.col("text"), "conv_id", "turn")


@query(f"""WITH {_CURVE_SQL}, s AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n, min(distinct_pairs) OVER (PARTITION BY conv_id) AS lo, max(distinct_pairs) OVER (PARTITION BY conv_id) AS hi FROM curve),
d AS (SELECT conv_id, i, CASE WHEN hi > lo THEN round((distinct_pairs - lo) / (hi - lo) - i / (n - 1), 9) END AS d FROM s WHERE n >= 3)
SELECT conv_id, CASE WHEN max(d) IS NULL THEN 1 WHEN max(d) >= 0.05 THEN arg_max(i, d * 1000000 - i * 1e-6) + 1 END::int AS knee FROM d GROUP BY 1""")
def knee_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items.knee(bigram_curve(spark, sf_dir), "conv_id", "turn")


# relevance


@query(f"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), {q(P.TERM)})) AS term FROM documents),
d AS (SELECT doc_id, len(regexp_extract_all(lower(text), {q(P.TERM)})) AS len FROM documents), a AS (SELECT avg(len) AS avgdl FROM d),
tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY 1, 2), qf AS (SELECT item_id AS query_id, term, count(*) AS qf FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), {q(P.TERM)})) AS term FROM benchmark) GROUP BY 1, 2),
s AS (SELECT tf.doc_id, query_id, sum(ln(2) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avgdl)) * qf) AS raw, bool_or(octet_length(encode(tf.term)) >= 8) AS l, count(*) AS n_matched FROM tf JOIN qf ON qf.term = tf.term JOIN d ON d.doc_id = tf.doc_id, a GROUP BY 1, 2),
r AS (SELECT doc_id, query_id, round(CASE WHEN l THEN least(least(raw / 10, 1.0) + 0.3, 1.0) ELSE least(raw / 10, 1.0) END, 6) AS score, n_matched FROM s)
SELECT doc_id, query_id, score, n_matched FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, n_matched DESC, doc_id) AS n FROM r) WHERE n <= 10""")
def bm25_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top ten documents for every item of the benchmark."""
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    scored = relevance.bm25(texts(spark, sf_dir, "documents"), queries).select("doc_id", "query_id", F.round("score", 6).alias("score"), F.size("matched").cast("long").alias("n_matched"))
    return items.top_n(scored, 10, "query_id", [F.desc("score"), F.desc("n_matched"), "doc_id"])


@query("""WITH s AS (SELECT q.vec_id AS query_id, e.vec_id, e.label, round(greatest(list_cosine_similarity(e.embedding::double[], q.embedding::double[]), 0.0), 5) AS score FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0)
SELECT vec_id, label, query_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s) WHERE n <= 10""")
def cosine_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every vector whose id is divisible by 100."""
    e = table(spark, sf_dir, "embeddings")
    ask = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return relevance.nearest(e, ask, 10).select("vec_id", "label", "query_id", "score")


# conversations, policy, stores


@query("SELECT conv_id, turn, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id) AS last_user FROM conversations")
def last_user_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.last_index(table(spark, sf_dir, "conversations"), "user", "conv_id", "turn").select("conv_id", "turn", "last_user")


@query("SELECT conv_id, coalesce(max(CASE WHEN length(text) > 400 THEN turn END) + 1, 0) AS frozen FROM conversations GROUP BY 1")
def frozen_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of more than 400 characters carry the mark here."""
    m = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("msg_idx"), (F.length("text") > 400).alias("has_mark"))
    return policy.frozen_prefix(m, "conv_id")


@query("""WITH m AS (SELECT conv_id, turn AS pos, role AS section, CASE WHEN length(text) % 3 = 0 THEN '1h' WHEN length(text) % 3 = 1 THEN '5m' END AS ttl FROM conversations),
s AS (SELECT *, coalesce(max((coalesce(ttl, '5m') = '5m')::int) OVER (PARTITION BY conv_id, section ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM m)
SELECT conv_id, section, coalesce(bool_or(seen = 1 AND ttl = '1h'), false) AS violated FROM s GROUP BY 1, 2""")
def ttl_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("text") % 3
    m = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("pos"), F.col("role").alias("section"), F.when(n == 0, "1h").when(n == 1, "5m").alias("ttl"))
    return policy.ttl_violations(m, "conv_id")


@query("""WITH h AS (SELECT conv_id, turn, substr(sha256(text), 1, 16) AS prefix_hash FROM conversations WHERE text IS NOT NULL)
SELECT conv_id, turn, prefix_hash, lag(prefix_hash) OVER w AS previous_hash, coalesce(lag(prefix_hash) OVER w <> prefix_hash, false) AS prefix_changed FROM h WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def prefix_drift_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").where("text IS NOT NULL")
    return policy.prefix_drift(c, F.col("text"), "conv_id", "turn").select("conv_id", "turn", "prefix_hash", "previous_hash", "prefix_changed")


@query("""WITH a AS (SELECT conv_id, turn, 'call' || ((turn + 1) // 2) AS id FROM conversations WHERE role = 'assistant'), r AS (SELECT conv_id, turn, 'call' || (turn // 2) AS id FROM conversations WHERE role = 'user'),
l AS (SELECT conv_id, id, max(turn) AS call_idx FROM a GROUP BY 1, 2) SELECT DISTINCT r.conv_id, call_idx, r.turn AS result_idx FROM r JOIN l ON l.conv_id = r.conv_id AND l.id = r.id""")
def tool_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns play the tool results of the assistant's calls."""
    c = table(spark, sf_dir, "conversations")
    turn, call = F.col("turn"), lambda n: F.concat(F.lit("call"), n.cast("long").cast("string"))
    m = c.select("conv_id", turn.alias("msg_idx"), F.when(F.col("role") == "user", "tool").otherwise(F.col("role")).alias("role"), F.when(F.col("role") == "assistant", F.array(call(F.floor((turn + 1) / 2)))).alias("call_ids"), F.when(F.col("role") == "user", call(F.floor(turn / 2))).alias("tool_call_id"))
    return policy.tool_pairs(m)


@query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'subscription' WHEN 1 THEN 'oauth' ELSE 'payg' END AS auth, CASE c_custkey % 4 WHEN 0 THEN 32 ELSE 128 END AS volatile_tokens, (CASE c_custkey % 4 WHEN 0 THEN 0.25 ELSE 0.45 END)::double AS max_lossy_ratio FROM customer""")
def auth_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey") % 4
    headers = F.when(k == 0, F.create_map(F.lit("User-Agent"), F.lit("Cursor/1.2"))).when(k == 1, F.create_map(F.lit("authorization"), F.lit("Bearer a.b.c"))).when(k == 2, F.create_map(F.lit("x-api-key"), F.lit("k"))).otherwise(F.create_map(F.lit("Authorization"), F.lit("Bearer sk-abc")))
    out = table(spark, sf_dir, "customer").select("c_custkey", policy.auth_mode(headers).alias("auth"))
    p = policy.policy(F.col("auth"))
    return out.select("c_custkey", "auth", p["volatile_tokens"].alias("volatile_tokens"), p["max_lossy_ratio"].alias("max_lossy_ratio"))


@query("""SELECT o_orderkey, round(o_custkey::double * (1.25 + 0.1 * ((o_orderkey % 7) - 1)) - 0.5 * 1.15 * (o_orderkey % 500), 6)::double AS gain, round(CASE WHEN o_custkey = 0 THEN 0 ELSE 11.5 * ((o_orderkey % 500)::double / o_custkey - 1) END, 6)::double AS break_even FROM orders""")
def policy_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, s = F.col("o_custkey").cast("double"), (F.col("o_orderkey") % 500).cast("double")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(policy.mutation_gain(d, s, (F.col("o_orderkey") % 7).cast("double"), F.lit(0.5)), 6).alias("gain"), F.round(F.coalesce(policy.break_even_reads(d, s), F.lit(0.0)), 6).alias("break_even"))


# block compressors: sequential kernels have no SQL; a lossless or countable property of their result is compared instead


@query()
def log_compress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's log, shortened."""
    return event_blocks(spark, sf_dir).withColumn("r", compress.logs(F.col("text"))).select("user_id", "r.compressed", "r.lines_in", "r.lines_out", "r.format", "r.errors", "r.warnings", "r.info")


@query(f"WITH {EVENT_SQL} SELECT user_id, count(*)::int AS lines_in, count(*) FILTER (level = 'error')::int AS errors, count(*) FILTER (level = 'warn')::int AS warnings, count(*) FILTER (level = 'info')::int AS info FROM c GROUP BY 1 HAVING count(*) >= 50")
def log_compress_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the trailers of shortened logs count: the levels of all lines."""
    return log_compress(spark, sf_dir).where("lines_in >= 50").select("user_id", "lines_in", "errors", "warnings", "info")


@query()
def search_compress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hit_blocks(spark, sf_dir).withColumn("r", compress.search(F.col("text"))).select("block", "lang", "r.compressed", "r.hits_in", "r.hits_out", "r.files")


@query("SELECT lang AS block, count(*)::int AS hits_in FROM (SELECT lang, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL) WHERE trim(line) <> '' GROUP BY 1")
def search_compress_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits that the compressor read, by language."""
    counts = search_compress(spark, sf_dir).groupBy(F.col("lang").alias("block"))
    return counts.agg(F.sum("hits_in").cast("int").alias("hits_in")).where("hits_in > 0")


def order_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(o_custkey, text): the orders of each customer as a JSON array."""
    row = F.struct("o_orderkey", "o_orderstatus", F.round("o_totalprice", 2).alias("o_totalprice"), "o_orderpriority")
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(row)).alias("r"))
    return o.select("o_custkey", F.concat(F.lit("["), F.array_join(F.transform("r", lambda x: F.to_json(x)), ","), F.lit("]")).alias("text"))


@query()
def crush_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_arrays(spark, sf_dir).withColumn("r", compress.crush(F.col("text"))).select("o_custkey", "r.compressed", "r.was_modified", "r.strategy")


@query("""WITH r AS (SELECT o_custkey, o_orderkey, o_orderpriority, o_orderstatus, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
SELECT o_custkey, '[' || any_value(n) || ']{o_orderkey:int,o_orderpriority:string,o_orderstatus:string}' || chr(10) || string_agg(o_orderkey || ',' || o_orderpriority || ',' || o_orderstatus || chr(10), '' ORDER BY o_orderkey) AS rendered FROM r WHERE n >= 2 GROUP BY 1""")
def table_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lossless table of each customer's orders."""
    row = F.struct("o_orderkey", "o_orderstatus", "o_orderpriority")
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(row)).alias("r"))
    blocks = o.select("o_custkey", F.to_json("r").alias("text"))
    return blocks.select("o_custkey", compress.table(F.col("text")).alias("rendered")).where("rendered IS NOT NULL")


@query()
def crush_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", F.round("o_totalprice", 2).alias("p")))).alias("r"))
    blocks = o.select("o_custkey", F.to_json(F.transform("r", lambda x: x["p"])).alias("text"))
    return blocks.withColumn("r", compress.crush(F.col("text"))).select("o_custkey", "r.compressed", "r.strategy")


@query()
def json_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_arrays(spark, sf_dir).withColumn("r", compress.json_structure(F.col("text"))).select("o_custkey", "r.compressed", "r.keys")


@query("SELECT o_custkey, (4 * count(*))::int AS keys FROM orders GROUP BY 1")
def json_structure_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return json_structure(spark, sf_dir).select("o_custkey", "keys")


@query()
def log_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_blocks(spark, sf_dir).select("user_id", compress.log_template(F.col("text")).alias("collapsed"))


@query("SELECT page_id, md5(html) AS content_hash FROM pages WHERE html IS NOT NULL")
def tag_protect_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages behind placeholders and back are what they were."""
    p = table(spark, sf_dir, "pages").where("html IS NOT NULL").withColumn("p", compress.protect_tags(F.col("html")))
    return p.select("page_id", F.md5(compress.restore_tags(F.col("p.text"), F.col("p.names"))).alias("content_hash"))


def near_copy_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text): a unified diff made of each document's lines, with every seventh line replaced."""
    rows = lines.lines(table(spark, sf_dir, "documents").where("text IS NOT NULL"))
    body = F.when(F.col("line_no") % 7 == 3, F.concat(F.lit("-"), "line", F.lit("\n+"), F.upper("line"))).otherwise(F.concat(F.lit(" "), "line"))
    g = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line_no", body.alias("b")))).alias("r"))
    name = F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".txt"))
    head = F.concat(F.lit("diff --git a/"), name, F.lit(" b/"), name, F.lit("\n--- a/"), name, F.lit("\n+++ b/"), name, F.lit("\n@@ -1,"), F.size("r").cast("string"), F.lit(" +1,"), F.size("r").cast("string"), F.lit(" @@\n"))
    return g.select("doc_id", F.concat(head, F.array_join(F.transform("r", lambda x: x["b"]), "\n")).alias("text"))


@query()
def diff_compress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copy_diffs(spark, sf_dir).withColumn("r", compress.diffs(F.col("text"))).select("doc_id", "r.compressed", "r.lines_in", "r.lines_out", "r.files", "r.additions", "r.deletions")


@query("WITH x AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents WHERE text IS NOT NULL) SELECT doc_id, count(*) FILTER (line_no % 7 = 3) AS additions, count(*) FILTER (line_no % 7 = 3) AS deletions, 1::bigint AS hunks FROM x GROUP BY 1")
def diff_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Additions and deletions counted from the diffs' lines by windows and a rollup."""
    t = lines.diff_totals(lines.lines(near_copy_diffs(spark, sf_dir)))
    return t.where("file_no IS NULL").select("doc_id", "additions", "deletions", "hunks")


@query("WITH x AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no, len(string_split(text, chr(10))) AS n FROM documents WHERE text IS NOT NULL), k AS (SELECT doc_id, n, line_no, (line_no % 7 = 3)::int AS c FROM x), m AS (SELECT *, max(c) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM k) SELECT doc_id, CASE WHEN any_value(n) < 4 THEN least(any_value(n), 2) ELSE sum(near + c * near) END::bigint AS kept FROM m GROUP BY 1")
def diff_context_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lines.trimmed_context(lines.lines(near_copy_diffs(spark, sf_dir)))
    return t.groupBy("doc_id").agg(F.count("*").alias("kept"))


# plans


@query()
def pipeline_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline.run(event_blocks(spark, sf_dir)).select("user_id", "content_type", "output", "saved", "steps")


@query()
def pipeline_bloat(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = detect.classify(event_blocks(spark, sf_dir))
    return blocks.select("user_id", "content_type", F.explode(pipeline.bloat_scores(F.col("text"), F.col("content_type"))).alias("offload", "bloat"))


def conversation_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as a request body in the Messages format; every third one's last user turn holds a log."""
    c = table(spark, sf_dir, "conversations")
    turn = F.struct("turn", F.col("role"), F.col("text").alias("content"))
    g = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    logs = event_blocks(spark, sf_dir).select(F.col("user_id").alias("conv_id"), F.col("text").alias("log"))
    g = g.join(logs, "conv_id", "left").withColumn("log", F.when(F.col("conv_id") % 3 == 0, F.col("log")))
    messages = F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))
    messages = F.when(F.col("log").isNotNull(), F.concat(messages, F.array(F.struct(F.lit("user").alias("role"), F.col("log").alias("content"))))).otherwise(messages)
    return g.select(F.col("conv_id").cast("string").alias("request_id"), F.lit("messages").alias("format"), F.lit(None).cast("string").alias("mode"), F.to_json(F.struct(messages.alias("messages"))).alias("body"))


def format_requests(spark: SparkSession, sf_dir: str, form: str) -> DataFrame:
    """Each conversation as a request body of a format; the assistant's long turns play users and tools."""
    c = table(spark, sf_dir, "conversations")
    i = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    text, said = F.col("text"), F.col("role") == "assistant"
    if form == "responses":
        part = F.array(F.struct(F.lit("input_text").alias("type"), text.alias("text")))
        item = F.struct("turn", F.when(said, "function_call_output").otherwise("message").alias("type"), F.when(said, text).alias("output"), F.when(~said, part).alias("content"))
    else:
        role = F.when(said, F.when(F.col("i") % 4 == 1, "tool").otherwise("assistant") if form == "chat" else F.lit("user")).when((F.col("role") == "user") & (F.lit(form) == "messages"), "assistant").otherwise(F.col("role"))
        item = F.struct("turn", role.alias("role"), text.alias("content"))
    g = c.withColumn("i", i).groupBy("conv_id").agg(F.array_sort(F.collect_list(item)).alias("t"))
    items_ = F.transform("t", lambda x: x.dropFields("turn"))
    return g.select(F.col("conv_id").cast("string").alias("request_id"), F.lit(form).alias("format"), F.lit(None).cast("string").alias("mode"), F.to_json(F.struct(items_.alias("input" if form == "responses" else "messages"))).alias("body"))


def _routed(spark: SparkSession, sf_dir: str, form: str) -> DataFrame:
    return livezone.parts(format_requests(spark, sf_dir, form)).select("request_id", "idx", "action", "reason", F.md5("text").alias("text_md5"))


_TURNS_SQL = "t AS (SELECT conv_id::varchar AS request_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::int AS i, role AS said, text, coalesce(octet_length(encode(text)), 0) >= 512 AS long FROM conversations)"
_PARTS_SQL = "SELECT request_id, idx, CASE WHEN reason IS NULL THEN 'candidate' WHEN idx < 0 THEN 'none' ELSE 'excluded' END AS action, reason, CASE WHEN reason IS NULL THEN md5(text) END AS text_md5 FROM f"


@query(f"""WITH {_TURNS_SQL}, m AS (SELECT *, CASE said WHEN 'assistant' THEN 'user' WHEN 'user' THEN 'assistant' ELSE said END AS role FROM t),
l AS (SELECT *, max(CASE WHEN role = 'user' THEN i END) OVER (PARTITION BY request_id) AS live FROM m),
f AS (SELECT request_id, i AS idx, text, CASE WHEN i < live THEN 'frozen_by_policy' WHEN i > live THEN 'latest_assistant' WHEN NOT long THEN 'too_small' END AS reason FROM l WHERE i <= live OR role = 'assistant' AND live IS NOT NULL
UNION ALL SELECT DISTINCT request_id, -1, NULL, 'no_live_user_message' FROM l WHERE live IS NULL) {_PARTS_SQL}""")
def route_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of bodies in the Messages format and their verdicts."""
    return _routed(spark, sf_dir, "messages")


@query(f"""WITH {_TURNS_SQL}, m AS (SELECT *, CASE WHEN said = 'assistant' AND i % 4 = 1 THEN 'tool' ELSE said END AS role FROM t),
l AS (SELECT *, max(CASE WHEN role = 'user' THEN i END) OVER (PARTITION BY request_id) AS u, max(CASE WHEN role = 'tool' THEN i END) OVER (PARTITION BY request_id) AS o FROM m),
f AS (SELECT request_id, i AS idx, text, CASE WHEN role = 'system' THEN 'system_message' WHEN i < least(coalesce(u, o), coalesce(o, u)) THEN 'frozen_by_policy'
WHEN role = 'assistant' THEN CASE WHEN i > coalesce(u, -1) OR i > coalesce(o, -1) THEN 'latest_assistant' ELSE 'frozen_by_policy' END END AS reason, long AND (role = 'tool' OR i = u) AS open FROM l WHERE coalesce(u, o) IS NOT NULL
UNION ALL SELECT DISTINCT request_id, -1, NULL, 'no_live_zone_candidates', false FROM l WHERE coalesce(u, o) IS NULL) {_PARTS_SQL} WHERE reason IS NOT NULL OR open""")
def route_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of bodies in the Chat format and their verdicts."""
    return _routed(spark, sf_dir, "chat")


@query(f"WITH {_TURNS_SQL}, f AS (SELECT request_id, i AS idx, text, CASE WHEN NOT long THEN 'too_small' END AS reason FROM t WHERE long OR said = 'assistant') {_PARTS_SQL}")
def route_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of bodies in the Responses format and their verdicts."""
    return _routed(spark, sf_dir, "responses")


@query()
def live_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return livezone.manifest(conversation_requests(spark, sf_dir)).select("request_id", "part", "idx", "action", "reason", "strategy", "original_tokens", "compressed_tokens", "compressed")


@query()
def live_zone_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = conversation_requests(spark, sf_dir)
    return livezone.outcomes(r, livezone.manifest(r))


@query()
def manifest_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.manifest_totals(livezone.manifest(conversation_requests(spark, sf_dir)))


@query("SELECT conv_id::varchar AS request_id, (turn)::int AS msg_idx, role FROM (SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn FROM conversations)")
def request_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages read back from the bodies as VARIANT."""
    m = R.messages(conversation_requests(spark, sf_dir))
    real = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").cast("string").alias("request_id")).agg(F.count("*").cast("int").alias("n"))
    return m.join(real, "request_id").where("msg_idx < n").select("request_id", "msg_idx", "role")


@query("SELECT substr(sha256(text), 1, 24) AS hash, md5(text) AS payload_md5 FROM documents WHERE text IS NOT NULL GROUP BY ALL")
def ccr_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads put into a store under their keys and got back by their keys."""
    from .sources.store import FolderStore, keyed, scratch

    d = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    store = FolderStore(spark, scratch(spark, "payloads"), ttl=3600, capacity=None)
    store.put(keyed(d))
    keys = d.select(H.payload_key(F.col("text")).alias("hash")).distinct()
    return store.get(keys).select("hash", F.md5("payload").alias("payload_md5"))


_HINTS_SQL = ", ".join(
    "[" + " + ".join(f"(length(text) - length(replace(text, {q(h)}, ''))) // {len(h)}" for h in hints) + f", -{i}]" for i, hints in enumerate(codetext.HINTS.values())
)


@query(f"""WITH b AS (SELECT doc_id, list_max([{_HINTS_SQL}]) AS b FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CASE WHEN b[1] > 0 THEN ([{", ".join(q(n) for n in codetext.HINTS)}])[1 - b[2]] ELSE 'unknown' END AS language FROM b""")
def code_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The programming language whose hints a text holds most."""
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", codetext.language_column(F.col("text")).alias("language"))


@query(r"""SELECT 'documents' AS source, doc_id AS id, CASE WHEN text IS NULL THEN 'null' WHEN text LIKE 'http://%' OR text LIKE 'https://%' THEN 'url'
  WHEN octet_length(encode(text)) >= 500 AND length(regexp_replace(text, '[^A-Za-z0-9+/=]', '', 'g')) > 0.8 * octet_length(encode(text)) THEN 'opaque' WHEN octet_length(encode(text)) >= 100 THEN 'long_string' ELSE 'short_string' END AS class FROM documents
UNION ALL SELECT 'hashes', doc_id, CASE WHEN text IS NULL THEN 'null' ELSE 'uuid' END FROM documents
UNION ALL SELECT 'pages', page_id, CASE WHEN url IS NULL THEN 'null' WHEN url LIKE 'http://%' OR url LIKE 'https://%' THEN 'url' WHEN octet_length(encode(url)) >= 100 THEN 'long_string' ELSE 'short_string' END FROM pages
UNION ALL SELECT 'orders', o_orderkey, CASE WHEN o_totalprice = floor(o_totalprice) THEN 'int' ELSE 'float' END FROM orders""")
def cell_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of texts, of their hashes in the form of a UUID, of addresses and of prices."""
    none = F.lit(None).cast("double")
    d, o = table(spark, sf_dir, "documents"), table(spark, sf_dir, "orders")
    m = F.md5("text")
    uuid = F.concat_ws("-", *(F.substring(m, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    row = lambda t, source, key, kind, value, number: t.select(F.lit(source).alias("source"), F.col(key).alias("id"), items.cell_class(F.lit(kind), value, number).alias("class"))
    out = row(d, "documents", "doc_id", "string", F.col("text"), none).union(row(d, "hashes", "doc_id", "string", F.when(m.isNotNull(), uuid), none))
    return out.union(row(table(spark, sf_dir, "pages"), "pages", "page_id", "string", F.col("url"), none)).union(row(o, "orders", "o_orderkey", "numeric", F.col("o_totalprice").cast("string"), F.col("o_totalprice").cast("double")))


@query("""WITH p AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN ' [' || props || '] ' WHEN 2 THEN event_type ELSE props || '}' END AS t FROM events)
SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'OBJECT' WHEN event_id % 4 = 1 THEN 'ARRAY' ELSE 'none' END AS kind FROM p""")
def container_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which strings hold a JSON container: properties, arrays of them, plain words, unbalanced ones."""
    k, p = F.col("event_id") % 4, F.col("props")
    text = F.when(k == 0, p).when(k == 1, F.concat(F.lit(" ["), p, F.lit("] "))).when(k == 2, F.col("event_type")).otherwise(F.concat(p, F.lit("}")))
    v = F.schema_of_variant(items.json_container(text))
    return table(spark, sf_dir, "events").select("event_id", F.when(v.startswith("OBJECT"), "OBJECT").when(v.startswith("ARRAY"), "ARRAY").otherwise("none").alias("kind"))


@query()
def array_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pattern, verdict and strategy of each customer's orders."""
    return order_arrays(spark, sf_dir).select("o_custkey", compress.array_analysis(F.col("text")).alias("a")).select("o_custkey", "a.*")


@query()
def anchor_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_arrays(spark, sf_dir).select("o_custkey", compress.anchor_places(F.col("text"), 8).alias("places"))


@query()
def adaptive_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lines of each user's log are worth keeping, and how many distinct ones there are."""
    rows = F.split("text", "\n")
    return event_blocks(spark, sf_dir).select("user_id", compress.adaptive_k(rows, 1.0, 10, 100).alias("k"), compress.near_clusters(rows).alias("clusters"))


@query("SELECT user_id, event_id, event_type = 'error' AS is_error FROM events WHERE regexp_matches(lower(event_type || ' ' || props), 'error|exception|failed|failure|critical|fatal|crash|panic|abort|timeout|denied|rejected')")
def error_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("raw", F.concat_ws(" ", "event_type", "props"))
    return items.error_items(e).select("user_id", "event_id", (F.col("event_type") == "error").alias("is_error"))


@query("""WITH p AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i, o_orderstatus FROM orders),
k AS (SELECT o_custkey, i, 'first' AS reason FROM p WHERE i < 2 UNION ALL SELECT o_custkey, i, 'status' FROM p WHERE o_orderstatus = 'P')
SELECT o_custkey, i::bigint AS item_idx, array_to_string(list_sort(list(DISTINCT reason)), ',') AS reasons FROM k GROUP BY 1, 2""")
def keep_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keep sets of two rules and why each item is in."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    p = table(spark, sf_dir, "orders").withColumn("item_idx", (F.row_number().over(w) - 1).cast("long"))
    first = p.where("item_idx < 2").select("o_custkey", "item_idx", F.lit("first").alias("reason"))
    status = p.where("o_orderstatus = 'P'").select("o_custkey", "item_idx", F.lit("status").alias("reason"))
    return items.keep_union(first, status, key="o_custkey").select("o_custkey", "item_idx", F.array_join("reasons", ",").alias("reasons"))


@query("""WITH c AS (SELECT user_id, event_id FROM events WHERE event_type = 'error' AND value > 20), n AS (SELECT user_id, event_id + o AS item_idx FROM c, (SELECT unnest(range(-2, 3)) AS o))
SELECT DISTINCT user_id, item_idx::bigint AS item_idx FROM n WHERE item_idx >= 0""")
def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places within two of the given ones, by exploded offsets."""
    points = table(spark, sf_dir, "events").where("event_type = 'error' AND value > 20").select("user_id", F.col("event_id").alias("item_idx"))
    return items.neighbours(points, 2, "user_id")


@query("""SELECT vec_id, round(CASE WHEN vec_id % 3 = 0 THEN 0.65 ELSE 0.5 END * (vec_id % 10) / 10 + (1 - CASE WHEN vec_id % 3 = 0 THEN 0.65 ELSE 0.5 END) * 0.25, 6)::double AS score FROM embeddings""")
def hybrid_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact and semantic scores weighed by what the query holds (an identifier in every third one)."""
    q_text = F.when(F.col("vec_id") % 3 == 0, "ticket 12345").otherwise("plain words")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(relevance.hybrid((F.col("vec_id") % 10) / 10, F.lit(0.25), q_text), 6).alias("score"))


@query("""WITH m AS (SELECT conv_id, turn, text, regexp_extract_all(text, '[0-9]{4}') AS found FROM conversations WHERE role = 'user' AND text IS NOT NULL)
SELECT conv_id, substr(sha256(string_agg(regexp_replace(text, '[0-9]{4}', '', 'g'), chr(10) || '---' || chr(10) ORDER BY turn)), 1, 16) AS stable_hash, sum(len(found))::bigint AS n_moved FROM m GROUP BY 1""")
def cache_aligned_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns play the system messages; four digits play the dates."""
    m = table(spark, sf_dir, "conversations").where("role = 'user' AND text IS NOT NULL").select("conv_id", F.col("turn").alias("msg_idx"), F.lit("system").alias("role"), "text")
    return policy.aligned_prefix(m, patterns=(r"[0-9]{4}",)).select("conv_id", "stable_hash", F.col("n_moved").cast("long").alias("n_moved"))

"""The queries of this subpackage: one opN_<name> per operator, over whole tables, with their SQL where it exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import dedup_report

    return dedup_report(_docs(spark, sf_dir))


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t, length(coalesce(text, '')) AS n FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER w = 1 AS kept,
       sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t ORDER BY n DESC, doc_id)
"""


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash_dedup import near_groups

    return near_groups(_docs(spark, sf_dir))


OP9_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS a FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(a) = 0 THEN [] WHEN len(a) < 3 THEN [array_to_string(a, ' ')]
    ELSE list_transform(range(1, len(a) - 1), lambda i: a[i] || ' ' || a[i + 1] || ' ' || a[i + 2]) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
i AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM i JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 85 * (p.n + q.n - k)),
r AS (SELECT doc_id AS id, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id),
c AS (SELECT id, min(root) AS component_id FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN c ON c.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack

    return pack(_docs(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), end_id=0, tokens=2048)


def op4_rans_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    import public_tokenizers

    from . import common, rans

    out = f"{common.shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    rans.write_files(_docs(spark, sf_dir), out, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return rans.read_files(spark, out)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import secret_report

    return secret_report(_docs(spark, sf_dir))


def _op5_sql() -> str:
    from .secret_scan import ACCESS, ALLOW, ASSIGN, CANDIDATE, CLASSES, HEX, KINDS, WINDOW

    def quoted(p: str) -> str:
        return "'" + p.replace("'", "''") + "'"

    def matches(p: str, second: int = 0) -> str:
        # RE2 counts groups as Java does; a split by the pattern gives the gaps
        return f"unnest(list_zip(regexp_extract_all(t, {quoted(p)}), regexp_split_to_array(t, {quoted(p)}), regexp_extract_all(t, {quoted(p)}, {second}))) AS m"

    def placed(kind: int, p: str, second: int, keep: str) -> str:
        return f"""
        SELECT doc_id, {kind} AS kind, pos AS start, pos + length(hit) AS stop, hit FROM (
          SELECT doc_id, i, hit, second, (sum(length(gap)) OVER (PARTITION BY doc_id ORDER BY i) + sum(length(hit)) OVER (PARTITION BY doc_id ORDER BY i) - length(hit))::bigint AS pos
          FROM (SELECT doc_id, i, m[1] AS hit, m[2] AS gap, m[3] AS second FROM (
            SELECT doc_id, {matches(p, second)}, generate_subscripts(regexp_split_to_array(t, {quoted(p)}), 1) AS i FROM d) WHERE m[1] IS NOT NULL))
        WHERE {keep}"""

    names = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"
    least = "CASE " + " ".join(f"WHEN regexp_matches(hit, {quoted(p)}) THEN {h}" for _, p, h in CLASSES) + " END"
    best = f"list_max(list_transform(range(1, length(hit) - {WINDOW} + 2), lambda i: list_aggregate(string_split(substring(hit, i, {WINDOW}), ''), 'entropy')))"
    return f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    base AS ({placed(0, ASSIGN, 2, "length(second) >= 12")} UNION ALL {placed(1, ACCESS, 0, "length(hit) >= 18")} UNION ALL {placed(2, HEX, 0, "true")}),
    cand AS ({placed(3, CANDIDATE, 0, f"NOT regexp_matches(hit, {quoted(ALLOW)})")}),
    added AS (SELECT * FROM cand c WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = c.doc_id AND b.start < c.stop AND c.start < b.stop) AND {best} >= {least} - 1e-9),
    b AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n0, count(*) FILTER (kind = 1) AS n1, count(*) FILTER (kind = 2) AS n2,
      string_agg({names}[kind + 1] || ':' || start || ':' || stop, ',' ORDER BY start, kind, stop) AS j FROM base GROUP BY 1),
    a AS (SELECT doc_id, string_agg({names}[kind + 1] || ':' || start || ':' || stop, ',' ORDER BY start, kind, stop) AS j FROM (FROM base UNION ALL FROM added) GROUP BY 1)
    SELECT d.doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex, sha256(coalesce(b.j, '')) AS base_sha256, coalesce(a.j, '') AS spans
    FROM d LEFT JOIN b ON b.doc_id = d.doc_id LEFT JOIN a ON a.doc_id = d.doc_id
    """


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_counts import token_counts

    return token_counts(_docs(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"), 4096)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import language_report

    return language_report(_docs(spark, sf_dir))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contaminated

    return contaminated(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import repeated_passages

    return repeated_passages(_docs(spark, sf_dir))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extract

    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_exact_dedup": op1_exact_dedup,
        "op2_decontaminate": op2_decontaminate,
        "op3_html_text": op3_html_text,
        "op4_rans_token_files": op4_rans_token_files,
        "op5_secret_scan": op5_secret_scan,
        "op6_token_counts": op6_token_counts,
        "op7_substring_dedup": op7_substring_dedup,
        "op8_language_id": op8_language_id,
        "op9_minhash_dedup": op9_minhash_dedup,
        "op10_best_fit_packing": op10_best_fit_packing,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": OP1_SQL, "op5_secret_scan": _op5_sql(), "op9_minhash_dedup": OP9_SQL}

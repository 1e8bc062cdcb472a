"""Content classification of text blocks, as one native expression per block.

The cascade is: JSON array, diff, HTML, search hits, log, code, plain text; the first whose confidence reaches
its bound decides. Only the first lines or bytes of a block are looked at, so a block costs the same however
long it is. JSON is validated by the JVM's parser, or, with ``tolerant``, by a bracket scan that accepts object
bodies as they are (an Arrow function that sees only blocks that start with '[').
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import patterns as P
from ..functions import text as X

TYPES = ("text", "json_array", "source_code", "search", "build", "diff", "html")


def json_confidence(text: Column) -> Column:
    """1.0: array of objects; 0.8: any other array; null: none."""
    kind = F.schema_of_variant(X.container(F.when(F.ltrim(F.regexp_replace(text, r"^\s+", "")).startswith("["), text)))
    return F.when(kind.startswith("ARRAY<OBJECT"), 1.0).when(kind.startswith("ARRAY<"), 0.8)


def diff_confidence(lines: Column) -> Column:
    """Of the first 500 lines."""
    headers, changes = X.count_lines(lines, P.DIFF_HEADER), X.count_lines(lines, P.DIFF_CHANGE)
    return F.when(headers > 0, F.least(F.lit(0.5) + headers * 0.2 + changes * 0.05, F.lit(1.0)))


def html_confidence(sample: Column) -> Column:
    """Of the first 3000 bytes; text without a '<' costs no tag search."""
    tag = lambda name: sample.rlike(rf"(?i)<{name}[ \t>\n/]")
    doctype = sample.rlike(P.DOCTYPE)
    n = F.size(F.regexp_extract_all(sample, F.lit(r"(?i)<(" + "|".join(P.HTML_TAGS) + r")[ \t>\n/]"), F.lit(0)))
    points = lambda c, v: F.when(c, v).otherwise(0.0)
    total = F.least(points(doctype, 0.5) + points(tag("html"), 0.3) + points(tag("head"), 0.1) + points(tag("body"), 0.1) + F.least(n * 0.03, F.lit(0.3)), F.lit(1.0))
    return F.when(sample.contains("<") & (doctype | tag("html") | (n >= 3)) & (total >= 0.5), total)


def _filled(lines: Column, n: int) -> Column:
    return F.filter(F.slice(lines, 1, n), lambda x: ~X.is_blank(x))


def search_confidence(lines: Column) -> Column:
    """Of the filled ones of the first 100 lines."""
    ratio = X.count_lines(lines, P.SEARCH_HIT) / F.size(lines)
    return F.when((F.size(lines) > 0) & (ratio >= 0.3), F.least(F.lit(0.4) + ratio * 0.6, F.lit(1.0)))


def log_marks(lines: Column) -> Column:
    """Of each of the filled ones of the first 200 lines: 2 with an error mark, 1 with another mark of logs, else 0."""
    return F.transform(lines, lambda x: F.when(x.rlike(P.LOG_ERROR), 2).when(x.rlike(P.LOG_OTHER), 1).otherwise(0))


def log_confidence(marks: Column) -> Column:
    errors, matched = F.size(F.filter(marks, lambda m: m == 2)), F.size(F.filter(marks, lambda m: m > 0))
    ratio = matched / F.size(marks)
    return F.when((F.size(marks) > 0) & (ratio >= 0.1), F.least(F.lit(0.3) + ratio * 0.5 + errors * 0.05, F.lit(1.0)))


def code_best(lines: Column) -> Column:
    """(score, -line of the first match, -rank, language) of the best language in the filled ones of the first 100 lines."""
    rows = []
    for i, (name, p) in enumerate(P.LANGUAGES.items()):
        rows.append(F.struct(X.count_lines(lines, p).alias("score"), (-F.array_position(F.transform(lines, X.matcher(p)), F.lit(True))).alias("first"), F.lit(-i).alias("rank"), F.lit(name).alias("language")))
    return F.array_max(F.array(*rows))


def code_confidence(lines: Column) -> Column:
    """By the language with most matching lines; which of equals it is does not matter here."""
    best = F.greatest(*(X.count_lines(lines, p) for p in P.LANGUAGES.values()))
    ratio = best / F.greatest(F.size(lines), F.lit(1))
    return F.when(best >= 3, F.least(F.lit(0.4) + ratio * 0.4 + best * 0.02, F.lit(1.0)))


@F.pandas_udf(T.DoubleType())
def tolerant_json(text: pd.Series) -> pd.Series:
    """Confidence of a bracket scan; null where the text is null or no balanced array."""
    return text.map(lambda t: None if t is None else scan_array(t), na_action="ignore").astype("float64")


def scan_array(text: str) -> float | None:
    """1.0 or 0.8 for a top-level array whose brackets and strings balance, with values between commas."""
    text = text.strip()
    if not text.startswith("["):
        return None
    depth, at, n, in_string = 0, 0, len(text), False
    starts, expect = [], False
    while at < n:
        c = text[at]
        if in_string:
            if c == "\\":
                at += 1
            elif c == '"':
                in_string = False
        elif c in " \t\r\n":
            pass
        elif c in "]}":
            if expect and depth == 1 and starts:
                return None  # a comma without a value after it
            depth -= 1
            if depth == 0:
                return (1.0 if starts and all(s == "{" for s in starts) else 0.8) if at == n - 1 else None
        elif c == "," and depth == 1:
            if expect:
                return None
            expect = True
        else:
            if depth == 1 and (expect or not starts) or depth == 1 and expect:
                starts.append(c)
                expect = False
            if c in "[{":
                depth += 1
                if depth == 1:
                    starts, expect = [], False
            elif c == '"':
                in_string = True
        at += 1
    return None


#: Bounds of the cascade, in its order.
CASCADE = (("diff", 0.7), ("html", 0.7), ("search", 0.6), ("build", 0.5), ("source_code", 0.5))


def _layers(tolerant: bool) -> list[dict]:
    """Columns of the cascade from a column ``_t``, layer by layer.

    Each is its own projection and is used more than once by the next, so that the optimizer keeps it apart: lines
    are split once, and a confidence is computed once and only where nothing before it decided.
    """
    c = F.col
    first = [
        {"_t": F.when(~X.is_blank(c("_t")), c("_t"))},
        {"_json": tolerant_json(F.when(F.ltrim(c("_t")).startswith("["), c("_t"))) if tolerant else json_confidence(c("_t"))},
        {"_open": c("_t").isNotNull() & c("_json").isNull(), "_l500": F.when(c("_json").isNull(), X.first_lines(c("_t"), 500))},
        {"_l100": _filled(c("_l500"), 100), "_l200": _filled(c("_l500"), 200)},
    ]
    find = {
        "diff": lambda: diff_confidence(c("_l500")), "html": lambda: html_confidence(c("_sample")),
        "search": lambda: search_confidence(c("_l100")), "build": lambda: log_confidence(c("_marks")), "source_code": lambda: code_confidence(c("_l100")),
    }
    out, still = first, c("_open")
    for kind, least in CASCADE:
        if kind == "html":
            out.append({"_sample": F.when(still, F.substring(c("_t").cast("binary"), 1, 3000).cast("string"))})
        if kind == "build":
            out.append({"_marks": F.when(still, log_marks(c("_l200")))})
        out.append({f"_{kind}": F.when(still, find[kind]())})
        still = still & (F.coalesce(c(f"_{kind}"), F.lit(0.0)) < least)
    return out


def _verdict() -> Column:
    def row(kind: str, confidence: Column) -> Column:
        return F.struct(F.lit(kind).alias("content_type"), confidence.cast("double").alias("confidence"))

    cases = F.when(F.col("_t").isNull(), row("text", F.lit(0.0))).when(F.col("_json").isNotNull(), row("json_array", F.col("_json")))
    for kind, least in CASCADE:
        cases = cases.when(F.col(f"_{kind}") >= least, row(kind, F.col(f"_{kind}")))
    return cases.otherwise(row("text", F.lit(0.5)))


def detected(blocks: DataFrame, text: Column, out: str, tolerant: bool = False) -> DataFrame:
    """blocks with STRUCT<content_type, confidence> ``out`` of a text column."""
    rows = blocks.select(F.struct(*(F.col(f"`{c}`") for c in blocks.columns)).alias("_row"), text.alias("_t"))
    for layer in _layers(tolerant):
        rows = rows.withColumns(layer)
    return rows.select("_row.*", _verdict().alias(out))


def classify(blocks: DataFrame, text_col: str = "text", tolerant: bool = False) -> DataFrame:
    """blocks with content_type and confidence."""
    names = [c for c in blocks.columns if c not in ("content_type", "confidence")]
    return detected(blocks.select(*(F.col(f"`{c}`") for c in names)), F.col(f"`{text_col}`"), "_found", tolerant).select(*(F.col(f"`{c}`") for c in names), "_found.content_type", "_found.confidence")


def is_array_of_objects(text: Column) -> Column:
    return F.coalesce(json_confidence(text) == 1.0, F.lit(False))


# Labels of a file-type model by content type.
MODEL_LABELS = {
    "json_array": ("json", "jsonl"),
    "diff": ("diff",),
    "html": ("html", "xml"),
    "source_code": (
        "rust", "python", "javascript", "typescript", "go", "java", "c", "cpp", "cs", "php", "ruby", "swift", "kotlin", "scala", "haskell", "lua", "dart", "perl", "shell", "powershell",
        "batch", "sql", "css", "vue", "groovy", "clojure", "asm", "cmake", "dockerfile", "makefile", "yaml", "toml", "ini", "hcl", "jinja", "r", "scss", "less", "gradle", "maven",
    ),
}


def from_model_label(label: Column) -> Column:
    """Content type of a file-type model's label; text where it is unknown."""
    out = F.when(F.lit(False), F.lit(None))
    for kind, names in MODEL_LABELS.items():
        out = out.when(label.isin(*names), F.lit(kind))
    return out.otherwise("text")


def unified_diff(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, is_diff, files, hunks, additions, deletions) from (key, line_no, line): a file header pair with hunks inside."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy("line_no")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    line = F.col("line")
    before = F.lag("line").over(w)
    is_file = line.startswith("+++ ") & F.coalesce(before.startswith("--- "), F.lit(False))
    marked = lines.withColumn("is_file", is_file.cast("int")).withColumn("file_no", F.sum("is_file").over(upto))
    is_hunk = line.rlike(P.HUNK) & (F.col("file_no") > 0)
    marked = marked.withColumn("is_hunk", is_hunk.cast("int")).withColumn("hunk_no", F.sum("is_hunk").over(upto))
    own = Window.partitionBy(key, "file_no").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    marked = marked.withColumn("in_hunk", F.max("is_hunk").over(own) == 1)
    next_header = line.startswith("--- ") & F.coalesce(F.lead("line").over(w).startswith("+++ "), F.lit(False)) | line.startswith("diff --git ")
    body = F.col("in_hunk") & (F.col("is_hunk") == 0) & ~next_header & (F.col("is_file") == 0)
    return marked.withColumn("body", body).groupBy(key).agg(
        (F.max("hunk_no") > 0).alias("is_diff"), F.max("file_no").cast("long").alias("files"), F.max("hunk_no").cast("long").alias("hunks"),
        F.count_if(F.col("body") & line.startswith("+")).alias("additions"), F.count_if(F.col("body") & line.startswith("-")).alias("deletions"),
    )


def tiered(blocks: DataFrame, text: Column, model_type: Column | None = None, is_diff: Column | None = None, out: str = "found") -> DataFrame:
    """blocks with STRUCT<content_type, confidence, tier> ``out``: a model's verdict (0.9), then a unified diff (0.95), then the cascade."""

    def row(kind: Column, confidence: Column, tier: int) -> Column:
        return F.struct(kind.alias("content_type"), confidence.cast("double").alias("confidence"), F.lit(tier).alias("tier"))

    verdict = F.when(X.is_blank(text), row(F.lit("text"), F.lit(0.0), 3))
    if model_type is not None:
        verdict = verdict.when(model_type.isNotNull() & (model_type != "text"), row(model_type, F.lit(0.9), 1))
    if is_diff is not None:
        verdict = verdict.when(is_diff, row(F.lit("diff"), F.lit(0.95), 2))
    # the cascade runs where neither decided
    above = blocks.withColumn("_above", verdict)
    rows = detected(above, F.when(F.col("_above").isNull(), text), "_rules")
    return rows.withColumn(out, F.coalesce("_above", row(F.col("_rules.content_type"), F.col("_rules.confidence"), 3))).drop("_above", "_rules")

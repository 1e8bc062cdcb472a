"""Blocks as tables of lines: classes, segments, context, choice. Keyed by a block id; one shuffle serves all windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as X
from ..functions.hits import NUMBER


def lines(blocks: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, line_no, line) of every line; the empty line after a final line end counts."""
    return blocks.select(key, F.posexplode(F.split(F.col(text_col), "\n")).alias("line_no", "line"))


def level(line: Column) -> Column:
    """Highest level word of a log line."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, p in P.LEVELS:
        out = out.when(line.rlike(p), name)
    return out.otherwise("unknown")


def log_format(text: Column) -> Column:
    """Format with most lines that hold one of its marks, among the first 100 lines; the first of equals."""
    head = X.first_lines(text, 100)
    rows = []
    for i, (name, marks) in enumerate(P.FORMATS.items()):
        rows.append(F.struct(F.size(F.filter(head, X.holds_any(marks))).alias("n"), F.lit(-i).alias("rank"), F.lit(name).alias("name")))
    best = F.array_max(F.array(*rows))
    return F.when(best["n"] > 0, best["name"]).otherwise("generic")


def classified(rows: DataFrame) -> DataFrame:
    """Lines with level, is_summary, starts_trace and their score (single precision, as ties depend on it)."""
    line = F.col("line")
    base = F.create_map(*[F.lit(x) for kv in P.LEVEL_SCORE.items() for x in kv])
    out = rows.withColumn("level", level(line)).withColumn("is_summary", line.rlike(P.SUMMARY)).withColumn("starts_trace", line.rlike(P.TRACE_START))
    total = base[F.col("level")] + F.when(F.col("starts_trace"), 0.3).otherwise(0.0) + F.when(F.col("is_summary"), 0.4).otherwise(0.0)
    return out.withColumn("score", F.least(total, F.lit(1.0)).cast("float"))


def level_counts(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """Lines by level and block; combines before its shuffle."""
    count = lambda v: F.count_if(F.col("level") == v)
    return rows.groupBy(key).agg(count("error").alias("errors"), count("fail").alias("fails"), count("warn").alias("warnings"), count("info").alias("info"), F.count("*").alias("total"))


def context(rows: DataFrame, chosen: Column, around: int, key: str = "doc_id") -> DataFrame:
    """Rows within ``around`` lines of a chosen one."""
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(-around, around)
    return rows.withColumn("_near", F.max(chosen.cast("int")).over(w)).where("_near = 1").drop("_near")


def islands(rows: DataFrame, flag: str, key: str = "doc_id") -> DataFrame:
    """(key, island, first_line, last_line, n) of the runs of consecutive flagged lines."""
    flagged = rows.where(F.col(flag))
    run = F.col("line_no") - F.row_number().over(Window.partitionBy(key).orderBy("line_no"))
    return flagged.withColumn("_run", run).groupBy(key, "_run").agg(F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"), F.count("*").alias("n")).withColumn(
        "island", F.row_number().over(Window.partitionBy(key).orderBy("first_line"))
    ).drop("_run")


def first_last_best(rows: DataFrame, most: int, key: str = "doc_id") -> DataFrame:
    """First, last and the best scored rows of a block, at most ``most``."""
    w = Window.partitionBy(key)
    rank = F.when(F.col("line_no") == F.min("line_no").over(w), 0).when(F.col("line_no") == F.max("line_no").over(w), 1).otherwise(2)
    order = Window.partitionBy(key).orderBy("_rank", F.desc("score"), "line_no")
    return rows.withColumn("_rank", rank).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_rank", "_n")


def distinct_warnings(rows: DataFrame, most: int | None = None, key: str = "doc_id") -> DataFrame:
    """The first warning line of each normal form, and of those the first ``most``."""
    warn = rows.where("level = 'warn'").withColumn("form", X.normal_warning(F.col("line")))
    first = warn.groupBy(key, "form").agg(F.min(F.struct("line_no", "line")).alias("f"), F.count("*").alias("n")).select(key, "form", "f.line_no", "f.line", "n")
    if most is None:
        return first
    return first.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("line_no"))).where(F.col("_n") <= most).drop("_n")


def segments(rows: DataFrame, header: Column, name: str = "segment", key: str = "doc_id") -> DataFrame:
    """Lines with the number of the header at or before them (0 before the first)."""
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.sum(header.cast("int")).over(w))


def diff_lines(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """Lines of diffs with file_no, hunk_no and kind (file, hunk, add, del, context, other)."""
    line = F.col("line")
    out = segments(rows, line.rlike("^diff --(git|combined|cc) "), "file_no", key)
    out = segments(out, line.rlike(P.HUNK), "hunk_no", key)
    w = Window.partitionBy(key, "file_no").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    inside = F.max(line.rlike(P.HUNK).cast("int")).over(w) == 1
    kind = (
        F.when(line.rlike("^diff --(git|combined|cc) "), "file").when(line.rlike(P.HUNK), "hunk").when(~inside, "other")
        .when(line.startswith("+") & ~line.startswith("+++"), "add").when(line.startswith("-") & ~line.startswith("---"), "del").when((line == "") | line.startswith(" "), "context").otherwise("other")
    )
    return out.withColumn("kind", kind)


def diff_totals(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """Additions, deletions and hunks by file, and by block in the rows without a file."""
    return diff_lines(rows, key).where("file_no > 0").rollup(key, "file_no").agg(
        F.count_if(F.col("kind") == "add").alias("additions"), F.count_if(F.col("kind") == "del").alias("deletions"), F.count_if(F.col("kind") == "hunk").alias("hunks")
    ).where(F.col(key).isNotNull())


def trimmed_context(rows: DataFrame, around: int = 2, key: str = "doc_id") -> DataFrame:
    """Hunk lines within ``around`` lines of a change of the same hunk; hunks without one keep their first lines."""
    body = diff_lines(rows, key).where("kind IN ('add', 'del', 'context') OR (kind = 'other' AND line LIKE '\\\\%')")
    hunk = Window.partitionBy(key, "hunk_no")
    changed = F.col("kind").isin("add", "del").cast("int")
    near = F.max(changed).over(hunk.orderBy("line_no").rowsBetween(-around, around))
    out = body.withColumn("_near", near).withColumn("_any", F.max(changed).over(hunk)).withColumn("_n", F.row_number().over(hunk.orderBy("line_no")))
    return out.where((F.col("_near") == 1) | F.col("line").startswith("\\") | (F.col("_any") == 0) & (F.col("_n") <= around)).drop("_near", "_any", "_n")


def search_hits(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, file, line_number, content, line_no) of hits; the grammar is that of ``hits.parse``."""
    hit = rf"(?s)^(.*?){NUMBER}(.*)$"
    line = F.regexp_replace("line", r"^\s+|\s+$", "")
    part = lambda i: F.regexp_extract(line, hit, i)
    return rows.select(key, "line_no", part(1).alias("file"), part(2).cast("decimal(38,0)").alias("line_number"), part(3).alias("content")).where("file <> ''").withColumn("line_number", F.col("line_number").cast("long"))


def budgeted(hits: DataFrame, k: int, per_file: int = 5, files: int = 15, key: str = "doc_id") -> DataFrame:
    """Chosen hits: the best files take up to ``per_file`` each until k are taken (clipped running sums, no loop)."""
    total = Window.partitionBy(key, "file")
    ranked = hits.withColumn("_total", F.sum(F.col("score").cast("float")).over(total)).withColumn("_file", F.dense_rank().over(Window.partitionBy(key).orderBy(F.desc("_total"), "file"))).where(F.col("_file") <= files)
    ends = Window.partitionBy(key, "file")
    place = F.when(F.col("line_no") == F.min("line_no").over(ends), 0).when(F.col("line_no") == F.max("line_no").over(ends), 1).otherwise(2)
    ranked = ranked.withColumn("_place", place).withColumn("_n", F.row_number().over(Window.partitionBy(key, "file").orderBy("_place", F.desc("score"), "line_number", "line_no")))
    first = F.row_number().over(Window.partitionBy(key, "file", "line_number", "content").orderBy("_n")) == 1
    unique = ranked.withColumn("_first", first).where("_first").withColumn("_n", F.row_number().over(Window.partitionBy(key, "file").orderBy("_n")))
    sizes = unique.groupBy(key, "_file").agg(F.least(F.count("*"), F.lit(per_file)).alias("_u"))
    upto = Window.partitionBy(key).orderBy("_file").rowsBetween(Window.unboundedPreceding, 0)
    clipped = F.least(F.sum("_u").over(upto), F.lit(k))
    before = F.least(F.coalesce(F.sum("_u").over(upto.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), F.lit(k))
    take = sizes.withColumn("_take", clipped - before).select(key, "_file", "_take")
    return unique.join(take, [key, "_file"]).where("_n <= _take").select(key, "file", "line_number", "content", "score")

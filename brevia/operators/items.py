"""Records and fields as tables: profiles, outliers, rare values, change points, sampling, keep sets.

``items`` has (key, item_idx, ...); ``cells`` has (key, item_idx, name, kind, value, number) with one row per
field of an item. Field statistics are small beside the cells; whether they are broadcast is left to the planner,
which knows their size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as X
from ..functions.arrays import ERROR_WORDS


def array_items(blocks: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, item_idx, v VARIANT) of blocks that hold a JSON array."""
    parsed = blocks.select(key, F.try_parse_json(text_col).alias("_v")).where(F.schema_of_variant("_v").startswith("ARRAY"))
    return parsed.select(key, F.posexplode(F.variant_get("_v", "$", "array<variant>")).alias("item_idx", "v"))


def variant_cells(items: DataFrame, key: str = "doc_id") -> DataFrame:
    """Cells of items that are objects."""
    kind = F.schema_of_variant("value")
    number = F.when(kind.rlike("^(BIGINT|DOUBLE|DECIMAL)"), F.try_variant_get("value", "$", "double"))
    return (
        items.where(F.schema_of_variant("v").startswith("OBJECT"))
        .select(key, "item_idx", F.variant_get("v", "$", "map<string,variant>").alias("_m"))
        .select(key, "item_idx", F.explode("_m").alias("name", "value"))
        .select(
            key, "item_idx", "name",
            F.when(kind == "VOID", "null").when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean").when(kind.startswith("ARRAY"), "array").when(kind.startswith("OBJECT"), "object").otherwise("numeric").alias("kind"),
            F.try_variant_get("value", "$", "string").alias("value"), number.alias("number"),
        )
    )


def column_cells(rows: DataFrame, key: str, idx: Column, columns: list[str]) -> DataFrame:
    """Cells of ordinary columns, typed by the table's schema."""
    kinds = dict(rows.dtypes)
    numeric = {c for c in columns if kinds[c].split("(")[0] in ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")}
    cells = [
        F.struct(F.lit(c).alias("name"), F.lit("numeric" if c in numeric else "string").alias("kind"), F.col(c).cast("string").alias("value"), (F.col(c).cast("double") if c in numeric else F.lit(None).cast("double")).alias("number"))
        for c in columns
    ]
    return rows.select(F.col(key), idx.alias("item_idx"), F.explode(F.array(*cells)).alias("_c")).select(key, "item_idx", "_c.*")


#: Bytes from which a string is long, and from which it may be opaque; share of base64 signs above which it is.
LONG_STRING, OPAQUE, OPAQUE_SHARE = 100, 500, 0.8


def cell_class(kind: Column, value: Column, number: Column) -> Column:
    """Class of a cell: null, bool, int, float, array, object, or for strings uuid, url, opaque, long_string, short_string."""
    size = F.octet_length(value)
    signs = F.length(F.regexp_replace(value, r"[^A-Za-z0-9+/=]", ""))
    text = (
        F.when(value.rlike(rf"^{P.UUID}$"), "uuid").when(value.startswith("http://") | value.startswith("https://"), "url")
        .when((size >= OPAQUE) & (signs > OPAQUE_SHARE * size), "opaque").when(size >= LONG_STRING, "long_string").otherwise("short_string")
    )
    whole = F.when(number == F.floor(number), "int").otherwise("float")
    return F.when(value.isNull() | (kind == "null"), "null").when(kind == "boolean", "bool").when(kind == "numeric", whole).when(kind.isin("array", "object"), kind).otherwise(text)


def json_container(text: Column) -> Column:
    """VARIANT of a string that holds a JSON object or array, null of any other."""
    return X.container(text)


def profile(cells: DataFrame, sizes: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per field: n (items, missing ones too), type of the first value, distinct forms (missing counts as one), moments.

    ``sizes`` has (key, n). Distinct counts use the aggregate's own expansion, combined before each shuffle.
    """
    there = F.col("value").isNotNull() & (F.col("kind") != "null")
    agg = cells.groupBy(key, "name").agg(
        F.count_if(there).alias("present"), F.min_by("kind", F.when(there, F.col("item_idx"))).alias("kind"), F.count_distinct(F.when(there, F.col("value"))).alias("distinct_values"),
        F.min("number").alias("low"), F.max("number").alias("high"), F.avg("number").alias("mean"), F.var_samp("number").alias("variance"), F.avg(F.when(F.col("kind") == "string", F.length("value"))).alias("avg_length"),
    )
    out = agg.join(sizes, key)
    unique = F.col("distinct_values") + (F.col("present") < F.col("n")).cast("long")
    return out.select(
        key, "name", "kind", "n", unique.alias("n_unique"), (unique / F.col("n")).alias("unique_ratio"), (unique == 1).alias("is_constant"), "low", "high", "mean",
        F.when(F.col("kind") == "numeric", F.coalesce("variance", F.lit(0.0))).alias("variance"), "avg_length",
    )


def top_values(cells: DataFrame, most: int = 5, key: str = "doc_id") -> DataFrame:
    """Most frequent values of each field, ties by first appearance."""
    counts = cells.where("value IS NOT NULL").groupBy(key, "name", "value").agg(F.count("*").alias("n"), F.min("item_idx").alias("first_idx"))
    order = Window.partitionBy(key, "name").orderBy(F.desc("n"), "first_idx", "value")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def numeric_outliers(cells: DataFrame, sigma: float = 2.0, key: str = "doc_id") -> DataFrame:
    """Cells whose number is more than sigma sample deviations from the mean of its field."""
    stats = cells.groupBy(key, "name").agg(F.avg("number").alias("mean"), F.stddev_samp("number").alias("sd"))
    return cells.where("number IS NOT NULL").join(stats.where("sd > 0"), [key, "name"]).where(F.abs(F.col("number") - F.col("mean")) > sigma * F.col("sd"))


def rare_key_items(cells: DataFrame, sizes: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, item_idx) of items with a field that fewer than a fifth of the items have."""
    rare = cells.groupBy(key, "name").agg(F.count_distinct("item_idx").alias("c")).join(sizes, key).where("n >= 5 AND c < 0.2 * n").select(key, "name")
    return cells.join(rare, [key, "name"], "left_semi").select(key, "item_idx").distinct()


def pareto_head(cells: DataFrame, share: float = 0.8, key: str = "doc_id") -> DataFrame:
    """The values of each field of 2 to 50 values that make up ``share`` of it, if they are five at most."""
    counts = cells.groupBy(key, "name", F.coalesce("value", F.lit("__none__")).alias("value")).agg(F.count("*").alias("c"))
    order = Window.partitionBy(key, "name").orderBy(F.desc("c"), "value")
    field = Window.partitionBy(key, "name")
    ranked = counts.withColumn("total", F.sum("c").over(field)).withColumn("card", F.count_if(F.col("value") != "__none__").over(field)).withColumn("before", F.coalesce(F.sum("c").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    head = ranked.where("card BETWEEN 2 AND 50").where(F.col("before") < F.ceil(F.col("total") * share - 1e-6)).withColumn("size", F.count("*").over(field))
    return head.where("size <= 5").select(key, "name", "value", "c", "total")


def rare_status_items(cells: DataFrame, key: str = "doc_id") -> DataFrame:
    """Cells whose value is outside the head of a field that has one."""
    head = pareto_head(cells, key=key)
    fields = head.select(key, "name").distinct()
    named = cells.withColumn("value", F.coalesce("value", F.lit("__none__")))
    return named.join(fields, [key, "name"], "left_semi").join(head.select(key, "name", "value"), [key, "name", "value"], "left_anti")


def error_items(items: DataFrame, raw: str = "raw") -> DataFrame:
    """Items whose text holds an error word anywhere."""
    return items.where(F.lower(raw).rlike("|".join(ERROR_WORDS)))


def change_points(rows: DataFrame, value: str, key: str, order: list, window: int = 5, sigma: float = 2.0) -> DataFrame:
    """Rows where the mean of the next values differs from that of the previous ones by more than sigma deviations."""
    w = Window.partitionBy(key).orderBy(*order)
    every = Window.partitionBy(key)
    out = rows.withColumn("_i", F.row_number().over(w)).withColumn("_n", F.count("*").over(every)).withColumn("_sd", F.stddev_samp(value).over(every))
    out = out.withColumn("before_mean", F.avg(value).over(w.rowsBetween(-window, -1))).withColumn("after_mean", F.avg(value).over(w.rowsBetween(0, window - 1)))
    inside = (F.col("_i") > window) & (F.col("_i") <= F.col("_n") - window)
    return out.where(inside & (F.col("_sd") > 0) & (F.abs(F.col("after_mean") - F.col("before_mean")) > sigma * F.col("_sd"))).drop("_i", "_n", "_sd")


def sequential_fields(rows: DataFrame, value: str, key: str, order: list) -> DataFrame:
    """(key, is_sequential): mostly steps of about one in sorted order, mostly upwards in the given order."""
    by_value = F.col(value) - F.lag(value).over(Window.partitionBy(key).orderBy(value))
    by_order = F.col(value) - F.lag(value).over(Window.partitionBy(key).orderBy(*order))
    steps = rows.where(F.col(value).isNotNull()).withColumn("_gap", by_value).withColumn("_up", by_order)
    out = steps.groupBy(key).agg(F.count("*").alias("n"), F.avg("_gap").alias("gap"), F.avg(F.col("_gap").between(0.5, 2.0).cast("int")).alias("even"), F.avg((F.col("_up") >= 0).cast("int")).alias("up"))
    return out.select(key, "n", (F.col("n").__ge__(5) & F.col("gap").between(0.5, 2.0) & (F.col("even") > 0.8) & (F.col("up") > 0.7)).alias("is_sequential"))


def spread_quantiles(rows: DataFrame, value: str, key: str) -> DataFrame:
    """Mean, median, sample deviation and quartiles (linear) of each group."""
    return rows.groupBy(key).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.median(value).alias("median"), F.stddev_samp(value).alias("stddev"), F.percentile(value, 0.25).alias("p25"), F.percentile(value, 0.75).alias("p75"))


def top_n(rows: DataFrame, n: int, key: str, order: list) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def stride_sample(rows: DataFrame, budget: Column, key: str, order: list) -> DataFrame:
    """Every stride-th row of a group, with stride (n - 1) / (budget + 1), at least 1."""
    w = Window.partitionBy(key)
    out = rows.withColumn("_i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count("*").over(w))
    stride = F.greatest(F.lit(1), F.floor((F.col("_n") - 1) / (budget + 1)).cast("int"))
    return out.where(F.col("_i") % stride == 0).drop("_i", "_n")


def interleaved_fill(rows: DataFrame, budget: int, key: str, order: list) -> DataFrame:
    """``budget`` rows of each group in interleaved strides: 0, s, 2s, ..., 1, 1 + s, ..."""
    w = Window.partitionBy(key)
    out = rows.withColumn("_i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count("*").over(w))
    step = F.greatest(F.lit(1), F.floor(F.col("_n") / (budget + 1)).cast("int"))
    return out.withColumn("_p", F.row_number().over(w.orderBy(F.col("_i") % step, "_i"))).where(F.col("_p") <= budget).drop("_i", "_n", "_p")


def critical_first(rows: DataFrame, critical: Column, most: int, key: str, order: list) -> DataFrame:
    """At most ``most`` rows (more only if that many are critical): critical ones, first 3, last 2, then in order."""
    w = Window.partitionBy(key)
    out = rows.withColumn("_i", F.row_number().over(w.orderBy(*order))).withColumn("_n", F.count("*").over(w))
    rank = F.when(critical, 0).when(F.col("_i") <= 3, 1).when(F.col("_i") > F.col("_n") - 2, 2).otherwise(3)
    out = out.withColumn("_r", rank).withColumn("_p", F.row_number().over(w.orderBy("_r", "_i")))
    return out.where((F.col("_p") <= most) | (F.col("_r") == 0)).drop("_i", "_n", "_r", "_p")


def representatives(rows: DataFrame, text: Column, n: int, key: str, order: list) -> DataFrame:
    """The first n rows of each cluster: equal first 50 characters by hash."""
    out = rows.withColumn("cluster", F.left(F.md5(F.left(text, F.lit(50))), F.lit(8)))
    return out.withColumn("_n", F.row_number().over(Window.partitionBy(key, "cluster").orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def first_of_equal(rows: DataFrame, content: Column, key: list[str], idx: str) -> DataFrame:
    """(key, content_hash, idx) of the first row of each content."""
    return rows.groupBy(*key, F.left(F.md5(content), F.lit(16)).alias("content_hash")).agg(F.min(idx).alias(idx), F.count("*").alias("copies"))


def pair_curve(rows: DataFrame, text: Column, key: str, idx: str) -> DataFrame:
    """(key, idx, distinct_pairs): distinct lower-case word pairs up to each row; a row of one word counts as that word.

    Words are made by one projection and pairs by zipping two of its slices. A column that a lambda refers to is
    computed again for every element once the optimizer has merged the projections; an explode between them keeps
    them apart. Pairs are known by 96 bits of two hashes, so that the aggregate that finds their first rows, before
    and after its shuffle, has keys of fixed width.
    """
    words = rows.select(key, idx, F.explode(F.array(F.split(F.trim(F.regexp_replace(F.lower(text), r"[ \t\n\r]+", " ")), " "))).alias("w"))
    n = F.size("w")
    pairs = F.when(n > 1, F.zip_with(F.slice("w", 1, F.greatest(n - 1, F.lit(0))), F.slice("w", 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.col("w"))
    hashed = words.select(key, idx, F.explode(pairs).alias("pair")).select(key, idx, F.xxhash64("pair").alias("_h"), F.hash("pair").alias("_g"))
    first = hashed.groupBy(key, "_h", "_g").agg(F.min(idx).alias(idx))
    new = first.groupBy(key, idx).agg(F.count("*").alias("new"))
    every = rows.select(key, idx).join(new, [key, idx], "left")
    return every.withColumn("distinct_pairs", F.sum(F.coalesce("new", F.lit(0))).over(Window.partitionBy(key).orderBy(idx))).drop("new")


def knee(curve: DataFrame, key: str, idx: str) -> DataFrame:
    """(key, knee): 1-based row where the scaled curve is farthest above the diagonal; null where never by 0.05."""
    w = Window.partitionBy(key)
    c = curve.withColumn("_i", F.row_number().over(w.orderBy(idx)) - 1).withColumn("_n", F.count("*").over(w)).withColumn("_lo", F.min("distinct_pairs").over(w)).withColumn("_hi", F.max("distinct_pairs").over(w))
    diff = (F.col("distinct_pairs") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) - F.col("_i") / (F.col("_n") - 1)
    c = c.where("_n >= 3").withColumn("_d", F.when(F.col("_hi") > F.col("_lo"), F.round(diff, 9)))
    best = c.groupBy(key).agg(F.max_by("_i", F.struct("_d", -F.col("_i"))).alias("at"), F.max("_d").alias("d"))
    return best.select(key, F.when(F.col("d").isNull(), 1).when(F.col("d") >= 0.05, F.col("at") + 1).cast("int").alias("knee"))


def keep_union(*parts: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, item_idx, reasons) of keep sets with a reason column."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(key, "item_idx").agg(F.array_sort(F.collect_set("reason")).alias("reasons"))


def neighbours(points: DataFrame, around: int, key: str = "doc_id", idx: str = "item_idx") -> DataFrame:
    """Rows within ``around`` of the points: exploded offsets, so that the later join is on equal keys."""
    return points.select(key, F.explode(F.sequence(F.col(idx) - around, F.col(idx) + around)).alias(idx)).where(F.col(idx) >= 0).distinct()


def schema_union(cells: DataFrame, sizes: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, name, tag, nullable) of a table over the items: the last value decides the tag, a gap makes it nullable."""
    whole = F.col("number") == F.floor("number")
    tag = F.when(F.col("kind") == "numeric", F.when(whole, "int").otherwise("float")).when(F.col("kind") == "boolean", "bool").otherwise("string")
    there = F.col("kind") != "null"
    return cells.groupBy(key, "name").agg(F.max_by(tag, F.when(there, F.col("item_idx"))).alias("tag"), F.count_if(there).alias("present")).join(sizes, key).select(key, "name", F.coalesce("tag", F.lit("string")).alias("tag"), (F.col("present") < F.col("n")).alias("nullable"))

"""Block compressors as Arrow functions: one row is one block, so that no operator of this module shuffles.

Each function takes columns and gives a struct column. Kernels see one block at a time; their memory is that of
one Arrow batch. Blocks that a compressor does not apply to should be filtered out or passed as null before:
Python functions are barriers for predicates. They are declared not deterministic, so that a filter on their
result is not pushed below them, which would run them twice.

Queries and biases are values or columns: every row may have its own. A null query is an empty one, a null bias is 1.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import arrays, codetext, difftext, hits, jsontext, loglines, logtemplates, sizing, tagspans
from ..functions.difftext import DiffRules
from ..functions.hits import HitRules
from ..functions.loglines import LogRules


def _rows(text: pd.Series, f: Callable[[str], dict], columns: list[str]) -> pd.DataFrame:
    return pd.DataFrame([dict.fromkeys(columns) if t is None else f(t) for t in text], columns=columns)


def _column(value: Column | str | float) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def _query(value: Column | str) -> Column:
    return F.coalesce(_column(value), F.lit(""))


def _bias(value: Column | float) -> Column:
    return F.coalesce(_column(value).cast("double"), F.lit(1.0))


def _with(text: pd.Series, f: Callable[..., dict], columns: list[str], *given: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([dict.fromkeys(columns) if t is None else f(t, *g) for t, *g in zip(text, *given)], columns=columns)


def logs(text: Column, bias: Column | float = 1.0, rules: LogRules = LogRules(), store: bool = False) -> Column:
    columns = ["compressed", "lines_in", "lines_out", "format", "errors", "fails", "warnings", "info", "key"]

    @F.pandas_udf("compressed string, lines_in int, lines_out int, format string, errors int, fails int, warnings int, info int, key string")
    def run(text: pd.Series, bias: pd.Series) -> pd.DataFrame:
        def one(t: str, b: float) -> dict:
            r = loglines.compress(t, b, rules, store)
            return {"compressed": r.text, "lines_in": r.lines_in, "lines_out": r.lines_out, "format": r.format, "key": r.key} | {k: r.stats.get(k, 0) for k in columns[4:8]}

        return _with(text, one, columns, bias)

    return run.asNondeterministic()(text, _bias(bias))


def trace_lines(lines: Column, most: int = 20) -> Column:
    """Flags of the lines of an array that belong to stack traces."""

    @F.pandas_udf("array<boolean>")
    def run(lines: pd.Series) -> pd.Series:
        return lines.map(lambda x: loglines.trace_flags(list(x), most), na_action="ignore")

    return run.asNondeterministic()(lines)


def diffs(text: Column, query: Column | str = "", rules: DiffRules = DiffRules()) -> Column:
    columns = ["compressed", "lines_in", "lines_out", "files", "additions", "deletions", "hunks_kept", "hunks_removed", "key"]

    @F.pandas_udf("compressed string, lines_in int, lines_out int, files int, additions int, deletions int, hunks_kept int, hunks_removed int, key string")
    def run(text: pd.Series, query: pd.Series) -> pd.DataFrame:
        return _with(text, lambda t, q: (lambda d: d | {"compressed": d.pop("text")})(asdict(difftext.compress(t, q, rules))), columns, query)

    return run.asNondeterministic()(text, _query(query))


def diff_noise(text: Column) -> Column:
    @F.pandas_udf("string")
    def run(text: pd.Series) -> pd.Series:
        return text.map(difftext.drop_noise, na_action="ignore")

    return run.asNondeterministic()(text)


def search(text: Column, query: Column | str = "", bias: Column | float = 1.0, rules: HitRules = HitRules()) -> Column:
    columns = ["compressed", "hits_in", "hits_out", "files", "key"]

    @F.pandas_udf("compressed string, hits_in int, hits_out int, files int, key string")
    def run(text: pd.Series, query: pd.Series, bias: pd.Series) -> pd.DataFrame:
        return _with(text, lambda t, q, b: (lambda d: d | {"compressed": d.pop("text")})(asdict(hits.compress(t, q, b, rules))), columns, query, bias)

    return run.asNondeterministic()(text, _query(query), _bias(bias))


def crush(text: Column, query: Column | str = "", bias: Column | float = 1.0, rules: arrays.Rules = arrays.Rules()) -> Column:
    columns = ["compressed", "was_modified", "strategy"]

    @F.pandas_udf("compressed string, was_modified boolean, strategy string")
    def run(text: pd.Series, query: pd.Series, bias: pd.Series) -> pd.DataFrame:
        return _with(text, lambda t, q, b: dict(zip(columns, arrays.crush(t, q, b, rules))), columns, query, bias)

    return run.asNondeterministic()(text, _query(query), _bias(bias))


def table(text: Column, style: str = "csv") -> Column:
    """The array as a table (csv with a typed header, markdown, json); null where it is no array of two or more objects."""

    @F.pandas_udf("string")
    def run(text: pd.Series) -> pd.Series:
        def one(t: str) -> str | None:
            try:
                value = jsontext.read(t)
            except ValueError:
                return None
            return arrays.table(value, style=style) if isinstance(value, list) else None

        return text.map(one, na_action="ignore")

    return run.asNondeterministic()(text)


def json_structure(text: Column) -> Column:
    @F.pandas_udf("compressed string, keys int")
    def run(text: pd.Series) -> pd.DataFrame:
        return _rows(text, lambda t: dict(zip(("compressed", "keys"), jsontext.structure(t))), ["compressed", "keys"])

    return run.asNondeterministic()(text)


def minified(text: Column) -> Column:
    @F.pandas_udf("string")
    def run(text: pd.Series) -> pd.Series:
        return text.map(jsontext.minified, na_action="ignore")

    return run.asNondeterministic()(text)


def log_template(text: Column) -> Column:
    @F.pandas_udf("string")
    def run(text: pd.Series) -> pd.Series:
        return text.map(logtemplates.collapse, na_action="ignore")

    return run.asNondeterministic()(text)


def code(text: Column) -> Column:
    columns = ["compressed", "language", "bodies", "tokens_in", "tokens_out"]

    @F.pandas_udf("compressed string, language string, bodies int, tokens_in int, tokens_out int")
    def run(text: pd.Series) -> pd.DataFrame:
        return _rows(text, lambda t: (lambda d: d | {"compressed": d.pop("text")})(asdict(codetext.compress(t))), columns)

    return run.asNondeterministic()(text)


def protect_tags(text: Column) -> Column:
    @F.pandas_udf("text string, names map<string,string>")
    def run(text: pd.Series) -> pd.DataFrame:
        return _rows(text, lambda t: dict(zip(("text", "names"), tagspans.protect(t))), ["text", "names"])

    return run.asNondeterministic()(text)


def restore_tags(text: Column, names: Column) -> Column:
    @F.pandas_udf("string")
    def run(text: pd.Series, names: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else tagspans.restore(t, dict(n or {})) for t, n in zip(text, names)])

    return run.asNondeterministic()(text, names)


def keep_words(text: Column, scores: Column, least: float = 0.5) -> Column:
    """The words whose score of a model is above ``least``: arrays of scores, one per white-space word."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    pairs = F.arrays_zip(words.alias("w"), scores.alias("s"))
    return F.array_join(F.transform(F.filter(pairs, lambda p: p["s"] > least), lambda p: p["w"]), " ")


def adaptive_k(lines: Column, bias: float = 1.0, least: int = 3, most: int | None = None, check: bool = True) -> Column:
    """How many of an array of texts to keep, by their diversity."""

    @F.pandas_udf("int")
    def run(lines: pd.Series) -> pd.Series:
        return lines.map(lambda x: sizing.adaptive_k(list(x), bias, least, most, check), na_action="ignore")

    return run.asNondeterministic()(lines)


def near_clusters(lines: Column, radius: int = sizing.SAME) -> Column:
    """Greedy SimHash clusters of an array of texts; for large tables block on fingerprint bands instead."""

    @F.pandas_udf("int")
    def run(lines: pd.Series) -> pd.Series:
        return lines.map(lambda x: sizing.clusters(list(x), radius), na_action="ignore")

    return run.asNondeterministic()(lines)


def _array(text: str) -> jsontext.Raw | None:
    try:
        value = jsontext.read(text)
    except ValueError:
        return None
    return value if isinstance(value, jsontext.Raw) else None


def anchor_places(text: Column, most: int = 15, strategy: str = "smart_sample", query: Column | str = "") -> Column:
    """Anchor places of a JSON array; null where it is none."""

    @F.pandas_udf("array<int>")
    def run(text: pd.Series, query: pd.Series) -> pd.Series:
        return pd.Series([None if t is None or (v := _array(t)) is None else arrays.anchors(v, most, strategy, q) for t, q in zip(text, query)], dtype=object)

    return run.asNondeterministic()(text, _query(query))


def array_analysis(text: Column) -> Column:
    """STRUCT<pattern, strategy, crushable, confidence, reason, signals, reduction> of an array of objects."""
    columns = ["pattern", "strategy", "crushable", "confidence", "reason", "signals", "reduction"]

    @F.pandas_udf("pattern string, strategy string, crushable boolean, confidence double, reason string, signals array<string>, reduction double")
    def run(text: pd.Series) -> pd.DataFrame:
        def one(t: str) -> dict:
            v = _array(t)
            if v is None or arrays.kind_of(v) != "dict":
                return dict.fromkeys(columns)
            a = arrays.analyse(list(v), v.raw)
            return {c: getattr(a, c) for c in columns}

        return _rows(text, one, columns)

    return run.asNondeterministic()(text)

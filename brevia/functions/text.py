"""Column functions on text: lines, words, terms, normal forms. All run inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P


def quoted(pattern: str) -> str:
    """A SQL literal of a pattern."""
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def first_lines(text: Column, n: int) -> Column:
    """The first n lines; the rest of a long text is not split."""
    return F.slice(F.split(text, "\n", n + 1), 1, n)


def count_lines(lines: Column, pattern: str) -> Column:
    return F.size(F.filter(lines, lambda x: x.rlike(pattern)))


def matcher(pattern: str) -> Callable[[Column], Column]:
    """A function of one column for higher-order functions, which count the arguments of what they get."""
    return lambda x: x.rlike(pattern)


def holds_any(parts: tuple[str, ...]) -> Callable[[Column], Column]:
    def test(x: Column) -> Column:
        out = F.lit(False)
        for p in parts:
            out = out | x.contains(p)
        return out

    return test


def is_blank(text: Column) -> Column:
    return text.rlike(r"^[ \t\r\n\x0b\x0c]*$")


def has_word(text: Column, *alternatives: str) -> Column:
    """Whole-word search in any case, with ASCII word borders."""
    return text.rlike(P.words(*alternatives))


def keyword_then_space(text: Column, *keywords: str) -> Column:
    return text.rlike(r"^[ \t]*(" + "|".join(keywords) + r")[ \t]")


def terms(text: Column) -> Column:
    """Lower-case terms: UUIDs, numbers of four digits or more, words of [a-zA-Z0-9_]."""
    return F.regexp_extract_all(F.lower(text), F.lit(P.TERM), F.lit(0))


def container(text: Column) -> Column:
    """VARIANT of a text that is one JSON object or array and nothing else, null of any other.

    The parser ignores what follows the first value, so the text is read inside an object, which a further ']' or
    value breaks, and inside an array, which a further '}' breaks.
    """
    body = F.regexp_replace(text, r"^\s+|\s+$", "")
    body = F.when(body.startswith("{") & body.endswith("}") | body.startswith("[") & body.endswith("]"), body)
    own = F.try_parse_json(F.concat(F.lit('{"v":'), body, F.lit("}")))
    return F.when(F.try_parse_json(F.concat(F.lit("["), body, F.lit("]"))).isNotNull(), F.try_variant_get(own, "$.v", "variant"))


def strip_space(text: Column) -> Column:
    return F.translate(text, " \t\r\n", "")


def normal_warning(line: Column) -> Column:
    """After the first ':' or '=': hexadecimal addresses of letters, digit runs and directories become fixed words."""
    head = F.regexp_extract(line, r"^[^:=]*", 0)
    tail = F.substr(line, F.length(head) + 1)
    tail = F.regexp_replace(tail, r"0x[a-fA-F]+(?![0-9a-fA-F])", "ADDR")
    tail = F.regexp_replace(tail, r"[0-9]+", "N")
    tail = F.regexp_replace(tail, r"/[A-Za-z0-9_/]*[A-Za-z0-9_/]/", "/PATH/")
    return F.concat(head, tail)


def plus_line(header: Column) -> Column:
    """Line number after '+' of a hunk header, 0 without one."""
    return F.coalesce(F.try_to_number(F.regexp_extract(header, r"[+]([0-9]+)", 1), F.lit("9999999999")).cast("long"), F.lit(0))


def new_path(header: Column) -> Column:
    """Path after the last ' b/' of a diff header."""
    return F.regexp_extract(header, r"^.* b/(.*)$", 1)


def is_uuid(text: Column) -> Column:
    return text.rlike(P.UUID)


def is_hostname(text: Column) -> Column:
    return text.rlike(r"[a-zA-Z0-9]([a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?([.][a-zA-Z0-9]([a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?)*[.][a-zA-Z]{2,}")


def is_email(text: Column) -> Column:
    return text.rlike(r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+[.][a-zA-Z]{2,}")


def is_iso_datetime(text: Column) -> Column:
    return text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}")


def is_iso_date(text: Column) -> Column:
    return text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$")


def query_anchors(query: Column) -> Column:
    """Lower-case anchors of a query: UUIDs, long numbers, host names, short quoted strings, e-mail addresses."""

    def every(pattern: str, group: int = 0) -> Column:
        return F.regexp_extract_all(query, F.lit(pattern), F.lit(group))

    hosts = F.filter(every(r"\b[a-zA-Z0-9][a-zA-Z0-9-]*(?:\.[a-zA-Z0-9-]+)*\.[a-zA-Z]{2,}\b"), lambda x: ~F.lower(x).isin("e.g", "i.e", "etc."))
    quotes = F.filter(F.transform(every(r"['\"]([^'\"]{1,50})['\"]", 1), F.trim), lambda x: F.length(x) >= 2)
    found = F.concat(every(rf"\b{P.UUID}\b"), every(r"\b[0-9]{4,}\b"), hosts, quotes, every(r"\b[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\b"))
    return F.array_sort(F.array_distinct(F.transform(found, F.lower)))

"""Importance of single lines by keywords: one kernel for text at hand, one column expression for tables."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P


@dataclass
class Keywords:
    """Keywords by category; users may add their own."""

    by_category: dict[str, list[str]] = field(default_factory=lambda: {k: list(v) for k, v in P.IMPORTANCE.items()})

    def add(self, category: str, keyword: str) -> None:
        self.by_category.setdefault(category, []).append(keyword)

    def of(self, category: str) -> list[str]:
        return self.by_category.get(category, [])

    def pattern(self, category: str) -> str:
        """Whole words in any case, longer alternatives first; matches nothing without keywords."""
        found = sorted(self.of(category), key=lambda k: (-len(k), k))
        return P.words(*(re.escape(k).replace("\\ ", " ") for k in found)) if found else "$^a"


#: Categories that count in each context, besides error and importance.
CONTEXTS = {"text": ("warning",), "search": ("warning",), "log": ("warning",), "diff": ("security",)}
_DEFAULT = Keywords()
_COMPILED = {c: re.compile(_DEFAULT.pattern(c)) for c in ("error", "importance", "warning", "security")}


def category(line: str, context: str = "text") -> str | None:
    """Category of the first keyword of the line."""
    first = [(m.start(2), c) for c in ("error", "importance") if (m := _COMPILED[c].search(line))]
    if first:
        return min(first)[1]
    for c in CONTEXTS[context]:
        if _COMPILED[c].search(line):
            return c
    if context == "text" and line.startswith(tuple(P.IMPORTANCE["markdown"])):
        return "markdown"
    return None


def signal(line: Column, context: str = "text", keywords: Keywords | None = None) -> Column:
    """STRUCT<category, has_match, priority, confidence> of a line."""
    words = keywords or _DEFAULT

    def row(name: str) -> Column:
        return F.struct(F.lit(name).alias("category"), F.lit(True).alias("has_match"), F.lit(P.PRIORITY[name]).alias("priority"), F.lit(P.KEYWORD_CONFIDENCE).alias("confidence"))

    def place(name: str) -> Column:
        """Where the first keyword of a category starts."""
        return F.nullif(F.regexp_instr(line, F.lit(words.pattern(name))), F.lit(0))

    error, important = place("error"), place("importance")
    out = F.when(error.isNotNull() & (important.isNull() | (error <= important)), row("error")).when(important.isNotNull(), row("importance"))
    for name in CONTEXTS[context]:
        out = out.when(line.rlike(words.pattern(name)), row(name))
    if context == "text":
        marks = [F.startswith(line, F.lit(m)) for m in words.of("markdown")]
        if marks:
            any_mark = marks[0]
            for m in marks[1:]:
                any_mark = any_mark | m
            out = out.when(any_mark, row("markdown"))
    none = F.struct(F.lit(None).cast("string").alias("category"), F.lit(False).alias("has_match"), F.lit(0.0).alias("priority"), F.lit(0.0).alias("confidence"))
    return out.otherwise(none)


def tiered(*signals: Column) -> Column:
    """The first signal with a confidence of 0.7 or more, else the most confident one."""
    out = F.when(F.lit(False), signals[0])
    for s in signals:
        out = out.when(s["has_match"] & (s["confidence"] >= 0.7), s)
    return out.otherwise(F.sort_array(F.array(*(F.struct(s["confidence"].alias("c"), F.lit(-i).alias("i"), s.alias("s")) for i, s in enumerate(signals))), False)[0]["s"])

"""Secret scan in DataFrame functions alone: three base patterns and sliding-window entropy of candidate strings.

Base spans (code points, end exclusive) come from the leftmost, non-overlapping matches of each kind; the gaps
between matches (a split by the same pattern) and the matches' lengths give their places.

Entropy: candidates are runs of ``MIN`` or more characters of [A-Za-z0-9+/_=-]. A window of ``WINDOW`` characters
slides over a candidate; its symbol counts and the sum of c*log2(c) change by the character that enters and the
one that leaves. A candidate whose highest window entropy reaches the limit of its character class is a span of
kind ``entropy``, unless the allow list knows it or a base span overlaps it.

Defined cases: null text counts as empty and has no span; repeated rows are scanned each; an empty table gives
an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The base patterns and least lengths of the contract.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"  # a maximal run of [0-9a-f]+ that is long enough; shorter ones are dropped anyway
KINDS = ("assign", "access", "hex", "entropy")

MIN, WINDOW = 20, 20
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Character class, its pattern, least entropy in bits of the best window: 99 of 100 windows of random symbols of the
#: class's own alphabet have more (mixed: 9 of 10).
CLASSES = (
    ("digits", "^[0-9]+$", 2.5), ("hex", "^[0-9a-fA-F]+$", 2.9), ("lower", "^[a-z]+$", 3.24), ("upper", "^[A-Z]+$", 3.24), ("letters", "^[A-Za-z]+$", 3.6), ("mixed", "^.*$", 3.8),
)
#: Well-known harmless candidates: words joined by signs (with a slash before them, too), rules of one sign, UUIDs, placeholders,
#: single words (up to 20 groups of at most three consonants between at most three vowels) and camel case (humps of three letters or more).
ALLOW = r"^/?[A-Za-z]+([/_=+-]+[A-Za-z]+)+[/_=+-]*$|^[/_=+-]+$|^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$|(?i:example|sample|placeholder|changeme|dummy|your_)"
ALLOW += r"|^[A-Z]?[aeiouy]{0,3}([b-df-hj-np-tv-xz]{1,3}[aeiouy]{1,3}){0,20}[b-df-hj-np-tv-xz]{0,3}$|^[a-z]*([A-Z][a-z]{2,}){2,20}$"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _matches(pattern: str, group2: bool = False) -> str:
    """Array of (gap before, length, text, second group) of all matches; null if there is none."""
    p = _quoted(pattern)
    second = f"regexp_extract_all(text, {p}, 2)" if group2 else "CAST(NULL AS array<string>)"
    return f"CASE WHEN text RLIKE {p} THEN struct(transform(split(text, {p}, -1), g -> length(g)) AS gaps, regexp_extract_all(text, {p}, 0) AS hits, {second} AS seconds) END"


def _spans(col: str, kind: int, keep: str) -> str:
    """Spans (start, kind, end, text) of a _matches column; ``keep`` tests x.hit and x.second."""
    rows = f"transform({col}.hits, (h, i) -> struct({col}.gaps[i] AS gap, length(h) AS n, h AS hit, {col}.seconds[i] AS second))"
    none = "CAST(array() AS array<struct<start: int, kind: int, end: int, hit: string>>)"
    step = f"(a, x) -> named_struct('at', a.at + x.gap + x.n, 'out', CASE WHEN {keep} THEN concat(a.out, array(struct(a.at + x.gap AS start, {kind} AS kind, a.at + x.gap + x.n AS end, x.hit AS hit))) ELSE a.out END)"
    return f"coalesce(aggregate({rows}, named_struct('at', 0, 'out', {none}), {step}).out, {none})"


def _best_entropy(hit: str) -> str:
    """Highest entropy over all windows: counts change by one symbol in and one out."""
    chars = f"transform(split({hit}, ''), c -> locate(c, '{ALPHABET}'))"
    n = len(ALPHABET)
    f = "(CASE WHEN {0} <= 1 THEN 0D ELSE {0} * log2({0}) END)"
    # state: counts by symbol, the sum of c log2 c, the best; every step first takes out what leaves, then puts in what enters
    out = "transform(s.counts, (k, i) -> CASE WHEN i + 1 = x.o THEN k - 1 ELSE k END)"
    step = (
        f"(s, x) -> transform(array(named_struct('counts', CASE WHEN x.o > 0 THEN {out} ELSE s.counts END, "
        f"'sum', CASE WHEN x.o > 0 THEN s.sum - {f.format('s.counts[x.o - 1]')} + {f.format('(s.counts[x.o - 1] - 1)')} ELSE s.sum END, 'best', s.best)), "
        f"r -> transform(array(named_struct('counts', transform(r.counts, (k, i) -> CASE WHEN i + 1 = x.c THEN k + 1 ELSE k END), "
        f"'sum', r.sum - {f.format('r.counts[x.c - 1]')} + {f.format('(r.counts[x.c - 1] + 1)')}, 'best', r.best)), "
        f"q -> named_struct('counts', q.counts, 'sum', q.sum, 'best', CASE WHEN x.full THEN greatest(q.best, log2({WINDOW}D) - q.sum / {WINDOW}D) ELSE q.best END))[0])[0]"
    )
    rows = f"transform({chars}, (c, i) -> struct(c AS c, i >= {WINDOW - 1} AS full, CASE WHEN i >= {WINDOW} THEN locate(substring({hit}, i - {WINDOW - 1}, 1), '{ALPHABET}') ELSE 0 END AS o))"
    return f"aggregate({rows}, named_struct('counts', array_repeat(0, {n}), 'sum', 0D, 'best', 0D), {step}).best"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id with ``base`` and ``added`` spans: arrays of (start, kind, end, hit), kind an index of KINDS."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    found = rows.selectExpr(
        "doc_id", f"{_matches(ASSIGN, True)} AS m0", f"{_matches(ACCESS)} AS m1", f"{_matches(HEX)} AS m2", f"{_matches(CANDIDATE)} AS m3",
    )
    placed = found.selectExpr(
        "doc_id", f"{_spans('m0', 0, 'length(x.second) >= 12')} AS s0", f"{_spans('m1', 1, 'x.n >= 18')} AS s1", f"{_spans('m2', 2, 'true')} AS s2",
        f"{_spans('m3', 3, f'NOT x.hit RLIKE {_quoted(ALLOW)}')} AS s3",
    )
    least = "CASE " + " ".join(f"WHEN x.hit RLIKE {_quoted(p)} THEN {h}D" for _, p, h in CLASSES) + " END"
    return placed.selectExpr("doc_id", "s0", "s1", "s2", "array_sort(concat(s0, s1, s2)) AS base", "s3").selectExpr(
        "doc_id", "size(s0) AS n_assign", "size(s1) AS n_access", "size(s2) AS n_hex", "base",
        f"filter(s3, x -> NOT exists(base, b -> b.start < x.end AND x.start < b.end) AND {_best_entropy('x.hit')} >= {least} - 1e-9D) AS added",
    )


def _joined(spans: str) -> str:
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return f"array_join(transform({spans}, s -> concat({names}[s.kind], ':', s.start, ':', s.end)), ',')"


def secret_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every document."""
    return scan(docs, id_col, text_col).selectExpr(
        "doc_id", "CAST(n_assign AS long) AS n_assign", "CAST(n_access AS long) AS n_access", "CAST(n_hex AS long) AS n_hex",
        f"sha2({_joined('base')}, 256) AS base_sha256", f"{_joined('array_sort(concat(base, added))')} AS spans",
    )

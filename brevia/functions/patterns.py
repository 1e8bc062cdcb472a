"""Patterns, word lists and thresholds of the text classifiers.

Patterns avoid look-around and back-references and use ASCII word borders, so that Java and RE2 read them alike.
"""

from __future__ import annotations


def words(*alternatives: str) -> str:
    """Any of the words, whole by ASCII borders, in any case."""
    return "(?i)(^|[^A-Za-z0-9_])(" + "|".join(alternatives) + ")([^A-Za-z0-9_]|$)"


# content detection
HUNK = r"^@@[ \t]+-[0-9]+(,[0-9]+)?[ \t]*[+][0-9]+(,[0-9]+)?[ \t]*@@"
HUNK3 = r"^@@@[ \t]+-[0-9]+(,[0-9]+)?[ \t]*(-[0-9]+(,[0-9]+)?[ \t]*)*[+][0-9]+(,[0-9]+)?[ \t]*@@@"
HUNK4 = r"^@@@@[ \t]+-[0-9]+(,[0-9]+)?[ \t]*(-[0-9]+(,[0-9]+)?[ \t]*)*[+][0-9]+(,[0-9]+)?[ \t]*@@@@"
DIFF_HEADER = rf"^diff --git |^diff --combined |^diff --cc |^--- a/|{HUNK}|{HUNK3}|{HUNK4}"
DIFF_CHANGE = r"^[+-][^+-]"
DOCTYPE = r"(?i)^[ \t]*<!doctype[ \t]+html"
HTML_TAGS = ("div", "span", "script", "style", "link", "meta", "nav", "header", "footer", "aside", "article", "section", "main")
SEARCH_HIT = r"^[^: \t\n\r]+:[0-9]+:"
LOG_ERROR = words("error", "fail", "failed", "fatal", "critical", "warning", "warn")
LOG_OTHER = "|".join(
    [
        "(" + words("info", "debug", "trace") + ")", r"^[ \t]*[0-9]{4}-[0-9]{2}-[0-9]{2}", r"^[ \t]*\[[0-9]{2}:[0-9]{2}:[0-9]{2}\]", "^===", "^---",
        r"^[ \t]*(PASSED|FAILED|SKIPPED)", "^npm ERR!", "^yarn error", "^cargo error", r"Traceback \(most recent call last\)", r"^[ \t]*at[ \t]+[A-Za-z0-9_.$]+\(",
    ]
)
LANGUAGES = {
    "python": r'^[ \t]*((async def|def|class|import|from)[ \t]+[A-Za-z0-9_]|@[A-Za-z0-9_]|"""|if __name__[ \t]*==)',
    "javascript": r"^[ \t]*((function|const|let|var|class|import|export)[ \t]|async[ \t]+function|=>[ \t]*\{|module\.exports)",
    "typescript": r"^[ \t]*(interface|type|enum|namespace)[ \t]+[A-Za-z0-9_]|^:[ \t]*(string|number|boolean|any|void)([^A-Za-z0-9_]|$)",
    "go": r"^[ \t]*(func|type|package|import)[ \t]",
    "rust": r"^[ \t]*((fn|struct|enum|impl|mod|use|pub)[ \t]|#\[)",
    "java": r"^[ \t]*((public|private|protected)[ \t]+(class|interface|enum)|@[A-Za-z0-9_]|package[ \t]+[A-Za-z0-9_.]+;)",
}

# log lines
FORMATS = {
    "pytest": ("=== FAILURES", "=== ERRORS", "=== test session", "=== short test summary", "PASSED [", "FAILED [", "ERROR [", "SKIPPED [", "collected "),
    "npm": ("npm ERR!", "npm WARN", "npm info", "npm http"),
    "cargo": ("Compiling ", "Finished ", "Running ", "warning: ", "error[E"),
    "jest": ("PASS ", "FAIL ", "Test Suites:"),
    "make": ("make[", "make:", "gcc ", "g++ ", "clang "),
}
LEVELS = (
    ("error", words("error", "fatal", "critical")), ("fail", words("failed", "fail")), ("warn", words("warning", "warn")),
    ("info", words("info")), ("debug", words("debug")), ("trace", words("trace")),
)
LEVEL_SCORE = {"error": 1.0, "fail": 1.0, "warn": 0.5, "info": 0.1, "unknown": 0.1, "debug": 0.05, "trace": 0.02}
SUMMARY = (
    r"^===|^---|^[0-9]+ (passed|failed|skipped|error|warning)|^Tests?[: ][ \t]*[0-9]|^Suites?[: ][ \t]*[0-9]|^(TOTAL|Total|Summary)"
    r"|^(Test|Build|Compile).*(succeeded|failed|complete)"
)
TRACE_START = (
    r'^[ \t]*Traceback \(most recent call last\)|^[ \t]*File ".*", line .*[0-9]$|^[ \t]*at .*:[0-9]+:[0-9]|^[ \t]*at [A-Za-z0-9._$]+\(|^[ \t]*--> .*:[0-9]+:[0-9]|^[ \t]*[0-9]+: *0x[0-9a-fA-F]'
)

# line importance
IMPORTANCE = {
    "error": ("error", "exception", "fail", "failed", "failure", "fatal", "critical", "crash", "panic", "abort", "timeout", "denied", "rejected"),
    "warning": ("warn", "warning"),
    "importance": ("important", "note", "todo", "fixme", "hack", "xxx", "bug", "fix"),
    "security": ("security", "auth", "password", "secret"),
    "markdown": ("# ", "## ", "### ", "#### ", "**", "> "),
}
PRIORITY = {"error": 0.95, "warning": 0.75, "security": 0.85, "importance": 0.6, "markdown": 0.45}
KEYWORD_CONFIDENCE = 0.7
DIFF_PRIORITY = (
    "error", "exception", "failed", "failure", "fail", "fatal", "critical", "crash", "panic", "important", "note", "todo", "fixme", "hack", "xxx",
    "bug", "fix", "security", "auth", "password", "secret", "token",
)

# identifiers and query anchors
UUID = r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
TERM = rf"{UUID}|[0-9]{{4,}}|[a-zA-Z0-9_]+"

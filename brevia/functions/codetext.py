"""Source code with function bodies left out: imports, types, signatures and docstrings stay.

Python is read with the standard library's parser; brace languages by a scanner that knows strings and comments.
"""

from __future__ import annotations

import ast
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Marks that speak for a language.
HINTS = {
    "python": ("def ", "import ", "class ", "from ", "self."),
    "javascript": ("function ", "const ", "let ", "var ", "=>"),
    "typescript": ("interface ", "type ", ": string", ": number", "export "),
    "go": ("func ", "package ", "go ", ":= "),
    "rust": ("fn ", "let mut", "pub fn", "use ", "impl "),
    "java": ("public class", "void ", "private ", "public "),
    "c": ("#include", "int main(", "void ", "sizeof("),
    "cpp": ("namespace ", "class ", "::", "std::", "cout"),
}
LEAST_TOKENS = 100


@dataclass
class CodeResult:
    text: str
    language: str
    bodies: int
    tokens_in: int
    tokens_out: int


def tokens(text: str) -> int:
    return max(1, len(text.encode()) // 4)


def language(text: str) -> str:
    """The language with most hints, the first of equals; unknown without any."""
    counts = {name: sum(text.count(h) for h in hints) for name, hints in HINTS.items()}
    best = max(counts, key=lambda k: counts[k])
    return best if counts[best] else "unknown"


def language_column(text: Column) -> Column:
    """``language`` as an expression: occurrences by lengths, the most, the first of equals."""

    def count(hint: str) -> Column:
        return F.floor((F.length(text) - F.length(F.replace(text, F.lit(hint), F.lit("")))) / len(hint))

    rows = [F.struct(sum((count(h) for h in hints), F.lit(0)).alias("n"), F.lit(-i).alias("rank"), F.lit(name).alias("language")) for i, (name, hints) in enumerate(HINTS.items())]
    best = F.array_max(F.array(*rows))
    return F.when(best["n"] > 0, best["language"]).otherwise("unknown")


def can_handle(text: str) -> bool:
    return bool(text.strip()) and language(text) != "unknown"


def _python(text: str) -> tuple[str, int]:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return text, 0
    lines = text.split("\n")
    cuts = []

    def visit(node: ast.AST) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                body = child.body
                doc = isinstance(body[0], ast.Expr) and isinstance(body[0].value, ast.Constant) and isinstance(body[0].value.value, str)
                rest = body[1:] if doc else body
                if rest and rest[0].lineno > child.lineno:
                    cuts.append((min([rest[0].lineno, *(d.lineno for d in getattr(rest[0], "decorator_list", []))]), child.end_lineno, rest[0].col_offset))
            else:
                visit(child)

    visit(tree)
    removed = 0
    for first, last, indent in sorted(cuts, reverse=True):
        lines[first - 1 : last] = [" " * indent + f"# [{last - first + 1} lines omitted]", " " * indent + "pass"]
        removed += 1
    return "\n".join(lines), removed


_SCAN = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?|`(?:\\.|[^`\\])*`?|[{};]", re.S)
_TYPE = re.compile(r"\b(class|interface|struct|enum|union|impl|trait|namespace|mod|module|extern|package|switch|object)\b")
_FUNCTION = re.compile(r"\)\s*(?:const|noexcept|override|final|throws\s+[\w.,\s]+|->\s*[^{};]+|:\s*[^{};()]+|[\w\[\]*.<>, ()]*?)?\s*(?:=>)?\s*$", re.S)


def _braces(text: str) -> tuple[str, int]:
    stack: list[tuple[int, bool]] = []
    cuts: list[tuple[int, int]] = []
    head = 0
    for m in _SCAN.finditer(text):
        c = m[0]
        if c == ";":
            head = m.end()
        elif c == "{":
            lead = text[head : m.start()]
            is_function = "(" in lead and bool(_FUNCTION.search(lead)) and not _TYPE.search(lead.split("(")[0].rsplit("\n", 1)[-1])
            stack.append((m.start(), is_function))
            head = m.end()
        elif c == "}":
            head = m.end()
            if stack:
                start, is_function = stack.pop()
                n = text.count("\n", start, m.end())
                if is_function and n > 1 and not any(f for _, f in stack):
                    cuts = [x for x in cuts if x[0] < start] + [(start, m.end())]
    for start, end in reversed(cuts):
        n = max(1, text.count("\n", start, end) - 1)
        text = text[:start] + f"{{ // [{n} lines omitted] }}" + text[end:]
    return text, len(cuts)


def compress(text: str) -> CodeResult:
    name, n = language(text), tokens(text)
    if n < LEAST_TOKENS or name == "unknown":
        return CodeResult(text, name, 0, n, n)
    out, bodies = _python(text) if name == "python" else _braces(text)
    if not bodies or len(out) >= len(text):
        return CodeResult(text, name, 0, n, n)
    return CodeResult(out, name, bodies, n, tokens(out))

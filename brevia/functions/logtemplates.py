"""Runs of alike log lines as a template and its varying words."""

from __future__ import annotations

WILD = "<*>"


def collapse(text: str, min_lines: int = 20, min_run: int = 3, alike: float = 0.4, constants: int = 2) -> str | None:
    """The text with runs collapsed where that is shorter, the text itself where not; None below the least lines."""
    lines = text.split("\n")
    if lines[-1] == "":
        lines.pop()
    if not text or len(lines) < min_lines:
        return None
    out: list[str] = []
    run: list[str] = []
    template: list[str | None] = []
    number = 0

    def flush() -> None:
        nonlocal number
        fixed = sum(w is not None for w in template)
        if len(run) < min_run or fixed < constants or fixed == len(template):
            out.extend(run)
        else:
            number += 1
            out.append(f"[Template T{number}: {' '.join(WILD if w is None else w for w in template)}] ({len(run)} occurrences)")
            out.extend(" ".join(w for w, t in zip(x.split(), template) if t is None) for x in run)
        run.clear()

    for line in lines:
        words = line.split()
        if run and words and len(words) == len(template) and sum(t is None or t == w for t, w in zip(template, words)) / len(words) >= alike:
            template = [t if t == w else None for t, w in zip(template, words)]
            run.append(line)
            continue
        flush()
        if words:
            run.append(line)
            template = list(words)
        else:
            out.append(line)
    flush()
    result = "\n".join(out) + ("\n" if text.endswith("\n") else "")
    return result if len(result.encode()) < len(text.encode()) else text

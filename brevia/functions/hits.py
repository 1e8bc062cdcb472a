"""Selection of grep-style hits (file:line:content) of one block."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from dataclasses import dataclass

import numpy as np

from .importance import category
from .sizing import adaptive_k

#: A line number between two separators, the first of which follows no other separator. A search tries each place once.
NUMBER = r"(?<![:-])[:-]([0-9]+)[:-]"
_NUMBER = re.compile(NUMBER)


@dataclass(frozen=True)
class HitRules:
    per_file: int = 5
    most: int = 30
    least: int = 5
    files: int = 15
    keep_first: bool = True
    keep_last: bool = True
    boost: bool = True
    keywords: tuple[str, ...] = ()
    store_hits: int = 10
    store_ratio: float = 0.8


@dataclass
class HitResult:
    text: str
    hits_in: int = 0
    hits_out: int = 0
    files: int = 0
    key: str | None = None


def parse(line: str) -> tuple[str, int, str] | None:
    """(file, line number, content) by the first number between separators; None without one or without a file before it.

    The colon of a drive letter is followed by a slash, so it is never such a place.
    """
    line = line.strip()
    m = _NUMBER.search(line)
    return (line[: m.start()], int(m[1]), line[m.end() :]) if m and m.start() else None


def score(content: str, words: list[str], rules: HitRules) -> float:
    """Relevance of a hit, summed in single precision: that decides ties."""
    low, s = content.lower(), np.float32(0)
    for w in words:
        if w in low:
            s += np.float32(0.3)
    if rules.boost:
        s += np.float32({"error": 0.5, "warning": 0.4, "importance": 0.3}.get(category(content, "search"), 0.0))
    for w in rules.keywords:
        if w.lower() in low:
            s += np.float32(0.4)
    return float(min(s, np.float32(1)))


def compress(text: str, query: str = "", bias: float = 1.0, rules: HitRules = HitRules()) -> HitResult:
    words = [w for w in query.lower().split() if len(w.encode()) > 2]
    files: dict[str, list[tuple[int, str, float]]] = defaultdict(list)
    for line in text.split("\n"):
        hit = parse(line)
        if hit:
            files[hit[0]].append((hit[1], hit[2], score(hit[2], words, rules)))
    if not files:
        return HitResult(text)
    total = {f: float(np.sum(np.array([s for _, _, s in rows], np.float32), dtype=np.float32)) for f, rows in files.items()}
    order = sorted(files, key=lambda f: (-total[f], f))[: rules.files]
    k = adaptive_k([f"{f}:{n}:{c}" for f in order for n, c, _ in files[f]], bias, rules.least, rules.most)
    chosen: dict[str, list[tuple[int, str]]] = {}
    taken = 0
    for f in order:
        room = min(rules.per_file, k - taken)
        if room <= 0:
            break
        rows = files[f]
        ranked = [rows[0]] * rules.keep_first + [rows[-1]] * (rules.keep_last and len(rows) > 1) + sorted(rows, key=lambda r: (-r[2], r[0]))
        own = list(dict.fromkeys((n, c) for n, c, _ in ranked))[:room]
        chosen[f] = sorted(own, key=lambda r: r[0])
        taken += len(own)
    out = []
    for f in sorted(chosen):
        out += [f"{f}:{n}:{c}" for n, c in chosen[f]]
        if len(files[f]) > len(chosen[f]):
            out.append(f"[... and {len(files[f]) - len(chosen[f])} more matches in {f}]")
    hits = sum(map(len, files.values()))
    result = HitResult("\n".join(out), hits, taken, len(chosen))
    if hits >= rules.store_hits and len(result.text.encode()) / max(1, len(text.encode())) < rules.store_ratio:
        result.key = hashlib.md5(text.encode()).hexdigest()[:24]
        result.text += f"\n[{hits} matches compressed to {taken}. Retrieve more: hash={result.key}]"
    return result

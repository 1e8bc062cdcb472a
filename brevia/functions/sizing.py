"""How many of a sequence of items are worth keeping, from the diversity of the items.

Greedy SimHash clusters tell how many distinct items there are; the running count of distinct word pairs has a
knee beyond which further items add little; a check of compressibility widens the choice where it loses too much.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib

import numpy as np

FEW = 8
SAME, SAME_CLUSTERS = 3, 3
KNEE_LEAST = 0.05
DIVERSE = 0.7
ZLIB_TOLERANCE, ZLIB_LEAST, ZLIB_GROWTH = 0.15, 200, 1.2
_SPACE = re.compile(r"[ \t\n\r]+")


class _Grams:
    """Bits of the hashes of 4-grams met so far, as rows of one matrix; emptied when it is full."""

    MOST = 1 << 18

    def __init__(self) -> None:
        self.row: dict[str, int] = {}
        self.bits = np.zeros((1024, 64), np.int8)

    def rows(self, grams: list[str]) -> list[int]:
        if len(self.row) + len(grams) > self.MOST and self.row:
            self.row = {}
        row = self.row
        for g in set(grams).difference(row):
            at = row[g] = len(row)
            if at == len(self.bits):
                self.bits = np.concatenate([self.bits, np.zeros_like(self.bits)])
            digest = hashlib.md5(g.encode()).digest()[:8]
            self.bits[at] = np.unpackbits(np.frombuffer(digest, np.uint8)[::-1], bitorder="little").view(np.int8) * 2 - 1
        return [row[g] for g in grams]


_grams = _Grams()
#: 4-grams of a text summed at once.
_PART = 1 << 14


def simhash(text: str) -> int:
    """64-bit SimHash over the MD5 of lower-case 4-grams (the whole text if it is shorter)."""
    low = text.lower()
    n = max(1, len(low) - 3)
    votes = np.zeros(64, np.int64)
    for lo in range(0, n, _PART):
        at = _grams.rows([low[i : i + 4] for i in range(lo, min(n, lo + _PART))])
        votes += _grams.bits[at].sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes > 0, bitorder="little").tobytes(), "little")


def clusters(items: list[str], radius: int = SAME) -> int:
    """Greedy clusters: an item joins the first representative within the radius, else becomes one.

    Representatives are looked up by the blocks of their fingerprint: of radius + 1 blocks one is equal within the radius.
    """
    parts = radius + 1
    width = -(-64 // parts)
    seen: list[dict[int, list[int]]] = [{} for _ in range(parts)]
    n = 0
    for item in dict.fromkeys(items):
        f = simhash(item)
        own = [f >> (width * b) & ((1 << width) - 1) for b in range(parts)]
        if any((r ^ f).bit_count() <= radius for d, v in zip(seen, own) for r in d.get(v, ())):
            continue
        n += 1
        for d, v in zip(seen, own):
            d.setdefault(v, []).append(f)
    return n


def pair_curve(items: list[str]) -> list[int]:
    """Distinct lower-case word pairs seen up to each item; an item of one word counts as that word."""
    seen: set = set()
    curve = []
    for item in items:
        w = [x for x in _SPACE.split(item.translate(_ASCII_LOWER)) if x]
        seen.update(zip(w, w[1:]) if len(w) > 1 else [tuple(w)])
        curve.append(len(seen))
    return curve


_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def knee(curve: list[int]) -> int | None:
    """1-based place where the scaled curve is farthest above the diagonal; 1 on a flat curve, None if never far."""
    n = len(curve)
    if n < 3:
        return None
    if curve[0] == curve[-1]:
        return 1
    y = (np.array(curve, float) - curve[0]) / (curve[-1] - curve[0])
    above = y - np.arange(n) / (n - 1)
    at = int(np.argmax(above))
    return at + 1 if above[at] >= KNEE_LEAST else None


def deflated(text: str) -> int:
    c = zlib.compressobj(1, zlib.DEFLATED, -15)
    return len(c.compress(text.encode())) + len(c.flush())


def widened(items: list[str], k: int, most: int) -> int:
    """k, or 1.2 k where the first k compress much unlike all items."""
    if k >= len(items) or k >= most:
        return k
    whole, part = "\n".join(items), "\n".join(items[:k])
    if len(whole.encode()) < ZLIB_LEAST:
        return k
    ratio = lambda s: deflated(s) / len(s.encode()) if s else 1.0
    return min(int(k * ZLIB_GROWTH), most) if abs(ratio(whole) - ratio(part)) > ZLIB_TOLERANCE else k


def adaptive_k(items: list[str], bias: float, least: int, most: int | None = None, check: bool = True) -> int:
    n = len(items)
    if n <= FEW:
        return n
    cap = n if most is None else most
    distinct = clusters(items)
    if distinct <= SAME_CLUSTERS:
        return min(max(least, distinct), cap)
    share = distinct / n
    spread = max(least, math.floor(n * (0.3 + 0.7 * share)))
    at = knee(pair_curve(items))
    if at is None:
        at = spread
    elif share > DIVERSE:
        at = max(at, spread)
    k = min(max(least, math.floor(at * bias)), cap)
    return widened(items, k, cap) if check else k


def split_k(total: int, first: float = 0.3, last: float = 0.15) -> tuple[int, int]:
    """How many of k come from the head and from the tail."""
    head = min(max(1, round(total * first)), total)
    return head, min(max(1, round(total * last)), total - head)

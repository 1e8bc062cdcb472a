"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming lookup, exact verification.

Words are runs of letters, digits and other non-ASCII characters, capitals folded; shingles are k words. For every
size that an item has, the windows of that many shingles are looked at. A window can only be similar to any item if
most of its shingles occur in the benchmark: of size + item size tokens, the share least / (1 + least) must be common.
A running count of known shingles thus drops most windows, exactly and whatever item they might match.

The 64-bit fingerprint of a window is the sign of its summed shingle votes (a shingle that occurs twice votes
twice). Items are found by it alone: fingerprints are cut into ``BLOCKS`` blocks of 8 bits, and two fingerprints within
``RADIUS`` differ in some block by at most RADIUS // BLOCKS bits, so the union over blocks of the items within that
ball holds all of them. Candidates of the window's size are verified by the weighted Jaccard similarity of the shingle
multisets. A similarity of 0.8 turns about 10 of 64 bits; ``RADIUS`` is over three deviations above that.

Defined cases: null or empty texts and items match nothing; an item of fewer than k words matches only a text
that is the same words; repeated rows give a row each; empty tables give an empty result; further columns are
ignored; ids must be numbers, and a leak in a row with a null id has a null doc_id. Very long texts are read whole.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .language_id import folded
from .textkernel import HashIndex, U, hashes, segments, shingles, slices, text_buffers

BLOCKS, RADIUS = 8, 20
#: Bytes of items handled at once; a larger benchmark is held against the texts in several groups.
GROUP_BYTES = 8 << 20
#: Windows whose votes are summed at once.
WINDOWS = 4096
#: ASCII signs part words.
SIGN = np.zeros(256, bool)
SIGN[:128] = True
SIGN[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False
OUT = "doc_id long, item_id long, similarity double, word_start long, word_end long"


def shingle_rows(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingle hashes, their number by row, words by row)."""
    low = folded(data)
    start, stop, counts = segments(low, offsets, SIGN)
    h, n = shingles(hashes(low, start, stop), counts, k)
    return h, n, counts


def fingerprints(h: np.ndarray, size: int) -> np.ndarray:
    """SimHash of every run of ``size`` shingles."""
    votes = ((h[:, None] >> np.arange(64, dtype=U)) & U(1)).astype(np.int32) * 2 - 1
    total = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(votes, 0, dtype=np.int32)])
    sign = total[size:] - total[:-size] > 0
    return np.packbits(sign, axis=1, bitorder="little").view("<u8").reshape(-1)


class Items:
    """The benchmark's shingles, fingerprints and Hamming blocks."""

    def __init__(self, ids: list[int], texts: list[str], k: int) -> None:
        data, off = text_buffers(pa.array(texts, pa.string()))
        h, n, _ = shingle_rows(data, off, k)
        ends = np.cumsum(n)
        self.ids, self.h = ids, [h[a:b] for a, b in zip(ends - n, ends)]
        self.bags = [Counter(x.tolist()) for x in self.h]
        self.sizes = n
        self.distinct_sizes = np.unique(n[n > 0]).tolist()
        self.index = HashIndex()
        self.index.add(np.unique(h))
        self.prints = np.array([fingerprints(x, len(x))[0] if len(x) else 0 for x in self.h], U)
        # near[size][b][v]: bits of the items of a size whose block b is within RADIUS // BLOCKS bits of v
        value = np.arange(256, dtype=np.uint8)
        self.of_size = {size: np.flatnonzero(n == size) for size in self.distinct_sizes}
        self.near = {}
        for size, own in self.of_size.items():
            blocks = self.prints[own].view(np.uint8).reshape(-1, 8)
            self.near[size] = np.stack([np.packbits(np.bitwise_count(blocks[None, :, b] ^ value[:, None]) <= RADIUS // BLOCKS, axis=1) for b in range(BLOCKS)])

    def within(self, prints: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(place of the fingerprint, item) of all items of ``size`` shingles within RADIUS of a fingerprint, by place."""
        blocks, near, own = prints.view(np.uint8).reshape(-1, 8), self.near[size], self.of_size[size]
        mask = near[0][blocks[:, 0]]
        for b in range(1, BLOCKS):
            mask = mask | near[b][blocks[:, b]]
        hit = np.flatnonzero(mask.any(1))
        at, item = np.nonzero(np.unpackbits(mask[hit], axis=1, count=len(own)))
        at, item = hit[at], own[item]
        ok = np.bitwise_count(self.prints[item] ^ prints[at]) <= RADIUS
        return at[ok], item[ok]

    def matches(self, h: np.ndarray, known: np.ndarray, least: float) -> Iterator[tuple[int, float, int, int]]:
        """(item, similarity, first shingle, end) of the best window of each item in one text; known: which shingles some item has."""
        count = np.concatenate([[0], np.cumsum(known)])
        best: dict[int, tuple[float, int, int]] = {}
        for item_size in self.distinct_sizes:
            size = min(item_size, len(h))
            need = math.ceil(least * (size + item_size) / (1 + least) - 1e-9)
            if need > min(size, int(count[-1])):
                break  # larger items need more
            first = np.flatnonzero(count[size:] - count[:-size] >= need)
            # runs of neighbouring windows share one pass over their shingles
            for run in np.split(first, np.flatnonzero(np.diff(first) > 1) + 1) if len(first) else ():
                for lo in range(int(run[0]), int(run[-1]) + 1, WINDOWS):
                    part = h[lo : min(lo + WINDOWS, int(run[-1]) + 1) + size - 1]
                    bag, last = None, -1
                    for at, i in zip(*(x.tolist() for x in self.within(fingerprints(part, size), item_size))):
                        if at != last:
                            bag, last = Counter(part[at : at + size].tolist()), at
                        best[i] = max(best.get(i, (0.0, 0, 0)), (weighted(bag, self.bags[i]), -(lo + at), size))
        for i, (sim, at, size) in sorted(best.items()):
            if sim >= least:
                yield i, sim, -at, -at + size


def weighted(a: Counter, b: Counter) -> float:
    """Weighted Jaccard similarity of two multisets."""
    inter = sum(min(n, b[x]) for x, n in a.items() if x in b)
    return inter / (sum(a.values()) + sum(b.values()) - inter)


def _match(items: Items, k: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            ids = batch.column(0).to_pylist()
            data, off = text_buffers(batch.column(1))
            for lo, hi, b, o in slices(data, off):
                h, n, words = shingle_rows(b, o, k)
                entry = items.index.get(h)
                ends = np.cumsum(n)
                for r in np.unique(np.searchsorted(ends, np.flatnonzero(entry >= 0), "right")).tolist():
                    begin = int(ends[r] - n[r])
                    for i, sim, first, end in items.matches(h[begin : int(ends[r])], entry[begin : int(ends[r])] >= 0, least):
                        rows.append((ids[lo + r], items.ids[i], sim, first, min(int(words[r]), end + k - 1)))
            c = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.float64()), pa.array(c[3], pa.int64()), pa.array(c[4], pa.int64())], ["doc_id", "item_id", "similarity", "word_start", "word_end"])

    return run


def _groups(benchmark: DataFrame, k: int) -> Iterator[Items]:
    """The benchmark in groups of ``GROUP_BYTES``, each read to the driver and handed to the tasks."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text IS NOT NULL AND item_id IS NOT NULL")
    size = items.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    groups = max(1, -(-size // GROUP_BYTES))
    for g in range(groups):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(groups)) == g).orderBy("item_id").collect()
        yield Items([r.item_id for r in rows], [r.text for r in rows], k)


def contaminated(docs: DataFrame, benchmark: DataFrame, k: int = 5, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document and item that it holds: doc_id, item_id, similarity, word_start, word_end of the best window."""
    common.small_batches(docs.sparkSession)
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    out = None
    for items in _groups(benchmark, k):
        found = base.mapInArrow(_match(items, k, least), OUT)
        out = found if out is None else out.union(found)
    return out


def _clean(items: Items, k: int, least: float, text_at: int):
    """Rows whose text holds no item, whole."""
    match = _match(items, k, least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = pa.array(np.arange(batch.num_rows))
            held = next(match(iter([pa.RecordBatch.from_arrays([place, batch.column(text_at)], ["place", "text"])])))
            keep = np.ones(batch.num_rows, bool)
            keep[held.column(0).to_numpy()] = False
            yield batch.filter(pa.array(keep))

    return run


def keep_clean(docs: DataFrame, benchmark: DataFrame, k: int = 5, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the documents that hold a benchmark item; rows without an id are judged one by one, by their text."""
    gone = common.written(contaminated(docs, benchmark, k, least, id_col, text_col).select(F.col("doc_id").alias(id_col)).where(F.col(f"`{id_col}`").isNotNull()).distinct(), "leaks")
    named = common.keyed_filter(docs.where(F.col(f"`{id_col}`").isNotNull()), gone, id_col, "left_anti").select(docs.columns)
    rest = docs.where(F.col(f"`{id_col}`").isNull())
    if rest.isEmpty():
        return named
    for items in _groups(benchmark, k):
        rest = rest.mapInArrow(_clean(items, k, least, docs.columns.index(text_col)), docs.schema)
    return named.union(rest)

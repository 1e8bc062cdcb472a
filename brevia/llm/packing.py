"""Best-fit packing of documents into sequences under vector capacities.

A sequence has three residual capacities: tokens, documents and attention cost (the sum of squared piece
lengths). Pieces go in falling length to the open sequence that satisfies every capacity and whose residual
vector after placement has the smallest weighted norm. Documents longer than a piece may be (by the tokens, and by
the cost of a sequence) are cut into longest pieces, the first of which takes what remains; a piece that fills a
sequence is a sequence of its own. Other pieces are dealt into groups of about ``GROUP`` pieces that are packed
independently, so a task's memory is bounded and at most one poorly filled sequence is added per group. The hash that
deals them holds a piece's place in its task, so that repeated rows spread over all groups.

Defined cases: null text is empty (its end id alone); every row is a document, repeated rows too; an empty
table gives an empty result; further columns are ignored; ids must be numbers, a null id stays null. Very long texts
are encoded whole, in slices.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .textkernel import slices, text_buffers
from .tokencache import encoder

GROUP = 50_000
#: Weights of tokens, documents and attention cost in the residual norm.
WEIGHTS = (1.0, 0.01, 0.01)
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
_SALTED = PIECE + ", salt long"


def _pieces(path: str, end_id: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for batch in batches:
            data, off = text_buffers(batch.column(1))
            ids = batch.column(0).to_pylist()
            for lo, hi, b, o in slices(data, off):
                tokens, n = encoder(path, end_id, True).encode(b, o)
                rows = []
                at = 0
                for doc, total in zip(ids[lo:hi], n.tolist()):
                    begin, k = 0, 0
                    while begin < total:
                        end = begin + (total % size or size) if k == 0 else begin + size
                        rows.append((doc, k, begin, end - begin, zlib.crc32(tokens[at + begin : at + end].astype("<u4"))))
                        begin, k = end, k + 1
                    at += total
                c = list(zip(*rows))
                salt = pa.array(np.arange(seen, seen + len(rows)))
                seen += len(rows)
                yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int32()), *(pa.array(x, pa.int64()) for x in c[2:]), salt], ["doc_id", "piece", "start", "length", "ids_crc32", "salt"])

    return run


def best_fit(lengths: np.ndarray, tokens: int, documents: int, cost: int, weights: tuple[float, float, float] = WEIGHTS) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece. Bins wait in lists by residual tokens; a bit mask finds the next list that is not empty."""
    wt, wd, wc = weights[0] / tokens**2, weights[1] / documents**2, weights[2] / cost**2
    where, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    waiting: list[list[tuple[int, int, int]]] = [[] for _ in range(tokens + 1)]
    mask, bins = 0, 0
    order = np.argsort(-lengths, kind="stable")
    for i, n in zip(order.tolist(), lengths[order].tolist()):
        best, found, square = float("inf"), None, n * n
        rest = mask >> n << n
        while rest:
            r = (rest & -rest).bit_length() - 1
            if wt * (r - n) ** 2 >= best:
                break
            for at, (_, d, c) in enumerate(waiting[r]):
                if d >= 1 and c >= square:
                    score = wt * (r - n) ** 2 + wd * (d - 1) ** 2 + wc * (c - square) ** 2
                    if score < best:
                        best, found = score, (r, at)
            rest &= rest - 1
        if found is None:
            if square > cost or documents < 1:
                raise ValueError(f"a piece of {n} tokens does not fit the capacities")
            own, r, d, c = bins, tokens, documents, cost
            bins += 1
        else:
            r, at = found
            own, d, c = waiting[r][at]
            waiting[r][at] = waiting[r][-1]
            waiting[r].pop()
            if not waiting[r]:
                mask &= ~(1 << r)
        where[i], offset[i] = own, tokens - r
        r, d, c = r - n, d - 1, c - square
        if r > 0 and d > 0:
            waiting[r].append((own, d, c))
            mask |= 1 << r
    return where, offset


def _pack(tokens: int, documents: int, cost: int, weights: tuple[float, float, float]):
    def run(table: pa.Table) -> pa.Table:
        where, offset = best_fit(table["length"].to_numpy(), tokens, documents, cost, weights)
        seq = (table["grp"].to_numpy().astype(np.int64) << 32) + where
        return table.drop(["grp"]).append_column("sequence_id", pa.array(seq)).append_column("offset", pa.array(offset))

    return run


def pack(
    docs: DataFrame, path: str, end_id: int = 0, tokens: int = 2048, documents: int | None = None, cost: int | None = None,
    weights: tuple[float, float, float] = WEIGHTS, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    ``documents`` and ``cost`` are capacities of a sequence beside its tokens: pieces, and the sum of their squared
    lengths. Left out they don't bind, as at most ``tokens`` pieces and ``tokens`` squared fit anyway.
    """
    documents, cost = documents or tokens, cost or tokens**2
    longest = min(tokens, math.isqrt(cost))
    common.small_batches(docs.sparkSession)
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    pieces = common.written(base.mapInArrow(_pieces(path, end_id, longest), _SALTED), "pieces")
    n = pieces.where(F.col("length") < tokens).count()
    groups = max(1, round(n / GROUP))
    full = pieces.drop("salt").where(F.col("length") == tokens).withColumn("sequence_id", F.lit(1 << 62) + F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    small = pieces.where(F.col("length") < tokens).withColumn("grp", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "salt"), F.lit(groups))).drop("salt")
    packed = small.groupBy("grp").applyInArrow(_pack(tokens, documents, cost, weights), PIECE + ", sequence_id long, offset long")
    return full.unionByName(packed)

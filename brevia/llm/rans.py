"""Token-id files in a static range asymmetric numeral system (rANS).

One frequency table, shared by all files, is scaled to 2^SCALE. Ids are cut into blocks of ``BLOCK`` ids; a
block has ``LANES`` interleaved coders, each with a 64-bit state and 32-bit renormalisation words. Blocks are
independent: a checkpoint per block (first word, lane states, CRC-32 of its ids) lets a reader start at any of
them, and all blocks of a segment are encoded and decoded in lock step.

A segment is a run of whole documents in ascending id order, in one self-contained blob:

    magic 'RNS1', then little-endian uint32: documents, ids, blocks, words
    document table: int64 id, uint32 ids of it          (one entry per document)
    block table:    uint32 words before it, uint32 CRC-32, LANES x uint64 states
    words:          uint32 each

Segments are the rows (part, seg, blob) of Parquet shards, so that any store that Spark reads will do; the
frequency table is the Parquet table (id, freq) beside them.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .textkernel import U, slices, text_buffers
from .tokencache import encoder

SCALE, LANES, STEPS = 20, 32, 256
BLOCK = LANES * STEPS
LOW = 1 << 31
#: Ids after which a segment ends with the document at hand.
SEGMENT = 1 << 20
MAGIC = b"RNS1"


def frequencies(counts: np.ndarray) -> np.ndarray:
    """Counts scaled to a sum of 2^SCALE, at least 1 where an id occurs."""
    total, out = int(counts.sum()), np.zeros(len(counts), np.int64)
    if total == 0:
        out[0] = 1 << SCALE
        return out
    out = np.where(counts > 0, np.maximum(1, (counts.astype(np.float64) / total * (1 << SCALE)).astype(np.int64)), 0)
    gap = (1 << SCALE) - int(out.sum())
    order = np.argsort(-counts, kind="stable")
    if gap >= 0:
        out[order[0]] += gap
    for i in order:  # the ids that occur most give way to those that were raised to 1
        if gap >= 0:
            break
        give = min(-gap, int(out[i]) // 2)
        out[i] -= give
        gap += give
    return out


class Coder:
    """Encoder and decoder of one frequency table."""

    def __init__(self, freq: np.ndarray) -> None:
        self.freq = freq.astype(U)
        self.low = (np.cumsum(freq) - freq).astype(U)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.int32), freq)
        self.pad = int(np.argmax(freq))

    def encode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(words, words before each block, states by block and lane); a last block is filled up with the commonest id."""
        blocks = -(-len(ids) // BLOCK)
        full = np.full(blocks * BLOCK, self.pad, np.int64)
        full[: len(ids)] = ids
        sym = full.reshape(blocks, STEPS, LANES)
        state = np.full((blocks, LANES), LOW, U)
        word = np.zeros((blocks, STEPS, LANES), np.uint32)
        used = np.zeros((blocks, STEPS, LANES), bool)
        for t in range(STEPS - 1, -1, -1):
            f, lo = self.freq[sym[:, t]], self.low[sym[:, t]]
            spill = state >= (f << U(63 - SCALE))
            word[:, t] = state.astype(np.uint32)
            used[:, t] = spill
            state = np.where(spill, state >> U(32), state)
            q = state // f
            state = (q << U(SCALE)) + (state - q * f) + lo
        before = np.concatenate([[0], np.cumsum(used.sum((1, 2)))])[:blocks]
        return word[used], before, state

    def decode(self, words: np.ndarray, before: np.ndarray, state: np.ndarray, n: int) -> np.ndarray:
        blocks = len(before)
        out = np.empty((blocks, STEPS, LANES), np.int32)
        at = before.astype(np.int64).copy()
        state = state.copy()
        words = np.concatenate([words, np.zeros(1, np.uint32)]).astype(U)
        for t in range(STEPS):
            slot = state & U((1 << SCALE) - 1)
            s = self.symbol[slot.astype(np.int64)]
            out[:, t] = s
            state = self.freq[s] * (state >> U(SCALE)) + slot - self.low[s]
            need = state < U(LOW)
            order = np.cumsum(need, axis=1)
            pick = np.minimum(at[:, None] + order - 1, len(words) - 1)
            state = np.where(need, (state << U(32)) | words[pick], state)
            at += order[:, -1]
        return out.reshape(-1)[:n]


def write_segment(coder: Coder, docs: list[int], sizes: np.ndarray, ids: np.ndarray) -> bytes:
    words, before, state = coder.encode(ids)
    table = np.zeros(len(docs), [("id", "<i8"), ("n", "<u4")])
    table["id"], table["n"] = docs, sizes
    block = np.zeros(len(before), [("before", "<u4"), ("crc", "<u4"), ("state", "<u8", (LANES,))])
    block["before"], block["state"] = before, state
    raw = ids.astype("<u4")
    block["crc"] = [zlib.crc32(raw[i * BLOCK : (i + 1) * BLOCK]) for i in range(len(before))]
    head = MAGIC + struct.pack("<4I", len(docs), len(ids), len(before), len(words))
    return head + table.tobytes() + block.tobytes() + words.astype("<u4").tobytes()


def read_segment(coder: Coder, blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document ids, ids of each, all ids); every block's checksum is held against its ids."""
    if blob[:4] != MAGIC:
        raise ValueError("not a segment of this format")
    docs, n, blocks, words = struct.unpack_from("<4I", blob, 4)
    at = 20
    table = np.frombuffer(blob, [("id", "<i8"), ("n", "<u4")], docs, at)
    at += table.nbytes
    block = np.frombuffer(blob, [("before", "<u4"), ("crc", "<u4"), ("state", "<u8", (LANES,))], blocks, at)
    at += block.nbytes
    ids = coder.decode(np.frombuffer(blob, "<u4", words, at), block["before"], block["state"].astype(U), n)
    raw = ids.astype("<u4")
    for i, crc in enumerate(block["crc"].tolist()):
        if zlib.crc32(raw[i * BLOCK : (i + 1) * BLOCK]) != crc:
            raise ValueError(f"block {i} does not match its checksum")
    return table["id"], table["n"].astype(np.int64), ids


def _tokenise(path: str, end_id: int, joins_space: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            data, off = text_buffers(batch.column(1))
            packed: list[bytes] = []
            for _, _, b, o in slices(data, off):
                ids, n = encoder(path, end_id, joins_space).encode(b, o)
                ids = ids.astype("<u4" if ids.size and ids.max() > 0xFFFF else "<u2")
                ends = np.cumsum(n)
                wide = bytes([ids.itemsize])
                packed += [wide + squeeze.compress(ids[a:e].tobytes()) for a, e in zip((ends - n).tolist(), ends.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], ["doc_id", "ids"])

    return run


def _unpacked(col: pa.Array) -> Iterator[np.ndarray]:
    plain = zstandard.ZstdDecompressor()
    for x in col:
        raw = x.as_py()
        yield np.frombuffer(plain.decompress(raw[1:]), f"<u{raw[0]}")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1, np.int64)
    for batch in batches:
        for ids in _unpacked(batch.column(0)):
            c = np.bincount(ids)
            if len(c) > len(total):
                total = np.concatenate([total, np.zeros(len(c) - len(total), np.int64)])
            total[: len(c)] += c
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["id", "n"])


def _write(freq: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, seg = Coder(freq), TaskContext.get().partitionId(), 0
        docs: list[int] = []
        own: list[np.ndarray] = []
        held = 0

        def flush():
            ids = np.concatenate(own).astype(np.int64)
            blob = write_segment(coder, docs, np.array([len(x) for x in own]), ids)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([seg], pa.int32()), pa.array([docs[0]], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([blob], pa.binary())],
                ["part", "seg", "first_id", "n_ids", "blob"],
            )

        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), _unpacked(batch.column(1))):
                docs.append(doc)
                own.append(ids)
                held += len(ids)
                if held >= SEGMENT:
                    yield flush()
                    docs, own, held, seg = [], [], 0, seg + 1
        if docs:
            yield flush()

    return run


def _read(freq: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(freq)
        for batch in batches:
            for part, seg, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                doc, n, ids = read_segment(coder, blob.as_py())
                ends = np.cumsum(n)
                raw = ids.astype("<u4")
                crc = [zlib.crc32(raw[a:e]) for a, e in zip((ends - n).tolist(), ends.tolist())]
                m = len(doc)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(m, part, np.int32)), pa.array(np.full(m, seg, np.int32)), pa.array(doc.astype(np.int64)), pa.array(ends - n), pa.array(n), pa.array(crc, pa.int64())],
                    ["part", "seg", "doc_id", "at", "n_tokens", "ids_crc32"],
                )

    return run


def write_files(docs: DataFrame, out: str, path: str, end_id: int = 1, joins_space: bool = False, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every document into segment files under ``out`` (segments, table), in ascending id order.

    Null text is empty (the end id alone); a null id counts as the smallest; repeated rows are written each; an
    empty table gives no segment; further columns are ignored.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    base = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(-(1 << 63))).alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    tokens = common.written(base.mapInArrow(_tokenise(path, end_id, joins_space), "doc_id long, ids binary"), "ids")
    # one count per id of the vocabulary, whatever the corpus
    counted = {r.id: r.n for r in tokens.select("ids").mapInArrow(_count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()}
    counts = np.zeros(max(counted, default=0) + 1, np.int64)
    for i, n in counted.items():
        counts[i] = n
    freq = frequencies(counts)
    spark.createDataFrame([(i, int(f)) for i, f in enumerate(freq) if f], "id long, freq long").coalesce(1).write.parquet(f"{out}/table")
    ordered = tokens.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    ordered.mapInArrow(_write(freq), "part int, seg int, first_id long, n_ids long, blob binary").write.option("compression", "none").parquet(f"{out}/segments")
    common.drop(tokens)


def read_files(spark: SparkSession, out: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the files."""
    table = {r.id: r.freq for r in spark.read.parquet(f"{out}/table").collect()}
    freq = np.zeros(max(table, default=0) + 1, np.int64)
    for i, f in table.items():
        freq[i] = f
    segments = spark.read.parquet(f"{out}/segments")
    # starts: totals of the parts (as many as the writer had tasks) are summed on the driver, segments within a part by a window
    parts = segments.groupBy("part").agg(F.min("first_id").alias("first"), F.sum("n_ids").alias("n")).collect()
    starts, at = [], 0
    for r in sorted(parts, key=lambda r: (r["first"], r["part"])):
        starts.append((r["part"], at))
        at += r["n"]
    part_start = spark.createDataFrame(starts, "part int, part_start long")
    from pyspark.sql import Window

    w = Window.partitionBy("part").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    seg_start = segments.select("part", "seg", "n_ids").withColumn("seg_start", F.coalesce(F.sum("n_ids").over(w), F.lit(0))).join(part_start, "part").select("part", "seg", (F.col("part_start") + F.col("seg_start")).alias("base"))
    docs = segments.select("part", "seg", "blob").mapInArrow(_read(freq), "part int, seg int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return docs.join(seg_start, ["part", "seg"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")

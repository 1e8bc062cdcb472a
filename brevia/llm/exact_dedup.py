"""Exact dedup by distributed most-significant-digit radix partitioning of normalised texts.

Texts are equal when they are identical after white space [\\x20\\x09-\\x0D] is deleted. No digest decides
equality: documents are dealt out by the leading bytes of their text, prefixes that hold too many documents
are split by further bytes (counted over all documents, level by level), and what shares a bucket is split
by successive bytes until every group is a single text or has ended.

Copies that one task meets collapse before the shuffle, so that a group with a third of all rows arrives as
about one row per task; rows of a group never meet in one task, only their representatives do.

A path's bodies are split within a fixed budget of bytes. The rows, tagged, and the roots are written to the shared
folder; the result reads them, so they stay until that folder is cleaned.

Defined cases: null text counts as empty; empty texts are one group; repeated rows (same id and text) count
as separate rows, of which one stays; ids are of any ordered type; null ids are allowed and sort last on ties; very
long texts are split like others, one at a time if they exceed the budget; an empty table gives an empty result;
other columns, whatever their names, are carried along in the struct ``row``.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .textkernel import text_buffers

WHITE = b" \t\n\x0b\x0c\r"
#: Bytes of the radix prefix by level; the last level is the whole text.
LEVELS = (16, 128, 1024, 8192, 65536)
#: A task forgets the texts that it has seen once they hold so many bytes.
SEEN_BYTES = 24 << 20
#: Bytes of the bodies that are split by successive bytes at once.
BUCKET_BYTES = 32 << 20


def normalised(col: pa.Array) -> list[bytes]:
    data, off = text_buffers(col)
    raw = memoryview(data.tobytes())
    return [bytes(raw[a:b]).translate(None, WHITE) for a, b in zip(off[:-1].tolist(), off[1:].tolist())]


def _tag(text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid, seen, held = TaskContext.get().partitionId() << 40, {}, 0
        for batch in batches:
            row = batch.column(0)
            col = row.field(text_col) if row.null_count == 0 else pc.struct_field(row, text_col)
            uids, reps, shas, paths = [], [], [], []
            for text in normalised(col):
                at = seen.get(text)
                if at is None:
                    held += len(text) + 100
                    if held > SEEN_BYTES:
                        seen, held = {}, len(text) + 100
                    at = seen[text] = (uid, hashlib.sha256(text).digest())
                uids.append(uid)
                reps.append(at[0])
                shas.append(at[1])
                paths.append(text[: LEVELS[0]])
                uid += 1
            n_cp = pc.fill_null(pc.utf8_length(col), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [row, pa.array(uids, pa.int64()), pa.array(reps, pa.int64()), n_cp, pa.array(shas, pa.binary()), pa.array(paths, pa.binary())],
                ["row", "uid", "rep", "n_cp", "sha", "path"],
            )

    return run


def _prefix_counts(level: int, heavy: frozenset[bytes]):
    """Counts of the prefixes of this level among texts under a heavy prefix of the level before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count: dict[bytes, int] = defaultdict(int)
            for text in normalised(batch.column(0)):
                if text[: LEVELS[level - 1]] in heavy and len(text) > LEVELS[level - 1]:
                    count[text[: LEVELS[level]]] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.binary()), pa.array(list(count.values()), pa.int64())], ["path", "n"])

    return run


def _paths(heavy: list[frozenset[bytes]]):
    """(path, uid, body): the path is the shortest prefix that is not heavy."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = normalised(batch.column(1))
            paths = []
            for text in bodies:
                level = 0
                while level < len(heavy) and text[: LEVELS[level]] in heavy[level]:
                    level += 1
                paths.append(text[: LEVELS[level]] if level < len(LEVELS) else text)
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.binary()), batch.column(0), pa.array(bodies, pa.binary())], ["path", "uid", "body"])

    return run


def radix_groups(items: list[tuple[bytes, int]]) -> Iterator[list[int]]:
    """Ids of equal texts, found by splitting on successive bytes until a group is a singleton or has ended."""
    todo = [(items, 0)]
    while todo:
        group, depth = todo.pop()
        if len(group) == 1:
            yield [group[0][1]]
            continue
        low, high = min(group)[0], max(group)[0]
        if low == high:  # what lies between them is the same text: the group has ended
            yield [uid for _, uid in group]
            continue
        end = min(len(low), len(high))
        while depth < end and low[depth : depth + 256] == high[depth : depth + 256]:
            depth += 256
        depth = min(depth, end)
        while depth < end and low[depth] == high[depth]:
            depth += 1
        parts: dict[int, list] = defaultdict(list)
        for x in group:
            parts[x[0][depth] if depth < len(x[0]) else -1].append(x)
        todo += [(part, depth) for part in parts.values()]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by body, so those of a path follow each other; each path's rows are split by their further bytes.

    A path whose bodies exceed ``BUCKET_BYTES`` is split in several goes: all but the copies of the last body are
    settled, as no later body is equal to them.
    """
    path, rows, held = None, [], 0

    def flush(rows: list[tuple[bytes, int]]) -> pa.RecordBatch:
        rep, root = [], []
        for group in radix_groups(rows):
            rep += group
            root += [min(group)] * len(group)
        return pa.RecordBatch.from_arrays([pa.array(rep, pa.int64()), pa.array(root, pa.int64())], ["rep", "root"])

    for batch in batches:
        out = []
        for p, uid, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            if p != path:
                if rows:
                    out.append(flush(rows))
                path, rows, held = p, [], 0
            elif rows[-1][0] == body:
                body = rows[-1][0]  # copies share one object and cost no bytes
            elif held > BUCKET_BYTES:
                out.append(flush(rows))
                rows, held = [], 0
            held += 0 if rows and rows[-1][0] is body else len(body) + 100
            rows.append((body, uid))
        if out:
            yield pa.Table.from_batches(out).combine_chunks().to_batches()[0]
    if rows:
        yield flush(rows)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of docs in the struct ``row``, with uid, root (group), keep_id, group_size, kept and sha (binary).

    Of equal texts the row with the most code points in the original text stays, then the smallest id.
    """
    tagged, decided = _decide(docs, id_col, text_col)
    return tagged.join(decided, "rep").select("row", "uid", "root", "keep_id", "group_size", (F.col("uid") == F.col("keep_uid")).alias("kept"), "sha")


def _decide(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """All rows with uid and representative, and the decision on each representative's group."""
    spark = docs.sparkSession
    common.small_batches(spark)
    rows = docs.select(F.struct("*").alias("row"))
    schema = T.StructType([*rows.schema.fields, *(T.StructField(c, k) for c, k in (("uid", T.LongType()), ("rep", T.LongType()), ("n_cp", T.LongType()), ("sha", T.BinaryType()), ("path", T.BinaryType())))])
    tagged = common.written(rows.mapInArrow(_tag(text_col), schema), "tagged")
    reps = tagged.where("uid = rep")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # at most 4 * parts prefixes of a level can hold more than this, so what comes to the driver is bounded
    limit = max(1000, reps.count() // (4 * parts))
    heavy: list[frozenset[bytes]] = []
    found = reps.groupBy("path").count().where(F.col("count") > limit).select("path").collect()
    while found and len(heavy) < len(LEVELS) - 1:
        heavy.append(frozenset(bytes(r.path) for r in found))
        counts = reps.select(F.col(f"row.`{text_col}`").alias("text")).mapInArrow(_prefix_counts(len(heavy), heavy[-1]), "path binary, n long")
        found = counts.groupBy("path").agg(F.sum("n").alias("n")).where(F.col("n") > limit).select("path").collect()
    roots = (
        reps.select("uid", F.col(f"row.`{text_col}`").alias("text"))
        .mapInArrow(_paths(heavy), "path binary, uid long, body binary")
        .repartition("path")
        .sortWithinPartitions("body")
        .mapInArrow(_groups, "rep long, root long")
    )
    roots = common.written(roots, "roots")
    # best row of a group: by representative first, then by group; both aggregates combine before their shuffle
    best = F.min(F.struct((-F.col("n_cp")).alias("less"), F.col("id").isNull().alias("no_id"), "id", "uid")).alias("best")
    by_rep = tagged.select("uid", "rep", "n_cp", F.col(f"row.`{id_col}`").alias("id")).groupBy("rep").agg(best, F.count("*").alias("size"))
    by_root = by_rep.join(roots, "rep").groupBy("root").agg(F.min("best").alias("best"), F.sum("size").alias("size"))
    decided = roots.join(by_root, "root").select("rep", "root", F.col("best.id").alias("keep_id"), F.col("best.uid").alias("keep_uid"), F.col("size").alias("group_size"))
    return tagged, decided


def dedup_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row."""
    return exact_dedup(docs, id_col, text_col).select(
        F.col(f"row.`{id_col}`").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256")
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with the columns of docs."""
    tagged, decided = _decide(docs, id_col, text_col)
    # the few rows that go are written, so that the whole rows meet ids alone and are not shuffled
    gone = common.written(tagged.select("uid", "rep").join(decided.select("rep", "keep_uid"), "rep").where("uid <> keep_uid").select("uid"), "gone")
    return common.keyed_filter(tagged, gone, "uid", "left_anti").select("row.*")

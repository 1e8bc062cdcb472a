"""Near-duplicate groups by MinHash with tensored banding; every link is confirmed on full shingle sets.

Two small collections of sub-keys, each of ``BANDS`` groups of ``ROWS`` min-hashes, are made; every pair of a
first and a second sub-key is one table key. 2 * BANDS * ROWS = 60 min-hashes thus give 100 tables of 2 * ROWS = 6
rows each. A pair of Jaccard similarity s misses all tables with probability 2 * (1 - s^ROWS)^BANDS at most: 0.00015
at 0.85, 0.0015 at 0.8. One of 0.5 meets with probability 0.54, one of 0.3 with 0.06.

Stages: equal sets collapse to classes; classes that share a table key are linked to the smallest id of the
key (a star, never all pairs) and each link is verified; keys whose members are still in several components
afterwards are settled exactly: groups of such members are compared set by set, in blocks, inside tasks that
return spanning links only. Nothing is capped.

Defined cases: null or empty text, or white space alone, has an empty set and is linked with nothing; a text
of fewer than k words has its whole sequence as its one shingle; rows that repeat an id are one document; rows
without an id are left out; an empty table gives an empty result; further columns are ignored; ids must be numbers.
Very long texts are read whole; a set is held by one task at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .textkernel import U, lowered_words, mix, seeds, shingles, slices, text_buffers

ROWS, BANDS = 3, 10
#: Shingles of a block in the exact comparison of unsettled groups, and of the sets looked up at once.
BLOCK, CHUNK = 60_000, 1_000_000
_SEEDS = seeds(2 * ROWS * BANDS, 3)
_ODD = U(0x9E3779B97F4A7C15)


def row_sets(col: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    data, off = text_buffers(col)
    for _, _, b, o in slices(data, off):
        h, n = shingles(*_wc(b, o), k)
        end = np.cumsum(n)
        for i, m in zip((end - n).tolist(), n.tolist()):
            yield np.unique(h[i : i + m])


def _wc(b: np.ndarray, o: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    w, _, _, counts = lowered_words(b, o)
    return w, counts


def sub_keys(sets: list[np.ndarray]) -> np.ndarray:
    """For each non-empty set its 2 * BANDS sub-keys."""
    sizes = np.array([len(s) for s in sets])
    at = np.cumsum(sizes) - sizes
    h = np.concatenate(sets) if sets else np.zeros(0, U)
    low = np.empty((len(sets), len(_SEEDS)), U)
    for j, s in enumerate(_SEEDS):
        x = (h ^ s) * _ODD
        low[:, j] = np.minimum.reduceat(x ^ (x >> U(32)), at)
    out = np.zeros((len(sets), 2 * BANDS), U)
    for r in range(ROWS):
        out = mix(out * U(31) + low[:, r::ROWS] + U(r))
    return out


def _signatures(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            sets = list(row_sets(batch.column(1), k))
            n = np.array([len(s) for s in sets], np.int64)
            full = np.flatnonzero(n)
            d = np.zeros((len(n), 2), np.int64)
            keys: list[bytes | None] = [None] * len(n)
            for lo in range(0, len(full), 256):
                part = full[lo : lo + 256]
                own = [sets[i] for i in part]
                for i, s in zip(part, own):
                    d[i] = np.array([s.sum(dtype=U), mix(s).sum(dtype=U)], U).view(np.int64)
                for i, row in zip(part, sub_keys(own)):
                    keys[i] = row.tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n), pa.array(d[:, 0].copy()), pa.array(d[:, 1].copy()), pa.array(keys, pa.binary())], ["id", "n", "d1", "d2", "keys"])

    return run


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All BANDS * BANDS table keys of each class."""
    pair = seeds(BANDS * BANDS, 11).reshape(BANDS, BANDS)
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sub = np.frombuffer(b"".join(batch.column(1).to_pylist()), U).reshape(batch.num_rows, 2 * BANDS)
        key = mix(sub[:, :BANDS, None] * _ODD + mix(sub[:, None, BANDS:] + pair[None]))
        ids = np.repeat(batch.column(0).to_numpy(), BANDS * BANDS)
        yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1).view(np.int64)), pa.array(ids)], ["key", "id"])


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in row_sets(batch.column(1), k)], pa.binary())], ["id", "set"])

    return run


def similar(inter: int | np.ndarray, na: int | np.ndarray, nb: int | np.ndarray, percent: int):
    return 100 * inter >= percent * (na + nb - inter)


def _verify(percent: int):
    """(a, b, set_a, set_b) to the links that hold on the full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3)):
                p, q = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
                if not similar(min(len(p), len(q)), len(p), len(q), percent):
                    ok.append(False)
                    continue
                if len(p) > len(q):
                    p, q = q, p
                at = np.minimum(np.searchsorted(q, p), len(q) - 1)
                ok.append(bool(similar(int((q[at] == p).sum()), len(p), len(q), percent)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def spanning_links(ids: np.ndarray, comp: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that join the components of rows ``left`` and ``right`` (indexes) wherever any pair of them is similar."""
    size = np.array([len(s) for s in sets], np.int64)
    names, root = np.unique(comp, return_inverse=True)
    links = []
    for i in left.tolist():
        n = size[i]
        apart = right[(root[right] != root[i]) & similar(np.minimum(size[right], n), size[right], n, percent)]
        lo = 0
        while lo < len(apart):
            hi = lo + max(1, int(np.searchsorted(np.cumsum(size[apart[lo:]]), CHUNK, "right")))
            part = apart[lo:hi]
            lo = hi
            h = np.concatenate([sets[j] for j in part])
            hit = sets[i][np.minimum(np.searchsorted(sets[i], h), n - 1)] == h
            inter = np.add.reduceat(hit.astype(np.int64), np.cumsum(size[part]) - size[part])
            for j in part[similar(inter, n, size[part], percent)].tolist():
                if root[i] != root[j]:
                    root[root == root[j]] = root[i]
                    links.append((int(ids[i]), int(ids[j])))
            apart = np.concatenate([apart[:lo], apart[lo:][root[apart[lo:]] != root[i]]])
    return links


def _settle(percent: int):
    """One block of visitors (members outside the main component) against one block of members, compared exactly."""

    def run(table: pa.Table) -> pa.Table:
        t = table.combine_chunks()
        ids, comp = t["id"].to_numpy(), t["comp"].to_numpy()
        sets = [np.frombuffer(x, U) for x in t["set"].to_pylist()]
        guest = t["guest"].to_numpy(zero_copy_only=False).astype(bool)
        links = spanning_links(ids, comp, sets, np.flatnonzero(guest), np.flatnonzero(~guest), percent)
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    return run


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document; links have 100 * intersection >= percent * union."""
    common.small_batches(docs.sparkSession)
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text")).where("id IS NOT NULL")
    sig = common.written(base.mapInArrow(_signatures(k), "id long, n long, d1 long, d2 long, keys binary").dropDuplicates(["id"]), "sig")
    full = sig.where("n > 0")
    classes = full.groupBy("n", "d1", "d2").agg(F.min("id").alias("cls"))
    member = common.written(full.select("id", "n", "d1", "d2").join(classes, ["n", "d1", "d2"]).select("id", "cls"), "member")
    firsts = member.where("id = cls").select("id")
    keyed = full.select("id", "keys").join(firsts, "id").mapInArrow(_tables, "key long, id long")
    shared = keyed.groupBy("key").agg(F.min("id").alias("rep"), F.count("*").alias("size")).where("size > 1")
    bucket = common.written(keyed.join(shared, "key"), "bucket")

    # candidate links: to the smallest id of the key
    pairs = common.written(bucket.where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b")).distinct(), "pairs")
    party = common.written(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "party")
    sets = common.written(common.keyed_filter(base, party, "id").mapInArrow(_sets(k), "id long, set binary").dropDuplicates(["id"]), "sets")
    links = common.written(
        pairs.join(sets.selectExpr("id AS b", "set AS set_b"), "b").join(sets.selectExpr("id AS a", "set AS set_a"), "a").select("a", "b", "set_a", "set_b").mapInArrow(_verify(percent), "a long, b long"), "links"
    )
    label = common.components(links)

    # keys of three members or more that are not in one component: pairs there may be untested
    placed = bucket.where("size > 2").join(label, "id", "left").withColumn("comp", F.coalesce("label", "id"))
    mixed = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
    open_rows = common.written(placed.join(mixed, "key").select("id", "rep", "comp"), "open")
    if not open_rows.isEmpty():
        groups = common.components(open_rows.where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b")))
        members = common.written(open_rows.select("id", "comp").distinct().join(groups.withColumnRenamed("label", "grp"), "id"), "members")
        # of each group, all outside its largest component are held against all members, block by block
        members = common.written(members.join(sig.select("id", "n"), "id"), "sized")
        count = members.groupBy("grp", "comp").agg(F.count("*").alias("m"), F.sum("n").alias("n"))
        largest = count.groupBy("grp").agg(F.max_by("comp", F.struct("m", "comp")).alias("main"), F.sum("n").alias("all"), (F.sum("n") - F.max_by("n", F.struct("m", "comp"))).alias("rest"))
        rows = members.join(largest, "grp").withColumn("nb", F.ceil(F.col("all") / BLOCK).cast("int")).withColumn("ng", F.greatest(F.lit(1), F.ceil(F.col("rest") / BLOCK).cast("int")))
        own = rows.select("grp", F.expr("explode(sequence(0, ng - 1)) AS g"), F.expr("CAST(pmod(xxhash64(id), nb) AS int) AS block"), "id", "comp", F.lit(False).alias("guest"))
        visit = rows.where("comp <> main").select("grp", F.expr("CAST(pmod(xxhash64(id, 1), ng) AS int) AS g"), F.expr("explode(sequence(0, nb - 1)) AS block"), "id", "comp", F.lit(True).alias("guest"))
        blocks = own.union(visit).join(sets, "id")
        extra = blocks.groupBy("grp", "g", "block").applyInArrow(_settle(percent), "a long, b long")
        label = common.components(links.union(extra))
    group = member.join(label.withColumnRenamed("id", "cls"), "cls", "left").select("id", F.coalesce("label", "cls").alias("component_id"))
    return (
        sig.select("id", "n").join(group, "id", "left").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))
        .withColumn("kept", F.col("doc_id") == F.col("component_id"))
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """docs without the documents that are near copies of one with a smaller id; rows without an id stay."""
    gone = common.written(near_groups(docs, id_col, text_col, k, percent).where("NOT kept").select(F.col("doc_id").alias(id_col)), "gone")
    return common.keyed_filter(docs, gone, id_col, "left_anti").select(docs.columns)

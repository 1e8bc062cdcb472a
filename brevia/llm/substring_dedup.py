"""Near-duplicate passages by compact windows over token min-hashes.

Tokens are k-word shingles. For a hash function, the compact windows of a text are the nodes of the Cartesian
tree over its token hashes: the pivot with the least hash and the widest stretch around it where it stays the
least. Windows of at least ``t`` tokens stand for all passages of t tokens or more, each of which has exactly
one pivot per hash function. Only minimizers of t-token windows can be pivots of such windows, and the nearest
smaller hash of one is one too, so a sliding minimum and a stack over few candidates build the tree.

Windows are grouped by pivot token and one anchor token on its right or left, where the window reaches half a
passage that far: any passage of t tokens that two places share keeps one of the two sides. The anchor is itself a
min-hash, the least of the tokens ``NEAR`` to t / 2 places away, so that words put in or left out between pivot and
anchor change neither. Within a key, every window meets the first one (a star by a min aggregate and a join). What
the hash functions find between two texts is joined by intervals: each place is verified on the token sequences, where
tokens match within ``DRIFT`` places of the diagonal. Kept are the stretches of windows of t tokens whose similarity
(matches over all tokens of both sides) is at least ``least``; stretches that different hash functions or diagonals
found twice are one.

Windows that did not verify against the first one of their key are settled exactly: each is held against all
earlier windows of the key, in blocks of bounded size, on the tokens around the pivot, and joins the first that
has a passage over the pivot in common with it.

Very long texts are cut nowhere; a text's windows are linear in its length. Ids must be numbers. A passage of 46 to 49
equal words is found too: among windows of 50 words it has a similarity of 0.8.

Defined cases: null, empty and short texts have no passage; rows without an id are left out; rows that repeat
an id are one document; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .textkernel import U, lowered_words, mix, seeds, shingles, slices, text_buffers

HASHES = 3
_SEEDS = seeds(HASHES, 17)
_ANCHORS = seeds(HASHES, 19)
#: Tokens between pivot and anchor at least.
NEAR = 14
#: Tokens by which matches may leave the diagonal of two places.
DRIFT = 8
_STEPS = sorted(range(-DRIFT, DRIFT + 1), key=lambda d: (-abs(d), -d))
#: Windows of a key in one block when a key is settled.
BLOCK = 2_000
OUT = "doc_id long, start long, end long, first_doc_id long, first_start long, first_end long, similarity double"


def _tokens(b: np.ndarray, o: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    w, _, _, counts = lowered_words(b, o)
    h, n = shingles(w, counts, k)
    short = (counts > 0) & (counts < k)
    if short.any():
        h, n = h[~np.repeat(short, n)], np.where(short, 0, n)
    return h, n


def sliding_min(x: np.ndarray, t: int) -> np.ndarray:
    """Minimum of x[i:i+t] for every i, by doubling."""
    out, have = x, 1
    while have < t:
        step = min(have, t - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def compact_windows(x: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pivot, left, right end) of all compact windows of at least t tokens of one sequence; the leftmost of equals counts as smaller."""
    if len(x) < t:
        e = np.zeros(0, np.int64)
        return e, e, e
    low = sliding_min(x, t)
    # places that are the minimum of some t tokens around them
    pad = np.concatenate([np.zeros(t - 1, U), low, np.zeros(t - 1, U)])
    is_pivot = x <= _sliding_max(pad, t)[: len(x)]
    cand = np.flatnonzero(is_pivot)
    v = x[cand].tolist()
    left, right, stack = [0] * len(v), [0] * len(v), []
    c = cand.tolist()
    for i, y in enumerate(v):
        while stack and v[stack[-1]] > y:
            right[stack.pop()] = c[i]
        left[i] = c[stack[-1]] + 1 if stack else 0
        stack.append(i)
    for i in stack:
        right[i] = len(x)
    left, right = np.array(left, np.int64), np.array(right, np.int64)
    wide = right - left >= t
    return cand[wide], left[wide], right[wide]


def _sliding_max(x: np.ndarray, t: int) -> np.ndarray:
    out, have = x, 1
    while have < t:
        step = min(have, t - have)
        out = np.maximum(out[:-step], out[step:])
        have += step
    return out


def window_keys(h: np.ndarray, t: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(key, pivot, left, right end) of the windows of one token sequence under each hash function."""
    half = t // 2
    near = min(NEAR, half)
    for j, (s, r) in enumerate(zip(_SEEDS, _ANCHORS)):
        c, left, right = compact_windows(mix(h ^ s), t)
        if not len(c):
            continue
        # the least token of half - near + 1 places, by where they begin
        low = sliding_min(mix(h ^ r), half - near + 1)
        for side, begin, ok in ((1, c + near, c + half < right), (2, c - half, c - half >= left)):
            p, lo, hi = c[ok], left[ok], right[ok]
            key = mix(mix(h[p] + U(4 * j + side)) ^ low[begin[ok]])
            order = np.argsort(key, kind="stable")
            again = np.flatnonzero(key[order[1:]] == key[order[:-1]]) + 1 if len(order) else order
            if len(again):
                # text that repeats within itself: places closer than a passage to the one before give nothing new
                keep, hi = np.ones(len(p), bool), hi.copy()
                last = {}
                for i in np.sort(order[np.union1d(again, again - 1)]).tolist():
                    before = last.get(key[i])
                    if before is not None and p[i] - p[before] < t:
                        keep[i] = False
                        continue
                    if before is not None:
                        hi[before] = min(hi[before], p[i] + t)
                    last[key[i]] = i
                key, p, lo, hi = key[keep], p[keep], lo[keep], hi[keep]
            yield key, p, lo, hi


def _keys(k: int, t: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            data, off = text_buffers(batch.column(1))
            for lo, _, b, o in slices(data, off):
                h, n = _tokens(b, o, k)
                ends = np.cumsum(n)
                found, doc = [], []
                for r in np.flatnonzero(n >= t).tolist():
                    for x in window_keys(h[ends[r] - n[r] : ends[r]], t):
                        found.append(x)
                        doc.append(np.full(len(x[0]), ids[lo + r], np.int64))
                if found:
                    key, pos, left, right = (np.concatenate(x) for x in zip(*found))
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.concatenate(doc)), *(pa.array(x.astype(np.int32)) for x in (pos, left, right))], ["key", "doc", "pos", "lo", "hi"])

    return run


def _sequences(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = text_buffers(batch.column(1))
            seqs: list[bytes] = []
            for _, _, b, o in slices(data, off):
                h, n = _tokens(b, o, k)
                ends = np.cumsum(n)
                h32 = (h >> U(32)).astype("<u4")
                seqs += [h32[a:e].tobytes() for a, e in zip(ends - n, ends)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(seqs, pa.binary())], ["id", "seq"])

    return run


def drifts(a: np.ndarray, b: np.ndarray, shift: int, lo: int, hi: int) -> np.ndarray:
    """For each place of a[lo:hi] how far from place - shift its token is in b, the nearest within DRIFT; DRIFT + 1 without a match."""
    off = np.full(hi - lo, DRIFT + 1, np.int8)
    if lo >= shift and hi <= len(b) + shift and (a[lo:hi] == b[lo - shift : hi - shift]).all():
        off[:] = 0
        return off
    for d in _STEPS:  # the nearest writes last
        x, y = max(lo, shift + d), min(hi, len(b) + shift + d)
        if x < y:
            np.copyto(off[x - lo : y - lo], d, where=a[x:y] == b[x - shift - d : y - shift - d])
    return off


def good_windows(off: np.ndarray, t: int, least: float) -> np.ndarray:
    """Whether each window of t places (last axis) is similar: matches over the tokens of both sides, of which the other has t at least."""
    match = off <= DRIFT
    n = off.shape[-1]
    c = np.concatenate([np.zeros((*off.shape[:-1], 1), np.int64), np.cumsum(match, -1)], -1)
    inter = c[..., t:] - c[..., :-t]
    place = np.arange(n)
    # places on the other side of the first and the last match of each window
    after = np.minimum.accumulate(np.where(match, place, n - 1)[..., ::-1], -1)[..., ::-1][..., : n - t + 1]
    before = np.maximum.accumulate(np.where(match, place, 0), -1)[..., t - 1 :]
    q = place - np.where(match, off, np.int8(0))
    span = np.take_along_axis(q, before, -1) - np.take_along_axis(q, after, -1) + 1
    return inter >= least * (t + np.maximum(span, t) - inter)


def similar_spans(a: np.ndarray, b: np.ndarray, shift: int, t: int, least: float, lo: int = 0, hi: int = 1 << 60) -> list[tuple[int, int, int, int, float]]:
    """(start, end, start in b, end in b, similarity) of the stretches of a[lo:hi] where windows of t tokens match b near place - shift."""
    lo, hi = max(lo, shift - DRIFT, 0), min(hi, len(a), len(b) + shift + DRIFT)
    if hi - lo < t:
        return []
    off = drifts(a, b, shift, lo, hi)
    match = off <= DRIFT
    if match.sum() < least * t:
        return []
    good = np.flatnonzero(good_windows(off, t, least))
    c = np.concatenate([[0], np.cumsum(match)])
    spans = []
    if len(good):
        for run in np.split(good, np.flatnonzero(np.diff(good) > t) + 1):
            start, end = int(run[0]), int(run[-1]) + t
            while not match[start]:
                start += 1
            while not match[end - 1]:
                end -= 1
            first, last = lo + start - shift - int(off[start]), lo + end - shift - int(off[end - 1])
            n = int(c[end] - c[start])
            spans.append((lo + start, lo + end, first, last, n / (end - start + max(last - first, n) - n)))
    return spans


def pair_spans(a: np.ndarray, b: np.ndarray, runs: list[tuple[int, int, int]], t: int, least: float) -> list[tuple[int, int, int, int, float]]:
    """The spans of all candidate (shift, lo, hi) of two texts, each stretch once."""
    # intervals that overlap, on diagonals that one verification sees, are one
    joined: list[list[int]] = []
    for lo, hi, shift in sorted({(lo, hi, shift) for shift, lo, hi in runs}):
        same = next((x for x in joined if abs(x[0] - shift) <= DRIFT // 2 and lo <= x[2]), None)
        if same is None:
            joined.append([shift, lo, hi])
        else:
            same[2] = max(same[2], hi)
    spans: list[tuple[int, int, int, int, float]] = []

    def holds(x: tuple, start: int, end: int, shift: int) -> bool:
        return x[0] <= start and end <= x[1] and abs(x[0] - x[2] - shift) <= 2 * DRIFT

    for shift, lo, hi in sorted(joined, key=lambda r: r[1] - r[2]):
        if any(holds(x, lo, hi, shift) for x in spans):
            continue
        for new in similar_spans(a, b, shift, t, least, lo, hi):
            if not any(holds(x, new[0], new[1], new[0] - new[2]) for x in spans):
                spans = [x for x in spans if not holds(new, x[0], x[1], x[0] - x[2])] + [new]
    return sorted(spans)


def _verify(k: int, t: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            doc, first, runs = (batch.column(i).to_pylist() for i in range(3))
            for i in range(batch.num_rows):
                a, b = (np.frombuffer(batch.column(j)[i].as_buffer(), "<u4") for j in (3, 4))
                for start, end, other, stop, sim in pair_spans(a, b, [(r["shift"], r["lo"], r["hi"]) for r in runs[i]], t, least):
                    rows.append((doc[i], start, end + k - 1, first[i], other, stop + k - 1, sim))
            c = list(zip(*rows)) or [()] * 7
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in c[:6]), pa.array(c[6], pa.float64())], [f.split()[0] for f in OUT.split(", ")])

    return run


MEMBER = "key long, doc long, pos int, open boolean, own_lo int, own_hi int, lo int, hi int, around binary"


def _around(k: int, t: int):
    """(doc, members, sequence) to one row per member: the 2t - 1 tokens around its pivot, and the first and last place there where a window of t tokens may start (own_lo, own_hi: within its compact window; lo, hi: within the text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, (doc, members) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                h = np.frombuffer(batch.column(2)[i].as_buffer(), "<u4")
                wide = np.concatenate([np.zeros(t - 1, "<u4"), h, np.zeros(t - 1, "<u4")])
                for m in members:
                    p = m["pos"]
                    rows.append((m["key"], doc, p, m["open"], max(m["lo"] - p + t - 1, 0), min(m["hi"] - p - 1, t - 1), max(t - 1 - p, 0), min(len(h) - p - 1, t - 1), wide[p : p + 2 * t - 1].tobytes()))
            c = list(zip(*rows)) or [()] * 9
            yield pa.RecordBatch.from_arrays(
                [pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.int32()), pa.array(c[3], pa.bool_()), *(pa.array(x, pa.int32()) for x in c[4:8]), pa.array(c[8], pa.binary())],
                ["key", "doc", "pos", "open", "own_lo", "own_hi", "lo", "hi", "around"],
            )

    return run


def first_partners(doc: np.ndarray, pos: np.ndarray, around: np.ndarray, own: np.ndarray, bounds: np.ndarray, guests: np.ndarray, homes: np.ndarray, t: int, least: float) -> list[tuple[int, int]]:
    """(guest, home) indexes: for each guest the first earlier home with a similar window of t tokens over both pivots, if any."""
    homes = homes[np.lexsort((pos[homes], doc[homes]))]
    found = []
    starts, width = np.arange(t), 2 * t - 1
    d, p = doc[homes], pos[homes]
    for g in guests.tolist():
        earlier = homes[(d < doc[g]) | ((d == doc[g]) & (p <= pos[g] - t))]
        for lo in range(0, len(earlier), 256):
            part = earlier[lo : lo + 256]
            off = np.full((len(part), width), DRIFT + 1, np.int8)
            theirs, ours = around[part], around[g]
            for step in _STEPS:
                x, y = max(0, step), min(width, width + step)
                np.copyto(off[:, x:y], step, where=theirs[:, x - step : y - step] == ours[x:y])
            likely = (off <= DRIFT).sum(1) >= least * t
            part, off = part[likely], off[likely]
            if not len(part):
                continue
            first, last = np.maximum(bounds[part, 0] - DRIFT, own[g, 0]), np.minimum(bounds[part, 1] + DRIFT, own[g, 1])
            good = (good_windows(off, t, least) & (starts >= first[:, None]) & (starts <= last[:, None])).any(1)
            if good.any():
                found.append((g, int(part[good.argmax()])))
                break
    return found


def _settle(t: int, least: float):
    """Blocks of open windows (guests) against blocks of windows, key by key."""

    def run(table: pa.Table) -> pa.Table:
        x = table.combine_chunks()
        key, doc, pos, *ends = (x[c].to_numpy() for c in ("key", "doc", "pos", "own_lo", "own_hi", "lo", "hi"))
        guest = x["guest"].to_numpy(zero_copy_only=False).astype(bool)
        around = np.frombuffer(b"".join(x["around"].to_pylist()), "<u4").reshape(len(key), 2 * t - 1)
        own, bounds = np.stack(ends[:2], 1), np.stack(ends[2:], 1)
        order = np.argsort(key, kind="stable")
        found = []
        for part in np.split(order, np.flatnonzero(np.diff(key[order])) + 1):
            found += first_partners(doc, pos, around, own, bounds, part[guest[part]], part[~guest[part]], t, least)
        i, j = (np.array(c, np.int64) for c in (list(zip(*found)) or [(), ()]))
        return pa.table({"key": pa.array(key[i]), "doc": pa.array(doc[i]), "pos": pa.array(pos[i]), "to_doc": pa.array(doc[j]), "to_pos": pa.array(pos[j])})

    return run


def _more_runs(members: DataFrame, verified: DataFrame, pairs: DataFrame, seqs: DataFrame, k: int, t: int, least: float) -> DataFrame | None:
    """Candidates of the windows that did not verify against the first of their key, with the first window that they do match; None if all did."""
    held = verified.selectExpr("doc_id AS doc", "first_doc_id AS first_doc", "start - first_start AS shift", "start", f"end - {k - 1} AS stop")
    spans = F.broadcast(held) if held.count() <= common.BROADCAST_IDS // 16 else held
    m = members.where("n > 2").withColumn("shift", F.expr("CAST(pos - first_pos AS long)")).alias("m")
    inside = f"m.doc = h.doc AND m.first_doc = h.first_doc AND abs(m.shift - h.shift) <= {2 * DRIFT} AND m.pos >= h.start AND m.pos < h.stop"
    missed = m.join(spans.alias("h"), F.expr(inside), "left_anti")
    missed = common.written(missed.where(f"doc <> first_doc OR pos - first_pos >= {t}").select("key", "doc", "pos"), "missed")
    if missed.isEmpty():
        return None
    rows = members.join(missed.select("key").distinct(), "key").where("doc <> first_doc OR pos <> first_pos").join(missed.withColumn("open", F.lit(True)), ["key", "doc", "pos"], "left")
    of_doc = rows.groupBy("doc").agg(F.collect_list(F.struct("key", "pos", "lo", "hi", F.coalesce("open", F.lit(False)).alias("open"))).alias("members"))
    near = common.written(of_doc.join(seqs.withColumnRenamed("id", "doc"), "doc").select("doc", "members", "seq").mapInArrow(_around(k, t), MEMBER), "around")
    size = near.groupBy("key").agg(F.count("*").alias("m"), F.count_if("open").alias("o"))
    n = max(1, -(-near.count() // BLOCK))
    # small keys share a block by their hash; in larger ones every block of open windows meets every block of windows
    sized = near.join(size, "key").where("m > 1").withColumn("nb", F.expr(f"CAST(ceil(m / {BLOCK}) AS int)")).withColumn("ng", F.expr(f"CAST(ceil(o / {BLOCK}) AS int)"))
    sized = sized.withColumn("grp", F.expr(f"CASE WHEN m <= {BLOCK} THEN pmod(xxhash64(key), {n}) ELSE key END")).withColumn("large", F.expr(f"m > {BLOCK}"))
    cols = ["key", "doc", "pos", "own_lo", "own_hi", "lo", "hi", "around", "large", "grp"]
    homes = sized.select(*cols, F.expr("explode(sequence(0, ng - 1)) AS g"), F.expr("CAST(pmod(xxhash64(doc, pos), nb) AS int) AS block"), F.lit(False).alias("guest"))
    guests = sized.where("open").select(*cols, F.expr("CAST(pmod(xxhash64(doc, pos, 1), ng) AS int) AS g"), F.expr("explode(sequence(0, nb - 1)) AS block"), F.lit(True).alias("guest"))
    links = homes.union(guests).groupBy("large", "grp", "g", "block").applyInArrow(_settle(t, least), "key long, doc long, pos int, to_doc long, to_pos int")
    first = links.groupBy("key", "doc", "pos").agg(F.min(F.struct("to_doc", "to_pos")).alias("to"))
    ends = near.select("key", "doc", "pos", F.expr(f"pos + own_lo - {t - 1} AS lo"), F.expr("pos + own_hi + 1 AS hi"))
    runs = F.collect_list(F.struct(F.expr("CAST(pos - to.to_pos AS int) AS shift"), "lo", "hi"))
    more = first.join(ends, ["key", "doc", "pos"]).groupBy("doc", F.col("to.to_doc").alias("first_doc")).agg(runs.alias("more"))
    # what the stars had found between the same texts is verified once more, with the new places
    return common.written(more.join(pairs, ["doc", "first_doc"], "left").select("doc", "first_doc", F.expr("CASE WHEN runs IS NULL THEN more ELSE concat(runs, more) END AS runs")), "more")


def repeated_passages(docs: DataFrame, words: int = 50, k: int = 5, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per verified passage of at least ``words`` words that an earlier place has too: doc_id, start, end (words), first_doc_id, first_start, similarity."""
    common.small_batches(docs.sparkSession)
    t = words - k + 1
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text")).where("id IS NOT NULL")
    # written: both the firsts and the members read it, and the windows cost more than the table
    keys = common.written(base.mapInArrow(_keys(k, t), "key long, doc long, pos int, lo int, hi int"), "windows")
    firsts = keys.groupBy("key").agg(F.min(F.struct("doc", "pos")).alias("first"), F.count("*").alias("n")).where("n > 1").select("key", "n", F.col("first.doc").alias("first_doc"), F.col("first.pos").alias("first_pos"))
    members = common.written(keys.join(firsts, "key"), "members")
    common.drop(keys)
    runs = F.collect_list(F.struct(F.expr("CAST(pos - first_pos AS int) AS shift"), "lo", "hi"))
    pairs = common.written(members.where(f"doc <> first_doc OR pos - first_pos >= {t}").groupBy("doc", "first_doc").agg(runs.alias("runs")), "runs")
    party = common.written(pairs.select(F.explode(F.array("doc", "first_doc")).alias("id")).distinct(), "party")
    seqs = common.written(common.keyed_filter(base, party, "id").mapInArrow(_sequences(k), "id long, seq binary").dropDuplicates(["id"]), "seqs")

    def verify(some: DataFrame) -> DataFrame:
        both = some.join(seqs.selectExpr("id AS doc", "seq AS a"), "doc").join(seqs.selectExpr("id AS first_doc", "seq AS b"), "first_doc")
        return both.select("doc", "first_doc", "runs", "a", "b").mapInArrow(_verify(k, t, least), OUT)

    verified = common.written(verify(pairs), "verified")
    more = _more_runs(members, verified, pairs, seqs, k, t, least)
    if more is None:
        return verified
    again = more.selectExpr("doc AS doc_id", "first_doc AS first_doc_id")
    return verified.join(again, ["doc_id", "first_doc_id"], "left_anti").select(verified.columns).union(verify(more))

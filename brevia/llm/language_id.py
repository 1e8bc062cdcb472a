"""Language of whole texts: scripts narrow the candidates, Viterbi with a switching penalty labels spans of words.

Training counts hashed byte n-grams (2 to 4, with word borders) by language over labelled rows, at most about
``SAMPLE`` of them, chosen by a hash of their id. A word's score for a language is its mean log-likelihood ratio
to the average of the languages, cut at ``CLIP``; a language that has (nearly) no letters of the word's script in training is no
candidate. The best path over a text's words, where each change of language costs ``SWITCH``, gives spans; the
prediction is the language with most letters (bytes of words with letters), its share is the score.

Most texts have one language: where no stretch of words gains more than the penalty even if each word takes its
best other language, the best path is constant, which numpy passes decide; other texts get the full dynamic programme.

Defined cases: null text and text without a letter give ``und`` and 0; if nothing was learned, every text gives
``und``; repeated rows are predicted each; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .textkernel import SPACE, U, segments, slices, text_buffers

#: Labelled rows used for training at most, about.
SAMPLE = 20_000
ORDERS, BITS = (2, 3, 4), 17
CLIP, SWITCH = 4.0, 12.0
#: Bytes of text handled at once: n-grams take many times their size.
SLICE = 1 << 17
UNKNOWN = "und"
#: Script of a letter by the first byte of its UTF-8 form; 0 stands for ``other``.
# Ranges of lead bytes.
SCRIPTS = (
    ("latin", ((0x41, 0x5A), (0x61, 0x7A), (0xC3, 0xC9))), ("greek", ((0xCD, 0xCF),)), ("cyrillic", ((0xD0, 0xD4),)), ("hebrew", ((0xD6, 0xD7),)),
    ("arabic", ((0xD8, 0xDB),)), ("indic", ((0xE0, 0xE0),)), ("other3", ((0xE1, 0xE1),)), ("kana_cjk", ((0xE3, 0xE9),)), ("hangul", ((0xEA, 0xED),)), ("other", ()),
)
SCRIPT = np.zeros(256, np.int8)
for _i, (_, _ranges) in enumerate(SCRIPTS):
    for _lo, _hi in _ranges:
        SCRIPT[_lo : _hi + 1] = _i + 1
SCRIPT[SCRIPT == 0] = len(SCRIPTS)
#: Letters: code points of a category L*.
LETTER = np.array([unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)])


def folded(data: np.ndarray) -> np.ndarray:
    """Bytes with ASCII and Latin-1 capitals in lower case."""
    out = data.copy()
    out[(out >= 65) & (out <= 90)] |= 32
    if len(out) > 1:
        after = np.flatnonzero((out[:-1] == 0xC3) & (out[1:] >= 0x80) & (out[1:] <= 0x9E) & (out[1:] != 0x97)) + 1
        out[after] |= 32
    return out


def grams(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of every n-gram, its word); a word has one border sign at either end."""
    size = stop - start + 2
    ends = np.cumsum(size)
    first = ends - size
    flat = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint32)
    inside = np.ones(len(flat), bool)
    inside[first], inside[ends - 1] = False, False
    flat[inside] = data[np.arange(int((stop - start).sum())) + np.repeat(start - (np.cumsum(stop - start) - (stop - start)), stop - start)]
    word = np.repeat(np.arange(len(start)), size)
    buckets, words = [], []
    for n in ORDERS:
        if len(flat) < n:
            continue
        x = np.zeros(len(flat) - n + 1, np.uint64)
        for i in range(n):
            x = x * U(257) + flat[i : len(flat) - n + 1 + i].astype(U) + U(1)
        same = word[: len(x)] == word[n - 1 :]
        x = ((x + U(n << 40)) * U(0x9E3779B97F4A7C15)) >> U(64 - BITS)
        buckets.append(x[same].astype(np.int64))
        words.append(word[: len(x)][same])
    if not buckets:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(buckets), np.concatenate(words)


def letter_places(data: np.ndarray) -> np.ndarray:
    """Places of the first bytes of letters in UTF-8."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    lead = data[at].astype(np.int64)
    more = (lead >= 0xC0).astype(np.int64) + (lead >= 0xE0) + (lead >= 0xF0)
    point = np.where(more == 0, lead, lead & (0x3F >> more))
    for i in (1, 2, 3):
        on = np.flatnonzero(more >= i)
        point[on] = point[on] << 6 | data[np.minimum(at[on] + i, len(data) - 1)] & 0x3F
    return at[LETTER[np.minimum(point, len(LETTER) - 1)]]


def scripts_of(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Script of each word: the one of its first letter, 0 if it has none."""
    letters = letter_places(data)
    k = np.searchsorted(letters, start)
    at = letters[np.minimum(k, max(len(letters) - 1, 0))] if len(letters) else np.zeros(len(start), np.int64)
    return np.where((k < len(letters)) & (at < stop), SCRIPT[data[at]] if len(data) else 0, 0)


@dataclass
class Model:
    languages: list[str]
    score: np.ndarray  # buckets x languages, log-likelihood ratios to the mean of the languages
    allowed: np.ndarray  # scripts x languages

    def words(self, data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(scores of each word by language, whether it has a letter)."""
        script = scripts_of(data, start, stop)
        lettered = np.flatnonzero(script)
        out = np.zeros((len(start), len(self.languages)))
        bucket, word = grams(data, start[lettered], stop[lettered])
        n = np.bincount(word, minlength=len(lettered)).astype(float)
        for k in range(len(self.languages)):
            out[lettered, k] = np.bincount(word, self.score[bucket, k], len(lettered)) / np.maximum(n, 1) * len(ORDERS)
        out = np.clip(out - out.max(1, keepdims=True, initial=-1e9), -CLIP, 0) if len(out) else out
        out[~self.allowed[script]] = -3 * CLIP
        return out, script > 0


def best_path(score: np.ndarray, switch: float) -> np.ndarray:
    """Language of each word on the best path."""
    n, k = score.shape
    back = np.zeros((n, k), np.int8)
    value = score[0].tolist()
    for t in range(1, n):
        top = max(range(k), key=value.__getitem__)
        jump = value[top] - switch
        row = score[t].tolist()
        for j in range(k):
            if value[j] >= jump:
                back[t, j] = j
                row[j] += value[j]
            else:
                back[t, j] = top
                row[j] += jump
        value = row
    path = np.empty(n, np.int8)
    path[-1] = max(range(k), key=value.__getitem__)
    for t in range(n - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path


def label_rows(model: Model, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray | None], tuple]:
    """(language index or -1, score, path of mixed rows, words) of each row."""
    data = folded(data)
    start, stop, counts = segments(data, offsets, SPACE)
    score, lettered = model.words(data, start, stop)
    rows = len(counts)
    ends = np.cumsum(counts)
    first = ends - counts
    weight = np.where(lettered, stop - start, 0).astype(float)
    row = np.repeat(np.arange(rows), counts)
    letters = np.bincount(row, weight, rows)
    total = np.stack([np.bincount(row, score[:, k], rows) for k in range(score.shape[1])], 1) if rows else np.zeros((0, score.shape[1]))
    main = total.argmax(1)
    mixed = np.zeros(rows, bool)
    full = np.flatnonzero(counts)
    if len(full) and score.shape[1] > 1:
        # gain of every stretch of words if each takes the best other language, which no path can exceed; rows are kept apart by a large step down
        apart = row * -1e7
        own = main[row]
        rest = score.copy()
        rest[np.arange(len(row)), own] = -np.inf
        step = np.maximum(rest.max(1), score.min() - 1e3) - score[np.arange(len(row)), own]
        c = np.cumsum(step)
        base = np.where(first[row] > 0, c[np.maximum(first[row] - 1, 0)], 0.0)
        after = c - base
        before = np.concatenate([[0.0], after[:-1]])
        before[first[full]] = 0.0
        gain = after - (np.minimum.accumulate(before + apart) - apart)
        mixed[full] = np.maximum.reduceat(gain, first[full]) > SWITCH
    lang, share = np.where(letters > 0, main, -1), (letters > 0).astype(float)
    paths: list[np.ndarray | None] = [None] * rows
    for r in np.flatnonzero(mixed & (letters > 0)):
        own = slice(first[r], ends[r])
        paths[r] = path = best_path(score[own], SWITCH)
        by = np.bincount(path, weight[own], score.shape[1])
        lang[r], share[r] = by.argmax(), by.max() / letters[r]
    return lang, share, paths, (start, stop, counts)


def _count(languages: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(languages), (1 << BITS) + len(SCRIPTS) + 1), np.int64)
        for batch in batches:
            lang = np.array([languages.index(x) for x in batch.column(1).to_pylist()])
            data, off = text_buffers(batch.column(0))
            for lo, hi, b, o in slices(data, off, SLICE):
                b = folded(b)
                start, stop, counts = segments(b, o, SPACE)
                of = np.repeat(lang[lo:hi], counts)
                script = scripts_of(b, start, stop)
                bucket, word = grams(b, start[script > 0], stop[script > 0])
                which = of[script > 0][word]
                for k in range(len(languages)):
                    total[k, : 1 << BITS] += np.bincount(bucket[which == k], minlength=1 << BITS)
                    total[k, 1 << BITS :] += np.bincount(script[of == k], minlength=len(SCRIPTS) + 1)
        k, at = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(total[k, at])], ["k", "at", "n"])

    return run


def fit(labelled: DataFrame, sample: int = SAMPLE) -> Model | None:
    """A model from (id, text, lang) rows without nulls; what comes to the driver has a fixed bound per language."""
    common.small_batches(labelled.sparkSession)
    per_lang = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    languages = sorted(per_lang)
    if not languages:
        return None
    share = min(1.0, sample / sum(per_lang.values()))
    some = labelled.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(share * 1_000_000) + 1)
    found = some.select("text", "lang").mapInArrow(_count(languages), "k int, at int, n long").groupBy("k", "at").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros((len(languages), (1 << BITS) + len(SCRIPTS) + 1))
    total[found["k"].to_numpy(), found["at"].to_numpy()] = found["n"].to_numpy()
    n, script = total[:, : 1 << BITS], total[:, 1 << BITS :]
    p = np.log((n + 0.5) / (n.sum(1, keepdims=True) + 0.5 * (1 << BITS)))
    allowed = (script >= 0.001 * np.maximum(script.sum(1, keepdims=True), 1)).T
    allowed |= ~allowed.any(1, keepdims=True)
    allowed[0] = True
    return Model(languages, (p - p.mean(0)).T.astype(np.float32).copy(), allowed)


def _predict(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows)
            if model is not None:
                data, off = text_buffers(batch.column(1))
                for lo, hi, b, o in slices(data, off, SLICE):
                    lang, share, _, _ = label_rows(model, b, o)
                    names[lo:hi] = [model.languages[k] if k >= 0 else UNKNOWN for k in lang.tolist()]
                    scores[lo:hi] = share
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    return run


def training_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Labelled rows that are not held out (crc32 of the id as text, modulo 4, is not 2)."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang"))
    return rows.where("text IS NOT NULL AND lang IS NOT NULL AND coalesce(crc32(CAST(id AS string)) % 4, 0) <> 2")


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every row."""
    common.small_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(_predict(model), "doc_id long, lang_pred string, score double")


def language_report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    found = predict(docs, fit(training_rows(docs)))
    return found.select("doc_id", F.expr("coalesce(crc32(CAST(doc_id AS string)) % 4 = 2, false)").alias("held_out"), "lang_pred", "score")


def _identified(model: Model | None, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep: list[bool] = []
            data, off = text_buffers(batch.column(at))
            for _, _, b, o in slices(data, off, SLICE):
                keep += [False] * (len(o) - 1) if model is None else (label_rows(model, b, o)[0] >= 0).tolist()
            yield batch.filter(pa.array(keep, pa.bool_()))

    return run


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows, with all their columns, whose language is not ``und``; learned from the labelled rows among them."""
    model = fit(training_rows(docs, id_col, text_col, lang_col))
    return docs.mapInArrow(_identified(model, docs.columns.index(text_col)), docs.schema)

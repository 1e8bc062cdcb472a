"""Exact token ids of whole texts through the tokenizers library, with each distinct chunk encoded once per worker.

A text is cut only where the tokenizer itself always cuts, so the ids of the chunks joined are the ids of the
text. For the byte-level vocabulary a chunk is a run of white space and the word after it (its pattern never
joins a word to the white space that follows); for the word vocabulary it is a word. Rows with white space
outside ASCII are encoded whole by the library.

A word vocabulary that lower-cases and splits by ``PIECES`` is cut further: a word of ASCII and of the letters U+00C0
to U+024F, without ``'`` and ``<`` (contractions, special strings), is cut into its letter runs, single digits and runs
of other signs, with A-Z lower-cased. Each of them is one piece to the library, and the last token of a piece, and no
other, has the vocabulary's end mark; so unknown pieces go to the library as one text and its ids are dealt by the marks.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable

import numpy as np

from .textkernel import LOWER, SPACE, HashIndex, hashes, ragged, segments

#: Distinct chunks that a worker remembers; beyond it the memory starts anew (ids don't depend on it).
REMEMBERED = 600_000
#: Unknown pieces in a text that goes to the library.
JOINED = 20_000
_loaded: dict[tuple, object] = {}

#: Pattern and normalisers of the vocabularies whose words are cut into pieces.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALISERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_LETTER, _DIGIT, _SIGN = 1, 2, 3
_CLASS = np.full(256, _SIGN, np.uint8)
_CLASS[SPACE] = 0
_CLASS[[*range(65, 91), *range(97, 123), *range(0x80, 0x100)]] = _LETTER
_CLASS[48:58] = _DIGIT
#: 1: a word with this byte stays whole; 2: with this byte and some after it (U+00D7, U+00F7 are signs, U+0130 grows in lower case).
_WHOLE = np.zeros(256, np.uint8)
_WHOLE[[0x27, 0x3C, 0xC0, 0xC1, 0xC2, *range(0xCA, 0x100)]] = 1
_WHOLE[[0xC3, 0xC4]] = 2


def pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes with A-Z lower-cased in words that are cut, start and end of pieces, which are whole words, pieces of each row."""
    n = len(data)
    if n == 0:
        e = np.zeros(0, np.int64)
        return data, e, e, np.zeros(0, bool), np.zeros(len(offsets) - 1, np.int64)
    kind = _CLASS[data]
    cut = np.empty(n + 1, bool)
    cut[1:n] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
    cut[offsets] = True
    low = LOWER[data]
    mark = _WHOLE[data]
    odd = np.flatnonzero(mark)
    after = data[np.minimum(odd + 1, n - 1)]
    lead = data[odd]
    odd = odd[(mark[odd] == 1) | (lead == 0xC3) & ((after == 0x97) | (after == 0xB7)) | (lead == 0xC4) & (after == 0xB0)]
    if len(odd):
        first, end, _ = segments(data, offsets)
        w = np.unique(np.searchsorted(first, odd, "right") - 1)
        first, size = first[w], end[w] - first[w]
        cut[ragged(first + 1, size - 1)] = False
        inside = ragged(first, size)
        low[inside] = data[inside]
    at = np.flatnonzero(cut)
    word = np.flatnonzero(kind[at[:-1]])
    start, stop = at[word], at[word + 1]
    whole = np.zeros(len(start), bool)
    if len(odd):
        whole[np.searchsorted(start, first)] = True
    return low, start, stop, whole, np.diff(np.searchsorted(start, offsets))


class ChunkIds:
    """Ids of chunks by hash; ``encode`` maps chunks, and which of them may not be joined, to all ids and the ids of each. Entry 0 is the end id."""

    def __init__(self, encode: Callable[[list[bytes], np.ndarray], tuple[np.ndarray, np.ndarray]], end_id: int) -> None:
        self.encode, self.end_id = encode, end_id
        self.reset()

    def reset(self) -> None:
        self.index = HashIndex()
        self.index.add(np.zeros(1, np.uint64))
        self.start, self.size = np.zeros(1, np.int64), np.ones(1, np.int64)
        self.pool = np.array([self.end_id], np.int32)

    def entries(self, data: np.ndarray, start: np.ndarray, stop: np.ndarray, whole: np.ndarray) -> np.ndarray:
        if self.index.n > REMEMBERED:
            self.reset()
        h = hashes(data, start, stop)
        found = self.index.get(h)
        miss = np.flatnonzero(found < 0)
        if len(miss):
            new, first = np.unique(h[miss], return_index=True)
            raw = data.tobytes()
            at = miss[first]
            ids, size = self.encode([raw[a:b] for a, b in zip(start[at].tolist(), stop[at].tolist())], whole[at])
            self.start = np.concatenate([self.start, len(self.pool) + np.cumsum(size) - size])
            self.size = np.concatenate([self.size, size])
            self.pool = np.concatenate([self.pool, ids])
            self.index.add(new)
            found[miss] = self.index.get(h[miss])
        return found


def _odd_space(data: np.ndarray) -> np.ndarray:
    """Positions of white space outside ASCII (U+0085, A0, 1680, 2000-200A, 2028, 2029, 202F, 205F, 3000) in UTF-8."""
    if len(data) < 2 or not (data > 0x7F).any():
        return np.zeros(0, np.int64)
    b = np.concatenate([data[1:], [0]])
    c = np.concatenate([data[2:], [0, 0]])
    hit = (data == 0xC2) & ((b == 0x85) | (b == 0xA0)) | (data == 0xE1) & (b == 0x9A) & (c == 0x80)
    hit |= (data == 0xE2) & ((b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF)) | (b == 0x81) & (c == 0x9F))
    return np.flatnonzero(hit | (data == 0xE3) & (b == 0x80) & (c == 0x80))


def _end_marks(tok) -> np.ndarray | None:
    """By token id, whether it ends a piece; None for a vocabulary whose words can't be cut into pieces."""
    spec = json.loads(tok.to_str())
    normal, split, suffix = spec["normalizer"] or {}, spec["pre_tokenizer"] or {}, spec["model"].get("end_of_word_suffix")
    first, *rest = split.get("pretokenizers") or [{}]
    if (
        normal.get("normalizers") != NORMALISERS
        or first != {"type": "Split", "pattern": {"Regex": PIECES}, "behavior": "Removed", "invert": True}
        or rest != [{"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]
        or not all("<" in t["content"] for t in spec["added_tokens"])
        or not suffix
    ):
        return None
    marked = {w: i for w, i in spec["model"]["vocab"].items() if w.endswith(suffix)}
    if sum(len(w) == len(suffix) + 1 for w in marked) < 256:  # a piece that ends in an unmarked byte would lose its end
        return None
    ends = np.zeros(tok.get_vocab_size(), bool)
    ends[list(marked.values())] = True
    return ends


class TextEncoder:
    """Ids of rows of text, each with the end id after it."""

    def __init__(self, path: str, end_id: int, joins_space: bool) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        self.batch = getattr(tok, "encode_batch_fast", tok.encode_batch)
        self.joins_space = joins_space
        self.ends = None if joins_space else _end_marks(tok)
        self.chunks = ChunkIds(self._ids, end_id)

    def _ids(self, chunks: list[bytes], whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the chunks, and the ids of each."""
        size, out = np.empty(len(chunks), np.int64), []
        order = [np.flatnonzero(~whole), np.flatnonzero(whole)]
        for lo in range(0, len(order[0]), JOINED):
            some = order[0][lo : lo + JOINED]
            ids = np.array(self.batch([b" ".join([chunks[i] for i in some.tolist()]).decode()], add_special_tokens=False)[0].ids, np.int32)
            last = np.flatnonzero(self.ends[ids])
            if len(last) != len(some):
                raise ValueError("the vocabulary does not mark the ends of pieces")
            size[some] = np.diff(last, prepend=-1)
            out.append(ids)
        each = [e.ids for e in self.batch([chunks[i].decode() for i in order[1].tolist()], add_special_tokens=False)]
        size[order[1]] = [len(x) for x in each]
        out.append(np.fromiter((t for x in each for t in x), np.int32))
        order = np.concatenate(order)
        start = np.empty_like(size)
        start[order] = np.cumsum(size[order]) - size[order]
        return np.concatenate(out)[ragged(start, size)], size

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows one after another, ids of each row); both with end ids."""
        if self.ends is not None:
            data, start, stop, whole, counts = pieces(data, offsets)
        else:
            start, stop, counts = segments(data, offsets)
        if self.joins_space:
            # a chunk starts where the one before it ends; white space at the end of a row is a chunk too
            first = np.cumsum(counts) - counts
            begin = np.empty_like(start)
            begin[1:] = stop[:-1]
            begin[first[counts > 0]] = offsets[:-1][counts > 0]
            tail = np.where(counts > 0, stop[np.maximum(first + counts - 1, 0)] if len(stop) else 0, offsets[:-1])
            rest = tail < offsets[1:]
            at = (first + counts)[rest]
            start, stop = np.insert(begin, at, tail[rest]), np.insert(stop, at, offsets[1:][rest])
            counts = counts + rest
            odd = _odd_space(data)
            if len(odd):
                rows = np.unique(np.searchsorted(offsets, odd, "right") - 1)
                whole = np.zeros(len(counts), bool)
                whole[rows] = True
                keep = ~np.repeat(whole, counts)
                start, stop, counts = start[keep], stop[keep], np.where(whole, 0, counts)
                at = (np.cumsum(counts))[rows]
                start, stop = np.insert(start, at, offsets[rows]), np.insert(stop, at, offsets[rows + 1])
                counts[rows] = 1
        if self.ends is None:
            whole = np.ones(len(start), bool)
        entry = self.chunks.entries(data, start, stop, whole)
        entry = np.insert(entry, np.cumsum(counts), 0)
        size = self.chunks.size[entry]
        ids = self.chunks.pool[ragged(self.chunks.start[entry], size)]
        ends = np.cumsum(size)
        last = np.cumsum(counts + 1) - 1
        total = ends[last] if len(last) else np.zeros(0, np.int64)
        return ids, np.diff(np.concatenate([[0], total]))


def encoder(path: str, end_id: int, joins_space: bool) -> TextEncoder:
    """The worker's encoder, loaded once."""
    key = (path, end_id, joins_space)
    if key not in _loaded:
        _loaded[key] = TextEncoder(path, end_id, joins_space)
    return _loaded[key]

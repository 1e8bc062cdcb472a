"""Token counts by a compiled finite-state transducer, composed over chunks by a prefix scan.

For byte-pair merges over a vocabulary where every piece is its own encoding, each prefix of a text has one
last token, and a token may follow another exactly if the two are stable together. What the future can depend
on is therefore finite: the longest suffix that may still grow into a piece, and for each border inside it the
token that ends there and the tokens counted so far. These are the states of a deterministic transducer whose
transitions carry the change in the number of emitted tokens; it is compiled as transitions are met.

A word border (white space after anything else) resets the transducer, as no piece spans it. A chunk of text
is thus a map of entry states: its head, up to the first border, runs from the state that enters; the rest has
one count and one exit state. Maps are made for all chunks in lock step, and a prefix scan composes them: the
exit of each chunk enters the head of the next.

Defined cases: null and empty texts have 0 tokens; repeated rows count each; an empty table gives an empty
result; further columns are ignored; ids must be numbers; a text without any border is one long chain of heads, still
exact, and very long texts are cut into chunks without any loss.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .textkernel import slices, text_buffers

#: Code points of a chunk; a text longer than that is cut into several.
CHUNK = 512
#: States after which a worker compiles anew.
STATES = 500_000
SPACE = 0x2581


class Vocabulary:
    """Pieces of a byte-fallback BPE model without normalisation, read through the sentencepiece library."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.rank: dict[str, float] = {}  # lower merges first
        for i in range(model.get_piece_size()):
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)):
                self.rank[model.id_to_piece(i)] = -model.get_score(i)
        for p in self.rank:
            if chr(SPACE) in p.lstrip(chr(SPACE)):
                raise ValueError("a piece spans a word border")
        self.longest = max(map(len, self.rank))
        self.pair: dict[tuple[str, str], bool] = {}
        whole = [p for p in self.rank if len(p) == 1 or self.merge(p) == [p]]
        self.pieces = set(whole)
        self.prefixes = {p[:i] for p in whole for i in range(1, len(p))}

    def merge(self, text: str) -> list[str]:
        """Plain merging: again and again the best pair, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = self.rank.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def stable(self, a: str, b: str) -> bool:
        key = (a, b)
        if key not in self.pair:
            self.pair[key] = self.merge(a + b) == [a, b]
        return self.pair[key]


class Transducer:
    """States are (suffix, tokens at its borders, counts there relative to the end); state 0 is the start."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        # symbols: one per single-character piece, then unknown characters of 1 to 4 bytes
        self.chars = sorted(p for p in vocabulary.rank if len(p) == 1)
        self.symbol = np.full(0x110000, -1, np.int32)
        self.symbol[[ord(c) for c in self.chars]] = np.arange(len(self.chars))
        code = np.arange(0x110000)
        size = 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)
        self.symbol = np.where(self.symbol < 0, len(self.chars) + size - 1, self.symbol).astype(np.int32)
        self.symbol[0x20] = self.symbol[SPACE]
        self.width = len(self.chars) + 4
        self.reset()

    def reset(self) -> None:
        start = ("", (None,), (0,))
        self.states, self.ids = [start], {start: 0}
        self.bits = 17
        self.key = np.full(1 << self.bits, -1, np.int64)
        self.next = np.zeros(1 << self.bits, np.int32)
        self.emit = np.zeros(1 << self.bits, np.int32)
        self.filled = 0

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _store(self, keys: np.ndarray, nxt: np.ndarray, emit: np.ndarray) -> None:
        if (self.filled + len(keys)) * 2 > len(self.key):
            old = self.key >= 0
            keys, nxt, emit = (np.concatenate([a[old], b]) for a, b in ((self.key, keys), (self.next, nxt), (self.emit, emit)))
            while len(keys) * 2 > 1 << self.bits:
                self.bits += 1
            self.key, self.next, self.emit, self.filled = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32), np.zeros(1 << self.bits, np.int32), 0
        slot, mask = self._slot(keys), (1 << self.bits) - 1
        for i, s in enumerate(slot.tolist()):
            while self.key[s] >= 0:
                s = (s + 1) & mask
            self.key[s], self.next[s], self.emit[s] = keys[i], nxt[i], emit[i]
        self.filled += len(keys)

    def compile(self, state: int, symbol: int) -> tuple[int, int]:
        """Next state and the change in the token count."""
        suffix, last, count = self.states[state]
        if symbol >= len(self.chars):
            # an unknown character is its bytes; nothing merges with it
            return self._id(("", (None,), (0,))), symbol - len(self.chars) + 1
        text, v = suffix + self.chars[symbol], self.v
        for size in range(min(len(text), v.longest), 0, -1):
            token = text[len(text) - size :]
            if token in v.pieces:
                before = last[len(text) - size]
                if before is None or v.stable(before, token):
                    now = count[len(text) - size] + 1
                    break
        else:
            raise ValueError("no token ends here")
        last, count = (*last, token), (*count, now)
        drop = 0
        while drop < len(text) and text[drop:] not in v.prefixes:
            drop += 1
        # borders from which no piece can still grow don't matter
        live = [i == len(text) or text[i:] in v.prefixes for i in range(drop, len(text) + 1)]
        kept = tuple(t if use else "" for t, use in zip(last[drop:], live))
        return self._id((text[drop:], kept, tuple(c - now if use else 0 for c, use in zip(count[drop:], live)))), now

    def _id(self, state: tuple) -> int:
        if state not in self.ids:
            self.ids[state] = len(self.states)
            self.states.append(state)
        return self.ids[state]

    def step(self, state: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = state.astype(np.int64) * self.width + symbol
        slot, mask = self._slot(key), (1 << self.bits) - 1
        got = self.key[slot]
        todo = np.flatnonzero((got != key) & (got >= 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & mask
            got[todo] = self.key[slot[todo]]
            todo = todo[(got[todo] != key[todo]) & (got[todo] >= 0)]
        miss = np.flatnonzero(got < 0)
        nxt, emit = self.next[slot], self.emit[slot]
        if len(miss):
            new, inverse = np.unique(key[miss], return_inverse=True)
            made = [self.compile(*divmod(k, self.width)) for k in new.tolist()]
            n, e = np.array([m[0] for m in made], np.int32), np.array([m[1] for m in made], np.int32)
            nxt[miss], emit[miss] = n[inverse], e[inverse]
            self._store(new, n, e)
        return nxt, emit

    def run(self, symbols: np.ndarray, begin: np.ndarray, end: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exit state and token count of each stretch, all in lock step."""
        state, total = state.copy(), np.zeros(len(begin), np.int64)
        order = np.argsort(begin - end, kind="stable")
        length = (end - begin)[order]
        for t in range(int(length[0]) if len(length) else 0):
            live = order[: int(np.searchsorted(-length, -t, "left"))]
            state[live], e = self.step(state[live], symbols[begin[live] + t])
            total[live] += e
        return state, total

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        if len(self.states) > STATES:
            self.reset()
        full = [chr(SPACE) + t if t else "" for t in texts]
        code = np.frombuffer("".join(full).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        size = np.array([len(t) for t in full], np.int64)
        ends = np.cumsum(size)
        starts = ends - size
        symbols = self.symbol[code]
        gap = symbols == self.symbol[SPACE]
        border = gap.copy()
        border[1:] &= ~gap[:-1]
        first = starts[size > 0]
        border[first] = True
        # chunks of each text
        pieces = -(-size // CHUNK)
        text = np.repeat(np.arange(len(full)), pieces)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = starts[text] + nth * CHUNK
        end = np.minimum(begin + CHUNK, ends[text])
        # the map of a chunk: head up to its first border, then a count and an exit that no entry state changes
        at = np.flatnonzero(border)
        k = np.searchsorted(at, begin)
        head = np.minimum(np.where(k < len(at), at[np.minimum(k, max(len(at) - 1, 0))] if len(at) else end, end), end)
        constant, total = self.run(symbols, head, end, np.zeros(len(begin), np.int32))
        total += self._heads(symbols, begin, head, np.where(head < end, constant, -1), text)
        return np.bincount(text, weights=total, minlength=len(full)).astype(np.int64)

    def _heads(self, symbols: np.ndarray, begin: np.ndarray, head: np.ndarray, constant: np.ndarray, text: np.ndarray) -> np.ndarray:
        """Tokens that the heads of chains of chunks emit, put down at the first chunk of each chain.

        A head's map has one node per entry state; ``constant`` is the exit of chunks that have a border, else -1.
        Every head is run from a guess and from all states that the head before it can leave, all in lock step, until
        no new entry state turns up: states forget what came long before, so that takes few rounds. Then the maps
        compose by a doubling scan over the nodes.
        """
        out = np.zeros(len(begin), np.int64)
        open_head = head > begin  # never the first chunk of a text, which begins with a border
        if not open_head.any():
            return out
        chunks = np.flatnonzero(open_head)
        after = np.append(open_head[1:] & (text[1:] == text[:-1]), False)
        starts = chunks[constant[chunks - 1] >= 0]
        ids: dict[tuple[int, int], int] = {}
        node_exit: list[int] = []
        node_count: list[int] = []
        node_chunk: list[int] = []
        new = [(int(c), int(constant[c - 1])) for c in starts] + [(int(c), 0) for c in chunks if constant[c - 1] < 0]
        while new:
            new = list(dict.fromkeys(x for x in new if x not in ids))
            for x in new:
                ids[x] = len(ids)
            c = np.array([x[0] for x in new], np.int64)
            left, n = self.run(symbols, begin[c], head[c], np.array([x[1] for x in new], np.int32))
            node_exit += left.tolist()
            node_count += n.tolist()
            node_chunk += c.tolist()
            new = [(i + 1, s) for i, s in zip(c.tolist(), left.tolist()) if after[i] and constant[i] < 0 and (i + 1, s) not in ids]
        # doubling: after r rounds a node holds what 2^r heads from its own on emit
        last = len(ids)
        jump = np.full(last + 1, last)
        for i, (c, s) in enumerate(zip(node_chunk, node_exit)):
            if after[c] and constant[c] < 0:
                jump[i] = ids[c + 1, s]
        total = np.array([*node_count, 0], np.int64)
        while (jump != last).any():
            total = total + total[jump]
            jump = jump[jump]
        for c in starts.tolist():
            out[c] = total[ids[c, int(constant[c - 1])]]
        return out


_loaded: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    if path not in _loaded:
        _loaded[path] = Transducer(Vocabulary(path))
    return _loaded[path]


def _counts(path: str, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = text_buffers(batch.column(1))
            n = np.zeros(batch.num_rows, np.int64)
            for lo, hi, b, o in slices(data, off, 4 << 20):
                raw, at = b.tobytes(), o.tolist()
                n[lo:hi] = transducer(path).count([raw[x:y].decode() for x, y in zip(at[:-1], at[1:])])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(off)), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return run


def token_counts(docs: DataFrame, path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit of every document."""
    common.small_batches(docs.sparkSession)
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return base.mapInArrow(_counts(path, limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")

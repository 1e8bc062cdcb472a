"""Token counts: an estimate by characters, byte-pair counts by local vocabulary files, model families."""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters per token of model families by prefix; others have 4.
RATIOS = (("claude", 3.5),)
#: Encodings of model names by prefix, the longest first.
ENCODINGS = (
    ("gpt-4o", "o200k_base"), ("gpt-4.1", "o200k_base"), ("o1", "o200k_base"), ("o3", "o200k_base"), ("o4", "o200k_base"), ("gpt-4", "cl100k_base"), ("gpt-3.5", "cl100k_base"),
    ("text-embedding-3", "cl100k_base"), ("text-davinci", "p50k_base"), ("davinci", "r50k_base"),
)
_registered: dict[str, Callable[[str], int]] = {}


def estimate(text: str, ratio: float = 4.0) -> int:
    return math.ceil(len(text) / (ratio if ratio > 0 else 4.0))


def ratio_of(model: str) -> float:
    return next((r for p, r in RATIOS if model.lower().startswith(p)), 4.0)


def counter(model: str) -> Callable[[str], int]:
    """A registered counter of the model, else the estimate of its family."""
    if model in _registered:
        return _registered[model]
    ratio = ratio_of(model)
    return lambda text: estimate(text, ratio)


def register(model: str, count: Callable[[str], int]) -> None:
    _registered[model] = count


def clear() -> None:
    _registered.clear()


def backend(model: Column) -> Column:
    """tiktoken, or estimation, by the model's name."""
    known = F.lit(False)
    for p, _ in ENCODINGS:
        known = known | F.lower(model).startswith(p)
    return F.when(known, "tiktoken").otherwise("estimation")


def encoding(model: Column) -> Column:
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for p, name in ENCODINGS:
        out = out.when(F.lower(model).startswith(p), name)
    return out


def estimated(text: Column, ratio: float = 4.0) -> Column:
    return F.ceil(F.length(text) / F.lit(ratio if ratio > 0 else 4.0)).cast("long")


def chat_total(role: Column, content: Column) -> Column:
    """Aggregate: estimated tokens of a conversation, 3 and 4 per message for the frame."""
    return (F.lit(3) + F.sum(F.lit(4) + estimated(role) + estimated(F.coalesce(content, F.lit(""))))).cast("long")


def bpe_counts(path: str, pattern: str) -> Callable[[Column], Column]:
    """Column function that counts tokens with a rank file; the encoder is loaded once per worker."""

    @F.pandas_udf("long")
    def count(text: pd.Series) -> pd.Series:
        encoder = _bpe(path, pattern)
        return text.map(lambda t: len(encoder.encode_ordinary(t)), na_action="ignore")

    return count


_encoders: dict[tuple[str, str], object] = {}


def _bpe(path: str, pattern: str):
    if (path, pattern) not in _encoders:
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path, pattern] = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path, pattern]

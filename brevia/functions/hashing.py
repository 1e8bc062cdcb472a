"""Hash columns: keys of payloads, SimHash, FNV-1a."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Payload keys use SHA-256 here; another function may be registered under a name.
KEY_FUNCTIONS = {"sha256": lambda data: hashlib.sha256(data).hexdigest()[:24], "blake2b": lambda data: hashlib.blake2b(data).hexdigest()[:24], "md5": lambda data: hashlib.md5(data).hexdigest()[:24]}


def payload_key(text: Column) -> Column:
    """24 hexadecimal digits that name a payload."""
    return F.left(F.sha2(text, 256), F.lit(24))


def md5_key(text: Column, digits: int = 24) -> Column:
    return F.left(F.md5(text), F.lit(digits))


def sha_prefix(text: Column, digits: int) -> Column:
    return F.left(F.sha2(text, 256), F.lit(digits))


def opaque_marker(text: Column, kind: str) -> Column:
    """``<<ccr:hash,kind,bytes>>`` in place of an opaque value."""
    return F.concat(F.lit("<<ccr:"), sha_prefix(text, 12), F.lit(f",{kind},"), F.octet_length(text), F.lit(">>"))


def simhash(text: Column) -> Column:
    """64-bit SimHash of lower-case 4-grams by MD5, in native expressions; meant for short texts."""
    low = F.lower(text)
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(low) - 3, F.lit(1))), lambda i: F.substr(low, i, F.lit(4)))
    hashes = F.transform(grams, lambda g: F.conv(F.substring(F.md5(g), 1, 16), 16, -10).cast("long"))
    n = F.size(grams)
    bits = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda b: F.when(F.aggregate(hashes, F.lit(0), lambda s, h: s + F.getbit(h, b).cast("int")) * 2 > n, F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))


@F.pandas_udf(T.LongType())
def simhash_long(text: pd.Series) -> pd.Series:
    """The same fingerprint for long texts, by Arrow batches."""
    from . import sizing

    return text.map(lambda t: None if t is None else (lambda h: h - (1 << 64) if h >> 63 else h)(sizing.simhash(t)))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


@F.pandas_udf(T.StringType())
def fnv1a64(text: pd.Series) -> pd.Series:
    def one(t: str) -> str:
        h = 0xCBF29CE484222325
        for b in t.encode():
            h = ((h ^ b) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
        return f"{h:016x}"

    return text.map(one, na_action="ignore")

"""Tokens, SimHash fingerprints and their bands."""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

BITS = 64
_WORD = re.compile(r"\w+")


def tokens(text: Column) -> Column:
    """Unicode word tokens of the lower-cased text, natively; null gives null."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))


@lru_cache(maxsize=1 << 17)
def token_hash(token: str) -> int:
    """The first 8 bytes of blake2b, big-endian."""
    return int.from_bytes(blake2b(token.encode("utf-8"), digest_size=8).digest(), "big")


def simhash_of(text: str | None) -> int:
    """64-bit SimHash, terms weighted by count; a bit is set iff its signed sum is above 0, so ties and empty texts give 0."""
    counts = Counter(_WORD.findall((text or "").lower()))
    if not counts:
        return 0
    hashes = np.fromiter(map(token_hash, counts), dtype=np.uint64, count=len(counts))
    weights = np.fromiter(counts.values(), dtype=np.float64, count=len(counts))
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)  # the highest bit first
    sums = 2 * (weights @ bits) - weights.sum()  # whole numbers, exact below 2**53
    return int.from_bytes(np.packbits(sums > 0).tobytes(), "big")


def signed64(value: int) -> int:
    """Two's complement of an unsigned 64-bit value."""
    return value - (1 << 64) if value >= 1 << 63 else value


@F.pandas_udf(T.LongType())
def simhash(texts: pd.Series) -> pd.Series:
    """Signed SimHash of each text; null counts as empty."""
    return texts.map(lambda t: signed64(simhash_of(t)))


def hex_hash(token: Column) -> Column:
    """Signed 64-bit prefix of a token's SHA-256: the native stand-in for ``token_hash``, which an SQL engine can follow."""
    return F.conv(F.substring(F.sha2(token, 256), 1, 16), 16, -10).cast("long")


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two 64-bit values."""
    return F.bit_count(a.bitwiseXOR(b))


def band_values(fingerprint: Column, bands: int = 4, bits: int = BITS) -> Column:
    """Bands of a fingerprint, the lowest bits first; bits left over by an uneven division are dropped."""
    width = bits // bands
    mask = F.lit((1 << width) - 1 if width < 64 else -1).cast("long")
    return F.array(*[F.shiftrightunsigned(fingerprint, i * width).bitwiseAND(mask) for i in range(bands)])


@F.pandas_udf(T.LongType())
def token_hashes(tokens: pd.Series) -> pd.Series:
    """Signed ``token_hash`` of each token; null stays null."""
    return pd.Series([None if t is None else signed64(token_hash(t)) for t in tokens], dtype="Int64")

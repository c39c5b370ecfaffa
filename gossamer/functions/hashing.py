"""Murmur3 and Bloom arithmetic, vectorized over whole Arrow batches."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_C1, _C2 = np.uint32(0xCC9E2D51), np.uint32(0x1B873593)


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint32(r)) | (x >> np.uint32(32 - r))


def murmur3_32(values: Sequence[bytes], seeds: np.ndarray | int = 0) -> np.ndarray:
    """MurmurHash3 x86_32 of each value as uint32. Values of one length are hashed together, four bytes of all at a time."""
    n = len(values)
    seed = np.broadcast_to(np.asarray(seeds, dtype=np.uint32), (n,))
    out = np.empty(n, dtype=np.uint32)
    lengths = np.fromiter(map(len, values), dtype=np.int64, count=n)
    with np.errstate(over="ignore"):
        for size in np.unique(lengths):
            at = np.flatnonzero(lengths == size)
            data = np.frombuffer(b"".join(values[i] for i in at), dtype=np.uint8).reshape(len(at), size) if size else np.empty((len(at), 0), np.uint8)
            h = seed[at].copy()
            blocks = size // 4
            words = np.ascontiguousarray(data[:, : blocks * 4]).view("<u4") if blocks else np.empty((len(at), 0), np.uint32)
            for i in range(blocks):
                k = _rotl(words[:, i] * _C1, 15) * _C2
                h = _rotl(h ^ k, 13) * np.uint32(5) + np.uint32(0xE6546B64)
            tail = data[:, blocks * 4 :].astype(np.uint32)
            if tail.shape[1]:
                k = np.zeros(len(at), dtype=np.uint32)
                for i in range(tail.shape[1]):
                    k |= tail[:, i] << np.uint32(8 * i)
                h ^= _rotl(k * _C1, 15) * _C2
            h ^= np.uint32(size)
            h ^= h >> np.uint32(16)
            h *= np.uint32(0x85EBCA6B)
            h ^= h >> np.uint32(13)
            h *= np.uint32(0xC2B2AE35)
            h ^= h >> np.uint32(16)
            out[at] = h
    return out


def _bytes(texts: pd.Series) -> list[bytes]:
    return [t.encode("utf-8") for t in texts]


@F.pandas_udf(T.LongType())
def murmur3(texts: pd.Series) -> pd.Series:
    """Unsigned Murmur3 with seed 0 as a long; null stays null."""
    held = texts.notna()
    out = pd.Series(pd.NA, index=texts.index, dtype="Int64")
    out[held] = murmur3_32(_bytes(texts[held])).astype(np.int64)
    return out


def optimal_bits(items: int, rate: float) -> int:
    """Bits of a Bloom filter for so many items at a false-positive rate."""
    return max(8, math.ceil(-items * math.log(rate) / math.log(2) ** 2))


def optimal_hashes(bits: int, items: int) -> int:
    """Hash functions of a Bloom filter; Python's rounding, half to even."""
    return max(1, round(bits / items * math.log(2)))


def optimal_bits_col(items: Column, rate: Column) -> Column:
    return F.greatest(F.lit(8), F.ceil(-items * F.log(rate) / F.lit(math.log(2) ** 2))).cast("long")


def optimal_hashes_col(bits: Column, items: Column) -> Column:
    return F.greatest(F.lit(1), F.bround(bits / items * F.lit(math.log(2)), 0)).cast("long")


def bloom_indices_of(values: Sequence[bytes], bits: int, hashes: int) -> np.ndarray:
    """(values × hashes) places by double hashing: (h1 + i·(h2 | 1)) mod bits, h2 seeded with h1."""
    h1 = murmur3_32(values)
    h2 = murmur3_32(values, h1).astype(np.uint64) | np.uint64(1)
    i = np.arange(hashes, dtype=np.uint64)
    return ((h1.astype(np.uint64)[:, None] + i * h2[:, None]) % np.uint64(bits)).astype(np.int64)


def bloom_indices(bits: int, hashes: int):
    """Arrow function text → places of its bits; null stays null."""

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def run(texts: pd.Series) -> pd.Series:
        held = texts.notna()
        out = pd.Series([None] * len(texts), index=texts.index, dtype=object)
        places = bloom_indices_of(_bytes(texts[held]), bits, hashes)
        out[held] = pd.Series(list(places), index=texts.index[held], dtype=object)
        return out

    # Exploding a deterministic function makes Catalyst infer a filter on its size, that is, run it twice.
    return run.asNondeterministic()

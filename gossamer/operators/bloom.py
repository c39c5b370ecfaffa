"""Approximate anti-join with one Bloom filter, sized by the keys it holds."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gossamer.functions.hashing import bloom_indices, bloom_indices_of, optimal_bits, optimal_hashes

#: Largest filter that is gathered, as a million words, and shipped: 8 MB.
MAX_BITS = 1 << 26


class Bloom:
    """Bits of a filter over text keys."""

    def __init__(self, items: int, rate: float):
        self.m = optimal_bits(items, rate)
        if self.m > MAX_BITS:
            raise ValueError(f"a filter of {self.m} bits is too large to ship; use an exact anti-join")
        self.k = optimal_hashes(self.m, items)
        self.bits = np.zeros((self.m + 7) // 8, dtype=np.uint8)

    def add(self, keys: list[str]) -> None:
        at = bloom_indices_of([k.encode() for k in keys], self.m, self.k).ravel()
        np.bitwise_or.at(self.bits, at >> 3, (1 << (at & 7)).astype(np.uint8))

    def may_contain(self, keys: list[str]) -> np.ndarray:
        at = bloom_indices_of([k.encode() for k in keys], self.m, self.k)
        return ((self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1)


def build_bloom(keys: DataFrame, key: str, items: int | None = None, rate: float = 0.01) -> Bloom:
    """The filter over a key column, for ``items`` keys or, if that is null, for as many as there are (counted within 5 %, with that to
    spare). Bits are OR-ed per 64-bit word in the cluster; what reaches the driver is the filter, at most ``MAX_BITS``."""
    if items is None:
        items = max(1, int(1.1 * keys.agg(F.approx_count_distinct(key, 0.02)).first()[0]))
    bloom = Bloom(items, rate)
    places = keys.where(F.col(key).isNotNull()).select(F.explode(bloom_indices(bloom.m, bloom.k)(key)).alias("i"))
    words = places.groupBy(F.shiftright("i", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(i & 63L as int)))").alias("v")).toPandas()
    flat = np.zeros((bloom.m + 63) // 64, dtype=np.uint64)
    flat[words["w"].to_numpy(dtype=np.int64)] = words["v"].to_numpy(dtype=np.int64).view(np.uint64)
    bloom.bits = flat.view(np.uint8)
    return bloom


def probably_new(df: DataFrame, key: str, bloom: Bloom) -> DataFrame:
    """Rows of ``df`` whose key the filter lacks: none of the filter's keys, and all but about its error rate of the others. Null keys go."""
    shipped = df.sparkSession.sparkContext.broadcast((bloom.m, bloom.k, bloom.bits.tobytes()))

    @F.pandas_udf("boolean")
    def held(keys: pd.Series) -> pd.Series:
        filter_ = Bloom.__new__(Bloom)
        filter_.m, filter_.k, raw = shipped.value
        filter_.bits = np.frombuffer(raw, dtype=np.uint8)
        return pd.Series(filter_.may_contain(keys.fillna("").tolist()))

    return df.where(F.col(key).isNotNull()).where(~held(key))


def unseen_rows(df: DataFrame, key: str, seen: DataFrame, rate: float = 0.01) -> DataFrame:
    """Rows of ``df`` whose key ``seen`` (a column of that name) lacks: by a filter sized for its keys, or exactly where that filter would be
    too large to ship. With the filter up to about ``rate`` of the new rows go too. Null keys go."""
    items = max(1, int(1.1 * seen.agg(F.approx_count_distinct(key, 0.02)).first()[0]))
    if optimal_bits(items, rate) > MAX_BITS:
        return df.where(F.col(key).isNotNull()).join(seen.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti").select(*df.columns)
    return probably_new(df, key, build_bloom(seen, key, items, rate))

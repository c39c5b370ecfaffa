"""Consistent hashing: ring, assignment, and how evenly and how stably keys spread."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gossamer.functions.hashing import murmur3_32

VIRTUAL_NODES = 150


class Ring:
    """Points of the nodes on a circle of 32-bit hashes; a key belongs to the first point after its hash, around the end to the first."""

    def __init__(self, nodes: Sequence[str], virtual: int = VIRTUAL_NODES):
        self.virtual, self.nodes = virtual, list(dict.fromkeys(nodes))
        names = [f"{n}#{i}".encode() for n in self.nodes for i in range(virtual)]
        hashes = murmur3_32(names) if names else np.empty(0, np.uint32)
        owners = np.repeat(np.arange(len(self.nodes)), virtual)
        # Equal points: the node added last owns the point.
        last = {int(h): int(o) for h, o in zip(hashes, owners)}
        self.points = np.array(sorted(last), dtype=np.int64)
        self.owners = np.array([last[int(p)] for p in self.points], dtype=np.int64)

    def with_node(self, node: str) -> Ring:
        return Ring([*self.nodes, node], self.virtual)

    def without_node(self, node: str) -> Ring:
        return Ring([n for n in self.nodes if n != node], self.virtual)

    def owners_of(self, keys: Sequence[str]) -> list[str | None]:
        if not len(self.points):
            return [None] * len(keys)
        at = np.searchsorted(self.points, murmur3_32([k.encode() for k in keys]).astype(np.int64), side="right")
        return [self.nodes[i] for i in self.owners[at % len(self.points)]]


def assign(ring: Ring, out: str = "node"):
    """Arrow function key → node; null keys have no node. The ring travels with the function: nodes × virtual nodes points."""

    @F.pandas_udf("string")
    def run(keys: pd.Series) -> pd.Series:
        held = keys.notna()
        result = pd.Series([None] * len(keys), index=keys.index, dtype=object)
        result[held] = ring.owners_of(keys[held].tolist())
        return result

    return run


def naive_shard(n: int):
    """Arrow function key → hash modulo ``n``."""

    @F.pandas_udf("long")
    def run(keys: pd.Series) -> pd.Series:
        return pd.Series(murmur3_32([k.encode() for k in keys.fillna("")]).astype(np.int64) % n)

    return run


def distribution(assigned: DataFrame, node: str, nodes: Sequence[str]) -> DataFrame:
    """(node, n) of every node, 0 for those without a key."""
    spark = assigned.sparkSession
    every = spark.createDataFrame([(n,) for n in nodes], "node string")
    counts = assigned.groupBy(F.col(node).alias("node")).agg(F.count("*").alias("n"))
    return every.join(counts, "node", "left").select("node", F.coalesce("n", F.lit(0)).alias("n"))


def imbalance(counts: DataFrame) -> DataFrame:
    """(imbalance): the largest load over the mean of all nodes, empty ones included; 0 without keys."""
    return counts.agg(F.when(F.sum("n") > 0, F.max("n") / (F.sum("n") / F.count("*"))).otherwise(0.0).alias("imbalance"))


def churn(before: DataFrame, after: DataFrame, key: str, node: str) -> DataFrame:
    """(churn): share of the keys of ``before`` that ``after`` puts elsewhere or lacks."""
    old, new = before.select(key, F.col(node).alias("_old")), after.select(key, F.col(node).alias("_new"))
    return old.join(new, key, "left").agg(F.avg((~F.col("_old").eqNullSafe(F.col("_new"))).cast("double")).alias("churn"))


def successor_join(keys: DataFrame, key: str, points: Sequence[tuple[int, str]], out: str) -> DataFrame:
    """``keys`` with ``out``: the label of the least point above the key, around the end the least point. Points are few by contract."""
    ordered = sorted(points)
    at = np.array([p for p, _ in ordered], dtype=np.int64)
    labels = [label for _, label in ordered]

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return pd.Series([labels[i % len(at)] for i in np.searchsorted(at, values.to_numpy(dtype=np.int64), side="right")], dtype=object)

    return keys.withColumn(out, run(F.col(key)))

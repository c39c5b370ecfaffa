"""Has this key been seen before? Scalable Bloom chains over a log in order of arrival.

A chain is a list of Bloom layers. A layer that reaches its fill threshold is closed and a larger one opened with a tighter error
rate, so the sum of all layers' rates stays under a bound that is known however far history grows. Keys are hashed to shards; a
shard is one task's sorted stream through one chain, whose memory is bits, not keys.

A hot key must not land in one shard with all its rows: the log is cut into short blocks, a block sends each key once (its first
message), and the block's later messages with that key are repeats by that alone. All other answers are the chain's.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gossamer.functions.url import crawlable, normalize_url
from gossamer.session import cut_lineage

FIRST_CAPACITY = 1 << 14
GROWTH = 4
TIGHTENING = 0.5
ERROR_RATE = 1e-3
#: Ids of a block: short against the log, so that the chain gives most answers.
BLOCK = 1 << 12
#: Chains that a history is spread over. Kept chains name their number, whatever the session's settings are later.
SHARDS = 64
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


class Layer:
    """A Bloom filter of fixed capacity for 64-bit keys, by double hashing."""

    def __init__(self, capacity: int, rate: float):
        self.capacity, self.rate, self.count = capacity, rate, 0
        self.k = max(1, round(-math.log2(rate)))
        self.m = max(64, math.ceil(-capacity * math.log(rate) / math.log(2) ** 2))
        self.bits = np.zeros((self.m + 7) // 8, dtype=np.uint8)

    def _places(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            a = keys * _A
            a ^= a >> np.uint64(32)
            b = (keys ^ (keys >> np.uint64(29))) * _B
            b = (b ^ (b >> np.uint64(31))) | np.uint64(1)
            return ((a[:, None] + np.arange(self.k, dtype=np.uint64) * b[:, None]) % np.uint64(self.m)).astype(np.int64)

    def has(self, keys: np.ndarray) -> np.ndarray:
        at = self._places(keys)
        return ((self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1)

    def add(self, keys: np.ndarray) -> None:
        at = self._places(keys).ravel()
        np.bitwise_or.at(self.bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
        self.count += len(keys)


class BloomChain:
    """Layers of ``GROWTH`` times the last capacity and ``TIGHTENING`` times the last error rate.

    With a first rate of rate * (1 - TIGHTENING) the rates of any number of layers sum to less than ``rate``.
    """

    def __init__(self, rate: float = ERROR_RATE, capacity: int = FIRST_CAPACITY):
        if not 0 < rate < 1 or capacity < 1:
            raise ValueError("rate must be in (0, 1), capacity positive")
        self.rate, self.layers = rate, [Layer(capacity, rate * (1 - TIGHTENING))]

    @property
    def bound(self) -> float:
        """The compounded false-positive bound of the layers so far: 1 - prod(1 - rate)."""
        return 1 - math.prod(1 - layer.rate for layer in self.layers)

    def seen(self, keys: np.ndarray) -> np.ndarray:
        """For each key in turn, whether the chain holds it or it came before in ``keys``; new keys are added."""
        keys = np.ascontiguousarray(keys, dtype=np.uint64)
        out = np.zeros(len(keys), dtype=bool)
        for layer in self.layers:
            open_ = np.flatnonzero(~out)
            if len(open_):
                out[open_] = layer.has(keys[open_])
        fresh = np.flatnonzero(~out)
        _, first = np.unique(keys[fresh], return_index=True)
        late = np.ones(len(fresh), dtype=bool)
        late[first] = False
        out[fresh[late]] = True
        new = np.sort(fresh[first])
        while len(new):
            top = self.layers[-1]
            room = top.capacity - top.count
            if not room:
                self.layers.append(Layer(top.capacity * GROWTH, top.rate * TIGHTENING))
                continue
            # Keys that a layer closed within this call holds already aren't looked up again: they are distinct and were all new.
            top.add(keys[new[:room]])
            new = new[room:]
        return out

    def dump(self) -> bytes:
        head = struct.pack("<dI", self.rate, len(self.layers))
        return head + b"".join(struct.pack("<QdQ", x.capacity, x.rate, x.count) + x.bits.tobytes() for x in self.layers)

    @classmethod
    def load(cls, data: bytes) -> BloomChain:
        rate, n = struct.unpack_from("<dI", data)
        chain, at = cls(rate), 12
        chain.layers = []
        for _ in range(n):
            capacity, layer_rate, count = struct.unpack_from("<QdQ", data, at)
            layer = Layer(capacity, layer_rate)
            at += 24
            layer.bits = np.frombuffer(data, np.uint8, len(layer.bits), at).copy()
            layer.count = count
            at += len(layer.bits)
            chain.layers.append(layer)
        return chain


def keyed_log(messages: DataFrame) -> DataFrame:
    """(msg_id, key): 64-bit key of the normalized url; messages without an id or a crawlable url don't count."""
    rows = messages.where(F.col("msg_id").isNotNull() & crawlable(F.col("url")))
    return rows.select("msg_id", F.xxhash64(normalize_url(F.col("url"))).alias("key"))


def block_firsts(log: DataFrame) -> DataFrame:
    """(key, first, later): per block of ``BLOCK`` consecutive ids and key the first id and the others, each id once."""
    block = F.expr(f"msg_id div {BLOCK}")
    ids = F.array_sort(F.collect_set("msg_id"))
    grouped = log.groupBy(block.alias("block"), "key").agg(ids.alias("ids"))
    return grouped.select("key", F.element_at("ids", 1).alias("first"), F.slice("ids", 2, BLOCK).alias("later"))


def chain_answers(firsts: DataFrame, shards: int = SHARDS, rate: float = ERROR_RATE, state: DataFrame | None = None, keep_state: bool = False) -> DataFrame:
    """(shard, key, first, seen, bound[, chain]) of every row of ``firsts`` (key, first) in order of ``first``.

    ``state`` (shard, chain) goes on from chains kept earlier, of which there must be ``shards``; ``keep_state`` adds a row per shard
    with a null key that holds the chain. A retried task replays its shard from the shuffle and gives the same answers.
    """
    rows = firsts.select(F.pmod("key", F.lit(shards)).cast("int").alias("shard"), "key", "first", F.lit(None).cast("binary").alias("chain"))
    if state is not None:
        # The key of a chain's row must not be null: pandas would turn the batch's keys into floating point.
        rows = rows.unionAll(state.select("shard", F.lit(0).cast("long").alias("key"), F.lit(-(2**63)).cast("long").alias("first"), "chain"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, chain = None, BloomChain(rate)

        def closing() -> pd.DataFrame:
            return pd.DataFrame({"shard": [shard], "key": [None], "first": [None], "seen": [None], "bound": [chain.bound], "chain": [chain.dump()]})

        for batch in batches:
            for name, part in batch.groupby("shard", sort=False):
                if name != shard:
                    if shard is not None and keep_state:
                        yield closing()
                    shard, chain = name, BloomChain(rate)
                kept = part["chain"].notna()
                if kept.any():
                    chain = BloomChain.load(bytes(part["chain"][kept].iloc[0]))
                    part = part[~kept]
                seen = chain.seen(part["key"].to_numpy(dtype=np.int64).view(np.uint64))
                yield pd.DataFrame({"shard": name, "key": part["key"].astype("Int64"), "first": part["first"].astype("Int64"), "seen": seen, "bound": chain.bound, "chain": None})
        if shard is not None and keep_state:
            yield closing()

    ordered = rows.repartition(shards, "shard").sortWithinPartitions("shard", "first")
    return ordered.mapInPandas(run, "shard int, key long, first long, seen boolean, bound double, chain binary")


def kept_chains(messages: DataFrame, state: DataFrame | None = None, shards: int = SHARDS) -> DataFrame:
    """(shard, shards, chain): the history after ``messages``, going on from ``state``, in bounded memory. A shard without keys has no row."""
    firsts = block_firsts(keyed_log(messages)).select("key", "first")
    shards = _shards_of(state, shards)
    return chain_answers(firsts, shards, state=state, keep_state=True).where("chain IS NOT NULL").select("shard", F.lit(shards).alias("shards"), "chain")


def _shards_of(state: DataFrame | None, shards: int) -> int:
    held = state.agg(F.max("shards")).first()[0] if state is not None else None
    return shards if held is None else int(held)


def repeated_messages(messages: DataFrame, state: DataFrame | None = None, shards: int = SHARDS) -> DataFrame:
    """(msg_id) of the messages whose normalized url a message with a smaller msg_id had.

    Null ids and urls, empty urls and urls that can't be crawled are never cases; a second delivery of a msg_id is no other message;
    late enqueued_at plays no part; an empty log gives no row. Within a block a later message with a key is a repeat for certain. A
    block's first message of a key is asked of the chain. Without ``state`` the keys that the chain calls seen are held against their
    least msg_id, so a false positive of the chain (under ``ERROR_RATE`` of new keys) doesn't come out. With ``state``, the chains of
    ``kept_chains`` over earlier messages whose keys are gone, the chain's answers come out as they are, wrong at most at its bound.
    """
    firsts = block_firsts(keyed_log(messages))
    said = chain_answers(firsts, _shards_of(state, shards), state=state).where("seen").select("key", "first")
    if state is None:
        answers = cut_lineage(said)
        least = firsts.join(answers.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.min("first").alias("least"))
        said = answers.join(least, "key").where("first > least")
    return firsts.select(F.explode("later").alias("msg_id")).unionAll(said.select(F.col("first").alias("msg_id")))


def wrong_answer_rate(messages: DataFrame) -> DataFrame:
    """(n_keys, n_asked, n_said_seen, n_wrong, wrong_rate, bound): the chain's answers held against the truth over the whole log.

    ``n_wrong`` counts first messages of a key of which the chain said seen; ``wrong_rate`` is their share among all keys' firsts; ``bound`` the
    largest compounded bound a shard reached. No false negatives can occur. An empty log gives zeros and a null rate.
    """
    firsts = block_firsts(keyed_log(messages)).select("key", "first")
    answers = chain_answers(firsts)
    per_key = answers.groupBy("key").agg(
        F.count("*").alias("n"), F.sum(F.col("seen").cast("long")).alias("said"), F.min_by("seen", "first").alias("wrong"), F.max("bound").alias("bound")
    )
    return per_key.agg(
        F.count("*").alias("n_keys"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_asked"),
        F.coalesce(F.sum("said"), F.lit(0)).alias("n_said_seen"),
        F.coalesce(F.sum(F.col("wrong").cast("long")), F.lit(0)).alias("n_wrong"),
        (F.sum(F.col("wrong").cast("long")) / F.count("*")).alias("wrong_rate"),
        F.max("bound").alias("bound"),
    )

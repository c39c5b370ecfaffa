"""Per-key gates: budgets, token buckets, failure streaks and circuit breakers.

What has a closed form is a blocked scan (no key lands in one task). What depends on every earlier decision is a fold: rows are
partitioned by key, sorted, and streamed through a step function whose state is a few numbers, so memory is constant per key.
The step functions are plain Python and serve the streaming operators too.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gossamer.operators.scan import blocked_scan

Step = Callable[[tuple | None, tuple], tuple[tuple, tuple]]


def budget(df: DataFrame, key: str, seq: str, limit: int, cost: Column | None = None) -> DataFrame:
    """``df`` with ``allowed`` and ``remaining``: a budget of ``limit`` per key that every request charges, denied or not.

    A limit of 0 or less allows all and leaves -1. With a cost of 1 this is the first ``limit`` requests of a key.
    """
    if limit <= 0:
        return df.withColumn("allowed", F.lit(True)).withColumn("remaining", F.lit(-1).cast("long"))
    charged = df.withColumn("_cost", (F.lit(1) if cost is None else cost).cast("long"))
    used = blocked_scan(charged, key, seq, "_cost", "_used")
    return used.withColumn("allowed", F.col("_used") <= limit).withColumn("remaining", F.greatest(F.lit(0), F.lit(limit) - F.col("_used")).cast("long")).drop("_cost", "_used")


def paced_grants(df: DataFrame, key: str, seq: str, seconds: Column, rate: float) -> DataFrame:
    """``df`` with ``grant_s``: when a bucket of capacity 1, refilled ``rate`` times a second, lets each request of a key pass.

    grant_k = k / rate + max over j <= k of (t_j - j / rate): a running maximum.
    """
    placed = blocked_scan(df.withColumn("_one", F.lit(1).cast("long")), key, seq, "_one", "_k")
    lag = placed.withColumn("_lag", seconds - F.col("_k") / F.lit(rate))
    most = blocked_scan(lag, key, seq, "_lag", "_most", "max")
    return most.withColumn("grant_s", F.col("_most") + F.col("_k") / F.lit(rate)).drop("_one", "_k", "_lag", "_most")


def failure_streaks(df: DataFrame, key: str, seq: str, failed: Column, threshold: int) -> DataFrame:
    """``df`` with ``streak`` (consecutive failures of the key up to this row) and ``tripped`` (at least ``threshold`` of them)."""
    placed = blocked_scan(df.withColumn("_one", F.lit(1).cast("long")), key, seq, "_one", "_k")
    marked = placed.withColumn("_ok", F.when(~failed, F.col("_k")))
    last = blocked_scan(marked, key, seq, "_ok", "_last", "max")
    streak = F.col("_k") - F.coalesce("_last", F.lit(0))
    return last.withColumn("streak", streak).withColumn("tripped", streak >= threshold).drop("_one", "_k", "_ok", "_last")


def keyed_fold(df: DataFrame, key: str, order: list[str], inputs: list[str], step: Step, output: str) -> DataFrame:
    """(key, *order, *outputs): ``step(state or None, inputs) -> (state, outputs)`` over the rows of each key in order.

    ``output`` is the schema of the outputs. Rows with a null key form one key. Partitions are streamed in Arrow batches and
    the state is all that is kept between two of them.
    """
    columns = [key, *order, *[c for c in inputs if c not in (key, *order)]]
    names = [part.strip().split(" ")[0] for part in output.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state, started = None, None, False
        for batch in batches:
            keys = batch[key].astype(object).where(batch[key].notna(), None).tolist()
            rows = list(zip(*[batch[c].tolist() for c in inputs]))
            out = []
            for k, row in zip(keys, rows):
                if not started or k != current:
                    current, state, started = k, None, True
                state, result = step(state, row)
                out.append(result)
            frame = batch[[key, *order]].copy()
            for i, name in enumerate(names):
                frame[name] = [r[i] for r in out]
            yield frame

    head = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in (key, *order))
    return df.select(*columns).repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, f"{head}, {output}")


def strict_budget(df: DataFrame, key: str, seq: str, cost: str, limit: int, block: int = 1 << 16) -> DataFrame:
    """(key, seq, allowed, remaining) of a budget that a denied request doesn't charge, without one task per key.

    What a block of ``block`` values of ``seq`` does to a budget is a table: from each amount used before to the amount used after. The tables
    of a key's blocks are composed in order, a row a block; then every block is folded from where it starts. ``cost`` is a whole number of
    at least 0, null counts as 0; null keys form one key; rows with a null seq have no place and are left out; a limit of 0 or less allows all.
    """
    rows = df.where(F.col(seq).isNotNull()).select(F.col(key).alias("_k"), F.col(seq).alias("_s"), F.coalesce(F.col(cost), F.lit(0)).cast("long").alias("_c"), F.expr(f"`{seq}` div {int(block)}").alias("_b"))
    types = {n: t for n, t in rows.dtypes}
    most = max(limit, 0)

    def tables(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        every = np.arange(most + 1)
        at, used = None, every

        def done() -> pd.DataFrame:
            return pd.DataFrame({"_k": pd.Series([at[0]], dtype=object), "_b": [at[1]], "after": [used.tolist()]})

        for batch in batches:
            keys = batch["_k"].astype(object).where(batch["_k"].notna(), None)
            for k, b, c in zip(keys, batch["_b"], batch["_c"].tolist()):
                if at != (k, b):
                    if at is not None:
                        yield done()
                    at, used = (k, b), every
                if limit > 0:
                    used = np.where(used + c <= limit, used + c, used)
        if at is not None:
            yield done()

    placed = rows.repartition("_k", "_b").sortWithinPartitions("_k", "_b", "_s")
    after = placed.mapInPandas(tables, f"_k {types['_k']}, _b long, after array<int>")

    def compose(state, row):
        before = state[0] if state else 0
        return (int(row[0][before]),), (before,)

    starts = keyed_fold(after, "_k", ["_b"], ["after"], compose, "start int").select(F.col("_k").alias("_k2"), F.col("_b").alias("_b2"), "start")
    joined = rows.join(starts, F.col("_k").eqNullSafe(F.col("_k2")) & (F.col("_b") == F.col("_b2"))).select("_k", "_b", "_s", "_c", "start")
    plain = strict_budget_step(limit)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state = None, None
        for batch in batches:
            keys = batch["_k"].astype(object).where(batch["_k"].notna(), None)
            out = []
            for k, b, c, start in zip(keys, batch["_b"], batch["_c"].tolist(), batch["start"].tolist()):
                if at != (k, b):
                    at, state = (k, b), (start,)
                state, result = plain(state, (c,))
                out.append(result)
            yield pd.DataFrame({key: batch["_k"], seq: batch["_s"], "allowed": [r[0] for r in out], "remaining": [r[1] for r in out]})

    return joined.repartition("_k", "_b").sortWithinPartitions("_k", "_b", "_s").mapInPandas(fold, f"{key} {types['_k']}, {seq} {types['_s']}, allowed boolean, remaining long")


def strict_budget_step(limit: int) -> Step:
    """A budget that a denied request doesn't charge. Input: (cost); output: (allowed, remaining)."""

    def step(state, row):
        used = state[0] if state else 0
        cost = int(row[0] or 0)
        if limit <= 0:
            return (used,), (True, -1)
        allowed = used + cost <= limit
        used += cost if allowed else 0
        return (used,), (allowed, max(0, limit - used))

    return step


def token_bucket_step(capacity: float, rate: float) -> Step:
    """A token bucket. Input: (now_ms, requested); output: (allowed, wait_ms). Time that runs backwards refills nothing."""

    def step(state, row):
        now, wanted = float(row[0]), float(row[1])
        tokens, then = state or (float(capacity), now)
        tokens = min(capacity, tokens + max(0.0, now - then) / 1000.0 * rate)
        if tokens >= wanted:
            return (tokens - wanted, now), (True, 0)
        return (tokens, now), (False, math.ceil((wanted - tokens) / rate * 1000))

    return step


CLOSED, OPEN, HALF_OPEN = "closed", "open", "half_open"


def breaker_step(threshold: int = 5, reset_seconds: float = 30.0) -> Step:
    """A circuit breaker. Input: (seconds, failed); output: (allowed, state). A request that isn't allowed has no outcome.

    Closed until ``threshold`` failures in a row, then open; after ``reset_seconds`` half open, which lets requests pass: a failure
    opens again at once, a success closes.
    """
    if threshold <= 0:
        raise ValueError("threshold must be positive")

    def step(state, row):
        now, failed = float(row[0]), bool(row[1])
        mode, failures, opened = state or (CLOSED, 0, 0.0)
        if mode == OPEN:
            if now - opened < reset_seconds:
                return (mode, failures, opened), (False, mode)
            mode = HALF_OPEN
        if not failed:
            mode, failures = CLOSED, 0
        elif mode == HALF_OPEN:
            mode, opened = OPEN, now
        else:
            failures += 1
            if failures >= threshold:
                mode, opened = OPEN, now
        return (mode, failures, opened), (True, mode)

    return step

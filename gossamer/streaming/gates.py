"""Stateful gates on streams, with the step functions of the batch folds."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gossamer.operators.state import Step


def keyed_gate(stream: DataFrame, key: str, order: str, inputs: list[str], step: Step, output: str, state: str) -> DataFrame:
    """(key, order, *outputs) of a stream: ``step`` over each key's rows, sorted by ``order`` within a micro-batch.

    ``state`` is the schema of the step's state tuple. Rows that come in a later batch are taken as later, whatever their order.
    A batch's rows of a key arrive in Arrow chunks; only their sort needs them together.
    """
    names = [part.strip().split(" ")[0] for part in output.split(",")]

    def run(k: tuple, chunks: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(chunks), ignore_index=True).sort_values(order, ignore_index=True)
        held = tuple(group.get) if group.exists else None
        out = []
        for row in zip(*[rows[c].tolist() for c in inputs]):
            held, result = step(held, row)
            out.append(result)
        group.update(held)
        frame = rows[[key, order]].copy()
        for i, name in enumerate(names):
            frame[name] = [r[i] for r in out]
        yield frame

    types = {f.name: f.dataType.simpleString() for f in stream.schema}
    schema = f"{key} {types[key]}, {order} {types[order]}, {output}"
    columns = list(dict.fromkeys([key, order, *inputs]))
    return stream.select(*columns).groupBy(key).applyInPandasWithState(run, schema, state, "append", GroupStateTimeout.NoTimeout)


def seen_near(index: dict, fingerprint: int, now: float, bands: int = 4, threshold: int = 3, ttl: float = 7 * 86400.0) -> bool:
    """Whether a live fingerprint of ``index`` shares a band with this one and differs in at most ``threshold`` bits; if not, it is added.

    ``index``: (band, value) to [end, fingerprints]. A bucket lives for ``ttl`` seconds from the last fingerprint added to it.
    """
    width = 64 // bands
    unsigned = fingerprint & ((1 << 64) - 1)
    keys = [(band, (unsigned >> band * width) & ((1 << width) - 1)) for band in range(bands)]
    live = {k: index[k] for k in keys if k in index and now < index[k][0]}
    if any((unsigned ^ other).bit_count() <= threshold for _, held in live.values() for other in held):
        return True
    for k in keys:
        held = live[k][1] if k in live else set()
        held.add(unsigned)
        index[k] = [now + ttl, held]
    return False


def near_duplicate_gate(stream: DataFrame, order: str, fingerprint: str, seconds: str, bands: int = 4, threshold: int = 3, ttl: float = 7 * 86400.0) -> DataFrame:
    """(order, fingerprint, duplicate) of a stream, rows taken by (seconds, order) within a micro-batch, through one index of bands that expires.

    Whether a row is added hangs on all its buckets, and an added row prolongs them: the index is one state, swept each batch, and one
    task folds it. It holds the fingerprints of the last ``ttl`` that aren't near-duplicates. A row that comes late is taken as now.
    """

    def run(_: tuple, chunks: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(chunks), ignore_index=True).sort_values([seconds, order], ignore_index=True)
        index, clock = pickle.loads(group.get[0]) if group.exists else ({}, float("-inf"))
        out = []
        for fp, at in zip(rows[fingerprint].tolist(), rows[seconds].tolist()):
            clock = max(clock, at)
            out.append(seen_near(index, fp, clock, bands, threshold, ttl))
        group.update((pickle.dumps(({k: v for k, v in index.items() if clock < v[0]}, clock)),))
        yield rows[[order, fingerprint]].assign(duplicate=out)

    types = {f.name: f.dataType.simpleString() for f in stream.schema}
    schema = f"{order} {types[order]}, {fingerprint} {types[fingerprint]}, duplicate boolean"
    keyed = stream.select(order, fingerprint, seconds, F.lit(0).alias("_index")).where(F.col(fingerprint).isNotNull() & F.col(seconds).isNotNull())
    return keyed.groupBy("_index").applyInPandasWithState(run, schema, "held binary", "append", GroupStateTimeout.NoTimeout)

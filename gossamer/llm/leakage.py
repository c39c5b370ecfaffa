"""Evaluation texts leaking into training text: size-partitioned MinHash containment search, verified exactly.

Queries are sets of word shingles of items: whole items, or each run of ``run`` words of one. Queries are partitioned by size; a
partition of queries of up to ``u`` shingles has its own domains, namely documents cut into segments of two adjacent blocks of ``u`` shingles,
so that a passage of that size lies whole in one segment and the containment asked for bounds the Jaccard similarity from below,
however long a document is. From that bound follows how many universal minima the partition needs (bands of one minimum: a low
similarity must not be missed).

1. Items give their minima as keys and their shingles; both go into compact filters of bounded size, built in the cluster.
2. Documents are read once. A segment is kept if one of its minima is a key and enough of its shingles are items' shingles.
3. Kept segments meet the items by an equi-join on the keys; every pair is verified on its shingle sets or, for runs, word by word.

The plan is one whatever the number of items: fuller filters only keep more segments for the join.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gossamer.llm.frames import frame
from gossamer.llm.neardup import _P1, _P3, _mix, ordered_shingles, words_of
from gossamer.session import cut_lineage, spread

RUN, WIDTH = 13, 5
#: Share of an item's shingles that a document must hold for the report.
THRESHOLD = 0.5
#: Chance to miss a pair at exactly the threshold, for each partition.
MISS = 1e-4
#: Sizes of the partitions of whole items, in shingles; larger items are cut into queries of the largest size.
SIZES = (16, 32, 64, 128, 256)
#: Largest filter: 2**27 bits, 16 MB.
MAX_BITS = 1 << 27
#: Shingles whose minima are taken at a time.
PIECE = 1 << 14
#: Characters of documents that are searched at a time.
SLICE = 1 << 20
_rng = np.random.RandomState(20240613)
_MULT = (_rng.randint(0, 2**63, 512, dtype=np.int64).astype(np.uint64) << np.uint64(1)) | np.uint64(1)
_ADD = _rng.randint(0, 2**63, 512, dtype=np.int64).astype(np.uint64)
_LANE = _mix(np.arange(1, 513, dtype=np.uint64) * _P3)


@dataclass(frozen=True)
class Partition:
    """Queries of up to ``size`` shingles, at least ``least`` of them, against segments of two blocks of ``size``."""

    size: int
    least: int
    threshold: float

    @property
    def similarity(self) -> float:
        """The least Jaccard similarity of a segment that holds ``threshold`` of a query of ``least`` shingles."""
        held = self.threshold * self.least
        return held / (2 * self.size + self.least - held)

    @property
    def n_minima(self) -> int:
        return min(len(_MULT), max(8, math.ceil(math.log(MISS) / math.log(1 - self.similarity))))


def item_partitions(threshold: float) -> tuple[Partition, ...]:
    return tuple(Partition(u, u // 2 + 1 if i else 1 + u // 4, threshold) for i, u in enumerate(SIZES))


def run_partition(run: int) -> Partition:
    """Runs of ``run`` words: one size, wholly contained. Runs of less than half as many distinct shingles have keys of their own."""
    size = max(1, run - WIDTH + 1)
    return Partition(size, max(1, (size + 1) // 2), 1.0)


def block_minima(shingles: np.ndarray, starts: np.ndarray, n_minima: int) -> np.ndarray:
    """(n_minima × blocks): the least universal hash of each block, by pieces. ``starts``: first shingle of each block, ascending."""
    out = np.empty((n_minima, len(starts)), dtype=np.uint64)
    ends = np.append(starts[1:], len(shingles))
    at = 0
    with np.errstate(over="ignore"):
        while at < len(starts):
            to = max(at + 1, int(np.searchsorted(ends, starts[at] + PIECE, side="right")))
            part = _MULT[:n_minima, None] * shingles[starts[at] : ends[to - 1]] + _ADD[:n_minima, None]
            out[:, at:to] = np.minimum.reduceat(part, starts[at:to] - starts[at], axis=1)
            at = to
    return out


def lane_keys(minima: np.ndarray, size: int) -> np.ndarray:
    """64-bit keys of minima, by lane and partition."""
    with np.errstate(over="ignore"):
        return _mix(minima * _P1 + _LANE[: len(minima), None] + np.uint64(size)).view(np.int64)


def repeat_keys(shingles: np.ndarray, size: int) -> np.ndarray:
    """Keys of the shingles that stand twice within half of ``size`` positions: a run of few distinct shingles holds such a one."""
    twice = [shingles[d:][shingles[d:] == shingles[:-d]] for d in range(1, (size + 1) // 2) if d < len(shingles)]
    found = np.unique(np.concatenate(twice)) if twice else shingles[:0]
    with np.errstate(over="ignore"):
        return _mix(found * _P1 + np.uint64(size) + _P3).view(np.int64)


def query_keys(shingles: np.ndarray, part: Partition) -> np.ndarray:
    distinct = np.unique(shingles)
    if len(distinct) < part.least and part.threshold >= 1:
        return repeat_keys(shingles, part.size)
    return lane_keys(block_minima(distinct, np.zeros(1, dtype=np.int64), part.n_minima), part.size)[:, 0]


class KeySet:
    """A Bloom filter of 64-bit keys with two places a key."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.mask = bits, np.uint64(len(bits) * 64 - 1)

    def has(self, keys: np.ndarray) -> np.ndarray:
        k = keys.view(np.uint64)
        a, b = k & self.mask, (k >> np.uint64(32)) & self.mask
        held = (self.bits[(a >> np.uint64(6)).astype(np.int64)] >> (a & np.uint64(63))) & np.uint64(1) == 1
        at = np.nonzero(held)
        b = b[at]
        held[at] = (self.bits[(b >> np.uint64(6)).astype(np.int64)] >> (b & np.uint64(63))) & np.uint64(1) == 1
        return held


def key_sets(keys: dict[str, tuple[DataFrame, int]]) -> dict[str, KeySet]:
    """A filter for each named column of 64-bit keys (a frame of that one column, and about how many): 16 bits a key up to ``MAX_BITS``.
    The words of all filters are OR-ed in the cluster, in one job."""
    sizes = {name: min(MAX_BITS, 1 << max(10, math.ceil(math.log2(16 * max(n, 1))))) for name, (_, n) in keys.items()}
    parts = []
    for name, (df, _) in keys.items():
        key = F.col(df.columns[0])
        places = df.select(F.explode(F.array(key, F.shiftrightunsigned(key, 32))).alias("h")).select(F.col("h").bitwiseAND(F.lit(sizes[name] - 1)).alias("p"))
        parts.append(places.groupBy(F.lit(name).alias("name"), F.shiftright("p", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(p & 63L as int)))").alias("v")))
    words = reduce(DataFrame.unionAll, parts).toPandas()
    out = {}
    for name, bits in sizes.items():
        mine = words[words["name"] == name]
        flat = np.zeros(bits // 64, dtype=np.uint64)
        flat[mine["w"].to_numpy(dtype=np.int64)] = mine["v"].to_numpy(dtype=np.int64).view(np.uint64)
        out[name] = KeySet(flat)
    return out


QUERIES = "item_id long, query int, size int, keys array<long>, shingles array<long>, words string"


def item_queries(items: DataFrame, run: int | None, threshold: float) -> DataFrame:
    """(item_id, query, size, keys, shingles, words) of each item: its runs of ``run`` words, or the item itself if ``run`` is null.

    Null ids and texts, and items too short, have none. Shingles are distinct.
    """

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for item, text in zip(batch["item_id"], batch["text"]):
                words = words_of(text)
                shingles = ordered_shingles(words, min(WIDTH, run or WIDTH))
                if run:
                    part = run_partition(run)
                    pieces = [(i, part, i + run) for i in range(len(words) - run + 1)]
                else:
                    parts = item_partitions(threshold)
                    most = SIZES[-1]
                    pieces = [(i, next(p for p in parts if min(len(shingles) - i, most) <= p.size), i + most + WIDTH - 1) for i in range(0, len(shingles), most)]
                for i, part, end in pieces:
                    mine = shingles[i : i + (part.size if run else SIZES[-1])]
                    out.append((item, i, part.size, query_keys(mine, part), np.unique(mine).view(np.int64), " ".join(words[i:end])))
            yield pd.DataFrame(out, columns=["item_id", "query", "size", "keys", "shingles", "words"])

    rows = items.select("item_id", "text").where("item_id IS NOT NULL AND text IS NOT NULL").dropDuplicates()
    return rows.mapInPandas(each, QUERIES)


def text_slices(texts: list[str], most: int = SLICE) -> Iterator[tuple[int, int]]:
    """(from, to) of neighbouring texts that together have at most ``most`` characters, or of one longer text."""
    at = total = 0
    for i, t in enumerate(texts):
        if i > at and total + len(t) > most:
            yield at, i
            at, total = i, 0
        total += len(t)
    if at < len(texts):
        yield at, len(texts)


SEGMENTS = "doc_id long, segment int, size int, keys array<long>, held array<long>, said string"


def kept_segments(documents: DataFrame, parts: tuple[Partition, ...], keys: KeySet, known: KeySet, run: int | None) -> DataFrame:
    """(doc_id, segment, size, keys, held, said) of the segments that may hold a query: keys the items share, shingles and words."""
    shipped = documents.sparkSession.sparkContext.broadcast((keys.bits, known.bits))
    width = min(WIDTH, run or WIDTH)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, known = map(KeySet, shipped.value)
        for batch in batches:
            ids, raw = batch["doc_id"].tolist(), batch["text"].tolist()
            rows = []
            for lo, hi in text_slices(raw):
                rows += slice_rows(ids[lo:hi], raw[lo:hi], keys, known)
            yield pd.DataFrame(rows, columns=["doc_id", "segment", "size", "keys", "held", "said"])

    def slice_rows(doc: list[int], raw: list[str], keys: KeySet, known: KeySet) -> list[tuple]:
        texts = [words_of(t) for t in raw]
        each = [ordered_shingles(w, width) for w in texts]
        sizes = np.array([len(s) for s in each], dtype=np.int64)
        first = np.concatenate([[0], np.cumsum(sizes)])
        shingles = np.concatenate(each) if each else np.empty(0, dtype=np.uint64)
        out = []
        if len(shingles):
            flags = np.concatenate([[0], np.cumsum(known.has(shingles.view(np.int64)))])
            for part in parts:
                out += part_segments(part, shingles, sizes, first, flags, keys)
        rows = []
        for d, block, size, found in out:
            s, e = block * size, min((block + 2) * size, int(sizes[d]))
            if run:
                more = repeat_keys(each[d][s:e], size)
                found = np.concatenate([found, more[keys.has(more)]])
            if len(found):
                rows.append((doc[d], block, size, found, np.unique(each[d][s:e]).view(np.int64), " ".join(texts[d][s : e + width - 1])))
        return rows

    def part_segments(part: Partition, shingles, sizes, first, flags, keys: KeySet) -> list[tuple]:
        u = part.size
        n_blocks = -(-sizes // u)
        owner = np.repeat(np.arange(len(sizes)), n_blocks)
        number = np.arange(len(owner)) - np.repeat(np.cumsum(n_blocks) - n_blocks, n_blocks)
        starts = first[owner] + number * u
        minima = block_minima(shingles, starts, part.n_minima)
        # A segment is a block and the next one of the same document; a document's last block stands alone only if it is the first.
        paired = np.flatnonzero((number + 1 < n_blocks[owner]) | (number == 0))
        follows = np.where(number[paired] + 1 < n_blocks[owner[paired]], paired + 1, paired)
        lanes = lane_keys(np.minimum(minima[:, paired], minima[:, follows]), u)
        hit = keys.has(lanes)
        ends = np.minimum(starts[paired] + 2 * u, first[owner[paired] + 1])
        known_here = flags[ends] - flags[starts[paired]]
        need = u if run else max(1, math.ceil(part.threshold * part.least))
        # Runs of few distinct shingles are looked for by their repeats, whatever the minima say.
        kept = np.flatnonzero((known_here >= need) & (hit.any(axis=0) | bool(run)))
        return [(int(owner[paired[k]]), int(number[paired[k]]), u, lanes[hit[:, k], k]) for k in kept.tolist()]

    docs = documents.select("doc_id", "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    return spread(docs).mapInPandas(search, SEGMENTS)


def contained(documents: DataFrame, items: DataFrame, threshold: float = THRESHOLD, run: int | None = None) -> DataFrame:
    """(doc_id, item_id, query, n_shared, n_shingles) of the items' queries that a segment of a document contains.

    With ``run`` a query is a run of so many words, found if they stand in the document one after the other; without, it is the item (in parts
    of 256 shingles if longer), found if a segment holds ``threshold`` of its shingles; the segment that holds most counts. Words are
    ``\\w+`` of the lower-cased text, so case, punctuation and spacing play no part. Null ids and texts, and texts too short, share
    nothing; a document given twice counts once; documents are read whole; other columns play no part.
    """
    # Stored: the filters and the joins read them.
    queries = cut_lineage(item_queries(items, run, threshold).dropDuplicates(["item_id", "query"]))
    index = queries.select("item_id", "query", "size", F.explode("keys").alias("key")).distinct()
    n = queries.agg(F.sum(F.size("keys")), F.sum(F.size("shingles"))).first()
    sets = key_sets({"keys": (queries.select(F.explode("keys")), n[0] or 0), "known": (queries.select(F.explode("shingles")), n[1] or 0)})
    keys, known = sets["keys"], sets["known"]
    parts = (run_partition(run),) if run else item_partitions(threshold)
    kept = kept_segments(documents, parts, keys, known, run).withColumn("key", F.explode("keys")).drop("keys")
    met = kept.join(index, ["size", "key"]).drop("key").dropDuplicates(["doc_id", "segment", "size", "item_id", "query"])
    both = met.join(queries.select("item_id", "query", "shingles", "words"), ["item_id", "query"])
    shared = F.size(F.array_intersect("held", "shingles"))
    scored = both.select("doc_id", "item_id", "query", shared.alias("n_shared"), F.size("shingles").alias("n_shingles"), "said", "words")
    if run:
        blank = F.lit(" ")
        right = scored.where(F.concat(blank, "said", blank).contains(F.concat(blank, "words", blank)))
    else:
        right = scored.where(F.col("n_shared") >= F.lit(threshold) * F.col("n_shingles"))
    return right.groupBy("doc_id", "item_id", "query").agg(F.max("n_shared").alias("n_shared"), F.max("n_shingles").alias("n_shingles"))


def leaked_items(documents: DataFrame, items: DataFrame, run: int = RUN) -> DataFrame:
    """(doc_id, item_id): documents with at least ``run`` consecutive words of an item, a row a pair."""
    return contained(documents, items, 1.0, run).select("doc_id", "item_id").distinct()


def leak_report(documents: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(item_id, n_docs, n_whole, max_containment): per item the documents that hold ``threshold`` of its shingles, edits or not, those that
    hold all of them, and the largest share that one document holds. Items that no document holds have no row."""
    found = contained(documents, items, threshold)
    size = item_queries(items, None, threshold).groupBy("item_id").agg(F.sum(F.size("shingles")).alias("n"))
    pairs = found.groupBy("doc_id", "item_id").agg(F.sum("n_shared").alias("held")).join(size, "item_id")
    share = F.col("held") / F.col("n")
    return pairs.where(share >= threshold).groupBy("item_id").agg(
        F.count("*").alias("n_docs"), F.count_if(F.col("held") == F.col("n")).alias("n_whole"), F.round(F.max(share), 6).alias("max_containment")
    )


def duckdb_leaks(run: int = RUN) -> str:
    """The SQL twin of ``leaked_items``."""

    def windows(id_: str, table: str) -> str:
        return (
            f"SELECT {id_}, unnest(list_transform(generate_series(1, len(w) - {run - 1}), lambda i: array_to_string(w[i:i + {run - 1}], ' '))) AS g "
            f"FROM (SELECT {id_}, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS w FROM {table} WHERE text IS NOT NULL) WHERE len(w) >= {run}"
        )

    return f"SELECT DISTINCT doc_id, item_id FROM ({windows('doc_id', 'documents')}) d JOIN ({windows('item_id', 'eval_item')}) e USING (g)"

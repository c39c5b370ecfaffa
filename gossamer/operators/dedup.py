"""Near-duplicates by SimHash: banded candidate pairs and greedy leaders."""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from math import comb

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gossamer.functions.text import BITS, band_values, hamming, signed64
from gossamer.session import cut_lineage

#: Fingerprints below which leaders are found in one generation.
SMALL = 20_000


def fingerprint_pairs(fingerprints: DataFrame, bands: int = 4, threshold: int = 3) -> DataFrame:
    """(a, b), a < b: different fingerprints (column fp) that share a band and differ in at most ``threshold`` bits.

    Complete while threshold < bands; beyond that pairs without a common band are not found. Equal fingerprints are one.
    """
    banded = fingerprints.where("fp IS NOT NULL").select("fp").distinct().select("fp", F.posexplode(band_values(F.col("fp"), bands)).alias("band", "value"))
    left = banded.withColumnRenamed("fp", "a")
    right = banded.withColumnRenamed("fp", "b")
    return left.join(right, ["band", "value"]).where((F.col("a") < F.col("b")) & (hamming(F.col("a"), F.col("b")) <= threshold)).select("a", "b").distinct()


def _key_masks(bands: int, threshold: int, most: int = 40) -> list[int]:
    """Bits that two fingerprints have in common under at least one mask if they count as candidates.

    Of threshold + k blocks, k are equal in any two fingerprints within ``threshold`` bits, so below ``bands`` every choice of k blocks is a
    mask: complete as the bands are, but of k blocks of bits instead of one. From ``bands`` on the bands themselves.
    """
    if threshold >= bands:
        width = BITS // bands
        return [((1 << width) - 1) << (i * width) for i in range(bands)]
    kept = max(k for k in (1, 2, 3) if k == 1 or comb(threshold + k, k) <= most)
    n = threshold + kept
    ends = [BITS * i // n for i in range(n + 1)]
    blocks = [(1 << b) - (1 << a) for a, b in zip(ends, ends[1:])]
    return [sum(chosen) for chosen in combinations(blocks, kept)]


def _near(late: DataFrame, early: DataFrame, masks: list[int], threshold: int) -> DataFrame:
    """(late, early): nodes of two tables (node, fp) of which the second has the lesser node and differs in at most ``threshold`` bits. Each pair
    once, from the first mask that it agrees under."""
    bits = [F.lit(signed64(m)).cast("long") for m in masks]

    def keyed(rows: DataFrame, node: str, fp: str) -> DataFrame:
        return rows.select(F.col("node").alias(node), F.col("fp").alias(fp), F.posexplode(F.array(*[F.col("fp").bitwiseAND(m) for m in bits])).alias("mask", "value"))

    differ = F.col("fp_late").bitwiseXOR(F.col("fp_early"))
    first = reduce(lambda rest, k: F.when(differ.bitwiseAND(bits[k]) == 0, k).otherwise(rest), reversed(range(len(bits))), F.lit(None).cast("int"))
    pairs = keyed(late, "late", "fp_late").join(keyed(early, "early", "fp_early"), ["mask", "value"])
    return pairs.where((F.col("early") < F.col("late")) & (hamming(F.col("fp_late"), F.col("fp_early")) <= threshold) & (first == F.col("mask"))).select("late", "early")


def _generations(firsts: DataFrame) -> tuple[DataFrame, list]:
    """``firsts`` (node, fp), and the last nodes of its first 1/64 and 1/8 by order; none for a small table."""
    if firsts.count() < SMALL:
        return firsts, []
    ranged = cut_lineage(firsts.repartitionByRange(64, "node"))
    last = [r["last"] for r in ranged.groupBy(F.spark_partition_id().alias("part")).agg(F.max("node").alias("last")).orderBy("part").collect()]
    return ranged, [last[0], last[len(last) // 8]] if len(last) > 8 else []


def _first_independent(nodes: DataFrame, edges: DataFrame) -> list[DataFrame]:
    """The nodes, in parts, of the lexicographically first maximal independent set of stored ``edges`` (late, early)."""
    new = cut_lineage(nodes.select("node").join(edges.select(F.col("late").alias("node")), "node", "left_anti"))
    rounds, waiting = [new], edges
    # Only what a round decides is stored, and the edges that are still open.
    while waiting.take(1):
        led = waiting.join(new.select(F.col("node").alias("early")), "early", "left_semi").select(F.col("late").alias("node")).distinct()
        left = waiting.join(led.select(F.col("node").alias("late")), "late", "left_anti")
        still = left.join(led.select(F.col("node").alias("early")), "early", "left_anti").select("late", "early")
        free = left.select("late").distinct().join(still.select("late"), "late", "left_anti")
        # Both in one job: open edges, and new leaders as edges to nothing.
        both = cut_lineage(still.unionAll(free.select("late", F.lit(None).cast(still.schema["early"].dataType).alias("early"))))
        new, waiting = both.where("early IS NULL").select(F.col("late").alias("node")), both.where("early IS NOT NULL")
        rounds.append(new)
    return rounds


def greedy_leaders(rows: DataFrame, bands: int = 4, threshold: int = 3) -> DataFrame:
    """(id, fp, duplicate): rows in order of id; a row is a duplicate iff an earlier leader is within ``threshold`` bits.

    Duplicates lead nothing, so the result is the lexicographically first maximal independent set of the candidate graph. Equal
    fingerprints collapse to their first row before pairing: the others are duplicates. A round takes the fingerprints without open
    earlier neighbours as leaders and their later neighbours as duplicates. Null fingerprints are never duplicates. ``rows``: id (unique), fp.

    A large table is decided in generations by order of id: the leaders of a generation meet all later rows, and only rows that none of
    them is near go on. So a dense cluster goes with its first leaders, and its other pairs are never formed.
    """
    masks = _key_masks(bands, threshold)
    held = rows.where("fp IS NOT NULL")
    left, lasts = _generations(cut_lineage(held.groupBy("fp").agg(F.min("id").alias("node")).select("node", "fp")))
    parts: list[DataFrame] = []
    for last in [*lasts, None]:
        now = left if last is None else left.where(F.col("node") <= F.lit(last))
        found = _first_independent(now, cut_lineage(_near(now, now, masks, threshold)))
        parts += found
        if last is not None:
            later = left.where(F.col("node") > F.lit(last))
            leaders = now.join(reduce(DataFrame.unionAll, found), "node", "left_semi")
            left = cut_lineage(later.join(_near(later, leaders, masks, threshold).select(F.col("late").alias("node")), "node", "left_anti"))
    leaders = reduce(DataFrame.unionAll, parts).select(F.col("node").alias("id"), F.lit(True).alias("is_leader"))
    return rows.join(leaders, "id", "left").select("id", "fp", (F.col("fp").isNotNull() & F.col("is_leader").isNull()).alias("duplicate"))

"""Running totals and maxima per key without one task per key.

A window over (key order by seq) puts all rows of a key into one task. Here the rows of a key are cut into blocks of consecutive
positions: partial results per block, an exclusive prefix over a key's few blocks, then a window inside each block.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def blocked_scan(df: DataFrame, key: str, seq: str, value: str, out: str, kind: str = "sum", block: int = 1 << 16) -> DataFrame:
    """``df`` with ``out``: inclusive running sum or max of ``value`` per ``key`` in order of ``seq``.

    ``seq`` is an integer; a block is a range of ``block`` values of it, so a block holds that many rows of a key at most if seq is unique.
    Rows with equal key and seq get the same total, as a RANGE frame gives. Null values don't count; null keys form one key; rows
    with a null seq have no place in the order and are left out.
    """
    if kind not in ("sum", "max"):
        raise ValueError(kind)
    agg = F.sum if kind == "sum" else F.max
    # A string key without nulls lets one shuffle by (key, block) serve the window and the join; the totals move a row a block.
    blocked = df.withColumn("_scan_key", F.coalesce(F.concat(F.lit("k"), F.col(key).cast("string")), F.lit("null"))).withColumn("_scan_block", F.expr(f"`{seq}` div {int(block)}"))
    totals = blocked.groupBy("_scan_key", "_scan_block").agg(agg(value).alias("_scan_total"))
    earlier = Window.partitionBy("_scan_key").orderBy("_scan_block").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("_scan_key", "_scan_block", agg("_scan_total").over(earlier).alias("_scan_before"))
    inside = Window.partitionBy("_scan_key", "_scan_block").orderBy(seq).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    joined = blocked.withColumn("_scan_here", agg(value).over(inside)).join(before, ["_scan_key", "_scan_block"])
    total = F.coalesce("_scan_before", F.lit(0)) + F.coalesce("_scan_here", F.lit(0)) if kind == "sum" else F.greatest("_scan_here", "_scan_before")
    return joined.withColumn(out, total).select(*df.columns, out)

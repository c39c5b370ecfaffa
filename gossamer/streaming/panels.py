"""Dashboard panels as window aggregates over an event stream or table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gossamer.streaming import frontier


def rates(events: DataFrame, time: str, by: str, width: str = "5 minutes", slide: str = "1 minute", seconds: int = 300, late: str = "10 minutes") -> DataFrame:
    """(window_end, by, n, per_second) over sliding windows; on a stream, windows close ``late`` after their end."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    counted = rows.groupBy(F.window(time, width, slide).alias("w"), by).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.end").alias("window_end"), by, "n", (F.col("n") / F.lit(float(seconds))).alias("per_second"))


def bucket_counts(value: Column, buckets: Sequence[float]) -> list[Column]:
    return [F.count_if(value <= b).alias(f"le_{i}") for i, b in enumerate(buckets)]


def histogram_quantile(counts: Sequence[Column], total: Column, buckets: Sequence[float], q: float) -> Column:
    """Quantile of cumulative bucket counts, linear inside a bucket, the first from 0; beyond the last bound that bound; null without rows."""
    rank = total * F.lit(q)
    out = F.lit(float(buckets[-1]))
    for i in reversed(range(len(buckets))):
        low = F.lit(float(buckets[i - 1]) if i else 0.0)
        below = counts[i - 1] if i else F.lit(0)
        inside = counts[i] - below
        at = low + (F.lit(float(buckets[i])) - low) * F.when(inside > 0, (rank - below) / inside).otherwise(0.0)
        out = F.when(counts[i] >= rank, at).otherwise(out)
    return F.when(total > 0, out)


def latency_quantiles(events: DataFrame, time: str, value: str, buckets: Sequence[float], width: str = "5 minutes") -> DataFrame:
    """(window_end, n, p50, p95, p99) from bucket counts alone, as a histogram metric gives them."""
    per = events.groupBy(F.window(time, width).alias("w")).agg(F.count(value).alias("n"), *bucket_counts(F.col(value), buckets))
    cols = [F.col(f"le_{i}") for i in range(len(buckets))]
    return per.select(F.col("w.end").alias("window_end"), "n", *[histogram_quantile(cols, F.col("n"), buckets, q).alias(name) for name, q in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))])


def polled_counts(stream: DataFrame, by: str, name: str) -> DataFrame:
    """Counts by ``by`` of a stream as they stand once it is drained, as a table in the shared folder that a display may ask at any time."""
    return frontier.drain(stream.groupBy(by).agg(F.count("*").alias("n")), name, "complete")

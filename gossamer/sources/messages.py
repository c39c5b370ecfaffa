"""Frontier messages: codec, partitioning by domain, and routing of what failed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gossamer.functions.scalars import RETRY_CAP_SECONDS
from gossamer.operators.sharding import Ring, assign

MESSAGE = "url string, depth int, crawl_id int, attempts int, not_before double"
PARTITIONS, MAX_ATTEMPTS = 6, 3


def encode(df: DataFrame) -> Column:
    """JSON of a message, all fields present, null ones as null."""
    return F.to_json(F.struct("url", "depth", "crawl_id", "attempts", "not_before"), {"ignoreNullFields": "false"})


def decode(df: DataFrame, column: str) -> DataFrame:
    """Columns of the messages in ``column``; missing fields take their defaults; what isn't a JSON object with a url is dropped."""
    m = F.from_json(column, MESSAGE, {"mode": "PERMISSIVE"})
    rows = df.withColumn("_m", m).where("_m.url IS NOT NULL")
    return rows.select(
        *[c for c in df.columns if c != column], "_m.url", F.coalesce("_m.depth", F.lit(0)).alias("depth"), "_m.crawl_id",
        F.coalesce("_m.attempts", F.lit(0)).alias("attempts"), F.coalesce("_m.not_before", F.lit(0.0)).alias("not_before"),
    )


def to_items(messages: DataFrame) -> DataFrame:
    """(url, depth, crawl_id): what a worker needs."""
    return messages.select("url", "depth", "crawl_id")


def partition_ring(partitions: int = PARTITIONS) -> Ring:
    return Ring([str(i) for i in range(partitions)])


def with_partition(messages: DataFrame, domain: str, partitions: int = PARTITIONS) -> DataFrame:
    """``messages`` with ``partition``: all messages of a domain in one."""
    return messages.withColumn("partition", assign(partition_ring(partitions))(F.col(domain)).cast("int"))


def route_failures(failed: DataFrame, now: float, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """``failed`` messages with ``topic`` retry or dlq, attempts raised by one on retry, and not_before by min(2**attempts, 30) s.

    Input: the message columns and ``skipped``; only fetch errors are routed, other skips are dropped.
    """
    errors = failed.where("skipped = 'fetch_error'")
    again = F.col("attempts") < max_attempts
    return errors.withColumn("topic", F.when(again, "retry").otherwise("dlq")).withColumn(
        "not_before", F.when(again, F.lit(now) + F.least(F.pow(F.lit(2.0), F.col("attempts")), F.lit(float(RETRY_CAP_SECONDS)))).otherwise(F.col("not_before"))
    ).withColumn("attempts", F.when(again, F.col("attempts") + 1).otherwise(F.col("attempts")))


TOPICS = {"frontier": PARTITIONS, "parsed": PARTITIONS, "retry": PARTITIONS, "dlq": 1}


def create_topics(spark, folder: str) -> DataFrame:
    """(topic, partitions): a folder a topic and partition under ``folder``, made where it is missing."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    for topic, partitions in TOPICS.items():
        for i in range(partitions):
            path = hadoop.Path(f"{folder}/{topic}/partition={i}")
            path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    return spark.createDataFrame(list(TOPICS.items()), "topic string, partitions int")

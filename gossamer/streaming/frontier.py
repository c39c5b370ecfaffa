"""The frontier as a stream: at-least-once batches, seen keys, retries and dead letters, delayed redelivery."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gossamer.session import shared_dir


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under the shared one, for a stream's output and checkpoint."""
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


def file_stream(spark: SparkSession, path: str, schema, files_per_batch: int | None = None) -> DataFrame:
    """A stream of the Parquet files at ``path`` (a folder or one file); ``files_per_batch`` is the back-pressure."""
    reader = spark.readStream.schema(schema).option("recursiveFileLookup", "true")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if os.path.isfile(path):
        reader = reader.option("pathGlobFilter", os.path.basename(path))
        path = os.path.dirname(path)
    return reader.parquet(path)


@contextmanager
def _settings(spark: SparkSession, values: dict[str, object]) -> Iterator[None]:
    """The session with these settings; a stream keeps those it was started under."""
    held = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in held.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def small_batches(spark: SparkSession) -> dict[str, object]:
    """Settings of a stream of many small batches with state: a batch opens and commits the state of every partition, however few rows it has,
    so there are as many as cores. What a batch changes is logged, and the state lies outside the heap."""
    store = "spark.sql.streaming.stateStore"
    return {
        "spark.sql.shuffle.partitions": spark.sparkContext.defaultParallelism,
        f"{store}.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        f"{store}.rocksdb.changelogCheckpointing.enabled": "true",
    }


def drain(stream: DataFrame, name: str, mode: str = "append", settings: dict[str, object] | None = None) -> DataFrame:
    """Run a stream over what is there, into Parquet under the shared folder, and give the result as a table.

    Every micro-batch writes its own folder, so a replayed batch overwrites itself: at-least-once delivery, exactly-once result.
    In complete mode the last batch is the result. ``settings`` hold for the stream alone.
    """
    spark = stream.sparkSession
    out = scratch(spark, name)

    def write(batch: DataFrame, number: int) -> None:
        target = f"{out}/data/batch={0 if mode == 'complete' else number}"
        batch.write.mode("overwrite").parquet(target)

    with _settings(spark, settings or {}):
        running = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{out}/state").foreachBatch(write).trigger(availableNow=True).start()
    running.awaitTermination()
    rows = spark.read.schema(stream.schema).parquet(f"{out}/data/batch=*") if _written(spark, f"{out}/data") else spark.createDataFrame([], stream.schema)
    return rows


def _written(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def unseen_stream(messages: DataFrame, key: str) -> DataFrame:
    """The first message of each key, with exact keyed state in the state store."""
    return messages.dropDuplicates([key])


def unseen_within(messages: DataFrame, key: str, time: str, delay: str) -> DataFrame:
    """The first message of each key within ``delay``: state older than the watermark is dropped, as an expiring index would."""
    return messages.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def split_topics(routed: DataFrame, number: int, folder: str) -> None:
    """``foreachBatch`` sink: a batch's retry and dead letters to a folder each, overwritten on replay."""
    held = routed.persist()
    for topic in ("retry", "dlq"):
        held.where(F.col("topic") == topic).write.mode("overwrite").parquet(f"{folder}/{topic}/batch={number}")
    held.unpersist()


def due_split(messages: DataFrame, now: float) -> tuple[DataFrame, DataFrame]:
    """(due, waiting): a message isn't delivered before its not_before; what waits goes round again."""
    return messages.where(F.col("not_before") <= now), messages.where(F.col("not_before") > now)

"""Spark session helper, and the one way this library cuts a lineage."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "gossamer", master: str | None = None, **conf: object) -> SparkSession:
    """A session with the settings the operators count on; every setting can be overridden."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    settings.update({k: str(v) for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder. A local session that names none (tests, a laptop) gets a temporary one; a cluster must name
    one, as no executor could read another machine's."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(named)
        return named
    held = spark.sparkContext.getCheckpointDir()
    if held is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix=f"gossamer-{os.getpid()}-"))
        held = spark.sparkContext.getCheckpointDir()
    return held


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` stored in the shared folder, so that a lost executor costs no recomputation beyond this point."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Operators after which the number of partitions is no longer that of the files.
_MOVING = ("Join", "Aggregate", "Repartition", "Sort", "Distinct", "Deduplicate", "Window")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many partitions as there are cores, for work in Python. Only a table of a few small files is moved: a large
    one has more splits than that, and what was shuffled is left to AQE."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    if df.isStreaming or any(word in plan for word in _MOVING):
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once an application; needed where it isn't installed there."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    import shutil

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    held = tempfile.mkdtemp(prefix="gossamer-zip-")
    stage = os.path.join(held, "stage")
    shutil.copytree(os.path.join(root, "gossamer"), os.path.join(stage, "gossamer"), ignore=shutil.ignore_patterns("__pycache__"))
    context.addPyFile(shutil.make_archive(os.path.join(held, "gossamer"), "zip", stage))
    _shipped.add(context.applicationId)

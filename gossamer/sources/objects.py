"""Content-addressed body store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gossamer.functions.html import gunzip, gzip

BACKENDS = {"noop": "", "sql": "pg:", "minio": "s3://bodies/"}


def storage_key(backend: str, content_hash):
    """Key under which a backend keeps a body: "" if it keeps none."""
    if backend not in BACKENDS:
        raise ValueError(f"unknown backend {backend!r}")
    return F.lit("") if backend == "noop" else F.concat(F.lit(BACKENDS[backend]), content_hash)


def pack_bodies(bodies: DataFrame) -> DataFrame:
    """(content_hash, body, content_type, size): each distinct raw body once, gzipped, named by its SHA-256; empty bodies and nulls go.

    ``bodies``: raw binary, content_type. Grouping is by hash, and of a group one row stays, so copies cost no memory.
    """
    rows = bodies.where("raw IS NOT NULL AND octet_length(raw) > 0").select(F.sha2("raw", 256).alias("content_hash"), "raw", "content_type", F.octet_length("raw").alias("size"))
    return rows.dropDuplicates(["content_hash"]).select("content_hash", gzip("raw").alias("body"), "content_type", "size")


def unpack_bodies(stored: DataFrame) -> DataFrame:
    """(content_hash, raw) of stored bodies."""
    return stored.select("content_hash", gunzip("body").alias("raw"))

"""Write side of the crawl store: upserts and insert-or-ignore as set operations over tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gossamer.functions.url import normalize_href
from gossamer.session import cut_lineage

#: Columns that a later fetch overwrites; first_seen, in_degree and registered_domain stay as first written.
OVERWRITTEN = (
    "http_status", "content_type", "content_length", "title", "content_hash", "simhash", "storage_key", "etag",
    "last_modified", "depth", "out_degree", "crawl_id", "last_crawled",
)


def upsert_documents(base: DataFrame, incoming: DataFrame, seq: str) -> DataFrame:
    """``base`` after the rows of ``incoming`` in order of ``seq``: one row a url, later rows overwriting.

    Both have the document columns; ``incoming`` has ``seq`` besides, unique per url. New urls get ids above the base's largest, in
    order of url. The order within a url is an aggregate (max_by), so no window gathers a hot url's rows. Null urls are dropped.
    """
    columns = base.columns
    kept = [c for c in columns if c not in OVERWRITTEN]
    rows = base.withColumn("_seq", F.lit(None).cast("long")).unionByName(incoming.withColumnRenamed(seq, "_seq").select(*columns, F.col("_seq").cast("long"))).where("url IS NOT NULL")
    order = F.coalesce(F.col("_seq"), F.lit(-1))
    last = F.max_by(F.struct(*OVERWRITTEN), order).alias("_last")
    first = F.min_by(F.struct(*kept), order).alias("_first")
    merged = rows.groupBy("url").agg(last, first, F.max(F.col("_seq").isNull()).alias("_known"))
    flat = merged.select(*[F.col(f"_{'last' if c in OVERWRITTEN else 'first'}.{c}").alias(c) for c in columns], "_known")
    return _with_ids(flat, base, columns)


def _with_ids(flat: DataFrame, base: DataFrame, columns: list[str]) -> DataFrame:
    """Ids for the rows that were not ``_known``: ranges of a url order, numbered by partition, so no task sees them all."""
    known = flat.where("_known").select(*columns)
    fresh = flat.where("NOT _known").repartitionByRange("url").sortWithinPartitions("url").withColumn("_p", F.spark_partition_id())
    # Stored, because a second evaluation could cut the ranges elsewhere.
    numbered = cut_lineage(fresh.withColumn("_n", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    sizes = numbered.groupBy("_p").agg((F.max("_n") + 1).alias("_size"))
    # One row a partition.
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    earlier = sizes.select("_p", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    top = base.agg(F.coalesce(F.max("id"), F.lit(0))).scalar()
    ids = numbered.join(earlier, "_p").withColumn("id", (top + 1 + F.col("_offset") + F.col("_n")).cast("long"))
    return known.unionByName(ids.select(*columns))


def insert_edges(base: DataFrame, incoming: DataFrame) -> DataFrame:
    """(src_document_id, dst_url, anchor_text): ``base`` and the pairs that it lacks; of repeated new pairs that with the least id."""
    pair = ["src_document_id", "dst_url"]
    first = incoming.groupBy(*pair).agg(F.min_by("anchor_text", "id").alias("anchor_text"))
    new = first.join(base.select(*pair), pair, "left_anti")
    return base.groupBy(*pair).agg(F.min_by("anchor_text", "id").alias("anchor_text")).unionByName(new.select(*pair, "anchor_text"))


def insert_bodies(base: DataFrame, incoming: DataFrame) -> DataFrame:
    """Bodies by content_hash: those of ``base``, and one of each hash that it lacks; null hashes are dropped."""
    new = incoming.where("content_hash IS NOT NULL").join(base.select("content_hash"), "content_hash", "left_anti").dropDuplicates(["content_hash"])
    return base.where("content_hash IS NOT NULL").dropDuplicates(["content_hash"]).unionByName(new.select(*base.columns))


def delete_crawl(document: DataFrame, crawl_id: int) -> DataFrame:
    """Documents after a crawl's row is deleted: their reference becomes null."""
    return document.withColumn("crawl_id", F.when(F.col("crawl_id") != crawl_id, F.col("crawl_id")))


def delete_documents(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges after documents (id) are deleted: theirs go with them."""
    return edges.join(gone.select(F.col("id").alias("src_document_id")), "src_document_id", "left_anti")


def crawl_started(crawls: DataFrame, name: str, seeds: list[str], max_depth: int, max_pages: int, now: str) -> DataFrame:
    """``crawls`` with a new row: running, or failed if no seed is crawlable."""
    if not seeds or not 0 <= max_depth <= 20 or max_pages < 1:
        raise ValueError("a crawl needs a seed, a depth of 0..20 and at least one page")
    good = [s for s in map(normalize_href, seeds) if s]
    top = crawls.agg(F.coalesce(F.max("id"), F.lit(0))).scalar()
    row = crawls.sparkSession.range(1).select(
        (top + 1).cast("int").alias("id"), F.lit(name).alias("name"), F.array(*map(F.lit, good or seeds)).alias("seeds"), F.lit("running" if good else "failed").alias("status"),
        F.lit(max_depth).alias("max_depth"), F.lit(max_pages).alias("max_pages"), F.lit(None).cast("array<string>").alias("allowed_domains"),
        F.lit(now).cast("timestamp").alias("created_at"), F.lit(now).cast("timestamp").alias("updated_at"),
    )
    return crawls.unionByName(row.select(*crawls.columns))


def crawl_stopped(crawls: DataFrame, crawl_id: int, now: str) -> DataFrame:
    """``crawls`` with a running crawl stopped; stopping one that isn't running changes nothing."""
    mine = (F.col("id") == crawl_id) & (F.col("status") == "running")
    return crawls.withColumn("updated_at", F.when(mine, F.lit(now).cast("timestamp")).otherwise(F.col("updated_at"))).withColumn("status", F.when(mine, "stopped").otherwise(F.col("status")))

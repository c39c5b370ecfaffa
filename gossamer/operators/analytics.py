"""Read side of the crawl store: filters, counts, rankings and lookups over document, link_edge and crawl."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gossamer.functions.scalars import status_class

LIMITS = {"documents": 200, "crawls": 200, "domains": 500, "graph": 200, "links": 200}


def checked_limit(what: str, limit: int) -> int:
    """``limit`` if it lies between 1 and what ``what`` allows; otherwise ValueError."""
    if not 1 <= limit <= LIMITS[what]:
        raise ValueError(f"{what}: limit must be 1..{LIMITS[what]}")
    return limit


def document_filter(domain: str | None = None, q: str | None = None) -> Column:
    """Rows of one domain and with ``q`` in url or title whatever the case; % and _ in q stay wildcards; empty means no filter."""
    cond = F.lit(True)
    if domain:
        cond = cond & (F.col("registered_domain") == domain)
    if q:
        cond = cond & (F.col("url").ilike(f"%{q}%") | F.coalesce(F.col("title").ilike(f"%{q}%"), F.lit(False)))
    return cond


def stale(now: str, age_seconds: float) -> Column:
    """Never crawled, or last crawled before now - age; strictly."""
    return F.col("last_crawled").isNull() | (F.unix_micros("last_crawled") < F.unix_micros(F.lit(now).cast("timestamp")) - F.lit(int(age_seconds * 1e6)))


def document_counts(document: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: documents, edges, distinct domains, content hashes on more than one row."""
    shared = document.where("content_hash IS NOT NULL").groupBy("content_hash").agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").alias("near_duplicates")).scalar()
    n_edges = edges.agg(F.count("*")).scalar()
    return document.agg(F.count("*").alias("documents"), F.countDistinct("registered_domain").alias("domains")).select(
        "documents", n_edges.alias("edges"), "domains", shared.alias("near_duplicates")
    )


def status_histogram(document: DataFrame) -> DataFrame:
    """(http_status, n): null is a group."""
    return document.groupBy("http_status").agg(F.count("*").alias("n"))


def top_domains(document: DataFrame, limit: int) -> DataFrame:
    """Domains by documents, ties by name."""
    ranked = document.groupBy("registered_domain").agg(F.count("*").alias("n"))
    return ranked.orderBy(F.desc("n"), F.asc_nulls_first("registered_domain")).limit(checked_limit("domains", limit))


def degrees(document: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, url, out_degree, in_degree) recomputed from the edge table: one row a row of document.

    Edges are counted per end before they meet the documents, so a much-linked url costs the join one row.
    """
    out = edges.groupBy(F.col("src_document_id").alias("_src")).agg(F.count("*").alias("_out"))
    into = edges.groupBy(F.col("dst_url").alias("_dst")).agg(F.count("*").alias("_in"))
    return (
        document.select("id", "url")
        .join(out, F.col("id") == F.col("_src"), "left")
        .join(into, F.col("url") == F.col("_dst"), "left")
        .select("id", "url", F.coalesce("_out", F.lit(0)).alias("out_degree"), F.coalesce("_in", F.lit(0)).alias("in_degree"))
    )


def crawl_summaries(crawl: DataFrame, document: DataFrame) -> DataFrame:
    """Every crawl with its number of documents, 0 if none."""
    per = document.groupBy(F.col("crawl_id").alias("_crawl")).agg(F.count("*").alias("_n"))
    return crawl.join(per, F.col("id") == F.col("_crawl"), "left").select("id", "name", "status", "max_depth", "max_pages", F.coalesce("_n", F.lit(0)).alias("documents"))


def nearest_rank(df: DataFrame, key: str, value: str, q: float, buckets: int = 32) -> DataFrame:
    """(key, n, value): sorted[min(n - 1, int(q * n))] per key, exactly, without sorting a key in one task.

    Approximate quantiles cut a key's range into buckets; the bucket that holds the rank is found by counting; only its distinct
    values, with their counts, are ranked. Null values don't count; a key without values has no row.
    """
    rows = df.select(F.col(key).alias("k"), F.col(value).cast("double").alias("v")).where("v IS NOT NULL")
    cuts = rows.groupBy(F.col("k").alias("ck")).agg(F.percentile_approx("v", [i / buckets for i in range(1, buckets)], 500).alias("cuts"))
    # One row a key, of at most ``buckets`` numbers; AQE decides whether it is small enough to broadcast.
    placed = rows.join(cuts, F.col("k").eqNullSafe(F.col("ck"))).select("k", "v", F.size(F.filter("cuts", lambda c: c < F.col("v"))).alias("b"))
    counts = placed.groupBy("k", "b").agg(F.count("*").alias("nb"))
    per_key = counts.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("b", "nb"))).alias("bs"), F.sum("nb").alias("n"))  # at most ``buckets`` entries
    target = per_key.withColumn("rank", F.least(F.col("n") - 1, F.floor(F.col("n") * F.lit(q)).cast("long")))
    step = F.aggregate(
        "bs",
        F.struct(F.lit(0).cast("long").alias("seen"), F.lit(-1).alias("b"), F.lit(0).cast("long").alias("before")),
        lambda acc, x: F.when((acc["b"] < 0) & (acc["seen"] + x["nb"] > F.col("rank")), F.struct((acc["seen"] + x["nb"]).alias("seen"), x["b"].alias("b"), acc["seen"].alias("before")))
        .otherwise(F.struct((acc["seen"] + x["nb"]).alias("seen"), acc["b"].alias("b"), acc["before"].alias("before"))),
    )
    spot = target.withColumn("s", step).select(F.col("k").alias("sk"), "n", "rank", F.col("s.b").alias("sb"), F.col("s.before").alias("before"))
    inside = placed.join(spot, F.col("k").eqNullSafe(F.col("sk")) & (F.col("b") == F.col("sb"))).groupBy("k", "n", "rank", "before", "v").agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy("k").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = inside.withColumn("upto", F.col("before") + upto).where(F.col("upto") > F.col("rank"))
    return ranked.groupBy("k", "n").agg(F.min("v").alias("v")).select(F.col("k").alias(key), "n", F.col("v").alias(value))


def class_profile(document: DataFrame) -> DataFrame:
    """(status_class, n, bytes)."""
    return document.groupBy(status_class(F.col("http_status")).alias("status_class")).agg(F.count("*").alias("n"), F.sum(F.coalesce("content_length", F.lit(0)).cast("long")).alias("bytes"))

"""The read and control side as a facade: every method returns a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gossamer.functions.scalars import iso_utc
from gossamer.operators import analytics, graph, writes


class CrawlAnalytics:
    """Questions about the tables of one folder (document, link_edge and crawl as Parquet)."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def stats(self) -> DataFrame:
        """(documents, edges, domains, near_duplicates)."""
        return analytics.document_counts(self.table("document"), self.table("link_edge"))

    def status_histogram(self) -> DataFrame:
        return analytics.status_histogram(self.table("document"))

    def documents(self, limit: int = 50, offset: int = 0, domain: str | None = None, q: str | None = None) -> DataFrame:
        """A page of documents, newest first."""
        rows = self.table("document").where(analytics.document_filter(domain, q)).select("id", "url", "title", "registered_domain", "http_status", iso_utc(F.col("last_crawled")).alias("last_crawled"))
        return rows.orderBy(F.desc("id"), "url").offset(max(0, offset)).limit(analytics.checked_limit("documents", limit))

    def document_total(self, domain: str | None = None, q: str | None = None) -> DataFrame:
        return self.table("document").where(analytics.document_filter(domain, q)).agg(F.count("*").alias("total"))

    def document(self, doc_id: int) -> DataFrame:
        """The rows of a document; none if there is none."""
        return self.table("document").where(F.col("id") == doc_id)

    def links(self, doc_id: int, limit: int = 200) -> DataFrame:
        """Links of a document in order of target."""
        return self.table("link_edge").where(F.col("src_document_id") == doc_id).select("dst_url", "anchor_text").distinct().orderBy("dst_url", "anchor_text").limit(analytics.checked_limit("links", limit))

    def domains(self, limit: int = 50) -> DataFrame:
        return analytics.top_domains(self.table("document"), limit)

    def graph(self, limit: int = 20) -> DataFrame:
        """The most linked pages by recomputed degrees."""
        nodes = analytics.degrees(self.table("document"), self.table("link_edge")).distinct()
        return nodes.orderBy(F.desc("in_degree"), "url", "id").limit(analytics.checked_limit("graph", limit))

    def crawls(self, limit: int = 50) -> DataFrame:
        rows = analytics.crawl_summaries(self.table("crawl"), self.table("document"))
        return rows.orderBy(F.desc("id")).limit(analytics.checked_limit("crawls", limit))

    def create_crawl(self, name: str, seeds: list[str], max_depth: int, max_pages: int, now: str) -> DataFrame:
        """The crawl table with a new row; ValueError if the request isn't valid."""
        return writes.crawl_started(self.table("crawl"), name, seeds, max_depth, max_pages, now)

    def stop_crawl(self, crawl_id: int, now: str) -> DataFrame:
        return writes.crawl_stopped(self.table("crawl"), crawl_id, now)

    def crawl(self, seeds: list[str], max_depth: int, max_pages: int | None = None) -> DataFrame:
        """(url, depth) that a crawl from ``seeds`` reaches over the stored link graph."""
        start = self.spark.createDataFrame([(s,) for s in seeds], "url string")
        return graph.bfs(start, graph.page_links(self.table("document"), self.table("link_edge")), max_depth, max_pages)

    def recrawl(self, now: str, age_seconds: float, limit: int = 100) -> DataFrame:
        """The stalest documents, never crawled first."""
        rows = self.table("document").where(analytics.stale(now, age_seconds))
        return rows.select("url", "crawl_id", "last_crawled").orderBy(F.asc_nulls_first("last_crawled"), "url").limit(limit)

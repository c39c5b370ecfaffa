"""Breadth-first traversal of the link graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gossamer.functions.url import registered_domain
from gossamer.session import cut_lineage


def bfs(seeds: DataFrame, edges: DataFrame, max_depth: int, max_pages: int | None = None) -> DataFrame:
    """(url, depth): every url within ``max_depth`` links of a seed (url), at its least depth, seeds at 0.

    ``edges``: src, dst. A level is one job: join, distinct, anti-join with what was seen, checkpoint; the loop stops at an empty
    level or, with ``max_pages``, once that many are known, of which those first by (depth, url) stay. Null urls and ends don't count.
    """
    # Stored once: every level reads it.
    links = cut_lineage(edges.where("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst").distinct())
    level = cut_lineage(seeds.where("url IS NOT NULL").select("url").distinct())
    levels, known = [level.withColumn("depth", F.lit(0))], level.count()
    for depth in range(1, max_depth + 1):
        if max_pages is not None and known >= max_pages:
            break
        seen = reduce(DataFrame.unionAll, [x.select("url") for x in levels])
        reached = level.join(links, level["url"] == links["src"]).select(F.col("dst").alias("url")).distinct()
        level = cut_lineage(reached.join(seen, "url", "left_anti"))
        n = level.count()
        if not n:
            break
        known += n
        levels.append(level.withColumn("depth", F.lit(depth)))
    out = reduce(DataFrame.unionAll, levels)
    return out if max_pages is None else out.orderBy("depth", "url").limit(max_pages)


def page_links(document: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst) urls of the link graph."""
    owners = document.select(F.col("id").alias("src_document_id"), F.col("url").alias("src")).distinct()
    return edges.join(owners, "src_document_id").select("src", F.col("dst_url").alias("dst")).distinct()


def first_pages(rows: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows in ``order``, with their position from 1: the cut-off of a page limit in arrival order."""
    kept = rows.orderBy(*order).limit(n)
    # The window sees at most n rows, a page limit.
    return kept.withColumn("position", F.row_number().over(Window.orderBy(*order)))


def domain_rules(crawls: DataFrame, seeds: DataFrame) -> DataFrame:
    """(crawl_id, domain): where a crawl may go: its allow-list or, if that is null or empty, the domains of its seeds."""
    listed = F.size(F.coalesce("allowed_domains", F.array().cast("array<string>"))) > 0
    allowed = crawls.where(listed).select("crawl_id", F.explode("allowed_domains").alias("domain"))
    own = seeds.join(crawls.where(~listed).select("crawl_id"), "crawl_id", "left_semi").select("crawl_id", registered_domain(F.col("url")).alias("domain"))
    return allowed.unionAll(own).where("domain <> ''").distinct()


def crawl_bfs(crawls: DataFrame, seeds: DataFrame, pages: DataFrame, edges: DataFrame, max_url_length: int = 2048) -> DataFrame:
    """(crawl_id, url, depth, processed): what each crawl discovers under its own limits, and whether it fetched it.

    ``crawls``: crawl_id, max_depth, max_pages, allowed_domains; ``seeds``: crawl_id, url; ``pages``: url, fetched, expand, a row a
    url; ``edges``: src, dst. Urls are taken in order of (depth, url) until a crawl has fetched ``max_pages``; those it fetched above
    its ``max_depth`` and that may expand give their links within its domains. A near-duplicate has no stored links.
    """
    limits = cut_lineage(crawls.select("crawl_id", "max_depth", "max_pages"))
    rules = cut_lineage(domain_rules(crawls, seeds))
    good = edges.where((F.length("dst") <= max_url_length) & F.col("src").isNotNull())
    # Stored once: every level reads it.
    links = cut_lineage(good.select("src", "dst", registered_domain(F.col("dst")).alias("domain")).distinct())
    deepest = limits.agg(F.max("max_depth")).first()[0]
    level = seeds.where("url IS NOT NULL").join(limits.select("crawl_id"), "crawl_id", "left_semi").select("crawl_id", "url").distinct()
    levels: list[DataFrame] = []
    for depth in range((-1 if deepest is None else deepest) + 1):
        used = reduce(DataFrame.unionAll, levels).where("processed").groupBy("crawl_id").agg(F.count("*").alias("used")) if levels else None
        left = (limits.join(used, "crawl_id", "left") if used is not None else limits.withColumn("used", F.lit(0))).select("crawl_id", (F.col("max_pages") - F.coalesce("used", F.lit(0))).alias("left"))
        at = cut_lineage(level.join(pages.select("url", "fetched", "expand"), "url", "left").select("crawl_id", "url", F.coalesce("fetched", F.lit(False)).alias("fetched"), F.coalesce("expand", F.lit(False)).alias("expand")))
        if not at.take(1):
            break
        counts = at.where("fetched").groupBy("crawl_id").agg(F.count("*").alias("n")).join(left, "crawl_id")
        whole = at.where("fetched").join(counts.where("n <= left").select("crawl_id"), "crawl_id", "left_semi").select("crawl_id", "url")
        # The level in which a crawl reaches its page limit, once a crawl.
        order = Window.partitionBy("crawl_id").orderBy("url")
        cut = at.where("fetched").join(counts.where("n > left AND left > 0").select("crawl_id", "left"), "crawl_id").withColumn("k", F.row_number().over(order)).where("k <= left").select("crawl_id", "url")
        done = whole.unionAll(cut).withColumn("processed", F.lit(True))
        now = cut_lineage(at.join(done, ["crawl_id", "url"], "left").select("crawl_id", "url", F.lit(depth).alias("depth"), F.coalesce("processed", F.lit(False)).alias("processed"), "expand"))
        levels.append(now)
        open_ = now.where("processed AND expand").join(limits.where(F.col("max_depth") > depth).select("crawl_id"), "crawl_id", "left_semi").select("crawl_id", F.col("url").alias("src"))
        reached = open_.join(links, "src").join(rules, ["crawl_id", "domain"], "left_semi").select("crawl_id", F.col("dst").alias("url")).distinct()
        level = reached.join(reduce(DataFrame.unionAll, levels).select("crawl_id", "url"), ["crawl_id", "url"], "left_anti")
    if not levels:
        return level.select("crawl_id", "url", F.lit(0).alias("depth"), F.lit(False).alias("processed"))
    return reduce(DataFrame.unionAll, levels).drop("expand")

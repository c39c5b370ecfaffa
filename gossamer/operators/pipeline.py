"""The per-URL pipeline as one chain of columns: which gate stops a fetch, what is stored, what is expanded."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gossamer.functions import robots
from gossamer.functions.html import html_links, html_text, html_title, is_html
from gossamer.functions.text import simhash
from gossamer.functions.url import host_of, normalize_url, origin_of, registered_domain
from gossamer.operators import dedup, state, writes
from gossamer.session import cut_lineage


def outcomes(requests: DataFrame) -> DataFrame:
    """``requests`` with ``skipped``, ``fetched``, ``stored``, ``expand`` and ``breaker_failure``.

    Input flags: robots_allowed, circuit_allowed, budget_allowed, near_duplicate booleans; status, error of the fetch. The first gate
    that holds names the skip; budget is charged before the fetch; a 304 stores nothing; a near-duplicate is stored, but not expanded;
    a status of 500 and above, 0 or an error counts as a failure for the breaker. Null flags allow, a null near_duplicate is no.
    """
    yes = lambda c: F.coalesce(F.col(c), F.lit(True))
    gate = F.when(~yes("robots_allowed"), "robots").when(~yes("circuit_allowed"), "circuit_open").when(~yes("budget_allowed"), "budget_exhausted")
    failed = F.col("error").isNotNull() | (F.coalesce("status", F.lit(0)) <= 0)
    skipped = F.coalesce(gate, F.when(failed, "fetch_error").when(F.col("status") == 304, "not_modified"))
    duplicate = F.coalesce("near_duplicate", F.lit(False))
    return (
        requests.withColumn("skipped", skipped)
        .withColumn("fetched", F.col("skipped").isNull() | (F.col("skipped") == "not_modified"))
        .withColumn("stored", F.col("skipped").isNull())
        .withColumn("expand", F.col("stored") & ~duplicate)
        .withColumn("breaker_failure", F.when(gate.isNull(), failed | (F.col("status") >= 500)))
    )


def page_records(results: DataFrame) -> DataFrame:
    """Parsed pages: url (normalized final url, or the url), domain, hash, title and links. ``results``: url, final_url, content_type, html.

    Only HTML with a body is parsed; others have a null title and no links.
    """
    parse = is_html(F.col("content_type")) & (F.length(F.coalesce("html", F.lit(""))) > 0)
    canonical = F.coalesce(normalize_url(F.col("final_url"), True), F.col("url"))
    rows = results.select(canonical.alias("url"), "content_type", "html", F.when(parse, F.col("html")).alias("_page"))
    return rows.select(
        "url", registered_domain(F.col("url")).alias("registered_domain"), "content_type",
        F.when(F.length("html") > 0, F.sha2("html", 256)).alias("content_hash"), html_title("_page").alias("title"), html_links("_page", "url").alias("links"),
    )


def link_rows(records: DataFrame) -> DataFrame:
    """(url, pos, dst_url, anchor_text) of parsed pages."""
    return records.select("url", F.posexplode("links").alias("pos", "link")).select("url", "pos", F.col("link.url").alias("dst_url"), F.col("link.anchor").alias("anchor_text"))


def children(links: DataFrame, parents: DataFrame, max_depth: int, max_url_length: int = 2048) -> DataFrame:
    """(url, depth): targets of expandable parents (url, depth, expand) above ``max_depth``, each at its least depth."""
    open_ = parents.where("expand").where(F.col("depth") < max_depth).select(F.col("url").alias("_parent"), "depth")
    found = links.where(F.length("dst_url") <= max_url_length).join(open_, F.col("url") == F.col("_parent"))
    return found.groupBy(F.col("dst_url").alias("url")).agg((F.min("depth") + 1).alias("depth"))


def crawl_children(links: DataFrame, parents: DataFrame, rules: DataFrame, max_url_length: int = 2048) -> DataFrame:
    """(crawl_id, url, depth): ``children`` under the limits of each parent's crawl; a url goes out once, for the least (depth, crawl_id).

    ``parents``: crawl_id, url, depth, expand, max_depth; ``rules``: crawl_id, domain.
    """
    open_ = parents.where("expand AND depth < max_depth").select("crawl_id", F.col("url").alias("_parent"), "depth")
    found = links.where(F.length("dst_url") <= max_url_length).join(open_, F.col("url") == F.col("_parent"))
    kept = found.select("crawl_id", "dst_url", "depth", registered_domain(F.col("dst_url")).alias("domain")).join(rules, ["crawl_id", "domain"], "left_semi")
    first = kept.groupBy(F.col("dst_url").alias("url")).agg(F.min(F.struct("depth", "crawl_id")).alias("_first"))
    return first.select("_first.crawl_id", "url", (F.col("_first.depth") + 1).alias("depth"))


def gate_step(limit: int, threshold: int, reset_seconds: float):
    """Breaker and budget of a domain as one fold. Input: (host, seconds, robots_allowed, failed); output: (circuit_allowed, budget_allowed).

    Only what passes robots reaches the breaker, only what passes that is charged, only what is fetched is an outcome for the breaker.
    """
    breaker = state.breaker_step(threshold, reset_seconds)

    def step(held, row):
        host, now, robots_allowed, failed = row
        hosts, used = held or ({}, 0)
        if not robots_allowed:
            return (hosts, used), (True, True)
        mode, _, opened = hosts.get(host) or (state.CLOSED, 0, 0.0)
        if mode == state.OPEN and now - opened < reset_seconds:
            return (hosts, used), (False, True)
        used += 1
        if 0 < limit < used:
            return (hosts, used), (True, False)
        hosts[host], _ = breaker(hosts.get(host), (now, failed))
        return (hosts, used), (True, True)

    return step


def crawl_pages(requests: DataFrame, rules: DataFrame, limit: int, threshold: int, reset_seconds: float) -> DataFrame:
    """The chain of a fetch over ``requests`` in order of seq: robots, breaker, budget, outcome, parse, near-duplicates.

    ``requests``: seq (long, unique), url, seconds, status, error, content_type, html and what else is kept; ``rules`` as of
    ``robots_rules``. Adds the columns of ``outcomes``, canonical, title, simhash, near_duplicate, links and keep_body; a near-duplicate
    has no links and keeps no body, but is stored.
    """
    asked = requests.withColumn("_host", F.coalesce(host_of(F.col("url")), F.lit(""))).withColumn("_domain", F.coalesce(registered_domain(F.col("url")), F.lit("")))
    urls = asked.select("url", origin_of(F.col("url")).alias("origin"), robots.path_of(F.col("url")).alias("path")).distinct()
    asked = asked.join(robots.can_fetch(urls, rules).withColumnRenamed("allowed", "robots_allowed"), "url", "left").withColumn("robots_allowed", F.coalesce("robots_allowed", F.lit(True)))
    bad = F.col("error").isNotNull() | (F.coalesce("status", F.lit(0)) <= 0) | (F.coalesce("status", F.lit(0)) >= 500)
    gates = state.keyed_fold(
        asked.withColumn("_failed", bad), "_domain", ["seq"], ["_host", "seconds", "robots_allowed", "_failed"], gate_step(limit, threshold, reset_seconds), "circuit_allowed boolean, budget_allowed boolean"
    ).drop("_domain")
    first = outcomes(asked.join(gates, "seq").withColumn("near_duplicate", F.lit(False)))
    parse = F.col("stored") & is_html(F.col("content_type")) & (F.length(F.coalesce("html", F.lit(""))) > 0)
    pages = first.withColumn("canonical", F.coalesce(normalize_url(F.col("url"), True), F.col("url"))).withColumn("_page", F.when(parse, F.col("html")))
    prints = cut_lineage(pages.where("_page IS NOT NULL").select(F.col("seq").alias("id"), simhash(html_text("_page")).alias("fp")))
    near = dedup.greedy_leaders(prints).select(F.col("id").alias("seq"), F.col("fp").alias("simhash"), F.col("duplicate").alias("near_duplicate"))
    known = pages.drop("near_duplicate", "skipped", "fetched", "stored", "expand", "breaker_failure").drop("simhash").join(near, "seq", "left")
    judged = outcomes(known)
    none = F.col("expand") & F.col("_page").isNotNull()
    links = F.when(none, html_links("_page", "canonical"))
    return judged.withColumn("title", html_title("_page")).withColumn("links", links).withColumn("keep_body", F.col("expand") & (F.length(F.coalesce("html", F.lit(""))) > 0)).drop("_page", "_host", "_domain")


def store(pages: DataFrame, documents: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, edges) after the stored rows of ``crawl_pages``: upserts in order of seq, then the links of what was expanded.

    ``pages`` needs seconds, depth, crawl_id, etag, last_modified and content_hash besides.
    """
    held = cut_lineage(pages.where("stored"))
    now = F.timestamp_micros((F.col("seconds") * 1e6).cast("long"))
    values = {
        "id": F.lit(None), "url": F.col("canonical"), "registered_domain": registered_domain(F.col("canonical")), "http_status": F.col("status"), "content_length": F.length(F.coalesce("html", F.lit(""))),
        "storage_key": F.when(F.col("keep_body"), F.concat(F.lit("pg:"), F.col("content_hash"))), "in_degree": F.lit(0), "out_degree": F.coalesce(F.size("links"), F.lit(0)), "first_seen": now, "last_crawled": now,
    }
    incoming = held.select("seq", *[values.get(c, F.col(c)).cast(documents.schema[c].dataType).alias(c) for c in documents.columns])
    after = cut_lineage(writes.upsert_documents(documents, incoming, "seq"))
    links = held.select("canonical", "seq", F.posexplode("links").alias("pos", "link")).select(F.col("canonical").alias("url"), F.struct("seq", "pos").alias("id"), F.col("link.url").alias("dst_url"), F.col("link.anchor").alias("anchor_text"))
    new = links.join(after.select("url", F.col("id").alias("src_document_id")), "url").drop("url")
    return after, writes.insert_edges(edges, new)

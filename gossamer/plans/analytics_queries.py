"""Filters, aggregates, joins and rankings over document, link_edge, crawl and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from gossamer.functions import html, scalars, text, url
from gossamer.operators import analytics as A
from gossamer.plans.registry import query, table

DOMAIN, TERM, NOW, AGE, URL = "fluir3.example", "no_es", "2025-04-15 00:00:00", 864000, "https://fluir3.example/events-list"
_US = "epoch_us({0})".format
STALE_SQL = f"(last_crawled IS NULL OR epoch_us(last_crawled) < epoch_us(TIMESTAMP '{NOW}') - {AGE}000000)"
HTML_SQL = "(contains(lower(coalesce(content_type, '')), 'text/html') OR contains(lower(coalesce(content_type, '')), 'application/xhtml+xml'))"
HOST_SQL = "nullif(regexp_replace(regexp_replace(lower(regexp_extract(trim({0}), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^.*@', ''), ':[0-9]*$', ''), '')".format


def doc(spark, d):
    return table(spark, d, "document")


def edge(spark, d):
    return table(spark, d, "link_edge")


# Filters and predicates


@query("f1_domain", f"SELECT id, url FROM document WHERE registered_domain = '{DOMAIN}'")
def f1(spark, d):
    return doc(spark, d).where(A.document_filter(domain=DOMAIN)).select("id", "url")


@query("f2_search", f"SELECT id, url, title FROM document WHERE url ILIKE '%{TERM}%' OR title ILIKE '%{TERM}%'")
def f2(spark, d):
    return doc(spark, d).where(A.document_filter(q=TERM)).select("id", "url", "title")


@query("f3_point_lookup", "SELECT id, url, http_status FROM document WHERE id = 135")
def f3(spark, d):
    return doc(spark, d).where("id = 135").select("id", "url", "http_status")


@query("f4_validators", "SELECT url, max(etag) AS etag, max(last_modified) AS last_modified FROM document WHERE etag IS NOT NULL OR last_modified IS NOT NULL GROUP BY url")
def f4(spark, d):
    """The validators map of the whole store, as the sink keeps it: urls with an etag or a last_modified."""
    return doc(spark, d).where("etag IS NOT NULL OR last_modified IS NOT NULL").groupBy("url").agg(F.max("etag").alias("etag"), F.max("last_modified").alias("last_modified"))


@query("f5_stale", f"SELECT id, url FROM document WHERE {STALE_SQL}")
def f5(spark, d):
    return doc(spark, d).where(A.stale(NOW, AGE)).select("id", "url")


@query("f6_has_body", "SELECT id, content_hash FROM document WHERE content_hash IS NOT NULL")
def f6(spark, d):
    return doc(spark, d).where(F.col("content_hash").isNotNull()).select("id", "content_hash")


@query("f7_url_length", "SELECT id, dst_url FROM link_edge WHERE length(dst_url) <= 2048")
def f7(spark, d):
    return edge(spark, d).where(F.length("dst_url") <= 2048).select("id", "dst_url")


_LINKS_SQL = f"SELECT DISTINCT e.id, e.dst_url, d.crawl_id, {HOST_SQL('e.dst_url')} AS host FROM link_edge e JOIN (SELECT DISTINCT id, crawl_id FROM document) d ON e.src_document_id = d.id"


def links_with_crawl(spark, d):
    owners = doc(spark, d).select(F.col("id").alias("src_document_id"), "crawl_id").distinct()
    return edge(spark, d).join(owners, "src_document_id").select("id", "dst_url", "crawl_id", url.host_of(F.col("dst_url")).alias("host")).distinct()


@query("f8_allow_list", f"WITH l AS ({_LINKS_SQL}), a AS (SELECT DISTINCT id AS crawl_id, unnest(allowed_domains) AS host FROM crawl) SELECT l.id, l.dst_url, l.crawl_id FROM l SEMI JOIN a ON l.crawl_id = a.crawl_id AND l.host = a.host")
def f8(spark, d):
    allowed = table(spark, d, "crawl").select(F.col("id").alias("crawl_id"), F.explode("allowed_domains").alias("host")).distinct()
    return links_with_crawl(spark, d).join(allowed, ["crawl_id", "host"], "left_semi").select("id", "dst_url", "crawl_id")


@query("f9_same_domain", f"WITH l AS ({_LINKS_SQL}), s AS (SELECT DISTINCT id AS crawl_id, {HOST_SQL('u')} AS host FROM (SELECT id, unnest(seeds) AS u FROM crawl)) SELECT l.id, l.dst_url, l.crawl_id FROM l SEMI JOIN s ON l.crawl_id = s.crawl_id AND l.host = s.host")
def f9(spark, d):
    seeds = table(spark, d, "crawl").select(F.col("id").alias("crawl_id"), F.explode("seeds").alias("u")).select("crawl_id", url.host_of(F.col("u")).alias("host")).distinct()
    return links_with_crawl(spark, d).join(seeds, ["crawl_id", "host"], "left_semi").select("id", "dst_url", "crawl_id")


@query("f10_expandable", "SELECT d.id, d.url, d.depth FROM document d JOIN crawl c ON d.crawl_id = c.id WHERE d.depth < c.max_depth")
def f10(spark, d):
    crawl = table(spark, d, "crawl").select(F.col("id").alias("crawl_id"), "max_depth")
    return doc(spark, d).join(crawl, "crawl_id").where("depth < max_depth").select("id", "url", "depth")


@query("f11_too_deep", "SELECT m.msg_id, m.depth FROM frontier_message m JOIN crawl c ON m.crawl_id = c.id WHERE m.depth > c.max_depth")
def f11(spark, d):
    crawl = table(spark, d, "crawl").select(F.col("id").alias("crawl_id"), "max_depth")
    return table(spark, d, "frontier_message").join(crawl, "crawl_id").where("depth > max_depth").select("msg_id", "depth")


@query("f12_parse_gate", f"SELECT content_hash, size FROM page_body WHERE {HTML_SQL} AND size > 0")
def f12(spark, d):
    return table(spark, d, "page_body").where(html.is_html(F.col("content_type")) & (F.col("size") > 0)).select("content_hash", "size")


@query("f13_decodable", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE json_valid(props) AND json_extract(props, '$.k') IS NOT NULL")
def f13(spark, d):
    parsed = F.from_json("props", "k long", {"mode": "PERMISSIVE"})
    return table(spark, d, "events").select("event_id", parsed["k"].alias("k")).where("k IS NOT NULL")


@query("f14_document_summary", f"SELECT id, url, coalesce(title, url) AS label, registered_domain AS domain, coalesce(http_status, 0) AS status, depth, {_US('last_crawled')} AS last_crawled_us FROM document")
def f14(spark, d):
    return doc(spark, d).select(
        "id", "url", F.coalesce("title", "url").alias("label"), F.col("registered_domain").alias("domain"), F.coalesce("http_status", F.lit(0)).alias("status"), "depth",
        F.unix_micros("last_crawled").alias("last_crawled_us"),
    )


# Aggregates


@query("a1_documents", "SELECT count(*) AS n FROM document")
def a1(spark, d):
    return doc(spark, d).agg(F.count("*").alias("n"))


@query("a2_edges", "SELECT count(*) AS n FROM link_edge")
def a2(spark, d):
    return edge(spark, d).agg(F.count("*").alias("n"))


@query("a3_domains", "SELECT count(DISTINCT registered_domain) AS n FROM document")
def a3(spark, d):
    return doc(spark, d).agg(F.countDistinct("registered_domain").alias("n"))


@query("a4_shared_hashes", "SELECT count(*) AS n FROM (SELECT content_hash FROM document WHERE content_hash IS NOT NULL GROUP BY content_hash HAVING count(*) > 1)")
def a4(spark, d):
    return doc(spark, d).where("content_hash IS NOT NULL").groupBy("content_hash").agg(F.count("*").alias("c")).where("c > 1").agg(F.count("*").alias("n"))


@query("a5_status_histogram", "SELECT http_status, count(*) AS n FROM document GROUP BY http_status")
def a5(spark, d):
    return A.status_histogram(doc(spark, d))


@query("a6_top_domains", "SELECT registered_domain, count(*) AS n FROM document GROUP BY 1 ORDER BY n DESC, registered_domain ASC NULLS FIRST LIMIT 50")
def a6(spark, d):
    return A.top_domains(doc(spark, d), 50)


@query("a7_filtered_total", f"SELECT count(*) AS total FROM document WHERE registered_domain = '{DOMAIN}' AND (url ILIKE '%{TERM}%' OR title ILIKE '%{TERM}%')")
def a7(spark, d):
    return doc(spark, d).where(A.document_filter(DOMAIN, TERM)).agg(F.count("*").alias("total"))


@query(
    "a8_stats",
    """SELECT count(*) AS documents, (SELECT count(*) FROM link_edge) AS edges, count(DISTINCT registered_domain) AS domains,
    (SELECT count(*) FROM (SELECT content_hash FROM document WHERE content_hash IS NOT NULL GROUP BY 1 HAVING count(*) > 1)) AS near_duplicates FROM document""",
)
def a8(spark, d):
    return A.document_counts(doc(spark, d), edge(spark, d))


@query(
    "a9_degrees",
    """SELECT d.id, d.url, coalesce(o.n, 0) AS out_degree, coalesce(i.n, 0) AS in_degree FROM document d
    LEFT JOIN (SELECT src_document_id, count(*) AS n FROM link_edge GROUP BY 1) o ON o.src_document_id = d.id
    LEFT JOIN (SELECT dst_url, count(*) AS n FROM link_edge GROUP BY 1) i ON i.dst_url = d.url""",
)
def a9(spark, d):
    return A.degrees(doc(spark, d), edge(spark, d))


_TOKENS_SQL = "SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS token FROM documents"


@query("a10_term_counts", f"SELECT doc_id, token, count(*) AS n FROM ({_TOKENS_SQL}) GROUP BY 1, 2")
def a10(spark, d):
    return table(spark, d, "documents").select("doc_id", F.explode(text.tokens(F.col("text"))).alias("token")).groupBy("doc_id", "token").agg(F.count("*").alias("n"))


@query(
    "a11_simhash_bit_sums",
    f"""WITH c AS (SELECT doc_id, token, count(*) AS n FROM ({_TOKENS_SQL}) GROUP BY 1, 2),
    h AS (SELECT doc_id, n, ('0x' || substr(sha256(token), 1, 16))::UBIGINT AS h FROM c)
    SELECT doc_id, i AS bit, CAST(sum(CASE WHEN (h >> i::UBIGINT) & 1::UBIGINT = 1 THEN n ELSE -n END) AS BIGINT) AS signed_sum FROM h, range(64) r(i) GROUP BY 1, 2""",
)
def a11(spark, d):
    counts = a10(spark, d).withColumn("h", text.hex_hash(F.col("token")))
    # All 64 sums in one pass over the terms; only the sums are unpivoted, 64 rows a document.
    sums = counts.groupBy("doc_id").agg(*[F.sum(F.when(F.shiftrightunsigned("h", i).bitwiseAND(F.lit(1).cast("long")) == 1, F.col("n")).otherwise(-F.col("n"))).alias(f"b{i}") for i in range(64)])
    return sums.select("doc_id", F.posexplode(F.array(*[f"b{i}" for i in range(64)])).alias("bit", "signed_sum")).select("doc_id", F.col("bit").cast("long").alias("bit"), "signed_sum")


@query("a15_nearest_rank", "SELECT event_type, count(*) AS n, list_sort(list(value))[least(count(*) - 1, CAST(floor(0.95 * count(*)) AS BIGINT)) + 1] AS value FROM events WHERE value IS NOT NULL GROUP BY 1")
def a15(spark, d):
    return A.nearest_rank(table(spark, d, "events"), "event_type", "value", 0.95)


@query(
    "a16_run_summary",
    """SELECT n AS pages, CASE WHEN s > 0 THEN round(n / s, 6) ELSE 0.0 END AS pages_per_s, CASE WHEN s > 0 THEN round(b / 1e6 / s, 9) ELSE 0.0 END AS mb_per_s,
    CASE WHEN n > 0 THEN round((h - u) / n, 9) ELSE 0.0 END AS dedup_ratio FROM (SELECT count(*) AS n, sum(coalesce(content_length, 0)) AS b, count(content_hash) AS h,
    count(DISTINCT content_hash) AS u, (max(epoch_us(last_crawled)) - min(epoch_us(last_crawled))) / 1e6 AS s FROM document)""",
)
def a16(spark, d):
    sums = doc(spark, d).agg(
        F.count("*").alias("n"), F.sum(F.coalesce("content_length", F.lit(0))).alias("b"), F.count("content_hash").alias("h"), F.countDistinct("content_hash").alias("u"),
        ((F.max(F.unix_micros("last_crawled")) - F.min(F.unix_micros("last_crawled"))) / 1e6).alias("s"),
    )
    rate = lambda x, places: F.when(F.col("s") > 0, F.round(x / F.col("s"), places)).otherwise(0.0)
    return sums.select(
        F.col("n").alias("pages"), rate(F.col("n"), 6).alias("pages_per_s"), rate(F.col("b") / 1e6, 9).alias("mb_per_s"),
        F.when(F.col("n") > 0, F.round((F.col("h") - F.col("u")) / F.col("n"), 9)).otherwise(0.0).alias("dedup_ratio"),
    )


@query("a17_total_bytes", "SELECT CAST(sum(coalesce(content_length, 0)) AS BIGINT) AS total FROM document")
def a17(spark, d):
    return doc(spark, d).agg(F.sum(F.coalesce("content_length", F.lit(0)).cast("long")).alias("total"))


@query(
    "a20_depth_and_bands",
    """SELECT max(depth) OVER () AS max_depth, band, n FROM (SELECT CASE WHEN http_status IS NULL THEN 'unknown' WHEN http_status < 300 THEN 'ok' WHEN http_status < 400 THEN 'redirect'
    WHEN http_status < 500 THEN 'client' ELSE 'server' END AS band, count(*) AS n, max(depth) AS depth FROM document GROUP BY 1)""",
)
def a20(spark, d):
    docs = doc(spark, d)
    deepest = docs.agg(F.max("depth")).scalar()
    return docs.groupBy(scalars.status_band(F.col("http_status")).alias("band")).agg(F.count("*").alias("n")).select(deepest.alias("max_depth"), "band", "n")


BUCKETS = (0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0)


@query(
    "a21_histogram",
    "SELECT event_type, b AS le, CAST(count_if(value <= b) AS BIGINT) AS n FROM events, (SELECT unnest([" + ", ".join(f"{b}::DOUBLE" for b in BUCKETS) + "]) AS b) GROUP BY 1, 2",
)
def a21(spark, d):
    """Cumulative buckets, all counted in one pass."""
    counted = table(spark, d, "events").groupBy("event_type").agg(*[F.count_if(F.col("value") <= b).alias(f"b{i}") for i, b in enumerate(BUCKETS)])
    pairs = F.array(*[F.struct(F.lit(b).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(BUCKETS)])
    return counted.select("event_type", F.explode(pairs).alias("p")).select("event_type", "p.le", "p.n")


# Joins


@query("j1_out_degree", "SELECT d.id, count(e.id) AS n FROM (SELECT DISTINCT id FROM document) d LEFT JOIN link_edge e ON e.src_document_id = d.id GROUP BY 1")
def j1(spark, d):
    per = edge(spark, d).groupBy(F.col("src_document_id").alias("id")).agg(F.count("id").alias("n"))
    return doc(spark, d).select("id").distinct().join(per, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n"))


@query("j2_in_degree", "SELECT d.url, count(e.id) AS n FROM (SELECT DISTINCT url FROM document) d LEFT JOIN link_edge e ON e.dst_url = d.url GROUP BY 1")
def j2(spark, d):
    per = edge(spark, d).groupBy(F.col("dst_url").alias("url")).agg(F.count("id").alias("n"))
    return doc(spark, d).select("url").distinct().join(per, "url", "left").select("url", F.coalesce("n", F.lit(0)).alias("n"))


@query("j3_crawl_documents", "SELECT c.id, c.name, c.status, c.max_depth, c.max_pages, (SELECT count(*) FROM document d WHERE d.crawl_id = c.id) AS documents FROM crawl c")
def j3(spark, d):
    return A.crawl_summaries(table(spark, d, "crawl"), doc(spark, d))


@query("j4_unseen", "SELECT DISTINCT dst_url AS url FROM link_edge WHERE dst_url NOT IN (SELECT url FROM document WHERE url IS NOT NULL)")
def j4(spark, d):
    return edge(spark, d).select(F.col("dst_url").alias("url")).distinct().join(doc(spark, d).select("url"), "url", "left_anti")


@query("j7_allowed_documents", "SELECT d.id, d.url FROM document d SEMI JOIN (SELECT DISTINCT id, unnest(allowed_domains) AS h FROM crawl) a ON d.crawl_id = a.id AND d.registered_domain = a.h")
def j7(spark, d):
    allowed = table(spark, d, "crawl").select(F.col("id").alias("crawl_id"), F.explode("allowed_domains").alias("registered_domain"))
    return doc(spark, d).join(allowed, ["crawl_id", "registered_domain"], "left_semi").select("id", "url")


@query("j9_document_links", "SELECT d.id, e.dst_url, e.anchor_text FROM (SELECT DISTINCT id FROM document) d JOIN (SELECT DISTINCT * FROM link_edge) e ON e.src_document_id = d.id")
def j9(spark, d):
    edges = edge(spark, d).distinct().select(F.col("src_document_id").alias("id"), "dst_url", "anchor_text")
    return doc(spark, d).select("id").distinct().join(edges, "id").select("id", "dst_url", "anchor_text")


@query("j11_crawl_of_document", "SELECT d.id, c.name, c.status FROM document d JOIN crawl c ON d.crawl_id = c.id")
def j11(spark, d):
    crawl = table(spark, d, "crawl").select(F.col("id").alias("crawl_id"), "name", "status")
    return doc(spark, d).join(crawl, "crawl_id").select("id", "name", "status")


# Rankings


@query("k1_top_pages", "SELECT id, url, in_degree FROM (SELECT DISTINCT id, url, in_degree FROM document) ORDER BY in_degree DESC, url, id LIMIT 20")
def k1(spark, d):
    return doc(spark, d).select("id", "url", "in_degree").distinct().orderBy(F.desc("in_degree"), "url", "id").limit(A.checked_limit("graph", 20))


@query("k2_top_domains", "SELECT registered_domain, count(*) AS n FROM document WHERE registered_domain IS NOT NULL GROUP BY 1 ORDER BY n DESC, registered_domain LIMIT 10")
def k2(spark, d):
    return A.top_domains(doc(spark, d).where("registered_domain IS NOT NULL"), 10)


@query("k3_newest_page", "SELECT id, url, title FROM document ORDER BY id DESC, url, title NULLS FIRST LIMIT 50 OFFSET 50")
def k3(spark, d):
    return doc(spark, d).select("id", "url", "title").orderBy(F.desc("id"), "url", F.asc_nulls_first("title")).offset(50).limit(A.checked_limit("documents", 50))


@query("k4_recent_crawls", "SELECT id, name, status FROM crawl ORDER BY id DESC LIMIT 50")
def k4(spark, d):
    return table(spark, d, "crawl").select("id", "name", "status").orderBy(F.desc("id")).limit(A.checked_limit("crawls", 50))


@query("k5_stalest", f"SELECT id, url, {_US('last_crawled')} AS last_us FROM document WHERE {STALE_SQL} ORDER BY last_crawled ASC NULLS FIRST, url, id LIMIT 100")
def k5(spark, d):
    rows = doc(spark, d).where(A.stale(NOW, AGE)).select("id", "url", F.unix_micros("last_crawled").alias("last_us"))
    return rows.orderBy(F.asc_nulls_first("last_us"), "url", "id").limit(100)


@query("k6_links_of_document", "SELECT dst_url, anchor_text FROM (SELECT DISTINCT dst_url, anchor_text FROM link_edge WHERE src_document_id = 1) ORDER BY dst_url, anchor_text NULLS FIRST LIMIT 200")
def k6(spark, d):
    return edge(spark, d).where("src_document_id = 1").select("dst_url", "anchor_text").distinct().orderBy("dst_url", F.asc_nulls_first("anchor_text")).limit(A.checked_limit("links", 200))


@query("k7_due", "SELECT msg_id, url, not_before, greatest(0.0, not_before - 1740800000.0) AS wait_s FROM frontier_message WHERE not_before <= 1740900000.0")
def k7(spark, d):
    """Entries due by a time, with the seconds each had still to wait at an earlier one."""
    due = table(spark, d, "frontier_message").where("not_before <= 1740900000.0")
    return due.select("msg_id", "url", "not_before", F.greatest(F.lit(0.0), F.col("not_before") - F.lit(1740800000.0)).alias("wait_s"))


@query("k7_next_due", "SELECT min(not_before) AS next_due, greatest(0.0, min(not_before) - 1740800000.0) AS seconds_until FROM frontier_message WHERE not_before > 0")
def k7_next(spark, d):
    least = table(spark, d, "frontier_message").where("not_before > 0").agg(F.min("not_before").alias("next_due"))
    return least.select("next_due", F.greatest(F.lit(0.0), F.col("next_due") - F.lit(1740800000.0)).alias("seconds_until"))


@query("k9_dry_run", "SELECT depth, url FROM (SELECT DISTINCT depth, url FROM document) ORDER BY depth, url LIMIT 25")
def k9(spark, d):
    return doc(spark, d).select("depth", "url").distinct().orderBy("depth", "url").limit(25)


# Scalar functions


@query("u1_normalize_url", f"SELECT msg_id, {url.duckdb_normalized('url', True, True)} AS normalized FROM frontier_message")
def u1(spark, d):
    return table(spark, d, "frontier_message").select("msg_id", url.normalize_url(F.col("url"), first_of_equal_names=True, encoded=True).alias("normalized"))


@query("u2_tracked_urls", "SELECT msg_id FROM frontier_message WHERE regexp_matches(url, '[?&](" + "|".join(url.TRACKING) + ")=[^#]*(#|$)') AND regexp_matches(url, '^[^#]*[?&](" + "|".join(url.TRACKING) + ")=')")
def u2(spark, d):
    return table(spark, d, "frontier_message").where(F.col("url").rlike("^[^#]*[?&](" + "|".join(url.TRACKING) + ")=")).select("msg_id")


@query("u3_host", f"SELECT msg_id, {HOST_SQL('url')} AS host FROM frontier_message")
def u3(spark, d):
    return table(spark, d, "frontier_message").select("msg_id", url.host_of(F.col("url")).alias("host"))


@query("u4_registered_domain", f"SELECT id, coalesce({HOST_SQL('url')}, '') AS domain FROM document")
def u4(spark, d):
    """All hosts lie under reserved names here, so each is its own registrable name."""
    return doc(spark, d).select("id", url.registered_domain(F.col("url")).alias("domain"))


@query("u5_same_domain", f"SELECT e.id, {HOST_SQL('e.dst_url')} IS NOT DISTINCT FROM {HOST_SQL('d.url')} AS same FROM link_edge e JOIN (SELECT DISTINCT id, url FROM document) d ON d.id = e.src_document_id")
def u5(spark, d):
    owners = doc(spark, d).select(F.col("id").alias("src_document_id"), "url").distinct()
    return edge(spark, d).join(owners, "src_document_id").select("id", (url.registered_domain(F.col("dst_url")) == url.registered_domain(F.col("url"))).alias("same"))


@query("u6_origin", "SELECT id, regexp_extract(dst_url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)', 1) AS origin FROM link_edge")
def u6(spark, d):
    return edge(spark, d).select("id", url.origin_of(F.col("dst_url")).alias("origin"))


@query("t1_tokens", f"SELECT token, count(*) AS n FROM ({_TOKENS_SQL}) GROUP BY 1")
def t1(spark, d):
    return table(spark, d, "documents").select(F.explode(text.tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


@query("t4_hamming", "SELECT a.id AS id, bit_count(xor(a.simhash, b.simhash))::INT AS distance FROM (SELECT DISTINCT id, crawl_id, simhash FROM document WHERE simhash IS NOT NULL) a JOIN (SELECT crawl_id, min(simhash) AS simhash FROM document GROUP BY 1) b ON a.crawl_id = b.crawl_id")
def t4(spark, d):
    docs = doc(spark, d).where("simhash IS NOT NULL").select("id", "crawl_id", "simhash").distinct()
    least = doc(spark, d).groupBy("crawl_id").agg(F.min("simhash").alias("least"))
    return docs.join(least, "crawl_id").select("id", text.hamming(F.col("simhash"), F.col("least")).alias("distance"))


@query("t5_bands", "SELECT DISTINCT id, i AS band, (CAST(simhash & 9223372036854775807 AS BIGINT) >> (16 * i)) & 65535 | CASE WHEN i = 3 AND simhash < 0 THEN 32768 ELSE 0 END AS value FROM document, range(4) r(i) WHERE simhash IS NOT NULL")
def t5(spark, d):
    docs = doc(spark, d).where("simhash IS NOT NULL")
    return docs.select("id", F.posexplode(text.band_values(F.col("simhash"))).alias("band", "value")).select("id", F.col("band").cast("long").alias("band"), "value").distinct()


@query("t6_signed", "SELECT id, CASE WHEN simhash IS NULL THEN NULL ELSE printf('%016x', simhash) END AS hex FROM document")
def t6(spark, d):
    return doc(spark, d).select("id", F.lower(F.lpad(F.hex("simhash"), 16, "0")).alias("hex"))


@query("t7_body_hash", "SELECT doc_id, CASE WHEN length(text) > 0 THEN sha256(text) END AS hash FROM documents")
def t7(spark, d):
    return table(spark, d, "documents").select("doc_id", F.when(F.length("text") > 0, F.sha2("text", 256)).alias("hash"))


@query(
    "t10_bloom_sizing",
    """SELECT doc_id, greatest(8, CAST(ceil(-n_chars * ln(0.01) / pow(ln(2), 2)) AS BIGINT)) AS bits,
    greatest(1, CAST(round_even(greatest(8, CAST(ceil(-n_chars * ln(0.01) / pow(ln(2), 2)) AS BIGINT)) / n_chars * ln(2), 0) AS BIGINT)) AS hashes FROM documents WHERE n_chars > 0""",
)
def t10(spark, d):
    from gossamer.functions.hashing import optimal_bits_col, optimal_hashes_col

    docs = table(spark, d, "documents").where("n_chars > 0").select("doc_id", "n_chars", optimal_bits_col(F.col("n_chars"), F.lit(0.01)).alias("bits"))
    return docs.select("doc_id", "bits", optimal_hashes_col(F.col("bits"), F.col("n_chars")).alias("hashes"))


@query("t12_status_class", "SELECT CASE WHEN http_status <= 0 THEN 'error' WHEN http_status IS NOT NULL THEN (http_status // 100)::VARCHAR || 'xx' END AS status_class, count(*) AS n, CAST(sum(coalesce(content_length, 0)) AS BIGINT) AS bytes FROM document GROUP BY 1")
def t12(spark, d):
    return A.class_profile(doc(spark, d))


@query("t13_status_band", "SELECT id, CASE WHEN http_status IS NULL THEN 'unknown' WHEN http_status < 300 THEN 'ok' WHEN http_status < 400 THEN 'redirect' WHEN http_status < 500 THEN 'client' ELSE 'server' END AS band FROM document")
def t13(spark, d):
    return doc(spark, d).select("id", scalars.status_band(F.col("http_status")).alias("band"))


@query(
    "t14_hash01",
    """SELECT id, round(list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(url, ''), lambda c: ascii(c)::BIGINT)),
    lambda h, c: (xor(h, c) * 16777619) & 4294967295) / 4294967295.0, 9) AS h FROM document""",
)
def t14(spark, d):
    return doc(spark, d).select("id", F.round(scalars.hash01(F.col("url")), 9).alias("h"))


@query(
    "t15_node_geometry",
    """SELECT DISTINCT id, round(CASE WHEN (SELECT max(depth) FROM document) > 0 THEN depth / (SELECT max(depth) FROM document) ELSE 0.0 END, 9) AS depth_share,
    round(2.4 + least(9.0, 1.7 * sqrt(in_degree + out_degree)), 9) AS size FROM document""",
)
def t15(spark, d):
    docs = doc(spark, d)
    deepest = docs.agg(F.max("depth").alias("m")).scalar()
    share = F.when(deepest > 0, F.col("depth") / deepest).otherwise(0.0)
    return docs.select("id", F.round(share, 9).alias("depth_share"), F.round(scalars.node_size(F.col("in_degree") + F.col("out_degree")), 9).alias("size")).distinct()


@query("t16_short_url", "SELECT id, CASE WHEN length(p) > 18 THEN substr(p, 1, 17) || '…' ELSE p END AS label FROM (SELECT id, regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) AS p FROM document)")
def t16(spark, d):
    path = F.regexp_extract("url", r"^[A-Za-z]+://[^/?#]*([^?#]*)", 1)
    return doc(spark, d).select("id", scalars.short_path(path).alias("label"))


@query(
    "t17_local_time",
    """SELECT id, strftime(make_timestamp(epoch_us(last_crawled) + 19800000000), '%Y-%m-%d %H:%M:%S') AS ist,
    CASE WHEN n = 0 THEN '0 of 0' ELSE '1–' || least(25, n)::VARCHAR || ' of ' || n::VARCHAR END AS pager FROM document, (SELECT count(*) AS n FROM document)""",
)
def t17(spark, d):
    docs = doc(spark, d)
    total = docs.agg(F.count("*")).scalar()
    local = F.date_format(F.from_utc_timestamp("last_crawled", "Asia/Kolkata"), "yyyy-MM-dd HH:mm:ss")
    return docs.select("id", local.alias("ist"), scalars.page_label(F.lit(0), F.least(F.lit(25), total), total).alias("pager"))


@query("t18_iso_utc", "SELECT id, strftime(make_timestamp(epoch_us(first_seen)), '%Y-%m-%dT%H:%M:%S+00:00') AS iso FROM document")
def t18(spark, d):
    return doc(spark, d).select("id", scalars.iso_utc(F.col("first_seen")).alias("iso"))


@query("t19_next_interval", "SELECT id, CAST(CASE WHEN etag IS NULL OR content_length IS NULL THEN 100.0 ELSE least(content_length * 2.0, 1000.0) END AS DOUBLE) AS interval_s FROM document")
def t19(spark, d):
    current = F.col("content_length").cast("double")
    return doc(spark, d).select("id", scalars.next_interval(current, F.col("etag").isNull(), 100.0, 1000.0, 2.0).alias("interval_s"))


@query("t20_effective_delay", "SELECT id, delay_ms, CASE WHEN delay_ms > 0 THEN 1000.0 / delay_ms END AS refill FROM (SELECT id, greatest(500, depth * 400)::BIGINT AS delay_ms FROM document)")
def t20(spark, d):
    delay = scalars.effective_delay_ms(F.lit(500), F.col("depth") * F.lit(0.4))
    return doc(spark, d).select("id", delay.alias("delay_ms")).select("id", "delay_ms", scalars.refill_per_second(F.col("delay_ms")).alias("refill"))


@query("t21_conditional_headers", "SELECT id, nullif(etag, '') AS if_none_match, nullif(last_modified, '') AS if_modified_since FROM document WHERE coalesce(etag, '') <> '' OR coalesce(last_modified, '') <> ''")
def t21(spark, d):
    headers = doc(spark, d).select("id", scalars.conditional_headers(F.col("etag"), F.col("last_modified")).alias("h")).where("h IS NOT NULL")
    return headers.select("id", scalars.header(F.col("h"), "if-none-match").alias("if_none_match"), scalars.header(F.col("h"), "if-modified-since").alias("if_modified_since"))


@query("t22_retry_delay", "SELECT msg_id, least(pow(2.0, attempts), 30.0) AS delay_s FROM frontier_message")
def t22(spark, d):
    return table(spark, d, "frontier_message").select("msg_id", scalars.retry_delay(F.col("attempts")).alias("delay_s"))


@query("t24_seed_lists", "SELECT id, pos::INT AS pos, seed FROM (SELECT id, unnest(seeds) AS seed, generate_subscripts(seeds, 1) - 1 AS pos FROM crawl)")
def t24(spark, d):
    """Seeds through their JSON form and back, one row a seed."""
    stored = table(spark, d, "crawl").select("id", F.to_json("seeds").alias("json"))
    return stored.select("id", F.posexplode(F.from_json("json", "array<string>")).alias("pos", "seed"))

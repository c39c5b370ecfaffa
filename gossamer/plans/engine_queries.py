"""State gates, graph, fingerprints, sharding, writes, sources, pipeline and streams as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gossamer.api import CrawlAnalytics
from gossamer.functions import hashing, html, robots, text, url
from gossamer.operators import analytics, bloom, dedup, graph, pipeline, sharding, state, writes
from gossamer.plans.analytics_queries import AGE, HOST_SQL, HTML_SQL, NOW, STALE_SQL, doc, edge
from gossamer.plans import twins
from gossamer.plans.registry import query, table
from gossamer.sources import fetch, messages, objects, site
from gossamer.session import cut_lineage, spread
from gossamer.streaming import frontier, gates, panels

RATE, LIMIT, THRESHOLD = 0.001, 20, 3


def events(spark, d):
    """Events as fetch outcomes: host, sequence, seconds, failed."""
    rows = table(spark, d, "events")
    return rows.select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("seconds"))


_EV = "SELECT event_id, user_id, event_type, value, epoch_us(ts) / 1e6 AS seconds FROM events"
_WIN = "OVER (PARTITION BY user_id ORDER BY event_id)"


@query("w1_first_link", "SELECT src_document_id, dst_url, min(id) AS id FROM link_edge GROUP BY 1, 2")
def w1(spark, d):
    """The first of a page's equal links, as an aggregate instead of a window."""
    return edge(spark, d).groupBy("src_document_id", "dst_url").agg(F.min("id").alias("id"))


@query("w2_budget", f"SELECT event_id, row_number() {_WIN} <= {LIMIT} AS allowed, greatest(0, {LIMIT} - row_number() {_WIN}) AS remaining FROM events")
def w2(spark, d):
    return state.budget(events(spark, d), "user_id", "event_id", LIMIT).select("event_id", "allowed", "remaining")


@query("w3_charged_budget", f"SELECT event_id, sum(event_id % 3 + 1) {_WIN} <= 40 AS allowed, CAST(greatest(0, 40 - sum(event_id % 3 + 1) {_WIN}) AS BIGINT) AS remaining FROM events")
def w3(spark, d):
    return state.budget(events(spark, d), "user_id", "event_id", 40, F.col("event_id") % 3 + 1).select("event_id", "allowed", "remaining")


_PAID = "(SELECT *, (event_id % 3 + 1)::BIGINT AS cost FROM events)"
_STRICT_SQL = twins.strict_budget(_PAID, "user_id", "event_id", "cost", 40)


@query("w4_strict_budget", _STRICT_SQL)
def w4(spark, d):
    rows = events(spark, d).withColumn("cost", F.col("event_id") % 3 + 1)
    return state.strict_budget(rows, "user_id", "event_id", "cost", 40)


@query(
    "w5_paced_grants",
    f"""SELECT event_id, round(max(seconds - k / {RATE}) OVER (PARTITION BY user_id ORDER BY event_id) + k / {RATE}, 3) AS grant_s
    FROM (SELECT *, row_number() {_WIN} AS k FROM ({_EV}))""",
)
def w5(spark, d):
    return state.paced_grants(events(spark, d), "user_id", "event_id", F.col("seconds"), RATE).select("event_id", F.round("grant_s", 3).alias("grant_s"))


@query("w6_token_bucket", twins.token_bucket(f"(SELECT *, seconds * 1000 AS now_ms FROM ({_EV}))", "user_id", "event_id", "now_ms", 5, RATE / 10))
def w6(spark, d):
    rows = events(spark, d).withColumn("now_ms", F.col("seconds") * 1000).withColumn("wanted", F.lit(1))
    return state.keyed_fold(rows, "user_id", ["event_id"], ["now_ms", "wanted"], state.token_bucket_step(5, RATE / 10), "allowed boolean, wait_ms long")


@query(
    "w7_failure_streaks",
    f"""SELECT event_id, k - coalesce(max(CASE WHEN event_type <> 'error' THEN k END) {_WIN}, 0) AS streak,
    k - coalesce(max(CASE WHEN event_type <> 'error' THEN k END) {_WIN}, 0) >= {THRESHOLD} AS tripped FROM (SELECT *, row_number() {_WIN} AS k FROM events)""",
)
def w7(spark, d):
    return state.failure_streaks(events(spark, d), "user_id", "event_id", F.col("event_type") == "error", THRESHOLD).select("event_id", "streak", "tripped")


@query("w8_page_limit", "SELECT url, depth, row_number() OVER (ORDER BY depth, url)::INT AS position FROM (SELECT DISTINCT url, depth FROM document) ORDER BY depth, url LIMIT 200")
def w8(spark, d):
    return graph.first_pages(doc(spark, d).select("url", "depth").distinct(), ["depth", "url"], 200)


@query("w9_seen_growth", "SELECT url FROM document UNION SELECT dst_url FROM link_edge")
def w9(spark, d):
    return doc(spark, d).select("url").unionByName(edge(spark, d).select(F.col("dst_url").alias("url"))).distinct()


_BREAKER_SQL = twins.breaker(f"(SELECT *, event_type = 'error' AS failed FROM ({_EV}))", "user_id", "event_id", "seconds", "failed", THRESHOLD, 86400.0)


@query("r8_breaker", _BREAKER_SQL)
def r8(spark, d):
    rows = events(spark, d).withColumn("failed", F.col("event_type") == "error")
    return state.keyed_fold(rows, "user_id", ["event_id"], ["seconds", "failed"], state.breaker_step(THRESHOLD, 86400.0), "allowed boolean, state string")


@query("a19_open_breakers", f"SELECT count_if(state = 'open')::BIGINT AS open FROM (SELECT arg_max(state, event_id) AS state FROM ({_BREAKER_SQL}) GROUP BY user_id)")
def a19(spark, d):
    last = r8(spark, d).groupBy("user_id").agg(F.max_by("state", "event_id").alias("state"))
    return last.agg(F.count_if(F.col("state") == state.OPEN).alias("open"))


# Graph

_EDGES_SQL = "e AS (SELECT DISTINCT d.url AS src, l.dst_url AS dst FROM link_edge l JOIN document d ON d.id = l.src_document_id)"
_BFS_SQL = f"WITH RECURSIVE {_EDGES_SQL}, b(url, depth) AS (SELECT DISTINCT url, 0 FROM document WHERE depth = 0 UNION SELECT e.dst, b.depth + 1 FROM b JOIN e ON e.src = b.url WHERE b.depth < 4)"


def _crawl(spark, d):
    return graph.bfs(doc(spark, d).where("depth = 0").select("url"), graph.page_links(doc(spark, d), edge(spark, d)), 4)


@query("g1_bfs", f"{_BFS_SQL} SELECT url, min(depth) AS depth FROM b GROUP BY 1")
def g1(spark, d):
    return _crawl(spark, d)


@query("g1_synthetic_bfs", "WITH RECURSIVE e AS (SELECT i AS src, (7 * i + j) % 500 AS dst FROM range(500) r(i), range(6) s(j) WHERE i % 10 <> 1), b(url, depth) AS (SELECT 0::BIGINT, 0 UNION SELECT e.dst, b.depth + 1 FROM b JOIN e ON e.src = b.url WHERE b.depth < 5) SELECT url, min(depth) AS depth FROM b GROUP BY 1")
def g1_synthetic(spark, d):
    return graph.bfs(spark.range(1).select(F.col("id").alias("url")), site.site_edges(spark, 500), 5)


@query("g2_next_frontier", f"WITH {_EDGES_SQL} SELECT e.dst AS url, min(p.depth) + 1 AS depth FROM e JOIN (SELECT url, min(depth) AS depth FROM document WHERE http_status = 200 GROUP BY 1) p ON p.url = e.src WHERE p.depth < 4 AND e.dst NOT IN (SELECT url FROM document) GROUP BY 1")
def g2(spark, d):
    """One distributed step: unseen children of the pages that were fetched."""
    links = graph.page_links(doc(spark, d), edge(spark, d)).select(F.col("src").alias("url"), F.col("dst").alias("dst_url"))
    parents = doc(spark, d).where("http_status = 200").groupBy("url").agg(F.min("depth").alias("depth")).withColumn("expand", F.lit(True))
    return pipeline.children(links, parents, 4).join(doc(spark, d).select("url"), "url", "left_anti")


@query("g3_degree_histogram", "SELECT n AS degree, count(*) AS pages FROM (SELECT count(*) AS n FROM link_edge GROUP BY src_document_id) GROUP BY 1")
def g3(spark, d):
    return edge(spark, d).groupBy("src_document_id").agg(F.count("*").alias("degree")).groupBy("degree").agg(F.count("*").alias("pages"))


@query("a18_crawl_stats", f"{_BFS_SQL} SELECT count(*) AS discovered, count_if(depth < 4)::BIGINT AS processed FROM (SELECT url, min(depth) AS depth FROM b GROUP BY 1)")
def a18(spark, d):
    return _crawl(spark, d).agg(F.count("*").alias("discovered"), F.count_if(F.col("depth") < 4).alias("processed"))


# The traversal under each crawl's own limits


def _crawls(spark, d):
    """Crawls with their limits, and their seeds: those of the crawl row and the crawl's documents of depth 0."""
    rows = table(spark, d, "crawl").select(F.col("id").alias("crawl_id"), "max_depth", "max_pages", "allowed_domains", "seeds")
    named = rows.select("crawl_id", F.explode("seeds").alias("url")).select("crawl_id", url.normalize_url(F.col("url")).alias("url"))
    roots = doc(spark, d).where("depth = 0").join(rows.select("crawl_id"), "crawl_id", "left_semi").select("crawl_id", "url")
    return rows.drop("seeds"), named.unionAll(roots).where("url IS NOT NULL").distinct()


def _fetched_pages(spark, d):
    """(url, fetched, expand): any response counts as fetched, all but a 304 may expand; near-duplicates have no stored links."""
    status = F.coalesce("http_status", F.lit(0))
    return doc(spark, d).groupBy("url").agg(F.max(status > 0).alias("fetched"), F.max((status > 0) & (status != 304)).alias("expand"))


@query("g1_crawl_bfs")
def g1_crawls(spark, d):
    crawls, seeds = _crawls(spark, d)
    return graph.crawl_bfs(crawls, seeds, _fetched_pages(spark, d), graph.page_links(doc(spark, d), edge(spark, d)))


@query("g2_crawl_frontier")
def g2_crawls(spark, d):
    """One distributed step under each crawl's limits: unseen children of the pages that were fetched."""
    crawls, seeds = _crawls(spark, d)
    links = graph.page_links(doc(spark, d), edge(spark, d)).select(F.col("src").alias("url"), F.col("dst").alias("dst_url"))
    status = F.coalesce("http_status", F.lit(0))
    rows = doc(spark, d).groupBy("crawl_id", "url").agg(F.min("depth").alias("depth"), F.max((status > 0) & (status != 304)).alias("expand"))
    parents = rows.join(crawls.select("crawl_id", "max_depth"), "crawl_id")
    return pipeline.crawl_children(links, parents, graph.domain_rules(crawls, seeds)).join(doc(spark, d).select("url"), "url", "left_anti").select("crawl_id", "url", "depth")


@query("a18_crawl_totals")
def a18_crawls(spark, d):
    return g1_crawls(spark, d).groupBy("crawl_id").agg(F.count("*").alias("discovered"), F.count_if("processed").alias("processed"))


# HTML and fingerprints of stored bodies


def pages(spark, d):
    """(content_hash, page) of every stored HTML body, decoded."""
    bodies = table(spark, d, "page_body").where(html.is_html(F.col("content_type")) & F.col("content_hash").isNotNull())
    return bodies.dropDuplicates(["content_hash"]).select("content_hash", html.decoded_body("body", "content_type").alias("page"))


_STORED_SQL = f"(SELECT DISTINCT content_hash FROM page_body WHERE {HTML_SQL} AND content_hash IS NOT NULL)"


@query("h1_titles", f"SELECT DISTINCT d.id, trim(d.title) AS title FROM document d SEMI JOIN {_STORED_SQL} p USING (content_hash) WHERE d.title IS NOT NULL")
def h1(spark, d):
    """Titles read from the bodies of the documents whose row has one."""
    titles = pages(spark, d).select("content_hash", html.html_title("page").alias("title"))
    return doc(spark, d).where("title IS NOT NULL").select("id", "content_hash").distinct().join(titles, "content_hash").select("id", "title")


def document_links(spark, d):
    rows = doc(spark, d).select("id", "url", "content_hash").distinct().join(pages(spark, d), "content_hash")
    return rows.select("id", F.posexplode(html.html_links("page", "url")).alias("pos", "link")).select("id", "pos", "link.url", "link.anchor")


@query("h3_links", f"SELECT DISTINCT e.src_document_id AS id, e.dst_url AS url FROM link_edge e SEMI JOIN (SELECT id FROM document d SEMI JOIN {_STORED_SQL} p USING (content_hash)) s ON s.id = e.src_document_id")
def h3(spark, d):
    return document_links(spark, d).select("id", "url")


@query("h4_visible_text")
def h4(spark, d):
    return pages(spark, d).select("content_hash", html.html_text("page").alias("text"))


@query("t2_token_hashes")
def t2(spark, d):
    return table(spark, d, "documents").select(F.explode(text.tokens(F.col("text"))).alias("token")).distinct().select("token", text.token_hashes("token").alias("hash"))


@query("t3_simhash", f"SELECT DISTINCT content_hash, simhash FROM document d SEMI JOIN {_STORED_SQL} p USING (content_hash) WHERE simhash IS NOT NULL")
def t3(spark, d):
    """Fingerprints of the stored bodies that a document with a fingerprint refers to."""
    asked = doc(spark, d).where("simhash IS NOT NULL").select("content_hash")
    return pages(spark, d).join(asked, "content_hash", "left_semi").select("content_hash", text.simhash(html.html_text("page")).alias("simhash"))


@query("t8_gzip_round_trip", "SELECT doc_id, true AS same FROM documents")
def t8(spark, d):
    raw = F.encode("text", "UTF-8")
    return table(spark, d, "documents").select("doc_id", (html.gunzip(html.gzip(raw)) == raw).alias("same"))


@query("t9_murmur", f"SELECT msg_id, {twins.murmur3('url')} AS hash FROM frontier_message")
def t9(spark, d):
    return table(spark, d, "frontier_message").select("msg_id", hashing.murmur3("url").alias("hash"))


@query("t11_bloom_places", f"SELECT DISTINCT id, {twins.bloom_places('url', hashing.optimal_bits(1_000_000, 0.01), 7)} AS places FROM document")
def t11(spark, d):
    places = hashing.bloom_indices(hashing.optimal_bits(1_000_000, 0.01), 7)
    return doc(spark, d).select("id", F.array_join(places("url"), ",").alias("places")).distinct()


@query("t23_robots")
def t23(spark, d):
    """Which document urls the robots files among the stored bodies allow."""
    files = doc(spark, d).where(F.col("url").endswith("/robots.txt") & F.col("content_hash").isNotNull()).select("content_hash", url.origin_of(F.col("url")).alias("origin"))
    bodies = table(spark, d, "page_body").dropDuplicates(["content_hash"]).select("content_hash", html.decoded_body("body", "content_type").alias("text"))
    rules = robots.robots_rules(files.join(bodies, "content_hash").select("origin", "text"))
    urls = doc(spark, d).select("url", url.origin_of(F.col("url")).alias("origin"), robots.path_of(F.col("url")).alias("path")).distinct()
    return robots.can_fetch(urls, rules)


@query(
    "j6_lsh_pairs",
    "WITH f AS (SELECT DISTINCT simhash AS fp FROM document WHERE simhash IS NOT NULL) SELECT x.fp AS a, y.fp AS b FROM f x JOIN f y ON x.fp < y.fp AND bit_count(xor(x.fp, y.fp)) <= 3",
)
def j6(spark, d):
    return dedup.fingerprint_pairs(doc(spark, d).select(F.col("simhash").alias("fp")))


@query("g4_greedy_leaders")
def g4(spark, d):
    # Stored: the leaders' rounds and the result read the fingerprints.
    rows = cut_lineage(spread(table(spark, d, "documents").select("doc_id", "text")).select(F.col("doc_id").alias("id"), text.simhash("text").alias("fp")))
    return dedup.greedy_leaders(rows)


@query("j5_probably_new")
def j5(spark, d):
    return bloom.unseen_rows(edge(spark, d).select(F.col("dst_url").alias("url")).distinct(), "url", doc(spark, d).select("url"))


# Sharding

NODES = [f"worker-{i}" for i in range(4)]


_DOMAINS_SQL = "SELECT DISTINCT registered_domain FROM document WHERE registered_domain IS NOT NULL"
_OWNED_SQL = twins.owned(_DOMAINS_SQL, "registered_domain", NODES)
_LOAD_SQL = f"SELECT v.node, count(o.node) AS n FROM (VALUES {', '.join(f'({chr(39)}{n}{chr(39)})' for n in NODES)}) v(node) LEFT JOIN ({_OWNED_SQL}) o ON o.node = v.node GROUP BY 1"
_IMBALANCE_SQL = f"SELECT CASE WHEN sum(n) > 0 THEN max(n) / (sum(n) / count(*)) ELSE 0.0 END::DOUBLE AS imbalance FROM ({_LOAD_SQL})"
_CHURN_SQL = f"""SELECT (SELECT avg((b.node IS DISTINCT FROM a.node)::INT) FROM ({_OWNED_SQL}) b JOIN ({twins.owned(_DOMAINS_SQL, "registered_domain", [*NODES, "worker-4"])}) a USING (registered_domain)) AS churn,
    (SELECT avg((h % 4 <> h % 5)::INT) FROM (SELECT {twins.murmur3("registered_domain")} AS h FROM ({_DOMAINS_SQL}))) AS naive_churn"""


@query("a12_load", _LOAD_SQL)
def a12(spark, d):
    keys = doc(spark, d).select("registered_domain").where("registered_domain IS NOT NULL").distinct()
    return sharding.distribution(keys.withColumn("node", sharding.assign(sharding.Ring(NODES))("registered_domain")), "node", NODES)


@query("a13_imbalance", _IMBALANCE_SQL)
def a13(spark, d):
    return sharding.imbalance(a12(spark, d))


@query("a14_churn", _CHURN_SQL)
def a14(spark, d):
    keys = doc(spark, d).select("registered_domain").where("registered_domain IS NOT NULL").distinct()
    ring = sharding.Ring(NODES)
    before, after = keys.withColumn("node", sharding.assign(ring)("registered_domain")), keys.withColumn("node", sharding.assign(ring.with_node("worker-4"))("registered_domain"))
    old, new = keys.withColumn("node", sharding.naive_shard(4)("registered_domain")), keys.withColumn("node", sharding.naive_shard(5)("registered_domain"))
    naive = sharding.churn(old, new, "registered_domain", "node").withColumnRenamed("churn", "naive_churn").scalar()
    return sharding.churn(before, after, "registered_domain", "node").select("churn", naive.alias("naive_churn"))


@query(
    "j8_successor",
    """WITH n AS (SELECT (n_nationkey * 40009 + 17) % 1000003 AS p, n_name FROM nation), k AS (SELECT p_partkey, (p_partkey * 7919) % 1000003 AS h FROM part)
    SELECT p_partkey, coalesce((SELECT arg_min(n_name, p) FROM n WHERE p > h), (SELECT arg_min(n_name, p) FROM n)) AS node FROM k""",
)
def j8(spark, d):
    points = [(r["p"], r["n_name"]) for r in table(spark, d, "nation").select(((F.col("n_nationkey").cast("long") * 40009 + 17) % 1000003).alias("p"), "n_name").collect()]  # 25 rows, fixed
    keys = table(spark, d, "part").select("p_partkey", ((F.col("p_partkey") * 7919) % 1000003).alias("h"))
    return sharding.successor_join(keys, "h", points, "node").select("p_partkey", "node")


@query("j10_moved", "SELECT round(avg(CASE WHEN a.node IS DISTINCT FROM b.node THEN 1.0 ELSE 0.0 END), 9) AS churn FROM (SELECT DISTINCT id, depth % 3 AS node FROM document) b LEFT JOIN (SELECT DISTINCT id, depth % 2 AS node FROM document WHERE depth > 0) a USING (id)")
def j10(spark, d):
    docs = doc(spark, d)
    before = docs.select("id", (F.col("depth") % 3).alias("node")).distinct()
    after = docs.where("depth > 0").select("id", (F.col("depth") % 2).alias("node")).distinct()
    return sharding.churn(before, after, "id", "node").select(F.round("churn", 9).alias("churn"))


@query("ring_points", twins.ring(NODES))
def ring_points(spark, d):
    ring = sharding.Ring(NODES)
    return spark.createDataFrame([(int(p), ring.nodes[o]) for p, o in zip(ring.points, ring.owners)], "point long, node string")


@query("ring_demo", f"SELECT *, ({_IMBALANCE_SQL}) AS imbalance FROM ({_CHURN_SQL})")
def ring_demo(spark, d):
    """Churn from 4 to 5 workers and load over the crawled domains."""
    return a14(spark, d).withColumn("imbalance", a13(spark, d).scalar())


# Writes


def _split(spark, d, condition):
    docs = doc(spark, d).where(condition)
    return docs.groupBy("url").agg(*[F.max(c).alias(c) for c in docs.columns if c != "url"])


_MAXES = ", ".join(f"max({c}) AS {c}" for c in ("http_status", "title", "content_hash", "depth", "in_degree", "registered_domain", "crawl_id")) + ", max(epoch_us(first_seen)) AS first_us"


@query(
    "au1_upsert",
    f"""WITH b AS (SELECT url, {_MAXES} FROM document WHERE depth <= 3 GROUP BY 1), i AS (SELECT url, {_MAXES} FROM document WHERE depth >= 2 GROUP BY 1)
    SELECT coalesce(i.url, b.url) AS url, """
    + ", ".join(f"CASE WHEN i.url IS NOT NULL THEN i.{c} ELSE b.{c} END AS {c}" for c in ("http_status", "title", "content_hash", "depth", "crawl_id"))
    + ", "
    + ", ".join(f"CASE WHEN b.url IS NOT NULL THEN b.{c} ELSE i.{c} END AS {c}" for c in ("in_degree", "registered_domain", "first_us"))
    + " FROM b FULL JOIN i ON b.url = i.url",
)
def au1(spark, d):
    merged = writes.upsert_documents(_split(spark, d, "depth <= 3"), _split(spark, d, "depth >= 2").withColumn("seq", F.lit(1)), "seq")
    return merged.select("url", "http_status", "title", "content_hash", "depth", "crawl_id", "in_degree", "registered_domain", F.unix_micros("first_seen").alias("first_us"))


@query("au2_insert_edges", "SELECT src_document_id, dst_url, CASE WHEN count(*) = count(anchor_text) THEN arg_min(anchor_text, id) END AS anchor_text FROM link_edge GROUP BY 1, 2")
def au2(spark, d):
    """Pairs stored without an anchor keep none; of the others the first comes in, with its anchor."""
    edges = edge(spark, d)
    return writes.insert_edges(edges.where("anchor_text IS NULL"), edges)


@query("au3_insert_bodies", "SELECT DISTINCT content_hash FROM page_body WHERE content_hash IS NOT NULL")
def au3(spark, d):
    bodies = table(spark, d, "page_body")
    return writes.insert_bodies(bodies.where("size = 0"), bodies).select("content_hash")


@query("au5_new_crawl", "SELECT id, name, status FROM crawl UNION ALL SELECT max(id) + 1, 'extra', 'running' FROM crawl")
def au5(spark, d):
    return writes.crawl_started(table(spark, d, "crawl"), "extra", ["https://one.example/"], 3, 100, NOW).select("id", "name", "status")


@query("au6_stop_crawl", "SELECT id, CASE WHEN id = 3 AND status = 'running' THEN 'stopped' ELSE status END AS status FROM crawl")
def au6(spark, d):
    return writes.crawl_stopped(table(spark, d, "crawl"), 3, NOW).select("id", "status")


@query("au7_set_null", "SELECT id, url, CASE WHEN crawl_id <> 3 THEN crawl_id END AS crawl_id FROM document")
def au7(spark, d):
    return writes.delete_crawl(doc(spark, d), 3).select("id", "url", "crawl_id")


@query("au7_cascade", "SELECT e.id FROM link_edge e ANTI JOIN (SELECT id FROM document WHERE http_status >= 400) g ON g.id = e.src_document_id")
def au7_cascade(spark, d):
    return writes.delete_documents(edge(spark, d), doc(spark, d).where("http_status >= 400")).select("id")


# Sources and sinks


def _answers(address, headers, options):
    """A transport without a network: pages about "why" time out."""
    if "why" in address:
        raise TimeoutError("no answer")
    return address, 200, {"Content-Type": "text/html"}, f"<html>{address}</html>".encode()


@query("s1_fetch", "SELECT DISTINCT url, CASE WHEN contains(url, 'why') THEN 0 ELSE 200 END AS status, CASE WHEN contains(url, 'why') THEN 0 ELSE strlen(url) + 13 END::INT AS n_bytes FROM document")
def s1(spark, d):
    requests = doc(spark, d).select("url").distinct().withColumn("headers", F.lit(None).cast("map<string,string>"))
    got = fetch.fetch(requests, _answers, fetch.FetchOptions(retries=1, backoff_seconds=0.0))
    return got.select("url", "status", F.octet_length("body").alias("n_bytes"))


@query("s2_body_cap", "SELECT doc_id, least(strlen(text), 1000)::INT AS n_bytes FROM documents")
def s2(spark, d):
    return table(spark, d, "documents").select("doc_id", F.octet_length(fetch.capped(F.encode("text", "UTF-8"), 1000)).alias("n_bytes"))


@query("s4_decoded", "SELECT doc_id, sha256(text) AS hash FROM documents")
def s4(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(html.decoded_body(F.encode("text", "UTF-8"), F.lit("text/plain; charset=utf-8")), 256).alias("hash"))


@query("s5_first_arrivals", "SELECT url, min(msg_id) AS msg_id FROM frontier_message WHERE url IS NOT NULL GROUP BY 1")
def s5(spark, d):
    """What an exact frontier hands out: each url once, with its first message."""
    return table(spark, d, "frontier_message").where("url IS NOT NULL").groupBy("url").agg(F.min("msg_id").alias("msg_id"))


_PARTITIONS = [str(i) for i in range(messages.PARTITIONS)]
_HOSTS_SQL = f"SELECT DISTINCT {HOST_SQL('url')} AS domain FROM frontier_message WHERE {HOST_SQL('url')} IS NOT NULL"
_PARTED_SQL = f"SELECT domain, n, node::INT AS partition FROM (SELECT {HOST_SQL('url')} AS domain, count(*) AS n FROM frontier_message WHERE {HOST_SQL('url')} IS NOT NULL GROUP BY 1) JOIN ({twins.owned(_HOSTS_SQL, 'domain', _PARTITIONS)}) USING (domain)"


@query("s6_partitioned_log", f"SELECT partition, sum(n)::BIGINT AS n FROM ({_PARTED_SQL}) GROUP BY 1")
def s6(spark, d):
    rows = table(spark, d, "frontier_message").withColumn("domain", url.registered_domain(F.col("url"))).where("domain <> ''")
    return messages.with_partition(rows, "domain").groupBy("partition").agg(F.count("*").alias("n"))


_FAILED_SQL = "SELECT *, CASE WHEN crawl_id IS NOT NULL THEN 'fetch_error' ELSE 'robots' END AS skipped FROM frontier_message"


def _failed(rows):
    return rows.withColumn("skipped", F.when(F.col("crawl_id").isNotNull(), "fetch_error").otherwise("robots"))


_ROUTED_SQL = f"""SELECT msg_id, CASE WHEN attempts < 3 THEN 'retry' ELSE 'dlq' END AS topic, CASE WHEN attempts < 3 THEN attempts + 1 ELSE attempts END::INT AS attempts,
    CASE WHEN attempts < 3 THEN 1740800000.0 + least(pow(2.0, attempts), 30.0) ELSE not_before END AS not_before FROM ({_FAILED_SQL}) WHERE skipped = 'fetch_error'"""


@query("s9_retry_and_dlq", _ROUTED_SQL)
def s9(spark, d):
    return messages.route_failures(_failed(table(spark, d, "frontier_message")), 1740800000.0).select("msg_id", "topic", "attempts", "not_before")


@query("s10_codec", "SELECT msg_id, url, depth, crawl_id, attempts, not_before FROM frontier_message WHERE url IS NOT NULL")
def s10(spark, d):
    rows = table(spark, d, "frontier_message")
    return messages.decode(rows.select("msg_id", messages.encode(rows).alias("json")), "json")


@query("s11_items", "SELECT url, depth, crawl_id, count(*) AS n FROM frontier_message GROUP BY 1, 2, 3")
def s11(spark, d):
    return messages.to_items(table(spark, d, "frontier_message")).groupBy("url", "depth", "crawl_id").agg(F.count("*").alias("n"))


@query("s12_page_records")
def s12(spark, d):
    """Records and links that the sink stores, parsed from the stored bodies."""
    rows = doc(spark, d).select("url", "content_hash", "content_type").distinct().join(pages(spark, d), "content_hash")
    records = pipeline.page_records(rows.select("url", F.col("url").alias("final_url"), "content_type", F.col("page").alias("html")))
    return records.select("url", "registered_domain", "title", F.size("links").alias("n_links"))


@query("s14_repacked", "SELECT DISTINCT content_hash FROM page_body WHERE content_hash IS NOT NULL")
def s14(spark, d):
    """Unpack, name by content and pack again: the names must be those stored."""
    raw = objects.unpack_bodies(table(spark, d, "page_body").where("content_hash IS NOT NULL")).withColumn("content_type", F.lit(None).cast("string"))
    return objects.pack_bodies(raw).select("content_hash")


@query("s15_storage_keys", "SELECT id, 'pg:' || content_hash AS pg, 's3://bodies/' || content_hash AS s3, '' AS noop FROM document WHERE content_hash IS NOT NULL")
def s15(spark, d):
    h = F.col("content_hash")
    return doc(spark, d).where(h.isNotNull()).select("id", objects.storage_key("sql", h).alias("pg"), objects.storage_key("minio", h).alias("s3"), objects.storage_key("noop", h).alias("noop"))


@query("s18_synthetic_site", "SELECT i AS src, (7 * i + j) % 1000 AS dst FROM range(1000) r(i), range(6) s(j) WHERE i % 10 <> 1")
def s18(spark, d):
    return site.site_edges(spark, 1000)


@query("s19_exposition", "SELECT 'documents_total{status=\"' || coalesce(http_status::VARCHAR, 'none') || '\"} ' || count(*)::VARCHAR AS line FROM document GROUP BY http_status")
def s19(spark, d):
    counts = doc(spark, d).groupBy("http_status").agg(F.count("*").alias("n"))
    return counts.select(F.concat(F.lit('documents_total{status="'), F.coalesce(F.col("http_status").cast("string"), F.lit("none")), F.lit('"} '), F.col("n").cast("string")).alias("line"))


_FLAGS_SQL = "SELECT id, depth < 6 AS robots_allowed, depth <> 5 AS circuit_allowed, in_degree < 8 AS budget_allowed, http_status AS status, content_length, simhash FROM document"


@query(
    "pl_outcomes",
    f"""SELECT id, skipped, skipped IS NULL OR skipped = 'not_modified' AS fetched, skipped IS NULL AS stored FROM (SELECT id, CASE WHEN NOT robots_allowed THEN 'robots' WHEN NOT circuit_allowed
    THEN 'circuit_open' WHEN NOT coalesce(budget_allowed, true) THEN 'budget_exhausted' WHEN coalesce(status, 0) <= 0 THEN 'fetch_error' WHEN status = 304 THEN 'not_modified' END AS skipped FROM ({_FLAGS_SQL}))""",
)
def pl_outcomes(spark, d):
    flags = doc(spark, d).select(
        "id", (F.col("depth") < 6).alias("robots_allowed"), (F.col("depth") != 5).alias("circuit_allowed"), (F.col("in_degree") < 8).alias("budget_allowed"),
        F.col("http_status").alias("status"), F.lit(None).cast("string").alias("error"), F.lit(False).alias("near_duplicate"),
    )
    return pipeline.outcomes(flags).select("id", "skipped", "fetched", "stored")


def _crawled(spark, d):
    """Documents as requests in order of their crawl through the real gates, parser and near-duplicate test."""
    at = F.unix_micros(F.coalesce("last_crawled", "first_seen"))
    files = doc(spark, d).where(F.col("url").endswith("/robots.txt") & F.col("content_hash").isNotNull()).select("content_hash", url.origin_of(F.col("url")).alias("origin"))
    bodies = table(spark, d, "page_body").where("content_hash IS NOT NULL").dropDuplicates(["content_hash"]).select("content_hash", html.decoded_body("body", "content_type").alias("html"))
    rules = robots.robots_rules(files.join(bodies, "content_hash").select("origin", F.col("html").alias("text")))
    rows = doc(spark, d).select("id", "url", F.col("http_status").alias("status"), "content_type", "content_hash", "etag", "last_modified", "depth", "crawl_id", (at * 4096 + F.col("id") % 4096).alias("seq"), (at / 1e6).alias("seconds"))
    requests = rows.where("seq IS NOT NULL").dropDuplicates(["seq"]).join(bodies, "content_hash", "left").withColumn("error", F.lit(None).cast("string"))
    return pipeline.crawl_pages(requests, rules, LIMIT, THRESHOLD, 86400.0)


@query("pl_pages")
def pl_pages(spark, d):
    return _crawled(spark, d).select("seq", "id", "skipped", "fetched", "stored", "expand", "breaker_failure", "near_duplicate", "keep_body", F.coalesce(F.size("links"), F.lit(0)).alias("n_links"))


@query("pl_documents")
def pl_documents(spark, d):
    """The documents that the pipeline leaves in an empty store."""
    return pipeline.store(_crawled(spark, d), doc(spark, d).where("false"), edge(spark, d).where("false"))[0].select("id", "url", "title", "simhash", "storage_key", "out_degree")


@query("pl_edges")
def pl_edges(spark, d):
    return pipeline.store(_crawled(spark, d), doc(spark, d).where("false"), edge(spark, d).where("false"))[1]


# Streams


def log_stream(spark, d, files=None):
    path = f"{d}/frontier_message.parquet"
    return frontier.file_stream(spark, path, spark.read.parquet(path).schema, files)


@query("r1_drained_log", "SELECT msg_id, count(*) AS n FROM frontier_message GROUP BY 1")
def r1(spark, d):
    """Every delivery of the log through checkpointed micro-batches."""
    return frontier.drain(log_stream(spark, d, 2).select("msg_id"), "r1").groupBy("msg_id").agg(F.count("*").alias("n"))


@query("r2_routed_stream", _ROUTED_SQL)
def r2(spark, d):
    return frontier.drain(messages.route_failures(_failed(log_stream(spark, d)), 1740800000.0).select("msg_id", "topic", "attempts", "not_before"), "r2")


@query("r3_due", "SELECT msg_id, not_before <= 1740900000.0 AS due FROM frontier_message WHERE not_before > 0")
def r3(spark, d):
    due, waiting = frontier.due_split(table(spark, d, "frontier_message").where("not_before > 0"), 1740900000.0)
    return due.select("msg_id", F.lit(True).alias("due")).unionAll(waiting.select("msg_id", F.lit(False).alias("due")))


@query("r4_unseen_stream", "SELECT DISTINCT url FROM frontier_message WHERE url IS NOT NULL")
def r4(spark, d):
    return frontier.drain(frontier.unseen_stream(log_stream(spark, d).where("url IS NOT NULL").select("url"), "url"), "r4")


@query("r6_unseen_within", "SELECT DISTINCT simhash FROM document WHERE simhash IS NOT NULL AND last_crawled IS NOT NULL")
def r6(spark, d):
    """Fingerprints new within a week's watermark, in one batch: none expires."""
    path = f"{d}/document.parquet"
    rows = frontier.file_stream(spark, path, spark.read.parquet(path).schema).where("simhash IS NOT NULL AND last_crawled IS NOT NULL").select("simhash", "last_crawled")
    return frontier.drain(frontier.unseen_within(rows, "simhash", "last_crawled", "365 days"), "r6").select("simhash")


@query("r6_near_duplicates")
def r6_near(spark, d):
    """Which documents a banded index with a life of 7 days calls near-duplicates, in order of their crawl."""
    path = f"{d}/document.parquet"
    rows = frontier.file_stream(spark, path, spark.read.parquet(path).schema).select("id", "simhash", (F.unix_micros("last_crawled") / 1e6).alias("seconds"))
    return frontier.drain(gates.near_duplicate_gate(rows, "id", "simhash", "seconds"), "r6n")


@query("r8_breaker_stream", _BREAKER_SQL)
def r8_stream(spark, d):
    path = f"{d}/events.parquet"
    stream = frontier.file_stream(spark, path, spark.read.parquet(path).schema, 2)
    rows = stream.select("user_id", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("seconds"), (F.col("event_type") == "error").alias("failed"))
    gate = gates.keyed_gate(rows, "user_id", "event_id", ["seconds", "failed"], state.breaker_step(THRESHOLD, 86400.0), "allowed boolean, state string", "mode string, failures int, opened double")
    return frontier.drain(gate, "r8")


@query("r9_budget_stream", _STRICT_SQL)
def r9_stream(spark, d):
    path = f"{d}/events.parquet"
    stream = frontier.file_stream(spark, path, spark.read.parquet(path).schema, 2).select("user_id", "event_id", (F.col("event_id") % 3 + 1).alias("cost"))
    return frontier.drain(gates.keyed_gate(stream, "user_id", "event_id", ["cost"], state.strict_budget_step(40), "allowed boolean, remaining long", "used long"), "r9")


@query("r14_recrawl", f"SELECT DISTINCT url, 0 AS depth, crawl_id FROM document WHERE {STALE_SQL}")
def r14(spark, d):
    """Stale documents back to the frontier at depth 0."""
    return doc(spark, d).where(analytics.stale(NOW, AGE)).select("url", F.lit(0).alias("depth"), "crawl_id").distinct()


@query("r15_domain_partitions", _PARTED_SQL)
def r15(spark, d):
    """The partition of each domain, and the messages that go there: were there two of a domain, it would have two rows."""
    rows = table(spark, d, "frontier_message").withColumn("domain", url.registered_domain(F.col("url"))).where("domain <> ''")
    return messages.with_partition(rows, "domain").groupBy("domain", "partition").agg(F.count("*").alias("n"))


@query(
    "r17_rates",
    """SELECT ((epoch_us(ts) // 60000000) * 60 + 60 * i)::BIGINT AS window_end_s, event_type, count(*) AS n, count(*) / 300.0::DOUBLE AS per_second FROM events, range(1, 6) r(i) GROUP BY 1, 2""",
)
def r17(spark, d):
    return panels.rates(events(spark, d), "ts", "event_type").select(F.unix_seconds("window_end").alias("window_end_s"), "event_type", "n", "per_second")


_BOUNDS = (1.0, 5.0, 10.0, 25.0, 50.0, 100.0, 500.0)


@query("r17_latency_quantiles", f"SELECT epoch(window_end)::BIGINT AS window_end_s, n, round(p50, 6) AS p50, round(p95, 6) AS p95, round(p99, 6) AS p99 FROM ({twins.latency_quantiles('events', 'ts', 'value', _BOUNDS, '1 day')})")
def r17_quantiles(spark, d):
    rows = panels.latency_quantiles(events(spark, d), "ts", "value", _BOUNDS, "1 day")
    return rows.select(F.unix_seconds("window_end").alias("window_end_s"), "n", *[F.round(p, 6).alias(p) for p in ("p50", "p95", "p99")])


# What remains of the inventory


@query("s7_consumed", "SELECT count(*) AS n, count(DISTINCT msg_id) AS n_messages FROM frontier_message")
def s7(spark, d):
    """The log read in bounded micro-batches, committed by the checkpoint."""
    rows = frontier.drain(log_stream(spark, d, 1).select("msg_id"), "s7")
    return rows.agg(F.count("*").alias("n"), F.countDistinct("msg_id").alias("n_messages"))


@query("s8_topics", "SELECT * FROM (VALUES ('frontier', 6), ('parsed', 6), ('retry', 6), ('dlq', 1)) t(topic, partitions)")
def s8(spark, d):
    return messages.create_topics(spark, frontier.scratch(spark, "topics"))


@query("s13_validators", "SELECT url, max(etag) AS etag, max(last_modified) AS last_modified FROM document WHERE etag IS NOT NULL OR last_modified IS NOT NULL GROUP BY url HAVING count(*) > 0")
def s13(spark, d):
    """Through a temporary view, as an in-memory sink keeps it."""
    doc(spark, d).where("etag IS NOT NULL OR last_modified IS NOT NULL").createOrReplaceTempView("stored_validators")
    return spark.sql("SELECT url, max(etag) AS etag, max(last_modified) AS last_modified FROM stored_validators GROUP BY url")


@query("s16_catalog", "SELECT 'crawl' AS name, count(*) AS n FROM crawl UNION ALL SELECT 'document', count(*) FROM document UNION ALL SELECT 'link_edge', count(*) FROM link_edge UNION ALL SELECT 'page_body', count(*) FROM page_body")
def s16(spark, d):
    """The store's tables as views of the session's catalog."""
    names = ("crawl", "document", "link_edge", "page_body")
    for name in names:
        table(spark, d, name).createOrReplaceTempView(f"store_{name}")
    return spark.sql(" UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n FROM store_{n}" for n in names))


@query("h2_base_href", "SELECT DISTINCT id, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) || '/base/page1.html' AS link FROM document")
def h2(spark, d):
    """A relative link of a page with a base, for every document's url."""
    page = F.lit('<html><head><base href="/base/"></head><body><a href="page1.html">One</a></body></html>')
    rows = doc(spark, d).select("id", "url").distinct()
    return rows.select("id", F.explode(html.html_links(page, "url")).alias("link")).select("id", F.col("link.url").alias("link"))


@query("au4_out_degree", f"SELECT DISTINCT id, out_degree AS n FROM document d SEMI JOIN {_STORED_SQL} p USING (content_hash)")
def au4(spark, d):
    """Out-degree at save: the distinct links of the stored body."""
    rows = doc(spark, d).select("id", "url", "content_hash").distinct().join(pages(spark, d), "content_hash")
    return rows.select("id", F.size(html.html_links("page", "url")).alias("n"))


@query("r5_seen_filter")
def r5(spark, d):
    """Messages whose url a filter over the stored urls lacks."""
    return bloom.unseen_rows(table(spark, d, "frontier_message").select("msg_id", "url"), "url", doc(spark, d).select("url")).select("msg_id")


@query("r7_token_bucket_stream", twins.token_bucket("(SELECT *, epoch_us(ts) / 1e3 AS now_ms FROM events)", "user_id", "event_id", "now_ms", 5, RATE / 10))
def r7(spark, d):
    path = f"{d}/events.parquet"
    stream = frontier.file_stream(spark, path, spark.read.parquet(path).schema, 2)
    rows = stream.select("user_id", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e3).alias("now_ms"), F.lit(1).alias("wanted"))
    return frontier.drain(gates.keyed_gate(rows, "user_id", "event_id", ["now_ms", "wanted"], state.token_bucket_step(5, RATE / 10), "allowed boolean, wait_ms long", "tokens double, then double"), "r7")


@query("r10_batches", "SELECT count(DISTINCT msg_id) AS n FROM frontier_message")
def r10(spark, d):
    """Back-pressure: one file a trigger, whatever the log's length."""
    return frontier.drain(log_stream(spark, d, 1).select("msg_id").dropDuplicates(["msg_id"]), "r10", settings=frontier.small_batches(spark)).agg(F.count("*").alias("n"))


@query("r11_host_tasks", f"SELECT {HOST_SQL('url')} AS host, 1::BIGINT AS tasks FROM frontier_message WHERE {HOST_SQL('url')} IS NOT NULL GROUP BY 1")
def r11(spark, d):
    """All requests of a host in one task, which is what a limit of connections per host needs."""
    rows = table(spark, d, "frontier_message").select(url.host_of(F.col("url")).alias("host")).where("host IS NOT NULL").repartition("host")
    return rows.select("host", F.spark_partition_id().alias("task")).groupBy("host").agg(F.countDistinct("task").alias("tasks"))


@query("r12_robots_origins", "SELECT DISTINCT regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)', 1) AS origin FROM document")
def r12(spark, d):
    """The origins whose robots file is fetched, each once."""
    return doc(spark, d).select(url.origin_of(F.col("url")).alias("origin")).distinct()


@query("r13_polite_slots")
def r13(spark, d):
    """When each allowed document may be fetched again: robots permission, then a paced slot of its host."""
    allowed = t23(spark, d).where("allowed").select("url")
    rows = doc(spark, d).join(allowed, "url", "left_semi").groupBy("id", "registered_domain").agg(F.max(F.unix_micros("last_crawled") / 1e6).alias("seconds"))
    return state.paced_grants(rows.where("seconds IS NOT NULL"), "registered_domain", "id", F.col("seconds"), 1.0).select("id", "registered_domain", "grant_s")


@query("r16_polled_statuses", "SELECT http_status, count(*) AS n FROM document GROUP BY http_status")
def r16(spark, d):
    path = f"{d}/document.parquet"
    return panels.polled_counts(frontier.file_stream(spark, path, spark.read.parquet(path).schema), "http_status", "polled_statuses")


@query("api_stats", "SELECT (SELECT count(*) FROM document) AS documents, (SELECT count(*) FROM link_edge) AS edges, (SELECT count(DISTINCT registered_domain) FROM document) AS domains, (SELECT count(*) FROM (SELECT content_hash FROM document WHERE content_hash IS NOT NULL GROUP BY 1 HAVING count(*) > 1)) AS near_duplicates")
def api_stats(spark, d):
    return CrawlAnalytics(spark, d).stats()


@query("api_graph", """SELECT DISTINCT d.id, d.url, coalesce(o.n, 0) AS out_degree, coalesce(i.n, 0) AS in_degree FROM document d LEFT JOIN (SELECT src_document_id, count(*) AS n FROM link_edge GROUP BY 1) o ON o.src_document_id = d.id
    LEFT JOIN (SELECT dst_url, count(*) AS n FROM link_edge GROUP BY 1) i ON i.dst_url = d.url ORDER BY in_degree DESC, url, id LIMIT 20""")
def api_graph(spark, d):
    return CrawlAnalytics(spark, d).graph(20)


@query("api_crawls", "SELECT c.id, c.name, c.status, c.max_depth, c.max_pages, (SELECT count(*) FROM document d WHERE d.crawl_id = c.id) AS documents FROM crawl c ORDER BY c.id DESC LIMIT 50")
def api_crawls(spark, d):
    return CrawlAnalytics(spark, d).crawls(50)


@query("api_documents", "SELECT id, url FROM document WHERE url ILIKE '%why%' OR title ILIKE '%why%' ORDER BY id DESC, url LIMIT 50")
def api_documents(spark, d):
    return CrawlAnalytics(spark, d).documents(50, q="why").select("id", "url")


@query("api_document", "SELECT id, url, depth, http_status FROM document WHERE id = 5")
def api_document(spark, d):
    return CrawlAnalytics(spark, d).document(5).select("id", "url", "depth", "http_status")


@query("api_links", "SELECT DISTINCT dst_url, anchor_text FROM link_edge WHERE src_document_id = 5 ORDER BY dst_url, anchor_text NULLS FIRST LIMIT 200")
def api_links(spark, d):
    return CrawlAnalytics(spark, d).links(5)


@query("api_domains", "SELECT registered_domain AS domain, count(*) AS n FROM document GROUP BY 1 ORDER BY n DESC, domain NULLS FIRST LIMIT 50")
def api_domains(spark, d):
    return CrawlAnalytics(spark, d).domains(50).toDF("domain", "n")


@query("api_create", "SELECT id, name, status, max_depth, max_pages FROM crawl UNION ALL SELECT max(id) + 1, 'mine', 'running', 2, 50 FROM crawl")
def api_create(spark, d):
    return CrawlAnalytics(spark, d).create_crawl("mine", ["https://one.example/"], 2, 50, NOW).select("id", "name", "status", "max_depth", "max_pages")


@query("api_stop", "SELECT id, CASE WHEN id = 1 AND status = 'running' THEN 'stopped' ELSE status END AS status FROM crawl")
def api_stop(spark, d):
    return CrawlAnalytics(spark, d).stop_crawl(1, NOW).select("id", "status")


@query("pl_parse_dedup")
def pl_parse_dedup(spark, d):
    """One job over the stored pages: title, links and fingerprint of each in one parse, then its near-duplicate flag."""
    parsed = cut_lineage(pages(spark, d).select("content_hash", html.html_title("page").alias("title"), F.size(html.html_links("page", F.lit("http://site.test/"))).alias("n_links"), text.simhash(html.html_text("page")).alias("fp")))
    flags = dedup.greedy_leaders(parsed.select(F.col("content_hash").alias("id"), "fp"))
    return parsed.join(flags.select(F.col("id").alias("content_hash"), "duplicate"), "content_hash")

"""The chained pipeline against a sequential loop."""

from gossamer.functions.html import links_of, visible_text
from gossamer.functions.robots import robots_rules
from gossamer.functions.text import simhash_of
from gossamer.operators import pipeline

LIMIT, THRESHOLD, RESET = 6, 2, 10.0
TEXT = " ".join(f"word{i}" for i in range(200))


def page(text, *hrefs):
    return f"<body>{text}" + "".join(f'<a href="{h}">x</a>' for h in hrefs) + "</body>"


ROWS = [
    ("http://a.test/private/1", 200, page("secret", "/x")), ("http://a.test/1", 200, page(TEXT, "/2", "/3")), ("http://a.test/2", 200, page(TEXT, "/4")), ("http://a.test/3", 304, None),
    ("http://a.test/4", 404, page("not here at all", "/5")), ("http://a.test/5", 200, "plain"), ("http://a.test/6", 200, page("other words", "/7")), ("http://a.test/7", 200, page("too late", "/8")),
    ("http://b.test/1", 500, page("broken", "/2")), ("http://b.test/2", 0, None), ("http://b.test/3", 200, page("closed", "/4")), ("http://b.test/4", 200, page("half open", "/5")), ("http://b.test/5", None, None),
    ("http://b.test/6", 200, page(TEXT, "/7")),
]
TIMES = [float(i) for i in range(11)] + [30.0, 31.0, 60.0]


def loop():
    used, breaker, leaders, out = {}, {}, [], []
    for (url, status, body), now in zip(ROWS, TIMES):
        host = url.split("/")[2]
        fails, opened = breaker.get(host, (0, None))
        skipped, duplicate, n = None, False, 0
        if "/private" in url:
            skipped = "robots"
        elif opened is not None and now - opened < RESET:
            skipped = "circuit_open"
        else:
            used[host] = used.get(host, 0) + 1
            if used[host] > LIMIT:
                skipped = "budget_exhausted"
            else:
                if not status or status >= 500:
                    fails += 1
                    breaker[host] = (fails, now if fails >= THRESHOLD or opened is not None else None)
                else:
                    breaker[host] = (0, None)
                skipped = "fetch_error" if not status else "not_modified" if status == 304 else None
        if skipped is None and body and body.startswith("<"):
            fp = simhash_of(visible_text(body))
            duplicate = any((fp ^ x).bit_count() <= 3 for x in leaders)
            if not duplicate:
                leaders.append(fp)
                n = len(links_of(body, url))
        out.append((skipped, skipped is None, duplicate, n, bool(skipped is None and body and not duplicate)))
    return out


def test_chain_is_that_of_a_loop(spark):
    rows = [(i, u, t, s, None, "text/html" if b and b.startswith("<") else "text/plain", b) for i, ((u, s, b), t) in enumerate(zip(ROWS, TIMES))]
    requests = spark.createDataFrame(rows, "seq long, url string, seconds double, status int, error string, content_type string, html string")
    rules = robots_rules(spark.createDataFrame([("http://a.test", "User-agent: *\nDisallow: /private")], "origin string, text string"))
    got = {r["seq"]: r for r in pipeline.crawl_pages(requests, rules, LIMIT, THRESHOLD, RESET).collect()}
    mine = [(got[i]["skipped"], got[i]["stored"], bool(got[i]["near_duplicate"]), len(got[i]["links"] or []), got[i]["keep_body"]) for i in range(len(ROWS))]
    assert mine == loop()
    assert {m[0] for m in mine} == {None, "robots", "circuit_open", "budget_exhausted", "fetch_error", "not_modified"} and any(m[2] for m in mine)


def test_store_keeps_the_row_of_a_near_duplicate_without_links_and_body(spark, data):
    docs, edges = (spark.read.parquet(f"{data}/{t}.parquet").where("false") for t in ("document", "link_edge"))
    rows = [(i, u, float(i), 200, None, "text/html", b, f"h{i}", None, None, 0, 1) for i, (u, _, b) in enumerate(ROWS[k] for k in (1, 13, 4))]
    requests = spark.createDataFrame(rows, "seq long, url string, seconds double, status int, error string, content_type string, html string, content_hash string, etag string, last_modified string, depth int, crawl_id int")
    rules = robots_rules(spark.createDataFrame([], "origin string, text string"))
    after, links = pipeline.store(pipeline.crawl_pages(requests, rules, LIMIT, THRESHOLD, RESET), docs, edges)
    got = {r["url"]: r for r in after.collect()}
    assert {u: (r["out_degree"], r["storage_key"]) for u, r in got.items()} == {"http://a.test/1": (2, "pg:h0"), "http://b.test/6": (0, None), "http://a.test/4": (1, "pg:h2")}
    want = {("http://a.test/1", "http://a.test/2"), ("http://a.test/1", "http://a.test/3"), ("http://a.test/4", "http://a.test/5")}
    assert {(r["src_document_id"], r["dst_url"]) for r in links.collect()} == {(got[u]["id"], dst) for u, dst in want}

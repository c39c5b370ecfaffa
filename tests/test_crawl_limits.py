"""Traversals under each crawl's own depth, pages and domains, against a sequential loop."""

import pytest
from gossamer.operators import graph, pipeline
from gossamer.plans import engine_queries

CRAWLS = [(1, 6, 100, None), (2, 2, 100, []), (3, 5, 100, ["a.test", "b.test"]), (4, 6, 3, ["a.test"]), (5, 0, 9, None)]
SEEDS = [(1, "http://a.test/0"), (2, "http://a.test/0"), (3, "http://a.test/0"), (4, "http://a.test/0"), (4, "http://a.test/2"), (5, "http://a.test/0"), (9, "http://a.test/0")]
# A chain of eight pages, a fan from the second, another domain, a cycle, a failed page with links and a long url.
EDGES = [(f"http://a.test/{i}", f"http://a.test/{i + 1}") for i in range(8)] + [("http://a.test/1", f"http://a.test/f{i}") for i in range(4)]
EDGES += [("http://a.test/1", "http://b.test/0"), ("http://b.test/0", "http://b.test/1"), ("http://a.test/3", "http://a.test/0")]
EDGES += [("http://a.test/f0", "http://a.test/lost"), ("http://a.test/f1", "http://a.test/unchanged"), ("http://a.test/0", "http://a.test/" + "x" * 2048), (None, "http://a.test/n")]
STATUS = {"http://a.test/f0": (False, False), "http://a.test/f1": (True, False)}
PAGES = [(u, *STATUS.get(u, (True, True))) for u in sorted({u for e in EDGES for u in e if u} - {"http://a.test/f3"})]


def loop(crawls, seeds, pages, edges):
    known, out = {u: (f, e) for u, f, e in pages}, {}
    for crawl, max_depth, max_pages, allowed in crawls:
        mine = sorted({u for c, u in seeds if c == crawl})
        domains = set(allowed or [u.split("/")[2] for u in mine])
        seen, queue, processed = {u: [0, False] for u in mine}, [(0, u) for u in mine], 0
        while queue:
            queue.sort()
            depth, u = queue.pop(0)
            fetched, expand = known.get(u, (False, False))
            if processed >= max_pages or not fetched:
                continue
            processed += 1
            seen[u][1] = True
            if depth >= max_depth or not expand:
                continue
            for src, dst in edges:
                if src == u and len(dst) <= 2048 and dst.split("/")[2] in domains and dst not in seen:
                    seen[dst] = [depth + 1, False]
                    queue.append((depth + 1, dst))
        out |= {(crawl, u): tuple(v) for u, v in seen.items()}
    return out


@pytest.fixture(scope="module")
def frames(spark):
    return (
        spark.createDataFrame(CRAWLS, "crawl_id int, max_depth int, max_pages int, allowed_domains array<string>"), spark.createDataFrame(SEEDS, "crawl_id int, url string"),
        spark.createDataFrame(PAGES, "url string, fetched boolean, expand boolean"), spark.createDataFrame(EDGES, "src string, dst string"),
    )


def test_crawl_bfs_is_that_of_a_loop(frames):
    rows = graph.crawl_bfs(*frames).collect()
    got = {(r["crawl_id"], r["url"]): (r["depth"], r["processed"]) for r in rows}
    assert len(got) == len(rows) and got == loop(CRAWLS, SEEDS, PAGES, EDGES)
    assert got[1, "http://a.test/6"] == (6, True) and (1, "http://a.test/7") not in got
    assert max(depth for (crawl, _), (depth, _) in got.items() if crawl == 2) == 2


def test_children_keep_their_crawls_limits(spark, frames):
    crawls, seeds, _, edges = frames
    parents = [(1, "http://a.test/4", 5, True, 6), (2, "http://a.test/5", 2, True, 2), (3, "http://a.test/1", 1, True, 5), (1, "http://a.test/1", 1, True, 6), (1, "http://a.test/f0", 2, False, 6)]
    rows = pipeline.crawl_children(edges.withColumnsRenamed({"src": "url", "dst": "dst_url"}), spark.createDataFrame(parents, "crawl_id int, url string, depth int, expand boolean, max_depth int"), graph.domain_rules(crawls, seeds))
    want = {("http://a.test/5", 1, 6), ("http://a.test/2", 1, 2), ("http://b.test/0", 3, 2)} | {(f"http://a.test/f{i}", 1, 2) for i in range(4)}
    assert {(r["url"], r["crawl_id"], r["depth"]) for r in rows.collect()} == want


def test_queries_follow_the_crawl_table(spark, data):
    limits = {r["id"]: r["max_depth"] for r in spark.read.parquet(f"{data}/crawl.parquet").collect()}
    rows = engine_queries.g1_crawls(spark, data).collect()
    assert rows and all(r["depth"] <= limits[r["crawl_id"]] for r in rows)
    totals = {r["crawl_id"]: (r["discovered"], r["processed"]) for r in engine_queries.a18_crawls(spark, data).collect()}
    assert totals == {c: (sum(r["crawl_id"] == c for r in rows), sum(r["crawl_id"] == c and r["processed"] for r in rows)) for c in totals}

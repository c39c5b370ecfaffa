import pytest
from pyspark.sql import functions as F

from gossamer.functions.text import signed64
from gossamer.functions.hashing import optimal_bits
from gossamer.operators import analytics, bloom, dedup, graph, pipeline, sharding, skew, writes

DOC = """id long, url string, registered_domain string, http_status int, content_type string, content_length int, title string, content_hash string, simhash long, storage_key string,
etag string, last_modified string, depth int, in_degree int, out_degree int, crawl_id int, first_seen timestamp, last_crawled timestamp"""


def docs(spark, *rows):
    names = [c.split()[0] for c in DOC.replace("\n", " ").split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], DOC)


# Skew


def test_salted_aggregate_matches_plain_grouping(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, None).otherwise((F.col("id") % 7).cast("string")).alias("k"), (F.col("id") % 11).alias("v"), F.lit(1).alias("n"), F.lit(2).alias("salt"))
    measures = {"n": ("count", F.lit(1)), "total": ("sum", F.col("v")), "least": ("min", F.col("v")), "most": ("max", F.col("v"))}
    got = skew.salted_aggregate(df, ["k"], measures, 8)
    want = df.groupBy("k").agg(F.count("*").alias("n"), F.sum("v").alias("total"), F.min("v").alias("least"), F.max("v").alias("most"))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_salted_aggregate_edges(spark):
    empty = spark.createDataFrame([], "k string, v long")
    assert skew.salted_aggregate(empty, ["k"], {"n": ("count", F.lit(1))}).count() == 0
    nulls = spark.createDataFrame([(None, None), (None, 1), ("", 2)], "k string, v long")
    got = {r["k"]: (r["n"], r["s"]) for r in skew.salted_aggregate(nulls, ["k"], {"n": ("count", F.col("v")), "s": ("sum", F.col("v"))}).collect()}
    assert got == {None: (1, 1), "": (1, 2)}
    with pytest.raises(ValueError):
        skew.salted_aggregate(nulls, ["k"], {"k": ("count", F.lit(1))})
    with pytest.raises(ValueError):
        skew.salted_aggregate(nulls, ["k"], {"x": ("median", F.lit(1))})


def test_heavy_hosts(spark):
    document = spark.createDataFrame([("a",)] * 50 + [(None,)] * 40 + [("b",)] * 4 + [("c",)] * 6, "registered_domain string")
    messages = spark.createDataFrame([(i, f"https://{'Big' if i % 2 else 'h' + str(i)}.example/{i}") for i in range(60)] + [(1, "https://Big.example/1"), (99, None), (98, "tel:1"), (None, "https://x.example/")], "msg_id long, url string")
    got = {tuple(r) for r in skew.heavy_hosts(document, messages, 0.05).collect()}
    assert got == {("document", "a"), ("document", "c"), ("frontier_message", "big.example")}
    nothing = skew.heavy_hosts(document.limit(0), messages.limit(0))
    assert nothing.count() == 0


def test_no_task_holds_a_hot_key(spark):
    hot = spark.range(20000).select(F.lit("one").alias("k"))
    partial = hot.select("k", F.pmod(F.monotonically_increasing_id(), F.lit(16)).alias("salt")).groupBy("k", "salt").count()
    assert partial.count() == 16


# Analytics


def test_near_duplicate_count_counts_groups(spark):
    d = docs(spark, {"id": 1, "url": "a", "content_hash": "x"}, {"id": 2, "url": "b", "content_hash": "x"}, {"id": 3, "url": "c", "content_hash": "x"}, {"id": 4, "url": "d"}, {"id": 5, "url": "e"})
    edges = spark.createDataFrame([(1, 1, "b", None)], "id long, src_document_id long, dst_url string, anchor_text string")
    row = analytics.document_counts(d, edges).first()
    assert (row["documents"], row["edges"], row["near_duplicates"]) == (5, 1, 1)


def test_degrees(spark):
    d = docs(spark, {"id": 1, "url": "A"}, {"id": 2, "url": "B"}, {"id": 3, "url": "C"})
    edges = spark.createDataFrame([(1, 1, "B"), (2, 1, "C"), (3, 2, "A"), (4, 2, "Z")], "id long, src_document_id long, dst_url string")
    assert {r["url"]: (r["out_degree"], r["in_degree"]) for r in analytics.degrees(d, edges).collect()} == {"A": (2, 1), "B": (2, 1), "C": (0, 1)}


def test_stale_is_strict_and_takes_nulls(spark):
    d = docs(spark, {"id": 1, "url": "a"}, {"id": 2, "url": "b"}).withColumn("last_crawled", F.when(F.col("id") == 2, F.lit("2025-01-01 00:00:00").cast("timestamp")))
    assert [r["id"] for r in d.where(analytics.stale("2025-01-02 00:00:00", 86400)).collect()] == [1]
    assert sorted(r["id"] for r in d.where(analytics.stale("2025-01-02 00:00:01", 86400)).collect()) == [1, 2]


def test_search_keeps_wildcards(spark):
    d = docs(spark, {"id": 1, "url": "http://x/a_b"}, {"id": 2, "url": "http://x/acb", "title": "T"}, {"id": 3, "url": "http://y", "title": "A1B"})
    assert sorted(r["id"] for r in d.where(analytics.document_filter(q="A_b")).collect()) == [1, 2, 3]
    assert d.where(analytics.document_filter("", "")).count() == 3


def test_limits():
    with pytest.raises(ValueError):
        analytics.checked_limit("documents", 201)
    assert analytics.checked_limit("domains", 500) == 500


@pytest.mark.parametrize("q", [0.0, 0.5, 0.95, 1.0])
def test_nearest_rank(spark, q):
    values = {"a": [5.0, 1.0, 1.0, 9.0, 3.0], "b": [2.0], "c": [float(i % 17) for i in range(1000)]}
    df = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs] + [("d", None)], "k string, v double")
    got = {r["k"]: (r["n"], r["v"]) for r in analytics.nearest_rank(df, "k", "v", q, 8).collect()}
    assert got == {k: (len(vs), sorted(vs)[min(len(vs) - 1, int(q * len(vs)))]) for k, vs in values.items()}


# Graph and fingerprints


def test_bfs(spark):
    edges = spark.createDataFrame([("/", "/b"), ("/", "/c"), ("/b", "/d"), ("/d", "/"), ("/c", "/c"), (None, "/x"), ("/", None)], "src string, dst string")
    seeds = spark.createDataFrame([("/",), ("/",), (None,)], "url string")
    levels = lambda n, pages=None: {r["url"]: r["depth"] for r in graph.bfs(seeds, edges, n, pages).collect()}
    assert levels(2) == {"/": 0, "/b": 1, "/c": 1, "/d": 2}
    assert levels(1) == {"/": 0, "/b": 1, "/c": 1}
    assert levels(0) == {"/": 0}
    assert levels(5, 2) == {"/": 0, "/b": 1}


def test_greedy_leaders_match_the_sequential_rule(spark):
    import random

    rng = random.Random(11)
    base = [rng.getrandbits(64) for _ in range(12)]
    fps = []
    for _ in range(150):
        fp = rng.choice(base)
        for _ in range(rng.randint(0, 4)):
            fp ^= 1 << rng.randrange(64)
        fps.append(fp)
    fps[7] = fps[3]
    leaders, want = [], {}
    for i, fp in enumerate(fps):
        want[i] = any(bin(fp ^ o).count("1") <= 3 for o in leaders)
        if not want[i]:
            leaders.append(fp)
    df = spark.createDataFrame([(i, signed64(fp)) for i, fp in enumerate(fps)] + [(999, None)], "id long, fp long")
    got = {r["id"]: r["duplicate"] for r in dedup.greedy_leaders(df).collect()}
    assert got.pop(999) is False and got == want


def test_a_chain_has_two_leaders(spark):
    df = spark.createDataFrame([(1, 0), (2, 0b111), (3, 0b111111)], "id long, fp long")
    assert {r["id"]: r["duplicate"] for r in dedup.greedy_leaders(df).collect()} == {1: False, 2: True, 3: False}


def test_bloom_antijoin(spark):
    keys = spark.createDataFrame([(f"http://x/{i}",) for i in range(2000)] + [(None,)], "url string")
    held = bloom.build_bloom(keys, "url", 2000, 0.01)
    one = bloom.Bloom(2000, 0.01)
    one.add([f"http://x/{i}" for i in range(2000)])
    assert (held.bits[: len(one.bits)] == one.bits).all()
    assert bloom.probably_new(keys, "url", held).count() == 0
    new = bloom.probably_new(spark.createDataFrame([(f"http://y/{i}",) for i in range(2000)], "url string"), "url", held).count()
    assert new > 0.97 * 2000
    with pytest.raises(ValueError):
        bloom.Bloom(10**9, 1e-6)


# Writes


def test_upsert(spark):
    base = docs(spark, {"id": 1, "url": "a", "depth": 3, "in_degree": 7, "http_status": 200, "title": "old"}, {"id": 2, "url": "b", "depth": 1})
    new = docs(spark, {"url": "a", "depth": 9, "in_degree": 0, "http_status": 404}, {"url": "a", "depth": 5, "http_status": 500}, {"url": "c", "depth": 1}, {"url": "d", "depth": 1}, {"url": None})
    incoming = new.withColumn("seq", F.when(F.col("depth") == 9, 1).otherwise(2))
    got = {r["url"]: r for r in writes.upsert_documents(base, incoming, "seq").collect()}
    assert set(got) == {"a", "b", "c", "d"}
    a = got["a"]
    assert (a["id"], a["depth"], a["http_status"], a["title"], a["in_degree"]) == (1, 5, 500, None, 7)
    assert got["b"]["id"] == 2 and sorted((got["c"]["id"], got["d"]["id"])) == [3, 4]


def test_edges_first_anchor_wins(spark):
    schema = "id long, src_document_id long, dst_url string, anchor_text string"
    base = spark.createDataFrame([(1, 1, "b", "first")], schema)
    new = spark.createDataFrame([(5, 1, "b", "second"), (7, 1, "c", "later"), (6, 1, "c", "sooner")], schema)
    assert {tuple(r) for r in writes.insert_edges(base, new).collect()} == {(1, "b", "first"), (1, "c", "sooner")}


def test_new_crawl(spark):
    crawls = spark.createDataFrame([], "id int, name string, seeds array<string>, status string, max_depth int, max_pages int, allowed_domains array<string>, created_at timestamp, updated_at timestamp")
    one = writes.crawl_started(crawls, "x", ["https://a.example"], 2, 5, "2025-01-01 00:00:00")
    assert (one.first()["id"], one.first()["status"]) == (1, "running")
    assert writes.crawl_started(crawls, "x", ["mailto:a"], 2, 5, "2025-01-01 00:00:00").first()["status"] == "failed"
    assert writes.crawl_stopped(one, 1, "2025-01-02 00:00:00").first()["status"] == "stopped"
    for bad in ([], 2, 5), (["a"], 21, 5), (["a"], 2, 0):
        with pytest.raises(ValueError):
            writes.crawl_started(crawls, "x", *bad, "2025-01-01 00:00:00")


# Sharding


def test_ring():
    nodes = [f"n{i}" for i in range(5)]
    ring, keys = sharding.Ring(nodes), [f"domain-{i}.com" for i in range(2000)]
    owners = ring.owners_of(keys)
    loads = [owners.count(n) for n in nodes]
    assert min(loads) > 0.65 * 400 and max(loads) < 1.35 * 400
    grown = ring.with_node("n5").owners_of(keys)
    moved = [(a, b) for a, b in zip(owners, grown) if a != b]
    assert moved and all(b == "n5" for _, b in moved)
    assert 0.08 < len(moved) / len(keys) < 0.30
    assert ring.with_node("n5").without_node("n5").owners_of(keys) == owners
    assert sharding.Ring([]).owners_of(["x"]) == [None]


def test_load_and_imbalance(spark):
    assigned = spark.createDataFrame([("k1", "a"), ("k2", "a"), ("k3", "b")], "k string, node string")
    counts = sharding.distribution(assigned, "node", ["a", "b", "c"])
    assert {r["node"]: r["n"] for r in counts.collect()} == {"a": 2, "b": 1, "c": 0}
    assert sharding.imbalance(counts).first()["imbalance"] == 2.0
    assert sharding.imbalance(counts.withColumn("n", F.lit(0))).first()["imbalance"] == 0.0
    after = spark.createDataFrame([("k1", "a"), ("k2", "b")], "k string, node string")
    assert sharding.churn(assigned, after, "k", "node").first()["churn"] == pytest.approx(2 / 3)


# Pipeline


def test_first_gate_names_the_skip(spark):
    schema = "n int, robots_allowed boolean, circuit_allowed boolean, budget_allowed boolean, near_duplicate boolean, status int, error string"
    rows = [
        (1, False, False, True, False, 200, None), (2, True, False, False, False, 200, None), (3, True, True, False, False, 200, None), (4, None, None, None, None, 0, "timeout"),
        (5, True, True, True, False, 304, None), (6, True, True, True, True, 200, None), (7, True, True, True, False, 503, None),
    ]
    got = {r["n"]: (r["skipped"], r["fetched"], r["stored"], r["expand"], r["breaker_failure"]) for r in pipeline.outcomes(spark.createDataFrame(rows, schema)).collect()}
    assert got == {
        1: ("robots", False, False, False, None), 2: ("circuit_open", False, False, False, None), 3: ("budget_exhausted", False, False, False, None), 4: ("fetch_error", False, False, False, True),
        5: ("not_modified", True, False, False, False), 6: (None, True, True, False, False), 7: (None, True, True, True, True),
    }


def test_records_and_children(spark):
    rows = [("http://h/", "http://h/", "text/html", '<title>T</title><body><a href="/b">b</a><a href="/b">again</a><a href="/c?utm_source=x">c</a>'), ("http://h/t", "http://h/t", "text/plain", "<a href='/z'>")]
    records = pipeline.page_records(spark.createDataFrame(rows, "url string, final_url string, content_type string, html string"))
    links = pipeline.link_rows(records)
    assert [(r["pos"], r["dst_url"], r["anchor_text"]) for r in links.orderBy("pos").collect()] == [(0, "http://h/b", "b"), (1, "http://h/c", "c")]
    parents = spark.createDataFrame([("http://h/", 0, True)], "url string, depth int, expand boolean")
    assert {(r["url"], r["depth"]) for r in pipeline.children(links, parents, 1).collect()} == {("http://h/b", 1), ("http://h/c", 1)}
    assert pipeline.children(links, parents, 0).count() == 0


def test_only_heavy_keys_are_salted(spark):
    df = spark.range(9000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id"))).alias("k"), F.col("id").alias("v")).repartition(5)
    found = skew.heavy_hashes(df, ["k"], 1 / 128)
    hot = df.where("k = 'hot'").select(F.xxhash64("k")).first()[0]
    assert hot in found and len(found) <= 128
    got = {r["k"]: (r["n"], r["s"]) for r in skew.salted_aggregate(df, ["k"], {"n": ("count", F.lit(1)), "s": ("sum", F.col("v"))}).where("n > 1").collect()}
    assert got == {"hot": (3000, sum(range(0, 9000, 3)))}
    spread = df.where(F.xxhash64("k").isin(found)).groupBy(F.floor(F.rand(17) * 64)).count()
    assert spread.count() == 64 and spread.agg(F.max("count")).first()[0] < 200


def test_filters_are_sized_by_their_keys(spark, monkeypatch):
    seen = spark.range(5000).select(F.concat(F.lit("https://x/"), "id").alias("url"))
    assert bloom.build_bloom(seen, "url").m > optimal_bits(4800, 0.01)
    new = spark.range(4000, 9000).select(F.concat(F.lit("https://x/"), "id").alias("url"), F.col("id"))
    rows = {r["id"] for r in bloom.unseen_rows(new, "url", seen).collect()}
    assert min(rows) >= 5000 and len(rows) > 3900
    monkeypatch.setattr(bloom, "MAX_BITS", 64)
    assert bloom.unseen_rows(new, "url", seen).count() == 4000


def test_a_long_chain_of_fingerprints(spark):
    """Leaders alternate along a chain in which each is near the next alone, so many rounds are needed."""
    values, fp = [], 0
    for i in range(20):
        values.append((i, fp))
        fp ^= 0b11 << (2 * i)
    df = spark.createDataFrame(values, "id long, fp long")
    leaders: list[int] = []
    want = {}
    for i, f in values:
        want[i] = any((f ^ g).bit_count() <= 3 for g in leaders)
        if not want[i]:
            leaders.append(f)
    assert {r["id"]: r["duplicate"] for r in dedup.greedy_leaders(df).collect()} == want


def test_generations_of_leaders_form_few_pairs(spark, monkeypatch):
    """Dense clusters and one hot band: the sequential rule's answer, without all the pairs of a cluster."""
    import random

    rng = random.Random(5)
    bases = [(7 << 48) | rng.getrandbits(48) for _ in range(8)]
    fps = [b ^ flip for b in bases for flip in (0, *(1 << i for i in range(64)))] + [(7 << 48) | rng.getrandbits(48) for _ in range(200)]
    rng.shuffle(fps)
    leaders, want = [], {}
    for i, fp in enumerate(fps):
        want[f"{i:04}"] = any((fp ^ o).bit_count() <= 3 for o in leaders)
        if not want[f"{i:04}"]:
            leaders.append(fp)
    stored = []

    def counted(df, cut=dedup.cut_lineage):
        held = cut(df)
        stored.append(held.count() if held.columns == ["late", "early"] else 0)
        return held

    monkeypatch.setattr(dedup, "SMALL", 100, raising=False)
    monkeypatch.setattr(dedup, "cut_lineage", counted)
    df = spark.createDataFrame([(f"{i:04}", signed64(fp)) for i, fp in enumerate(fps)], "id string, fp long")
    assert {r["id"]: r["duplicate"] for r in dedup.greedy_leaders(df).collect()} == want
    pairs = sum((a ^ b).bit_count() <= 3 for k, a in enumerate(fps) for b in fps[:k])
    assert 8 * 2000 < pairs and sum(stored) < pairs / 4


def test_a_cluster_must_name_its_folder(monkeypatch):
    from gossamer import session

    class Context:
        master = "spark://far:7077"

        def getConf(self):
            return self

        def get(self, *_):
            return None

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext, conf = Context(), Context()

    with pytest.raises(ValueError):
        session.shared_dir(Session())


def test_the_core_loads_without_the_llm_libraries():
    """An import that only the llm subpackage needs may be missing."""
    import subprocess
    import sys

    code = "import sys; sys.modules['xxhash'] = None; import __spark_entry__ as e; q = e.queries(); assert 'u1_normalize_url' in q and 'p1_found' not in q and e.oracle_sql()"
    root = str(__import__("pathlib").Path(__file__).parents[1])
    assert subprocess.run([sys.executable, "-W", "ignore", "-c", code], cwd=root).returncode == 0


def test_only_small_tables_are_spread(spark):
    from gossamer.session import spread

    one = spark.range(0, 10, 1, 1).select((F.col("id") + 1).alias("n"))
    cores = spark.sparkContext.defaultParallelism
    assert spread(one).rdd.getNumPartitions() == cores and {r[0] for r in spread(one).collect()} == set(range(1, 11))
    many = spark.range(0, 10, 1, cores + 3)
    assert spread(many) is many
    counted = one.groupBy("n").count()
    assert spread(counted) is counted

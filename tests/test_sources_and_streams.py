from pyspark.sql import functions as F

from gossamer.functions import html
from gossamer.operators import state
from gossamer.sources import fetch, messages, objects, site
from gossamer.streaming import frontier, gates, panels


def test_codec_defaults_and_garbage(spark):
    rows = spark.createDataFrame([(1, '{"url":"u"}'), (2, '{"url":"v","depth":3,"crawl_id":9,"attempts":2,"not_before":1.5}'), (3, "not json"), (4, '{"depth":1}'), (5, None)], "n int, json string")
    got = {r["n"]: tuple(r)[1:] for r in messages.decode(rows, "json").collect()}
    assert got == {1: ("u", 0, None, 0, 0.0), 2: ("v", 3, 9, 2, 1.5)}
    full = messages.decode(rows, "json")
    again = messages.decode(full.select("n", messages.encode(full).alias("json")), "json")
    assert again.exceptAll(full).count() == 0


def test_partition_is_stable_per_domain(spark):
    rows = spark.createDataFrame([(f"d{i % 20}", i) for i in range(100)], "domain string, i int")
    got = messages.with_partition(rows, "domain")
    assert got.groupBy("domain").agg(F.countDistinct("partition").alias("n")).where("n <> 1").count() == 0
    assert got.where("partition < 0 OR partition >= 6").count() == 0


def test_routing(spark):
    rows = spark.createDataFrame([("a", 0, "fetch_error", 0.0), ("b", 3, "fetch_error", 7.0), ("c", 1, "robots", 0.0), ("d", 2, "fetch_error", 0.0)], "url string, attempts int, skipped string, not_before double")
    got = {r["url"]: (r["topic"], r["attempts"], r["not_before"]) for r in messages.route_failures(rows, 100.0).collect()}
    assert got == {"a": ("retry", 1, 101.0), "b": ("dlq", 3, 7.0), "d": ("retry", 3, 104.0)}


def test_fetch_retries_and_caps(spark):
    def transport(url, headers, options):
        if url == "bad":
            raise OSError("down")
        return url + "/final", 200, {"content-TYPE": "text/html", **headers}, b"x" * 100

    requests = spark.createDataFrame([("bad", None), ("good", {"If-None-Match": "e"})], "url string, headers map<string,string>")
    got = {r["url"]: r for r in fetch.fetch(requests, transport, fetch.FetchOptions(retries=2, max_bytes=10, backoff_seconds=0.0)).collect()}
    assert got["bad"]["status"] == 0 and got["bad"]["error"] == "OSError: down" and got["bad"]["final_url"] == "bad"
    assert len(got["good"]["body"]) == 10 and got["good"]["content_type"] == "text/html" and got["good"]["headers"]["If-None-Match"] == "e"


def test_objects(spark):
    raw = spark.createDataFrame([(bytearray(b"one"), "text/plain"), (bytearray(b"one"), "x"), (bytearray(b""), "y"), (None, "z")], "raw binary, content_type string")
    packed = objects.pack_bodies(raw)
    assert packed.count() == 1 and packed.first()["size"] == 3
    assert bytes(objects.unpack_bodies(packed).first()["raw"]) == b"one"
    assert html.unpack(packed.first()["body"]) == b"one"


def test_synthetic_site_crawl_shape(spark):
    pages = site.synthetic_site(spark, 40)
    links = pages.select("page", html.html_links("html", "url").alias("l"))
    assert links.where("page % 10 <> 1").where(F.size("l") != 6).count() == 0
    assert links.where("page % 10 = 1").where(F.size("l") != 0).count() == 0
    text = pages.where("page % 10 = 1").select(html.html_text("html").alias("t")).distinct()
    assert text.count() == 1


def test_static_site(spark, tmp_path):
    (tmp_path / "index.html").write_text("<title>I</title>")
    (tmp_path / "page1.html").write_text("<title>P</title>")
    (tmp_path / "skip.txt").write_text("no")
    got = {r["url"]: r["html"] for r in site.static_site(spark, str(tmp_path)).collect()}
    assert got == {"http://static.test/": "<title>I</title>", "http://static.test/page1.html": "<title>P</title>"}


def test_streams_agree_with_batch(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"k{i % 5}", float(i), i % 3 == 0) for i in range(60)], "seq long, key string, seconds double, failed boolean")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    step = state.breaker_step(2, 10.0)
    stream = frontier.file_stream(spark, str(tmp_path / "in"), rows.schema)
    gate = gates.keyed_gate(stream, "key", "seq", ["seconds", "failed"], step, "allowed boolean, state string", "mode string, failures int, opened double")
    got = {r["seq"]: (r["allowed"], r["state"]) for r in frontier.drain(gate, "t").collect()}
    want = {r["seq"]: (r["allowed"], r["state"]) for r in state.keyed_fold(rows, "key", ["seq"], ["seconds", "failed"], step, "allowed boolean, state string").collect()}
    assert got == want and len(got) == 60
    unseen = frontier.drain(frontier.unseen_stream(frontier.file_stream(spark, str(tmp_path / "in"), rows.schema).select("key"), "key"), "u")
    assert sorted(r["key"] for r in unseen.collect()) == [f"k{i}" for i in range(5)]


def test_topics_and_due(spark, tmp_path):
    rows = spark.createDataFrame([("a", "retry", 5.0), ("b", "dlq", 0.0)], "url string, topic string, not_before double")
    for _ in range(2):  # a replayed batch overwrites itself
        frontier.split_topics(rows, 0, str(tmp_path))
    assert spark.read.parquet(str(tmp_path / "retry")).count() == 1 and spark.read.parquet(str(tmp_path / "dlq")).count() == 1
    due, waiting = frontier.due_split(rows, 1.0)
    assert (due.first()["url"], waiting.first()["url"]) == ("b", "a")


def test_histogram_quantile(spark):
    buckets = (1.0, 2.0, 4.0)
    row = spark.createDataFrame([(0, 10, 20, 20), (5, 5, 5, 10), (0, 0, 0, 0)], "a int, b int, c int, n int")
    got = [r["q"] for r in row.select(panels.histogram_quantile([F.col("a"), F.col("b"), F.col("c")], F.col("n"), buckets, 0.5).alias("q")).collect()]
    assert got == [2.0, 1.0, None]


def test_fetches_run_side_by_side_in_order(spark):
    import time

    def transport(address, headers, options):
        time.sleep(0.2)
        return address, 200, {}, address.encode()

    requests = spark.createDataFrame([(f"https://x.example/{i}", None) for i in range(40)], "url string, headers map<string,string>").coalesce(1)
    began = time.monotonic()
    got = fetch.fetch(requests, transport, fetch.FetchOptions(connections=20)).collect()
    assert [r["url"] for r in got] == [f"https://x.example/{i}" for i in range(40)] and all(bytes(r["body"]) == r["url"].encode() for r in got)
    assert max(r["elapsed"] for r in got) < 40 * 0.2 and time.monotonic() - began < 40 * 0.2


def test_batches_of_a_long_log_open_few_states(spark, tmp_path, monkeypatch):
    import os

    from gossamer.plans import QUERIES

    log = spark.range(90).select((F.col("id") % 70).alias("msg_id"))
    log.repartition(3).write.parquet(str(tmp_path / "frontier_message.parquet"))
    monkeypatch.setattr(frontier, "scratch", lambda session, name: str(tmp_path / name))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 40)
    try:
        assert QUERIES["r10_batches"](spark, str(tmp_path)).first()["n"] == 70
        assert spark.conf.get("spark.sql.shuffle.partitions") == "40" and spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    # One batch a file, each with the state of as many partitions as there are cores.
    assert sorted(os.listdir(tmp_path / "r10/data")) == ["batch=0", "batch=1", "batch=2"]
    assert len([x for x in os.listdir(tmp_path / "r10/state/state/0") if x.isdigit()]) == spark.sparkContext.defaultParallelism

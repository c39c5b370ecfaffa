import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from gossamer.functions.html import page_text, visible_text
from gossamer.llm import neardup
from gossamer.llm.components import connected_components


def components_by_hand(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)] + [(500, i) for i in range(501, 560)]
    edges += edges[:10] + [(None, 1), (2, None), (3, 3)]
    got = {r["vertex"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == components_by_hand(edges)


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert connected_components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0


def sentences(rng, n):
    return [" ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") * rng.randint(2, 5) + str(rng.randint(0, 300)) for _ in range(12)) + "." for _ in range(n)]


def corpus():
    rng = random.Random(5)
    texts = {}
    for g in range(12):
        base = sentences(rng, 12)
        for v in range(6):
            mine = list(base)
            for _ in range(v):
                mine[rng.randrange(len(mine))] = sentences(rng, 1)[0]
            if v == 5:
                mine = mine[6:] + mine[:6]
            texts[f"g{g}v{v}"] = " ".join(mine)
    # One group of copies holds a third of all rows; ties and short texts besides.
    for i in range(40):
        texts[f"copy{i:02}"] = texts["g0v0"]
    texts["short"] = "just three words"
    texts["empty"] = ""
    return texts


def brute(texts, width, threshold, least):
    sets = {}
    for key, t in texts.items():
        words = neardup.words_of(t)
        if len(words) >= max(least, width):
            sets[key] = {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}
    keys = sorted(sets)
    return {(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}


@pytest.fixture(scope="module")
def operator(spark):
    texts = corpus()
    rows = [(k, t, 1, b"x") for k, t in texts.items()] + [("g1v1", texts["g1v1"], 2, b"y"), (None, texts["g0v0"], 3, b"z"), ("null", None, 4, None)]
    # sig, cls and component clash with the operator's own names.
    df = spark.createDataFrame(rows, "key string, text string, cls int, sig binary").withColumn("component", F.lit(0)).repartition(6)
    return texts, neardup.NearDuplicates(df, lambda t: t or "", ["text"], 3, 0.7, 5)


def test_pairs_are_those_of_brute_force(operator):
    texts, op = operator
    got = [tuple(r) for r in op.key_pairs().collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(texts, 3, 0.7, 5)


def test_groups_lose_no_link(operator):
    texts, op = operator
    pairs = brute(texts, 3, 0.7, 5)
    rows = {r["key"]: r for r in op.groups().collect()}
    assert set(rows) == {k for k, t in texts.items() if len(neardup.words_of(t)) >= 5}
    assert all(rows[a]["group_id"] == rows[b]["group_id"] for a, b in pairs)
    hand = components_by_hand(pairs)
    groups = defaultdict(set)
    for k, r in rows.items():
        groups[r["group_id"]].add(hand.get(k, k))
    assert all(len(g) == 1 for g in groups.values())
    assert rows["copy00"]["n_copies"] == 41
    distinct = {k: frozenset(neardup.shingle_set(neardup.words_of(texts[k]), 3).tolist()) for k in rows}
    links = defaultdict(set)
    for a, b in pairs:
        if distinct[a] != distinct[b]:
            links[a].add(distinct[b])
            links[b].add(distinct[a])
    assert {k: r["n_links"] for k, r in rows.items()} == {k: len(links[k]) for k in rows}


@pytest.mark.parametrize("big", [256, 3])
def test_blocks_meet_once(spark, monkeypatch, big):
    monkeypatch.setattr(neardup, "BLOCK", 4)
    monkeypatch.setattr(neardup, "BIG", big)
    rng = random.Random(9)
    base = sentences(rng, 10)
    texts = {f"t{i:02}": " ".join(base[:9] + [sentences(rng, 1)[0]]) for i in range(30)}
    op = neardup.NearDuplicates(spark.createDataFrame(list(texts.items()), "key string, text string"), lambda t: t, ["text"], 3, 0.7, 5)
    got = [tuple(r) for r in op.key_pairs().collect()]
    assert len(got) == len(set(got)) and set(got) == brute(texts, 3, 0.7, 5)


def test_hot_buckets_give_the_same_pairs(spark, monkeypatch):
    texts = corpus()
    monkeypatch.setattr(neardup, "BIG", 2)
    monkeypatch.setattr(neardup, "BLOCK", 3)
    op = neardup.NearDuplicates(spark.createDataFrame(list(texts.items()), "key string, text string"), lambda t: t, ["text"], 3, 0.7, 5)
    assert {tuple(r) for r in op.key_pairs().collect()} == brute(texts, 3, 0.7, 5)


def test_a_chain_meets_only_along_its_links(spark, monkeypatch):
    """A component that is a long chain: the meetings grow with its links, not with the square of its length."""
    monkeypatch.setattr(neardup, "BLOCK", 4)
    rng = random.Random(21)
    lines = [" ".join(f"c{rng.randint(0, 9999)}" for _ in range(6)) for _ in range(260)]
    texts = {f"t{i:03}": " ".join(lines[i : i + 14]) for i in range(240)}
    op = neardup.NearDuplicates(spark.createDataFrame(list(texts.items()), "key string, text string"), lambda t: t, ["text"], 3, 0.8, 5)
    links = brute(texts, 3, 0.8, 5)
    assert {tuple(r) for r in op.key_pairs().collect()} == links
    blocks = 240 // 4
    met = neardup.candidate_meetings(op.components, op.pairs, op.hot)
    assert op.components.select("component").distinct().count() == 1
    assert met.count() <= 2 * op.pairs.count() and met.select("lo", "hi").distinct().count() < blocks * blocks // 2
    rows = {r["key"]: r for r in op.groups().collect()}
    degree = defaultdict(int)
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    assert {k: r["n_links"] for k, r in rows.items()} == {k: degree[k] for k in texts} and len({r["group_id"] for r in rows.values()}) == 1


def test_body_pairs_against_brute_force(spark, data):
    bodies = spark.read.parquet(f"{data}/page_body.parquet")
    texts = {r["content_hash"]: visible_text(page_text(r["body"], r["content_type"])) for r in bodies.where("lower(content_type) LIKE '%html%'").collect()}
    got = {tuple(r) for r in neardup.duplicate_bodies(bodies).collect()}
    assert got == brute(texts, 3, 0.7, 60) and got


def test_bodies_with_nulls_and_long_texts(spark):
    long = "<body>" + " ".join(f"word{i}" for i in range(60_000)) + "</body>"
    pack = lambda t: zlib.compress(t.encode(), wbits=31)
    rows = [("a", pack(long), "text/html"), ("b", pack(long + " tail"), "TEXT/HTML"), ("c", None, "text/html"), (None, pack(long), "text/html"), ("d", pack(""), "text/html"), ("e", pack(long), None), ("f", b"\x1f\x8bx", "text/html")]
    df = spark.createDataFrame(rows, "content_hash string, body binary, content_type string")
    assert [tuple(r) for r in neardup.duplicate_bodies(df).collect()] == [("a", "b")]


def test_signature_estimates_similarity():
    rng = random.Random(3)
    words = [str(rng.random()) for _ in range(2000)]
    a = neardup.shingle_set(words[:1500], 3)
    b = neardup.shingle_set(words[200:1700], 3)
    agree = (neardup.signature(a) == neardup.signature(b)).mean()
    assert abs(agree - 1300 / 1700) < 0.15

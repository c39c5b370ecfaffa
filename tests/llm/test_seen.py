import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gossamer.llm import seen


def keys(values):
    return np.array(values, dtype=np.uint64)


def test_no_false_negatives_and_a_known_bound():
    rng = np.random.RandomState(1)
    chain = seen.BloomChain(1e-3, 64)
    history = rng.randint(0, 2**62, 60_000).astype(np.uint64)
    first = chain.seen(history)
    assert chain.seen(history).all()
    assert len(chain.layers) > 3
    wrong = first.sum() - (len(history) - len(np.unique(history)))
    assert wrong <= 3 * 1e-3 * len(history)
    assert chain.bound < 1e-3
    assert sum(x.rate for x in chain.layers) < 1e-3
    absent = rng.randint(2**62, 2**63 - 1, 50_000).astype(np.uint64)
    assert chain.seen(absent).mean() < 2e-3


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 40), max_size=200), st.integers(1, 17))
def test_batches_make_no_difference(values, size):
    whole, parts = seen.BloomChain(1e-9, 4), seen.BloomChain(1e-9, 4)
    one = whole.seen(keys(values))
    many = [x for i in range(0, len(values), size) for x in parts.seen(keys(values[i : i + size]))]
    known, want = set(), []
    for v in values:
        want.append(v in known)
        known.add(v)
    assert list(one) == many == want


def test_dump_and_load():
    chain = seen.BloomChain(1e-4, 8)
    chain.seen(keys(range(1000)))
    again = seen.BloomChain.load(chain.dump())
    assert again.seen(keys(range(1000))).all() and again.bound == chain.bound and again.dump() == chain.dump()
    for bad in (0, 1):
        with pytest.raises(ValueError):
            seen.BloomChain(bad)


def log(spark, rows):
    return spark.createDataFrame(rows, "msg_id long, url string").withColumn("key", F.lit("clash")).withColumn("first", F.lit(1)).repartition(5)


def repeats(rows):
    from gossamer.functions.url import normalize_href

    known, out = set(), set()
    for i, u in sorted({(i, u) for i, u in rows if i is not None}, key=lambda r: r[0]):
        # Parameters with one name are kept apart by the frontier; the test's urls have none.
        n = normalize_href(u) if u and "://" in u else None
        if n:
            (out if n in known else known).add(i if n in known else n)
    return out


@pytest.mark.parametrize("block", [1 << 16, 8])
def test_repeats_match_a_set(spark, monkeypatch, block):
    monkeypatch.setattr(seen, "BLOCK", block)
    rng = random.Random(block)
    # One key on a third of all messages.
    rows = [(i, "https://hot.example/" if i % 3 == 0 else rng.choice(["http://A.example/", "HTTP://a.example", f"https://b.example/{rng.randint(0, 40)}?utm_source={i}", f" https://c.example/{i} "])) for i in range(600)]
    rows += [(5, rows[5][1]), (700, None), (701, ""), (702, "tel:1"), (703, "http://"), (None, "http://a.example/"), (704, "mailto:x")]
    got = [r["msg_id"] for r in seen.repeated_messages(log(spark, rows)).collect()]
    assert len(got) == len(set(got)) and set(got) == repeats(rows)


def test_error_rate_is_reported(spark):
    rows = [(i, f"https://x.example/{i % 700}") for i in range(1000)]
    row = seen.wrong_answer_rate(log(spark, rows)).first()
    assert row["n_keys"] == 700 and row["n_said_seen"] - row["n_wrong"] == row["n_asked"] - 700
    assert row["wrong_rate"] <= 5e-3 and 0 < row["bound"] < 1e-3


def test_state_goes_on(spark):
    firsts = spark.range(400).select(F.col("id").alias("key"), F.col("id").alias("first"))
    kept = seen.chain_answers(firsts, 4, keep_state=True).where("chain IS NOT NULL").select("shard", "chain")
    later = spark.range(200, 600).select(F.col("id").alias("key"), (F.col("id") + 1000).alias("first"))
    answers = {r["key"]: r["seen"] for r in seen.chain_answers(later, 4, state=kept).collect()}
    assert all(answers[k] for k in range(200, 400))
    assert sum(answers[k] for k in range(400, 600)) <= 2


def test_a_log_goes_on_from_kept_chains(spark):
    """The history's keys are gone; only its chains are at hand, whatever the session's partitions are now."""
    earlier = log(spark, [(i, f"https://x.example/{i % 300}") for i in range(500)])
    kept = seen.kept_chains(earlier, shards=8)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 3)
    try:
        later = log(spark, [(1000 + i, f"https://x.example/{200 + i}") for i in range(200)] + [(1500, "https://x.example/399")])
        got = {r[0] for r in seen.repeated_messages(later, kept).collect()}
        assert {1000 + i for i in range(100)} | {1500} <= got and len(got) <= 103
        again = seen.kept_chains(later, kept)
        assert again.select("shards").distinct().collect() == [(8,)]
        assert seen.repeated_messages(log(spark, [(2000, "https://x.example/5"), (2001, "https://x.example/350"), (2002, "https://new.example/")]), again).count() == 2
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_the_chain_answers_most_repeats(spark):
    rng = random.Random(3)
    rows = [(i, f"https://x.example/{int(rng.paretovariate(0.6))}") for i in range(30_000)]
    firsts = seen.block_firsts(seen.keyed_log(log(spark, rows)))
    later, whole = firsts.agg(F.sum(F.size("later"))).first()[0], len(repeats(rows))
    assert seen.chain_answers(firsts).where("seen").count() + later >= whole > later

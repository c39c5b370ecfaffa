import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gossamer.operators import scan, state


def rows(n=400, seed=3):
    rng = random.Random(seed)
    # One key holds most rows.
    return [(i, rng.choice(["hot", "hot", "hot", "a", "b", None]), rng.randint(0, 5), rng.random() < 0.5, float(i) + rng.random()) for i in range(n)]


SCHEMA = "seq long, key string, cost long, failed boolean, t double"


@pytest.mark.parametrize("kind", ["sum", "max"])
def test_blocked_scan(spark, kind):
    data = rows()
    got = {r["seq"]: r["out"] for r in scan.blocked_scan(spark.createDataFrame(data, SCHEMA), "key", "seq", "cost", "out", kind, block=16).collect()}
    held = {}
    for seq, key, cost, *_ in data:
        held[key] = cost if key not in held else held[key] + cost if kind == "sum" else max(held[key], cost)
        assert got[seq] == held[key]


def test_blocked_scan_of_nothing(spark):
    assert scan.blocked_scan(spark.createDataFrame([], SCHEMA), "key", "seq", "cost", "out").count() == 0
    one = scan.blocked_scan(spark.createDataFrame([(1, None, None, None, None)], SCHEMA), "key", "seq", "cost", "out").first()
    assert one["out"] == 0


def test_budget(spark):
    df = spark.createDataFrame([(i, "d", 1, False, 0.0) for i in range(5)], SCHEMA)
    got = [(r["allowed"], r["remaining"]) for r in state.budget(df, "key", "seq", 3).orderBy("seq").collect()]
    assert got == [(True, 2), (True, 1), (True, 0), (False, 0), (False, 0)]
    assert {(r["allowed"], r["remaining"]) for r in state.budget(df, "key", "seq", 0).collect()} == {(True, -1)}


def test_paced_grants_follow_a_bucket(spark):
    data, rate = rows(200), 0.5
    got = {r["seq"]: r["grant_s"] for r in state.paced_grants(spark.createDataFrame(data, SCHEMA), "key", "seq", F.col("t"), rate).collect()}
    last = {}
    for seq, key, _, _, t in data:
        last[key] = max(t, last[key] + 1 / rate) if key in last else t
        assert got[seq] == pytest.approx(last[key])


def test_streaks(spark):
    data = rows()
    got = {r["seq"]: (r["streak"], r["tripped"]) for r in state.failure_streaks(spark.createDataFrame(data, SCHEMA), "key", "seq", F.col("failed"), 3).collect()}
    run = {}
    for seq, key, _, failed, _ in data:
        run[key] = run.get(key, 0) + 1 if failed else 0
        assert got[seq] == (run[key], run[key] >= 3)


def test_keyed_fold_matches_a_loop(spark):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA).repartition(7)
    step = state.strict_budget_step(40)
    got = {r["seq"]: (r["allowed"], r["remaining"]) for r in state.keyed_fold(df, "key", ["seq"], ["cost"], step, "allowed boolean, remaining long").collect()}
    held = {}
    for seq, key, cost, *_ in data:
        held[key], want = step(held.get(key), (cost,))
        assert got[seq] == want


def drive(step, inputs):
    held, out = None, []
    for row in inputs:
        held, result = step(held, row)
        out.append(result)
    return out


def test_breaker():
    step = state.breaker_step(3, 10.0)
    out = drive(step, [(0, True), (1, True), (2, True), (5, False), (12, True), (13, False), (23, False), (24, True)])
    assert out == [(True, "closed"), (True, "closed"), (True, "open"), (False, "open"), (True, "open"), (False, "open"), (True, "closed"), (True, "closed")]
    with pytest.raises(ValueError):
        state.breaker_step(0)


def test_token_bucket():
    step = state.token_bucket_step(1, 10.0)
    assert drive(step, [(0, 1), (0, 1), (100, 1), (50, 1)]) == [(True, 0), (False, 100), (True, 0), (False, 100)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.floats(0, 1e6), st.integers(1, 3)), max_size=30), st.integers(1, 5), st.floats(0.1, 10))
def test_token_bucket_never_overspends(requests, capacity, rate):
    requests = sorted(requests)
    out = drive(state.token_bucket_step(capacity, rate), requests)
    spent = sum(n for (_, n), (ok, _) in zip(requests, out) if ok)
    span = (requests[-1][0] - requests[0][0]) / 1000 if requests else 0
    assert spent <= capacity + rate * span + 1e-6
    assert all((wait > 0) != ok for ok, wait in out)


def test_strict_budget_by_blocks_is_the_sequential_one(spark):

    rng = random.Random(6)
    rows = [(rng.choice(["hot", "hot", "hot", "b", None]), i, rng.choice([0, 1, 2, 5, 30, None])) for i in rng.sample(range(-50, 700), 500)] + [("hot", None, 1)]
    df = spark.createDataFrame(rows, "k string, n long, cost int").withColumn("_k", F.lit(1))
    for limit in (40, 0):
        got = {r["n"]: (r["k"], r["allowed"], r["remaining"]) for r in state.strict_budget(df, "k", "n", "cost", limit, 16).collect()}
        held, want = {}, {}
        step = state.strict_budget_step(limit)
        for k, n, cost in sorted((r for r in rows if r[1] is not None), key=lambda r: r[1]):
            held[k], result = step(held.get(k), (cost,))
            want[n] = (k, *result)
        assert got == want
    assert state.strict_budget(df.limit(0), "k", "n", "cost", 40).count() == 0

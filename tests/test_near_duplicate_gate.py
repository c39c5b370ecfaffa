"""The expiring banded index against a sequential loop."""

import random

from pyspark.sql import functions as F

from gossamer.streaming import frontier, gates

DAY, TTL = 86400.0, 7 * 86400.0


def loop(rows):
    """Rows (id, fp, seconds) in order. A bucket is walked back from now through its leaders as long as no gap reaches the life."""
    leaders, out = [], {}
    for id_, fp, now in rows:
        duplicate = False
        for band in range(4):
            value = (fp >> 16 * band) & 0xFFFF
            at = now
            for other, then in reversed([x for x in leaders if (x[0] >> 16 * band) & 0xFFFF == value]):
                if at - then >= TTL:
                    break
                at = then
                duplicate |= bin((fp ^ other) & (2**64 - 1)).count("1") <= 3
        out[id_] = duplicate
        if not duplicate:
            leaders.append((fp, now))
    return out


def test_bands_hamming_and_expiry(spark, tmp_path):
    rng = random.Random(7)
    bases = [rng.getrandbits(63) * rng.choice([1, -1]) for _ in range(12)]
    rows = [(1, 0, 0.0), (2, 0b111, DAY), (3, 0b1111, 2 * DAY), (4, 0, 8.5 * DAY), (5, 0, 16 * DAY)]
    at = 20 * DAY
    for i in range(6, 400):
        fp = rng.choice(bases)
        for _ in range(rng.randint(0, 6)):
            fp ^= 1 << rng.randrange(60)
        at += rng.choice([0.0, 0.02, 0.1, 0.5]) * DAY + (8 * DAY if i % 120 == 0 else 0)
        rows.append((i, fp, at))
    want = loop(rows)
    # A bucket that a new leader prolongs keeps its old ones; a week without any ends it.
    assert [want[i] for i in range(1, 6)] == [False, True, False, True, False]
    for n, part in enumerate((rows[:200], rows[200:])):
        spark.createDataFrame(part, "id long, fp long, seconds double").coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    schema = spark.read.parquet(f"{tmp_path}/in/0").schema
    got = frontier.drain(gates.near_duplicate_gate(frontier.file_stream(spark, f"{tmp_path}/in", schema, 1), "id", "fp", "seconds"), "near")
    assert {r["id"]: r["duplicate"] for r in got.collect()} == want
    assert got.where("duplicate").count() > 50 and got.where(~F.col("duplicate")).count() > 50

"""Full grouping: every stored body gets a row, short and plain texts among them."""

import zlib
from collections import Counter

from gossamer.llm import neardup, queries


def pack(text):
    return zlib.compress(text.encode(), wbits=31)


def test_short_plain_and_wordless_bodies_are_grouped(spark):
    words = [f"w{i}" for i in range(30)]
    rows = [
        ("a", pack("<title>A</title><body>Page introuvable</body>"), "text/html"), ("b", pack("<title>B</title><body>Page <b>introuvable</b></body>"), "application/xhtml+xml"),
        ("c", pack("page introuvable"), "text/plain; charset=utf-8"), ("d", pack("<b>page</b> introuvable"), "text/plain"), ("e", pack(" ".join(words)), None),
        ("f", pack("<body>" + " ".join(words[:-1] + ["end"]) + "</body>"), "TEXT/HTML"), ("g", pack(""), "text/html"), ("h", pack("..."), "text/plain"), ("i", b"\x89PNG page introuvable", "image/png"),
        ("j", None, "text/html"), (None, pack("page introuvable"), "text/html"), ("c", pack("page introuvable"), "text/plain; charset=utf-8"),
    ]
    got = {}
    for r in neardup.body_groups(spark.createDataFrame(rows, "content_hash string, body binary, content_type string")).collect():
        assert r["key"] not in got
        got[r["key"]] = r
    assert set(got) == set("abcdefghij")
    parts = Counter(r["group_id"] for r in got.values())
    assert got["a"]["cls"] == got["b"]["cls"] == got["c"]["cls"] and got["a"]["n_copies"] == 3
    assert got["e"]["group_id"] == got["f"]["group_id"] and got["e"]["n_links"] == 1
    assert all(parts[got[k]["group_id"]] == 1 and got[k]["n_copies"] == 1 and got[k]["n_links"] == 0 for k in "dghij")


def test_every_stored_body_has_a_row(spark, data):
    want = {r[0] for r in spark.read.parquet(f"{data}/page_body.parquet").where("content_hash IS NOT NULL").select("content_hash").distinct().collect()}
    got = [r["content_hash"] for r in queries.p1_groups(spark, data).collect()]
    assert len(got) == len(want) and set(got) == want

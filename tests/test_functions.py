import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gossamer.functions import hashing, html, robots, scalars, text, url

BASE = "http://example.com/dir/page"


@pytest.mark.parametrize(
    "href,want",
    [
        ("/a", "http://example.com/a"),
        ("b?z=1&a=2", "http://example.com/dir/b?a=2&z=1"),
        ("HTTP://Example.COM/Path/", "http://example.com/Path/"),
        ("/p#frag", "http://example.com/p"),
        ("/p?utm_source=x&id=3", "http://example.com/p?id=3"),
        ("mailto:a@b.c", None),
        ("javascript:void(0)", None),
        ("#top", None),
        ("ftp://example.com/x", None),
        ("http://[bad", None),
        ("//other.example", "http://other.example/"),
        ("/x%2fy", "http://example.com/x%2Fy"),
        ("/q?v=2&v=1", "http://example.com/q?v=2"),
        ("", None),
        (None, None),
    ],
)
def test_href(href, want):
    assert url.normalize_href(href, BASE) == want


def test_native_normalization(spark):
    cases = {
        "  https://A.Example/x?b=2&a=1#f \n": "https://a.example/x?a=1&b=2",
        "https://a.example": "https://a.example/",
        "https://a.example?": "https://a.example/",
        "https://a.example/x?v=b&v=a&gclid=1": "https://a.example/x?v=a&v=b",
        "https://a.example/X/%c3%a9": "https://a.example/X/%C3%A9",
        "https://a.example/x?flag": "https://a.example/x?flag=",
        "https://User:pW@A.example:8080/": "https://User:pW@a.example:8080/",
        "http://": None,
        "http://:80/x": None,
        "ftp://a.example/": None,
        "/relative": None,
        "": None,
        "https://a.example/100%": "https://a.example/100%",
    }
    df = spark.createDataFrame(list(cases.items()), "u string, want string")
    assert df.where(~url.normalize_url(F.col("u")).eqNullSafe(F.col("want"))).collect() == []
    odd = ["http://user@", "http://user@/x", "http://a@b@c.example", "http://a@:80", "HTTPS://x", "  http://x  ", "http://?q", "http://#f", "https:/x", "xhttp://a", "http://x?y=a@b", "http://[::1]/", "http://x/@y"]
    more = df.select("u").unionAll(spark.createDataFrame([(o,) for o in odd], "u string"))
    assert more.where(url.crawlable(F.col("u")) != url.normalize_url(F.col("u")).isNotNull()).collect() == []
    nulls = spark.createDataFrame([(None,)], "u string").select(url.normalize_url(F.col("u")).alias("n"), url.host_of(F.col("u")).alias("h"), url.registered_domain(F.col("u")).alias("d")).first()
    assert tuple(nulls) == (None, None, "")


def test_domains(spark):
    cases = {
        "https://www.shop.example.co.uk/x": "example.co.uk",
        "https://a.b.example.com": "example.com",
        "https://co.uk/": "co.uk",
        "http://127.0.0.1:9/": "127.0.0.1",
        "https://a.b.invalid/": "a.b.invalid",
        "nothing": "",
    }
    df = spark.createDataFrame(list(cases.items()), "u string, want string")
    assert df.where(url.registered_domain(F.col("u")) != F.col("want")).collect() == []


PAGE = """<html><head><title> Example &amp; Page </title><base href="/base/"></head><body><script>var x = "<a href='/no'>";</script>
<a href="page1.html">One</a> <a href='/abs'>Two</a><a href="page1.html#x">again</a><a href="mailto:x@y">m</a><a href=https://other.example>O<b>ut</b></a><p>unclosed
<style>p{}</style><noscript>hidden</noscript><!-- no --><template>t</template>tail &lt;end&gt;</body></html>"""


def test_html():
    assert html.title_of(PAGE) == "Example & Page"
    assert html.links_of(PAGE, "http://example.com/d/p") == [
        ("http://example.com/base/page1.html", "One"),
        ("http://example.com/abs", "Two"),
        ("https://other.example/", "Out"),
    ]
    seen = html.visible_text(PAGE)
    assert "hidden" not in seen and "var x" not in seen and "Example" not in seen and seen.endswith("tail <end>")
    assert html.title_of("<p>none") is None and html.visible_text("") == ""
    assert html.visible_text("no body <b>at</b> all") == "no body  at  all"


def test_visible_text_against_the_stdlib_parser(spark, data):
    from html.parser import HTMLParser

    class Slow(HTMLParser):
        def __init__(self):
            super().__init__()
            self.words, self.hidden, self.body = [], 0, False

        def handle_starttag(self, tag, attrs):
            self.body |= tag == "body"
            self.hidden += tag in ("script", "style", "noscript", "template")

        def handle_endtag(self, tag):
            self.hidden -= tag in ("script", "style", "noscript", "template")

        def handle_data(self, data):
            if self.body and not self.hidden:
                self.words += data.split()

    rows = spark.read.parquet(f"{data}/page_body.parquet").where(html.is_html(F.col("content_type"))).collect()
    assert rows
    for r in rows:
        page = html.page_text(r["body"], r["content_type"])
        slow = Slow()
        slow.feed(page)
        assert html.visible_text(page).split() == slow.words


def test_bodies():
    assert html.unpack(None) == b"" and html.unpack(b"plain") == b"plain"
    assert html.unpack(b"\x1f\x8bbroken") == b""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    assert html.unpack(packer.compress(b"x" * 9999) + packer.flush()) == b"x" * 9999
    assert html.decode("é".encode("latin-1"), "text/html; charset=ISO-8859-1") == "é"
    assert html.decode(b"\xff", "text/html; charset=nonsense") == "�"


def test_simhash():
    assert text.simhash_of("") == 0 and text.simhash_of(None) == 0
    assert text.simhash_of("hello world") == 0x30C12801C4100D
    assert text.simhash_of("Éléa über_x 日本") == 0xEA22185DE9759B73
    base = "the quick brown fox jumps over the lazy dog near the river bank " * 3
    near, far = text.simhash_of(base + "today"), text.simhash_of("completely different words about compilers and type systems " * 5)
    distance = lambda a, b: bin(a ^ b).count("1")
    assert distance(text.simhash_of(base), near) < distance(text.simhash_of(base), far)
    assert distance(text.simhash_of(base), far) > 12


def test_bands(spark):
    row = spark.createDataFrame([(text.signed64(0xABCD123456789ABC), -1)], "fp long, m long").select(
        text.band_values(F.col("fp")).alias("b"), text.hamming(F.col("m"), F.lit(0).cast("long")).alias("h"), text.band_values(F.col("m"), 3).alias("odd")
    ).first()
    assert row["b"] == [0x9ABC, 0x5678, 0x1234, 0xABCD] and row["h"] == 64 and row["odd"] == [(1 << 21) - 1] * 3


def test_murmur_vectors():
    known = {b"": 0, b"a": 0x3C2569B2, b"abc": 0xB3DD93FA, b"hello": 0x248BFA47, b"hello, world": 0x149BBB7F, b"The quick brown fox jumps over the lazy dog": 0x2E4FF723}
    assert hashing.murmur3_32(list(known)).tolist() == list(known.values())
    assert int(hashing.murmur3_32([b""], 1)[0]) == 0x514E28B7


@settings(max_examples=50, deadline=None)
@given(st.lists(st.binary(max_size=20), min_size=1, max_size=30))
def test_murmur_batches_agree_with_single_values(values):
    assert hashing.murmur3_32(values).tolist() == [int(hashing.murmur3_32([v])[0]) for v in values]


def test_bloom_sizing():
    m = hashing.optimal_bits(1_000_000, 0.01)
    assert m == 9585059 and hashing.optimal_hashes(m, 1_000_000) == 7
    places = hashing.bloom_indices_of([b"x", b"y"], 1000, 5)
    assert places.shape == (2, 5) and (places < 1000).all()


def test_robots(spark):
    rules = robots.parse_robots("User-agent: *\nDisallow: /private\nCrawl-delay: 2\n# c\n")
    assert rules == ([(False, "/private")], 2.0)
    assert robots.parse_robots("User-agent: a\nUser-agent: mybot\nAllow: /\n\nUser-agent: *\nDisallow: /", "MyBot/1.0") == ([(True, "/")], None)
    assert robots.parse_robots(None) == ([], None)
    files = spark.createDataFrame([("http://h", "User-agent: *\nDisallow: /private\nAllow: /private/open\nDisallow: /*.pdf$\nCrawl-delay: 2")], "origin string, text string")
    table = robots.robots_rules(files)
    urls = spark.createDataFrame(
        [("http://h/public", "http://h", "/public"), ("http://h/private/x", "http://h", "/private/x"), ("http://h/private/open/y", "http://h", "/private/open/y"),
         ("http://h/a.pdf", "http://h", "/a.pdf"), ("http://h/a.pdf?x", "http://h", "/a.pdf?x"), ("http://o/", "http://o", "/")],
        "url string, origin string, path string",
    )
    got = {r["url"]: r["allowed"] for r in robots.can_fetch(urls, table).collect()}
    assert got == {"http://h/public": True, "http://h/private/x": False, "http://h/private/open/y": True, "http://h/a.pdf": False, "http://h/a.pdf?x": True, "http://o/": True}
    assert [tuple(r) for r in robots.crawl_delay(table).collect()] == [("http://h", 2.0)]


def test_intervals(spark):
    rows, current = [], None
    for _ in range(4):
        current = spark.createDataFrame([(current,)], "c double").select(scalars.next_interval(F.col("c"), F.lit(False), 100.0, 1000.0, 2.0).alias("n")).first()["n"]
        rows.append(current)
    assert rows == [100.0, 200.0, 400.0, 800.0]
    assert spark.createDataFrame([(800.0,)], "c double").select(scalars.next_interval(F.col("c"), F.lit(False), 100.0, 1000.0, 2.0).alias("n")).first()["n"] == 1000.0
    assert spark.createDataFrame([(800.0,)], "c double").select(scalars.next_interval(F.col("c"), F.lit(True), 100.0, 1000.0, 2.0).alias("n")).first()["n"] == 100.0


def test_public_suffixes_by_rule(spark):
    cases = {
        "www.service.gov.uk": "service.gov.uk", "gov.uk": "gov.uk", "a.b.co.kr": "b.co.kr", "www.bbc.co.uk": "bbc.co.uk", "x.y.de": "y.de", "y.de": "y.de", "a.b.com": "b.com", "shop.example": "shop.example",
        "a.b.test": "a.b.test", "10.0.0.1": "10.0.0.1", "localhost": "localhost", "a.b.com.au": "b.com.au", "www.univ.ac.jp": "univ.ac.jp", "co.uk": "co.uk", "uk": "uk", "[::1]": "[::1]", "a.b.museum": "b.museum",
    }
    df = spark.createDataFrame(list(cases.items()), "host string, want string")
    assert df.where(~url.registered_domain_of_host(F.col("host")).eqNullSafe(F.col("want"))).collect() == []


def test_unsafe_characters_are_encoded(spark):
    cases = {
        "http://h/é ü?q=a b": "http://h/%C3%A9%20%C3%BC?q=a%20b", "http://h/%c3%a9": "http://h/%C3%A9", 'http://h/<a>"b"': "http://h/%3Ca%3E%22b%22", "http://h/\U0001f600": "http://h/%F0%9F%98%80",
        "http://h/a+b?x=1&y=[2]": "http://h/a+b?x=1&y=[2]", "http://h/100%": "http://h/100%", " http://H ": "http://h/",
    }
    df = spark.createDataFrame(list(cases.items()), "u string, want string")
    got = df.select("want", url.normalize_url(F.col("u"), True, True).alias("native"), url.normalize_hrefs(F.col("u"), F.lit(None).cast("string")).alias("python")).collect()
    assert [(r["native"], r["python"]) for r in got] == [(r["want"], r["want"]) for r in got]


def test_a_filter_has_eight_bits_at_least():
    assert hashing.optimal_bits(1, 0.5) == 8 and hashing.optimal_hashes(8, 1) == 6

"""Main content, stuffed pages and residue."""

import itertools
import os
import random
import zlib
from html.parser import HTMLParser

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gossamer.functions.html import page_text, title_of
from gossamer.llm import boilerplate, content_model, residue, spam
from gossamer.llm.boilerplate import cut_labels, label_page
from gossamer.llm.content_model import ContentModel, Layout
from gossamer.llm.maxflow import min_cut
from gossamer.llm.page import Page


def cost(unary, edges, labels):
    return sum(max(0, u) if not x else max(0, -u) for u, x in zip(unary, labels)) + sum(w for i, j, w in edges if labels[i] != labels[j])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(-6, 6), max_size=8), st.data())
def test_min_cut_is_least(unary, data):
    n = len(unary)
    edges = data.draw(st.lists(st.tuples(st.integers(0, n - 1), st.integers(0, n - 1), st.integers(0, 4)), max_size=14)) if n else []
    got = min_cut(unary, edges)
    real = [(i, j, w) for i, j, w in edges if i != j]
    assert len(got) == n
    assert cost(unary, real, got) == min((cost(unary, real, x) for x in itertools.product((False, True), repeat=n)), default=0)


def test_min_cut_pulls_a_doubtful_vertex():
    assert min_cut([3, -0.5, 3], [(0, 1, 1.0), (1, 2, 1.0)]) == [True, True, True]
    assert min_cut([0], []) == [False] and min_cut([], []) == []


PROSE = "The small boat crossed the lake before the wind turned. Nobody on the shore had expected it so early."


def page(main, **parts):
    top = parts.get("top", '<div class="content"><a href="/a">Home</a><a href="/b">Shop</a><a href="/c">Forum</a></div>')
    end = parts.get("end", '<div><p>© 2021 Lake Paper. All rights reserved.</p><p>Printed with care by Ann.</p></div>')
    return f"<html><head><title>{parts.get('title', 'Boats')}</title></head><body>{top}{main}{end}</body></html>"


@pytest.fixture(scope="module")
def model(spark):
    folder = "/root/testdata/sf0.01/page_body.parquet"
    if not os.path.exists(folder):
        pytest.skip("no test tables here")
    return boilerplate.fitted_model(spark.read.parquet(folder))


def own(html, model):
    p = label_page(html, model)
    return [t for t, mine in zip(p.text, p.label) if mine]


def test_article_with_interruptions(model):
    main = f"""<main><article><h1>Boats</h1><div><span>By Ann Lake</span><span>3 May</span><span>4 min read</span></div><p>{PROSE}</p>
    <div class="article-info"><p>We use cookies to measure visits.</p><button>OK</button></div><div class="promo"><p>Get one letter a month.</p><button>Subscribe</button></div>
    <p>{PROSE} <a href="/x">A related idea</a> stays inside.</p><ul><li>Oars</li><li>Sails are heavy when wet.</li></ul><table><tr><td>mast</td><td>12 m</td></tr></table><pre><code>x = 1</code></pre>
    <div>Advertisement</div><div><span>Share</span><span>Print</span><span>Mail</span></div></article></main>
    <div><h3>Comments</h3><div><b>joe12</b><p>{PROSE}</p></div></div><aside><h3>Related</h3><ul><li><a href="/1">More boats</a></li></ul></aside>"""
    assert own(page(main), model) == ["Boats", PROSE, PROSE, "A related idea", "stays inside.", "Oars", "Sails are heavy when wet.", "mast", "12 m", "x = 1"]


def test_table_layout_without_headline(model):
    main = f"<table><tr><td><p>{PROSE}</p><p>{PROSE}</p></td></tr></table><table><tr><td><h3>More from this section</h3><ul><li><a href='/q'>Next</a></li></ul></td></tr></table>"
    assert own(page(main), model) == [PROSE, PROSE]


def test_a_message_is_the_content(model):
    assert own(page("<div><h1>Lake Paper</h1><p>You need to enable JavaScript to run this app.</p></div>"), model) == ["Lake Paper", "You need to enable JavaScript to run this app."]


def test_pages_without_anything(model):
    for text in ("", "<html></html>", "<body><script>x</script></body>", "<body>" + "<div>" * 3000):
        assert own(text, model) == []
    assert label_page("<<<>>>", model).text == ["<<<>>>"]


def test_a_very_long_page_is_read_to_its_end(model):
    body = "<main><h1>T</h1>" + f"<p>{PROSE}</p>" * 4000 + "<p>The very last line ends here.</p></main>"
    assert own(page(body), model)[-1] == "The very last line ends here." and len(own(page(body), model)) == 4002


def test_the_cut_decides(model):
    """Without any capacity between nodes some labels differ; on the pages at hand the edges settle doubtful nodes."""
    doubtful = page(f"<main><article><h1>Boats</h1><p>{PROSE}</p><div><span>Zurp</span><span>Share</span><span>Print</span><span>Mail</span></div><p>{PROSE}</p></article></main>")
    layout, costs = model.layout(Page(doubtful))
    at = layout.page.text.index("Zurp")
    labels = cut_labels(layout, costs)
    assert not labels[at] and not any(labels[at : at + 4])
    raised = [2.0 if i == at else c for i, c in enumerate(costs)]
    assert not cut_labels(layout, raised)[at]  # against the sign of its own cost


def test_prior_without_a_model():
    bare = ContentModel()
    got = own(page(f"<main><article><h1>Boats</h1><p>{PROSE}</p></article></main><aside><a href='/x'>More</a></aside>"), bare)
    assert got == ["Boats", PROSE]
    assert content_model.fit([], cut_labels).words == {} and Layout(Page(""), None).main == 0


def test_words_are_learned_not_listed():
    """Prompts of an invented language are learned where the markup gives them away, and known where it doesn't."""
    rng = random.Random(5)
    nouns = ["lake", "boat", "wind", "oar", "sail", "shore"]

    def prose():
        return " ".join(f"The {rng.choice(nouns)} near the {rng.choice(nouns)} moved before the {rng.choice(nouns)} did." for _ in range(3))

    def make(inside):
        prompt = "<div><p>Brupu zalo fendi.</p></div>"
        return f"<body><nav><a href='/'>Home</a></nav><main><h1>{rng.choice(nouns)}</h1><p>{prose()}</p>{prompt if inside else ''}<p>{prose()}</p></main>{'' if inside else '<aside>' + prompt + '</aside>'}</body>"

    model = content_model.fit([Page(make(False)) for _ in range(40)], cut_labels)
    assert "Brupu zalo fendi." not in own(make(True), model)


class Slow(HTMLParser):
    """Node numbering by the standard library."""

    def __init__(self):
        super().__init__()
        self.nodes, self.hidden, self.body = [], 0, False

    def handle_starttag(self, tag, attrs):
        self.body |= tag == "body"
        self.hidden += tag in ("script", "style", "noscript", "template")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style", "noscript", "template")

    def handle_data(self, data):
        if self.body and not self.hidden and data.strip():
            self.nodes.append(data.strip())


def test_node_numbers(spark, data):
    rows = spark.read.parquet(f"{data}/page_body.parquet").where("lower(content_type) LIKE '%html%'").collect()
    for r in rows:
        text = page_text(r["body"], r["content_type"])
        slow = Slow()
        slow.feed(text)
        assert Page(text).text == slow.nodes


def pack(text, charset="utf-8"):
    return zlib.compress(text.encode(charset), wbits=31)


BODY = "content_hash string, body binary, content_type string, nodes string, shapes int, kind int"


def test_own_nodes_of_dirty_bodies(spark):
    good = page(f"<main><h1>Été</h1><p>{PROSE}</p></main>")
    rows = [("a", pack(good), "text/html"), ("a", pack(good), "text/html"), ("b", pack(good, "latin-1"), "text/html; charset=ISO-8859-1") if False else ("b", pack(good.replace("©", "(c)"), "latin-1"), "TEXT/HTML; charset=ISO-8859-1"),
            ("c", None, "text/html"), (None, pack(good), "text/html"), ("d", pack(good), "text/plain"), ("e", pack(good), None), ("f", b"\x1f\x8b??", "text/html"), ("g", b"", "text/html")]
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], BODY)
    got = sorted(tuple(r) for r in boilerplate.own_nodes(df).collect())
    assert got == [("a", 4), ("a", 5), ("b", 4), ("b", 5)]


# Stuffed pages


@pytest.mark.parametrize(
    "line,linked,sentence",
    [
        ("The small boat crossed the lake before noon.", False, True),
        ("SHE SAID THAT THE BOAT – AFTER ALL – CROSSED.", False, True),
        ("cheap boats * best boats * boats sale * buy boats.", False, False),
        ("Cheap boats, best boats, boats sale, buy boats.", False, False),
        ("#boats #cheapboats #buyboats", False, False),
        ("The small boat crossed the lake before noon.", True, False),
        ("boats boats boats boats boats boats boats boats boats boats boats boats.", False, False),
        ("Too short.", False, False),
        ("", False, False),
    ],
)
def test_line_shapes(line, linked, sentence):
    assert spam.line_shape(line, linked)[1] is sentence


def flagged(spark, pages, documents=None):
    bodies = spark.createDataFrame([(k, pack(t), "text/html", "x", 1, 2) for k, t in pages.items()], BODY)
    rows = [(*r, 200)[:4] for r in documents or [(i, k, None) for i, k in enumerate(pages)]]
    docs = spark.createDataFrame(rows, "id long, content_hash string, title string, http_status int")
    return bodies, docs


def test_stuffed_documents(spark):
    rng = random.Random(2)
    words = ["cheap", "best", "buy", "sale"]
    keywords = " * ".join(f"{rng.choice(words)} boats" for _ in range(80))
    links = "<ul>" + "".join(f"<li><a href='/{i}'>buy boats {i}</a></li>" for i in range(60)) + "</ul>"
    pages = {
        "prose": page(f"<main><h1>Boats</h1><p>{PROSE}</p><p>{PROSE}</p></main>"),
        "keywords": page(f"<main><h1>boats sale</h1><p>{keywords}</p></main>"),
        "links": page(f"<main><h1>boats</h1>{links}</main>"),
        "explained": page(f"<main><h1>Boats</h1><p>{PROSE * 12}</p><p>{' * '.join(['boat tag'] * 20)}</p></main>"),
        "error": page("<div><h1>404 Not Found</h1><p>The address /a was not found</p></div>"),
    }
    bodies, docs = flagged(spark, pages, [(1, "prose", None), (2, "keywords", None), (2, "keywords", None), (3, "keywords", "t"), (4, "links", None), (5, "explained", None), (6, "error", None), (7, "gone", None), (8, None, None), (None, "keywords", None)])
    assert sorted(r["document_id"] for r in spam.stuffed_documents(docs, bodies).collect()) == [2, 3, 4]


def test_dominance_by_few_shapes_decides(spark):
    """Two pages without sentences: one of few shapes, one of many, of which none prevails."""
    few = [("L7a0", False, 40, 200), ("L3a0@", False, 40, 100), ("L1a0", False, 10, 10)]
    many = [(f"L{size}{case}{gap}", False, 5, 20) for size in ("1", "3", "7", "15") for case in "0as" for gap in "0m"]
    said = [("L7a0", False, 5, 60), ("S15s0", True, 4, 40)]
    df = spark.createDataFrame([("few", few), ("many", many), ("said", said), ("none", [])], spam.SHAPES)
    assert [r[0] for r in df.where(spam.is_stuffed(F.col("shapes"))).collect()] == ["few"]


def test_shape_groups(spark):
    keywords = " * ".join(["cheap boats", "best boats"] * 40)
    pages = {"a": page(f"<main><h1>boats</h1><p>{keywords}</p></main>"), "b": page(f"<main><h1>boats</h1><p>{keywords} * boats</p></main>"), "ok": page(f"<main><h1>Boats</h1><p>{PROSE}</p></main>")}
    bodies, docs = flagged(spark, pages, [(1, "a", None), (1, "a", None), (2, "a", None), (3, "ok", None)])
    rows = spam.shape_groups(docs.withColumn("out_degree", F.when(F.col("id") == 1, 4)), bodies).collect()
    assert sum(r["n_bodies"] for r in rows) == 2 and sum(r["n_documents"] for r in rows) == 2
    assert {r["mean_out_degree"] for r in rows if r["n_documents"]} == {4.0}


# Residue


@pytest.mark.parametrize(
    "text", ["Dear {{ user.name }}, hello", "Pay ${total} now", "<%= title %>", "{% block x %}", "Hi [first name], news", "From [[COMPANY NAME]] today", "Hello %%NAME%%, hi", "@@teaser@@", "Price: $PRICE$ net", "Call {PHONE} now", "to XX_CITY_XX soon", "TITLE_GOES_HERE", "__SITE_NAME__", "only ?? km", "%s - %s"]
)
def test_placeholders(text):
    assert residue.PLACEHOLDER.search(text)


@pytest.mark.parametrize("text", ["a set {1, 2}", "see [1] and [sic]", "50% of 3 $ or 5 $", "C# and F#", "rate: 10%", "He asked why??", "array[i]", "100 %", "snake_case_name", "user@@example", "a {b"])
def test_no_placeholders(text):
    assert not residue.PLACEHOLDER.search(text)


def kind(main, model, title="Boats"):
    html = page(main, title=title)
    return residue.residue_kind(label_page(html, model), title_of(html))


def test_residue_kinds(model):
    real = f"<p>{PROSE}</p>" * 4
    assert kind(f"<main><h1>Boats</h1>{real}</main>", model) is None
    assert kind(f"<main><h1>Boats</h1>{real}<p>Dear {{{{ name }}}}, thank you.</p></main>", model) == residue.PLACE
    assert kind(f"<main><h1>Boats</h1>{real}<p>Dear , thank you for all.</p></main>", model) == residue.PLACE
    assert kind(f"<main><h1>Your heading goes here</h1>{real}</main>", model) == residue.FILLER
    assert kind("<main><h1>Welcome</h1><p>Lorem ipsum dolor sit amet, consectetur adipiscing elit. Sed tempor magna velit nibh orci lectus.</p></main>", model) == residue.FILLER
    assert kind("<main><h1>Oops!</h1><p>Something went wrong on our side.</p></main>", model) == residue.ERROR
    assert kind(f"<main><h1>Boats</h1>{real}</main>", model, "{{title}} – Lake") == residue.TITLE
    assert kind(f"<main><h1>Boats</h1>{real}</main>", model, "undefined | Lake") == residue.TITLE


def test_talk_about_residue_is_no_residue(model):
    real = f"<p>{PROSE}</p>" * 6
    assert kind(f"<main><h1>Templates</h1><pre><code>{{{{ name }}}}</code></pre><p>The block above prints a field.</p>{real}</main>", model) is None
    assert kind(f"<main><h1>Templates</h1><pre><code>x</code></pre><p>In a template, {{{{ name }}}} prints the name of the user.</p>{real}</main>", model) is None
    assert kind(f"<main><h1>Codes</h1><p>A page not found reply is normal, and a crawler lists it.</p>{real}</main>", model) is None
    assert kind(f"<main><h1>Print</h1><p>The printer calls its dummy copy lorem ipsum, and so do we all.</p>{real}</main>", model) is None
    assert kind(f"<main><h1>Boats</h1><noscript><p>Please enable JavaScript.</p></noscript>{real}</main>", model) is None


@pytest.mark.parametrize(
    "text",
    ["Hello , your parcel is here.", "Reply to .", "Filed under  by noon, thanks to  today.", "Flights from to", "Valid from until further notice", "Tickets from starts today", "Ring us at or visit the shop.", "Published in by Ann", "Written by on", "Total: excl shipping", "The sale closes in hours",
     "The voucher expires after days.", "Your cart contains items", "The list holds results", "undefined, welcome back"],
)
def test_empty_fills_of_other_wordings(text):
    assert residue.EMPTY_FILL.search(text) and any(h in text.lower() for h in residue.GAP_HINTS)


def test_hints_cover_the_messages():
    """Whatever sentence of the pages at hand is a message holds a hint, and so does every literal start of the grammar."""
    for text in ("Error 404: not found", "This page is gone", "No results for x", "Warning: foo() expects", "Errno 13", "JavaScript is disabled", "Your browser is too old", "Zugriff verweigert", "Sidan finns inte", "Something broke", "You are human, right?", "The upstream did not answer", "database error", "Bad gateway"):
        assert residue.MESSAGE.search(text) is None or any(h in text.lower() for h in residue.MESSAGE_HINTS), text


@pytest.mark.parametrize(
    "text",
    ["He came from the lake, by boat.", "Open at or after noon.", "She walked in by the back door in May.", "The ferry leaves in two hours.", "It stayed for days.", "Your cart contains three items.", "Price: 12 incl. VAT", "What is it for? Ann knows.", "NaN is a value", "Il part : enfin !", "from time to time"],
)
def test_full_sentences_have_no_gap(text):
    assert not residue.EMPTY_FILL.search(text)


def test_long_placeholders_and_long_messages(model):
    real = f"<p>{PROSE}</p>" * 4
    assert kind(f"<main><h1>Boats</h1>{real}<p>Dear {{{{ {'user.name | ' * 40} }}}}, thank you.</p></main>", model) == residue.PLACE
    sorry = "Something went wrong on our side and the page you asked for could not be shown to you today. " * 6
    assert kind(f"<main><h1>Oops</h1><p>{sorry}</p></main>", model) == residue.ERROR


def test_stubs_under_error_statuses(spark):
    """A stub of unknown wording is residue only if every known status of its documents is an error."""
    stub = page("<main><h1>Ejbvi</h1><p>Seda lehte ei ole siin enam leida.</p></main>")
    pages = {"s": stub, "t": stub.replace("siin", "seal"), "u": stub.replace("siin", "kuskil")}
    bodies, docs = flagged(spark, pages, [(1, "s", None, 404), (2, "s", None, None), (3, "t", None, 404), (4, "t", None, 200), (5, "u", None, None)])
    assert sorted(r[0] for r in residue.residue_documents(docs, bodies).collect()) == [1, 2]


def test_residue_documents(spark, model):
    real = f"<main><h1>Boats</h1><p>{PROSE}</p><p>{PROSE}</p></main>"
    pages = {"ok": page(real), "bad": page("<div><p>Access denied. You do not have permission.</p></div>")}
    bodies, docs = flagged(spark, pages, [(1, "ok", "Boats"), (2, "bad", "x"), (3, "bad", None), (3, "bad", None), (4, "ok", "%%TITLE%%"), (5, "gone", "%%TITLE%%"), (6, None, "null"), (None, "bad", None), (7, "ok", "null")])
    assert sorted(r["document_id"] for r in residue.residue_documents(docs, bodies, model).collect()) == [2, 3, 4, 7]

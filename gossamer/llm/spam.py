"""Keyword-stuffed pages, link lists and tag walls, by the shapes of their lines.

The own content of a page falls into lines (sentences of a text node, or the node itself). A line is reduced to a shape: bucket of
its word count, capitals, separators, link, repeated words. Running sentences have one family of shapes; a page is stuffed if a few
others hold two thirds of its words. Lines are grouped by shape in the page's own Arrow row, so no shuffle moves text; the decision is
a native expression. Pages are grouped across the crawl by the shapes that make them up.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gossamer.functions.html import page_text, title_of
from gossamer.llm.boilerplate import fitted_model, html_bodies, label_page
from gossamer.llm.content_model import ContentModel
from gossamer.llm.frames import frame
from gossamer.llm.page import Page
from gossamer.llm.residue import STUB, residue_kind
from gossamer.session import spread

_SENTENCE = re.compile(r"(?<=[.!?…])\s+")
_SEPARATOR = re.compile(r"[*|•·/~+=»>#;,]|(?<=\s)[-–—](?=\s)")
#: A page is stuffed if its ``FEW_SHAPES`` largest shapes that are no sentence's hold over ``STUFFED_SHARE`` of its words.
FEW_SHAPES, STUFFED_SHARE = 5, 2 / 3
SHAPES = "content_hash string, shapes array<struct<shape string, sentence boolean, n_lines int, n_words int>>"


def line_shape(line: str, linked: bool) -> tuple[str, bool, int]:
    """(shape, whether it is a running sentence's, words) of one line.

    A running sentence has at least 4 words, ends in a full stop, question or exclamation mark, starts with no small letter, has a
    separator on at most every fourth word, isn't a link as a whole, and its words seldom repeat.
    """
    words = line.split()
    n = len(words)
    separators = len(_SEPARATOR.findall(line))
    distinct = len({w.lower() for w in words})
    ends = line[-1:] in ".!?…" or line[-2:-1] in ".!?…"
    starts = not line[:1].islower()
    repeats = n >= 12 and distinct * 2 < n
    sentence = n >= 4 and ends and starts and separators * 4 <= n and not repeats and not linked
    size = "1" if n == 1 else "3" if n <= 3 else "7" if n <= 7 else "15" if n <= 15 else "40" if n <= 40 else "+"
    capitals = sum(1 for w in words if w[:1].isupper())
    case = "0" if not capitals else "a" if capitals == n else "s"
    gap = "0" if not separators else "m" if separators * 4 > n else "f"
    return f"{'S' if sentence else 'L'}{size}{case}{gap}{'@' if linked else ''}{'r' if repeats else ''}", sentence, n


def page_shapes(page: Page) -> dict[tuple[str, bool], list[int]]:
    """(shape, sentence) → [lines, words] of a page's own content."""
    out: dict[tuple[str, bool], list[int]] = {}
    tag, parent, elem = page.tag, page.parent, page.elem
    link = [False] * len(tag)
    for e in range(1, len(tag)):
        link[e] = tag[e] == "a" or link[parent[e]]
    for i, mine in enumerate(page.label):
        if mine:
            linked = link[elem[i]]
            for line in _SENTENCE.split(page.text[i]):
                shape, sentence, n = line_shape(line, linked)
                entry = out.setdefault((shape, sentence), [0, 0])
                entry[0] += 1
                entry[1] += n
    return out


def body_shapes(bodies: DataFrame, model: ContentModel | None = None) -> DataFrame:
    """(content_hash, shapes) of every HTML body that isn't residue; shapes: array of (shape, sentence, n_lines, n_words).

    Null hashes and bodies, and bodies that aren't HTML, give no row; a body without own content gives an empty array; a body
    stored twice may come twice. Without a ``model`` one is fitted on a sample of the bodies.
    """
    model = model or fitted_model(bodies)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            hashes, shapes = [], []
            for h, body, ct in zip(batch.content_hash, batch.body, batch.content_type):
                text = page_text(body, ct)
                page = label_page(text, model)
                found = page_shapes(page)
                words = sum(n for _, n in found.values())
                rest = sum(n for (_, s), (_, n) in found.items() if not s)
                # Residue is looked for only where it can change the outcome.
                if rest > STUFFED_SHARE * words and residue_kind(page, title_of(text)) not in (None, STUB):
                    continue
                hashes.append(h)
                shapes.append([(s, b, k, n) for (s, b), (k, n) in found.items()])
            yield frame(content_hash=hashes, shapes=shapes)

    return spread(html_bodies(bodies)).mapInPandas(run, SHAPES)


def dominant_shapes(shapes: Column) -> Column:
    """The largest ``FEW_SHAPES`` shapes that are no sentence's, the one with most words first."""
    others = F.filter(shapes, lambda x: ~x["sentence"])
    ranked = F.array_sort(F.transform(others, lambda x: F.struct((-x["n_words"]).alias("less"), x["shape"].alias("shape"), x["n_lines"].alias("n_lines"))))
    return F.slice(ranked, 1, FEW_SHAPES)


def is_stuffed(shapes: Column) -> Column:
    """Whether few shapes that are no sentence's hold over two thirds of the words."""
    total = F.aggregate(shapes, F.lit(0), lambda acc, x: acc + x["n_words"])
    held = F.aggregate(dominant_shapes(shapes), F.lit(0), lambda acc, x: acc - x["less"])
    return held > F.lit(STUFFED_SHARE) * total


def shape_groups(document: DataFrame, bodies: DataFrame, model: ContentModel | None = None) -> DataFrame:
    """(shapes, n_bodies, n_documents, mean_out_degree, mean_link_lines) of the stuffed bodies, grouped by the names of their dominant shapes.

    Documents of a body are counted first, each id once; mean_out_degree is over the documents that know theirs, null if none does.
    ``mean_link_lines`` counts lines that are links as a whole, per body.
    """
    top = dominant_shapes(F.col("shapes"))
    linked = F.aggregate(F.filter("shapes", lambda x: x["shape"].contains("@")), F.lit(0), lambda acc, x: acc + x["n_lines"])
    stuffed = body_shapes(bodies, model).where(is_stuffed(F.col("shapes"))).dropDuplicates(["content_hash"])
    named = stuffed.select("content_hash", F.array_join(F.transform(top, lambda x: x["shape"]), " ").alias("shapes"), linked.alias("link_lines"))
    docs = document.where("id IS NOT NULL AND content_hash IS NOT NULL").groupBy("content_hash", "id").agg(F.max("out_degree").alias("out_degree"))
    per_body = docs.groupBy("content_hash").agg(F.count("*").alias("n_documents"), F.sum("out_degree").alias("degrees"), F.count("out_degree").alias("known"))
    return named.join(per_body, "content_hash", "left").groupBy("shapes").agg(
        F.count("*").alias("n_bodies"), F.coalesce(F.sum("n_documents"), F.lit(0)).alias("n_documents"), F.try_divide(F.sum("degrees"), F.sum("known")).alias("mean_out_degree"), F.avg("link_lines").alias("mean_link_lines")
    )


def stuffed_documents(document: DataFrame, bodies: DataFrame, model: ContentModel | None = None) -> DataFrame:
    """(document_id) of every document whose stored body is stuffed; all URLs sharing the body count, each id once.

    Null ids and hashes give no row. One hash may hold a third of the documents: the flagged side has each hash about once, and
    AQE splits a skewed partition of the semi join.
    """
    flagged = body_shapes(bodies, model).where(is_stuffed(F.col("shapes"))).select("content_hash")
    docs = document.select("id", "content_hash").where(F.col("id").isNotNull() & F.col("content_hash").isNotNull())
    return docs.join(flagged, "content_hash", "left_semi").select(F.col("id").alias("document_id")).distinct()

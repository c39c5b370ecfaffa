"""Main content of a page by minimum-cut labelling of its text nodes.

The classifier of ``content_model`` gives each text node a cost for either label (terminal capacities). Edges carry the smoothness,
by DOM proximity: between pieces of one block, neighbours in one branch, a heading and what it stands over, neighbours apart; and the
nodes of a branch share an auxiliary vertex. The minimum cut separates content from boilerplate. A page is a graph of its own, so
labelling is one narrow Arrow pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gossamer.functions.html import is_html, page_text
from gossamer.llm.content_model import SAMPLE_PAGES, ContentModel, Layout, fit
from gossamer.llm.frames import frame
from gossamer.llm.maxflow import min_cut
from gossamer.llm.page import HEADS, Page
from gossamer.session import spread

#: Capacities of the smoothness edges, on the scale of the costs (log-odds of at most ``content_model.MOST_COST``).
SAME_BLOCK, HEADING, BRANCH, SAME_BRANCH, SAME_BOX, APART = 2.0, 1.0, 1.0, 0.6, 0.2, 0.15


def smoothness(at: Layout) -> tuple[list[tuple[int, int, float]], int]:
    """(edges, auxiliary vertices) of a page; the auxiliary vertices are numbered after its nodes."""
    elem, tag, block, branch = at.page.elem, at.page.tag, at.block, at.branch
    n = len(elem)
    edges: list[tuple[int, int, float]] = []
    extra = 0
    for b, members in at.groups.items():
        if b not in (-1, at.main) and len(members) > 1:
            edges += [(i, n + extra, BRANCH) for i in members]
            extra += 1
    for i in range(n - 1):
        a, b = elem[i], elem[i + 1]
        if block[a] == block[b]:
            w = SAME_BLOCK
        elif branch[a] == branch[b]:
            w = SAME_BRANCH if branch[a] != -1 or at.box[a] == at.box[b] else SAME_BOX
        else:
            # A subheading stands over what follows; a headline stands over the page.
            w = HEADING if tag[block[a]] in HEADS and tag[block[a]] != "h1" else APART
        edges.append((i, i + 1, w))
    return edges, extra


def cut_labels(at: Layout, costs: list[float]) -> list[bool]:
    """The labels of the minimum cut: True where a node belongs to the page's own content."""
    edges, extra = smoothness(at)
    return min_cut(costs + [0.0] * extra, edges)[: len(costs)]


def label_page(html: str, model: ContentModel) -> Page:
    """The page with a label for each text node."""
    page = Page(html)
    if page.text:
        page.label = cut_labels(*model.layout(page))
    return page


def html_bodies(bodies: DataFrame) -> DataFrame:
    """(content_hash, body, content_type) of the HTML bodies that have a hash and bytes."""
    kept = bodies.where(is_html(bodies["content_type"]) & bodies["content_hash"].isNotNull() & bodies["body"].isNotNull())
    return kept.select("content_hash", "body", "content_type")


_fitted: dict[int, ContentModel] = {}


def fitted_model(bodies: DataFrame, sample_pages: int = SAMPLE_PAGES) -> ContentModel:
    """The classifier fitted on about ``sample_pages`` HTML bodies, chosen by the hash of their names; fitted once a sample and process.

    The sample is what the driver gets: at most twice ``sample_pages`` rows, however large the table. Everything after covers all bodies.
    """
    html = html_bodies(bodies)
    # Counted without a look at the bodies.
    rows = bodies.where(is_html(bodies["content_type"]) & bodies["content_hash"].isNotNull()).agg(F.count("*")).first()[0]
    place = F.pmod(F.xxhash64("content_hash"), F.lit(1 << 32))
    sample = html.where(place < int(min(1.0, sample_pages / max(rows, 1)) * (1 << 32))).dropDuplicates(["content_hash"]).orderBy("content_hash").limit(2 * sample_pages).collect()
    texts = [page_text(r["body"], r["content_type"]) for r in sample]
    key = hash(tuple(texts))
    if key not in _fitted:
        _fitted.clear()
        _fitted[key] = fit(map(Page, texts), cut_labels)
    return _fitted[key]


def own_nodes(bodies: DataFrame, model: ContentModel | None = None) -> DataFrame:
    """(content_hash, node_no) of the text nodes of every HTML body that belong to its own content.

    Input: content_hash string, body binary, content_type string; other columns play no part. Nodes are the non-blank text runs
    of the body outside script, style, noscript, template and comments, numbered from 1 in document order. Repeated rows give
    each node once. A null hash, a null or empty body, a body that isn't HTML and a page without text give no row; an empty
    table gives no row. Very long pages are read to their end. Bytes that don't decode become U+FFFD and change no numbering.
    Without a ``model`` one is fitted on a sample of the bodies.
    """
    model = model or fitted_model(bodies)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            hashes: list[str] = []
            numbers: list[list[int]] = []
            for h, body, ct in zip(batch.content_hash, batch.body, batch.content_type):
                own = [i + 1 for i, x in enumerate(label_page(page_text(body, ct), model).label) if x]
                if own:
                    hashes.append(h)
                    numbers.append(own)
            yield frame(content_hash=hashes, nodes=numbers)

    labelled = spread(html_bodies(bodies)).mapInPandas(run, "content_hash string, nodes array<int>")
    once = labelled.dropDuplicates(["content_hash"])
    return once.selectExpr("content_hash", "explode(nodes) AS node_no")

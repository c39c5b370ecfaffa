"""Tolerant HTML reading with one regular expression, as Arrow-batched functions.

``html.parser`` spends most of a page on attributes nobody reads. Here one compiled pattern splits a page into
alternating text runs and tags; hidden elements (script, style, noscript, template, comments) are single tokens.
"""

from __future__ import annotations

import re
import zlib
from html import unescape
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gossamer.functions.url import normalize_href

_ATTRS = r"""[^>"']*(?:"[^"]*"[^>"']*|'[^']*'[^>"']*)*"""
TOKEN = re.compile(
    r"(<!--.*?(?:-->|\Z)"
    + "".join(rf"|<{t}\b{_ATTRS}>.*?(?:</{t}\s*>|\Z)" for t in ("script", "style", "noscript", "template"))
    + rf"|</?[a-zA-Z]{_ATTRS}>|</?[a-zA-Z][^>]*>|<[!?][^>]*>)",
    re.S | re.I,
)
TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)")
_BODY = re.compile(r"<body\b[^>]*>", re.I)
_BODY_END = re.compile(r"</body\s*>", re.I)
_TITLE = re.compile(r"<title\b[^>]*>(.*?)(?:</title\s*>|\Z)", re.S | re.I)
_ATTR = re.compile(r"""([a-zA-Z_:][-\w:.]*)\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)""")
_CHARSET = re.compile(r"charset\s*=\s*[\"']?\s*([-\w.:]+)", re.I)


def is_html(content_type):
    """Column: the content type says text/html or application/xhtml+xml in any case; null counts as no."""
    low = F.lower(F.coalesce(content_type, F.lit("")))
    return low.contains("text/html") | low.contains("application/xhtml+xml")


def unpack(body: bytes | None) -> bytes:
    """The bytes of a stored body: gunzipped if it is gzip, as they are otherwise; b"" for null or a broken stream."""
    if not body:
        return b""
    body = bytes(body)
    if body[:2] != b"\x1f\x8b":
        return body
    try:
        return zlib.decompress(body, 31)
    except zlib.error:
        part = zlib.decompressobj(31)
        try:
            return part.decompress(body)
        except zlib.error:
            return b""


def decode(raw: bytes, content_type: str | None) -> str:
    """Text of a body in the charset its content type names; UTF-8 otherwise. Undecodable bytes become U+FFFD."""
    found = _CHARSET.search(content_type or "")
    try:
        return raw.decode(found[1] if found else "utf-8", "replace")
    except LookupError:
        return raw.decode("utf-8", "replace")


def page_text(body: bytes | None, content_type: str | None) -> str:
    return decode(unpack(body), content_type)


def body_part(page: str) -> str:
    """What lies inside body, or the whole page if it has none."""
    start = _BODY.search(page)
    if not start:
        return page
    end = _BODY_END.search(page, start.end())
    return page[start.end() : end.start() if end else len(page)]


def hidden(token: str) -> bool:
    """Whether a token of ``TOKEN`` is a comment, a declaration or a hidden element."""
    return token[1] in "!?" or (token[1] in "sSnNtT" and token.find(">") < len(token) - 1)


def visible_text(page: str) -> str:
    """Text runs of the body joined by one blank, stripped; hidden elements and (given a body) the title left out."""
    text = " ".join(TOKEN.split(body_part(page))[::2])
    return (unescape(text) if "&" in text else text).strip()


def title_of(page: str) -> str | None:
    """The first title's text, stripped; null if there is none."""
    found = _TITLE.search(page)
    return unescape(found[1]).strip() if found else None


def links_of(page: str, url: str) -> list[tuple[str, str | None]]:
    """Every a[href] of a page in document order as (normalized url, anchor text or null); the first of equal urls stays."""
    base, out, open_href, words, seen = url, [], None, [], set()

    def close() -> None:
        nonlocal open_href
        if open_href is not None:
            target = normalize_href(open_href, base)
            if target is not None and target not in seen:
                seen.add(target)
                out.append((target, unescape("".join(words)).strip() or None))
            open_href = None

    for i, token in enumerate(TOKEN.split(page)):
        if i % 2 == 0:
            if open_href is not None:
                words.append(token)
            continue
        tag = TAG.match(token)
        if not tag or hidden(token):
            continue
        name = tag[2].lower()
        if name == "a":
            close()
            if not tag[1]:
                href = {k.lower(): v for k, v in _ATTR.findall(token)}.get("href")
                if href is not None:
                    open_href, words = unescape(href.strip("\"'")), []
        elif name == "base" and not tag[1]:
            href = {k.lower(): v for k, v in _ATTR.findall(token)}.get("href")
            if href and base == url:
                try:
                    base = urljoin(url, unescape(href.strip("\"'")).strip())
                except ValueError:
                    pass
    close()
    return out


@F.pandas_udf(T.StringType())
def html_title(pages: pd.Series) -> pd.Series:
    """Title of each page; null pages give null."""
    return pages.map(lambda p: None if p is None else title_of(p))


@F.pandas_udf(T.StringType())
def html_text(pages: pd.Series) -> pd.Series:
    """Visible text of each page; null pages give null."""
    return pages.map(lambda p: None if p is None else visible_text(p))


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("url", T.StringType()), T.StructField("anchor", T.StringType())])))
def html_links(pages: pd.Series, urls: pd.Series) -> pd.Series:
    """Links of each page, resolved against its url; null pages or urls give an empty list."""
    return pd.Series([[] if p is None or u is None else links_of(p, u) for p, u in zip(pages, urls)])


# Exploding a deterministic function makes Catalyst infer a filter on its size, that is, run it twice.
html_links = html_links.asNondeterministic()


@F.pandas_udf(T.StringType())
def decoded_body(bodies: pd.Series, content_types: pd.Series) -> pd.Series:
    """Text of a stored body; "" for null or unreadable bodies."""
    return pd.Series([page_text(b, c) for b, c in zip(bodies, content_types)], dtype=object)


@F.pandas_udf(T.BinaryType())
def gunzip(bodies: pd.Series) -> pd.Series:
    """Unpacked bytes; null stays null."""
    return bodies.map(lambda b: None if b is None else unpack(b))


@F.pandas_udf(T.BinaryType())
def gzip(bodies: pd.Series) -> pd.Series:
    """Gzip bytes without a time stamp, so that equal bodies give equal bytes; null stays null."""

    def one(b):
        if b is None:
            return None
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        return packer.compress(bytes(b)) + packer.flush()

    return bodies.map(one)

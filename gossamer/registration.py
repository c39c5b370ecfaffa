"""The scalar functions under SQL names, and link extraction as a table function."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from gossamer.functions import hashing, html, text, url


@F.udtf(returnType="pos int, url string, anchor string")
class PageLinks:
    """page_links(html, url): the links of a page in document order."""

    def eval(self, page: str, address: str):
        for pos, (target, anchor) in enumerate(html.links_of(page, address) if page and address else []):
            yield pos, target, anchor


def register(spark: SparkSession) -> None:
    """Make the functions callable from SQL in this session."""
    for name, function in {
        "html_title": html.html_title,
        "html_text": html.html_text,
        "decoded_body": html.decoded_body,
        "gunzip": html.gunzip,
        "simhash": text.simhash,
        "murmur3_unsigned": hashing.murmur3,
        "normalize_href": url.normalize_hrefs,
    }.items():
        spark.udf.register(name, function)
    spark.udtf.register("page_links", PageLinks)

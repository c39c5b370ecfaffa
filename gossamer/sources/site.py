"""Sites to crawl without a network: a generated one, and a folder of HTML files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FANOUT = 6
BOILERPLATE_TEXT = "This site uses standard terms. Read the same notice on every page of it."


def synthetic_site(spark: SparkSession, pages: int, origin: str = "http://site.test") -> DataFrame:
    """(page, url, html) of a site whose page i links to (7 i + j) mod pages for j < 6; pages with i mod 10 = 1 share one text."""
    i = F.col("page")
    targets = F.transform(F.sequence(F.lit(0), F.lit(FANOUT - 1)), lambda j: F.pmod(i * 7 + j, F.lit(pages)))
    anchors = F.array_join(F.transform(targets, lambda t: F.concat(F.lit('<a href="/p'), t.cast("string"), F.lit('">p'), t.cast("string"), F.lit("</a>"))), " ")
    words = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(59)), lambda k: F.concat(F.lit("w"), F.pmod(i * 31 + k * 17, F.lit(9973)).cast("string"))), " ")
    body = F.when(i % 10 == 1, F.concat(F.lit("<p>"), F.lit(BOILERPLATE_TEXT), F.lit("</p>"))).otherwise(F.concat(F.lit("<p>"), words, F.lit("</p>"), anchors))
    html = F.concat(F.lit("<html><head><title>Page "), i.cast("string"), F.lit("</title></head><body>"), body, F.lit("</body></html>"))
    return spark.range(pages).select(F.col("id").alias("page")).select("page", F.concat(F.lit(f"{origin}/p"), i.cast("string")).alias("url"), html.alias("html"))


def site_edges(spark: SparkSession, pages: int) -> DataFrame:
    """(src, dst) page numbers of the same site's links, boilerplate pages without any."""
    i = F.col("src")
    return spark.range(pages).select(F.col("id").alias("src")).where(i % 10 != 1).select("src", F.explode(F.transform(F.sequence(F.lit(0), F.lit(FANOUT - 1)), lambda j: F.pmod(i * 7 + j, F.lit(pages)))).alias("dst"))


def static_site(spark: SparkSession, folder: str, origin: str = "http://static.test") -> DataFrame:
    """(url, html) of every .html file of a folder; index.html is the root."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.html").load(folder)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return files.select(F.when(name == "index.html", F.lit(f"{origin}/")).otherwise(F.concat(F.lit(f"{origin}/"), name)).alias("url"), F.decode("content", "UTF-8").alias("html"))

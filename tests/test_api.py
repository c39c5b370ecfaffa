import pytest

from gossamer.__main__ import main
from gossamer.api import CrawlAnalytics
from gossamer.registration import register


def test_facade(spark, data):
    api = CrawlAnalytics(spark, data)
    stats = api.stats().first()
    assert stats["documents"] == api.table("document").count() and stats["edges"] == api.table("link_edge").count()
    assert api.documents(10, 0).count() == 10
    first, second = ({r["id"] for r in api.documents(10, at).collect()} for at in (0, 20))
    assert not first & second
    assert api.document_total(q="the").first()["total"] == api.table("document").where("url ILIKE '%the%' OR title ILIKE '%the%'").count()
    top = [r["in_degree"] for r in api.graph(20).collect()]
    assert top == sorted(top, reverse=True)
    assert api.domains(5).count() == 5 and api.crawls(5).count() == 5
    some = api.table("link_edge").first()["src_document_id"]
    assert api.links(some).count() > 0 and api.document(some).count() > 0 and api.document(-1).count() == 0
    with pytest.raises(ValueError):
        api.documents(limit=500)
    start = api.table("document").where("depth = 0").first()["url"]
    reached = api.crawl([start], 1)
    assert reached.where("depth = 0").count() == 1
    assert api.recrawl("2025-06-01 00:00:00", 0, 7).count() == 7
    assert api.create_crawl("n", ["https://a.example"], 1, 1, "2025-01-01 00:00:00").count() == api.table("crawl").count() + 1
    assert api.stop_crawl(1, "2025-01-01 00:00:00").count() == api.table("crawl").count()


def test_sql_names(spark):
    register(spark)
    row = spark.sql("SELECT html_title('<title>T</title>') AS t, murmur3_unsigned('abc') AS m, normalize_href('/x', 'http://h/') AS n").first()
    assert tuple(row) == ("T", 0xB3DD93FA, "http://h/x")
    rows = spark.sql("SELECT * FROM page_links('<a href=\"/a\">A</a><a href=\"/b\"></a>', 'http://h/')").collect()
    assert [tuple(r) for r in rows] == [(0, "http://h/a", "A"), (1, "http://h/b", None)]


def test_command_line(spark, data, capsys):
    assert main(["version"]) == 0
    assert main(["--data", data, "stats"]) == 0
    assert "documents" in capsys.readouterr().out
    assert main(["--data", data, "query", "a5_status_histogram"]) == 0

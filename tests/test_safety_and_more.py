import json

import pytest
from pyspark.sql import functions as F

from weft.functions import dom as D
from weft.functions import safety
from weft.functions import text as T
from weft.sources import web


@pytest.mark.parametrize("url,reason", [("https://a.example/", None), ("ftp://a.example/", "scheme"), ("https://u:p@a.example/", "credentials"), ("http://127.0.0.1/", "private"), ("http://0x7f.1/", "private"), ("http://2130706433/", "private"), ("http://017700000001/", "private"), ("http://[::ffff:10.0.0.1]/", "private"), ("http://169.254.169.254/x", "metadata"), ("http://10.0.0.1.nip.io/", "rebinding"), ("http://a.example:99999/", "malformed"), ("http://a\n.example/", "malformed"), (None, "malformed"), ("http://8.8.8.8/", None)])
def test_unsafe(url, reason):
    assert safety.unsafe_reason(url) == reason


def test_redaction():
    value = {"apiKey": "x", "nested": [{"Authorization": "y", "note": "see https://u:p@h.example/p?token=1&q=2"}], "auth": "Bearer abc"}
    assert safety.redacted(value) == {"apiKey": "[REDACTED]", "nested": [{"Authorization": "[REDACTED]", "note": "see https://h.example/p?token=%5BREDACTED%5D&q=2"}], "auth": "[REDACTED]"}
    assert value["apiKey"] == "x" and len(safety.bounded_json({"a": "b" * 10000}, 1000)) <= 1000
    assert json.loads(safety.bounded_json({"a": 1})) == {"a": 1}


def test_citations():
    text, refs = T.cite('a [x](/p "T") b ![i](https://b.example/i.png) [y](/p)', "https://a.example/")
    assert text == "a x⟨1⟩ b ![i⟨2⟩] y⟨1⟩" and refs == "\n\n## References\n\n⟨1⟩ https://a.example/p: T - x\n⟨2⟩ https://b.example/i.png: i\n"
    assert T.cite("none") == ("none", "")


def test_page_types_and_finders():
    assert D.page_type('<meta http-equiv="refresh" content="0; url=/x">', "https://a.example/") == "redirect"
    assert D.page_type("<p>Subscribe to read</p>", "https://a.example/") == "paywall"
    assert D.page_type('<div data-paywall="off">x</div><article>y</article>', "https://a.example/") == "article"
    assert D.page_type('<div class="question">', "https://a.example/") == "qa" and D.page_type("", "u") == "unknown"
    assert D.page_type("".join(f'<a href="/{i}">x</a>' for i in range(25)), "https://a.example/", "", 300) == "list"
    root = D.parse('<ul><li class=a id=k>one</li><li class=a>two</li></ul><p><li>x</li></p><img src="/i.png"><img src="/i.png">')
    first = D.select(root, "li")[0]
    assert [n.text() for n in D.similar(root, first, 0.5)] == ["two"]
    assert D.relocate(root, "li", "two", {"class": "a"}).text() == "two" and D.relocate(root, "b", "nothing like it", {}) is None
    assert D.images(root, "https://a.example/") == ["https://a.example/i.png"]
    assert D.primary_source({"canonical": "https://b.example/"}, [], "https://a.example/") == "https://b.example/"
    assert D.metrics(root)["depth"] == 2


def test_contents_retry_and_ratio(spark):
    df = spark.createDataFrame([([(1, 1), (2, 3), (2, 5), (1, 9)], 12)], "toc array<struct<level:int,page:int>>, pages int")
    assert df.select(T.toc_ends(F.col("toc"), F.col("pages")).alias("e")).first()["e"] == [8, 4, 8, 12]
    r = spark.createDataFrame([("120",), ("-3",), ("Wed, 03 Jan 2024 00:01:00 GMT",), ("soon",)], "v string").select(T.retry_after("v", F.to_timestamp(F.lit("2024-01-03 00:00:00"))).alias("s"), T.ratio(F.lit("abcd"), F.lit("bcde")).alias("q")).collect()
    assert [x["s"] for x in r][:3] == [120.0, 0.0, 60.0] and r[0]["q"] == 0.75


def test_sitemap_levels_and_discovery(spark):
    docs = spark.createDataFrame([("https://a.example/s.xml", "<sitemapindex><sitemap><loc>https://a.example/t.xml</loc></sitemap></sitemapindex>"), ("https://a.example/t.xml", "<urlset><url><loc>https://a.example/x</loc><lastmod>2024</lastmod></url></urlset>")], "url string, body string")
    got = web.discovered_sitemaps(docs, spark.createDataFrame([("https://a.example/s.xml",)], "url string"))
    assert [tuple(r) for r in got.collect()] == [("https://a.example/x", "2024")]
    more = spark.createDataFrame([("https://www.a.example/x?utm_source=1",), ("https://sub.a.example/y",), ("https://b.example/",)], "url string")
    assert {r["url"] for r in web.discovered("a.example", got, more).collect()} == {"https://a.example/x", "https://www.a.example/x", "https://sub.a.example/y"}


def test_files_are_written_whole(tmp_path):
    from weft.sources.files import write_whole

    path = tmp_path / "a.json"
    write_whole(str(path), "one")
    write_whole(str(path), b"two")
    assert path.read_text() == "two" and oct(path.stat().st_mode & 0o777) == "0o600" and [p.name for p in tmp_path.iterdir()] == ["a.json"]


def test_capabilities_come_from_the_queries():
    from weft.queries import CORE

    told = {c["name"]: c for c in CORE.capabilities()}
    assert set(told) == set(CORE.queries) and told["web_sitemaps"]["stated"] and told["search_quorum"]["area"] == "search"


def test_progress_is_told_and_may_fail():
    from types import SimpleNamespace as Of

    from weft.streaming.state import Progress

    seen = []
    event = Of(progress=Of(name="q", batchId=3, numInputRows=7, processedRowsPerSecond=1.5))
    Progress(lambda *a: seen.append(a)).onQueryProgress(event)
    Progress(lambda *a: 1 / 0).onQueryProgress(event)
    assert seen == [("q", 3, 7, 1.5)]

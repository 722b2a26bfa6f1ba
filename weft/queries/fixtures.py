"""Queries over small fixed inputs: broken documents, odd markup, ladders of rules. Their SQL states the rows that must come out."""

from __future__ import annotations

import gzip
import json

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.functions import capture as A
from weft.functions import classes as C
from weft.functions import dom as D
from weft.functions import pages as P
from weft.functions import response as R
from weft.functions import safety as S
from weft.functions import text as T
from weft.functions import urls as U
from weft.operators import crawl as W
from weft.operators import search as Q
from weft.operators import state as ST
from weft.plans import pipeline
from weft.plans.staging import ensure_package
from weft.queries.base import CORE
from weft.queries.expected import ROWS
from weft.sources import records as K
from weft.sources import web

_SQL_TYPES = {"string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN", "date": "DATE", "timestamp": "TIMESTAMP"}
_ARROW = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}


def _columns(schema: str) -> list[tuple[str, str]]:
    return [tuple(x.strip().rsplit(" ", 1)) for x in schema.split(",")]


def _literal(v) -> str:
    if v is None:
        return "NULL"
    return str(v).upper() if isinstance(v, bool) else repr(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"


def values(schema: str, rows: list[tuple]) -> str:
    """SQL of literal rows."""
    cols = _columns(schema)
    casts = ", ".join(f"CAST(c{i} AS {_SQL_TYPES[t]}) AS {n}" for i, (n, t) in enumerate(cols))
    names = ", ".join(f"c{i}" for i in range(len(cols)))
    if not rows:
        return f"SELECT {casts} FROM (SELECT {', '.join('NULL AS c' + str(i) for i in range(len(cols)))}) WHERE false"
    return f"SELECT {casts} FROM (VALUES " + ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows) + f") AS t({names})"


def fixture(name: str, schema: str, given: list[tuple] = (), given_schema: str = ""):
    """Register a query over given rows; ``made`` gets them as a DataFrame."""

    def keep(made):
        def query(spark, sf_dir) -> DataFrame:
            df = spark.createDataFrame(list(given), given_schema) if given_schema else None
            return made(spark, df).select(*[n for n, _ in _columns(schema)])

        CORE.add(name, values(schema, ROWS[name]) if name in ROWS else None)(query)
        return made

    return keep


def each(df: DataFrame, schema: str, fn) -> DataFrame:
    """Rows that a function gives for each row."""
    ensure_package(df.sparkSession)
    cols = _columns(schema)

    def run(batches):
        for b in batches:
            rows = [r for given in zip(*(c.to_pylist() for c in b.columns)) for r in fn(*given)]
            made = list(zip(*rows)) if rows else [[] for _ in cols]
            yield pa.RecordBatch.from_arrays([pa.array(list(v), _ARROW[t]) for v, (_, t) in zip(made, cols)], names=[n for n, _ in cols])

    return df.mapInArrow(run, schema)


def rows_fixture(name: str, schema: str, given: list[tuple], given_schema: str, fn) -> None:
    """A fixture whose rows a plain function gives."""
    fixture(name, schema, given, given_schema)(lambda spark, df: each(df, schema, fn))


def _j(x) -> str:
    return json.dumps(x, ensure_ascii=False, sort_keys=True)


# --- documents that name pages

_URLSET = "<urlset xmlns='http://www.sitemaps.org/schemas/sitemap/0.9'><url><loc> https://a.example/1 </loc><lastmod>2024-01-02</lastmod></url><url><loc>https://a.example/2?x=1&amp;y=2</loc></url><url><lastmod>2024</lastmod></url></urlset>"
_SITEMAPS = [
    (1, _URLSET.encode()),
    (2, b"<sitemapindex><sitemap><loc>https://a.example/s1.xml</loc><lastmod>2024-02-03T00:00:00Z</lastmod></sitemap></sitemapindex>"),
    (3, gzip.compress(_URLSET.encode(), mtime=0)),
    (4, b"<urlset><url><loc>https://a.example/cut</loc></url><url><loc>https://a.exam"),
    (5, b"<!DOCTYPE x [<!ENTITY e SYSTEM 'file:///etc/passwd'>]><urlset><url><loc>&e;</loc></url></urlset>"),
    (6, b"no xml at all \x00\xff"),
    (7, None),
]
rows_fixture("web_sitemaps", "id int, url string, lastmod string, kind string, recovered boolean", _SITEMAPS, "id int, data binary", lambda i, data: [(i, *r) for r in web.sitemap(data)])

_SITE = [
    ("https://a.example/sitemap.xml", "<sitemapindex><sitemap><loc>https://a.example/s1.xml</loc></sitemap><sitemap><loc>https://a.example/sitemap.xml</loc></sitemap><sitemap><loc>https://a.example/gone.xml</loc></sitemap></sitemapindex>"),
    ("https://a.example/s1.xml", _URLSET),
    ("https://b.example/sitemap.xml", "<urlset><url><loc>https://b.example/x</loc></url></urlset>"),
    ("https://a.example/empty.xml", None),
]


@fixture("web_sitemap_walk", "url string, lastmod string", _SITE, "url string, body string")
def _(spark, df):
    return web.discovered_sitemaps(df, spark.createDataFrame([("https://a.example/sitemap.xml",), ("https://a.example/empty.xml",)], "url string"))


_ROBOTS = "User-agent: *\nDisallow: /private\nAllow: /private/open\nDisallow: /*.pdf$\n\nUser-agent: goodbot\nUser-agent: otherbot\nDisallow:\nSitemap: /map.xml\nSitemap: https://a.example/two.xml # second\nSITEMAP: /map.xml"
_ASKED = [(1, 200, "/private/x", "*"), (2, 200, "/private/open/x", "*"), (3, 200, "/doc.pdf", "*"), (4, 200, "/doc.pdf?x", "*"), (5, 200, "/private", "GoodBot/2.0"), (6, 404, "/private", "*"), (7, 503, "/", "*"), (8, None, "/", "*"), (9, 403, "/", "*")]
rows_fixture("web_robots", "id int, policy string", _ASKED, "id int, status int, path string, agent string", lambda i, status, path, agent: [(i, web.robots_policy(status, _ROBOTS, "https://a.example" + path, agent))])
_HOME = '<html><head><link rel="alternate" type="application/rss+xml" href="/feed"><link rel="sitemap" href="map.xml"><link rel="stylesheet" href="x.css"></head><a href="/feed2" type="application/rss+xml">no head link</a></html>'
rows_fixture("web_named_routes", "source string, url string", [(_ROBOTS, _HOME)], "robots string, home string", lambda r, h: [*(("robots", u) for u in web.robots_sitemaps(r, "https://a.example/robots.txt")), *(("page", u) for u in web.page_feeds(h, "https://a.example/"))])

_FEEDS = [
    (1, "<feed xmlns='http://www.w3.org/2005/Atom'><entry><id>t3_abc</id><title>First &amp; best</title><link href='/r/x/1'/><author><name>ann</name></author><published>2024-01-01T00:00:00Z</published></entry><entry><id>t1_def</id><title/><link href='https://b.example/c'/><updated>2024-01-03T00:00:00Z</updated></entry></feed>"),
    (2, "<rss><channel><title>Channel</title><item><title>Item</title><link>https://c.example/i</link><guid>g1</guid><pubDate>Mon, 01 Jan 2024 00:00:00 GMT</pubDate><creator>bob</creator></item><item><title>No link</title></item></channel></rss>"),
    (3, "<rss><channel><item><title>cut"),
    (4, None),
]
rows_fixture("web_feeds", "id int, entry string, title string, link string, author string, published string", _FEEDS, "id int, xml string", lambda i, x: [(i, *r) for r in web.feed(x, "https://a.example/")])

_TARGETS = [("python",), ("/r/python/",), ("https://old.reddit.com/r/python/?sort=new",), ("https://www.reddit.com/r/python/comments/ab12/title/",), ("https://www.reddit.com/r/python/search?q=x&y=",), ("https://www.reddit.com/user/ann.rss",), ("r/spark ",)]


@fixture("web_feed_urls", "target string, feed string, kind string", _TARGETS, "target string")
def _(spark, df):
    f = df.select("target", K.feed_url("target").alias("feed"))
    return f.withColumn("kind", K.feed_kind("feed"))


@fixture("web_entry_kinds", "id string, kind string", [("t1_a", "https://x/r/s.rss"), ("t3_a", "https://x/r/s/comments/q.rss"), ("a", "https://x/r/s/comments/q.rss"), ("a", "https://x/r/s.rss"), (None, "https://x/comments/q")], "id string, feed string")
def _(spark, df):
    return df.select("id", K.entry_kind("id", "feed").alias("kind"))


_THINGS = "<div class='thing link' data-author='ann' data-score='12'><a class='title' href='/r/x/comments/1/a/'>One &lt;b&gt;</a><a class='comments'>3 comments</a></div><div class='thing promoted'><a class='title' href='/ad'>Ad</a></div><div class='thing'><a class='title' href='https://b.example/'>Two</a><div class='score' title='7'>7 points</div><a class='author'>bob</a></div><div class='thing'><p>no title</p></div>"
rows_fixture("web_listing", "ord int, title string, link string, author string, score string, comments string", [(_THINGS,), (None,)], "html string", lambda h: list(web.listing(h, "https://old.reddit.com/r/x/")))
rows_fixture("web_listing_markdown", "md string", [(_THINGS,)], "html string", lambda h: [(web.listing_markdown(h, "https://old.reddit.com/r/x/"),)])


@fixture("web_listing_urls", "url string, moved string", [("https://www.reddit.com/r/x/?a=1#b",), ("https://reddit.com",), ("https://old.reddit.com/r/x",), ("https://np.reddit.com/r/x/comments/1/t",), ("https://notreddit.com/r/x",), ("http://m.reddit.com:80/user/y",), ("no url",)], "url string")
def _(spark, df):
    return df.select("url", K.listing_url("url").alias("moved"))


@fixture("web_records", "id string, title string, body string, author string, url string, published_at string, source string, source_type string")
def _(spark, df):
    feed = spark.createDataFrame([("t3_a", "T", "https://x/1", "ann", "2024", "summary", ""), ("t1_b", None, "https://x/2", None, None, "sum", "content")], "id string, title string, link string, author string, published string, summary string, content string")
    payloads = [_j({"id": "p1", "title": "Post", "selftext": "text", "author": "bob", "permalink": "/r/x/comments/p1", "created_utc": 1704067200}), _j({"name": "c1", "body": "comment", "author_fullname": "t2_x", "url": "https://y/2", "created": "5"}), "no json", _j({"id": "", "name": "n"})]
    return K.feed_records(feed).unionByName(K.archive_records(spark.createDataFrame([(p,) for p in payloads], "payload string")))


@fixture("web_media_entries", "id string, title string, view_count string, webpage_url string", [(_j({"id": " v1 ", "title": "T", "view_count": 7, "secret": "x"}),), (_j({"id": "v2", "webpage_url": "https://m.example/v2"}),), (_j({"title": "no id", "original_url": "https://m.example/o"}),), (_j({}),), ("no json",)], "payload string")
def _(spark, df):
    return K.media_entries(df)


@fixture("web_media_errors", "text string, category string", [("HTTP Error 429",), ("Too Many Requests",), ("Sign in to confirm you are no bot",), ("login required after timeout",), ("Connection reset by peer",), ("unsupported url",), (None,)], "text string")
def _(spark, df):
    return df.select("text", R.media_error("text").alias("category"))


@fixture("web_media_waits", "seconds double, asked int, wait int", [(None, None), (60.0, None), (60.5, None), (300.0, None), (900.0, None), (901.0, None), (5.0, 0), (5.0, 50), (5.0, 5000), (float("nan"), None)], "seconds double, asked int")
def _(spark, df):
    return df.select(F.when(~F.isnan("seconds"), F.col("seconds")).alias("seconds"), "asked", R.wait_for("seconds", "asked").alias("wait"))


_ACCOUNTS = [{"site": "A", "url": "https://a.example/u", "status": "Claimed"}, {"site_name": "B", "link": "https://b.example/u", "status_code": "weird", "score": "0.4"}, {"name": "C", "url": "http://c.example/u"}, {"url": "https://d.example"}, {"site": "E", "url": "https://e.example", "score": 7}, {"site": "F", "url": "https://f.example", "score": "x", "status": "claimed"}]


@fixture("web_accounts", "site string, url string, status string, confidence double", [(_j(a),) for a in _ACCOUNTS], "payload string")
def _(spark, df):
    return K.account_matches(df)


_TREE = _j([{"kind": "Listing", "data": {"children": [{"kind": "t1", "data": {"id": "a", "author": "ann", "body": "one", "replies": {"data": {"children": [{"kind": "t1", "data": {"id": "b", "author": "bob", "body": "two", "replies": ""}}]}}}}, {"kind": "t1", "data": {"id": "c", "author": "cy", "body": "three"}}]}}])
rows_fixture("web_comments", "ord int, depth int, id string, author string, body string", [(_TREE,), ("broken {",), (None,)], "data string", lambda d: list(web.comment_tree(d)))
rows_fixture("web_relaxed_json", "id int, json string", [(1, '{"a": 1, // note\n "b": [1, 2,], /* more */ "c": "x // y, ]",}'), (2, "[1,]"), (3, '{"u": "https://a.example/*x*/"}')], "id int, text string", lambda i, t: [(i, _j(web.relaxed_json(t)))])


@fixture("web_url_list", "url string", [("https://a.example/1",), ("  https://a.example/2  ",), ("# comment",), ("",), ('["https://a.example/1", "https://a.example/3"]',)], "value string")
def _(spark, df):
    return web.url_list(df)


_RESPONSES = [(1, _j({"web": {"results": [{"title": "A", "meta": {"url": "https://a"}, "n": 1}, {"title": None, "meta": {}}]}})), (2, _j({"web": {}})), (3, "broken")]


@fixture("web_mapped_responses", "id int, place int, title string, url string", _RESPONSES, "id int, body string")
def _(spark, df):
    m = df.select("id", F.posexplode(web.map_response(F.col("body"), "web.results", {"title": "title", "url": "meta.url"})).alias("place", "m"))
    return m.select("id", "place", F.col("m")["title"].alias("title"), F.col("m")["url"].alias("url"))


@fixture("web_discovered", "url string, source int")
def _(spark, df):
    one = spark.createDataFrame([("https://www.a.example/p?utm_source=x",), ("https://b.example/p",), ("https://sub.a.example/docs/q#t",)], "url string")
    two = spark.createDataFrame([("https://www.a.example/p",), ("https://a.example/docs/r",), (None,)], "url string")
    return web.discovered("a.example", one, two)


_PAGES = {"1": {"data": {"items": [{"n": 1}, {"n": 2}]}, "next": "k2"}, "k2": {"data": {"items": [{"n": 3}]}, "next": ""}, "2": {"data": {"items": []}}}
_SPECS = [(1, _j({"items": "data.items", "next": "next", "mode": "cursor"})), (2, _j({"items": "data.items", "mode": "page", "max_pages": 5})), (3, _j({"items": "data.items", "next": "next", "mode": "cursor", "max_pages": 1}))]
rows_fixture("web_api_pages", "id int, ord int, page string, item string", _SPECS, "id int, spec string", lambda i, s: [(i, r["ord"], r["page"], _j(r["item"])) for r in K.paged(_PAGES, "1", json.loads(s))])
rows_fixture("web_templates", "id int, body string", [(1, _j({"q": "{query.text}", "n": "{n}", "s": "x {n}", "l": ["{missing}", 5]}))], "id int, template string", lambda i, t: [(i, _j(K.filled(json.loads(t), {"query": {"text": "spark"}, "n": 3})))])


@fixture("web_unwrapped", "url string, target string", [("https://www.google.com/url?q=https%3A%2F%2Fa.example%2Fx%3Fy&sa=U",), ("https://r.search.yahoo.com/x/RU=https%3A%2F%2Fb.example%2F/RK=2/RS=z",), ("https://www.bing.com/ck/a?u=a1aHR0cHM6Ly9jLmV4YW1wbGUv&x=1",), ("https://d.example/url?q=https%3A%2F%2Fe.example",), ("https://www.google.com/url?x=1",)], "url string")
def _(spark, df):
    return df.select("url", U.unwrap_result("url").alias("target"))


# --- page trees

_RICH = """<!doctype html><html lang="en"><head><title> Page &amp;  title </title>
<meta name="description" content="About"><meta content="2024-05-06" property="article:published_time"><meta property="og:site_name" content="Site"><meta name="twitter:image" content="/i.png">
<link rel="canonical" href="/canon"><link rel="alternate" type="application/rss+xml" href="/feed">
<script type="application/ld+json">{"@graph": [{"@type": "Article", "headline": "H", "author": {"name": "Ann"}}, {"@type": "Org"}]}</script>
<script type="application/ld+json">{"broken": </script><script type="application/ld+json">[{"@type": "Product", "name": "P", "author": [{"name": "Bo"}]}]</script>
<script id="__NEXT_DATA__" type="application/json">{"props": {"a": [1, 2]}}</script><script>window.state = {"x": "</p>", "y": [1]}; var cfg = [1, 2]; let bad = {x: 1};</script></head>
<body><nav><a href="/home">Home</a><a href="javascript:void(0)">JS</a></nav>
<div itemscope itemtype="https://schema.org/Product"><span itemprop="name">Chair</span><div itemprop="offers" itemscope itemtype="https://schema.org/Offer"><meta itemprop="price" content="9.50"><span itemprop="currency">EUR</span></div><a itemprop="url" href="/chair">x</a></div>
<article id="main"><h1>Heading <em>one</em></h1><p class="lead">First <b>bold</b> <a href="/ref?x=1#f">ref</a> and <a href="https://arxiv.org/abs/1">paper</a>.</p><p>Second<p>Third <span style="display: none">hidden</span><br>line</p>
<ul><li>one</li><li>two <code>x</code></li></ul><pre>  code
 here</pre><img src="/a.png"><img src="https://c.example/b.jpg"><img src="data:image/png;base64,AA"><img src="/a.png"></article>
<footer class="footer"><a href="/imprint">Imprint</a></footer></body></html>"""
_URL = "https://www.a.example/dir/page"
_ONE = [(_RICH,)]
rows_fixture("pages_meta_fields", "field string, value string", _ONE, "html string", lambda h: sorted(D.metadata(D.parse(h), _URL).items()))
rows_fixture("pages_json_ld", "ord int, entity string", _ONE, "html string", lambda h: list(enumerate(D.json_ld(D.parse(h)))))
rows_fixture("pages_microdata", "ord int, item string", _ONE, "html string", lambda h: list(enumerate(D.microdata(D.parse(h)))))
rows_fixture("pages_script_data", "label string, data string", _ONE, "html string", lambda h: D.script_data(D.parse(h)))
rows_fixture("pages_images", "ord int, url string", _ONE, "html string", lambda h: list(enumerate(D.images(D.parse(h), _URL))))
rows_fixture("pages_link_kinds", "ord int, url string, text string, kind string", _ONE, "html string", lambda h: [(i, *x) for i, x in enumerate(D.links(D.parse(h), _URL))])
_MANY = "<nav>" + "".join(f"<a href='/n{i}'>n{i}</a>" for i in range(25)) + "</nav>" + "".join(f"<a href='/c{i}'>c{i}</a>" for i in range(40)) + "<a href='https://github.com/x'>x</a>"
rows_fixture("pages_link_report", "kind string, n int, last string", [(_MANY,), (_RICH,)], "html string", lambda h: [(k, len(v) if k != "primary_source" else None, (v[-1]["url"] if v else None) if k != "primary_source" else v) for k, v in D.link_report(D.parse(h), _URL).items()])
rows_fixture("pages_link_list", "md string", _ONE, "html string", lambda h: [(D.link_list(D.links(D.parse(h), _URL)),)])
rows_fixture("pages_rich_markdown", "md string", _ONE, "html string", lambda h: [(D.markdown(D.sanitise(D.parse(h))),)])
rows_fixture("pages_sanitised", "html string", [("<div>a<script>x</script>b<p hidden>c</p>d<i aria-hidden='true'>e</i>f<b style='opacity: 0'>g</b></div>",)], "given string", lambda h: [("".join(D.to_html(c) for c in D.sanitise(D.parse(h)).elements()),)])
_DEEP = "<div>" * 400 + "<p>" + "deep text of a long paragraph. " * 8 + "</p>" + "</div>" * 400
rows_fixture("pages_pruned", "id int, text string", [(1, "<body><nav class='nav'><a href='/a'>A</a><a href='/b'>B</a></nav><article><p>" + "A long paragraph of real text. " * 10 + "</p></article><div class='cookie-banner'><a href='/c'>ok</a></div></body>"), (2, _DEEP)], "id int, html string", lambda i, h: [(i, D.prune(D.parse(h)).text()[:60])])
rows_fixture("pages_tree_metrics", "nodes int, text int, depth int", [("<div><p>ab</p><p>c<b>d</b></p></div>",), (_DEEP,), ("",)], "html string", lambda h: [tuple(D.metrics(D.parse(h)).values())])

_TABLES = [
    (1, "<table><caption>Cap</caption><thead><tr><th>A</th><th colspan=2>B</th></tr></thead><tbody><tr><td rowspan=2>1</td><td>2</td><td>3</td></tr><tr><td>4</td><td>5</td></tr></tbody></table>"),
    (2, "<table summary='s'><thead><tr><th>A</th><th>B</th></tr><tr><th>C</th><th>D</th></tr></thead><tbody><tr><td>1</td><td>2<table><tr><td>inner</td></tr></table></td></tr></tbody></table>"),
    (3, "<table role=presentation><tr><td>layout</td><td>x</td></tr></table>"),
    (4, "<table><thead><tr><th>A</th><th>B</th></tr></thead><tbody><tr><td colspan='x1'>1</td><td>2</td></tr></tbody></table>"),
    (5, "<table><caption>C</caption><thead><tr><th>A</th><th>B</th></tr></thead><tbody><tr><td colspan=99999999999>1</td></tr></tbody></table>"),
]
rows_fixture("pages_odd_tables", "id int, caption string, headers string, line int, cells string", _TABLES, "id int, html string", lambda i, h: [(i, t["caption"], "|".join(t["headers"][:4]), k, "|".join(r[:4]) + f"#{len(r)}") for t in D.tables(D.parse(h)) for k, r in enumerate(t["rows"])])

_CARDS = "<div class=card data-id=1><h2> One </h2><a href='/1'>go</a><span class=price>EUR 9.50</span><ul><li>a</li><li>b</li></ul></div><div class=card data-id=2><h2>Two</h2><div class=by><i>Ann</i></div></div>"
_SCHEMA = {"baseSelector": "div.card", "fields": [{"name": "id", "selector": "", "type": "attribute", "attribute": "data-id"}, {"name": "title", "selector": "h2", "transform": "uppercase"}, {"name": "price", "selector": ".price", "pattern": r"([\d.]+)", "default": "0"}, {"name": "link", "selector": "./a/@href"}, {"name": "tags", "selector": "li", "type": "list"}, {"name": "by", "selector": ".by", "type": "nested", "fields": [{"name": "who", "selector": "i"}]}]}
rows_fixture("pages_schema_records", "record string", [(_CARDS,)], "html string", lambda h: [(_j(r),) for r in D.extract(D.parse(h), _SCHEMA)])
_SCHEMAS = [(1, _SCHEMA), (2, {"fields": []}), (3, {"fields": [{"name": "a"}, {"name": "a"}]}), (4, {"fields": [{"name": "a", "type": "attribute"}]}), (5, {"fields": [{"name": "a", "regex": "("}]}), (6, {"base": "p", "fields": [{"key": "a", "css": "b", "attr": "href"}]}), (7, {"fields": [{"name": "a", "expression": "1"}]}), (8, {"fields": [{"name": "a", "type": "odd"}]})]


def _checked(i, s):
    try:
        return [(i, True, ",".join(sorted(D.checked_schema(json.loads(s))["fields"][0])))]
    except ValueError as e:
        return [(i, False, str(e).split(":")[0])]


rows_fixture("pages_schema_checks", "id int, ok boolean, told string", [(i, _j(s)) for i, s in _SCHEMAS], "id int, schema string", _checked)
_PATHS = [("//li",), ("//div[@class='card'][2]/h2/text()",), ("//div[contains(@class,'car')]/@data-id",), ("//span[starts-with(text(),'EUR')]",), ("//li[last()]",), ("//i/../..",), ("//h2[text()='Two']",)]
rows_fixture("pages_xpath", "path string, ord int, found string", _PATHS, "path string", lambda p: [(p, k, x if isinstance(x, str) else f"{x.tag}:{x.text()}") for k, x in enumerate(D.xpath(D.parse(_CARDS), p))])
rows_fixture("pages_selectors", "css string, path string, found boolean", [(_CARDS + "<p id=here><b>x</b></p>",)], "html string", lambda h: [(D.selector_of(n), D.xpath_of(n), D.select(r, D.selector_of(n)) == [n] and D.xpath(r, D.xpath_of(n)) == [n]) for r in [D.parse(h)] for n in r.nodes() if n.tag in ("h2", "li", "b")])
rows_fixture("pages_similar", "text string", [("<ul><li class='x a'>one</li><li class='x a'>two</li><li>three</li></ul><ol><li class='y'>four</li></ol>",)], "html string", lambda h: [(n.text(),) for r in [D.parse(h)] for n in D.similar(r, D.select(r, "li")[0], 0.7)])
rows_fixture("pages_relocated", "want string, got string", [("Buy this chair now",), ("nothing like it at all",)], "text string", lambda t: [(t, (lambda n: n and D.selector_of(n))(D.relocate(D.parse("<div><p>Some text</p><p class=buy>Buy this chair today</p></div>"), "p", t, {"class": "buy"})))])
rows_fixture("pages_narrowed", "ord int, markup string", [(_CARDS,)], "html string", lambda h: list(enumerate(D.narrowed(D.parse(h), "h2, .price"))))
rows_fixture("pages_minified", "html string", [("<div>  a \n b <pre> x  y </pre>   <b> c </b>\n</div>",)], "given string", lambda h: [(D.minified(D.parse(h)),)])
rows_fixture("pages_cleaned", "part string, value string", _ONE, "html string", lambda h: [(k, v if isinstance(v, str) and k != "body" else str(len(v))) for k, v in D.cleaned(h, _URL).items()])
rows_fixture("pages_references", "refs string", [("See the ref and the Imprint, not more.", _RICH)], "text string, html string", lambda t, h: [(D.surviving_references(t, D.parse(h), _URL),)])
rows_fixture("pages_bare_text", "text string", [("a<b>b</b> c<script>x</script>&amp;",), ("",), ("<p>x</p><p>y</p>",)], "html string", lambda h: [(D.bare_text(h),)])
_KINDS = [(1, "", "text/html", 0), (2, "<meta http-equiv=refresh content='0; url=/x'>", "", 0), (3, "<div data-paywall='true'>x</div>", "", 900), (4, "<p>Subscribe to continue</p>", "", 900), (5, '<div class="question">q</div>', "", 900), (6, "<body class='phpbb'>", "", 900), (7, "<nav class='md-nav'>", "", 900), (8, "".join(f"<a href='/{i}'>l</a>" for i in range(30)), "", 900), (9, "<article>x</article>", "", 900), (10, "<p>x</p>", "", 900), (11, "<div data-paywall='off'>x</div>", "", 900)]
rows_fixture("pages_kinds_by_markup", "id int, kind string", _KINDS, "id int, html string, media string, n int", lambda i, h, m, n: [(i, D.page_type(h, _URL, "", n))])

_BLOCKS = [(1, 429, "x"), (2, 200, "Pardon our interruption"), (3, 403, "<p>no</p>"), (4, 403, '{"e": 1}'), (5, 500, "Access denied"), (6, 200, "short"), (7, 200, '{"ok": true}'), (8, 200, "long " * 40), (9, 404, "gone"), (10, 500, "Access denied" + " " * 10_000), (11, None, None)]


@fixture("pages_block_ladder", "id int, block string", _BLOCKS, "id int, status int, text string")
def _(spark, df):
    return df.select("id", P.block(F.col("status"), F.col("text")).alias("block"))


_SHELLS = [
    (1, 200, "Please enable JavaScript", 100, "text/html", "http"), (2, 200, "", 100, "", "http"), (3, 200, "short", 5000, "text/html; charset=utf-8", "http"), (4, 200, "short", 5000, "text/html", "dynamic"),
    (5, 200, "", 100, "application/pdf", "http"), (6, 200, "Select your region " + "x" * 300, 100, "text/html", "http"), (7, 403, "cf-turnstile " + "x" * 300, 100, "text/html", "stealthy"), (8, 404, "not here " + "x" * 300, 100, "text/html", "http"),
    (9, 0, "none " + "x" * 300, 0, "", "http"), (10, 200, "fine " + "x" * 300, 5000, "text/html", "http"), (11, 200, "challenge-platform " + "x" * 300, 100, "text/html", "http"),
]


@fixture("pages_quality", "id int, issue string", _SHELLS, "id int, status int, text string, size bigint, ct string, fetcher string")
def _(spark, df):
    return df.select("id", R.quality("status", "text", "size", "ct", "fetcher").alias("issue"))


@fixture("pages_error_types", "error string, kind string", [("js_shell_detected: x",), ("AUTH_REQUIRED: y",), ("not_a_pdf: behind auth",), ("not_a_pdf: html",), ("geo_redirect_detected",), ("",), (None,)], "error string")
def _(spark, df):
    return df.select("error", P.error_page_type(F.col("error")).alias("kind"))


_ROUTED = [(1, "https://a/x", "application/json", "{}"), (2, "https://a/x", "application/json", ""), (3, "https://a/x", "text/html", "%PDF-1.7"), (4, "https://a/x.pdf?y", "text/html", "<p>Please Sign In</p>"), (5, "https://a/x.PDF", "text/html", "<p>moved</p>"), (6, "https://a/i", "image/png", "x"), (7, "https://old.reddit.com/r/x", "text/html", "<p>"), (8, "https://old.reddit.com/r/x/comments/1", "text/html", "<p>"), (9, None, None, None), (10, "https://a/d", "application/pdf", "x")]


@fixture("pages_routes", "id int, route string", _ROUTED, "id int, url string, ct string, body string")
def _(spark, df):
    return df.select("id", R.route("url", "ct", "body").alias("route"))


_PANEL = "<div class='panel loading'>Loading…</div>"
_AJAX = [(1, _PANEL * 2 + "<p>" + "words " * 60 + "</p>" + " " * 20_000, "words " * 60), (2, _PANEL + "<p>x</p>" + " " * 20_000, "words " * 60), (3, _PANEL * 2, "words " * 60), (4, _PANEL * 2 + " " * 20_000, "12345 " * 60), (5, "<div data-url='/x'><div class=spinner></div></div><section><img src='/loader.gif'></section>" + " " * 20_000, "words " * 60), (6, None, None)]
rows_fixture("pages_ajax_shells", "id int, panels int, shell boolean", _AJAX, "id int, html string, text string", lambda i, h, t: [(i, A.waiting_panels(D.parse(h)), A.ajax_shell(h, t))])

_XHR = [
    (1, "https://api.a.example/v1/prices?x=1", "xhr", "application/json; charset=utf-8"), (2, "https://www.google-analytics.com/collect", "xhr", "application/json"), (3, "https://static.a.example/x", "fetch", "application/json"),
    (4, "https://a.example/api/telemetry/x", "fetch", "text/plain"), (5, "https://a.example/app.js", "fetch", ""), (6, "https://a.example/data", "fetch", "image/png"), (7, "https://a.example/data", "document", "text/html"), (8, "https://a.example/data", "fetch", None),
]


@fixture("pages_captured", "id int, kept boolean, asked boolean", _XHR, "id int, url string, request string, media string")
def _(spark, df):
    return df.select("id", A.captured("url", "request", "media").alias("kept"), A.captured("url", "request", "media", "collect|data").alias("asked"))


@fixture("pages_payloads", "id int, consent boolean, animation boolean", [(1, '{"GDPR": 1, "vendorList": []}'), (2, '{"gdpr": 1}'), (3, '{"layers": [], "assets": [], "op": 1}'), (4, ""), (5, None), (6, " " * 4000 + "gdpr consent")], "id int, text string")
def _(spark, df):
    return df.select("id", A.consent_payload("text").alias("consent"), A.animation_payload("text").alias("animation"))


_FRAGMENTS = [
    ("p", 1, "u1", "word " * 100, "<p>", False), ("p", 2, "u2", "\n".join(f"{i} {i * 7} {i * 13}" for i in range(60)), '{"data": [], "items": []}', True), ("p", 3, "u3", "\n".join(f"12:0{i % 10} {i} C" for i in range(40)), "<table><tr><td>", False),
    ("p", 4, "u4", '{"ok": 1}', "", False), ("p", 5, "u5", "gdpr consent " * 50, "", False), ("p", 6, "u6", "   ", "", False), ("q", 1, "v1", '{"series": [1, 2, 3]}' * 20, '"series"', True),
]


@fixture("pages_fragments", "page string, place int, url string, n int, primary boolean", _FRAGMENTS, "page string, ord int, url string, text string, raw string, from_script boolean")
def _(spark, df):
    return A.ranked_fragments(df).withColumn("n", F.length("text"))


@fixture("pages_fragment_scores", "ord int, score double", _FRAGMENTS, "page string, ord int, url string, text string, raw string, from_script boolean")
def _(spark, df):
    return df.filter("page = 'p'").select("ord", F.round(A.fragment_score("text", "raw"), 6).alias("score"))


# --- texts

rows_fixture("text_absolute_links", "md string", [("[a](/x) ![i](y.png) [m](mailto:a@b) [h](#t) [w](https://w.example) [sp]( z )",)], "text string", lambda t: [(D.absolute_links(t, "https://a.example/d/p"),)])
rows_fixture("text_pretty_json", "id int, json string", [(1, '{"a":[1,{"b":"ü"}]}'), (2, " no json "), (3, "[]")], "id int, text string", lambda i, t: [(i, D.pretty_json(t))])
_REPLIES = [(1, 'Here:\n```json\n[{"a": 1, "b": ["x"]}]\n```'), (2, '{"a": "x"} trailing'), (3, '[{"b": "no list"}]'), (4, "nothing"), (5, "[1, 2]")]
rows_fixture("text_replies", "id int, records string", _REPLIES, "id int, reply string", lambda i, t: [(i, (lambda r: None if r is None else _j(r))(D.reply_records(t, {"a": "string", "b": "list"})))])
rows_fixture("text_cited", "id int, text string, refs string", [(1, 'See [one](/a "Title") and [two](https://b.example/x), again [one](/a) ![img](/i.png)'), (2, "no links"), (3, "")], "id int, md string", lambda i, t: [(i, *T.cite(t, "https://a.example/"))])


@fixture("text_clean_values", "id int, clean string", [(1, "a​b﻿c\x00d"), (2, "tab\tline\nret\rok"), (3, None)], "id int, text string")
def _(spark, df):
    return df.select("id", T.clean_value("text").alias("clean"))


@fixture("text_ratios", "id int, ratio double", [(1, "abcd", "bcde"), (2, "", None), (3, "same", "same"), (4, "a", "")], "id int, a string, b string")
def _(spark, df):
    return df.select("id", F.round(T.ratio("a", "b"), 6).alias("ratio"))


@fixture("text_without_noscript", "id int, kept string, cut string", [(1, "<p>a</p><noscript>turn it <b>on</b></noscript><style>x</style><p>b&amp;c</p>")], "id int, html string")
def _(spark, df):
    return df.select("id", T.visible_text("html").alias("kept"), T.visible_text("html", noscript=False).alias("cut"))


@fixture("text_toc_ends", "place int, end_page int")
def _(spark, df):
    toc = F.array(*[F.struct(F.lit(l).alias("level"), F.lit(p).cast("int").alias("page")) for l, p in ((1, 1), (2, 2), (2, 5), (1, 9), (2, None), (1, 9))])
    return spark.range(1).select(F.posexplode(T.toc_ends(toc, F.lit(12))).alias("place", "end_page"))


@fixture("text_retry_after", "value string, seconds double", [("120",), ("0",), ("-5",), ("Mon, 01 Jan 2024 00:01:30 GMT",), ("Sun, 31 Dec 2023 00:00:00 GMT",), ("soon",), (None,)], "value string")
def _(spark, df):
    return df.select("value", T.retry_after("value", F.lit("2024-01-01 00:00:00")).alias("seconds"))


_DATES = [("2024-01-31T10:00:00Z",), ("20240131",), ("2024/01/31",), ("January 31, 2024",), ("Jan 31, 2024",), ("31 January 2024",), ("31 Jan 2024",), ("2024-13-01",), ("D:20240131120000Z",), ("yesterday",), ("",), (None,)]


@fixture("text_dates", "text string, day string, property string", _DATES, "text string")
def _(spark, df):
    return df.select("text", T.parse_date("text").cast("string").alias("day"), R.document_date("text").alias("property"))


@fixture("text_page_specs", "spec string, pages string", [("",), ("1-3,5",), ("5,1-3,2",), ("9-12",), ("3-1",), ("x,2",), ("0",)], "spec string")
def _(spark, df):
    return df.select("spec", F.array_join(T.page_list("spec", F.lit(10)), ",").alias("pages"))


@fixture("text_within_bounds", "id int, n double", [(1, "5"), (2, "-3"), (3, "1e9"), (4, "x"), (5, None), (6, "NaN"), (7, "Infinity")], "id int, value string")
def _(spark, df):
    return df.select("id", R.within("value", 0, 100, 7).alias("n"))


_SECRETS = [(1, _j({"apiKey": "k", "user": {"password": "p", "name": "n"}, "urls": ["https://u:p@a.example/?token=1&x=2"], "auth": "Bearer abc"})), (2, "plain https://u:p@a.example/"), (3, None)]


@fixture("text_redacted_json", "id int, json string", _SECRETS, "id int, text string")
def _(spark, df):
    return df.select("id", S.redact_json("text").alias("json"))


rows_fixture("text_bounded_json", "id int, n int, cut boolean", [(1, 10), (2, 5000)], "id int, n int", lambda i, n: [(i, len(j), "_truncated" in j) for j in [S.bounded_json({"text": "x" * n, "token": "secret"}, 1000)]])


@fixture("text_packed_chunks", "place int, chunk string")
def _(spark, df):
    text = "One two three. Four five six seven. Eight nine. Ten. " + " ".join(f"w{i}" for i in range(23)) + ". End here."
    return spark.createDataFrame([(text,)], "t string").select(F.posexplode(T.semantic_chunks(10, 3)(F.col("t"))).alias("place", "chunk"))


_NAV = "\n".join(["Home", "About"] * 8 + ["A sentence that is long enough to be kept as it stands here, number %d of the page." % i for i in range(30)] + [f"Link {i}" for i in range(12)])


@fixture("text_collapsed_lines", "place int, line string", [(_NAV,), ("short\n" * 30,), (None,)], "t string")
def _(spark, df):
    return df.select(F.posexplode(F.split(T.collapse_lines("t"), "\n")).alias("place", "line")).filter(~F.col("line").startswith("A sentence") & (F.col("place") < 60) & (F.col("line") != "short") & (F.col("line") != ""))


@fixture("text_joined_hyphens", "id int, text string", [(1, ["some-", "thing new", "well-", "Known", " two ", "words"]), (2, []), (3, ["a -", "b"])], "id int, lines array<string>")
def _(spark, df):
    return df.select("id", T.dehyphenate(F.col("lines")).alias("text"))


_SPANS = [(1, 10.0, "body text"), (1, 10.0, "more"), (1, 14.0, "Title"), (1, None, "x"), (2, 9.0, "ab"), (2, 12.0, "cd"), (3, 8.0, None)]


@fixture("pdf_font_sizes", "page int, median_size double, main_size double", _SPANS, "page int, size double, text string")
def _(spark, df):
    return T.font_sizes(df, "page")


# --- urls and search

_UNSAFE = [(u,) for u in ("https://a.example/x", "http://127.0.0.1/", "http://0x7f.1/", "http://2130706433/", "http://[::1]/", "http://[::ffff:10.0.0.1]/", "http://192.168.0.9:8080/", "http://169.254.169.254/latest", "http://metadata.google.internal/", "ftp://a.example/", "https://u:p@a.example/", "http://localhost./", "https://x.internal/", "https://1.2.3.4.nip.io/", "https://8.8.8.8/", "https://a.example:99999/", "https://a.example/\nx", "", None)]


@fixture("url_unsafe_reasons", "url string, reason string", _UNSAFE, "url string")
def _(spark, df):
    return df.select("url", S.unsafe("url").alias("reason"))


@fixture("url_platforms", "url string, platform string", [("https://www.instagram.com/p/x",), ("https://vm.tiktok.com/x",), ("https://youtu.be/x",), ("https://a.example/",), ("",)], "url string")
def _(spark, df):
    return df.select("url", F.coalesce(U.platform("url"), F.lit("")).alias("platform"))


@fixture("url_capped_score", "id int, kept boolean", [(1, "https://a.example/docs/x", "Docs", "text"), (2, "https://a.example/i.png", "x", "y"), (3, "https://b.example/docs", "x", "y")], "id int, url string, title string, text string")
def _(spark, df):
    chain = U.pattern_filter("url", include=["*/docs/*"]) & U.domain_filter("url", ["a.example"]) & ~U.is_asset("url")
    return df.select("id", chain.alias("kept"))


_ASKS = [("spark vs flink", "brave"), ("spark vs flink", "google"), ("research paper on memory", "google"), ("research paper on memory", "yahoo"), ("latest news on spark", "qwant"), ("plain words", "google")]


@fixture("search_query_map", "query string, engine string, intent string, backend string, asked string", _ASKS, "query string, engine string")
def _(spark, df):
    k = df.withColumn("intent", C.intent(F.col("query")))
    return k.select("query", "engine", "intent", C.intent_backend(F.col("intent")).alias("backend"), C.query_for(F.col("query"), F.col("intent"), F.col("engine")).alias("asked"))


@fixture("search_quorum_rule", "query_id int, at string")
def _(spark, df):
    import datetime as dt

    t = dt.datetime(2024, 1, 1)
    s = lambda x: t + dt.timedelta(seconds=x)
    hits = [(1, e, s(k), f"https://a{i}.example/") for i, (e, k) in enumerate((("a", 1), ("a", 1), ("b", 2), ("c", 3), ("c", 3), ("a", 5)))]
    hits += [(2, "a", s(1), f"https://b{i}.example/") for i in range(7)] + [(3, e, s(1), "https://c.example/") for e in "abcd"] + [(4, "a", s(9), f"https://d{i}.example/") for i in range(6)] + [(5, None, None, None)]
    h = spark.createDataFrame(hits, "query_id int, engine string, arrival timestamp, url string")
    q = spark.createDataFrame([(i, t if i != 6 else None) for i in range(1, 7)], "query_id int, issued_at timestamp")
    return Q.quorum(h, q).select("query_id", F.date_format("quorum_at", "HH:mm:ss").alias("at"))


# --- state, plans, crawls

_CALLS = [(i, "h", t * 1_000_000, s) for i, (t, s) in enumerate([(0, 200), (1, 429), (2, 200), (3, 403), (4, 429), (5, 200), (70, 200), (71, 500), (400, 200)])]
_CALL = "fetch_id bigint, host string, us bigint, status int"


@fixture("state_key_order", "fetch_id bigint, key_no int", _CALLS, _CALL)
def _(spark, df):
    return ST.key_turns(df, 3)


@fixture("state_route_order", "fetch_id bigint, route_no int, direct_no int", _CALLS, _CALL)
def _(spark, df):
    return ST.route_turns(df, 2).join(ST.route_turns(df, 2, direct=True).select("fetch_id", F.col("route_no").alias("direct_no")), "fetch_id")


@fixture("state_policy_reads", "fetch_id bigint, read boolean", [(i, "h", t * 1_000_000, s) for i, (t, s) in enumerate([(0, 404), (200, 200), (301, 200), (302, 404), (3900, 200), (3901, 200), (9000, None), (9200, 200), (9301, 200)])], _CALL)
def _(spark, df):
    return ST.policy_reads(df)


@fixture("state_hits_in_time", "id int, entry_id int")
def _(spark, df):
    import datetime as dt

    t = dt.datetime(2024, 1, 1)
    s = lambda x: t + dt.timedelta(seconds=x)
    cache = spark.createDataFrame([(1, "k", s(0), 100), (2, "k", s(50), 100), (3, "l", s(0), None), (4, "m", s(0), 10)], "entry_id int, key string, fetched_at timestamp, ttl int")
    asked = spark.createDataFrame([(1, "k", s(40), None), (2, "k", s(60), None), (3, "k", s(60), 5), (4, "k", s(200), None), (5, "l", s(1), None), (6, "x", s(1), None), (7, "m", s(5), 60)], "id int, key string, at timestamp, ttl int")
    return ST.hits_in_time(asked, cache)


_POSTS = [(1, "instagram", "A", None), (2, "instagram", None, "https://www.instagram.com/p/A/?x=1"), (3, None, "B", "https://b.example/x/"), (4, None, None, "https://b.example/x"), (5, "tiktok", "A", None), (6, None, None, None), (7, None, None, None), (8, "instagram", "S", None)]


@fixture("social_aliases", "item int, names string", _POSTS, "item int, platform string, code string, url string")
def _(spark, df):
    return df.select("item", F.array_join(F.array_sort(K.aliases(F.col("platform"), F.col("code"), F.col("url"))), " ").alias("names"))


@fixture("social_unseen", "item int", _POSTS, "item int, platform string, code string, url string")
def _(spark, df):
    items = df.select("item", F.col("item").alias("ord"), K.aliases(F.col("platform"), F.col("code"), F.col("url")).alias("names"))
    return K.unseen(items, spark.createDataFrame([("instagram:id:S",)], "name string"))


@fixture("social_grid", "code string, url string, caption string, views string, likes string, comments string, cover string")
def _(spark, df):
    grid = spark.createDataFrame([("https://www.instagram.com/reel/A/", "1,234 views 5 likes", "g", "ga"), ("https://www.instagram.com/p/B/", "2.5K likes 3 comments", None, None), ("https://www.instagram.com/x", None, "odd", None)], "url string, visible string, caption string, cover string")
    payloads = spark.createDataFrame([("A", True, "p", 99, None, 7, "pa"), ("C", False, "only", None, 1, None, "pc"), ("D", True, None, None, None, None, None)], "code string, is_video boolean, caption string, views int, likes int, comments int, cover string")
    return K.grid_posts(grid, payloads)


@fixture("social_likes", "page int, ord int, text string, likes int", [(1, i, l) for i, l in enumerate(["first", "1,200 likes", "second", "", "3 likes", "  ", "third", "fourth"])] + [(2, 0, "other")], "page int, ord int, line string")
def _(spark, df):
    return K.carried_likes(df)


_LINKS = [("https://a.example/", "https://a.example/docs", "docs"), ("https://a.example/", "https://a.example/login", "sign in"), ("https://a.example/docs", "https://a.example/docs/2", "more"), ("https://a.example/", "https://a.example/i.png", "image"), ("https://a.example/docs/2", "https://a.example/", "home"), ("https://a.example/docs/2", "https://a.example/deep", "deep")]


@fixture("crawl_best_first", "most int, page string, depth int", _LINKS, "src string, dst string, text string")
def _(spark, df):
    seeds = spark.createDataFrame([("https://a.example",)], "page string")
    runs = [W.crawl(df, seeds, ["docs"], max_pages=n).select(F.lit(n).alias("most"), "page", "depth") for n in (2, 100)]
    return runs[0].unionByName(runs[1])


_PLAN = {"version": 1, "nodes": [{"id": "top", "stage": "search_select", "depends_on": ["good"], "input": "good", "tiers": ["high"], "max": 2}, {"id": "good", "stage": "filter", "input": "hits", "where": "score > 0"}, {"id": "bad", "stage": "filter", "input": "hits", "where": "no_such_column > 1"}, {"id": "after", "stage": "select", "depends_on": ["bad"], "input": "bad", "columns": ["url"]}]}
_RANKED = [("https://a.example/1", 0.9, "high", "docs", 1), ("https://a.example/2", 0.8, "high", "docs", 2), ("https://a.example/3", 0.7, "high", "blog", 3), ("https://a.example/4", 0.0, "high", "docs", 1)]


@fixture("plan_pipeline", "ord int, id string, ok boolean, rows bigint", _RANKED, "url string, score double, tier string, source_type string, rank int")
def _(spark, df):
    got = pipeline.run(_PLAN, {"hits": df})
    return spark.createDataFrame([(i, r["id"], r["ok"], r["result"].count() if r["ok"] else None) for i, r in enumerate(got)], "ord int, id string, ok boolean, rows bigint")


@fixture("search_selected", "url string", _RANKED, "url string, score double, tier string, source_type string, rank int")
def _(spark, df):
    got = pipeline.run({"version": 1, "nodes": [{"id": "s", "stage": "search_select", "input": "hits", "source_types": ["docs"], "domains": ["a.example"], "max": 1}]}, {"hits": df})
    return got[0]["result"]


@fixture("search_rerank_pool", "wanted int, n bigint")
def _(spark, df):
    ranked = spark.range(1, 41).select(F.col("id").cast("int").alias("rank"))
    return Q.rerank_pool(ranked, 3).agg(F.lit(3).alias("wanted"), F.count(F.lit(1)).alias("n")).unionByName(Q.rerank_pool(ranked, 10).agg(F.lit(10).alias("wanted"), F.count(F.lit(1)).alias("n")))

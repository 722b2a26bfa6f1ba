import gzip
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weft.functions import dom as D
from weft.plans import pipeline
from weft.sources import web


def test_tables_fill_spans_and_leave_layout_out():
    html = """<table summary="s"><caption>Prices</caption><thead><tr><th>A</th><th colspan=2>B</th></tr></thead>
    <tbody><tr><td rowspan=2>1</td><td>2</td><td>3</td></tr><tr><td>4<table><tr><td>inner</td></tr></table></td><td>5</td></tr></tbody></table>
    <table><tr><td>layout</td></tr></table><table><thead><tr><th colspan=x>A</th></tr></thead><tbody><tr><td>1</td></tr></tbody><caption>c</caption></table>"""
    got = D.tables(D.parse(html))
    assert len(got) == 1 and got[0]["headers"] == ["A", "B", "B"] and got[0]["rows"] == [["1", "2", "3"], ["1", "4", "5"]] and got[0]["caption"] == "Prices"


def test_links_metadata_and_structured_data():
    html = """<html lang=en><head><title> A  b </title><link rel=canonical href=/c><meta property="og:title" content=T><meta name=author content=Me>
    <script type="application/ld+json">{"@graph": [{"@type": "X"}, {"@type": "Y"}]}</script><script type="application/ld+json">{broken,}</script>
    <script>window.state = {"a": [1, 2]}; var s = "</p>";</script></head><body><nav><a href=/n>Nav</a></nav><p><b>One<br><p>Two <a href="/x#1">X</a><a href="/x">again</a><a href="https://b.example/">B</a><a href="mailto:a@b">m</a>
    <div itemscope itemtype="http://s/Product"><span itemprop=name>N</span><div itemprop=offer itemscope itemtype="http://s/Offer"><meta itemprop=price content=5></div></div>"""
    root = D.parse(html)
    assert D.metadata(root, "https://a.example/") == {"lang": "en", "title": "T", "canonical": "https://a.example/c", "author": "Me"}
    assert [(u, k) for u, _, k in D.links(root, "https://www.a.example/p")] == [("https://www.a.example/n", "navigation"), ("https://www.a.example/x", "citation"), ("https://b.example/", "external")]
    assert [json.loads(x)["@type"] for x in D.json_ld(root)] == ["X", "Y"]
    assert json.loads(D.microdata(root)[0]) == {"@type": "Product", "name": "N", "offer": {"@type": "Offer", "price": "5"}}
    assert ("state", '{"a": [1, 2]}') in D.script_data(root)


@pytest.mark.parametrize("css,n", [("li", 3), ("ul > li.a", 2), ("li:nth-child(2)", 1), ("li:first-child, li:last-child", 2), ("li:not(.a)", 1), ("[data-x^=v]", 1), ("li + li", 2), ("h1 ~ ul li", 3), ("li::before", 0)])
def test_css(css, n):
    root = D.parse('<div><h1>t</h1><ul><li class="a b">1<li class=a data-x=v1>2<li>3</ul></div>')
    assert len(D.select(root, css)) == n


def test_generated_selectors_find_their_node():
    root = D.parse("<div><p>1<p>2<ul id=k><li>a<li>b</ul></div><div><p>3</div>")
    for node in root.nodes():
        assert D.select(root, D.selector_of(node)) == [node]


def test_records_have_every_field():
    schema = {"baseSelector": ".r", "fields": [{"name": "t", "selector": "b", "transform": "uppercase"}, {"name": "n", "selector": "i", "pattern": r"(\d+)"}, {"name": "none", "selector": "u", "default": "-"}, {"name": "sub", "selector": "s", "type": "nested", "fields": [{"name": "x"}]}]}
    got = D.extract(D.parse("<div class=r><b>a</b><i>no 12</i><s>q</s></div><div class=r></div>"), schema)
    assert got == [{"t": "A", "n": "12", "none": "-", "sub": {"x": "q"}}, {"t": None, "n": None, "none": "-", "sub": None}]


def test_pruning_keeps_the_article_and_survives_depth():
    html = "<nav class=menu><a href=/1>a</a><a href=/2>b</a></nav><article><p>" + "Some words of real text. " * 20 + "</p></article>" + "<div>" * 3000 + "deep" + "</div>" * 3000
    text = D.prune(D.sanitise(D.parse(html))).text()
    assert "real text" in text and "a b" not in text
    md = D.markdown(D.parse("<h2>T</h2><ul><li>x</li></ul><p>a <b>b</b> <a href=/c>c</a></p><script>no</script>"))
    assert md == "## T\n\n- x\n\na **b** [c](/c)"


URLSET = '<urlset xmlns="http://s"><url><loc> https://a.example/1 </loc><lastmod>2024-01-01</lastmod></url><url><loc>https://a.example/2</loc></url></urlset>'


def test_sitemaps():
    want = [("https://a.example/1", "2024-01-01", "page", False), ("https://a.example/2", None, "page", False)]
    assert list(web.sitemap(URLSET)) == want and list(web.sitemap(gzip.compress(URLSET.encode()))) == want
    assert list(web.sitemap(URLSET[:90])) == [("https://a.example/1", None, "page", True)]
    assert list(web.sitemap("<sitemapindex><sitemap><loc>https://a.example/s</loc></sitemap></sitemapindex>"))[0][2] == "index"
    assert list(web.sitemap('<!DOCTYPE x [<!ENTITY e "x">]><urlset><url><loc>&e;</loc></url></urlset>')) == []


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=300))
def test_parsers_never_raise(data):
    list(web.sitemap(data))
    list(web.feed(data))
    D.markdown(D.parse(data.decode("utf-8", "replace")))
    list(web.comment_tree(data.decode("utf-8", "replace")))


def test_feeds_robots_comments_and_relaxed_json():
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>t3_a</id><title>T</title><link href="/x"/><author><name>N</name></author><updated>2024</updated></entry></feed>'
    assert list(web.feed(atom, "https://a.example/")) == [("t3_a", "T", "https://a.example/x", "N", "2024")]
    robots = "User-agent: *\nDisallow: /private\nAllow: /private/open\n\nUser-agent: bot\nDisallow: /"
    assert [web.robots_policy(200, robots, f"https://a.example{p}") for p in ("/x", "/private/1", "/private/open/1")] == ["allowed", "disallowed", "allowed"]
    assert web.robots_policy(200, robots, "https://a.example/x", "mybot") == "disallowed"
    assert [web.robots_policy(s, "", "https://a.example/") for s in (404, 503, None)] == ["no_policy", "unavailable", "unavailable"]
    tree = json.dumps([{"kind": "t1", "data": {"id": "1", "body": "a", "replies": {"data": {"children": [{"data": {"id": "2", "body": "b"}}]}}}}, {"data": {"id": "3", "body": "c"}}])
    assert [(o, d, i) for o, d, i, _, _ in web.comment_tree(json.dumps({"data": {"children": json.loads(tree)}}))] == [(0, 0, "1"), (1, 1, "2"), (2, 0, "3")]
    assert web.relaxed_json('{"a": "x,} // no", /* c */ "b": [1, 2,], // d\n}') == {"a": "x,} // no", "b": [1, 2]}


def test_pipeline_order_skips_and_cycles(spark):
    df = spark.range(10)
    p = {"version": 1, "nodes": [{"id": "b", "stage": "filter", "input": "a", "where": "id > 5", "depends_on": ["a"]}, {"id": "a", "stage": "filter", "input": "src", "where": "id % 2 = 0"}, {"id": "x", "stage": "select", "input": "src", "columns": ["nope"]}, {"id": "y", "stage": "filter", "input": "x", "where": "true", "depends_on": ["x"]}]}
    got = pipeline.run(p, {"src": df})
    assert [r["id"] for r in got] == ["a", "b", "x", "y"] and [r["ok"] for r in got] == [True, True, False, False]
    assert sorted(r["id"] for r in got[1]["result"].collect()) == [6, 8]
    with pytest.raises(ValueError, match="cycle"):
        pipeline.ordered([{"id": "a", "stage": "filter", "depends_on": ["b"]}, {"id": "b", "stage": "filter", "depends_on": ["a"]}])
    with pytest.raises(ValueError, match="code"):
        pipeline.ordered([{"id": "a", "stage": "filter", "code": "x"}])


def test_table_functions_and_page_folder(spark, tmp_path):
    from weft.sources.folder import PageFolder

    web.register(spark)
    assert spark.sql(f"SELECT url FROM sitemap_urls('{URLSET}')").count() == 2
    (tmp_path / "a.jsonl").write_text('{"url": "https://a.example/", "status": 200, "body": "x"}\nbroken\n')
    spark.dataSource.register(PageFolder)
    assert [tuple(r) for r in spark.read.format("weft_pages").load(str(tmp_path)).collect()] == [("https://a.example/", 200, "x")]
    lines = spark.createDataFrame([('["https://b.example/", "https://a.example/"]',), ("https://a.example/",), ("# no",)], "value string").coalesce(1)
    assert [r["url"] for r in web.url_list(lines).collect()] == ["https://b.example/", "https://a.example/"]

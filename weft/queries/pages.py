"""Queries over page trees. Stored texts are rendered to pages first, then parsed once for every product asked for."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from weft.functions import dom as D
from weft.functions import pages as P
from weft.operators import crawl as W
from weft.plans.staging import ensure_package
from weft.queries.base import CORE
from weft.sources.tables import cache_text, latest_delivery, table


def _pages(spark, d):
    last = latest_delivery(table(spark, d, "cache_entries").select("entry_id", "url", "content", "stored_at"), "entry_id", "stored_at")
    return last.select("entry_id", "url", cache_text().alias("text"))


def _each(df, schema: str, rows_of):
    """Rows of each page: ``rows_of(url, text)`` gives tuples; the id comes first."""
    ensure_package(df.sparkSession)

    def run(batches):
        for b in batches:
            at, rows = [], []
            for i, (url, text) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())):
                for r in rows_of(url or "", text or ""):
                    at.append(i)
                    rows.append(r)
            cols = [list(c) for c in zip(*rows)] if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, types))], names=["entry_id", *names])

    fields = [x.rsplit(" ", 1) for x in schema.split(", ")]
    names = [n for n, _ in fields]
    types = [{"string": pa.string(), "int": pa.int32(), "array<string>": pa.list_(pa.string()), "double": pa.float64()}[t] for _, t in fields]
    return df.select("entry_id", "url", "text").mapInArrow(run, f"entry_id bigint, {schema}")


@CORE.add("pages_links")
def pages_links(spark, d):
    def rows(url, text):
        return [(i, *x) for i, x in enumerate(D.links(D.parse(D.render(text)), url))]

    return _each(_pages(spark, d), "ord int, target string, text string, kind string", rows)


@CORE.add("pages_tables")
def pages_tables(spark, d):
    def rows(url, text):
        return [(i, t["headers"], j, r) for i, t in enumerate(D.tables(D.parse(D.render(text)))) for j, r in enumerate(t["rows"])]

    return _each(_pages(spark, d), "table_ix int, headers array<string>, row_ix int, cells array<string>", rows)


@CORE.add("pages_records")
def pages_records(spark, d):
    schema = {"baseSelector": "article", "fields": [{"name": "title", "selector": "h1"}, {"name": "first", "selector": "p"}, {"name": "link", "selector": "a", "type": "attribute", "attribute": "href"}]}

    def rows(url, text):
        return [(r["title"], r["first"], r["link"]) for r in D.extract(D.parse(D.render(text)), schema)]

    return _each(_pages(spark, d), "title string, first string, link string", rows)


@CORE.add("pages_metadata", r"""SELECT DISTINCT entry_id, nullif(trim(regexp_replace(url, '\s+', ' ', 'g')), '') AS title, CAST(NULL AS VARCHAR) AS lang, CAST(NULL AS VARCHAR) AS canonical FROM cache_entries""")
def pages_metadata(spark, d):
    def rows(url, text):
        m = D.metadata(D.parse(D.render(text, url)), url)
        return [(m.get("title"), m.get("lang"), m.get("canonical"))]

    return _each(_pages(spark, d), "title string, lang string, canonical string", rows)


@CORE.add("pages_main_markdown")
def pages_main_markdown(spark, d):
    return _each(_pages(spark, d), "markdown string", lambda url, text: [(D.markdown(D.prune(D.sanitise(D.parse(D.render(text))))),)])


@CORE.add("pages_signals", r"""WITH e AS (SELECT DISTINCT entry_id, array_to_string(CAST(json(content) AS VARCHAR[]), chr(10)) AS text FROM cache_entries),
    p AS (SELECT entry_id, '<html><body><p>' || text || '</p><a href="/x">more</a><script>1</script></body></html>' AS h FROM e)
    SELECT entry_id, CAST(length(trim(regexp_replace(regexp_replace(regexp_replace(h, '(?is)<script\b[^>]*>.*?</script>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))) AS INT) AS text_len,
      CAST(len(regexp_extract_all(h, '(?i)<script\b')) AS INT) AS scripts, CAST(len(regexp_extract_all(h, '(?i)<a\b[^>]*href')) AS INT) AS links FROM p""")
def pages_signals(spark, d):
    h = F.concat(F.lit("<html><body><p>"), "text", F.lit('</p><a href="/x">more</a><script>1</script></body></html>'))
    s = P.signals(h)
    return _pages(spark, d).select("entry_id", s["text_len"].alias("text_len"), s["scripts"].alias("scripts"), s["links"].alias("links"))


@CORE.add("pages_kind", r"""WITH e AS (SELECT DISTINCT entry_id, array_to_string(CAST(json(content) AS VARCHAR[]), chr(10)) AS text FROM cache_entries),
    s AS (SELECT entry_id, length(text) AS md, length(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS t, len(regexp_extract_all(text, '\]\(/')) AS links, coalesce(list_sum(list_transform(regexp_extract_all(text, '\[([^\]\n]*)\]\(/', 1), lambda x: length(x))), 0) AS lt FROM e)
    SELECT entry_id, CASE WHEN links >= 10 AND lt / greatest(t, 1) >= 0.5 THEN 'list' WHEN md >= 200 THEN 'article' WHEN links >= 10 THEN 'list' ELSE 'fallback' END AS kind, md >= 50 AS ok FROM s""")
def pages_kind(spark, d):
    t = F.trim(F.regexp_replace("text", r"\s+", " "))
    link_text = F.aggregate(F.regexp_extract_all("text", F.lit(r"\[([^\]\n]*)\]\(/"), F.lit(1)), F.lit(0), lambda a, x: a + F.length(x))
    k = P.kind(F.length("text"), F.length(t), F.regexp_count("text", F.lit(r"\]\(/")), link_text, F.lit(0), F.lit(False))
    return _pages(spark, d).select("entry_id", k["kind"].alias("kind"), k["ok"].alias("ok"))


@CORE.add("pages_kind_counts", "WITH t AS (" + CORE.sql["pages_kind"] + ") SELECT kind, count(*) AS pages, CAST(sum(CASE WHEN ok THEN 1 ELSE 0 END) AS BIGINT) AS ok FROM t GROUP BY kind")
def pages_kind_counts(spark, d):
    """Pages by kind, and how many of them have enough content."""
    return pages_kind(spark, d).groupBy("kind").agg(F.count(F.lit(1)).alias("pages"), F.count_if("ok").alias("ok"))


@CORE.add("pages_blocked", """WITH e AS (SELECT DISTINCT entry_id, status, array_to_string(CAST(json(content) AS VARCHAR[]), chr(10)) AS text FROM cache_entries)
    SELECT entry_id, CASE WHEN status = 429 THEN 'rate' WHEN regexp_matches(text, '(?i)pardon\\s+our\\s+interruption|attention\\s+required|captcha-delivery\\.com|_Incapsula_Resource|blocked\\s+by\\s+network\\s+security') THEN 'vendor'
      WHEN status IN (403, 503) AND NOT regexp_matches(text, '^\\s*[\\[{]') THEN 'status' WHEN status >= 400 AND length(text) < 10000 AND regexp_matches(text, '(?i)access\\s+denied|checking\\s+your\\s+browser|g-recaptcha|h-captcha') THEN 'marker'
      WHEN status = 200 AND length(trim(translate(text, chr(10) || chr(9) || chr(13), '   '))) < 100 AND NOT regexp_matches(text, '^\\s*[\\[{]') THEN 'empty' ELSE 'none' END AS block FROM e""")
def pages_blocked(spark, d):
    last = latest_delivery(table(spark, d, "cache_entries").select("entry_id", "status", "content", "stored_at"), "entry_id", "stored_at")
    e = last.select("entry_id", "status", cache_text().alias("text"))
    return e.select("entry_id", P.block(F.col("status"), F.col("text")).alias("block"))


_EDGES = r"""page AS (SELECT entry_id, url, array_to_string(CAST(json(content) AS VARCHAR[]), chr(10)) AS text FROM (SELECT DISTINCT ON (entry_id) * FROM cache_entries ORDER BY entry_id)),
    e AS (SELECT DISTINCT regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]*)', 1)), '^www\.', '') AS src, regexp_extract(unnest(regexp_extract_all(text, '\]\((/[^)\s]*)\)', 1)), '^/([a-zA-Z0-9]+)', 1) AS dst FROM page)"""


@CORE.add("crawl_reachable", f"""WITH RECURSIVE {_EDGES}, pair AS (SELECT src, dst FROM e WHERE src <> '' AND dst <> ''),
    walk AS (SELECT DISTINCT src AS node, 0 AS depth FROM pair UNION SELECT p.dst, w.depth + 1 FROM walk w JOIN pair p ON p.src = w.node WHERE w.depth < 3)
    SELECT node, CAST(min(depth) AS INT) AS depth FROM walk GROUP BY node""")
def crawl_reachable(spark, d):
    """Depth of everything that is reached from the sites' pages over their relative links, in rounds of joins."""
    pages = latest_delivery(table(spark, d, "cache_entries").select("entry_id", "url", "content", "stored_at"), "entry_id", "stored_at")
    targets = F.regexp_extract_all(cache_text(), F.lit(r"\]\((/[^)\s]*)\)"), F.lit(1))
    e = pages.select(F.regexp_replace(F.regexp_extract(F.lower("url"), r"^[a-z]+://([^/:?#]*)", 1), r"^www\.", "").alias("src"), F.explode(targets).alias("t"))
    edges = e.select("src", F.regexp_extract("t", r"^/([a-zA-Z0-9]+)", 1).alias("dst")).filter("src <> '' and dst <> ''").distinct()
    return W.reachable(edges, edges.select(F.col("src").alias("node")).distinct(), 3)


@CORE.add("pages_types")
def pages_types(spark, d):
    return _each(_pages(spark, d), "page_type string", lambda url, text: [(D.page_type(D.render(text), url, "", len(text)),)])


@CORE.add("pages_citations")
def pages_citations(spark, d):
    from weft.functions import text as T

    c = T.cited("text", "url")
    return _pages(spark, d).select("entry_id", c.alias("c")).select("entry_id", F.col("c")[0].alias("text"), F.col("c")[1].alias("refs"))


@CORE.add("pages_metrics")
def pages_metrics(spark, d):
    def rows(url, text):
        m = D.metrics(D.parse(D.render(text)))
        return [(m["nodes"], m["text"], m["depth"])]

    return _each(_pages(spark, d), "nodes int, chars int, depth int", rows)

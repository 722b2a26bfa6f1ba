"""Documents that name pages: sitemaps, feeds, robots rules, url lists, comment trees, API responses.

The parsers are plain Python that never raises on broken input; ``table_function``
registers the row-producing ones for use over DataFrames and in SQL.
"""

from __future__ import annotations

import gzip
import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from urllib.parse import urljoin, urlsplit

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_URLS, MAX_ENTRIES, MAX_BYTES = 50_000, 500, 50_000_000


def _xml(data: bytes | str | None) -> ET.Element | None:
    """Root of an XML document, gzip by its magic; entities that are declared are refused."""
    raw = data.encode() if isinstance(data, str) else bytes(data or b"")
    if raw[:2] == b"\x1f\x8b":
        try:
            raw = gzip.decompress(raw)[:MAX_BYTES]
        except (OSError, EOFError):
            return None
    if re.search(rb"<!(?:ENTITY|DOCTYPE)", raw[:20_000], re.I):
        return None
    try:
        return ET.fromstring(raw.strip())
    except (ET.ParseError, ValueError):
        return None


def _name(e: ET.Element) -> str:
    return e.tag.rsplit("}", 1)[-1].lower() if isinstance(e.tag, str) else ""


def sitemap(data: bytes | str | None, most: int = MAX_URLS) -> Iterator[tuple[str, str | None, str, bool]]:
    """(url, lastmod, kind, recovered) rows of a urlset or an index; from truncated documents what can be read."""
    root = _xml(data)
    if root is not None:
        n = 0
        for e in root.iter():
            if _name(e) in ("url", "sitemap") and n < most:
                loc = next((c.text for c in e if _name(c) == "loc" and c.text), None)
                if loc and loc.strip():
                    n += 1
                    mod = next((c.text for c in e if _name(c) == "lastmod" and c.text), None)
                    yield loc.strip(), mod.strip() if mod else None, "index" if _name(e) == "sitemap" else "page", False
        return
    raw = data.decode("utf-8", "replace") if isinstance(data, (bytes, bytearray)) else data or ""
    if "<!ENTITY" not in raw.upper():
        for m in list(re.finditer(r"<loc>\s*([^<\s]+)\s*</loc>", raw, re.I))[:most]:
            yield m[1], None, "page", True


def feed(data: bytes | str | None, url: str = "", most: int = MAX_ENTRIES) -> Iterator[tuple[str, str, str, str, str]]:
    """(id, title, link, author, published) rows of an Atom or RSS feed."""
    root = _xml(data)
    if root is None:
        return
    n = 0
    for e in root.iter():
        if _name(e) not in ("entry", "item") or n >= most:
            continue
        got: dict[str, str] = {}
        for c in e:
            k = _name(c)
            if k == "link":
                got.setdefault("link", c.attrib.get("href") or (c.text or "").strip())
            elif k == "author":
                got.setdefault("author", next(((x.text or "").strip() for x in c if _name(x) == "name"), (c.text or "").strip()))
            elif k in ("title", "id", "guid", "published", "updated", "pubdate", "creator"):
                got.setdefault(k, (c.text or "").strip())
        n += 1
        link = urljoin(url, got.get("link", ""))
        yield got.get("id") or got.get("guid") or link, got.get("title", ""), link, got.get("author") or got.get("creator", ""), got.get("published") or got.get("pubdate") or got.get("updated", "")


def robots_rules(text: str | None, agent: str = "*") -> list[tuple[str, bool]]:
    """(path prefix, allowed) rules of the group that names the agent best."""
    groups: dict[str, list[tuple[str, bool]]] = {}
    names: list[str] = []
    fresh = True
    for line in (text or "").splitlines():
        key, sep, value = line.split("#", 1)[0].partition(":")
        key, value = key.strip().lower(), value.strip()
        if not sep:
            continue
        if key == "user-agent":
            names = [value.lower()] if fresh else [*names, value.lower()]
            fresh = False
            groups.setdefault(value.lower(), [])
        elif key in ("allow", "disallow") and names:
            fresh = True
            if value or key == "allow":
                for n in names:
                    groups[n].append((value, key == "allow"))
    best = max((n for n in groups if n != "*" and n in agent.lower()), key=len, default="*")
    return groups.get(best, [])


def robots_policy(status: int | None, text: str | None, url: str, agent: str = "*") -> str:
    """allowed, disallowed, no_policy or unavailable; the longest rule decides, allowing wins ties."""
    if status in (404, 410):
        return "no_policy"
    if status is None or status in (401, 403) or status >= 500:
        return "unavailable"
    parts = urlsplit(url)
    path = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    fitting = [(len(p), ok) for p, ok in robots_rules(text, agent) if re.match(re.escape(p).replace(r"\*", ".*").replace(r"\$", "$"), path)]
    return "allowed" if not fitting or max(fitting)[1] else "disallowed"


def robots_sitemaps(text: str | None, url: str = "") -> list[str]:
    """Sitemaps that a robots file names, absolute, in order, each once."""
    found = [v.strip() for k, sep, v in (l.split("#", 1)[0].partition(":") for l in (text or "").splitlines()) if sep and k.strip().lower() == "sitemap" and v.strip()]
    return list(dict.fromkeys(urljoin(url, f) for f in found))


def page_feeds(html: str | None, url: str) -> list[str]:
    """Feeds and sitemaps that a page's head links to."""
    from weft.functions.dom import parse

    kinds = ("application/rss+xml", "application/atom+xml", "application/feed+json")
    found = [n.attrs["href"] for n in parse(html).nodes() if n.tag == "link" and n.attrs.get("href") and (n.attrs.get("type", "").lower() in kinds or "sitemap" in n.attrs.get("rel", "").lower())]
    return list(dict.fromkeys(urljoin(url, f.strip()) for f in found))


LISTED = 25


def listing(html: str | None, url: str = "", most: int = LISTED) -> Iterator[tuple[int, str, str, str, str, str]]:
    """(ord, title, link, author, score, comments) of a listing page's entries; promoted ones are left out."""
    from weft.functions.dom import parse, select

    n = 0
    for entry in select(parse(html), "div.thing"):
        marks = entry.attrs.get("class", "").split()
        if n >= most or "promoted" in marks or "promotedlink" in marks or entry.attrs.get("data-promoted") == "true":
            continue
        title = next(iter(select(entry, "a.title")), None)
        if title is None:
            continue
        text = lambda css: next((x.attrs.get("title") or x.text() for x in select(entry, css)), "")
        yield n, title.text(), urljoin(url, title.attrs.get("href", "")), entry.attrs.get("data-author") or text("a.author"), entry.attrs.get("data-score") or text("div.score"), text("a.comments")
        n += 1


def listing_markdown(html: str | None, url: str = "") -> str:
    """A listing as a numbered list."""
    return "\n".join(f"{i + 1}. [{t}]({u}) · {s or '0'} points · {a or 'unknown'} · {c or '0 comments'}" for i, t, u, a, s, c in listing(html, url))


def comment_tree(data: str | None) -> Iterator[tuple[int, int, str, str, str]]:
    """(ord, depth, id, author, body) of a comment tree in reading order."""
    try:
        todo = [(x, 0) for x in _items(json.loads(data or "null"))][::-1]
    except ValueError:
        return
    n = 0
    while todo:
        x, depth = todo.pop()
        d = x.get("data", x) if isinstance(x.get("data", x), dict) else x
        yield n, depth, str(d.get("id", "")), str(d.get("author", "")), str(d.get("body", ""))
        n += 1
        todo += [(c, depth + 1) for c in _items(d.get("replies"))][::-1]


def _items(value) -> list[dict]:
    if isinstance(value, dict):
        inner = value.get("data", value)
        return [x for x in inner.get("children", [value] if "body" in inner else []) if isinstance(x, dict)]
    return [x for y in value for x in (_items(y) or ([y] if isinstance(y, dict) and "kind" not in y else []))] if isinstance(value, list) else []


def relaxed_json(text: str):
    """JSON with comments and trailing commas; strings are left alone."""
    out, i, n = [], 0, len(text)
    while i < n:
        c = text[i]
        if c == '"':
            j = i + 1
            while j < n and text[j] != '"':
                j += 2 if text[j] == "\\" else 1
            out.append(text[i : j + 1])
            i = j + 1
        elif text.startswith("//", i):
            i = text.find("\n", i) if "\n" in text[i:] else n
        elif text.startswith("/*", i):
            end = text.find("*/", i)
            i = n if end < 0 else end + 2
        else:
            out.append(c)
            i += 1
    return json.loads(re.sub(r",(\s*[}\]])", r"\1", "".join(out)) if '"' not in "".join(out) else _no_trailing("".join(out)))


def _no_trailing(text: str) -> str:
    parts = re.split(r'("(?:\\.|[^"\\])*")', text)
    joined = "".join(p if k % 2 else p.replace(",", "\0") for k, p in enumerate(parts))
    return re.sub(r"\0(\s*[}\]])", r"\1", joined).replace("\0", ",")


def url_list(lines: DataFrame, column: str = "value") -> DataFrame:
    """(ord, url): urls of a text with one per line or one JSON array, the first of equal ones kept, in order."""
    t = F.trim(column)
    many = F.when(t.startswith("["), F.from_json(t, "array<string>")).otherwise(F.array(t))
    rows = lines.select(F.monotonically_increasing_id().alias("line"), F.posexplode(many).alias("at", "url")).filter((F.col("url") != "") & ~F.col("url").startswith("#"))
    return rows.groupBy("url").agg(F.min(F.struct("line", "at")).alias("ord")).select("ord", "url").orderBy("ord")


def map_response(body: Column, root: str, fields: dict[str, str], schema: str = "array<string>") -> Column:
    """Items of a JSON response: array of maps from field name to the value at its dotted path."""
    items = F.from_json(F.get_json_object(body, "$" if root in ("", "$") else f"$.{root}"), "array<string>")
    return F.transform(items, lambda x: F.map_from_arrays(F.array(*[F.lit(k) for k in fields]), F.array(*[F.get_json_object(x, f"$.{p}") for p in fields.values()])))


def register(spark: SparkSession) -> None:
    """Table functions for SQL: sitemap_urls(xml), feed_entries(xml, url), comments(json)."""
    from pyspark.sql.functions import udtf

    class Sitemap:
        def eval(self, data: str):
            yield from sitemap(data)

    class Feed:
        def eval(self, data: str, url: str):
            yield from feed(data, url or "")

    class Comments:
        def eval(self, data: str):
            yield from comment_tree(data)

    spark.udtf.register("sitemap_urls", udtf(Sitemap, returnType="url string, lastmod string, kind string, recovered boolean"))
    spark.udtf.register("feed_entries", udtf(Feed, returnType="id string, title string, link string, author string, published string"))
    spark.udtf.register("comments", udtf(Comments, returnType="ord int, depth int, id string, author string, body string"))


def two_segments(url: Column | str) -> Column:
    """Whether a url's path has exactly two segments, as item pages below an owner have."""
    path = F.regexp_extract(F.col(url) if isinstance(url, str) else url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    return F.size(F.filter(F.split(path, "/"), lambda x: x != "")) == 2


#: Sitemaps that one discovery opens.
MOST_SITEMAPS = 25


def discovered_sitemaps(documents: DataFrame, seeds: DataFrame, depth: int = 3, most: int = MOST_SITEMAPS) -> DataFrame:
    """(url, lastmod) of pages below seed sitemaps: stored documents (url, body) are opened level by level, each once.

    Only documents that a level names are parsed, and at most ``most`` in all, by name: the bound is the feature.
    """
    from weft.plans.staging import stage

    class Rows:
        def eval(self, data: str):
            yield from sitemap(data)

    read = F.udtf(Rows, returnType="url string, lastmod string, kind string, recovered boolean")
    front, out, left = stage(seeds.select("url").distinct().orderBy("url").limit(most), "front"), None, most
    opened = front
    for _ in range(depth + 1):
        n = front.count()
        left -= n
        if not n:
            break
        body = documents.join(front, "url", "left_semi").groupBy("url").agg(F.max("body").alias("body")).select(F.col("body").cast("string").alias("body"))
        found = stage(body.lateralJoin(read(F.col("body").outer())).select("url", "lastmod", "kind"), "sitemap-level")
        pages = found.filter("kind = 'page'").select("url", "lastmod")
        out = pages if out is None else out.unionByName(pages)
        front = stage(found.filter("kind = 'index'").select("url").distinct().join(opened, "url", "left_anti").orderBy("url").limit(max(left, 0)), "front")
        opened = opened.unionByName(front)
    if out is None:
        return documents.sparkSession.createDataFrame([], "url string, lastmod string")
    return out.groupBy("url").agg(F.max("lastmod").alias("lastmod"))


def discovered(host: str, *sources: DataFrame, contains: str = "") -> DataFrame:
    """(url, source) of several url relations: one host's, each page once by its first source, with a substring if asked."""
    from weft.functions import urls as U

    union = None
    for i, s in enumerate(sources):
        part = s.select("url", F.lit(i).alias("source"))
        union = part if union is None else union.unionByName(part)
    h = U.host("url", True)
    kept = union.filter(((h == host) | h.endswith("." + host)) & F.contains("url", F.lit(contains)))
    return kept.groupBy(U.crawl_key("url").alias("url")).agg(F.min("source").alias("source"))

"""Queries over urls: identities, filters, scores, classes."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weft.functions import urls as U
from weft.functions import classes as C
from weft.queries.base import CORE, sql_list
from weft.sources.tables import table

_SCHEME = r"lower(regexp_extract(trim(coalesce(url, '')), '^([A-Za-z][A-Za-z0-9+.\-]*)://', 1))"
_AUTH = r"regexp_extract(trim(coalesce(url, '')), '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1)"
#: The pieces of search_hits' (or another relation's) urls.
def parts_sql(relation: str, keep: str) -> str:
    return rf"""
    parts AS (
      SELECT {keep}, url, {_SCHEME} AS scheme, regexp_extract({_AUTH}, ':([0-9]+)$', 1) AS port,
             regexp_replace(lower(regexp_replace({_AUTH}, ':[0-9]*$', '')), '\.+$', '') AS h,
             regexp_extract(trim(coalesce(url, '')), '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1) AS path,
             regexp_extract(trim(coalesce(url, '')), '^[^?#]*\?([^#]*)', 1) AS query, {_AUTH} AS auth
      FROM {relation}),
    good AS (SELECT *, scheme IN ('http', 'https') AND h <> '' AND NOT contains(auth, '@') AS ok FROM parts)"""


def key_sql(tracking, root: str = "") -> str:
    names = f" AND lower(url_decode(split_part(x, '=', 1))) NOT IN {sql_list(tracking)}" if tracking else ""
    query = f"array_to_string(list_filter(string_split(query, '&'), lambda x: x <> '' AND NOT starts_with(lower(url_decode(split_part(x, '=', 1))), 'utm_'){names}), '&')"
    path = f"CASE WHEN path = '' THEN '{root}' ELSE path END"
    return rf"""CASE WHEN ok THEN scheme || '://' || h
      || CASE WHEN port <> '' AND NOT (scheme = 'http' AND CAST(port AS INT) = 80) AND NOT (scheme = 'https' AND CAST(port AS INT) = 443) THEN ':' || CAST(CAST(port AS INT) AS VARCHAR) ELSE '' END
      || CASE WHEN length({path}) > 1 THEN regexp_replace({path}, '/+$', '') ELSE {path} END
      || CASE WHEN {query} <> '' THEN '?' || {query} ELSE '' END ELSE '' END"""


def hits(spark, d):
    return table(spark, d, "search_hits")


@CORE.add("url_host", f"WITH {parts_sql('search_hits', 'hit_id')} SELECT hit_id, CASE WHEN ok THEN h ELSE '' END AS host, CASE WHEN ok THEN regexp_replace(h, '^www\\.', '') ELSE '' END AS domain FROM good")
def url_host(spark, d):
    return hits(spark, d).select("hit_id", U.host("url").alias("host"), U.host("url", True).alias("domain"))


@CORE.add("url_dedupe_key", f"WITH {parts_sql('search_hits', 'hit_id')} SELECT hit_id, {key_sql(())} AS key FROM good")
def url_dedupe_key(spark, d):
    return hits(spark, d).select("hit_id", U.dedupe_key("url").alias("key"))


@CORE.add("url_crawl_key", f"WITH {parts_sql('cache_entries', 'entry_id')} SELECT entry_id, {key_sql(U.CRAWL_TRACKING, '/')} AS key FROM good")
def url_crawl_key(spark, d):
    return table(spark, d, "cache_entries").select("entry_id", U.crawl_key("url").alias("key"))


@CORE.add("url_search_key", f"WITH {parts_sql('search_hits', 'hit_id')} SELECT hit_id, {key_sql(U.SEARCH_TRACKING)} AS key FROM good")
def url_search_key(spark, d):
    return hits(spark, d).select("hit_id", U.search_key("url").alias("key"))


_DEPTH = "len(list_filter(string_split(regexp_extract(url, '://[^/]*(/.*)$', 1), '/'), lambda x: x <> ''))"
_WORDS = ["docs", "guide", "listing", "archive"]
_YEARS = r"list_max(list_filter(list_transform(regexp_extract_all(url, '[/\-_]((?:19|20)\d{2})(?:[/\-_]\d{2}(?:[/\-_]\d{2})?)?', 1), lambda y: CAST(y AS INT)), lambda y: y <= 2024))"
_FRESH = f"CASE WHEN {_YEARS} IS NULL THEN 0.5 WHEN 2024 - {_YEARS} < 6 THEN 1.0 - 0.1 * (2024 - {_YEARS}) ELSE greatest(0.1, 1.0 - (2024 - {_YEARS}) * 0.1) END"
_TYPES = {".html$": 0.9, ".pdf$": 0.7, "/files/": 0.6, "/docs": 0.8}
_AUTHORITY = {"meshwright.example": 0.9, "blog.donmo.example": 0.7}
_EXT = r"lower(regexp_extract(url, '\.([A-Za-z0-9]*)[^.]*$', 1))"
_TYPE = f"CASE WHEN {_EXT} = 'html' THEN 0.9 WHEN {_EXT} = 'pdf' THEN 0.7 WHEN contains(url, '/docs') THEN 0.8 WHEN contains(url, '/files/') THEN 0.6 ELSE 0.0 END"
_DOMAIN = r"regexp_replace(regexp_extract(regexp_extract(lower(url), '://(.*)$', 1), '^([^/?#]*)', 1), ':[^:]*$', '')"
_AUTH_SCORE = f"CASE {_DOMAIN} WHEN 'meshwright.example' THEN 0.9 WHEN 'blog.donmo.example' THEN 0.7 ELSE 0.5 END"
_KEYWORD = "(" + " + ".join(f"CAST(contains(lower(url), '{w}') AS INT)" for w in _WORDS) + ") / 4.0"


@CORE.add(
    "url_scores",
    f"""SELECT hit_id, round(CAST({_KEYWORD} AS DOUBLE), 6) AS keyword, round(CAST(1.0 / (1.0 + abs({_DEPTH} - 3)) AS DOUBLE), 6) AS depth,
      round(CAST({_TYPE} AS DOUBLE), 6) AS type, round(CAST({_FRESH} AS DOUBLE), 6) AS freshness, round(CAST({_AUTH_SCORE} AS DOUBLE), 6) AS authority
    FROM search_hits""",
)
def url_scores(spark, d):
    return hits(spark, d).select(
        "hit_id", F.round(U.keyword_score("url", _WORDS), 6).alias("keyword"), F.round(U.depth_score("url"), 6).alias("depth"), F.round(U.type_score("url", _TYPES), 6).alias("type"),
        F.round(U.freshness_score("url"), 6).alias("freshness"), F.round(U.authority_score("url", _AUTHORITY), 6).alias("authority"),
    )


_COMPOSITE = f"round(CAST(({_KEYWORD} * 2.0 + 1.0 / (1.0 + abs({_DEPTH} - 3)) + ({_FRESH}) * 0.5) / 3.0 AS DOUBLE), 6)"


def scored_hits(spark, d):
    """(hit_id, host, score): narrow rows, each once."""
    score = F.round(U.composite([(U.keyword_score("url", _WORDS), 2.0), (U.depth_score("url"), 1.0), (U.freshness_score("url"), 0.5)]), 6)
    return hits(spark, d).select("hit_id", U.host("url").alias("host"), score.alias("score")).distinct()


@CORE.add(
    "url_top_per_host",
    f"""WITH {parts_sql('search_hits', 'hit_id')}, scored AS (SELECT hit_id, CASE WHEN ok THEN h ELSE '' END AS host, {_COMPOSITE} AS score FROM good GROUP BY ALL),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY score DESC, hit_id) AS rank FROM scored)
    SELECT host, hit_id, score, CAST(rank AS INT) AS rank FROM ranked WHERE rank <= 3""",
)
def url_top_per_host(spark, d):
    """Composite score, stable descending order, the best three of every host; rank filters run per partition before the shuffle."""
    return scored_hits(spark, d).withColumn("rank", F.row_number().over(Window.partitionBy("host").orderBy(F.desc("score"), "hit_id"))).filter("rank <= 3").select("host", "hit_id", "score", "rank")


_LINKPATH = "translate(lower(path), '/-_', '   ')"
_LINKWORDS = f"string_split_regex({_LINKPATH}, '\\s+')"
_TERMS = ["archive", "listing", "rural"]


@CORE.add(
    "link_score",
    f"""WITH {parts_sql('search_hits', 'hit_id, title')}
    SELECT hit_id, round(CAST(2.0 * ({' + '.join(f"CAST(contains(lower(coalesce(title, '')), '{t}') AS INT)" for t in _TERMS)}) / 3.0
      + ({' + '.join(f"CAST(contains({_LINKPATH}, '{t}') AS INT)" for t in _TERMS)}) / 3.0
      + 0.5 * len(list_filter({sql_list(U.CONTENT_WORDS).replace('(', '[').replace(')', ']')}, lambda w: list_contains({_LINKWORDS}, w)))
      - 1.0 * len(list_filter({sql_list(U.JUNK_WORDS).replace('(', '[').replace(')', ']')}, lambda w: list_contains({_LINKWORDS}, w))) AS DOUBLE), 6) AS score
    FROM good""",
)
def link_score(spark, d):
    return hits(spark, d).select("hit_id", F.round(U.link_score("url", "title", _TERMS), 6).alias("score"))


@CORE.add(
    "url_pattern_filter",
    rf"""WITH {parts_sql('search_hits', 'hit_id')} SELECT hit_id, url FROM good
    WHERE (regexp_matches(url, '(?is)^.*/arch.*$') OR contains(lower(url), 'listing') OR regexp_matches(url, 'note[s]?'))
      AND NOT contains(lower(url), 'page=2')""",
)
def url_pattern_filter(spark, d):
    return hits(spark, d).filter(U.pattern_filter("url", ["*/arch*", "listing", "re:note[s]?"], ["page=2"])).select("hit_id", "url")


@CORE.add(
    "url_domain_filter",
    f"""WITH {parts_sql('search_hits', 'hit_id')} SELECT hit_id, h AS host FROM good
    WHERE ok AND (h = 'example' OR ends_with(h, '.example')) AND NOT (h = 'meshwright.example' OR ends_with(h, '.meshwright.example'))""",
)
def url_domain_filter(spark, d):
    return hits(spark, d).filter(U.domain_filter("url", ["example"], ["meshwright.example"])).select("hit_id", U.host("url").alias("host"))


_HTML_EXT = sql_list(sorted(e for e, m in U.MIME.items() if "text/html" in m))


@CORE.add(
    "url_type_filter",
    rf"""WITH {parts_sql('cache_entries', 'entry_id, content_type')},
    named AS (SELECT *, split_part(path, '/', -1) AS name, lower(trim(split_part(coalesce(content_type, ''), ';', 1))) AS media FROM good)
    SELECT entry_id FROM named WHERE CASE WHEN coalesce(content_type, '') <> '' THEN contains(media, 'text/html') AND regexp_matches(media, '^[^/ ]+/[^/ ]+$')
      ELSE NOT contains(name, '.') OR lower(split_part(name, '.', -1)) IN {_HTML_EXT} END""",
)
def url_type_filter(spark, d):
    e = table(spark, d, "cache_entries")
    return e.filter(U.type_filter("url", ["text/html"], F.col("content_type"))).select("entry_id")


@CORE.add(
    "url_asset_skip",
    r"SELECT hit_id, regexp_matches(url, '(?i)\.(png|jpe?g|gif|webp|svg|css|js|ico|pdf|zip|mp[34]|woff2?|gz|tar|exe|dmg)(\?|$)') OR regexp_matches(lower(trim(url)), '^(javascript:|mailto:|tel:|data:|#)') AS skipped FROM search_hits",
)
def url_asset_skip(spark, d):
    return hits(spark, d).select("hit_id", U.is_asset("url").alias("skipped"))


@CORE.add("url_path_prefix", f"WITH {parts_sql('cache_entries', 'entry_id')} SELECT entry_id, path FROM good WHERE (starts_with(path, '/a') OR starts_with(path, '/b')) AND NOT starts_with(path, '/an')")
def url_path_prefix(spark, d):
    p = U.Parts("url").path
    return table(spark, d, "cache_entries").filter((p.startswith("/a") | p.startswith("/b")) & ~p.startswith("/an")).select("entry_id", p.alias("path"))


@CORE.add(
    "url_relevance_filter",
    """WITH terms AS (
      SELECT hit_id, regexp_extract_all(lower(coalesce(title, '') || ' ' || coalesce(title, '') || ' ' || coalesce(title, '') || ' ' || coalesce(snippet, '')), '[a-z0-9]+') AS t FROM search_hits WHERE coalesce(title, '') <> '' OR coalesce(snippet, '') <> ''),
    f AS (SELECT hit_id, len(t) AS n, len(list_filter(t, lambda x: x = 'archive')) AS a, len(list_filter(t, lambda x: x = 'mirror')) AS b FROM terms)
    SELECT hit_id, round(ln(2 / (a + 0.5) + 1) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * n / 1000.0)) + ln(2 / (b + 0.5) + 1) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * n / 1000.0)), 6) AS score
    FROM f WHERE ln(2 / (a + 0.5) + 1) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * n / 1000.0)) + ln(2 / (b + 0.5) + 1) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * n / 1000.0)) >= 0.5""",
)
def url_relevance_filter(spark, d):
    score = C.relevance(F.col("title"), F.col("snippet"), ["archive", "mirror"])
    kept = hits(spark, d).filter((F.coalesce("title", F.lit("")) != "") | (F.coalesce("snippet", F.lit("")) != "")).select("hit_id", score.alias("s")).filter("s >= 0.5")
    return kept.select("hit_id", F.round("s", 6).alias("score"))


def _domain_case(h: str, groups: list[tuple[str, tuple[str, ...]]]) -> str:
    return " ".join(f"WHEN {' OR '.join(f'''{h} = '{x}' OR ends_with({h}, '.{x}')''' for x in ds)} THEN '{name}'" for name, ds in groups)


@CORE.add(
    "url_source_type",
    rf"""WITH {parts_sql('search_hits', 'hit_id')}, b AS (SELECT hit_id, ok, regexp_replace(h, '^www\.', '') AS b, lower(path) AS p FROM good)
    SELECT hit_id, CASE WHEN NOT coalesce(ok, false) THEN 'other' {_domain_case('b', C.SOURCE_TYPES)}
      WHEN contains(p, '/docs/') OR contains(p, '/documentation/') OR contains(p, '/api/') THEN 'docs'
      WHEN contains(p, '/blog/') OR contains(p, '/post/') OR contains(p, '/article/') THEN 'blog'
      WHEN contains(p, '/forum/') OR contains(p, '/thread/') OR contains(p, '/discussion/') THEN 'forum' ELSE 'other' END AS source_type FROM b""",
)
def url_source_type(spark, d):
    return hits(spark, d).select("hit_id", C.source_type("url").alias("source_type"))


@CORE.add("url_source_counts", "WITH t AS (" + CORE.sql["url_source_type"] + ") SELECT source_type, count(*) AS hits FROM t GROUP BY source_type")
def url_source_counts(spark, d):
    """Hits by kind of source."""
    return url_source_type(spark, d).groupBy("source_type").agg(F.count(F.lit(1)).alias("hits"))


@CORE.add(
    "url_source_authority",
    rf"""WITH {parts_sql('cache_entries', 'entry_id')}
    SELECT entry_id, CASE WHEN NOT ok THEN 'unknown' WHEN ends_with(h, '.gov') OR h = 'gov' OR contains(h, '.gov.') THEN 'gov'
      WHEN ends_with(h, '.edu') OR regexp_matches(h, '\.ac\.[a-z]{{2}}$') THEN 'edu'
      WHEN h IN {sql_list(C.CODE_HOSTS)} OR ends_with(h, '.github.io') THEN 'github'
      WHEN starts_with(h, 'docs.') OR starts_with(h, 'developer.') OR starts_with(h, 'developers.') THEN 'docs-site'
      WHEN h IN {sql_list(C.QA_HOSTS)} OR ends_with(h, '.stackexchange.com') OR ends_with(h, '.stackoverflow.com') THEN 'qa'
      WHEN regexp_matches(h, 'forum|community|discourse|board') OR h = 'reddit.com' OR ends_with(h, '.reddit.com') THEN 'forum'
      WHEN starts_with(h, 'blog.') OR h IN ('medium.com', 'wordpress.com', 'substack.com') OR ends_with(h, '.substack.com') OR ends_with(h, '.medium.com') THEN 'blog'
      WHEN starts_with(h, 'shop.') OR starts_with(h, 'store.') OR h IN ('amazon.com', 'ebay.com') OR ends_with(h, '.shop') THEN 'ecommerce'
      WHEN {' OR '.join(f"h = '{x}' OR ends_with(h, '.{x}')" for x in C.NEWS_HOSTS)} THEN 'news' ELSE 'unknown' END AS source,
      coalesce(ok AND (ends_with(h, '.gov') OR h = 'gov' OR contains(h, '.gov.') OR ends_with(h, '.edu') OR regexp_matches(h, '\.ac\.[a-z]{{2}}$') OR h IN {sql_list(C.CODE_HOSTS)} OR ends_with(h, '.github.io')), false) AS official
    FROM good""",
)
def url_source_authority(spark, d):
    s = C.source_authority("url")
    return table(spark, d, "cache_entries").select("entry_id", s["source"].alias("source"), s["official"].alias("official"))


@CORE.add("media_bucket", r"""SELECT entry_id, lower(trim(split_part(coalesce(content_type, ''), ';', 1))) AS media,
      CASE WHEN trim(split_part(coalesce(content_type, ''), ';', 1)) = '' THEN 'unknown' WHEN lower(content_type) LIKE 'text/html%' THEN 'html' WHEN lower(content_type) LIKE 'application/json%' THEN 'json'
        WHEN lower(content_type) LIKE 'application/pdf%' THEN 'pdf' WHEN lower(content_type) LIKE 'image/%' THEN 'image' WHEN lower(content_type) LIKE 'text/%' THEN 'text' ELSE 'binary' END AS bucket,
      nullif(lower(regexp_extract(coalesce(content_type, ''), '(?i);\s*charset\s*=\s*["'']?([^;"''\s]+)', 1)), '') AS charset FROM cache_entries""")
def media_bucket(spark, d):
    return table(spark, d, "cache_entries").select("entry_id", U.media_type("content_type").alias("media"), U.media_bucket("content_type").alias("bucket"), U.charset("content_type").alias("charset"))


@CORE.add("url_same_domain", rf"WITH {parts_sql('search_hits', 'hit_id')} SELECT hit_id, coalesce(ok AND (h = 'donmo.example' OR ends_with(h, '.donmo.example')), false) AS same FROM good")
def url_same_domain(spark, d):
    return hits(spark, d).select("hit_id", U.same_domain("url", F.lit("https://donmo.example/"), subdomains=True).alias("same"))


@CORE.add("url_unwrap", "SELECT hit_id, url AS target FROM search_hits")
def url_unwrap(spark, d):
    """Every hit's url wrapped as a search engine's redirect, and unwrapped again."""
    kind = F.pmod("hit_id", F.lit(3))
    b64 = F.translate(F.regexp_replace(F.base64(F.encode("url", "utf-8")), r"[=\r\n]", ""), "+/", "-_")
    wrapped = (
        F.when(kind == 0, F.concat(F.lit("https://www.google.com/url?sa=t&q="), F.url_encode("url")))
        .when(kind == 1, F.concat(F.lit("https://r.search.yahoo.com/_ylt=A/RU="), F.url_encode("url"), F.lit("/RK=2/RS=x")))
        .otherwise(F.concat(F.lit("https://www.bing.com/ck/a?u=a1"), b64))
    )
    return hits(spark, d).select("hit_id", U.unwrap_result(wrapped).alias("target"))


@CORE.add("url_unsafe", """SELECT hit_id, CASE hit_id % 7 WHEN 0 THEN NULL WHEN 1 THEN 'scheme' WHEN 2 THEN 'credentials' WHEN 3 THEN 'private' WHEN 4 THEN 'metadata' WHEN 5 THEN 'rebinding' ELSE 'malformed' END AS reason
    FROM search_hits WHERE regexp_matches(url, '^https?://[a-z]')""")
def url_unsafe(spark, d):
    """Every hit's address, and what an attacker may make of it."""
    from weft.functions import safety

    rest = F.regexp_replace("url", r"^[A-Za-z]+://", "")
    below = F.regexp_replace(rest, r"^[^/?#]*", "")
    made = (
        F.when(F.col("hit_id") % 7 == 0, F.col("url")).when(F.col("hit_id") % 7 == 1, F.concat(F.lit("ftp://"), rest)).when(F.col("hit_id") % 7 == 2, F.concat(F.lit("https://user:pass@"), rest))
        .when(F.col("hit_id") % 7 == 3, F.concat(F.lit("http://10."), F.pmod("hit_id", F.lit(256)).cast("string"), F.lit(".0.1"), below)).when(F.col("hit_id") % 7 == 4, F.concat(F.lit("http://169.254.169.254"), below))
        .when(F.col("hit_id") % 7 == 5, F.concat(F.lit("https://10.0.0.1.nip.io"), below)).otherwise(F.concat(F.lit("https://a.example:99999"), below))
    )
    return hits(spark, d).filter(F.col("url").rlike("^https?://[a-z]")).select("hit_id", safety.unsafe(made).alias("reason"))


@CORE.add("url_score_stats", f"""WITH {parts_sql('search_hits', 'hit_id')}, s AS (SELECT hit_id, CASE WHEN ok THEN h ELSE '' END AS host, {_COMPOSITE} AS score FROM good GROUP BY ALL)
    SELECT host, count(*) AS n, CAST(sum(CAST(round(score * 1000000) AS BIGINT)) AS DOUBLE) / (count(*) * 1000000.0::DOUBLE) AS mean, min(score) AS least, max(score) AS most FROM s GROUP BY host""")
def url_score_stats(spark, d):
    """Count, mean, least and greatest score of every host."""
    s = scored_hits(spark, d)
    return s.groupBy("host").agg(F.count(F.lit(1)).alias("n"), (F.sum(F.round(F.col("score") * 1_000_000).cast("long")).cast("double") / (F.count(F.lit(1)) * F.lit(1_000_000.0))).alias("mean"), F.min("score").alias("least"), F.max("score").alias("most"))


@CORE.add("url_two_segments", rf"WITH {parts_sql('search_hits', 'hit_id')} SELECT hit_id, len(list_filter(string_split(path, '/'), lambda x: x <> '')) = 2 AS item FROM good")
def url_two_segments(spark, d):
    from weft.sources import web

    return hits(spark, d).select("hit_id", web.two_segments("url").alias("item"))

"""Queries over texts: tokens, blocks, focus, chunks, cleaning, dates, pages of scans."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.functions import text as T
from weft.queries.base import CORE, sql_list
from weft.sources.tables import cache_text, latest_delivery, table

_STOP = sql_list(T.FOCUS_STOPWORDS)
_TEXT = "array_to_string(CAST(json(content) AS VARCHAR[]), chr(10))"


def _tok(x: str) -> str:
    return f"list_filter(regexp_extract_all(lower(coalesce({x}, '')), '[a-z0-9]+'), lambda t: length(t) >= 2 AND t NOT IN {_STOP})"


def docs(spark, d):
    return table(spark, d, "documents")


def entries(spark, d):
    last = latest_delivery(table(spark, d, "cache_entries").select("entry_id", "content", "stored_at"), "entry_id", "stored_at")
    return last.select("entry_id", cache_text().alias("text"))


def scans(spark, d):
    return latest_delivery(table(spark, d, "pdf_results"), "pdf_id", "loaded_at")


_ENTRIES = f"entries AS (SELECT DISTINCT entry_id, {_TEXT} AS text FROM cache_entries)"


@CORE.add("text_tokens", f"SELECT doc_id, CAST(len({_tok('text')}) AS INT) AS n, CAST(len(list_distinct({_tok('text')})) AS INT) AS kinds FROM documents")
def text_tokens(spark, d):
    t = docs(spark, d).select("doc_id", T.tokens("text").alias("t"))
    return t.select("doc_id", F.size("t").alias("n"), F.size(F.array_distinct("t")).alias("kinds"))


@CORE.add("text_term_counts", f"WITH t AS (SELECT unnest({_tok('text')}) AS term FROM documents) SELECT term, count(*) AS n FROM t GROUP BY term")
def text_term_counts(spark, d):
    return docs(spark, d).select(F.explode(T.tokens("text")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


_BLOCKS = rf"""split AS (SELECT entry_id, list_filter(list_transform(string_split_regex(regexp_replace(text, '^(?:[ \t\r\f]*\n)+', ''), '\n(?:[ \t\r\f]*\n)+'), lambda b: regexp_replace(b, '\n[ \t\r\f]*$', '')), lambda b: trim(translate(b, chr(9) || chr(13) || chr(12) || chr(10), '')) <> '') AS bs FROM entries),
    blocks AS (SELECT entry_id, unnest(bs) AS block, CAST(unnest(range(len(bs))) AS INT) AS ix, len(bs) AS n FROM split),
    lined AS (SELECT *, ltrim(split_part(block, chr(10), 1), ' ' || chr(9)) AS first, list_filter(string_split(block, chr(10)), lambda l: trim(l) <> '') AS ls FROM blocks),
    kinds AS (SELECT *, starts_with(first, '#') AS heading, CASE WHEN starts_with(first, '#') THEN CAST(length(substring(first, 1, 6)) - length(replace(substring(first, 1, 6), '#', '')) AS INT) ELSE 0 END AS level,
      len(ls) >= 2 AND len(list_filter(ls, lambda l: contains(l, '|'))) >= len(ls) * 0.5 AS tab,
      starts_with(ltrim(block, ' ' || chr(9) || chr(10)), '```') OR (len(ls) >= 2 AND len(list_filter(ls, lambda l: starts_with(l, '    ') OR starts_with(l, chr(9)))) >= len(ls) * 0.8) AS code FROM lined)"""


@CORE.add("text_blocks", f"WITH {_ENTRIES}, {_BLOCKS} SELECT entry_id, ix, heading, level, tab AS is_table, code AS is_code, CAST(length(block) AS INT) AS chars FROM kinds")
def text_blocks(spark, d):
    b = entries(spark, d).select("entry_id", F.posexplode(T.blocks("text")).alias("ix", "block"))
    k = T.block_kind(F.col("block"))
    return b.select("entry_id", "ix", k["heading"].alias("heading"), k["level"].alias("level"), k["table"].alias("is_table"), k["code"].alias("is_code"), F.length("block").alias("chars"))


_FOCUS = ["archive", "mirror", "response", "policy"]
_FQ = "['archive', 'mirror', 'policy', 'response']"


@CORE.add(
    "text_focus",
    f"""WITH {_ENTRIES}, {_BLOCKS},
    tok AS (SELECT *, {_tok('block')} AS t FROM kinds WHERE n > 1),
    doc AS (SELECT entry_id, sum(len(t)) / count(*) AS avg, count(*) AS nb FROM tok GROUP BY entry_id),
    tf AS (SELECT entry_id, ix, q, len(list_filter(t, lambda x: x = q)) AS f, len(t) AS dl FROM tok, (SELECT unnest({_FQ}) AS q)),
    df AS (SELECT entry_id, q, sum(CASE WHEN f > 0 THEN 1 ELSE 0 END) AS df FROM tf GROUP BY ALL),
    base AS (SELECT entry_id, ix, sum(CASE WHEN f > 0 THEN ln((nb - df + 0.5) / (df + 0.5) + 1) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * dl / CASE WHEN avg = 0 THEN 1 ELSE avg END)) ELSE 0 END) AS s, bool_or(f > 0) AS met
      FROM tf JOIN df USING (entry_id, q) JOIN doc USING (entry_id) GROUP BY ALL),
    b AS (SELECT k.entry_id, k.ix, k.heading, k.level, k.tab OR k.code AS keepable, base.s, base.met FROM tok k JOIN base USING (entry_id, ix)),
    cover AS (SELECT j.entry_id, j.ix, count(*) AS c FROM b j JOIN b h ON h.entry_id = j.entry_id AND h.ix <= j.ix AND h.heading AND h.met
      WHERE NOT EXISTS (SELECT 1 FROM b k WHERE k.entry_id = j.entry_id AND k.ix > h.ix AND k.ix <= j.ix AND k.heading AND k.level <= h.level) GROUP BY ALL),
    scored AS (SELECT b.*, b.s * pow(1.5, coalesce(c, 0)) AS score, coalesce(c, 0) > 0 AS section FROM b LEFT JOIN cover USING (entry_id, ix)),
    flagged AS (SELECT *, score >= 1.0 OR section OR (met AND keepable) AS k0, row_number() OVER (PARTITION BY entry_id ORDER BY score DESC, ix) AS r FROM scored),
    chosen AS (SELECT *, CASE WHEN bool_or(k0) OVER (PARTITION BY entry_id) THEN k0 ELSE r <= 5 END AS k1 FROM flagged)
    SELECT entry_id, ix, round(score, 6) AS score, k1 OR coalesce(heading AND lead(k1 AND NOT heading) OVER (PARTITION BY entry_id ORDER BY ix), false) AS kept FROM chosen""",
)
def text_focus(spark, d):
    f = entries(spark, d).select("entry_id", F.inline(T.focus("text", _FOCUS)))
    return f.select("entry_id", "ix", "score", "kept")


@CORE.add("text_focus_text")
def text_focus_text(spark, d):
    """The focused text of every entry, as a reader gets it; texts of one block come whole."""
    rows = entries(spark, d).select("entry_id", "text", T.focus("text", _FOCUS).alias("f"))
    kept = F.filter("f", lambda x: x["kept"])
    joined = F.array_join(F.transform(kept, lambda x: x["block"]), "\n\n")
    head = F.concat(F.lit("[Focus: showing "), F.size(kept), F.lit(" of "), F.size("f"), F.lit(" blocks]\n\n"))
    return rows.select("entry_id", F.when(F.size("f") > 0, F.concat(head, joined)).otherwise(F.col("text")).alias("text"))


@CORE.add("text_chunks_regex", r"""WITH c AS (SELECT doc_id, list_filter(list_transform(flatten(list_transform(string_split_regex(coalesce(text, ''), '\n\n'), lambda x: string_split_regex(x, '; '))), lambda x: trim(regexp_replace(x, '^\s+|\s+$', '', 'g'))), lambda x: x <> '') AS c FROM documents)
    SELECT doc_id, CAST(unnest(range(len(c))) AS INT) AS ix, CAST(length(unnest(c)) AS INT) AS chars FROM c""")
def text_chunks_regex(spark, d):
    return docs(spark, d).select("doc_id", F.posexplode(T.regex_chunks("text", [r"\n\n", "; "])).alias("ix", "c")).select("doc_id", "ix", F.length("c").alias("chars"))


@CORE.add("text_sentences", r"""WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS s FROM documents)
    SELECT doc_id, CAST(len(s) AS INT) AS n, CAST(coalesce(list_max(list_transform(s, lambda x: length(x))), 0) AS INT) AS longest FROM s""")
def text_sentences(spark, d):
    s = docs(spark, d).select("doc_id", T.sentences("text").alias("s"))
    return s.select("doc_id", F.size("s").alias("n"), F.coalesce(F.array_max(F.transform("s", lambda x: F.length(x))), F.lit(0)).alias("longest"))


@CORE.add("text_chunks_semantic")
def text_chunks_semantic(spark, d):
    return docs(spark, d).filter("text is not null").select("doc_id", F.posexplode(T.semantic_chunks(120, 20)("text")).alias("ix", "chunk"))


@CORE.add(
    "text_collapse_counts",
    rf"""WITH {_ENTRIES}, longer AS (SELECT entry_id, text || repeat(chr(10) || regexp_extract(text, '^[^
]{{0,30}}') || chr(10) || ' Menu ', 6) AS text FROM entries),
    long AS (SELECT entry_id, string_split(text, chr(10)) AS ls FROM longer WHERE length(text) >= 2000 AND len(string_split(text, chr(10))) >= 20),
    l AS (SELECT entry_id, regexp_replace(unnest(ls), '^\s+|\s+$', '', 'g') AS s FROM long)
    SELECT entry_id, s AS line, count(*) AS n FROM l WHERE s <> '' AND length(s) <= 30 GROUP BY ALL HAVING count(*) > 5""",
)
def text_collapse_counts(spark, d):
    """Short lines that come more than five times in a text; each text gets a menu and its own first words six times."""
    menu = F.concat(F.lit("\n"), F.regexp_extract("text", r"^[^\n]{0,30}", 0), F.lit("\n Menu "))
    longer = entries(spark, d).withColumn("text", F.concat("text", F.repeat(menu, F.lit(6))))
    lines = longer.filter((F.length("text") >= 2000) & (F.size(F.split("text", "\n", -1)) >= 20)).select("entry_id", F.explode(F.split("text", "\n", -1)).alias("l"))
    s = lines.select("entry_id", F.regexp_replace("l", r"^\s+|\s+$", "").alias("line")).filter((F.col("line") != "") & (F.length("line") <= 30))
    return s.groupBy("entry_id", "line").agg(F.count(F.lit(1)).alias("n")).filter("n > 5")


@CORE.add("text_collapsed")
def text_collapsed(spark, d):
    return entries(spark, d).select("entry_id", T.collapse_lines("text").alias("text"))


@CORE.add("text_visible", r"""WITH p AS (SELECT hit_id, '<div><script>var a = 1;</script><style>b{}</style><p class="x">' || coalesce(snippet, '') || '</p></div>' AS h FROM search_hits)
    SELECT hit_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(h, '(?is)<script\b[^>]*>.*?</script>', ' ', 'g'), '(?is)<style\b[^>]*>.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM p""")
def text_visible(spark, d):
    html = F.concat(F.lit('<div><script>var a = 1;</script><style>b{}</style><p class="x">'), F.coalesce("snippet", F.lit("")), F.lit("</p></div>"))
    return table(spark, d, "search_hits").select("hit_id", T.visible_text(html).alias("text"))


@CORE.add("text_safe_links", rf"""WITH {_ENTRIES} SELECT entry_id, md5(regexp_replace(text || '[x](javascript:alert(1)) ![y](data:image/png)', '(?i)(!?\[[^\n\]]*\]\()\s*(?:javascript|vbscript|file|data):[^)\n]*\)', '\1#)', 'g')) AS digest FROM entries""")
def text_safe_links(spark, d):
    t = F.concat("text", F.lit("[x](javascript:alert(1)) ![y](data:image/png)"))
    return entries(spark, d).select("entry_id", F.md5(T.safe_links(t)).alias("digest"))


@CORE.add("text_redact", r"""SELECT hit_id, regexp_replace(regexp_replace('key sk-' || repeat('a', 24) || ' at ' || replace(url, '://', '://me:secret@'), '(?:sk|pk|api_key)[-_][a-zA-Z0-9]{20,}', '[API_KEY_REDACTED]', 'g'), '((?:https?|socks5h?)://)[^:@\s/]+:[^@\s/]+@', '\1[CREDENTIALS_REDACTED]@', 'g') AS redacted,
      regexp_replace(url, '(?s)[?#].*$', '') AS for_log FROM search_hits""")
def text_redact(spark, d):
    t = F.concat(F.lit("key sk-" + "a" * 24 + " at "), F.replace("url", F.lit("://"), F.lit("://me:secret@")))
    return table(spark, d, "search_hits").select("hit_id", T.redact(t).alias("redacted"), T.redact_url("url").alias("for_log"))


@CORE.add("text_clean_query", r"SELECT query_id, nullif(regexp_replace(regexp_replace(coalesce(query_text, ''), '^\s+|\s+$', '', 'g'), '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g'), '') AS query FROM search_queries")
def text_clean_query(spark, d):
    return table(spark, d, "search_queries").select("query_id", T.clean_query("query_text").alias("query"))


@CORE.add("text_human_size", "SELECT entry_id, CASE WHEN coalesce(total_size_bytes, 0) >= 1048576 THEN printf('%.1fMB', total_size_bytes / 1024.0 / 1024.0) WHEN coalesce(total_size_bytes, 0) >= 1024 THEN printf('%.1fKB', total_size_bytes / 1024.0) ELSE coalesce(total_size_bytes, 0) || 'B' END AS size FROM cache_entries")
def text_human_size(spark, d):
    return table(spark, d, "cache_entries").select("entry_id", T.human_size("total_size_bytes").alias("size"))


@CORE.add("text_jaccard", f"""WITH t AS (SELECT hit_id, list_distinct({_tok('title')}) AS a, list_distinct({_tok('snippet')}) AS b FROM search_hits)
    SELECT hit_id, round(CASE WHEN len(a) + len(b) = 0 THEN 0.0 ELSE len(list_intersect(a, b)) / CAST(len(list_distinct(list_concat(a, b))) AS DOUBLE) END, 6) AS similarity FROM t""")
def text_jaccard(spark, d):
    h = table(spark, d, "search_hits").select("hit_id", T.tokens("title").alias("a"), T.tokens("snippet").alias("b"))
    return h.select("hit_id", F.round(T.jaccard(F.col("a"), F.col("b")), 6).alias("similarity"))


@CORE.add("text_paging", f"""WITH {_ENTRIES} SELECT entry_id, CAST(length(text) AS INT) AS total, length(text) - 1500 > 500 AS truncated, CASE WHEN length(text) - 1500 > 500 THEN 1500 ELSE 0 END AS next_offset,
      CAST(CASE WHEN length(text) - 1500 > 500 THEN 1500 ELSE length(text) END AS INT) AS chars FROM entries""")
def text_paging(spark, d):
    p = T.page_of("text", 1500)
    return entries(spark, d).select("entry_id", p["total"].alias("total"), p["truncated"].alias("truncated"), p["next_offset"].alias("next_offset"), F.length(p["piece"]).alias("chars"))


_PDF = "SELECT pdf_id, any_value(content) AS content, any_value(pages_total) AS pages_total, any_value(quality_score) AS quality_score FROM pdf_results GROUP BY pdf_id"


@CORE.add("pdf_readable", f"""WITH p AS ({_PDF}), g AS (SELECT pdf_id, unnest(content) AS page, unnest(range(1, len(content) + 1)) AS page_no FROM p)
    SELECT pdf_id, CAST(page_no AS INT) AS page_no, round(CASE WHEN length(page) > 0 THEN (length(page || '(cid:7)') - length(regexp_replace(page || '(cid:7)', '\\(cid:\\d+\\)', '', 'g'))) / CAST(length(page || '(cid:7)') AS DOUBLE) ELSE 0.0 END, 6) AS cid FROM g WHERE page IS NOT NULL AND length(page) > 0""")
def pdf_readable(spark, d):
    g = scans(spark, d).select("pdf_id", F.posexplode("content").alias("i", "page")).filter(F.length("page") > 0)
    return g.select("pdf_id", (F.col("i") + 1).alias("page_no"), F.round(T.cid_ratio(F.concat("page", F.lit("(cid:7)"))), 6).alias("cid"))


@CORE.add("pdf_pages_spec", f"""WITH p AS ({_PDF}), s AS (SELECT pdf_id, list_sort(list_filter(list_distinct(list_concat(range(1, 4), [5])), lambda x: x <= coalesce(pages_total, 0) AND x >= 1)) AS l FROM p)
    SELECT pdf_id, array_to_string(l, ',') AS pages FROM s""")
def pdf_pages_spec(spark, d):
    p = scans(spark, d)
    return p.select("pdf_id", F.array_join(T.page_list(F.lit("3-1, 5, x"), F.coalesce("pages_total", F.lit(0))).cast("array<string>"), ",").alias("pages"))


@CORE.add("pdf_weighted_quality", f"""WITH p AS ({_PDF}), n AS (SELECT pdf_id, quality_score AS q, list_sum(list_transform(content, lambda x: length(coalesce(x, '')))) AS n, len(content) AS pages FROM p)
    SELECT CAST(pages AS INT) AS pages, count(*) AS docs, round(sum(q * n) / sum(n), 6) AS quality FROM n WHERE q IS NOT NULL AND n > 0 GROUP BY pages""")
def pdf_weighted_quality(spark, d):
    p = scans(spark, d)
    n = p.select(F.col("quality_score").alias("q"), F.aggregate("content", F.lit(0), lambda a, x: a + F.length(F.coalesce(x, F.lit("")))).alias("n"), F.size("content").alias("pages"))
    return n.filter("q is not null and n > 0").groupBy("pages").agg(F.count(F.lit(1)).alias("docs"), F.round(F.sum(F.col("q") * F.col("n")) / F.sum("n"), 6).alias("quality"))


@CORE.add("pdf_dehyphenated")
def pdf_dehyphenated(spark, d):
    p = scans(spark, d).select("pdf_id", F.posexplode("content").alias("page", "text"))
    b = p.select("pdf_id", "page", F.posexplode(T.blocks("text")).alias("ix", "block"))
    return b.select("pdf_id", "page", "ix", T.dehyphenate(F.split("block", "\n")).alias("text"))


@CORE.add("text_captions", """WITH c AS (SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_replace(l, '^\\s+|\\s+$', '', 'g')), lambda l: l <> '' AND NOT regexp_matches(l, '^\\d+$') AND l <> 'WEBVTT' AND NOT starts_with(l, 'NOTE')) AS l FROM documents),
    t AS (SELECT doc_id, list_filter(list_transform(l, lambda x: regexp_replace(x, '<[^>]+>', '', 'g')), lambda x: x <> '') AS l FROM c)
    SELECT doc_id, CAST(len(list_distinct(l)) AS INT) AS lines FROM t""")
def text_captions(spark, d):
    timed = F.concat(F.lit("WEBVTT\n\n1\n00:00:01.000 --> 00:00:02.000\n"), F.coalesce("text", F.lit("")))
    c = T.captions(timed)
    return docs(spark, d).select("doc_id", F.when(c == "", 0).otherwise(F.size(F.split(c, "\n"))).alias("lines"))


@CORE.add("text_page_age", """WITH e AS (SELECT DISTINCT entry_id, fetched_at, regexp_extract(array_to_string(CAST(json(content) AS VARCHAR[]), chr(10)), '\\b(20\\d{2}-\\d{2}-\\d{2})\\b', 1) AS s FROM cache_entries),
    d AS (SELECT entry_id, TRY_CAST(nullif(s, '') AS DATE) AS d, CAST(fetched_at AS DATE) AS f FROM e)
    SELECT entry_id, CAST(CASE WHEN d IS NOT NULL AND f >= d THEN date_diff('day', d, f) ELSE -1 END AS INT) AS age_days, coalesce(d IS NOT NULL AND date_diff('day', d, f) > 365, false) AS stale FROM d""")
def text_page_age(spark, d):
    e = table(spark, d, "cache_entries").select("entry_id", "fetched_at", F.regexp_extract(cache_text(), r"\b(20\d{2}-\d{2}-\d{2})\b", 1).alias("s")).distinct()
    a = T.age(T.parse_date("s"), F.to_date("fetched_at"))
    return e.select("entry_id", a["age_days"].alias("age_days"), a["stale"].alias("stale"))

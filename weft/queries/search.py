"""Queries over search hits: fusion, ranking, tiers, intents, related queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weft.functions import classes as C
from weft.operators import search as S
from weft.queries.base import CORE, sql_list
from weft.queries.urls import key_sql, parts_sql
from weft.functions.urls import NO_OWNERS, SEARCH_TRACKING  # noqa: F401
from weft.sources.tables import table


def _any(text: str, marks) -> str:
    return "(" + " OR ".join(f"contains({text}, '{m}')".replace("\t", "' || chr(9) || '") for m in marks) + ")"


def _in(h: str, domains) -> str:
    return "(" + " OR ".join(f"{h} = '{d}' OR ends_with({h}, '.{d}')" for d in domains) + ")"


_FAMILY = "CASE engine " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in S.FAMILIES.items()) + " ELSE engine END"
_STOP = sql_list(C.STOPWORDS)
_TERMS = f"list_filter(list_distinct(regexp_extract_all(lower(coalesce(query_text, '')), '[a-z][a-z0-9''+-]{{2,}}')), lambda w: w NOT IN {_STOP})"
_TECH = _any("lower(coalesce(query_text, ''))", C.TECH_SIGNALS)
_Q, _SN = "lower(coalesce(query_text, ''))", "lower(snippet)"
_ANSWER = f"""least(CASE WHEN ({_TECH} OR {_any(_Q, C.NUMBER_WORDS)}) AND regexp_matches(snippet, '\\d{{3,}}') THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END
  + CASE WHEN {_any(_Q, ('table', 'comparison'))} AND {_any(_SN, C.TABLE_MARKS)} THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END
  + CASE WHEN {_any(_Q, C.COMPARE_WORDS)} AND {_any(_SN, C.COMPARE_MARKS)} THEN 0.10::DOUBLE ELSE 0.0::DOUBLE END
  + CASE WHEN {_any(_Q, C.CODE_WORDS)} AND {_any(_SN, C.CODE_MARKS)} THEN 0.10::DOUBLE ELSE 0.0::DOUBLE END, 0.30::DOUBLE)"""
_MERGE = """list_reduce(list_prepend('', list_transform(list_sort(list({'a': arrival, 'i': hit_id, 'b': trim(coalesce(snippet, ''))})), lambda x: x.b)),
  lambda t, b: CASE WHEN b = '' OR contains(t, b) OR length(t) >= 600 THEN t WHEN t = '' THEN b ELSE substring(trim(t || ' ' || b), 1, 600) END)"""


def _share(text: str, most: str) -> str:
    return f"CASE WHEN len(terms) > 0 THEN CAST(len(list_filter(terms, lambda w: contains({text}, w))) AS DOUBLE) / len(terms) * {most}::DOUBLE ELSE 0.0 END"


_MERGED = f"""once AS (SELECT DISTINCT ON (hit_id) * FROM search_hits ORDER BY hit_id),
    {parts_sql('once', 'hit_id, query_id, engine, arrival, title, snippet, position, relevance_score')},
    keyed AS (SELECT *, {key_sql(SEARCH_TRACKING)} AS key FROM good),
    merged AS (
      SELECT query_id, key, arg_min(title, (arrival, hit_id)) AS title, arg_min(url, (arrival, hit_id)) AS url, min(arrival) AS arrival,
        CAST(count(DISTINCT {_FAMILY}) AS INT) AS consensus, array_to_string(list_sort(list_distinct(list(engine))), ',') AS sources,
        min(coalesce(position, 1000)) AS position, max(coalesce(relevance_score, 0.0)) AS base, {_MERGE} AS snippet
      FROM keyed WHERE key <> '' AND coalesce(title, '') <> '' GROUP BY query_id, key)"""
_RANKED = rf"""WITH {_MERGED},
    joined AS (SELECT merged.*, query_text, {_TERMS} AS terms, {_TECH} AS technical, regexp_replace(regexp_extract(key, '^https?://([^/:?]*)', 1), '^www\.', '') AS domain,
        lower(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1)) AS lpath
      FROM merged JOIN (SELECT DISTINCT ON (query_id) query_id, query_text FROM search_queries) USING (query_id)),
    signals AS (SELECT *, CASE WHEN technical AND {_in('domain', C.TECH_DOMAINS)} THEN 0.15::DOUBLE WHEN {_in('domain', C.REFERENCE_DOMAINS)} THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END AS domain_boost, {_ANSWER} AS answer FROM joined),
    raw AS (SELECT *, round(base + 0.2::DOUBLE * (greatest(consensus, 1) - 1) + domain_boost + answer + {_share('lower(title)', '0.10')} + {_share('lpath', '0.08')}, 6) AS raw FROM signals),
    scored AS (SELECT *, CAST(count(*) OVER (PARTITION BY query_id) AS INT) AS total,
        round(CASE WHEN max(raw) OVER (PARTITION BY query_id) > 1.0 THEN raw / max(raw) OVER (PARTITION BY query_id) ELSE raw END, 6) AS score FROM raw),
    placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, consensus DESC, position, arrival, key) AS place FROM scored),
    counted AS (SELECT *, row_number() OVER (PARTITION BY query_id, domain ORDER BY place) AS nth FROM placed),
    final AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN nth > 2 THEN 1 ELSE 0 END, place) AS INT) AS rank FROM counted),
    tiered AS (SELECT *, CASE WHEN score >= 0.5 OR rank = 1 THEN 'high' WHEN (consensus >= 3 OR domain_boost > 0 OR answer >= 0.15) AND score >= 0.25 THEN 'high'
        WHEN score >= 0.15 THEN 'med' WHEN rank <= greatest(2, total // 3) THEN 'med' ELSE 'low' END AS tier FROM final)"""


def _tables(spark, d):
    return table(spark, d, "search_hits"), table(spark, d, "search_queries")


@CORE.add("search_merged", f"WITH {_MERGED} SELECT query_id, key, title, consensus, sources, position, snippet FROM merged")
def search_merged(spark, d):
    return S.merged(_tables(spark, d)[0]).select("query_id", "key", "title", "consensus", "sources", "position", "snippet")


@CORE.add("search_boosted", f"{_RANKED} SELECT query_id, key, score, domain_boost, answer, total FROM tiered")
def search_boosted(spark, d):
    h, q = _tables(spark, d)
    return S.boosted(S.merged(h), q).select("query_id", "key", "score", "domain_boost", "answer", "total")


@CORE.add("search_ranked", f"{_RANKED} SELECT query_id, key, title, score, rank, tier FROM tiered")
def search_ranked(spark, d):
    return S.ranked(*_tables(spark, d)).select("query_id", "key", "title", "score", "rank", "tier")


@CORE.add("search_diversified", f"{_RANKED} SELECT query_id, key, domain, CAST(place AS INT) AS place, CAST(nth AS INT) AS nth, rank FROM tiered")
def search_diversified(spark, d):
    return S.ranked(*_tables(spark, d)).select("query_id", "key", "domain", "place", "nth", "rank")


@CORE.add("search_tier_counts", f"""{_RANKED}, c AS (SELECT query_id, CAST(sum(CASE WHEN tier = 'high' THEN 1 ELSE 0 END) AS BIGINT) AS high, CAST(sum(CASE WHEN tier = 'med' THEN 1 ELSE 0 END) AS BIGINT) AS med,
      CAST(sum(CASE WHEN tier = 'low' THEN 1 ELSE 0 END) AS BIGINT) AS low FROM tiered GROUP BY query_id)
    SELECT *, CASE WHEN high >= 3 THEN 'fetch 1-2' WHEN high >= 1 THEN 'fetch 1, maybe 2' WHEN med >= 2 THEN 'fetch 1-2, rephrase if thin' ELSE 'fetch 1, rephrase if thin' END AS advice FROM c""")
def search_tier_counts(spark, d):
    return S.tier_counts(S.ranked(*_tables(spark, d)))


@CORE.add("search_quality_filtered", f"""{_RANKED}, g AS (SELECT *, sum(CASE WHEN tier <> 'low' THEN 1 ELSE 0 END) OVER (PARTITION BY query_id) AS good FROM tiered)
    SELECT query_id, key, tier, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank) AS INT) AS index FROM g WHERE total <= 3 OR good < 3 OR tier <> 'low'""")
def search_quality_filtered(spark, d):
    return S.quality_filtered(S.ranked(*_tables(spark, d))).select("query_id", "key", "tier", "index")


@CORE.add("search_results_page", f"{_RANKED} SELECT query_id, key, rank FROM tiered WHERE rank <= 6")
def search_results_page(spark, d):
    """The six results that a request shows: a limit that is the feature."""
    return S.ranked(*_tables(spark, d)).filter("rank <= 6").select("query_id", "key", "rank")


_BIGRAMS = f"""words AS (SELECT query_id, key, list_filter(regexp_extract_all(lower(title || ' ' || snippet), '[a-z][a-z0-9''+-]{{2,}}'), lambda w: w NOT IN {_STOP}) AS w FROM merged),
    pairs AS (SELECT query_id, key, unnest(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS bigram FROM words WHERE len(w) > 1),
    counted AS (SELECT query_id, bigram, count(*) AS pages FROM pairs GROUP BY ALL HAVING count(*) >= 3)"""


@CORE.add(
    "search_related",
    f"""WITH {_MERGED}, {_BIGRAMS}, q AS (SELECT DISTINCT ON (query_id) query_id, lower(coalesce(query_text, '')) AS q, {_TERMS} AS terms FROM search_queries)
    SELECT query_id, bigram, pages FROM counted JOIN q USING (query_id)
    WHERE len(list_filter(string_split(bigram, ' '), lambda w: NOT list_contains(terms, w))) > 0 AND NOT contains(q, bigram) AND NOT contains(bigram, q)""",
)
def search_related(spark, d):
    h, q = _tables(spark, d)
    return S.related_bigrams(S.merged(h), q)


def _intent_sql(q: str) -> str:
    cases = " ".join(f"WHEN regexp_matches({q}, '{p}') THEN '{n}'" for n, p in C.INTENTS)
    return f"CASE {cases} WHEN {_any(q, C.TECH_SIGNALS)} AND {_any(q, C.DATA_WORDS)} THEN 'factual' ELSE 'general' END"


def _missing(words) -> str:
    return "array_to_string(list_filter([" + ", ".join(f"'{w}'" for w in words) + f"], lambda w: NOT contains({_Q}, w)), ' ')"


@CORE.add(
    "search_intents",
    f"""WITH i AS (SELECT query_id, coalesce(query_text, '') AS t, query_text, {_intent_sql(_Q)} AS intent FROM search_queries)
    SELECT query_id, intent, CASE WHEN intent = 'research' AND {_missing(C.EXPANSIONS['research'])} <> '' THEN t || ' ' || {_missing(C.EXPANSIONS['research'])}
      WHEN intent = 'factual' AND {_missing(C.EXPANSIONS['factual'])} <> '' THEN t || ' ' || {_missing(C.EXPANSIONS['factual'])} ELSE t END AS expanded FROM i""",
)
def search_intents(spark, d):
    q = F.coalesce("query_text", F.lit(""))
    kind = C.intent(q)
    return _tables(spark, d)[1].select("query_id", kind.alias("intent"), C.expanded(q, kind).alias("expanded"))


@CORE.add(
    "search_minmax",
    """WITH once AS (SELECT DISTINCT ON (hit_id) hit_id, query_id, relevance_score AS s FROM search_hits WHERE relevance_score IS NOT NULL ORDER BY hit_id),
    b AS (SELECT *, min(s) OVER (PARTITION BY query_id) AS lo, max(s) OVER (PARTITION BY query_id) AS hi FROM once)
    SELECT hit_id, round(CASE WHEN hi = lo THEN 1.0 ELSE (s - lo) / (hi - lo) END, 6) AS score, round(1 / (1 + exp(-s)), 6) AS sigmoid FROM b""",
)
def search_minmax(spark, d):
    h = S.last_hits(_tables(spark, d)[0].select("hit_id", "query_id", F.col("relevance_score").alias("s"), "loaded_at")).filter("s is not null")
    b = h.groupBy("query_id").agg(F.min("s").alias("lo"), F.max("s").alias("hi"))
    score = F.when(F.col("hi") == F.col("lo"), 1.0).otherwise((F.col("s") - F.col("lo")) / (F.col("hi") - F.col("lo")))
    return h.join(b, "query_id").select("hit_id", F.round(score, 6).alias("score"), F.round(1 / (1 + F.exp(-F.col("s"))), 6).alias("sigmoid"))


_CLASS = "CASE WHEN engine IN ('semantic_scholar', 'github_api', 'hackernews') THEN 2 WHEN engine IN ('tavily', 'serper', 'exa', 'firecrawl') THEN 0 ELSE 1 END"


@CORE.add("search_backend_order", f"""WITH once AS (SELECT DISTINCT ON (hit_id) hit_id, query_id, engine, arrival FROM search_hits ORDER BY hit_id)
    SELECT hit_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY {_CLASS}, arrival, hit_id) AS INT) AS place FROM once""")
def search_backend_order(spark, d):
    from weft.plans.ranking import spread_rank

    h = S.last_hits(_tables(spark, d)[0].select("hit_id", "query_id", "engine", "arrival", "loaded_at")).drop("loaded_at")
    cls = F.when(F.col("engine").isin("semantic_scholar", "github_api", "hackernews"), 2).when(F.col("engine").isin("tavily", "serper", "exa", "firecrawl"), 0).otherwise(1)
    return spread_rank(h.withColumn("cls", cls), ["query_id"], [F.asc("cls"), F.asc("arrival"), F.asc("hit_id")], "place").select("hit_id", "place")


@CORE.add("search_quorum", f"""WITH {_MERGED},
    p AS (SELECT query_id, key, min(arrival) AS came FROM keyed WHERE key <> '' AND arrival IS NOT NULL AND engine IS NOT NULL GROUP BY ALL),
    e AS (SELECT query_id, engine, min(arrival) AS came FROM keyed WHERE arrival IS NOT NULL AND engine IS NOT NULL GROUP BY ALL),
    r AS (SELECT query_id, came FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY came) AS n FROM p) WHERE n = 6),
    s AS (SELECT query_id, came FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY came) AS n FROM e) WHERE n = 3),
    q AS (SELECT DISTINCT ON (query_id) query_id, issued_at FROM search_queries),
    t AS (SELECT r.query_id, least(greatest(r.came, q.issued_at + INTERVAL 4 SECONDS), CASE WHEN s.came IS NOT NULL THEN greatest(r.came, s.came) END) AS quorum_at FROM r JOIN q USING (query_id) LEFT JOIN s USING (query_id))
    SELECT * FROM t WHERE quorum_at IS NOT NULL""")
def search_quorum(spark, d):
    """When a search could have answered: six pages, and three engines or four seconds."""
    hits, queries = _tables(spark, d)
    return S.quorum(hits, queries)


@CORE.add("search_by_domain_list", r"""WITH h AS (SELECT hit_id, regexp_replace(regexp_extract(lower(url), '^https?://([^/:?#]*)', 1), '^www\.', '') AS h FROM search_hits),
    listed AS (SELECT DISTINCT regexp_replace(regexp_extract(lower(url), '^https?://([^/:?#]*)', 1), '^www\.', '') AS d FROM cache_entries WHERE status >= 400)
    SELECT DISTINCT hit_id FROM h JOIN listed ON h.h = d OR ends_with(h.h, '.' || d)""")
def search_by_domain_list(spark, d):
    """Hits whose host is in a long, growing domain list, or below a listed domain: suffixes explode to an equi semi join."""
    from weft.functions import urls as U

    listed = table(spark, d, "cache_entries").filter("status >= 400").select(U.host("url", True).alias("suffix")).distinct()
    h = _tables(spark, d)[0].select("hit_id", F.explode(U.host_suffixes(U.host("url", True))).alias("suffix"))
    return h.join(listed, "suffix", "left_semi").select("hit_id").distinct()


@CORE.add("search_stale_fallback", """WITH f AS (SELECT host, bool_and(status IN (0, 408, 429, 500, 502, 503, 504)) AS all_transient, count(*) AS n FROM (SELECT DISTINCT * FROM fetch_log) GROUP BY host)
    SELECT host, coalesce(all_transient, false) AS stale_ok, n FROM f""")
def search_stale_fallback(spark, d):
    """A stale answer may be used only where every fetch failed transiently."""
    f = table(spark, d, "fetch_log").distinct().groupBy("host").agg(F.bool_and(F.col("status").isin(0, 408, 429, 500, 502, 503, 504)).alias("t"), F.count(F.lit(1)).alias("n"))
    return f.select("host", F.coalesce("t", F.lit(False)).alias("stale_ok"), "n")

"""Search results fused, boosted, diversified, tiered and filtered: one lazy plan from hits to results.

Hits are (hit_id, query_id, engine, arrival, title, url, snippet, position,
relevance_score). Deliveries of one hit count once. Hits without title or without a
good url are left out, as are hits of queries that aren't given. Ties are broken by
arrival and then by key, so every order is total.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions import classes as C
from weft.functions import urls as U
from weft.plans.ranking import spread_rank
from weft.plans.staging import stage
from weft.sources.tables import latest_delivery

# Engines that serve one and the same index.
FAMILIES = {"duckduckgo": "bing", "yahoo": "bing", "startpage": "google"}
MERGED_CHARS = 600


def family(engine: Column) -> Column:
    """Index family of an engine, itself by default; a map literal, as the list is fixed and short."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in FAMILIES.items() for x in pair]), engine), engine)


def last_hits(hits: DataFrame) -> DataFrame:
    """Every hit once, as it was delivered last; hits without a delivery time are alike."""
    return latest_delivery(hits, "hit_id", "loaded_at") if "loaded_at" in hits.columns else hits.dropDuplicates(["hit_id"])


def merged(hits: DataFrame) -> DataFrame:
    """One row per (query, page): the first hit's title and url, consensus, sources and merged snippet.

    A page's hits are few even where its query is hot, since engines bound them; the
    aggregation combines before it shuffles.
    """
    h = last_hits(hits).select("hit_id", "query_id", "engine", "arrival", "title", "url", "snippet", "position", "relevance_score")
    keyed = h.withColumn("key", U.search_key("url")).filter((F.col("key") != "") & (F.coalesce("title", F.lit("")) != ""))
    first = F.struct("arrival", "hit_id", "title", "url")
    bodies = F.array_sort(F.collect_list(F.struct("arrival", "hit_id", F.trim(F.coalesce("snippet", F.lit(""))).alias("body"))))
    fused = keyed.groupBy("query_id", "key").agg(
        F.min(first).alias("f"),
        F.count_distinct(family(F.col("engine"))).cast("int").alias("consensus"),
        F.array_join(F.sort_array(F.collect_set("engine")), ",").alias("sources"),
        F.min(F.coalesce("position", F.lit(1000))).alias("position"),
        F.max(F.coalesce("relevance_score", F.lit(0.0))).alias("base"),
        bodies.alias("bodies"),
    )
    return fused.select("query_id", "key", F.col("f.title").alias("title"), F.col("f.url").alias("url"), F.col("f.arrival").alias("arrival"), "consensus", "sources", "position", "base", merge_snippets(F.col("bodies.body")).alias("snippet"))


def merge_snippets(bodies: Column) -> Column:
    """Bodies in order, each appended if the text so far is short and doesn't hold it; at most 600 characters."""

    def step(text: Column, body: Column) -> Column:
        more = F.substring(F.trim(F.concat(text, F.lit(" "), body)), 1, MERGED_CHARS)
        return F.when((body == "") | F.contains(text, body) | (F.length(text) >= MERGED_CHARS), text).otherwise(F.when(text == "", body).otherwise(more))

    return F.aggregate(bodies, F.lit(""), step)


def boosted(pages: DataFrame, queries: DataFrame) -> DataFrame:
    """Scores with consensus, domain, answer, title and url boosts, divided by the query's best where that exceeds 1."""
    q = queries.select("query_id", "query_text").dropDuplicates(["query_id"])
    j = pages.join(q, "query_id")
    text = F.coalesce("query_text", F.lit(""))
    terms = C.query_terms(text)
    scored = j.withColumn("technical", C.is_technical(text)).withColumn("terms", terms)
    with_parts = scored.withColumn("domain_boost", C.domain_boost("url", F.col("technical"))).withColumn("answer", C.answer_signal(text, F.col("snippet"), F.col("technical")))
    total = (
        F.col("base") + F.lit(0.2) * (F.greatest(F.col("consensus"), F.lit(1)) - 1) + F.col("domain_boost") + F.col("answer")
        + C.share_of_terms(F.col("terms"), F.col("title"), 0.10) + C.share_of_terms(F.col("terms"), U.Parts("url").path, 0.08)
    )
    raw = with_parts.withColumn("raw", F.round(total, 6)).drop("technical", "terms")
    best = raw.groupBy("query_id").agg(F.max("raw").alias("best"), F.count(F.lit(1)).cast("int").alias("total"))
    return raw.join(best, "query_id").withColumn("score", F.round(F.when(F.col("best") > 1.0, F.col("raw") / F.col("best")).otherwise(F.col("raw")), 6)).drop("best", "raw")


def ranked(hits: DataFrame, queries: DataFrame, per_domain: int = 2) -> DataFrame:
    """Every page of every query in its final order, with tier and source type.

    The first ``per_domain`` pages of a domain keep their place, the others follow at
    the end; none is dropped. Ranks are taken without holding a query in one task.
    """
    scored = stage(boosted(merged(hits), queries), "scored")
    order = [F.desc("score"), F.desc("consensus"), F.asc("position"), F.asc("arrival"), F.asc("key")]
    narrow = scored.select("query_id", "key", "score", "consensus", "position", "arrival", "domain_boost", "answer", "total", U.host("url", True).alias("domain"))
    placed = spread_rank(narrow, ["query_id"], order, "place")
    counted = spread_rank(placed, ["query_id", "domain"], [F.asc("place")], "nth").withColumn("later", (F.col("nth") > per_domain).cast("int"))
    final = spread_rank(counted, ["query_id"], [F.asc("later"), F.asc("place")], "rank").withColumn("tier", tier())
    return final.join(scored.select("query_id", "key", "title", "url", "snippet", "sources"), ["query_id", "key"]).withColumn("source_type", C.source_type("url"))


def tier() -> Column:
    """high, med or low of a page by score, place and signals."""
    s, r = F.col("score"), F.col("rank")
    strong = (F.col("consensus") >= 3) | (F.col("domain_boost") > 0) | (F.col("answer") >= 0.15)
    return F.when((s >= 0.5) | (r == 1), "high").when(strong & (s >= 0.25), "high").when(s >= 0.15, "med").when(r <= F.greatest(F.lit(2), F.floor(F.col("total") / 3)), "med").otherwise("low")


def quality_filtered(results: DataFrame, least: int = 3) -> DataFrame:
    """Low pages left out where at least ``least`` others stay, and pages numbered again."""
    kept = results.groupBy("query_id").agg(F.sum((F.col("tier") != "low").cast("int")).alias("good"))
    j = results.join(kept, "query_id").filter((F.col("total") <= least) | (F.col("good") < least) | (F.col("tier") != "low"))
    return spread_rank(j.drop("good"), ["query_id"], [F.asc("rank")], "index")


def tier_counts(results: DataFrame) -> DataFrame:
    """Per query the pages by tier, and what to read first."""
    n = lambda t: F.sum((F.col("tier") == t).cast("int"))
    c = results.groupBy("query_id").agg(n("high").alias("high"), n("med").alias("med"), n("low").alias("low"))
    advice = F.when(F.col("high") >= 3, "fetch 1-2").when(F.col("high") >= 1, "fetch 1, maybe 2").when(F.col("med") >= 2, "fetch 1-2, rephrase if thin").otherwise("fetch 1, rephrase if thin")
    return c.withColumn("advice", advice)


def related_bigrams(results: DataFrame, queries: DataFrame, least: int = 3) -> DataFrame:
    """(query_id, bigram, pages): word pairs of at least ``least`` pages' titles and snippets that the query doesn't say."""
    words = _content_words(F.concat_ws(" ", "title", "snippet"))
    w = results.select("query_id", "key", words.alias("w"))
    pairs = F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.concat(F.element_at("w", i), F.lit(" "), F.element_at("w", i + 1))))
    counted = w.filter(F.size("w") > 1).select("query_id", "key", F.explode(pairs).alias("bigram")).groupBy("query_id", "bigram").agg(F.count(F.lit(1)).alias("pages")).filter(F.col("pages") >= least)
    q = queries.select("query_id", F.lower(F.coalesce("query_text", F.lit(""))).alias("q"), C.query_terms(F.col("query_text")).alias("terms")).dropDuplicates(["query_id"])
    own = F.size(F.array_except(F.split("bigram", " "), "terms")) == 0
    return counted.join(q, "query_id").filter(~own & ~F.contains("q", F.col("bigram")) & ~F.contains("bigram", F.col("q"))).select("query_id", "bigram", "pages")


def _content_words(text: Column) -> Column:
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[a-z][a-z0-9'+-]{2,}"), F.lit(0))
    stop = F.array(*[F.lit(x) for x in C.STOPWORDS])
    return F.filter(words, lambda x: ~F.array_contains(stop, x))


def quorum(hits: DataFrame, asked: DataFrame, least_results: int = 6, least_engines: int = 3, seconds: float = 4.0) -> DataFrame:
    """(query_id, quorum_at): when a search may answer before all engines have.

    Enough different pages must have come, and either enough engines or enough time since the query
    was issued. Arrivals of a query are aggregated per page and per engine before they are put in
    order, so ranks are taken over what engines bound; queries that never get there give no row.
    """
    h = hits.select("query_id", "engine", "arrival", U.search_key("url").alias("key")).filter("arrival is not null and engine is not null")
    pages = h.filter("key <> ''").groupBy("query_id", "key").agg(F.min("arrival").alias("at")).select("query_id", "at")
    engines = h.groupBy("query_id", "engine").agg(F.min("arrival").alias("at")).select("query_id", "at")
    nth = lambda df, n, name: spread_rank(df.withColumn("tie", F.monotonically_increasing_id()), ["query_id"], [F.asc("at"), F.asc("tie")], "n").filter(F.col("n") == n).select("query_id", F.col("at").alias(name))
    enough = nth(stage(pages, "pages"), least_results, "results_at")
    several = nth(stage(engines, "engines"), least_engines, "engines_at")
    late = F.col("issued_at") + F.make_dt_interval(secs=F.lit(float(seconds)))
    q = asked.select("query_id", "issued_at").dropDuplicates(["query_id"])
    told = enough.join(q, "query_id").join(several, "query_id", "left")
    by_time = F.when(late.isNotNull(), F.greatest("results_at", late))
    by_engines = F.when(F.col("engines_at").isNotNull(), F.greatest("results_at", "engines_at"))
    return told.select("query_id", F.least(by_time, by_engines).alias("quorum_at")).filter("quorum_at is not null")


def rerank_pool(results: DataFrame, wanted: int) -> DataFrame:
    """The results that are worth a costly reranking: the best max(2 x wanted, 12) of each query."""
    return results.filter(F.col("rank") <= max(2 * wanted, 12))

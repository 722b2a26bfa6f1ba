"""Queries over the fetch log and the cache: throttling, health, sessions, freshness, checkpoints."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.operators import state as S
from weft.queries.base import CORE
from weft.sources.tables import table

_FETCHES = """once AS (SELECT fetch_id, arg_min({'host': lower(trim(host)), 'ts': ts, 'latency': latency, 'status': status, 'retry_after': retry_after}, logged_at) AS r FROM fetch_log WHERE host IS NOT NULL AND ts IS NOT NULL GROUP BY fetch_id),
    f AS (SELECT fetch_id, r.host AS host, r.ts AS ts, r.latency AS latency, r.status AS status, r.retry_after AS retry_after FROM once)"""


def log(spark, d):
    return table(spark, d, "fetch_log")


def cache(spark, d):
    return table(spark, d, "cache_entries")


@CORE.add(
    "state_throttle",
    f"""WITH RECURSIVE {_FETCHES}, n AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY ts, fetch_id) AS k, greatest(coalesce(latency, 0.0), 0.0) AS l FROM f),
    walk AS (
      SELECT host, 0 AS k, CAST(NULL AS BIGINT) AS fetch_id, 2.0::DOUBLE AS delay FROM (SELECT DISTINCT host FROM n)
      UNION ALL
      SELECT w.host, n.k, n.fetch_id, greatest(2.0::DOUBLE, least(30.0::DOUBLE, CASE WHEN n.status IN (429, 403)
        THEN greatest((w.delay + n.l) / 2, n.l, coalesce(n.retry_after, w.delay * 2), w.delay) ELSE greatest((w.delay + n.l) / 2, n.l) END))
      FROM walk w JOIN n ON n.host = w.host AND n.k = w.k + 1)
    SELECT fetch_id, host, delay FROM walk WHERE k > 0""",
)
def state_throttle(spark, d):
    return S.throttle(log(spark, d))


@CORE.add(
    "state_health",
    f"""WITH RECURSIVE {_FETCHES}, n AS (SELECT *, epoch_us(ts) AS us, row_number() OVER (PARTITION BY host ORDER BY ts, fetch_id) AS k FROM f),
    walk AS (
      SELECT host, 0 AS k, CAST(NULL AS BIGINT) AS fetch_id, 100 AS score, CAST(NULL AS BIGINT) AS until FROM (SELECT DISTINCT host FROM n)
      UNION ALL
      SELECT host, k, fetch_id, s2, CASE WHEN s2 < 40 THEN us + 300000000 END FROM (
        SELECT host, k, fetch_id, us, CASE WHEN status BETWEEN 200 AND 299 THEN least(s1 + 1, 150) WHEN status IN (429, 403) THEN s1 - 20 WHEN coalesce(status, 0) = 0 OR status BETWEEN 500 AND 599 THEN s1 - 10 ELSE s1 END AS s2
        FROM (SELECT w.host, n.k, n.fetch_id, n.us, n.status, CASE WHEN w.until IS NOT NULL AND n.us >= w.until THEN 40 ELSE w.score END AS s1 FROM walk w JOIN n ON n.host = w.host AND n.k = w.k + 1)))
    SELECT fetch_id, host, score FROM walk WHERE k > 0""",
)
def state_health(spark, d):
    return S.health(log(spark, d))


@CORE.add(
    "state_open_circuits",
    f"""WITH {_FETCHES}, g AS (SELECT *, last_value(CASE WHEN status IN (429, 403) THEN ts END IGNORE NULLS) OVER w AS b, last_value(CASE WHEN status BETWEEN 200 AND 299 THEN ts END IGNORE NULLS) OVER w AS c
      FROM f WINDOW w AS (PARTITION BY host ORDER BY ts, fetch_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT fetch_id, host FROM g WHERE b IS NOT NULL AND (c IS NULL OR c < b) AND epoch_us(ts) - epoch_us(b) < 21600000000""",
)
def state_open_circuits(spark, d):
    return S.open_circuits(log(spark, d), 6 * 3600)


@CORE.add(
    "state_sessions",
    f"""WITH {_FETCHES}, s AS (SELECT host, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 300 SECONDS THEN 1 ELSE 0 END AS new, fetch_id FROM f WINDOW w AS (PARTITION BY host ORDER BY ts, fetch_id)),
    g AS (SELECT *, sum(new) OVER (PARTITION BY host ORDER BY ts, fetch_id ROWS UNBOUNDED PRECEDING) AS g FROM s)
    SELECT host, min(ts) AS started, max(ts) AS ended, count(*) AS fetches FROM g GROUP BY host, g""",
)
def state_sessions(spark, d):
    return S.sessions(log(spark, d))


@CORE.add("state_latency", f"""WITH {_FETCHES} SELECT host, count(latency) AS n, CAST(sum(CAST(round(latency * 10000) AS BIGINT)) AS DOUBLE) / (count(latency) * 10000.0::DOUBLE) AS mean, round(min(latency), 6) AS least, round(max(latency), 6) AS most,
      round(quantile_cont(latency, 0.5), 6) AS median, round(quantile_cont(latency, 0.95), 6) AS p95 FROM f WHERE latency >= 0 GROUP BY host""")
def state_latency(spark, d):
    f = S.fetches(log(spark, d)).filter("latency >= 0")
    r = lambda c: F.round(c, 6)
    return f.groupBy("host").agg(F.count("latency").alias("n"), (F.sum(F.round(F.col("latency") * 10000).cast("long")).cast("double") / (F.count("latency") * F.lit(10000.0))).alias("mean"), r(F.min("latency")).alias("least"), r(F.max("latency")).alias("most"), r(F.percentile("latency", 0.5)).alias("median"), r(F.percentile("latency", 0.95)).alias("p95"))


@CORE.add("state_status_counts", f"WITH {_FETCHES} SELECT host, count(*) AS n, CAST(sum(CASE WHEN status BETWEEN 200 AND 299 THEN 1 ELSE 0 END) AS BIGINT) AS ok, CAST(sum(CASE WHEN status IN (429, 403) THEN 1 ELSE 0 END) AS BIGINT) AS blocked FROM f GROUP BY host")
def state_status_counts(spark, d):
    f = S.fetches(log(spark, d))
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("int"))
    return f.groupBy("host").agg(F.count(F.lit(1)).alias("n"), n(F.col("status").between(200, 299)).alias("ok"), n(F.col("status").isin(*S.BLOCKED)).alias("blocked"))


@CORE.add("state_budget", f"""WITH {_FETCHES}, b AS (SELECT fetch_id, host, CAST(sum(1) OVER (PARTITION BY host ORDER BY ts, fetch_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS spent FROM f)
    SELECT * FROM b WHERE spent <= 30""")
def state_budget(spark, d):
    f = S.fetches(log(spark, d)).select("fetch_id", "host", "ts", F.lit(1).alias("one"))
    return S.within_budget(f, "host", ["ts", "fetch_id"], "one", 30).select("fetch_id", "host", "spent")


@CORE.add("state_dedupe", "SELECT lower(trim(host)) AS host, url, min(ts) AS first_seen, count(DISTINCT fetch_id) AS fetches FROM fetch_log WHERE host IS NOT NULL AND ts IS NOT NULL GROUP BY ALL")
def state_dedupe(spark, d):
    f = log(spark, d).filter("host is not null and ts is not null")
    return f.groupBy(F.lower(F.trim("host")).alias("host"), "url").agg(F.min("ts").alias("first_seen"), F.count_distinct("fetch_id").alias("fetches"))


@CORE.add("state_hourly", f"WITH {_FETCHES} SELECT date_trunc('hour', ts) AS hour, count(*) AS fetches, count(DISTINCT host) AS hosts FROM f GROUP BY 1")
def state_hourly(spark, d):
    return S.fetches(log(spark, d)).groupBy(F.window("ts", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("fetches"), F.count_distinct("host").alias("hosts")).select(F.col("w.start").alias("hour"), "fetches", "hosts")


_NOW = "(SELECT max(fetched_at) FROM cache_entries)"


@CORE.add("cache_fresh", f"SELECT entry_id, key FROM cache_entries WHERE epoch_us(fetched_at) + CAST(least(coalesce(ttl, 0), 3600) AS BIGINT) * 1000000 > epoch_us({_NOW})")
def cache_fresh(spark, d):
    c = cache(spark, d).select("entry_id", "key", "fetched_at", "ttl")
    now = c.agg(F.max("fetched_at").alias("now"))
    return S.fresh(c.crossJoin(F.broadcast(now)), F.col("now"), ttl=3600).select("entry_id", "key")


@CORE.add("cache_stale_window", f"SELECT entry_id, key FROM cache_entries WHERE epoch_us(fetched_at) + CAST(86400 AS BIGINT) * 1000000 > epoch_us({_NOW})")
def cache_stale_window(spark, d):
    c = cache(spark, d).select("entry_id", "key", "fetched_at", "ttl")
    now = c.agg(F.max("fetched_at").alias("now"))
    return S.fresh(c.crossJoin(F.broadcast(now)), F.col("now"), stale_max_age=86400).select("entry_id", "key")


@CORE.add("cache_upserted", """WITH r AS (SELECT key, fetched_at, entry_id, row_number() OVER (PARTITION BY key ORDER BY fetched_at DESC, stored_at DESC, entry_id DESC) AS n FROM cache_entries)
    SELECT key, fetched_at, entry_id FROM r WHERE n = 1""")
def cache_upserted(spark, d):
    return S.upserted(cache(spark, d))


@CORE.add("cache_evicted", """WITH r AS (SELECT key, fetched_at, entry_id, row_number() OVER (PARTITION BY key ORDER BY fetched_at DESC, stored_at DESC, entry_id DESC) AS n FROM cache_entries),
    u AS (SELECT key, fetched_at, entry_id, row_number() OVER (ORDER BY fetched_at DESC, key) AS p, count(*) OVER () AS total FROM r WHERE n = 1)
    SELECT key, fetched_at, entry_id FROM u WHERE total <= 500 OR p <= 450""")
def cache_evicted(spark, d):
    return S.evicted(cache(spark, d), 500)


@CORE.add("cache_cacheable", "SELECT DISTINCT entry_id FROM cache_entries WHERE status > 0 AND status < 400 AND trim(translate(array_to_string(CAST(json(content) AS VARCHAR[]), chr(10)), chr(10) || chr(9) || chr(13), '   ')) <> ''")
def cache_cacheable(spark, d):
    from weft.sources.tables import cache_text

    return cache(spark, d).filter((F.col("status") > 0) & (F.col("status") < 400)).filter(cache_text().rlike(r"\S")).select("entry_id").distinct()


@CORE.add("cache_expired_purge", f"SELECT count(*) AS purged FROM cache_entries WHERE epoch_us(fetched_at) + CAST(coalesce(ttl, 0) AS BIGINT) * 1000000 <= epoch_us({_NOW})")
def cache_expired_purge(spark, d):
    c = cache(spark, d).select("fetched_at", "ttl")
    now = c.agg(F.max("fetched_at").alias("now"))
    return c.crossJoin(F.broadcast(now)).filter(S.micros("fetched_at") + F.coalesce("ttl", F.lit(0)).cast("long") * 1_000_000 <= S.micros("now")).agg(F.count(F.lit(1)).alias("purged"))


@CORE.add("cache_lookup", """WITH r AS (SELECT key, url, entry_id, row_number() OVER (PARTITION BY url ORDER BY fetched_at DESC, stored_at DESC, entry_id DESC) AS n FROM cache_entries)
    SELECT h.hit_id, r.entry_id FROM (SELECT DISTINCT hit_id, url FROM search_hits) h LEFT JOIN r ON r.url = h.url AND r.n = 1""")
def cache_lookup(spark, d):
    """Every hit with the newest cached page of its url, if any: one equi join on the url."""
    newest = cache(spark, d).groupBy("url").agg(F.max(F.struct("fetched_at", "stored_at", "entry_id")).alias("m")).select("url", F.col("m.entry_id").alias("entry_id"))
    return table(spark, d, "search_hits").select("hit_id", "url").distinct().join(newest, "url", "left").select("hit_id", "entry_id")


@CORE.add("batch_resume", "WITH done AS (SELECT DISTINCT url FROM cache_entries WHERE status BETWEEN 200 AND 299) SELECT DISTINCT url FROM search_hits WHERE url NOT IN (SELECT url FROM done)")
def batch_resume(spark, d):
    wanted = table(spark, d, "search_hits").select("url").distinct()
    done = cache(spark, d).select("url", F.col("status").between(200, 299).alias("ok"))
    return S.to_resume(wanted, done, "url", retry_failed=True)


@CORE.add("jsonl_export", """SELECT '{"hit_id":' || hit_id || ',"title":' || coalesce(to_json(title), 'null') || ',"position":' || coalesce(CAST(position AS VARCHAR), 'null') || '}' AS line FROM search_hits""")
def jsonl_export(spark, d):
    h = table(spark, d, "search_hits")
    return h.select(F.to_json(F.struct("hit_id", "title", "position"), {"ignoreNullFields": "false"}).alias("line"))


@CORE.add("state_key_turns")
def state_key_turns(spark, d):
    f = S.fetches(log(spark, d)).select("fetch_id", "host", S.micros("ts").alias("us"), "status")
    return S.key_turns(f, 3)


@CORE.add("cache_envelope_redacted")
def cache_envelope_redacted(spark, d):
    from weft.functions import safety

    return cache(spark, d).select("entry_id", safety.redact_json("envelope").alias("envelope"))


@CORE.add("cache_summary", """SELECT entry_id, CASE WHEN coalesce(status, 0) = 0 THEN 'network error' ELSE status || CASE WHEN status < 400 THEN ' OK' ELSE ' ERR' END END AS head, CASE WHEN coalesce(status, 0) = 0 OR status >= 400 THEN 'fetch failed' ELSE '' END AS next_action FROM cache_entries""")
def cache_summary(spark, d):
    from weft.functions import text as T

    s = T.fetch_summary(F.col("status"), F.col("total_size_bytes"), F.col("extraction_type"), F.lit(""), F.lit("article"), F.lit(True))
    return cache(spark, d).select("entry_id", F.substring_index(s["summary"], " · ", 1).alias("head"), s["next_action"].alias("next_action"))

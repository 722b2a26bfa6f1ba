import datetime as dt
import random

from pyspark.sql import functions as F

from weft.operators import crawl, search, state
from weft.plans.ranking import spread_rank
from weft.streaming import state as streams

SCHEMA = "fetch_id bigint, host string, ts timestamp, latency double, status int, retry_after double, logged_at timestamp"


def fetch_rows(n=200):
    rng = random.Random(1)
    t = dt.datetime(2024, 1, 1)
    out = []
    for i in range(n):
        t += dt.timedelta(seconds=rng.randrange(0, 400))
        out.append((i, rng.choice(["a", "a", "A", "b"]), t, rng.choice([None, -1.0, rng.random() * 20]), rng.choice([200, 200, 429, 403, 503, 0, None]), rng.choice([None, None, 7.0]), t))
    return out


def test_delays_of_a_known_sequence():
    d, seen = 2.0, []
    for latency, status, wait in [(12, 200, None), (1, 429, None), (8, 200, None)]:
        d = state.next_delay(d, latency, status, wait, 0.0, 1000.0)
        seen.append(d)
    assert seen == [12.0, 24.0, 16.0]
    for _ in range(8):
        d = state.next_delay(d, 0, 429, None, 0.0, 256.0)
    assert d == 256.0


def test_health_rests_and_recovers():
    score, until = 100, None
    for k in range(4):
        score, until = state.next_health(score, until, float(k), 429)
    assert (score, until) == (20, 303.0)
    assert state.next_health(score, until, 400.0, 200) == (41, None)


def test_batch_fold_equals_plain_loop(spark):
    rows = fetch_rows()
    df = spark.createDataFrame([*rows, rows[3], (None, None, None, None, None, None, None)], SCHEMA)
    got = {r["fetch_id"]: r["delay"] for r in state.throttle(df).collect()}
    held, want = {}, {}
    for i, h, t, l, s, w, _ in sorted(rows, key=lambda r: (r[2], r[0])):
        held[h.lower()] = want[i] = state.next_delay(held.get(h.lower(), state.MIN_DELAY), l, s, w)
    assert got == want
    assert state.throttle(df.limit(0)).count() == 0 and state.sessions(df.limit(0)).count() == 0


def test_streams_equal_batches(spark, tmp_path):
    rows = sorted(fetch_rows(), key=lambda r: (r[2], r[0]))
    for k in range(4):
        spark.createDataFrame(rows[k * 50 : k * 50 + 50], SCHEMA).withColumn("host", F.lower("host")).coalesce(1).write.parquet(str(tmp_path / f"part{k}"))
    import shutil

    (tmp_path / "in").mkdir()
    for k in range(4):
        for f in (tmp_path / f"part{k}").glob("*.parquet"):
            target = tmp_path / "in" / f"{k}.parquet"
            shutil.copyfile(f, target)
            import os

            os.utime(target, (1_700_000_000 + k * 10, 1_700_000_000 + k * 10))
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for name, make, batch, value in (("t", streams.throttle, state.throttle, "delay"), ("h", streams.health, state.health, "score")):
        q = make(source).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"c{name}")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        got = {r["fetch_id"]: r[value] for r in spark.table(name).collect()}
        want = {r["fetch_id"]: r[value] for r in batch(spark.createDataFrame(rows, SCHEMA)).collect()}
        assert got == want
    q = streams.sessions(source).writeStream.format("memory").queryName("s").option("checkpointLocation", str(tmp_path / "cs")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("s").count() > 0
    q = streams.first_sightings(source.withColumn("url", F.lit("u"))).writeStream.format("memory").queryName("d").option("checkpointLocation", str(tmp_path / "cd")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert 2 <= spark.table("d").count() <= 200


def test_spread_rank_equals_a_window(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["hot"] * 8 + ["b", None]), rng.randrange(50), i) for i in range(500)]
    got = spread_rank(spark.createDataFrame(rows, "g string, v int, i int"), ["g"], [F.desc("v"), F.asc("i")], "r").collect()
    by = {}
    for r in got:
        if r["g"] is not None:
            by.setdefault(r["g"], []).append((r["r"], -r["v"], r["i"]))
    for ranked in by.values():
        ranked.sort()
        assert [x[0] for x in ranked] == list(range(1, len(ranked) + 1)) and [x[1:] for x in ranked] == sorted(x[1:] for x in ranked)


def test_search_merges_and_ranks(spark):
    t = dt.datetime(2024, 1, 1)
    h = [(1, 1, "brave", t, "T", "https://a.example/x?utm_source=f", "first part", 1, 0.4), (2, 1, "yahoo", t + dt.timedelta(seconds=1), "U", "https://a.example/x", "second part", 2, 0.6), (3, 1, "brave", t, "V", "https://b.example/", None, 3, None), (3, 1, "brave", t, "V", "https://b.example/", None, 3, None), (4, 1, "brave", t, None, "https://c.example/", "s", 4, 0.9), (5, 2, "brave", t, "W", "not a url", "s", 1, 0.9)]
    hits = spark.createDataFrame(h, "hit_id bigint, query_id bigint, engine string, arrival timestamp, title string, url string, snippet string, position int, relevance_score double")
    m = {r["key"]: r for r in search.merged(hits).collect()}
    assert set(m) == {"https://a.example/x", "https://b.example/"} and m["https://a.example/x"]["consensus"] == 2 and m["https://a.example/x"]["snippet"] == "first part second part"
    q = spark.createDataFrame([(1, "anything"), (2, None)], "query_id bigint, query_text string")
    r = search.ranked(hits, q).orderBy("rank").collect()
    assert [x["key"] for x in r] == ["https://a.example/x", "https://b.example/"] and r[0]["tier"] == "high"
    assert search.ranked(hits.limit(0), q).count() == 0


def test_bounded_crawl(spark):
    links = spark.createDataFrame([("https://a.example/", "https://a.example/docs", "docs"), ("https://a.example/", "https://a.example/login", "x"), ("https://a.example/docs", "https://a.example/docs/2", "y"), ("https://a.example/", "https://a.example/i.png", "z")], "src string, dst string, text string")
    seeds = spark.createDataFrame([("https://a.example",)], "page string")
    pages = lambda **k: [r["page"] for r in crawl.crawl(links, seeds, ["docs"], **k).orderBy("depth", F.desc("score")).collect()]
    assert pages() == ["https://a.example/", "https://a.example/docs", "https://a.example/login", "https://a.example/docs/2"]
    assert pages(max_pages=2) == ["https://a.example/", "https://a.example/docs"] and len(pages(max_depth=0)) == 1


def test_ranks_of_null_and_hot_groups(spark):
    from weft.plans import staging
    from weft.plans.ranking import spread_rank

    rows = spark.range(4000).select(
        F.when(F.col("id") % 3 != 0, F.pmod(F.xxhash64("id"), F.lit(5))).alias("g"), F.when(F.col("id") % 5 != 0, F.lit("x")).alias("h"), F.xxhash64("id", F.lit(1)).alias("o")
    )
    got = spread_rank(rows, ["g", "h"], [F.desc("o")], "n").toPandas()
    want = got.sort_values("o", ascending=False).groupby(["g", "h"], dropna=False).cumcount() + 1
    assert len(got) == 4000 and (want.sort_index() == got["n"]).all()
    assert spread_rank(rows.limit(0), ["g"], [F.desc("o")], "n").count() == 0
    assert staging.sweep() >= 0


def test_a_cluster_needs_a_shared_folder():
    from weft.plans import staging

    class Cluster:
        class conf:
            get = staticmethod(lambda k, d: None)

        class sparkContext:
            master = "spark://host:7077"

            class getConf:
                get = staticmethod(lambda k, d: None)

    import pytest

    with pytest.raises(ValueError):
        staging.shared_dir(Cluster)

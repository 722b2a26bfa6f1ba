"""Keyed, time-driven rules over fetch logs and the cache, in batch form.

Recurrences run over rows sorted by key and time within partitions and keep one key's
state at a time, so a hot key streams through a task without being held. A fetch is
(fetch_id, host, ts, latency, status, retry_after, logged_at); exact repeats count once
and hosts are compared in lower case.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weft.plans.staging import ensure_package


def micros(c: Column | str) -> Column:
    """Microseconds since the epoch, of timestamps with and without zone."""
    return F.unix_micros((F.col(c) if isinstance(c, str) else c).cast("timestamp"))

#: Rows of one key whose totals run together.
STRETCH = 10_000

# Throttle bounds and growth, blocking statuses, health steps.
MIN_DELAY, MAX_DELAY, BACKOFF = 2.0, 30.0, 2.0
BLOCKED = (429, 403)
START, MOST, FLOOR, REWARD, LIMITED, FAILED, REST_SECONDS = 100, 150, 40, 1, -20, -10, 300


def fetches(log: DataFrame) -> DataFrame:
    """The log with every fetch once (its first delivery) and hosts in lower case; rows without host or time are left out."""
    named = log.select("fetch_id", F.lower(F.trim("host")).alias("host"), "ts", "latency", "status", "retry_after", "logged_at").filter("host is not null and ts is not null")
    return named.groupBy("fetch_id").agg(F.min_by(F.struct("host", "ts", "latency", "status", "retry_after"), "logged_at").alias("r")).select("fetch_id", "r.*")


def next_delay(current: float, latency: float | None, status: int | None, retry_after: float | None, least: float = MIN_DELAY, most: float = MAX_DELAY, factor: float = BACKOFF) -> float:
    """Delay after one more fetch: halfway to the latency and not below it; longer after a block; within bounds."""
    seen = max(latency or 0.0, 0.0)
    new = max((current + seen) / 2.0, seen)
    if status in BLOCKED:
        new = max(new, retry_after if retry_after is not None else current * factor, current)
    return max(least, min(new, most))


def next_health(score: int, resting_until: float | None, at: float, status: int | None) -> tuple[int, float | None]:
    """(score, end of rest) of a route after one more observation; status 0 or null is a timeout."""
    if resting_until is not None and at >= resting_until:
        score, resting_until = FLOOR, None
    if status is not None and 200 <= status < 300:
        score = min(score + REWARD, MOST)
    elif status in BLOCKED:
        score += LIMITED
    elif not status or 500 <= status < 600:
        score += FAILED
    if score < FLOOR:
        return score, at + REST_SECONDS
    return score, None


def _fold(rows: DataFrame, key: str, order: list[str], schema: str, start, step, out_type: pa.DataType) -> DataFrame:
    """Streams sorted rows and yields (fetch_id, host, value after the row)."""
    ensure_package(rows.sparkSession)

    def run(batches):
        held, state = None, None
        for b in batches:
            values = []
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if row[1] != held:
                    held, state = row[1], start()
                state = step(state, row)
                values.append(state[0] if isinstance(state, tuple) else state)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(values, out_type)], names=["fetch_id", "host", "value"])

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)


def throttle(log: DataFrame) -> DataFrame:
    """(fetch_id, host, delay): the host's delay after each fetch, in order of time."""
    rows = fetches(log).select("fetch_id", "host", "ts", "latency", "status", "retry_after")
    return _fold(rows, "host", ["ts", "fetch_id"], "fetch_id bigint, host string, value double", lambda: MIN_DELAY, lambda d, r: next_delay(d, r[3], r[4], r[5]), pa.float64()).withColumnRenamed("value", "delay")


def health(log: DataFrame) -> DataFrame:
    """(fetch_id, host, score): the route's health after each fetch."""
    rows = fetches(log).select("fetch_id", "host", micros("ts").alias("us"), "status")
    return _fold(rows, "host", ["us", "fetch_id"], "fetch_id bigint, host string, value int", lambda: (START, None), lambda s, r: next_health(s[0], s[1], r[2] / 1e6, r[3]), pa.int32()).withColumnRenamed("value", "score")


def open_circuits(log: DataFrame, seconds: int = 60) -> DataFrame:
    """(fetch_id, host): fetches made within ``seconds`` after a block of their host that no success has cleared yet.

    A fetch sees the blocks and successes before it. Both are joined to it by time buckets as long
    as the rule looks back, so a hot host is split over its buckets and no task folds a host.
    """
    f = fetches(log).select("fetch_id", "host", micros("ts").alias("us"), "status")
    span = seconds * 1_000_000
    bucket = lambda c: F.floor(c / span)
    by_bucket = Window.partitionBy("host", "bucket").orderBy("us", "fetch_id").rowsBetween(Window.unboundedPreceding, -1)
    when = lambda cond: F.when(cond, F.col("us"))
    b, c = when(F.col("status").isin(*BLOCKED)), when(F.col("status").between(200, 299))
    held = f.withColumn("bucket", bucket(F.col("us"))).withColumns({"b": b, "c": c})
    inside = held.withColumns({"b0": F.max("b").over(by_bucket), "c0": F.max("c").over(by_bucket)})
    # what the bucket before holds; older blocks no longer count, and an older success clears nothing newer
    earlier = held.groupBy("host", "bucket").agg(F.max("b").alias("b1"), F.max("c").alias("c1")).withColumn("bucket", F.col("bucket") + 1)
    seen = inside.join(earlier, ["host", "bucket"], "left")
    block, clear = F.coalesce("b0", "b1"), F.coalesce("c0", "c1")
    return seen.filter(block.isNotNull() & (clear.isNull() | (clear < block)) & (F.col("us") - block < span)).select("fetch_id", "host")


def sessions(log: DataFrame, seconds: int = 300) -> DataFrame:
    """(host, started, ended, fetches): sessions that end after idle time, by the built-in session windows."""
    return (
        fetches(log).groupBy("host", F.session_window("ts", f"{seconds} seconds").alias("w")).agg(F.count(F.lit(1)).alias("fetches"), F.max("ts").alias("ended"))
        .select("host", F.col("w.start").alias("started"), "ended", "fetches")
    )


def fresh(cache: DataFrame, now: Column, ttl: int | None = None, stale_max_age: int | None = None) -> DataFrame:
    """Entries that may be served at ``now``: within the lesser of their and the asked ttl, or within the stale window."""
    if stale_max_age is not None and not 1 <= stale_max_age <= 86400:
        raise ValueError("stale_max_age must be between 1 and 86400")
    own = F.coalesce("ttl", F.lit(0))
    keep = F.lit(stale_max_age) if stale_max_age is not None else F.least(own, F.lit(ttl)) if ttl is not None else own
    return cache.filter(micros("fetched_at") + keep.cast("long") * 1_000_000 > micros(now))


def upserted(cache: DataFrame) -> DataFrame:
    """The last write of every key, by the time it was fetched, then stored, then by id."""
    return cache.groupBy("key").agg(F.max(F.struct("fetched_at", "stored_at", "entry_id")).alias("m")).select("key", "m.fetched_at", "m.entry_id")


def evicted(cache: DataFrame, most: int = 10_000) -> DataFrame:
    """The newest entries: all while there are at most ``most``, else nine tenths of that; ties by key."""
    from weft.plans.ranking import spread_rank

    rows = upserted(cache)
    n = rows.count()
    if n <= most:
        return rows
    return spread_rank(rows.withColumn("one", F.lit(1)), ["one"], [F.desc("fetched_at"), F.asc("key")], "r").filter(F.col("r") <= int(most * 0.9)).drop("one", "r")


def within_budget(rows: DataFrame, key: str, order: list[str], amount: str, limit: int) -> DataFrame:
    """(id, key, spent) of the rows (id first) whose running total per key stays within a budget; null amounts count as 0.

    Rows are put in order over all tasks and their places are known; totals run within stretches of places and
    are shifted by the stretches before, so that no task holds a hot key. The order must be total.
    """
    from weft.plans.ranking import spread_rank

    first = rows.columns[0]
    narrow = rows.select(F.col(first).alias("_id"), F.col(key).alias("_key"), F.coalesce(F.col(amount), F.lit(0)).cast("long").alias("_amount"), *[F.col(o).alias(f"_o{i}") for i, o in enumerate(order)])
    placed = spread_rank(narrow, ["_key"], [F.asc(f"_o{i}") for i in range(len(order))], "_place").withColumn("_stretch", F.floor((F.col("_place") - 1) / STRETCH))
    totals = placed.groupBy("_key", "_stretch").agg(F.sum("_amount").alias("_n"))
    before = totals.withColumn("_before", F.sum("_n").over(Window.partitionBy("_key").orderBy("_stretch")) - F.col("_n")).select(F.col("_key").alias("_k"), F.col("_stretch").alias("_s"), "_before")
    run = F.sum("_amount").over(Window.partitionBy("_key", "_stretch").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0))
    both = placed.withColumn("_run", run).join(before, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_stretch") == F.col("_s")))
    return both.withColumn("spent", F.col("_run") + F.col("_before")).filter(F.col("spent") <= limit).select(F.col("_id").alias(first), F.col("_key").alias(key), "spent")


def to_resume(wanted: DataFrame, done: DataFrame, key: str, retry_failed: bool = False) -> DataFrame:
    """What a resumed batch still has to do: wanted rows without record, and failed ones if asked."""
    finished = done.filter("ok") if retry_failed else done
    return wanted.join(finished.select(key).distinct(), key, "left_anti")


def key_turns(requests: DataFrame, keys: int, rest: float = 60.0, long_rest: float = 300.0) -> DataFrame:
    """(fetch_id, host, key_no): round robin over a host's keys; a limited key rests, a refused one longer; -1 if all rest.

    Requests are (fetch_id, host, us, status), the status being what the request then met.
    """

    def step(state: tuple, row: tuple) -> tuple:
        _, turn, until = state
        at = row[2] / 1e6
        free = next((k % keys for k in range(turn, turn + keys) if until[k % keys] <= at), -1)
        if free < 0:
            return -1, turn, until
        pause = rest if row[3] == 429 else long_rest if row[3] in (401, 403) else 0.0
        held = tuple(at + pause if k == free and pause else u for k, u in enumerate(until))
        return free, free + 1, held

    rows = requests.select("fetch_id", "host", "us", "status")
    return _fold(rows, "host", ["us", "fetch_id"], "fetch_id bigint, host string, value int", lambda: (-1, 0, (0.0,) * keys), step, pa.int32()).withColumnRenamed("value", "key_no")


def route_turns(requests: DataFrame, routes: int, rest: float = 60.0, direct: bool = False) -> DataFrame:
    """(fetch_id, host, route_no): round robin over routes, one that failed rests; where all rest the first, or -1 for none if a direct way is open.

    Requests are (fetch_id, host, us, status); a status of 0, 403, 429 or 5xx is a failure of the route.
    """

    def step(state: tuple, row: tuple) -> tuple:
        _, turn, until = state
        at, status = row[2] / 1e6, row[3]
        free = next((k % routes for k in range(turn, turn + routes) if until[k % routes] <= at), None)
        if free is None:
            return (-1 if direct else 0), turn, until
        failed = not status or status in BLOCKED or status >= 500
        return free, free + 1, tuple(at + rest if k == free and failed else u for k, u in enumerate(until))

    rows = requests.select("fetch_id", "host", "us", "status")
    return _fold(rows, "host", ["us", "fetch_id"], "fetch_id bigint, host string, value int", lambda: (-1, 0, (0.0,) * routes), step, pa.int32()).withColumnRenamed("value", "route_no")


def policy_reads(requests: DataFrame, found_seconds: int = 3600, missing_seconds: int = 300) -> DataFrame:
    """(fetch_id, host, read): whether a request has to read its host's rules again.

    Requests are (fetch_id, host, us, status), the status being what a read of the rules would give then.
    Rules that were found hold for an hour, missing ones for five minutes.
    """

    def step(state: tuple, row: tuple) -> tuple:
        _, until = state
        if until is not None and row[2] < until:
            return False, until
        held = found_seconds if row[3] is not None and 200 <= row[3] < 300 else missing_seconds
        return True, row[2] + held * 1_000_000

    rows = requests.select("fetch_id", "host", "us", "status")
    return _fold(rows, "host", ["us", "fetch_id"], "fetch_id bigint, host string, value boolean", lambda: (False, None), step, pa.bool_()).withColumnRenamed("value", "read")


def hits_in_time(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """(id, entry_id): the newest entry of each request's key that was still fresh when it came; null for none.

    Requests are (id, key, at, ttl), a null ttl asking for nothing less than the entry's own. An entry
    (entry_id, key, fetched_at, ttl) is fresh for the lesser of the two.
    """
    c = cache.select("entry_id", "key", micros("fetched_at").alias("f"), F.coalesce("ttl", F.lit(0)).cast("long").alias("own"))
    r = requests.select("id", "key", micros("at").alias("t"), F.col("ttl").alias("asked"))
    met = r.join(c, "key").filter((F.col("f") <= F.col("t")) & (F.col("f") + F.least("own", F.coalesce("asked", "own")).cast("long") * 1_000_000 > F.col("t")))
    best = met.groupBy("id").agg(F.max(F.struct("f", "entry_id")).alias("m")).select("id", F.col("m.entry_id").alias("entry_id"))
    return requests.select("id").join(best, "id", "left")

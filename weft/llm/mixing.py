"""Problem 8: sources mixed to target shares with capped repeats.

Min-cost flow for overlapping sources: documents are aggregated by membership pattern
(the sources that hold their text), each pattern's tokens are routed to the sources'
quotas, and using a text once more costs more each time, so that repeats are spread.
The flow runs over patterns, not documents; seeded documents then fill each route.

A source's documents serve its own quota alone, as a source's share is made of its own
documents; a text that several sources hold may fill any of their quotas, and its uses add up
over all of them, so that the flow takes texts that are used less before ones that are used more.
"""

from __future__ import annotations

import heapq
from decimal import ROUND_CEILING, Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.llm.common import pick
from weft.plans.staging import stage

#: Membership patterns that enter the flow; it is checked, and beyond it the smallest ones count under their sources alone.
MAX_PATTERNS = 5000
#: Buckets per route among which seeded selection looks for its last document.
BUCKETS = 1024


def source_key(c: Column | str) -> Column:
    """Sources are compared trimmed and lower-cased."""
    return F.lower(F.trim(F.col(c) if isinstance(c, str) else c))


class Flow:
    """Min-cost flow by successive shortest paths with potentials, in integers."""

    def __init__(self, nodes: int) -> None:
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.left: list[int] = []
        self.cost: list[int] = []

    def arc(self, a: int, b: int, capacity: int, cost: int = 0) -> int:
        k = len(self.to)
        for x, y, c, w in ((a, b, capacity, cost), (b, a, 0, -cost)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.left.append(c)
            self.cost.append(w)
        return k

    def through(self, arc: int) -> int:
        return self.left[arc ^ 1]

    def run(self, s: int, t: int) -> int:
        potential = [0] * len(self.out)
        sent = 0
        while True:
            far = [None] * len(self.out)
            via = [-1] * len(self.out)
            far[s] = 0
            heap = [(0, s)]
            while heap:
                d, a = heapq.heappop(heap)
                if d > far[a]:
                    continue
                for k in self.out[a]:
                    if self.left[k] > 0:
                        b = self.to[k]
                        nd = d + self.cost[k] + potential[a] - potential[b]
                        if far[b] is None or nd < far[b]:
                            far[b], via[b] = nd, k
                            heapq.heappush(heap, (nd, b))
            if far[t] is None:
                return sent
            most = max(x for x in far if x is not None)
            potential = [p + (most if x is None else x) for p, x in zip(potential, far)]
            amount, at = None, t
            while at != s:
                k = via[at]
                amount = self.left[k] if amount is None else min(amount, self.left[k])
                at = self.to[k ^ 1]
            at = t
            while at != s:
                k = via[at]
                self.left[k] -= amount
                self.left[k ^ 1] += amount
                at = self.to[k ^ 1]
            sent += amount


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(id, src, tokens, text_key): null texts have no tokens; tokens are UTF-8 bytes."""
    d = pick(docs, id=id_col, text=text_col, source=source_col)
    return d.select("id", source_key("source").alias("src"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("tokens"), F.xxhash64(F.lit(1), "text").alias("h1"), F.xxhash64(F.lit(2), "text").alias("h2"))


def targets_of(targets: DataFrame, source_col: str = "source", share_col: str = "target_share", repeats_col: str = "max_repeats") -> list[dict]:
    """The target rows, a configuration table of one row per source; rows without source or share are left out."""
    t = pick(targets, source=source_col, share=share_col, repeats=repeats_col).filter("source is not null and share is not null").select("source", source_key("source").alias("src"), "share", F.greatest(F.coalesce("repeats", F.lit(0)), F.lit(0)).alias("repeats")).distinct()
    rows = [r.asDict() for r in t.orderBy("src", "source").limit(100_001).collect()]
    if len(rows) > 100_000:
        raise ValueError("more than 100,000 mixing targets: that is no configuration table")
    return rows


def _of(documents: DataFrame, names: list[str]) -> DataFrame:
    """Documents of these sources; the names are those of a configuration table, at most 100,000."""
    named = documents.sparkSession.createDataFrame([(n,) for n in sorted(set(names))], "src string")
    return documents.join(F.broadcast(named), "src", "left_semi")


def patterns(documents: DataFrame, wanted: list[str]) -> tuple[DataFrame, list[dict]]:
    """Membership patterns: per text the wanted sources that hold it; then per (pattern, source) the tokens.

    A text's sources are distinct wanted names, so their set is bounded however often
    a text is repeated; both aggregations combine before they shuffle.
    """
    held = _of(documents, wanted).filter("tokens > 0")
    of_text = held.groupBy("h1", "h2", "src").agg(F.sum("tokens").alias("tokens"), F.max("tokens").alias("once"))
    grouped = of_text.groupBy("h1", "h2").agg(F.sort_array(F.collect_set("src")).alias("members"), F.max("once").alias("once"), F.collect_list(F.struct("src", "tokens")).alias("each"))
    totals = (
        grouped.select("members", "once", F.explode("each").alias("e"))
        .groupBy("members", F.col("e.src").alias("src"))
        .agg(F.sum("e.tokens").alias("tokens"), F.sum("once").alias("once"))
    )
    rows = [r.asDict() for r in totals.orderBy(F.desc("tokens"), "members", "src").limit(MAX_PATTERNS).collect()]
    return totals, rows


def plan(documents: DataFrame, targets: list[dict]) -> tuple[list[dict], list[dict]]:
    """(routes, sources): tokens of each (pattern, source) that are used, and what each source reaches.

    A route's members are None where it stands for its source's folded patterns.
    """
    total = documents.agg(F.sum("tokens")).first()[0] or 0
    names = [t["src"] for t in targets]
    of_source = {r["src"]: r["n"] for r in _of(documents, names).groupBy("src").agg(F.sum("tokens").alias("n")).collect()}
    _, rows = patterns(documents, names)
    kept: dict[str, int] = {}
    for r in rows:
        kept[r["src"]] = kept.get(r["src"], 0) + r["tokens"]
    for src, n in of_source.items():  # what lies beyond the bound counts under its source alone
        if n > kept.get(src, 0):
            rows.append({"members": [src], "src": src, "tokens": n - kept.get(src, 0), "once": n - kept.get(src, 0), "rest": True})
    members = {tuple(r["members"]) + (("rest",) if r.get("rest") else ()): [] for r in rows}
    for r in rows:
        members[tuple(r["members"]) + (("rest",) if r.get("rest") else ())].append(r)
    flow = Flow(2 + len(members) + len(targets))
    s, t = 0, 1
    node = {m: 2 + i for i, m in enumerate(members)}
    sink = {x["src"]: 2 + len(members) + i for i, x in enumerate(targets)}
    repeats = {x["src"]: int(x["repeats"]) for x in targets}
    quota = {x["src"]: int((Decimal(repr(x["share"])) * total).to_integral_value(ROUND_CEILING)) for x in targets}
    routes = []
    for m, parts in members.items():
        once = max(1, max(p["once"] for p in parts))
        most = sum(repeats[p["src"]] * p["tokens"] for p in parts)
        # the first use of a text costs nothing, the second 1, the next two 2, the next four 3 and so on
        used, cost = 0, 0
        while used < most:
            room = min(once * max(1, 1 << (cost - 1) if cost else 1), most - used)
            flow.arc(s, node[m], room, cost)
            used, cost = used + room, cost + 1
        for p in parts:
            routes.append((p, flow.arc(node[m], sink[p["src"]], repeats[p["src"]] * p["tokens"])))
    ends = {x["src"]: flow.arc(sink[x["src"]], t, quota[x["src"]]) for x in targets}
    flow.run(s, t)
    got = [{"members": None if p.get("rest") else p["members"], "src": p["src"], "tokens": p["tokens"], "used": flow.through(k)} for p, k in routes]
    sources = [
        {
            "source": x["source"], "src": x["src"], "target_share": float(x["share"]), "max_repeats": repeats[x["src"]], "tokens": of_source.get(x["src"], 0),
            "quota": quota[x["src"]], "used": flow.through(ends[x["src"]]), "total": total,
        }
        for x in targets
    ]
    return got, sources


_REPORT = T.StructType(
    [
        T.StructField("source", T.StringType()), T.StructField("src", T.StringType()), T.StructField("target_share", T.DoubleType()), T.StructField("max_repeats", T.IntegerType()),
        T.StructField("tokens", T.LongType()), T.StructField("quota", T.LongType()), T.StructField("used", T.LongType()), T.StructField("total", T.LongType()),
    ]
)


def report(docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per target: its tokens, quota, used tokens, actual share of what is mixed, mean repeats, and whether it falls short.

    Targets without documents get nothing; documents of sources without target are not
    used, but count in the total that the mix is to reach. Null texts have no tokens.
    """
    spark = docs.sparkSession
    documents = stage(sized(docs, id_col, text_col, source_col), "sized")
    _, sources = plan(documents, targets_of(targets))
    mixed = sum(x["used"] for x in sources)
    r = spark.createDataFrame([tuple(x[f.name] for f in _REPORT) for x in sources], _REPORT)
    return r.select(
        "source", "target_share", "max_repeats", "tokens", "quota", "used",
        (F.col("used") / F.lit(mixed or None)).alias("actual_share"), (F.col("used") / F.when(F.col("tokens") > 0, F.col("tokens"))).alias("mean_repeats"), (F.col("used") < F.col("quota")).alias("short"),
    )


def short_sources(docs: DataFrame, targets: DataFrame, **columns: str) -> DataFrame:
    """(source) of the targets whose quota the flow can't fill."""
    return report(docs, targets, **columns).filter("short").select("source").distinct()


def routes(docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(members, source, tokens, used, mean_uses): how many tokens of a source's documents each membership pattern gives it.

    ``members`` are the sources that hold the texts, null where a source's smallest patterns
    count together. Routes without use are shown too.
    """
    documents = stage(sized(docs, id_col, text_col, source_col), "sized")
    got, _ = plan(documents, targets_of(targets))
    known = docs.sparkSession.createDataFrame([(x["members"], x["src"], x["tokens"], x["used"]) for x in got], "members array<string>, source string, tokens bigint, used bigint")
    return known.withColumn("mean_uses", F.col("used") / F.col("tokens"))


def mix(docs: DataFrame, targets: DataFrame, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, source, tokens, copies): how often each document is used; unused ones give no row.

    Along each route every document is used as often as the route's tokens allow for
    all, and the rest is filled with documents in seeded order. The order is looked up
    in a histogram of hash buckets, so no route's documents are sorted in one task; a
    route may stay short of its tokens by less than one document.
    """
    spark = docs.sparkSession
    documents = stage(sized(docs, id_col, text_col, source_col), "sized")
    wanted = targets_of(targets)
    routes, _ = plan(documents, wanted)
    listed = _of(documents, [t["src"] for t in wanted]).filter("tokens > 0")
    members = listed.select("h1", "h2", "src").distinct().groupBy("h1", "h2").agg(F.sort_array(F.collect_set("src")).alias("members")).filter(F.size("members") > 1)
    known = spark.createDataFrame([(x["members"], x["src"], x["tokens"], x["used"]) for x in routes], "members array<string>, src string, route_tokens bigint, used bigint")
    own = known.filter("members is not null")
    rest = known.filter("members is null").select("src", F.col("route_tokens").alias("rest_tokens"), F.col("used").alias("rest_used"))
    each = (
        listed.join(members, ["h1", "h2"], "left").withColumn("members", F.coalesce("members", F.array("src")))
        .join(own, ["members", "src"], "left").join(rest, "src", "left")  # one row per document: its pattern's route, else its source's rest
        .withColumn("members", F.when(F.col("used").isNull(), F.array()).otherwise(F.col("members")))
        .withColumns({"route_tokens": F.coalesce("route_tokens", "rest_tokens"), "used": F.coalesce("used", "rest_used")})
        .filter("used > 0")
    )
    whole = F.floor(F.col("used") / F.col("route_tokens"))
    order = F.xxhash64("id", F.lit(seed))
    placed = stage(
        each.select("id", "members", "src", "tokens", whole.cast("int").alias("whole"), (F.col("used") - whole * F.col("route_tokens")).alias("rest"), F.pmod(order, F.lit(BUCKETS)).alias("bucket"), order.alias("at")),
        "placed",
    )
    from pyspark.sql import Window

    by_bucket = placed.groupBy("members", "src", "rest", "bucket").agg(F.sum("tokens").alias("n"))
    before = by_bucket.withColumn("before", F.sum("n").over(Window.partitionBy("members", "src").orderBy("bucket")) - F.col("n")).select("members", "src", "bucket", "before")
    inside = placed.join(before, ["members", "src", "bucket"])
    upto = F.col("before") + F.sum("tokens").over(Window.partitionBy("members", "src", "bucket").orderBy("at", "id").rowsBetween(Window.unboundedPreceding, 0))
    copies = F.col("whole") + F.when(upto <= F.col("rest"), 1).otherwise(0)
    return inside.withColumn("copies", copies.cast("int")).filter("copies > 0").select("id", F.col("src").alias("source"), "tokens", "copies")

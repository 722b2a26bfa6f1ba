"""Bounded walks over stored pages: rounds of joins instead of a queue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weft.functions import urls as U
from weft.plans.staging import stage


def reachable(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(node, depth): least depth of every node reached from the seeds within ``depth`` steps.

    Each round joins only the nodes that are new with the edges (src, dst) and is written
    to the shared folder, so lineage stays short and a lost executor loses nothing.
    """
    known = stage(seeds.select("node", F.lit(0).alias("depth")).distinct(), "walk0")
    front = known
    for step in range(1, depth + 1):
        found = edges.join(front.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct()
        front = stage(found.join(known, "node", "left_anti").select("node", F.lit(step).alias("depth")), f"walk{step}")
        if front.isEmpty():
            break
        known = known.unionByName(front)
    return known


def crawl(links: DataFrame, seeds: DataFrame, focus: list[str], max_pages: int = 100, max_depth: int = 3) -> DataFrame:
    """(page, depth, score): a best-first crawl with page and depth limits over (src, dst, text).

    Every round scores what the front links to, keeps each page's best offer, leaves out
    seen pages and assets, and takes the best up to the limit: the limits are the feature.
    """
    visited = stage(seeds.select(U.crawl_key("page").alias("page"), F.lit(0).alias("depth"), F.lit(0.0).alias("score")).filter("page <> ''").distinct().orderBy("page").limit(max_pages), "crawl0")
    left = max_pages - visited.count()
    front = visited
    for step in range(1, max_depth + 1):
        if left <= 0:
            break
        offers = links.join(front.select(F.col("page").alias("src")), "src").filter(~U.is_asset("dst"))
        scored = offers.select(U.crawl_key("dst").alias("page"), (U.link_score("dst", "text", focus) - 0.15 * step).alias("score")).filter("page <> ''")
        best = scored.groupBy("page").agg(F.max("score").alias("score")).join(visited, "page", "left_anti")
        front = stage(best.orderBy(F.desc("score"), "page").limit(left).select("page", F.lit(step).alias("depth"), "score"), f"crawl{step}")
        n = front.count()
        if not n:
            break
        left -= n
        visited = visited.unionByName(front)
    return visited


def per_host(pages: DataFrame, url: str, score: str, most: int) -> DataFrame:
    """The best pages of every host: per-partition limits run before the shuffle."""
    w = Window.partitionBy("host").orderBy(F.desc(score), url)
    return pages.withColumn("host", U.host(url)).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)

"""Parquet tables of one data directory, and the cache relation's encodings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory; pruning and pushdown reach the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cache_text(content: Column | str = "content") -> Column:
    """Text of a cache entry: its JSON array of strings joined by newlines.

    Null elements are left out; content that is no JSON array gives null.
    """
    return F.array_join(F.from_json(F.col(content) if isinstance(content, str) else content, "array<string>"), "\n")


def site_of(url: Column | str = "url") -> Column:
    """Host of a url, lower-cased, without credentials, leading ``www.`` and port; '' where there is none."""
    u = F.lower(F.trim(F.col(url) if isinstance(url, str) else url))
    authority = F.regexp_extract(u, r"^(?:[a-z][a-z0-9+.\-]*:)?//([^/?#\\]*)", 1)
    host = F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":[0-9]*$", "")
    return F.coalesce(F.regexp_replace(host, r"^www\.", ""), F.lit(""))


def latest_delivery(df: DataFrame, key: str, stamp: str) -> DataFrame:
    """Rows of the last delivery of each key (ties: any one of the equal rows' values stay together).

    The narrow (key, stamp) columns are aggregated first and only keys that were
    delivered more than once meet the wide rows, so texts are shuffled only when
    that set is too large for AQE to broadcast. Rows with a null key are kept.
    """
    late = (
        df.groupBy(F.col(key).alias("_k"))
        .agg(F.max(stamp).alias("_last"), F.count(F.lit(1)).alias("_n"))
        .filter("_n > 1 and _k is not null")
    )
    joined = df.join(late, df[key] == late["_k"], "left")
    once = joined.filter(F.col("_n").isNull()).drop("_k", "_last", "_n")
    again = joined.filter(F.col("_n").isNotNull() & F.col(stamp).eqNullSafe(F.col("_last"))).drop("_k", "_last", "_n")
    return once.unionByName(again.dropDuplicates([key]))

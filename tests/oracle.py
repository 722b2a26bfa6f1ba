"""Runs a query and its SQL over the same tables and compares the rows."""

import math
import os

import duckdb

SMALL = os.environ.get("WEFT_TEST_SF", "/root/testdata/sf0.001")


def views(folder: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in sorted(os.listdir(folder)):
        path = os.path.join(folder, f)
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


def plain(v):
    if v is None or str(v) in ("NaT", "<NA>", "nan"):
        return None
    v = v.item() if hasattr(v, "item") else v
    if isinstance(v, float):
        return None if math.isnan(v) else int(v) if v == int(v) else round(v, 5)
    return v


def rows(frame) -> list[str]:
    return sorted(str(tuple(plain(v) for v in r)) for r in frame[sorted(frame.columns)].itertuples(index=False, name=None))


def assert_same(spark, query, sql: str, folder: str = SMALL) -> None:
    ours, theirs = query(spark, folder).toPandas(), views(folder).sql(sql).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)

"""What the text operators share: decoding, batching, id handling."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.plans.staging import ensure_package

#: Characters that one vectorised step looks at together; it bounds a worker's memory, not the work.
STEP_CHARS = 1_000_000


def decode(content: str | None) -> str | None:
    """Text of a cache entry in Python: as ``weft.sources.tables.cache_text``."""
    if content is None:
        return None
    try:
        parts = json.loads(content)
    except ValueError:
        return None
    if not isinstance(parts, list):
        return None
    return "\n".join(x if isinstance(x, str) else json.dumps(x) for x in parts if x is not None)


def steps(sizes: list[int], most: int = STEP_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes add up to about ``most``; one longer row is a range of its own."""
    begin = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(sizes):
        yield begin, len(sizes)


def map_arrow(df: DataFrame, fn, schema: str) -> DataFrame:
    """``mapInArrow`` with the package shipped to executors that lack it."""
    ensure_package(df.sparkSession)
    return df.mapInArrow(fn, schema)


def batch(columns: dict[str, tuple[object, pa.DataType]]) -> pa.RecordBatch:
    """A record batch from {name: (values, type)}."""
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in columns.values()], names=list(columns))


def pick(df: DataFrame, **columns: str | Column) -> DataFrame:
    """Just the columns an operator reads, under its own names, so that extra or clashing columns don't matter."""
    return df.select(*[(F.col(f"`{c}`") if isinstance(c, str) else c).alias(name) for name, c in columns.items()])

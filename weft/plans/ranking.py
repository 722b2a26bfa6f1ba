"""Ranks within groups that may be hot."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weft.plans.staging import ensure_package, stage


def spread_rank(df: DataFrame, group: list[str], order: list[Column], name: str) -> DataFrame:
    """``row_number`` within groups, without holding a group in one task; null is a group of its own.

    One shuffle and one sort: rows are range-partitioned and sorted by group and order,
    numbered while they stream by, and shifted by what earlier partitions hold of their
    group. Just a partition's first group goes on from an earlier one, so the shifts
    are a row a partition and are broadcast. The order must be total; ties would come in any order.
    The numbered rows are staged, as they are read twice; pass narrow rows, and ones that
    are cheap to read again, since the ranges are found by sampling.
    """
    spark = df.sparkSession
    ensure_package(spark)
    at = [df.columns.index(g) for g in group]

    def number(batches):
        from pyspark import TaskContext

        part, last, count = TaskContext.get().partitionId(), None, 0
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            new = np.zeros(n, bool)
            for k in at:
                c = b.column(k)
                differ = pc.not_equal(c[1:], c[:-1])
                nulls = np.asarray(pc.is_null(c).to_numpy(zero_copy_only=False))
                new[1:] |= np.where(nulls[1:] | nulls[:-1], nulls[1:] != nulls[:-1], pc.fill_null(differ, False).to_numpy(zero_copy_only=False))
            first = tuple(b.column(k)[0].as_py() for k in at)
            new[0] = last is None or first != last
            begin = np.maximum.accumulate(np.where(new, np.arange(n), -1))
            local = np.arange(n) - begin + 1
            going_on = begin < 0
            local[going_on] = np.arange(1, going_on.sum() + 1) + count
            last, count = tuple(b.column(k)[n - 1].as_py() for k in at), int(local[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(n, part, np.int32)), pa.array(local.astype(np.int64))], names=[*b.schema.names, "_part", "_local"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    keys = [F.col(g).asc_nulls_first() for g in group]
    ranged = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    local = stage(ranged.mapInArrow(number, f"{schema}, _part int, _local bigint"), "ranks")
    held = local.groupBy("_part", *group).agg(F.max("_local").alias("_held"))
    before = held.withColumn("_before", F.sum("_held").over(Window.partitionBy(*group).orderBy("_part")) - F.col("_held")).filter("_before > 0")
    shift = F.broadcast(before.select(F.col("_part").alias("_p"), *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], "_before"))
    same = F.col("_part") == F.col("_p")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    return local.join(shift, same, "left").select(*df.columns, (F.col("_local") + F.coalesce("_before", F.lit(0))).cast("int").alias(name))

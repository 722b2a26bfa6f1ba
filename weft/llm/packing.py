"""Problem 7: documents packed into containers of fixed capacity, with a certificate.

Bound-certified repacking: each partition is packed by best-fit decreasing, and a
lower bound from dual-feasible functions says how many bins it needs at least. Where
the two differ, the partition's poorly filled bins are opened, their documents are
exchanged between partitions, and best-fit decreasing runs again over them.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import batch, map_arrow, pick
from weft.plans.staging import stage

CAPACITY = 4096
#: Items that one task packs together; the number of tasks grows with the data.
GROUP_ITEMS = 40_000
ROUNDS = 2


def best_fit_decreasing(sizes: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """Bin number of each item. Open bins are kept by their free space, and the bits of one integer tell which
    spaces occur, so an item finds the tightest bin in a few steps."""
    order = np.argsort(-sizes, kind="stable")
    bins = np.empty(len(sizes), np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, used = 0, 0
    for i in order.tolist():
        s = int(sizes[i])
        fitting = mask >> s
        if fitting:
            r = s + (fitting & -fitting).bit_length() - 1
            b = free[r].pop()
            if not free[r]:
                mask &= ~(1 << r)
        else:
            b, r = used, capacity
            used += 1
        bins[i] = b
        r -= s
        if r:
            free[r].append(b)
            mask |= 1 << r
    return bins


def lower_bound(sizes: np.ndarray, capacity: int = CAPACITY, counted: bool = False) -> int:
    """Bins that any packing needs at least: the best of two families of dual-feasible functions.

    ``counted``: ``sizes[x]`` is how many items have size ``x``.

    A function u on [0, 1] is dual-feasible if values that fit together keep a sum of
    at most 1; then the rounded-up sum of u over all items is a valid bound.
    """
    if not len(sizes):
        return 0
    count = sizes if counted else np.bincount(sizes, minlength=capacity + 1).astype(np.int64)
    value = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int((count * value).sum()) // capacity)
    for k in range(1, 21):  # steps: x -> floor((k+1)x)/k unless (k+1)x is whole
        scaled = (k + 1) * value
        u_num = np.where(scaled % capacity == 0, value * k, (scaled // capacity) * capacity)
        best = max(best, -(-int((count * u_num).sum()) // (capacity * k)))
    from_top, weight = np.cumsum(count[::-1])[::-1], np.cumsum(count * value)
    for eps in np.unique(np.r_[1, np.flatnonzero(count[: capacity // 2 + 1]), capacity // 2]):  # threshold: large -> 1, small -> 0
        if eps < 1:
            continue
        large = int(from_top[capacity - eps + 1]) if capacity - eps + 1 <= capacity else 0
        middle = int(weight[capacity - eps] - (weight[eps - 1] if eps else 0))
        best = max(best, large + -(-middle // capacity))
    return best


def _rounds(df: DataFrame, id_col: str, text_col: str, capacity: int, rounds: int, group_items: int) -> tuple[DataFrame, list[DataFrame]]:
    """(full pieces of split documents, packed items of each round, opened bins' items among them)."""
    sized = pick(df, id=id_col, text=text_col).select("id", F.octet_length("text").cast("long").alias("size")).filter("size > 0")
    cap = F.lit(capacity).cast("long")
    pieces = sized.select(
        "id", F.ceil(F.col("size") / cap).cast("int").alias("n_pieces"), F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, cap)).alias("_p", "_start"), "size"
    ).select(
        "id", (F.col("_p") + 1).cast("int").alias("piece_no"), "n_pieces", F.least(cap, F.col("size") - F.col("_start")).cast("int").alias("tokens")
    )
    items = stage(pieces, "items")
    full = items.filter(F.col("tokens") == capacity).select(
        "*", F.concat(F.lit("full:"), F.col("id").cast("string"), F.lit(":"), F.col("piece_no"), F.lit(":"), F.monotonically_increasing_id()).alias("container"), F.lit(capacity).alias("fill")
    )
    done, open_items = [], items.filter(F.col("tokens") < capacity)
    kind = df.schema[id_col].dataType.simpleString()
    for r in range(rounds + 1):
        n = open_items.count()
        if not n:
            break
        groups = max(1, math.ceil(n / group_items))
        spread = open_items.repartition(groups, F.xxhash64("id", "piece_no", F.lit(r)))
        packed = stage(
            map_arrow(spread, _packer(capacity, r, r == rounds), f"id {kind}, piece_no int, n_pieces int, tokens int, container string, fill int, kept boolean, part int, bound int"), f"packed{r}"
        )
        done.append(packed)
        open_items = packed.filter("not kept").select("id", "piece_no", "n_pieces", "tokens")
    return full, done


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, rounds: int = ROUNDS, group_items: int = GROUP_ITEMS) -> DataFrame:
    """Containers of all documents: (id, piece_no, n_pieces, tokens, container, fill).

    A document is split only if it alone exceeds the capacity; its pieces are full
    containers and a rest that is packed as an item. Tokens are UTF-8 bytes (one per
    byte for a byte-level tokenizer, end mark not counted). Null and empty texts have
    no tokens and give no row. Repeated ids are packed as often as they occur. The
    container is a string that is unique over the run; ``fill`` is its tokens.
    """
    out, done = _rounds(df, id_col, text_col, capacity, rounds, group_items)
    for packed in done:
        out = out.unionByName(packed.filter("kept").drop("kept", "part", "bound"))
    return out


def certificate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, rounds: int = ROUNDS, group_items: int = GROUP_ITEMS) -> DataFrame:
    """(round, part, items, bins, bound, gap): what is certified of the packing that ``pack`` gives for the same arguments.

    For every partition of every round, its bins, the least number that any packing of its
    items needs, and the difference; a partition with a gap opened bins for the next round.
    The row with a null round and part is the whole: all bins kept in the end, against the
    bound over all items, whose sizes are counted in a table of at most ``capacity`` rows.
    Without items there is no row.
    """
    full, done = _rounds(df, id_col, text_col, capacity, rounds, group_items)
    spark = df.sparkSession
    schema = "round int, part int, items bigint, bins bigint, bound bigint, gap bigint"
    out = None
    for r, packed in enumerate(done):
        each = packed.groupBy("part", "container").agg(F.count(F.lit(1)).alias("n"), F.max("bound").alias("bound")).groupBy("part").agg(F.sum("n").alias("items"), F.count(F.lit(1)).alias("bins"), F.max("bound").cast("bigint").alias("bound"))
        rows = each.select(F.lit(r).alias("round"), "part", "items", "bins", "bound", (F.col("bins") - F.col("bound")).alias("gap"))
        out = rows if out is None else out.unionByName(rows)
    whole, n_full = None, full.count()
    bins = n_full
    count = np.zeros(capacity + 1, np.int64)
    count[capacity] = n_full
    for packed in done:
        kept = packed.filter("kept")
        bins += kept.select("container").distinct().count()
        for row in kept.groupBy("tokens").count().collect():
            count[row["tokens"]] += row["count"]
    items = int(count.sum())
    bound = lower_bound(count, capacity, counted=True) if items else 0
    whole = spark.createDataFrame([(None, None, items, bins, bound, bins - bound)] if items else [], schema)
    return whole if out is None else whole.unionByName(out)


def _packer(capacity: int, round_no: int, last: bool):
    def run(batches):
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        t = pa.Table.from_batches(got)
        sizes = t.column("tokens").to_numpy().astype(np.int64)
        # the same items give the same bins when a lost task runs again
        order = np.lexsort((t.column("piece_no").to_numpy(), np.array([str(x) for x in t.column("id").to_pylist()]), -sizes))
        t, sizes = t.take(pa.array(order)), sizes[order]
        bins = best_fit_decreasing(sizes, capacity)
        fill = np.bincount(bins, weights=sizes).astype(np.int64)
        bound = lower_bound(sizes, capacity)
        gap = len(fill) - bound
        keep = np.ones(len(fill), bool)
        if gap > 0 and not last:
            # open the emptiest bins, with as many well filled ones as give the exchange room
            opened = np.argsort(fill, kind="stable")[: min(len(fill), 8 * gap + 8)]
            keep[opened] = False
        for s in range(0, len(sizes), 20_000):
            part_of = slice(s, s + 20_000)
            x = t.slice(s, 20_000).combine_chunks().to_batches()[0]
            yield batch(
                {
                    "id": (x.column("id"), x.schema.field("id").type),
                    "piece_no": (x.column("piece_no"), pa.int32()),
                    "n_pieces": (x.column("n_pieces"), pa.int32()),
                    "tokens": (x.column("tokens"), pa.int32()),
                    "container": ([f"r{round_no}:{part}:{b}" for b in bins[part_of].tolist()], pa.string()),
                    "fill": (fill[bins[part_of]].astype(np.int32), pa.int32()),
                    "kept": (keep[bins[part_of]], pa.bool_()),
                    "part": ([part] * x.num_rows, pa.int32()),
                    "bound": ([bound] * x.num_rows, pa.int32()),
                }
            )

    return run


def containers(packed: DataFrame) -> DataFrame:
    """One row per container with its fill: (container, items, fill)."""
    return packed.groupBy("container").agg(F.count(F.lit(1)).alias("items"), F.sum("tokens").alias("fill"))


def split_found(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id) of the documents that the packing had to split."""
    return pack(docs, capacity=capacity).filter("n_pieces > 1").select(F.col("id").alias("doc_id")).distinct()

"""Problem 3: records that share most of their word runs, found over a Gray-order hierarchical index.

Each text is its set of word runs (shingles) and gets a binary fingerprint: 16 bits of each
of 72 min-hashes, and one bit of each of 192. The share of differing bits follows the
sets' distance. The index is a hierarchy over fingerprints in Gray order:

* Upper nodes are masked bit patterns. A mask shows 48 bits of a fingerprint; in the order of
  the Gray rank of these bits, texts that share the pattern stand side by side.
* Below an upper node texts stand in Gray order of the 192 bits. Neighbours form lower nodes
  that keep the bits in which all agree; nodes of nodes keep fewer. The search goes down from
  the top with pairs of nodes, and the differences that have accumulated in the bits which
  both sides agree in prune all pairs below at once.
* An upper node with too many members for one task is split by further masked patterns, of other
  min-hashes, until its parts are small. Where its members are near each other on average, or
  four levels leave it large, it is cut into blocks in Gray order, and the pairs of blocks
  that what they agree in doesn't prune are compared.

What is left is checked exactly on the sets. Similarity 0.6 loses a pair at a chance of 0.3 % a
level with 24 masks, 0.7 at 0.005 %; all that is found is exact.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import decode, map_arrow, pick, steps
from weft.plans.staging import stage

RUN, SIMILARITY = 3, 0.6
#: Masks of an upper level, min-hashes that one shows, bits of each of these, and bits of the fingerprint's part below upper nodes.
MASKS, SHOWN, CELL, BITS = 24, 3, 16, 192
#: Members of an upper node that one task holds together; larger nodes are split by further patterns, LEVELS times at most.
NODE_LIMIT, LEVELS = 4096, 4
#: Neighbours in Gray order that form a lower node, and lower nodes that form the next.
LEAF, FAN = 16, 8
#: Texts with candidates up to which their names are broadcast (16 bytes each) to pick their sets; more are joined by shuffle.
BROADCAST_NAMES = 1_000_000

_U = np.uint64
_WORD = re.compile(r"[^\W_]+")
_LOW48 = _U((1 << 48) - 1)


def radius(similarity: float = SIMILARITY) -> int:
    """Differing bits within which sets of this similarity stay, but for four standard deviations."""
    p = (1 - similarity) / 2
    return int(BITS * p + 4 * (BITS * p * (1 - p)) ** 0.5)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def _constants(n: int, salt: int) -> np.ndarray:
    return _mix(np.arange(1 + salt, n + 1 + salt, dtype=_U) * _U(0x9E3779B97F4A7C15))


_A, _B = _constants(BITS + LEVELS * MASKS * SHOWN, 0) | _U(1), _constants(BITS + LEVELS * MASKS * SHOWN, 1000)


def shingle_sets(texts: list[str], run: int, least_words: int, seen: dict[str, int]) -> tuple[list[int], list[np.ndarray]]:
    """Numbers of the texts with enough words, and their sorted sets of 48-bit run hashes."""
    which, sets = [], []
    for i, t in enumerate(texts):
        words = _WORD.findall(t.lower())
        if len(words) < max(least_words, run):
            continue
        ids = []
        for w in words:
            h = seen.get(w)
            if h is None:
                h = xxhash.xxh3_64_intdigest(w)
                if len(seen) < 500_000 and len(w) < 40:
                    seen[w] = h
            ids.append(h)
        a = np.array(ids, _U)
        n = len(a) - run + 1
        h = np.zeros(n, _U)
        for k in range(run):
            h = _mix(h * _U(3) + a[k : k + n])
        which.append(i)
        sets.append(np.unique(h & _LOW48))
    return which, sets


def _pack(s: np.ndarray) -> bytes:
    """Six bytes a hash."""
    return s.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpack(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view("<u8")


def _hashed(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return _mix(np.concatenate(sets)), np.cumsum([0, *(len(s) for s in sets[:-1])])


def shown_bits(x: np.ndarray, starts: np.ndarray, level: int, mins: np.ndarray | None = None) -> np.ndarray:
    """The masked patterns of a level (n x MASKS): 48 bits, 16 of each of three min-hashes; each level has its own."""
    out = np.zeros((len(starts), MASKS), _U)
    first = 0 if level == 0 else BITS + (level - 1) * MASKS * SHOWN
    for i in range(MASKS * SHOWN):
        least = mins[:, i] if mins is not None else np.minimum.reduceat((x ^ _B[first + i]) * _A[first + i], starts)
        out[:, i // SHOWN] = (out[:, i // SHOWN] << _U(CELL)) | (_mix(least) >> _U(64 - CELL))
    return out


def fingerprints(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(masked patterns of the first level, n x MASKS; the 192 bits, n x 3 words)."""
    x, starts = _hashed(sets)
    mins = np.empty((len(sets), MASKS * SHOWN), _U)
    bits = np.zeros((len(sets), BITS // 64), _U)
    for i in range(BITS):
        least = np.minimum.reduceat((x ^ _B[i]) * _A[i], starts)
        if i < MASKS * SHOWN:
            mins[:, i] = least
        bits[:, i // 64] |= ((_mix(least) >> _U(17)) & _U(1)) << _U(63 - i % 64)
    return shown_bits(x, starts, 0, mins), bits


def gray_rank(words: np.ndarray) -> np.ndarray:
    """Place of each fingerprint in Gray order: the inverse Gray code, carried over its words."""
    out = words.copy()
    carry = np.zeros(len(words), _U)
    for k in range(words.shape[1]):
        x = out[:, k]
        for s in (1, 2, 4, 8, 16, 32):
            x = x ^ (x >> _U(s))
        x = np.where(carry == 1, ~x, x)
        out[:, k] = x
        carry = x & _U(1)
    return out


def gray_code(ranks: np.ndarray) -> np.ndarray:
    """The fingerprints at these places of the Gray order."""
    out = ranks ^ (ranks >> _U(1))
    out[:, 1:] ^= (ranks[:, :-1] & _U(1)) << _U(63)
    return out


class Tree:
    """Lower nodes over rows in Gray order: per level the bits in which all members agree, and these bits' values."""

    def __init__(self, bits: np.ndarray) -> None:
        self.n = len(bits)
        self.rows = np.concatenate([bits, np.repeat(bits[-1:], -self.n % LEAF, axis=0)])
        every, some = self.rows, self.rows
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []  # from the leaves up
        size = LEAF
        while not self.levels or len(every) > 1:
            at = np.arange(0, len(every), size)
            every, some = np.bitwise_and.reduceat(every, at), np.bitwise_or.reduceat(some, at)
            self.levels.append((every | ~some, every))
            size = FAN


def node_pairs(bits: np.ndarray, most: int, other: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows within ``most`` differing bits, of one set of rows or of two, both in Gray order.

    Goes down from the top with pairs of nodes. A node agrees in all bits that its parent
    does, so differences accumulate on the way; a pair with more than ``most`` is pruned.
    """
    if not len(bits) or (other is not None and not len(other)):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    one = Tree(bits)
    two = one if other is None else Tree(other)
    i, j = np.zeros(1, np.int64), np.zeros(1, np.int64)
    for k in range(max(len(one.levels), len(two.levels)) - 1, -1, -1):
        ka, kb = min(k, len(one.levels) - 1), min(k, len(two.levels) - 1)
        (ma, va), (mb, vb) = one.levels[ka], two.levels[kb]
        keep = np.bitwise_count((va[i] ^ vb[j]) & ma[i] & mb[j]).sum(1) <= most
        i, j = i[keep], j[keep]
        if k:
            i, j = _children(i, j, len(one.levels[k - 1][0]) if k == ka else 0, len(two.levels[k - 1][0]) if k == kb else 0, other is None)
    left, right = [], []
    inside = np.arange(LEAF)
    for s in range(0, len(i), 1024):
        a, b = i[s : s + 1024, None] * LEAF + inside, j[s : s + 1024, None] * LEAF + inside
        near = np.bitwise_count(one.rows[a][:, :, None] ^ two.rows[b][:, None]).sum(3, dtype=np.int32) <= most
        p, x, y = np.nonzero(near)
        x, y = a[p, x], b[p, y]
        ok = (x < one.n) & (y < two.n) & ((x < y) if other is None else True)
        left.append(x[ok])
        right.append(y[ok])
    return (np.concatenate(left), np.concatenate(right)) if left else (np.empty(0, np.int64), np.empty(0, np.int64))


def _children(i: np.ndarray, j: np.ndarray, n: int, m: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of children; ``n`` and ``m`` are the numbers of children, 0 for a side that has no level here."""
    step = np.arange(FAN)
    x = np.repeat(i[:, None] * FAN + step if n else i[:, None], FAN if m else 1, axis=1)
    y = np.tile(j[:, None] * FAN + step if m else j[:, None], (1, FAN if n else 1))
    x, y = x.ravel(), y.ravel()
    ok = ((x < n) if n else True) & ((y < m) if m else True) & ((x <= y) if same else True)
    return x[ok], y[ok]


def _sets_of(df: DataFrame, id_col: str, text_col: str, tag: str, run: int, least_words: int, encoded: bool) -> DataFrame:
    """(tbl, id, doc, size, set): ``doc`` names the set; a set is kept where a task meets it first."""
    kind = df.schema[id_col].dataType.simpleString()

    def work(batches):
        seen: dict[str, int] = {}
        met: set[int] = set()
        for b in batches:
            texts = [(decode(t) if encoded else t) or "" for t in b.column(1).to_pylist()]
            which, sets = shingle_sets(texts, run, least_words, seen)
            docs, kept = [], []
            for s in sets:
                packed = _pack(s)
                h = xxhash.xxh3_64_intdigest(tag.encode() + packed) - (1 << 63)
                docs.append(h)
                kept.append(None if h in met else packed)
                if len(met) < 2_000_000:
                    met.add(h)
            yield pa.RecordBatch.from_arrays(
                [pa.array([tag] * len(which), pa.string()), b.column(0).take(pa.array(which, pa.int64())), pa.array(docs, pa.int64()), pa.array([len(s) for s in sets], pa.int32()), pa.array(kept, pa.binary())],
                names=["tbl", "id", "doc", "size", "set"],
            )

    narrow = pick(df, id=id_col, text=text_col).filter("id is not null and text is not null")
    return map_arrow(narrow, work, f"tbl string, id {kind}, doc bigint, size int, set binary")


def _postings(docs: DataFrame, tags: list[str]) -> DataFrame:
    """(node, doc, r0, r1, r2): each distinct text below each of its upper nodes; ``r`` is its Gray rank there.

    A node is the Gray rank of its relation's number, its mask's number and the 48 bits that the mask shows.
    """
    number = {t: i for i, t in enumerate(tags)}

    def work(batches):
        for b in batches:
            packed = b.column(2).to_pylist()
            of = np.array([number[t] for t in b.column(0).to_pylist()], _U)
            for s, e in steps([len(p) for p in packed], 600_000):
                shown, bits = fingerprints([_unpack(p) for p in packed[s:e]])
                yield _below(shown | ((of[s:e, None] << _U(56)) | (np.arange(MASKS, dtype=_U) << _U(48))), b.column(1).slice(s, e - s).to_numpy(), gray_rank(bits))

    return map_arrow(docs.filter("set is not null").select("tbl", "doc", "set"), work, _POSTING)


_POSTING = "node bigint, doc bigint, r0 bigint, r1 bigint, r2 bigint"


def _below(patterns: np.ndarray, doc: np.ndarray, ranks: np.ndarray) -> pa.RecordBatch:
    node = gray_rank(patterns.reshape(-1, 1))[:, 0].view(np.int64)
    n = patterns.shape[1]
    wide = np.repeat(ranks, n, axis=0).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(node), pa.array(np.repeat(doc, n)), *(pa.array(np.ascontiguousarray(wide[:, k])) for k in range(3))], names=["node", "doc", "r0", "r1", "r2"])


def _split(docs: DataFrame, large: DataFrame, level: int) -> DataFrame:
    """Postings of the members of large nodes below the nodes' own parts: further masked patterns of a deeper level."""

    def prints(batches):
        for b in batches:
            sets = b.column(1).to_pylist()
            for s, e in steps([len(p) for p in sets], 600_000):
                x, starts = _hashed([_unpack(p) for p in sets[s:e]])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(s, e - s), pa.array([r.tobytes() for r in shown_bits(x, starts, level)], pa.binary())], names=["doc", "shown"])

    def work(batches):
        for b in batches:
            if not b.num_rows:
                continue
            shown = np.frombuffer(b"".join(b.column(5).to_pylist()), _U).reshape(-1, MASKS)
            node = _mix(b.column(0).to_numpy().view(_U))[:, None]
            # a part's name is its node's and its pattern's, as both must be shared
            ranks = np.stack([b.column(k).to_numpy() for k in range(2, 5)], 1).view(_U)
            yield _below(_mix(shown ^ node ^ (np.arange(MASKS, dtype=_U) << _U(50))), b.column(1).to_numpy(), ranks)

    members = stage(large.select("node", "doc", "r0", "r1", "r2").distinct(), "members")
    sets = docs.filter("set is not null").select("doc", "set").join(members.select("doc").distinct(), "doc", "left_semi").dropDuplicates(["doc"])
    return map_arrow(members.join(map_arrow(sets, prints, "doc bigint, shown binary"), "doc").select("node", "doc", "r0", "r1", "r2", "shown"), work, _POSTING)


_PAIRS = "a bigint, b bigint, node bigint, doc bigint, r0 bigint, r1 bigint, r2 bigint"
_NAMES = ["a", "b", "node", "doc", "r0", "r1", "r2"]


def _out(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    low, high = np.minimum(a, b), np.maximum(a, b)
    two = np.unique(np.stack([low, high], 1)[low != high], axis=0)
    none = pa.nulls(len(two), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(two[:, 0]), pa.array(two[:, 1]), none, none, none, none, none], names=_NAMES)


def _bits(rows: np.ndarray) -> np.ndarray:
    return gray_code(np.ascontiguousarray(rows[:, 2:]).view(_U))


def _search(most: int, limit: int):
    """Streams postings in order of node and Gray rank. Nodes of up to ``limit`` members are searched.

    Larger ones are passed on, and behind them a row without ``doc`` whose ``r0`` says whether two members
    differ by no more than ``most`` bits on average.
    """

    def work(batches):
        held: list[np.ndarray] = []  # rows of the last node, which may go on
        open_node, large, count = None, False, 0
        ones = np.zeros(BITS)

        def pass_on(rows: np.ndarray):
            nonlocal ones
            ones = ones + np.unpackbits(_bits(rows).view(np.uint8).reshape(len(rows), -1), axis=1).sum(0)
            none = pa.nulls(len(rows), pa.int64())
            return pa.RecordBatch.from_arrays([none, none, *(pa.array(np.ascontiguousarray(rows[:, k])) for k in range(5))], names=_NAMES)

        def close():
            nonlocal ones
            if large:
                share, ones = ones / count, np.zeros(BITS)
                none = pa.nulls(1, pa.int64())
                alike = int((2 * share * (1 - share)).sum() <= most)
                return pa.RecordBatch.from_arrays([none, none, pa.array([open_node], pa.int64()), none, pa.array([alike], pa.int64()), none, none], names=_NAMES)
            if not held:
                return None
            rows = np.concatenate(held)
            rows = rows[np.sort(np.unique(rows[:, 1], return_index=True)[1])]
            if len(rows) < 2:
                return None
            x, y = node_pairs(_bits(rows), most)
            return _out(rows[x, 1], rows[y, 1])

        for b in batches:
            if not b.num_rows:
                continue
            rows = np.stack([b.column(k).to_numpy() for k in range(5)], 1)
            cut = np.flatnonzero(np.r_[True, rows[1:, 0] != rows[:-1, 0]])
            sizes = np.diff(np.r_[cut, len(rows)])
            # nodes wholly inside the batch that are no more than one leaf: all of them at once
            inner = np.ones(len(cut), bool)
            inner[0] = inner[-1] = False
            leaves = inner & (sizes > 1) & (sizes <= LEAF)
            if leaves.any():
                part = rows[np.repeat(leaves, sizes)]
                bits = _bits(part)
                left, right = [], []
                for d in range(1, int(sizes[leaves].max())):
                    same = np.flatnonzero(part[d:, 0] == part[:-d, 0])
                    near = same[np.bitwise_count(bits[same] ^ bits[same + d]).sum(1) <= most]
                    left.append(part[near, 1])
                    right.append(part[near + d, 1])
                yield _out(np.concatenate(left), np.concatenate(right))
            for i in np.flatnonzero(~inner | (sizes > LEAF)):
                own = rows[cut[i] : cut[i] + sizes[i]]
                if open_node is not None and own[0, 0] != open_node:
                    if (found := close()) is not None:
                        yield found
                    held, large, count = [], False, 0
                open_node = int(own[0, 0])
                count += len(own)
                if large:
                    yield pass_on(own)
                    continue
                held.append(own)
                if count > limit:
                    large = True
                    yield pass_on(np.concatenate(held))
                    held = []
        if open_node is not None and (found := close()) is not None:
            yield found

    return work


def _in_blocks(large: DataFrame, most: int, block: int) -> DataFrame:
    """Pairs below nodes that no level has made small: blocks in Gray order over all tasks, block pairs pruned by what
    the blocks agree in, the others compared."""

    def cut(batches):
        from pyspark import TaskContext

        part, n, last, size = TaskContext.get().partitionId(), 0, None, 0
        for b in batches:
            ids = []
            for node in b.column(0).to_pylist():
                if node != last or size >= block:
                    n, last, size = n + 1, node, 0
                size += 1
                ids.append((part << 32) + n)
            bits = _bits(np.stack([b.column(k).to_numpy() for k in range(5)], 1)).view(np.int64) if b.num_rows else np.empty((0, 3), np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:5], *(pa.array(np.ascontiguousarray(bits[:, k])) for k in range(3)), pa.array(ids, pa.int64())], names=[*b.schema.names[:5], *words, "block"])

    words = ("w0", "w1", "w2")
    order = ("node", "r0", "r1", "r2", "doc")
    members = stage(large.select("node", "doc", "r0", "r1", "r2").distinct(), "large")
    blocks = stage(map_arrow(members.repartitionByRange(*order).sortWithinPartitions(*order), cut, f"{_POSTING}, w0 bigint, w1 bigint, w2 bigint, block bigint"), "blocks")
    summary = blocks.groupBy("node", "block").agg(*[F.bit_and(w).alias(f"e{w}") for w in words], *[F.bit_or(w).alias(f"s{w}") for w in words])
    x, y = summary.alias("x"), summary.alias("y")
    agreed = [F.bit_count(F.col(f"x.e{w}").bitwiseXOR(F.col(f"y.e{w}")).bitwiseAND(F.col(f"x.e{w}").bitwiseOR(F.bitwise_not(f"x.s{w}"))).bitwiseAND(F.col(f"y.e{w}").bitwiseOR(F.bitwise_not(f"y.s{w}")))) for w in words]
    near = x.join(y, (F.col("x.node") == F.col("y.node")) & (F.col("x.block") <= F.col("y.block"))).filter(sum(agreed[1:], agreed[0]) <= most).select(F.col("x.block").alias("p"), F.col("y.block").alias("q"))
    sides = near.select("p", "q", F.explode(F.array_distinct(F.array("p", "q"))).alias("block"))

    def compare(pdf):
        import pandas as pd

        p, q = int(pdf["p"].iloc[0]), int(pdf["q"].iloc[0])
        a, b = pdf[pdf["block"] == p].sort_values(["r0", "r1", "r2"]), pdf[pdf["block"] == q].sort_values(["r0", "r1", "r2"])
        bits = [np.ascontiguousarray(s[list(words)].to_numpy(np.int64)).view(_U) for s in (a, b)]
        i, j = node_pairs(bits[0], most, other=None if p == q else bits[1])
        da, db = a["doc"].to_numpy()[i], b["doc"].to_numpy()[j]
        return pd.DataFrame({"a": np.minimum(da, db), "b": np.maximum(da, db)})

    return sides.join(blocks, "block").groupBy("p", "q").applyInPandas(compare, "a bigint, b bigint").filter("a < b")


def _exact(similarity: float, limit_bytes: int = 1 << 22):
    def work(batches):
        for b in batches:
            keep = []
            for i, (x, y) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist())):
                x, y = _unpack(x), _unpack(y)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if both >= similarity * (len(x) + len(y) - both):
                    keep.append((i, both / (len(x) + len(y) - both)))
            at = pa.array([i for i, _ in keep], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array([j for _, j in keep], pa.float64())], names=["a", "b", "similarity"])

    return work


def similar(
    relations: list[tuple[DataFrame, str, str, str, int, bool]], run: int = RUN, similarity: float = SIMILARITY, node_limit: int = NODE_LIMIT
) -> tuple[DataFrame, DataFrame]:
    """(members, links) of near-duplicate texts within each relation.

    A relation is (DataFrame, id column, text column, tag, least words, whether the text
    is a cache's JSON). ``members`` has (tbl, id, doc): equal sets share a ``doc``, so
    copies are compared once, however many there are. ``links`` has (a, b, similarity),
    a < b, for every two different sets at or above the similarity. Null and short
    texts are left out; repeated ids come once.
    """
    parts = [_sets_of(df, i, t, tag, run, least, enc) for df, i, t, tag, least, enc in relations]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    docs = stage(union, "sets")
    most = radius(similarity)
    postings = _postings(docs, [r[3] for r in relations])
    found = []
    for level in range(LEVELS + 1):
        got = stage(map_arrow(postings.repartition("node").sortWithinPartitions("node", "r0", "r1", "r2"), _search(most, node_limit), _PAIRS), "near")
        found.append(got.filter("a is not null").select("a", "b"))
        named = got.filter("node is not null and doc is null").select("node", F.col("r0").alias("alike"))
        if named.isEmpty():
            break
        large = got.filter("node is not null and doc is not null").join(named, "node")
        # where most pairs are near, splitting finds the same pairs over and over
        if level == LEVELS or not named.filter("alike = 1").isEmpty():
            found.append(_in_blocks(large.filter("alike = 1") if level < LEVELS else large, most, node_limit))
        if level == LEVELS or named.filter("alike = 0").isEmpty():
            break
        postings = _split(docs, large.filter("alike = 0"), level + 1)
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    pairs = stage(pairs.distinct(), "pairs")
    needed = pairs.select(F.explode(F.array("a", "b")).alias("doc")).distinct()
    if needed.count() <= BROADCAST_NAMES:
        needed = F.broadcast(needed)
    sets = docs.filter("set is not null").select("doc", "set").join(needed, "doc", "left_semi").dropDuplicates(["doc"])
    sets = stage(sets, "needed")
    both = pairs.join(sets.select(F.col("doc").alias("a"), F.col("set").alias("set_a")), "a").join(sets.select(F.col("doc").alias("b"), F.col("set").alias("set_b")), "b").select("a", "b", "set_a", "set_b")
    links = stage(map_arrow(both, _exact(similarity), "a bigint, b bigint, similarity double"), "links")
    return docs.select("tbl", "id", "doc").distinct(), links


def all_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """(tbl, id_a, id_b), id_a < id_b: links between ids, and the pairs of equal texts."""
    m = stage(members, "members")
    x, y = m.alias("x"), m.alias("y")
    linked = (
        links.select("a", "b")
        .join(x, F.col("a") == F.col("x.doc"))
        .join(y, F.col("b") == F.col("y.doc"))
        .filter(F.col("x.tbl") == F.col("y.tbl"))
        .select(F.col("x.tbl").alias("tbl"), F.col("x.id").alias("i"), F.col("y.id").alias("j"))
    )
    several = m.groupBy("doc").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc")
    copies = stage(m.join(several, "doc", "left_semi"), "copies")
    equal = copies.select("doc", "tbl", F.col("id").alias("i")).join(copies.select("doc", F.col("id").alias("j")), "doc").filter("i < j").select("tbl", "i", "j")
    return linked.unionByName(equal).select("tbl", F.least("i", "j").alias("id_a"), F.greatest("i", "j").alias("id_b")).filter("id_a < id_b").distinct()


def classes(members: DataFrame, links: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(tbl, id, class_id, links): the connected class of every text, named by its least ``doc``, and the links of its set.

    Labels run along links and then jump to their label's label, so long chains need few
    rounds; each round is written to the shared folder.
    """
    edges = stage(links.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(links.select(F.col("b").alias("x"), F.col("a").alias("y"))), "edges")
    label = stage(edges.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("l")), "label")
    for _ in range(most_rounds):
        near = edges.join(label.select(F.col("x").alias("y"), F.col("l").alias("ly")), "y").groupBy("x").agg(F.min("ly").alias("m"))
        met = label.join(near, "x").select("x", F.least("l", "m").alias("n"), F.col("l").alias("was"))
        jump = met.join(met.select(F.col("x").alias("n"), F.col("n").alias("nn")), "n", "left").select("x", F.least("n", F.coalesce("nn", "n")).alias("l"), "was")
        label = stage(jump, "label")
        if label.filter("l != was").isEmpty():
            break
    else:
        raise RuntimeError("classes did not settle; raise most_rounds")
    degree = edges.groupBy("x").agg(F.count(F.lit(1)).alias("links"))
    named = label.select(F.col("x").alias("doc"), F.col("l").alias("class_id")).join(degree.withColumnRenamed("x", "doc"), "doc")
    return members.join(named, "doc", "left").select("tbl", "id", F.coalesce("class_id", "doc").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))

"""Problem 1: text repeated across one site's documents, found by content-defined chunks.

A rolling hash over the letters of a whole text, line breaks or none, cuts it into
content-defined chunks, and distinct documents are counted per chunk and site. Runs of
repeated chunks are cut out of the texts, wherever they stand.

Where lines are asked for, a line is named by the chunks, and the parts of its first and
last chunk, that it holds. A line is repeated if all of these are, which an exact count of
the same sequence of chunks then confirms.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import decode, map_arrow, pick, steps
from weft.plans.staging import stage
from weft.sources.tables import site_of

MIN_LETTERS, MIN_ENTRIES = 12, 5
#: Letters that the rolling hash sees, and the bits that must be zero at a cut (chunks of about 32 letters).
WINDOW, CUT_MASK = 8, 31
#: The same for lines: one cut in two is left out, and chunks are twice as long.
LINE_MASK = 63
#: Letters that a run of repeated chunks must have to be cut out of a text, so that common phrases stay.
MIN_RUN = 40

_SENTENCE_END = re.compile(r"[.!?…]+[\"')\]»”]*(?:\s+|(?=[^\W\d_a-z]))|\n")

_U = np.uint64
_tables: dict[str, np.ndarray] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads consecutive numbers over all bits."""
    x = x.astype(_U)
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def _table(name: str) -> np.ndarray:
    if name not in _tables:
        if name == "letter":
            made = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
        elif name == "gear":
            made = _mix(np.arange(1, 0x110001, dtype=_U) * _U(0x9E3779B97F4A7C15))
        else:
            base = _U(0xD6E8FEB86659FD93 if name == "powers1" else 0xA0761D6478BD642F)
            with np.errstate(over="ignore"):
                made = np.cumprod(np.full(1 << 16, base), dtype=_U)
        _tables[name] = made
    return _tables[name]


def _power(name: str, at: np.ndarray) -> np.ndarray:
    """base ** (at + 1) modulo 2**64."""
    t = _table(name)
    if not len(at) or at.max() < len(t):
        return t[at]
    return t[at & 0xFFFF] * _power_of_blocks(t[-1], at >> 16)


def _power_of_blocks(step: np.uint64, blocks: np.ndarray) -> np.ndarray:
    out = np.ones(int(blocks.max()) + 1, _U)
    if len(out) > 1:
        out[1:] = np.cumprod(np.full(len(out) - 1, step), dtype=_U)
    return out[blocks]


def _lower(t: str) -> str:
    """Lower case with every character in its place."""
    s = t.lower()
    return s if len(s) == len(t) else t.replace("İ", "i").lower()


class _Stream:
    """The letters of some texts, one after the other, and the cuts that the rolling hash puts between them.

    A cut stands behind a letter if the hash of the last letters of the same text says so; a hash that
    stays as it was, as in a run of one letter, cuts nothing.
    """

    def __init__(self, texts: list[str], mask: int = CUT_MASK) -> None:
        big = "\n".join(map(_lower, texts))
        self.codes = np.frombuffer(big.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.at = np.flatnonzero(_table("letter")[self.codes])
        self.code = self.codes[self.at]
        self.sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.first = np.cumsum(self.sizes + 1) - self.sizes - 1  # where each text begins
        self.begin = np.searchsorted(self.at, self.first)  # its first letter
        self.letters = np.diff(np.r_[self.begin, len(self.at)])
        self.gear = _table("gear")[self.code]
        h = self.gear.copy()
        for back in (1, 2, 4):  # after these, h covers the last 8 letters
            turned = (h << _U(9 * back)) | (h >> _U(64 - 9 * back))
            h[back:] ^= turned[:-back]
        same = np.zeros(len(h), bool)
        same[1:] = h[1:] == h[:-1]
        self.cut = (((h >> _U(20)) & _U(mask)) == 0) & ~same

    def since(self, begin: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """Each letter's place within the part it belongs to."""
        return np.arange(int(letters.sum())) - np.repeat(np.cumsum(letters) - letters, letters)


def _keys(gear: np.ndarray, starts: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent keys of each stretch of letters."""
    long = np.diff(np.r_[starts, total])
    within = np.arange(total) - np.repeat(starts, long)
    with np.errstate(over="ignore"):
        c1 = _mix(np.add.reduceat(gear * _power("powers1", within), starts) + long.astype(_U))
        c2 = _mix(np.add.reduceat((gear ^ (gear >> _U(29))) * _power("powers2", within), starts) + long.astype(_U))
    return c1, c2


def chunk_text(texts: list[str]):
    """Chunks of whole texts, as arrays: (text number, first character, character behind the last letter, letters, key)."""
    s = _Stream(texts)
    if not len(s.at):
        e = np.empty(0, np.int64)
        return e, e, e, e, e.astype(_U)
    pos = s.since(s.begin, s.letters)
    cut = s.cut & (pos >= WINDOW)
    full = np.flatnonzero(s.letters)
    cut[s.begin[full] + s.letters[full] - 1] = True
    ends = np.flatnonzero(cut)
    starts = np.r_[0, ends[:-1] + 1]
    key, _ = _keys(s.gear, starts, len(s.at))
    of = np.searchsorted(s.begin[full], starts, "right") - 1
    text_no = full[of]
    return text_no, s.at[starts] - s.first[text_no], s.at[ends] + 1 - s.first[text_no], ends + 1 - starts, key


def chunk_lines(texts: list[str], min_letters: int = MIN_LETTERS):
    """Lines with enough letters, as arrays: (text number, line number from 1, key1, key2, offsets into parts, parts).

    The parts are what the line holds of the text's chunks. Of the cuts only those count that letters of the
    line alone decide, so equal letters give equal parts and equal keys wherever a line stands.
    """
    s = _Stream(texts, LINE_MASK)
    e = np.empty(0, np.int64)
    none = e, e, e.astype(_U), e.astype(_U), np.zeros(1, np.int64), e.astype(_U)
    if not len(s.at):
        return none
    breaks = np.cumsum(s.codes == 10, dtype=np.int32)
    line = breaks[s.at]
    first = np.r_[0, breaks[s.first[1:] - 1]].astype(np.int64)  # number of each text's first line
    count = np.bincount(line, minlength=int(breaks[-1]) + 1 if len(breaks) else 1)
    enough = count >= min_letters
    keep = enough[line]
    if not keep.any():
        return none
    kept = np.flatnonzero(enough)
    size = count[kept]
    begin = np.cumsum(size) - size
    cut = s.cut[keep] & (s.since(begin, size) >= WINDOW)
    cut[begin + size - 1] = True
    ends = np.flatnonzero(cut) + 1
    starts = np.r_[0, ends[:-1]]
    c1, c2 = _keys(s.gear[keep], starts, len(cut))
    with np.errstate(over="ignore"):
        owner = np.searchsorted(begin, starts, "right") - 1
        off = np.r_[0, np.cumsum(np.bincount(owner, minlength=len(kept)))]
        nth = np.arange(len(starts)) - np.repeat(off[:-1], np.diff(off))
        k1 = _mix(np.add.reduceat(c1 * _power("powers2", nth), off[:-1]) + size.astype(_U))
        k2 = _mix(np.add.reduceat(c2 * _power("powers1", nth), off[:-1]) + size.astype(_U))
    text_no = np.searchsorted(first, kept, "right") - 1
    return text_no, kept - first[text_no] + 1, k1, k2, off, c1


def line_chunks(df: DataFrame, id_col: str, url_col: str, content_col: str, min_letters: int, encoded: bool) -> DataFrame:
    """(id, line_no, k1, k2, chunks): keys and chunks are bound to the site, so they count per site."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            ids, salts, contents = b.column(0), b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_pylist()
            texts = [(decode(c) if encoded else c) or "" for c in contents]
            for s, e in steps([len(t) for t in texts]):
                text_no, line_no, k1, k2, off, chunks = chunk_lines(texts[s:e], min_letters)
                with np.errstate(over="ignore"):
                    salt = _mix(salts[s:e].astype(np.int64).view(_U))[text_no]
                    bound = _mix(chunks ^ np.repeat(salt, np.diff(off)))
                    k1, k2 = _mix(k1 ^ salt), _mix(k2 + salt)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(s, e - s).take(pa.array(text_no)),
                        pa.array(line_no.astype(np.int32)),
                        pa.array(k1.view(np.int64)),
                        pa.array(k2.view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(bound.view(np.int64))),
                    ],
                    names=["id", "line_no", "k1", "k2", "chunks"],
                )

    narrow = pick(df, id=id_col, url=url_col, content=content_col).filter("id is not null and content is not null").select("id", F.xxhash64(site_of("url")).alias("salt"), "content")
    return map_arrow(narrow, run, f"id {kind}, line_no int, k1 bigint, k2 bigint, chunks array<bigint>")


def repeated_lines(
    df: DataFrame,
    id_col: str = "entry_id",
    url_col: str = "url",
    content_col: str = "content",
    min_letters: int = MIN_LETTERS,
    min_entries: int = MIN_ENTRIES,
    encoded: bool = True,
) -> DataFrame:
    """(id, line_no) of every line whose letters come back in at least ``min_entries`` distinct ids of its site.

    Deliveries of one id count once; null ids, null contents and lines with fewer than
    ``min_letters`` letters give no row; a null or hostless url makes a site of its own.
    Letters are Unicode letters of the lower-cased line. No row is dropped to escape
    skew: counts are aggregated before they are shuffled, and lines meet the repeated
    parts in a join that AQE may split.
    """
    lines = stage(line_chunks(df, id_col, url_col, content_col, min_letters, encoded), "lines")
    pieces = lines.select("id", F.explode("chunks").alias("chunk"))
    often = pieces.groupBy("chunk").agg(F.count_distinct("id").alias("n")).filter(F.col("n") >= min_entries).select("chunk")
    held = lines.select("id", "line_no", "k1", "k2", F.explode(F.array_distinct("chunks")).alias("chunk"), F.size(F.array_distinct("chunks")).alias("kinds"))
    candidates = stage(
        held.join(often, "chunk", "left_semi").groupBy("id", "line_no", "k1", "k2", "kinds").agg(F.count_distinct("chunk").alias("met")).filter("met = kinds").select("id", "line_no", "k1", "k2"),
        "candidates",
    )
    exact = candidates.groupBy("k1", "k2").agg(F.count_distinct("id").alias("n")).filter(F.col("n") >= min_entries).select("k1", "k2")
    return candidates.join(exact, ["k1", "k2"], "left_semi").select("id", "line_no").distinct()


def text_chunks(df: DataFrame, id_col: str, url_col: str, content_col: str, encoded: bool) -> DataFrame:
    """(id, chunk) of every chunk of every text, bound to its site, once a text."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            ids, salts = b.column(0), b.column(1).to_numpy(zero_copy_only=False)
            texts = [(decode(c) if encoded else c) or "" for c in b.column(2).to_pylist()]
            for s, e in steps([len(t) for t in texts]):
                text_no, _, _, letters, key = chunk_text(texts[s:e])
                text_no, key = text_no[letters >= WINDOW], key[letters >= WINDOW]
                yield pa.RecordBatch.from_arrays([ids.slice(s, e - s).take(pa.array(text_no)), pa.array(_bound(key, salts[s:e], text_no))], names=["id", "chunk"])

    narrow = pick(df, id=id_col, url=url_col, content=content_col).filter("id is not null and content is not null").select("id", F.xxhash64(site_of("url")).alias("salt"), "content")
    return map_arrow(narrow, run, f"id {kind}, chunk bigint")


def _bound(key: np.ndarray, salts: np.ndarray, text_no: np.ndarray) -> np.ndarray:
    """Keys that count per site."""
    return _mix(key ^ _mix(salts.astype(np.int64).view(_U))[text_no]).view(np.int64)


def without_repeats(
    df: DataFrame, id_col: str = "entry_id", url_col: str = "url", content_col: str = "content", min_entries: int = MIN_ENTRIES, min_run: int = MIN_RUN, encoded: bool = True
) -> DataFrame:
    """(id, text): every text without what comes back in at least ``min_entries`` distinct ids of its site.

    Runs of repeated chunks with at least ``min_run`` letters are cut out at the chunks' ends, in texts
    without line breaks too, and repeated lines whole, with the letters of chunks that reach over a
    line's ends. Null and undecodable contents come out as null; rows with a null id keep their text.
    One row per row of ``df``, so repeated ids give repeated rows.
    """
    kind = df.schema[id_col].dataType.simpleString()
    chunks = stage(text_chunks(df, id_col, url_col, content_col, encoded), "chunks")
    often = chunks.groupBy("chunk").agg(F.count_distinct("id").alias("n")).filter(F.col("n") >= min_entries).select("chunk")
    spans = chunks.join(often, "chunk", "left_semi").select("id", "chunk", F.lit(None).cast("int").alias("line_no"))
    lines = repeated_lines(df, id_col, url_col, content_col, min_entries=min_entries, encoded=encoded).select("id", F.lit(None).cast("bigint").alias("chunk"), "line_no")
    gone = spans.unionByName(lines).groupBy("id").agg(F.collect_set("chunk").alias("chunks"), F.collect_set("line_no").alias("lines"))
    texts = pick(df, id=id_col, url=url_col, content=content_col).select("id", F.xxhash64(site_of("url")).alias("salt"), "content").join(gone, "id", "left").select("id", "salt", "content", "chunks", "lines")

    def run(batches):
        for b in batches:
            salts = b.column(1).to_numpy(zero_copy_only=False)
            texts = [decode(c) if encoded else c for c in b.column(2).to_pylist()]
            known, lines = b.column(3).to_pylist(), b.column(4).to_pylist()
            for s, e in steps([len(t or "") for t in texts]):
                which = [i for i in range(s, e) if texts[i] and known[i]]
                cuts: dict[int, list] = {}
                if which:
                    text_no, begin, end, letters, key = chunk_text([texts[i] for i in which])
                    bound = _bound(key, salts[which], text_no)
                    edges = np.searchsorted(text_no, np.arange(len(which) + 1))
                    for k, i in enumerate(which):
                        own = slice(edges[k], edges[k + 1])
                        hit = np.isin(bound[own], np.array(known[i], np.int64))
                        cuts[i] = _runs(texts[i], hit, begin[own], end[own], letters[own], min_run)
                out = [_cut(texts[i], cuts.get(i, ()), set(lines[i] or ())) for i in range(s, e)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(s, e - s), pa.array(out, pa.string())], names=["id", "text"])

    return map_arrow(texts, run, f"id {kind}, text string")


def _runs(text: str, hit: np.ndarray, begin: np.ndarray, end: np.ndarray, letters: np.ndarray, least: int) -> list[tuple[int, int]]:
    """(first character, character behind the last) of the runs of repeated chunks with enough letters.

    Chunks of a few letters between two repeated ones go along. A run is widened to the ends of its
    first and last sentence, on each side by no more than it holds.
    """
    out: list[tuple[int, int]] = []
    small = letters < WINDOW
    i, n = 0, len(hit)
    while i < n:
        if not hit[i]:
            i += 1
            continue
        j, last, total = i, i, 0
        while j < n and (hit[j] or small[j]):
            if hit[j]:
                last = j
            total += int(letters[j])
            j += 1
        if total >= least:
            s, e = int(begin[i]), int(end[last])
            most = e - s
            low, high = max(0, s - most, out[-1][1] if out else 0), min(len(text), e + most)
            starts = [m.end() for m in _SENTENCE_END.finditer(text, low, s) if m.end() <= s]
            s = starts[-1] if starts else 0 if low == 0 else s
            stop = _SENTENCE_END.search(text, e, high)
            e = stop.end() if stop else len(text) if high == len(text) else e
            out.append((s, e))
        i = j
    return out


def _cut(text: str | None, spans, lines: set[int]) -> str | None:
    if not text or not (spans or lines):
        return text
    kept, at = [], 0
    for s, e in spans:
        # line breaks stay, so that lines keep their numbers until they are cut
        kept += [text[at:s], "\n" * text.count("\n", s, e)]
        at = e
    kept.append(text[at:])
    rest = "".join(kept).split("\n")
    was = text.split("\n")
    return "\n".join(r for n, (r, w) in enumerate(zip(rest, was), 1) if n not in lines and (r == w or r.strip()))


def without_lines(df: DataFrame, found: DataFrame, id_col: str, text) -> DataFrame:
    """(id, text) with the found lines cut out of each text; texts without any come out as they are."""
    gone = found.groupBy("id").agg(F.collect_set("line_no").alias("gone"))
    texts = df.select(F.col(id_col).alias("id"), text.alias("text"))
    left = F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains("gone", i + 1))
    return texts.join(gone, "id", "left").select("id", F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(left, "\n")).alias("text"))

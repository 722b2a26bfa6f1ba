"""Problem 5: items over a size limit cut into overlapping pieces at natural boundaries.

Balanced targets: the least number of pieces that can hold the text is computed,
targets are placed at equal lengths, each is snapped to the strongest boundary
near it, and a piece is added when any limit fails.
"""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import batch, decode, map_arrow, pick

LIMIT, OVERLAP = 6000, 200
#: Pieces beyond the least number that may be added so that no cut stands off a boundary.
EXTRA = 2

#: Boundaries from strong to weak: a cut may stand at the end of a match.
BOUNDARIES = (
    re.compile(r"\n[ \t]*\n\s*|\n(?=#{1,6} )"),
    re.compile(r"\n"),
    re.compile(r"[.!?…]+[\"')\]»”]*\s+"),
    re.compile(r"[;:,]\s+|\s[–—-]\s+"),
    re.compile(r"\s+"),
)
_RUN = re.compile(r"\S+")


def cuts(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[int]:
    """Positions that cut ``text``; each piece after the first begins ``overlap`` before its cut.

    Near the target the strongest boundary is taken, the nearest of its strength (ties:
    the earlier one). Where none is near, the strongest within the whole range in which the
    cut may stand; where there is none either, as within a long unbroken run, the cut stands
    at the target itself, moved back out of a combining sequence.
    """
    n = len(text)
    if n <= limit:
        return []
    fresh = limit - overlap
    least = -(-(n - overlap) // fresh)
    best: tuple[int, list[int]] | None = None
    pieces = least
    while best is None or (best[0] and pieces <= least + EXTRA):
        found, forced = _place(text, pieces, limit, overlap)
        if found is not None and (best is None or forced < best[0]):
            best = forced, found
        pieces += 1
    return best[1]


def _place(text: str, pieces: int, limit: int, overlap: int) -> tuple[list[int] | None, int]:
    """(cuts for this number of pieces or None, how many of them stand at no boundary)."""
    n, fresh = len(text), limit - overlap
    length = (n + (pieces - 1) * overlap) / pieces
    reach = max(1, min(limit // 6, int(length / 3)))
    found: list[int] = []
    forced = 0
    for i in range(1, pieces):
        last = found[-1] if found else 0
        begin = last - overlap if found else 0
        target = round(length + (i - 1) * (length - overlap))
        # what is behind the cut must still fit into the pieces that are left
        low = max(last + 1, begin + overlap + 1, n - (pieces - i) * fresh)
        high = min(begin + limit, n - 1)
        if low > high:
            return None, 0
        at, natural = _snap(text, min(max(target, low), high), low, high, reach)
        found.append(at)
        forced += not natural
    return (found, forced) if n - (found[-1] - overlap) <= limit else (None, 0)


def _snap(text: str, target: int, low: int, high: int, reach: int) -> tuple[int, bool]:
    for a, b in ((max(low, target - reach), min(high, target + reach)), (low, high)):
        for boundary in BOUNDARIES:
            near = [m.end() for m in boundary.finditer(text, max(0, a - 40), b) if a <= m.end() <= b]
            if near:
                return min(near, key=lambda p: (abs(p - target), p)), True
    while target > low and (unicodedata.combining(text[target]) or text[target] == "\u200d"):
        target -= 1
    return target, False


def longest_run(text: str) -> int:
    """Characters of the longest stretch without whitespace."""
    return max((m.end() - m.start() for m in _RUN.finditer(text)), default=0)


def split_oversized(
    df: DataFrame, id_col: str = "entry_id", content_col: str = "content", limit: int = LIMIT, overlap: int = OVERLAP, encoded: bool = True
) -> DataFrame:
    """Pieces of every text longer than ``limit`` code points.

    Result: (id, n_chars, longest_run, n_pieces, piece_no, start, piece); piece ``k``
    is ``text[start : start + len(piece)]``, holds at most ``limit`` characters, and
    after the first begins with the last ``overlap`` characters of the one before.
    Texts within the limit, nulls and content that can't be decoded give no row.
    Repeated rows are cut once each; no shuffle is needed.

    ``encoded``: the column holds JSON arrays, whose raw length bounds the text's,
    so the scan filters before any row reaches Python.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and less than limit")
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            rows: list[tuple] = []
            for key, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                text = decode(content) if encoded else content
                if text is None or len(text) <= limit:
                    continue
                at = cuts(text, limit, overlap)
                run_of = longest_run(text)
                begins = [0, *[c - overlap for c in at]]
                for k, (s, e) in enumerate(zip(begins, [*at, len(text)]), 1):
                    rows.append((key, len(text), run_of, len(begins), k, s, text[s:e]))
            cols = list(zip(*rows)) if rows else [[]] * 7
            yield batch(
                {
                    "id": (list(cols[0]), b.schema.field(0).type),
                    "n_chars": (list(cols[1]), pa.int32()),
                    "longest_run": (list(cols[2]), pa.int32()),
                    "n_pieces": (list(cols[3]), pa.int32()),
                    "piece_no": (list(cols[4]), pa.int32()),
                    "start": (list(cols[5]), pa.int32()),
                    "piece": (list(cols[6]), pa.string()),
                }
            )

    narrow = pick(df, id=id_col, content=content_col).filter(F.length("content") > limit)
    return map_arrow(narrow, run, f"id {kind}, n_chars int, longest_run int, n_pieces int, piece_no int, start int, piece string")


def oversized_found(entries: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(entry_id, kind): texts that were cut, and those with a run longer than the limit."""
    first = split_oversized(entries, limit=limit, overlap=overlap).filter("piece_no = 1")
    kinds = F.explode(F.when(F.col("longest_run") > limit, F.array(F.lit("oversized"), F.lit("unbroken"))).otherwise(F.array(F.lit("oversized"))))
    return first.select(F.col("id").alias("entry_id"), kinds.alias("kind")).distinct()

"""Problem 2: text of scanned pages repaired into continuous paragraphs.

Skip-gram vectors are learned over the corpus: pairs of words within a window are counted,
and a word's vector projects its shifted mutual information with all others, the matrix that
skip-grams with negative sampling factorise. Rare words are linked to frequent ones that
plausible glyph edits turn them into. Each link is judged where the word stands: how
much more frequent the other word is, and whether the words around it are such as stand
around that word (or around any word), by the similarities that both have in the corpus.
Then page furniture is cut off, words broken at line ends are joined, and lines flow into
paragraphs. Counts, vectors and similarities cover all documents.
"""

from __future__ import annotations

import difflib
import math
import re
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import map_arrow, pick
from weft.plans.staging import stage

#: A word is known from this count on.
LEAST_COUNT = 5
#: How many times as frequent as a word its correction must be if the words around tell nothing.
DOMINANCE = 20
#: Log odds that the words around can add against a correction and in favour of it: a factor of 4.5 in frequency.
AGAINST, IN_FAVOUR = 1.5, 1.5
#: Deviations that true and chance similarities must lie apart for the words around to tell anything.
APART = 0.25
#: Documents in whose page edges a template must recur, and how many of the lines of that form must stand there.
TEMPLATE_DOCS, TEMPLATE_EDGE = 4, 0.5
#: Counts from which a word may be a fixed one of a template; names may be as frequent as the first.
TEMPLATE_COUNTS = (5, 16)
#: Words to each side that form skip-gram pairs, the times that a pair must come, and dimensions (bits of a hash).
WINDOW, PAIR_COUNT, DIMENSIONS = 4, 2, 64
HYPHENS = "-­‐¬"

# What a scanner reads, and what may have been printed.
GLYPHS = {
    "0": ("o",), "1": ("l", "i"), "!": ("i", "l"), "|": ("l", "i"), "5": ("s",), "6": ("b",), "8": ("b",), "9": ("g",), "$": ("s",), "3": ("e",), "4": ("a",), "7": ("t",),
    "c": ("e", "o"), "e": ("c",), "f": ("t",), "t": ("f",), "b": ("h",), "h": ("b", "li", "n"), "l": ("i", "t"), "i": ("l",), "j": ("i",), "q": ("g",), "u": ("n", "ii"), "n": ("u", "ri"), "o": ("e", "a"), "y": ("v",), "v": ("y",),
    "rn": ("m",), "m": ("rn",), "vv": ("w",), "w": ("vv",), "ii": ("u",), "ri": ("n",), "cl": ("d",), "d": ("cl",), "li": ("h",), "ni": ("m",), "nn": ("m",), "lc": ("k",), ".": ("",), "'": ("",),
}
_EDGE = ".,;:()[]{}\"“”„»«?…"
_TOKEN = re.compile(r"\S+")
_NUMERIC = re.compile(r"[\d.,:%/+\-–°€$£]+(?:st|nd|rd|th)?|[ivxlcdm]+", re.I)
_PAGE_NO = re.compile(r"(?:(?P<word>p[a-z]?[gq][ceo]|pa ?ge|p\.?|seite|s\.|pág\.?|str\.)\s*)?(?P<open>[\[(\-–—|]*)\s*(?P<n>[0-9A-Za-z!|]{1,7})\s*(?P<close>[\])\-–—|]*)(?P<of>\s+(?:of|0f|oí|ot|von|de|sur|/)\s+[0-9A-Za-z!|]{1,5})?", re.I)
_DIGIT = str.maketrans({"l": "1", "I": "1", "i": "1", "!": "1", "|": "1", "O": "0", "o": "0", "S": "5", "s": "5", "B": "8", "b": "6", "g": "9", "q": "9", "Z": "2", "z": "2", "t": "7"})
_ROMAN = re.compile(r"(?=[ivxl])(x{0,3}|xl|l?x{0,3})(ix|iv|v?i{0,3})")
_SKELETON = str.maketrans({"0": "o", "1": "i", "!": "i", "|": "i", "l": "i", "j": "i", "5": "s", "$": "s", "6": "b", "8": "b", "h": "b", "9": "g", "q": "g", "c": "e", "3": "e", "f": "t", "7": "t"})


#: What glyphs come to when all that are taken for each other fall together: round ones, strokes (any number), and the rest.
_STROKES = str.maketrans({**dict.fromkeys("0oeca34", "o"), **dict.fromkeys("1li!|jtf7rhbnu68m", "l"), "5": "s", "$": "s", "9": "g", "q": "g", "y": "v", "w": "vv", "d": "ol", "k": "lo", ".": "", "'": ""})
_RUNS = re.compile(r"l{2,}")


def strokes(w: str) -> str:
    """A word's shape: no glyph edit changes it."""
    return _RUNS.sub("l", plain(w).translate(_STROKES))


def plain(s: str) -> str:
    """Without accents."""
    return s if s.isascii() else "".join(c for c in unicodedata.normalize("NFD", s) if not unicodedata.combining(c))


def skeleton(s: str) -> str:
    """What is left of a line when glyphs that are taken for each other look alike and blanks and points don't count."""
    s = re.sub(r"[^a-z0-9!|$]", "", plain(s.lower())).translate(_SKELETON)
    return s.replace("rn", "m").replace("vv", "w").replace("ii", "u").replace("ri", "n").replace("ei", "d")


def bare(token: str) -> str:
    """A token without outer punctuation and possessive ending, lower-cased."""
    w = token.strip(_EDGE).rstrip("!").lower().replace("’", "'")
    return w[:-2] if w.endswith("'s") else w


def words_of(pages: list[str]) -> Counter:
    """Words within lines; the last of a line that ends in a hyphen and the first of the next are no whole words."""
    out: Counter = Counter()
    for page in pages:
        broken = False
        for line in (page or "").split("\n"):
            tokens = _TOKEN.findall(line)
            if not tokens:
                continue
            ends = tokens[-1][-1] in HYPHENS and len(tokens[-1]) > 1
            out.update(bare(t) for t in tokens[1 if broken else 0 : len(tokens) - ends])
            broken = ends
    out.pop("", None)
    return out


class Context:
    """Whether words stand around a word as they do around another: similarities in the corpus, true and by chance.

    ``true`` and ``chance`` are (mean, deviation) of the similarity between a word's vector and
    the words around it, and around other words.
    """

    def __init__(self, vectors: dict[str, np.ndarray], true: tuple[float, float] = (0.0, 1.0), chance: tuple[float, float] = (0.0, 1.0)) -> None:
        self.vectors, self.true, self.chance = vectors, true, chance
        self._signs: dict[str, np.ndarray] = {}

    def odds(self, v: str, around: list[str]) -> float:
        """Log odds that ``v`` was printed among these words against any other word; 0 where nothing is known."""
        own = self.vectors.get(v)
        near = [x for x in around if x in self.vectors]
        if own is None or len(near) < 2:
            return 0.0
        total = np.zeros(DIMENSIONS, np.float32)
        for x in near:
            if x not in self._signs:
                self._signs[x] = signs([x])[0]
            total += self._signs[x]
        (m1, d1), (m0, d0) = self.true, self.chance
        if m1 - m0 < APART * (d0 + d1) / 2:  # words are no more at home where they stand than elsewhere
            return 0.0
        x = float(np.dot(total, own)) / float(np.linalg.norm(total) or 1.0)
        x = min(max(x, m0 - d0), m1 + d1)  # beyond, the tails of the two say nothing
        odds = math.log(d0 / d1) + (x - m0) ** 2 / (2 * d0 * d0) - (x - m1) ** 2 / (2 * d1 * d1)
        return min(max(odds, -AGAINST), IN_FAVOUR)


def signs(words: list[str]) -> np.ndarray:
    """The axes that words project onto: 64 signs of their hashes, so that different words are nearly orthogonal."""
    h = np.array([xxhash.xxh3_64_intdigest(w) for w in words], "<u8")
    return np.unpackbits(h.view(np.uint8).reshape(len(words), 8), axis=1).astype(np.float32) * 2 - 1


class Lexicon:
    """Known words, the counts of rarer ones that come more than once, contexts, and corrections (kept per worker)."""

    def __init__(self, counts: dict[str, int], context: Context | None = None, templates: frozenset[str] = frozenset(), rare: dict[str, int] | None = None) -> None:
        self.counts, self.context, self.templates, self.rare = counts, context or Context({}), templates, rare or {}
        self.most = max(counts.values(), default=0)
        self._candidates: dict[str, tuple[str, ...]] = {}
        self._tokens: dict[str, tuple[str, bool, bool]] = {}
        self._shapes = None
        self._of_strokes: set[str] | None = None

    def __getstate__(self):
        return self.counts, self.context, self.templates, self.rare

    def __setstate__(self, state):
        self.__init__(*state)

    def times(self, w: str) -> int:
        """How often a word comes, 1 at least."""
        return self.counts.get(w) or self.rare.get(w, 1)

    def token(self, token: str) -> tuple[str, bool, bool]:
        """(word, whether it may be misread, whether it may be a part of a word) of a token as it stands."""
        got = self._tokens.get(token)
        if got is None:
            w = bare(token)
            judged = bool(w) and not w.isdigit() and (bool(self.linked(w)) or (w not in self.counts and _odd_glyphs(token.strip(_EDGE))))
            got = w, judged, w.isalpha() and DOMINANCE * self.times(w) <= self.most
            if len(self._tokens) < 400_000:
                self._tokens[token] = got
        return got

    def candidates(self, w: str) -> tuple[str, ...]:
        """More frequent words that one or two plausible glyph edits make of ``w``; how much more, the words around decide."""
        got = self._candidates.get(w)
        if got is None:
            need = DOMINANCE * math.exp(-IN_FAVOUR) * self.times(w)
            first = _edits(w) if self.has_shape(w) else ()
            got = tuple(sorted({v for v in first if self.counts.get(v, 0) >= need}))
            if first and not got and 4 <= len(w) <= 24:
                need = DOMINANCE * self.times(w)
                got = tuple(sorted({v for f in first for v in _edits(f) if self.counts.get(v, 0) >= need and v != w}))
            if len(self._candidates) < 200_000:
                self._candidates[w] = got
        return got

    def has_shape(self, w: str) -> bool:
        """Whether a known word has this shape, as every correction has."""
        if self._of_strokes is None:
            self._of_strokes = set(map(strokes, self.counts))
        return strokes(w) in self._of_strokes

    def linked(self, w: str) -> tuple[str, ...]:
        """What ``w`` may have been printed as, whatever stands around it."""
        if len(w) < 2 or (_NUMERIC.fullmatch(w) and w not in ("i", "c")):
            return ()
        parts = w.split("-") if "-" in w and w not in self.counts else ()
        return self.candidates(w) or tuple(c for p in parts for c in self.linked(p))

    def correct(self, w: str, around: list[str] = ()) -> str | None:
        """The word that ``w`` was most likely printed as among these words, None if it is fine as it is."""
        if len(w) < 2 or (_NUMERIC.fullmatch(w) and w not in ("i", "c")):
            return None
        found = self.candidates(w)
        if not found:
            if "-" in w and w not in self.counts:
                parts = [(p, self.correct(p, around)) for p in w.split("-")]
                whole = "-".join(c or p for p, c in parts)
                return whole if any(c for _, c in parts) else None
            return None
        own = math.log(DOMINANCE * self.times(w))
        odds, _, best = max((math.log(self.counts[v]) - own + self.context.odds(v, around), self.counts[v], v) for v in found)
        return best if odds >= 0 else None

    def masks(self, text: str) -> list[str]:
        """A line's templates: words kept, names and numbers not; one for each count from which a word is kept."""
        out = [[] for _ in TEMPLATE_COUNTS]
        for t in text.split():
            w = self.token(t)[0]
            if not w:
                continue
            n = self.times(w)
            if n < TEMPLATE_COUNTS[-1]:
                w = (None if _number(w) is not None and any(c.isdigit() for c in w) else self.correct(w)) or w
                n = self.times(w)
            number = any(c.isdigit() for c in w) and _number(w) is not None
            for kept, least in zip(out, TEMPLATE_COUNTS):
                kept.append("0" if number else w if n >= least else "@")
        return list(dict.fromkeys(" ".join(x) for x in out))

    def is_template(self, text: str) -> bool:
        if not self.templates:
            return False
        for key in self.masks(text):
            if key in self.templates:
                return True
            words = key.split()  # a name may be more frequent than that
            if any(" ".join([*words[:i], "@", *words[i + 1 :]]) in self.templates for i in range(len(words))):
                return True
        if self._shapes is None:
            shapes = []
            for t in self.templates:
                if sum(len(x) for x in t.split() if x not in "@0") >= 8:
                    shapes.append("".join(".{2,40}" if x == "@" else "[a-z]{1,4}" if x == "0" else re.escape(skeleton(x)) for x in t.split()))
            self._shapes = re.compile("|".join(shapes) or r"(?!)")
        return self._shapes.fullmatch(skeleton(text)) is not None


def _edits(w: str) -> set[str]:
    out = set()
    for size in (1, 2):
        for i in range(len(w) - size + 1):
            for right in GLYPHS.get(w[i : i + size], ()):
                out.add(w[:i] + right + w[i + size :])
    flat = plain(w)
    if flat != w:
        out.add(flat)
    return out


def _number(s: str) -> int | None:
    """A page number as scanned, arabic or roman."""
    if any(c.isdigit() for c in s) or all(c in "lI!|" for c in s):
        t = s.translate(_DIGIT)
        if t.isdigit() and len(t) <= 4 and sum(c.isdigit() or c in "lIiOoS!|" for c in s) == len(s):
            return int(t)
    r = s.lower().replace("1", "i").replace("!", "i").replace("|", "i")
    if r != "l" and r and _ROMAN.fullmatch(r):
        value = {"i": 1, "v": 5, "x": 10, "l": 50}
        return sum(-value[a] if value[a] < value.get(b, 0) else value[a] for a, b in zip(r, r[1:] + " "))
    return None


def page_number(text: str) -> tuple[int, bool] | None:
    """(value, whether marks or words show that it is one) of a text that is a page number."""
    m = _PAGE_NO.fullmatch(text.strip())
    if not m:
        return None
    n = _number(m["n"])
    if n is None:
        return None
    return n, bool(m["word"] or m["open"] or m["close"] or m["of"])


def split_edge(line: str) -> tuple[tuple[int, bool] | None, str]:
    """(page number, rest) of an edge line that may hold both, set apart by blanks."""
    text = line.strip()
    if whole := page_number(text):
        return whole, ""
    parts = re.split(r"\s{2,}", text)
    if len(parts) > 1:
        for k in (0, -1):
            if n := page_number(parts[k]):
                return n, "  ".join(parts[1:] if k == 0 else parts[:-1])
    return None, text


def furniture_lines(pages: list[list[str]], title: str | None, lexicon: Lexicon) -> list[set[int]]:
    """Per page the indexes of running headers, footers and page numbers; they reach in from the page's edges."""
    edges: list[list[list[tuple[int, tuple | None, str]]]] = []
    offsets: Counter = Counter()
    for p, lines in enumerate(pages):
        filled = [i for i, l in enumerate(lines) if l.strip()]
        sides = []
        for order in (filled[:3], filled[::-1][:3]):
            side = [(i, *split_edge(lines[i])) for i in order]
            for _, n, _ in side[:2]:
                if n:
                    offsets[n[0] - p] += 1
            sides.append(side)
        edges.append(sides)
    main, times = max(offsets.items(), key=lambda x: (x[1], -abs(x[0])), default=(None, 0))
    # lines of other pages' edges that look like running lines: skeleton -> pages
    seen: dict[str, set[int]] = {}
    for p, sides in enumerate(edges):
        for side in sides:
            for _, _, rest in side[:2]:
                if _running(rest):
                    seen.setdefault(skeleton(rest), set()).add(p)
    names = skeleton(title) if title else ""
    marked = bool(times >= 2 or any(n and n[1] for sides in edges for side in sides for _, n, _ in side[:2]) or any(len(x) > 1 for x in seen.values()))
    out = []
    for p, sides in enumerate(edges):
        gone: set[int] = set()
        for s, side in enumerate(sides):
            for k, (i, n, rest) in enumerate(side):
                if i in gone:
                    break
                fits = n is not None and (n[0] - p == main and (times >= 2 or n[1] or (len(pages) == 1 and k == 0)) or (n[1] and times < 2))
                if not rest:
                    if not fits:
                        break
                elif not (_running(rest) and (_again(rest, p, seen) or lexicon.is_template(rest) or (marked and s == 0 and ((names and _alike(skeleton(rest), names)) or (k == 0 and rest.isupper() and " " in rest))))):
                    if not (fits and n[1] and _running(rest) and k == 0):
                        break
                gone.add(i)
        out.append(gone)
    return out


def _running(rest: str) -> bool:
    return 2 < len(rest) <= 100 and rest[-1] not in ".;,?" and rest[-1] not in HYPHENS and not rest[0].islower()


def _again(rest: str, page: int, seen: dict[str, set[int]]) -> bool:
    own = skeleton(rest)
    if seen.get(own, set()) - {page}:
        return True
    return len(own) >= 8 and any(abs(len(own) - len(x)) <= 4 and at - {page} and _alike(own, x) for x, at in seen.items())


def _alike(a: str, b: str) -> bool:
    if a == b:
        return True
    m = difflib.SequenceMatcher(None, a, b, autojunk=False)
    return m.real_quick_ratio() >= 0.85 and m.quick_ratio() >= 0.85 and m.ratio() >= 0.85


def repair(contents: list[str | None], title: str | None, lexicon: Lexicon) -> tuple[list[tuple[int, int, str]], list[str]]:
    """((page, line, kind) rows, numbered from 1; paragraphs) of one document."""
    pages = [(c or "").split("\n") for c in contents]
    gone = furniture_lines(pages, title, lexicon)
    found = [(p + 1, i + 1, "furniture") for p, g in enumerate(gone) for i in sorted(g)]
    body: list[tuple[int, int, list[str]]] = []  # page, line, tokens; no tokens: a blank line
    for p, lines in enumerate(pages):
        for i, l in enumerate(lines):
            if i not in gone[p]:
                body.append((p, i, _TOKEN.findall(l)))
    counts = lexicon.counts
    paragraphs: list[str] = []
    text: list[str] = []
    carried = None  # (joined word, tokens that stood before it)
    at_page_edge = -1
    for k, (p, i, tokens) in enumerate(body):
        if not tokens:
            if carried is None and (not text or text[-1][-1:] in ".!?:…\"”)" or p == at_page_edge or not _page_break(body, k)):
                if text:
                    paragraphs.append(" ".join(text))
                text = []
            continue
        at_page_edge = p
        bad = False
        told = [lexicon.token(t) for t in tokens]
        plain_words = [x[0] for x in told]
        first = 0
        if carried is not None:
            first = 1  # judged with the line before
            text.append(carried)
            carried = None
        last = len(tokens)
        following = _next_tokens(body, k)
        joint = None
        if tokens[-1][-1] in HYPHENS and len(tokens[-1]) > 1 and any(c.isalpha() for c in tokens[-1]) and following:
            last -= 1
            head, tail = tokens[-1][:-1].lstrip(_EDGE), following[0]
            joint = _join(head, tail, tokens[-1][-1], lexicon)
            if joint[1]:
                found.append((p + 1, i + 1, "hyphen"))
        for t in range(first, last):
            w, judged, part = told[t]
            fixed = None
            if judged:
                fixed = lexicon.correct(w, plain_words[max(0, t - WINDOW) : t] + plain_words[t + 1 : t + 1 + WINDOW])
                if fixed is None and w not in counts and _odd_glyphs(tokens[t].strip(_EDGE)):
                    bad = True
            if fixed is None and part and t + 1 < last and told[t + 1][2]:
                after = plain_words[t + 1]
                whole = counts.get(w + after, 0)
                if whole >= DOMINANCE and (w not in counts and after not in counts or whole >= DOMINANCE * max(lexicon.times(w), lexicon.times(after))):
                    bad = True
            if fixed:
                bad = True
                text.append(_as(tokens[t], w, fixed))
            else:
                text.append(tokens[t])
        if joint:
            w = bare(joint[0])
            fixed = lexicon.correct(w, plain_words[-1 - WINDOW : -1])
            if fixed is None and w not in counts and _odd_glyphs(joint[0].strip(_EDGE)):
                bad = True
            if fixed:
                bad = True
            carried = _as(joint[0], w, fixed) if fixed else joint[0]
        if bad:
            found.append((p + 1, i + 1, "ocr"))
    if carried:
        text.append(carried)
    if text:
        paragraphs.append(" ".join(text))
    return found, paragraphs


def _page_break(body, k: int) -> bool:
    """Whether a blank line stands between two pages."""
    before = next((body[j][0] for j in range(k, -1, -1) if body[j][2]), None)
    after = next((body[j][0] for j in range(k, len(body)) if body[j][2]), None)
    return before != after


def _next_tokens(body, k: int) -> list[str]:
    """Tokens of the line that goes on behind line ``k``; a blank line within a page ends the text."""
    for j in range(k + 1, len(body)):
        if body[j][2]:
            return body[j][2]
        if body[j][0] == body[k][0] and not _page_break(body, j):
            return []
    return []


def _join(head: str, tail: str, mark: str, lexicon: Lexicon) -> tuple[str, bool]:
    """(word, whether it is written unbroken) of a word that goes on in the next line."""
    counts = lexicon.counts
    rest = bare(tail)
    one, two = head.lower() + rest, f"{head.lower()}-{rest}"
    n, m = counts.get(one, 0), counts.get(two, 0)
    if not n and not m:
        fixed_one, fixed_two = lexicon.correct(one), lexicon.correct(two)
        n, m = counts.get(fixed_one or "", 0), counts.get(fixed_two or "", 0)
        if not n and not m and mark in "-‐" and tail[:1].isupper() and head[:1].islower():
            m = 1
    return (head + "-" + tail, False) if m > n else (head + tail, True)


def _odd_glyphs(token: str) -> bool:
    """Signs or digits within a word's letters, as in a name that no frequent word can correct."""
    core = token.rstrip("!").replace("’", "'")
    if core.endswith("'s"):
        core = core[:-2]
    letters = sum(c.isalpha() for c in core)
    if letters < 3 or "-" in core or "/" in core or "@" in core or "_" in core:
        return False
    inner = re.search(r"[^\W\d_][0-9!|$]+[^\W\d_]", core) or re.match(r"[0-9!|$][a-z]{3}", core)
    return bool(inner) or (not core.isascii() and plain(core).isascii() and plain(core).isalpha())


def _as(token: str, w: str, fixed: str) -> str:
    """The corrected word with the token's punctuation and capital."""
    low = token.lower().replace("’", "'")
    at = low.find(w)
    if at < 0:
        return token
    new = fixed.capitalize() if token[at : at + 1].isupper() or (at == 0 and token[:1] in "0153|!" and token[1:2].isupper()) else fixed
    return token[:at] + new + token[at + len(w) :]


def learn(docs: DataFrame) -> Lexicon:
    """A lexicon of (id, title, pages): counts, vectors, contexts and templates over all documents."""

    def counted(batches):
        for b in batches:
            total: Counter = Counter()
            for pages in b.column(0).to_pylist():
                total.update(words_of(pages))
            yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

    words = stage(map_arrow(docs.select("pages"), counted, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")), "words")
    several = {r["word"]: r["n"] for r in words.filter("n > 1").collect()}  # all that come once count 1 without being listed
    counts = {w: n for w, n in several.items() if n >= LEAST_COUNT}
    rare = {w: n for w, n in several.items() if n < LEAST_COUNT}
    context = contexts(docs, _vectors(docs, counts), counts) if counts else Context({})
    shared = docs.sparkSession.sparkContext.broadcast(Lexicon(counts, context, rare=rare))

    def edges(batches):
        lex = shared.value
        for b in batches:
            at_edge: Counter = Counter()
            inside: Counter = Counter()
            for pages in b.column(0).to_pylist():
                own: set[str] = set()
                for page in pages or ():
                    filled = [l for l in (page or "").split("\n") if l.strip()]
                    for l in filled[:2] + filled[-2:]:
                        _, rest = split_edge(l)
                        if _running(rest):
                            own.update(lex.masks(rest))
                    for l in filled[2:-2]:
                        if _running(l.strip()):
                            inside.update(lex.masks(l))
                at_edge.update(own)
            # lines inside of pages are counted by their names' hashes alone
            keys = list(at_edge.keys() | inside.keys())
            yield pa.RecordBatch.from_arrays(
                [pa.array([_hash(k) for k in keys], pa.int64()), pa.array([k if k in at_edge else None for k in keys], pa.string()), pa.array([at_edge[k] for k in keys], pa.int64()), pa.array([inside[k] for k in keys], pa.int64())],
                names=["h", "template", "n", "inside"],
            )

    seen = map_arrow(docs.select("pages"), edges, "h bigint, template string, n bigint, inside bigint").groupBy("h").agg(F.max("template").alias("template"), F.sum("n").alias("n"), F.sum("inside").alias("inside"))
    often = seen.filter((F.col("n") >= TEMPLATE_DOCS) & (F.col("n") >= TEMPLATE_EDGE * (F.col("n") + F.col("inside"))))
    kept = frozenset(r["template"] for r in often.collect() if set(r["template"].split()) - {"@", "0"})
    return Lexicon(counts, context, kept, rare)


def _hash(s: str) -> int:
    return xxhash.xxh3_64_intdigest(s) - (1 << 63)


def _known(pages, get) -> list[np.ndarray]:
    """Per page the numbers of its known words in order."""
    return [np.array([i for t in _TOKEN.findall(page or "") if (i := get(bare(t))) is not None], np.int64) for page in pages or ()]


def _vectors(docs: DataFrame, counts: dict[str, int]) -> dict[str, np.ndarray]:
    """Skip-gram vectors of length 1 of the known words: their pairs' mutual information, where positive, along the pairs' axes.

    Pairs are counted within batches, then over all documents; a word's pairs meet in one
    task, at most as many as there are words.
    """
    names = sorted(counts)
    size = len(names)
    shared = docs.sparkSession.sparkContext.broadcast((names, np.array([counts[w] for w in names], float)))

    def pairs(batches):
        get = {w: i for i, w in enumerate(shared.value[0])}.get
        for b in batches:
            codes = []
            for pages in b.column(0).to_pylist():
                for own in _known(pages, get):
                    for d in range(1, WINDOW + 1):
                        codes += [own[:-d] * size + own[d:], own[d:] * size + own[:-d]]
            both, n = np.unique(np.concatenate(codes), return_counts=True) if codes else (np.empty(0, np.int64), np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array((both // size).astype(np.int32)), pa.array((both % size).astype(np.int32)), pa.array(n.astype(np.int64))], names=["w", "c", "n"])

    def project(batches):
        names, times = shared.value
        axes, total = signs(names), times.sum()
        for b in batches:
            if not b.num_rows:
                continue
            w, c, n = (b.column(k).to_numpy() for k in range(3))
            about = np.maximum(np.log(n * total / (times[w] * times[c] * 2 * WINDOW)), 0).astype(np.float32)
            at = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
            sums = np.add.reduceat(axes[c] * about[:, None], at, axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(w[at]), pa.array(list(sums), pa.list_(pa.float32()))], names=["w", "v"])

    counted = map_arrow(docs.select("pages"), pairs, "w int, c int, n bigint").groupBy("w", "c").agg(F.sum("n").alias("n")).filter(F.col("n") >= PAIR_COUNT)
    out: dict[str, np.ndarray] = {}
    for r in map_arrow(counted.repartition("w").sortWithinPartitions("w", "c"), project, "w int, v array<float>").collect():  # a row a word, few more
        out[names[r["w"]]] = out.get(names[r["w"]], 0) + np.array(r["v"], np.float32)
    return {w: _unit(v) for w, v in out.items()}


def contexts(docs: DataFrame, vectors: dict[str, np.ndarray], counts: dict[str, int]) -> Context:
    """How similar words are to what stands around them, and to what stands around any word, over all documents.

    Every word weighs the same, however often it comes. What chance gives follows from the first
    and second moments of both sides, whatever the order of the documents.
    """
    names = sorted(vectors)
    if len(names) < 2:
        return Context(vectors)
    shared = docs.sparkSession.sparkContext.broadcast((names, np.stack([vectors[w] for w in names]), np.array([1.0 / counts[w] for w in names], np.float32)))
    d = DIMENSIONS

    def run(batches):
        names, rows, weights = shared.value
        get, axes = {w: i for i, w in enumerate(names)}.get, signs(names)
        total = np.zeros(3 + 2 * d + 2 * d * d)
        for b in batches:
            for pages in b.column(0).to_pylist():
                for own in _known(pages, get):
                    if len(own) < 3:
                        continue
                    v, x = rows[own], axes[own]
                    sums = np.concatenate([np.zeros((1, d), np.float32), np.cumsum(x, axis=0)])
                    at = np.arange(len(own))
                    near = sums[np.minimum(at + WINDOW + 1, len(own))] - sums[np.maximum(at - WINDOW, 0)] - x
                    near /= np.maximum(np.linalg.norm(near, axis=1, keepdims=True), 1e-9)
                    y, m = (near * v).sum(1), weights[own]
                    wide_near, wide_v = near * m[:, None], v * m[:, None]
                    total += np.concatenate([[m.sum(), (y * m).sum(), (y * y * m).sum()], wide_near.sum(0), wide_v.sum(0), (wide_near.T @ near).ravel(), (wide_v.T @ v).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["at", "x"])

    got = map_arrow(docs.select("pages"), run, "at int, x double").groupBy("at").agg(F.sum("x").alias("x")).collect()
    t = np.zeros(3 + 2 * d + 2 * d * d)
    for r in got:
        t[r["at"]] = r["x"]
    n, mean, square = t[0], *(t[1:3] / (t[0] or 1.0))
    if n <= 0:
        return Context(vectors)
    near, own = t[3 : 3 + d] / n, t[3 + d : 3 + 2 * d] / n
    by_chance = float(near @ own)
    chance_square = float(((t[3 + 2 * d : 3 + 2 * d + d * d] / n) * (t[3 + 2 * d + d * d :] / n)).sum())
    spread = lambda m, s: (float(m), max(1e-3, float(s - m * m)) ** 0.5)
    return Context(vectors, spread(mean, square), spread(by_chance, chance_square))


def _unit(v: np.ndarray) -> np.ndarray:
    n = float(np.linalg.norm(v))
    return v / n if n else v


def _documents(df: DataFrame, id_col: str, pages_col: str, title_col: str | None) -> DataFrame:
    narrow = pick(df, id=id_col, pages=pages_col, title=title_col if title_col else F.lit(None).cast("string")).filter("id is not null and pages is not null")
    return stage(narrow.dropDuplicates(["id"]), "scans")


def scan_noise(df: DataFrame, id_col: str = "pdf_id", pages_col: str = "content", title_col: str | None = "title") -> DataFrame:
    """(id, page_no, line_no, kind): lines that are furniture, end in a broken word, or hold misread words.

    Pages and lines are numbered from 1, blank ones included. Null contents and ids give
    no row, a null page is an empty one, and an id that comes several times counts once.
    """
    docs = _documents(df, id_col, pages_col, title_col)
    lexicon = learn(docs)
    shared = df.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches):
        lex = shared.value
        for b in batches:
            at, rows = [], []
            for i, (pages, title) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())):
                for r in sorted(set(repair(pages, title, lex)[0])):
                    at.append(i)
                    rows.append(r)
            cols = list(zip(*rows)) if rows else [(), (), ()]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string())], names=["id", "page_no", "line_no", "kind"])

    return map_arrow(docs, run, f"id {df.schema[id_col].dataType.simpleString()}, page_no int, line_no int, kind string")


def paragraphs(df: DataFrame, id_col: str = "pdf_id", pages_col: str = "content", title_col: str | None = "title") -> DataFrame:
    """(id, para_no, text): the repaired documents as continuous paragraphs."""
    docs = _documents(df, id_col, pages_col, title_col)
    lexicon = learn(docs)
    shared = df.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches):
        lex = shared.value
        for b in batches:
            at, numbers, texts = [], [], []
            for i, (pages, title) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())):
                for n, t in enumerate(repair(pages, title, lex)[1], 1):
                    at.append(i)
                    numbers.append(n)
                    texts.append(t)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(numbers, pa.int32()), pa.array(texts, pa.string())], names=["id", "para_no", "text"])

    return map_arrow(docs, run, f"id {df.schema[id_col].dataType.simpleString()}, para_no int, text string")

"""Problem 6: site furniture removed by counting hashed subtrees per host.

A stored page has no markup left, so its tree is read from its lines: page, line, and
the labels of a menu line. Each subtree is hashed with the host's own name and all
numbers masked. Distinct articles are counted per subtree, within a host and over all
hosts; subtrees that recur over many different articles are furniture. Lists of other
pages vary from page to page, so they are cut with the recurring heading they hang on.

Counting articles instead of pages keeps copies of one article from turning its lines
into furniture, and pages without an article (errors, checks, filler) don't count.
Articles are told apart by title and by paragraphs: copies under other titles have the
paragraphs in common, edited copies the title. The pages that copies fill don't matter.
"""

from __future__ import annotations

import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import decode, map_arrow, pick
from weft.llm.residue import FILLER, FUNCTION_WORDS, NOTICE, PROSE_CHARS, PROSE_WORDS, is_filler_paragraph
from weft.plans.staging import stage
from weft.sources.tables import site_of

#: Hosts over which a subtree must recur to be furniture of all hosts.
ALL_HOSTS = 3
#: Lines that look like a page's own need more. Rows: plain lines, lines that read like titles or list items,
#: long paragraphs (the last two bits of a hash tell which). Columns: articles within a host, over all hosts, share of
#: different titles that must have different paragraphs.
NEEDS = ((4, 5, 0.5), (5, 10, 0.6), (20, 20, 0.7))
LONG_CHARS = 130
#: Share of a menu's labels that must be known.
MENU_SHARE = 0.6

#: Share of a heading's articles on which items follow it, and of different first items among these, from which it heads a list.
HEADS_SHARE, HEADS_VARIETY = 0.8, 0.75

_LABELS = re.compile(r"\s*[|·›»•—]+\s*|\s{2,}|\]\([^)]*\)\s*\[?")
_MARK = re.compile(r"^(?:[#>*•\-–_\s]+|\d+\.\s)+|[*_\s]+$")
_LINK = re.compile(r"\[([^\]\n]*)\]\([^)\n]*\)")
_SPACES = re.compile(r"[\W_]+")
_DIGITS = re.compile(r"\d+")
_DATE = re.compile(r"\b(?:\d{4}-\d{2}-\d{2}|\d{1,2}[./]\d{1,2}[./]\d{4}|\d{1,2}\.? \w+ \d{4})\b")
_SERIES = re.compile(r"(?:part|teil|partie|parte) (?:\d+ )?(?:of|der|die|de|du|del)\b.{0,60}\b(?:series|reihe|serie|série)\b", re.I)
_GENERIC_HOST = frozenset("blog docs news shop help wiki info forum mail portal support static media data site home page example test".split())

BLANK, PROSE, HEADING, ITEM, BLOCK, SHORT = range(6)
_TITLE, _BYLINE, _NOTICE, _LINKED = 8, 16, 32, 256


def brands(site: str) -> list[str]:
    """Names of a host that its own lines may carry: its labels but the last, without generic ones."""
    return [x for x in site.split(".")[:-1] if len(x) > 3 and x not in _GENERIC_HOST]


def masked(bare: str, names: list[str]) -> str:
    """A line as its subtree is hashed: link targets, markup, numbers and the host's name left out."""
    s = _LINK.sub(r"\1", bare).lower()
    for n in names:
        if n in s:
            s = s.replace(n, " zzbrand ")
    return _SPACES.sub(" ", _DIGITS.sub("0", s)).strip().replace("zzbrand", "@")


def _h(s: str, row: int = 0) -> int:
    return (xxhash.xxh3_64_intdigest(s) >> 2 << 2 | row) - (1 << 63)


def form(key: str) -> str:
    """A line's words of grammar in their places, others masked."""
    return " ".join(w if w == "@" or w in FUNCTION_WORDS else "*" for w in key.split())


def page_tree(text: str, site: str):
    """(hash of the article's title or None, hash of its paragraphs or None, line hashes, line features, label hashes, label owners, heads, firsts).

    Labels are parts of menu lines and forms of lines; a form's owner is -1 minus its line. ``heads`` are
    the hashes of lines that items follow, ``firsts`` the hashes of the first of these.
    """
    names = brands(site)
    keys: list[int] = []
    feats: list[int] = []
    labels: list[int] = []
    owners: list[int] = []
    fenced = False
    first_prose = -1
    bares: list[str] = []
    prose: list[int] = []
    prose_chars = 0
    for i, raw in enumerate(text.split("\n")):
        bare = _MARK.sub("", raw)
        bares.append(bare)
        if raw.lstrip().startswith("```"):
            fenced = not fenced
            keys.append(0)
            feats.append(BLOCK if raw.strip() else BLANK)
            continue
        if not bare:
            keys.append(0)
            feats.append(BLOCK if raw.strip() else BLANK)
            continue
        n = len(bare)
        if fenced or raw.lstrip("* ").startswith("|"):
            keys.append(0)
            feats.append(BLOCK)
            continue
        spaces = bare.count(" ")
        if n >= PROSE_CHARS and spaces >= PROSE_WORDS - 1:
            keys.append(_h(masked(bare, names), 2 if n >= LONG_CHARS else 0))
            feats.append(PROSE)
            if n >= 140 and not is_filler_paragraph(bare):
                prose_chars += n
                prose.append(keys[-1])
                if first_prose < 0:
                    first_prose = i
            continue
        key = masked(bare, names)
        titled = n <= 110 and spaces >= 1 and bare[-1] not in ".!?:;,"
        keys.append(_h(key, 1 if titled and key.count(" ") >= 3 and "@" not in key else 0))
        stripped = raw.lstrip(" *")
        f = HEADING if stripped.startswith("#") else ITEM if stripped.startswith(("- ", "•", "+ ")) or raw.lstrip().startswith("* ") else SHORT
        if titled or _LINK.search(bare):
            f |= _TITLE
        if _LINK.fullmatch(bare):
            f |= _LINKED
        if n <= 100 and (_DATE.search(bare) or _SERIES.match(bare)):
            f |= _BYLINE
        if NOTICE.fullmatch(bare) or FILLER.fullmatch(bare):
            f |= _NOTICE
        feats.append(f)
        if key.startswith("@ ") and n <= LONG_CHARS and f & 7 == SHORT and key.count(" ") >= 2:
            labels.append(_h("form " + form(key)))
            owners.append(-1 - i)
        parts = [p for p in _LABELS.split(bare.strip("[]")) if p]
        if len(parts) >= 2 and all(len(p) <= 32 and p.count(" ") <= 3 for p in parts):
            for p in parts:
                p = masked(p, names)
                if p and p != "0":
                    labels.append(_h(p))
                    owners.append(i)
    sig = body = None
    if first_prose >= 0 and prose_chars >= 140:
        # the article is known by its title: the line above the first paragraph, the byline skipped
        at = first_prose - 1
        while at >= 0 and (not bares[at] or feats[at] & _BYLINE):
            at -= 1
        sig = _h(_SPACES.sub(" ", _LINK.sub(r"\1", bares[at]).lower()) if at >= 0 else bares[first_prose][:80].lower())
        body = _h(",".join(map(str, prose)))
    heads, firsts = [], []
    none = [False] * len(keys)
    for i, f in enumerate(feats):
        if f & 7 in (HEADING, ITEM, SHORT) and not f & _BYLINE and i + 1 < len(feats) and (feats[i + 1] & _TITLE or feats[i + 1] & 7 == BLANK):
            at = items_under(feats, none, i, 1)
            if at:
                heads.append(keys[i])
                firsts.append(keys[at[0]])
    return sig, body, keys, feats, labels, owners, heads, firsts


def items_under(feats: list[int], out: list[bool], i: int, most: int | None = None) -> list[int]:
    """The lines of a list (just the first ``most`` if asked) that hangs on line ``i``: lines that read like titles, up to what is furniture of its own,
    text, or a blank line behind which no list item goes on."""
    n, j, found = len(feats), i + 1, []
    while j < n:
        f = feats[j]
        if f & 7 == BLANK:
            k = j
            while k < n and feats[k] & 7 == BLANK:
                k += 1
            if k == n or not (feats[k] & _TITLE) or out[k]:
                break
            if found and not (feats[k] & 7 == ITEM or feats[k] & _LINKED):
                break
            j = k
            continue
        if out[j] or f & _BYLINE or f & 7 in (PROSE, BLOCK, HEADING) or not f & _TITLE:
            break
        if f & 7 == SHORT and not f & _LINKED and _heads_text(feats, out, j):
            break
        found.append(j)
        if len(found) == most:
            break
        j += 1
    return found


def trees(df: DataFrame, id_col: str, url_col: str, content_col: str, encoded: bool) -> DataFrame:
    """One narrow row per page: (id, host, sig, body, keys, feats, labels, owners, heads, firsts)."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            ids, hosts = b.column(0), b.column(1).to_pylist()
            cols: list[list] = [[] for _ in range(9)]
            rows: list[int] = []
            for i, (host, content) in enumerate(zip(hosts, b.column(2).to_pylist())):
                text = decode(content) if encoded else content
                if not text:
                    continue
                rows.append(i)
                for c, v in zip(cols, (_h(host), *page_tree(text, host))):
                    c.append(v)
            ints, shorts = pa.list_(pa.int64()), pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(rows, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), ints, shorts, ints, shorts, ints, ints)))],
                names=["id", "host", "sig", "body", "keys", "feats", "labels", "owners", "heads", "firsts"],
            )

    narrow = pick(df, id=id_col, url=url_col, content=content_col).filter("id is not null and content is not null").select("id", site_of("url").alias("host"), "content")
    return map_arrow(narrow, run, f"id {kind}, host bigint, sig bigint, body bigint, keys array<bigint>, feats array<int>, labels array<bigint>, owners array<int>, heads array<bigint>, firsts array<bigint>")


def recurring(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, host) and the counts that they come from: subtrees that recur over enough different articles; host is null where they do so over all hosts.

    Each title and each article's paragraphs count once, however many pages show them;
    pages without an article don't count. The counts are taken over all pages, in two
    aggregations of narrow rows: first by (key, host, article), which no hot host or line
    can skew, then by (key, host). Over all hosts an article that several of them hold
    counts once; just the keys that enough hosts show are counted for that.
    """
    seen = pages.filter("sig is not null").select("host", "sig", "body", F.explode(F.array_distinct(F.filter(F.concat("keys", "labels"), lambda k: k != 0))).alias("key"))
    row = F.col("key").bitwiseAND(3)

    def need(column: int):
        return F.when(row == 2, NEEDS[2][column]).when(row == 1, NEEDS[1][column]).otherwise(NEEDS[0][column])

    def counted(rows: DataFrame, *by: str) -> DataFrame:
        each = rows.select(*by, F.explode(F.array(F.struct(F.lit(True).alias("titled"), F.col("sig").alias("article")), F.struct(F.lit(False).alias("titled"), F.col("body").alias("article")))).alias("a")).select(*by, "a.*").distinct()
        return each.groupBy(*by).agg(F.count_if("titled").alias("titles"), F.count_if(~F.col("titled")).alias("bodies"))

    def enough(column: int):
        return (F.least("titles", "bodies") >= need(column)) & (F.col("bodies") >= need(2) * F.col("titles"))

    of_host = stage(counted(seen, "key", "host"), "subtrees")
    own = of_host.filter(enough(0)).select("key", "host")
    wide = of_host.groupBy("key").agg(F.sum("titles").alias("titles"), F.count(F.lit(1)).alias("hosts")).filter((F.col("titles") >= need(1)) & (F.col("hosts") >= ALL_HOSTS)).select("key")
    over_all = counted(seen.join(wide, "key", "left_semi"), "key").filter(enough(1)).select("key", F.lit(None).cast("bigint").alias("host"))
    return own.unionByName(over_all), of_host


def heading(pages: DataFrame, of_host: DataFrame) -> DataFrame:
    """(key): lines under which, on most of their articles, items stand that differ from article to article.

    Lines with items are few on a page. An article of a host counts once, with one of the first items it shows.
    """
    led = pages.filter("sig is not null").select("host", "sig", F.explode(F.arrays_zip("heads", "firsts")).alias("h")).groupBy(F.col("h.heads").alias("key"), "host", "sig").agg(F.min("h.firsts").alias("first"))
    led = led.groupBy("key").agg(F.count(F.lit(1)).alias("led"), F.count_distinct("first").alias("firsts")).filter((F.col("firsts") > 1) & (F.col("firsts") >= HEADS_VARIETY * F.col("led")))
    shown = of_host.join(led.select("key"), "key", "left_semi").groupBy("key").agg(F.sum("titles").alias("shown"))
    return led.join(shown, "key").filter(F.col("led") >= HEADS_SHARE * F.col("shown")).select("key")


def decide(keys: list[int], feats: list[int], labels: list[int], owners: list[int], known: set[int], heads: set[int]) -> list[int]:
    """Numbers (from 1) of the furniture lines of one page."""
    n = len(keys)
    out = [False] * n
    total: dict[int, int] = {}
    met: dict[int, int] = {}
    for k, i in zip(labels, owners):
        total[i] = total.get(i, 0) + 1
        met[i] = met.get(i, 0) + (k in known)
    for i in range(n):
        f = feats[i]
        if f & 7 in (BLANK, BLOCK) or (f & (_BYLINE | _NOTICE) and keys[i] not in heads):
            continue
        out[i] = keys[i] in known or (total.get(i, 0) >= 2 and met[i] >= MENU_SHARE * total[i]) or met.get(-1 - i, 0) > 0
    i = 0
    while i < n:
        if not (out[i] and keys[i] in heads):
            i += 1
            continue
        items = items_under(feats, out, i)
        for k in range(i + 1, items[-1] + 1 if items else i + 1):
            if feats[k] & 7 != BLANK:
                out[k] = True
        i = max(items[-1] if items else i, i) + 1
    return [i + 1 for i in range(n) if out[i]]


def _heads_text(feats: list[int], out: list[bool], i: int) -> bool:
    """Whether a short line stands right above a byline or a paragraph, as a page's own title does."""
    for k in range(i + 1, len(feats)):
        if feats[k] & 7 != BLANK:
            return bool(feats[k] & _BYLINE) or (feats[k] & 7 == PROSE and not out[k])
    return False


def furniture(df: DataFrame, id_col: str = "entry_id", url_col: str = "url", content_col: str = "content", encoded: bool = True) -> DataFrame:
    """(id, line_no) of the non-blank lines that are site furniture, lines numbered from 1.

    Null and empty texts and null ids give no row; a page without a host counts under
    an empty host. Deliveries of one id give the same lines, once. Lines of any length
    are hashed whole; tables and code are left alone.
    """
    kind = df.schema[id_col].dataType.simpleString()
    pages = stage(trees(df, id_col, url_col, content_col, encoded), "trees")
    found, of_host = recurring(pages)
    heads = heading(pages, of_host).withColumn("head", F.lit(True))
    known = stage(found.join(heads, "key", "left"), "known")
    subtree = pages.select("id", "host", F.explode(F.array_distinct(F.filter(F.concat("keys", "labels"), lambda k: k != 0))).alias("key"))
    over_all, own = known.filter("host is null").select("key", "head"), known.filter("host is not null")
    hits = subtree.join(over_all, "key").select("id", "key", "head").unionByName(subtree.join(own, ["key", "host"]).select("id", "key", "head"))
    of_page = hits.groupBy("id").agg(F.collect_set("key").alias("known"), F.collect_set(F.when(F.col("head"), F.col("key"))).alias("heads"))
    joined = pages.select("id", "keys", "feats", "labels", "owners").join(of_page, "id", "left").select("id", "keys", "feats", "labels", "owners", "known", "heads")

    def run(batches):
        for b in batches:
            ids, lines = [], []
            for i, row in enumerate(zip(*(b.column(k).to_pylist() for k in range(1, 7)))):
                got = decide(row[0], row[1], row[2], row[3], set(row[4] or ()), set(row[5] or ()))
                ids += [i] * len(got)
                lines += got
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(ids, pa.int64())), pa.array(lines, pa.int32())], names=["id", "line_no"])

    return map_arrow(joined, run, f"id {kind}, line_no int").distinct()

"""Text functions as expressions: tokens, blocks, chunks, cleaning, redaction, paging.

Lengths are code points and lines end at newlines. Null texts count as empty ones
unless a function says otherwise. Functions that fold over lines in order are Arrow
batch functions; they are marked so.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType

from weft.functions.urls import let

# Words that a focus query doesn't look for.
FOCUS_STOPWORDS = tuple(
    "the and for with from that this are was were has have had you your its our not but can will into via using use how what when why who which about also more most than then them they their there here such each other some any all one two new get got may might could should would does did done been being very just like over time since".split()
)
BLANK_LINES = r"\n(?:[ \t\r\f]*\n)+"


def text_of(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def tokens(text: Column | str) -> Column:
    """Runs of a-z and 0-9 of two characters and more that are no stopwords, in order."""
    stop = F.array(*[F.lit(w) for w in FOCUS_STOPWORDS])
    return F.filter(F.regexp_extract_all(F.lower(text_of(text)), F.lit("[a-z0-9]+"), F.lit(0)), lambda t: (F.length(t) >= 2) & ~F.array_contains(stop, t))


def blocks(text: Column | str) -> Column:
    """Paragraph blocks: what stands between blank lines, lines kept."""
    inner = F.regexp_replace(text_of(text), r"^(?:[ \t\r\f]*\n)+", "")
    return F.filter(F.transform(F.split(inner, BLANK_LINES, -1), lambda b: F.regexp_replace(b, r"\n[ \t\r\f]*$", "")), lambda b: F.trim(F.translate(b, "\t\r\f\n", "")) != "")


def block_kind(block: Column) -> dict[str, Column]:
    """heading, level, table and code of one block."""
    first = F.regexp_replace(F.substring_index(block, "\n", 1), r"^\s+", "")
    lines = F.filter(F.split(block, "\n"), lambda l: F.trim(l) != "")
    n = F.size(lines)
    piped = F.size(F.filter(lines, lambda l: F.contains(l, F.lit("|"))))
    indented = F.size(F.filter(lines, lambda l: l.startswith("    ") | l.startswith("\t")))
    heading = first.startswith("#")
    six = F.substring(first, 1, 6)
    return {
        "heading": heading,
        "level": F.when(heading, F.length(six) - F.length(F.replace(six, F.lit("#"), F.lit("")))).otherwise(0),
        "table": (n >= 2) & (piped >= n * 0.5),
        "code": F.regexp_replace(block, r"^\s+", "").startswith("```") | ((n >= 2) & (indented >= n * 0.8)),
    }


def regex_chunks(text: Column | str, patterns: list[str] = (r"\n\n",)) -> Column:
    """Pieces after splitting by each pattern in turn; blank pieces are left out. Patterns with groups aren't taken."""
    if len(patterns) > 32 or any(len(p) > 512 for p in patterns):
        raise ValueError("at most 32 patterns of at most 512 characters")
    out = F.array(text_of(text))
    for p in patterns:
        if re.search(r"\((?!\?:)", re.sub(r"\\.", "", p)):
            raise ValueError("patterns with groups or look-arounds are not supported")
        out = F.flatten(F.transform(out, _splitter(p)))
    return F.filter(F.transform(out, lambda x: F.trim(F.regexp_replace(x, r"^\s+|\s+$", ""))), lambda x: x != "")


def _splitter(pattern: str):
    return lambda x: F.split(x, pattern, -1)


def sentences(text: Column | str) -> Column:
    """Split behind . ! ? and blanks; pieces trimmed, empty ones left out."""
    parts = F.split(text_of(text), r"(?<=[.!?])\s+", -1)
    return F.filter(F.transform(parts, lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def semantic_chunks(max_tokens: int = 500, overlap: int = 50, count=None):
    """Batch function text -> chunks: sentences packed up to ``max_tokens``, tail sentences up to ``overlap`` repeated.

    ``count`` counts a text's tokens (words by default). A sentence over the limit is cut
    by words. The overlap may push a chunk over the limit.
    """
    if not 1 <= max_tokens <= 8192 or not 0 <= overlap < max_tokens:
        raise ValueError("1 <= max_tokens <= 8192 and overlap below it")

    def pack(text: str | None) -> list[str]:
        size = count or (lambda s: len(s.split()))
        out: list[str] = []
        held: list[str] = []
        total = 0
        for s in (p.strip() for p in re.split(r"(?<=[.!?])\s+", text or "")):
            if not s:
                continue
            n = size(s)
            if n > max_tokens:
                if held:
                    out.append(" ".join(held))
                    held, total = [], 0
                words = s.split()
                out += [" ".join(words[i : i + max_tokens]) for i in range(0, len(words), max_tokens)]
                continue
            if held and total + n > max_tokens:
                out.append(" ".join(held))
                kept, total = [], 0
                for t in reversed(held):
                    m = size(t)
                    if total + m > overlap:
                        break
                    kept.insert(0, t)
                    total += m
                held = kept
            held.append(s)
            total += n
        return [*out, " ".join(held)] if held else out

    @F.pandas_udf(ArrayType(StringType()))
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(pack)

    return run


@F.pandas_udf(StringType())
def collapse_lines(texts: pd.Series) -> pd.Series:
    """Batch function: repeated short lines kept twice, long runs of short lines cut to five, with markers."""
    return texts.map(_collapse)


def _collapse(text: str | None) -> str | None:
    if text is None or len(text) < 2000:
        return text
    lines = text.split("\n")
    if len(lines) < 20:
        return text
    times: dict[str, int] = {}
    for l in lines:
        s = l.strip()
        if s and len(s) <= 30:
            times[s] = times.get(s, 0) + 1
    often = {s for s, n in times.items() if n > 5}
    if not often:
        return text
    kept, met, dropped = [], {}, 0
    for l in lines:
        s = l.strip()
        if s in often:
            met[s] = met.get(s, 0) + 1
            if met[s] > 2:
                dropped += 1
                continue
        kept.append(l)
    if dropped:
        kept.append(f"\n[{dropped} repeated nav controls collapsed]")
    out, i = [], 0
    while i < len(kept):
        j = i
        while j < len(kept) and 0 < len(kept[j].strip()) <= 25:
            j += 1
        if j - i > 8:
            out += [*kept[i : i + 5], f"[{j - i - 5} similar links collapsed]"]
            i = j
        else:
            out.append(kept[i])
            i += 1
    return "\n".join(out)


def visible_text(html: Column | str, noscript: bool = True) -> Column:
    """Text of a page without scripts, styles and tags, blanks collapsed; without what scripts replace if asked."""
    html = text_of(html) if noscript else F.regexp_replace(text_of(html), r"(?is)<noscript\b[^>]*>.*?</noscript>", " ")
    bare = F.regexp_replace(F.regexp_replace(text_of(html), r"(?is)<script\b[^>]*>.*?</script>", " "), r"(?is)<style\b[^>]*>.*?</style>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"<[^>]+>", " "), r"\s+", " "))


def clean_value(text: Column | str) -> Column:
    """Without zero-width and control characters; tabs, newlines and returns stay."""
    return F.regexp_replace(text_of(text), r"[\u200b\u200c\u200d\ufeff\u2060\u180e\x00-\x08\x0b\x0c\x0e-\x1f]", "")


def clean_query(query: Column | str) -> Column:
    """Trimmed query without control characters; null for empty ones and those over 2048 characters."""
    q = F.regexp_replace(text_of(query), r"^\s+|\s+$", "")
    return F.when((q != "") & (F.length(q) <= 2048), F.regexp_replace(q, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", ""))


def safe_links(markdown: Column | str) -> Column:
    """Links with active schemes point to '#'."""
    return F.regexp_replace(text_of(markdown), r"(?i)(!?\[[^\n\]]*\]\()\s*(?:javascript|vbscript|file|data):[^)\n]*\)", "$1#)")


def redact(text: Column | str) -> Column:
    """Keys and credentials within texts replaced."""
    t = F.regexp_replace(text_of(text), r"(?:sk|pk|api_key)[-_][a-zA-Z0-9]{20,}", "[API_KEY_REDACTED]")
    return F.regexp_replace(t, r"((?:https?|socks5h?)://)[^:@\s/]+:[^@\s/]+@", "$1[CREDENTIALS_REDACTED]@")


def redact_url(url: Column | str) -> Column:
    """Scheme, host and path of a url, for logs."""
    return F.regexp_replace(F.regexp_replace(text_of(url), r"[?#][\s\S]*$", ""), r"^([A-Za-z][A-Za-z0-9+.\-]*://)[^/]*@", "$1")


def human_size(n: Column | str) -> Column:
    c = F.coalesce(F.col(n) if isinstance(n, str) else n, F.lit(0)).cast("double")
    return F.when(c >= 1024 * 1024, F.format_string("%.1fMB", F.bround(c / 1024 / 1024, 1))).when(c >= 1024, F.format_string("%.1fKB", F.bround(c / 1024, 1))).otherwise(F.format_string("%dB", c.cast("long")))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two token arrays as sets; 0 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def page_of(text: Column | str, size: int, offset: int = 0, rest: int = 500) -> dict[str, Column]:
    """A page of a text from ``offset``: piece, whether more follows, and the next offset; a short rest is taken along."""
    t = text_of(text)
    n = F.length(t)
    left = n - offset - size
    more = left > rest
    return {"piece": F.when(more, F.substring(t, offset + 1, size)).otherwise(F.substring(t, offset + 1, 2_000_000_000)), "truncated": more, "next_offset": F.when(more, F.lit(offset + size)).otherwise(F.lit(0)), "total": n}


def dehyphenate(lines: Column) -> Column:
    """Lines of a block joined: a break behind a hyphen before a small letter is closed up."""

    def join(text: Column, line: Column) -> Column:
        a, b = F.regexp_replace(text, r"\s+$", ""), F.regexp_replace(line, r"^\s+", "")
        broken = a.rlike(r"[^ ]-$") & b.rlike(r"^\p{Ll}")
        return F.when(text == "", b).otherwise(F.when(broken, F.concat(F.regexp_replace(a, "-$", ""), b)).otherwise(F.concat(a, F.lit(" "), b)))

    return F.aggregate(lines, F.lit(""), join)


def cid_ratio(text: Column | str) -> Column:
    """Share of unresolved glyph codes like (cid:12) in a text."""
    t = text_of(text)
    return F.when(F.length(t) > 0, (F.length(t) - F.length(F.regexp_replace(t, r"\(cid:\d+\)", ""))) / F.length(t)).otherwise(F.lit(0.0))


def readable_share(text: Column | str) -> Column:
    """Printable characters without glyph codes, over all characters."""
    t = text_of(text)
    clean = F.regexp_replace(F.regexp_replace(t, r"\(cid:\d+\)", ""), r"[\p{Cc}\p{Cf}\p{Co}\p{Cn}&&[^\n\t]]", "")
    return F.when(F.length(t) > 0, F.length(clean) / F.length(t)).otherwise(F.lit(0.0))


def page_list(spec: Column | str, total: Column) -> Column:
    """Pages of a specification like '1-3,5', clamped to the document, sorted, once each; all pages without one."""
    s = text_of(spec)

    def part(p: Column) -> Column:
        q = F.trim(p)
        lo, hi = F.substring_index(q, "-", 1).try_cast("int"), F.substring_index(q, "-", -1).try_cast("int")
        a, b = F.greatest(F.lit(1), F.least(lo, hi)), F.least(total, F.greatest(lo, hi))
        return F.when(lo.isNotNull() & hi.isNotNull() & (a <= b), F.sequence(a, b)).otherwise(F.array().cast("array<int>"))

    every = F.when(total >= 1, F.sequence(F.lit(1), total)).otherwise(F.array().cast("array<int>"))
    return F.when(F.trim(s) == "", every).otherwise(F.array_sort(F.array_distinct(F.flatten(F.transform(F.split(s, ","), part)))))


def captions(text: Column | str) -> Column:
    """Caption text of SRT or VTT: counters, times, notes and tags dropped, each line once."""
    lines = F.transform(F.split(text_of(text), "\n"), lambda l: F.regexp_replace(l, r"^\s+|\s+$", ""))
    kept = F.filter(lines, lambda l: (l != "") & ~l.rlike(r"^\d+$") & (l != "WEBVTT") & ~l.startswith("NOTE") & ~l.rlike(r"^\d{2,}:\d{2}:\d{2}[,.]\d+.*-->"))
    return F.array_join(F.array_distinct(F.filter(F.transform(kept, lambda l: F.regexp_replace(l, r"<[^>]+>", "")), lambda l: l != "")), "\n")


def parse_date(text: Column | str) -> Column:
    """Date of ISO, compact and plain written forms; null where none fits."""
    s = F.regexp_replace(F.trim(text_of(text)), r"^D:(\d{8})\S*$", "$1")
    iso = F.regexp_extract(s, r"^(\d{4}-\d{2}-\d{2})", 1)
    return F.coalesce(
        F.when(s.rlike(r"^\d{8}$"), F.try_to_date(s, "yyyyMMdd")),
        F.when(iso != "", F.try_to_date(iso, "yyyy-MM-dd")),
        F.when(s.rlike(r"^\d{4}/\d{2}/\d{2}"), F.try_to_date(F.substring(s, 1, 10), "yyyy/MM/dd")),
        F.when(s.rlike(r"^[A-Za-z]{4,} \d{1,2}, \d{4}$"), F.try_to_date(s, "MMMM d, yyyy")),
        F.when(s.rlike(r"^[A-Za-z]{3} \d{1,2}, \d{4}$"), F.try_to_date(s, "MMM d, yyyy")),
        F.when(s.rlike(r"^\d{1,2} [A-Za-z]{4,} \d{4}$"), F.try_to_date(s, "d MMMM yyyy")),
        F.when(s.rlike(r"^\d{1,2} [A-Za-z]{3} \d{4}$"), F.try_to_date(s, "d MMM yyyy")),
    )


def age(content_date: Column, fetched: Column, stale_days: int = 365) -> dict[str, Column]:
    """Days since the content's date, and whether that is stale; -1 and false without a date or for future ones."""
    days = F.datediff(fetched, content_date)
    ok = F.coalesce(days >= 0, F.lit(False))
    return {"age_days": F.when(ok, days).otherwise(F.lit(-1)), "stale": ok & (F.coalesce(days, F.lit(0)) > stale_days)}


def focus(text: Column | str, terms: list[str], threshold: float = 1.0, k1: float = 1.5, b: float = 0.75, fallback: int = 5) -> Column:
    """Blocks of a text with score and whether a focus on ``terms`` keeps them: array of (ix, score, kept, block).

    Heading-aware ranking in one row: nothing is exploded or shuffled. A heading that
    holds a term boosts itself and its section by half and keeps it; tables and code with
    a term are kept; a heading right above a kept block comes along. Empty without terms.
    """
    qs = sorted(set(terms))

    def over(bs: Column) -> Column:
        info = F.transform(bs, lambda x: let(tokens(x), lambda t: _block_info(x, t, qs)))
        return let(info, scored)

    def scored(info: Column) -> Column:
        n = F.size(info)
        total = F.aggregate(info, F.lit(0), lambda a, x: a + x["n"])
        avg = F.when(total > 0, total / n).otherwise(F.lit(1.0))
        hits = [F.size(F.filter(info, _has(i))) for i in range(len(qs))]
        return let(F.struct(n.alias("n"), avg.alias("avg"), F.array(*hits).alias("df")), lambda g: finish(info, g))

    def finish(info: Column, g: Column) -> Column:
        def base(x: Column) -> Column:
            s = F.lit(0.0)
            for i in range(len(qs)):
                f, d = x["f"][i], g["df"][i]
                idf = F.log((g["n"] - d + 0.5) / (d + 0.5) + 1.0)
                s = s + F.when(f > 0, idf * (f * (k1 + 1)) / (f + k1 * (1 - b + b * x["n"] / g["avg"]))).otherwise(F.lit(0.0))
            return s

        start = F.struct(F.array().cast("array<int>").alias("open"), F.array().cast("array<int>").alias("depth"))

        def walk(state: Column, x: Column) -> Column:
            still = F.when(x["heading"], F.filter(state["open"], lambda l: l < x["level"])).otherwise(state["open"])
            opened = F.when(x["heading"] & x["met"], F.concat(still, F.array(x["level"]))).otherwise(still)
            return let(opened, lambda o: F.struct(o.alias("open"), F.concat(state["depth"], F.array(F.size(o))).alias("depth")))

        depth = F.aggregate(info, start, walk, lambda s: s["depth"])
        rows = F.zip_with(info, depth, lambda x, d: F.struct(x["block"].alias("block"), x["heading"].alias("heading"), (base(x) * F.pow(F.lit(1.5), d.cast("double"))).alias("score"), (d > 0).alias("section"), (x["met"] & (x["table"] | x["code"])).alias("preserved")))
        return let(F.transform(rows, lambda x, i: F.struct(i.alias("ix"), x["block"].alias("block"), x["heading"].alias("heading"), x["score"].alias("score"), ((x["score"] >= threshold) | x["section"] | x["preserved"]).alias("kept"))), choose)

    def choose(rows: Column) -> Column:
        some = F.exists(rows, lambda x: x["kept"])
        order = F.transform(F.array_sort(F.transform(rows, lambda x: F.struct((-x["score"]).alias("s"), x["ix"].alias("ix")))), lambda x: x["ix"])
        return let(F.when(some, F.transform(F.filter(rows, lambda x: x["kept"]), lambda x: x["ix"])).otherwise(F.slice(order, 1, fallback)), lambda kept: mark(rows, kept))

    def mark(rows: Column, kept: Column) -> Column:
        def final(x: Column) -> Column:
            below = F.try_element_at(rows, x["ix"] + 2)
            context = x["heading"] & F.coalesce(F.array_contains(kept, x["ix"] + 1) & ~below["heading"], F.lit(False))
            return F.struct(x["ix"].alias("ix"), F.round(x["score"], 6).alias("score"), (F.array_contains(kept, x["ix"]) | context).alias("kept"), x["block"].alias("block"))

        return F.transform(rows, final)

    empty = F.array().cast("array<struct<ix:int,score:double,kept:boolean,block:string>>")
    return let(blocks(text), lambda bs: F.when((F.size(bs) > 1) & F.lit(bool(qs)), over(bs)).otherwise(empty))


def _has(i: int):
    return lambda x: x["f"][i] > 0


def _block_info(block: Column, words: Column, qs: list[str]) -> Column:
    k = block_kind(block)
    f = F.array(*[F.size(words) - F.size(F.array_remove(words, q)) for q in qs])
    met = F.arrays_overlap(words, F.array(*[F.lit(q) for q in qs]))
    return F.struct(block.alias("block"), F.size(words).alias("n"), f.alias("f"), F.coalesce(met, F.lit(False)).alias("met"), *[v.alias(n) for n, v in k.items()])


@F.pandas_udf(DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Batch function: matching-blocks similarity of two texts, 1 for two empty ones."""
    import difflib

    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b)])


def cite(markdown: str, base: str = "") -> tuple[str, str]:
    """(text with numbered marks for links, references block); equal targets share a number, images keep their mark."""
    from urllib.parse import urljoin

    numbers: dict[str, int] = {}
    lines: list[str] = []

    def mark(m: re.Match) -> str:
        target = m[3] if m[3].startswith(("http://", "https://", "mailto:")) or not base else urljoin(base, m[3])
        if target not in numbers:
            numbers[target] = len(numbers) + 1
            about = " - ".join(x for x in dict.fromkeys((m[4], m[2])) if x)
            lines.append(f"⟨{numbers[target]}⟩ {target}{': ' + about if about else ''}\n")
        label = f"{m[2]}⟨{numbers[target]}⟩"
        return f"![{label}]" if m[1] else label

    text = re.sub(r"(!?)\[([^\]\n]*)\]\(\s*([^)\s]+)(?:\s+\"([^\"]*)\")?\s*\)", mark, markdown)
    return text, "\n\n## References\n\n" + "".join(lines) if lines else ""


@F.pandas_udf(ArrayType(StringType()))
def cited(markdown: pd.Series, base: pd.Series) -> pd.Series:
    """Batch function of ``cite``: [text, references]."""
    return pd.Series([list(cite(m or "", b or "")) for m, b in zip(markdown, base)])


def toc_ends(toc: Column, pages: Column) -> Column:
    """Last page of each entry of a contents list of (level, page): before the next entry of its level or above."""

    def last(x: Column, i: Column) -> Column:
        later = F.filter(F.slice(toc, i + 2, F.size(toc)), lambda y: (y["level"] <= x["level"]) & y["page"].isNotNull())
        end = F.when(F.size(later) > 0, F.greatest(x["page"], F.try_element_at(later, F.lit(1))["page"] - 1)).otherwise(pages)
        return F.when(x["page"].isNotNull(), end)

    return F.transform(toc, last)


def retry_after(value: Column | str, now: Column) -> Column:
    """Seconds to wait of a Retry-After value, as seconds or as a date; null where it can't be read."""
    v = F.trim(text_of(value))
    at = F.try_to_timestamp(F.regexp_replace(F.regexp_replace(v, r"^[A-Za-z]{3}, ", ""), r" GMT$", ""), F.lit("dd MMM yyyy HH:mm:ss"))
    wait = F.unix_timestamp(at) - F.unix_timestamp(now.cast("timestamp"))
    told = F.coalesce(v.try_cast("double"), wait.cast("double"))
    return F.when(told.isNotNull(), F.greatest(told, F.lit(0.0)))


def fetch_summary(status: Column, size: Column, kind: Column, error: Column, page_kind: Column, content_ok: Column) -> dict[str, Column]:
    """One-line summary of a fetch and what to do next."""
    head = F.when(F.coalesce(status, F.lit(0)) == 0, "network error").otherwise(F.concat(status.cast("string"), F.when(status < 400, " OK").otherwise(" ERR")))
    e = F.coalesce(error, F.lit(""))
    action = (
        F.when(e == "selector_empty", "retry without selector").when(e.startswith("robots"), "use another permitted source")
        .when(e.startswith("js_shell_detected"), "needs a browser").when(e.startswith("bot_challenge_detected"), "blocked by a challenge").when(e.startswith("geo_redirect_detected"), "try another region")
        .when((F.coalesce(status, F.lit(0)) == 0) | (status >= 400), "fetch failed").when(content_ok & (page_kind == "list"), "follow its links").when(content_ok & page_kind.isin("auth_wall", "paywall"), "use an archive or another source").otherwise("")
    )
    return {"summary": F.concat_ws(" · ", head, F.concat_ws(" ", human_size(size), kind)), "next_action": action}


def font_sizes(spans: DataFrame, group: str) -> DataFrame:
    """(group, median_size, main_size) of text spans (group, size, text): the middle size of all spans, and the one that most characters have (ties: the smaller)."""
    sized = spans.filter("size is not null")
    per = sized.groupBy(group, "size").agg(F.sum(F.length(F.coalesce("text", F.lit("")))).alias("chars"))
    main = per.groupBy(group).agg(F.max(F.struct("chars", -F.col("size"))).alias("m")).select(group, (-F.col("m")["col2"]).alias("main_size"))
    return sized.groupBy(group).agg(F.median("size").alias("median_size")).join(main, group)

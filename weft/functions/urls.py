"""URL functions as Catalyst expressions: identity keys, hosts, scores and classes.

Nothing here needs Python at run time. A url is good if it is credential-free http(s)
with a host and without control characters; others give '' (keys, hosts) or the
function's stated neutral value. Null gives the same as ''.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that don't change a page, for crawling and for search.
CRAWL_TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "ref", "ref_src", "source", "_ga", "mc_cid", "mc_eid")
SEARCH_TRACKING = (*CRAWL_TRACKING, "igshid", "si")
# First path segments of the code host that name no owner.
NO_OWNERS = ("about", "apps", "codespaces", "collections", "dashboard", "explore", "features", "issues", "login", "marketplace", "new", "notifications", "orgs", "pricing", "pulls", "search", "security", "settings", "sponsors", "topics", "trending")
# Path words that speak for content and against it.
CONTENT_WORDS = ("doc", "docs", "guide", "tutorial", "api", "reference", "article", "blog", "post", "learn", "manual", "help", "spec")
JUNK_WORDS = ("login", "signin", "sign-in", "signup", "sign-up", "register", "submit", "cart", "checkout", "account", "admin", "logout", "auth", "password", "settings", "preferences")
# Extensions and schemes of links that are no pages.
ASSET = r"(?i)\.(png|jpe?g|gif|webp|svg|css|js|ico|pdf|zip|mp[34]|woff2?|gz|tar|exe|dmg)(\?|$)"
SKIPPED_SCHEMES = ("javascript:", "mailto:", "tel:", "data:", "#")
# Extension -> media type.
MIME = {
    "txt": "text/plain", "html": "text/html", "htm": "text/html", "xhtml": "application/xhtml+xml", "css": "text/css", "csv": "text/csv", "ics": "text/calendar", "js": "application/javascript", "json": "application/json",
    "xml": "application/xml", "pdf": "application/pdf", "md": "text/markdown", "gif": "image/gif", "jpeg": "image/jpeg", "jpg": "image/jpeg", "png": "image/png", "svg": "image/svg+xml", "webp": "image/webp",
}
# Score by distance from the best depth, and by years of age.
DEPTH_SCORES = (1.0, 0.5, 1 / 3, 0.25)
AGE_SCORES = (1.0, 0.9, 0.8, 0.7, 0.6, 0.5)


def _c(url: Column | str) -> Column:
    return F.col(url) if isinstance(url, str) else url


def let(value: Column, fn) -> Column:
    """``fn(value)`` with the value computed once, however often ``fn`` uses it."""
    return F.element_at(F.transform(F.array(value), fn), 1)


class Parts:
    """The pieces of a url column; shared by the functions below."""

    def __init__(self, url: Column | str) -> None:
        raw = F.coalesce(_c(url), F.lit(""))
        trimmed = F.trim(raw)
        u = F.when(trimmed.startswith("//"), F.concat(F.lit("https:"), trimmed)).otherwise(trimmed)
        self.scheme = F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.\-]*)://", 1))
        authority = F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)
        self.port = F.regexp_extract(authority, r":([0-9]+)$", 1)
        self.host = F.regexp_replace(F.lower(F.regexp_replace(authority, r":[0-9]*$", "")), r"\.+$", "")
        self.path = F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
        self.query = F.regexp_extract(u, r"^[^?#]*\?([^#]*)", 1)
        number = F.coalesce(self.port.try_cast("int"), F.lit(-1))
        self.good = (
            self.scheme.isin("http", "https") & (self.host != "") & ~authority.contains("@") & ~raw.rlike(r"[\x00-\x1f\x7f]") & ((self.port == "") | number.between(1, 65535)) & ~authority.rlike(r":[^0-9\]]+$")
        )


class _Bound:
    def __init__(self, row: Column) -> None:
        self.scheme, self.host, self.port, self.path, self.query, self.good = (row[k] for k in ("scheme", "host", "port", "path", "query", "good"))


def with_parts(url: Column | str, fn) -> Column:
    """``fn(parts)`` with a url's pieces computed once."""
    p = Parts(url)
    row = F.struct(*[getattr(p, k).alias(k) for k in ("scheme", "host", "port", "path", "query", "good")])
    return let(row, lambda r: fn(_Bound(r)))


def host(url: Column | str, strip_www: bool = False) -> Column:
    """Lower-case host of a good url, '' of others."""
    h = with_parts(url, lambda p: F.when(p.good, p.host).otherwise(F.lit("")))
    return F.regexp_replace(h, r"^www\.", "") if strip_www else h


def dedupe_key(url: Column | str, tracking: tuple[str, ...] = (), root_path: str = "", trailing_slash: bool = True) -> Column:
    """Identity of a page: default port, fragment, tracking parameters and trailing slashes left out; order kept."""
    return with_parts(url, lambda p: _dedupe(p, tracking, root_path, trailing_slash))


def _dedupe(p, tracking: tuple[str, ...], root_path: str, trailing_slash: bool) -> Column:
    port = F.when((p.port != "") & ~(((p.scheme == "http") & (p.port.try_cast("int") == 80)) | ((p.scheme == "https") & (p.port.try_cast("int") == 443))), F.concat(F.lit(":"), p.port.try_cast("int").cast("string"))).otherwise(F.lit(""))
    path = F.when(p.path == "", F.lit(root_path)).otherwise(p.path)
    if trailing_slash:
        path = F.when(F.length(path) > 1, F.regexp_replace(path, r"/+$", "")).otherwise(path)

    def kept(part: Column) -> Column:
        name = F.lower(F.coalesce(F.try_url_decode(F.regexp_replace(F.substring_index(part, "=", 1), r"\+", "%2B")), F.substring_index(part, "=", 1)))
        keep = (part != "") & ~name.startswith("utm_")
        return keep & ~name.isin(*tracking) if tracking else keep

    query = F.array_join(F.filter(F.split(p.query, "&"), kept), "&")
    tail = let(query, lambda q: F.when(q != "", F.concat(F.lit("?"), q)).otherwise(F.lit("")))
    return F.when(p.good, F.concat(p.scheme, F.lit("://"), p.host, port, path, tail)).otherwise(F.lit(""))


def crawl_key(url: Column | str) -> Column:
    """Identity for crawling: tracking parameters off, the root path written out."""
    return dedupe_key(url, CRAWL_TRACKING, "/")


def search_key(url: Column | str) -> Column:
    """Identity for merging search hits; owner and name of a code repository don't depend on case."""
    repo = r"^(https?://(?:www\.)?github\.com(?::[0-9]+)?)(/+([^/?]+)/+[^/?]+)(.*)$"

    def fold(key: Column) -> Column:
        owner = F.lower(F.regexp_extract(key, repo, 3))
        folded = F.concat(F.regexp_extract(key, repo, 1), F.lower(F.regexp_extract(key, repo, 2)), F.regexp_extract(key, repo, 4))
        return F.when(key.contains("github.com") & (owner != "") & ~owner.isin(*NO_OWNERS), folded).otherwise(key)

    return let(dedupe_key(url, SEARCH_TRACKING), fold)


def in_domains(h: Column, domains) -> Column:
    """Whether a host is one of the domains or below one; its suffixes are made once, however long the list."""
    return F.arrays_overlap(host_suffixes(h), F.array(*[F.lit(d) for d in sorted(domains)]))


def host_suffixes(h: Column) -> Column:
    """All dot suffixes of a host: what a join with a long domain list explodes."""
    return let(F.split(h, r"\."), lambda labels: F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")))


def same_domain(left: Column | str, right: Column | str, subdomains: bool = False) -> Column:
    a, b = host(left), host(right)
    same = a == b
    if subdomains:
        same = same | a.endswith(F.concat(F.lit("."), b))
    return (a != "") & (b != "") & same


def keyword_score(url: Column | str, keywords: list[str]) -> Column:
    """Share of the keywords that occur in the url, case not counting; 0 without keywords."""
    low = F.lower(F.coalesce(_c(url), F.lit("")))
    if not keywords:
        return F.lit(0.0)
    return sum((low.contains(k.lower()).cast("double") for k in keywords), F.lit(0.0)) / F.lit(float(len(keywords)))


def depth(url: Column | str) -> Column:
    """Non-empty segments behind the host; the query's text counts as path."""
    u = F.coalesce(_c(url), F.lit(""))
    tail = F.when(u.contains("://"), F.regexp_extract(u, r"://[^/]*(/[\s\S]*)$", 1)).otherwise(F.regexp_extract(u, r"(/[\s\S]*)$", 1))
    return F.size(F.filter(F.split(tail, "/"), lambda x: x != ""))


def depth_score(url: Column | str, best: int = 3) -> Column:
    """1 / (1 + distance from the best depth)."""
    return F.lit(1.0) / (F.lit(1.0) + F.abs(depth(url) - best))


def extension(url: Column | str) -> Column:
    """Letters and digits behind the url's last dot, lower-cased."""
    return F.lower(F.regexp_extract(F.coalesce(_c(url), F.lit("")), r"\.([A-Za-z0-9]*)[^.]*$", 1))


def type_score(url: Column | str, weights: dict[str, float]) -> Column:
    """Score by '.ext$' patterns first, then by regular expressions from high to low; 0 where none fits."""
    ext, u = extension(url), F.coalesce(_c(url), F.lit(""))
    exact = {k[1:-1]: v for k, v in weights.items() if k.startswith(".") and k.endswith("$")}
    out = F.lit(0.0)
    for pattern, score in sorted(((k, v) for k, v in weights.items() if not (k.startswith(".") and k.endswith("$"))), key=lambda x: x[1]):
        out = F.when(u.rlike(pattern), F.lit(float(score))).otherwise(out)
    for e, score in exact.items():
        out = F.when(ext == e, F.lit(float(score))).otherwise(out)
    return out


def freshness_score(url: Column | str, current_year: int = 2024) -> Column:
    """By the latest year in the url that isn't in the future; 0.5 without one."""
    found = F.transform(F.regexp_extract_all(F.coalesce(_c(url), F.lit("")), F.lit(r"[/\-_]((?:19|20)\d{2})(?:[/\-_]\d{2}(?:[/\-_]\d{2})?)?"), F.lit(1)), lambda y: y.cast("int"))
    table = F.array(*[F.lit(x) for x in AGE_SCORES])

    def score(age: Column) -> Column:
        return F.when(age.isNull(), F.lit(0.5)).when(age < len(AGE_SCORES), F.element_at(table, (age + 1).cast("int"))).otherwise(F.greatest(F.lit(0.1), F.lit(1.0) - age * F.lit(0.1)))

    return let(F.lit(current_year) - F.array_max(F.filter(found, lambda y: y <= current_year)), score)


def authority_score(url: Column | str, weights: dict[str, float], default: float = 0.5) -> Column:
    """Weight of the exact host, port left out."""
    u = F.lower(F.coalesce(_c(url), F.lit("")))
    rest = F.when(u.contains("://"), F.regexp_extract(u, r"://([\s\S]*)$", 1)).otherwise(u)
    domain = F.regexp_replace(F.regexp_extract(rest, r"^([^/?#]*)", 1), r":[^:]*$", "")
    out = F.lit(float(default))
    for d, w in weights.items():
        out = F.when(domain == d.lower(), F.lit(float(w))).otherwise(out)
    return out


def composite(scores: list[tuple[Column, float]], mean: bool = True) -> Column:
    """Weighted scores, summed or averaged."""
    total = sum((s * F.lit(float(w)) for s, w in scores), F.lit(0.0))
    return total / F.lit(float(len(scores))) if mean and scores else total


def link_score(url: Column | str, text: Column | str, terms: list[str]) -> Column:
    """Priority of a link: shares of the focus terms in text (twice) and path, content words, junk words."""
    path = F.translate(F.lower(Parts(url).path), "/-_", "   ")
    low = F.lower(F.coalesce(_c(text), F.lit("")))
    words = F.split(path, r"\s+")
    focus = F.lit(0.0)
    if terms:
        n = F.lit(float(len(terms)))
        focus = sum((low.contains(t).cast("double") for t in terms), F.lit(0.0)) / n * 2.0 + sum((path.contains(t).cast("double") for t in terms), F.lit(0.0)) / n
    content = sum((F.array_contains(words, w).cast("double") * 0.5 for w in CONTENT_WORDS), F.lit(0.0)) - sum((F.array_contains(words, w).cast("double") for w in JUNK_WORDS), F.lit(0.0))
    return focus + content


def is_asset(url: Column | str) -> Column:
    u = F.coalesce(_c(url), F.lit(""))
    skipped = reduce(lambda a, b: a | b, [F.lower(F.trim(u)).startswith(s) for s in SKIPPED_SCHEMES])
    return skipped | u.rlike(ASSET)


def pattern_filter(url: Column | str, include: list[str] = (), exclude: list[str] = ()) -> Column:
    """Whether a url passes: any exclude pattern rejects; with include patterns one must match.

    Globs are tried on url, path and path without its slash; 're:' starts a regular
    expression; other patterns are substrings, case not counting. Compiled to
    expressions when the plan is made.
    """
    u = F.coalesce(_c(url), F.lit(""))
    p = Parts(url).path
    path = F.when(p == "", F.lit("/")).otherwise(p)

    def matches(pattern: str) -> Column:
        if pattern.startswith("re:"):
            return u.rlike(pattern[3:])
        if set("*?[") & set(pattern):
            rx = "(?is)^(?:" + _glob(pattern) + r")\z"
            return u.rlike(rx) | path.rlike(rx) | F.regexp_replace(path, "^/+", "").rlike(rx)
        return F.lower(path).contains(pattern.lower()) | F.lower(u).contains(pattern.lower())

    if len(include) + len(exclude) > 64 or any(len(x) > 512 for x in (*include, *exclude)):
        raise ValueError("at most 64 patterns of at most 512 characters")
    ok = reduce(lambda a, b: a | b, [matches(x) for x in include]) if include else F.lit(True)
    return ok & ~reduce(lambda a, b: a | b, [matches(x) for x in exclude]) if exclude else ok


def _glob(pattern: str) -> str:
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and "]" in pattern[i + 2 :]:
            end = pattern.index("]", i + 2)
            body = pattern[i + 1 : end].replace("\\", "\\\\")
            out.append("[" + ("^" + body[1:] if body.startswith("!") else body) + "]")
            i = end
        else:
            out.append("\\" + c if c in r"\.^$+{}()|[]-#&~" else c)
        i += 1
    return "".join(out)


def domain_filter(url: Column | str, allowed: list[str] = (), blocked: list[str] = ()) -> Column:
    """Blocked beats allowed; subdomains count; a url without host is rejected."""
    h = host(url)
    ok = h != ""
    if blocked:
        ok = ok & ~in_domains(h, [d.lower() for d in blocked])
    return ok & in_domains(h, [d.lower() for d in allowed]) if allowed else ok


def type_filter(url: Column | str, allowed: list[str], content_type: Column | None = None) -> Column:
    """By the given content type, else by the extension; urls without extension pass."""
    low = [a.lower() for a in allowed]
    good = sorted(e for e, m in MIME.items() if any(a in m or m in a for a in low))
    name = F.substring_index(Parts(url).path, "/", -1)
    ext = F.when(name.contains("."), F.lower(F.substring_index(name, ".", -1))).otherwise(F.lit(""))
    by_ext = (ext == "") | ext.isin(*good)
    if content_type is None:
        return by_ext
    media = media_type(content_type)
    return F.when(F.coalesce(content_type, F.lit("")) != "", (media != "") & reduce(lambda a, b: a | b, [media.contains(a) for a in low])).otherwise(by_ext)


def media_type(value: Column | str) -> Column:
    """Normalised type/subtype of a content-type header, '' where it can't be read."""
    media = F.lower(F.trim(F.substring_index(F.coalesce(_c(value), F.lit("")), ";", 1)))
    return F.when(media.rlike(r"^[a-z0-9!#$%&'*+.^_`|~\-]+/[a-z0-9!#$%&'*+.^_`|~\-]+$"), media).otherwise(F.lit(""))


def charset(value: Column | str) -> Column:
    """Charset parameter of a content-type header, lower-cased, null without one."""
    found = F.regexp_extract(F.coalesce(_c(value), F.lit("")), r"(?i);\s*charset\s*=\s*[\"']?([^;\"'\s]+)", 1)
    return F.when(found != "", F.lower(found))


def media_bucket(value: Column | str) -> Column:
    """json, pdf, image, html, text, binary or unknown."""
    m = media_type(value)
    return (
        F.when(m == "", "unknown")
        .when(m.isin("application/json", "text/json") | m.endswith("+json"), "json")
        .when(m == "application/pdf", "pdf")
        .when(m.startswith("image/"), "image")
        .when((m == "text/html") | m.endswith("+html") | (m == "application/xhtml+xml"), "html")
        .when(m.startswith("text/") | (m == "application/xml") | m.endswith("+xml"), "text")
        .otherwise("binary")
    )


def unwrap_result(url: Column | str) -> Column:
    """Target of a search engine's redirect url (q=, RU=, base64 u=); other urls as they are."""
    u = F.coalesce(_c(url), F.lit(""))
    q = F.try_url_decode(F.regexp_extract(u, r"/url\?(?:[^#]*&)?q=([^&#]*)", 1))
    ru = F.try_url_decode(F.regexp_extract(u, r"/RU=((?:(?!/RK=|/RS=)[\s\S])*)", 1))
    b64 = F.substring(F.regexp_extract(u, r"[?&]u=([^&#]*)", 1), 3, 2_000_000_000)
    target = F.unbase64(F.translate(b64, "-_", "+/")).cast("string")
    return (
        F.when(u.rlike(r"^https?://(?:www\.)?google\.[^/]+/url\?") & (F.coalesce(q, F.lit("")) != ""), q)
        .when(u.contains("/RU=") & (F.coalesce(ru, F.lit("")) != ""), ru)
        .when(u.rlike(r"^https?://(?:www\.)?bing\.com/ck/") & (F.length(b64) > 0), target)
        .otherwise(u)
    )


def platform(url: Column | str) -> Column:
    """Social platform of a plain https url, null for others."""
    p = Parts(url)
    ok = p.good & (p.scheme == "https") & p.port.isin("", "443")
    return F.when(ok & p.host.isin("instagram.com", "www.instagram.com", "m.instagram.com"), "instagram").when(ok & p.host.isin("tiktok.com", "www.tiktok.com", "m.tiktok.com", "vm.tiktok.com"), "tiktok")

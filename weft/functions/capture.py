"""What a page fetched behind its back: which responses carry data, what they are worth, and pages that wait for them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weft.functions.dom import Node, parse

# What requests carry data, and what marks hosts and paths that never do.
REQUESTS = ("xhr", "fetch")
MEDIA = ("application/json", "text/html", "text/plain", "text/xml", "application/xml", "application/ld+json", "text/csv")
NOISE_HOSTS = (
    "google-analytics", "googletagmanager", "googlesyndication", "doubleclick", "googleadservices", "adservice", "adsystem", "adnxs", "criteo", "taboola", "outbrain", "pubmatic",
    "rubiconproject", "openx", "smartadserver", "facebook.com", "facebook.net", "connect.facebook", "hotjar", "mixpanel", "amplitude", "segment.io", "segment.com", "sentry.io", "bugsnag",
    "newrelic", "nr-data.net", "clarity.ms", "quantserve", "scorecardresearch", "chartbeat", "parsely", "cloudflareinsights", "onetrust", "cookielaw", "sourcepoint", "usercentrics",
    "trustarc", "optimizely", "branch.io", "snowplow", "matomo", "piwik", "statcounter", "adsrvr", "casalemedia", "moatads", "krxd.net", "demdex", "omtrdc.net", "adobedtm", "tiqcdn",
    "challenges.cloudflare.com", "html-load.cc", "hcaptcha.com", "recaptcha.net", "google.com/recaptcha", "perimeterx", "px-cloud", "datadome.co", "captcha-delivery", "arkoselabs",
    "funcaptcha", "imperva", "incapsula", "akamaihd", "akstat.io",
)
NOISE_PATHS = (
    "/analytics", "/telemetry", "/beacon", "/collect", "/pixel", "/track", "/tracking", "/metrics", "/log/", "/logs", "/event", "/events", "/heartbeat", "/ping", "/consent", "/gtm",
    "/gdpr", "/ccpa", "/error-report", "/csp-report", "/rum", "/stats", "/cdn-cgi/", "/wrapper/v2/", "/meta-data", "/pv-data", "/privacy-manager",
)
STATIC_HOSTS = ("static.", "assets.", "asset.", "cdn.", "cdn-", "img.", "images.", "media.", "fonts.", "icons.")
ASSETS = (".js", ".mjs", ".css", ".map", ".png", ".jpg", ".jpeg", ".gif", ".webp", ".svg", ".ico", ".woff", ".woff2", ".ttf", ".eot", ".mp4", ".webm", ".mp3", ".wasm", ".avif")
CONSENT = ("gdpr", "ccpa", "consent", "vendorlist", "privacymanager", "propertyid", "campaigns", "iabvendor", "usnat", "cookiepolicy", "legitimateinterest")
ANIMATION = ('"layers"', '"assets"', '"markers"', '"ddd"', '"ip"', '"op"')
STRUCTURE = ("<tr", "<td", "<li", "<table", '"data"', '"results"', '"items"', '"list"', '"series"', '"values"')
MOST_FRAGMENTS, PRIMARY_CHARS, OTHER_CHARS, RENDERED_CHARS = 12, 20_000, 2_000, 200
PANELS = frozenset("div section main article aside ul ol table tbody span p figure".split())
HOOKS = ("data-load", "data-ajax", "data-url", "data-endpoint", "data-remote", "data-feed", "data-widget", "data-src")
_WAITING = re.compile(r"loader|loading|spinner|skeleton|placeholder", re.I)


def _any(text: Column, marks: tuple[str, ...]) -> Column:
    return F.exists(F.array(*[F.lit(m) for m in marks]), lambda m: F.contains(text, m))


def _count(text: Column, marks: tuple[str, ...]) -> Column:
    return F.size(F.filter(F.array(*[F.lit(m) for m in marks]), lambda m: F.contains(text, m)))


def captured(url: Column | str, request: Column | str, media: Column | str, pattern: str | None = None) -> Column:
    """Whether a response may carry the page's data; a caller's pattern decides alone over data requests."""
    c = lambda x: F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit(""))
    asked = c(request).isin(*REQUESTS)
    if pattern is not None:
        return asked & c(url).rlike(pattern)
    address = F.lower(c(url))
    host = F.regexp_replace(F.regexp_replace(F.regexp_extract(address, r"^[a-z][a-z0-9+.\-]*://([^/?#]*)", 1), r"^.*@", ""), r":[0-9]*$", "")
    path = F.regexp_extract(address, r"^[a-z][a-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    kind = F.lower(F.trim(F.substring_index(c(media), ";", 1)))
    noise = _any(host, NOISE_HOSTS) | F.exists(F.array(*map(F.lit, STATIC_HOSTS)), lambda p: F.startswith(host, p)) | _any(path, NOISE_PATHS) | F.exists(F.array(*map(F.lit, ASSETS)), lambda p: F.endswith(path, p))
    return asked & ~noise & ((kind == "") | F.exists(F.array(*map(F.lit, MEDIA)), lambda p: F.startswith(kind, p)))


def consent_payload(text: Column | str) -> Column:
    """Whether a payload manages consent: two of the marks near its start."""
    t = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return _count(F.lower(F.substring(t, 1, 4000)), CONSENT) >= 2


def animation_payload(text: Column | str) -> Column:
    """Whether a payload draws an animation: three of the keys near its start."""
    t = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return _count(F.substring(t, 1, 2000), ANIMATION) >= 3


def fragment_score(text: Column | str, raw: Column | str) -> Column:
    """Worth of a payload as the page's data: size, damped, times figures, structure and rows; little for tiny ones."""
    t = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    body = F.lower(F.coalesce(F.col(raw) if isinstance(raw, str) else raw, F.lit("")))
    n = F.length(t)
    density = F.regexp_count(t, F.lit(r"\d")) / n
    marks = _count(body, STRUCTURE)
    rows = F.size(F.filter(F.split(t, "\n"), lambda l: F.trim(l) != ""))
    worth = (
        F.sqrt(n)
        * F.when(density > 0.02, 1 + F.least(density * 8, F.lit(3.0))).otherwise(1.0)
        * F.when(marks > 0, 1 + F.least(marks * 0.15, F.lit(0.6))).otherwise(1.0)
        * F.when(rows >= 5, 1 + F.least(rows / 100, F.lit(0.5))).otherwise(1.0)
        * F.when(n < 200, 0.2).otherwise(1.0)
    )
    return F.when(n > 0, worth).otherwise(0.0)


def ranked_fragments(fragments: DataFrame, page: str = "page", most: int = MOST_FRAGMENTS) -> DataFrame:
    """(page, place, url, text, primary) of each page's best payloads of (page, ord, url, text, raw, from_script).

    Consent and animation payloads and blank ones are left out. The best rendered one of
    some length comes before what was read from scripts; the number kept and the lengths
    are the feature. A page's payloads are few, as its browser bounds them.
    """
    kept = fragments.filter(F.trim("text") != "").filter(~consent_payload("text") & ~animation_payload("text"))
    scored = kept.withColumn("score", fragment_score("text", "raw"))
    own = Window.partitionBy(page)
    rendered = ~F.col("from_script") & (F.length("text") >= RENDERED_CHARS)
    first = F.min(F.when(rendered, F.struct(-F.col("score"), F.col("ord")))).over(own)
    lead = F.coalesce(first["ord"] == F.col("ord"), F.lit(False))
    placed = scored.withColumn("lead", lead).withColumn("place", F.row_number().over(own.orderBy(F.desc("lead"), F.desc("score"), F.asc("ord")))).filter(F.col("place") <= most)
    primary = (F.col("place") == 1) & (F.col("score") > 0)
    return placed.select(page, "place", "url", F.when(primary, F.substring("text", 1, PRIMARY_CHARS)).otherwise(F.substring("text", 1, OTHER_CHARS)).alias("text"), primary.alias("primary"))


def waiting_panels(root: Node) -> int:
    """Outermost containers that hold hardly any text and are marked to be filled later."""
    found, todo = 0, list(reversed(root.elements()))
    while todo:
        n = todo.pop()
        if n.tag in PANELS and _waits(n):
            found += 1
        else:
            todo += reversed(n.elements())
    return found


def _waits(n: Node) -> bool:
    if len(n.text().strip()) > 80:
        return False
    marked = any(_WAITING.search(f"{k}={v}") for k, v in n.attrs.items())
    inside = any(_WAITING.search(c.attrs.get("class", "")) or (c.tag == "img" and _WAITING.search(c.attrs.get("src") or c.attrs.get("data-src", ""))) for c in n.nodes())
    return marked or inside or any(h in n.attrs for h in HOOKS)


def ajax_shell(html: str | None, text: str | None, least_bytes: int = 20_000) -> bool:
    """Whether a page's panels still wait for their data: a large page with text, hardly a figure in it, and two such panels."""
    h, t = html or "", text or ""
    if len(h) < least_bytes or len(t) < 200 or sum(c.isdigit() for c in t) >= 0.005 * len(t):
        return False
    return waiting_panels(parse(h)) >= 2

"""Page signals, kinds and block detection as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weft.functions.text import visible_text

_FRAMEWORK = r'(?i)id=["\'](?:root|app|__next|__nuxt)["\']|data-reactroot|ng-app|window\.__NUXT__'
# Markers of challenge vendors, and weaker ones that count with an error status.
VENDOR = r"(?i)pardon\s+our\s+interruption|attention\s+required|captcha-delivery\.com|_Incapsula_Resource|blocked\s+by\s+network\s+security"
MARKER = r"(?i)access\s+denied|checking\s+your\s+browser|g-recaptcha|h-captcha"


def signals(html: Column) -> dict[str, Column]:
    """Visible text length, scripts, links, and whether a client framework draws the page."""
    return {
        "text_len": F.length(visible_text(html)),
        "scripts": F.regexp_count(html, F.lit(r"(?i)<script\b")),
        "links": F.regexp_count(html, F.lit(r"(?i)<a\b[^>]*href")),
        "framework": html.rlike(_FRAMEWORK),
    }


def kind(md: Column, text_len: Column, links: Column, link_text: Column, scripts: Column, framework: Column) -> dict[str, Column]:
    """list, article, js_shell or fallback, and whether the content is enough."""
    dense = link_text / F.greatest(text_len, F.lit(1)) >= 0.5
    k = (
        F.when((links >= 10) & dense, "list").when(md >= 200, "article").when(links >= 10, "list")
        .when((text_len < 400) & ((scripts >= 5) | framework), "js_shell").otherwise("fallback")
    )
    return {"kind": k, "ok": md >= 50}


def block(status: Column, text: Column) -> Column:
    """Why a response is a block page: rate, vendor, status, marker, empty; none if it isn't."""
    t = F.coalesce(text, F.lit(""))
    data = t.rlike(r"^\s*[\[{]")
    bare = F.length(F.trim(F.translate(t, "\n\t\r", "   ")))
    return (
        F.when(status == 429, "rate").when(t.rlike(VENDOR), "vendor").when(status.isin(403, 503) & ~data, "status")
        .when((status >= 400) & (F.length(t) < 10_000) & t.rlike(MARKER), "marker").when((status == 200) & (bare < 100) & ~data, "empty").otherwise("none")
    )


def error_page_type(error: Column) -> Column:
    """Page type that an error text implies, '' for none."""
    e = F.lower(F.coalesce(error, F.lit("")))
    return F.when(e.startswith("js_shell_detected"), "js_shell").when(e.startswith("auth_required") | (e.startswith("not_a_pdf") & e.contains("auth")), "auth_wall").when(e.startswith("geo_redirect_detected"), "redirect").otherwise("")

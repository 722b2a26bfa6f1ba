"""What a stored response is and what is wrong with it: routes by media, quality notes, ladders of errors, dates of documents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weft.functions.urls import media_bucket

# What shells, challenges and region pages say.
SHELL = (
    "enable javascript", "you need to enable javascript", "javascript is required", "javascript is disabled", "javascript to run this app", "javascript must be enabled", "please enable javascript",
    "requires javascript", "we've detected that javascript is disabled", "javascript is disabled in this browser", "enable javascript to run this app",
)
CHALLENGE = ("challenges.cloudflare.com/turnstile", "cf-turnstile", "cf_chl_opt", "__cf_chl", "cf-browser-verification", "challenge-platform", "cf-mitigated")
REGION = ("choose a country", "select your country", "select your region", "shopping in the u.s.", "choose your country", "country selector", "region selector")
LOGIN = ("sign in", "log in", "login", "password", "subscribe", "paywall", "access denied", "authenticate")


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _says(text: Column, marks: tuple[str, ...]) -> Column:
    return F.exists(F.array(*[F.lit(m) for m in marks]), lambda m: F.contains(text, m))


def route(url: Column | str, content_type: Column | str, body: Column | str) -> Column:
    """How a response is read: json, pdf, auth_required or not_a_pdf (a page in place of one), image, listing or html.

    The first that fits counts; ``body`` is the response as text. An empty body is no json, pdf or image.
    """
    u, b = F.lower(F.coalesce(_c(url), F.lit(""))), F.coalesce(_c(body), F.lit(""))
    bucket, filled = media_bucket(_c(content_type)), F.coalesce(_c(body), F.lit("")) != ""
    is_pdf = F.startswith(b, F.lit("%PDF"))
    host = F.regexp_extract(u, r"^[a-z]+://([^/?#:]*)", 1)
    return (
        F.when(filled & (bucket == "json"), "json")
        .when(filled & ((bucket == "pdf") | is_pdf), "pdf")
        .when(filled & F.endswith(F.substring_index(u, "?", 1), F.lit(".pdf")), F.when(_says(F.lower(F.substring(b, 1, 4096)), LOGIN), "auth_required").otherwise("not_a_pdf"))
        .when(filled & (bucket == "image"), "image")
        .when((host == "old.reddit.com") & ~F.contains(u, F.lit("/comments/")), "listing")
        .otherwise("html")
    )


def quality(status: Column | str, text: Column | str, size: Column | str, content_type: Column | str, fetcher: Column | str) -> Column:
    """What makes a response unusable, '' for nothing: a script shell, a region page, a challenge, an error status, no answer."""
    s, low = F.coalesce(_c(status), F.lit(0)), F.lower(F.trim(F.coalesce(_c(text), F.lit(""))))
    kind, via = F.coalesce(_c(content_type), F.lit("")), F.coalesce(_c(fetcher), F.lit(""))
    page = (kind == "") | (media_bucket(kind) == "html")
    thin = via.isin("http", "stealthy") & (s == 200) & (F.coalesce(_c(size), F.lit(0)) > 3000) & (F.length(F.coalesce(_c(text), F.lit(""))) < 200)
    shell = page & ((low == "") | _says(low, SHELL) | ((via == "http") & (s == 200) & _says(low, CHALLENGE)) | thin)
    return (
        F.when(shell, "js_shell_detected").when(_says(low, REGION), "geo_redirect_detected").when(s.isin(403, 503) & _says(low, CHALLENGE), "bot_challenge_detected")
        .when(s >= 400, F.concat(F.lit("http_error_"), s.cast("string"))).when(s == 0, "network_error").otherwise("")
    )


def media_error(text: Column | str) -> Column:
    """Category of a media tool's error text."""
    t = F.lower(F.coalesce(_c(text), F.lit("")))
    return (
        F.when(_says(t, ("429", "too many requests", "rate limit")), "rate_limited").when(_says(t, ("sign in to confirm", "authentication", "login")), "authentication_or_block")
        .when(_says(t, ("timed out", "timeout", "connection reset", "network")), "network").otherwise("tool_or_source")
    )


def wait_for(seconds: Column | str, asked: Column | str | None = None, default: int = 300, most: int = 600) -> Column:
    """Seconds to allow for media of a length: in steps, or what was asked within bounds; the default where nothing is known."""
    s = _c(seconds)
    steps = F.when(s.isNull() | F.isnan(s.cast("double")), default).when(s <= 60, 60).when(s <= 300, 120).when(s <= 900, 300).otherwise(most)
    if asked is None:
        return steps
    a = _c(asked)
    return F.when(a.isNotNull(), F.greatest(F.lit(1), F.least(a.cast("int"), F.lit(most)))).otherwise(steps)


def document_date(text: Column | str) -> Column:
    """Date of a document property like D:20240131…; other texts as they are, '' for none."""
    bare = F.regexp_replace(F.coalesce(_c(text), F.lit("")), r"^D:", "")
    return F.when(bare.rlike(r"^\d{8}"), F.regexp_replace(bare, r"^(\d{4})(\d{2})(\d{2})[\s\S]*$", "$1-$2-$3")).otherwise(bare)


def within(value: Column | str, least: float, most: float, default: float) -> Column:
    """A number held within bounds; the default for nulls, what is no number, and infinite values."""
    v = _c(value).try_cast("double")
    fine = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    return F.when(fine, F.greatest(F.lit(float(least)), F.least(v, F.lit(float(most))))).otherwise(F.lit(float(default)))

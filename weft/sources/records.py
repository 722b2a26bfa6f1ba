"""Records of feeds, archives, media, profiles and declared interfaces in one shape, and what a resumed collection has already seen."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LISTING_HOST, FEED_HOST = "old.reddit.com", "www.reddit.com"
#: Fields of a media entry that are kept where they are present.
MEDIA_FIELDS = ("id", "title", "description", "uploader", "channel", "channel_id", "channel_follower_count", "timestamp", "upload_date", "duration", "view_count", "like_count", "comment_count", "thumbnail", "extractor")
ACCOUNT_STATES = ("claimed", "available", "unknown", "error", "declared")
_ITEM = r"/(?:reel|p|tv|video)/([^/?#]+)"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)


def _is_host(host: Column) -> Column:
    return (host == "reddit.com") | F.endswith(host, F.lit(".reddit.com"))


def listing_url(url: Column | str) -> Column:
    """A listing's address on the host that serves smaller pages; threads and other hosts stay as they are."""
    u = _c(url)
    h = _host(u)
    moved = F.regexp_replace(u, r"^([A-Za-z][A-Za-z0-9+.\-]*://)[^/?#]*", f"$1{LISTING_HOST}")
    return F.when(_is_host(h) & (h != LISTING_HOST) & ~F.contains(_path(u), F.lit("/comments/")), moved).otherwise(u)


def feed_kind(url: Column | str) -> Column:
    """thread, search or subreddit, by a feed address's path."""
    p = F.regexp_replace(_path(_c(url)), r"/+$", "")
    return F.when(p.rlike(r"(?i)/comments/[^/]+(?:\.rss)?$"), "thread").when((F.endswith(p, F.lit(".rss")) & F.contains(p, F.lit("/search"))) | F.contains(p, F.lit("/search.rss")), "search").otherwise("subreddit")


def entry_kind(entry_id: Column | str, feed_url: Column | str) -> Column:
    """comment, submission or entry, by the entry's id prefix and the feed's path."""
    e = F.coalesce(_c(entry_id), F.lit(""))
    in_thread = F.contains(_path(_c(feed_url)), F.lit("/comments/")) & (e != "")
    return F.when(F.startswith(e, F.lit("t1_")) | (~F.startswith(e, F.lit("t3_")) & in_thread), "comment").when(F.startswith(e, F.lit("t3_")), "submission").otherwise("entry")


def feed_url(target: Column | str) -> Column:
    """Feed address of a group's name, a listing, a search or a thread on the feed's host."""
    t = F.trim(F.coalesce(_c(target), F.lit("")))
    address = F.when(F.contains(t, F.lit("://")), t).otherwise(F.concat(F.lit(f"https://{FEED_HOST}/"), F.regexp_replace(t, "^/+", "")))
    path, query = F.regexp_replace(_path(address), r"/+$", ""), F.regexp_extract(address, r"\?([^#]*)", 1)
    named = F.when(path.rlike(r"^/(?:r|user|u|comments)/"), path).otherwise(F.concat(F.lit("/r/"), F.regexp_replace(path, "^/+", "")))
    thread = F.regexp_extract(named, r"(?i)(/comments/[^/]+)", 1)
    built = (
        F.when(F.endswith(path, F.lit(".rss")), path)
        .when(thread != "", F.when(F.endswith(thread, F.lit(".rss")), thread).otherwise(F.concat(thread, F.lit(".rss"))))
        .when(F.contains(named, F.lit("/search")), F.regexp_replace(named, "/search", "/search.rss"))
        .otherwise(F.concat(named, F.lit(".rss")))
    )
    keep = (query != "") & (thread == "")
    return F.concat(F.lit(f"https://{FEED_HOST}"), built, F.when(keep, F.concat(F.lit("?"), query)).otherwise(F.lit("")))


RECORD = "id string, title string, body string, author string, url string, published_at string, source string, source_type string"


def feed_records(entries: DataFrame) -> DataFrame:
    """Feed entries (id, title, link, author, published, summary, content, feed) as source-neutral records."""
    text = lambda c: F.coalesce(c, F.lit(""))
    body = F.coalesce(F.when(text(F.col("content")) != "", F.col("content")), F.col("summary"))
    return entries.select("id", text(F.col("title")).alias("title"), text(body).alias("body"), text(F.col("author")).alias("author"), F.col("link").alias("url"), text(F.col("published")).alias("published_at"), F.lit("reddit").alias("source"), F.lit("reddit_rss").alias("source_type"))


def archive_records(items: DataFrame, payload: str = "payload") -> DataFrame:
    """Archive items, one JSON payload a row, as source-neutral records; the first field that has a value counts."""
    p = F.col(payload)

    def first(*names: str) -> Column:
        return F.coalesce(*[F.when(F.get_json_object(p, f"$.{n}") != "", F.get_json_object(p, f"$.{n}")) for n in names], F.lit(""))

    link = first("permalink", "url")
    return items.select(
        first("id", "name").alias("id"), first("title").alias("title"), first("selftext", "body").alias("body"), first("author", "author_fullname").alias("author"),
        F.when(F.startswith(link, F.lit("/")), F.concat(F.lit(f"https://{FEED_HOST}"), link)).otherwise(link).alias("url"), first("created_utc", "created").alias("published_at"),
        F.lit("reddit").alias("source"), F.lit("arctic_shift").alias("source_type"),
    )


def media_entries(items: DataFrame, payload: str = "payload") -> DataFrame:
    """Media entries of JSON payloads: the fields that are kept, as text, and the page's address, built from the id where none is given."""
    p = F.col(payload)
    got = lambda n: F.get_json_object(p, f"$.{n}")
    page = F.coalesce(F.when(got("webpage_url") != "", got("webpage_url")), F.when(got("original_url") != "", got("original_url")), F.when(F.trim(got("id")) != "", F.concat(F.lit("https://www.youtube.com/watch?v="), F.trim(got("id")))))
    return items.select(*[got(n).alias(n) for n in MEDIA_FIELDS], page.alias("webpage_url"))


def account_matches(items: DataFrame, payload: str = "payload") -> DataFrame:
    """(site, url, status, confidence) of account matches in JSON payloads; those without site or secure address are left out."""
    p = F.col(payload)

    def first(*names: str) -> Column:
        return F.trim(F.coalesce(*[F.when(F.get_json_object(p, f"$.{n}") != "", F.get_json_object(p, f"$.{n}")) for n in names], F.lit("")))

    state = F.lower(first("status", "status_code"))
    status = F.when(state.isin(*ACCOUNT_STATES), state).otherwise("unknown")
    raw = F.get_json_object(p, "$.score")
    score = F.when(raw.isNull(), F.when(status == "claimed", 1.0).otherwise(0.0)).otherwise(F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw.try_cast("double"))), F.lit(0.0)))
    return items.select(first("site", "site_name", "name").alias("site"), first("url", "site_url", "link").alias("url"), status.alias("status"), score.alias("confidence")).filter((F.col("site") != "") & F.col("url").rlike(r"^https://[^/?#]+"))


def aliases(platform: Column, code: Column, url: Column) -> Column:
    """Every stable name of a record: its code and its address without query, and the code within the address, by platform."""
    scope = F.when(F.coalesce(platform, F.lit("")) != "", F.concat(F.lower(F.trim(platform)), F.lit(":"))).otherwise("")
    token = F.trim(F.coalesce(code, F.lit("")))
    u = F.trim(F.coalesce(url, F.lit("")))
    bare = F.regexp_replace(F.regexp_replace(u, r"[?#][\s\S]*$", ""), r"/+$", "")
    inner = F.regexp_extract(_path(u), _ITEM, 1)
    names = F.array(
        F.when(token != "", F.concat(scope, F.lit("id:"), token)), F.when(u.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+"), F.concat(scope, F.lit("url:"), bare)), F.when(inner != "", F.concat(scope, F.lit("id:"), inner))
    )
    return F.array_distinct(F.filter(names, lambda x: x.isNotNull()))


def unseen(items: DataFrame, seen: DataFrame, rounds: int = 30) -> DataFrame:
    """Items (item, ord, names) of which no name was seen, and within the batch none of an earlier item kept.

    ``seen`` has (name). Items without names are kept. Within a batch an item is dropped for
    an earlier one only if that one itself is kept, so rounds settle what is the first of its names.
    """
    from weft.plans.staging import stage

    named = items.select("item", "ord", F.explode("names").alias("name"))
    met = named.join(seen.select("name").distinct(), "name", "left_semi").select("item").distinct()
    open_ = stage(named.join(met, "item", "left_anti"), "aliases")
    kept = items.filter(F.size("names") == 0).select("item", "ord")
    for _ in range(rounds):
        if open_.isEmpty():
            break
        # an item that is the first under each of its names is kept; whoever shares a name with it is dropped
        first = open_.groupBy("name").agg(F.min("ord").alias("first"))
        ranked = open_.join(first, "name").groupBy("item", "ord").agg(F.max((F.col("first") < F.col("ord")).cast("int")).alias("later"))
        won = stage(ranked.filter("later = 0").select("item", "ord"), "won")
        kept = kept.unionByName(won)
        taken = open_.join(won.select("item"), "item", "left_semi").select("name").distinct()
        gone = open_.join(taken, "name", "left_semi").select("item").distinct()
        open_ = stage(open_.join(gone, "item", "left_anti"), "aliases")
    else:
        raise RuntimeError("aliases did not settle; raise rounds")
    return kept


def grid_posts(grid: DataFrame, payloads: DataFrame, host: str = "https://www.instagram.com") -> DataFrame:
    """Posts of a rendered grid (url, visible, caption, cover) joined with their payloads (code, is_video, caption, views, likes, comments, cover) by code.

    Payloads that the grid doesn't show come along under an address of their own. What a
    payload lacks is read from the visible text; what neither has stays null.
    """
    g = grid.select(F.regexp_extract("url", r"/(?:reel|p|tv)/([^/?#]+)", 1).alias("code"), F.col("url").alias("g_url"), F.coalesce("visible", F.lit("")).alias("visible"), F.col("caption").alias("g_caption"), F.col("cover").alias("g_cover"))
    g = g.withColumn("code", F.when(F.col("code") != "", F.col("code")))
    p = payloads.select("code", "is_video", F.col("caption").alias("p_caption"), "views", "likes", "comments", F.col("cover").alias("p_cover"))
    own = F.concat(F.lit(host + "/"), F.when(F.col("is_video"), "reel").otherwise("p"), F.lit("/"), F.col("code"), F.lit("/"))

    def metric(name: str, word: str) -> Column:
        seen = F.regexp_extract("visible", rf"(?i)([\d,.]+[KMB]?)\s*{word}", 1)
        return F.coalesce(F.col(name).cast("string"), F.when(seen != "", seen)).alias(name)

    return g.join(p, "code", "full_outer").withColumn("visible", F.coalesce("visible", F.lit(""))).select(
        "code", F.coalesce("g_url", own).alias("url"), F.coalesce("p_caption", "g_caption").alias("caption"), metric("views", "(?:views?|plays?)"), metric("likes", "likes?"), metric("comments", "comments?"), F.coalesce("g_cover", "p_cover").alias("cover"),
    )


def carried_likes(lines: DataFrame, group: str = "page", order: str = "ord") -> DataFrame:
    """(group, order, text, likes) of comment lines; a line like "12 likes" belongs to the next comment."""
    w = Window.partitionBy(group).orderBy(order)
    likes = F.regexp_extract(F.trim("line"), r"^([\d,]+) likes$", 1)
    filled = lines.filter(F.trim("line") != "").withColumn("n", F.when(likes != "", F.regexp_replace(likes, ",", "").cast("int")))
    return filled.withColumn("before", F.lag("n").over(w)).filter("n is null").select(group, order, F.trim("line").alias("text"), F.col("before").alias("likes"))


_TEMPLATE = re.compile(r"\{([A-Za-z][\w.\-]{0,63})\}")


def at_path(value, path: str):
    """The value at a dotted path of nested mappings; None where it ends."""
    for part in filter(None, path.split(".")):
        if not isinstance(value, dict) or part not in value:
            return None
        value = value[part]
    return value


def filled(template, arguments: dict):
    """A template with its whole-value references {a.b} replaced; other strings stay."""
    if isinstance(template, dict):
        return {k: filled(v, arguments) for k, v in template.items()}
    if isinstance(template, list):
        return [filled(v, arguments) for v in template]
    found = _TEMPLATE.fullmatch(template) if isinstance(template, str) else None
    return at_path(arguments, found[1]) if found else template


def paged(responses: dict[str, dict], first: str, spec: dict) -> list[dict]:
    """Items of stored pages of a declared interface, followed from page to page: (ord, page, item).

    ``responses`` holds what each page's key gave. ``spec`` is {items, next, mode, max_pages}: dotted
    paths to the items and to the next page's key; in page and offset mode a missing key means the next number.
    """
    out, at, n = [], first, 0
    while at in responses and n < int(spec.get("max_pages", 10)):
        n += 1
        items = at_path(responses[at], spec.get("items", "")) or []
        if not isinstance(items, list):
            raise ValueError("items must name a list")
        out += [{"ord": len(out) + i, "page": at, "item": x} for i, x in enumerate(items)]
        following = at_path(responses[at], spec["next"]) if spec.get("next") else None
        if following in (None, "", False):
            if spec.get("mode") not in ("page", "offset") or not items:
                break
            following = n + 1
        at = str(following)
    return out

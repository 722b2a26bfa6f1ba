import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weft.functions import pages as P
from weft.functions import text as T
from weft.functions import urls as U


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'string' if not isinstance(v, int) else 'int'}" for k, v in values.items()) or "x int"
    return spark.createDataFrame([tuple(values.values()) or (1,)], schema).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "url,key",
    [
        ("HTTPS://Example.COM:443/a/b/?b=2&utm_source=x&a=1#top", "https://example.com/a/b?b=2&a=1"),
        ("http://example.com:8080/", "http://example.com:8080/"),
        ("//example.com/x", "https://example.com/x"),
        ("http://user:pw@example.com/", ""),
        ("file:///etc/passwd", ""),
        ("http://example.com/\nx", ""),
        ("http://example.com:99999/", ""),
        ("http://example.com/?%75tm_medium=1&q=2", "http://example.com/?q=2"),
        (None, ""),
        ("", ""),
    ],
)
def test_dedupe_key(spark, url, key):
    assert one(spark, U.dedupe_key("u"), u=url) == key


def test_search_key_folds_repositories(spark):
    assert one(spark, U.search_key("u"), u="https://github.com/Owner/Repo/tree/Main") == "https://github.com/owner/repo/tree/Main"
    assert one(spark, U.search_key("u"), u="https://github.com/Topics/Big/") == "https://github.com/Topics/Big"


@settings(max_examples=1, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="abcAB:/?&=#%.@-_ 12", max_size=40), min_size=60, max_size=60))
def test_keys_are_idempotent(spark, tails):
    df = spark.createDataFrame([("http://a.example/" + t,) for t in tails], "u string").select(U.crawl_key("u").alias("k"))
    assert df.select("k", U.crawl_key("k").alias("again")).filter("k <> again").count() == 0


@pytest.mark.parametrize("pattern,url,ok", [("docs/*", "https://a.example/docs/x", True), ("*.pdf", "https://a.example/b.PDF", True), ("/admin", "https://a.example/Admin/panel", True), ("re:x[0-9]+$", "https://a.example/x12", True), ("docs/*", "https://a.example/blog/x", False)])
def test_patterns(spark, pattern, url, ok):
    assert one(spark, U.pattern_filter("u", [pattern]), u=url) is ok
    assert one(spark, U.pattern_filter("u", [], [pattern]), u=url) is not ok


def test_freshness_and_depth(spark):
    assert one(spark, U.freshness_score("u"), u="https://a.example/2022/05/x-2030") == pytest.approx(0.8)
    assert one(spark, U.freshness_score("u"), u="https://a.example/x") == 0.5
    assert one(spark, U.freshness_score("u"), u="https://a.example/1999/x") == 0.1
    assert one(spark, U.depth_score("u"), u="https://a.example/a/b/c?x=/d") == 0.5


def test_focus_keeps_sections_tables_and_headings(spark):
    text = "# Guide\n\nNothing here at all\n\n## Engine parts\n\nfirst para\n\n### Deep\n\nsecond para\n\n## Other\n\nlast para\n\n| a | engine |\n| - | - |"
    rows = spark.createDataFrame([(text,)], "t string").select(F.inline(T.focus("t", ["engine"]))).collect()
    assert [r["ix"] for r in rows if r["kept"]] == [2, 3, 4, 5, 8]
    assert one(spark, F.size(T.focus("t", ["engine"])), t="one block only") == 0
    assert one(spark, F.size(T.focus("t", ["engine"])), t=None) == 0


def test_collapse_and_captions(spark):
    lines = "\n".join(["x" * 150] * 20 + ["Read more"] * 8)
    out = one(spark, T.collapse_lines("t"), t=lines)
    assert out.count("Read more") == 2 and "[6 repeated nav controls collapsed]" in out
    assert one(spark, T.captions("t"), t="WEBVTT\n\n1\n00:00:01.000 --> 00:00:02.000\n<i>Hello</i>\n\n2\n00:00:02.000 --> 00:00:03.000\nHello\nNOTE x\nWorld") == "Hello\nWorld"


def test_small_texts(spark):
    assert one(spark, T.redact("t"), t="at https://u:p@h.example/ with sk-" + "a" * 24) == "at https://[CREDENTIALS_REDACTED]@h.example/ with [API_KEY_REDACTED]"
    assert one(spark, T.safe_links("t"), t="[a](javascript:x) [b](https://c)") == "[a](#) [b](https://c)"
    assert one(spark, T.dehyphenate(F.split("t", "\n")), t="a well-\nknown Big-\nName") == "a wellknown Big- Name"
    assert one(spark, T.clean_query("t"), t=" \x00 ") in (None, "")
    assert one(spark, F.array_join(T.page_list("t", F.lit(6)).cast("array<string>"), ","), t="3-1,5,9,x") == "1,2,3,5"
    assert str(one(spark, T.parse_date("t"), t="March 3, 2021")) == "2021-03-03"
    assert one(spark, T.parse_date("t"), t="no date") is None


def test_clean_value(spark):
    assert one(spark, T.clean_value("t"), t="a\u200bb\x07c\td\ufeff") == "abc\td"


def test_semantic_chunks(spark):
    text = " ".join(f"Sentence number {i} has six words." for i in range(20))
    got = one(spark, T.semantic_chunks(18, 6)("t"), t=text)
    assert all(len(c.split()) <= 24 for c in got) and got[1].startswith("Sentence number 2")
    assert one(spark, T.semantic_chunks(18, 6)("t"), t="   ") == []


@pytest.mark.parametrize("status,text,kind", [(429, "x", "rate"), (403, "<html>" + "x" * 200, "status"), (403, '{"a": 1}', "none"), (200, "tiny", "empty"), (200, "Pardon our interruption", "vendor"), (404, "Access denied", "marker"), (200, "y" * 200, "none")])
def test_blocks(spark, status, text, kind):
    assert one(spark, P.block(F.col("s"), F.col("t")), s=status, t=text) == kind

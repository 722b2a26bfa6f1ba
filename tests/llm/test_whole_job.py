import random

import pytest
from test_text_operators import entries, prose

from weft.llm import furniture, language, mixing, packing, residue, scans, splitting

# --- problem 6


def test_copies_hide_no_furniture(spark):
    rng = random.Random(21)

    def page(title, paragraphs, extra=""):
        return f"Home | About us | Contact\n\n# {title}\n\n{paragraphs[0]}\n\n{paragraphs[1]}{extra}\n\nFollow us on your favourite network"

    rows, bodies = [], []
    for i in range(12):
        bodies.append([f"The {prose(rng, 40)[:-1]} of the day.", f"It is a {prose(rng, 40)[:-1]} in the end."])
        rows.append((i, f"https://donmo.example/p{i}", page(f"Article {'abcdefghijkl'[i]} on {prose(rng, 4)[:-1]}", bodies[i])))
    menu, title = rows[0][2], rows[0][2].split("\n")[2][2:]
    rows += [(100 + i, f"https://donmo.example/p0?v={i}", menu) for i in range(30)]  # copies
    rows += [(200 + i, f"https://donmo.example/p0?w={i}", page(title, bodies[0], f" And {prose(rng, 6)}")) for i in range(30)]  # edited copies
    rows += [(300 + i, f"https://donmo.example/q{i}", page(f"Title {'abcdefghijklmnopqrstuvwx'[i]} anew", bodies[1])) for i in range(24)]  # copies under other titles
    rows += [(400 + i, f"https://donmo.example/e{i}", "Home | About us | Contact\n\nPage not found\n\nFollow us on your favourite network") for i in range(60)]  # no article
    got = {tuple(r) for r in furniture.furniture(entries(spark, rows)).collect()}
    assert got == {(i, 1 + n) for i, _, t in rows for n in (0, t.count("\n"))}


def test_an_article_of_several_hosts_counts_once(spark):
    rng = random.Random(22)
    own = [f"The {prose(rng, 40)[:-1]} of the day.", f"It is a {prose(rng, 12)[:-1]} in the end."]
    rows = [(i, f"https://host{'abcdefghijkl'[i // 2]}.example/p{i}", f"# The very same title here\n\n{own[0]}\n\n{own[1]}\n\nA short closing line") for i in range(24)]
    assert furniture.furniture(entries(spark, rows)).count() == 0


# --- problem 8


@pytest.mark.parametrize("bound", [1, 3, 5000])
def test_folded_patterns_fill_their_route(spark, monkeypatch, bound):
    monkeypatch.setattr(mixing, "MAX_PATTERNS", bound)
    rng = random.Random(6)
    docs = []
    for held in ("a", "b", "c", "ab", "ac", "bc", "abc"):
        for _ in range(20):
            text = prose(rng, 20)
            docs += [(len(docs) + k, text, src) for k, src in enumerate(held)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, source string")
    t = spark.createDataFrame([("a", 0.2, 2), ("b", 0.5, 2), ("c", 0.3, 1)], "source string, target_share double, max_repeats int")
    rep = {r["source"]: r for r in mixing.report(d, t).collect()}
    used = mixing.mix(d, t).collect()
    assert len({r["id"] for r in used}) == len(used)
    longest = max(r["tokens"] for r in used)
    for s, r in rep.items():
        n = sum(x["tokens"] * x["copies"] for x in used if x["source"] == s)
        assert r["used"] - 4 * longest <= n <= r["used"]
        assert all(x["copies"] <= r["max_repeats"] for x in used if x["source"] == s)


# --- problem 4


def test_filler_is_judged_whatever_comes_first():
    rng = random.Random(8)
    own = [f"The {prose(rng, 60)[:-1]} of the day." for _ in range(18)]
    filler = [prose(rng, 40) for _ in range(1, 80)]
    assert sum(map(len, own)) > 6800 and sum(map(len, filler)) > 2 * sum(map(len, own))
    assert residue.judge("\n".join(filler + own)) == "filler"
    assert residue.judge("\n".join(own + filler)) == "filler"
    assert residue.judge("\n".join(own + filler[:3])) is None


# --- problem 2


def test_true_counts_decide_on_misread_words(spark):
    filler = [f"{a}{b}{c}" for a in ("ba", "do", "ga", "pa") for b in ("sto", "gra", "pla", "dru") for c in ("xa", "zo", "ka")]
    rng = random.Random(13)
    line = lambda w: " ".join([rng.choice(filler), w, rng.choice(filler)])
    words = ["market"] * 250 + ["rnarket"] * 6 + ["modern"] * 15 + ["meadow"] * 60 + ["rneadow"] * 4
    docs = [(i, ["\n".join([*(line("garden") for _ in range(3)), line(w), *(line("garden") for _ in range(3))])], None) for i, w in enumerate(words)]
    # many words, so that a share of them would be a bar above these counts
    docs += [(1000 + i, ["\n".join(["gastoxa " * 400] * 60)], None) for i in range(70)]
    df = spark.createDataFrame(docs, "pdf_id bigint, content array<string>, title string")
    got = {r["id"] for r in scans.scan_noise(df).filter("kind = 'ocr'").collect()}
    assert got == set(range(250, 256))  # 6 against 250 is misread, 4 against 60 is not


def _topics(spark, rng):
    """Words of two topics; "clay" is a word of one, and a misread "day" in the other."""
    one = [f"{a}{b}" for a in ("mor", "sun", "win", "fros", "clou") for b in ("ning", "tide", "mer", "shine", "gale")]
    two = [f"{a}{b}" for a in ("pot", "kil", "gla", "bow", "jug") for b in ("tery", "nery", "zing", "lery", "gary")]
    def say(topic, *w):
        words = [rng.choice(topic) for _ in range(10 - len(w))]
        at = 4
        return " ".join([*words[:at], *w, *words[at:]])

    rows = [(i, [say(one, "day") + "."], None) for i in range(400)] + [(1000 + i, [say(two) + "."], None) for i in range(400)]
    rows += [(2000 + i, [say(two, "clay") + "."], None) for i in range(9)] + [(3000 + i, [say(one, "clay") + "."], None) for i in range(9)]
    return spark.createDataFrame(rows, "pdf_id bigint, content array<string>, title string")


def test_vectors_decide_on_misread_words(spark, monkeypatch):
    df = _topics(spark, random.Random(17))
    found = lambda: {r["id"] for r in scans.scan_noise(df).filter("kind = 'ocr'").collect()}
    misread, own = set(range(3000, 3009)), set(range(2000, 2009))
    got = found()
    assert len(got & misread) >= 8 and len(got & own) <= 1 and got <= misread | own
    learned = scans._vectors

    def shuffled(*args):
        names, rows = zip(*sorted(learned(*args).items()))
        rows = list(rows)
        random.Random(5).shuffle(rows)
        return dict(zip(names, rows))

    monkeypatch.setattr(scans, "_vectors", shuffled)
    worse = found()
    assert len(worse & misread) - len(worse & own) < len(got & misread) - len(got & own)


def test_templates_need_no_share_of_all_documents(spark):
    """A running footer of six documents is one however many others there are."""
    rng = random.Random(18)
    body = lambda: "\n".join(prose(rng, 9)[:-1] for _ in range(8))
    rows = [(i, [f"{body()}\nHouse Notes for {'Qu' + 'aeiouy'[i] + 'lthor'}"], None) for i in range(6)]
    rows += [(100 + i, [body()], None) for i in range(600)]
    df = spark.createDataFrame(rows, "pdf_id bigint, content array<string>, title string")
    got = {(r["id"], r["line_no"]) for r in scans.scan_noise(df).filter("kind = 'furniture'").collect()}
    assert got == {(i, 9) for i in range(6)}


def test_lists_hang_on_headings_of_any_words(spark):
    """The heading of a list of other pages is known by what it does, not by its words."""
    rng = random.Random(23)
    rows = []
    for i in range(16):
        site = ["donmo", "klaxo"][i % 2]
        others = "\n".join(f"- {prose(rng, 4)[:-1]}" for _ in range(3))
        text = f"# {prose(rng, 5)[:-1]}\n\nThe {prose(rng, 40)[:-1]} of the day.\n\n## Zubrik vorma\n{others}\n\nQuendo alar pistu"
        rows.append((i, f"https://{site}.example/p{i}", text))
    got = {tuple(r) for r in furniture.furniture(entries(spark, rows)).collect()}
    assert got == {(i, n) for i in range(16) for n in (5, 6, 7, 8, 10)}


def test_long_lines_are_masked_as_short_ones(spark):
    rng = random.Random(24)
    rows = []
    for i in range(44):
        site = ["donmo", "klaxo", "virem", "plasto"][i % 4]
        text = f"# {prose(rng, 5)[:-1]}\n\nThe {prose(rng, 40)[:-1]} of the day.\n\n© {2001 + i} {site.capitalize()}: " + "whoever copies these pages in whole or in part without having asked for it in writing does so at a risk of their own. " * 3
        rows.append((i, f"https://{site}.example/p{i}", text))
    assert {tuple(r) for r in furniture.furniture(entries(spark, rows)).collect()} == {(i, 5) for i in range(44)}


def test_no_glyph_edit_changes_the_shape():
    for w in ["market", "modern", "cloud", "clay", "queue", "running", "d0wn", "w1ndow", "back", "o'clock", "fjord", "knnight", "vview", "élan", "lc", "ri"]:
        assert all(scans.strokes(f) == scans.strokes(w) for f in scans._edits(w)), w


# --- problem 5


def test_a_far_boundary_goes_before_a_forced_cut():
    text = "x" * 5700 + " " + "y" * 3299
    assert splitting.cuts(text) == [5701]
    assert splitting.cuts("z" * 9000) == [4600]


# --- problem 7


def test_certificates_hold(spark):
    rng = random.Random(33)
    rows = [(i, "x" * rng.choice([rng.randrange(1, 4000), 2049, 1400, 4096, 9000])) for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = packing.certificate(df, group_items=100).collect()
    whole = [r for r in got if r["round"] is None]
    parts = [r for r in got if r["round"] is not None]
    bins = packing.pack(df, group_items=100).select("container").distinct().count()
    assert len(whole) == 1 and whole[0]["bins"] == bins and whole[0]["items"] == packing.pack(df, group_items=100).count()
    assert all(r["bound"] <= r["bins"] and r["gap"] == r["bins"] - r["bound"] for r in got)
    assert len([r for r in parts if r["round"] == 0]) == 5 and -(-sum(len(t) for _, t in rows) // 4096) <= whole[0]["bound"]
    assert packing.certificate(df.limit(0)).count() == 0


# --- problem 8


def test_routes_add_up_and_often_repeated_texts_are_spread(spark):
    docs = [(i, "the same text over and over", "a") for i in range(300)] + [(1000 + i, "the same text over and over", "b") for i in range(3)] + [(2000 + i, f"text number {i}", "b") for i in range(200)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, source string")
    t = spark.createDataFrame([("a", 0.5, 4), ("b", 0.2, 5)], "source string, target_share double, max_repeats int")
    rep = {r["source"]: r for r in mixing.report(d, t).collect()}
    routes = mixing.routes(d, t).collect()
    for s, r in rep.items():
        own = [x for x in routes if x["source"] == s]
        assert sum(x["used"] for x in own) == r["used"] and sum(x["tokens"] for x in own) == r["tokens"]
        assert all(0 <= x["used"] <= r["max_repeats"] * x["tokens"] for x in own)
    # b's own texts are used before the one that a needs too
    assert [x["used"] for x in routes if x["source"] == "b" and x["members"] == ["a", "b"]] == [0]


# --- problem 9


def test_languages_of_others_and_of_none(spark):
    from test_text_operators import SAMPLES

    samples = spark.createDataFrame([(l, t) for l, t in SAMPLES.items() for _ in range(3)], "lang string, text string")
    finnish = "Kylän väki kokoontui illalla torille kuuntelemaan pitkää puhetta kalastuksesta, metsistä sekä tulevan talven varastoista."
    rows = [(1, finnish, "en", "https://a.example/"), (2, SAMPLES["de"], None, ""), (3, SAMPLES["de"], None, None), (4, SAMPLES["fr"], "fr", "https://a.example/")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, url string")
    told = {r["id"]: r for r in language.identify(df, samples).collect()}
    assert told[1]["lang"] == "und" and told[2]["lang"] == told[3]["lang"] == "de" and told[2]["confidence"] == told[3]["confidence"]
    assert sorted(map(tuple, language.mislabelled(df, samples).collect())) == [(2, 1, "de"), (3, 1, "de")]


def test_weak_sentences_make_a_stretch_together():
    import numpy as np

    scores = np.array([[6.0, 0.0], [5.0, 0.0], [0.0, 2.4], [0.0, 2.4]])
    assert language.runs(scores) == [(0, 2), (1, 4)]
    assert language.runs(scores[:3]) == [(0, 3)]
    rng = np.random.default_rng(3)
    for _ in range(200):  # against all paths
        s = rng.normal(0, 2, (6, 2))
        paths = [[(x >> i) & 1 for i in range(6)] for x in range(64)]
        worth = lambda p: sum(s[i, j] for i, j in enumerate(p)) - language.SWITCH * sum(a != b for a, b in zip(p, p[1:]))
        got, at = [], 0
        for j, end in language.runs(s):
            got += [j] * (end - at)
            at = end
        assert worth(got) == pytest.approx(max(map(worth, paths)))

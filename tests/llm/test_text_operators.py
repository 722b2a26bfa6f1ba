import json
import random
import re

import pytest

from weft.llm import furniture, language, mixing, neardup, packing, repeated, residue, scans, splitting

WORDS = "river stone market garden letter window signal copper morning harbour lantern meadow thunder velvet orchard compass barrel saddle mirror feather".split()


def prose(rng, n=30):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(3)).replace("0", "").replace("1", "s").replace("2", "ed") for _ in range(n)).capitalize() + "."


def entries(spark, rows):
    return spark.createDataFrame([(i, u, json.dumps(t.split("\x00")) if t is not None else None, "clash", 1) for i, u, t in rows], "entry_id bigint, url string, content string, id string, piece int")


# --- problem 1


def brute_repeated(rows, least=5, letters=12):
    site = lambda u: re.sub(r":\d+$", "", re.sub(r"^www\.", "", re.sub(r"^[a-z]+://", "", (u or "").lower()).split("/")[0]))
    seen, at = {}, {}
    for i, u, t in rows:
        for n, line in enumerate((t or "").split("\n"), 1):
            key = "".join(c for c in line.lower() if c.isalpha())
            if len(key) >= letters:
                seen.setdefault((site(u), key), set()).add(i)
                at[(i, n)] = (site(u), key)
    return {k for k, v in at.items() if len(seen[v]) >= least}


def test_repeated_lines_equal_brute_force(spark):
    rng = random.Random(1)
    common = ["Share this page with all your friends!", "© 2024 All rights reserved", "Short", "Überall ähnliche Zeilen, Größe 12", prose(rng, 80)]
    rows = []
    for i in range(40):
        lines = [prose(rng, rng.randrange(3, 60)) for _ in range(4)] + rng.sample(common, 3) + ["", "ab"]
        rng.shuffle(lines)
        rows.append((i, ["https://www.A.example:80/x", "http://a.example/y", "https://b.example/"][i % 3], "\n".join(lines)))
    rows += [rows[0], rows[0], (100, None, None), (101, "", ""), (102, "https://a.example/", "long " * 30000)]
    got = {tuple(r) for r in repeated.repeated_lines(entries(spark, rows)).collect()}
    assert got == brute_repeated([r for r in rows])
    assert repeated.repeated_lines(entries(spark, [])).count() == 0


def test_repeats_are_cut(spark):
    rows = [(i, "https://a.example/", f"only here number {WORDS[i]} {WORDS[i + 1]}\nThe very same notice everywhere") for i in range(6)]
    out = repeated.without_repeats(entries(spark, rows)).collect()
    assert len(out) == 6 and all("notice" not in r["text"] and "only here" in r["text"] for r in out)


def test_repeats_without_line_breaks_are_cut(spark):
    rng = random.Random(31)
    notice = "All views on this page are those of their authors alone, and nobody else may be held to them in any way or form."
    own = [(prose(rng, 60), prose(rng, 60)) for _ in range(12)]
    rows = [(i, "https://a.example/", f"{a} {notice} {b}" if i < 9 else f"{a} {b}") for i, (a, b) in enumerate(own)]
    rows += [(100 + i, f"https://host{i}.example/", f"{a} {notice} {b}") for i, (a, b) in enumerate(own[:6])]  # once on each site
    rows += [rows[0], (900, "https://a.example/", None), (901, None, ""), (902, "https://a.example/", "ab")]
    got = {r["id"]: r["text"] for r in repeated.without_repeats(entries(spark, rows)).collect()}
    for i, (a, b) in enumerate(own):
        assert got[i].replace("  ", " ") == f"{a} {b}"
    assert all(notice in got[100 + i] for i in range(6)) and got[900] is None and got[901] == "" and got[902] == "ab"
    assert repeated.without_repeats(entries(spark, [])).count() == 0


def test_chunks_do_not_depend_on_what_stands_before():
    rng = random.Random(32)
    middle = prose(rng, 80)
    a = repeated.chunk_text([prose(rng, 30) + middle, "İx " + middle + prose(rng, 5)])
    one = set(a[4][a[0] == 0].tolist())
    two = set(a[4][a[0] == 1].tolist())
    assert len(one & two) >= 0.5 * len(two)
    texts = ["", "İx " + middle, "\n", "ab\ncd"]
    no, s, e, n, _ = repeated.chunk_text(texts)
    for i, t in enumerate(texts):
        assert "".join(c for k in range(len(no)) if no[k] == i for c in t[s[k] : e[k]] if c.isalpha()) == "".join(filter(str.isalpha, t))


# --- problem 5


@pytest.mark.parametrize("n", [6001, 11800, 11801, 25000])
def test_pieces_overlap_and_rebuild(n):
    rng = random.Random(n)
    text = ""
    while len(text) < n:
        text += prose(rng, rng.randrange(5, 40)) + rng.choice(["\n", "\n\n", " "])
    text = text[:n]
    at = splitting.cuts(text)
    assert len(at) >= -(-(n - 200) // 5800) - 1
    begins = [0, *[c - 200 for c in at]]
    pieces = [text[b:e] for b, e in zip(begins, [*at, n])]
    assert all(len(p) <= 6000 for p in pieces) and all(b[:200] == a[-200:] for a, b in zip(pieces, pieces[1:]))
    assert pieces[0] + "".join(p[200:] for p in pieces[1:]) == text
    assert all(text[c - 1].isspace() for c in at)


def test_oversized_kinds(spark):
    rows = [(1, "u", "a" * 6001), (2, "u", "word " * 1300), (3, "u", "short"), (4, "u", None), (5, "u", "x" * 3000 + "\n" + "y" * 3000), (5, "u", "x" * 3000 + "\n" + "y" * 3000)]
    got = sorted(map(tuple, splitting.oversized_found(entries(spark, rows)).collect()))
    assert got == [(1, "oversized"), (1, "unbroken"), (2, "oversized"), (5, "oversized")]
    assert splitting.oversized_found(entries(spark, [])).count() == 0


# --- problem 7


def test_packing_is_whole_and_tight(spark):
    rng = random.Random(3)
    rows = [(i, "x" * rng.choice([rng.randrange(1, 4000), 2048, 4096, 9000]), "c") for i in range(400)] + [(900, None, "c"), (901, "", "c"), (5, "ab", "c")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, tokens string")
    got = packing.pack(df, group_items=120).collect()
    assert sum(r["tokens"] for r in got) == sum(len(t or "") for _, t, _ in rows)
    fill = {}
    for r in got:
        fill[r["container"]] = fill.get(r["container"], 0) + r["tokens"]
    assert max(fill.values()) <= 4096 and all(fill[r["container"]] == r["fill"] for r in got)
    assert {r["id"] for r in got if r["n_pieces"] > 1} == {i for i, t, _ in rows if t and len(t) > 4096}
    assert sum(fill.values()) / (4096 * len(fill)) > 0.93
    assert packing.split_found(df.limit(0)).count() == 0


def test_lower_bound_holds():
    import numpy as np

    rng = np.random.default_rng(0)
    for _ in range(30):
        sizes = rng.integers(1, 101, rng.integers(1, 60))
        bins = packing.best_fit_decreasing(sizes, 100)
        load = np.bincount(bins, weights=sizes)
        assert load.max() <= 100 and packing.lower_bound(sizes, 100) <= len(load)
    assert packing.lower_bound(np.array([51] * 7), 100) == 7


# --- problem 8


def test_mix_meets_quotas_and_caps(spark):
    rng = random.Random(5)
    docs = [(i, prose(rng, 20), rng.choice(["A ", "a", "B", "c"]), "x") for i in range(300)] + [(900, None, "b", "x"), (901, "t", None, "x")]
    docs += [(1000 + i, docs[i][1], "b", "x") for i in range(30)]  # texts that two sources hold
    d = spark.createDataFrame(docs, "doc_id bigint, text string, source string, used string")
    t = spark.createDataFrame([("A", 0.5, 2), ("b", 0.3, 1), ("c", 0.1, 3), ("none", 0.1, 2)], "source string, target_share double, max_repeats int")
    rep = {r["source"]: r for r in mixing.report(d, t).collect()}
    total = sum(len((x[1] or "").encode()) for x in docs)
    for s, r in rep.items():
        own = sum(len((x[1] or "").encode()) for x in docs if x[2] and x[2].strip().lower() == s.lower())
        assert r["tokens"] == own and r["used"] == min(r["quota"], r["max_repeats"] * own)
        assert r["short"] == (r["max_repeats"] * own < r["target_share"] * total)
    used = mixing.mix(d, t).collect()
    longest = max(r["tokens"] for r in used)
    for s, r in rep.items():
        n = sum(x["tokens"] * x["copies"] for x in used if x["source"] == s.lower())
        assert r["used"] - 4 * longest <= n <= r["used"]
        assert all(x["copies"] <= r["max_repeats"] for x in used if x["source"] == s.lower())
    assert mixing.short_sources(d.limit(0), t).count() == 0 and mixing.report(d, t.limit(0)).count() == 0
    assert mixing.mix(d.limit(0), t).count() == 0


# --- problem 4


@pytest.mark.parametrize(
    "text,reason",
    [
        ("Page not found\nSorry, we looked everywhere but this address leads nowhere.", "notice"),
        ("# 403 Forbidden\nYou don't have permission to open this resource on this server.", "notice"),
        ("Hello {{ first_name }},\n" + "The long road follows a quiet river to the old town and its market. " * 6, "placeholder"),
        ("The page says `{{ first_name }}` here.\n" + "The long road follows a quiet river to the old town and its market. " * 6, None),
        ("```\n<h1>{{ title }}</h1>\n```\n" + "The long road follows a quiet river to the old town and its market. " * 6, None),
        ("When it answers with 404 the page not found notice is shown.\n" + "The long road follows a quiet river to the old town and its market. " * 6, None),
        ("# A title\n" + "Lorem ipsum dolor amet caldo verinus tellus sittum molite vadit. " * 9, "filler"),
        # spoken of, in sentences of a tutorial
        ("The long road follows a quiet river to the old town and its market. " * 60 + "\nIn a template you write {{ name }} and the engine puts the value there.", None),
        ("The long road follows a quiet river to the old town and its market. " * 60 + "\nWhoever reads “[object Object]” knows at once that nobody looked at the page.", None),
        # dense hits are no tutorial
        ("In a template you write {{ name }}. You write {{ street }} too, in a template. In a template you write {{ town }}.", "placeholder"),
        # beside words of templates, but left unfilled
        ("The long road follows a quiet river to the old town and its template. " * 6 + "\nDear {{ name }}, the token of the market is here.", "placeholder"),
        # sentences that stand in no list
        ("# Ojdå 404\nHär fanns ingenting att hämta.", "notice"),
        ("# Pahoittelut\nTapaus 99-A7712345", "notice"),
        ("Valon nopeus kertoo paljon maailmasta jossa elämme, mutta harva huomaa kuinka hitaasti vanha virta kulkee rannalta toiselle kesäisin. " "Kylän väki kokoontui illalla torille kuuntelemaan pitkää puhetta kalastuksesta, metsistä sekä tulevan talven varastoista.", None),
        ("", None),
        (None, None),
    ],
)
def test_residue(text, reason):
    assert residue.judge(text) == reason


def test_status_counts_only_beside_texts_without_prose():
    assert residue.judge("# Pahoittelut\nJotain meni pieleen", 503) == "notice"
    assert residue.judge("# Pahoittelut\nJotain meni pieleen", 200) is None
    assert residue.judge("The long road follows a quiet river to the old town and its market. " * 6, 503) is None
    assert residue.judge("| a | b |\n|---|---|\n| 1 | 2 |", 404) is None


def test_residue_rows(spark):
    rows = [(1, "u", "Too many requests"), (1, "u", "Too many requests"), (2, "u", None), (3, "u", "A " * 50000)]
    assert {r["id"] for r in residue.residue(entries(spark, rows)).collect()} == {1}
    assert residue.residue(entries(spark, [])).count() == 0


# --- problem 6


def test_site_furniture(spark):
    rng = random.Random(9)
    rows = []
    for i in range(30):
        site = ["donmo", "klaxo", "virem"][i % 3]
        text = f"Home | About us | Contact\n\n# {prose(rng, 5)[:-1]}\n\nThe {prose(rng, 40)[:-1]} of the day.\n\nIt is a {prose(rng, 40)[:-1]} in the end.\n\nFollow {site.capitalize()} on your favourite network\n© {2020 + i % 4} {site.capitalize()}. All rights reserved."
        rows.append((i, f"https://{site}.example/p{i}", text))
    rows += [rows[0], (900, None, None), (901, "", "Page not found")]
    got = {tuple(r) for r in furniture.furniture(entries(spark, rows)).collect()}
    assert got == {(i, n) for i in range(30) for n in (1, 9, 10)}
    assert furniture.furniture(entries(spark, [])).count() == 0


# --- problem 3


def runs_of(text, n=3):
    w = re.findall(r"[^\W_]+", text.lower())
    return frozenset(zip(*(w[i:] for i in range(n))))


def near_fixture():
    rng = random.Random(11)
    rows = []
    for base in range(25):
        words = prose(rng, 60).split()
        for copy in range(rng.randrange(1, 5)):
            w = list(words)
            for _ in range(rng.randrange(0, 6)):
                w[rng.randrange(len(w))] = rng.choice(WORDS) + "x"
            rows.append((base * 10 + copy, " ".join(w)))
    return rows


@pytest.mark.parametrize("limit", [4096, 3])
def test_near_duplicates_equal_brute_force(spark, limit):
    rows = near_fixture()
    true = {(a, b) for a, s in rows for b, t in rows if a < b and len(runs_of(s) & runs_of(t)) >= 0.6 * len(runs_of(s) | runs_of(t))}
    df = spark.createDataFrame([(i, t, "k", 1) for i, t in [*rows, rows[0], (900, None), (901, ""), (902, "two words")]], "hit_id bigint, snippet string, node string, doc int")
    members, links = neardup.similar([(df, "hit_id", "snippet", "hits", 12, False)], node_limit=limit)
    got = {(r["id_a"], r["id_b"]) for r in neardup.all_pairs(members, links).collect()}
    assert not got - true and len(true & got) >= 0.99 * len(true)
    classes = {r["id"]: r["class_id"] for r in neardup.classes(members, links).collect()}
    assert all(classes[a] == classes[b] for a, b in got) and len(classes) == len(rows)
    empty = neardup.similar([(df.limit(0), "hit_id", "snippet", "hits", 12, False)])
    assert neardup.all_pairs(*empty).count() == 0


@pytest.mark.parametrize("n,m", [(500, None), (1, None), (17, None), (300, 90), (3, 200)])
def test_gray_index_finds_what_all_pairs_find(n, m):
    import numpy as np

    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, (40, 3), dtype=np.int64).view(np.uint64)

    def near(n):
        rows = base[rng.integers(0, 40, n)].copy()
        for r in rows:
            for _ in range(rng.integers(0, 40)):
                r[rng.integers(0, 3)] ^= np.uint64(1) << np.uint64(rng.integers(0, 64))
        return rows[np.lexsort(neardup.gray_rank(rows).T[::-1])]

    rows, other = near(n), None if m is None else near(m)
    i, j = neardup.node_pairs(rows, 50, other)
    d = np.bitwise_count(rows[:, None] ^ (rows if other is None else other)[None]).sum(2)
    true = d <= 50
    assert sorted(zip(i.tolist(), j.tolist())) == sorted(zip(*np.nonzero(np.triu(true, 1) if other is None else true)))
    assert (neardup.gray_code(neardup.gray_rank(rows)) == rows).all()


def test_large_nodes_are_split(spark):
    """Texts that share a stock sentence meet in large nodes though few of them are near each other."""
    rng = random.Random(12)
    stock = " ".join(f"stock{i}" for i in range(14))
    rows = []
    for i in range(300):
        own = [f"own{i}x{k}" for k in range(14)]
        rows.append((i, stock + " " + " ".join(own)))
        if i % 10 == 0:
            rows.append((1000 + i, stock + " " + " ".join([*own[:-2], "other", "end"])))
    df = spark.createDataFrame(rows, "hit_id bigint, snippet string")
    members, links = neardup.similar([(df, "hit_id", "snippet", "hits", 12, False)], node_limit=20)
    got = {(r["id_a"], r["id_b"]) for r in neardup.all_pairs(members, links).collect()}
    assert got == {(i, 1000 + i) for i in range(0, 300, 10)}


# --- problem 9

SAMPLES = {
    "en": "The old house is near the river and the garden is full of flowers. We are going to the market because it is warm today.",
    "de": "Das alte Haus steht am Fluss und der Garten ist voller Blumen. Wir gehen heute auf den Markt, weil es warm ist.",
    "fr": "La vieille maison est près de la rivière et le jardin est plein de fleurs. Nous allons au marché parce qu'il fait chaud.",
}


def test_languages(spark):
    samples = spark.createDataFrame([(l, t) for l, t in SAMPLES.items() for _ in range(3)], "lang string, text string")
    rows = [
        (1, SAMPLES["en"], " EN-gb", "https://a.example/"),
        (2, SAMPLES["de"], "en", "https://a.example/"),
        (3, SAMPLES["fr"], None, None),
        (4, SAMPLES["en"] + " " + SAMPLES["de"], "en", "https://b.example/"),
        (5, None, "en", "x"),
        (6, "", "en", "x"),
        (7, SAMPLES["fr"], "French", "x"),
    ]
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id bigint, text string, lang string, url string, scores string")
    got = sorted(map(tuple, language.mislabelled(df, samples).collect()))
    assert got == [(2, 1, "de"), (3, 1, "fr"), (4, 1, "en"), (4, 2, "de")]
    assert language.mislabelled(df.limit(0), samples).count() == 0 and language.mislabelled(df, samples.limit(0)).count() == 0


# --- problem 2


def test_scans(spark):
    rng = random.Random(4)
    vocabulary = WORDS + ["something", "between", "machines", "corner", "number"]
    def page(n, broken, misread):
        w = [rng.choice(vocabulary) for _ in range(60)]
        lines = [" ".join(w[i : i + 8]) for i in range(0, 56, 8)]
        if broken:
            lines[2] += " some-"
            lines[3] = "thing " + lines[3]
        if misread:
            lines[5] = "rnirror " + lines[5]
        return "\n".join(["Quarterly Notes of Stone", "", *lines, "", f"[{n}]"])

    rows = [(i, [page(k + 1, k == 0, k == 1 and i < 5) for k in range(3)], None, "c") for i in range(30)]
    df = spark.createDataFrame([*rows, rows[0], (900, None, None, "c"), (901, [None, ""], None, "c")], "pdf_id bigint, content array<string>, title string, word string")
    got = {tuple(r) for r in scans.scan_noise(df).collect()}
    for i in range(30):
        assert {(i, p, n, "furniture") for p in (1, 2, 3) for n in (1, 11)} <= got
        assert (i, 1, 5, "hyphen") in got and ((i, 2, 8, "ocr") in got) == (i < 5)
    assert len(got) == 30 * 7 + 5
    text = " ".join(r["text"] for r in scans.paragraphs(df).collect())
    assert "something" in text and "rnirror" not in text and "Quarterly" not in text
    assert scans.scan_noise(df.limit(0)).count() == 0

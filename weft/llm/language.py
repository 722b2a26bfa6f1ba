"""Problem 9: a language and a confidence for every document and every segment.

Bayesian evidence fusion: the likelihood of the text (words, and letter trigrams of
unknown ones, fitted on labelled samples) is combined with the declared label, the
address suffix and a host prior. Label reliability, suffix and host counts come from
grouped aggregations over all documents; a host's prior is smoothed by its suffix's,
and that by the one of all documents.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import map_arrow, pick, steps
from weft.plans.staging import stage
from weft.sources.tables import site_of

#: Labelled rows that the model is fitted on at most, per language.
SAMPLES_PER_LANGUAGE = 2000
#: Log odds that a change of language between two sentences costs.
SWITCH = 4.0
#: Strength of the smoothing from suffix to host and from all documents to suffix, in documents.
HOST_WEIGHT, SUFFIX_WEIGHT = 5.0, 20.0
#: Words from which it can be told that a text is in no sampled language, and the share of known words below which it is.
UNKNOWN_WORDS, UNKNOWN_SHARE, UNKNOWN = 12, 0.12, "und"
#: A text's likelihood is tempered, since its words aren't independent.
TEMPER = 0.5

# Names that a label may have for a language, besides its two-letter code.
NAMES = {
    "en": "eng english anglais englisch inglés",
    "de": "deu ger german deutsch allemand alemán",
    "fr": "fra fre french français francais französisch francés",
    "es": "spa spanish español espanol castilian castellano spanisch espagnol",
    "it": "ita italian italiano italienisch italien",
    "pt": "por portuguese português portugues portugiesisch",
    "nl": "nld dut dutch nederlands niederländisch flemish",
    "sv": "swe swedish svenska schwedisch",
    "pl": "pol polish polski polnisch",
    "ru": "rus russian русский russisch",
    "da": "dan danish dansk", "no": "nor nob nno norwegian norsk", "fi": "fin finnish suomi", "cs": "ces cze czech čeština",
    "uk": "ukr ukrainian українська", "ro": "ron rum romanian română", "hu": "hun hungarian magyar", "tr": "tur turkish türkçe",
    "el": "ell gre greek", "ca": "cat catalan català", "ja": "jpn japanese", "zh": "zho chi chinese", "ko": "kor korean", "ar": "ara arabic",
}
_BY_NAME = {n: code for code, names in NAMES.items() for n in (code, *names.split())}
_WORD = re.compile(r"[^\W\d_]+")
#: Addresses and code have no language.
_NOISE = re.compile(r"(?:\b[a-z][a-z0-9+.\-]*://|\bwww\.)\S+|\S+@\S+\.\w+|`[^`\n]*`")
_SENTENCE = re.compile(r"(?<=[.!?…])[\"')\]»”]*\s+|\n+")


def label_language(label):
    """Column: the two-letter code that a label names, null where it names none; case, blanks and region don't matter."""
    bare = F.regexp_extract(F.lower(F.trim(label)), r"^\s*(\p{L}+)", 1)
    return F.element_at(F.create_map(*[F.lit(x) for pair in _BY_NAME.items() for x in pair]), bare)


class Model:
    """Log likelihoods of words by language; made small enough to travel with a task."""

    def __init__(self, samples: list[tuple[str, str]]) -> None:
        self.langs = sorted({l for l, _ in samples})
        words: dict[str, Counter] = {l: Counter() for l in self.langs}
        grams: dict[str, Counter] = {l: Counter() for l in self.langs}
        for l, t in samples:
            for s in _SENTENCE.split(t):
                for i, w in enumerate(_WORD.findall(s)):
                    if i and w[0].isupper() and l != "de":
                        continue  # names say nothing about a language
                    words[l][w.lower()] += 1
        for l in self.langs:
            if l == "de":  # nouns are capitalised as names are; names don't come back
                words[l] = Counter({w: n for w, n in words[l].items() if n > 1})
            for w, n in words[l].items():
                for g in trigrams(w):
                    grams[l][g] += n
        self.ids = {w: i + 1 for i, w in enumerate(sorted({w for c in words.values() for w in c}))}
        k = len(self.langs)
        self.rows = np.zeros((len(self.ids) + 1, k), np.float32)
        for j, l in enumerate(self.langs):
            total, kinds = sum(words[l].values()), len(self.ids)
            for w, i in self.ids.items():
                self.rows[i, j] = math.log((words[l][w] + 0.1) / (total + 0.1 * kinds))
        self.rows[1:] -= self.rows[1:].mean(1, keepdims=True)
        kinds = len({g for c in grams.values() for g in c}) or 1
        self.grams: dict[str, np.ndarray] = {}
        for g in {g for c in grams.values() for g in c}:
            row = np.array([math.log((grams[l][g] + 0.5) / (sum(grams[l].values()) + 0.5 * kinds)) for l in self.langs], np.float32)
            self.grams[g] = (row - row.mean()) * 0.3
        # letters that only some languages use speak for them in unknown words, names too
        letters = {l: set("".join(words[l])) for l in self.langs}
        self.rare = {c: np.array([0.0 if c in letters[l] else -3.0 for l in self.langs], np.float32) for c in set().union(*letters.values()) if ord(c) > 127}

    def unknown(self, word: str) -> np.ndarray | None:
        """Evidence of a word that the samples lack: by its trigrams, of a name only by its letters; None for none."""
        out = None
        for c in word.lower():
            if ord(c) > 127 and c in self.rare:
                out = self.rare[c] if out is None else out + self.rare[c]
        if not word[0].isupper():
            for g in trigrams(word.lower()):
                if g in self.grams:
                    out = self.grams[g] if out is None else out + self.grams[g]
        return out


def trigrams(word: str) -> list[str]:
    w = f"^{word}$"
    return [w[i : i + 3] for i in range(len(w) - 2)]


def fit(samples: DataFrame, lang_col: str = "lang", text_col: str = "text", per_language: int = SAMPLES_PER_LANGUAGE) -> Model:
    """A model of labelled rows, at most ``per_language`` of each language; rows without label or text are left out."""
    from pyspark.sql import Window

    rows = pick(samples, lang=lang_col, text=text_col).select(label_language(F.col("lang")).alias("lang"), "text").filter("lang is not null and text is not null")
    bounded = rows.withColumn("_n", F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("text"), "text"))).filter(F.col("_n") <= per_language)
    return Model([(r["lang"], r["text"]) for r in bounded.select("lang", "text").collect()])


class _Words:
    """Word ids of a worker: the model's, and those of unknown words met so far (forgotten when they are many)."""

    def __init__(self, model: Model) -> None:
        self.model, self.rows, self.ids = model, list(model.rows), dict(model.ids)

    def of(self, words: list[str]) -> list[int]:
        get, out = self.ids.get, []
        for w in words:
            i = get(w)
            if i is None:
                i = get(w.lower())
                if i is None:
                    row = self.model.unknown(w)
                    i = 0
                    if row is not None:
                        i = len(self.rows)
                        self.rows.append(row)
                if len(w) < 24 and len(self.ids) < 300_000:
                    self.ids[w] = i
            out.append(i)
        return out

    def forget(self) -> None:
        if len(self.rows) > 200_000:
            self.rows, self.ids = list(self.model.rows), dict(self.model.ids)


def runs(scores: np.ndarray, switch: float = SWITCH) -> list[tuple[int, int]]:
    """(language, last sentence + 1) of each stretch of sentences: the best path with a price on changes."""
    n, k = scores.shape
    whole = int(scores.sum(0).argmax())
    # no other path can win where all that any language gains on the main one doesn't make up for a change
    if n == 1 or np.maximum(scores - scores[:, whole : whole + 1], 0).sum(0).max() <= switch:
        return [(whole, n)]
    cost = scores[0].copy()
    back = np.zeros((n, k), np.int64)
    stay = np.arange(k)
    for i in range(1, n):
        m = int(cost.argmax())
        change = cost[m] - switch
        back[i] = np.where(cost >= change, stay, m)
        cost = np.maximum(cost, change) + scores[i]
    path = [int(cost.argmax())]
    for i in range(n - 1, 0, -1):
        path.append(int(back[i][path[-1]]))
    path.reverse()
    return [(path[i], i + 1) for i in range(n) if i + 1 == n or path[i + 1] != path[i]]


def evidence(df: DataFrame, model: Model, id_col: str, text_col: str, label_col: str, url_col: str) -> DataFrame:
    """(id, declared, host, suffix, lang, scores, foreign): a row per text with letters; lang and scores of its stretches in order.

    ``scores`` holds, stretch by stretch, the log likelihood of each language; ``foreign``
    tells whether hardly any of the text's words occur in the samples.
    """
    kind = df.schema[id_col].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        words, k = _Words(m), len(m.langs)
        for b in batches:
            texts = b.column(4).to_pylist()
            for s, e in steps([len(t) for t in texts], 4_000_000):
                ids: list[int] = []
                ends: list[int] = []
                of_text: list[int] = []
                for t in texts[s:e]:
                    if "://" in t or "www." in t or "@" in t or "`" in t:
                        t = _NOISE.sub(" ", t)
                    for sentence in _SENTENCE.split(t):
                        got = words.of(_WORD.findall(sentence))
                        if got:
                            ids += got
                            ends.append(len(ids))
                    of_text.append(len(ends))
                table = np.asarray(words.rows, np.float32)
                if ends:
                    score = np.add.reduceat(table[np.array(ids)], np.array([0, *ends[:-1]], np.int64), axis=0)
                begin = 0
                rows, langs, flat, foreign = [], [], [], []
                known = np.r_[0, np.cumsum((np.array(ids, np.int64) > 0) & (np.array(ids, np.int64) <= len(m.ids)))]
                for i, end in enumerate(of_text):
                    if end > begin:
                        first, last = (ends[begin - 1] if begin else 0), ends[end - 1]
                        foreign.append(bool(last - first >= UNKNOWN_WORDS and known[last] - known[first] < UNKNOWN_SHARE * (last - first)))
                        found, at, parts = runs(score[begin:end]), begin, []
                        for _, stop in found:
                            parts.append(score[at : begin + stop].sum(0))
                            at = begin + stop
                        rows.append(s + i)
                        langs.append([x for x, _ in found])
                        flat.append(np.concatenate(parts).tolist())
                    begin = end
                x = b.take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [*(x.column(c) for c in range(4)), pa.array(langs, pa.list_(pa.int32())), pa.array(flat, pa.list_(pa.float32())), pa.array(foreign, pa.bool_())],
                    names=["id", "declared", "host", "suffix", "lang", "scores", "foreign"],
                )
                words.forget()

    host = site_of("url")
    narrow = (
        pick(df, id=id_col, label=label_col, url=url_col, text=text_col)
        .filter("text is not null")
        .select("id", F.coalesce(label_language(F.col("label")), F.lit("")).alias("declared"), host.alias("host"), F.regexp_extract(host, r"\.([a-z]+)$", 1).alias("suffix"), "text")
    )
    return map_arrow(narrow, run, f"id {kind}, declared string, host string, suffix string, lang array<int>, scores array<float>, foreign boolean")


def identify(
    df: DataFrame, samples: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", url_col: str = "url"
) -> DataFrame:
    """(id, declared, seg_no, lang, confidence, doc_lang, doc_confidence, n_segments): a row per segment of every text with letters.

    ``declared`` is the language that the label names, '' for none; ``doc_lang`` is the
    document's main language. A text in none of the sampled languages is one segment in
    'und', its confidence the share of evidence that is missing. Null texts and texts without
    any word give no row, as nothing is known about them; repeated rows are judged once each.
    """
    model = fit(samples)
    langs = model.langs
    kind = df.schema[id_col].dataType.simpleString()
    if not langs:  # nothing is known about any language
        return df.sparkSession.createDataFrame([], f"id {kind}, declared string, seg_no int, lang string, confidence double, doc_lang string, doc_confidence double, n_segments int")
    found = stage(evidence(df, model, id_col, text_col, label_col, url_col), "evidence")
    single = found.filter((F.size("lang") == 1) & ~F.col("foreign")).select("declared", "host", "suffix", F.element_at("lang", 1).alias("l"))
    counts = [F.sum((F.col("l") == j).cast("int")).cast("double") for j in range(len(langs))]
    vector = F.array(*counts)
    # bounded tables: one row per declared code, and one for all documents
    by_label = {r["declared"]: r["v"] for r in single.groupBy("declared").agg(vector.alias("v")).collect()}
    total = np.sum([v for v in by_label.values()], axis=0) if by_label else np.ones(len(langs))
    base = (total + 1) / (total + 1).sum()
    labels = [*langs, ""]
    odds = {d: [math.log((by_label.get(d, [0] * len(langs))[j] + (2.0 if d == l else 0.2)) / (total[j] + 4.0)) for j, l in enumerate(langs)] for d in labels}
    by_suffix = single.groupBy("suffix").agg(vector.alias("sv"))
    by_host = single.filter("host != ''").groupBy("host").agg(vector.alias("hv"))
    priors = by_host.withColumn("suffix", F.regexp_extract("host", r"\.([a-z]+)$", 1)).join(by_suffix, "suffix", "left").select("host", "hv", "sv")
    none = F.lit(None).cast("array<double>")
    columns = ["id", "declared", "lang", "scores", "foreign", "hv", "sv"]
    # texts without a host have no prior of one, and don't meet in one task for it
    joined = found.filter("host != ''").join(priors, "host", "left").select(columns).unionByName(found.filter("host = ''").withColumns({"hv": none, "sv": none}).select(columns))
    k = len(langs)

    def without(votes, own) -> np.ndarray:
        """Votes of the others."""
        v = np.array(votes if votes else [0.0] * k)
        if votes and len(own) == 1:
            v[own[0]] -= 1.0
        return v

    def run(batches):
        for b in batches:
            ids, decl = b.column(0), b.column(1).to_pylist()
            rows, out = [], []
            for i, (d, own, scores, foreign, hv, sv) in enumerate(zip(decl, *(b.column(c).to_pylist() for c in range(2, 7)))):
                if foreign:
                    rows.append(i)
                    out.append((1, UNKNOWN, 1.0 - UNKNOWN_SHARE, UNKNOWN, 1.0 - UNKNOWN_SHARE, 1))
                    continue
                sv, hv = without(sv, own), without(hv, own)
                suffix = (sv + SUFFIX_WEIGHT * base) / (sv.sum() + SUFFIX_WEIGHT)
                host = (hv + HOST_WEIGHT * suffix) / (hv.sum() + HOST_WEIGHT)
                prior = np.log(host) + np.array(odds.get(d, odds[""]))
                text = np.array(scores).reshape(-1, k)
                merged: list[list] = []
                whole = _posterior(text.sum(0) * TEMPER + prior)
                for part in text:
                    # only a text in one language is bound to its label and host as a whole
                    p = whole if len(own) == 1 else _posterior(part * TEMPER + prior / len(own))
                    j = int(p.argmax())
                    if merged and merged[-1][0] == j:  # one segment, judged by all it holds
                        merged[-1][2] = merged[-1][2] + part
                        merged[-1][1] = float(_posterior(merged[-1][2] * TEMPER + prior / len(own))[j])
                    else:
                        merged.append([j, float(p[j]), part])
                main = int(whole.argmax()) if len(merged) > 1 else merged[0][0]
                for n, (j, p, _) in enumerate(merged, 1):
                    rows.append(i)
                    out.append((n, langs[j], p, langs[main], float(whole[main]), len(merged)))
            cols = list(zip(*out)) if out else [()] * 6
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [ids.take(take), b.column(1).take(take), pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.string()), pa.array(cols[4], pa.float64()), pa.array(cols[5], pa.int32())],
                names=["id", "declared", "seg_no", "lang", "confidence", "doc_lang", "doc_confidence", "n_segments"],
            )

    return map_arrow(joined, run, f"id {kind}, declared string, seg_no int, lang string, confidence double, doc_lang string, doc_confidence double, n_segments int")


def _posterior(logs: np.ndarray) -> np.ndarray:
    p = np.exp(logs - logs.max())
    return p / p.sum()


def mislabelled(df: DataFrame, samples: DataFrame, **columns: str) -> DataFrame:
    """(id, seg_no, lang) of the texts whose label is missing or wrong, or that are in several languages.

    Of a text in no sampled language nothing is said, whatever its label.
    """
    told = identify(df, samples, **columns).filter(F.col("lang") != UNKNOWN)
    return told.filter((F.col("n_segments") > 1) | (F.col("declared") != F.col("lang"))).select("id", "seg_no", "lang").distinct()

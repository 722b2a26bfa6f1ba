"""Classes and scores of hits and pages: source types, authority, intent, answer signals, relevance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from weft.functions.urls import in_domains, let, with_parts

# Domains by kind of source, in order of priority.
SOURCE_TYPES = [
    ("docs", ("docs.python.org", "docs.anthropic.com", "docs.openai.com", "platform.openai.com", "pytorch.org", "tensorflow.org", "developer.mozilla.org", "developers.google.com", "docs.github.com", "docs.microsoft.com", "learn.microsoft.com", "docs.rs", "go.dev", "doc.rust-lang.org", "kotlinlang.org", "dart.dev", "flutter.dev", "nodejs.org", "react.dev", "vuejs.org", "angular.io", "svelte.dev")),
    ("paper", ("arxiv.org", "dl.acm.org", "acm.org", "ieee.org", "ieeexplore.ieee.org", "openreview.net", "semanticscholar.org", "scholar.google.com", "paperswithcode.com", "papers.ssrn.com", "biorxiv.org", "medrxiv.org")),
    ("repo", ("github.com", "gitlab.com", "bitbucket.org", "codeberg.org", "sourceforge.net", "raw.githubusercontent.com")),
    ("forum", ("stackoverflow.com", "serverfault.com", "superuser.com", "askubuntu.com", "reddit.com", "news.ycombinator.com", "discourse.org", "discuss.python.org", "forum.vuejs.org", "groups.google.com", "community.openai.com")),
    ("reference", ("wikipedia.org", "wikimedia.org", "britannica.com", "en.wikipedia.org")),
    ("news", ("reuters.com", "bloomberg.com", "techcrunch.com", "theverge.com", "arstechnica.com", "wired.com", "cnet.com", "zdnet.com")),
    ("blog", ("medium.com", "substack.com", "dev.to", "hashnode.com", "blog.google", "towardsdatascience.com", "freecodecamp.org")),
]
TECH_DOMAINS = ("github.com", "arxiv.org", "stackoverflow.com", "docs.python.org", "huggingface.co", "paperswithcode.com", "pytorch.org", "tensorflow.org", "developer.mozilla.org", "kaggle.com", "pypi.org", "npmjs.com", "raw.githubusercontent.com", "dl.acm.org", "acm.org", "ieee.org", "openreview.net", "semanticscholar.org", "scholar.google.com", "docs.anthropic.com", "docs.openai.com", "platform.openai.com", "openai.com", "anthropic.com", "ai.meta.com", "research.google.com", "deepmind.google", "mistral.ai", "x.ai", "grok.com", "deepseek.com")
REFERENCE_DOMAINS = ("wikipedia.org", "wikimedia.org", "britannica.com")
CODE_HOSTS = ("github.com", "raw.githubusercontent.com", "gist.github.com")
QA_HOSTS = ("stackoverflow.com", "stackexchange.com", "serverfault.com", "superuser.com", "mathoverflow.com", "askubuntu.com")
NEWS_HOSTS = ("nytimes.com", "bbc.com", "bbc.co.uk", "reuters.com", "theguardian.com", "washingtonpost.com", "bloomberg.com", "apnews.com", "aljazeera.com", "cnbc.com", "ft.com", "economist.com", "techcrunch.com", "theverge.com", "arstechnica.com", "wired.com", "nature.com", "science.org")
# Words that mark technical queries, and queries for data.
TECH_SIGNALS = ("model", "architecture", "d_model", "embedding", "dimension", "api", "code", "implement", "benchmark", "paper", "arxiv", "github", "algorithm", "neural", "transformer", "layer", "parameter", "config", "specification", "spec", "schema", "table", "comparison", "matrix", "tensor", "precision", "throughput", "latency", "inference", "training", "fine-tun", "quantiz", "attention", "tokeniz", "vocab", "hidden", "encoder", "decoder", "dense")
DATA_WORDS = ("dimension", "size", "parameters", "count", "value", "spec", "specification", "d_model", "architecture", "layer", "config", "hidden", "precision", "vocab", "vocabulary", "encoder", "decoder", "context", "window", "throughput", "latency", "memory", "token", "batch", "sequence", "flops", "compute", "gpu", "head", "heads", "embedding", "optimizer")
# Intents in order of priority.
INTENTS = (
    ("comparison", r"\b(?:vs\.?|versus|compare|comparison|difference\s+between|pros\s+and\s+cons|which\s+is\s+better)\b"),
    ("howto", r"\b(?:how\s+to|how\s+do\s+i|guide|tutorial|step\s+by\s+step|walkthrough)\b"),
    ("research", r"\b(?:arxiv|research|benchmark|literature|state\s+of\s+the\s+art|case\s+study|white\s+paper)\b"),
    ("code", r"\b(?:implement|function|api|method|class|snippet|script|debug|error|exception|source\s+code|code\s+example)\b"),
    ("reference", r"\b(?:what\s+is|definition|explain|meaning|overview|introduction|understand)\b"),
    ("news", r"\b(?:latest|newest|recent|announcement|breaking|changelog|release\s+notes|new\s+release|just\s+released)\b"),
)
EXPANSIONS = {"research": ("paper", "arxiv", "benchmark", "results"), "factual": ("specifications", "table", "data", "parameters")}
# What a query asks for, and what a snippet shows then.
NUMBER_WORDS = ("dimension", "size", "parameters", "count", "number", "how many", "value", "d_model", "embedding", "layers", "heads")
COMPARE_WORDS = ("vs", "compare", "comparison", "difference", "better")
CODE_WORDS = ("code", "api", "function", "method", "implement", "example", "snippet")
TABLE_MARKS = ("table", "|", "column", "row", "\t")
COMPARE_MARKS = ("vs", "compared", "while", "however", "whereas", "better", "faster", "larger")
CODE_MARKS = ("def ", "func ", "class ", "import ", "const ", "```", "=> ", "fn ")
STOPWORDS = tuple(
    "the and for with from that this are was were has have had you your its our not but can will into via using use how what when why who which about also more most than then them they their there here such each other some any all one two new get got may might could should would does did done been being very just like".split()
)


def any_of(text: Column, marks) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(m) for m in marks])


def source_type(url: Column | str) -> Column:
    """Kind of source by domain, then by path words; 'other' without a host."""
    def kind(p) -> Column:
        def of(h: Column) -> Column:
            path = F.lower(p.path)
            out = F.when(~p.good, "other")
            for name, domains in SOURCE_TYPES:
                out = out.when(in_domains(h, domains), name)
            return (
                out.when(any_of(path, ("/docs/", "/documentation/", "/api/")), "docs")
                .when(any_of(path, ("/blog/", "/post/", "/article/")), "blog")
                .when(any_of(path, ("/forum/", "/thread/", "/discussion/")), "forum")
                .otherwise("other")
            )

        return let(F.regexp_replace(p.host, r"^www\.", ""), of)

    return with_parts(url, kind)


def source_authority(url: Column | str) -> dict[str, Column]:
    """{'source': kind of host, 'official': whether it is surely the subject's own}."""
    both = with_parts(url, _authority)
    return {"source": both["source"], "official": both["official"]}


def _authority(p) -> Column:
    h = p.host
    gov = h.endswith(".gov") | (h == "gov") | h.contains(".gov.")
    edu = h.endswith(".edu") | h.rlike(r"\.ac\.[a-z]{2}$")
    code = h.isin(*CODE_HOSTS) | h.endswith(".github.io")
    source = (
        F.when(~p.good, "unknown").when(gov, "gov").when(edu, "edu").when(code, "github")
        .when(h.startswith("docs.") | h.startswith("developer.") | h.startswith("developers."), "docs-site")
        .when(h.isin(*QA_HOSTS) | h.endswith(".stackexchange.com") | h.endswith(".stackoverflow.com"), "qa")
        .when(any_of(h, ("forum", "community", "discourse", "board")) | (h == "reddit.com") | h.endswith(".reddit.com"), "forum")
        .when(h.startswith("blog.") | h.isin("medium.com", "wordpress.com", "substack.com") | h.endswith(".substack.com") | h.endswith(".medium.com"), "blog")
        .when(h.startswith("shop.") | h.startswith("store.") | h.isin("amazon.com", "ebay.com") | h.endswith(".shop"), "ecommerce")
        .when(in_domains(h, NEWS_HOSTS), "news").otherwise("unknown")
    )
    return F.struct(source.alias("source"), (p.good & (gov | edu | code)).alias("official"))


def relevance(title: Column, text: Column, terms: list[str], k1: float = 1.2, b: float = 0.75, avgdl: float = 1000.0) -> Column:
    """Relevance of one document, its title counted three times; the weight of a term falls with its frequency."""
    t = F.coalesce(title, F.lit(""))
    words = F.regexp_extract_all(F.lower(F.concat_ws(" ", t, t, t, F.coalesce(text, F.lit("")))), F.lit("[a-z0-9]+"), F.lit(0))
    n = F.size(words)
    total = F.lit(0.0)
    for term in sorted(set(terms)):
        f = F.size(words) - F.size(F.array_remove(words, term))
        total = total + F.log(F.lit(2.0) / (f + 0.5) + 1.0) * f * (k1 + 1) / (f + k1 * (1 - b + b * n / avgdl))
    return total


def is_technical(query: Column) -> Column:
    return any_of(F.lower(query), TECH_SIGNALS)


def intent(query: Column) -> Column:
    """The first intent whose pattern fits, then factual or general."""
    low = F.lower(query)
    out = F.when(low.rlike(INTENTS[0][1]), INTENTS[0][0])
    for name, pattern in INTENTS[1:]:
        out = out.when(low.rlike(pattern), name)
    return out.when(is_technical(query) & any_of(low, DATA_WORDS), "factual").otherwise("general")


def expanded(query: Column, kind: Column) -> Column:
    """The query with its intent's words that it lacks; queries of fifteen words and more stay."""
    low = F.lower(query)
    short = F.size(F.filter(F.split(F.trim(query), r"\s+"), lambda w: w != "")) < 15
    out = query
    for name, words in EXPANSIONS.items():
        missing = F.array_join(F.filter(F.array(*[F.lit(w) for w in words]), lambda w: ~F.contains(low, w)), " ")
        out = F.when((kind == name) & short & (missing != ""), F.concat(query, F.lit(" "), missing)).otherwise(out)
    return out


def domain_boost(url: Column | str, technical: Column) -> Column:
    def boost(p) -> Column:
        h = F.regexp_replace(p.host, r"^www\.", "")
        return F.when(p.good & technical & in_domains(h, TECH_DOMAINS), 0.15).when(p.good & in_domains(h, REFERENCE_DOMAINS), 0.05).otherwise(0.0)

    return with_parts(url, boost)


def answer_signal(query: Column, snippet: Column, technical: Column) -> Column:
    """Whether a snippet holds what the query asks for, up to 0.30."""
    q, raw = F.lower(query), F.coalesce(snippet, F.lit(""))
    s = F.lower(raw)
    total = (
        F.when((technical | any_of(q, NUMBER_WORDS)) & raw.rlike(r"\d{3,}"), 0.15).otherwise(0.0)
        + F.when(any_of(q, ("table", "comparison")) & any_of(s, TABLE_MARKS), 0.15).otherwise(0.0)
        + F.when(any_of(q, COMPARE_WORDS) & any_of(s, COMPARE_MARKS), 0.10).otherwise(0.0)
        + F.when(any_of(q, CODE_WORDS) & any_of(s, CODE_MARKS), 0.10).otherwise(0.0)
    )
    return F.least(total, F.lit(0.30))


def query_terms(query: Column) -> Column:
    """Distinct words of three letters and more that are no stopwords."""
    words = F.regexp_extract_all(F.lower(F.coalesce(query, F.lit(""))), F.lit(r"[a-z][a-z0-9'+-]{2,}"), F.lit(0))
    return F.array_except(F.array_distinct(words), F.array(*[F.lit(w) for w in STOPWORDS]))


def share_of_terms(terms: Column, text: Column, most: float) -> Column:
    """Share of the terms that occur in a text, times ``most``."""
    hits = let(F.lower(F.coalesce(text, F.lit(""))), lambda low: F.size(F.filter(terms, lambda t: F.contains(low, t))))
    return F.when(F.size(terms) > 0, hits / F.size(terms) * F.lit(most)).otherwise(F.lit(0.0))


# The index that each intent asks besides the general ones, and engines that keep the query as it is.
INTENT_BACKENDS = {"research": "semantic_scholar", "factual": "semantic_scholar", "code": "github_api", "news": "hackernews", "howto": "hackernews", "reference": "wikipedia"}
CORE_ENGINES = ("duckduckgo", "brave", "mojeek", "yahoo")


def intent_backend(kind: Column) -> Column:
    """The specialised index of an intent; null where the general engines do."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in INTENT_BACKENDS.items() for x in pair]), kind)


def query_for(query: Column, kind: Column, engine: Column) -> Column:
    """What an engine is asked: core engines the query itself, others the expanded one."""
    return F.when(engine.isin(*CORE_ENGINES), query).otherwise(expanded(query, kind))

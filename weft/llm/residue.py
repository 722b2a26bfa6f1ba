"""Problem 4: template residue, filler, error and access-check texts.

Unfilled placeholders are found by one small grammar per delimiter, outside code (fences,
indented blocks, back-ticked spans). What surrounds a hit tells whether it was left unfilled
or is spoken of: quotation marks, a sentence that explains templates, a heading that names
them, the same placeholder in the page's code. Where hits are dense they are no tutorial.

Filler, error, access-check, parked and scripts-required texts are judged by density: they
are cases only where hardly any prose of the page's own stands beside them. There, a known
sentence shows one, and so does the shape of the page: a status or case number set apart in
a short text, or a status that says the page failed. Filler is text without function words
that draws on few words again and again.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import batch, decode, map_arrow, pick

# The placeholder grammars, by delimiter.
PLACEHOLDERS = (
    r"\{\{[#/^>!&]?\s*[A-Za-z_][\w.\-| ]{0,60}\}\}",  # {{ name }}, {{#each x}}
    r"\{%-?\s*[a-z_]+(?:\s[^%\n]{0,80})?-?%\}",  # {% block x %}
    r"\$\{\s*[A-Za-z_][\w.\[\]()]{0,60}\s*\}",  # ${a.b}
    r"#\{\s*[A-Za-z_@][\w.\[\]()]{0,60}\s*\}",  # #{a.b}
    r"(?:<|&lt;)%[=\-]?\s*[\w.@\[\]() ]{1,80}%(?:>|&gt;)",  # <%= x %>
    r"(?:<|&lt;)\?(?:=|php)?\s*\$?\w[^?\n]{0,80}\?(?:>|&gt;)",  # <?= $x ?>
    r"\[\[\s*[A-Za-z_][\w. \-]{0,40}\s*\]\]",  # [[x]]
    r"%%[A-Za-z_]\w{0,40}%%",
    r"(?<![\w%])%[A-Z][A-Z_]{2,40}%(?![\w%])",
    r"@@[A-Za-z_]\w{0,40}@@",
    r"(?<![\w_])__[A-Z][A-Z0-9_]{1,40}__(?![\w_])",
    r"\$\$[A-Z][A-Z0-9_]{1,40}\$\$",
    r"\*\|[A-Z][A-Z0-9_:]{1,40}\|\*",
    r"(?<![\w{$#])\{(?:\d{1,2}|[a-z][a-z0-9]*(?:_[a-z0-9]+)+|[a-z_]\w*\|\w+)\}(?![\w}])",  # {0}, {first_name}, {name|default}
    r"\[(?:INSERT|ENTER|ADD|YOUR|REPLACE|PUT)\b[A-Z0-9 _\-]{1,40}\]",
    r"<(?:INSERT|ENTER|YOUR|TITLE|NAME|TEXT|REPLACE)\b[A-Z0-9 _\-]{0,40}>",
    r"\((?:your|insert|enter|add) [a-z ]{2,30} here\)",
    r"\bXXX[\-_ ]?(?:REPLACE|CHANGE|INSERT|TODO)[\w\-]*",
    r"\bTODO: ?[a-z]+ [a-z ]{2,40}",
    r"\bundefined undefined\b",
    r"\bNaN of NaN\b",
    r"\[object [A-Z]\w+\]",
    r"\bInvalid Date\b",
)
PLACEHOLDER = re.compile("|".join(f"(?:{p})" for p in PLACEHOLDERS))
#: A text without any of these can't hold a placeholder.
_MARKS = ("{", "%", "[[", "@@", "__", "$$", "*|", "[INSERT", "[ENTER", "[ADD", "[YOUR", "[REPLACE", "[PUT", "<INSERT", "<ENTER", "<YOUR", "<TITLE", "<NAME", "<TEXT", "<REPLACE", "<?", "&lt;?", " here)", "XXX", "TODO:", "undefined undefined", "NaN of NaN", "[object ", "Invalid Date")

# Sentences of error, access-check, parked, withdrawn and scripts-required pages, by language.
_NOTICES = (
    r"(?:error |http |fehler |erreur )?[45]\d\d(?:\b.{0,60})?",
    r"(?:the )?page (?:you (?:asked|are looking) for |was )?(?:is )?not (?:be )?(?:found|here).*",
    r"(?:sorry|oops|whoops|uh oh)\b.*",
    r"seite nicht gefunden.*|die (?:gesuchte |angeforderte )?seite (?:gibt es nicht|existiert nicht|wurde nicht gefunden).*",
    r"page introuvable.*|l'adresse demandée n'existe pas.*|la page demandée.*n'existe.*",
    r"(?:error \d+: )?no (?:encontramos|se encontró|existe) la página.*|página no encontrada.*|la página (?:solicitada|que busca) no existe.*|vuelva al inicio de .*",
    r"nothing (?:lives|was found|here) .*|it may have been moved or removed.*|nothing to see here.*",
    r"(?:internal|fatal|unexpected|server|application) (?:server )?error\b.*|uncaught exception.*|stack trace.*|traceback .*|at line \d+",
    r"something went wrong.*|our team has been (?:told|notified).*|an error (?:has )?occurred.*",
    r"database connection .*|error establishing .*|could not connect .*",
    r"(?:service|site|server) (?:is )?(?:temporarily )?unavailable.*|the server is (?:under maintenance|too busy|down).*|bad gateway.*|gateway time-?out.*|upstream .*",
    r"too many requests.*|you have been sending requests .*|rate limit.*|slow down and .*",
    r"(?:403 )?forbidden.*|you don't have permission .*|access (?:to this page has been )?denied.*|access denied.*",
    r"checking (?:that|if|whether) (?:you are (?:a )?human|your browser|the site connection).*|.*(?:needs|has) to review the security of your connection.*|verify(?:ing)? (?:that )?you are (?:a )?human.*|.*you use automation tools.*|are you a robot.*|please complete the (?:captcha|security check).*|attention required.*|just a moment.*",
    r"(?:request|case|visit|reference|ray|incident|error)(?: (?:id|number|code|no\.?))?:? [#\w\-]{1,40}",
    r"(?:your )?session (?:has )?expired.*|for your safety you were signed out.*|(?:please )?(?:sign|log) in (?:again )?to (?:continue|read on|view).*",
    r"this domain is (?:parked|for sale).*|the owner of .* has not set up .*|buy this domain.*|future home of .*|domain (?:name )?(?:has )?expired.*",
    r"(?:this|the) (?:content|page|article|item|document|post) (?:is|was|has been) (?:no longer available|withdrawn|removed|deleted).*|the author has withdrawn .*|.*the link has run out.*",
    r"loading(?:…|\.\.\.)?|please wait.*|if nothing happens, allow scripts.*",
    r"(?:you need to |please |you must )?(?:enable|turn on|switch on|activate|allow) (?:javascript|scripts|js)\b.*|javascript (?:is )?(?:required|disabled|must be enabled).*|.*cannot be shown without (?:it|javascript|scripts).*|your browser (?:is out of date|has scripts blocked|does not support).*|this (?:app|page|site) (?:needs|requires) (?:javascript|scripts).*",
    r"(?:bitte )?aktivieren sie (?:java)?scripts?.*|bitte (?:schalten|erlauben) sie .*skripte?.*|javascript (?:wird benötigt|ist deaktiviert).*",
    r"(?:veuillez )?activ(?:er|ez) (?:le |les )?(?:java)?scripts?.*",
    r"(?:por favor,? )?activ[ea] (?:el )?(?:java)?scripts?.*",
)
NOTICE = re.compile("|".join(f"(?:{p})" for p in _NOTICES), re.I)
# Sentences that stand in unfinished pages.
_FILLERS = (
    r"lorem ipsum\b.*",
    r"this is (?:placeholder|sample|dummy|example) (?:copy|text|content|page)\b.*",
    r"(?:coming soon\b.*)|.*under construction\b.*",
    r"your (?:text|content|title|headline|story) (?:goes )?here\.?",
    r"(?:sample|example|dummy) (?:paragraph|post|page|text|heading)\b.*",
    r"(?:insert|enter|add) (?:your )?(?:heading|title|text|content|headline) here\.?",
    r"(?:asdf|qwer|test)(?: (?:asdf|qwer|test|123))+",
    r"just another (?:new |\w+ )?(?:site|blog|weblog)\.?",
    r"hello world!?",
    r"texte de remplissage.*|texte à venir.*",
    r"blindtext\b.*|hier steht später .*|hier entsteht .*",
    r"texto de (?:relleno|ejemplo|prueba).*|escriba aquí .*",
)
FILLER = re.compile("|".join(f"(?:{p})" for p in _FILLERS), re.I)

_FENCE = re.compile(r"^\s*(?:```|~~~)")
_TICKS = re.compile(r"`[^`\n]*`")
_TAG = re.compile(r"^(?:[#>*•\-–_\s]+|\d+\.\s)+|[*_\s]+$")
_WORD = re.compile(r"[^\W\d_]+")
#: Lines from this length on are prose if they also have enough words; prose in all from OWN_PROSE on makes a page real.
PROSE_CHARS, PROSE_WORDS, OWN_PROSE = 90, 12, 170
#: Share of a paragraph's words that must come from filler vocabulary.
FILLER_SHARE = 0.6
# Function words; a paragraph of several sentences without any of them is no text of a language.
FUNCTION_WORDS = frozenset(
    "the a an and or of to in on for with is are was were that this it its by as at from our each some most no nobody when if while "
    "der die das und oder in im von zu mit ein eine einen den dem des ist für auf bei aus nicht aber denn nach vor "
    "le la les un une des et ou de du en dans pour avec est sur chez à au aux ce cette mais car par sans "
    "el los las uno una y o del en para con es por que se su al según pero porque sin esta este "
    "il lo gli e di che da per non è con una dei della nel o um uma os as no na do da com não mas em por "
    "de het een en van voor met op bij niet maar naar och att det som på av för med inte men ett i w z na do nie że jest się oraz "
    "и в на не с по к за из у о для от что это но".split()
)


#: Evidence from which a placeholder is spoken of, and characters of prose per hit below which hits are too dense for that.
SPOKEN_OF, DENSE_CHARS = 2, 400
#: Share of different words in filler: few words come again and again. Words from which it can be told.
VARIETY, VARIETY_WORDS = 0.8, 24
#: Characters up to which a text without prose may be a notice by its shape alone.
SHAPE_CHARS = 800

# What texts about templates say, by language: names of the thing, and phrases of explaining.
_THING = re.compile(
    r"\b(?:placeholders?|templat(?:es?|ing)|variables?|merge (?:tags?|fields?)|tags?|tokens?|syntax|delimiters?|braces|brackets|expressions?|interpolation|engines?|markup|snippets?"
    r"|platzhaltern?|vorlagen?|klammern|variablen|gabarits?|modèles?|balises?|accolades|variables?|plantillas?|marcador(?:es)?|llaves|etiquetas?)\b",
    re.I,
)
_EXPLAINS = re.compile(
    r"\b(?:you (?:can |may |must |should |would )?(?:write|type|put|use|see|get|insert|add)|we (?:write|use|put)|is (?:written|replaced|called|rendered|written as|spelled)|are (?:written|replaced|called)|stands? for|means?|looks? like|such as"
    r"|for (?:example|instance)|e\.g\.|i\.e\.|instead of|literal(?:ly)?|so-called|known as|refers? to|puts? the value|fills? in|wrap(?:ped|s)? in|between (?:double|curly)|unfilled|left (?:empty|unfilled)"
    r"|schreibt man|steht für|bedeutet|zum beispiel|z\. ?b\.|wird ersetzt|heißt|on écrit|signifie|par exemple|remplacée? par|se escribe|significa|por ejemplo|se sustituye)\b",
    re.I,
)
_QUOTES = "\"'“”„«»‹›‘’「」"
_STATUS_LINE = re.compile(r"(?:\W*\w+\W+){0,3}\W*[45]\d\d\b.{0,60}", re.S)
_CASE_LINE = re.compile(r"(?:[^\W\d_]+[ :#.]+){1,3}#?(?=[\w\-]*\d)[\w\-]{5,40}")
_SENTENCE_END = re.compile(r"[.!?…]\s|\n")


def outside_code(text: str) -> str:
    """The text without fenced blocks, indented code and back-ticked spans."""
    if "`" not in text and "~~~" not in text and "    " not in text and "\t" not in text:
        return text
    lines, fenced = [], False
    for line in text.split("\n"):
        if _FENCE.match(line):
            fenced = not fenced
        elif not fenced and not line.startswith(("    ", "\t")):
            lines.append(_TICKS.sub(" ", line))
    if fenced:  # a fence that is never closed hides nothing
        return _TICKS.sub(" ", text.replace("```", " "))
    return "\n".join(lines)


def has_placeholder(text: str) -> bool:
    """Whether an unfilled placeholder, or a value that was never filled in, stands in the text outside code.

    One that is only spoken of doesn't count, unless hits are dense.
    """
    if not any(m in text for m in _MARKS):
        return False
    bare = outside_code(text)
    hits = list(PLACEHOLDER.finditer(bare))
    if not hits:
        return False
    spoken = [_spoken_of(bare, m) for m in hits]
    if not any(spoken):
        return True
    in_code = {x[0] for x in PLACEHOLDER.finditer(text)} if bare != text else set()
    outside = {m[0] for m in hits}
    headed = any(_THING.search(line) for line in bare.split("\n") if line.lstrip().startswith("#") and not PLACEHOLDER.search(line))
    more = headed + bool(in_code - outside or any(text.count(x) > bare.count(x) for x in outside))
    left = [m for m, n in zip(hits, spoken) if n + (more if n else 0) < SPOKEN_OF]
    return bool(left) or len(bare) < DENSE_CHARS * (len(hits) - sum(n >= 3 for n in spoken))


def _spoken_of(text: str, m: re.Match) -> int:
    """Evidence that a placeholder is spoken of: its quotation marks, and what its sentence says."""
    before, after = text[max(0, m.start() - 1) : m.start()], text[m.end() : m.end() + 1]
    quoted = 3 * (bool(before) and bool(after) and before in _QUOTES and after in _QUOTES)
    begin = max((x.end() for x in _SENTENCE_END.finditer(text, max(0, m.start() - 240), m.start())), default=max(0, m.start() - 240))
    end = _SENTENCE_END.search(text, m.end(), m.end() + 240)
    around = text[begin : m.start()] + " \x00 " + text[m.end() : end.start() if end else m.end() + 240]
    return quoted + bool(_THING.search(around)) * bool(_EXPLAINS.search(around)) * 2


def is_filler_paragraph(line: str) -> bool:
    """Words of no language: several of them, hardly any function word."""
    words = _WORD.findall(line.lower())
    if len(words) < 8:
        return False
    return sum(w not in FUNCTION_WORDS for w in words) / len(words) > 0.97 and len(set(words)) > 4


def judge(text: str | None, status: int | None = None) -> str | None:
    """'placeholder', 'filler', 'notice' or None for real content, empty and null texts.

    The status is evidence only beside a text without prose, as it may not match the text.
    """
    if not text:
        return None
    if has_placeholder(text):
        return "placeholder"
    own = filler = notices = 0
    said: list[str] = []
    fillers = shaped = other = False
    bare_text = outside_code(text)
    for line in bare_text.split("\n"):
        bare = _TAG.sub("", line)
        if not bare:
            continue
        if len(bare) >= PROSE_CHARS and bare.count(" ") >= PROSE_WORDS - 1:
            if is_filler_paragraph(bare):
                filler += len(bare)
                said.append(bare)
            elif len(bare) >= 150 or not NOTICE.fullmatch(bare):
                own += len(bare)
            else:
                notices += 1
        elif len(bare) < 150:
            if FILLER.fullmatch(bare):
                fillers = True
            elif NOTICE.fullmatch(bare):
                notices += 1
            elif is_filler_paragraph(bare):
                filler += len(bare)
                said.append(bare)
            elif len(bare) <= 80 and (_STATUS_LINE.fullmatch(bare) or _CASE_LINE.fullmatch(bare)):
                shaped = True
            other = other or line.lstrip().startswith("|")
    if said and not fillers:
        words = [w for x in said for w in _WORD.findall(x.lower())]
        if len(words) >= VARIETY_WORDS and len(set(words)) > VARIETY * len(words):  # a language that isn't known
            own, filler = own + filler, 0
    if (fillers or filler > 80) and own <= max(OWN_PROSE, filler * (1 - FILLER_SHARE) / FILLER_SHARE):
        return "filler"
    if own <= OWN_PROSE and (notices or ((shaped or (status or 0) >= 400) and not other and bare_text == text and len(text) <= SHAPE_CHARS)):
        return "notice"
    return None


def residue(df: DataFrame, id_col: str = "entry_id", content_col: str = "content", encoded: bool = True, status_col: str | None = "status") -> DataFrame:
    """(id, reason) of the rows whose text is residue; null, undecodable and empty texts give no row.

    Row by row, without a shuffle; repeated rows give repeated results. A null status, or no
    status column, is no evidence.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            got = [(k, r) for k, c, s in zip(*(b.column(i).to_pylist() for i in range(3))) if (r := judge(decode(c) if encoded else c, s))]
            yield batch({"id": ([k for k, _ in got], b.schema.field(0).type), "reason": ([r for _, r in got], pa.string())})

    return map_arrow(pick(df, id=id_col, content=content_col, status=_status(df, status_col)), run, f"id {kind}, reason string")


def _status(df: DataFrame, status_col: str | None):
    return F.col(f"`{status_col}`").cast("int") if status_col and status_col in df.columns else F.lit(None).cast("int")


def kept(df: DataFrame, id_col: str = "entry_id", url_col: str = "url", content_col: str = "content", encoded: bool = True, status_col: str | None = "status") -> DataFrame:
    """(id, url, text) of the rows whose text is real content, judged and kept in one pass, without a join.

    Empty, null and undecodable texts are no residue and stay; repeated rows stay repeated.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            texts = [decode(c) if encoded else c for c in b.column(2).to_pylist()]
            at = [i for i, (t, s) in enumerate(zip(texts, b.column(3).to_pylist())) if judge(t, s) is None]
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array([texts[i] for i in at], pa.string())], names=["id", "url", "text"])

    return map_arrow(pick(df, id=id_col, url=url_col, content=content_col, status=_status(df, status_col)), run, f"id {kind}, url string, text string")

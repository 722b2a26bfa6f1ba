"""A small document tree on the standard parser, CSS selection, and what pages yield.

Plain Python for use inside Arrow batch functions: one parse per page, every product
asked for from the same tree. Nothing here raises on broken markup.
"""

from __future__ import annotations

import json
import math
import re
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# an opening tag ends these open ones first
_ENDS = {"li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
_BLOCKS = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_SCOPES = {"li": {"ul", "ol"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}}
NAV_TAGS = frozenset(("nav", "header", "footer", "aside"))
#: The nodes of a page that are read are bounded by a request's budget.
MAX_COLUMNS, MAX_NODES = 64, 2_000_000


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: "Node | None") -> None:
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []

    def nodes(self):
        """This node's elements below it, in document order, without recursion."""
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            n = stack.pop()
            yield n
            stack.extend(c for c in reversed(n.children) if isinstance(c, Node))

    def text(self, skip: frozenset[str] = frozenset(("script", "style", "noscript", "template"))) -> str:
        out, stack = [], list(reversed(self.children))
        while stack:
            c = stack.pop()
            if isinstance(c, str):
                out.append(c)
            elif c.tag not in skip:
                if c.tag in _BLOCKS or c.tag in ("br", "li", "tr", "td", "th"):
                    out.append(" ")
                stack.extend(reversed(c.children))
        return " ".join("".join(out).split())

    def ancestors(self):
        n = self.parent
        while n is not None:
            yield n
            n = n.parent

    def elements(self) -> list["Node"]:
        return [c for c in self.children if isinstance(c, Node)]


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("#root", {}, None)
        self.open, self.count = self.root, 0

    def handle_starttag(self, tag, attrs):
        self.count += 1
        if self.count > MAX_NODES:
            return
        if tag in _ENDS:
            self._close_until(_ENDS[tag], _SCOPES.get(tag, set()))
        elif tag in _BLOCKS:
            self._close_until({"p"}, {"td", "th", "li", "div", "section", "article"})
        node = Node(tag, {k: v or "" for k, v in attrs}, self.open)
        self.open.children.append(node)
        if tag not in VOID:
            self.open = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open.tag == tag:
            self.open = self.open.parent

    def _close_until(self, tags: set[str], walls: set[str]):
        n = self.open
        while n is not self.root and n.tag not in walls:
            if n.tag in tags:
                self.open = n.parent
                n = self.open
                continue
            n = n.parent

    def handle_endtag(self, tag):
        n = self.open
        while n is not self.root:
            if n.tag == tag:
                self.open = n.parent
                return
            n = n.parent

    def handle_data(self, data):
        self.open.children.append(data)


def parse(html: str | None) -> Node:
    b = _Builder()
    try:
        b.feed(html or "")
        b.close()
    except Exception:
        pass
    return b.root


_STEP = re.compile(r"\s*([>+~,]|\s)\s*|(\*|[A-Za-z][\w-]*)|#([\w-]+)|\.([\w-]+)|\[\s*([\w:-]+)\s*(?:([~^$*|]?=)\s*(?:\"([^\"]*)\"|'([^']*)'|([^\]\s]+))\s*)?\]|:(first-child|last-child|nth-child|nth-of-type|not)(?:\(([^()]*)\))?")


def compile_css(selector: str) -> list[list[tuple[str, list]]] | None:
    """Alternatives of (combinator, tests); None for selectors outside the subset."""
    out, current, tests, combinator, at = [], [], [], " ", 0
    selector = selector.strip()
    while at < len(selector):
        m = _STEP.match(selector, at)
        if not m or m.end() == at:
            return None
        at = m.end()
        if m[1]:
            if tests:
                current.append((combinator, tests))
            tests, combinator = [], m[1]
            if m[1] == ",":
                out.append(current)
                current, combinator = [], " "
            continue
        if m[2]:
            tests.append(("tag", m[2].lower()))
        elif m[3]:
            tests.append(("attr", "id", "=", m[3]))
        elif m[4]:
            tests.append(("attr", "class", "~=", m[4]))
        elif m[5]:
            tests.append(("attr", m[5].lower(), m[6] or "", next((x for x in (m[7], m[8], m[9]) if x is not None), "")))
        elif m[10] == "not":
            inner = compile_css(m[11] or "")
            if not inner:
                return None
            tests.append(("not", inner))
        else:
            tests.append((m[10], m[11] or ""))
    if tests:
        current.append((combinator, tests))
    if current:
        out.append(current)
    return out or None


def _attr_fits(have: str | None, op: str, want: str) -> bool:
    if have is None:
        return False
    if op == "":
        return True
    if op == "=":
        return have == want
    if op == "~=":
        return want in have.split()
    if op == "|=":
        return have == want or have.startswith(want + "-")
    return bool(want) and {"^=": have.startswith, "$=": have.endswith, "*=": have.__contains__}[op](want)


def _fits(n: Node, tests: list) -> bool:
    for t in tests:
        if t[0] == "tag":
            if t[1] not in ("*", n.tag):
                return False
        elif t[0] == "attr":
            if not _attr_fits(n.attrs.get(t[1]), t[2], t[3]):
                return False
        elif t[0] == "not":
            if any(matches(n, c) for c in t[1]):
                return False
        else:
            kin = n.parent.elements() if n.parent else [n]
            if t[0] == "nth-of-type":
                kin = [k for k in kin if k.tag == n.tag]
            place = next(i for i, k in enumerate(kin, 1) if k is n)
            if t[0] == "first-child":
                good = place == 1
            elif t[0] == "last-child":
                good = place == len(kin)
            else:
                good = _nth(t[1], place)
            if not good:
                return False
    return True


def _nth(spec: str, place: int) -> bool:
    spec = spec.strip().lower().replace("odd", "2n+1").replace("even", "2n").replace(" ", "")
    if spec.lstrip("-").isdigit():
        return place == int(spec)
    m = re.fullmatch(r"(-?\d*)n([+-]\d+)?", spec)
    if not m:
        return False
    a = {"": 1, "-": -1}.get(m[1]) or int(m[1] or 1)
    b = int(m[2] or 0)
    return (place - b) % a == 0 and (place - b) // a >= 0 if a else place == b


def matches(n: Node, steps: list) -> bool:
    """Whether a node is what a compiled selector's last step names."""
    combinator, tests = steps[-1]
    if n.tag == "#root" or not _fits(n, tests):
        return False
    rest = steps[:-1]
    if not rest:
        return True
    if combinator == ">":
        return n.parent is not None and matches(n.parent, rest)
    if combinator in "+~":
        kin = n.parent.elements() if n.parent else []
        before = kin[: next((i for i, k in enumerate(kin) if k is n), 0)]
        return any(matches(k, rest) for k in (before[-1:] if combinator == "+" else before))
    return any(matches(a, rest) for a in n.ancestors())


def select(root: Node, selector: str) -> list[Node]:
    """Matching nodes in document order; none for selectors outside the subset."""
    steps = compile_css(selector)
    return [n for n in root.nodes() if any(matches(n, s) for s in steps)] if steps else []


def title(root: Node) -> str:
    for n in root.nodes():
        if n.tag == "title":
            return " ".join("".join(c for c in n.children if isinstance(c, str)).split())
    return ""


# The field that a meta key fills; the first in the document counts.
META_FIELDS = {
    "og:title": "title", "twitter:title": "title", "og:description": "description", "description": "description", "twitter:description": "description", "og:site_name": "site_name", "og:type": "type",
    "og:image": "image", "twitter:image": "image", "og:url": "og_url", "article:published_time": "published_time", "article:modified_time": "modified_time", "article:author": "author", "author": "author",
}
#: What a field of JSON-LD fills, in the order in which its keys are tried, and the length it is cut to.
LD_FIELDS = {"published_time": (("datePublished", "dateCreated"), 20), "title": (("headline", "name"), 500), "description": (("description",), 300), "author": (("author",), 200)}


def metadata(root: Node, url: str) -> dict[str, str]:
    """Title, description, site, type, image, author, dates, language and canonical address of a page.

    Meta keys come first, then the title element, then what JSON-LD entities say. Values are
    cut to 500 characters, which is the feature of a summary.
    """
    out: dict[str, str] = {}
    entities: list = []
    for n in root.nodes():
        if n.tag == "meta":
            key = META_FIELDS.get((n.attrs.get("property") or n.attrs.get("name") or "").lower().strip())
            value = n.attrs.get("content", "").strip()
            if key and value:
                out.setdefault(key, value[:500])
        elif n.tag == "html" and n.attrs.get("lang"):
            out.setdefault("lang", n.attrs["lang"].strip()[:100])
        elif n.tag == "link" and "canonical" in n.attrs.get("rel", "").lower().split() and n.attrs.get("href"):
            out.setdefault("canonical", urljoin(url, n.attrs["href"].strip()))
        elif n.tag == "script" and n.attrs.get("type", "").lower() == "application/ld+json":
            try:
                found = json.loads("".join(c for c in n.children if isinstance(c, str)))
            except ValueError:
                continue
            entities += [x for x in (found if isinstance(found, list) else [found]) if isinstance(x, dict)]
    if t := title(root):
        out.setdefault("title", t[:500])
    for entity in entities:
        for field, (keys, most) in LD_FIELDS.items():
            value = next((entity[k] for k in keys if entity.get(k)), None)
            if field == "author":
                value = value[0] if isinstance(value, list) and value else value
                value = value.get("name") if isinstance(value, dict) else value
            if value:
                out.setdefault(field, str(value)[:most])
    return out


#: Links of each kind that are classified for a reader, and anchors looked at; bounds of the report, not of the page's links.
LINK_CAPS, MOST_ANCHORS = {"citation": 30, "navigation": 20, "external": 20}, 3000


def link_report(root: Node, url: str) -> dict:
    """{citations, navigation, external, primary_source}: a page's first links by kind, each {url, text}."""
    found = list(_anchors(root, url, MOST_ANCHORS))
    kinds = {"citation": lambda out, nav: not out and not nav, "navigation": lambda out, nav: not out and nav, "external": lambda out, nav: out}
    of = lambda k: [{"url": u, "text": t} for u, t, out, nav in found if kinds[k](out, nav)][: LINK_CAPS[k]]
    content = [(u, t, "external") for u, t, out, nav in found if out and not nav]  # navigation names no sources
    return {"citations": of("citation"), "navigation": of("navigation"), "external": of("external"), "primary_source": primary_source(metadata(root, url), content, url)}


def links(root: Node, url: str, most: int | None = None) -> list[tuple[str, str, str]]:
    """(url, text, kind) of links, each page once: citation, navigation or external; of the first ``most`` anchors if asked."""
    return [(target, text, "external" if outside else "navigation" if nav else "citation") for target, text, outside, nav in _anchors(root, url, most)]


def _anchors(root: Node, url: str, most: int | None):
    """(url, text, whether on another host, whether in navigation) of anchors, each page once."""
    own, seen, anchors = _host(url), set(), 0
    for n in root.nodes():
        if n.tag != "a" or "href" not in n.attrs:
            continue
        anchors += 1
        if most is not None and anchors > most:
            return
        href = n.attrs["href"].strip()
        if not href or href.lower().startswith(("javascript:", "mailto:", "tel:", "data:", "#")):
            continue
        try:
            target = urljoin(url, href).split("#")[0]
            host = _host(target)
        except ValueError:
            continue
        if not host or target in seen:
            continue
        seen.add(target)
        text = n.text()
        nav = any(a.tag in NAV_TAGS or a.attrs.get("role") in ("navigation", "menu", "menubar") for a in n.ancestors())
        yield target, text if len(text) <= 160 else text[:157] + "...", host != own, nav


def _host(url: str) -> str:
    p = urlsplit(url)
    h = (p.hostname or "").lower() if p.scheme in ("http", "https") else ""
    return h[4:] if h.startswith("www.") else h


def _own_rows(table: Node) -> list[tuple[Node, bool]]:
    """(row, whether in the head) of a table, rows of tables within it left out."""
    out = []
    for c in table.elements():
        if c.tag == "tr":
            out.append((c, False))
        elif c.tag in ("thead", "tbody", "tfoot"):
            out += [(r, c.tag == "thead") for r in c.elements() if r.tag == "tr"]
    return out


def _span(cell: Node, name: str, most: int) -> int | None:
    raw = cell.attrs.get(name, "1").strip() or "1"
    return min(max(int(raw), 1), most) if raw.isdigit() and len(raw) < 7 else (most if raw.isdigit() else None)


def tables(root: Node, least: int = 7) -> list[dict]:
    """Data tables: headers, rectangular rows, caption and summary.

    A table's signs are added up: a head 2, a body 1, header cells 3, an even number of
    columns 2, a caption 2, a summary 1, a presentation role -3. Spans fill a grid; a
    table with a span that is no number is left out.
    """
    out = []
    for t in root.nodes():
        if t.tag != "table":
            continue
        rows = _own_rows(t)
        if not rows:
            continue
        kids = [c.tag for c in t.elements()]
        widths = [sum(1 for n in r.nodes() if n.tag in ("td", "th")) for r, _ in rows]
        mean = sum(widths) / len(widths)
        headed = any(c.tag == "th" for c in rows[0][0].elements())
        score = 2 * ("thead" in kids) + ("tbody" in kids) + 3 * headed + 2 * ("caption" in kids) + bool(t.attrs.get("summary")) - 3 * (t.attrs.get("role", "").lower() in ("presentation", "none"))
        score += 2 * (sum((w - mean) ** 2 for w in widths) / len(widths) < 1)
        if score < least:
            continue
        grid: dict[tuple[int, int], str] = {}
        broken = False
        for y, (r, _) in enumerate(rows):
            x = 0
            for cell in (c for c in r.elements() if c.tag in ("td", "th")):
                while (y, x) in grid:
                    x += 1
                wide, high = _span(cell, "colspan", MAX_COLUMNS), _span(cell, "rowspan", len(rows) - y)
                if wide is None or high is None:
                    broken = True
                    break
                value = cell.text(frozenset(("script", "style", "noscript", "template", "table")))
                for dy in range(high):
                    for dx in range(min(wide, MAX_COLUMNS - x)):
                        grid.setdefault((y + dy, x + dx), value)
                x += wide
        if broken:
            continue
        full = max((x for _, x in grid), default=-1) + 1
        lines = [[grid.get((y, x), "") for x in range(full)] for y in range(len(rows))]
        head = next((y for y, (_, h) in enumerate(rows) if h), 0 if headed else None)
        body = [line for y, line in enumerate(lines) if y != head and not rows[y][1] and any(v.strip() for v in line)]
        caption = next((c.text() for c in t.elements() if c.tag == "caption"), "")
        out.append({"headers": lines[head] if head is not None else [], "rows": body, "caption": caption, "summary": t.attrs.get("summary", "")})
    return out


def json_ld(root: Node, most: int = 100) -> list[str]:
    """Entities of JSON-LD scripts as JSON texts; graphs and lists are opened, broken ones skipped."""
    out: list[str] = []
    for n in root.nodes():
        if n.tag == "script" and n.attrs.get("type", "").lower() == "application/ld+json":
            try:
                found = json.loads("".join(c for c in n.children if isinstance(c, str)))
            except ValueError:
                continue
            todo = [found]
            while todo and len(out) < most:
                x = todo.pop(0)
                if isinstance(x, list):
                    todo = x + todo
                elif isinstance(x, dict):
                    if isinstance(x.get("@graph"), list):
                        todo = x["@graph"] + todo
                    else:
                        out.append(json.dumps(x, ensure_ascii=False, sort_keys=True)[:20_000])
    return out


def microdata(root: Node) -> list[str]:
    """Top items of microdata as JSON texts, items within items nested."""

    def value(n: Node):
        if "itemscope" in n.attrs:
            return item(n)
        for name in ("content", "datetime", "href", "src", "value"):
            if n.attrs.get(name):
                return n.attrs[name]
        return n.text()

    def item(n: Node) -> dict:
        out: dict = {"@type": n.attrs.get("itemtype", "").rsplit("/", 1)[-1]}
        todo = n.elements()[::-1]
        while todo:
            c = todo.pop()
            if "itemprop" in c.attrs:
                for name in c.attrs["itemprop"].split():
                    v = value(c)
                    out[name] = [*(out[name] if isinstance(out[name], list) else [out[name]]), v] if name in out else v
            if "itemscope" not in c.attrs:
                todo.extend(c.elements()[::-1])
        return out

    return [json.dumps(item(n), ensure_ascii=False, sort_keys=True) for n in root.nodes() if "itemscope" in n.attrs and "itemprop" not in n.attrs]


def script_data(root: Node, most: int = 200_000) -> list[tuple[str, str]]:
    """(label, JSON text) of data that scripts carry: JSON scripts and assignments of JSON literals."""
    out = []
    for n in root.nodes():
        if n.tag != "script":
            continue
        body = "".join(c for c in n.children if isinstance(c, str)).strip()
        if "json" in n.attrs.get("type", "").lower():
            label = "json-ld" if "ld+json" in n.attrs["type"].lower() else n.attrs.get("id") or "json"
            try:
                out.append((label, json.dumps(json.loads(body), ensure_ascii=False)[:most]))
            except ValueError:
                pass
            continue
        for m in re.finditer(r"(?:window\.|var |let |const |self\.)([A-Za-z_$][\w$]*)\s*=\s*(?=[\[{])", body):
            try:
                found, _ = json.JSONDecoder().raw_decode(body, m.end())
            except ValueError:
                continue
            out.append((m[1], json.dumps(found, ensure_ascii=False)[:most]))
    return out


_NOISE_TAGS = frozenset("script style noscript template iframe object embed svg canvas form button input select textarea".split())
_HIDDEN = ("display:none", "visibility:hidden", "opacity:0", "height:0", "width:0", "font-size:0")


def sanitise(root: Node) -> Node:
    """Noise tags and hidden nodes out, what follows them kept."""
    for n in [root, *root.nodes()]:
        n.children = [c for c in n.children if isinstance(c, str) or not _is_noise(c)]
    return root


def _is_noise(n: Node) -> bool:
    style = n.attrs.get("style", "").lower().replace(" ", "")
    return n.tag in _NOISE_TAGS or "hidden" in n.attrs or n.attrs.get("aria-hidden") == "true" or any(h in style for h in _HIDDEN)


# Weights of a node's signs, and of tags.
WEIGHTS = {"density": 0.4, "links": 0.2, "tag": 0.2, "name": 0.1, "length": 0.1}
_TAG_WEIGHT = {"article": 1.5, "main": 1.4, "section": 1.3, "h1": 1.2, "h2": 1.1, "h3": 1.0, "p": 1.0, "div": 0.5, "li": 0.5, "span": 0.3}
_CHROME = re.compile(r"nav|footer|sidebar|comment|advert|cookie|popup|banner", re.I)


def prune(root: Node, threshold: float = 0.48) -> Node:
    """Nodes that read like page furniture cut out, judged bottom-up by text and link density, tag and names."""
    order = [root, *root.nodes()]
    stats: dict[int, tuple[int, int, int]] = {}  # markup, text, link text
    for n in reversed(order):
        own = sum(len(c.strip()) for c in n.children if isinstance(c, str))
        size = own + 2 * len(n.tag) + 5 + sum(len(k) + len(v) + 2 for k, v in n.attrs.items())
        text, linked = own, own if n.tag == "a" else 0
        for c in n.elements():
            s = stats[id(c)]
            size, text, linked = size + s[0], text + s[1], linked + (s[1] if n.tag == "a" else s[2])
        stats[id(n)] = (size, text, linked)
    for n in order:
        n.children = [c for c in n.children if isinstance(c, str) or _worth(c, stats[id(c)]) >= threshold - 0.15 or c.tag in ("html", "body", "head")]
    return root


def _worth(n: Node, s: tuple[int, int, int]) -> float:
    size, text, linked = s
    names = n.attrs.get("class", "") + " " + n.attrs.get("id", "")
    name = 0.0 if _CHROME.search(names) else 0.5
    return (
        WEIGHTS["density"] * (text / size if size else 0.0) + WEIGHTS["links"] * (1 - linked / text if text else 1.0) + WEIGHTS["tag"] * _TAG_WEIGHT.get(n.tag, 0.5)
        + WEIGHTS["name"] * name + WEIGHTS["length"] * math.log(text + 1) / 5
    )


def markdown(root: Node) -> str:
    """Headings, paragraphs, lists, tables and code of a tree as Markdown."""
    out: list[str] = []

    def inline(n: Node) -> str:
        parts = []
        for c in n.children:
            if isinstance(c, str):
                parts.append(c)
            elif c.tag == "a" and c.attrs.get("href"):
                parts.append(f"[{inline(c).strip()}]({c.attrs['href']})")
            elif c.tag in ("b", "strong"):
                parts.append(f"**{inline(c).strip()}**")
            elif c.tag == "code":
                parts.append(f"`{c.text()}`")
            elif c.tag == "br":
                parts.append("\n")
            elif c.tag not in _NOISE_TAGS:
                parts.append(inline(c))
        return re.sub(r"[ \t\r\f\v]+", " ", "".join(parts))

    stack: list[Node | str] = list(reversed(root.children))
    while stack:
        c = stack.pop()
        if isinstance(c, str):
            if c.strip():
                out.append(" ".join(c.split()))
        elif c.tag in _NOISE_TAGS or c.tag in ("head", "title"):
            continue
        elif re.fullmatch(r"h[1-6]", c.tag):
            out.append("#" * int(c.tag[1]) + " " + inline(c).strip())
        elif c.tag in ("p", "blockquote"):
            if t := inline(c).strip():
                out.append(("> " if c.tag == "blockquote" else "") + t)
        elif c.tag == "pre":
            out.append("```\n" + "".join(x if isinstance(x, str) else x.text() for x in c.children).strip("\n") + "\n```")
        elif c.tag in ("ul", "ol"):
            items = [x for x in c.elements() if x.tag == "li"]
            out.append("\n".join(f"{'-' if c.tag == 'ul' else f'{i}.'} {inline(x).strip()}" for i, x in enumerate(items, 1)))
        elif c.tag == "table":
            cells = [[x.text() for x in r.elements() if x.tag in ("td", "th")] for r, _ in _own_rows(c)]
            if cells:
                wide = max(map(len, cells))
                lines = ["| " + " | ".join(r + [""] * (wide - len(r))) + " |" for r in cells]
                out.append("\n".join([lines[0], "| " + " | ".join(["---"] * wide) + " |", *lines[1:]]))
        else:
            stack.extend(reversed(c.children))
    return "\n\n".join(x for x in out if x.strip())


def extract(root: Node, schema: dict) -> list[dict]:
    """Records by a schema {baseSelector, fields: [{name, selector, type, attribute, pattern, group, fields, default, transform}]}.

    Types are text, attribute, html, regex, list, nested and nested_list; selectors are CSS, or paths where they begin
    with a slash or ./; every declared field is there, null where nothing fits.
    """
    schema = checked_schema(schema)
    bases = _found(root, schema["baseSelector"]) if schema.get("baseSelector") else [root]
    return [{f["name"]: _field(b, f) for f in schema.get("fields", ())} for b in bases]


def _found(base: Node, selector: str) -> list:
    """Nodes by a path where the selector looks like one, else by CSS."""
    return xpath(base, selector) if selector.startswith(("/", "./", "xpath:")) else select(base, selector)


def _field(base: Node, f: dict):
    found = _found(base, f["selector"]) if f.get("selector") else [base]
    if found and isinstance(found[0], str):  # a path may end in texts
        return found if f.get("type") == "list" else found[0]
    if f.get("type") == "list":
        return [n.text() for n in found]
    kind = f.get("type", "text")
    if kind == "nested_list":
        return [{g["name"]: _field(n, g) for g in f.get("fields", ())} for n in found]
    if not found:
        return f.get("default")
    n = found[0]
    if kind == "nested":
        return {g["name"]: _field(n, g) for g in f.get("fields", ())}
    if kind == "attribute":
        v = n.attrs.get(f.get("attribute", ""))
    elif kind == "html":
        v = to_html(n)
    else:
        v = n.text()
    if v is not None and f.get("pattern"):
        m = re.search(f["pattern"], v)
        v = m.group(f.get("group", 1 if m.re.groups else 0)) if m else None
    if v is None or v == "":
        return f.get("default")
    change = {"lowercase": str.lower, "uppercase": str.upper, "strip": str.strip}.get(f.get("transform", ""))
    return change(v) if change else v


def to_html(n: Node) -> str:
    esc = lambda s: s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    out: list[str] = []
    todo: list = [n]
    while todo:
        x = todo.pop()
        if isinstance(x, tuple):
            out.append(x[0])
        elif isinstance(x, str):
            out.append(esc(x))
        else:
            out.append("<" + x.tag + "".join(f' {k}="{esc(v).replace(chr(34), "&quot;")}"' for k, v in x.attrs.items()) + ">")
            if x.tag not in VOID:
                todo.append((f"</{x.tag}>",))
                todo.extend(reversed(x.children))
    return "".join(out)


def selector_of(n: Node) -> str:
    """A CSS selector that finds the node: from the nearest id down, by place among its kind."""
    parts = []
    while n.tag != "#root":
        if n.attrs.get("id") and re.fullmatch(r"[\w-]+", n.attrs["id"]):
            parts.append("#" + n.attrs["id"])
            break
        kin = [k for k in (n.parent.elements() if n.parent else [n]) if k.tag == n.tag]
        parts.append(n.tag if len(kin) == 1 else f"{n.tag}:nth-of-type({next(i for i, k in enumerate(kin, 1) if k is n)})")
        n = n.parent
    return " > ".join(reversed(parts))


def render(text: str, page_title: str = "") -> str:
    """A page of Markdown-like text: what turns stored texts back into a tree."""
    out, items = [], []
    esc = lambda s: s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    link = lambda s: re.sub(r"\[([^\]\n]*)\]\(([^)\s]+)\)", r'<a href="\2">\1</a>', esc(s))
    rows: list[str] = []

    def flush():
        if items:
            out.append("<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>")
            items.clear()
        if rows:
            cells = [[c.strip() for c in r.strip().strip("|").split("|")] for r in rows if not re.fullmatch(r"[|\s:-]+", r)]
            if cells:
                head = "<thead><tr>" + "".join(f"<th>{esc(c)}</th>" for c in cells[0]) + "</tr></thead>"
                out.append("<table>" + head + "<tbody>" + "".join("<tr>" + "".join(f"<td>{esc(c)}</td>" for c in r) + "</tr>" for r in cells[1:]) + "</tbody></table>")
            rows.clear()

    for line in text.split("\n"):
        s = line.strip()
        m = re.match(r"(#{1,6}) (.*)", s)
        if re.match(r"[-•*] ", s):
            items.append(link(s[2:]))
            continue
        if s.startswith("|"):
            rows.append(s)
            continue
        flush()
        if m:
            out.append(f"<h{len(m[1])}>{link(m[2])}</h{len(m[1])}>")
        elif s:
            out.append(f"<p>{link(s)}</p>")
    flush()
    return f"<html><head><title>{esc(page_title)}</title></head><body><article>{''.join(out)}</article></body></html>"


def images(root: Node, url: str, most: int = 20) -> list[str]:
    """Absolute image addresses in document order, each once."""
    found = [urljoin(url, n.attrs["src"].strip()) for n in root.nodes() if n.tag == "img" and n.attrs.get("src", "").strip() and not n.attrs["src"].startswith("data:")]
    return list(dict.fromkeys(found))[:most]


def link_list(found: list[tuple[str, str, str]], most: int = 200) -> str:
    """Links as a Markdown list."""
    return "\n".join(f"- [{text or url}]({url})" for url, text, _ in found[:most])


def metrics(root: Node) -> dict[str, int]:
    """Nodes, characters of text and greatest depth of a tree."""
    deepest, nodes, chars, todo = 0, 0, 0, [(root, 0)]
    while todo:
        n, d = todo.pop()
        deepest = max(deepest, d)
        for c in n.children:
            if isinstance(c, str):
                chars += len(c)
            else:
                nodes += 1
                todo.append((c, d + 1))
    return {"nodes": nodes, "text": chars, "depth": deepest}


# What marks kinds of pages, and hosts of primary sources.
_QA = ("stackoverflow", "stackexchange", 'class="question', 'class="answer', "data-answerid", "data-questionid")
_FORUM = ("phpbb", "discourse", 'class="forum', 'id="forum', 'class="thread', 'class="post-body', 'class="message-body', "data-post-id")
_DOCS = ("mkdocs", "docusaurus", "readthedocs", "sphinx-document", "algolia-docsearch", "md-nav", "theme-doc", 'class="rst-content', "wy-nav-side")
_PAYWALL = ("subscribe to continue", "subscribe to read", "this article is for subscribers", "create a free account to continue", "sign in to continue reading", "you've reached your free article limit", "subscriber-only content", "premium content")
_GATES = ("data-paywall", "data-content-gate", "data-subscription-wall")
_OFF = frozenset(("0", "false", "no", "off", "disabled", "none", "null"))
PRIMARY_HOSTS = ("arxiv.org", "doi.org", "biorxiv.org", "medrxiv.org", "github.com", "gitlab.com", "opencode.dev", "wikipedia.org", "wikimedia.org", "nature.com", "science.org", "sciencedirect.com", "springer.com", "ieee.org", "acm.org", "plos.org")


def page_type(html: str, url: str, media: str = "", text_len: int = 0) -> str:
    """Kind of page: pdf, json or image by media, else redirect, paywall, qa, forum, docs, list, article or unknown."""
    if media in ("pdf", "json", "image"):
        return media
    if not (html or "").strip():
        return "unknown"
    low, root = html.lower(), parse(html)
    refresh = any(n.tag == "meta" and n.attrs.get("http-equiv", "").lower() == "refresh" and "url=" in n.attrs.get("content", "").lower() for n in root.nodes())
    if refresh or (text_len < 500 and re.search(r"location\.href\s*=|location\.replace|window\.location\s*=", low)):
        return "redirect"
    visible = root.text().lower()
    gated = any(k in n.attrs and n.attrs[k].strip().lower() not in _OFF for n in root.nodes() if n.tag not in ("base", "link", "meta") for k in _GATES)
    if gated or any(m in visible for m in _PAYWALL):
        return "paywall"
    for name, marks in (("qa", _QA), ("forum", _FORUM), ("docs", _DOCS)):
        if any(m in low for m in marks):
            return name
    article = any(n.tag == "article" for n in root.nodes())
    if not article:
        own = sum(kind == "citation" for _, _, kind in links(root, url))
        if own >= 20 and (text_len < 1500 or text_len / own < 200):
            return "list"
    return "article" if article else "unknown"


def primary_source(meta: dict[str, str], found: list[tuple[str, str, str]], url: str) -> str:
    """A canonical address on another host, else the first outside link to a primary host, else ''."""
    other = meta.get("canonical", "")
    if _host(other) and _host(other) != _host(url):
        return other
    return next((u for u, _, kind in found if kind == "external" and any(_host(u) == h or _host(u).endswith("." + h) for h in PRIMARY_HOSTS)), "")


def _likeness(a: Node, b: Node, text: bool) -> float:
    path = lambda n: [n.tag, *[x.tag for x in list(n.ancestors())[:2]]]
    signs = [float(len(list(a.ancestors())) == len(list(b.ancestors()))), float(path(a) == path(b))]
    keys = set(b.attrs)
    signs.append(len(keys & set(a.attrs)) / len(keys | set(a.attrs)) if keys else 0.0)
    if keys:
        signs.append(sum(a.attrs.get(k) == v for k, v in b.attrs.items()) / len(keys))
    if text:
        import difflib

        signs.append(difflib.SequenceMatcher(None, b.text(), a.text()).ratio())
    return round(sum(signs) / len(signs), 2)


def similar(root: Node, prototype: Node, threshold: float = 0.2, text: bool = False) -> list[Node]:
    """Elements of the prototype's kind that resemble it by depth, path, attributes and, if asked, text."""
    return [n for n in root.nodes() if n is not prototype and n.tag == prototype.tag and _likeness(n, prototype, text) >= threshold]


def relocate(root: Node, tag: str, text: str, attrs: dict[str, str], least: float = 0.6) -> Node | None:
    """The element that most likely is the one once seen with this tag, text and these attributes."""
    import difflib

    best, score = None, least
    for n in root.nodes():
        s = difflib.SequenceMatcher(None, n.text(), text).ratio() + 0.1 * (n.tag == tag) + 0.05 * sum(n.attrs.get(k) == v for k, v in attrs.items())
        if s > score:
            best, score = n, s
    return best


_PATH_STEP = re.compile(r"(//|/)(\.\.|\.|\*|text\(\)|[\w-]+|@[\w-]+)((?:\[[^\]]*\])*)")
_PATH_TEST = re.compile(r"@([\w-]+)(?:\s*=\s*(['\"])(.*?)\2)?|(contains|starts-with)\(\s*(?:@([\w-]+)|text\(\)|\.)\s*,\s*(['\"])(.*?)\6\s*\)|(\d+)|last\(\)|(text\(\)|\.)\s*=\s*(['\"])(.*?)\10")


def xpath(root: Node, path: str) -> list:
    """Nodes, or texts where the path ends in an attribute or text(), of a path of child and descendant steps.

    Steps are names, *, ., .., @name and text(), with tests of attributes, texts, contains,
    starts-with and places. A path outside this raises ValueError. Relative paths start at ``root``.
    """
    path = path.strip()
    path = path[1:] if path.startswith(".") else path if path.startswith("/") else "/" + path
    steps, at = [], 0
    while at < len(path):
        m = _PATH_STEP.match(path, at)
        if not m:
            raise ValueError(f"path not understood: {path}")
        steps.append((m[1] == "//", m[2], re.findall(r"\[([^\]]*)\]", m[3])))
        at = m.end()
    held: list = [root]
    for deep, name, tests in steps:
        got: dict[int, object] = {}
        texts: list[str] = []
        for n in held:
            bases = [n, *n.nodes()] if deep else [n]
            for b in bases:
                if name.startswith("@"):
                    texts += [b.attrs[name[1:]]] if name[1:] in b.attrs else []
                elif name == "text()":
                    texts += [c for c in b.children if isinstance(c, str) and c.strip()]
                else:
                    kin = [b] if name == "." else [b.parent] if name == ".." and b.parent else [c for c in b.elements() if name in ("*", c.tag)] if name != ".." else []
                    for t in tests:
                        kin = _filtered(kin, t)
                    got.update((id(k), k) for k in kin)
        if name.startswith("@") or name == "text()":
            return texts
        held = list(got.values())
    order = {id(n): i for i, n in enumerate([root, *root.nodes()])}
    return sorted(held, key=lambda n: order.get(id(n), -1))


def _filtered(kin: list[Node], test: str) -> list[Node]:
    m = _PATH_TEST.fullmatch(test.strip())
    if not m:
        raise ValueError(f"test not understood: {test}")
    if m[8]:
        return kin[int(m[8]) - 1 : int(m[8])]
    if test.strip() == "last()":
        return kin[-1:]
    if m[1]:
        return [k for k in kin if m[1] in k.attrs and (m[2] is None or k.attrs[m[1]] == m[3])]
    if m[4]:
        value = lambda k: k.attrs.get(m[5], "") if m[5] else k.text()
        return [k for k in kin if (m[7] in value(k) if m[4] == "contains" else value(k).startswith(m[7]))]
    return [k for k in kin if k.text() == m[11]]


def xpath_of(n: Node) -> str:
    """A path that finds the node: from the nearest id down, by place among its kind."""
    parts = []
    while n.tag != "#root":
        if n.attrs.get("id") and re.fullmatch(r"[\w-]+", n.attrs["id"]):
            return "/".join(['//*[@id="' + n.attrs["id"] + '"]', *reversed(parts)])
        kin = [k for k in (n.parent.elements() if n.parent else [n]) if k.tag == n.tag]
        parts.append(n.tag if len(kin) == 1 else f"{n.tag}[{next(i for i, k in enumerate(kin, 1) if k is n)}]")
        n = n.parent
    return "/" + "/".join(reversed(parts))


# Other names that a schema's keys go by, and the kinds of fields.
_SCHEMA_NAMES = {"base_selector": "baseSelector", "base": "baseSelector", "css": "selector", "attr": "attribute", "regex": "pattern", "key": "name"}
_KINDS = ("text", "attribute", "html", "regex", "nested", "nested_list", "list")
_FORBIDDEN_KEYS = ("expression", "function", "code", "eval", "script")


def checked_schema(schema: dict, depth: int = 0) -> dict:
    """A schema with its keys under their own names; ValueError for one that can't be used, and for keys that carry code."""
    if not isinstance(schema, dict) or depth > 8:
        raise ValueError("a schema is an object, nested at most eight deep")
    out = {_SCHEMA_NAMES.get(k, k): v for k, v in schema.items()}
    if bad := sorted(set(out) & set(_FORBIDDEN_KEYS)):
        raise ValueError(f"keys that carry code are not allowed: {bad}")
    fields = out.get("fields", [])
    if not isinstance(fields, list) or (depth == 0 and not fields):
        raise ValueError("fields must be a list, and not an empty one")
    names = set()
    checked = []
    for f in fields:
        f = checked_schema(f, depth + 1)
        kind = f.setdefault("type", "text")
        if not isinstance(f.get("name"), str) or not f["name"] or f["name"] in names:
            raise ValueError("every field needs a name of its own")
        if kind not in _KINDS:
            raise ValueError(f"unknown type {kind!r} of {f['name']}")
        if kind == "attribute" and not f.get("attribute"):
            raise ValueError(f"{f['name']} names no attribute")
        if f.get("pattern"):
            try:
                re.compile(f["pattern"])
            except re.error as e:
                raise ValueError(f"pattern of {f['name']}: {e}") from None
        names.add(f["name"])
        checked.append(f)
    if fields:
        out["fields"] = checked
    return out


def narrowed(root: Node, selector: str, most_nodes: int = 100, node_chars: int = 100_000, all_chars: int = 500_000) -> list[str]:
    """Markup of the nodes that a selector finds; the numbers bound what one request may return."""
    out, total = [], 0
    for n in select(root, selector)[:most_nodes]:
        markup = to_html(n)[:node_chars]
        if total + len(markup) > all_chars:
            break
        out.append(markup)
        total += len(markup)
    return out


_RAW = frozenset(("script", "style", "pre", "textarea"))


def minified(root: Node) -> str:
    """Markup with blanks collapsed outside of raw text, and blank texts left out."""
    todo = [(root, False)]
    while todo:
        n, raw = todo.pop()
        raw = raw or n.tag in _RAW
        if not raw:
            n.children = [re.sub(r"\s+", " ", c) if isinstance(c, str) else c for c in n.children if not isinstance(c, str) or c.strip()]
        todo += [(c, raw) for c in n.elements()]
    return "".join(to_html(c) if isinstance(c, Node) else c for c in root.children).strip()


def cleaned(html: str, base: str = "") -> dict:
    """{title, body, links, images, data} of a page: its minified body, absolute addresses and what its scripts carry."""
    root = parse(html)
    data = script_data(root)
    hrefs = [urljoin(base, n.attrs["href"]) if base else n.attrs["href"] for n in root.nodes() if n.tag == "a" and n.attrs.get("href")]
    sources = [n.attrs["src"] if n.attrs["src"].startswith("http") or not base else urljoin(base, n.attrs["src"]) for n in root.nodes() if n.tag == "img" and n.attrs.get("src")]
    body = next((n for n in root.nodes() if n.tag == "body"), root)
    own = body if body is root else _wrapped(body)
    return {"title": title(root), "body": minified(own), "links": hrefs, "images": sources, "data": data}


def _wrapped(n: Node) -> Node:
    top = Node("#root", {}, None)
    top.children.append(n)
    return top


def absolute_links(text: str, base: str) -> str:
    """Markdown whose relative link targets are made absolute."""
    keep = ("http://", "https://", "mailto:", "#", "data:", "javascript:")
    return re.sub(r"(!?\[[^\n\]]*\]\()([^)\n]+)\)", lambda m: f"{m[1]}{m[2].strip() if m[2].strip().startswith(keep) else urljoin(base, m[2].strip())})", text)


def surviving_references(text: str, root: Node, base: str) -> str:
    """References of anchors whose words still stand in a text while their targets are gone, numbered in order."""
    numbers: dict[str, int] = {}
    for n in root.nodes():
        href, label = (n.attrs.get("href", "").strip(), n.text().strip()) if n.tag == "a" else ("", "")
        if len(label) < 2 or not href or label not in text:
            continue
        if not href.startswith(("http://", "https://")):
            if not base or href.startswith(("mailto:", "#", "javascript:")):
                continue
            href = urljoin(base, href)
        numbers.setdefault(href, len(numbers) + 1)
    return "\n\n## References\n\n" + "".join(f"⟨{k}⟩ {u}\n" for u, k in numbers.items()) if numbers else ""


def bare_text(html: str) -> str:
    """Text of a piece of markup, its parts set apart by one blank."""
    return " ".join(" ".join(c.strip() for c in _texts(parse(html))).split())


def _texts(root: Node) -> list[str]:
    out, todo = [], list(reversed(root.children))
    while todo:
        c = todo.pop()
        if isinstance(c, str):
            out.append(c)
        elif c.tag not in ("script", "style"):
            todo += reversed(c.children)
    return [x for x in out if x.strip()]


def pretty_json(text: str) -> str:
    """A JSON text with one value a line; other texts trimmed."""
    try:
        return json.dumps(json.loads(text), indent=1, ensure_ascii=False)
    except ValueError:
        return text.strip()


def reply_records(reply: str, fields: dict[str, str]) -> list[dict] | None:
    """Records of a model's reply: JSON, in a fence or among other words; None where there is none that fits.

    ``fields`` gives each field's type; fields of type list must be lists, other types aren't checked.
    """
    fence = re.search(r"```(?:json)?\s*\n(.*?)```", reply, re.S)
    body = fence[1] if fence else reply
    found = None
    for m in re.finditer(r"[\[{]", body):
        try:
            found, _ = json.JSONDecoder().raw_decode(body, m.start())
            break
        except ValueError:
            continue
    rows = found if isinstance(found, list) else [found] if isinstance(found, dict) else None
    if rows is None or not all(isinstance(r, dict) for r in rows):
        return None
    if any(kind == "list" and not isinstance(r.get(name, []), list) for r in rows for name, kind in fields.items()):
        return None
    return [{name: r.get(name) for name in fields} for r in rows]

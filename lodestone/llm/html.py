"""Main text of web pages (operator 9): composite text density.

For every node of the page's tree: characters per tag, adjusted for links as in the published composite text density, but
divided by ``ln(...)`` where that takes a logarithm to the base ``ln(...)``: the base is 1, and the density without a value, on a
page without links.
The density sum of a node adds those of its children. The path from the body to the densest leaf region gives the
threshold: its least density. Among the nodes that reach the threshold the one with the largest density sum is the main
content; without an article or main element around it, so are the largest of the others, one for each section of the text.
Boilerplate (navigation, forms, adverts, comments and the like) is cut from the tree before densities are taken.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import over_text, take, texts_of

VOID = frozenset("area base br col embed hr img input link meta param source track wbr keygen command".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
CUT = frozenset("head script style noscript iframe template nav header footer aside button select textarea input svg canvas object embed menu dialog title xmp noembed noframes audio video map".split())
#: Words of class, id and role that name what is not the article.
CUT_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising advertorial adsense banner banners sponsor sponsored sponsors promo promos promotion promoted sidebar sidebars rail nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager footer foot header masthead topbar "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup comment comments disqus reply replies respond share sharing social related recommended recommendations widget widgets complementary contentinfo toolbar search skip outbrain taboola login copyright disclaimer".split()
)
KEEP = frozenset("html body article main".split())
#: An attribute: a name, and after an equals sign a value in quotes or one up to white space, in which quotes are characters.
NAME, VALUE = r"[^\s/>=]++", r"\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^\s>\"'][^\s>]*+"
TAG = re.compile(rf"<(?:!--.*?(?:-->|\Z)|!\[CDATA\[.*?(?:\]\]>|\Z)|[!?][^>]*(?:>|\Z)|(/?)([A-Za-z][^\s/>]*+)((?:[\s/=]++|{NAME}(?:\s*+=\s*+(?:{VALUE})?+)?+)*+)(?:>|\Z))", re.S)
ATTRIBUTE = re.compile(rf"({NAME})(?:\s*+=\s*+({VALUE})?+)?+")
SPACES = re.compile(r"[ \t\n\r\f\v\xa0]+")
LEADING = re.compile(r"[^a-z]*([a-z]+)(.*)", re.S)
#: Why a node is cut: for certain, by a whole name of its class, id or role, by the leading word of such a name, or as a form.
CERTAIN, NAMED, LED, FORM = 1, 2, 3, 4
#: Shares of the page's text outside links from which a name, or being a form, does not cut.
SPARED = {NAMED: 0.9, LED: 0.5, FORM: 0.5}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Open elements that a start tag closes.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"}, "body": {"head"}}
STOP = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}, "tbody": {"table"}, "tfoot": {"table"}, "body": {"html"}}


class Node:
    __slots__ = ("name", "kids", "parent", "link", "chars", "tags", "link_chars", "link_tags", "density", "total", "cut")

    def __init__(self, name: str, parent: Node | None, cut: int = 0):
        self.name, self.parent, self.kids, self.cut = name, parent, [], cut
        self.link = name == "a"
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def _boilerplate(name: str, attributes: str) -> int:
    """Why a node is no part of the article: 0, ``CERTAIN``, ``NAMED``, ``LED`` or ``FORM``."""
    if name in CUT:
        return CERTAIN
    out = FORM if name == "form" else 0
    if not attributes or name in KEEP:
        return out
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and "display:none" in value.replace(" ", ""):
            return CERTAIN
        if key in ("class", "id", "role"):
            for word in value.split():
                led = LEADING.match(word)
                if led and led[1] in CUT_WORDS and out not in (NAMED, FORM):
                    out = LED if led[2] else NAMED
    return out


def _spare(root: Node) -> None:
    """Keep what is cut by a name alone, or as a form, but holds so much of the page's text outside links that it is the article's wrapper."""
    nodes, i, named = [root], 0, False
    while i < len(nodes):
        named |= nodes[i].cut > CERTAIN
        nodes.extend(k for k in nodes[i].kids if k.__class__ is Node and k.cut != CERTAIN)
        i += 1
    if not named:
        return
    held: dict[Node, int] = {}
    for x in reversed(nodes):
        held[x] = 0 if x.link else sum(held.get(k, 0) if k.__class__ is Node else len(k.strip()) for k in x.kids)
    for x in nodes:
        if x.cut > CERTAIN and held[x] and held[x] >= SPARED[x.cut] * held[root]:
            x.cut = 0


class Open:
    """The open elements: a stack, with the places of each name and of blocks, so that no tag walks up the stack."""

    def __init__(self, root: Node):
        self.stack, self.names, self.blocks = [root], {}, []

    def last(self, name: str) -> int:
        """Place of the innermost open element of that name; 0 is none."""
        at = self.names.get(name)
        return at[-1] if at else 0

    def push(self, node: Node) -> None:
        at = len(self.stack)
        self.stack.append(node)
        self.names.setdefault(node.name, []).append(at)
        if node.name in BLOCKS:
            self.blocks.append(at)

    def close(self, at: int) -> None:
        """Close the element at that place and all inside it."""
        while len(self.stack) > at:
            name = self.stack.pop().name
            self.names[name].pop()
            if name in BLOCKS:
                self.blocks.pop()

    def outermost(self, names: set[str], stop: int) -> int:
        """Place of the outermost open element of those names inside ``stop``; 0 is none."""
        found = 0
        for name in names:
            at = self.names.get(name)
            if at and at[-1] > stop:
                first = at[bisect_right(at, stop)]
                found = min(found or first, first)
        return found


def parse(page: str) -> Node:
    """The tree of a page, forgiving as browsers are: implied ends, stray ends, and an end at the end of the text."""
    root = Node("#root", None)
    up = Open(root)
    at, n = 0, len(page)
    while at < n:
        m = TAG.search(page, at)
        if m is None:
            up.stack[-1].kids.append(page[at:])
            break
        if m.start() > at:
            up.stack[-1].kids.append(page[at : m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            if page.startswith("<![CDATA[", m.start()):
                up.stack[-1].kids.append(page[m.start() + 9 : at].removesuffix("]]>").replace("&", "&amp;"))
            continue
        name = name.lower()
        if m[1]:
            if name == "br":
                up.stack[-1].kids.append(" ")
                continue
            place = up.last(name)
            if place and (name in BLOCKS or place >= max(map(up.last, ("article", "td", "body")))):
                up.close(place)
            continue
        if name in BLOCKS and up.blocks and up.stack[up.blocks[-1]].name == "p":  # a block ends an open paragraph
            up.close(up.blocks[-1])
        if name in CLOSES:
            place = up.outermost(CLOSES[name], max(map(up.last, STOP[name])))
            if place:
                up.close(place)
        node = Node(name, up.stack[-1], _boilerplate(name, m[3]))
        up.stack[-1].kids.append(node)
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\s*(?=[\s/>])", re.I).search(page, at)
            node.kids.append(page[at : end.start() if end else n])
            at = end.start() if end else n
            up.push(node)
        elif name not in VOID and not m[3].rstrip().endswith("/"):
            up.push(node)
    return root


def _nodes(root: Node) -> list[Node]:
    """All nodes that are not cut, parents first."""
    out, i = [root], 0
    while i < len(out):
        out.extend(k for k in out[i].kids if k.__class__ is Node and not k.cut)
        i += 1
    return out


def _widened(found: Node) -> Node:
    """The block that holds a node, or what holds the paragraph, list or table that it is."""
    while found.name not in BLOCKS and found.parent is not None:
        found = found.parent
    if found.name in ("p", "li", "td", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "dl", "dt", "dd", "blockquote", "table", "tbody", "pre", "figure") and found.parent is not None:
        wide = found.parent
        while wide.name in ("li", "td", "tr", "ul", "ol", "dl", "dd", "blockquote", "table", "tbody", "figure") and wide.parent is not None:
            wide = wide.parent
        found = wide
    return found


def measure(root: Node) -> Node:
    """Set the characters, tags, density and density sum of every node that is not cut; returns the body."""
    nodes = _nodes(root)
    for x in reversed(nodes):
        for k in x.kids:
            if k.__class__ is Node:
                if not k.cut:
                    x.chars, x.tags, x.link_chars, x.link_tags = x.chars + k.chars, x.tags + k.tags + 1, x.link_chars + k.link_chars, x.link_tags + k.link_tags + k.link
            else:
                x.chars += len(k.strip())
        if x.link:
            x.link_chars = x.chars
    body = next((x for x in nodes if x.name == "body"), root)
    share = body.link_chars / max(1, body.chars)
    for x in reversed(nodes):
        c, t, lc, lt = x.chars, max(1, x.tags), x.link_chars, x.link_tags
        if c:
            base = math.log(c / max(1, c - lc) * lc + share * c + math.e)
            # divided by the logarithm itself: it is 1 without links, where as a base it would be none
            x.density = c / t * max(0.0, math.log(c / max(1, lc) * (t / max(1, lt)))) / base
        below = [k.density for k in x.kids if k.__class__ is Node and not k.cut]
        x.total = sum(below) if below else x.density
    return body


def main_nodes(root: Node) -> list[Node]:
    """The subtrees that composite text density takes for the article, in page order, none inside another."""
    _spare(root)
    body = measure(root)
    inside = _nodes(body)
    densest = max(inside, key=lambda x: x.total)
    threshold, up = math.inf, densest
    while up is not None:
        threshold = min(threshold, up.density)
        if up is body:
            break
        up = up.parent
    found = max((x for x in inside if x.density >= threshold), key=lambda x: x.total, default=body)
    # the sum is largest at the direct parent of the text blocks; headings beside it belong to the same article
    up = found
    while up is not None and up is not body:
        if up.name in ("article", "main"):
            return [up]
        up = up.parent
    # text in several sections has a maximum in each: the largest first, then each that neither holds nor is inside another
    parts, settled = [], set()
    passed = [x for x in inside if x.name in BLOCKS and x.density >= threshold and x.density > 0]
    for x in [found, *sorted(passed, key=lambda x: -x.total)]:
        if x in settled:
            continue
        wide = _widened(x)
        if wide in settled or x is not found and wide.density < threshold:
            continue
        parts.append(wide)
        settled.update(_nodes(wide))
        up = wide.parent
        while up is not None and up not in settled:
            settled.add(up)
            up = up.parent
    if len(parts) == 1:
        return parts
    # headings beside the parts belong to the article
    chosen, out, held = set(parts), [], []
    stack: list = [body]
    while stack:
        x = stack.pop()
        if x in chosen:
            out += [*held, x]
            held = []
        elif x.name in HEADINGS:
            held.append(x)
        else:
            stack.extend(k for k in reversed(x.kids) if k.__class__ is Node and not k.cut)
    return out


def blocks_of(node: Node) -> list[str]:
    """Text of each block under a node in page order, references decoded and white space made single."""
    out: list[str] = []
    run: list[str] = []

    def close() -> None:
        if run:
            text = SPACES.sub(" ", unescape("".join(run))).strip()
            if text:
                out.append(text)
            run.clear()

    stack: list = [node]
    while stack:
        x = stack.pop()
        if x is None:
            close()
        elif x.__class__ is str:
            run.append(x)
        elif not x.cut or x is node:
            if x.name == "br":
                run.append(" ")
            elif x.name in BLOCKS:
                close()
                stack.append(None)
                stack.extend(reversed(x.kids))
            else:
                stack.extend(reversed(x.kids))
    close()
    return out


def extract(page: str) -> str:
    """The main text of a page; empty if it has none."""
    if not page.strip():
        return ""
    return "\n".join(block for node in main_nodes(parse(page)) for block in blocks_of(node))


def main_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of every page, from the whole html.

    Null and empty html give an empty text; repeated rows give repeated results; an empty table gives no rows; null
    ids and urls stay; other columns are not read. No shuffle.
    """
    d = take(pages, "page_id", "url", html_col)

    def run(batch: pa.RecordBatch) -> dict:
        texts = [extract(t) for t in texts_of(batch, html_col)]
        return {"page_id": batch.column(0), "url": batch.column(1), "text": texts, "n_chars": [len(t) for t in texts]}

    return over_text(d, html_col, f"page_id {d.dtypes[0][1]}, url string, text string, n_chars bigint", run)

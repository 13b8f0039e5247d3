"""Main text of web pages by scoring the tree.

Each paragraph passes points to its ancestors: one, one for each comma, and one
for every hundred characters up to three; the parent takes them whole, the
grandparent half, and further ancestors a share that falls with the distance. A
container's points are discounted by its share of link text. The best container is
kept with its siblings: those with a fair share of its points, those that are or
hold paragraphs with hardly any links, and other articles beside it. If the best
container lies in an article or main element, that element takes its place.

What can be no article text (scripts, styles, hidden elements) never enters the
tree. Menus, headers, footers, asides, notices, adverts, forms and reader comments,
told by their tags, roles and the tokens of class and id, do, but keep their points
to themselves and are left out. Page layouts use some of these names for wrappers
(a form around the page, "content-sidebar"): a wrapper of such a name that holds over
three quarters of the points that are not left out anyway, with no article outside, is taken
as a plain container. Adverts, notices, menus, footers and comments are never taken back.

Inside the container nothing is dropped: every block's text counts, white space
becomes one space, character references are decoded, blocks are joined by two line
feeds in page order.

The tokenizer is one scan from left to right, and open elements are counted by name,
so time is in proportion to the page, however broken it is. As in browsers, "<" and a
letter begin a tag up to its ">" ("if a <b and c> d" holds a tag); a quote that never
closes ends with its tag; a last tag without an end is dropped.

Defined cases: null, empty and text-free pages give an empty string; plain text
without any tag is one block. Pages are independent rows; a page's tree is the only
thing held, and grows with the page alone.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
GAP = re.compile(r"[\s/]*+")
ATTRIBUTE = re.compile(r"([^\s/>=]++)(?:\s*+=\s*+(\"[^\"]*\"|'[^']*'|[^\s>]*+))?")
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in ("script", "style", "textarea", "title", "iframe", "noscript", "noembed", "noframes", "xmp")}
#: Never article text.
NEVER = {"head", "button", "select", "template", "svg", "math", "object", "canvas", "audio", "video", *RAW_END}
ASIDE = {"nav", "header", "footer", "aside", "form", "dialog", "menu"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCKS = {"address", "article", "blockquote", "body", "caption", "center", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption", "figure", "h1", "h2", "h3", "h4", "h5", "h6", "html", "li", "main", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "head"} | ASIDE
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
PARAGRAPHS = {"p", "pre", "li", "td", "dd", "dt", "blockquote"} | HEADINGS
KEEPS_P = {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "html", "body", "head"}
#: What an open element of a name closes when the next one begins, and what shields it.
PEERS = {"li": (("li",), "list"), "dt": (("dt", "dd"), "dl"), "dd": (("dt", "dd"), "dl"), "tr": (("td", "th", "tr"), "table"), "td": (("td", "th"), "row"), "th": (("td", "th"), "row"), "tbody": (("td", "th", "tr", "tbody", "thead", "tfoot"), "table"), "thead": (("td", "th", "tr", "tbody", "thead", "tfoot"), "table"), "tfoot": (("td", "th", "tr", "tbody", "thead", "tfoot"), "table")}
SHIELDS = {
    "scope": {"table", "td", "th", "caption", "template", "object", "button"},
    "list": {"ul", "ol", "menu", "table", "td", "th"},
    "dl": {"dl", "table", "td", "th"},
    "table": {"table"},
    "row": {"tr", "table"},
}
SHIELDED_BY = defaultdict(tuple, {t: tuple(k for k, ts in SHIELDS.items() if t in ts) for ts in SHIELDS.values() for t in ts})

# Names in class and id, fixed values.
COMMENTS = {"comment", "comments", "commentlist", "disqus", "respond", "replies"}
FIRM = {"ad", "ads", "adslot", "adsense", "adsbygoogle", "banner", "promo", "promotion", "cookie", "cookies", "consent", "gdpr", "popup", "modal", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "masthead", "footer", "sharing", "social", "newsletter", "subscribe", "signup", "login", "pagination", "pager", "sponsor", "sponsored", "advert", "adverts", "advertisement", "advertising", *COMMENTS}
LOOSE = {"notice", "notices", "alert", "overlay", "foot", "copyright", "skip"}
LAYOUT = {"sidebar", "sidebars", "side", "aside", "header", "search", "widget", "widgets", "tags", "related", "recommended", "toolbar", "share"}
TOPICS = {"banner", "promo", "promotion", "cookie", "cookies", "consent", "gdpr", "menu", "navigation", "sharing", "social", "newsletter", "subscribe", "signup", "login", "sponsor", "advertising"}
PIECES = {"area", "bar", "block", "body", "bottom", "box", "btn", "button", "buttons", "container", "content", "footer", "form", "head", "header", "icons", "inner", "item", "items", "label", "left", "link", "links", "list", "media", "message", "modal", "notice", "outer", "overlay", "panel", "policy", "popup", "prompt", "right", "section", "slot", "text", "toggle", "top", "unit", "widget", "wrap", "wrapper"} | FIRM
NOT_SO = {"has", "no", "not", "with", "without", "is", "non"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu", "menubar"}
SENTENCE = re.compile(r"[.!?…。！？]['\"”’)]*(\s|$)")
HUMP = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
#: Two words in one: a name and a piece of a page.
JOINED = re.compile(r"(ad|ads|banner|promo|cookie|consent|popup|menu|newsletter|signup|login|sponsor|comment|comments)(bar|block|box|container|form|item|items|links|list|notice|panel|section|slot|unit|widget|wrap|wrapper)$")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

IN, OUT, WRAPPER, LOST = 0, 1, 2, 3  # plain; left out; left out unless it wraps the page; never in the tree


class Node:
    __slots__ = ("tag", "parent", "kids", "points", "raw", "text", "linked", "place", "headed")

    def __init__(self, tag: str, parent: Node | None, place: int = IN):
        self.tag, self.parent, self.place = tag, parent, place
        self.kids: list[Node | tuple[str, bool]] = []  # elements, or (text, is it link text)
        self.points, self.raw, self.text, self.linked, self.headed = 0.0, 0.0, 0, 0, False


def _named(value: str, tag: str) -> int:
    """What the tokens of a class or id say of an element.

    A token is cut at hyphens, underscores and capitals. A word of ``TOPICS`` that begins
    a longer token may be what the text is about ("social-science", "login-guide"): there
    it counts only before a word of ``PIECES`` ("social-links", "login-form").
    """
    out = IN
    for token in value.split():
        parts = [x for x in HUMP.sub("-", token).lower().replace("_", "-").split("-") if x]
        if not parts or NOT_SO & set(parts):
            continue
        if len(parts) == 1 and (m := JOINED.match(parts[0])):
            parts = list(m.groups())
        first, last = parts[0], parts[-1]
        if tag in ("article", "main"):
            if first in COMMENTS and first != "respond":
                return OUT
        elif last in FIRM and (len(parts) == 1 or tag not in PARAGRAPHS):
            return OUT
        elif first in FIRM and (first not in TOPICS or PIECES & set(parts[1:])):
            return OUT
        elif tag not in PARAGRAPHS and len(parts) <= 2:
            if last in LOOSE:
                return OUT
            if last in LAYOUT and (last != "side" or len(parts) == 1):
                out = WRAPPER
    return out


def _place(tag: str, attributes: list[tuple[str, str]]) -> int:
    if tag in NEVER:
        return LOST
    out = {"nav": OUT, "footer": OUT, "dialog": OUT, "menu": OUT, "aside": OUT, "header": WRAPPER, "form": WRAPPER}.get(tag, IN)
    for name, value in attributes:
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and HIDDEN.search(value):
            return LOST
        if tag in ("html", "body"):
            continue
        if name in ("class", "id"):
            now = _named(value, tag)
            out = OUT if OUT in (now, out) else max(now, out)
        elif name == "role" and value.lower() in ROLES and tag not in ("article", "main"):
            out = OUT if value.lower() != "form" else max(out, WRAPPER)
    return out


class _Open:
    """The open elements, found by name or by what shields them without a search."""

    def __init__(self):
        self.stack: list[list] = []  # [tag, place, node or None, ended early]
        self.of: dict[str, list[int]] = defaultdict(list)

    def push(self, tag: str, place: int, node: Node | None) -> None:
        at = len(self.stack)
        self.stack.append([tag, place, node, False])
        self.of[tag].append(at)
        for k in SHIELDED_BY[tag]:
            self.of["#" + k].append(at)
        if tag in BLOCKS:
            self.of["#block"].append(at)

    def pop(self) -> list:
        e = self.stack.pop()
        self.of[e[0]].pop()
        for k in SHIELDED_BY[e[0]]:
            self.of["#" + k].pop()
        if e[0] in BLOCKS:
            self.of["#block"].pop()
        return e

    def last(self, name: str) -> int:
        at = self.of.get(name)
        return at[-1] if at else -1


def parse(html: str) -> Node:
    """The tree of block elements; inline elements only mark link text, or are left out."""
    root = Node("html", None)
    here, lost, links = root, 0, 0  # lost: how many open elements keep text out of the tree
    opened, n = _Open(), len(html)

    def ended(e: list) -> None:
        nonlocal here, lost, links
        if not e[3]:
            lost -= e[1] == LOST or e[1] and not e[2]
            links -= e[0] == "a"
        if e[2] is not None and e[2] is not root:
            here = e[2].parent

    def close(at: int) -> None:
        while len(opened.stack) > at:
            ended(opened.pop())

    def text(a: int, b: int) -> None:
        if b > a and not lost:
            here.kids.append((html[a:b], links > 0))

    at = pos = 0
    while True:
        at = html.find("<", at)
        if at < 0 or at + 1 >= n:
            break
        m = TAG.match(html, at)
        if m is None:
            c = html[at + 1]
            if c not in "!?/":
                at += 1
                continue
            text(pos, at)
            if html.startswith("<!--", at):
                e = html.find("-->", at + 2)
                pos = at = e + 3 if e >= 0 else n
            else:
                e = html.find(">", at)
                pos = at = e + 1 if e >= 0 else n
            continue
        text(pos, at)
        tag, p = m[2].lower(), m.end()
        found: list[tuple[str, str]] = []
        if p < n and html[p] != ">":
            while (p := GAP.match(html, p).end()) < n and html[p] != ">":
                a = ATTRIBUTE.match(html, p)
                if a is None:
                    p += 1
                    continue
                p = a.end()
                name = a[1].lower()
                if name in ("class", "id", "role", "style", "hidden", "aria-hidden"):
                    found.append((name, unescape((a[2] or "").strip("\"'"))))
        if p >= n:
            pos = at = n
            break
        pos = at = p + 1
        if m[1]:
            k = opened.last(tag)
            if k < 0:
                continue
            if tag in BLOCKS:
                if tag in ("table", "td", "th", "tr", "tbody", "thead", "tfoot", "caption") or k > opened.last("#scope"):
                    close(k)
            elif k > opened.last("#block"):
                close(k)
            else:  # an inline element that reaches into blocks ends, they stay open
                e = opened.stack[k]
                if not e[3]:
                    lost -= e[1] == LOST or e[1] and not e[2]
                    links -= tag == "a"
                    e[3] = True
            continue
        if tag in RAW_END:
            e = RAW_END[tag].search(html, at)
            close_at = html.find(">", e.end()) if e else -1
            pos = at = close_at + 1 if close_at >= 0 else n
            continue
        if tag == "br":
            if not lost:
                here.kids.append((" ", links > 0))
            continue
        if tag == "a" and (k := opened.last("a")) > opened.last("#block"):
            close(k)  # links do not nest
        if tag in BLOCKS or tag == "hr":
            if tag not in KEEPS_P and (k := opened.last("p")) > opened.last("#scope"):
                close(k)
            if tag in PEERS:
                names, shield = PEERS[tag]
                k = min((k for x in names if (k := opened.last(x)) > opened.last("#" + shield)), default=-1)
                if k >= 0:
                    close(k)
        if tag == "hr" and not lost:
            here.kids.append(Node("hr", here))
        if tag in VOID:
            continue
        if html[p - 1] == "/" and tag not in BLOCKS and tag != "a":
            continue  # closes itself
        place = _place(tag, found)
        node = None
        if tag in BLOCKS and not lost and place != LOST:
            node = Node(tag, here, place)
            here.kids.append(node)
            here = node
        if place == LOST or place and node is None:
            lost += 1
        links += tag == "a"
        opened.push(tag, place, node)
    text(pos, n)
    return root


def blocks(node: Node) -> list[str]:
    """Texts of the blocks under a node in page order: runs of text between block boundaries."""
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        text = " ".join(unescape("".join(run)).split())
        run.clear()
        if text:
            out.append(text)

    todo: list[Node | tuple[str, bool] | None] = [node]
    while todo:
        x = todo.pop()
        if x is None:
            flush()
        elif isinstance(x, tuple):
            run.append(x[0])
        else:
            flush()
            if x.place == IN or x is node:
                todo.append(None)
                todo.extend(reversed(x.kids))
    flush()
    return out


def _ordered(root: Node) -> list[Node]:
    """All nodes, parents first."""
    nodes, todo = [], [root]
    while todo:
        x = todo.pop()
        nodes.append(x)
        todo += [k for k in x.kids if isinstance(k, Node)]
    return nodes


def _own(node: Node) -> tuple[int, int, float]:
    """Characters, linked characters and points of the text right in a node."""
    size = linked = commas = 0
    for k in node.kids:
        if isinstance(k, tuple):
            n = len(k[0].strip())
            size += n
            linked += n * k[1]
            commas += k[0].count(",") + k[0].count("،") + k[0].count("、")
    points = 1.0 + commas + min(size // 100, 3) if size else 0.0
    return size, linked, points if size >= 25 else points / 4


def settle(root: Node) -> None:
    """Decide which of the wrappers are plain containers after all."""
    nodes = _ordered(root)
    inside = dict.fromkeys(map(id, nodes), 0)  # articles with text under each node
    for x in reversed(nodes):
        size, linked, points = _own(x)
        x.text, x.linked, x.raw = x.text + size, x.linked + linked, x.raw + points
        x.headed |= x.tag in HEADINGS
        inside[id(x)] += x.tag in ("article", "main") and x.text > 0 and x.place == IN
        if x.parent is not None and x.place != OUT:
            up = x.parent
            up.text, up.linked, up.raw, up.headed = up.text + x.text, up.linked + x.linked, up.raw + x.raw, up.headed or x.headed
            inside[id(up)] += inside[id(x)]
    within = {id(root): False}
    for x in nodes:
        if x.parent is not None:
            within[id(x)] = within[id(x.parent)] or x.parent.tag in ("article", "main")
        if x.place != WRAPPER:
            continue
        if x.tag == "header" and within[id(x)]:
            x.place = IN if x.headed else OUT  # an article's own headline
        elif 4 * x.raw > 3 * root.raw and 2 * x.linked < x.text and inside[id(root)] == inside[id(x)]:
            x.place = IN
        else:
            x.place = OUT


def score(root: Node) -> list[Node]:
    """The nodes that are not left out, with points passed to ancestors and text lengths summed up."""
    nodes, todo = [], [root]
    while todo:
        x = todo.pop()
        x.points, x.text, x.linked = 0.0, 0, 0
        nodes.append(x)
        todo += [k for k in x.kids if isinstance(k, Node) and k.place == IN]
    for x in reversed(nodes):
        size, linked, points = _own(x)
        x.text, x.linked = x.text + size, x.linked + linked
        share, depth, up = 1.0, 1, x.parent if x.tag in PARAGRAPHS else x
        while size and up is not None and depth < 6:
            up.points += points * share
            depth += 1
            share, up = 1 / (2 * depth - 2), up.parent
        if x.parent is not None:
            x.parent.text += x.text
            x.parent.linked += x.linked
    for x in nodes:
        x.points *= 1 - x.linked / x.text if x.text else 0
    return nodes


def _has_paragraphs(node: Node) -> bool:
    todo = [node]
    while todo:
        x = todo.pop()
        if x.tag in PARAGRAPHS and x.text:
            return True
        todo += [k for k in x.kids if isinstance(k, Node) and k.place == IN]
    return False


def _has_sentence(node: Node) -> bool:
    """Does a plain container beside the article hold prose, not a label?"""
    return node.text >= 25 and any(SENTENCE.search(t) for t in blocks(node))


def main_text(html: str | None) -> str:
    if not html:
        return ""
    root = parse(html)
    settle(root)
    best = max(score(root), key=lambda x: x.points)
    if best.points <= 0:
        return "\n\n".join(blocks(root)) if root.text and root.linked < root.text else ""
    up: Node | None = best
    while up is not None and up.tag not in ("article", "main"):
        up = up.parent
    kept = up or best
    around = kept.parent
    if around is None:
        return "\n\n".join(blocks(kept))
    least = max(10.0, 0.2 * best.points)
    out: list[str] = []
    for k in around.kids:
        if k is kept:
            out += blocks(k)
        elif isinstance(k, Node) and k.place == IN and k.text:
            density = k.linked / k.text
            if k.points >= least or density < 0.25 and (_has_paragraphs(k) or _has_sentence(k)) or density < 0.5 and k.tag == "article":
                out += blocks(k)
    return "\n\n".join(out)


def extracted(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per page: page_id, url, text."""
    own = pages.select(F.col(id_col).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return own.mapInArrow(work, f"page_id {own.schema['page_id'].dataType.simpleString()}, url string, text string")

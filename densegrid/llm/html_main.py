"""Main text of web pages: gradient-boosted trees over DOM nodes and a hierarchical decoding.

A page is read into a tree of block elements (inline elements belong to the block around them). Every node has
features of its tag, its attribute tokens and those of its ancestors, its depth, the density of text and links in
its subtree, and its place among its siblings. Boosted trees give each node the log-odds of holding main text. The
decoding then keeps or drops whole nodes: a dropped node drops all that is below it, a kept node has kept ancestors,
and among all such choices it takes the one with the highest sum. So no text is kept inside a dropped part.

The trees are trained here, on the driver, on pages built from a grammar of layouts whose truth is known; ``PAGES``
bounds their number. Nothing is learned from, and nothing is left out of, the pages that are extracted.

Character references are decoded, white space inside a block becomes one blank, blocks are trimmed and joined by a
line break in page order; empty blocks are left out. Scripts, styles, comments, controls, embedded media and other
markup are never text and leave the text around them in one piece. Formulas are text; their annotations are not.
Null or empty html gives an empty text, as does a page without main text. Unclosed and misnested tags are read the
way browsers treat the common cases: a new block ends an open paragraph, a stray end tag is skipped, the first
element or text of the body ends an open head. What stands in a hidden element ends nothing outside of it. A comment
ends at ``-->`` or ``--!>``, ``<!-->`` and ``<!--->`` are whole comments; a comment, a tag or a quoted attribute that is
never closed runs to the end of the page and is no text. The time to read a page grows with its length only.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements of the HTML standard by how they take part in the tree.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd",
    "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
    "math", "maction", "menclose", "merror", "mfenced", "mfrac", "mi", "mmultiscripts", "mn", "mo", "mover", "mpadded", "mphantom",
    "mprescripts", "mroot", "mrow", "ms", "mspace", "msqrt", "mstyle", "msub", "msubsup", "msup", "mtable", "mtd", "mtext", "mtr",
    "mlabeledtr", "munder", "munderover", "none", "semantics",
}
#: ``annotation`` is a second form of a formula that stands before it, which browsers do not show.
HIDDEN = {"script", "style", "noscript", "template", "head", "title", "svg", "iframe", "object", "select", "option", "datalist",
          "button", "textarea", "canvas", "audio", "video", "map", "annotation", "annotation-xml", "noembed", "noframes"}
#: Elements whose content has no tags in it.
RAW = {"script", "style", "title", "textarea", "iframe", "noembed", "noframes"}
ENDS_PARAGRAPH = {
    "address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset", "figcaption", "figure",
    "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul",
}
SELF_ENDING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
               "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"tr", "td", "th", "thead"}, "body": {"head"}}
#: Start tags that leave an open head open; any other ends it, as does text.
IN_HEAD = {"html", "head", "title", "meta", "link", "base", "basefont", "bgsound", "style", "script", "noscript", "noframes", "template"}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}}

# Tags and attribute tokens that carry a feature of their own.
TAGS = ["article", "main", "section", "div", "p", "h1", "h2", "h3", "ul", "li", "table", "td", "blockquote", "pre", "figure", "nav",
        "header", "footer", "aside", "form", "dl", "address", "figcaption", "details", "dialog"]
TOKENS = {
    "article": "article content post entry story main body text hentry prose blog",
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs topbar toolbar pagination pager tabs toc skip",
    "header": "header masthead banner branding logo hero",
    "footer": "footer copyright colophon legal imprint",
    "side": "sidebar side aside widget rail related recommended popular trending more tags author bio",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay message warning privacy",
    "advert": "ad ads adv advert advertisement advertising sponsor sponsored promo promotion promoted banner commercial dfp adsbygoogle",
    "comment": "comment comments reply replies disqus discussion respond feedback reader",
    "form": "form newsletter subscribe subscription signup login search input field contact",
    "share": "share sharing social follow twitter facebook like buttons meta byline",
}
ROLES = {"navigation": "menu", "banner": "header", "contentinfo": "footer", "complementary": "side", "search": "form", "main": "article",
         "alert": "notice", "dialog": "notice", "form": "form", "article": "article"}


TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@cache
def _token_groups() -> dict[str, int]:
    """Mask of groups by token; roles as ``role:name``."""
    out: dict[str, int] = {}
    for i, words in enumerate(TOKENS.values()):
        for w in words.split():
            out[w] = out.get(w, 0) | 1 << i
    names = list(TOKENS)
    return out | {f"role:{role}": 1 << names.index(group) for role, group in ROLES.items()}


class Node:
    """A block element. Masks have a bit per token group: of its own tokens, with its ancestors', of its children."""

    __slots__ = ("tag", "parent", "depth", "own", "up", "below", "inside", "place", "parts", "children", "link", "hidden", "truth")

    def __init__(self, tag: str, parent: int, depth: int, own: int, up: int, inside: int, place: int, hidden: bool, truth: str | None):
        self.tag, self.parent, self.depth, self.own, self.up, self.inside = tag, parent, depth, own, up, inside
        self.place, self.hidden, self.truth, self.below, self.link = place, hidden, truth, 0, 0
        self.parts: list[tuple[int, str]] = []
        self.children: list[int] = []


# Bits of ``inside``: kinds of elements among the node and its ancestors.
INSIDE = {"article": 1, "main": 2, "nav": 4, "footer": 4, "aside": 4, "dialog": 4, "form": 8, "ul": 16, "ol": 16, "dl": 16}


class Tree:
    """Block tree of a page; ``parts`` are runs of text with the child number before which they stand.

    ``places`` has the positions of the open elements by tag, so that what an end tag or a new block closes is found
    without a walk over the open elements; ``shut`` has those of the open elements that hide their content.
    """

    def __init__(self):
        self.nodes = [Node("#root", 0, 0, 0, 0, 0, 0, False, None)]
        self.open = [0]
        self.places: dict[str, list[int]] = {}
        self.shut: list[int] = []
        self.links = self.math = 0
        self.body = False

    def _tokens(self, attrs) -> int:
        mask = 0
        known = _token_groups()
        for name, value in attrs:
            if not value:
                continue
            if name in ("class", "id"):
                for token in TOKEN.findall(value):
                    mask |= known.get(token.lower(), 0)
            elif name == "role":
                mask |= known.get("role:" + value.lower(), 0)
        return mask

    def _last(self, tags) -> int:
        """Position of the innermost open element with one of ``tags``; 0 if there is none."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def _cut(self, place: int) -> None:
        """Ends the open elements from ``place`` on."""
        while len(self.open) > place:
            tag = self.nodes[self.open.pop()].tag
            self.places[tag].pop()
            if tag in HIDDEN:
                self.shut.pop()

    def _close(self, tags: set[str], stop: set[str]) -> None:
        """Ends the innermost of ``tags`` unless an element of ``stop`` or a hidden one stands further in."""
        place = self._last(tags)
        if place and place >= max(self._last(stop), self.shut[-1] if self.shut else 0):
            self._cut(place)

    def _end_head(self) -> None:
        if self.nodes[self.open[-1]].tag == "head":
            self._cut(len(self.open) - 1)

    def start(self, tag: str, attrs: list[tuple[str, str]]) -> None:
        if tag not in IN_HEAD:
            self._end_head()
        if tag in INLINE:
            if tag == "br":
                self.text("\n")
            self.links += tag == "a"
            self.math += tag == "math"
            return
        if tag in ENDS_PARAGRAPH:
            self._close({"p"}, {"table", "td", "th", "button", "body"})
        if tag in SELF_ENDING:
            self._close(SELF_ENDING[tag], SCOPES.get(tag, set()))
        if tag == "html" or tag == "body" and self.body:
            return
        if tag in VOID:
            if tag == "hr":
                self._break()
            return
        parent = self.open[-1]
        up = self.nodes[parent]
        truth = next((v for k, v in attrs if k == "data-truth"), up.truth)
        own = self._tokens(attrs) if attrs else 0
        up.below |= own
        up.children.append(len(self.nodes))
        self.places.setdefault(tag, []).append(len(self.open))
        if tag in HIDDEN:
            self.shut.append(len(self.open))
        self.open.append(len(self.nodes))
        self.nodes.append(Node(
            tag, parent, up.depth + 1, own, up.up | own, up.inside | INSIDE.get(tag, 0), len(up.children) - 1, up.hidden or tag in HIDDEN, truth
        ))
        self.body |= tag == "body"
        self.links = self.math = 0

    def end(self, tag: str) -> None:
        if tag in INLINE:
            self.links -= tag == "a" and self.links > 0
            self.math -= tag == "math" and self.math > 0
            return
        place = self._last((tag,))
        if place:
            self._cut(place)

    def _break(self):
        """A rule ends the run of text before it; it is the only void element that is a block."""
        node = self.nodes[self.open[-1]]
        if node.parts:
            node.parts.append((-1, ""))

    def text(self, data: str) -> None:
        if data.strip():
            self._end_head()
        node = self.nodes[self.open[-1]]
        if node.hidden or not data:
            return
        node.parts.append((len(node.children), data))
        if self.links:
            node.link += len(data.strip())

    def foreign(self) -> bool:
        """Inside svg or math, where CDATA sections are text."""
        return bool(self.math or self.places.get("svg"))


# Markup, read from left to right; every character is passed a bounded number of times.
MARKUP = re.compile(r"<(?=[a-zA-Z/!?])")
NAME = re.compile(r"[^ \t\n\r\f/>]*")
GAP = re.compile(r"[ \t\n\r\f/]*")
ATTRIBUTE = re.compile(r"=?[^ \t\n\r\f/>=]*")
EQUALS = re.compile(r"[ \t\n\r\f]*=[ \t\n\r\f]*")
VALUE = re.compile(r"[^ \t\n\r\f>]*")
COMMENT_END = re.compile(r"--!?>")
RAW_END = {tag: re.compile(rf"</{tag}(?=[ \t\n\r\f/>])", re.I) for tag in RAW}


def _attributes(html: str, i: int) -> tuple[int, list[tuple[str, str]], bool]:
    """From behind a tag's name: place behind its ``>`` (-1: the page ends before), attributes, whether ``/>`` ends it."""
    out: list[tuple[str, str]] = []
    while True:
        gap = GAP.match(html, i).end()
        if gap == len(html):
            return -1, out, False
        if html[gap] == ">":
            return gap + 1, out, html[gap - 1] == "/" and gap > i
        name = ATTRIBUTE.match(html, gap)
        i, value = name.end(), ""
        equals = EQUALS.match(html, i)
        if equals:
            i = equals.end()
            if html[i: i + 1] in ("'", '"'):
                close = html.find(html[i], i + 1)
                if close < 0:
                    return -1, out, False
                value, i = html[i + 1: close], close + 1
            else:
                value = VALUE.match(html, i).group()
                i += len(value)
        out.append((name.group().lower(), unescape(value) if "&" in value else value))


def parse(html: str) -> list[Node]:
    """Block tree of a page. Comments, tags and raw text end where they end in browsers, if need be with the page."""
    tree = Tree()
    i, n, last = 0, len(html), html.rfind(">")
    while i < n:
        mark = MARKUP.search(html, i)
        at = mark.start() if mark else n
        if at > i:
            tree.text(unescape(html[i:at]))
        if not mark:
            break
        i, closing = at, html.startswith("</", at)
        first = html[at + 1 + closing: at + 2 + closing]
        if "a" <= first <= "z" or "A" <= first <= "Z":
            name = NAME.match(html, at + 1 + closing)
            tag = name.group().lower()
            i, attrs, empty = _attributes(html, name.end())
            if i < 0:
                break
            if closing:
                tree.end(tag)
                continue
            tree.start(tag, attrs)
            if empty:
                tree.end(tag)
            elif tag in RAW and not tree.places.get("svg"):
                end = RAW_END[tag].search(html, i)
                tree.text(html[i: end.start() if end else n])
                i = end.start() if end else n
        elif html.startswith("<!--", at):
            if html.startswith(("<!-->", "<!--->"), at):
                i = html.index(">", at) + 1
                continue
            end = COMMENT_END.search(html, at + 4)
            i = end.end() if end else n
        elif html.startswith("<![CDATA[", at) and tree.foreign():
            end = html.find("]]>", at)
            tree.text(html[at + 9: end if end >= 0 else n])
            i = end + 3 if end >= 0 else n
        elif at < last:
            i = html.index(">", at) + 1
        else:
            if html.startswith("<![", at) or closing and at + 2 == n:
                tree.text(unescape(html[at:]))
            break
    return tree.nodes


SHAPES = 17
WIDTH = len(TAGS) + 3 * len(TOKENS) + SHAPES + 5
_TAG_NUMBER = {t: k for k, t in enumerate(TAGS)}


def node_features(pages: list[list[Node]]) -> np.ndarray:
    """A row per node of all pages, in order. Subtree sums are differences of running sums, as nodes are in preorder."""
    nodes = [x for page in pages for x in page]
    n = len(nodes)
    base = np.repeat(np.cumsum([0] + [len(p) for p in pages[:-1]]), [len(p) for p in pages])
    column = {k: np.fromiter((getattr(x, k) for x in nodes), np.int64, n) for k in ("parent", "depth", "own", "up", "below", "inside", "place", "link")}
    parent = column["parent"] + base
    tag = np.fromiter((_TAG_NUMBER.get(x.tag, -1) for x in nodes), np.int64, n)
    fan = np.fromiter((len(x.children) for x in nodes), np.int64, n)
    own, stops = np.zeros(n), np.zeros(n)
    for i, x in enumerate(nodes):
        if x.parts:
            text = "".join(t for _, t in x.parts).strip()
            own[i], stops[i] = len(text), text.count(".") + text.count(",")
    root = np.arange(n) == base
    end = np.arange(1, n + 1)
    for i in range(n - 1, 0, -1):
        if not root[i] and end[i] > end[parent[i]]:
            end[parent[i]] = end[i]
    link = np.minimum(column["link"], own)

    def below(values: np.ndarray) -> np.ndarray:
        total = np.r_[0.0, np.cumsum(values)]
        return total[end] - total[:-1]

    filled = (own > 0).astype(float)
    is_p = filled * (tag == _TAG_NUMBER["p"])
    text, links, ends, blocks, size, paragraphs = map(below, (own, link, stops, filled, np.ones(n), is_p))
    _, kin, same = np.unique(parent * 64 + tag + 1, return_inverse=True, return_counts=True)
    siblings = np.where(root, 1, fan[parent])
    whole = np.maximum(text[base], 1)
    values = [
        own / (own + 40), text / (text + 200), links / np.maximum(text, 1), link / np.maximum(own, 1), text / whole, ends / np.maximum(text, 1) * 20,
        np.log1p(text / size) / 6, np.log1p(blocks) / 4, paragraphs / np.maximum(blocks, 1), np.log1p(paragraphs) / 4, column["depth"] / 10,
        column["place"] / np.maximum(siblings, 1), np.log1p(siblings) / 4, same[kin] / np.maximum(siblings, 1), text[parent] / whole,
        paragraphs[parent] / np.maximum(blocks[parent], 1), links[parent] / np.maximum(text[parent], 1),
    ]
    groups, at = np.arange(len(TOKENS)), len(TAGS) + 3 * len(TOKENS)
    out = np.zeros((n, WIDTH), np.float32)
    known = np.flatnonzero(tag >= 0)
    out[known, tag[known]] = 1
    for k, mask in enumerate(("own", "below", "up")):
        start = len(TAGS) + k * len(TOKENS)
        out[:, start: start + len(TOKENS)] = column[mask][:, None] >> groups & 1
    out[:, at: at + SHAPES] = np.stack(values, 1)
    out[:, at + SHAPES:] = column["inside"][:, None] >> np.arange(5) & 1
    return out


# --- boosted trees --------------------------------------------------------------------------------------------------


def train_trees(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 5, rate: float = 0.2, bins: int = 24) -> list[tuple]:
    """Trees as (feature, cut, value) arrays in heap order; second-order gain on binned features, logistic loss."""
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T)], 1)
    width = bins + 1
    score = np.zeros(len(y))
    trees = []
    flat = binned + np.arange(x.shape[1]) * width
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p) + 1e-6
        feature, cut, value = np.full(2 ** depth - 1, -1), np.zeros(2 ** depth - 1), np.zeros(2 ** (depth + 1) - 1)
        where = {0: np.arange(len(y))}
        for node in range(2 ** (depth + 1) - 1):
            rows = where.pop(node, None)
            if rows is None:
                continue
            gs, hs = g[rows].sum(), h[rows].sum()
            value[node] = rate * gs / (hs + 1)
            if node >= 2 ** depth - 1 or len(rows) < 10:
                continue
            cells = flat[rows].ravel()
            d = x.shape[1]
            gh = np.bincount(cells, np.repeat(g[rows], d), d * width).reshape(d, width).cumsum(1)
            hh = np.bincount(cells, np.repeat(h[rows], d), d * width).reshape(d, width).cumsum(1)
            gain = gh**2 / (hh + 1) + (gs - gh) ** 2 / (hs - hh + 1) - gs**2 / (hs + 1)
            gain[(hh < 0.5) | (hs - hh < 0.5)] = 0
            f, b = np.unravel_index(gain.argmax(), gain.shape)
            if gain[f, b] < 1e-3 or b >= len(cuts[f]):
                continue
            feature[node], cut[node] = f, cuts[f][b]
            left = binned[rows, f] <= b
            where[2 * node + 1], where[2 * node + 2] = rows[left], rows[~left]
        trees.append((feature, cut, value))
        score += predict([trees[-1]], x)
    return trees


def predict(trees: list[tuple], x: np.ndarray) -> np.ndarray:
    """Log-odds; all rows go down each tree together."""
    out = np.zeros(len(x))
    for feature, cut, value in trees:
        at = np.zeros(len(x), int)
        live = np.arange(len(x))
        while len(live):
            f = feature[at[live]]
            live, f = live[f >= 0], f[f >= 0]
            at[live] = 2 * at[live] + 1 + (x[live, f] > cut[at[live]])
            live = live[at[live] < len(feature)]
        out += value[at]
    return out


# --- decoding -------------------------------------------------------------------------------------------------------


def odds_weight(node: Node) -> float:
    return min(4.0, sum(len(t) for _, t in node.parts) / 40)


def decode(nodes: list[Node], odds: np.ndarray) -> list[bool]:
    """Which nodes are kept: the best choice in which every kept node has a kept parent. Text weighs more than frames."""
    best = [min(6.0, max(-6.0, v)) for v in odds]
    best[0] = 0.0
    for i in range(len(nodes) - 1, 0, -1):
        x = nodes[i]
        if x.hidden:
            best[i] = -1e9
            continue
        if x.parts:
            best[i] += odds_weight(x) * min(6.0, max(-6.0, odds[i]))
    for i in range(len(nodes) - 1, 0, -1):
        if best[i] > 0:
            best[nodes[i].parent] += best[i]
    keep = [True] * len(nodes)
    for i in range(1, len(nodes)):
        keep[i] = keep[nodes[i].parent] and best[i] > 0
    return keep


def blocks(nodes: list[Node], keep) -> list[str]:
    """Texts of the kept nodes in page order; a child block splits the text around it, kept or not, a hidden one does not."""
    out: list[str] = []
    stack: list[tuple[int, int, int]] = [(0, 0, 0)]

    def put(text: str) -> None:
        text = " ".join(text.split())
        if text:
            out.append(text)

    while stack:
        i, part, child = stack.pop()
        node = nodes[i]
        run: list[str] = []
        while True:
            while part < len(node.parts) and node.parts[part][0] <= child:
                before, text = node.parts[part]
                if before < 0:
                    put("".join(run))
                    run = []
                run.append(text)
                part += 1
            if child == len(node.children) or not nodes[node.children[child]].hidden:
                break
            child += 1
        put("".join(run))
        if child < len(node.children):
            stack.append((i, part, child + 1))
            if keep[node.children[child]]:
                stack.append((node.children[child], 0, 0))
    return out


# --- training pages -------------------------------------------------------------------------------------------------

#: Number of training pages, a fixed bound.
PAGES = 500


def training_page(rng: random.Random) -> str:
    """A page of a random layout; ``data-truth`` says of each part whether it is main text."""
    letters = "etaoinshrdlucm"

    def word() -> str:
        return "".join(rng.choice(letters) for _ in range(rng.randint(1, 9)))

    def say(low: int, high: int, stop: str = ".") -> str:
        ws = [word() + rng.choice(["", "", "", "", ","]) for _ in range(rng.randint(low, high))]
        return " ".join(ws).strip(",").capitalize() + rng.choice([stop, stop, ""])

    def prose(low: int, high: int) -> str:
        return " ".join(say(1, 22) for _ in range(rng.randint(low, high)))

    def link(n: int = 3) -> str:
        return f'<a href="/{word()}">{say(1, n, "")}</a>'

    def attrs(kind: str) -> str:
        if rng.random() < 0.25:
            return ""
        name = rng.choice(TOKENS[kind].split())
        if rng.random() < 0.4:
            name = f"{rng.choice(['site', 'page', 'c', 'js', word()])}-{name}"
        return f' {rng.choice(["class", "class", "id"])}="{name}"'

    def box(kind: str, tag: str, body: str) -> str:
        a = attrs(kind)
        if not a and tag in ("div", "section", "p", "span", "ul"):
            a = f' class="{rng.choice(TOKENS[kind].split())}"'
        return f'<{tag}{a} data-truth="0">{body}</{tag}>'

    def items(n: int, make) -> str:
        end = rng.choice(["</li>", "</li>", ""])
        return "<ul>" + "".join(f"<li>{make()}{end}" for _ in range(n)) + "</ul>"

    def boiler(kind: str) -> str:
        if kind == "menu":
            body = items(rng.randint(2, 10), link) if rng.random() < 0.7 else " | ".join(link() for _ in range(rng.randint(2, 8)))
            return box(kind, rng.choice(["nav", "nav", "div", "ul"]), body)
        if kind == "header":
            return box(kind, rng.choice(["header", "header", "div"]), f"<h1>{say(1, 4, '')}</h1>" * rng.randint(0, 1) + link() + f"<p>{say(2, 9)}</p>" * rng.randint(0, 1))
        if kind == "footer":
            return box(kind, rng.choice(["footer", "footer", "div"]), rng.choice([f"&copy; {word()} &middot; {say(2, 14)}", f"<p>{say(2, 10)}</p>" + items(3, link)]))
        if kind == "side":
            return box(kind, rng.choice(["aside", "aside", "div"]), f"<h3>{say(1, 4, '')}</h3>" * rng.randint(0, 1) + rng.choice([items(rng.randint(2, 6), lambda: link(8)), f"<p>{prose(1, 3)}</p>", say(3, 20)]))
        if kind == "notice":
            return box(kind, rng.choice(["div", "div", "section", "dialog", "p"]), rng.choice([say(4, 25), f"<p>{prose(1, 2)}</p>"]) + rng.choice(["", "<button>Ok</button>", link()]))
        if kind == "advert":
            return box(kind, rng.choice(["div", "div", "aside", "section", "p"]), rng.choice([say(2, 25), f"<p>{prose(1, 3)}</p>", link(9)]))
        if kind == "comment":
            one = lambda: rng.choice([f"<p>{prose(1, 4)}</p>", f"<div><b>{word()}</b> <p>{prose(1, 3)}</p></div>", prose(1, 2)])
            n = rng.randint(1, 7)
            body = f"<h3>{say(1, 3, '')}</h3>" * rng.randint(0, 1) + rng.choice([items(n, one), "".join(f'<div class="comment">{one()}</div>' for _ in range(n)), "".join(one() for _ in range(n))])
            return box(kind, rng.choice(["section", "div", "div", "aside"]), body)
        if kind == "form":
            return box(kind, rng.choice(["form", "form", "div"]), f"<label>{say(1, 4, '')}</label><input name=q>" + rng.choice(["", f"<p>{say(3, 12)}</p>", "<button>Go</button>"]))
        return box(kind, rng.choice(["div", "ul", "p"]), " ".join(link() for _ in range(rng.randint(2, 5))))

    def content() -> str:
        roll = rng.random()
        if roll < 0.70:
            end = rng.choice(["</p>", "</p>", "</p>", ""])
            text = prose(1, rng.choice([1, 2, 6, 14]))
            if rng.random() < 0.2:
                text = f"<b>{text}<br>"
            elif rng.random() < 0.2:
                text += f" {link()} {say(1, 9)}"
            return f"<p>{text}{end}"
        if roll < 0.80:
            return f"<h{(k := rng.randint(2, 3))}>{say(1, 8, '')}</h{k}>"
        if roll < 0.86:
            return items(rng.randint(2, 6), lambda: say(1, 12))
        if roll < 0.90:
            return f"<blockquote><p>{prose(1, 3)}</p></blockquote>"
        if roll < 0.93:
            return "<table>" + "".join("<tr>" + "".join(f"<td>{say(1, 3, '')}</td>" for _ in range(3)) + "</tr>" for _ in range(rng.randint(2, 5))) + "</table>"
        if roll < 0.96:
            return f"<pre>{prose(1, 2)}</pre>"
        return f'<div>{prose(1, 4)}</div>' if rng.random() < 0.5 else f'<figure><img src="x"><figcaption>{say(2, 9)}</figcaption></figure>'

    inner = [content() for _ in range(rng.choice([1, 2, 4, 8, 15, 30]))]
    if rng.random() < 0.85:
        inner.insert(0, f"<h1>{say(1, 12, '')}</h1>")
    for kind in rng.sample(["side", "advert", "notice", "form", "share", "comment", "menu", "footer"], rng.choice([0, 0, 1, 2, 3])):
        inner.insert(len(inner) if kind in ("comment", "footer") else rng.randint(0, len(inner)), boiler(kind))
    tag = rng.choice(["article", "article", "article", "main", "div", "section"])
    body = f'<{tag}{attrs("article")} data-truth="1">' + "".join(inner) + f"</{tag}>"
    if tag not in ("main",) and rng.random() < 0.3:
        body = f"<main>{body}</main>"
    before = [boiler(k) for k in rng.sample(["menu", "header", "notice", "advert", "form", "share", "side"], rng.randint(1, 4))]
    after = [boiler(k) for k in rng.sample(["side", "advert", "comment", "footer", "form", "notice", "share", "menu"], rng.randint(1, 4))]
    if rng.random() < 0.4:
        body = f'<div{rng.choice(["", " class=wrap", " id=page", " class=container"])}>{"".join(before)}{body}{"".join(after)}</div>'
    else:
        body = "".join(before) + body + "".join(after)
    return f"<html><head><title>{say(1, 9)}</title><style>p{{}}</style></head><body>{body}<script>var a='</p>';</script></body></html>"


def _labelled(html: str) -> tuple[list[Node], np.ndarray]:
    """Nodes and whether each holds main text itself or below."""
    nodes = parse(html)
    y = np.zeros(len(nodes))
    for i in range(len(nodes) - 1, 0, -1):
        node = nodes[i]
        if node.truth == "1" and not node.hidden and any(t.strip() for _, t in node.parts):
            y[i] = 1
        if y[i]:
            y[node.parent] = 1
    return nodes, y


@cache
def train(pages: int = PAGES, seed: int = 5) -> list[tuple]:
    """Trees from ``pages`` training pages."""
    rng = random.Random(seed)
    parts = [_labelled(training_page(rng)) for _ in range(pages)]
    x = node_features([nodes for nodes, _ in parts])
    y = np.concatenate([y for _, y in parts])
    seen = np.array([n.depth > 0 and not n.hidden for nodes, _ in parts for n in nodes])
    return train_trees(x[seen], y[seen])


def main_text(html: str, trees: list[tuple]) -> str:
    nodes = parse(html)
    return "\n".join(blocks(nodes, decode(nodes, predict(trees, node_features([nodes])))))


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", trees: list[tuple] | None = None) -> DataFrame:
    """Per row of ``pages``: page_id, url, text, n_chars (code points of the text)."""
    shared = pages.sparkSession.sparkContext.broadcast(trees or train())
    rows = pages.select(F.col(f"`{page_id}`").cast("long").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"), F.coalesce(F.col(f"`{html}`"), F.lit("")).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts: list[str] = []
            pending: list[list[Node]] = []
            size = 0
            htmls = batch.column(2)
            for i in range(batch.num_rows):
                pending.append(parse(htmls[i].as_py()))
                size += len(pending[-1])
                if size > 20_000 or i + 1 == batch.num_rows:
                    odds = predict(shared.value, node_features(pending)).tolist()
                    for nodes in pending:
                        texts.append("\n".join(blocks(nodes, decode(nodes, odds[: len(nodes)]))))
                        del odds[: len(nodes)]
                    pending, size = [], 0
            lengths = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), lengths], names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")

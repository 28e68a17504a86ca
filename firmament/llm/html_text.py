"""Main-text extraction: boosted trees over DOM nodes, decoded down the tree.

1. A page is parsed into a tree, in time in proportion to its length: block
   elements, inline ones that a tag or attribute tells from running text, and
   the texts that stand in no element but the body.  Other inline elements
   belong to the node they stand in.
2. Every node gets features: tag, attribute tokens, depth, place and
   number of siblings, text, link and punctuation density of its subtree, and
   the same of its parent.
3. Gradient-boosted trees give the log odds that the element is content or
   holds it.
4. Decoding picks the labels with the largest sum of log odds under the rule
   that nothing inside an element that is left out is kept, by one pass up
   the tree, so ancestors and descendants never contradict each other.

The trees are fitted on at most about ``sample`` pages.  Their elements are
labelled by what the page itself says (article and main hold content; nav,
header, footer, aside, form, buttons and marked adverts don't), and the same texts are
laid out again in random layouts with other tags, class names, sidebars,
notices, forms and reader comments, so the model also learns pages that don't
use those elements.

Defined results: null and empty html give an empty text; elements that never
close are closed at their parent's end, scripts, styles, text areas and the like
at the page's end, quotes that never close belong to a bare value; repeated rows get equal rows; null ids
are carried; whole pages of any length are read; without a page to learn from
the fixed layouts alone are learned; other columns are ignored.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NAME = re.compile(r"<(/?)([A-Za-z][^\s/>]*)")
BETWEEN = re.compile(r"[\s/]*")
ATTRIBUTE = re.compile(r"=?[^\s/>=]*")
EQUALS = re.compile(r"\s*=\s*")
BARE = re.compile(r"[^\s>]*")

# Elements by what they do.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe noembed noframes xmp".split())  # text up to their end tag
BLOCK = frozenset(
    "html head body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption nav header "
    "footer aside form fieldset blockquote pre figure figcaption address details summary dialog center hgroup search".split()
)
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}, "body": {"head"},
}
SCOPE = frozenset("html body article main section div ul ol dl table nav header footer aside form blockquote td th figure details dialog".split())
# inline elements that are nodes; others are if an attribute token names them as no content
INLINE = frozenset("button select svg math object canvas audio video".split())
TAGS = (
    "article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl table tr td nav header footer aside form fieldset blockquote pre figure "
    "figcaption address details dialog body #text span a button select svg math object".split()
)
TAG_AT = {t: i for i, t in enumerate(TAGS)}
# Attribute tokens that name content, and that name other things.
CONTENT_TOKENS = frozenset("article articlebody post entry content main body story text prose single hentry blogpost markdown page".split())
OTHER_TOKENS = frozenset(
    "ad ads advert advertisement adverts banner promo promotion promoted sponsor sponsored cookie cookies consent gdpr notice alert popup modal "
    "overlay nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead topbar footer foot bottom copyright legal sidebar side aside "
    "widget related recommended popular trending share sharing social comment comments commentlist reply replies respond disqus discussion "
    "form login signup subscribe subscription newsletter search pagination pager tags meta byline toolbar skip contentinfo complementary dialog".split()
)
HASHED = 24
N_FEATURES = len(TAGS) + HASHED + 28
DEPTH = 4


@dataclass
class Node:
    tag: str
    parent: int
    tokens: list[str]
    depth: int
    place: int = 0
    children: int = 0
    chars: int = 0  # of its subtree's text
    own: int = 0
    linked: int = 0
    marks: int = 0  # sentence punctuation
    words: int = 0
    elements: int = 0
    paragraphs: int = 0
    inputs: int = 0
    start: int = 0  # characters of text before it
    made: bool = False  # marked as content by ``layout``


@dataclass
class Page:
    nodes: list[Node] = field(default_factory=list)
    #: (node, text) in page order; (-1, "") is a block's edge
    pieces: list[tuple[int, str]] = field(default_factory=list)


def attributes(source: str, at: int, gone: set[str]) -> tuple[list[tuple[str, str]], int]:
    """(name, value) pairs of a tag, read from behind its name, and where the
    tag ends.  A quote that never closes is part of a bare value; ``gone``
    remembers which ones close no more, so nobody looks again."""
    out = []
    while True:
        at = BETWEEN.match(source, at).end()
        if at >= len(source) or source[at] == ">":
            return out, at + 1
        m = ATTRIBUTE.match(source, at)
        name, at = m[0].lower(), m.end()
        if (eq := EQUALS.match(source, at)) is None:
            out.append((name, ""))
            continue
        at = eq.end()
        quote = source[at : at + 1]
        end = source.find(quote, at + 1) if quote in ("'", '"') and quote and quote not in gone else -1
        if end >= 0:
            out.append((name, source[at + 1 : end]))
            at = end + 1
        else:
            if quote:
                gone.add(quote)
            m = BARE.match(source, at)
            out.append((name, m[0]))
            at = m.end()


def _tokens(pairs: list[tuple[str, str]]) -> list[str]:
    out = []
    for name, value in pairs:
        if name in ("class", "id", "role", "itemprop"):
            text = re.sub(r"([a-z])([A-Z])", r"\1 \2", value)
            out += re.findall(r"[a-z]+", html.unescape(text).lower())
    return out


class Open:
    """The elements that are open: (tag, node), innermost last, and by each
    that bounds a scope how many of a tag are open inside it, so that no
    question costs more than it closes."""

    def __init__(self):
        self.stack: list[tuple[str, int, bool, bool]] = [("#root", 0, False, False)]
        self.scopes: list[tuple[int, Counter]] = [(0, Counter())]
        self.count: Counter = Counter()
        self.made = 0  # open elements marked by ``layout``
        self.unclosed: list[int] = []  # inline nodes without an end tag of their own

    def push(self, tag: str, node: int, made: bool = False, inline: bool = False) -> None:
        self.count[tag] += 1
        self.made += made
        self.stack.append((tag, node, made, inline))
        if tag in SCOPE:
            self.scopes.append((len(self.stack) - 1, Counter()))
        else:
            self.scopes[-1][1][tag] += 1

    def pop(self, own_end: bool = False) -> str:
        tag, node, made, inline = self.stack.pop()
        if inline and not own_end:
            self.unclosed.append(node)
        self.count[tag] -= 1
        self.made -= made
        if self.scopes[-1][0] == len(self.stack):
            self.scopes.pop()
        else:
            self.scopes[-1][1][tag] -= 1
        return tag

    def close(self, tag: str) -> None:
        if self.count[tag] > 0:
            while self.stack[-1][0] != tag:
                self.pop()
            self.pop(own_end=True)

    def close_before(self, tag: str) -> None:
        """What the start of ``tag`` closes, up to the next scope."""
        closes = CLOSES.get(tag, frozenset()) | {"p"}
        while True:
            at, inside = self.scopes[-1]
            if any(inside[c] > 0 for c in closes):
                while (was := self.pop()) not in closes:
                    pass
            elif at and self.stack[at][0] in closes:
                while len(self.stack) > at:
                    was = self.pop()
            else:
                return
            if was == "p" and tag not in CLOSES:
                return


def parse(source: str | None) -> Page:
    """The tree of a page; node 0 is its root.  Time is in proportion to the page."""
    page = Page([Node("#root", -1, [], 0)])
    nodes, pieces = page.nodes, page.pieces
    source, at, text_at, gone = source or "", 0, 0, set()
    open_ = Open()

    def new(tag: str, tokens: list[str], made: bool = False) -> int:
        up = open_.stack[-1][1]
        nodes.append(Node(tag, up, tokens, nodes[up].depth + 1, nodes[up].children, start=len(pieces), made=made))
        nodes[up].children += 1
        return len(nodes) - 1

    def add(text: str) -> None:
        if not text:
            return
        text = html.unescape(text) if "&" in text else text
        at = open_.stack[-1][1]
        size = len(text) - text.count(" ")
        blank = not size or text.isspace()
        if nodes[at].tag in ("#root", "html", "body"):  # judged by itself
            last = pieces[-1][0] if pieces else -1
            if last > 0 and nodes[last].tag == "#text" and nodes[last].parent == at:
                at = last
            elif not blank:
                at = new("#text", [], open_.made > 0)
        pieces.append((at, text))
        if not blank:
            node = nodes[at]
            node.own += size
            node.linked += size if open_.count["a"] > 0 else 0
            node.marks += sum(map(text.count, ".,;:!?"))
            node.words += text.count(" ") + 1

    while (lt := source.find("<", at)) >= 0:
        m = NAME.match(source, lt)
        if m is None:
            if source[lt + 1 : lt + 2] not in ("!", "?", "/") or lt + 1 >= len(source):
                at = lt + 1  # a plain sign
                continue
            add(source[text_at:lt])
            mark, skip = ("-->", 2) if source.startswith("<!--", lt) else (">", 1)
            end = source.find(mark, lt + skip)
            at = text_at = end + len(mark) if end >= 0 else len(source)
            continue
        add(source[text_at:lt])
        tag = m[2].lower()
        pairs, at = attributes(source, m.end(), gone)
        text_at = at = min(at, len(source))
        if m[1]:
            open_.close(tag)
            if tag in BLOCK:
                pieces.append((-1, ""))
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*>?", re.I).search(source, at)
            at = text_at = end.end() if end else len(source)
            nodes[open_.stack[-1][1]].inputs += tag == "textarea"
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                pieces.append((-1, ""))
            nodes[open_.stack[-1][1]].inputs += tag == "input"
            continue
        made = any(name == MADE for name, _ in pairs)
        tokens = _tokens(pairs)
        if tag in BLOCK:
            pieces.append((-1, ""))
            open_.close_before(tag)
            open_.push(tag, new(tag, tokens, made), made)
        elif tag in INLINE or not OTHER_TOKENS.isdisjoint(tokens):
            nodes[open_.stack[-1][1]].inputs += tag in ("button", "select")
            open_.push(tag, new(tag, tokens, made), made, inline=True)
        else:
            open_.push(tag, open_.stack[-1][1], made)
    add(source[text_at:])
    while len(open_.stack) > 1:
        open_.pop()

    # an inline element that never closes and holds blocks doesn't hold them: they belong to its parent
    holds = {node.parent for node in nodes[1:] if node.tag in BLOCK}
    lost = {i for i in open_.unclosed if i in holds}
    if lost:
        at_ = list(range(len(nodes)))
        for i, node in enumerate(nodes[1:], 1):
            node.parent = at_[node.parent]
            if i in lost:
                at_[i] = node.parent
        for i in lost:
            up, node = nodes[at_[i]], nodes[i]
            up.own, up.linked, up.marks, up.words = up.own + node.own, up.linked + node.linked, up.marks + node.marks, up.words + node.words
            node.own = node.linked = node.marks = node.words = 0
        page.pieces = pieces = [(at_[i] if i >= 0 else i, text) for i, text in pieces]

    before, upto = 0, [0]
    for node, text in pieces:
        before += len(text) if node >= 0 else 0
        upto.append(before)
    for node in nodes:
        node.start = upto[min(node.start, len(upto) - 1)]
        node.chars = node.own
    for i in range(len(nodes) - 1, 0, -1):
        node, up = nodes[i], nodes[nodes[i].parent]
        up.chars += node.chars
        up.linked += node.linked
        up.marks += node.marks
        up.words += node.words
        up.inputs += node.inputs
        up.elements += node.elements + 1
        up.paragraphs += node.paragraphs + (node.tag == "p")
    return page


def _stable(token: str) -> int:
    return sum((i + 1) * 31 * b for i, b in enumerate(token.encode())) % HASHED


def features(page: Page) -> np.ndarray:
    """One row of N_FEATURES numbers per node."""
    nodes = page.nodes
    total, last = max(1, nodes[0].chars), max(1, nodes[0].chars + nodes[0].words)
    x = np.zeros((len(nodes), N_FEATURES), np.float32)
    good, bad = [0] * len(nodes), [0] * len(nodes)
    rows = []
    for i, node in enumerate(nodes):
        own_good = sum(t in CONTENT_TOKENS for t in node.tokens)
        own_bad = sum(t in OTHER_TOKENS for t in node.tokens)
        up = nodes[node.parent] if i else node
        if i:
            good[i], bad[i] = good[node.parent] + own_good, bad[node.parent] + own_bad
        if node.tag in TAG_AT:
            x[i, TAG_AT[node.tag]] = 1
        for t in node.tokens:
            x[i, len(TAGS) + _stable(t)] += 1
        chars, up_chars = max(1, node.chars), max(1, up.chars)
        rows.append((
            own_good, own_bad, good[i] - own_good, bad[i] - own_bad, node.depth, node.place, up.children, node.place / max(1, up.children),
            math.log1p(node.chars), math.log1p(node.own), node.linked / chars, node.marks / chars, node.chars / max(1, node.words),
            node.chars / (1 + node.elements), node.elements, node.paragraphs, node.inputs, node.chars / total, node.start / last,
            node.chars / up_chars, up.linked / up_chars, up.marks / up_chars, up_chars / (1 + up.elements), up.paragraphs, up.inputs,
            TAG_AT.get(up.tag, -1), len(node.tokens), node.words / (1 + node.elements),
        ))
    x[:, len(TAGS) + HASHED :] = rows
    return x


@dataclass
class Trees:
    """Perfect trees of DEPTH levels: features and cuts by heap place, values by leaf."""

    base: float
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        tree = np.arange(len(self.feature))[None, :]
        at = np.zeros((len(x), len(self.feature)), np.int64)
        row = np.arange(len(x))[:, None]
        for _ in range(DEPTH):
            at = 2 * at + 1 + (x[row, self.feature[tree, at]] > self.cut[tree, at])
        return self.base + self.value[tree, at - (2**DEPTH - 1)].sum(1)


def boost(x: np.ndarray, y: np.ndarray, trees: int = 80, rate: float = 0.3, bins: int = 32, penalty: float = 1.0) -> Trees:
    """Gradient boosting of the log loss on histograms of the features."""
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f]) for f, e in enumerate(edges)], 1)
    used = [f for f in range(x.shape[1]) if binned[:, f].max(initial=0) > 0]
    base = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    margin = np.full(len(y), base)
    n = 2**DEPTH - 1
    out = Trees(base, np.zeros((trees, n), np.int64), np.full((trees, n), np.inf), np.zeros((trees, n + 1)))
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        at = np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            here, low = 2**level, 2**level - 1
            best = np.zeros(here)
            for f in used:
                key = (at - low) * bins + binned[:, f]
                gs = np.bincount(key, g, here * bins).reshape(here, bins).cumsum(1)
                hs = np.bincount(key, h, here * bins).reshape(here, bins).cumsum(1)
                gain = gs**2 / (hs + penalty) + (gs[:, -1:] - gs) ** 2 / (hs[:, -1:] - hs + penalty) - gs[:, -1:] ** 2 / (hs[:, -1:] + penalty)
                cut = gain[:, : len(edges[f])].argmax(1)
                top = gain[np.arange(here), cut]
                for k in np.flatnonzero(top > best + 1e-9):
                    best[k], out.feature[t, low + k], out.cut[t, low + k] = top[k], f, edges[f][cut[k]]
            at = 2 * at + 1 + (x[np.arange(len(y)), out.feature[t, at]] > out.cut[t, at])
        leaf = at - n
        out.value[t] = -rate * np.bincount(leaf, g, n + 1) / (np.bincount(leaf, h, n + 1) + penalty)
        margin += out.value[t][leaf]
    return out


def decode(page: Page, log_odds: np.ndarray) -> np.ndarray:
    """Which nodes are kept: the best sum of log odds over kept nodes, where a
    kept node's parent is kept.  The root, html and body are always kept."""
    nodes = page.nodes
    gain = log_odds.tolist()
    for i in range(len(nodes) - 1, 0, -1):  # children come after their parent
        if gain[i] > 0 or nodes[i].tag in ("html", "body"):
            gain[nodes[i].parent] += max(0.0, gain[i])
    kept = np.zeros(len(nodes), bool)
    kept[0] = True
    for i in range(1, len(nodes)):
        kept[i] = kept[nodes[i].parent] and (gain[i] > 0 or nodes[i].tag in ("html", "body")) and nodes[i].tag != "head"
    return kept


def text_of(page: Page, kept: np.ndarray) -> str:
    """The kept text: white space of a block as one space, blocks joined by newlines."""
    blocks, now = [], []
    for node, text in [*page.pieces, (-1, "")]:
        if node < 0:
            block = " ".join("".join(now).split())
            if block:
                blocks.append(block)
            now = []
        elif kept[node]:
            now.append(text)
    return "\n".join(blocks)


def extract(source: str | None, trees: Trees) -> str:
    page = parse(source)
    return text_of(page, decode(page, trees.log_odds(features(page))))


# ---------------------------------------------------------------- what the trees learn from
CONTENT_AT = frozenset(("article", "main"))
OTHER_AT = frozenset("nav header footer aside form dialog fieldset button select svg object canvas audio video".split())
MADE = "data-content"  # marks content in the laid-out pages; never a feature


def weak_labels(page: Page) -> np.ndarray | None:
    """1 for elements that are content or hold it, by the page's own elements;
    None for a page without article or main."""
    nodes = page.nodes
    if not any(n.tag in CONTENT_AT for n in nodes):
        return None
    inside = [False] * len(nodes)
    for i, node in enumerate(nodes):
        if i:
            other = node.tag in OTHER_AT or any(t in OTHER_TOKENS for t in node.tokens)
            inside[i] = (inside[node.parent] or node.tag in CONTENT_AT) and not other
    return _upwards(nodes, inside)


def _upwards(nodes: list[Node], inside: list[bool]) -> np.ndarray:
    y = np.array(inside, float)
    for i in range(len(nodes) - 1, 0, -1):
        y[nodes[i].parent] = max(y[nodes[i].parent], y[i])
    return y


def blocks_of(page: Page, y: np.ndarray) -> tuple[list[str], list[str]]:
    """Texts of content blocks and of the others."""
    out: tuple[list[str], list[str]] = ([], [])
    for node, text in page.pieces:
        text = " ".join(text.split())
        if node >= 0 and text and page.nodes[node].tag != "head":
            out[0 if y[node] else 1].append(text)
    return out


def layout(content: list[str], other: list[str], stray: list[str], rng: random.Random) -> str:
    """A page with the same content in a random layout.  ``stray``: sentences
    of other pages, for comments and notices that read like content."""
    esc = html.escape
    pick = lambda xs, k: [rng.choice(xs) for _ in range(k)] if xs else []
    name = lambda *ws: f' {rng.choice(("class", "id"))}="{rng.choice(ws)}"'
    paras = lambda texts: "".join(f"<p>{esc(t)}</p>" for t in texts)
    links = lambda k: "".join(f'<li><a href="/{i}">{esc(" ".join(t.split()[: rng.randint(1, 5)]))}</a></li>' for i, t in enumerate(pick(other + stray, k)))

    def boiler() -> str:
        kind = rng.randrange(12)
        some = pick(stray + other, rng.randint(1, 4))
        if kind == 0:
            return f"<{(t := rng.choice(('nav', 'div', 'header')))}{name('menu', 'main-nav', 'navbar', 'topnav navigation')}><ul>{links(rng.randint(2, 9))}</ul></{t}>"
        if kind == 1:
            return f"<aside{rng.choice(('', name('sidebar', 'widget', 'side')))}>{paras(some)}<ul>{links(3)}</ul></aside>"
        if kind == 2:
            return f"<div{name('sidebar', 'side-bar widget', 'related posts', 'recommended', 'popular', 'share social', 'promo', 'sponsored')}>{paras(some)}</div>"
        if kind == 3:
            return f"<div{name('cookie-notice', 'consent banner', 'alert notice', 'popup', 'gdpr', 'notice', 'modal overlay')}>{rng.choice((esc(some[0]) if some else '', paras(some)))}</div>"
        if kind == 4:
            return f"<div{name('ad', 'ads', 'advert', 'ad-slot', 'banner-ad')}>{esc(some[0]) if some else ''}</div>"
        if kind == 5:
            return f"<form action='/s'{rng.choice(('', name('search', 'newsletter subscribe', 'login')))}><p>{esc(some[0]) if some else ''}</p><label>{esc(' '.join(some)[:20])}</label><input name=q><button>go</button></form>"
        if kind == 6:
            return f"<footer{rng.choice(('', name('footer', 'site-footer')))}>{rng.choice((paras(some), esc(' '.join(some))))}</footer>"
        if kind == 7:
            return f"<header{rng.choice(('', name('masthead', 'site-header')))}><p>{esc(some[0][:60]) if some else ''}</p><ul>{links(3)}</ul></header>"
        if kind == 8:
            return f"<div{name('footer', 'copyright', 'bottom', 'breadcrumb', 'pagination', 'meta byline')}>{esc(some[0][:80]) if some else ''}</div>"
        if kind == 9:
            return f"<{(t := rng.choice(('button', 'select', 'svg', 'object')))}>{esc(' '.join(some)[: rng.choice((8, 20, 60))])}</{t}>"
        if kind == 10:
            return f"<span{name('ad', 'ads', 'advert', 'sponsored', 'promo', 'share')}>{esc(some[0]) if some else ''}</span>"
        return f"<{(t := rng.choice(('section', 'div', 'ul', 'ol')))}{name('comments', 'comment-list', 'replies', 'discussion', 'comments-area')}>" + "".join(
            f"<{(u := 'li' if t in ('ul', 'ol') else rng.choice(('div', 'article', 'p')))}{name('comment', 'reply', 'comment-body')}>{esc(s)}</{u}>" for s in some * 2
        ) + f"</{t}>"

    body = f"<h1>{esc(content[0][:60])}</h1>" if content and rng.random() < 0.8 else ""
    for text in content:
        kind = rng.random()
        if rng.random() < 0.15:  # within the block: elements that are content, and that are not
            within = rng.choice((f"<math><mi>{esc(text[:9])}</mi></math>", f"<b>{esc(text[:20])}</b>", f"<span class='ad'>{esc(text[:60])}</span>", "<button>ok go</button>", "<span id='share'>share this</span>"))
            body += f"<p>{esc(text)} {within}</p>"
            continue
        body += (
            f"<p>{esc(text)}</p>" if kind < 0.7 else f"<div>{esc(text)}</div>" if kind < 0.76 else f"<ul><li>{esc(text)}</li></ul>" if kind < 0.82
            else f"<blockquote><p>{esc(text)}</p></blockquote>" if kind < 0.87 else f"<h2>{esc(text[:50])}</h2>" if kind < 0.93
            else f"<table><tr><td>{esc(text)}</td></tr></table>" if kind < 0.96 else f"<pre>{esc(text)}</pre>"
        )
    inner = "".join(boiler() for _ in range(rng.choice((0, 0, 0, 1, 2))))
    cut = body.rfind("</p>", 0, len(body) // 2 + 1) + 4
    parts = [body[:cut], inner, body[cut:]] if cut > 3 and rng.random() < 0.5 else [body, inner]
    tag = rng.choice(("article", "main", "div", "div", "div", "section"))
    mark = rng.choice(("", name("content", "post", "entry-content", "article-body", "main", "post-body story", "text"))) if tag != "div" or rng.random() < 0.2 else name("content", "post", "entry-content", "article-body", "main", "post-body story", "text", "page-content")
    out = f"<{tag}{mark} {MADE}>" + "".join(parts) + f"</{tag}>"
    if rng.random() < 0.06:  # text without any element, as an old page has it
        out = f"<x-text {MADE}>" + "<br>".join(map(esc, content)) + "</x-text>"
    for _ in range(rng.randrange(3)):
        out = f"<div{rng.choice(('', name('wrapper', 'container', 'row', 'layout', 'page')))}>{boiler() if rng.random() < 0.4 else ''}{out}{boiler() if rng.random() < 0.4 else ''}</div>"
    stray_text = lambda: f" {esc(' '.join(' '.join(pick(stray + other, 1)).split()[: rng.randint(2, 9)]))} " if rng.random() < 0.2 else ""
    around = lambda k: "".join(rng.choice((boiler() + stray_text(), stray_text() + boiler())) for _ in range(rng.randint(0, k)))
    return f"<!DOCTYPE html><html><head><title>x</title></head><body>{around(4)}{out}{around(4)}</body></html>"


def layout_labels(page: Page) -> np.ndarray:
    """Labels of a laid-out page: its marked nodes, without what ``boiler``
    put inside; all of those have a telling tag or token."""
    inside = [False] * len(page.nodes)
    for i, node in enumerate(page.nodes):
        other = node.tag in OTHER_AT or any(t in OTHER_TOKENS and t not in CONTENT_TOKENS for t in node.tokens)
        inside[i] = node.made or (i > 0 and inside[node.parent] and not other)
    return _upwards(page.nodes, inside)


def fit(sources: list[str], layouts: int = 3, seed: int = 5) -> Trees:
    """Trees from pages; each with content also in ``layouts`` random layouts."""
    rng = random.Random(seed)
    x, y, texts, stray = [], [], [], []
    for source in sources:
        page = parse(source)
        label = weak_labels(page)
        if label is None:
            continue
        x.append(features(page))
        y.append(label)
        texts.append(blocks_of(page, label))
        stray += texts[-1][0][:4]
    if not texts:
        plain = ["A plain sentence, as an article has many of them.", "Another sentence; it follows the first."]
        texts, stray = [(plain, ["menu", "about us", "all rights reserved"])] * 60, plain
    for content, other in texts:
        for k in range(layouts):
            # some pages hold little: a block or two, or a few words
            some = content[: rng.choice((1, 2, 6))] if k == 0 else content[:40]
            some = [" ".join(some[0].split()[: rng.randint(1, 4)])] if k == 0 and some and rng.random() < 0.3 else some
            source = layout(some, other, stray, rng)
            page = parse(source)
            x.append(features(page))
            y.append(layout_labels(page))
    return boost(np.vstack(x), np.concatenate(y))


def train(pages: DataFrame, html_col: str = "html", sample: int = 200, longest: int = 40_000) -> Trees:
    """Trees from at most about ``sample`` pages of at most ``longest``
    characters (a bound of what is learned from; extraction reads all pages),
    chosen by the hash of their html; the driver gets those pages only."""
    rows = pages.select(F.col(html_col).alias("html")).filter(F.length("html") <= longest)
    n = max(1, rows.count())
    rows = rows.filter(F.pmod(F.xxhash64(F.lit(9), "html"), F.lit(1_000_000)) < 1e6 * sample / n).distinct().limit(2 * sample)
    return fit(sorted(r["html"] for r in rows.collect()))


def main_text(pages: DataFrame, trees: Trees, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    shared = pages.sparkSession.sparkContext.broadcast(trees)
    of = F.udf(lambda source: extract(source, shared.value), "string")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), of(F.col(html_col)).alias("text"))
    return rows.withColumn("n_chars", F.char_length("text").cast("bigint"))

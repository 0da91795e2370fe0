"""Main text of HTML pages by a tree-structured graphical model over their DOM.

A tolerant parser turns a page into a tree of block elements with runs of text as
leaves; inline elements with a class, id or role are nodes too, nested as in the
page, whose text stays in its block's line or leaves it.  Every node is content or not; a node's own features (tag, words of class,
id and role, size, punctuation, share of linked text) and the state of its parent
decide.  Sum-product messages pass upward and downward, level by level over all
pages of a batch, and give exact marginals; text whose marginal is at least one
half is kept.

The weights maximise the likelihood of labelled pages.  As no table has labels of
page parts, the labelled pages come from a grammar of page layouts in this module.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

WIDTH = 1 << 16
#: Labelled pages, gradient steps, and the ridge.
PAGES, ROUNDS, RIDGE = 400, 160, 1e-3
#: Bytes of html per batch of trees, and the depth below which elements hang on one level.
CHUNK, DEPTH = 1 << 22, 200

# Fixed values of the HTML standard.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd map mark meter nobr output picture progress q rp rt ruby s samp small source span strike strong sub sup time track tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("script style title textarea noscript iframe template svg math object select datalist canvas audio video noframes xmp".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dd dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table ul".split())
#: An element that starts ends an open one of these, unless one of the others lies between.
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "option": (("option",), ("optgroup",)),
    "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "tbody": (("thead", "tbody", "tfoot"), ("table",)), "tfoot": (("thead", "tbody", "tfoot"), ("table",)), "body": (("head",), ()),
}

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<raw>.*?)(?:\]\]>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/><]*+)(?P<attrs>(?:[^>"']|"[^"]*+"|'[^']*+')*+)>|<[!?/][^>]*+(?:>|\Z)|<[a-zA-Z][^<>]*+(?:>|\Z)""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*+)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++))?""")
_NAMED = re.compile(r"(?i)(?:^|[\s\"'])(?:class|id|role|hidden|aria-hidden|style)\b")
_WORD = re.compile(r"[a-z]{2,}")
_features: dict = {}
_models: list = []


def feature(name: str) -> int:
    if name not in _features:
        if len(_features) > 1 << 16:
            _features.clear()
        _features[name] = zlib.crc32(name.encode()) % WIDTH
    return _features[name]


def _of_element(tag: str, attrs: str) -> tuple[int, ...]:
    key = (tag, attrs)
    if key not in _features:
        names = [f"tag {tag}"]
        for name, value in _ATTRIBUTE.findall(attrs):
            name, value = name.lower(), unescape(value.strip("\"'")).lower()
            if name in ("class", "id", "role", "itemprop", "aria-label"):
                names += [f"word {w}" for w in set(_WORD.findall(value))]
            elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                names.append("hidden")
        found = tuple(feature(n) for n in names)
        if len(_features) > 1 << 16:
            _features.clear()
        _features[key] = found
    return _features[key]


def _of_text(text: str, linked: int, parent: str) -> tuple[int, ...]:
    n = len(text)
    words = text.count(" ") + 1
    stops = sum(map(text.count, ".!?。"))
    return (
        feature("text"), feature(f"in {parent}"), feature(f"size {min(n.bit_length(), 10)}"), feature(f"words {min(words.bit_length(), 7)}"),
        feature(f"linked {round(4 * linked / n)}"), feature(f"stops {min(stops, 3)}"), feature(f"commas {min(text.count(','), 3)}"),
        feature(f"ends {text[-1] in '.!?。…:;'}"), feature("notice" if "©" in text else "no notice"),
    )


class Trees:
    """Nodes of many pages: parents, depths, features, and the texts of leaves."""

    def __init__(self):
        self.parent: list[int] = []
        self.depth: list[int] = []
        self.nodes: list[int] = []  # node of each feature
        self.features: list[int] = []
        self.leaf: list[bool] = []
        self.texts: list[tuple[int, int, str]] = []  # page, leaf, its text
        self.blocks: list[tuple[int, list[tuple[int, str]]]] = []  # page, and the parts of a line with their leaves

    def _node(self, parent: int, depth: int, features: tuple[int, ...], leaf: bool) -> int:
        at = len(self.parent)
        self.parent.append(parent)
        self.depth.append(depth)
        self.nodes += [at] * len(features)
        self.features += features
        self.leaf.append(leaf)
        return at

    def add(self, page: int, html: str) -> None:
        open_: list[tuple[str, int]] = [("", self._node(-1, 0, (feature("page"),), False))]
        pieces: list[str] = []
        linked: list[int] = []  # pieces in links
        within: list[int] = []  # the innermost named inline element of each piece
        marked: list[tuple[str, tuple[int, ...], int]] = []  # named inline elements of the block: tag, features, the one around it
        inline: list[tuple[str, int]] = []  # open inline elements, named or not, and the named one that counts in them
        link, at, size = False, 0, len(html)

        def leaf(node: int, depth: int, own: list[int], tag: str) -> tuple[int, str]:
            text = " ".join(unescape("".join(pieces[i] for i in own)).split())
            if not text:
                return -1, text
            share = min(len(text), sum(len(pieces[i]) for i in set(linked).intersection(own)))
            found = self._node(node, min(depth, DEPTH), _of_text(text, share, tag), True)
            self.texts.append((page, found, text))
            return found, text

        def close() -> None:
            """The text since the last block border becomes a leaf."""
            if pieces:
                tag, node = open_[-1]
                if max(within) < 0:
                    found, text = leaf(node, len(open_), list(range(len(pieces))), tag)
                    if text:
                        self.blocks.append((page, [(found, text)]))
                else:
                    own: dict[int, list[int]] = {}
                    for i, m in enumerate(within):
                        own.setdefault(m, []).append(i)
                    leaves = {-1: leaf(node, len(open_), own[-1], tag)[0]} if -1 in own else {}
                    made: dict[int, tuple[int, int]] = {-1: (node, len(open_) - 1)}  # its node and depth

                    def element(m: int) -> tuple[int, int]:
                        way = []
                        while m not in made:
                            way.append(m)
                            m = marked[m][2]
                        for x in reversed(way):
                            name, features, above = marked[x]
                            up, depth = made[above]
                            made[x] = self._node(up, min(depth + 1, DEPTH - 1), (*features, feature(f"tag {name} in {marked[above][0] if above >= 0 else tag}")), False), depth + 1
                        return made[way[0] if way else m]

                    for m in sorted(own):
                        if m >= 0:
                            up, depth = element(m)
                            leaves[m] = leaf(up, depth + 1, own[m], marked[m][0])[0]
                    self.blocks.append((page, [(leaves[m], pieces[i]) for i, m in enumerate(within)]))
                pieces.clear()
                linked.clear()
                within.clear()
            # what is still open goes on in the next block
            kept = [(name, marked[m] if m >= 0 else None) for name, m in inline]
            marked.clear()
            inline.clear()
            for name, mark in kept:
                around = inline[-1][1] if inline else -1
                if mark is not None and (not inline or mark is not kept[len(inline) - 1][1]):
                    marked.append((mark[0], mark[1], around))
                    around = len(marked) - 1
                inline.append((name, around))

        def push(piece: str) -> None:
            if link:
                linked.append(len(pieces))
            within.append(inline[-1][1] if inline else -1)
            pieces.append(piece)

        while at < size:
            found = _TOKEN.search(html, at)
            if not found:
                push(html[at:])
                break
            if found.start() > at:
                push(html[at : found.start()])
            at = found.end()
            tag = found["tag"]
            if tag is None:
                if found["raw"]:
                    push(found["raw"].replace("&", "&amp;"))
                continue
            tag = tag.lower()
            if tag in INLINE:
                if tag == "a":
                    link = not found["end"]
                elif tag == "br":
                    push(" ")
                if tag not in VOID:
                    if found["end"]:
                        for i in range(len(inline) - 1, -1, -1):  # the innermost open one of the name; an end without a start is none
                            if inline[i][0] == tag:
                                del inline[i]
                                # those within it end with it: what follows is around them
                                del inline[i:]
                                break
                    elif len(inline) < DEPTH:
                        around = inline[-1][1] if inline else -1
                        if found["attrs"] and _NAMED.search(found["attrs"]):
                            marked.append((tag, _of_element(tag, found["attrs"]), around))
                            around = len(marked) - 1
                        inline.append((tag, around))
                continue
            close()
            if found["end"]:
                inline.clear()
                marked.clear()
                if tag == "p" or tag in CLOSES_P:
                    link = False
                for i in range(len(open_) - 1, 0, -1):
                    if open_[i][0] == tag:
                        del open_[i:]
                        break
                continue
            if tag in DROPPED:
                if not found["attrs"].endswith("/") or tag not in ("svg", "math"):
                    end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(html, at)
                    at = end.end() if end else size
                continue
            if tag in VOID:
                continue
            if tag in CLOSES_P:
                for i in range(len(open_) - 1, 0, -1):
                    if open_[i][0] == "p":
                        del open_[i:]
                        break
                    if open_[i][0] in ("table", "td", "th", "button", "caption"):
                        break
            if tag in IMPLIED:
                ends, stops = IMPLIED[tag]
                for i in range(len(open_) - 1, 0, -1):
                    if open_[i][0] in ends:
                        del open_[i:]
                        break
                    if open_[i][0] in stops:
                        break
            above, node = open_[-1]
            node = self._node(node, min(len(open_), DEPTH - 1), (*_of_element(tag, found["attrs"]), feature(f"tag {tag} in {above}")), False)
            if len(open_) < DEPTH:  # deeper elements stay leaves: what is in them hangs on the last level
                open_.append((tag, node))
        close()

    def arrays(self) -> Nodes:
        depth = np.array(self.depth, np.int64)
        return Nodes(np.array(self.parent, np.int64), depth, np.array(self.leaf, np.int64), np.array(self.nodes, np.int64), np.array(self.features, np.int64), [np.flatnonzero(depth == d) for d in range(int(depth.max(initial=0)) + 1)])


@dataclass
class Nodes:
    parent: np.ndarray
    depth: np.ndarray
    kind: np.ndarray  # 1: a leaf
    node: np.ndarray
    feature: np.ndarray
    levels: list[np.ndarray]


@dataclass
class Model:
    weights: np.ndarray  # what a feature adds to the log odds of content
    pairs: np.ndarray  # kind of child, parent's state, own state


def _log_sum(x: np.ndarray) -> np.ndarray:
    return np.logaddexp(x[..., 0], x[..., 1])


def sum_product(nodes: Nodes, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Every node's marginal of content, and every node's joint with its parent (parent's state, own state)."""
    n = len(nodes.parent)
    own = np.zeros((n, 2))
    own[:, 1] = np.bincount(nodes.node, weights=model.weights[nodes.feature], minlength=n)
    up = own.copy()
    message = np.zeros((n, 2))
    for level in nodes.levels[:0:-1]:
        message[level] = _log_sum(up[level][:, None, :] + model.pairs[nodes.kind[level]])
        np.add.at(up, nodes.parent[level], message[level])
    total = up.copy()
    joint = np.zeros((n, 2, 2))
    for level in nodes.levels[1:]:
        above = total[nodes.parent[level]] - message[level]
        both = above[:, :, None] + model.pairs[nodes.kind[level]] + up[level][:, None, :]
        joint[level] = both
        total[level] = np.logaddexp(both[:, 0], both[:, 1])
    odds = total[:, 1] - total[:, 0]
    peak = joint.max((1, 2), keepdims=True)
    joint = np.exp(joint - peak)
    joint /= joint.sum((1, 2), keepdims=True)
    return 1 / (1 + np.exp(-np.clip(odds, -500, 500))), joint


def train(pages: list[str], content: list[set[str]]) -> Model:
    """Fits on pages and the texts of their blocks that are content; an element is content if something under it is."""
    trees = Trees()
    for i, html in enumerate(pages):
        trees.add(i, html)
    nodes = trees.arrays()
    n = len(nodes.parent)
    label = np.zeros(n, np.int64)
    for page, node, text in trees.texts:
        label[node] = text in content[page]
    for level in nodes.levels[:0:-1]:
        np.maximum.at(label, nodes.parent[level], label[level])
    child = np.flatnonzero(nodes.parent >= 0)
    seen = np.zeros((2, 2, 2))
    np.add.at(seen, (nodes.kind[child], label[nodes.parent[child]], label[child]), 1)
    model = Model(np.zeros(WIDTH), np.zeros((2, 2, 2)))
    theta = np.zeros(WIDTH + 8)
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, ROUNDS + 1):
        marginal, joint = sum_product(nodes, model)
        gap = np.bincount(nodes.feature, weights=(label - marginal)[nodes.node], minlength=WIDTH)
        expected = np.stack([joint[child][nodes.kind[child] == k].sum(0) for k in (0, 1)])
        grad = np.concatenate([gap, (seen - expected).reshape(-1)]) / len(pages) - RIDGE * theta
        mean, square = 0.9 * mean + 0.1 * grad, 0.99 * square + 0.01 * grad**2
        theta += 0.1 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
        model = Model(theta[:WIDTH], theta[WIDTH:].reshape(2, 2, 2))
    return model


# ---- labelled pages -------------------------------------------------------------------------------------------------

_NOT_CONTENT = {
    "nav": "nav navbar navigation menu mainmenu topnav breadcrumb breadcrumbs pagination pager toc tabs", "header": "header masthead topbar branding logo site banner",
    "footer": "footer bottom copyright legal colophon", "aside": "sidebar aside rail widget related recommended popular trending more tags archive",
    "notice": "cookie consent notice gdpr privacy alert paywall subscribe newsletter signup popup modal overlay banner message disclaimer", "ad": "ad ads advert advertisement sponsor sponsored promo promotion adslot dfp teaser",
    "form": "form search login contact", "comments": "comments comment reply replies respond discussion disqus feedback responses thread", "social": "share social sharing follow buttons toolbar",
}
_PREFIXES, _SUFFIXES = ("", "site-", "page-", "js-", "block-", "x-"), ("", "", "-box", "-inner", "-wrap", "-1")
_CONTENT_WORDS = "article content main post entry story body text page maincontent articlebody".split()


class _Writer:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.content: set[str] = set()
        parts = ["".join(self.r.choice("bcdfghlmnprstv") + self.r.choice("aeiouéä") for _ in range(2)) for _ in range(60)]
        self.lexicon = ["".join(self.r.choice(parts) for _ in range(self.r.randint(1, 3))) for _ in range(400)]

    def words(self, n: int) -> str:
        return " ".join(self.r.choice(self.lexicon) for _ in range(n))

    def sentence(self, low: int = 3, high: int = 18) -> str:
        s = self.words(self.r.randint(low, high)).capitalize()
        if self.r.random() < 0.4:
            s = s.replace(" ", ", ", 1)
        return s + self.r.choice("....!?")

    def text(self, low: int, high: int) -> str:
        odd = self.r.random()
        if odd < 0.06:
            return self.words(self.r.randint(3, 80))
        if odd < 0.10:
            return " | ".join(self.words(1) for _ in range(self.r.randint(3, 60)))
        if odd < 0.14:
            return " ".join(w + self.r.choice(["%%%", "***", "###", "&amp;&amp;"]) for w in self.words(self.r.randint(3, 60)).split())
        if odd < 0.18:
            return " ".join([self.words(1).capitalize()] * self.r.randint(3, 40))
        return " ".join(self.sentence() for _ in range(self.r.randint(low, high)))

    def kept(self, text: str) -> str:
        self.content.add(" ".join(unescape(text).split()))
        return text

    def inner(self, line: str) -> str:
        """A line of the article with words of it in a named element, whatever the name, and at times an advert within that."""
        r, words = self.r, line.split()
        if len(words) < 2 or "&" in line:
            return self.kept(line)
        i = r.randrange(len(words))
        j = min(len(words), i + r.choice([1, 1, 1, 2, 3, 6, 20]))
        if r.random() < 0.25:  # with the whole line in it
            i, j = 0, len(words)
        own, rest = " ".join(words[i:j]), " ".join(words[:i] + words[j:])
        self.kept(own)
        if rest:
            self.kept(rest)
        tag = r.choice("a a a em em b i strong cite code time abbr span span span sup q mark".split())
        name = self.words(1) + r.choice(["", "", "-" + self.words(1), " " + self.words(1)]) if r.random() < 0.85 else r.choice(_CONTENT_WORDS)
        name = r.choice(_PREFIXES) + r.choice([name, name, r.choice("abcdefghijklmnopqrstuvwxyz")]) + r.choice(_SUFFIXES)
        attrs = r.choice([f' class="{name}"', f" class='{name}'", f' id="{name}"', f' class="{name}" title="{name}"']) + (' href="/x"' if tag == "a" else "")
        if r.random() < 0.3 and j - i > 1:
            half = (i + j) // 2
            head, tail = " ".join(words[i:half]), " ".join(words[half:j])
            own = f"{head} <span{self.attrs('ad')}>{self.sentence(2, 8)}</span> {tail}"
        return " ".join([*words[:i], f"<{tag}{attrs}>{own}</{tag}>", *words[j:]])

    def attrs(self, kind: str) -> str:
        words = _NOT_CONTENT[kind].split() if kind in _NOT_CONTENT else _CONTENT_WORDS
        name = self.r.choice(_PREFIXES) + self.r.choice(words) + self.r.choice(_SUFFIXES)
        return self.r.choice([f' class="{name}"', f' id="{name}"', f' class="box {name}"', f" class='{name} col'"])

    def links(self, n: int) -> str:
        return "".join(f'<li><a href="/{i}">{self.words(self.r.randint(1, 3))}</a></li>' for i in range(n))

    def junk(self, kind: str) -> str:
        r, tag = self.r, {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form", "comments": "section"}.get(kind, "div")
        if kind in ("ad", "social") and r.random() < 0.3:
            return f"<span{self.attrs(kind)}>{self.sentence(2, 8)}</span>"
        semantic = r.random() < 0.6
        open_ = f"<{tag}{self.attrs(kind) if r.random() < 0.5 else ''}>" if semantic and tag != "div" else f"<div{self.attrs(kind)}>"
        close = f"</{open_[1:].split('>')[0].split()[0]}>"
        if kind == "nav":
            inner = f"<ul>{self.links(r.randint(2, 9))}</ul>"
        elif kind == "header":
            inner = r.choice([f"<a href='/'>{self.words(2)}</a>", f"<div>{self.words(3)}</div><p>{self.sentence()}</p>", f"<h1>{self.words(2)}</h1>", f"<span>{self.words(4)}</span>"])
        elif kind == "footer":
            inner = r.choice([f"&copy; {self.words(2)} &middot; {self.sentence()}", f"<p>&copy; 2024 {self.words(3)}</p><ul>{self.links(3)}</ul>", f"<p>{self.text(1, 3)}</p>", f"<div>{self.sentence()}</div>"])
        elif kind == "aside":
            inner = r.choice([f"<h3>{self.words(2)}</h3><ul>{self.links(r.randint(2, 6))}</ul>", f"<h2>{self.words(2)}</h2><p>{self.text(1, 4)}</p>", f"<p>{self.text(1, 4)}</p>"])
        elif kind == "notice":
            inner = r.choice([f"<p>{self.text(1, 3)}</p><button>{self.words(1)}</button>", self.text(1, 3), f"<p>{self.text(1, 2)} <a href='#'>{self.words(2)}</a></p>"])
        elif kind == "ad":
            inner = r.choice([self.text(1, 3), f"<p>{self.text(1, 3)}</p>", f"<a href='/ad'>{self.sentence()}</a>", f"<span>{self.words(1)}</span><p>{self.sentence()}</p>"])
        elif kind == "form":
            inner = f"<label>{self.words(2)}</label><input type='text'><p>{self.sentence()}</p><button>{self.words(1)}</button>"
        elif kind == "comments":
            one = lambda: r.choice(["<div class='comment'><p>%s</p></div>", "<article class='comment'><header>%s</header><p>%s</p></article>", "<li><b>%s</b><p>%s</p></li>"])
            inner = f"<h2>{self.words(2)}</h2>" if r.random() < 0.7 else ""
            for _ in range(r.randint(1, 6)):
                shape = one()
                inner += shape % tuple([self.words(2)] * (shape.count("%s") - 1) + [self.text(1, 6)])
            inner += f"<form><p>{self.words(3)}</p></form>" if r.random() < 0.3 else ""
        else:
            inner = "".join(f"<a href='#'>{self.words(1)}</a> " for _ in range(r.randint(2, 5)))
        return open_ + inner + close

    def article(self) -> str:
        r, out = self.r, []
        title = r.choice([lambda: self.words(r.randint(2, 8)).capitalize(), lambda: self.sentence(2, 8)])()
        heading = f"<h1>{self.kept(title)}</h1>" if r.random() < 0.9 else ""
        out.append(f"<header>{heading}</header>" if heading and r.random() < 0.1 else heading)
        for _ in range(r.randint(1, 12)):
            kind = r.random()
            if kind < 0.68:
                line = self.text(1, 6) if r.random() < 0.85 else self.words(r.randint(1, 4)).capitalize() + "."
                odd = r.random()
                if odd < 0.40:
                    line = self.inner(line)
                else:
                    self.kept(line)
                if odd < 0.06:
                    line = f"<span{self.attrs('content')}>{line}</span>"
                elif 0.3 < odd < 0.55:
                    line += f" <{(tag := r.choice(['span', 'small', 'em']))}{self.attrs(r.choice(['ad', 'ad', 'social', 'notice']))}>{self.sentence(2, 8)}</{tag}>"
                out.append(f"<p>{r.choice(['', '', '<b>'])}{line}" + r.choice(["</p>", "</p>", "<br>", "</b></p>"]))
            elif kind < 0.76:
                out.append(f"<h2>{self.kept(self.words(r.randint(1, 6)).capitalize())}</h2>")
            elif kind < 0.82:
                out.append("<ul>" + "".join(f"<li>{self.kept(self.sentence(2, 12))}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
            elif kind < 0.87:
                out.append(f"<blockquote><p>{self.kept(self.text(1, 3))}</p></blockquote>")
            elif kind < 0.90:
                out.append("<table>" + "".join(f"<tr><td>{self.kept(self.words(2))}</td><td>{self.kept(self.words(1) + str(r.randint(1, 99)))}</td></tr>" for _ in range(r.randint(2, 4))) + "</table>")
            elif kind < 0.92:
                out.append(f"<figure><img src='x.png'><figcaption>{self.kept(self.sentence())}</figcaption></figure>")
            elif kind < 0.93:
                out.append(f"<pre>{self.kept(self.words(6))}</pre>")
            else:
                out.append(self.junk(r.choice(["ad", "social", "aside", "notice", "ad"])))
        return "\n".join(out)

    def page(self) -> str:
        r = self.r
        before = [self.junk(k) for k in ("header", "nav", "notice", "ad", "aside", "form", "social") if r.random() < 0.45]
        after = [self.junk(k) for k in ("comments", "aside", "social", "ad", "notice", "form", "nav", "footer") if r.random() < 0.45]
        r.shuffle(before)
        body = self.article()
        shape = r.random()
        if shape < 0.4:
            body = f"<article{self.attrs('content') if r.random() < 0.4 else ''}>{body}</article>"
        elif shape < 0.6:
            body = f"<main{self.attrs('content') if r.random() < 0.3 else ''}>{body}</main>"
        elif shape < 0.9:
            body = f"<div{self.attrs('content')}>{body}</div>"
        else:
            body = r.choice(["<div>%s</div>", "<section>%s</section>", "%s"]) % body
        inside = after[: len(after) // 2] if r.random() < 0.15 else []
        if inside:
            body, after = f"<main>{body}{''.join(inside)}</main>", after[len(inside) :]
        if r.random() < 0.3:
            return f"<html><head><title>{self.words(3)}</title></head><body><div class='wrapper'>{''.join(before)}{body}{''.join(after)}</div></body></html>"
        return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{self.words(3)}</title></head><body>{''.join(before)}{body}{''.join(after)}</body></html>"


def labelled_pages(n: int = PAGES, seed: int = 11) -> tuple[list[str], list[set[str]]]:
    pages, content = [], []
    for i in range(n):
        w = _Writer(seed * 100_003 + i)
        pages.append(w.page())
        content.append(w.content)
    return pages, content


# ---- the operator ---------------------------------------------------------------------------------------------------


def texts(pages: list[str], model: Model) -> list[str]:
    trees = Trees()
    for i, html in enumerate(pages):
        trees.add(i, html)
    out: list[list[str]] = [[] for _ in pages]
    if trees.texts:
        marginal, _ = sum_product(trees.arrays(), model)
        for page, parts in trees.blocks:
            kept = [x for node, x in parts if node >= 0 and marginal[node] >= 0.5]
            if kept and len(parts) > 1:
                kept = [" ".join(unescape("".join(x if node < 0 or marginal[node] >= 0.5 else " " for node, x in parts)).split())]
            out[page] += [x for x in kept if x]
    return ["\n".join(x) for x in out]


def _trained() -> Model:
    """The model of the grammar's pages, fitted once per session."""
    if not _models:
        _models.append(train(*labelled_pages()))
    return _models[0]


def extracted(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text (empty if none) and n_chars of every page; null html is an empty page.

    White space is what str.split splits at; a line break element counts as white
    space.  Rows that repeat are extracted as often.
    """
    model = model or _trained()
    used = np.flatnonzero(model.weights)
    sent = (used, model.weights[used], model.pairs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.zeros(WIDTH)
        weights[sent[0]] = sent[1]
        own = Model(weights, sent[2])
        for batch in batches:
            html = [h or "" for h in batch.column("html").to_pylist()]
            row = 0
            while row < len(html):
                end, size = row, 0
                while end < len(html) and (end == row or size + len(html[end]) <= CHUNK):
                    size += len(html[end])
                    end += 1
                found = texts(html[row:end], own)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("page_id")[row:end], batch.column("url")[row:end], pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], ["page_id", "url", "text", "n_chars"]
                )
                row = end

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")

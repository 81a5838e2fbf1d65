"""Operator 6: main text of web pages by gradient-boosted trees over DOM nodes.

A tolerant parser, linear in the page's length, builds the block-level tree of a page. Each block node gets features:
subtree and own text density, tokens of its tag and attributes, depth, sibling and ancestor statistics. Gradient-boosted
trees, trained on labelled pages that a seeded generator makes, in half of which names and tags say nothing, give each
node log-odds of being main content. Decoding is hierarchical: the labelling with the highest total is taken among those
in which no kept node has a discarded ancestor.

Pages are independent: extraction is a map without a shuffle, and the trees are a few kilobytes. They are fitted once and
kept in the shared folder.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fitted

# --- parsing -------------------------------------------------------------------------------------------------------

#: Fixed values of the HTML standard: elements without content, with raw text, and those that flow inside a line.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label map mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: An open element of the key is closed by a start tag among the values.
_BLOCKS = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CLOSED_BY = {
    "head": frozenset(["body"]), "p": _BLOCKS, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "tbody", "tfoot", "thead"]),
    "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]), "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]), "option": frozenset(["option", "optgroup"]), "thead": frozenset(["tbody", "tfoot"]), "tbody": frozenset(["tbody", "tfoot"]),
}
#: How far up an implied end reaches.
SCOPE = {"p": frozenset(["body", "td", "th", "article", "section", "div", "li", "blockquote"]), "li": frozenset(["ul", "ol", "menu"])}
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
#: Attributes up to the end of a tag, or to a quotation mark without its like.
_REST = re.compile(r"[^>\"']*+(?:(?:\"[^\"]*\"|'[^']*')[^>\"']*+)*+")
_ATTR = re.compile(r"(class|id|role|itemprop|aria-label|hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_TOKEN = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")
_DIGITS, _WORD = re.compile(r"[0-9]+"), re.compile(r"[^\W\d_]+")


class Node:
    __slots__ = ("tag", "tokens", "attrs", "parent", "children", "own", "linked", "depth", "hidden", "text_len", "link_len", "n_nodes", "commas", "digits", "blocks", "h1", "said", "words", "sign", "items")

    def __init__(self, tag: str, attrs: str, parent: Node | None):
        self.tag, self.attrs, self.parent, self.depth = tag, attrs, parent, parent.depth + 1 if parent else 0
        self.tokens: list[str] = []
        self.hidden = False
        for m in _ATTR.finditer(attrs) if attrs else ():
            name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if name == "hidden" or name == "style" and re.search(r"display\s*:\s*none", value):
                self.hidden = True
            elif name != "style":
                self.tokens += _TOKEN.findall(value)
        self.children: list[Node] = []
        self.items: list[str | Node] = []  # inline text and child blocks, in page order
        self.own = self.linked = 0
        if parent:
            parent.children.append(self)
            parent.items.append(self)

    def add(self, text: str, in_link: bool) -> None:
        self.items.append(text)
        n = len(text.strip())
        self.own += n
        self.linked += n * in_link


def markup(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, rest) in page order: ("text", "", text), ("open", name, attributes), ("close", name, "").

    What no ``>`` follows is text. Each character is passed a bounded number of times: where a search for the end of
    something finds none, none is begun behind it.
    """
    at, n, last = 0, len(page), page.rfind(">")
    sections = plain = True  # whether a CDATA section, and an unclosed quotation mark in a tag, can still end
    while at < n:
        start = page.find("<", at)
        unclosed = start > last
        if unclosed:
            start = page.find("<!--", start)  # an open comment takes the rest, all else is text
        if start < 0:
            break
        m = _NAME.match(page, start)
        mark = page[start + 1 : start + 2]
        if not unclosed and not m and mark not in ("!", "?"):
            yield "text", "", page[at : start + 1]
            at = start + 1
            continue
        if start > at:
            yield "text", "", page[at:start]
        if m:
            stop = _REST.match(page, m.end()).end() if plain else m.end()
            end = page.find(">", stop)
            if end < 0:
                plain = False
                end = page.find(">", m.end())
            if end < 0:
                yield "text", "", page[start:]
                return
            yield "close" if m[1] else "open", m[2].lower(), page[m.end() : end]
            at = end + 1
        elif page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = end + 3 if end >= 0 else n
        else:
            end = page.find("]]>", start) if sections and page.startswith("<![CDATA[", start) else -1
            if end >= 0:
                yield "text", "", html.escape(page[start + 9 : end])
                at = end + 3
            else:
                sections = sections and not page.startswith("<![CDATA[", start)
                at = page.find(">", start) + 1
        if m and not m[1] and m[2].lower() in RAW and not page.startswith("/>", at - 2):
            close = re.compile(rf"</{re.escape(m[2])}\s*>", re.I).search(page, at)
            at = close.end() if close else n
    if at < len(page):
        yield "text", "", page[at:]


def parse(page: str) -> Node:
    """The tree of block elements; the text of raw elements is dropped, inline tags are looked through."""
    root = node = Node("#page", "", None)
    links, opened = 0, Counter()  # open elements by tag

    def leave(until: Node) -> None:
        nonlocal node, links
        while node is not until:
            opened[node.tag] -= 1
            node = node.parent
        links = 0

    for kind, tag, rest in markup(page):
        if kind == "text":
            node.add(rest, links > 0)
        elif kind == "close":
            if tag == "a":
                links = max(0, links - 1)
            elif tag not in INLINE and opened[tag]:
                up = node
                while up.tag != tag:
                    up = up.parent
                leave(up.parent)
        elif tag == "br" or tag == "wbr":
            node.items.append(" " if tag == "br" else "")
        elif tag == "a":
            links += 1
        elif tag == "hr":
            Node("hr", "", node)
        elif tag not in INLINE and tag not in VOID and tag not in RAW:
            up = node
            while up.parent:
                if tag in CLOSED_BY.get(up.tag, ()):
                    leave(up.parent)
                    up = node
                    continue
                if up.tag not in CLOSED_BY or up.tag in SCOPE.get(tag, ()):
                    break
                up = up.parent
            node = Node(tag, rest, node)
            opened[tag] += 1
    return root


# --- features ------------------------------------------------------------------------------------------------------

#: Attribute tokens and tags that speak for and against content, by kind.
TOKENS = {
    "content": "article body content entry main post story text".split(),
    "menu": "breadcrumb breadcrumbs links menu nav navbar navigation pager pagination tabs toc".split(),
    "edge": "banner bottom copyright footer header masthead top".split(),
    "side": "aside related rail recommended sidebar widget".split(),
    "advert": "ad ads adsbox advert advertisement promo promoted sponsor sponsored".split(),
    "notice": "alert cookie cookies consent dialog gdpr modal newsletter notice overlay popup subscribe".split(),
    "comment": "comment comments discussion disqus replies reply respond".split(),
    "social": "like share sharing social tweet".split(),
    "form": "form login search signup".split(),
}
_KIND = {t: k for k, ts in TOKENS.items() for t in ts}
TAGS = ("p", "h", "li", "list", "div", "section", "article", "main", "nav", "aside", "header", "footer", "form", "table", "cell", "quote", "figure", "body", "control")
_TAG_KIND = {"ul": "list", "ol": "list", "dl": "list", "dt": "li", "dd": "li", "td": "cell", "th": "cell", "tr": "cell", "blockquote": "quote", "pre": "quote", "figcaption": "figure", "html": "body", "#page": "body", "button": "control", "select": "control", "option": "control", "fieldset": "form", **{f"h{k}": "h" for k in range(1, 7)}}
_BAD_TAGS = {"nav", "aside", "footer", "form", "button", "select", "option", "dialog", "menu", "svg", "head", "object"}
#: Words that boilerplate of one short block says.
SAYINGS = frozenset("accept advertisement alle all answer antworten archive aviso accueil anmelden categories comment comments commentaires comentarios contact contacto consent cookie cookies copyright datenschutz derechos droits impressum inicio kommentar kommentare kontakt like login mentions más menu moins newsletter next página page por prev previous privacy publicidad publicité rechte register related reply répondre reservados responder reserved réservés rights share sign sponsored startseite subscribe suche tags teilen terms tweet vorbehalten werbung".split())
#: Characters of a node that is read for them, and of one that counts as short.
SAID_LENGTH, SHORT = 400, 60
NUMBERS = (
    "depth", "text", "own", "link_share", "text_per_node", "commas_per_text", "share_of_page", "index", "siblings", "sibling_text", "same_tag", "before", "bad", "good_above", "bad_token", "header_in_content", "hidden",
    "digits", "copyright", "said", "same_shape", "headed", "h1_inside", "after_h1", "mean_block", "share_of_parent", "links_per_node", "heading_said", "short_siblings",
)
NAMES = [*NUMBERS, *(f"token_{k}" for k in TOKENS), *(f"tag_{t}" for t in TAGS)]


def ordered(root: Node) -> list[Node]:
    """Nodes in page order, parents first."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack += reversed(node.children)
    return out


def matrix(nodes: list[Node]) -> np.ndarray:
    for node in nodes:
        node.text_len, node.link_len, node.n_nodes = node.own, node.linked, 1
        own = [x for x in node.items if isinstance(x, str)]
        node.commas = sum(x.count(",") + x.count(".") for x in own)
        node.digits = sum(map(len, _DIGITS.findall("".join(own))))
        node.blocks, node.h1 = int(node.own > 0), int(node.tag == "h1")
        node.said = node.words = node.sign = 0
        if 0 < node.own <= SAID_LENGTH:
            text = html.unescape(" ".join(own)).lower()
            words = _WORD.findall(text)
            node.said, node.words, node.sign = sum(w in SAYINGS for w in words), len(words), int("©" in text or "(c)" in text)
    for node in reversed(nodes):
        if node.parent:
            p = node.parent
            p.text_len, p.link_len, p.n_nodes, p.commas = p.text_len + node.text_len, p.link_len + node.link_len, p.n_nodes + node.n_nodes, p.commas + node.commas
            p.digits, p.blocks, p.h1 = p.digits + node.digits, p.blocks + node.blocks, p.h1 | node.h1
            p.said, p.words, p.sign = p.said + node.said, p.words + node.words, p.sign | node.sign
    total = max(nodes[0].text_len, 1)
    x = np.zeros((len(nodes), len(NAMES)))
    above: dict[int, tuple[int, int, int]] = {id(nodes[0]): (0, 0, 0)}
    numbers = {id(c): k for node in nodes for k, c in enumerate(node.children)}
    shapes = {id(node): (node.tag, *(c.tag for c in node.children[:6])) for node in nodes}
    tallies = {id(node): Counter(c.tag for c in node.children) for node in nodes}
    alike = {id(node): Counter(shapes[id(c)] for c in node.children) for node in nodes}
    short = {id(node): sum(c.text_len < SHORT for c in node.children) for node in nodes}
    headings: dict[int, tuple[float, float]] = {}  # whether a heading is among the siblings before, what the last one says
    for node in nodes:
        heading = (0.0, 0.0)
        for c in node.children:
            headings[id(c)] = heading
            if _TAG_KIND.get(c.tag) == "h":
                heading = (1.0, sayings(c)[0])
    seen = seen_h1 = 0
    first_token = len(NUMBERS)
    first_tag = first_token + len(TOKENS)
    kinds = list(TOKENS)
    for i, node in enumerate(nodes):
        p = node.parent
        bad, good, token = above[id(node)]
        own_kinds = {_KIND[t] for t in node.tokens if t in _KIND}
        own_bad = node.tag in _BAD_TAGS or node.tag == "header" and not good
        inherit = (int(bad or own_bad), int(good or node.tag in ("article", "main") or "content" in own_kinds and node.tag != "body"), int(token or bool(own_kinds - {"content"})))
        for c in node.children:
            above[id(c)] = inherit
        n_sib = len(p.children) if p else 1
        same = tallies[id(p)].get(node.tag, 1) if p else 1
        sib_text = (p.text_len - node.text_len) / max(n_sib - 1, 1) if p else 0
        said = sayings(node)
        x[i, : len(NUMBERS)] = (
            node.depth, np.log1p(node.text_len), np.log1p(node.own), node.link_len / max(node.text_len, 1), np.log1p(node.text_len / node.n_nodes), node.commas / max(node.text_len, 1), node.text_len / total,
            numbers.get(id(node), 0), n_sib, np.log1p(sib_text), same / n_sib, seen / total, inherit[0], good, inherit[2], float(node.tag == "header" and good), node.hidden,
            node.digits / max(node.text_len, 1), said[1], said[0], alike[id(p)][shapes[id(node)]] / n_sib if p else 1, headings.get(id(node), (0, 0))[0], node.h1, float(seen_h1 > 0), np.log1p(node.text_len / max(node.blocks, 1)), node.text_len / max(p.text_len, 1) if p else 1,
            node.link_len / node.n_nodes, headings.get(id(node), (0, 0))[1], short[id(p)] / n_sib if p else 0,
        )
        for k in own_kinds:
            x[i, first_token + kinds.index(k)] = 1
        kind = _TAG_KIND.get(node.tag, node.tag)
        if kind in TAGS:
            x[i, first_tag + TAGS.index(kind)] = 1
        seen += node.own
        seen_h1 += node.tag == "h1"
    return x


def sayings(node: Node) -> tuple[float, float]:
    """(share of words of boilerplate, whether there is a copyright sign) in a node with little text; else zeros."""
    if not 0 < node.text_len <= SAID_LENGTH:
        return 0.0, 0.0
    return node.said / max(node.words, 1), float(node.sign)


# --- training ------------------------------------------------------------------------------------------------------

#: Bytes of pages whose nodes are scored at once.
PAGE_BYTES = 1_000_000
#: The bound of the training set, and the size of the model.
TRAINING_PAGES, ROUNDS, DEPTH = 1000, 24, 5
#: Of the training pages, parser, features and trees: fitted ones are kept under it.
VERSION = f"3-{TRAINING_PAGES}-{ROUNDS}-{DEPTH}"


def training_page(rng: random.Random) -> str:
    """A page whose content elements carry the attribute ``data-y``; layouts, tags and tokens vary. In half of the pages
    no tag and no name tells what is content: boxes are ``div``, ``td`` or ``p`` with names of no meaning or without."""
    plain = rng.random() < 0.45
    syllables = [a + b for a in "b d f g k l m n p r s t v th sch qu".split() for b in ("a", "e", "i", "o", "u", "en", "er", "ion")]
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 4)))
    number = lambda: rng.choice([str(rng.randint(0, 99)), str(rng.randint(1900, 2030)), f"{rng.randint(1, 28)}.{rng.randint(1, 12)}.{rng.randint(1990, 2025)}", f"{rng.randint(1, 999)},{rng.randint(0, 99)}", f"{rng.randint(1, 99)}%"])
    numeric = rng.choice([0.0, 0.03, 0.15])  # some pages are full of numbers, and all words also occur in content
    any_word = lambda: number() if rng.random() < numeric else rng.choice(sorted(SAYINGS)) if rng.random() < 0.02 else word()
    words = lambda lo, hi: " ".join(any_word() for _ in range(rng.randint(lo, hi)))
    sentence = lambda lo, hi: words(lo, hi).capitalize() + rng.choice(["."] * 6 + ["!", "?", ""])
    prose = lambda: " ".join(sentence(1, 22) for _ in range(rng.choice([1, 1, 1, 2, 3, 5, 8])))
    says = lambda k=1: " ".join(rng.choice(sorted(SAYINGS)) if rng.random() < 0.8 else word() for _ in range(k))
    link = lambda text=None: f'<a href="/{word()}">{text or word()}</a>'
    any_of = lambda *options: rng.choice(options)()
    name = lambda: rng.choice([f"x{rng.randint(1, 99)}", f"css-{rng.randint(0, 2**24):x}", word(), "row", "col", "inner"])

    def box(kind: str, inner: str, tags: tuple[str, ...] = ("div", "section", "aside")) -> str:
        if plain:
            t = rng.choice(["div", "div", "div", "section", "p" if "<p" not in inner and "<div" not in inner and "<ul" not in inner else "div"])
            return f"<{t}{rng.choice(['', f' class={name()}', f' id={chr(34)}{name()}{chr(34)}'])}>{inner}</{t}>"
        t = rng.choice(tags)
        return f'<{t} {rng.choice(["class", "id"])}="{rng.choice(TOKENS[kind])}">{inner}</{t}>'

    def links(n: int) -> str:
        if plain and rng.random() < 0.7:
            between = rng.choice([" | ", " ", "<br>", " &middot; ", "", ", "])
            return between.join(link(rng.choice([None, None, says()])) for _ in range(n))
        return "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(n)) + "</ul>"

    def comment() -> str:
        head = f"{word()}{rng.choice([', ', ' ', ' - '])}{rng.randint(1, 28)}.{rng.randint(1, 12)}.20{rng.randint(10, 25)} {rng.randint(0, 23)}:{rng.randint(10, 59)}"
        said = rng.choice([f"<p>{prose()}</p>", f"<div>{sentence(2, 20)}</div>", f"<p>{sentence(2, 20)}</p>"])
        return rng.choice([f"<div>{said}</div>", f"<div><b>{word()}</b> {said}</div>", f"<div><p>{head}</p>{said}<a href=#>{says()}</a></div>", f"<div><span>{head}</span>{said}</div>", f"<li>{said}</li>"])

    def comments() -> str:
        head, level = "", rng.randint(2, 4)
        if rng.random() < (0.5 if plain else 0.2):
            head = f"<h{level}>{rng.choice(['', '3 ', '12 '])}{says()}</h{level}>"
        return box("comment", head + "".join(comment() for _ in range(rng.randint(1, 6))))

    copyright_line = lambda: rng.choice(["&copy;", "©", "Copyright ©", "(c)"]) + f" {rng.choice(['', '2019 ', '2024 '])}{word()}.{rng.choice(['example', 'org'])} {rng.choice(['', '&middot; ', '| ', '- '])}{rng.choice([sentence(1, 14), says(3)])}"
    def linked() -> str:
        """The rest of a paragraph, with links in it."""
        return "".join(f" {link()} {words(0, 9)}" for _ in range(rng.choice([1, 1, 2, 4, 8]))) + f" {sentence(1, 6)}"

    def headed(inner: str) -> str:
        k = rng.randint(2, 4)
        return f"<h{k}>{rng.choice([says(), sentence(1, 4)])}</h{k}>{inner}"

    def boilerplate(where: str) -> str:
        menu = lambda: box("menu", links(rng.randint(2, 9)))
        notice = lambda: box("notice", rng.choice([f"<p>{prose()} {says(2)}</p><button>{says()}</button>", f"{sentence(3, 12)} {says(3)} {link(says())}"]))
        form = lambda: box("form", f'<form><input name="q"><button>{word()}</button></form>')
        logo = lambda: box("edge", rng.choice([link(), f"<b>{word()}</b>", f"{words(1, 3)} {link()}"]))
        advert = lambda: box("advert", sentence(3, 14))
        edge = lambda: box("edge", rng.choice([f"<p>{copyright_line()}</p>", copyright_line(), f"{copyright_line()} {links(rng.randint(1, 4))}"]))
        side = lambda: box("side", headed(rng.choice([links(rng.randint(2, 8)), f"<p>{sentence(3, 14)}</p>" if plain else f"<p>{prose()}</p>"])))
        social = lambda: box("social", rng.choice([links(rng.randint(1, 4)), f"{says()}: {links(rng.randint(1, 5))}"]))
        if plain:
            top, end = [menu, menu, menu, notice, form, logo, advert], [edge, edge, edge, side, side, comments, comments, comments, social, menu]
        else:
            top = [lambda: f"<nav>{links(rng.randint(2, 9))}</nav>", lambda: f"<header><h1>{sentence(1, 4)}</h1>{links(rng.randint(0, 5))}</header>", menu, notice, advert, form]
            end = [lambda: f"<footer>{copyright_line()}</footer>", lambda: f"<footer>&copy; {word()}.example &middot; {sentence(2, 14)}</footer>", lambda: f"<footer><p>{sentence(2, 10)}</p>{links(rng.randint(0, 4))}</footer>", lambda: box("edge", f"<p>{sentence(2, 10)}</p>"), edge, lambda: f"<aside>{headed(links(rng.randint(2, 8)))}</aside>", side, comments, social, lambda: box("advert", f"<p>{sentence(3, 14)}</p>")]
        return "".join(any_of(*(top if where == "top" else end)) for _ in range(rng.randint(1, 4)))

    def content(k: int) -> str:
        # Content is marked; what interrupts it is not.
        kind = rng.random()
        if k == 0 and kind < 0.8:
            level = rng.choice([1, 1, 1, 1, 1, 2])
            return f"<h{level} data-y>{sentence(2, 12)}</h{level}>"
        if kind < 0.66:
            return f"<p data-y>{rng.choice(['', '<b>', '<em>'])}{prose()}{rng.choice(['', '', '<br>', linked(), linked()])}" + rng.choice(["</p>", "</p>", "\n"])
        if kind < 0.74:
            level = rng.randint(2, 4)
            return f"<h{level} data-y>{sentence(1, 8)}</h{level}><p data-y>{prose()}</p>"
        if kind < 0.79:
            return "<ul data-y>" + "".join(f"<li data-y>{sentence(1, 12)}</li>" for _ in range(rng.randint(2, 5))) + "</ul>"
        if kind < 0.83:
            return f"<blockquote data-y><p data-y>{prose()}</p></blockquote>"
        if kind < 0.86:
            return "<table data-y>" + "".join(f"<tr data-y><td data-y>{word()}</td><td data-y>{sentence(1, 5)}</td></tr>" for _ in range(rng.randint(1, 4))) + "</table>"
        if kind < 0.89:
            return f"<pre data-y>{word()} = {word()}</pre>"
        if kind < 0.94:
            if plain:
                return box("social", f"{says(2)} {links(rng.randint(1, 4))}")
            return box(rng.choice(["advert", "social", "side", "notice"]), f"<p>{sentence(2, 14)}</p>")
        return f"<div data-y><p data-y>{prose()}</p></div>"

    body = "".join(content(k) for k in range(rng.choice([1, 2, 4, 6, 9, 14] * 4 + [40, 90])))
    if rng.random() < 0.05:
        body += f"<p data-y>{sentence(1, 4)}</p>" * rng.randint(3, 30)
    if rng.random() < 0.1:
        body += "<br><br>".join(f" {prose()} {prose()} " for _ in range(rng.randint(2, 5)))
    if plain:
        attribute = rng.choice(["", f' class="{name()}"', f" id={name()}"])
        holder = rng.choice(["<div data-y%s>{}</div>", "<div data-y%s>{}</div>", "<section data-y%s>{}</section>", "<div data-y><div data-y%s>{}</div></div>", "{}"]).replace("%s", attribute)
        inside = holder.replace("{}", body)
        if rng.random() < 0.35:
            cell = lambda inner, mark="": f"<td{mark}>{inner}</td>"
            cells = [cell(links(rng.randint(2, 9))), cell(inside, " data-y")] + [cell(headed(links(rng.randint(2, 6))))] * rng.randint(0, 1)
            if rng.random() < 0.3:
                cells = cells[1:]
            above = f"<tr><td>{any_of(word, lambda: links(4))}</td></tr>" * rng.randint(0, 1)
            below = f"<tr><td>{copyright_line()}</td></tr>" * rng.randint(0, 1)
            page = boilerplate("top") * rng.randint(0, 1) + f"<table data-y>{above}<tr data-y>{''.join(cells)}</tr>{below}</table>" + boilerplate("end") * rng.randint(0, 1)
        else:
            page = boilerplate("top") + inside + boilerplate("end")
    else:
        holder = rng.choice(["<article data-y>{}</article>"] * 4 + ["<main data-y>{}</main>", "<main data-y><article data-y>{}</article></main>", '<div data-y class="content">{}</div>', '<div data-y id="main"><div data-y class="post entry">{}</div></div>', "<section data-y>{}</section>", "<div data-y>{}</div>"])
        page = boilerplate("top") + holder.replace("{}", body) + boilerplate("end")
    if rng.random() < 0.3:
        page = f'<div data-y class="{rng.choice(["page", "wrapper", "container", "layout", name()])}">{page}</div>'
    return f"<!DOCTYPE html><html data-y><head><title>{sentence(2, 9)}</title><style>p{{margin:0}}</style></head><body data-y>{page}" + rng.choice(["</body></html>", ""])


def marks(nodes: list[Node]) -> np.ndarray:
    """Which nodes of a training page are content; the mark is no feature."""
    return np.array([node.parent is None or "data-y" in node.attrs for node in nodes])


def training_nodes(pages: int = TRAINING_PAGES, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    rng, xs, ys = random.Random(seed), [], []
    for _ in range(pages):
        nodes = ordered(parse(training_page(rng)))
        xs.append(matrix(nodes))
        ys.append(marks(nodes))
    return np.concatenate(xs), np.concatenate(ys)


class Trees:
    """The boosted trees as arrays, for scoring in tasks: log-odds of content."""

    def __init__(self, spark: SparkSession):
        saved = fitted(spark, "html-trees", fit_trees, VERSION)
        self.weights = saved["weights"]
        self.trees = [tuple(np.array(c) for c in columns) for columns in saved["trees"]]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for w, (feature, threshold, left, right, value) in zip(self.weights, self.trees, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                inner = left[at] >= 0
                at = np.where(inner, np.where(x[rows, feature[at]] <= threshold[at], left[at], right[at]), at)
            total += w * value[at]
        return 2 * total  # the model's loss is on twice the margin


def fit_trees(spark: SparkSession) -> dict:
    """Weights and, of each tree, the columns feature, threshold, left, right, value."""
    x, y = training_nodes()
    rows = [(k, float(t), Vectors.dense(v)) for k, (t, v) in enumerate(zip(y, x, strict=True))]
    # The same rows in the same order in each of four partitions, whatever the cluster: the same trees.
    table = spark.createDataFrame(rows, ["k", "label", "features"]).repartition(4, "k").sortWithinPartitions("k").select("label", "features")
    model = GBTClassifier(maxIter=ROUNDS, maxDepth=DEPTH, stepSize=0.3, seed=3).fit(table)
    trees = []
    for t in model.trees:
        nodes: list[tuple[int, float, int, int, float]] = []

        def walk(node, nodes=nodes) -> int:
            k = len(nodes)
            nodes.append((0, 0.0, -1, -1, node.prediction()))
            if node.subtreeDepth():
                split = node.split()
                left, right = walk(node.leftChild()), walk(node.rightChild())
                nodes[k] = (split.featureIndex(), split.threshold(), left, right, 0.0)
            return k

        walk(t._call_java("rootNode"))
        trees.append([list(c) for c in zip(*nodes, strict=True)])
    return {"weights": list(model.treeWeights), "trees": trees}


# --- decoding ------------------------------------------------------------------------------------------------------


def decode(nodes: list[Node], score: np.ndarray) -> set[int]:
    """ids of kept nodes: the best labelling in which every kept node's parent is kept. The page itself is always kept."""
    number = {id(n): i for i, n in enumerate(nodes)}
    keep, drop = score.copy(), -score.copy()
    for i in range(len(nodes) - 1, 0, -1):
        p = number[id(nodes[i].parent)]
        keep[p] += max(keep[i], drop[i])
        drop[p] += drop[i]
    kept = {id(nodes[0])}
    for i, node in enumerate(nodes[1:], 1):
        if id(node.parent) in kept and keep[i] > drop[i] and not node.hidden:
            kept.add(id(node))
    return kept


def text_of(root: Node, kept: set[int]) -> str:
    """The blocks of kept nodes in page order, one a line; a block is the inline text between two block tags."""
    out: list[str] = []
    stack: list = [iter(root.items)]
    line: list[str] = []

    def flush() -> None:
        text = _SPACE.sub(" ", html.unescape("".join(line))).strip()
        line.clear()
        if text:
            out.append(text)

    while stack:
        item = next(stack[-1], None)
        if item is None:
            stack.pop()
            flush()
        elif isinstance(item, str):
            line.append(item)
        else:
            flush()
            if id(item) in kept:
                stack.append(iter(item.items))
    return "\n".join(out)


def extract(page: str | None, trees: Trees) -> str:
    if not page:
        return ""
    root = parse(page)
    nodes = ordered(root)
    return text_of(root, decode(nodes, trees.score(matrix(nodes))))


def _extractor(trees):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = trees.value
        for batch in batches:
            for part in _slices(batch):
                texts = _extract_many(part.column("html").to_pylist(), model)
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return run


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of about PAGE_BYTES each; a longer page is one of its own."""
    at = size = 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(batch.column("html")), 0).to_pylist()):
        size += n
        if size >= PAGE_BYTES:
            yield batch.slice(at, i + 1 - at)
            at, size = i + 1, 0
    if at < batch.num_rows:
        yield batch.slice(at)


def _extract_many(pages: list[str | None], trees: Trees) -> list[str]:
    """As ``extract`` for each page, with the nodes of all pages scored at once."""
    roots = [parse(p) if p else None for p in pages]
    lists = [ordered(r) if r else [] for r in roots]
    xs = [matrix(n) for n in lists if n]
    scores = trees.score(np.concatenate(xs)) if xs else np.empty(0)
    out, at = [], 0
    for root, nodes in zip(roots, lists, strict=True):
        out.append(text_of(root, decode(nodes, scores[at : at + len(nodes)])) if root else "")
        at += len(nodes)
    return out


def extract_pages(pages: DataFrame) -> DataFrame:
    """One row per row of ``pages(page_id long, url, html, ...)``: page_id, url, text, n_chars.

    text is the main text: character references decoded, white space inside a block made one space, blocks trimmed and
    joined by line feeds in page order; empty if there is none, or the html is null or empty. n_chars counts its code
    points. Broken markup is read as browsers would, as far as end tags go. Null ids and urls stay null; repeated rows are
    extracted alike; equal sums keep the smaller labelling; other columns are ignored; an empty table gives an empty result.
    A very long or malformed page is parsed in time in proportion to its length; its nodes are held by one task.
    """
    trees = pages.sparkSession.sparkContext.broadcast(Trees(pages.sparkSession))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return rows.mapInArrow(_extractor(trees), "page_id long, url string, text string, n_chars long")

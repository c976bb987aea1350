"""Main text of web pages by gradient-boosted trees over DOM nodes.

A tolerant parser builds the tree; text that stands loose between blocks becomes a node of its own. Every node gets features: tag, tokens of
its class, id and role, depth, sibling statistics, text and link density of its subtree and of its parent's. Boosted trees give the log-odds
that its own text is content. Decoding is hierarchical: over the whole tree, each node is kept or dropped so that the sum of log-odds, each
weighed by the text that the node itself holds, is largest, where a dropped node drops all that it holds; so no kept node lies under a
dropped one. Kept text comes out in blocks, in page order.

A class name of several words is read as one: ``tag-social`` or ``has-comments`` says what an article is about or has, not that it is a
list of tags or of comments. No name decides alone; the model is fitted on generated pages with known content, in many layouts, where
containers of content carry such names too.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import trees

_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?/][^<>]*+>", re.S)
_ATTR = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_TOKEN = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements whose text is never shown.
RAW = frozenset("script style noscript template iframe object svg canvas math textarea title".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: What an opening tag closes, and where the search for it stops.
CLOSES = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}
PARAGRAPH_ENDS = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())


class Node:
    __slots__ = ("tag", "attrs", "parent", "kids", "index")

    def __init__(self, tag, attrs, parent):
        self.tag, self.attrs, self.parent, self.kids, self.index = tag, attrs, parent, [], 0


def parse(page: str) -> Node:
    """The page's tree. ``kids`` mix nodes and strings; character references in strings are decoded. Never fails: what isn't markup is text."""
    root = now = Node("#page", "", None)
    open_ = Counter()  # open elements by tag, so that an end without a beginning costs nothing
    at = 0
    find = _MARKUP.search
    last = page.rfind(">") + 1  # no markup ends behind it, but a comment that nothing ends may begin there
    if (comment := page.find("<!--", last)) >= 0:
        page = page[:comment]

    def close(node: Node) -> Node:
        """Closes all that is open up to ``node`` and returns what holds it."""
        n = now
        while n is not node:
            open_[n.tag] -= 1
            n = n.parent
        open_[n.tag] -= 1
        return n.parent

    while True:
        m = find(page, at, last) if at < last else None
        if m is None:
            break
        if m.start() > at:
            now.kids.append(entities.unescape(page[at : m.start()]))
        at = m.end()
        tag = m[2]
        if tag is None:
            if m[0].startswith("<!--") and not m[0].endswith("-->"):
                at = len(page)
            continue
        tag = tag.lower()
        if m[1]:
            if open_[tag] > 0:
                n = now
                while n.tag != tag:
                    n = n.parent
                now = close(n)
            continue
        if tag in PARAGRAPH_ENDS and open_["p"] > 0:
            n = now
            while n is not root and n.tag in INLINE:
                n = n.parent
            if n.tag == "p":
                now = close(n)
        elif tag in CLOSES:
            ends, stop = CLOSES[tag]
            ends = ends.split()
            n, top = now, None
            while n is not root and n.tag not in stop and any(open_[e] for e in ends):
                if n.tag in ends:
                    top = n
                n = n.parent
            if top is not None:
                now = close(top)
        node = Node(tag, m[3], now)
        now.kids.append(node)
        if tag in VOID or m[3].endswith("/"):
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        open_[tag] += 1
        now = node
    if at < len(page):
        now.kids.append(entities.unescape(page[at:]))
    return root


#: The tag of a run of text and inline elements between blocks.
LOOSE = "#text"


def _runs_on(kid) -> bool:
    return isinstance(kid, str) or kid.tag in INLINE or kid.tag in RAW or kid.tag == "br"


def wrap_loose(root: Node) -> Node:
    """The tree, with runs of text beside blocks, or in the page itself, as nodes that can be judged; blank runs stay as they are."""
    stack = [root]
    while stack:
        x = stack.pop()
        inner = [k for k in x.kids if not isinstance(k, str)]
        stack += inner
        if x.tag in INLINE or x.tag == "head" or not (x.tag in ("#page", "html", "body") or any(not _runs_on(k) for k in inner)):
            continue
        kids: list = []
        run: list = []

        def close():
            if any((not k.isspace()) if isinstance(k, str) else k.tag in INLINE for k in run):
                node = Node(LOOSE, "", x)
                node.kids = list(run)
                for k in run:
                    if not isinstance(k, str):
                        k.parent = node
                kids.append(node)
            else:
                kids.extend(run)
            run.clear()

        for k in x.kids:
            if _runs_on(k):
                run.append(k)
            else:
                close()
                kids.append(k)
        close()
        x.kids = kids
    return root


def elements(root: Node) -> list[Node]:
    """All element nodes, parents first, in page order; their ``index`` is set."""
    out, stack = [], [root]
    while stack:
        n = stack.pop()
        n.index = len(out)
        out.append(n)
        stack += [k for k in reversed(n.kids) if not isinstance(k, str)]
    return out


#: Tokens of class, id and role that name parts of a page; fixed values.
_BOILER = frozenset("ad ads advert advertisement adverts banner sponsor sponsored promo promoted nav navbar navigation menu breadcrumb breadcrumbs sidebar aside widget footer header masthead topbar bottom cookie cookies consent gdpr notice notification alert popup modal overlay subscribe newsletter signup login search form share sharing social related recommended more tags tag pagination pager copyright legal disclaimer toolbar rail skip".split())
_COMMENT = frozenset("comment comments commentlist disqus reply replies respond discussion reader readers feedback review reviews thread".split())
_CONTENT = frozenset("article content main post entry story body text page prose blog single hentry copy".split())
#: First words of names that say what an element is about or has; fixed values.
_ABOUT = frozenset("tag category cat topic has with without no is type format status author series layout".split())
_TAGS = ("article", "main", "section", "div", "p", "ul", "ol", "li", "nav", "header", "footer", "aside", "form", "table", "a", "span", "figure", "blockquote", "button", "select")
_MARKS = frozenset("nav footer aside form header".split())
_HEADS = frozenset("h1 h2 h3 h4 h5 h6".split())
FEATURES = (
    *(f"is_{t}" for t in _TAGS), "is_heading", "is_inline", "is_loose", "is_hidden", "boiler", "comment", "content", "about", "up_boiler", "up_comment", "up_content", "up_article",
    "depth", "size", "share", "link_share", "parent_link_share", "own_size", "kids", "siblings", "alike", "place", "blocks", "sentences",
    "boiler_above", "comment_above", "heads", "comments_within", "parent_share", "parent_sentences", "up_mark", "mark_above", "main_elsewhere", "content_elsewhere", "prose_elsewhere", "after_heading", "links_only", "sentence_links", "marks_inside",
)
_AT = {name: k for k, name in enumerate(FEATURES)}


@lru_cache(maxsize=20_000)
def _named(attrs: str) -> tuple[int, int, int, int, bool]:
    """(boiler, comment, content, about, hidden) of an element's attributes."""
    named = {a.lower(): b or c or d or "" for a, b, c, d in _ATTR.findall(attrs)}
    found = [0, 0, 0]
    about = 0
    for name in " ".join(named.get(a, "") for a in ("class", "id", "role", "itemprop", "aria-label")).split():
        words = _TOKEN.findall(_CAMEL.sub("-", name).lower())
        if len(words) > 1 and words[0] in _ABOUT:
            about += 1
        else:
            counts = [sum(w in known for w in words) for known in (_BOILER, _COMMENT, _CONTENT)]
            if counts[0] or counts[1]:
                counts[2] = 0  # the content of a sidebar, the footer of a post
            found = [a + b for a, b in zip(found, counts)]
    style = named.get("style", "").replace(" ", "").lower()
    hidden = "display:none" in style or "visibility:hidden" in style or named.get("aria-hidden") == "true" or re.search(r"(?:^|\s)hidden(?:\s|=|/|$)", attrs) is not None
    return (*found, about, hidden)


def featurize(nodes: list[Node]) -> np.ndarray:
    """A row of FEATURES for each node. Ancestors with a boiler or comment name, or a tag that says so, are known by their number and by the share of the page's text that the nearest holds.

    What a name is worth depends on the rest of the page: a thread is its content where there is no article, and comments where there is one. So nodes also
    know how much text stands in articles, in elements named as content, and in paragraphs of plain elements, outside of their own branch.
    """
    n = len(nodes)
    f = np.zeros((n, len(FEATURES)), np.float32)
    size, link, own, stops, blocks, heads, within = ([0.0] * n for _ in range(7))
    names = [_named(x.attrs) if x.attrs else (0, 0, 0, 0, False) for x in nodes]
    for k in range(n - 1, -1, -1):  # children before parents
        x = nodes[k]
        for c in x.kids:
            if isinstance(c, str):
                m = len(c)
                if m and not c.isspace():
                    own[k] += m
                    stops[k] += c.count(". ") + c.count(", ") + c.endswith(".")
            else:
                j = c.index
                size[k] += size[j]
                link[k] += link[j]
                stops[k] += stops[j]
                blocks[k] += blocks[j] + (c.tag not in INLINE)
                heads[k] += heads[j] + (c.tag in _HEADS)
                within[k] += within[j] if not names[j][1] else 0.0
        size[k] += own[k]
        if x.tag == "a":
            link[k] = size[k]
        if names[k][1]:
            within[k] = size[k]
    t = _AT["is_heading"]
    whole = size[0] or 1.0
    up = [(0, 0, 0, 0, 0, 0.0, 0.0, 0, 0.0, 0)] * n
    # text in the topmost articles, elements named as content, and paragraphs under no name or tag of another kind: below each node, and in all
    marked, branch = [[0.0] * n for _ in range(3)], [[False] * n for _ in range(3)]
    aside = [False] * n
    for k, x in enumerate(nodes):
        j = x.parent.index if x.parent is not None else -1
        aside[k] = (j >= 0 and aside[j]) or x.tag in _MARKS or (names[k][0] > 0 or names[k][1] > 0) and x.tag not in ("article", "main", "body", "html")
        for z, is_it in enumerate((x.tag in ("article", "main") and not aside[k], names[k][2] > 0 and not aside[k] and x.tag not in ("body", "html"), x.tag in ("p", LOOSE) and not aside[k])):
            branch[z][k] = is_it or (j >= 0 and branch[z][j])
            if is_it and not (j >= 0 and branch[z][j]):
                marked[z][k] = size[k]
    for k in range(n - 1, 0, -1):
        for z in range(3):
            marked[z][nodes[k].parent.index] += marked[z][k] if not branch[z][nodes[k].parent.index] else 0.0
    totals = [m[0] for m in marked]
    for k, x in enumerate(nodes):
        row = f[k]
        if x.tag in _TAGS:
            row[_TAGS.index(x.tag)] = 1
        boiler, comment, content, about, hidden = names[k]
        p = x.parent
        if p is not None:
            b, c, d, e, depth, bs, cs, g, gs, inside = up[p.index]
            j = p.index
            row[_AT["parent_link_share"]] = link[j] / (size[j] or 1.0)
            row[_AT["siblings"]] = len(p.kids)
            row[_AT["parent_share"]] = size[j] / whole
            row[_AT["parent_sentences"]] = stops[j] / (1.0 + size[j] / 50.0)
        else:
            b = c = d = e = depth = g = inside = 0
            bs = cs = gs = 0.0
        mine = size[k] / whole
        row[t : t + 13] = (x.tag in _HEADS, x.tag in INLINE, x.tag == LOOSE, hidden, boiler, comment, content, about, b, c, d, e, depth)
        row[t + 13 : t + 16] = np.log1p(size[k]), mine, link[k] / (size[k] or 1.0)
        row[_AT["own_size"]], row[_AT["kids"]] = np.log1p(own[k]), len(x.kids)
        row[_AT["blocks"]] = np.log1p(blocks[k])
        row[_AT["sentences"]] = stops[k] / (1.0 + size[k] / 50.0)
        row[_AT["boiler_above"]], row[_AT["comment_above"]] = bs, cs
        row[_AT["heads"]], row[_AT["comments_within"]] = np.log1p(heads[k]), within[k] / (size[k] or 1.0)
        mark = x.tag in _MARKS
        row[_AT["up_mark"]], row[_AT["mark_above"]] = g, gs
        # names and tags of other parts below the nearest element that is, or is named as, content
        inside = 0 if x.tag in ("article", "main") or content else inside + (boiler + comment > 0 or mark)
        row[_AT["marks_inside"]] = inside
        for z, name in enumerate(("main_elsewhere", "content_elsewhere", "prose_elsewhere")):
            row[_AT[name]] = 0.0 if z < 2 and branch[z][k] else (totals[z] - (size[k] if branch[z][k] else marked[z][k])) / whole
        row[_AT["links_only"]] = size[k] > 0 and link[k] >= 0.9 * size[k]
        row[_AT["sentence_links"]] = stops[p.index] / (1.0 + link[p.index] / 20.0) if p is not None else 0.0
        up[k] = (max(b, boiler + mark), max(c, comment), max(d, content), max(e, x.tag in ("article", "main")), depth + 1, mine if boiler + mark else bs, mine if comment else cs, max(g, mark), mine if mark else gs, inside)
    for x in nodes:  # sibling statistics
        kids = [c for c in x.kids if not isinstance(c, str)]
        if kids:
            tags: dict[str, int] = {}
            for c in kids:
                tags[c.tag] = tags.get(c.tag, 0) + 1
            for i, c in enumerate(kids):
                f[c.index, _AT["alike"]] = tags[c.tag] / len(kids)
                f[c.index, _AT["place"]] = i / len(kids)
                f[c.index, _AT["after_heading"]] = i > 0 and kids[i - 1].tag in _HEADS
    return f


def decode(nodes: list[Node], odds: np.ndarray) -> np.ndarray:
    """Which nodes are kept: the choice of largest sum (a node counts its odds if kept, minus them if dropped) in which dropped nodes hold no kept ones."""
    n = len(nodes)
    own = odds.astype(float)
    own[0] = 0.0  # the page itself holds both
    keep, drop = own.copy(), -own
    for k in range(n - 1, 0, -1):
        p = nodes[k].parent.index
        keep[p] += max(keep[k], drop[k])
        drop[p] += drop[k]
    kept = np.zeros(n, bool)
    kept[0] = True
    for k in range(1, n):
        kept[k] = kept[nodes[k].parent.index] and keep[k] > drop[k]
    return kept


_SPACE = re.compile(r"\s+")


def blocks_of(root: Node, kept: np.ndarray) -> list[str]:
    """Text of the kept nodes; a block ends wherever an element that isn't inline begins or ends. A line break is white space."""
    out: list[str] = []
    part: list[str] = []

    def close():
        if part:
            s = _SPACE.sub(" ", "".join(part)).strip()
            if s:
                out.append(s)
            part.clear()

    stack: list = [root]
    while stack:
        x = stack.pop()
        if x is None:
            close()
        elif isinstance(x, str):
            part.append(x)
        elif x.tag == "br":
            part.append(" ")
        elif x.tag in RAW and x.tag != "title":
            continue  # stands in a line and shows nothing
        elif kept[x.index] and x.tag not in RAW and x.tag != "head":
            if x.tag in INLINE:
                stack += reversed(x.kids)
            else:
                close()
                stack.append(None)
                stack += reversed(x.kids)
        elif x.tag not in INLINE:
            close()
    close()
    return out


# Training pages


def _words(r: random.Random, n: int) -> str:
    bits = ("th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "nt", "ea", "ti", "to", "io", "le", "is", "ou")
    out = []
    for i in range(n):
        w = "".join(r.choice(bits) for _ in range(r.randint(1, 4)))
        out.append((w.capitalize() if i == 0 else w) + (r.choice((",", ".", "")) if r.random() < 0.15 else ""))
    return " ".join(out) + "."


#: Marks loose text as content in training pages; taken out before features are made.
_CONTENT_MARK = "\x01"


def training_page(seed: int) -> str:
    """A page in one of many layouts. Content elements carry the attribute ``data-y="1"`` and loose content text a mark, others none; the rest is known by where it stands."""
    r = random.Random(seed)
    pick = r.choice
    y = ' data-y="1"'
    cls = lambda names, p=0.8: f' {pick(("class", "class", "id"))}="{pick(names)}"' if r.random() < p else ""
    link = lambda: f'<a href="/{_words(r, 1)}">{_words(r, r.randint(1, 3))[:-1]}</a>'
    listed = lambda n: "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(n)) + "</ul>"
    listed_names = sorted(_BOILER | _COMMENT)

    def holder(names, p):
        """The class of a container of content, which may also say what the content is about or has beside it, in the same words that name other parts."""
        own = [pick(names)] if r.random() < p else []
        if r.random() < 0.4:
            for _ in range(r.randint(1, 4)):
                k = r.random()
                own.append(pick(listed_names) if k < 0.35 else f"{pick(sorted(_ABOUT))}-{pick(listed_names)}" if k < 0.8 else f"{_words(r, 1)[:-1].lower().strip(',.')}-{pick(listed_names)}")
            r.shuffle(own)
        return f' {pick(("class", "class", "class", "id"))}="{" ".join(own)}"' if own else ""

    def paragraph():
        n = pick((1, 3, 8, 20, 60, 120))
        t = _words(r, n)
        if r.random() < 0.2:
            t = f"<{(g := pick(('b', 'em', 'i', 'strong', 'span')))}{y}>{t}</{g}>" if r.random() < 0.7 else f"<b{y}>{t}<br{y}>"
        if r.random() < 0.2:
            t += f' <a href="/x"{y}>{_words(r, 2)}</a> {_words(r, 6)}'
        return f"<p{y}>{t}" + "</p>" * (r.random() < 0.9)

    def loose():
        t = _CONTENT_MARK + _words(r, pick((3, 8, 20, 60, 120)))
        for _ in range(pick((0, 0, 1, 3))):
            t += f"<br{y}>" * pick((1, 2)) + _words(r, pick((8, 30, 60)))
        if r.random() < 0.3:
            t += f' <a href="/x"{y}>{_words(r, 2)}</a> {_words(r, 6)}'
        return t

    def body():
        out = [f"<{(g := pick(('h1', 'h1', 'h2')))}{y}>{_words(r, r.randint(2, 9))}</{g}>"] if r.random() < 0.9 else []
        if out and r.random() < 0.2:
            out = [f"<header{cls(('entry-header', 'post-header'), 0.4)}{y}>{out[0]}</header>"]
        plain = r.random() < 0.12  # text without paragraphs
        linked = lambda n: f"<{(g := pick(('ul', 'ul', 'ol')))}{y}>" + "".join(f'<li{y}><a href="/s"{y}>{_words(r, pick((1, 3, 6)))[:-1]}</a></li>' for _ in range(n)) + f"</{g}>"
        even = r.random() < 0.35  # paragraphs alone
        for _ in range(pick((1, 1, 2, 3, 5, 8, 14, 24)) if not even else pick((1, 2, 3, 6, 12, 20, 30))):
            k = 0.5 if even else r.random()
            if k < 0.04:
                out.append(f'<p{y}><a href="/x"{y}>{_words(r, r.randint(1, 6))}</a></p>')
            elif k < 0.75:
                out.append(loose() + f"<br{y}><br{y}>" if plain else paragraph())
            elif k < 0.82:
                out.append(f"<h2{y}>{_words(r, 4)}</h2>")
            elif k < 0.88:
                out.append(f"<ul{y}>" + "".join(f"<li{y}>{_words(r, r.randint(2, 12))}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
            elif k < 0.9:
                out.append(f"<blockquote{y}>{paragraph()}</blockquote>")
            elif k < 0.92:
                out.append(f"<table{y}>" + "".join(f"<tr{y}><td{y}>{_words(r, 2)}</td><td{y}>{_words(r, 3)}</td></tr>" for _ in range(3)) + "</table>")
            elif k < 0.94:  # sources, reports, see also
                out.append((f"<{(g := pick(('h2', 'h3', 'h2', 'p')))}{y}>{_words(r, pick((1, 1, 2, 4)))}</{g}>" if r.random() < 0.7 else "") + linked(pick((2, 3, 4, 8, 12))))
            elif k < 0.95:
                out.append(f"<div{y}>{_words(r, pick((4, 12, 30)))}</div>")
            else:
                out.append(boiler_block())
        if r.random() < 0.15:
            out.append(f"<{(g := pick(('h2', 'h3')))}{y}>{_words(r, pick((1, 2)))}</{g}>" + linked(pick((2, 3, 4, 8))))
        return "".join(out)

    def much():
        """Text of another kind as long as articles are."""
        return (f"<h3>{_words(r, 2)}</h3>" if r.random() < 0.4 else "") + "".join(f"<p>{_words(r, pick((5, 8, 20, 40, 60)))}</p>" for _ in range(pick((2, 4, 6, 6, 9, 12, 20))))

    def boiler_block():
        k = r.randint(0, 19)
        if k in (14, 15):
            return f"<aside{cls(('sidebar', 'related', 'widget', 'right'), 0.4)}>{much()}</aside>"
        if k == 16:
            return f'<div{cls(("sidebar", "side-bar", "right-rail", "widget-area", "sidebar-content", "sideBar"), 1)}>{much()}</div>'
        if k in (17, 18):
            return f'<{(g := pick(("div", "div", "section")))}{cls(("comments", "comment-list", "disqus_thread", "reader-comments", "discussion", "replies"), 1)}>{much()}</{g}>'
        if k == 19:
            return f"<footer{cls(('entry-footer', 'footer', 'site-footer'), 0.4)}>{much()}</footer>"
        t = _words(r, pick((3, 8, 20, 40)))
        if k == 0:
            return f'<div{cls(("ad", "ads", "advert", "banner-ad", "sponsored", "ad-text", "content-ad"), 1)}>{t}</div>'
        if k == 1:
            return f"<aside{cls(('sidebar', 'related', 'widget'), 0.5)}><h3>{_words(r, 2)}</h3>{listed(r.randint(2, 6))}<p>{t}</p></aside>"
        if k == 2:
            return f'<div{cls(("sidebar", "side-bar", "right-rail", "widget-area", "sidebar-content", "sideBar"), 1)}><p>{t}</p>{listed(3)}</div>'
        if k == 3:
            return f'<div{cls(("cookie-notice", "cookie-banner", "consent", "notice", "gdpr", "alert", "cookie-text"), 1)}><p>{t}</p><button>OK</button></div>'
        if k == 4:
            return f'<form action="/s"{cls(("search", "newsletter", "login", "subscribe"), 0.5)}><label>{_words(r, 2)}</label><input type="text"><button>{_words(r, 1)}</button><p>{t}</p></form>'
        if k in (5, 6):
            posts = "".join(f'<{(g := pick(("div", "li", "article", "section")))}{cls(("comment", "comment-body", "reply"), 0.7)}><p><b>{_words(r, 1)}</b></p><p>{_words(r, pick((5, 20, 50)))}</p></{g}>' for _ in range(r.randint(1, 4)))
            return f'<{(g := pick(("div", "section", "ol")))}{cls(("comments", "comment-list", "disqus_thread", "respond", "reader-comments", "discussion"), 1)}><h3>{_words(r, 2)}</h3>{posts}</{g}>'
        if k == 7:
            return f'<div{cls(("share", "social", "share-buttons", "tags", "breadcrumbs", "pagination", "post-tags", "tag-list"), 1)}>{link()} {link()} {link()}</div>'
        if k == 8:
            return f'<div{cls(("related", "related-posts", "recommended", "more-stories"), 1)}><h3>{_words(r, 3)}</h3>{listed(4)}</div>'
        if k == 9:
            return f'<div style="display:none">{t}</div>'
        if k == 10:
            return f'<div{cls(("popup", "modal", "newsletter-signup", "promo"), 1)}><p>{t}</p></div>'
        if k == 11:
            cards = "".join(f'<{(g := pick(("article", "div", "li")))}{cls(("card", "teaser", "post"), 0.6)}><h3>{link()}</h3><p>{_words(r, pick((5, 15)))}</p></{g}>' for _ in range(r.randint(2, 4)))
            return f'<{(g := pick(("section", "div", "aside")))}{cls(("related", "more-stories", "recommended-posts", "read-more"), 1)}>{cards}</{g}>'
        if k == 12:
            return f'<footer{cls(("entry-footer", "post-footer", "article-footer"), 0.5)}>{_words(r, 2)} {link()} {link()}</footer>'
        return f"<nav>{listed(r.randint(3, 8))}</nav>"

    def stray():
        """Loose text that is no content."""
        return r.choice((_words(r, pick((1, 2, 4, 8, 15))), f"{link()} | {link()}", f"{_words(r, 2)} {link()}"))

    head = f'<head><meta charset="utf-8"><title>{_words(r, 5)}</title><style>p{{margin:0}}</style></head>'
    top = []
    if r.random() < 0.8:
        inner = f"<nav{cls(('main-nav', 'menu'), 0.3)}>{listed(r.randint(3, 9))}</nav>" if r.random() < 0.6 else f'<div{cls(("nav", "menu", "navbar", "navigation"), 1)}>{listed(r.randint(3, 9))}</div>'
        top.append(inner if r.random() < 0.6 else f"<header{cls(('site-header', 'top'), 0.4)}><p>{_words(r, 4)}</p>{inner}</header>")
    if r.random() < 0.15:
        top.append(f'<div{cls(("header", "masthead", "site-header"), 1)}><h1>{_words(r, 3)}</h1><p>{_words(r, 6)}</p></div>')
    top += [boiler_block() for _ in range(pick((0, 0, 1, 1, 2)))]
    after = [boiler_block() for _ in range(pick((0, 0, 1, 2, 3)))]
    foot = f"<footer{cls(('site-footer',), 0.3)}>&copy; {_words(r, pick((3, 10, 30)))}</footer>" if r.random() < 0.7 else f'<div{cls(("footer", "site-footer", "copyright", "legal", "footer-text"), 1)}><p>&copy; {_words(r, pick((3, 10)))}</p>{link()}</div>'
    if r.random() < 0.2:
        foot = f"<footer{cls(('site-footer', 'footer'), 0.4)}>{much()}</footer>" if r.random() < 0.7 else f'<div{cls(("footer", "site-footer", "legal"), 1)}>{much()}</div>'
    for part in (top, after):
        if r.random() < 0.12:
            part.insert(r.randint(0, len(part)), stray())
    kind = r.random()
    if kind < 0.03:  # a bare text
        return r.choice((loose(), f"<html{y}><body{y}>{loose()}</body></html>", f"<html{y}><body{y}>{body()}</body></html>"))
    if kind < 0.5:
        main = f"<article{holder(('post', 'story', 'entry', 'hentry', 'article'), 0.4)}{y}>{body()}</article>"
    elif kind < 0.65:
        main = f"<main{holder(('content', 'main', 'page'), 0.2)}{y}>{body()}</main>"
    elif kind < 0.81:
        main = f'<div{holder(("content", "post", "main", "entry-content", "article-body", "story", "text", "post-body", "main-content"), 0.95)}{y}>{body()}</div>'
    elif kind < 0.9:  # a forum: its posts are what the page is for
        posts = "".join(f"<{(g := pick(('div', 'div', 'section', 'li')))}{cls(('post', 'message', 'post-body', 'reply', 'entry'), 0.9)}{y}>" + "".join(paragraph() for _ in range(pick((1, 1, 2, 4)))) + f"</{g}>" for _ in range(pick((1, 2, 3, 6, 10))))
        main = f"<div{cls(('thread', 'topic', 'discussion', 'posts', 'forum-thread', 'messages'), 0.95)}{y}>" + (f"<h1{y}>{_words(r, 4)}</h1>" if r.random() < 0.6 else "") + posts + "</div>"
        after = [b for b in after if "comment" not in b and "repl" not in b and "discuss" not in b and "disqus" not in b]
    elif kind < 0.95:
        main = f"<section{holder(('content', 'article'), 0.8)}{y}>{body()}</section>"
    else:
        main = body()
    if r.random() < 0.3:
        main = f"<main{holder(('content', 'main'), 0.2)}{y}>{main}</main>" if r.random() < 0.5 else f'<div{holder(("container", "wrapper", "page", "row"), 1)}{y}>{main}{"".join(after)}</div>'
    return f'<!DOCTYPE html><html lang="en"{y}>{head}<body{y}>{"".join(top)}{main}{"".join(after)}{foot}</body></html>'


def training_nodes(page: str) -> tuple[list[Node], np.ndarray]:
    """The nodes of a training page without its marks, and which of them are content."""
    nodes = elements(wrap_loose(parse(page)))
    y = np.zeros(len(nodes))
    for k, n in enumerate(nodes):
        y[k] = 'data-y="1"' in n.attrs if n.tag != LOOSE else any(_CONTENT_MARK in c if isinstance(c, str) else 'data-y="1"' in c.attrs for c in n.kids)
    for n in nodes:
        n.attrs = n.attrs.replace(' data-y="1"', "")
        n.kids = [c.replace(_CONTENT_MARK, "") if isinstance(c, str) else c for c in n.kids]
    return nodes, y


def judged(nodes: list[Node]) -> list[int]:
    """Places of the nodes that the model judges."""
    return [n.index for n in nodes if n.tag not in RAW and n.tag not in ("#page", "head", "meta", "html", "body")]


def training_sample(pages: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    xs, ys = [], []
    for k in range(pages):
        nodes, y = training_nodes(training_page(seed * 1_000_003 + k))
        rows = judged(nodes)
        xs.append(featurize(nodes)[rows])
        ys.append(y[rows])
    return np.concatenate(xs), np.concatenate(ys)


@lru_cache(maxsize=2)
def default_model(pages: int = 1000, rounds: int = 60) -> trees.Trees:
    """Fitted on ``pages`` generated pages (a bounded sample); the same in every process."""
    x, y = training_sample(pages)
    return trees.fit(x, y, rounds=rounds, depth=4, rate=0.3)


#: Longer text has no more say, so that much text can't outvote what stands around it.
MOST_WEIGHT = 4.0


def kept_nodes(nodes: list[Node], features: np.ndarray, odds: np.ndarray) -> np.ndarray:
    """Which nodes are kept, by the model's odds of each, weighed by the logarithm of their own text up to MOST_WEIGHT. The page itself, html and body hold both kinds and count nothing."""
    o = odds * (1.0 + np.minimum(features[:, _AT["own_size"]], MOST_WEIGHT))
    for n in nodes:
        if n.tag in ("#page", "html", "body"):
            o[n.index] = 0.0
        elif n.tag in RAW or n.tag == "head":
            o[n.index] = -20.0
    kept = decode(nodes, o)
    for n in nodes:
        if n.tag in ("html", "body") and kept[n.parent.index]:
            kept[n.index] = True
    return kept


def extract_all(pages: list[str | None], model: trees.Trees) -> list[str]:
    """The main text of each page; empty for a null or empty one. Nodes of all pages are scored together."""
    roots = [wrap_loose(parse(p or "")) for p in pages]
    listed = [elements(r) for r in roots]
    if not listed:
        return []
    features = [featurize(n) for n in listed]
    odds = model.score(np.concatenate(features))
    out, at = [], 0
    for root, nodes, f in zip(roots, listed, features):
        out.append("\n".join(blocks_of(root, kept_nodes(nodes, f, odds[at : at + len(nodes)]))))
        at += len(nodes)
    return out


def extract(pages: DataFrame, model: trees.Trees | None = None, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``(*keep, text)`` for each row; a kept column named as the result is replaced by it. Pages pass through in slices of about 4 MB, and each is one task's work alone.

    A null or empty page has an empty text; repeated rows are results of their own; other columns don't matter.
    """
    model = model or default_model()
    keep = tuple(c for c in keep if c != "text")

    def run(batches):
        for b in batches:
            sizes = [len(x) if x else 0 for x in (s.as_py() for s in b.column(len(keep)))]
            at = 0
            while at < b.num_rows:
                to, held = at, 0
                while to < b.num_rows and (to == at or held + sizes[to] < 4 << 20):
                    held += sizes[to]
                    to += 1
                part = b.slice(at, to - at)
                text = extract_all(part.column(len(keep)).to_pylist(), model)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(text, pa.string())], names)
                at = to

    names = [*(f"k{i}" for i in range(len(keep))), "text"]  # inside, kept columns are known by place
    src = pages.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names)], F.col(f"`{html}`").alias("html"))
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in src.schema.fields[:-1]), "text string"])
    return src.mapInArrow(run, schema).toDF(*keep, "text")

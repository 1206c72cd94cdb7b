"""Main-text extraction by a tree-structured graphical model over the page's DOM.

Each block element is a binary variable: does it belong to the content, or hold some of it? Its own
evidence (kind of tag, words of its class, id and role, amount of text, share of links) gives a unary
potential, and parent and child share a pairwise one; both are estimated with add-one smoothing from
labelled pages. Sum-product messages pass once upward and once downward through the tree, which is exact,
and text whose element has a content marginal of at least a half is kept.
"""

from __future__ import annotations

import html as _html
import re
from bisect import bisect_right
from itertools import product
from math import exp, log

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table, without

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
HIDDEN = frozenset("script style head title noscript template textarea select svg math iframe object canvas".split())
FOREIGN = frozenset("svg math".split())  # may be closed in the tag itself
RAW = frozenset("script style textarea title noscript iframe".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q s samp small span strong sub sup time tt u var wbr".split())
#: tag -> tags of open elements that it ends, and the tags beyond which it does not look.
CLOSES = {
    **dict.fromkeys("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split(), ({"p"}, {"td", "th", "button", "li", "dd", "blockquote", "div", "article", "section"})),
    "li": ({"li", "p"}, {"ul", "ol"}),
    "dt": ({"dt", "dd", "p"}, {"dl"}),
    "dd": ({"dt", "dd", "p"}, {"dl"}),
    "tr": ({"tr", "td", "th", "p"}, {"table"}),
    "td": ({"td", "th", "p"}, {"tr", "table"}),
    "th": ({"td", "th", "p"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
#: A quote opens a value only after "=", and where it is not closed, it is a character as any other.
TAG = re.compile(r"""<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+)?+)*+)>)""")
#: For a tag whose closed quotes hold all ">" that are left.
TAG_TO_NEXT = re.compile(r"<()()(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
ATTR = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
WORD = re.compile(r"[a-z]+")
ROOT_TAG = re.compile(r"^<(\w+)")

#: Words of class, id and role, by what they hint at. A name hints only if every part of it is one of these or of
#: PLAIN: social-policy, market-share or ad-hoc are names of what a page is about.
HINTS = {
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager",
    "header": "header masthead topbar banner logo",
    "footer": "footer contentinfo copyright colophon legal",
    "side": "sidebar aside side complementary widget related recommended recommendations trending popular",
    "notice": "notice cookie cookies consent gdpr alert popup modal overlay dialog newsletter disclaimer toast paywall",
    "advert": "ad ads adv advert advertisement advertising sponsor sponsored promo promotion promoted adsense",
    "comment": "comment comments commentlist reply replies respond disqus discussion reactions",
    "share": "share sharing sharebar",
    "form": "form search login signup subscribe subscription register contact",
    "either": "tabs rail",
    "content": "article content post entry story body text main page prose",
}
ARTICLE = frozenset("article content post entry story".split())
HINT_OF = {w: k for k, ws in HINTS.items() for w in ws.split()}
PLAIN = frozenset("site page main top bottom left right box block bar list wrap wrapper container inner outer section item items area links link button buttons the my js ui global primary secondary small large slot unit row col column panel group title form thread user".split())
KIND_OF = {t: t for t in "html body main article section div p h1 ul ol li table td nav header footer aside form button figure blockquote pre".split()} | dict.fromkeys(("h2", "h3", "h4", "h5", "h6"), "h2") | {"th": "td", "fieldset": "form", "menu": "nav", "dialog": "aside"}


class Node:
    __slots__ = ("tag", "parent", "hint", "size", "linked", "label", "off", "opens", "inside")

    def __init__(self, tag: str, parent: int, attrs: str):
        self.tag, self.parent, self.size, self.linked = tag, parent, 0, 0
        self.label, self.off = "data-content" in attrs, "data-boilerplate" in attrs
        #: Whether the element is named as an article, and whether it lies in one that is.
        self.opens, self.inside = tag in ("article", "main"), False
        hints = set()
        for m in ATTR.finditer(attrs) if "=" in attrs else ():
            for name in m[1].strip("\"'").lower().split():
                parts = WORD.findall(name)
                if all(w in HINT_OF or w in PLAIN for w in parts):
                    hints.update(HINT_OF[w] for w in parts if w in HINT_OF)
                    self.opens |= not ARTICLE.isdisjoint(parts)
        self.hint = next((h for h in HINTS if h in hints), "")  # those against content come first


def parse(page: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """Nodes, parents first, and in page order the text pieces: (node, text); a block's edge is (-1, "")."""
    nodes, pieces = [Node("html", -1, "")], []
    stack: list[tuple[str, int, bool]] = [("html", 0, False)]  # tag, its node, inside hidden markup
    where: dict[str, list[int]] = {}  # places of open elements in the stack, by tag
    blocks: list[int] = []  # and of those that are blocks
    links, at, n = 0, 0, len(page)

    def close(k: int) -> bool:
        """Ends the open elements from place k up; tells whether a block was among them."""
        nonlocal links
        block = bool(blocks) and blocks[-1] >= k
        while len(stack) > k:
            tag = stack.pop()[0]
            where[tag].pop()
            links -= tag == "a"
        while blocks and blocks[-1] >= k:
            blocks.pop()
        return block

    def text(a: int, b: int) -> None:
        if b > a and not stack[-1][2]:
            k, t = stack[-1][1], page[a:b]
            t = _html.unescape(t) if "&" in t else t
            pieces.append((k, t))
            size = len(t.strip())
            nodes[k].size += size
            nodes[k].linked += size if links else 0

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            text(at, n)
            break
        m = TAG.match(page, lt) or TAG_TO_NEXT.match(page, lt)
        if not m:
            if lt + 1 < n and (page[lt + 1].isalpha() or page[lt + 1] == "/" and lt + 2 < n and page[lt + 2].isalpha()):
                text(at, lt)  # a tag that the page's end cuts off
                break
            text(at, lt + 1)
            at = lt + 1
            continue
        text(at, lt)
        at = m.end()
        if m[1]:  # a comment; "<!-->" and "<!--->" are whole ones
            end = -1 if page.startswith((">", "->"), lt + 4) else page.find("-->", lt + 4)
            at = page.find(">", lt + 4) + 1 if page.startswith((">", "->"), lt + 4) else n if end < 0 else end + 3
            continue
        if m[2]:
            end = page.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        tag = m[4].lower()
        block = tag not in INLINE
        if m[3]:
            k = where[tag][-1] if where.get(tag) else 0
            if k and (block or not blocks or blocks[-1] < k) and close(k):
                pieces.append((-1, ""))
            continue
        if tag in CLOSES:
            ends, stop = CLOSES[tag]
            wall = max((where[t][-1] for t in stop if where.get(t)), default=0)
            low = [own[i] for t in ends if (own := where.get(t)) and (i := bisect_right(own, wall)) < len(own)]
            if low:
                close(min(low))
        if block or tag == "br":
            pieces.append((-1, ""))
        if tag in VOID:
            continue
        if tag in ("html", "body") and where.get(tag):
            continue
        hidden, k, attrs = stack[-1][2] or tag in HIDDEN, stack[-1][1], m[5] or ""
        if not hidden and tag != "html" and block:
            # Words inside a line belong to the line, whatever their element is called.
            node = Node(tag, k, attrs)
            node.inside = nodes[k].inside or nodes[k].opens
            nodes.append(node)
            k = len(nodes) - 1
        if tag in RAW:
            ended = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            end = page.find(">", ended.end()) if ended else -1
            at = n if end < 0 else end + 1
            continue
        if not attrs.endswith("/") or block and tag not in FOREIGN:
            where.setdefault(tag, []).append(len(stack))
            if block:
                blocks.append(len(stack))
            stack.append((tag, k, hidden))
            links += tag == "a"
    return nodes, pieces


def evidence(node: Node, size: int, linked: int) -> tuple:
    """The features of a node: tag kind, hint and whether it is one against content, amount of text below it, share of it in links (which says less in an article)."""
    share = linked / size if size else 0
    return ("tag", KIND_OF.get(node.tag, "other")), ("hint", node.hint), ("against", node.hint not in ("", "either", "content")), ("size", (size > 0) + (size > 40) + (size > 200)), ("links", (share > 0.2) + (share > 0.6), node.inside)


def _below(nodes: list[Node]) -> list[tuple[int, int]]:
    size, linked = [x.size for x in nodes], [x.linked for x in nodes]
    for i in range(len(nodes) - 1, 0, -1):
        size[nodes[i].parent] += size[i]
        linked[nodes[i].parent] += linked[i]
    return list(zip(size, linked, strict=True))


class TreeModel:
    """Potentials counted from labelled pages: elements marked data-content, all above them, and all below them
    but for what has a hint against it or is marked data-boilerplate."""

    def __init__(self, labelled: list[str]):
        seen, pairs, totals = {}, [[1.0, 1.0], [1.0, 1.0]], [0, 0]
        for page in labelled:
            nodes, _ = parse(page)
            mark = [int(x.label) for x in nodes]
            for i in range(1, len(nodes)):
                mark[i] |= mark[nodes[i].parent] and nodes[i].hint in ("", "either") and not nodes[i].off
            holds = list(mark)
            for i in range(len(nodes) - 1, 0, -1):
                holds[nodes[i].parent] |= holds[i]
            for i, (x, (size, linked)) in enumerate(zip(nodes, _below(nodes), strict=True)):
                y = int(bool(holds[i]))
                totals[y] += 1
                for f in evidence(x, size, linked):
                    seen.setdefault(f, [1.0, 1.0])[y] += 1
                if i:
                    pairs[int(bool(holds[x.parent]))][y] += 1
        kinds = {name: 1 + sum(f[0] == name for f in seen) for name in ("tag", "hint", "against", "size", "links")}
        self.rest = {name: log((totals[0] + k) / (totals[1] + k)) for name, k in kinds.items()}
        self.odds = {f: log(n[1] / (totals[1] + kinds[f[0]])) - log(n[0] / (totals[0] + kinds[f[0]])) for f, n in seen.items()}
        self.given = [[log(x / sum(row)) for x in row] for row in pairs]

    def marginals(self, nodes: list[Node]) -> list[float]:
        """Probability that each node belongs to or holds content: one upward and one downward pass."""
        n, lp = len(nodes), self.given
        up0, up1 = [0.0] * n, [0.0] * n
        for i, (x, (size, linked)) in enumerate(zip(nodes, _below(nodes), strict=True)):
            up1[i] = sum(self.odds.get(f, self.rest[f[0]]) for f in evidence(x, size, linked)) if i else 4.0
        to0, to1 = [0.0] * n, [0.0] * n
        for i in range(n - 1, 0, -1):
            a, b = up0[i], up1[i]
            to0[i], to1[i] = _lse(lp[0][0] + a, lp[0][1] + b), _lse(lp[1][0] + a, lp[1][1] + b)
            p = nodes[i].parent
            up0[p] += to0[i]
            up1[p] += to1[i]
        down0, down1, out = [0.0] * n, [0.0] * n, [0.0] * n
        for i in range(n):
            if i:
                p = nodes[i].parent
                a, b = down0[p] + up0[p] - to0[i], down1[p] + up1[p] - to1[i]
                down0[i], down1[i] = _lse(a + lp[0][0], b + lp[1][0]), _lse(a + lp[0][1], b + lp[1][1])
            d = down0[i] + up0[i] - down1[i] - up1[i]
            out[i] = 1 / (1 + exp(min(d, 700)))
        return out

    def text(self, page: str) -> str:
        nodes, pieces = parse(page)
        good = [p >= 0.5 for p in self.marginals(nodes)]
        return " ".join("".join(t if k >= 0 and good[k] else " " for k, t in pieces if k < 0 or good[k]).split())


def _lse(a: float, b: float) -> float:
    return a + log(1 + exp(b - a)) if a > b else b + log(1 + exp(a - b))


def labelled_pages() -> list[str]:
    """Labelled training pages: every kind of content wrapper with every kind of surrounding piece."""
    long = "A long run of words that goes on, with clauses, and tells the reader one thing after the other until it ends. " * 3
    body = f'<h1>A title of some words</h1><p>{long}</p><p>Short words.</p><h2>Part</h2><p>{long} <a href="x">a link</a></p><ul><li>One thing to know</li><li>{long}</li></ul><blockquote><p>{long}</p></blockquote><table><tr><td>cell</td></tr></table>'
    linked = "".join(f'<li><a href="/{i}">A thing to read about {i}</a></li>' for i in range(4))
    cells = "".join(f'<tr><td><a href="/{i}">Entry {i}</a></td><td><a href="/x{i}">{i}</a></td></tr>' for i in range(4))
    within = [f"<ul>{linked}</ul>", f"<ol>{linked}</ol>", '<p><a href="x">A line that is one link</a></p>', '<p>See <a href="x">this</a> too.</p>', f"<table><tbody>{cells}</tbody></table>", f'<div class="tabs"><p>{long}</p></div>', f'<div class="rail"><p>{long}</p></div>', f"<section><header><h2>Part of it</h2></header><p>{long}</p></section>", f"<section><h2>Other</h2><div><p>{long}</p></div></section>"]
    wraps = ['<article data-content="">{}</article>', '<main data-content="">{}</main>', '<main><article data-content="">{}</article></main>', '<div class="post-content" data-content="">{}</div>', '<div id="content" data-content="">{}</div>', '<section class="entry" data-content="">{}</section>', '<div data-content="">{}</div>', '<div class="page"><div class="story" data-content="">{}</div></div>']
    items = "".join(f'<li><a href="/{i}">word {i}</a></li>' for i in range(6))
    around = [f"<nav><ul>{items}</ul></nav>", f"<header><a href='/'>Site</a><p>Slogan of it</p></header><div class='menu'><ul>{items}</ul></div>", f"<aside><p>{long}</p><ul>{items}</ul></aside>", f'<div class="sidebar"><div><p>{long}</p></div></div>', '<div class="ad">Words that sell, in a line.</div>', f'<div class="advert"><p>{long}</p></div>', f'<div class="cookie-notice"><p>{long}</p><button>Yes</button></div>', f"<form><p>{long}</p><button>Send</button></form>"]
    after = [f'<div class="comments"><h2>Comments</h2><div><p>{long}</p></div><div><p>{long}</p><p>Yes.</p></div></div>', f'<section id="comments"><ul><li><p>{long}</p></li><li>Good.</li></ul></section>', "<footer>&copy; site <p>All rights kept.</p></footer>", f'<div id="footer"><ul>{items}</ul><p>{long}</p></div>', f'<div class="related"><h2>More</h2><ul>{items}</ul></div>', '<div class="share"><a href="x">Tell</a></div>', f'<section class="comments"><h2>Comments</h2><p>{long}</p><p>{long}</p></section>']
    more = lambda k, own, n: "".join(own[(k * 3 + j) % len(own)] for j in range(n))
    inside = lambda *parts: "".join(ROOT_TAG.sub(r'<\1 data-boilerplate=""', x) for x in parts)
    ends = [after[2], f"<footer>&copy; site, {long}</footer>", "<footer>&copy; site, all rights are kept by those who wrote it.</footer>"]
    pages = []
    for k, (a, w, b) in enumerate(product(around, wraps, after)):
        content = body + (inside(a, b, after[4]) if k % 3 == 0 else "".join(within) + "<p>And then on.</p>" + (inside(after[4], after[(0, 1, 6)[k // 3 % 3]]) if k % 3 == 1 else ""))
        pages.append(f"<html><body>{a}{more(k, around, 3)}{w.format(content)}{b}{more(k, after, 2)}{ends[k % 3]}</body></html>")
    return pages


_MODEL: dict[int, TreeModel] = {}


def default_model() -> TreeModel:
    if 0 not in _MODEL:
        _MODEL[0] = TreeModel(labelled_pages())
    return _MODEL[0]


def extract(pages: DataFrame, labelled: list[str] | None = None) -> DataFrame:
    """pages with main_text and n_chars (its code points) of the html, in place of columns so named, in whatever case.

    Null, empty or text-free html: an empty text. labelled: pages whose content elements bear the
    attribute data-content, to train on in place of the built-in ones. Rows are independent.
    """
    new = ["main_text", "n_chars"]
    kept = without(pages, new)
    own = TreeModel(labelled) if labelled else None

    def run(batches):
        model = own or default_model()
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                rows = batch.slice(lo, 256)
                out = [model.text(h or "") for h in rows.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=[*rows.schema.names, *new])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept.schema.fields)
    return kept.mapInArrow(run, f"{fields}main_text string, n_chars long")


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).selectExpr("page_id", "url", "main_text as text", "n_chars")

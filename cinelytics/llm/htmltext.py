"""Main text of web pages by composite text density.

A page is read into a tree that forgives what browsers forgive: unclosed and misnested
tags, implied ends of p, li, td and the like, raw text of scripts and styles, comments
that never end.  Of every node, C is the number of characters, T of tags, LC and LT those
of links; for the page as a whole Cb and LCb.  Its density (Sun, Song, Liao: "DOM based
content extraction via text density") is

    C / T * log(C / LC * T / LT) / log(ln(C / (C - LC) * LC + LCb / Cb * C + e))

with 1 for a zero divisor; on a page without links it is C / T.  A box is a block child or
a run of text and inline children between such; a node's density sum adds the densities of
its boxes.  The block of the largest sum is the content, and its threshold the least
density on its path to the body.  Boxes beside that path stay if their density reaches
the threshold: of each such block its own largest-sum block, and so on inside it.

Before that go, as the text is the article alone: elements whose tag, role or
class and id words say menu, header, footer, sidebar, notice, advert, form, script,
style, sharing or reader comment, and hidden ones, unless they hold the first article.  Where a page has an
``article`` (else ``main``) of its own, the search is inside these, and the one found
stays whole but for menu-like blocks (three links or more, nine tenths of the text in links),
since a short paragraph of an article is part of it whatever its density.

Character references are decoded, white space in a box becomes one space, boxes are
trimmed and joined in page order by one space.  Null and empty html give the empty text,
as do pages with nothing but boilerplate.  Repeated rows and null ids are rows of their
own; an empty table gives an empty result; extra columns are not read.  One page is
parsed in a time that grows with its length, whatever its depth.
"""

from __future__ import annotations

import re
from html import unescape
from math import e, log

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import map_texts, table

# Element names of HTML by their part in a page.
BLOCK = frozenset("""html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure
    footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol optgroup option p pre search section summary table caption
    colgroup col tbody td tfoot th thead tr ul""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noembed noframes xmp noscript".split())
IN_HEAD = frozenset("base link meta title style script noscript template".split())
GONE = frozenset("""head script style title textarea iframe noembed noframes noscript template object svg canvas audio video map
    nav aside footer form dialog menu search button select option optgroup datalist input rp""".split())
ENDS_P = BLOCK - frozenset("html body dd dt legend li option optgroup summary caption colgroup col tbody td tfoot th thead tr".split())
#: A start tag of the key ends an open element of the value, within the nearest of the last.
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu")), "dd": (("dd", "dt"), ("dl",)), "dt": (("dd", "dt"), ("dl",)),
    "tr": (("tr",), ("table",)), "td": (("td", "th"), ("table",)), "th": (("td", "th"), ("table",)),
    "tbody": (("tbody", "thead", "tfoot"), ("table",)), "tfoot": (("tbody", "thead", "tfoot"), ("table",)),
    "thead": (("tbody", "thead", "tfoot"), ("table",)), "option": (("option",), ("select", "datalist")),
}
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form status".split())
# Words of class and id names that mark what is not the article.
HINTS = frozenset("""nav navbar navigation menu menubar breadcrumb breadcrumbs crumbs pagination pager toolbar topbar skip skiplink
    header masthead banner logo footer foot colophon copyright sidebar sidenav aside rail widget widgets related recommended
    recommendations trending notice notices notification alert popup modal overlay toast cookie cookies consent gdpr newsletter subscribe
    subscription paywall ad ads adv advert adverts advertisement advertising adsense adslot sponsor sponsored sponsors promo promotion
    promoted outbrain taboola form login signin signup search comment comments commentlist respond reply replies disqus discussion
    reactions share sharing social""".split())
STEMS = ("cookie", "sidebar", "comments", "commentlist", "advert", "newsletter", "breadcrumb", "footer", "sponsor", "subscri", "navbar")
#: Beside one of these words, a header is the article's own.
OWN = frozenset("article post entry story content section".split())
HEADS = frozenset("header banner masthead".split())
#: A name that begins with one of these tells of the page's layout.
LAYOUT = frozenset("has with without no is show hide".split())

_ATTRS = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+""")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTR = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_CLOSE = {name: re.compile(f"</{name}(?=[\\s/>]|$)", re.I) for name in RAW}


class Node:
    __slots__ = ("tag", "parent", "kids", "at", "hinted", "gone", "block", "chars", "tags", "link_chars", "links",
                 "density", "total", "best", "boxes")

    def __init__(self, tag, parent, at):
        self.tag, self.parent, self.kids, self.at = tag, parent, [], at
        self.hinted = self.gone = False


def hinted(attrs: str) -> tuple[bool, bool]:
    """Whether a start tag's attributes mark boilerplate, and whether they mark the main part."""
    bad = main = False
    for name, *values in _ATTR.findall(attrs):
        name, value = name.lower(), unescape("".join(values))
        if name in ("class", "id"):
            for one in value.split():
                words = [w.lower() for w in _WORD.findall(one)]
                if not words or words[0] in LAYOUT:
                    continue
                found = {w for w in words if w in HINTS or w.startswith(STEMS)}
                if found and not (found <= HEADS and OWN.intersection(words)):
                    bad = True
        elif name == "role":
            bad |= value.strip().lower() in ROLES
            main |= value.strip().lower() in ("main", "article")
        elif name == "hidden" or (name == "aria-hidden" and value.strip().lower() == "true"):
            bad = True
        elif name == "style":
            bad |= bool(_HIDDEN.search(value))
    return bad, main


def parse(html: str) -> list[Node]:
    """The nodes in page order; the first is the root.  Texts are decoded strings among ``kids``."""
    root = Node("html", None, 0)
    nodes, top, at, n = [root], root, 0, len(html)

    def text(s):
        if s:
            top.kids.append(unescape(s) if "&" in s else s)

    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            text(html[at:])
            break
        mark = html[lt + 1:lt + 2]
        closing = mark == "/" and html[lt + 2:lt + 3].isalpha() and html[lt + 2:lt + 3].isascii()
        if not closing and not (mark.isalpha() and mark.isascii()):
            if mark not in ("!", "?", "/"):  # a lone < is text
                text(html[at:lt + 1])
                at = lt + 1
                continue
            text(html[at:lt])
            long = html.startswith("<!--", lt)
            end = html.find("-->", lt + 4) if long else html.find(">", lt)
            if long and html.startswith(("<!-->", "<!--->"), lt):
                end = html.find(">", lt) - 2
            at = n if end < 0 else end + (3 if long else 1)
            continue
        text(html[at:lt])
        name = _NAME.match(html, lt + 2 if closing else lt + 1)
        end = _ATTRS.match(html, name.end()).end()
        if html[end:end + 1] != ">":  # a quote without an end
            end = html.find(">", name.end())
            if end < 0:
                break
        tag, attrs, at = name.group().lower(), html[name.end():end], end + 1
        if closing:
            if tag == "br":
                top.kids.append("\n")
            elif tag not in ("html", "body"):
                node = top
                while node is not root and node.tag != tag and (tag in BLOCK or node.tag not in BLOCK):
                    node = node.parent
                if node is not root and node.tag == tag:
                    top = node.parent
            continue
        if tag in ("html", "body"):
            if tag == "body" and top.tag == "head":
                top = top.parent
            continue
        if top.tag == "head" and tag not in IN_HEAD:
            top = top.parent
        if tag in ENDS_P or tag in IMPLIED:
            ended, within = (("p",), ("table", "td", "th", "caption")) if tag not in IMPLIED else IMPLIED[tag]
            node, found = top, None
            while node is not root and node.tag not in within:
                if node.tag in ended:
                    found = node
                    break
                node = node.parent
            if found:
                top = found.parent
        if tag == "br":
            top.kids.append("\n")
            continue
        node = Node(tag, top, len(nodes))
        node.hinted, main = hinted(attrs) if attrs else (False, False)
        if main:
            node.tag = "main"
        nodes.append(node)
        top.kids.append(node)
        if tag in RAW:
            close = _CLOSE[tag].search(html, at)
            if not close:
                break
            end = html.find(">", close.end())
            at = n if end < 0 else end + 1
        elif tag not in VOID and not (attrs.endswith("/") and tag in ("svg", "path")):
            top = node
    return nodes


def prune(nodes: list[Node], hints: bool = True) -> list[Node]:
    """Mark what is not the article; the article (else main) elements that remain."""
    for node in nodes[1:]:
        up = node.parent
        node.gone = up.gone or node.tag in GONE or (hints and node.hinted)
    mains = [x for x in nodes if x.tag == "article" and not x.hinted] or [x for x in nodes if x.tag == "main" and not x.hinted]
    spared = set()
    if mains:
        node = mains[0].parent
        while node:
            spared.add(node.at)
            node = node.parent
    for node in nodes[1:]:
        up = node.parent
        own = node.tag in GONE or (hints and node.hinted) or (node.tag == "header" and not _inside(node))
        node.gone = up.gone or (own and node.at not in spared)
    return [x for x in mains if not x.gone]


def _inside(node: Node) -> bool:
    while node:
        if node.tag in ("article", "main"):
            return True
        node = node.parent
    return False


def _density(chars, tags, link_chars, links, share):
    if not chars:
        return 0.0
    plain = chars / (tags or 1)
    if not share:
        return plain
    base = log(log(chars / ((chars - link_chars) or 1) * link_chars + share * chars + e))
    return plain * log(chars / (link_chars or 1) * (tags or 1) / (links or 1)) / base


def measure(nodes: list[Node], gone: bool = False) -> float:
    """Fill in the figures of the nodes that remain; the page's share of link characters."""
    for node in reversed(nodes):
        node.chars = node.tags = node.link_chars = node.links = 0
        node.block = node.tag in BLOCK
        for kid in node.kids:
            if isinstance(kid, str):
                node.chars += len("".join(kid.split()))
            elif gone or not kid.gone:
                node.chars += kid.chars
                node.tags += kid.tags + 1
                node.link_chars += kid.link_chars
                node.links += kid.links
                node.block |= kid.block
        if node.tag == "a":
            node.link_chars, node.links = node.chars, node.links + 1
    root = nodes[0]
    return root.link_chars / root.chars if root.chars else 0.0


def weigh(nodes: list[Node], share: float) -> None:
    """Densities, boxes (block nodes and (chars, tags, link_chars, links, pieces, density) runs), sums
    and, below each node, the block of the largest sum."""
    for node in reversed(nodes):
        if node.gone:
            continue
        node.density = _density(node.chars, node.tags, node.link_chars, node.links, share)
        node.boxes, run = [], []
        for kid in [*node.kids, None]:
            if isinstance(kid, Node) and kid.gone:
                continue
            if kid is None or (isinstance(kid, Node) and kid.block):
                if run:
                    figures = [0, 0, 0, 0]
                    for piece in run:
                        if isinstance(piece, str):
                            figures[0] += len("".join(piece.split()))
                        else:
                            for i, x in enumerate((piece.chars, piece.tags + 1, piece.link_chars, piece.links)):
                                figures[i] += x
                    node.boxes.append((*figures, run, _density(*figures, share)))
                run = []
                if kid is not None:
                    node.boxes.append(kid)
            else:
                run.append(kid)
        node.total = sum(b.density if isinstance(b, Node) else b[5] for b in node.boxes)
        node.best = node
        for box in node.boxes:
            if isinstance(box, Node) and box.best.total > node.best.total:
                node.best = box.best


def _run_text(pieces) -> str:
    out, stack = [], list(reversed(pieces))
    while stack:
        piece = stack.pop()
        if isinstance(piece, str):
            out.append(piece)
        elif not piece.gone:
            stack += reversed(piece.kids)
    return " ".join("".join(out).split())


def _menu(node: Node) -> bool:
    return node.links >= 3 and 10 * node.link_chars >= 9 * node.chars and node.tag != "p"


def main_text(html: str) -> str:
    """The article's text of one page."""
    nodes = parse(html)
    share = measure(nodes, gone=True)
    mains = prune(nodes)
    measure(nodes)
    if not nodes[0].chars:  # names that mislead: a page is more than its boilerplate
        mains = prune(nodes, hints=False)
        measure(nodes)
    mains = [m for m in mains if m.chars]
    weigh(nodes, share)
    root = nodes[0]
    if mains:
        best = max(mains, key=lambda m: (m.best.total, -m.at)).best
        whole = best
        while whole.parent and (whole.parent.tag == "article" or not _owned(whole, mains)):
            whole = whole.parent
    else:
        best, whole = root.best, None
    path, node = set(), best
    threshold = best.density
    while node:
        path.add(node.at)
        threshold = min(threshold, node.density)
        node = node.parent
    out: list[str] = []
    # each entry: a box, and the node whose subtree is content as a whole (or None)
    stack = [(whole, True)] if whole else [(root, False)]
    chosen = {best.at}
    while stack:
        box, kept = stack.pop()
        if not isinstance(box, Node):
            if kept or box[5] >= threshold:
                out.append(_run_text(box[4]))
            continue
        if whole:
            if box is not whole and box.at not in path and _menu(box):
                continue
        elif not kept:
            if box.density >= threshold:
                chosen.add(box.best.at)
            kept = box.at in chosen
        stack += [(b, kept) for b in reversed(box.boxes)]
    return " ".join(t for t in out if t)


def _owned(node: Node, mains: list[Node]) -> bool:
    return any(node is m for m in mains)


def extract(pages: DataFrame, keep: list[str], html_col: str = "html") -> DataFrame:
    """``keep`` columns, text and n_chars of every page."""
    def make():
        def work(htmls):
            found = [main_text(h) for h in htmls]
            return [found, [len(t) for t in found]]
        return work

    return map_texts(pages, html_col, make, [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())], keep)


def q_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11 over whole ``pages``."""
    return extract(table(spark, sf_dir, "pages"), ["page_id", "url"])

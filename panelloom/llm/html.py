"""Main text of a web page by tree scoring.

A page is read into a tree of block elements.  Paragraphs earn points for length and commas and pass them to their ancestors,
less with every level; an element's points are discounted by its share of link text.  The best container is kept, and those of
its siblings that score near it or are paragraphs of running text.  Menus, headers, footers, sidebars, notices, adverts, forms,
scripts, styles and comments are taken out first, by element, role, class and id.  A form, or an element whose class or id only sounds like
one of these, stays if it holds most of the page, such as a form around the whole page.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .batches import fresh_name, slices, widened

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
                   r"|<(/?)([A-Za-z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
RAW = {"script", "style", "title", "textarea", "noscript", "iframe", "noembed", "noframes", "xmp", "template", "svg", "math", "object", "canvas"}
VOID = {"br", "hr", "img", "input", "meta", "link", "col", "area", "base", "embed", "source", "track", "wbr", "param"}
BLOCKS = set("html body main article section div p pre blockquote h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption figure "
             "figcaption header footer nav aside form fieldset address details summary dialog center hgroup menu search".split())
OUT = {"nav", "header", "footer", "aside", "button", "select", "dialog", "menu", "search", "audio", "video", "head"}
SOFT = {"form", "fieldset"}  # out, unless most of the page lies inside
OUT_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "menu", "menubar", "toolbar"}
#: words of class and id that mark what is no article text, those that mark what is, and those that only tell a state
OUT_WORDS = set("nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar side footer foot header masthead banner topbar ad ads advert adverts "
                "advertisement advertising adsense sponsor sponsored promo promotion cookie cookies consent gdpr notice notices notification popup modal "
                "overlay newsletter subscribe subscription signup login share sharing social comment comments commentlist disqus reply replies respond "
                "related recommended recommendations pagination pager widget widgets toolbar skip search form alert".split())
READERS = {"comment", "comments", "commentlist", "disqus", "reply", "replies", "respond"}  # these never stay
KEEP_WORDS = {"article", "content", "main", "body", "post", "entry", "story", "text"}
STATES = {"has", "no", "with", "without", "is"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
CLOSES_P = BLOCKS - {"html", "body"}
#: an open element of the second kind is ended by a start tag of the first, unless one of the third kind lies between
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
           "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
           "tfoot": ({"thead", "tbody", "tr", "td", "th"}, {"table"})}
BASE = {"article": 25.0, "main": 20.0, "div": 5.0, "section": 5.0, "pre": 3.0, "td": 3.0, "blockquote": 3.0, "ul": -3.0, "ol": -3.0, "dl": -3.0,
        "li": -3.0, "address": -3.0, "h1": -5.0, "h2": -5.0, "h3": -5.0, "h4": -5.0, "h5": -5.0, "h6": -5.0, "th": -5.0}
#: inside an article these go by a class that says nothing else; boxes go by one that says it among other things
TEXTS = {"p", "pre", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6", "dl", "dd", "dt", "td", "th", "tr", "figure", "figcaption"}
PARAGRAPHS = {"p", "pre", "td", "blockquote", "li", "dd", "div", "section", "article", "main", "body"}
WORD = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")


class Node:
    __slots__ = ("tag", "parent", "out", "soft", "article", "points", "mass", "size", "linked", "weight", "semantic")

    def __init__(self, tag: str, parent: Node | None, out: bool = False, weight: float = 0.0, semantic: bool = False, soft: bool = False):
        self.tag, self.parent, self.out, self.weight, self.semantic, self.soft = tag, parent, out, weight, semantic, soft
        self.article = not out and (semantic or parent is not None and parent.article)  # marked as the article, or inside it
        self.points, self.mass, self.size, self.linked = 0.0, 0.0, 0, 0


def traits(tag: str, text: str, parent: Node) -> tuple[bool, float, bool, bool]:
    """Whether an element is taken out, its own weight, whether it is marked as the article, and whether it goes unless it holds most of the page."""
    weight, semantic = BASE.get(tag, 0.0), tag in ("article", "main")
    inside = parent.out
    if not text or text.isspace():
        title = tag in HEADINGS and parent.tag == "header" and parent.parent is not None and parent.parent.semantic and not parent.parent.out
        return inside and not title or tag in OUT, weight, semantic, tag in SOFT
    found = {m[0].lower(): unescape(m[1] or m[2] or m[3]) for m in ATTRIBUTE.findall(text)}
    role = found.get("role", "").lower().strip()
    style = found.get("style", "").lower().replace(" ", "")
    classes = [WORD.findall(CAMEL.sub(" ", name).lower()) for name in f"{found.get('class', '')} {found.get('id', '')}".split()]
    semantic = semantic or role in ("main", "article") or found.get("itemprop", "").lower() == "articlebody"
    good = any(KEEP_WORDS & set(said) for said in classes)
    soft = tag in SOFT or role == "form"
    out = tag in OUT or role in OUT_ROLES or "hidden" in found or found.get("aria-hidden", "").lower() == "true" \
        or "display:none" in style or "visibility:hidden" in style
    if tag not in ("html", "body", "main"):  # an article's classes may also tell its state, such as comments-open
        marks = [said for said in classes if said and not STATES & set(said)]
        strict = tag == "article" or tag in TEXTS and parent.article
        marks = [said for said in marks if (all(w in OUT_WORDS for w in said) if strict else OUT_WORDS & set(said))]
        out, soft = out or any(READERS & set(said) for said in marks), soft or bool(marks)
    if tag in HEADINGS and parent.tag == "header" and parent.parent is not None and parent.parent.semantic and not parent.parent.out:
        inside = False  # the title of an article may stand in a header of its own
    return inside or out, weight + 25.0 * good + 25.0 * (role in ("main", "article")), semantic, soft


def blocks(html: str) -> list[tuple[Node, str, int]]:
    """(innermost block element, text, characters inside links) in page order."""
    root = Node("body", None)
    open_, found, links = [root], [], 0
    parts: list[str] = []
    linked: list[str] = []
    skip_inline = 0

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                found.append((open_[-1], text, len(" ".join(unescape("".join(linked)).split()))))
            parts, linked = [], []

    def close(depth: int) -> None:
        flush()
        del open_[depth:]

    at = 0
    end = len(html)
    while at < end:
        begin = html.find("<", at)
        if begin < 0:
            begin = end
        if begin > at and not skip_inline:
            parts.append(html[at:begin])
            if links:
                linked.append(html[at:begin])
        if begin >= end:
            break
        token = TOKEN.match(html, begin)
        if token is None:  # a bare < is text
            if not skip_inline:
                parts.append("<")
            at = begin + 1
            continue
        at = token.end()
        tag = token[2]
        if tag is None:
            if token[0].startswith("<![CDATA["):
                parts.append(token[0][9:].removesuffix("]]>"))
            continue
        tag, closing = tag.lower(), token[1]
        if tag in RAW:
            if not closing and not token[3].rstrip().endswith("/"):
                stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(html, at)
                at = stop.end() if stop else end
            continue
        if tag == "br" or tag == "wbr":
            parts.append(" " if tag == "br" else "")
        elif tag == "hr":
            flush()
        elif tag == "a":
            links = 0 if closing else 1
        elif tag in ("button", "select", "audio", "video"):
            skip_inline = 0 if closing else 1
        elif tag in BLOCKS or tag == "head":
            if not closing:
                if tag in ("html", "body"):
                    flush()
                    continue
                if tag in CLOSES_P and open_[-1].tag == "p":
                    close(len(open_) - 1)
                flush()
                if tag in IMPLIED:
                    ended, limit = IMPLIED[tag]
                    depth = len(open_)
                    for i in range(len(open_) - 1, 0, -1):
                        if open_[i].tag in limit:
                            break
                        if open_[i].tag in ended:
                            depth = i
                    close(depth)
                if tag == "head":
                    open_.append(Node(tag, open_[-1], True))
                elif tag not in VOID:
                    if len(open_) > 1 and open_[-1].tag == "head":
                        close(len(open_) - 1)
                    open_.append(Node(tag, open_[-1], *traits(tag, token[3], open_[-1])))
                links = 0
            else:
                if tag in ("html", "body"):
                    close(1)
                    continue
                for i in range(len(open_) - 1, 0, -1):
                    if open_[i].tag == tag:
                        close(i)
                        break
                    if tag == "p" and open_[i].tag != "p":
                        break
                links = 0
        elif open_[-1].tag == "head" and tag not in VOID:
            close(len(open_) - 1)
    flush()
    return found


def paragraph_points(text: str, linked: int) -> float:
    return (1 + text.count(",") + min(len(text) / 100, 3.0)) * (1 - linked / max(1, len(text)))


def without_soft(found: list[tuple[Node, str, int]]) -> list[tuple[Node, str, int]]:
    """The blocks that are not taken out.  A soft element goes, unless it holds a marked article and more than half of the page's points, or,
    on a page without one, more than four fifths."""
    left = [(node, text, linked) for node, text, linked in found if not node.out]
    total, marked, holds = 0.0, False, set()
    for node, text, linked in left:
        points = paragraph_points(text, linked) if node.tag in PARAGRAPHS else 0.0
        total, up, article = total + points, node, False
        while up is not None:
            up.mass += points
            article = article or up.semantic
            if article:
                holds.add(id(up))
            up = up.parent
        marked = marked or article
    gone: dict[int, bool] = {}

    def goes(node: Node | None) -> bool:
        if node is None:
            return False
        if id(node) not in gone:
            stays = 2 * node.mass > total and id(node) in holds if marked else 5 * node.mass > 4 * total
            gone[id(node)] = node.soft and not stays or goes(node.parent)
        return gone[id(node)]

    return [(node, text, linked) for node, text, linked in left if not goes(node)]


def main_blocks(found: list[tuple[Node, str, int]]) -> list[str]:
    kept = without_soft(found)
    if not kept:
        return []
    scored: dict[int, Node] = {}
    for node, text, linked in kept:
        chain, up = [], node
        while up is not None:
            up.size += len(text)
            up.linked += linked
            chain.append(up)
            up = up.parent
        if node.tag not in PARAGRAPHS:
            continue
        points = paragraph_points(text, linked)
        for level, up in enumerate(chain[node.tag in ("p", "pre", "blockquote", "li", "dd", "td") and len(chain) > 1:]):
            up.points += points / (1 if level == 0 else 2 if level == 1 else 3 * level)
            scored.setdefault(id(up), up)
    value = lambda n: (n.points + n.weight) * (1 - n.linked / max(1, n.size))
    pool = list(scored.values()) or [kept[0][0]]
    best = max(pool, key=value)
    marked = [n for n in pool if n.semantic]
    up = best
    while up is not None and not up.semantic:
        up = up.parent
    if up is not None:
        best = up
        while up is not None:  # the innermost article may lie in a larger one
            best = up if up.tag == "article" or up.semantic and best.tag != "article" else best
            up = up.parent
    elif marked:
        top = max(marked, key=value)
        best = top if 2 * top.size >= best.size else best
    else:  # a container that holds most of what its parent holds gives way to the parent
        while best.parent is not None and best.parent.parent is not None and value(best.parent) >= 0.75 * value(best):
            best = best.parent
    level = max(10.0, 0.2 * value(best))
    beside: dict[int, bool] = {}

    def belongs(node: Node, text: str, linked: int) -> bool:
        up = node
        while up is not None:
            if up is best:
                return True
            if up.parent is best.parent and up.parent is not None:
                if id(up) not in beside:
                    density = up.linked / max(1, up.size)
                    same = up.tag == best.tag and up.semantic == best.semantic
                    running = up.tag == "p" and (up.size > 80 and density < 0.25 or up.size <= 80 and not up.linked and text.endswith((".", "!", "?")))
                    beside[id(up)] = running if best.semantic else value(up) >= level and density < 0.5 or running or same and value(up) >= level
                return beside[id(up)] and not best.semantic
            up = up.parent
        return False

    return [text for node, text, linked in kept if belongs(node, text, linked)]


def main_text(html: str | None) -> str:
    """Main text of one page; empty for null, empty and textless pages."""
    return "\n\n".join(main_blocks(blocks(html or "")))


def extract(pages: DataFrame, html: str = "html", text: str = "text", slice_bytes: int = 8 << 20) -> DataFrame:
    """``pages`` without ``html``, with the main text and its length in code points; a row maps to a row, without a shuffle.

    Null and empty pages and pages without article text get an empty text; whole pages are read; repeated rows repeat; other
    columns are carried through (taken names get underscores).
    """
    names = [c for c in pages.columns if c != html]
    new = fresh_name(names, text)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, html, slice_bytes):
            made = [main_text(t) for t in batch.column(len(names)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(made, pa.string())], names=[*names, new])

    rest = pages.select(*names, html)
    made = rest.mapInArrow(run, widened(rest.select(*names).schema, **{new: "string"}))
    return made.withColumn(fresh_name([*names, new], "n_chars"), F.length(new).cast("long"))

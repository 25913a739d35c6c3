"""Main text of web pages by tree scoring.

Each paragraph gives points for its length and commas to its ancestors, the nearest one most; a container's points are
discounted by its link density, and the best container is kept with the siblings that score alike or are parts of the same article by their
tag, class or headings. A page takes time in proportion to its length: each element
knows the block, list and paragraph around it, and sums go up the tree in one pass. Elements that are
navigation, notices, adverts, forms, comments and the like by their tag, role or class take no part at all; a class or id
says nothing of an element that holds the page's article or most of its paragraph points. Of an article's own header the
headings stay.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TOKEN = re.compile(
    r"<!--(?:.*?-->|.*\Z)|<[!?][^>]*+>?|<(/?)([A-Za-z][^\s/>]*+)((?:[^\"'>]++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)(?:>|\Z)", re.S
)
_ATTR = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
_SPACE = re.compile(r"\s+")
_NAME = re.compile(r"[a-z0-9]+")
_WORD = re.compile(r"\S+")

_RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noframes"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_DROP_TAGS = {"head", "nav", "header", "footer", "aside", "form", "template", "svg", "math", "object", "button", "select", "dialog", "menu", "canvas", "audio", "video", "map"} | _RAW
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img", "br"}
_CLOSES_P = {"address", "article", "aside", "blockquote", "center", "details", "dir", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}
_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = {"table", "ul", "ol", "dl", "html", "body", "article", "section", "div", "main"}
_LISTS = {"table", "ul", "ol", "dl"}
_NEVER = {"html", "body", "article", "main"}
_DROP_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "form", "toolbar"}
_DROP_NAMES = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner",
    "comment", "comments", "commentlist", "disqus", "reply", "replies", "respond", "discussion",
    "sidebar", "aside", "widget", "widgets", "related", "recommended", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "pagination", "pager", "toolbar", "toc",
    "header", "masthead", "footer", "copyright", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "notification", "alert", "popup", "modal", "overlay",
    "cta", "donate", "feedback", "guestbook", "share", "sharing", "social", "newsletter", "subscribe", "subscription", "signup", "login", "paywall", "skip",
}
#: Words that make no other thing of a name in _DROP_NAMES when they stand beside it, as in "comment-list".
_PLAIN_NAMES = {
    "area", "bar", "block", "body", "box", "btn", "button", "buttons", "card", "container", "entries", "feed", "form", "global", "holder", "icons", "inner", "item", "items", "left", "link", "links", "list",
    "meta", "outer", "page", "pane", "panel", "posts", "primary", "reader", "readers", "right", "row", "secondary", "section", "single", "site", "stream", "text", "thread", "top", "user", "users", "visitor", "visitors", "wrap", "wrapper",
}
#: Words that a part of an article may carry; a header of such a name is the article's own.
_OWN_NAMES = {"article", "blog", "entry", "post", "story"}
_OWN_HEADERS = {"header", "masthead", "notice", "alert", "banner", "toc", "aside"}
_CLASS = re.compile(r"""\bclass\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+))""", re.I)


class _Node:
    __slots__ = ("tag", "up", "drop", "soft", "named", "weight", "points", "text", "linked", "links", "block", "holder", "stop", "item", "flag", "attrs")

    def __init__(self, tag: str, up: _Node | None, drop: bool, named: bool = False):
        self.tag, self.up, self.drop = tag, up, drop or (up is not None and up.drop)
        #: Dropped for no other reason than a header of an article, which may hold its headings.
        self.soft = up is not None and up.soft and not drop
        self.named, self.weight = named, 0.0  # unwanted by class or id; points of the paragraphs inside
        self.points, self.text, self.linked, self.links = 0.0, 0, 0, 0
        self.attrs = ""
        self.block, self.flag = tag not in _INLINE, False
        # the nearest of itself and those above: a block, what an open paragraph ends at, a list or what belongs to one
        self.holder = self if self.block or up is None else up.holder
        self.stop = self if tag == "p" or tag in _SCOPE or up is None else up.stop
        self.item = self if tag in _SAME or tag in _LISTS else None if up is None else up.item


def _unwanted(tag: str, attrs: str) -> bool:
    if tag in _DROP_TAGS:
        return True
    if tag in _NEVER or not attrs:
        return False
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "role" and value.strip() in _DROP_ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
    return False


def _named(tag: str, attrs: str) -> bool:
    """Whether a whole name of the class or id is an unwanted one."""
    if tag in _NEVER or not attrs:
        return False
    for m in _ATTR.finditer(attrs):
        if m[1].lower() in ("class", "id"):
            for name in _WORD.findall((m[2] or m[3] or m[4] or "").lower()):
                words = set(_NAME.findall(name))
                found = words & _DROP_NAMES
                if found and words <= _DROP_NAMES | _PLAIN_NAMES:
                    return True
                if found - _OWN_HEADERS and words <= _DROP_NAMES | _PLAIN_NAMES | _OWN_NAMES:
                    return True
    return False


def _points(text: str) -> float:
    return 0.1 + text.count(",") + min(len(text) / 100, 3.0)


def _heading(tag: str) -> bool:
    return tag[:1] == "h" and tag[1:].isdigit()


def _up(nodes: list[_Node], add) -> None:  # noqa: ANN001
    """Calls add(node, the one above) for all nodes, children before parents."""
    for x in reversed(nodes):
        if x.up is not None:
            add(x, x.up)


def _down(nodes: list[_Node], start) -> None:  # noqa: ANN001
    """Sets the flag of each node for which start(node, flag of the one above) holds, parents before children."""
    for x in nodes:
        x.flag = start(x, x.up is not None and x.up.flag)


def _wanted(blocks: list[tuple[_Node, list[tuple[_Node, str]]]], nodes: list[_Node]) -> list[tuple[_Node, str]]:
    """The blocks without what stands in elements unwanted by class or id; counts text, linked text and links of what is left."""
    if any(x.named and not x.drop for x in nodes):
        all_points = 0.0
        for holder, parts in blocks:
            if not _heading(holder.tag):
                points = _points(_SPACE.sub(" ", "".join(t for _, t in parts)).strip())
                all_points += points
                holder.weight += points

        def weigh(x: _Node, up: _Node) -> None:
            up.weight += x.weight

        _up(nodes, weigh)
        articles = [x for x in nodes if x.tag in ("article", "main") and x.weight > 0]
        _down(nodes, lambda x, over: over or x.up is not None and x.up.named)
        free = any(not x.flag for x in articles)
        mine = {id(x) for x in articles}
        for x in nodes:
            x.flag = False

        def hold(x: _Node, up: _Node) -> None:
            up.flag = up.flag or x.flag or id(x) in mine

        if not free:
            _up(nodes, hold)
        for x in nodes:  # parents first
            if x.named and (x.flag or not free and 2 * x.weight > all_points):
                x.named = False
            x.drop = x.drop or x.named or x.up is not None and x.up.drop and not (x.up.soft and _heading(x.tag))
    out = []
    for holder, parts in blocks:
        kept = [(x, t) for x, t in parts if not x.drop]
        for x, t in kept:
            x.text += len(t.strip())
        text = _SPACE.sub(" ", "".join(t for _, t in kept)).strip()
        if text:
            out.append((holder, text))

    def count(x: _Node, up: _Node) -> None:
        if x.tag == "a":
            x.linked = x.text
        up.text += x.text
        up.linked += x.linked
        up.links += x.links + (x.tag == "a" and not x.drop)

    _up(nodes, count)
    return out


def _blocks(page: str) -> tuple[list[tuple[_Node, str]], list[_Node]]:
    """The page's text blocks with the block element that holds each, and all elements, in page order."""
    node = _Node("", None, False)
    nodes, blocks, parts = [node], [], []
    at, end = 0, len(page)
    opened: dict[str, int] = {}

    def flush() -> None:
        if parts:
            blocks.append((node.holder, parts.copy()))
            parts.clear()

    def close(to: _Node) -> None:
        nonlocal node
        while node is not to:
            if node.block:
                flush()
            opened[node.tag] -= 1
            node = node.up

    def say(raw: str) -> None:
        if raw and not node.drop:
            parts.append((node, html.unescape(raw) if "&" in raw else raw))

    while at < end:
        start = page.find("<", at)
        if start < 0:
            say(page[at:])
            break
        m = _TOKEN.match(page, start)
        if m is None:  # a "<" that begins no tag is text
            say(page[at : start + 1])
            at = start + 1
            continue
        say(page[at:start])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if opened.get(tag):
                x = node
                while x.tag != tag:
                    x = x.up
                close(x.up)
            elif tag in ("p", "br"):
                flush()
            continue
        if tag == "br":
            parts.append((node, " "))
            continue
        if tag in _VOID:
            if tag not in _INLINE:
                flush()
            continue
        if tag in _RAW:
            stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = stop.end() if stop else end
            continue
        if tag in _CLOSES_P and node.stop.tag == "p":
            close(node.stop.up)
        if tag in _SAME:
            x = node.item
            while x is not None:
                above = x.up
                if x.tag in _SAME[tag]:
                    close(above)
                if x.tag in _LISTS:
                    break
                x = above.item
        soft = tag == "header" and not node.drop and (opened.get("article") or opened.get("main"))
        new = _Node(tag, node, _unwanted(tag, m[3]), _named(tag, m[3]))
        new.attrs = m[3]
        if soft:
            new.soft = True
        elif node.soft and _heading(tag) and not _unwanted(tag, m[3]):
            new.drop = new.soft = False
        if new.block:
            flush()
        opened[tag] = opened.get(tag, 0) + 1
        node = new
        nodes.append(new)
    close(nodes[0])
    flush()
    return _wanted(blocks, nodes), nodes


#: A paragraph's points reach this many block elements above it; at the last one a share of less than 1/90 is left.
_LEVELS = 32


def _parts_like(best: _Node, nodes: list[_Node]) -> set[int]:
    """Siblings that are parts of the same article however short: other sections beside a section, elements of the best one's own class, those
    under a heading of their own where the best one has one too; and the headings between parts."""
    if best.up is None or best.tag in ("article", "main", "html", "body"):
        return set()
    name = lambda x: next((m[1] or m[2] or m[3] or "" for m in [_CLASS.search(x.attrs)] if m), "").split()
    own, kin = name(best), [x for x in nodes if x.up is best.up]
    headed = {id(x.up) for x in nodes if _heading(x.tag) and x.up is not None and not x.drop}
    out = set()
    for x in kin:
        if x is not best and x.tag == best.tag and not x.drop and x.text and x.linked < 0.5 * x.text:
            if x.tag == "section" or own and name(x) == own or id(best) in headed and id(x) in headed:
                out.add(id(x))
    if out:
        for x, after in zip(kin, kin[1:], strict=False):
            if _heading(x.tag) and (id(after) in out or after is best):
                out.add(id(x))
    return out


def main_text(page: str) -> str:
    """The blocks of the best container and of siblings that score alike, joined by newlines; empty if there is no text."""
    blocks, nodes = _blocks(page)
    if not blocks:
        return ""
    for holder, text in blocks:
        if _heading(holder.tag):
            continue  # headings go with their section but speak for none
        points = _points(text)
        x = holder.up.holder if holder.up is not None and holder.tag in ("p", "li", "pre", "td", "blockquote", "dd") else holder
        for level in range(_LEVELS):
            x.points += points / (1 if level == 0 else 2 if level == 1 else 3 * level)
            if x.up is None:
                break
            x = x.up.holder
    score = lambda x: x.points * (1 - x.linked / max(1, x.text))
    best = max(nodes, key=score)  # the first of equals: the outermost
    x = best
    while x is not None and x.tag not in ("article", "main"):
        x = x.up
    best = x or best
    floor = 0.2 * score(best)
    alike = {id(x) for x in nodes if x.up is best.up and x is not best and best.up is not None and score(x) >= floor and x.points > 0 and x.linked < 0.5 * max(1, x.text)}
    loose = {id(x) for x in nodes if x.up is best.up and best.up is not None and x.tag == "p" and x.text > 80 and x.linked < 0.25 * x.text}
    keep = {id(best)} | alike | loose | _parts_like(best, nodes)
    listing = {id(x) for x in nodes if x.tag in ("ul", "ol", "dl", "div", "table") and x.links >= 3 and x.linked > 0.8 * max(1, x.text) and x is not best}
    if best.tag not in ("", "html", "body") and listing:  # what links an article holds, such as its references, are part of it
        _down(nodes, lambda x, over: x is best or over)
        inside = {id(x) for x in nodes if x.flag and x is not best}
        first = -1
        if best.tag not in ("article", "main"):
            _down(nodes, lambda x, over: x is not best and (over or id(x) in listing))
            first = next((i for i, (x, _) in enumerate(blocks) if id(x) in inside and x.tag == "p" and not x.flag), len(blocks))
        for x in nodes:
            x.flag = False
        for x, _ in blocks[first + 1 :]:
            x.flag = True

        def later(x: _Node, up: _Node) -> None:
            up.flag = up.flag or x.flag

        _up(nodes, later)
        listing -= {id(x) for x in nodes if x.flag and id(x) in inside}
    _down(nodes, lambda x, over: over or id(x) in keep)
    kept = {id(x) for x in nodes if x.flag}
    _down(nodes, lambda x, over: over or id(x) in listing)
    out = [(x, text) for x, text in blocks if id(x) in kept and not x.flag]
    if best.tag in ("", "html", "body"):  # nothing holds the article alone: rows of links at either end are the page's
        rows = [x.linked > 0.8 * x.text for x, _ in out]
        first = next((i for i, r in enumerate(rows) if not r), 0)
        last = next((i for i, r in enumerate(reversed(rows)) if not r), 0)
        out = out[first : len(out) - last]
    return "\n".join(text for _, text in out)


def extract_main_text(pages: DataFrame) -> DataFrame:
    """Adds text and n_chars (its code points) to ``pages`` (any columns with html), replacing columns of these names.

    A null or empty html gives an empty text. Character references are decoded, white space inside a block becomes one
    space, blocks are trimmed and joined by a newline in page order. Nothing is cut: whole pages are read, and unclosed or
    crossed tags end where the next block begins.
    """
    plain = pages.drop("text", "n_chars")
    at = plain.columns.index("html")

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x.as_py() or "") for x in b.column(at)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*b.schema.names, "text"])

    out = plain.mapInArrow(go, T.StructType([*plain.schema.fields, T.StructField("text", T.StringType())]))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))

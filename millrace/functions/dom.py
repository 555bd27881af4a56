"""A tolerant HTML tree, small: what the extractors need of it, and Markdown of a node.

Nothing recurses, so that no nesting is too deep, and every node is rendered once.

Selectors: compounds of tag, ``#id`` and ``.class``, joined by spaces (descendant); commas for alternatives.
"""

from __future__ import annotations

import re
from functools import lru_cache
from html import unescape
from html.parser import HTMLParser

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: An opening tag closes open ones of these kinds, up to one of the walls.
CLOSES = {
    "li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "thead": ({"tbody", "tr", "td", "th"}, {"table"}),
}
NONE = ((), ())
BLOCKS = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}


#: Markup that reads the same in any parser, and at last a ``<`` that may not: text, an end tag, an opening tag with its attributes, comments and document types.
PLAIN = re.compile(
    r"""([^<]++)|</([a-zA-Z][a-zA-Z0-9]*+)[ \t\n\r\f]*+>"""
    r"""|<([a-zA-Z][a-zA-Z0-9]*+)((?:[ \t\n\r\f]++[a-zA-Z_:][-a-zA-Z0-9_:.]*+(?:="[^"]*+"|='[^']*+')?+)*+)[ \t\n\r\f]*+(/?)>"""
    r"""|<!--(?!-?>)(?:[^-]|-(?!-))*+-->|<!(?i:doctype)[^<>]*+>|(<)"""
)
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-a-zA-Z0-9_:.]*+)(?:="([^"]*+)"|='([^']*+)')?+""")
#: Elements whose content isn't markup: the standard parser reads on from them.
RAW = {*HTMLParser.CDATA_CONTENT_ELEMENTS, *getattr(HTMLParser, "RCDATA_CONTENT_ELEMENTS", ()), "plaintext"}
#: Scripts and styles whose end is beyond doubt.
SCRIPT = re.compile(r"((?:[^<]|<(?!/|!--))*+)</(script|style)>")


class Node:
    __slots__ = ("attrs", "children", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None) -> None:
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def walk(self):
        """Descendants in document order."""
        open_ = [iter(self.children)]
        while open_:
            child = next(open_[-1], None)
            if child is None:
                open_.pop()
            elif isinstance(child, Node):
                yield child
                open_.append(iter(child.children))

    def text(self, without: frozenset[str] = frozenset(), deep: bool = True) -> str:
        """The text, without that of elements ``without``; only of own children unless ``deep``."""
        out = []
        if not without:
            left = self.children[::-1]
            while left:
                child = left.pop()
                if isinstance(child, str):
                    out.append(child)
                else:
                    left += child.children[::-1]
            return "".join(out)
        open_ = [iter(self.children)]
        while open_:
            child = next(open_[-1], None)
            if child is None:
                open_.pop()
            elif isinstance(child, str):
                out.append(child)
            elif child.tag not in without or (len(open_) > 1 and not deep):
                open_.append(iter(child.children))
        return "".join(out)

    def remove(self) -> None:
        if self.parent:
            self.parent.children = [c for c in self.parent.children if c is not self]

    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()

    def find(self, selector: str) -> list[Node]:
        """Descendants that match, in document order."""
        out, paths, left = [], _compiled(selector), self.children[::-1]
        while left:
            n = left.pop()
            if isinstance(n, Node):
                for p in paths:
                    if _matches(n, p):
                        out.append(n)
                        break
                left += n.children[::-1]
        return out

    def first(self, selector: str) -> Node | None:
        return next(iter(self.find(selector)), None)


@lru_cache(1024)
def _compiled(selector: str) -> list[list[tuple[str, str, set[str]]]]:
    """The alternatives' parts: (tag, id, classes)."""
    out = []
    for path in selector.split(","):
        out.append([])
        for part in path.split():
            tag, ident = re.match(r"[\w-]*", part)[0], re.search(r"#([\w-]+)", part)
            out[-1].append((tag, ident[1] if ident else "", set(re.findall(r"\.([\w-]+)", part))))
    return out


def _fits(n: Node, part: tuple[str, str, set[str]]) -> bool:
    tag, ident, classes = part
    return (not tag or n.tag == tag) and (not ident or n.attrs.get("id") == ident) and (not classes or classes.issubset(n.classes()))


def _matches(n: Node, path: list) -> bool:
    if not _fits(n, path[-1]):
        return False
    i, up = len(path) - 2, n.parent
    while i >= 0 and up is not None:
        i, up = i - _fits(up, path[i]), up.parent
    return i < 0


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", {}, None)
        #: How many elements of each kind are open, in all and in the innermost cell, so that none is sought in vain.
        self.open: dict[str, int] = {}
        self.cells: list[dict[str, int]] = [{}]

    def _close_to(self, node: Node) -> None:
        while self.at is not node:
            self.open[self.at.tag] -= 1
            self.cells[-1][self.at.tag] -= 1
            if self.at.tag in ("td", "th"):
                self.cells.pop()
            self.at = self.at.parent

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """A declaration that isn't known is a comment, as in browsers."""
        return self.parse_bogus_comment(i)

    def read(self, html: str) -> None:
        """Plain markup here; from the first markup that is not on, the standard parser reads."""
        at = 0
        while at is not None:
            at = self._read_plain(html, at)
        self.close()

    def _read_plain(self, html: str, start: int) -> int | None:
        """Reads on; where to go on after a script, else None."""
        for m in PLAIN.finditer(html, start):
            kind = m.lastindex
            if kind == 1:
                text = m[1]
                self.at.children.append(unescape(text) if "&" in text else text)
            elif kind == 2:
                self.handle_endtag(m[2].lower())
            elif kind == 6:
                self.feed(html[m.start() :])
                return None
            elif kind:
                tag, text, closed = m.group(3, 4, 5)
                tag, script = tag.lower(), None
                if tag in RAW:
                    script = None if closed else SCRIPT.match(html, m.end())
                    if not script or script[2] != tag:
                        self.feed(html[m.start() :])
                        return None
                if "&" in text:
                    self.feed(m[0])  # references in attributes have rules of their own
                    self.clear_cdata_mode()
                else:
                    attrs = [(k.lower(), a or b) for k, a, b in ATTRIBUTE.findall(text)] if text else ()
                    (self.handle_startendtag if closed else self.handle_starttag)(tag, attrs)
                if script:
                    if script[1]:
                        self.handle_data(script[1])
                    self.handle_endtag(tag)
                    return script.end()
        return None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        kinds, walls = CLOSES.get(tag, NONE)
        for k in kinds:
            if self.open.get(k):
                n = to = self.at
                while n.parent and n.tag not in walls:
                    to = n.parent if n.tag in kinds else to
                    n = n.parent
                self._close_to(to)
                break
        if tag in BLOCKS and self.open.get("p"):
            n = self.at
            while n.parent and n.tag not in {"td", "th", "div", "li", "button"}:
                if n.tag == "p":
                    self._close_to(n.parent)
                    break
                n = n.parent
        if tag == "tr" and self.at.tag == "table":
            self._open("tbody", [])
        elif tag in ("td", "th") and self.at.tag in ("table", "tbody", "thead", "tfoot"):
            self.handle_starttag("tr", [])
        self._open(tag, attrs)
        if tag in VOID:
            self._close_to(self.at.parent)

    def _open(self, tag: str, attrs: list) -> None:
        node = Node(tag, {}, self.at)
        for k, v in attrs:
            node.attrs.setdefault(k, v or "")
        self.at.children.append(node)
        self.at = node
        if tag in ("td", "th"):
            self.cells.append({})
        open_, cell = self.open, self.cells[-1]
        open_[tag] = open_.get(tag, 0) + 1
        cell[tag] = cell.get(tag, 0) + 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag in ("svg", "path"):
            self._close_to(self.at.parent)

    def handle_endtag(self, tag: str) -> None:
        # Only a table's own end tags reach beyond the cell. What is sought is open, so all that is walked over closes.
        within = self.open if tag in ("table", "tr", "tbody", "thead", "tfoot") else self.cells[-1]
        if within.get(tag):
            n = self.at
            while n.tag != tag:
                n = n.parent
            self._close_to(n.parent)

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def parse(html: str) -> Node:
    builder = _Builder()
    builder.read(html)
    return builder.root


def trim(s: str) -> str:
    return s.strip(" \t\n\r\f\v                 　﻿")


SPACES, HEADINGS = re.compile(r"[ \t\r\n]+"), {"h1", "h2", "h3", "h4", "h5", "h6"}


def _inline(n: Node, inner: str, items: list[str]) -> str:
    """Markdown of an element from that of its content; ``items``: of its list items."""
    if n.tag in ("script", "style", "head", "noscript"):
        return ""
    if n.tag == "br":
        return "  \n"
    if n.tag in ("b", "strong") and inner.strip():
        return f"**{inner.strip()}**"
    if n.tag in ("i", "em") and inner.strip():
        return f"_{inner.strip()}_"
    if n.tag == "code" and inner.strip():
        return f"`{inner}`"
    if n.tag == "a" and n.attrs.get("href"):
        return f"[{inner.strip()}]({n.attrs['href']})"
    if n.tag == "img":
        return f"![{n.attrs.get('alt', '')}]({n.attrs['src']})" if n.attrs.get("src") else ""
    return inner if n.tag not in BLOCKS and n.tag not in ("li", "tr", "td", "th") else f"\n\n{_block(n, inner.strip(), items)}\n\n"


def _block(n: Node, inner: str, items: list[str]) -> str:
    if n.tag in HEADINGS:
        return f"{'#' * int(n.tag[1])} {inner}"
    if n.tag == "hr":
        return "* * *"
    if n.tag == "pre":
        return f"```\n{n.text().strip(chr(10))}\n```"
    if n.tag == "blockquote":
        return "\n".join(f"> {line}".rstrip() for line in inner.split("\n"))
    if n.tag in ("ul", "ol"):
        marks = [f"{i}.  " if n.tag == "ol" else "*   " for i in range(1, len(items) + 1)]
        return "\n".join(m + x.replace("\n", "\n    ") for m, x in zip(marks, items, strict=True))
    return inner


def _content(top: Node) -> str:
    """Markdown of a node's content, each descendant from its own content as soon as that is whole."""
    open_ = [(top, iter(top.children), [], [])]
    while True:
        n, left, parts, items = open_[-1]
        child = next(left, None)
        if isinstance(child, str):
            parts.append(SPACES.sub(" ", child))
        elif child is not None:
            open_.append((child, iter(child.children), [], []))
        else:
            inner = "".join(parts)
            open_.pop()
            if not open_:
                return inner
            open_[-1][2].append(_inline(n, inner, items))
            if n.tag == "li":
                open_[-1][3].append(inner.strip())


def markdown(n: Node | None) -> str:
    """Markdown of a node's content: headings, lists, links, images, emphasis, code, quotes and rules."""
    if n is None:
        return ""
    text = _content(n)
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"(?<![ \t])[ \t]+\n(?!\S)", "\n", text)).strip()

"""HTML as table functions, on the standard library's parser: links, titles, main text, labelled values."""

from __future__ import annotations

from html.parser import HTMLParser
from urllib.parse import urljoin

from evispark.functions.text import clean

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_DROPPED = frozenset("script style nav footer noscript header".split())
_CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}}


class Node:
    """An element with its children: elements and strings."""

    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def walk(self):
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def find(self, tag: str) -> Node | None:
        return next((n for n in self.walk() if n.tag == tag), None)

    def strings(self, without: frozenset[str] = frozenset()):
        stack: list = [self]
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                yield node
            elif node.tag not in without:
                stack.extend(reversed(node.children))

    def text(self, joint: str = " ", without: frozenset[str] = frozenset()) -> str:
        return joint.join(s for s in (x.strip() for x in self.strings(without)) if s)


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        closes = _CLOSES.get(tag)
        if closes and self.at.tag in closes:
            self.at = self.at.parent
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag):
        node = self.at
        while node is not self.root and node.tag != tag:
            node = node.parent
        if node is not self.root:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parse(html: bytes | str) -> Node:
    """The tree of a page; broken markup never raises."""
    tree = _Tree()
    tree.feed(html.decode("utf-8", "replace") if isinstance(html, bytes) else html)
    tree.close()
    return tree.root


def _main(root: Node) -> Node:
    return root.find("main") or root.find("article") or root.find("body") or root


def title(root: Node) -> str:
    node = root.find("title")
    return node.text() if node else ""


def main_text(root: Node) -> str:
    """Cleaned text of the main element without scripts, styles and furniture elements, a string per line."""
    return clean(_main(root).text("\n", _DROPPED))


def links(root: Node, base: str) -> list[tuple[str, str]]:
    """``(address, text)`` of all anchors, in order; unresolvable ones left out."""
    out = []
    for n in root.walk():
        if n.tag == "a" and "href" in n.attrs:
            try:
                out.append((urljoin(base, n.attrs["href"]), n.text()))
            except ValueError:
                continue
    return out


def label_values(root: Node) -> dict[str, str]:
    """What a page says beside its labels, by label in small letters without colon; the first value of a label counts.

    A label is an element's own text; its value is the next element beside it, or else the text that follows it directly.
    """
    values: dict[str, str] = {}
    for parent in root.walk():
        kin = [c for c in parent.children if isinstance(c, Node) or c.strip()]
        for k, element in enumerate(kin):
            if isinstance(element, str):
                continue
            value = next((c.text() for c in kin[k + 1 :] if isinstance(c, Node)), "")
            if not value and k + 1 < len(kin) and isinstance(kin[k + 1], str):
                value = kin[k + 1].strip().strip(":").strip()
            if value:
                for own in element.children:
                    if isinstance(own, str) and own.strip():
                        values.setdefault(" ".join(own.split()).removesuffix(":").rstrip().lower(), value)
    return values


def titled(slug: str) -> str:
    """``berga-kommun`` as ``Berga kommun``."""
    first, *rest = [w.capitalize() for w in slug.split("-")]
    return " ".join([first, *("kommun" if w == "Kommun" else w for w in rest)])


def body_text(body: bytes | None, content_type: str | None) -> tuple[str, str]:
    """``(kind, text)``: ``pdf`` (no text without a PDF library), ``html`` or ``unsupported``."""
    start = (body or b"").lstrip()[:200].lower()
    if start.startswith(b"%pdf-"):
        return "pdf", ""
    if "html" in (content_type or "").lower() or start.startswith((b"<!doctype html", b"<html")):
        return "html", main_text(parse(body or b""))
    return "unsupported", ""

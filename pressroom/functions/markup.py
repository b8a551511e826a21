"""A small HTML reader for use inside tasks: build the element tree of one page, find elements.

The tree is the lenient one: an end tag closes up to its start tag and is ignored without one,
an unclosed tag stays open, and text inside scripts and styles is not part of an element's text.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from html.parser import HTMLParser

# Elements without content, and elements whose text is not shown.
VOID = frozenset(
    "area base br col embed hr img input keygen link menuitem meta param source track wbr".split()
)
SILENT = frozenset(("script", "style", "template", "rt", "rp"))

_SELECTOR = re.compile(r"([\w-]*)(?:#([\w-]+))?((?:\.[\w-]+)*)(?:\[([\w-]+)=([^\]]*)\])?")


@functools.cache
def _parts(selector: str):
    tag, ident, classes, attr, value = _SELECTOR.fullmatch(selector).groups()
    return tag, ident, frozenset(filter(None, classes.split("."))), attr, value


class Element:
    __slots__ = ("tag", "attrs", "kids")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.kids = tag, attrs, []

    @property
    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()

    def attribute(self, name: str) -> str | None:
        return " ".join(self.classes) if name == "class" else self.attrs.get(name)

    def walk(self) -> Iterator["Element"]:
        """Descendants in document order; iterative, since unclosed tags nest deeply."""
        stack = [iter(self.kids)]
        while stack:
            kid = next(stack[-1], None)
            if kid is None:
                stack.pop()
            elif isinstance(kid, Element):
                yield kid
                stack.append(iter(kid.kids))

    def strings(self) -> Iterator[str]:
        stack = [iter(self.kids)]
        while stack:
            kid = next(stack[-1], None)
            if kid is None:
                stack.pop()
            elif isinstance(kid, str):
                yield kid
            elif kid.tag not in SILENT:
                stack.append(iter(kid.kids))

    def text(self) -> str:
        return "".join(self.strings())

    def stripped_text(self) -> str:
        return "".join(part.strip() for part in self.strings())

    def find_all(self, selector: str) -> Iterator["Element"]:
        """Descendants matching ``tag#id.class.class[attr=value]``; any part may be left out."""
        tag, ident, wanted, attr, value = _parts(selector)
        for node in self.walk():
            if (
                (not tag or node.tag == tag)
                and (not ident or node.attrs.get("id") == ident)
                and (not wanted or wanted <= set(node.classes))
                and (not attr or node.attribute(attr) == value)
            ):
                yield node

    def find(self, selector: str) -> "Element | None":
        return next(self.find_all(selector), None)

    def remove(self, selector: str) -> None:
        doomed = {id(node) for node in self.find_all(selector)}
        for node in [self, *self.walk()] if doomed else ():
            node.kids = [kid for kid in node.kids if id(kid) not in doomed]


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Element("", {})
        self.open = [self.root]
        self.counts: dict[str, int] = {}

    def handle_starttag(self, tag, attrs):
        node = Element(tag, {name: value or "" for name, value in attrs})
        self.open[-1].kids.append(node)
        if tag not in VOID:
            self.open.append(node)
            self.counts[tag] = self.counts.get(tag, 0) + 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if not self.counts.get(tag):
            return
        while True:
            closed = self.open.pop()
            self.counts[closed.tag] -= 1
            if closed.tag == tag:
                return

    def handle_data(self, data):
        self.open[-1].kids.append(data)


def read_html(html: str) -> Element:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root

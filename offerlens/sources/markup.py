"""A small tree of an HTML page with the few selectors that the parsers need."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_STEP = re.compile(r"([a-z][a-z0-9]*|\*)?((?:[.#][\w-]+|\[[\w-]+(?:=\"[^\"]*\")?\])*)", re.I)
_PART = re.compile(r"([.#])([\w-]+)|\[([\w-]+)(?:=\"([^\"]*)\")?\]")


class Node:
    def __init__(self, tag: str, attributes: dict[str, str], parent: Node | None):
        self.tag, self.attributes, self.parent, self.children = tag, attributes, parent, []

    def get(self, name: str) -> str | None:
        return self.attributes.get(name)

    def below(self) -> Iterator[Node]:
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            node = stack.pop()
            yield node
            stack += [c for c in reversed(node.children) if isinstance(c, Node)]

    def text(self) -> str:
        parts, stack = [], list(reversed(self.children))
        while stack:
            c = stack.pop()
            if isinstance(c, str):
                parts.append(c)
            else:
                stack += reversed(c.children)
        return "".join(parts)

    def squeezed(self) -> str:
        return " ".join(self.text().split())

    def all(self, selector: str) -> Iterator[Node]:
        """Nodes below that match any of the comma-separated selectors, in page order."""
        paths = [path.split() for path in selector.split(",")]
        return (n for n in self.below() if any(_path(n, p, self) for p in paths))

    def first(self, selector: str) -> Node | None:
        return next(self.all(selector), None)


def _step(node: Node, step: str) -> bool:
    m = _STEP.fullmatch(step)
    if m is None:
        raise ValueError(f"selector not known: {step}")
    if m[1] and m[1] != "*" and m[1].lower() != node.tag:
        return False
    for sign, name, attribute, value in _PART.findall(m[2]):
        if sign == "." and name not in (node.get("class") or "").split() or sign == "#" and node.get("id") != name:
            return False
        if attribute and (attribute not in node.attributes or f'{attribute}="' in step and node.get(attribute) != value):
            return False
    return True


def _path(node: Node, path: list[str], top: Node) -> bool:
    if not _step(node, path[-1]):
        return False
    above, rest = node.parent, path[:-1]
    while rest and above is not None:
        if _step(above, rest[-1]):
            rest = rest[:-1]
        above = above.parent
    return not rest


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.top = self.at = Node("", {}, None)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        node = Node(tag, {k: v or "" for k, v in reversed(attrs)}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.at = self.at.parent

    def handle_endtag(self, tag: str) -> None:
        node = self.at
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def parse(html: str) -> Node:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.top

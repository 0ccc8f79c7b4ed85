"""A small element tree of a captured page, for the extraction tasks.

Elements nest as the tags say; an end tag closes up to its nearest open start tag, and an
end tag without one is ignored.  Selectors are descendant chains of simple parts:
``tag``, ``#id``, ``.class``, ``[a='v']``, ``[a^='v']``, ``[a*='v']`` and mixes of these.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_PART = re.compile(r"""([a-zA-Z][\w-]*)|\#([\w-]+)|\.([\w-]+)|\[([\w-]+)([\^*]?)=['"]([^'"]*)['"]\]""")


class Element:
    def __init__(self, tag: str, attrs: dict, parent: "Element | None"):
        self.tag, self.attrs, self.parent, self.content = tag, attrs, parent, []

    def walk(self):
        """Elements below this one, in page order."""
        todo = [iter(self.content)]
        while todo:
            for child in todo[-1]:
                if isinstance(child, Element):
                    yield child
                    todo.append(iter(child.content))
                    break
            else:
                todo.pop()

    def text(self) -> str:
        """Text below this element, pieces and white space joined by one blank."""
        pieces, todo = [], [iter(self.content)]
        while todo:
            for child in todo[-1]:
                if isinstance(child, str):
                    pieces.append(child)
                elif child.tag not in ("script", "style"):
                    todo.append(iter(child.content))
                    break
            else:
                todo.pop()
                pieces.append(" ")
        return " ".join("".join(" " + p for p in pieces).split())


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Element("", {}, None)
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        new = Element(tag, {k: v or "" for k, v in attrs}, self.open[-1])
        self.open[-1].content.append(new)
        if tag not in VOID:
            self.open.append(new)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.open.pop()

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                break

    def handle_data(self, data):
        self.open[-1].content.append(data)


def parse(html: str) -> Element:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


_chains: dict = {}


def _chain(selector: str):
    if selector in _chains:
        return _chains[selector]
    out = []
    for part in re.findall(r"(?:\[[^\]]*\]|[^\s\[])+", selector):
        tests = _PART.findall(part)
        if "".join("".join(t) for t in tests) == "" or _PART.sub("", part):
            raise ValueError(f"unsupported selector: {selector}")
        out.append(tests)
    _chains[selector] = out
    return out


def _fits(e: Element, tests) -> bool:
    for tag, ident, cls, attr, how, value in tests:
        have = e.attrs.get(attr)
        if tag and e.tag != tag.lower() or ident and e.attrs.get("id") != ident or cls and cls not in e.attrs.get("class", "").split():
            return False
        if attr and (have is None or not (value in have if how == "*" else have.startswith(value) if how else have == value)):
            return False
    return True


def _matches(e: Element, chain) -> bool:
    if not _fits(e, chain[-1]):
        return False
    left, up = list(chain[:-1]), e.parent
    while left and up is not None:
        if _fits(up, left[-1]):
            left.pop()
        up = up.parent
    return not left


def select(e: Element, selector: str):
    """Elements below ``e`` that match, in page order."""
    chain = _chain(selector)
    return (x for x in e.walk() if _matches(x, chain))


def select_any(e: Element, selectors):
    """Elements below ``e`` that match one of the selectors, in page order."""
    chains = [_chain(s) for s in selectors]
    return (x for x in e.walk() if any(_matches(x, c) for c in chains))


def nearest(e: Element, selectors) -> Element | None:
    """The nearest element around ``e`` that fits the first selector that any of them fits."""
    for selector in selectors:
        chain, up = _chain(selector), e.parent
        while up is not None:
            if _matches(up, chain):
                return up
            up = up.parent
    return None

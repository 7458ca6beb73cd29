"""Leaf blocks of a web page: their text, and where in the page they stand.

A block is the text between two block-level tags. Forgiving as browsers are: tags may
be left open or closed twice, and the page may end anywhere.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass
from zlib import crc32

import numpy as np

_TAG = re.compile(r"""</?([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""")
_NAMED = re.compile(r"""(?:^|[\s"'/])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PARTS = re.compile(r"[^a-z0-9]+")

# Element names of HTML by how they are read.
_HIDDEN = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "object", "canvas", "select", "noembed", "noframes", "xmp"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt",
    "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img", "br",
}
#: Elements that an opening tag of their own kind closes, up to the element that holds them.
_SIBLING = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}

#: Elements that say of themselves what they are for, by name or by a part of their class, id or role. Training labels only.
_MAIN_TAGS, _OTHER_TAGS = {"article", "main"}, {"nav", "header", "footer", "aside", "form", "menu", "dialog"}
_MAIN_WORDS = {"article", "content", "post", "entry", "story", "main", "body"}
_OTHER_WORDS = {
    "ad", "ads", "advert", "advertisement", "banner", "sponsored", "promo", "nav", "navigation", "navbar", "menu", "breadcrumb", "breadcrumbs", "sidebar", "aside", "footer",
    "header", "masthead", "comment", "comments", "reply", "replies", "respond", "cookie", "cookies", "consent", "notice", "alert", "popup", "modal", "newsletter", "subscribe", "signup",
    "login", "search", "share", "social", "related", "recommended", "widget", "pagination", "pager", "toolbar", "complementary", "contentinfo",
}

PATH_DIMS, WORD_DIMS = 128, 32


def _bucket(token: str, dims: int) -> int:
    return crc32(token.encode()) % dims


@dataclass
class Block:
    text: str
    #: Tokens of the elements around it, outermost first, counted in PATH_DIMS buckets; and of the innermost element.
    path: np.ndarray
    tag: str
    linked: int
    #: What the elements around it say: 1 main text, 0 not, None nothing.
    said: int | None


def tokens(name: str, attributes: str) -> list[str]:
    """What stands for an element in a path: its name, and the parts of its class, id and role."""
    out = [name]
    if attributes and ("=" in attributes):
        for m in _NAMED.finditer(attributes):
            value = (m[2] or m[3] or m[4] or "").lower()
            out += [f".{part}" for part in _PARTS.split(value) if part and not part.isdigit()]
    return out


def _says(own: list[str], outer: int | None) -> int | None:
    if outer == 0 or own[0] in _OTHER_TAGS or any(t[0] == "." and t[1:] in _OTHER_WORDS for t in own):
        return 0
    if own[0] in _MAIN_TAGS or any(t[0] == "." and t[1:] in _MAIN_WORDS for t in own):
        return 1
    return outer


def blocks(page: str) -> list[Block]:
    """All blocks with text, in page order."""
    found: list[Block] = []
    root = np.zeros(PATH_DIMS, np.float32)
    stack: list[tuple[str, np.ndarray, int | None]] = []
    parts: list[str] = []
    linked = anchors = 0
    at, size = 0, len(page)
    opened: dict[str, int] = {}

    def close_block():
        nonlocal parts, linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                found.append(Block(text, stack[-1][1] if stack else root, next((n for n, *_ in reversed(stack) if n not in _INLINE), ""), linked, stack[-1][2] if stack else None))
            parts, linked = [], 0

    def push(name: str, attributes: str):
        path = (stack[-1][1] if stack else root).copy()
        own = tokens(name, attributes)
        for token in own:
            path[_bucket(token, PATH_DIMS)] += 1
        stack.append((name, path, _says(own, stack[-1][2] if stack else None)))
        opened[name] = opened.get(name, 0) + 1

    def leave() -> str:
        name = stack.pop()[0]
        opened[name] -= 1
        return name

    while at < size:
        mark = page.find("<", at)
        if mark < 0:
            mark = size
        if mark > at:
            text = page[at:mark]
            text = html.unescape(text) if "&" in text else text
            parts.append(text)
            if anchors:
                linked += len(text)
            at = mark
            continue
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            at = size if end < 0 else end + 3
            continue
        following = page[at + 1 : at + 2]
        if following in ("!", "?") or (following == "/" and not page[at + 2 : at + 3].isalpha()):
            end = page.find(">", at)
            at = size if end < 0 else end + 1
            continue
        if not (following == "/" or (following.isalpha() and following.isascii())):
            parts.append("<")
            at += 1
            continue
        m = _TAG.match(page, at)
        if m:
            name, attributes, at = m[1].lower(), m[2], m.end()
        else:
            # A quote that is never closed: the tag ends at the next bracket.
            end = page.find(">", at)
            if end < 0:
                break
            name, attributes, at = re.match(r"</?([^\s/>]*)", page[at:end])[1].lower(), "", end + 1
        if following == "/":
            if name not in _INLINE:
                close_block()
            elif name == "a":
                anchors = 0
            if opened.get(name):
                while leave() != name:
                    pass
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name in _VOID:
            if name == "hr":
                close_block()
            continue
        if name in _HIDDEN:
            if name not in _INLINE:
                close_block()
            if not attributes.rstrip().endswith("/") or name in ("script", "style", "title", "textarea"):
                # In the page itself: its lower-case form may be longer.
                end = re.compile(f"</{re.escape(name)}", re.I | re.A).search(page, at)
                end = page.find(">", end.start()) if end else -1
                at = size if end < 0 else end + 1
            continue
        if name not in _INLINE:
            close_block()
            # A block-level element ends an open paragraph; an item ends the item before it.
            while stack and (stack[-1][0] == "p" or stack[-1][0] in _INLINE) and any(n == "p" for n, *_ in stack[-8:]):
                leave()
            if name in _SIBLING:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in _SIBLING[name]:
                        break
                    if stack[i][0] == name:
                        while len(stack) > i:
                            leave()
                        break
        elif name == "a":
            anchors = 1
        push(name, attributes)
    close_block()
    return found


def features(own: list[Block]) -> np.ndarray:
    """One row per block: path, innermost element, hashed words, and how much of it there is."""
    out = np.zeros((len(own), PATH_DIMS + 16 + WORD_DIMS + 6), np.float32)
    for i, b in enumerate(own):
        row = out[i]
        row[:PATH_DIMS] = np.minimum(b.path, 1)
        row[PATH_DIMS + _bucket(b.tag, 16)] = 1
        words = b.text.encode().split()
        counts = np.bincount([crc32(w) % WORD_DIMS for w in words], minlength=WORD_DIMS)
        row[PATH_DIMS + 16 : PATH_DIMS + 16 + WORD_DIMS] = counts / max(1.0, float(np.sqrt((counts * counts).sum())))
        row[-6:] = (
            np.log1p(len(words)) / 5, min(1.0, b.linked / max(1, len(b.text))), b.text[-1] in ".!?:;\"'", b.text[0].isupper(),
            i / max(1, len(own) - 1), sum(map(str.isdigit, b.text)) / len(b.text),
        )
    return out


WIDTH = PATH_DIMS + 16 + WORD_DIMS + 6

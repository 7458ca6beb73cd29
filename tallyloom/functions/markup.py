"""HTML columns: the markup inside one element, and HTML as Markdown.

Markup needs a parser, so these two run as Arrow-batched functions on the
standard library's HTML parser. Layout choices: underlined level 1 and 2
headings, `*` bullets, backslash before `*` and `_`.
"""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Element classes of HTML and the Markdown marks used for them.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
SILENT = {"script", "style", "title", "head", "template"}
IN_HEAD = {"title", "meta", "link", "base", "style", "script", "noscript", "template"}
BLOCKS = {"p", "div", "article", "section", "header", "footer", "nav", "main", "aside", "figure", "table", "form"}
MARKS = {"b": "**", "strong": "**", "i": "*", "em": "*", "code": "`", "kbd": "`", "samp": "`", "del": "~~", "s": "~~"}
HEADINGS = {"h1": 1, "h2": 2, "h3": 3, "h4": 4, "h5": 5, "h6": 6}
BULLETS = "*+-"
LITERAL = ("code", "kbd", "samp")

BLANKS = re.compile(r"\s+")
SPECIAL = re.compile(r"[*_]")


class _MarkdownWriter(HTMLParser):
    """Keeps one text buffer per open element and folds it into its parent on close."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, dict]] = [("", {})]
        self.buffers: list[list[str]] = [[]]
        self.depth: Counter[str] = Counter()

    def inside(self, tags) -> bool:
        return any(self.depth[tag] for tag in tags)

    def handle_starttag(self, tag, attrs):
        # The end tag of the head may be left out: anything of the body ends it.
        while self.depth["head"] and tag not in IN_HEAD:
            self.close_top()
        if tag in VOID:
            self.buffers[-1].append(self.void(tag, dict(attrs)))
            return
        if tag in ("p", "li", "tr", "td", "th") and self.open[-1][0] == tag:
            self.close_top()
        self.open.append((tag, dict(attrs)))
        self.buffers.append([])
        self.depth[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if self.depth[tag]:
            while self.open[-1][0] != tag:
                self.close_top()
            self.close_top()

    def handle_data(self, data):
        if self.inside(SILENT):
            return
        if not self.depth["pre"]:
            data = BLANKS.sub(" ", data)
            if not self.inside(LITERAL):
                data = SPECIAL.sub(r"\\\g<0>", data)
        self.buffers[-1].append(data)

    def void(self, tag: str, attrs: dict) -> str:
        if tag == "br":
            return "  \n"
        if tag == "hr":
            return "\n\n---\n\n"
        if tag == "img":
            return f"![{attrs.get('alt') or ''}]({attrs.get('src') or ''})"
        return ""

    def close_top(self):
        tag, attrs = self.open.pop()
        self.depth[tag] -= 1
        text = "".join(self.buffers.pop())
        self.buffers[-1].append(self.render(tag, attrs, text))

    def render(self, tag: str, attrs: dict, text: str) -> str:
        bare = text.strip()
        if tag in SILENT:
            return ""
        if tag == "pre":
            return f"\n\n```\n{text.strip(chr(10))}\n```\n\n"
        if self.depth["pre"]:
            return text
        if tag in MARKS:
            return self.around(text, MARKS[tag], MARKS[tag])
        if tag == "a":
            return self.around(text, "[", f"]({attrs['href']})") if attrs.get("href") else text
        if tag in HEADINGS:
            title = " ".join(bare.split())
            level = HEADINGS[tag]
            if not title:
                return ""
            return f"\n\n{title}\n{'=-'[level - 1] * len(title)}\n\n" if level < 3 else f"\n\n{'#' * level} {title}\n\n"
        if tag == "li":
            return self.item(bare)
        if tag in ("ul", "ol"):
            return f"\n{text.rstrip()}" if self.depth["li"] else f"\n\n{text.strip(chr(10))}\n\n"
        if tag == "blockquote":
            return "\n\n" + "\n".join(f"> {line}".rstrip() for line in bare.split("\n")) + "\n\n" if bare else ""
        if tag in ("td", "th"):
            return f" {' '.join(bare.split())} |"
        if tag == "tr":
            return self.table_row(text)
        return f"\n\n{bare}\n\n" if tag in BLOCKS and bare else text

    @staticmethod
    def around(text: str, before: str, after: str) -> str:
        """Marks hug the words; blanks at the edges stay outside."""
        bare = text.strip()
        if not bare:
            return text
        lead = text[: len(text) - len(text.lstrip())]
        return f"{lead}{before}{bare}{after}{text[len(text.rstrip()):]}"

    def item(self, text: str) -> str:
        lists = [(tag, attrs) for tag, attrs in self.open if tag in ("ul", "ol")]
        if lists and lists[-1][0] == "ol":
            attrs = lists[-1][1]
            start = attrs.get("start") or ""
            number = attrs["next item"] = attrs.get("next item", int(start) - 1 if start.isdigit() else 0) + 1
            mark = f"{number}. "
        else:
            depth = sum(tag == "ul" for tag, _ in lists)
            mark = f"{BULLETS[max(depth - 1, 0) % len(BULLETS)]} "
        return mark + text.replace("\n", "\n" + " " * len(mark)) + "\n"

    def table_row(self, cells: str) -> str:
        table = next((attrs for tag, attrs in reversed(self.open) if tag == "table"), self.open[-1][1])
        first = not table.get("has rows")
        table["has rows"] = True
        line = f"|{cells}".replace("\n", " ").rstrip() + "\n"
        return line + "|" + " --- |" * cells.count(" |") + "\n" if first else line

    def result(self) -> str:
        while len(self.open) > 1:
            self.close_top()
        text = re.sub(r"[ \t]+\n(?=\n)", "\n", "".join(self.buffers[0]))
        return re.sub(r"\n{3,}", "\n\n", text).strip()


class _ElementFinder(HTMLParser):
    """Finds the first element that matches a path of child steps. Its inner markup is a stretch of the page, as it is written there."""

    def __init__(self, page: str, steps: list[tuple[str | None, str | None, set[str], int | None]]) -> None:
        super().__init__(convert_charrefs=False)
        self.page, self.steps = page, steps
        self.lines = [0, *(m.end() for m in re.finditer("\n", page))]
        self.path: list[tuple[str, str | None, set[str], int]] = []
        self.children = [0]
        self.depth: int | None = None
        self.begin, self.end = 0, len(page)
        self.feed(page)
        self.close()

    def place(self) -> int:
        """Where the tag that is being read begins."""
        line, offset = self.getpos()
        return self.lines[line - 1] + offset

    def matches(self) -> bool:
        tail = self.path[-len(self.steps) :]
        return len(tail) == len(self.steps) and all(
            (tag is None or tag == name) and (ident is None or ident == own) and classes <= worn and (nth is None or nth == place)
            for (tag, ident, classes, nth), (name, own, worn, place) in zip(self.steps, tail)
        )

    def handle_starttag(self, tag, attrs):
        self.children[-1] += 1
        if tag in VOID:
            return
        self.path.append((tag, dict(attrs).get("id"), set((dict(attrs).get("class") or "").split()), self.children[-1]))
        self.children.append(0)
        if self.depth is None and self.matches():
            self.depth, self.begin = len(self.path), self.place() + len(self.get_starttag_text())

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if all(tag != name for name, *_ in self.path):
            return
        while True:
            if self.depth == len(self.path):
                # Below 1, so no other element is looked for.
                self.end, self.depth = max(self.begin, self.place()), 0
            name, *_ = self.path.pop()
            self.children.pop()
            if name == tag:
                break

    def result(self) -> str | None:
        return None if self.depth is None else self.page[self.begin : self.end]


def _step(text: str) -> tuple[str | None, str | None, set[str], int | None]:
    match = re.fullmatch(r"([a-zA-Z][\w-]*)?(?:#([\w-]+))?((?:\.[\w-]+)*)(?::nth-child\((\d+)\))?", text.strip())
    if not match or not text.strip():
        raise ValueError(f"unsupported selector step: {text!r}")
    tag, ident, classes, nth = match.groups()
    return tag and tag.lower(), ident, set(classes.split(".")) - {""}, int(nth) if nth else None


def inner_html(html: Column, selector: str) -> Column:
    """Markup inside the first element, as it is written in the page, at `selector`, a path such as `#main > div.a.b > p:nth-child(2)`."""
    steps = [_step(part) for part in selector.split(">")]

    @F.pandas_udf("string")
    def find(pages: pd.Series) -> pd.Series:
        def one(page: str | None) -> str | None:
            if page is None:
                return None
            return _ElementFinder(page, steps).result()

        return pages.map(one)

    return find(html)


@F.pandas_udf(T.StringType())
def html_to_markdown(html: pd.Series) -> pd.Series:
    def one(page: str | None) -> str | None:
        if page is None:
            return None
        writer = _MarkdownWriter()
        writer.feed(page)
        writer.close()
        return writer.result()

    return html.map(one)

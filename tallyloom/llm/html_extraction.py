"""Main text of web pages by a recurrent block labeller.

A page is a sequence of blocks, each a vector of its tag path, hashed words and size.
A bidirectional LSTM in numpy reads the whole sequence in both directions and says of
each block whether it belongs to the article. It is trained here, on at most FIT_PAGES
pages: their blocks are labelled by what their elements say of themselves, and are set
again into other layouts (sidebars, notices, forms, comments, other article holders),
so that it learns the parts that the pages at hand happen not to have.

Defined cases: a null html is an empty one and gives an empty text. A page without
blocks, or without a block that is main text, gives an empty text. Pages are taken row
by row; repeated and null ids don't matter. Block text: character references decoded,
white space to one space, trimmed; main blocks joined by one space, whatever their
number or length. `text` and `n_chars` replace columns of these names; other extra
columns are passed on.
"""

from __future__ import annotations

import html
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.html_blocks import WIDTH, blocks, features
from tallyloom.llm.sample import drawn
from tallyloom.llm.words import slices

#: Pages that the model is trained on, at most, and blocks of one of them that are learnt from.
FIT_PAGES, FIT_BLOCKS = 300, 64
HIDDEN, EPOCHS, BATCH, RATE, SEED = 24, 14, 32, 0.01, 5
#: Numbers that one forward step may hold.
_STEP = 1 << 21


class Labeller:
    """Weights of the two directions and of the output."""

    def __init__(self, width: int = WIDTH, hidden: int = HIDDEN, seed: int = SEED):
        random = np.random.default_rng(seed)
        self.hidden = hidden
        self.w = [np.concatenate([random.normal(0, 0.1, (width, 4 * hidden)), random.normal(0, 0.2, (hidden, 4 * hidden)), np.zeros((1, 4 * hidden))]).astype(np.float32) for _ in range(2)]
        for w in self.w:
            w[-1, hidden : 2 * hidden] = 1.0  # remember at first
        self.out = np.concatenate([random.normal(0, 0.2, 2 * hidden), [0.0]]).astype(np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [*self.w, self.out]

    def _run(self, w: np.ndarray, x: np.ndarray, mask: np.ndarray, keep: bool):
        """States after each step of x (time, pages, width); a page that has ended keeps its state."""
        n, h = self.hidden, np.zeros((x.shape[1], self.hidden), np.float32)
        c, states, trace = h, np.empty((len(x), x.shape[1], n), np.float32), []
        given = x.reshape(-1, x.shape[2]) @ w[: x.shape[2]] + w[-1]
        given = given.reshape(len(x), x.shape[1], 4 * n)
        inner = w[x.shape[2] : -1]
        for t in range(len(x)):
            z = given[t] + h @ inner
            gates = 1 / (1 + np.exp(-np.clip(z[:, : 3 * n], -30, 30)))
            i, f, o, g = gates[:, :n], gates[:, n : 2 * n], gates[:, 2 * n :], np.tanh(z[:, 3 * n :])
            new_c = f * c + i * g
            tanh_c = np.tanh(new_c)
            m = mask[t][:, None]
            if keep:
                trace.append((h, c, i, f, o, g, tanh_c, m))
            h, c = np.where(m, o * tanh_c, h), np.where(m, new_c, c)
            states[t] = h
        return states, trace

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Log odds of main text for x (time, pages, width)."""
        ahead, trace = self._run(self.w[0], x, mask, keep)
        back, back_trace = self._run(self.w[1], x[::-1], mask[::-1], keep)
        both = np.concatenate([ahead, back[::-1]], axis=2)
        return both @ self.out[:-1] + self.out[-1], (both, trace, back_trace)

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
        """Of the mean logistic loss over labelled blocks."""
        odds, (both, trace, back_trace) = self.forward(x, mask, True)
        wrong = ((1 / (1 + np.exp(-np.clip(odds, -30, 30))) - y) * weight / max(1.0, weight.sum())).astype(np.float32)
        out = np.append((both * wrong[:, :, None]).sum((0, 1)), wrong.sum())
        to_state = wrong[:, :, None] * self.out[:-1]
        n = self.hidden
        return [self._back(self.w[0], x, trace, to_state[:, :, :n]), self._back(self.w[1], x[::-1], back_trace, to_state[::-1, :, n:]), out]

    def _back(self, w: np.ndarray, x: np.ndarray, trace: list, to_state: np.ndarray) -> np.ndarray:
        n, inner, total = self.hidden, w[x.shape[2] : -1], np.zeros_like(w)
        dh = dc = np.zeros((x.shape[1], n), np.float32)
        dz_all = np.empty((len(x), x.shape[1], 4 * n), np.float32)
        for t in range(len(x) - 1, -1, -1):
            h, c, i, f, o, g, tanh_c, m = trace[t]
            dh = dh + to_state[t]
            own, own_c = np.where(m, dh, 0), np.where(m, dc, 0)
            own_c = own_c + own * o * (1 - tanh_c * tanh_c)
            dz = np.concatenate([own_c * g * i * (1 - i), own_c * c * f * (1 - f), own * tanh_c * o * (1 - o), own_c * i * (1 - g * g)], axis=1)
            dz_all[t] = dz
            total[x.shape[2] : -1] += h.T @ dz
            dh = np.where(m, 0, dh) + dz @ inner.T
            dc = np.where(m, own_c * f, dc)
        flat = dz_all.reshape(-1, 4 * n)
        total[: x.shape[2]] = x.reshape(-1, x.shape[2]).T @ flat
        total[-1] = flat.sum(0)
        return total


# Layouts that known texts are set into for training.
_HOLDERS = [
    "<article>", "<main>", '<div class="content">', '<div id="article-body">', '<section class="post entry">', '<div class="story main-text">', '<div role="main">', "<main><article>", "<div>", "",
]
_BESIDE = [
    "<nav>", "<header>", "<footer>", "<aside>", "<form>", '<div class="ad">', '<div class="advert banner">', '<div class="sidebar widget">', '<ul class="menu">', '<div id="comments">',
    '<section class="comments">', '<div class="comment reply">', '<div class="cookie-notice">', '<div class="notice alert">', '<div class="newsletter signup">', '<div class="related">',
    '<div class="social share">', '<div id="footer">', '<div id="header" class="masthead">', '<aside class="promo">', '<ol class="breadcrumb">', '<div class="login popup modal">',
]
_LEAVES = ["<p>", "<p>", "<p>", "<p>", "<div>", "<li>", "<h2>", "<blockquote>", "<td>"]


def _around(opening: str, inside: str) -> str:
    names = [part.split(" ")[0].strip("<>") for part in opening.replace("><", ">|<").split("|") if part]
    return opening + inside + "".join(f"</{name}>" for name in reversed(names))


def recomposed(random: np.random.Generator, main: list[str], other: list[str]) -> tuple[str, list[int]]:
    """A page that sets some known texts into a random layout, and the labels of its blocks."""
    labels: list[int] = []
    pick = lambda texts: html.escape(texts[random.integers(len(texts))])

    def beside() -> str:
        opening = _BESIDE[random.integers(len(_BESIDE))]
        out = ""
        for _ in range(random.integers(1, 5)):
            text = pick(other if random.random() < 0.5 else main)
            leaf = _LEAVES[random.integers(len(_LEAVES))]
            out += _around(leaf, f'<a href="/x">{text}</a>' if random.random() < 0.4 else text)
            labels.append(0)
        return _around(opening, out)

    def article() -> str:
        out = ""
        if random.random() < 0.8:
            out += f"<h1>{pick(main)[:80].strip() or 'x'}</h1>"
            labels.append(1)
        for _ in range(random.integers(1, 12)):
            if random.random() < 0.08:
                out += beside()
            out += _around(_LEAVES[random.integers(len(_LEAVES))], pick(main if random.random() < 0.8 else other))
            labels.append(1)
        return out

    page = "".join(beside() for _ in range(random.integers(0, 4)))
    page += _around(_HOLDERS[random.integers(len(_HOLDERS))], article())
    page += "".join(beside() for _ in range(random.integers(0, 4)))
    return f"<html><body>{page}</body></html>", labels


def training_set(pages: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(features, labels) of the pages as they are and recomposed twice; label -1 counts for nothing."""
    random = np.random.default_rng(SEED)
    read = [blocks(page) for page in pages]
    out = [(features(own), np.array([-1 if b.said is None else b.said for b in own])) for own in read]
    texts = {said: [b.text for own in read for b in own if b.said == said] for said in (0, 1, None)}
    every = texts[0] + texts[1] + texts[None]
    main, other = texts[1] or every, texts[0] or every
    for _ in range(2 * len(pages) if every else 0):
        page, labels = recomposed(random, main, other)
        own = blocks(page)
        if len(own) == len(labels):
            out.append((features(own), np.array(labels)))
    return [(x[:FIT_BLOCKS], y[:FIT_BLOCKS]) for x, y in out if len(x)]


def padded(group: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(time, pages, width) and where it holds blocks."""
    size = max(map(len, group))
    x, mask = np.zeros((size, len(group), group[0].shape[1]), np.float32), np.zeros((size, len(group)), bool)
    for i, own in enumerate(group):
        x[: len(own), i], mask[: len(own), i] = own, True
    return x, mask


def train(examples: list[tuple[np.ndarray, np.ndarray]], epochs: int = EPOCHS) -> Labeller:
    """Adam over batches of pages of like length; the same examples give the same weights."""
    model, random = Labeller(), np.random.default_rng(SEED)
    first, second, step = [np.zeros_like(p) for p in model.parameters()], [np.zeros_like(p) for p in model.parameters()], 0
    by_size = sorted(range(len(examples)), key=lambda i: len(examples[i][0]))
    batches = [by_size[i : i + BATCH] for i in range(0, len(by_size), BATCH)]
    for epoch in range(epochs):
        for b in random.permutation(len(batches)):
            x, mask = padded([examples[i][0] for i in batches[b]])
            y, weight = np.zeros(mask.shape, np.float32), np.zeros(mask.shape, np.float32)
            for at, i in enumerate(batches[b]):
                own = examples[i][1]
                y[: len(own), at], weight[: len(own), at] = own > 0, own >= 0
            step += 1
            rate = RATE * (1 - epoch / epochs) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for p, g, m, v in zip(model.parameters(), model.gradients(x, mask, y, weight), first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= (rate * m / (np.sqrt(v) + 1e-8)).astype(np.float32)
    return model


def fit(pages: DataFrame, html_column: str = "html", fit_pages: int = FIT_PAGES) -> Labeller:
    """A labeller from at most `fit_pages` of the pages, those whose html hashes lowest."""
    some = pages.where(F.length(html_column) > 0).select(F.col(html_column).alias("html"))
    return train(training_set([row.html for row in drawn(some, fit_pages, "html").collect()]))


def main_texts(model: Labeller, pages: list[str]) -> list[str]:
    """The main text of each page; pages of like length are read together."""
    read = [blocks(page) for page in pages]
    order = sorted((i for i in range(len(read)) if read[i]), key=lambda i: len(read[i]))
    out = [""] * len(pages)
    at = 0
    while at < len(order):
        # Sorted, so the last page of a group is the longest.
        end = at + 1
        while end < len(order) and end - at < 256 and (end - at + 1) * len(read[order[end]]) * WIDTH <= _STEP:
            end += 1
        group = order[at:end]
        odds, _ = model.forward(*padded([features(read[i]) for i in group]))
        for column, i in enumerate(group):
            out[i] = " ".join(b.text for b, o in zip(read[i], odds[:, column]) if o > 0)
        at = end
    return out


def extract(pages: DataFrame, html_column: str = "html", model: Labeller | None = None) -> DataFrame:
    """`pages` without the html, with `text` and `n_chars`. Map-only once the model is trained."""
    model = model or fit(pages, html_column)
    others = [c for c in pages.columns if c not in (html_column, "text", "n_chars")]
    plain = pages.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(others)), F.coalesce(F.col(html_column).cast("string"), F.lit("")).alias("html"))
    carried = [f"c{i}" for i in range(len(others))]

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                texts = main_texts(model, part.column("html").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(c) for c in carried] + [pa.array(texts, pa.string())], names=[*carried, "text"])

    found = plain.mapInArrow(label, plain.select(*carried, F.lit("").alias("text")).schema)
    return found.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(others)), "text", F.length("text").cast("long").alias("n_chars"))

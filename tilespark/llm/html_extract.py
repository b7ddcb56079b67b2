"""Main text of HTML pages by a recurrent block labeller.

A page is a sequence of leaf blocks: the text between two tags that aren't inline. Each block is a vector: its tag path
(tags, classes, ids and roles of the open elements) and its words, both hashed, and a few numbers (length, share of
link text, punctuation, place). A bidirectional LSTM in numpy reads the whole sequence, so every block is judged
with the blocks before and after it, and labels it main text or not.

The network is trained on pages that are generated here, from a fixed seed, with many layouts and names, and kept by
the driver's process; its weights (some 100 KB) are broadcast.
"""

from __future__ import annotations

import functools
import math
import re
import zlib
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import span_hashes, text_buffers, word_spans

INLINE = frozenset("a b i img em strong span u s small sub sup code mark abbr cite q font big tt kbd var samp time ins del bdi bdo dfn data wbr acronym strike".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page.
SILENT = frozenset("script style noscript template head title svg math iframe object select datalist textarea canvas".split())
#: A start tag of the first kind ends an open element of these kinds.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
    **dict.fromkeys("p div ul ol table article section header footer nav aside main form h1 h2 h3 h4 h5 h6 blockquote pre hr dl figure fieldset address".split(), {"p"}),
}
PATH, WORDS, NUMBERS = 512, 32, 8
INPUT = PATH + WORDS + NUMBERS
HIDDEN = 24
#: Blocks times pages that are labelled at once; what the network holds meanwhile grows with it. A longer page goes in pieces.
STEPS = 16_384
_TOKEN = re.compile(r"[a-z]+|\d+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


@functools.lru_cache(100_000)
def _slot(token: str, size: int) -> int:
    return zlib.crc32(token.encode()) % size


@functools.lru_cache(50_000)
def _names(tag: str, attrs: tuple) -> tuple[str, ...]:
    """The tag and the words of class, id and role."""
    out = [f"<{tag}>"]
    for key, value in attrs:
        if key in ("class", "id", "role", "itemprop", "aria-label") and value:
            out += _TOKEN.findall(_CAMEL.sub(" ", value).lower())
    return tuple(out)


class Blocks(HTMLParser):
    """blocks: (path tokens, text, characters of link text) of each leaf block with text."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[tuple[str, ...], str, int]] = []
        self.open: list[tuple[str, tuple[str, ...]]] = []
        self.text: list[str] = []
        self.path: tuple[str, ...] = ()
        self.linked = self.links = self.silent = 0

    def flush(self):
        if self.text:
            text = " ".join("".join(self.text).split())
            if text:
                self.blocks.append((self.path, text, self.linked))
            self.text, self.linked = [], 0

    def pop(self, at: int):
        for tag, _ in self.open[at:]:
            self.links -= tag == "a"
            self.silent -= tag in SILENT
        del self.open[at:]

    def handle_starttag(self, tag, attrs):
        if tag not in INLINE:
            self.flush()
        ends = CLOSES.get(tag)
        if ends:
            for k in range(len(self.open) - 1, -1, -1):
                if self.open[k][0] in ends:
                    self.flush()
                    self.pop(k)
                    break
                if self.open[k][0] not in INLINE and self.open[k][0] != "p":
                    break
        if tag not in VOID:
            if tag == "body":
                self.pop(next((k for k, x in enumerate(self.open) if x[0] == "head"), len(self.open)))
            self.open.append((tag, _names(tag, tuple(attrs))))
            self.links += tag == "a"
            self.silent += tag in SILENT

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag not in INLINE:
            self.flush()
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                self.pop(k)
                return

    def handle_data(self, data):
        if self.silent:
            return
        if not self.text:
            if not data.strip():
                return
            self.path = tuple(t for _, names in self.open for t in names)
        self.text.append(data)
        if self.links:
            self.linked += len(data)


def blocks(html: str) -> list[tuple[tuple[str, ...], str, int]]:
    parser = Blocks()
    parser.feed(html)
    parser.close()
    parser.flush()
    return parser.blocks


def path_vector(path: tuple[str, ...]) -> np.ndarray:
    out = np.zeros(PATH, dtype=np.float32)
    np.add.at(out, [_slot(t, PATH) for t in path], np.float32(0.5))
    return np.minimum(out, 1.0)


def word_vectors(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed word counts of each text, scaled to length one, and the numbers of words."""
    buffer, offsets = text_buffers(pa.array([t.lower() for t in texts], pa.string()))
    starts, ends = word_spans(buffer)
    firsts = np.searchsorted(starts, offsets)
    text = np.repeat(np.arange(len(texts)), np.diff(firsts))
    cell = (span_hashes(buffer, starts, ends) % np.uint64(WORDS)).astype(np.int64)
    counts = np.bincount(text * WORDS + cell, minlength=len(texts) * WORDS).reshape(-1, WORDS).astype(np.float32)
    return counts / np.sqrt((counts * counts).sum(axis=1, keepdims=True)).clip(1), np.diff(firsts)


def dense_vectors(pages: list[list[tuple[tuple[str, ...], str, int]]], parts: list[tuple[int, int, int]] | None = None) -> list[np.ndarray]:
    """For each page, a row of WORDS + NUMBERS numbers for each block. parts: where a page is only a part of one, the number
    of its first block, and the blocks and characters of the whole."""
    words, n_words = word_vectors([t for page in pages for _, t, _ in page])
    rows = []
    at = 0
    for which, page in enumerate(pages):
        first, n, total = parts[which] if parts else (0, len(page), max(1, sum(len(t) for _, t, _ in page)))
        for k, (path, text, linked) in enumerate(page, first):
            size = max(1, int(n_words[at]))
            rows.append((math.log1p(size) / 4, min(1.0, linked / len(text)), (text.count(".") + text.count(",")) / size, (k + 0.5) / n, text[-1] in ".!?", len(text) / total, len(path) / 16, 1.0))
            at += 1
    both = np.concatenate((words, np.asarray(rows, dtype=np.float32).reshape(-1, NUMBERS)), axis=1)
    edges = np.cumsum([len(p) for p in pages])[:-1]
    return np.split(both, edges)


def vectors(pages: list[list[tuple[tuple[str, ...], str, int]]]) -> list[np.ndarray]:
    """For each page, a row of INPUT numbers for each block."""
    return [np.concatenate((np.stack([path_vector(p) for p, _, _ in page]), d), axis=1) for page, d in zip(pages, dense_vectors(pages), strict=True)]


# ---------------------------------------------------------------- the network


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _run(pre: np.ndarray, mask: np.ndarray, u: np.ndarray, keep: bool):
    """One direction over what the inputs give to the gates, (time, pages, 4 HIDDEN); masked steps pass the state on."""
    return _steps(pre, mask, u, keep, None)[:2]


def _steps(pre: np.ndarray, mask: np.ndarray, u: np.ndarray, keep: bool, state):
    """The same from a state (h, c) on, or from zeros; also returns the state after the last step."""
    steps, pages, _ = pre.shape
    h, c = state or (np.zeros((pages, HIDDEN), dtype=np.float32),) * 2
    hs, kept = np.empty((steps, pages, HIDDEN), dtype=np.float32), []
    for t in range(steps):
        z = pre[t] + h @ u
        gates = _sigmoid(z[:, : 3 * HIDDEN])
        i, f, o, g = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :], np.tanh(z[:, 3 * HIDDEN :])
        m = mask[t][:, None]
        c2 = f * c + i * g
        tc = np.tanh(c2)
        h2 = o * tc
        if keep:
            kept.append((i, f, o, g, c, tc, h, m))
        c, h = np.where(m, c2, c), np.where(m, h2, h)
        hs[t] = h
    return hs, kept, (h, c)


def _back(x, dhs, kept, u):
    """Gradients of w, u and b by backpropagation through time."""
    steps, pages, _ = x.shape
    du = np.zeros_like(u)
    dh, dc = np.zeros((pages, HIDDEN), dtype=x.dtype), np.zeros((pages, HIDDEN), dtype=x.dtype)
    dz_all = np.empty((steps, pages, 4 * HIDDEN), dtype=x.dtype)
    for t in range(steps - 1, -1, -1):
        i, f, o, g, c, tc, h, m = kept[t]
        dh = dh + dhs[t]
        dnow = dh * m
        dcell = dc * m + dnow * o * (1 - tc * tc)
        dz = np.concatenate((dcell * g * i * (1 - i), dcell * c * f * (1 - f), dnow * tc * o * (1 - o), dcell * i * (1 - g * g)), axis=1)
        dz_all[t] = dz
        du += h.T @ dz
        dh = dh * (1 - m) + dz @ u.T
        dc = dc * (1 - m) + dcell * f
    flat = dz_all.reshape(-1, 4 * HIDDEN)
    return x.reshape(-1, INPUT).T @ flat, du, flat.sum(axis=0)


def pad(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(time, pages, values) with zeros after a page's end, and which steps are within each page."""
    steps = max(len(p) for p in pages)
    x = np.zeros((steps, len(pages), pages[0].shape[1]), dtype=np.float32)
    mask = np.zeros((steps, len(pages)), dtype=bool)
    for k, p in enumerate(pages):
        x[: len(p), k], mask[: len(p), k] = p, True
    return x, mask


class Labeller:
    """The network for many pages; what a tag path gives to the gates is computed once for each path."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.weights = weights
        self.dense = np.concatenate((weights["wf"][PATH:], weights["wb"][PATH:]), axis=1)
        self.path = np.concatenate((weights["wf"][:PATH], weights["wb"][:PATH]), axis=1)
        self.bias = np.concatenate((weights["bf"], weights["bb"]))
        self.paths: dict[tuple[str, ...], np.ndarray] = {}

    def _path(self, path: tuple[str, ...]) -> np.ndarray:
        if path not in self.paths:
            if len(self.paths) >= 50_000:
                self.paths.clear()
            self.paths[path] = path_vector(path) @ self.path + self.bias
        return self.paths[path]

    def label(self, pages: list[list[tuple[tuple[str, ...], str, int]]]) -> list[np.ndarray]:
        """The probability of each block of each page to be main text."""
        given = [d @ self.dense + np.stack([self._path(p) for p, _, _ in page]) for page, d in zip(pages, dense_vectors(pages), strict=True)]
        x, mask = pad(given)
        forward, _ = _run(x[:, :, : 4 * HIDDEN], mask, self.weights["uf"], False)
        backward, _ = _run(x[::-1, :, 4 * HIDDEN :], mask[::-1], self.weights["ub"], False)
        p = _sigmoid(np.concatenate((forward, backward[::-1]), axis=2) @ self.weights["out"] + self.weights["bias"])
        return [p[: len(page), k] for k, page in enumerate(pages)]


    def label_long(self, page: list[tuple[tuple[str, ...], str, int]], steps: int = STEPS) -> np.ndarray:
        """The same for one long page, in pieces that pass the state on: backwards first, of which one number for each
        block is kept, then forwards."""
        total = max(1, sum(len(t) for _, t, _ in page))
        sides = {}
        for side, u, out in (("b", "ub", self.weights["out"][HIDDEN:]), ("f", "uf", self.weights["out"][:HIDDEN])):
            columns = slice(4 * HIDDEN, None) if side == "b" else slice(None, 4 * HIDDEN)
            given, state = np.empty(len(page), dtype=np.float32), None
            begins = range(0, len(page), steps)
            for at in reversed(begins) if side == "b" else begins:
                part = page[at : at + steps]
                x = dense_vectors([part], [(at, len(page), total)])[0] @ self.dense[:, columns] + np.stack([self._path(p)[columns] for p, _, _ in part])
                x = x[::-1] if side == "b" else x
                hs, _, state = _steps(x[:, None, :], np.ones((len(part), 1), dtype=bool), self.weights[u], False, state)
                scores = hs[:, 0] @ out
                given[at : at + steps] = scores[::-1] if side == "b" else scores
            sides[side] = given
        return _sigmoid(sides["f"] + sides["b"] + self.weights["bias"])


@functools.cache
def trained(n_pages: int = 1_500, epochs: int = 8, seed: int = 11) -> dict[str, np.ndarray]:
    """Weights after training on generated pages (Adam, cross entropy)."""
    from .html_pages import page

    rng = np.random.default_rng(seed)
    made = [page(rng) for _ in range(n_pages)]
    made = [(found, wanted) for found, wanted in ((blocks(html), wanted) for html, wanted in made) if found]
    data = [(x, np.asarray([t in wanted for _, t, _ in found], dtype=np.float32)) for x, (found, wanted) in zip(vectors([f for f, _ in made]), made, strict=True)]
    size = lambda *s: (rng.standard_normal(s) / math.sqrt(s[0])).astype(np.float32)
    weights = {k + d: v for d in "fb" for k, v in (("w", size(INPUT, 4 * HIDDEN)), ("u", size(HIDDEN, 4 * HIDDEN)), ("b", np.repeat(np.float32([0, 1, 0, 0]), HIDDEN)))}
    weights |= {"out": size(2 * HIDDEN), "bias": np.zeros(1, dtype=np.float32)}
    first, second, step = {k: np.zeros_like(v) for k, v in weights.items()}, {k: np.zeros_like(v) for k, v in weights.items()}, 0
    for epoch in range(epochs):
        order = rng.permutation(len(data))
        order = order[np.argsort([len(data[k][0]) // 8 for k in order], kind="stable")]
        groups = [order[k : k + 32] for k in range(0, len(order), 32)]
        for g in rng.permutation(len(groups)):
            pages = [data[k] for k in groups[g]]
            x, mask = pad([p for p, _ in pages])
            y = np.zeros(mask.shape, dtype=np.float32)
            for k, (_, t) in enumerate(pages):
                y[: len(t), k] = t
            forward, kf = _run(x @ weights["wf"] + weights["bf"], mask, weights["uf"], True)
            backward, kb = _run(x[::-1] @ weights["wb"] + weights["bb"], mask[::-1], weights["ub"], True)
            both = np.concatenate((forward, backward[::-1]), axis=2)
            d = (_sigmoid(both @ weights["out"] + weights["bias"]) - y) * mask / mask.sum()
            dboth = d[:, :, None] * weights["out"]
            grads = {"out": np.einsum("tp,tph->h", d, both), "bias": d.sum(keepdims=True).reshape(1)}
            grads["wf"], grads["uf"], grads["bf"] = _back(x, dboth[:, :, :HIDDEN], kf, weights["uf"])
            grads["wb"], grads["ub"], grads["bb"] = _back(x[::-1], dboth[::-1, :, HIDDEN:], kb, weights["ub"])
            step += 1
            rate = 0.01 * 0.5 * (1 + math.cos(math.pi * step / (epochs * len(groups))))
            for k, v in weights.items():
                first[k] += 0.1 * (grads[k] - first[k])
                second[k] += 0.01 * (grads[k] ** 2 - second[k])
                v -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return weights


# ---------------------------------------------------------------- the operator


def groups(sizes: list[int], most_pages: int = 64, most_steps: int = STEPS) -> list[list[int]]:
    """Numbers of pages that are labelled together, of like length: at most so many, and at most so many steps times
    pages, as all are padded to the longest. A longer page is alone."""
    out, own = [], []
    for k in sorted((k for k, n in enumerate(sizes) if n), key=sizes.__getitem__):
        if own and (len(own) == most_pages or sizes[k] * (len(own) + 1) > most_steps):
            out.append(own)
            own = []
        own.append(k)
    return [*out, own] if own else out


def main_text(pages: list[str | None], labeller: Labeller, group: int = 64) -> list[str]:
    """The main text of each page."""
    found = [blocks(html or "") for html in pages]
    out = [""] * len(pages)
    for own in groups([len(b) for b in found], group):
        label = labeller.label([found[k] for k in own]) if len(found[own[0]]) <= STEPS else [labeller.label_long(found[own[0]])]
        for k, p in zip(own, label, strict=True):
            out[k] = " ".join(text for (_, text, _), v in zip(found[k], p.tolist(), strict=True) if v >= 0.5)
    return out


def _extract(weights):
    def run(batches):
        labeller = Labeller(weights.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = main_text(part.column(2).to_pylist(), labeller)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return run


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars (code points) for each row of pages.

    Null and empty html, and pages without main text, give the empty string and 0. Character references are decoded,
    white space within a block becomes one space, blocks are joined in page order by one space. Repeated rows get a
    row each. A null id or url stays null. An empty table gives no rows. Other columns are not read."""
    weights = pages.sparkSession.sparkContext.broadcast(trained())
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(_extract(weights), "page_id long, url string, text string, n_chars long")

"""Main text of web pages by a recurrent block labeller.

A page becomes its sequence of leaf blocks: runs of text between block-level tags, with the
path of open tags and the words of their class, id and role attributes. Each block is the
sum of its path's hashed vectors, the mean of its words' hashed vectors and a few numbers;
a bidirectional LSTM in numpy reads the whole sequence both ways, so every block is judged
by its own looks and by all of its document, and the blocks judged main text are joined.

The labeller is trained here on a bounded sample of the table's own pages. Their semantic
tags are the teacher; each sampled page is also rewritten several times with its containers
renamed and boilerplate of many kinds put around and inside, so the labeller does not lean
on one layout.
"""

from __future__ import annotations

import html
import math
import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.llm.labels import least_hashes

# bounds of what the labeller is fitted on; every page is labelled whole
SAMPLE_PAGES = 240  # pages for training, drawn by hash
REWRITES = 4  # of each sampled page
MAIN_BLOCKS = 60  # main blocks of a sampled page that go into its rewritten forms
POOL_TEXTS = 20_000  # texts of the sample that boilerplate is made of
PROSE_WORDS = 8  # words that a block of a page without semantic tags needs to be rewritten as main text
EPOCHS = 5
PATH_BUCKETS = 1024
WORD_BUCKETS = 64
EMBED = 24
HIDDEN = 16
NUMBERS = 9
BATCH = 32

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea iframe".split())  # no markup inside, none of it is text of the page
FOREIGN = frozenset("svg math".split())  # inside them any element may close itself
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong"
    " sub sup time tt u var img wbr math mi mn mo ms mrow mtext mspace msub msup msubsup mfrac msqrt mroot munder mover munderover"
    " mstyle mpadded mphantom menclose semantics".split()
)
CLOSES = {  # an opening tag ends an open element of these kinds, up to the given ancestors
    "p": (("p",), ("div", "article", "section", "td", "li", "body", "main", "aside", "blockquote")),
    "li": (("li",), ("ul", "ol")), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "option": (("option",), ("select",)),
}
ENDS_P = frozenset(
    "div article section ul ol table h1 h2 h3 h4 h5 h6 header footer nav aside main form blockquote pre hr dl figure".split()
)
MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^\"'>]|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|</?[A-Za-z][^>]*>",
    re.S,
)
NAMED = re.compile(r"(?:^|\s)(class|id|role|data-block-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Block:
    __slots__ = ("path", "text", "links", "label")

    def __init__(self, path: tuple[str, ...], text: str, links: int, label: str | None):
        self.path, self.text, self.links, self.label = path, text, links, label


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page in order, with character references decoded and white space made single."""
    found: list[Block] = []
    stack: list[tuple[str, tuple[str, ...], str | None, bool]] = []  # (tag, path down to it, training label, in a link)
    parts: list[str] = []
    linked = [0]

    def flush() -> None:
        text = " ".join("".join(parts).split())
        if text:
            found.append(Block(stack[-1][1] if stack else (), text, linked[0], stack[-1][2] if stack else None))
        parts.clear()
        linked[0] = 0

    def add(raw: str) -> None:
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if stack and stack[-1][3]:
                linked[0] += len(text.strip())

    def close_to(at: int) -> None:
        del stack[at:]

    at, end = 0, len(page)
    while at < end:
        m = MARKUP.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if tag not in INLINE:
            flush()
        if m[1]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    close_to(i)
                    break
            continue
        if tag in RAW:
            if not m[3].rstrip().endswith("/"):
                over = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at = over.end() if over else end
            continue
        if tag in ENDS_P or tag in CLOSES:
            kinds, limits = CLOSES.get(tag, (("p",), ("article", "section", "td", "li", "body", "main", "aside")))
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in kinds:
                    close_to(i)
                    break
                if stack[i][0] in limits:
                    break
        if tag in VOID:
            continue
        if m[3].rstrip().endswith("/") and (tag in FOREIGN or any(e[0] in FOREIGN for e in stack)):
            continue
        tokens, label = ["tag:" + tag], None
        if m[3] and "=" in m[3]:
            for name, a, b, c in NAMED.findall(m[3]):
                value = a or b or c
                if name == "data-block-label":
                    label = value
                else:
                    tokens += ["name:" + x.lower() for x in NAME_PART.findall(value)]
        above = stack[-1] if stack else ("", (), None, False)
        tokens.append(f"pair:{above[0]}>{tag}")
        stack.append((tag, above[1] + tuple(tokens), label or above[2], above[3] or tag == "a"))
    flush()
    return found


class Buckets(dict):
    """The hash bucket of each token, remembered; the memory starts afresh beyond a bound."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, token: str) -> int:
        if len(self) > 300_000:
            self.clear()
        found = self[token] = zlib.crc32(token.encode("utf-8", "replace")) % self.buckets
        return found


WORD_BUCKET = Buckets(WORD_BUCKETS)
PATH_BUCKET = Buckets(PATH_BUCKETS)


def block_features(sequence: list[Block]) -> tuple[list[tuple[str, ...]], np.ndarray]:
    """For each block its path, and its numbers with the shares of its words' buckets."""
    dense = np.zeros((len(sequence), NUMBERS + WORD_BUCKETS), dtype=np.float32)
    numbers, words_of = [], []
    for i, b in enumerate(sequence):
        text = b.text
        words = text.lower().split()
        n, chars = len(words), len(text)
        numbers.append((
            math.log1p(chars) / 5, math.log1p(n) / 4, b.links / chars, chars / n / 10, text[-1] in ".!?…\"»",
            (text.count(".") + text.count(",") + text.count(";")) / n,
            i / len(sequence), (len(sequence) - 1 - i) / len(sequence), 1.0,
        ))
        words_of.append([WORD_BUCKET[w] for w in words])
    if sequence:
        counts = np.array([len(w) for w in words_of])
        cell = np.repeat(np.arange(len(sequence)) * WORD_BUCKETS, counts) + np.array([x for w in words_of for x in w])
        dense[:, :NUMBERS] = numbers
        shares = np.bincount(cell, minlength=len(sequence) * WORD_BUCKETS).reshape(-1, WORD_BUCKETS)
        dense[:, NUMBERS:] = shares / counts[:, None]
    return [b.path for b in sequence], dense


class Labeller:
    """Embeddings of hashed paths and words, a bidirectional LSTM, a logistic output for each block."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)

        def draw(*shape: int, scale: float) -> np.ndarray:
            return (r.standard_normal(shape) * scale).astype(np.float32)

        self.p = {
            "path": draw(PATH_BUCKETS, EMBED, scale=0.3), "dense": draw(NUMBERS + WORD_BUCKETS, EMBED, scale=0.3),
            "out": draw(2 * HIDDEN + EMBED, scale=0.3), "bias": np.zeros(1, dtype=np.float32),
        }
        for d in "fb":
            self.p["x" + d] = draw(EMBED, 4 * HIDDEN, scale=EMBED**-0.5)
            self.p["h" + d] = draw(HIDDEN, 4 * HIDDEN, scale=HIDDEN**-0.5)
            self.p["c" + d] = np.repeat(np.float32([0, 1, 0, 0]), HIDDEN)  # forget gates open at first

    @staticmethod
    def batch(features: list[tuple[list[list[int]], np.ndarray]]):
        """Flat inputs of several sequences and their places in a padded (step, sequence) grid, forwards and backwards."""
        lengths = np.array([len(p) for p, _ in features])
        steps = np.concatenate([np.arange(n) for n in lengths])
        lane = np.repeat(np.arange(len(lengths)), lengths)
        known: dict[tuple[str, ...], int] = {}  # the different paths
        path = np.array([known.setdefault(p, len(known)) for paths, _ in features for p in paths])
        buckets = [[PATH_BUCKET[t] for t in dict.fromkeys(p)] for p in known]
        flat = np.array([i for x in buckets for i in x], dtype=np.int64)
        owner = np.repeat(np.arange(len(buckets)), [len(x) for x in buckets])
        order = {"f": steps, "b": lengths[lane] - 1 - steps}
        return lengths, lane, order, (path, flat, owner, len(known)), np.concatenate([d for _, d in features])

    def forward(self, batch, keep: bool = False):
        lengths, lane, order, (path, flat, owner, different), dense = batch
        p = self.p
        sums = np.zeros((different, EMBED), dtype=np.float32)
        np.add.at(sums, owner, p["path"][flat])
        x = np.tanh(sums[path] + dense @ p["dense"])
        states, outs = {}, []
        longest, lanes = int(lengths.max()), len(lengths)
        alive = np.arange(longest)[:, None] < lengths[None, :]
        for d in "fb":
            grid = np.zeros((longest, lanes, 4 * HIDDEN), dtype=np.float32)
            grid[order[d], lane] = x @ p["x" + d] + p["c" + d]
            h = c = np.zeros((lanes, HIDDEN), dtype=np.float32)
            trace, hs = [], np.zeros((longest, lanes, HIDDEN), dtype=np.float32)
            for t in range(longest):
                z = grid[t] + h @ p["h" + d]
                gates = 0.5 + 0.5 * np.tanh(0.5 * z[:, : 3 * HIDDEN])
                i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
                g = np.tanh(z[:, 3 * HIDDEN :])
                on = alive[t][:, None]
                c_new = np.where(on, f * c + i * g, c)
                squashed = np.tanh(c_new)
                h_new = np.where(on, o * squashed, h)
                if keep:
                    trace.append((h, c, i, f, o, g, squashed, on))
                h, c = h_new, c_new
                hs[t] = h
            states[d] = trace
            outs.append(hs[order[d], lane])
        top = np.hstack([*outs, x])
        logits = top @ p["out"] + p["bias"]
        return (logits, x, top, states) if keep else logits

    def gradients(self, batch, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        lengths, lane, order, (path, flat, owner, different), dense = batch
        logits, x, top, states = self.forward(batch, keep=True)
        p = self.p
        probability = 1 / (1 + np.exp(-np.clip(logits, -20, 20)))
        delta = ((probability - labels) / len(labels)).astype(np.float32)
        loss = float(-np.mean(np.log(np.where(labels > 0, probability, 1 - probability) + 1e-9)))
        grad = {"out": top.T @ delta, "bias": delta.sum(keepdims=True)}
        d_top = delta[:, None] * p["out"][None, :]
        dx = d_top[:, 2 * HIDDEN :].copy()
        longest, lanes = int(lengths.max()), len(lengths)
        for at, d in enumerate("fb"):
            d_hs = np.zeros((longest, lanes, HIDDEN), dtype=np.float32)
            d_hs[order[d], lane] = d_top[:, at * HIDDEN : (at + 1) * HIDDEN]
            d_grid = np.zeros((longest, lanes, 4 * HIDDEN), dtype=np.float32)
            d_rec = np.zeros_like(p["h" + d])
            dh = dc = np.zeros((lanes, HIDDEN), dtype=np.float32)
            for t in reversed(range(longest)):
                h, c, i, f, o, g, squashed, on = states[d][t]
                dh = dh + d_hs[t]
                own = np.where(on, dh, 0)
                d_cell = np.where(on, dc + own * o * (1 - squashed**2), 0)
                dz = np.hstack([d_cell * g * i * (1 - i), d_cell * c * f * (1 - f), own * squashed * o * (1 - o), d_cell * i * (1 - g**2)])
                d_grid[t] = dz
                d_rec += h.T @ dz
                dh = np.where(on, 0, dh) + dz @ p["h" + d].T
                dc = np.where(on, d_cell * f, dc)
            flat_grid = d_grid[order[d], lane]
            grad["x" + d], grad["c" + d], grad["h" + d] = x.T @ flat_grid, flat_grid.sum(0), d_rec
            dx += flat_grid @ p["x" + d].T
        dx *= 1 - x**2
        grad["dense"] = dense.T @ dx
        grad["path"] = np.zeros_like(p["path"])
        d_sums = np.zeros((different, EMBED), dtype=np.float32)
        np.add.at(d_sums, path, dx)
        np.add.at(grad["path"], flat, d_sums[owner])
        return loss, grad

    def train(self, data: list[tuple[tuple[list[list[int]], np.ndarray], np.ndarray]], epochs: int = EPOCHS,
              rate: float = 0.01, seed: int = 3) -> None:
        """Adam on batches of sequences, with words blanked at random so that layout counts most."""
        r = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for epoch in range(epochs):
            order = sorted(r.permutation(len(data)), key=lambda i: len(data[i][1]) // 8)  # like lengths together
            lots = [order[i : i + BATCH] for i in range(0, len(order), BATCH)]
            for lot in r.permutation(len(lots)):
                chosen = [data[i] for i in lots[lot]]
                batch = list(self.batch([f for f, _ in chosen]))
                dense = batch[4].copy()
                dense[r.random(len(dense)) < 0.5, NUMBERS:] = 0
                batch[4] = dense
                _, grad = self.gradients(tuple(batch), np.concatenate([y for _, y in chosen]))
                norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
                step += 1
                pace = rate * (0.3 if epoch >= epochs - 2 else 1.0)
                for k, g in grad.items():
                    g = g * min(1.0, 1.0 / (norm + 1e-9))
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.99 * second[k] + 0.01 * g * g
                    self.p[k] -= (pace * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)

    def label(self, features: list[tuple[list[list[int]], np.ndarray]]) -> list[np.ndarray]:
        """For each sequence which blocks are main text; sequences of like length share a batch."""
        out: list[np.ndarray] = [np.zeros(0, dtype=bool)] * len(features)
        order = sorted((i for i, (p, _) in enumerate(features) if p), key=lambda i: len(features[i][0]))
        at = 0
        while at < len(order):
            size = max(1, min(64, 60_000 // max(1, len(features[order[min(at + 63, len(order) - 1)]][0]))))
            lot = order[at : at + size]
            at += size
            logits = self.forward(self.batch([features[i] for i in lot]))
            ends = np.cumsum([len(features[i][0]) for i in lot])
            for i, part in zip(lot, np.split(logits > 0, ends[:-1])):
                out[i] = part
        return out


# --- training pages -----------------------------------------------------------------------

CONTENT_WRAPS = (
    '<article>', '<main>', '<div class="content">', '<div class="post-body">', '<div id="article-body">',
    '<section class="entry">', '<div class="story text">', '<div itemprop="articleBody" class="article">', '<div id="main-content">',
    '<div role="main">', '<div>', '<td class="body">',
)
# (opening tag, inner tag, wording) of boilerplate; wordings are mixed with words of the sample
BOILERPLATE = (
    ('<nav>', "link", "home about contact menu search login"), ('<ul class="menu">', "link", "home news sports more"),
    ('<div id="nav-bar">', "link", "products services support"), ('<div class="breadcrumb">', "link", "home category"),
    ('<header>', "p", "welcome site tagline"), ('<div class="site-header">', "p", "logo search sign in"),
    ('<div class="masthead banner">', "p", "edition subscribe"),
    ('<footer>', "p", "© copyright all rights reserved privacy terms"), ('<div id="footer">', "p", "© contact imprint privacy"),
    ('<div class="footer-links">', "link", "terms privacy cookies"),
    ('<aside>', "p", "read more popular latest"), ('<div class="sidebar">', "link", "popular posts archive tags"),
    ('<div class="widget">', "p", "recent posts weather"), ('<div class="related">', "link", "related articles you may also like"),
    ('<div class="cookie-notice">', "p", "we use cookies accept decline settings"), ('<div class="notice">', "p", "notice please note"),
    ('<div class="alert warning">', "p", "javascript is disabled update your browser"), ('<div role="dialog" class="modal popup">', "p", "subscribe close"),
    ('<div class="ad">', "p", "advertisement sponsored"), ('<div class="advert">', "p", "buy now offer sale"),
    ('<div id="ads-top">', "p", "sponsored"), ('<ins class="adsbygoogle">', "p", "ad"), ('<div class="sponsored promo">', "p", "promoted deal"),
    ('<form>', "form", "name email send submit"), ('<div class="newsletter">', "form", "subscribe email sign up"),
    ('<div class="comments">', "comment", "reply says posted like"), ('<section id="comments">', "comment", "comment reply report"),
    ('<ol class="comment-list">', "comment", "reply says"), ('<div id="disqus_thread">', "comment", "reply share"),
    ('<div class="share social">', "link", "share tweet like email"), ('<div class="tags">', "link", "tags topics"),
    ('<div class="pagination pager">', "link", "previous next page"), ('<div class="skip">', "link", "skip to content"),
)
CHROME = frozenset("nav header footer aside form head button select menu dialog".split())


def _semantic(sequence: list[Block]) -> bool:
    """Whether the page marks its main text at all."""
    return any(t in ("tag:article", "tag:main") for b in sequence for t in b.path)


def _prose(sequence: list[Block]) -> list[Block]:
    """Blocks of running text outside page chrome, of a page whose tags tell nothing."""
    return [
        b for b in sequence
        if len(b.text.split()) >= PROSE_WORDS and 3 * b.links < len(b.text.split()) and not {t[4:] for t in b.path} & CHROME
    ]


def _teacher(sequence: list[Block]) -> np.ndarray:
    """Main text by semantic tags: inside an article or main, outside page chrome and named boilerplate."""
    names = {w for opening, _, _ in BOILERPLATE for w in re.findall(r'(?:class|id)="([^"]*)"', opening) for w in NAME_PART.findall(w.lower())}
    names -= {"top", "text", "list", "links", "bar", "site", "more"}
    out = []
    for b in sequence:
        tags = {t[4:] for t in b.path if t.startswith("tag:")}
        named = {t[5:] for t in b.path if t.startswith("name:")}
        out.append(bool(tags & {"article", "main"}) and not tags & CHROME and not named & names)
    return np.array(out)


def _closing(opening: str) -> str:
    return "</" + re.match(r"<(\w+)", opening)[1] + ">"


def _boilerplate(r: random.Random, pool: list[str]) -> str:
    opening, kind, wording = r.choice(BOILERPLATE)

    def some(low: int, high: int) -> str:
        text = r.choice(pool).split()
        at = r.randrange(len(text))
        words = text[at : at + r.randint(low, high)]
        if r.random() < 0.6:
            words[:0] = r.sample(wording.split(), r.randint(1, len(wording.split())))
        return html.escape(" ".join(words))

    marked = opening[:-1] + ' data-block-label="0">'
    if kind == "link":
        body = "".join(f"<li><a href=\"#\">{some(1, 4)}</a></li>" for _ in range(r.randint(1, 8)))
        body = body if opening.startswith("<ul") or r.random() < 0.3 else f"<ul>{body}</ul>"
        if r.random() < 0.3:
            body = " | ".join(f"<a href=\"#\">{some(1, 4)}</a>" for _ in range(r.randint(2, 6)))
    elif kind == "form":
        body = f"<label>{some(1, 4)}</label><input name=x><button>{some(1, 3)}</button>" + (f"<p>{some(5, 20)}</p>" if r.random() < 0.5 else "")
    elif kind == "comment":
        wrap = r.choice(('<div class="comment">', '<li class="comment-body">', "<div>", '<article class="comment">'))
        body = f"<h3>{some(1, 3)}</h3>" + "".join(
            f"{wrap}<b>{some(1, 2)}</b><p>{some(5, 60)}</p>{_closing(wrap)}" for _ in range(r.randint(1, 4))
        )
    else:
        body = "".join(r.choice(("<p>{}</p>", "<div>{}</div>", "{}", "<span>{}</span>")).format(some(2, 40)) for _ in range(r.randint(1, 3)))
    return marked + body + _closing(opening)


def rewritten(r: random.Random, main: list[Block], pool: list[str]) -> str:
    """A page with the given main blocks in another layout, boilerplate around and inside, each part marked with its label."""
    inner, wrap = [], r.choice(CONTENT_WRAPS)
    title = html.escape(r.choice(pool)[:60])
    head_first = r.random() < 0.7
    if head_first:
        inner.append(f"<h{r.choice((1, 1, 2))}>{title}</h1>")
    for b in main:
        text = html.escape(b.text)
        style = r.random()
        if style < 0.7:
            inner.append(f"<p>{text}</p>" if r.random() < 0.8 else f"<p>{text}")
        elif style < 0.78:
            inner.append(f"<div>{text}</div>")
        elif style < 0.84:
            inner.append(f"<blockquote><p>{text}</p></blockquote>")
        elif style < 0.9:
            words = text.split()
            inner.append("<ul>" + "".join(f"<li>{' '.join(words[i : i + 12])}</li>" for i in range(0, len(words), 12)) + "</ul>")
        elif style < 0.95:
            inner.append(f"<h2>{' '.join(text.split()[:6])}</h2><p>{text}</p>")
        else:
            words = text.split()
            half = len(words) // 2
            inner.append(f"<p>{' '.join(words[:half])} <a href=\"#\"><b>{' '.join(words[half : half + 3])}</b></a> {' '.join(words[half + 3 :])}<br></p>")
    if r.random() < 0.5:
        for _ in range(r.randint(1, 2)):
            inner.insert(r.randint(0, len(inner)), _boilerplate(r, pool))
    before = [_boilerplate(r, pool) for _ in range(r.randint(0, 4))]
    after = [_boilerplate(r, pool) for _ in range(r.randint(0, 5))]
    marked = wrap[:-1] + ' data-block-label="1">'
    shell = r.choice(("{}", "<div>{}</div>", '<div class="page wrapper">{}</div>', '<div id="container"><div class="row">{}</div></div>'))
    body = shell.format("".join(before) + marked + "".join(inner) + _closing(wrap) + "".join(after))
    return f"<html><head><title>{title}</title></head><body>{body}</body></html>"


def training_data(pages: list[str], rewrites: int = REWRITES, seed: int = 11, main_blocks: int = MAIN_BLOCKS, pool_texts: int = POOL_TEXTS):
    """(features, labels) of the sampled pages by the teacher, and of their rewritten forms by construction.

    The teacher knows nothing about a page without semantic tags: such a page is not learnt
    from as it is, but its running text is main text in its rewritten forms, so there are
    examples of both classes however the pages are marked.
    """
    r = random.Random(seed)
    parsed = [s for s in (blocks(p) for p in pages) if s]
    pool = [b.text for s in parsed for b in s][:pool_texts] or ["text"]
    data = []
    for sequence in parsed:
        if _semantic(sequence):
            y = _teacher(sequence)
            data.append((block_features(sequence), y.astype(np.float32)))
            main = [b for b, keep in zip(sequence, y) if keep][:main_blocks]
        else:
            main = _prose(sequence)[:main_blocks]
        for _ in range(rewrites):
            again = blocks(rewritten(r, main, pool)) if main else []
            if again:
                data.append((block_features(again), np.array([b.label == "1" for b in again], dtype=np.float32)))
    return data


def fit(pages: DataFrame, sample: int = SAMPLE_PAGES) -> Labeller:
    """A labeller trained on at most ``sample`` pages, those with the smallest hashes of page_id and html.

    Of a sampled page at most ``MAIN_BLOCKS`` blocks and of the sample ``POOL_TEXTS`` texts go
    into rewritten pages. Training runs in a task of its own; its input is bounded by the sample, its output are
    the weights.
    """
    drawn = least_hashes(pages.filter(F.length("html") > 0).select("page_id", "html"), sample, "page_id", "html")

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller()
        data = training_data([x.as_py() for batch in batches for x in batch.column("html")])
        if data:
            labeller.train(data)
            names = sorted(labeller.p)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names), pa.array([labeller.p[k].astype("<f4").tobytes() for k in names], pa.binary())],
                names=["name", "weights"],
            )

    labeller = Labeller()
    for row in drawn.coalesce(1).mapInArrow(train, "name string, weights binary").collect():
        labeller.p[row["name"]] = np.frombuffer(row["weights"], dtype="<f4").reshape(labeller.p[row["name"]].shape)
    return labeller


SCHEMA = T.StructType([
    T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()),
    T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType()),
])


def extract_main_text(pages: DataFrame, sample: int = SAMPLE_PAGES) -> DataFrame:
    """Per row: page_id, url, text (the main text, empty if none), n_chars (its code points).

    A null or empty html gives an empty text; broken and cut markup is read as far as it
    goes; repeated rows come out each; an empty table gives no rows; other columns are ignored.
    """
    labeller = fit(pages, sample)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sequences = [blocks(x.as_py() or "") for x in part.column("html")]
                chosen = labeller.label([block_features(s) for s in sequences])
                texts = [" ".join([b.text for b, keep in zip(s, c) if keep]) for s, c in zip(sequences, chosen)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id").cast(pa.int64()), part.column("url"), pa.array(texts, pa.string()),
                     pa.array([len(t) for t in texts], pa.int64())], names=SCHEMA.names,
                )

    return pages.select("page_id", F.col("url").cast("string").alias("url"), "html").mapInArrow(extract, SCHEMA)

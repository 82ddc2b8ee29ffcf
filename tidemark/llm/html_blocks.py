"""Main text of web pages by a recurrent labeller over their blocks.

A page falls into blocks, the runs of text between tags that aren't inline.  Each block has a vector: its path of
tags with the words of their classes and ids, hashed; its own words, hashed; and a few shares.  A bidirectional
LSTM in numpy reads the vectors of a whole page and says of every block whether it belongs to the article.  The
labeller is trained on pages made up here, of many layouts, by gradient descent from a fixed seed.

Cases: a null or empty page, or one without article, has the empty text; tags that never close or were never
opened, stray brackets and quotes are taken as browsers roughly do; rows that repeat give equal rows; very long
pages are read whole; an empty table gives an empty table; only ``page_id``, ``url`` and ``html`` are read, so
other columns and their names don't matter.
"""

from __future__ import annotations

import html as references
import random
import re
import zlib
from bisect import bisect_left
from collections import Counter
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.textutil import Remembered, arrow_map

PATH, WORDS, SHARES = 64, 32, 6
#: Elements that don't end a block, that have no content, and whose content is no text of the page.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template svg iframe object select textarea title math canvas audio video".split())
#: Fixed value: a paragraph ends where one of these begins.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table ul".split())
OTHER = r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?"
#: A comment and the like, a tag, or the beginning of a tag that never ends.
TAG = re.compile(rf"""{OTHER}|<(/?)([A-Za-z][^\s/>]*+)((?>[^>"']++|"[^"]*"|'[^']*'|["'])*+)>|(</?[A-Za-z])""", re.S)
START = re.compile(rf"{OTHER}|<(/?)(?=[A-Za-z])", re.S)
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
PART = re.compile(r"[a-z]+")
SPACE = re.compile(r"\s+")


class Block(NamedTuple):
    text: str
    path: np.ndarray
    linked: int


def _token(token: str) -> tuple[int, float]:
    h = zlib.crc32(token.encode("utf-8", "replace"))
    return h % PATH, 1.0 if h >> 16 & 1 else -1.0


def _step(key: str) -> np.ndarray:
    """Vector of one element, given its tag and its class, id and role."""
    out = np.zeros(PATH, np.float32)
    tag, _, names = key.partition(" ")
    for token in [f"<{tag}", *dict.fromkeys(PART.findall(names.lower()))]:
        i, sign = _token(token)
        out[i] += sign
    return out


_steps = Remembered(_step, 20_000, 400)
_buckets = Remembered(lambda w: zlib.crc32(w.encode("utf-8", "replace")) % WORDS, 200_000)


class Ends:
    """The tags of a page from a place on, where a tag begins that never ends.

    A tag ends at the first bracket outside quotes.  Ends are looked up in a table made from behind, so that many
    beginnings without an end don't each look through the rest of the page.
    """

    def __init__(self, page: str, at: int) -> None:
        self.page = page
        self.marks = [m.start() for m in re.compile("[\"'>]").finditer(page, at)]
        self.names = [m.start() for m in re.compile(r"[\s/>]").finditer(page, at)]
        self.ends = [-1] * (len(self.marks) + 1)
        closing = {}
        for j in range(len(self.marks) - 1, -1, -1):
            c = page[self.marks[j]]
            if c == ">":
                self.ends[j] = self.marks[j]
            else:  # behind the quote that closes this one, or behind this one if none does
                self.ends[j] = self.ends[closing.get(c, j) + 1]
                closing[c] = j

    def after(self, at: int) -> tuple[int, int, str | None, str | None, str | None] | None:
        """Start and end of the next tag, comment or the like, and a tag's slash, name and attributes."""
        while m := START.search(self.page, at):
            if m[1] is None:
                return m.start(), m.end(), None, None, None
            i = bisect_left(self.names, m.end())
            if i < len(self.names):
                stop = self.names[i]
                end = self.ends[bisect_left(self.marks, stop)]
                if end >= 0:
                    return m.start(), end + 1, m[1], self.page[m.end() : stop], self.page[stop:end]
            at = m.end()
        return None


def blocks(page: str) -> list[Block]:
    """All blocks with text, in page order; white space is one space, references are decoded."""
    out: list[Block] = []
    root = np.zeros(PATH, np.float32)
    stack: list[tuple[str, np.ndarray]] = []
    standing: Counter[str] = Counter()
    parts: list[str] = []
    here, linked, link_depth, at = root, 0, 0, 0
    ends: Ends | None = None

    def flush() -> None:
        nonlocal linked
        text = "".join(parts)
        parts.clear()
        text = SPACE.sub(" ", references.unescape(text) if "&" in text else text).strip()
        if text:
            out.append(Block(text, here, linked))
        linked = 0

    def leave(n: int) -> None:
        for name, _ in stack[n:]:
            standing[name] -= 1
        del stack[n:]

    while True:
        if ends is None:
            m = TAG.search(page, at)
            if m is None:
                break
            if m[4]:
                ends = Ends(page, m.start())
                continue
            start, stop = m.span()
            closes, name, attributes = m.group(1, 2, 3)
        elif (t := ends.after(at)) is not None:
            start, stop, closes, name, attributes = t
        else:
            break
        if start > at:
            parts.append(page[at:start])
            if link_depth:
                linked += start - at
        at = stop
        if name is None:
            if page.startswith("<![CDATA[", start):
                parts.append(page[start + 9 : stop].removesuffix("]]>").replace("&", "&amp;"))
            continue
        tag = name.lower()
        if tag in SILENT and not closes:
            if not attributes.endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\b", re.I).search(page, at)
                at = (page.find(">", end.end()) + 1 or len(page)) if end else len(page)
            continue
        if tag == "a":
            link_depth = 0 if closes else 1
        if tag in INLINE:
            if tag == "br":
                parts.append(" ")
            continue
        flush()
        if closes:
            if standing[tag]:
                leave(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag))
            link_depth = 0
        else:
            if tag in ENDS_P and stack and stack[-1][0] == "p":
                leave(len(stack) - 1)
            if tag in ("li", "dt", "dd", "tr", "td", "th", "option") and stack and stack[-1][0] == tag:
                leave(len(stack) - 1)
            if tag not in VOID and not attributes.endswith("/"):
                names = " ".join(x or y or z for x, y, z in NAMES.findall(attributes)) if attributes else ""
                above = stack[-1][1] if stack else root
                stack.append((tag, np.float32(0.85) * above + _steps[f"{tag} {names}" if names else tag]))
                standing[tag] += 1
        here = stack[-1][1] if stack else root
    parts.append(page[at:])
    flush()
    return out


def vectors(page: list[Block]) -> np.ndarray:
    out = np.zeros((len(page), PATH + WORDS + SHARES), np.float32)
    for i, b in enumerate(page):
        words = b.text.lower().split()
        out[i, :PATH] = b.path
        out[i, PATH : PATH + WORDS] = np.bincount([_buckets[w] for w in words], minlength=WORDS)
        n = len(b.text)
        out[i, PATH + WORDS :] = (np.log1p(n) / 5, np.log1p(len(words)) / 3, min(1.0, b.linked / n), 4 * sum(map(b.text.count, ".,;:!?")) / n, (i + 1) / len(page), np.log1p(len(page)) / 4)
    own = out[:, PATH : PATH + WORDS]
    own[:] = own / np.maximum(1, own.sum(1, keepdims=True)) * 2
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Two LSTMs, one for each direction, and a logistic output on both their states."""

    def __init__(self, width: int, hidden: int = 20, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.hidden = hidden
        self.p: dict[str, np.ndarray] = {}
        for d in "fb":
            self.p["x" + d] = rng.normal(0, 1 / np.sqrt(width), (width, 4 * hidden))
            self.p["h" + d] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 4 * hidden))
            self.p["c" + d] = np.concatenate([np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)])
        self.p["o"] = rng.normal(0, 1 / np.sqrt(2 * hidden), 2 * hidden)
        self.p["s"] = rng.normal(0, 0.1, width)
        self.p["b"] = np.zeros(1)
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _run(self, x: np.ndarray, live: np.ndarray, d: str, keep: list | None) -> np.ndarray:
        """States of (time, pages, hidden); where a page has no block the state stays as it is."""
        n, m = x.shape[:2]
        k = self.hidden
        given = x @ self.p["x" + d] + self.p["c" + d]
        h, c = np.zeros((m, k), np.float32), np.zeros((m, k), np.float32)
        out = np.zeros((n, m, k), np.float32)
        for t in range(n) if d == "f" else range(n - 1, -1, -1):
            z = given[t] + h @ self.p["h" + d]
            gates = _sigmoid(z[:, : 3 * k])
            i, f, o, g = gates[:, :k], gates[:, k : 2 * k], gates[:, 2 * k :], np.tanh(z[:, 3 * k :])
            on = live[t][:, None]
            new = np.where(on, f * c + i * g, c)
            th = np.tanh(new)
            if keep is not None:
                keep.append((t, h, c, i, f, o, g, th, on))
            h, c = np.where(on, o * th, h), new
            out[t] = h
        return out

    def scores(self, x: np.ndarray, live: np.ndarray, kept: dict | None = None) -> np.ndarray:
        both = np.concatenate([self._run(x, live, d, None if kept is None else kept.setdefault(d, [])) for d in "fb"], axis=2)
        if kept is not None:
            kept["both"] = both
        return both @ self.p["o"] + x @ self.p["s"] + self.p["b"][0]

    def slopes(self, x: np.ndarray, live: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        kept: dict = {}
        error = np.where(live, _sigmoid(self.scores(x, live, kept)) - y, 0).astype(np.float32) / live.sum()
        k = self.hidden
        out = {"o": np.einsum("tm,tmk->k", error, kept["both"]), "s": np.einsum("tm,tmk->k", error, x), "b": error.sum(keepdims=True).reshape(1)}
        for d, own in (("f", slice(0, k)), ("b", slice(k, 2 * k))):
            dh, dc = np.zeros((x.shape[1], k), np.float32), np.zeros((x.shape[1], k), np.float32)
            dz_all = np.zeros((*x.shape[:2], 4 * k), np.float32)
            wide = np.zeros_like(self.p["h" + d])
            for t, h, c, i, f, o, g, th, on in reversed(kept[d]):
                dh = dh + error[t][:, None] * self.p["o"][own]
                do = np.where(on, dh * th, 0)
                dnew = np.where(on, dh * o * (1 - th * th) + dc, 0)
                dz = np.concatenate([dnew * g * i * (1 - i), dnew * c * f * (1 - f), do * o * (1 - o), dnew * i * (1 - g * g)], axis=1)
                wide += h.T @ dz
                dz_all[t] = dz
                dh = np.where(on, 0, dh) + dz @ self.p["h" + d].T
                dc = np.where(on, dnew * f, dc)
            out["x" + d] = np.tensordot(x, dz_all, axes=((0, 1), (0, 1)))
            out["h" + d] = wide
            out["c" + d] = dz_all.sum((0, 1))
        return out


def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    n = max(map(len, pages))
    x = np.zeros((n, len(pages), pages[0].shape[1]), np.float32)
    live = np.zeros((n, len(pages)), bool)
    for i, p in enumerate(pages):
        x[: len(p), i] = p
        live[: len(p), i] = True
    return x, live


# Pages to learn from.  Words are made of syllables, so that only layout and the few words of its own tell.

#: What elements around an article, and around all else, are called.
ARTICLE = ["<article>", '<article class="post">', '<main id="content">', '<div class="article-body">', '<div class="entry-content">', '<section class="story">', '<div id="main-content" class="text">', '<main><article class="entry">', '<div role="main"><div class="post-content">']
MENU = ["<nav>", '<nav class="menu">', '<div class="navbar">', '<ul class="breadcrumbs">', '<div id="menu">', '<div class="pagination">', '<header><nav class="top">', '<div class="topbar navigation">', '<nav role="navigation">']
HEAD = ["<header>", '<div class="header">', '<div id="masthead">', '<div class="site-header banner">', '<header class="site">']
FOOT = ["<footer>", '<div class="footer">', '<div id="footer" class="copyright">', '<footer class="site-footer">', '<div class="legal bottom">']
SIDE = ["<aside>", '<div class="sidebar">', '<div id="related" class="widget">', '<aside class="popular">', '<section class="related-posts">', '<div class="recommended more">']
ADVERT = ['<div class="ad">', '<div class="advert">', '<div id="sponsor" class="promo">', '<aside class="ads banner">', '<div class="sponsored">', '<section class="advertisement">']
NOTICE = ['<div class="cookie-notice">', '<div id="consent" class="popup">', '<div class="notice">', '<div role="alert" class="banner">', '<div class="newsletter subscribe">', '<div class="modal gdpr">', '<div class="share social">']
FORM = ["<form>", '<form class="search">', '<form id="login" class="signup">', '<div class="contact"><form>']
COMMENT = ['<section class="comments">', '<div id="comments">', '<ol class="comment-list">', '<div class="reader-comments discussion">', '<div class="replies" id="disqus">', '<section id="responses">']
#: Words that stand in such places.
PHRASES = {"menu": "home about news contact sport world help search".split(), "foot": "copyright rights reserved privacy terms imprint contact".split(), "notice": "cookies accept privacy consent subscribe newsletter share follow".split(), "form": "name email password send submit search login".split(), "comment": "reply likes report posted says ago".split(), "ad": "buy now sale offer sponsored free shop".split()}


def made_page(rng: random.Random) -> tuple[str, list[str]]:
    """A made-up page and the blocks of its article, in order."""
    syllables = [rng.choice("bdfglmnprstvwz") + rng.choice("aeiouéä") + rng.choice(["", "n", "r", "s", "nt"]) for _ in range(40)]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))

    def sentence(n: int) -> str:
        out = [word() for _ in range(max(1, n))]
        return " ".join([out[0].capitalize(), *out[1:]]) + rng.choice([".", ".", ".", "?", "!"])

    def paragraph() -> str:
        return " ".join(sentence(rng.randint(1, 22)) for _ in range(rng.choice([1, 1, 2, 3, 5, 8])))

    def close(opened: str) -> str:
        return "".join(f"</{t}>" for t in reversed(re.findall(r"<(\w+)", opened)))

    def links(kind: str, n: int) -> str:
        item = lambda: rng.choice(PHRASES[kind]) if rng.random() < 0.3 else " ".join(word() for _ in range(rng.randint(1, 5)))
        form = rng.choice(["<li><a href='/x'>{}</a></li>", "<a href='/x'>{}</a> ", "<li>{}</li>", "<div><a href='#'>{}</a></div>"])
        out = "".join(form.format(item()) for _ in range(n))
        return f"<ul>{out}</ul>" if "<li" in form else out

    def around(kind: str) -> str:
        said = lambda: " ".join([rng.choice(PHRASES[kind]) for _ in range(rng.randint(0, 3))] + [sentence(rng.randint(2, 18))])
        return "".join(rng.choice(["<p>{}</p>", "<div>{}</div>", "{}", "<span>{}</span>"]).format(said()) for _ in range(rng.choice([1, 1, 2, 3])))

    def boxed(kinds: list[str], inner: str) -> str:
        opened = rng.choice(kinds)
        return opened + inner + close(opened)

    def comments() -> str:
        form = rng.choice(['<div class="comment"><b>{}</b><p>{}</p></div>', "<li><p>{}</p><p>{}</p></li>", '<article class="comment"><h4>{}</h4><p>{}</p></article>'])
        return boxed(COMMENT, rng.choice(["<h3>Comments</h3>", "<h2>{}</h2>".format(sentence(2)), ""]) + "".join(form.format(word(), paragraph()) for _ in range(rng.randint(1, 6))))

    body: list[str] = []
    want: list[str] = []

    def say(form: str, text: str) -> None:
        body.append(form.format(text))
        want.append(text)

    title = sentence(rng.randint(1, 12))
    if rng.random() < 0.8:
        say(rng.choice(["<h1>{}</h1>", "<h1 class='title'>{}</h1>", "<h2>{}</h2>"]), title)
    if rng.random() < 0.4:
        say("<p><b>{}<br>", title + " " + sentence(rng.randint(3, 30)))
    for _ in range(rng.choice([1, 2, 4, 7, 12, 20])):
        r = rng.random()
        if r < 0.08:
            say(rng.choice(["<h2>{}</h2>", "<h3>{}</h3>"]), sentence(rng.randint(1, 8)))
        elif r < 0.16:
            say(rng.choice(["<p><b>{}<br>", "<p><i>{}</i></p>", "<p>{}"]), paragraph())
        elif r < 0.22:
            body.append("<ul>")
            for _ in range(rng.randint(2, 5)):
                say("<li>{}</li>", sentence(rng.randint(2, 15)))
            body.append("</ul>")
        elif r < 0.26:
            say("<blockquote>{}</blockquote>", paragraph())
        elif r < 0.30:
            body.append(boxed(ADVERT, around("ad")))
        elif r < 0.33:
            body.append(boxed(SIDE, links("menu", rng.randint(2, 5))))
        elif r < 0.36:
            body.append("<figure><img src='x.png'>")
            say("<figcaption>{}</figcaption>", sentence(rng.randint(3, 12)))
            body.append("</figure>")
        elif r < 0.5:
            text = paragraph().split(" ")
            at = rng.randrange(len(text))
            body.append("<p>" + " ".join([*text[:at], f"<a href='/y'>{text[at]}</a>", *text[at + 1 :]]) + "</p>")
            want.append(" ".join(text))
        else:
            say("<p>{}</p>", paragraph())
    if rng.random() < 0.15:
        body.append(comments())
    article = rng.choice(ARTICLE)
    if rng.random() < 0.04:
        body, want = [], []
    parts = [
        boxed(HEAD, rng.choice([f"<h1><a href='/'>{word()}</a></h1>", around("menu"), f"<div class='logo'>{word()}</div><p>{sentence(5)}</p>"])) if rng.random() < 0.45 else "",
        boxed(MENU, links("menu", rng.randint(3, 9))) if rng.random() < 0.85 else "",
        boxed(NOTICE, around("notice")) if rng.random() < 0.35 else "",
        boxed(ADVERT, around("ad")) if rng.random() < 0.6 else "",
        boxed(SIDE, rng.choice([links("menu", 4), around("ad") + links("menu", 3), f"<h3>{sentence(2)}</h3><p>{paragraph()}</p>"])) if rng.random() < 0.3 else "",
        article + "".join(body) + close(article) if body else "",
        comments() if rng.random() < 0.35 else "",
        boxed(SIDE, rng.choice([links("menu", 5), f"<h3>{sentence(2)}</h3><p>{paragraph()}</p>"])) if rng.random() < 0.35 else "",
        boxed(ADVERT, around("ad")) if rng.random() < 0.3 else "",
        boxed(FORM, f"<label>{rng.choice(PHRASES['form'])}</label><input><p>{sentence(5)}</p><button>{rng.choice(PHRASES['form'])}</button>") if rng.random() < 0.3 else "",
        boxed(FOOT, rng.choice([f"&copy; {word()}.example.net &middot; {sentence(8)}", around("foot"), links("foot", 4) + f"<p>{sentence(6)}</p>"])) if rng.random() < 0.85 else "",
    ]
    return "<!DOCTYPE html><html><head><title>x</title></head><body>" + "".join(parts) + rng.choice(["</body></html>", ""]), want


def labelled(page: str, want: list[str]) -> tuple[np.ndarray, np.ndarray]:
    found = blocks(page)
    y = np.zeros(len(found), np.float32)
    at = 0
    for text in want:
        while at < len(found) and found[at].text != text:
            at += 1
        if at < len(found):
            y[at] = 1
            at += 1
    return vectors(found), y


@lru_cache(maxsize=1)
def trained(pages: int = 1200, rounds: int = 14, seed: int = 11, rate: float = 0.01) -> Labeller:
    """The labeller after Adam steps over made-up pages; the same in every process."""
    rng = random.Random(seed)
    data = [x for x in (labelled(*made_page(rng)) for _ in range(pages)) if len(x[0])]
    model = Labeller(PATH + WORDS + SHARES)
    first, second = ({k: np.zeros_like(v) for k, v in model.p.items()} for _ in range(2))
    step = 0
    for turn in range(rounds):
        order = sorted(range(len(data)), key=lambda i: (len(data[i][0]) // 8, rng.random()))
        lots = [order[i : i + 32] for i in range(0, len(order), 32)]
        rng.shuffle(lots)
        for lot in lots:
            x, live = _padded([data[i][0] for i in lot])
            y = np.zeros(live.shape, np.float32)
            for j, i in enumerate(lot):
                y[: len(data[i][1]), j] = data[i][1]
            step += 1
            now = rate * (1 - turn / rounds) + 1e-4
            for k, g in model.slopes(x, live, y).items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                model.p[k] = (model.p[k] - now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return model


def label(model: Labeller, pages: list[list[Block]]) -> list[np.ndarray]:
    """For each page, which of its blocks belong to the article."""
    out = [np.zeros(len(p), bool) for p in pages]
    order = sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i]))
    lot: list[int] = []
    for i in [*order, -1]:
        if lot and (i < 0 or len(lot) == 128 or len(pages[i]) > 1.3 * len(pages[lot[0]]) + 4):
            x, live = _padded([vectors(pages[j]) for j in lot])
            scores = model.scores(x, live)
            for k, j in enumerate(lot):
                out[j] = scores[: len(pages[j]), k] > 0
            lot = []
        lot.append(i)
    return out


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text of the article (empty if there is none) and n_chars, its code points."""
    model = trained()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [blocks(h or "") for h in batch.column(2).to_pylist()]
        texts = ["\n".join(b.text for b, yes in zip(p, mine, strict=True) if yes) for p, mine in zip(found, label(model, found), strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return arrow_map(pages.select("page_id", "url", "html"), run, "page_id long, url string, text string, n_chars long", rows=256)

"""Main text of web pages by a recurrent block labeller.

A page becomes the sequence of its leaf text blocks. Each block is a vector: hashed tokens of its tag path (tags, class
and id words), hashed words, and shape (length, links, punctuation). A bidirectional LSTM in numpy reads the sequence in
both directions, so each block is judged with the whole page as context, and labels it main text or not.

The labeller is trained here on pages made by rule (``make_page``): invented words in the layouts that pages have, with
each block's label known. Training takes a few seconds and gives the same weights each time; nothing is read from the
tables. The weights, some hundred kilobytes whatever the data, go to the tasks.
"""

from __future__ import annotations

import html
import math
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

PATH, WORDS, SHAPE, HIDDEN = 192, 24, 12, 20
WIDE = PATH + WORDS + SHAPE
#: A tag up to its end. Quotes count after an equals sign only; nothing is tried twice, so unclosed tags cost one pass.
_TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9:-]*)(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+>")
_ATTR = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: Elements whose content is characters, not markup, up to their own closing tag; none of it is text of the page's body.
_RAW = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I) for name in ("script", "style", "textarea", "title", "iframe")}
#: Elements with markup inside that isn't shown as text.
_HIDDEN = frozenset(("template", "select", "annotation", "annotation-xml", "desc", "metadata"))
_DIGITS, _APART, _CAMEL = re.compile(r"\d"), re.compile(r"[^a-z]+"), re.compile(r"([a-z])([A-Z])")
_VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"))
_INLINE = frozenset(("a", "abbr", "b", "bdi", "bdo", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"))
#: Tags that end an open paragraph.
_ENDS_P = frozenset(("address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"))


#: Blocks of a page whose vectors are held at once.
SLICE = 4096


@lru_cache(1 << 16)
def _slots(token: str) -> tuple[tuple[int, float], ...]:
    """A path token stands in three places of the path's vector, so that no two tokens look alike."""
    return () if token in ("html", "body") else tuple(_slot(f"{k}{token}", PATH) for k in range(3))


class _Path:
    """The open elements and the vector of their distinct tokens, kept up to date as elements open and close.

    Every question about the path takes the same time at any depth.
    """

    def __init__(self):
        self.names: list[str] = []
        self.tokens: list[tuple[str, ...]] = []
        self.places: dict[str, list[int]] = defaultdict(list)
        self.held: Counter = Counter()
        self.size, self.vector = 0, np.zeros(PATH, np.float32)
        self.known: dict[bytes, np.ndarray] = {}  # blocks of one path share its vector

    def open(self, name: str, tokens: tuple[str, ...]):
        self.places[name].append(len(self.names))
        self.names.append(name)
        self.tokens.append(tokens)
        self._count(tokens, 1)

    def close_from(self, place: int):
        """Close the element that stands at ``place``, and all inside it."""
        while len(self.names) > place:
            self.places[self.names.pop()].pop()
            self._count(self.tokens.pop(), -1)

    def _count(self, tokens: tuple[str, ...], by: int):
        self.size += by * len(tokens)
        for t in tokens:
            self.held[t] += by
            if self.held[t] == (1 if by > 0 else 0):
                for at, sign in _slots(t):
                    self.vector[at] += by * sign

    def last(self, *names: str) -> int:
        """Place of the innermost open element of these names; -1 without one."""
        return max((self.places[n][-1] for n in names if self.places[n]), default=-1)

    def look(self) -> tuple[np.ndarray, int, str, bool]:
        held = self.known.setdefault(self.vector.tobytes(), None)
        if held is None:
            held = self.known[self.vector.tobytes()] = self.vector.copy()
        return held, self.size, self.names[-1] if self.names else "", self.last("p") >= 0


def _tokens(source: str) -> Iterator[tuple[str | None, re.Match | None]]:
    """(text, None) and (None, tag) in page order; comments and declarations go, raw elements with their content too."""
    at, size = 0, len(source)
    while at < size:
        lt = source.find("<", at)
        while lt >= 0 and not (source[lt + 1 : lt + 2].isalpha() and source[lt + 1].isascii() or source[lt + 1 : lt + 2] in ("/", "!", "?") and lt + 2 < size):
            lt = source.find("<", lt + 1)  # a sign in the text
        if lt != at:
            yield source[at : lt if lt >= 0 else size], None
        if lt < 0:
            return
        if source.startswith("<!--", lt):
            end = lt + 4 if source.startswith((">", "->"), lt + 4) else source.find("-->", lt + 4)
            at = size if end < 0 else source.find(">", end) + 1
            continue
        tag = _TAG.match(source, lt)
        if tag is None:
            named = source[lt + 1 : lt + 2].isalpha() or source[lt + 1 : lt + 2] == "/" and source[lt + 2].isascii() and source[lt + 2].isalpha()
            end = -1 if named else source.find(">", lt)
            at = size if end < 0 else end + 1  # a tag that never ends, or a declaration
            continue
        at = tag.end()
        raw = None if tag[1] or tag[0].endswith("/>") else _RAW.get(tag[2].lower())
        if raw is not None:
            end = raw.search(source, at)
            at = end.end() if end else size
        yield None, tag


def blocks(source: str | None) -> list[tuple[tuple, str, int, int]]:
    """(path: vector, tokens, innermost element, inside p; text; characters in links; number) of leaf blocks in page order."""
    out: list = []
    path, parts = _Path(), []
    links, seen = 0, None

    def flush():
        nonlocal links, seen
        text = " ".join("".join(parts).split())
        if text:
            out.append((seen, text, links, len(out)))
        parts.clear()
        links, seen = 0, None

    skip, depth = None, 0
    for text, tag in _tokens(source or ""):
        if tag is None:
            if skip is None:
                text = html.unescape(text)
                if seen is None and not text.isspace():
                    seen = path.look()
                parts.append(text)
                if path.places["a"]:
                    links += len(text.strip())
            continue
        closing, name, empty = bool(tag[1]), tag[2].lower(), tag[0].endswith("/>")
        if name in _RAW:
            continue
        if skip is not None:
            if name == skip and not empty:
                depth += -1 if closing else 1
                skip = skip if depth else None
            continue
        if not closing and name in _HIDDEN:
            if not empty:
                skip, depth = name, 1
            continue
        # formulas and drawings stand in the line; labels of a drawing are blocks
        drawn = name in ("math", "svg") or path.places["math"] or path.places["svg"]
        inside = drawn and name not in _ENDS_P and name not in ("text", "br", "li", "dt", "dd", "tr", "td", "th")
        if not inside and name not in _INLINE:
            flush()
        if closing:
            if path.places[name]:
                path.close_from(path.places[name][-1])
            continue
        if inside:
            if not empty:
                path.open(name, (name,))
            continue
        if name in _ENDS_P and path.last("p") > path.last("table", "button", "object"):
            path.close_from(path.last("p"))
        if name in ("li", "dt", "dd", "tr", "td", "th", "option"):
            same = ("dt", "dd") if name in ("dt", "dd") else ("td", "th") if name in ("td", "th") else (name,)
            if path.names and path.names[-1] in same:
                path.close_from(len(path.names) - 1)
        if name not in _VOID:
            tokens = [name]
            for a in _ATTR.finditer(tag[0]):
                value = a.group(2) or a.group(3) or a.group(4) or ""
                tokens += [w for w in _APART.split(_CAMEL.sub(r"\1-\2", value).lower()) if w]
            path.open(name, tuple(tokens))
    flush()
    return out


def _slot(name: str, width: int) -> tuple[int, float]:
    h = zlib.crc32(name.encode("utf-8", "replace"))
    return h % width, 1.0 if h >> 16 & 1 else -1.0


@lru_cache(1 << 16)
def _word_slot(word: str) -> tuple[int, float]:
    return _slot(word, WORDS)


def vectors(page: list, first: int = 0, until: int | None = None) -> np.ndarray:
    """Vectors of a page's blocks, or of some of them."""
    n = len(page)
    some = page[first:until]
    x = np.zeros((len(some), WIDE), np.float32)
    for i, ((path, tokens, last, inside), text, links, _) in enumerate(some, first):
        row = x[i - first]
        row[:PATH] = path
        words, bag = text.lower().split(), [0.0] * WORDS
        for w, k in Counter(words).items():
            at, sign = _word_slot(w) if len(w) < 40 else _slot(w, WORDS)
            bag[at] += sign * k
        scale = 2 + math.sqrt(sum(x * x for x in bag))
        row[PATH : PATH + WORDS] = [x / scale for x in bag]
        size = len(text)
        row[PATH + WORDS :] = (
            math.log1p(size) / 5, min(links / size, 1.0), text.count(".") / max(len(words), 1), text.count(",") / max(len(words), 1),
            i / n, (n - i) / n, float(text[-1] in ".!?:;"), float(last in ("h1", "h2", "h3", "h4")), len(_DIGITS.findall(text)) / size,
            float(inside), float(size > 200), min(tokens, 100) / 10,
        )
    return x


# ---------------------------------------------------------------- pages made by rule, to train on

#: Words of class names and ids, by what the element holds.
_CLASSES = {
    "nav": "nav navigation menu navbar topnav breadcrumb breadcrumbs links pagination pager toc tabs skip",
    "header": "header masthead banner top brand logo sitehead branding",
    "footer": "footer foot bottom copyright legal colophon credits",
    "side": "sidebar side aside related widget widgets recommended more popular trending rail tags",
    "notice": "notice cookie cookies consent gdpr alert warning popup modal overlay newsletter subscribe paywall",
    "ad": "ad ads advert advertisement sponsor sponsored promo promotion promoted adsense",
    "form": "form search login signup contact register subscribe",
    "comments": "comment comments comment-list replies reply discussion disqus responses thread",
    "share": "share social sharing toolbar buttons follow",
    "main": "content article post entry story main text body page maincontent article-body post-content entry-content prose copy",
}
_PHRASES = ("home", "about us", "contact", "privacy policy", "terms of use", "sign in", "log in", "subscribe now", "read more", "all rights reserved", "share this", "we use cookies", "accept all", "follow us", "advertisement", "sponsored", "search", "next page", "menu", "reply", "related articles", "join our newsletter")


def make_page(rng: np.random.Generator) -> str:
    """A page whose main text is marked: its blocks start with the character U+0001, others with U+0002."""
    pick = lambda xs: xs[int(rng.random() * len(xs))]
    syllables = ["".join(pick(list("bcdfghlmnprstvz")) + pick(list("aeiouäéó")) for _ in range(1)) for _ in range(30)]
    word = lambda: "".join(pick(syllables) for _ in range(int(rng.integers(1, 4))))

    def words(a, b):
        out = [word() for _ in range(int(rng.integers(a, b)))]
        noisy = rng.random() < 0.08
        return " ".join(w + pick(["###", "%%%", "&amp;&amp;", "***"]) if noisy else w for w in out)

    def sentences(a, b):
        return " ".join(words(1, 14).capitalize() + pick([".", ".", ".", "!", "?", ""]) for _ in range(int(rng.integers(a, b))))

    def short():
        return str(pick(_PHRASES)) if rng.random() < 0.4 else words(1, 6)

    def named(kind, tags):
        tag = str(pick(tags.split()))
        name = str(pick(_CLASSES[kind].split()))
        semantic = tag in ("nav", "footer", "aside", "header", "article", "main", "form")
        if rng.random() < (0.4 if semantic else 1.0):
            extra = f"{pick(['site', 'page', 'block', 'box', 'wrap', 'c', 'x1', 'inner'])}-" if rng.random() < 0.4 else ""
            return tag, f"<{tag} {pick(['class', 'class', 'id'])}=\"{extra}{name}\">"
        return tag, f"<{tag}>"

    no, yes = "\x02", "\x01"

    def links(n):
        items = [f"<li><a href=\"/{word()}\">{no}{short()}</a></li>" for _ in range(n)]
        return "<ul>" + "".join(items) + "</ul>" if rng.random() < 0.7 else "".join(f"<a href=\"#\">{no}{short()}</a><br>" for _ in range(n))

    def junk(kind):
        tags = {"nav": "nav nav div ul", "header": "header header div", "footer": "footer footer div", "side": "aside aside div section", "form": "form form div"}.get(kind, "div div section aside")
        tag, open_ = named(kind, tags)
        if kind in ("nav", "share"):
            inner = links(int(rng.integers(2, 9)))
        elif kind == "side":
            inner = f"<h3>{no}{short()}</h3>" + (links(int(rng.integers(2, 6))) if rng.random() < 0.6 else f"<p>{no}{sentences(1, 4)}</p>")
        elif kind == "comments":
            inner = f"<h3>{no}{short()}</h3>" * int(rng.integers(0, 2)) + "".join(f"<div class=\"comment\"><b>{no}{word()}</b><p>{no}{sentences(1, 5)}</p></div>" if rng.random() < 0.6 else f"<p>{no}{sentences(1, 6)}</p>" for _ in range(int(rng.integers(1, 6))))
        elif kind == "form":
            inner = f"<label>{no}{short()}</label><input name=q><button>{no}{short()}</button>" + (f"<p>{no}{sentences(1, 2)}</p>" if rng.random() < 0.3 else "")
        elif kind == "header":
            inner = (f"<a href=\"/\">{no}{short()}</a>" if rng.random() < 0.5 else "<h{0}>{1}{2}</h{0}>".format(rng.integers(1, 3), no, short())) + (f"<p>{no}{sentences(1, 3) if rng.random() < 0.5 else words(2, 9)}</p>" if rng.random() < 0.5 else "") + (junk("nav") if rng.random() < 0.3 else "")
        else:
            text = sentences(1, 4) if rng.random() < 0.7 else short()
            inner = f"{no}{'&copy; ' if kind == 'footer' and rng.random() < 0.5 else ''}{text}" if rng.random() < 0.5 else f"<p>{no}{text}</p>"
            inner += f"<a href=\"#\">{no}{short()}</a>" if rng.random() < 0.2 and "<p>" in inner else ""
        return f"{open_}{inner}</{tag}>"

    def body():
        out = [f"<h1>{yes}{words(2, 12)}</h1>"] if rng.random() < 0.8 else []
        for _ in range(int(rng.integers(1, 14))):
            kind = rng.random()
            if kind < 0.66:
                text = sentences(1, 7) if rng.random() < 0.8 else words(1, 5)
                text = f"<b>{yes}{text}<br>" if rng.random() < 0.07 else f"{yes}{text}"
                out.append(f"<p>{text}" + ("</p>" if rng.random() < 0.9 else ""))
            elif kind < 0.73:
                out.append(f"<h2>{yes}{words(1, 7)}</h2>")
            elif kind < 0.78:
                out.append("<ul>" + "".join(f"<li>{yes}{sentences(1, 2) if rng.random() < 0.5 else words(1, 5)}</li>" for _ in range(int(rng.integers(2, 5)))) + "</ul>")
            elif kind < 0.82:
                out.append(f"<blockquote>{yes}{sentences(1, 3)}</blockquote>")
            elif kind < 0.85:
                out.append("<table>" + "".join(f"<tr><td>{yes}{words(1, 3)}</td><td>{yes}{words(1, 3)}</td></tr>" for _ in range(2)) + "</table>")
            elif kind < 0.87:
                out.append(f"<pre>{yes}{words(2, 12)}</pre>")
            else:
                out.append(junk(str(pick(["ad", "ad", "side", "share", "notice", "comments", "form", "nav"]))))
        # junk that pages nest in the article's end
        out += [junk(k) for k in ("share", "comments", "footer") if rng.random() < 0.15]
        return "".join(out)

    before = [junk(k) for k in ("header", "nav", "notice", "ad", "form", "share") if rng.random() < 0.45]
    after = [junk(k) for k in ("comments", "side", "ad", "share", "form", "footer", "notice") if rng.random() < 0.45]
    if rng.random() < 0.3:
        after, before = [x for x in after if rng.random() < 0.7], before + [junk("side")]
    tag, open_ = named("main", "article article article main div div section")
    if rng.random() < 0.3:
        before, after = [*before, "<main>" if tag != "main" else "<div>"], ["</main>" if tag != "main" else "</div>", *after]
    return f"<html><head><title>{words(2, 6)}</title></head><body>{''.join(before)}{open_}{body()}</{tag}>{''.join(after)}</body></html>"


def training_set(pages: int, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    rng, out = np.random.default_rng(seed), []
    for _ in range(pages):
        page = blocks(make_page(rng))
        label = np.array([1.0 if "\x01" in b[1] else 0.0 for b in page], np.float32)
        page = [(p, t.replace("\x01", "").replace("\x02", "") or ".", n, i) for p, t, n, i in page]
        if page:
            out.append((vectors(page), label))
    return out


# ---------------------------------------------------------------- the network


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """A bidirectional LSTM with a logistic output for each block."""

    def __init__(self, params: list[np.ndarray]):
        self.params = params

    @classmethod
    def fresh(cls, seed: int) -> Labeller:
        rng = np.random.default_rng(seed)
        params = []
        for _ in range(2):
            bias = np.zeros(4 * HIDDEN)
            bias[HIDDEN : 2 * HIDDEN] = 1
            params += [rng.normal(0, 1 / np.sqrt(WIDE), (WIDE, 4 * HIDDEN)), rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, 4 * HIDDEN)), bias]
        return cls([*params, rng.normal(0, 0.2, 2 * HIDDEN), rng.normal(0, 0.02, WIDE), np.zeros(1)])

    def _run(self, x, mask, w, u, b, keep):
        n, length, _ = x.shape
        h, c = np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN))
        xw = x @ w + b
        hs, tape = np.zeros((n, length, HIDDEN)), []
        for t in range(length):
            z = xw[:, t] + h @ u
            s = _sigmoid(z[:, : 3 * HIDDEN])
            i, f, o = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            m = mask[:, t, None]
            new_c = m * (f * c + i * g) + (1 - m) * c
            tc = np.tanh(new_c)
            if keep:
                tape.append((h, c, i, f, o, g, tc, m))
            h, c = m * (o * tc) + (1 - m) * h, new_c
            hs[:, t] = h
        return hs, tape

    def forward(self, x, mask, keep=False):
        p = self.params
        a, ta = self._run(x, mask, *p[0:3], keep)
        r, tr = self._run(x[:, ::-1], mask[:, ::-1], *p[3:6], keep)
        both = np.concatenate([a, r[:, ::-1]], 2)
        return _sigmoid(both @ p[6] + x @ p[7] + p[8]), both, (ta, tr)

    def _back(self, x, dh_out, tape, w, u):
        n, length, _ = x.shape
        dz_all, du = np.zeros((n, length, 4 * HIDDEN)), np.zeros_like(u)
        dh, dc = np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN))
        for t in range(length - 1, -1, -1):
            h0, c0, i, f, o, g, tc, m = tape[t]
            dh = dh + dh_out[:, t]
            live = dh * m
            do = live * tc
            dcc = (dc + live * o * (1 - tc * tc)) * m
            dz = np.concatenate([dcc * g * i * (1 - i), dcc * c0 * f * (1 - f), do * o * (1 - o), dcc * i * (1 - g * g)], 1)
            dz_all[:, t] = dz
            du += h0.T @ dz
            dh = dz @ u.T + dh * (1 - m)
            dc = dcc * f + dc * (1 - m)
        flat = dz_all.reshape(-1, 4 * HIDDEN)
        return x.reshape(-1, x.shape[2]).T @ flat, du, flat.sum(0)

    def gradients(self, x, mask, y):
        prob, both, (ta, tr) = self.forward(x, mask, True)
        err = (prob - y) * mask / mask.sum()
        dboth = err[:, :, None] * self.params[6]
        g1 = self._back(x, dboth[:, :, :HIDDEN], ta, *self.params[0:2])
        g2 = self._back(x[:, ::-1], dboth[:, ::-1, HIDDEN:], tr, *self.params[3:5])
        tail = [np.einsum("nt,nth->h", err, both), np.einsum("nt,ntw->w", err, x), np.array([err.sum()])]
        return [*g1, *g2, *tail]

    def probabilities(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Of each block of each page that it is main text; pages of like length run together."""
        out: list = [np.zeros(0)] * len(pages)
        order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
        at = 0
        while at < len(order):
            to = at + 1
            while to < len(order) and to - at < 256 and len(pages[order[to]]) * (to + 1 - at) <= 20_000 and len(pages[order[to]]) <= 1.3 * len(pages[order[at]]) + 4:
                to += 1
            part = [pages[i] for i in order[at:to]]
            x, mask = _padded(part)
            prob = self.forward(x, mask)[0]
            for i, p, row in zip(order[at:to], part, prob, strict=True):
                out[i] = row[: len(p)]
            at = to
        return out


    def of_long(self, page: list) -> np.ndarray:
        """The same of one page of very many blocks: the states go on from slice to slice, one way and then the other, and
        of a slice only its blocks' shares of the outcome are kept."""
        p, n = self.params, len(page)
        out = np.full(n, p[8][0])
        cuts = [(a, min(a + SLICE, n)) for a in range(0, n, SLICE)]
        for way, (w, u, b), share in ((1, p[0:3], p[6][:HIDDEN]), (-1, p[3:6], p[6][HIDDEN:])):
            h, c = np.zeros(HIDDEN), np.zeros(HIDDEN)
            for first, until in cuts[::way]:
                x = vectors(page, first, until).astype(np.float64)
                if way > 0:
                    out[first:until] += x @ p[7]
                xw = (x @ w + b)[::way]
                told = np.empty(len(x))
                for t in range(len(x)):
                    z = xw[t] + h @ u
                    s = _sigmoid(z[: 3 * HIDDEN])
                    c = s[HIDDEN : 2 * HIDDEN] * c + s[:HIDDEN] * np.tanh(z[3 * HIDDEN :])
                    h = s[2 * HIDDEN :] * np.tanh(c)
                    told[t] = h @ share
                out[first:until] += told[::way]
        return _sigmoid(out)


def _padded(pages):
    length = max(len(p) for p in pages)
    x, mask = np.zeros((len(pages), length, WIDE)), np.zeros((len(pages), length))
    for i, p in enumerate(pages):
        x[i, : len(p)], mask[i, : len(p)] = p, 1
    return x, mask


def train(pages: int = 1200, epochs: int = 14, batch: int = 28, rate: float = 0.01, seed: int = 23) -> Labeller:
    data = training_set(pages, seed)
    rng, net = np.random.default_rng(seed), Labeller.fresh(seed)
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in net.params]
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(data))
        order = order[np.argsort([len(data[i][0]) // 12 for i in order], kind="stable")]
        starts = rng.permutation(np.arange(0, len(order), batch))
        for at in starts:
            part = [data[i] for i in order[at : at + batch]]
            x, mask = _padded([p for p, _ in part])
            x *= rng.random(x.shape[2]) > 0.05  # so that no single slot decides
            y = np.zeros(mask.shape)
            for i, (_, label) in enumerate(part):
                y[i, : len(label)] = label
            step += 1
            now = rate * (1 - 0.9 * epoch / epochs)
            for p, g, (m, v) in zip(net.params, net.gradients(x, mask, y), moments, strict=True):
                g = np.clip(g, -1, 1)
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return net


_trained: dict[int, Labeller] = {}


def labeller(seed: int = 23) -> Labeller:
    """The trained labeller; trained once a process."""
    if seed not in _trained:
        _trained[seed] = train(seed=seed)
    return _trained[seed]


def extract_text(sources, net: Labeller) -> list[str]:
    out, sources = [], list(sources)
    for part in common.slices(sources):
        pages = [blocks(s) for s in sources[part]]
        long = {i for i, p in enumerate(pages) if len(p) > SLICE}
        probs = net.probabilities([vectors([] if i in long else p) for i, p in enumerate(pages)])
        probs = [net.of_long(p) if i in long else prob for i, (p, prob) in enumerate(zip(pages, probs, strict=True))]
        out += [" ".join(b[1] for b, y in zip(p, prob, strict=True) if y >= 0.5) for p, prob in zip(pages, probs, strict=True)]
    return out


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page: its main text, blocks joined by one space.

    Defined cases: null and empty html, and pages without a main block, give an empty text; broken markup is read as far
    as it goes (an unclosed comment or script swallows the rest, as in browsers); scripts, styles, templates, form
    controls, iframes, titles, and annotations of formulas and drawings are no text; formulas, drawings and fallback
    content (noscript, object, canvas) are labelled like all other text; repeated rows are extracted each; an
    empty table gives an empty result; other columns are ignored.
    """
    net = labeller()

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(extract_text(texts, net), dtype=object)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    out = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.pandas_udf(run, "string")(F.col(html_col)).alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))


def op10_html_extraction(spark, sf_dir):
    return extract(common.table(spark, sf_dir, "pages"))

"""Main text of web pages by a recurrent block labeller.

A page becomes the sequence of its leaf blocks: text between block tags, with
the path of open tags. A bidirectional LSTM in numpy reads for each leaf a
hashed vector of its tag path (names, classes, ids), a hashed vector of its
words and a few shape figures, and labels every leaf with the whole page in
view. It is trained here on made-up pages of many layouts; the weights' size is
fixed. Texts of the leaves labelled main are joined in page order.

Defined results: null and empty html give empty text; unclosed comments and raw
elements run to the page's end; a tag that is never closed is text, and quotes
that are never closed are no quotes; repeated rows give one row each; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html
import random
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import ship

SCHEMA = "page_id long, url string, text string, n_chars long"
PATH_DIM, WORD_DIM, SHAPE_DIM, HIDDEN = 96, 24, 6, 24
_START = re.compile(r"<(?:!--|[!?]|/?[a-zA-Z])")
#: A tag; quotes count only right after an equals sign. No part is tried twice.
_TAG = re.compile(r"""<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]*+))*+)>""")
#: The same for the rest of a page in which a tag's quotes never end.
_SIMPLE_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^>]*+)>")
_NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "object", "math"}
VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}
INLINE = set("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
ALONE = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


class Leaf:
    __slots__ = ("linked", "path", "text")

    def __init__(self, path, text, linked):
        self.path, self.text, self.linked = path, text, linked


def _path_names(tag: str, attrs: str) -> tuple[str, ...]:
    out = [tag]
    for m in _NAMES.finditer(attrs):
        out += [f"{m[1].lower()}={x}" for x in re.split(r"[\s_-]+", (m[2] or m[3] or m[4] or "").lower()) if x]
    return tuple(out)


def leaves(page: str) -> list[Leaf]:
    """Leaf blocks with a text, in page order."""
    out: list[Leaf] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    words: list[str] = []
    links, linked, at, head = 0, 0, 0, False

    def flush():
        nonlocal linked
        text = " ".join("".join(words).split())
        if text and not head:
            out.append(Leaf([n for _, n in stack], text, linked))
        words.clear()
        linked = 0

    def say(raw: str):
        nonlocal linked
        if raw:
            text = html.unescape(raw)
            words.append(text)
            if links:
                linked += len(text.strip())

    pattern = _TAG
    while at < len(page):
        found = _START.search(page, at)
        if not found:
            say(page[at:])
            break
        say(page[at : found.start()])
        at = found.start()
        if found[0] == "<!--":
            end = page.find("-->", at + 4)
            at = len(page) if end < 0 else end + 3
            continue
        if found[0] in ("<!", "<?"):
            end = page.find(">", at)
            if end < 0:
                say(page[at:])
                break
            at = end + 1
            continue
        m = pattern.match(page, at)
        if not m and pattern is _TAG:
            pattern = _SIMPLE_TAG
            m = pattern.match(page, at)
        if not m:  # no tag ends after this place
            say(page[at:])
            break
        at = m.end()
        tag = m[2].lower()
        if tag == "a":
            links = max(0, links + (-1 if m[1] else 1))
        if tag in RAW and not m[1]:
            if not m[3].rstrip().endswith("/"):
                end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
                at = end.end() if end else len(page)
            if tag not in INLINE:
                flush()
            continue
        if tag == "br":
            words.append(" ")
            continue
        if tag in INLINE:
            continue
        flush()
        if tag == "head":
            head = not m[1]
            continue
        if tag == "body":
            head = False
        if m[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
        elif tag not in VOID:
            if tag in ALONE and stack and stack[-1][0] in ALONE[tag]:
                stack.pop()
            stack.append((tag, _path_names(tag, m[3])))
    flush()
    return out


@lru_cache(1 << 16)
def _slot(text: str, dim: int) -> tuple[int, float]:
    h = zlib.crc32(text.encode())
    return h % dim, 1.0 if h & 0x40000000 else -1.0


def vectors(blocks: list[Leaf]) -> np.ndarray:
    """One row for each leaf."""
    n = len(blocks)
    out = np.zeros((n, PATH_DIM + WORD_DIM + SHAPE_DIM), dtype=np.float32)
    half = PATH_DIM // 2
    place, signs, word_place, word_signs, shape = [], [], [], [], []
    for k, leaf in enumerate(blocks):
        at = k * PATH_DIM
        for depth, names in enumerate(reversed(leaf.path)):
            slots = [_slot(name, half) for name in names]
            place += [at + i + (half if depth else 0) for i, _ in slots]
            signs += [sign for _, sign in slots]
        slots = [_slot(w, WORD_DIM) for w in leaf.text.lower().split()]
        at = k * WORD_DIM
        word_place += [at + i for i, _ in slots]
        word_signs += [sign / len(slots) for _, sign in slots]
        size = len(leaf.text)
        ends = sum(map(leaf.text.count, ".!?,"))
        shape.append((np.log1p(size) / 5, min(leaf.linked / size, 1.0), min(10 * ends / size, 2.0), len(leaf.path) / 8, k / n, 1.0))
    if n:
        out[:, :PATH_DIM] = np.bincount(place, weights=signs, minlength=n * PATH_DIM).reshape(n, PATH_DIM) if place else 0
        out[:, PATH_DIM : PATH_DIM + WORD_DIM] = np.bincount(word_place, weights=word_signs, minlength=n * WORD_DIM).reshape(n, WORD_DIM) if word_place else 0
        out[:, PATH_DIM + WORD_DIM :] = shape
    return out


class Labeller:
    """Bidirectional LSTM and a logistic output; parameters in one dict."""

    def __init__(self, params: dict):
        self.p = params

    @staticmethod
    def fresh(seed: int) -> Labeller:
        rng = np.random.default_rng(seed)
        dim = PATH_DIM + WORD_DIM + SHAPE_DIM
        p = {"o": rng.normal(0, 0.1, 2 * HIDDEN + 1).astype(np.float32)}
        for d in "fb":
            p[f"w{d}"] = (rng.normal(0, 1, (dim + HIDDEN, 4 * HIDDEN)) / np.sqrt(dim + HIDDEN)).astype(np.float32)
            p[f"c{d}"] = np.zeros(4 * HIDDEN, np.float32)
            p[f"c{d}"][HIDDEN : 2 * HIDDEN] = 1.0  # forget gates start open
        return Labeller(p)

    def _run(self, d: str, x: np.ndarray, mask: np.ndarray, keep: bool):
        n, steps, _ = x.shape
        w, c0 = self.p[f"w{d}"], self.p[f"c{d}"]
        dim = x.shape[2]
        inward = x @ w[:dim] + c0
        h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        out, tape = np.zeros((n, steps, HIDDEN), np.float32), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = inward[:, t] + h @ w[dim:]
            i, f, o = (1 / (1 + np.exp(-np.clip(z[:, k * HIDDEN : (k + 1) * HIDDEN], -30, 30))) for k in range(3))
            g = np.tanh(z[:, 3 * HIDDEN :])
            m = mask[:, t : t + 1]
            c1 = (f * c + i * g) * m
            tc = np.tanh(c1)
            h1 = o * tc * m
            if keep:
                tape.append((t, h, c, i, f, o, g, tc, m))
            h, c = h1, c1
            out[:, t] = h
        return out, tape

    def logits(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        hf, tf = self._run("f", x, mask, keep)
        hb, tb = self._run("b", x, mask, keep)
        both = np.concatenate([hf, hb], axis=2)
        return both @ self.p["o"][:-1] + self.p["o"][-1], both, tf, tb

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict:
        z, both, tf, tb = self.logits(x, mask, keep=True)
        dz = (1 / (1 + np.exp(-z)) - y) * mask / mask.sum()
        g = {"o": np.append((both * dz[..., None]).sum((0, 1)), dz.sum()).astype(np.float32)}
        dboth = dz[..., None] * self.p["o"][:-1]
        dim = x.shape[2]
        for d, tape, dh_out in (("f", tf, dboth[..., :HIDDEN]), ("b", tb, dboth[..., HIDDEN:])):
            w = self.p[f"w{d}"]
            gw, gc = np.zeros_like(w), np.zeros(4 * HIDDEN, np.float32)
            dh, dc = np.zeros((len(x), HIDDEN), np.float32), np.zeros((len(x), HIDDEN), np.float32)
            for t, h, c, i, f, o, gg, tc, m in reversed(tape):
                dh = (dh + dh_out[:, t]) * m
                dc = (dc + dh * o * (1 - tc * tc)) * m
                s = np.concatenate([dc * gg * i * (1 - i), dc * c * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - gg * gg)], axis=1)
                gw[:dim] += x[:, t].T @ s
                gw[dim:] += h.T @ s
                gc += s.sum(0)
                dh, dc = s @ w[dim:].T, dc * f
            g[f"w{d}"], g[f"c{d}"] = gw, gc
        return g


def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(len(p) for p in pages)
    x = np.zeros((len(pages), steps, pages[0].shape[1]), np.float32)
    mask = np.zeros((len(pages), steps), np.float32)
    for k, p in enumerate(pages):
        x[k, : len(p)], mask[k, : len(p)] = p, 1
    return x, mask


def fit(pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = 9, batch: int = 32, rate: float = 0.01, seed: int = 5) -> Labeller:
    """Adam on the leaves' cross-entropy."""
    model, rng = Labeller.fresh(seed), np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in model.p.items()}
    v = {k: np.zeros_like(x) for k, x in model.p.items()}
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(pages))
        for s in range(0, len(order), batch):
            chosen = [pages[i] for i in order[s : s + batch]]
            x, mask = _padded([p for p, _ in chosen])
            y = np.zeros(mask.shape, np.float32)
            for k, (_, label) in enumerate(chosen):
                y[k, : len(label)] = label
            step += 1
            for k, g in model.gradients(x, mask, y).items():
                g = np.clip(g, -1, 1)
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                model.p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


def made_up_page(r: random.Random) -> str:
    """A page of a random layout; blocks of the main text start with the sign \\x02."""
    word = lambda: "".join(r.choice("bcdfglmnprstvzéü") + r.choice("aeiouáö") for _ in range(r.randint(1, 4)))
    line = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))
    sentence = lambda: line(2, 25).capitalize() + r.choice([".", ".", ".", "!", "?"])
    prose = lambda: " ".join(sentence() for _ in range(r.choice([1, 1, 2, 4, 8])))
    links = lambda n: "".join(f'<li><a href="/{word()}">{line(1, 3)}</a></li>' for _ in range(n))
    close = lambda s: s if r.random() < 0.9 else ""

    def other() -> str:
        kind = r.choice("menu menu ad ad header footer sidebar notice form comments related share breadcrumb".split())
        text = {
            "menu": f"<nav><ul>{links(r.randint(2, 8))}</ul></nav>" if r.random() < 0.7 else f'<div class="{r.choice(["menu", "nav", "navbar", "topnav"])}"><ul>{links(r.randint(2, 8))}</ul></div>',
            "ad": f'<div class="{r.choice(["ad", "ads", "advert", "promo", "banner", "sponsored"])}">{prose()}</div>',
            "header": f"<header><p>{line(1, 6)}</p></header>" if r.random() < 0.6 else f'<div id="header"><p>{line(1, 6)}</p></div>',
            "footer": f"<footer>&copy; {line(1, 3)} &middot; {prose()}</footer>" if r.random() < 0.7 else f'<div class="footer">{prose()}</div>',
            "sidebar": f"<aside><h3>{line(1, 3)}</h3><p>{prose()}</p></aside>" if r.random() < 0.5 else f'<div class="{r.choice(["sidebar", "side", "widget"])}"><p>{prose()}</p></div>',
            "notice": f'<div class="{r.choice(["cookie", "cookie-notice", "notice", "consent", "alert", "newsletter", "popup"])}"><p>{prose()}</p></div>',
            "form": f"<form><label>{line(1, 3)}</label><p>{line(2, 8)}</p><button>{word()}</button></form>",
            "comments": f'<{(t := r.choice(["div", "section"]))} {r.choice(["class", "id"])}="comments">' + "".join(f'<div class="comment"><p>{prose()}</p></div>' for _ in range(r.randint(1, 5))) + f"</{t}>",
            "related": f'<div class="related"><h3>{line(1, 3)}</h3><ul>{links(r.randint(2, 5))}</ul></div>',
            "share": f'<div class="{r.choice(["share", "social", "tags", "meta"])}">{line(1, 4)}</div>',
            "breadcrumb": f'<div class="breadcrumb"><a href="/">{word()}</a> <a href="/a">{word()}</a></div>',
        }
        return text[kind]

    def block() -> str:
        kind = r.choice("p p p p p p h2 list quote pre".split())
        if kind == "p":
            return f"<p>\x02{prose()}" + r.choice(["</p>", "</p>", "</p>", "", "<br>"])
        if kind == "list":
            return "<ul>" + "".join(f"<li>\x02{sentence()}</li>" for _ in range(r.randint(2, 4))) + "</ul>"
        tag = {"h2": "h2", "quote": "blockquote", "pre": "pre"}[kind]
        return f"<{tag}>\x02{line(1, 8)}</{tag}>"

    tag, attrs = r.choice([("article", "")] * 6 + [("main", ""), ("div", ' class="content"'), ("div", ' id="main"'), ("div", ' class="article-body"'), ("section", ' class="post"'), ("div", ' class="entry"')])
    body = (f"<h1>\x02{line(2, 10)}</h1>" if r.random() < 0.85 else "") + "".join(block() if r.random() < 0.93 else other() for _ in range(r.choice([1, 2, 4, 8, 16])))
    if r.random() < 0.15:
        body += other()
    main = f"<{tag}{attrs}>{body}" + close(f"</{tag}>")
    if r.random() < 0.3:
        main = f'<div class="{r.choice(["wrapper", "container", "page"])}">{main}</div>'
    return "<html><body>" + "".join(other() for _ in range(r.randint(0, 4))) + main + "".join(other() for _ in range(r.randint(0, 4))) + close("</body></html>")


_MODEL: list[Labeller] = []


def trained(pages: int = 600, seed: int = 5) -> Labeller:
    """The labeller, trained once in a process."""
    if not _MODEL:
        r, data = random.Random(seed), []
        for _ in range(pages):
            blocks = leaves(made_up_page(r))
            label = np.array([b.text.startswith("\x02") for b in blocks], dtype=np.float32)
            for b in blocks:
                b.text = b.text.lstrip("\x02").strip() or "."
            if blocks:
                data.append((vectors(blocks), label))
        _MODEL.append(fit(data))
    return _MODEL[0]


def main_texts(pages: list[str], model: Labeller, most: int = 4096) -> list[str]:
    """Main text of each page; pages of similar length share a pass of the network."""
    every = [leaves(p) for p in pages]
    out = [""] * len(pages)
    order = sorted((i for i in range(len(pages)) if every[i]), key=lambda i: len(every[i]))
    while order:
        take = [order.pop()]
        while order and (len(take) + 1) * len(every[take[0]]) <= most:
            take.append(order.pop())
        z = model.logits(*_padded([vectors(every[i]) for i in take]))[0]
        for k, i in enumerate(take):
            out[i] = " ".join(b.text for b, s in zip(every[i], z[k]) if s > 0)
    return out


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """Main text of every page."""
    spark = pages.sparkSession
    ship(spark)
    params = spark.sparkContext.broadcast(trained().p)
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(page).cast("string"), F.lit("")).alias("html"))

    def run(batches):
        model = Labeller(params.value)
        for batch in batches:
            for at in range(0, len(batch), 64):
                part = batch.slice(at, 64)
                texts = main_texts(part.column("html").to_pylist(), model)
                yield pa.record_batch([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, SCHEMA)

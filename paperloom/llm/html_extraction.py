"""Main text of web pages by a linear-chain conditional random field.

A page is a chain of DOM leaf blocks. Each block is described by its ancestors
(tags, and the words of their class, id and role attributes) and by its text
(length, words, share of links, sentence ends, notices' signs). The field has a
weight for each feature and label and for each pair of labels that follow each
other; it is fitted on labelled pages by gradient ascent on the conditional
likelihood (forward-backward), and the best labelling is found by Viterbi.

Labelled pages are built here from templates with known roles: articles in the
usual containers, between and around menus, headers, footers, sidebars, notices,
adverts, forms, related links and comments, the structure, names and texts drawn
from a seeded generator. Any other labelled pages can be given to `fit`.

Results in special cases: null and empty pages, and pages without a content
block, give an empty text; hidden elements, the head, scripts, styles and
comments are never content; a page that is plain text is one block; repeated
rows and null ids are treated like others; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .html_blocks import Block, Node, blocks

TRAINING_PAGES, SEED, STEPS, RIDGE = 600, 11, 160, 1e-3
TAGS = "article main section div p h1 h2 h3 h4 ul ol li nav header footer aside form table tr td th blockquote pre figure figcaption dl dt dd button title head fieldset legend details summary address center".split()
#: Kinds of names in class, id and role attributes: what designers call the parts of a page.
NAMES = {
    "nav": "nav navbar navigation menu menubar breadcrumb breadcrumbs crumb crumbs pagination pager tabs toc toolbar skip".split(),
    "header": "header masthead topbar banner branding logo hero sitehead".split(),
    "footer": "footer foot copyright colophon legal contentinfo imprint bottom".split(),
    "side": "sidebar side aside widget widgets rail complementary secondary".split(),
    "notice": "cookie cookies consent gdpr notice notification alert popup modal overlay paywall newsletter disclaimer warning toast dialog".split(),
    "ad": "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion promoted banner commercial".split(),
    "comment": "comment comments commentlist disqus discussion reply replies respond responses thread".split(),
    "form": "form search searchform login signup subscribe subscription register contact".split(),
    "related": "related recommended recommendations popular trending share sharing social tags tag meta byline author more links also next previous".split(),
    "body": "article content post entry story text body main page prose copy articlebody maincontent".split(),
}
_KIND = {w: k for k, ws in NAMES.items() for w in ws}
_SIGNS = ("©", "cookie", "copyright", "all rights reserved", "subscribe", "sign up", "log in", "advertisement", "sponsored", "privacy", "read more", "comments", "reply", "share")
FEATURES = ["bias", *(f"in_{t}" for t in TAGS), *(f"own_{t}" for t in TAGS), *(f"name_{k}" for k in NAMES), *(f"inner_{k}" for k in NAMES), "article_then_aside", "depth_in_article", "len_1", "len_2", "len_3", "len_4", "link_some", "link_most", "ends", "stops", "sign", "digits", "first", "last"]
_AT = {f: i for i, f in enumerate(FEATURES)}
_ASIDE = frozenset("aside nav footer form".split())


@dataclass(slots=True)
class _Chain:
    """What a block's ancestors say: features, the nearest kind of name, whether an article is open, whether the head is."""

    on: frozenset[int]
    kind: str | None
    article: bool
    head: bool


def _chain(node: Node | None) -> _Chain:
    """Made from the parent's, once for each element."""
    todo: list[Node] = []
    while node is not None and node.state is None:
        todo.append(node)
        node = node.parent
    c = _Chain(frozenset(), None, False, False) if node is None else node.state
    for n in reversed(todo):
        kinds = [_KIND[x] for x in n.names if x in _KIND]
        on = {f"in_{n.tag}", *(f"name_{k}" for k in kinds)}
        if c.article or n.tag == "article":
            on.add("depth_in_article")
            if n.tag in _ASIDE:
                on.add("article_then_aside")
        more = c.on | {_AT[f] for f in on if f in _AT}
        n.state = c = _Chain(c.on if len(more) == len(c.on) else more, kinds[-1] if kinds else c.kind, c.article or n.tag == "article", c.head or n.tag in ("head", "title"))
    return c


def describe(page: list[Block]) -> np.ndarray:
    """A row of features for each block."""
    x = np.zeros((len(page), len(FEATURES)), np.float32)
    for i, b in enumerate(page):
        row, c = x[i], _chain(b.node)
        row[0] = 1
        row[list(c.on)] = 1
        if b.node is not None and (k := _AT.get(f"own_{b.node.tag}")) is not None:
            row[k] = 1
        if c.kind:
            row[_AT[f"inner_{c.kind}"]] = 1
        n = b.text.count(" ") + 1
        row[_AT["len_1" if n < 4 else "len_2" if n < 12 else "len_3" if n < 40 else "len_4"]] = 1
        share = b.link_chars / len(b.text)
        row[_AT["link_some"]], row[_AT["link_most"]] = share > 0.1, share > 0.6
        row[_AT["ends"]] = b.text[-1] in ".!?:\"'”»。"
        row[_AT["stops"]] = ". " in b.text or ", " in b.text
        low = b.text.lower()
        row[_AT["sign"]] = any(s in low for s in _SIGNS)
        row[_AT["digits"]] = sum(map(low.count, "0123456789")) > 0.2 * len(low)
    if len(page):
        x[0, _AT["first"]] = x[-1, _AT["last"]] = 1
    return x


def never(b: Block) -> bool:
    return b.hidden or _chain(b.node).head


# Labelled pages -------------------------------------------------------------------------------------------------------


def labelled_page(rng: random.Random) -> list[tuple[Block, int]]:
    """A page from a template: its blocks and whether each is main text."""
    syllables = [a + b for a in ("", *"bcdfglmnprstv") for b in ("a", "e", "i", "o", "u", "an", "en", "er", "on", "é")]
    word = lambda: "".join(rng.choices(syllables, k=rng.choice((1, 1, 2, 2, 3))))
    words = lambda n: " ".join(word() for _ in range(n))
    sentence = lambda: words(rng.randint(2, 18)).capitalize() + rng.choice((".", ".", ".", "!", "?", ", " + words(3) + "."))
    prose = lambda: " ".join(sentence() for _ in range(rng.choice((1, 1, 2, 3, 5, 8)))) if rng.random() < 0.93 else words(rng.randint(1, 12))
    name = lambda kind: f' {rng.choice(("class", "class", "id"))}="{rng.choice(("", "", "site-", "page-", "js-", "c-"))}{rng.choice(NAMES[kind])}{rng.choice(("", "", "-box", "-wrap", "-inner", " clearfix"))}"'
    maybe = lambda p, s: s if rng.random() < p else ""
    Y, N = "\ue000", "\ue001"  # marks of the labels; they go before the features are made

    def p(mark: str, tag: str = "p", n: str | None = None) -> str:
        body = n if n is not None else prose()
        if rng.random() < 0.1:
            body = f"<{rng.choice('bi')}>{body}" + maybe(0.6, "</b>")
        if mark == Y and rng.random() < 0.15:
            body += f' <a href="#">{words(2)}</a> {words(4)}.'
        return f"<{tag}>{mark}{body}" + maybe(0.85, f"</{tag}>")

    def links(mark: str = N) -> str:
        return "<ul>" + "".join(f'<li><a href="/{word()}">{mark}{words(rng.choice((1, 1, 2, 4)))}</a></li>' for _ in range(rng.randint(2, 7))) + "</ul>"

    def wrap(tags: str, kind: str, inner: str) -> str:
        tag = rng.choice(tags.split())
        attr = name(kind) if tag in ("div", "section", "ul", "p", "span") or rng.random() < 0.4 else ""
        return f"<{tag}{attr}>{inner}</{tag}>"

    def advert() -> str:
        return wrap("div div aside section", "ad", rng.choice((f"{N}{prose()}", p(N), f'<a href="#">{N}{words(4)}</a>', f"<span>{N}Advertisement</span>{p(N)}")))

    def comments() -> str:
        one = lambda: wrap("div li article", "comment", maybe(0.6, f"<h4>{N}{words(2)}</h4>") + "".join(p(N) for _ in range(rng.randint(1, 2))) + maybe(0.4, f'<a href="#">{N}Reply</a>'))
        return wrap("section div", "comment", maybe(0.7, f"<h3>{N}{rng.randint(1, 40)} comments</h3>") + "".join(one() for _ in range(rng.randint(1, 4))))

    def form() -> str:
        return wrap("form form div", "form", rng.choice((f"<label>{N}{words(2)}</label><input><button>{N}{word()}</button>", p(N) + f"<form><p>{N}{words(3)} <input type=text></p><button>{N}Subscribe</button></form>")))

    def side() -> str:
        return wrap("aside aside div section", "side", maybe(0.6, f"<h3>{N}{words(2)}</h3>") + rng.choice((links(), p(N), p(N) + p(N), links() + p(N))))

    def related() -> str:
        return wrap("div section aside", "related", maybe(0.6, f"<h3>{N}{words(2)}</h3>") + links())

    def notice() -> str:
        return wrap("div div section aside", "notice", p(N) + maybe(0.5, f"<button>{N}OK</button>"))

    def inside() -> str:
        kind = rng.random()
        if kind < 0.74:
            return p(Y)
        if kind < 0.80:
            return f"<{(t := rng.choice(('h2', 'h2', 'h3')))}>{Y}{words(rng.randint(1, 7)).capitalize()}</{t}>"
        if kind < 0.84:
            return f"<{(t := rng.choice(('ul', 'ol')))}>" + "".join(f"<li>{Y}{prose()}</li>" for _ in range(rng.randint(1, 5))) + f"</{t}>"
        if kind < 0.87:
            return f"<blockquote>{p(Y)}</blockquote>"
        if kind < 0.89:
            return "<table>" + "".join("<tr>" + "".join(f"<td>{Y}{words(rng.randint(1, 4))}</td>" for _ in range(3)) + "</tr>" for _ in range(rng.randint(1, 3))) + "</table>"
        if kind < 0.90:
            return f"<pre>{Y}{words(8)}</pre>"
        if kind < 0.91:
            return f"<figure><img src=x><figcaption>{Y}{sentence()}</figcaption></figure>"
        return rng.choice((advert, advert, related, form, notice, side))()

    title = f"<h1>{Y}{words(rng.randint(1, 10)).capitalize()}</h1>"
    body = maybe(0.85, rng.choice((title, title, f"<header>{title}</header>"))) + "".join(inside() for _ in range(rng.choice((1, 2, 3, 5, 8, 12)))) + maybe(0.15, comments())
    shape = rng.random()
    article = f"<article>{body}</article>" if shape < 0.3 else wrap("article", "body", body) if shape < 0.5 else f"<main>{maybe(0.5, '<article>')}{body}</main>" if shape < 0.65 else wrap("div div section main", "body", body)
    before = [lambda: wrap("nav nav div ul", "nav", links()), lambda: wrap("header header div", "header", maybe(0.6, rng.choice((f"<h1>{N}{words(2)}</h1>", f"<div>{N}{words(2)}</div>"))) + maybe(0.6, f"<p>{N}{sentence()}</p>") + maybe(0.4, f"<nav>{links()}</nav>")), advert, notice, form]
    after = [comments, comments, side, side, related, advert, form, notice, lambda: wrap("nav div", "nav", links())]
    foot = wrap("footer footer div", "footer", rng.choice((f"{N}&copy; {words(2)} &middot; {prose()}", p(N), links() + p(N), p(N, n="© " + words(4)))))
    page = "<html><body>" + "".join(f() for f in rng.sample(before, rng.randint(0, 4))) + article + "".join(f() for f in rng.sample(after, rng.randint(0, 4))) + maybe(0.85, foot) + "</body></html>"
    out = []
    for b in blocks(page):
        if (y := Y in b.text) or N in b.text:
            b.text = b.text.replace(Y, "").replace(N, "").strip()
            b.link_chars = min(b.link_chars, len(b.text))
            if b.text:
                out.append((b, int(y)))
    return out


# The field ------------------------------------------------------------------------------------------------------------


@dataclass
class Field:
    w: np.ndarray  # features x labels
    t: np.ndarray  # labels x labels

    def viterbi(self, x: np.ndarray) -> list[int]:
        e = x @ self.w
        s, back = e[0], []
        for k in range(1, len(e)):
            m = s[:, None] + self.t
            back.append(m.argmax(axis=0))
            s = m.max(axis=0) + e[k]
        path = [int(s.argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        return path[::-1]


def fit(pages: list[list[tuple[Block, int]]], steps: int = STEPS, ridge: float = RIDGE) -> Field:
    """Gradient ascent (Adam) on the conditional likelihood of labelled pages."""
    pages = [p for p in pages if p]
    n, longest = len(pages), max(map(len, pages))
    x = np.zeros((n, longest, len(FEATURES)), np.float32)
    y, mask = np.zeros((n, longest), int), np.zeros((n, longest), bool)
    for i, p in enumerate(pages):
        x[i, : len(p)] = describe([b for b, _ in p])
        y[i, : len(p)] = [v for _, v in p]
        mask[i, : len(p)] = True
    flat = x[mask]
    one = np.eye(2)[y]
    seen = flat.T @ one[mask]
    both = np.einsum("ntk,ntl->kl", one[:, :-1] * mask[:, 1:, None], one[:, 1:])
    w, t = np.zeros((len(FEATURES), 2)), np.zeros((2, 2))
    m = [np.zeros_like(w), np.zeros_like(t)]
    v = [np.zeros_like(w), np.zeros_like(t)]
    for step in range(1, steps + 1):
        e = np.where(mask[..., None], (x.reshape(-1, x.shape[2]) @ w.astype(np.float32)).reshape(n, longest, 2), 0).astype(float)
        a, b = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        a[:, 0] = e[:, 0]
        for k in range(1, longest):
            a[:, k] = np.where(mask[:, k, None], np.logaddexp(a[:, k - 1, 0, None] + t[0], a[:, k - 1, 1, None] + t[1]) + e[:, k], a[:, k - 1])
        for k in range(longest - 2, -1, -1):
            z = b[:, k + 1] + e[:, k + 1]
            b[:, k] = np.where(mask[:, k + 1, None], np.logaddexp(z[:, 0, None] + t[:, 0], z[:, 1, None] + t[:, 1]), 0)
        total = np.logaddexp(a[:, -1, 0], a[:, -1, 1])
        p = np.exp(a + b - total[:, None, None])
        pair = np.exp(a[:, :-1, :, None] + t + (b + e)[:, 1:, None, :] - total[:, None, None, None]) * mask[:, 1:, None, None]
        grads = [(seen - flat.T @ p[mask]) / n - ridge * w, (both - pair.sum(axis=(0, 1))) / n - ridge * t]
        for g, q, mm, vv in zip(grads, (w, t), m, v, strict=True):
            mm += 0.1 * (g - mm)
            vv += 0.01 * (g * g - vv)
            q += 0.15 * (mm / (1 - 0.9**step)) / (np.sqrt(vv / (1 - 0.99**step)) + 1e-8)
    return Field(w, t)


def trained(pages: int = TRAINING_PAGES, seed: int = SEED) -> Field:
    rng = random.Random(seed)
    return fit([labelled_page(rng) for _ in range(pages)])


def main_text(page: str | None, field: Field) -> str:
    found = [b for b in blocks(page or "") if not never(b)]
    if not found:
        return ""
    return "\n".join(b.text for b, y in zip(found, field.viterbi(describe(found)), strict=True) if y)


def extract(pages: DataFrame, field: Field | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, url, text, n_chars."""
    field = field or trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [main_text(h.as_py(), field) for h in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["id", "url", "text", "n_chars"])

    id_type = pages.schema[id_col].dataType.simpleString()
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.col(f"`{html_col}`").cast("string").alias("html"))
    return rows.mapInArrow(run, f"id {id_type}, url string, text string, n_chars long").withColumnsRenamed({"id": id_col, "url": url_col})

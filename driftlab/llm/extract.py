"""Operator 1: main text of web pages, by gradient-boosted trees over DOM nodes and hierarchical decoding.

Each block element, and each element with a class, id or role, is a node with features: its tag and its parent's, groups of attribute
words on it and above it, depth, place among its siblings and how many are alike, length and density of its subtree's
text, link density, stops. Boosted trees give the log-odds that it is part of the article. Decoding
chooses the labels of the whole tree at once, so that nothing is kept below a node that is dropped (see dom.decode).

The trees are trained on the driver, on ``SYNTHETIC`` generated pages (articles among menus, headers, footers,
sidebars, notices, adverts, forms and comments, with and without telling tags) whose labels are known, and on
``SAMPLE`` pages of the table, the first by a hash of the id, that mark their article with <article> or <main>: there
nodes inside it, but for those inside nav, aside, footer or form, are content.

Text: character references are decoded, white space inside a block becomes one space, blocks are trimmed and joined by
one line feed in page order; <br> is white space. Defined results: a null or empty html, or one without an article,
gives ''; text without any tag is kept as it is; broken markup is read as browsers do in the common cases (implied end
tags, stray end tags, quotes that open no value; a tag without its ">" has the rest of the page); each character of a
page is looked at a bounded number of times; null ids and URLs, repeated rows and extra columns don't matter; an empty table gives no rows.
"""

from __future__ import annotations

import random
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_arrow, table
from .dom import Page, decode

SYNTHETIC, SAMPLE, SAMPLE_BYTES = 700, 150, 200_000
TREES, DEPTH, RATE, BINS, L2 = 50, 5, 0.2, 32, 1.0


# --- boosted trees -----------------------------------------------------------------------------


@dataclass
class Trees:
    feature: np.ndarray  # tree x inner node, as in a heap
    threshold: np.ndarray
    leaf: np.ndarray  # tree x leaf
    base: float

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, t, leaf in zip(self.feature, self.threshold, self.leaf):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            out += leaf[at - len(f)]
        return out


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Trees:
    """Trees of fixed depth for the logistic loss, with Newton steps on histograms of binned features."""
    n, m = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for j in range(m)]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)
    flat = binned + np.arange(m) * BINS
    base = float(np.log((y @ weight + 1) / ((1 - y) @ weight + 1)))
    score, inner = np.full(n, base), (1 << DEPTH) - 1
    feats, cuts, leaves = [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        g, h = weight * (y - p), weight * p * (1 - p)
        at, f, c = np.zeros(n, np.int64), np.zeros(inner, np.int64), np.full(inner, np.inf)
        for d in range(DEPTH):
            first = (1 << d) - 1
            key = ((at - first)[:, None] * (m * BINS) + flat).ravel()
            many = (1 << d) * m * BINS
            gs = np.bincount(key, np.repeat(g, m), many).reshape(-1, m, BINS).cumsum(2)
            hs = np.bincount(key, np.repeat(h, m), many).reshape(-1, m, BINS).cumsum(2)
            gt, ht = gs[:, :, -1:], hs[:, :, -1:]
            gain = gs**2 / (hs + L2) + (gt - gs) ** 2 / (ht - hs + L2) - gt**2 / (ht + L2)
            for j, e in enumerate(edges):
                gain[:, j, len(e) :] = -1
            best = gain.reshape(len(gain), -1).argmax(1)
            for k, b in enumerate(best.tolist()):
                j, v = divmod(b, BINS)
                if gain[k, j, v] > 1e-6:
                    f[first + k], c[first + k] = j, edges[j][v]
            at = 2 * at + 1 + (x[np.arange(n), f[at]] > c[at])
        leaf = np.bincount(at - inner, g, inner + 1) / (np.bincount(at - inner, h, inner + 1) + L2) * RATE
        score += leaf[at - inner]
        feats.append(f)
        cuts.append(c)
        leaves.append(leaf)
    return Trees(np.array(feats), np.array(cuts), np.array(leaves), base)


# --- training pages ----------------------------------------------------------------------------


def synthetic_page(r: random.Random) -> str:
    """A page in which every element of the article, and what holds it, has the attribute data-y=1."""
    word = lambda: "".join(r.choices("etaoinshrdlucmfwypvbgk", k=r.choice((2, 3, 4, 5, 6, 7, 9))))

    def sentence(lo: int, hi: int) -> str:
        w = [word() for _ in range(r.randint(lo, hi))]
        for i in range(len(w) - 1):
            if r.random() < 0.1:
                w[i] += ","
        return " ".join(w).capitalize() + r.choice("....!?")

    def prose(most: int = 6) -> str:
        return " ".join(sentence(1, 18) for _ in range(r.randint(1, r.choice((1, 2, most)))))

    link = lambda: f'<a href="/{word()}">{" ".join(word() for _ in range(r.randint(1, 3)))}</a>'
    plain = r.random() < 0.45  # no telling tags, only classes and ids

    def wrap(tag: str, names: list[str], inner: str, y: int = 0, bare: float = 0.25) -> str:
        name = r.choice(names) if names else ""
        tag, name = ("div", name or tag) if plain or not tag else (tag, "" if r.random() < bare else name)
        attr = f' {r.choice(("class", "class", "id"))}="{name}{r.choice(("", "", f" {word()}", "-wrap", "-box"))}"' if name else ""
        return f'<{tag}{attr} data-y="{y}">{inner}</{tag}>'

    menu = lambda: wrap("nav", ["nav", "menu", "main-nav", "navbar", "breadcrumbs"], "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(r.randint(2, 9))) + "</ul>")
    ad = lambda: wrap("", ["ad", "ads", "advert", "sponsored", "promo-banner", "ad-slot"], r.choice((sentence(3, 15), f"<p>{prose(2)}</p>", link())))
    notice = lambda: wrap("", ["cookie-notice", "notice", "cookie-consent", "alert", "gdpr-popup"], f"<p>{prose(3)}</p>" if r.random() < 0.6 else sentence(4, 20))
    side = lambda: wrap("aside", ["sidebar", "side", "widget", "related-posts", "popular"], r.choice((f"<h3>{sentence(1, 4)}</h3><ul>" + "".join(f"<li>{link()}</li>" for _ in range(r.randint(2, 6))) + "</ul>", f"<h3>{sentence(1, 4)}</h3><p>{prose(3)}</p>", sentence(3, 20))))
    top = lambda: wrap("header", ["header", "masthead", "site-header", "topbar"], r.choice(("", f"<h1>{sentence(1, 4)}</h1>", f"<div class=\"logo\">{word()}</div>")) + r.choice((f"<p>{sentence(2, 8)}</p>", menu(), sentence(1, 6))))
    foot = lambda: wrap("footer", ["footer", "site-footer", "copyright", "legal"], r.choice((f"&copy; {word()} {sentence(2, 20)}", f"<p>{prose(3)}</p>", f"<p>{sentence(2, 9)}</p><ul><li>{link()}</li><li>{link()}</li></ul>")))
    share = lambda: wrap("", ["share", "social-share", "share-links"], " ".join(link() for _ in range(3)))
    control = lambda: r.choice((f"<label>{word()}</label><input name={word()}>", f"<input placeholder={word()}>", f"<select><option>{word()}<option>{word()}</select>", "<textarea></textarea>"))
    bare_form = lambda: f"<form{r.choice(("", "", f" id={word()}", " class=search-form", " action=/send method=post"))} data-y=\"0\">" + r.choice((f"<p>{sentence(2, 9)}</p>", f"<h3>{sentence(1, 4)}</h3>", sentence(1, 6), f"<fieldset><legend>{word()}</legend>{sentence(1, 4)}</fieldset>", "")) + "".join(r.choice((control(), f"<div>{word()} {control()}</div>", f"<p>{sentence(1, 4)} {control()}</p>")) for _ in range(r.randint(1, 4))) + f"<button>{word()}</button>" * (r.random() < 0.7) + "</form>"
    form = lambda: bare_form() if r.random() < 0.5 else wrap("", ["newsletter", "subscribe", "login", "search"], bare_form())

    def talk() -> str:
        one = lambda: wrap("" if r.random() < 0.7 else "article", ["comment", "reply", "comment-body"], f"<p>{prose(3)}</p>" if r.random() < 0.8 else prose(2), 0, 0.1)
        return wrap("section", ["comments", "comment-list", "responses comments", "discussion"], f"<h2>{sentence(1, 3)}</h2>" * (r.random() < 0.5) + "".join(one() for _ in range(r.randint(1, 5))), 0, 0.0)

    def part() -> str:
        k = r.random()
        if k < 0.68:
            return f'<p data-y="1">{prose()}</p>'
        if k < 0.76:
            return f'<h{(n := r.randint(2, 4))} data-y="1">{sentence(1, 8)}</h{n}>'
        if k < 0.84:
            t = r.choice(("ul", "ol"))
            return f'<{t} data-y="1">' + "".join(f'<li data-y="1">{r.choice((sentence(1, 15), link() + " " + sentence(2, 9)))}</li>' for _ in range(r.randint(1, 6))) + f"</{t}>"
        if k < 0.89:
            return f'<blockquote data-y="1"><p data-y="1">{prose(3)}</p></blockquote>'
        if k < 0.92:
            return f'<pre data-y="1">{prose(2)}</pre>'
        if k < 0.95:
            return '<table data-y="1">' + "".join(f'<tr data-y="1"><td data-y="1">{word()}</td><td data-y="1">{sentence(1, 5)}</td></tr>' for _ in range(r.randint(1, 4))) + "</table>"
        if k < 0.98:
            return f'<figure data-y="1"><img src=x><figcaption data-y="1">{sentence(2, 12)}</figcaption></figure>'
        return f'<p data-y="1">{prose(2)} {link()} {prose(2)}</p>'

    if r.random() < 0.06:  # a page that is nothing but a few blocks, often of a word or a letter
        few = "".join(f'<p data-y="1">{r.choice((r.choice("abcdefgh"), word(), sentence(1, 3), prose(2)))}</p>' for _ in range(r.randint(1, 4)))
        return few if r.random() < 0.5 else f"<html><body>{few}</body></html>"
    body = [part() for _ in range(r.choice((0, 1, 1, 2, 3, 5, 8, 14)))]
    head = f'<h1 data-y="1">{sentence(1, 12)}</h1>' if r.random() < 0.85 or not body else ""
    if head and r.random() < 0.15:
        head = f'<header data-y="1">{head}</header>'
    for extra, p in ((ad, 0.3), (share, 0.15), (side, 0.15), (form, 0.2), (notice, 0.05)):
        if r.random() < p:
            body.insert(r.randint(0, len(body)), extra())
    if r.random() < 0.12:
        body.append(talk())
    core = head + "".join(body)
    if r.random() < 0.25:
        core = f'<div class="{r.choice(("entry-content", "post-body", "article-text", word()))}" data-y="1">{core}</div>'
    core = wrap(r.choice(("article", "article", "main", "section")), ["article", "post", "content", "main-content", "entry", "story", word()], core, 1, 0.5)
    before = [f() for f, p in ((top, 0.5), (menu, 0.7), (notice, 0.3), (ad, 0.4)) if r.random() < p]
    after = [f() for f, p in ((side, 0.4), (talk, 0.3), (ad, 0.25), (form, 0.2), (menu, 0.2), (notice, 0.15), (foot, 0.8)) if r.random() < p]
    page = "".join([*before, core, *after])
    if r.random() < 0.3:
        page = f'<div id="{r.choice(("wrapper", "page", "container", "root", word()))}" data-y="1">{page}</div>'
    if r.random() < 0.15:  # some sites put a form around the whole page
        page = f'<form{r.choice(("", f" id={word()}", " id=aspnetForm", " action=/ method=post"))} data-y="1"><input type=hidden name={word()}>{page}</form>'
    return f"<!DOCTYPE html><html><head><title>{word()}</title></head><body>{page}</body></html>"


def _labelled(source: str) -> tuple[Page, list[int], np.ndarray, np.ndarray]:
    """A generated page, its nodes, features and labels."""
    marks: dict[int, int] = {}
    page = Page(source)
    nodes, x = page.features()
    for v in nodes:
        end = source.find(">", page.at[v])
        marks[v] = int('data-y="1"' in source[page.at[v] : end])
    return page, nodes, x, np.array([1 if page.tag[v] in ("html", "body") else marks[v] for v in nodes])


def _weak_labels(page: Page, nodes: list[int]) -> np.ndarray | None:
    """Labels of a page that marks its article, else None."""
    core = [v for v in range(len(page.tag)) if page.tag[v] in ("article", "main")]
    if not core:
        return None
    inside, out, holds = [False] * len(page.tag), [False] * len(page.tag), set()
    for v in core:
        while v >= 0 and v not in holds:
            holds.add(v)
            v = page.parent[v]
    for v in range(1, len(page.tag)):
        inside[v] = inside[page.parent[v]] or page.tag[v] in ("article", "main")
        out[v] = out[page.parent[v]] or page.tag[v] in ("nav", "aside", "footer") or page.tag[v] == "form" and v not in holds or page.never[v]
    return np.array([int(v in holds or inside[v] and not out[v]) for v in nodes])


def train(pages: list[str], synthetic: int = SYNTHETIC, seed: int = 11) -> Trees:
    r, xs, ys, ws = random.Random(seed), [], [], []
    for _ in range(synthetic):
        page, nodes, x, y = _labelled(synthetic_page(r))
        ok = np.array([not page.never[v] for v in nodes])
        xs.append(x[ok])
        ys.append(y[ok])
        ws.append(np.ones(ok.sum()))
    for source in pages:
        page = Page(source)
        nodes, x = page.features()
        y = _weak_labels(page, nodes)
        if y is not None:
            ok = np.array([not page.never[v] for v in nodes])
            xs.append(x[ok])
            ys.append(y[ok])
            ws.append(np.ones(ok.sum()))
    return boost(np.concatenate(xs), np.concatenate(ys), np.concatenate(ws))


# --- the operator ------------------------------------------------------------------------------


def main_text(source: str | None, model: Trees) -> str:
    return main_texts([source], model)[0]


def main_texts(sources: list[str | None], model: Trees) -> list[str]:
    pages = [Page(s) if s else None for s in sources]
    got = [p.features() if p else ([], np.zeros((0, 0), np.float32)) for p in pages]
    sizes = [len(n) for n, _ in got]
    if not sum(sizes):
        return [""] * len(sources)
    score = model.log_odds(np.concatenate([x for n, x in got if n]))
    out, at = [], 0
    for p, (nodes, x) in zip(pages, got):
        if p is None:
            out.append("")
            continue
        out.append(p.text(decode(p, nodes, score[at : at + len(nodes)], x[:, 7])))
        at += len(nodes)
    return out


def fit(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample: int = SAMPLE) -> Trees:
    """Trees from generated pages and a bounded sample of the table: ``sample`` pages of at most SAMPLE_BYTES bytes each."""
    draw = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    rows = pages.select(F.col(html_col).alias("h"), draw.alias("d")).filter((F.octet_length("h") <= SAMPLE_BYTES) & F.col("h").rlike("(?i)<(article|main)[ >]")).orderBy("d", "h").limit(sample)
    return train([r.h for r in rows.select("h").collect()])


def extract_text(pages: DataFrame, model: Trees, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for every row."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for at in range(0, b.num_rows, 100):
                part = b.slice(at, 100)
                text = main_texts(part.column(2).to_pylist(), model)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = dict(pages.dtypes)
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return in_arrow(rows, run, f"page_id {kinds[id_col]}, url {kinds[url_col]}, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract_text(pages, fit(pages))

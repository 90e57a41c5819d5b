"""The DOM of a page as flat lists: a small, forgiving reader of HTML for the extraction operator."""

from __future__ import annotations

import html
import math
import re
from collections import Counter

import numpy as np

#: A well-formed tag; without going back, so it fails after one look at each character.
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++[^\s"'/>=]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'>]++))?+)*+[\s/]*+)>""")
_NAME = re.compile(r"[^\s/>]++")
_ATTR_NAME = re.compile(r"[\s/]*+([^\s/>][^\s/>=]*+)?+")
_EQUALS = re.compile(r"\s*+=\s*+")
_BARE = re.compile(r"[^\s>]*+")
_ATTR = re.compile(r"""(class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noembed noframes".split())
#: Elements that are no article by what they are: scripts, styles, drawings, the page's head and the controls of forms. On all others the trees decide.
NEVER = RAW | frozenset("head template noscript svg math button select optgroup option label legend datalist output meter progress".split())
#: What is counted for an element that may be a form, or hold one.
CONTROLS = frozenset("input button select textarea label".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_ENDS_P = BLOCK - {"html", "body", "head", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
#: A start tag closes an open element of these, up to the given scopes.
_IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table"}), "option": ({"option"}, {"select"})}
_SCOPE = frozenset("html body table td th caption article section div main aside nav header footer form blockquote ul ol".split())
_GROUPS = {
    "main": "article content main post entry story body text prose copy page blog".split(),
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs toc pagination pager tabs toolbar skip links".split(),
    "ad": "ad ads advert adverts advertisement sponsor sponsored promo promotion banner affiliate outbrain taboola".split(),
    "side": "sidebar side aside widget related recommended recommendations more popular trending archive tags".split(),
    "notice": "cookie cookies consent gdpr notice notification alert popup modal overlay disclaimer paywall".split(),
    "talk": "comment comments reply replies respond discussion disqus reader thread".split(),
    "form": "form login signin signup search subscribe subscription newsletter register contact".split(),
    "edge": "footer foot header head masthead topbar bottom copyright legal colophon credits share social".split(),
}
_TOKENS = {w: g for g, ws in _GROUPS.items() for w in ws}
GROUPS = list(_GROUPS)
TAGS = [{"p", "blockquote", "pre", "dd", "dt"}, {"h1"}, {"h2", "h3", "h4", "h5", "h6"}, {"li"}, {"ul", "ol", "menu", "dl"}, {"div", "section", "center"}, {"article"}, {"main"}, {"nav"}, {"aside"}, {"footer", "address"}, {"header", "hgroup"}, {"table", "tr", "td", "th", "tbody", "thead"}, {"figure", "figcaption"}, {"body", "html"}, {"form", "fieldset"}]
_TAG_CODE = {t: i + 1 for i, ts in enumerate(TAGS) for t in ts}


def tag_end(source: str, at: int) -> tuple[int, int]:
    """(end of the attributes, end) of a tag whose name ends at ``at``, as browsers read it: a quote opens a value only after "=".

    A quote that nothing closes is part of a value without quotes. Without any ">" the tag has the rest of the page: (-1, -1).
    """
    while True:
        at = _ATTR_NAME.match(source, at).end()
        equals = _EQUALS.match(source, at)
        if equals:
            at = equals.end()
            quote = source[at : at + 1]
            close = source.find(quote, at + 1) if quote in ("'", '"') else -1
            at = close + 1 if close >= 0 else _BARE.match(source, at).end()
        if at >= len(source):
            return -1, -1
        if source[at] == ">":
            return at, at + 1


class Page:
    """tags, parents and attribute words of the elements, and the text as (element, raw text) with None between blocks."""

    __slots__ = ("tag", "parent", "words", "never", "pieces", "at", "size", "controls")

    def __init__(self, source: str):
        self.tag, self.parent, self.words, self.never, self.at = ["html"], [-1], [()], [False], [0]
        self.pieces: list = []
        self.controls: list[int] = []  # the element that holds each control
        self.size = max(1, len(source))
        stack, pos = [0], 0
        tag, pieces, body = self.tag, self.pieces, False
        end, opened = len(source), Counter()
        while pos < end:
            start = source.find("<", pos)
            mark = source[start + 1 : start + 2] if start >= 0 else ""
            letter = source[start + 2 : start + 3] if mark == "/" else mark
            if start < 0 or not (mark in "!?" or letter.isascii() and letter.isalpha()) or not mark:
                stop = end if start < 0 else start + 1  # text, up to and with a "<" that opens nothing
                pieces.append((stack[-1], source[pos:stop]))
                pos = stop
                continue
            if start > pos:
                pieces.append((stack[-1], source[pos:start]))
            if mark in "!?":
                comment = source.startswith("<!--", start)
                close = source.find("-->", start + 2) if comment else source.find(">", start)
                pos = end if close < 0 else max(close + 3, start + 4) if comment else close + 1
                continue
            m = _TAG.match(source, start)
            if m:
                close, name, attrs, pos = m[1], m[2], m[3], m.end()
            else:
                close = "/" if mark == "/" else ""
                n = _NAME.match(source, start + 1 + len(close))
                to, pos = tag_end(source, n.end())
                if pos < 0:
                    break
                name, attrs = n[0], source[n.end() : to]
            name = name.lower()
            if close:  # an end tag
                if name in BLOCK:
                    pieces.append(None)
                for k in () if not opened[name] else range(len(stack) - 1, 0, -1):
                    if tag[stack[k]] == name:
                        self._close(stack, k, opened)
                        break
                    if name not in BLOCK and tag[stack[k]] in BLOCK:
                        break  # an inline end tag does not close a block
                    if name in ("p", "li", "dd", "dt") and tag[stack[k]] in _SCOPE and tag[stack[k]] not in ("ul", "ol"):
                        break
                continue
            if name in ("html", "body"):
                if name == "body" and not body:
                    body = True
                    self._open(name, attrs, start, stack, opened)
                continue
            if name == "br" or name == "wbr":
                if name == "br":
                    pieces.append((stack[-1], " "))
                continue
            if name in BLOCK:
                pieces.append(None)
            if name in CONTROLS and "hidden" not in attrs.lower():
                self.controls.append(stack[-1])
            if name in VOID:
                continue
            if name in _ENDS_P and opened["p"]:
                for k in range(len(stack) - 1, 0, -1):
                    if tag[stack[k]] == "p":
                        self._close(stack, k, opened)
                        break
                    if tag[stack[k]] in _SCOPE or tag[stack[k]] == "li":
                        break
            if name in _IMPLIED:
                closes, scope = _IMPLIED[name]
                for k in () if not any(opened[c] for c in closes) else range(len(stack) - 1, 0, -1):
                    if tag[stack[k]] in closes:
                        self._close(stack, k, opened)
                        break
                    if tag[stack[k]] in scope:
                        break
            self._open(name, attrs, start, stack, opened)
            if name in RAW:
                self._close(stack, len(stack) - 1, opened)
                shut = re.compile(rf"</{name}(?=[\s/>])[^>]*+>", re.I).search(source, pos)
                pos = shut.end() if shut else end

    def _close(self, stack: list[int], k: int, opened: Counter) -> None:
        for i in stack[k:]:
            opened[self.tag[i]] -= 1
        del stack[k:]

    def _open(self, name: str, attrs: str, at: int, stack: list[int], opened: Counter) -> None:
        words: tuple = ()
        if attrs and "=" in attrs:
            words = tuple(w.lower() for a in _ATTR.findall(attrs) for w in _WORDS.findall(" ".join(a[1:])))
        self.tag.append(name)
        self.parent.append(stack[-1])
        self.words.append(words)
        self.never.append(name in NEVER)
        self.at.append(at)
        opened[name] += 1
        stack.append(len(self.tag) - 1)

    def deciding(self) -> list[int]:
        """For each element itself if a decision is made on it (blocks and what has a class or id), else its nearest ancestor of the kind."""
        out: list[int] = []
        for i, t in enumerate(self.tag):
            out.append(i if i == 0 or t in BLOCK or self.words[i] or self.never[i] else out[self.parent[i]])
        return out

    def features(self) -> tuple[list[int], np.ndarray]:
        """The deciding elements in page order and a row of features for each."""
        of = self.deciding()
        nodes = [i for i in range(len(of)) if of[i] == i]
        index = {v: k for k, v in enumerate(nodes)}
        n = len(nodes)
        own, linked, stops, digits, breaks = ([0] * n for _ in range(5))
        in_link = [False] * len(self.tag)
        for i in range(1, len(self.tag)):
            in_link[i] = self.tag[i] == "a" or in_link[self.parent[i]]
        for piece in self.pieces:
            if piece is None:
                continue
            e, text = piece
            size = len(text) if not text.isspace() else 0
            if not size:
                continue
            k = index[of[e]]
            own[k] += size
            if in_link[e]:
                linked[k] += size
            stops[k] += text.count(".") + text.count(",") + text.count("!") + text.count("?")
            digits[k] += size if size < 4 else 0
        parent = [index[of[self.parent[v]]] if v else -1 for v in nodes]
        sub, sub_link, sub_stops, tags, kids, blocks = own[:], linked[:], stops[:], [1] * n, [0] * n, [1 if x else 0 for x in own]
        asks = [0] * n
        for e in self.controls:
            asks[index[of[e]]] += 1
        for k in range(n - 1, 0, -1):
            p = parent[k]
            sub[p] += sub[k]
            sub_link[p] += sub_link[k]
            sub_stops[p] += sub_stops[k]
            tags[p] += tags[k]
            blocks[p] += blocks[k]
            asks[p] += asks[k]
            kids[p] += 1
        total = max(1, sub[0])
        rows, depth, code, hit, above, place, same = [], [0] * n, [0] * n, [None] * n, [None] * n, [0] * n, {}
        seen = [0] * n
        for k, v in enumerate(nodes):
            p = parent[k]
            code[k] = _TAG_CODE.get(self.tag[v], 0)
            own_hit = [0] * len(GROUPS)
            for w in self.words[v]:
                g = _TOKENS.get(w)
                if g:
                    own_hit[GROUPS.index(g)] = 1
            hit[k] = own_hit
            if p >= 0:
                depth[k] = depth[p] + 1
                # what stands above: attribute groups, then whether article or main, nav, aside, footer, header
                t = self.tag[nodes[p]]
                mine = [a | b for a, b in zip(above[p], [*hit[p], t in ("article", "main"), t == "nav", t == "aside", t == "footer", t == "header"])]
                above[k] = mine
                place[k] = seen[p]
                seen[p] += 1
                key = (p, code[k])
                same[key] = same.get(key, 0) + 1
            else:
                above[k] = [0] * (len(GROUPS) + 5)
        for k, v in enumerate(nodes):
            p = max(parent[k], 0)
            rows.append([
                code[k], code[p], depth[k], kids[k], place[k], place[k] / max(1, seen[p]), same.get((p, code[k]), 1),
                math.log1p(own[k]), math.log1p(sub[k]), sub[k] / total, sub_link[k] / max(1, sub[k]), sub_link[p] / max(1, sub[p]), sub[k] / tags[k], sub_stops[k] / max(1, sub[k]) * 100,
                blocks[k], sub[k] / max(1, sub[p]), self.at[v] / self.size, asks[k], asks[k] / (1 + sub[k]) * 100, *hit[k], *above[k], *hit[p],
            ])
        return nodes, np.array(rows, np.float32)

    def text(self, keep: list[bool]) -> str:
        """The text of the kept elements (a flag for each element): blocks joined by line feeds."""
        blocks, held = [], []
        for piece in [*self.pieces, None]:
            if piece is not None:
                if keep[piece[0]]:
                    held.append(html.unescape(piece[1]) if "&" in piece[1] else piece[1])
            elif held:
                block = " ".join("".join(held).split())
                if block:
                    blocks.append(block)
                held = []
        return "\n".join(blocks)


def decode(page: Page, nodes: list[int], score: np.ndarray, size: np.ndarray) -> list[bool]:
    """The best labelling in which nothing is kept below what is dropped, as a flag for each element.

    score: log-odds that a node is content; each counts by 1 plus the logarithm of its own text. Going up, a node's
    gain when kept is its own score plus the better choice of each child; when dropped, the whole subtree is dropped.
    """
    n = len(nodes)
    of = page.deciding()
    index = {v: k for k, v in enumerate(nodes)}
    parent = [index[of[page.parent[v]]] if v else -1 for v in nodes]
    s = (np.clip(score, -8, 8) * (1 + size)).tolist()
    never = [page.never[v] for v in nodes]
    keep, drop = s[:], [-x for x in s]
    for k in range(n - 1, 0, -1):
        p = parent[k]
        if never[k]:
            keep[k] = -math.inf
        drop[p] += drop[k]
        keep[p] += max(keep[k], drop[k])
    label = [True] * n  # the root is kept: a page may be nothing but text
    for k in range(1, n):
        label[k] = label[parent[k]] and not never[k] and keep[k] > drop[k]
    return [label[index[v]] for v in of]

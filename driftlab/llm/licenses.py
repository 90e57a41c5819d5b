"""Operator 7: license scan by an exact set-similarity join of text blocks (lines) with license templates.

Two passes over whole texts. The first counts, over all documents, how often each word of the templates occurs: the
global order of tokens, rare first (words in no template can't add to an overlap; they all stand last). The second
joins: a template of n distinct words matches a line that holds at least ceil(threshold * n) of them. The prefix
filter looks only at lines with one of the template's first n - need + 1 words in that order; the length filter drops
lines of fewer than ``need`` distinct words; the positional filter drops lines whose words after the first common one
are too few; what is left is verified by the exact intersection. No line that meets the threshold is missed.

A block is never longer than the template (its words over the threshold, so that some words may be put in): words that
are scattered over a long line are no notice. In a line of more words the blocks are the windows of that many
consecutive words; they are looked at only around words of the template's prefix, only where enough words stand, and
verified by exact running counts of distinct words. A notice may also be wrapped over lines: with ``wrapped`` blocks are
also such windows whatever lines they stand on. A window over a line that the template matches already adds none.

Beside the templates, phrases are found as places where their words stand consecutively.

Words: runs of 0-9, a-z and bytes above 127 after lower-casing A-Z. Defined results: a null or empty text has no words
and no labels; null ids, repeated rows and ties are rows of their own; extra columns don't matter; an empty table
gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_arrow, lower_ascii, table, text_chunks, words_of
from .license_texts import TEXTS

#: phrase -> label
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: label -> text of a license or notice
TEMPLATES = TEXTS
THRESHOLD = 0.9


def text_words(text: str) -> np.ndarray:
    return words_of(lower_ascii(np.frombuffer(text.encode(), np.uint8)))[2]


def _vocabulary(templates: Mapping[str, str]) -> np.ndarray:
    return np.unique(np.concatenate([text_words(t) for t in templates.values()] or [np.zeros(0, np.uint64)]))


def token_counts(docs: DataFrame, vocabulary: np.ndarray, text_col: str = "text") -> np.ndarray:
    """How often each word of the sorted vocabulary occurs in all documents."""

    def run(batches):
        import pyarrow as pa

        n = np.zeros(len(vocabulary), np.int64)
        for _, data, offsets in text_chunks(batches):
            h = words_of(lower_ascii(data), offsets)[2]
            at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
            n += np.bincount(at[vocabulary[at] == h], minlength=len(vocabulary))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n))), pa.array(n)], ["word", "n"])

    out = np.zeros(len(vocabulary), np.int64)
    if len(vocabulary):
        counts = in_arrow(docs.select(F.col(text_col).alias("text")), run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).toPandas()
        out[counts.word.to_numpy(int)] = counts.n.to_numpy(int)
    return out


SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, blocks array<struct<label: string, start: long, end: long, containment: double>>"


def scan_licenses(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, phrases: Mapping[str, str] = PHRASES, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", wrapped: bool = False) -> DataFrame:
    """One row per document: phrase places and, in ``blocks``, each matching line (byte span) with its template and containment.

    Lines of more words than a template's block may have count by their windows. wrapped: also windows over two or more lines.

    ``score``: 1 if a phrase occurs, else the greatest containment of a template in a block, else 0.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be over 0 and at most 1")
    vocabulary = _vocabulary(templates)
    counts = token_counts(docs, vocabulary, text_col)
    rank = np.empty(len(vocabulary), np.int64)
    rank[np.lexsort((vocabulary, counts))] = np.arange(len(vocabulary))
    shapes, widths = [], []  # label, sorted ranks, how many are needed; words of a window
    for label, text in sorted(templates.items()):
        r = np.sort(rank[np.searchsorted(vocabulary, np.unique(text_words(text)))])
        shapes.append((label, r, math.ceil(threshold * len(r) - 1e-9)))
        widths.append(math.floor(len(text_words(text)) / threshold + 1e-9))
    starts_with: dict[int, list[int]] = {}  # rank -> templates that have it in their prefix
    for k, (_, r, need) in enumerate(shapes):
        for x in r[: len(r) - need + 1].tolist():
            starts_with.setdefault(x, []).append(k)
    probe = np.zeros(len(vocabulary) + 1, bool)
    probe[list(starts_with)] = True
    sought = [(text_words(p), label) for p, label in phrases.items()]

    def blocks_of(h: np.ndarray) -> list[tuple[int, float]]:
        """Templates, by number, that the distinct words of a line match."""
        h = np.unique(h)
        at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
        own = np.sort(rank[at[vocabulary[at] == h]])
        found = []
        for k in sorted({k for x in own.tolist() for k in starts_with.get(x, ())}):
            _, r, need = shapes[k]
            if len(h) < need:
                continue
            first = np.intersect1d(own, r[: len(r) - need + 1], assume_unique=True)[0]
            i, j = np.searchsorted(r, first), np.searchsorted(own, first)
            if 1 + min(len(r) - i - 1, len(own) - j - 1) < need:
                continue
            common = len(np.intersect1d(own, r, assume_unique=True))
            if common >= need:
                found.append((k, common / len(r)))
        return found

    def windows_of(k: int, ranks: np.ndarray, hits: np.ndarray, low: np.ndarray, high: np.ndarray, best: np.ndarray | None = None) -> list[tuple[int, int, float]]:
        """(first word, end, containment) of windows that template k matches, the best of those that overlap.

        ranks: of all words, the vocabulary's size where in no template; low and high: the ends of each word's document
        or line, which windows do not cross; best: takes the greatest containment of a window that begins at a word.
        """
        _, r, need = shapes[k]
        width = widths[k]
        own = np.zeros(len(vocabulary) + 1, bool)
        own[r[: len(r) - need + 1]] = True
        near = hits[own[ranks[hits]]]
        if not len(near):
            return []
        lo, hi = np.maximum(near - width + 1, low[near]), np.minimum(near + width, high[near])
        new = np.flatnonzero(lo[1:] >= hi[:-1]) + 1  # ranges that touch are one
        lo, hi = lo[np.append(0, new)], hi[np.append(new - 1, len(hi) - 1)]
        lo, hi = lo[hi - lo >= need], hi[hi - lo >= need]
        size = hi - lo
        at = np.arange(size.sum()) + np.repeat(lo - (np.cumsum(size) - size), size)
        own[r] = True
        at = at[own[ranks[at]]]
        order = np.lexsort((at, ranks[at]))
        again = ranks[at[order[1:]]] == ranks[at[order[:-1]]]
        before = np.full(len(at), -1)
        before[order[1:][again]] = at[order[:-1][again]]
        # word i is counted in the windows that begin after its last occurrence and reach it: distinct words of each window
        begins = np.sort(np.maximum(np.maximum(before + 1, at - width + 1), low[at]))
        count = np.searchsorted(begins, at, "right") - np.arange(len(at))
        good = np.flatnonzero(count >= need)
        if best is not None:
            best[at[good]] = np.maximum(best[at[good]], count[good] / len(r))
        starts, found, i = at[good], [], 0
        while i < len(good):
            s = starts[i]
            j = np.searchsorted(starts, min(s + width, high[s]))
            b = good[i + int(np.argmax(count[good[i:j]]))]
            end = at[np.searchsorted(at, min(at[b] + width, high[at[b]])) - 1] + 1
            found.append((int(at[b]), int(end), float(count[b] / len(r))))
            i = int(np.searchsorted(starts, end))
        return found

    def run(batches):
        import pyarrow as pa

        for rows, raw, offsets in text_chunks(batches):
            n = rows.num_rows
            starts, ends, h = words_of(lower_ascii(raw), offsets)
            doc = np.searchsorted(offsets, starts, "right") - 1
            first_of = np.searchsorted(starts, offsets)
            base, lo, hi = np.zeros(n, np.int64), np.full(n, -1), np.full(n, -1)
            names: list[set] = [set() for _ in range(n)]
            for words, label in sought:
                k = len(words)
                if len(h) < k:
                    continue
                same = doc[: len(h) - k + 1] == doc[k - 1 :]
                for j, w in enumerate(words):
                    same &= h[j : len(h) - k + 1 + j] == w
                places = np.flatnonzero(same)
                of = doc[places]
                base += np.bincount(of, minlength=n)
                index = places - first_of[of]
                for d, i in zip(of.tolist(), index.tolist()):
                    lo[d] = i if lo[d] < 0 else min(lo[d], i)
                    hi[d] = max(hi[d], i)
                    names[d].add(label)
            more: list[list] = [[] for _ in range(n)]
            best = np.zeros(len(h))
            if len(vocabulary) and len(h):
                at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
                hits = np.flatnonzero((vocabulary[at] == h) & probe[rank[at]])
                edges = np.union1d(np.flatnonzero(raw == 10), offsets)
                line = np.unique(np.searchsorted(edges, starts[hits], "right"))
                matched = set()
                ranks = np.where(vocabulary[at] == h, rank[at], len(vocabulary))
                line_of = np.searchsorted(edges, starts, "right")
                line_low, line_high = np.searchsorted(starts, edges[line_of - 1]), np.searchsorted(starts, edges[line_of])

                def add(label, i, j, share):
                    d = int(doc[i])
                    more[d].append({"label": label, "start": int(starts[i] - offsets[d]), "end": int(ends[j - 1] - offsets[d]), "containment": float(share)})
                    return d

                for e in line.tolist():
                    s, t = (edges[e - 1] if e else 0), edges[e]
                    i, j = np.searchsorted(starts, [s, t])
                    for k, share in blocks_of(h[i:j]):
                        if j - i <= widths[k]:
                            found = [(i, j, share)]
                        else:
                            found = windows_of(k, ranks, hits[np.searchsorted(hits, i) : np.searchsorted(hits, j)], line_low, line_high)
                        for x, y, part in found:
                            matched.add((shapes[k][0], e))
                            add(shapes[k][0], x, y, part)
                if wrapped and len(hits):
                    low, high, changed = first_of[doc], first_of[doc + 1], set()
                    for k, (label, _, _) in enumerate(shapes):
                        for i, j, share in windows_of(k, ranks, hits, low, high, best):
                            over = np.unique(line_of[i:j]).tolist()
                            if len(over) > 1 and not any((label, e) in matched for e in over):
                                changed.add(add(label, i, j, share))
                    for d in changed:
                        more[d].sort(key=lambda b: (b["start"], b["label"]))
            some = base > 0
            top = np.zeros(n)
            np.maximum.at(top, doc, best)
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column(0), pa.array(np.diff(first_of), pa.int64()), pa.array(base),
                    pa.array(lo, pa.int64(), mask=~some), pa.array(hi, pa.int64(), mask=~some),
                    pa.array([",".join(sorted(x)) for x in names], pa.string()),
                    pa.array([",".join(sorted(x | {b["label"] for b in y})) for x, y in zip(names, more)], pa.string()),
                    pa.array([1.0 if x else max((b["containment"] for b in y), default=t) if not wrapped else t for x, y, t in zip(names, more, top.tolist())], pa.float64()),
                    pa.array(more, pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("containment", pa.float64())]))),
                ],
                ["doc_id", *(x.split()[0] for x in SCHEMA.split(", ")[:7]), "blocks"],
            )

    return in_arrow(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), run, f"doc_id {dict(docs.dtypes)[id_col]}, {SCHEMA}")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"), wrapped=True).drop("blocks")


def _sql() -> str:
    """The same by counting the distinct words of every window, without any of the filters but that a text holds enough words of a template at all."""
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    upper = "".join(map(chr, range(65, 91)))
    words = lambda t: "".join(c if c.isascii() and c.isalnum() else " " for c in t.lower()).split()
    listed = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
    rows = ", ".join(f"('{k}', {listed(sorted(set(words(t))))}, {math.ceil(THRESHOLD * len(set(words(t))) - 1e-9)}, {math.floor(len(words(t)) / THRESHOLD + 1e-9)})" for k, t in TEMPLATES.items())
    places = ", ".join("list_filter(range(1, len(words) + 1), lambda i: " + " AND ".join(f"words[i + {j}] IS NOT DISTINCT FROM '{w}'" for j, w in enumerate(p.split())) + f") AS {label}" for p, label in PHRASES.items())
    every = "list_concat(" * (len(PHRASES) - 1) + list(PHRASES.values())[0] + "".join(f", {x})" for x in list(PHRASES.values())[1:])
    base = "list_filter([" + ", ".join(f"CASE WHEN len({x}) > 0 THEN '{x}' END" for x in PHRASES.values()) + "], lambda v: v IS NOT NULL)"
    return f"""
WITH t AS (SELECT doc_id, row_number() OVER () AS r, translate(coalesce(text, ''), '{upper}', '{upper.lower()}') AS s FROM documents),
w AS (SELECT doc_id, r, regexp_extract_all(s, '{pattern}') AS words FROM t),
p AS (SELECT doc_id, r, len(words) AS n, {places} FROM w),
b AS (SELECT doc_id, r, n, {every} AS places, {base} AS base FROM p),
tpl(label, tw, need, width) AS (VALUES {rows}),
tw AS (SELECT label, need, width, len(tw) AS size, unnest(tw) AS word FROM tpl),
place AS (SELECT r, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM w),
occ AS (SELECT r, label, need, width, size, word, pos, lag(pos, 1, 0) OVER (PARTITION BY r, label, word ORDER BY pos) AS before FROM place JOIN tw USING (word)),
few AS (SELECT r, label FROM occ GROUP BY r, label, need HAVING count(DISTINCT word) >= need),
o AS (SELECT occ.* FROM occ SEMI JOIN few USING (r, label)),
win AS (SELECT a.r, a.label, a.pos, any_value(a.need) AS need, any_value(a.size) AS size, count(*) AS c
  FROM o a JOIN o b ON a.r = b.r AND a.label = b.label AND b.pos >= a.pos AND b.pos < a.pos + a.width AND b.before < a.pos GROUP BY a.r, a.label, a.pos),
m AS (SELECT r, label, max(c / size::DOUBLE) AS c FROM win WHERE c >= need GROUP BY r, label),
g AS (SELECT r, list(label) AS found, max(c) AS c FROM m GROUP BY r)
SELECT doc_id, n::BIGINT AS n_words, len(places)::BIGINT AS n_base, (list_min(places) - 1)::BIGINT AS first_word, (list_max(places) - 1)::BIGINT AS last_word,
  array_to_string(list_sort(base), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(base, coalesce(found, [])))), ',') AS labels,
  CASE WHEN len(places) > 0 THEN 1.0 ELSE coalesce(c, 0.0) END::DOUBLE AS score
FROM b LEFT JOIN g ON g.r = b.r"""


SQL = _sql()

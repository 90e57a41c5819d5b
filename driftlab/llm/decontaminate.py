"""Operator 6: benchmark decontamination with SimHash over item-sized windows.

Texts are lower-cased and cut into words; shingles are runs of five words, weighted by the bytes of their words. A
document is read in windows as long as the benchmark item they are compared with (the whole document if it is
shorter). A window can only be similar to an item with which it shares a shingle, so only windows around such a
shingle are fingerprinted: their 64-bit SimHash comes from running sums over the shingles. The fingerprints of the
items of that length are indexed in eight blocks of eight bits; probing each block with up to two flipped bits finds
every fingerprint within 23 bits (three differing bits in each of eight blocks make 24). Those within ``RADIUS`` bits
are verified by the exact weighted Jaccard similarity of the shingle multisets, ``THRESHOLD`` or more.

The benchmark is held in memory in blocks of about ``BLOCK_BYTES`` of text, at most ``BLOCKS_AT_ONCE`` of them on the
driver and in a job; with a larger benchmark what is found so far is written and read again before the next blocks.

An item of one to four words is one shingle, that run of words: it is found wherever these words stand consecutively.

Defined results: a null text is clean, and so is one of fewer than five words but for such short items; items that are
null or without a word match nothing; repeated items and items with the same id count once; null ids of documents, repeated rows and
ties are rows of their own; of equally similar windows the first is reported; extra columns don't matter; an empty
table gives no rows, an empty benchmark finds nothing.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, in_arrow, lower_bytes, mix64, powers, table, text_chunks, words_of

K, THRESHOLD, RADIUS = 5, 0.8, 20
BLOCK_BYTES, BLOCKS_AT_ONCE = 16 << 20, 4
_BITS = np.arange(64, dtype=np.uint64)
_NEAR = np.array([v for v in range(256) if v.bit_count() <= 2], np.int64)  # flips of up to two of eight bits
_FILTER_BITS = 20


def shingles(h: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and weights of all runs of K words."""
    out = runs(h, K)
    weight = np.zeros(len(out), np.int64)
    for j in range(K):
        weight += sizes[j : len(out) + j]
    return out, weight


def runs(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words."""
    out, p = np.zeros(max(0, len(h) - n + 1), np.uint64), powers(2)[1]
    for j in range(n if len(out) else 0):
        out = out * p + h[j : len(out) + j]
    return mix64(out)


def signs(h: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Running sums of each shingle's +weight or -weight for each of the 64 bits; one more row than shingles."""
    out = np.zeros((len(h) + 1, 64), np.int64)
    np.cumsum(np.where(h[:, None] >> _BITS & np.uint64(1), weight[:, None], -weight[:, None]), axis=0, out=out[1:])
    return out


def fingerprints(sums: np.ndarray) -> np.ndarray:
    return ((sums > 0).astype(np.uint64) << _BITS).sum(axis=1, dtype=np.uint64)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two shingle multisets."""
    h = np.concatenate([a[0], b[0]])
    u, at = np.unique(h, return_inverse=True)
    x = np.bincount(at[: len(a[0])], a[1], len(u))
    y = np.bincount(at[len(a[0]) :], b[1], len(u))
    total = np.maximum(x, y).sum()
    return float(np.minimum(x, y).sum() / total) if total else 0.0


class Items:
    """Items by the number of their words, with the block index of their fingerprints."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.ids, self.shingles, self.sizes = [], [], []
        self.short: dict[int, list[tuple[int, int]]] = {}  # number of words -> (hash, item) of the items that are one run of words
        prints = []
        for item, text in sorted(set(rows)):
            s, e, h = words_of(lower_bytes(text))
            if len(h) < K:
                if len(h):
                    self.short.setdefault(len(h), []).append((int(runs(h, len(h))[0]), item))
                continue
            sh = shingles(h, e - s)
            self.ids.append(item)
            self.shingles.append(sh)
            self.sizes.append(len(h))
            prints.append(fingerprints(signs(*sh)[-1:])[0])
        self.prints = np.array(prints, np.uint64)
        self.vocabulary = np.unique(np.concatenate([s[0] for s in self.shingles] or [np.zeros(0, np.uint64)]))
        lengths: list[set[int]] = [set() for _ in self.vocabulary]
        for s, n in zip(self.shingles, self.sizes):
            for x in np.searchsorted(self.vocabulary, np.unique(s[0])).tolist():
                lengths[x].add(n)
        self.lengths = [sorted(x) for x in lengths]
        self.quick = np.zeros(1 << _FILTER_BITS, bool)
        self.quick[(self.vocabulary & np.uint64((1 << _FILTER_BITS) - 1)).astype(np.int64)] = True
        self.index = {}
        for n in set(self.sizes):
            own = np.flatnonzero(np.array(self.sizes) == n)
            blocks = []
            for b in range(8):
                byte = (self.prints[own] >> np.uint64(8 * b) & np.uint64(255)).astype(np.int64)
                order = np.argsort(byte, kind="stable")
                blocks.append((own[order], np.searchsorted(byte[order], np.arange(257))))
            self.index[n] = blocks

    def within(self, n: int, prints: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
        """All pairs (place in prints, item of n words) within the radius, at most 23."""
        found = []
        for b, (own, at) in enumerate(self.index[n]):
            probes = (prints >> np.uint64(8 * b) & np.uint64(255)).astype(np.int64)[:, None] ^ _NEAR
            lo, hi = at[probes].ravel(), at[probes + 1].ravel()
            many = hi - lo
            which = np.repeat(np.arange(len(lo)), many)
            item = own[np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many) + lo[which]]
            found.append(which // len(_NEAR) * len(self.ids) + item)
        w, i = np.divmod(np.unique(np.concatenate(found)), len(self.ids))
        near = np.bitwise_count(prints[w] ^ self.prints[i]) <= radius
        return w[near], i[near]

    def hits(self, h: np.ndarray, weight: np.ndarray, places: np.ndarray) -> dict[int, tuple[float, int, int]]:
        """For one document, given its shingles and the places of those that an item has: item -> (similarity, first word, end)."""
        best: dict[int, tuple[float, int, int]] = {}
        words = len(h) + K - 1
        by_length: dict[int, list[int]] = {}
        for p, v in zip(places.tolist(), np.searchsorted(self.vocabulary, h[places]).tolist()):
            for n in self.lengths[v]:
                by_length.setdefault(n, []).append(p)
        for n, at in sorted(by_length.items()):
            size, last = min(n, words), max(0, words - n)
            width = size - K + 1  # shingles in a window
            a = np.array(at)
            lo, hi = np.clip(a - width + 1, 0, last), np.minimum(a, last)
            cut = np.flatnonzero(lo[1:] > np.maximum.accumulate(hi)[:-1] + 1) + 1  # runs of windows
            for s, e in zip(np.append(0, cut), np.append(cut, len(a))):
                for from_ in range(int(lo[s]), int(hi[e - 1]) + 1, 4096):  # a bounded piece of a long run
                    to = min(from_ + 4096, int(hi[e - 1]) + 1)
                    part = slice(from_, to - 1 + width)
                    sums = signs(h[part], weight[part])
                    k = to - from_
                    for w, i in zip(*(x.tolist() for x in self.within(n, fingerprints(sums[width : width + k] - sums[:k])))):
                        start = from_ + w
                        sim = similarity((h[start : start + width], weight[start : start + width]), self.shingles[i])
                        if sim >= THRESHOLD and (i not in best or (-sim, start) < (-best[i][0], best[i][1])):
                            best[i] = (sim, start, start + size)
        return best


def _find(items: Items, rows, data: np.ndarray, offsets: np.ndarray) -> list[dict[int, tuple[float, int, int]]]:
    """For each row of a chunk item -> (similarity, first word, end)."""
    out: list[dict] = [{} for _ in range(rows.num_rows)]
    s, e, h = words_of(data, offsets)
    doc = np.searchsorted(offsets, s, "right") - 1
    for n, listed in items.short.items():
        known, own = np.array([x for x, _ in listed], np.uint64), [i for _, i in listed]
        r = runs(h, n)
        ok = np.flatnonzero(np.isin(r, known) & (doc[: len(r)] == doc[n - 1 :]))
        _, once = np.unique(np.stack([doc[ok].astype(np.uint64), r[ok]]), axis=1, return_index=True)  # the first of each document
        for p in ok[once].tolist():
            d = int(doc[p])
            start = p - int(np.searchsorted(s, offsets[d]))
            out[d] |= {own[k]: (1.0, start, start + n) for k in np.flatnonzero(known == r[p]).tolist()}
    sh, weight = shingles(h, e - s)
    if not len(sh) or not items.ids:
        return out
    at = np.flatnonzero(items.quick[(sh & np.uint64((1 << _FILTER_BITS) - 1)).astype(np.int64)] & (doc[: len(sh)] == doc[K - 1 :]))
    at = at[items.vocabulary[np.minimum(np.searchsorted(items.vocabulary, sh[at]), len(items.vocabulary) - 1)] == sh[at]]
    first = np.searchsorted(s, offsets)
    for d in np.unique(doc[at]).tolist():
        lo, hi = first[d], first[d + 1] - K + 1
        own = at[(at >= lo) & (at < hi)] if len(at) < 64 else at[np.searchsorted(at, lo) : np.searchsorted(at, hi)]
        out[d] |= {items.ids[i]: x for i, x in items.hits(sh[lo:hi], weight[lo:hi], own - lo).items()}
    return out


def count_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES, text_col: str = "text") -> int:
    size = benchmark.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return math.ceil(2 * size / block_bytes) if size > block_bytes else 1


def item_blocks(benchmark: DataFrame, n: int, id_col: str = "item_id", text_col: str = "text"):
    """The benchmark as n Items, one after another."""
    rows = benchmark.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).filter("i IS NOT NULL AND t IS NOT NULL")
    for k in range(n):
        part = rows.filter(F.pmod(F.xxhash64("i"), F.lit(n)) == k) if n > 1 else rows
        yield Items([tuple(r) for r in part.collect()])


HITS = "array<struct<item_id: long, start_word: long, end_word: long, similarity: double>>"


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, contaminated, n_items, item_ids, similarity, hits): for each document the items that it holds, each with its best window."""

    def finder(items: Items, last: bool):
        def run(batches):
            import pyarrow as pa

            fields = [("item_id", pa.int64()), ("start_word", pa.int64()), ("end_word", pa.int64()), ("similarity", pa.float64())]
            for rows, data, offsets in text_chunks(batches, lower=True):
                new = [[dict(zip((f for f, _ in fields), (i, s, e, sim))) for i, (sim, s, e) in sorted(x.items())] for x in _find(items, rows, data, offsets)]
                hits = pa.array([x + y for x, y in zip(rows.column(2).to_pylist(), new)], pa.list_(pa.struct(fields)))
                kept = [rows.column(0), hits] if last else [rows.column(0), rows.column(1), hits]
                yield pa.RecordBatch.from_arrays(kept, ["doc_id", "hits"] if last else ["doc_id", "text", "hits"])

        return run

    kind = dict(docs.dtypes)[id_col]
    found = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.array().cast(HITS).alias("hits"))
    n, made = count_blocks(benchmark, block_bytes), f"doc_id {kind}, text string, hits {HITS}"
    for k, items in enumerate(item_blocks(benchmark, n)):  # one after another within a task: no shuffle, one block's index at a time
        last = k == n - 1
        found = in_arrow(found, finder(items, last), f"doc_id {kind}, hits {HITS}" if last else made)
        if not last and k % BLOCKS_AT_ONCE == BLOCKS_AT_ONCE - 1:
            found = cut(found, "decontaminate")
    ids = F.array_sort(F.array_distinct(F.transform("hits", lambda x: x["item_id"])))
    return found.select("doc_id", (F.size("hits") > 0).alias("contaminated"), F.size(ids).alias("n_items"), ids.alias("item_ids"), F.coalesce(F.array_max(F.transform("hits", lambda x: x["similarity"])), F.lit(0.0)).alias("similarity"), "hits")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs without those that hold an item; the columns stay as they are."""

    def keeper(items: Items):
        def run(batches):
            import pyarrow as pa

            for rows, data, offsets in text_chunks(batches, text_col, lower=True):
                yield rows.filter(pa.array([not x for x in _find(items, rows, data, offsets)], pa.bool_()))

        return run

    out, n = docs, count_blocks(benchmark, block_bytes)
    for k, items in enumerate(item_blocks(benchmark, n)):
        out = in_arrow(out, keeper(items), docs.schema)
        if k < n - 1 and k % BLOCKS_AT_ONCE == BLOCKS_AT_ONCE - 1:
            out = cut(out, "decontaminate")
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))

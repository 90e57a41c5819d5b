"""Operator 3: exact substring deduplication over suffix arrays of repeated passages.

A document loses every byte covered by a string of 50 bytes that also starts in a document with a smaller id. Equal
strings must meet, so each 50-byte window is assigned by its content: to its anchor, the run of 16 bytes with the
least hash among its 35 (the leftmost of equal ones); consecutive windows mostly share one.

1. Copies: of equal texts (by SHA-256) the one with the least id stands for all; the others are covered by it entirely.
2. Anchors: the documents' anchor hashes are dealt out by hash, 48 bits each, in packed blocks; those that two or more
   documents have come back to their documents. A match of 50 bytes shares its anchor, so none is lost. Anchors only
   deal windows out and rule windows out; they never say that a window is a repetition.
3. Pieces: only windows with such an anchor can be repeated. Those of one anchor are cut out as a piece and dealt out
   by the anchor's hash.
4. Suffix arrays: the pieces of a key are sorted by grouping (see grouping.suffix_order), all keys of a task at once;
   neighbours in that order that agree in 50 bytes form a group, and the group's least id tells for each window whether
   it is a repetition. The verdicts go back to the documents as bit masks.

A hash of a piece's bytes says which pieces are sorted together first, and the suffix order which of them are equal: within
a block of documents pieces are sorted beside the one of their hash with the least id (as runs, where they go on from each
other), and only that one goes on; those that meet in a key are sorted ``FOLD`` at a time, over letters of four bytes, until one of
each is left, and then all that differ together. No piece is sorted alone.

Frequent strings: a key must not gather all documents that hold a common line. An anchor with ``HOT`` or more different
surroundings in a sample of documents is not used: each of its windows has its own 50 bytes for an anchor, in steps 2 to
4 alike. In the same way a key of over ``CROWD`` different pieces is divided within its task into keys by windows of 50
bytes. Both only divide the work.

Rows that share an id, null ids above all, are told apart by a tag, a hash of their text (0 where an id is the only one
of its kind): anchors and verdicts come back to a row and not to an id, so the work stays linear in such rows.

A window counts as repeated only in a group of the suffix order, whose neighbours agree in all 50 bytes. Hashes only rule
windows out; of whole texts SHA-256 stands for the bytes.

Defined results: a null text is empty; ids that are null count as larger than all others and equal to each other;
documents with the same id don't remove anything from each other; ties and repeated rows are documents of their own;
extra columns don't matter; an empty table gives no rows; a text of under 50 bytes is kept.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, fresh, in_arrow, mix64, only, powers, table, text_chunks
from .grouping import suffix_order

LENGTH, GRAM = 50, 16
WINDOW = LENGTH - GRAM + 1
SAMPLE, SAMPLE_BYTES, HOT, CROWD = 4_000, 32 << 20, 12, 64
PIECE = 1 << 18  # bytes that are looked at together; a place among them has 24 bits
BLOCK_TEXT = 8 << 20  # bytes of documents whose anchors or pieces leave a task together
BUCKET_TEXT, HOME_TEXT, LEAST_TEXT = 8 << 20, 32 << 20, 1 << 20  # bytes of documents for each bucket of anchors, each group of documents that verdicts come back to, and each task at least
LOT_PIECES, LOT_BYTES = 10_000, 1 << 17  # pieces that are judged, and numbers that are sorted, together
FOLD, RUN = 8, 256  # copies that are sorted together, and windows of a run of pieces
SALTS = 32  # parts of a text's copies
_LAST = (1 << 63) - 1
_PLACE = np.uint64((1 << 24) - 1)
_U = np.uint64


def _anchors(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Runs of windows with a common anchor: first window, how many, anchor's hash; and the hash of 50 bytes at each place."""
    n = len(data)
    if n < LENGTH:
        none = np.zeros(0, np.int64)
        return {"start": none, "count": none, "key": none.view(_U), "h50": none.view(_U)}
    p = powers(64)
    x = data.astype(_U) + _U(1)
    grams = {1: x}
    for s in (1, 2, 4, 8, 16):
        y = grams[s]
        grams[2 * s] = y[:-s] * p[s] + y[s:]
    h50 = (grams[32][: n - 49] * p[16] + grams[16][32 : 32 + n - 49]) * p[2] + grams[2][48 : 48 + n - 49]
    h = grams[16] * _U(0xD6E8FEB86659FD93)
    h ^= h >> _U(32)
    m = (h & ~_PLACE) | np.arange(len(h), dtype=_U)
    for s in (1, 2, 4, 8, 16):
        m = np.minimum(m[:-s], m[s:])
    place = (np.minimum(m[:-3], m[3:]) & _PLACE).astype(np.int64)
    windows = len(place)
    ok = np.zeros(windows + 1, np.int32)  # windows that cross from one document into the next don't count
    inner = offsets[1:-1]
    np.add.at(ok, np.clip(inner - LENGTH + 1, 0, windows), 1)
    np.add.at(ok, np.clip(inner, 0, windows), -1)
    ok = np.cumsum(ok[:-1]) == 0
    new = np.ones(windows, bool)
    new[1:] = (place[1:] != place[:-1]) | ~ok[:-1]
    start = np.flatnonzero(new & ok)
    stop = np.ones(windows, bool)
    stop[:-1] = new[1:] | ~ok[1:]
    count = np.flatnonzero(stop & ok) - start + 1
    return {"start": start, "count": count, "key": h[place[start]], "h50": h50}


def _runs(data: np.ndarray, offsets: np.ndarray, hot: np.ndarray) -> dict[str, np.ndarray]:
    """_anchors, but each window of a frequent anchor is a run of its own, and its 50 bytes its anchor."""
    a = _anchors(data, offsets)
    is_hot = _among(a["key"], hot)
    if is_hot.any():
        hs, hc = a["start"][is_hot], a["count"][is_hot]
        single = np.arange(hc.sum()) - np.repeat(np.cumsum(hc) - hc - hs, hc)
        start = np.concatenate([a["start"][~is_hot], single])
        order = np.argsort(start, kind="stable")
        for name, own in (("start", single), ("count", np.ones(len(single), np.int64)), ("key", mix64(a["h50"][single] + _U(3)))):
            a[name] = np.concatenate([a[name][~is_hot], own])[order]
    return a


def _pieces(data: np.ndarray, offsets: np.ndarray, size: int):
    """(first document, data, offsets, shift) of a chunk in pieces that anchor places can name; long documents in overlapping parts."""
    if len(data) <= 2 * size:
        yield 0, data, offsets, 0
        return
    for d in range(len(offsets) - 1):
        for at in range(int(offsets[d]), max(int(offsets[d]) + 1, int(offsets[d + 1]) - LENGTH + 1), size):
            part = data[at : min(at + size + LENGTH - 1, int(offsets[d + 1]))]
            yield d, part, np.array([0, len(part)]), at - int(offsets[d])


def _blocks(batches, most: int, *columns: str):
    """Lists of (values of the columns, data, offsets) of about ``most`` bytes together."""
    held, size = [], 0
    for rows, data, offsets in text_chunks(batches, most=PIECE):
        held.append(([rows.column(rows.schema.get_field_index(c)) for c in columns], data, offsets))
        size += len(data)
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def hot_keys(docs: DataFrame) -> np.ndarray:
    """Anchors with HOT or more different surroundings in the sample: the first SAMPLE documents by a hash of their id, and of these as many as SAMPLE_BYTES hold."""
    drawn = docs.select("did", "tag", F.octet_length("text").alias("size"), F.xxhash64("did", "tag", F.lit(3)).alias("draw")).orderBy("draw", "size").limit(SAMPLE)
    upto = F.sum("size").over(Window.orderBy("draw", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow))  # over at most SAMPLE rows
    ids = drawn.withColumn("upto", upto).filter(F.col("upto") <= SAMPLE_BYTES).select("did", "tag", "size").distinct()

    def run(batches):
        import pyarrow as pa

        for _, data, offsets in text_chunks(batches, most=PIECE):
            for _, part, cuts, _ in _pieces(data, offsets, PIECE):
                a = _anchors(part, cuts)
                around = _content(a["h50"], a["start"], a["count"])
                yield pa.RecordBatch.from_arrays([pa.array(a["key"].view(np.int64)), pa.array(around.view(np.int64))], ["k", "around"])

    few = docs.withColumn("size", F.octet_length("text")).join(F.broadcast(ids), ["did", "tag", "size"], "left_semi").select("text")
    found = in_arrow(few, run, "k long, around long").distinct().groupBy("k").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= HOT)
    return np.sort(found.select("k").toPandas()["k"].to_numpy(np.int64).view(_U))  # at most SAMPLE_BYTES / HOT numbers


def _content(h50: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each run of windows: its first and last window overlap or meet, so they hold all of it."""
    return mix64(h50[start] + _U(7) * mix64(h50[start + count - 1]) + count.astype(_U))


def _among(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(keys), bool)
    return known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys


_PACKED = "home long, dids binary, tids binary, many binary, first binary, second binary"


def _pack_by_document(did: np.ndarray, tid: np.ndarray, first: np.ndarray, second: np.ndarray, homes: int):
    """A batch of rows, one for each of ``homes`` groups of documents: the entries of its documents end to end."""
    import pyarrow as pa

    if not len(did):
        return
    home = (mix64(did.view(_U) ^ mix64(tid.view(_U))) % _U(homes)).astype(np.int64)
    order = np.lexsort((tid, did, home))
    home, did, tid, first, second = home[order], did[order], tid[order], first[order], second[order]
    new = np.append(True, (did[1:] != did[:-1]) | (tid[1:] != tid[:-1]))
    heads = np.flatnonzero(new)
    many = np.diff(np.append(heads, len(did))).astype(np.uint32)
    at = np.flatnonzero(np.append(True, home[1:] != home[:-1]))
    ends = np.append(at[1:], len(home))
    group = np.searchsorted(heads, np.append(at, len(home)))
    own = [(home[s], did[heads[g:h]].tobytes(), tid[heads[g:h]].tobytes(), many[g:h].tobytes(), first[s:e].tobytes(), second[s:e].tobytes()) for s, e, g, h in zip(at, ends, group[:-1], group[1:])]
    for i in range(0, len(own), 32):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*own[i : i + 32]), (pa.int64(), *[pa.binary()] * 5))], [x.split()[0] for x in _PACKED.split(", ")])


def _gathered(packed: DataFrame, first: np.dtype, second: np.dtype, once: bool = False) -> DataFrame:
    """(did, tid, first, second): the entries of each document in one row, from rows packed for groups of documents; once: equal ones of tagged rows are one."""

    def run(batches):
        import pyarrow as pa

        home, held = None, []

        def done():
            many = np.concatenate([np.frombuffer(r[2], np.uint32) for r in held])
            did, tid = (np.repeat(np.concatenate([np.frombuffer(r[k], np.int64) for r in held]), many) for k in (0, 1))
            x, y = (np.concatenate([np.frombuffer(r[k], t) for r in held]) for k, t in ((3, first), (4, second)))
            several = once and tid.any()  # rows that agree in id and text send what they have alike
            order = np.lexsort((y, x, tid, did) if several else (tid, did))
            did, tid, x, y = did[order], tid[order], x[order], y[order]
            if several:
                new = np.append(True, (did[1:] != did[:-1]) | (tid[1:] != tid[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1]))
                did, tid, x, y = did[new], tid[new], x[new], y[new]
            at = np.flatnonzero(np.append(True, (did[1:] != did[:-1]) | (tid[1:] != tid[:-1])))
            ends = np.append(at[1:], len(did))
            for i in range(0, len(at), 2_000):
                s, e = at[i : i + 2_000], ends[i : i + 2_000]
                yield pa.RecordBatch.from_arrays([pa.array(did[s]), pa.array(tid[s]), *(pa.array([v[a:b].tobytes() for a, b in zip(s, e)], pa.binary()) for v in (x, y))], ["did", "tid", "first", "second"])

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if row[0] != home and held:
                    yield from done()
                    held = []
                home = row[0]
                held.append(row[1:])
        if held:
            yield from done()

    return in_arrow(packed.repartition("home").sortWithinPartitions("home"), run, "did long, tid long, first binary, second binary")


def _shared_anchors(docs: DataFrame, hot: np.ndarray, buckets: int, homes: int) -> DataFrame:
    """(did, tag, high, low): for each document its anchors that documents with other ids have too, 48 bits each."""

    names = ["bucket", "dids", "tags", "many", "high", "low"]

    def emit(did, tag, key):
        """Rows for documents themselves, with bucket -1."""
        import pyarrow as pa

        if len(did):
            yield pa.RecordBatch.from_arrays([pa.array([-1]), *(pa.array([x], pa.binary()) for x in (did.tobytes(), tag.tobytes(), b"", key.tobytes(), b""))], names)

    def pack(batches):
        import pyarrow as pa

        for held in _blocks(batches, BLOCK_TEXT, "did", "tag"):
            keys, dids, tags = [], [], []
            for (ids, marks), data, offsets in held:
                ids, marks = ids.to_numpy(), marks.to_numpy()
                for first, part, cuts, _ in _pieces(data, offsets, PIECE):
                    a = _runs(part, cuts, hot)
                    doc = first + np.searchsorted(cuts, a["start"], "right") - 1
                    keys.append(a["key"] >> _U(16))
                    dids.append(ids[doc])
                    tags.append(marks[doc])
            key, did, tag = np.concatenate(keys), np.concatenate(dids), np.concatenate(tags)
            order = np.lexsort((tag, did, key) if tag.any() else (did, key))
            key, did, tag = key[order], did[order], tag[order]
            new = np.append(True, (key[1:] != key[:-1]) | (did[1:] != did[:-1]) | (tag[1:] != tag[:-1])) if len(key) else np.zeros(0, bool)
            key, did, tag = key[new], did[new], tag[new]
            at = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
            many = np.diff(np.append(at, len(key)))
            both = np.repeat(did[at] != did[at + many - 1], many)  # shared within the block: all of these know already
            yield from emit(did[both], tag[both], key[both].view(np.int64))
            go = ~both
            go[at] = True  # to its bucket such an anchor goes once, with its least id; rows of one id all ask there
            key, did, tag = key[go], did[go], tag[go]
            bucket = (key % _U(buckets)).astype(np.int64)
            order = np.lexsort((tag, did, bucket) if tag.any() else (did, bucket))
            key, did, tag, bucket = key[order], did[order], tag[order], bucket[order]
            edges = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else []
            out = []
            for s, e in zip(edges, [*edges[1:], len(bucket)]):
                own = s + np.flatnonzero(np.append(True, (did[s + 1 : e] != did[s : e - 1]) | (tag[s + 1 : e] != tag[s : e - 1])))
                many = np.diff(np.append(own, e))
                out.append((int(bucket[s]), did[own].tobytes(), tag[own].tobytes(), many.astype(np.uint32).tobytes(), (key[s:e] >> _U(16)).astype(np.uint32).tobytes(), (key[s:e] & _U(0xFFFF)).astype(np.uint16).tobytes()))
            for i in range(0, len(out), 64):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[i : i + 64]), (pa.int64(), *[pa.binary()] * 5))], names)

    def meet(held):
        did, tag = (np.concatenate([np.repeat(np.frombuffer(r[k], np.int64), np.frombuffer(r[2], np.uint32)) for r in held]) for k in (0, 1))
        key = np.concatenate([np.frombuffer(h, np.uint32).astype(np.int64) << 16 | np.frombuffer(x, np.uint16) for *_, h, x in held])
        order = np.lexsort((did, key))
        did, tag, key = did[order], tag[order], key[order]
        new = np.append(True, key[1:] != key[:-1])
        at = np.flatnonzero(new)
        last = np.append(at[1:], len(key)) - 1
        shared = np.repeat(did[at] != did[last], last - at + 1)
        return did[shared], tag[shared], key[shared]

    def run(batches):
        bucket, held = None, []

        def done():
            if bucket < 0:
                did, tag, key = (np.concatenate([np.frombuffer(r[k], np.int64) for r in held]) for k in (0, 1, 3))
            else:
                did, tag, key = meet(held)
            yield from _pack_by_document(did, tag, (key >> 16).astype(np.uint32), (key & 0xFFFF).astype(np.uint16), homes)

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if held and (row[0] != bucket or bucket < 0):
                    yield from done()
                    held = []
                bucket = row[0]
                held.append(row[1:])
        if held:
            yield from done()

    spread = F.when(F.col("bucket") < 0, F.xxhash64("dids", "high")).otherwise(F.col("bucket"))
    packed = in_arrow(docs.select("did", "tag", "text"), pack, "bucket long, dids binary, tags binary, many binary, high binary, low binary")
    found = in_arrow(packed.repartition(spread).sortWithinPartitions("bucket"), run, _PACKED)
    return _gathered(found, np.uint32, np.uint16, once=True).select("did", F.col("tid").alias("tag"), F.col("first").alias("high"), F.col("second").alias("low"))


_PIECES = "bucket long, dids binary, tids binary, docs binary, starts binary, counts binary, keys binary, hashes binary, bytes binary"


def _cut_pieces(docs: DataFrame, hot: np.ndarray, buckets: int) -> DataFrame:
    """Packed pieces by bucket, of rows (did, tid, text, high, low); rows with bucket -1 hold verdicts that are known already."""

    def run(batches):
        import pyarrow as pa

        for held in _blocks(batches, BLOCK_TEXT, "did", "tid", "high", "low"):
            cols: dict[str, list] = {k: [] for k in ("key", "did", "tid", "start", "count", "hash", "bytes")}
            for (ids, tids, high, low), data, offsets in held:
                ids, tids = ids.to_numpy(), tids.to_numpy()
                shared = [np.sort(np.frombuffer(x, np.uint32).astype(np.int64) << 16 | np.frombuffer(y, np.uint16)) for x, y in zip(high.to_pylist(), low.to_pylist())]
                for first, part, cuts, shift in _pieces(data, offsets, PIECE):
                    a = _runs(part, cuts, hot)
                    doc = first + np.searchsorted(cuts, a["start"], "right") - 1
                    some = np.zeros(len(doc), bool)
                    key48 = (a["key"] >> _U(16)).view(np.int64)
                    runs = np.searchsorted(doc, np.arange(first, first + len(cuts)))
                    for d in range(len(cuts) - 1):
                        s, e = runs[d], runs[d + 1]
                        if e > s and len(shared[first + d]):
                            some[s:e] = _among(key48[s:e], shared[first + d])
                    start, count, doc = a["start"][some], a["count"][some], doc[some]
                    cols["key"].append(a["key"][some])
                    cols["did"].append(ids[doc])
                    cols["tid"].append(tids[doc])
                    cols["start"].append(start - cuts[doc - first] + shift)
                    cols["hash"].append(_content(a["h50"], start, count))
                    cols["count"].append(count)
                    base = len(cols["bytes"])
                    cols["bytes"].append((part, start))
                    cols.setdefault("of", []).append(np.full(len(start), base))
                    cols.setdefault("raw", []).append(start)
            if not cols["key"]:
                continue
            key, did, tid, start, count, hash_, of, raw = (np.concatenate(cols[k]) for k in ("key", "did", "tid", "start", "count", "hash", "of", "raw"))
            parts = [p for p, _ in cols["bytes"]]
            at = np.cumsum([0, *map(len, parts)])[of] + raw
            known = _repeat_in_block(did, count, hash_, at, np.concatenate(parts))
            yield from _packed(pa, np.full(known.sum(), -1), *(x[known] for x in (key, did, tid, start, count, hash_)), None)
            go = np.flatnonzero(~known)
            bucket = (key[go] % _U(buckets)).astype(np.int64)
            o = np.lexsort((key[go], bucket))
            go, bucket = go[o], bucket[o]
            yield from _packed(pa, bucket, *(x[go] for x in (key, did, tid, start, count, hash_)), (parts, of[go], raw[go]))

    return in_arrow(docs, run, _PIECES)


def _repeat_in_block(did: np.ndarray, count: np.ndarray, hash_: np.ndarray, at: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Which pieces a document of the block with a smaller id has too, as the suffix order shows.

    Each piece is held against the one of its hash with the least id; pieces that go on from each other, as those do, are one run.
    """
    order = np.lexsort((did, hash_))
    heads = np.flatnonzero(np.append(True, hash_[order][1:] != hash_[order][:-1]))
    other = np.empty(len(order), np.int64)
    other[order] = np.repeat(order[heads], np.diff(np.append(heads, len(order))))
    known = did > did[other]
    own = np.flatnonzero(known)
    own = own[np.argsort(at[own])]
    if len(own):
        a, b, n = at[other[own]], at[own], count[own]
        new = np.append(True, (b[1:] != b[:-1] + n[:-1]) | (a[1:] != a[:-1] + n[:-1]))
        first = np.flatnonzero(new)
        before = np.cumsum(n) - n
        inside = before - np.repeat(before[first], np.diff(np.append(first, len(n))))
        first = np.flatnonzero(new | np.append(False, inside[1:] // RUN != inside[:-1] // RUN))
        shown = _shown(a[first], b[first], np.add.reduceat(n, first), data)
        known[own] = np.logical_and.reduceat(shown, before)
    return known


def _shown(a: np.ndarray, b: np.ndarray, size: np.ndarray, data: np.ndarray) -> np.ndarray:
    """For pairs of runs of windows, at a and b in data: which windows of the second ones, end to end, are in a group with one of the first."""
    out, starts = np.zeros(size.sum(), bool), np.cumsum(size) - size
    order = np.lexsort((b, size, a))
    cost = np.cumsum(size[order] + LENGTH)
    s = 0
    while s < len(order):
        e = max(s + 1, int(np.searchsorted(cost, (cost[s - 1] if s else 0) + LOT_BYTES, "right")))
        own = order[s:e]
        new = np.append(True, (a[own][1:] != a[own][:-1]) | (size[own][1:] != size[own][:-1]))
        rank = np.arange(len(own)) - np.flatnonzero(new)[np.cumsum(new) - 1]
        first = rank % (FOLD - 1) == 0  # a run and FOLD - 1 of those that may be its copies are sorted together
        lots, lot = int(first.sum()), np.cumsum(first) - 1
        group, label = np.append(np.arange(lots), lot), np.append(np.zeros(lots, np.int64), np.ones(len(own), np.int64))
        least = _sorted(group, label, np.append(size[own][first], size[own]), np.append(a[own][first], b[own]), data)[lots:]
        p, w = _windows(size[own])
        out[starts[own][p] + w] = least[p, w] == 0
        s = e
    return out


def _packed(pa, bucket, key, did, tid, start, count, hash_, source):
    """Rows of pieces of one bucket, each with a list of its documents; without source (verdicts known already) neither keys nor bytes."""
    names = [x.split()[0] for x in _PIECES.split(", ")]
    batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(zip(*rows), (pa.int64(), *[pa.binary()] * 8))], names)
    edges = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else []
    rows, held = [], 0
    for s, e in zip(edges, [*edges[1:], len(bucket)]):
        for s in range(s, e, 50_000):
            t = min(e, s + 50_000)
            pair, of = np.unique(np.stack([did[s:t], tid[s:t]], 1), axis=0, return_inverse=True)
            parts, part, raw = source or ((), (), ())
            text = b"".join([parts[k][r : r + c + LENGTH - 1].tobytes() for k, r, c in zip(part[s:t].tolist(), raw[s:t].tolist(), count[s:t].tolist())]) if source else b""
            own = (key[s:t].tobytes(), hash_[s:t].tobytes()) if source else (b"", b"")
            rows.append((int(bucket[s]), pair[:, 0].tobytes(), pair[:, 1].tobytes(), of.astype(np.uint32).tobytes(), start[s:t].astype(np.uint32).tobytes(), count[s:t].astype(np.uint8).tobytes(), *own, text))
            held += len(text) + (t - s) * 25
            if held > 4 << 20:
                yield batch()
                rows, held = [], 0
    if rows:
        yield batch()


def _judge(key: np.ndarray, did: np.ndarray, count: np.ndarray, hash_: np.ndarray, at: np.ndarray, data: np.ndarray, crowded: int = CROWD) -> np.ndarray:
    """For each piece, the windows (as bits) that also start in a document with a smaller id. at: where its bytes begin in data."""
    order = np.lexsort((did, hash_, key))
    k, h = key[order], hash_[order]
    keys = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
    several = np.maximum.reduceat(did[order], keys) > np.minimum.reduceat(did[order], keys)
    met = np.empty(len(order), bool)
    met[order] = np.repeat(several, np.diff(np.append(keys, len(order))))  # a key that only one document has repeats nothing
    # equal pieces of a key are one piece, with the least of their ids
    kin, root = np.empty(len(order), np.int64), np.arange(len(order))
    kin[order] = np.cumsum(np.append(True, (k[1:] != k[:-1]) | (h[1:] != h[:-1])))
    some = np.flatnonzero(met)
    root[some] = some[_alike(kin[some], did[some], count[some], at[some], data)]
    one = order[root[order] == order]
    of = np.empty(len(order), np.int64)
    of[one] = np.arange(len(one))
    of = of[root]
    most = did[one]
    np.maximum.at(most, of, did)
    lone, go = most == did[one], met[one]
    least = np.repeat(did[one][:, None], int(count.max()), 1)
    if go.any():
        least[go, : int(count[one[go]].max())] = _least(key[one[go]], did[one[go]], lone[go], count[one[go]], at[one[go]], data, crowded)
    bits = np.zeros(len(order), np.int64)
    for w in range(least.shape[1]):
        bits |= ((w < count) & (least[of, w] < did)).astype(np.int64) << w
    return bits


def _alike(kin: np.ndarray, did: np.ndarray, size: np.ndarray, at: np.ndarray, data: np.ndarray) -> np.ndarray:
    """For each piece the one with the least id of those that the suffix order shows to be equal to it.

    Pieces of one kin, a hash of their bytes, are sorted FOLD at a time; those that are left of each lot meet those of the others.
    """
    root = np.arange(len(kin))
    todo = np.lexsort((did, kin))
    while True:
        heads = np.flatnonzero(np.append(True, kin[todo][1:] != kin[todo][:-1]))
        many = np.diff(np.append(heads, len(todo)))
        rank, many = np.arange(len(todo)) - np.repeat(heads, many), np.repeat(many, many)
        todo, rank, many = todo[many > 1], rank[many > 1], many[many > 1]
        if not len(todo):
            break
        first = rank % FOLD == 0
        busy = ~first | (rank + 1 < many)  # the last lot of a kin may be one piece
        own = todo[busy]
        root[own] = own[_first_equal(np.cumsum(first[busy]), size[own] + LENGTH - 1, at[own], data)]
        left = todo[root[todo] == todo]
        if len(left) == len(todo):
            break
        todo = left
    while (root[root] != root).any():
        root = root[root]
    return root


def _first_equal(group: np.ndarray, length: np.ndarray, at: np.ndarray, data: np.ndarray) -> np.ndarray:
    """For each piece the first of its group (these ascend) that equals it, by the order of their suffixes over letters of four bytes."""
    out = np.arange(len(group))
    letters = (length + 3) // 4 + 1  # with an end
    ends = np.cumsum(letters)
    s = 0
    while s < len(group):
        e = max(s + 1, int(np.searchsorted(ends, (ends[s - 1] if s else 0) + LOT_BYTES, "right")))
        while e < len(group) and group[e] == group[e - 1]:
            e += 1
        own, n = length[s:e], letters[s:e]
        piece, place = _windows(n)
        t = np.zeros(len(piece), np.int64)
        for j in range(4):
            inside = 4 * place + j < own[piece]
            t[inside] |= data[at[s:e][piece[inside]] + 4 * place[inside] + j].astype(np.int64) << (8 * (3 - j))
        t[place < n[piece] - 1] += 1
        problem = np.cumsum(np.append(True, group[s + 1 : e] != group[s : e - 1]))[piece]
        sa = suffix_order(t, problem)
        sa = sa[place[sa] == 0]
        a, b = sa[:-1], sa[1:]
        agree = (problem[a] == problem[b]) & (own[piece[a]] == own[piece[b]])
        for j in range(int(n.max()) - 1):
            both = np.flatnonzero(agree & (j < n[piece[a]] - 1))
            agree[both] = t[a[both] + j] == t[b[both] + j]
        start = np.flatnonzero(np.append(True, ~agree))
        found = s + piece[sa]
        out[found] = np.repeat(np.minimum.reduceat(found, start), np.diff(np.append(start, len(sa))))
        s = e
    return out


def _windows(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For all windows of pieces of the given sizes: the piece and the place in it."""
    piece = np.repeat(np.arange(len(size)), size)
    return piece, np.arange(len(piece)) - np.repeat(np.cumsum(size) - size, size)


def _met(key: np.ndarray, did: np.ndarray, lone: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order by key, where its keys begin, and for each of these whether two documents or more have it."""
    order = np.lexsort((did, key))
    starts = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1]))
    several = np.maximum.reduceat(did[order], starts) > np.minimum.reduceat(did[order], starts)
    return order, starts, several | np.logical_or.reduceat(~lone[order], starts)


def _hash50(data: np.ndarray) -> np.ndarray:
    """A hash of the 50 bytes at each place."""
    p = powers(64)
    h, x = data.astype(_U) + _U(1), {}
    for s in (1, 2, 4, 8, 16):
        x[s] = h
        h = h[:-s] * p[s] + h[s:]
    n = len(data) - LENGTH + 1
    return mix64((h[:n] * p[16] + x[16][32 : 32 + n]) * p[2] + x[2][48 : 48 + n])


def _least(key: np.ndarray, did: np.ndarray, lone: np.ndarray, size: np.ndarray, at: np.ndarray, data: np.ndarray, crowded: int) -> np.ndarray:
    """For each of the pieces, ordered by key, and each of its windows the least id of the key's pieces that hold the window. lone: no other document has the piece."""
    out = np.repeat(did[:, None], int(size.max()), 1)
    # what only one document has at either end of a piece, or in all of it, needs no sorting
    piece, w = _windows(size)
    length = size + LENGTH - 1
    own, inside = _windows(length)
    flat = data[at[own] + inside]
    base = np.cumsum(length) - length
    h = _hash50(flat)[base[piece] + w] ^ mix64(key)[piece]
    order, starts, met = _met(h, did[piece], lone[piece])
    shared = np.empty(len(h), bool)
    shared[order] = np.repeat(met, np.diff(np.append(starts, len(h))))
    if not shared.any():
        return out
    ends = np.cumsum(size)
    before = np.cumsum(shared)
    some = np.flatnonzero(np.add.reduceat(shared.astype(np.int64), ends - size) > 0)
    first = np.searchsorted(before, (before - shared)[ends[some] - size[some]], "right")
    last = np.searchsorted(before, before[ends[some] - 1], "left")
    skip, size = first - (ends - size)[some], last - first + 1
    at, base, group = base[some] + skip, base[some], np.cumsum(np.append(True, key[some][1:] != key[some][:-1])) - 1
    data = flat
    low = np.repeat(did[some][:, None], int(size.max()), 1)
    crowd = np.bincount(group)[group] > crowded
    if crowd.any():
        # each shared window of a crowded key is a key of its own
        p, w = _windows(size[crowd])
        c = np.flatnonzero(crowd)[p]
        go = shared[first[c] + w]
        c, w = c[go], w[go]
        k, ids, one = h[first[c] + w], did[some][c], np.ones(len(c), np.int64)
        root = _alike(k, ids, one, at[c] + w, data)
        top = np.flatnonzero(root == np.arange(len(root)))
        _, of, many = np.unique(k[top], return_inverse=True, return_counts=True)
        if (many > 1).any():  # different windows of one hash
            own = many[of] > 1
            ids[top[own]] = _sorted(of[own], ids[top[own]], one[top[own]], (at[c] + w)[top[own]], data)[:, 0]
        low[c, w] = ids[root]
    group = np.where(crowd, group.max() + 1, group)
    rest = np.flatnonzero(~crowd & (np.bincount(group)[group] > 1))
    if len(rest):
        found = _sorted(group[rest], did[some][rest], size[rest], at[rest], data)
        low[rest, : found.shape[1]] = found
    p, w = _windows(size)
    out[some[p], skip[p] + w] = low[p, w]
    return out


def _sorted(group: np.ndarray, label: np.ndarray, size: np.ndarray, at: np.ndarray, data: np.ndarray) -> np.ndarray:
    """For each piece and window the least label (ids, mostly) of its group's pieces that hold the window, by their suffixes."""
    out = np.repeat(label[:, None], int(size.max()), 1)
    total = np.bincount(group, size + LENGTH)
    todo = np.lexsort((np.arange(len(group)), group, total[group]))  # groups of about the same size together
    ends = np.cumsum(size[todo] + LENGTH)
    s = 0
    while s < len(todo):
        e = max(s + 1, int(np.searchsorted(ends, (ends[s - 1] if s else 0) + LOT_BYTES, "right")))
        while e < len(todo) and group[todo[e]] == group[todo[e - 1]]:
            e += 1
        _by_suffixes(todo[s:e], group, at, size, data, out)
        s = e
    return out


def _by_suffixes(todo, group, at, size, data, out) -> None:
    length = size[todo] + LENGTH  # the bytes of a piece and its end
    first = np.cumsum(length) - length
    n = int(length.sum())
    piece = np.repeat(np.arange(len(todo)), length)
    inside = np.arange(n) - first[piece]
    t = np.zeros(n, np.int64)
    body = inside < length[piece] - 1
    t[body] = data[(at[todo][piece] + inside)[body]].astype(np.int64) + 1
    problem = np.cumsum(np.append(True, group[todo][1:] != group[todo][:-1]))[piece]
    sa = suffix_order(t, problem)
    sa = sa[inside[sa] < size[todo][piece[sa]]]  # windows: suffixes of 50 bytes or more
    x = np.append(t, np.zeros(8, np.int64)).astype(_U)
    w7 = np.zeros(n, _U)  # seven numbers from each place on
    for j in range(7):
        w7 |= (x[j : n + j] & _U(0x1FF)) << _U(9 * j)
    a, b = sa[:-1], sa[1:]
    agree = problem[a] == problem[b]
    for j in (0, 7, 14, 21, 28, 35, 42, 43):
        agree &= w7[a + j] == w7[b + j]
    start = np.flatnonzero(np.append(True, ~agree))
    own, at_window = todo[piece[sa]], inside[sa]
    low = np.minimum.reduceat(out[own, at_window], start)
    out[own, at_window] = np.repeat(low, np.diff(np.append(start, len(sa))))


def _verdicts(pieces: DataFrame, homes: int) -> DataFrame:
    """(did, tid, first, second) of documents with repeated windows: where these start, and masks of windows from there on."""

    def done(bucket, held):
        of = [np.frombuffer(r[2], np.uint32) for r in held]
        did, tid = (np.concatenate([np.frombuffer(r[k], np.int64)[o] for r, o in zip(held, of)]) for k in (0, 1))
        start, count = (np.concatenate([np.frombuffer(r[k], t) for r in held]).astype(np.int64) for k, t in ((3, np.uint32), (4, np.uint8)))
        mask = (np.int64(1) << count) - 1
        if bucket >= 0:
            key, hash_ = (np.concatenate([np.frombuffer(r[k], _U) for r in held]) for k in (5, 6))
            data = np.frombuffer(b"".join(r[7] for r in held), np.uint8)
            held.clear()
            length = count + LENGTH - 1
            at = np.cumsum(length) - length
            order = np.argsort(key, kind="stable")
            edges = np.append(np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1])), len(key))
            s = 0
            while s < len(edges) - 1:  # whole keys, LOT_PIECES pieces or a larger key together
                e = max(s + 1, int(np.searchsorted(edges, edges[s] + LOT_PIECES, "right")) - 1)
                lot = order[edges[s] : edges[e]]
                mask[lot] = _judge(key[lot], did[lot], count[lot], hash_[lot], at[lot], data, CROWD)
                s = e
        some = mask != 0
        yield from _pack_by_document(did[some], tid[some], start[some].astype(np.uint32), mask[some], homes)

    def run(batches):
        bucket, held = None, []
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if held and (row[0] != bucket or bucket < 0):
                    yield from done(bucket, held)
                    held = []
                bucket = row[0]
                held.append(row[1:])
        if held:
            yield from done(bucket, held)

    # what is known already is spread evenly; it needs no company
    spread = F.when(F.col("bucket") < 0, F.xxhash64("starts", "dids")).otherwise(F.col("bucket"))
    return _gathered(in_arrow(pieces.repartition(spread).sortWithinPartitions("bucket"), run, _PACKED), np.uint32, np.int64)


def _covered(n: int, starts: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """Which of n bytes the repeated windows cover."""
    edge = np.zeros(n + 1, np.int32)
    for w in range(int(masks.max()).bit_length() if len(masks) else 0):
        s = starts[masks >> w & 1 == 1] + w
        np.add.at(edge, s, 1)
        np.add.at(edge, s + LENGTH, -1)
    return np.cumsum(edge[:-1]) > 0


_KEPT = "did long, tid long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start: long, end: long>>, kept binary"


def _apply(rows: DataFrame, with_text: bool) -> DataFrame:
    """Removes from rows (did, tid, text, first, second) what their verdicts cover."""

    def run(batches):
        import pyarrow as pa

        names = [x.split()[0] for x in _KEPT.split(", ")[:5]] + ["spans", "kept"]
        for rows, data, offsets in text_chunks(batches):
            out = []
            for d, (starts, masks) in enumerate(zip(rows.column(3).to_pylist(), rows.column(4).to_pylist())):
                own = data[offsets[d] : offsets[d + 1]]
                gone = _covered(len(own), np.frombuffer(starts, np.uint32).astype(np.int64), np.frombuffer(masks, np.int64))
                edge = np.diff(gone.view(np.int8), prepend=np.int8(0), append=np.int8(0))
                spans = [{"start": s, "end": e} for s, e in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist())]
                kept = own[~gone].tobytes()
                out.append((int(gone.sum()), len(spans), hashlib.sha256(kept).hexdigest(), spans, kept if with_text else None))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary())
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), *(pa.array(c, t) for c, t in zip(zip(*out), kinds))], names)

    return in_arrow(rows, run, _KEPT)


def _repeated(docs: DataFrame, with_text: bool) -> tuple[DataFrame, DataFrame]:
    """(every document: did, tid, n_bytes, sha, owner), (what is left of those texts, by owner, that lose something)."""
    spark = docs.sparkSession
    sized = docs.select("did", F.xxhash64("text", F.lit(1)).alias("tid"), F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("sha"))
    base = cut(sized, "dedup-base")
    owners = base.groupBy("sha").agg(F.min("did").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("sha", "first")
    owners = owners.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))  # only texts that occur again, in parts that the copies are dealt to
    salted = base.withColumn("salt", F.pmod(F.xxhash64("did", F.lit(5)), F.lit(SALTS)).cast("int"))
    base = cut(salted.join(owners, ["sha", "salt"], "left").select("did", "tid", "n_bytes", "sha", F.coalesce("first", "did").alias("owner")), "dedup-owned")
    copies = base.filter("did > owner OR n_bytes < 50").select("did", "tid").distinct()
    total = base.filter("did = owner").agg(F.sum("n_bytes")).first()[0] or 0
    tasks, most = int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / LEAST_TEXT)
    buckets = max(1, min(4 * tasks, most), math.ceil(total / BUCKET_TEXT))  # several a task, so that tasks are alike
    homes = max(1, min(tasks, most), math.ceil(total / HOME_TEXT))

    texts = docs.withColumn("tid", F.xxhash64("text", F.lit(1)))
    texts = only(texts, copies, ["did", "tid"], "left_anti")  # one row for each text, but for rows that repeat id and text
    again = cut(base.groupBy("did").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("did"), "dedup-again")
    keys, none = ["did"], F.lit(0).cast("long")
    if again.isEmpty():
        texts = texts.withColumn("tag", none)
    else:
        keys = ["did", "tag"]
        texts = only(texts, again, "did", "left_anti").withColumn("tag", none).unionByName(only(texts, again, "did", "left_semi").withColumn("tag", F.col("tid")))
    hot = hot_keys(texts)
    shared = cut(_shared_anchors(texts, hot, buckets, homes), "dedup-anchors")
    affected = only(texts, shared.select(*keys), keys, "left_semi").join(shared.drop(*({"tag"} - {*keys})), keys)
    verdicts = cut(_verdicts(_cut_pieces(affected.select("did", "tid", "text", "high", "low"), hot, buckets), homes), "dedup-verdicts")
    losing = only(texts, verdicts.select("did", "tid"), ["did", "tid"], "left_semi").join(verdicts, ["did", "tid"])
    return base, _apply(losing.select("did", "tid", "text", "first", "second"), with_text)


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("did"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans) for every document."""
    base, kept = _repeated(_source(docs, id_col, text_col), with_text=False)
    kept = kept.drop("kept").dropDuplicates(["did", "tid"])
    copy = (F.col("did") > F.col("owner")) & (F.col("n_bytes") >= LENGTH)
    # copies lose everything: only the others look for what is left of them
    lacking = [F.lit(None).cast(t).alias(c) for c, t in kept.dtypes if c not in ("did", "tid")]
    out = base.filter(~copy).join(kept, ["did", "tid"], "left").select(*base.columns, *kept.columns[2:]).unionByName(base.filter(copy).select(*base.columns, *lacking))
    pick = lambda whole, name, none: F.when(copy, whole).otherwise(F.coalesce(F.col(name), none))
    zero, spans = F.lit(0).cast("long"), "array<struct<start: long, end: long>>"
    return out.select(
        F.when(F.col("did") != _LAST, F.col("did")).alias("doc_id"), "n_bytes",
        pick(F.col("n_bytes"), "n_removed", zero).alias("n_removed"), pick(F.lit(1).cast("long"), "n_spans", zero).alias("n_spans"),
        pick(F.lit(hashlib.sha256(b"").hexdigest()), "kept_sha256", F.col("sha")).alias("kept_sha256"),
        pick(F.array(F.struct(zero.alias("start"), F.col("n_bytes").alias("end"))), "spans", F.array().cast(spans)).alias("spans"),
    )


def remove_repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """docs with the repeated bytes cut out of their texts (a character that loses a byte goes entirely); chars_col, if there, is counted anew."""
    key, tid, left = fresh(docs, "_did", "_tid", "_left")
    base, kept = _repeated(_source(docs, id_col, text_col), with_text=True)
    kept = cut(kept.select(F.col("did").alias(key), F.col("tid").alias(tid), "kept").dropDuplicates([key, tid]), "dedup-kept")
    gone = cut(base.filter(f"did > owner AND n_bytes >= {LENGTH}").select(F.col("did").alias(key), F.col("tid").alias(tid)).distinct(), "dedup-gone")
    rows = docs.withColumns({key: F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)), tid: F.xxhash64(F.coalesce(F.col(text_col), F.lit("")), F.lit(1))})
    changed = kept.withColumnRenamed("kept", left)
    changed = changed.unionByName(gone.withColumn(left, F.lit(b"").cast("binary")))
    names = changed.select(key, tid).distinct()
    same = only(rows, names, [key, tid], "left_anti").select(*docs.columns)
    other = only(rows, names, [key, tid], "left_semi").drop(text_col).join(changed, [key, tid])
    whole = F.pandas_udf(lambda x: x.map(lambda b: bytes(b).decode("utf-8", "ignore")), "string")
    other = other.withColumn(text_col, whole(left))
    if chars_col and chars_col in docs.columns:
        other = other.withColumn(chars_col, F.length(text_col).cast(dict(docs.dtypes)[chars_col]))
    return same.unionByName(other.select(*docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(table(spark, sf_dir, "documents")).drop("spans")

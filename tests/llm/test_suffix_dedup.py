import hashlib
import random

import numpy as np
import pytest

from driftlab.llm import suffix_dedup as S

DOCS = "doc_id long, text string, lang string, n_chars long, tid string, kept int"


def brute(rows):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        i = S._LAST if i is None else i
        for k in range(len(b) - 49):
            w = b[k : k + 50]
            first[w] = min(first.get(w, i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        i = S._LAST if i is None else i
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < i:
                gone[k : k + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed, n=120):
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdeé", k=r.randint(1, 7)))
    prose = lambda k: " ".join(word() for _ in range(k))
    lines = ["a short common line, often", "a common line that is just under fifty bytes.", "x" * 49, "a line of exactly fifty bytes in all, count them.."]
    passages = [prose(r.randint(8, 80)) for _ in range(12)]
    base = prose(150)
    rows, ids = [], r.sample(range(10_000), n)
    for i in ids:
        parts = []
        for _ in range(r.randint(0, 6)):
            k = r.random()
            parts.append(prose(r.randint(1, 40)) if k < 0.4 else r.choice(lines) if k < 0.65 else r.choice(passages)[r.randint(0, 5) :] if k < 0.9 else r.choice(("ab" * 60, "z" * 130, "")))
        rows.append((i, r.choice(("\n", " ", "")).join(parts)))
    for i in ids[:30]:
        w = base.split()
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = word()
        rows.append((i + 20_000, " ".join(w)))
    rows += [(50_000, rows[3][1]), (rows[5][0], rows[5][1]), (rows[6][0], rows[7][1]), (None, base), (None, base + " more"), (None, None), (60_000, ""), (60_001, None), (60_002, "é" * 25), (60_003, "é" * 24 + "a"), (60_004, "é" * 25)]
    r.shuffle(rows)
    return rows


def frame(spark, rows, parts=4):
    return spark.createDataFrame([(i, t, "xx", len(t or ""), "t", 1) for i, t in rows], DOCS).repartition(parts)


def result(df):
    return sorted((S._LAST if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())


@pytest.mark.parametrize("hot,crowd,block", [(8, 64, 16 << 20), (10**9, 64, 16 << 20), (10**9, 10**9, 3_000), (10**9, 1, 16 << 20), (1, 64, 2_000)])
def test_matches_brute_force(spark, monkeypatch, hot, crowd, block):
    monkeypatch.setattr(S, "HOT", hot)
    monkeypatch.setattr(S, "CROWD", crowd)
    monkeypatch.setattr(S, "BLOCK_TEXT", block)
    rows = corpus(hot % 7 + crowd % 5)
    assert result(S.deduplicate(frame(spark, rows))) == sorted(brute(rows))


@pytest.mark.parametrize("hot,crowd", [(False, 64), (True, 64), (False, 2)])
def test_repetitions_are_found_by_suffix_order(monkeypatch, hot, crowd):
    """Every removed window was in a group of the suffix order with windows of other pieces, the least id's among them; nothing is sorted alone."""
    rows = [(i, t) for i, t in corpus(3) if t]
    paired, sort = set(), S._by_suffixes

    def watched(todo, group, at, size, data, out):
        met = {}
        for k in todo.tolist():
            for w in range(int(size[k])):
                met.setdefault((int(group[k]), data[at[k] + w : at[k] + w + 50].tobytes()), set()).add(k)
        sort(todo, group, at, size, data, out)
        assert np.unique(group[todo], return_counts=True)[1].min() > 1
        paired.update(x for (_, x), pieces in met.items() if len(pieces) > 1)

    def watched_whole(group, length, at, data):
        met = {}
        for k in range(len(group)):
            met.setdefault((int(group[k]), data[at[k] : at[k] + length[k]].tobytes()), []).append(k)
        out = whole(group, length, at, data)
        assert out.tolist() == [met[int(group[k]), data[at[k] : at[k] + length[k]].tobytes()][0] for k in range(len(group))]
        assert np.unique(group, return_counts=True)[1].min() > 1
        for (_, x), pieces in met.items():
            if len(pieces) > 1:
                paired.update(x[w : w + 50] for w in range(len(x) - 49))
        return out

    whole = S._first_equal
    monkeypatch.setattr(S, "_by_suffixes", watched)
    monkeypatch.setattr(S, "_first_equal", watched_whole)
    cols = [[] for _ in range(6)]
    texts, base = [], 0
    for i, t in rows:
        data = np.frombuffer(t.encode(), np.uint8)
        runs = S._anchors(data, np.array([0, len(data)]))
        a = S._runs(data, np.array([0, len(data)]), np.unique(runs["key"]) if hot else np.zeros(0, np.uint64))
        did = np.full(len(a["key"]), S._LAST if i is None else i)
        for c, x in zip(cols, (a["key"], did, a["count"], S._content(a["h50"], a["start"], a["count"]), a["start"] + base, a["start"])):
            c.append(x)
        texts.append(data)
        base += len(data)
    key, did, count, hash_, at, start = (np.concatenate(c) for c in cols)
    data = np.concatenate(texts)
    bits = S._judge(key, did, count, hash_, at, data, crowd)
    least = {}
    for d, n, p in zip(did.tolist(), count.tolist(), at.tolist()):
        for w in range(n):
            x = data[p + w : p + w + 50].tobytes()
            least[x] = min(least.get(x, d), d)
    removed = 0
    for d, n, p, b in zip(did.tolist(), count.tolist(), at.tolist(), bits.tolist()):
        for w in range(n):
            x = data[p + w : p + w + 50].tobytes()
            assert (b >> w & 1) == (least[x] < d)
            if b >> w & 1:
                removed += 1
                assert x in paired
    assert removed > 1_000


@pytest.mark.parametrize("alike", [False, True])
def test_equal_pieces_are_told_by_suffix_order_whatever_their_hashes(alike):
    """alike: all hashes are the same, so that only the order can tell pieces apart."""
    r = random.Random(8)
    texts = ["".join(r.choices("ab", k=r.choice((50, 50, 51, 60, 84)))).encode() for _ in range(6)] + [b"a" * 60, b"ab" * 30]
    pieces = [(r.randint(0, 9), r.choice(texts)) for _ in range(90)]
    data = np.frombuffer(b"".join(t for _, t in pieces), np.uint8)
    at = np.cumsum([0] + [len(t) for _, t in pieces])[:-1]
    did, count = np.array([d for d, _ in pieces]), np.array([len(t) - 49 for _, t in pieces])
    hash_ = np.array([0 if alike else texts.index(t) for _, t in pieces]).astype(np.uint64)
    known = S._repeat_in_block(did, count, hash_, at, data)
    for (d, t), k in zip(pieces, known.tolist()):
        truth = min(x for x, y in pieces if t in y) < d
        assert truth >= k and (alike or k == (min(x for x, y in pieces if y == t) < d))
    for crowd in (64, 1):
        bits = S._judge(np.zeros(90, np.uint64), did, count, hash_, at, data, crowd)
        for (d, t), b in zip(pieces, bits.tolist()):
            for w in range(len(t) - 49):
                assert (b >> w & 1) == (min(x for x, y in pieces if t[w : w + 50] in y) < d)


def test_copies_that_go_on_from_each_other_are_one_run(spark, monkeypatch):
    monkeypatch.setattr(S, "RUN", 40)
    rows = corpus(13)
    assert result(S.deduplicate(frame(spark, rows, 1))) == sorted(brute(rows))


def test_long_documents_are_looked_at_in_parts(spark, monkeypatch):
    monkeypatch.setattr(S, "PIECE", 300)
    rows = corpus(11, 60) + [(70_000, " ".join(t or "" for _, t in corpus(11, 60)))]
    assert result(S.deduplicate(frame(spark, rows, 1))) == sorted(brute(rows))


def test_texts_after_removal(spark):
    rows = corpus(5, 60)
    docs = frame(spark, rows)
    out = S.remove_repeated(docs)
    assert out.columns == docs.columns and out.schema == docs.schema
    got = sorted(((S._LAST if r.doc_id is None else r.doc_id), r.text or "", r.n_chars) for r in out.collect())
    want = []
    first = {}
    for i, t in rows:
        b, i = (t or "").encode(), S._LAST if i is None else i
        for k in range(len(b) - 49):
            first[b[k : k + 50]] = min(first.get(b[k : k + 50], i), i)
    for i, t in rows:
        b, i = (t or "").encode(), S._LAST if i is None else i
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < i:
                gone[k : k + 50] = b"\1" * 50
        text = bytes(x for x, g in zip(b, gone) if not g).decode("utf-8", "ignore")
        want.append((i, text, len(text)))
    assert got == sorted(want)


def test_empty(spark):
    docs = frame(spark, [])
    assert S.deduplicate(docs).count() == 0 and S.remove_repeated(docs).count() == 0
    some = frame(spark, [(1, None), (2, "")])
    assert result(S.deduplicate(some)) == sorted(brute([(1, None), (2, "")]))


def test_rows_without_an_id_take_linear_work(spark, monkeypatch):
    """Half of all rows share the null id: what comes back to rows grows as these do, and so does the number of their homes."""
    monkeypatch.setattr(S, "LEAST_TEXT", 1 << 14)
    r, sizes = random.Random(4), []
    base = [" ".join("".join(r.choices("abcdefgh", k=5)) for _ in range(60)) for _ in range(3)]
    seen = []
    gathered = S._gathered

    def spy(packed, *args, **kw):
        out = S.cut(gathered(packed, *args, **kw), "spied")
        seen.append((out, packed.select("home").distinct().count()))
        return out

    monkeypatch.setattr(S, "_gathered", spy)
    for n in (200, 400):
        rows = [(None if i % 2 else i, f"{r.choice(base)[r.randint(0, 9) :]} {i} {r.choice(base)[: r.randint(60, 200)]}") for i in range(n)]
        rows += [(None, rows[1][1])] * 20 + [(4, rows[2][1]), (4, rows[2][1] + "!")]
        seen.clear()
        assert result(S.deduplicate(frame(spark, rows))) == sorted(brute(rows))
        anchors, homes = seen[0]
        sizes.append(sum(len(x.first) + len(x.second) for x in anchors.collect()))
        assert homes > 1 and seen[1][1] > 1
    assert sizes[1] < 2.4 * sizes[0]

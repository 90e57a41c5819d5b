import random

import numpy as np
import pytest

from driftlab.llm import jaccard as J
from driftlab.llm.common import word_hashes

DOCS = "doc_id long, text string, n int, set_id string, class_id int"


def brute(rows, threshold=0.8):
    """class_id, n_links and n_copies of rows (id, text), by all pairs of sets."""
    sets, of = {}, []
    for i, t in rows:
        w = (t or "").lower().split()
        s = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else None
        of.append(s)
        if s is not None:
            sets.setdefault(s, []).append(i)
    names = list(sets)
    root, links = {s: s for s in names}, dict.fromkeys(names, 0)

    def top(s):
        while root[s] is not s:
            s = root[s]
        return s

    for k, a in enumerate(names):
        for b in names[:k]:
            if len(a & b) >= threshold * len(a | b) - 1e-9:
                links[a] += 1
                links[b] += 1
                root[top(a)] = top(b)
    least = {}
    for s, ids in sets.items():
        least.setdefault(top(s), []).extend(ids)
    first = lambda ids: min((i for i in ids if i is not None), default=None)
    return [(i, first(least[top(s)]) if s is not None else i, links[s] if s is not None else 0, len(sets[s]) - 1 if s is not None else 0) for (i, _), s in zip(rows, of)]


def corpus(seed, groups=60, hot=120):
    r = random.Random(seed)
    vocab = ["w%d" % i for i in range(800)]
    rows, k = [], 1
    line = " ".join(r.choices(vocab, k=12))

    def edit(w, n):
        w = w[:]
        for _ in range(n):
            w[r.randrange(len(w))] = r.choice(vocab)
        return w

    for g in range(groups):
        base = r.choices(vocab, k=r.choice((3, 8, 40, 90, 200)))
        for _ in range(r.choice((1, 1, 2, 3, 6))):
            rows.append((k, " ".join(edit(base, r.choice((0, 0, 1, 2, 4)))) + (" " + line if r.random() < 0.5 else "")))
            k += 1
    base = r.choices(vocab, k=120)
    for _ in range(hot):
        rows.append((k, " ".join(edit(base, r.choice((0, 1, 2))))))
        k += 1
    rows += [(k, None), (k + 1, ""), (None, ""), (None, rows[0][1]), (rows[1][0], rows[1][1]), (k + 2, "ONE two"), (k + 3, "one   Two"), (None, "null id alone in its class here"), (rows[2][0], "the same id with another text altogether"), (k + 4, " ".join(r.choices(vocab, k=30_000)))]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("limit,tile", [(256, 4096), (8, 16)])
def test_matches_all_pairs(spark, monkeypatch, limit, tile):
    monkeypatch.setattr(J, "LIMIT", limit)
    monkeypatch.setattr(J, "TILE_SETS", tile)
    rows = corpus(7)
    docs = spark.createDataFrame([(*x, 1, "s", 2) for x in rows], DOCS).repartition(5)
    got = sorted(map(str, (tuple(r) for r in J.join_similar(docs).select("doc_id", "class_id", "n_links", "n_copies").collect())))
    want = sorted(map(str, brute(rows)))
    missed = len(set(want) - set(got))
    assert len(got) == len(want)
    if limit == 256:
        assert missed == 0
    else:  # three levels deep, each link is found with the recall aimed at
        links = lambda x: sum(int(y.split(", ")[2]) for y in x)
        assert links(want) >= links(got) >= 0.99 * links(want)


def test_survival_and_runs():
    rng = np.random.default_rng(0)
    met, n = 0, 4000
    for k in range(n):
        shared, a, b = rng.integers(0, 1 << 63, 800).astype(np.uint64), rng.integers(0, 1 << 63, 100).astype(np.uint64), rng.integers(0, 1 << 63, 100).astype(np.uint64)
        x, y = np.concatenate([shared, a]), np.concatenate([shared, b])
        node = np.uint64(k + 1)
        met += bool(len(np.intersect1d(J.choose(x, node, 0.8), J.choose(y, node, 0.8))))
    # Jaccard 0.8, so an overlap of 8/9 of either set
    assert met / n == pytest.approx(1 - np.exp(-800 / (0.8 * 900)), abs=0.03)
    assert J.runs_for() == 15 and (1 - J.survival(0.8, 3)) ** 15 < 1e-3


def test_one_of_each_class_stays(spark):
    rows = corpus(3, groups=30, hot=20)
    docs = spark.createDataFrame([(*x, 1, "s", 2) for x in rows], DOCS)
    kept = [(r.doc_id, r.text) for r in J.keep_one(docs).collect()]
    assert J.keep_one(docs).columns == docs.columns
    want = brute(rows)
    classes = {}
    for (i, t), (_, c, *_) in zip(rows, want):
        classes.setdefault((c, t if not (t or "").split() else None), []).append((i, t))
    worded = [x for x in kept if (x[1] or "").split()]
    by_class = {}
    lookup = {x: w[1] for x, w in zip(rows, want)}
    for x in worded:
        by_class.setdefault(lookup[x], []).append(x)
    assert all(len(v) == 1 and (v[0][0] == c) for c, v in by_class.items())
    assert set(by_class) == {w[1] for x, w in zip(rows, want) if (x[1] or "").split()}
    assert len(kept) - len(worded) == sum(not (t or "").split() for _, t in rows)


def test_empty(spark):
    docs = spark.createDataFrame([], DOCS)
    assert J.join_similar(docs).count() == 0 and J.keep_one(docs).count() == 0
    assert word_hashes("a b").size == 2


def test_repeated_ids_of_texts_with_odd_capitals_stay(spark):
    """Rows of a repeated id are told apart by their sets: those of U+0130 and a final sigma are lowered as elsewhere."""
    texts = [f"{odd} " + " ".join(f"{odd}{i}" for i in range(12)) for odd in ("İ", "ΑΣ", "plain")]
    other = "ΒΣ " + " ".join(f"İ{i}ΒΣ" for i in range(12))
    rows = [(i, t) for i, t in zip((1, 2, 3, None), (*texts, other)) for _ in range(2)]
    docs = spark.createDataFrame([(*x, 1, "s", 2) for x in rows], DOCS)
    assert sorted((r.doc_id or 0, r.text) for r in J.keep_one(docs).collect()) == sorted({(i or 0, t) for i, t in rows})

import random
from collections import Counter

import numpy as np
import pytest

from driftlab.llm import decontaminate as D

DOCS = "doc_id long, text string, hits string, similarity string"
R = random.Random(5)
VOCAB = ["".join(R.choices("abcdefgh", k=R.randint(2, 7))) for _ in range(400)]


def brute(text, items):
    """Every window of every item's size, by the exact similarity alone."""
    words = (text or "").lower().split()
    out = {}
    for i, t in items:
        w = (t or "").lower().split()
        if len(w) < D.K or len(words) < D.K:
            continue
        own = Counter(tuple(w[j : j + D.K]) for j in range(len(w) - D.K + 1))
        n = min(len(w), len(words))
        for s in range(len(words) - n + 1):
            win = Counter(tuple(words[s + j : s + j + D.K]) for j in range(n - D.K + 1))
            weigh = lambda c: sum(k * sum(len(x) for x in sh) for sh, k in c.items())
            sim = weigh(own & win) / weigh(own | win)
            if sim >= D.THRESHOLD and (i not in out or sim > out[i][0] + 1e-12):
                out[i] = (sim, s, s + n)
    return out


def words(n):
    return R.choices(VOCAB, k=n)


@pytest.fixture(scope="module")
def case(spark):
    items = [(i, " ".join(words(R.randint(15, 60)))) for i in range(40)]
    items += [(40, None), (41, "too short here"), (None, "one two three four five six"), (3, items[3][1]), (42, "a a a a a a a a")]
    texts = [None, "", "a b", items[0][1].upper()]
    for _ in range(150):
        t = words(R.randint(0, 120))
        if R.random() < 0.7:
            w = items[R.randrange(40)][1].split()
            if R.random() < 0.6:
                for _ in range(R.randint(1, 3)):
                    k = R.randrange(len(w))
                    w[k : k + 1] = R.choice([[], ["zz"], [w[k], "yy"]])
            t[len(t) // 2 : len(t) // 2] = w
        texts.append(" ".join(t))
    texts.append(" ".join(words(30_000) + items[7][1].split()))
    rows = [(i if i else None, t, "x", None) for i, t in enumerate(texts)] + [(3, texts[3], "x", "y")]
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, "item_id long, text string"), rows, [x for x in items if x[0] is not None]


def test_matches_brute_force(case):
    docs, bench, rows, items = case
    got = D.find_contamination(docs, bench).collect()
    assert len(got) == len(rows)
    found = 0
    for x in got:
        text = next(r[1] for r in rows if r[0] == x.doc_id)
        if text and len(text) > 50_000:
            assert x.item_ids == [7]
            continue
        want = brute(text, items)
        assert x.item_ids == sorted(want) and x.contaminated == bool(want)
        for h in x.hits:
            assert (h.similarity, h.start_word, h.end_word) == (pytest.approx(want[h.item_id][0]), *want[h.item_id][1:])
        found += len(want)
    assert found > 40


def test_blocks_of_items_find_the_same(case):
    docs, bench, *_ = case
    a = D.find_contamination(docs, bench).select("doc_id", "item_ids", "similarity").collect()
    b = D.find_contamination(docs, bench, block_bytes=2_000).select("doc_id", "item_ids", "similarity").collect()
    assert Counter(map(str, a)) == Counter(map(str, b))
    assert D.count_blocks(bench, 2_000) > D.BLOCKS_AT_ONCE
    assert D.remove_contaminated(docs, bench, block_bytes=2_000).count() == D.remove_contaminated(docs, bench).count()


def test_filter_and_empty_tables(case):
    docs, bench, *_ = case
    bad = D.find_contamination(docs, bench).filter("contaminated").count()
    kept = D.remove_contaminated(docs, bench)
    assert kept.columns == docs.columns and kept.count() == docs.count() - bad
    assert D.find_contamination(docs, bench.limit(0)).filter("contaminated").count() == 0
    assert D.find_contamination(docs.limit(0), bench).count() == 0


def test_index_finds_all_within_radius():
    rng = np.random.default_rng(1)
    it = D.Items([(i, " ".join(words(20))) for i in range(300)])
    probes = it.prints[rng.integers(0, len(it.prints), 500)]
    for _ in range(20):
        probes = probes ^ (np.uint64(1) << rng.integers(0, 64, 500).astype(np.uint64))
    w, i = it.within(20, probes, 23)
    want = np.argwhere(np.bitwise_count(probes[:, None] ^ it.prints[None, :]) <= 23)
    assert sorted(zip(w.tolist(), i.tolist())) == sorted(map(tuple, want.tolist()))


@pytest.mark.parametrize("odd", ["İstanbul", "ΛΟΓΟΣ"])
def test_items_and_documents_are_lowered_alike(spark, odd):
    """U+0130 and a final capital sigma have other lower cases in Python than in Arrow."""
    item = " ".join([f"w{i}" for i in range(10)] + [odd] + [f"v{i}" for i in range(9)])
    docs = spark.createDataFrame([(1, item, "", ""), (2, "x " + item.upper() + " y", "", "")], DOCS)
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    got = {r.doc_id: r for r in D.find_contamination(docs, bench).collect()}
    assert (got[1].item_ids, got[1].similarity) == ([7], 1.0) and got[2].contaminated
    assert D.remove_contaminated(docs, bench).count() == 0


def test_short_items_are_found_as_runs_of_words(spark):
    items = [(1, "Alpha"), (2, "beta gamma"), (3, "one two three four"), (4, "beta gamma"), (5, "?!"), (6, "five words make one shingle")]
    docs = [(1, "so alpha, then Beta-gamma"), (2, "alphabet beta x gamma"), (3, "one two three"), (4, "ONE two three four five"), (5, "alpha"), (6, None), (7, "gamma"), (8, "x five words make one shingle"), (9, "gamma beta")]
    got = {r.doc_id: (r.item_ids, [(h.item_id, h.start_word, h.end_word, h.similarity) for h in r.hits]) for r in D.find_contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert {k: v[0] for k, v in got.items()} == {1: [1, 2, 4], 2: [], 3: [], 4: [3], 5: [1], 6: [], 7: [], 8: [6], 9: []}
    assert got[1][1] == [(1, 1, 2, 1.0), (2, 3, 5, 1.0), (4, 3, 5, 1.0)] and got[4][1] == [(3, 0, 4, 1.0)]

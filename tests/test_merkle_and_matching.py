import hashlib
import random
import re

import pytest

from driftlab.operators import matching as W
from driftlab.operators import merkle as K
from driftlab.plans import fits

ROWS = "path string, label int"
COLUMNS = ["path", "label"]


def brute_diff(a, b):
    of = lambda rows: {p: sorted(str(x) for q, x in rows if q == p) for p, _ in rows}
    x, y = of(a), of(b)
    return sorted((str(p), "added" if p not in x else "lost" if p not in y else "changed") for p in x.keys() | y.keys() if x.get(p) != y.get(p))


@pytest.mark.parametrize("leaf", [4, 256])
def test_diff_names_exactly_what_differs(spark, monkeypatch, leaf):
    monkeypatch.setattr(K, "LEAF_ROWS", leaf)
    r = random.Random(1)
    a = [(f"d/{i}.jpg", r.randrange(2)) for i in range(300)] + [(None, 1), (None, 0), ("twice", 1), ("twice", 1)]
    b = [(p, 1 - x if i % 50 == 7 else x) for i, (p, x) in enumerate(a) if i % 40 != 3] + [(f"new/{i}", None) for i in range(5)] + [("twice", 1)]
    df = lambda rows: spark.createDataFrame(rows, ROWS).repartition(3)
    got = sorted((str(x.path), x.kind) for x in K.diff(df(a), df(b), "path", COLUMNS).collect())
    assert got == brute_diff(a, b) and {k for _, k in got} == {"added", "lost", "changed"}
    assert K.diff(df(a), df(a[::-1]), "path", COLUMNS).count() == 0
    assert K.root(K.tree(df(a), "path", COLUMNS)) == K.root(K.tree(df(a[::-1]).coalesce(1), "path", COLUMNS)) != K.root(K.tree(df(b), "path", COLUMNS))


def test_empty_manifests(spark):
    none, one = spark.createDataFrame([], ROWS), spark.createDataFrame([("a", 1)], ROWS)
    assert K.root(K.tree(none, "path", COLUMNS)) is None and K.diff(none, none, "path", COLUMNS).count() == 0
    assert [tuple(r) for r in K.diff(none, one, "path", COLUMNS).collect()] == [("a", "added")] and [tuple(r) for r in K.diff(one, none, "path", COLUMNS).collect()] == [("a", "lost")]


def test_tree_follows_the_count_and_rows_stay_small(spark, monkeypatch):
    monkeypatch.setattr(K, "LEAF_ROWS", 4)
    rows = [(f"{i}", 0) for i in range(500)] + [("hot", i) for i in range(700)]  # one path holds most rows
    nodes = K.tree(spark.createDataFrame(rows, ROWS), "path", COLUMNS).collect()
    depth = max(n.level for n in nodes)
    assert depth == K.depth_of(1200) == 3 and all(len(n.hash) == 40 for n in nodes)
    for level in range(depth):  # a node is made of its children, in order
        for n in (x for x in nodes if x.level == level):
            below = sorted((x.node, x.hash) for x in nodes if x.level == level + 1 and x.node.startswith(n.node))
            assert len(below) <= 16 and n.hash == hashlib.sha1(",".join(f"{a}:{b}" for a, b in below).encode()).hexdigest()
    assert {n.n for n in nodes if n.level == 0} == {1200}


def test_views_of_a_stem_must_agree(spark):
    rows = [("s", v, p) for v in ("clean", "blur") for p in "abc"] + [("t", "clean", "a"), ("t", "blur", "a"), ("t", "jpeg", "b")]
    df = spark.createDataFrame(rows, "stem string, view string, path string")
    assert sorted(map(tuple, K.stem_agreement(df).collect())) == [("s", 2, 1, []), ("t", 3, 2, ["jpeg"])]
    K.require_agreement(df.filter("stem = 's'"))
    with pytest.raises(ValueError, match=r"t \(jpeg\)"):
        K.require_agreement(df)


def test_weights_make_classes_alike_within_strata(spark):
    r = random.Random(2)
    rows = [(i, r.choices([0, 1, None], (6, 3, 1))[0], r.choice([1, 2, None]), r.choice("abc"), r.random()) for i in range(300)]
    rows += [(900, 1, 7, "only", 0.5), (901, 0, 8, "only", 0.5)]
    df = spark.createDataFrame(rows, "id int, y int, size int, shape string, v double")
    got = {x.id: x.weight for x in W.weigh(df, ["size", "shape"]).collect()}
    assert len(got) == len(rows)
    strata = {}
    for i, y, a, b, _ in rows:
        strata.setdefault((a, b), []).append((i, y))
    both = {k: own for k, own in strata.items() if {0, 1} <= {y for _, y in own}}
    pos, neg = (sum(y == c for own in both.values() for _, y in own) for c in (1, 0))
    for k, own in strata.items():
        p, n = (sum(y == c for _, y in own) for c in (1, 0))
        for i, y in own:
            want = 0.0 if k not in both or y is None else 1.0 if y == 1 else p / n * neg / pos
            assert got[i] == pytest.approx(want)
    assert {(x.size, x["shape"]) for x in W.strata_of(df, ["size", "shape"]).filter("NOT matched").collect()} == strata.keys() - both.keys()
    # a probe's AUC with these weights, pair by pair
    p = W.probe_auc(W.weigh(df, ["size", "shape"]), ["v"]).first()
    a, b = ([(x[4], got[x[0]]) for x in rows if x[1] == c] for c in (1, 0))
    pairs = [(u * w, (x > z) + (x == z) / 2) for x, u in a for z, w in b]
    assert p.auc_after == pytest.approx(sum(w * s for w, s in pairs) / sum(w for w, _ in pairs), abs=1e-6)
    assert p.auc_before == pytest.approx(sum(s for _, s in pairs) / len(pairs), abs=1e-6)


def test_without_rows_or_a_class(spark):
    kind = "y int, size int, v double"
    assert W.weigh(spark.createDataFrame([], kind), ["size"]).count() == 0
    assert [x.weight for x in W.weigh(spark.createDataFrame([(1, 1, 0.5)], kind), ["size"]).collect()] == [0.0]


def test_probes_read_the_texts_once(spark, tmp_path):
    texts = ["A b, c!", "ÄÖ é 12  3 ", "  ", "x", "", None, "\U0001f600a\n.E", "aeiou AEIOU.,;:!?0123456789"]
    spark.createDataFrame([(i, t, "de") for i, t in enumerate(texts)], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2) for i in range(len(texts))], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    out = fits._probes(spark, str(tmp_path))
    assert not any("documents.parquet" in f for f in out.inputFiles())
    got = {r.doc_id: r for r in out.collect()}
    assert sorted(got) == [i for i, t in enumerate(texts) if t]
    for i, r in got.items():
        t = texts[i]
        assert (r.size, r["shape"]) == (len(bin(len(t))) - 2, 20 * len(t.split(" ")) // len(t))
        for k, c in fits._PROBES.items():
            assert r[k] == len(re.sub(c, "", t)) / len(t)

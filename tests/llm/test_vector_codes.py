import hashlib
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from driftlab.llm import vector_codes as V

SCHEMA = "vec_id long, embedding array<float>, label string, code int, ERROR string"


def brute(rows, parts=4, entries=3, scale=256, rounds=2):
    """(codes, errors, books) by the plain rule; rows: (vec_id, vector, label) that are kept."""
    x = [[math.floor(scale * float(np.float32(c))) for c in v] for _, v, _ in rows]
    d = len(x[0]) // parts
    cut = lambda v, p: v[p * d : (p + 1) * d]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, x[i]))
    books = [[list(cut(x[i], p)) for i in order[:entries]] for p in range(parts)]
    far = lambda a, b: sum((i - j) ** 2 for i, j in zip(a, b))
    near = lambda v, p: min((far(cut(v, p), e), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        for p in range(parts):
            at = [near(v, p)[1] for v in x]
            for k in range(len(books[p])):
                own = [cut(v, p) for v, a in zip(x, at) if a == k]
                if own:
                    books[p][k] = [sum(c) // len(own) for c in zip(*own)]
    codes = ["".join(f"{near(v, p)[1]:02x}" for p in range(parts)) for v in x]
    return codes, [sum(near(v, p)[0] for p in range(parts)) for v in x], books


def made(n=60, d=8, seed=1):
    r = random.Random(seed)
    rows = [(r.randrange(n), [r.choice([-0.5, -0.25, 0.1, 0.7, r.uniform(-1, 1)]) for _ in range(d)], r.choice(["a", "b", None])) for _ in range(n)]
    return rows + [rows[0], rows[0], (rows[1][0], rows[2][1], "a"), (None, rows[3][1], None)]  # repeated rows, ids that tie, no id


def test_equals_brute_force(spark):
    rows = made()
    odd = [(1, None, "a"), (2, [0.1] * 7 + [None], "a"), (3, [float("nan")] * 8, "a"), (-9, [float("inf")] * 8, "b")]
    ragged = [(-5, [1.0] * 4, "a"), (-6, [], "b"), (-7, [1e30] * 8, None), (-8, [0.0] * 7, "a")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows + odd + ragged], SCHEMA).repartition(5)
    books = V.train(df, parts=4, entries=3)
    codes, errors, want = brute(rows)
    assert books.tolist() == want
    out = V.with_label_error(V.encode(df.drop("code", "ERROR"), books, ["vec_id", "label"])).collect()
    labels = {}
    for r, e in zip(rows, errors):
        labels[r[2]] = labels.get(r[2], 0) + e
    expect = [(r[0], c, e, labels[r[2]]) for r, c, e in zip(rows, codes, errors)] + [(i, None, None, labels[lab]) for i, _, lab in ragged]
    key = lambda r: str(tuple(r))
    assert sorted(map(key, expect)) == sorted(key((r.vec_id, r.code, r.error, r.label_error)) for r in out)
    assert V.books_sha256(books) == hashlib.sha256(",".join(str(c) for b in want for e in b for c in e).encode()).hexdigest()


def test_labels_beyond_a_broadcast(spark, monkeypatch):
    coded = spark.createDataFrame([(i, None if i % 3 == 0 else i, i) for i in range(40)], "vec_id int, label int, error long")
    want = sorted(map(tuple, V.with_label_error(coded).collect()), key=str)
    monkeypatch.setattr(V, "BROADCAST_LABELS", 2)
    assert sorted(map(tuple, V.with_label_error(coded).collect()), key=str) == want


def test_decoding_gives_the_entries(spark):
    rows = made(20)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    books = V.train(df, parts=4, entries=3)
    out = V.decode(V.encode(df, books, ["vec_id"]), books).collect()
    for r in out:
        assert r.approx == [float(c) / 256 for p in range(4) for c in books[p][int(r.code[2 * p : 2 * p + 2], 16)]]


@pytest.mark.parametrize("rows", [[], [(1, None, "a")], [(1, [float("nan")] * 4, "a")]])
def test_nothing_kept(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    books = V.train(df, parts=4)
    assert books.shape[1] == 0 and V.with_label_error(V.encode(df, books, ["vec_id", "label"])).count() == 0
    assert V.books_sha256(books) == hashlib.sha256(b"").hexdigest()


def test_only_vectors_of_no_use(spark):
    df = spark.createDataFrame([(1, [], "a", 1, "x"), (2, [0.5], "a", 1, "x")], SCHEMA)
    out = V.encode(df, V.train(df, parts=4), ["vec_id", "label"])
    assert sorted((r.vec_id, r.code, r.error) for r in out.collect()) == [(1, None, None), (2, None, None)]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 40), st.integers(1, 5), st.sampled_from([2, 9, 300, 10**6]))
def test_va_file_is_exact_and_prunes(seed, k, d, spread):
    r = np.random.default_rng(seed)
    entries, queries = r.integers(-spread, spread, (k, d)), r.integers(-spread, spread, (50, d))
    f = V.VAFile(entries)
    far = ((queries[:, None] - entries[None]) ** 2).sum(axis=2)
    best, error = f.nearest(queries)
    assert (best == far.argmin(axis=1)).all() and (error == far.min(axis=1)).all()
    assert f.candidates(queries)[best, np.arange(50)].all()


def test_va_file_leaves_few_to_refine():
    r = np.random.default_rng(5)
    entries, queries = r.normal(0, 100, (64, 4)).astype(int), r.normal(0, 100, (500, 4)).astype(int)
    assert V.VAFile(entries).candidates(queries).mean() < 0.35


def test_all_rows_of_a_task_need_not_be_in_one_batch(spark):
    rows = made(200, seed=3)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    want = V.train(df.coalesce(1), parts=4, entries=7).tolist()
    assert V.train(df.repartition(9, F.rand(1)), parts=4, entries=7).tolist() == want == brute(rows, entries=7)[2]

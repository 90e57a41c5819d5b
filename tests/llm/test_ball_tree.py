import hashlib
import math
import random

import numpy as np
import pytest

from driftlab.llm import ball_tree as B

SCHEMA = "vec_id long, embedding array<float>, cluster string, POINTS int"


def brute(rows, k=3, rounds=4, scale=1024):
    x = [[math.floor(scale * float(np.float32(c))) for c in v] for _, v in rows]
    rank = lambda i: (rows[i][0] is None, hashlib.sha256(f"3:{rows[i][0]}".encode()).hexdigest(), x[i])
    at = [x[i] for i in sorted(range(len(x)), key=rank)[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(at))
    for _ in range(rounds):
        own = [near(v)[1] for v in x]
        at = [[sum(c) // own.count(i) for c in zip(*(v for v, o in zip(x, own) if o == i))] if i in own else c for i, c in enumerate(at)]
    return sorted((str(r[0]), near(v)[1], near(v)[0]) for r, v in zip(rows, x)), at


def made(n=300, d=6, seed=2):
    r = random.Random(seed)
    rows = [(r.randrange(n), [r.choice([-1.0, 0.0, 0.5, r.uniform(-1, 1)]) for _ in range(d)]) for _ in range(n)]
    return rows + [rows[5]] * 150 + [(None, rows[1][1]), (7, rows[2][1]), (7, rows[3][1])]


def run(spark, rows, parts=3, **kw):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(parts)
    out, at = B.cluster(df, **kw)
    return sorted((str(r.vec_id), r.cluster, r.distance) for r in out.collect()), at.tolist()


@pytest.mark.parametrize("parts", [1, 5])
def test_equals_brute_force(spark, monkeypatch, parts):
    monkeypatch.setattr(B.plant, "__defaults__", (*B.plant.__defaults__[:-1], 70))  # small lots: several trees a task
    rows = made()
    odd = [(1, None), (2, [0.1] * 5 + [None]), (3, [float("nan")] * 6), (4, [float("inf")] * 6), (5, []), (6, [0.5] * 5)]
    assert run(spark, rows + odd, parts, width=6, centroids=3, rounds=4) == brute(rows)


def test_more_centroids_than_vectors_ties_and_copies(spark):
    rows = [(1, [0.0, 0.0]), (1, [0.0, 0.0]), (2, [1.0, 1.0])]
    assert run(spark, rows, width=2, centroids=8, rounds=3) == brute(rows, 8, 3)


def test_empty_and_too_large(spark):
    assert run(spark, [], width=6) == ([], []) and run(spark, [(1, None)], width=6) == ([], [])
    got, at = run(spark, [(1, [1e30, 0.0]), (2, [0.25, 0.5])], width=2, centroids=2)
    assert got == [("1", None, None), ("2", 0, 0)] and at == [[256, 512]]


def test_balls_cover_their_points_and_most_are_not_looked_into():
    r = np.random.default_rng(1)
    points = np.concatenate([r.normal(c, 12, (700, 16)) for c in r.uniform(-800, 800, (6, 16))] + [np.full((900, 16), 5)]).astype(np.int64)
    t = B.BallTree.unpacked(B.BallTree.build(points).packed(), 16)
    for i in range(len(t.start)):
        own = t.points[t.start[i] : t.end[i]].astype(np.int64)
        assert (own.sum(axis=0) == t.sums[i]).all() and ((own - t.center[i]) ** 2).sum(axis=1).max() == t.radius[i]
    assert sorted(t.order) == list(range(len(points))) and (t.points == points[t.order]).all()
    at = points[::800][:6]
    balls, to, rest, near = t.descend(at)
    got = np.full(len(points), -1)
    for b, c in zip(balls, to):
        got[t.start[b] : t.end[b]] = c
    got[rest] = near
    assert (got == B.distances(t.points, at).argmin(axis=1)).all()
    assert len(rest) < 0.1 * len(points)  # the rest came with whole balls, which the triangle inequality decided


def test_distances_are_exact_for_large_integers():
    p, c = np.array([[1 << 26, -(1 << 26)], [3, 4]]), np.array([[-(1 << 26), 1], [3, 5]])
    assert B.distances(p, c).tolist() == [[sum((int(a) - int(b)) ** 2 for a, b in zip(x, y)) for y in c] for x in p]

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftlab.operators import metrics as M
from driftlab.operators import probes as P
from driftlab.operators import scoring
from driftlab.plans.checks import protocol_check

ROWS = "id long, source string, y int, x array<double>"


def made(seed=1):
    r = random.Random(seed)
    rows = [(i, "tells", y := i % 2, [r.gauss(3.0 * y, 1), r.gauss(0, 1)]) for i in range(200)]
    rows += [(1000 + i, "blind", i % 2, [r.gauss(0, 1), r.gauss(0, 1)]) for i in range(200)]
    rows += [(2000 + i, "few", i % 2, [0.0, float(i)]) for i in range(9)] + [(3000 + i, "one class", 1, [0.0, float(i)]) for i in range(30)]
    return rows + [(9000, "tells", None, [0.0, 0.0]), (9001, "tells", 1, None)]


def plain(x, y, steps=60):
    a, w, ridge = np.hstack([x, np.ones((len(x), 1))]), np.zeros(x.shape[1] + 1), np.append(np.ones(x.shape[1]), 1e-9)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(a @ w)))
        w = w - np.linalg.solve((a.T * (p * (1 - p))) @ a + np.diag(ridge), a.T @ (p - y) + ridge * w)
    return w


def test_probes_of_all_groups_at_once(spark):
    df = spark.createDataFrame(made(), ROWS).repartition(4)
    got = {r.source: r for r in P.blind_probes(df, "source", "id").collect()}
    assert {k: (r.n, r.skipped) for k, r in got.items()} == {"tells": (200, False), "blind": (200, False), "few": (9, True), "one class": (30, True), "pooled": (439, False)}
    assert got["tells"].auc > 0.95 and got["tells"].warns and 0.3 < got["blind"].auc < 0.7 and not got["blind"].warns and got["few"].auc is None
    # the fit and the scores of one group by hand
    parted = P.stratified(df.dropna().withColumn("k", F.col("id").cast("string")), ["source", "y"], "k").filter("source = 'tells'").collect()
    assert [sum(r.probe for r in parted if r.y == c) for c in (0, 1)] == [30, 30]
    x, y = (np.array([getattr(r, c) for r in parted if not r.probe]) for c in ("x", "y"))
    w = plain(x, y)
    assert P.fit_groups(df.filter("false").unionByName(spark.createDataFrame([(r.id, r.source, r.y, r.x) for r in parted if not r.probe], ROWS)), "source")["tells"] == pytest.approx(w, abs=1e-6)
    s = [(float(np.dot(w[:2], r.x) + w[2]), r.y) for r in parted if r.probe]
    pairs = [(a > b) + (a == b) / 2 for a, t in s if t for b, u in s if not u]
    assert got["tells"].auc == pytest.approx(sum(pairs) / len(pairs), abs=1e-6)


def test_no_rows(spark):
    assert P.blind_probes(spark.createDataFrame([], ROWS), "source", "id").count() == 0


def test_rows_without_a_path_or_a_whole_vector_have_no_score(spark):
    good = [(f"p{i}", i % 2, [0.1 * i, 1.0 - i]) for i in range(6)]
    bad = [(None, 1, [0.0, 0.0]), ("a", 1, None), ("b", 0, [1.0]), ("c", 0, [None, 1.0]), ("d", 0, [float("nan"), 1.0]), ("e", 0, [])]
    kind = "path string, y int, x array<double>"
    head = scoring.fit_centroid_head(spark.createDataFrame(good, kind))
    one = {r.path: r.p for r in scoring.score_views(spark.createDataFrame(good, kind), head, ["clean"]).collect()}
    both = scoring.score_views(spark.createDataFrame(good + bad, kind).coalesce(1), head, ["clean"]).collect()
    assert len(both) == 12 and {r.path: r.p for r in both if r.path in one} == one
    assert all(r.p is None for r in both if r.path not in one) and all(p is not None for p in one.values())
    assert M.auc(spark.createDataFrame([(r.p, r.y) for r in both if r.p is not None], "p double, y int")).first().n_pos == 3


def test_protocol_tolerance(spark):
    kind = "name string, threshold double, fpr double, tpr double"
    recorded = spark.createDataFrame([("a", 0.5, 0.1, 0.9), ("b", 0.5, 0.1, 0.9), ("c", 0.5, 0.1, 0.9)], kind)
    derived = spark.createDataFrame([("a", 0.5, 0.10004, 0.9), ("b", 0.5, 0.1, 0.9001)], kind)
    assert {r.name: (r.threshold_ok, r.rates_ok, r.reproduced) for r in protocol_check(recorded, derived).collect()} == {"a": (True, True, True), "b": (True, False, False), "c": (False, False, False)}

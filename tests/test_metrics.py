import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from driftlab.functions import vectors as V
from driftlab.operators import metrics as M


def frame(spark, rows):
    return spark.createDataFrame([(float(p), int(y), g) for p, y, g in rows], "p double, y int, g string")


def brute_auc(rows):
    pos, neg = [p for p, y, _ in rows if y], [p for p, y, _ in rows if not y]
    return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg)) if pos and neg else None


def test_known_values(spark):
    auc = lambda rows: M.auc(frame(spark, rows)).first()["auc"]
    assert auc([(0.1, 0, ""), (0.4, 0, ""), (0.35, 1, ""), (0.8, 1, "")]) == 0.75
    assert auc([(0.5, 0, ""), (0.5, 1, ""), (0.5, 1, "")]) == 0.5
    assert auc([(0.5, 1, "")]) is None


def test_auc_by_group_matches_pairs(spark):
    r = random.Random(1)
    rows = [(round(r.random(), 2), r.random() < 0.4, r.choice("abc")) for _ in range(400)]
    for x in M.auc(frame(spark, rows), ("g",)).collect():
        assert x.auc == pytest.approx(brute_auc([v for v in rows if v[2] == x.g]), abs=1e-6)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 20), st.booleans()), min_size=4, max_size=40))
def test_auc_is_kept_by_monotone_maps(spark, rows):
    a = M.auc(frame(spark, [(p / 21, y, "") for p, y in rows])).first()["auc"]
    b = M.auc(frame(spark, [((p / 21) ** 3, y, "") for p, y in rows])).first()["auc"]
    assert a == b


def threshold(spark, rows):
    return M.best_balanced_threshold(frame(spark, rows)).first()["threshold"]


def test_best_threshold_takes_the_next_vertex_not_the_next_score(spark):
    separated = [(0.9, 1, ""), (0.8, 1, ""), (0.7, 1, ""), (0.3, 0, ""), (0.2, 0, ""), (0.05, 0, "")]
    assert threshold(spark, separated) == pytest.approx((0.7 + 0.05) / 2)
    assert threshold(spark, [(0.9, 1, ""), (0.8, 0, ""), (0.7, 1, ""), (0.6, 0, "")]) == pytest.approx((0.9 + 0.6) / 2)


def test_sweep_and_rates(spark):
    r = random.Random(2)
    rows = [(round(r.random(), 3), r.random() < 0.5, "") for _ in range(300)]
    grid = [0.1, 0.5, 0.905]
    for x in M.sweep(frame(spark, rows), grid).collect():
        tp = sum(y and p >= x.threshold for p, y, _ in rows)
        fp = sum(not y and p >= x.threshold for p, y, _ in rows)
        fn = sum(y and p < x.threshold for p, y, _ in rows)
        assert (x.tp, x.fp, x.fn) == (tp, fp, fn)
        assert x.f1 == pytest.approx(2 * tp / max(1, 2 * tp + fp + fn), abs=1e-6)
    assert M.sweep(frame(spark, [(0.9, 1, "")]), [0.5]).first()["fpr"] is None


def test_each_group_against_all_reals(spark):
    r = random.Random(3)
    rows = [(round(r.random(), 2), int(r.random() < 0.5), r.choice("abc")) for _ in range(300)]
    reals = [x for x in rows if not x[1]]
    for x in M.against_all_reals(frame(spark, rows), "g").collect():
        own = [v for v in rows if v[1] and v[2] == x.g]
        assert x.n == len(own) and x.auc == pytest.approx(brute_auc(own + reals), abs=1e-6)


def test_empty(spark):
    e = frame(spark, [])
    assert M.auc(e, ("g",)).count() == 0 and M.roc_vertices(e).count() == 0


def test_quantile_matches_numpy(spark):
    import numpy as np

    r = random.Random(5)
    rows = [(round(r.random(), 2), 0, r.choice("ab")) for _ in range(200)]
    for q in (0.0, 0.1, 0.975, 1.0):
        for x in M.quantile(frame(spark, rows), q, ("g",)).collect():
            assert x.value == pytest.approx(np.quantile([p for p, _, g in rows if g == x.g], q))


def test_six_digits_round_as_printf_does(spark):
    r = random.Random(4)
    p = [0.0, 1.0, 0.0078125, 0.0234375, 0.1234565, 0.572168500, 0.9999995, 0.99999949999, 5e-7, 1e-9, 2.5e-6] + [(2 * r.randrange(500_000) + 1) / 2e6 for _ in range(2000)] + [round(r.random(), 9) for _ in range(1000)]
    got = spark.createDataFrame([(x,) for x in [*p, None, float("nan")]], "p double").select("p", V.six_digits(F.col("p")).alias("t")).collect()
    assert [x.t for x in got] == [*("%.6f" % x for x in p), None, "nan"]

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftlab.operators import calibration as C
from driftlab.operators import metrics as M


def brute(rows):
    """score -> isotonic value, by the min-max formula over all runs of distinct scores."""
    counts = {}
    for p, y in rows:
        n, pos = counts.get(p, (0, 0))
        counts[p] = n + 1, pos + y
    ps = sorted(counts)
    n, pos = (np.cumsum([0, *(counts[p][i] for p in ps)]) for i in (0, 1))
    mean = lambda j, k: (pos[k + 1] - pos[j]) / (n[k + 1] - n[j])
    return {p: max(min(mean(j, k) for k in range(i, len(ps))) for j in range(i + 1)) for i, p in enumerate(ps)}


def made(spark, n, seed=1):
    r = random.Random(seed)
    rows = [(round(p, 2) if r.random() < 0.6 else p, int(r.random() < p * p)) for p in (r.random() for _ in range(n))]
    odd = [(None, 1), (0.5, None)]
    return rows, spark.createDataFrame(rows + odd, "p double, y int").repartition(3)


@pytest.mark.parametrize("fan_in,parts", [(2, 11), (16, 4)])
def test_pools_equal_brute_force(spark, monkeypatch, fan_in, parts):
    monkeypatch.setattr(C, "FAN_IN", fan_in)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows, df = made(spark, 150)
        pools = C.isotonic(df)
        got = {r.p: r.isotonic for r in C.apply_isotonic(df.filter("p is not null").select("p").distinct(), pools).collect()}
        want = brute(rows)
        assert {p: got[p] for p in want} == pytest.approx(want)
        ps = sorted(pools.collect())
        assert all(a.hi < b.lo and a.value < b.value for a, b in zip(ps, ps[1:])) and sum(r.n for r in ps) == 150
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_one_class_ties_and_nothing(spark):
    df = lambda rows: spark.createDataFrame(rows, "p double, y int")
    assert [tuple(r) for r in C.isotonic(df([(0.3, 1), (0.3, 0), (0.3, 1)])).collect()] == [(0.3, 0.3, 3, 2, 2 / 3)]
    assert C.isotonic(df([])).count() == 0
    assert [tuple(r) for r in C.apply_isotonic(df([(0.1, 1), (None, 1)]), C.isotonic(df([(0.3, 1)]))).collect()] in ([(0.1, 1, 1.0), (None, 1, None)], [(None, 1, None), (0.1, 1, 1.0)])
    for rows in ([], [(0.2, 1)]):
        with pytest.raises(ValueError):
            C.platt(df(rows))


def test_platt_finds_the_minimum_and_keeps_the_order(spark):
    rows, df = made(spark, 400)
    df = df.dropna()
    a, b = C.platt(df)
    n_pos = sum(y for _, y in rows)
    t = np.array([(n_pos + 1) / (n_pos + 2) if y else 1 / (len(rows) - n_pos + 2) for _, y in rows])
    z = np.array([math.log(min(max(p, 1e-12), 1 - 1e-12) / (1 - min(max(p, 1e-12), 1 - 1e-12))) for p, _ in rows])
    s = 1 / (1 + np.exp(-(a * z + b)))
    assert abs(((s - t) * z).sum()) < 1e-5 and abs((s - t).sum()) < 1e-5  # the gradient vanishes
    out = C.apply_platt(df, (a, b)).select(F.col("platt").alias("p"), "y")
    assert M.auc(out).first().auc == M.auc(df).first().auc


def test_separable_scores_do_not_diverge(spark):
    df = spark.createDataFrame([(0.0, 0), (0.1, 0), (0.9, 1), (1.0, 1)], "p double, y int")
    assert all(map(math.isfinite, C.platt(df)))

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftlab.operators import local_sgd as L
from driftlab.operators import views

ROWS = "id long, y int, x array<double>"


def made(spark, n=500, d=5, seed=2):
    r = random.Random(seed)
    rows = [(i, y := int(r.random() < 0.3), [r.gauss(0.6 * y, 1) for _ in range(d)]) for i in range(n)]
    return spark.createDataFrame(rows, ROWS).repartition(3)


def plain(order, x, y, batch, epochs, rate, decay):
    """Minibatch AdamW as a loop over the rows in the order given for each epoch."""
    mean, std = x.mean(axis=0), x.std(axis=0)
    z, pos = (x - mean) / std, (y == 0).sum() / (y == 1).sum()
    p, m, v, t, losses, heads = np.zeros(x.shape[1] + 1), 0.0, 0.0, 0, [], []
    for e in range(epochs):
        for i in range(0, len(order[e]), batch):
            a, b = z[order[e][i : i + batch]], y[order[e][i : i + batch]]
            s = 1 / (1 + np.exp(-(a @ p[:-1] + p[-1])))
            losses.append(-np.mean(pos * b * np.log(s) + (1 - b) * np.log(1 - s)))
            w = (pos * b * (s - 1) + (1 - b) * s) / len(b)
            g, t = np.append(w @ a, w.sum()), t + 1
            p = p * (1 - rate * decay)
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            p = p - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
            heads.append(p)
    return losses, heads, z


def brute_auc(s, y):
    a, b = s[y == 1], s[y == 0]
    return float(((a[:, None] > b).sum() + 0.5 * (a[:, None] == b).sum()) / (len(a) * len(b)))


def test_one_worker_is_plain_training(spark):
    df = made(spark)
    val = df.select(F.lit("clean").alias("view"), "y", "x").unionByName(df.select(F.lit("dim").alias("view"), "y", F.transform("x", lambda c: F.round(c)).alias("x")))
    run = L.train(df, "id", val, workers=1, batch=64, epochs=2, rate=0.05, weight_decay=0.1, eval_every=5)
    rows = sorted(df.collect())
    x, y = np.array([r.x for r in rows]), np.array([r.y for r in rows])
    order = [[r.id for r in L.dealt(df, "id", e, 1, 0).collect()] for e in (1, 2)]
    assert sorted(order[0]) == sorted(order[1]) == list(range(500)) and order[0] != order[1]
    losses, heads, z = plain(order, x, y, 64, 2, 0.05, 0.1)
    steps = sorted(run.steps.collect())
    assert [r.step for r in steps] == list(range(1, 17)) and [r.n for r in steps] == [64] * 7 + [52] + [64] * 7 + [52]
    assert [r.batch_loss for r in steps] == pytest.approx(losses, abs=2e-6)
    n = np.array([r.n for r in steps])
    for i, r in enumerate(steps):
        e = slice(0 if i < 8 else 8, i + 1)
        assert r.running_mean == pytest.approx(np.average(losses[e], weights=n[e]), abs=2e-6) and r.trailing_mean == pytest.approx(np.mean(losses[: i + 1]), abs=2e-6)
    assert run.head["weights"] + [run.head["bias"]] == pytest.approx(heads[-1].tolist())
    scaled = {"clean": z, "dim": (np.round(x) - x.mean(axis=0)) / x.std(axis=0)}
    curve = sorted(run.curve.collect())
    assert [(r.step, r.epoch) for r in curve] == [(1, 1), (5, 1), (8, 1), (10, 2), (15, 2), (16, 2)]
    for r in curve:
        h = heads[r.step - 1]
        clean, robust = (brute_auc(scaled[k] @ h[:-1] + h[-1], y) for k in ("clean", "dim"))
        assert (r.auc_clean, r.auc_robust) == pytest.approx((clean, robust), abs=1e-6) and r.score == pytest.approx((clean + robust) / 2, abs=1e-6)
    assert run.meta["n_rows"] == 500 and run.meta["balance_pos_weight"] == pytest.approx((y == 0).sum() / (y == 1).sum(), abs=1e-6)


def test_workers_average_and_do_not_depend_on_partitions(spark):
    one, two = (L.train(df, "id", workers=3, batch=32, epochs=2, rate=0.05) for df in (made(spark), made(spark).repartition(1)))
    assert all(one.head[k] == pytest.approx(two.head[k]) for k in one.head)
    assert [r.batch_loss for r in sorted(one.steps.collect())] == pytest.approx([r.batch_loss for r in sorted(two.steps.collect())], abs=2e-6)
    rows = sorted(one.steps.collect())
    assert sum(r.n for r in rows) == 1000 and [r.step for r in rows] == list(range(1, len(rows) + 1))
    assert rows[-1].running_mean < rows[0].running_mean
    # the averages are those of the workers' own last parameters
    df, o = made(spark), {"workers": 3, "batch": 32, "rate": 0.05, "decay": 0.0, "seed": 0, "eval_every": 50, "positive": 1.0}
    told = L._epoch(df, "id", 1, np.zeros(18), 0, L.scaler(df), o)
    ends = told.filter("kind = 'end'").collect()
    assert len(ends) == 3 and sum(r.n for r in ends) == 500
    assert L._averaged(told, "end")[0] == pytest.approx(np.average([r.params for r in ends], axis=0, weights=[r.n for r in ends]))


def test_rows_of_no_use_raise(spark):
    with pytest.raises(ValueError):
        L.train(made(spark).filter("false"), "id")
    for row in ((1, 1, None), (1, None, [0.0] * 5), (1, 1, [0.0] * 4 + [None]), (1, 1, [0.0] * 4)):
        with pytest.raises(Exception):
            L.train(made(spark, 20).unionByName(spark.createDataFrame([row], ROWS)), "id", clean=made(spark, 20), epochs=1)


def test_segments_and_tiles_change_nothing(spark, monkeypatch):
    df = made(spark, 700).withColumn("path", F.concat(F.lit("v/"), F.col("id")))
    names = ["clean", "noise_sigma0.05", "jpeg_q30"]
    key = F.concat_ws("::", "path", "view").alias("key")
    kinds = {m.__name__: m(df, names).select(key, "view", "y", "x", *(["seed"] if m is views.named_views else [])) for m in (views.expand_views, views.named_views)}
    train = lambda m, workers=3: L.train(kinds[m].drop("view") if m == "expand_views" else kinds[m], "key", kinds[m].drop("key"), clean=df, workers=workers, batch=32, epochs=2, rate=0.05, eval_every=12)
    shown = lambda run: (sorted(run.steps.collect()), sorted(run.curve.collect()), run.head)
    close = lambda a, b: all(x == pytest.approx(y, abs=3e-6) for u, v in zip(a[:2], b[:2], strict=True) for x, y in zip(u, v, strict=True)) and all(a[2][k] == pytest.approx(b[2][k]) for k in b[2])
    whole = shown(train("expand_views"))
    assert sum(r.n for r in whole[0]) == 4200
    assert close(shown(train("named_views")), whole)  # views made by the trainer
    counts, ordered = [], L._ordered
    monkeypatch.setattr(L, "_ordered", lambda rows, *a: counts.append(rows.count()) or ordered(rows, *a))
    monkeypatch.setattr(L, "SEGMENT_MB", 2100 * (8 * 5 + 64) / 3 / 1e6 / 5.5)
    monkeypatch.setattr(L, "BLOCK_MB", 300 * 8 * 5 / 1e6)  # three blocks
    assert close(shown(train("named_views")), whole)
    assert len(counts) == 12 and sum(counts) == 4200 and max(counts) < 500  # no job has many more rows than a sixth of an epoch
    # with so many segments that workers are missing in some, the last too
    monkeypatch.setattr(L, "_ordered", ordered)
    few = lambda mb: (monkeypatch.setattr(L, "SEGMENT_MB", mb), sorted(L.train(made(spark, 12), "id", workers=4, batch=2, epochs=1).steps.collect()))[1]
    assert few(12 * (8 * 5 + 64) / 4 / 1e6 / 8) == few(1)

"""Blind probes: whether cheap features alone tell two classes apart, for many groups at once.

A probe is a logistic regression with a ridge penalty, fitted on a stratified part of a group's rows by Newton's method. A step
is one job for all groups: tasks sum up gradients and Hessians of the groups that they meet, Spark adds them; the driver gets
one small matrix a group, so groups are meant to be sources and not rows (MOST_GROUPS). Groups with fewer than MIN_ROWS rows or
with a class of fewer than MIN_OF_CLASS are skipped and say so. Rows without a label, or without all features, are not probed.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlab.operators import metrics as M
from driftlab.operators.manifests import drawn_ranks
from driftlab.sources.files import checkpoint_folder

MIN_ROWS, MIN_OF_CLASS, MOST_GROUPS = 10, 2, 10_000
WARNS = 0.7


def stratified(rows: DataFrame, strata: Sequence[str], key: str, fraction: float = 0.3, seed: str = "0") -> DataFrame:
    """rows with probe, true for the given part of each stratum, drawn by a hash of the key."""
    r = drawn_ranks(rows, strata, seed, key)
    return r.withColumn("probe", F.col("rank") <= F.round(F.col("n") * fraction)).drop("rank", "n")


def fit_groups(rows: DataFrame, group: str, vector: str = "x", label: str = "y", penalty: float = 1.0, steps: int = 12) -> dict[str, np.ndarray]:
    """group -> weights and, last, the bias (not penalised) of a logistic regression."""
    rows = rows.select(F.col(group).cast("string").alias("g"), F.col(vector).alias("x"), F.col(label).cast("double").alias("y"))
    names = [r["g"] for r in rows.select("g").distinct().limit(MOST_GROUPS + 1).collect()]
    if len(names) > MOST_GROUPS:
        raise ValueError("too many groups to probe each")
    first = rows.select("x").first()
    w = {g: np.zeros(len(first["x"]) + 1) for g in names}
    for _ in range(steps if names else 0):
        now = w

        def run(batches):
            import pyarrow as pa

            sums: dict[str, list] = {}
            for b in batches:
                g, y = np.array(b.column(0).to_pylist(), object), b.column(2).to_numpy(zero_copy_only=False)
                x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                x = np.hstack([x, np.ones((len(x), 1))])
                for name in set(g):
                    own = g == name
                    a, t = x[own], y[own]
                    p = 1 / (1 + np.exp(-np.clip(a @ now[name], -500, 500)))
                    h = (a * (p * (1 - p))[:, None]).T @ a
                    s = sums.setdefault(name, [np.zeros(a.shape[1]), np.zeros(h.shape)])
                    s[0] += a.T @ (p - t)
                    s[1] += h
            if sums:
                flat = [np.concatenate([v[0], v[1].ravel()]) for v in sums.values()]
                yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array(flat, pa.list_(pa.float64()))], ["g", "s"])

        told = rows.mapInArrow(run, "g string, s array<double>").select("g", F.posexplode("s").alias("i", "v")).groupBy("g", "i").agg(F.sum("v").alias("v"))
        flat: dict[str, dict[int, float]] = {}
        for r in told.collect():  # the numbers of one matrix a group
            flat.setdefault(r["g"], {})[r["i"]] = r["v"]
        moved = {}
        for g, parts in flat.items():
            d = len(w[g])
            s = np.array([parts[i] for i in range(d * d + d)])
            ridge = np.append(np.full(d - 1, penalty), 1e-9)
            moved[g] = w[g] - np.linalg.solve(s[d:].reshape(d, d) + np.diag(ridge), s[:d] + ridge * w[g])
        still = all(np.abs(moved[g] - w[g]).max() < 1e-10 for g in moved)
        w = moved
        if still:
            break
    return w


def blind_probes(rows: DataFrame, group: str, key: str, vector: str = "x", label: str = "y", pooled: str = "pooled") -> DataFrame:
    """(group, n, skipped, auc, bacc, warns): of the rows kept from the fit, of each group and of all rows as one more group."""
    whole = rows.filter(F.col(label).isNotNull() & F.col(vector).isNotNull()).select(F.col(group).cast("string").alias("g"), F.col(key).cast("string").alias("k"), F.col(vector).cast("array<double>").alias("x"), F.col(label).cast("int").alias("y"))
    both = whole.unionByName(whole.withColumn("g", F.lit(pooled)))
    per = both.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("y") == 1).alias("p"))
    per = per.withColumn("skipped", (F.col("n") < MIN_ROWS) | (F.col("p") < MIN_OF_CLASS) | (F.col("n") - F.col("p") < MIN_OF_CLASS))
    parted = stratified(both.join(F.broadcast(per.filter("NOT skipped").select("g")), "g"), ["g", "y"], "k")  # a row a group
    path, schema = checkpoint_folder(rows.sparkSession, "probed"), parted.schema
    parted.write.parquet(path)  # read in every step
    parted = rows.sparkSession.read.schema(schema).parquet(path)
    fitted = fit_groups(parted.filter("NOT probe"), "g")
    heads = rows.sparkSession.createDataFrame([(g, w.tolist()) for g, w in fitted.items()], "g string, w array<double>")
    z = F.aggregate(F.zip_with("x", F.slice("w", 1, F.size("x")), lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v) + F.element_at("w", -1)
    scored = parted.filter("probe").join(F.broadcast(heads), "g").select("g", "y", F.round(1 / (1 + F.exp(-z)), 9).alias("p"))
    out = M.auc(scored, ["g"]).select("g", "auc").join(M.rates(scored, 0.5, ["g"]).select("g", F.round("bacc", 6).alias("bacc")), "g")
    return per.join(out, "g", "left").select(F.col("g").alias(group), "n", "skipped", "auc", "bacc", (F.col("bacc") >= WARNS).alias("warns"))

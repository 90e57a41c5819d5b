"""Scaler, heads and scores."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlab.functions import vectors as V
from driftlab.operators import views


def scaler_stats(rows: DataFrame, vector: str = "x") -> DataFrame:
    """(dim, mean, std): mean and population deviation of each place; a deviation of 0 counts as 1. Partial aggregates, then one row a place."""
    dims = rows.select(F.posexplode(vector).alias("dim", "v"))
    return dims.groupBy("dim").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std")).withColumn("std", F.when(F.col("std") == 0, F.lit(1.0)).otherwise(F.col("std")))


def fit_centroid_head(rows: DataFrame, vector: str = "x", label: str = "y") -> DataFrame:
    """One row (mean, std, weights, bias): the difference of the standardized class means, and the point half-way between them.

    All from one pass: sums by place, of the class means too.
    """
    dims = rows.select(F.posexplode(vector).alias("dim", "v"), label)
    by_dim = dims.groupBy("dim").agg(
        F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"),
        F.avg(F.when(F.col(label) == 1, F.col("v"))).alias("m1"), F.avg(F.when(F.col(label) == 0, F.col("v"))).alias("m0"),
    )
    by_dim = by_dim.withColumn("std", F.when(F.col("std") == 0, F.lit(1.0)).otherwise(F.col("std")))
    by_dim = by_dim.withColumns({"z1": (F.col("m1") - F.col("mean")) / F.col("std"), "z0": (F.col("m0") - F.col("mean")) / F.col("std")})
    pick = lambda c: F.transform(F.col("all"), lambda s: s[c])
    one = by_dim.groupBy().agg(F.array_sort(F.collect_list(F.struct("dim", "mean", "std", "z1", "z0"))).alias("all"))  # one row a place of the vector
    return one.select(pick("mean").alias("mean"), pick("std").alias("std"), F.transform("all", lambda s: s["z1"] - s["z0"]).alias("weights"), (-F.aggregate("all", F.lit(0.0), lambda a, s: a + (s["z1"] - s["z0"]) * (s["z1"] + s["z0"])) / 2).alias("bias"))


def score(rows: DataFrame, head: DataFrame, vector: str = "x", digits: int = 9) -> DataFrame:
    """rows with p, the head's probability, in place of the vector. The head is one row as long as the vector."""
    z = V.standardize(F.col(vector), F.col("mean"), F.col("std"))
    p = V.sigmoid(V.dot(z, F.col("weights")) + F.col("bias"))
    return rows.crossJoin(F.broadcast(head)).withColumn("p", F.round(p, digits)).drop(vector, "mean", "std", "weights", "bias")


def _half_away(x: np.ndarray) -> np.ndarray:
    a = np.abs(x)
    f = np.floor(a)
    return np.copysign(f + (a - f >= 0.5), x)


def view_matrix(x: np.ndarray, name: str, seeds: np.ndarray) -> np.ndarray:
    """A view of many vectors at once; the same numbers as the column expressions of driftlab.functions.vectors."""
    d = x.shape[1]
    at = np.arange(d)
    for op, p in views.view_steps()[name]:
        if op == "jpeg":
            step = (100 - p) / 200.0
            x = _half_away(x / step) * step
        elif op == "blur":
            taps = V.blur_taps(p)
            out = np.zeros(x.shape)
            for j, (k, w) in enumerate(taps):
                term = x[:, np.clip(at + k, 0, d - 1)] * w
                out = term if j == 0 else out + term
            x = out / sum(w for _, w in taps)
        elif op == "resize":
            f = round(1 / p)
            x = x[:, at // f * f]
        elif op == "noise":
            v = (seeds[:, None] + (at + 1)[None, :] * 2654435761) % V.M32
            v = (v * 1664525 + 1013904223) % V.M32
            v = v ^ (v >> 16)
            x = x + ((v * 22695477 + 1) % V.M32 / float(V.M32) - 0.5) * (p * math.sqrt(12.0))
        elif op == "jitter":
            x = x * (1 - views.JITTER_STRENGTH + 2 * views.JITTER_STRENGTH * (seeds / float(V.M32)))[:, None]
        else:
            edge = math.floor(d * round((1 - views.CROP_FRACTION) / 2, 6))
            x = np.where((at >= edge) & (at < d - edge), x, 0.0)
    return x


def score_views(rows: DataFrame, head: DataFrame, names=None, vector: str = "x", path: str = "path", digits: int = 9, scored_only: bool = True) -> DataFrame:
    """rows times views with p in place of the vector: views and head in Arrow batches, with no shuffle.

    Does what score(expand_views(rows), head) does, an order of magnitude faster: array expressions are interpreted
    value by value, numpy takes a batch at once. The head, one row as long as the vector, is fitted first.

    Rows without a path, or whose vector is null, of another length than the head or holds null or non-finite components,
    have a null p in every view.
    """
    h = head.first()
    chosen, order = views.select_views(names, scored_only), {n: i for i, n in enumerate(views.view_steps())}
    rest = [c for c in rows.columns if c != vector]
    mean, std, w = (np.array(h[c] if h and h[c] is not None else [], float) for c in ("mean", "std", "weights"))
    bias, draws = float(h["bias"] or 0.0) if h else 0.0, {n: "stochastic" in views.view_spec(n) for n in chosen}

    def run(batches):
        import hashlib

        import pyarrow as pa

        for b in batches:
            flat = b.column(len(rest))
            n = b.num_rows
            if not n:
                continue
            lengths = np.nan_to_num(np.asarray(flat.value_lengths().to_numpy(zero_copy_only=False), float)).astype(np.int64)
            fits = lengths == len(w)
            x = np.zeros((n, len(w)))
            x[fits] = flat.flatten().to_numpy(zero_copy_only=False).astype(float)[np.repeat(fits, lengths)].reshape(-1, len(w))
            keys = [(k or "").encode() for k in b.column(rest.index(path)).to_pylist()]
            fits &= np.isfinite(x).all(axis=1) & b.column(rest.index(path)).is_valid().to_numpy(zero_copy_only=False)
            x[~fits] = 0.0
            for name in chosen:
                tail = f"::{name}::path-v1".encode()
                seeds = np.array([int.from_bytes(hashlib.sha1(k + tail).digest()[:4], "little") for k in keys], np.int64) if draws[name] else np.zeros(n, np.int64)
                z = (view_matrix(x, name, seeds) - mean) / std
                s = np.zeros(n)
                for i in range(z.shape[1]):  # in the order of the places, as the expressions add up
                    s += z[:, i] * w[i]
                p = np.round(1.0 / (1.0 + np.exp(-(s + bias))), digits)
                made = [pa.array([name] * n), pa.array(np.full(n, order[name], np.int32)), pa.array(["chain" if views.is_chain(name) else "single"] * n), pa.array(p, mask=~fits)]
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(rest))), *made], [*rest, "view", "ord", "kind", "p"])

    kinds = dict(rows.dtypes)
    return rows.select(*rest, vector).mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in rest) + ", view string, ord int, kind string, p double")

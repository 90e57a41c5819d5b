"""Trainable heads: MLlib logistic regressions and perceptrons, heads over many views, and instrumented minibatch curves."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlab.functions import vectors as V
from driftlab.operators import views
from driftlab.operators.manifests import exclude_generators


def logistic_head(rows: DataFrame, vector: str = "x", label: str = "y", balance: bool = True) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression that MLlib fits on all executors; classes weigh alike if balance."""
    n = rows.agg(F.sum(F.col(label)).alias("p"), F.sum(1 - F.col(label)).alias("n")).first()
    w = F.when(F.col(label) == 1, F.lit(float(n["n"] or 1) / max(1, n["p"] or 0))).otherwise(F.lit(1.0)) if balance else F.lit(1.0)
    m = LogisticRegression(featuresCol="f", labelCol=label, weightCol="w", regParam=0.01, maxIter=50).fit(rows.select(array_to_vector(vector).alias("f"), F.col(label).cast("double"), w.alias("w")))
    return m.coefficients.toArray(), float(m.intercept)


def score_linear(rows: DataFrame, weights: np.ndarray, bias: float, vector: str = "x") -> DataFrame:
    w = F.array(*[F.lit(float(v)) for v in weights])
    return rows.withColumn("p", F.round(V.sigmoid(V.dot(F.col(vector), w) + F.lit(bias)), 9)).drop(vector)


def mlp_head(rows: DataFrame, hidden: Sequence[int] = (32,), vector: str = "x", label: str = "y", steps: int = 60, seed: int = 0):
    """A multi-layer perceptron that MLlib trains on all executors, on standardized vectors: a fitted pipeline."""
    first = rows.select(vector).first()
    if first is None:
        raise ValueError("a head can't be trained without rows")
    layers = [len(first[0]), *hidden, 2]
    stages = [StandardScaler(inputCol="_f", outputCol="_z", withMean=True), MultilayerPerceptronClassifier(featuresCol="_z", labelCol="_y", probabilityCol="_p", layers=layers, maxIter=steps, seed=seed)]
    return Pipeline(stages=stages).fit(rows.select(array_to_vector(vector).alias("_f"), F.col(label).cast("double").alias("_y")))


def score_mlp(rows: DataFrame, model, vector: str = "x") -> DataFrame:
    rest = [c for c in rows.columns if c != vector]
    return model.transform(rows.withColumn("_f", array_to_vector(vector))).select(*rest, F.round(vector_to_array("_p")[1], 9).alias("p"))


def train_on_views(base: DataFrame, extra: Sequence[DataFrame], names: Sequence[str], exclude: Sequence[str] = (), fake_weight: float | None = None) -> dict:
    """A logistic head over the views of a base corpus and of extra ones: a dict of mean, std, weights, bias, views and rows.

    Rows: path, y, generator, x. The scaler comes from the base corpus as it is (its clean view), the excluded
    generators are left out of all corpora, and the generated class has ``fake_weight`` (None: classes weigh alike).
    """
    if "clean" not in names:
        raise ValueError("the clean view is required")
    pick = lambda df: exclude_generators(df, exclude).select("path", "y", "generator", "x")
    base = pick(base)
    mean, std = (next(iter(base.select(f(array_to_vector("x"))).first())).toArray() for f in (Summarizer.mean, Summarizer.std))
    n = base.count()
    std = std * np.sqrt((n - 1) / n) if n > 1 else np.zeros_like(std)  # the population's deviation
    std[std == 0] = 1.0
    rows = base
    for e in extra:
        rows = rows.unionByName(pick(e))
    z = V.standardize(F.col("x"), F.array(*map(F.lit, mean.tolist())), F.array(*map(F.lit, std.tolist())))
    seen = views.expand_views(rows, list(names)).withColumn("x", z)
    c = seen.agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("n")).first()
    weight = float(c["n"] or 1) / max(1, c["p"] or 0) if fake_weight is None else float(fake_weight)
    w = F.when(F.col("y") == 1, F.lit(weight)).otherwise(F.lit(1.0))
    m = LogisticRegression(featuresCol="f", labelCol="y", weightCol="w", regParam=0.01, maxIter=50).fit(seen.select(array_to_vector("x").alias("f"), F.col("y").cast("double").alias("y"), w.alias("w")))
    return {"mean": mean.tolist(), "std": std.tolist(), "weights": m.coefficients.toArray().tolist(), "bias": float(m.intercept), "views": list(names), "rows": int((c["n"] or 0) + (c["p"] or 0))}


def run_arms(spark, arms: dict, status: str) -> dict:
    """Runs each arm, a function of the session, after the other; one that fails doesn't stop the rest. Appends a status row an arm; returns the results."""
    import time

    from driftlab.sources.files import append_status

    out = {}
    for name, arm in arms.items():
        began = time.time()
        try:
            out[name] = arm(spark)
            state = "done"
        except Exception as e:
            state = f"failed: {str(e).splitlines()[0][:200] if str(e) else type(e).__name__}"
        append_status(spark, status, {"stage": name, "state": state, "seconds": round(time.time() - began, 3)})
    return out

"""Calibration of scores by Platt's and by isotonic fits, from counts of equal scores.

The isotonic fit is pool-adjacent-violators, spread out: rows are counted by score, ranges of the score pool their own counts
in one pass each, and neighbouring ranges' pools are merged, FAN_IN ranges at a time, until one is left. Pools of one range
have rising means, which are fractions whose denominators sum up to the number of rows N; so there are at most about
N^(2/3) of them, whatever the scores: what a merge holds is bounded by that, not by the rows. Equal scores are one point.
Platt's fit is Newton's method on two parameters, whose sums Spark adds up from the counts, a job a step.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlab.operators import frames
from driftlab.operators.metrics import distinct_scores
from driftlab.sources.files import checkpoint_folder

FAN_IN = 16
_POOLS = "part int, lo double, hi double, n long, pos long"


def pooled(points):
    """Pools (lo, hi, n, pos) of (lo, hi, n, pos) by rising score: neighbours whose means don't rise become one."""
    out: list[list] = []
    for lo, hi, n, pos in points:
        out.append([lo, hi, n, pos])
        while len(out) > 1 and out[-2][3] * out[-1][2] >= out[-1][3] * out[-2][2]:  # exact, in integers
            last = out.pop()
            out[-1] = [out[-1][0], last[1], out[-1][2] + last[2], out[-1][3] + last[3]]
    return out


def isotonic(rows: DataFrame, p: str = "p", y: str = "y") -> DataFrame:
    """(lo, hi, n, pos, value): the pools of the isotonic fit of y by p; rows without a score or a label don't count."""
    spark = rows.sparkSession
    counts = distinct_scores(rows.filter(F.col(p).isNotNull() & F.col(y).isNotNull()), (), p, y)
    parts = counts.select(F.col(p).cast("double").alias("lo"), (F.col("pos") + F.col("neg")).alias("n"), "pos").repartitionByRange("lo").sortWithinPartitions("lo")

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, out = TaskContext.get().partitionId(), []
        for b in batches:
            lo, n, pos = (b.column(i).to_pylist() for i in range(3))
            out = pooled([*out, *zip(lo, lo, n, pos)])
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(out), pa.int32()), *map(pa.array, zip(*out))], ["part", "lo", "hi", "n", "pos"])

    def merge(table):
        import pyarrow as pa

        table = table.sort_by("lo")
        out = pooled(zip(*(table.column(c).to_pylist() for c in ("lo", "hi", "n", "pos"))))
        return pa.table([pa.array([table.column("part")[0].as_py()] * len(out), pa.int32()), *map(pa.array, zip(*out))], ["part", "lo", "hi", "n", "pos"])

    pools = _kept(parts.mapInArrow(run, _POOLS), spark)
    most = pools.agg(F.max("part")).first()[0]
    while most:
        pools = _kept(pools.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("int")).groupBy("part").applyInArrow(merge, _POOLS), spark)
        most //= FAN_IN
    return pools.select("lo", "hi", "n", "pos", (F.col("pos") / F.col("n")).alias("value"))


def _kept(df: DataFrame, spark) -> DataFrame:
    path = checkpoint_folder(spark, "pools")
    df.write.parquet(path)
    return spark.read.schema(_POOLS).parquet(path)


def apply_isotonic(rows: DataFrame, pools: DataFrame, p: str = "p", name: str = "isotonic") -> DataFrame:
    """rows with the value of the last pool that begins at or before their score, of the first one below all."""
    lowest = pools.agg(F.min_by("value", "lo").alias("_lowest"))  # one row
    out = frames.neighbours(rows, pools.withColumnRenamed("lo", p), p, ["value"])
    return out.crossJoin(F.broadcast(lowest)).withColumn(name, F.coalesce("before.value", F.when(F.col(p).isNotNull(), F.col("_lowest")))).drop("before", "after", "_lowest")


def _logit(p):
    x = F.least(F.lit(1 - 1e-12), F.greatest(F.lit(1e-12), p))
    return F.log(x / (1 - x))


def platt(rows: DataFrame, p: str = "p", y: str = "y", steps: int = 25) -> tuple[float, float]:
    """(slope, intercept) of the logistic fit of y by the score's logit, with Platt's softened targets."""
    counts = distinct_scores(rows.filter(F.col(p).isNotNull() & F.col(y).isNotNull()), (), p, y).select(_logit(F.col(p)).alias("z"), "pos", "neg")
    counts = counts.groupBy("z").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).persist()  # computed again if it is lost
    c = counts.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n")).first()
    n_pos, n_neg = c["p"] or 0, c["n"] or 0
    if not n_pos or not n_neg:
        counts.unpersist()
        raise ValueError("a calibration needs rows of both classes")
    high, low = (n_pos + 1) / (n_pos + 2), 1 / (n_neg + 2)
    target = F.col("pos") * high + F.col("neg") * low

    def sums(a: float, b: float):
        s = 1 / (1 + F.exp(-(F.col("z") * a + b)))
        w, d = (F.col("pos") + F.col("neg")), (F.col("pos") + F.col("neg")) * s - target
        h = w * s * (1 - s)
        z = F.col("z") * a + b
        loss = target * F.log1p(F.exp(-F.abs(z))) + target * F.greatest(F.lit(0.0), -z) + (w - target) * (F.log1p(F.exp(-F.abs(z))) + F.greatest(F.lit(0.0), z))
        return counts.agg(F.sum(loss), F.sum(d * F.col("z")), F.sum(d), F.sum(h * F.col("z") * F.col("z")), F.sum(h * F.col("z")), F.sum(h)).first()

    a, b = 0.0, math.log((n_pos + 1) / (n_neg + 1))
    now = sums(a, b)
    for _ in range(steps):
        step = np.linalg.lstsq(np.array([[now[3] + 1e-12, now[4]], [now[4], now[5] + 1e-12]]), np.array([now[1], now[2]]), rcond=None)[0]
        size = 1.0
        while size > 1e-10:
            after = sums(a - size * step[0], b - size * step[1])
            if after[0] <= now[0]:
                break
            size /= 2
        if size <= 1e-10 or np.abs(step).max() < 1e-10:
            break
        a, b, now = a - size * step[0], b - size * step[1], after
    counts.unpersist()
    return float(a), float(b)


def apply_platt(rows: DataFrame, fit: tuple[float, float], p: str = "p", name: str = "platt") -> DataFrame:
    return rows.withColumn(name, 1 / (1 + F.exp(-(_logit(F.col(p)) * fit[0] + fit[1]))))

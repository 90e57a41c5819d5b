"""Ranking and operating-point metrics of scored rows (p, y with y 0 or 1), by groups.

Rankings never sort a group in one task: equal scores are counted together first, running sums go over ranges of the
score, then within each range, so a group as large as the table is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGES = 1024
By = Sequence[str]


def distinct_scores(df: DataFrame, by: By = (), p: str = "p", y: str = "y") -> DataFrame:
    """(by, p, pos, neg): how many rows of either class have each score."""
    return df.groupBy(*by, p).agg(F.sum(F.col(y).cast("long")).alias("pos"), F.sum(1 - F.col(y).cast("long")).alias("neg"))


def cumulative(df: DataFrame, by: By, p: str = "p", columns: Sequence[str] = ("neg",), descending: bool = False) -> DataFrame:
    """df with, for each column c, ``c_before``: its sum over rows of the group that come before in the order of p (distinct within a group, 0 to 1)."""
    df = df.withColumn("_range", F.floor(F.col(p) * RANGES).cast("long"))
    order = lambda c: F.col(c).desc() if descending else F.col(c)
    inside = Window.partitionBy(*by, "_range").orderBy(order(p)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranges = df.groupBy(*by, "_range").agg(*[F.sum(c).alias(f"_{c}") for c in columns])
    above = Window.partitionBy(*by).orderBy(order("_range")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranges = ranges.select(*by, "_range", *[(F.sum(f"_{c}").over(above) - F.col(f"_{c}")).alias(f"_{c}") for c in columns])
    out = df.join(ranges, [*by, "_range"])
    return out.withColumns({f"{c}_before": F.col(f"_{c}") + F.sum(c).over(inside) - F.col(c) for c in columns}).drop("_range", *[f"_{c}" for c in columns])


def auc(df: DataFrame, by: By = (), digits: int = 6) -> DataFrame:
    """(by, auc, n_pos, n_neg): area under the ROC curve, ties counting half; null where a class is missing."""
    s = auc_of_counts(distinct_scores(df, by), by)
    return s.withColumn("auc", F.round("auc", digits))


def auc_of_counts(counts: DataFrame, by: By = ()) -> DataFrame:
    """auc, not rounded, of what distinct_scores counted; counts may be weights."""
    d = cumulative(counts, by)
    s = d.groupBy(*by).agg(F.sum(F.col("pos") * (2 * F.col("neg_before") + F.col("neg"))).alias("s"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    return s.select(*by, F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.col("s") / (2.0 * F.col("n_pos") * F.col("n_neg"))).alias("auc"), "n_pos", "n_neg")


def tpr(t: Column, p: str = "p", y: str = "y") -> Column:
    return F.avg(F.when(F.col(y) == 1, (F.col(p) >= t).cast("double")))


def fpr(t: Column, p: str = "p", y: str = "y") -> Column:
    return F.avg(F.when(F.col(y) == 0, (F.col(p) >= t).cast("double")))


def rates(df: DataFrame, threshold: float | Column, by: By = ()) -> DataFrame:
    """(by, tpr, fpr, bacc) at a fixed threshold, p >= t counting as positive."""
    t = F.lit(threshold) if isinstance(threshold, float) else threshold
    out = df.groupBy(*by).agg(tpr(t).alias("tpr"), fpr(t).alias("fpr"))
    return out.withColumn("bacc", (F.col("tpr") + 1 - F.col("fpr")) / 2)


def roc_vertices(df: DataFrame, by: By = ()) -> DataFrame:
    """(by, p, tps, fps): the points of the ROC curve, by falling score, without those on a straight line between their neighbours."""
    d = cumulative(distinct_scores(df, by), by, columns=("pos", "neg"), descending=True)
    d = d.select(*by, "p", (F.col("pos_before") + F.col("pos")).alias("tps"), (F.col("neg_before") + F.col("neg")).alias("fps"))
    w = Window.partitionBy(*by).orderBy(F.col("p").desc())
    near = {f"{c}{k}": (F.lag if k == "0" else F.lead)(c).over(w) for c in ("tps", "fps") for k in "01"}
    bend = lambda c: F.col(f"{c}1") - 2 * F.col(c) + F.col(f"{c}0") != 0
    return d.withColumns(near).filter(F.col("tps0").isNull() | F.col("tps1").isNull() | bend("tps") | bend("fps")).select(*by, "p", "tps", "fps")


def best_balanced_threshold(df: DataFrame, by: By = ()) -> DataFrame:
    """(by, threshold): the middle between the highest best vertex and the vertex below the lowest best one."""
    v = roc_vertices(df, by)
    every = Window.partitionBy(*by)
    v = v.withColumn("bacc", (F.col("tps") / F.max("tps").over(every) + 1 - F.col("fps") / F.max("fps").over(every)) / 2)
    v = v.withColumn("best", F.col("bacc") >= F.max("bacc").over(every) - 1e-12)
    v = v.withColumn("low", F.min(F.when(F.col("best"), F.col("p"))).over(every))
    out = v.groupBy(*by).agg(F.max(F.when(F.col("best"), F.col("p"))).alias("upper"), F.max(F.when(F.col("p") < F.col("low"), F.col("p"))).alias("below"), F.min("p").alias("least"))
    return out.select(*by, F.round((F.col("upper") + F.coalesce("below", F.least("least", "upper"))) / 2, 9).alias("threshold"))


def quantile(df: DataFrame, q: float, by: By = (), name: str = "value", p: str = "p") -> DataFrame:
    """(by, name): the exact quantile of p with linear interpolation, from counts of equal values and their running sums."""
    d = cumulative(df.groupBy(*by, p).agg(F.count(F.lit(1)).alias("neg")), by, p=p)
    n = d.groupBy(*by).agg(F.sum("neg").alias("_n"))
    d = d.join(F.broadcast(n), [*by]) if by else d.crossJoin(F.broadcast(n))  # one row a group
    at = F.lit(q) * (F.col("_n") - 1)
    holds = lambda k: (F.col("neg_before") <= k) & (k < F.col("neg_before") + F.col("neg"))
    k = F.floor(at)
    out = d.groupBy(*by).agg(F.max(F.when(holds(k), F.col(p))).alias("_lo"), F.max(F.when(holds(F.least(k + 1, F.col("_n") - 1)), F.col(p))).alias("_hi"), F.max(at - k).alias("_f"))
    return out.select(*by, (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_f")).alias(name))


def sweep(df: DataFrame, thresholds: Sequence[float], by: By = ()) -> DataFrame:
    """(by, threshold, tp, fp, fn, fpr, tpr, f1) for each threshold.

    The rows are counted once by the threshold that they just reach; sums over the (few) thresholds do the rest.
    """
    ts = F.array(*[F.lit(float(t)) for t in thresholds])
    reached = F.size(F.filter(ts, lambda t: t <= F.col("p")))
    counts = df.groupBy(*by, reached.alias("k")).agg(F.sum(F.col("y").cast("long")).alias("pos"), F.sum(1 - F.col("y").cast("long")).alias("neg"))
    grid = F.posexplode(ts).alias("i", "threshold")
    sums = counts.select(*by, "k", "pos", "neg", grid).groupBy(*by, "i", "threshold").agg(
        F.sum(F.when(F.col("k") > F.col("i"), F.col("pos")).otherwise(0)).alias("tp"), F.sum(F.when(F.col("k") > F.col("i"), F.col("neg")).otherwise(0)).alias("fp"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg")
    )
    fn = F.col("n_pos") - F.col("tp")
    return sums.select(
        *by, "threshold", "tp", "fp", fn.alias("fn"), F.round(F.try_divide("fp", "n_neg"), 6).alias("fpr"), F.round(F.try_divide("tp", "n_pos"), 6).alias("tpr"),
        F.round(2.0 * F.col("tp") / F.greatest(F.lit(1), 2 * F.col("tp") + F.col("fp") + fn), 6).alias("f1"),
    )


def against_all_reals(df: DataFrame, group: str, by: By = ()) -> DataFrame:
    """(by, group, n, auc): each group's positives against the negatives of all groups, without repeating those.

    A positive's share is the part of the negatives below it (ties half); a group's AUC is the mean share of its own.
    """
    reals = cumulative(df.filter("y = 0").groupBy(*by, "p").agg(F.count(F.lit(1)).alias("neg")), by)
    both = df.filter("y = 1").groupBy(*by, group, "p").agg(F.count(F.lit(1)).alias("pos"))
    points = both.select(*by, "p").distinct().join(reals.select(*by, "p", "neg"), [*by, "p"], "full").select(*by, "p", F.coalesce("neg", F.lit(0)).alias("neg"))
    at = cumulative(points, by)
    total = reals.groupBy(*by).agg(F.sum("neg").alias("n_neg"))
    s = both.join(at, [*by, "p"]).groupBy(*by, group).agg(F.sum("pos").alias("n"), F.sum(F.col("pos") * (2 * F.col("neg_before") + F.col("neg"))).alias("s"))
    s = s.join(total, [*by]) if by else s.crossJoin(F.broadcast(total))  # one row
    return s.select(*by, group, "n", F.round(F.col("s") / (2.0 * F.col("n") * F.col("n_neg")), 6).alias("auc"))

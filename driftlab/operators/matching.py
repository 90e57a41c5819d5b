"""Coarsened exact matching: classes are compared within strata of what must not decide, such as size and shape.

Rows of class 1 weigh 1; rows of class 0 weigh so much that each stratum holds the classes in the proportion of all matched
rows. Strata with one class alone have no counterpart: their rows weigh 0 and are reported, not dropped. Null strata values
are values; rows without a class weigh 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlab.operators import metrics as M

BROADCAST_STRATA = 100_000


def strata_of(rows: DataFrame, strata: Sequence[str], y: str = "y") -> DataFrame:
    """(strata, n_pos, n_neg, matched): a row a stratum."""
    per = rows.groupBy(*strata).agg(F.count_if(F.col(y) == 1).alias("n_pos"), F.count_if(F.col(y) == 0).alias("n_neg"))
    return per.withColumn("matched", (F.col("n_pos") > 0) & (F.col("n_neg") > 0))


def weigh(rows: DataFrame, strata: Sequence[str], y: str = "y", name: str = "weight") -> DataFrame:
    """rows with their weights; a hot stratum meets a small side, which is broadcast only if it is counted small."""
    per = strata_of(rows, strata, y).filter("matched")
    total = per.agg(F.sum("n_pos").alias("_p"), F.sum("n_neg").alias("_n"))  # one row
    per = per.crossJoin(F.broadcast(total)).select(*[F.col(c).alias(f"_s{i}") for i, c in enumerate(strata)], (F.col("n_pos") / F.col("n_neg") * (F.col("_n") / F.col("_p"))).alias("_w"))
    per = F.broadcast(per) if per.limit(BROADCAST_STRATA + 1).count() <= BROADCAST_STRATA else per
    match = F.lit(True)
    for i, c in enumerate(strata):
        match = match & F.col(c).eqNullSafe(F.col(f"_s{i}"))
    out = rows.join(per, match, "left")
    weight = F.when(F.col("_w").isNull() | F.col(y).isNull(), F.lit(0.0)).when(F.col(y) == 1, F.lit(1.0)).otherwise(F.col("_w"))
    return out.withColumn(name, weight).drop("_w", *[f"_s{i}" for i in range(len(strata))])


def probe_auc(rows: DataFrame, probes: Sequence[str], y: str = "y", weight: str = "weight") -> DataFrame:
    """(probe, auc_before, auc_after): how well each probe alone, a number from 0 to 1, tells the classes apart without and with the weights."""
    long = rows.select(F.col(y).alias("y"), F.col(weight).alias("w"), F.explode(F.create_map(*[x for c in probes for x in (F.lit(c), F.round(F.col(c).cast("double"), 12))])).alias("probe", "p"))
    long = long.filter(F.col("p").isNotNull() & F.col("y").isNotNull())
    sides = lambda w: (F.sum(F.when(F.col("y") == 1, w).otherwise(F.lit(0.0))).alias("pos"), F.sum(F.when(F.col("y") == 0, w).otherwise(F.lit(0.0))).alias("neg"))
    auc = lambda w, name: M.auc_of_counts(long.groupBy("probe", "p").agg(*sides(w)), ["probe"]).select("probe", F.round("auc", 6).alias(name))
    return auc(F.lit(1.0), "auc_before").join(auc(F.col("w"), "auc_after"), "probe")

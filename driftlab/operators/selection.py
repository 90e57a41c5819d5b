"""Row selection, calibration and intervals: rules on manifests and scored rows that more than one report needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The distribution function of a Poisson variable of mean 1 at 0, 1, 2, ...
POISSON = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183)


def prefix(df: DataFrame, order: str, limit: int) -> DataFrame:
    """The first ``limit`` rows in an order: never a bare limit, so that reruns agree."""
    return df.orderBy(F.col(order).asc_nulls_last()).limit(limit)


def seeded_sample(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows without replacement: those that come first by a hash of seed and key (each task sends n rows at most)."""
    draw = F.sha1(F.concat(F.lit(f"{seed}::"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"))
    return df.withColumn("_draw", draw).orderBy("_draw", F.col(key).asc_nulls_last()).limit(n).drop("_draw")


def select_rows(df: DataFrame, order: str, key: str, limit: int | None = None, sample: int | None = None, seed: int = 0) -> DataFrame:
    """A sample if one is asked for, else a prefix, else all rows."""
    if sample is not None:
        return seeded_sample(df, key, sample, seed)
    return df if limit is None else prefix(df, order, limit)


def relabelled(df: DataFrame, label: int, source: str, generator: str | None) -> DataFrame:
    """The rows of one label under another source and generator."""
    return df.filter(F.col("label") == label).withColumns({"source": F.lit(source), "generator": F.lit(generator).cast("string")})


def existing(df: DataFrame, listing: DataFrame, path: str = "image_path", listed: str = "path") -> DataFrame:
    """Rows whose file is in a listing."""
    return df.join(listing.select(F.col(listed).alias("_listed")), F.col(path) == F.col("_listed"), "left_semi")


def concat_blocks(blocks: list[DataFrame], order: list[str]) -> DataFrame:
    """Blocks one after another, each in its order: the column ``block`` comes first in the result's order."""
    out = None
    for i, b in enumerate(blocks):
        b = b.withColumn("block", F.lit(i))
        out = b if out is None else out.unionByName(b)
    return out.orderBy("block", *order)


def brier(p: str = "p", y: str = "y") -> Column:
    return F.avg((F.col(p) - F.col(y)) * (F.col(p) - F.col(y)))


def log_loss(p: str = "p", y: str = "y", least: float = 1e-12) -> Column:
    q = F.greatest(F.lit(least), F.least(F.lit(1 - least), F.col(p)))
    return F.avg(-F.log(F.when(F.col(y) == 1, q).otherwise(1 - q)))


def poisson_weights(key: str, replicates: int, seed: str = "boot") -> Column:
    """For each replicate how often it draws a row: Poisson counts of mean 1 from a hash of the replicate and the row."""

    def weight(b: Column) -> Column:
        h = F.sha1(F.concat(F.lit(seed + "::"), b.cast("string"), F.lit("::"), F.col(key)).cast("binary"))
        u = F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
        out = F.lit(0)
        for c in POISSON:
            out = out + (u >= F.lit(c)).cast("int")
        return out

    return F.transform(F.sequence(F.lit(0), F.lit(replicates - 1)), weight)

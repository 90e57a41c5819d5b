"""Frames, numbers and neighbours over keys of any length.

Rows are dealt by ranges of key and order, so that a key's rows may lie in many partitions; what a range needs of those
beside it travels apart: numbers of rows and sums as offsets, the last rows of a chunk as a halo, the last and the first
reading of a range as carries. No task holds a key. Null keys are one key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftlab.sources.files import checkpoint_folder

CHUNK = 10_000


def _dealt(df: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """df with _part, its range; written once, as ranges are sampled anew whenever they are made."""
    dealt = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    path, schema = checkpoint_folder(df.sparkSession, "ranges"), dealt.schema
    dealt.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def _joined(df: DataFrame, other: DataFrame, on: Sequence[str]) -> DataFrame:
    """A left join on columns that may be null; other has no more columns of df's than these."""
    other = other.withColumnsRenamed({c: f"_on{i}" for i, c in enumerate(on)})
    match = F.lit(True)
    for i, c in enumerate(on):
        match = match & F.col(c).eqNullSafe(F.col(f"_on{i}"))
    return df.join(other, match, "left").drop(*[f"_on{i}" for i in range(len(on))])


def numbered(df: DataFrame, key: Sequence[str], order: Sequence[str], name: str = "n") -> DataFrame:
    """df with a number from 0 for each row among those of its key, in an order that tells them apart."""
    dealt = _dealt(df, [*key, *order])
    per = dealt.groupBy("_part", *key).agg(F.count(F.lit(1)).alias("_rows"))
    earlier = Window.partitionBy(*key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range and key
    per = per.withColumn("_before", F.sum("_rows").over(earlier)).filter("_before > 0").drop("_rows")  # at most one key of a range has rows before it
    inside = Window.partitionBy("_part", *key).orderBy(*order)
    out = _joined(dealt, F.broadcast(per), ["_part", *key])
    return out.withColumn(name, F.row_number().over(inside) - 1 + F.coalesce("_before", F.lit(0))).drop("_part", "_before")


def trailing(df: DataFrame, key: Sequence[str], order: Sequence[str], columns: dict[str, Column], size: int = 100) -> DataFrame:
    """df with aggregates over each row and the size - 1 before it: a key's rows go in chunks, each of which takes over the last rows of the one before."""
    length = max(CHUNK, size)
    rows = numbered(df, key, order, "__n").withColumn("__chunk", F.floor(F.col("__n") / length))
    both = F.when(F.col("__n") % length > length - size, F.array(F.col("__chunk"), F.col("__chunk") + 1)).otherwise(F.array("__chunk"))
    rows = rows.withColumn("__of", F.explode(both))
    frame = Window.partitionBy(*key, "__of").orderBy("__n").rowsBetween(1 - size, 0)
    return rows.withColumns({c: f.over(frame) for c, f in columns.items()}).filter("__of = __chunk").drop("__n", "__chunk", "__of")


def cumulative(df: DataFrame, key: Sequence[str], order: Sequence[str], columns: dict[str, Column]) -> DataFrame:
    """df with running sums over its key: sums of the chunks before, then within the chunk."""
    rows = numbered(df, key, order, "__n").withColumn("__chunk", F.floor(F.col("__n") / CHUNK))
    per = rows.groupBy(*key, "__chunk").agg(*[F.sum(c).alias(f"_s{i}") for i, c in enumerate(columns.values())])
    earlier = Window.partitionBy(*key).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)  # a row a chunk
    per = per.select(*key, "__chunk", *[F.sum(f"_s{i}").over(earlier).alias(f"_b{i}") for i in range(len(columns))]).filter("__chunk > 0")
    inside = Window.partitionBy(*key, "__chunk").orderBy("__n").rowsBetween(Window.unboundedPreceding, 0)
    out = _joined(rows, per, [*key, "__chunk"])
    made = {name: F.coalesce(F.col(f"_b{i}"), F.lit(0)) + F.coalesce(F.sum(c).over(inside), F.lit(0)) for i, (name, c) in enumerate(columns.items())}
    return out.withColumns(made).drop("__n", "__chunk", *[f"_b{i}" for i in range(len(columns))])


def filled(df: DataFrame, key: Sequence[str], order: Sequence[str], column: str, name: str) -> DataFrame:
    """df with name: the last value of a column that is not null, up to each row of its key."""
    dealt = _dealt(df, [*key, *order])
    per = dealt.groupBy("_part", *key).agg(F.max_by(column, F.when(F.col(column).isNotNull(), F.struct(*order))).alias("_last"))
    earlier = Window.partitionBy(*key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range and key
    per = per.withColumn("_carry", F.last("_last", ignorenulls=True).over(earlier)).filter("_carry IS NOT NULL").drop("_last")  # at most one key a range
    inside = Window.partitionBy("_part", *key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = _joined(dealt, F.broadcast(per), ["_part", *key])
    return out.withColumn(name, F.coalesce(F.last(column, ignorenulls=True).over(inside), F.col("_carry"))).drop("_part", "_carry")


def neighbours(left: DataFrame, right: DataFrame, at: str, take: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """left with before and after: of right's rows of the same key, the place and ``take`` of the last at or before its own place, and of the first beyond.

    Of right's rows at one place the one with the least ``take`` counts. A left row without a place has no neighbours.
    """
    kinds = dict(left.dtypes)
    readings = right.filter(F.col(at).isNotNull()).groupBy(*by, F.col(at).cast(kinds[at]).alias(at)).agg(F.min(F.struct(*take)).alias("_t"))
    reading = F.struct(F.col(at).alias(at), *[F.col(f"_t.{c}").alias(c) for c in take if c != at])
    readings = readings.select(*by, F.col(at).alias("_at"), reading.alias("_r"), F.lit(0).alias("_kind"), F.lit(None).cast(left.schema.simpleString()).alias("_row"))
    rows = left.select(*by, F.col(at).alias("_at"), F.lit(None).cast(dict(readings.dtypes)["_r"]).alias("_r"), F.lit(1).alias("_kind"), F.struct(*left.columns).alias("_row"))
    # the hash lets ranges part rows of one place, however many
    dealt = _dealt(readings.unionByName(rows).withColumn("_h", F.xxhash64("_row")), [*by, "_at", "_kind", "_h"])
    per = dealt.groupBy("_part", *by).agg(F.max("_r").alias("_last"), F.min("_r").alias("_first"))
    ranges = Window.partitionBy(*by)
    seen = lambda c, way: F.last(c, ignorenulls=True).over(ranges.orderBy(way).rowsBetween(Window.unboundedPreceding, -1))  # noqa: E731  a row a range and key
    per = per.select("_part", *by, F.count(F.lit(1)).over(ranges).alias("_parts"), seen("_last", F.col("_part").asc()).alias("_carry"), seen("_first", F.col("_part").desc()).alias("_next"))
    per = per.filter("_parts > 1").drop("_parts")  # fewer than twice as many as ranges
    inside = Window.partitionBy("_part", *by)
    found = dealt.withColumns({
        "_b": F.last("_r", ignorenulls=True).over(inside.orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)),
        # from the far end, as a frame of all that follows is read anew for every row
        "_a": F.last("_r", ignorenulls=True).over(inside.orderBy(F.col("_at").desc(), F.col("_kind").desc()).rowsBetween(Window.unboundedPreceding, -1)),
    }).filter("_kind = 1")
    out = _joined(found, F.broadcast(per), ["_part", *by])
    placed = lambda *cs: F.when(F.col("_at").isNotNull(), F.coalesce(*cs))
    return out.select("_row.*", placed("_b", "_carry").alias("before"), placed("_a", "_next").alias("after"))


def nearest(left: DataFrame, right: DataFrame, at: str, take: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """left with nearest, (at, *take) of the row of right that is nearest in its key, and before and after; of two as near the one before."""
    out = neighbours(left, right, at, take, by)
    b, a, x = F.col(f"before.{at}"), F.col(f"after.{at}"), F.col(at)
    return out.withColumn("nearest", F.when(a.isNull() | (x - b <= a - x), F.col("before")).otherwise(F.col("after")))

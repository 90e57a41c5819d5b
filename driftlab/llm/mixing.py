"""Operator 10: mix sources to target weights along a time-varying curriculum, with DataFrame functions only.

Each source has a weight and a schedule, a piecewise linear multiplier of that weight over training time 0..1. The
integral of the schedule is the source's demand for words up to a time. Its documents, in the order of a hash, are
laid end to end (again from the first while the target exceeds the source); a document's training position is the
time at which the demand reaches its middle word: the inverse of the integral. Documents are range-sorted by it.

Targets: the words of all sources are shared by weight; no source gets over ``max_repeat`` times its size, and the
excess is shared anew among the others by weight. With sources sorted by (limit / weight), the common level is found
in one pass of running sums over one row per source. Running sums are made in two steps, over ranges of the order and
within each range, so that neither many sources nor a large one are ever in one task.

Rows of one source that agree in id and size can't be told apart in the result, so they are counted and laid end to
end together: null ids, or an id that is repeated, make no hot key. They become rows again in blocks of ``BLOCK_ROWS``,
which are dealt out before, so that neither an array nor a task holds all that agree.

Defined results: a null text has size 0; a null source is a source of its own, the last; null ids, repeated ids and
repeated rows are rows of their own; a source without words has target 0; documents of which nothing is taken have
no positions and are sorted after the others; an empty table gives no rows. Input columns other than the id, the
source and the text are not carried, so clashing names don't matter.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
#: For each weight in turn, knots (time, multiplier): what weighs most is shown early, what weighs least late.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (1.0, 1.5)))
BUCKET_ROWS, BLOCK_ROWS = 4096, 10_000
BROADCAST_SOURCES, SALTS = 100_000, 32


def _pieces(knots: Sequence[tuple[float, float]]) -> list[tuple[float, float, float, float]]:
    """(share of the integral before the piece, start, width, ...) so that demand(t) = before + a*u + b*u*u, u = t - start."""
    area = sum((t1 - t0) * (m0 + m1) / 2 for (t0, m0), (t1, m1) in zip(knots, knots[1:]))
    out, before = [], 0.0
    for (t0, m0), (t1, m1) in zip(knots, knots[1:]):
        out.append((before, t0, m0 / area, (m1 - m0) / (t1 - t0) / 2 / area))
        before += (t1 - t0) * (m0 + m1) / 2 / area
    return out


def invert(share: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """The time at which the integral of the schedule reaches the share (0 to 1) of its total."""
    out = None
    for before, start, a, b in _pieces(knots):
        need = share - F.lit(before)
        u = need / F.lit(a) if abs(b) < 1e-12 else (F.sqrt(F.greatest(F.lit(a * a) + F.lit(4 * b) * need, F.lit(0.0))) - F.lit(a)) / F.lit(2 * b)
        at = F.lit(start) + u
        out = at if out is None else F.when(share >= F.lit(before), at).otherwise(out)
    return out


def running(df: DataFrame, order: Sequence[str], sums: Sequence[str], name: str) -> DataFrame:
    """df with the columns ``upto_<x>``: sums of x over all rows up to each in the order, which must be without ties and nulls."""
    rows = cut(df.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), name)
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    ranges = rows.groupBy("range").agg(*[F.sum(x).alias(x) for x in sums])
    ranges = ranges.select("range", *[F.coalesce(F.sum(x).over(before), F.lit(0)).alias(f"before_{x}") for x in sums])
    inside = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = rows.join(F.broadcast(ranges), "range").withColumns({f"upto_{x}": F.col(f"before_{x}") + F.sum(x).over(inside) for x in sums})
    return out.drop("range", *[f"before_{x}" for x in sums])


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, max_repeat: int = 3) -> DataFrame:
    """sizes: one row per source (source, source_size, n_docs). Adds rank, weight and target."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    n = len(weights)
    named = sizes.withColumns({"no_source": F.col("source").isNull(), "name": F.coalesce("source", F.lit("")), "one": F.lit(1).cast("long")})
    ranked = running(named, ["no_source", "name"], ["one"], "mix-ranks").withColumn("rank", F.col("upto_one") - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % n + 1).cast("int")))
    ranked = ranked.withColumn("most", (F.col("source_size") * max_repeat).cast("double")).withColumn("ratio", F.col("most") / F.col("weight"))
    ranked = running(ranked, ["ratio", "rank"], ["most", "weight"], "mix-levels")
    every = ranked.agg(F.sum("source_size").alias("total"), F.sum("weight").alias("weights"))
    left = F.col("weights") - (F.col("upto_weight") - F.col("weight"))
    full = ranked.crossJoin(F.broadcast(every)).withColumn("level", (F.col("total") - (F.col("upto_most") - F.col("most"))) / left)  # one row
    # limits are met from the smallest ratio up; the first source whose level stays below its ratio sets the level of the rest
    first = full.agg(F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "rank", "level"))).alias("first"))
    full = full.crossJoin(F.broadcast(first))  # one row
    return full.withColumn("target", F.coalesce(F.least(F.col("most"), F.col("first.level") * F.col("weight")), F.lit(0.0))).select("source", "source_size", "n_docs", "rank", "weight", "target")


def mix_sources(docs: DataFrame, weights: Sequence[float] = WEIGHTS, schedules: Sequence = SCHEDULES, max_repeat: int = 3, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(id, source, size, source_size, target, taken, passes, position, positions), range-sorted by position.

    ``taken`` words: whole passes over the document and, for the one document of a source in which its target ends,
    the part up to there; ``positions`` has one training time for each pass.
    """
    base = cut(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).alias("source"),
            F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).cast("binary")).alias("key"),
        ),
        "mix-sizes",
    )
    named = (F.col("source").isNull().alias("no_source"), F.coalesce("source", F.lit("")).alias("name"))
    targets = source_targets(base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs")), weights, max_repeat)
    targets = targets.select(*named, "source_size", "target", "rank", F.ceil(F.col("n_docs") / BUCKET_ROWS).alias("buckets"), F.round("target").cast("long").alias("words"))

    hashed = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    # rows that agree in all that the result tells are one, n times
    rows = base.groupBy("doc_id", "source", "size", "key").agg(F.count(F.lit(1)).alias("n")).select(*named, "doc_id", "source", "size", "key", "n", F.pmod(hashed, F.lit(SALTS)).cast("int").alias("salt"))
    # one row a source: sent to all executors if they are few enough, else to each of the parts that sources are dealt out in
    targets = cut(targets, "mix-targets")
    if targets.count() <= BROADCAST_SOURCES:
        ranged = rows.join(F.broadcast(targets), ["no_source", "name"])
    else:
        ranged = rows.join(targets.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["no_source", "name", "salt"])

    # a running sum in two steps, so that no task sorts a whole source: first over ranges of the hash, then within each range
    ranged = ranged.withColumn("bucket", F.shiftright(hashed * F.col("buckets"), 32)).withColumn("words_here", F.col("size") * F.col("n"))
    place = ["no_source", "name", "bucket"]
    sums = ranged.groupBy(*place).agg(F.sum("words_here").alias("in_bucket"))
    before = sums.select(*place, (F.sum("in_bucket").over(Window.partitionBy("no_source", "name").orderBy("bucket")) - F.col("in_bucket")).alias("before"))
    inside = Window.partitionBy(*place).orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cum = ranged.withColumn("upto", F.sum("words_here").over(inside)).join(before, place)
    block = F.lit(BLOCK_ROWS).cast("long")
    cum = cum.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / block)))).repartition("key", "size", "block")
    cum = cum.withColumn("nth", F.explode(F.sequence(F.col("block") * block, F.least(F.col("n"), (F.col("block") + 1) * block) - 1))).drop("block")
    cum = cum.withColumn("start", F.col("before") + F.col("upto") - F.col("words_here") + F.col("nth") * F.col("size"))

    whole = F.when(F.col("source_size") > 0, F.floor(F.col("words") / F.col("source_size"))).otherwise(F.lit(0))
    cum = cum.withColumn("whole", whole.cast("long")).withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), F.col("words") - F.col("whole") * F.col("source_size") - F.col("start"))))
    cum = cum.withColumn("taken", (F.col("whole") * F.col("size") + F.col("part")).cast("long")).withColumn("passes", F.when(F.col("size") > 0, F.col("whole") + (F.col("part") > 0).cast("long")).otherwise(F.lit(0)).cast("long"))

    def at(k: Column) -> Column:
        length = F.when(k < F.col("whole"), F.col("size")).otherwise(F.col("part"))
        share = (k * F.col("source_size") + F.col("start") + length / 2) / F.col("words")
        out = None
        for i, knots in enumerate(schedules):
            t = invert(share, knots)
            out = t if out is None else F.when(F.col("rank") % len(schedules) == i, t).otherwise(out)
        return F.round(out, 9)

    cum = cum.withColumn("positions", F.when(F.col("passes") > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col("passes") - 1), at)))
    cum = cum.withColumn("position", F.try_element_at("positions", F.lit(1)))
    order = F.coalesce(F.col("position"), F.lit(1) + hashed / F.lit(float(1 << 32)))
    return cum.select("doc_id", "source", "size", "source_size", "target", "taken", "passes", "position", "positions", order.alias("sort_key")).orderBy("sort_key", "doc_id").drop("sort_key")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "passes", "position")


def mix_sql(docs: str = "documents") -> str:
    return rf"""
WITH base AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, 'null')) AS k FROM {docs}),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM base GROUP BY source),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS rnk FROM src),
weighed AS (
  SELECT *, [5.0, 2.0, 1.0][(rnk % 3 + 1)::INT]::DOUBLE AS w, (source_size * 3)::DOUBLE AS most FROM ranked),
levels AS (
  SELECT *, most / w AS ratio,
    ((sum(source_size) OVER ())::DOUBLE - (sum(most) OVER o - most)) / ((sum(w) OVER ()) - (sum(w) OVER o - w)) AS lvl
  FROM weighed WINDOW o AS (ORDER BY most / w, rnk ROWS UNBOUNDED PRECEDING)),
tgt AS (
  SELECT *, coalesce(least(most, (SELECT arg_min(lvl, (ratio, rnk)) FROM levels WHERE lvl <= ratio) * w), 0.0) AS target FROM levels),
cum AS (
  SELECT b.doc_id, b.size, t.source_size, t.target, t.rnk, round(t.target)::BIGINT AS words,
    sum(b.size) OVER (PARTITION BY b.source ORDER BY b.k, b.doc_id, b.size ROWS UNBOUNDED PRECEDING) - b.size AS start_at
  FROM base b JOIN tgt t ON b.source IS NOT DISTINCT FROM t.source),
parts AS (
  SELECT *, CASE WHEN source_size > 0 THEN words // source_size ELSE 0 END AS whole FROM cum),
took AS (
  SELECT *, greatest(0, least(size, words - whole * source_size - start_at)) AS part FROM parts),
shares AS (
  SELECT *, (start_at + (CASE WHEN whole > 0 THEN size ELSE part END) / 2) / words AS share FROM took)
SELECT doc_id, size, source_size, target, (whole * size + part)::BIGINT AS taken,
  (CASE WHEN size > 0 THEN whole + (part > 0)::INT ELSE 0 END)::BIGINT AS passes,
  CASE WHEN size > 0 AND whole + (part > 0)::INT > 0 THEN round(CASE rnk % 3
    WHEN 0 THEN (sqrt(greatest(2.25 - 2.0 * share, 0.0)) - 1.5) / -1.0
    WHEN 1 THEN share
    ELSE (sqrt(greatest(0.25 + 2.0 * share, 0.0)) - 0.5) / 1.0 END, 9) END AS position
FROM shares"""


SQL = mix_sql()

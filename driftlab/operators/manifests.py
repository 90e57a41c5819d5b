"""Manifest algebra: union, keep-first deduplication, backfill, filters, caps, splits, samples, hold-outs, leakage."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COLUMNS = ("image_path", "label", "source")


def check_columns(df: DataFrame, needed: Sequence[str] = COLUMNS) -> DataFrame:
    missing = [c for c in needed if c not in df.columns]
    if missing:
        raise ValueError(f"manifest lacks columns: {missing}")
    return df


def draw(seed: str, *keys: str) -> Column:
    """A hash by which rows are drawn: the same draw wherever and in whatever order the rows are."""
    return F.sha1(F.concat_ws("::", F.lit(seed), *[F.col(k).cast("string") for k in keys]).cast("binary"))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def union_manifests(*frames: DataFrame) -> DataFrame:
    """All rows of manifests that may lack columns of each other, each with its place ``part``."""
    out = None
    for i, f in enumerate(frames):
        f = f.withColumn("part", F.lit(i))
        out = f if out is None else out.unionByName(f, allowMissingColumns=True)
    return out


def keep_first(df: DataFrame, key: str, order: Sequence[str | Column]) -> DataFrame:
    """One row for each key, the first by order. The rank limit is applied before the shuffle, so a hot key costs a row a task."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def backfill_generator(df: DataFrame, known: Mapping[tuple[str, int], str]) -> DataFrame:
    """Null generators from (source, label), else 'unknown'."""
    if not known:
        return df.withColumn("generator", F.coalesce("generator", F.lit("unknown")))
    pairs = F.create_map(*[F.lit(x) for (s, y), g in known.items() for x in (f"{s}\0{y}", g)])
    return df.withColumn("generator", F.coalesce(F.col("generator"), F.try_element_at(pairs, F.concat(F.col("source"), F.lit("\0"), F.col("label").cast("string"))), F.lit("unknown")))


def exclude_sources(df: DataFrame, sources: Iterable[str]) -> DataFrame:
    sources = list(sources)
    return df.filter(~F.col("source").isin(sources)) if sources else df


def exclude_generators(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Without the named generators, whatever their case and blanks; a manifest without that column raises."""
    check_columns(df, ("generator",))
    names = sorted({n.strip().lower() for n in names})
    return df.filter(~F.lower(F.trim("generator")).isin(names)) if names else df


def ranked(df: DataFrame, by: Sequence[str], seed: str, key: str = "image_path") -> Column:
    return F.row_number().over(Window.partitionBy(*by).orderBy(draw(seed, key), key))


def cap(df: DataFrame, by: Sequence[str], n: int, seed: str = "42", key: str = "image_path") -> DataFrame:
    """At most n rows of each group, drawn by hash; groups are cut to n rows before they are shuffled."""
    return df.withColumn("_rank", ranked(df, by, seed, key)).filter(F.col("_rank") <= n).drop("_rank")


def drawn_ranks(df: DataFrame, by: Sequence[str], seed: str, key: str = "image_path") -> DataFrame:
    """df with ``rank`` (from 1) by a hash within each group and the group's size ``n``; ranges of the hash first, so no task orders a whole group."""
    df = df.withColumn("_h", draw(seed, key)).withColumn("_b", F.substring("_h", 1, 2))
    b = df.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*by)
    b = b.select(*by, "_b", (F.sum("_c").over(w.orderBy("_b")) - F.col("_c")).alias("_before"), F.sum("_c").over(w).alias("n"))
    out = df.join(b, [*by, "_b"])
    return out.withColumn("rank", F.col("_before") + F.row_number().over(Window.partitionBy(*by, "_b").orderBy("_h", key))).drop("_h", "_b", "_before")


def stratified_split(df: DataFrame, fraction: float = 0.15, seed: str = "42") -> DataFrame:
    """df with split 'val' or 'train' by (source, label); strata of one row go to train."""
    r = drawn_ranks(df, ("source", "label"), seed)
    return r.withColumn("split", F.when((F.col("n") >= 2) & (F.col("rank") <= F.round(F.col("n") * fraction)), F.lit("val")).otherwise(F.lit("train"))).drop("rank", "n")


def hold_out(df: DataFrame, generators: Iterable[str]) -> DataFrame:
    """Training rows of the given generators move to val; rows that are there stay."""
    return df.withColumn("split", F.when(F.col("generator").isin(list(generators)), F.lit("val")).otherwise(F.col("split")))


def sample_allocation(sizes: DataFrame, n: int) -> DataFrame:
    """(label, source, size, k): rows to draw so that each label gets n // 2, each source its proportional share rounded down, and what is left over goes to the largest source with room, then the next."""
    every = Window.partitionBy("label")
    order = every.orderBy(F.col("size").desc(), "source").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    s = sizes.withColumn("all", F.sum("size").over(every)).withColumn("want", F.least(F.lit(n // 2), F.col("all")))
    s = s.withColumn("share", F.floor(F.col("size") * F.col("want") / F.col("all"))).withColumn("room", F.col("size") - F.col("share"))
    s = s.withColumn("left", F.col("want") - F.sum("share").over(every)).withColumn("above", F.sum("room").over(order) - F.col("room"))
    return s.select("label", "source", "size", (F.col("share") + F.greatest(F.lit(0), F.least(F.col("left") - F.col("above"), F.col("room")))).cast("long").alias("k"))


def stratified_sample(df: DataFrame, n: int, seed: str = "42") -> DataFrame:
    """About n rows, half of each label, spread over sources in proportion; all rows if there are no more than n."""
    sizes = df.groupBy("label", "source").agg(F.count(F.lit(1)).alias("size"))
    k = sample_allocation(sizes, n).select("label", "source", "k", (F.sum("size").over(Window.partitionBy()) <= n).alias("all_rows"))
    r = drawn_ranks(df, ("label", "source"), seed).join(k, ["label", "source"])
    return r.filter(F.col("all_rows") | (F.col("rank") <= F.col("k"))).drop("rank", "n", "k", "all_rows")


def balance(df: DataFrame, seed: str = "42") -> DataFrame:
    """Reals (label 0) drawn down to the number of generated rows."""
    fakes = df.filter("label = 1").agg(F.count(F.lit(1)).alias("fakes"))
    r = drawn_ranks(df, ("label",), seed).crossJoin(F.broadcast(fakes))  # one row
    return r.filter((F.col("label") == 1) | (F.col("rank") <= F.col("fakes"))).drop("rank", "n", "fakes")


def leaked(df: DataFrame, other: DataFrame, key: Column | None = None) -> DataFrame:
    """Rows of df whose file name (or key) is in other too."""
    key = basename(F.col("image_path")) if key is None else key
    return df.withColumn("_key", key).join(other.select(key.alias("_key")).distinct(), "_key", "left_semi").drop("_key")


def require_disjoint(df: DataFrame, other: DataFrame) -> DataFrame:
    if not leaked(df, other).isEmpty():
        raise ValueError("rows of one set are in the other")
    return df


def recover_labels(df: DataFrame, labels: DataFrame, key: str = "image_path") -> DataFrame:
    """Labels joined by path; a row without one raises: labels are never guessed."""
    out = df.drop("label").join(labels.select(key, "label"), key, "left")
    if not out.filter("label IS NULL").isEmpty():
        raise ValueError("rows without a known label")
    return out


def fingerprint(df: DataFrame, by: Sequence[str] = (), path: str = "image_path") -> DataFrame:
    """(by, n_rows, fingerprint): a hash of all paths of a group in order.

    SHA-1 over the SHA-1 sums of ranges of the ordered paths: a range has the paths with the same first two digits of
    their own hash, so no task holds a group's paths, and any row that is added, lost or changed shows.
    """
    h = F.sha1(F.col(path).cast("binary"))
    parts = df.groupBy(*by, F.substring(h, 1, 2).alias("_b")).agg(F.count(F.lit(1)).alias("_n"), F.sha1(F.concat(F.array_join(F.array_sort(F.collect_list(path)), "\n"), F.lit("\n")).cast("binary")).alias("_h"))
    order = F.transform(F.array_sort(F.collect_list(F.struct("_b", "_h"))), lambda x: x["_h"])
    return parts.groupBy(*by).agg(F.sum("_n").alias("n_rows"), F.sha1(F.concat(F.array_join(order, "\n"), F.lit("\n")).cast("binary")).alias("fingerprint"))

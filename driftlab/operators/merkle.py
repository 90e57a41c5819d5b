"""Merkle trees over manifests: one fingerprint of all rows, and a diff that looks only where two manifests are unlike.

A row's place in the tree is its path's SHA-1, sixteen children a node; the depth follows the number of rows, so that a leaf has
LEAF_ROWS of them or fewer on average. A leaf is the sum of its rows' hashes, word by word, and their number, which Spark adds
up without any list, so that equal paths, however many, make no large row; an inner node is the SHA-1 of its children's hashes,
in order: sixteen at most. The diff goes down both trees level by level and joins the rows below unequal leaves only.
Null paths are one path; repeated rows count, the order of the rows does not (see manifests.fingerprint for ordered ones).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlab.sources.files import checkpoint_folder

LEAF_ROWS, MOST_LEVELS = 256, 10
BROADCAST_LEAVES = 100_000
_WORDS = 5


def depth_of(rows: int) -> int:
    depth = 0
    while rows > LEAF_ROWS * 16**depth and depth < MOST_LEVELS:
        depth += 1
    return depth


def _place(path: str, depth: int) -> Column:
    return F.substring(F.sha1(F.coalesce(F.concat(F.lit("p"), F.col(path).cast("string")), F.lit("-")).cast("binary")), 1, depth)


def _sums(columns: Sequence[str]) -> list[Column]:
    h = F.sha1(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).cast("binary"))
    return [F.sum(F.conv(F.substring(h, 8 * i + 1, 8), 16, 10).cast("long")).alias(f"w{i}") for i in range(_WORDS)]


def _summed() -> Column:
    return F.sha1(F.concat_ws(",", "n", *[f"w{i}" for i in range(_WORDS)]).cast("binary"))


def _written(df: DataFrame, name: str) -> DataFrame:
    path, schema = checkpoint_folder(df.sparkSession, name), df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def tree(rows: DataFrame, path: str, columns: Sequence[str], depth: int | None = None) -> DataFrame:
    """(level, node, hash, n): the leaves of ``depth`` and all nodes above; columns: what makes a row, its path too."""
    depth = depth_of(rows.count()) if depth is None else depth
    leaves = rows.groupBy(_place(path, depth).alias("node")).agg(F.count(F.lit(1)).alias("n"), *_sums(columns))
    out = now = _written(leaves.select(F.lit(depth).alias("level"), "node", _summed().alias("hash"), "n"), "leaves")
    for level in range(depth - 1, -1, -1):
        children = F.array_sort(F.collect_list(F.struct("node", "hash")))  # sixteen at most
        now = now.groupBy(F.substring("node", 1, level).alias("node")).agg(children.alias("c"), F.sum("n").alias("n"))
        now = now.select(F.lit(level).alias("level"), "node", F.sha1(F.concat_ws(",", F.transform("c", lambda x: F.concat(x["node"], F.lit(":"), x["hash"]))).cast("binary")).alias("hash"), "n")
        now = _written(now, "nodes")
        out = out.unionByName(now)
    return out


def root(nodes: DataFrame) -> str | None:
    r = nodes.filter("level = 0").first()
    return r["hash"] if r else None


def diff(a: DataFrame, b: DataFrame, path: str, columns: Sequence[str]) -> DataFrame:
    """(path, kind): rows of b that a has not (added), of a that b has not (lost), and of both with other contents (changed)."""
    depth = depth_of(max(a.count(), b.count()))
    one, two = tree(a, path, columns, depth), tree(b, path, columns, depth)
    unlike = None
    for level in range(depth + 1):
        x, y = (t.filter(F.col("level") == level).select("node", "hash") for t in (one, two))
        if unlike is not None:  # only below nodes that differ
            up = F.substring("node", 1, level - 1)
            x, y = (t.withColumn("_up", up).join(unlike.withColumnRenamed("node", "_up"), "_up", "left_semi").drop("_up") for t in (x, y))
        pairs = x.join(y.withColumnRenamed("hash", "other"), "node", "full")
        unlike = _written(pairs.filter(~F.col("hash").eqNullSafe(F.col("other"))).select("node"), "unlike")
        if unlike.isEmpty():
            break
    leaves = F.broadcast(unlike) if unlike.limit(BROADCAST_LEAVES + 1).count() <= BROADCAST_LEAVES else unlike

    def rows(df):
        below = df.withColumn("_node", _place(path, depth)).join(leaves.withColumnRenamed("node", "_node"), "_node", "left_semi")
        return below.groupBy(F.col(path).alias("path")).agg(F.count(F.lit(1)).alias("n"), *_sums(columns)).select("path", _summed().alias("hash"))

    x, y = rows(a), rows(b).withColumnsRenamed({"path": "path2", "hash": "other"})
    out = x.join(y, F.col("path").eqNullSafe(F.col("path2")), "full").filter(~F.col("hash").eqNullSafe(F.col("other")))
    kind = F.when(F.col("hash").isNull(), "added").when(F.col("other").isNull(), "lost").otherwise("changed")
    return out.select(F.when(F.col("hash").isNull(), F.col("path2")).otherwise(F.col("path")).alias("path"), kind.alias("kind"))


def stem_agreement(caches: DataFrame, path: str = "path") -> DataFrame:
    """(stem, views, fingerprints, odd): of rows (stem, view, path), how many different sets of paths a stem's views have, and the views unlike its clean one."""
    h = caches.groupBy("stem", "view").agg(F.count(F.lit(1)).alias("n"), *_sums([path])).select("stem", "view", _summed().alias("hash"))  # a row a view
    clean = h.filter("view = 'clean'").select("stem", F.col("hash").alias("clean"))
    odd = F.array_sort(F.collect_list(F.when(~F.col("hash").eqNullSafe(F.col("clean")), F.col("view"))))
    return h.join(clean, "stem", "left").groupBy("stem").agg(F.count(F.lit(1)).alias("views"), F.countDistinct("hash").alias("fingerprints"), odd.alias("odd"))


def require_agreement(caches: DataFrame, path: str = "path") -> None:
    """Raises for the first stems whose views were made of different rows."""
    bad = stem_agreement(caches, path).filter("fingerprints > 1").orderBy("stem").limit(5).collect()
    if bad:
        raise ValueError("views of different rows: " + "; ".join(f"{r['stem']} ({', '.join(r['odd'])})" for r in bad))

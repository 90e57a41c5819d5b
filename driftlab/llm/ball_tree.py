"""Centroid clustering: rounds of nearest centroids and floored means, over ball trees local to a partition.

Components become integers, floor(scale * x). Each task cuts its vectors into lots of LOT and builds a metric tree over each;
a node is a ball with the integer sum and the count of its vectors, their floored mean as centre, and the radius around it.
The trees are written once as a table and read in every round. A round goes down each tree, level by level: if the triangle
inequality leaves every vector of a ball nearer to one centroid than to all others, the ball's sum and count go to that
centroid as a whole; else its children are looked at, and at a leaf the vectors themselves by exact integer distances. Tasks
give a sum and a count for each centroid, Spark adds them up, and the driver holds nothing but the centroids.

Equal vectors, however many, end as one ball of radius 0, which is never cut further nor looked into.

Nulls: rows whose vector is null, holds null or non-finite components or has not exactly ``width`` components are dropped;
null ids rank after all others. Vectors with components so large that a long can't hold their distances (vector_codes.limit)
stay with a null cluster and distance. Ties go to the centroid with the smaller number; rows with the same id rank by their
vectors. Repeated rows each count. With fewer vectors than centroids there are as many centroids as vectors. An empty table
gives an empty result. Only the columns id and vector are read, so extra ones can't clash.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlab.llm.common import cut, in_arrow, table
from driftlab.llm.vector_codes import integer_rows, limit

WIDTH, CENTROIDS, SCALE, ROUNDS, SEED = 64, 8, 1024, 10, 3
LOT, LEAF = 8192, 48


class BallTree:
    """Balls over integer points, which are reordered so that a ball's are in one run; children come after their parent."""

    FIELDS = {"order": np.int32, "points": np.int32, "start": np.int32, "end": np.int32, "child": np.int32, "center": np.int32, "sums": np.int64, "radius": np.int64}

    def __init__(self, **fields: np.ndarray):
        self.__dict__.update(fields)

    @classmethod
    def build(cls, points: np.ndarray, leaf: int = LEAF) -> "BallTree":
        points, order = np.asarray(points, np.int64), np.arange(len(points))
        start, end, child, center, sums, radius = [0], [len(points)], [], [], [], []
        at = 0
        while at < len(start):
            a, b = start[at], end[at]
            own = points[order[a:b]]
            total = own.sum(axis=0)
            middle = total // (b - a)
            off = own - middle
            far = np.einsum("ij,ij->i", off, off)
            center.append(middle)
            sums.append(total)
            radius.append(int(far.max()))  # squared
            if b - a <= leaf or not radius[-1]:
                child.append(-1)
            else:  # two halves along the line between two vectors that lie far apart
                one = own[far.argmax()]
                off = own - one
                other = own[np.einsum("ij,ij->i", off, off).argmax()]
                half = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(own @ (other - one).astype(np.float64), half)]
                child.append(len(start))
                start += [a, a + half]
                end += [a + half, b]
            at += 1
        made = {"order": order, "points": points[order], "start": start, "end": end, "child": child, "center": np.array(center), "sums": np.array(sums), "radius": radius}
        return cls(**{k: np.asarray(v, cls.FIELDS[k]) for k, v in made.items()})

    def packed(self) -> list[bytes]:
        return [np.ascontiguousarray(getattr(self, k), t).tobytes() for k, t in self.FIELDS.items()]

    @classmethod
    def unpacked(cls, fields: list[bytes], width: int) -> "BallTree":
        flat = {k: np.frombuffer(b, t) for (k, t), b in zip(cls.FIELDS.items(), fields)}
        return cls(**flat | {k: flat[k].reshape(-1, width) for k in ("points", "center", "sums")})

    def descend(self, centroids: np.ndarray):
        """(balls, centroid of each) that are assigned as a whole, then (points, centroid of each) of the leaves that are not."""
        whole, to, rest = [], [], []
        front = np.zeros(1, np.int64)
        while len(front):
            squared = distances(self.center[front], centroids)
            best = squared.argmin(axis=1)
            d = np.sqrt(squared.astype(np.float64))
            nearest = d[np.arange(len(front)), best].copy()
            d[np.arange(len(front)), best] = np.inf
            # every vector is within the radius of the centre, so nearer to best than to others; the slack covers rounding
            r = np.sqrt(self.radius[front].astype(np.float64))
            sure = (self.radius[front] == 0) | (d.min(axis=1) - nearest > 2 * r + 1e-9 * (1 + nearest + r))
            whole.append(front[sure])
            to.append(best[sure])
            front = front[~sure]
            leaves = self.child[front] < 0
            rest.append(front[leaves])
            inner = self.child[front[~leaves]].astype(np.int64)
            front = np.concatenate([inner, inner + 1])
        rest = np.concatenate(rest)
        points = np.concatenate([np.arange(self.start[i], self.end[i]) for i in rest]) if len(rest) else np.zeros(0, np.int64)
        return np.concatenate(whole), np.concatenate(to), points, distances(self.points[points], centroids).argmin(axis=1)


def distances(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances (point, centroid): as products of matrices where doubles hold every sum, else in integers."""
    most = max(int(np.abs(points).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    if points.shape[1] * most * most < 1 << 50:
        p, c = points.astype(np.float64), centroids.astype(np.float64)
        return ((p * p).sum(axis=1)[:, None] - 2 * (p @ c.T) + (c * c).sum(axis=1)).astype(np.int64)
    p, c = points.astype(np.int64), centroids.astype(np.int64)
    return np.stack([((p - k) ** 2).sum(axis=1) for k in c], axis=1)


def plant(df: DataFrame, id: str = "vec_id", vector: str = "embedding", width: int = WIDTH, scale: float = SCALE, lot: int = LOT) -> DataFrame:
    """The table of trees: a row a lot, with the ids in the order of the tree's points, and those of vectors without integers."""
    kind = dict(df.dtypes)[id]

    def run(batches):
        import pyarrow as pa

        def row(ids, points, rest):
            ids, rest = pa.concat_arrays(ids), pa.concat_arrays(rest)
            points = np.concatenate(points)
            tree = BallTree.build(points) if len(points) else None
            if tree:
                ids = ids.take(pa.array(tree.order))
            fields = tree.packed() if tree else [b""] * len(BallTree.FIELDS)
            lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (ids, rest)]
            return pa.RecordBatch.from_arrays([*lists, *(pa.array([x], pa.binary()) for x in fields)], ["ids", "rest", *BallTree.FIELDS])

        ids, points, rest, n = [], [], [], 0
        for b in batches:
            kept, whole, x = integer_rows(b.column(1), scale, width)
            of_width = b.column(1).value_lengths().to_numpy(zero_copy_only=False) == width
            for at in range(0, b.num_rows, lot):
                part = slice(at, at + lot)
                own, odd = whole[part], (kept & of_width & ~whole)[part]
                ids.append(b.column(0).slice(at, lot).filter(pa.array(own)))
                rest.append(b.column(0).slice(at, lot).filter(pa.array(odd)))
                points.append(x[whole[:at].sum() : whole[: at + lot].sum()])
                n += int(own.sum() + odd.sum())
                if n >= lot:
                    yield row(ids, points, rest)
                    ids, points, rest, n = [], [], [], 0
        if n:
            yield row(ids, points, rest)

    fields = ", ".join(f"{k} binary" for k in BallTree.FIELDS)
    return cut(in_arrow(df.select(id, vector), run, f"ids array<{kind}>, rest array<{kind}>, {fields}"), "trees")


def first_centroids(df: DataFrame, id: str, vector: str, width: int, scale: float, centroids: int, seed: int) -> np.ndarray:
    """Integers of the vectors whose ids, with the seed before them, have the smallest SHA-256."""
    most = limit(width)
    fits = F.forall(vector, lambda c: (c.cast("double") * scale > -most + 1) & (c.cast("double") * scale < most))
    x = F.transform(vector, lambda c: F.floor(c.cast("double") * scale).cast("long"))
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id).cast("string")).cast("binary"), 256)
    top = df.filter((F.size(vector) == width) & fits).select(rank.alias("h"), x.alias("x")).orderBy(F.col("h").asc_nulls_last(), "x").limit(centroids).collect()
    return np.array([r["x"] for r in top], np.int64).reshape(len(top), width)


def moved(trees: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids after one round: tasks sum up balls and vectors, Spark adds the sums; empty ones stay."""
    k, width = centroids.shape

    def run(batches):
        import pyarrow as pa

        n, sums = np.zeros(k, np.int64), np.zeros((k, width), np.int64)
        for b in batches:
            for fields in zip(*(c.to_pylist() for c in b.columns)):
                if fields[0]:
                    tree = BallTree.unpacked(fields, width)
                    balls, to, points, at = tree.descend(centroids)
                    for c in range(k):
                        own, mine = balls[to == c], points[at == c]
                        n[c] += (tree.end[own] - tree.start[own]).sum() + len(mine)
                        sums[c] += tree.sums[own].sum(axis=0) + tree.points[mine].sum(axis=0, dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, dtype=np.int32)), pa.array(n), pa.array(list(sums), pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    rows = in_arrow(trees.select(*BallTree.FIELDS), run, "cluster int, n long, sums array<long>")
    out = centroids.copy()
    for r in rows.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.get("sums", F.lit(j))).alias(f"s{j}") for j in range(width)]).collect():  # a row a centroid
        if r["n"]:
            out[r["cluster"]] = [r[f"s{j}"] // r["n"] for j in range(width)]
    return out


def assigned(trees: DataFrame, centroids: np.ndarray, id: str = "vec_id") -> DataFrame:
    """(id, cluster, distance): each vector's nearest centroid and the squared distance to it."""
    k, width = centroids.shape
    kind = dict(trees.dtypes)["ids"][6:-1]

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for i, fields in enumerate(zip(*(c.to_pylist() for c in b.columns[2:]))):
                ids, rest = (b.column(c)[i].values for c in (0, 1))
                cluster, far = np.zeros(len(ids), np.int32), np.zeros(len(ids), np.int64)
                if fields[0]:
                    tree = BallTree.unpacked(fields, width)
                    balls, to, points, at = tree.descend(centroids)
                    for ball, c in zip(balls, to):
                        cluster[tree.start[ball] : tree.end[ball]] = c
                    cluster[points] = at
                    off = tree.points.astype(np.int64) - centroids[cluster]
                    far = np.einsum("ij,ij->i", off, off)
                none = np.arange(len(ids) + len(rest)) >= len(ids)
                fill = lambda x: np.concatenate([x, np.zeros(len(rest), x.dtype)])
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([ids, rest]), pa.array(fill(cluster), mask=none), pa.array(fill(far), mask=none)], [id, "cluster", "distance"])

    return in_arrow(trees, run, f"`{id}` {kind}, cluster int, distance long")


def cluster(df: DataFrame, id: str = "vec_id", vector: str = "embedding", width: int = WIDTH, centroids: int = CENTROIDS, rounds: int = ROUNDS, scale: float = SCALE, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """((id, cluster, distance), centroids) of all vectors of df."""
    at = first_centroids(df, id, vector, width, scale, centroids, seed)
    trees = plant(df, id, vector, width, scale)
    for _ in range(rounds if len(at) else 0):
        at = moved(trees, at)
    return assigned(trees, at, id), at


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, centroids = cluster(table(spark, sf_dir, "embeddings"))
    rows = cut(rows, "clusters")
    hashes = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    per = rows.groupBy("cluster").agg(F.try_sum("distance").alias("cluster_inertia"))  # a row a centroid
    total = per.agg(F.try_sum("cluster_inertia").alias("inertia"))
    out = rows.join(F.broadcast(per), "cluster", "left").crossJoin(F.broadcast(total))
    named = F.array(*map(F.lit, hashes)) if hashes else F.array().cast("array<string>")
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.get(named, "cluster").alias("centroid_sha256"))


def _sql(rounds: int = ROUNDS) -> str:
    """The same by brute force: every vector against every centroid."""

    def nearest(c: str) -> str:
        return f"(SELECT rid, arg_min(k, (d, k)) AS k, min(d)::BIGINT AS d FROM (SELECT v.rid, c.k, sum((v.c - c.c) * (v.c - c.c)) AS d FROM v JOIN {c} c USING (j) GROUP BY v.rid, c.k) GROUP BY rid)"

    text = f"""WITH kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id) NULLS LAST, x) - 1 AS rid, vec_id, x FROM (
 SELECT vec_id, list_transform(embedding, lambda c: floor(c::DOUBLE * {SCALE})::BIGINT) AS x FROM embeddings
 WHERE len(embedding) = {WIDTH} AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0)),
v AS MATERIALIZED (SELECT rid, unnest(x) AS c, generate_subscripts(x, 1) AS j FROM kept),
c0 AS MATERIALIZED (SELECT rid AS k, j, c FROM v WHERE rid < {CENTROIDS})"""
    for r in range(1, rounds + 1):
        text += f""",
a{r} AS MATERIALIZED {nearest(f"c{r - 1}")},
m{r} AS (SELECT k, j, (sum(c) - (((sum(c) % count(*)) + count(*)) % count(*))) // count(*) AS c FROM a{r} JOIN v USING (rid) GROUP BY k, j),
c{r} AS MATERIALIZED (SELECT c.k, c.j, coalesce(m.c, c.c)::BIGINT AS c FROM c{r - 1} c LEFT JOIN m{r} m USING (k, j))"""
    return f"""{text},
f AS {nearest(f"c{rounds}")},
h AS (SELECT k, sha256(string_agg(c::VARCHAR, ',' ORDER BY j)) AS centroid_sha256 FROM c{rounds} GROUP BY k)
SELECT vec_id, k::INT AS cluster, d AS distance, sum(d) OVER (PARTITION BY k)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia, centroid_sha256 FROM kept JOIN f USING (rid) JOIN h USING (k)"""


SQL = _sql()

"""Queries that write a store, read it back and check it, and ablations of equal size, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftlab.operators import manifests, scoring, views
from driftlab.operators import metrics as M
from driftlab.plans import data
from driftlab.plans.corpus import _M
from driftlab.plans.sql_views import auc_sql, scores_cte
from driftlab.sources import files

QUERIES: dict = {}
SQL: dict[str, str] = {}
_CACHED = ["clean", "jpeg_q30"]
_BASE = scores_cte(["clean"]).split(",\ndims AS")[0]
#: First and last place of the vector that each probe reads.
PROBES = {"head": (1, 6), "body": (7, 60), "tail": (61, 64)}
MATCHED = 50


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(scores_cte(_CACHED) + "SELECT row_id, view, view = 'clean' AS reused, p FROM scores")
def cache_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of cached vectors: the clean view is cached first, so that a second call for two views makes only the other."""
    e = data.embeddings(spark, sf_dir).select("row_id", "path", "x")
    path, head = files.checkpoint_folder(spark, "views"), scoring.fit_centroid_head(data.embeddings(spark, sf_dir))
    embed = lambda names: views.expand_views(e, names).select("row_id", "view", "x")
    prints = {v: views.view_fingerprint(v) for v in _CACHED}
    files.embed_or_reuse(spark, path, "vec64", "rows", {"clean": prints["clean"]}, embed)
    cached, made = files.embed_or_reuse(spark, path, "vec64", "rows", prints, embed)
    reused = ~F.col("view").isin(made) if made else F.lit(True)
    return scoring.score(cached.select("row_id", "view", "x"), head).select("row_id", "view", reused.alias("reused"), "p")


@query(_M + "SELECT image_path, label, CASE WHEN label = 1 THEN source ELSE 'late' END AS source, CASE WHEN label = 1 THEN generator END AS generator FROM m")
def merged_indexes(spark, sf_dir):
    """Two indexes written as CSV and read as one: of a path that is in both, the row of the first index stays."""
    m = data.manifest(spark, sf_dir).select("image_path", "label", "source", "generator")
    folder = files.checkpoint_folder(spark, "indexes")
    m.filter("label = 1").write.option("header", True).csv(f"{folder}/a_index.csv")
    m.withColumns({"source": F.lit("late"), "generator": F.lit(None).cast("string")}).write.option("header", True).csv(f"{folder}/b_index.csv")
    return files.read_indexes(spark, folder)


@query(_M + "SELECT source, image_path, label, generator FROM m")
def source_manifests(spark, sf_dir):
    """A manifest written source by source, and all of it read back."""
    path = files.checkpoint_folder(spark, "sources")
    files.write_per_source(data.manifest(spark, sf_dir).drop("doc_id"), path)
    return spark.read.option("header", True).schema("image_path string, label int, generator string, source string").csv(path).select("source", "image_path", "label", "generator")


@query(_M + ", t AS (SELECT *, ('0x' || substr(sha1(image_path), 1, 8))::BIGINT % 10 AS fold FROM m) SELECT image_path, label FROM t WHERE fold < 8")
def guarded_training_rows(spark, sf_dir):
    """The training folds, once it is certain that none of their paths is in the others."""
    fold = F.conv(F.substring(F.sha1(F.col("image_path").cast("binary")), 1, 8), 16, 10).cast("long") % 10
    m = data.manifest(spark, sf_dir).withColumn("fold", fold)
    return manifests.require_disjoint(m.filter("fold < 8"), m.filter("fold >= 8")).select("image_path", "label")


@query("SELECT doc_id, octet_length(encode(text)) AS n_bytes, sha1(text) AS sha1 FROM documents WHERE text IS NOT NULL")
def base64_frames(spark, sf_dir):
    """Frames sent as base64, every other one with a data: prefix, decoded."""
    d = data.table(spark, sf_dir, "documents").filter("text IS NOT NULL")
    sent = F.concat(F.when(F.col("doc_id") % 2 == 0, "data:image/png;base64,").otherwise(""), F.base64(F.col("text").cast("binary")))
    return d.select("doc_id", files.frame_bytes(sent).alias("frame")).select("doc_id", F.octet_length("frame").cast("long").alias("n_bytes"), F.sha1("frame").alias("sha1"))


_HEAD = """mean, std, list_transform(range(1, len(mean) + 1), lambda i: z1[i] - z0[i]) AS w, -list_sum(list_transform(range(1, len(mean) + 1), lambda i: (z1[i] - z0[i]) * (z1[i] + z0[i]))) / 2 AS b"""
_LISTS = "list(mean ORDER BY dim) AS mean, list(std ORDER BY dim) AS std, list((m1 - mean) / std ORDER BY dim) AS z1, list((m0 - mean) / std ORDER BY dim) AS z0"
_STATS = "avg(v) AS mean, CASE WHEN stddev_pop(v) = 0 THEN 1.0 ELSE stddev_pop(v) END AS std, avg(v) FILTER (y = 1) AS m1, avg(v) FILTER (y = 0) AS m0"


@query(_BASE + f""",
probes(probe, a, z) AS (VALUES {', '.join(f"('{n}', {a}, {z})" for n, (a, z) in PROBES.items())}),
d AS (SELECT y, unnest(range(1, 65)) AS dim, unnest(x) AS v FROM base),
s AS (SELECT probe, a, z, dim, {_STATS} FROM d JOIN probes ON dim BETWEEN a AND z GROUP BY ALL),
l AS (SELECT probe, a, z, {_LISTS} FROM s GROUP BY ALL), h AS (SELECT probe, a, z, {_HEAD} FROM l),
t AS (SELECT probe, y, round(1.0 / (1.0 + exp(-(list_dot_product(list_transform(range(a, z + 1), lambda i: (x[i] - mean[i - a + 1]) / std[i - a + 1]), w) + b))), 9) AS p FROM base CROSS JOIN h)
""" + auc_sql("probe", "t"))
def feature_probes(spark, sf_dir):
    """How well each part of the vector tells the classes apart alone."""
    e, out = data.embeddings(spark, sf_dir).select("y", "x"), None
    for name, (a, z) in PROBES.items():
        part = e.withColumn("x", F.slice("x", a, z - a + 1))
        s = scoring.score(part, scoring.fit_centroid_head(part)).select(F.lit(name).alias("probe"), "y", "p")
        out = s if out is None else out.unionByName(s)
    return M.auc(out, ("probe",)).select("probe", "auc")


@query(_BASE + f""",
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY sha1('match::' || path), path) AS place FROM base) WHERE place <= {MATCHED}),
d AS (SELECT source, row_id, y, unnest(range(1, 65)) AS dim, unnest(x) AS v FROM k),
s AS (SELECT source, dim, count(DISTINCT row_id) AS n, {_STATS} FROM d GROUP BY ALL),
l AS (SELECT source, max(n) AS n, {_LISTS} FROM s GROUP BY source), h AS (SELECT source, n, {_HEAD} FROM l),
t AS (SELECT h.source AS trained_on, n, y, round(1.0 / (1.0 + exp(-(list_dot_product(list_transform(range(1, 65), lambda i: (x[i] - mean[i]) / std[i]), w) + b))), 9) AS p FROM base CROSS JOIN h WHERE tier = 'ood')
""" + auc_sql("trained_on, n", "t"))
def size_matched_ablation(spark, sf_dir):
    """Heads of the sources, each learned from equally many rows, on one tier: what a source is worth apart from its size."""
    e, out = data.embeddings(spark, sf_dir), None
    order = Window.partitionBy("source").orderBy(F.sha1(F.concat(F.lit("match::"), "path").cast("binary")), "path")
    drawn = e.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= MATCHED).drop("place")  # each task cuts its rows first
    path, schema = files.checkpoint_folder(spark, "matched"), drawn.schema
    drawn.write.parquet(path)
    drawn, test = spark.read.schema(schema).parquet(path), e.filter("tier = 'ood'").select("y", "x")
    for source in [f"s{k}" for k in range(3)]:
        part = drawn.filter(F.col("source") == source)
        n = part.agg(F.count(F.lit(1)).alias("n"))
        s = scoring.score(test, scoring.fit_centroid_head(part)).crossJoin(F.broadcast(n)).select(F.lit(source).alias("trained_on"), "n", "y", "p")  # one row
        out = s if out is None else out.unionByName(s)
    return M.auc(out, ("trained_on", "n")).select("trained_on", "n", "auc")

"""More report queries: alignment, transfer, attributes, slices and batches, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from driftlab.functions import vectors as V
from driftlab.operators import frames
from driftlab.operators import metrics as M
from driftlab.operators import views
from driftlab.plans import data
from driftlab.plans.corpus import _M
from driftlab.plans.robustness import SHIP
from driftlab.plans.sql_views import auc_sql, scores_cte

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_ALL, _CLEAN = scores_cte(), scores_cte(["clean"])
_E = "WITH e AS (SELECT event_id, ts, user_id, event_type, round(value / (value + 50.0::DOUBLE), 9) AS pred FROM events)"


@query(_ALL + " SELECT row_id, count(*) AS n_views, count(DISTINCT y) = 1 AS aligned FROM scores GROUP BY row_id")
def cross_view_alignment(spark, sf_dir):
    """Whether each row is in every view with one label."""
    s = data.scores(spark, sf_dir)
    return s.groupBy("row_id").agg(F.count(F.lit(1)).alias("n_views"), (F.min("y") == F.max("y")).alias("aligned"))


@query(_M + ", c AS (SELECT vec_id, label AS cached FROM embeddings) SELECT doc_id, image_path, cached IS NOT NULL AS has_vector FROM m LEFT JOIN c ON vec_id = doc_id")
def manifest_cache_mask(spark, sf_dir):
    """Which rows of the manifest have a cached vector."""
    e = data.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit(True).alias("cached"))
    return data.manifest(spark, sf_dir).join(e, "doc_id", "left").select("doc_id", "image_path", F.coalesce("cached", F.lit(False)).alias("has_vector"))


@query(_CLEAN.split(",\ndims AS")[0] + """,
d AS (SELECT source, y, row_id, unnest(range(1, 65)) AS dim, unnest(x) AS v FROM base),
h AS (SELECT source AS train, dim, avg(v) AS mean, CASE WHEN stddev_pop(v) = 0 THEN 1.0 ELSE stddev_pop(v) END AS std, avg(v) FILTER (y = 1) AS m1, avg(v) FILTER (y = 0) AS m0 FROM d GROUP BY ALL),
w AS (SELECT train, list(mean ORDER BY dim) AS mean, list(std ORDER BY dim) AS std, list((m1 - m0) / std ORDER BY dim) AS w FROM h GROUP BY train),
t AS (SELECT train, source AS test, y, round(1.0 / (1.0 + exp(-list_dot_product(list_transform(range(1, 65), lambda i: (x[i] - mean[i]) / std[i]), w))), 9) AS p FROM base CROSS JOIN w)
""" + auc_sql("train, test", "t"))
def transfer_matrix(spark, sf_dir):
    """A head for each source, scored on every source."""
    e = data.embeddings(spark, sf_dir)
    d = e.select("source", "y", F.posexplode("x").alias("dim", "v")).groupBy("source", "dim").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.avg(F.when(F.col("y") == 1, F.col("v"))).alias("m1"), F.avg(F.when(F.col("y") == 0, F.col("v"))).alias("m0"))
    d = d.withColumn("std", F.when(F.col("std") == 0, F.lit(1.0)).otherwise(F.col("std"))).withColumn("w", (F.col("m1") - F.col("m0")) / F.col("std"))
    heads = d.groupBy(F.col("source").alias("train")).agg(F.array_sort(F.collect_list(F.struct("dim", "mean", "std", "w"))).alias("all"))
    pick = lambda c: F.transform("all", lambda s: s[c])
    heads = heads.select("train", pick("mean").alias("mean"), pick("std").alias("std"), pick("w").alias("w"))
    s = e.crossJoin(F.broadcast(heads))  # one short row a source
    s = s.select("train", F.col("source").alias("test"), "y", F.round(V.sigmoid(V.dot(V.standardize(F.col("x"), F.col("mean"), F.col("std")), F.col("w"))), 9).alias("p"))
    return M.auc(s, ("train", "test")).select("train", "test", "auc")


@query(_M + ", a AS (SELECT label AS y, n_chars / (n_chars + 1000.0::DOUBLE) AS p, n_chars FROM m JOIN documents d ON d.doc_id = m.doc_id), q AS (SELECT y, quantile_cont(n_chars, 0.1) AS p10, quantile_cont(n_chars, 0.5) AS p50, quantile_cont(n_chars, 0.9) AS p90 FROM a GROUP BY y) SELECT q.*, u.auc FROM q CROSS JOIN (" + auc_sql("", "a") + ") u")
def attribute_classifier(spark, sf_dir):
    """How well one attribute alone tells the classes apart, and its spread in each."""
    d = data.table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    a = data.manifest(spark, sf_dir).join(d, "doc_id").select(F.col("label").alias("y"), "n_chars", (F.col("n_chars") / (F.col("n_chars") + 1000.0)).alias("p"))
    q = a.groupBy("y").agg(*[F.percentile("n_chars", F.lit(v)).alias(n) for n, v in (("p10", 0.1), ("p50", 0.5), ("p90", 0.9))])
    return q.crossJoin(F.broadcast(M.auc(a).select("auc")))


@query("SELECT view, CASE WHEN view LIKE 'chain%' THEN false ELSE true END AS trained FROM (VALUES " + ", ".join(f"('{v}')" for v in views.select_views(None)) + ") t(view)")
def trained_views(spark, sf_dir):
    """Scored views, and whether they are trained on: the set of scored views without those of the evaluation chains."""
    v = views.views_table(spark)
    held = v.filter("scored").join(v.filter("kind = 'chain'"), "view", "left_semi").select("view", F.lit(False).alias("held"))
    return v.filter("scored").join(held, "view", "left").select("view", F.coalesce("held", F.lit(True)).alias("trained"))


@query(_ALL + f", a AS ({auc_sql('view')}), worst AS (SELECT arg_min(view, auc) AS view FROM a WHERE view <> 'clean'), l AS (SELECT 'clean' AS view, 0 AS place UNION ALL SELECT view, 1 FROM worst UNION ALL SELECT 'jpeg_q30', 2 UNION ALL SELECT 'chain_heavy', 3) SELECT view, min(place) AS place FROM l GROUP BY view")
def focus_views(spark, sf_dir):
    """Clean, the worst view and those asked for, each once."""
    a = M.auc(data.scores(spark, sf_dir), ("view", "ord"))
    worst = a.filter("view <> 'clean'").agg(F.min_by("view", F.struct("auc", "ord")).alias("view")).withColumn("place", F.lit(1))
    fixed = spark.createDataFrame([("clean", 0), ("jpeg_q30", 2), ("chain_heavy", 3)], "view string, place int")
    return fixed.unionByName(worst).groupBy("view").agg(F.min("place").alias("place"))


@query(_ALL + f", a AS ({auc_sql('tier')}), o(tier, place) AS (VALUES ('social', 0), ('ood', 1), ('absent', 2), ('val', 3)) SELECT o.tier, place, auc FROM o LEFT JOIN a ON a.tier = o.tier")
def reindexed_tiers(spark, sf_dir):
    """Figures in the order asked for, with a row for what is missing."""
    o = spark.createDataFrame([("social", 0), ("ood", 1), ("absent", 2), ("val", 3)], "tier string, place int")
    return o.join(M.auc(data.scores(spark, sf_dir), ("tier",)).select("tier", "auc"), "tier", "left").select("tier", "place", "auc")


@query("SELECT CASE WHEN event_id <= 400 THEN 'eval' ELSE 'train' END AS part, event_type, count(*) AS n, min(event_id) AS first, max(event_id) AS last FROM events GROUP BY ALL")
def disjoint_slices(spark, sf_dir):
    """Slices of a stream by position, which share no row."""
    e = data.table(spark, sf_dir, "events").withColumn("part", F.when(F.col("event_id") <= 400, F.lit("eval")).otherwise(F.lit("train")))
    return e.groupBy("part", "event_type").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first"), F.max("event_id").alias("last"))


@query(f"{_E} SELECT user_id, event_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 6 AS batch FROM e")
def micro_batches(spark, sf_dir):
    """Each key's rows in batches of six."""
    e = data.stream_scores(spark, sf_dir).select("user_id", "event_id", "ts")
    return frames.numbered(e, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", F.floor(F.col("n") / 6).cast("long").alias("batch"))


@query(f"{_E}, b AS (SELECT *, (event_id // 6)::BIGINT AS batch, event_type = 'error' AS failed FROM e) SELECT batch, row_number() OVER (PARTITION BY batch ORDER BY failed DESC, event_id) AS place, event_id, CASE WHEN NOT failed THEN pred END AS pred, CASE WHEN failed THEN 'unreadable' END AS error FROM b")
def batch_results(spark, sf_dir):
    """Results of batch requests: errors first, then scores, each with its place."""
    b = data.stream_scores(spark, sf_dir).withColumns({"batch": F.floor(F.col("event_id") / 6).cast("long"), "failed": F.col("event_type") == "error"})
    place = F.row_number().over(Window.partitionBy("batch").orderBy(F.col("failed").desc(), "event_id")).cast("long")
    return b.select("batch", place.alias("place"), "event_id", F.when(~F.col("failed"), F.col("pred")).alias("pred"), F.when(F.col("failed"), F.lit("unreadable")).alias("error"))


@query(f"{_E}, l AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS state, arg_max(pred, (ts, event_id)) AS pred, count(*) AS n FROM e GROUP BY user_id) SELECT * FROM l WHERE state <> 'error'")
def tracked_elements(spark, sf_dir):
    """The last state of each element that has not been removed."""
    at = F.struct("ts", "event_id")
    l = data.stream_scores(spark, sf_dir).groupBy("user_id").agg(F.max_by("event_type", at).alias("state"), F.max_by("pred", at).alias("pred"), F.count(F.lit(1)).alias("n"))  # noqa: E741
    return l.filter("state <> 'error'")


@query("WITH s AS (SELECT event_id AS step, date_trunc('day', ts) AS epoch, value FROM events), l AS (SELECT epoch, max(step) AS last FROM s GROUP BY epoch) SELECT step, value FROM s JOIN l USING (epoch) WHERE step % 50 = 0 OR step = 1 OR step = last")
def curve_points(spark, sf_dir):
    """Every fiftieth step, the first, and each epoch's last: the points of a validation curve (its own rule, not a sample)."""
    s = data.table(spark, sf_dir, "events").select(F.col("event_id").alias("step"), F.date_trunc("day", "ts").alias("epoch"), "value")
    last = s.groupBy("epoch").agg(F.max("step").alias("last"))
    return s.join(last, "epoch").filter("step % 50 = 0 OR step = 1 OR step = last").select("step", "value")


@query(_CLEAN + """ SELECT path, '{"image_path":"' || path || '","pred":' || printf('%.6f', p) || '}' AS line FROM scores""")
def prediction_lines(spark, sf_dir):
    """Predictions as JSON lines."""
    s = data.scores(spark, sf_dir, ["clean"])
    return s.select("path", F.concat(F.lit('{"image_path":"'), "path", F.lit('","pred":'), V.six_digits(F.col("p")), F.lit("}")).alias("line"))


@query(_CLEAN + f" SELECT view, sum((p >= {SHIP} AND y = 1)::INT)::BIGINT AS tp, sum((p >= {SHIP} AND y = 0)::INT)::BIGINT AS fp, sum((p < {SHIP} AND y = 1)::INT)::BIGINT AS fn, sum((p < {SHIP} AND y = 0)::INT)::BIGINT AS tn FROM scores GROUP BY view")
def confusion(spark, sf_dir):
    hit, pos = F.col("p") >= SHIP, F.col("y") == 1
    return data.scores(spark, sf_dir, ["clean"]).groupBy("view").agg(F.count_if(hit & pos).alias("tp"), F.count_if(hit & ~pos).alias("fp"), F.count_if(~hit & pos).alias("fn"), F.count_if(~hit & ~pos).alias("tn"))


@query("SELECT source, min(n_chars) AS least, median(n_chars) AS middle, max(n_chars) AS most, round(avg((n_chars = 52)::INT::DOUBLE) * 100, 4) AS pct_same, count(DISTINCT lang) AS formats FROM documents GROUP BY source")
def describe_sizes(spark, sf_dir):
    d = data.table(spark, sf_dir, "documents")
    return d.groupBy("source").agg(F.min("n_chars").alias("least"), F.median("n_chars").alias("middle"), F.max("n_chars").alias("most"), F.round(F.avg((F.col("n_chars") == 52).cast("double")) * 100, 4).alias("pct_same"), F.countDistinct("lang").alias("formats"))

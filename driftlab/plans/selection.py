"""Queries on selection, calibration, ensembles and intervals, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlab.functions import vectors as V
from driftlab.operators import metrics as M
from driftlab.operators import scoring, training
from driftlab.operators import selection as S
from driftlab.plans import data
from driftlab.plans.robustness import _ALL, _CLEAN, _DIM, _RATES, SHIP
from driftlab.plans.sql_views import auc_sql, scores_cte
from driftlab.sources.files import checkpoint_folder, read_head, write_head

QUERIES: dict = {}
SQL: dict[str, str] = {}
REPLICATES = 50
_PAIR = ["clean", "chain_heavy"]
_TWO = scores_cte(_PAIR)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_M = """WITH m AS (SELECT concat_ws('/', source, lang, d.doc_id || '.jpg') AS image_path, coalesce(quality, d.doc_id % 2)::INT AS label, source, lang AS generator, d.doc_id
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)
"""


@query(_M + "SELECT * FROM m ORDER BY doc_id LIMIT 100")
def prefix_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 100 rows of the manifest in its order."""
    return S.prefix(data.manifest(spark, sf_dir), "doc_id", 100)


@query(_M + "SELECT * FROM m ORDER BY sha1('0::' || doc_id), doc_id LIMIT 150")
def seeded_sample(spark, sf_dir):
    """150 rows of the manifest without replacement."""
    return S.seeded_sample(data.manifest(spark, sf_dir), "doc_id", 150)


@query(_M + "SELECT * FROM (SELECT 'sample' AS rule, * FROM (SELECT * FROM m ORDER BY sha1('3::' || doc_id), doc_id LIMIT 20)) UNION ALL SELECT * FROM (SELECT 'prefix' AS rule, * FROM (SELECT * FROM m ORDER BY doc_id LIMIT 30)) UNION ALL SELECT 'all' AS rule, * FROM m")
def row_selection(spark, sf_dir):
    """What each rule selects: a sample wins over a limit, and without either all rows stay."""
    m = data.manifest(spark, sf_dir)
    rules = {"sample": {"limit": 30, "sample": 20, "seed": 3}, "prefix": {"limit": 30}, "all": {}}
    out = None
    for rule, how in rules.items():
        part = S.select_rows(m, "doc_id", "doc_id", **how).select(F.lit(rule).alias("rule"), "*")
        out = part if out is None else out.unionByName(part)
    return out


@query(_M + "SELECT image_path, label, 'real_only' AS source, 'camera' AS generator, doc_id FROM m WHERE label = 0")
def relabelled_reals(spark, sf_dir):
    return S.relabelled(data.manifest(spark, sf_dir), 0, "real_only", "camera")


@query(_M + ", files AS (SELECT DISTINCT concat_ws('/', source, lang, doc_id || '.jpg') AS path FROM documents WHERE n_chars >= 200) SELECT m.* FROM m JOIN files ON m.image_path = files.path")
def existing_files(spark, sf_dir):
    """Rows of the manifest whose file is listed (texts of 200 characters or more stand for the listing)."""
    d = data.table(spark, sf_dir, "documents").filter("n_chars >= 200")
    return S.existing(data.manifest(spark, sf_dir), d.select(F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".jpg"))).alias("path")))


@query(_M + "SELECT block::INT AS block, image_path, label FROM (SELECT 0 AS block, * FROM m WHERE label = 1 UNION ALL SELECT 1 AS block, * FROM m WHERE label = 0 UNION ALL SELECT 2 AS block, * FROM m WHERE source IS NOT NULL AND label = 1)")
def block_concat(spark, sf_dir):
    """A base corpus and extra ones, block after block, each in its own order."""
    m = data.manifest(spark, sf_dir)
    blocks = [m.filter("label = 1"), m.filter("label = 0"), m.filter("source IS NOT NULL AND label = 1")]
    return S.concat_blocks(blocks, ["image_path"]).select("block", "image_path", "label")


@query("WITH r AS (SELECT split_part(url, '?', 1) AS src, max(page_id) AS verdict FROM pages GROUP BY 1) SELECT page_id, src, verdict FROM (SELECT page_id, split_part(url, '?', 1) AS src FROM pages) e JOIN r USING (src)")
def reattached_results(spark, sf_dir):
    """One result a source address, given back to every element that shows it."""
    e = data.table(spark, sf_dir, "pages").select("page_id", F.substring_index("url", "?", 1).alias("src"))
    return e.join(e.groupBy("src").agg(F.max("page_id").alias("verdict")), "src").select("page_id", "src", "verdict")


@query(_ALL + f", a AS ({auc_sql('view')}), q AS ({auc_sql('', '(SELECT * FROM scores WHERE view <> \'clean\')')}), c AS (SELECT max(a.auc) FILTER (view = 'clean') AS clean, avg(a.auc) FILTER (view <> 'clean') AS mean, min(a.auc) FILTER (view <> 'clean') AS worst FROM a) SELECT round(0.5 * clean + 0.5 * (SELECT auc FROM q), 6) AS pooled, round(0.5 * clean + 0.5 * mean, 6) AS mean, round(0.5 * clean + 0.5 * worst, 6) AS worst FROM c")
def composite_scores(spark, sf_dir):
    """Half the clean AUC and half the degraded one, by all three definitions of the latter."""
    s = data.scores(spark, sf_dir)
    a = M.auc(s, ("view",))
    c = a.agg(F.max(F.when(F.col("view") == "clean", F.col("auc"))).alias("clean"), F.avg(F.when(F.col("view") != "clean", F.col("auc"))).alias("m"), F.min(F.when(F.col("view") != "clean", F.col("auc"))).alias("w"))
    q = M.auc(s.filter("view <> 'clean'")).select(F.col("auc").alias("q"))
    half = lambda x: F.round(0.5 * F.col("clean") + 0.5 * F.col(x), 6)
    return c.crossJoin(F.broadcast(q)).select(half("q").alias("pooled"), half("m").alias("mean"), half("w").alias("worst"))  # one row each


@query(_CLEAN + f", a AS ({auc_sql('source')}), b AS (SELECT source, {_RATES.format(t=SHIP)}, count(*) AS n FROM scores GROUP BY source) SELECT source, n, auc, round((tpr + 1 - fpr) / 2, 6) AS bacc FROM a JOIN b USING (source) WHERE auc IS NOT NULL")
def per_source_metrics(spark, sf_dir):
    """AUC and balanced accuracy of each source that has both classes."""
    s = data.scores(spark, sf_dir, ["clean"])
    n = s.groupBy("source").agg(F.count(F.lit(1)).alias("n"), M.tpr(F.lit(SHIP)).alias("tpr"), M.fpr(F.lit(SHIP)).alias("fpr"))
    return M.auc(s, ("source",)).filter("auc IS NOT NULL").join(n, "source").select("source", "n", "auc", F.round((F.col("tpr") + 1 - F.col("fpr")) / 2, 6).alias("bacc"))


@query(_CLEAN + f", {_DIM} SELECT coalesce(family, 'unknown') AS family, count(*) AS n, round(avg((p >= {SHIP})::INT::DOUBLE), 6) AS tpr FROM scores LEFT JOIN dim USING (generator) WHERE y = 1 GROUP BY 1")
def family_tpr(spark, sf_dir):
    """The share of each family's images that a fixed threshold flags."""
    s = data.scores(spark, sf_dir, ["clean"]).filter("y = 1").join(F.broadcast(data.generators(spark)), "generator", "left")  # the dimension is a fixed list
    return s.groupBy(F.coalesce("family", F.lit("unknown")).alias("family")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("p") >= SHIP).cast("double")), 6).alias("tpr"))


@query(_CLEAN + "SELECT source, generator, count(*) AS n, round(avg(p), 6) AS mean_score, count(DISTINCT row_id % 7) AS n_shapes FROM scores GROUP BY ALL")
def provenance_checks(spark, sf_dir):
    """Mean score and number of different shapes of each corpus: one shape alone, or a mean off the others', tells a pipeline apart."""
    s = data.scores(spark, sf_dir, ["clean"]).withColumn("shape", F.col("row_id") % 7)
    return s.groupBy("source", "generator").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("p"), 6).alias("mean_score"), F.countDistinct("shape").alias("n_shapes"))


@query(_ALL + f"SELECT view, y, count(*) AS n, round(avg(p), 6) AS mean_score, round(avg((p >= {SHIP})::INT::DOUBLE), 6) AS flagged FROM scores GROUP BY view, y")
def mean_score_by_class(spark, sf_dir):
    return data.scores(spark, sf_dir).groupBy("view", "y").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("p"), 6).alias("mean_score"), F.round(F.avg((F.col("p") >= SHIP).cast("double")), 6).alias("flagged"))


@query(_ALL + "SELECT view, round(avg((p - y) * (p - y)), 6) AS brier, round(avg(-ln(CASE WHEN y = 1 THEN greatest(1e-12, least(1 - 1e-12, p)) ELSE 1 - greatest(1e-12, least(1 - 1e-12, p)) END)), 6) AS log_loss FROM scores GROUP BY view")
def calibration_losses(spark, sf_dir):
    return data.scores(spark, sf_dir).groupBy("view").agg(F.round(S.brier(), 6).alias("brier"), F.round(S.log_loss(), 6).alias("log_loss"))


@query(_ALL + "SELECT view, least(9, floor(p * 10))::INT AS bin, count(*) AS n, round(avg(p), 6) AS mean_score, round(avg(y::DOUBLE), 6) AS observed FROM scores GROUP BY ALL")
def reliability_bins(spark, sf_dir):
    """What is said and what is so, in ten bins of the score."""
    b = F.least(F.lit(9), F.floor(F.col("p") * 10)).cast("int")
    return data.scores(spark, sf_dir).groupBy("view", b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("p"), 6).alias("mean_score"), F.round(F.avg(F.col("y").cast("double")), 6).alias("observed"))


_HEADS = _CLEAN.split(",\ndims AS")[0] + """,
d AS (SELECT source, y, unnest(range(1, 65)) AS dim, unnest(x) AS v FROM base),
h AS (SELECT source AS train, dim, avg(v) AS mean, CASE WHEN stddev_pop(v) = 0 THEN 1.0 ELSE stddev_pop(v) END AS std, avg(v) FILTER (y = 1) AS m1, avg(v) FILTER (y = 0) AS m0 FROM d GROUP BY ALL),
w AS (SELECT train, list(mean ORDER BY dim) AS mean, list(std ORDER BY dim) AS std, list((m1 - m0) / std ORDER BY dim) AS w FROM h GROUP BY train),
z AS (SELECT row_id, y, train, list_dot_product(list_transform(range(1, 65), lambda i: (x[i] - mean[i]) / std[i]), w) AS z FROM base CROSS JOIN w),
r AS (SELECT row_id, y, max(z) FILTER (train = 's0') AS z0, max(z) FILTER (train = 's1') AS z1, max(z) FILTER (train = 's2') AS z2 FROM z GROUP BY row_id, y),
"""
_ENSEMBLES = {"s0+s1": (0, 1), "s0+s2": (0, 2), "s1+s2": (1, 2), "s0+s1+s2": (0, 1, 2)}
_MEMBERS = " UNION ALL ".join(
    f"SELECT '{name}' AS heads, '{kind}' AS averaged, y, round({'(' + ' + '.join(f'1.0 / (1.0 + exp(-z{k}))' for k in ks) + f') / {len(ks)}' if kind == 'probability' else f'1.0 / (1.0 + exp(-(' + ' + '.join(f'z{k}' for k in ks) + f') / {len(ks)}))'}, 9) AS p FROM r"
    for name, ks in _ENSEMBLES.items()
    for kind in ("probability", "logit")
)


@query(_HEADS + f"t AS ({_MEMBERS}) " + auc_sql("heads, averaged", "t"))
def head_ensembles(spark, sf_dir):
    """Averages of the heads of two or three sources, of their probabilities and of their logits, over all rows."""
    e = data.embeddings(spark, sf_dir)
    d = e.select("source", "y", F.posexplode("x").alias("dim", "v")).groupBy("source", "dim").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.avg(F.when(F.col("y") == 1, F.col("v"))).alias("m1"), F.avg(F.when(F.col("y") == 0, F.col("v"))).alias("m0"))
    d = d.withColumn("std", F.when(F.col("std") == 0, F.lit(1.0)).otherwise(F.col("std"))).withColumn("w", (F.col("m1") - F.col("m0")) / F.col("std"))
    pick = lambda k, c: F.transform(F.array_sort(F.collect_list(F.when(F.col("source") == f"s{k}", F.struct("dim", "mean", "std", "w")))), lambda s: s[c]).alias(f"{c}{k}")
    heads = d.groupBy().agg(*[pick(k, c) for k in range(3) for c in ("mean", "std", "w")])  # one row: three heads, as long as the vector
    z = e.crossJoin(F.broadcast(heads)).select("y", *[V.dot(V.standardize(F.col("x"), F.col(f"mean{k}"), F.col(f"std{k}")), F.col(f"w{k}")).alias(f"z{k}") for k in range(3)])
    out = []
    for name, ks in _ENSEMBLES.items():
        total = lambda cs: sum(cs[1:], cs[0]) / len(cs)
        for kind, p in (("probability", total([V.sigmoid(F.col(f"z{k}")) for k in ks])), ("logit", V.sigmoid(total([F.col(f"z{k}") for k in ks])))):
            out.append(F.struct(F.lit(name).alias("heads"), F.lit(kind).alias("averaged"), F.round(p, 9).alias("p")))
    s = z.select("y", F.explode(F.array(*out)).alias("o")).select("y", "o.*")
    return M.auc(s, ("heads", "averaged")).select("heads", "averaged", "auc")


@query(_CLEAN + "SELECT row_id, y, p FROM scores")
def head_round_trip(spark, sf_dir):
    """The fitted head written as a table, read back with its backbone checked, and applied to the clean view."""
    e = data.embeddings(spark, sf_dir).select("row_id", "y", "x")
    path = checkpoint_folder(spark, "head")
    write_head(spark, scoring.fit_centroid_head(e).first().asDict(), "vec64", path)
    return scoring.score(e, read_head(spark, path, "vec64")).select("row_id", "y", "p")


@query()
def multi_view_head(spark, sf_dir):
    """A head trained on some views of one tier and extra rows of another, reported on all views: which it has not seen, and its AUC there."""
    e = data.embeddings(spark, sf_dir)
    learned = ["clean", "jpeg_q30", "chain_heavy"]
    head = training.train_on_views(e.filter("tier = 'val'"), [e.filter("tier = 'social'")], learned, exclude=["g9"])
    h = spark.createDataFrame([tuple(head[k] for k in ("mean", "std", "weights", "bias"))], "mean array<double>, std array<double>, weights array<double>, bias double")
    s = scoring.score_views(e.filter("tier = 'ood'"), h)
    return M.auc(s, ("view",)).select("view", F.col("view").isin(learned).alias("learned"), "auc")


_WEIGHT = " + ".join(f"(u >= {c!r}::DOUBLE)::INT" for c in S.POISSON)


@query(_TWO + f""", k AS (SELECT view, path, p FROM scores WHERE y = 1),
u AS (SELECT view, p, b, ('0x' || substr(sha1('boot::' || b || '::' || path), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM k CROSS JOIN range(0, {REPLICATES}) t(b)),
r AS (SELECT b, view, sum(({_WEIGHT}) * (p >= {SHIP})::INT)::DOUBLE / sum({_WEIGHT}) AS recall FROM u GROUP BY b, view),
f AS (SELECT b, max(recall) FILTER (view = 'clean') - max(recall) FILTER (view = 'chain_heavy') AS diff FROM r GROUP BY b)
SELECT round((SELECT avg((p >= {SHIP})::INT::DOUBLE) FILTER (view = 'clean') - avg((p >= {SHIP})::INT::DOUBLE) FILTER (view = 'chain_heavy') FROM k), 6) AS difference,
  round(quantile_cont(diff, 0.025), 6) AS low, round(quantile_cont(diff, 0.975), 6) AS high FROM f""")
def recall_difference_interval(spark, sf_dir):
    """A 95 % interval of the difference in recall between the clean view and the heaviest chain, by a Poisson bootstrap over images."""
    s = data.scores(spark, sf_dir, _PAIR).filter("y = 1").select("view", "path", (F.col("p") >= SHIP).cast("int").alias("hit"))
    w = s.select("view", "hit", F.posexplode(S.poisson_weights("path", REPLICATES)).alias("b", "w"))
    r = w.groupBy("b").pivot("view", _PAIR).agg((F.sum(F.col("w") * F.col("hit")) / F.sum("w")).alias("recall"))
    f = r.agg(F.percentile(F.col("clean") - F.col("chain_heavy"), F.lit(0.025)).alias("low"), F.percentile(F.col("clean") - F.col("chain_heavy"), F.lit(0.975)).alias("high"))  # one row a replicate
    d = s.agg((F.avg(F.when(F.col("view") == "clean", F.col("hit"))) - F.avg(F.when(F.col("view") == "chain_heavy", F.col("hit")))).alias("difference"))
    return d.crossJoin(F.broadcast(f)).select(*[F.round(c, 6).alias(c) for c in ("difference", "low", "high")])

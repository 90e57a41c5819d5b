"""Robustness reports over the scored views, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftlab.operators import metrics as M
from driftlab.operators import scoring, views
from driftlab.plans import data
from driftlab.plans.sql_views import auc_sql, scores_cte

SHIP, MATCHED_FPR, MIN_GROUP = 0.6, 0.025, 10
GRID = [round(0.5 + 0.005 * k, 4) for k in range(100)]
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
_RATES = "avg(CASE WHEN y = 1 THEN (p >= {t})::INT::DOUBLE END) AS tpr, avg(CASE WHEN y = 0 THEN (p >= {t})::INT::DOUBLE END) AS fpr"
_DIM = "dim(generator, family, era, seen) AS (VALUES " + ", ".join(f"('{g}', '{f}', {e}, {str(s).lower()})" for g, f, e, s in data.GENERATORS) + ")"
_BEST = """d AS (SELECT p, sum(y) AS pos, sum(1 - y) AS neg FROM {src} GROUP BY p),
c AS (SELECT p, sum(pos) OVER (ORDER BY p DESC) AS tps, sum(neg) OVER (ORDER BY p DESC) AS fps FROM d),
l AS (SELECT *, lag(tps) OVER w AS t0, lead(tps) OVER w AS t1, lag(fps) OVER w AS f0, lead(fps) OVER w AS f1 FROM c WINDOW w AS (ORDER BY p DESC)),
v AS (SELECT p, tps, fps FROM l WHERE t0 IS NULL OR t1 IS NULL OR t1 - 2 * tps + t0 <> 0 OR f1 - 2 * fps + f0 <> 0),
b AS (SELECT p, (tps / (SELECT max(tps) FROM v)::DOUBLE + 1 - fps / (SELECT max(fps) FROM v)::DOUBLE) / 2 AS bacc FROM v),
o AS (SELECT max(p) AS upper, min(p) AS low FROM b WHERE bacc >= (SELECT max(bacc) FROM b) - 1e-12),
thr AS (SELECT round((upper + coalesce((SELECT max(p) FROM v WHERE p < low), least((SELECT min(p) FROM v), upper))) / 2, 9) AS threshold FROM o)"""


@query(_ALL + f", a AS ({auc_sql('view')}) SELECT v.view, v.ord, v.kind, a.auc, round(v.tpr, 6) AS tpr, round(v.fpr, 6) AS fpr, round((v.tpr + 1 - v.fpr) / 2, 6) AS bacc FROM (SELECT view, ord, kind, {_RATES.format(t='0.5')} FROM scores GROUP BY ALL) v JOIN a ON a.view = v.view")
def view_grid_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: AUC, TPR, FPR and balanced accuracy of each scored view."""
    s = data.scores(spark, sf_dir)
    r = M.rates(s, 0.5, ("view", "ord", "kind"))
    return r.join(M.auc(s, ("view",)).select("view", "auc"), "view").select("view", "ord", "kind", "auc", *[F.round(c, 6).alias(c) for c in ("tpr", "fpr", "bacc")])


@query(_ALL + auc_sql("view"))
def view_auc_grid(spark, sf_dir):
    return M.auc(data.scores(spark, sf_dir), ("view",)).select("view", "auc")


@query(_ALL + auc_sql("", "(SELECT * FROM scores WHERE view <> 'clean')"))
def pooled_auc(spark, sf_dir):
    """One ranking over all degraded views."""
    return M.auc(data.scores(spark, sf_dir).filter("view <> 'clean'")).select("auc")


def _per_view(spark, sf_dir):
    s = data.scores(spark, sf_dir)
    return s, M.auc(s, ("view", "ord", "kind")).select("view", "ord", "kind", "auc")


@query(_ALL + f", a AS ({auc_sql('view')}) SELECT round(avg(auc), 6) AS mean_auc, min(auc) AS worst_auc, arg_min(view, auc) AS worst_view, count(*) AS n_views FROM a WHERE view <> 'clean'")
def mean_worst_auc(spark, sf_dir):
    _, a = _per_view(spark, sf_dir)
    return a.filter("view <> 'clean'").agg(F.round(F.avg("auc"), 6).alias("mean_auc"), F.min("auc").alias("worst_auc"), F.min_by("view", F.struct("auc", "ord")).alias("worst_view"), F.count(F.lit(1)).alias("n_views"))


@query(_ALL + ", clean AS (SELECT * FROM scores WHERE view = 'clean'), " + _BEST.format(src="clean") + f", r AS (SELECT view, threshold, {_RATES.format(t='threshold')} FROM scores CROSS JOIN thr GROUP BY view, threshold) SELECT view, threshold, round((tpr + 1 - fpr) / 2, 6) AS bacc FROM r")
def balanced_accuracy(spark, sf_dir):
    """Every view at the one threshold that is best on the clean view."""
    s = data.scores(spark, sf_dir)
    t = M.best_balanced_threshold(s.filter("view = 'clean'"))
    return M.rates(s.crossJoin(F.broadcast(t)), F.col("threshold"), ("view", "threshold")).select("view", "threshold", F.round("bacc", 6).alias("bacc"))


@query(_ALL + f"SELECT view, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr FROM (SELECT view, {_RATES.format(t=SHIP)} FROM scores GROUP BY view)")
def tpr_fpr(spark, sf_dir):
    return M.rates(data.scores(spark, sf_dir), SHIP, ("view",)).select("view", F.round("tpr", 6).alias("tpr"), F.round("fpr", 6).alias("fpr"))


@query(_ALL + f"SELECT view, round(fpr, 6) AS fpr, round(1 - tpr, 6) AS fnr FROM (SELECT view, {_RATES.format(t=SHIP)} FROM scores WHERE view IN ('clean', 'jpeg_q30', 'chain_heavy') GROUP BY view)")
def fnr_tradeoff(spark, sf_dir):
    s = data.scores(spark, sf_dir, ["clean", "jpeg_q30", "chain_heavy"])
    return M.rates(s, SHIP, ("view",)).select("view", F.round("fpr", 6).alias("fpr"), F.round(1 - F.col("tpr"), 6).alias("fnr"))


_SWEEP = "g AS (SELECT round(0.5 + 0.005 * k, 4)::DOUBLE AS threshold FROM range(0, 100) t(k)), s AS (SELECT threshold, sum((p >= threshold AND y = 1)::INT)::BIGINT AS tp, sum((p >= threshold AND y = 0)::INT)::BIGINT AS fp, sum((p < threshold AND y = 1)::INT)::BIGINT AS fn, sum(1 - y) AS nn, sum(y) AS np FROM {src} CROSS JOIN g GROUP BY threshold)"


@query(_CLEAN + ", " + _SWEEP.format(src="scores") + " SELECT threshold, tp, fp, fn, round(fp / nn::DOUBLE, 6) AS fpr, round(tp / np::DOUBLE, 6) AS tpr, round(2.0 * tp / greatest(1, 2 * tp + fp + fn), 6)::DOUBLE AS f1 FROM s")
def f1_sweep(spark, sf_dir):
    return M.sweep(data.scores(spark, sf_dir, ["clean"]), GRID)


@query(_CLEAN + ", " + _BEST.format(src="scores") + " SELECT p, tps::BIGINT AS tps, fps::BIGINT AS fps FROM v")
def roc_vertices(spark, sf_dir):
    return M.roc_vertices(data.scores(spark, sf_dir, ["clean"])).select("p", "tps", "fps")


@query(_CLEAN + ", " + _BEST.format(src="scores") + " SELECT threshold FROM thr")
def best_threshold(spark, sf_dir):
    return M.best_balanced_threshold(data.scores(spark, sf_dir, ["clean"])).select("threshold")


def halves(df: DataFrame, key: str = "path", seed: str = "half-0") -> DataFrame:
    """df with half = A for the floor(n/2) rows that come first by a hash of the key. Ranked over distinct keys, ranges of the hash first."""
    h = F.sha1(F.concat(F.lit(seed + "::"), F.col(key)).cast("binary"))
    keys = df.select(key).distinct().withColumn("h", h).withColumn("_b", F.substring("h", 1, 2))
    before = keys.groupBy("_b").count().select("_b", (F.sum("count").over(Window.orderBy("_b")) - F.col("count")).alias("before"), F.sum("count").over(Window.partitionBy()).alias("n"))  # 256 rows
    ranked = keys.join(F.broadcast(before), "_b").withColumn("rank", F.col("before") + F.row_number().over(Window.partitionBy("_b").orderBy("h", key)))
    return df.join(ranked.select(key, F.when(F.col("rank") <= F.floor(F.col("n") / 2), F.lit("A")).otherwise(F.lit("B")).alias("half")), key)


_HALF = "hr AS (SELECT path, row_number() OVER (ORDER BY sha1('half-0::' || path), path) AS rk, count(*) OVER () AS n FROM (SELECT DISTINCT path FROM scores)), half AS (SELECT s.*, CASE WHEN rk <= n // 2 THEN 'A' ELSE 'B' END AS half FROM scores s JOIN hr USING (path))"


@query(_CLEAN + f", {_HALF} SELECT half, y, count(*) AS n FROM half GROUP BY ALL")
def half_split(spark, sf_dir):
    return halves(data.scores(spark, sf_dir, ["clean"])).groupBy("half", "y").agg(F.count(F.lit(1)).alias("n"))


_CDN = scores_cte(list(views.CDN_VIEWS))


@query(_CDN + f", {_HALF}, a AS (SELECT * FROM half WHERE half = 'A'), " + _SWEEP.format(src="a") + f", t AS (SELECT threshold FROM s ORDER BY round(2.0 * tp / greatest(1, 2 * tp + fp + fn), 6) DESC, threshold LIMIT 1) SELECT threshold, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr FROM (SELECT threshold, {_RATES.format(t='threshold')} FROM half CROSS JOIN t WHERE half = 'B' GROUP BY threshold)")
def derived_threshold(spark, sf_dir):
    """The threshold of the best F1 on half the images, over the views a browser sees; its rates on the other half."""
    s = halves(data.scores(spark, sf_dir, list(views.CDN_VIEWS)))
    t = M.sweep(s.filter("half = 'A'"), GRID).agg(F.max_by("threshold", F.struct("f1", -F.col("threshold"))).alias("threshold"))
    return M.rates(s.filter("half = 'B'").crossJoin(F.broadcast(t)), F.col("threshold"), ("threshold",)).select("threshold", F.round("tpr", 6).alias("tpr"), F.round("fpr", 6).alias("fpr"))


@query(_ALL + f"SELECT view, round(quantile_cont(p, {1 - MATCHED_FPR}) FILTER (y = 0), 9) AS threshold FROM scores GROUP BY view")
def matched_fpr_threshold(spark, sf_dir):
    q = M.quantile(data.scores(spark, sf_dir).filter("y = 0"), 1 - MATCHED_FPR, ("view",), "threshold")
    return q.withColumn("threshold", F.round("threshold", 9))


_ARMS = "t AS (SELECT view, quantile_cont(p, 0.975) FILTER (y = 0) AS thr FROM scores WHERE tier = 'social' GROUP BY view)"


@query(_ALL + f", {_ARMS} SELECT s.view, tier, round(avg((p >= thr)::INT::DOUBLE), 6) AS recall FROM scores s JOIN t ON s.view = t.view WHERE y = 1 GROUP BY s.view, tier")
def recall_at_matched_fpr(spark, sf_dir):
    """Each view's threshold for the same FPR on one tier's reals, applied to the others."""
    s = data.scores(spark, sf_dir)
    t = M.quantile(s.filter("tier = 'social' AND y = 0"), 1 - MATCHED_FPR, ("view",), "thr")
    return s.filter("y = 1").join(F.broadcast(t), "view").groupBy("view", "tier").agg(F.round(F.avg((F.col("p") >= F.col("thr")).cast("double")), 6).alias("recall"))


@query(_ALL + f", {_ARMS}, r AS (SELECT s.view, tier, avg((p >= thr)::INT::DOUBLE) AS recall FROM scores s JOIN t ON s.view = t.view WHERE y = 1 GROUP BY s.view, tier) SELECT view AS arm, 'matched_threshold' AS metric, 'social' AS tier, round(thr, 6) AS value FROM t UNION ALL SELECT view, 'recall', tier, round(recall, 6) FROM r UNION ALL SELECT view, 'mean_recall', 'all', round(avg(recall), 6) FROM r GROUP BY view")
def ablation_arms(spark, sf_dir):
    """Long table of arms (here: views): threshold, recall by tier, and the mean of those."""
    s = data.scores(spark, sf_dir)
    t = M.quantile(s.filter("tier = 'social' AND y = 0"), 1 - MATCHED_FPR, ("view",), "thr")
    r = s.filter("y = 1").join(F.broadcast(t), "view").groupBy("view", "tier").agg(F.avg((F.col("p") >= F.col("thr")).cast("double")).alias("recall"))
    row = lambda df, metric, tier, v: df.select(F.col("view").alias("arm"), F.lit(metric).alias("metric"), tier.alias("tier"), F.round(v, 6).alias("value"))
    mean = r.groupBy("view").agg(F.avg("recall").alias("recall"))
    return row(t, "matched_threshold", F.lit("social"), F.col("thr")).unionByName(row(r, "recall", F.col("tier"), F.col("recall"))).unionByName(row(mean, "mean_recall", F.lit("all"), F.col("recall")))


@query(_ALL + f", a AS ({auc_sql('view')}), b AS (SELECT view, (tpr + 1 - fpr) / 2 AS bacc FROM (SELECT view, {_RATES.format(t=SHIP)} FROM scores GROUP BY view)), j AS (SELECT * FROM a JOIN b USING (view)) SELECT round(max(auc) FILTER (view = 'clean') - avg(auc) FILTER (view <> 'clean'), 6) AS auc_gap, round(max(bacc) FILTER (view = 'clean') - avg(bacc) FILTER (view <> 'clean'), 6) AS bacc_gap, round(0.5 * max(auc) FILTER (view = 'clean') + 0.5 * avg(auc) FILTER (view <> 'clean'), 6) AS score_mean, round(0.5 * max(auc) FILTER (view = 'clean') + 0.5 * min(auc) FILTER (view <> 'clean'), 6) AS score_worst FROM j")
def robustness_gap(spark, sf_dir):
    s, a = _per_view(spark, sf_dir)
    j = a.join(M.rates(s, SHIP, ("view",)), "view")
    clean = lambda c: F.max(F.when(F.col("view") == "clean", F.col(c)))
    rest = lambda f, c: f(F.when(F.col("view") != "clean", F.col(c)))
    return j.agg(
        F.round(clean("auc") - rest(F.avg, "auc"), 6).alias("auc_gap"), F.round(clean("bacc") - rest(F.avg, "bacc"), 6).alias("bacc_gap"),
        F.round(0.5 * clean("auc") + 0.5 * rest(F.avg, "auc"), 6).alias("score_mean"), F.round(0.5 * clean("auc") + 0.5 * rest(F.min, "auc"), 6).alias("score_worst"),
    )


_PARTS = [(c, v, i) for c in views.CHAINS for i, v in enumerate(views.component_views(c))]


@query(_ALL + f", a AS ({auc_sql('view')}), parts(chain, part, place) AS (VALUES {', '.join(f"('{c}', '{v}', {i})" for c, v, i in _PARTS)}) SELECT chain, max(c.auc) AS chain_auc, arg_min(part, p.auc) AS weakest, min(p.auc) AS weakest_auc, round(max(c.auc) - min(p.auc), 6) AS penalty FROM parts JOIN a c ON c.view = chain JOIN a p ON p.view = part GROUP BY chain")
def composition_penalty(spark, sf_dir):
    """Each chain against the weakest of the views that it is made of."""
    _, a = _per_view(spark, sf_dir)
    parts = spark.createDataFrame(_PARTS, "chain string, part string, place int")
    j = F.broadcast(parts).join(a.select(F.col("view").alias("chain"), F.col("auc").alias("chain_auc")), "chain").join(a.select(F.col("view").alias("part"), "auc"), "part")
    return j.groupBy("chain", "chain_auc").agg(F.min_by("part", F.struct("auc", "place")).alias("weakest"), F.min("auc").alias("weakest_auc")).withColumn("penalty", F.round(F.col("chain_auc") - F.col("weakest_auc"), 6))


@query(_ALL + f", a AS ({auc_sql('view, kind')}) SELECT round(avg(auc) FILTER (kind = 'single'), 6) AS single_mean, round(avg(auc) FILTER (kind = 'chain'), 6) AS chain_mean, round(avg(auc) FILTER (kind = 'chain') - avg(auc) FILTER (kind = 'single'), 6) AS delta FROM a WHERE view <> 'clean'")
def chain_vs_single(spark, sf_dir):
    _, a = _per_view(spark, sf_dir)
    mean = lambda k: F.avg(F.when(F.col("kind") == k, F.col("auc")))
    return a.filter("view <> 'clean'").agg(F.round(mean("single"), 6).alias("single_mean"), F.round(mean("chain"), 6).alias("chain_mean"), F.round(mean("chain") - mean("single"), 6).alias("delta"))


def _generator_auc(df: DataFrame) -> DataFrame:
    return M.against_all_reals(df, "generator").filter(F.col("n") >= MIN_GROUP)


def _gen_sql(src: str, name: str) -> str:
    return f"{name} AS (SELECT f.generator, count(*) AS n, round(avg(f.share) / max(f.nn), 6) AS auc FROM (SELECT generator, (SELECT count(*) FROM {src} r WHERE r.y = 0) AS nn, (SELECT count(*) FROM {src} r WHERE r.y = 0 AND r.p < s.p) + 0.5::DOUBLE * (SELECT count(*) FROM {src} r WHERE r.y = 0 AND r.p = s.p) AS share FROM {src} s WHERE y = 1) f GROUP BY f.generator HAVING count(*) >= {MIN_GROUP})"


_GEN = f"{_ALL}, {_DIM}, cl AS (SELECT * FROM scores WHERE view = 'clean'), dg AS (SELECT * FROM scores WHERE view <> 'clean'), {_gen_sql('cl', 'gc')}, {_gen_sql('dg', 'gd')}, gen AS (SELECT gc.generator, coalesce(family, 'unknown') AS family, coalesce(seen, false) AS seen, gc.n, gc.auc AS clean_auc, gd.auc AS degraded_auc FROM gc JOIN gd ON gc.generator = gd.generator LEFT JOIN dim ON dim.generator = gc.generator)"


def _generators(spark, sf_dir):
    s = data.scores(spark, sf_dir)
    clean = _generator_auc(s.filter("view = 'clean'")).withColumnRenamed("auc", "clean_auc")
    rest = _generator_auc(s.filter("view <> 'clean'")).select("generator", F.col("auc").alias("degraded_auc"))
    known = F.broadcast(data.generators(spark).select("generator", "family", "seen"))  # a fixed table of some dozens
    return clean.join(rest, "generator").join(known, "generator", "left").withColumns({"family": F.coalesce("family", F.lit("unknown")), "seen": F.coalesce("seen", F.lit(False))}).select("generator", "family", "seen", "n", "clean_auc", "degraded_auc")


@query(_GEN + " SELECT * FROM gen")
def per_generator_auc(spark, sf_dir):
    """Each generator's rows against the real rows of all sources, clean and pooled over the degraded views."""
    return _generators(spark, sf_dir)


@query(_GEN + " SELECT family, count(*) AS generators, round(avg(clean_auc), 6) AS clean_auc, round(avg(degraded_auc), 6) AS degraded_auc FROM gen GROUP BY family")
def family_means(spark, sf_dir):
    return _generators(spark, sf_dir).groupBy("family").agg(F.count(F.lit(1)).alias("generators"), F.round(F.avg("clean_auc"), 6).alias("clean_auc"), F.round(F.avg("degraded_auc"), 6).alias("degraded_auc"))


@query(_GEN + " SELECT generator, family, round(clean_auc - degraded_auc, 6) AS drop, row_number() OVER (ORDER BY clean_auc - degraded_auc DESC, generator) AS rank FROM gen")
def collapse_ranking(spark, sf_dir):
    """Generators by how much they lose when degraded (one row a generator, so one task orders them)."""
    g = _generators(spark, sf_dir).withColumn("lost", F.col("clean_auc") - F.col("degraded_auc"))
    return g.select("generator", "family", F.round("lost", 6).alias("drop"), F.row_number().over(Window.orderBy(F.col("lost").desc(), "generator")).cast("long").alias("rank"))


@query(_ALL + f", {_DIM} SELECT s.generator, count(*) AS n, round(avg((p >= {SHIP})::INT::DOUBLE), 6) AS fpr, round(avg((p >= 0.5)::INT::DOUBLE), 6) AS fpr_half, round(avg((p >= 0.99)::INT::DOUBLE), 6) AS fpr_99, round(avg(p), 6) AS mean_p, avg((p >= {SHIP})::INT::DOUBLE) > 0.25 AS flagged FROM scores s JOIN dim USING (generator) WHERE family = 'real' AND y = 0 AND view = 'clean' GROUP BY s.generator HAVING count(*) >= {MIN_GROUP}")
def real_source_fpr(spark, sf_dir):
    s = data.scores(spark, sf_dir, ["clean"]).filter("y = 0").join(F.broadcast(data.generators(spark).filter("family = 'real'").select("generator")), "generator")
    at = lambda t: F.avg((F.col("p") >= t).cast("double"))
    return s.groupBy("generator").agg(F.count(F.lit(1)).alias("n"), F.round(at(SHIP), 6).alias("fpr"), F.round(at(0.5), 6).alias("fpr_half"), F.round(at(0.99), 6).alias("fpr_99"), F.round(F.avg("p"), 6).alias("mean_p"), (at(SHIP) > 0.25).alias("flagged")).filter(F.col("n") >= MIN_GROUP)


@query(_CLEAN + f", {_DIM} SELECT s.generator, coalesce(family, 'unknown') AS family, era, count(*) AS n, round(avg((p >= {SHIP})::INT::DOUBLE), 6) AS recall FROM scores s LEFT JOIN dim USING (generator) WHERE y = 1 GROUP BY ALL")
def generator_recall(spark, sf_dir):
    s = data.scores(spark, sf_dir, ["clean"]).filter("y = 1").join(F.broadcast(data.generators(spark)), "generator", "left")
    return s.groupBy("generator", F.coalesce("family", F.lit("unknown")).alias("family"), "era").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("p") >= SHIP).cast("double")), 6).alias("recall"))


_SUM = f"{_ALL}, a AS ({auc_sql('tier, view, kind')}), b AS (SELECT tier, view, (tpr + 1 - fpr) / 2 AS bacc FROM (SELECT tier, view, {_RATES.format(t=SHIP)} FROM scores GROUP BY tier, view)), j AS (SELECT a.*, b.bacc FROM a JOIN b ON a.tier = b.tier AND a.view = b.view)"


@query(_SUM + """ SELECT tier, 'clean' AS condition, 1::BIGINT AS n_views, auc, round(bacc, 6) AS bacc, '' AS worst_view FROM j WHERE view = 'clean'
UNION ALL SELECT tier, 'transformed_mean', count(*), round(avg(auc), 6), round(avg(bacc), 6), '' FROM j WHERE view <> 'clean' GROUP BY tier
UNION ALL SELECT tier, 'transformed_single_mean', count(*), round(avg(auc), 6), NULL, '' FROM j WHERE view <> 'clean' AND kind = 'single' GROUP BY tier
UNION ALL SELECT tier, 'transformed_chained_mean', count(*), round(avg(auc), 6), NULL, '' FROM j WHERE kind = 'chain' GROUP BY tier
UNION ALL SELECT tier, 'transformed_worst', 1, min(auc), round(arg_min(bacc, auc), 6), arg_min(view, auc) FROM j WHERE view <> 'clean' GROUP BY tier""")
def robustness_summary(spark, sf_dir):
    """Five conditions for each tier."""
    s = data.scores(spark, sf_dir)
    by = ("tier", "view", "kind", "ord")
    j = M.auc(s, by).join(M.rates(s, SHIP, ("tier", "view")), ["tier", "view"])
    rest, single, chain = F.col("view") != "clean", (F.col("view") != "clean") & (F.col("kind") == "single"), F.col("kind") == "chain"
    mean = lambda ok, c: F.round(F.avg(F.when(ok, F.col(c))), 6)
    worst = F.min(F.when(rest, F.struct("auc", "ord", "view", "bacc")))
    none, blank = F.lit(None).cast("double"), F.lit("")
    row = lambda name, n, a, b, v: F.struct(F.lit(name).alias("condition"), n.cast("long").alias("n_views"), a.alias("auc"), b.alias("bacc"), v.alias("worst_view"))
    rows = F.array(
        row("clean", F.lit(1), F.max(F.when(~rest, F.col("auc"))), F.round(F.max(F.when(~rest, F.col("bacc"))), 6), blank),
        row("transformed_mean", F.count_if(rest), mean(rest, "auc"), mean(rest, "bacc"), blank),
        row("transformed_single_mean", F.count_if(single), mean(single, "auc"), none, blank),
        row("transformed_chained_mean", F.count_if(chain), mean(chain, "auc"), none, blank),
        row("transformed_worst", F.lit(1), worst["auc"], F.round(worst["bacc"], 6), worst["view"]),
    )
    return j.groupBy("tier").agg(rows.alias("r")).select("tier", F.explode("r").alias("r")).select("tier", "r.*")


@query(_CLEAN + f", t(threshold) AS (VALUES (0.5::DOUBLE), ({SHIP}::DOUBLE)) SELECT coalesce(source, 'all') AS platform, threshold, round(avg((p >= threshold)::INT::DOUBLE), 6) AS fpr, count(*) AS n FROM scores CROSS JOIN t WHERE y = 0 GROUP BY GROUPING SETS ((source, threshold), (threshold))")
def platform_fpr(spark, sf_dir):
    s = data.scores(spark, sf_dir, ["clean"]).filter("y = 0").select("source", "p", F.explode(F.array(F.lit(0.5), F.lit(SHIP))).alias("threshold"))
    s.createOrReplaceTempView("_platform")
    out = spark.sql("SELECT coalesce(source, 'all') AS platform, threshold, round(avg(CAST(p >= threshold AS DOUBLE)), 6) AS fpr, count(*) AS n FROM _platform GROUP BY GROUPING SETS ((source, threshold), (threshold))")
    spark.catalog.dropTempView("_platform")
    return out


@query(_ALL + f", a AS ({auc_sql('tier, view')}) SELECT view, " + ", ".join(f"max(auc) FILTER (tier = '{t}') AS {t}" for t in data.TIERS) + " FROM a GROUP BY view")
def view_tier_pivot(spark, sf_dir):
    return M.auc(data.scores(spark, sf_dir), ("tier", "view")).groupBy("view").pivot("tier", list(data.TIERS)).agg(F.first("auc"))


@query(_ALL + f", pair AS (SELECT view, p, 1 AS y FROM scores WHERE y = 1 AND tier = 'ood' UNION ALL SELECT view, p, 0 FROM scores WHERE y = 0 AND tier = 'social') {auc_sql('view', 'pair')}")
def cross_tier_pairing(spark, sf_dir):
    """One tier's generated rows against another's real ones."""
    s = data.scores(spark, sf_dir).filter("(y = 1 AND tier = 'ood') OR (y = 0 AND tier = 'social')")
    return M.auc(s, ("view",)).select("view", "auc")


_TOPK = f"SELECT view, kind, rank, row_id, generator, p FROM (SELECT view, 'FP' AS kind, row_number() OVER (PARTITION BY view ORDER BY p DESC, row_id) AS rank, row_id, generator, p FROM scores WHERE y = 0 AND p >= {SHIP} UNION ALL SELECT view, 'FN', row_number() OVER (PARTITION BY view ORDER BY p, row_id), row_id, generator, p FROM scores WHERE y = 1 AND p < {SHIP}) WHERE rank <= 8"


@query(_ALL + _TOPK)
def topk_errors(spark, sf_dir):
    """The eight most confident errors of either kind in each view; the rank limit is applied before the shuffle."""
    s = data.scores(spark, sf_dir)
    wrong = s.filter(((F.col("y") == 0) & (F.col("p") >= SHIP)) | ((F.col("y") == 1) & (F.col("p") < SHIP))).withColumn("kind", F.when(F.col("y") == 0, F.lit("FP")).otherwise(F.lit("FN")))
    worst = F.when(F.col("kind") == "FP", -F.col("p")).otherwise(F.col("p"))
    ranked = wrong.withColumn("rank", F.row_number().over(Window.partitionBy("view", "kind").orderBy(worst, "row_id"))).filter("rank <= 8")
    return ranked.select("view", "kind", F.col("rank").cast("long").alias("rank"), "row_id", "generator", "p")


@query(_CLEAN + ", " + _SWEEP.format(src="scores") + f" SELECT threshold, round(fp / nn::DOUBLE, 6) AS fpr, round(tp / np::DOUBLE, 6) AS tpr FROM s ORDER BY abs(threshold - {SHIP}::DOUBLE), threshold LIMIT 1")
def nearest_threshold(spark, sf_dir):
    """The row of the sweep that is nearest to a threshold."""
    s = M.sweep(data.scores(spark, sf_dir, ["clean"]), GRID)
    best = s.agg(F.min_by(F.struct("threshold", "fpr", "tpr"), F.struct(F.abs(F.col("threshold") - F.lit(SHIP)), F.col("threshold"))).alias("r"))
    return best.select("r.*")


_SCALER = _CLEAN.split(",\nviews AS")[0]


@query(_SCALER + " SELECT (dim - 1)::INT AS dim, round(mean, 9) AS mean, round(std, 9) AS std FROM sc")
def scaler_stats(spark, sf_dir):
    return scoring.scaler_stats(data.embeddings(spark, sf_dir)).select("dim", F.round("mean", 9).alias("mean"), F.round("std", 9).alias("std"))


@query(_CLEAN + " SELECT row_id, y, p FROM scores")
def linear_scores(spark, sf_dir):
    return data.scores(spark, sf_dir, ["clean"]).select("row_id", "y", "p")


@query(_CLEAN + f", a AS ({auc_sql('source')}), u AS (SELECT source, auc FROM a UNION ALL SELECT 'pooled', auc FROM ({auc_sql('')})) SELECT * FROM u")
def per_source_auc_rollup(spark, sf_dir):
    """AUC of each source that has both classes, and of all together."""
    s = data.scores(spark, sf_dir, ["clean"])
    return M.auc(s, ("source",)).filter("auc IS NOT NULL").select("source", "auc").unionByName(M.auc(s).select(F.lit("pooled").alias("source"), "auc"))


@query(_ALL + f", t AS (SELECT view, min(p) AS thr FROM (SELECT view, p, row_number() OVER (PARTITION BY view ORDER BY p DESC) AS rk, count(*) OVER (PARTITION BY view) AS n FROM scores WHERE y = 1) WHERE rk <= ceil(0.9 * n) GROUP BY view) SELECT s.view, thr AS threshold, round(avg((p >= thr)::INT::DOUBLE), 6) AS fpr FROM scores s JOIN t ON s.view = t.view WHERE y = 0 GROUP BY s.view, thr")
def fpr_at_matched_recall(spark, sf_dir):
    """The FPR at the highest threshold with a recall of 0.9 or more."""
    s = data.scores(spark, sf_dir)
    d = M.cumulative(s.filter("y = 1").groupBy("view", "p").agg(F.count(F.lit(1)).alias("pos")), ("view",), columns=("pos",), descending=True)
    n = d.groupBy("view").agg(F.sum("pos").alias("n"))
    t = d.join(F.broadcast(n), "view").filter(F.col("pos_before") + F.col("pos") >= F.ceil(0.9 * F.col("n"))).groupBy("view").agg(F.max("p").alias("threshold"))
    return s.filter("y = 0").join(F.broadcast(t), "view").groupBy("view", "threshold").agg(F.round(F.avg((F.col("p") >= F.col("threshold")).cast("double")), 6).alias("fpr"))

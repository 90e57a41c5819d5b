"""Queries that check a corpus, a cache, a head or a protocol, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftlab.operators import metrics as M
from driftlab.operators import probes, training, views
from driftlab.plans import data, robustness
from driftlab.plans.corpus import _M
from driftlab.plans.sql_views import scores_cte
from driftlab.sources import files

QUERIES: dict = {}
SQL: dict[str, str] = {}
TOLERANCE = 5e-5
_CLEAN = scores_cte(["clean"])


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query()
def blind_probe_sources(spark, sf_dir):
    """Whether sums of a vector's quarters tell the classes apart in each source, and in all: fitted on a stratified 70 %, judged on the rest."""
    cheap = F.array(*[F.aggregate(F.slice("x", 4 * i + 1, 4), F.lit(0.0), lambda a, v: a + v) for i in range(16)])
    e = data.embeddings(spark, sf_dir).select("path", "y", "source", cheap.alias("x"))
    return probes.blind_probes(e, "source", "path")


_SPREAD = "CASE WHEN len(list_filter(embedding, lambda c: abs(c) > 0.1)) IS NULL THEN 0 ELSE len(list_filter(embedding, lambda c: abs(c) > 0.1)) END"


@query(_CLEAN + f""", a AS (SELECT s.y, s.p, {_SPREAD} AS a FROM scores s JOIN embeddings ON vec_id = row_id),
l AS (SELECT y, rank() OVER (PARTITION BY y ORDER BY p) + (count(*) OVER (PARTITION BY y, p) - 1) / 2.0 AS rp, rank() OVER (PARTITION BY y ORDER BY a) + (count(*) OVER (PARTITION BY y, a) - 1) / 2.0 AS ra FROM a)
SELECT y, count(*) AS n, round(corr(rp::DOUBLE, ra::DOUBLE), 6) AS spearman FROM l GROUP BY y""")
def class_rank_correlation(spark, sf_dir):
    """Spearman's correlation of the score with a fact of the vector (its large components), within each class: a head that rides the fact shows it there."""
    fact = data.embeddings(spark, sf_dir).select("row_id", (F.size(F.filter("x", lambda c: F.abs(c) > F.lit(0.1).cast("float").cast("double"))) / 1024).alias("a"))
    s = data.scores(spark, sf_dir, ["clean"]).select("row_id", "y", "p").join(fact, "row_id")
    for c in ("p", "a"):
        d = M.cumulative(s.groupBy("y", c).agg(F.count(F.lit(1)).alias("neg")), ["y"], p=c)
        s = s.join(d.select("y", c, (F.col("neg_before") + (F.col("neg") + 1) / 2).alias(f"r{c}")), ["y", c])
    return s.groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.round(F.corr("rp", "ra"), 6).alias("spearman"))


@query(_M + """, a AS (SELECT label AS y, n_chars AS a FROM m JOIN documents d ON d.doc_id = m.doc_id), c AS (SELECT a, sum(y) AS pos, sum(1 - y) AS neg FROM a GROUP BY a),
r AS (SELECT a, sum(pos) OVER w / sum(pos) OVER ()::DOUBLE AS tp, sum(neg) OVER w / sum(neg) OVER ()::DOUBLE AS fp FROM c WINDOW w AS (ORDER BY a)),
b AS (SELECT a AS cut, CASE WHEN tp >= fp THEN 'at most' ELSE 'above' END AS side, round(0.5 + abs(tp - fp) / 2, 6) AS bacc FROM r)
SELECT cut, side, bacc FROM b ORDER BY bacc DESC, cut LIMIT 1""")
def attribute_best_cut(spark, sf_dir):
    """The cut of one attribute that tells the classes apart best, on which side the generated ones lie, and the balanced accuracy that it alone reaches."""
    d = data.table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").alias("a"))
    a = data.manifest(spark, sf_dir).join(d, "doc_id").select(F.col("label").alias("y"), "a")
    c = a.groupBy("a").agg(F.sum(F.col("y").cast("long")).alias("pos"), F.sum(1 - F.col("y").cast("long")).alias("neg"))
    r = M.cumulative(c.withColumn("p", F.col("a") / 1024), (), columns=("pos", "neg"))  # ranges of one length
    total = c.agg(F.sum("pos").alias("np"), F.sum("neg").alias("nn"))  # one row
    tp, fp = ((F.col(f"{k}_before") + F.col(k)) / F.col(n) for k, n in (("pos", "np"), ("neg", "nn")))
    b = r.crossJoin(F.broadcast(total)).select(F.col("a").alias("cut"), F.when(tp >= fp, "at most").otherwise("above").alias("side"), F.round(0.5 + F.abs(tp - fp) / 2, 6).alias("bacc"))
    return b.orderBy(F.desc("bacc"), "cut").limit(1)


@query("""WITH s AS (SELECT source, lang, length(bin(length(text))) AS size, count(*) AS c, sum(length(text)) AS chars FROM documents GROUP BY ALL), t AS (SELECT source, sum(c)::BIGINT AS n, count(*) AS n_shapes, round(max(c) / sum(c)::DOUBLE, 6) AS top_share, sum(chars) / sum(c)::DOUBLE AS mean FROM s GROUP BY source)
SELECT source, n, n_shapes, top_share, round(mean / (SELECT sum(chars) / sum(c)::DOUBLE FROM s), 6) AS mean_ratio FROM t""")
def corpus_provenance(spark, sf_dir):
    """How many shapes (language and size) each source has, the share of its most frequent one, and its mean length against all: one shape alone, or a mean off the others', tells a pipeline apart."""
    n = F.length("text")
    s = data.table(spark, sf_dir, "documents").groupBy("source", "lang", F.length(F.bin(n)).alias("size")).agg(F.count(F.lit(1)).alias("c"), F.sum(n).alias("chars"))
    all_ = s.agg((F.sum("chars") / F.sum("c")).alias("all"))  # one row
    t = s.groupBy("source").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("n_shapes"), F.round(F.max("c") / F.sum("c"), 6).alias("top_share"), (F.sum("chars") / F.sum("c")).alias("mean"))
    return t.crossJoin(F.broadcast(all_)).select("source", "n", "n_shapes", "top_share", F.round(F.col("mean") / F.col("all"), 6).alias("mean_ratio"))


PLATFORMS = ("src1", "src5", "src9")  # the first that a path contains counts
_PLATFORM = "CASE " + " ".join(f"WHEN contains(image_path, '{p}') THEN '{p}'" for p in PLATFORMS) + " ELSE 'other' END"


@query(_M + f", p AS (SELECT {_PLATFORM} AS platform, label FROM m) SELECT coalesce(platform, 'all') AS platform, count(*) AS n, count(*) FILTER (label = 0) AS n_real FROM p GROUP BY ROLLUP (platform)")
def platforms_by_substring(spark, sf_dir):
    """Rows and reals of each platform that a path names somewhere, and of all."""
    platform = F.lit("other")
    for p in reversed(PLATFORMS):
        platform = F.when(F.contains("image_path", F.lit(p)), p).otherwise(platform)
    m = data.manifest(spark, sf_dir).select(platform.alias("platform"), "label")
    return m.rollup("platform").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == 0).alias("n_real")).withColumn("platform", F.coalesce("platform", F.lit("all")))


_STORED = ("clean", "jpeg_q30", "resize_0.5x")


@query("SELECT view, (SELECT count(*) FROM embeddings) AS n, view = 'jpeg_q30' AS stale, CASE WHEN view = 'jpeg_q30' THEN 'older' ELSE fingerprint END AS fingerprint FROM (VALUES " + ", ".join(f"('{v}', '{views.view_fingerprint(v)}')" for v in _STORED) + ") t(view, fingerprint)")
def cached_fingerprints(spark, sf_dir):
    """The fingerprints that a written cache holds, against those of the views as they are now; one view was cached under an older one."""
    e, path = data.embeddings(spark, sf_dir).select("row_id", "path", "x"), files.checkpoint_folder(spark, "stored")
    names = list(_STORED)
    now = {v: views.view_fingerprint(v) for v in names}
    files.embed_or_reuse(spark, path, "vec64", "rows", now | {"jpeg_q30": "older"}, lambda todo: views.expand_views(e, todo, scored_only=False).select("row_id", "view", "x"))
    known = F.create_map(*[F.lit(x) for v in names for x in (v, now[v])])
    kept = spark.read.parquet(path).groupBy("view", F.col("view_fingerprint").alias("fingerprint")).agg(F.count(F.lit(1)).alias("n"))
    return kept.select("view", "n", (F.col("fingerprint") != known[F.col("view")]).alias("stale"), "fingerprint")


@query(scores_cte() + "SELECT view, view IN ('clean', 'jpeg_q30', 'chain_heavy') AS learned, count(*) AS n FROM scores GROUP BY view")
def learned_views(spark, sf_dir):
    """Which scored views a head that was trained, written and read again has learned from, and how many rows each has."""
    e = data.embeddings(spark, sf_dir)
    head, path = training.train_on_views(e, [], ["clean", "jpeg_q30", "chain_heavy"]), files.checkpoint_folder(spark, "learned-head")
    files.write_head(spark, head, "vec64", path)
    learned = spark.read.schema(files.HEAD).parquet(path).select(F.explode("views").alias("view"), F.lit(True).alias("learned"))
    counts = data.scores(spark, sf_dir).groupBy("view").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(F.broadcast(learned), "view", "left").select("view", F.coalesce("learned", F.lit(False)).alias("learned"), "n")  # a row a view


def protocol_check(recorded, derived, tolerance: float = TOLERANCE):
    """(name, threshold_ok, rates_ok, reproduced) of recorded and derived (name, threshold, fpr, tpr): a record without a derived row is not reproduced."""
    d = derived.select("name", *[F.col(c).alias(f"_{c}") for c in ("threshold", "fpr", "tpr")])
    near = lambda c, t: F.coalesce(F.abs(F.col(c) - F.col(f"_{c}")) < t, F.lit(False))
    out = recorded.join(d, "name", "left").select("name", near("threshold", 1e-9).alias("threshold_ok"), (near("fpr", tolerance) & near("tpr", tolerance)).alias("rates_ok"))
    return out.withColumn("reproduced", F.col("threshold_ok") & F.col("rates_ok"))


@query(f"WITH d AS ({robustness.SQL['derived_threshold']}), r AS (SELECT * FROM (VALUES ('as recorded', 0.0::DOUBLE, 0.0::DOUBLE), ('rates within', 0.0::DOUBLE, 0.00004::DOUBLE), ('rates off', 0.0::DOUBLE, 0.001::DOUBLE), ('threshold off', 0.005::DOUBLE, 0.0::DOUBLE)) t(name, dt, dr)) SELECT name, dt = 0 AND (SELECT count(*) FROM d) = 1 AS threshold_ok, dr < {TOLERANCE} AS rates_ok, dt = 0 AND dr < {TOLERANCE} AS reproduced FROM r")
def protocol_drift(spark, sf_dir):
    """Whether a threshold and its rates, derived anew, are those that a store recorded: once as they were, thrice moved a little."""
    path = files.checkpoint_folder(spark, "recorded")
    moves = spark.createDataFrame([("as recorded", 0.0, 0.0), ("rates within", 0.0, 0.00004), ("rates off", 0.0, 0.001), ("threshold off", 0.005, 0.0)], "name string, dt double, dr double")
    first = robustness.derived_threshold(spark, sf_dir)  # one row
    moves.crossJoin(F.broadcast(first)).select("name", (F.col("threshold") + F.col("dt")).alias("threshold"), (F.col("fpr") + F.col("dr")).alias("fpr"), "tpr").write.parquet(path)
    again = moves.select("name").crossJoin(F.broadcast(robustness.derived_threshold(spark, sf_dir)))
    return protocol_check(spark.read.parquet(path), again)

"""Queries of trainers, calibrations, neighbours, Merkle trees and matched probes, and their SQL."""

from __future__ import annotations

import string

from pyspark.sql import functions as F

from driftlab.operators import calibration as C
from driftlab.operators import frames, local_sgd, matching, merkle, views
from driftlab.operators import metrics as M
from driftlab.operators import selection as S
from driftlab.plans import data
from driftlab.plans.robustness import GRID
from driftlab.plans.sql_views import auc_sql, scores_cte
from driftlab.sources.files import checkpoint_folder

QUERIES: dict = {}
SQL: dict[str, str] = {}
#: the views to learn from: all single ones and the chains that are for training
LEARNED = [n for n in views.view_steps() if not views.is_chain(n) or n in views.TRAIN_CHAINS]
STEPS = {"workers": 4, "batch": 128, "rate": 1e-3}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- instrumented training -----------------------------------------------------------------------


def _views_of(rows, names, scored_only: bool):
    return views.named_views(rows, names, scored_only=scored_only).select(F.concat_ws("::", "path", "view").alias("key"), "view", "seed", "y", "x")


def _run(spark, sf_dir, epochs: int, validate: bool) -> local_sgd.Run:
    stored = data.table(spark, sf_dir, "embeddings").schema["embedding"].dataType  # rows travel as they are stored
    e = data.embeddings(spark, sf_dir).withColumn("x", F.col("x").cast(stored))
    learn, val = e.filter("tier <> 'val'"), e.filter("tier = 'val'")
    return local_sgd.train(_views_of(learn, LEARNED, False), "key", _views_of(val, None, True) if validate else None, clean=learn.withColumn("x", F.col("x").cast("array<double>")), epochs=epochs, eval_every=50, **STEPS)


@query()
def minibatch_curve(spark, sf_dir):
    """The loss of every step of a head's training, in its row and in trailing and epoch means."""
    e = data.embeddings(spark, sf_dir).select("row_id", "y", "x")
    return local_sgd.train(e, "row_id", epochs=1, **STEPS).steps


@query()
def train_loss_steps(spark, sf_dir):
    """The same over all views to learn from, for two epochs."""
    return _run(spark, sf_dir, 2, False).steps


@query()
def val_curve(spark, sf_dir):
    """AUC on the validation rows at the first step, every fiftieth and each epoch's last: clean, mean of the other views, and both."""
    return _run(spark, sf_dir, 2, True).curve


@query(f"WITH r AS (SELECT (label >= 5)::INT AS y FROM embeddings, range({len(LEARNED)}) WHERE vec_id % 4 <> 0), c AS (SELECT count(*) AS n_rows, sum(1 - y)::BIGINT AS n_real_rows, sum(y)::BIGINT AS n_fake_rows FROM r) SELECT 'linear' AS head, 1 AS epochs, 128 AS batch_size, 0.001::DOUBLE AS lr, n_rows, n_real_rows, n_fake_rows, round(n_real_rows / n_fake_rows::DOUBLE, 6) AS balance_pos_weight FROM c")
def training_meta(spark, sf_dir):
    """What a run tells of itself."""
    m = _run(spark, sf_dir, 1, False).meta
    kinds = "head string, epochs int, batch_size int, lr double, n_rows long, n_real_rows long, n_fake_rows long, balance_pos_weight double"
    return spark.createDataFrame([tuple(m[k.split()[0]] for k in kinds.split(", "))], kinds)


# --- calibration: fitted on even rows of the clean view, judged on odd ones -----------------------

_CLEAN = scores_cte(["clean"])
_PAV = (
    _CLEAN
    + """, f AS (SELECT p, count(*) AS n, sum(y) AS pos FROM scores WHERE row_id % 2 = 0 GROUP BY p),
c AS MATERIALIZED (SELECT row_number() OVER w AS i, p, n, pos, sum(n) OVER w AS cn, sum(pos) OVER w AS cp FROM f WINDOW w AS (ORDER BY p)),
m AS (SELECT a.i AS j, b.i AS k, (b.cp - a.cp + a.pos)::DOUBLE / (b.cn - a.cn + a.n)::DOUBLE AS mean FROM c a JOIN c b ON a.i <= b.i),
s AS (SELECT j, k, min(mean) OVER (PARTITION BY j ORDER BY k DESC) AS least FROM m),
v AS MATERIALIZED (SELECT c.i, any_value(p) AS p, any_value(n) AS n, any_value(pos) AS pos, max(least) AS value FROM s JOIN c ON c.i = s.k GROUP BY c.i)"""
)
_ODD = """, t AS (SELECT o.row_id, o.y, o.p AS raw, coalesce(v.value, (SELECT arg_min(value, p) FROM v)) AS isotonic FROM (SELECT * FROM scores WHERE row_id % 2 = 1) o ASOF LEFT JOIN v ON o.p >= v.p)"""


def _halves(spark, sf_dir):
    s = data.scores(spark, sf_dir, ["clean"]).select("row_id", "y", "p")
    return s.filter("row_id % 2 = 0"), s.filter("row_id % 2 = 1")


@query(_PAV + " SELECT min(p) AS lo, max(p) AS hi, sum(n)::BIGINT AS n, sum(pos)::BIGINT AS pos, round(value, 9) AS value FROM v GROUP BY value")
def isotonic_pools(spark, sf_dir):
    """The steps of the isotonic fit; the SQL is the min-max formula over all runs of scores."""
    pools = C.isotonic(_halves(spark, sf_dir)[0])
    return pools.withColumn("value", F.round("value", 9))


@query(_PAV + _ODD + " SELECT row_id, y, raw, round(isotonic, 9) AS isotonic FROM t")
def isotonic_scores(spark, sf_dir):
    fit, odd = _halves(spark, sf_dir)
    return C.apply_isotonic(odd, C.isotonic(fit)).select("row_id", "y", F.col("p").alias("raw"), F.round("isotonic", 9).alias("isotonic"))


_MAPS = ", l AS (SELECT 'raw' AS map, y, raw AS p FROM t UNION ALL SELECT 'isotonic', y, isotonic FROM t)"
_LOST = "SELECT map AS m, round(avg((p - y) * (p - y)), 6) AS brier, round(avg(-ln(CASE WHEN y = 1 THEN greatest(1e-12, least(1 - 1e-12, p)) ELSE 1 - greatest(1e-12, least(1 - 1e-12, p)) END)), 6) AS log_loss FROM l GROUP BY map"


def _losses(long):
    lost = long.groupBy("map").agg(F.round(S.brier(), 6).alias("brier"), F.round(S.log_loss(), 6).alias("log_loss"))
    return M.auc(long, ["map"]).select("map", "auc").join(lost, "map")


@query(_PAV + _ODD + _MAPS + f" SELECT map, auc, brier, log_loss FROM ({auc_sql('map', 'l')}) JOIN ({_LOST}) ON m = map")
def calibrated_losses(spark, sf_dir):
    """AUC, Brier and log loss of the held-out half, raw and calibrated: a step function ties scores, so its AUC may fall."""
    fit, odd = _halves(spark, sf_dir)
    both = C.apply_isotonic(odd, C.isotonic(fit))
    return _losses(both.select("y", F.explode(F.create_map(F.lit("raw"), "p", F.lit("isotonic"), "isotonic")).alias("map", "p")))


@query()
def platt_losses(spark, sf_dir):
    """The same of Platt's fit, which keeps the order and so the AUC."""
    fit, odd = _halves(spark, sf_dir)
    both = C.apply_platt(odd, C.platt(fit))
    return _losses(both.select("y", F.explode(F.create_map(F.lit("raw"), "p", F.lit("platt"), "platt")).alias("map", "p")))


# --- neighbours ------------------------------------------------------------------------------------


@query("""WITH l AS (SELECT event_id, user_id, epoch_us(ts) AS t FROM events WHERE event_type = 'error'),
r AS (SELECT user_id, epoch_us(ts) AS t, min(event_id) AS event_id FROM events WHERE event_type = 'view' GROUP BY ALL),
b AS (SELECT l.*, r.event_id AS before_id, r.t AS before_at FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.t >= r.t),
a AS (SELECT b.*, r.event_id AS after_id, r.t AS after_at FROM b ASOF LEFT JOIN r ON b.user_id = r.user_id AND b.t < r.t)
SELECT event_id, before_id, after_id, CASE WHEN after_at IS NULL OR t - before_at <= after_at - t THEN before_id ELSE after_id END AS nearest_id FROM a""")
def nearest_readings(spark, sf_dir):
    """For each error the same user's last view before it, the first after it and the nearer of the two."""
    e = data.table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    out = frames.nearest(e.filter("event_type = 'error'"), e.filter("event_type = 'view'"), "at", ["event_id"], ["user_id"])
    return out.select("event_id", F.col("before.event_id").alias("before_id"), F.col("after.event_id").alias("after_id"), F.col("nearest.event_id").alias("nearest_id"))


@query(scores_cte(["clean", "jpeg_q30"]) + f""", g AS (SELECT unnest({GRID!r})::DOUBLE AS t),
b AS (SELECT row_id, view, p, g.t AS lo FROM scores ASOF LEFT JOIN g ON p >= g.t), a AS (SELECT b.*, g.t AS hi FROM b ASOF LEFT JOIN g ON b.p < g.t)
SELECT row_id, view, CASE WHEN hi IS NULL OR p - lo <= hi - p THEN lo ELSE hi END AS threshold FROM a""")
def nearest_grid_threshold(spark, sf_dir):
    """The threshold of the sweep that is nearest to each score: a join without a key, whose rows still go by ranges."""
    grid = spark.createDataFrame([(float(t),) for t in GRID], "p double")
    out = frames.nearest(data.scores(spark, sf_dir, ["clean", "jpeg_q30"]).select("row_id", "view", "p"), grid, "p", ["p"])
    return out.select("row_id", "view", F.col("nearest.p").alias("threshold"))


# --- manifests that differ -----------------------------------------------------------------------

_M = "WITH m AS (SELECT concat_ws('/', d.source, d.lang, d.doc_id || '.jpg') AS path, d.doc_id, coalesce(l.quality, (d.doc_id % 2)::INT)::INT AS label, d.source FROM documents d LEFT JOIN labels l USING (doc_id))"
_B = ", b AS (SELECT CASE WHEN doc_id % 19 = 7 THEN 'moved/' || path ELSE path END AS path, CASE WHEN doc_id % 13 = 5 THEN 1 - label ELSE label END AS label, source FROM m WHERE doc_id % 17 <> 3)"


def _manifests(spark, sf_dir):
    m = data.manifest(spark, sf_dir).select(F.col("image_path").alias("path"), "doc_id", "label", "source")
    later = m.filter("doc_id % 17 <> 3").select(F.when(F.col("doc_id") % 19 == 7, F.concat(F.lit("moved/"), F.col("path"))).otherwise(F.col("path")).alias("path"), F.when(F.col("doc_id") % 13 == 5, 1 - F.col("label")).otherwise(F.col("label")).alias("label"), "source")
    return m.select("path", "label", "source"), later


@query(_M + _B + " SELECT coalesce(m.path, b.path) AS path, CASE WHEN m.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'lost' ELSE 'changed' END AS kind FROM m FULL JOIN b ON m.path = b.path WHERE m.path IS NULL OR b.path IS NULL OR m.label <> b.label OR m.source <> b.source")
def manifest_diff(spark, sf_dir):
    """Where two manifests differ, found through their Merkle trees; the SQL joins all of both."""
    return merkle.diff(*_manifests(spark, sf_dir), "path", ["path", "label", "source"])


@query(_M + _B + " SELECT a.n AS rows_before, c.n AS rows_after, false AS same FROM (SELECT count(*) AS n FROM m) a, (SELECT count(*) AS n FROM b) c")
def manifest_roots(spark, sf_dir):
    """The fingerprints of both manifests compared."""
    a, b = (merkle.tree(m, "path", ["path", "label", "source"]).filter("level = 0") for m in _manifests(spark, sf_dir))
    return a.select(F.col("n").alias("rows_before"), F.col("hash").alias("_a")).crossJoin(b.select(F.col("n").alias("rows_after"), F.col("hash").alias("_b"))).select("rows_before", "rows_after", (F.col("_a") == F.col("_b")).alias("same"))  # a row each


@query("""WITH v AS (SELECT 's' || (vec_id % 3) AS stem, 'vec/' || vec_id AS path, view FROM embeddings, (VALUES ('clean'), ('blur_s1'), ('jpeg_q30')) t(view) WHERE NOT (view = 'blur_s1' AND vec_id % 3 = 1 AND vec_id % 5 = 0)),
h AS (SELECT stem, view, sha1(string_agg(path, ',' ORDER BY path)) AS h FROM v GROUP BY ALL), c AS (SELECT stem, h AS clean FROM h WHERE view = 'clean')
SELECT stem, count(*) AS views, count(DISTINCT h) AS fingerprints, coalesce(string_agg(view, ',' ORDER BY view) FILTER (h <> clean), '') AS odd FROM h JOIN c USING (stem) GROUP BY stem""")
def stem_fingerprints(spark, sf_dir):
    """Whether all views of a stem were made of the same rows; here one view of one stem was made of fewer."""
    e = data.embeddings(spark, sf_dir).select("row_id", F.col("source").alias("stem"), "path", F.explode(F.array(*map(F.lit, ("clean", "blur_s1", "jpeg_q30")))).alias("view"))
    made = e.filter("NOT (view = 'blur_s1' AND row_id % 3 = 1 AND row_id % 5 = 0)")
    return merkle.stem_agreement(made).withColumn("odd", F.concat_ws(",", "odd"))


# --- probes with size and shape controlled -----------------------------------------------------------

_PROBES = {"vowels": "[^aeiou]", "marks": "[^.,;:!?]", "capitals": "[^A-Z]", "digits": "[^0-9]"}
_COUNTED = {"vowels": "aeiou", "marks": ".,;:!?", "capitals": string.ascii_uppercase, "digits": string.digits}  # what these leave
_D = (
    "WITH d AS (SELECT doc_id, l.quality AS y, length(bin(length(text))) AS size, (20 * len(string_split(text, ' '))) // length(text) AS shape, lang, "
    + ", ".join(f"length(regexp_replace(text, '{c}', '', 'g')) / length(text)::DOUBLE AS {k}" for k, c in _PROBES.items())
    + " FROM documents JOIN labels l USING (doc_id) WHERE length(text) > 0), st AS (SELECT size, shape, lang, count(*) FILTER (y = 1) AS n_pos, count(*) FILTER (y = 0) AS n_neg FROM d GROUP BY ALL)"
)


def _probes(spark, sf_dir):
    """Sizes, strata and shares of each text, written once: the texts are long, what is read of them several times is not."""
    d = data.table(spark, sf_dir, "documents").select("doc_id", "text", "lang").join(data.table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("y")), "doc_id").filter(F.length("text") > 0)
    n = F.length("text")
    count = lambda chars: n - F.length(F.translate("text", chars, ""))  # noqa: E731  how many of these a text has
    shares = [(count(chars) / n).alias(k) for k, chars in _COUNTED.items()]
    made = d.select("doc_id", "y", F.length(F.bin(n)).alias("size"), F.floor(20 * (count(" ") + 1) / n).cast("long").alias("shape"), "lang", *shares)
    path, schema = checkpoint_folder(spark, "probes"), made.schema
    made.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


@query(_D + ", k AS (SELECT sum(n_pos) AS p, sum(n_neg) AS n FROM st WHERE n_pos > 0 AND n_neg > 0), w AS (SELECT d.*, CASE WHEN n_pos > 0 AND n_neg > 0 THEN CASE WHEN y = 1 THEN 1.0::DOUBLE ELSE n_pos / n_neg::DOUBLE * (k.n / k.p::DOUBLE) END ELSE 0.0::DOUBLE END AS weight FROM d JOIN st USING (size, shape, lang), k), g AS (" + " UNION ALL ".join(f"SELECT '{k}' AS probe, round({k}, 12) AS p, y, weight FROM w" for k in _PROBES) + "), c AS (SELECT probe, p, sum((y = 1)::INT::DOUBLE) AS a, sum((y = 0)::INT::DOUBLE) AS b, sum(CASE WHEN y = 1 THEN weight ELSE 0.0 END) AS wa, sum(CASE WHEN y = 0 THEN weight ELSE 0.0 END) AS wb FROM g GROUP BY ALL), r AS (SELECT *, sum(b) OVER o - b AS below, sum(wb) OVER o - wb AS wbelow FROM c WINDOW o AS (PARTITION BY probe ORDER BY p)) SELECT probe, round(sum(a * (2 * below + b)) / (2 * sum(a) * sum(b)), 6) AS auc_before, round(sum(wa * (2 * wbelow + wb)) / (2 * sum(wa) * sum(wb)), 6) AS auc_after FROM r GROUP BY probe")
def matched_probes(spark, sf_dir):
    """How well cheap features of a text tell quality apart, before and after texts of like size, shape and language are weighed alike."""
    return matching.probe_auc(matching.weigh(_probes(spark, sf_dir), ["size", "shape", "lang"]), list(_PROBES))


@query(_D + " SELECT size::INT AS size, shape::BIGINT AS shape, lang, n_pos, n_neg FROM st WHERE n_pos = 0 OR n_neg = 0")
def unmatched_strata(spark, sf_dir):
    """Strata of size, shape and language without a counterpart in the other class."""
    return matching.strata_of(_probes(spark, sf_dir), ["size", "shape", "lang"]).filter("NOT matched").select("size", "shape", "lang", "n_pos", "n_neg")

"""Score-stream, curve and head queries, and the SQL of those that SQL can express."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from driftlab.operators import frames, training
from driftlab.operators import metrics as M
from driftlab.plans import data
from driftlab.plans.sql_views import scores_cte
from driftlab.streaming import scores as S

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_E = "WITH e AS (SELECT event_id, ts, user_id, event_type, round(value / (value + 50.0::DOUBLE), 9) AS pred FROM events)"


@query(f"""{_E}, k AS (SELECT *, CASE WHEN event_type IN ('view', 'click') THEN 'real' ELSE event_type END AS g FROM e WHERE event_id > 100),
q AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY event_id) AS nth FROM k), kept AS (SELECT * FROM q WHERE nth <= CASE WHEN g = 'real' THEN 300 ELSE 40 END),
sp AS (SELECT g, min(event_id) AS f, max(event_id) FILTER (nth = CASE WHEN g = 'real' THEN 300 ELSE 40 END) AS fu FROM kept GROUP BY g),
op AS (SELECT k.event_id, (SELECT count(*) FROM sp WHERE (sp.f <= k.event_id OR sp.g = 'real') AND (sp.fu IS NULL OR sp.fu > k.event_id)) AS open FROM kept k WHERE k.event_id >= 200)
SELECT event_id, event_type FROM kept WHERE event_id <= coalesce((SELECT min(event_id) FROM op WHERE open = 0), 9223372036854775807)""")
def quota_stream(spark, sf_dir):
    """What a quota'd reader keeps of the stream (the quotas are the operator's own limits)."""
    return S.quota_slice(data.stream_scores(spark, sf_dir), "event_id", "event_type", ["view", "click"], per_group=40, real_cap=300, skip=100, min_scan=200).select("event_id", "event_type")


@query(f"""{_E}, r AS (SELECT event_id, event_type = 'view' OR event_type = 'click' OR event_type = 'error' AS bad, count(*) OVER w AS seen, sum((event_type IN ('view', 'click', 'error'))::INT) OVER w AS bad_seen FROM e WINDOW w AS (ORDER BY event_id ROWS UNBOUNDED PRECEDING))
SELECT min(event_id) FILTER (bad AND seen >= 200 AND bad_seen / seen::DOUBLE > 0.5) AS abort_at, max(seen) AS seen, max(bad_seen)::BIGINT AS bad_seen FROM r""")
def gated_abort(spark, sf_dir):
    e = data.stream_scores(spark, sf_dir)
    return S.gated_abort(e, "event_id", F.col("event_type").isin("view", "click", "error"))


@query("SELECT event_id, user_id FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY props ORDER BY event_id) AS r FROM events) WHERE r = 1")
def url_dedup(spark, sf_dir):
    from driftlab.operators.manifests import keep_first

    return keep_first(data.table(spark, sf_dir, "events").select("event_id", "user_id", "props"), "props", ["event_id"]).drop("props")


@query(f"{_E} SELECT event_id, user_id, pred FROM (SELECT *, row_number() OVER (PARTITION BY user_id, time_bucket(INTERVAL 3 SECONDS, ts) ORDER BY ts, event_id) AS r FROM e) WHERE r = 1")
def sampled_windows(spark, sf_dir):
    return S.sampled(data.stream_scores(spark, sf_dir), "user_id", "ts", "event_id").select("event_id", "user_id", "pred")


@query(f"""WITH RECURSIVE {_E[5:]}, o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, event_type = 'signup' AS reset FROM e),
s AS (SELECT user_id, n, ts, event_id, CASE WHEN reset THEN NULL ELSE pred END AS ema FROM o WHERE n = 1
  UNION ALL SELECT o.user_id, o.n, o.ts, o.event_id, CASE WHEN o.reset THEN NULL ELSE coalesce(0.6::DOUBLE * o.pred + (1 - 0.6::DOUBLE) * s.ema, o.pred) END FROM s JOIN o ON o.user_id = s.user_id AND o.n = s.n + 1)
SELECT user_id, event_id, round(ema, 6) AS ema FROM s""")
def ema_scores(spark, sf_dir):
    e = data.stream_scores(spark, sf_dir)
    return S.ema_batch(e, "user_id", ["ts", "event_id"], "pred", F.col("event_type") == "signup").select("user_id", "event_id", F.round("ema", 6).alias("ema"))


@query(f"{_E} SELECT event_id, round(avg(pred) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 99 PRECEDING), 6) AS trailing FROM e")
def trailing_mean(spark, sf_dir):
    e = data.stream_scores(spark, sf_dir)
    return frames.trailing(e, ["user_id"], ["ts", "event_id"], {"trailing": F.avg("pred")}, 100).select("event_id", F.round("trailing", 6).alias("trailing"))


@query(f"{_E} SELECT event_id, date_trunc('day', ts)::DATE::VARCHAR AS epoch, round(sum(pred) OVER w / count(*) OVER w, 6) AS running FROM e WINDOW w AS (PARTITION BY user_id, date_trunc('day', ts) ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def cumulative_mean(spark, sf_dir):
    e = data.stream_scores(spark, sf_dir).withColumn("epoch", F.date_format("ts", "yyyy-MM-dd"))
    out = frames.cumulative(e, ["user_id", "epoch"], ["ts", "event_id"], {"_s": F.col("pred"), "_n": F.lit(1)})
    return out.select("event_id", "epoch", F.round(F.col("_s") / F.col("_n"), 6).alias("running"))


@query(f"{_E} SELECT event_type, arg_max(event_id, (ts, event_id)) AS last_event, round(arg_max(pred, (ts, event_id)), 6) AS last_pred, round(sum(pred * 2) / sum(2), 6) AS weighted FROM e GROUP BY event_type")
def last_per_epoch(spark, sf_dir):
    e, at = data.stream_scores(spark, sf_dir), F.struct("ts", "event_id")
    return e.groupBy("event_type").agg(F.max_by("event_id", at).alias("last_event"), F.round(F.max_by("pred", at), 6).alias("last_pred"), F.round(F.sum(F.col("pred") * 2) / F.sum(F.lit(2)), 6).alias("weighted"))


_C = scores_cte(["clean"])


@query(_C + """, l AS (SELECT y, row_id, p, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS rp, rank() OVER (ORDER BY row_id % 97) + (count(*) OVER (PARTITION BY row_id % 97) - 1) / 2.0 AS ra FROM scores)
SELECT round(corr(rp::DOUBLE, ra::DOUBLE), 6) AS spearman FROM l""")
def rank_correlation(spark, sf_dir):
    """Spearman's correlation of the score with an attribute, from mean ranks of distinct values."""
    s = data.scores(spark, sf_dir, ["clean"]).select("p", ((F.col("row_id") % 97) / 97.0).alias("a"), F.lit(1).alias("y"))
    for c in ("p", "a"):
        d = M.cumulative(s.groupBy(c).agg(F.count(F.lit(1)).alias("neg")), (), p=c)
        s = s.join(d.select(c, (F.col("neg_before") + (F.col("neg") + 1) / 2).alias(f"r{c}")), c)
    return s.agg(F.round(F.corr("rp", "ra"), 6).alias("spearman"))


@query()
def blind_probe(spark, sf_dir):
    """Whether cheap features alone tell the classes apart: (auc, bacc, warns)."""
    e = data.embeddings(spark, sf_dir)
    cheap = F.array(*[F.aggregate(F.slice("x", 4 * i + 1, 4), F.lit(0.0), lambda a, v: a + v) for i in range(16)])
    rows = e.select("row_id", "path", "y", cheap.alias("x"))
    part = F.pmod(F.xxhash64("path"), F.lit(10)) < 7  # 70 % to learn from, 30 % to probe
    w, b = training.logistic_head(rows.filter(part))
    s = training.score_linear(rows.filter(~part), w, b)
    r = M.rates(s, 0.5).select(F.round("bacc", 6).alias("bacc"))
    return M.auc(s).select("auc").crossJoin(r).withColumn("warns", F.col("bacc") >= 0.7)


@query()
def lr_head(spark, sf_dir):
    e = data.embeddings(spark, sf_dir).select("row_id", "y", "x")
    return training.score_linear(e, *training.logistic_head(e))


@query()
def mlp_head(spark, sf_dir):
    e = data.embeddings(spark, sf_dir).select("row_id", "y", "x")
    return training.score_mlp(e, training.mlp_head(e))


def _streamed(spark, out, name: str):
    """The rows of a stream that has read all there is, through a Parquet sink in the shared folder."""
    from driftlab.sources.files import checkpoint_folder

    table = f"{name}_{uuid.uuid4().hex[:8]}"
    path = checkpoint_folder(spark, f"{table}-rows")
    q = out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint_folder(spark, table)).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(out.schema).parquet(path)


def _event_stream(spark, sf_dir):
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(path if path.endswith("/") else sf_dir + "/events.parque[t]")


@query(SQL["ema_scores"])
def stream_ema_state(spark, sf_dir):
    e = _event_stream(spark, sf_dir).select("user_id", "event_id", F.round(F.col("value") / (F.col("value") + 50.0), 9).alias("pred"), "ts", (F.col("event_type") == "signup").alias("reset"))
    e = e.withColumn("at", F.struct("ts", "event_id").cast("string")).withColumn("at", F.concat(F.date_format("ts", "yyyyMMddHHmmssSSSSSS"), F.lpad(F.col("event_id").cast("string"), 20, "0")))
    out = _streamed(spark, S.ema_stream(e, "user_id", "pred", "at", "reset"), "ema")
    ema = F.round(F.when(~F.isnan("ema"), F.col("ema")), 6)
    return out.select("user_id", F.substring("at", 21, 20).cast("long").alias("event_id"), ema.alias("ema"))


@query(f"{_E} SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS r FROM e) WHERE r <= 50")
def stream_quota_state(spark, sf_dir):
    """The first fifty of each type (the operator's own quota), from a stream."""
    out = _streamed(spark, S.quota_stream(_event_stream(spark, sf_dir), "event_type", "event_id", 50), "quota")
    return S.first_of_group(out.select("event_type", "event_id"), "event_type", "event_id", 50)


@query("SELECT DISTINCT props FROM events")
def stream_url_dedup(spark, sf_dir):
    """Each URL (here: props) once within the watermark, from a stream."""
    e = _event_stream(spark, sf_dir).select("props", F.col("ts").cast("timestamp").alias("at"))
    return _streamed(spark, S.first_per_url(e, "props", "at", late="3650 days"), "urls").select("props")


@query(f"{_E} SELECT event_id // 500 AS batch, count(*) AS n, sum((event_type = 'error')::INT)::BIGINT AS failed, round(avg(pred) FILTER (event_type <> 'error'), 6) AS mean_pred FROM e GROUP BY ALL")
def batch_summary(spark, sf_dir):
    """Batches of a scoring service: how many failed, and the mean of the others."""
    e = data.stream_scores(spark, sf_dir)
    return e.groupBy(F.floor(F.col("event_id") / 500).cast("long").alias("batch")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("failed"), F.round(F.avg(F.when(F.col("event_type") != "error", F.col("pred"))), 6).alias("mean_pred"))

"""Queries that run a stream through several triggers, and their SQL, which sees all rows at once."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftlab.operators import scoring
from driftlab.plans import data, streams
from driftlab.plans.sql_views import scores_cte
from driftlab.sources.files import checkpoint_folder
from driftlab.streaming import live

QUERIES: dict = {}
SQL: dict[str, str] = {}
ARRIVALS = 3
_E = streams._E


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def arriving(spark, rows, position: str, step, between=lambda i: None) -> None:
    """rows come in ARRIVALS slices of their position's range; the stream takes what is new each time, at the batch where it stood."""
    folder, checkpoint = checkpoint_folder(spark, "arrived"), checkpoint_folder(spark, "stream")
    r = rows.agg(F.min(position).alias("lo"), F.max(position).alias("hi")).first()
    slice_of = F.lit(0) if r["lo"] is None else F.floor((F.col(position) - r["lo"]) * ARRIVALS / F.lit(r["hi"] - r["lo"] + 1))
    for i in range(ARRIVALS):
        between(i)
        rows.filter(slice_of == i).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(rows.schema).parquet(folder)
        live.drained(stream, step, checkpoint)


@query(streams.SQL["quota_stream"])
def stream_quota_stop(spark, sf_dir):
    """What a quota'd reader keeps until no group is open any more: a stream with state of groups and of the whole."""
    e = data.table(spark, sf_dir, "events").select("event_id", "event_type").withColumn("g", F.when(F.col("event_type").isin("view", "click"), "real").otherwise(F.col("event_type")))
    reader = live.QuotaReader(spark, checkpoint_folder(spark, "quota"), "event_id", "g", 40, {"real": 300}, ("real",), skip=100, min_scan=200)
    arriving(spark, e, "event_id", reader.step)
    kept = reader.rows().select("event_id")  # no more than the quotas
    return e.join(kept, "event_id", "left_semi").select("event_id", "event_type")


@query(f"""{_E}, r AS (SELECT event_id, event_type, coalesce(event_type IN ('view', 'click', 'error'), false) AS bad, count(*) OVER w AS seen, sum((event_type IN ('view', 'click', 'error'))::INT) OVER w AS bad_seen FROM e WINDOW w AS (ORDER BY event_id ROWS UNBOUNDED PRECEDING)),
a AS (SELECT min(event_id) FILTER (bad AND seen >= 200 AND bad_seen / seen::DOUBLE > 0.5) AS aborted_at FROM r),
k AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS nth FROM r WHERE NOT bad)
SELECT aborted_at, (SELECT count(*) FROM r WHERE event_id <= coalesce(aborted_at, 9223372036854775807)) AS seen, (SELECT count(*) FROM r WHERE bad AND event_id <= coalesce(aborted_at, 9223372036854775807)) AS bad_seen,
(SELECT count(*) FROM k WHERE nth <= 50 AND event_id <= coalesce(aborted_at, 9223372036854775807)) AS kept FROM a""")
def stream_gate(spark, sf_dir):
    """A reader with caps that gives up a source of which most rows are bad: where it did, and what it had seen and kept."""
    e = data.table(spark, sf_dir, "events").select("event_id", "event_type")
    reader = live.QuotaReader(spark, checkpoint_folder(spark, "gate"), "event_id", "event_type", 50, classes=("never",), bad=F.col("event_type").isin("view", "click", "error"))
    arriving(spark, e, "event_id", reader.step)
    s = reader.state()
    return reader.rows().agg(F.count(F.lit(1)).alias("kept")).select(F.lit(s["aborted"]).cast("long").alias("aborted_at"), F.lit(s["seen"]).cast("long").alias("seen"), F.lit(s["bad"]).cast("long").alias("bad_seen"), "kept")


@query("""WITH q AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS nth FROM events WHERE event_type IN ('signup', 'purchase', 'error')),
k AS (SELECT * FROM q WHERE nth <= 60), f AS (SELECT CASE WHEN count(*) FILTER (nth = 60) = 3 THEN max(event_id) FILTER (nth = 60) END AS full_at FROM k)
SELECT (SELECT count(*) FROM k) AS kept, (SELECT sum(event_id)::BIGINT FROM k) AS id_sum, (SELECT min(event_id) FROM q WHERE event_id > full_at) AS stopped_at FROM f""")
def stream_class_caps(spark, sf_dir):
    """A reader with a cap a class, which stops at the first row of a class that it finds full while all are."""
    e = data.table(spark, sf_dir, "events").select("event_id", "event_type")
    reader = live.QuotaReader(spark, checkpoint_folder(spark, "caps"), "event_id", "event_type", 60, classes=("signup", "purchase", "error"), stop="overflow")
    arriving(spark, e, "event_id", reader.step)
    stopped = reader.state()["stopped"]
    return reader.rows().agg(F.count(F.lit(1)).alias("kept"), F.sum("event_id").alias("id_sum")).withColumn("stopped_at", F.lit(stopped).cast("long"))


@query(f"{_E}, l AS (SELECT user_id, max(event_id) AS version, arg_max(event_type, event_id) AS kind, arg_max(pred, event_id) AS value FROM e GROUP BY user_id) SELECT user_id::VARCHAR AS key, version, value, NULL::VARCHAR AS error FROM l WHERE kind <> 'error'")
def stream_changes(spark, sf_dir):
    """A table of the newest scores of all elements that were not removed, from a stream of changes. Requests of the second batch fail and are put back."""
    e = data.stream_scores(spark, sf_dir)
    e = e.select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("version"), F.when(F.col("event_type") == "error", "delete").otherwise("upsert").alias("op"), F.col("pred").alias("value"))
    table = live.ChangeTable(spark, checkpoint_folder(spark, "changes"), fails=lambda i: F.lit(i == 1))
    arriving(spark, e, "version", table.step)
    return table.current().select("key", "version", "value", "error")


_CLEAN = scores_cte(["clean"])


@query(_CLEAN + f""", b AS (SELECT *, ((row_id - (SELECT min(row_id) FROM scores)) * {ARRIVALS}) // ((SELECT max(row_id) - min(row_id) + 1 FROM scores)) AS batch FROM scores)
SELECT row_id AS id, batch, CASE WHEN batch = 0 THEN 1 ELSE 2 END::BIGINT AS head, round(CASE WHEN batch = 0 THEN p ELSE 1 - p END, 6) AS pred, row_number() OVER (PARTITION BY batch ORDER BY row_id) AS place, NULL::VARCHAR AS error FROM b""")
def stream_scored(spark, sf_dir):
    """Scores of arriving vectors by the newest head: after the first arrival it is exchanged for its opposite."""
    e = data.embeddings(spark, sf_dir)
    head = scoring.fit_centroid_head(e).first()
    scorer = live.OnlineScorer(spark, checkpoint_folder(spark, "online"))

    def publish(i: int) -> None:
        if i < 2 and head and head["weights"]:
            sign = 1.0 if i == 0 else -1.0
            scorer.publish({"mean": head["mean"], "std": head["std"], "weights": [sign * w for w in head["weights"]], "bias": sign * head["bias"]}, i + 1)

    arriving(spark, e.select(F.col("row_id").alias("id"), "x"), "id", scorer.step, publish)
    return scorer.rows().select("id", "batch", "head", F.round("pred", 6).alias("pred"), "place", "error")


IDLE = 6 * 3600 * 1_000_000  # microseconds
_V = f"""SELECT event_id, user_id, epoch_us(ts) AS t, CASE event_type WHEN 'signup' THEN 'load' WHEN 'purchase' THEN 'remove' ELSE 'result' END AS kind, event_id % 2 AS version, round(value / (value + 50.0::DOUBLE), 9) AS pred FROM events"""


@query(f"""WITH RECURSIVE e AS ({_V}), g AS (SELECT *, lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS prev FROM e),
c AS (SELECT *, CASE WHEN kind = 'load' THEN version WHEN kind = 'remove' OR t - prev > {IDLE} THEN -1 END AS control FROM g),
f AS (SELECT *, last_value(control IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS cur FROM c),
k AS (SELECT *, coalesce(kind = 'result' AND cur = version AND pred IS NOT NULL, false) AS ok FROM f),
o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS n FROM k WHERE ok OR control IS NOT NULL),
s AS (SELECT user_id, n, event_id, ok, CASE WHEN ok THEN pred END AS ema FROM o WHERE n = 1
  UNION ALL SELECT o.user_id, o.n, o.event_id, o.ok, CASE WHEN o.ok THEN coalesce(0.6::DOUBLE * o.pred + (1 - 0.6::DOUBLE) * s.ema, o.pred) END FROM s JOIN o ON o.user_id = s.user_id AND o.n = s.n + 1)
SELECT user_id::VARCHAR AS key, event_id, round(ema, 6) AS ema FROM s WHERE ok""")
def stream_versioned_scores(spark, sf_dir):
    """Smoothed results of elements that are loaded in versions, removed, and forgotten after six idle hours."""
    e = data.stream_scores(spark, sf_dir)
    kind = F.when(F.col("event_type") == "signup", "load").when(F.col("event_type") == "purchase", "remove").otherwise("result")
    rows = e.select(F.col("user_id").cast("string").alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), F.col("event_id").alias("seq"), kind.alias("kind"), (F.col("event_id") % 2).alias("version"), F.col("pred").alias("value"))
    scores = live.VersionedScores(spark, checkpoint_folder(spark, "versioned"), IDLE)
    arriving(spark, rows, "t", scores.step)
    return scores.rows().select("key", F.col("seq").alias("event_id"), F.round("ema", 6).alias("ema"))

"""Manifest, audit and report queries over the tables at hand, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from driftlab.functions import vectors as V
from driftlab.operators import manifests as K
from driftlab.operators import views
from driftlab.plans import data

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_M = "WITH m AS (SELECT source || '/' || lang || '/' || d.doc_id || '.jpg' AS image_path, coalesce(quality, d.doc_id % 2)::INT AS label, source, lang AS generator, d.doc_id FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"
_RANK = "row_number() OVER (PARTITION BY {by} ORDER BY sha1('{seed}::' || image_path), image_path)"


@query(_M + " SELECT image_path, label, source, generator, 0 AS part FROM m UNION ALL SELECT 'bench/' || item_id || '.jpg', 1, 'benchmark', NULL, 1 FROM benchmark")
def manifest_union(spark, sf_dir):
    """Two manifests, the second without generators."""
    b = data.table(spark, sf_dir, "benchmark").select(F.concat(F.lit("bench/"), F.col("item_id").cast("string"), F.lit(".jpg")).alias("image_path"), F.lit(1).alias("label"), F.lit("benchmark").alias("source"))
    return K.union_manifests(data.manifest(spark, sf_dir).drop("doc_id"), b)


@query("SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def dedup_keep_first(spark, sf_dir):
    d = data.table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2(F.col("text").cast("binary"), 256).alias("key"))
    return K.keep_first(d, "key", ["doc_id"]).drop("key")


@query(_M + " SELECT image_path, CASE WHEN generator <> 'en' THEN generator WHEN source = 'src0' AND label = 0 THEN 'Real' WHEN source = 'src1' THEN 'SD15' ELSE 'unknown' END AS generator FROM m")
def generator_backfill(spark, sf_dir):
    m = data.manifest(spark, sf_dir).withColumn("generator", F.when(F.col("generator") != "en", F.col("generator")))
    return K.backfill_generator(m, {("src0", 0): "Real", ("src1", 0): "SD15", ("src1", 1): "SD15"}).select("image_path", "generator")


@query(_M + " SELECT source, label, count(*) AS n FROM m WHERE source NOT IN ('src0', 'src3') GROUP BY ALL")
def exclude_sources(spark, sf_dir):
    return K.exclude_sources(data.manifest(spark, sf_dir), ["src0", "src3"]).groupBy("source", "label").agg(F.count(F.lit(1)).alias("n"))


@query(_M + f" SELECT image_path, source FROM (SELECT *, {_RANK.format(by='source', seed='42')} AS r FROM m) WHERE r <= 20")
def cap_per_source(spark, sf_dir):
    """At most twenty rows of each source (the operator's own limit)."""
    return K.cap(data.manifest(spark, sf_dir), ["source"], 20).select("image_path", "source")


_SPLIT = f"{_M}, s AS (SELECT *, {_RANK.format(by='source, label', seed='42')} AS r, count(*) OVER (PARTITION BY source, label) AS n FROM m), sp AS (SELECT *, CASE WHEN n >= 2 AND r <= round(n * 0.15::DOUBLE) THEN 'val' ELSE 'train' END AS split FROM s)"


@query(_SPLIT + " SELECT image_path, split FROM sp")
def stratified_split(spark, sf_dir):
    return K.stratified_split(data.manifest(spark, sf_dir)).select("image_path", "split")


@query(_SPLIT + " SELECT generator, label, CASE WHEN generator IN ('fr') THEN 'val' ELSE split END AS split, count(*) AS n FROM sp GROUP BY ALL")
def holdout_generators(spark, sf_dir):
    return K.hold_out(K.stratified_split(data.manifest(spark, sf_dir)), ["fr"]).groupBy("generator", "label", "split").agg(F.count(F.lit(1)).alias("n"))


@query(_M + f""", z AS (SELECT label, source, count(*) AS size FROM m GROUP BY ALL), w AS (SELECT *, sum(size) OVER (PARTITION BY label) AS tot, least(150, sum(size) OVER (PARTITION BY label)) AS want FROM z),
a AS (SELECT *, (size * want) // tot AS share FROM w), b AS (SELECT *, want - sum(share) OVER (PARTITION BY label) AS rem, sum(size - share) OVER (PARTITION BY label ORDER BY size DESC, source ROWS UNBOUNDED PRECEDING) - (size - share) AS above FROM a),
k AS (SELECT label, source, share + greatest(0, least(rem - above, size - share)) AS k FROM b)
SELECT image_path, m2.label, m2.source FROM (SELECT *, {_RANK.format(by='label, source', seed='42')} AS r FROM m) m2 JOIN k ON k.label = m2.label AND k.source = m2.source WHERE r <= k OR (SELECT count(*) FROM m) <= 300""")
def stratified_sample(spark, sf_dir):
    """A sample of 300 rows (the operator's own size)."""
    return K.stratified_sample(data.manifest(spark, sf_dir), 300).select("image_path", "label", "source")


@query(_M + f", r AS (SELECT *, {_RANK.format(by='label', seed='42')} AS r FROM m) SELECT image_path, label FROM r WHERE label = 1 OR r <= (SELECT count(*) FROM m WHERE label = 1)")
def class_balance_trim(spark, sf_dir):
    return K.balance(data.manifest(spark, sf_dir)).select("image_path", "label")


@query("SELECT DISTINCT d.doc_id FROM documents d WHERE d.doc_id::VARCHAR IN (SELECT regexp_extract(url, '/(\\d+)', 1) FROM pages)")
def leakage_semijoin(spark, sf_dir):
    """Documents whose number is the number in a page's URL."""
    d = data.table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("number"))
    p = data.table(spark, sf_dir, "pages").select(F.regexp_extract("url", r"/(\d+)", 1).alias("number"))
    return K.leaked(d, p, F.col("number")).select("doc_id").distinct()


@query("SELECT DISTINCT 'g' || label AS generator FROM embeddings EXCEPT SELECT generator FROM (VALUES ('g0'), ('g1'), ('g5'), ('g6'), ('g8')) t(generator)")
def unseen_generators_except(spark, sf_dir):
    seen = data.generators(spark).filter("seen").select("generator")
    return data.embeddings(spark, sf_dir).select("generator").distinct().join(F.broadcast(seen), "generator", "left_anti")


@query(_M + " SELECT image_path, label FROM m")
def label_recovery(spark, sf_dir):
    m = data.manifest(spark, sf_dir)
    return K.recover_labels(m.select("image_path"), m).select("image_path", "label")


@query(_M + ", p AS (SELECT source, substr(sha1(image_path), 1, 2) AS b, count(*) AS n, sha1(string_agg(image_path, chr(10) ORDER BY image_path) || chr(10)) AS h FROM m GROUP BY ALL) SELECT source, sum(n)::BIGINT AS n_rows, sha1(string_agg(h, chr(10) ORDER BY b) || chr(10)) AS fingerprint FROM p GROUP BY source")
def ordered_fingerprint(spark, sf_dir):
    return K.fingerprint(data.manifest(spark, sf_dir), ["source"])


@query("SELECT view, spec, sha1(spec || CASE WHEN spec LIKE '%|stochastic' THEN '|seed=path-v1' ELSE '' END) AS fingerprint FROM (VALUES " + ", ".join(f"('{n}', '{views.view_spec(n)}')" for n in views.view_steps()) + ") t(view, spec)")
def view_fingerprint(spark, sf_dir):
    return views.views_table(spark).select("view", "spec", "fingerprint")


_SEED = "sha1('vec/' || vec_id || '::' || view || '::path-v1')"


@query("SELECT vec_id AS row_id, view, ('0x' || " + " || ".join(f"substr({_SEED}, {k}, 2)" for k in (7, 5, 3, 1)) + ")::BIGINT AS seed FROM embeddings CROSS JOIN (VALUES " + ", ".join(f"('{n}')" for n in views.view_steps()) + ") t(view)")
def path_seed(spark, sf_dir):
    names = F.explode(F.array(*[F.lit(n) for n in views.view_steps()])).alias("view")
    e = data.embeddings(spark, sf_dir).select("row_id", "path", names)
    return e.select("row_id", "view", V.path_seed(F.col("path"), F.col("view")).alias("seed"))


@query(_M + " SELECT generator, label, count(*) AS n FROM m WHERE lower(trim(generator)) NOT IN ('es', 'fr') GROUP BY ALL")
def exclude_generators_train(spark, sf_dir):
    return K.exclude_generators(data.manifest(spark, sf_dir), [" ES", "Fr "]).groupBy("generator", "label").agg(F.count(F.lit(1)).alias("n"))


@query(_M + " SELECT sum(1 - label)::BIGINT AS n_neg, sum(label)::BIGINT AS n_pos, round(sum(1 - label) / sum(label)::DOUBLE, 6) AS pos_weight FROM m")
def class_weight(spark, sf_dir):
    m = data.manifest(spark, sf_dir).agg(F.sum(1 - F.col("label")).alias("n_neg"), F.sum("label").alias("n_pos"))
    return m.withColumn("pos_weight", F.round(F.try_divide("n_neg", "n_pos"), 6))


@query(_M + " SELECT source, count(*) AS n, sum((label = 0)::INT)::BIGINT AS n_real, sum(label)::BIGINT AS n_fake, count(DISTINCT generator) AS n_generators, array_to_string(list_sort(list(DISTINCT generator)), ',') AS generators FROM m GROUP BY source")
def describe_groups(spark, sf_dir):
    return data.manifest(spark, sf_dir).groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.sum(1 - F.col("label")).alias("n_real"), F.sum("label").alias("n_fake"), F.countDistinct("generator").alias("n_generators"),
        F.array_join(F.array_sort(F.collect_set("generator")), ",").alias("generators"),
    )


@query("WITH c AS (SELECT lang, n_chars, count(*) AS n FROM documents GROUP BY lang, n_chars) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, n_chars) AS rank FROM c) WHERE rank <= 5")
def topn_resolutions(spark, sf_dir):
    """The five most common sizes of each group."""
    c = data.table(spark, sf_dir, "documents").groupBy("lang", "n_chars").agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), "n_chars")).cast("long")).filter("rank <= 5").select("lang", "n_chars", "n", "rank")


@query("SELECT source, count(*) AS n, round(avg(len(text) / greatest(1, strlen(text))::DOUBLE), 6) AS mean_ratio, median(n_chars) AS median_chars, round(avg((n_chars < 40)::INT::DOUBLE) * 100, 4) AS pct_small, sum((text IS NULL)::INT)::BIGINT AS unreadable, median(n_chars) < 500 AS suspect FROM documents GROUP BY source")
def corpus_health(spark, sf_dir):
    d = data.table(spark, sf_dir, "documents")
    return d.groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(F.length("text") / F.greatest(F.lit(1), F.octet_length("text"))), 6).alias("mean_ratio"), F.median("n_chars").alias("median_chars"),
        F.round(F.avg((F.col("n_chars") < 40).cast("double")) * 100, 4).alias("pct_small"), F.count_if(F.col("text").isNull()).alias("unreadable"), (F.median("n_chars") < 500).alias("suspect"),
    )


@query("SELECT page_id, CASE WHEN starts_with(url, 'http') THEN url ELSE 'root/' || url END AS absolute, regexp_replace(url, '^https?://[^/]+/?', '') AS relative, lower(regexp_extract(url, '\\.([A-Za-z0-9]+)$', 1)) AS suffix FROM pages")
def relative_paths(spark, sf_dir):
    u = F.col("url")
    return data.table(spark, sf_dir, "pages").select("page_id", F.when(u.startswith("http"), u).otherwise(F.concat(F.lit("root/"), u)).alias("absolute"), F.regexp_replace(u, "^https?://[^/]+/?", "").alias("relative"), F.lower(F.regexp_extract(u, r"\.([A-Za-z0-9]+)$", 1)).alias("suffix"))


@query("SELECT page_id, pos, href FROM (SELECT page_id, unnest(range(0, len(regexp_extract_all(html, 'href=\"([^\"]*)\"')))) AS pos, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href FROM pages) WHERE href <> '' AND len(href) >= 4")
def image_candidates(spark, sf_dir):
    """Candidates of a page that pass the element filter (here: links, as the pages hold no images)."""
    p = data.table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("pos", "href"))
    return p.filter("href <> '' AND length(href) >= 4").select("page_id", F.col("pos").cast("long").alias("pos"), "href")


@query(_M + " SELECT coalesce(source, 'all') AS source, coalesce(generator, 'all') AS generator, count(*) AS n, sum(label)::BIGINT AS fakes FROM m GROUP BY CUBE (source, generator)")
def group_subtotals(spark, sf_dir):
    return data.manifest(spark, sf_dir).cube("source", "generator").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("fakes")).select(F.coalesce("source", F.lit("all")).alias("source"), F.coalesce("generator", F.lit("all")).alias("generator"), "n", "fakes")


@query("SELECT source, array_to_string(list_slice(string_split(url_dir, '/'), 1, 3), '/') AS dir, n, rank FROM (SELECT 'pages' AS source, regexp_replace(url, '/[^/]*$', '') AS url_dir, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, regexp_replace(url, '/[^/]*$', '')) AS rank FROM pages GROUP BY 2) WHERE rank <= 10")
def directory_histogram(spark, sf_dir):
    """The ten directories with most files."""
    p = data.table(spark, sf_dir, "pages").groupBy(F.regexp_replace("url", "/[^/]*$", "").alias("url_dir")).agg(F.count(F.lit(1)).alias("n"))
    top = p.orderBy(F.col("n").desc(), "url_dir").limit(10)
    return top.select(F.lit("pages").alias("source"), F.array_join(F.slice(F.split("url_dir", "/"), 1, 3), "/").alias("dir"), "n", F.row_number().over(Window.orderBy(F.col("n").desc(), "url_dir")).cast("long").alias("rank"))


@query(_M + f" SELECT source, label, count(*) AS n, sum((substr(image_path, 1, 4) = 'src1')::INT)::BIGINT AS present FROM (SELECT *, {_RANK.format(by='source, label', seed='0')} AS r FROM m) WHERE r <= 600 GROUP BY ALL")
def audit_sample(spark, sf_dir):
    """At most 600 rows of each (source, label), as the audits take them, and how many are at hand."""
    s = K.cap(data.manifest(spark, sf_dir), ["source", "label"], 600, seed="0")
    return s.groupBy("source", "label").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.substring("image_path", 1, 4) == "src1").alias("present"))

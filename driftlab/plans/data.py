"""How the tables at hand stand for manifests, embeddings and score streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlab.operators import scoring
from driftlab.sources.files import checkpoint_folder

# The dimension of generators. g9 is unknown to it on purpose.
GENERATORS = [("g0", "real", 2019, True), ("g1", "real", 2020, True), ("g2", "real", 2021, False), ("g3", "real", 2022, False), ("g4", "real", 2023, False), ("g5", "diffusion", 2021, True), ("g6", "diffusion", 2022, True), ("g7", "diffusion", 2023, False), ("g8", "gan", 2019, True)]
TIERS = ("val", "ood", "demo_val", "social")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def generators(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(GENERATORS, "generator string, family string, era int, seen boolean")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, path, y, generator, source, tier, x): label 5 and over counts as generated."""
    e = table(spark, sf_dir, "embeddings")
    tier = F.element_at(F.array(*map(F.lit, TIERS)), (F.col("vec_id") % 4 + 1).cast("int"))
    return e.select(
        F.col("vec_id").alias("row_id"), F.concat(F.lit("vec/"), F.col("vec_id").cast("string")).alias("path"), (F.col("label") >= 5).cast("int").alias("y"),
        F.concat(F.lit("g"), F.col("label").cast("string")).alias("generator"), F.concat(F.lit("s"), (F.col("vec_id") % 3).cast("string")).alias("source"), tier.alias("tier"),
        F.col("embedding").cast("array<double>").alias("x"),
    )


def scores(spark: SparkSession, sf_dir: str, names=None) -> DataFrame:
    """(row_id, path, y, generator, source, tier, view, ord, kind, p): every row in every view, scored by the head fitted on the clean view.

    Reports read the scores several times, so they are written once and read back, the columns that a report needs.
    """
    rows = embeddings(spark, sf_dir)
    scored = scoring.score_views(rows, scoring.fit_centroid_head(rows), names)
    path, schema = checkpoint_folder(spark, "scores"), scored.schema
    scored.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_path, label, source, generator, doc_id): documents as a labelled manifest."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return d.join(lab, "doc_id", "left").select(
        F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".jpg"))).alias("image_path"),
        F.coalesce(F.col("quality"), (F.col("doc_id") % 2).cast("int")).cast("int").alias("label"), "source", F.col("lang").alias("generator"), "doc_id",
    )


def stream_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, ts, user_id, event_type, pred): events as a stream of scores in [0, 1)."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "ts", "user_id", "event_type", F.round(F.col("value") / (F.col("value") + 50.0), 9).alias("pred"))

"""Sources and sinks: manifests, image folders, view caches, heads, predictions and status rows."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlab.operators.manifests import check_columns, keep_first

IMAGE_SUFFIXES = ("jpg", "jpeg", "png", "webp", "bmp", "jfif")
MANIFEST = "image_path string, label int, source string, generator string"


def checkpoint_folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir; below a temporary one only in local mode, where none need be set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="driftlab-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def read_manifest(spark: SparkSession, path: str | Sequence[str], root: str | None = None) -> DataFrame:
    """A manifest from CSV files with a header; the generator column may be missing. Relative paths are put below root."""
    df = spark.read.option("header", True).csv(path)
    check_columns(df)
    df = df.select("image_path", F.col("label").cast("int").alias("label"), "source", (F.col("generator") if "generator" in df.columns else F.lit(None).cast("string")).alias("generator"))
    if root is None:
        return df
    return df.withColumn("image_path", F.when(F.col("image_path").startswith("/"), F.col("image_path")).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), "image_path")))


def read_indexes(spark: SparkSession, folder: str) -> DataFrame:
    """All *_index.csv of a folder together, one row for each path: that of the first file by name, and in it the first."""
    df = spark.read.option("header", True).schema(MANIFEST).option("enforceSchema", False).option("mode", "PERMISSIVE").csv(f"{folder}/*_index.csv")
    return keep_first(df.withColumns({"_file": F.col("_metadata.file_path"), "_at": F.monotonically_increasing_id()}), "image_path", ["_file", "_at"]).drop("_file", "_at")


def read_by_source(spark: SparkSession, folders: Sequence[str]) -> DataFrame:
    """All *_index.csv of several folders, each file under one source: that of its first row, or the file's stem if it names none there."""
    df = spark.read.option("header", True).schema(MANIFEST).option("enforceSchema", False).csv([f"{f}/*_index.csv" for f in folders])
    df = df.withColumns({"_file": F.col("_metadata.file_path"), "_at": F.monotonically_increasing_id()})
    named = df.groupBy("_file").agg(F.min_by(F.struct("source"), "_at")["source"].alias("_named"))  # one row a file
    stem = F.regexp_extract("_file", r"([^/]+)_index\.csv$", 1)
    return df.drop("source").join(named, "_file").select("image_path", "label", F.coalesce(F.nullif(F.trim("_named"), F.lit("")), stem).alias("source"), "generator")


def list_images(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length, suffix) of the images below a folder, whatever the case of their suffix."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length")
    return files.withColumn("suffix", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))).filter(F.col("suffix").isin(*IMAGE_SUFFIXES))


def label_from_folder(path: Column, names: dict[str, int], level: int = -2) -> Column:
    """The label that the folder above a file names; null if it names none."""
    part = F.lower(F.element_at(F.split(path, "/"), level))
    out = F.lit(None).cast("int")
    for name, label in names.items():
        out = F.when(part == name.lower(), F.lit(label)).otherwise(out)
    return out


def frame_bytes(text: Column) -> Column:
    """The bytes of a base64 frame, with or without a data: prefix."""
    return F.unbase64(F.substring_index(text, ",", -1))


def write_view_cache(df: DataFrame, path: str) -> None:
    """Vectors by backbone, stem and view; only the partitions at hand are overwritten."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("backbone", "stem", "view").parquet(path)


def read_view_cache(spark: SparkSession, path: str, backbone: str, stem: str, views: Sequence[str], fingerprints: dict[str, str]) -> DataFrame:
    """The cached views, if all are there with the fingerprints expected; else raises (stale or missing)."""
    df = spark.read.parquet(path).filter((F.col("backbone") == backbone) & (F.col("stem") == stem) & F.col("view").isin(list(views)))
    found = {r["view"]: r["f"] for r in df.groupBy("view").agg(F.collect_set("view_fingerprint").alias("f")).collect()}
    for v in views:
        if found.get(v) != [fingerprints[v]]:
            raise ValueError(f"the cache of view {v} is {'stale' if v in found else 'missing'}: embed it again")
    return df


def find_caches(spark: SparkSession, path: str, backbone: str, stem: str, wanted: Sequence[str]) -> list[str]:
    """The wanted views that a cache has, in the order asked for; without the clean one, or with two backbones' vectors in one view, it raises."""
    df = spark.read.parquet(path).filter((F.col("backbone") == backbone) & (F.col("stem") == stem)).groupBy("view").agg(F.countDistinct("view_fingerprint").alias("n"))
    have = {r["view"]: r["n"] for r in df.collect()}  # one row a view
    mixed = sorted(v for v, n in have.items() if n > 1 and v in wanted)
    if mixed:
        raise ValueError(f"views with more than one fingerprint: {', '.join(mixed)}")
    if "clean" in wanted and "clean" not in have:
        raise ValueError(f"{backbone} has no clean view of {stem}")
    return [v for v in wanted if v in have]


def embed_or_reuse(spark: SparkSession, path: str, backbone: str, stem: str, fingerprints: dict[str, str], embed: Callable[[list[str]], DataFrame]) -> tuple[DataFrame, list[str]]:
    """(the cached vectors of all views in fingerprints, the views that had to be made): views that are missing or stale are embedded and written."""
    try:
        df = spark.read.parquet(path).filter((F.col("backbone") == backbone) & (F.col("stem") == stem))
        have = {r["view"]: r["f"] for r in df.groupBy("view").agg(F.collect_set("view_fingerprint").alias("f")).collect()}
    except AnalysisException:  # nothing is there yet
        have = {}
    todo = [v for v, f in fingerprints.items() if have.get(v) != [f]]
    if todo:
        stamp = F.create_map(*[F.lit(x) for v in todo for x in (v, fingerprints[v])])
        write_view_cache(embed(todo).withColumns({"backbone": F.lit(backbone), "stem": F.lit(stem), "view_fingerprint": stamp[F.col("view")]}), path)
    return read_view_cache(spark, path, backbone, stem, list(fingerprints), fingerprints), todo


def write_new(df: DataFrame, path: str) -> None:
    """Writes a corpus where there is none: one that is there is not mixed with another."""
    df.write.mode("errorifexists").parquet(path)


HEAD = "backbone string, mean array<double>, std array<double>, weights array<double>, bias double, views array<string>"


def write_head(spark: SparkSession, head: dict, backbone: str, path: str) -> None:
    """A head as a table of one row, with the backbone whose vectors it reads."""
    row = (backbone, *[list(map(float, head[k])) for k in ("mean", "std", "weights")], float(head["bias"]), list(head.get("views", ["clean"])))
    spark.createDataFrame([row], HEAD).coalesce(1).write.mode("overwrite").parquet(path)


def read_head(spark: SparkSession, path: str, backbone: str) -> DataFrame:
    """The one row of a head; a head of another backbone, or one that has not learned the clean view, raises."""
    df = spark.read.schema(HEAD).parquet(path)
    r = df.select("backbone", "views").first()
    if r is None or r["backbone"] != backbone:
        raise ValueError(f"a head of {r['backbone'] if r else 'no backbone'}, not of {backbone}")
    if "clean" not in (r["views"] or []):
        raise ValueError("a head that has not learned the clean view")
    return df.select("mean", "std", "weights", "bias")


def write_per_source(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("source").option("header", True).csv(path)


def write_predictions(df: DataFrame, path: str) -> None:
    """JSON lines {"image_path", "pred"}, sorted by path across files."""
    df.select("image_path", "pred").orderBy("image_path").write.mode("overwrite").json(path)


def append_status(spark: SparkSession, path: str, row: dict) -> None:
    spark.createDataFrame([(str(row.get("stage")), str(row.get("state")), float(row.get("seconds", 0)))], "stage string, state string, seconds double").write.mode("append").json(path)


def read_status(spark: SparkSession, path: str) -> DataFrame:
    """Status rows; lines that are damaged are skipped."""
    return spark.read.schema("stage string, state string, seconds double, _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path).filter("_bad IS NULL").drop("_bad")


def archive_members(spark: SparkSession, path: str, prefix: str = "", suffixes: Sequence[str] = IMAGE_SUFFIXES) -> DataFrame:
    """(archive, member, content) of the members of zip archives whose names start with prefix; an archive that is damaged raises."""

    def run(batches):
        import io
        import zipfile

        import pyarrow as pa

        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1)):
                with zipfile.ZipFile(io.BytesIO(content.as_py())) as z:
                    for m in z.namelist():  # one member at a time
                        if m.startswith(prefix) and m.rsplit(".", 1)[-1].lower() in suffixes:
                            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([m]), pa.array([z.read(m)], pa.binary())], ["archive", "member", "content"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("path", "content")
    return files.mapInArrow(run, "archive string, member string, content binary")


def first_column(df: DataFrame, candidates: Sequence[str] = ("image", "img", "jpg", "png", "photo")) -> Column:
    """The first of the candidate columns that a row has a value in; raises if df has none of them."""
    have = [c for c in candidates if c in df.columns]
    if not have:
        raise ValueError(f"none of {list(candidates)} in {df.columns}")
    return F.coalesce(*[F.col(c)["bytes"] if df.schema[c].dataType.typeName() == "struct" else F.col(c) for c in have])


def write_report(df: DataFrame, path: str, digits: int = 6) -> None:
    """A report as CSV with a header, its doubles rounded."""
    rounded = {c: F.round(c, digits) for c, kind in df.dtypes if kind in ("double", "float")}
    df.withColumns(rounded).write.mode("overwrite").option("header", True).csv(path) if rounded else df.write.mode("overwrite").option("header", True).csv(path)


def write_audit(df: DataFrame, path: str, suspect: str = "suspect") -> bool:
    """An audit as JSON lines; True if a row is suspect, for a caller's exit code."""
    df.write.mode("overwrite").json(path)
    return not df.filter(F.col(suspect)).isEmpty()


def resolve(spark: SparkSession, paths: Sequence[str], reader) -> DataFrame:
    """reader(spark, path) of the first path that can be read; raises with all reasons if none can."""
    reasons = []
    for p in paths:
        try:
            df = reader(spark, p)
            df.limit(1).count()
            return df
        except Exception as e:  # a mirror may fail in any way
            reasons.append(f"{p}: {str(e).splitlines()[0]}")
    raise ValueError("; ".join(reasons))


def catalog_status(spark: SparkSession, names: Sequence[str]) -> DataFrame:
    """(name, present) of tables and views."""
    return spark.createDataFrame([(n, spark.catalog.tableExists(n)) for n in names], "name string, present boolean")

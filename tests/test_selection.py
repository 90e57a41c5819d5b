import pytest
from pyspark.sql import functions as F

from driftlab.operators import metrics as M
from driftlab.operators import selection as S
from driftlab.operators import training
from driftlab.sources import files


def rows(spark, n=400):
    x = F.array(*[(F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1000)) / 500.0 - 1).alias("v") for k in range(64)])
    df = spark.range(n).select("id", F.concat(F.lit("p/"), F.col("id").cast("string")).alias("path"), x.alias("x"))
    return df.withColumn("y", (F.element_at("x", 1) * F.element_at("x", 2) > 0).cast("int")).withColumn("generator", F.concat(F.lit("g"), (F.col("id") % 4).cast("string")))


def test_a_perceptron_learns_what_a_line_cannot(spark):
    df = rows(spark).select("id", "y", F.slice("x", 1, 2).alias("x"))
    s = training.score_mlp(df, training.mlp_head(df, (16,), steps=200))
    line = training.score_linear(df, *training.logistic_head(df))
    assert M.auc(s).first()["auc"] > 0.95 > 0.7 > M.auc(line).first()["auc"]
    with pytest.raises(ValueError):
        training.mlp_head(df.limit(0))


def test_heads_over_views(spark):
    df = rows(spark).withColumn("y", (F.element_at("x", 1) > 0).cast("int"))
    head = training.train_on_views(df.filter("id % 2 = 0"), [df.filter("id % 2 = 1")], ["clean", "jpeg_q30"], exclude=[" G3 "])
    assert head["rows"] == 2 * 300 and max(range(64), key=lambda k: abs(head["weights"][k])) == 0
    heavy = training.train_on_views(df, [], ["clean"], fake_weight=20.0)
    assert heavy["bias"] > training.train_on_views(df, [], ["clean"])["bias"]
    with pytest.raises(ValueError):
        training.train_on_views(df, [], ["jpeg_q30"])


def test_heads_are_kept_with_their_backbone(spark, tmp_path):
    head = {"mean": [0.0], "std": [1.0], "weights": [2.0], "bias": 0.5, "views": ["clean"]}
    files.write_head(spark, head, "a", f"{tmp_path}/h")
    assert files.read_head(spark, f"{tmp_path}/h", "a").first().asDict() == {k: head[k] for k in ("mean", "std", "weights", "bias")}
    with pytest.raises(ValueError, match="not of b"):
        files.read_head(spark, f"{tmp_path}/h", "b")
    files.write_head(spark, head | {"views": ["jpeg_q30"]}, "a", f"{tmp_path}/h")
    with pytest.raises(ValueError, match="clean"):
        files.read_head(spark, f"{tmp_path}/h", "a")


def test_caches_are_found_used_again_and_not_mixed(spark, tmp_path):
    path, made = f"{tmp_path}/cache", []

    def embed(names):
        made.append(list(names))
        return spark.createDataFrame([(i, n, [1.0]) for i in range(3) for n in names], "row_id long, view string, x array<double>")

    df, todo = files.embed_or_reuse(spark, path, "b", "s", {"clean": "f1", "blur": "f2"}, embed)
    assert todo == ["clean", "blur"] and df.count() == 6
    df, todo = files.embed_or_reuse(spark, path, "b", "s", {"clean": "f1", "blur": "new"}, embed)
    assert todo == ["blur"] and df.count() == 6 and made == [["clean", "blur"], ["blur"]]
    assert files.embed_or_reuse(spark, path, "b", "s", {"clean": "f1"}, embed)[1] == []
    assert files.find_caches(spark, path, "b", "s", ["blur", "noise", "clean"]) == ["blur", "clean"]
    with pytest.raises(ValueError, match="no clean"):
        files.find_caches(spark, path, "b", "other", ["clean"])
    files.write_new(df, f"{tmp_path}/corpus")
    with pytest.raises(Exception, match="(?i)exist"):
        files.write_new(df, f"{tmp_path}/corpus")


def test_selection_rules(spark):
    df = spark.range(100).withColumn("label", (F.col("id") % 2).cast("int")).withColumns({"source": F.lit("a"), "generator": F.lit("x"), "image_path": F.col("id").cast("string")}).repartition(5)
    assert [r.id for r in S.select_rows(df, "id", "id", limit=3).collect()] == [0, 1, 2]
    a, b = (sorted(r.id for r in S.select_rows(df.repartition(k), "id", "id", limit=3, sample=20).collect()) for k in (2, 7))
    assert a == b and len(set(a)) == 20 and a != list(range(20))
    assert S.select_rows(df, "id", "id").count() == 100 and S.select_rows(df.limit(0), "id", "id", sample=3).count() == 0
    r = S.relabelled(df, 0, "real", None).collect()
    assert len(r) == 50 and {(x.source, x.generator, x.label) for x in r} == {("real", None, 0)}
    listing = spark.createDataFrame([("3",), ("3",), (None,)], "path string")
    assert [x.id for x in S.existing(df, listing).collect()] == [3]
    blocks = S.concat_blocks([df.filter("id > 97"), df.filter("id < 2")], ["id"]).collect()
    assert [(x.block, x.id) for x in blocks] == [(0, 98), (0, 99), (1, 0), (1, 1)]


def test_poisson_weights_are_those_of_a_bootstrap(spark):
    w = spark.range(400).withColumn("k", F.col("id").cast("string")).select(F.explode(S.poisson_weights("k", 50)).alias("w"))
    m = w.agg(F.avg("w").alias("m"), F.variance("w").alias("v")).first()
    assert m.m == pytest.approx(1, abs=0.03) and m.v == pytest.approx(1, abs=0.05)

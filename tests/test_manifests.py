import pytest
from pyspark.sql import functions as F

from driftlab.operators import manifests as K
from driftlab.operators import views

M = "image_path string, label int, source string, generator string"


def rows(sizes):
    return [(f"{s}/{y}/{i}.jpg", y, s, None) for (s, y), n in sizes.items() for i in range(n)]


def test_union_and_keep_first(spark):
    a = spark.createDataFrame([("x", 0, "a", "g")], M)
    b = spark.createDataFrame([("x", 1, "b"), ("y", 1, "b")], "image_path string, label int, source string")
    u = K.keep_first(K.union_manifests(a, b), "image_path", ["part"])
    assert sorted((r.image_path, r.source, r.generator) for r in u.collect()) == [("x", "a", "g"), ("y", "b", None)]
    with pytest.raises(ValueError):
        K.check_columns(b.drop("label"))


def test_backfill_and_exclusions(spark):
    df = spark.createDataFrame([("1", 0, "a", None), ("2", 1, "a", None), ("3", 0, "b", " SDXL ")], M)
    got = {r.image_path: r.generator for r in K.backfill_generator(df, {("a", 0): "Real"}).collect()}
    assert got == {"1": "Real", "2": "unknown", "3": " SDXL "}
    assert K.exclude_generators(df.fillna("x"), ["sdxl"]).count() == 2
    assert K.exclude_sources(df, []).count() == 3 and K.exclude_sources(df, ["a"]).count() == 1


def test_split_of_small_strata(spark):
    df = spark.createDataFrame(rows({("a", 0): 1, ("a", 1): 2, ("b", 0): 7, ("b", 1): 100}), M)
    s = K.stratified_split(df)
    n = {(r.source, r.label): r.n for r in s.filter("split = 'val'").groupBy("source", "label").agg(F.count("*").alias("n")).collect()}
    assert n == {("b", 0): 1, ("b", 1): 15}
    assert sorted(map(str, s.collect())) == sorted(map(str, K.stratified_split(df.repartition(7)).collect()))
    held = K.hold_out(s.withColumn("generator", F.col("source")), ["a"])
    assert held.filter("source = 'a' AND split = 'train'").count() == 0


def test_remainder_goes_to_the_largest_source(spark):
    sizes = spark.createDataFrame([(0, "a", 5), (0, "b", 5), (0, "c", 3)], "label int, source string, size long")
    assert {r.source: r.k for r in K.sample_allocation(sizes, 14).collect()} == {"a": 4, "b": 2, "c": 1}
    df = spark.createDataFrame(rows({("a", 0): 30, ("b", 0): 10, ("a", 1): 3}), M)
    assert K.stratified_sample(df, 20).count() == 13  # a label that is short is not topped up
    assert K.stratified_sample(df, 100).count() == 43


def test_caps_balance_and_leaks(spark):
    df = spark.createDataFrame(rows({("a", 0): 30, ("a", 1): 4, ("b", 0): 2}), M)
    assert K.cap(df, ["source"], 5).groupBy("source").count().orderBy("source").collect() == [("a", 5), ("b", 2)]
    assert K.balance(df).filter("label = 0").count() == 4
    other = spark.createDataFrame([("elsewhere/3.jpg", 0, "z", None)], M)
    assert K.leaked(df, other).count() == 2  # of the strata with four rows or more
    with pytest.raises(ValueError):
        K.require_disjoint(df, other)
    with pytest.raises(ValueError):
        K.recover_labels(df, other)


def test_fingerprint_sees_changes_but_not_partitions(spark):
    df = spark.createDataFrame(rows({("a", 0): 300}), M)
    f = lambda d: K.fingerprint(d).first()["fingerprint"]
    assert f(df) == f(df.repartition(5)) != f(df.limit(299))
    assert f(df) != f(df.unionByName(df.limit(1)))


def test_view_registry():
    assert len(views.view_steps()) == 22 and len(views.select_views(None)) == 18
    assert views.view_spec("chain_heavy") == "chain[blur(sigma=1.0)>resize(scale=0.25)>pil_noise(sigma=0.05)>jpeg(q=30)]|stochastic"
    assert views.view_spec("noise_sigma0.1") == "noise(sigma=0.1)|stochastic"
    assert views.component_views("chain_light") == ["resize_0.5x", "jpeg_q70"]
    with pytest.raises(ValueError):
        views.select_views(["nothing"])


def test_views_of_a_vector(spark):
    df = spark.createDataFrame([("vec/1", [float(i) for i in range(10)])], "path string, x array<double>")
    v = {r.view: r.x for r in views.expand_views(df, scored_only=False).collect()}
    assert len(v) == 22 and v["clean"] == [float(i) for i in range(10)]
    assert v["resize_0.5x"] == [0.0, 0.0, 2.0, 2.0, 4.0, 4.0, 6.0, 6.0, 8.0, 8.0]
    assert v["center_crop_80"] == [0.0, *[float(i) for i in range(1, 9)], 0.0]
    assert v["noise_sigma0.1"] != v["clean"] and max(abs(a - b) for a, b in zip(v["noise_sigma0.1"], v["clean"])) < 0.1 * 12**0.5


def test_batches_and_expressions_score_alike(spark):
    import random

    from driftlab.operators import scoring

    r = random.Random(1)
    df = spark.createDataFrame([(i, f"vec/{i}", i % 2, [r.gauss(i % 2, 1) for _ in range(12)]) for i in range(40)], "row_id long, path string, y int, x array<double>")
    head = scoring.fit_centroid_head(df)
    key = lambda rows: {(x.row_id, x.view): (x.y, x.ord, x.kind, x.p) for x in rows}
    a = key(scoring.score(views.expand_views(df, scored_only=False), head).collect())
    b = key(scoring.score_views(df, head, scored_only=False).collect())
    assert len(a) == 40 * 22 and a.keys() == b.keys()
    assert all(a[k][:3] == b[k][:3] and abs(a[k][3] - b[k][3]) <= 1e-9 for k in a)
    assert scoring.score_views(df.limit(0), head).count() == 0

import json
import os

import pytest
from pyspark.sql import functions as F

from driftlab.operators import local_sgd, training, views
from driftlab.sources import files
from driftlab.streaming import scores as S

E = "k string, n long, v double, reset boolean"


def test_ema_batch_and_stream(spark, tmp_path):
    rows = [("a", 1, 1.0, False), ("a", 2, 0.0, False), ("a", 3, 9.0, True), ("a", 4, 0.5, False), ("b", 1, 0.2, False)]
    df = spark.createDataFrame(rows, E)
    want = {("a", 1): 1.0, ("a", 2): 0.4, ("a", 3): None, ("a", 4): 0.5, ("b", 1): 0.2}
    got = {(r.k, r.n): r.ema for r in S.ema_batch(df, "k", ["n"], "v", F.col("reset")).collect()}
    assert got == pytest.approx(want)
    # two files, one after another: the state carries over
    for i, part in enumerate((rows[:2], rows[2:])):
        spark.createDataFrame(part, E).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(E).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    q = S.ema_stream(stream, "k", "v", "n", "reset").writeStream.format("memory").queryName("ema_test").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    out = {(r.k, r.n): None if r.ema is None or r.ema != r.ema else r.ema for r in spark.table("ema_test").collect()}
    assert out == pytest.approx(want)


def brute_quota(rows, reals, per, cap, skip, min_scan, max_scan):
    n, kept = {}, []
    for pos, g in rows:
        if pos <= skip:
            continue
        if max_scan is not None and pos > max_scan:
            break
        key = "real" if g in reals else g
        quota = cap if key == "real" else per
        if n.get(key, 0) >= quota:
            continue
        n[key] = n.get(key, 0) + 1
        kept.append(pos)
        if pos >= min_scan and n.get("real", 0) >= cap and all(v >= (cap if k == "real" else per) for k, v in n.items()):
            break
    return kept


@pytest.mark.parametrize("min_scan,max_scan", [(0, None), (60, None), (0, 40)])
def test_quota_slice_matches_a_reader(spark, min_scan, max_scan):
    import random

    for seed in range(4):
        r = random.Random(seed)
        rows = [(i, r.choices("xyzw", weights=(5, 2, 2, 0.3))[0]) for i in range(1, 200)]
        df = spark.createDataFrame(rows, "pos long, g string")
        got = sorted(x.pos for x in S.quota_slice(df, "pos", "g", ["x"], 5, 20, 3, min_scan, max_scan).collect())
        assert got == brute_quota(rows, {"x"}, 5, 20, 3, min_scan, max_scan)


def test_gate_aborts_after_enough_rows(spark):
    df = spark.range(1, 301).select(F.col("id").alias("pos"), (F.col("id") % 5 < 3).alias("grey"))
    r = S.gated_abort(df, "pos", F.col("grey")).first()
    assert (r.seen, r.abort_at) == (300, 200 if 200 % 5 < 3 else 201)
    assert S.gated_abort(df.filter("NOT grey"), "pos", F.col("grey")).first()["abort_at"] is None


def test_manifests_and_indexes(spark, tmp_path):
    for name, lines in (("b_index.csv", ["p,1,b,g"]), ("a_index.csv", ["p,0,a,", "q,0,a,"])):
        (tmp_path / name).write_text("\n".join(["image_path,label,source,generator", *lines]) + "\n")
    got = sorted((r.image_path, r.source) for r in files.read_indexes(spark, str(tmp_path)).collect())
    assert got == [("p", "a"), ("q", "a")]
    m = files.read_manifest(spark, f"{tmp_path}/a_index.csv", root="/data")
    assert {r.image_path for r in m.collect()} == {"/data/p", "/data/q"}


def test_images_labels_and_frames(spark, tmp_path):
    for p in ("REAL/a.JPG", "FAKE/x/b.png", "FAKE/c.txt"):
        os.makedirs(os.path.dirname(tmp_path / p), exist_ok=True)
        (tmp_path / p).write_bytes(b"12")
    found = files.list_images(spark, str(tmp_path)).withColumn("label", files.label_from_folder(F.col("path"), {"real": 0, "fake": 1})).collect()
    assert sorted((r.path.rsplit("/", 1)[1], r.suffix, r.label) for r in found) == [("a.JPG", "jpg", 0), ("b.png", "png", None)]
    f = spark.createDataFrame([("data:image/png;base64,aGk=",), ("aGk=",)], "t string").select(files.frame_bytes(F.col("t")).alias("b")).collect()
    assert [bytes(x.b) for x in f] == [b"hi", b"hi"]


def test_view_cache_checks_fingerprints(spark, tmp_path):
    names = ["clean", "jpeg_q70"]
    prints = {v: views.view_fingerprint(v) for v in names}
    df = spark.createDataFrame([("b", "s", v, prints[v], [1.0]) for v in names], "backbone string, stem string, view string, view_fingerprint string, embedding array<double>")
    files.write_view_cache(df, str(tmp_path / "c"))
    assert files.read_view_cache(spark, str(tmp_path / "c"), "b", "s", names, prints).count() == 2
    with pytest.raises(ValueError, match="stale"):
        files.read_view_cache(spark, str(tmp_path / "c"), "b", "s", names, prints | {"clean": "other"})
    with pytest.raises(ValueError, match="missing"):
        files.read_view_cache(spark, str(tmp_path / "c"), "b", "s", ["blur_sigma1.0"], {"blur_sigma1.0": "x"})


def test_predictions_and_status(spark, tmp_path):
    df = spark.createDataFrame([("b", 0.5), ("a", 0.25)], "image_path string, pred double")
    files.write_predictions(df, str(tmp_path / "p"))
    lines = [json.loads(x) for f in sorted((tmp_path / "p").glob("part-*")) for x in f.read_text().splitlines()]
    assert lines == [{"image_path": "a", "pred": 0.25}, {"image_path": "b", "pred": 0.5}]
    files.append_status(spark, str(tmp_path / "s"), {"stage": "embed", "state": "done", "seconds": 2})
    (tmp_path / "s" / "part-bad.json").write_text("{broken\n")
    assert [(r.stage, r.seconds) for r in files.read_status(spark, str(tmp_path / "s")).collect()] == [("embed", 2.0)]


def test_heads_learn(spark):
    import random

    r = random.Random(0)
    rows = [(i, int(i % 2), [r.gauss(2.0 * (i % 2), 1.0), r.gauss(0, 1)]) for i in range(400)]
    df = spark.createDataFrame(rows, "row_id long, y int, x array<double>")
    w, b = training.logistic_head(df)
    assert w[0] > 0.5 > abs(w[1])
    got = training.score_linear(df, w, b).collect()
    assert sum((x.p >= 0.5) == x.y for x in got) > 320
    curve = local_sgd.train(df, "row_id", epochs=4, rate=0.05).steps.orderBy("step").collect()
    assert curve[-1].batch_loss < curve[0].batch_loss
    assert training.score_mlp(df, training.mlp_head(df, (8,))).filter("p BETWEEN 0 AND 1").count() == 400


def test_arms_mirrors_reports_and_audits(spark, tmp_path):
    def bad(s):
        raise RuntimeError("no weights")

    got = training.run_arms(spark, {"a": lambda s: 1, "b": bad, "c": lambda s: 3}, str(tmp_path / "status"))
    assert got == {"a": 1, "c": 3}
    assert {r.stage: r.state for r in files.read_status(spark, str(tmp_path / "status")).collect()} == {"a": "done", "b": "failed: no weights", "c": "done"}
    df = spark.createDataFrame([("v", 0.12345678, True)], "view string, auc double, suspect boolean")
    files.write_report(df, str(tmp_path / "r"))
    back = files.resolve(spark, [str(tmp_path / "missing"), str(tmp_path / "r")], lambda s, p: s.read.option("header", True).csv(p))
    assert back.first()["auc"] == "0.123457"
    assert files.write_audit(df, str(tmp_path / "a")) and not files.write_audit(df.filter("false"), str(tmp_path / "b"))
    with pytest.raises(ValueError):
        files.resolve(spark, [str(tmp_path / "missing")], lambda s, p: s.read.csv(p))
    assert not files.catalog_status(spark, ["nothing_here"]).first()["present"]


@pytest.fixture
def tiny_frames(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "2")
    yield
    spark.conf.set(name, before)


def events(n=60):
    import random

    r = random.Random(7)
    rows = [(r.choices("abc", weights=(6, 2, 1))[0], i, r.random(), r.random() < 0.05) for i in range(n)]
    return rows, r.sample(rows, n)


def sequential(rows, alpha=S.ALPHA):
    e, out = {}, {}
    for k, n, v, reset in rows:
        e[k] = None if reset else v if e.get(k) is None else alpha * v + (1 - alpha) * e[k]
        out[k, n] = e[k]
    return out


def test_streams_do_not_depend_on_frames(spark, tmp_path, tiny_frames):
    from driftlab.plans import streams

    rows, mixed = events()
    for i in range(2):
        spark.createDataFrame(mixed[i::2], E).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    read = lambda: spark.readStream.schema(E).option("recursiveFileLookup", True)
    out = streams._streamed(spark, S.ema_stream(read().parquet(f"{tmp_path}/in"), "k", "v", "n", "reset"), "ema")
    assert {(r.k, r.n): None if r.ema is None or r.ema != r.ema else r.ema for r in out.collect()} == pytest.approx(sequential(rows))
    want = {(k, n) for k in "abc" for n in sorted(n for g, n, *_ in rows if g == k)[:5]}
    for files_each in (1, 10):  # several triggers, and one
        stream = read().option("maxFilesPerTrigger", files_each).parquet(f"{tmp_path}/in")
        out = streams._streamed(spark, S.quota_stream(stream, "k", "n", 5), "quota")
        assert out.count() <= 2 * len(want)
        assert sorted((r.k, r.n) for r in S.first_of_group(out, "k", "n", 5).collect()) == sorted(want)


def test_a_long_key_is_smoothed_in_ranges(spark, tiny_frames):
    rows, mixed = events(400)
    df = spark.createDataFrame(mixed, E)
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    try:
        out = S.ema_batch(df, "k", ["n"], "v", F.col("reset"))
        assert {(r.k, r.n): r.ema for r in out.collect()} == pytest.approx(sequential(rows))
        plain = [(k, n, v, False) for k, n, v, _ in rows]
        out = S.ema_batch(spark.createDataFrame(plain, E), "k", ["n"], "v", F.col("reset"))
        assert {(r.k, r.n): r.ema for r in out.collect()} == pytest.approx(sequential(plain))
    finally:
        spark.conf.unset(name)

import io
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftlab.functions import pixels as P
from driftlab.operators import views
from driftlab.sources import files

R = np.random.default_rng(0)
X = np.clip(np.add.outer(np.arange(40) * 3, np.arange(60) * 2)[..., None] + R.integers(0, 30, (40, 60, 3)), 0, 255).astype(np.uint8)


def test_degradations_degrade_by_degrees():
    err = lambda y: np.abs(y.astype(int) - X).mean()
    assert err(P.jpeg(X, 90)) < err(P.jpeg(X, 50)) < err(P.jpeg(X, 10))
    assert err(P.blur(X, 0.5)) < err(P.blur(X, 2.0))
    assert 0 < err(P.resize_round_trip(X, 0.5)) < err(P.resize_round_trip(X, 0.1))
    assert err(P.add_noise(X, 0.02, 1)) < err(P.add_noise(X, 0.1, 1))
    assert (P.add_noise(X, 0.1, 1) == P.add_noise(X, 0.1, 1)).all()


def test_shapes():
    assert P.center_crop(X, 0.8).shape == (32, 48, 3) and P.fit_square(X, 24).shape == (24, 24, 3)
    assert P.long_side_cap(X, 30).shape == (20, 30, 3) and P.long_side_cap(X, 90) is X
    flat = np.full((8, 8, 3), 77, np.uint8)
    assert (P.jpeg(flat, 90) == P.blur(flat, 1.0)).all() and P.saturation(flat) == 0
    assert P.normalize(flat, [0.0] * 3, [1.0] * 3) == pytest.approx(77 / 255)
    for steps in views.view_steps().values():
        assert P.apply_steps(X, steps, 3).dtype == np.uint8


def test_views_and_facts_of_a_table(spark):
    df = spark.createDataFrame([("a", 40, 60, bytearray(X.tobytes())), ("b", 40, 60, bytearray(b"short")), ("c", None, 60, None)], "path string, height int, width int, data binary")
    v = df.select("path", P.pixel_view(F.col("data"), F.col("height"), F.col("width"), F.lit(5), views.view_steps()["chain_medium"]).alias("v")).select("path", "v.*").collect()
    assert (v[0].height, v[0].width, len(v[0].data)) == (32, 48, 32 * 48 * 3) and v[1].data is None and v[2].data is None
    f = P.image_facts(df).collect()
    assert len(f[0].grey) == 256 and f[1].saturation is None


def test_archives_and_columns(spark, tmp_path):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for n in ("in/a.png", "in/b.txt", "out/c.png"):
            z.writestr(n, n)
    (tmp_path / "x.zip").write_bytes(b.getvalue())
    assert [(r.member, bytes(r.content)) for r in files.archive_members(spark, str(tmp_path), "in/").collect()] == [("in/a.png", b"in/a.png")]
    df = spark.createDataFrame([(None, bytearray(b"1")), (bytearray(b"2"), None)], "img binary, photo binary")
    assert [bytes(r[0]) for r in df.select(files.first_column(df)).collect()] == [b"1", b"2"]
    with pytest.raises(ValueError):
        files.first_column(df.select(F.lit(1).alias("x")))

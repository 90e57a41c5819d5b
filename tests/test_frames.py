import random
import re

import pytest
from pyspark.sql import functions as F

from driftlab.operators import frames as R

ROWS = "k string, o long, v double, id long"


def made(n=700, seed=1):
    r = random.Random(seed)  # one key holds most rows, one has no name
    return [(r.choices(["hot", "b", None, "c"], (8, 1, 1, 0.2))[0], i, r.choice([None, 1.0, 2.5, 4.0]), i) for i in r.sample(range(5000), n)]


@pytest.fixture(params=[7, 10_000])
def chunk(request, monkeypatch):
    monkeypatch.setattr(R, "CHUNK", request.param)


def keyed(rows):
    out = {}
    for r in sorted(rows, key=lambda r: r[1]):
        out.setdefault(r[0], []).append(r)
    return out


def test_numbers_trailing_and_running_frames(spark, chunk):
    rows = made()
    df = spark.createDataFrame(rows, ROWS).repartition(6)
    assert {r.id: r.n for r in R.numbered(df, ["k"], ["o"]).collect()} == {r[3]: i for own in keyed(rows).values() for i, r in enumerate(own)}
    got = {r.id: (r.m, r.c) for r in R.trailing(df, ["k"], ["o"], {"m": F.sum("v"), "c": F.count(F.lit(1))}, 5).collect()}
    want = {}
    for own in keyed(rows).values():
        for i, r in enumerate(own):
            seen = own[max(0, i - 4) : i + 1]
            values = [x[2] for x in seen if x[2] is not None]
            want[r[3]] = (sum(values) if values else None, len(seen))
    assert got == want
    got = {r.id: (r.s, r.c) for r in R.cumulative(df, ["k"], ["o"], {"s": F.col("v"), "c": F.lit(1)}).collect()}
    assert got == {r[3]: (sum(x[2] or 0 for x in own[: i + 1]), i + 1) for own in keyed(rows).values() for i, r in enumerate(own)}


def test_frames_without_a_key_and_without_rows(spark, chunk):
    df = spark.createDataFrame(made(60), ROWS)
    assert sorted(r.n for r in R.numbered(df, [], ["o"]).collect()) == list(range(60))
    none = df.filter("false")
    assert R.trailing(none, ["k"], ["o"], {"m": F.sum("v")}).count() == R.cumulative(none, [], ["o"], {"s": F.col("v")}).count() == R.nearest(none, df, "o", ["id"], ["k"]).count() == 0


@pytest.mark.parametrize("by", [["k"], []])
def test_nearest_equals_brute_force(spark, by):
    r = random.Random(3)
    key = lambda: r.choices(["hot", "b", None], (8, 1, 1))[0]
    left = [(key(), r.choice([None, 50, r.randrange(200)]), 0.5, i) for i in range(400)]
    right = [(key(), r.choice([None, r.randrange(0, 220, 3)]), 0.5, i) for i in range(90)] + [("only right", 3, 0.0, 900)]
    df = lambda rows: spark.createDataFrame(rows, ROWS).repartition(5)
    got = {x.id: (x.before, x.after, x.nearest) for x in R.nearest(df(left), df(right), "o", ["id"], by).collect()}
    assert len(got) == 400
    for k, o, _, i in left:
        own = sorted((x[1], x[3]) for x in right if x[1] is not None and (not by or x[0] == k))
        first = {}
        for p, n in own:
            first.setdefault(p, n)
        before = max(((p, n) for p, n in first.items() if o is not None and p <= o), default=None)
        after = min(((p, n) for p, n in first.items() if o is not None and p > o), default=None)
        near = min((x for x in (before, after) if x), key=lambda x: (abs(x[0] - o), x[0]), default=None)
        assert tuple(x and tuple(x) for x in got[i]) == (before, after, near)



def test_filled_takes_the_last_value_over_ranges(spark):
    rows = made(400, 5)
    got = {r.id: r.last for r in R.filled(spark.createDataFrame(rows, ROWS).repartition(6), ["k"], ["o"], "v", "last").collect()}
    for own in keyed(rows).values():
        last = None
        for r in own:
            last = r[2] if r[2] is not None else last
            assert got[r[3]] == last


def test_nearest_reads_no_range_again_for_each_row(spark):
    df = spark.createDataFrame([(None, i, 0.5, i) for i in range(2000)], ROWS)
    out = R.nearest(df, df.filter("id % 200 = 100"), "o", ["id"])
    # a frame from beside a row to its key's end is read anew for every row
    plan = out._jdf.queryExecution().analyzed().toString().lower()
    assert "rowframe, unboundedpreceding" in plan and not re.search(r"rowframe, (?!unboundedpreceding)[^,]*, unboundedfollowing", plan)
    got = {r.id: r.nearest.id for r in out.collect()}
    assert all(got[i] == min(range(100, 2000, 200), key=lambda x: (abs(x - i), x)) for i in range(2000))

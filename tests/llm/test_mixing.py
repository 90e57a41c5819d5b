import pytest
from pyspark.sql import functions as F

from driftlab.llm import mixing

DOCS = "doc_id long, text string, source string, Size int, target string"


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, open_, out = sum(sizes.values()), set(names), {}
    while True:
        total = sum(w[s] for s in open_)
        over = [s for s in open_ if left * w[s] / total > most * sizes[s]]
        if not over:
            return out | {s: left * w[s] / total for s in open_}
        for s in over:
            out[s] = most * sizes[s]
        left -= sum(most * sizes[s] for s in over)
        open_ -= set(over)


def test_targets_and_taken(spark):
    rows, k = [], 0
    for source, n, words in [("a", 3, 4), ("b", 50, 9), ("c", 40, 30), (None, 5, 7), ("e", 1, 0), ("f", 2, 3), ("Z", 12, 11)]:
        for _ in range(n):
            rows.append((k, " \t".join(["wé"] * words), source, 1, "x"))
            k += 1
    rows += [(None, None, "a", 1, None), (3, "one two", "b", 1, None), (3, "one two", "b", 1, None)]
    docs = spark.createDataFrame(rows, DOCS)
    got = mixing.mix_sources(docs).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, s, *_ in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = brute_targets(sizes)
    taken = {}
    for r in got:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source]
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        assert (r.positions is None) == (r.taken == 0)
        assert all(0 <= p <= 1 for p in r.positions or [])
        assert (r.positions or []) == sorted(r.positions or [])
    assert taken == {s: round(v) for s, v in want.items()}
    known = [r.position for r in got if r.position is not None]
    assert known == sorted(known)
    again = mixing.mix_sources(docs.repartition(3)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert mixing.mix_sources(docs.limit(0)).count() == 0
    assert {r.taken for r in mixing.mix_sources(docs.filter("text is null")).collect()} == {0}


def test_schedule_is_inverted(spark):
    knots = ((0.0, 2.0), (0.3, 1.0), (0.6, 1.0), (1.0, 0.25))
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:]))

    def demand(t):
        out = 0.0
        for (t0, m0), (t1, m1) in zip(knots, knots[1:]):
            u = min(max(t - t0, 0), t1 - t0)
            out += m0 * u + (m1 - m0) / (t1 - t0) * u * u / 2
        return out / area

    ts = [i / 50 for i in range(51)]
    df = spark.createDataFrame([(t, demand(t)) for t in ts], "t double, share double")
    for r in df.select("t", mixing.invert(F.col("share"), knots).alias("back")).collect():
        assert r.back == pytest.approx(r.t, abs=1e-9)


def test_what_weighs_most_comes_early(spark):
    docs = spark.createDataFrame([(i, "w " * 10, "a" if i % 2 else "b", 0, "") for i in range(2000)], DOCS)
    mean = {r.source: r.m for r in mixing.mix_sources(docs).groupBy("source").agg(F.avg("position").alias("m")).collect()}
    assert mean["a"] < 0.45 and mean["b"] == pytest.approx(0.5, abs=0.02)


def test_rows_that_agree_are_laid_out_in_blocks(spark, monkeypatch):
    long = "word " * 300_000
    rows = [(None, "a b", "s", 1, "x")] * 25 + [(7, None, "s", 1, "x")] * 11 + [(8, "c", None, 1, "x")] * 10 + [(9, long, "t", 1, "x"), (1, "d e f", "t", 1, "x")]
    docs = spark.createDataFrame(rows, DOCS)
    facts = lambda: sorted(map(str, mixing.mix_sources(docs).collect()))
    whole = facts()
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 4)
    assert facts() == whole and len(whole) == len(rows)
    got = mixing.mix_sources(docs).collect()
    assert [r.size for r in got if r.doc_id == 9] == [300_000]
    assert len({str(r.positions) for r in got if r.doc_id is None and r.taken}) == sum(r.doc_id is None and r.taken > 0 for r in got)  # each has places of its own

import math
import random

import pytest
from pyspark.sql import functions as F

from driftlab.streaming import live as V


def splits(rows, parts, r):
    """rows cut into runs, each of them shuffled."""
    cuts = sorted(r.sample(range(len(rows) + 1), parts - 1))
    out = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)])]
    return [r.sample(x, len(x)) for x in out]


def brute_reader(rows, default, quota, classes, stop, skip=0, min_scan=0, min_seen=200, most_bad=0.5):
    n, kept, seen, bad, opened = {}, [], 0, 0, set(classes)
    q = lambda g: quota.get(g, default)
    full = lambda: all(n.get(g, 0) >= q(g) for g in opened)
    for at, g, b in rows:
        if at is None or g is None or at <= skip:
            continue
        seen += 1
        if b:
            bad += 1
            if seen >= min_seen and bad / seen > most_bad:
                return kept, None, at, seen, bad
            continue
        if stop == "overflow" and g not in classes:
            continue
        if n.get(g, 0) >= q(g):
            if stop == "overflow" and full():
                return kept, at, None, seen, bad
            continue
        n[g] = n.get(g, 0) + 1
        opened.add(g)
        kept.append(at)
        if stop == "filled" and at >= min_scan and full():
            return kept, at, None, seen, bad
    return kept, None, None, seen, bad


@pytest.mark.parametrize("seed,stop,p_bad,most", [(1, "filled", 0.1, 0.5), (2, "filled", 0.45, 0.45), (3, "overflow", 0.1, 0.5)])
def test_quota_reader_equals_a_reader_for_any_split(spark, tmp_path, seed, stop, p_bad, most):
    r = random.Random(seed)
    rows = [(i, r.choices(["real", "a", "b", "c", None], (5, 2, 2, 0.2, 0.1))[0], r.random() < p_bad) for i in range(1, 260)]
    kw = dict(default=4, quota={"real": 30}, classes=("real", "a") if stop == "overflow" else ("real",), stop=stop, skip=3, min_scan=60, min_seen=40, most_bad=most)
    want = brute_reader(rows, **kw)
    assert want[1] is not None or want[2] is not None
    for k, parts in enumerate((1, 4)):
        reader = V.QuotaReader(spark, f"file://{tmp_path}/{k}", "at", "g", bad=F.col("bad"), **kw)
        for i, part in enumerate(splits(rows, parts, r)):
            df = spark.createDataFrame(part, "at long, g string, bad boolean")
            for _ in range(2 if i == 1 else 1):  # a replayed batch changes nothing
                reader.step(df, i)
        s = reader.state()
        assert sorted(x.at for x in reader.rows().collect()) == want[0]
        assert (s.stopped, s.aborted, s.seen, s.bad) == want[1:]


def test_quota_reader_of_an_empty_stream(spark, tmp_path):
    reader = V.QuotaReader(spark, f"file://{tmp_path}", "at", "g", 3)
    assert reader.rows().count() == 0
    reader.step(spark.createDataFrame([], "at long, g string"), 0)
    assert reader.rows().count() == 0 and reader.state().stopped is None


def brute_table(batches, fails, size=3, attempts=2):
    table, pending = {}, []
    for i, batch in enumerate(batches):
        latest = {}
        for k, v, op, x, t in [(*c, 0) for c in batch if c[0] is not None and c[1] is not None] + pending:
            c = (v, op, x, t)
            latest[k] = max(latest.get(k, c), c, key=lambda z: (z[0], z[1], -math.inf if z[2] is None else z[2], z[3]))
        latest = {k: c for k, c in latest.items() if k not in table or c[0] > table[k][0]}
        sent, pending = sorted(k for k, c in latest.items() if c[1] != "delete"), []
        for a in range(0, len(sent), size):
            request = sent[a : a + size]
            bad = any(fails(i, k) for k in request)
            for k in request:
                v, op, x, t = latest[k]
                if bad and t + 1 < attempts:
                    pending.append((k, v, op, x, t + 1))
                else:
                    table[k] = (v, op, None if bad else x, "unreachable" if bad else None)
        for k, (v, op, x, t) in latest.items():
            if op == "delete":
                table[k] = (v, op, None, None)
    return table, pending


def test_changes_with_retries_replays_and_late_versions(spark, tmp_path):
    r = random.Random(4)
    keys = [f"k{i:02}" for i in range(14)]
    batches = [[(r.choice([*keys, keys[0], None]), r.choice([None, r.randrange(20)]) if r.random() < 0.1 else r.randrange(5 * i, 5 * i + 8), r.choices(["upsert", "delete"], (4, 1))[0], r.random()) for _ in range(12)] for i in range(4)]
    fails = lambda i, k: i in (1, 2) and k in ("k03", "k08")
    table = V.ChangeTable(spark, f"file://{tmp_path}", lambda i: F.col("key").isin("k03", "k08") & F.lit(i in (1, 2)), size=3, attempts=2)
    for i, b in enumerate(batches):
        df = spark.createDataFrame(r.sample(b, len(b)), "key string, version long, op string, value double")
        for _ in range(1 + i % 2):
            table.step(df, i)
        want, pending = brute_table(batches[: i + 1], fails)
        got = {x.key: (x.version, x.op, x.value, x.error) for x in table.before("table", i + 1).collect()}
        assert got == want and sorted(tuple(x) for x in table.before("pending", i + 1).collect()) == sorted(pending)
    assert {x.key for x in table.current().collect()} == {k for k, c in want.items() if c[1] != "delete"}


def test_a_batch_that_breaks_off_leaves_the_table_as_it_was(spark, tmp_path):
    table = V.ChangeTable(spark, f"file://{tmp_path}")
    rows = lambda *x: spark.createDataFrame(list(x), "key string, version long, op string, value double")
    table.step(rows(("a", 1, "upsert", 0.5)), 0)
    table.fails = lambda i: F.raise_error(F.lit("down"))
    with pytest.raises(Exception, match="down"):
        table.step(rows(("a", 2, "upsert", 0.7)), 1)
    assert [x.value for x in table.current().collect()] == [0.5]
    table.fails = lambda i: F.lit(False)
    table.step(rows(("a", 2, "upsert", 0.7)), 1)
    assert [x.value for x in table.current().collect()] == [0.7]


def test_heads_are_exchanged_between_triggers(spark, tmp_path):
    scorer = V.OnlineScorer(spark, f"file://{tmp_path}")
    head = lambda w: {"mean": [0.0, 1.0], "std": [1.0, 2.0], "weights": [w, -w], "bias": 0.1}
    rows = [(5, [1.0, 2.0]), (1, None), (3, [1.0]), (4, [float("nan"), 0.0]), (2, [0.5, 0.5]), (6, [None, 1.0])]
    df = spark.createDataFrame(rows, "id long, x array<double>")
    scorer.step(df, 0)
    scorer.publish(head(1.0), 7)
    scorer.step(df, 1)
    scorer.publish(head(2.0), 8)
    scorer.step(df, 1)  # a replay keeps its head
    scorer.step(df, 2)
    got = {(x.batch, x.id): x for x in scorer.rows().collect()}
    assert len(got) == 18 and {b: {x.head for (k, _), x in got.items() if k == b} for b in range(3)} == {0: {None}, 1: {7}, 2: {8}}
    for (b, i), x in got.items():
        v = dict(rows)[i]
        error = "no head" if b == 0 else "unreadable" if v is None else "another length" if len(v) != 2 else None if all(c is not None and c == c for c in v) else "not finite"
        assert x.error == error
        if error is None:
            assert x.pred == pytest.approx(1 / (1 + math.exp(-(b * v[0] - b * (v[1] - 1) / 2 + 0.1))), abs=1e-8)
        assert x.place == 1 + sorted(dict(rows), key=lambda j: (got[b, j].error is None, j)).index(i)


def brute_versions(rows, idle, alpha=0.6):
    out, state = {}, {}
    for key, t, seq, kind, version, value in sorted((x for x in rows if x[0] is not None), key=lambda x: (x[1], x[2])):
        known = state.get(key)
        if known and t - known[0] > idle:
            known = None
        if kind == "load":
            known = (t, version, None)
        elif kind == "remove":
            known = None
        elif known and version == known[1] and value is not None:
            ema = value if known[2] is None else alpha * value + (1 - alpha) * known[2]
            known = (t, known[1], ema)
            out[key, t, seq] = ema
        # any row keeps a key awake, also one that does not count
        state[key] = (t, *known[1:]) if known else (t, -1, None)
    return out, state


@pytest.mark.parametrize("seed,parts", [(1, 1), (1, 5), (2, 4)])
def test_versions_removals_and_late_results_equal_a_replay(spark, tmp_path, seed, parts):
    r = random.Random(seed)
    rows = []
    for i in range(300):
        key = r.choices(["hot", "b", "c", None], (10, 3, 1, 0.3))[0]
        kind = r.choices(["load", "result", "remove"], (1, 8, 0.5))[0]
        rows.append((key, i // 2 + 40 * (i // 100), i, kind, r.randrange(2), r.choice([None, *[r.random()] * 9])))
    scores = V.VersionedScores(spark, f"file://{tmp_path}", idle=12)
    for i, part in enumerate(splits(rows, parts, r)):
        for _ in range(2 if i == 1 else 1):
            scores.step(spark.createDataFrame(part, "key string, t long, seq long, kind string, version int, value double"), i)
    want, state = brute_versions(rows, 12)
    got = {(x.key, x.t, x.seq): x.ema for x in scores.rows().collect()}
    assert want and got == pytest.approx(want)
    newest = max(x[1] for x in rows)
    kept = {x.key: (x.t, x.version, x.ema) for x in scores.before("state", parts).collect()}
    alive = {k: s for k, s in state.items() if s[1] != -1 and newest - s[0] <= 12}
    assert kept.keys() == alive.keys() and all(kept[k][:2] == alive[k][:2] and kept[k][2] == (pytest.approx(alive[k][2]) if alive[k][2] is not None else None) for k in alive)


def test_the_state_does_not_grow_with_keys_that_idle(spark, tmp_path):
    scores = V.VersionedScores(spark, f"file://{tmp_path}", idle=10)
    for i in range(3):
        rows = [(f"k{i}-{j}", 100 * i + j % 3, j, "load", 1, None) for j in range(50)]
        scores.step(spark.createDataFrame(rows, "key string, t long, seq long, kind string, version int, value double"), i)
        assert scores.before("state", i + 1).count() == 50

import importlib.util
import random
from pathlib import Path

import pytest

import corpus_pipeline as P
from driftlab.llm import langid

sys_path = Path(__file__).resolve().parent


def _other(name):
    spec = importlib.util.spec_from_file_location(name, sys_path / f"{name}.py")
    out = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(out)
    return out


jaccard, dedup, decon, mixing = (_other(f"test_{x}") for x in ("jaccard", "suffix_dedup", "decontaminate", "mixing"))
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
VOCAB = {"en": "the of and with over house thing made from".split(), "fr": "été élève où garçon une leçon forêt".split()}


@pytest.fixture(scope="module")
def case(spark, tmp_path_factory):
    r = random.Random(8)

    def prose(lang, n):
        return " ".join(r.choice(VOCAB[lang]) + str(r.randrange(400)) for _ in range(n))

    items = [(i, prose("en", r.randint(15, 40))) for i in range(8)]
    shared = [prose("en", 70) for _ in range(3)]
    rows = []
    for i in range(160):
        lang = r.choice(("en", "en", "fr"))
        t = prose(lang, r.randint(20, 120))
        if i % 7 == 0:
            t = f"{t}\n{r.choice(shared)}\n{prose(lang, 10)}"
        if i % 11 == 0:
            t += "\n" + r.choice(items)[1]
        if rows and i % 5 == 0:
            w = r.choice(rows)[1].split(" ")
            w[len(w) // 2] = "changed"
            t = " ".join(w)
        rows.append((i, t, lang, r.choice(("a", "b", "c", None)), len(t)))
    rows += [(200, None, "en", "a", 0), (201, "", None, "b", 0), (202, "12 34 !!", "fr", "c", 8), (203, rows[0][1], "en", "d", 1), (None, prose("en", 30), None, None, None)]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows, items


def test_stages_match_brute_force(spark, case):
    path, rows, items = case
    docs, left = spark.read.parquet(f"{path}/documents.parquet"), rows
    columns = docs.columns
    for k, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, path).cache()
        got = sorted(map(str, (tuple(x) for x in out.collect())))
        if k == 0:
            assert langid.UND == "und"
            left = [x for x in left if langid.has_letter(x[1])]
        elif k == 1:
            first = jaccard.brute([(x[0], x[1]) for x in left])
            left = [x for x, f in zip(left, first) if x[0] == f[1]]
        elif k == 2:
            least, new = {}, []
            for x in left:
                b = x[1].encode()
                for j in range(len(b) - 49):
                    i = dedup.S._LAST if x[0] is None else x[0]
                    least[b[j : j + 50]] = min(least.get(b[j : j + 50], i), i)
            for x in left:
                b, i = x[1].encode(), dedup.S._LAST if x[0] is None else x[0]
                gone = bytearray(len(b))
                for j in range(len(b) - 49):
                    if least[b[j : j + 50]] < i:
                        gone[j : j + 50] = b"\1" * 50
                t = bytes(v for v, g in zip(b, gone) if not g).decode("utf-8", "ignore")
                new.append((x[0], t, x[2], x[3], len(t) if t != x[1] else x[4]))
            assert new != left
            left = new
        elif k == 3:
            before = len(left)
            left = [x for x in left if not decon.brute(x[1], items)]
            assert len(left) < before
        else:
            sizes = {}
            for x in left:
                sizes[x[3]] = sizes.get(x[3], 0) + len(x[1].split())
            want = mixing.brute_targets(sizes)
            taken = {}
            for x in out.collect():
                assert x.target == pytest.approx(want[x.source])
                taken[x.source] = taken.get(x.source, 0) + x.taken
            assert taken == {s: round(v) for s, v in want.items()} and len(got) == len(left)
            break
        assert out.columns == columns and got == sorted(map(str, left)), name
        docs = spark.createDataFrame(left, DOCS)


def test_run_equals_its_stages_and_empty_tables_pass(spark, case, tmp_path):
    path, rows, _ = case
    a = P.run(spark, path)
    b = P.run(spark, path)
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect())) and 0 < a.count() < len(rows)
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0

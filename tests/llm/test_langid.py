import random
import zlib

import numpy as np
import pytest

from driftlab.llm import langid

DOCS = "doc_id long, text string, lang string, score string"
WORDS = {"en": "the of and thing with over house".split(), "fr": "été élève où ça garçon le une".split(), "de": "über straße für und größe nicht".split()}


def made(n, seed):
    r = random.Random(seed)
    return [(" ".join(r.choices(WORDS[lang], k=r.randint(3, 60))), lang) for lang in (r.choice(list(WORDS)) for _ in range(n))]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, lang if i % 9 else None, "s") for i, (t, lang) in enumerate(made(600, 1))]
    rows += [(600, None, "en", None), (601, "", "fr", None), (602, "123 !!", "de", None), (None, "the house", "en", None), (7, "the thing", "en", None), (603, "the " * 20_000, "en", None)]
    return spark.createDataFrame(rows, DOCS)


def test_held_out_accuracy_and_edges(docs):
    model = langid.fit(docs)
    got = langid.predict(docs, model).collect()
    assert len(got) == docs.count()
    truth = {i: lang for i, (_, lang) in enumerate(made(600, 1))}
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 600 and r.doc_id != 7]
    assert all((zlib.crc32(str(r.doc_id).encode()) % 4 == 2) == r.held_out for r in got if r.doc_id is not None)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.98
    by = {r.doc_id: r for r in got}
    assert all((by[i].lang_pred, by[i].score) == ("und", 0.0) for i in (600, 601, 602))
    assert by[603].lang_pred == "en" and all(0 <= r.score <= 1 for r in got)
    assert (model.weights == 0).mean() > 0.5


def test_held_out_rows_and_labels_teach_nothing(docs, spark):
    from pyspark.sql import functions as F

    other = docs.withColumn("lang", F.when(langid.crc32_fold("doc_id") == 2, F.lit("xx")).otherwise(F.col("lang")))
    a, b = langid.fit(docs), langid.fit(other)
    assert a.languages == b.languages and np.array_equal(a.weights, b.weights)


def test_document_frequencies_match_brute_force(docs):
    df, total = langid.document_frequencies(docs)
    want, n = np.zeros(1 << langid.BITS, int), 0
    for r in docs.collect():
        if r.text:
            want[langid.features(r.text)[0]] += 1
            n += 1
    assert total == n and np.array_equal(df, want)


def test_no_labels_and_empty(spark, docs):
    assert langid.fit(docs.filter("false")) is None
    assert langid.predict(docs.filter("false"), None).count() == 0
    assert {r.lang_pred for r in langid.predict(docs, None).collect()} == {"und"}
    kept = langid.keep_identified(docs, langid.fit(docs))
    assert kept.columns == docs.columns and kept.count() == docs.count() - 3


def test_what_the_filter_keeps(spark):
    words = {"en": "the of and with over house thing made from".split(), "fr": "été élève où garçon une leçon forêt".split(), "de": "über straße und nicht schön weiß".split()}
    r = random.Random(2)
    rows = [(i, " ".join(r.choices(words[lang], k=r.randint(1, 60))), lang) for i in range(600) for lang in (r.choice(("en", "en", "en", "fr", "de")),)]
    other = [(1_000, "съешь ещё этих мягких французских булок", None), (1_001, "今日は天気がいいですね", "en"), (1_002, None, "en"), (1_003, "12 %", "en"), (1_004, "לשון קודש", "fr")]
    df = spark.createDataFrame(rows + other, "doc_id long, text string, lang string")
    model = langid.fit(spark.createDataFrame(rows, df.schema))
    kept = {x.doc_id for x in langid.keep_identified(df, model).collect()}
    assert kept == {i for i, _, _ in rows}


def test_sample_is_bounded_in_bytes_and_ids(spark):
    rows = [(i, "the house " * 20, "en") for i in range(100)] + [(None, f"la maison {k} " * 20, "fr") for k in range(100)] + [(7_000 + i, "x" * 50_000, "de") for i in range(20)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample_bytes=100_000)
    assert model.languages == ["en", "fr"]  # the long texts are over a hundredth of the bound
    assert langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample_bytes=10) is None


def test_ftrl_steps_match_a_plain_version():
    rows = [("the house of the thing", "en"), ("une maison où", "fr"), ("with the house", "en"), ("la leçon été", "fr")]
    idf = np.ones(1 << langid.BITS)
    model = langid.train(rows, idf, epochs=2)
    z, n, size = {}, {}, 1 << langid.BITS

    def weight(i, c):
        l1 = 0.0 if i == size else langid.L1
        s = z.get((i, c), 0.0)
        return 0.0 if abs(s) <= l1 else -(s - np.sign(s) * l1) / ((langid.BETA + np.sqrt(n.get((i, c), 0.0))) / langid.ALPHA + langid.L2)

    for _ in range(2):
        for text, lang in rows:
            at, v = langid.vector(text, idf)
            x = {**dict(zip(at.tolist(), v.tolist())), size: 1.0}
            w = {(i, c): weight(i, c) for i in x for c in (0, 1)}
            s = [sum(w[i, c] * u for i, u in x.items()) for c in (0, 1)]
            p = np.exp(np.array(s) - max(s))
            p /= p.sum()
            for i, u in x.items():
                for c in (0, 1):
                    g = u * (p[c] - (c == ("en", "fr").index(lang)))
                    old = n.get((i, c), 0.0)
                    z[i, c] = z.get((i, c), 0.0) + g - (np.sqrt(old + g * g) - np.sqrt(old)) / langid.ALPHA * w[i, c]
                    n[i, c] = old + g * g
    for i, c in z:
        got = model.bias[c] if i == size else model.weights[i, c]
        assert got == pytest.approx(weight(i, c), abs=1e-5)
    assert (model.weights == 0).mean() > 0.99

import random
import re
import textwrap

from driftlab.llm import licenses as L

DOCS = "doc_id long, text string, labels string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


WIDTH = {k: int(len(WORD.findall(lower(t))) / L.THRESHOLD + 1e-9) for k, t in L.TEMPLATES.items()}


def brute(text):
    words = WORD.findall(lower(text))
    places, base = [], set()
    for p, label in L.PHRASES.items():
        w = p.split()
        at = [i for i in range(len(words) - len(w) + 1) if words[i : i + len(w)] == w]
        places += at
        base |= {label} if at else set()
    labels, best = set(base), 0.0
    for line in lower(text).split("\n"):
        own = WORD.findall(line)
        for label, t in L.TEMPLATES.items():
            width, t = WIDTH[label], set(WORD.findall(lower(t)))
            if len(set(own) & t) < L.THRESHOLD * len(t) - 1e-9:
                continue
            most = max(len(set(own[i : i + width]) & t) for i in range(max(1, len(own) - width + 1)))
            if most >= L.THRESHOLD * len(t) - 1e-9:
                labels.add(label)
                best = max(best, most / len(t))
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), 1.0 if base else best


def test_matches_brute_force(spark):
    r = random.Random(3)
    vocab = sorted({w for t in L.TEMPLATES.values() for w in WORD.findall(lower(t))}) + ["été", "x1", "MIT", "İ", "K"]
    texts = [None, "", "MIT", "the Apache-License; mit\nlicense", "GENERAL public license general public license", "\n\n", "a" * 70_000]
    for _ in range(300):
        lines = []
        for _ in range(r.randint(1, 6)):
            w = L.TEMPLATES[r.choice(list(L.TEMPLATES))].split() if r.random() < 0.5 else r.choices(vocab, k=r.randint(0, 30))
            w = [x for x in w if r.random() > 0.06] + r.choices(vocab, k=r.randint(0, 3))
            r.shuffle(w)
            lines.append(r.choice([" ", ", ", "--"]).join(w))
        texts.append("\n".join(lines))
    texts.append("\n".join(texts[7:]) * 20)
    rows = [(i if i else None, t, "clash") for i, t in enumerate(texts)] + [(5, texts[5], "x")]
    docs = spark.createDataFrame(rows, DOCS)
    got = L.scan_licenses(docs).collect()
    assert len(got) == len(rows)
    for x in got:
        assert tuple(x)[1:8] == brute(texts[x.doc_id or 0]), x
        for b in x.blocks:
            line = (texts[x.doc_id or 0] or "").encode()[b.start : b.end].decode()
            assert len(WORD.findall(lower(line))) <= WIDTH[b.label] and "\n" not in line
            own, t = set(WORD.findall(lower(line))), set(WORD.findall(lower(L.TEMPLATES[b.label])))
            assert b.containment == len(own & t) / len(t)
    assert sum(len(x.blocks) for x in got) > 100
    assert L.scan_licenses(docs.limit(0)).count() == 0


def test_counts_cover_all_documents(spark):
    docs = spark.createDataFrame([(i, "Licensed under\nlicensed UNDER x", "") for i in range(50)], DOCS).repartition(7)
    v = L._vocabulary({"a": "licensed under nothing"})
    assert sorted(L.token_counts(docs, v).tolist()) == [0, 100, 100]


def brute_windows(text, label):
    """The most distinct words of the template that a window of its length holds, over all windows."""
    t = WORD.findall(lower(L.TEMPLATES[label]))
    words, width = WORD.findall(lower(text)), int(len(t) / L.THRESHOLD + 1e-9)
    return max((len(set(words[i : i + width]) & set(t)) for i in range(max(1, len(words)))), default=0) / len(set(t))


def test_wrapped_notices(spark):
    """Notices wrapped over lines, with and without comment signs, a word in four changed, and alone or amid other text."""
    wrap = lambda k, n: textwrap.fill(" ".join(L.TEMPLATES[k].split()), n, subsequent_indent=" * ")
    bsd, mit = wrap("bsd-conditions", 70), wrap("mit-grant", 60)
    far = "licensed\n" + "word " * 30 + "\nunder CC BY\n" + "word " * 30 + "\n4.0"
    texts = {1: bsd, 2: "Intro.\n" + mit + "\n" + bsd, 3: far, 4: "Licensed under\nCC BY 4.0", 5: "licensed\n\n", 6: "under CC BY 4.0"}
    r = random.Random(5)
    for i in range(200):
        w = L.TEMPLATES[r.choice(list(L.TEMPLATES))].split()
        w = [x if r.random() > 0.03 else "other" for x in w for _ in range(1 + (r.random() < 0.04))]
        w = r.choices(["the", "of", "license", "x"], k=r.randint(0, 40)) + w + r.choices(["is", "and", "rights", "y"], k=r.randint(0, 40))
        texts[10 + i] = "".join(x + r.choice([" ", " ", " ", "\n# "]) for x in w)
    docs = spark.createDataFrame([(i, t, "") for i, t in texts.items()], DOCS)
    got = {x.doc_id: x for x in L.scan_licenses(docs, wrapped=True).collect()}
    for i, t in texts.items():
        shares = {k: brute_windows(t, k) for k in L.TEMPLATES}
        want = {k: v for k, v in shares.items() if v >= L.THRESHOLD - 1e-9}
        base = got[i].base_labels.split(",") if got[i].base_labels else []
        assert got[i].labels == ",".join(sorted({*want, *base})) and got[i].score == (1.0 if base else max(want.values(), default=0.0))
    assert [got[i].labels for i in range(1, 7)] == ["bsd-conditions", "bsd-conditions,mit-grant", "", "cc-by-4.0-licensed", "", ""]
    assert [(b.start, b.end, b.containment) for b in got[1].blocks] == [(0, len(bsd) - 1, 1.0)]
    lines, found = {x.doc_id: x for x in L.scan_licenses(docs).collect()}, 0
    for i, t in texts.items():
        of_line, more = {b.label for b in lines[i].blocks}, {b.label: b for b in got[i].blocks if b.label not in {x.label for x in lines[i].blocks}}
        want = {k for k in L.TEMPLATES if k not in of_line and brute_windows(t, k) >= L.THRESHOLD - 1e-9}
        assert set(more) == want, (i, t)
        assert {tuple(b) for b in lines[i].blocks} <= {tuple(b) for b in got[i].blocks}
        for k, b in more.items():
            part, own = t.encode()[b.start : b.end].decode(), set(WORD.findall(lower(L.TEMPLATES[k])))
            assert "\n" in part and b.containment == len(set(WORD.findall(lower(part))) & own) / len(own)
        found += len(more)
    assert found > 50


def test_whole_licenses_are_found_however_they_are_wrapped(spark):
    r, rows = random.Random(8), []
    for i, (label, text) in enumerate(sorted(L.TEMPLATES.items())):
        body = textwrap.fill(" ".join(text.split()), r.choice((40, 72, 79, 120)), subsequent_indent=r.choice(("", "# ", " * ", "// ")))
        rows.append((i, "Some words before it.\n\n" + body + "\n\nand others after.", label))
    for x in L.scan_licenses(spark.createDataFrame(rows, DOCS), wrapped=True).collect():
        assert rows[x.doc_id][2] in x.labels.split(",") and x.score == 1.0


def test_scattered_words_are_no_notice(spark):
    far = "The software team met under the oak. Nobody was licensed to drive; MIT sent a student and the fishing license expired, so this is the end of the story."
    near = "One more long line of words without any break, " * 3 + "which is licensed under CC BY 4.0 as a whole " + "and goes on for a while after that " * 3
    docs = spark.createDataFrame([(1, far, ""), (2, near, "")], DOCS)
    for wrapped in (False, True):
        got = {x.doc_id: x for x in L.scan_licenses(docs, wrapped=wrapped).collect()}
        assert (got[1].labels, got[1].score, got[2].labels, got[2].score) == ("", 0.0, "cc-by-4.0-licensed", 1.0)


def test_sql_says_the_same(spark, tmp_path):
    """On wrapped, changed, scattered and very long texts, as the given tables have next to no notices."""
    import duckdb
    import pandas as pd

    r, texts = random.Random(12), [None, "", "MIT License", "x " * 50_000 + "licensed under\nCC BY 4.0 " + "license " * 2_000]
    for _ in range(150):
        w = [x for x in L.TEMPLATES[r.choice(list(L.TEMPLATES))].split() if r.random() > 0.04]
        w = [y for x in w for y in [x, *["extra"] * (r.random() < r.choice((0.02, 0.3)))]]
        texts.append("".join(x + r.choice([" ", " ", " ", "\n"]) for x in r.choices(["the", "license"], k=r.randint(0, 20)) + w))
    rows = [(i if i else None, t) for i, t in enumerate(texts)]
    documents = pd.DataFrame({"doc_id": pd.array([i for i, _ in rows], "Int64"), "text": texts})
    con = duckdb.connect()
    con.register("documents", documents)
    cur = con.execute(L.SQL)
    names = [d[0] for d in cur.description]
    want = sorted(map(str, cur.fetchall()))
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], DOCS)
    got = L.scan_licenses(docs, wrapped=True).select(*names).collect()
    assert sorted(str(tuple(x)) for x in got) == want and sum("," in x.labels for x in got) > 20

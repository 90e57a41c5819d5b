import hashlib
import random

import pytest

from driftlab.llm import warc as W
from driftlab.llm.common import shared_dir

PAGES = "page_id long, url string, html string, digest string, keeper int"


def test_loser_tree_merges_any_number_of_runs():
    r = random.Random(2)
    for k in range(0, 12):
        runs = [sorted(r.randint(0, 30) for _ in range(r.randint(0, 20))) for _ in range(k)]
        assert list(W.LoserTree(runs, key=lambda x: x)) == sorted(x for run in runs for x in run)


def test_url_key():
    assert W.url_key("http://WWW.Example.com/A?b=1#top") == "com,example,www)/A?b=1"
    assert (W.url_key(""), W.url_key("no host")) == ("", "no host)")


@pytest.fixture(scope="module")
def pages(spark):
    r = random.Random(4)
    big = ["".join(r.choices("abé\r\n <>", k=1500)) for _ in range(5)]
    rows = [(i, f"http://h{r.randint(0, 3)}.example.org/{r.randint(0, 40)}", r.choice(big + ["small", None, "\r\n\r\n" * 3, "x" * 999, "y" * 1000]), "z", 1) for i in range(1, 400)]
    rows += [(None, None, big[0], None, None), (None, "a\nb\r\n", "null id", None, None), (399, "http://again/", rows[-1][2], None, None), (1000, "http://long/", "long " * 60_000, None, None), (7, "http://m/", big[1], "", 0), (1002, " <http://n/o p> ", "spaces", "", 0), (1001, "http://c/", big[1], "", 0), (1001, "http://c/", big[1], "", 0)]
    return spark.createDataFrame(rows, PAGES), rows


def test_round_trip_and_revisits(spark, pages):
    df, rows = pages
    path = f"{shared_dir(spark)}/w1"
    W.write_warc(df.repartition(5), path)
    got = W.capture_index(spark, path).collect()
    keeper = {}
    for i, _, html, *_ in rows:
        keeper[html or ""] = max(keeper.get(html or "", W._LEAST), W._LEAST if i is None else i)
    want = []
    for i, url, html, *_ in rows:
        raw, k = (html or "").encode(), keeper[html or ""]
        again = len(raw) >= 1000 and k > (W._LEAST if i is None else i)
        want.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", k if again else None))
    assert sorted(map(str, want)) == sorted(str((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in got)
    order = [(r.url_key, r.capture_time, r.page_id is not None, r.page_id or 0) for r in got]
    assert order == sorted(order)
    assert [r.url_key for r in got if r.page_id == 1002] == [W.url_key(" <http://n/o p> ")]
    payloads = W.read_warc(spark, path, with_payload=True).filter("record_type = 'response'").collect()
    assert {bytes(p.payload).decode() for p in payloads} == {r[2] or "" for r in rows}


def test_merge_in_many_ranges_and_pieces(spark, monkeypatch):
    monkeypatch.setattr(W, "PIECE_ROWS", 3)
    monkeypatch.setattr(W, "RANGE_ROWS", 40)
    r = random.Random(6)
    rows = [(r.choice(("", "com,a)/", "com,b)/" + "x" * 300)) + str(r.randint(0, 5)) * r.randint(0, 1), f"2020-01-0{r.randint(1, 9)}", r.choice((None, r.randint(1, 99))), "response", None, 1, "d", f"a{k}", i, 1) for k in range(7) for i in range(90)]
    runs = [x for k in range(7) for x in sorted((y for y in rows if y[7] == f"a{k}"), key=W._key)]
    merged = W.merge_runs(spark.createDataFrame(runs, W.INDEX).coalesce(2))
    got = [tuple(x) for x in merged.collect()]
    assert got == sorted(rows, key=W._key) and merged.rdd.getNumPartitions() > 5


def test_tree_goes_on_with_what_is_left():
    tree = W.LoserTree([[1, 4, 6], [2, 3], []], key=lambda x: x)
    assert [tree.pop(), tree.pop(), tree.pop()] == [1, 2, 3] and tree.least() == 4
    assert list(W.LoserTree([*tree.rest(), [0, 5]], key=lambda x: x)) == [0, 4, 5, 6]


def test_archives_of_several_sizes(spark, monkeypatch):
    monkeypatch.setattr(W, "FILES", ((100, 3), (1_000, 2), (1 << 31, 1)))
    rows = [(i, f"http://h/{i}", "x" * n) for i, n in enumerate([0, 5, 100, 101, 999, 1_001, 5_000, 70_000] * 4)]
    path = f"{shared_dir(spark)}/w3"
    W.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2), path)
    got = W.read_warc(spark, path, with_payload=True).collect()
    assert len(got) == len(rows) and {p.archive for p in got if p.page_id % 8 > 4}.isdisjoint({p.archive for p in got if p.page_id % 8 < 5})
    raw = {f.archive: bytes(f.content) for f in spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).selectExpr("regexp_extract(path, '[^/]+$', 0) AS archive", "content").collect()}
    for p in got:  # a record is where the index says
        assert raw[p.archive][p.offset :].startswith(b"WARC/1.1\r\n") and f"urn:page:{p.page_id}>".encode() in raw[p.archive][p.offset : p.offset + p.length][:200]


def test_empty_table_and_damage(spark, pages):
    import gzip

    path = f"{shared_dir(spark)}/w2"
    W.write_warc(pages[0].limit(0), path)
    assert W.capture_index(spark, path).count() == 0
    good = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    assert [x[3] for x in W.records(gzip.compress(good * 3))] == [b"abc"] * 3
    assert [x[:2] for x in W.records(gzip.compress(good) * 3)] == [x[:2] for x in W.records(good * 3)] == [(k * len(good), len(good)) for k in range(3)]
    for bad in (good[:-5], b"nothing", good[:20], good.replace(b"3", b"9")):
        for packed in (gzip.compress(bad), bad):
            with pytest.raises(ValueError):
                list(W.records(packed))


def test_archives_of_other_writers(spark, tmp_path):
    import base64
    import gzip

    def record(*fields, block=b""):
        return "\r\n".join(["WARC/1.0", *fields, f"content-length: {len(block)}"]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"

    http = b"HTTP/1.1 200 OK\r\nX: y\r\n\r\n"
    sha = lambda b: hashlib.sha1(b).digest()
    b32 = lambda b: base64.b32encode(sha(b)).decode()
    chunked = b"4\r\nwiki\r\n5;x=1\r\npedia\r\n0\r\n\r\n"
    parts = [
        record("WARC-Type: warcinfo", "WARC-Record-ID: <urn:uuid:0>", block=b"software: x\r\n"),
        record("WARC-Type: request", "WARC-Target-URI: http://a.org/", block=b"GET / HTTP/1.1\r\n\r\n"),
        record("WARC-Type: metadata", block=b"via: x"),
        record("warc-type: response", "WARC-TARGET-URI: <http://a.org/1>", "WARC-Date:2020-01-01T00:00:00Z", "WARC-Record-ID: <urn:uuid:1>", f"WARC-Payload-Digest: sha1:{b32(b'one')}", "X-Note: a", "\tgoes: on", "X-Note: b", block=http + b"one"),
        record("WARC-Type: response", "WARC-Target-URI: http://a.org/2", "WARC-Date: 2020-01-02T00:00:00Z", f"WARC-Payload-Digest: SHA-256:{hashlib.sha256(b'two').hexdigest().upper()}", block=http + b"two"),
        record("WARC-Type: response", "WARC-Target-URI: http://a.org/3", f"WARC-Payload-Digest: sha1:{b32(b'wikipedia')}", block=b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked),
        record("WARC-Type: resource", "WARC-Target-URI: http://a.org/4", block=b"plain\r\n\r\nbytes"),
        record("WARC-Type: response", "WARC-Target-URI: http://a.org/5", "WARC-Payload-Digest: odd:xyz", block=b"HTTP/1.1 204 No Content"),
        record("WARC-Type: revisit", "WARC-Target-URI: http://a.org/1", "WARC-Date: 2021", "WARC-Record-ID: <urn:uuid:9>", f"WARC-Payload-Digest: sha1:{b32(b'one')}", block=http),
    ]
    folder = tmp_path / "foreign"
    folder.mkdir()
    (folder / "crawl.warc.gz").write_bytes(b"".join(gzip.compress(p) for p in parts))
    (folder / "crawl.idx").write_bytes(b"not an archive")
    got = [(r.url_key, r.capture_time, r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in W.capture_index(spark, str(folder)).collect()]
    assert got == [
        ("org,a)/1", "2020-01-01T00:00:00Z", None, "response", None, 3, sha(b"one").hex()),
        ("org,a)/1", "2021", None, "revisit", None, None, sha(b"one").hex()),
        ("org,a)/2", "2020-01-02T00:00:00Z", None, "response", None, 3, sha(b"two").hex()),
        ("org,a)/3", "", None, "response", None, len(chunked), sha(chunked).hex()),
        ("org,a)/4", "", None, "resource", None, 14, sha(b"plain\r\n\r\nbytes").hex()),
        ("org,a)/5", "", None, "response", None, 0, sha(b"").hex()),
    ]
    wrong = record("WARC-Type: response", f"WARC-Payload-Digest: sha1:{b32(b'1')}", block=http + b"2")
    offset, length, header, block = next(W.records(wrong))
    with pytest.raises(ValueError, match="another digest"):
        W._capture("x", offset, length, header, block)
    assert header["warc-type"] == "response"
    with pytest.raises(ValueError):
        next(W.records(b"WARC/1.0\r\nWARC-Type: response\r\n\r\nabc\r\n\r\n"))

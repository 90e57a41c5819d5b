import functools
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from driftlab.llm import token_files as T

all_words = functools.cache(lambda: T.Words(T.vocabulary_path()))
SCHEMA = "doc_id long, text string, START int, task string"


@pytest.fixture(scope="module")
def model():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(T.vocabulary_path())


def brute(model, docs):
    out, at = [], 0
    for i, t in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0)):
        ids = [*model.encode(t or "", add_special_tokens=False).ids, 2]
        out.append((i, at, len(ids), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))))
        at += len(ids)
    return out


def run(spark, tmp_path, docs, parts=4, **kw):
    path = f"file://{tmp_path}/files"
    T.write(spark.createDataFrame([(*d, 1, "x") for d in docs], SCHEMA).repartition(parts), path, **kw)
    return [tuple(r) for r in T.positions(T.read(spark, path)).collect()]


def texts(n, seed=4):
    r = random.Random(seed)
    words = ["Straße", "naïve", "it's", "don't", "12,5", "héllo", "世界", "été", "a b", "x\x0by", "<|endoftext|>", "#!?", "ΟΔΟΣ", "İx", "́", "q" * 90]
    return [" ".join(r.choices(words, k=r.choice([0, 1, 5, 80]))) for _ in range(n)]


@pytest.mark.parametrize("size", [1 << 18, 60])
def test_equals_brute_force(spark, tmp_path, model, size):
    docs = [(i * 7 % 101, t) for i, t in enumerate(texts(101))] + [(200, None), (-5, ""), (300, " \n\t"), (301, "long words " * 3000)]
    assert sorted(run(spark, tmp_path, docs, size=size)) == sorted(brute(model, docs))


def test_equal_and_missing_ids(spark, tmp_path, model):
    docs = [(None, "one two"), (None, None), (4, "x y z"), (4, "x y z"), (4, "another"), (None, "one two")]
    got, want = run(spark, tmp_path, docs), brute(model, docs)
    assert sorted((str(r[0]), *r[2:]) for r in got) == sorted((str(r[0]), *r[2:]) for r in want)
    got.sort(key=lambda r: r[1])  # starts and lengths are those of one run of tokens, null ids first
    assert [r[1] for r in got] == np.cumsum([0, *(r[2] for r in got[:-1])]).tolist() and [r[0] for r in got] == [None] * 3 + [4] * 3


def test_empty_table(spark, tmp_path):
    assert run(spark, tmp_path, []) == []


@settings(max_examples=150, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" \n\t\r\x0b\x0c\x1c\x85  'sSt,.!&T(σΣς́ͅİß<|>endoftext1#ǅ"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_words_are_tokenised_as_whole_texts_are(text):
    words = all_words()
    assert np.frombuffer(words.tokens([text.encode()])[0], "<u4").tolist() == words.model.encode(text, add_special_tokens=False).ids


def test_the_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(T, "CACHED_WORDS", 10)
    words = T.Words(T.vocabulary_path())
    for i in range(50):
        words.tokens([f"w{i} Wx{i}, ".encode() + b"z" * 100])
    assert len(words.new) <= 13 and len(words.old) <= 13 and all(len(w) <= T.CACHED_BYTES for w in words.new | words.old)


def test_pieces_and_generations_give_the_same_tokens(monkeypatch):
    whole = [t.encode() for t in texts(60, 9)] + [b"Hello, hello HELLO!? &&& hello,, \xc3\x89t\xc3\xa9. \xe2\x84\xabB", "J̌ ǰ É <|ENDOFTEXT|> A<|endoftext|>b".encode()]
    want = [np.array(all_words().model.encode(t.decode(), add_special_tokens=False).ids, "<u4").tobytes() for t in whole]
    monkeypatch.setattr(T, "CACHED_WORDS", 7)
    monkeypatch.setattr(T, "PIECE", 20)
    small = T.Words(T.vocabulary_path())
    assert small.tokens(whole) == [small.tokens([t])[0] for t in whole] == want == all_words().tokens(whole)


def test_the_table_is_asked_once_a_lot_for_each_word():
    class Counted(dict):
        asked = 0

        def get(self, *a):
            self.asked += 1
            return super().get(*a)

    vocabulary = [f"wo{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(500)]
    text = " ".join(random.Random(1).choices(vocabulary, k=100_000))  # half a megabyte
    words = T.Words(T.vocabulary_path())
    want = words.tokens([text.encode()])
    words.new = Counted(words.new)
    assert words.tokens([text.encode()]) == want and words.new.asked <= 2 * len(vocabulary)


def test_every_letter_that_pieces_may_have(model):
    letters = [chr(i) for i in range(0x80, 0x530) if chr(i).isalpha()]
    texts = [f"{w}{tail}" for x in letters for w in (x, f"a{x}", f"{x}b{x}") for tail in ("", ",")]
    got = T.Words(T.vocabulary_path()).tokens([t.encode() for t in texts])
    assert [np.frombuffer(t, "<u4").tolist() for t in got] == [e.ids for e in model.encode_batch(texts, add_special_tokens=False)]


def test_texts_that_are_not_utf8_keep_their_tokens(model):
    broken = [b"abc \xff\xfe d\xe9f, ok", b"\xc3", b"", b" \t", b"x\x80y z"]
    got = T.Words(T.vocabulary_path()).tokens(broken)
    assert [np.frombuffer(t, "<u4").tolist() for t in got] == [model.encode(t.decode("utf-8", "replace"), add_special_tokens=False).ids for t in broken]


def test_many_large_values_widen_a_block():
    values = np.arange(256) * 120 % 30_000
    values[::12] += 34_000  # 22 exceptions of ten bytes each take more than a bit a value
    data = T.pack(values)
    assert len(data) == 12 + 8 + 11 + 256 * 16 // 8 and T.unpack(memoryview(data))[0].tolist() == values.tolist()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 60), st.integers(-(2**63), 2**63 - 1)), max_size=700), st.integers(0, 700), st.integers(0, 700), st.sampled_from([7, 64, 256]))
def test_streams_round_trip_and_open_anywhere(values, a, b, block):
    data = b"xx" + T.pack(np.array(values, np.int64), block) + b"yy"
    got, end = T.unpack(memoryview(data), 2, block=block)
    assert got.tolist() == values and end == len(data) - 2
    assert T.unpack(memoryview(data), 2, a, b, block)[0].tolist() == values[a:b]


def test_few_large_values_do_not_widen_a_block():
    narrow = np.arange(1000, 1000 + 256) % 16 + 50
    spiked = narrow.copy()
    spiked[[3, 77, 200]] = 49_000
    assert len(T.pack(spiked)) == len(T.pack(narrow)) + 3 * 10  # a place and a value each
    assert len(T.pack(narrow)) < 256 // 2 + 40


def test_tokens_by_place_and_damage():
    tokens = np.random.default_rng(0).integers(0, 49_000, 5000)
    data = T.segment(3, 70, [None, 1, 9], [0, 4000, 1000], tokens)
    assert T.ids_at(data, 1234, 1300).tolist() == tokens[1234:1300].tolist()
    (task, start, ids, counts, values), = T.segments(data + b"\n")
    assert (task, start, ids, counts.tolist(), values.tolist()) == (3, 70, [None, 1, 9], [0, 4000, 1000], tokens.tolist())
    for broken in (data[:-1], b"X" + data[1:]):
        with pytest.raises(ValueError):
            list(T.segments(broken))

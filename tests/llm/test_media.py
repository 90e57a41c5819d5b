import hashlib
import random
import zlib

import pytest

from driftlab.llm import media

DOCS = "doc_id long, text string, extra int"


def test_round_trip_of_every_size_near_packet_edges():
    r = random.Random(1)
    for n in [*range(0, 600, 7), 8191, 8192, 8193, 70_000, 200_001]:
        payload = r.randbytes(n)
        d = media.demux(media.mux(payload))
        assert d["payload"] == payload and d["continuity_errors"] == 0
        assert d["random_access"] == [i % media.RAP_EVERY == 0 for i in range(d["units"])]
        assert d["pts"] == [media.PTS_FIRST + i * media.PTS_STEP for i in range(d["units"])]
        assert all(p is None or p == t - media.PCR_LEAD for p, t in zip(d["pcr"], d["pts"]))


def test_lost_packets_and_damage_are_seen():
    s = media.mux(bytes(20_000))
    lost = s[: 188 * 10] + s[188 * 11 :]
    d = media.demux(lost)
    assert (d["continuity_errors"], d["length_errors"], d["crc_errors"]) == (1, 1, 1)
    sixteen = media.demux(s[: 188 * 10] + s[188 * 26 :])  # the counters fit again
    assert (sixteen["continuity_errors"], sixteen["length_errors"], sixteen["crc_errors"]) == (0, 1, 1)
    assert media.demux(s[:-188])["length_errors"] == 1  # cut between two elementary packets
    bad = bytearray(s)
    bad[20] ^= 1  # in the PAT
    with pytest.raises(ValueError, match="CRC"):
        media.demux(bytes(bad))
    with pytest.raises(ValueError):
        media.demux(b"")


def test_query_columns(spark):
    texts = [None, "", "a", "é" * 40, "x" * 64, "long " * 30_000, "a"]
    docs = spark.createDataFrame([(i if i else None, t, 1) for i, t in enumerate(texts)], DOCS)
    rows = {(r.doc_id or 0): r for r in media.media_digests(media.media_table(docs)).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        pad = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-64:]))
        m = media.mux(pad)
        assert (r.media_bytes, r.media_sha256) == (len(m), hashlib.sha256(m).hexdigest())
    assert rows[2].feature == rows[6].feature
    assert media.media_digests(media.media_table(docs.limit(0))).count() == 0
    broken = spark.createDataFrame([(1, 2, None), (2, 2, bytearray(b"x" * 188))], "doc_id long, n_bytes long, media binary")
    assert all(r.payload_sha256 is None for r in media.media_digests(broken).collect())


def test_damaged_streams_are_read_or_refused():
    r = random.Random(7)
    whole = media.mux(r.randbytes(3_000))
    read = 0
    for k in range(30_000):
        s = bytearray(whole)
        for _ in range(r.randint(1, 3)):
            p = r.choice((0, 0, 1, 2, r.randrange(len(s) // 188))) * 188
            s[p + r.choice((1, 2, 3, 4, 4, 5, 6, 10, 12, 13, r.randrange(188)))] = r.choice((0, 183, 184, 200, 250, 255, r.randrange(256)))
        if k % 5 == 0:
            del s[188 * r.randrange(len(s) // 188) :][: 188 * r.randint(0, 3)]
        if k % 7 == 0:
            p = 188 * r.randrange(len(s) // 188)
            s[p : p + 188] = s[188 * r.randrange(len(s) // 188) :][:188]
        try:
            media.demux(bytes(s))
            read += 1
        except ValueError:
            pass
    assert 0 < read < 30_000
    bad = bytearray(media.mux(b"x" * 64))
    bad[3] |= 0x20
    bad[4] = 255
    with pytest.raises(ValueError, match="adaptation"):
        media.demux(bytes(bad))


def test_no_change_of_the_payload_is_silent():
    r = random.Random(11)
    payload = r.randbytes(30_000)
    whole = media.mux(payload)
    n = len(whole) // 188
    for k in range(10_000):
        s = bytearray(whole)
        if k % 4 == 0:  # any single bit
            at = r.randrange(len(s))
            s[at] ^= 1 << r.randrange(8)
        elif k % 4 == 1:  # up to 16 bits in a row
            at = r.randrange(len(s) - 2)
            s[at] ^= r.randrange(256)
            s[at + 1] ^= r.randrange(256)
        elif k % 4 == 2:  # packets lost, often as many as the counter counts
            at = 188 * r.randrange(n)
            del s[at : at + 188 * r.choice((1, 2, 16, 16, 32, 48))]
        else:  # a packet twice, or in another's place
            at, of = 188 * r.randrange(n), 188 * r.randrange(n)
            s[at : at + 188 * r.randint(0, 1)] = whole[of : of + 188]
        try:
            d = media.demux(bytes(s))
        except ValueError:
            continue
        assert d["payload"] == payload or d["continuity_errors"] + d["length_errors"] + d["crc_errors"] > 0, k


def test_crc_is_the_one_of_the_standard():
    def plain(data):  # bit by bit, as a shift register
        c = 0xFFFF
        for b in data:
            for i in range(7, -1, -1):
                c = (c << 1 ^ (0x1021 if (c >> 15 ^ b >> i) & 1 else 0)) & 0xFFFF
        return c

    for data in (b"", b"a", bytes(64), b"unit of some bytes"):
        assert media.unit_crc(data) == plain(data)
        assert plain(data + media.unit_crc(data).to_bytes(2, "big")) == 0


def test_damage_is_told_and_names_may_clash(spark):
    docs = spark.createDataFrame([(1, "a" * 20_000, b"x", "y"), (2, "b", None, None)], "doc_id long, text string, media binary, payload string")
    stored = {r.doc_id: r for r in media.media_table(docs).collect()}
    lost = bytes(stored[1].media[: 188 * 10] + stored[1].media[188 * 26 :])
    rows = spark.createDataFrame([(1, 20_000, bytearray(lost)), (2, 1, stored[2].media)], "doc_id long, n_bytes long, media binary")
    got = {r.doc_id: r for r in media.read_media(rows).collect()}
    assert got[1].payload is None and got[1].error == "damaged: length_errors 1, crc_errors 1" and got[1].units == 3
    assert got[2].error is None and bytes(got[2].payload) == b"b".ljust(64, b"\0")

"""Operator 9: media columns as MPEG transport streams (ISO/IEC 13818-1).

``media_table`` stores a byte payload losslessly: it is cut into units, each a PES packet with a presentation time and
the CRC of the unit before it, carried in 188-byte transport packets beside the program tables (PAT, PMT), which are
repeated at each random-access point; an empty PES packet at the end has the last unit's CRC. ``read_media`` reads the
stored bytes back: it parses the program tables (with their CRC), checks continuity counters, reassembles the PES
packets, compares their declared lengths and CRCs with what came, and lists timestamps and random-access points.

Defined results: a null or empty text is stored as 64 zero bytes (the padded payload is never empty); null ids,
repeated rows and ties are rows of their own; an empty table gives no rows; only the id and the text column are read,
so extra columns don't matter. A null stream, or one that can't be parsed, gives ``error`` and null values instead of a
failure. A stream with lost or changed bytes has its counts (``continuity_errors``, ``length_errors``, ``crc_errors``),
an ``error`` that names them, and no payload; ``demux`` itself hands out what came. A stream whose packets have CRCs must
end with the empty packet, or it counts as cut. Two units in which 16-bit CRCs agree by chance can't be told apart.
"""

from __future__ import annotations

from binascii import crc_hqx
from functools import lru_cache
from hashlib import sha256

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, in_arrow, table, text_chunks

SIZE, SYNC = 188, 0x47
PAT_PID, PMT_PID, DATA_PID, PROGRAM = 0x0000, 0x0100, 0x0101, 1
STREAM_TYPE, STREAM_ID = 0x06, 0xBD  # private data in PES packets
UNIT = 8192  # payload bytes of a PES packet
RAP_EVERY = 8  # units from one random-access point to the next
PTS_FIRST, PTS_STEP, PCR_LEAD = 126_000, 3_600, 63_000  # in 1/90000 s
PAD = 64
VIDEO = (0x01, 0x02, 0x1B, 0x24)  # the stream types whose PES packets may leave their length open


@lru_cache
def _crc_table() -> list[int]:
    out = []
    for n in range(256):
        c = n << 24
        for _ in range(8):
            c = ((c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        out.append(c)
    return out


def section_crc(data: bytes) -> int:
    c, t = 0xFFFFFFFF, _crc_table()
    for b in data:
        c = (c << 8 & 0xFFFFFFFF) ^ t[c >> 24 ^ b]
    return c


@lru_cache
def _section_packet(pid: int) -> bytes:
    if pid == PAT_PID:
        body = PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big")
        table_id, number = 0x00, 1
    else:
        body = (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([STREAM_TYPE]) + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00"
        table_id, number = 0x02, PROGRAM
    head = bytes([table_id]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\x00\x00"
    section = head + body
    section += section_crc(section).to_bytes(4, "big")
    packet = bytes([SYNC, 0x40 | pid >> 8, pid & 255, 0x10, 0]) + section
    return packet.ljust(SIZE, b"\xff")


def _pts_bytes(pts: int) -> bytes:
    return bytes([0x21 | pts >> 29 & 0x0E, pts >> 22 & 255, pts >> 14 & 0xFE | 1, pts >> 7 & 255, pts << 1 & 0xFE | 1])


def unit_crc(data: bytes) -> int:
    """previous_PES_packet_CRC: 16 bits of x^16 + x^12 + x^5 + 1 over a packet's data, from all ones."""
    return crc_hqx(data, 0xFFFF)


def _pes_head(size: int, flags: int, fields: bytes) -> bytes:
    return b"\x00\x00\x01" + bytes([STREAM_ID]) + (size + 3 + len(fields)).to_bytes(2, "big") + bytes([0x80, flags, len(fields)]) + fields


def _crc_field(pes: bytes) -> int | None:
    """The CRC of the packet before, if this one's header has it."""
    f = pes[7]
    if not f & 0x02:
        return None
    at = 9 + (0, 0, 5, 10)[f >> 6] + 6 * (f >> 5 & 1) + 3 * (f >> 4 & 1) + (f >> 3 & 1) + (f >> 2 & 1)
    if at + 2 > 9 + pes[8]:
        raise ValueError("an elementary packet whose header has no room for its fields")
    return int.from_bytes(pes[at : at + 2], "big")


def mux(payload: bytes) -> bytes:
    """A transport stream that carries the payload."""
    out, cc, tables = [], 0, 0
    for i, at in enumerate(range(0, max(1, len(payload)), UNIT)):
        rap = i % RAP_EVERY == 0
        if rap:
            for pid in (PAT_PID, PMT_PID):
                p = bytearray(_section_packet(pid))
                p[3] |= tables & 15
                out.append(bytes(p))
            tables += 1
        pts = (PTS_FIRST + i * PTS_STEP) & (1 << 33) - 1
        chunk = payload[at : at + UNIT]
        fields = _pts_bytes(pts) + (b"" if i == 0 else before.to_bytes(2, "big"))
        pes = np.frombuffer(_pes_head(len(chunk), 0x80 | 0x02 * (i > 0), fields) + chunk, np.uint8)
        before = unit_crc(chunk)
        first = min(len(pes), SIZE - 12)
        full, rest = divmod(len(pes) - first, SIZE - 4)
        n = 1 + full + (rest > 0)
        packets = np.full((n, SIZE), 0xFF, np.uint8)
        packets[:, 0] = SYNC
        packets[:, 1] = DATA_PID >> 8
        packets[:, 2] = DATA_PID & 255
        packets[:, 3] = 0x10 | (cc + np.arange(n)) & 15
        cc += n
        base = pts - PCR_LEAD
        packets[0, 1] |= 0x40
        packets[0, 3] |= 0x20
        packets[0, 4] = SIZE - 5 - first
        packets[0, 5] = 0x10 | 0x40 * rap
        packets[0, 6:12] = list((base << 15 | 0x7E00).to_bytes(6, "big"))
        packets[0, SIZE - first :] = pes[:first]
        packets[1 : 1 + full, 4:] = pes[first : first + full * (SIZE - 4)].reshape(full, SIZE - 4)
        if rest:
            packets[-1, 3] |= 0x20
            packets[-1, 4] = SIZE - 5 - rest
            packets[-1, 5 : 6 if rest < SIZE - 5 else 5] = 0
            packets[-1, SIZE - rest :] = pes[-rest:]
        out.append(packets.tobytes())
    last = _pes_head(0, 0x02, before.to_bytes(2, "big"))
    stuffing = SIZE - 5 - len(last)
    out.append(bytes([SYNC, 0x40 | DATA_PID >> 8, DATA_PID & 255, 0x30 | cc & 15, stuffing, 0]) + b"\xff" * (stuffing - 1) + last)
    return b"".join(out)


def _section(packet: bytes, offset: int, table_id: int) -> bytes:
    at = offset + 1 + packet[offset] if offset < SIZE else SIZE
    size = 3 + (int.from_bytes(packet[at + 1 : at + 3], "big") & 0x0FFF)
    section = packet[at : at + size]
    if len(section) < size or size < 12 or section[0] != table_id or section_crc(section):
        raise ValueError("program table with a wrong number, length or CRC")
    return section


@lru_cache(256)
def _programs(packet: bytes, offset: int) -> dict[int, int]:
    s = _section(packet, offset, 0x00)
    return {int.from_bytes(s[i : i + 2], "big"): int.from_bytes(s[i + 2 : i + 4], "big") & 0x1FFF for i in range(8, len(s) - 4, 4) if s[i : i + 2] != b"\0\0"}


@lru_cache(256)
def _streams(packet: bytes, offset: int) -> dict[int, int]:
    s = _section(packet, offset, 0x02)
    out, at = {}, 12 + (int.from_bytes(s[10:12], "big") & 0x0FFF)
    while at < len(s) - 4:
        out[int.from_bytes(s[at + 1 : at + 3], "big") & 0x1FFF] = s[at]
        at += 5 + (int.from_bytes(s[at + 3 : at + 5], "big") & 0x0FFF)
    return out


def demux(media: bytes) -> dict:
    """Payload, program tables, timestamps and random-access points of a transport stream with one program."""
    if not media or len(media) % SIZE:
        raise ValueError("not a whole number of transport packets")
    a = np.frombuffer(media, np.uint8).reshape(-1, SIZE)
    if (a[:, 0] != SYNC).any():
        raise ValueError("a packet without its sync byte")
    pid = (a[:, 1].astype(np.int32) & 0x1F) << 8 | a[:, 2]
    starts, control, cc = a[:, 1] & 0x40 != 0, a[:, 3] >> 4 & 3, a[:, 3] & 15
    adapted = control & 2 != 0
    offset = np.where(adapted, 5 + a[:, 4].astype(np.int32), 4)
    if (offset > SIZE).any():
        raise ValueError("an adaptation field that is longer than its packet")
    clear = lambda i: bytes([*a[i, :3].tolist(), a[i, 3] & 0xF0]) + a[i, 4:].tobytes()  # noqa: E731  without the counter, so equal tables are parsed once
    programs: dict[int, int] = {}
    for i in np.flatnonzero((pid == PAT_PID) & starts):
        programs |= _programs(clear(i), int(offset[i]))
    streams: dict[int, int] = {}
    for p in programs.values():
        for i in np.flatnonzero((pid == p) & starts):
            streams |= _streams(clear(i), int(offset[i]))
    if len(streams) != 1:
        raise ValueError(f"{len(streams)} elementary streams")
    (es, kind), errors = next(iter(streams.items())), 0
    for p in (PAT_PID, *programs.values(), es):
        own = cc[(pid == p) & (control & 1 != 0)].astype(np.int16)
        errors += int(((own[1:] - own[:-1]) % 16 != 1).sum())
    rows = np.flatnonzero((pid == es) & (control & 1 != 0))
    if not len(rows) or not starts[rows[0]]:
        raise ValueError("no start of an elementary packet")
    own, from_ = a[rows], offset[rows]
    data = own[np.arange(SIZE) >= from_[:, None]].tobytes()
    at = np.concatenate([[0], np.cumsum(SIZE - from_)])
    heads = np.flatnonzero(starts[rows])
    units, pts, rap, pcr = [], [], [], []
    lengths = crcs = 0
    checked = False
    for h, to in zip(heads, [*heads[1:], len(rows)]):
        pes = data[at[h] : at[to]]
        if pes[:3] != b"\0\0\1":
            raise ValueError("an elementary packet without its start code")
        if len(pes) < 9 or len(pes) < 9 + pes[8] or pes[7] & 0x80 and pes[8] < 5:
            raise ValueError("an elementary packet that is cut short")
        size, skip = int.from_bytes(pes[4:6], "big"), 9 + pes[8]
        if size or kind not in VIDEO:
            lengths += len(pes) != 6 + size
        crc = _crc_field(pes)
        if crc is not None:
            checked = True
            crcs += not units or crc != unit_crc(units[-1])
        units.append(pes[skip : 6 + size] if size else pes[skip:])
        p = pes[9:14]
        pts.append((p[0] >> 1 & 7) << 30 | p[1] << 22 | p[2] >> 1 << 15 | p[3] << 7 | p[4] >> 1 if pes[7] & 0x80 else None)
        k = own[h]
        has = bool(k[3] & 0x20) and k[4] > 0
        rap.append(bool(has and k[5] & 0x40))
        pcr.append(int.from_bytes(k[6:12].tobytes(), "big") >> 15 if has and k[5] & 0x10 else None)
    if checked and not units[-1] and pts[-1] is None:  # the closing packet is not a unit
        for x in (units, pts, rap, pcr):
            x.pop()
    elif checked:
        lengths += 1
    stuffing = int((from_ - 4).sum())
    return {"payload": b"".join(units), "programs": programs, "pid": es, "stream_type": kind, "packets": len(a), "units": len(units), "pts": pts, "pcr": pcr, "random_access": rap, "continuity_errors": errors, "length_errors": lengths, "crc_errors": crcs, "adaptation_bytes": stuffing}


def media_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each whole text as UTF-8, padded with zeros to a positive multiple of 64, as a stream."""

    def run(batches):
        import pyarrow as pa

        for rows, data, offsets in text_chunks(batches):
            raw, n = data.tobytes(), np.diff(offsets)
            media = [mux(raw[s:e].ljust(max(PAD, -(-(e - s) // PAD) * PAD), b"\0")) for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(n, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return in_arrow(source, run, "doc_id long, n_bytes long, media binary")


READ = "doc_id long, n_bytes long, media_bytes long, media_sha256 string, payload binary, program int, pid int, stream_type int, packets int, units int, pts array<long>, pcr array<long>, random_access array<boolean>, continuity_errors int, length_errors int, crc_errors int, adaptation_bytes int, error string"


def read_media(media: DataFrame) -> DataFrame:
    """Parses the column ``media``: payload, tables, a presentation time, clock and random-access flag for each unit."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            ids, n, streams = (batch.column(i) for i in range(3))
            out: list[tuple] = []
            held, at = 0, 0
            for k in range(batch.num_rows):
                x = streams[k].as_py()
                held += len(x or b"")
                try:
                    d = demux(x)
                    bad = {k: d[k] for k in ("continuity_errors", "length_errors", "crc_errors")}
                    damage = "damaged: " + ", ".join(f"{k} {v}" for k, v in bad.items() if v) if any(bad.values()) else None
                    out.append((len(x), sha256(x).hexdigest(), None if damage else d["payload"], next(iter(d["programs"])), d["pid"], d["stream_type"], d["packets"], d["units"], d["pts"], d["pcr"], d["random_access"], *bad.values(), d["adaptation_bytes"], damage))
                except ValueError as e:
                    out.append((*((len(x), sha256(x).hexdigest()) if x is not None else (None, None)), *[None] * 13, str(e)))
                if held >= 4 << 20 or k == batch.num_rows - 1:
                    cols = list(zip(*out))
                    kinds = [pa.int64(), pa.string(), pa.binary(), *[pa.int32()] * 5, pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.bool_()), *[pa.int32()] * 4, pa.string()]
                    yield pa.RecordBatch.from_arrays([ids.slice(at, k + 1 - at), n.slice(at, k + 1 - at), *[pa.array(c, t) for c, t in zip(cols, kinds)]], [x.split()[0] for x in READ.split(", ")])
                    out, held, at = [], 0, k + 1

    return in_arrow(media.select("doc_id", "n_bytes", "media"), run, READ)


def media_digests(media: DataFrame) -> DataFrame:
    """Digests of what is stored and of what is read back, and the stream's facts as one string."""
    points = F.array_compact(F.transform("random_access", lambda x, i: F.when(x, i.cast("string"))))
    facts = F.format_string(
        "ts/program=%d/pid=%d/type=%d/packets=%d/units=%d/pts=%d-%d/rap=%s/cc=%d/af=%d",
        "program", "pid", "stream_type", "packets", "units", F.get("pts", F.lit(0)), F.try_element_at("pts", F.lit(-1)), F.concat_ws(".", points), "continuity_errors", "adaptation_bytes",
    )
    return read_media(media).select(
        "doc_id", "n_bytes", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -PAD, PAD)).alias("tail_crc32"), "media_bytes", "media_sha256", F.coalesce("error", facts).alias("feature"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = cut(media_table(table(spark, sf_dir, "documents")), "media")
    return media_digests(stored)

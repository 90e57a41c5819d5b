"""Operator 5: WARC archives and their globally ordered capture index.

``write_warc`` writes one record per page with Spark's text sink: a record's header and block are text, and the line
separator is the blank line that ends each record, so any file system that Spark can write to will do. Archives are not
compressed, so an index entry's offset and length name a record's bytes. Payloads of at least ``MIN_REVISIT`` bytes that
occur more than once are stored once: the page with the largest id is the response, the others are revisits that refer
to it and name the payload's length. ``read_warc`` reads the archives back, record by record as their Content-Length
says, checks the digests and sorts each archive's captures by URL key and time: a sorted run.

``merge_runs`` merges the runs externally. Each run is cut into pieces of ``PIECE_ROWS`` captures, which are dealt out by
ranges of the order (their fences come from a bounded sample of the pieces' first keys) and sorted within a range by
their first keys; Spark shuffles, sorts and spills them as they are, packed. A task then streams them through a loser
tree: a piece is opened when the merge comes to its first key and closed when it is used up, so what is held are the
pieces that are open, one for each run that overlaps there, and not the range. The index is ordered within and across
partitions.

Defined results: a null html is an empty payload; a null URL has the key ''; line breaks in a URL are percent-encoded;
a null page id counts as less than any other and is read back as null; rows that share the largest page id of equal
payloads are all responses; repeated rows are records of their own; extra columns don't matter; an empty table
gives no records. A record that is cut short or whose payload has another digest raises ValueError.

Archives of other writers are read too: captures are the records of type response, resource and revisit, others
(warcinfo, request, metadata) are passed over; field names are read in any case, continued lines are joined, of a
repeated field the first counts; digests may be in base 16 or 32 or of another kind, then the index has the payload's
own SHA-1 (for revisits the digest as it stands); ids that are no page ids are null; a revisit may refer to nothing. Of
a chunked body the digest may be that of its content or that of its bytes; the payload is the bytes as they stand.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import hashlib
import math
import re
import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, cut, in_arrow, shared_dir, table

MIN_REVISIT = 1_000
#: (most bytes of a page, pages to a file): no archive has more than about 64 MB, but for a page that is longer by itself
FILES = ((32 << 10, 2_000), (1 << 20, 64), (1 << 31, 1))
PIECE_ROWS, RANGE_ROWS, FENCES, FENCE_CHARS = 500, 50_000, 20_000, 200
SALTS = 32
EPOCH = 1_577_836_800  # a page's capture time where no column has it: 2020-01-01 plus its id in seconds
LENGTH_FIELD = "X-Payload-Length"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_LEAST = -(1 << 63)


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit: int = MIN_REVISIT) -> None:
    """Writes archives into folders within path, one for each row of FILES that has pages."""
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.regexp_replace(F.regexp_replace(F.coalesce(F.col(url_col), F.lit("")), "\r", "%0D"), "\n", "%0A").alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary"))).withColumn("known", F.coalesce("id", F.lit(_LEAST)))
    again = rows.filter(F.octet_length("html") >= min_revisit).groupBy("digest").agg(F.max("known").alias("keeper"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    again = cut(again, "warc-again")
    if again.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        rows = rows.join(F.broadcast(again), "digest", "left")
    else:  # the pages move; those of a digest that many have are dealt out in parts
        again = again.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("known", "url"), F.lit(SALTS)).cast("int")).join(again, ["digest", "salt"], "left").drop("salt")
    rows = rows.withColumn("revisit", F.col("keeper") > F.col("known"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.when(c == _LEAST, F.lit("null")).otherwise(c.cast("string")), F.lit(">"))
    date = F.date_format(F.timestamp_seconds(F.lit(EPOCH) + F.coalesce(F.pmod("id", F.lit(1 << 30)), F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    body = F.when(F.col("revisit"), F.lit(HTTP)).otherwise(F.concat(F.lit(HTTP), F.col("html")))
    record = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(F.col("revisit"), F.lit("revisit")).otherwise(F.lit("response")),
        F.lit("\r\nWARC-Record-ID: "), urn(F.col("known")), F.lit("\r\nWARC-Date: "), date, F.lit("\r\nWARC-Target-URI: "), F.col("url"),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"),
        F.when(F.col("revisit"), F.concat(F.lit(f"\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), urn(F.col("keeper")), F.lit(f"\r\n{LENGTH_FIELD}: "), F.octet_length("html").cast("string"))).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body,
    )
    size = F.octet_length("html")
    kind = F.when(size <= FILES[0][0], F.lit(0)).when(size <= FILES[1][0], F.lit(1)).otherwise(F.lit(2))
    present = {r.kind for r in rows.groupBy(kind.alias("kind")).count().collect()} | {0}
    for k in sorted(present):
        rows.filter(kind == k).select(record.alias("value")).write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", FILES[k][1]).text(f"{path}/files-{k}")


def _unpacked(content: bytes) -> Iterator[bytes]:
    """content in parts; of a gzip-compressed archive what its members hold."""
    if content[:2] != b"\x1f\x8b":
        yield content
        return
    stream = zlib.decompressobj(31)
    for at in range(0, len(content), 65536):
        part = content[at : at + 65536]
        while part:
            yield stream.decompress(part)
            part = stream.unused_data
            if part:
                stream = zlib.decompressobj(31)


def _fields(lines: list[str]) -> dict[str, str]:
    """Header fields by their names in lower case: continued lines joined, of a repeated field the first."""
    held: list[str] = []
    for line in lines:
        if line[:1] in (" ", "\t") and held:
            held[-1] += " " + line.strip()
        else:
            held.append(line)
    out: dict[str, str] = {}
    for line in held:
        name, colon, value = line.partition(":")
        if colon:
            out.setdefault(name.strip().lower(), value.removeprefix(" "))  # a URL may end in spaces
    return out


def records(content: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, header, block) of each record of an archive, plain or gzip-compressed; one record is held at a time.

    Header fields have names in lower case. Positions are those in the plain archive.
    """
    parts, buffer, base, at = _unpacked(content), b"", 0, 0

    def more(n: int) -> bool:
        """Makes the buffer reach n bytes beyond at, if the archive does."""
        nonlocal buffer, base, at
        if len(buffer) - at >= n:
            return True
        held = [buffer[at:]]
        size = len(held[0])
        for part in parts:
            held.append(part)
            size += len(part)
            if size >= n:
                break
        base, at, buffer = base + at, 0, held[1] if len(held) == 2 and not held[0] else b"".join(held)
        return len(buffer) >= n

    while more(1):
        end, want = -1, 4096
        while (end := buffer.find(b"\r\n\r\n", at)) < 0:
            if not more(want := want * 2) and buffer.find(b"\r\n\r\n", at) < 0:
                raise ValueError("a record without the end of its header")
        head = buffer[at:end].decode("utf-8", "replace").split("\r\n")
        if not head[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        header = _fields(head[1:])
        skip, size = end + 4 - at, _number(header.get("content-length"))
        if size is None:
            raise ValueError("a record without its length")
        if not more(skip + size + 4) or buffer[at + skip + size : at + skip + size + 4] != b"\r\n\r\n":
            raise ValueError("a record that is cut short")
        yield base + at, skip + size + 4, header, buffer[at + skip : at + skip + size]
        at += skip + size + 4


def url_key(url: str) -> str:
    """The URL in sort order: host in lower case with its labels reversed, then path and query; no scheme, no fragment."""
    m = re.match(r"(?s)(?:[A-Za-z][A-Za-z0-9+.-]*://)?([^/?#]*)([^#]*)", url)
    return f"{','.join(reversed(m[1].lower().split('.')))}){m[2]}" if url else ""


INDEX = "url_key string, capture_time string, page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, archive string, offset long, length long"


def _number(x: str | None) -> int | None:
    return int(x) if x and re.fullmatch(r"\s*[0-9]+\s*", x) else None


def _page(urn: str | None) -> int | None:
    """The page that an id of write_warc names; null for ids of other writers."""
    m = re.fullmatch(r"<urn:page:(-?[0-9]{1,19})>", (urn or "").strip())
    return int(m[1]) if m and -(1 << 63) <= int(m[1]) < 1 << 63 else None


def _unchunked(body: bytes) -> bytes | None:
    """The content of a chunked body, None if it is not one."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        size = re.match(rb"[0-9A-Fa-f]+", body[at:end]) if end >= 0 else None
        if not size:
            return None
        n = int(size[0], 16)
        if n == 0:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + n])
        if body[end + 2 + n : end + 4 + n] != b"\r\n":
            return None
        at = end + 4 + n


def _hex_digest(digest: str | None) -> tuple[str, str] | None:
    """(kind, digits in base 16) of a digest in base 16 or 32; None where the digits don't fit a kind that can be checked."""
    kind, _, digits = (digest or "").partition(":")
    kind = kind.strip().lower().replace("-", "")
    if kind not in ("md5", "sha1", "sha256", "sha512"):
        return None
    n, digits = hashlib.new(kind).digest_size, digits.strip()
    if re.fullmatch(rf"[0-9A-Fa-f]{{{2 * n}}}", digits):
        return kind, digits.lower()
    try:
        raw = base64.b32decode(digits.rstrip("=").upper() + "=" * (-len(digits.rstrip("=")) % 8))
    except binascii.Error:
        return None
    return (kind, raw.hex()) if len(raw) == n else None


def _capture(archive: str, offset: int, length: int, h: dict[str, str], block: bytes) -> tuple | None:
    """The row of INDEX, and the payload, of a record; None if it is no capture."""
    kind = h.get("warc-type", "").strip().lower()
    if kind not in ("response", "resource", "revisit"):
        return None
    head, ends, rest = block.partition(b"\r\n\r\n")
    http = kind != "resource" and head.startswith(b"HTTP/")
    payload = (rest if ends else b"") if http else block
    stated, named = _hex_digest(h.get("warc-payload-digest")), h.get("warc-payload-digest")
    url, when, name = h.get("warc-target-uri", ""), h.get("warc-date", "").strip(), h.get("warc-record-id", "").strip()
    page = _page(name)
    if not name.startswith("<urn:page:"):  # other writers pad URLs and put them in brackets
        url = url.strip().removeprefix("<").removesuffix(">")
    if kind == "revisit":
        digest = stated[1] if stated and stated[0] == "sha1" else named
        return url_key(url), when, page, kind, _page(h.get("warc-refers-to")), _number(h.get(LENGTH_FIELD.lower())), digest, archive, offset, length, payload
    own = hashlib.sha1(payload).hexdigest()
    if stated:
        found = own if stated[0] == "sha1" else hashlib.new(stated[0], payload).hexdigest()
        if found != stated[1]:
            content = _unchunked(payload) if http and re.search(rb"(?i)\r\ntransfer-encoding:[^\r]*chunked", head) else None
            if content is None or hashlib.new(stated[0], content).hexdigest() != stated[1]:
                raise ValueError(f"{archive} at {offset}: the payload has another digest")
    return url_key(url), when, page, kind, None, len(payload), own, archive, offset, length, payload


def read_warc(spark: SparkSession, path: str, with_payload: bool = False, pattern: str = "{part-*,*.warc,*.warc.gz}") -> DataFrame:
    """The captures of all archives in path whose file names fit, each archive's as a sorted run; payload_bytes is null for revisits that don't name it (other writers')."""

    def run(batches):
        import pyarrow as pa

        names = [x.split()[0] for x in INDEX.split(", ")] + ["payload"] * with_payload
        kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()] + [pa.binary()] * with_payload
        for batch in batches:
            for archive, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                out = []
                for record in records(content.as_py()):
                    row = _capture(archive, *record)
                    if row:
                        out.append(row if with_payload else row[:-1])
                out.sort(key=_key)
                for i in range(0, len(out), 500):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[i : i + 500]), kinds)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select(F.regexp_extract("path", "[^/]+$", 0).alias("archive"), "content")
    return in_arrow(files, run, INDEX + ", payload binary" * with_payload)


def _key(row: tuple) -> tuple:
    return row[0], row[1], row[2] is not None, row[2] or 0, row[7], row[8]


class LoserTree:
    """Merges k sorted lists: each inner node holds the run that lost there, so a step compares once a level."""

    def __init__(self, runs: list[list[tuple]], key=_key):
        self.runs, self.key, self.k = runs, key, max(1, len(runs))
        self.at = [0] * self.k
        self.head = [self._load(i) for i in range(self.k)]
        self.tree = [-1] * self.k
        for i in range(self.k):
            self._play(i)

    def _load(self, i: int):
        done = i >= len(self.runs) or self.at[i] >= len(self.runs[i])
        return (1,) if done else (0, self.key(self.runs[i][self.at[i]]), i)

    def _play(self, winner: int) -> None:
        node = (winner + self.k) // 2
        while node:
            held = self.tree[node]
            if held < 0:  # the first to come waits for its opponent
                self.tree[node] = winner
                return
            if self.head[held] < self.head[winner]:
                self.tree[node], winner = winner, held
            node //= 2
        self.tree[0] = winner

    def least(self):
        """The key of the next row, None if there is none."""
        head = self.head[self.tree[0]]
        return head[1] if head[0] == 0 else None

    def pop(self) -> tuple:
        w = self.tree[0]
        row = self.runs[w][self.at[w]]
        self.at[w] += 1
        self.head[w] = self._load(w)
        self._play(w)
        return row

    def rest(self) -> list[list[tuple]]:
        """What is left of the runs that are not used up."""
        return [r[a:] for r, a in zip(self.runs, self.at) if a < len(r)]

    def __iter__(self) -> Iterator[tuple]:
        while self.head[self.tree[0]][0] == 0:
            yield self.pop()


def _pieces(index: DataFrame) -> DataFrame:
    """(url_key, capture_time, page_id, n, rows): the captures in pieces that are in order, with their first keys, packed as Arrow batches."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            keys = [_key(r) for r in zip(*(c.to_pylist() for c in batch.columns))]
            cuts = [0] + [i for i in range(1, len(keys)) if keys[i] < keys[i - 1]] + [len(keys)]
            starts = [i for a, b in zip(cuts, cuts[1:]) for i in range(a, b, PIECE_ROWS)]
            for s, e in zip(starts, [*starts[1:], len(keys)]):
                packed = pa.RecordBatch.from_struct_array(batch.slice(s, e - s).to_struct_array())
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(s, 1) for i in range(3)), pa.array([e - s]), pa.array([_pack(packed)])], ["url_key", "capture_time", "page_id", "n", "rows"])

    return in_arrow(index, run, "url_key string, capture_time string, page_id long, n long, rows binary")


def _pack(batch) -> bytes:
    import pyarrow as pa

    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpack(data: bytes):
    import pyarrow as pa

    return pa.ipc.open_stream(data).read_next_batch()


def _split(pieces: DataFrame, fences: list[tuple[str, str]]) -> DataFrame:
    """pieces cut at the fences, with the number of their range."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for data in batch.column(4):
                rows = _unpack(data.as_py())
                of = [bisect.bisect_right(fences, k) for k in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist())]
                starts = [i for i in range(len(of)) if i == 0 or of[i] != of[i - 1]]
                for s, e in zip(starts, [*starts[1:], len(of)]):
                    own = rows if e - s == len(of) else pa.RecordBatch.from_struct_array(rows.slice(s, e - s).to_struct_array())
                    yield pa.RecordBatch.from_arrays([pa.array([of[s]], pa.int32()), *(own.column(i).slice(0, 1) for i in range(3)), pa.array([_pack(own)])], ["range", "url_key", "capture_time", "page_id", "rows"])

    return in_arrow(pieces, run, "range int, url_key string, capture_time string, page_id long, rows binary")


def merge_runs(index: DataFrame) -> DataFrame:
    """The index, given as sorted runs, ordered by URL key, time and page across all partitions."""
    spark, columns, schema = index.sparkSession, index.columns, index.schema
    pieces = cut(_pieces(index), "warc-pieces")
    many = pieces.agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("pieces")).first()
    ranges = max(math.ceil((many.rows or 0) / RANGE_ROWS), min(int(spark.conf.get("spark.sql.shuffle.partitions")), many.pieces))
    drawn = pieces.select(F.substring("url_key", 1, FENCE_CHARS).alias("u"), "capture_time", F.xxhash64("url_key", "capture_time", "page_id").alias("draw")).orderBy("draw").limit(FENCES).collect()
    known = sorted((r.u, r.capture_time) for r in drawn)
    fences = sorted({known[i * len(known) // ranges] for i in range(1, ranges)}) if known else []
    names = [x.split()[0] for x in INDEX.split(", ")]

    def run(batches):
        import pyarrow as pa

        waiting = (_unpack(x.as_py()) for b in batches for x in b.column(4))
        coming, tree, held = next(waiting, None), LoserTree([]), []

        def packed():
            return pa.RecordBatch.from_arrays([pa.array(c, f) for c, f in zip(zip(*held), kinds)], names)

        kinds = [f.type for f in coming.schema] if coming else []
        while True:
            first = tree.least()
            opened = []
            while coming and (first is None or _key(_row(coming, 0))[:4] <= first[:4]):  # it begins where the merge is
                opened.append([_row(coming, i) for i in range(coming.num_rows)])
                coming = next(waiting, None)
                if first is None:
                    break
            if opened:
                tree = LoserTree([*tree.rest(), *opened])
                continue
            if first is None:
                break
            held.append(tree.pop())
            if len(held) == 1_000:
                yield packed()
                held.clear()
        if held:
            yield packed()

    dealt = _split(pieces, fences).repartitionByRange(max(1, len(fences) + 1), "range").sortWithinPartitions("range", "url_key", "capture_time", "page_id")
    return in_arrow(dealt, run, schema).select(*columns)


def _row(batch, i: int) -> tuple:
    return tuple(c[i].as_py() for c in batch.columns)


def capture_index(spark: SparkSession, path: str) -> DataFrame:
    """Reads the archives in path and merges their runs."""
    return merge_runs(cut(read_warc(spark, path), "warc-runs"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(table(spark, sf_dir, "pages"), path)
    return capture_index(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "capture_time")


SQL = rf"""
WITH p AS (
  SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS digest FROM pages),
k AS (SELECT digest, max(page_id) AS keeper FROM p WHERE strlen(html) >= {MIN_REVISIT} GROUP BY digest)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, p.digest AS payload_digest,
  CASE WHEN keeper > page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN keeper > page_id THEN keeper END AS refers_to,
  array_to_string(list_reverse(string_split(lower(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*://)?([^/?#]*)', 1)), '.')), ',') || ')' ||
    regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*://)?[^/?#]*([^#]*)', 1) AS url_key,
  strftime(make_timestamp(({EPOCH} + page_id) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS capture_time
FROM p LEFT JOIN k ON p.digest = k.digest"""

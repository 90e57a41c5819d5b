"""Token files: token ids of documents in patched frame-of-reference blocks.

A file is a run of segments; a segment holds whole documents in ascending order of their ids:

    header   "TOK1", bytes of the segment, task, place of the segment's first token within the task's, documents, documents
             without an id, tokens (little-endian, HEADER)
    streams  the documents' ids, their numbers of tokens, the tokens

A stream is a count, the number of blocks, the offset of each block from the first one, and the blocks. A block has BLOCK
values: their minimum, a width, the number of exceptions, all differences to the minimum packed at that width, then the
exceptions' places and their differences' higher bits. The width is that of the difference at PERCENTILE of the block, so that
few large values don't widen all. The index of block starts lets a reader decode only the blocks that it needs (ids_at).

Documents are dealt by ranges of their ids and sorted within; tasks tokenise, pack and write through Spark's text sink,
so that a lost task leaves no half file (a segment ends with the sink's line feed), and Spark reads the files back whole;
they hold SEGMENTS_A_FILE segments of about SEGMENT tokens, or one longer document. Words between white space are tokenised
alone and kept in caches of bounded size: the tokeniser drops white space, which no token or normal form crosses.

Nulls: a null text counts as empty, so it has the end id alone; null ids come first and stay null. Rows with the same id
follow each other by their texts' hashes, repeated rows each have tokens of their own. Very long texts are one segment. An
empty table gives no rows. Only the columns id and text are read, so extra ones can't clash.
"""

from __future__ import annotations

import functools
import re
import struct
import unicodedata
import uuid
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftlab.llm.common import cut, in_arrow, shared_dir, table

VOCABULARY, END = "word_bpe_49k.json", 2
BLOCK, PERCENTILE = 256, 0.9
SEGMENT, SEGMENTS_A_FILE = 1 << 18, 12
CACHED_WORDS, CACHED_BYTES = 500_000, 40  # of a generation of words (but for one piece's), and of a word
PIECE = 1 << 21
HEADER = struct.Struct("<4sQIQQQQ")
STREAM = struct.Struct("<QI")
BLOCK_HEAD = np.dtype([("least", "<i8"), ("width", "u1"), ("exceptions", "<u2")])
EXCEPTION = 10  # bytes of a place and of higher bits
SPACE = re.compile(rb"[ \t\n\r\x0b\x0c]")
KEEPS_CASE = (b"<|", b"\xcc", b"\xcd")  # special tokens; marks that join capitals and small letters differently
TAILS = b".,;:!?&%#$*()"  # punctuation that may follow letters as a piece of its own: not the apostrophe, nor what special tokens hold
WHOLE = re.compile("[\u03a3\u0130\u0530-\U0010ffff]")  # letters whose lower case differs by place or has more than one character, and those beyond Latin, Greek and Cyrillic


# --- patched frame-of-reference blocks -----------------------------------------------------------


def _bit_length(x: np.ndarray) -> np.ndarray:
    high = x >> np.uint64(32)  # halves fit a double
    top, low = (np.frexp(h.astype(np.float64))[1].astype(np.int64) for h in (high, x & np.uint64(0xFFFFFFFF)))
    return np.where(high > 0, top + 32, low)


def _lane(width: int) -> np.dtype:
    """The least unsigned integers that hold a width."""
    return np.dtype(f"<u{next(b for b in (1, 2, 4, 8) if 8 * b >= width)}")


def _in_eights(width: int, block: int) -> np.dtype | None:
    """Integers wide enough to shift a byte over a value, where eight values of a block fill ``width`` whole bytes; else None."""
    return None if block % 8 or not 0 < width <= 56 else np.dtype(np.uint32 if width <= 24 else np.uint64)


def _to_bytes(off: np.ndarray, width: int) -> np.ndarray:
    """Rows of values packed at a width, lowest bits first."""
    rows, block = off.shape
    if width in (8, 16, 32):
        return off.astype(_lane(width)).view(np.uint8)
    kind = _in_eights(width, block)
    if kind is None:
        lane = _lane(width)
        bits = np.unpackbits(off.astype(lane).view(np.uint8).reshape(-1, lane.itemsize), axis=1, count=width, bitorder="little")
        return np.packbits(bits.reshape(rows, -1), axis=1, bitorder="little")
    v = (off & off.dtype.type((1 << width) - 1)).astype(kind).reshape(rows, block // 8, 8)
    out = np.zeros((rows, block // 8, width), np.uint8)
    for j in range(width):  # a byte has bits of the values k that overlap it
        for k in range(8 * j // width, min(8, -(-8 * (j + 1) // width))):
            s = 8 * j - k * width
            out[:, :, j] |= (v[:, :, k] >> kind.type(s) if s >= 0 else v[:, :, k] << kind.type(-s)).astype(np.uint8)
    return out.reshape(rows, -1)


def _from_bytes(packed: np.ndarray, width: int, block: int) -> np.ndarray:
    rows = len(packed)
    if width in (8, 16, 32):
        return packed.view(_lane(width)).reshape(rows, block)
    kind = _in_eights(width, block)
    if kind is None:
        lane = _lane(width)
        wide = np.zeros((rows * block, 8 * lane.itemsize), np.uint8)
        wide[:, :width] = np.unpackbits(packed, axis=1, count=block * width, bitorder="little").reshape(-1, width)
        return np.packbits(wide, axis=1, bitorder="little").view(lane).reshape(rows, block)
    b = packed.reshape(rows, block // 8, width).astype(kind)
    out = np.zeros((rows, block // 8, 8), kind)
    for k in range(8):
        for j in range(k * width // 8, -(-(k + 1) * width // 8)):
            s = 8 * j - k * width
            out[:, :, k] |= b[:, :, j] << kind.type(s) if s >= 0 else b[:, :, j] >> kind.type(-s)
    return (out & kind.type((1 << width) - 1)).reshape(rows, block)


def pack(values: np.ndarray, block: int = BLOCK, percentile: float = PERCENTILE) -> bytes:
    """A stream of 64-bit integers."""
    values = np.asarray(values, np.int64)
    n = len(values)
    blocks = -(-n // block)
    if not n:
        return STREAM.pack(0, 0)
    padded = np.concatenate([values, np.full(blocks * block - n, values[-1])]).reshape(blocks, block)
    least = padded.min(axis=1)
    if int(values.max()) - int(values.min()) < 1 << 32:
        off = (padded - least[:, None]).astype(np.uint32)
    else:
        off = padded.astype(np.uint64) - least.astype(np.uint64)[:, None]  # differences wrap as they should
    kind, most = off.dtype.type, 8 * off.itemsize
    at = min(block - 1, int(percentile * block))
    width = _bit_length(np.partition(off, at, axis=1)[:, at].astype(np.uint64))
    over = (off >> np.minimum(width, most - 1).astype(kind)[:, None] > 0) & (width < most)[:, None]
    widest = _bit_length(off.max(axis=1).astype(np.uint64))
    whole = (block * widest + 7) // 8 < (block * width + 7) // 8 + EXCEPTION * over.sum(axis=1)
    width = np.where(whole, widest, width)
    over[whole] = False
    body: list[bytes] = [b""] * blocks
    for w in np.unique(width):  # all blocks of a width at once
        own = np.flatnonzero(width == w)
        if w:
            for i, row in zip(own, _to_bytes(off[own], int(w))):
                body[i] = row.tobytes()
    exceptions = over.sum(axis=1)
    block_of, place = np.nonzero(over)
    high = off[block_of, place] >> width[block_of].astype(kind)
    ends = np.cumsum(exceptions)
    heads = np.empty(blocks, BLOCK_HEAD)
    heads["least"], heads["width"], heads["exceptions"] = least, width, exceptions
    out = []
    for i in range(blocks):
        a, b = ends[i] - exceptions[i], ends[i]
        out.append(heads[i].tobytes() + body[i] + place[a:b].astype("<u2").tobytes() + high[a:b].astype("<u8").tobytes())
    starts = np.cumsum([0, *map(len, out[:-1])]).astype("<u8")
    return STREAM.pack(n, blocks) + starts.tobytes() + b"".join(out)


def unpack(data: memoryview, at: int = 0, first: int = 0, last: int | None = None, block: int = BLOCK) -> tuple[np.ndarray, int]:
    """Values of the stream at ``at`` from place ``first`` up to ``last``, of whose blocks alone it reads, and where the stream ends."""
    n, blocks = STREAM.unpack_from(data, at)
    at += STREAM.size
    starts = np.frombuffer(data, "<u8", blocks, at).astype(np.int64) + at + 8 * blocks
    if not blocks:
        return np.zeros(0, np.int64), at
    last = n if last is None else min(last, n)

    def head(i):
        return np.frombuffer(data, BLOCK_HEAD, 1, int(starts[i]))[0]

    def sizes(h):
        return (block * h["width"].astype(np.int64) + 7) // 8

    tail = head(blocks - 1)
    end = int(starts[-1]) + BLOCK_HEAD.itemsize + int(sizes(tail)) + EXCEPTION * int(tail["exceptions"])
    lo, hi = first // block, -(-last // block)
    if first >= last:
        return np.zeros(0, np.int64), end
    raw = np.frombuffer(data, np.uint8)
    heads = raw[starts[lo:hi, None] + np.arange(BLOCK_HEAD.itemsize)].copy().view(BLOCK_HEAD).ravel()
    off = np.zeros((hi - lo, block), np.uint64)
    body = starts[lo:hi] + BLOCK_HEAD.itemsize
    for w in np.unique(heads["width"]):
        own = np.flatnonzero(heads["width"] == w)
        if w:
            size = (block * int(w) + 7) // 8
            packed = np.frombuffer(b"".join([data[at : at + size] for at in body[own].tolist()]), np.uint8)
            off[own] = _from_bytes(packed.reshape(len(own), size), int(w), block)
    ends = body + sizes(heads)
    for i in np.flatnonzero(heads["exceptions"]):
        k, p = int(heads["exceptions"][i]), int(ends[i])
        off[i, np.frombuffer(data, "<u2", k, p)] |= np.frombuffer(data, "<u8", k, p + 2 * k) << np.uint64(heads["width"][i])
    values = (off + heads["least"].astype(np.uint64)[:, None]).astype(np.int64).ravel()
    return values[first - lo * block : last - lo * block], end


# --- segments ----------------------------------------------------------------------------------


def segment(task: int, start: int, ids: list, counts: list[int], tokens: np.ndarray) -> bytes:
    """The bytes of a segment; documents without an id come first."""
    known = [i for i in ids if i is not None]
    body = pack(np.array(known, np.int64)) + pack(np.array(counts, np.int64)) + pack(tokens)
    return HEADER.pack(b"TOK1", HEADER.size + len(body), task, start, len(ids), len(ids) - len(known), len(tokens)) + body


def segments(content: bytes):
    """(task, start, ids, counts, tokens) of each segment of a file."""
    data, at = memoryview(content), 0
    while at < len(data):
        magic, size, task, start, documents, unknown, tokens = HEADER.unpack_from(data, at)
        if magic != b"TOK1" or at + size > len(data):
            raise ValueError(f"not a segment at {at}")
        own = data[at : at + size]
        ids, p = unpack(own, HEADER.size)
        counts, p = unpack(own, p)
        values, p = unpack(own, p)
        if p != size or len(values) != tokens or len(counts) != documents or int(counts.sum()) != tokens:
            raise ValueError(f"a damaged segment at {at}")
        yield task, start, [None] * unknown + ids.tolist(), counts, values
        at += size + 1  # the sink's line feed


def ids_at(content: bytes, first: int, last: int) -> np.ndarray:
    """The tokens from place first up to last of a file's first segment: only the blocks that hold them are decoded."""
    data = memoryview(content)
    p = HEADER.size
    for _ in range(2):
        _, p = unpack(data, p, 0, 0)
    return unpack(data, p, first, last)[0]


# --- words to tokens -----------------------------------------------------------------------------


class Words:
    """Texts to tokens, through words that are kept with their tokens (little-endian 32-bit integers) in two generations.

    A word is what stands between ASCII white space, in UTF-8. Arrow cuts a lot of texts into words and numbers the different
    ones, so that the table is asked once a lot for each, and their tokens are laid out by those numbers. Letters before
    punctuation are a piece of their own, whose case doesn't matter; the vocabulary's model takes those not met before as they
    are, without looking for pieces in them, and each ends with a token that ends words.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.model = Tokenizer.from_file(path)
        self.pairs = self.model.model  # the tokeniser without normal form and search for pieces
        self.as_letters = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.new, self.old = {}, {}
        ends = [i for t, i in self.model.get_vocab(with_added_tokens=False).items() if t.endswith("</w>")]
        self.ends = np.zeros(self.model.get_vocab_size(), bool)
        self.ends[ends] = True

    def tokens(self, texts: list[bytes]) -> list[bytes]:
        """The tokens of each text; texts of about PIECE together, or pieces of a longer one, are looked up in one go."""
        out: list[list[bytes]] = [[] for _ in texts]
        lot, size = [], 0
        for i, text in enumerate(texts):
            if not any(x in text for x in KEEPS_CASE):
                text = text.lower()  # ASCII letters, as the tokeniser does it later
            at = 0
            while at < len(text):
                cut = SPACE.search(text, at + PIECE) if len(text) - at > PIECE else None
                to = cut.start() if cut else len(text)
                lot.append((i, text[at:to]))
                size += to - at
                at = to
                if size >= PIECE:
                    self._look_up(lot, out)
                    lot, size = [], 0
        if lot:
            self._look_up(lot, out)
        return [x[0] if len(x) == 1 else b"".join(x) for x in out]

    def _look_up(self, lot: list[tuple[int, bytes]], out: list[list[bytes]]) -> None:
        import pyarrow as pa
        import pyarrow.compute as pc

        own = pc.ascii_split_whitespace(pa.array([t for _, t in lot], pa.binary()).view(pa.string()))
        numbered = own.values.dictionary_encode()
        words = numbered.dictionary.view(pa.binary()).to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.new.get, words))
        if None in found:
            places = [i for i, t in enumerate(found) if t is None]
            known = self._learn([words[i] for i in places])
            for i in places:
                found[i] = known[words[i]]
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        number = numbered.indices.to_numpy()
        counts = sizes[number]
        ends = np.cumsum(counts)
        at = np.repeat((np.cumsum(sizes) - sizes)[number] - ends + counts, counts)
        at += np.arange(len(at))
        data = np.frombuffer(b"".join(found), "<u4")[at].tobytes()
        to = [0, *(4 * ends[own.offsets.to_numpy()[1:] - 1]).tolist()]  # a text has a word at least, be it empty
        for (i, _), a, b in zip(lot, to, to[1:]):
            out[i].append(data[a:b])

    def _learn(self, words: list[bytes]) -> dict[bytes, bytes]:
        """The tokens of words that the new generation doesn't have, which it then has but for long ones."""
        known, old, new = {}, self.old, self.new
        if old:
            known = {w: t for w, t in zip(words, map(old.get, words)) if t is not None}
            words = [w for w in words if w not in known]
        plain = [w for w in words if w.isalpha() and w.islower()]  # ASCII letters
        known |= zip(plain, self._pieces(b" ".join(plain).decode().split()))
        whole, cut, pieces, tails, other = [], [], [], [], []  # flat lists: tuples would set off the collector of cycles
        for w in words:
            if w in known:
                continue
            letters = w.rstrip(TAILS)
            if letters.isalpha():
                piece = letters.lower()
            else:
                text = letters.decode("utf-8", "replace")
                if not text.isalpha() or WHOLE.search(text):
                    whole.append(w)
                    continue
                piece = text.lower().encode()
                if piece == w:
                    other.append(w)
                    continue
            cut.append(w)
            pieces.append(piece)
            tails.append(w[len(letters) :])
        known |= zip(other, self._pieces(self._letters(other)))
        need = set()
        for p in pieces:
            if p not in known:
                t = new.get(p) or old.get(p)
                if t is None:
                    need.add(p)
                else:
                    known[p] = t
        need = list(need)
        known |= zip(need, self._pieces(self._letters(need)))
        whole += {t for t in tails if t and t not in known}
        known |= {w: np.array(i, "<u4").tobytes() for w, i in zip(whole, self._ids(whole) if whole else ())}
        for w, p, t in zip(cut, pieces, tails):
            known[w] = known[p] + known[t] if t else known[p]
        if len(new) + len(known) > CACHED_WORDS:
            self.new, self.old = {}, new
        self.new.update(known if max(map(len, known), default=0) <= CACHED_BYTES else {w: t for w, t in known.items() if len(w) <= CACHED_BYTES})
        return known

    def _letters(self, pieces: list[bytes]) -> list[str]:
        """Pieces in normal form, as the vocabulary writes their bytes; it writes a blank as a letter that is none of theirs."""
        if not pieces:
            return []
        (text, _), = self.as_letters.pre_tokenize_str(unicodedata.normalize("NFC", b" ".join(pieces).decode()).lower())
        (blank, _), = self.as_letters.pre_tokenize_str(" ")
        return text.split(blank)

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        """The tokens of pieces that are in normal form."""
        ids = np.array([t.id for p in pieces for t in self.pairs.tokenize(p)], "<u4")
        last = (np.flatnonzero(self.ends[ids]) + 1).tolist()
        if len(last) != len(pieces):
            raise ValueError("the vocabulary doesn't end each word with a token of its own")
        data = ids.tobytes()
        return [data[4 * a : 4 * b] for a, b in zip([0, *last], last)]

    def _ids(self, texts: list[bytes]) -> list[list[int]]:
        return [e.ids for e in self.model.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)]


@functools.cache
def words_of_worker(path: str) -> Words:
    """One for all tasks that a worker runs."""
    return Words(path)


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# --- files ---------------------------------------------------------------------------------------


def write(df: DataFrame, path: str, id: str = "doc_id", text: str = "text", vocabulary: str | None = None, end: int = END, size: int = SEGMENT) -> None:
    """The token files of df's texts in ascending order of their ids, below path."""
    vocabulary = vocabulary or vocabulary_path()
    ordered = df.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("hash"), F.monotonically_increasing_id().alias("row"))
    keys = [F.col(c).asc_nulls_first() for c in ("id", "hash", "row")]
    ordered = ordered.repartitionByRange(*keys).sortWithinPartitions(*keys).select("id", "text")

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        task, words, start, stop = TaskContext.get().partitionId(), words_of_worker(vocabulary), 0, np.array([end], "<u4").tobytes()
        ids, counts, parts, held = [], [], [], 0

        def full():
            made = segment(task, start, ids, counts, np.frombuffer(b"".join(parts), "<u4"))
            return pa.RecordBatch.from_arrays([pa.array([made], pa.binary())], ["segment"])

        for b in batches:
            texts = [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in b.column(1)]
            for i, tokens in zip(b.column(0).to_pylist(), words.tokens(texts)):
                tokens += stop
                n = len(tokens) // 4
                if held and held + n > size:
                    yield full()
                    start += held
                    ids, counts, parts, held = [], [], [], 0
                ids.append(i)
                counts.append(n)
                parts.append(tokens)
                held += n
        if held:
            yield full()

    made = in_arrow(ordered, run, "segment binary")
    made.select(F.col("segment").cast("string")).write.option("maxRecordsPerFile", SEGMENTS_A_FILE).option("compression", "none").text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(task, at, doc_id, n_tokens, ids_crc32) of each document of the files: its first token is the at-th of the task that wrote it."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for content in b.column(0):
                for task, start, ids, counts, values in segments(content.as_buffer()):
                    ends = np.cumsum(counts)
                    data = memoryview(values.astype("<u4").tobytes())
                    crc = [zlib.crc32(data[4 * (e - n) : 4 * e]) for n, e in zip(counts.tolist(), ends.tolist())]
                    made = [pa.array(np.full(len(ids), task, np.int32)), pa.array(start + ends - counts), pa.array(ids, pa.int64()), pa.array(counts), pa.array(crc, pa.int64())]
                    yield pa.RecordBatch.from_arrays(made, ["task", "at", "doc_id", "n_tokens", "ids_crc32"])

    files = spark.read.format("binaryFile").load(path).select("content")
    return in_arrow(files, run, "task int, at long, doc_id long, n_tokens long, ids_crc32 long")


def positions(found: DataFrame) -> DataFrame:
    """read()'s rows with start, the tokens of all documents before: what earlier tasks wrote, a row a task, and the place within the own task's."""
    per = found.groupBy("task").agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1))  # one row a task
    starts = per.select("task", F.coalesce(before, F.lit(0)).alias("before"))
    return found.join(F.broadcast(starts), "task").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write(table(spark, sf_dir, "documents"), path)
    return positions(cut(read(spark, path), "token-rows"))

"""Helpers that several operators share."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a temporary one only in local mode, where none need be set."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="driftlab-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lost executors then cost a reread, not the lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


BROADCAST_IDS = 500_000


def only(df: DataFrame, ids: DataFrame, on: str | list[str], how: str) -> DataFrame:
    """A semi or anti join whose ids are sent to all executors if they are few enough, and shuffled with df if not."""
    return df.join(F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids, on, how)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like names that df does not have yet, in any case."""
    have, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in have:
            n += "_"
        have.add(n.lower())
        out.append(n)
    return out


# --- batches of texts --------------------------------------------------------------------------

CHUNK_BYTES = 1 << 20
ARROW_ROWS, ARROW_BYTES = 1_000, 8 << 20


def bounded_batches(df: DataFrame) -> DataFrame:
    """df, once its session hands Arrow functions batches of at most ARROW_ROWS rows or about ARROW_BYTES; lower settings stay."""
    conf = df.sparkSession.conf
    for name, most in (("maxRecordsPerBatch", ARROW_ROWS), ("maxBytesPerBatch", ARROW_BYTES)):
        name = f"spark.sql.execution.arrow.{name}"
        now = _bytes(conf.get(name, None))
        if not 0 < now <= most:
            conf.set(name, str(most))
    return df


def _bytes(setting: str | None) -> int:
    m = re.fullmatch(r"(\d+)\s*([kmgt]?)b?", (setting or "0").strip().lower())
    return int(m[1]) << " kmgt".index(m[2] or " ") * 10 if m else 0


def in_arrow(df: DataFrame, run: Callable[[Iterator], Iterator], schema) -> DataFrame:
    """df.mapInArrow in bounded batches, after which a worker gives back the memory that it has no more use for.

    Workers are used again by later tasks and stand beside an executor's heap; what one stage needed must not stay theirs.
    """

    def held(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return bounded_batches(df).mapInArrow(held, schema)


def give_back() -> None:
    """Unused memory of Arrow's pool and of the C library goes back to the system."""
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim:
        trim(0)


def text_chunks(batches, column: str = "text", most: int = CHUNK_BYTES, lower: bool = False):
    """(rows, data, offsets) of Arrow batches, cut so that data holds about ``most`` bytes, or one longer text.

    data: UTF-8 bytes of the texts (or of their lower case) end to end, null as empty; offsets: one more than rows.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column(batch.schema.get_field_index(column))
        if texts.null_count:
            texts = pc.fill_null(texts, "")
        texts = pc.utf8_lower(texts.cast(pa.large_string())) if lower else texts.cast(pa.large_string())
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + most, "right")))
            part = texts.slice(at, to - at)
            offsets = np.frombuffer(part.buffers()[1], np.int64)[part.offset : part.offset + len(part) + 1]
            values = part.buffers()[2]
            data = np.frombuffer(values, np.uint8)[offsets[0] : offsets[-1]] if values is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
            yield batch.slice(at, to - at), data, offsets - offsets[0]
            at = to


# --- word and shingle hashes -------------------------------------------------------------------

_P = np.uint64(0x9E3779B97F4A7C15)
_WORD = np.zeros(256, bool)  # bytes of words: 0-9, a-z and all of UTF-8's multi-byte sequences
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        p = np.full(1 << (n - 1).bit_length(), _P, np.uint64)
        p[0] = 1
        _powers = np.multiply.accumulate(p)
    return _powers[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit over all others."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def words_of(data: np.ndarray, offsets: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and 64-bit hashes of the words in lower-case UTF-8 data; no word crosses one of the offsets."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64)
    inside = _WORD[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    if offsets is not None:
        cuts = offsets[offsets < len(data)]
        first[cuts] = inside[cuts]
    starts = np.flatnonzero(first)
    at = np.flatnonzero(inside)
    if not len(starts):
        return starts, starts, np.zeros(0, np.uint64)
    begins = np.searchsorted(at, starts)
    lengths = np.diff(begins, append=len(at))
    place = np.arange(len(at)) - np.repeat(begins, lengths)
    parts = (data[at].astype(np.uint64) + np.uint64(1)) * powers(int(lengths.max()))[place]
    return starts, starts + lengths, mix64(np.add.reduceat(parts, begins) + lengths.astype(np.uint64))


def lower_bytes(text: str | None) -> np.ndarray:
    """UTF-8 bytes of the lower case as text_chunks makes it: str.lower() has other ones for U+0130 and a final sigma."""
    import pyarrow as pa
    import pyarrow.compute as pc

    return np.frombuffer(pc.utf8_lower(pa.scalar((text or "").encode("utf-8", "replace").decode(), pa.large_string())).as_buffer(), np.uint8)


def word_hashes(text: str | None) -> np.ndarray:
    return words_of(lower_bytes(text))[2]


def shingle_hashes(words: np.ndarray, k: int = 5) -> np.ndarray:
    """Hashes of all runs of k words, in order; a text of 1 to k-1 words is one shingle."""
    if not len(words):
        return words
    k = min(k, len(words))
    out = np.zeros(len(words) - k + 1, np.uint64)
    for j in range(k):
        out = out * _P + words[j : len(words) - k + 1 + j]
    return mix64(out)


def crc32_fold(id_col) -> F.Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4

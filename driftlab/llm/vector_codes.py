"""Vector code compression: product quantisation whose nearest entries a VA-file finds.

Components become integers, floor(scale * x); a vector is cut into equal consecutive parts, and each part position has a
codebook of its own. The codebooks start as the parts of the vectors with the smallest ids and are moved to the floored
means of the parts that they are nearest to, a fixed number of rounds.

The nearest entry is found as in a VA-file: every coordinate of an entry is bit-quantised into one of 2^bits cells; a
query's lookup tables say how near and how far each cell can be, whose sums bound the distance to every entry from both
sides; only entries whose lower bound is within the least upper bound are refined with integer distances.

Nulls: rows whose vector is null or holds null or non-finite components are dropped; null ids rank after all others, and
null labels are one label. Vectors without components, of another length than the most frequent one (ties: the
longer one), of a length that ``parts`` doesn't divide, or with components so large that a long can't hold
their distances (limit()): they stay with a null code and error, and take no part in codebooks. Ties go to the entry with
the lower index; rows with the same id rank by their vectors. Repeated rows each count; a label_error beyond a long is null. An empty table gives an empty
result (codebooks without entries). Only the columns id, vector and label are read, so extra ones can't clash.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlab.llm.common import cut, in_arrow, table

PARTS, ENTRIES, SCALE, ROUNDS, CELL_BITS = 16, 64, 256, 2, 3
BROADCAST_LABELS = 100_000
SALTS = 32


def limit(width: int) -> float:
    """Integer components below this in size have squared distances under 2^62."""
    return (2.0**60 / max(1, width)) ** 0.5


def integer_rows(column, scale: float, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(kept, whole, x) of an Arrow list column: rows without null or non-finite components, those of them that have ``width`` small enough integers, and these.

    x: int64, a row for each true value of whole.
    """
    import pyarrow as pa

    column = column.cast(pa.list_(pa.float64()))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    lengths = np.nan_to_num(np.asarray(column.value_lengths().to_numpy(zero_copy_only=False), np.float64)).astype(np.int64)
    there = column.is_valid().to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    kept = there & (bad[ends] == bad[ends - lengths])
    whole = kept & (lengths == width)
    x = np.floor(flat[np.repeat(whole, lengths)] * scale).reshape(int(whole.sum()), max(0, width))
    small = (np.abs(x) < limit(width)).all(axis=1)
    whole[np.flatnonzero(whole)[~small]] = False
    return kept, whole, x[small].astype(np.int64)


class VAFile:
    """Entries with small integer coordinates, bit-quantised into cells."""

    def __init__(self, entries: np.ndarray, bits: int = CELL_BITS):
        self.entries = np.asarray(entries, np.int64)
        k, d = self.entries.shape
        self.cell = np.zeros((d, k), np.int64)  # of each coordinate of each entry
        self.low, self.high = [], []  # a dimension's cells: the least and the largest coordinate in them
        for j in range(d):
            at = self.entries[:, j]
            fences = np.sort(at)[np.arange(1, 1 << bits) * k >> bits]  # cells hold about as many entries each
            used, self.cell[j] = np.unique(np.searchsorted(fences, at, "right"), return_inverse=True)
            self.low.append(np.array([at[self.cell[j] == c].min() for c in range(len(used))], np.int64))
            self.high.append(np.array([at[self.cell[j] == c].max() for c in range(len(used))], np.int64))

    def candidates(self, queries: np.ndarray) -> np.ndarray:
        """(entries, queries): whether an entry's lower bound is within the query's least upper bound."""
        k, n = len(self.entries), len(queries)
        nearest, farthest = np.zeros((k, n), np.int64), np.zeros((k, n), np.int64)
        for j, (low, high) in enumerate(zip(self.low, self.high)):
            to_low, to_high = low[:, None] - queries[None, :, j], queries[None, :, j] - high[:, None]
            table_low = np.maximum(np.maximum(to_low, to_high), 0) ** 2  # a query's lookup tables, a row for each cell
            table_high = np.maximum(np.abs(to_low), np.abs(to_high)) ** 2
            nearest += table_low[self.cell[j]]
            farthest += table_high[self.cell[j]]
        return nearest <= farthest.min(axis=0)

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of each query's nearest entry; ties to the lower index."""
        found = self.candidates(queries)
        entry, query = np.nonzero(found)
        exact = np.full(found.shape, np.iinfo(np.int64).max)
        exact[entry, query] = ((queries[query] - self.entries[entry]) ** 2).sum(axis=1)
        best = exact.argmin(axis=0)
        return best, exact[best, np.arange(len(queries))]


def _width(df: DataFrame, vector: str, parts: int) -> int:
    """The most frequent length among vectors that parts can be cut of; 0 if there is none."""
    n = F.size(vector)
    top = df.filter(F.col(vector).isNotNull() & (n > 0) & (n % parts == 0)).groupBy(n.alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return top["n"] if top else 0


def _first(df: DataFrame, id: str, vector: str, width: int, entries: int, scale: float) -> np.ndarray:
    """Integers of the vectors with the smallest ids: each batch hands on ``entries`` rows at most, Spark ranks those."""
    kind = dict(df.dtypes)[id]

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for b in batches:
            _, whole, x = integer_rows(b.column(1), scale, width)
            ids = b.column(0).filter(pa.array(whole))
            rows = pa.Table.from_arrays([ids, pa.array(list(x), pa.list_(pa.int64()))], ["id", "x"])
            at = pc.sort_indices(ids, null_placement="at_end")
            if len(at) > entries:  # rows that tie with the last one stay, so that the vectors decide
                last = ids[at[entries - 1].as_py()]
                keep = pc.less_equal(ids, last) if last.is_valid else pa.array([True] * len(ids))
                rows = rows.filter(pc.fill_null(keep, False))
            yield from rows.to_batches()

    rows = in_arrow(df.select(id, vector), run, f"id {kind}, x array<long>")
    top = rows.orderBy(F.col("id").asc_nulls_last(), "x").limit(entries).collect()  # as many as a codebook has entries
    return np.array([r["x"] for r in top], np.int64).reshape(len(top), width)


def _files(books: np.ndarray) -> list[VAFile]:
    return [VAFile(b) for b in books]


def _moved(df: DataFrame, vector: str, books: np.ndarray, scale: float) -> np.ndarray:
    """books after one round: each task sums up the parts nearest to each entry, Spark adds the sums of all tasks."""
    parts, k, d = books.shape

    def run(batches):
        import pyarrow as pa

        files = _files(books)
        n, sums = np.zeros((parts, k), np.int64), np.zeros((parts, k, d), np.int64)
        for b in batches:
            _, _, x = integer_rows(b.column(0), scale, parts * d)
            for p, f in enumerate(files if len(x) else ()):
                own = x[:, p * d : (p + 1) * d]
                best, _ = f.nearest(own)
                n[p] += np.bincount(best, minlength=k)
                for j in range(d):  # exact: a batch's sums stay far under 2^53
                    sums[p, :, j] += np.bincount(best, weights=own[:, j], minlength=k).astype(np.int64)
        at = np.argwhere(n)
        p, e = at[:, 0].astype(np.int32), at[:, 1].astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(e), pa.array(n[p, e]), pa.array(list(sums[p, e]), pa.list_(pa.int64()))], ["part", "entry", "n", "sums"])

    rows = in_arrow(df.select(vector), run, "part int, entry int, n long, sums array<long>")
    total = rows.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.get("sums", F.lit(j))).alias(f"s{j}") for j in range(d)])
    out = books.copy()
    for r in total.collect():  # a row for each entry of a codebook
        out[r["part"], r["entry"]] = [r[f"s{j}"] // r["n"] for j in range(d)]
    return out


def train(df: DataFrame, id: str = "vec_id", vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, scale: float = SCALE, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (part, entry, place) of all rows of df; there are fewer entries if df has fewer vectors."""
    width = _width(df, vector, parts)
    first = _first(df, id, vector, width, entries, scale) if width else np.zeros((0, 0), np.int64)
    books = np.stack(np.split(first, parts, axis=1)) if len(first) else np.zeros((parts, 0, width // parts), np.int64)
    for _ in range(rounds if len(first) else 0):
        books = _moved(df, vector, books, scale)
    return books


def encode(df: DataFrame, books: np.ndarray, keep: list[str], vector: str = "embedding", scale: float = SCALE) -> DataFrame:
    """The columns ``keep`` with code (two hex digits a part) and error (squared distances summed over the parts)."""
    parts, k, d = books.shape
    kinds = dict(df.dtypes)

    def run(batches):
        import pyarrow as pa

        files = _files(books) if k else []
        for b in batches:
            kept, whole, x = integer_rows(b.column(len(keep)), scale, parts * d if k else -1)
            codes, error = np.zeros((len(x), parts), np.uint8), np.zeros(len(x), np.int64)
            for p, f in enumerate(files if len(x) else ()):
                codes[:, p], far = f.nearest(x[:, p * d : (p + 1) * d])
                error += far
            digits = codes.tobytes().hex()
            code, errors = np.full(b.num_rows, None, object), np.zeros(b.num_rows, np.int64)
            code[whole] = [digits[i : i + 2 * parts] for i in range(0, len(digits), 2 * parts)]
            errors[whole] = error
            made = [pa.array(code, pa.string()), pa.array(errors, mask=~whole)]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), *made], [*keep, "code", "error"]).filter(pa.array(kept))

    return in_arrow(df.select(*keep, vector), run, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", code string, error long")


def decode(coded: DataFrame, books: np.ndarray, scale: float = SCALE) -> DataFrame:
    """coded with approx, the vector whose parts are the entries that code names (null for a null code)."""
    flat = F.array(*[F.array(*[F.array(*[F.lit(float(v) / scale) for v in e]) for e in b]) for b in books])
    at = lambda p: F.conv(F.substring("code", 2 * p + 1, 2), 16, 10).cast("int")
    return coded.withColumn("approx", F.when(F.col("code").isNotNull(), F.concat(*[F.get(F.get(flat, F.lit(p)), at(p)) for p in range(len(books))])))


def books_sha256(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def with_label_error(coded: DataFrame, label: str = "label") -> DataFrame:
    """coded with label_error, the errors of equal labels summed up; a label may hold most rows, and there may be as many labels as rows."""
    sums = coded.groupBy(F.col(label).alias("_label")).agg(F.try_sum("error").alias("label_error"))
    if sums.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS:
        return coded.join(F.broadcast(sums), F.col(label).eqNullSafe(F.col("_label")), "left").drop("_label")
    dealt = coded.withColumn("_salt", F.pmod(F.xxhash64(*coded.columns), F.lit(SALTS)).cast("int"))
    sums = sums.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt2"))
    return dealt.join(sums, F.col(label).eqNullSafe(F.col("_label")) & (F.col("_salt") == F.col("_salt2")), "left").drop("_label", "_salt", "_salt2")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    books = train(rows)
    coded = cut(encode(rows, books, ["vec_id", "label"]), "codes")
    return with_label_error(coded).select("vec_id", "label", "code", "error", "label_error", F.lit(books_sha256(books)).alias("codebooks_sha256"))


def _sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """The same by brute force: every part against every entry."""

    def assigned(book: str) -> str:
        return f"""(SELECT vec_id, rid, label, p, v, arg_min(e, (d, e)) AS e, min(d) AS d FROM (
  SELECT q.*, b.e, list_sum(list_transform(list_zip(q.v, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM parts q JOIN {book} b USING (p)) GROUP BY vec_id, rid, label, p, v)"""

    text = f"""WITH kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, x) - 1 AS rid, * FROM (
 SELECT vec_id, label, list_transform(embedding, lambda c: floor(c::DOUBLE * {SCALE})::BIGINT) AS x FROM embeddings
 WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0)),
parts AS MATERIALIZED (SELECT vec_id, rid, label, p, x[p * len(x) // {parts} + 1 : (p + 1) * len(x) // {parts}] AS v FROM kept, range({parts}) t(p)),
b0 AS MATERIALIZED (SELECT p, rid AS e, v AS c FROM parts WHERE rid < {entries})"""
    for r in range(1, rounds + 1):
        text += f""",
a{r} AS MATERIALIZED {assigned(f"b{r - 1}")},
m{r} AS (SELECT p, e, list(c ORDER BY j) AS c FROM (SELECT p, e, j, (sum(c) - (((sum(c) % count(*)) + count(*)) % count(*))) // count(*) AS c FROM (SELECT p, e, unnest(v) AS c, generate_subscripts(v, 1) AS j FROM a{r}) GROUP BY p, e, j) GROUP BY p, e),
b{r} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.c, b.c)::BIGINT[] AS c FROM b{r - 1} b LEFT JOIN m{r} m USING (p, e))"""
    return f"""{text},
f AS MATERIALIZED {assigned(f"b{rounds}")},
c AS (SELECT vec_id, rid, label, string_agg(format('{{:02x}}', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM f GROUP BY ALL),
s AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{rounds})
SELECT vec_id, label, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM c, s"""


SQL = _sql()

"""Operator 4: language identification by sparse multinomial logistic regression on TF-IDF character n-grams.

Features: runs of 1 to 3 characters of the lower-case text, hashed to 2**16 places; weight (1 + ln count) * idf, scaled
to length 1. The idf counts all documents of the training fold, in one distributed pass. The regression is trained
on the driver with follow-the-regularised-leader (per-coordinate steps, elastic-net penalty: L1 zeroes weights) on a
bounded sample, ``PER_LANGUAGE`` rows of each language, ``SAMPLE`` rows and ``SAMPLE_BYTES`` bytes in all, the first by a hash of the id;
every fifth row of it is kept back and fits the temperature that calibrates the scores.

Training fold: crc32(id as text) mod 4 is not 2. Prediction reads the text alone, whole.

Defined results: a null text or one without a letter is ``und`` with score 0, and so is every text if no labelled row
exists; ids that are null count as the text ''; repeated rows and ties are rows of their own (equal texts, equal
predictions; of equal scores the first language by code point wins); extra columns don't matter; an empty table gives
no rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import crc32_fold, cut, in_arrow, table

BITS, GRAMS = 16, 3
PER_LANGUAGE, SAMPLE, EPOCHS = 800, 6_000, 2
ALPHA, BETA, L1, L2 = 2.0, 1.0, 0.02, 1e-4
UND = "und"
SAMPLE_BYTES = 64 << 20
#: The filter stage keeps a document if, by its n-grams alone (without the bias, which knows only how frequent a language
#: is), one language is more likely than all others together.
MIN_EVIDENCE = 0.5
_K = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Places and counts of the character n-grams of the whole text, with a space at either end."""
    c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    h, codes = np.zeros(len(c), np.uint64), []
    for n in range(min(GRAMS, len(c))):
        h = h[: len(c) - n] * _K[0] + (c[n:] + np.uint64(n + 1)) * _K[1]
        codes.append(((h ^ h >> np.uint64(31)) * _K[2] >> np.uint64(64 - BITS)).astype(np.int64))
    all_codes = np.concatenate(codes)
    if len(all_codes) < 1 << 13:
        return np.unique(all_codes, return_counts=True)
    counts = np.bincount(all_codes, minlength=1 << BITS)
    at = np.flatnonzero(counts)
    return at, counts[at]


def vector(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, n = features(text)
    v = (1 + np.log(n)) * idf[at]
    return at, (v / np.sqrt((v * v).sum())).astype(np.float32)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # place x language, mostly zeros
    bias: np.ndarray
    temperature: float

    def probabilities(self, text: str, bias: float = 1.0) -> np.ndarray:
        at, v = vector(text, self.idf)
        z = (v @ self.weights[at] + bias * self.bias) / self.temperature
        p = np.exp(z - z.max())
        return p / p.sum()

    def evidence(self, text: str) -> float:
        """The greatest probability that the text's n-grams give by themselves: about 1 / languages for a text of none of them."""
        return float(self.probabilities(text, 0.0).max())


def train(rows: Sequence[tuple[str, str]], idf: np.ndarray, epochs: int = EPOCHS) -> Model | None:
    """Follow-the-regularised-leader over (text, language) rows, in the given order; None without rows."""
    languages = sorted({lang for _, lang in rows})
    if not languages:
        return None
    index, k = {x: i for i, x in enumerate(languages)}, len(languages)
    data = [(*vector(t, idf), index[lang]) for t, lang in rows]
    held = data[4::5] if len(data) >= 50 else []
    learn = [x for i, x in enumerate(data) if i % 5 != 4] if held else data
    size = 1 << BITS
    z, n = np.zeros((size + 1, k)), np.zeros((size + 1, k))  # the last row is the bias, which no penalty holds back

    def weights(at: np.ndarray) -> np.ndarray:
        za, l1 = z[at], np.where(at == size, 0.0, L1)[:, None]
        return np.where(np.abs(za) <= l1, 0.0, -(za - np.sign(za) * l1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    for _ in range(epochs):
        for at, v, y in learn:
            at, v = np.append(at, size), np.append(v, 1.0)
            w = weights(at)
            s = v @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1
            g = v[:, None] * p
            g2 = g * g
            z[at] += g - (np.sqrt(n[at] + g2) - np.sqrt(n[at])) / ALPHA * w
            n[at] += g2
    w = weights(np.arange(size + 1))
    model = Model(languages, idf.astype(np.float32), w[:size].astype(np.float32), w[size].astype(np.float32), 1.0)
    if held and k > 1:
        scores = np.array([v @ model.weights[at] + model.bias for at, v, _ in held])
        truth = np.array([y for *_, y in held])

        def loss(log_t: float) -> float:
            s = scores / np.exp(log_t)
            s = s - s.max(axis=1, keepdims=True)
            return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(s)), truth]).mean())

        lo, hi, r = np.log(0.2), np.log(5.0), (np.sqrt(5) - 1) / 2
        while hi - lo > 1e-3:
            a, b = hi - r * (hi - lo), lo + r * (hi - lo)
            lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
        model.temperature = float(np.exp((lo + hi) / 2))
    return model


def document_frequencies(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, int]:
    """For each place, the number of documents that have it, and the number of documents; counted where the rows are."""

    def run(batches):
        import pyarrow as pa

        df, total = np.zeros(1 << BITS, np.int64), 0
        for batch in batches:
            for text in batch.column(0):
                t = text.as_py()
                if t:
                    df[features(t)[0]] += 1
                    total += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], total))], ["place", "n"])

    counts = in_arrow(docs.select(F.col(text_col).alias("text")), run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toPandas()
    total = int(counts.loc[counts.place < 0, "n"].sum())
    counts = counts[counts.place >= 0]
    out = np.zeros(1 << BITS, np.int64)
    out[counts.place.to_numpy()] = counts.n.to_numpy()
    return out, total


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Model | None:
    """Learns from the training fold; the drawn rows are the first whose texts have ``sample_bytes`` together, longer ones than a hundredth of that left out."""
    fold = docs.filter((crc32_fold(id_col) != 2) & F.col(lang_col).isNotNull())
    draw = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")).alias("draw")
    lang = F.col(lang_col).cast("string").alias("lang")
    # which rows, without their texts; the rank filter is pushed below the shuffle, so a task sends at most per_language short rows of a language
    first = F.row_number().over(Window.partitionBy("lang").orderBy("draw"))
    chosen = fold.select(lang, draw).withColumn("rank", first).filter(F.col("rank") <= per_language).orderBy("rank", "draw", "lang").limit(sample)
    chosen = chosen.groupBy("lang", "draw").agg(F.min("rank").alias("rank"))
    rows = fold.filter(F.octet_length(text_col) <= sample_bytes // 100).select(F.col(text_col).alias("text"), lang, draw).join(F.broadcast(chosen), ["lang", "draw"])  # at most ``sample`` rows are sent
    # one row of each id, and of these the first that have sample_bytes together
    rows = cut(rows.groupBy("lang", "draw", "rank").agg(F.min_by("text", F.xxhash64("text")).alias("text")), "language-sample")
    upto = F.sum("size").over(Window.orderBy("rank", "draw", "lang").rowsBetween(Window.unboundedPreceding, Window.currentRow))  # over at most ``sample`` short rows
    few = rows.select("lang", "draw", F.octet_length("text").alias("size"), "rank").withColumn("upto", upto).filter(F.col("upto") <= sample_bytes).select("lang", "draw")
    drawn = rows.join(F.broadcast(few), ["lang", "draw"]).orderBy("rank", "draw", "lang").select("text", "lang").collect()
    pairs = [(r.text, r.lang) for r in drawn if has_letter(r.text)]
    if not pairs:
        return None
    df, total = document_frequencies(fold.filter(F.col(text_col).isNotNull()), text_col)
    return train(pairs, np.log((1 + total) / (1 + df)) + 1)


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            lang, score = [], []
            for text in batch.column(2):
                t = text.as_py()
                if model is None or not has_letter(t):
                    lang.append(UND)
                    score.append(0.0)
                    continue
                p = model.probabilities(t)
                i = int(p.argmax())
                lang.append(model.languages[i])
                score.append(float(p[i]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).alias("doc_id"), (crc32_fold(id_col) == 2).alias("held_out"), F.col(text_col).alias("text"))
    return in_arrow(rows, run, f"doc_id {dict(docs.dtypes)[id_col]}, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Model | None, min_evidence: float = MIN_EVIDENCE, text_col: str = "text") -> DataFrame:
    """docs without those that have no letter or are of no learned language (evidence below min_evidence); the columns stay as they are."""
    at = docs.columns.index(text_col)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            keep = [model is not None and has_letter(t) and model.evidence(t) >= min_evidence for t in (x.as_py() for x in batch.column(at))]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return in_arrow(docs, run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, fit(docs))

"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Document frequencies cover every row that may be learned from. The classifier
is fitted by follow-the-regularised-leader with an elastic net on a bounded
sample, ``per_label`` rows of each label, chosen by a hash of the id; a fifth
of it is held back to calibrate the temperature of the probabilities. What
leaves the executors is the document frequencies, one number per feature, and
the sparse vectors of the sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import astuple, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.llm.shared import plain_names

BITS = 15
UNKNOWN = "und"


class Grams:
    """Counts of hashed runs of one to three letters; a run of other characters is one blank."""

    def __init__(self):
        self.table = np.array([ord(chr(c).lower()[0]) if chr(c).isalpha() else 0 for c in range(0x10000)], dtype=np.uint32)

    def letters(self, text: str) -> np.ndarray:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        if len(codes) and codes.max() >= 0x10000:
            far = np.unique(codes[codes >= 0x10000])
            mapped = np.array([c if chr(c).isalpha() else 0 for c in far.tolist()], dtype=np.uint32)
            low = self.table[np.minimum(codes, 0xFFFF)]
            high = codes >= 0x10000
            low[high] = mapped[np.searchsorted(far, codes[high])]
            codes = low
        else:
            codes = self.table[codes]
        if not codes.any():
            return np.empty(0, dtype=np.uint32)
        return np.concatenate([[np.uint32(0)], codes[(codes != 0) | np.append(codes[1:] != 0, False)], [np.uint32(0)]])

    def count(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Features and how often each occurs; none for a text without letters."""
        a = self.letters(text or "").astype(np.uint32)
        if len(a) < 3:
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        one = a * np.uint32(0x9E3779B1)
        two = (one[:-1] ^ np.uint32(0x5BD1E995)) * np.uint32(0x85EBCA6B) + a[1:] * np.uint32(0xC2B2AE35)
        three = (two[:-1] ^ (two[:-1] >> np.uint32(15))) * np.uint32(0x27D4EB2F) + a[2:] * np.uint32(0x165667B1)
        h = np.concatenate([one[a != 0], two, three])
        h = (h ^ (h >> np.uint32(16))) * np.uint32(0x7FEB352D)
        h = (h ^ (h >> np.uint32(15))) >> np.uint32(32 - BITS)
        if len(h) < 4000:
            return np.unique(h, return_counts=True)
        counts = np.bincount(h, minlength=1 << BITS)
        found = np.flatnonzero(counts)
        return found, counts[found]


def weights(features: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(counts)) * idf[features]
    norm = np.sqrt(x @ x)
    return x / norm if norm > 0 else x


@dataclass(frozen=True)
class Model:
    """Labels, a weight per feature and label, a bias per label, and the temperature."""

    labels: tuple[str, ...]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def logits(self, features: np.ndarray, x: np.ndarray) -> np.ndarray:
        return x @ self.weights[features] + self.bias

    def predict(self, features: np.ndarray, counts: np.ndarray) -> tuple[str, float]:
        if not len(features) or not self.labels:
            return UNKNOWN, 0.0
        p = softmax(self.logits(features, weights(features, counts, self.idf)) / self.temperature)
        best = int(p.argmax())
        return self.labels[best], float(p[best])


def softmax(v: np.ndarray) -> np.ndarray:
    e = np.exp(v - v.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], labels: int, epochs: int, alpha: float, beta: float, l1: float, l2: float) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases by FTRL-proximal with per-coordinate rates; an elastic net keeps most weights at zero."""
    z = np.zeros((1 << BITS, labels))
    n = np.zeros_like(z)
    zb, nb = np.zeros(labels), np.zeros(labels)

    def solved(z, n, l1):
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))

    for _ in range(epochs):
        for features, x, label in rows:
            w, b = solved(z[features], n[features], l1), solved(zb, nb, 0.0)
            error = softmax(x @ w + b)
            error[label] -= 1
            g = np.outer(x, error)
            old = n[features]
            new = old + g * g
            z[features] += g - (np.sqrt(new) - np.sqrt(old)) / alpha * w
            n[features] = new
            zb += error - (np.sqrt(nb + error**2) - np.sqrt(nb)) / alpha * b
            nb += error**2
    return solved(z, n, l1), solved(zb, nb, 0.0)


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss on rows held back, by golden-section search; 1 without rows.

    Targets are smoothed by 1 / (rows + labels), as in Platt scaling, so that
    separable rows don't drive the temperature to zero.
    """
    if not len(labels):
        return 1.0

    off = 1 / (len(labels) + logits.shape[1])
    target = np.full(logits.shape, off / max(1, logits.shape[1] - 1))
    target[np.arange(len(labels)), labels] = 1 - off

    def loss(log_t):
        return -(target * np.log(softmax(logits / np.exp(log_t)) + 1e-12)).sum(axis=1).mean()

    lo, hi, ratio = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def document_frequencies(docs: DataFrame, text_col: str) -> tuple[np.ndarray, int]:
    """In how many texts each feature occurs, and the number of texts."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, total = Grams(), np.zeros((1 << BITS) + 1, dtype=np.int64)
        for batch in batches:
            for text in batch.column(0):
                total[grams.count(text.as_py())[0]] += 1
            total[-1] += batch.num_rows
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(total[found])], names=["feature", "n"])

    summed = docs.select(F.col(text_col).cast("string")).mapInArrow(rows, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    df = np.zeros((1 << BITS) + 1, dtype=np.int64)
    for feature, n in summed.collect():  # one row per feature
        df[feature] = n
    return df[:-1], int(df[-1])


def train(
    docs: DataFrame, per_label: int = 1000, epochs: int = 3, alpha: float = 2.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang"
) -> Model:
    """Fit on rows with an id and a label; at most ``per_label`` of each label shape the weights.

    Labels without a sampled text that has letters are not learned. Without
    any rows the model knows no label and predicts ``und``.
    """
    known = docs.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(label_col).cast("string").alias("label"))
    df, n = document_frequencies(known, "text")
    idf = np.log((1 + n) / (1 + df)) + 1

    place = F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1 << 30))
    sizes = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}  # one row per label
    rate = F.create_map(*(F.lit(x) for k, v in sizes.items() for x in (k, min(1.0, 2.0 * per_label / v)))) if sizes else None
    if rate is None:
        return Model((), idf, np.zeros((1 << BITS, 0)), np.zeros(0), 1.0)
    drawn = known.withColumn("place", place).where(F.col("place") < rate[F.col("label")] * (1 << 30))
    order = Window.partitionBy("label").orderBy("place", "id")
    drawn = drawn.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= per_label)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams()
        for batch in batches:
            counted = [grams.count(t.as_py()) for t in batch.column("text")]
            columns = [pa.array([c[k].astype(np.int32).tobytes() for c in counted], pa.binary()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("place").cast(pa.int64()), *columns], names=["label", "place", "features", "counts"])

    sample = drawn.select("label", F.col("place").cast("long").alias("place"), "text").mapInArrow(vectors, "label string, place long, features binary, counts binary").collect()  # per_label rows of each label
    sample = sorted((r for r in sample if len(r["features"])), key=lambda r: (r["place"] * 2654435761 % (1 << 30), r["label"], r["features"]))
    labels = tuple(sorted({r["label"] for r in sample}))
    rows = []
    for r in sample:
        features = np.frombuffer(r["features"], dtype=np.int32)
        rows.append((features, weights(features, np.frombuffer(r["counts"], dtype=np.int32), idf), labels.index(r["label"])))
    held = rows[::5] if len(rows) >= 10 else []
    w, b = fit_ftrl([x for k, x in enumerate(rows) if k % 5 or not held], len(labels), epochs, alpha, beta, l1, l2)
    model = Model(labels, idf, w.astype(np.float32), b, 1.0)
    t = fit_temperature(np.array([model.logits(f, x) for f, x, _ in held]), np.array([k for *_, k in held])) if held else 1.0
    return Model(labels, idf, model.weights, b, t)


def held_out(id_: Column, parts: int = 3, part: int = 1) -> Column:
    """Whether the CRC-32 of the id as text leaves ``part`` modulo ``parts``; false for a null id."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % parts == part, F.lit(False))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score`` of every row; ``und`` with score 0 for texts that are null or have no letter."""
    shared = docs.sparkSession.sparkContext.broadcast(astuple(model))  # labels * 2**BITS numbers

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, model = Grams(), Model(*shared.value)
        for batch in batches:
            found = [model.predict(*grams.count(t.as_py())) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([y for _, y in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(rows, "doc_id long, lang_pred string, score double")


def scored_documents(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The documents, every column, with ``_lang_pred`` and ``_score``, without a join."""
    shared = docs.sparkSession.sparkContext.broadcast(astuple(model))
    added = ("_lang_pred", "_score")
    plain, names, where = plain_names(docs, added)
    schema = T.StructType([*plain.schema.fields, T.StructField("_lang_pred", T.StringType()), T.StructField("_score", T.DoubleType())])
    at = plain.columns.index(where[text_col])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, model = Grams(), Model(*shared.value)
        for batch in batches:
            found = [model.predict(*grams.count(t.as_py())) for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x for x, _ in found], pa.string()), pa.array([y for _, y in found], pa.float64())], names=[*schema.names])

    return plain.mapInArrow(rows, schema).toDF(*names, *added)

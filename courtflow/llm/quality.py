"""Quality classifier: hashed word n-gram logistic regression, follow-the-regularised-leader updates.

A text becomes a sparse unit vector: its word and shape unigrams and bigrams, hashed into 2**bits
buckets, each with the value sqrt(count / all counts). A score is the logistic of a sparse
dot product. Training is sequential, as the updates are, and so takes a bounded sample of labelled
rows; scoring is one map over all rows, with the weight vector (2**bits floats) sent to each task.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BoundedCache, fresh, id_crc32, in_parts, keyed_text

TOKEN = re.compile(rb"[0-9A-Za-z_\x80-\xff]+|[^0-9A-Za-z_\x80-\xff\s]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SAME = np.uint64(0x5851F42D4C957F2D)


@dataclass(frozen=True)
class QualityParams:
    """max_train_rows bounds the sample of labelled rows that the sequential training takes."""

    bits: int = 18
    max_train_rows: int = 12_000
    epochs: int = 5
    alpha: float = 4.0
    beta: float = 1.0
    l1: float = 1e-2
    l2: float = 1e-4


def _shape(token: bytes) -> bytes:
    if token.isdigit():
        return b"9"
    if token[0] in b"!-/:-@[-`{-~" or not (token[:1].isalnum() or token[0] >= 128 or token[:1] == b"_"):
        return token[:4]
    if token.isupper():
        return b"XX" if len(token) > 1 else b"X"
    return b"Xx" if token[:1].isupper() else b"x"


def _codes(token: bytes) -> tuple[int, int]:
    return xxhash.xxh64_intdigest(token.lower()), xxhash.xxh64_intdigest(_shape(token), 7)


def _grams(codes: np.ndarray) -> list[np.ndarray]:
    return [codes, codes[:-1] * _MIX + codes[1:]]


def features(text: bytes, cache: BoundedCache, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text, ascending, and their values; none for a text without tokens."""
    tokens = TOKEN.findall(text)
    if not tokens:
        return np.empty(0, np.uint32), np.empty(0, np.float32)
    codes = np.array(list(map(cache.__getitem__, tokens)), np.uint64)
    codes[1:][codes[1:, 0] == codes[:-1, 0]] = _SAME  # a token that repeats the one before has one code of its own
    mixed = np.concatenate(_grams(codes[:, 0]) + _grams(codes[:, 1]))
    mixed = (mixed ^ (mixed >> np.uint64(31))) * _MIX
    buckets, counts = np.unique((mixed >> np.uint64(64 - bits)).astype(np.uint32), return_counts=True)
    return buckets, np.sqrt(counts / len(mixed)).astype(np.float32)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], p: QualityParams) -> np.ndarray:
    """Per-coordinate FTRL-Proximal; the last weight is the bias, which isn't regularised by l1."""
    dim = (1 << p.bits) + 1
    z, n, w = np.zeros(dim), np.zeros(dim), np.zeros(dim)
    for _ in range(p.epochs):
        for buckets, values, label in rows:
            i, x = np.append(buckets, dim - 1).astype(np.int64), np.append(values, 1.0)
            zi, ni = z[i], n[i]
            l1 = np.full(len(i), p.l1)
            l1[-1] = 0.0
            wi = np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((p.beta + np.sqrt(ni)) / p.alpha + p.l2))
            g = (1 / (1 + np.exp(-np.clip(wi @ x, -30, 30))) - label) * x
            z[i] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / p.alpha * wi
            n[i] = ni + g * g
    l1 = np.full(dim, p.l1)
    l1[-1] = 0.0
    w = np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((p.beta + np.sqrt(n)) / p.alpha + p.l2))
    return w.astype(np.float32)


def train(docs: DataFrame, labels: DataFrame, params: QualityParams = QualityParams(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> np.ndarray:
    """Weights from labelled rows. labels: (id_col, label_col); a null label is left out, of several labels of one id the least counts.

    The sample is the first max_train_rows ids by hash: a uniform one, the same in each run. Without labelled rows all weights are 0.
    """
    spark = docs.sparkSession
    chosen = (
        labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label"))
        .where("label in (0, 1) and doc_id is not null")
        .groupBy("doc_id").agg(F.min("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(params.max_train_rows)
    )
    bits = params.bits

    def to_features(batches):
        cache = BoundedCache(_codes, 50_000)
        for batch in in_parts(batches, 2):
            rows = [features(t, cache, bits) for t in batch.column(2).to_pylist()]
            packed = [pa.array([r[k].tobytes() for r in rows], pa.binary()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *packed], ["doc_id", "label", "buckets", "values"])

    def to_weights(batches):
        rows = sorted((xxhash.xxh64_intdigest(str(i)), b, v, y) for x in batches for i, y, b, v in zip(*(c.to_pylist() for c in x.columns)))
        weights = ftrl([(np.frombuffer(b, np.uint32), np.frombuffer(v, np.float32), y) for _, b, v, y in rows], params)
        yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()], pa.binary())], ["weights"])

    sample = (
        keyed_text(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id")  # at most max_train_rows rows
        .select(F.col("doc_id").cast("string").alias("doc_id"), "label", F.col("text").cast("binary").alias("text"))
        .mapInArrow(to_features, "doc_id string, label int, buckets binary, values binary")
    )
    row = sample.repartition(1).mapInArrow(to_weights, "weights binary")
    found = row.collect()
    return np.frombuffer(bytes(found[0][0]), np.float32) if found else np.zeros((1 << bits) + 1, np.float32)


def score(docs: DataFrame, weights: np.ndarray, params: QualityParams = QualityParams(), id_col: str = "doc_id", text_col: str = "text", out: str = "score") -> DataFrame:
    """docs with a column `out` (0 to 1) more; an empty or null text gets the score of the bias alone.

    Every input column is kept; one named `out` is replaced, and no other name clashes. Texts are scored whole, of any length.
    Repeated rows have equal scores; an empty table gives an empty one.
    """
    sent, bits, keep = docs.sparkSession.sparkContext.broadcast(weights.tobytes()), params.bits, [c for c in docs.columns if c != out]

    def run(batches):
        w = np.frombuffer(sent.value, np.float32)
        cache = BoundedCache(_codes, 50_000)
        for batch in in_parts(batches, -1):
            sums = []
            for text in batch.column(batch.num_columns - 1).to_pylist():
                i, x = features(text or b"", cache, bits)
                sums.append(float(w[-1]) + float(w[i] @ x))
            s = 1 / (1 + np.exp(-np.clip(np.array(sums, np.float64), -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(s, pa.float64())], [*batch.schema.names[:-1], out])

    given = docs.select(*keep, F.col(text_col).cast("binary").alias(fresh(keep, "__text")))
    schema = docs.select(*keep).schema.add(out, "double")
    return given.mapInArrow(run, schema)


def held_out(column: str = "doc_id"):
    return F.coalesce(id_crc32(column) % 5 == 0, F.lit(False))


def fit_and_score(docs: DataFrame, labels: DataFrame, params: QualityParams = QualityParams()) -> DataFrame:
    """Train on the labels outside the held-out fold, score all of docs (doc_id, text and any others)."""
    weights = train(docs, labels.where(~held_out()), params)
    return score(docs, weights, params)

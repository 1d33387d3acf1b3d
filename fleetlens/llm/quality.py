"""Quality classifier: hashed word n-gram logistic regression trained with
follow-the-regularised-leader (FTRL-proximal) updates.

Features of a whole text: words (runs of non-space bytes, ASCII lower case) and
their shapes (runs of lower-case, upper-case, digit and other bytes collapsed),
as 1-grams and 2-grams, hashed into ``2 ** BITS`` places. A word equal to the
one before it counts as one more feature, so repetition shows whatever the word.
Values are ``log(1 + count)``, scaled to length 1; a score is the sparse dot
product with the weights, through the logistic function.

Training is sequential by nature: it reads a bounded sample of labelled rows
(``max_train``, those of least hash) in one task and returns only non-zero
weights, at most ``2 ** BITS`` numbers. Scoring reads every row.

Defined cases: null and empty texts have no feature and get the score of the
bias; rows without id or label train nothing; without any labelled row every
score is 0.5; if several labels name one id, each trains; repeated rows are
scored alike. Input columns are kept, and only ``id_col`` and ``text_col`` are
read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 18
MASK = (1 << BITS) - 1
MAX_TRAIN = 8192
EPOCHS = 3

_SHAPE = bytes(32 if b in b" \t\n\x0b\x0c\r" else 97 if 97 <= b <= 122 or b >= 128 else 65 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else b
               for b in range(256))


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), np.uint64, len(words))


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(index, value) of one text: distinct hashed places and values of length 1."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.lower().split()
    if not words:
        return np.empty(0, np.int64), np.empty(0)
    shape = np.frombuffer(raw.translate(_SHAPE), np.uint8)
    shape = shape[np.concatenate(([True], shape[1:] != shape[:-1]))].tobytes().split()
    parts = []
    for salt, h in ((1, _hashes(words)), (2, _hashes(shape))):
        parts.append(h * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt))
        two = h[:-1] * np.uint64(0xBF58476D1CE4E5B9) + h[1:] * np.uint64(0x94D049BB133111EB)
        if salt == 1:
            two = np.where(h[:-1] == h[1:], np.uint64(7), two)
        parts.append(two * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt + 2))
    index, count = np.unique((np.concatenate(parts) >> np.uint64(64 - BITS)).astype(np.int64), return_counts=True)
    value = np.log1p(count)
    return index, value / math.sqrt(float(value @ value))


def train(rows, alpha: float = 2.0, beta: float = 1.0, l1: float = 0.05, l2: float = 0.1, epochs: int = EPOCHS):
    """FTRL-proximal over ``(text, label)`` rows, in their order; returns (weights, bias)."""
    data = [(i.astype(np.int32), v.astype(np.float32), float(y)) for t, y in rows for i, v in [features(t)]]
    z, n = np.zeros(MASK + 2), np.zeros(MASK + 2)
    for _ in range(epochs if data else 0):
        for index, value, y in data:
            at, x = np.append(index, MASK + 1), np.append(value, 1.0)
            za, na = z[at], n[at]
            root = np.sqrt(na)
            first = np.full(len(at), l1)
            first[-1] = 0.0  # the bias is not shrunk
            w = -np.sign(za) * np.maximum(np.abs(za) - first, 0) / ((beta + root) / alpha + l2)
            p = 1 / (1 + math.exp(-max(-35.0, min(35.0, float(w @ x)))))
            g = (p - y) * x
            new = na + g * g
            z[at] = za + g - (np.sqrt(new) - root) / alpha * w
            n[at] = new
    first = np.full(MASK + 2, l1)
    first[-1] = 0.0
    w = -np.sign(z) * np.maximum(np.abs(z) - first, 0) / ((beta + np.sqrt(n)) / alpha + l2)
    return w[:-1], float(w[-1])


def score_of(text: str | None, weights: np.ndarray, bias: float) -> float:
    index, value = features(text)
    s = bias + float(weights[index] @ value)
    return 1 / (1 + math.exp(-max(-35.0, min(35.0, s))))


def fit(docs: DataFrame, labels: DataFrame, label_col: str, learn: Column | None = None, id_col: str = "doc_id",
        text_col: str = "text", max_train: int = MAX_TRAIN) -> tuple[np.ndarray, float]:
    """Weights and bias from labelled rows; ``learn`` says which ids (named ``id``) may be learned from."""
    known = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("double").alias("label"))
    known = known.where(F.col("id").isNotNull() & F.col("label").isNotNull() & (F.lit(True) if learn is None else learn))
    known = known.orderBy(F.xxhash64("id"), "id", "label").limit(max_train)
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    # at most max_train ids: a bounded side; limit again, as an id may have several rows
    rows = texts.join(F.broadcast(known), "id").withColumn("h", F.xxhash64("id"))
    rows = rows.orderBy("h", "id", "label", F.xxhash64("text")).limit(max_train)
    schema = pa.schema([("place", pa.int32()), ("weight", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]):
        w, b = train((t.as_py(), y.as_py()) for x in batches for t, y in zip(x.column(0), x.column(1)))
        at = np.flatnonzero(w)
        yield pa.record_batch([pa.array(np.append(at, MASK + 1).astype(np.int32)), pa.array(np.append(w[at], b))], schema=schema)

    ordered = rows.select("h", "id", "label", "text").repartition(1).sortWithinPartitions("h", "id", "label", F.xxhash64("text"))
    got = ordered.select("text", "label").mapInArrow(run, "place int, weight double").collect()
    weights = np.zeros(MASK + 2)
    for r in got:
        weights[r["place"]] = r["weight"]
    return weights[:-1], float(weights[-1])


def score_column(spark, model: tuple[np.ndarray, float], text_col: str = "text") -> Column:
    """The score of a whole text, as a column over any frame that has ``text_col``."""
    shared = spark.sparkContext.broadcast((model[0].astype(np.float32), model[1]))

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        w, b = shared.value
        for x in texts:
            yield pd.Series([score_of(t, w, b) for t in x], dtype="float64")

    return score(F.col(f"`{text_col}`").cast("string"))

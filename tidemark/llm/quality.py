"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader.

Words are runs of letters and digits, or runs of other visible characters, with their case. Every
distinct word and pair of adjacent words sets one of 2**20 features (a pair of equal words the same
one); a text's features share unit length. Training runs over a bounded sample of labelled texts (``SAMPLE_DOCS``), one text at a time,
with per-coordinate rates and an L1 term that keeps unused weights at zero. A score is the logistic
function of a sparse dot product.

Edge cases: null and empty texts have no features and get the score of the bias; rows without a
label or with a null one are not trained on; without any labelled row every score is 0.5; rows with
the same doc_id are each scored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .sampling import bounded_sample
from .textkernel import TOKENS, Words, chunks, ngrams

BITS, SAMPLE_DOCS, EPOCHS = 20, 12_000, 3
ALPHA, BETA, L1, L2 = 2.0, 1.0, 0.05, 0.02
_SHIFT = np.uint64(64 - BITS)


def features(column: pa.Array) -> list[np.ndarray]:
    """Per text the distinct hashed features of its words and word pairs."""
    words = Words(column, TOKENS, lower=False)
    one = (words.hash >> _SHIFT).astype(np.int32)
    two = ngrams(words.hash, 2)
    two[words.hash[1:] == words.hash[:-1]] = 0  # a word said twice is one feature, whatever the word
    two = (two >> _SHIFT).astype(np.int32)
    return [np.unique(np.concatenate([one[lo:hi], two[lo : max(lo, hi - 1)]])) for lo, hi in zip(words.first.tolist(), words.last.tolist(), strict=True)]


def train(rows: Sequence[np.ndarray], labels: Sequence[int], seed: int = 3) -> tuple[np.ndarray, float]:
    """Weights and bias by follow-the-regularised-leader over the rows in seeded order."""
    size = 1 << BITS
    z, n, w = np.zeros(size), np.zeros(size), np.zeros(size)
    zb = nb = bias = 0.0
    rng = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            at = rows[i]
            x = 1.0 / np.sqrt(len(at)) if len(at) else 0.0
            zi, ni = z[at], n[at]
            wi = np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))
            p = 1.0 / (1.0 + np.exp(-np.clip(wi.sum() * x + bias, -35, 35)))
            g = (p - labels[i]) * x
            z[at] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA * wi
            n[at] = ni + g * g
            gb = p - labels[i]
            zb += gb - (np.sqrt(nb + gb * gb) - np.sqrt(nb)) / ALPHA * bias
            nb += gb * gb
            bias = -zb / ((BETA + np.sqrt(nb)) / ALPHA)
    w = np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    return w.astype(np.float32), float(bias)


def fit(labelled: DataFrame, seed: int = 3) -> tuple[np.ndarray, float]:
    """Weights from rows (doc_id, text, label 0 or 1)."""
    rows = bounded_sample(labelled.filter("label is not null"), "doc_id", SAMPLE_DOCS, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                found = [f.tobytes() for f in features(part.column(1))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(found, pa.binary())], ["doc_id", "label", "f"])

    schema = T.StructType([rows.schema["doc_id"], T.StructField("label", T.IntegerType()), T.StructField("f", T.BinaryType())])
    got = rows.select("doc_id", "text", F.col("label").cast("int").alias("label")).mapInArrow(run, schema).collect()
    got.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2]))
    if not got:
        return np.zeros(1 << BITS, dtype=np.float32), 0.0
    return train([np.frombuffer(r[2], dtype=np.int32) for r in got], [r[1] for r in got])


def score(docs: DataFrame, model: tuple[np.ndarray, float], carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Per row of ``docs`` (text): the columns ``carry``, then score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 4 MB, whatever the input
    carry = [c for c in carry if c != "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value
        for batch in batches:
            for part in chunks(batch, "__text"):
                logit = [float(weights[f].sum(dtype=np.float64)) / max(1.0, np.sqrt(len(f))) + bias for f in features(part.column(part.num_columns - 1))]
                p = 1.0 / (1.0 + np.exp(-np.clip(logit, -35, 35)))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(p, pa.float64())], [*carry, "score"])

    schema = T.StructType([*(docs.schema[c] for c in carry), T.StructField("score", T.DoubleType())])
    return docs.select(*carry, F.col("text").alias("__text")).mapInArrow(run, schema)

"""Language identification by a byte convolutional network, trained and applied in numpy.

Bytes are folded into 64 classes (ASCII letters without case, 37 for bytes beyond ASCII, one for all
else). Filters of widths 2, 3 and 4 slide over windows of ``WINDOW`` bytes; each filter's
maximum over the window passes a rectifier and a softmax layer. A text is cut into windows that
cover it whole; its scores are the means over its windows, weighted by their letters.

Training: ``fit`` takes all windows of a bounded sample of labelled texts (about ``SAMPLE_DOCS`` of them, or fewer so that
about ``SAMPLE_BYTES`` are not exceeded), Adam, a fixed seed. ``fit_whole`` takes all windows of all labelled texts: they are
dealt evenly to parts of about ``PART_BYTES``, each part trains the network it is given over its windows, and the mean of
the parts' networks, weighted by their windows, is what the next pass begins with. The driver holds a network for each part
(about 20 kB), and one softmax column for each language, which are taken to be few.

Edge cases: a null text and one without a letter are ``und`` with score 0; texts shorter than a
window are padded with the class for all else; with no labelled text at all every prediction is
``und``; repeated rows get equal results; an empty table gives an empty result; other columns are
carried only on request.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .sampling import bounded_sample
from .scratch import Scratch
from .textkernel import chunks

WINDOW, WIDTHS, FILTERS = 256, (2, 3, 4), 8
SAMPLE_DOCS, SAMPLE_BYTES, EPOCHS, BATCH = 4000, 6 << 20, 6, 128
#: Bytes of text a part trains on, passes over all parts at least, windows a row of the dealt table has at most, windows shuffled at a time.
PART_BYTES, PASSES, ROW_WINDOWS, HELD = 32 << 20, 2, 16, 8192
#: At most so many windows are scored at a time.
BLOCK = 1024

_CLASS = np.zeros(256, dtype=np.int32)
for _i in range(26):
    _CLASS[97 + _i] = _CLASS[65 + _i] = 1 + _i
for _i in range(128):
    _CLASS[128 + _i] = 27 + _i % 37
_CLASSES = 64


@dataclass
class Network:
    """Weights: per width an array (width, classes, filters), biases, and the softmax layer."""

    labels: list[str]
    filters: list[np.ndarray]
    bias: list[np.ndarray]
    dense: np.ndarray
    dense_bias: np.ndarray

    def params(self) -> list[np.ndarray]:
        return [*self.filters, *self.bias, self.dense, self.dense_bias]

    def pooled(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Maxima of all filters over windows of classes (n, length), and where they stand."""
        values, places = [], []
        for kernel, bias in zip(self.filters, self.bias, strict=True):
            width = len(kernel)
            span = windows.shape[1] - width + 1
            acc = kernel[0][windows[:, :span]]
            for j in range(1, width):
                acc += kernel[j][windows[:, j : j + span]]
            where = acc.argmax(axis=1)
            values.append(np.take_along_axis(acc, where[:, None, :], axis=1)[:, 0, :] + bias)
            places.append(where)
        return np.concatenate(values, axis=1), np.concatenate(places, axis=1)

    def tables(self) -> list[tuple[np.ndarray, np.ndarray | None]]:
        """Per width, sums of the filters by pairs of adjacent classes: fewer lookups per byte."""
        out = []
        for kernel in self.filters:
            pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(_CLASSES * _CLASSES, -1)
            rest = None if len(kernel) == 2 else kernel[2] if len(kernel) == 3 else pair(kernel[2], kernel[3])
            out.append((pair(kernel[0], kernel[1]), rest))
        return out

    def probabilities(self, windows: np.ndarray, tables: list | None = None) -> np.ndarray:
        tables = tables or self.tables()
        x = np.ascontiguousarray(windows.T)  # positions first: the maxima then run over whole rows
        pairs = x[:-1] * _CLASSES + x[1:]
        values = []
        for (head, tail), kernel, bias in zip(tables, self.filters, self.bias, strict=True):
            span = len(x) - len(kernel) + 1
            acc = np.take(head, pairs[:span], axis=0, mode="clip")
            if tail is not None:
                acc += np.take(tail, (x if len(kernel) == 3 else pairs)[2 : 2 + span], axis=0, mode="clip")
            values.append(acc.max(axis=0) + bias)
        z = np.maximum(np.concatenate(values, axis=1), 0) @ self.dense + self.dense_bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def windows_of(text: bytes) -> np.ndarray:
    """Classes of consecutive windows that cover ``text``, the last one padded: (n, WINDOW)."""
    n = max(1, -(-len(text) // WINDOW))
    out = np.zeros(n * WINDOW, dtype=np.int32)
    out[: len(text)] = _CLASS[np.frombuffer(text, dtype=np.uint8)]
    return out.reshape(n, WINDOW)


def fresh(labels: Sequence[str], rng: np.random.Generator) -> Network:
    """A network before training."""
    return Network(
        list(labels),
        [rng.normal(0, 0.3, (w, _CLASSES, FILTERS)).astype(np.float32) for w in WIDTHS],
        [np.zeros(FILTERS, dtype=np.float32) for _ in WIDTHS],
        rng.normal(0, 0.2, (FILTERS * len(WIDTHS), len(labels))).astype(np.float32),
        np.zeros(len(labels), dtype=np.float32),
    )


class Adam:
    """Trains a network in place on the cross entropy; only the places of the maxima get gradients."""

    def __init__(self, net: Network):
        self.net, self.params, self.steps = net, net.params(), 0
        self.first, self.second = [np.zeros_like(p) for p in self.params], [np.zeros_like(p) for p in self.params]

    def epoch(self, windows: np.ndarray, targets: np.ndarray, rng: np.random.Generator) -> None:
        order = rng.permutation(len(windows))
        for at in range(0, len(order), BATCH):
            rows = order[at : at + BATCH]
            self.step(windows[rows], targets[rows])

    def step(self, x: np.ndarray, y: np.ndarray) -> None:
        net = self.net
        pre, where = net.pooled(x)
        hidden = np.maximum(pre, 0)
        z = hidden @ net.dense + net.dense_bias
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        p /= len(y)
        back = (p @ net.dense.T) * (pre > 0)
        grads = []
        for i, width in enumerate(WIDTHS):
            part, place = back[:, i * FILTERS : (i + 1) * FILTERS], where[:, i * FILTERS : (i + 1) * FILTERS]
            g = np.zeros_like(net.filters[i])
            column = np.broadcast_to(np.arange(FILTERS), place.shape)
            for j in range(width):
                np.add.at(g[j], (np.take_along_axis(x, place + j, axis=1), column), part)
            grads.append(g)
        grads += [back[:, i * FILTERS : (i + 1) * FILTERS].sum(axis=0) for i in range(len(WIDTHS))]
        grads += [hidden.T @ p, p.sum(axis=0)]
        self.steps += 1
        for q, g, m, v in zip(self.params, grads, self.first, self.second, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            q -= (0.01 * (m / (1 - 0.9**self.steps)) / (np.sqrt(v / (1 - 0.999**self.steps)) + 1e-8)).astype(np.float32)


def train(windows: np.ndarray, targets: np.ndarray, labels: Sequence[str], seed: int = 5) -> Network:
    """Fits a network by Adam over all windows, ``EPOCHS`` times."""
    rng = np.random.default_rng(seed)
    net = fresh(labels, rng)
    adam = Adam(net)
    for _ in range(EPOCHS):
        adam.epoch(windows, targets, rng)
    return net


def mean_of(nets: Sequence[tuple[int, Network]]) -> Network:
    """The mean of networks of the same labels, by weight."""
    total, net = sum(n for n, _ in nets), nets[0][1]
    for k, own in enumerate(net.params()):
        own[...] = sum(n * other.params()[k].astype(np.float64) for n, other in nets) / total
    return net


def fit(docs: DataFrame, labelled: DataFrame | None = None, seed: int = 5) -> Network | None:
    """A network from rows (doc_id, text, lang) with a language; None if there is none."""
    labelled = (docs if labelled is None else labelled).filter(F.col("lang").isNotNull())
    sample = bounded_sample(labelled.select("doc_id", "text", "lang"), "doc_id", SAMPLE_DOCS, seed, SAMPLE_BYTES)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                got = []
                for i, text, lang in zip(*(part.column(c).to_pylist() for c in range(3)), strict=True):
                    if has_letter(text):
                        got.append((i, lang, windows_of(text.encode()).astype(np.uint8).tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array([g[k] for g in got], t) for k, t in enumerate((part.column(0).type, pa.string(), pa.binary()))], ["doc_id", "lang", "windows"])

    schema = T.StructType([sample.schema["doc_id"], T.StructField("lang", T.StringType()), T.StructField("windows", T.BinaryType())])
    rows = sorted(sample.mapInArrow(cut, schema).collect(), key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2]))
    if not rows:
        return None
    labels = sorted({r[1] for r in rows})
    windows = np.concatenate([np.frombuffer(r[2], dtype=np.uint8).reshape(-1, WINDOW) for r in rows]).astype(np.int32)
    targets = np.concatenate([np.full(len(r[2]) // WINDOW, labels.index(r[1])) for r in rows])
    return train(windows, targets, labels)


def fit_whole(docs: DataFrame, seed: int = 5) -> Network | None:
    """A network from all windows of all rows (text, lang) with a language; None if there is none."""
    spark = docs.sparkSession
    scratch, labelled = Scratch(spark, "langid"), docs.filter(F.col("lang").isNotNull()).select("lang", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                langs, rows = [], []
                for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    if has_letter(text):
                        w = windows_of(text.encode()).astype(np.uint8)
                        rows += [w[at : at + ROW_WINDOWS].tobytes() for at in range(0, len(w), ROW_WINDOWS)]
                        langs += [lang] * (len(rows) - len(langs))
                yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(rows, pa.binary())], ["lang", "windows"])

    # without a key, and by a hash of their place: rows of one language or text that stand together come to all parts, and apart there
    parts = max(1, -(-(labelled.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // PART_BYTES))
    cut_up = labelled.mapInArrow(cut, "lang string, windows binary").withColumn("at", F.xxhash64(F.monotonically_increasing_id()))
    dealt = scratch.write(cut_up.repartition(parts).sortWithinPartitions("at").drop("at"), "windows")
    labels = sorted(r[0] for r in dealt.select("lang").distinct().collect())
    if not labels:
        return None
    number = {lang: k for k, lang in enumerate(labels)}
    net = fresh(labels, np.random.default_rng(seed))
    for nth in range(max(PASSES, EPOCHS // parts)):
        began = spark.sparkContext.broadcast(pickle.dumps(net))

        def pass_over(batches: Iterator[pa.RecordBatch], began=began, nth=nth) -> Iterator[pa.RecordBatch]:
            own, rng, seen, held, targets = pickle.loads(began.value), np.random.default_rng([seed, nth]), 0, [], []
            adam = Adam(own)
            for batch in batches:
                for lang, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    held.append(raw)
                    targets.append(np.full(len(raw) // WINDOW, number[lang]))
                    if len(held) * ROW_WINDOWS >= HELD:
                        seen += _trained(adam, held, targets, rng)
            seen += _trained(adam, held, targets, rng)
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array([seen], pa.int64()), pa.array([pickle.dumps(own)], pa.binary())], ["n", "net"])

        trained = sorted((r[0], bytes(r[1])) for r in dealt.mapInArrow(pass_over, "n long, net binary").collect())
        net = mean_of([(n, pickle.loads(raw)) for n, raw in trained])
    scratch.drop("windows")
    return net


def _trained(adam: Adam, held: list[bytes], targets: list[np.ndarray], rng: np.random.Generator) -> int:
    """Trains on what is held and lets go of it; the number of windows."""
    if not held:
        return 0
    windows = np.frombuffer(b"".join(held), dtype=np.uint8).reshape(-1, WINDOW).astype(np.int32)
    adam.epoch(windows, np.concatenate(targets), rng)
    held.clear()
    targets.clear()
    return len(windows)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def predict_batch(net: Network | None, texts: Sequence[str | None]) -> tuple[list[str], list[float]]:
    langs, scores = ["und"] * len(texts), [0.0] * len(texts)
    if net is None:
        return langs, scores
    tables = net.tables()
    total = np.zeros((len(texts), len(net.labels)))
    pending: list[np.ndarray] = []
    owner: list[np.ndarray] = []

    def flush() -> None:
        if pending:
            w, o = np.concatenate(pending), np.concatenate(owner)
            for at in range(0, len(w), 32):  # small enough for a core's cache
                part = w[at : at + 32]
                letters = (part > 0).sum(axis=1, keepdims=True)
                np.add.at(total, o[at : at + 32], net.probabilities(part, tables) * letters)
            pending.clear()
            owner.clear()

    held = 0
    letters = [has_letter(t) for t in texts]
    for i, text in enumerate(texts):
        if letters[i]:
            w = windows_of(text.encode())
            for at in range(0, len(w), BLOCK):
                pending.append(w[at : at + BLOCK])
                owner.append(np.full(len(pending[-1]), i))
                held += len(pending[-1])
                if held >= BLOCK:
                    flush()
                    held = 0
    flush()
    for i in range(len(texts)):
        if letters[i]:
            s = total[i].sum()
            best = int(total[i].argmax())
            langs[i], scores[i] = net.labels[best], float(min(1.0, total[i][best] / s)) if s > 0 else 0.0
    return langs, scores


def identify(docs: DataFrame, net: Network | None, carry: Sequence[str] = (), names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Per row of ``docs`` (text): the columns ``carry``, then the language and its score under ``names``."""
    model = docs.sparkSession.sparkContext.broadcast(pickle.dumps(net))  # fixed size: classes x filters
    carry = [c for c in carry if c not in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pickle.loads(model.value)
        for batch in batches:
            for part in chunks(batch, "__text"):
                langs, scores = predict_batch(own, part.column(part.num_columns - 1).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*carry, *names])

    schema = T.StructType([*(docs.schema[c] for c in carry), T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])
    return docs.select(*carry, F.col("text").alias("__text")).mapInArrow(run, schema)

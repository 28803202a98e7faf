"""Quality classifier: Naive Bayes support vectors.

Features are indicators of hashed n-grams: 3-byte n-grams, 2- to 5-grams of the
text's sequence of character classes, and 6-grams of whether a word equals the
one before.  Each indicator is scaled by the log ratio of its smoothed
frequency in the two classes, and a linear hinge-loss model on the scaled
indicators is fitted by dual coordinate descent.  The score is the logistic
function of twice the margin.

The model is fitted on a bounded sample of the labelled rows (SAMPLE rows, in
the order of a hash of doc_id); every row of documents is scored, over its
whole text.

Defined results: null texts score like empty ones (by the bias); rows whose
label is null, or whose doc_id is null, are not learnt from; repeated rows are
repeated examples, up to the sample's bound; without examples of both classes
the score is the share of label 1 among the examples (0.5 without any).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import SPACE, U, gram_hashes, mix, slices, utf8, word_hashes, words

SAMPLE = 12000     # labelled rows that a model is fitted on, at most
BITS = 18          # of a feature's number
SMOOTH, COST, ROUNDS = 1.0, 1.0, 8

#: Classes of bytes: lower-case or non-ASCII letter, capital, digit, space, line end; other bytes by themselves.
_CLASS = np.array([1 if 97 <= c <= 122 or c > 127 else 2 if 65 <= c <= 90 else 3 if 48 <= c <= 57 else 4 if c in (32, 9, 11, 12, 13) else 5 if c == 10 else 6 + c for c in range(256)], np.uint8)


def _numbers(x: np.ndarray, family: int) -> np.ndarray:
    return (mix(x.astype(U) + U(family << 56)) >> U(64 - BITS)).astype(np.int64)


def row_features(data: np.ndarray, off: np.ndarray) -> Iterator[np.ndarray]:
    """The numbers of each row's features, ascending."""
    mark = np.zeros(1 << BITS, bool)
    s, e, row = words(data, off, SPACE)
    h = word_hashes(data, s, e)
    cut = np.searchsorted(row, np.arange(len(off)))
    for r in range(len(off) - 1):
        text = data[off[r]:off[r + 1]]
        d = text.astype(np.int64)
        if len(d) > 2:
            mark[_numbers((d[:-2] << 16) | (d[1:-1] << 8) | d[2:], 1)] = True
        kinds = _CLASS[text]
        if len(kinds):
            kinds = kinds[np.append(True, kinds[1:] != kinds[:-1])].astype(U)
        for n in (2, 3, 4, 5):
            mark[_numbers(gram_hashes(kinds, n) >> U(8), n)] = True
        w = h[cut[r]:cut[r + 1]]
        if len(w) > 6:
            same = np.lib.stride_tricks.sliding_window_view(w[1:] == w[:-1], 6) @ (1 << np.arange(6))
            mark[_numbers(same, 6)] = True
        found = np.flatnonzero(mark)
        mark[found] = False
        yield found


@dataclass
class Model:
    """Weights of the features and the bias, or one score for all rows."""

    weight: np.ndarray
    bias: float
    always: float | None = None

    def scores(self, texts: pa.Array) -> np.ndarray:
        out = np.full(len(texts), np.nan if self.always is None else self.always)
        if self.always is None:
            for i, _, data, off in slices(utf8(texts)):
                for r, f in enumerate(row_features(data, off)):
                    out[i + r] = 1 / (1 + np.exp(-np.clip(2 * (self.weight[f].sum() + self.bias), -500, 500)))
        return out


def hinge(rows: list[np.ndarray], label: np.ndarray) -> Model:
    """Log-count ratios, then dual coordinate descent on the hinge loss; a
    class's rows share its cost, so that both classes weigh the same."""
    good = label == 1
    count = np.full((2, 1 << BITS), SMOOTH)
    for f, y in zip(rows, good):
        count[int(y), f] += 1
    ratio = np.log(count[1] / count[1].sum()) - np.log(count[0] / count[0].sum())
    sign = np.where(good, 1.0, -1.0)
    most = COST * len(rows) / (2 * np.where(good, good.sum(), (~good).sum()))
    values = [ratio[f] for f in rows]
    norm = np.array([float(v @ v) + 1 for v in values])
    weight, bias, dual = np.zeros(1 << BITS), 0.0, np.zeros(len(rows))
    order = np.random.default_rng(0)
    for _ in range(ROUNDS):
        for i in order.permutation(len(rows)):
            f, v = rows[i], values[i]
            slope = sign[i] * (float(weight[f] @ v) + bias) - 1
            new = min(max(dual[i] - slope / norm[i], 0.0), most[i])
            if new != dual[i]:
                step = (new - dual[i]) * sign[i]
                weight[f] += step * v
                bias += step
                dual[i] = new
    return Model((weight * ratio).astype(np.float32), bias)


def _example_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, data, off in slices(utf8(batch["text"])):
            got = [f.astype("<u4").tobytes() for f in row_features(data, off)]
            yield pa.RecordBatch.from_arrays([batch["label"].slice(i, j - i), pa.array(got, pa.binary())], ["label", "features"])


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Rows that are never learnt from: crc32 of doc_id as text, mod 5, is 0."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on up to `sample` rows of labels(doc_id, quality) that are not held out."""
    some = (labels.filter(~held_out()).filter(F.col("quality").isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label"))
            .orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(sample))
    rows = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(some), "doc_id")
            .mapInArrow(_example_batches, "label int, features binary").orderBy(F.xxhash64("features"), "label").limit(sample).collect())
    label = np.array([r.label for r in rows])
    if not len(rows) or label.min() == label.max():
        return Model(np.zeros(0, np.float32), 0.0, float(label.mean()) if len(rows) else 0.5)
    return hinge([np.frombuffer(r.features, "<u4").astype(np.int64) for r in rows], label)


def score(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """docs with the model's score of `text` as double `column`."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sent.value.scores(batch["text"]))], [*batch.schema.names, column])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())]))

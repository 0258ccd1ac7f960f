"""Quality classifier: naive Bayes features for a linear hinge-loss model fitted by dual coordinate descent."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from worklens.llm.common import Words, fingerprints, mixed, slices
from worklens.llm.samples import fitted, labelled_documents
from worklens.session import written

BITS = 20
#: Added to the squared length of a document's feature vector: a text of a few words stays near the bias.
LENGTH_PRIOR = 2000.0
#: Text whose n-grams are in memory at once, some thirty times its size.
SLICE_BYTES = 2 << 20


def _ngrams(codes: np.ndarray, ends: np.ndarray, n: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the n-grams that stay inside a row, and their hashes."""
    at = np.flatnonzero(np.arange(len(codes)) + n <= ends)
    key = np.full(len(at), salt, dtype=np.uint64)
    for k in range(n):
        key = mixed(key + codes[at + k])
    return at, key


def indicators(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and feature of every n-gram that a text holds, each once.

    Features are hashed words, pairs of words, and one to three neighbouring word
    shapes: letters by case, digits, and signs as they stand.
    """
    words = Words(texts, lower=False)
    if not len(words.codes):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    shapes = words.distinct
    for pattern, letter in ((r"\p{Lu}+", "A"), (r"[\p{Ll}\p{Lo}\p{Lt}\p{Lm}]+", "a"), (r"\p{N}+", "0")):
        shapes = pc.replace_substring_regex(shapes, pattern, letter)
    shapes = shapes.dictionary_encode()
    shape = fingerprints(shapes.dictionary)[shapes.indices.to_numpy(zero_copy_only=False)][words.codes]
    word = fingerprints(pc.utf8_lower(words.distinct))[words.codes]
    rows = words.rows()
    ends = words.offsets[1:][rows]
    keys = []
    for salt, (codes, n) in enumerate(((word, 1), (word, 2), (shape, 1), (shape, 2), (shape, 3)), 1):
        at, key = _ngrams(codes, ends, n, salt)
        keys.append(rows[at] << BITS | (key >> np.uint64(64 - BITS)).astype(np.int64))
    found = np.concatenate(keys)
    found.sort()
    found = found[np.concatenate(([True], found[1:] != found[:-1]))]
    return found >> BITS, found & ((1 << BITS) - 1)


def log_count_ratio(features: list[np.ndarray], labels: np.ndarray, smoothing: float = 1.0) -> np.ndarray:
    """Log ratio of a feature's share among the documents of label 1 and of label 0; 0 for unseen features."""
    counts = np.zeros((2, 1 << BITS))
    for f, y in zip(features, labels.tolist()):
        counts[int(y > 0), f] += 1
    seen = counts.sum(axis=0) > 0
    # Shares of documents rather than of counts: classes of any size and length compare.
    sizes = np.array([max(1, int((labels <= 0).sum())), max(1, int((labels > 0).sum()))])[:, None]
    share = (counts + smoothing) / (sizes + 2 * smoothing)
    odds = np.log(share / (1 - share))
    return np.where(seen, odds[1] - odds[0], 0.0)


def dual_coordinate_descent(
    features: list[np.ndarray], values: list[np.ndarray], labels: np.ndarray, cost: np.ndarray, epochs: int = 30, seed: int = 1
) -> tuple[np.ndarray, float]:
    """Weights and bias of the linear model with hinge loss; one dual variable per document, kept within its cost."""
    w, bias = np.zeros(1 << BITS), 0.0
    alpha = np.zeros(len(labels))
    diagonal = np.array([v @ v + 1.0 for v in values])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        largest = 0.0
        for i in rng.permutation(len(labels)).tolist():
            f, v, y = features[i], values[i], labels[i]
            gradient = y * (w[f] @ v + bias) - 1.0
            new = min(max(alpha[i] - gradient / diagonal[i], 0.0), cost[i])
            step = (new - alpha[i]) * y
            if step:
                w[f] += step * v
                bias += step
                largest = max(largest, abs(step))
                alpha[i] = new
        if largest < 1e-4:
            break
    return w, bias


def _scaled(features: list[np.ndarray], ratio: np.ndarray) -> list[np.ndarray]:
    out = []
    for f in features:
        v = ratio[f]
        out.append(v / np.sqrt(v @ v + LENGTH_PRIOR))
    return out


def _sigmoid_fit(margins: np.ndarray, labels: np.ndarray, weights: np.ndarray, steps: int = 200) -> tuple[float, float]:
    """Slope and offset of the logistic curve from margin to probability (Newton steps on two numbers)."""
    a, b = 1.0, 0.0
    positive = (labels > 0).astype(float)
    x = np.stack([margins, np.ones_like(margins)])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        gradient = x @ (weights * (p - positive)) + 1e-3 * np.array([a - 1.0, b])
        curvature = (x * (weights * p * (1 - p))) @ x.T + 1e-3 * np.eye(2)
        step = np.linalg.solve(curvature, gradient)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return max(a, 1e-3), b


class QualityModel:
    """Weights per feature and the curve from margin to score.

    ``odds`` is the number of documents of label 1 for one of label 0.
    """

    def __init__(self, features: list[np.ndarray], labels: np.ndarray, odds: float = 1.0, penalty: float = 10.0):
        # Both classes weigh the same, however few documents one has.
        share = np.array([(labels == s).mean() if (labels == s).any() else 1.0 for s in (-1, 1)])
        weights = np.where(labels > 0, 0.5 / share[1], 0.5 / share[0])
        margins = np.zeros(len(labels))
        order = np.random.default_rng(0).permutation(len(labels))
        for part in range(3):
            test = order[part::3]
            train = np.setdiff1d(order, test)
            w, bias, ratio = self._fitted([features[i] for i in train], labels[train], penalty * weights[train])
            margins[test] = [w[f] @ v + bias for f, v in zip((features[i] for i in test), _scaled([features[i] for i in test], ratio))]
        self.slope, self.offset = _sigmoid_fit(margins, labels, weights)
        # The sample says nothing about how frequent a label is; the labels as a whole do.
        self.offset += np.log(odds)
        w, self.bias, ratio = self._fitted(features, labels, penalty * weights)
        self.weight, self.square = (w * ratio).astype(np.float32), (ratio * ratio).astype(np.float32)

    @staticmethod
    def _fitted(features: list[np.ndarray], labels: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
        ratio = log_count_ratio(features, labels)
        w, bias = dual_coordinate_descent(features, _scaled(features, ratio), labels, cost)
        return w, bias, ratio

    def scores(self, texts: pa.Array) -> np.ndarray:
        rows, found = indicators(texts)
        total = np.bincount(rows, self.weight[found], len(texts))
        norm = np.sqrt(np.bincount(rows, self.square[found], len(texts)) + LENGTH_PRIOR)
        margin = total / norm + self.bias
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -30, 30)))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    where: Column,
    per_label: int = 1500,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "quality",
) -> QualityModel | None:
    """The model of the labelled documents for which ``where`` holds; none without labels.

    ``per_label`` bounds the documents of each label that the model is fitted on; they
    are fitted by one executor task and only the weights come to the driver. A document with labels of both kinds
    counts as label 0; null labels and labels without a document are left out. How
    frequent the labels are is counted over all of them.
    """
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    marks = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("label")).dropna()
    marks = marks.groupBy("doc_id").agg(F.min("label").alias("label")).filter(where)
    # A label counts only where its document is there.
    marks = written(marks.join(own.select("doc_id").distinct(), "doc_id"), "labels")
    good, bad = marks.agg(F.count_if(F.col("label") > 0), F.count_if(F.col("label") <= 0)).first()
    odds = max(good, 1) / max(bad, 1)
    return fitted(labelled_documents(own, marks, per_label), lambda sample: _built(sample, odds))


def _built(sample: pa.Table, odds: float) -> QualityModel:
    rows = []
    for batch in slices(iter(sample.combine_chunks().to_batches()), "text", SLICE_BYTES):
        row, found = indicators(batch.column("text"))
        cuts = np.searchsorted(row, np.arange(batch.num_rows + 1))
        parts = [found[a:b].astype(np.int64) for a, b in zip(cuts, cuts[1:])]
        rows += zip(batch.column("doc_id").to_pylist(), parts, batch.column("label").to_pylist())
    rows.sort(key=lambda r: (r[0], r[1].astype(np.int32).tobytes()))
    return QualityModel([f for _, f, _ in rows], np.array([1 if y > 0 else -1 for _, _, y in rows]), odds)


def with_quality(docs: DataFrame, model: QualityModel | None, text: str = "text", into: str = "score") -> DataFrame:
    """The documents with the score of their whole text, 0 to 1; a column of that name is replaced.

    Null and empty texts hold no n-gram and get the model's base score; without a model
    every score is 0.5. Equal texts score alike. Rows are scored where they are.
    """
    kept = docs.drop(into)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = kept.columns.index(text)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, SLICE_BYTES):
            own = shared.value
            score = np.full(batch.num_rows, 0.5) if own is None else own.scores(batch.column(place))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64())], names=[*batch.schema.names, into])

    return kept.mapInArrow(scored, T.StructType([*kept.schema.fields, T.StructField(into, T.DoubleType())]))

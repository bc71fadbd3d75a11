"""Quality by logistic regression over hashed word n-grams, fitted with follow-the-regularised-leader updates.

Tokens are runs of letters and digits and runs of marks, case kept; features
are single tokens, pairs of neighbours, and for a pair of equal neighbours the
one pair that stands for all such. A feature's value is its share of the
text's tokens, so a score is a sparse dot product of shares and weights.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from epistride.llm import labelled
from epistride.llm.labelled import Sample, sigmoid
from epistride.llm.terms import LETTERS_AND_MARKS, Tokens, mixed, parts

#: Features are hashed to so many bits.
BITS = 20
#: A feature's value is this times its share of the text's tokens.
SCALE = 30.0
EPOCHS = 3
THRESHOLD = 0.3
_SAME = 0x5A5A


def _each_feature(texts: list[bytes]):
    """(row, hashed feature) of every token and pair, for part after part of the texts."""
    for data, rows, at in parts(texts, LETTERS_AND_MARKS):
        tokens = Tokens(data, LETTERS_AND_MARKS)
        row = rows[np.searchsorted(at, tokens.starts, "right") - 1]
        word = tokens.hashes()
        yield row, (word >> np.uint64(64 - BITS)).astype(np.int64), True
        together = row[1:] == row[:-1]
        pair = mixed(word[:-1] * np.uint64(3) + word[1:])
        pair = np.where(word[1:] == word[:-1], mixed(np.full(1, _SAME, np.uint64)), pair)[together]
        yield row[1:][together], (pair >> np.uint64(64 - BITS)).astype(np.int64), False


def features(texts: list[bytes]) -> list[np.ndarray]:
    """For each text, its features in order of the hash, each as often as it occurs, the number of tokens first."""
    found, tokens = [], np.zeros(len(texts), np.int64)
    for row, feature, single in _each_feature(texts):
        found.append(row << BITS | feature)
        if single:
            tokens += np.bincount(row, minlength=len(texts))
    every = np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)
    edges = np.searchsorted(every, np.arange(len(texts) + 1, dtype=np.int64) << BITS)
    plain = (every & ((1 << BITS) - 1)).astype(np.uint32)
    return [np.r_[np.uint32(n), plain[a:b]] for n, a, b in zip(tokens, edges, edges[1:])]


def counted_features(texts: list[bytes]) -> list[np.ndarray]:
    """The same with each feature once: the number of tokens, the features, and how often each occurs."""
    out = []
    for found in features(texts):
        feature, count = np.unique(found[1:], return_counts=True)
        out.append(np.concatenate([found[:1], feature, count.astype(np.uint32)]))
    return out


@dataclass
class Regression:
    bias: float
    weights: np.ndarray

    def __call__(self, texts: list[bytes]) -> np.ndarray:
        total, tokens = np.zeros(len(texts)), np.zeros(len(texts))
        for row, feature, single in _each_feature(texts):
            total += np.bincount(row, self.weights[feature], len(texts))
            if single:
                tokens += np.bincount(row, minlength=len(texts))
        return sigmoid(self.bias + SCALE * total / np.maximum(tokens, 1))


def fit(data: Sample, epochs: int = EPOCHS, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01, seed: int = 3) -> Regression:
    """Follow the regularised leader, coordinate by coordinate, text after text; features as ``counted_features`` gives them.

    With a single label or no rows the weights stay 0 and every text gets the
    smoothed share of label 1.
    """
    share = (float((data.labels * data.weights).sum()) + 1) / (float(data.weights.sum()) + 2)
    bias = float(np.log(share / (1 - share)))
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    if len(np.unique(data.labels)) < 2:
        return Regression(bias, np.zeros(1 << BITS, np.float32))

    def sparse_row(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        feature, count = np.split(found[1:], 2)
        return feature, (SCALE * count / max(1, int(found[0]))).astype(np.float32)

    sparse = [sparse_row(f) for f in data.features]
    rng = np.random.default_rng(seed)
    bias_n = 0.0

    def leader(zi, ni):
        return np.where(np.abs(zi) <= l1, 0.0, (np.sign(zi) * l1 - zi) / ((beta + np.sqrt(ni)) / alpha + l2))

    for _ in range(epochs):
        for row in rng.permutation(len(data)):
            i, x = sparse[row][0], sparse[row][1].astype(np.float64)
            zi, ni = z[i], n[i]
            w = leader(zi, ni)
            error = float(data.weights[row]) * (float(sigmoid(np.array(bias + w @ x))) - float(data.labels[row]))
            g = error * x
            z[i] += g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha * w
            n[i] += g * g
            bias_n += error * error
            bias -= 0.1 * error / (1 + np.sqrt(bias_n))
    return Regression(bias, leader(z, n).astype(np.float32))


def train(docs: DataFrame, labels: DataFrame, allowed: Column | None = None, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text",
          rows_per_label: int = labelled.ROWS_PER_LABEL) -> Regression:
    """Fit on at most ``rows_per_label`` texts of either label; the model has a fixed size."""
    allowed = F.lit(True) if allowed is None else allowed
    return fit(labelled.sample(docs, labels, label_col, allowed, counted_features, rows_per_label, id_col, text_col))


def scores(docs: DataFrame, model: Regression, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row, 0 to 1; a null or empty text has no feature and gets the bias' score."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    return labelled.scored(docs, lambda texts: held.value(texts), id_col, text_col)

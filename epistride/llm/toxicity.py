"""Toxicity by a factorization machine over hashed terms.

A text's terms are its words and the beginnings of its words. A linear weight
for each term and the inner products of the terms' factors give the score, so
that two terms together can weigh more (or less) than they do apart.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from epistride.llm import labelled
from epistride.llm.labelled import Sample, sigmoid
from epistride.llm.terms import LETTERS, Tokens, parts

#: Terms are hashed to so many bits.
BITS = 20
#: Whole words (None) and their first bytes.
STEMS = (None, 4, 5, 6)
#: Terms that the machine may use: those that tell most about the label in the sample.
TERMS = 4096
#: Twice the logarithm of the likelihood ratio that a term must reach; chance gives some sixty in a million.
EVIDENCE = 16.0
FACTORS = 8
EPOCHS = 24
THRESHOLD = 0.7

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _each_term(texts: list[bytes]):
    """(row of each term, hashed term), for part after part of the texts."""
    for data, rows, at in parts(texts, LETTERS):
        tokens = Tokens(data.translate(_LOWER), LETTERS)
        row = rows[np.searchsorted(at, tokens.starts, "right") - 1]
        for number, longest in enumerate(STEMS):
            yield row, (tokens.hashes(longest, number) >> np.uint64(64 - BITS)).astype(np.int64)


def distinct_terms(texts: list[bytes]) -> list[np.ndarray]:
    """The distinct hashed terms of each text."""
    pairs = [row << BITS | term for row, term in _each_term(texts)]
    unique = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
    edges = np.searchsorted(unique, np.arange(len(texts) + 1, dtype=np.int64) << BITS)
    terms = (unique & ((1 << BITS) - 1)).astype(np.uint32)
    return [terms[a:b] for a, b in zip(edges, edges[1:])]


@dataclass
class Machine:
    """``place`` gives a hashed term's row in ``linear`` and ``factors``, -1 where it is not used."""

    place: np.ndarray
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def __getstate__(self) -> dict:
        used = np.flatnonzero(self.place >= 0)
        return {**self.__dict__, "place": (len(self.place), used, self.place[used])}

    def __setstate__(self, state: dict) -> None:
        size, used, at = state["place"]
        self.__dict__.update(state, place=np.full(size, -1, np.int32))
        self.place[used] = at

    def __call__(self, texts: list[bytes]) -> np.ndarray:
        found = []
        for row, term in _each_term(texts):
            at = self.place[term]
            used = at >= 0
            found.append(row[used] * len(self.linear) + at[used])
        z = np.full(len(texts), self.bias)
        if found and len(self.linear):
            pairs = np.unique(np.concatenate(found))
            row, at = np.divmod(pairs, len(self.linear))
            z += np.bincount(row, self.linear[at], len(texts))
            for f in range(self.factors.shape[1]):
                v = self.factors[at, f]
                z += 0.5 * (np.bincount(row, v, len(texts)) ** 2 - np.bincount(row, v * v, len(texts)))
        return sigmoid(z)


def telling_terms(data: Sample, most: int = TERMS, evidence: float = EVIDENCE) -> np.ndarray:
    """The hashed terms that tell most about the label, by the likelihood ratio of their presence.

    Terms below ``evidence`` are spread over the labels as chance may spread them.
    """
    counts = [np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64)]
    for found, label in zip(data.features, data.labels):
        counts[int(label)][found] += 1  # a text's terms are distinct
    n = [max(1, int((data.labels == label).sum())) for label in (0, 1)]
    total = counts[0] + counts[1]
    ratio = np.zeros(1 << BITS)
    with np.errstate(divide="ignore", invalid="ignore"):
        for seen, size in zip(counts, n):
            for part, whole in ((seen, total), (size - seen, sum(n) - total)):
                ratio += np.where(part > 0, 2 * part * np.log(part / (whole * (size / sum(n)))), 0)
    order = np.argsort(-ratio, kind="stable")[:most]
    return order[ratio[order] >= evidence]


def with_telling_terms(rows: DataFrame, most: int = TERMS, evidence: float = EVIDENCE) -> DataFrame:
    """The sample's rows (id, label, found) with no terms but those that ``telling_terms`` may choose.

    The likelihood ratios are computed where the rows are; only the chosen
    terms, twice as many as the machine uses, come to the driver.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.frombuffer(f, "<u4") for f in batch.column("found").to_pylist()]
            label = np.repeat(batch.column("label").to_numpy(), [len(f) for f in found])
            term, place = np.unique(np.concatenate([np.zeros(0, "<u4"), *found]), return_inverse=True)
            seen = [np.bincount(place[label == one], minlength=len(term)) for one in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in (term, *seen)], names=["term", "seen_0", "seen_1"])

    sizes = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    n = [max(1, sizes.get(label, 0)) for label in (0, 1)]
    terms = rows.select("label", "found").mapInArrow(counted, "term long, seen_0 long, seen_1 long")
    terms = terms.groupBy("term").agg(F.sum("seen_0").alias("seen_0"), F.sum("seen_1").alias("seen_1"))
    total, ratio = F.col("seen_0") + F.col("seen_1"), F.lit(0.0)
    for seen, size in ((F.col("seen_0"), n[0]), (F.col("seen_1"), n[1])):
        for part, whole in ((seen, total), (size - seen, sum(n) - total)):
            ratio = ratio + F.when(part > 0, 2 * part * F.ln(part / (whole * (size / sum(n))))).otherwise(0.0)
    told = terms.withColumn("ratio", ratio).filter(F.col("ratio") >= evidence * (1 - 1e-9)).orderBy(F.desc("ratio"), "term").limit(2 * most)
    chosen = np.sort(np.array([r.term for r in told.select("term").collect()], np.uint32))

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.frombuffer(f, "<u4") for f in batch.column("found").to_pylist()]
            found = pa.array([f[np.isin(f, chosen)].tobytes() for f in found], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), found], names=["id", "label", "found"])

    return rows.mapInArrow(kept, rows.schema)


def fit(
    data: Sample, most: int = TERMS, factors: int = FACTORS, epochs: int = EPOCHS, seed: int = 5, evidence: float = EVIDENCE,
    rate: float = 0.01, decay: tuple[float, float] = (1e-4, 1e-2),
) -> Machine:
    """A machine for the sample; without both labels it gives their share to every text."""
    share = (float((data.labels * data.weights).sum()) + 1) / (float(data.weights.sum()) + 2)
    place = np.full(1 << BITS, -1, np.int32)
    terms = telling_terms(data, most, evidence) if len(np.unique(data.labels)) == 2 else np.zeros(0, np.int64)
    place[terms] = np.arange(len(terms))
    rng = np.random.default_rng(seed)
    state = [np.zeros(1), np.zeros(len(terms)), rng.normal(0, 0.01, (len(terms), factors))]
    state[0][0] = np.log(share / (1 - share))
    used = [place[f][place[f] >= 0] for f in data.features]
    first, second, step = [np.zeros_like(s) for s in state], [np.zeros_like(s) for s in state], 0
    for _ in range(epochs if len(terms) else 0):
        for rows in np.array_split(rng.permutation(len(data)), max(1, len(data) // 128)):
            x = np.zeros((len(rows), len(terms)))
            for i, r in enumerate(rows):
                x[i, used[r]] = 1
            inner = x @ state[2]
            z = state[0][0] + x @ state[1] + 0.5 * ((inner**2).sum(1) - (x @ state[2] ** 2).sum(1))
            error = (sigmoid(z) - data.labels[rows]) * data.weights[rows] / len(rows)
            slopes = [
                np.array([error.sum()]),
                x.T @ error + decay[0] * state[1],
                x.T @ (error[:, None] * inner) - (x.T @ error)[:, None] * state[2] + decay[1] * state[2],
            ]
            step += 1
            for s, g, m, v in zip(state, slopes, first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                s -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Machine(place, float(state[0][0]), state[1], state[2])


def train(docs: DataFrame, labels: DataFrame, allowed: Column | None = None, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text",
          rows_per_label: int = labelled.ROWS_PER_LABEL) -> Machine:
    """Fit on at most ``rows_per_label`` texts of either label; the model has a fixed size."""
    allowed = F.lit(True) if allowed is None else allowed
    return fit(labelled.sample(docs, labels, label_col, allowed, distinct_terms, rows_per_label, id_col, text_col, reduced=with_telling_terms))


def scores(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row, 0 to 1; a null or empty text gets the score of no term."""
    held = docs.sparkSession.sparkContext.broadcast(machine)
    return labelled.scored(docs, lambda texts: held.value(texts), id_col, text_col)


def accepted(docs: DataFrame, machine: Machine, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows below the threshold, all columns kept."""
    held = docs.sparkSession.sparkContext.broadcast(machine)
    return labelled.kept_below(docs, lambda texts: held.value(texts), threshold, text_col)

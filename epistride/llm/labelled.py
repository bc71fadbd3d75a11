"""Bounded samples of labelled texts for fitting a classifier."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from epistride.llm.arrow import prepared, slices
from epistride.session import stored

#: A classifier is fitted on at most so many rows of either label.
ROWS_PER_LABEL = 4_000
#: And on at most so many bytes of features of either label.
BYTES_PER_LABEL = 32 << 20


def folded(doc_id: Column, folds: int) -> Column:
    """crc32 of the id's text modulo ``folds``; a null id counts as the empty text."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds).cast("int")


@dataclass
class Sample:
    features: list[np.ndarray]
    labels: np.ndarray
    weights: np.ndarray

    def __len__(self) -> int:
        return len(self.features)


def sample(
    docs: DataFrame,
    labels: DataFrame,
    label_col: str,
    allowed: Column,
    extract: Callable[[list[bytes]], list[np.ndarray]],
    rows_per_label: int = ROWS_PER_LABEL,
    id_col: str = "doc_id",
    text_col: str = "text",
    seed: int = 11,
    reduced: Callable[[DataFrame], DataFrame] | None = None,
    bytes_per_label: int = BYTES_PER_LABEL,
) -> Sample:
    """Features of at most ``rows_per_label`` texts of either label, drawn by a seeded hash of the id.

    ``allowed`` says which rows of ``labels`` may be learnt from. Labels other
    than 0 and 1 and ids with both labels are left out; of rows that repeat an
    id one counts. ``extract`` runs in the tasks and gives one uint32 array for
    each text, ``reduced`` may thin these out over all rows (id, label, found)
    before they leave the tasks. Where the features take more than
    ``bytes_per_label``, fewer texts are taken. Weights bring the labels back
    to their shares among all allowed rows.
    """
    spark = docs.sparkSession
    known = labels.filter(allowed).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    known = known.filter("id is not null and label in (0, 1)").groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("other"))
    known = known.filter("label = other").select("id", "label")
    counts = {r.label: r["count"] for r in known.groupBy("label").count().collect()}
    drawn = None
    for label in counts:
        part = known.filter(F.col("label") == label).orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(rows_per_label)
        drawn = part if drawn is None else drawn.union(part)
    if drawn is None:
        return Sample([], np.zeros(0, np.float32), np.zeros(0, np.float32))
    # At most 2 * rows_per_label ids and labels.
    chosen = spark.createDataFrame(drawn.collect(), drawn.schema)
    texts = prepared(docs, id_col, text_col).join(F.broadcast(chosen), "id").select("id", "label", "text")
    kind = texts.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in slices(batches):
            found = [f.astype("<u4").tobytes() for f in extract(batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(found, pa.binary())], names=["id", "label", "found"])

    rows = texts.mapInArrow(run, f"id {kind}, label int, found binary").groupBy("id", "label").agg(F.min("found").alias("found"))
    rows = stored(rows, "sample")
    rows = rows if reduced is None else reduced(rows)
    rows = _within(rows, bytes_per_label, seed).orderBy("id").collect()
    seen = {label: sum(r.label == label for r in rows) for label in counts}
    weight = {label: counts[label] / max(1, seen[label]) for label in counts}
    scale = sum(seen.values()) / max(1, sum(counts.values()))
    return Sample(
        [np.frombuffer(r.found, "<u4") for r in rows],
        np.array([r.label for r in rows], np.float32),
        np.array([weight[r.label] * scale for r in rows], np.float32),
    )


def _within(rows: DataFrame, bytes_per_label: int, seed: int) -> DataFrame:
    """The sample's rows, or where a label's features take more than so many bytes, as many of them as fit, in seeded order."""
    total = rows.groupBy("label").agg(F.sum(F.octet_length("found")).alias("bytes"))
    if total.filter(F.col("bytes") > bytes_per_label).isEmpty():
        return rows
    # A few thousand ids and sizes.
    listed = rows.select("id", "label", F.octet_length("found").alias("size")).orderBy("label", F.xxhash64(F.lit(seed), "id"), "id").collect()
    kept, used = [], {}
    for r in listed:
        used[r.label] = used.get(r.label, 0) + r.size
        if used[r.label] <= bytes_per_label:
            kept.append((r.id,))
    chosen = rows.sparkSession.createDataFrame(kept, f"id {rows.schema['id'].dataType.simpleString()}")
    return rows.join(F.broadcast(chosen), "id")


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def scored(
    docs: DataFrame, score: Callable[[list[bytes]], np.ndarray], id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, score) of every row; ``score`` maps texts to numbers and runs in the tasks."""
    plain = prepared(docs, id_col, text_col)
    kind = plain.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in slices(batches):
            values = np.asarray(score(batch.column("text").to_pylist()), np.float64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(values)], names=["id", "score"])

    return plain.mapInArrow(run, f"id {kind}, score double")


def kept_below(docs: DataFrame, score: Callable[[list[bytes]], np.ndarray], threshold: float, text_col: str = "text") -> DataFrame:
    """The rows whose text scores below ``threshold``, with all columns; one pass, no shuffle."""
    place = docs.columns.index(text_col)

    def run(batches):
        for batch in slices(batches, place):
            texts = [(t or "").encode() for t in batch.column(place).to_pylist()]
            yield batch.filter(pa.array(np.asarray(score(texts)) < threshold))

    return docs.mapInArrow(run, docs.schema)

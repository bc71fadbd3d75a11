"""Small helpers for work on Arrow batches inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

#: A task works on so many bytes of text at a time; one longer text makes a slice of its own.
SLICE_BYTES = 2 << 20


def prepared(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The id and the whole text as UTF-8 bytes (null: empty), under names of our own; other columns go."""
    return df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"))


def slices(
    batches: Iterator[pa.RecordBatch], column: str | int = "text", limit: int = SLICE_BYTES, inside: str | None = None
) -> Iterator[pa.RecordBatch]:
    """The same rows in order, in batches of about ``limit`` bytes of ``column``, or of its field ``inside``."""
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column(column)
        if inside is not None:
            texts = texts.field(inside)
        size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        block = (np.cumsum(size) - size) // limit
        edges = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
        for start, end in zip(edges, edges[1:]):
            yield batch.slice(start, end - start)


def record_batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)

"""Batch scoring of windows by a user-supplied model."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Scorer = Callable[[pd.DataFrame], pd.DataFrame]


def uniform_batch(batch: pd.DataFrame, arrays: list[str]) -> None:
    """Raise when the windows of one batch cannot be stacked."""
    for name in arrays:
        present = batch[name].notna()
        if present.any() and not present.all():
            raise ValueError(f"batch mixes windows with and without {name!r}")
        if present.all() and batch[name].map(len).nunique() > 1:
            raise ValueError(f"batch mixes lengths of {name!r}")


def score_windows(
    windows: DataFrame, scorer: Scorer, schema: str, arrays: list[str] | None = None, carried: Sequence[str] = ()
) -> DataFrame:
    """Call ``scorer`` on Arrow batches of windows.

    ``carried`` columns of the windows, such as their targets, stand beside
    the scores of their row, so that no join has to bring them together again;
    the scorer sees none of them but those it asks for in ``arrays``.

    A batch has at most ``spark.sql.execution.arrow.maxRecordsPerBatch`` rows,
    so a task's memory does not grow with the data.
    """
    checked = list(arrays or [])
    kept = [f"`{n}` {windows.schema[n].dataType.simpleString()}" for n in carried]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in parts:
            if len(batch):
                uniform_batch(batch, checked)
                scored = scorer(batch.drop(columns=[n for n in carried if n not in checked]))
                yield scored.assign(**{name: batch[name].to_numpy() for name in carried}) if carried else scored

    return windows.mapInPandas(run, ", ".join([schema, *kept]))


def scored_positions(scored: DataFrame, value: str = "value", carried: Sequence[str] = ()) -> DataFrame:
    """One row per window and history position, with the arrays ``value`` and ``carried`` taken apart."""
    zipped = F.arrays_zip("frame_indices", value, *carried)
    return scored.select("episode_id", "sample_id", F.posexplode(zipped).alias("position", "cell")).select(
        "episode_id",
        "sample_id",
        "position",
        F.col("cell.frame_indices").alias("frame_index"),
        *[F.col("cell").getField(name).alias(name) for name in (value, *carried)],
    )


def completeness(processed: DataFrame, total: DataFrame) -> DataFrame:
    """One row: are there as many scored records as windows?  ``total`` is the
    one-row count from ``windows.total_windows``."""
    return processed.agg(F.count(F.lit(1)).alias("records")).withColumn(
        "windows", total.scalar()
    ).withColumn("complete", F.col("records") == F.col("windows"))

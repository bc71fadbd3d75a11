"""From a frame table to normalised training and validation windows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epistride.columns import COLUMNS, Columns
from epistride.operators import integrity, normalise, splits, windows
from epistride.session import stored


@dataclass(frozen=True)
class TrainingData:
    split: DataFrame
    statistics: DataFrame
    train: DataFrame
    validation: DataFrame


def prepare_training(
    frames: DataFrame,
    history: int,
    fraction: float = 0.1,
    seed: int = 42,
    split: DataFrame | None = None,
    batch: int = 1,
    vector: str | None = None,
    fields: tuple[str, ...] = (),
    c: Columns = COLUMNS,
) -> TrainingData:
    """Split by episode, fit on train only, standardise, and cut windows.

    A given ``split`` must be disjoint and cover all episodes.
    """
    vector = vector or c.action
    integrity.require_none(integrity.uneven_episodes(frames, c), "episodes are not consecutive", [c.episode])
    if split is None:
        split = stored(splits.seeded_split(frames, fraction, seed, c), "split")
    else:
        integrity.require_none(splits.split_overlap(split, c), "episodes on both sides", [c.episode])
        integrity.require_none(splits.split_coverage(split, frames, c), "split and episodes differ", [c.episode, "problem"])
    statistics = stored(normalise.fit_normalisation(frames, split, vector, c=c), "normalisation")
    # One row tells the size; the statistics, of all training rows, must have it too.
    some = frames.where(F.col(f"`{vector}`").isNotNull()).select(F.size(f"`{vector}`")).first()
    dimension = some[0] if some else 0
    integrity.require_none(normalise.statistics_problems(statistics, dimension), "normalisation", ["problem"])
    scaled = normalise.apply_normalisation(frames, statistics, vector, c)

    def cut(name: str) -> DataFrame:
        part = splits.select_split(scaled, split, name, c)
        return windows.history_windows(part, history, [vector, *fields], c)

    available = windows.total_windows(splits.select_split(frames, split, "train", c), history, c)
    gates = integrity.size_gates(available, batch)
    integrity.require_none(
        gates.where(~(F.col("any_window") & F.col("full_batch"))), "too few training windows", ["windows"]
    )
    return TrainingData(split, statistics, cut("train"), cut("val"))

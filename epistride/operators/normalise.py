"""Vector normalisation fitted on the training episodes only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epistride.columns import COLUMNS, Columns, named
from epistride.functions.scalars import all_finite, is_finite, standardise
from epistride.operators.splits import select_split

EPSILON = 1e-6


def dimension_moments(frames: DataFrame, vector: str) -> DataFrame:
    """(position, count, mean, std) over rows whose vector is wholly finite.

    The exploded rows meet the partial aggregate inside the scan stage, so
    only one row per dimension and task is shuffled.
    """
    finite = frames.select(named(vector).alias("v")).where(all_finite(F.col("v")))
    return (
        finite.select(F.posexplode("v").alias("position", "x"))
        .groupBy("position")
        .agg(
            F.count(F.lit(1)).alias("count"),
            F.avg(F.col("x").cast("double")).alias("mean"),
            F.stddev_pop(F.col("x").cast("double")).alias("std"),
        )
    )


def fit_normalisation(
    frames: DataFrame,
    split: DataFrame,
    vector: str | None = None,
    epsilon: float = EPSILON,
    c: Columns = COLUMNS,
) -> DataFrame:
    """One row ``(mean, std)`` of float arrays; std never below ``epsilon``."""
    moments = dimension_moments(select_split(frames, split, "train", c), vector or c.action)
    # One entry per vector dimension, so the row has a fixed size.
    ordered = moments.agg(
        F.sort_array(
            F.collect_list(
                F.struct(
                    "position", "mean", F.greatest(F.col("std"), F.lit(epsilon)).alias("std")
                )
            )
        ).alias("dims")
    )
    return ordered.select(
        F.transform("dims", lambda d: d["mean"].cast("float")).alias("mean"),
        F.transform("dims", lambda d: d["std"].cast("float")).alias("std"),
    )


def apply_normalisation(
    frames: DataFrame, stats: DataFrame, vector: str | None = None, c: Columns = COLUMNS
) -> DataFrame:
    """Standardise the vector column; null where dimensions differ."""
    vector = vector or c.action
    fitted = frames.withColumns(
        {"__mean": stats.select("mean").scalar(), "__std": stats.select("std").scalar()}
    )
    return fitted.withColumn(
        vector, standardise(named(vector), F.col("__mean"), F.col("__std"))
    ).drop("__mean", "__std")


def statistics_problems(stats: DataFrame, dimension: int) -> DataFrame:
    """Reasons why fitted statistics cannot be used, one row each."""
    wrong = {
        "missing": F.col("mean").isNull() | F.col("std").isNull(),
        "dimension": (F.size("mean") != dimension) | (F.size("std") != dimension),
        "not finite": ~F.forall("mean", is_finite) | ~F.forall("std", is_finite),
        "not positive": F.exists("std", lambda s: s <= 0),
    }
    listed = F.array(*[F.when(test, F.lit(name)) for name, test in wrong.items()])
    return stats.select(F.explode(F.array_compact(listed)).alias("problem"))


def vector_dimension(frames: DataFrame, vector: str) -> DataFrame:
    """Smallest and largest size of a vector column, and whether it is fixed."""
    sizes = F.size(named(vector))
    return frames.agg(F.min(sizes).alias("smallest"), F.max(sizes).alias("largest")).withColumn(
        "fixed", F.col("smallest") == F.col("largest")
    )

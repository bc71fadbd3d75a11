"""Episode summaries and integrity checks.

Every check returns the offending rows as a DataFrame.  ``require_none`` turns
a check into an error that names the first offenders.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epistride.columns import COLUMNS, Columns, named
from epistride.operators.bitmaps import number_sets
from epistride.operators.scans import blocked_scan, position_block, previous


class IntegrityError(ValueError):
    """Raised when a check finds offenders."""


def require_none(offenders: DataFrame, message: str, order: Sequence[str] | None = None, first: int = 10) -> None:
    """Raise when ``offenders`` has rows, naming the ``first`` in key order."""
    order = list(order or offenders.columns[:1])
    head = first_offenders(offenders, order, first).collect()
    if head:
        raise IntegrityError(f"{message}: {[tuple(row) for row in head]}")


def first_offenders(offenders: DataFrame, order: Sequence[str], first: int = 10) -> DataFrame:
    """The ``first`` distinct keys in order; Spark plans it as a top-k."""
    keys = [named(name) for name in order]
    return offenders.select(*keys).distinct().orderBy(*keys).limit(first)


def distinct_episodes(frames: DataFrame, c: Columns = COLUMNS) -> DataFrame:
    return frames.select(named(c.episode)).distinct()


def episode_summary(frames: DataFrame, c: Columns = COLUMNS) -> DataFrame:
    """Rows, first and last frame per episode."""
    return frames.groupBy(named(c.episode)).agg(
        F.count(F.lit(1)).alias("length"),
        F.min(named(c.frame)).alias("first_frame"),
        F.max(named(c.frame)).alias("last_frame"),
    )


def frame_spans(frames: DataFrame, c: Columns = COLUMNS) -> DataFrame:
    """First and last frame per episode."""
    return episode_summary(frames, c).drop("length")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their row count."""
    return (
        df.groupBy(*[named(k) for k in keys])
        .agg(F.count(F.lit(1)).alias("row_count"))
        .where(F.col("row_count") > 1)
    )


def episode_runs(frames: DataFrame, c: Columns = COLUMNS, block_rows: int = 1_000_000) -> DataFrame:
    """Number of contiguous runs of every episode in table order."""
    marked = blocked_scan(
        frames.select(named(c.index), named(c.episode)),
        [],
        position_block(named(c.index), block_rows),
        [c.index],
        {"before": previous(named(c.episode))},
    )
    starts = F.when(F.col("before").isNull() | (F.col("before") != named(c.episode)), 1).otherwise(0)
    return marked.groupBy(named(c.episode)).agg(
        F.sum(starts).alias("runs"), F.count(F.lit(1)).alias("length")
    )


def scattered_episodes(frames: DataFrame, c: Columns = COLUMNS, block_rows: int = 1_000_000) -> DataFrame:
    """Episodes that are not one contiguous run."""
    return episode_runs(frames, c, block_rows).where(F.col("runs") > 1)


def broken_steps(
    frames: DataFrame, step: str | None = None, c: Columns = COLUMNS, block_rows: int = 1_000_000
) -> DataFrame:
    """Rows whose step is not one more than the row before in the episode.

    Rows follow table order (``c.index``), which also places the blocks.
    """
    step = step or c.frame
    walked = blocked_scan(
        frames.select(named(c.episode), named(c.index), named(step)),
        [c.episode],
        position_block(named(c.index), block_rows),
        [c.index],
        {"step_before": previous(named(step))},
    )
    return walked.where(named(step) - F.col("step_before") != 1)


def uneven_episodes(frames: DataFrame, c: Columns = COLUMNS) -> DataFrame:
    """Episodes whose frames are not one gap-free, duplicate-free range.

    Needs no table order, and one group for every 64 frames: the cheap gate
    before work that relies on consecutive frames.
    """
    counted = number_sets(frames, [c.episode], c.frame)
    return counted.select(
        named(c.episode), "length", F.col("distinct").alias("distinct_frames"), F.col("first").alias("first_frame"), F.col("last").alias("last_frame")
    ).where(
        (F.col("length") != F.col("distinct_frames"))
        | (F.col("last_frame") - F.col("first_frame") + 1 != F.col("distinct_frames"))
    )


def span_mismatches(frames: DataFrame, c: Columns = COLUMNS) -> DataFrame:
    """Episodes whose frame span differs from their row count."""
    return episode_summary(frames, c).where(
        F.col("last_frame") - F.col("first_frame") + 1 != F.col("length")
    )


def multi_task_episodes(frames: DataFrame, c: Columns = COLUMNS) -> DataFrame:
    """Episodes that carry more than one task."""
    return (
        frames.groupBy(named(c.episode))
        .agg(F.countDistinct(named(c.task)).alias("tasks"))
        .where(F.col("tasks") > 1)
    )


def zero_based(frames: DataFrame, c: Columns = COLUMNS) -> DataFrame:
    """One row: are the episode ids exactly 0..n-1?"""
    ids = number_sets(frames, [], c.episode)
    return ids.select(
        F.coalesce(F.col("distinct"), F.lit(0)).cast("long").alias("episodes"), F.col("first").alias("lowest"), F.col("last").alias("highest")
    ).withColumn(
        "zero_based",
        (F.col("episodes") > 0) & (F.col("lowest") == 0) & (F.col("highest") == F.col("episodes") - 1),
    )


def unknown_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys of ``left`` that ``right`` lacks.

    Both sides are reduced to distinct keys before they are shuffled.
    """
    return left.select(named(key)).distinct().join(right.select(named(key)).distinct(), key, "left_anti")


def coverage(requested: DataFrame, available: DataFrame, key: str) -> DataFrame:
    """Both set differences, labelled ``unknown`` and ``missing``."""
    return (
        unknown_keys(requested, available, key)
        .withColumn("problem", F.lit("unknown"))
        .unionByName(unknown_keys(available, requested, key).withColumn("problem", F.lit("missing")))
    )


def partly_missing(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Groups in which a column is set in some rows and null in others."""
    counted = df.groupBy(*[named(k) for k in keys]).agg(
        F.count(F.lit(1)).alias("row_count"), *[F.count(named(n)).alias(n) for n in columns]
    )
    partial = [(named(n) > 0) & (named(n) < F.col("row_count")) for n in columns]
    return counted.where(reduce(lambda a, b: a | b, partial))


def count_nulls(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """How many rows each strict expression rejected, in one pass."""
    return df.agg(*[F.count_if(value.isNull()).alias(name) for name, value in checks.items()])


def dataset_totals(frames: DataFrame, success: str | None = None, c: Columns = COLUMNS) -> DataFrame:
    """Episodes, frames, tasks and outcome counts of the whole dataset."""
    per_episode = frames.groupBy(named(c.episode)).agg(
        F.count(F.lit(1)).alias("length"),
        F.max(named(success).cast("int") if success else F.lit(None).cast("int")).alias("success"),
    )
    tasks = frames.agg(F.countDistinct(named(c.task)).alias("tasks"))
    return per_episode.agg(
        F.count(F.lit(1)).alias("total_episodes"),
        F.sum("length").alias("total_frames"),
        F.max("length").alias("longest_episode"),
        F.count_if(F.col("success") == 1).alias("success_episodes"),
        F.count_if(F.col("success") == 0).alias("failure_episodes"),
    ).withColumn("total_tasks", tasks.scalar())


def size_gates(total: DataFrame, required: int) -> DataFrame:
    """Enough windows for one, and for one full batch?  ``total`` is the
    one-row count from ``windows.total_windows``."""
    return total.withColumns(
        {"any_window": F.col("windows") > 0, "full_batch": F.col("windows") >= required}
    )

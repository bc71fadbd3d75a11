"""Success labels: where they come from and how they become one per episode."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epistride.columns import COLUMNS, Columns, named
from epistride.functions.scalars import scalar_cell, strict_bool
from epistride.operators.integrity import frame_spans
from epistride.operators.scans import join_episodes

# Success columns in order of precedence.
SUCCESS_COLUMNS = (
    "next.success",
    "next.is_success",
    "is_episode_successful",
    "episode.success",
    "episode_success",
    "is_success",
    "success",
)


def success_column(columns: Sequence[str], explicit: str | None = None) -> str | None:
    """The success column to use: the explicit one, or the first known name."""
    if explicit is not None:
        if explicit not in columns:
            raise KeyError(f"no column {explicit!r} to read success from")
        return explicit
    return next((name for name in SUCCESS_COLUMNS if name in columns), None)


def generated_labels(spark: SparkSession, start: int, end: int, value: bool = True) -> DataFrame:
    """The same label for every episode of the inclusive range."""
    if start < 0 or end < start:
        raise ValueError("label range must satisfy 0 <= start <= end")
    return spark.range(start, end + 1).select(
        F.col("id").alias("episode_index"), F.lit(value).alias("success")
    )


def reduce_success(frames: DataFrame, flag: str, how: str = "any", c: Columns = COLUMNS) -> DataFrame:
    """One label per episode from a per-frame flag.

    ``success`` is null where the label cannot be trusted: a value other than
    0 or 1, or (for ``constant``) a flag that changes.
    """
    per_frame = frames.select(
        named(c.episode), named(c.frame), strict_bool(scalar_cell(frames, flag)).alias("flag")
    )
    label = {
        "last": F.max_by("flag", named(c.frame)),
        "any": F.bool_or("flag"),
        "constant": F.when(F.bool_and("flag") == F.bool_or("flag"), F.bool_or("flag")),
    }.get(how)
    if label is None:
        raise ValueError("how must be 'last', 'any' or 'constant'")
    refused = F.count_if(F.col("flag").isNull())
    return per_frame.groupBy(named(c.episode)).agg(
        F.when(refused == 0, label).alias("success")
    )


def changing_labels(frames: DataFrame, flag: str, c: Columns = COLUMNS) -> DataFrame:
    """Episodes in which the per-frame flag takes both values."""
    value = strict_bool(scalar_cell(frames, flag))
    return (
        frames.groupBy(named(c.episode))
        .agg(F.count_if(value).alias("set_frames"), F.count_if(~value).alias("clear_frames"))
        .where((F.col("set_frames") > 0) & (F.col("clear_frames") > 0))
    )


def label_problems(frames: DataFrame, labels: DataFrame, c: Columns = COLUMNS) -> DataFrame:
    """Labels without an episode, episodes without a label, unusable labels."""
    episodes = frames.select(named(c.episode)).distinct().withColumn("has_frames", F.lit(True))
    known = labels.select(named(c.episode), "success", F.lit(True).alias("has_label"))
    joined = episodes.join(known, c.episode, "full")
    return joined.select(
        named(c.episode),
        F.when(F.col("has_frames").isNull(), "unknown episode")
        .when(F.col("has_label").isNull(), "missing label")
        .when(F.col("success").isNull(), "not a boolean")
        .alias("problem"),
    ).where(F.col("problem").isNotNull())


def with_labels(frames: DataFrame, labels: DataFrame, c: Columns = COLUMNS) -> DataFrame:
    """Frames with their episode's label as a 0/1 byte, null without one."""
    spans = frame_spans(frames, c).join(labels.select(named(c.episode), "success"), c.episode, "left")
    return join_episodes(frames, spans, c.episode, c.frame).select(
        *[named(n) for n in frames.columns], F.col("__success").cast("byte").alias(c.success)
    )


def disagreeing_labels(frames: DataFrame, labels: DataFrame, existing: str, c: Columns = COLUMNS) -> DataFrame:
    """Frames whose stored label differs from the derived one."""
    stored = frames.select(named(c.episode), named(c.frame), strict_bool(named(existing)).alias("stored"))
    spans = frame_spans(frames, c).join(labels.select(named(c.episode), "success"), c.episode, "left")
    joined = join_episodes(stored, spans, c.episode, c.frame)
    return joined.where(~F.col("stored").eqNullSafe(F.col("__success"))).select(
        *[named(k) for k in c.key], "stored", F.col("__success").alias("success")
    )

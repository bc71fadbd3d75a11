"""Return targets from success labels.

The last frame earns 0 on success and the negative failure penalty otherwise;
every earlier frame costs ``step_scale``; nothing is discounted.  The return
of a frame therefore depends only on its distance from the end, so it is plain
arithmetic after one join with the episode table and needs no window.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epistride.columns import COLUMNS, Columns, named
from epistride.functions.scalars import affine, clip
from epistride.operators.checksums import compared_rows
from epistride.operators.scans import BLOCK_ROWS, blocked_scan, join_episodes, position_block, running_count, spread_join
from epistride.session import stored

NORMALISATIONS = ("task_max", "global_minmax", "none")


def task_max_length(episodes: DataFrame, task: str = "task_index") -> DataFrame:
    """Longest episode of every task."""
    return episodes.groupBy(named(task)).agg(F.max("length").alias("task_max_length"))


def episode_terms(
    frames: DataFrame,
    labels: DataFrame,
    failure_penalty: float | None = None,
    step_scale: float = 1.0,
    c: Columns = COLUMNS,
    step: str | None = None,
) -> DataFrame:
    """Per episode: length, frame and step range, scaled task length and last reward.

    An episode without a usable label keeps its row with a null reward.  The
    episode table is stored: it is small next to the frames and read for the
    task lengths, the fitted range and the join.
    """
    _check_arguments(failure_penalty, step_scale)
    episodes = stored(
        frames.groupBy(named(c.episode)).agg(
            F.count(F.lit(1)).alias("length"),
            F.min(named(c.frame)).alias("first_frame"),
            F.max(named(c.frame)).alias("last_frame"),
            F.min(named(step or c.frame)).alias("first_step"),
            F.max(named(step or c.frame)).alias("last_step"),
            F.min(named(c.task)).alias(c.task),
        ),
        "episodes",
    )
    scaled = F.col("task_max_length").cast("double") * F.lit(float(step_scale))
    penalty = F.lit(float(failure_penalty)) if failure_penalty is not None else F.col("task_length")
    longest = task_max_length(episodes, c.task)
    return (
        spread_join(episodes, longest, [c.task], [c.episode], "left")
        .join(labels.select(named(c.episode), "success"), c.episode, "left")
        .withColumn("task_length", scaled)
        .withColumn("last_reward", F.when(F.col("success"), F.lit(0.0)).when(~F.col("success"), -penalty))
        .select(
            named(c.episode), "length", "first_frame", "last_frame", "first_step", "last_step", "success", "task_max_length",
            "task_length", "last_reward",
        )
    )


def raw_range(terms: DataFrame, step_scale: float = 1.0) -> DataFrame:
    """Smallest and largest raw return, from the episode table alone."""
    steps = F.col("length") - 1
    return terms.agg(
        F.min(F.col("last_reward") - F.lit(float(step_scale)) * steps).alias("low"),
        F.max("last_reward").alias("high"),
    )


def with_returns(
    frames: DataFrame,
    labels: DataFrame,
    normalisation: str = "task_max",
    failure_penalty: float | None = None,
    step_scale: float = 1.0,
    c: Columns = COLUMNS,
    keep: tuple[str, ...] | None = None,
    step: str | None = None,
    terms: DataFrame | None = None,
) -> DataFrame:
    """Add raw and normalised return and the episode's label to every frame.

    The distance from the end is counted in ``step``, by default the frame
    number.  Steps must be consecutive; the returns of an episode whose steps
    span more or less than its rows are null.  ``terms`` is ``episode_terms``
    with the same arguments, where it is known already.
    """
    _check_normalisation(normalisation)
    if terms is None:
        terms = episode_terms(frames, labels, failure_penalty, step_scale, c, step)
    even = F.col("__last_step") - F.col("__first_step") + 1 == F.col("__length")
    remaining = F.col("__last_step") - named(step or c.frame)
    raw = F.when(even, F.col("__last_reward") - F.lit(float(step_scale)) * remaining)
    joined = join_episodes(frames, terms, c.episode, c.frame).withColumn("__raw", raw)
    return _finished(joined, keep or tuple(frames.columns), normalisation, terms, step_scale, c)


def returns_by_rank(
    frames: DataFrame,
    terms: DataFrame,
    normalisation: str = "task_max",
    step_scale: float = 1.0,
    c: Columns = COLUMNS,
    step: str | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(key, returns, label): the same by another way, for verification.

    Rewards are summed from the end of the episode: the last row earns the
    last reward, and every row before it costs one step more.  Only the order
    of the steps counts, not their numbers.
    """
    _check_normalisation(normalisation)
    backward = frames.select(*[named(k) for k in c.key], (-named(step or c.frame).cast("long")).alias("__back"))
    counted = blocked_scan(
        backward, [c.episode], position_block(F.col("__back"), block_rows), ["__back"], {"__place": running_count(F.col("__back"))}
    )
    joined = join_episodes(counted, terms, c.episode, c.frame)
    raw = F.col("__last_reward") - F.lit(float(step_scale)) * (F.col("__place") - 1)
    return _finished(joined.withColumn("__raw", raw), tuple(c.key), normalisation, terms, step_scale, c)


def _check_normalisation(normalisation: str) -> None:
    if normalisation not in NORMALISATIONS:
        raise ValueError(f"normalisation must be one of {NORMALISATIONS}")


def _finished(joined: DataFrame, kept: tuple[str, ...], normalisation: str, terms: DataFrame, step_scale: float, c: Columns) -> DataFrame:
    return joined.select(
        *[named(name) for name in kept],
        _normalised(normalisation, terms, step_scale).cast("float").alias(c.ret),
        F.col("__raw").cast("float").alias(c.ret_raw),
        F.col("__success").cast("byte").alias(c.success),
    )


def _normalised(normalisation: str, terms: DataFrame, step_scale: float) -> Column:
    if normalisation == "task_max":
        return clip(F.col("__raw") / F.col("__task_length"), -1.0, 0.0)
    if normalisation == "global_minmax":
        # Both ends in one scalar, asked for once.
        limits = raw_range(terms, step_scale).select(F.struct("low", "high")).scalar()
        return affine(F.col("__raw"), limits.getField("low"), limits.getField("high"))
    return F.col("__raw")


def value_ranges(frames: DataFrame, c: Columns = COLUMNS) -> DataFrame:
    """Range of the raw and of the normalised return."""
    return frames.agg(
        F.min(named(c.ret_raw)).alias("raw_min"),
        F.max(named(c.ret_raw)).alias("raw_max"),
        F.min(named(c.ret)).alias("normalised_min"),
        F.max(named(c.ret)).alias("normalised_max"),
    )


def verify_augmented(augmented: DataFrame, expected: DataFrame, c: Columns = COLUMNS, tolerance: float = 1e-6) -> DataFrame:
    """Rows that augmentation lost, invented or got wrong.

    ``expected`` has every key of the source with the returns and label it
    must have, best from ``returns_by_rank``; ``augmented`` is what was written.
    Blocks of both sides are compared by checksum, and rows only in blocks
    that differ.
    """
    want, have = (
        df.select(
            *[named(k) for k in c.key],
            named(c.ret).alias("return"),
            named(c.ret_raw).alias("raw"),
            named(c.success).cast("int").alias("success"),
        )
        for df in (expected, augmented)
    )

    def off(name: str) -> Column:
        apart = F.abs(named(f"have.{name}").cast("double") - named(f"want.{name}").cast("double")) > tolerance
        # An unusable label leaves both sides without a return.
        return F.coalesce(apart, ~(named(f"have.{name}").isNull() & named(f"want.{name}").isNull()))

    problem = (
        F.when(F.col("in_have").isNull(), "lost row")
        .when(F.col("in_want").isNull(), "new row")
        .when(off("return"), "return")
        .when(off("raw"), "raw return")
        .when(~named("have.success").eqNullSafe(named("want.success")), "success")
    )
    values = ["return", "raw", "success"]
    return compared_rows(want, have, c.episode, c.frame, values).withColumn("problem", problem).where(F.col("problem").isNotNull()).select(*[named(k) for k in c.key], "problem")


def _check_arguments(failure_penalty: float | None, step_scale: float) -> None:
    if not math.isfinite(step_scale) or step_scale <= 0:
        raise ValueError("step_scale must be finite and positive")
    if failure_penalty is not None and (not math.isfinite(failure_penalty) or failure_penalty <= 0):
        raise ValueError("failure_penalty must be finite and positive")

"""History windows that never cross an episode boundary.

A window of history ``h`` is ``h + 1`` consecutive frames: ``h`` current ones
and one more that supplies only the next observation.  Frames are cut into
blocks by frame number and the first ``h`` frames of each block are copied to
the block before, so a long episode is spread over many tasks and no window is
lost at a block edge.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epistride.columns import COLUMNS, Columns, named
from epistride.functions.scalars import is_finite, sample_id
from epistride.operators.integrity import episode_summary, frame_spans
from epistride.operators.scans import (
    BLOCK_ROWS,
    blocked_scan,
    even_blocks,
    hash_rank,
    join_episodes,
    position_block,
    running_sum,
)
from epistride.session import stored


def _check_history(history: int) -> None:
    if history < 1:
        raise ValueError("history must be at least 1")


def history_windows(
    frames: DataFrame,
    history: int,
    fields: Sequence[str],
    c: Columns = COLUMNS,
    block_rows: int = BLOCK_ROWS,
    over_gaps: bool = False,
) -> DataFrame:
    """One row per window with ``steps``, an array of ``history + 1`` structs.

    Frames should be consecutive within an episode (see ``uneven_episodes``).
    A window that would reach over a gap is left out; ``over_gaps`` keeps it,
    for ``window_problems`` to report.
    """
    _check_history(history)
    if block_rows < history:
        raise ValueError("a block must hold at least one history")
    home = position_block(named(c.frame), block_rows)
    early = (F.pmod(named(c.frame), F.lit(block_rows)) < history) & (home > 0)
    spread = frames.select(
        named(c.episode),
        named(c.frame),
        *[named(f) for f in fields],
        F.explode(F.when(early, F.array(home, home - 1)).otherwise(F.array(home))).alias("__block"),
    )
    ahead = (
        Window.partitionBy(named(c.episode), "__block").orderBy(named(c.frame)).rowsBetween(0, history)
    )
    step = F.struct(named(c.frame).alias("frame"), *[named(f).alias(f) for f in fields])
    steps = F.collect_list(step).over(ahead)
    unbroken = F.element_at("steps", -1).getField("frame") - F.col("start_frame") == history
    return (
        spread.select(named(c.episode), named(c.frame).alias("start_frame"), "__block", steps.alias("steps"))
        .where((F.size("steps") == history + 1) & (position_block(F.col("start_frame"), block_rows) == F.col("__block")))
        .where(F.lit(over_gaps) | unbroken)
        .select(
            named(c.episode).alias("episode_id"),
            sample_id(named(c.episode), F.col("start_frame")).alias("sample_id"),
            "start_frame",
            "steps",
        )
    )


def split_window(windows: DataFrame, history: int, current: Sequence[str], upcoming: Sequence[str] = ()) -> DataFrame:
    """Parallel arrays per field: ``current`` ones and, shifted by one, ``next_`` ones."""
    now = F.slice("steps", 1, history)
    later = F.slice("steps", 2, history)
    pick = lambda steps, name: F.transform(steps, lambda s: s.getField(name))
    return windows.select(
        "episode_id",
        "sample_id",
        "start_frame",
        pick(now, "frame").alias("frame_indices"),
        *[pick(now, name).alias(name) for name in current],
        *[pick(later, name).alias(f"next_{name}") for name in upcoming],
    )


def window_starts(frames: DataFrame, history: int, c: Columns = COLUMNS) -> DataFrame:
    """First frames of all windows, by arithmetic: no window is built."""
    _check_history(history)
    return (
        join_episodes(frames.select(*[named(k) for k in c.key]), frame_spans(frames, c), c.episode, c.frame)
        .where(named(c.frame) + history <= F.col("__last_frame"))
        .select(
            named(c.episode).alias("episode_id"),
            named(c.frame).alias("start_frame"),
            sample_id(named(c.episode), named(c.frame)).alias("sample_id"),
        )
    )


def window_counts(frames: DataFrame, history: int, c: Columns = COLUMNS) -> DataFrame:
    """Windows per episode; episodes that are too short have none."""
    _check_history(history)
    return episode_summary(frames, c).withColumn(
        "windows", F.greatest(F.lit(0).cast("long"), F.col("length") - history)
    )


def total_windows(frames: DataFrame, history: int, c: Columns = COLUMNS) -> DataFrame:
    """One row: number of windows, from the episode lengths alone."""
    return window_counts(frames, history, c).agg(F.coalesce(F.sum("windows"), F.lit(0)).alias("windows"))


def endpoint_frames(frames: DataFrame, history: int, c: Columns = COLUMNS) -> DataFrame:
    """Frames that are the last history position of some window."""
    _check_history(history)
    inside = (named(c.frame) >= F.col("__first_frame") + history - 1) & (named(c.frame) < F.col("__last_frame"))
    joined = join_episodes(frames, frame_spans(frames, c), c.episode, c.frame)
    return joined.where(inside).select(*[named(n) for n in frames.columns])


def endpoint(values: Column, valid: Column) -> Column:
    """Value at the last valid position of a window."""
    positions = F.filter(F.transform(valid, lambda ok, i: F.when(ok, i)), lambda i: i.isNotNull())
    return F.get(values, F.array_max(positions))


def window_numbers(
    frames: DataFrame, history: int, c: Columns = COLUMNS, blocks: int | None = None
) -> DataFrame:
    """Windows with their 1-based dataset number, episodes and frames ascending.

    The number is an offset per episode plus the distance from its first
    frame, so only the episode table is scanned in order.
    """
    counted = stored(window_counts(frames, history, c), "episodes")
    offsets = blocked_scan(
        counted,
        [],
        even_blocks(counted, named(c.episode), blocks),
        [c.episode],
        {"before": running_sum(F.col("windows"), exclusive=True)},
    ).where(F.col("windows") > 0)
    joined = join_episodes(frames.select(*[named(k) for k in c.key]), offsets, c.episode, c.frame)
    return joined.where(named(c.frame) + history <= F.col("__last_frame")).select(
        named(c.episode).alias("episode_id"),
        named(c.frame).alias("start_frame"),
        sample_id(named(c.episode), named(c.frame)).alias("sample_id"),
        (F.col("__before") + named(c.frame) - F.col("__first_frame") + 1).alias("rank"),
    )


def batches(ranked: DataFrame, size: int, drop_last: bool, total: DataFrame | None = None, rank: str = "rank") -> DataFrame:
    """Batch number of each ranked row; ``drop_last`` removes a partial batch.

    ``total`` is a one-row count of the rows when it is known already.
    """
    if size < 1:
        raise ValueError("batch size must be positive")
    number = F.floor((named(rank) - 1) / F.lit(size)).cast("long")
    numbered = ranked.withColumn("batch", number)
    if not drop_last:
        return numbered
    count = (total or ranked.agg(F.count(F.lit(1)).alias("n"))).scalar()
    return numbered.where(F.col("batch") < F.floor(count / F.lit(size)))


def epoch_order(samples: DataFrame, seed: int, epoch: int, key: str = "sample_id") -> DataFrame:
    """Rank of every sample in the shuffled order of one epoch."""
    return hash_rank(samples, f"{seed}:{epoch}", named(key), [key])


def drop_padding(ranked: DataFrame, shards: int, total: DataFrame | None = None, rank: str = "rank") -> DataFrame:
    """Keep only the ranks that fill all shards equally."""
    count = (total or ranked.agg(F.count(F.lit(1)).alias("n"))).scalar()
    return ranked.where(named(rank) <= F.floor(count / F.lit(shards)) * shards)


def window_problems(windows: DataFrame, task: str | None = None, finite: Sequence[str] = ()) -> DataFrame:
    """Windows with gaps, a changed task, or missing or non-finite fields."""
    tests = {
        "frames not consecutive": F.exists(
            F.transform("steps", lambda s, i: s["frame"] - i), lambda base: base != F.col("start_frame")
        )
    }
    if task:
        tests["task changes"] = F.exists(
            "steps", lambda s: ~s.getField(task).eqNullSafe(F.element_at("steps", 1).getField(task))
        )
    unusable = lambda name: F.exists("steps", lambda s: ~is_finite(s.getField(name)))
    tests.update({f"{name} not finite": unusable(name) for name in finite})
    reasons = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in tests.items()]))
    return windows.select("sample_id", F.explode(reasons).alias("problem"))

"""Value curves: one predicted value per (episode, frame)."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epistride.columns import named
from epistride.functions.scalars import is_finite
from epistride.operators.integrity import duplicate_keys, unknown_keys
from epistride.operators.scans import (
    BLOCK_ROWS,
    blocked_scan,
    following,
    join_episodes,
    position_block,
    running_count,
)

POINT_KEY = ["episode_id", "frame_index"]


def point_problems(points: DataFrame, values: Sequence[str] = ("value", "return")) -> DataFrame:
    """Repeated (episode, frame) keys and non-finite values."""
    repeated = duplicate_keys(points, POINT_KEY).select(*POINT_KEY, F.lit("duplicate").alias("problem"))
    finite = F.lit(True)
    for name in values:
        finite = finite & is_finite(named(name))
    odd = points.where(~finite).select(*POINT_KEY, F.lit("not finite").alias("problem"))
    return repeated.unionByName(odd)


def assemble_curves(
    points: DataFrame, values: Sequence[str] = ("value", "return"), page_frames: int = BLOCK_ROWS
) -> DataFrame:
    """Curves as parallel arrays sorted by frame, one row per episode page.

    The form is the same at every size: a row is one page, which covers
    ``page_frames`` frame numbers and carries its number, so arrays stay
    bounded.  Readers take (episode, page) as the key.
    """
    entry = F.struct("frame_index", *[named(v) for v in values])
    paged = points.groupBy(
        "episode_id", position_block(F.col("frame_index"), page_frames).alias("page")
    ).agg(F.sort_array(F.collect_list(entry)).alias("entries"))
    pick = lambda name: F.transform("entries", lambda e: e.getField(name))
    return paged.select(
        "episode_id",
        "page",
        pick("frame_index").alias("frame_indices"),
        *[pick(v).alias(f"{v}s") for v in values],
    )


def explode_curves(curves: DataFrame, value: str = "values") -> DataFrame:
    """Back to one row per point."""
    return curves.select("episode_id", F.inline(F.arrays_zip("frame_indices", value))).select(
        "episode_id", F.col("frame_indices").alias("frame_index"), F.col(value).alias("value")
    )


def curve_spans(points: DataFrame) -> DataFrame:
    """First and last frame and number of points of every curve."""
    return points.groupBy("episode_id").agg(
        F.min("frame_index").alias("first_curve_frame"),
        F.max("frame_index").alias("last_curve_frame"),
        F.count(F.lit(1)).alias("curve_points"),
    )


def curve_summary(points: DataFrame, limit: int | None = None) -> DataFrame:
    """One row: episodes and points of a report over the first ``limit``
    episodes, and how many episodes there are in all."""
    per_episode = points.groupBy("episode_id").agg(F.count(F.lit(1)).alias("n"))
    shown = per_episode if limit is None else per_episode.orderBy("episode_id").limit(limit)
    everything = per_episode.agg(F.count(F.lit(1)).alias("episodes"))
    return shown.agg(
        F.count(F.lit(1)).alias("num_episodes"), F.coalesce(F.sum("n"), F.lit(0)).alias("num_points")
    ).withColumns({"total_num_episodes": everything.scalar(), "max_episodes": F.lit(limit).cast("long")})


def limit_curves(points: DataFrame, episodes: int) -> DataFrame:
    """Points of the first ``episodes`` episodes in id order."""
    if episodes < 1:
        raise ValueError("the limit must be positive")
    first = points.select("episode_id").distinct().orderBy("episode_id").limit(episodes)
    # The report size is the caller's number, which bounds the broadcast.
    return points.join(F.broadcast(first), "episode_id", "left_semi")


def ordered_unique(values: DataFrame, key: str, position: str) -> DataFrame:
    """Distinct keys with the position of their first appearance."""
    return values.groupBy(named(key)).agg(F.min(named(position)).alias(position))


def requested_episodes(points: DataFrame, ids: Sequence[int], limit: int | None = None) -> DataFrame:
    """(episode_id, position): requested ids in order, repeats dropped."""
    if limit is not None and limit < 1:
        raise ValueError("the limit must be positive")
    spark = points.sparkSession
    listed = spark.createDataFrame([(list(map(int, ids)),)], "ids array<bigint>").select(
        F.posexplode("ids").alias("position", "episode_id")
    )
    wanted = ordered_unique(listed, "episode_id", "position")
    return wanted.orderBy("position").limit(limit) if limit is not None else wanted


def absent_episodes(points: DataFrame, requested: DataFrame) -> DataFrame:
    return unknown_keys(requested, points, "episode_id")


def curve_gaps(points: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(episode, left, right): neighbouring points that are not adjacent frames."""
    paired = blocked_scan(
        points.select(*POINT_KEY),
        ["episode_id"],
        position_block(F.col("frame_index"), block_rows),
        ["frame_index"],
        {"right_frame": following(F.col("frame_index"))},
    )
    return paired.where(F.col("right_frame") != F.col("frame_index") + 1).select(
        "episode_id", F.col("frame_index").alias("left_frame"), "right_frame"
    )


def ranked_points(points: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Points with their 1-based position in the curve."""
    return blocked_scan(
        points,
        ["episode_id"],
        position_block(F.col("frame_index"), block_rows),
        ["frame_index"],
        {"position": running_count(F.col("frame_index"))},
    )


def curve_segments(points: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Runs of consecutive frames: frame minus position is constant in a run."""
    placed = ranked_points(points.select(*POINT_KEY), block_rows)
    return (
        placed.groupBy("episode_id", (F.col("frame_index") - F.col("position")).alias("run"))
        .agg(
            F.min("frame_index").alias("first_frame"),
            F.max("frame_index").alias("last_frame"),
            F.count(F.lit(1)).alias("point_count"),
        )
        .drop("run")
    )


def preview_points(points: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The middle point of every curve."""
    joined = join_episodes(
        ranked_points(points, block_rows), curve_spans(points), "episode_id", "frame_index",
        "first_curve_frame", "last_curve_frame", block_rows,
    )
    # Position floor(n / 2) + 1, written so that it stays a filter of the join.
    middle = joined.where((F.col("position") * 2 - F.col("__curve_points")).isin(1, 2))
    return middle.select(*[named(n) for n in points.columns])


def value_domain(
    points: DataFrame, by: Sequence[str] = (), low: float | None = None, high: float | None = None
) -> DataFrame:
    """Axis range of the values: padded, never flat, requested ends win.

    When a requested end lies beyond the data the other end is moved by the
    minimum span.
    """
    for end in (low, high):
        if end is not None and not math.isfinite(end):
            raise ValueError("a requested end must be finite")
    if low is not None and high is not None and not low < high:
        raise ValueError("the lower end must be below the upper end")
    data = points.groupBy(*[named(b) for b in by]).agg(
        F.min("value").cast("double").alias("data_low"), F.max("value").cast("double").alias("data_high")
    )
    # Least span as a share of the largest value and as a number, padding on either side as a share.
    span_share, span_least, padding = 0.08, 0.08, 0.14
    wide = F.col("data_high") - F.col("data_low")
    flat = span_share * F.greatest(F.lit(1.0), F.abs("data_low"), F.abs("data_high"))
    made = data.withColumn("span", F.greatest(wide, flat, F.lit(span_least)))
    free = {"lower": F.col("data_low") - F.col("span") * padding, "upper": F.col("data_high") + F.col("span") * padding}
    # A requested end holds; the free one keeps at least one span away from an end that lies beyond it.
    if low is not None:
        free["lower"] = F.lit(float(low))
    if high is not None:
        free["upper"] = F.lit(float(high))
    crossed = free["lower"] >= free["upper"]
    moved = ("upper", free["lower"] + F.col("span")) if low is not None else ("lower", free["upper"] - F.col("span"))
    if (low is None) != (high is None):
        free[moved[0]] = F.when(crossed, moved[1]).otherwise(free[moved[0]])
    data, lower, upper = made, free["lower"], free["upper"]
    return data.where(F.col("data_low").isNotNull()).select(
        *[named(b) for b in by], lower.alias("lower"), upper.alias("upper")
    )

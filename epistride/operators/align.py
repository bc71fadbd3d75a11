"""Aligning value curves with the full frame timeline of their episode."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epistride.columns import COLUMNS, Columns, named
from epistride.functions.scalars import first_positive, is_finite, positive_or_null
from epistride.operators.curves import curve_gaps, curve_spans
from epistride.operators.integrity import episode_summary
from epistride.operators.scans import (
    BLOCK_ROWS,
    blocked_scan,
    latest,
    overall_max,
    position_block,
    running_count,
)


def frame_states(frames: DataFrame, points: DataFrame, c: Columns = COLUMNS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """What may be shown on every frame, without looking at later points.

    Frames and points are laid on one timeline and scanned once, points before
    the frame they belong to.  Frames of episodes without a curve are left out.
    """
    timeline = frames.select(
        named(c.episode).cast("long").alias("episode_id"),
        named(c.frame).cast("long").alias("frame_index"),
        F.lit(1).alias("is_frame"),
        (named(c.frame).cast("long") * 2 + 1).alias("place"),
        F.lit(None).cast("double").alias("value"),
        F.lit(None).cast("long").alias("point_frame"),
    ).unionByName(
        points.select(
            F.col("episode_id").cast("long").alias("episode_id"),
            F.col("frame_index").cast("long").alias("frame_index"),
            F.lit(0).alias("is_frame"),
            (F.col("frame_index").cast("long") * 2).alias("place"),
            F.col("value").cast("double").alias("value"),
            F.col("frame_index").cast("long").alias("point_frame"),
        )
    )
    scanned = blocked_scan(
        timeline,
        ["episode_id"],
        position_block(F.col("frame_index"), block_rows),
        ["place"],
        {
            "visible_points": running_count(F.col("point_frame")),
            "latest_frame": latest(F.col("point_frame")),
            "latest_value": latest(F.col("value")),
            "last_point": overall_max(F.col("point_frame")),
        },
    )
    exact = F.coalesce(F.col("latest_frame") == F.col("frame_index"), F.lit(False))
    status = (
        F.when(F.col("visible_points") == 0, "warming_up")
        .when(exact, "estimated")
        .when(F.col("frame_index") > F.col("last_point"), "terminal_hold")
        .otherwise("no_estimate")
    )
    shown = F.col("status").isin("estimated", "terminal_hold")
    return (
        scanned.where((F.col("is_frame") == 1) & F.col("last_point").isNotNull())
        .withColumn("status", status)
        .select(
            "episode_id",
            "frame_index",
            "visible_points",
            "latest_frame",
            exact.alias("exact"),
            "status",
            F.when(shown, F.col("latest_value")).alias("shown_value"),
        )
    )


def values_at(frames: DataFrame, points: DataFrame, c: Columns = COLUMNS) -> DataFrame:
    """Value exactly at each frame, null elsewhere."""
    keyed = frames.select(named(c.episode).alias("episode_id"), named(c.frame).alias("frame_index"))
    return keyed.join(points.select("episode_id", "frame_index", "value"), ["episode_id", "frame_index"], "left")


# Where an episode's frames come from.  Each function returns one row per
# episode: episode_id, path, camera_key, fps, start_seconds, frame_count,
# frame_count_inferred, first_source_frame, last_source_frame,
# expected_first_curve_frame, basis.

SOURCE_FIELDS = (
    "episode_id",
    "path",
    "camera_key",
    "fps",
    "start_seconds",
    "frame_count",
    "frame_count_inferred",
    "first_source_frame",
    "last_source_frame",
    "expected_first_curve_frame",
    "basis",
)


def _source(df: DataFrame, first: Column, count: Column, history: Column, **fields: Column) -> DataFrame:
    placed = df.withColumns({"__first": first.cast("long"), "__count": count.cast("long"), "__history": history})
    made = {
        "episode_id": F.col("episode_id").cast("long"),
        "path": F.lit(None).cast("string"),
        "camera_key": F.lit(None).cast("string"),
        "start_seconds": F.lit(0.0),
        "frame_count": F.col("__count"),
        "frame_count_inferred": F.lit(False),
        "first_source_frame": F.col("__first"),
        "last_source_frame": F.col("__first") + F.col("__count") - 1,
        "expected_first_curve_frame": (F.col("__first") + F.col("__history") - 1).cast("long"),
        **fields,
    }
    return placed.select(*[made[name].alias(name) for name in SOURCE_FIELDS])


def _history(value: int | None) -> Column:
    if value is not None and value < 1:
        raise ValueError("history must be at least 1")
    return F.lit(value).cast("long")


def inferred_count(last_curve_frame: Column, offset: Column) -> Column:
    """The last point is one frame before the episode's last one."""
    return last_curve_frame - offset + 2


def sources_from_frames(frames: DataFrame, fps: float, history: int | None = None, camera: str | None = None, c: Columns = COLUMNS) -> DataFrame:
    """Row-by-row sources, described by the frame table itself."""
    spans = episode_summary(frames, c).withColumnRenamed(c.episode, "episode_id")
    return _source(
        spans, F.col("first_frame"), F.col("length"), _history(history),
        camera_key=F.lit(camera).cast("string"), fps=F.lit(float(fps)), basis=F.lit("frame table"),
    )


def sources_from_template(points: DataFrame, path: Column, offset: int, fps: float, probed: DataFrame | None = None, history: int | None = None) -> DataFrame:
    """One file per episode; ``probed`` may give (episode_id, frame_count)."""
    spans = curve_spans(points)
    known = F.lit(None).cast("long")
    if probed is not None:
        spans = spans.join(probed.select("episode_id", F.col("frame_count").alias("__probed")), "episode_id", "left")
        known = F.col("__probed")
    start = F.lit(int(offset))
    return _source(
        spans, start, F.coalesce(known, inferred_count(F.col("last_curve_frame"), start)), _history(history),
        path=path, fps=F.lit(float(fps)), frame_count_inferred=known.isNull(), basis=F.lit("path template"),
    )


def sources_from_map(points: DataFrame, video_map: DataFrame, offset: int = 0, fps: float | None = None, probed: DataFrame | None = None, history: int | None = None) -> DataFrame:
    """Entries of a video map, defaults filled in; see ``read_video_map``.

    ``probed`` may give (episode_id, frame_count, fps) of the files.  Its
    count does not apply to an entry that starts inside its file.
    """
    joined = curve_spans(points).join(video_map, "episode_id")
    if probed is None:
        known = joined.withColumns({"__frames": F.lit(None).cast("long"), "__rate": F.lit(None).cast("double")})
    else:
        found = probed.select("episode_id", F.col("frame_count").alias("__frames"), F.col("fps").alias("__rate"))
        known = joined.join(found, "episode_id", "left")
    start = F.coalesce(F.col("frame_offset"), F.lit(int(offset)))
    from_start = F.coalesce(F.col("start_seconds"), F.lit(0.0)) <= 0
    count = F.coalesce(F.col("frame_count"), F.when(from_start, F.col("__frames")))
    return _source(
        known,
        start,
        F.coalesce(count, inferred_count(F.col("last_curve_frame"), start)),
        F.coalesce(F.col("history_size"), _history(history)),
        path=F.col("path"),
        camera_key=F.col("camera_key"),
        fps=first_positive(F.lit(fps).cast("double"), F.col("fps"), F.col("__rate")),
        start_seconds=F.coalesce(F.col("start_seconds"), F.lit(0.0)),
        frame_count_inferred=count.isNull(),
        basis=F.lit("video map"),
    )


def sources_from_episodes(episodes: DataFrame, camera: str, fps: float, offset: int = 0, history: int | None = None) -> DataFrame:
    """Ranges of shared video shards, from the episode table."""
    at = lambda name: named(f"videos/{camera}/{name}")
    return _source(
        episodes.withColumn("episode_id", F.col("episode_index")),
        F.lit(int(offset)),
        F.col("length"),
        _history(history),
        path=F.format_string("videos/%s/chunk-%03d/file-%03d.mp4", F.lit(camera), at("chunk_index"), at("file_index")),
        camera_key=F.lit(camera),
        fps=F.lit(float(fps)),
        start_seconds=at("from_timestamp"),
        basis=F.lit("episode table"),
    )


def duration_problems(episodes: DataFrame, camera: str, fps: float) -> DataFrame:
    """Episodes whose video range disagrees with length / fps."""
    start, end = named(f"videos/{camera}/from_timestamp"), named(f"videos/{camera}/to_timestamp")
    # One and a half frames, but a millisecond at least.
    tolerance = max(1.5 / fps, 1e-3)
    duration, expected = end - start, F.col("length") / F.lit(float(fps))
    problem = (
        F.when(~is_finite(start) | (start < 0), "bad start")
        .when(~is_finite(end) | (end < start), "bad end")
        .when(F.abs(duration - expected) > tolerance, "duration")
    )
    return episodes.select("episode_index", duration.alias("duration"), expected.alias("expected"), problem.alias("problem")).where(
        F.col("problem").isNotNull()
    )


def preflight(points: DataFrame, sources: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Curves with their source and every alignment problem found.

    ``hard`` problems always forbid rendering; ``soft`` ones are allowed when
    mismatches are tolerated; ``notes`` never forbid it.
    """
    gaps = curve_gaps(points, block_rows).groupBy("episode_id").agg(F.count(F.lit(1)).alias("gaps"))
    joined = (
        curve_spans(points)
        .join(sources, "episode_id", "left")
        .join(gaps, "episode_id", "left")
        .withColumn("gaps", F.coalesce("gaps", F.lit(0)))
    )
    reasons = lambda **tests: F.array_compact(F.array(*[F.when(t, F.lit(n.replace("_", " "))) for n, t in tests.items()]))
    first, last = F.col("first_curve_frame"), F.col("last_curve_frame")
    return joined.withColumns(
        {
            "hard": reasons(
                no_source=F.col("basis").isNull(),
                outside_source=(first < F.col("first_source_frame")) | (last > F.col("last_source_frame")),
            ),
            "soft": reasons(
                frame_gaps=F.col("gaps") > 0,
                unexpected_last_frame=last != F.col("last_source_frame") - 1,
                unexpected_first_frame=first != F.col("expected_first_curve_frame"),
            ),
            "notes": reasons(first_frame_unchecked=F.col("basis").isNotNull() & F.col("expected_first_curve_frame").isNull()),
        }
    )


def rejected(checked: DataFrame, strict: bool = True) -> DataFrame:
    """(episode_id, problem) of episodes that must not be rendered.

    Without ``strict`` only the hard problems count.
    """
    found = F.concat("hard", "soft") if strict else F.col("hard")
    return checked.select("episode_id", F.explode(found).alias("problem"))


def alignment_report(checked: DataFrame, speed: float = 1.0, output_fps: float | None = None) -> DataFrame:
    """One record per episode that passed the hard checks."""
    if not math.isfinite(speed) or speed <= 0:
        raise ValueError("speed must be finite and positive")
    if output_fps is not None and speed != 1.0:
        raise ValueError("give either speed or output_fps")
    if output_fps is not None and (not math.isfinite(output_fps) or output_fps <= 0):
        raise ValueError("output_fps must be finite and positive")
    fps = positive_or_null(F.col("fps"))
    out = F.lit(float(output_fps)) if output_fps is not None else fps * F.lit(float(speed))
    first, last = F.col("first_curve_frame"), F.col("last_curve_frame")
    return checked.where(F.size("hard") == 0).select(
        "episode_id",
        "path",
        "camera_key",
        "basis",
        fps.alias("source_fps"),
        out.alias("output_fps"),
        (out / fps).alias("playback_speed"),
        (F.col("frame_count") / fps).alias("source_duration_seconds"),
        (F.col("frame_count") / out).alias("output_duration_seconds"),
        F.col("frame_count").alias("source_frame_count"),
        "first_source_frame",
        "last_source_frame",
        "first_curve_frame",
        "last_curve_frame",
        "curve_points",
        warmup_frames().alias("warmup_frame_count"),
        ends_without_estimate().alias("terminal_without_new_estimate"),
        "expected_first_curve_frame",
        F.coalesce(first == F.col("expected_first_curve_frame"), F.lit(False)).alias("first_frame_verified"),
        "frame_count_inferred",
        ((F.size("soft") == 0) & (F.size("notes") == 0)).alias("mapping_verified"),
        F.concat("soft", "notes").alias("warnings"),
    )


def warmup_frames() -> Column:
    """Source frames before the first point."""
    return F.greatest(F.lit(0).cast("long"), F.col("first_curve_frame") - F.col("first_source_frame"))


def ends_without_estimate() -> Column:
    """Does the source go on after the last point?"""
    return F.col("last_curve_frame") < F.col("last_source_frame")

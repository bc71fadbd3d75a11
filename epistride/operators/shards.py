"""Episode offsets, episode-aligned shards and flat frame layouts."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epistride.columns import named
from epistride.functions.scalars import chunk_of, file_of, strict_bool, strict_long
from epistride.operators.scans import BLOCK_ROWS, blocked_scan, even_blocks, latest, position_block, running_sum
from epistride.session import stored

KEY = "episode_index"

# A shard block covers this many shard sizes; every next level joins this many blocks.
BLOCK_SHARDS = 16
LEVEL_BLOCKS = 64


def episode_offsets(episodes: DataFrame, blocks: int | None = None) -> DataFrame:
    """Add ``offset``, the frames before the episode in id order.

    Ids need not be dense: ``blocks`` of equally many episodes are summed apart.
    """
    return blocked_scan(
        episodes,
        [],
        even_blocks(episodes, F.col(KEY), blocks),
        [KEY],
        {"offset": running_sum(F.col("length"), exclusive=True)},
    )


def layout_problems(episodes: DataFrame, total_frames: DataFrame, blocks: int | None = None) -> DataFrame:
    """Violations of a flat layout: (episode or null, problem).

    ``episodes`` has ``length``, ``ep_offset`` and ``ep_success``;
    ``total_frames`` is the one-row frame count.
    """
    checked = episode_offsets(
        episodes.withColumns(
            {"length": strict_long(F.col("length")), "ep_offset": strict_long(F.col("ep_offset"))}
        ),
        blocks,
    )
    tests = {
        "length": F.coalesce(F.col("length") <= 0, F.lit(True)),
        "success": strict_bool(F.col("ep_success")).isNull(),
        "offset": ~F.col("ep_offset").eqNullSafe(F.col("offset")),
    }
    reasons = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in tests.items()]))
    per_episode = checked.select(F.col(KEY), F.explode(reasons).alias("problem"))
    cover = episodes.agg(F.sum("length").alias("covered")).where(
        ~F.col("covered").eqNullSafe(total_frames.scalar())
    )
    return per_episode.unionByName(
        cover.select(F.lit(None).cast("long").alias(KEY), F.lit("frame count").alias("problem"))
    )


def frames_of_episodes(episodes: DataFrame, fps: float | None = None, task: int = 0, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per frame of every episode, with the derived frame columns.

    Long episodes are first cut into blocks, so no array holds more than
    ``block_rows`` frames and no task gets a whole hot episode.
    """
    blocks = episodes.select(
        F.col(KEY),
        "offset",
        "length",
        *[named(n) for n in episodes.columns if n not in (KEY, "offset", "length")],
        F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / block_rows))).alias("__block"),
    ).repartition(KEY, "__block")
    first = F.col("__block") * block_rows
    last = F.least(F.col("length"), first + block_rows) - 1
    frames = blocks.withColumn("frame_index", F.explode(F.sequence(first, last))).drop("__block")
    derived = {"index": F.col("offset") + F.col("frame_index"), "task_index": F.lit(task).cast("long")}
    if fps is not None:
        derived["timestamp"] = (F.col("frame_index") / F.lit(float(fps))).cast("float")
    return frames.withColumns(derived).drop("offset", "length")


def locate_rows(rows: DataFrame, episodes: DataFrame, index: str = "index", block_rows: int = 1_000_000) -> DataFrame:
    """Episode and frame of every global row number.

    Episode starts and rows share one timeline cut by row number; the last
    start seen is the row's episode.  Rows beyond the last episode stay out.
    """
    extra = [n for n in rows.columns if n != index]
    nothing = F.lit(None).cast("long")
    timeline = rows.select(
        named(index).cast("long").alias("__at"),
        (named(index).cast("long") * 2 + 1).alias("__place"),
        *[nothing.alias(n) for n in ("__episode", "__offset", "__length")],
        *[named(n) for n in extra],
    )
    starts = episodes.select(
        F.col("offset").cast("long").alias("__at"),
        (F.col("offset").cast("long") * 2).alias("__place"),
        F.col(KEY).cast("long").alias("__episode"),
        F.col("offset").cast("long").alias("__offset"),
        F.col("length").cast("long").alias("__length"),
        *[F.lit(None).cast(rows.schema[n].dataType).alias(n) for n in extra],
    )
    scanned = blocked_scan(
        timeline.unionByName(starts),
        [],
        position_block(F.col("__at"), block_rows),
        ["__place"],
        {f"__owner_{n}": latest(F.col(f"__{n}")) for n in ("episode", "offset", "length")},
    )
    is_row = F.col("__episode").isNull()
    inside = F.col("__at") < F.col("__owner_offset") + F.col("__owner_length")
    return scanned.where(is_row & inside).select(
        F.col("__at").alias(index),
        F.col("__owner_episode").alias(KEY),
        (F.col("__at") - F.col("__owner_offset")).alias("frame_index"),
        *[named(n) for n in extra],
    )


def episode_shards(episodes: DataFrame, max_frames: int, blocks: int | None = None, level_blocks: int = LEVEL_BLOCKS) -> DataFrame:
    """Episodes with ``offset`` and ``shard``, packed greedily in id order.

    A shard takes episodes until the next one would exceed ``max_frames``; an
    episode above the limit gets a shard of its own.  Where the next shard
    begins depends only on where this one begins, so every episode points to
    that place.  The chain from frame 0 is followed level by level: blocks of
    frames are shortened to "enter here, leave there", those again in groups,
    until one block is left; then the marks go back down.  Each group is
    bounded by the block size, and the number of levels grows with log(frames).
    """
    if max_frames < 1:
        raise ValueError("max_frames must be positive")
    # Every step below reads the offsets, and the way up and down the links.
    placed = stored(episode_offsets(episodes, blocks), "offsets")
    total = placed.agg(F.sum("length")).collect()[0][0] or 0
    width = BLOCK_SHARDS * max_frames
    links = stored(_next_shard(placed, max_frames, width, total), "links")
    levels, widths = [links], [width]
    while widths[-1] < total:
        shorter = _shorten(levels[-1], widths[-1], max_frames)
        widths.append(widths[-1] * level_blocks)
        # All but the last are read again on the way down.
        levels.append(stored(shorter, "links") if widths[-1] < total else shorter)
    marks = episodes.sparkSession.createDataFrame([(0,)], "at long")
    for level, span in zip(reversed(levels), reversed(widths)):
        marks = _walk(level, marks, span)
    starts = marks.withColumnRenamed("at", "offset").withColumn("__starts", F.lit(1).cast("long"))
    flagged = placed.join(starts, "offset", "left").withColumn("__starts", F.coalesce("__starts", F.lit(0).cast("long")))
    numbered = blocked_scan(
        flagged, [], even_blocks(placed, F.col(KEY), blocks), [KEY], {"shard": running_sum(F.col("__starts"))}
    )
    return numbered.withColumn("shard", F.col("shard") - 1).select(*[named(n) for n in episodes.columns], "offset", "shard")


def _next_shard(placed: DataFrame, max_frames: int, width: int, total: int) -> DataFrame:
    """(at, to, forced): where the shard after one starting at ``at`` begins.

    That is the episode holding the frame ``max_frames`` further on.  An
    episode that fills a shard alone is ``forced`` to hand over at its end.
    ``to`` is ``total`` for the last shard.
    """
    starts = placed.select(
        F.col("offset").alias("at"), (F.col("offset") * 2).alias("place"), F.col("offset").alias("owner"),
        F.lit(None).cast("long").alias("asked_by"),
    )
    ending = F.col("offset") + F.greatest(F.col("length"), F.lit(max_frames)) >= total
    probes = placed.where((F.col("length") < max_frames) & ~ending).select(
        (F.col("offset") + max_frames).alias("at"), ((F.col("offset") + max_frames) * 2 + 1).alias("place"),
        F.lit(None).cast("long").alias("owner"), F.col("offset").alias("asked_by"),
    )
    found = blocked_scan(
        starts.unionByName(probes), [], position_block(F.col("at"), width), ["place"],
        {"to": latest(F.col("owner"))},
    ).where(F.col("asked_by").isNotNull()).select(F.col("asked_by").alias("at"), "to", F.lit(False).alias("forced"))
    alone = placed.where((F.col("length") >= max_frames) | ending).select(
        F.col("offset").alias("at"),
        F.when(ending, F.lit(total)).otherwise(F.col("offset") + F.col("length")).cast("long").alias("to"),
        F.lit(True).alias("forced"),
    )
    return found.unionByName(alone)


def _shorten(links: DataFrame, width: int, max_frames: int) -> DataFrame:
    """Keep the places where a block can be entered, with where it is left."""

    def leave(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("at", ignore_index=True)
        at, to = block["at"].to_numpy(), block["to"].to_numpy().copy()
        forced = block["forced"].to_numpy(dtype=bool).copy()
        begin = at[0] // width * width
        # Links lead on to later places: doubling the step follows all chains at once.
        place = np.append(np.searchsorted(at, to), len(at))
        place[:-1][place[:-1] < np.arange(len(at)) + 1] = len(at)
        while True:
            onward = place[:-1] < len(at)
            if not onward.any():
                break
            next_place = place[place[:-1]]
            to[onward], forced[onward] = to[place[:-1][onward]], forced[place[:-1][onward]]
            place[:-1] = np.where(onward, next_place, len(at))
        # Entered from the block before, or after an episode that fills a shard.
        enterable = (at - begin < max_frames) | block["entered"].to_numpy(dtype=bool)
        return pd.DataFrame({"at": at[enterable], "to": to[enterable], "forced": forced[enterable]})

    targets = links.where("forced").select(F.col("to").alias("at")).distinct().withColumn("entered", F.lit(True))
    marked = links.join(targets, "at", "left").withColumn("entered", F.coalesce("entered", F.lit(False)))
    return marked.groupBy(position_block(F.col("at"), width).alias("block")).applyInPandas(
        leave, "at long, to long, forced boolean"
    )


def _walk(links: DataFrame, entries: DataFrame, width: int) -> DataFrame:
    """All places the chain visits, given where it enters each block."""

    def visit(block: pd.DataFrame) -> pd.DataFrame:
        entered = block.loc[block["entry"], "at"]
        if entered.empty:
            return pd.DataFrame({"at": pd.Series([], dtype="int64")})
        block = block.sort_values("at", ignore_index=True)
        at, to = block["at"].to_numpy(), block["to"].to_numpy()
        end = len(at)
        place = np.minimum(np.searchsorted(at, to), end - 1)
        # From each place on to the next; beyond the block to ``end``, which stays there.
        jump = np.append(np.where((at[place] == to) & (to > at), place, end), end)
        seen = np.zeros(end + 1, dtype=bool)
        seen[np.searchsorted(at, int(entered.min()))] = True
        while (jump < end).any():
            seen[jump[seen]] = True
            jump = jump[jump]
        return pd.DataFrame({"at": at[seen[:-1]]})

    marked = links.join(entries.withColumn("entry", F.lit(True)), "at", "left").withColumn(
        "entry", F.coalesce("entry", F.lit(False))
    )
    return marked.groupBy(position_block(F.col("at"), width).alias("block")).applyInPandas(visit, "at long")


def shard_ranges(sharded: DataFrame) -> DataFrame:
    """Half-open episode and frame ranges of every shard, with its address."""
    return (
        sharded.groupBy("shard")
        .agg(
            F.min(KEY).alias("episode_start"),
            (F.max(KEY) + 1).alias("episode_end"),
            F.min("offset").alias("frame_start"),
            F.max(F.col("offset") + F.col("length")).alias("frame_end"),
        )
        .withColumns({"chunk_index": chunk_of(F.col("shard")), "file_index": file_of(F.col("shard"))})
    )


def episode_table(episodes: DataFrame, data_shards: DataFrame, video_shards: DataFrame | None = None, fps: float = 10.0, camera: str | None = None) -> DataFrame:
    """Episode metadata: data address, flat range and, with a camera, video range.

    ``episodes`` has ``episode_index`` and ``tasks``; the shards come from
    ``episode_shards``.
    """
    table = episodes.select(KEY, "tasks").join(
        data_shards.select(
            KEY,
            "length",
            chunk_of(F.col("shard")).alias("data/chunk_index"),
            file_of(F.col("shard")).alias("data/file_index"),
            F.col("offset").alias("dataset_from_index"),
            (F.col("offset") + F.col("length")).alias("dataset_to_index"),
        ),
        KEY,
    )
    if camera is not None:
        table = table.join(video_ranges(data_shards if video_shards is None else video_shards, fps, camera), KEY)
    return table.withColumns(
        {"meta/episodes/chunk_index": F.lit(0).cast("long"), "meta/episodes/file_index": F.lit(0).cast("long")}
    )


def video_ranges(sharded: DataFrame, fps: float, camera: str) -> DataFrame:
    """Video address and time range of every episode inside its shard."""
    begins = sharded.groupBy("shard").agg(F.min("offset").alias("shard_start"))
    local = F.col("offset") - F.col("shard_start")
    rate = F.lit(float(fps))
    return sharded.join(begins, "shard").select(
        KEY,
        chunk_of(F.col("shard")).alias(f"videos/{camera}/chunk_index"),
        file_of(F.col("shard")).alias(f"videos/{camera}/file_index"),
        (local / rate).alias(f"videos/{camera}/from_timestamp"),
        ((local + F.col("length")) / rate).alias(f"videos/{camera}/to_timestamp"),
    )


def first_seen_ids(frames: DataFrame, text: str, index: str = "index", block_rows: int = 1_000_000) -> DataFrame:
    """Task ids by first appearance of each text."""
    first = frames.groupBy(named(text)).agg(F.min(named(index)).alias("first_row"))
    ranked = blocked_scan(
        first, [], position_block(F.col("first_row"), block_rows), ["first_row"],
        {"task_index": running_sum(F.lit(1).cast("long"))},
    )
    return ranked.select(named(text), (F.col("task_index") - 1).alias("task_index"), "first_row")


def candidate_rows(episodes: DataFrame) -> DataFrame:
    """Rows worth re-reading: first and last of the data, and of the first
    success and the first failure.  ``episodes`` has offset, length, success."""
    end = F.struct(F.col("offset").alias("first"), (F.col("offset") + F.col("length") - 1).alias("last"))
    pick = lambda outcome: F.min_by(end, F.when(F.col("success") == F.lit(outcome), F.col("offset")))
    found = episodes.agg(
        F.min("offset").alias("head"),
        F.max(F.col("offset") + F.col("length") - 1).alias("tail"),
        pick(True).alias("won"),
        pick(False).alias("lost"),
    )
    rows = F.array_distinct(F.array_compact(F.array("head", "tail", "won.first", "won.last", "lost.first", "lost.last")))
    return found.select(F.explode(rows).alias("index"))

"""Train/validation splits by whole episode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epistride.columns import COLUMNS, Columns, named
from epistride.operators.integrity import coverage, distinct_episodes
from epistride.operators.scans import hash_rank, spread_join
from epistride.session import stored


def validation_count(episodes: Column, fraction: float) -> Column:
    """Episodes to hold out: half-even rounding, at least one, never all."""
    wanted = F.greatest(
        F.lit(1).cast("double"), F.least(episodes - 1, F.rint(episodes * F.lit(float(fraction))))
    ).cast("long")
    return F.when((episodes <= 1) | F.lit(fraction <= 0), F.lit(0).cast("long")).otherwise(wanted)


def seeded_split(frames: DataFrame, fraction: float, seed: int, c: Columns = COLUMNS) -> DataFrame:
    """(episode, split): the episodes with the smallest seeded hash are held out.

    The same ids and seed always give the same split, in whatever order or
    partitioning the rows arrive.
    """
    episodes = stored(distinct_episodes(frames, c), "episodes")
    held_out = episodes.agg(F.count(F.lit(1)).alias("n")).select(
        validation_count(F.col("n"), fraction).alias("held_out")
    )
    ranked = hash_rank(episodes, str(seed), named(c.episode), [c.episode])
    return ranked.select(
        named(c.episode),
        F.when(F.col("rank") <= held_out.scalar(), "val").otherwise("train").alias("split"),
    )


def select_split(frames: DataFrame, split: DataFrame, name: str, c: Columns = COLUMNS) -> DataFrame:
    """Frames of one split, or of ``all``.

    A hot episode's frames are spread over all tasks, also where the split is
    derived in the same plan.
    """
    if name == "all":
        return frames
    wanted = split.where(F.col("split") == name).select(named(c.episode))
    return spread_join(frames, wanted, [c.episode], [n for n in c.key if n in frames.columns], "left_semi")


def split_overlap(split: DataFrame, c: Columns = COLUMNS) -> DataFrame:
    """Episodes that occur on both sides."""
    side = lambda name: split.where(F.col("split") == name).select(named(c.episode))
    return side("train").intersect(side("val"))


def split_coverage(split: DataFrame, frames: DataFrame, c: Columns = COLUMNS) -> DataFrame:
    """Split episodes without frames, and episodes in neither split."""
    return coverage(split, frames, c.episode)


def trainer_shard(ranked: DataFrame, shards: int, rank: str = "rank", name: str = "shard") -> DataFrame:
    """Round-robin shard of a 1-based rank: nothing padded, nothing repeated."""
    return ranked.withColumn(name, F.pmod(named(rank) - 1, F.lit(shards)).cast("int"))

"""Frames stored by episode and block, so that what works on blocks finds them in place.

A table bucketed and sorted by (episode, block) is shuffled once, when it is
written.  Episode joins, running computations inside a block and checksums
of blocks then read each bucket as it lies; only rows of the episode side and
summaries of blocks move.  The block is part of the key, so an episode that
holds most of the frames is spread over the buckets.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epistride.columns import COLUMNS, Columns, named
from epistride.operators.scans import BLOCK_ROWS, STORED_BLOCK, blocked_scan, position_block, wrapped_block
from epistride.session import scratch_path


def stored_by_episode(frames: DataFrame, buckets: int | None = None, c: Columns = COLUMNS) -> DataFrame:
    """The frames, written to the shared folder as a bucketed table, with the block as a further column.

    As many buckets as shuffle partitions unless told otherwise; each is one file.
    """
    spark = frames.sparkSession
    count = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"frames_{uuid.uuid4().hex}"
    placed = frames.withColumn(STORED_BLOCK, wrapped_block(position_block(named(c.frame), BLOCK_ROWS)))
    (
        placed.repartition(count, named(c.episode), STORED_BLOCK)
        .write.option("path", scratch_path(spark, "colocated"))
        .bucketBy(count, c.episode, STORED_BLOCK)
        .sortBy(c.episode, STORED_BLOCK, c.frame)
        .saveAsTable(name)
    )
    return spark.table(name)


def plain(frames: DataFrame) -> DataFrame:
    """Without the block's column."""
    return frames.drop(STORED_BLOCK)


def running_by_episode(frames: DataFrame, outputs: dict, c: Columns = COLUMNS) -> DataFrame:
    """Running ``outputs`` along each episode's frames, block by block where the frames lie.

    Frame numbers must lie below the count at which blocks wrap around.
    """
    return blocked_scan(frames, [c.episode], F.col(STORED_BLOCK), [c.frame], outputs)

"""Column names as configuration, and the schemas of the tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Columns:
    """Names of the frame-table fields; pass another instance to rename them."""

    episode: str = "episode_index"
    frame: str = "frame_index"
    index: str = "index"
    task: str = "task_index"
    task_text: str = "task"
    timestamp: str = "timestamp"
    action: str = "action"
    state: str = "observation.state"
    ret: str = "return"
    ret_raw: str = "return_raw"
    success: str = "episode_success"

    @property
    def key(self) -> list[str]:
        return [self.episode, self.frame]


COLUMNS = Columns()


def named(name: str) -> Column:
    """A top-level column whose name may hold dots or slashes."""
    return F.col(f"`{name}`")


EPISODE_LINES = T.StructType(
    [
        T.StructField("episode_index", T.LongType()),
        T.StructField("tasks", T.ArrayType(T.StringType())),
        T.StructField("length", T.LongType()),
    ]
)

TASK_LINES = T.StructType(
    [T.StructField("task_index", T.LongType()), T.StructField("task", T.StringType())]
)

MOMENTS = T.StructType(
    [
        T.StructField("min", T.ArrayType(T.DoubleType())),
        T.StructField("max", T.ArrayType(T.DoubleType())),
        T.StructField("mean", T.ArrayType(T.DoubleType())),
        T.StructField("std", T.ArrayType(T.DoubleType())),
        T.StructField("count", T.ArrayType(T.LongType())),
    ]
)

EPISODE_STATS_LINES = T.StructType(
    [
        T.StructField("episode_index", T.LongType()),
        T.StructField("stats", T.MapType(T.StringType(), MOMENTS)),
    ]
)

SPLIT_LINES = T.StructType(
    [
        T.StructField("schema_version", T.IntegerType()),
        T.StructField("seed", T.LongType()),
        T.StructField("val_fraction", T.DoubleType()),
        T.StructField("train", T.ArrayType(T.LongType())),
        T.StructField("val", T.ArrayType(T.LongType())),
    ]
)

FEATURE = T.StructType(
    [
        T.StructField("dtype", T.StringType()),
        T.StructField("shape", T.ArrayType(T.LongType())),
        T.StructField("names", T.ArrayType(T.StringType())),
    ]
)

INFO_LINES = T.StructType(
    [
        T.StructField("codebase_version", T.StringType()),
        T.StructField("robot_type", T.StringType()),
        T.StructField("total_episodes", T.LongType()),
        T.StructField("total_frames", T.LongType()),
        T.StructField("total_tasks", T.LongType()),
        T.StructField("total_videos", T.LongType()),
        T.StructField("total_chunks", T.LongType()),
        T.StructField("chunks_size", T.LongType()),
        T.StructField("fps", T.DoubleType()),
        T.StructField("splits", T.MapType(T.StringType(), T.StringType())),
        T.StructField("data_path", T.StringType()),
        T.StructField("video_path", T.StringType()),
        T.StructField("features", T.MapType(T.StringType(), FEATURE)),
    ]
)

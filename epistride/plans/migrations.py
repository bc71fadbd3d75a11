"""Carrying a dataset from one schema generation to the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epistride.columns import COLUMNS, Columns, named
from epistride.functions.scalars import clean_text
from epistride.operators import statistics
from epistride.operators.integrity import coverage, frame_spans, require_none, zero_based
from epistride.operators.scans import join_episodes
from epistride.operators.shards import episode_shards, episode_table
from epistride.operators.tasks import index_tasks, single_task, task_lists
from epistride.session import stored
from epistride.sources import publish, readers, writers

STATISTICS = "feature string, position int, min double, max double, mean double, std double, count long"


def with_episode_tasks(frames: DataFrame, pairs: DataFrame, c: Columns = COLUMNS) -> DataFrame:
    """Frames with the instruction of their episode from (key, value) pairs."""
    mapping = single_task(task_lists(pairs))
    require_none(mapping.where(F.col("task").isNull()), "episodes without exactly one instruction")
    require_none(coverage(mapping, frames, c.episode), "instructions and episodes differ", ["episode_index"])
    texts = mapping.select(F.col("episode_index").alias(c.episode), "task")
    spans = frame_spans(frames, c).join(texts, c.episode)
    joined = join_episodes(frames, spans, c.episode, c.frame)
    return joined.select(*[named(n) for n in frames.columns], F.col("__task").alias(c.task_text))


def to_indexed_tasks(frames: DataFrame, task: str | None = None, column: str | None = None, c: Columns = COLUMNS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """First step: (frames with task_index, task table, episode lines).

    The instruction is one text for all frames, or a column.
    """
    if (task is None) == (column is None):
        raise ValueError("give exactly one of task and column")
    base = zero_based(frames, c)
    require_none(base.where(~F.col("zero_based")), "episode ids must be 0..n-1", ["episodes"])
    text = column or c.task_text
    source = frames if column else frames.withColumn(text, F.lit(task))
    empty = source.where(clean_text(named(text)).isNull()).select(named(c.episode))
    require_none(empty, "frames without an instruction", [c.episode])
    indexed, tasks = index_tasks(source, text, c)
    # Instructions of an episode in order of their first frame.
    firsts = source.groupBy(named(c.episode), named(text)).agg(
        F.min(named(c.frame)).alias("first"), F.count(F.lit(1)).alias("n")
    )
    episodes = firsts.groupBy(named(c.episode).alias("episode_index")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("first", named(text).alias("t")))), lambda s: s["t"]).alias("tasks"),
        F.sum("n").alias("length"),
    )
    return indexed, tasks, episodes


def write_indexed_tasks(
    frames: DataFrame,
    root: str,
    fps: float,
    task: str | None = None,
    column: str | None = None,
    c: Columns = COLUMNS,
) -> None:
    """The first step's dataset (v2.0): frame directories, JSON lines, statistics and info."""
    indexed, tasks, episodes = to_indexed_tasks(frames, task, column, c)
    tasks, episodes = stored(tasks, "tasks"), stored(episodes, "episodes")
    writers.write_task_lines(tasks, root)
    writers.write_episode_lines(episodes, root)
    writers.write_episode_files(indexed, root, c=c)
    features = statistics.numeric_features(indexed)
    writers.write_statistics(statistics.feature_statistics(indexed, [f for f in features if f != c.episode]), root)
    shapes = statistics.inferred_features(indexed)
    require_none(shapes.where(~F.col("fixed")), "features without a fixed shape", ["feature"])
    features = statistics.feature_map(shapes, motors=True)
    info = writers.dataset_info(
        episodes, tasks, features, fps, "v2.0",
        data_path="data/episode_chunk={episode_chunk}/episode_index={episode_index}",
    )
    writers.write_info(info, root)


def to_episode_statistics(frames: DataFrame, whole: DataFrame, tolerance: float = 1e-6, c: Columns = COLUMNS) -> DataFrame:
    """Second step: per-episode statistics that must add up to ``whole``."""
    features = [row[0] for row in whole.select("feature").distinct().collect()]
    # Read by each part of the check and by what follows.
    parts = stored(statistics.episode_statistics(frames, features, c), "statistics")
    require_none(
        statistics.rollup_differences(parts, whole, tolerance), "episode statistics do not add up", statistics.STAT_KEY
    )
    return parts


def write_episode_statistics(spark: SparkSession, source: str, output: str, tolerance: float = 1e-6, c: Columns = COLUMNS) -> None:
    """The second step: a v2.1 dataset from a v2.0 one.

    Per-episode statistics take the place of those of the whole, with which
    they must agree.
    """
    publish.check_output(spark, source, output)
    frames = stored(readers.read_episode_files(spark, source), "frames")
    whole = spark.read.schema(STATISTICS).json(f"{source}/meta/stats.json")
    info = readers.read_info(spark, source)

    def write(root: str) -> None:
        writers.write_episode_files(frames, root, c=c)
        parts = to_episode_statistics(frames, whole, tolerance, c)
        writers.write_episode_statistics_lines(statistics.as_episode_lines(parts, c), root)
        writers.write_episode_lines(readers.read_episode_lines(spark, source), root)
        writers.write_task_lines(readers.read_task_lines(spark, source), root)
        writers.write_info(info.withColumn("codebase_version", F.lit("v2.1")), root)

    publish.published(spark, output, write)


def write_sharded(spark: SparkSession, source: str, output: str, max_frames: int = writers.DATA_FRAMES, c: Columns = COLUMNS) -> None:
    """The third step: a v3.0 dataset from a v2.1 one, with the statistics merged."""
    publish.check_output(spark, source, output)
    frames = stored(readers.read_episode_files(spark, source), "frames")
    episodes = stored(readers.read_episode_lines(spark, source).select("episode_index", "length", "tasks"), "episodes")
    tasks = readers.read_task_lines(spark, source)
    fps = readers.read_info(spark, source).first()["fps"]
    parts = stored(statistics.from_episode_lines(readers.read_episode_statistics_lines(spark, source)), "statistics")

    def write(root: str) -> None:
        to_sharded(frames, episodes, tasks, root, fps, max_frames, c=c)
        writers.write_statistics(statistics.merge_statistics(parts), root)

    publish.published(spark, output, write)


def to_sharded(
    frames: DataFrame, episodes: DataFrame, tasks: DataFrame, root: str, fps: float, max_frames: int = writers.DATA_FRAMES,
    compression: str = "snappy", c: Columns = COLUMNS, padded: bool = False,
) -> None:
    """Third step: few episode-aligned shards plus an episode table.

    ``padded`` writes one file a shard under padded names, as other tools of
    the format expect it.
    """
    sharded = stored(episode_shards(episodes.select("episode_index", "length"), max_frames), "shards")
    write = writers.write_frame_files if padded else writers.write_frames
    write(frames, sharded, root, max_frames, compression, c)
    writers.write_episodes(episode_table(episodes, sharded), root)
    writers.write_tasks(tasks, root)
    features = statistics.feature_map(statistics.inferred_features(frames))
    path = {"data_path": writers.FILE_PATH} if padded else {}
    writers.write_info(writers.dataset_info(episodes, tasks, features, fps, **path), root)

"""From flat frame rows and an episode list to a sharded dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epistride.columns import COLUMNS, Columns, named
from epistride.functions.scalars import all_finite
from epistride.operators import integrity, layout, returns, shards, statistics
from epistride.session import stored
from epistride.sources import publish, readers, writers


def flat_frames(rows: DataFrame, episodes: DataFrame, fps: float, c: Columns = COLUMNS) -> DataFrame:
    """Rows with a global ``index`` get their episode, frame and timestamp.

    ``episodes`` has episode_index, length, ep_offset and ep_success.
    """
    total = rows.agg(F.count(F.lit(1)).alias("n"))
    integrity.require_none(shards.layout_problems(episodes, total), "flat layout", ["problem", "episode_index"])
    placed = shards.locate_rows(rows, episodes.withColumn("offset", F.col("ep_offset")), c.index)
    return placed.withColumns(
        {c.timestamp: (named(c.frame) / F.lit(float(fps))).cast("float"), c.task: F.lit(0).cast("long")}
    )


def write_flat_dataset(
    spark: SparkSession,
    rows: DataFrame,
    episodes: DataFrame,
    task: str,
    output: str,
    fps: float,
    camera: str | None = None,
    max_data_frames: int = writers.DATA_FRAMES,
    max_video_frames: int | None = None,
    normalisation: str = "task_max",
    failure_penalty: float | None = None,
    step_scale: float = 1.0,
    compression: str = "snappy",
    c: Columns = COLUMNS,
) -> DataFrame:
    """Write shards and metadata, re-read them, and return one report row."""
    if not task.strip():
        raise ValueError("the task text is empty")
    publish.check_output(spark, None, output)
    vectors = [n for n in (c.action, c.state) if n in rows.columns]
    for name in vectors:
        integrity.require_none(rows.where(~all_finite(named(name))).select(named(c.index)), f"{name} is not finite", [c.index])
    frames = stored(flat_frames(rows, episodes, fps, c), "frames")
    label = episodes.select(F.col("episode_index").alias(c.episode), (F.col("ep_success") == 1).alias("success"))
    made = returns.with_returns(frames, label, normalisation, failure_penalty, step_scale, c)
    lengths = episodes.select("episode_index", "length")
    sharded = stored(shards.episode_shards(lengths, max_data_frames), "shards")
    tasks = spark.createDataFrame([(0, task.strip())], "task_index long, task string")

    def write(root: str) -> None:
        writers.write_frames(made, sharded, root, max_data_frames, compression, c)
        video = None
        if camera is not None and max_video_frames not in (None, max_data_frames):
            video = shards.episode_shards(lengths, max_video_frames)
        told = lengths.select("episode_index", F.array(F.lit(task.strip())).alias("tasks"))
        writers.write_episodes(shards.episode_table(told, sharded, video, fps, camera), root)
        writers.write_tasks(tasks, root)
        features = statistics.feature_map(statistics.inferred_features(made))
        writers.write_info(writers.dataset_info(lengths, tasks, features, fps), root)
        verify_flat_dataset(spark, root, made, episodes, c)
        ranges = returns.value_ranges(readers.read_frames(spark, root, made.schema), c)
        outcome = episodes.select("length", (F.col("ep_success") == 1).alias("success"))
        manifest = writers.conversion_manifest(outcome, ranges, sharded, task.strip(), fps, normalisation)
        writers.write_document(manifest, f"{root}/meta/conversion_manifest.json")

    publish.published(spark, output, write)
    return layout.structure_check(
        readers.read_frames(spark, output, made.schema),
        readers.read_episodes(spark, output),
        readers.read_tasks(spark, f"{output}/meta/tasks.parquet"),
    )


def verify_flat_dataset(spark: SparkSession, output: str, expected: DataFrame, episodes: DataFrame, c: Columns = COLUMNS) -> DataFrame:
    """Counts of the written tables and a re-read of a few telling rows."""
    written = readers.read_frames(spark, output, expected.schema)
    structure = layout.structure_check(
        written, readers.read_episodes(spark, output), readers.read_tasks(spark, f"{output}/meta/tasks.parquet")
    )
    integrity.require_none(structure.where(~F.col("consistent")), "written tables disagree", ["frame_rows"])
    rows = shards.candidate_rows(
        episodes.select(F.col("ep_offset").alias("offset"), "length", (F.col("ep_success") == 1).alias("success"))
    )
    size = F.size(named(c.action)) if c.action in expected.columns else F.lit(0)
    # At most six row numbers, so they go to the scans as a filter.
    chosen = [row[0] for row in rows.collect()]
    sample = lambda df: df.where(named(c.index).isin(chosen)).select(
        named(c.index).alias("index"), size.alias("dimension"), named(c.ret).alias("return")
    )
    checked = layout.spot_check(rows, sample(written), sample(expected))
    integrity.require_none(
        checked.where(~(F.col("found") & F.col("dimension_ok") & F.col("return_ok"))), "written rows differ", ["index"]
    )
    return structure

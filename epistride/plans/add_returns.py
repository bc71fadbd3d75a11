"""From labelled frames to a new dataset with return targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epistride.columns import COLUMNS, Columns, named
from epistride.functions.scalars import clean_task
from epistride.functions.versions import NEWEST
from epistride.operators import integrity, labels, returns, statistics
from epistride.operators.bitmaps import bit_of, word_of
from epistride.operators.tasks import index_tasks, task_problems
from epistride.plans.migrations import to_sharded
from epistride.session import stored
from epistride.sources import publish, readers, writers


def episode_labels(spark: SparkSession, frames: DataFrame, success_key: str | None, reduction: str, label_path: str | None, c: Columns) -> tuple[DataFrame, str, str]:
    """Labels with their origin: a success column wins over a label file."""
    from_file = readers.read_success_labels(spark, label_path) if label_path else None
    if from_file is not None:
        integrity.require_none(readers.label_file_problems(from_file), "label file", ["entry"])
    column = labels.success_column(frames.columns, success_key)
    if column is not None:
        return labels.reduce_success(frames, column, reduction, c), column, reduction
    if from_file is None:
        raise ValueError("no success column and no label file; success is never guessed")
    return from_file.select(F.col("episode_index").alias(c.episode), "success"), label_path, "file"


def frame_problems(frames: DataFrame, step: str, c: Columns = COLUMNS) -> DataFrame:
    """Episodes that are not consecutive or not of one task: (episode, problem).

    One pass, one group for every 64 steps: rows, different steps, and the
    range of steps and tasks.
    """
    n = named(step)
    per_word = frames.groupBy(named(c.episode), word_of(n).alias("word")).agg(
        F.count(F.lit(1)).alias("rows"), F.bit_or(bit_of(n)).alias("bits"), F.min(n).alias("first"), F.max(n).alias("last"),
        F.min(named(c.task)).alias("low_task"), F.max(named(c.task)).alias("high_task"),
    )
    per_episode = per_word.groupBy(named(c.episode)).agg(
        F.sum("rows").alias("rows"),
        F.sum(F.bit_count("bits")).alias("steps"),
        (F.max("last") - F.min("first") + 1).alias("span"),
        F.min("low_task").alias("low_task"),
        F.max("high_task").alias("high_task"),
    )
    problem = F.when(F.col("low_task") != F.col("high_task"), "several tasks").when(
        (F.col("rows") != F.coalesce("steps", F.lit(0))) | (F.col("span") != F.col("steps")), "steps are not consecutive"
    )
    return per_episode.select(named(c.episode), problem.alias("problem")).where(F.col("problem").isNotNull())


def check_frames(frames: DataFrame, step: str, c: Columns = COLUMNS) -> None:
    """Raise unless episodes are contiguous, consecutive and of one task."""
    integrity.require_none(frame_problems(frames, step, c), "episodes", [c.episode, "problem"])
    if c.index in frames.columns:
        integrity.require_none(integrity.scattered_episodes(frames, c), "episodes that are not contiguous", [c.episode])
        integrity.require_none(integrity.broken_steps(frames, step, c), "steps that are not consecutive", [c.episode, step])


def add_returns(
    spark: SparkSession,
    frames: DataFrame,
    output: str,
    fps: float,
    source: str | None = None,
    tasks: DataFrame | None = None,
    success_key: str | None = None,
    reduction: str = "any",
    label_path: str | None = None,
    normalisation: str = "task_max",
    failure_penalty: float | None = None,
    step_scale: float = 1.0,
    step: str | None = None,
    recompute_statistics: bool = True,
    max_frames: int = writers.DATA_FRAMES,
    c: Columns = COLUMNS,
) -> DataFrame:
    """A new dataset with returns and labels, complete and verified.

    It holds data, episodes, tasks, info with the new features, statistics,
    the return definition and a manifest.  Nothing appears under ``output``
    unless the written rows agree with returns derived in another way.
    ``tasks`` is (task_index, task); without it frames must carry the
    instruction, or ``source`` a task table.
    """
    publish.check_output(spark, source, output)
    taken = sorted({c.ret, c.ret_raw} & set(frames.columns))
    if taken:
        raise ValueError(f"columns exist already: {taken}")
    if c.task not in frames.columns:
        if c.task_text not in frames.columns:
            raise KeyError("frames need a task id or an instruction")
        cleaned = frames.withColumn(c.task_text, clean_task(frames, c.task_text))
        empty = cleaned.where(named(c.task_text).isNull()).select(named(c.episode))
        integrity.require_none(empty, "empty instructions", [c.episode])
        frames, tasks = index_tasks(cleaned, c.task_text, c)
    elif tasks is None:
        if source is None:
            raise KeyError("frames with task ids need a task table")
        tasks = readers.read_tasks(spark, f"{source}/meta/tasks.parquet")
    integrity.require_none(task_problems(frames, tasks, c), "tasks", ["task_index", "problem"])
    check_frames(frames, step or c.frame, c)
    label, origin, how = episode_labels(spark, frames, success_key, reduction, label_path, c)
    integrity.require_none(labels.label_problems(frames, label, c), "success labels", [c.episode, "problem"])
    if c.success in frames.columns:
        integrity.require_none(
            labels.disagreeing_labels(frames, label, c.success, c), "stored label differs", [c.episode, c.frame]
        )
    version = None
    if source is not None and publish.exists(spark, f"{source}/meta/info.json"):
        version = readers.read_info(spark, source).first()["codebase_version"]
    kept = tuple(n for n in frames.columns if n != c.success)
    terms = stored(returns.episode_terms(frames, label, failure_penalty, step_scale, c, step), "terms")
    made = returns.with_returns(frames, label, normalisation, failure_penalty, step_scale, c, kept, step, terms)
    tasks = stored(tasks.select("task_index", "task"), "tasks")
    told = frames.select(named(c.episode), named(c.task)).distinct().join(
        tasks.withColumnRenamed("task_index", c.task), c.task
    )
    episodes = terms.join(told, c.episode).select(named(c.episode).alias("episode_index"), "length", F.array("task").alias("tasks"))
    episodes = stored(episodes, "episodes")
    steps = ["add returns"] if version in (None, NEWEST) else [f"{version} to {NEWEST}", "add returns"]

    def write(root: str) -> None:
        to_sharded(made, episodes, tasks, root, fps, max_frames, c=c)
        written = readers.read_frames(spark, root, made.schema)
        expected = returns.returns_by_rank(frames, terms, normalisation, step_scale, c, step)
        integrity.require_none(returns.verify_augmented(written, expected, c), "written rows differ", [*c.key, "problem"])
        if recompute_statistics:
            writers.write_statistics(statistics.feature_statistics(written), root)
        lengths = terms.join(told, c.episode).groupBy(named(c.task)).agg(F.max("length").alias("task_max_length"))
        definition = writers.return_definition(
            terms, lengths, normalisation, failure_penalty, step_scale, returns.raw_range(terms, step_scale), origin, how, source, version, steps
        )
        writers.write_document(definition, f"{root}/meta/return_definition.json")
        writers.write_document(writers.migration_manifest(spark, source, version, steps), f"{root}/meta/conversion_manifest.json")

    publish.published(spark, output, write)
    return readers.read_frames(spark, output, made.schema)

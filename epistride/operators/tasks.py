"""Instructions: per frame, per episode and per task id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epistride.columns import COLUMNS, Columns, named
from epistride.functions.scalars import clean_text, strict_long_token
from epistride.operators.scans import spread_join
from epistride.operators.shards import first_seen_ids


def with_task_text(frames: DataFrame, tasks: DataFrame, c: Columns = COLUMNS) -> DataFrame:
    """Frames with the instruction of their task id; null when unknown."""
    if c.task_text in frames.columns:
        raise ValueError(f"frames have a column {c.task_text!r} already")
    texts = tasks.select(F.col("task_index").cast("long").alias(c.task), F.col("task").alias(c.task_text))
    return spread_join(frames, texts, [c.task], _row_names(frames, c), "left")


def _row_names(frames: DataFrame, c: Columns) -> list[str]:
    """What tells the frames of a task apart: the episode and frame, or what the table has."""
    return [n for n in (*c.key, c.index) if n in frames.columns] or frames.columns


def task_problems(frames: DataFrame, tasks: DataFrame, c: Columns = COLUMNS) -> DataFrame:
    """Task ids that are used but absent, listed twice, or without text."""
    used = frames.select(named(c.task).alias("task_index")).distinct()
    listed = tasks.groupBy("task_index").agg(
        F.count(F.lit(1)).alias("rows"), F.max(clean_text(F.col("task"))).alias("text")
    )
    problem = (
        F.when(F.col("rows").isNull(), "absent")
        .when(F.col("rows") > 1, "listed twice")
        .when(F.col("text").isNull(), "no text")
    )
    return used.join(listed, "task_index", "left").select("task_index", problem.alias("problem")).where(
        F.col("problem").isNotNull()
    )


def task_lists(pairs: DataFrame) -> DataFrame:
    """(episode_index, tasks) from (key, value) texts: a string or a JSON list.

    ``tasks`` is null when an instruction is empty or not a text.
    """
    value = F.col("value")
    tasks = F.when(F.ltrim(value).startswith("["), F.from_json(value, "array<string>")).otherwise(F.array(value))
    usable = (F.size(tasks) > 0) & F.forall(tasks, lambda t: F.coalesce(F.length(F.trim(t)) > 0, F.lit(False)))
    return pairs.select(
        strict_long_token(F.col("key")).alias("episode_index"), F.when(usable, tasks).alias("tasks")
    )


def single_task(lists: DataFrame) -> DataFrame:
    """(episode_index, task): null unless there is exactly one instruction."""
    return lists.select("episode_index", F.when(F.size("tasks") == 1, F.get("tasks", 0)).alias("task"))


def index_tasks(frames: DataFrame, text: str, c: Columns = COLUMNS) -> tuple[DataFrame, DataFrame]:
    """Replace the text column by ``task_index``; also the task table.

    Ids follow the first appearance of each text in table order.  No row is
    lost; frames without a text are an error of the caller's to check first.
    """
    tasks = first_seen_ids(frames, text, c.index).select(named(text).alias("task"), "task_index")
    ids = tasks.select(F.col("task").alias(text), F.col("task_index").alias(c.task))
    return spread_join(frames, ids, [text], _row_names(frames, c), "left").drop(text), tasks

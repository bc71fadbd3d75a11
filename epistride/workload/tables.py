"""The given tables seen as trajectories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from epistride.operators.integrity import episode_summary
from epistride.operators.labels import reduce_success
from epistride.operators.scans import number_rows
from epistride.session import stored

TASKS = 5


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def wall_micros(name: str) -> Column:
    """Microseconds of a zone-less timestamp, whatever the session's zone."""
    days = F.datediff(F.to_date(name), F.lit("1970-01-01").cast("date")).cast("long")
    minutes = (days * 24 + F.hour(name)) * 60 + F.minute(name)
    seconds = F.extract(F.lit("SECOND"), F.col(name)) * 1_000_000
    return minutes * 60_000_000 + seconds.cast("long")


def event_frames(spark: SparkSession, folder: str, *extra: str, ranges: int = 256) -> DataFrame:
    """Events as frames: a user is an episode, time gives the frame number.

    ``purchase`` is the per-frame success flag and ``observed`` the value.
    """
    events = table(spark, folder, "events").select(
        F.col("user_id").alias("episode_index"),
        wall_micros("ts").alias("at"),
        "event_id",
        (F.col("user_id") % TASKS).alias("task_index"),
        (F.col("event_type") == "purchase").cast("int").alias("next.success"),
        F.col("value").alias("observed"),
        *extra,
    )
    return number_rows(events, ["episode_index"], "at", ["event_id"], "frame_index", ranges).drop("at")


def event_table(spark: SparkSession, folder: str, *extra: str) -> DataFrame:
    """The same as a written table, for queries that read it more than once."""
    return stored(event_frames(spark, folder, *extra), "event-frames")


def event_labels(frames: DataFrame) -> DataFrame:
    """A user succeeds when the last event is a purchase."""
    return reduce_success(frames, "next.success", "last")


def conversation_frames(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations as frames; turns are frame numbers already."""
    return table(spark, folder, "conversations").select(
        F.col("conv_id").alias("episode_index"),
        F.col("turn").alias("frame_index"),
        "role",
        F.length("text").cast("long").alias("n_chars"),
        "text",
    )


def conversation_episodes(spark: SparkSession, folder: str) -> DataFrame:
    return episode_summary(conversation_frames(spark, folder)).select("episode_index", "length")


def line_frames(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines as frames: has repeated and missing frame numbers."""
    return table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("episode_index"),
        F.col("l_linenumber").cast("long").alias("frame_index"),
        F.col("l_quantity").alias("quantity"),
    )


def vector_frames(spark: SparkSession, folder: str) -> DataFrame:
    """Embeddings as actions; the label is the episode, order is vec_id."""
    vectors = table(spark, folder, "embeddings").select(
        F.col("label").cast("long").alias("episode_index"), "vec_id", F.col("embedding").alias("action")
    )
    return number_rows(vectors, ["episode_index"], "vec_id", ["vec_id"], "frame_index")


def document_episodes(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as episodes: the length is the number of characters."""
    return table(spark, folder, "documents").select(
        F.col("doc_id").alias("episode_index"), F.col("n_chars").alias("length"), F.col("source").alias("task")
    )


# The same views in the oracle's SQL.

EVENT_FRAMES = """
frames AS (
  SELECT user_id AS episode_index,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_index,
         user_id % 5 AS task_index, event_id, event_type, value AS observed,
         CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS flag
  FROM events)"""

EVENT_EPISODES = EVENT_FRAMES + """,
episodes AS (
  SELECT episode_index, min(task_index) AS task_index, count(*) AS length,
         max(frame_index) AS last_frame, arg_max(flag, frame_index) = 1 AS success
  FROM frames GROUP BY 1)"""

EVENT_RETURNS = EVENT_EPISODES + """,
terms AS (
  SELECT *, max(length) OVER (PARTITION BY task_index) AS lmax FROM episodes),
returns AS (
  SELECT f.*, t.length, t.success, t.lmax,
         CASE WHEN t.success THEN 0 ELSE -t.lmax END - (t.length - 1 - f.frame_index) AS raw,
         greatest(-1.0, least(0.0, (CASE WHEN t.success THEN 0 ELSE -t.lmax END
                                    - (t.length - 1 - f.frame_index))::DOUBLE / t.lmax)) AS ret
  FROM frames f JOIN terms t USING (episode_index))"""

VECTOR_FRAMES = """
frames AS (
  SELECT CAST(label AS BIGINT) AS episode_index, vec_id, embedding AS action,
         row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame_index
  FROM embeddings)"""


def split_sql(episodes: str, fraction: float, seed: int, name: str = "split") -> str:
    """Seeded split of the ids of a relation with ``episode_index``."""
    return f"""
{name}_ids AS (SELECT DISTINCT episode_index FROM {episodes}),
{name}_size AS (
  SELECT CASE WHEN count(*) <= 1 OR {fraction} <= 0 THEN 0
              ELSE greatest(1, least(count(*) - 1, round_even(count(*) * {fraction}, 0))) END AS held
  FROM {name}_ids),
{name} AS (
  SELECT episode_index,
         CASE WHEN row_number() OVER (ORDER BY md5(concat('{seed}:', episode_index)), episode_index) <= held
              THEN 'val' ELSE 'train' END AS split
  FROM {name}_ids, {name}_size)"""


def r6(expression: str) -> str:
    """Six places, and never a negative zero."""
    return f"(round({expression}, 6) + 0.0)"

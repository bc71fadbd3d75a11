"""Readers, writers, shards, layouts and migrations.

Queries of readers and writers derive a dataset from the given tables, write
it to the shared folder, and read it back.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from epistride.functions import scalars as S
from epistride.functions.versions import migration_chain, migration_steps, normalise_version
from epistride.operators import align, integrity, layout, returns, shards, splits, statistics, tasks
from epistride.operators.checksums import compared_rows
from epistride.plans import add_returns as returns_plan
from epistride.plans import evaluation, flat_dataset, migrations, training
from epistride.session import scratch_path, stored
from epistride.sources import publish, readers, writers
from epistride.workload.evaluation import SCORED, closed_form_scorer
from epistride.workload.registry import query
from epistride.workload.tables import (
    EVENT_EPISODES,
    EVENT_FRAMES,
    EVENT_RETURNS,
    conversation_episodes,
    conversation_frames,
    document_episodes,
    event_labels,
    event_table,
    r6,
    split_sql,
    table,
)

CAP = 20_000

# Shards ------------------------------------------------------------------

OFFSETS_SQL = """
sized AS (SELECT doc_id AS episode_index, n_chars AS length,
                 coalesce(sum(n_chars) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset"
          FROM documents)"""

SHARDS_SQL = f"""
WITH RECURSIVE {OFFSETS_SQL},
numbered AS (SELECT *, row_number() OVER (ORDER BY episode_index) AS n FROM sized),
packed AS (
  SELECT n, length AS used, 0::BIGINT AS shard FROM numbered WHERE n = 1
  UNION ALL
  SELECT x.n, CASE WHEN p.used + x.length > {CAP} THEN x.length ELSE p.used + x.length END,
         p.shard + CASE WHEN p.used + x.length > {CAP} THEN 1 ELSE 0 END
  FROM packed p JOIN numbered x ON x.n = p.n + 1),
sharded AS (SELECT x.episode_index, x.length, x."offset", p.shard FROM numbered x JOIN packed p USING (n))"""


@query("E5", f"WITH {OFFSETS_SQL} SELECT * FROM sized")
def episode_offsets(spark: SparkSession, folder: str) -> DataFrame:
    return shards.episode_offsets(document_episodes(spark, folder).select("episode_index", "length"))


@query("E10", f"{SHARDS_SQL} SELECT * FROM sharded")
def episode_shards(spark: SparkSession, folder: str) -> DataFrame:
    return shards.episode_shards(document_episodes(spark, folder).select("episode_index", "length"), CAP)


@query("E10 B13 K1", f"""
{SHARDS_SQL}
SELECT shard, min(episode_index) AS episode_start, max(episode_index) + 1 AS episode_end, min("offset") AS frame_start,
       CAST(max("offset" + length) AS BIGINT) AS frame_end, shard // 1000 AS chunk_index, shard % 1000 AS file_index
FROM sharded GROUP BY shard""")
def shard_ranges(spark: SparkSession, folder: str) -> DataFrame:
    lengths = document_episodes(spark, folder).select("episode_index", "length")
    return shards.shard_ranges(shards.episode_shards(lengths, CAP))


@query("B14 B13", """
SELECT doc_id, concat('data/chunk-', lpad(CAST(doc_id // 1000 AS VARCHAR), 3, '0'), '/file-', lpad(CAST(doc_id % 1000 AS VARCHAR), 3, '0'), '.parquet') AS path
FROM documents""")
def shard_paths(spark: SparkSession, folder: str) -> DataFrame:
    number = F.col("doc_id")
    return table(spark, folder, "documents").select(
        "doc_id", S.shard_path("data", S.chunk_of(number), S.file_of(number), "parquet").alias("path")
    )


@query("B15 K2", f"""
{SHARDS_SQL},
begins AS (SELECT shard, min("offset") AS begins FROM sharded GROUP BY 1)
SELECT episode_index, shard // 1000 AS "videos/cam/chunk_index", shard % 1000 AS "videos/cam/file_index",
       {r6('("offset" - begins) / 25.0')} AS "videos/cam/from_timestamp",
       {r6('("offset" - begins + length) / 25.0')} AS "videos/cam/to_timestamp"
FROM sharded JOIN begins USING (shard)""")
def video_ranges(spark: SparkSession, folder: str) -> DataFrame:
    lengths = document_episodes(spark, folder).select("episode_index", "length")
    made = shards.video_ranges(stored(shards.episode_shards(lengths, CAP), "shards"), 25.0, "cam")
    return made.select(
        *[F.round(f"`{n}`", 6).alias(n) if n.endswith("timestamp") else F.col(f"`{n}`") for n in made.columns]
    )


CONVERSATION_LAYOUT_SQL = """
sized AS (SELECT conv_id AS episode_index, count(*) AS length FROM conversations GROUP BY 1),
placed AS (SELECT *, coalesce(sum(length) OVER (ORDER BY episode_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM sized)"""


def _flat_layout(spark: SparkSession, folder: str) -> DataFrame:
    return shards.episode_offsets(conversation_episodes(spark, folder))


@query("C5 B12", f"""
WITH {CONVERSATION_LAYOUT_SQL}
SELECT episode_index, turn AS frame_index, "offset" + turn AS "index", CAST(0 AS BIGINT) AS task_index,
       round(CAST(CAST(turn / 10.0 AS FLOAT) AS DOUBLE), 5) AS "timestamp"
FROM placed JOIN conversations ON conv_id = episode_index""")
def frames_of_episodes(spark: SparkSession, folder: str) -> DataFrame:
    made = shards.frames_of_episodes(_flat_layout(spark, folder), fps=10.0)
    return made.withColumn("timestamp", F.round(F.col("timestamp").cast("double"), 5))


@query("C6 A14", f"""
WITH {CONVERSATION_LAYOUT_SQL}
SELECT "offset" + turn AS "index", episode_index, turn AS frame_index, length(text) AS n_chars
FROM placed JOIN conversations ON conv_id = episode_index""")
def located_rows(spark: SparkSession, folder: str) -> DataFrame:
    episodes = _flat_layout(spark, folder)
    return shards.locate_rows(_flat_rows(spark, folder, episodes), episodes)


def _flat_rows(spark: SparkSession, folder: str, episodes: DataFrame) -> DataFrame:
    """Conversation turns known only by their global row number."""
    return conversation_frames(spark, folder).join(episodes, "episode_index").select(
        (F.col("offset") + F.col("frame_index")).alias("index"), "n_chars"
    )


@query("D10 A14", """
SELECT doc_id AS episode_index, 'offset' AS problem FROM documents WHERE doc_id % 7 = 3
UNION ALL SELECT doc_id, 'success' FROM documents WHERE doc_id % 5 = 2
UNION ALL SELECT doc_id, 'length' FROM documents WHERE n_chars <= 0""")
def layout_problems(spark: SparkSession, folder: str) -> DataFrame:
    """A layout with wrong offsets and unusable success flags."""
    episodes = stored(shards.episode_offsets(document_episodes(spark, folder).select("episode_index", "length")), "layout")
    broken = episodes.select(
        "episode_index",
        "length",
        (F.col("offset") + F.when(F.col("episode_index") % 7 == 3, 1).otherwise(0)).alias("ep_offset"),
        (F.col("episode_index") % 5).alias("five"),
    ).withColumn("ep_success", F.when(F.col("five") == 2, 2).otherwise(F.col("five") % 2)).drop("five")
    return shards.layout_problems(broken, episodes.agg(F.sum("length").alias("n")))


@query("J3", """
SELECT doc_id AS episode_index, round((n_chars + CASE WHEN doc_id % 9 = 4 THEN 40 ELSE 0 END) / 25.0, 5) AS duration,
       round(n_chars / 25.0, 5) AS expected, 'duration' AS problem FROM documents WHERE doc_id % 9 = 4""")
def duration_problems(spark: SparkSession, folder: str) -> DataFrame:
    """Video ranges of which every ninth is too long."""
    extra = F.when(F.col("episode_index") % 9 == 4, 40).otherwise(0)
    rows = document_episodes(spark, folder).withColumns(
        {"videos/cam/from_timestamp": F.lit(0.0), "videos/cam/to_timestamp": (F.col("length") + extra) / 25.0}
    )
    found = align.duration_problems(rows, "cam", 25.0)
    return found.withColumns({n: F.round(n, 5) for n in ("duration", "expected")})


@query("G4", f"""
WITH {CONVERSATION_LAYOUT_SQL},
won AS (SELECT * FROM placed WHERE episode_index % 3 = 1 ORDER BY "offset" LIMIT 1),
lost AS (SELECT * FROM placed WHERE episode_index % 3 <> 1 ORDER BY "offset" LIMIT 1)
SELECT DISTINCT "index" FROM (
  SELECT min("offset") AS "index" FROM placed UNION ALL SELECT max("offset" + length) - 1 FROM placed
  UNION ALL SELECT "offset" FROM won UNION ALL SELECT "offset" + length - 1 FROM won
  UNION ALL SELECT "offset" FROM lost UNION ALL SELECT "offset" + length - 1 FROM lost)""")
def candidate_rows(spark: SparkSession, folder: str) -> DataFrame:
    episodes = _flat_layout(spark, folder).withColumn("success", F.col("episode_index") % 3 == 1)
    return shards.candidate_rows(episodes)


# Tables written and read back --------------------------------------------


def _write_dataset(spark: SparkSession, folder: str, max_frames: int = 1000, padded: bool = False) -> str:
    """Events as a sharded dataset; returns its root."""
    root = scratch_path(spark, "dataset")
    _fill_dataset(spark, folder, root, max_frames, padded)
    return root


def _fill_dataset(spark: SparkSession, folder: str, root: str, max_frames: int, padded: bool) -> None:
    frames = event_table(spark, folder)
    rows = frames.select("episode_index", "frame_index", "task_index", "event_id", "observed")
    text = F.concat(F.lit("task "), (F.col("episode_index") % 5).cast("string"))
    episodes = stored(
        integrity.episode_summary(frames).select("episode_index", "length", F.array(text).alias("tasks")), "episodes"
    )
    texts = rows.select("task_index").distinct().withColumn("task", F.concat(F.lit("task "), F.col("task_index").cast("string")))
    migrations.to_sharded(rows, episodes, texts, root, 25.0, max_frames, padded=padded)


FRAME_SCHEMA = T.StructType(
    [T.StructField(name, T.LongType()) for name in ("episode_index", "frame_index", "task_index", "event_id")]
    + [T.StructField("observed", T.DoubleType())]
)


@query("A1 K1 L3", f"WITH {EVENT_FRAMES} SELECT episode_index, frame_index, task_index, event_id, {r6('observed')} AS observed FROM frames")
def padded_frame_files(spark: SparkSession, folder: str) -> DataFrame:
    """A dataset of ``chunk-000/file-000.parquet`` files, read with the caller's schema."""
    frames = readers.read_frames(spark, _write_dataset(spark, folder, padded=True), FRAME_SCHEMA)
    return frames.withColumn("observed", F.round("observed", 6))


@query("A1 A3 C3", f"""
WITH {EVENT_FRAMES}, {split_sql('frames', 0.1, 11)}
SELECT episode_index, frame_index, task_index, event_id FROM frames JOIN split USING (episode_index) WHERE split = 'val'""")
def held_out_frame_files(spark: SparkSession, folder: str) -> DataFrame:
    """Frames of the held-out episodes, from the files that the episode table names for them."""
    root = _write_dataset(spark, folder, padded=True)
    episodes = readers.read_episodes(spark, root)
    held = splits.seeded_split(episodes.select("episode_index"), 0.1, 11).where("split = 'val'")
    chosen = episodes.join(held, "episode_index", "left_semi")
    return readers.read_episode_frames(spark, root, chosen, FRAME_SCHEMA).drop("observed")


@query("A1 K1 L3", f"WITH {EVENT_FRAMES} SELECT episode_index, frame_index, task_index, event_id FROM frames")
def frame_table_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    root = _write_dataset(spark, folder)
    return readers.read_frames(spark, root).select("episode_index", "frame_index", "task_index", "event_id")


EVENT_SHARDS_SQL = f"""{EVENT_EPISODES},
numbered AS (SELECT episode_index, length, row_number() OVER (ORDER BY episode_index) AS n FROM episodes),
packed AS (
  SELECT n, length AS used, 0::BIGINT AS shard FROM numbered WHERE n = 1
  UNION ALL
  SELECT x.n, CASE WHEN p.used + x.length > 1000 THEN x.length ELSE p.used + x.length END,
         p.shard + CASE WHEN p.used + x.length > 1000 THEN 1 ELSE 0 END FROM packed p JOIN numbered x ON x.n = p.n + 1)"""


@query("K1 E10", f"""
WITH RECURSIVE {EVENT_SHARDS_SQL}
SELECT CAST(shard // 1000 AS INTEGER) AS chunk, CAST(shard % 1000 AS INTEGER) AS file, CAST(sum(length) AS BIGINT) AS row_count,
       CAST(1 AS BIGINT) AS files FROM packed JOIN numbered USING (n) GROUP BY 1, 2""")
def shard_files(spark: SparkSession, folder: str) -> DataFrame:
    """Rows and files of every written shard directory."""
    root = _write_dataset(spark, folder)
    rows = spark.read.parquet(f"{root}/data").select("chunk", "file", F.input_file_name().alias("name"))
    return rows.groupBy("chunk", "file").agg(
        F.count(F.lit(1)).alias("row_count"), F.countDistinct("name").alias("files")
    )


@query("A2", "SELECT event_id FROM events")
def column_scan(spark: SparkSession, folder: str) -> DataFrame:
    return readers.read_column(table(spark, folder, "events"), "event_id", scalar=True)


@query("A3 K2", f"""
WITH RECURSIVE {EVENT_SHARDS_SQL}
SELECT episode_index, concat('task ', episode_index % 5) AS task, length, shard // 1000 AS chunk, shard % 1000 AS file,
       coalesce(sum(length) OVER (ORDER BY episode_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS dataset_from_index,
       (sum(length) OVER (ORDER BY episode_index))::BIGINT AS dataset_to_index
FROM (SELECT n.*, p.shard FROM packed p JOIN numbered n USING (n))""")
def episode_table_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    root = _write_dataset(spark, folder)
    return readers.read_episodes(spark, root).select(
        "episode_index", F.get("tasks", 0).alias("task"), "length", F.col("data/chunk_index").alias("chunk"),
        F.col("data/file_index").alias("file"), "dataset_from_index", "dataset_to_index",
    )


def _source_tasks(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").select(F.col("source").alias("task"), F.col("doc_id").alias("index"))
    return shards.first_seen_ids(rows, "task").select("task_index", "task")


TASKS_SQL = """
WITH first AS (SELECT source AS task, min(doc_id) AS f FROM documents GROUP BY 1)
SELECT row_number() OVER (ORDER BY f) - 1 AS task_index, trim(task) AS task FROM first"""


@query("A4 K3", TASKS_SQL)
def task_table_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    root = scratch_path(spark, "tasks")
    writers.write_tasks(_source_tasks(spark, folder), root)
    return readers.read_tasks(spark, f"{root}/meta/tasks.parquet")


@query("A4 A5 K3", TASKS_SQL)
def task_lines_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    root = scratch_path(spark, "tasks")
    writers.write_task_lines(_source_tasks(spark, folder), root)
    return readers.read_tasks(spark, f"{root}/meta/tasks.jsonl", "lines")


@query("A4 H8", TASKS_SQL)
def task_object_scan(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "tasks")
    pair = F.struct(F.col("task_index").cast("string"), "task")
    _source_tasks(spark, folder).groupBy(F.floor(F.col("task_index") / 8).alias("page")).agg(
        F.to_json(F.map_from_entries(F.collect_list(pair))).alias("value")
    ).select("value").write.text(path)
    return readers.read_tasks(spark, path, "object", pretty=False)


@query("A5 K5 L1 A6", """
SELECT conv_id AS episode_index, count(*) AS length, string_agg(DISTINCT role, ',' ORDER BY role) AS tasks FROM conversations GROUP BY 1""")
def legacy_episode_lines(spark: SparkSession, folder: str) -> DataFrame:
    """First migration step with the role as instruction column."""
    root = _write_legacy(spark, folder)
    return readers.read_episode_lines(spark, root).select(
        "episode_index", "length", F.array_join(F.sort_array("tasks"), ",").alias("tasks")
    )


def _write_legacy(spark: SparkSession, folder: str) -> str:
    root = scratch_path(spark, "legacy")
    migrations.write_indexed_tasks(_ordered_turns(spark, folder), root, 10.0, column="role")
    return root


def _migrated(spark: SparkSession, folder: str) -> str:
    """All three steps, each from the directory that the one before wrote."""
    root = _write_legacy(spark, folder)
    migrations.write_episode_statistics(spark, root, f"{root}-v21")
    migrations.write_sharded(spark, f"{root}-v21", f"{root}-v30", max_frames=200)
    return f"{root}-v30"


@query("L1 L2 L3 K1", """
WITH firsts AS (SELECT role, min(conv_id * 1000000 + turn) AS f FROM conversations GROUP BY 1),
ids AS (SELECT role, row_number() OVER (ORDER BY f) - 1 AS task_index FROM firsts),
sized AS (SELECT conv_id, count(*) AS length FROM conversations GROUP BY 1),
placed AS (SELECT *, coalesce(sum(length) OVER (ORDER BY conv_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS o FROM sized)
SELECT conv_id AS episode_index, turn AS frame_index, o + turn AS "index", task_index, length(text) AS n_chars
FROM conversations JOIN ids USING (role) JOIN placed USING (conv_id)""")
def migrated_frames(spark: SparkSession, folder: str) -> DataFrame:
    """Frames after the whole chain of schema generations."""
    return readers.read_frames(spark, _migrated(spark, folder)).select("episode_index", "frame_index", "index", "task_index", "n_chars")


@query("L2 L3 D19 D17", f"""
SELECT 'n_chars' AS feature, 0 AS position, min(length(text))::DOUBLE AS min, max(length(text))::DOUBLE AS max,
       {r6('avg(length(text))')} AS mean, {r6('stddev_pop(length(text))')} AS std, count(*) AS count FROM conversations
UNION ALL SELECT 'frame_index', 0, min(turn), max(turn), {r6('avg(turn)')}, {r6('stddev_pop(turn)')}, count(*) FROM conversations""")
def migrated_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """Statistics that the last step merged from those of the episodes."""
    stats = spark.read.schema(migrations.STATISTICS).json(f"{_migrated(spark, folder)}/meta/stats.json")
    return stats.where(F.col("feature").isin("n_chars", "frame_index")).withColumns({n: F.round(n, 6) for n in ("mean", "std")})


@query("L3 K2 K3 K4 B13", """
WITH sized AS (SELECT conv_id, count(*) AS length FROM conversations GROUP BY 1)
SELECT conv_id AS episode_index, length, (SELECT count(DISTINCT role) FROM conversations) AS tasks, 'v3.0' AS version, true AS addressed FROM sized""")
def migrated_episodes(spark: SparkSession, folder: str) -> DataFrame:
    """Episode rows after the chain; the address of each must hold its frames."""
    root = _migrated(spark, folder)
    frames = readers.read_frames(spark, root).groupBy("episode_index").agg(
        F.min("chunk").alias("chunk"), F.max("chunk").alias("last_chunk"), F.min("file").alias("file"), F.max("file").alias("last_file"),
        F.count(F.lit(1)).alias("rows"),
    )
    info = readers.read_info(spark, root)
    tasks = readers.read_tasks(spark, f"{root}/meta/tasks.parquet").agg(F.count(F.lit(1)).alias("n"))
    joined = readers.read_episodes(spark, root).join(frames, "episode_index")
    there = (
        (F.col("chunk") == F.col("data/chunk_index")) & (F.col("last_chunk") == F.col("chunk"))
        & (F.col("file") == F.col("data/file_index")) & (F.col("last_file") == F.col("file")) & (F.col("rows") == F.col("length"))
    )
    return joined.select(
        "episode_index", "length", tasks.scalar().alias("tasks"), info.select("codebase_version").scalar().alias("version"), there.alias("addressed")
    )


def _ordered_turns(spark: SparkSession, folder: str) -> DataFrame:
    """Conversation turns with their global row number."""
    turns = conversation_frames(spark, folder).select("episode_index", "frame_index", "role", "n_chars")
    numbered = turns.join(_flat_layout(spark, folder).select("episode_index", "offset"), "episode_index").withColumn(
        "index", F.col("offset") + F.col("frame_index")
    )
    return stored(numbered.drop("offset"), "turns")


@query("L1 A6 K5 E9", """
WITH firsts AS (SELECT role, min(conv_id * 1000000 + turn) AS f FROM conversations GROUP BY 1),
ids AS (SELECT role, row_number() OVER (ORDER BY f) - 1 AS task_index FROM firsts)
SELECT conv_id AS episode_index, turn AS frame_index, task_index, CAST(conv_id // 1000 AS INTEGER) AS episode_chunk, length(text) AS n_chars
FROM conversations JOIN ids USING (role)""")
def legacy_directory_scan(spark: SparkSession, folder: str) -> DataFrame:
    """The first step's per-episode directories, read back."""
    root = _write_legacy(spark, folder)
    return spark.read.parquet(f"{root}/data").select(
        F.col("episode_index").cast("long").alias("episode_index"), "frame_index", "task_index", "episode_chunk", "n_chars"
    )


@query("A12 K4 D23", """
SELECT feature, 'int64' AS dtype, CAST(count(DISTINCT conv_id) AS BIGINT) AS total_episodes, count(*) AS total_frames,
       count(DISTINCT role) AS total_tasks, '0:' || count(DISTINCT conv_id) AS train, 10.0::DOUBLE AS fps
FROM conversations, unnest(['episode_index', 'frame_index', 'index', 'n_chars', 'task_index']) t(feature) GROUP BY feature""")
def info_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    info = readers.read_info(spark, _write_legacy(spark, folder))
    listed = info.select("*", F.explode("features").alias("feature", "f"))
    return listed.select(
        "feature", "f.dtype", "total_episodes", "total_frames", "total_tasks", F.element_at("splits", "train").alias("train"), "fps"
    )


@query("A13 A12", """
SELECT conv_id AS episode_index, CASE WHEN conv_id % 3 = 0 THEN 2.5 * count(*) ELSE 50.0 + conv_id % 3 END::DOUBLE AS fps
FROM conversations GROUP BY 1""")
def resolved_fps(spark: SparkSession, folder: str) -> DataFrame:
    """One description per conversation: unusable rates give way to the next in line."""
    stated = conversation_episodes(spark, folder).withColumn("fps", F.col("length") * 2.5)
    kind = F.col("episode_index") % 3
    override = F.when(kind == 0, F.lit(float("nan"))).otherwise(50.0 + kind)
    return stated.select("episode_index", S.first_positive(F.lit(-1.0), override, F.col("fps")).alias("fps"))


@query("A13 A12", """
SELECT (SELECT count(DISTINCT user_id) FROM events) AS total_episodes, 25.0::DOUBLE AS stated, 12.5::DOUBLE AS overridden""")
def described_fps(spark: SparkSession, folder: str) -> DataFrame:
    """The rate of a written dataset's description, and an override's after unusable ones."""
    info = readers.read_info(spark, _write_dataset(spark, folder))
    stated, overridden = readers.resolved_fps(info, None, 0.0), readers.resolved_fps(info, float("nan"), -3.0, 12.5, 30.0)
    return info.select("total_episodes", stated.scalar().alias("stated"), overridden.scalar().alias("overridden"))


@query("J6", """
SELECT root, 'v3.0' AS version, 'files' AS basis, (SELECT count(*) FROM events) AS total_frames
FROM (VALUES ('plain'), ('parent')) r(root)""")
def listed_layouts(spark: SparkSession, folder: str) -> DataFrame:
    """Datasets found and classified by listing a folder; one lies below a parent of its own."""
    base = scratch_path(spark, "roots")
    roots = {"plain": f"{base}/plain", "parent": f"{base}/parent/dataset"}
    for root, padded in zip(roots.values(), (False, True)):
        publish.published(spark, root, lambda staged, padded=padded: _fill_dataset(spark, folder, staged, 1000, padded))
    files = layout.resolve_roots(layout.relative_paths(layout.list_files(spark, base), base), "dataset")
    infos = None
    for name, root in roots.items():
        info = readers.read_info(spark, root).select(F.lit(name).alias("root"), "total_frames")
        infos = info if infos is None else infos.unionByName(info)
    return layout.classify_roots(files).select("root", "version", "basis").join(infos, "root")


@query("A5", """
SELECT concat('root-', doc_id) AS root, ['meta/info.json', 'meta/episodes.jsonl', 'meta/tasks.jsonl', 'meta/stats.json'][k + 1] AS path
FROM (SELECT doc_id, n_chars % 6 AS k FROM documents) WHERE k < 4""")
def missing_metadata_files(spark: SparkSession, folder: str) -> DataFrame:
    """One root per document; the length of the text says which file it lacks."""
    listed = F.array(*[F.lit(p) for p in readers.REQUIRED_FILES["v2.0"]], F.lit("data/part-0.parquet"))
    there = F.filter(listed, lambda p: ~p.eqNullSafe(F.get(F.slice(listed, 1, 4), (F.col("n_chars") % 6).cast("int"))))
    root = F.concat(F.lit("root-"), F.col("doc_id").cast("string"))
    files = table(spark, folder, "documents").select(root.alias("root"), F.explode(there).alias("path"))
    return readers.missing_files(files, "v2.0")


LABELS_SQL = "SELECT doc_id AS episode_index, quality = 1 AS success FROM labels"


def _document_labels(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "labels").select(
        F.col("doc_id").alias("episode_index"), (F.col("quality") == 1).alias("success")
    )


@query("A7 B1 B2", LABELS_SQL)
def label_file_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "labels")
    writers.write_labels(_document_labels(spark, folder), path, page_ids=500)
    return readers.read_success_labels(spark, path).select("episode_index", "success")


@query("A7 B1", """
SELECT concat('"', doc_id, '": ', CASE WHEN quality = 1 THEN '1.5' ELSE '"true"' END) AS entry FROM labels WHERE doc_id % 4 = 0""")
def label_file_problems(spark: SparkSession, folder: str) -> DataFrame:
    """A label file in which every fourth entry is no boolean."""
    path = scratch_path(spark, "labels")
    bad = F.when(F.col("success"), "1.5").otherwise('"true"')
    good = F.when(F.col("success"), "1").otherwise("false")
    entry = F.concat(F.lit('"'), F.col("episode_index").cast("string"), F.lit('": '), F.when(F.col("episode_index") % 4 == 0, bad).otherwise(good))
    pages = _document_labels(spark, folder).groupBy(F.floor(F.col("episode_index") / 500)).agg(F.collect_list(entry).alias("entries"))
    whole = F.concat(F.lit("{ "), F.array_join("entries", ",\n"), F.lit("\n}"))
    pages.select(whole.alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return readers.label_file_problems(readers.read_success_labels(spark, path)).select("entry")


@query("A8", """
SELECT generate_series AS episode_index, false AS success
FROM generate_series((SELECT min(user_id) FROM events), (SELECT max(user_id) FROM events))""")
def generated_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Negative-control labels for the range of ids in the data."""
    from epistride.operators.labels import generated_labels as generate

    low, high = table(spark, folder, "events").agg(F.min("user_id"), F.max("user_id")).collect()[0]
    return generate(spark, low, high, False)


@query("A9 K8 I1", f"WITH {split_sql('(SELECT doc_id AS episode_index FROM documents)', 0.25, 9)} SELECT * FROM split")
def split_manifest_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "split")
    episodes = document_episodes(spark, folder)
    writers.write_split(splits.seeded_split(episodes, 0.25, 9), path, 9, 0.25, page_ids=300)
    return readers.read_split(spark, path)


POINTS_SQL = "SELECT conv_id AS episode_id, turn AS frame_index, round(sqrt(length(text)), 6) AS value FROM conversations"


def _turn_points(spark: SparkSession, folder: str) -> DataFrame:
    return conversation_frames(spark, folder).select(
        F.col("episode_index").alias("episode_id"),
        "frame_index",
        F.sqrt("n_chars").alias("value"),
        F.log(F.col("n_chars") + 2.0).alias("return"),
    )


@query("A10 K9 D20", POINTS_SQL)
def curve_artifact_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    target = scratch_path(spark, "curves")
    writers.write_curves(_turn_points(spark, folder), target)
    points = readers.read_curves(spark, f"{target}/episode_curves.json", pretty=False)
    return points.withColumn("value", F.round("value", 6))


@query("A10", POINTS_SQL)
def wrapped_curve_artifact(spark: SparkSession, folder: str) -> DataFrame:
    """Objects that hold their curves under ``episode_curves``."""
    from epistride.operators.curves import assemble_curves

    path = scratch_path(spark, "curves")
    pages = assemble_curves(_turn_points(spark, folder), page_frames=1024)
    pages.groupBy(F.floor(F.col("episode_id") / 100).alias("part"), "page").agg(
        F.collect_list(F.struct("episode_id", "page", "frame_indices", "values")).alias("episode_curves")
    ).select("episode_curves").write.json(path)
    return readers.read_curves(spark, path, pretty=False).withColumn("value", F.round("value", 6))


def _write_documents(members: DataFrame, path: str, ends: str) -> None:
    """JSON documents that span lines, one a ``part``, of members (part, at, member)."""
    first = members.groupBy("part").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    told = members.join(first, "part")
    opening = F.when(F.col("at") == F.col("first"), ends[0]).otherwise(",")
    closing = F.when(F.col("at") == F.col("last"), "\n" + ends[1]).otherwise("")
    lines = told.select("part", "at", F.concat(opening, F.lit("\n  "), "member", closing).alias("value"))
    lines.repartition("part").sortWithinPartitions("part", "at").drop("at").write.partitionBy("part").text(path)


@query("A10 K9", POINTS_SQL)
def curve_document_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Curve documents that span lines, each read in as many tasks as it has splits."""
    entries = _turn_points(spark, folder).groupBy("episode_id").agg(
        F.sort_array(F.collect_list(F.struct("frame_index", "value"))).alias("p")
    ).select("episode_id", F.col("p.frame_index").alias("frame_indices"), F.col("p.value").alias("values"))
    member = F.regexp_replace(F.to_json(F.struct("episode_id", "frame_indices", "values")), ",", ",\n    ")
    path = scratch_path(spark, "documents")
    _write_documents(entries.select(F.floor(F.col("episode_id") / 500).alias("part"), F.col("episode_id").alias("at"), member.alias("member")), path, "[]")
    return readers.read_curves(spark, path).withColumn("value", F.round("value", 6))


@query("A4", "SELECT item_id AS task_index, nullif(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '') AS task FROM benchmark")
def task_document_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Task texts, with commas and quotes in them, as objects that span lines."""
    rows = table(spark, folder, "benchmark").select("item_id", F.to_json(F.struct(F.col("text").alias("v"))).alias("v"))
    member = F.concat(F.lit('"'), F.col("item_id").cast("string"), F.lit('": '), F.regexp_extract("v", r'(?s)^\{"v":(.*)\}$', 1))
    path = scratch_path(spark, "documents")
    _write_documents(rows.select(F.floor(F.col("item_id") / 64).alias("part"), F.col("item_id").alias("at"), member.alias("member")), path, "{}")
    return readers.read_tasks(spark, path, "object")


@query("A10 B2 B3 D13", """
WITH kinds AS (SELECT DISTINCT conv_id, conv_id % 6 AS k FROM conversations)
SELECT CAST(conv_id AS VARCHAR) AS episode_id,
       CASE k WHEN 1 THEN 'frame index' WHEN 2 THEN 'duplicate frame' WHEN 3 THEN 'missing field' WHEN 4 THEN 'sizes differ' END AS problem
FROM kinds WHERE k BETWEEN 1 AND 4
UNION ALL SELECT CAST(conv_id AS VARCHAR), 'duplicate episode' FROM kinds WHERE k = 5""")
def curve_artifact_problems(spark: SparkSession, folder: str) -> DataFrame:
    """A damaged artifact: one kind of damage per residue of the episode."""
    kind = F.col("conv_id") % 6
    episodes = table(spark, folder, "conversations").select("conv_id").distinct()
    frames = (
        F.when(kind == 1, F.array(F.lit(0.0), F.lit(1.5))).when(kind == 2, F.array(F.lit(3.0), F.lit(3.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0)))
    )
    values = F.when(kind == 4, F.array(F.lit(0.1))).when(kind != 3, F.array(F.lit(0.1), F.lit(0.2)))
    rows = episodes.select(F.col("conv_id").alias("episode_id"), frames.alias("frame_indices"), values.alias("values"))
    path = scratch_path(spark, "curves")
    rows.unionByName(rows.where(F.col("episode_id") % 6 == 5)).write.json(path)
    return readers.curve_entry_problems(readers.read_curve_entries(spark, path, pretty=False))


@query("K9 H6", """
SELECT conv_id AS episode_id, count(*) AS count,
       round(avg((sqrt(length(text)) - ln(length(text) + 2)) ** 2), 6) AS value_mse,
       round(avg(abs(sqrt(length(text)) - ln(length(text) + 2))), 6) AS value_mae,
       round(sqrt(avg((sqrt(length(text)) - ln(length(text) + 2)) ** 2)), 6) AS value_rmse,
       round(CASE WHEN count(*) > 1 AND var_pop(sqrt(length(text))) > 0 THEN covar_pop(sqrt(length(text)), ln(length(text) + 2)) / sqrt(var_pop(sqrt(length(text))) * var_pop(ln(length(text) + 2))) END, 6) AS value_pearson
FROM conversations GROUP BY 1""")
def curve_metrics_file(spark: SparkSession, folder: str) -> DataFrame:
    target = scratch_path(spark, "curves")
    writers.write_curves(_turn_points(spark, folder), target)
    schema = "episode_id long, count long, value_mse double, value_mae double, value_rmse double, value_pearson double"
    rows = spark.read.schema(schema).json(f"{target}/episode_metrics.json")
    return rows.withColumns({n: F.round(n, 6) for n in ("value_mse", "value_mae", "value_rmse", "value_pearson")})


@query("K9 G1", POINTS_SQL.replace(" AS value FROM", ' AS value, round(ln(length(text) + 2), 6) AS "return" FROM'))
def curve_csv_file(spark: SparkSession, folder: str) -> DataFrame:
    target = scratch_path(spark, "curves")
    writers.write_curves(_turn_points(spark, folder), target)
    schema = "episode_id long, frame_index long, value double, `return` double"
    rows = spark.read.schema(schema).option("header", True).csv(f"{target}/episode_curves.csv")
    return rows.select("episode_id", "frame_index", F.round("value", 6).alias("value"), F.round("return", 6).alias("return"))


@query("A11 C12 J4 H8", """
WITH spans AS (SELECT conv_id AS episode_id, max(turn) AS last FROM conversations GROUP BY 1)
SELECT episode_id, concat('/clips/', episode_id, '.mp4') AS path,
       CASE WHEN episode_id % 3 = 0 THEN 5 ELSE 2 END::BIGINT AS first_source_frame,
       CASE WHEN episode_id % 3 = 0 THEN 40 ELSE last - 2 + 2 END AS frame_count, episode_id % 3 <> 0 AS frame_count_inferred,
       CASE WHEN episode_id % 3 = 0 THEN 30.0 ELSE 24.0 END::DOUBLE AS fps,
       CASE WHEN episode_id % 3 = 0 THEN 5 + 4 - 1 ELSE 2 + 3 - 1 END::BIGINT AS expected_first_curve_frame FROM spans""")
def video_map_sources(spark: SparkSession, folder: str) -> DataFrame:
    """A map in which every third entry is an object, the others are paths."""
    points = _turn_points(spark, folder)
    path = scratch_path(spark, "map")
    key = F.col("episode_id").cast("string")
    clip = F.concat(F.lit("/clips/"), key, F.lit(".mp4"))
    full = F.to_json(F.struct(clip.alias("path"), F.lit(5).alias("frame_offset"), F.lit(30.0).alias("fps"), F.lit(40).alias("frame_count"), F.lit(4).alias("history_size")))
    entry = F.when(F.col("episode_id") % 3 == 0, full).otherwise(F.to_json(F.struct(clip.alias("v"))))
    entry = F.when(F.col("episode_id") % 3 == 0, entry).otherwise(F.regexp_extract(entry, r'^\{"v":(.*)\}$', 1))
    pairs = points.select("episode_id").distinct().select(
        F.floor(F.col("episode_id") / 500).alias("page"), F.concat(F.lit('"'), key, F.lit('":'), entry).alias("pair")
    )
    pairs.groupBy("page").agg(
        F.concat(F.lit("{"), F.array_join(F.collect_list("pair"), ","), F.lit("}")).alias("value")
    ).select("value").write.text(path)
    video_map = readers.read_video_map(spark, path, pretty=False)
    integrity.require_none(readers.video_map_problems(video_map), "video map", ["episode_id"])
    probed = points.select("episode_id", F.lit(None).cast("long").alias("frame_count"), F.lit(24.0).alias("fps")).distinct()
    made = align.sources_from_map(points, video_map, offset=2, probed=probed, history=3)
    return made.select("episode_id", "path", "first_source_frame", "frame_count", "frame_count_inferred", "fps", "expected_first_curve_frame")


VIDEO_SHARDS_SQL = SHARDS_SQL.replace(str(CAP), str(CAP * 2))


@query("C12 A3 J3 B15", f"""
{VIDEO_SHARDS_SQL},
begins AS (SELECT shard, min("offset") AS begins FROM sharded GROUP BY 1)
SELECT episode_index AS episode_id, length AS frame_count, length - 1 AS last_source_frame,
       concat('videos/cam/chunk-', lpad(CAST(shard // 1000 AS VARCHAR), 3, '0'), '/file-', lpad(CAST(shard % 1000 AS VARCHAR), 3, '0'), '.mp4') AS path,
       {r6('("offset" - begins) / 25.0')} AS start_seconds
FROM sharded JOIN begins USING (shard)""")
def episode_table_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Video ranges of shared shards, checked against their lengths."""
    episodes = document_episodes(spark, folder).select("episode_index", "length", F.array("task").alias("tasks"))
    lengths = episodes.select("episode_index", "length")
    data, video = (stored(shards.episode_shards(lengths, cap), "shards") for cap in (CAP, CAP * 2))
    made = stored(shards.episode_table(episodes, data, video, 25.0, "cam"), "episodes")
    integrity.require_none(align.duration_problems(made, "cam", 25.0), "durations", ["episode_index"])
    rows = align.sources_from_episodes(made, "cam", 25.0, history=3)
    return rows.select("episode_id", "frame_count", "path", F.round("start_seconds", 6).alias("start_seconds"), "last_source_frame")


@query("K6 C10 J9 D17", f"""
WITH {EVENT_RETURNS}
SELECT episode_index, frame_index, event_id, round(CAST(CAST(ret AS FLOAT) AS DOUBLE), 5) + 0.0 AS "return",
       CAST(raw AS DOUBLE) AS return_raw, CASE WHEN success THEN 1 ELSE 0 END AS episode_success FROM returns""")
def augmented_dataset(spark: SparkSession, folder: str) -> DataFrame:
    """Returns added, written, verified against the source and read back."""
    written = _augment(spark, folder, scratch_path(spark, "augmented"))
    return written.select(
        "episode_index", "frame_index", "event_id", F.round(F.col("return").cast("double"), 5).alias("return"),
        F.col("return_raw").cast("double").alias("return_raw"), F.col("episode_success").cast("int").alias("episode_success"),
    )


def _augment(spark: SparkSession, folder: str, output: str, normalisation: str = "task_max") -> DataFrame:
    frames = event_table(spark, folder)
    tasks = frames.select("task_index").distinct().withColumn("task", F.concat(F.lit("task "), F.col("task_index").cast("string")))
    return returns_plan.add_returns(
        spark, frames, output, 25.0, tasks=tasks, success_key="next.success", reduction="last", normalisation=normalisation, max_frames=1000
    )


@query("C10 J8 J9", """
SELECT o_custkey AS episode_index, o_orderkey AS frame_index, o_orderkey % 997 <> 5 AS kept FROM orders
WHERE o_orderkey % 997 = 5 OR o_orderkey % 991 = 3""")
def changed_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Rows that a damaged copy of the orders lost or changed, told by block checksums and then row by row."""
    orders = table(spark, folder, "orders").select(
        F.col("o_custkey").alias("episode_index"), F.col("o_orderkey").alias("frame_index"), F.col("o_totalprice").cast("double").alias("price"),
        F.col("o_orderstatus").alias("status"),
    )
    copy = orders.where("frame_index % 997 <> 5").withColumn("price", F.col("price") + F.when(F.col("frame_index") % 991 == 3, 0.01).otherwise(0.0))
    told = compared_rows(orders, copy, "episode_index", "frame_index", ["price", "status"])
    changed = F.col("in_have").isNull() | (F.col("`want.price`") != F.col("`have.price`"))
    return told.where(changed).select("episode_index", "frame_index", F.col("in_have").isNotNull().alias("kept"))


@query("K6 K2 K3", f"""
WITH {EVENT_EPISODES}
SELECT episode_index, length, concat('task ', task_index) AS task, task_index,
       coalesce(sum(length) OVER (ORDER BY episode_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS dataset_from_index FROM episodes""")
def augmented_episodes(spark: SparkSession, folder: str) -> DataFrame:
    """Episode and task tables of an augmented dataset."""
    output = scratch_path(spark, "augmented")
    _augment(spark, folder, output)
    tasks = readers.read_tasks(spark, f"{output}/meta/tasks.parquet")
    episodes = readers.read_episodes(spark, output).withColumn("task", F.get("tasks", 0))
    return episodes.join(tasks, "task").select("episode_index", "length", "task", "task_index", "dataset_from_index")


@query("K6 K4 D23", """
SELECT feature, dtype, (SELECT count(DISTINCT user_id) FROM events) AS total_episodes, (SELECT count(*) FROM events) AS total_frames,
       (SELECT count(DISTINCT user_id % 5) FROM events) AS total_tasks, 25.0::DOUBLE AS fps
FROM (VALUES ('episode_index', 'int64'), ('frame_index', 'int64'), ('task_index', 'int64'), ('event_id', 'int64'), ('observed', 'float64'),
             ('next.success', 'int32'), ('return', 'float32'), ('return_raw', 'float32'), ('episode_success', 'int8')) t(feature, dtype)""")
def augmented_info(spark: SparkSession, folder: str) -> DataFrame:
    """The description of an augmented dataset names the new features."""
    output = scratch_path(spark, "augmented")
    _augment(spark, folder, output)
    info = readers.read_info(spark, output)
    listed = info.select("*", F.explode("features").alias("feature", "f"))
    return listed.select("feature", "f.dtype", "total_episodes", "total_frames", "total_tasks", "fps")


@query("K7 D4 D15", f"""
WITH {EVENT_RETURNS}
SELECT 'global_minmax' AS normalisation, CAST(min(raw) AS DOUBLE) AS global_min, CAST(max(raw) AS DOUBLE) AS global_max,
       count(DISTINCT episode_index) AS episodes, count(*) AS frames, max(length) AS longest_episode,
       count(DISTINCT CASE WHEN success THEN episode_index END) AS num_success_episodes,
       count(DISTINCT CASE WHEN NOT success THEN episode_index END) AS num_failure_episodes, 'next.success' AS success_source,
       'task_max_episode_length' AS failure_penalty, 'add returns' AS steps,
       (SELECT string_agg(t || ':' || l, ',' ORDER BY t) FROM (SELECT task_index AS t, max(lmax) AS l FROM returns GROUP BY 1)) AS longest FROM returns""")
def return_definition(spark: SparkSession, folder: str) -> DataFrame:
    output = scratch_path(spark, "augmented")
    _augment(spark, folder, output, "global_minmax")
    schema = (
        "definition struct<normalization string, global_min double, global_max double, failure_penalty string>, episodes long, frames long, "
        "longest_episode long, num_success_episodes long, num_failure_episodes long, success_source string, conversion_steps array<string>, "
        "task_max_episode_length map<string,long>"
    )
    longest = F.array_sort(F.transform(F.map_entries("task_max_episode_length"), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))))
    return spark.read.schema(schema).json(f"{output}/meta/return_definition.json").select(
        F.col("definition.normalization").alias("normalisation"), "definition.global_min", "definition.global_max", "episodes", "frames",
        "longest_episode", "num_success_episodes", "num_failure_episodes", "success_source", "definition.failure_penalty",
        F.array_join("conversion_steps", ",").alias("steps"), F.array_join(longest, ",").alias("longest"),
    )


@query("C10", f"""
WITH {EVENT_RETURNS}
SELECT episode_index, frame_index, CASE event_type WHEN 'error' THEN 'lost row' ELSE 'return' END AS problem FROM returns
WHERE event_type IN ('error', 'view')""")
def augmentation_differences(spark: SparkSession, folder: str) -> DataFrame:
    """A damaged copy: errors are lost, returns of views are shifted."""
    frames = event_table(spark, folder, "event_type")
    terms = stored(returns.episode_terms(frames, event_labels(frames)), "terms")
    made = returns.with_returns(frames, event_labels(frames), terms=terms)
    shifted = F.when(F.col("event_type") == "view", F.col("return") + 0.25).otherwise(F.col("return"))
    damaged = made.where(F.col("event_type") != "error").withColumn("return", shifted.cast("float"))
    return returns.verify_augmented(damaged, returns.returns_by_rank(frames, terms))


@query("K11 E14", """
SELECT CAST(day(ts) AS INTEGER) AS epoch, round(avg((sqrt(value) - 8) ** 2), 6) AS value_mse FROM events GROUP BY 1""")
def metrics_log(spark: SparkSession, folder: str) -> DataFrame:
    """Appends to one log, of which one is repeated."""
    path = scratch_path(spark, "log")
    rows = table(spark, folder, "events").groupBy(F.dayofmonth("ts").alias("epoch")).agg(
        F.avg(F.pow(F.sqrt("value") - 8, F.lit(2.0))).alias("value_mse")
    )
    writers.append_log(rows.where("epoch <= 15"), path)
    writers.append_log(rows.where("epoch > 15"), path)
    writers.append_log(rows.where("epoch = 20"), path)
    return spark.read.schema("epoch int, value_mse double").json(path).withColumn("value_mse", F.round("value_mse", 6))


@query("K12 K14 D12 H6 H10", f"""
WITH {EVENT_EPISODES},
steps AS (SELECT lead(observed, 2) OVER w AS a, lead(observed, 3) OVER w AS b
          FROM frames WINDOW w AS (PARTITION BY episode_index ORDER BY frame_index)),
errors AS (SELECT avg((sqrt(a) - sqrt(b)) ** 2) AS e FROM steps WHERE b IS NOT NULL)
SELECT 'all' AS split, (SELECT round(e, 6) FROM errors) AS next_state_mse, CAST(sum(greatest(0, length - 3)) AS BIGINT) AS num_windows, CAST(sum(greatest(0, length - 3)) AS BIGINT) AS value_count,
       CAST(sum(greatest(0, length - 3)) * 3 AS BIGINT) AS token_value_count, count(*) AS num_episodes, count(*) AS verified_episodes FROM episodes""")
def evaluation_artifacts(spark: SparkSession, folder: str) -> DataFrame:
    """Full evaluation written to files, summary and manifest read back."""
    target = scratch_path(spark, "evaluation")
    frames = event_table(spark, folder)
    with_target = stored(returns.with_returns(frames, event_labels(frames)), "returns")
    schema = SCORED.replace("next_state array<double>", "next_state array<array<double>>, next_state_target array<array<double>>")
    evaluation.evaluate(with_target, _scorer_with_states, schema, 3, ("observed",), 25.0, target, upcoming=("observed",))
    manifest = spark.read.json(f"{target}/alignment/manifest.json").where(F.col("created_at").isNotNull())
    one = lambda name: manifest.select(name).scalar()
    return spark.read.json(f"{target}/summary.json").select(
        "split", "num_windows", "value_count", "token_value_count", F.round("next_state_mse", 6).alias("next_state_mse"),
        one("num_episodes").alias("num_episodes"), one("verified_episodes").alias("verified_episodes"),
    )


def _scorer_with_states(batch: pd.DataFrame) -> pd.DataFrame:
    """The closed form, with the last root as next state of one dimension."""
    scored = closed_form_scorer(batch)
    roots = lambda rows: [[[x] for x in np.sqrt(row)] for row in rows]
    return scored.assign(next_state=roots(batch["observed"]), next_state_target=roots(batch["next_observed"]))


@query("K13", """
SELECT lang, count(*) AS kept, 3 AS refused FROM documents GROUP BY 1""")
def refused_overwrites(spark: SparkSession, folder: str) -> DataFrame:
    """One output per language: a second, a nested and a failing write leave it as it was."""
    base = scratch_path(spark, "outputs")
    documents = table(spark, folder, "documents").select("doc_id", "lang")
    languages = sorted(r.lang for r in documents.select("lang").distinct().collect())
    refused = []
    for lang in languages:
        rows, output = documents.where(F.col("lang") == lang), f"{base}/{lang}"

        def fail(root: str, rows: DataFrame = rows) -> None:
            rows.limit(1).write.parquet(root)
            raise integrity.IntegrityError("a check at the end")

        publish.published(spark, output, lambda root, rows=rows: rows.write.parquet(root))
        attempts = (
            lambda output=output, rows=rows: publish.published(spark, output, lambda root: rows.limit(1).write.parquet(root)),
            lambda output=output: publish.check_output(spark, output, f"{output}/inside"),
            lambda output=output, fail=fail: publish.published(spark, f"{output}-checked", fail),
        )
        count = 0
        for attempt in attempts:
            try:
                attempt()
            except (FileExistsError, ValueError):
                count += 1
        refused.append((lang, count if not publish.exists(spark, f"{output}-checked") else -1))
    kept = spark.read.parquet(*[f"{base}/{lang}" for lang in languages]).groupBy("lang").agg(F.count(F.lit(1)).alias("kept"))
    return kept.join(spark.createDataFrame(refused, "lang string, refused int"), "lang")


@query("A14 J8 J9 K1 K2 K3 K4 G4", f"""
WITH {CONVERSATION_LAYOUT_SQL}
SELECT count(*) AS episode_rows, CAST(sum(length) AS BIGINT) AS expected_frames, CAST(sum(length) AS BIGINT) AS frame_rows,
       CAST(1 AS BIGINT) AS task_rows, true AS consistent FROM placed""")
def flat_dataset_job(spark: SparkSession, folder: str) -> DataFrame:
    """Flat rows to a sharded dataset, with all its checks."""
    return _write_flat(spark, folder, scratch_path(spark, "flat"))


@query("K7 D15 D16", """
WITH sized AS (SELECT conv_id, count(*) AS length FROM conversations GROUP BY 1)
SELECT 'answer the user' AS task, count(*) AS episodes, CAST(sum(length) AS BIGINT) AS frames,
       count(*) FILTER (conv_id % 2 = 1) AS successful_episodes, max(length) AS longest_episode,
       CAST(min(CASE WHEN conv_id % 2 = 1 THEN 1 - length ELSE 1 - length - (SELECT max(length) FROM sized) END) AS DOUBLE) AS raw_low,
       CAST(max(CASE WHEN conv_id % 2 = 1 THEN 0 ELSE -(SELECT max(length) FROM sized) END) AS DOUBLE) AS raw_high,
       round(min(greatest(-1.0, (CASE WHEN conv_id % 2 = 1 THEN 1 - length ELSE 1 - length - (SELECT max(length) FROM sized) END)::DOUBLE / (SELECT max(length) FROM sized))), 5) AS low,
       round(max(CASE WHEN conv_id % 2 = 1 THEN 0.0 ELSE -1.0 END), 5)::DOUBLE AS high, 10.0::DOUBLE AS fps,
       count(*) FILTER (conv_id % 2 = 0) AS failed_episodes FROM sized""")
def conversion_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest that the same job leaves behind."""
    root = scratch_path(spark, "flat")
    _write_flat(spark, folder, root)
    return spark.read.json(f"{root}/meta/conversion_manifest.json").select(
        "task", "episodes", "frames", "successful_episodes", "longest_episode",
        F.col("raw_range.low").alias("raw_low"), F.col("raw_range.high").alias("raw_high"),
        F.round("normalised_range.low", 5).alias("low"), F.round("normalised_range.high", 5).alias("high"), "fps", "failed_episodes",
    )


def _write_flat(spark: SparkSession, folder: str, root: str) -> DataFrame:
    episodes = stored(_flat_layout(spark, folder), "layout")
    rows = _flat_rows(spark, folder, episodes).withColumn(
        "action", F.array(F.sqrt("n_chars").cast("float"), F.col("n_chars").cast("float"))
    )
    listed = episodes.select(
        "episode_index", "length", F.col("offset").alias("ep_offset"), (F.col("episode_index") % 2).alias("ep_success")
    )
    return flat_dataset.write_flat_dataset(
        spark, stored(rows, "rows"), listed, "answer the user", root, 10.0, "cam", 200, 400
    )


@query("J9", "SELECT event_id AS \"index\", value >= 50 AS found, value >= 50 AS dimension_ok, value BETWEEN 50 AND 200 AS return_ok FROM events WHERE event_type = 'signup'")
def spot_check_report(spark: SparkSession, folder: str) -> DataFrame:
    """Candidate rows of which small values are lost and large ones are wrong."""
    events = table(spark, folder, "events")
    expected = events.select(F.col("event_id").alias("index"), F.lit(64).alias("dimension"), F.col("value").alias("return"))
    wrong = F.when(F.col("return") > 200, F.col("return") + 1).otherwise(F.col("return"))
    written = expected.where(F.col("return") >= 50).withColumn("return", wrong)
    candidates = events.where(F.col("event_type") == "signup").select(F.col("event_id").alias("index"))
    return layout.spot_check(candidates, written, expected)


@query("C3 D5 E3 D27", f"""
WITH {EVENT_EPISODES}, {split_sql('frames', 0.1, 42)}
SELECT split, CAST(sum(greatest(0, length - 3)) AS BIGINT) AS windows FROM episodes JOIN split USING (episode_index) GROUP BY 1""")
def training_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Windows of both sides, normalised on the training side."""
    frames = event_table(spark, folder).withColumn(
        "action", F.array(F.sqrt("observed").cast("float"), F.ln(F.col("observed") + 1).cast("float"))
    )
    made = training.prepare_training(frames, 3, 0.1, 42, batch=64)
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("windows")).select(F.lit(name).alias("split"), "windows")
    return count(made.train, "train").unionByName(count(made.validation, "val"))


# Migration statistics, layouts and versions ------------------------------


@query("L2 D18 D19 A5", """
SELECT conv_id AS episode_index, 'n_chars' AS feature, 0 AS position, min(length(text))::DOUBLE AS min, max(length(text))::DOUBLE AS max,
       round(avg(length(text)) + 1e-8, 6) AS mean, round(stddev_pop(length(text)) + 1e-8, 6) AS std, count(*) AS count FROM conversations GROUP BY 1""")
def episode_statistics_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Second migration step, through its nested file."""
    frames = conversation_frames(spark, folder).select("episode_index", "frame_index", "n_chars")
    parts = migrations.to_episode_statistics(frames, statistics.feature_statistics(frames, ["n_chars"]))
    root = scratch_path(spark, "stats")
    writers.write_episode_statistics_lines(statistics.as_episode_lines(parts), root)
    flat = statistics.from_episode_lines(readers.read_episode_statistics_lines(spark, root))
    return flat.select("episode_index", "feature", "position", "min", "max", F.round(F.col("mean") + 1e-8, 6).alias("mean"), F.round(F.col("std") + 1e-8, 6).alias("std"), "count")


KINDS = 9


def _listing(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """One dataset root per document, of nine kinds, and their info files."""
    kind = F.col("doc_id") % KINDS
    paths = (
        F.when(kind == 0, F.array(F.lit("meta/episodes/chunk-000/file-000.parquet"), F.lit("meta/tasks.parquet")))
        .when(kind == 1, F.array(F.lit("meta/episodes.jsonl"), F.lit("meta/tasks.jsonl"), F.lit("meta/episodes_stats.jsonl")))
        .when(kind == 2, F.array(F.lit("meta/episodes.jsonl"), F.lit("meta/tasks.jsonl"), F.lit("meta/info.json")))
        .when(kind == 3, F.array(F.lit("meta_data/info.json"), F.lit("data/train-0.parquet")))
        .when(kind == 4, F.array(F.lit("meta/info.json"), F.lit("readme.md")))
        .when(kind == 5, F.array(F.lit("meta/info.json")))
        .when(kind == 6, F.array(F.lit("meta_data/other.bin")))
        .when(kind == 7, F.array(F.lit("train/part-0.arrow")))
        .otherwise(F.array(F.lit("notes.txt")))
    )
    root = F.concat(F.lit("root-"), F.col("doc_id").cast("string")).alias("root")
    documents = table(spark, folder, "documents")
    files = documents.select(root, F.explode(paths).alias("path"))
    declared = documents.where(kind.isin(2, 4, 5)).select(
        root,
        F.lit("meta/info.json").alias("path"),
        F.when(kind == 2, "v3.0").when(kind == 4, "2.1.0").otherwise("v9").alias("codebase_version"),
    )
    return files, declared


CLASSIFIED_SQL = f"""
kinds AS (SELECT doc_id, doc_id % {KINDS} AS k FROM documents),
classified AS (
  SELECT concat('root-', doc_id) AS root, CASE k WHEN 0 THEN 2 WHEN 1 THEN 3 WHEN 2 THEN 3 WHEN 3 THEN 2 WHEN 4 THEN 2 ELSE 1 END::BIGINT AS files,
         CASE k WHEN 0 THEN 'v3.0' WHEN 1 THEN 'v2.1' WHEN 2 THEN 'v2.0' WHEN 3 THEN 'v1.6' WHEN 4 THEN 'v2.1' WHEN 6 THEN 'v1.6' WHEN 7 THEN 'v1.6' END AS version,
         CASE k WHEN 4 THEN 'declared' WHEN 5 THEN 'unsupported version' WHEN 8 THEN 'unknown layout' ELSE 'files' END AS basis FROM kinds)"""


@query("J6", f"WITH {CLASSIFIED_SQL} SELECT * FROM classified")
def layout_classification(spark: SparkSession, folder: str) -> DataFrame:
    return layout.classify_roots(*_listing(spark, folder))


@query("J7 H4", f"""
WITH {CLASSIFIED_SQL}, hops AS (SELECT * FROM (VALUES ('v1.6', 'v2.0'), ('v2.0', 'v2.1'), ('v2.1', 'v3.0')) h(from_version, to_version))
SELECT root, CAST(row_number() OVER (PARTITION BY root ORDER BY from_version) - 1 AS INTEGER) AS step, from_version, to_version
FROM classified JOIN hops ON from_version >= version""")
def migration_plan(spark: SparkSession, folder: str) -> DataFrame:
    return layout.migration_plan(layout.classify_roots(*_listing(spark, folder)))


@query("H2", """
SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN 'v1.6' WHEN 1 THEN 'v2.0' WHEN 2 THEN 'v2.1' WHEN 3 THEN 'v3.0' WHEN 4 THEN 'v1.6' END AS version FROM documents""")
def normalised_versions(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.col("doc_id") % 8
    text = (
        F.when(kind == 0, " V1 ").when(kind == 1, "2").when(kind == 2, "v2.1.0").when(kind == 3, "3.0")
        .when(kind == 4, "1.06").when(kind == 5, "v2.2").when(kind == 6, "latest").otherwise("4")
    )
    return table(spark, folder, "documents").select("doc_id", normalise_version(text).alias("version"))


@query("H4", """
WITH hops AS (SELECT * FROM (VALUES ('v1.6', 'v2.0', 0), ('v2.0', 'v2.1', 1), ('v2.1', 'v3.0', 2)) h(from_version, to_version, n)),
asked AS (SELECT doc_id, ['v1.6', 'v2.0', 'v2.1', 'v3.0'][doc_id % 4 + 1] AS version FROM documents)
SELECT doc_id, version, string_agg(from_version || '>' || to_version, ' ' ORDER BY n) AS chain FROM asked LEFT JOIN hops ON from_version >= version GROUP BY 1, 2""")
def version_chains(spark: SparkSession, folder: str) -> DataFrame:
    versions = F.array(*[F.lit(v) for v in ("v1.6", "v2.0", "v2.1", "v3.0")])
    rows = table(spark, folder, "documents").select("doc_id", F.element_at(versions, (F.col("doc_id") % 4 + 1).cast("int")).alias("version"))
    hops = F.transform(migration_chain(F.col("version")), lambda h: F.concat(h["from_version"], F.lit(">"), h["to_version"]))
    return rows.select("doc_id", "version", F.when(F.size(hops) > 0, F.array_join(hops, " ")).alias("chain"))


# Tasks and row-level functions -------------------------------------------


@query("C2", """
WITH first AS (SELECT source AS task, min(doc_id) AS f FROM documents GROUP BY 1),
ids AS (SELECT task, row_number() OVER (ORDER BY f) - 1 AS task_index FROM first)
SELECT doc_id, doc_id % 25 AS task_index, task FROM documents LEFT JOIN ids ON task_index = doc_id % 25""")
def frames_with_task_text(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").select("doc_id", (F.col("doc_id") % 25).alias("task_index"))
    return tasks.with_task_text(rows, _source_tasks(spark, folder)).select("doc_id", "task_index", "task")


@query("C2 C4", """
WITH used AS (SELECT DISTINCT doc_id % 25 AS task_index FROM documents), n AS (SELECT count(DISTINCT source) AS n FROM documents)
SELECT task_index, CASE WHEN task_index >= n THEN 'absent' WHEN task_index = 2 THEN 'listed twice' ELSE 'no text' END AS problem
FROM used, n WHERE task_index >= n OR task_index IN (2, 4)""")
def task_problems(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").select((F.col("doc_id") % 25).alias("task_index"))
    known = _source_tasks(spark, folder).withColumn("task", F.when(F.col("task_index") == 4, " \t ").otherwise(F.col("task")))
    return tasks.task_problems(rows, known.unionByName(known.where(F.col("task_index") == 2)))


@query("B22 C11", """
SELECT doc_id AS episode_index, CASE doc_id % 4 WHEN 0 THEN source WHEN 1 THEN source END AS task FROM documents""")
def task_mapping(spark: SparkSession, folder: str) -> DataFrame:
    """Instructions as text, one-element list, two-element list and blank."""
    kind = F.col("doc_id") % 4
    value = (
        F.when(kind == 0, F.col("source")).when(kind == 1, F.to_json(F.array("source")))
        .when(kind == 2, F.to_json(F.array("source", "lang"))).otherwise("  ")
    )
    pairs = table(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("key"), value.alias("value"))
    return tasks.single_task(tasks.task_lists(pairs))


@query("C11 B22 L1", "SELECT conv_id AS episode_index, turn AS frame_index, concat('talk ', conv_id % 3) AS task FROM conversations")
def frames_with_episode_task(spark: SparkSession, folder: str) -> DataFrame:
    frames = conversation_frames(spark, folder).select("episode_index", "frame_index")
    pairs = integrity.distinct_episodes(frames).select(
        F.col("episode_index").cast("string").alias("key"),
        F.concat(F.lit("talk "), (F.col("episode_index") % 3).cast("string")).alias("value"),
    )
    return migrations.with_episode_tasks(frames, pairs)


@query("B5 H1", """
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE trim(source) END AS task FROM documents""")
def clean_task_text(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.col("doc_id") % 3
    padded = F.when(kind == 0, F.lit("\n\t ")).otherwise(F.concat(F.lit(" \t"), "source", F.lit("\n ")))
    rows = table(spark, folder, "documents").select("doc_id", F.array(F.encode(padded, "UTF-8")).alias("task"))
    return rows.select("doc_id", S.clean_task(rows, "task").alias("task"))


@query("B4 B18 H5", """
SELECT event_id, CASE WHEN event_type <> 'error' THEN round(CAST(CAST(value AS FLOAT) AS DOUBLE), 2) END AS "return" FROM events""")
def scalar_cells(spark: SparkSession, folder: str) -> DataFrame:
    """One-element arrays are unwrapped; longer ones are refused."""
    cell = F.when(F.col("event_type") != "error", F.array("value")).otherwise(F.array("value", "value"))
    rows = table(spark, folder, "events").select("event_id", cell.alias("return"))
    return rows.select("event_id", F.round(S.canonical_return(rows, "return").cast("double"), 2).alias("return"))


@query("H6", """
SELECT event_id, CASE WHEN event_type NOT IN ('error', 'view') THEN round(value, 2) END AS x,
       CASE WHEN event_type NOT IN ('error', 'view') THEN round(value, 2) END AS nested FROM events""")
def json_safe_numbers(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.col("event_type")
    x = F.when(kind == "error", F.lit(float("nan"))).when(kind == "view", F.lit(float("-inf"))).otherwise(F.col("value"))
    rows = table(spark, folder, "events").select("event_id", x.alias("x"), F.array(F.struct(x.alias("y"))).alias("nested"))
    return S.json_safe(rows).select("event_id", F.round("x", 2).alias("x"), F.round(F.col("nested")[0]["y"], 2).alias("nested"))


@query("B16 H7", "SELECT conv_id, turn, concat(conv_id, ':', turn) AS sample_id FROM conversations")
def sample_ids(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "conversations").select("conv_id", "turn", S.sample_id(F.col("conv_id"), F.col("turn")).alias("sample_id"))

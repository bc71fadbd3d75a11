"""Writing datasets and artifacts.

Nothing is ever overwritten: every write fails when its target exists, and
Spark's commit protocol publishes a table only when all its tasks are done.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from epistride.columns import COLUMNS, Columns, named
from epistride.functions.scalars import chunk_of, file_of, json_safe
from epistride.functions.versions import NEWEST
from epistride.operators.curves import assemble_curves
from epistride.operators.integrity import frame_spans
from epistride.operators.metrics import curve_metrics
from epistride.operators.scans import BLOCK_ROWS, join_episodes, position_block
from epistride.sources import episode_files, publish

ROW_GROUP_ROWS = 65_536
DATA_FRAMES = 250_000


def write_document(one_row: DataFrame, path: str) -> None:
    """A small result as one JSON object; non-finite numbers become null."""
    json_safe(one_row).repartition(1).write.mode("errorifexists").option("ignoreNullFields", False).json(path)


def append_log(rows: DataFrame, path: str, keys: Sequence[str] = ("epoch",)) -> None:
    """Add rows to a log of JSON objects, one directory for each of the ``keys``' values.

    What is appended again, for instance by a retry, takes the place of what
    stood under the same keys; other keys' entries stay as they are.
    """
    dealt = json_safe(rows).repartition(1, *[named(k) for k in keys])
    (
        dealt.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("ignoreNullFields", False)
        .partitionBy(*keys)
        .json(path)
    )


def _in_shards(frames: DataFrame, sharded: DataFrame, max_frames: int, c: Columns) -> DataFrame:
    """The frames with chunk, file and piece, dealt so that a piece of a shard lies in one task.

    The number of tasks is fixed, as in ``write_episode_files``.
    """
    tasks = int(frames.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    begins = sharded.groupBy("shard").agg(F.min("offset").alias("__begin"))
    address = sharded.join(begins, "shard").select(
        named(c.episode), "shard", (F.col("offset") - F.col("__begin")).alias("before")
    )
    address = frame_spans(frames, c).join(address, c.episode)
    placed = join_episodes(frames, address, c.episode, c.frame).select(
        *[named(n) for n in frames.columns],
        chunk_of(F.col("__shard")).alias("chunk"),
        file_of(F.col("__shard")).alias("file"),
        F.floor((F.col("__before") + named(c.frame) - F.col("__first_frame")) / F.lit(max_frames)).alias("piece"),
    )
    return placed.repartition(tasks, "chunk", "file", "piece").sortWithinPartitions("chunk", "file", "piece", *[named(k) for k in c.key])


def _write_parquet(rows: DataFrame, path: str, by: Sequence[str], max_frames: int, compression: str) -> None:
    (
        rows.write.mode("errorifexists")
        .option("compression", compression)
        .option("parquet.block.row.count.limit", ROW_GROUP_ROWS)
        .option("maxRecordsPerFile", max_frames)
        .partitionBy(*by)
        .parquet(path)
    )


def write_frames(
    frames: DataFrame,
    sharded: DataFrame,
    root: str,
    max_frames: int = DATA_FRAMES,
    compression: str = "snappy",
    c: Columns = COLUMNS,
) -> None:
    """Episode-aligned data shards under ``root/data/chunk=/file=``.

    ``sharded`` comes from ``episode_shards``.  A shard is one directory, named
    by the chunk and file numbers of the episode table; its files hold at most
    ``max_frames`` rows, so no task writes more than that.
    """
    placed = _in_shards(frames, sharded, max_frames, c).drop("piece")
    _write_parquet(placed, f"{root}/data", ["chunk", "file"], max_frames, compression)


# Fixed value: the template of data files that other tools of this format write and expect.
FILE_PATH = "data/chunk-{chunk_index:03d}/file-{file_index:03d}.parquet"


def write_frame_files(
    frames: DataFrame,
    sharded: DataFrame,
    root: str,
    max_frames: int = DATA_FRAMES,
    compression: str = "snappy",
    c: Columns = COLUMNS,
) -> None:
    """The same with one file a shard, ``root/data/chunk-000/file-000.parquet``.

    Only a shard of one episode longer than ``max_frames`` goes on in files
    that sort after its first, ``file-000.part-001.parquet``, so that no task
    writes more than that.  Spark names its files itself, so they are written
    beside ``data`` and renamed at the end.
    """
    placed = _in_shards(frames, sharded, max_frames, c)
    _write_parquet(placed, f"{root}/data-parts", ["chunk", "file", "piece"], max_frames, compression)

    def name(keys: dict[str, int], place: int) -> str:
        if place:
            raise ValueError("a piece of a shard has more than one file")
        path = FILE_PATH.format(chunk_index=keys["chunk"], file_index=keys["file"])
        return path if not keys["piece"] else path.replace(".parquet", f".part-{keys['piece']:03d}.parquet")

    publish.named_parts(frames.sparkSession, f"{root}/data-parts", name)


def write_episodes(episodes: DataFrame, root: str) -> None:
    episodes.write.mode("errorifexists").parquet(f"{root}/meta/episodes")


def write_tasks(tasks: DataFrame, root: str) -> None:
    tasks.select(F.col("task_index").cast("long"), "task").write.mode("errorifexists").parquet(f"{root}/meta/tasks.parquet")


def write_task_lines(tasks: DataFrame, root: str) -> None:
    tasks.select("task_index", "task").write.mode("errorifexists").json(f"{root}/meta/tasks.jsonl")


def write_episode_lines(episodes: DataFrame, root: str) -> None:
    episodes.select("episode_index", "tasks", "length").write.mode("errorifexists").json(f"{root}/meta/episodes.jsonl")


def write_episode_statistics_lines(lines: DataFrame, root: str) -> None:
    lines.write.mode("errorifexists").json(f"{root}/meta/episodes_stats.jsonl")


def write_statistics(stats: DataFrame, root: str) -> None:
    """Statistics of the whole dataset, one object per dimension."""
    json_safe(stats).repartition(1).write.mode("errorifexists").option("ignoreNullFields", False).json(f"{root}/meta/stats.json")


def dataset_info(
    episodes: DataFrame,
    tasks: DataFrame,
    features: DataFrame,
    fps: float,
    version: str = NEWEST,
    videos: int = 0,
    chunk_size: int = 1000,
    data_path: str = "data/chunk={chunk_index}/file={file_index}",
    video_path: str | None = None,
) -> DataFrame:
    """The one-row description; ``features`` is the map from ``feature_map``."""
    counts = episodes.agg(
        F.count(F.lit(1)).alias("total_episodes"), F.sum("length").cast("long").alias("total_frames")
    )
    task_count = tasks.agg(F.count(F.lit(1)).alias("n"))
    return counts.select(
        F.lit(version).alias("codebase_version"),
        F.lit("unknown").alias("robot_type"),
        "total_episodes",
        "total_frames",
        task_count.scalar().alias("total_tasks"),
        (F.col("total_episodes") * videos).alias("total_videos"),
        F.ceil(F.col("total_episodes") / chunk_size).alias("total_chunks"),
        F.lit(chunk_size).cast("long").alias("chunks_size"),
        F.lit(float(fps)).alias("fps"),
        F.create_map(F.lit("train"), F.concat(F.lit("0:"), F.col("total_episodes").cast("string"))).alias("splits"),
        F.lit(data_path).alias("data_path"),
        F.lit(video_path).cast("string").alias("video_path"),
        features.scalar().alias("features"),
    )


def write_info(info: DataFrame, root: str) -> None:
    info.coalesce(1).write.mode("errorifexists").json(f"{root}/meta/info.json")


def write_episode_files(frames: DataFrame, root: str, chunk_size: int = 1000, block_rows: int = 1_000_000, c: Columns = COLUMNS) -> None:
    """One directory per episode, long episodes in several files.

    The number of tasks is fixed: many small files cost more than their bytes
    say, so the writers must not be merged by size.  On a mounted file system
    the tasks write the files themselves, see ``episode_files``; ``data`` then
    gets its name when all are there.
    """
    spark = frames.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chunked = frames.withColumns(
        {
            "episode_chunk": chunk_of(named(c.episode), chunk_size),
            "__piece": position_block(named(c.frame), block_rows),
        }
    )
    placed = chunked.repartition(tasks, "episode_chunk", named(c.episode), "__piece").sortWithinPartitions(
        "episode_chunk", *[named(k) for k in c.key]
    )
    path, whole = episode_files.mounted(spark, f"{root}/data"), isinstance(frames.schema[c.episode].dataType, T.IntegralType)
    kept = [n for n in frames.columns if n not in ("episode_chunk", c.episode)]
    if path is None or not whole or not episode_files.plain(T.StructType([frames.schema[n] for n in kept])):
        placed.drop("__piece").write.mode("errorifexists").partitionBy("episode_chunk", c.episode).parquet(f"{root}/data")
        return
    value = lambda name: F.coalesce(named(name).cast("string"), F.lit(episode_files.NO_VALUE))
    part = F.when(F.col("__piece").isNull(), "part-none").otherwise(F.format_string("part-%05d", F.col("__piece")))
    file = F.concat(F.lit("episode_chunk="), value("episode_chunk"), F.lit(f"/{c.episode}="), value(c.episode), F.lit("/"), part, F.lit(".parquet"))
    named_rows = placed.select(*[named(n) for n in kept], file.alias("__file"))
    publish.published(spark, f"{root}/data", lambda staged: episode_files.write_files(named_rows, staged))


def return_definition(
    terms: DataFrame,
    task_lengths: DataFrame,
    normalisation: str,
    failure_penalty: float | None,
    step_scale: float,
    limits: DataFrame,
    success_source: str,
    reduction: str,
    source: str | None = None,
    source_version: str | None = None,
    steps: Sequence[str] = (),
) -> DataFrame:
    """One row describing how the returns were made.

    ``terms`` is ``returns.episode_terms``, ``limits`` its ``raw_range``,
    ``task_lengths`` one row (task, longest episode) per task.  The field
    names are those of the file format.
    """
    fitted = limits if normalisation == "global_minmax" else limits.where(F.lit(False))
    ends = fitted.select(F.struct(*[F.col(n).cast("double").alias(n) for n in ("low", "high")])).scalar()
    penalty = F.lit("task_max_episode_length" if failure_penalty is None else str(float(failure_penalty)))
    entries = F.collect_list(F.struct(F.col("task_index").cast("string").alias("k"), F.col("task_max_length").alias("v")))
    lengths = task_lengths.select(F.col(task_lengths.columns[0]).alias("task_index"), "task_max_length").agg(
        F.map_from_entries(F.sort_array(entries)).alias("m")
    )
    return terms.agg(
        F.count(F.lit(1)).alias("episodes"),
        F.sum("length").cast("long").alias("frames"),
        F.count_if("success").alias("num_success_episodes"),
        F.count_if(~F.col("success")).alias("num_failure_episodes"),
        F.max("length").alias("longest_episode"),
    ).select(
        F.lit(2).alias("schema_version"),
        F.struct(F.lit(source).cast("string").alias("root"), F.lit(source_version).cast("string").alias("detected_version")).alias("source"),
        F.lit(NEWEST).alias("canonical_training_format"),
        F.array(*[F.lit(s) for s in steps]).cast("array<string>").alias("conversion_steps"),
        F.struct(
            F.lit(-float(step_scale)).alias("nonterminal_reward"),
            F.lit(0.0).alias("success_terminal_reward"),
            F.lit("-failure_penalty").alias("failure_terminal_reward"),
            penalty.alias("failure_penalty"),
            F.lit(1.0).alias("discount"),
            F.lit(normalisation).alias("normalization"),
            F.lit(float(step_scale)).alias("step_scale"),
            ends.getField("low").alias("global_min"),
            ends.getField("high").alias("global_max"),
        ).alias("definition"),
        F.lit(success_source).alias("success_source"),
        F.lit(reduction).alias("success_reduction"),
        lengths.scalar().alias("task_max_episode_length"),
        "episodes",
        "frames",
        "longest_episode",
        "num_success_episodes",
        "num_failure_episodes",
    )


def migration_manifest(spark: SparkSession, source: str | None, source_version: str | None, steps: Sequence[str]) -> DataFrame:
    """One row: where a dataset came from and which steps it went through."""
    schema = (
        "schema_version int, source_version string, target_version string, source_root string, source_was_modified boolean, steps array<string>"
    )
    return spark.createDataFrame([(1, source_version, NEWEST, source, False, list(steps))], schema)


def conversion_manifest(
    episodes: DataFrame, ranges: DataFrame, data_shards: DataFrame, task: str, fps: float, normalisation: str
) -> DataFrame:
    """One row describing a conversion: counts, return ranges and the writer.

    ``episodes`` has length and success, ``ranges`` is ``returns.value_ranges``.
    """
    # All four ends in one scalar, so the frames are scanned once.
    ends = ranges.select(F.struct(*[F.col(n).cast("double").alias(n) for n in ranges.columns])).scalar()
    pair = lambda low, high: F.struct(ends.getField(low).alias("low"), ends.getField(high).alias("high"))
    count = data_shards.agg(F.countDistinct("shard").alias("n"))
    return episodes.agg(
        F.count(F.lit(1)).alias("episodes"),
        F.sum("length").cast("long").alias("frames"),
        F.count_if("success").alias("successful_episodes"),
        F.count_if(~F.col("success")).alias("failed_episodes"),
        F.max("length").alias("longest_episode"),
    ).select(
        F.lit(1).alias("schema_version"),
        F.lit(task).alias("task"),
        "*",
        F.lit(normalisation).alias("normalisation"),
        pair("raw_min", "raw_max").alias("raw_range"),
        pair("normalised_min", "normalised_max").alias("normalised_range"),
        F.lit(float(fps)).alias("fps"),
        count.scalar().alias("data_shards"),
    )


def split_pages(split: DataFrame, seed: int, fraction: float, page_ids: int = BLOCK_ROWS) -> DataFrame:
    """The split manifest: one row per page, a range of ``page_ids`` episode ids.

    The form is the same at every size; pages carry their number.
    """
    page = position_block(F.col("episode_index"), page_ids)
    side = lambda name: F.sort_array(
        F.collect_list(F.when(F.col("split") == name, F.col("episode_index")))
    ).alias(name)
    return split.groupBy(page.alias("page")).agg(side("train"), side("val")).select(
        F.lit(1).alias("schema_version"),
        F.lit(seed).cast("long").alias("seed"),
        F.lit(float(fraction)).alias("val_fraction"),
        "page",
        "train",
        "val",
    )


def write_split(split: DataFrame, path: str, seed: int, fraction: float, page_ids: int = BLOCK_ROWS) -> None:
    split_pages(split, seed, fraction, page_ids).write.mode("errorifexists").json(path)


def write_labels(labels: DataFrame, path: str, page_ids: int = BLOCK_ROWS) -> None:
    """Success labels as JSON files, each one object of episode -> flag.

    A file holds one page, a range of ``page_ids`` episode ids.
    """
    entry = F.struct(F.col("episode_index").cast("string").alias("key"), F.col("success").alias("value"))
    pages = labels.groupBy(position_block(F.col("episode_index"), page_ids).alias("page")).agg(
        F.to_json(F.map_from_entries(F.sort_array(F.collect_list(entry)))).alias("value")
    )
    pages.select("value").write.mode("errorifexists").option("maxRecordsPerFile", 1).text(path)


def write_curves(points: DataFrame, folder: str, page_frames: int = BLOCK_ROWS) -> None:
    """Curves, per-episode metrics and a flat table of all points."""
    json_safe(assemble_curves(points, page_frames=page_frames)).write.mode("errorifexists").json(f"{folder}/episode_curves.json")
    json_safe(curve_metrics(points)).write.mode("errorifexists").option("ignoreNullFields", False).json(f"{folder}/episode_metrics.json")
    (
        points.select("episode_id", "frame_index", "value", "return")
        .repartitionByRange("episode_id", "frame_index")
        .sortWithinPartitions("episode_id", "frame_index")
        .write.mode("errorifexists")
        .option("header", True)
        .csv(f"{folder}/episode_curves.csv")
    )


def evaluation_summary(metrics: DataFrame, total: DataFrame, split: str) -> DataFrame:
    """One row: split, number of windows and the metrics.  ``total`` is the
    one-row count from ``windows.total_windows``."""
    return json_safe(
        metrics.select(F.lit(split).alias("split"), total.scalar().alias("num_windows"), *[named(n) for n in metrics.columns])
    )


def stamped(manifest: DataFrame) -> DataFrame:
    """Add the UTC creation time."""
    text = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return manifest.withColumn("created_at", text)


def write_alignment(report: DataFrame, folder: str, extra: Sequence[Column] = ()) -> None:
    """Per-episode records and a one-row manifest."""
    json_safe(report).write.mode("errorifexists").option("ignoreNullFields", False).json(f"{folder}/alignment.json")
    counts = report.agg(
        F.lit(1).alias("schema_version"),
        F.count(F.lit(1)).alias("num_episodes"),
        F.count_if("mapping_verified").alias("verified_episodes"),
    ).select("*", *extra)
    write_document(stamped(counts), f"{folder}/manifest.json")

"""Classifying dataset directories by their files."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epistride.functions.versions import NEWEST, migration_chain, normalise_version


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path) of every file below ``folder``, listed without reading contents."""
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path")
    )


def relative_paths(files: DataFrame, parent: str) -> DataFrame:
    """(root, path): the first directory below ``parent`` and the rest."""
    rest = F.regexp_replace("path", r"^.*?" + parent.strip("/").replace("/", r"\/") + r"\/", "")
    return files.select(
        F.substring_index(rest, "/", 1).alias("root"),
        F.regexp_replace(rest, r"^[^/]*/", "").alias("path"),
    )


# Files that mark a dataset directory.
ROOT_MARKERS = ("meta/info.json", "meta/episodes.jsonl", "meta/tasks.parquet", "meta_data/")


def resolve_roots(files: DataFrame, nested: str) -> DataFrame:
    """Descend into ``nested`` where that directory is the dataset.

    A root may be the dataset itself or a parent that holds it under
    ``nested``; the nested one wins when it carries a marker.
    """
    prefix = nested.strip("/") + "/"
    inner = F.when(F.col("path").startswith(prefix), F.substr(F.col("path"), F.lit(len(prefix) + 1)))
    marked = reduce(or_, [F.coalesce(inner.startswith(m), F.lit(False)) for m in ROOT_MARKERS])
    descend = files.groupBy("root").agg(F.bool_or(marked).alias("descend"))
    return (
        files.join(descend, "root")
        .select("root", F.when(F.col("descend"), inner).otherwise(F.col("path")).alias("path"))
        .where(F.col("path").isNotNull())
    )


def classify_roots(files: DataFrame, declared: DataFrame | None = None) -> DataFrame:
    """Schema generation of every root from its file listing.

    ``files`` is (root, path); ``declared`` is (root, path, codebase_version)
    read from the info files.  File markers beat a declared version.
    """
    path = F.col("path")
    has = {
        "episode_parts": path.like("meta/episodes/%"),
        "task_table": (path == "meta/tasks.parquet") | path.like("meta/tasks/%") | path.like("meta/tasks.parquet/%"),
        "episode_lines": path == "meta/episodes.jsonl",
        "task_lines": path == "meta/tasks.jsonl",
        "episode_stats": path == "meta/episodes_stats.jsonl",
        "old_info": path == "meta_data/info.json",
        "old_content": (path == "meta_data/stats.safetensors") | path.like("data/%") | path.startswith("videos"),
        "old_meta": path.like("meta_data/%"),
        "train": path.like("train/%") | (path == "train"),
        "meta": path.like("meta/%"),
    }
    marks = files.groupBy("root").agg(
        F.count(F.lit(1)).alias("files"), *[F.bool_or(test).alias(name) for name, test in has.items()]
    )
    if declared is None:
        marks = marks.withColumns({"stated": F.lit(None).cast("string"), "unsupported": F.lit(False)})
    else:
        # The first info file that states a version decides, even a bad one.
        order = F.when(F.col("codebase_version").isNotNull(), F.when(F.col("path") == "meta/info.json", 0).otherwise(1))
        said = declared.groupBy("root").agg(F.min_by("codebase_version", order).alias("stated_text")).select(
            "root",
            normalise_version(F.col("stated_text")).alias("stated"),
            (F.col("stated_text").isNotNull() & normalise_version(F.col("stated_text")).isNull()).alias("unsupported"),
        )
        marks = marks.join(said, "root", "left").withColumn("unsupported", F.coalesce("unsupported", F.lit(False)))
    on = F.col
    by_files = (
        F.when(on("episode_parts") & on("task_table"), "v3.0")
        .when(on("episode_lines") & on("task_lines") & on("episode_stats"), "v2.1")
        .when(on("episode_lines") & on("task_lines"), "v2.0")
        .when(on("old_info") & on("old_content"), "v1.6")
    )
    by_rest = F.when(on("old_meta") | (on("train") & ~on("meta")), "v1.6")
    version = F.coalesce(by_files, F.when(~on("unsupported"), F.coalesce(on("stated"), by_rest)))
    return marks.select(
        "root",
        "files",
        version.alias("version"),
        F.when(by_files.isNotNull(), "files")
        .when(on("unsupported"), "unsupported version")
        .when(on("stated").isNotNull(), "declared")
        .when(by_rest.isNotNull(), "files")
        .otherwise("unknown layout")
        .alias("basis"),
    )


def migration_plan(classified: DataFrame) -> DataFrame:
    """Steps that bring each root to the newest generation, in order."""
    steps = F.posexplode(migration_chain(F.col("version"))).alias("step", "hop")
    return classified.where(F.col("version") != NEWEST).select("root", steps).select(
        "root", "step", "hop.from_version", "hop.to_version"
    )


def structure_check(frames: DataFrame, episodes: DataFrame, tasks: DataFrame) -> DataFrame:
    """One row: do the written tables agree on rows, episodes and tasks?"""
    counted = lambda df: df.agg(F.count(F.lit(1)).alias("n")).scalar()
    return episodes.agg(
        F.count(F.lit(1)).alias("episode_rows"), F.sum("length").alias("expected_frames")
    ).withColumns({"frame_rows": counted(frames), "task_rows": counted(tasks)}).withColumn(
        "consistent",
        (F.col("frame_rows") == F.col("expected_frames")) & (F.col("episode_rows") > 0) & (F.col("task_rows") > 0),
    )


def spot_check(candidates: DataFrame, written: DataFrame, expected: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Re-read candidate rows: present, right size, right return?

    ``written`` and ``expected`` hold ``index``, ``dimension`` and ``return``.
    """
    want = expected.select("index", F.col("dimension").alias("want_dim"), F.col("return").cast("double").alias("want_return"))
    have = written.select("index", F.col("dimension").alias("have_dim"), F.col("return").cast("double").alias("have_return"))
    chosen = candidates.select("index").distinct()
    return (
        want.join(chosen, "index", "left_semi")
        .join(have.join(chosen, "index", "left_semi"), "index", "left")
        .select(
            "index",
            F.col("have_dim").isNotNull().alias("found"),
            F.coalesce(F.col("have_dim") == F.col("want_dim"), F.lit(False)).alias("dimension_ok"),
            F.coalesce(F.abs(F.col("have_return") - F.col("want_return")) <= tolerance, F.lit(False)).alias("return_ok"),
        )
    )

"""Reading datasets and their side files."""

from __future__ import annotations

import re
from string import Formatter

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from epistride.columns import (
    EPISODE_LINES,
    EPISODE_STATS_LINES,
    INFO_LINES,
    SPLIT_LINES,
    TASK_LINES,
    named,
)
from epistride.functions.scalars import (
    all_finite,
    clean_task,
    clean_text,
    first_positive,
    is_finite,
    scalar_cell,
    strict_bool_token,
    strict_long_number,
    strict_long_token,
)
from epistride.operators.integrity import duplicate_keys, require_none
from epistride.operators.scans import spread_join
from epistride.session import stored
from epistride.sources import episode_files
from epistride.sources.json_scan import document_problems, json_leaves


def read_frames(spark: SparkSession, root: str, schema: T.StructType | None = None) -> DataFrame:
    """All frame files below ``root/data``, in either layout.

    Files are ``chunk-000/file-000.parquet``, or lie in directories named
    ``chunk=0/file=0``; the latter names come as columns, so a filter on them
    reads no other directory.  With ``schema`` only its columns are returned
    and no file is opened for planning; columns that the files lack are null.
    """
    reader = spark.read if schema is None else spark.read.schema(schema)
    try:
        frames = reader.parquet(f"{root}/data/chunk-*/*.parquet")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        frames = reader.parquet(f"{root}/data")
    return frames if schema is None else frames.select(*[named(f.name) for f in schema])


# What a path template may name, and the column of the episode table that fills it.
ADDRESS = {"chunk_index": "data/chunk_index", "file_index": "data/file_index", "episode_chunk": "episode_chunk", "episode_index": "episode_index"}


def data_files(episodes: DataFrame, data_path: str, chunk_size: int = 1000) -> list[str]:
    """Paths, relative to the root, of the files that hold the given rows of the episode table.

    ``data_path`` is the template of the dataset's description, such as
    ``data/chunk-{chunk_index:03d}/file-{file_index:03d}.parquet``.  The list
    is as long as there are files to open, as Spark's own list of them.
    """
    fields = sorted({field for _, field, _, _ in Formatter().parse(data_path) if field is not None})
    unknown = [field for field in fields if field not in ADDRESS]
    if unknown:
        raise ValueError(f"unknown field in path template {data_path!r}: {unknown}")
    rows = episodes.withColumn("episode_chunk", F.floor(F.col("episode_index") / chunk_size))
    rows = rows.select(*[named(ADDRESS[field]).cast("long").alias(field) for field in fields]).distinct()
    return sorted(data_path.format(**row.asDict()) for row in rows.toLocalIterator())


def read_episode_frames(
    spark: SparkSession,
    root: str,
    episodes: DataFrame,
    schema: T.StructType | None = None,
    data_path: str | None = None,
    chunk_size: int = 1000,
) -> DataFrame:
    """Frames of the given rows of the episode table; only the files they lie in are opened.

    The template comes from the dataset's description unless given.  A shard
    may go on in files named after it (``file-000.part-001.parquet``).
    """
    if data_path is None:
        described = read_info(spark, root, pretty=True).select("data_path", "chunks_size").first()
        data_path, chunk_size = described.data_path, described.chunks_size or chunk_size
    files = data_files(episodes, data_path, chunk_size)
    if not files:
        return read_frames(spark, root, schema).limit(0)
    reader = spark.read if schema is None else spark.read.schema(schema)
    whole = [f"{root}/" + re.sub(r"\.parquet$", "{.parquet,.part-*.parquet}", f) for f in files]
    frames = reader.option("basePath", f"{root}/data").parquet(*whole)
    if schema is not None:
        frames = frames.select(*[named(f.name) for f in schema])
    return frames.join(episodes.select("episode_index"), "episode_index", "left_semi")


def read_column(frames: DataFrame, name: str, scalar: bool = False) -> DataFrame:
    """One column; the scan reads nothing else."""
    value = scalar_cell(frames, name) if scalar else named(name)
    return frames.select(value.alias(name))


def read_episodes(spark: SparkSession, root: str, strict: bool = True) -> DataFrame:
    """The episode table; repeated episodes are refused."""
    episodes = spark.read.option("recursiveFileLookup", True).parquet(f"{root}/meta/episodes")
    if "episode_index" not in episodes.columns:
        raise ValueError(f"{root}/meta/episodes has no episode_index")
    if strict:
        require_none(duplicate_keys(episodes, ["episode_index"]), "repeated episodes")
    return episodes


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def _present(value: Column) -> Column:
    """A leaf's text, without JSON's null."""
    return F.when(F.col("is_string") | (value != "null"), value)


def read_tasks(spark: SparkSession, path: str, form: str = "parquet", pretty: bool = True) -> DataFrame:
    """(task_index, task) from any of the known forms.

    ``parquet`` takes the text from a ``task`` column or, when the file was
    written from an indexed pandas frame, from its index column; ``lines`` is
    one object per line; ``object`` maps id to text, also in pages of one line
    each (``pretty=False``); ``list`` is texts in id order.  A document that
    spans lines is read in many tasks.
    """
    if form == "parquet":
        table = spark.read.parquet(path)
        text = "task" if "task" in table.columns else "__index_level_0__"
        return table.select(
            F.col("task_index").cast("long").alias("task_index"), clean_task(table, text).alias("task")
        )
    if form == "lines":
        return spark.read.schema(TASK_LINES).json(path).select("task_index", clean_text(F.col("task")).alias("task"))
    if form not in ("object", "list"):
        raise ValueError(f"unknown task form {form!r}")
    index: Column = strict_long_token(F.col("key")) if form == "object" else F.col("key").cast("long")
    if pretty:
        members = json_leaves(spark, path, 1).where("not empty")
        key = F.get("keys", 0) if form == "object" else F.get("places", 0)
        pairs = members.select(key.alias("key"), _present(F.col("value")).alias("text"))
    elif form == "object":
        pairs = _lines(spark, path).select(F.explode(F.from_json("value", "map<string,string>")).alias("key", "text"))
    else:
        pairs = _lines(spark, path).select(F.posexplode(F.from_json("value", "array<string>")).alias("key", "text"))
    return pairs.select(index.alias("task_index"), clean_text(F.col("text")).alias("task"))


def read_episode_lines(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(EPISODE_LINES).json(f"{root}/meta/episodes.jsonl")


def read_task_lines(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(TASK_LINES).json(f"{root}/meta/tasks.jsonl")


def read_episode_statistics_lines(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(EPISODE_STATS_LINES).json(f"{root}/meta/episodes_stats.jsonl")


def read_episode_files(spark: SparkSession, root: str) -> DataFrame:
    """Frames of a legacy dataset; the episode stands in the directory's name.

    Each reading opens as many files as there are episodes, so store what is
    read more than once.
    """
    found = episode_files.read_files(spark, f"{root}/data")
    if found is not None:
        return found
    frames = spark.read.parquet(f"{root}/data")
    return frames.withColumn("episode_index", F.col("episode_index").cast("long")).drop("episode_chunk")


# Metadata files that each legacy generation must have.
REQUIRED_FILES = {
    "v2.0": ("meta/info.json", "meta/episodes.jsonl", "meta/tasks.jsonl", "meta/stats.json"),
    "v2.1": ("meta/info.json", "meta/episodes.jsonl", "meta/tasks.jsonl", "meta/episodes_stats.jsonl"),
}


def missing_files(files: DataFrame, generation: str) -> DataFrame:
    """(root, path) of required metadata files that a listing lacks.

    A file may also be a directory of parts, as Spark writes it.
    """
    roots = files.select("root").distinct()
    needed = roots.select("root", F.explode(F.array(*[F.lit(p) for p in REQUIRED_FILES[generation]])).alias("path"))
    present = files.select("root", F.regexp_replace("path", r"(\.jsonl?)/.*$", "$1").alias("path")).distinct()
    return needed.join(present, ["root", "path"], "left_anti")


def read_success_labels(spark: SparkSession, path: str) -> DataFrame:
    """(episode_index, success, entry) from files that are objects of episode -> flag.

    An object may hold millions of flat entries, so it is read as text cut at
    commas: Spark splits such a file over tasks.  A null ``episode_index`` or
    ``success`` marks an entry that breaks the format, and a file that is not
    exactly one object gives a row of its own.
    """
    pieces = spark.read.option("lineSep", ",").text(path)
    value, opening, closing = F.col("value"), r"^\s*\{", r"\}\s*$"
    pieces = pieces.select(
        "value",
        F.col("_metadata.file_name").alias("file"),
        # Pieces of a file in order: splits by their start, pieces of a split as they are read.
        F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id")).alias("at"),
        value.rlike(opening).alias("opens"),
        value.rlike(closing).alias("closes"),
    )
    braces = lambda name: F.count_if(name) != 1
    broken = braces("opens") | braces("closes") | ~F.min_by("opens", "at") | ~F.max_by("closes", "at")
    files = pieces.groupBy("file").agg(broken.alias("broken")).where("broken")
    shape = r"(?s)^\s*\"([^\"]*)\"\s*:\s*(.*?)\s*$"
    bare = F.regexp_replace(F.regexp_replace(value, opening, ""), closing, "")
    entries = pieces.select("value", bare.alias("bare"), (F.col("opens") & F.col("closes")).alias("alone"))
    # Only an empty object may have an empty entry.
    entries = entries.where(~(F.col("alone") & F.col("bare").rlike(r"^\s*$")))
    matched = F.col("bare").rlike(shape)
    found = entries.select(
        F.when(matched, strict_long_token(F.regexp_extract("bare", shape, 1))).alias("episode_index"),
        F.when(matched, strict_bool_token(F.regexp_extract("bare", shape, 2))).alias("success"),
        F.regexp_replace("bare", r"^\s+|\s+$", "").alias("entry"),
    )
    faults = files.select(
        F.lit(None).cast("long").alias("episode_index"),
        F.lit(None).cast("boolean").alias("success"),
        F.concat(F.lit("not one object: "), "file").alias("entry"),
    )
    return found.unionByName(faults)


def label_file_problems(labels: DataFrame) -> DataFrame:
    """Entries that are no label, and episodes labelled twice."""
    broken = labels.where(F.col("episode_index").isNull() | F.col("success").isNull()).select("entry")
    twice = duplicate_keys(labels.where(F.col("episode_index").isNotNull()), ["episode_index"])
    return broken.unionByName(twice.select(F.col("episode_index").cast("string").alias("entry")))


def read_split(spark: SparkSession, path: str, pretty: bool = False) -> DataFrame:
    """(episode_index, split) from a split manifest.

    ``pretty`` reads one document spread over lines; without it every line is
    one page of the manifest.
    """
    pages = spark.read.schema(SPLIT_LINES).option("multiLine", pretty).json(path)
    require_none(
        pages.where(~F.col("schema_version").eqNullSafe(F.lit(1))).select("schema_version"), "unsupported split manifest"
    )
    side = lambda name: pages.select(F.explode(name).alias("episode_index"), F.lit(name).alias("split"))
    split = side("train").unionByName(side("val"))
    both = side("train").join(side("val"), "episode_index", "left_semi")
    require_none(both, "episodes on both sides of the split", ["episode_index"])
    return split


_CURVE = T.StructType(
    [
        # Numbers as they are written: a double would change large ids.
        T.StructField("episode_id", T.StringType()),
        T.StructField("page", T.LongType()),
        T.StructField("frame_indices", T.ArrayType(T.StringType())),
        T.StructField("values", T.ArrayType(T.DoubleType())),
    ]
)


def read_curve_entries(spark: SparkSession, path: str, pretty: bool = True) -> DataFrame:
    """Curve entries from a list, or an object holding ``curves`` or
    ``episode_curves``.  Returns and metrics stay unread."""
    wrapped = T.StructType(
        [*_CURVE.fields, T.StructField("curves", T.ArrayType(_CURVE)), T.StructField("episode_curves", T.ArrayType(_CURVE))]
    )
    rows = spark.read.schema(wrapped).option("multiLine", pretty).json(path)
    own = F.array(F.struct("episode_id", "page", "frame_indices", "values"))
    return rows.select(F.inline(F.coalesce("curves", "episode_curves", own)))


def curve_entry_problems(entries: DataFrame) -> DataFrame:
    """Entries that cannot be aligned: (episode_id, problem)."""
    frames, values = F.col("frame_indices"), F.col("values")
    whole = lambda x: strict_long_number(x).isNotNull()
    problem = (
        F.when(F.col("episode_id").isNull() | frames.isNull() | values.isNull(), "missing field")
        .when(strict_long_number(F.col("episode_id")).isNull(), "episode id")
        .when(F.size(frames) != F.size(values), "sizes differ")
        .when(F.size(frames) == 0, "no points")
        .when(~F.forall(frames, whole), "frame index")
        .when(~all_finite(values), "value")
        .when(F.size(F.array_distinct(F.transform(frames, strict_long_number))) != F.size(frames), "duplicate frame")
    )
    broken = entries.select("episode_id", problem.alias("problem")).where(F.col("problem").isNotNull())
    twice = (
        entries.groupBy("episode_id", F.coalesce("page", F.lit(0)).alias("page"))
        .agg(F.count(F.lit(1)).alias("copies"))
        .where((F.col("copies") > 1) & F.col("episode_id").isNotNull())
    )
    return broken.unionByName(twice.select("episode_id", F.lit("duplicate episode").alias("problem")))


def curve_cells(spark: SparkSession, path: str) -> DataFrame:
    """(file, entry, field, place, value, is_string) of the curve entries in documents of any size.

    A document is a list of entries, one entry, or an object that holds a list
    under ``curves`` or else ``episode_curves``.  An array's members have
    places from 0; an empty array has one row without a place, other fields
    have place -1.
    """
    leaves = json_leaves(spark, path, 4)
    first = F.get("keys", 0)
    named_list = first.isin("curves", "episode_curves")
    # Where both names occur the first one counts.
    both = leaves.groupBy("file").agg(F.bool_or(first == "curves").alias("plain"))
    leaves = spread_join(leaves, both, ["file"], ["places"]).where(~((first == "episode_curves") & F.col("plain")))
    skipped = F.when(named_list, 2).when(first == "", 1).otherwise(0)
    rows = leaves.withColumn("skipped", skipped).where(F.size("keys") > F.col("skipped"))
    below = F.size("keys") - F.col("skipped")
    place = F.when(below == 1, F.lit(-1)).when(~F.col("empty"), F.get("places", F.col("skipped") + 1))
    entry = F.when(F.col("skipped") > 0, F.get("places", F.col("skipped") - 1)).otherwise(0)
    return rows.where((below <= 2) & F.get("keys", F.col("skipped")).isin("episode_id", "page", "frame_indices", "values")).select(
        "file", entry.cast("long").alias("entry"), F.get("keys", F.col("skipped")).alias("field"), place.cast("long").alias("place"),
        _present(F.col("value")).alias("value"), "is_string",
    )


def curve_cell_problems(cells: DataFrame) -> DataFrame:
    """Entries of ``curve_cells`` that cannot be aligned: (episode_id, problem), as ``curve_entry_problems`` names them."""
    field, member = F.col("field"), F.col("place") >= 0
    own = lambda name: F.max(F.when((field == name) & (F.col("place") == -1), F.col("value")))
    some = lambda name: F.coalesce(F.bool_or(field == name), F.lit(False))
    size = lambda name: F.count_if((field == name) & member)
    frame = strict_long_number(F.col("value"))
    told = cells.groupBy("file", "entry").agg(
        own("episode_id").alias("episode_id"),
        own("page").alias("page"),
        (some("frame_indices") & some("values")).alias("complete"),
        size("frame_indices").alias("frames"),
        size("values").alias("numbers"),
        F.count_if((field == "frame_indices") & member & frame.isNull()).alias("bad_frames"),
        F.count_if((field == "values") & member & ~F.coalesce(_number(), F.lit(False))).alias("bad_values"),
    )
    frames = cells.where((field == "frame_indices") & member).select("file", "entry", frame.alias("frame"))
    twice = duplicate_keys(frames, ["file", "entry", "frame"]).select("file", "entry").distinct().withColumn("twice", F.lit(True))
    told = told.join(twice, ["file", "entry"], "left")
    problem = (
        F.when(F.col("episode_id").isNull() | ~F.col("complete"), "missing field")
        .when(strict_long_number(F.col("episode_id")).isNull(), "episode id")
        .when(F.col("frames") != F.col("numbers"), "sizes differ")
        .when(F.col("frames") == 0, "no points")
        .when(F.col("bad_frames") > 0, "frame index")
        .when(F.col("bad_values") > 0, "value")
        .when(F.col("twice"), "duplicate frame")
    )
    broken = told.select("episode_id", problem.alias("problem")).where(F.col("problem").isNotNull())
    again = told.where("episode_id is not null").groupBy("episode_id", F.coalesce("page", F.lit("0")).alias("page")).agg(F.count(F.lit(1)).alias("copies"))
    return broken.unionByName(again.where("copies > 1").select("episode_id", F.lit("duplicate episode").alias("problem")))


def _number() -> Column:
    """Is the cell a finite number, not a text?"""
    return ~F.col("is_string") & is_finite(F.col("value").try_cast("double"))


def _points_of_cells(cells: DataFrame) -> DataFrame:
    member = lambda name, kept: cells.where((F.col("field") == name) & (F.col("place") >= 0)).select("file", "entry", "place", kept)
    frames = member("frame_indices", strict_long_number(F.col("value")).alias("frame_index"))
    values = member("values", F.col("value").try_cast("double").alias("value"))
    ids = cells.where((F.col("field") == "episode_id") & (F.col("place") == -1))
    ids = ids.select("file", "entry", strict_long_number(F.col("value")).alias("episode_id"))
    points = frames.join(values, ["file", "entry", "place"])
    # An entry may hold most of the points.
    return spread_join(points, ids, ["file", "entry"], ["place"]).select("episode_id", "frame_index", "value")


def read_curves(spark: SparkSession, path: str, pretty: bool = True) -> DataFrame:
    """(episode_id, frame_index, value) of a valid curve artifact.

    ``pretty`` reads documents that may span lines, of any size, in many
    tasks; without it every line is a document of its own.
    """
    if pretty:
        require_none(document_problems(spark, path), "curve artifact", ["file", "problem"])
        cells = stored(curve_cells(spark, path), "curve-cells")
        if cells.isEmpty():
            raise ValueError(f"{path} holds no curves")
        require_none(curve_cell_problems(cells), "curve artifact", ["episode_id", "problem"])
        points = _points_of_cells(cells)
    else:
        entries = read_curve_entries(spark, path, pretty)
        if entries.isEmpty():
            raise ValueError(f"{path} holds no curves")
        require_none(curve_entry_problems(entries), "curve artifact", ["episode_id", "problem"])
        points = entries.select(
            strict_long_number(F.col("episode_id")).alias("episode_id"), F.inline(F.arrays_zip("frame_indices", "values"))
        ).select("episode_id", strict_long_number(F.col("frame_indices")).alias("frame_index"), F.col("values").alias("value"))
    # Pages of one episode must not overlap.
    require_none(duplicate_keys(points, ["episode_id", "frame_index"]), "repeated curve points", ["episode_id", "frame_index"])
    return points


_VIDEO = (
    "path string, frame_offset bigint, fps double, frame_count bigint, history_size bigint, "
    "start_seconds double, camera_key string"
)


def read_video_map(spark: SparkSession, path: str, pretty: bool = True, base: str | None = None) -> DataFrame:
    """One row per episode of an object of episode -> path or description.

    ``pretty`` reads one object per file, in many tasks, otherwise one per
    line.  Relative paths are placed below ``base``, normally the map's own folder.
    """
    if pretty:
        leaves = json_leaves(spark, path, 2).where(~F.col("empty") | (F.size("keys") == 2))
        field = F.coalesce(F.get("keys", 1), F.lit("path"))
        value = _present(F.col("value"))
        columns = [f.split() for f in _VIDEO.split(", ")]
        pick = lambda name, kind: F.max(F.when((field == name) & ~F.col("empty"), value)).try_cast(kind).alias(name)
        rows = leaves.groupBy("file", F.get("places", 0).alias("__place"), F.get("keys", 0).alias("__key")).agg(*[pick(n, k) for n, k in columns])
        rows = rows.select(strict_long_token(F.col("__key")).alias("episode_id"), *[n for n, _ in columns])
    else:
        pairs = _lines(spark, path).select(F.explode(F.from_json("value", "map<string,string>")).alias("key", "entry"))
        described = F.from_json("entry", _VIDEO)
        entry = F.when(F.ltrim("entry").startswith("{"), described).otherwise(
            F.from_json(F.to_json(F.struct(F.col("entry").alias("path"))), _VIDEO)
        )
        rows = pairs.select(strict_long_token(F.col("key")).alias("episode_id"), entry.alias("v")).select("episode_id", "v.*")
    if base is None:
        return rows
    relative = (F.length("path") > 0) & ~F.col("path").startswith("/")
    return rows.withColumn("path", F.when(relative, F.concat(F.lit(base.rstrip("/") + "/"), "path")).otherwise(F.col("path")))


def video_map_problems(video_map: DataFrame) -> DataFrame:
    """Entries with an unusable field: (episode_id, problem)."""
    problem = (
        F.when(F.col("episode_id").isNull(), "episode id")
        .when(F.coalesce(F.length("path"), F.lit(0)) == 0, "path")
        .when(F.col("history_size") < 1, "history size")
        .when(F.col("start_seconds").isNotNull() & (~is_finite(F.col("start_seconds")) | (F.col("start_seconds") < 0)), "start")
        .when(F.col("frame_count") < 1, "frame count")
    )
    return video_map.select("episode_id", problem.alias("problem")).where(F.col("problem").isNotNull())


def read_info(spark: SparkSession, root: str, pretty: bool = False) -> DataFrame:
    """The one-row dataset description."""
    return spark.read.schema(INFO_LINES).option("multiLine", pretty).json(f"{root}/meta/info.json")


def info_features(info: DataFrame) -> DataFrame:
    """(feature, dtype, shape, names) rows of a description."""
    return info.select(F.explode("features").alias("feature", "f")).select("feature", "f.dtype", "f.shape", "f.names")


def video_features(info: DataFrame) -> DataFrame:
    return info_features(info).where(F.lower("dtype") == "video").select("feature")


def resolved_fps(info: DataFrame, *overrides: float | None) -> DataFrame:
    """One row ``fps``: first positive finite override, else the stated one."""
    return info.select(first_positive(*[F.lit(o).cast("double") for o in overrides], F.col("fps")).alias("fps"))

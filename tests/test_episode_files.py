"""Directories of one episode each: written and read by tasks, or by Spark where the folder is not mounted."""

import datetime

import pyarrow.parquet as pq
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from epistride.columns import COLUMNS
from epistride.operators import shards, statistics
from epistride.plans import migrations
from epistride.sources import episode_files, readers, writers

SCHEMA = "episode_index long, frame_index long, action array<float>, text string, at timestamp, day date, index long"


def frames_of_kinds(spark):
    at = datetime.datetime(2024, 5, 1, 12, 30, 0, 7)
    rows = [(e, f, [float(e), None], None if f == 1 else f"t{e}", at, at.date(), 10 * e + f) for e in (0, 3, 1000) for f in range(4)]
    return spark.createDataFrame(rows, SCHEMA)


def files_below(folder):
    """What lies in the directories, besides the marker of a whole table."""
    return sorted(str(p.relative_to(folder)) for p in folder.rglob("*") if p.is_file() and "_SUCCESS" not in p.name)


def test_an_episode_is_one_directory_of_its_files_only(spark, tmp_path, rows):
    frames = frames_of_kinds(spark)
    writers.write_episode_files(frames, str(tmp_path))
    assert files_below(tmp_path / "data") == [
        f"episode_chunk={e // 1000}/episode_index={e}/part-00000.parquet" for e in (0, 3, 1000)
    ]
    got = readers.read_episode_files(spark, str(tmp_path))
    assert dict(got.dtypes) == dict(frames.dtypes)
    assert rows(got.select(*frames.columns)) == rows(frames)
    # Spark's own reader finds the same.
    plain = spark.read.parquet(str(tmp_path / "data"))
    assert rows(plain.select(*frames.columns)) == rows(frames)
    assert {r.episode_chunk for r in plain.collect()} == {0, 1}
    with pytest.raises(FileExistsError):
        writers.write_episode_files(frames, str(tmp_path))


def test_frames_of_an_episode_lie_in_order(spark, tmp_path):
    frames = spark.range(5000).select(F.lit(7).cast("long").alias("episode_index"), (4999 - F.col("id")).alias("frame_index"))
    writers.write_episode_files(frames, str(tmp_path), block_rows=2000)
    folder = tmp_path / "data" / "episode_chunk=0" / "episode_index=7"
    parts = [pq.read_table(folder / name, partitioning=None)["frame_index"].to_pylist() for name in files_below(folder)]
    assert parts == [list(range(2000)), list(range(2000, 4000)), list(range(4000, 5000))]


def test_many_rows_of_a_file_stay_together(spark, tmp_path, monkeypatch):
    """More rows than a batch or a row group holds, beside small episodes."""
    monkeypatch.setattr(episode_files, "GROUP_ROWS", 15_000)
    monkeypatch.setattr(episode_files, "BATCH_ROWS", 700)
    frames = spark.range(40_500).select(F.greatest(F.col("id") - 40_000, F.lit(0)).alias("episode_index"), F.col("id").alias("frame_index"))
    writers.write_episode_files(frames, str(tmp_path))
    got = readers.read_episode_files(spark, str(tmp_path)).select(*frames.columns)
    assert got.count() == 40_500 and got.exceptAll(frames).count() == 0
    assert len(files_below(tmp_path / "data")) == 500


def test_rows_without_episode_or_frame_are_kept(spark, tmp_path, rows):
    frames = spark.createDataFrame(
        [(0, 0, 1), (0, None, 2), (0, None, 2), (None, 0, 3), (None, None, 4), (-1, 5, 5), (2, -3, 6)],
        "episode_index long, frame_index long, index long",
    )
    writers.write_episode_files(frames, str(tmp_path), block_rows=2)
    assert rows(readers.read_episode_files(spark, str(tmp_path)).select(*frames.columns)) == rows(frames)
    plain = spark.read.parquet(str(tmp_path / "data"))
    assert rows(plain.select(F.col("episode_index").cast("long"), "frame_index", "index")) == rows(frames)


def test_spark_reads_and_writes_where_the_folder_is_not_mounted(spark, tmp_path, rows, monkeypatch):
    frames = frames_of_kinds(spark)
    with monkeypatch.context() as patch:
        patch.setattr(episode_files, "mounted", lambda *_: None)
        writers.write_episode_files(frames, str(tmp_path))
        assert rows(readers.read_episode_files(spark, str(tmp_path)).select(*frames.columns)) == rows(frames)
    # What Spark wrote is read by tasks too.
    assert episode_files.read_files(spark, str(tmp_path / "data")) is not None
    assert rows(readers.read_episode_files(spark, str(tmp_path)).select(*frames.columns)) == rows(frames)


def test_the_first_file_tells_the_columns(spark, tmp_path, rows):
    data = str(tmp_path / "data")
    spark.createDataFrame([(0, 5)], "frame_index long, x long").write.parquet(f"{data}/episode_chunk=0/episode_index=0")
    spark.createDataFrame([(1,)], "frame_index long").write.parquet(f"{data}/episode_chunk=0/episode_index=1")
    got = readers.read_episode_files(spark, str(tmp_path))
    assert rows(got.select("episode_index", "frame_index", "x")) == [(0, 0, 5), (1, 1, None)]


def test_nothing_appears_when_a_task_fails(spark, tmp_path):
    frames = spark.range(50).select(
        F.col("id").alias("episode_index"),
        F.col("id").alias("frame_index"),
        F.when(F.col("id") == 49, F.raise_error(F.lit("broken")).cast("long")).otherwise(F.col("id")).alias("index"),
    )
    with pytest.raises(PySparkException, match="broken"):
        writers.write_episode_files(frames, str(tmp_path))
    assert not (tmp_path / "data").exists()


def legacy(spark, root, episodes=6, length=5):
    rows = [(e, f, e * length + f, float(e + f), "ab"[e % 2]) for e in range(episodes) for f in range(length)]
    frames = spark.createDataFrame(rows, "episode_index long, frame_index long, index long, x double, words string")
    migrations.write_indexed_tasks(frames, root, 10.0, column="words")
    return frames


def test_each_step_opens_the_episode_files_once(spark, tmp_path, rows, monkeypatch):
    frames = legacy(spark, str(tmp_path / "v20"))
    seen = []
    for owner, name in ((statistics, "episode_statistics"), (migrations, "to_sharded")):
        was = getattr(owner, name)
        monkeypatch.setattr(owner, name, lambda given, *a, was=was, **k: (seen.append(given), was(given, *a, **k))[1])
    migrations.write_episode_statistics(spark, str(tmp_path / "v20"), str(tmp_path / "v21"))
    migrations.write_sharded(spark, str(tmp_path / "v21"), str(tmp_path / "v30"), max_frames=11)
    assert len(seen) == 2
    for given in seen:
        assert given.inputFiles() and all("/scratch/" in path for path in given.inputFiles())
    got = readers.read_frames(spark, str(tmp_path / "v30")).select("episode_index", "frame_index", "index", "x")
    assert rows(got) == rows(frames.select("episode_index", "frame_index", "index", "x"))


def test_statistics_of_the_episodes_are_computed_once(spark, tmp_path, rows, monkeypatch):
    """The check and the merge read them several times, so they are stored."""
    frames = legacy(spark, str(tmp_path / "v20"))
    whole = statistics.feature_statistics(frames, ["x"])
    parts = migrations.to_episode_statistics(frames, whole)
    assert parts.inputFiles() and all("/scratch/" in path for path in parts.inputFiles())
    assert rows(parts) == rows(statistics.episode_statistics(frames, ["x"]))

    seen, was = [], statistics.merge_statistics
    monkeypatch.setattr(statistics, "merge_statistics", lambda given: (seen.append(given), was(given))[1])
    migrations.write_episode_statistics(spark, str(tmp_path / "v20"), str(tmp_path / "v21"))
    migrations.write_sharded(spark, str(tmp_path / "v21"), str(tmp_path / "v30"), max_frames=11)
    assert len(seen) == 2 and all("/scratch/" in path for given in seen for path in given.inputFiles())
    merged = spark.read.schema(migrations.STATISTICS).json(str(tmp_path / "v30" / "meta" / "stats.json"))
    got = {r.feature: (r.min, r.max, round(r.mean, 9)) for r in merged.collect()}
    assert (got["x"], got["index"]) == ((0.0, 9.0, 4.5), (0.0, 29.0, 14.5))


def test_shards_are_written_by_all_tasks(spark, tmp_path):
    """However few bytes they have: each shard costs a directory and a file."""
    frames = spark.range(600).select(F.floor(F.col("id") / 3).alias("episode_index"), F.col("id") % 3, F.col("id").alias("index"))
    frames = frames.toDF("episode_index", "frame_index", "index")
    sharded = shards.episode_shards(frames.groupBy("episode_index").agg(F.count("*").alias("length")), 6)
    placed = writers._in_shards(frames, sharded, 6, COLUMNS)
    assert placed.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1
    held = placed.withColumn("task", F.spark_partition_id()).groupBy("chunk", "file", "piece").agg(F.countDistinct("task"), F.count("*"))
    assert {tuple(r)[3:] for r in held.collect()} == {(1, 6)} and held.count() == 100

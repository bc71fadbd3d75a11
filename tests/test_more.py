"""Names that clash, hot episodes, nested roots and file details."""

import json

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from epistride.columns import Columns
from epistride.operators import align, labels, layout, returns, scans, shards, statistics, tasks, windows
from epistride.sources import readers, writers
from tests.test_returns import column, frames_of, labels_of


def test_frame_columns_may_carry_any_name(spark):
    extra = ("success", "length", "first_frame", "last_frame", "task_max_length")
    frames = frames_of(spark, {0: 3, 1: 2}).withColumns({n: F.lit(-1) for n in extra})
    label = labels_of(spark, {0: True, 1: False})
    made = returns.with_returns(frames, label)
    assert set(extra) <= set(made.columns) and made.agg(F.min("length"), F.max("success")).collect()[0] == (-1, -1)
    assert column(made, "return_raw", 0) == [-2.0, -1.0, 0.0]
    assert windows.endpoint_frames(frames, 1).columns == frames.columns
    assert labels.with_labels(frames, label).columns == [*frames.columns, "episode_success"]


def test_names_are_configuration(spark):
    names = Columns(episode="trial", frame="step", task="goal", ret="g", ret_raw="g_raw", success="won")
    frames = frames_of(spark, {0: 3}).toDF("trial", "step", "goal")
    made = returns.with_returns(frames, spark.createDataFrame([(0, True)], "trial long, success boolean"), c=names)
    assert made.columns == ["trial", "step", "goal", "g", "g_raw", "won"]
    assert windows.history_windows(made, 2, ["g"], c=names).count() == 1


@pytest.mark.parametrize("block", [1, 4, 1000])
def test_episode_join_keeps_every_frame(spark, block):
    frames = frames_of(spark, {0: 50, 1: 1, 2: 7})
    spans = frames.groupBy("episode_index").agg(F.min("frame_index").alias("first_frame"), F.max("frame_index").alias("last_frame"))
    joined = scans.join_episodes(frames, spans, "episode_index", "frame_index", block_rows=block)
    assert joined.count() == 58
    assert joined.where("frame_index > __last_frame or frame_index < __first_frame").count() == 0


def test_a_null_label_gives_no_return(spark):
    made = returns.with_returns(frames_of(spark, {0: 2}), labels_of(spark, {0: None}).select("episode_index", F.lit(None).cast("boolean").alias("success")))
    assert column(made, "return", 0) == [None, None]


def test_unlabelled_frames_are_kept(spark):
    frames, label = frames_of(spark, {0: 2, 1: 2}), labels_of(spark, {0: True})
    for mode in returns.NORMALISATIONS:
        assert column(returns.with_returns(frames, label, mode), "return", 1) == [None, None]
    assert column(labels.with_labels(frames, label), "episode_success", 1) == [None, None]
    assert labels.disagreeing_labels(frames.withColumn("s", F.lit(1)), label, "s").count() == 2


def test_row_groups_are_bounded(spark, tmp_path):
    frames = spark.range(150_000).select(
        F.lit(0).cast("long").alias("episode_index"), F.col("id").alias("frame_index"), F.rand(1).alias("x")
    )
    sharded = spark.createDataFrame([(0, 150_000, 0, 0)], "episode_index long, length long, offset long, shard long")
    writers.write_frames(frames, sharded, str(tmp_path / "out"), 1_000_000)
    files = list((tmp_path / "out" / "data").rglob("*.parquet"))
    assert len(files) == 1
    meta = pq.read_metadata(files[0])
    assert max(meta.row_group(i).num_rows for i in range(meta.num_row_groups)) <= 65_536
    frame = pq.read_table(files[0]).column("frame_index").to_pylist()
    assert frame == sorted(frame)


def test_nested_roots(spark, rows):
    files = [("a", "org/set/meta/info.json"), ("a", "org/set/data/x"), ("a", "other"), ("b", "meta/info.json"), ("b", "org/set/x")]
    got = layout.resolve_roots(spark.createDataFrame(files, "root string, path string"), "org/set")
    assert rows(got) == [("a", "data/x"), ("a", "meta/info.json"), ("b", "meta/info.json"), ("b", "org/set/x")]


def test_first_stated_version_decides(spark):
    files = spark.createDataFrame([("a", "meta/info.json"), ("a", "meta_data/info.json"), ("b", "meta/info.json")], "root string, path string")
    stated = spark.createDataFrame(
        [("a", "meta/info.json", "v2.1"), ("a", "meta_data/info.json", "bad"), ("b", "meta/info.json", "9")],
        "root string, path string, codebase_version string",
    )
    got = {r.root: (r.version, r.basis) for r in layout.classify_roots(files, stated).collect()}
    assert got == {"a": ("v2.1", "declared"), "b": (None, "unsupported version")}


def test_video_map_paths_counts_and_rates(spark, tmp_path):
    path = tmp_path / "map.json"
    path.write_text(json.dumps({"1": "a.mp4", "2": {"path": "/b.mp4", "start_seconds": 4.0}, "3": {"path": "c.mp4", "fps": 5, "frame_count": 9}}))
    video_map = readers.read_video_map(spark, str(path), base=str(tmp_path))
    points = spark.createDataFrame([(e, f, 0.0) for e in (1, 2, 3) for f in (2, 3)], "episode_id long, frame_index long, value double")
    probed = spark.createDataFrame([(e, 50, 24.0) for e in (1, 2, 3)], "episode_id long, frame_count long, fps double")
    got = {r.episode_id: r for r in align.sources_from_map(points, video_map, probed=probed, history=3).collect()}
    assert got[1].path == f"{tmp_path}/a.mp4" and got[2].path == "/b.mp4"
    assert [(got[e].frame_count, got[e].frame_count_inferred, got[e].fps) for e in (1, 2, 3)] == [(50, False, 24.0), (5, True, 24.0), (9, False, 5.0)]
    assert align.preflight(points, align.sources_from_map(points, video_map, fps=10.0, history=3)).where("episode_id = 2").collect()[0].soft == []


def test_motor_names(spark):
    df = spark.createDataFrame([(1, [0.5, 1.0])], "a int, v array<float>")
    inferred = statistics.inferred_features(df)
    features = statistics.feature_map(inferred, motors=True).collect()[0].features
    assert features["v"].names == ["motor_0", "motor_1"] and features["a"].names is None
    assert statistics.feature_map(inferred).collect()[0].features["v"].names is None


def test_existing_instruction_column_is_refused(spark):
    frames = frames_of(spark, {0: 1}).withColumn("task", F.lit("x"))
    with pytest.raises(ValueError):
        tasks.with_task_text(frames, spark.createDataFrame([(0, "pick")], "task_index long, task string"))


def test_curve_pages_must_not_overlap(spark, tmp_path):
    path = tmp_path / "curves.json"
    entry = {"episode_id": 1, "frame_indices": [1], "values": [0.5]}
    path.write_text("\n".join(json.dumps({**entry, "page": p}) for p in (0, 1)))
    with pytest.raises(ValueError, match="repeated curve points"):
        readers.read_curves(spark, str(path), pretty=False)


def test_shards_of_a_hot_episode(spark):
    lengths = [(i, 3) for i in range(40)] + [(40, 5000)] + [(41 + i, 2) for i in range(30)]
    made = shards.episode_shards(spark.createDataFrame(lengths, "episode_index long, length long"), 10, level_blocks=2)
    sizes = made.groupBy("shard").agg(F.sum("length").alias("n"), F.count(F.lit(1)).alias("k")).collect()
    assert all(r.n <= 10 or r.k == 1 for r in sizes) and sum(r.n for r in sizes) == 5180

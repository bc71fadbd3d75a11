import json

import pytest
from pyspark.sql import functions as F

from epistride.functions.versions import migration_steps, normalise_version
from epistride.operators import integrity, layout, pixels, tasks
from epistride.plans.add_returns import add_returns as write_returns
from epistride.plans.migrations import to_indexed_tasks, with_episode_tasks
from epistride.plans.training import prepare_training
from epistride.sources import readers
from tests.test_returns import frames_of


def add_returns(spark, frames, output, **options):
    tasks = spark.createDataFrame([(i, f"task {i}") for i in range(5)], "task_index long, task string")
    return write_returns(spark, frames, output, 10.0, tasks=tasks, **options)


def labelled(spark):
    frames = frames_of(spark, {0: 3, 1: 2})
    return frames.withColumn("next.success", ((F.col("episode_index") == 0) & (F.col("frame_index") == 2)).cast("int"))


def test_add_returns_writes_and_verifies(spark, tmp_path):
    out = str(tmp_path / "out")
    made = add_returns(spark, labelled(spark), out)
    got = made.orderBy("episode_index", "frame_index").collect()
    assert [r["return_raw"] for r in got] == [-2.0, -1.0, 0.0, -4.0, -3.0]
    assert [r.episode_success for r in got] == [1, 1, 1, 0, 0]
    definition = spark.read.json(f"{out}/meta/return_definition.json").collect()[0]
    assert (definition.num_success_episodes, definition.success_source, definition.success_reduction) == (1, "next.success", "any")
    assert definition.task_max_episode_length.asDict() == {"0": 3} and definition.definition.normalization == "task_max"
    manifest = spark.read.json(f"{out}/meta/conversion_manifest.json").collect()[0]
    assert (manifest.target_version, manifest.steps, manifest.source_was_modified) == ("v3.0", ["add returns"], False)
    # The output is a dataset like any other.
    assert readers.read_episodes(spark, out).count() == 2
    assert sorted(tuple(r) for r in readers.read_tasks(spark, f"{out}/meta/tasks.parquet").collect())[0] == (0, "task 0")
    info = readers.read_info(spark, out).collect()[0]
    assert {"return", "return_raw", "episode_success"} <= set(info.features) and (info.total_frames, info.fps) == (5, 10.0)
    with pytest.raises(FileExistsError):
        add_returns(spark, labelled(spark), out)


def test_an_existing_root_is_refused(spark, tmp_path):
    (tmp_path / "out" / "meta").mkdir(parents=True)
    (tmp_path / "out" / "meta" / "info.json").write_text("{}")
    with pytest.raises(FileExistsError):
        add_returns(spark, labelled(spark), str(tmp_path / "out"))
    assert not (tmp_path / "out" / "data").exists()


def test_nothing_appears_when_the_last_check_fails(spark, tmp_path, monkeypatch):
    from epistride.operators import returns

    monkeypatch.setattr(returns, "verify_augmented", lambda written, expected, c: expected.select(*c.key, F.lit("return").alias("problem")))
    with pytest.raises(integrity.IntegrityError, match="written rows differ"):
        add_returns(spark, labelled(spark), str(tmp_path / "out"))
    assert not (tmp_path / "out").exists()


def test_a_step_column_of_its_own(spark, tmp_path):
    frames = labelled(spark).withColumn("step", F.col("frame_index") + 5).withColumn("frame_index", F.col("frame_index") * 2)
    frames = frames.withColumn("next.success", F.col("step") % 2)
    made = add_returns(spark, frames.where("episode_index = 0"), str(tmp_path / "out"), step="step")
    assert [r["return_raw"] for r in made.orderBy("frame_index").collect()] == [-2.0, -1.0, 0.0]
    with pytest.raises(integrity.IntegrityError, match="not consecutive"):
        add_returns(spark, frames, str(tmp_path / "gap"))


def test_success_column_wins_over_the_label_file(spark, tmp_path):
    path = tmp_path / "labels.json"
    path.write_text(json.dumps({"0": False, "1": True}))
    made = add_returns(spark, labelled(spark), str(tmp_path / "a"), label_path=str(path))
    assert made.where("episode_index = 0").agg(F.max("episode_success")).collect()[0][0] == 1
    plain = labelled(spark).drop("next.success")
    made = add_returns(spark, plain, str(tmp_path / "b"), label_path=str(path))
    assert made.where("episode_index = 0").agg(F.max("episode_success")).collect()[0][0] == 0


def test_add_returns_refuses_what_it_cannot_trust(spark, tmp_path):
    plain = labelled(spark).drop("next.success")
    with pytest.raises(ValueError, match="never guessed"):
        add_returns(spark, plain, str(tmp_path / "a"))
    path = tmp_path / "labels.json"
    path.write_text(json.dumps({"0": True, "1": True, "9": True}))
    with pytest.raises(integrity.IntegrityError, match="unknown episode"):
        add_returns(spark, plain, str(tmp_path / "b"), label_path=str(path))
    gap = labelled(spark).where(~((F.col("episode_index") == 0) & (F.col("frame_index") == 1)))
    with pytest.raises(integrity.IntegrityError, match="not consecutive"):
        add_returns(spark, gap, str(tmp_path / "c"))
    twice = labelled(spark).withColumn("task_index", F.col("frame_index"))
    with pytest.raises(integrity.IntegrityError, match="several tasks"):
        add_returns(spark, twice, str(tmp_path / "d"))
    stored = labelled(spark).withColumn("episode_success", F.lit(1))
    with pytest.raises(integrity.IntegrityError, match="stored label"):
        add_returns(spark, stored, str(tmp_path / "e"), success_key="next.success")
    with pytest.raises(ValueError, match="outside"):
        add_returns(spark, plain, str(tmp_path / "f" / "inner"), source=str(tmp_path / "f"))


def test_training_data(spark):
    frames = frames_of(spark, {e: 6 for e in range(10)}).withColumn("action", F.array(F.col("frame_index").cast("float")))
    made = prepare_training(frames, 2, 0.2, 1)
    assert (made.train.count(), made.validation.count()) == (32, 8)
    with pytest.raises(integrity.IntegrityError, match="too few"):
        prepare_training(frames, 6, 0.2, 1)
    leaking = spark.createDataFrame([(e, "train") for e in range(10)] + [(0, "val")], "episode_index long, split string")
    with pytest.raises(integrity.IntegrityError, match="both sides"):
        prepare_training(frames, 2, split=leaking)
    partial = spark.createDataFrame([(e, "train") for e in range(9)], "episode_index long, split string")
    with pytest.raises(integrity.IntegrityError, match="missing"):
        prepare_training(frames, 2, split=partial)


def test_instructions_become_ids(spark):
    rows = [(0, 0, 0, "b"), (1, 0, 1, "b"), (2, 1, 0, "a"), (3, 1, 1, "b")]
    df = spark.createDataFrame(rows, "index long, episode_index long, frame_index long, words string")
    indexed, table, episodes = to_indexed_tasks(df, column="words")
    assert {r.task: r.task_index for r in table.collect()} == {"b": 0, "a": 1}
    assert "words" not in indexed.columns and indexed.count() == 4
    assert {r.episode_index: (r.tasks, r.length) for r in episodes.collect()} == {0: (["b"], 2), 1: (["a", "b"], 2)}
    with pytest.raises(integrity.IntegrityError):
        to_indexed_tasks(df.where("episode_index = 1"), task="x")


def test_instruction_maps(spark):
    frames = frames_of(spark, {0: 1, 1: 1})
    pairs = spark.createDataFrame([("0", "pick"), ("1", '["place"]')], "key string, value string")
    got = with_episode_tasks(frames, pairs).orderBy("episode_index").collect()
    assert [r.task for r in got] == ["pick", "place"]
    bad = spark.createDataFrame([("0", "pick"), ("1", '["a", "b"]')], "key string, value string")
    with pytest.raises(integrity.IntegrityError, match="exactly one"):
        with_episode_tasks(frames, bad)
    assert tasks.task_lists(spark.createDataFrame([("1", '["a", " "]')], "key string, value string")).collect()[0].tasks is None


def test_versions(spark):
    texts = ["1", "v1.0", " V2.1 ", "2.0.5", "3", "v3.0", "2.2", "v", "", None, "v1.6", "1.6.0", "03"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(normalise_version(F.col("t"))).collect()]
    assert got == ["v1.6", "v1.6", "v2.1", "v2.0", "v3.0", "v3.0", None, None, None, None, "v1.6", "v1.6", "v3.0"]
    steps = migration_steps(spark).where("version = 'v2.0'").orderBy("step").collect()
    assert [(r.from_version, r.to_version) for r in steps] == [("v2.0", "v2.1"), ("v2.1", "v3.0")]


def test_layouts_on_disk(spark, tmp_path):
    for name in ("a/meta/episodes/x.parquet", "a/meta/tasks.parquet", "b/meta/episodes.jsonl", "b/meta/tasks.jsonl", "b/meta/info.json", "c/notes.txt"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("x")
    files = layout.relative_paths(layout.list_files(spark, str(tmp_path)), str(tmp_path))
    got = {r.root: (r.version, r.basis) for r in layout.classify_roots(files).collect()}
    assert got == {"a": ("v3.0", "files"), "b": ("v2.0", "files"), "c": (None, "unknown layout")}
    assert {r.path for r in readers.missing_files(files.where("root = 'b'"), "v2.1").collect()} == {"meta/episodes_stats.jsonl"}


def test_pixel_audit(spark):
    rows = [
        ([1, 2, 2], [0.0, 0.5, 1.0, 0.2]), ([2, 2, 1], [0.0, 200.0, 1.0, 2.0]), ([1, 4, 1], [0.0] * 4), ([1, 2, 2], [0.0, -1.0, 0.0, 0.0]),
        ([1, 2, 2], [0.0, 300.0, 0.0, 0.0]), ([1, 2, 2], [0.0, float("nan"), 0.0, 0.0]), ([4], [0.0] * 4),
    ]
    df = spark.createDataFrame(rows, "shape array<long>, px array<double>")
    got = [(r.problem, r["layout"], r.value_range) for r in pixels.audit_pixels(df, "px", "shape").collect()]
    assert got == [
        (None, "channels first", "0..1"), (None, "channels last", "0..255"), ("ambiguous layout", None, None), ("negative", None, None),
        ("above 255", None, None), ("not finite", None, None), ("not three dimensions", None, None),
    ]

"""Files as other tools write them, and round trips through our writers."""

import json

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from epistride.operators import integrity, shards
from epistride.plans import migrations
from epistride.sources import readers, writers
from tests.test_returns import frames_of


def test_pretty_and_compact_label_files(spark, tmp_path, rows):
    labels = {"0": True, "1": 0, "2": 1.0, "10": False}
    for i, indent in enumerate((2, None)):
        path = tmp_path / f"labels{i}.json"
        path.write_text(json.dumps(labels, indent=indent) + "\n")
        got = readers.read_success_labels(spark, str(path))
        assert rows(got.select("episode_index", "success")) == [(0, True), (1, False), (10, False), (2, True)]
        assert readers.label_file_problems(got).count() == 0


def test_bad_label_files(spark, tmp_path):
    path = tmp_path / "labels.json"
    path.write_text('{"0": true, "x": true, "2": 2, "3": "true", "4": null, "0": false}')
    got = readers.label_file_problems(readers.read_success_labels(spark, str(path)))
    assert sorted(r.entry for r in got.collect()) == sorted(['"x": true', '"2": 2', '"3": "true"', '"4": null', "0"])
    path.write_text("[true, false]")
    assert readers.label_file_problems(readers.read_success_labels(spark, str(path))).count() == 3


def test_pretty_split_manifest(spark, tmp_path, rows):
    path = tmp_path / "split.json"
    manifest = {"schema_version": 1, "seed": 3, "val_fraction": 0.5, "train": [0, 2], "val": [1]}
    path.write_text(json.dumps(manifest, indent=2))
    assert rows(readers.read_split(spark, str(path), pretty=True)) == [(0, "train"), (1, "val"), (2, "train")]
    path.write_text(json.dumps({**manifest, "val": [1, 2]}, indent=2))
    with pytest.raises(integrity.IntegrityError, match="both sides"):
        readers.read_split(spark, str(path), pretty=True)
    path.write_text(json.dumps({**manifest, "schema_version": 7}, indent=2))
    with pytest.raises(integrity.IntegrityError, match="unsupported"):
        readers.read_split(spark, str(path), pretty=True)


@pytest.mark.parametrize("wrap", [None, "curves", "episode_curves"])
def test_pretty_curve_artifacts(spark, tmp_path, rows, wrap):
    entries = [
        {"episode_id": 3, "frame_indices": [2, 1], "values": [0.5, 0.25], "returns": [0, 0]},
        {"episode_id": 1, "frame_indices": [7], "values": [-1.0]},
    ]
    path = tmp_path / "curves.json"
    path.write_text(json.dumps(entries if wrap is None else {wrap: entries}, indent=2))
    assert rows(readers.read_curves(spark, str(path))) == [(1, 7, -1.0), (3, 1, 0.25), (3, 2, 0.5)]


def test_bad_curve_artifact(spark, tmp_path):
    path = tmp_path / "curves.json"
    path.write_text(json.dumps([{"episode_id": 1, "frame_indices": [1, 2], "values": [0.5]}]))
    with pytest.raises(integrity.IntegrityError, match="sizes differ"):
        readers.read_curves(spark, str(path))


def test_video_map(spark, tmp_path):
    path = tmp_path / "map.json"
    path.write_text(json.dumps({"4": "clips/a.mp4", "5": {"path": "b.mp4", "frame_offset": 3, "fps": 12.5, "start_seconds": -1}}))
    got = {r.episode_id: r for r in readers.read_video_map(spark, str(path)).collect()}
    assert got[4].path == "clips/a.mp4" and got[4].fps is None
    assert (got[5].path, got[5].frame_offset, got[5].fps) == ("b.mp4", 3, 12.5)
    assert [tuple(r) for r in readers.video_map_problems(readers.read_video_map(spark, str(path))).collect()] == [(5, "start")]


def test_task_forms(spark, tmp_path):
    import pandas as pd

    want = [(0, "pick"), (1, "place")]
    frame = pd.DataFrame({"task_index": [0, 1]}, index=pd.Index([" pick ", "place"], name="task"))
    frame.to_parquet(tmp_path / "named.parquet")
    frame.rename_axis(None).to_parquet(tmp_path / "unnamed.parquet")
    (tmp_path / "object.json").write_text(json.dumps({"0": "pick", "1": "place"}, indent=1))
    (tmp_path / "list.json").write_text(json.dumps(["pick", "place"]))
    (tmp_path / "lines.json").write_text('{"task_index": 0, "task": "pick"}\n{"task_index": 1, "task": "place "}\n')
    forms = {"named.parquet": "parquet", "unnamed.parquet": "parquet", "object.json": "object", "list.json": "list", "lines.json": "lines"}
    for name, form in forms.items():
        assert sorted(map(tuple, readers.read_tasks(spark, str(tmp_path / name), form).collect())) == want


def test_info_document(spark, tmp_path):
    (tmp_path / "meta").mkdir()
    info = {
        "codebase_version": "v3.0",
        "fps": 30,
        "features": {"cam": {"dtype": "video", "shape": [4, 4, 3], "names": None}, "action": {"dtype": "float32", "shape": [7]}},
    }
    (tmp_path / "meta" / "info.json").write_text(json.dumps(info, indent=2))
    read = readers.read_info(spark, str(tmp_path), pretty=True)
    assert [r.feature for r in readers.video_features(read).collect()] == ["cam"]
    assert readers.resolved_fps(read, None, 0.0).collect()[0][0] == 30.0
    assert readers.resolved_fps(read, 12.0).collect()[0][0] == 12.0


def test_shards_are_single_files_with_bounded_row_groups(spark, tmp_path):
    lengths = {0: 3, 1: 4, 2: 25, 3: 2}
    frames = frames_of(spark, lengths)
    sharded = shards.episode_shards(spark.createDataFrame(list(lengths.items()), "episode_index long, length long"), 8)
    writers.write_frames(frames, sharded, str(tmp_path / "out"), 8)
    files = sorted((tmp_path / "out" / "data").rglob("*.parquet"))
    by_shard = {}
    for f in files:
        by_shard.setdefault(f.parent.name, []).append(pq.read_metadata(f).num_rows)
    assert by_shard["file=0"] == [7] and by_shard["file=2"] == [2]
    # The oversize episode is cut so that no task writes more than the cap.
    assert sum(by_shard["file=1"]) == 25 and max(by_shard["file=1"]) <= 8
    back = readers.read_frames(spark, str(tmp_path / "out"))
    assert back.count() == 34 and back.columns == [*frames.columns, "chunk", "file"]
    with pytest.raises(Exception, match="ALREADY_EXISTS"):
        writers.write_frames(frames, sharded, str(tmp_path / "out"), 8)


def test_repeated_episode_rows_are_refused(spark, tmp_path):
    spark.createDataFrame([(1,), (1,)], "episode_index long").write.parquet(str(tmp_path / "meta" / "episodes"))
    with pytest.raises(integrity.IntegrityError):
        readers.read_episodes(spark, str(tmp_path))


def test_documents_hold_no_non_finite_numbers(spark, tmp_path):
    row = spark.createDataFrame([(float("nan"), [1.0, float("inf")])], "a double, b array<double>")
    writers.write_document(row, str(tmp_path / "doc"))
    text = "".join(p.read_text() for p in (tmp_path / "doc").glob("part-*"))
    assert json.loads(text) == {"a": None, "b": [1.0, None]}


def test_label_files_are_json(spark, tmp_path):
    labels = spark.createDataFrame([(i, i % 3 == 0) for i in range(25)], "episode_index long, success boolean")
    writers.write_labels(labels, str(tmp_path / "labels"), page_ids=10)
    files = list((tmp_path / "labels").glob("part-*.txt"))
    found = {}
    for f in files:
        found |= json.loads(f.read_text())
    assert len(files) == 3 and found == {str(i): i % 3 == 0 for i in range(25)}
    back = readers.read_success_labels(spark, str(tmp_path / "labels"))
    assert readers.label_file_problems(back).count() == 0
    assert {r.episode_index: r.success for r in back.collect()} == {i: i % 3 == 0 for i in range(25)}


@pytest.mark.parametrize(
    "text, entries",
    [
        ('{"0": true, "1": false}', []),
        ('{\n  "0": true,\n  "1": 0\n}\n', []),
        ("{}", []),
        (" { }\n", []),
        ('{"0": true, "1": false', ["not one object: f.json"]),
        ('"0": true, "1": false}', ["not one object: f.json"]),
        ('{"0": true}{"1": false}', ['"0": true}{"1": false']),
        ('{"0": true}, {"1": false}', ["not one object: f.json"]),
        ('{"0": true,}', [""]),
        ('{"0": true}, "1": false', ["not one object: f.json"]),
        ("[true, false]", ["not one object: f.json"]),
        ('{"0": "true"}', ['"0": "true"']),
    ],
)
def test_malformed_label_files(spark, tmp_path, text, entries):
    (tmp_path / "f.json").write_text(text)
    problems = [r.entry for r in readers.label_file_problems(readers.read_success_labels(spark, str(tmp_path / "f.json"))).collect()]
    assert set(entries) <= set(problems) and bool(problems) == bool(entries)


def test_large_ids_in_curves(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"curves": [{"episode_id": 9007199254740993, "frame_indices": [0, 1.0, 2e0], "values": [1, 2, 3]}]}')
    got = readers.read_curves(spark, str(tmp_path / "c.json")).orderBy("frame_index").collect()
    assert [tuple(r) for r in got] == [(9007199254740993, 0, 1.0), (9007199254740993, 1, 2.0), (9007199254740993, 2, 3.0)]


def test_padded_files_are_read_back_and_only_needed_ones_opened(spark, tmp_path):
    lengths = {0: 3, 1: 4, 2: 25, 3: 2, 4: 8}
    frames = frames_of(spark, lengths)
    episodes = spark.createDataFrame([(e, n, ["t"]) for e, n in lengths.items()], "episode_index long, length long, tasks array<string>")
    tasks = spark.createDataFrame([(0, "t")], "task_index long, task string")
    root = str(tmp_path / "out")
    migrations.to_sharded(frames, episodes, tasks, root, 10.0, 8, padded=True)
    names = sorted(f.relative_to(tmp_path / "out" / "data").as_posix() for f in (tmp_path / "out" / "data").rglob("*.parquet"))
    chunk = "chunk-000/file-00"
    assert names == [f"{chunk}0.parquet", f"{chunk}1.parquet", *[f"{chunk}1.part-00{i}.parquet" for i in (1, 2, 3)], f"{chunk}2.parquet", f"{chunk}3.parquet"]
    assert not (tmp_path / "out" / "data-parts").exists()
    wanted = sorted(map(tuple, frames.collect()))
    assert sorted(map(tuple, readers.read_frames(spark, root).collect())) == wanted
    assert sorted(map(tuple, readers.read_frames(spark, root, frames.schema).collect())) == wanted

    table = readers.read_episodes(spark, root)
    some = readers.read_episode_frames(spark, root, table.where("episode_index in (2, 3)"), frames.schema)
    assert {f.rsplit("/", 1)[1] for f in some.inputFiles()} >= {"file-001.parquet", "file-002.parquet"}
    assert not {f.rsplit("/", 1)[1] for f in some.inputFiles()} & {"file-000.parquet", "file-003.parquet"}
    assert sorted((r.episode_index, r.frame_index) for r in some.collect()) == [(e, i) for e in (2, 3) for i in range(lengths[e])]
    assert readers.read_episode_frames(spark, root, table.where("episode_index > 9")).count() == 0


def test_directories_named_by_key_are_pruned_too(spark, tmp_path):
    lengths = {0: 3, 1: 4, 2: 5}
    frames = frames_of(spark, lengths)
    episodes = spark.createDataFrame([(e, n, ["t"]) for e, n in lengths.items()], "episode_index long, length long, tasks array<string>")
    root = str(tmp_path / "out")
    migrations.to_sharded(frames, episodes, spark.createDataFrame([(0, "t")], "task_index long, task string"), root, 10.0, 5)
    some = readers.read_episode_frames(spark, root, readers.read_episodes(spark, root).where("episode_index = 1"), frames.schema)
    opened = [f for f in some.inputFiles() if "/data/" in f]
    assert len(opened) == 1 and "file=1" in opened[0]
    assert some.count() == 4
    assert sorted(map(tuple, readers.read_frames(spark, root, frames.schema).collect())) == sorted(map(tuple, frames.collect()))


def test_foreign_files_and_templates(spark, tmp_path):
    folder = tmp_path / "data" / "chunk-000"
    folder.mkdir(parents=True)
    for e in (0, 1):
        pq.write_table(pa.table({"episode_index": [e] * 3, "frame_index": [0, 1, 2]}), folder / f"episode_{e:06d}.parquet")
    assert readers.read_frames(spark, str(tmp_path)).count() == 6
    legacy = "data/chunk-{episode_chunk:03d}/episode_{episode_index:06d}.parquet"
    chosen = spark.createDataFrame([(1,)], "episode_index long")
    some = readers.read_episode_frames(spark, str(tmp_path), chosen, data_path=legacy)
    assert [f.rsplit("/", 1)[1] for f in some.inputFiles()] == ["episode_000001.parquet"]
    assert some.count() == 3
    with pytest.raises(ValueError, match="unknown field"):
        readers.data_files(chosen, "data/{episode_index.__class__}.parquet")


def test_damaged_curve_documents_are_told_as_entries_are(spark, tmp_path):
    entries = [
        {"episode_id": 1, "frame_indices": [3, 4], "values": [0.5, -1e-3]},
        {"episode_id": 2, "frame_indices": [3, 3], "values": [0.5, 1]},
        {"episode_id": 3, "frame_indices": [3, 4.5], "values": [0.5, 1]},
        {"episode_id": 4, "frame_indices": [3], "values": [0.5, 1]},
        {"episode_id": 5, "frame_indices": [], "values": []},
        {"episode_id": 6, "values": [1.0]},
        {"episode_id": "x", "frame_indices": [1], "values": [1.0]},
        {"episode_id": 8, "frame_indices": [1], "values": [None]},
        {"episode_id": 9, "frame_indices": [1], "values": [1.0], "other": {"values": [1, 2]}},
        {"episode_id": 9, "frame_indices": [2], "values": [2.0]},
    ]
    split = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "400")
    try:
        path = tmp_path / "curves.json"
        path.write_text(json.dumps({"curves": entries, "metrics": {"mse": 1, "values": [3]}, "episode_curves": entries}, indent=1))
        want = sorted(map(tuple, readers.curve_entry_problems(readers.read_curve_entries(spark, str(path))).collect()), key=str)
        cells = readers.stored(readers.curve_cells(spark, str(path)))
        got = sorted(map(tuple, readers.curve_cell_problems(cells).collect()), key=str)
        assert got == want and len(got) == 8
        path.write_text(json.dumps(entries[0]))
        assert sorted(map(tuple, readers.read_curves(spark, str(path)).collect())) == [(1, 3, 0.5), (1, 4, -0.001)]
        path.write_text(json.dumps(entries)[:-4])
        with pytest.raises(integrity.IntegrityError):
            readers.read_curves(spark, str(path))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)


def test_of_racing_writers_one_wins(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor
    from threading import Barrier

    from epistride.sources import publish

    ready = Barrier(4)

    def write(number):
        def fill(root):
            spark.range(number, number + 1).write.parquet(root)
            ready.wait()  # all have written before any gives the name

        try:
            publish.published(spark, str(tmp_path / "out"), fill)
        except FileExistsError:
            return None
        return number

    with ThreadPoolExecutor(4) as pool:
        won = [n for n in pool.map(write, range(4)) if n is not None]
    assert len(won) == 1
    assert [r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()] == won
    assert not (tmp_path / "out.claim").exists() and not list((tmp_path / "out").glob("out.staged*"))


def test_appends_that_are_repeated_stand_once(spark, tmp_path):
    log = str(tmp_path / "log")
    rows = spark.createDataFrame([(1, 1, 0.5), (1, 2, float("nan")), (2, 1, 0.25)], "run int, epoch int, mse double")
    for part in ("run = 1 and epoch = 1", "run = 1 and epoch = 1", "run = 2", "epoch = 2"):
        writers.append_log(rows.where(part), log, ["run", "epoch"])
    got = spark.read.schema("run int, epoch int, mse double").json(log).collect()
    assert sorted((r.run, r.epoch, r.mse) for r in got if r.mse) == [(1, 1, 0.5), (2, 1, 0.25)] and len(got) == 3

import random

import pytest
from pyspark.sql import functions as F

from epistride.operators import normalise, splits, windows
from tests.test_returns import frames_of


@pytest.mark.parametrize("block", [3, 4, 7, 1000])
def test_windows_at_every_block_size(spark, block):
    lengths = {0: 3, 1: 4, 2: 60, 3: 1, 5: 9}
    frames = frames_of(spark, lengths)
    made = windows.history_windows(frames, 3, ["task_index"], block_rows=block)
    got = {(r.episode_id, r.start_frame): [s.frame for s in r.steps] for r in made.collect()}
    want = {(e, s): list(range(s, s + 4)) for e, n in lengths.items() for s in range(n - 3)}
    assert got == want
    assert windows.window_starts(frames, 3).count() == len(want) == sum(max(0, n - 3) for n in lengths.values())


def test_one_window_and_its_endpoint(spark):
    frames = frames_of(spark, {0: 4, 1: 3})
    made = windows.split_window(windows.history_windows(frames, 3, ["task_index"]), 3, ["task_index"], ["task_index"])
    row = made.collect()[0]
    assert made.count() == 1
    assert row.sample_id == "0:0" and row.frame_indices == [0, 1, 2] and len(row.next_task_index) == 3
    assert [r.frame_index for r in windows.endpoint_frames(frames, 3).collect()] == [2]


def test_endpoint_follows_the_mask(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0], [True, True, False])], "v array<double>, ok array<boolean>")
    assert df.select(windows.endpoint(F.col("v"), F.col("ok"))).collect()[0][0] == 2.0


def test_window_problems(spark):
    rows = [(0, 0, 0, 1.0), (0, 1, 0, float("nan")), (0, 3, 1, 1.0)]
    df = spark.createDataFrame(rows, "episode_index long, frame_index long, task_index long, x double")
    assert windows.history_windows(df, 2, ["task_index", "x"]).count() == 0
    made = windows.history_windows(df, 2, ["task_index", "x"], over_gaps=True)
    found = windows.window_problems(made, "task_index", ["x"]).collect()
    assert sorted(r.problem for r in found) == ["frames not consecutive", "task changes", "x not finite"]


def test_batches_and_epochs(spark):
    frames = frames_of(spark, {e: 5 + e for e in range(6)})
    numbered = windows.window_numbers(frames, 2, blocks=3)
    assert sorted(r["rank"] for r in numbered.collect()) == list(range(1, numbered.count() + 1))
    total = numbered.count()
    assert windows.batches(numbered, 4, True).count() == total // 4 * 4
    assert windows.batches(numbered, 4, False).count() == total
    one, two = (
        [r.sample_id for r in windows.epoch_order(numbered.select("sample_id"), 1, e).orderBy("rank").collect()] for e in (0, 1)
    )
    assert sorted(one) == sorted(two) and one != two


@pytest.mark.parametrize("count, fraction, held", [(1, 0.5, 0), (25, 0.1, 2), (10, 0.0, 0), (3, 0.01, 1), (4, 0.99, 3), (35, 0.1, 4)])
def test_split_sizes(spark, count, fraction, held):
    frames = spark.range(count).select(F.col("id").alias("episode_index"))
    split = splits.seeded_split(frames, fraction, 3).collect()
    assert len(split) == count
    assert sum(r.split == "val" for r in split) == held


def test_split_ignores_order_and_repeats(spark):
    ids = list(range(40)) * 2
    random.Random(1).shuffle(ids)
    one = splits.seeded_split(spark.createDataFrame([(i,) for i in ids], "episode_index long"), 0.3, 5)
    two = splits.seeded_split(spark.range(40).select(F.col("id").alias("episode_index")), 0.3, 5)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))
    assert splits.split_overlap(one).count() == 0


def test_normalisation_uses_only_finite_training_rows(spark):
    rows = [(0, [1.0, 5.0]), (0, [3.0, 5.0]), (0, [float("inf"), 0.0]), (1, [100.0, 100.0])]
    df = spark.createDataFrame(rows, "episode_index long, action array<float>")
    split = spark.createDataFrame([(0, "train"), (1, "val")], "episode_index long, split string")
    stats = normalise.fit_normalisation(df, split)
    row = stats.collect()[0]
    assert row["mean"] == [2.0, 5.0]
    assert row["std"] == pytest.approx([1.0, 1e-6])
    scaled = normalise.apply_normalisation(df.limit(1), stats).collect()[0]
    assert scaled.action == pytest.approx([-1.0, 0.0])
    assert normalise.statistics_problems(stats, 2).count() == 0
    assert [r.problem for r in normalise.statistics_problems(stats, 3).collect()] == ["dimension"]


def test_carried_targets_stand_beside_scores_unseen(spark):
    import pandas as pd

    from epistride.operators import scoring

    windows_df = spark.createDataFrame([(1, "1:0", [0, 1], [1.0, 2.0], [0.5, 0.25])], "episode_id long, sample_id string, frame_indices array<long>, x array<double>, target array<double>")

    def scorer(batch):
        assert "target" not in batch.columns
        return pd.DataFrame({"episode_id": batch["episode_id"], "sample_id": batch["sample_id"], "frame_indices": batch["frame_indices"], "value": [[3.0, 4.0]]})

    scored = scoring.score_windows(windows_df, scorer, "episode_id long, sample_id string, frame_indices array<long>, value array<double>", ["x"], ["target"])
    rows = scoring.scored_positions(scored, carried=["target"]).collect()
    assert sorted((r.frame_index, r.value, r.target) for r in rows) == [(0, 3.0, 0.5), (1, 4.0, 0.25)]

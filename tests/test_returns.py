import pytest

from epistride.operators import integrity, labels, returns


def frames_of(spark, lengths, task=None):
    rows = [(e, f, (task or {}).get(e, 0)) for e, n in lengths.items() for f in range(n)]
    return spark.createDataFrame(rows, "episode_index long, frame_index long, task_index long")


def labels_of(spark, outcome):
    return spark.createDataFrame(list(outcome.items()), "episode_index long, success boolean")


def column(df, name, episode):
    return [r[name] for r in df.where(f"episode_index = {episode}").orderBy("frame_index").collect()]


def test_success_of_three_frames(spark):
    made = returns.with_returns(frames_of(spark, {0: 3}), labels_of(spark, {0: True}), "none")
    assert column(made, "return_raw", 0) == [-2.0, -1.0, 0.0]
    assert column(made, "return", 0) == [-2.0, -1.0, 0.0]


def test_failure_with_the_default_penalty_is_minus_one_throughout(spark):
    made = returns.with_returns(frames_of(spark, {0: 4, 1: 6}), labels_of(spark, {0: False, 1: True}))
    assert column(made, "return", 0) == [-1.0] * 4
    assert column(made, "return_raw", 0) == [-9.0, -8.0, -7.0, -6.0]
    assert column(made, "return", 1)[-1] == 0.0


def test_longest_episode_counts_per_task(spark):
    made = returns.with_returns(
        frames_of(spark, {0: 2, 1: 10}, {0: 0, 1: 1}), labels_of(spark, {0: True, 1: True})
    )
    assert column(made, "return", 0) == [-0.5, 0.0]


def test_frames_may_start_anywhere(spark):
    rows = spark.createDataFrame([(0, 5 + i, 0) for i in range(3)], "episode_index long, frame_index long, task_index long")
    made = returns.with_returns(rows, labels_of(spark, {0: True}), "none")
    assert column(made, "return_raw", 0) == [-2.0, -1.0, 0.0]


def test_step_scale_and_penalty(spark):
    made = returns.with_returns(frames_of(spark, {0: 3}), labels_of(spark, {0: False}), "none", 7.0, 2.0)
    assert column(made, "return_raw", 0) == [-11.0, -9.0, -7.0]


def test_global_range(spark):
    made = returns.with_returns(frames_of(spark, {0: 3, 1: 2}), labels_of(spark, {0: True, 1: False}), "global_minmax")
    # raw: [-2,-1,0] and [-4,-3]
    assert column(made, "return", 0) == pytest.approx([0.0, 0.5, 1.0])
    assert column(made, "return", 1) == pytest.approx([-1.0, -0.5])


def test_collapsed_range_gives_zeros(spark):
    made = returns.with_returns(frames_of(spark, {0: 1, 1: 1}), labels_of(spark, {0: True, 1: True}), "global_minmax")
    assert column(made, "return", 0) == [0.0]


@pytest.mark.parametrize("bad", [{"step_scale": 0.0}, {"failure_penalty": -1.0}, {"normalisation": "other"}])
def test_arguments_are_checked(spark, bad):
    with pytest.raises(ValueError):
        returns.with_returns(frames_of(spark, {0: 1}), labels_of(spark, {0: True}), **bad)


def test_success_column_precedence():
    assert labels.success_column(["success", "next.success"]) == "next.success"
    assert labels.success_column(["a"]) is None
    with pytest.raises(KeyError):
        labels.success_column(["a"], "b")


@pytest.mark.parametrize("how, want", [("last", [False, True, True]), ("any", [True, True, True]), ("constant", [None, True, None])])
def test_reductions(spark, how, want):
    rows = [(0, 0, 1.0), (0, 1, 0.0), (1, 0, 1.0), (1, 1, 1.0), (2, 1, 1.0), (2, 0, 0.0)]
    df = spark.createDataFrame(rows, "episode_index long, frame_index long, s double")
    got = labels.reduce_success(df, "s", how).orderBy("episode_index").collect()
    assert [r.success for r in got] == want


def test_other_numbers_are_no_labels(spark):
    rows = [(0, 0, 0.5), (0, 1, 1.0), (1, 0, float("nan"))]
    df = spark.createDataFrame(rows, "episode_index long, frame_index long, s double")
    assert [r.success for r in labels.reduce_success(df, "s", "any").collect()] == [None, None]


def test_label_problems_name_every_kind(spark, rows):
    frames = frames_of(spark, {0: 1, 1: 1, 2: 1})
    given = spark.createDataFrame([(0, True), (2, None), (9, True)], "episode_index long, success boolean")
    assert rows(labels.label_problems(frames, given)) == [(1, "missing label"), (2, "not a boolean"), (9, "unknown episode")]
    with pytest.raises(integrity.IntegrityError, match="missing label"):
        integrity.require_none(labels.label_problems(frames, given), "labels", ["episode_index", "problem"])


def test_integrity_checks_on_a_damaged_table(spark, rows):
    data = [(0, 0, 0), (1, 0, 1), (2, 1, 0), (3, 0, 2), (4, 1, 2), (5, 1, 2)]
    df = spark.createDataFrame(data, "index long, episode_index long, frame_index long")
    assert rows(integrity.scattered_episodes(df, block_rows=2)) == [(0, 2, 3), (1, 2, 3)]
    assert rows(integrity.broken_steps(df, block_rows=2)) == [(1, 4, 2, 0), (1, 5, 2, 2)]
    assert rows(integrity.duplicate_keys(df, ["episode_index", "frame_index"])) == [(1, 2, 2)]
    assert [r[0] for r in rows(integrity.uneven_episodes(df))] == [1]

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from epistride.operators import isotropy, metrics, statistics


def points(spark, rows):
    return spark.createDataFrame(rows, "episode_id long, frame_index long, value double, `return` double")


def test_metrics_against_numpy(spark):
    rng = np.random.default_rng(1)
    p, t = rng.normal(size=50), rng.normal(size=50)
    df = points(spark, [(0, i, float(a), float(b)) for i, (a, b) in enumerate(zip(p, t))])
    row = metrics.regression_metrics(df, F.col("value"), F.col("return")).collect()[0]
    assert row["count"] == 50
    assert row.mse == pytest.approx(np.mean((p - t) ** 2))
    assert row.pearson == pytest.approx(np.corrcoef(p, t)[0, 1])
    curve = metrics.curve_metrics(df).collect()[0]
    assert curve.value_pearson == pytest.approx(np.corrcoef(p, t)[0, 1])
    assert curve.value_rmse == pytest.approx(math.sqrt(np.mean((p - t) ** 2)))


def test_pearson_is_null_without_variation(spark):
    df = points(spark, [(0, 0, 1.0, 2.0), (1, 0, 1.0, 2.0), (1, 1, 1.0, 3.0)])
    got = {r.episode_id: r for r in metrics.curve_metrics(df).collect()}
    assert got[0].value_pearson is None and got[1].value_pearson is None
    flat = metrics.regression_metrics(df, F.col("value"), F.col("return"), by=["episode_id"]).collect()
    assert all(r.pearson is None for r in flat)


def test_no_rows_give_count_zero(spark):
    row = metrics.regression_metrics(points(spark, []), F.col("value"), F.col("return")).collect()[0]
    assert row["count"] == 0 and row.mse is None and row.pearson is None


def test_masked_error_skips_non_finite(spark):
    df = spark.createDataFrame([(1.0, 2.0, True), (float("nan"), 0.0, True), (5.0, 0.0, False)], "p double, t double, m boolean")
    row = metrics.masked_squared_error(df, F.col("p"), F.col("t"), F.col("m")).collect()[0]
    assert (row.squared_sum, row.counted) == (1.0, 1)


def test_best_so_far(spark):
    log = spark.createDataFrame([("a", i, v) for i, v in enumerate([3.0, 4.0, 2.0, float("nan"), 2.0])], "run string, epoch int, value_mse double")
    got = metrics.best_so_far(log).orderBy("epoch").collect()
    assert [r.is_best for r in got] == [True, False, True, False, False]


def test_vector_error_and_losses(spark):
    df = spark.createDataFrame([([1.0, 2.0], [0.0, 0.0]), ([1.0, 1.0], [1.0, 1.0])], "p array<double>, t array<double>")
    row = metrics.vector_mse(df, "p", "t").collect()[0]
    assert (row.elements, row.mse) == (4, 1.25)
    parts = spark.createDataFrame([(4.0, 2, 1.0, 1), (2.0, 1, 0.0, 0)], "a_sum double, a_count long, b_sum double, b_count long")
    loss = metrics.weighted_loss(parts, {"a": 2.0, "b": 3.0}).collect()[0]
    assert (loss.a_loss, loss.b_loss, loss.loss) == (2.0, 1.0, 7.0)


def test_statistics_merge(spark):
    rng = np.random.default_rng(2)
    rows = [(int(e), [float(x), float(y)], float(x)) for e, x, y in zip(rng.integers(0, 4, 80), rng.normal(3, 2, 80), rng.normal(size=80))]
    df = spark.createDataFrame(rows, "episode_index long, v array<double>, s double")
    parts = statistics.episode_statistics(df)
    whole = statistics.feature_statistics(df, ["v", "s"])
    assert statistics.rollup_differences(parts, whole).count() == 0
    shifted = whole.withColumn("mean", F.when(F.col("feature") == "s", F.col("mean") + 0.1).otherwise(F.col("mean")))
    assert [r.feature for r in statistics.rollup_differences(parts, shifted).collect()] == ["s"]
    lines = statistics.as_episode_lines(parts)
    assert statistics.from_episode_lines(lines).count() == parts.count()


def test_inferred_features(spark):
    df = spark.createDataFrame([(1, [[1.0, 2.0]], [1]), (2, [[3.0, 4.0]], [1, 2])], "a int, m array<array<float>>, r array<long>")
    got = {r.feature: r for r in statistics.inferred_features(df).collect()}
    assert (got["a"].dtype, got["a"]["shape"]) == ("int32", [1])
    assert (got["m"].dtype, got["m"]["shape"], got["m"].fixed) == ("float32", [1, 2], True)
    assert not got["r"].fixed
    assert [r.feature for r in statistics.ragged_features(df).collect()] == ["r"]


def test_isotropy_against_numpy(spark):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(60, 5))
    df = spark.createDataFrame([(i % 2, [float(x) for x in v]) for i, v in enumerate(vectors)], "g long, v array<double>").repartition(4)
    projections = isotropy.unit_projections(5, 7, 1)
    assert np.allclose(np.linalg.norm(projections, axis=0), 1)
    total = []
    for g in (0, 1):
        angles = (vectors[g::2] @ projections)[:, :, None] * np.linspace(0, 3, 17)
        target = np.exp(-np.linspace(0, 3, 17) ** 2 / 2)
        weight = np.full(17, 2 * 3 / 16)
        weight[[0, -1]] = 3 / 16
        error = (np.cos(angles).mean(0) - target) ** 2 + np.sin(angles).mean(0) ** 2
        total.append((error @ (weight * target)) * 30)
    got = isotropy.isotropy(df, "v", projections, by=["g"]).collect()[0][0]
    assert got == pytest.approx(np.mean(total))


@pytest.mark.parametrize("offset", [0.0, 1e9])
def test_statistics_far_from_zero_merge_without_loss(spark, offset):
    rng = np.random.default_rng(4)
    values = np.round(rng.normal(0, 300, 500), 3) + offset
    rows = [(i % 7, float(v), offset) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "episode_index long, v double, same double")
    parts, whole = statistics.episode_statistics(df), statistics.feature_statistics(df, ["v", "same"])
    merged = {r.feature: r for r in statistics.merge_statistics(parts).collect()}
    assert merged["v"].std == pytest.approx(np.std(values), rel=1e-9)
    assert merged["same"].std == pytest.approx(0, abs=offset * 1e-14)
    assert statistics.rollup_differences(parts, whole).count() == 0
    for factor in (1.001, 0.999):
        damaged = whole.withColumn("std", F.when(F.col("feature") == "v", F.col("std") * factor).otherwise(F.col("std")))
        assert [r.feature for r in statistics.rollup_differences(parts, damaged).collect()] == ["v"]


def test_parts_without_values(spark):
    df = spark.createDataFrame([(1, 1.0, None), (1, 3.0, None), (2, None, None)], "episode_index long, a double, b double")
    parts, whole = statistics.episode_statistics(df), statistics.feature_statistics(df, ["a", "b"])
    assert statistics.rollup_differences(parts, whole).count() == 0
    lost = whole.where(F.col("feature") == "a")
    assert [r.feature for r in statistics.rollup_differences(parts, lost).collect()] == ["b"]


@pytest.mark.parametrize("offset", [0.0, 1e8])
def test_states_merge_to_the_whole(spark, offset):
    rng = np.random.default_rng(6)
    p = rng.normal(size=400) + offset
    t = 0.3 * (p - offset) + rng.normal(size=400) + offset
    rows = [(i % 2, i % 5 if i < 390 else 9, float(a), float(b)) for i, (a, b) in enumerate(zip(p, t))]
    df = spark.createDataFrame(rows, "g int, part int, p double, t double")
    merged = metrics.merge_states(metrics.metric_state(df, F.col("p"), F.col("t"), ["g", "part"]), ["g"])
    for r in metrics.metrics_of(merged, ["g"]).collect():
        assert r.pearson == pytest.approx(np.corrcoef(p[r.g::2], t[r.g::2])[0, 1], rel=1e-6)
        assert r["count"] == 200
    everything = metrics.metrics_of(metrics.merge_states(metrics.metric_state(df, F.col("p"), F.col("t"), ["part"]))).collect()[0]
    assert everything.pearson == pytest.approx(np.corrcoef(p, t)[0, 1], rel=1e-6)


def test_no_state_and_no_variation(spark):
    df = spark.createDataFrame([(0.1, 1.0), (0.1, 2.0), (0.1, 4.0)], "p double, t double")
    assert metrics.regression_metrics(df, F.col("p"), F.col("t")).collect()[0].pearson is None
    empty = metrics.metric_state(df.where("p > 1"), F.col("p"), F.col("t"))
    assert metrics.metrics_of(empty).collect()[0]["count"] == 0
    merged = metrics.metrics_of(metrics.merge_states(empty)).collect()
    assert [r["count"] for r in merged] == [0]


def test_features_of_lines_that_disagree(spark):
    lines = ['{"a": 1, "b": [1, 2], "c": "x", "d": null, "e": [[1, 2], [3, 4]]}', '{"a": 1.5, "b": [1, 2], "c": 1, "d": true, "e": [[1], [2.5]], "f": {"x": 1}}', "[1]", "no json", None]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    got = {r.feature: (r.dtype, list(r["shape"]), r.fixed, r.depth, r["rows"], r.missing, r.conflict) for r in statistics.line_features(df).collect()}
    assert got == {
        "a": ("float64", [1], True, 0, 2, 0, False),
        "b": ("int64", [2], True, 1, 2, 0, False),
        "c": (None, [1], True, 0, 2, 0, True),
        "d": ("bool", [1], True, 0, 2, 0, False),
        "e": ("float64", [2, 2], False, 2, 2, 0, False),
        "f": ("struct", [1], True, 0, 1, 1, False),
    }
    assert statistics.line_features(df.limit(0)).count() == 0

import pytest
from pyspark.sql import functions as F

from epistride.operators import permutation, windows
from tests.test_returns import frames_of


@pytest.mark.parametrize("size", [1, 2, 3, 5, 17, 64, 65, 1000])
def test_order_is_a_bijection_and_undone(spark, size):
    places = permutation.place_of(F.col("id"), size, 7, 2)
    rows = spark.range(size).select("id", places.alias("place")).select("id", "place", permutation.number_at(F.col("place"), size, 7, 2).alias("back")).collect()
    assert sorted(r.place for r in rows) == list(range(size))
    assert all(r.back == r.id for r in rows)


def test_seeds_and_epochs_give_other_orders(spark):
    size = 4000
    order = lambda seed, epoch: [r[0] for r in spark.range(size).orderBy(permutation.place_of(F.col("id"), size, seed, epoch)).collect()]
    first = order(1, 0)
    assert first == order(1, 0) != order(1, 1) != order(2, 0)
    # Neighbours do not stay together, and the order has no drift.
    assert sum(abs(a - b) == 1 for a, b in zip(first, first[1:])) < 20
    assert abs(sum(first[: size // 2]) / (size // 2) - size / 2) < 120


def test_batches_are_found_without_the_order(spark):
    frames = frames_of(spark, {0: 9, 3: 1, 4: 30, 7: 12})
    total = windows.total_windows(frames, 3).first()[0]
    order = permutation.shuffled(windows.window_numbers(frames, 3), total, 5, 1)
    wanted = sorted(map(tuple, order.select("episode_id", "start_frame", "sample_id", "rank").collect()), key=lambda r: r[3])
    assert [r[3] for r in wanted] == list(range(1, total + 1))
    for batch, size in ((0, 8), (2, 10), (4, 10), (9, 10)):
        got = permutation.batch_members(spark, frames, 3, batch, size, 5, 1).collect()
        assert sorted(map(tuple, got), key=lambda r: r[3]) == wanted[batch * size : (batch + 1) * size]


def test_the_order_needs_no_shuffle(spark):
    plan = permutation.shuffled(spark.range(100).select((F.col("id") + 1).alias("rank")), 100, 1, 1)._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Sort" not in plan

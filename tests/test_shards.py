import random

import pytest
from pyspark.sql import functions as F

from epistride.operators import shards


def greedy(lengths, cap):
    shard, used, out = 0, 0, []
    for n in lengths:
        if used and used + n > cap:
            shard, used = shard + 1, 0
        used += n
        out.append(shard)
    return out


def episodes_of(spark, lengths):
    return spark.createDataFrame(list(enumerate(lengths)), "episode_index long, length long")


@pytest.mark.parametrize("seed, cap, levels", [(1, 10, 2), (2, 7, 2), (3, 50, 64), (4, 3, 3), (5, 1, 2)])
def test_greedy_shards(spark, seed, cap, levels):
    rnd = random.Random(seed)
    lengths = [rnd.choice([1, 2, 3, 5, cap, cap + 4, 9 * cap]) if rnd.random() < 0.3 else rnd.randint(1, 6) for _ in range(400)]
    made = shards.episode_shards(episodes_of(spark, lengths), cap, blocks=7, level_blocks=levels)
    got = [r.shard for r in made.orderBy("episode_index").collect()]
    assert got == greedy(lengths, cap)
    ranges = shards.shard_ranges(made).orderBy("shard").collect()
    assert [r.frame_start for r in ranges[1:]] == [r.frame_end for r in ranges[:-1]]
    assert all(r.frame_end - r.frame_start <= cap or r.episode_end - r.episode_start == 1 for r in ranges)


def test_equal_lengths_and_single_episode(spark):
    for lengths, cap in (([5] * 100, 12), ([1] * 60, 4), ([7], 3), ([3, 3], 6)):
        made = shards.episode_shards(episodes_of(spark, lengths), cap, level_blocks=2)
        assert [r.shard for r in made.orderBy("episode_index").collect()] == greedy(lengths, cap)


def test_flat_layout_round_trip(spark):
    lengths = [3, 1, 40, 2]
    episodes = shards.episode_offsets(episodes_of(spark, lengths), 2)
    assert [r.offset for r in episodes.orderBy("episode_index").collect()] == [0, 3, 4, 44]
    frames = shards.frames_of_episodes(episodes, fps=10.0, block_rows=7)
    assert frames.count() == 46
    placed = shards.locate_rows(frames.select("index"), episodes, block_rows=9)
    joined = placed.join(frames, ["index", "episode_index", "frame_index"])
    assert joined.count() == 46
    beyond = spark.createDataFrame([(46,), (100,)], "index long")
    assert shards.locate_rows(beyond, episodes, block_rows=9).count() == 0


def test_layout_problems(spark, rows):
    df = spark.createDataFrame([(0, 2, 0, 1), (1, 3, 2, 2), (2, 1, 9, 0)], "episode_index long, length long, ep_offset long, ep_success long")
    total = spark.range(7).agg(F.count(F.lit(1)))
    assert rows(shards.layout_problems(df, total)) == [(1, "success"), (2, "offset"), (None, "frame count")]


def test_first_seen_ids(spark):
    df = spark.createDataFrame([("b", 5), ("a", 7), ("b", 900), ("c", 6)], "task string, index long")
    got = {r.task: r.task_index for r in shards.first_seen_ids(df, "task", block_rows=2).collect()}
    assert got == {"b": 0, "c": 1, "a": 2}

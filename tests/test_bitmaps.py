import random
from collections import Counter, defaultdict

import pytest

from epistride.operators import bitmaps, integrity


@pytest.mark.parametrize("seed", [1, 2])
def test_against_sets(spark, rows, seed):
    rng = random.Random(seed)
    made = [(e, rng.choice([rng.randint(-200, 200), rng.randint(0, 70), None, 10**12 + rng.randint(0, 3)])) for e in range(6) for _ in range(rng.randint(1, 120))]
    made += [(9, n) for n in range(-70, 300)]
    df = spark.createDataFrame(made, "episode_index long, frame_index long").selectExpr("*", "'x' AS word", "'x' AS bits").repartition(5)
    held, all_rows = defaultdict(list), Counter(e for e, _ in made)
    for e, n in made:
        if n is not None:
            held[e].append(n)
    assert rows(bitmaps.number_sets(df, ["episode_index"], "frame_index")) == sorted(
        ((e, all_rows[e], len(set(ns)), min(ns), max(ns)) for e, ns in held.items()), key=repr
    )
    assert rows(bitmaps.repeated_numbers(df, ["episode_index"], "frame_index")) == sorted(
        ((e, n, k) for e, ns in held.items() for n, k in Counter(ns).items() if k > 1), key=repr
    )
    want = [(e, a, b) for e, ns in held.items() for a, b in zip(sorted(set(ns)), sorted(set(ns))[1:]) if b - a > 1]
    assert rows(bitmaps.step_gaps(df)) == sorted(want, key=repr)
    other = df.where("episode_index % 2 = 0")
    lost = {n for ns in held.values() for n in ns} - {n for e, ns in held.items() if e % 2 == 0 for n in ns}
    assert rows(bitmaps.missing_numbers(df, other, "frame_index")) == sorted(((n,) for n in lost), key=repr)
    broken = {r.episode_index for r in integrity.uneven_episodes(df).collect()}
    assert broken == {e for e, ns in held.items() if all_rows[e] != len(set(ns)) or max(ns) - min(ns) + 1 != len(set(ns))} and 9 not in broken


def test_nothing_and_only_nulls(spark):
    empty = spark.createDataFrame([], "episode_index long, frame_index long")
    assert bitmaps.step_gaps(empty).count() == 0 and bitmaps.missing_numbers(empty, empty, "frame_index").count() == 0
    assert [tuple(r) for r in integrity.zero_based(empty).collect()] == [(0, None, None, False)]
    nulls = spark.createDataFrame([(1, None), (1, None)], "episode_index long, frame_index long")
    assert integrity.uneven_episodes(nulls).count() == 1
    assert bitmaps.repeated_numbers(nulls, ["episode_index"], "frame_index").count() == 0


def test_a_dense_range_leaves_a_group_for_64_numbers(spark):
    df = spark.range(0, 64 * 500, 1, 4).selectExpr("0L AS episode_index", "id AS frame_index")
    assert bitmaps.words(df, ["episode_index"], "frame_index").count() == 500

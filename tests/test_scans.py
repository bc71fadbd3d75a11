"""Blocked scans against plain loops, with one key holding most rows."""

import random

import pytest
from pyspark.sql import functions as F

from epistride.operators import scans


def hot_rows(seed, keys=6, hot=200):
    rnd = random.Random(seed)
    made = []
    for key in range(keys):
        size = hot if key == 1 else rnd.randint(1, 9)
        frame = rnd.randint(0, 20)
        for _ in range(size):
            made.append((key, frame, rnd.choice([None, rnd.randint(-50, 50)])))
            frame += rnd.choice([1, 1, 1, 2, 9])
    rnd.shuffle(made)
    return made


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("block", [1, 7, 10_000])
def test_all_kinds_match_a_loop(spark, seed, block):
    data = hot_rows(seed)
    df = spark.createDataFrame(data, "k long, fr long, v long")
    out = scans.blocked_scan(
        df,
        ["k"],
        scans.position_block(F.col("fr"), block),
        ["fr"],
        {
            "total": scans.running_sum(F.col("v")),
            "before": scans.running_sum(F.col("v"), exclusive=True),
            "seen": scans.running_count(F.col("v")),
            "low": scans.running_min(F.col("v")),
            "last": scans.latest(F.col("v")),
            "prev": scans.previous(F.col("fr")),
            "next": scans.following(F.col("fr")),
            "top": scans.overall_max(F.col("v")),
        },
    )
    have = {(r.k, r.fr): r for r in out.collect()}
    assert len(have) == len(data)
    for key in {k for k, _, _ in data}:
        ordered = sorted(((fr, v) for k, fr, v in data if k == key), key=lambda x: x[0])
        total, seen, low, last, prev = 0, 0, None, None, None
        top = max((v for _, v in ordered if v is not None), default=None)
        for i, (fr, v) in enumerate(ordered):
            row = have[(key, fr)]
            assert row.before == total and row.prev == prev
            if v is not None:
                total, seen, last = total + v, seen + 1, v
                low = v if low is None else min(low, v)
            assert (row.total, row.seen, row.low, row.last, row.top) == (total, seen, low, last, top)
            assert row.next == (ordered[i + 1][0] if i + 1 < len(ordered) else None)
            prev = fr


@pytest.mark.parametrize("ranges", [1, 8, 300])
def test_number_rows_splits_hot_keys(spark, ranges):
    rnd = random.Random(3)
    data = [(1 if rnd.random() < 0.6 else rnd.randint(2, 30), rnd.randint(0, 500) ** 2, i) for i in range(1500)]
    df = spark.createDataFrame(data, "k long, at long, id long")
    out = scans.number_rows(df, ["k"], "at", ["id"], "n", ranges=ranges)
    assert sorted(out.columns) == ["at", "id", "k", "n"]
    want, sizes = {}, {}
    for k, _, i in sorted(data):
        want[i] = sizes.get(k, 0)
        sizes[k] = want[i] + 1
    assert {r.id: r.n for r in out.collect()} == want


def test_hot_keys_are_spread(spark):
    # Times of the hot key cluster: equal widths would leave nearly all rows in one range.
    data = [(1, i if i < 990 else i**3, i) for i in range(1000)] + [(k, 0, k) for k in range(2, 30)]
    df = spark.createDataFrame(data, "k long, at long, id long")
    blocks = df.withColumn("b", scans.even_blocks(df, F.col("at"), 10)).where("k = 1").groupBy("b").count().collect()
    assert len(blocks) >= 9 and max(r["count"] for r in blocks) < 150
    plan = scans.number_rows(df, ["k"], "at", ["id"], "n", ranges=10)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "__block" in text
    assert plan.where("k = 1").agg(F.max("n")).collect()[0][0] == 999


def test_sparse_ids_fill_few_blocks(spark):
    ids = [i * 10**15 + i % 7 for i in range(500)]
    df = spark.createDataFrame([(i,) for i in ids], "id long")
    sizes = df.groupBy(scans.even_blocks(df, F.col("id"), 8).alias("b")).count().collect()
    assert len(sizes) <= 9 and max(r["count"] for r in sizes) < 130


@pytest.mark.parametrize("gap", [1, 10**15])
def test_join_episodes_over_distant_frames(spark, gap):
    frames = [(e, f * gap) for e in (1, 2) for f in range(5)]
    df = spark.createDataFrame(frames, "e long, f long")
    spans = df.groupBy("e").agg(F.min("f").alias("first_frame"), F.max("f").alias("last_frame"))
    out = scans.join_episodes(df, spans, "e", "f", block_rows=2)
    assert sorted(tuple(r) for r in out.select("e", "f", "__first_frame").collect()) == [(e, f, 0) for e, f in frames]


def test_global_rank_over_blocks(spark):
    ids = random.Random(4).sample(range(10_000), 400)
    df = spark.createDataFrame([(i,) for i in ids], "id long")
    ranked = scans.ordered_rank(df, scans.position_block(F.col("id"), 64), ["id"])
    assert [r.id for r in ranked.orderBy("rank").collect()] == sorted(ids)
    assert sorted(r.rank for r in ranked.collect()) == list(range(1, 401))


def test_hash_rank_is_the_md5_order(spark):
    import hashlib

    df = spark.range(300)
    have = [r.id for r in scans.hash_rank(df, "9", F.col("id"), ["id"]).orderBy("rank").collect()]
    assert have == sorted(range(300), key=lambda i: (hashlib.md5(f"9:{i}".encode()).hexdigest(), i))

import re

from pyspark.sql import functions as F

from epistride.operators import colocated, returns
from epistride.operators.scans import running_sum
from tests.test_returns import frames_of


def test_frames_are_not_shuffled_again(spark):
    frames = frames_of(spark, {0: 30, 1: 2, 5: 400}).withColumn("observed", F.col("frame_index") / 2)
    label = spark.createDataFrame([(0, True), (1, False), (5, True)], "episode_index long, success boolean")
    stored = colocated.stored_by_episode(frames, 8)
    terms = returns.episode_terms(frames, label)
    made = returns.with_returns(stored, label, terms=terms)
    summed = colocated.running_by_episode(made, {"so_far": running_sum(F.col("observed"))})
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = summed._jdf.queryExecution().sparkPlan().toString() and summed._jdf.queryExecution().executedPlan().toString()
        got = {(r.episode_index, r.frame_index): (r["return"], r.so_far) for r in summed.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    want = returns.with_returns(frames, label, terms=terms).collect()
    assert got == {(r.episode_index, r.frame_index): (r["return"], r.frame_index * (r.frame_index + 1) / 4) for r in want}
    # What is exchanged below an exchange of its own never holds the frames' values row by row.
    lines = plan.splitlines()
    for number, line in enumerate(lines):
        if "Exchange" in line:
            below = lines[number + 1]
            assert "observed" not in below or "HashAggregate" in below or "partial" in below, below[:200]
    assert re.search("Bucketed: true", plan)


def test_columns_and_rows_stay(spark):
    frames = frames_of(spark, {0: 3, 2: 5})
    stored = colocated.stored_by_episode(frames, 3)
    assert colocated.plain(stored).columns == frames.columns
    assert sorted(map(tuple, colocated.plain(stored).collect())) == sorted(map(tuple, frames.collect()))

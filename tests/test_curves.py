import bisect
import random

import pytest
from pyspark.sql import functions as F

from epistride.operators import align, curves


def curve_rows(seed=1, episodes=5, hot=150):
    rnd = random.Random(seed)
    made = {}
    for e in range(episodes):
        frame, n = rnd.randint(0, 6), hot if e == 2 else rnd.randint(1, 12)
        made[e] = []
        for _ in range(n):
            made[e].append((frame, rnd.uniform(-1, 0)))
            frame += rnd.choice([1, 1, 1, 3])
    return made


def points_of(spark, made):
    rows = [(e, f, v, 0.0) for e, c in made.items() for f, v in c]
    random.Random(0).shuffle(rows)
    return spark.createDataFrame(rows, "episode_id long, frame_index long, value double, `return` double")


@pytest.mark.parametrize("block", [4, 50_000])
def test_frame_states_match_bisect(spark, block):
    made = curve_rows()
    frames = [(e, f) for e, c in made.items() for f in range(c[-1][0] + 4)] + [(99, 0)]
    df = spark.createDataFrame(frames, "episode_index long, frame_index long")
    got = {(r.episode_id, r.frame_index): r for r in align.frame_states(df, points_of(spark, made), block_rows=block).collect()}
    assert len(got) == len(frames) - 1
    for e, f in frames[:-1]:
        at = [x for x, _ in made[e]]
        seen = bisect.bisect_right(at, f)
        exact = f in at
        status = "warming_up" if not seen else "estimated" if exact else "terminal_hold" if seen == len(at) else "no_estimate"
        row = got[(e, f)]
        assert (row.visible_points, row.exact, row.status) == (seen, exact, status)
        shown = made[e][seen - 1][1] if status in ("estimated", "terminal_hold") else None
        assert row.shown_value == shown


@pytest.mark.parametrize("block", [5, 50_000])
def test_gaps_segments_and_preview(spark, rows, block):
    made = curve_rows(4)
    df = points_of(spark, made)
    want, segments, preview = [], [], []
    for e, c in made.items():
        at = [f for f, _ in c]
        want += [(e, a, b) for a, b in zip(at, at[1:]) if b != a + 1]
        start = at[0]
        for a, b in zip(at, at[1:] + [None]):
            if b != a + 1:
                segments.append((e, start, a, a - start + 1))
                start = b
        preview.append((e, at[len(at) // 2]))
    assert rows(curves.curve_gaps(df, block)) == sorted(want, key=repr)
    assert rows(curves.curve_segments(df, block)) == sorted(segments, key=repr)
    assert rows(curves.preview_points(df, block).select("episode_id", "frame_index")) == sorted(preview, key=repr)


def test_pages_hold_everything(spark):
    made = curve_rows(5)
    pages = curves.assemble_curves(points_of(spark, made), page_frames=16)
    assert pages.agg(F.max(F.size("frame_indices"))).collect()[0][0] <= 16
    back = {(r.episode_id, r.frame_index): r.value for r in curves.explode_curves(pages).collect()}
    assert back == {(e, f): v for e, c in made.items() for f, v in c}


def test_value_domain_is_padded_and_repaired(spark):
    df = spark.createDataFrame([(0, 0, -1.0), (0, 1, 0.0)], "episode_id long, frame_index long, value double")
    row = curves.value_domain(df).collect()[0]
    assert (row.lower, row.upper) == pytest.approx((-1.14, 0.14))
    flat = df.where("frame_index = 1")
    assert tuple(curves.value_domain(flat).collect()[0]) == pytest.approx((-0.0112, 0.0112))
    assert tuple(curves.value_domain(df, low=5.0).collect()[0]) == pytest.approx((5.0, 6.0))
    assert tuple(curves.value_domain(df, high=-7.0).collect()[0]) == pytest.approx((-8.0, -7.0))
    with pytest.raises(ValueError):
        curves.value_domain(df, low=1.0, high=1.0)


def test_requested_episodes_keep_their_order(spark):
    df = points_of(spark, {1: [(0, 0.0)], 4: [(0, 0.0)]})
    asked = curves.requested_episodes(df, [4, 1, 4], limit=1)
    assert [tuple(r) for r in asked.select("episode_id").collect()] == [(4,)]
    assert [r.episode_id for r in curves.absent_episodes(df, curves.requested_episodes(df, [1, 8])).collect()] == [8]


def test_point_problems(spark, rows):
    df = spark.createDataFrame([(0, 1, 1.0), (0, 1, 2.0), (0, 2, float("inf"))], "episode_id long, frame_index long, value double")
    assert rows(curves.point_problems(df, ["value"])) == [(0, 1, "duplicate"), (0, 2, "not finite")]


def test_preflight_and_report(spark):
    good = [(f, -0.5) for f in range(2, 9)]
    made = {0: good, 1: good[:-2], 2: [x for x in good if x[0] != 5], 3: good, 4: [(2, 0.0), (40, 0.0)]}
    frames = spark.createDataFrame([(e, f) for e in (0, 1, 2, 4) for f in range(10)], "episode_index long, frame_index long")
    sources = align.sources_from_frames(frames, 10.0, 3)
    checked = align.preflight(points_of(spark, made), sources)
    got = {r.episode_id: (r.hard, r.soft, r.notes) for r in checked.collect()}
    assert got[0] == ([], [], [])
    assert got[1] == ([], ["unexpected last frame"], [])
    assert got[2] == ([], ["frame gaps"], [])
    assert got[3][0] == ["no source"]
    assert got[4][0] == ["outside source"]
    report = {r.episode_id: r for r in align.alignment_report(checked, speed=2.0).collect()}
    assert set(report) == {0, 1, 2}
    assert report[0].mapping_verified and not report[1].mapping_verified
    assert (report[0].output_fps, report[0].source_duration_seconds, report[0].warmup_frame_count) == (20.0, 1.0, 2)
    loose = align.preflight(points_of(spark, {0: good}), align.sources_from_frames(frames, 10.0)).collect()[0]
    assert loose.notes == ["first frame unchecked"]

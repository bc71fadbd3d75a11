import random

import pytest

from epistride.operators import checksums

SCHEMA = "episode_index long, frame_index long, v double, s string"


def plain(want, have):
    """Keys of rows that one side lacks or holds otherwise."""
    a, b = ({r[:2]: r[2:] for r in rows} for rows in (want, have))
    return sorted(((k, a.get(k), b.get(k)) for k in a.keys() | b.keys() if a.get(k) != b.get(k)), key=repr)


@pytest.mark.parametrize("damage", [0, 1, 4])
def test_only_changed_rows_are_told(spark, damage):
    rng = random.Random(damage)
    rows = [(e if e else None, f, rng.choice([None, 0.5, f / 3]), rng.choice([None, "a", ""])) for e in range(4) for f in range(900)]
    have = list(rows)
    for _ in range(damage):
        at = rng.randrange(len(have))
        kind = rng.choice(["lost", "new", "value", "null"])
        if kind == "lost":
            have.pop(at)
        elif kind == "new":
            have.append((9, at, 1.0, "n"))
        else:
            e, f, v, s = have[at]
            have[at] = (e, f, (v or 0.0) + 1.0, s) if kind == "value" else (e, f, 1.0 if s else None, None if s else "a")
    rng.shuffle(have)
    a, b = (spark.createDataFrame(r, SCHEMA).selectExpr("*", "'x' AS block", "'x' AS hash") for r in (rows, have))
    told = checksums.compared_rows(a, b, "episode_index", "frame_index", ["v", "s"], block_rows=64).collect()
    got = [
        ((r[0], r[1]), (r["want.v"], r["want.s"]) if r.in_want else None, (r["have.v"], r["have.s"]) if r.in_have else None) for r in told
    ]
    assert sorted((g for g in got if g[1] != g[2]), key=repr) == plain(rows, have)
    blocks = checksums.differing_blocks(a, b, "episode_index", "frame_index", ["v", "s"], 64)
    assert {tuple(r) for r in blocks.collect()} == {(k[0], k[1] // 64) for k, *_ in plain(rows, have)}
    assert len(told) <= 65 * damage


def test_swapped_values_and_repeated_rows_do_not_cancel(spark):
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA)
    a = [(1, 0, 1.0, None), (1, 1, 2.0, "x")]
    for b in ([(1, 0, 2.0, None), (1, 1, 1.0, "x")], a + a[:1] * 2, a[:1], [(1, 0, 1.0, "x"), (1, 1, 2.0, None)]):
        assert checksums.differing_blocks(frame(a), frame(b), "episode_index", "frame_index", ["v", "s"]).count() == 1
    assert checksums.differing_blocks(frame(a), frame(a[::-1]), "episode_index", "frame_index", ["v", "s"]).count() == 0
    assert checksums.differing_blocks(frame([]), frame([]), "episode_index", "frame_index", ["v"]).count() == 0

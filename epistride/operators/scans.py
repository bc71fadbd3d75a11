"""Ordered running computations that never put one episode into one task.

A window over ``partitionBy(episode)`` sends an episode to a single task, and
one episode may hold a third of all rows.  ``blocked_scan`` cuts each key into
blocks along the order, runs an ordinary window inside every (key, block), and
adds what the earlier blocks contribute from a summary with one row per
(key, block).  The window keeps its (key, block) partitioning, so the summary
is joined without moving the frames again.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epistride.columns import named

BLOCK_ROWS = 65_536

# An episode's row is copied at most this often for the join with its frames.
EPISODE_BLOCKS = 4096

_BLOCK = "__block"

# Tables stored by episode and block (see ``colocated``) carry the block under this name.
STORED_BLOCK = "__frame_block"


@dataclass(frozen=True)
class Running:
    """One running output: what it computes, and over which expression."""

    kind: str
    value: Column
    exclusive: bool = False


def running_sum(value: Column, exclusive: bool = False) -> Running:
    return Running("sum", value, exclusive)


def running_count(value: Column) -> Running:
    """Number of non-null values seen so far, this row included."""
    return Running("sum", F.when(value.isNotNull(), 1).otherwise(0).cast("long"))


def running_min(value: Column, exclusive: bool = False) -> Running:
    return Running("min", value, exclusive)


def latest(value: Column, exclusive: bool = False) -> Running:
    """Last non-null value seen so far; with ``exclusive`` before this row."""
    return Running("latest", value, exclusive)


def previous(value: Column) -> Running:
    """``lag(value)`` for a value that is never null."""
    return latest(value, exclusive=True)


def following(value: Column) -> Running:
    """``lead(value)`` for a value that is never null."""
    return Running("following", value, True)


def overall_max(value: Column) -> Running:
    """Largest value of the whole key, earlier and later rows alike."""
    return Running("overall_max", value)


def position_block(position: Column, rows: int = BLOCK_ROWS) -> Column:
    """Block number of a dense integer position."""
    return F.floor(position / F.lit(rows)).cast("long")


def even_edges(df: DataFrame, position: Column, ranges: int | None = None) -> tuple[int, list[int]]:
    """(rows, edges): places that cut the rows into parts of about equal count.

    As many parts as shuffle partitions unless ``ranges`` says otherwise; only
    the edges come to the driver.  Equal positions stay together.
    """
    parts = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = F.array(*[F.lit(i / parts) for i in range(1, parts)] or [F.lit(0.5)])
    found = F.percentile_approx(position.cast("long"), shares, F.lit(20 * parts))
    row = df.agg(F.count(F.lit(1)).alias("n"), found.alias("edges")).first()
    return row.n, sorted({e for e in row.edges or [] if e is not None})


def edge_block(position: Column, edges: Sequence[int]) -> Column:
    """How many edges are at most ``position``, by halving steps."""
    if not edges:
        return F.lit(0).cast("long")
    listed = F.array(*[F.lit(e).cast("long") for e in edges])

    def step(found: Column, width: Column) -> Column:
        reached = (found + width <= len(edges)) & (F.get(listed, found + width - 1) <= position)
        return F.when(reached, found + width).otherwise(found)

    widths = F.array(*[F.lit(1 << i) for i in reversed(range(len(edges).bit_length()))])
    return F.aggregate(widths, F.lit(0), step).cast("long")


def even_blocks(df: DataFrame, position: Column, ranges: int | None = None) -> Column:
    """Block numbers along ``position``, however far apart the positions lie."""
    return edge_block(position, even_edges(df, position, ranges)[1])


def _local(spec: Running, inside, order) -> Column:
    if spec.kind == "overall_max":
        return F.max(spec.value).over(inside)
    directed = [named(n).desc() if spec.kind == "following" else named(n).asc() for n in order]
    until = -1 if spec.exclusive else 0
    window = inside.orderBy(*directed).rowsBetween(Window.unboundedPreceding, until)
    if spec.kind == "sum":
        return F.sum(spec.value).over(window)
    if spec.kind == "min":
        return F.min(spec.value).over(window)
    return F.last(spec.value, ignorenulls=True).over(window)


def _block_total(spec: Running, order: Column) -> Column:
    if spec.kind == "sum":
        return F.sum(spec.value)
    if spec.kind == "min":
        return F.min(spec.value)
    if spec.kind == "overall_max":
        return F.max(spec.value)
    present = F.when(spec.value.isNotNull(), order)
    if spec.kind == "following":
        return F.min_by(spec.value, present)
    return F.max_by(spec.value, present)


def _carried(spec: Running, total: Column, across) -> Column:
    carried = _local(Running(spec.kind, total, True), across, [_BLOCK])
    if spec.kind == "overall_max":
        return F.when(F.count(F.lit(1)).over(across) > 1, carried)
    return carried


def _merged(spec: Running, local: Column, carried: Column) -> Column:
    if spec.kind == "sum":
        return F.coalesce(local, F.lit(0)) + F.coalesce(carried, F.lit(0))
    if spec.kind == "min":
        return F.least(local, carried)
    if spec.kind == "overall_max":
        return F.greatest(local, carried)
    return F.coalesce(local, carried)


def blocked_scan(
    df: DataFrame,
    keys: Sequence[str],
    block: Column,
    order: Sequence[str],
    outputs: dict[str, Running],
    spanning: Column | None = None,
) -> DataFrame:
    """Add running ``outputs`` along ``order`` within ``keys``.

    ``block`` must never decrease along ``order``.  ``spanning`` marks the rows
    of keys that reach over more than one block; the summary then skips all
    others.  With ``latest`` or ``following`` over numbers, give one numeric
    order column: the summary is then hashed in the scan stage, not sorted.
    """
    keys = list(keys)
    rows = df.withColumn(_BLOCK, block)
    ordering = named(order[0]) if len(order) == 1 else F.struct(*[named(name) for name in order])
    inside = Window.partitionBy(*[named(k) for k in keys], _BLOCK)
    local = rows.withColumns({f"__local_{name}": _local(spec, inside, order) for name, spec in outputs.items()})

    summary = (rows if spanning is None else rows.where(spanning)).groupBy(
        *[named(k) for k in keys], _BLOCK
    ).agg(*[_block_total(spec, ordering).alias(f"__total_{name}") for name, spec in outputs.items()])
    across = Window.partitionBy(*[named(k) for k in keys])
    carried = {
        f"__carry_{name}": _carried(spec, F.col(f"__total_{name}"), across) for name, spec in outputs.items()
    }
    # A key of one block has nothing to carry, so short keys leave no rows.
    carry = summary.withColumns(carried).select(
        *[named(k) for k in keys], _BLOCK, *carried
    ).where(reduce(or_, [F.col(name).isNotNull() for name in carried]))
    merged = local.join(carry, [*keys, _BLOCK], "left")
    return merged.select(
        *[named(name) for name in df.columns],
        *[
            _merged(spec, F.col(f"__local_{name}"), F.col(f"__carry_{name}")).alias(name)
            for name, spec in outputs.items()
        ],
    )


def ordered_rank(
    df: DataFrame, block: Column, order: Sequence[str], name: str = "rank"
) -> DataFrame:
    """1-based rank over the whole table, without a single-task sort."""
    one = F.lit(1).cast("long")
    return blocked_scan(df, [], block, order, {name: running_sum(one)})


def hash_rank(df: DataFrame, salt: str, key: Column, tie: Sequence[str], name: str = "rank") -> DataFrame:
    """Rank rows by ``md5(salt:key)``; the first four hex digits are the block.

    The summary has at most 65,536 rows whatever the table's size.
    """
    hashed = df.withColumn("__hash", F.md5(F.concat_ws(":", F.lit(salt), key.cast("string"))))
    return ordered_rank(hashed, F.substring("__hash", 1, 4), ["__hash", *tie], name).drop("__hash")


def number_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    tie: Sequence[str],
    name: str,
    ranges: int | None = None,
) -> DataFrame:
    """0-based position within ``keys`` along an integer ``order`` column.

    The table is cut along ``order`` into ``ranges`` parts of equal count, by
    default as many as there are shuffle partitions.  A key with more rows
    than such a part is numbered part by part, so no task gets more than about
    one part of it, however its rows cluster.  At most ``ranges`` keys can be
    that large, which bounds the broadcast.
    """
    keys = list(keys)
    rows, edges = even_edges(df, F.col(order), ranges)
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    hot = counts.where(F.col("__n") > rows // (len(edges) + 1)).select(*keys, F.lit(True).alias("__hot"))
    placed = df.join(F.broadcast(hot), keys, "left")
    block = F.when(F.col("__hot"), edge_block(F.col(order), edges)).otherwise(F.lit(0).cast("long"))
    counted = blocked_scan(
        placed,
        keys,
        block,
        [order, *tie],
        {name: running_sum(F.lit(1).cast("long"))},
        spanning=F.col("__hot"),
    )
    return counted.withColumn(name, F.col(name) - 1).drop("__hot")


def spread_join(rows: DataFrame, table: DataFrame, keys: Sequence[str], spread: Sequence[str], how: str = "inner") -> DataFrame:
    """Join rows with a table of one row per key, however many rows a key has.

    Rows are salted by ``spread``; only the (key, salt) pairs that occur, which
    combine map-side, fetch the key's row.  There are as many salts as shuffle
    partitions.  Keys are compared null-safe.
    """
    salts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(*[named(n) for n in spread]), F.lit(salts)))
    same = lambda a, b, names: reduce(and_, [F.col(f"{a}.{_ticked(n)}").eqNullSafe(F.col(f"{b}.{_ticked(n)}")) for n in names])
    pairs = salted.select(*[named(k) for k in keys], "__salt").distinct().alias("p")
    found = pairs.join(table.alias("t"), same("p", "t", keys)).select(
        *[F.col(f"p.{_ticked(k)}") for k in keys], "p.__salt", *[F.col(f"t.{_ticked(n)}") for n in table.columns if n not in keys]
    )
    added = [] if how in ("left_semi", "left_anti") else [F.col(f"f.{_ticked(n)}") for n in table.columns if n not in keys]
    joined = salted.alias("r").join(found.alias("f"), same("r", "f", [*keys, "__salt"]), how)
    return joined.select(*[F.col(f"r.{_ticked(n)}") for n in rows.columns], *added)


def _ticked(name: str) -> str:
    return f"`{name}`"


def join_episodes(
    frames: DataFrame,
    episodes: DataFrame,
    episode: str,
    frame: str,
    first: str = "first_frame",
    last: str = "last_frame",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Inner join of frames with their episode's row, safe for hot episodes.

    An equi-join on the episode alone sends a hot episode to one task, and
    Spark cannot split it when the episode side is an aggregate on that key.
    So the episode side gets one row per block of its frame range and the join
    is on (episode, block); that adds only rows / block_rows rows.  Block numbers
    wrap around at ``EPISODE_BLOCKS``, which bounds the copies where frame numbers
    lie far apart.  ``first`` and ``last`` must span all frames of the episode in
    ``frames``.

    Columns of the episode side come out with ``__`` before their name, so
    they never clash with frame columns.  Frames that are stored by episode
    and block are joined where they lie; only the episode side moves.
    """
    key = STORED_BLOCK if STORED_BLOCK in frames.columns and block_rows == BLOCK_ROWS else _BLOCK
    low, high = position_block(named(first), block_rows), position_block(named(last), block_rows)
    blocks = F.sequence(low, F.least(high, low + (EPISODE_BLOCKS - 1)))
    spread = episodes.select(
        named(episode),
        *[named(n).alias(f"__{n}") for n in episodes.columns if n != episode],
        F.explode(F.transform(blocks, wrapped_block)).alias(key),
    )
    placed = frames if key == STORED_BLOCK else frames.withColumn(key, wrapped_block(position_block(named(frame), block_rows)))
    joined = placed.join(spread, [episode, key])
    return joined if key == STORED_BLOCK else joined.drop(key)


def wrapped_block(block: Column) -> Column:
    return F.pmod(block, F.lit(EPISODE_BLOCKS))

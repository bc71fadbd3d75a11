"""A seeded order of 0..n-1 without sorting.

A Feistel network on pairs (left, right) permutes a rectangle just larger than
n; a number that lands outside is sent through again until it is inside.  Each
number's place follows from the number alone, in constant time, and so does
the number at a place: an epoch's order needs no shuffle, and a batch's
members are found without building the order.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from epistride.columns import COLUMNS, Columns, named
from epistride.operators.scans import blocked_scan, even_blocks, running_sum
from epistride.operators.shards import locate_rows
from epistride.operators.windows import window_counts
from epistride.functions.scalars import sample_id
from epistride.session import stored

ROUNDS = 6
#: Of n numbers less than a share of 1/sqrt(n) lands outside at each pass, so that more passes than this never occur.
WALK = 64


def _sides(size: int) -> tuple[int, int]:
    high = math.isqrt(max(0, size - 1)) + 1
    return high, max(1, -(-size // high))


def _mixed(value: Column, seed: str, number: int) -> Column:
    told = F.concat(F.lit(f"{seed}:{number}:"), value.cast("string"))
    return F.conv(F.substring(F.md5(told), 1, 15), 16, 10).cast("long")


def _network(x: Column, size: int, seed: str, back: bool) -> Column:
    """One pass of the network over ``left * width + right``, or of its inverse."""
    height, width = _sides(size)

    def stepped(pairs: Column, number: int) -> Column:
        sign = -1 if back else 1

        def step(pair: Column) -> Column:
            left, right = pair["l"], pair["r"]
            if number % 2 == 0:
                return F.struct(F.pmod(left + sign * (_mixed(right, seed, number) % height), F.lit(height)).alias("l"), right.alias("r"))
            return F.struct(left.alias("l"), F.pmod(right + sign * (_mixed(left, seed, number) % width), F.lit(width)).alias("r"))

        return F.transform(pairs, step)

    # A one-element array makes each round's pair a variable, so it is computed once.
    pair = F.array(F.struct(F.floor(x / width).cast("long").alias("l"), F.pmod(x, F.lit(width)).cast("long").alias("r")))
    for number in reversed(range(ROUNDS)) if back else range(ROUNDS):
        pair = stepped(pair, number)
    return F.get(F.transform(pair, lambda p: p["l"] * width + p["r"]), F.lit(0))


def _walked(x: Column, size: int, seed: str, back: bool) -> Column:
    once = _network(x.cast("long"), size, seed, back)
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(WALK)), once, lambda at, _: F.when(at >= size, _network(at, size, seed, back)).otherwise(at)
    )


def place_of(number: Column, size: int, seed: int, epoch: int = 0) -> Column:
    """Where ``number`` of 0..size-1 stands in the epoch's order, from 0."""
    return _walked(number, size, f"{seed}:{epoch}", False)


def number_at(place: Column, size: int, seed: int, epoch: int = 0) -> Column:
    """The number that stands at ``place``; undoes ``place_of``."""
    return _walked(place, size, f"{seed}:{epoch}", True)


def shuffled(numbered: DataFrame, size: int, seed: int, epoch: int, rank: str = "rank") -> DataFrame:
    """``numbered`` with its 1-based ``rank`` replaced by that of the epoch's order; a projection."""
    return numbered.withColumn(rank, place_of(named(rank) - 1, size, seed, epoch) + 1)


def batch_members(spark: SparkSession, frames: DataFrame, history: int, batch: int, size: int, seed: int, epoch: int, c: Columns = COLUMNS) -> DataFrame:
    """(episode_id, start_frame, sample_id, rank) of one batch of an epoch.

    Only the batch's own places are turned into window numbers, and only these
    are looked up among the episodes' offsets.
    """
    counted = stored(window_counts(frames, history, c), "episodes")
    offsets = blocked_scan(
        counted, [], even_blocks(counted, named(c.episode)), [c.episode], {"offset": running_sum(F.col("windows"), exclusive=True)}
    ).where("windows > 0")
    total = counted.agg(F.sum("windows")).first()[0] or 0
    places = spark.range(min(batch * size, total), min((batch + 1) * size, total)).select(F.col("id").alias("place"))
    wanted = places.select(number_at(F.col("place"), total, seed, epoch).alias("index"), (F.col("place") + 1).alias("rank"))
    found = locate_rows(wanted, offsets.select(named(c.episode).alias("episode_index"), "offset", F.col("windows").alias("length")))
    first = counted.select(named(c.episode).alias("episode_index"), "first_frame")
    start = F.col("first_frame") + F.col("frame_index")
    placed = found.join(first, "episode_index").withColumn("start_frame", start)
    return placed.select(
        F.col("episode_index").alias("episode_id"), "start_frame", sample_id(F.col("episode_index"), F.col("start_frame")).alias("sample_id"), "rank"
    )

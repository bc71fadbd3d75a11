"""Comparing two versions of a table by checksums of blocks.

A block's checksum does not depend on the order of its rows: their number, the
sum and the exclusive or of their hashes.  It is combined before the shuffle,
so two tables that agree cost one small row for every block, and only the rows
of blocks that differ are brought together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epistride.columns import named
from epistride.session import stored

BLOCK_ROWS = 4_096


def row_hash(columns: Sequence[str]) -> Column:
    """A hash of the named columns, that tells nulls apart too."""
    nulls = F.concat(*[named(n).isNull().cast("string") for n in columns])
    return F.xxhash64(*[named(n) for n in columns], nulls)


def block_checksums(rows: DataFrame, key: str, position: str, values: Sequence[str], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(key, block, rows, total, parity): a block is a range of ``position`` within a key."""
    hashed = rows.select(
        named(key), F.floor(named(position) / block_rows).cast("long").alias("block"), row_hash([position, *values]).alias("hash")
    )
    return hashed.groupBy(named(key), "block").agg(
        F.count(F.lit(1)).alias("rows"),
        # The low half of each hash cannot overflow.
        F.sum(F.col("hash").bitwiseAND(F.lit(0xFFFFFFFF))).alias("total"),
        F.bit_xor("hash").alias("parity"),
    )


def differing_blocks(want: DataFrame, have: DataFrame, key: str, position: str, values: Sequence[str], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(key, block) of the blocks whose checksums differ or that one side lacks."""
    a, b = (block_checksums(df, key, position, values, block_rows).alias(name) for df, name in ((want, "a"), (have, "b")))
    same = F.col(f"a.`{key}`").eqNullSafe(F.col(f"b.`{key}`")) & F.col("a.block").eqNullSafe(F.col("b.block"))
    agree = F.lit(True)
    for name in ("rows", "total", "parity"):
        agree = agree & F.col(f"a.{name}").eqNullSafe(F.col(f"b.{name}"))
    found = a.join(b, same, "full").where(~agree)
    # A block stands on one side at least; null keys and positions are blocks of their own.
    side = lambda name: F.when(F.col("a.rows").isNotNull(), F.col(f"a.{name}")).otherwise(F.col(f"b.{name}"))
    return found.select(side(f"`{key}`").alias(key), side("block").alias("block"))


def compared_rows(want: DataFrame, have: DataFrame, key: str, position: str, values: Sequence[str], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows of both sides in blocks that differ, full-joined on (key, position).

    Columns are ``key``, ``position``, ``want.<value>``, ``have.<value>`` and
    the marks ``in_want`` and ``in_have``.
    """
    blocks = stored(differing_blocks(want, have, key, position, values, block_rows), "differing")
    few = not blocks.isEmpty()

    def side(df: DataFrame, name: str) -> DataFrame:
        if not few:
            kept = df.limit(0)
        else:
            placed = df.withColumn("__block", F.floor(named(position) / block_rows).cast("long")).alias("r")
            same = F.col(f"r.`{key}`").eqNullSafe(F.col(f"d.`{key}`")) & F.col("r.__block").eqNullSafe(F.col("d.block"))
            kept = placed.join(blocks.alias("d"), same, "left_semi")
        return kept.select(named(key), named(position), *[named(v) for v in values], F.lit(True).alias(f"in_{name}")).alias(name)

    a, b = side(want, "want"), side(have, "have")
    same = F.col(f"want.`{key}`").eqNullSafe(F.col(f"have.`{key}`")) & F.col(f"want.`{position}`").eqNullSafe(F.col(f"have.`{position}`"))
    both = lambda name: F.when(F.col("in_want").isNotNull(), F.col(f"want.`{name}`")).otherwise(F.col(f"have.`{name}`")).alias(name)
    told = [F.col(f"{s}.`{v}`").alias(f"{s}.{v}") for s in ("want", "have") for v in values]
    joined = a.join(b, same, "full")
    return joined.select(both(key), both(position), *told, "in_want", "in_have")

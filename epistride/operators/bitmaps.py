"""Sets of whole numbers as 64-bit words.

Checks for repeats, gaps and missing ids need to know which numbers occur, not
one group for each of them.  Numbers are grouped by their word (the number
without its last six bits), and a word's numbers are the bits of one long,
which Spark combines before the shuffle.  A dense range leaves a sixty-fourth
of the groups, whatever the order of the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epistride.columns import COLUMNS, Columns, named
from epistride.operators.scans import blocked_scan, even_blocks, latest

WORD = 64


def word_of(number: Column) -> Column:
    return F.shiftright(number.cast("long"), 6)


def bit_of(number: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), number.cast("long").bitwiseAND(F.lit(WORD - 1)).cast("int"))


def words(rows: DataFrame, keys: Sequence[str], number: str) -> DataFrame:
    """(keys, word, bits, rows, lowest, highest): the numbers of each key and word, and how many rows hold them.

    Rows without a number have a null word and no bits.
    """
    n = named(number)
    return rows.groupBy(*[named(k) for k in keys], word_of(n).alias("word")).agg(
        F.coalesce(F.bit_or(bit_of(n)), F.lit(0).cast("long")).alias("bits"),
        F.count(F.lit(1)).alias("rows"),
        F.min(n).cast("long").alias("lowest"),
        F.max(n).cast("long").alias("highest"),
    )


def numbers_of(word: Column, bits: Column) -> Column:
    """The numbers of a word, in order."""
    at = F.sequence(F.lit(0), F.lit(WORD - 1))
    return F.transform(F.filter(at, lambda i: F.getbit(bits, i) == 1), lambda i: word * WORD + i)


def number_sets(rows: DataFrame, keys: Sequence[str], number: str) -> DataFrame:
    """(keys, length, distinct, first, last) of every key: rows, different numbers, and their range."""
    held = words(rows, keys, number)
    return held.groupBy(*[named(k) for k in keys]).agg(
        F.sum("rows").alias("length"),
        F.sum(F.bit_count("bits")).cast("long").alias("distinct"),
        F.min("lowest").alias("first"),
        F.max("highest").alias("last"),
    )


def repeated_numbers(rows: DataFrame, keys: Sequence[str], number: str) -> DataFrame:
    """(keys, number, row_count) of numbers that occur more than once.

    Only rows of words that hold more rows than numbers are counted one by one.
    """
    full = words(rows, keys, number).where(F.col("rows") > F.bit_count("bits")).select(*[named(k) for k in keys], "word")
    suspects = rows.select(*[named(k) for k in keys], named(number), word_of(named(number)).alias("word")).join(full, [*keys, "word"], "left_semi")
    counted = suspects.groupBy(*[named(k) for k in keys], named(number)).agg(F.count(F.lit(1)).alias("row_count"))
    return counted.where("row_count > 1")


def gaps(rows: DataFrame, keys: Sequence[str], number: str) -> DataFrame:
    """(keys, after, before): neighbouring numbers of a key between which others are missing.

    Holes inside a word are read from its bits; between words the last number
    of the word before counts, carried along the words in blocks.
    """
    held = words(rows, keys, number).where("word is not null")
    block = even_blocks(held, F.col("word"))
    walked = blocked_scan(held, keys, block, ["word"], {"previous": latest(F.col("highest"), exclusive=True)})
    listed = numbers_of(F.col("word"), F.col("bits"))
    reached = F.concat(F.array_compact(F.array("previous")), listed)
    steps = F.arrays_zip(F.slice(reached, F.lit(1), F.size(reached) - 1).alias("after"), F.slice(reached, F.lit(2), F.size(reached)).alias("before"))
    # A word of one unbroken run that goes on from the word before has no hole.
    broken = (F.col("highest") - F.col("lowest") + 1 != F.bit_count("bits")) | (F.col("previous") + 1 != F.col("lowest"))
    found = walked.where(broken).select(*[named(k) for k in keys], F.explode(steps).alias("s"))
    return found.select(*[named(k) for k in keys], "s.after", "s.before").where(F.col("before") - F.col("after") > 1)


def missing_numbers(left: DataFrame, right: DataFrame, number: str) -> DataFrame:
    """Numbers of ``left`` that ``right`` lacks, compared word by word."""
    have = words(right, [], number).select(F.col("word"), F.col("bits").alias("known"))
    lost = F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("known", F.lit(0).cast("long"))))
    rest = words(left, [], number).where("word is not null").join(have, "word", "left").withColumn("lost", lost).where("lost <> 0")
    return rest.select(F.explode(numbers_of(F.col("word"), F.col("lost"))).alias(number))


def step_gaps(frames: DataFrame, step: str | None = None, c: Columns = COLUMNS) -> DataFrame:
    """(episode, after, before): where steps of an episode are missing."""
    return gaps(frames, [c.episode], step or c.frame)

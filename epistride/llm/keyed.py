"""Lookups and components over keys of which one may hold most rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from epistride.operators import scans
from epistride.session import stored


def salts_of(rows: DataFrame) -> int:
    """A hot key's rows are spread over as many parts as there are shuffle partitions."""
    return int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def salt_of(*row_id: Column, salts: int) -> Column:
    return F.pmod(F.xxhash64(*row_id), F.lit(salts)).cast("int")


def row_key(id_col: str, text_col: str) -> Column:
    """A digest of a row's id and text; null ids have one of their own, a null text counts as empty."""
    named = F.coalesce(F.sha2(F.col(id_col).cast("string"), 256), F.lit(""))
    return F.sha2(F.concat(named, F.lit("|"), F.coalesce(F.col(text_col).cast("string"), F.lit(""))), 256)


def spread_lookup(rows: DataFrame, table: DataFrame, keys: Sequence[str], row_id: Sequence[str], how: str = "inner") -> DataFrame:
    """Join ``rows`` with ``table`` (one row per key) without bringing a key's rows together.

    The (key, salt) pairs that occur, at most one per key and shuffle
    partition, fetch the table's row; the rows then join on key and salt.
    ``row_id`` spreads them.
    """
    salted = rows.withColumn("_salt", salt_of(*[F.col(c) for c in row_id], salts=salts_of(rows)))
    pairs = salted.select(*keys, "_salt").distinct().join(table, list(keys))
    return salted.join(pairs, [*keys, "_salt"], how).drop("_salt")


def lookup(rows: DataFrame, table: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join ``rows`` with ``table`` (one row per key), which is written first.

    Spark then knows the table's size, broadcasts it only where that allows,
    and else splits a hot key's rows as they are joined. The plan is smaller
    than that of ``spread_lookup``, which also spreads keys that are hot
    without being large.
    """
    return rows.join(stored(table, "lookup"), list(keys), how)


def numbered_copies(rows: DataFrame, keys: Sequence[str], name: str, most: int = 1) -> DataFrame:
    """``rows`` with a number from 0 among those of equal ``keys`` (never null), and 0 for all others.

    Only keys of more than ``most`` rows are numbered, in parts where one has very many.
    """
    again = stored(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_copies")).filter(F.col("_copies") > most), "repeated")
    if again.isEmpty():
        return rows.withColumn(name, F.lit(0).cast("long"))
    told = rows.join(again, list(keys), "left")
    single = told.filter("_copies is null").withColumn(name, F.lit(0).cast("long"))
    repeated = told.filter("_copies is not null").withColumn("_at", F.monotonically_increasing_id())
    return single.unionByName(scans.number_rows(repeated, keys, "_at", [], name).drop("_at")).drop("_copies")


def _mark(edges: DataFrame) -> tuple:
    return tuple(
        edges.agg(
            F.count(F.lit(1)),
            F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")),
        ).first()
    )


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b): root is the least node reachable.

    Alternating large-star and small-star rounds. Each step is a written
    table: plans stay small, lineage short, the least neighbours' table is
    broadcast only where its size on disk allows, and a hot node's rows are
    split where they are joined. Nothing but two numbers a round reaches the
    driver.
    """
    links = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = stored(links, "links")
    before = _mark(links)
    while before[0]:
        both = links.union(links.select("b", "a")).toDF("a", "b")
        least = stored(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m")), "least")
        # Large star: greater neighbours, and the node itself, hang below the least of the neighbourhood.
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.union(least.select("a", F.col("m").alias("b"))).filter("a <> b")
        large = stored(large.distinct(), "large-star")
        # Small star: a node's smaller neighbours, and the node, hang below the least of them.
        low = stored(large.groupBy("a").agg(F.min("b").alias("m")), "lowest")
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        links = stored(small.union(low.select("a", F.col("m").alias("b"))).distinct(), "links")
        after = _mark(links)
        if after == before:
            break
        before = after
    roots = links.groupBy("a").agg(F.min("b").alias("root"))
    return roots.withColumnRenamed("a", "node").union(roots.select(F.col("root").alias("node"), "root").distinct())

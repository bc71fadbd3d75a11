"""Mixing sources to target weights by Sainte-Laguë apportionment.

Each source gets a target in words. The targets compete for blocks of equal
size: block after block goes to the highest quotient target / (2 * blocks + 1).
A source's documents are dealt to shards of its own by a seeded hash, so that a
shard holds a bounded number of words and documents. The source's quota is
apportioned to its shards by the same rule, over groups of shards first where
they are many, so that the shards' quotas add up to it. In a shard they are
taken from its sequence of documents: whole passes first, then blocks in seeded
order.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from epistride.llm.arrow import slices
from epistride.llm.keyed import numbered_copies, spread_lookup
from epistride.session import stored

WORD = r"[^\x20\x09-\x0D]+"
BLOCK_WORDS = 64
#: A shard holds about so many words, and documents, at most.
SHARD_WORDS = 200_000
SHARD_ROWS = 1_000
#: So many shards, or groups of them, share a quota in one task.
GROUP_SHARDS = 1_000
_WORD = re.compile(WORD.encode())


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def cyclic_weights(sources: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """``sources`` with a weight each, dealt in code point order, null last."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    dealt = F.array(*[F.lit(float(w)) for w in weights])
    return sources.withColumn("weight", F.get(dealt, (F.row_number().over(order) - 1) % len(weights)))


def capped_targets(sources: DataFrame, share: float, most: float) -> DataFrame:
    """(source, source_size, weight) with ``target``: ``share`` of all words by weight, at most ``most`` times the source.

    What a capped source leaves goes to the others by weight. With sources in
    order of capacity per weight, the level at which those after the capped
    ones are served is the first that no later source exceeds. The table has a
    row per source; it is the mixture's definition and stays in one task.
    """
    room = F.lit(float(most)) * F.col("source_size")
    order = Window.orderBy("fills", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    levels = (
        sources.withColumn("room", room)
        .withColumn("fills", F.col("room") / F.col("weight"))
        .withColumn("wanted", F.lit(float(share)) * F.sum("source_size").over(everything))
        .withColumn("level", (F.col("wanted") - F.coalesce(F.sum("room").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    )
    served = F.min(F.when(F.col("fills") >= F.col("level"), F.struct("fills", "level"))).over(everything)["level"]
    level = F.coalesce(served, F.max("fills").over(everything))
    kept = [c for c in sources.columns if c not in ("source_size", "weight")]
    return levels.withColumn("served", level).select(
        *kept, "source_size", F.least("room", F.col("served") * F.col("weight")).alias("target")
    )


def sainte_lague(claims: np.ndarray, blocks: int) -> np.ndarray:
    """Integer quotas that sum to ``blocks``; ties go to the earlier claim."""
    quotas = np.zeros(len(claims), np.int64)
    if blocks <= 0 or claims.sum() <= 0:
        return quotas
    # Below these quotas no source is given too much yet; the rest goes block by block.
    quotas = np.maximum(0, np.floor(claims * blocks / claims.sum() - 0.5)).astype(np.int64)
    ahead = [(-c / (2 * q + 1), i) for i, (c, q) in enumerate(zip(claims.tolist(), quotas.tolist())) if c > 0]
    heapq.heapify(ahead)
    while quotas.sum() < blocks:
        _, i = ahead[0]
        quotas[i] += 1
        heapq.heapreplace(ahead, (-claims[i] / (2 * quotas[i] + 1), i))
    while True:  # a starting quota above its due gives blocks back
        with np.errstate(divide="ignore", invalid="ignore"):
            held = np.where(quotas > 0, claims / (2 * quotas - 1), np.inf)
        low, high = int(len(held) - 1 - held[::-1].argmin()), int((claims / (2 * quotas + 1)).argmax())
        if held[low] >= claims[high] / (2 * quotas[high] + 1):
            return quotas
        quotas[low] -= 1
        quotas[high] += 1


def _source_quotas(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("src", kind="stable")
    claims = rows["target"].to_numpy(float)
    return rows[["src", "source_size", "target", "shards"]].assign(quota=sainte_lague(claims, int(np.floor(claims.sum() / BLOCK_WORDS + 0.5))))


def _with_keys(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """``docs`` with two digests of id, source and text; rows equal in these are exchangeable."""
    told = [F.col(id_col), F.col(source_col).cast("string"), F.col(text_col)]
    # xxhash64 passes over nulls, so what is null is told beside it.
    told += [F.concat(*[F.col(c).isNull().cast("string") for c in (id_col, source_col, text_col)])]
    return docs.withColumns({"_key": F.xxhash64(*told), "_key2": F.xxhash64(F.lit(1), *told)})


def _shared_quota(rows: pd.DataFrame) -> pd.DataFrame:
    """``given`` words of a source dealt to its parts: blocks by highest quotients, none above ``room``.

    What a part has no room for goes to those that have, in order.
    """
    rows = rows.sort_values("part", kind="stable")
    given, room = int(rows["given"].iloc[0]), rows["room"].to_numpy(np.int64)
    blocks = sainte_lague(rows["words"].to_numpy(float), int(np.floor(given / BLOCK_WORDS + 0.5)))
    wanted = np.minimum(blocks * BLOCK_WORDS, room)
    short = given - int(wanted.sum())
    spare = room - wanted if short > 0 else wanted
    step = np.minimum(spare, np.maximum(0, abs(short) - (np.cumsum(spare) - spare)))
    wanted = wanted + np.sign(short) * step
    return rows[["src", "part"]].assign(given=wanted)


def shard_quotas(held: DataFrame, given: DataFrame, shards: int, most: float) -> DataFrame:
    """(src, part, given): each source's words (src, given) dealt to its shards (src, shard, words).

    Level by level, no more than ``GROUP_SHARDS`` parts share a quota at a time.
    """
    span = 1
    while span < shards:
        span *= GROUP_SHARDS
    given = given.select("src", F.lit(0).cast("long").alias("part"), "given")
    while True:
        below = max(1, span // GROUP_SHARDS)
        parts = held.groupBy("src", F.floor(F.col("shard") / below).cast("long").alias("part")).agg(
            F.sum("words").alias("words"), F.sum(F.floor(F.col("words") * float(most)).cast("long")).alias("room")
        )
        above = given.select("src", F.col("part").alias("above"), "given")
        dealt = parts.withColumn("above", F.floor(F.col("part") * below / span).cast("long")).join(above, ["src", "above"])
        given = dealt.groupBy("src", "above").applyInPandas(_shared_quota, "src string, part long, given long")
        if below == 1:
            return given
        span = below


def mix_plan(
    docs: DataFrame,
    weights: tuple[float, ...] | DataFrame,
    share: float,
    most: float = 2.0,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """What the mix takes of every row of ``docs``.

    Returns (id, source, size, source_size, target, passes, ranges, taken) and
    what names the row: ``passes`` whole copies and once more the words in
    ``ranges`` [start, end). ``weights`` are dealt to the sources in order, or
    a table (source, weight). A null text has size 0 and gives nothing; null
    is a source like others. Rows of equal id, source and text are numbered
    and exchangeable. The plan depends on the rows, the seed and the
    parameters alone. The table of sources, a row each, is worked on in one
    task.
    """
    keyed = _with_keys(docs.select(id_col, source_col, text_col), id_col, text_col, source_col)
    sizes = keyed.select(
        F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), "_key", "_key2"
    )
    # A key that is never null.
    sizes = stored(sizes.withColumn("src", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))), "sizes")
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    if isinstance(weights, DataFrame):
        weighed = sources.join(weights.select(F.col("source").alias("_s"), "weight"), sources.source.eqNullSafe(F.col("_s"))).drop("_s")
    else:
        weighed = cyclic_weights(sources, weights)
    shards = F.greatest(F.ceil(F.col("source_size") / SHARD_WORDS), F.ceil(F.col("rows") / SHARD_ROWS), F.lit(1)).cast("long")
    targets = capped_targets(weighed.withColumn("shards", shards), share, most)
    targets = targets.withColumn("src", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))).drop("source")
    given = "src string, source_size long, target double, shards long, quota long"
    targets = stored(targets.withColumn("all", F.lit("")).groupBy("all").applyInPandas(_source_quotas, given), "targets")

    dealt = numbered_copies(sizes, ["_key", "_key2"], "_nth")
    dealt = dealt.withColumn("place", F.xxhash64(F.lit(seed), "_key", "_key2", "_nth"))
    dealt = spread_lookup(dealt, targets.select("src", "shards"), ["src"], ["place"])
    dealt = stored(dealt.withColumn("shard", F.pmod("place", "shards")).drop("shards"), "dealt")

    # Each source's words are fixed once and then shared out to its shards.
    held = stored(dealt.groupBy("src", "shard").agg(F.sum("size").alias("words")), "held")
    whole = F.least(F.col("quota") * BLOCK_WORDS, F.floor(F.col("source_size") * float(most)).cast("long"))
    most_shards = targets.agg(F.max("shards")).first()[0] or 1
    quotas = shard_quotas(held.filter("words > 0"), targets.select("src", whole.alias("given")), most_shards, most)
    quotas = quotas.withColumnRenamed("part", "shard").join(held, ["src", "shard"])
    quotas = quotas.withColumn("passes", F.expr("given div words"))
    quotas = quotas.select("src", "shard", "words", "passes", (F.col("given") - F.col("passes") * F.col("words")).alias("rest"))
    quotas = stored(quotas, "quotas")

    # Seeded order of the blocks; the last one that fits only in part gives its first words.
    block = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(words - 1) div {BLOCK_WORDS}")))
    blocks = quotas.filter("rest > 0").select("src", "shard", "rest", "words", block.alias("block"))
    length = F.least(F.lit(BLOCK_WORDS).cast("long"), F.col("words") - F.col("block") * BLOCK_WORDS)
    seeded = Window.partitionBy("src", "shard").orderBy(F.xxhash64(F.lit(seed), "src", "shard", "block"), "block")
    before = F.coalesce(F.sum("length").over(seeded.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    chosen = (
        blocks.withColumn("length", length)
        .withColumn("use", F.least("length", F.col("rest") - before))
        .filter("use > 0")
        .select("src", "shard", "block", "use")
        # Spark takes the blocks' number from the sources' and would broadcast them.
        .hint("merge")
    )

    row = Window.partitionBy("src", "shard").orderBy("place", "_key", "_key2", "_nth")
    offset = F.sum("size").over(row.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    own = ["_key", "_key2", "_nth", "id", "size"]
    filled = dealt.filter("size > 0").select("src", "shard", *own, offset.alias("first"))
    touched = F.explode(F.sequence(F.expr(f"first div {BLOCK_WORDS}"), F.expr(f"(first + size - 1) div {BLOCK_WORDS}")))
    start = F.greatest(F.col("first"), F.col("block") * BLOCK_WORDS) - F.col("first")
    end = F.least(F.col("first") + F.col("size"), F.col("block") * BLOCK_WORDS + F.col("use")) - F.col("first")
    pieces = filled.withColumn("block", touched).join(chosen, ["src", "shard", "block"], "left")
    pieces = pieces.withColumn("piece", F.when(F.col("use").isNotNull() & (end > start), F.struct(start.alias("start"), end.alias("end"))))
    taken = pieces.groupBy("src", "shard", *own, "first").agg(F.array_sort(F.collect_list("piece")).alias("ranges"))
    empty = dealt.filter("size = 0").select("src", "shard", *own, F.lit(0).cast("long").alias("first"))
    taken = taken.unionByName(empty.withColumn("ranges", F.array().cast("array<struct<start:bigint,end:bigint>>")))

    passes = held.select("src", "shard").join(quotas, ["src", "shard"], "left").join(targets, "src")
    passes = passes.select("src", "shard", F.coalesce("passes", F.lit(0)).cast("long").alias("passes"), "source_size", "target")
    words = F.aggregate("ranges", F.lit(0).cast("long"), lambda s, r: s + r["end"] - r["start"])
    return spread_lookup(taken, passes, ["src", "shard"], ["_key", "_nth"]).select(
        *[c for c in own if c not in ("id", "size")],
        "id",
        F.when(F.col("src") != "", F.substring("src", 2, 1 << 30)).alias("source"),
        "size",
        "source_size",
        "target",
        "passes",
        "ranges",
        (F.col("passes") * F.col("size") + words).alias("taken"),
    )


def _cut(text: str, ranges: list[dict[str, int]]) -> str:
    """The words of ``text`` in the ranges with what stands between them; ranges that do not meet go on new lines."""
    data = text.encode()
    at = [m.span() for m in _WORD.finditer(data)]
    joined: list[list[int]] = []
    for r in ranges:
        if joined and joined[-1][1] == r["start"]:
            joined[-1][1] = r["end"]
        else:
            joined.append([r["start"], r["end"]])
    return b"\n".join(data[at[a][0] : at[b - 1][1]] for a, b in joined).decode()


def mixed_documents(
    docs: DataFrame,
    plan: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    chars_col: str | None = "n_chars",
) -> DataFrame:
    """The rows the plan takes, with the columns of ``docs``: whole copies, then the words taken once more.

    Each row follows its own plan; rows equal in id, source and text may
    exchange theirs.
    """
    wanted = stored(plan.filter("taken > 0").select("_key", "_key2", "_nth", "passes", "ranges"), "mix-plan")
    rows = _with_keys(docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), id_col, text_col, source_col), id_col, text_col, source_col)
    rows = numbered_copies(rows.select("row", "_key", "_key2"), ["_key", "_key2"], "_nth")
    joined = rows.join(wanted, ["_key", "_key2", "_nth"]).select("row", "passes", "ranges")
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = names.index(text_col)
        for batch in slices(batches, "row", inside=text_col):
            rows = pa.RecordBatch.from_struct_array(batch.column("row"))
            passes, ranges = batch.column("passes").to_pylist(), batch.column("ranges").to_pylist()
            whole = [i for i, n in enumerate(passes) for _ in range(n)]
            cut = [i for i, r in enumerate(ranges) if r]
            if whole:
                yield rows.take(pa.array(whole, pa.int64()))
            if cut:
                part = rows.take(pa.array(cut, pa.int64()))
                texts = [_cut(t, ranges[i]) for i, t in zip(cut, part.column(place).to_pylist())]
                columns = list(part.columns)
                columns[place] = pa.array(texts, part.schema.field(place).type)
                if chars_col in names:
                    chars = names.index(chars_col)
                    columns[chars] = pa.array([len(t) for t in texts], part.schema.field(chars).type)
                yield pa.RecordBatch.from_arrays(columns, schema=part.schema)

    return joined.mapInArrow(run, docs.schema)

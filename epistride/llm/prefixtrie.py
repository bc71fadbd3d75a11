"""The prefix trie of conversations, by hashing of blocks of turns.

Conversations are cut into blocks of ``BLOCK`` turns. A conversation is first
named by the running digest of its whole blocks, and conversations of equal
digest are one block node from then on. Single turns are looked at only inside
distinct blocks: where a block has no sibling, its turns are a chain and keep
the block's counts; where siblings diverge, their first turns are hashed one
by one and grouped.

Sums over subtrees need no walk from level to level: what a node adds is
charged to its smallest member, a running sum along that conversation tells
what lies beyond each of its blocks, and the members of a node add up. A
conversation may hold any share of the rows: positions and running digests are
computed in parts, and only digests and lengths are shuffled, never texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from epistride.operators import scans
from epistride.session import stored

BLOCK = 4
#: Running digests are carried between parts of so many blocks.
PART = 16_384
#: Ids travel to their node's digest in pieces of about so many bytes.
PIECE_BYTES = 1 << 16
_LANE = 15
ROOT = "0" * (2 * _LANE)
_FIRST = -(1 << 62)


def _lane(text: Column, number: int) -> Column:
    return F.conv(F.substring(F.sha2(text, 256), 1 + _LANE * number, _LANE), 16, 10).cast("decimal(20,0)")


def _key_of(lanes: list[Column]) -> Column:
    folded = [(lane % F.lit(1 << 4 * _LANE).cast("decimal(20,0)")).cast("long") for lane in lanes]
    return F.concat(*[F.lpad(F.lower(F.hex(lane)), _LANE, "0") for lane in folded])


def numbered_turns(
    conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """(conv, pos, digest, chars): turns by position in their conversation, from 0, without their texts.

    A null turn comes first; equal turns are ordered by digest. Null roles and
    texts are empty. Rows without a conversation id belong to none and go.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    digest = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32)
    rows = conversations.filter(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv"),
        F.coalesce(F.col(turn_col).cast("long"), F.lit(_FIRST)).alias("turn"),
        digest.alias("digest"),
        F.length(text).cast("long").alias("chars"),
    )
    rows = stored(rows, "turns")
    return scans.number_rows(rows, ["conv"], "turn", ["digest"], "pos").select("conv", "pos", "digest", "chars")


def with_shared_heads(turns: DataFrame, base: Column, head: Column, longest: int) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations): each conversation's first ``head`` turns replaced by those of conversation ``base``.

    ``base`` and ``head`` (at most ``longest``) are expressions of ``conv``; a
    shorter base gives all its turns, an absent one none. Conversations come
    as (conv, n), also those left without a turn.
    """
    turns = stored(turns, "numbered")
    convs = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("own"))
    convs = convs.select("conv", "own", base.cast("long").alias("base"), head.cast("int").alias("head"))
    given = convs.select(F.col("base").alias("conv")).distinct()
    firsts = turns.filter(F.col("pos") < longest).join(given, "conv", "left_semi")
    firsts = firsts.groupBy(F.col("conv").alias("base")).agg(F.array_sort(F.collect_list(F.struct("pos", "digest", "chars"))).alias("lead"))
    lead = F.when(F.col("head") > 0, F.slice("lead", F.lit(1), F.col("head")))
    lead = F.coalesce(lead, F.array().cast("array<struct<pos:bigint,digest:string,chars:bigint>>"))
    convs = convs.join(firsts, "base", "left").withColumn("lead", lead)
    n = F.size("lead") + F.greatest(F.col("own") - F.col("head"), F.lit(0))
    convs = stored(convs.select("conv", "own", "head", "lead", n.cast("long").alias("n")), "heads")
    reach = convs.select("conv", "head", F.size("lead").alias("led"), F.lit(0).cast("long").alias("first"), (F.col("own") - 1).alias("last"))
    rest = scans.join_episodes(turns, reach, "conv", "pos", "first", "last").filter("pos >= __head")
    rest = rest.select("conv", (F.col("pos") - F.col("__head") + F.col("__led")).alias("pos"), "digest", "chars")
    heads = convs.select("conv", F.explode("lead").alias("t")).select("conv", "t.pos", "t.digest", "t.chars")
    return heads.unionByName(rest), convs.select("conv", "n")


@dataclass(frozen=True)
class Trie:
    """``nodes``: (conv_id, depth, parent_conv_id, n_convs, n_ends, n_children, n_leaves, saved_tokens), a node being
    named by its smallest member and its depth; ``ends``: (node_conv_id, depth, conv_id) of every conversation's last node."""

    nodes: DataFrame
    ends: DataFrame


def _blocks(turns: DataFrame, convs: DataFrame, width: int) -> DataFrame:
    """(conv, k, chain, parent, turns, ends): a conversation's blocks, and its root as block -1.

    ``chain`` names all turns up to the block's end: digests of the blocks
    (with their numbers) added up in two lanes of 60 bits.
    """
    rows = turns.select("conv", F.floor(F.col("pos") / width).cast("long").alias("k"), F.struct("pos", "digest", "chars").alias("turn"), F.lit(0).alias("end"))
    last = F.when(F.col("n") > 0, F.floor((F.col("n") - 1) / width)).otherwise(F.lit(-1)).cast("long")
    nothing = F.lit(None).cast("struct<pos:bigint,digest:string,chars:bigint>")
    tips = convs.select("conv", last.alias("k"), nothing.alias("turn"), F.lit(1).alias("end"))
    roots = convs.select("conv", F.lit(-1).cast("long").alias("k"), nothing.alias("turn"), F.lit(0).alias("end"))
    held = rows.unionByName(tips).unionByName(roots).groupBy("conv", "k")
    held = held.agg(F.array_sort(F.collect_list("turn")).alias("turns"), F.max("end").alias("ends"))
    told = F.concat_ws("", F.col("k").cast("string"), F.lit(":"), F.transform("turns", lambda t: t["digest"]))
    lanes = {f"lane{i}": F.when(F.col("k") >= 0, _lane(told, i)).otherwise(F.lit(0).cast("decimal(20,0)")) for i in (0, 1)}
    sums = {f"sum{i}": scans.running_sum(F.col(f"lane{i}")) for i in (0, 1)}
    chained = scans.blocked_scan(held.withColumns(lanes), ["conv"], scans.position_block(F.col("k"), PART), ["k"], sums)
    before = [F.col(f"sum{i}") - F.col(f"lane{i}") for i in (0, 1)]
    return chained.select("conv", "k", _key_of([F.col("sum0"), F.col("sum1")]).alias("chain"), _key_of(before).alias("parent"), "turns", "ends")


def _steps(nodes: DataFrame, width: int, *kept: str) -> DataFrame:
    """One row for each turn of a block node: (depth, key, above, j, size, ...); the root has one row of depth 0.

    ``key`` names all turns up to this one: the chain at a whole block's end,
    else the chain before the block and the block's turns so far.
    """
    part = lambda j: F.array_join(F.transform(F.slice("turns", F.lit(1), j), lambda t: t["digest"]), "")
    inner = lambda j: F.substring(F.sha2(F.concat("parent", part(j)), 256), 1, 2 * _LANE)
    keyed = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size("turns"), F.lit(1))),
        lambda j: F.struct(
            j.alias("j"),
            F.when((j == width) | (F.col("k") < 0), F.col("chain")).otherwise(inner(j)).alias("key"),
            F.when(j == 1, F.col("parent")).otherwise(inner(j - 1)).alias("above"),
        ),
    )
    out = nodes.select("k", "turns", F.size("turns").alias("size"), *kept, F.explode(keyed).alias("s"))
    depth = F.when(F.col("k") < 0, 0).otherwise(F.col("k") * width + F.col("s.j")).cast("long")
    chars = F.coalesce(F.get("turns", F.col("s.j") - 1)["chars"], F.lit(0).cast("long"))
    return out.select("k", depth.alias("depth"), "s.key", "s.above", "s.j", chars.alias("chars"), "size", *kept)


def prefix_trie(turns: DataFrame, convs: DataFrame, width: int = BLOCK) -> Trie:
    """The trie of the sequences of turn digests.

    ``turns`` holds (conv, pos, digest, chars) with positions dense from 0,
    ``convs`` (conv, n) with n the number of turns, 0 included. n_convs counts
    a node's members, n_ends those that end there, n_children its children,
    n_leaves the childless nodes of its subtree (itself included), and
    saved_tokens sums (n_convs - 1) * chars of the last turn over the subtree.
    No conversation, no node.
    """
    blocks = stored(_blocks(turns, convs, width), "blocks")
    grouped = blocks.groupBy("k", "chain").agg(F.min("conv").alias("rep"), F.count(F.lit(1)).alias("n"), F.sum("ends").alias("ends"))
    shape = blocks.select(F.col("conv").alias("rep"), "k", "parent", "turns")
    nodes = stored(grouped.join(shape, ["rep", "k"]), "block-nodes")

    # A block without a sibling is a chain; the others are refined turn by turn.
    siblings = nodes.filter("k >= 0").groupBy("k", "parent").agg((F.count(F.lit(1)) > 1).alias("split"))
    split = scans.spread_join(nodes.select("k", "chain", "parent"), siblings.filter("split"), ["k", "parent"], ["chain"]).select("k", "chain", "split")
    nodes = stored(nodes.join(split, ["k", "chain"], "left").withColumn("split", F.coalesce("split", F.lit(False))), "split-nodes")
    ending = F.when(F.col("j") >= F.col("size"), F.col("ends")).otherwise(F.lit(0)).cast("long")
    steps = _steps(nodes, width, "rep", "n", "ends", "split").withColumn("ends", ending)
    chain = steps.filter("not split").select("depth", "key", "above", "chars", "rep", "n", "ends")
    forks = steps.filter("split").groupBy("depth", "key").agg(
        F.min("above").alias("above"), F.max("chars").alias("chars"), F.min("rep").alias("rep"), F.sum("n").alias("n"), F.sum("ends").alias("ends")
    )
    found = stored(chain.unionByName(forks), "trie-nodes")

    # Each node's own share is charged to its smallest member; what lies beyond a block adds up along the conversation.
    own = found.select(
        F.col("rep").alias("conv"),
        F.when(F.col("depth") > 0, F.floor((F.col("depth") - 1) / width)).otherwise(F.lit(-1)).cast("long").alias("k"),
        F.struct("depth", ((F.col("n") - 1) * F.col("chars")).alias("saved"), (F.col("n") == F.col("ends")).cast("long").alias("leaf")).alias("own"),
    )
    own = own.groupBy("conv", "k").agg(F.collect_list("own").alias("owned"))
    added = lambda name: F.aggregate("owned", F.lit(0).cast("long"), lambda s, o: s + o[name])
    charged = blocks.select("conv", "k", "chain").join(own, ["conv", "k"], "left").withColumn("back", -F.col("k"))
    charged = charged.withColumns({"saved": F.coalesce(added("saved"), F.lit(0)), "leaf": F.coalesce(added("leaf"), F.lit(0))})
    beyond = {"later_saved": scans.running_sum(F.col("saved"), True), "later_leaves": scans.running_sum(F.col("leaf"), True)}
    beyond = scans.blocked_scan(charged.select("conv", "k", "chain", "back", "saved", "leaf"), ["conv"], scans.position_block(F.col("back"), PART), ["back"], beyond)
    beyond = beyond.groupBy("k", "chain").agg(F.sum("later_saved").alias("later_saved"), F.sum("later_leaves").alias("later_leaves"))
    full = nodes.join(beyond, ["k", "chain"]).join(own.withColumnRenamed("conv", "rep"), ["rep", "k"], "left")
    inside = lambda name: F.coalesce(
        F.aggregate(F.filter("owned", lambda o: o["depth"] >= F.col("depth")), F.lit(0).cast("long"), lambda s, o: s + o[name]), F.lit(0)
    )
    sums = _steps(full, width, "split", "later_saved", "later_leaves", "owned").select(
        "depth", "key", "split", (F.col("later_saved") + inside("saved")).alias("saved_tokens"), (F.col("later_leaves") + inside("leaf")).alias("n_leaves")
    )
    forked = sums.filter("split").groupBy("depth", "key").agg(F.sum("saved_tokens").alias("saved_tokens"), F.sum("n_leaves").alias("n_leaves"))
    sums = sums.filter("not split").drop("split").unionByName(forked)

    children = found.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("above").alias("key")).agg(F.count(F.lit(1)).alias("n_children"))
    parents = found.select((F.col("depth") + 1).alias("depth"), F.col("key").alias("above"), F.col("rep").alias("parent_conv_id"))
    below = scans.spread_join(found.filter("depth > 0"), parents, ["depth", "above"], ["key"])
    top = found.filter("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long"))
    out = below.unionByName(top).join(sums, ["depth", "key"]).join(children, ["depth", "key"], "left").select(
        F.col("rep").alias("conv_id"),
        "depth",
        "parent_conv_id",
        F.col("n").alias("n_convs"),
        F.col("ends").alias("n_ends"),
        F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
        "n_leaves",
        "saved_tokens",
    )
    tips = _steps(blocks.filter("ends > 0"), width, "conv").filter("j >= size").select("depth", "key", F.col("conv").alias("conv_id"))
    ends = scans.spread_join(tips, found.select("depth", "key", F.col("rep").alias("node_conv_id")), ["depth", "key"], ["conv_id"])
    return Trie(out, ends.select("node_conv_id", "depth", "conv_id"))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (node_conv_id, depth, conv_id) as texts of ids, begun anew after PIECE_BYTES."""
    names = ["node_conv_id", "depth", "first", "ids"]
    node, first, ids, size = None, None, [], 0

    def piece() -> pa.RecordBatch:
        columns = [pa.array([v], pa.int64()) for v in (*node, first)]
        return pa.RecordBatch.from_arrays([*columns, pa.array([",".join(ids)])], names=names)

    for batch in batches:
        for conv, depth, member in zip(*[batch.column(c).to_pylist() for c in ("node_conv_id", "depth", "conv_id")]):
            if (conv, depth) != node or size >= PIECE_BYTES:
                if ids:
                    yield piece()
                node, first, ids, size = (conv, depth), member, [], 0
            ids.append(str(member))
            size += len(ids[-1]) + 1
    if ids:
        yield piece()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The SHA-256 of each node's pieces in order, fed piece by piece."""
    node, state = None, None

    def done() -> pa.RecordBatch:
        columns = [pa.array([v], pa.int64()) for v in node]
        return pa.RecordBatch.from_arrays([*columns, pa.array([state.hexdigest()])], names=["node_conv_id", "depth", "listed"])

    for batch in batches:
        for conv, depth, ids in zip(*[batch.column(c).to_pylist() for c in ("node_conv_id", "depth", "ids")]):
            if (conv, depth) != node:
                if state is not None:
                    yield done()
                node, state = (conv, depth), hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
    if state is not None:
        yield done()


def with_ends_digest(trie: Trie) -> DataFrame:
    """The nodes with ``ends_sha256``: the digest of the ascending, comma-joined ids of conversations that end there.

    SHA-256 takes its input in order, so a node's ids meet in one task in the
    end; they are sorted and joined to texts over many tasks before.
    """
    single = trie.ends.groupBy("node_conv_id", "depth").agg(F.min("conv_id").alias("only"), F.count(F.lit(1)).alias("many"))
    single = stored(single, "end-nodes")
    crowd = single.filter("many > 1").select("node_conv_id", "depth", "many")
    rows = stored(scans.spread_join(trie.ends, crowd, ["node_conv_id", "depth"], ["conv_id"]).drop("many"), "ends")
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["node_conv_id", "depth", "conv_id"]
    pieces = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    pieces = pieces.mapInArrow(_pieces, "node_conv_id long, depth long, first long, ids string")
    dealt = pieces.repartition("node_conv_id", "depth").sortWithinPartitions("node_conv_id", "depth", "first")
    listed = dealt.mapInArrow(_digests, "node_conv_id long, depth long, listed string")
    alone = single.filter("many = 1").select("node_conv_id", "depth", F.sha2(F.col("only").cast("string"), 256).alias("listed"))
    told = alone.unionByName(listed).withColumnRenamed("node_conv_id", "conv_id")
    nodes = trie.nodes.join(told, ["conv_id", "depth"], "left")
    return nodes.withColumn("ends_sha256", F.coalesce("listed", F.sha2(F.lit(""), 256))).drop("listed")

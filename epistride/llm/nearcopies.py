"""Near copies: texts whose word shingles have at least a given Jaccard similarity.

A text is the set of its shingles' hashes; texts of equal sets are one node.
SimHash fingerprints of the same shingles, linked through Golay keys, propose
groups of texts; so that nothing beyond their few bits is lost, MinHash bands
propose more. Every proposed pair is compared by its whole sets. Of two texts
at similarity s, no band agrees with probability (1 - s^ROWS)^BANDS, which is
7e-6 at 0.8 and less above it.

Pairs are never listed band by band; a component of fingerprints is a band like
the others. First every node of a band is compared
with the band's hub, the node that shares most bands with others; that joins
groups of near copies in as many comparisons as they have nodes. What bands
are then still apart go through an exact similarity join: in an order from
rare to common shingles, two sets that are alike share a shingle among the
first of both, and one that leaves enough shingles behind it on both sides. A
passage that many texts share is common, stands last, and joins nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from epistride.llm import simhash
from epistride.llm.arrow import record_batch, slices
from epistride.llm.keyed import components, lookup, row_key
from epistride.session import stored

WIDTH = 5
SIMILARITY = 0.8
BANDS, ROWS = 30, 5
_CHUNK = 2048
_DRAWN = np.random.default_rng(11).integers(0, 1 << 64, (2, BANDS * ROWS, 1), np.uint64)
FLIPS, FACTORS = _DRAWN[0], _DRAWN[1] | np.uint64(1)


def _distinct(runs: list[np.ndarray]) -> np.ndarray:
    return np.unique(np.concatenate(runs)) if runs else np.zeros(0, np.uint64)


def shingles(data: bytes, width: int = WIDTH) -> np.ndarray:
    """The sorted distinct hashes of a text's word shingles; none where it has no word."""
    return _distinct(list(simhash.shingle_hashes(data.lower(), width)))


def bands(found: np.ndarray) -> list[int]:
    """A key for each band of the set's least hashes; an empty set has none."""
    if not len(found):
        return []
    low = np.full(BANDS * ROWS, ~np.uint64(0))
    for start in range(0, len(found), _CHUNK):
        low = np.minimum(low, ((found[start : start + _CHUNK] ^ FLIPS) * FACTORS).min(axis=1))
    data = low.astype("<u8").tobytes()
    keys = [xxhash.xxh64_intdigest(data[i * 8 * ROWS : (i + 1) * 8 * ROWS], i) for i in range(BANDS)]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets; 1 for two empty ones."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    union = len(a) + len(b) - common
    return common / union if union else 1.0


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    return docs.select(F.col(id_col).alias("id"), row_key(id_col, text_col).alias("key"), text.alias("text"))


def _sketched(rows: DataFrame, width: int) -> DataFrame:
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets, prints = [], []
            for text in batch.column("text").to_pylist():
                runs = list(simhash.shingle_hashes(text.lower(), width))
                sets.append(_distinct(runs))
                prints.append(simhash.print_of(runs))
            prints = pa.array(np.array(prints, np.uint64).view(np.int64))
            names = pa.array([xxhash.xxh3_128_hexdigest(s.tobytes()) for s in sets], pa.string())
            keys = pa.array([bands(s) for s in sets], pa.list_(pa.int64()))
            sizes = pa.array([len(s) for s in sets], pa.int64())
            columns = [batch.column("id"), batch.column("key"), names, sizes, prints, keys]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "key", "name", "size", "fp", "bands"])

    return rows.mapInArrow(run, f"id {kind}, key string, name string, size long, fp long, bands array<long>")


def _sets(rows: DataFrame, width: int) -> DataFrame:
    """(node, hashes) of rows (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = pa.array([shingles(t, width).tobytes() for t in batch.column("text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("node"), sets], names=["node", "hashes"])

    return rows.select("node", "text").mapInArrow(run, "node long, hashes binary")


def _alike(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose sets (node, hashes) have at least the similarity ``least``."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "x"):
            x, y = (batch.column(c).to_pylist() for c in ("x", "y"))
            near = [i for i in range(len(x)) if similarity(np.frombuffer(x[i], np.uint64), np.frombuffer(y[i], np.uint64)) >= least]
            if near:
                part = batch.select(["a", "b"]).take(pa.array(near, pa.int64()))
                yield record_batch(schema, [part.column("a").to_pylist(), part.column("b").to_pylist()])

    # Pairs and sets are written tables: a hub's many pairs are split as they are joined.
    found = pairs.join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("y")), "b")
    found = found.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")), "a")
    return found.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _with_roots(rows: DataFrame, found: DataFrame) -> DataFrame:
    roots = components(found).select("node", "root")
    return rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _fits(a: Column, b: Column, least: float) -> Column:
    """Sets whose sizes are further apart cannot be alike."""
    return F.least(a, b) >= F.greatest(a, b) * F.lit(least - 1e-9)


def _hub_pairs(met: DataFrame, least: float) -> DataFrame:
    """Each node of a band (band, node, size, n) with the band's hub."""
    degrees = met.groupBy("node").agg(F.sum(F.col("n") - 1).alias("degree"))
    hubs = met.join(degrees, "node").groupBy("band").agg(F.max(F.struct("degree", "node", "size")).alias("hub"))
    told = lookup(met, hubs, ["band"]).filter(F.col("node") != F.col("hub.node"))
    told = told.filter(_fits(F.col("size"), F.col("hub.size"), least))
    return told.select(F.greatest("node", "hub.node").alias("a"), F.least("node", "hub.node").alias("b")).distinct()


def rare_prefixes(sets: DataFrame, least: float) -> DataFrame:
    """(token, node, root, size, place) of the shingles by which sets (node, root, hashes) that are alike must meet.

    A set's shingles are ordered from rare to common among the given sets,
    ``place`` counts from 0. Of two alike sets the first shared shingle lies
    among the first size - ceil(least * size) + 1 of both.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "hashes"):
            found = [np.frombuffer(h, np.uint64).view(np.int64) for h in batch.column("hashes").to_pylist()]
            sizes = np.array([len(f) for f in found], np.int64)
            node, root = (np.repeat(batch.column(c).to_numpy(), sizes) for c in ("node", "root"))
            columns = [np.concatenate([np.zeros(0, np.int64), *found]), node, root, np.repeat(sizes, sizes)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["token", "node", "root", "size"])

    tokens = stored(sets.select("node", "root", "hashes").mapInArrow(run, "token long, node long, root long, size long"), "tokens")
    # A shingle of one set only takes a place but meets nothing.
    shared = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("sets")).filter("sets > 1")
    known = lookup(tokens, shared, ["token"])
    mine = Window.partitionBy("node")
    alone = F.col("size") - F.count(F.lit(1)).over(mine)
    place = alone + F.row_number().over(mine.orderBy("sets", "token")) - 1
    kept = F.col("size") - F.ceil(F.col("size") * F.lit(least) - 1e-9) + 1
    return known.withColumn("place", place).filter(F.col("place") < kept).select("token", "node", "root", "size", "place")


def _crossing_pairs(prefixes: DataFrame, least: float) -> DataFrame:
    """Pairs of different roots that share a shingle which leaves enough common ones possible."""
    apart = prefixes.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("token")
    rest = stored(lookup(prefixes, apart, ["token"]), "prefixes")
    x, y = rest.alias("x"), rest.alias("y")
    both = F.col("x.size") + F.col("y.size")
    possible = F.least(F.col("x.size") - F.col("x.place"), F.col("y.size") - F.col("y.place"))
    meets = (F.col("x.token") == F.col("y.token")) & (F.col("x.root") < F.col("y.root"))
    crossed = x.join(y, meets & _fits(F.col("x.size"), F.col("y.size"), least) & (possible >= both * F.lit(least / (1 + least)) - 1e-9))
    return crossed.select(F.greatest("x.node", "y.node").alias("a"), F.least("x.node", "y.node").alias("b")).distinct()


def _print_bands(prints: DataFrame) -> DataFrame:
    """(node, size, band) of (node, size, fp): a band for each component of fingerprints that Golay keys link."""
    roots = simhash.with_roots(stored(prints.select("fp").distinct(), "distinct-prints"))
    band = F.xxhash64(F.lit("simhash"), F.col("root"))
    return lookup(prints, roots, ["fp"]).select("node", "size", band.alias("band")).distinct()


def links(nodes: DataFrame, prints: DataFrame, rows: DataFrame, width: int, least: float) -> DataFrame:
    """Edges (a, b) that connect all nodes joined by pairs that share a band, or a component of fingerprints, and are alike.

    ``nodes`` holds (node, key, size, bands), ``prints`` (node, size, fp), where a
    node may have several, and ``rows`` (key, text).
    """
    spread = nodes.select("node", "size", F.explode("bands").alias("band")).unionByName(stored(_print_bands(prints), "print-bands"))
    counts = spread.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = stored(lookup(spread, counts, ["band"]), "bands")
    wanted = met.select("node").distinct().join(nodes.select("node", "key"), "node")
    sets = _sets(rows.select("key", "text").join(wanted, "key"), width)
    sets = stored(sets.groupBy("node").agg(F.first("hashes").alias("hashes")), "sets")
    found = stored(_alike(stored(_hub_pairs(met, least), "hub-pairs"), sets, least), "alike")
    rooted = stored(_with_roots(met.select("band", "node"), found), "rooted")
    apart = rooted.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("band")
    left = stored(lookup(rooted, apart, ["band"]).select("node", "root").distinct(), "left-apart")
    prefixes = stored(rare_prefixes(sets.join(left, "node"), least), "rare-prefixes")
    pairs = stored(_crossing_pairs(prefixes, least), "crossed")
    return found.unionByName(_alike(pairs, sets, least))


def near_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, least: float = SIMILARITY
) -> DataFrame:
    """(id, component_id) of every row.

    component_id is the least id reachable over texts whose shingles of
    ``width`` words (in lower case) have similarity ``least`` or more, the
    row's own included. Fewer words than ``width`` are one shingle. Rows
    without words are alike. A null id names a component only if all are null.
    """
    rows = _rows(docs, id_col, text_col)
    sketched = stored(_sketched(rows, width), "sketches")
    nodes = sketched.groupBy("name").agg(F.min("id").alias("low"), F.min("key").alias("key"), F.first("size").alias("size"), F.first("bands").alias("bands"))
    nodes = stored(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    # Equal sets with other repeats have other fingerprints.
    prints = sketched.select("name", "fp").distinct().join(nodes.select("name", "node", "size"), "name")
    prints = stored(prints.select("node", "size", "fp"), "prints")
    near = stored(links(nodes.select("node", "key", "size", "bands"), prints, rows, width, least), "near-links")
    rooted = stored(_with_roots(nodes.select("node", "name", "low"), near), "rooted-nodes")
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = lookup(rooted, lowest, ["root"]).select("name", "component_id")
    return lookup(sketched.select("id", "name"), named, ["name"]).select("id", "component_id")

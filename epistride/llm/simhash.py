"""SimHash fingerprints, linked through Golay-code keys.

A fingerprint's 64 bits are three segments of 22, 21 and 21 bits. Of two
fingerprints that differ in at most four bits, the two least damaged segments
differ in at most two bits together, so some word lies within one flip of both
over these two segments. Every fingerprint therefore gets, for each pair of
segments, the Golay codeword indices that itself and its one-bit neighbours
decode to; two linked fingerprints share a key. A key's fingerprints are then
compared bit by bit.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from epistride.llm.arrow import prepared, record_batch, slices
from epistride.llm.keyed import components, row_key, spread_lookup
from epistride.session import stored

SHINGLE = 4
SEED = 42
DISTANCE = 4
SEGMENTS = (22, 21, 21)
#: A key with more fingerprints is not compared pair by pair; its fingerprints meet under wider keys, and at last at midpoints.
DENSE = 1024
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_PIECE = 1 << 20

# The generator polynomial of the binary Golay code of length 23.
GOLAY_GENERATOR = 0b110001110101
GOLAY_LENGTH = 23


def _word_pieces(data: bytes, width: int) -> Iterator[list[bytes]]:
    """The text's words, in runs that overlap by ``width - 1`` words."""
    kept: list[bytes] = []
    start = 0
    while start < len(data):
        end = len(data)
        if start + _PIECE < end:
            found = _SPACE.search(data, start + _PIECE)
            end = found.end() if found else end
        words = kept + data[start:end].split()
        start = end
        if len(words) >= width or start == len(data):
            yield words
            kept = words[len(words) - width + 1 :]
        else:
            kept = words


def shingle_hashes(data: bytes, width: int) -> Iterator[np.ndarray]:
    """The hashes (uint64) of the text's word shingles, a run at a time; fewer words than ``width`` are one shingle."""
    digest, total = xxhash.xxh64_intdigest, 0
    for words in _word_pieces(data, width):
        if not words or (len(words) < width and total):
            continue
        joined = b" ".join(words)
        at = [0, *accumulate(len(w) + 1 for w in words)]
        if len(words) < width:
            hashes = [digest(joined, SEED)]
        else:
            hashes = [digest(joined[a : b - 1], SEED) for a, b in zip(at, at[width:])]
        total += len(hashes)
        yield np.array(hashes, np.uint64)


def print_of(runs: Iterable[np.ndarray]) -> int:
    """The SimHash of a text's shingle hashes, repeats included; 0 where there are none."""
    ones, total = np.zeros(64, np.int64), 0
    for hashes in runs:
        bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
        total += len(hashes)
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big") if total else 0


def fingerprint(data: bytes) -> int:
    """The SimHash of a text's word shingles; 0 where it has no word."""
    return print_of(shingle_hashes(data.lower(), SHINGLE))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) of every row; null and wordless texts have fingerprint 0."""
    plain = prepared(docs, id_col, text_col)
    kind = plain.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in slices(batches):
            prints = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(prints)], names=["id", "fp"])

    return plain.mapInArrow(run, f"id {kind}, fp long")


def _golay() -> tuple[np.ndarray, np.ndarray]:
    """Syndromes of the unit words, and for each syndrome the error of weight 3 at most."""
    units = []
    for bit in range(GOLAY_LENGTH):
        word = 1 << bit
        for high in range(bit, GOLAY_LENGTH - 13, -1):
            if word >> high & 1:
                word ^= GOLAY_GENERATOR << (high - 11)
        units.append(word)
    errors = np.zeros(1 << 11, np.int64)
    for i in range(GOLAY_LENGTH):
        errors[units[i]] = 1 << i
        for j in range(i):
            errors[units[i] ^ units[j]] = 1 << i | 1 << j
            for k in range(j):
                errors[units[i] ^ units[j] ^ units[k]] = 1 << i | 1 << j | 1 << k
    return np.array(units, np.int64), errors


UNITS, ERRORS = _golay()


def codeword_index(words: np.ndarray) -> np.ndarray:
    """The 12 message bits of the codeword nearest to each 23-bit word."""
    syndrome = np.zeros_like(words)
    for bit in range(GOLAY_LENGTH):
        syndrome ^= (words >> bit & 1) * UNITS[bit]
    return (words ^ ERRORS[syndrome]) >> 11


def golay_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) for every fingerprint's distinct keys; ``prints`` is uint64."""
    parts, shift = [], np.uint64(0)
    for width in SEGMENTS:
        parts.append((prints >> shift & np.uint64((1 << width) - 1)).astype(np.int64))
        shift += np.uint64(width)
    own = [codeword_index(p) for p in parts]
    near = [np.stack([codeword_index(p ^ (1 << i)) for i in range(w)]) for p, w in zip(parts, SEGMENTS)]
    rows, keys = [], []
    for number, (a, b) in enumerate(((0, 1), (0, 2), (1, 2))):
        base = number << 24
        keys += [base | own[a] << 12 | own[b], (base | near[a] << 12 | own[b]).ravel(), (base | own[a] << 12 | near[b]).ravel()]
    span = np.arange(len(prints))
    for k in keys:
        rows.append(np.tile(span, len(k) // max(1, len(prints))))
    pairs = np.unique(np.concatenate(rows) << 26 | np.concatenate(keys))
    return pairs >> 26, pairs & ((1 << 26) - 1)


def wide_keys(prints: np.ndarray, number: np.ndarray) -> np.ndarray:
    """For each print and pair of segments, all words within one bit of the pair's bits, one row each.

    Two prints that meet under a Golay key differ in at most two bits of its
    two segments, so they share one. The third segment holds the pair's number,
    which keeps most words of different pairs apart.
    """
    out = np.zeros((len(prints), 1 + SEGMENTS[0] + SEGMENTS[1]), np.uint64)
    for pair, third in enumerate((2, 1, 0)):
        start, mine = sum(SEGMENTS[:third]), number == pair
        inside = [bit for bit in range(64) if not start <= bit < start + SEGMENTS[third]]
        mask = np.uint64(sum(1 << bit for bit in inside))
        flips = np.array([0] + [1 << bit for bit in inside], np.uint64)
        flips = np.r_[flips, np.zeros(out.shape[1] - len(flips), np.uint64)]
        out[mine] = ((prints[mine] & mask)[:, None] ^ flips[None, :]) | np.uint64((pair + 1) << start)
    return out


def midpoints(prints: np.ndarray) -> np.ndarray:
    """All words within two bits of each fingerprint, one row each; two prints within four bits share one."""
    flips = [0] + [1 << i for i in range(64)] + [1 << i | 1 << j for i in range(64) for j in range(i)]
    return prints[:, None] ^ np.array(flips, np.uint64)[None, :]


def _hook(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merge the trees of the linked rows; every label ends as its tree's least row."""
    while len(a):
        ra, rb = label[a], label[b]
        apart = ra != rb
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(label, np.maximum(ra, rb), np.minimum(ra, rb))
        while (label != (jump := label[label])).any():
            label[:] = jump


def links_within(key: np.ndarray, prints: np.ndarray) -> np.ndarray:
    """For rows sorted by key, the least row each is linked to inside its key.

    Rows are compared with the row d places on, for d = 1, 2, ... while keys agree.
    """
    label = np.arange(len(key))
    left = np.flatnonzero(key[1:] == key[:-1])
    step = 1
    while len(left):
        differ = np.bitwise_count(prints[left] ^ prints[left + step])
        close = left[differ <= DISTANCE]
        if len(close):
            _hook(label, close, close + step)
        step += 1
        left = left[left + step < len(key)]
        left = left[key[left] == key[left + step]]
    return label


def _bucket_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links inside each key of a partition sorted by key; dense keys give their rows back, with the key and b null."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("key", pa.int64())])
    keys, prints = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    dense = None

    def solve(keys, prints):
        start = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, int)
        size = np.diff(np.r_[start, len(keys)])
        heavy = np.repeat(size > DENSE, size)
        label = links_within(keys[~heavy], prints[~heavy])
        own = prints[~heavy].view(np.int64)
        moved = label != np.arange(len(label))
        given = prints[heavy].view(np.int64)
        found = pa.concat_arrays([pa.array(own[label][moved]), pa.nulls(len(given), pa.int64())])
        under = pa.concat_arrays([pa.nulls(int(moved.sum()), pa.int64()), pa.array(keys[heavy])])
        return pa.RecordBatch.from_arrays([pa.array(np.r_[own[moved], given]), found, under], schema=schema)

    for batch in batches:
        keys = np.r_[keys, batch.column("key").to_numpy().astype(np.int64)]
        prints = np.r_[prints, batch.column("fp").to_numpy().view(np.uint64)]
        if dense is not None:  # the rest of a key already known as dense
            rest = int(np.searchsorted(keys, dense, "right"))
            if rest:
                yield record_batch(schema, [prints[:rest].view(np.int64), [None] * rest, keys[:rest]])
            keys, prints = keys[rest:], prints[rest:]
        if not len(keys):
            continue
        last = int(np.searchsorted(keys, keys[-1], "left"))
        if len(keys) - last > DENSE:
            dense, last = keys[-1], len(keys)
        if last:
            yield solve(keys[:last], prints[:last])
        keys, prints = keys[last:], prints[last:]
    if len(keys):
        yield solve(keys, prints)


def _tied_to_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges from each fingerprint to the least one at the same midpoint; rows come sorted by word."""
    word, first = None, 0
    for batch in batches:
        words, prints = batch.column("word").to_numpy(), batch.column("fp").to_numpy()
        start = np.r_[True, words[1:] != words[:-1]]
        head = prints[start][np.cumsum(start) - 1]
        if len(words) and words[0] == word:
            head[words == word] = first
        if len(words):
            word, first = words[-1], head[-1]
        edges = np.unique(np.stack([prints, head], axis=1)[prints != head], axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], names=["a", "b"])


def fingerprint_links(prints: DataFrame) -> DataFrame:
    """Edges (a, b) between distinct fingerprints ``fp`` that connect all within ``DISTANCE`` bits.

    Not every pair is returned: inside a key each fingerprint is tied to the
    least of those it is linked to, which keeps all connections.
    """
    spark = prints.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def keyed(batches):
        schema = pa.schema([("key", pa.int32()), ("fp", pa.int64())])
        for batch in batches:
            fp = batch.column("fp").to_numpy()
            for start in range(0, len(fp), 1_000):
                part = fp[start : start + 1_000]
                row, key = golay_keys(part.view(np.uint64))
                yield record_batch(schema, [key.astype(np.int32), part[row]])

    def middles(batches):
        for batch in batches:
            fp = batch.column("fp").to_numpy()
            for start in range(0, len(fp), 200):
                part = fp[start : start + 200]
                words = midpoints(part.view(np.uint64)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(words.ravel()), pa.array(np.repeat(part, words.shape[1]))], names=["word", "fp"])

    def widened(batches):
        for batch in batches:
            fp, key = batch.column("a").to_numpy(), batch.column("key").to_numpy()
            for start in range(0, len(fp), 4_000):
                part = fp[start : start + 4_000]
                words = wide_keys(part.view(np.uint64), key[start : start + 4_000] >> 24).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(words.ravel()), pa.array(np.repeat(part, words.shape[1]))], names=["key", "fp"])

    def linked(rows: DataFrame) -> DataFrame:
        rows = rows.repartition(parts, "key").sortWithinPartitions("key")
        return stored(rows.mapInArrow(_bucket_links, "a long, b long, key long").distinct(), "bucket-links")

    found = linked(prints.select("fp").mapInArrow(keyed, "key int, fp long"))
    wide = linked(found.filter("b is null").mapInArrow(widened, "key long, fp long").distinct())
    crowded = wide.filter("b is null").select(F.col("a").alias("fp")).distinct()
    met = crowded.repartition(parts, "fp").mapInArrow(middles, "word long, fp long")
    met = met.repartition(parts, "word").sortWithinPartitions("word", "fp")
    tied = met.mapInArrow(_tied_to_first, "a long, b long").distinct()
    return found.unionByName(wide).filter("b is not null").select("a", "b").distinct().unionByName(tied)


def with_roots(prints: DataFrame) -> DataFrame:
    """``prints``, one row for each ``fp``, with ``root``: the least fingerprint reachable over links, or itself."""
    roots = components(fingerprint_links(prints.select("fp")))
    return prints.join(roots, prints.fp == roots.node, "left").drop("node").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, component_id) of every row.

    component_id is the least id whose fingerprint is reachable over links of
    at most four bits, the row's own included. Rows without words have
    fingerprint zero and are linked like others; repeated rows come back as
    often as given; a null id never becomes a component's id unless all are null.
    """
    prints = stored(fingerprints(docs, id_col, text_col), "fingerprints")
    least_id = stored(prints.groupBy("fp").agg(F.min("id").alias("low")), "distinct-prints")
    rooted = with_roots(least_id)
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = spread_lookup(rooted, lowest, ["root"], ["fp"]).select("fp", "component_id")
    return spread_lookup(prints, named, ["fp"], ["id"]).select(
        "id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", near: Callable[[DataFrame, str, str], DataFrame] = near_duplicates
) -> DataFrame:
    """One row of each component, that of the least id, with all its columns.

    ``near`` gives (id, component_id) of every row. Rows count as what their id
    and text are: other rows that repeat an id, or have none, stay unless they
    belong to the same component. Null ids come last, equal ids by a digest.
    """
    key = row_key(id_col, text_col)
    named = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), key.alias("key"))
    found = near(docs.select(named.alias("id"), F.col(text_col).alias("text")), "id", "text")
    kept = found.filter(F.col("component_id") == F.col("id")).groupBy(F.col("id.key").alias("_kept")).agg(F.count(F.lit(1)).alias("_n"))
    kept = stored(kept, "kept")
    keyed = docs.withColumn("_row_key", key)
    single = keyed.join(kept.filter("_n = 1"), F.col("_row_key") == F.col("_kept"), "left_semi")
    repeated = keyed.join(kept.filter("_n > 1"), F.col("_row_key") == F.col("_kept"), "left_semi")
    return single.union(repeated.dropDuplicates(["_row_key"])).drop("_row_key")

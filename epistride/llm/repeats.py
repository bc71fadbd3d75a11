"""Removal of byte strings that occur more than once, by merged shard transforms over sampled suffixes.

Every string of ``LENGTH`` bytes contains an anchor: the least hashed of its
32-byte pieces, leftmost of equals. Equal strings have equal anchors at equal
places, so only suffixes that start at anchors, about one byte in 70, need to
be ordered. A shard (a part of the documents) yields for each of its anchors
the suffix's first symbol (the 32 bytes at the anchor) and the rest of its
context: the suffix's further bytes and, as in a Burrows-Wheeler transform,
the bytes that precede it.

The shards' lists are merged by refining their interleave: rows are placed by
the first symbol, and rows of one block by the next; a block of one row is
settled. Neighbours in the merged order give the common prefixes. Rows whose
whole context recurs are repeated. Blocks that agree in the first symbol only
are refined further over the bytes themselves, eight at a time, which yields
the length of the common prefix; the strings that this length allows are then
compared with the preceding bytes included.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from epistride.llm.arrow import record_batch, slices
from epistride.llm.terms import _power, mixed
from epistride.session import stored

LENGTH = 200
PIECE = 32
_STARTS = LENGTH - PIECE + 1
#: Anchors are searched in buffers of at most 2^20 bytes; places within them take the low bits of a hash.
_PLACE_BITS = 20
_BUFFER = 1 << _PLACE_BITS
_LOW = np.uint64(_BUFFER - 1)
#: A task compares at most so many contexts of one symbol; larger blocks are refined by wider symbols first.
CROWDED = 20_000
#: Each refinement cuts the range of starts that share a symbol into so many.
_CUTS = 4
#: Rows that a task merges.
ROWS_PER_TASK = 400_000
#: Compressed bytes that a task opens at a time.
_PACKED_BYTES = 1 << 20
_GOLD = np.uint64(0x9E3779B97F4A7C15)

#: Removed strings in a compact form: first start, number of starts less one, anchor's place behind the first start.
_KEYED = pa.schema([("key", pa.int64()), ("place", pa.int64()), ("first", pa.int64()), ("rest", pa.int64())])


def _prefix_sums(raw: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw + np.uint64(1)) * _power("up", len(raw))[: len(raw)], out=sums[1:])
    return sums


def _span_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return (sums[end] - sums[start]) * _power("down", len(sums))[start]


def _anchors(buffer: bytes, ends: np.ndarray) -> tuple[np.ndarray, ...] | None:
    """(first start, last start, anchor, first symbol, whole context) for the runs of strings with one anchor.

    ``ends`` are the ends of the texts in the buffer; strings do not cross them.
    """
    raw = np.frombuffer(buffer, np.uint8)
    if len(raw) < LENGTH:
        return None
    sums, down = _prefix_sums(raw), _power("down", len(raw) + 1)
    symbol = mixed((sums[PIECE:] - sums[:-PIECE]) * down[: len(raw) - PIECE + 1])
    placed = (symbol & ~_LOW) | np.arange(len(symbol), dtype=np.uint64)
    # The least of every _STARTS neighbours: from the block's end backwards, and into the next block.
    blocks = -(-len(placed) // _STARTS)
    padded = np.full(blocks * _STARTS, np.iinfo(np.uint64).max)
    padded[: len(placed)] = placed
    padded = padded.reshape(blocks, _STARTS)
    into = np.minimum.accumulate(padded, axis=1).ravel()
    back = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    count = len(raw) - LENGTH + 1
    anchor = (np.minimum(back[:count], into[_STARTS - 1 : _STARTS - 1 + count]) & _LOW).astype(np.int64)
    # Strings that end in their own text.
    starts = np.r_[0, ends[:-1]]
    inside = np.zeros(count + 1, np.int64)
    valid = ends - starts >= LENGTH
    np.add.at(inside, starts[valid], 1)
    np.add.at(inside, ends[valid] - LENGTH + 1, -1)
    at = np.flatnonzero(np.cumsum(inside[:-1]))
    if not len(at):
        return None
    own = anchor[at]
    head = np.r_[True, (own[1:] != own[:-1]) | (at[1:] != at[:-1] + 1)]
    first = at[head]
    last = at[np.r_[np.flatnonzero(head)[1:], len(at)] - 1]
    own = own[head]
    shape = ((own - first) << 8 | (last - first)).astype(np.uint64)
    whole = mixed(_span_hashes(sums, first, last + LENGTH) + shape * _GOLD)
    return first, last, own, symbol[own], whole


def _buffers(keys: list[int], texts: list[bytes]) -> Iterator[tuple[bytes, list[int], np.ndarray, list[int]]]:
    """(buffer, keys, ends, offsets): texts side by side; a longer text in parts that overlap by ``LENGTH - 1`` bytes."""
    held, names, offsets, size = [], [], [], 0
    for key, text in zip(keys, texts):
        for start in range(0, max(1, len(text) - LENGTH + 1), _BUFFER - LENGTH + 1):
            part = text[start : start + _BUFFER]
            if len(part) < LENGTH:
                continue
            if size + len(part) > _BUFFER:
                yield b"".join(held), names, np.cumsum([len(h) for h in held]), offsets
                held, names, offsets, size = [], [], [], 0
            held.append(part)
            names.append(key)
            offsets.append(start)
            size += len(part)
    if held:
        yield b"".join(held), names, np.cumsum([len(h) for h in held]), offsets


def _shard_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A shard's anchors in the order of their symbols."""
    for batch in slices(batches):
        for buffer, keys, ends, offsets in _buffers(batch.column("key").to_pylist(), batch.column("text").to_pylist()):
            found = _anchors(buffer, ends)
            if found is None:
                continue
            first, last, anchor, symbol, whole = found
            text = np.searchsorted(ends, first, "right")
            start = first - np.r_[0, ends[:-1]][text] + np.array(offsets, np.int64)[text]
            place = start << 16 | (last - first) << 8 | (anchor - first)
            order = np.lexsort((whole, symbol))
            columns = (np.array(keys, np.int64)[text], place, symbol.view(np.int64), whole.view(np.int64))
            yield record_batch(_KEYED, [c[order] for c in columns])


def refine(order: np.ndarray, block: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One round: rows of a block are placed by their next symbol, rows already alone stay.

    ``order`` lists rows, ``block`` the number of each place's block. Equal
    symbols keep the order they had.
    """
    head = np.r_[True, block[1:] != block[:-1]]
    alone = head & np.r_[head[1:], True]
    open_at = np.flatnonzero(~alone)
    moved = order[open_at]
    # Blocks keep their places; within a block a stable placement by symbol.
    to = np.lexsort((symbol[moved], block[open_at]))
    order = order.copy()
    order[open_at] = moved[to]
    key = symbol[order]
    head = head | np.r_[True, key[1:] != key[:-1]]
    return order, np.cumsum(head) - 1


_STATES = "part int, edge int, key long, place long, first long, rest long, repeated boolean, asked boolean"


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One range of the merged order: rows that recur whole, and rows whose first symbol alone recurs.

    The first and last row of the range come back in any case (edge 1, 2, or 3
    for both), since a neighbour may stand in another range.
    """
    from pyspark import TaskContext

    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    table = pa.Table.from_batches(batches)
    first, rest = table.column("first").to_numpy(), table.column("rest").to_numpy()
    order, block = np.arange(len(first)), np.zeros(len(first), np.int64)
    order, block = refine(order, block, first)
    outer = block
    order, block = refine(order, block, rest)
    same_first = outer[1:] == outer[:-1]
    same_rest = block[1:] == block[:-1]
    recurs = np.r_[same_first, False] | np.r_[False, same_first]
    repeated = np.r_[same_rest, False] | np.r_[False, same_rest]
    # One row of each repeated context answers for it where its block holds other contexts.
    head = np.r_[True, ~same_rest]
    mixed_block = np.bincount(outer, head)[outer] > 1
    edge = np.zeros(len(order), np.int32)
    edge[0] |= 1
    edge[-1] |= 2
    asked = np.where(repeated, head & mixed_block, recurs)
    keep = np.flatnonzero(recurs | (edge > 0))
    rows = order[keep]
    part = np.full(len(rows), TaskContext.get().partitionId(), np.int32)
    names = ["part", "edge", "key", "place", "first", "rest", "repeated", "asked"]
    keys, places = table.column("key").to_numpy(), table.column("place").to_numpy()
    columns = [part, edge[keep], keys[rows], places[rows], first[rows], rest[rows], repeated[keep], asked[keep]]
    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)


def merge_shards(rows: DataFrame) -> DataFrame:
    """Rows (key, place, first, rest) whose first symbol recurs, with ``repeated`` (the rest recurs too) and ``asked``.

    Rows are dealt to ranges of (first, rest), so that a symbol or context
    that very many rows share is split; the rows at the ranges' edges, two for
    each, are settled by the driver.
    """
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // ROWS_PER_TASK))
    ranged = rows.repartitionByRange(parts, "first", "rest", "key", "place")
    merged = stored(ranged.mapInArrow(_merged, _STATES), "merged")
    edges = [r.asDict() for r in merged.filter("edge > 0").collect()]
    edges.sort(key=lambda r: (r["part"], r["edge"]))
    for before, after in zip(edges, edges[1:]):
        if before["part"] != after["part"] and before["first"] == after["first"]:
            alike = before["rest"] == after["rest"]
            for row in (before, after):
                row["repeated"] = row["repeated"] or alike
                row["asked"] = True
    for row in edges:
        # What is asked for needlessly costs little and changes nothing.
        row["asked"] = row["asked"] or row["repeated"]
    settled = spark.createDataFrame([tuple(r[c] for c in merged.columns) for r in edges if r["asked"] or r["repeated"]], merged.schema)
    return merged.filter("edge = 0").union(settled).select("key", "place", "first", "repeated", "asked")


def _word_matrix(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The bytes from start to end of each row as big-endian words of eight, zeros behind."""
    width = -(-LENGTH // 8) * 8
    at = start[:, None] + np.arange(width)[None, :]
    picked = np.where(at < end[:, None], data[np.minimum(at, len(data) - 1)], 0).astype(np.uint8)
    return np.ascontiguousarray(picked).view(">u8").astype(np.uint64)


def common_prefixes(group: np.ndarray, words: np.ndarray) -> np.ndarray:
    """For each row the longest common prefix, in bytes, with any other row of its group.

    Rows come sorted by group. Each round refines the interleave by the next
    word; where two neighbours part, the round and the word give the length.
    """
    order, block = np.arange(len(group)), np.cumsum(np.r_[True, group[1:] != group[:-1]]) - 1
    settled = np.full(max(0, len(group) - 1), -1, np.int64)
    settled[block[1:] != block[:-1]] = 0
    for number in range(words.shape[1]):
        order, refined = refine(order, block, words[:, number])
        parted = (refined[1:] != refined[:-1]) & (settled < 0)
        if parted.any():
            a, b = words[order[:-1][parted], number], words[order[1:][parted], number]
            differ = a ^ b
            same = np.zeros(len(differ), np.int64)
            for byte in range(1, 8):
                same += differ >> np.uint64(64 - 8 * byte) == 0
            settled[parted] = 8 * number + same
        block = refined
        if len(np.unique(block)) == len(block):
            break
    settled[settled < 0] = LENGTH
    longest = np.maximum(np.r_[settled, 0], np.r_[0, settled])
    out = np.zeros(len(group), np.int64)
    out[order] = longest
    return out


def _starts(row: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, number) for all numbers from low to high of each row."""
    count = np.maximum(0, high - low + 1)
    rows = np.repeat(row, count)
    return rows, np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)


class _Contexts:
    """Contexts of one batch: bytes around anchors, and hashes of parts of them.

    ``low`` and ``high`` bound how many bytes before its anchor a string may start.
    """

    def __init__(self, batch: pa.Table | pa.RecordBatch) -> None:
        column = lambda c: np.asarray(batch.column(c))
        self.key, self.first, self.asker = column("key"), column("first"), ~column("repeated").astype(bool)
        place = column("place")
        self.start, self.before = place >> 16, place & 255
        self.low, self.high = column("low").astype(np.int64), column("high").astype(np.int64)
        texts = batch.column("context").to_pylist()
        size = np.array([len(t) for t in texts], np.int64)
        self.end = np.cumsum(size)
        self.begin = self.end - size
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        self.sums = _prefix_sums(self.data)

    def parts(self, row: np.ndarray, back: np.ndarray, ahead: np.ndarray) -> np.ndarray:
        """Hash of the bytes from ``back`` before the row's anchor to ``ahead`` behind its start."""
        at = self.begin[row] + self.before[row]
        hashed = _span_hashes(self.sums, at - back, at + ahead) + (back << 16 | ahead).astype(np.uint64) * _GOLD
        return mixed(hashed ^ mixed(self.first[row].view(np.uint64)))


def _repeated_starts(batch: pa.Table) -> pa.RecordBatch:
    """Runs of the asking rows' strings that another context has too; contexts come sorted by first symbol."""
    c = _Contexts(batch)
    words = _word_matrix(c.data, c.begin + c.before, c.end)
    longest = common_prefixes(c.first, words)
    row, back = _starts(np.arange(len(c.key)), np.maximum(c.low, LENGTH - longest), c.high)
    _, which, times = np.unique(c.parts(row, back, LENGTH - back), return_inverse=True, return_counts=True)
    hit = (times[which] > 1) & c.asker[row]
    # Starts grow as ``back`` falls; neighbours of one row make a run.
    row, start = row[hit][::-1], (c.start[row] + c.before[row] - back)[hit][::-1]
    head = np.r_[True, (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)][: len(row)]
    last = np.r_[np.flatnonzero(head)[1:], len(row)][: head.sum()] - 1
    return pa.RecordBatch.from_arrays([pa.array(c.key[row[head]]), pa.array(start[head]), pa.array(start[last] + LENGTH)], names=["key", "start", "end"])


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole blocks of contexts, some ten thousand rows at a time; rows come sorted by first symbol."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        if count < 10_000:
            continue
        table = pa.Table.from_batches(held)
        first = table.column("first").to_numpy()
        cut = int(np.searchsorted(first, first[-1], "left"))
        if cut:
            yield _repeated_starts(table.slice(0, cut))
        held = table.slice(cut).to_batches()
        count = len(first) - cut
    if held:
        yield _repeated_starts(pa.Table.from_batches(held))


_CONTEXTS = "key long, place long, first long, repeated boolean, low int, high int, context binary"


def _refined(contexts: DataFrame, width: int) -> DataFrame:
    """The contexts once for each range of ``width`` starts, under the symbol that all strings of the range hold.

    Strings that start ``low`` to ``high`` bytes before the anchor have the
    bytes from ``low`` before it to ``LENGTH - high`` behind it in common: a
    wider symbol, of ``LENGTH - width + 1`` bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "context"):
            c = _Contexts(batch)
            row, number = _starts(np.arange(len(c.key)), c.low // width, c.high // width)
            low, high = number * width, np.minimum(number * width + width - 1, _STARTS - 1)
            symbol = c.parts(row, low, LENGTH - high).view(np.int64)
            taken = batch.take(pa.array(row))
            columns = [taken.column("key"), taken.column("place"), pa.array(symbol), taken.column("repeated"),
                       pa.array(np.maximum(low, c.low[row]).astype(np.int32)), pa.array(np.minimum(high, c.high[row]).astype(np.int32)), taken.column("context")]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "place", "first", "repeated", "low", "high", "context"])

    return contexts.mapInArrow(run, _CONTEXTS)


def repeated_in_contexts(contexts: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """(key, start, end) of the asking contexts' strings that another context of the same symbol has.

    A block of contexts is compared in one task. A block above ``crowded`` is
    refined by wider symbols first, which leaves contexts alone that share no
    more than the narrow one, until a symbol is the string itself.
    """
    spark = contexts.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    width, out = _STARTS, None
    while True:
        sizes = stored(contexts.groupBy("first").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > max(1, crowded)), "crowded")
        is_crowded = contexts.join(sizes, "first", "left")
        near = is_crowded.filter("n is null").drop("n").repartition(parts, "first").sortWithinPartitions("first")
        near = near.mapInArrow(_compared, "key long, start long, end long")
        out = near if out is None else out.union(near)
        if sizes.isEmpty():
            return out
        full = is_crowded.filter("n is not null").drop("n")
        if width == 1:
            # The symbol is the string, and more than one context has it.
            start = F.expr("shiftright(place, 16) + (place & 255) - low")
            return out.union(full.filter("not repeated").select("key", start.alias("start"), (start + LENGTH).alias("end")))
        width = -(-width // _CUTS)
        contexts = stored(_refined(full, width), "refined-contexts")


def _packed(docs: DataFrame) -> DataFrame:
    """(key, id, data): texts compressed for the way through a shuffle."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", 1)
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            sizes = pa.array([len(t) for t in texts], pa.int64())
            data = pa.array([codec.compress(t, asbytes=True) for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("id"), sizes, data], names=["key", "id", "n", "data"])

    return docs.select("key", "id", "text").mapInArrow(run, f"key long, id {kind}, n long, data binary")


def _unpacked(batch: pa.RecordBatch) -> Iterator[bytes]:
    codec = pa.Codec("zstd", 1)
    for size, data in zip(batch.column("n").to_pylist(), batch.column("data").to_pylist()):
        yield codec.decompress(data, size, asbytes=True) if size else b""


def _cut_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [("key", pa.int64()), ("place", pa.int64()), ("first", pa.int64()), ("repeated", pa.bool_()), ("low", pa.int32()), ("high", pa.int32()), ("context", pa.binary())]
    schema = pa.schema(kinds)
    for batch in slices(batches, "data", _PACKED_BYTES):
        out: list[tuple] = []
        for key, text, wanted in zip(batch.column("key").to_pylist(), _unpacked(batch), batch.column("wanted").to_pylist()):
            for w in wanted:
                start, more, before = w["place"] >> 16, w["place"] >> 8 & 255, w["place"] & 255
                out.append((key, w["place"], w["first"], w["repeated"], before - more, before, text[start : start + more + LENGTH]))
            if len(out) > 10_000:
                yield record_batch(schema, list(zip(*out)))
                out = []
        if out:
            yield record_batch(schema, list(zip(*out)))


def repeated_ranges(docs: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """(key, start, end) of byte ranges whose every byte lies in a string that occurs elsewhere too.

    ``docs`` has key (one per distinct row), id and text (binary, not null).
    Ranges of a key may overlap.
    """
    shards = stored(docs.select("key", "text").mapInArrow(_shard_rows, "key long, place long, first long, rest long"), "shard-order")
    merged = stored(merge_shards(shards), "merged-order")
    start = F.expr("shiftright(place, 16)")
    whole = merged.filter("repeated").select("key", start.alias("start"), (start + F.expr("shiftright(place, 8) & 255") + LENGTH).alias("end"))
    wanted = merged.filter("asked").groupBy("key").agg(F.collect_list(F.struct("place", "first", "repeated")).alias("wanted"))
    fetched = _packed(docs).join(stored(wanted, "wanted"), "key")
    contexts = stored(fetched.select("key", "n", "data", "wanted").mapInArrow(_cut_contexts, _CONTEXTS), "contexts")
    return whole.union(repeated_in_contexts(contexts, crowded))


def _joined_ranges(ranges: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of the maximal runs that each row's ranges cover, in order."""
    listed = ranges.fill_null([]) if ranges.null_count else ranges
    row = np.repeat(np.arange(len(listed)), np.diff(listed.offsets.to_numpy()))
    flat = listed.flatten()
    start, end = (np.asarray(flat.field(name)) for name in ("start", "end"))
    order = np.lexsort((start, row))
    row, start, end = row[order], start[order], end[order]
    if not len(row):
        return row, start, end
    # Rows one behind the other on one line: what has been reached so far then never leads into the next row.
    shift = row * (int(end.max()) + 2)
    reach = np.maximum.accumulate(end + shift)
    head = np.r_[True, (start + shift)[1:] > reach[:-1]]
    last = np.r_[np.flatnonzero(head)[1:], len(row)] - 1
    return row[head], start[head], reach[last] - shift[last]


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", crowded: int = CROWDED, keep_bytes: bool = True) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept, kept_sha256) of every row.

    Each byte goes that lies in a string of ``LENGTH`` bytes which starts
    anywhere else in the table too, overlaps and the same text included. Null
    counts as empty; a text below the length stays whole; rows that repeat id
    and text are texts of their own and so lose all but short texts. ``kept``
    may be cut from inside a character; without ``keep_bytes`` it is null.
    """
    plain = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("s"))
    plain = plain.select("id", F.xxhash64("id", "s").alias("key"), F.col("s").cast("binary").alias("text"))
    ranges = repeated_ranges(plain, crowded).groupBy("key").agg(F.collect_set(F.struct("start", "end")).alias("ranges"))
    joined = _packed(plain).join(stored(ranges, "ranges"), "key", "left").select("id", "n", "data", "ranges")
    kind = plain.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "data", _PACKED_BYTES):
            row, start, end = _joined_ranges(batch.column("ranges"))
            count = batch.num_rows
            removed = np.bincount(row, end - start, count).astype(np.int64)
            at = np.searchsorted(row, np.arange(count + 1))
            kept = []
            for text, a, b in zip(_unpacked(batch), at, at[1:]):
                if a < b:
                    edges = [0, *np.stack([start[a:b], end[a:b]], axis=1).ravel().tolist(), len(text)]
                    text = b"".join([text[x:y] for x, y in zip(edges[::2], edges[1::2])])
                kept.append(text)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    batch.column("n"),
                    pa.array(removed),
                    pa.array(np.diff(at).astype(np.int64)),
                    pa.array(kept, pa.binary()) if keep_bytes else pa.nulls(count, pa.binary()),
                    pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
                ],
                names=["id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"],
            )

    return joined.mapInArrow(run, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")

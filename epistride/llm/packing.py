"""Token ids of whole texts, packed best-fit-decreasing into rows of fixed length.

Every text becomes token ids of a public tokenizer and an end mark; a longer
document is split losslessly into pieces of the row length. A row of the packed
matrix holds whole pieces: each goes to the row with the least room that still
fits it, found in a segment tree over the possible rooms.
"""

from __future__ import annotations

import base64
import re
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from epistride.llm.arrow import prepared, record_batch, slices
from epistride.llm.keyed import numbered_copies

ROW_TOKENS = 4096
PAD = 0
#: A task packs the tokens of about so many bytes of text together.
SHARD_BYTES = 10_000_000
#: Rows that more than so many others equal are dealt to shards one by one.
MANY_COPIES = 100
#: Longer texts are encoded in parts of about so many characters.
PART_CHARS = 1 << 20
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the split pattern of the vocabulary, with runs that are never given back.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
#: The first id after the vocabulary's last; closes each document.
END_ID = 50256
_SINGLE_SPACE = re.compile(r"(?<=\S) (?=\S)")


class Tokens:
    """Ids of texts as uint16 bytes (little endian).

    No piece of the split pattern goes on over a single space, so a long text
    is cut before one and worked on in parts.
    """

    def __init__(self, vocabulary: bytes) -> None:
        import tiktoken

        lines = (line.split() for line in vocabulary.splitlines() if line)
        ranks = {base64.b64decode(word): int(rank) for word, rank in lines}
        self._encode = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def _part(self, text: str) -> bytes:
        ids = array("H", self._encode(text))
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def ids(self, text: str) -> bytes:
        out, start = [], 0
        while len(text) - start > PART_CHARS:
            found = _SINGLE_SPACE.search(text, start + PART_CHARS)
            if not found:
                break
            out.append(self._part(text[start : found.start()]))
            start = found.start()
        return b"".join([*out, self._part(text[start:])])


def token_pieces(
    docs: DataFrame, row_tokens: int = ROW_TOKENS, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY
) -> DataFrame:
    """(id, copy, piece, n, ids): each row's ids (uint16, little endian) and end mark, in pieces of ``row_tokens`` at most.

    ``copy`` tells rows apart that very many others equal, and is 0 for all else.

    A null or empty text is the end mark alone. The vocabulary (below 2 MB, a
    fixed size) is read once by the driver and sent to the tasks.
    """
    spark = docs.sparkSession
    plain = prepared(docs, id_col, text_col)
    kind = plain.schema["id"].dataType.simpleString()
    keyed = plain.withColumns({"_key": F.xxhash64("id", "text"), "_key2": F.xxhash64(F.lit(1), "id", "text")})
    plain = numbered_copies(keyed, ["_key", "_key2"], "copy", MANY_COPIES).select("id", "copy", "text")
    with open(vocabulary, "rb") as file:
        held = spark.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, end = Tokens(held.value), np.array([END_ID], "<u2").tobytes()
        for batch in slices(batches):
            rows, piece, size, ids = [], [], [], []
            for row, text in enumerate(batch.column("text").to_pylist()):
                data = tokens.ids(text.decode()) + end
                for number, start in enumerate(range(0, len(data), 2 * row_tokens)):
                    part = data[start : start + 2 * row_tokens]
                    rows.append(row)
                    piece.append(number)
                    size.append(len(part) // 2)
                    ids.append(part)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c).take(pa.array(rows, pa.int64())) for c in ("id", "copy")], pa.array(piece, pa.int32()), pa.array(size, pa.int32()), pa.array(ids, pa.binary())],
                names=["id", "copy", "piece", "n", "ids"],
            )

    return plain.mapInArrow(run, f"id {kind}, copy long, piece int, n int, ids binary")


class Rooms:
    """Segment tree over rooms 0..capacity: does a row with this much room exist?"""

    def __init__(self, capacity: int) -> None:
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)

    def change(self, room: int, by: int) -> None:
        at = room + self.leaves
        while at:
            self.count[at] += by
            at >>= 1

    def least_from(self, need: int) -> int | None:
        """The least room of at least ``need`` that some row has."""
        count, at = self.count, need + self.leaves
        if count[at]:
            return need
        while at > 1:
            if not at & 1 and count[at + 1]:  # a left child whose right sibling has some
                at += 1
                while at < self.leaves:
                    at = 2 * at if count[2 * at] else 2 * at + 1
                return at - self.leaves
            at >>= 1
        return None


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Rows as lists of item numbers; the largest items first, ties in the order given."""
    rooms, rows, open_rows = Rooms(capacity), [], [[] for _ in range(capacity + 1)]
    for item in np.argsort(-sizes, kind="stable").tolist():
        need = int(sizes[item])
        room = rooms.least_from(need)
        if room is None:
            row, room = len(rows), capacity
            rows.append([])
        else:
            row = open_rows[room].pop()
            rooms.change(room, -1)
        rows[row].append(item)
        if room > need:
            open_rows[room - need].append(row)
            rooms.change(room - need, 1)
    return rows


PACKED = "shard int, row int, ids binary, n_tokens int, cu_seqlens array<int>, positions binary, doc_ids array<bigint>, pieces array<int>"


def packed_rows(pieces: DataFrame, shards: int, row_tokens: int = ROW_TOKENS) -> DataFrame:
    """One row per row of the packed matrix.

    ids holds ``row_tokens`` uint16 ids (padded with ``PAD``), cu_seqlens the
    cumulative lengths 0, l1, l1 + l2, ..., positions the place of each token
    within its segment (uint16; padding counts up from 0 as a segment of its own),
    doc_ids and pieces the segments' origin. Pieces are dealt to shards by a
    hash, of a document's pieces each for itself, of very many equal rows each
    for itself; a task packs one shard.
    """
    dealt = pieces.select("id", "piece", "n", "ids", F.xxhash64("id", "copy", "piece", "ids").alias("place")).repartition(shards, "place")
    dealt = dealt.sortWithinPartitions(F.desc("n"), "place", "id", "piece").withColumn("shard", F.spark_partition_id())
    schema = pa.schema(
        [("shard", pa.int32()), ("row", pa.int32()), ("ids", pa.binary()), ("n_tokens", pa.int32()), ("cu_seqlens", pa.list_(pa.int32())),
         ("positions", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("pieces", pa.list_(pa.int32()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        table = pa.Table.from_batches(batches)
        ids, number, size, data = (table.column(c).to_pylist() for c in ("id", "piece", "n", "ids"))
        shard, size = table.column("shard")[0].as_py(), np.array(size, np.int64)
        ramp = np.arange(row_tokens, dtype="<u2").tobytes()
        packed = best_fit_decreasing(size, row_tokens)
        for first in range(0, len(packed), 256):
            out = []
            for row, items in enumerate(packed[first : first + 256], first):
                ends = np.r_[0, np.cumsum(size[items])]
                used, spare = int(ends[-1]), row_tokens - int(ends[-1])
                filled = b"".join([data[i] for i in items]) + np.full(spare, PAD, "<u2").tobytes()
                places = b"".join([ramp[: 2 * int(size[i])] for i in items]) + ramp[: 2 * spare]
                out.append((shard, row, filled, used, ends, places, [ids[i] for i in items], [number[i] for i in items]))
            yield record_batch(schema, list(zip(*out)))

    return dealt.select("shard", F.col("id").cast("long").alias("id"), "piece", "n", "ids").mapInArrow(run, PACKED)


def pack(docs: DataFrame, row_tokens: int = ROW_TOKENS, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """Packed rows of all texts; see ``packed_rows``. Nothing for an empty table.

    The number of shards follows the bytes of text, so a task's share is bounded.
    """
    total = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")) + 1)).first()[0] or 0
    shards = int(-(-total // SHARD_BYTES)) or 1
    return packed_rows(token_pieces(docs, row_tokens, id_col, text_col, vocabulary), shards, row_tokens)


def unpack(packed: DataFrame) -> DataFrame:
    """The pieces (id, piece, n, ids) back from packed rows, byte for byte."""
    segment = F.posexplode(F.arrays_zip("doc_ids", "pieces")).alias("k", "s")
    rows = packed.select("ids", "cu_seqlens", segment)
    start, end = F.get("cu_seqlens", F.col("k")), F.get("cu_seqlens", F.col("k") + 1)
    return rows.select(
        F.col("s.doc_ids").alias("id"), F.col("s.pieces").alias("piece"), (end - start).alias("n"), F.expr("substring(ids, 2 * cu_seqlens[k] + 1, 2 * (cu_seqlens[k + 1] - cu_seqlens[k]))").alias("ids")
    )

"""Benchmark decontamination with an Aho-Corasick automaton over word sequences.

Texts and benchmark items are normalised alike: A-Z become lower case, words
are runs of a-z, 0-9 and non-ASCII characters. Every window of ten item words
(a shorter item is one window) is a pattern of the automaton, whose symbols are
words; a text is scanned once. Word numbers of the hits map back to character
offsets of the original text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from epistride.llm.arrow import SLICE_BYTES, prepared, slices
from epistride.session import stored

WINDOW = 10
#: One automaton holds at most so many bytes of benchmark text; more text makes more automata, each read by every document.
BLOCK_BYTES = 4 << 20

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: A-Z in lower case, every other byte that is not part of a word as a space.
_NORMAL = bytes(
    c + 32 if 65 <= c <= 90 else c if chr(c) in "0123456789abcdefghijklmnopqrstuvwxyz" or c >= 128 else 32 for c in range(256)
)


def normal_words(data: bytes) -> list[bytes]:
    return data.translate(_NORMAL).split()


class Windows:
    """The automaton of some items' windows."""

    def __init__(self, items: list[tuple[int | None, bytes]], window: int = WINDOW) -> None:
        owners: dict[tuple[int, ...], set[int]] = {}
        self.word_id: dict[bytes, int] = {}
        for item, text in items:
            ids = [self.word_id.setdefault(w, len(self.word_id) + 1) for w in normal_words(text)]
            for start in range(max(1, len(ids) - window + 1) if ids else 0):
                owner = owners.setdefault(tuple(ids[start : start + window]), set())
                if item is not None:
                    owner.add(item)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for pattern, owner in owners.items():
            self.automaton.add_word(pattern, (len(pattern), frozenset(owner)))
        if owners:
            self.automaton.make_automaton()
        self.empty = not owners

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Maximal runs [start, end) of hit words, and the items with an occurring window."""
        if self.empty or not words:
            return [], set()
        known, runs, items = self.word_id.get, [], set()
        for last, (length, owner) in self.automaton.iter(tuple([known(w, 0) for w in words])):
            items |= owner
            start, end = last - length + 1, last + 1
            while runs and runs[-1][1] >= start:
                start = min(start, runs.pop()[0])
            runs.append((start, end))
        return runs, items


def _merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(runs):
        if out and out[-1][1] >= start:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _char_spans(data: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Character offsets [start, end) in the original text of runs of words."""
    if not runs:
        return []
    at = [m.span() for m in _WORD.finditer(data.lower())]
    raw = np.frombuffer(data, np.uint8)
    chars = np.r_[0, np.cumsum((raw & 0xC0) != 0x80)]
    return [(int(chars[at[a][0]]), int(chars[at[b - 1][1]])) for a, b in runs]


def benchmark_blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> list[DataFrame]:
    """The items in parts of about ``block_bytes`` of text, by a hash of the item."""
    items = benchmark.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = int(-(-total // block_bytes)) or 1
    part: Column = F.pmod(F.xxhash64("id", "text"), F.lit(blocks))
    return [items.filter(part == b) for b in range(blocks)]


def _held(block: DataFrame) -> Broadcast:
    """One block of items for the tasks; it is bounded by the block's size, but for an item that is longer by itself."""
    return block.sparkSession.sparkContext.broadcast([(r.id, (r.text or "").encode()) for r in block.collect()])


def _structs(runs: list[tuple[int, int]]) -> list[dict[str, int]]:
    return [{"start": a, "end": b} for a, b in runs]


_HITS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def benchmark_hits(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(id, n_words, word_runs, char_spans, items) of every row of ``docs``.

    word_runs are the maximal runs [start, end) of words inside occurrences of
    a window, char_spans the same as character offsets of the original text,
    items the sorted ids of items with an occurring window. A null text has no
    words; an item without words has no window; an item of null id hits words
    but is not listed. Repeated rows come back as often as given.
    """
    rows = prepared(docs, id_col, text_col)
    kind = rows.schema["id"].dataType.simpleString()
    hits = "array<struct<start:bigint,end:bigint>>"
    none = F.array().cast(hits)
    rows = rows.select("id", "text", F.lit(0).cast("long").alias("n_words"), none.alias("word_runs"), none.alias("char_spans"), F.array().cast("array<bigint>").alias("items"))
    blocks = benchmark_blocks(benchmark, item_col, item_text_col, block_bytes)
    for number, block in enumerate(blocks):
        # One block at a time is held: each but the last is done and gone before the next is read.
        last, held = number + 1 == len(blocks), _held(block)

        def run(batches: Iterator[pa.RecordBatch], held=held, last=last) -> Iterator[pa.RecordBatch]:
            windows = Windows(held.value, window)
            for batch in slices(batches, limit=SLICE_BYTES):
                texts = batch.column("text").to_pylist()
                counts = []
                runs, spans, items = (batch.column(c).to_pylist() for c in ("word_runs", "char_spans", "items"))
                for i, text in enumerate(texts):
                    words = normal_words(text)
                    counts.append(len(words))
                    found, owners = windows.scan(words)
                    if found:
                        merged = _merged([(r["start"], r["end"]) for r in runs[i]] + found)
                        runs[i], spans[i] = _structs(merged), _structs(_char_spans(text, merged))
                        items[i] = sorted({*items[i], *owners})
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id"),
                        # Only a further block of items needs the text again.
                        pa.nulls(len(texts), pa.binary()) if last else batch.column("text"),
                        pa.array(counts, pa.int64()),
                        pa.array(runs, _HITS),
                        pa.array(spans, _HITS),
                        pa.array(items, pa.list_(pa.int64())),
                    ],
                    names=["id", "text", "n_words", "word_runs", "char_spans", "items"],
                )

        rows = rows.mapInArrow(run, f"id {kind}, text binary, n_words long, word_runs {hits}, char_spans {hits}, items array<bigint>")
        if not last:
            rows = stored(rows, "benchmark-hits")
            held.destroy()
    return rows.drop("text")


def clean_documents(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The rows whose text holds no window, with all their columns; one pass, no shuffle."""
    rows, blocks = docs, benchmark_blocks(benchmark, item_col, item_text_col, block_bytes)
    place = docs.columns.index(text_col)
    for number, block in enumerate(blocks):
        held = _held(block)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            windows = Windows(held.value, window)
            for batch in slices(batches, place):
                clean = [not windows.scan(normal_words((t or "").encode()))[0] for t in batch.column(place).to_pylist()]
                yield batch.filter(pa.array(clean, pa.bool_()))

        rows = rows.mapInArrow(run, docs.schema)
        if number + 1 < len(blocks):
            rows = stored(rows, "clean-documents")
            held.destroy()
    return rows


def digest_columns(hits: DataFrame) -> DataFrame:
    """n_words, n_hit, n_items, items_sha256 and contaminated from the hits."""
    listed = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    n_hit = F.aggregate("word_runs", F.lit(0).cast("long"), lambda s, r: s + r["end"] - r["start"])
    return hits.select(
        F.col("id").alias("doc_id"),
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(listed, 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )

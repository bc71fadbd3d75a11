"""Homomorphic multiset fingerprints of a text's paragraphs.

Each paragraph (a line that is not blank) is hashed to a wide vector; a text's
fingerprint is the sum of its paragraphs' vectors, lane by lane.
The order of paragraphs plays no part, and a paragraph is inserted or deleted
by one addition or subtraction. The vector has two parts: lanes expanded from
the paragraph's digest, modulo 2^16, in which unequal multisets differ
everywhere, and lanes modulo 2^32 in which each three-word shingle of the
paragraph adds 1 or -1 in one place. The second part's inner products estimate
how much two texts share; a count below 2^31 never wraps.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from epistride.llm.arrow import prepared, slices
from epistride.llm.keyed import numbered_copies
from epistride.llm.terms import PART_BYTES, WORDS, Tokens, mixed

EXACT_LANES = 512
SKETCH_LANES = 512
#: In units of 16 bits; a sketch lane takes two, the lower half first.
LANES = EXACT_LANES + 2 * SKETCH_LANES
SHINGLE = 3
#: An id that more rows have, and than two ranges hold, is cut into parts.
MANY_ROWS = 1_000


def paragraphs(text: bytes) -> list[bytes]:
    return [p for p in text.split(b"\n") if p and not p.isspace()]


def _word_parts(paragraph: bytes) -> Iterator[bytes]:
    """A long paragraph in parts that overlap by ``SHINGLE - 1`` words, so that no shingle is lost or doubled."""
    start = 0
    while len(paragraph) - start > PART_BYTES:
        at = np.frombuffer(paragraph, np.uint8, PART_BYTES, start)
        gaps = np.flatnonzero((WORDS[at[:-1]] == 0) & (WORDS[at[1:]] == 1)) + 1
        if len(gaps) <= SHINGLE:
            break  # words of this length stay in one part
        yield paragraph[start : start + int(gaps[-1])]
        start += int(gaps[-SHINGLE])
    yield paragraph[start:]


def _sketches(units: list[tuple[int, bytes]], rows: int) -> np.ndarray:
    """Signed shingle counts of (row, paragraph) units, one lane row each."""
    out = np.zeros(rows * SKETCH_LANES)
    data = b"\n".join(p for _, p in units)
    length = np.array([len(p) + 1 for _, p in units], np.int64)
    at = np.cumsum(length) - length
    tokens = Tokens(data, WORDS)
    unit = np.searchsorted(at, tokens.starts, "right") - 1
    word = tokens.hashes()
    n = len(word) - SHINGLE + 1
    if n > 0:
        whole = unit[: max(n, 0)] == unit[SHINGLE - 1 :]
        shingle = mixed(word[:n] + np.uint64(3) * word[1 : n + 1] + np.uint64(5) * word[2 : n + 2])[whole]
        of = unit[:n][whole]
    else:
        shingle, of = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    # Units below a shingle's length count as one shingle.
    words = np.bincount(unit, minlength=len(units))
    first = np.cumsum(words) - words
    small = np.flatnonzero((words > 0) & (words < SHINGLE))
    if len(small):
        last = first[small] + words[small] - 1
        shingle = np.r_[shingle, mixed(word[first[small]] * np.uint64(7) + word[last] + words[small].astype(np.uint64))]
        of = np.r_[of, small]
    row = np.array([r for r, _ in units], np.int64)[of]
    lane = (shingle >> np.uint64(55)).astype(np.int64) % SKETCH_LANES
    sign = 1.0 - 2.0 * (shingle & np.uint64(1)).astype(np.float64)
    out += np.bincount(row * SKETCH_LANES + lane, sign, rows * SKETCH_LANES)
    return out.reshape(rows, SKETCH_LANES).astype(np.int64)


def _exact(vector: np.ndarray) -> np.ndarray:
    return vector[..., :EXACT_LANES]


def _counts(vector: np.ndarray) -> np.ndarray:
    """The sketch lanes as uint32."""
    return np.ascontiguousarray(vector[..., EXACT_LANES:].astype("<u2")).view("<u4")


def _vector(exact: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return np.concatenate([exact, np.ascontiguousarray(counts.astype("<u4")).view("<u2")], axis=-1)


def vectors(texts: Sequence[bytes]) -> np.ndarray:
    """The fingerprint vector (uint16 units) of each text; no paragraph gives zeros."""
    exact = np.zeros((len(texts), EXACT_LANES), np.uint16)
    counts = np.zeros((len(texts), SKETCH_LANES), np.uint32)
    units: list[tuple[int, bytes]] = []
    size = 0

    def add() -> None:
        rows = sorted({r for r, _ in units})
        number = {r: i for i, r in enumerate(rows)}
        counts[rows] += _sketches([(number[r], p) for r, p in units], len(rows)).astype(np.uint32)

    for row, text in enumerate(texts):
        for paragraph in paragraphs(text):
            exact[row] += np.frombuffer(hashlib.shake_128(paragraph).digest(2 * EXACT_LANES), "<u2")
            for part in _word_parts(paragraph):
                if units and size + len(part) > PART_BYTES:
                    add()
                    units, size = [], 0
                units.append((row, part))
                size += len(part) + 1
    if units:
        add()
    return _vector(exact, counts)


def inserted(vector: np.ndarray, paragraph: bytes) -> np.ndarray:
    new = vectors([paragraph])[0]
    return _vector(_exact(vector) + _exact(new), _counts(vector) + _counts(new))


def deleted(vector: np.ndarray, paragraph: bytes) -> np.ndarray:
    old = vectors([paragraph])[0]
    return _vector(_exact(vector) - _exact(old), _counts(vector) - _counts(old))


def digest(vector: np.ndarray) -> str:
    """A short name of a fingerprint, over the lower 16 bits of its lanes; equal multisets of paragraphs have equal names."""
    low = np.concatenate([_exact(vector), _counts(vector).astype(np.uint16)])
    return hashlib.sha256(low.astype("<u2").tobytes()).hexdigest()


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated share of common shingles (2 * common / (of a + of b)), row by row; 1 for equal vectors."""
    x = _counts(a).view("<i4").astype(np.float64)
    y = _counts(b).view("<i4").astype(np.float64)
    both = (x * x).sum(1) + (y * y).sum(1)
    shared = np.clip(2 * (x * y).sum(1) / np.maximum(both, 1), 0, 1)
    return np.where((a == b).all(1), 1.0, shared)


def fingerprint_vectors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, paragraphs, vector) of every row; the vector as little-endian uint16 bytes. Null counts as empty."""
    plain = prepared(docs, id_col, text_col)
    kind = plain.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            found = [v.astype("<u2").tobytes() for v in vectors(texts)]
            counts = pa.array([len(paragraphs(t)) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id"), counts, pa.array(found, pa.binary())], names=["id", "paragraphs", "vector"])

    return plain.mapInArrow(run, f"id {kind}, paragraphs long, vector binary")


def _edges(ids: DataFrame, pieces: int) -> list[int]:
    """About ``pieces - 1`` ids, ascending, that cut the rows into equal parts."""
    if pieces < 2:
        return []
    shares = F.array(*[F.lit(i / pieces) for i in range(1, pieces)])
    found = ids.select(F.percentile_approx("id", shares, F.lit(20 * pieces))).first()[0] or []
    return sorted({int(v) for v in found if v is not None})


def _place(column: Column, edges: list[int]) -> Column:
    """How many edges are at most ``column``, found in two short steps."""
    if not edges:
        return F.lit(0)
    width = max(1, int(len(edges) ** 0.5))
    blocks = [edges[i : i + width] for i in range(0, len(edges), width)]
    array = lambda values: F.array(*[F.lit(v).cast("long") for v in values])
    block = F.size(F.filter(array([b[0] for b in blocks]), lambda e: e <= column))
    inner = F.size(F.filter(F.get(F.array(*[array(b) for b in blocks]), block - 1), lambda e: e <= column))
    return F.when(block == 0, 0).otherwise((block - 1) * width + inner)


EDITED = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None) -> DataFrame:
    """Each text's fingerprint beside that of its edited text and of the next row.

    Rows stand in order of descending id (null last, equal ids by text); the
    row after the last is the first. The edited text has its last
    floor(n / 2) code points replaced by the first as many, or all, of the next
    row's text. Null counts as empty. A single row is its own next row.

    Returns (id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next).

    Rows are dealt to ranges of ids, by default four for each shuffle
    partition; the first row of a range is sent to the range before it as a
    guest, so texts are shuffled once. An id that very many rows have, or the
    lack of one, is a range of its own, cut further by a digest of the text
    and, for copies of one row, by their number. Only range edges and first
    ids, one of each per range, pass the driver.
    """
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    pieces = ranges or 4 * partitions
    counts = plain.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    most = max(MANY_ROWS, 2 * (counts.agg(F.sum("n")).first()[0] or 0) // pieces)
    crowded = {r.id: -(-r.n // most) for r in counts.filter(F.col("n") > most).collect()}  # at most half as many as ranges
    edges = sorted({*_edges(plain.select("id"), pieces), *[e for i in crowded if i is not None for e in (i, i + 1)]})
    # 0 holds the null ids, 1 and up ascending ranges, which are read downwards.
    placed = plain.withColumn("home", F.when(F.col("id").isNull(), 0).otherwise(1 + _place(F.col("id"), edges)).cast("int"))
    nothing = F.lit(0).cast("long")
    if crowded:
        placed = _spread(placed, crowded, most)
    else:
        placed = placed.withColumns({"copy": nothing, "spread": nothing, "part": _part(nothing, nothing, nothing)})
    slots = placed.groupBy("home", "part").agg(F.max("id").alias("head")).collect()
    if not slots:
        return spark.createDataFrame([], EDITED)
    slots.sort(key=lambda r: (-r.home, tuple(r.part)))
    told = [(r.home, r.part, r.head, number, number - 1 if number else len(slots) - 1) for number, r in enumerate(slots)]
    told = spark.createDataFrame(told, f"home int, part {_PART}, head long, slot int, before int")
    # A row for each range.
    placed = placed.join(F.broadcast(told), ["home", "part"])
    # Of rows that repeat the first id the first by digest and text stands first.
    guests = placed.filter(F.col("id").eqNullSafe(F.col("head"))).groupBy("before", "id", "slot")
    guests = guests.agg(F.min(F.struct("spread", "text")).alias("first"))
    guests = guests.select("id", F.col("first.text").alias("text"), F.col("before").alias("slot"), F.lit(True).alias("guest"), "first.spread", nothing.alias("copy"))
    rows = placed.select("id", "text", "slot", F.lit(False).alias("guest"), "spread", "copy").union(guests)
    rows = rows.repartition(max(1, min(len(slots), 2 * partitions)), "slot")
    rows = rows.sortWithinPartitions("slot", "guest", F.desc_nulls_last("id"), "spread", "text", "copy")
    return rows.select("id", "text", F.col("slot").alias("home"), "guest").mapInArrow(_with_next, EDITED)


_PART = "struct<range:bigint,digest:bigint,chunk:bigint>"


def _part(first: Column, digest: Column, chunk: Column) -> Column:
    return F.struct(first.alias("range"), digest.alias("digest"), chunk.alias("chunk"))


def _spread(placed: DataFrame, crowded: dict[int | None, int], most: int) -> DataFrame:
    """Rows with ``part``, ascending within a crowded id by ``spread``, a digest of the text, and ``copy``, the number among equal rows."""
    known = F.coalesce(F.col("id").cast("string"), F.lit(""))
    keyed = placed.withColumns({"_key": F.xxhash64(known, "text"), "_key2": F.xxhash64(F.lit(1), known, "text")})
    keyed = numbered_copies(keyed, ["_key", "_key2"], "copy", most)
    parts = F.lit(0)
    for i, n in crowded.items():
        parts = F.when(F.col("id").eqNullSafe(F.lit(i).cast("long")), n).otherwise(parts)
    spread = F.when(parts > 0, F.col("_key").bitwiseAND(F.lit(0x7FFFFFFF))).otherwise(0).cast("long")
    keyed = keyed.withColumns({"spread": spread, "parts": parts.cast("long")})
    # A part for each digest range, and behind it one for so many further copies of each row.
    first = F.floor(F.col("spread") * F.col("parts") / F.lit(1 << 31)).cast("long")
    chunk = F.floor(F.col("copy") / most).cast("long")
    part = _part(first, F.when(chunk > 0, F.col("_key")).otherwise(F.lit(0).cast("long")), chunk)
    return keyed.withColumn("part", part).drop("_key", "_key2", "parts")


def _with_next(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in reading order, each range's guest last; each row but the guest is paired with the one behind it."""
    held = None  # the last row seen: id, text, home, vector
    names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    for batch in slices(batches, limit=1 << 20):
        ids, texts, homes, guests = (batch.column(c).to_pylist() for c in ("id", "text", "home", "guest"))
        data = [t.encode() for t in texts]
        own = vectors(data)
        if held is not None:
            ids, texts, homes, guests = [held[0], *ids], [held[1], *texts], [held[2], *homes], [held[4], *guests]
            own = np.concatenate([held[3][None], own])
        at = [i for i in range(len(ids) - 1) if not guests[i] and homes[i] == homes[i + 1]]
        held = (ids[-1], texts[-1], homes[-1], own[-1], guests[-1])
        if not at:
            continue
        edited = []
        for i in at:
            text, half = texts[i], len(texts[i]) // 2
            edited.append((text[: len(text) - half] + texts[i + 1][:half]).encode())
        changed = vectors(edited)
        this, following = own[at], own[[i + 1 for i in at]]
        columns = [
            [ids[i] for i in at],
            [len(texts[i]) for i in at],
            [hashlib.sha256(e).hexdigest() for e in edited],
            [digest(v) for v in this],
            [digest(v) for v in changed],
            likeness(this, changed),
            likeness(this, following),
        ]
        yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types)], names=names)

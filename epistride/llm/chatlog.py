"""Chat logs folded into final messages and rendered with a loss mask.

A log is a table of events, each of a conversation, of a message in it, and
with a sequence:

* ``open``: the message begins, with its role and perhaps a first text;
* ``delta``: text streamed to the message's end;
* ``edit``: the message's text is replaced;
* ``regenerate``: the message's text is thrown away, deltas follow.

An edit or a regeneration withdraws the later messages opened before it, even
where its own message is withdrawn too. Messages are ordered by their names,
which grow in order of opening. An event delivered twice counts once.

The log is partitioned by conversation and sorted by message and sequence; a
task folds it as a stream and renders pages of bounded length. A conversation
with more events than a partition should hold is cut along its messages; the
blocks get the withdrawals of earlier blocks as an event of their own.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from epistride.llm.arrow import slices
from epistride.operators import scans

#: A page ends with the message that reaches so many characters, or so many messages.
PAGE_CHARS, PAGE_TURNS = 1 << 20, 1024

# The control strings of the template, in the order they take in a turn.
TURN, SAYS, END = "<turn>", "<says>", "</turn>"

_CONTROL = f"(?:{TURN}|{SAYS}|{END})"
_TO_ESCAPE = re.compile(rf"(?<!\\)(\\*+)({_CONTROL})")
_LAST_RUN = re.compile(r"(?<!\\)(\\++)\Z")
_ESCAPED = re.compile(rf"(?<!\\)(\\++)({_CONTROL}|\Z)")
_MARK = re.compile(rf"(?<!\\)(?:\\\\)*+({_CONTROL})")


def escaped(text: str) -> str:
    """``text`` with a backslash before every control string.

    Backslashes that stand before a control string, or end the text, are
    doubled, so that the next mark is never taken for an escaped one.
    """
    text = _TO_ESCAPE.sub(lambda m: m[1] * 2 + "\\" + m[2], text)
    return _LAST_RUN.sub(lambda m: m[1] * 2, text)


def unescaped(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1][: len(m[1]) // 2] + m[2], text)


def rendered_turn(role: str, text: str) -> str:
    return f"{TURN}{escaped(role)}{SAYS}{escaped(text)}{END}\n"


def parsed(page: str) -> Iterator[tuple[str, str]]:
    """(role, text) of every turn of a rendered page."""
    at, opened, role = 0, 0, ""
    while found := _MARK.search(page, at):
        start = found.start(1)
        if found[1] == TURN:
            opened = found.end()
        elif found[1] == SAYS:
            role, opened = unescaped(page[opened:start]), found.end()
        else:
            yield role, unescaped(page[opened:start])
        at = found.end()


@dataclass
class _Page:
    """The turns of one conversation's block that are not yet written out."""

    pieces: list[str] = field(default_factory=list)
    spans: list[dict[str, int]] = field(default_factory=list)
    chars: int = 0
    number: int = 0

    def add(self, role: str, text: str, learnt: bool) -> None:
        piece = rendered_turn(role, text)
        if learnt:
            end = self.chars + len(piece) - len(END) - 1
            self.spans.append({"start": end - len(escaped(text)), "end": end})
        self.pieces.append(piece)
        self.chars += len(piece)

    @property
    def full(self) -> bool:
        return self.chars >= PAGE_CHARS or len(self.pieces) >= PAGE_TURNS


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


class _Fold:
    """Folds sorted events; ``out`` collects finished pages (conv, block, page, last, n_turns, formatted, loss)."""

    def __init__(self, learnt: frozenset[str]) -> None:
        self.learnt, self.out, self.where = learnt, [], None

    def begin(self, where: tuple) -> None:
        self.end()
        self.where, self.page, self.reset, self.message, self.held = where, _Page(), None, None, False

    def event(self, message, seq, kind: str, role: str | None, text: str | None) -> None:
        if kind == "carry":
            self.reset = seq
            return
        if not self.held or message != self.message:
            self.close()
            self.message, self.held, self.opened, self.seq, self.role, self.parts, self.own = message, True, seq, None, None, [], None
        if seq == self.seq:
            return
        self.seq = seq
        self.role = role if self.role is None else self.role
        if kind in ("edit", "regenerate"):
            self.parts, self.own = [], seq
        if text:
            self.parts.append(text)

    def close(self) -> None:
        """The message in hand is complete."""
        if not self.held:
            return
        self.held = False
        if self.reset is None or self.opened > self.reset:
            role = self.role or ""
            self.page.add(role, "".join(self.parts), role in self.learnt)
            if self.page.full:
                self.write(False)
        if self.own is not None and (self.reset is None or self.own > self.reset):
            self.reset = self.own

    def write(self, last: bool) -> None:
        page = self.page
        self.out.append((*self.where, page.number, last, len(page.pieces), "".join(page.pieces), page.spans))
        self.page = _Page(number=page.number + 1)

    def end(self) -> None:
        if self.where is not None:
            self.close()
            self.write(True)


def rendered(events: DataFrame, place: Column, learnt: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Pages (conv, block, page, last, n_turns, formatted, loss) of all conversations.

    ``events`` holds (conv, message, seq, kind, role, text); messages and
    sequences are numbers, or strings compared by code point. ``place`` is a
    whole number that never falls along a conversation's messages. Pages of a
    conversation are ordered by (block, page); block is -1 where it is not
    cut. ``loss`` are the spans of the texts of the ``learnt`` roles. A null
    conversation is one of its own, null roles and texts are empty, and a
    conversation without a message left has one empty page.
    """
    kind = events.schema["conv"].dataType.simpleString()
    told = events.select("conv", "message", "seq", "kind", "role", "text", place.cast("long").alias("place"))
    rows, edges = scans.even_edges(told, F.col("place"))
    counts = told.groupBy(F.col("conv").alias("_conv")).agg(F.count(F.lit(1)).alias("_n"))
    # No more conversations than parts can be as large as a part.
    hot = counts.filter(F.col("_n") > rows // (len(edges) + 1)).select("_conv", F.lit(True).alias("hot"))
    told = told.join(F.broadcast(hot), F.col("conv").eqNullSafe(F.col("_conv")), "left")
    told = told.withColumn("block", F.when(F.col("hot"), scans.edge_block(F.col("place"), edges)).otherwise(F.lit(-1)).cast("long"))
    told = told.select("conv", "block", "message", "seq", "kind", "role", "text")
    resets = told.filter("block >= 0 and kind in ('edit', 'regenerate')").groupBy("conv", "block").agg(F.max("seq").alias("seq"))
    blocks = told.filter("block >= 0").select("conv", "block").distinct().join(resets.withColumnsRenamed({"conv": "_c", "block": "_b"}), F.col("conv").eqNullSafe(F.col("_c")) & (F.col("block") == F.col("_b")), "left")
    before = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carry = blocks.select("conv", "block", F.max("seq").over(before).alias("seq")).filter("seq is not null")
    none = lambda name: F.lit(None).cast(events.schema[name].dataType).alias(name)
    carry = carry.select("conv", "block", none("message"), "seq", F.lit("carry").alias("kind"), none("role"), none("text"))
    # A null message sorts first, so a block begins with what it inherits.
    dealt = told.unionByName(carry).repartition("conv", "block").sortWithinPartitions("conv", "block", "message", "seq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold, conv_type = _Fold(frozenset(learnt)), None

        def ready() -> pa.RecordBatch:
            out, fold.out = fold.out, []
            types = [conv_type, pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.string(), _SPANS]
            names = ["conv", "block", "page", "last", "n_turns", "formatted", "loss"]
            return pa.RecordBatch.from_arrays([pa.array(list(c), type=t) for c, t in zip(zip(*out), types)], names=names)

        for batch in slices(batches):
            conv_type = batch.column("conv").type
            for conv, block, *event in zip(*[c.to_pylist() for c in batch.columns]):
                if (conv, block) != fold.where:
                    fold.begin((conv, block))
                fold.event(*event)
            if fold.out:
                yield ready()
        if fold.where is not None:
            fold.end()
            yield ready()

    loss = "array<struct<start:bigint,end:bigint>>"
    return dealt.mapInArrow(run, f"conv {kind}, block long, page long, last boolean, n_turns long, formatted string, loss {loss}")


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each page's turns and learnt texts; digests where the page is a whole conversation, else the bytes."""
    for batch in slices(batches, "formatted"):
        rows: list[tuple] = []
        pages = (batch.column(c).to_pylist() for c in ("block", "page", "last", "formatted", "loss"))
        for block, page, last, text, spans in zip(*pages):
            turns = list(parsed(text))
            said = "".join(f"{role}\n{words}\n" for role, words in turns).encode()
            learnt = "".join(unescaped(text[s["start"] : s["end"]]) for s in spans)
            loss = learnt.encode()
            whole = block < 0 and page == 0 and last
            digests = (hashlib.sha256(said).hexdigest(), hashlib.sha256(loss).hexdigest()) if whole else (None, None)
            rows.append((len(turns), len(learnt), len(text), *digests, *((None, None) if whole else (said, loss))))
        types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.binary()] * 2
        columns = [pa.array(list(c), type=t) for c, t in zip(zip(*rows), types)]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("conv", "block", "page")], *columns], names=[f.split()[0] for f in _READ])


_READ = ["conv", "block long", "page long", "n_turns long", "loss_chars long", "formatted_chars long", "turns_sha256 string", "loss_sha256 string",
         "turns binary", "loss binary"]


def read_back(pages: DataFrame) -> DataFrame:
    """(conv, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read from rendered pages.

    Turns are parsed from the formatted text, and learnt texts cut out by the
    loss spans. Digests of conversations of several pages are fed page by page.
    """
    kind = pages.schema["conv"].dataType.simpleString()
    schema = ", ".join([f"conv {kind}", *_READ[1:]])
    told = pages.select("conv", "block", "page", "last", "formatted", "loss").mapInArrow(_told, schema)
    names = ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, conv, started = None, None, False

        def result(found: list[tuple], conv_type: pa.DataType) -> pa.RecordBatch:
            types = [conv_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(list(c), type=t) for c, t in zip(zip(*found), types)], names=names)

        def sums() -> tuple:
            turns, loss = held[3:]
            return (conv, held[0], turns if isinstance(turns, str) else turns.hexdigest(), held[1], loss if isinstance(loss, str) else loss.hexdigest(), held[2])

        conv_type = None
        for batch in slices(batches, "turns"):
            conv_type, found = batch.column("conv").type, []
            for name, _, _, n, loss_chars, chars, turns_sha, loss_sha, turns, loss in zip(*[c.to_pylist() for c in batch.columns]):
                if not started or name != conv:
                    if started:
                        found.append(sums())
                    conv, started = name, True
                    held = [0, 0, 0, turns_sha or hashlib.sha256(), loss_sha or hashlib.sha256()]
                if turns is not None:
                    held[3].update(turns)
                    held[4].update(loss)
                held[0], held[1], held[2] = held[0] + n, held[1] + loss_chars, held[2] + chars
            if found:
                yield result(found, conv_type)
        if started:
            yield result([sums()], conv_type)

    schema = f"conv {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return told.repartition("conv").sortWithinPartitions("conv", "block", "page").mapInArrow(run, schema)


#: Deltas of a log made from finished texts hold so many characters.
DELTA_CHARS = 512
_DRAFT_CHARS = 8


def log_of(
    conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """A log (conv, place, message, seq, kind, role, text) that a server may have written of finished conversations.

    Texts are streamed in deltas. An assistant's message first gets a draft
    and a hasty answer by the user; it is then regenerated, which withdraws
    the answer. Every fourth of the other messages is opened with its first
    characters and edited. Rows are ordered by turn (null first), then by a
    checksum of role and text; only rows equal in all are told apart by their
    place in the table.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    role = F.coalesce(F.col(role_col).cast("string"), F.lit(""))
    hexed = lambda value, width: F.lpad(F.hex(value), width, "0")
    rows = conversations.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("place"), role.alias("role"), text.alias("text"))
    rows = rows.withColumn("sum", F.crc32(F.encode(F.concat("role", F.lit("\n"), "text"), "utf-8")))
    # The sign bit flipped, hex digits sort as the numbers do; a null turn is the empty string.
    turn = F.coalesce(hexed(F.col("place").bitwiseXOR(F.lit(-(1 << 63))), 16), F.lit(""))
    rows = rows.withColumn("message", F.concat(turn, F.lit("-"), hexed(F.col("sum"), 8), F.lit("-"), hexed(F.monotonically_increasing_id(), 16)))

    def event(kind: str, step: Column | int, words: Column | str, role: Column | None = None, message: Column | None = None) -> Column:
        step = F.lit(step) if isinstance(step, int) else step
        return F.struct(
            (F.col("message") if message is None else message).alias("message"),
            F.concat("message", hexed(step.cast("long"), 8)).alias("seq"),
            F.lit(kind).alias("kind"),
            (F.lit(None).cast("string") if role is None else role).alias("role"),
            (F.lit(words) if isinstance(words, str) else words).alias("text"),
        )

    begun = F.substring("text", 1, _DRAFT_CHARS)
    first = F.substring("text", 1, DELTA_CHARS)
    starts = F.when(F.length("text") > DELTA_CHARS, F.sequence(F.lit(1), F.floor((F.length("text") - 1) / DELTA_CHARS).cast("int"))).otherwise(
        F.array().cast("array<int>")
    )
    deltas = F.transform(starts, lambda i: event("delta", i + 3, F.substring(F.col("text"), i * DELTA_CHARS + 1, F.lit(DELTA_CHARS))))
    hasty = event("open", 1, "?", F.lit("user"), F.concat("message", F.lit("+")))
    regenerated = F.concat(F.array(event("open", 0, begun, F.col("role")), hasty, event("regenerate", 2, ""), event("delta", 3, first)), deltas)
    edited = F.array(event("open", 0, begun, F.col("role")), event("edit", 3, F.col("text")))
    streamed = F.concat(F.array(event("open", 0, first, F.col("role"))), deltas)
    events = F.when(F.col("role") == "assistant", regenerated).when(F.col("sum") % 4 == 0, edited).otherwise(streamed)
    return rows.select("conv", F.coalesce("place", F.lit(-(1 << 62))).alias("place"), F.explode(events).alias("e")).select("conv", "place", "e.*")

"""Ranked lexical search: the best documents of every item, by branch and bound over document trees.

Only terms of the items matter, so a document is restricted to them: its terms
in order of falling document frequency, their frequencies, and its length
norm. Documents are put into prefix trees over these sequences; documents that
begin with the same frequent terms share a path. A node covers a range of the
sorted documents and holds, for every term, the highest frequency in its
subtree, and the least norm. The score of a document grows with frequencies
and falls with the norm, so a node's maxima and minimum bound every document
below it, exactly in integers. For each item the tree is searched depth first,
the child of the highest bound first, and a subtree whose bound is below the
worst of the item's best documents so far is left out.

Each task searches the trees of its part of the documents; of every item only
its best rows leave the task. Items come in blocks of bounded text, each
broadcast for one pass and destroyed after it.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from epistride.llm.arrow import prepared, slices
from epistride.session import stored

TOP = 20
#: Items are searched in blocks of about so many bytes of text.
BLOCK_BYTES = 1 << 20
#: A tree covers at most so many documents, and its leaves about so many.
TREE_DOCS, LEAF_DOCS = 4096, 32
#: Fewer documents where the terms are many: a tree's maxima take about so many cells.
_CELLS = 1 << 24
_TEXT_PART = 1 << 20

_TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_BREAK = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")


def term_counts(text: bytes) -> Counter[bytes]:
    """The text's terms (ASCII letters lower-cased) and how often each occurs, counted part by part."""
    found: Counter[bytes] = Counter()
    start = 0
    while start < len(text):
        end = len(text)
        if start + _TEXT_PART < end:
            cut = _BREAK.search(text, start + _TEXT_PART)
            end = cut.end() if cut else end
        found.update(_TERM.findall(text[start:end].lower()))
        start = end
    return found


def _vectors(docs: DataFrame, terms, id_col: str, text_col: str) -> DataFrame:
    """(id, n, terms, tfs): a document's number of terms, and its restricted vector by term number."""
    rows = prepared(docs, id_col, text_col)
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {term: i for i, term in enumerate(terms.value)}
        for batch in slices(batches):
            sizes, found, tfs = [], [], []
            for text in batch.column("text").to_pylist():
                counts = term_counts(text)
                sizes.append(counts.total())
                mine = sorted(known[t] for t in counts.keys() & known.keys())
                found.append(mine)
                tfs.append([counts[terms.value[i]] for i in mine])
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))],
                names=["id", "n", "terms", "tfs"],
            )

    return rows.mapInArrow(run, f"id {kind}, n long, terms array<int>, tfs array<long>")


def _gain(tf: np.ndarray, norm: np.ndarray | int) -> np.ndarray:
    """What a term of weight 1 adds; never falls with ``tf``, never grows with ``norm``."""
    return 1_000_000_000 * tf // np.maximum(1000 * tf + 12 * norm, 1)


@dataclass
class _Node:
    first: int
    last: int
    children: list[int]


class Tree:
    """A prefix tree over restricted vectors given as flat arrays: document ``d`` has the entries at[d]:at[d + 1]."""

    def __init__(self, at: np.ndarray, terms: np.ndarray, tfs: np.ndarray, norms: np.ndarray, width: int, leaf: int = LEAF_DOCS) -> None:
        paths = [terms[a:b].astype(">i4").tobytes() for a, b in zip(at, at[1:])]
        self.order = np.array(sorted(range(len(paths)), key=paths.__getitem__), np.int64)
        sizes = np.diff(at)[self.order]
        self.at = np.r_[0, np.cumsum(sizes)].astype(np.int64)
        take = np.repeat(at[self.order] - self.at[:-1], sizes) + np.arange(self.at[-1])
        self.terms, self.tfs, self.norms = terms[take], tfs[take], norms[self.order]
        self.nodes: list[_Node] = []
        self._grow(self._shared(), leaf)
        self.highest = np.zeros((len(self.nodes), width), np.int32)
        self.least = np.zeros(len(self.nodes), np.int64)
        for i in reversed(range(len(self.nodes))):  # children come after their parent
            node = self.nodes[i]
            if node.children:
                self.highest[i] = self.highest[node.children].max(axis=0)
                self.least[i] = self.least[node.children].min()
            else:
                a, b = self.at[node.first], self.at[node.last]
                np.maximum.at(self.highest[i], self.terms[a:b], self.tfs[a:b].astype(np.int32))
                self.least[i] = self.norms[node.first : node.last].min()

    def _shared(self) -> np.ndarray:
        """How many first terms each document shares with the one before it."""
        shared = np.zeros(len(self.order), np.int64)
        for d in range(1, len(shared)):
            a, b, c = self.at[d - 1 : d + 2]
            n = min(b - a, c - b)
            differ = np.flatnonzero(self.terms[a : a + n] != self.terms[b : b + n])
            shared[d] = differ[0] if len(differ) else n
        return shared

    def _grow(self, shared: np.ndarray, leaf: int) -> None:
        """Split ranges where their documents share least; runs of small children make one."""
        if not len(self.order):
            return
        self.nodes.append(_Node(0, len(self.order), []))
        todo = [0]
        while todo:
            node = self.nodes[todo.pop()]
            if node.last - node.first <= leaf:
                continue
            inside = shared[node.first + 1 : node.last]
            cuts = np.flatnonzero(inside == inside.min()) + node.first + 1
            edges, begun = [], node.first
            for cut in [*cuts.tolist(), node.last]:
                if cut - begun >= leaf or cut == node.last:
                    edges.append((begun, cut))
                    begun = cut
            if len(edges) < 2:  # a small child beside a large one
                middle = int(cuts[np.abs(cuts - (node.first + node.last) // 2).argmin()])
                edges = [(node.first, middle), (middle, node.last)]
            for first, last in edges:
                node.children.append(len(self.nodes))
                todo.append(len(self.nodes))
                self.nodes.append(_Node(first, last, []))

    def search(self, terms: np.ndarray, weights: np.ndarray, least: int, offer, place: np.ndarray) -> None:
        """Offer (document, score) arrays of all documents that may score ``least`` or more.

        ``offer`` returns the score that is worth offering from then on;
        ``place`` is scratch space of -1 for every term.
        """
        if not self.nodes or not len(terms):
            return
        bounds = (weights * _gain(self.highest[:, terms].astype(np.int64), self.least[:, None])).sum(axis=1)
        place[terms] = np.arange(len(terms))
        stack = [0]
        while stack:
            at = stack.pop()
            if bounds[at] < least:
                continue
            node = self.nodes[at]
            if node.children:
                stack.extend(sorted(node.children, key=bounds.__getitem__))
                continue
            a, b = self.at[node.first], self.at[node.last]
            where = place[self.terms[a:b]]
            used = np.flatnonzero(where >= 0)
            doc = np.searchsorted(self.at[node.first + 1 : node.last + 1], used + a, side="right") + node.first
            gains = weights[where[used]] * _gain(self.tfs[a:b][used], self.norms[doc])
            scores = np.zeros(node.last - node.first, np.int64)
            np.add.at(scores, doc - node.first, gains)
            good = np.flatnonzero(scores >= least)
            if len(good):
                least = offer(self.order[good + node.first], scores[good])
        place[terms] = -1


class _Best:
    """The best documents of one item: highest score, then least id, null last."""

    def __init__(self, top: int) -> None:
        self.top, self.rows = top, []

    @property
    def least(self) -> int:
        return self.rows[-1][0] if len(self.rows) == self.top else 1

    def add(self, scores: list[int], ids: list) -> int:
        rows = self.rows + list(zip(scores, ids))
        self.rows = heapq.nsmallest(self.top, rows, key=lambda r: (-r[0], r[1] is None, r[1] if r[1] is not None else 0))
        return self.least


def _searched(vectors: DataFrame, items, width: int, top: int) -> DataFrame:
    """(item, id, score): each task's best rows of every item."""
    kind = vectors.schema["id"].dataType.simpleString()
    docs = int(min(TREE_DOCS, max(4 * LEAF_DOCS, _CELLS // max(1, width) * LEAF_DOCS // 2)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [_Best(top) for _ in items.value]
        place = np.full(width, -1, np.int64)
        held: list[pa.RecordBatch] = []
        kinds: pa.DataType | None = None

        def search() -> None:
            rows = pa.Table.from_batches(held).combine_chunks()
            ids, lists, tfs = (rows.column(c).combine_chunks() for c in ("id", "terms", "tfs"))
            at = np.r_[0, np.cumsum(lists.value_lengths().to_numpy())].astype(np.int64)
            tree = Tree(at, lists.flatten().to_numpy().astype(np.int64), tfs.flatten().to_numpy(), rows.column("m").to_numpy(), width)
            for found, (terms, weights) in zip(best, items.value):
                offer = lambda docs, scores: found.add(scores.tolist(), ids.take(pa.array(docs)).to_pylist())  # noqa: B023, E731
                tree.search(terms, weights, found.least, offer, place)

        size = 0
        for batch in batches:
            kinds = batch.column("id").type
            for start in range(0, batch.num_rows, docs):
                part = batch.slice(start, docs)
                if size and size + part.num_rows > docs:
                    search()
                    held, size = [], 0
                held.append(part)
                size += part.num_rows
        if size:
            search()
        rows = [(item, *row[::-1]) for item, found in enumerate(best) for row in found.rows]
        if rows:
            item, ids, scores = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(ids, type=kinds), pa.array(scores, pa.int64())], names=["item", "id", "score"])

    return vectors.select("id", "m", "terms", "tfs").mapInArrow(run, f"item long, id {kind}, score long")


def _blocks(items: DataFrame, item_col: str, text_col: str, block_bytes: int) -> Iterator[list]:
    """The items, in parts of about ``block_bytes`` of text by a hash of the item; one part at a time is held."""
    rows = items.select(F.col(item_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = int(-(-total // block_bytes)) or 1
    part: Column = F.pmod(F.xxhash64("id", "text"), F.lit(count))
    for number in range(count):
        yield rows.filter(part == number).collect()


def top_documents(
    docs: DataFrame,
    items: DataFrame,
    top: int = TOP,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents of every item by score, then by id, null last.

    A term's weight is floor(1000 ln((2N + 2) / (2 df + 1))), a document's
    norm 75 + 25 n N div L, and the score sums weight * (10^9 tf div
    (1000 tf + 12 norm)) over the item's terms, repeats included. Null and
    wordless texts have no terms and are neither found nor find. Repeated rows
    of either table each count as one; a document or item of null id is one
    like others.
    """
    spark = docs.sparkSession
    context = spark.sparkContext
    kind = items.schema[item_col].dataType.simpleString()
    out = None
    for block in _blocks(items, item_col, item_text_col, block_bytes):
        texts = [term_counts(r.text.encode()) for r in block]
        terms = sorted(set().union(*texts)) if texts else []
        listed = context.broadcast(terms)
        vectors = stored(_vectors(docs, listed, id_col, text_col), "restricted")
        listed.destroy()
        totals = vectors.agg(F.count(F.when(F.col("n") > 0, 1)).alias("docs"), F.sum("n").alias("terms")).first()
        if not totals.docs or not terms:
            continue
        # One row for each term of the block.
        held = {r.term: r.df for r in vectors.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect()}
        table = spark.createDataFrame([(i, held.get(i, 0)) for i in range(len(terms))], "term int, df long")
        weight = F.floor(1000 * F.log(F.lit(2.0 * totals.docs + 2) / (2 * F.col("df") + 1))).cast("long")
        weights = {r.term: r.weight for r in table.select("term", weight.alias("weight")).collect()}
        # The most frequent terms come first on every path.
        rank = {t: i for i, t in enumerate(sorted(range(len(terms)), key=lambda t: (-held.get(t, 0), t)))}
        number = {term: t for t, term in enumerate(terms)}
        asked = []
        for counts in texts:
            mine = sorted((rank[number[t]], weights[number[t]] * n) for t, n in counts.items() if held.get(number[t]))
            asked.append((np.array([m[0] for m in mine], np.int64), np.array([m[1] for m in mine], np.int64)))
        ranks = context.broadcast(np.array([rank[t] for t in range(len(terms))], np.int32))
        norm = F.lit(75) + F.expr(f"cast(25 * cast(n as decimal(20,0)) * {totals.docs}BD div {totals.terms}BD as long)")
        questions = context.broadcast(asked)
        found = _searched(_ranked(vectors.filter("size(terms) > 0").withColumn("m", norm.cast("long")), ranks), questions, len(terms), top)
        found = stored(found, "found")
        ranks.destroy()
        questions.destroy()
        names = spark.createDataFrame([(i, r.id) for i, r in enumerate(block)], f"item long, item_id {kind}")
        order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
        best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
        best = best.join(names, "item").select("item_id", "rank", F.col("id").alias("doc_id"), "score")
        out = best if out is None else out.unionByName(best)
    if out is not None:
        return out
    id_kind = docs.schema[id_col].dataType.simpleString()
    return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id {id_kind}, score long")


def _ranked(vectors: DataFrame, ranks) -> DataFrame:
    """Vectors with terms named by rank and in that order."""
    kind = vectors.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("terms")
            sizes = lists.value_lengths().to_numpy().astype(np.int64)
            named = ranks.value[lists.flatten().to_numpy()]
            tfs = batch.column("tfs").flatten().to_numpy()
            row = np.repeat(np.arange(len(sizes)), sizes)
            order = np.lexsort((named, row))
            at = pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32))
            sorted_lists = [pa.ListArray.from_arrays(at, pa.array(values[order])) for values in (named, tfs)]
            columns = [batch.column("id"), batch.column("m"), *sorted_lists]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "m", "terms", "tfs"])

    return vectors.select("id", "m", "terms", "tfs").mapInArrow(run, f"id {kind}, m long, terms array<int>, tfs array<long>")

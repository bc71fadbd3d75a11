import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from epistride.llm import lexical, queries
from tests.oracle import compare, connect

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return TERM.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def plain_top(docs, items, top=20):
    """Sorted (item_id, rank, doc_id, score)."""
    counts = [Counter(terms_of(text)) for _, text in docs]
    sizes = [c.total() for c in counts]
    total, with_terms = sum(sizes), sum(n > 0 for n in sizes)
    df = Counter(t for c in counts for t in c)
    out = []
    for item, text in items:
        scores = []
        for (doc, _), c, n in zip(docs, counts, sizes):
            score = 0
            for term in terms_of(text):
                if c[term]:
                    weight = math.floor(1000 * math.log((2 * with_terms + 2) / (2 * df[term] + 1)))
                    norm = 100 - 25 + 25 * n * with_terms // total
                    score += weight * (1_000_000_000 * c[term] // (1000 * c[term] + 12 * norm))
            if score > 0:
                scores.append((-score, doc is None, doc or 0, doc))
        out += [(item, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scores, key=lambda s: s[:3])[:top], 1)]
    return sorted(out, key=repr)


def found(spark, docs, items, **options):
    given_docs = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", *[f"'x' AS {c}" for c in ("id", "n", "terms", "m", "score", "rank")])
    given_items = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'x' AS id", "'x' AS item")
    return sorted((tuple(r) for r in lexical.top_documents(given_docs, given_items, **options).collect()), key=repr)


def made(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(30)] + ["É", "é", "Z9", "ab c"]
    text = lambda k: " ".join(rng.choice(words[: rng.randint(2, len(words))]) for _ in range(k))
    docs = [(i, text(rng.randint(0, 40))) for i in range(n)] + [(500 + i, "w1 w2 w2 W3") for i in range(30)]
    docs += [(3, "w1 w9 w9"), (3, "w1 w9 w9"), (None, "w9 w9 É"), (901, None), (902, "!?"), (903, "w4 " * 5000)]
    items = [(i, text(rng.randint(1, 9))) for i in range(12)] + [(90, None), (91, ""), (92, "nowhere"), (None, "w1 w9"), (5, "w1"), (5, "w1")]
    return docs, items


@pytest.mark.parametrize("seed, tree, block", [(1, 4096, 1 << 20), (2, 40, 40), (3, 64, 1 << 20)])
def test_best_documents_are_those_of_all(spark, monkeypatch, seed, tree, block):
    monkeypatch.setattr(lexical, "TREE_DOCS", tree)
    docs, items = made(seed, 400)
    assert found(spark, docs, items, block_bytes=block) == plain_top(docs, items)


def test_empty_tables(spark):
    assert found(spark, [], [(1, "a")]) == []
    assert found(spark, [(1, "a")], []) == []
    assert found(spark, [(1, None), (2, "..")], [(1, "a")]) == []


VECTORS = st.lists(st.dictionaries(st.integers(0, 7), st.integers(1, 5), max_size=6), max_size=40)


@settings(max_examples=200, deadline=None)
@given(VECTORS, st.dictionaries(st.integers(0, 7), st.integers(0, 50), min_size=1), st.integers(1, 6), st.integers(1, 5), st.data())
def test_search_loses_no_document(vectors, question, leaf, top, data):
    norms = np.array([data.draw(st.integers(75, 200)) for _ in vectors], np.int64)
    at = np.r_[0, np.cumsum([len(v) for v in vectors])].astype(np.int64)
    entries = [sorted(v.items()) for v in vectors]
    terms, tfs = (np.array([e[i] for v in entries for e in v], np.int64) for i in (0, 1))
    tree = lexical.Tree(at, terms, tfs, norms, 8, leaf)
    asked = np.array(sorted(question), np.int64)
    weights = np.array([question[t] for t in asked.tolist()], np.int64)
    best = lexical._Best(top)
    seen = []

    def offer(docs, scores):
        seen.extend(docs.tolist())
        return best.add(scores.tolist(), docs.tolist())

    tree.search(asked, weights, best.least, offer, np.full(8, -1, np.int64))
    scores = [sum(question.get(t, 0) * int(lexical._gain(np.int64(tf), norm)) for t, tf in v) for v, norm in zip(entries, norms)]
    wanted = sorted(((-s, d) for d, s in enumerate(scores) if s > 0))[:top]
    assert best.rows == [(-s, d) for s, d in wanted]
    assert len(seen) == len(set(seen))


def test_bounded_subtrees_are_left_out():
    """One document that holds the whole item spares the search of the leaves that hold only its first term."""
    n = 1000
    at = np.arange(n + 1, dtype=np.int64)
    at[1:] += 1  # the first document has two terms
    terms = np.r_[0, 7, np.zeros(n - 1, np.int64)].astype(np.int64)
    tree = lexical.Tree(at, terms, np.ones(len(terms), np.int64), np.r_[75, np.arange(80, 80 + n - 1)].astype(np.int64), 8)
    best, offered = lexical._Best(1), []

    def offer(docs, scores):
        offered.append(len(docs))
        return best.add(scores.tolist(), docs.tolist())

    tree.search(np.array([0, 7]), np.array([1, 100]), 1, offer, np.full(8, -1, np.int64))
    assert best.rows[0][1] == 0 and sum(offered) <= 3 * lexical.LEAF_DOCS


def test_query_equals_oracle(spark, folder):
    name = "op13_document_tree_search"
    assert compare(queries.QUERIES[name](spark, folder), connect(folder), queries.ORACLES[name]) is None

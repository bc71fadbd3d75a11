import base64

import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st

from epistride.llm import packing, queries


PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@pytest.fixture(scope="module")
def encoding():
    lines = (line.split() for line in open(packing.VOCABULARY, "rb").read().splitlines() if line)
    ranks = {base64.b64decode(a): int(b) for a, b in lines}
    return tiktoken.Encoding("test", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def documents_of(rows):
    """Token ids of each document, put together from packed rows; checks every row's form."""
    pieces = {}
    for r in rows:
        ids, ends, places = np.frombuffer(r.ids, "<u2"), r.cu_seqlens, np.frombuffer(r.positions, "<u2")
        length = len(ids)
        assert len(places) == length and ends[0] == 0 and ends[-1] == r.n_tokens <= length
        edges = [*ends, length] if ends[-1] < length else ends
        for a, b in zip(edges, edges[1:]):
            assert (places[a:b] == np.arange(b - a)).all()
        assert (ids[r.n_tokens :] == packing.PAD).all()
        for doc, piece, a, b in zip(r.doc_ids, r.pieces, ends, ends[1:]):
            assert (doc, piece) not in pieces
            pieces[doc, piece] = ids[a:b].tolist()
    out = {}
    for doc, piece in sorted(pieces, key=lambda k: (k[0] is None, k)):
        out.setdefault(doc, []).extend(pieces[doc, piece])
    return out


def test_query_round_trip(spark, folder, texts, encoding):
    rows = queries.QUERIES["op10_packed_rows"](spark, folder).collect()
    got = documents_of(rows)
    assert got == {d: encoding.encode_ordinary(t) + [packing.END_ID] for d, t, _ in texts}
    used = sum(r.n_tokens for r in rows)
    assert used / (len(rows) * packing.ROW_TOKENS) > 0.95


def test_unpack(spark, folder):
    docs = queries.table(spark, folder, "documents")
    pieces = packing.token_pieces(docs, 64)
    rows = lambda df: sorted((r.id, r.piece, r.n, bytes(r.ids)) for r in df.collect())
    assert rows(packing.unpack(packing.packed_rows(pieces, 3, 64))) == rows(pieces)


def plain_best_fit(sizes, capacity):
    bins = []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        fitting = [b for b in bins if b[0] >= sizes[i]]
        if fitting:
            best = min(fitting, key=lambda b: b[0])
        else:
            best = [capacity, []]
            bins.append(best)
        best[0] -= sizes[i]
        best[1].append(i)
    return bins


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 37), max_size=60), st.integers(37, 70))
def test_best_fit_decreasing(sizes, capacity):
    got = packing.best_fit_decreasing(np.array(sizes, np.int64), capacity)
    want = plain_best_fit(sizes, capacity)
    assert sorted(i for row in got for i in row) == list(range(len(sizes)))
    room = lambda rows: sorted(capacity - sum(sizes[i] for i in row) for row in rows)
    assert room(got) == room([b[1] for b in want])


def test_odd_rows(spark, table, encoding):
    long = "some words of a long text " * 20_000
    rows = [(1, None, "a"), (2, "", None), (3, long, "a"), (None, "null id", "a"), (5, "é\u0000ß 漢字 \U0001f600", "b"), (6, "x" * 200_000, "b")]
    got = documents_of(packing.pack(table(rows), 128).collect())
    assert got == {d: encoding.encode_ordinary(t or "") + [packing.END_ID] for d, t, _ in rows}
    assert packing.pack(table(rows).limit(0)).count() == 0


def test_repeated_rows_stay(spark, table):
    rows = packing.pack(table([(1, "same", "a"), (1, "same", "a")]), 128).collect()
    assert sum(r.n_tokens for r in rows) == 4 and rows[0].doc_ids == [1, 1]


def test_long_text_in_parts(encoding, monkeypatch):
    monkeypatch.setattr(packing, "PART_CHARS", 5)
    tokens = packing.Tokens(open(packing.VOCABULARY, "rb").read())
    text = "alpha's  beta \n gamma 12 34, delta\t é  \n\n epsilon we'll   end  "
    assert np.frombuffer(tokens.ids(text), "<u2").tolist() == encoding.encode_ordinary(text)


def test_many_equal_rows_are_dealt_to_many_shards(spark, table, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_BYTES", 2_000)
    docs = table([(1, "a text that very many rows hold", "s")] * 600 + [(2, "another", "s")] * 3)
    rows = packing.pack(docs, 64).collect()
    held = [sum(d == 1 for d in r.doc_ids) for r in rows]
    assert sum(held) == 600 and sum(d == 2 for r in rows for d in r.doc_ids) == 3
    shards = {r.shard for r in rows if 1 in r.doc_ids}
    assert len(shards) > 5

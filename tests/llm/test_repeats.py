import hashlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from epistride.llm import queries, repeats

N = repeats.LENGTH


def plain(texts):
    """(n_bytes, n_removed, n_spans, kept) of each text."""
    seen = Counter(t[i : i + N] for t in texts for i in range(len(t) - N + 1))
    for t in texts:
        flag = bytearray(len(t))
        for i in range(len(t) - N + 1):
            if seen[t[i : i + N]] > 1:
                flag[i : i + N] = b"\1" * N
        runs = sum(1 for i, f in enumerate(flag) if f and not (i and flag[i - 1]))
        yield len(t), sum(flag), runs, bytes(b for b, f in zip(t, flag) if not f)


def test_query_against_brute_force(spark, folder, texts):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.QUERIES["op9_repeated_strings"](spark, folder).collect()}
    want = plain([(t or "").encode() for _, t, _ in texts])
    assert got == {d: (n, r, s, hashlib.sha256(k).hexdigest()) for (d, _, _), (n, r, s, k) in zip(texts, want)}


def check(spark, table, texts, **options):
    docs = table([(i, t, "s") for i, t in enumerate(texts)])
    got = {r.id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in repeats.without_repeats(docs, **options).collect()}
    assert got == dict(enumerate(plain([(t or "").encode() for t in texts])))


def words(rng, n, of=5000):
    return " ".join(f"w{i}" for i in rng.integers(0, of, n))


@pytest.mark.parametrize("crowded", [1, 2, 4000])
def test_shared_passages(spark, table, crowded):
    rng = np.random.default_rng(0)
    passage, other = words(rng, 70), words(rng, 45)
    texts = [words(rng, int(rng.integers(0, 60))) + " " + passage[int(rng.integers(0, 60)) : 260 + int(rng.integers(0, 60))] + words(rng, 20) for _ in range(25)]
    texts += [other, "x" + other, other + "y", other[:199], other[:200], "z" + other[1:201], "ab" * 150, "c" * 500, "c" * 200, None, "", "short"]
    texts += [words(rng, 900)] * 3 + ["é" * 120, "aé" * 100, "é" * 99]
    check(spark, table, texts, crowded=crowded)


def test_common_lines_beside_passages(spark, table):
    """A line in all texts that is too short by itself, and passages around it that some texts share."""
    rng = np.random.default_rng(4)
    line = words(rng, 20)[:90]
    passage = words(rng, 30)[:140]
    texts = [words(rng, 15) + line + words(rng, 15) for _ in range(40)]
    texts += [words(rng, 10) + passage[i % 7 :] + line + words(rng, 12) for i in range(12)]
    texts += [words(rng, 10) + line + passage[: 110 + i % 7] + words(rng, 12) for i in range(12)]
    for crowded in (3, 30, 20_000):
        check(spark, table, texts, crowded=crowded)


def test_string_beside_itself(spark, table):
    check(spark, table, ["q" * 200, "r" * 201, "st" * 101, "uvw" * 67])


def test_long_text_in_parts(spark, table, monkeypatch):
    rng = np.random.default_rng(1)
    text = words(rng, 3000, 10**6)
    monkeypatch.setattr(repeats, "_BUFFER", 2000)
    check(spark, table, [text + text[5000:5500], words(rng, 50), text[100:900]])


def test_odd_rows(spark, table):
    text = "a text that is longer than the shortest string looked for, " * 5
    docs = table([(1, text, "a"), (1, text, "a"), (None, text, "b"), (None, None, "b"), (2, "short", None)])
    got = sorted((str(r.id), r.n_bytes, r.n_removed, bytes(r.kept)) for r in repeats.without_repeats(docs).collect())
    n = len(text)
    assert got == [("1", n, n, b""), ("1", n, n, b""), ("2", 5, 0, b"short"), ("None", 0, 0, b""), ("None", n, n, b"")]
    assert repeats.without_repeats(docs.limit(0)).count() == 0


def test_ranges_split_a_common_symbol(spark, table, monkeypatch):
    # One passage in many texts, dealt over ranges of a few rows: neighbours stand in different ranges.
    monkeypatch.setattr(repeats, "ROWS_PER_TASK", 3)
    rng = np.random.default_rng(2)
    passage = words(rng, 60)
    check(spark, table, [words(rng, 30) + passage for _ in range(12)] + [passage] * 4)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.binary(max_size=12)), min_size=1, max_size=12))
def test_common_prefixes(rows):
    rows.sort(key=lambda r: r[0])
    data = b"".join(t for _, t in rows) or b"\0"
    end = np.cumsum([len(t) for _, t in rows])
    start = end - np.array([len(t) for _, t in rows])
    matrix = repeats._word_matrix(np.frombuffer(data, np.uint8), start, end)
    got = repeats.common_prefixes(np.array([g for g, _ in rows]), matrix)
    for i, (g, t) in enumerate(rows):
        full = t.ljust(N, b"\0")
        others = [u.ljust(N, b"\0") for j, (h, u) in enumerate(rows) if h == g and j != i]
        assert got[i] == max((next((k for k in range(N) if full[k] != u[k]), N) for u in others), default=0)


def test_refine_is_a_stable_placement():
    order, block = np.arange(6), np.array([0, 0, 0, 1, 2, 2])
    order, block = repeats.refine(order, block, np.array([5, 3, 5, 9, 1, 1]))
    assert order.tolist() == [1, 0, 2, 3, 4, 5] and block.tolist() == [0, 1, 1, 2, 3, 3]


def test_equal_strings_have_equal_anchors():
    rng = np.random.default_rng(3)
    string = rng.integers(97, 123, N).astype(np.uint8).tobytes()
    places = set()
    for _ in range(30):
        before = rng.integers(97, 123, int(rng.integers(0, 400))).astype(np.uint8).tobytes()
        text = before + string + b"end"
        first, last, anchor, symbol, _ = repeats._anchors(text, np.array([len(text)]))
        at = np.flatnonzero((first <= len(before)) & (last >= len(before)))
        assert len(at) == 1
        places.add((int(anchor[at[0]]) - len(before), int(symbol[at[0]])))
    assert len(places) == 1

import hashlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from epistride.llm import fingerprints, queries


def plain_edits(texts):
    for i, (doc, text, _) in enumerate(texts):
        following = texts[(i + 1) % len(texts)][1] or ""
        half = len(text or "") // 2
        yield doc, text or "", following, (text or "")[: len(text or "") - half] + following[:half]


def test_query_against_plain_python(spark, folder, texts):
    got = {r.doc_id: r for r in queries.QUERIES["op3_multiset_fingerprints"](spark, folder).collect()}
    assert len(got) == len(texts)
    names = {}
    for doc, text, following, edited in plain_edits(texts):
        r, v = got[doc], fingerprints.vectors([t.encode() for t in (text, edited, following)])
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (fingerprints.digest(v[0]), fingerprints.digest(v[1]))
        near = fingerprints.likeness(v[[0, 0]], v[[1, 2]])
        assert (r.near_edited, r.near_next) == pytest.approx(tuple(near))
        assert names.setdefault(r.fingerprint, text) == text
    near = np.array([(r.near_edited, r.near_next) for r in got.values()])
    assert near[:, 0].mean() > 0.4 and near[:, 1].mean() < 0.1


PARAGRAPHS = st.lists(st.text(alphabet="ab é", min_size=1, max_size=30).filter(lambda p: not p.isspace()), max_size=6)


@settings(max_examples=100, deadline=None)
@given(PARAGRAPHS, st.randoms())
def test_order_insertion_and_deletion(paragraphs, random):
    whole = fingerprints.vectors(["\n".join(paragraphs).encode()])[0]
    moved = paragraphs[:]
    random.shuffle(moved)
    assert (whole == fingerprints.vectors(["\n\n".join(moved).encode()])[0]).all()
    summed = np.zeros(fingerprints.LANES, np.uint16)
    for p in paragraphs:
        summed = fingerprints.inserted(summed, p.encode())
    assert (summed == whole).all()
    for p in moved:
        summed = fingerprints.deleted(summed, p.encode())
    assert not summed.any()


def test_multiplicity_counts():
    one, two = fingerprints.vectors([b"a b c", b"a b c\na b c"])
    assert (one != two).any() and fingerprints.digest(one) != fingerprints.digest(two)


def test_likeness_follows_the_shared_part():
    rng = np.random.default_rng(0)
    words = [f"w{i}" for i in rng.integers(0, 10**6, 3000)]
    text = " ".join(words)
    for share in (0.1, 0.5, 0.9):
        n = int(3000 * share)
        other = " ".join(words[:n] + [f"v{i}" for i in rng.integers(0, 10**6, 3000 - n)])
        a = fingerprints.vectors([text.encode(), other.encode()])
        assert float(fingerprints.likeness(a[:1], a[1:])[0]) == pytest.approx(share, abs=0.12)


def test_long_paragraph_in_parts(monkeypatch):
    text = " ".join(f"w{i}" for i in range(3000)).encode()
    whole = fingerprints.vectors([text, b"x"])
    monkeypatch.setattr(fingerprints, "PART_BYTES", 100)
    assert (fingerprints.vectors([text, b"x"]) == whole).all()


@pytest.mark.parametrize("ranges", [1, 3, 50])
def test_odd_rows(spark, table, ranges):
    long = "many words in one line " * 60_000
    rows = [(5, long, "a"), (4, "", None), (3, "b text\nof lines", "a"), (3, "a text", "a"), (2, None, "b"), (1, "é漢\U0001f600 x", "b"), (None, "z of null", "b"), (None, "y of null", "b")]
    order = [rows[i] for i in (0, 1, 3, 2, 4, 5, 7, 6)]
    got = fingerprints.edited_fingerprints(table(rows), ranges=ranges).collect()
    want = sorted((str(d), len(t), hashlib.sha256(e.encode()).hexdigest()) for d, t, _, e in plain_edits(order))
    assert sorted((str(r.id), r.n_chars, r.edited_sha256) for r in got) == want
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)


def test_single_and_no_row(spark, table):
    one = table([(1, "abcd", "s")])
    r = fingerprints.edited_fingerprints(one).first()
    assert r.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and r.near_next == 1.0
    assert fingerprints.edited_fingerprints(one.limit(0)).count() == 0
    assert fingerprints.fingerprint_vectors(one.limit(0)).count() == 0


def test_vectors_of_rows(spark, table):
    got = {r.id: r for r in fingerprints.fingerprint_vectors(table([(1, "a b\n\nc", "s"), (2, None, "s")])).collect()}
    assert (got[1].paragraphs, got[2].paragraphs) == (2, 0)
    assert bytes(got[1].vector) == fingerprints.vectors([b"a b\nc"])[0].astype("<u2").tobytes()
    assert not any(got[2].vector)


@pytest.mark.parametrize("n", [33_000, 40_000, 60_000, 70_000])
def test_a_word_repeated_often_keeps_its_likeness(n):
    rng = np.random.default_rng(1)
    whole, half = "word " * n, "word " * (n // 2)
    part = half + " ".join(f"v{i}" for i in rng.integers(0, 10**6, n // 2))
    v = fingerprints.vectors([whole.encode(), part.encode()])
    # One lane holds n in one and n / 2 in the other: 2 * n * n/2 / (n * n + n/2 * n/2).
    assert float(fingerprints.likeness(v[:1], v[1:])[0]) == pytest.approx(0.8, abs=0.01)
    twice = fingerprints.inserted(v[0], whole.encode())
    assert (twice == fingerprints.vectors([(whole + "\n" + whole).encode()])[0]).all()
    assert (fingerprints.deleted(twice, whole.encode()) == v[0]).all()


@pytest.mark.parametrize("hot", [7, None])
def test_an_id_of_very_many_rows_is_cut(spark, table, monkeypatch, hot):
    """Rows of one id, some of them equal: all rows stand in one order, each before exactly one other."""
    monkeypatch.setattr(fingerprints, "MANY_ROWS", 10)
    rows = [(hot, f"{i:03d} a text of its own", "a") for i in range(80)] + [(hot, "same as many others", "a")] * 60
    rows += [(i, f"{900 + i} with an id", "b") for i in (1, 2, 8, 9)]
    got = fingerprints.edited_fingerprints(table(rows), ranges=6).collect()
    texts = {t for _, t, _ in rows}
    edited = {hashlib.sha256((a[: len(a) - len(a) // 2] + b[: len(a) // 2]).encode()).hexdigest(): (a, b) for a in texts for b in texts}
    assert len(edited) == len(texts) ** 2
    pairs = [edited[r.edited_sha256] for r in got]
    every = Counter(t for _, t, _ in rows)
    assert Counter(a for a, _ in pairs) == Counter(b for _, b in pairs) == every
    assert Counter(r.id for r in got) == Counter(i for i, _, _ in rows)
    # Ids descend, a crowded one's rows among themselves, and after the last comes the first.
    by_text = {t: i for i, t, _ in rows}
    steps = Counter((by_text[a], by_text[b]) for a, b in pairs if by_text[a] != by_text[b])
    order = [9, 8, 7, 2, 1] if hot else [9, 8, 2, 1, None]
    assert steps == Counter(zip(order, order[1:] + order[:1]))

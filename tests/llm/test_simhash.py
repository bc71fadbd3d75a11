import numpy as np
import xxhash
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from epistride.llm import queries, simhash


def plain_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def plain_components(prints, ids):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= 4:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    groups = {}
    for i in range(len(prints)):
        groups.setdefault(find(i), []).append(ids[i])
    return {i: min((ids[k] for k in range(len(prints)) if find(k) == find(i) and ids[k] is not None), default=None) for i in range(len(prints))}


def test_query_against_brute_force(spark, folder, texts):
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in queries.QUERIES["op7_simhash_golay"](spark, folder).collect()}
    prints = [plain_print(t) for _, t, _ in texts]
    ids = [d for d, _, _ in texts]
    want = plain_components(prints, ids)
    assert got == {d: (prints[i], want[i]) for i, d in enumerate(ids)}


def test_golay_decoding():
    rng = np.random.default_rng(0)
    message = rng.integers(0, 1 << 12, 500)
    code = message << 11
    rest = code.copy()
    for bit in range(22, 10, -1):
        rest = np.where(rest >> bit & 1, rest ^ (simhash.GOLAY_GENERATOR << (bit - 11)), rest)
    code ^= rest
    for flips in range(4):
        word = code.copy()
        for i in range(len(word)):
            for b in rng.choice(23, flips, replace=False):
                word[i] ^= 1 << int(b)
        assert (simhash.codeword_index(word) == message).all()


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 2**64 - 1), st.sets(st.integers(0, 63), max_size=4))
def test_linked_prints_share_a_key(value, flips):
    other = value
    for b in flips:
        other ^= 1 << b
    _, a = simhash.golay_keys(np.array([value], np.uint64))
    _, b = simhash.golay_keys(np.array([other], np.uint64))
    assert set(a) & set(b)


def linked(spark, prints, monkeypatch, dense):
    monkeypatch.setattr(simhash, "DENSE", dense)
    df = spark.createDataFrame([(int(np.uint64(p).view(np.int64)),) for p in prints], "fp long")
    links = [(np.int64(r.a).view(np.uint64), np.int64(r.b).view(np.uint64)) for r in simhash.fingerprint_links(df).collect()]
    root = {int(p): int(p) for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        assert int(a ^ b).bit_count() <= 4 * len(prints)
        x, y = find(int(a)), find(int(b))
        root[max(x, y)] = min(x, y)
    return {p: find(p) for p in root}


def test_dense_keys_lose_no_link(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = int(rng.integers(0, 1 << 62))
    prints = {base}
    while len(prints) < 60:
        p = base
        for b in rng.choice(64, int(rng.integers(1, 7)), replace=False):
            p ^= 1 << int(b)
        prints.add(p)
    prints = sorted(prints)
    want = {}
    for p in prints:
        seen, todo = {p}, [p]
        while todo:
            a = todo.pop()
            for b in prints:
                if b not in seen and (a ^ b).bit_count() <= 4:
                    seen.add(b)
                    todo.append(b)
        want[p] = min(seen)
    assert linked(spark, prints, monkeypatch, 1024) == want


def test_midpoints_join_all_close_prints():
    rng = np.random.default_rng(4)
    a = rng.integers(0, 1 << 63, 1, dtype=np.uint64)
    for flips in range(5):
        b = a.copy()
        for bit in rng.choice(64, flips, replace=False):
            b ^= np.uint64(1) << np.uint64(bit)
        assert len(np.intersect1d(simhash.midpoints(a), simhash.midpoints(b)))


def test_dense_rows_come_back_and_meet_at_midpoints():
    import pyarrow as pa

    prints = np.arange(8, dtype=np.int64)
    batch = pa.RecordBatch.from_arrays([pa.array(np.zeros(8, np.int32)), pa.array(prints)], names=["key", "fp"])
    old, simhash.DENSE = simhash.DENSE, 3
    try:
        out = pa.Table.from_batches(list(simhash._bucket_links(iter([batch.slice(0, 2), batch.slice(2, 3), batch.slice(5)]))))
    finally:
        simhash.DENSE = old
    assert sorted(out.column("a").to_pylist()) == prints.tolist() and out.column("b").null_count == 8
    words = simhash.midpoints(prints.view(np.uint64)).view(np.int64)
    rows = sorted((int(w), int(p)) for p, ws in zip(prints, words) for w in ws)
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows])], names=["word", "fp"])
    tied = pa.Table.from_batches(list(simhash._tied_to_first(iter([batch.slice(0, 100), batch.slice(100)]))))
    root = {int(p): int(p) for p in prints}
    for a, b in zip(tied.column("a").to_pylist(), tied.column("b").to_pylist()):
        assert (a ^ b).bit_count() <= 4
        low, high = sorted((root[a], root[b]))
        root = {k: low if v == high else v for k, v in root.items()}
    assert set(root.values()) == {0}


def test_odd_rows(spark, table):
    long = "word " * 300_000
    text = "one two three four five six seven eight nine ten"
    docs = table([(1, None, "a"), (2, "", None), (3, " \n\t", "a"), (4, text, "a"), (4, text, "a"), (None, text, "b"), (5, long, "b"), (6, "two words", "b")])
    got = simhash.near_duplicates(docs).collect()
    assert sorted((r.id is None, r.id or 0, r.component_id) for r in got) == [
        (False, 1, 1), (False, 2, 1), (False, 3, 1), (False, 4, 4), (False, 4, 4), (False, 5, 5), (False, 6, 6), (True, 0, 4),
    ]
    assert {r.fingerprint for r in got if r.id in (1, 2, 3)} == {"0" * 16}
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 4, 5, 6]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0 and simhash.keep_one(docs.limit(0)).count() == 0


def test_null_ids_keep_one_row(spark, table):
    docs = table([(None, "a b c d e", "s"), (None, "a b c d e", "s"), (3, "quite another text of some words", "s")])
    assert sorted(str(r.doc_id) for r in simhash.keep_one(docs).collect()) == ["3", "None"]


def test_long_text_in_pieces(monkeypatch):
    text = " ".join(f"w{i % 97}x{i % 89}" for i in range(4000))
    monkeypatch.setattr(simhash, "_PIECE", 100)
    assert simhash.fingerprint(text.encode()) == plain_print(text)


def test_spark_hash_is_the_same(spark):
    row = spark.createDataFrame([("the quick brown fox",)], "s string").select(F.xxhash64("s").alias("h")).first()
    assert row.h & (2**64 - 1) == xxhash.xxh64_intdigest(b"the quick brown fox", 42)


def test_rows_that_share_an_id_or_have_none(spark, table):
    a, b, c = ("first text about the harbour", "second one on mountain paths", "third of bread and its baker")
    kept = lambda rows: sorted((str(r.doc_id), r.text) for r in simhash.keep_one(table(rows)).collect())
    assert kept([(None, a, "s"), (None, b, "s"), (None, b, "s")]) == [("None", a), ("None", b)]
    assert kept([(1, a, "s"), (1, b, "s"), (2, c, "s")]) == [("1", a), ("1", b), ("2", c)]
    # Id 2 comes from a component of its own and from that of id 1.
    assert kept([(1, a, "s"), (2, a, "s"), (2, b, "s")]) == [("1", a), ("2", b)]


def test_prints_alike_in_two_segments_share_a_wide_key():
    rng = np.random.default_rng(4)
    starts = np.cumsum([0, *simhash.SEGMENTS])
    for pair, (a, b) in enumerate(((0, 1), (0, 2), (1, 2))):
        bits = [bit for s in (a, b) for bit in range(starts[s], starts[s + 1])]
        third = ({0, 1, 2} - {a, b}).pop()
        for _ in range(60):
            x = int(rng.integers(0, 1 << 63)) * 2 + int(rng.integers(0, 2))
            y = x ^ sum(1 << bit for bit in rng.choice(bits, int(rng.integers(0, 3)), replace=False).tolist())
            y ^= int(rng.integers(0, 1 << simhash.SEGMENTS[third])) << int(starts[third])
            far = x ^ sum(1 << bit for bit in rng.choice(bits, 3, replace=False).tolist())
            words = [set(w.tolist()) for w in simhash.wide_keys(np.array([x, y, far], np.uint64), np.array([pair] * 3))]
            assert words[0] & words[1] and not words[0] & words[2]

import numpy as np

import corpus_pipeline
from epistride.llm import nearcopies, simhash


def plain_shingles(text, width=5):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def plain_kept(rows, least=0.8):
    """The least id of each component, all pairs compared."""
    sets = [plain_shingles(t) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            union = len(a | sets[j])
            if not union or len(a & sets[j]) / union >= least:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    return sorted(min(g) for g in groups.values())


def edited(rng, words, n):
    words = list(words)
    for at in rng.choice(len(words), n, replace=False):
        words[at] = f"v{rng.integers(10**9)}"
    return words


def test_stage_against_brute_force(spark, folder, texts):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = sorted(r.doc_id for r in corpus_pipeline._one_of_each(spark, docs, folder).collect())
    assert got == plain_kept(texts)
    # Alike to 0.83, their prints nine bits apart.
    assert 1 in got and 177 not in got


def test_chains_and_large_groups(spark, table):
    rng = np.random.default_rng(5)
    rows, doc = [], 0
    for size in (2, 3, 40):
        words = [f"w{i}" for i in rng.integers(0, 10**6, 300)]
        for k in range(size):
            # Chains: each is near the one before it, but not the first of all.
            words = edited(rng, words, 5) if k else words
            rows.append((doc, " ".join(words), "s"))
            doc += 1
    base = [f"w{i}" for i in rng.integers(0, 10**6, 200)]
    for k in range(40):
        rows.append((doc, " ".join(edited(rng, base, int(rng.integers(1, 9)))), "s"))
        doc += 1
    want = plain_kept(rows)
    assert len(want) < len(rows) / 2
    got = simhash.keep_one(table(rows), near=nearcopies.near_copies)
    assert sorted(r.doc_id for r in got.collect()) == want


def test_common_passages_join_nothing_and_hide_nothing(spark, table):
    """Texts that share most of their words with all others, a few of which are alike beyond that."""
    rng = np.random.default_rng(8)
    passage = [f"p{i}" for i in range(150)]
    rows = []
    for doc in range(120):
        own = [f"o{rng.integers(10**9)}" for _ in range(int(rng.integers(30, 60)))]
        rows.append((doc, " ".join(passage + own), "s"))
    for doc in range(120, 126):
        rows.append((doc, " ".join(edited(rng, rows[doc - 120][1].split(), 2)), "s"))
    want = plain_kept(rows)
    assert len(want) >= 110
    assert sorted(r.doc_id for r in simhash.keep_one(table(rows), near=nearcopies.near_copies).collect()) == want


def test_prefixes_meet_for_every_alike_pair(spark):
    rng = np.random.default_rng(9)
    base = rng.integers(1, 1 << 62, 60)
    made = [np.unique(np.r_[rng.choice(base, 55, replace=False), rng.integers(1, 1 << 62, int(rng.integers(0, 9)))]) for _ in range(60)]
    df = spark.createDataFrame([(i, i, m.astype(np.uint64).tobytes()) for i, m in enumerate(made)], "node long, root long, hashes binary")
    pairs = nearcopies._crossing_pairs(nearcopies.rare_prefixes(df, 0.8), 0.8)
    got = {(r.b, r.a) for r in pairs.collect()}
    alike = {(i, j) for j in range(60) for i in range(j) if nearcopies.similarity(made[i], made[j]) >= 0.8}
    assert alike and alike <= got


def test_odd_rows(spark, table):
    text = "one two three four five six seven eight nine ten"
    docs = table([(1, None, "a"), (2, "", None), (3, " \n\t", "a"), (4, text, "a"), (4, text, "a"), (None, text.upper(), "b"), (5, "word " * 300_000, "b"), (6, "two words", "b"), (7, "Two  words", "b")])
    got = simhash.keep_one(docs, near=nearcopies.near_copies)
    assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect()) == [1, 4, 5, 6]
    assert simhash.keep_one(docs.limit(0), near=nearcopies.near_copies).count() == 0


def test_long_text_in_pieces(monkeypatch):
    text = " ".join(f"w{i % 97}x{i % 89}" for i in range(4000)).encode()
    whole = nearcopies.shingles(text)
    monkeypatch.setattr(simhash, "_PIECE", 100)
    assert (nearcopies.shingles(text) == whole).all() and len(whole) == len(plain_shingles(text.decode()))


def test_fingerprints_propose_what_bands_miss(spark, folder, table):
    """Alike to 0.8, three bits apart, and without a common MinHash band: only Golay keys propose the pair."""
    base = [f"b{i}" for i in range(12)]
    a, b = (" ".join([*base, last]) for last in ("e1919", "e3032"))
    assert not set(nearcopies.bands(nearcopies.shingles(a.encode()))) & set(nearcopies.bands(nearcopies.shingles(b.encode())))
    docs = table([(1, a, "s"), (2, b, "s"), (3, " ".join(reversed(base)), "s")])
    assert plain_kept([(1, a), (2, b)]) == [1]
    assert sorted(r.doc_id for r in corpus_pipeline._one_of_each(spark, docs, folder).collect()) == [1, 3]


def test_fingerprints_only_propose(spark, folder, table):
    """Passages said very often make equal fingerprints of texts that are not alike; some of these are, in chains too."""
    rng = np.random.default_rng(12)
    often = "alpha beta gamma delta epsilon " * 400
    rows, words = [], None
    for doc in range(60):
        words = edited(rng, words, 1) if doc % 6 in (1, 2) else [f"q{rng.integers(10**9)}" for _ in range(80)]
        rows.append((doc, often + " ".join(words), "s"))
    # Equal sets of shingles whose repeats differ: one node under two fingerprints.
    rows.append((60, rows[0][1].replace(often, often[: len(often) // 200]), "s"))
    prints = [simhash.fingerprint(t.encode()) for _, t, _ in rows[:60]]
    assert all((p ^ prints[0]).bit_count() <= simhash.DISTANCE for p in prints)
    want = plain_kept(rows)
    assert len(want) == 40
    got = corpus_pipeline._one_of_each(spark, table(rows), folder)
    assert sorted(r.doc_id for r in got.collect()) == want

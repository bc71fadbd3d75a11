import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from epistride.llm import prefixtrie, queries
from tests.oracle import compare, connect

SCHEMA = "conv_id long, turn long, role string, text string"


def plain_rebuilt(rows, longest):
    held = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:32]
            held[conv].append((turn is not None, turn or 0, digest, role, text))
    turns = {c: [t[3:] for t in sorted(ts)] for c, ts in held.items()}
    out = {}
    for c, own in turns.items():
        head = zlib.crc32(str(c).encode()) % (longest + 1)
        base = c - (abs(c) % 100 if c >= 0 else -(abs(c) % 100))
        out[c] = turns.get(base, [])[:head] + own[head:]
    return out


def plain_nodes(rebuilt):
    members = defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    found = []
    for node, convs in members.items():
        below = [n for n in members if n[: len(node)] == node]
        ends = sorted(c for c in convs if len(rebuilt[c]) == len(node))
        children = [n for n in below if len(n) == len(node) + 1]
        leaves = [n for n in below if not any(len(m) == len(n) + 1 and m[: len(n)] == n for m in below)]
        saved = sum((len(members[n]) - 1) * (len(n[-1][1]) if n else 0) for n in below)
        parent = min(members[node[:-1]]) if node else None
        digest = hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()
        found.append((min(convs), len(node), parent, len(convs), len(children), len(leaves), saved, digest))
    return sorted(found)


def trie_of(spark, rows, width=prefixtrie.BLOCK):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", *[f"'x' AS {c}" for c in ("conv", "pos", "k", "key", "n", "chain", "__salt")])
    turns = prefixtrie.numbered_turns(df)
    conv = F.col("conv")
    head = F.crc32(conv.cast("string").cast("binary")) % 6
    trie = prefixtrie.prefix_trie(*prefixtrie.with_shared_heads(turns, conv - conv % 100, head, 5), width)
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(r) for r in prefixtrie.with_ends_digest(trie).select(*columns).collect())


def made_rows(seed, convs=60, hot=0):
    rng = random.Random(seed)
    ids = [0, 100, -100] + [rng.choice([7, 107, -5, 200, 301]) + i for i in range(convs)]
    rows = []
    for c in ids:
        for turn in range(rng.choice([0, 1, 2, 3, 7, 9])):
            rows.append((c, rng.choice([turn, turn, None]), rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "é\n", "", None])))
    rows += [(100, i, "user", f"t{i % 3}") for i in range(hot)]
    return rows + rows[:5] + [(None, 1, "user", "nobody")]


@pytest.mark.parametrize("seed, width, hot", [(1, 4, 0), (2, 1, 0), (3, 3, 40)])
def test_nodes_are_those_of_all_prefixes(spark, monkeypatch, seed, width, hot):
    monkeypatch.setattr(prefixtrie, "PART", 2)
    monkeypatch.setattr(prefixtrie, "PIECE_BYTES", 8)
    rows = made_rows(seed, hot=hot)
    assert trie_of(spark, rows, width) == plain_nodes(plain_rebuilt(rows, 5))


def test_copies_and_conversations_without_turns(spark):
    # Conversation 101 and its like lose all their own turns to the absent base's heads where the head is long enough.
    rows = [(c, t, "user", "same") for c in range(101, 131) for t in range(3)]
    assert trie_of(spark, rows) == plain_nodes(plain_rebuilt(rows, 5))


def test_empty_table(spark):
    assert trie_of(spark, []) == []


def test_query_equals_oracle(spark, folder):
    name = "op11_prefix_trie"
    assert compare(queries.QUERIES[name](spark, folder), connect(folder), queries.ORACLES[name]) is None

import hashlib
import random

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from epistride.llm import chatlog, queries
from tests.oracle import compare, connect

LOG = "conv long, message long, seq long, kind string, role string, text string"
PIECES = st.lists(st.sampled_from(["\\", "<turn>", "<says>", "</turn>", "<", "/turn>", "a", "\n", "é"]), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(PIECES, PIECES), max_size=4))
def test_rendered_turns_are_read_back(turns):
    page = "".join(chatlog.rendered_turn(role, text) for role, text in turns)
    assert list(chatlog.parsed(page)) == turns
    for part in (p for turn in turns for p in turn):
        assert chatlog.unescaped(chatlog.escaped(part)) == part


def test_long_runs_of_backslashes_take_linear_time():
    text = "\\" * 300_000 + "x" + "\\" * 300_000
    assert chatlog.unescaped(chatlog.escaped(text)) == text
    assert list(chatlog.parsed(chatlog.rendered_turn("user", text))) == [("user", text)]


def replayed(events):
    """Final (role, text) of each conversation, event by event."""
    out = {}
    for conv in {e[0] for e in events}:
        told = {}
        for _, message, seq, kind, role, text in sorted({e for e in events if e[0] == conv}, key=lambda e: e[2]):
            if kind == "open":
                told[message] = [role, text or ""]
            elif kind == "delta" and message in told:
                told[message][1] += text or ""
            elif kind in ("edit", "regenerate"):
                if message in told:
                    told[message][1] = text or ""
                told = {m: t for m, t in told.items() if m <= message}
        out[conv] = [(told[m][0] or "", told[m][1]) for m in sorted(told)]
    return out


def made_log(seed, sizes):
    rng, events = random.Random(seed), []
    for conv, size in sizes.items():
        opened = []
        for seq in range(size):
            kind = rng.choice(["open", "open", "delta", "delta", "delta", "edit", "regenerate"]) if opened else "open"
            if kind in ("edit", "regenerate") and rng.random() < 0.7:
                kind = "delta"
            message = seq if kind == "open" else rng.choice(opened[-3:])
            if kind == "open":
                opened.append(message)
            role = rng.choice(["user", "assistant", None]) if kind == "open" else None
            events.append((conv, message, seq, kind, role, rng.choice(["", None, "a\\", "<turn>", "é\n", "</turn>x"])))
    return events + rng.sample(events, len(events) // 4)


def told(turns):
    loss = "".join(text for role, text in turns if role == "assistant")
    said = "".join(f"{role}\n{text}\n" for role, text in turns)
    chars = sum(len(chatlog.rendered_turn(*t)) for t in turns)
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    return len(turns), sha(said), len(loss), sha(loss), chars


@pytest.mark.parametrize("seed, page", [(1, 1), (2, 50), (3, 1 << 20)])
def test_log_is_folded_as_replayed(spark, monkeypatch, seed, page):
    monkeypatch.setattr(chatlog, "PAGE_CHARS", page)
    sizes = {c: c % 9 + 1 for c in range(40)} | {1000: 300, None: 200}
    events = made_log(seed, sizes)
    df = spark.createDataFrame(events, LOG).selectExpr("*", "'x' AS place", "'x' AS hot", "'x' AS block")
    pages = chatlog.rendered(df, F.col("message"))
    found = {r[0]: tuple(r)[1:] for r in chatlog.read_back(pages).collect()}
    assert found == {conv: told(turns) for conv, turns in replayed(events).items()}


def test_large_conversation_is_cut_and_its_pages_follow_on(spark):
    events = made_log(5, {1: 2000, 2: 3, 3: 4})
    pages = chatlog.rendered(spark.createDataFrame(events, LOG), F.col("message")).collect()
    cut = sorted((p for p in pages if p.conv == 1), key=lambda p: (p.block, p.page))
    assert len({p.block for p in cut}) > 1 and all(p.block == -1 for p in pages if p.conv != 1)
    assert [t for p in cut for t in chatlog.parsed(p.formatted)] == replayed(events)[1]
    assert all(p.n_turns == len(list(chatlog.parsed(p.formatted))) for p in pages)


def test_query_rows_without_texts_roles_turns_and_ids(spark):
    rows = [(1, None, None, None), (1, 0, "assistant", "x" * 1300), (1, 0, "assistant", "x" * 1300), (1, 1, "user", "é"), (None, 1, "system", "s"), (2, 5, "user", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    log = chatlog.log_of(df.selectExpr("*", "'x' AS conv", "'x' AS message", "'x' AS sum"))
    found = {r[0]: tuple(r)[1:] for r in chatlog.read_back(chatlog.rendered(log, F.col("place"))).collect()}
    long = ("assistant", "x" * 1300)
    assert found == {1: told([("", ""), long, long, ("user", "é")]), None: told([("system", "s")]), 2: told([("user", "")])}


def test_empty_log(spark):
    assert chatlog.read_back(chatlog.rendered(spark.createDataFrame([], LOG), F.col("message"))).collect() == []


def test_query_equals_oracle(spark, folder):
    name = "op12_chat_formatting"
    assert compare(queries.QUERIES[name](spark, folder), connect(folder), queries.ORACLES[name]) is None

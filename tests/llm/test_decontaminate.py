import pytest

from epistride.llm import decontaminate, queries
from tests.oracle import compare, connect


def test_query(spark, folder):
    name = "op8_decontamination"
    assert compare(queries.QUERIES[name](spark, folder), connect(folder), queries.ORACLES[name]) is None


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string, doc_id string")


WORDS = " ".join(f"w{i}" for i in range(14))


@pytest.mark.parametrize("block_bytes", [30, 1 << 20])
def test_hits_and_offsets(spark, table, block_bytes):
    bench = items(spark, [(1, WORDS, "x"), (2, "Só  breve!", "x"), (2, "Só  breve!", "x"), (3, None, "x"), (4, " ;", "x"), (None, "lonely", "x")])
    texts = {
        1: "Zz; W0 w1, w2 w3 w4 w5 w6 w7 w8 (w9)! end",
        2: "w1 w2 w3 w4 w5 w6 w7 w8 w9",
        3: "é só BREVE. é",
        4: WORDS + " " + WORDS,
        5: None,
        6: "",
        7: "a lonely word",
    }
    docs = table([(i, t, "s") for i, t in texts.items()] + [(None, texts[1], "s")])
    got = {r.id: r for r in decontaminate.benchmark_hits(docs, bench, block_bytes=block_bytes).collect()}
    told = {i: ([tuple(s) for s in r.word_runs], r["items"], r.n_words) for i, r in got.items()}
    assert told == {
        1: ([(1, 11)], [1], 12), 2: ([], [], 9), 3: ([(1, 3)], [2], 4), 4: ([(0, 28)], [1], 28),
        5: ([], [], 0), 6: ([], [], 0), 7: ([(1, 2)], [], 3), None: ([(1, 11)], [1], 12),
    }
    cut = {i: [texts[i][a:b] for a, b in got[i].char_spans] for i in (1, 3)}
    assert cut == {1: ["W0 w1, w2 w3 w4 w5 w6 w7 w8 (w9"], 3: ["só BREVE"]}
    clean = decontaminate.clean_documents(docs, bench, block_bytes=block_bytes)
    assert clean.columns == docs.columns and sorted(r.doc_id for r in clean.collect()) == [2, 5, 6]


def test_empty_tables(spark, table):
    docs, bench = table([(1, WORDS, "s")]), items(spark, [(1, WORDS, "x")])
    assert decontaminate.benchmark_hits(docs.limit(0), bench).count() == 0
    assert decontaminate.benchmark_hits(docs, bench.limit(0)).first().word_runs == []
    assert decontaminate.clean_documents(docs, bench.limit(0)).count() == 1


def test_long_text(spark, table):
    text = "x " * 500_000 + WORDS + " y" * 10
    docs, bench = table([(1, text, "s")]), items(spark, [(1, WORDS, "x")])
    assert decontaminate.benchmark_hits(docs, bench).first().word_runs[0].start == 500_000

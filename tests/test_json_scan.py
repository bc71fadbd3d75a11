import json
import random

import pytest

from epistride.sources import json_scan


def plain_leaves(document, depth):
    out = []

    def walk(node, keys, places):
        if isinstance(node, (dict, list)):
            if len(keys) == depth:
                return
            members = list(node.items()) if isinstance(node, dict) else [("", v) for v in node]
            if not members:
                out.append((keys + [""], places + [0], None))
            for i, (key, value) in enumerate(members):
                walk(value, keys + [key], places + [i])
        else:
            out.append((keys, places, node if isinstance(node, str) else json.dumps(node)))

    walk(document, [], [])
    return sorted(map(repr, out))


def made(rng, depth):
    kind = rng.random()
    if depth == 0 or kind < 0.3:
        words = ["a", "x,y", 'quo"te', "back\\slash", "[{", "é\n", "", "s:", "1,2,3", "\\\\,"]
        return rng.choice([rng.randint(-99, 99), rng.random() * 10**rng.randint(-9, 9), True, None, *words])
    if kind < 0.65:
        return [made(rng, depth - 1) for _ in range(rng.randint(0, 5))]
    return {rng.choice(["k", "a,b", "}", "é", '"']) + str(i): made(rng, depth - 1) for i in range(rng.randint(0, 4))}


@pytest.mark.parametrize("split, indent", [("40", None), ("64", 2)])
def test_leaves_are_those_of_the_document(spark, tmp_path, split, indent):
    rng = random.Random(1)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        documents = [[made(rng, 3) for _ in range(8)], {f"m{i}": made(rng, 3) for i in range(8)}, [], {}]
        for number, document in enumerate(documents):
            path = tmp_path / f"d{number}.json"
            path.write_text(json.dumps(document, indent=indent, ensure_ascii=bool(number % 2)) + "\n")
            for depth in (1, 4) if number < 2 else (4,):
                leaves = json_scan.json_leaves(spark, str(path), depth)
                got = sorted(repr((r.keys, r.places, None if r.empty else r.value)) for r in leaves.collect())
                assert got == plain_leaves(document, depth), (number, depth)
            if split == "40" and number < 2:
                # The document is read in many splits.
                assert json_scan._pieces(spark, str(path)).select("block").distinct().count() > 5
        assert json_scan.document_problems(spark, str(tmp_path)).count() == 0
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("text", ['[1, 2', '[1]]', '[1] [2]', '{"a": "b', '[1, 2 3]', '1, 2', '{"a": 1}, {"b": 2}', "[1}x]"])
def test_broken_documents_are_told(spark, tmp_path, text):
    (tmp_path / "broken.json").write_text(text)
    assert json_scan.document_problems(spark, str(tmp_path / "broken.json")).count() == 1

"""Reading JSON documents of any size in many tasks.

Spark's JSON source reads a document that spans lines as one row.  Here a file
is read as text cut at commas, which Spark splits like any text.  What a piece
means depends on what came before it, whether it begins inside a string, at
which depth, and in which member, but only through sums and last values: the
number of quotes, the number of brackets, the last key at each depth.  These
are running computations, done split by split and carried over from split to
split by a summary with one row per split.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from epistride.operators.scans import blocked_scan, latest, running_sum

_STRING = r'"(?:[^"\\]|\\.)*+"'
_NUMBER = r"-?[0-9]+(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?"
_ORDER = ["block", "id"]


def _pieces(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(file, block, id, value): texts between commas, ordered by split and place in it."""
    text = spark.read.option("lineSep", ",").text(path if isinstance(path, str) else list(path))
    return text.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("id"),
        "value",
    )


def _scan(rows: DataFrame, outputs: dict) -> DataFrame:
    return blocked_scan(rows, ["file"], F.col("block"), _ORDER, outputs)


def _elements(pieces: DataFrame) -> DataFrame:
    """(file, block, id, value, whole): texts between the commas that stand outside strings.

    ``whole`` is false where a string is left open.  A comma never follows a
    lone backslash in JSON, so a piece holds its escapes whole.
    """
    quotes = F.length(F.regexp_replace("value", r'(?s)\\.|[^"\\]', "")).cast("long")
    told = _scan(pieces.withColumn("own", quotes), {"quotes": running_sum(F.col("own"))})
    told = told.withColumns({"inside": (F.col("quotes") - F.col("own")) % 2 == 1, "open": F.col("quotes") % 2 == 1})
    single = told.where(~F.col("inside") & ~F.col("open")).select("file", *_ORDER, "value", F.lit(True).alias("whole"))
    # Strings with commas in them are put together again.
    begun = {f"first_{n}": latest(F.when(~F.col("inside"), F.col(n))) for n in _ORDER}
    parts = _scan(told.where("inside or open"), begun).select(
        "file", "first_block", "first_id", F.struct(*_ORDER, "value", "open").alias("part")
    )
    joined = parts.groupBy("file", "first_block", "first_id").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    return single.unionByName(
        joined.select(
            "file",
            F.col("first_block").alias("block"),
            F.col("first_id").alias("id"),
            F.array_join(F.transform("parts", lambda p: p["value"]), ",").alias("value"),
            (~F.element_at("parts", -1)["open"]).alias("whole"),
        )
    )


def _shaped(elements: DataFrame) -> DataFrame:
    """Elements with their strings, what they open (one entry for each level, with its key), close, and their scalar.

    Between two commas a document opens containers, holds one scalar at most,
    and closes containers, in this order.
    """
    shape = F.regexp_replace("value", f"(?s){_STRING}", "s")
    # A space between two scalars tells them apart; elsewhere it means nothing.
    shape = F.regexp_replace(F.regexp_replace(shape, r"(?<=[-+.\w])\s+(?=[-+.\w])", "~"), r"\s+", "")
    rows = elements.withColumns({"shape": shape, "strings": F.regexp_extract_all("value", F.lit(f"(?s)({_STRING})"), 1)})
    head = F.regexp_extract("shape", r"^((?:s:|[\[{])*+)", 1)
    rows = rows.withColumns({"head": head, "rest": F.substr(F.col("shape"), F.length(head) + 1)})
    # One text for each level: "s:" where a key stands, else empty; the first belongs to the level the element begins at.
    rows = rows.withColumns(
        {
            "levels": F.split("head", r"[\[{]"),
            "tail": F.regexp_replace("rest", r"^[^\]}]*", ""),
            "scalar": F.regexp_extract("rest", r"^([^\[\]{}:]*)", 1),
        }
    )
    keys = F.transform(
        "levels",
        lambda level, i: F.when(level == "s:", F.get("strings", F.size(F.filter(F.slice("levels", F.lit(1), i), lambda x: x == "s:")))).otherwise(""),
    )
    value = F.when(F.col("scalar") == "s", F.element_at("strings", -1)).otherwise(F.col("scalar"))
    closed = F.length("tail").cast("long")
    # What is left over is no JSON: a bracket after a scalar's end, a colon without a key, two scalars.
    odd = ~F.col("rest").rlike(rf"^(?:s|{_NUMBER}|true|false|null|NaN|-?Infinity)?[\]}}]*$") | ~F.col("whole")
    return rows.select(
        "file",
        *_ORDER,
        keys.alias("keys"),
        (F.size("levels") - 1).cast("long").alias("opened"),
        closed.alias("closed"),
        value.alias("value"),
        odd.alias("odd"),
    )


def json_leaves(spark: SparkSession, path: str | Sequence[str], depth: int) -> DataFrame:
    """(file, keys, places, value, empty) of every scalar at most ``depth`` containers deep.

    ``keys`` and ``places`` tell the way to it, level by level: the member's
    key, empty in arrays, and its place in the container, from 0.  ``value``
    is the scalar as it is written, a string without its quotes decoded;
    ``is_string`` tells them apart.  A container without members comes as a row with
    ``empty`` set, at the level of its would-be first member.  What lies deeper is left out.
    """
    return _leaves(_shaped(_elements(_pieces(spark, path))), depth)


def _leaves(shaped: DataFrame, depth: int) -> DataFrame:
    rows = _scan(shaped, {"above": running_sum(F.col("opened") - F.col("closed"), exclusive=True)})
    levels = range(1, depth + 1)
    # The level that an element's n-th text belongs to is n more than where it begins.
    at = lambda level: F.lit(level) - F.col("above")
    touched = lambda level: (at(level) >= 0) & (at(level) <= F.col("opened"))
    moved = lambda level: F.when(F.col("above") == level, 1).otherwise(0).cast("long")
    outputs = {f"count_{n}": running_sum(moved(n)) for n in levels}
    outputs |= {f"key_{n}": latest(F.when(touched(n), F.get("keys", at(n).cast("int")))) for n in levels}
    rows = _scan(rows, outputs)
    begun = {f"base_{n}": latest(F.when((at(n) > 0) & (at(n) <= F.col("opened")), F.col(f"count_{n}"))) for n in levels}
    rows = _scan(rows, begun)
    reached = F.col("above") + F.col("opened")
    empty = (F.col("value") == "") & (F.col("opened") > 0)
    rows = rows.where((reached >= 1) & (reached <= depth) & ((F.col("value") != "") | empty))
    text = F.col("value").startswith('"')
    decoded = F.when(text, F.get(F.from_json(F.concat(F.lit("["), "value", F.lit("]")), "array<string>"), F.lit(0))).otherwise(F.col("value"))
    key = lambda n: F.get(F.from_json(F.concat(F.lit("["), F.nullif(F.col(f"key_{n}"), F.lit("")), F.lit("]")), "array<string>"), F.lit(0))
    listed = lambda columns: F.slice(F.array(*columns), F.lit(1), reached.cast("int"))
    return rows.select(
        "file",
        listed([F.coalesce(key(n), F.lit("")) for n in levels]).alias("keys"),
        listed([F.col(f"count_{n}") - F.col(f"base_{n}") for n in levels]).alias("places"),
        decoded.alias("value"),
        text.alias("is_string"),
        empty.alias("empty"),
    )


def document_problems(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(file, problem) of files that are not one complete object or array."""
    shaped = _shaped(_elements(_pieces(spark, path)))
    rows = _scan(shaped, {"above": running_sum(F.col("opened") - F.col("closed"), exclusive=True)})
    after = F.col("above") + F.col("opened") - F.col("closed")
    order = F.struct(*_ORDER)
    told = rows.groupBy("file").agg(
        F.sum(F.col("opened") - F.col("closed")).alias("balance"),
        F.count_if("odd").alias("odd"),
        F.count_if((after < 0) | ((after == 0) & (F.col("opened") + F.col("above") == 0))).alias("outside"),
        F.count_if(after == 0).alias("ends"),
        F.max_by(after, order).alias("last"),
    )
    problem = (
        F.when(F.col("odd") > 0, "not JSON")
        .when((F.col("balance") != 0) | (F.col("last") != 0), "incomplete")
        .when((F.col("outside") > 0) | (F.col("ends") != 1), "not one document")
    )
    return told.select("file", problem.alias("problem")).where("problem is not null")

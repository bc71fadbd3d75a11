"""Schema generations of a dataset and the steps between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from epistride.functions.scalars import clean_text

# Schema generations, oldest first.
GENERATIONS = ("v1.6", "v2.0", "v2.1", "v3.0")

# Fixed values: (major, minor) -> generation.  Generation 1 is also written
# as 1.0; a third number never matters.
GENERATION_OF = {"1.0": "v1.6", "1.6": "v1.6", "2.0": "v2.0", "2.1": "v2.1", "3.0": "v3.0"}

NEWEST = GENERATIONS[-1]


def normalise_version(value: Column) -> Column:
    """Generation named by a version text; null when it names none."""
    text = F.lower(clean_text(value))
    # One optional letter in front, then one to three numbers between dots.
    numbers = F.split(F.when(text.startswith("v"), F.substr(text, F.lit(2))).otherwise(text), r"\.")
    usable = (F.size(numbers) <= 3) & F.forall(numbers, lambda n: n.rlike("^[0-9]+$"))
    plain = F.transform(numbers, lambda n: n.try_cast("int").cast("string"))
    named = F.concat_ws(".", F.get(plain, F.lit(0)), F.coalesce(F.get(plain, F.lit(1)), F.lit("0")))
    table = F.create_map(*[F.lit(part) for pair in GENERATION_OF.items() for part in pair])
    return F.when(usable, F.try_element_at(table, named))


def migration_steps(spark: SparkSession) -> DataFrame:
    """(version, step, from_version, to_version) for every older generation."""
    rows = [
        (start, position - i, GENERATIONS[position], GENERATIONS[position + 1])
        for i, start in enumerate(GENERATIONS)
        for position in range(i, len(GENERATIONS) - 1)
    ]
    return spark.createDataFrame(rows, "version string, step int, from_version string, to_version string")


def migration_chain(version: Column) -> Column:
    """Array of (from, to) steps that bring ``version`` to the newest one."""
    steps = F.array(
        *[
            F.struct(F.lit(a).alias("from_version"), F.lit(b).alias("to_version"))
            for a, b in zip(GENERATIONS, GENERATIONS[1:])
        ]
    )
    return F.when(version.isin(*GENERATIONS), F.filter(steps, lambda s: s["from_version"] >= version))

"""How close vectors are to an isotropic Gaussian.

Vectors are projected on random unit directions; per direction the empirical
characteristic function is compared with that of a standard normal at a few
knots.  Each task sums cosines and sines of its rows with one matrix product
per batch, so only directions x knots rows per task are shuffled.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epistride.columns import named

# Fixed value: the last point at which characteristic functions are compared.
LAST_KNOT = 3.0

# A task holds so many angles at a time.
ANGLES = 1_000_000


def knot_table(knots: int = 17) -> list[tuple[int, float, float, float]]:
    """(knot, point, target, weight): trapezoid weights times the target."""
    step = LAST_KNOT / (knots - 1)
    table = []
    for k in range(knots):
        point = k * step
        target = math.exp(-point * point / 2)
        edge = k in (0, knots - 1)
        table.append((k, point, target, (step if edge else 2 * step) * target))
    return table


def unit_projections(dimension: int, directions: int, seed: int) -> np.ndarray:
    """Seeded random unit vectors as columns; the size is set by parameters."""
    uniform = np.array(
        [
            [
                [
                    (int(hashlib.md5(f"{seed}:{part}:{d}:{p}".encode()).hexdigest()[:8], 16) + 0.5) / 2**32
                    for part in (0, 1)
                ]
                for p in range(directions)
            ]
            for d in range(dimension)
        ]
    )
    normal = np.sqrt(-2 * np.log(uniform[..., 0])) * np.cos(2 * np.pi * uniform[..., 1])
    return normal / np.linalg.norm(normal, axis=0)


def characteristic_sums(
    df: DataFrame, vector: str, projections: np.ndarray, knots: int = 17, by: Sequence[str] = ()
) -> DataFrame:
    """(by.., direction, knot, cos_sum, sin_sum, n) over all rows."""
    points = np.array([row[1] for row in knot_table(knots)])
    by = list(by)
    size = projections.shape[1]
    schema = "".join(f"`{b}` {df.schema[b].dataType.simpleString()}, " for b in by)
    schema += "direction int, knot int, cos_sum double, sin_sum double, n long"

    def sums(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in parts:
            groups = batch.groupby(by, sort=False) if by else [((), batch)]
            for key, rows in groups:
                matrix = np.stack(rows["__vector"].to_numpy()).astype(np.float64)
                if matrix.shape[1] != projections.shape[0]:
                    raise ValueError("vector and projection dimensions differ")
                cosines, sines = np.zeros((size, len(points))), np.zeros((size, len(points)))
                rows_at_once = max(1, ANGLES // size)
                for first in range(0, len(matrix), rows_at_once):
                    projected = matrix[first : first + rows_at_once] @ projections
                    for k, point in enumerate(points):
                        angles = projected * point
                        cosines[:, k] += np.cos(angles).sum(axis=0)
                        sines[:, k] += np.sin(angles).sum(axis=0)
                out = pd.DataFrame(
                    {
                        "direction": np.repeat(np.arange(size), len(points)),
                        "knot": np.tile(np.arange(len(points)), size),
                        "cos_sum": cosines.ravel(),
                        "sin_sum": sines.ravel(),
                        "n": len(rows),
                    }
                )
                for name, value in zip(by, key if isinstance(key, tuple) else (key,)):
                    out.insert(0, name, value)
                yield out[[*by, "direction", "knot", "cos_sum", "sin_sum", "n"]]

    partial = df.select(*[named(b) for b in by], named(vector).alias("__vector")).mapInPandas(sums, schema)
    keys = [*[named(b) for b in by], F.col("direction"), F.col("knot")]
    return partial.groupBy(*keys).agg(
        F.sum("cos_sum").alias("cos_sum"), F.sum("sin_sum").alias("sin_sum"), F.sum("n").alias("n")
    )


def direction_statistics(
    df: DataFrame, vector: str, projections: np.ndarray, knots: int = 17, by: Sequence[str] = ()
) -> DataFrame:
    """Distance from normality per direction."""
    sums = characteristic_sums(df, vector, projections, knots, by)
    table = knot_table(knots)
    lookup = lambda column: F.element_at(F.array(*[F.lit(row[column]) for row in table]), F.col("knot") + 1)
    error = F.pow(F.col("cos_sum") / F.col("n") - lookup(2), F.lit(2.0)) + F.pow(F.col("sin_sum") / F.col("n"), F.lit(2.0))
    return (
        sums.groupBy(*[named(b) for b in by], "direction")
        .agg((F.sum(error * lookup(3)) * F.max("n")).alias("statistic"))
    )


def isotropy(df: DataFrame, vector: str, projections: np.ndarray, knots: int = 17, by: Sequence[str] = ()) -> DataFrame:
    """One row: the mean statistic over directions (and groups)."""
    return direction_statistics(df, vector, projections, knots, by).agg(F.avg("statistic").alias("isotropy"))

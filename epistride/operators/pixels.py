"""Audit of raw pixel cells before they reach an image processor."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from epistride.columns import named
from epistride.functions.scalars import all_finite

# Legal channel counts and the slack of float pixels.
CHANNELS = (1, 3, 4)
SLACK = 1e-6


def audit_pixels(images: DataFrame, pixels: str, shape: str) -> DataFrame:
    """Add ``layout``, ``value_range`` and ``problem`` to every image row.

    ``pixels`` is the flat array of values, ``shape`` its dimensions.
    """
    floating = isinstance(images.schema[pixels].dataType.elementType, T.FractionalType)
    dims, cells = named(shape), named(pixels)
    first = F.get(dims, 0).isin(*CHANNELS)
    last = F.get(dims, F.size(dims) - 1).isin(*CHANNELS)
    low, high = F.array_min(cells), F.array_max(cells)
    slack = SLACK if floating else 0
    unit = (high <= 1.0 + slack) if floating else F.lit(False)
    finite = all_finite(cells) if floating else F.lit(True)
    problem = (
        F.when(F.size(dims) != 3, "not three dimensions")
        .when(F.aggregate(dims, F.lit(1).cast("long"), lambda a, b: a * b) != F.size(cells), "shape does not fit")
        .when(first == last, "ambiguous layout")
        .when(~finite, "not finite")
        .when(low < -slack, "negative")
        .when(high > 255 + slack, "above 255")
    )
    return images.withColumn("problem", problem).withColumns(
        {
            "layout": F.when(F.col("problem").isNull(), F.when(first, "channels first").otherwise("channels last")),
            "value_range": F.when(F.col("problem").isNull(), F.when(unit, "0..1").otherwise("0..255")),
        }
    )


def mixed_batches(audited: DataFrame, batch: Sequence[str]) -> DataFrame:
    """Batches that hold images of both value ranges."""
    return (
        audited.groupBy(*[named(b) for b in batch])
        .agg(
            F.count_if(F.col("value_range") == "0..1").alias("unit_images"),
            F.count_if(F.col("value_range") == "0..255").alias("byte_images"),
        )
        .where((F.col("unit_images") > 0) & (F.col("byte_images") > 0))
    )

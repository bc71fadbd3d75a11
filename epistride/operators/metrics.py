"""Regression metrics from mergeable states, so every one is pre-aggregated map-side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epistride.columns import named
from epistride.functions.scalars import is_finite, squared_distance
from epistride.operators.scans import spread_join


#: State of the regression metrics of a part: its errors, means and centred second moments.
STATE = ["count", "squared", "absolute", "mean_p", "mean_t", "m2_p", "m2_t", "c_pt"]


def metric_state(
    df: DataFrame, prediction: Column, target: Column, by: Sequence[str] = (), mask: Column | None = None
) -> DataFrame:
    """The state of every group, mergeable with that of other parts.

    Variances and covariance are kept as central moments, which Spark merges
    pairwise from task to task, so values far from zero lose no digits.
    """
    rows = df.select(
        *[named(b) for b in by], prediction.cast("double").alias("p"), target.cast("double").alias("t"),
        (mask if mask is not None else F.lit(True)).alias("keep"),
    ).where("keep")
    p, t, n = F.col("p"), F.col("t"), F.count(F.lit(1))
    return rows.groupBy(*[named(b) for b in by]).agg(
        n.alias("count"),
        F.sum((p - t) * (p - t)).alias("squared"),
        F.sum(F.abs(p - t)).alias("absolute"),
        F.avg(p).alias("mean_p"),
        F.avg(t).alias("mean_t"),
        (F.var_pop(p) * n).alias("m2_p"),
        (F.var_pop(t) * n).alias("m2_t"),
        (F.covar_pop(p, t) * n).alias("c_pt"),
    )


def merge_states(parts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One state per group from states of parts, for instance those of several evaluation jobs.

    The parts' moments are moved to the merged means and added up.
    """
    keys = [named(b) for b in by]
    filled = parts.where(F.col("count") > 0)
    n = F.col("count").cast("double")
    mean = lambda name: F.sum(n * F.col(name)) / F.sum(n)
    centre = filled.groupBy(*keys, F.lit(0).alias("__one")).agg(mean("mean_p").alias("__p"), mean("mean_t").alias("__t"))
    placed = spread_join(filled.withColumn("__one", F.lit(0)), centre, [*by, "__one"], [*by, *STATE])
    p, t = F.col("mean_p") - F.col("__p"), F.col("mean_t") - F.col("__t")
    return placed.groupBy(*keys).agg(
        F.coalesce(F.sum("count"), F.lit(0)).alias("count"),
        F.sum("squared").alias("squared"),
        F.sum("absolute").alias("absolute"),
        F.max("__p").alias("mean_p"),
        F.max("__t").alias("mean_t"),
        F.sum(F.col("m2_p") + n * p * p).alias("m2_p"),
        F.sum(F.col("m2_t") + n * t * t).alias("m2_t"),
        F.sum(F.col("c_pt") + n * p * t).alias("c_pt"),
    )


def metrics_of(states: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """count, mse, rmse, mae and Pearson from states, merged or not.

    Pearson is null when either side does not vary.  Zero rows give count 0
    and nulls.
    """
    n, some = F.col("count").cast("double"), F.col("count") > 0
    mse = F.when(some, F.col("squared") / n)
    vary = (F.col("m2_p") > 0) & (F.col("m2_t") > 0)
    return states.select(
        *[named(b) for b in by],
        F.col("count"),
        mse.alias("mse"),
        F.sqrt(mse).alias("rmse"),
        F.when(some, F.col("absolute") / n).alias("mae"),
        F.when(vary, F.col("c_pt") / (F.sqrt("m2_p") * F.sqrt("m2_t"))).alias("pearson"),
    )


def regression_metrics(
    df: DataFrame, prediction: Column, target: Column, by: Sequence[str] = (), mask: Column | None = None
) -> DataFrame:
    """count, mse, rmse, mae and Pearson of the rows that ``mask`` keeps."""
    return metrics_of(metric_state(df, prediction, target, by, mask), by)


def curve_metrics(points: DataFrame, prediction: str = "value", target: str = "return", by: Sequence[str] = ("episode_id",)) -> DataFrame:
    """Per-episode metrics with the centred Pearson; null below two points.

    Variance and covariance are merged as central moments, which stays exact
    for curves far from zero.
    """
    p, t = named(prediction).cast("double"), named(target).cast("double")
    grouped = points.groupBy(*[named(b) for b in by]).agg(
        F.count(F.lit(1)).alias("count"),
        F.avg((p - t) * (p - t)).alias("value_mse"),
        F.avg(F.abs(p - t)).alias("value_mae"),
        F.covar_pop(p, t).alias("__cov"),
        (F.var_pop(p) * F.var_pop(t)).alias("__var"),
    )
    pearson = F.when(
        (F.col("count") >= 2) & (F.col("__var") > 0),
        F.col("__cov") / F.sqrt(F.when(F.col("__var") > 0, F.col("__var"))),
    )
    return grouped.select(
        *[named(b) for b in by],
        "count",
        "value_mse",
        F.sqrt("value_mse").alias("value_rmse"),
        "value_mae",
        pearson.alias("value_pearson"),
    )


def masked_squared_error(df: DataFrame, prediction: Column, target: Column, mask: Column, by: Sequence[str] = ()) -> DataFrame:
    """(squared_sum, counted) over masked rows with both values finite."""
    usable = F.coalesce(mask, F.lit(False)) & is_finite(prediction) & is_finite(target)
    error = (prediction - target).cast("double")
    return df.groupBy(*[named(b) for b in by]).agg(
        F.coalesce(F.sum(F.when(usable, error * error)), F.lit(0.0)).alias("squared_sum"),
        F.count_if(usable).alias("counted"),
    )


def weighted_loss(terms: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Global mean of every term and their weighted total.

    ``terms`` holds ``<name>_sum`` and ``<name>_count`` columns, one row per
    part; a term without rows counts as zero.
    """
    totals = terms.agg(
        *[F.sum(f"{n}_sum").alias(f"{n}_sum") for n in weights],
        *[F.sum(f"{n}_count").alias(f"{n}_count") for n in weights],
    )
    mean = lambda n: F.coalesce(
        F.col(f"{n}_sum") / F.greatest(F.col(f"{n}_count"), F.lit(1)), F.lit(0.0)
    )
    means = totals.select(*[mean(n).alias(f"{n}_loss") for n in weights])
    total = sum((F.lit(float(w)) * F.col(f"{n}_loss") for n, w in weights.items()), F.lit(0.0))
    return means.withColumn("loss", total)


def vector_mse(df: DataFrame, prediction: str, target: str, by: Sequence[str] = ()) -> DataFrame:
    """Element-wise mean squared error of two vector columns."""
    per_row = df.select(
        *[named(b) for b in by],
        squared_distance(named(prediction), named(target)).alias("squared"),
        F.size(named(prediction)).alias("elements"),
    )
    return per_row.groupBy(*[named(b) for b in by]).agg(
        F.sum("elements").alias("elements"),
        F.when(F.sum("elements") > 0, F.sum("squared") / F.sum("elements")).alias("mse"),
    )


def best_so_far(log: DataFrame, metric: str = "value_mse", epoch: str = "epoch", run: Sequence[str] = ("run",)) -> DataFrame:
    """Mark the epochs that beat all earlier ones of their run.

    One row per epoch and run, so a run's window is small.
    """
    before = Window.partitionBy(*[named(r) for r in run]).orderBy(named(epoch)).rowsBetween(
        Window.unboundedPreceding, -1
    )
    best = F.min(F.when(is_finite(named(metric)), named(metric))).over(before)
    return log.withColumn("best_before", best).withColumn(
        "is_best",
        is_finite(named(metric)) & (F.col("best_before").isNull() | (named(metric) < F.col("best_before"))),
    )

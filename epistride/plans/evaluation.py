"""From frames and a scorer to curves, metrics and alignment."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epistride.columns import COLUMNS, Columns, named
from epistride.functions.scalars import all_finite, is_finite
from epistride.operators import align, curves, integrity, metrics, scoring, windows
from epistride.operators.splits import select_split
from epistride.session import stored
from epistride.sources import writers


@dataclass(frozen=True)
class Evaluation:
    points: DataFrame
    metrics: DataFrame
    curve_metrics: DataFrame
    report: DataFrame


def evaluate(
    frames: DataFrame,
    scorer: scoring.Scorer,
    schema: str,
    history: int,
    fields: tuple[str, ...],
    fps: float,
    folder: str | None = None,
    split: DataFrame | None = None,
    split_name: str = "all",
    max_curve_episodes: int | None = None,
    upcoming: tuple[str, ...] = (),
    strict: bool = True,
    c: Columns = COLUMNS,
) -> Evaluation:
    """Score all windows of a split once and derive every artifact from that.

    ``schema`` must give episode_id, sample_id, frame_indices and value, and
    may give next_state and next_state_target, one vector per position.  The
    scores are stored, since the model is the expensive part.  With ``strict``
    a gap in a curve, or a curve that does not begin and end where it should,
    is an error like a missing source.
    """
    chosen = frames if split is None else select_split(frames, split, split_name, c)
    integrity.require_none(integrity.uneven_episodes(chosen, c), "episodes are not consecutive", [c.episode])
    # The targets travel with their windows, unseen by the scorer.
    current = list(dict.fromkeys([*fields, c.ret]))
    wanted = list(dict.fromkeys([*current, *upcoming]))
    made = windows.split_window(windows.history_windows(chosen, history, wanted, c), history, current, list(upcoming))
    scored = stored(scoring.score_windows(made, scorer, schema, list(fields), carried=[c.ret]), "scores")
    total = windows.total_windows(chosen, history, c)
    complete = scoring.completeness(scored, total)
    integrity.require_none(complete.where(~F.col("complete") | (F.col("windows") < 1)), "windows were not all scored", ["records"])

    key = ["episode_id", "frame_index"]
    tokens = scoring.scored_positions(scored, carried=[c.ret])
    tokens = tokens.select(*[n for n in tokens.columns if n != c.ret], named(c.ret).cast("double").alias("return"))
    unusable = tokens.where(~(is_finite(F.col("value")) & is_finite(F.col("return"))))
    integrity.require_none(unusable.select(*key), "values that are not finite", key)
    points = stored(tokens.where(F.col("position") == history - 1).select(*key, "value", "return"), "points")
    integrity.require_none(curves.point_problems(points), "curve points", [*key, "problem"])

    endpoint = metrics.regression_metrics(points, F.col("value"), F.col("return"))
    token = metrics.regression_metrics(tokens, F.col("value"), F.col("return"))
    rename = lambda df, prefix: df.select(*[F.col(n).alias(prefix + n) for n in df.columns])
    summary = rename(endpoint, "value_")
    for name in token.columns:
        summary = summary.withColumn(f"token_value_{name}", token.select(name).scalar())

    if {"next_state", "next_state_target"} <= set(scored.columns):
        states = scored.select(F.posexplode(F.arrays_zip("next_state", "next_state_target")).alias("position", "cell"))
        states = states.select("position", "cell.*")
        broken = states.where(~(all_finite(F.col("next_state")) & all_finite(F.col("next_state_target"))))
        integrity.require_none(broken.select("position"), "next states that are not finite")
        error = lambda df: metrics.vector_mse(df, "next_state", "next_state_target").select("mse").scalar()
        summary = summary.withColumns(
            {"next_state_mse": error(states.where(F.col("position") == history - 1)), "token_next_state_mse": error(states)}
        )

    checked = align.preflight(points, align.sources_from_frames(chosen, fps, history, c=c))
    integrity.require_none(align.rejected(checked, strict), "curves cannot be aligned", ["episode_id", "problem"])
    report = align.alignment_report(checked)
    result = Evaluation(points, summary, metrics.curve_metrics(points), report)
    if folder is not None:
        shown = curves.limit_curves(points, max_curve_episodes) if max_curve_episodes else points
        writers.write_curves(shown, folder)
        writers.write_document(curves.curve_summary(points, max_curve_episodes), f"{folder}/episode_curves_summary.json")
        writers.write_document(writers.evaluation_summary(summary, total, split_name), f"{folder}/summary.json")
        writers.write_alignment(report, f"{folder}/alignment")
    return result

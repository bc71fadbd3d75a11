"""Scoring, metrics, curves and alignment."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epistride.functions.scalars import episode_path, is_finite
from epistride.operators import align, curves, metrics, scoring, windows
from epistride.operators.isotropy import direction_statistics, isotropy, unit_projections
from epistride.operators.pixels import audit_pixels, mixed_batches
from epistride.operators.returns import with_returns
from epistride.workload.registry import query
from epistride.workload.tables import (
    EVENT_EPISODES,
    EVENT_RETURNS,
    event_frames,
    event_labels,
    event_table,
    r6,
    table,
)

HISTORY = 3

# Several blocks for each of the tables' episodes.
BLOCK = 16


def _targets(spark: SparkSession, folder: str) -> DataFrame:
    frames = event_table(spark, folder)
    return with_returns(frames, event_labels(frames))


# The model stand-in: a closed form of the history seen so far.


def closed_form_scorer(batch: pd.DataFrame) -> pd.DataFrame:
    """Value: minus the mean of the history's roots, scaled.  Next state: last root."""
    seen = np.sqrt(np.stack(batch["observed"].to_numpy()))
    running = seen.cumsum(axis=1) / np.arange(1, seen.shape[1] + 1)
    return pd.DataFrame(
        {
            "episode_id": batch["episode_id"],
            "sample_id": batch["sample_id"],
            "frame_indices": batch["frame_indices"],
            "value": list(-running / 25.0),
            "next_state": list(np.stack([seen, running], axis=2).reshape(len(batch), -1)),
        }
    )


SCORED = (
    "episode_id long, sample_id string, frame_indices array<long>, value array<double>, next_state array<double>"
)


def _scored(spark: SparkSession, folder: str) -> DataFrame:
    made = windows.history_windows(event_frames(spark, folder), HISTORY, ["observed"])
    parts = windows.split_window(made, HISTORY, ["observed"])
    return scoring.score_windows(parts, closed_form_scorer, SCORED, ["observed"])


# One row per window and position: seen1..3 are the roots of the history.
SCORED_SQL = f"""
{EVENT_RETURNS},
starts AS (
  SELECT episode_index AS episode_id, frame_index AS start_frame, sqrt(observed) AS s1, ret AS r1,
         sqrt(lead(observed, 1) OVER w) AS s2, lead(ret, 1) OVER w AS r2,
         sqrt(lead(observed, 2) OVER w) AS s3, lead(ret, 2) OVER w AS r3,
         sqrt(lead(observed, 3) OVER w) AS s4
  FROM returns WINDOW w AS (PARTITION BY episode_index ORDER BY frame_index)),
positions AS (
  SELECT episode_id, concat(episode_id, ':', start_frame) AS sample_id, 0 AS position, start_frame AS frame_index,
         -s1 / 25 AS value, r1 AS target, s1 AS last_root, s1 AS mean_root, s2 AS next_root FROM starts WHERE s4 IS NOT NULL
  UNION ALL
  SELECT episode_id, concat(episode_id, ':', start_frame), 1, start_frame + 1, -(s1 + s2) / 2 / 25, r2, s2, (s1 + s2) / 2, s3
  FROM starts WHERE s4 IS NOT NULL
  UNION ALL
  SELECT episode_id, concat(episode_id, ':', start_frame), 2, start_frame + 2, -(s1 + s2 + s3) / 3 / 25, r3, s3, (s1 + s2 + s3) / 3, s4
  FROM starts WHERE s4 IS NOT NULL)"""


@query("U1 U2 E3", f"""
WITH {SCORED_SQL}
SELECT episode_id, sample_id, position, frame_index, {r6('value')} AS value FROM positions""")
def scored_windows(spark: SparkSession, folder: str) -> DataFrame:
    rows = scoring.scored_positions(_scored(spark, folder))
    return rows.withColumn("value", F.round("value", 6))


def _metric_columns(names: str, prediction: str, target: str) -> str:
    return f"""
count(*) AS count, {r6(f'avg(({prediction} - {target}) ** 2)')} AS {names}mse,
{r6(f'sqrt(avg(({prediction} - {target}) ** 2))')} AS {names}rmse,
{r6(f'avg(abs({prediction} - {target}))')} AS {names}mae,
{r6(f'CASE WHEN var_pop({prediction}) > 0 AND var_pop({target}) > 0 THEN covar_pop({prediction}, {target}) / sqrt(var_pop({prediction}) * var_pop({target})) END')} AS {names}pearson"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(
        *[F.round(f.name, 6).alias(f.name) if f.dataType.simpleString() == "double" else F.col(f.name) for f in df.schema.fields]
    )


def _scored_with_targets(spark: SparkSession, folder: str) -> DataFrame:
    """Scores with the targets of their frames, which travel in the windows."""
    made = windows.history_windows(_targets(spark, folder), HISTORY, ["observed", "return"])
    parts = windows.split_window(made, HISTORY, ["observed", "return"])
    return scoring.score_windows(parts, closed_form_scorer, SCORED, ["observed"], carried=["return"])


@query("D6 U3 E4 C9", f"""
WITH {SCORED_SQL}
SELECT {_metric_columns('', 'value', 'target')} FROM positions WHERE position = {HISTORY} - 1""")
def endpoint_metrics(spark: SparkSession, folder: str) -> DataFrame:
    last = F.size("frame_indices") - 1
    points = _scored_with_targets(spark, folder).select(F.get("value", last).alias("value"), F.get("return", last).alias("return"))
    return _rounded(metrics.regression_metrics(points, F.col("value"), F.col("return")))


@query("D6 U3 C9", f"WITH {SCORED_SQL} SELECT {_metric_columns('', 'value', 'target')} FROM positions")
def token_metrics(spark: SparkSession, folder: str) -> DataFrame:
    points = scoring.scored_positions(_scored_with_targets(spark, folder), carried=["return"])
    return _rounded(metrics.regression_metrics(points, F.col("value"), F.col("return")))


def _target_keys(spark: SparkSession, folder: str) -> DataFrame:
    return _targets(spark, folder).select(F.col("episode_index").alias("episode_id"), "frame_index", "return")


def _endpoints(spark: SparkSession, folder: str) -> DataFrame:
    """Scored value at the last history position of every window."""
    last = F.size("frame_indices") - 1
    return _scored(spark, folder).select(
        "episode_id", F.get("frame_indices", last).alias("frame_index"), F.get("value", last).alias("value")
    )


def _curve_points(spark: SparkSession, folder: str) -> DataFrame:
    return _endpoints(spark, folder).join(_target_keys(spark, folder), ["episode_id", "frame_index"])


@query("C9 E4", f"""
WITH {SCORED_SQL}
SELECT episode_id, frame_index, {r6('value')} AS value, round(CAST(CAST(target AS FLOAT) AS DOUBLE), 5) + 0.0 AS "return"
FROM positions WHERE position = {HISTORY} - 1""")
def curve_records(spark: SparkSession, folder: str) -> DataFrame:
    return _curve_points(spark, folder).select(
        "episode_id", "frame_index", F.round("value", 6).alias("value"), F.round(F.col("return").cast("double"), 5).alias("return")
    )


@query("D26", f"""
WITH {SCORED_SQL}
SELECT count(*) AS records, (SELECT count(*) FROM starts WHERE s4 IS NOT NULL) AS windows, true AS complete
FROM positions WHERE position = {HISTORY} - 1""")
def scoring_completeness(spark: SparkSession, folder: str) -> DataFrame:
    frames = event_frames(spark, folder)
    return scoring.completeness(_endpoints(spark, folder), windows.total_windows(frames, HISTORY))


@query("D12", f"""
WITH {SCORED_SQL}
SELECT position, CAST(count(*) * 2 AS BIGINT) AS elements,
       {r6('sum((last_root - next_root) ** 2 + (mean_root - next_root) ** 2) / (count(*) * 2)')} AS mse
FROM positions GROUP BY 1""")
def next_state_mse(spark: SparkSession, folder: str) -> DataFrame:
    """Element-wise error of the predicted next state per history position."""
    made = windows.history_windows(event_frames(spark, folder), HISTORY, ["observed"])
    parts = windows.split_window(made, HISTORY, ["observed"], ["observed"])
    schema = "position array<int>, predicted array<array<double>>, actual array<array<double>>"

    def score(batch: pd.DataFrame) -> pd.DataFrame:
        scored = closed_form_scorer(batch)
        predicted = [list(np.reshape(v, (-1, 2))) for v in scored["next_state"]]
        actual = [[np.repeat(np.sqrt(x), 2) for x in row] for row in batch["next_observed"]]
        return pd.DataFrame({"position": [list(range(len(p))) for p in predicted], "predicted": predicted, "actual": actual})

    rows = scoring.score_windows(parts, score, schema).select(F.inline(F.arrays_zip("position", "predicted", "actual")))
    return _rounded(metrics.vector_mse(rows, "predicted", "actual", by=["position"]))


@query("D8", """
SELECT user_id % 5 AS task_index,
       round(sum(CASE WHEN event_type <> 'error' AND value < 400 THEN (ln(value + 1) - sqrt(event_id + 1)) ** 2 ELSE 0 END), 2) + 0.0 AS squared_sum,
       count(*) FILTER (event_type <> 'error' AND value < 400) AS counted FROM events GROUP BY 1""")
def masked_squared_error(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events").select(
        (F.col("user_id") % 5).alias("task_index"),
        F.when(F.col("value") < 400, F.ln(F.col("value") + 1)).otherwise(F.lit(float("nan"))).alias("prediction"),
        F.sqrt(F.col("event_id") + 1).alias("target"),
        (F.col("event_type") != "error").alias("mask"),
    )
    done = metrics.masked_squared_error(rows, F.col("prediction"), F.col("target"), F.col("mask"), by=["task_index"])
    return done.withColumn("squared_sum", F.round("squared_sum", 2))


@query("D11", """
WITH s AS (
  SELECT sum((ln(value + 1) - 3) ** 2) AS a, count(*) AS an,
         sum(CASE WHEN event_type = 'view' THEN (sqrt(value) - 9) ** 2 END) AS b, count(*) FILTER (event_type = 'view') AS bn FROM events)
SELECT round(a / an, 6) AS value_loss, round(b / bn, 6) AS next_state_loss, 0.0::DOUBLE AS next_state_vector_loss,
       round(1.0 * (a / an) + 0.5 * (b / bn), 6) AS loss FROM s""")
def weighted_loss(spark: SparkSession, folder: str) -> DataFrame:
    """Sums per user, then the global mean of each term and their total."""
    view = F.col("event_type") == "view"
    nothing = F.lit(0).cast("long")
    parts = table(spark, folder, "events").groupBy("user_id").agg(
        F.sum(F.pow(F.ln(F.col("value") + 1) - 3, F.lit(2.0))).alias("value_sum"),
        F.count(F.lit(1)).alias("value_count"),
        F.sum(F.when(view, F.pow(F.sqrt("value") - 9, F.lit(2.0)))).alias("next_state_sum"),
        F.count_if(view).alias("next_state_count"),
        F.sum(nothing.cast("double")).alias("next_state_vector_sum"),
        F.max(nothing).alias("next_state_vector_count"),
    )
    return _rounded(metrics.weighted_loss(parts, {"value": 1.0, "next_state": 0.5, "next_state_vector": 0.1}))


def _merged_by_type(spark: SparkSession, folder: str, offset: float) -> DataFrame:
    """Metrics per event type, from the states of seven parts each."""
    rows = table(spark, folder, "events").select(
        "event_type", (F.col("event_id") % 7).alias("part"),
        (F.sqrt("value") + offset).alias("p"), (F.ln(F.col("event_id") + 2) + offset).alias("t"),
    )
    parts = metrics.metric_state(rows, F.col("p"), F.col("t"), ["event_type", "part"])
    return _rounded(metrics.metrics_of(metrics.merge_states(parts, ["event_type"]), ["event_type"]))


@query("D6 U3", f"""
SELECT event_type, {_metric_columns('', 'sqrt(value)', 'ln(event_id + 2)')} FROM events GROUP BY 1""")
def merged_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Metrics of parts merged by their central moments."""
    return _merged_by_type(spark, folder, 0.0)


FAR = 1e8


@query("D6 U3", f"""
WITH far AS (SELECT event_type, sqrt(value) + {FAR} AS p, ln(event_id + 2) + {FAR} AS t FROM events)
SELECT event_type, {_metric_columns('', 'p', 't')} FROM far GROUP BY 1""")
def merged_metrics_far_from_zero(spark: SparkSession, folder: str) -> DataFrame:
    """The same far from zero, where raw moments would lose the correlation."""
    return _merged_by_type(spark, folder, FAR)


@query("E14 K11", """
WITH log AS (
  SELECT user_id % 3 AS run, day(ts) AS epoch, avg((sqrt(value) - 8) ** 2) AS value_mse FROM events GROUP BY 1, 2),
best AS (SELECT *, min(value_mse) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best_before FROM log)
SELECT run, CAST(epoch AS INTEGER) AS epoch, round(value_mse, 6) AS value_mse, round(best_before, 6) AS best_before,
       best_before IS NULL OR value_mse < best_before AS is_best FROM best""")
def best_epochs(spark: SparkSession, folder: str) -> DataFrame:
    log = table(spark, folder, "events").groupBy(
        (F.col("user_id") % 3).alias("run"), F.dayofmonth("ts").alias("epoch")
    ).agg(F.avg(F.pow(F.sqrt("value") - 8, F.lit(2.0))).alias("value_mse"))
    return _rounded(metrics.best_so_far(log))


# Curves ------------------------------------------------------------------
# A curve with gaps: one value per non-error event after the third frame.

POINTS_SQL = f"""
{EVENT_EPISODES},
points AS (
  SELECT episode_index AS episode_id, frame_index, -sqrt(observed) / 25 AS value, -CAST(frame_index AS DOUBLE) / 100 AS target
  FROM frames JOIN episodes USING (episode_index)
  WHERE event_type <> 'error' AND frame_index >= 2 AND frame_index < last_frame)"""


def _gappy_points(spark: SparkSession, folder: str) -> DataFrame:
    return _points_of(event_table(spark, folder, "event_type"))


def _points_of(frames: DataFrame) -> DataFrame:
    inner = windows.endpoint_frames(frames, HISTORY).where(F.col("event_type") != "error")
    return inner.select(
        F.col("episode_index").alias("episode_id"),
        "frame_index",
        (-F.sqrt("observed") / 25).alias("value"),
        (-F.col("frame_index").cast("double") / 100).alias("return"),
    )


@query("D7", f"""
WITH {POINTS_SQL}
SELECT episode_id, count(*) AS count, {r6('avg((value - target) ** 2)')} AS value_mse,
       {r6('sqrt(avg((value - target) ** 2))')} AS value_rmse, {r6('avg(abs(value - target))')} AS value_mae,
       {r6('CASE WHEN count(*) >= 2 AND var_pop(value) * var_pop(target) > 0 THEN covar_pop(value, target) / sqrt(var_pop(value) * var_pop(target)) END')} AS value_pearson
FROM points GROUP BY 1""")
def curve_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(metrics.curve_metrics(_gappy_points(spark, folder)))


@query("D20 G1 H7", f"""
WITH {POINTS_SQL}
SELECT episode_id, CAST(floor(frame_index / 32) AS BIGINT) AS page, string_agg(frame_index, ',' ORDER BY frame_index) AS frame_indices,
       string_agg(CAST(round(value * -25 * value * -25 * 100) AS BIGINT), ',' ORDER BY frame_index) AS "values" FROM points GROUP BY 1, 2""")
def assembled_curves(spark: SparkSession, folder: str) -> DataFrame:
    pages = curves.assemble_curves(_gappy_points(spark, folder), page_frames=32)
    cents = F.transform("values", lambda v: F.round(v * -25 * v * -25 * 100).cast("long").cast("string"))
    return pages.select(
        "episode_id", "page", F.array_join(F.col("frame_indices").cast("array<string>"), ",").alias("frame_indices"),
        F.array_join(cents, ",").alias("values"),
    )


@query("G1", f"WITH {POINTS_SQL} SELECT episode_id, frame_index FROM points ORDER BY 1, 2")
def ordered_curve_points(spark: SparkSession, folder: str) -> DataFrame:
    return _gappy_points(spark, folder).select("episode_id", "frame_index").orderBy("episode_id", "frame_index")


@query("K10 G2", f"""WITH {POINTS_SQL}
SELECT count(DISTINCT episode_id) AS num_episodes, count(*) AS num_points,
       (SELECT count(DISTINCT episode_id) FROM points) AS total_num_episodes, CAST(12 AS BIGINT) AS max_episodes
FROM points WHERE episode_id IN (SELECT DISTINCT episode_id FROM points ORDER BY 1 LIMIT 12)""")
def curve_summary(spark: SparkSession, folder: str) -> DataFrame:
    return curves.curve_summary(_gappy_points(spark, folder), 12)


@query("D13", """
SELECT l_orderkey AS episode_id, CAST(l_linenumber AS BIGINT) AS frame_index, 'duplicate' AS problem
FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""")
def curve_point_problems(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("episode_id"), F.col("l_linenumber").cast("long").alias("frame_index"), F.col("l_tax").alias("value")
    )
    return curves.point_problems(rows, ["value"])


@query("G2", f"""
WITH {POINTS_SQL}
SELECT episode_id, frame_index FROM points
WHERE episode_id IN (SELECT DISTINCT episode_id FROM points ORDER BY 1 LIMIT 12)""")
def limited_curves(spark: SparkSession, folder: str) -> DataFrame:
    """A report over the first twelve episodes."""
    return curves.limit_curves(_gappy_points(spark, folder), 12).select("episode_id", "frame_index")


REQUESTED = [7, 3, 7, 11, 0, 3, 2]


@query("B21 I4 C4", f"""
WITH {POINTS_SQL}, asked AS (SELECT unnest({REQUESTED}) AS episode_id, generate_subscripts({REQUESTED}, 1) - 1 AS position),
firsts AS (SELECT episode_id, CAST(min(position) AS INTEGER) AS position FROM asked GROUP BY 1)
SELECT episode_id, position, count(*) AS point_count FROM points JOIN firsts USING (episode_id) GROUP BY 1, 2""")
def requested_curves(spark: SparkSession, folder: str) -> DataFrame:
    points = _gappy_points(spark, folder)
    wanted = curves.requested_episodes(points, REQUESTED)
    return points.join(wanted, "episode_id").groupBy("episode_id", "position").agg(F.count(F.lit(1)).alias("point_count"))


@query("I4", "SELECT event_type, min(event_id) AS event_id FROM events GROUP BY 1")
def ordered_unique(spark: SparkSession, folder: str) -> DataFrame:
    return curves.ordered_unique(table(spark, folder, "events"), "event_type", "event_id")


@query("E7", f"""
WITH {POINTS_SQL},
paired AS (SELECT episode_id, frame_index AS left_frame, lead(frame_index) OVER (PARTITION BY episode_id ORDER BY frame_index) AS right_frame FROM points)
SELECT * FROM paired WHERE right_frame <> left_frame + 1""")
def curve_gaps(spark: SparkSession, folder: str) -> DataFrame:
    return curves.curve_gaps(_gappy_points(spark, folder), BLOCK)


@query("E8", f"""
WITH {POINTS_SQL},
islands AS (SELECT *, frame_index - row_number() OVER (PARTITION BY episode_id ORDER BY frame_index) AS run FROM points)
SELECT episode_id, min(frame_index) AS first_frame, max(frame_index) AS last_frame, count(*) AS point_count
FROM islands GROUP BY episode_id, run""")
def curve_segments(spark: SparkSession, folder: str) -> DataFrame:
    return curves.curve_segments(_gappy_points(spark, folder), BLOCK)


@query("E16", f"""
WITH {POINTS_SQL},
ranked AS (SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY episode_id) AS n
           FROM points WINDOW w AS (PARTITION BY episode_id ORDER BY frame_index))
SELECT episode_id, frame_index, {r6('value')} AS value FROM ranked WHERE rn = n // 2 + 1""")
def preview_points(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(curves.preview_points(_gappy_points(spark, folder), BLOCK).select("episode_id", "frame_index", "value"))


def _domain_sql(group: str) -> str:
    select, by = ("episode_id, ", "GROUP BY 1") if group else ("", "")
    return f"""
WITH {POINTS_SQL},
d AS (SELECT {select} min(value) AS lo, max(value) AS hi FROM points {by}),
s AS (SELECT *, greatest(hi - lo, greatest(abs(lo), abs(hi), 1.0) * 0.08, 0.08) AS span FROM d)
SELECT {select} {r6('lo - span * 0.14')} AS lower, {r6('hi + span * 0.14')} AS upper FROM s"""


@query("D21", _domain_sql("episode_id"))
def value_domain_per_episode(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(curves.value_domain(_gappy_points(spark, folder), ["episode_id"]))


@query("D21", _domain_sql(""))
def value_domain_global(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(curves.value_domain(_gappy_points(spark, folder)))


# Alignment ---------------------------------------------------------------


@query("C7 E12", f"""
WITH {POINTS_SQL},
totals AS (SELECT episode_id, count(*) AS total FROM points GROUP BY 1),
seen AS (
  SELECT f.episode_index AS episode_id, f.frame_index, p.frame_index AS latest_frame, p.value, total,
         (SELECT count(*) FROM points q WHERE q.episode_id = f.episode_index AND q.frame_index <= f.frame_index) AS visible_points
  FROM frames f JOIN totals t ON t.episode_id = f.episode_index
  ASOF LEFT JOIN points p ON p.episode_id = f.episode_index AND p.frame_index <= f.frame_index),
states AS (
  SELECT *, coalesce(latest_frame = frame_index, false) AS exact,
         CASE WHEN visible_points = 0 THEN 'warming_up' WHEN latest_frame = frame_index THEN 'estimated'
              WHEN visible_points = total THEN 'terminal_hold' ELSE 'no_estimate' END AS status FROM seen)
SELECT episode_id, frame_index, visible_points, latest_frame, exact, status,
       {r6("CASE WHEN status IN ('estimated', 'terminal_hold') THEN value END")} AS shown_value FROM states""")
def frame_states(spark: SparkSession, folder: str) -> DataFrame:
    frames = event_table(spark, folder, "event_type")
    return _rounded(align.frame_states(frames, _points_of(frames), block_rows=BLOCK))


@query("C8", f"""
WITH {POINTS_SQL}
SELECT f.episode_index AS episode_id, f.frame_index, {r6('p.value')} AS value
FROM frames f LEFT JOIN points p ON p.episode_id = f.episode_index AND p.frame_index = f.frame_index""")
def exact_values(spark: SparkSession, folder: str) -> DataFrame:
    frames = event_table(spark, folder, "event_type")
    return _rounded(align.values_at(frames, _points_of(frames)))


FPS = 25.0

CHECKED_SQL = f"""
{POINTS_SQL},
spans AS (SELECT episode_id, min(frame_index) AS fc, max(frame_index) AS lc, count(*) AS n FROM points GROUP BY 1),
gaps AS (SELECT episode_id, count(*) AS gaps FROM (
   SELECT episode_id, frame_index, lead(frame_index) OVER (PARTITION BY episode_id ORDER BY frame_index) AS nx FROM points)
   WHERE nx <> frame_index + 1 GROUP BY 1),
checked AS (
  SELECT s.episode_id, fc, lc, n, e.length, e.last_frame, coalesce(g.gaps, 0) AS gaps
  FROM spans s JOIN episodes e ON e.episode_index = s.episode_id LEFT JOIN gaps g USING (episode_id))"""


@query("J1 C12 E7", f"""
WITH {CHECKED_SQL}
SELECT episode_id, fc AS first_curve_frame, lc AS last_curve_frame, gaps,
       concat_ws(';', CASE WHEN gaps > 0 THEN 'frame gaps' END, CASE WHEN lc <> last_frame - 1 THEN 'unexpected last frame' END,
                 CASE WHEN fc <> {HISTORY} - 1 THEN 'unexpected first frame' END) AS soft, '' AS hard FROM checked""")
def alignment_preflight(spark: SparkSession, folder: str) -> DataFrame:
    frames = event_table(spark, folder, "event_type")
    checked = align.preflight(_points_of(frames), align.sources_from_frames(frames, FPS, HISTORY), BLOCK)
    return checked.select(
        "episode_id", "first_curve_frame", "last_curve_frame", "gaps",
        F.array_join("soft", ";").alias("soft"), F.array_join("hard", ";").alias("hard"),
    )


@query("J1", f"""
WITH {CHECKED_SQL},
found AS (
  SELECT episode_id, unnest([CASE WHEN gaps > 0 THEN 'frame gaps' END, CASE WHEN lc <> last_frame - 1 THEN 'unexpected last frame' END,
                             CASE WHEN fc <> {HISTORY} - 1 THEN 'unexpected first frame' END]) AS problem FROM checked)
SELECT episode_id, problem FROM found WHERE problem IS NOT NULL""")
def rejected_alignments(spark: SparkSession, folder: str) -> DataFrame:
    """Episodes that the strict mode refuses."""
    frames = event_table(spark, folder, "event_type")
    checked = align.preflight(_points_of(frames), align.sources_from_frames(frames, FPS, HISTORY), BLOCK)
    return align.rejected(checked, strict=True)


@query("J2 E15", f"""
WITH {CHECKED_SQL}
SELECT episode_id, {FPS}::DOUBLE AS source_fps, {FPS * 2}::DOUBLE AS output_fps, {r6(f'length / {FPS}')} AS source_duration_seconds,
       {r6(f'length / {FPS * 2}')} AS output_duration_seconds, length AS source_frame_count, fc - 0 AS warmup_frame_count,
       lc < last_frame AS terminal_without_new_estimate, fc = {HISTORY} - 1 AS first_frame_verified,
       gaps = 0 AND lc = last_frame - 1 AND fc = {HISTORY} - 1 AS mapping_verified FROM checked""")
def alignment_report(spark: SparkSession, folder: str) -> DataFrame:
    frames = event_table(spark, folder, "event_type")
    checked = align.preflight(_points_of(frames), align.sources_from_frames(frames, FPS, HISTORY), BLOCK)
    return _rounded(
        align.alignment_report(checked, speed=2.0).select(
            "episode_id", "source_fps", "output_fps", "source_duration_seconds", "output_duration_seconds",
            "source_frame_count", "warmup_frame_count", "terminal_without_new_estimate", "first_frame_verified", "mapping_verified",
        )
    )


@query("C12 J4 B14", f"""
WITH {CHECKED_SQL}
SELECT episode_id, concat('/videos/episode-', lpad(CAST(episode_id AS VARCHAR), 6, '0'), '.mp4') AS path,
       lc - 1 + 2 AS frame_count, true AS frame_count_inferred, CAST(1 AS BIGINT) AS first_source_frame,
       lc - 1 + 2 AS last_source_frame, CAST(1 + {HISTORY} - 1 AS BIGINT) AS expected_first_curve_frame FROM checked""")
def template_sources(spark: SparkSession, folder: str) -> DataFrame:
    made = align.sources_from_template(
        _gappy_points(spark, folder), episode_path("/videos/episode-{episode_id:06d}.mp4", F.col("episode_id")), 1, FPS, history=HISTORY
    )
    return made.select(
        "episode_id", "path", "frame_count", "frame_count_inferred", "first_source_frame", "last_source_frame", "expected_first_curve_frame"
    )


# Diagnostics -------------------------------------------------------------

DIRECTIONS, KNOTS = 8, 17

ISOTROPY_SQL = f"""
WITH knots AS (SELECT k, k * 3.0 / 16 AS point, exp(-power(k * 3.0 / 16, 2) / 2) AS target,
                      (CASE WHEN k IN (0, 16) THEN 1 ELSE 2 END) * 3.0 / 16 AS w FROM range(17) t(k)),
hashed AS (
  SELECT d, p, (('0x' || substr(md5(concat('11:0:', d, ':', p)), 1, 8))::BIGINT + 0.5) / 4294967296 AS u,
         (('0x' || substr(md5(concat('11:1:', d, ':', p)), 1, 8))::BIGINT + 0.5) / 4294967296 AS v
  FROM range(64) a(d), range({DIRECTIONS}) b(p)),
normal AS (SELECT d, p, sqrt(-2 * ln(u)) * cos(2 * pi() * v) AS x FROM hashed),
unit AS (SELECT d, p, x / sqrt(sum(x * x) OVER (PARTITION BY p)) AS x FROM normal),
cells AS (SELECT vec_id, unnest(embedding) AS e, generate_subscripts(embedding, 1) - 1 AS d FROM embeddings),
projected AS (SELECT vec_id, p, sum(CAST(e AS DOUBLE) * x) AS z FROM cells JOIN unit USING (d) GROUP BY 1, 2),
errors AS (
  SELECT p, k, (avg(cos(z * point)) - any_value(target)) ** 2 + avg(sin(z * point)) ** 2 AS err,
         any_value(w * target) AS w, count(*) AS n FROM projected, knots GROUP BY 1, 2),
stat AS (SELECT CAST(p AS INTEGER) AS direction, sum(err * w) * max(n) AS statistic FROM errors GROUP BY 1)"""


def _projections() -> np.ndarray:
    return unit_projections(64, DIRECTIONS, 11)


@query("D24 H5", f"{ISOTROPY_SQL} SELECT direction, round(statistic, 5) AS statistic FROM stat")
def isotropy_by_direction(spark: SparkSession, folder: str) -> DataFrame:
    rows = direction_statistics(table(spark, folder, "embeddings"), "embedding", _projections(), KNOTS)
    return rows.withColumn("statistic", F.round("statistic", 5))


@query("D24", f"{ISOTROPY_SQL} SELECT round(avg(statistic), 5) AS isotropy FROM stat")
def embedding_isotropy(spark: SparkSession, folder: str) -> DataFrame:
    rows = isotropy(table(spark, folder, "embeddings"), "embedding", _projections(), KNOTS)
    return rows.withColumn("isotropy", F.round("isotropy", 5))


def _pixel_cells(spark: SparkSession, folder: str) -> DataFrame:
    """Embeddings as tiny images of several layouts and value ranges."""
    size = F.col("vec_id") % 4
    return table(spark, folder, "embeddings").select(
        "vec_id",
        F.when(size == 0, F.array(F.lit(1), F.lit(8), F.lit(8)))
        .when(size == 1, F.array(F.lit(8), F.lit(8), F.lit(1)))
        .when(size == 2, F.array(F.lit(4), F.lit(4), F.lit(4)))
        .otherwise(F.array(F.lit(4), F.lit(8), F.lit(2)))
        .cast("array<long>")
        .alias("shape"),
        F.transform(
            "embedding", lambda x: F.when(F.col("vec_id") % 3 == 0, x).when(F.col("vec_id") % 3 == 1, F.abs(x)).otherwise(F.abs(x) * 250)
        ).alias("pixels"),
    )


PIXELS_SQL = """
WITH cells AS (
  SELECT vec_id, vec_id % 4 AS s, vec_id % 3 AS r, list_min(embedding) AS lo, list_max(list_transform(embedding, lambda x: abs(x))) AS hi FROM embeddings),
seen AS (
  SELECT vec_id, s, CASE WHEN r = 0 THEN lo ELSE 0 END AS low, CASE WHEN r = 2 THEN CAST(hi AS FLOAT) * 250 ELSE hi END AS high FROM cells),
judged AS (
  SELECT *, CASE WHEN s = 2 THEN 'ambiguous layout' WHEN low < -1e-6 THEN 'negative' WHEN high > 255 + 1e-6 THEN 'above 255' END AS problem FROM seen),
audited AS (
  SELECT vec_id, problem,
         CASE WHEN problem IS NULL THEN CASE WHEN s IN (0, 3) THEN 'channels first' ELSE 'channels last' END END AS layout,
         CASE WHEN problem IS NULL THEN CASE WHEN high <= 1.000001 THEN '0..1' ELSE '0..255' END END AS value_range FROM judged)"""


@query("B23", f"{PIXELS_SQL} SELECT * FROM audited")
def pixel_audit(spark: SparkSession, folder: str) -> DataFrame:
    return audit_pixels(_pixel_cells(spark, folder), "pixels", "shape").select("vec_id", "problem", "layout", "value_range")


@query("B23", f"""{PIXELS_SQL}
SELECT vec_id // 10 AS batch, count(*) FILTER (value_range = '0..1') AS unit_images, count(*) FILTER (value_range = '0..255') AS byte_images
FROM audited GROUP BY 1 HAVING unit_images > 0 AND byte_images > 0""")
def mixed_pixel_batches(spark: SparkSession, folder: str) -> DataFrame:
    cells = _pixel_cells(spark, folder).withColumn("batch", F.floor(F.col("vec_id") / 10).cast("long"))
    return mixed_batches(audit_pixels(cells, "pixels", "shape"), ["batch"])


@query("B3", """
SELECT count(*) FILTER (isfinite(x) IS NOT TRUE) AS not_finite, count(*) AS row_count
FROM (SELECT CASE WHEN event_type = 'error' THEN 'inf'::DOUBLE WHEN event_type = 'view' THEN 'nan'::DOUBLE WHEN event_type = 'click' THEN NULL ELSE value END AS x FROM events)""")
def finite_values(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.col("event_type")
    x = (
        F.when(kind == "error", F.lit(float("inf"))).when(kind == "view", F.lit(float("nan")))
        .when(kind == "click", F.lit(None)).otherwise(F.col("value"))
    )
    return table(spark, folder, "events").select(x.alias("x")).agg(
        F.count_if(~is_finite(F.col("x"))).alias("not_finite"), F.count(F.lit(1)).alias("row_count")
    )

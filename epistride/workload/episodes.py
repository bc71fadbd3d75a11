"""Integrity reports, labels and returns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epistride.functions.scalars import clean_text, strict_bool, strict_long, strict_long_token
from epistride.operators import bitmaps, colocated, integrity, labels, returns
from epistride.operators.scans import number_rows, running_sum
from epistride.operators.shards import first_seen_ids
from epistride.workload.registry import query
from epistride.workload.tables import (
    EVENT_EPISODES,
    EVENT_FRAMES,
    EVENT_RETURNS,
    conversation_frames,
    event_frames,
    event_labels,
    event_table,
    line_frames,
    r6,
    table,
)


@query("D1", f"""
WITH {EVENT_FRAMES}
SELECT episode_index, count(*) AS length, min(frame_index) AS first_frame, max(frame_index) AS last_frame
FROM frames GROUP BY 1""")
def episode_summary(spark: SparkSession, folder: str) -> DataFrame:
    return integrity.episode_summary(event_frames(spark, folder))


@query("D14", "SELECT DISTINCT l_orderkey AS episode_index FROM lineitem")
def distinct_episodes(spark: SparkSession, folder: str) -> DataFrame:
    return integrity.distinct_episodes(line_frames(spark, folder))


@query("D13", """
SELECT l_orderkey AS episode_index, CAST(l_linenumber AS BIGINT) AS frame_index, count(*) AS row_count
FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""")
def duplicate_frame_keys(spark: SparkSession, folder: str) -> DataFrame:
    return integrity.duplicate_keys(line_frames(spark, folder), ["episode_index", "frame_index"])


@query("D9", """
SELECT user_id AS episode_index, count(DISTINCT event_type) AS tasks
FROM events GROUP BY 1 HAVING count(DISTINCT event_type) > 1""")
def multi_task_episodes(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").select(
        F.col("user_id").alias("episode_index"), F.col("event_type").alias("task_index")
    )
    return integrity.multi_task_episodes(events)


@query("D15", f"""
WITH {EVENT_EPISODES}
SELECT count(*) AS total_episodes, CAST(sum(length) AS BIGINT) AS total_frames, max(length) AS longest_episode,
       count(*) FILTER (success) AS success_episodes, count(*) FILTER (NOT success) AS failure_episodes,
       (SELECT count(DISTINCT task_index) FROM frames) AS total_tasks
FROM episodes""")
def dataset_totals(spark: SparkSession, folder: str) -> DataFrame:
    frames = event_table(spark, folder)
    labelled = labels.with_labels(frames, event_labels(frames))
    return integrity.dataset_totals(labelled, "episode_success")


def _stored_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events in storage order: users are interleaved."""
    return table(spark, folder, "events").select(
        F.col("user_id").alias("episode_index"), F.col("event_id").alias("index")
    )


@query("E1", """
WITH marked AS (
  SELECT user_id, CASE WHEN lag(user_id) OVER (ORDER BY event_id) = user_id THEN 0 ELSE 1 END AS starts FROM events)
SELECT user_id AS episode_index, CAST(sum(starts) AS BIGINT) AS runs, count(*) AS length FROM marked GROUP BY 1""")
def contiguous_runs(spark: SparkSession, folder: str) -> DataFrame:
    return integrity.episode_runs(_stored_events(spark, folder))


def _indexed_conversations(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations with a table-order row number within the episode."""
    frames = conversation_frames(spark, folder).select("episode_index", "frame_index")
    frames = frames.where((F.col("episode_index") + F.col("frame_index")) % 5 != 2)
    return number_rows(frames, ["episode_index"], "frame_index", ["frame_index"], "index")


@query("E6", """
WITH walked AS (
  SELECT o_custkey AS episode_index, o_orderkey AS "index", o_orderkey AS frame_index,
         lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS step_before FROM orders)
SELECT episode_index, "index", frame_index, step_before FROM walked WHERE frame_index - step_before <> 1""")
def broken_steps(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select(
        F.col("o_custkey").alias("episode_index"),
        F.col("o_orderkey").alias("index"),
        F.col("o_orderkey").alias("frame_index"),
    )
    return integrity.broken_steps(orders, block_rows=1000)


@query("E6", """
SELECT episode_index, count(*) AS gaps FROM (
  SELECT conv_id AS episode_index, turn - lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS d FROM conversations
  WHERE (conv_id + turn) % 5 <> 2)
WHERE d <> 1 GROUP BY 1""")
def broken_conversation_steps(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations that lost every fifth turn."""
    broken = integrity.broken_steps(_indexed_conversations(spark, folder), block_rows=4)
    return broken.groupBy("episode_index").agg(F.count(F.lit(1)).alias("gaps"))


@query("K1 C1 E2", f"""
WITH {EVENT_RETURNS}
SELECT episode_index, frame_index, round(CAST(CAST(ret AS FLOAT) AS DOUBLE), 5) + 0.0 AS "return", CAST(raw AS DOUBLE) AS return_raw,
       CASE WHEN success THEN 1 ELSE 0 END AS episode_success,
       round(sum(observed) OVER (PARTITION BY episode_index ORDER BY frame_index), 4) AS observed_so_far FROM returns""")
def colocated_returns(spark: SparkSession, folder: str) -> DataFrame:
    """Returns and a running sum over frames stored by episode and block: no frame is shuffled again."""
    frames = colocated.stored_by_episode(event_frames(spark, folder))
    made = returns.with_returns(frames, event_labels(frames))
    summed = colocated.running_by_episode(made, {"observed_so_far": running_sum(F.col("observed"))})
    return summed.select(
        "episode_index", "frame_index", F.round(F.col("return").cast("double"), 5).alias("return"),
        F.col("return_raw").cast("double").alias("return_raw"), F.col("episode_success").cast("int").alias("episode_success"),
        F.round("observed_so_far", 4).alias("observed_so_far"),
    )


@query("E6", """
SELECT o_custkey AS episode_index, "after", o_orderkey AS "before" FROM (
  SELECT o_custkey, o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS "after" FROM orders)
WHERE o_orderkey - "after" > 1""")
def step_gaps(spark: SparkSession, folder: str) -> DataFrame:
    """Gaps between the orders of a customer, from bit sets of their numbers."""
    orders = table(spark, folder, "orders").select(F.col("o_custkey").alias("episode_index"), F.col("o_orderkey").alias("frame_index"))
    return bitmaps.step_gaps(orders)


@query("D13", """
SELECT l_orderkey AS episode_index, CAST(l_linenumber AS BIGINT) AS frame_index, count(*) AS row_count
FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""")
def repeated_steps(spark: SparkSession, folder: str) -> DataFrame:
    """Repeated line numbers of an order; only rows of suspect words are counted."""
    return bitmaps.repeated_numbers(line_frames(spark, folder), ["episode_index"], "frame_index")


@query("C4 J10", """
SELECT c_custkey AS episode_index FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)""")
def missing_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Customers without an order, by comparing bit sets."""
    ids = lambda name, column: table(spark, folder, name).select(F.col(column).alias("episode_index"))
    return bitmaps.missing_numbers(ids("customer", "c_custkey"), ids("orders", "o_custkey"), "episode_index")


@query("E6 D13", """
WITH keyed AS (
  SELECT l_orderkey AS episode_index, l_linenumber AS frame_index, count(*) AS copies FROM lineitem GROUP BY 1, 2)
SELECT episode_index, CAST(sum(copies) AS BIGINT) AS length, count(*) AS distinct_frames,
       CAST(min(frame_index) AS BIGINT) AS first_frame, CAST(max(frame_index) AS BIGINT) AS last_frame
FROM keyed GROUP BY 1
HAVING sum(copies) <> count(*) OR max(frame_index) - min(frame_index) + 1 <> count(*)""")
def uneven_episodes(spark: SparkSession, folder: str) -> DataFrame:
    return integrity.uneven_episodes(line_frames(spark, folder))


@query("J5", """
SELECT l_orderkey AS episode_index, count(*) AS length, CAST(min(l_linenumber) AS BIGINT) AS first_frame,
       CAST(max(l_linenumber) AS BIGINT) AS last_frame
FROM lineitem GROUP BY 1 HAVING max(l_linenumber) - min(l_linenumber) + 1 <> count(*)""")
def span_mismatches(spark: SparkSession, folder: str) -> DataFrame:
    return integrity.span_mismatches(line_frames(spark, folder))


@query("J10", """
WITH ids AS (SELECT DISTINCT l_orderkey AS id FROM lineitem)
SELECT count(*) AS episodes, min(id) AS lowest, max(id) AS highest,
       count(*) > 0 AND min(id) = 0 AND max(id) = count(*) - 1 AS zero_based FROM ids""")
def zero_based_episodes(spark: SparkSession, folder: str) -> DataFrame:
    return integrity.zero_based(line_frames(spark, folder))


@query("C4", """
SELECT DISTINCT o_orderkey AS episode_index FROM orders
WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""")
def episodes_without_frames(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("episode_index"))
    return integrity.unknown_keys(orders, line_frames(spark, folder), "episode_index")


@query("G3", """
SELECT DISTINCT o_orderkey AS episode_index FROM orders
WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) ORDER BY 1 LIMIT 10""")
def first_offenders(spark: SparkSession, folder: str) -> DataFrame:
    return integrity.first_offenders(episodes_without_frames(spark, folder), ["episode_index"], 10)


@query("D2", f"WITH {EVENT_EPISODES} SELECT episode_index, success FROM episodes")
def success_by_last_frame(spark: SparkSession, folder: str) -> DataFrame:
    frames = event_frames(spark, folder)
    flag = labels.success_column(frames.columns)
    return labels.reduce_success(frames, flag, "last")


@query("D2", "SELECT user_id AS episode_index, bool_or(event_type = 'purchase') AS success FROM events GROUP BY 1")
def success_by_any_frame(spark: SparkSession, folder: str) -> DataFrame:
    return labels.reduce_success(event_frames(spark, folder), "next.success", "any")


@query("D2", """
SELECT conv_id AS episode_index,
       CASE WHEN min(CASE WHEN role = 'user' THEN 1 ELSE 0 END) = max(CASE WHEN role = 'user' THEN 1 ELSE 0 END)
            THEN min(CASE WHEN role = 'user' THEN 1 ELSE 0 END) = 1 END AS success
FROM conversations GROUP BY 1""")
def success_by_constant_flag(spark: SparkSession, folder: str) -> DataFrame:
    frames = conversation_frames(spark, folder).withColumn("success", (F.col("role") == "user").cast("int"))
    return labels.reduce_success(frames, labels.success_column(frames.columns), "constant")


@query("D2", """
SELECT user_id AS episode_index, count(*) FILTER (event_type = 'purchase') AS set_frames,
       count(*) FILTER (event_type <> 'purchase') AS clear_frames
FROM events GROUP BY 1 HAVING set_frames > 0 AND clear_frames > 0""")
def changing_success_flags(spark: SparkSession, folder: str) -> DataFrame:
    return labels.changing_labels(event_frames(spark, folder), "next.success")


@query("C4 D14", """
SELECT doc_id AS episode_index, 'missing label' AS problem FROM documents
WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def label_problems(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select(F.col("doc_id").alias("episode_index"))
    known = table(spark, folder, "labels").select(
        F.col("doc_id").alias("episode_index"), strict_bool(F.col("quality")).alias("success")
    )
    return labels.label_problems(documents, known)


@query("C1", f"""
WITH {EVENT_EPISODES}
SELECT f.episode_index, f.frame_index, f.event_id, CASE WHEN e.success THEN 1 ELSE 0 END AS episode_success
FROM frames f JOIN episodes e USING (episode_index)""")
def labelled_frames(spark: SparkSession, folder: str) -> DataFrame:
    frames = event_table(spark, folder)
    return labels.with_labels(frames, event_labels(frames)).select(
        "episode_index", "frame_index", "event_id", F.col("episode_success").cast("int")
    )


@query("B8", f"""
WITH {EVENT_EPISODES}
SELECT f.episode_index, f.frame_index, f.flag = 1 AS stored, e.success
FROM frames f JOIN episodes e USING (episode_index) WHERE (f.flag = 1) <> e.success""")
def disagreeing_labels(spark: SparkSession, folder: str) -> DataFrame:
    frames = event_table(spark, folder)
    return labels.disagreeing_labels(frames, event_labels(frames), "next.success")


@query("B1", """
SELECT count(*) FILTER (quality IS NULL OR quality NOT IN (0, 1)) AS quality,
       count(*) FILTER (toxic + quality NOT IN (0, 1)) AS total FROM labels""")
def strict_boolean_violations(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "labels")
    return integrity.count_nulls(
        rows, {"quality": strict_bool(F.col("quality")), "total": strict_bool(F.col("toxic") + F.col("quality"))}
    )


@query("B2", """
SELECT count(*) FILTER (l_quantity <> round(l_quantity)) AS quantity,
       count(*) FILTER (l_extendedprice <> floor(l_extendedprice)) AS price FROM lineitem""")
def strict_integer_violations(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem")
    return integrity.count_nulls(
        rows, {"quantity": strict_long(F.col("l_quantity")), "price": strict_long(F.col("l_extendedprice"))}
    )


@query("B2", """
SELECT doc_id, CAST(9007199254740993 + doc_id AS BIGINT) AS number, CAST(1234567890123456789 + doc_id AS BIGINT) AS token,
       CASE WHEN doc_id % 2 = 0 THEN CAST(doc_id // 2 AS BIGINT) END AS half FROM documents""")
def exact_integers(spark: SparkSession, folder: str) -> DataFrame:
    """Integers beyond the precision of a double, as numbers and as text."""
    rows = table(spark, folder, "documents").select("doc_id")
    return rows.select(
        "doc_id",
        strict_long(F.lit(9007199254740993) + F.col("doc_id")).alias("number"),
        strict_long_token((F.lit(1234567890123456789) + F.col("doc_id")).cast("string")).alias("token"),
        strict_long(F.col("doc_id") / 2).alias("half"),
    )


@query("D3", f"""
WITH {EVENT_EPISODES}
SELECT task_index, max(length) AS task_max_length FROM episodes GROUP BY 1""")
def task_max_length(spark: SparkSession, folder: str) -> DataFrame:
    frames = event_frames(spark, folder)
    per_episode = frames.groupBy("episode_index").agg(
        F.min("task_index").alias("task_index"), F.count(F.lit(1)).alias("length")
    )
    return returns.task_max_length(per_episode)


def event_returns(spark: SparkSession, folder: str, normalisation: str = "task_max", **options) -> DataFrame:
    frames = event_table(spark, folder)
    return returns.with_returns(frames, event_labels(frames), normalisation, **options)


def _rounded_returns(df: DataFrame) -> DataFrame:
    return df.select(
        "episode_index",
        "frame_index",
        F.round(F.col("return").cast("double"), 5).alias("return"),
        F.col("return_raw").cast("double").alias("return_raw"),
        F.col("episode_success").cast("int").alias("episode_success"),
    )


@query("E2 B11 D3 C1", f"""
WITH {EVENT_RETURNS}
SELECT episode_index, frame_index, round(CAST(CAST(ret AS FLOAT) AS DOUBLE), 5) + 0.0 AS "return",
       CAST(raw AS DOUBLE) AS return_raw, CASE WHEN success THEN 1 ELSE 0 END AS episode_success FROM returns""")
def return_to_go(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded_returns(event_returns(spark, folder))


@query("E2 B11 C1", f"""
WITH {EVENT_RETURNS}
SELECT episode_index, frame_index * 2 AS frame_index, round(CAST(CAST(ret AS FLOAT) AS DOUBLE), 5) + 0.0 AS "return",
       CAST(raw AS DOUBLE) AS return_raw, CASE WHEN success THEN 1 ELSE 0 END AS episode_success FROM returns""")
def return_to_go_by_step(spark: SparkSession, folder: str) -> DataFrame:
    """Frame numbers go up by two; a column of their own counts the steps."""
    frames = event_table(spark, folder).withColumn("step", F.col("frame_index") + 7)
    frames = frames.withColumn("frame_index", F.col("frame_index") * 2)
    return _rounded_returns(returns.with_returns(frames, event_labels(frames), step="step"))


@query("E2 C10", f"""
WITH {EVENT_RETURNS}
SELECT episode_index, frame_index, round(CAST(CAST(ret AS FLOAT) AS DOUBLE), 5) + 0.0 AS "return",
       CAST(raw AS DOUBLE) AS return_raw, CASE WHEN success THEN 1 ELSE 0 END AS episode_success FROM returns""")
def returns_by_rank(spark: SparkSession, folder: str) -> DataFrame:
    """The verification's own way to the returns, over several blocks an episode."""
    frames = event_table(spark, folder)
    terms = returns.episode_terms(frames, event_labels(frames))
    return _rounded_returns(returns.returns_by_rank(frames, terms, block_rows=16))


@query("E2 B11 D4", f"""
WITH {EVENT_RETURNS}, limits AS (SELECT min(raw) AS lo, max(raw) AS hi FROM returns)
SELECT episode_index, frame_index,
       round(CAST(CAST(-1 + 2.0 * (raw - lo)::DOUBLE / (hi - lo) AS FLOAT) AS DOUBLE), 5) + 0.0 AS "return",
       CAST(raw AS DOUBLE) AS return_raw, CASE WHEN success THEN 1 ELSE 0 END AS episode_success
FROM returns, limits""")
def return_to_go_global_range(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded_returns(event_returns(spark, folder, "global_minmax"))


@query("E2", f"""
WITH {EVENT_EPISODES}
SELECT f.episode_index, f.frame_index, CASE WHEN e.success THEN 1 ELSE 0 END AS episode_success,
       CAST((CASE WHEN e.success THEN 0 ELSE -50 END) - 2.5 * (e.length - 1 - f.frame_index) AS DOUBLE) AS "return",
       CAST((CASE WHEN e.success THEN 0 ELSE -50 END) - 2.5 * (e.length - 1 - f.frame_index) AS DOUBLE) AS return_raw
FROM frames f JOIN episodes e USING (episode_index)""")
def return_to_go_fixed_penalty(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded_returns(event_returns(spark, folder, "none", failure_penalty=50.0, step_scale=2.5))


@query("D4", f"WITH {EVENT_RETURNS} SELECT CAST(min(raw) AS DOUBLE) AS low, CAST(max(raw) AS DOUBLE) AS high FROM returns")
def raw_return_range(spark: SparkSession, folder: str) -> DataFrame:
    frames = event_table(spark, folder)
    return returns.raw_range(returns.episode_terms(frames, event_labels(frames)))


@query("D16", f"""
WITH {EVENT_RETURNS}
SELECT CAST(min(raw) AS DOUBLE) AS raw_min, CAST(max(raw) AS DOUBLE) AS raw_max,
       {r6('min(ret)')} AS normalised_min, {r6('max(ret)')} AS normalised_max FROM returns""")
def value_ranges(spark: SparkSession, folder: str) -> DataFrame:
    ranges = returns.value_ranges(event_returns(spark, folder))
    return ranges.select(*[F.round(F.col(n).cast("double"), 6).alias(n) for n in ranges.columns])


@query("E9", """
WITH first AS (SELECT trim(source) AS task, min(doc_id) AS first_row FROM documents GROUP BY 1)
SELECT task, row_number() OVER (ORDER BY first_row) - 1 AS task_index, first_row FROM first""")
def first_seen_task_ids(spark: SparkSession, folder: str) -> DataFrame:
    frames = table(spark, folder, "documents").select(
        clean_text(F.col("source")).alias("task"), F.col("doc_id").alias("index")
    )
    return first_seen_ids(frames, "task")

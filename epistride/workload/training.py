"""Splits, normalisation, statistics and history windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epistride.operators import normalise, permutation, splits, statistics, windows
from epistride.operators.integrity import partly_missing, size_gates
from epistride.operators.scans import hash_rank, ordered_rank, position_block
from epistride.session import scratch_path
from epistride.workload.registry import query
from epistride.workload.tables import (
    EVENT_EPISODES,
    EVENT_FRAMES,
    VECTOR_FRAMES,
    conversation_frames,
    event_frames,
    event_table,
    r6,
    split_sql,
    table,
    vector_frames,
    wall_micros,
)

FRACTION, SEED = 0.1, 42


@query("E11 I1 D14", f"WITH {split_sql('(SELECT user_id AS episode_index FROM events)', FRACTION, SEED)} SELECT * FROM split")
def seeded_episode_split(spark: SparkSession, folder: str) -> DataFrame:
    return splits.seeded_split(_users(spark, folder), FRACTION, SEED)


def _users(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(F.col("user_id").alias("episode_index"))


@query("C3", f"""
WITH {EVENT_FRAMES}, {split_sql('frames', 0.2, 7)}
SELECT episode_index, frame_index, event_id FROM frames
WHERE episode_index IN (SELECT episode_index FROM split WHERE split = 'val')""")
def validation_frames(spark: SparkSession, folder: str) -> DataFrame:
    split = splits.seeded_split(_users(spark, folder), 0.2, 7)
    return splits.select_split(event_frames(spark, folder), split, "val").select("episode_index", "frame_index", "event_id")


def _two_sided(spark: SparkSession, folder: str) -> DataFrame:
    """A leaking split: labels name the training side, toxic the other."""
    rows = table(spark, folder, "labels")
    side = lambda name, test: rows.where(test).select(F.col("doc_id").alias("episode_index"), F.lit(name).alias("split"))
    return side("train", F.col("quality") == 1).unionByName(side("val", F.col("toxic") == 1))


@query("I1", "SELECT doc_id AS episode_index FROM labels WHERE quality = 1 AND toxic = 1")
def split_overlap(spark: SparkSession, folder: str) -> DataFrame:
    return splits.split_overlap(_two_sided(spark, folder))


@query("I2", """
WITH asked AS (SELECT doc_id AS id FROM labels WHERE quality = 1 OR toxic = 1),
     there AS (SELECT doc_id + 40 AS id FROM documents)
SELECT id AS episode_index, 'unknown' AS problem FROM (SELECT id FROM asked EXCEPT SELECT id FROM there)
UNION ALL
SELECT id AS episode_index, 'missing' AS problem FROM (SELECT id FROM there EXCEPT SELECT id FROM asked)""")
def split_coverage(spark: SparkSession, folder: str) -> DataFrame:
    # Shifted ids: some labelled episodes have no frames.
    frames = table(spark, folder, "documents").select((F.col("doc_id") + 40).alias("episode_index"))
    return splits.split_coverage(_two_sided(spark, folder), frames)


def _document_numbers(spark: SparkSession, folder: str) -> DataFrame:
    ids = table(spark, folder, "documents").select("doc_id")
    return ordered_rank(ids, position_block(F.col("doc_id")), ["doc_id"])


@query("E13", "SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rank, CAST((row_number() OVER (ORDER BY doc_id) - 1) % 8 AS INTEGER) AS shard FROM documents")
def trainer_shards(spark: SparkSession, folder: str) -> DataFrame:
    return splits.trainer_shard(_document_numbers(spark, folder), 8)


MOMENTS_SQL = f"""
{VECTOR_FRAMES}, {split_sql('frames', 0.2, SEED)},
cells AS (
  SELECT unnest(action) AS x, generate_subscripts(action, 1) - 1 AS position
  FROM frames WHERE episode_index IN (SELECT episode_index FROM split WHERE split = 'train')),
moments AS (
  SELECT CAST(position AS INTEGER) AS position, count(*) AS count, avg(CAST(x AS DOUBLE)) AS mean,
         stddev_pop(CAST(x AS DOUBLE)) AS std FROM cells GROUP BY 1)"""


@query("D5 C3 B3", f"WITH {MOMENTS_SQL} SELECT position, count, {r6('mean')} AS mean, {r6('std')} AS std FROM moments")
def vector_moments(spark: SparkSession, folder: str) -> DataFrame:
    frames = _labelled_vectors(spark, folder)
    train = splits.select_split(frames, splits.seeded_split(frames, 0.2, SEED), "train")
    return normalise.dimension_moments(train, "action").select(
        "position", "count", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std")
    )


def _labelled_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(
        F.col("label").cast("long").alias("episode_index"), "vec_id", F.col("embedding").alias("action")
    )


@query("D5 B9", f"""
WITH {MOMENTS_SQL},
fitted AS (SELECT position, CAST(mean AS FLOAT) AS mean, CAST(greatest(std, 1e-6) AS FLOAT) AS std FROM moments),
all_cells AS (SELECT vec_id, unnest(action) AS x, CAST(generate_subscripts(action, 1) - 1 AS INTEGER) AS position FROM frames)
SELECT vec_id, round(sum(CAST((x - mean) / std AS DOUBLE)), 1) + 0.0 AS total,
       round(max(CAST((x - mean) / std AS DOUBLE)), 3) + 0.0 AS highest
FROM all_cells JOIN fitted USING (position) GROUP BY 1""")
def standardised_vectors(spark: SparkSession, folder: str) -> DataFrame:
    frames = _labelled_vectors(spark, folder)
    stats = normalise.fit_normalisation(frames, splits.seeded_split(frames, 0.2, SEED))
    scaled = normalise.apply_normalisation(frames, stats)
    total = F.aggregate("action", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return scaled.select(
        "vec_id", F.round(total, 1).alias("total"), F.round(F.array_max("action").cast("double"), 3).alias("highest")
    )


@query("B10", """
SELECT CASE vec_id % 5 WHEN 1 THEN 'missing' WHEN 2 THEN 'dimension' WHEN 3 THEN 'not positive' WHEN 4 THEN 'not finite' END AS problem,
       count(*) AS rows FROM embeddings WHERE vec_id % 5 > 0 GROUP BY 1""")
def statistics_problems(spark: SparkSession, folder: str) -> DataFrame:
    """Each vector taken for fitted statistics, four of five of them damaged."""
    kind, vector = F.col("vec_id") % 5, F.col("embedding")
    positive = F.transform(vector, lambda x: F.abs(x) + 1)
    std = F.when(kind == 2, F.slice(positive, 1, 63)).when(kind == 3, F.transform(positive, lambda x: -x)).otherwise(positive)
    mean = F.when(kind == 4, F.transform(vector, lambda x: x + F.lit(float("nan")).cast("float"))).otherwise(vector)
    stats = table(spark, folder, "embeddings").select(F.when(kind != 1, mean).alias("mean"), std.alias("std"))
    found = normalise.statistics_problems(stats, 64)
    return found.groupBy("problem").agg(F.count(F.lit(1)).alias("rows"))


@query("B17", """
SELECT CAST(min(len(embedding)) AS INTEGER) AS smallest, CAST(max(len(embedding)) AS INTEGER) AS largest,
       min(len(embedding)) = max(len(embedding)) AS fixed FROM embeddings""")
def vector_dimension(spark: SparkSession, folder: str) -> DataFrame:
    return normalise.vector_dimension(_labelled_vectors(spark, folder), "action")


# Feature statistics ------------------------------------------------------

CELLS_SQL = """
cells AS (
  SELECT CAST(label AS BIGINT) AS episode_index, 'action' AS feature,
         CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS position, CAST(unnest(embedding) AS DOUBLE) AS x
  FROM embeddings
  UNION ALL
  SELECT label, 'vec_id', 0, CAST(vec_id AS DOUBLE) FROM embeddings)"""

STATS_SQL = f"""
{r6('min(x)')} AS min, {r6('max(x)')} AS max, {r6('avg(x)')} AS mean, {r6('stddev_pop(x)')} AS std, count(*) AS count
FROM cells GROUP BY ALL"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in ("min", "max", "mean", "std")})


@query("D17", f"WITH {CELLS_SQL} SELECT feature, position, {STATS_SQL}")
def feature_statistics(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(statistics.feature_statistics(_labelled_vectors(spark, folder), ["action", "vec_id"]))


@query("D18", f"WITH {CELLS_SQL} SELECT episode_index, feature, position, {STATS_SQL}")
def episode_statistics(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(statistics.episode_statistics(_labelled_vectors(spark, folder)))


@query("D19", f"WITH {CELLS_SQL} SELECT feature, position, {STATS_SQL}")
def merged_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """Per-episode statistics rolled up to the whole."""
    return _rounded(statistics.merge_statistics(statistics.episode_statistics(_labelled_vectors(spark, folder))))


@query("D19", f"""WITH {CELLS_SQL}
SELECT feature, position FROM cells WHERE feature = 'action' AND position % 9 = 4 GROUP BY ALL""")
def rollup_differences(spark: SparkSession, folder: str) -> DataFrame:
    """Statistics of the whole of which every ninth dimension is wrong."""
    frames = _labelled_vectors(spark, folder)
    whole = statistics.feature_statistics(frames, ["action", "vec_id"])
    wrong = (F.col("feature") == "action") & (F.col("position") % 9 == 4)
    whole = whole.withColumn("mean", F.col("mean") + F.when(wrong, F.lit(0.5)).otherwise(F.lit(0.0)))
    return statistics.rollup_differences(statistics.episode_statistics(frames), whole).select("feature", "position")


# Times of day to the second, as seconds since 1970 and, moved by 1e9, farther from zero.
TIMES_SQL = """
times AS (
  SELECT user_id AS episode_index, floor(epoch(ts)) AS seconds, floor(epoch(ts)) % 1000 + 1e9 AS far FROM events),
cells AS (
  SELECT episode_index, 'seconds' AS feature, 0 AS position, seconds AS x FROM times
  UNION ALL SELECT episode_index, 'far', 0, far FROM times)"""


def _time_frames(spark: SparkSession, folder: str) -> DataFrame:
    seconds = F.floor(wall_micros("ts") / 1_000_000)
    return table(spark, folder, "events").select(
        F.col("user_id").alias("episode_index"), seconds.cast("double").alias("seconds"), (seconds % 1000 + 1e9).alias("far")
    )


@query("D19 L2", f"""WITH {TIMES_SQL}
SELECT feature, position, min(x) AS min, max(x) AS max, round(avg(x), 4) AS mean, round(stddev_pop(x), 4) AS std, count(*) AS count
FROM cells GROUP BY ALL""")
def merged_time_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """Per-episode statistics of times, rolled up: the values are far larger than their spread."""
    merged = statistics.merge_statistics(statistics.episode_statistics(_time_frames(spark, folder)))
    return merged.withColumns({n: F.round(n, 4) for n in ("mean", "std")})


@query("D19", f"WITH {TIMES_SQL} SELECT DISTINCT feature, position FROM cells WHERE feature = 'far'")
def damaged_time_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """Statistics of times of which one deviation is wrong by a thousandth."""
    frames = _time_frames(spark, folder)
    whole = statistics.feature_statistics(frames, ["seconds", "far"])
    whole = whole.withColumn("std", F.col("std") * F.when(F.col("feature") == "far", 1.001).otherwise(1.0))
    return statistics.rollup_differences(statistics.episode_statistics(frames), whole).select("feature", "position")


@query("D23 A5", """
WITH sizes AS (SELECT min(n_chars % 5 + 1) AS low, max(n_chars % 5 + 1) AS high, count(*) FILTER (doc_id % 4 = 1) AS noted, count(*) AS n FROM documents)
SELECT 'amount' AS feature, 'float64' AS dtype, '1' AS shape, true AS fixed, CAST(0 AS BIGINT) AS missing, false AS conflict FROM sizes
UNION ALL SELECT 'doc_id', 'int64', '1', true, 0, false FROM sizes
UNION ALL SELECT 'mark', NULL, '1', true, 0, true FROM sizes
UNION ALL SELECT 'note', 'string', '1', true, n - noted, false FROM sizes
UNION ALL SELECT 'steps', 'int64', CAST(high AS VARCHAR) || ',2', low = high, 0, false FROM sizes""")
def disagreeing_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Features of JSON lines whose types and list lengths differ from line to line."""
    i = F.col("doc_id")
    pairs = F.transform(F.sequence(F.lit(1), (F.col("n_chars") % 5 + 1).cast("int")), lambda k: F.array(k, k + 1))
    member = lambda name, value: F.concat(F.lit(f'"{name}": '), value)
    line = F.concat_ws(
        ", ",
        member("doc_id", i.cast("string")),
        member("amount", F.when(i % 2 == 0, i.cast("string")).otherwise((i / 4).cast("string"))),
        member("mark", F.when(i % 3 == 0, F.lit('"three"')).otherwise(i.cast("string"))),
        member("steps", F.to_json(pairs)),
        F.when(i % 4 == 1, member("note", F.lit('"one"'))),
    )
    path = scratch_path(spark, "lines")
    table(spark, folder, "documents").select(F.concat(F.lit("{"), line, F.lit("}")).alias("value")).write.text(path)
    found = statistics.line_features(spark.read.text(path))
    return found.select("feature", "dtype", F.array_join("shape", ",").alias("shape"), "fixed", "missing", "conflict")


@query("D22", """
WITH lists AS (SELECT string_split(text, ' ') AS words FROM documents)
SELECT 'words' AS feature, min(len(words)) AS smallest, max(len(words)) AS largest FROM lists HAVING min(len(words)) <> max(len(words))""")
def ragged_features(spark: SparkSession, folder: str) -> DataFrame:
    lists = table(spark, folder, "documents").select(F.split("text", " ").alias("words"), "n_chars")
    return statistics.ragged_features(lists)


@query("D23", """
SELECT 'vec_id' AS feature, 'int64' AS dtype, '1' AS shape, true AS fixed FROM (SELECT 1)
UNION ALL SELECT 'label', 'int32', '1', true
UNION ALL SELECT 'embedding', 'float32', CAST(max(len(embedding)) AS VARCHAR), min(len(embedding)) = max(len(embedding)) FROM embeddings
UNION ALL SELECT 'halves', 'float32', '2x32', max(len(embedding)) = 64 FROM embeddings""")
def inferred_features(spark: SparkSession, folder: str) -> DataFrame:
    halves = F.array(F.slice("embedding", 1, 32), F.slice("embedding", 33, 32))
    rows = table(spark, folder, "embeddings").withColumn("halves", halves)
    return statistics.inferred_features(rows).select(
        "feature", "dtype", F.array_join(F.col("shape").cast("array<string>"), "x").alias("shape"), "fixed"
    )


# Windows -----------------------------------------------------------------

HISTORY = 3

WINDOWS_SQL = f"""
{EVENT_FRAMES},
windows AS (
  SELECT *, list(frame_index) OVER w AS fr, list(observed) OVER w AS obs
  FROM frames WINDOW w AS (PARTITION BY episode_index ORDER BY frame_index ROWS BETWEEN CURRENT ROW AND {HISTORY} FOLLOWING)
  QUALIFY len(fr) = {HISTORY} + 1)"""


@query("E3 U4 H7 B16", f"""
WITH {WINDOWS_SQL}
SELECT episode_index AS episode_id, concat(episode_index, ':', frame_index) AS sample_id, frame_index AS start_frame,
       array_to_string(fr[1:{HISTORY}], ',') AS frame_indices,
       array_to_string(list_transform(obs[1:{HISTORY}], lambda x: CAST(CAST(round(x * 100) AS BIGINT) AS VARCHAR)), ',') AS observed,
       array_to_string(list_transform(obs[2:{HISTORY} + 1], lambda x: CAST(CAST(round(x * 100) AS BIGINT) AS VARCHAR)), ',') AS next_observed
FROM windows""")
def history_windows(spark: SparkSession, folder: str) -> DataFrame:
    made = windows.history_windows(event_frames(spark, folder), HISTORY, ["observed"])
    cents = lambda c: F.array_join(F.transform(c, lambda x: F.round(x * 100).cast("long").cast("string")), ",")
    return windows.split_window(made, HISTORY, ["observed"], ["observed"]).select(
        "episode_id",
        "sample_id",
        "start_frame",
        F.array_join(F.col("frame_indices").cast("array<string>"), ",").alias("frame_indices"),
        cents("observed").alias("observed"),
        cents("next_observed").alias("next_observed"),
    )


@query("E3 E4", """
SELECT conv_id AS episode_id, turn AS start_frame, endpoint, endpoint_chars FROM (
  SELECT conv_id, turn, lead(turn, 2) OVER w AS endpoint, CAST(length(lead(text, 2) OVER w) AS BIGINT) AS endpoint_chars,
         lead(turn, 3) OVER w AS beyond
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE beyond IS NOT NULL""")
def window_endpoints(spark: SparkSession, folder: str) -> DataFrame:
    made = windows.history_windows(conversation_frames(spark, folder), HISTORY, ["n_chars"])
    parts = windows.split_window(made, HISTORY, ["n_chars"])
    valid = F.transform("frame_indices", lambda f: f.isNotNull())
    return parts.select(
        "episode_id",
        "start_frame",
        windows.endpoint(F.col("frame_indices"), valid).alias("endpoint"),
        windows.endpoint(F.col("n_chars"), valid).alias("endpoint_chars"),
    )


@query("E4 E15", f"""
WITH {EVENT_EPISODES}
SELECT f.episode_index, f.frame_index, f.event_id FROM frames f JOIN episodes e USING (episode_index)
WHERE f.frame_index >= {HISTORY} - 1 AND f.frame_index < e.last_frame""")
def endpoint_frames(spark: SparkSession, folder: str) -> DataFrame:
    frames = event_table(spark, folder)
    return windows.endpoint_frames(frames, HISTORY).select("episode_index", "frame_index", "event_id")


@query("E3 U4", """
SELECT conv_id AS episode_index, count(*) AS length, min(turn) AS first_frame, max(turn) AS last_frame,
       greatest(0, count(*) - 3) AS windows FROM conversations GROUP BY 1""")
def window_counts(spark: SparkSession, folder: str) -> DataFrame:
    return windows.window_counts(conversation_frames(spark, folder), HISTORY)


NUMBERED_SQL = f"""
{EVENT_EPISODES},
starts AS (
  SELECT f.episode_index AS episode_id, f.frame_index AS start_frame,
         concat(f.episode_index, ':', f.frame_index) AS sample_id,
         row_number() OVER (ORDER BY f.episode_index, f.frame_index) AS rank
  FROM frames f JOIN episodes e USING (episode_index) WHERE f.frame_index + {HISTORY} <= e.last_frame)"""


@query("E3 E5", f"WITH {NUMBERED_SQL} SELECT * FROM starts")
def window_numbers(spark: SparkSession, folder: str) -> DataFrame:
    return windows.window_numbers(event_table(spark, folder), HISTORY)


@query("E17", f"WITH {NUMBERED_SQL} SELECT sample_id, rank, CAST((rank - 1) // 64 AS BIGINT) AS batch FROM starts WHERE (rank - 1) // 64 < (SELECT count(*) // 64 FROM starts)")
def full_batches(spark: SparkSession, folder: str) -> DataFrame:
    frames = event_table(spark, folder)
    total = windows.total_windows(frames, HISTORY)
    numbered = windows.window_numbers(frames, HISTORY)
    return windows.batches(numbered, 64, drop_last=True, total=total).select("sample_id", "rank", "batch")


@query("E17 E13", f"WITH {NUMBERED_SQL} SELECT sample_id, CAST((rank - 1) // 50 AS BIGINT) AS batch, CAST((rank - 1) % 4 AS INTEGER) AS shard FROM starts")
def evaluation_batches(spark: SparkSession, folder: str) -> DataFrame:
    numbered = windows.window_numbers(event_table(spark, folder), HISTORY)
    return splits.trainer_shard(windows.batches(numbered, 50, drop_last=False), 4).select("sample_id", "batch", "shard")


@query("E18", f"""
WITH {NUMBERED_SQL},
shuffled AS (SELECT sample_id, row_number() OVER (ORDER BY md5(concat('{SEED}:3:', sample_id)), sample_id) AS rank FROM starts)
SELECT * FROM shuffled WHERE rank <= (SELECT count(*) // 8 * 8 FROM starts)""")
def epoch_order(spark: SparkSession, folder: str) -> DataFrame:
    frames = event_table(spark, folder)
    shuffled = windows.epoch_order(windows.window_starts(frames, HISTORY).select("sample_id"), SEED, 3)
    return windows.drop_padding(shuffled, 8, windows.total_windows(frames, HISTORY))


def _network_sql(x: str, source: str, seed: str, kept: str) -> str:
    """A pass of the six-round network over ``x``, as nested selections; ``shape`` holds height and width."""
    mixed = lambda value, n: f"('0x' || substr(md5(concat('{seed}:{n}:', {value})), 1, 15))::BIGINT"
    sql = f"SELECT {kept}, height, width, {x} // width AS l, {x} % width AS r FROM {source}, shape"
    for n in range(6):
        l, r = (f"(l + {mixed('r', n)} % height) % height", "r") if n % 2 == 0 else ("l", f"(r + {mixed('l', n)} % width) % width")
        sql = f"SELECT {kept}, height, width, {l} AS l, {r} AS r FROM ({sql})"
    return f"SELECT {kept}, l * width + r AS x FROM ({sql})"


SHUFFLED_SQL = f"""
WITH RECURSIVE {NUMBERED_SQL},
sized AS (SELECT count(*) AS n FROM starts),
shape AS (
  SELECT n, height, (n + height - 1) // height AS width
  FROM (SELECT n, (SELECT min(h) FROM range(1, 100000) t(h) WHERE h * h >= n) AS height FROM sized)),
walk AS (
  {_network_sql('(rank - 1)', 'starts', f'{SEED}:3', 'rank, 0 AS step')}
  UNION ALL
  {_network_sql('x', '(SELECT walk.* FROM walk, sized WHERE x >= n)', f'{SEED}:3', 'rank, step + 1 AS step').replace('SELECT rank, step + 1 AS step', 'SELECT rank, step', 6)})"""


@query("E18", f"{SHUFFLED_SQL} SELECT sample_id, x + 1 AS rank FROM starts JOIN walk USING (rank), sized WHERE x < n")
def shuffled_epoch(spark: SparkSession, folder: str) -> DataFrame:
    """An epoch's order by a keyed permutation of the window numbers: a projection, no sort."""
    frames = event_table(spark, folder)
    total = windows.total_windows(frames, HISTORY).first()[0]
    return permutation.shuffled(windows.window_numbers(frames, HISTORY), total, SEED, 3).select("sample_id", "rank")


@query("E18 E17", f"{SHUFFLED_SQL} SELECT sample_id, x + 1 AS rank FROM starts JOIN walk USING (rank), sized WHERE x < n AND x // 64 = 2")
def epoch_batch(spark: SparkSession, folder: str) -> DataFrame:
    """The members of an epoch's third batch, found without building the order."""
    return permutation.batch_members(spark, event_table(spark, folder), HISTORY, 2, 64, SEED, 3).select("sample_id", "rank")


@query("D27", f"WITH {NUMBERED_SQL} SELECT count(*) AS windows, count(*) > 0 AS any_window, count(*) >= 100000 AS full_batch FROM starts")
def window_size_gates(spark: SparkSession, folder: str) -> DataFrame:
    return size_gates(windows.total_windows(event_frames(spark, folder), HISTORY), 100_000)


@query("C13 D9", """
SELECT concat(conv_id, ':', turn) AS sample_id, 'task changes' AS problem FROM (
  SELECT conv_id, turn, role, lead(role, 1) OVER w AS a, lead(role, 2) OVER w AS b, lead(role, 3) OVER w AS c
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
WHERE c IS NOT NULL AND (a <> role OR b <> role OR c <> role)""")
def window_problems(spark: SparkSession, folder: str) -> DataFrame:
    made = windows.history_windows(conversation_frames(spark, folder), HISTORY, ["role"], over_gaps=True)
    return windows.window_problems(made, task="role")


@query("B19", """
SELECT user_id AS episode_index, count(*) AS row_count, count(CASE WHEN event_type <> 'error' THEN value END) AS state
FROM events GROUP BY 1 HAVING state > 0 AND state < count(*)""")
def partly_missing_states(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events").select(
        F.col("user_id").alias("episode_index"), F.when(F.col("event_type") != "error", F.col("value")).alias("state")
    )
    return partly_missing(rows, ["episode_index"], ["state"])


@query("E11", "SELECT o_orderkey, row_number() OVER (ORDER BY md5(concat('5:', o_orderkey)), o_orderkey) AS rank FROM orders")
def hashed_order(spark: SparkSession, folder: str) -> DataFrame:
    """Seeded permutation of all orders."""
    return hash_rank(table(spark, folder, "orders").select("o_orderkey"), "5", F.col("o_orderkey"), ["o_orderkey"])

"""The registered queries of this package: thin uses of the operators on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from epistride.llm import chatlog, decontaminate, fingerprints, labelled, lexical, mixing, packing, prefixtrie, quality, repeats, simhash, surrogates, toxicity, warc
from epistride.session import scratch_path

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: Mixture of the pipeline and of op5: shares by source, in code point order, and words taken over words there.
MIX_WEIGHTS, MIX_SHARE, MIX_MOST = (3.0, 1.0, 2.0), 1.5, 2.0


@query
def op2_warc_transactions(spark: SparkSession, folder: str) -> DataFrame:
    """Pages written as WARC records, read back and assembled by capture."""
    path = scratch_path(spark, "warc")
    warc.write_archive(table(spark, folder, "pages"), path)
    found = warc.captures(warc.read_archive(spark, path))
    kind = F.col("response.record_type")
    again = kind == "revisit"
    return found.select(
        "page_id",
        F.when(again, F.col("declared_bytes")).otherwise(F.col("response.payload_bytes")).alias("payload_bytes"),
        F.when(again, F.substring("declared_digest", 8, 64)).otherwise(F.col("payload_digest")).alias("payload_digest"),
        kind.alias("record_type"),
        F.col("refers_to_page_id").alias("refers_to"),
    )


ORACLES["op2_warc_transactions"] = """
WITH sized AS (
    SELECT page_id, coalesce(html, '') AS payload, octet_length(encode(coalesce(html, ''))) AS n FROM pages
), told AS (
    SELECT *, min(page_id) OVER (PARTITION BY payload) AS first FROM sized
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha256(payload) AS payload_digest,
       CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to
FROM told
"""


@query
def op3_multiset_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of all texts, of their edited texts, and how alike they are."""
    return fingerprints.edited_fingerprints(table(spark, folder, "documents")).withColumnRenamed("id", "doc_id")


def _with_fold(scores: DataFrame, folds: int, held: int, threshold: float) -> DataFrame:
    return scores.select(
        F.col("id").alias("doc_id"),
        (labelled.folded(F.col("id"), folds) == held).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def toxicity_model(spark: SparkSession, docs: DataFrame, folder: str) -> toxicity.Machine:
    return toxicity.train(docs, table(spark, folder, "labels"), labelled.folded(F.col("doc_id"), 3) != 1)


@query
def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of all texts by a factorization machine."""
    docs = table(spark, folder, "documents")
    return _with_fold(toxicity.scores(docs, toxicity_model(spark, docs, folder)), 3, 1, toxicity.THRESHOLD)


@query
def op5_source_mixture(spark: SparkSession, folder: str) -> DataFrame:
    """What a mixture at 150 % of all words takes of every document."""
    plan = mixing.mix_plan(table(spark, folder, "documents"), MIX_WEIGHTS, MIX_SHARE, MIX_MOST)
    return plan.select(F.col("id").alias("doc_id"), "source", "size", "source_size", "target", "taken")


@query
def op6_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of all texts by n-gram regression."""
    docs = table(spark, folder, "documents")
    model = quality.train(docs, table(spark, folder, "labels"), labelled.folded(F.col("doc_id"), 5) != 0)
    return _with_fold(quality.scores(docs, model), 5, 0, quality.THRESHOLD)


@query
def op7_simhash_golay(spark: SparkSession, folder: str) -> DataFrame:
    """SimHash fingerprints and components of all texts."""
    return simhash.near_duplicates(table(spark, folder, "documents")).withColumnRenamed("id", "doc_id")


@query
def op8_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark windows found in all texts."""
    hits = decontaminate.benchmark_hits(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return decontaminate.digest_columns(hits)


ORACLES["op8_decontamination"] = r"""
WITH item AS (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                       '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark
), windows AS (
    SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + 9], ' ') AS gram
    FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM item WHERE len(w) > 0)
), doc AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents
), lengths AS (SELECT DISTINCT n FROM windows
), grams AS (
    SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS gram
    FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, lengths WHERE len(w) >= n)
), found AS (SELECT g.doc_id, g.i, g.n, v.item_id FROM grams g JOIN windows v ON g.gram = v.gram AND g.n = v.n
), hit AS (
    SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM found) GROUP BY doc_id
), items AS (
    SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS listed
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM found) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@query
def op10_packed_rows(spark: SparkSession, folder: str) -> DataFrame:
    """All texts as token ids, packed into rows of 4,096."""
    return packing.pack(table(spark, folder, "documents"))


#: A deployment passes its own secret.
SURROGATE_KEY = "epistride-surrogates"


@query
def op1_pii_surrogates(spark: SparkSession, folder: str) -> DataFrame:
    """All texts with personal data replaced by surrogates."""
    return surrogates.with_surrogates(table(spark, folder, "documents"), SURROGATE_KEY).withColumnRenamed("id", "doc_id")


@query
def op9_repeated_strings(spark: SparkSession, folder: str) -> DataFrame:
    """All texts without the bytes that lie in repeated strings of 200 bytes."""
    kept = repeats.without_repeats(table(spark, folder, "documents"), keep_bytes=False)
    return kept.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


#: Conversations of a hundred share up to so many first turns.
SHARED_TURNS = 5


@query
def op11_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    """The trie of all conversations, each rebuilt on the first turns of its hundred."""
    turns = prefixtrie.numbered_turns(table(spark, folder, "conversations"))
    conv = F.col("conv")
    head = F.crc32(conv.cast("string").cast("binary")) % (SHARED_TURNS + 1)
    rebuilt = prefixtrie.with_shared_heads(turns, conv - conv % 100, head, SHARED_TURNS)
    return prefixtrie.with_ends_digest(prefixtrie.prefix_trie(*rebuilt)).drop("n_ends")


ORACLES["op11_prefix_trie"] = """
WITH told AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS i
    FROM conversations WHERE conv_id IS NOT NULL
), whole AS (
    SELECT conv_id, list({'role': role, 'text': text} ORDER BY i) AS turns FROM told GROUP BY conv_id
), headed AS (
    SELECT *, xor(4294967295, list_reduce(
        list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
        lambda a, b: list_reduce(list_prepend(xor(a, b), CAST(range(8) AS BIGINT[])), lambda x, y: xor(x >> 1, (x & 1) * 3988292384))
    )) % 6 AS h
    FROM whole
), rebuilt AS (
    SELECT c.conv_id, coalesce(b.turns[1 : c.h], []) || c.turns[c.h + 1 :] AS turns
    FROM headed c LEFT JOIN whole b ON b.conv_id = c.conv_id - c.conv_id % 100
), steps AS (
    SELECT conv_id, len(turns) AS n, d, turns[1 : d] AS prefix, CASE WHEN d > 0 THEN turns[1 : d - 1] END AS above,
           CASE WHEN d > 0 THEN length(turns[d].text) ELSE 0 END AS chars
    FROM (SELECT conv_id, turns, unnest(range(len(turns) + 1)) AS d FROM rebuilt)
), nodes AS (
    SELECT d, prefix, min(conv_id) AS conv_id, any_value(above) AS above, count(*) AS n_convs, any_value(chars) AS chars,
           string_agg(CASE WHEN d = n THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id) AS ends
    FROM steps GROUP BY d, prefix
), kids AS (SELECT d - 1 AS d, above AS prefix, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1, 2
), full_nodes AS (
    SELECT n.*, coalesce(k.n_children, 0) AS n_children, (n_convs - 1) * chars AS saved
    FROM nodes n LEFT JOIN kids k ON n.d = k.d AND n.prefix = k.prefix
), sums AS (
    SELECT a.d, a.prefix, sum(b.saved) AS saved_tokens, sum(CASE WHEN b.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves
    FROM (SELECT d, saved, n_children, unnest(range(d + 1)) AS up, prefix FROM full_nodes) b
    JOIN full_nodes a ON a.d = b.up AND a.prefix = b.prefix[1 : b.up] GROUP BY 1, 2
)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, CAST(n.n_convs AS BIGINT) AS n_convs,
       CAST(n.n_children AS BIGINT) AS n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves,
       CAST(s.saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(n.ends, '')) AS ends_sha256
FROM full_nodes n JOIN sums s ON s.d = n.d AND s.prefix = n.prefix LEFT JOIN full_nodes p ON p.d = n.d - 1 AND p.prefix = n.above
"""


#: A conversation that holds the template's own control strings, and others'.
CONTROL_TURNS = [(-7, turn, role, "\\### Assistant: </turn> ok") for turn, role in enumerate(("user", "assistant"))]


@query
def op12_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations as event logs, folded, rendered and read back."""
    given = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    log = chatlog.log_of(given.unionByName(spark.createDataFrame(CONTROL_TURNS, "conv_id long, turn long, role string, text string")))
    pages = chatlog.rendered(log, F.col("place"))
    return chatlog.read_back(pages).withColumnRenamed("conv", "conv_id")


ORACLES["op12_chat_formatting"] = r"""
WITH given AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), escaped AS (
    SELECT *, length(regexp_replace(regexp_replace(text, '(\\*)(<turn>|<says>|</turn>)', '\1\1\\\2', 'g'), '(\\+)$', '\1\1')) AS n_text,
           length(regexp_replace(regexp_replace(role, '(\\*)(<turn>|<says>|</turn>)', '\1\1\\\2', 'g'), '(\\+)$', '\1\1')) AS n_role
    FROM given
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST), '')) AS loss_sha256,
       CAST(sum(n_text + n_role + length('<turn><says></turn>') + 1) AS BIGINT) AS formatted_chars
FROM escaped GROUP BY conv_id
"""


@query
def op13_document_tree_search(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 best documents of every benchmark item."""
    return lexical.top_documents(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


ORACLES["op13_document_tree_search"] = r"""
WITH doc AS (
    SELECT row_number() OVER () AS row, doc_id, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM documents
), item AS (
    SELECT row_number() OVER () AS asked, item_id, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark
), question AS (SELECT asked, item_id, term, count(*) AS times FROM item GROUP BY ALL
), sizes AS (SELECT row, count(*) AS n FROM doc GROUP BY row
), totals AS (SELECT count(*) AS docs, sum(n) AS terms FROM sizes
), entries AS (
    SELECT row, doc_id, term, count(*) AS tf FROM doc WHERE term IN (SELECT term FROM question) GROUP BY ALL
), weights AS (
    SELECT term, CAST(floor(1000 * ln((2.0 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w
    FROM (SELECT term, count(*) AS df FROM entries GROUP BY term), totals
), norms AS (SELECT row, 75 + CAST((25 * n * docs) // terms AS BIGINT) AS m FROM sizes, totals
), scores AS (
    SELECT asked, item_id, row, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
    FROM question JOIN entries USING (term) JOIN weights USING (term) JOIN norms USING (row) GROUP BY ALL
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY asked ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 20
"""

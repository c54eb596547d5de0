"""Queries of a host's questions about sessions, and of scores around a model."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorekeep.operators import sentiment, session, snapshot
from lorekeep.plans.registry import query
from lorekeep.plans.sessions import CALLS, EV, OPENS, TURNED, lines, log
from lorekeep.sources.sessions import events, invalid_files
from lorekeep.tables import table


@query(f"WITH {TURNED} SELECT path, count(*) AS event_count, max(turn) - min(turn) + 1 AS turn_count, count(*) FILTER (WHERE kind = 'user') AS user_messages, count(*) FILTER (WHERE kind = 'assistant') AS assistant_messages, count(*) FILTER (WHERE {OPENS}) AS prompts, arg_max(text, idx) FILTER (WHERE {OPENS}) AS last_prompt, md5(coalesce(string_agg(text, chr(10) ORDER BY idx) FILTER (WHERE kind IN ('user', 'assistant') AND trim(text) <> ''), '')) AS workflow FROM tu GROUP BY path")
def session_facts(spark, d):
    """Counts, prompts and the whole text of each session in one pass over its events."""
    e = snapshot.event_facts(log(spark, d))
    return e.select("path", "event_count", "turn_count", "user_messages", "assistant_messages", F.size("prompts").cast("long").alias("prompts"), "last_prompt", F.md5("workflow_text").alias("workflow"))


@query(f"""WITH {CALLS} SELECT path, bool_or(NOT is_error AND name = 'Edit') AS has_edit, bool_or(is_error) AS has_error, count(*) FILTER (WHERE is_error) AS failures, count(*) FILTER (WHERE NOT is_error AND pending AND name = 'Bash') AS unresolved,
count(file_path) FILTER (WHERE NOT is_error) AS files, bool_or(NOT is_error AND name = 'Bash') AS runs_git, bool_or(NOT is_error AND name = 'Edit' AND conv_id % 7 <> 3) AS source FROM cr GROUP BY path""")
def call_facts(spark, d):
    """What a host asks of a session's calls, in one pass over them."""
    tests = {"runs_git": snapshot.runs("git", "status"), "source": snapshot.is_source("/repo", prefixes=("src/m3",)) & session.named("Edit|Write")}
    c = snapshot.call_facts(session.calls(log(spark, d)), tests, pending="Bash")
    return c.select("path", "has_edit", "has_error", "failures", "unresolved", F.size("files").cast("long").alias("files"), "runs_git", "source")


@query(f"WITH {TURNED}, r AS (SELECT path, idx, md5(text) AS text, row_number() OVER (PARTITION BY path ORDER BY idx DESC) AS r FROM tu WHERE kind IN ('user', 'assistant') AND trim(text) <> '') SELECT path, idx, text FROM r WHERE r <= 3")
def signal_texts(spark, d):
    """The three newest texts of each session."""
    return snapshot.signal_texts(log(spark, d), 3, "any").select("path", "idx", F.md5("text").alias("text"))


@query(f"WITH {CALLS} SELECT path, call_id AS key, name, row_number() OVER (PARTITION BY path ORDER BY idx) - 1 AS first, idx FROM ca")
def call_winners(spark, d):
    return snapshot.winners(session.calls(log(spark, d))).select("path", "key", "name", "first", "idx")


@query("""WITH c AS (SELECT conv_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w, regexp_matches(text, '(?i)\\b(la|the)\\b') AS early, len(list_filter(string_split_regex(text, '[ \\t\\n\\r]+'), lambda x: x <> '')) AS n FROM conversations WHERE role = 'user' AND text IS NOT NULL),
b AS (SELECT conv_id, bool_or(early) AS early, bool_or(n <= 12 AND NOT list_has_any(w, ['le', 'der', 'de'])) AS plain FROM c GROUP BY conv_id)
SELECT conv_id AS key, CASE WHEN early THEN 1 WHEN conv_id % 2 = 0 AND plain THEN 3 WHEN conv_id % 2 = 0 THEN 5 ELSE 2 END::INT AS score FROM b""")
def bucket_scores(spark, d):
    """Conversations scored by a stand-in for a model, with a stage before and one behind it."""
    texts = table(spark, d, "conversations").where("role = 'user' and text is not null").groupBy(F.col("conv_id").alias("key")).agg(F.array_sort(F.collect_list("text")).alias("texts"))
    words = sentiment.polarities(spark.createDataFrame([("le", 3), ("der", 4), ("de", 3), ("und", 1), ("les", -3)], "word string, score int"))
    stages = [sentiment.Frustration(r"(?i)\b(la|the)\b", 1), sentiment.PositiveClamp(5, 3, 12)]
    return sentiment.scored(texts, words, F.when(F.col("key") % 2 == 0, 5).otherwise(2), stages).select("key", "score")


def broken_lines(spark, d):
    """The conversations' transcripts with further lines: no id (every seventh file), no JSON and no object (every fifth), an unknown kind, repeated keys."""
    base = lines(spark, d)
    conv = F.substring("path", 2, 20).cast("long")
    files = base.select("path", conv.alias("c")).distinct()
    more = [(1000, '{"type":"user","sessionId":"s","timestamp":"2024-01-01T00:00:00Z","message":{"content":"x"}}', F.col("c") % 7 == 0), (1001, "{broken", F.col("c") % 5 == 1), (1002, "[1]", F.col("c") % 5 == 1), (1003, "  ", F.lit(True)), (1004, '{"type":"odd","k":[1]}', F.col("c") % 11 == 2), (1005, '{"type":"mode","mode":"a","mode":"plan"}', F.col("c") % 3 == 0)]
    out = base
    for idx, line, when in more:
        out = out.unionByName(files.where(when).select("path", F.lit(idx).alias("idx"), F.lit(line).alias("line")))
    return out


@query(f"WITH {EV} SELECT path, kind, count(*) AS n FROM (SELECT path, kind FROM ev WHERE conv_id % 7 <> 0 UNION ALL SELECT DISTINCT path, 'other' FROM ev WHERE conv_id % 7 <> 0 AND conv_id % 11 = 2 UNION ALL SELECT DISTINCT path, 'mode' FROM ev WHERE conv_id % 7 <> 0 AND conv_id % 3 = 0) GROUP BY ALL")
def broken_files(spark, d):
    """Lines that are no object are skipped, unknown kinds stay, and a record without an id takes its whole file away."""
    return events(broken_lines(spark, d)).groupBy("path", "kind").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {EV} SELECT DISTINCT path, 1000 AS idx, 'no uuid, session or time' AS problem FROM ev WHERE conv_id % 7 = 0")
def named_invalid_files(spark, d):
    return invalid_files(broken_lines(spark, d))

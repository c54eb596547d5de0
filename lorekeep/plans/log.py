"""Statistics, filters, turns and windows over an ordered conversation log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorekeep.functions.text import whole_words
from lorekeep.operators import turns
from lorekeep.operators.filters import Clause, keep, labelled
from lorekeep.plans.registry import query
from lorekeep.tables import table

LONG = [Clause("min_words", 12), Clause("role", ("user", "assistant"))]


def conversations(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations")


@query("SELECT role, count(*) AS n, sum(length(text))::BIGINT AS chars, sum(strlen(text))::BIGINT AS bytes, count(DISTINCT conv_id) AS sessions FROM conversations GROUP BY role")
def stats_kinds(spark, d):
    return conversations(spark, d).groupBy("role").agg(F.count("*").alias("n"), F.sum(F.char_length("text")).alias("chars"), F.sum(F.octet_length("text")).alias("bytes"), F.countDistinct("conv_id").alias("sessions"))


@query("SELECT count(*) AS n, count(DISTINCT conv_id) AS sessions, count(*) FILTER (WHERE role = 'user') AS user_turns FROM conversations")
def stats_totals(spark, d):
    return conversations(spark, d).agg(F.count("*").alias("n"), F.countDistinct("conv_id").alias("sessions"), F.count(F.when(F.col("role") == "user", 1)).alias("user_turns"))


@query("SELECT w AS word, count(*) AS n FROM (SELECT unnest(string_split_regex(lower(text), '[^a-z]+')) AS w FROM conversations) WHERE w <> '' GROUP BY w ORDER BY n DESC, word LIMIT 25")
def most_common_words(spark, d):
    words = conversations(spark, d).select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("word")).where("word != ''")
    return words.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(25)


@query("SELECT conv_id, turn, role FROM conversations WHERE role IN ('user','assistant') AND len(list_filter(string_split_regex(text, '[ \\t\\n\\r]+'), lambda x: x <> '')) >= 12")
def filter_keep(spark, d):
    return keep(conversations(spark, d), LONG).select("conv_id", "turn", "role")


@query("SELECT conv_id, turn, role FROM conversations WHERE NOT coalesce(regexp_matches(text, '(?i)\\b(the|and)\\b'), false)")
def filter_negate(spark, d):
    return keep(conversations(spark, d), [Clause("matches", whole_words("the", "and"), negate=True)]).select("conv_id", "turn", "role")


@query("SELECT conv_id, turn, concat_ws(',', CASE WHEN length(text) < 80 THEN 'short' END, CASE WHEN contains(text, '?') THEN 'question' END, CASE WHEN role = 'user' THEN 'human' END) AS labels FROM conversations")
def filter_labels(spark, d):
    return labelled(conversations(spark, d), {"short": [Clause("max_chars", 79)], "question": [Clause("contains", "?")], "human": [Clause("role", ("user",))]}).select("conv_id", "turn", F.concat_ws(",", "labels").alias("labels"))


@query("SELECT conv_id, turn FROM conversations WHERE text IS NULL OR trim(text) = ''")
def filter_empty(spark, d):
    return keep(conversations(spark, d), [Clause("empty", True)]).select("conv_id", "turn")


_SEGMENTS = "(SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS segment FROM conversations)"


@query(f"SELECT conv_id, turn, segment::BIGINT AS segment FROM {_SEGMENTS}")
def turn_segments(spark, d):
    return turns.segments(conversations(spark, d), "conv_id", "turn", F.col("role") == "user").select("conv_id", "turn", "segment")


@query(f"SELECT conv_id, segment::BIGINT AS segment, min(turn) AS first_turn, max(turn) AS last_turn, count(*) AS n, sum(length(text))::BIGINT AS chars FROM {_SEGMENTS} GROUP BY ALL")
def turn_spans(spark, d):
    seg = turns.segments(conversations(spark, d), "conv_id", "turn", F.col("role") == "user")
    return seg.groupBy("conv_id", "segment").agg(F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.count("*").alias("n"), F.sum(F.char_length("text")).alias("chars"))


@query(f"SELECT conv_id, max(segment)::BIGINT AS segment, arg_max(text, turn) AS text FROM {_SEGMENTS} GROUP BY conv_id")
def current_turn(spark, d):
    seg = turns.segments(conversations(spark, d), "conv_id", "turn", F.col("role") == "user")
    return seg.groupBy("conv_id").agg(F.max("segment").alias("segment"), F.max_by("text", "turn").alias("text"))


@query("SELECT conv_id, arg_min(text, turn) FILTER (WHERE role = 'user') AS prompt, arg_max(text, turn) FILTER (WHERE role = 'assistant') AS answer FROM conversations GROUP BY conv_id")
def first_prompt_last_answer(spark, d):
    when = lambda r: F.when(F.col("role") == r, F.col("turn"))
    return conversations(spark, d).groupBy("conv_id").agg(F.min_by("text", when("user")).alias("prompt"), F.max_by("text", when("assistant")).alias("answer"))


@query("SELECT conv_id, turn, max(CASE WHEN role='assistant' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS nearest FROM conversations QUALIFY role = 'user'")
def nearest_assistant(spark, d):
    return turns.previous_where(conversations(spark, d), "conv_id", "turn", F.col("role") == "assistant", "nearest").where("role = 'user'").select("conv_id", "turn", "nearest")


@query("SELECT conv_id, turn, min(CASE WHEN role='user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_user FROM conversations")
def next_user_message(spark, d):
    return turns.next_where(conversations(spark, d), "conv_id", "turn", F.col("role") == "user", "next_user").select("conv_id", "turn", "next_user")


@query("SELECT c.conv_id, c.turn, n.turn AS near_turn FROM conversations c JOIN conversations n ON c.conv_id = n.conv_id AND n.turn BETWEEN c.turn - 2 AND c.turn + 1 AND n.turn <> c.turn WHERE regexp_matches(c.text, '(?i)\\bthe\\b')")
def context_window(spark, d):
    log = conversations(spark, d)
    return turns.around(log, log.where(F.col("text").rlike(whole_words("the"))), "conv_id", "turn", 2, 1).select("conv_id", "turn", "near_turn")


@query("SELECT conv_id, turn FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3")
def window_recent(spark, d):
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return conversations(spark, d).withColumn("r", F.row_number().over(w)).where("r <= 3").select("conv_id", "turn")

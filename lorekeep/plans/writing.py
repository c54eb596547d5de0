"""Queries over edits of files and over what a log is made of, made of the driver's conversations by stated rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.operators import edits, session, stats
from lorekeep.plans.registry import query
from lorekeep.plans.sessions import CALLS, EV, START, lines
from lorekeep.sources.sessions import events
from lorekeep.tables import table


def edit_lines(spark: SparkSession, d: str) -> DataFrame:
    """path, idx, line: every assistant's turn t edits f0.py or f1.py, which takes back what turn t - 2 wrote; t = 3, 7, ... patches both.

    Even conversations name files by their folder, which for every third is a worktree. Turn 1 runs a command, too.
    """
    c = table(spark, d, "conversations").where("text is not null and role in ('user', 'assistant')")
    conv, turn = F.col("conv_id").cast("string"), F.col("turn").cast("string")
    cwd = F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit("/repo/.claude/worktrees/w"), (F.col("conv_id") % 2).cast("string"))).otherwise("/repo")
    head = [F.concat(F.lit("w"), conv, F.lit("-"), turn).alias("uuid"), F.concat(F.lit("s"), conv).alias("sessionId"), F.date_format(F.timestamp_seconds(F.lit(START) + F.col("conv_id") * 3600 + F.col("turn") * 50), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), cwd.alias("cwd")]
    folder = F.when(F.col("conv_id") % 2 == 0, "").otherwise("/repo/")
    file = F.concat(folder, F.lit("f"), (F.floor(F.col("turn") / 2) % 2).cast("string"), F.lit(".py"))
    old = F.concat(F.lit("L"), (F.col("turn") - 2).cast("string"), F.lit("\nS"))
    plain = F.struct(F.lit("tool_use").alias("type"), F.concat(F.lit("e"), turn).alias("id"), F.lit("Edit").alias("name"), F.struct(file.alias("file_path"), old.alias("old_string"), F.concat(F.lit("L"), turn, F.lit("\nS")).alias("new_string")).alias("input"))
    part = lambda n: F.concat(F.lit("*** Update File: "), folder, F.lit(f"f{n}.py\n@@\n-S\n+P"), turn, F.lit("\n"))
    patch = F.struct(F.lit("tool_use").alias("type"), F.concat(F.lit("e"), turn).alias("id"), F.lit("apply_patch").alias("name"), F.concat(F.lit("*** Begin Patch\n"), part(0), part(1), F.lit("*** End Patch\n")).alias("input"))
    run = F.struct(F.lit("tool_use").alias("type"), F.lit("r").alias("id"), F.lit("Bash").alias("name"), F.struct(F.concat(F.lit("make "), conv).alias("command")).alias("input"))
    person = F.to_json(F.struct(F.lit("user").alias("type"), *head, F.struct(F.col("text").alias("content")).alias("message")))
    frame = F.to_json(F.struct(F.lit("assistant").alias("type"), *head, F.struct(F.lit("m").alias("model"), F.lit("<<blocks>>").alias("content")).alias("message")))
    blocks = lambda *b: F.replace(frame, F.lit('"<<blocks>>"'), F.concat(F.lit("["), F.concat_ws(",", *[F.to_json(x) for x in b]), F.lit("]")))
    line = F.when(F.col("role") == "user", person).when(F.col("turn") % 4 == 3, blocks(patch)).when(F.col("turn") == 1, blocks(plain, run)).otherwise(blocks(plain))
    return c.select(F.concat(F.lit("w"), conv).alias("path"), F.col("turn").alias("idx"), line.alias("line"))


def edit_log(spark: SparkSession, d: str) -> DataFrame:
    return session.with_turns(events(edit_lines(spark, d)))


_EDITS = """c AS (SELECT conv_id, turn AS t, role, text FROM conversations WHERE text IS NOT NULL AND role IN ('user', 'assistant')),
n AS (SELECT *, sum((role = 'user' AND trim(text) <> '')::INT) OVER w - first_value((role = 'user' AND trim(text) <> '')::INT) OVER w AS turn FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY t ROWS UNBOUNDED PRECEDING)),
e AS (SELECT conv_id, t, turn, 0 AS nth, CASE WHEN t % 4 = 3 THEN 0 ELSE t // 2 % 2 END AS f, t % 4 = 3 AS patch FROM n WHERE role = 'assistant' UNION ALL SELECT conv_id, t, turn, 1, 1, true FROM n WHERE role = 'assistant' AND t % 4 = 3)"""
_OVERLAP = "CASE WHEN a.patch THEN 0 WHEN b.patch THEN 0.5 WHEN b.t - 2 = a.t THEN 1 ELSE 0.5 END"


@query(f"WITH {_EDITS} SELECT 'w' || conv_id AS path, t AS idx, nth, CASE WHEN conv_id % 2 = 0 THEN '' ELSE '/repo/' END || 'f' || f || '.py' AS file_path, CASE WHEN patch THEN 'update' END AS kind, CASE WHEN patch THEN 'S' ELSE 'L' || (t - 2) || chr(10) || 'S' END AS old FROM e")
def patch_edits(spark, d):
    """Every edit, and each file of every patch envelope."""
    return edits.edits(edit_log(spark, d)).select("path", "idx", "nth", "file_path", "kind", F.col("hunks")[0]["old"].alias("old"))


@query(f"WITH {_EDITS}, m AS (SELECT a.conv_id, a.t, a.nth, b.t AS c_idx, b.nth AS c_nth, {_OVERLAP} AS overlap FROM e a JOIN e b ON b.conv_id = a.conv_id AND b.f = a.f AND b.t > a.t AND b.turn - a.turn <= 3) SELECT 'w' || conv_id AS path, t AS idx, nth, c_idx, c_nth, overlap::DOUBLE AS overlap, row_number() OVER (PARTITION BY conv_id, t, nth ORDER BY overlap DESC, c_idx, c_nth) AS rank FROM m WHERE overlap > 0")
def edit_corrections(spark, d):
    """Later edits of a file that take back what an edit wrote, the closest first."""
    return edits.corrections(edits.edits(edit_log(spark, d)), 3).select("path", "idx", "nth", "c_idx", "c_nth", "overlap", "rank")


_WROTE = f"""w AS (SELECT 'f' || f || '.py' AS rel, 'w' || conv_id AS path, CASE WHEN conv_id % 2 = 0 AND conv_id % 3 = 0 THEN 'worktree:w0' ELSE 'main' END AS tree, t, patch, {START} + conv_id * 3600 + t * 50 AS sec, 's' || conv_id AS session_id FROM e),
g AS (SELECT rel, path, tree, session_id, max(sec) AS last, count(*) AS writes, min(t) FILTER (WHERE patch) AS p, min(t) FILTER (WHERE NOT patch) AS q FROM w GROUP BY ALL)"""


@query(f"WITH {_EDITS}, {_WROTE} SELECT rel, path, tree, last AS last_sec, writes, CASE WHEN p IS NULL THEN 'Edit' WHEN q IS NULL THEN 'apply_patch' WHEN p < q THEN 'apply_patch,Edit' ELSE 'Edit,apply_patch' END AS tools, row_number() OVER (PARTITION BY rel ORDER BY last DESC, session_id) AS place FROM g")
def file_writes(spark, d):
    """Who wrote each file of a repository and its worktrees, the newest first."""
    t = edit_log(spark, d)
    w = edits.writes(edits.edits(t), t, "/repo")
    return w.select("rel", "path", "tree", F.unix_seconds("last_ts").alias("last_sec"), "writes", F.array_join("tools", ",").alias("tools"), "place")


@query(f"""WITH {_EDITS}, {_WROTE}, k AS (SELECT 'f' || n_nationkey || '.py' AS rel, {START} + n_nationkey * 3600 + 60 AS mtime, n_nationkey AS k FROM nation),
b AS (SELECT conv_id, {START} + conv_id * 3600 + min(t) * 50 AS begin, {START} + conv_id * 3600 + max(t) * 50 AS fin, bool_or(t = 1 AND role = 'assistant') AS ran FROM c GROUP BY conv_id)
SELECT k.rel, CASE WHEN x.rel IS NOT NULL THEN 'written' WHEN b.conv_id IS NOT NULL THEN 'generated' ELSE 'external' END AS verdict, x.session_id, CASE WHEN x.rel IS NULL AND b.conv_id IS NOT NULL THEN 's' || b.conv_id || ':make ' || b.conv_id ELSE '' END AS suspects
FROM k LEFT JOIN (SELECT rel, arg_min(session_id, (-last, session_id)) AS session_id FROM g GROUP BY rel) x ON x.rel = k.rel LEFT JOIN b ON b.ran AND k.mtime BETWEEN b.begin AND b.fin""")
def attribute_files(spark, d):
    """Files by who wrote them last, or who was running commands when they changed."""
    t = edit_log(spark, d)
    n = table(spark, d, "nation")
    files = n.select(F.concat(F.lit("f"), F.col("n_nationkey").cast("string"), F.lit(".py")).alias("rel"), F.timestamp_seconds(F.lit(START) + F.col("n_nationkey") * 3600 + 60).alias("mtime"))
    a = edits.attribute(files, edits.edits(t), t, "/repo")
    shown = F.array_join(F.transform("candidates", lambda c: F.concat(c.session_id, F.lit(":"), F.array_join(c.commands, "+"))), ",")
    return a.select("rel", "verdict", "session_id", shown.alias("suspects"))


@query(f"""WITH {CALLS} SELECT count(DISTINCT path) AS files, count(*) AS events, count(DISTINCT path) AS sessions, sum(CASE WHEN kind IN ('user', 'assistant') THEN length(text) ELSE 0 END)::BIGINT AS text_chars, count(*) FILTER (WHERE has_result AND conv_id % 5 = 0) AS tool_errors, (min(sec) + {START})::BIGINT AS first_sec, (max(sec) + {START})::BIGINT AS last_sec FROM ev""")
def log_totals(spark, d):
    t = stats.totals(events(lines(spark, d)))
    return t.select("files", "events", "sessions", "text_chars", "tool_errors", F.unix_seconds("first_ts").alias("first_sec"), F.unix_seconds("last_ts").alias("last_sec"))


@query(f"""WITH {CALLS}, x AS (SELECT 'kind' AS what, kind AS name, path, idx FROM ev UNION ALL SELECT 'model', CASE WHEN conv_id % 3 = 0 THEN 'big-opus-1' ELSE 'a-sonnet-2' END, path, idx FROM ev WHERE kind = 'assistant' UNION ALL SELECT 'tool', name, path, idx FROM ca UNION ALL SELECT 'tool_error', name, path, result_idx FROM cr WHERE is_error),
g AS (SELECT what, name, count(*) AS n, min((path, idx)) AS first FROM x GROUP BY ALL) SELECT what, name, n, row_number() OVER (PARTITION BY what ORDER BY n DESC, first) AS place FROM g""")
def log_histograms(spark, d):
    """Kinds, models, tools and errors by tool; ties by who was seen first."""
    return stats.histograms(events(lines(spark, d)))


@query(f"WITH {EV}, r AS (SELECT path, idx, row_number() OVER (PARTITION BY path ORDER BY idx DESC) AS r, count(*) OVER (PARTITION BY path) AS n FROM ev) SELECT path, idx, greatest(n - 3, 0) AS hidden FROM r WHERE r <= 3")
def newest_events(spark, d):
    """The three newest events of each session, and how many are not shown."""
    return stats.page(events(lines(spark, d)).select("path", "idx"), ["idx"], cap=3)

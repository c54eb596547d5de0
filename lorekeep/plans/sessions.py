"""Queries over transcripts. The driver's conversations are first written as transcript lines and read by the parser.

A line's place, kind, text, time, calls and results follow from (conv_id, turn, role, text) by the rules below, which
the SQL equivalents state once more, in `EV` (events), `CALLS` and `RESULTS`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.functions import markers, scalars
from lorekeep.operators import deep, mining, session, spec
from lorekeep.plans.registry import query
from lorekeep.sources.sessions import events
from lorekeep.tables import table

START = 1_704_067_200  # 2024-01-01 in seconds
TOOLS = ("Edit", "Bash", "Read", "mcp__db__list_rows")


def lines(spark: SparkSession, d: str) -> DataFrame:
    """path, idx, line: each conversation as a transcript.

    Every third assistant turn calls a tool, and a user turn of an even conversation holds the result of the turn before.
    """
    c = table(spark, d, "conversations").where("text is not null")
    turn, conv = F.col("turn"), F.col("conv_id").cast("string")
    pick = F.array(*[F.lit(t) for t in TOOLS])[(turn % 4).cast("int")]
    file = F.concat(F.lit("/repo/src/m"), (F.col("conv_id") % 7).cast("string"), F.when(turn % 2 == 0, ".py").otherwise(".md"))
    text = F.struct(F.lit("text").alias("type"), "text")
    call = F.struct(F.lit("tool_use").alias("type"), F.concat(F.lit("t"), conv, F.lit("-"), turn).alias("id"), pick.alias("name"), F.struct(F.when(pick.isin("Edit", "Read"), file).alias("file_path"), F.when(pick == "Edit", F.lit("a\n b\nc")).alias("old_string"), F.when(pick == "Edit", F.lit("a\nb \nd")).alias("new_string"), F.when(pick == "Bash", F.concat(F.lit("git status "), conv)).alias("command")).alias("input"))
    denied = F.concat(F.lit(markers.DENIAL + ". " + markers.USER_SAID), F.lit("not "), conv, F.lit("\n" + markers.USER_SAID_END))
    result = F.struct(F.lit("tool_result").alias("type"), F.concat(F.lit("t"), conv, F.lit("-"), turn - 1).alias("tool_use_id"), F.when(F.col("conv_id") % 10 == 0, denied).otherwise("done").alias("content"), (F.col("conv_id") % 5 == 0).alias("is_error"))
    blocks = F.when((F.col("role") == "assistant") & (turn % 3 == 1), F.to_json(F.array(F.to_json(text), F.to_json(call)))).when(F.col("role") == "assistant", F.to_json(F.array(F.to_json(text)))).when(F.col("conv_id") % 2 == 0, F.to_json(F.array(F.to_json(text), F.to_json(result))))
    # the blocks are JSON already: they are put where a marker stands
    usage = F.struct(F.char_length("text").alias("input_tokens"), (turn * 10).alias("output_tokens"), F.lit(5).alias("cache_read_input_tokens"), F.lit(0).alias("cache_creation_input_tokens"))
    body = F.struct(
        F.col("role").alias("type"), F.concat_ws("-", F.lit("e"), conv, turn).alias("uuid"), F.concat(F.lit("s"), conv).alias("sessionId"),
        F.date_format(F.timestamp_seconds(F.lit(START) + F.col("conv_id") * 3600 + turn * 50), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"),
        (turn % 11 == 5).alias("isMeta"), F.lit("").alias("version"), F.when(F.col("role") == "system", F.col("text")).alias("content"), F.when(F.col("role") == "system", "note").alias("subtype"),
        F.when(F.col("role") != "system", F.struct("role", F.when(F.col("role") == "assistant", F.when(F.col("conv_id") % 3 == 0, "big-opus-1").otherwise("a-sonnet-2")).alias("model"), F.when(F.col("role") == "assistant", usage).alias("usage"), F.when(blocks.isNull(), F.col("text")).otherwise("<<blocks>>").alias("content"))).alias("message"),
    )
    own = F.when((F.col("role") == "assistant") & (turn % 3 == 1), F.concat_ws(",", F.to_json(text), F.to_json(call))).when((F.col("role") == "user") & (F.col("conv_id") % 2 == 0), F.concat_ws(",", F.to_json(text), F.to_json(result))).otherwise(F.to_json(text))
    line = F.when(blocks.isNotNull(), F.replace(F.to_json(body), F.lit('"<<blocks>>"'), F.concat(F.lit("["), own, F.lit("]")))).otherwise(F.to_json(body))
    return c.select(F.concat(F.lit("c"), conv).alias("path"), turn.alias("idx"), line.alias("line"))


def log(spark: SparkSession, d: str) -> DataFrame:
    return session.with_turns(events(lines(spark, d)))


EV = """ev AS (SELECT 'c' || conv_id AS path, conv_id, turn AS idx, role AS kind, text, turn % 11 = 5 AS is_meta, 'e-' || conv_id || '-' || turn AS uuid, conv_id * 3600 + turn * 50 AS sec,
 role = 'assistant' AND turn % 3 = 1 AS has_call, role = 'user' AND conv_id % 2 = 0 AS has_result FROM conversations WHERE text IS NOT NULL)"""
OPENS = "kind = 'user' AND NOT is_meta AND trim(text) <> ''"
TURNED = f"""{EV}, tu AS (SELECT *, (sum(CASE WHEN {OPENS} THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY idx ROWS UNBOUNDED PRECEDING)
 - first_value(CASE WHEN {OPENS} THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY idx))::BIGINT AS turn FROM ev)"""
CALLS = f"""{TURNED}, ca AS (SELECT path, conv_id, turn, idx, sec, 't' || conv_id || '-' || idx AS call_id, CASE idx % 4 WHEN 0 THEN 'Edit' WHEN 1 THEN 'Bash' WHEN 2 THEN 'Read' ELSE 'mcp__db__list_rows' END AS name,
 CASE WHEN idx % 4 IN (0, 2) THEN '/repo/src/m' || conv_id % 7 || CASE WHEN idx % 2 = 0 THEN '.py' ELSE '.md' END END AS file_path FROM tu WHERE has_call),
 cr AS (SELECT ca.*, r.idx AS result_idx, coalesce(r.conv_id % 5 = 0, false) AS is_error, r.idx IS NULL AS pending, (r.sec - ca.sec) * 1000 AS latency_ms FROM ca LEFT JOIN ev r ON r.path = ca.path AND r.idx = ca.idx + 1 AND r.has_result)"""


@query(f"WITH {EV} SELECT path, idx, kind, uuid, text, is_meta, has_call::INT AS n_calls, has_result::INT AS n_results FROM ev")
def transcript_events(spark, d):
    """Typed events of transcript lines."""
    e = events(lines(spark, d))
    return e.select("path", "idx", "kind", "uuid", "text", "is_meta", F.size("calls").alias("n_calls"), F.size("results").alias("n_results"))


@query(f"WITH {TURNED} SELECT path, turn, coalesce(arg_min(text, idx) FILTER (WHERE {OPENS}), '') AS prompt, (arg_min(sec, idx) + {START})::BIGINT AS started, (arg_max(sec, idx) + {START})::BIGINT AS ended, count(*) AS n_events, sum(has_call::INT)::BIGINT AS n_calls FROM tu GROUP BY path, turn")
def session_turns(spark, d):
    t = session.turns(log(spark, d))
    return t.select("path", "turn", "prompt", F.unix_seconds("started_at").alias("started"), F.unix_seconds("ended_at").alias("ended"), "n_events", "n_calls")


@query(f"WITH {TURNED} SELECT path, idx, turn FROM tu QUALIFY turn = max(turn) OVER (PARTITION BY path)")
def session_current_turn(spark, d):
    return session.current_turn(log(spark, d)).select("path", "idx", "turn")


@query(f"WITH {CALLS} SELECT path, turn, idx, call_id, name, file_path, is_error, pending, latency_ms::BIGINT AS latency_ms FROM cr")
def session_calls(spark, d):
    """Calls with their last results."""
    return session.calls(log(spark, d)).select("path", "turn", "idx", "call_id", "name", "file_path", "is_error", "pending", "latency_ms")


@query(f"WITH {CALLS} SELECT path, name, count(*) AS n, count(*) FILTER (WHERE is_error) AS failures, count(*) FILTER (WHERE pending) AS pending, sum(latency_ms)::BIGINT AS ms, max(latency_ms)::BIGINT AS slowest_ms FROM cr GROUP BY path, name")
def session_tool_counts(spark, d):
    return session.call_counts(session.calls(log(spark, d)))


@query(f"""WITH {CALLS} SELECT path, bool_or(NOT is_error AND name = 'Bash') AS has_bash, bool_or(NOT is_error AND name = 'Read' AND coalesce(contains(file_path, 'm3'), false)) AS has_read, bool_or(NOT is_error AND name = 'Edit' AND coalesce(file_path LIKE '%.py', false)) AS has_edit_to,
bool_or(NOT is_error AND name = 'mcp__db__list_rows') AS has_mcp, bool_or(NOT is_error AND pending) AS has_pending, bool_or(NOT is_error AND name = 'Bash' AND conv_id % 10 = 4) AS has_command, bool_or(NOT is_error AND coalesce(file_path LIKE '/repo/%', false)) AS under_repo FROM cr GROUP BY path""")
def session_predicates(spark, d):
    """Many yes-or-no questions about each session in one pass."""
    tests = {
        "has_bash": session.named("Execute|Bash"), "has_read": session.named("Read") & F.col("file_path").contains("m3"), "has_edit_to": session.named("Edit|Write") & session.touches("*.py"), "has_mcp": session.named("list_rows"),
        "has_pending": F.col("pending"), "has_command": F.col("command").rlike(r"\Agit status \d*4\z"), "under_repo": session.under("/repo"),
    }
    return session.predicates(session.calls(log(spark, d)), tests)


@query(f"""WITH {CALLS}, p AS (SELECT path, string_agg(name, ',' ORDER BY idx) AS pending FROM cr c WHERE pending AND turn = (SELECT max(turn) FROM tu t WHERE t.path = c.path) GROUP BY path)
SELECT s.path, p.path IS NOT NULL AS mid_tool, coalesce(pending, '') AS pending FROM (SELECT DISTINCT path FROM ev) s LEFT JOIN p ON p.path = s.path""")
def session_activity(spark, d):
    """Whether a session waits for a tool, and for which."""
    return session.activity(log(spark, d)).select("path", "mid_tool", F.array_join(F.transform("pending", lambda x: x["name"]), ",").alias("pending"))


@query(f"WITH {CALLS} SELECT name, count(*) AS errors FROM cr WHERE is_error GROUP BY name")
def result_error_by_name(spark, d):
    """Failed results by the tool of a call that came earlier."""
    return session.errors_of_earlier_calls(log(spark, d))


@query(f"""WITH {EV} SELECT path, idx, max(CASE WHEN kind = 'assistant' THEN idx END) OVER (PARTITION BY path ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before_assistant,
min(CASE WHEN kind = 'user' AND trim(text) <> '' THEN idx END) OVER (PARTITION BY path ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS next_user,
max(CASE WHEN has_call AND idx % 4 = 0 THEN idx END) OVER (PARTITION BY path ORDER BY idx ROWS BETWEEN 40 PRECEDING AND 1 PRECEDING) AS last_edit FROM ev""")
def session_neighbours(spark, d):
    return session.last_edit_within(session.nearest(log(spark, d))).select("path", "idx", "before_assistant", "next_user", "last_edit")


@query(f"WITH {EV}, r AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY idx DESC) AS r FROM ev WHERE kind = 'assistant' AND trim(text) <> '') SELECT path, string_agg(substr(text, 1, 50), chr(10) || chr(10) ORDER BY idx) AS text FROM r WHERE r <= 2 GROUP BY path")
def last_assistant_text(spark, d):
    return session.assistant_text(log(spark, d), 2, 50)


@query(f"WITH {EV} SELECT path, idx FROM ev QUALIFY idx > max(CASE WHEN has_call THEN idx END) OVER (PARTITION BY path)")
def window_after(spark, d):
    """Events behind the last call."""
    return session.after_last(log(spark, d), F.size("calls") > 0).select("path", "idx")


@query(f"WITH {EV} SELECT path, idx FROM ev QUALIFY coalesce(idx < max(CASE WHEN has_call THEN idx END) OVER (PARTITION BY path), true)")
def window_before(spark, d):
    return session.after_last(log(spark, d), F.size("calls") > 0, before=True).select("path", "idx")


@query(f"WITH {TURNED} SELECT path, idx FROM tu QUALIFY turn < max(turn) OVER (PARTITION BY path)")
def window_prior(spark, d):
    """All turns but the current one."""
    t = log(spark, d)
    return t.join(session.current_turn(t).select("path", F.col("idx").alias("idx")), ["path", "idx"], "left_anti").select("path", "idx")


@query(f"WITH {EV}, r AS (SELECT path, idx, row_number() OVER (PARTITION BY path ORDER BY idx) - 1 AS p FROM ev) SELECT path, idx FROM r WHERE p >= 1 AND p < 4")
def event_range(spark, d):
    """Events at places 1 to 3 of each session."""
    ranked = events(lines(spark, d)).select("path", "idx", F.row_number().over(session.in_order()).alias("p"))
    return ranked.where("p > 1 AND p <= 4").select("path", "idx")


_HITS = "h AS (SELECT path, idx, regexp_matches(text, '(?i)\\bthe\\b') AS a, regexp_matches(text, '[0-9]{2}') AS b FROM ev)"


@query(f"WITH {EV}, {_HITS} SELECT path, idx, concat_ws(',', CASE WHEN a THEN 'article' END, CASE WHEN b THEN 'digits' END) AS hits FROM (SELECT *, max((a OR b)::INT) OVER (PARTITION BY path ORDER BY idx ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near FROM h) WHERE near = 1")
def grep_context(spark, d):
    """Events that match one of two patterns, with one event on either side."""
    found = session.grep(events(lines(spark, d)), {"article": r"(?i)\bthe\b", "digits": "[0-9]{2}"}, context=1, facets=("text",))
    return found.select("path", "idx", F.array_join("hits", ",").alias("hits"))


@query(f"WITH {EV}, {_HITS}, e AS (SELECT path, idx, 'article' AS hit FROM h WHERE a UNION ALL SELECT path, idx, 'digits' FROM h WHERE b) SELECT hit, path, idx FROM e QUALIFY row_number() OVER (PARTITION BY hit ORDER BY path, idx) <= 20")
def grep_multi_cap(spark, d):
    """The first twenty matches of each pattern."""
    found = session.grep(events(lines(spark, d)), {"article": r"(?i)\bthe\b", "digits": "[0-9]{2}"}, cap=20, facets=("text",))
    return found.select(F.explode("hits").alias("hit"), "path", "idx")


@query(f"WITH {EV} SELECT path, idx FROM ev WHERE kind IN ('user', 'assistant') AND NOT (kind = 'user' AND trim(text) = '') AND NOT (kind = 'assistant' AND trim(text) = '' AND NOT has_call)")
def spec_signal(spark, d):
    """Conversation without noise, sidechains and empty turns."""
    return spec.keep(events(lines(spark, d)), spec.SIGNAL).select("path", "idx")


@query(f"""WITH {EV}, w AS (SELECT *, len(list_filter(string_split_regex(text, '[ \\t\\n\\r]+'), lambda x: x <> '')) AS words FROM ev)
SELECT path, idx, concat_ws(',', CASE WHEN kind = 'user' AND words <= 5 THEN 'short' END, CASE WHEN kind = 'assistant' AND NOT coalesce(regexp_matches(text, '(?i)(?:the)|(?:[0-9])'), false) THEN 'plain' END, CASE WHEN is_meta THEN 'meta' END) AS labels FROM w""")
def spec_labels(spark, d):
    """Tags, of which the negated one applies to assistants alone."""
    rules = [spec.Rule("words_at_most", 5, "tag", ("user",), label="short"), spec.Rule("text_matches", {"patterns": ["the", "[0-9]"], "ignore_case": True}, "tag", ("assistant",), True, "plain"), spec.Rule("meta_flag", "is_meta", "tag", label="meta")]
    return spec.annotate(events(lines(spark, d)), rules).select("path", "idx", F.array_join("labels", ",").alias("labels"))


@query(f"""WITH {EV}, n AS (SELECT *, max(CASE WHEN kind = 'assistant' THEN idx END) OVER (PARTITION BY path ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS trigger_idx, len(list_filter(string_split_regex(text, '[ \\t\\n\\r]+'), lambda x: x <> '')) AS words FROM ev)
SELECT path, idx, trigger_idx, least(1.0, (0.5 - CASE WHEN words <= 2 THEN 0.25 ELSE 0 END) + CASE WHEN coalesce(idx - trigger_idx <= 2, false) THEN 0.25 ELSE 0 END)::DOUBLE AS confidence FROM n WHERE kind = 'user' AND trim(text) <> ''""")
def mine_user_message(spark, d):
    return mining.messages(log(spark, d)).select("path", "idx", "trigger_idx", "confidence")


@query(f"WITH {CALLS} SELECT c.path, c.result_idx AS idx, c.idx AS trigger_idx, 'not ' || c.conv_id AS text, 0.5::DOUBLE AS confidence FROM cr c WHERE c.conv_id % 10 = 0 AND NOT c.pending UNION ALL SELECT r.path, r.idx, NULL, 'not ' || r.conv_id, 0.5::DOUBLE FROM ev r WHERE r.has_result AND r.conv_id % 10 = 0 AND NOT EXISTS (SELECT 1 FROM ev a WHERE a.path = r.path AND a.idx = r.idx - 1 AND a.has_call)")
def mine_denial(spark, d):
    """Rejected results with what the user said, each with its call."""
    return mining.denials(log(spark, d)).select("path", "idx", "trigger_idx", "text", "confidence")


@query(f"WITH {EV} SELECT 'message' AS detector, 0 AS rank, count(*) AS n FROM ev WHERE kind = 'user' AND trim(text) <> '' UNION ALL SELECT 'denial', 3, count(*) FROM ev WHERE has_result AND conv_id % 10 = 0 HAVING count(*) > 0")
def mine_union(spark, d):
    return mining.mine(log(spark, d)).groupBy("detector", "rank").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {CALLS}, f AS (SELECT name, count(*) AS n, min(path || lpad(idx::VARCHAR, 9, '0')) AS first FROM ca GROUP BY name) SELECT name, n, row_number() OVER (ORDER BY n DESC, first) AS place FROM f")
def tool_histogram(spark, d):
    """Calls by tool, most frequent first; ties by who was seen first."""
    from pyspark.sql import Window

    each = events(lines(spark, d)).select("path", "idx", F.explode("calls").alias("c"))
    counts = each.groupBy(F.col("c.name").alias("name")).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("path", "idx")).alias("first"))
    return counts.select("name", "n", F.row_number().over(Window.orderBy(F.desc("n"), "first")).cast("long").alias("place"))  # one row a tool


@query(f"WITH {CALLS} SELECT 'db' AS server, 'list_rows' AS tool, 'read' AS access, count(*) AS n FROM ca WHERE name = 'mcp__db__list_rows' HAVING count(*) > 0")
def mcp_summary(spark, d):
    each = session.calls(log(spark, d)).withColumn("mcp", markers.mcp_parts(F.col("name"))).where("mcp is not null")
    return each.groupBy("mcp.server", "mcp.tool", markers.mcp_access(F.col("mcp.tool")).alias("access")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {EV} SELECT path, round(sum(CASE WHEN conv_id % 3 = 0 THEN length(text) * 5.0 + idx * 10 * 25.0 + 5 * 0.5 ELSE length(text) * 3.0 + idx * 10 * 15.0 + 5 * 0.3 END) / 1e6, 9)::DOUBLE AS dollars FROM ev WHERE kind = 'assistant' GROUP BY path""")
def cost_breakdown(spark, d):
    """Dollars of each session's tokens."""
    e = events(lines(spark, d)).where("kind = 'assistant'")
    return e.groupBy("path").agg(F.round(F.sum(scalars.cost(F.col("model"), F.col("input_tokens"), F.col("output_tokens"), F.col("cache_read_input_tokens"), F.col("cache_creation_input_tokens"))), 9).alias("dollars"))


@query(f"WITH {CALLS} SELECT path, name, idx, latency_ms::BIGINT AS latency_ms FROM cr WHERE NOT pending ORDER BY latency_ms DESC, path, idx LIMIT 5")
def slowest_top5(spark, d):
    return session.calls(log(spark, d)).where("not pending").select("path", "name", "idx", "latency_ms").orderBy(F.desc("latency_ms"), "path", "idx").limit(5)


@query(f"""WITH {CALLS}, w AS (SELECT * FROM cr WHERE name = 'Edit' AND NOT is_error), s AS (SELECT file_path, path, max(sec) AS last, count(*) AS n FROM w GROUP BY file_path, path)
SELECT file_path, path AS owner, n FROM s QUALIFY row_number() OVER (PARTITION BY file_path ORDER BY last DESC, path) = 1""")
def attribute_owner(spark, d):
    """The session that wrote each file last, with its writes; ties to the smaller name."""
    wrote = session.calls(log(spark, d)).where(F.col("name").isin(*session.EDITS) & ~F.col("is_error") & F.col("file_path").isNotNull())
    each = wrote.groupBy("file_path", "path").agg(F.max("ts").alias("last"), F.count(F.lit(1)).alias("n"))
    top = each.groupBy("file_path").agg(F.max("last").alias("last"))
    return each.join(top, ["file_path", "last"]).groupBy("file_path").agg(F.min(F.struct("path", "n")).alias("o")).select("file_path", F.col("o.path").alias("owner"), "o.n")


@query(f"""WITH {CALLS}, e AS (SELECT * FROM cr WHERE name = 'Edit') SELECT a.call_id AS first, b.call_id AS later, round(2 / 3.0, 6)::DOUBLE AS overlap FROM e a JOIN e b ON a.path = b.path AND a.file_path = b.file_path AND a.idx < b.idx AND b.turn - a.turn <= 2""")
def range_corrections(spark, d):
    """Edits and later ones of the same file within two turns, with the share of new lines that the later one takes away."""
    e = session.calls(log(spark, d)).where("name = 'Edit'").select("path", "file_path", "turn", "idx", "call_id", F.col("hunks")[0].alias("h"))
    later = e.select("path", "file_path", F.col("turn").alias("t"), F.col("idx").alias("i"), F.col("call_id").alias("later"), F.col("h").alias("g"))
    met = e.join(later, ["path", "file_path"]).where("idx < i AND t - turn <= 2")
    return met.select(F.col("call_id").alias("first"), "later", F.round(scalars.overlap(F.col("h.new"), F.col("g.old")), 6).alias("overlap"))


@query("""WITH c AS (SELECT conv_id, role, text, conv_id * 3600 + turn * 50 AS sec FROM conversations WHERE text IS NOT NULL AND role IN ('user', 'assistant')),
o AS (SELECT *, (min(sec) OVER (PARTITION BY conv_id) // 180) * 180 AS origin, count(*) FILTER (WHERE role = 'user') OVER (PARTITION BY conv_id) AS users FROM c)
SELECT 's' || conv_id AS session_id, ((sec - origin) // 180)::BIGINT AS bucket, count(*) AS n FROM o WHERE users >= 2 GROUP BY ALL HAVING count(*) FILTER (WHERE role = 'user' AND length(trim(text)) >= 5) > 0 AND count(*) FILTER (WHERE role = 'assistant') > 0""")
def conversation_buckets(spark, d):
    """Three-minute windows from each session's start that hold a user's text of five characters and an assistant's turn; noise is no turn."""
    from lorekeep.operators.timed import conversation_windows

    return conversation_windows(events(lines(spark, d)))


@query("SELECT doc_id, CASE WHEN length(text) > 40 THEN substr(text, 1, 40) || '…(+' || (length(text) - 40) || 'ch)' ELSE text END AS clip, CASE WHEN strlen(text) < 1024 THEN strlen(text) || 'B' WHEN strlen(text) < 1048576 THEN printf('%.1fKB', strlen(text) / 1024.0) WHEN strlen(text) < 1073741824 THEN printf('%.1fMB', strlen(text) / 1048576.0) ELSE printf('%.1fGB', strlen(text) / 1073741824.0) END AS size FROM documents")
def clip_and_size(spark, d):
    return table(spark, d, "documents").select("doc_id", scalars.clip(F.col("text"), 40).alias("clip"), scalars.human_size(F.octet_length("text")).alias("size"))


@query("WITH RECURSIVE e AS (SELECT 'r' || n_regionkey AS parent, 'n' || n_nationkey AS child FROM nation UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer), w(node, depth) AS (SELECT 'r1', 0 UNION SELECT e.child, w.depth + 1 FROM w JOIN e ON e.parent = w.node WHERE w.depth < 12) SELECT node, min(depth)::INT AS depth FROM w GROUP BY node")
def session_tree(spark, d):
    """All that a root leads to, over edges with cycles; no node is more than 12 steps away."""
    n, c = table(spark, d, "nation"), table(spark, d, "customer")
    r, k = F.concat(F.lit("r"), "n_regionkey"), F.concat(F.lit("n"), "n_nationkey")
    edges = n.select(r.alias("parent"), k.alias("child")).unionByName(n.select(k.alias("parent"), r.alias("child"))).unionByName(c.select(F.concat(F.lit("n"), "c_nationkey").alias("parent"), F.concat(F.lit("c"), "c_custkey").alias("child")))
    return deep.reachable(edges, spark.createDataFrame([("r1",)], "node string")).select("node", "depth")
